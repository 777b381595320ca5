"""Token counts with a stored cache.

The cache is a table (content, tokenizer, n_tokens): digests of a normalised
text and of the tokenizer. A call joins the digests of its texts to the cache,
encodes each distinct text that is missing once, and appends it. Appending is
one Spark write, so a lost executor repeats tasks but never leaves half a
result; if two calls append the same text, readers take one row of the two.

Null text counts as empty and empty texts have no tokens. Rows with the same id
stay apart. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import mapped, table
from gradeloom.session import scratch_path

CACHE = "content binary, tokenizer binary, n_tokens long"
#: Distinct words that a task remembers the counts of, and words that it encodes at a time.
REMEMBERED, AT_ONCE = 400_000, 20_000


def tokenizer_digest(model: str) -> bytes:
    """Digest of the tokenizer's file and the library's version."""
    import tokenizers

    return hashlib.sha256(tokenizers.__version__.encode() + b"\0" + Path(model).read_bytes()).digest()


def normalised(text: Column) -> Column:
    """Runs of spaces, tabs and line ends as one space, none at the ends.

    The tokenizer drops white space between words, so this leaves all counts as
    they are. Letter case stays: the marks of special tokens depend on it.
    """
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


class Counter:
    """Counts the tokens of texts that `normalised` gave.

    The tokenizer works on each stretch between spaces by itself (no rule of
    it, its special tokens included, reaches over a space), so a text's count
    is the sum over its words, and a task encodes each distinct word once.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def count(self, many: list[str]) -> list[int]:
        split = [text.split(" ") if text else [] for text in many]
        new: set[str] = set()
        for words in split:
            new.update(words)
        new = {w for w in new if w not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            new = {w for words in split for w in words}
            self.known = {}
        todo = list(new)
        for at in range(0, len(todo), AT_ONCE):
            part = todo[at : at + AT_ONCE]
            encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update(zip(part, map(len, encoded), strict=True))
        known = self.known
        return [sum(map(known.__getitem__, words)) for words in split]


def encoder(model: str, tokenizer: bytes):
    """Batches (content, text) to rows of the cache."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        # One process per task; the library's own threads would take the others' cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = counter.count([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.binary()),
                        pa.array([tokenizer] * part.num_rows, pa.binary()),
                        pa.array(counts, pa.int64()),
                    ],
                    ["content", "tokenizer", "n_tokens"],
                )

    return encode


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at a path; empty if there is none yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def token_counts(documents: DataFrame, model: str, cache: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as (doc_id, n_bytes, n_tokens); the table at `cache` gets what it lacked.

    Copies of a text are dropped before the shuffle, so a text that a third of
    all rows share is encoded once and moves once per input split.
    """
    spark, tokenizer = documents.sparkSession, tokenizer_digest(model)
    key = F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("content")
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    distinct = rows.select(key, normalised(F.col("text")).alias("text")).dropDuplicates(["content"])
    stored = read_cache(spark, cache).where(F.col("tokenizer") == F.lit(tokenizer))
    missing = distinct.join(stored, "content", "left_anti")
    mapped(missing, encoder(model, tokenizer), CACHE).write.mode("append").parquet(cache)
    counts = (
        read_cache(spark, cache)
        .where(F.col("tokenizer") == F.lit(tokenizer))
        .groupBy("content")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    digests = rows.select("doc_id", key, F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return digests.join(counts, "content").select("doc_id", "n_bytes", "n_tokens")


#: Longest text, in tokens, that a training sequence takes.
LIMIT = 2048


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a cache of this call alone, so that every text is encoded here."""
    import public_tokenizers

    model = public_tokenizers.path("word_bpe_49k.json")
    counted = token_counts(table(spark, sf_dir, "documents"), model, scratch_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
