"""Decontamination: which words of a document repeat a window of a benchmark item.

A prefix-filtered set join. The words of a window are ordered by rarity in the
documents. A document that contains the window contains all its words, so of
the ordered words a prefix of one is necessary: the rarest. Documents give only
the places of such words, with the words around; these join the windows on the
word. A place and the word's position in the window fix where the window would
start, which has to be inside the document for the window's length, and the
words there are compared with the window's.

To drop most words before the join, tasks get a bit table of fixed size with a
bit for each hash of a word that matters; a larger benchmark fills it more and
lets more words through, and the result is the same. The join itself is Spark's
to choose: it broadcasts the windows' words while they are small.

Words are runs of digits, a-z (after lowering A-Z) and characters beyond ASCII.
Null texts have no words. Items without words have no window; an item without
id counts for words hit, but not among the items. Rows of the benchmark that
share an id are one item. Documents that agree in id and text are alike. Extra
columns are ignored or passed through. Empty tables give empty or clean results.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import keyed, mapped, packed, table, texts, unpacked, written

WINDOW = 10
#: Bits of the word filter; the table that tasks get has an eighth of it in bytes.
FILTER_BITS = 1 << 22
#: Distinct words a task counts before it emits them.
COUNTED = 100_000

#: Everything that splits words becomes a space, A-Z become a-z.
_SPLIT = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_SPLIT).split()


def windows_of(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(item, window): the distinct windows of each item, words joined by a space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for item, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                words = words_of(t)
                for i in range(max(1, len(words) - size + 1) if words else 0):
                    found.append((item, b" ".join(words[i : i + size]).decode()))
            items, windows = ([x[k] for x in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.string())], ["item", "window"])

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return mapped(rows, cut, "item string, window string").distinct()


def word_filter(words: DataFrame) -> bytes:
    """The bit table of a column of words; at most FILTER_BITS numbers come to the driver."""
    bits = np.zeros(FILTER_BITS, bool)
    slots = words.select((F.crc32("word") % FILTER_BITS).alias("slot")).distinct()
    for batch in slots.toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = True
    return np.packbits(bits).tobytes()


def unfolded(table: bytes) -> bytes:
    """A byte for each bit, which is faster to look up."""
    return np.unpackbits(np.frombuffer(table, np.uint8)).tobytes()


def counting(filter_table) -> Callable:
    """Batches (text) to (word, n) of the words that pass the filter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, last = unfolded(filter_table.value), FILTER_BITS - 1
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            found = [pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(found, ["word", "n"])

        for batch in batches:
            for t in texts(batch):
                counts.update(w for w in words_of(t) if passes[zlib.crc32(w) & last])
                if len(counts) > COUNTED:
                    yield rows()
        if counts:
            yield rows()

    return count


def placing(filter_table, size: int) -> Callable:
    """Batches (id, _k1, _k2, text) to those, the number of words, and the places of words that pass the filter."""
    place = pa.struct([("word", pa.string()), ("pos", pa.int32()), ("ahead", pa.int32()), ("around", pa.list_(pa.string()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, last = unfolded(filter_table.value), FILTER_BITS - 1
        crc = zlib.crc32
        for batch in batches:
            n_words, places = [], []
            for t in texts(batch):
                words = words_of(t)
                n_words.append(len(words))
                found = []
                for i in [i for i, w in enumerate(words) if passes[crc(w) & last]]:
                    low = max(0, i - size + 1)
                    around = [w.decode() for w in words[low : i + size]]
                    found.append({"word": words[i].decode(), "pos": i, "ahead": i - low, "around": around})
                places.append(found)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n_words, pa.int64()), pa.array(places, pa.list_(place))],
                ["id", "_k1", "_k2", "n_words", "places"],
            )

    return find


def rarest(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, word, offset, size): the prefix of each window, its rarest word and where it stands in the window."""
    words = windows.select("window", F.posexplode(F.split("window", " ")).alias("offset", "word"))
    ranked = words.join(counts, "word", "left")
    least = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("m")
    return ranked.groupBy("window").agg(least).select(
        "window", "m.word", "m.offset", F.size(F.split("window", " ")).alias("size")
    )


def contaminated(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", size: int = WINDOW,
) -> DataFrame:
    """Documents as (id, _k1, _k2, n_words, n_hit, items): words hit, and the ids of the items, sorted as strings."""
    context = documents.sparkSession.sparkContext
    rows = keyed(documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")), ["id", "text"])
    item_windows = written(windows_of(items, item_id, item_text, size), "item-windows")
    windows = item_windows.select("window").distinct()
    vocabulary = windows.select(F.explode(F.split("window", " ")).alias("word")).distinct()
    matter = context.broadcast(word_filter(vocabulary))
    # Sorted in counts by words of the windows alone: others that pass the filter don't join.
    counts = mapped(rows.select("text"), counting(matter), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    prefixes = written(rarest(windows, counts), "window-prefixes")
    needed = context.broadcast(word_filter(prefixes.select("word").distinct()))
    schema = "id long, _k1 long, _k2 long, n_words long, places array<struct<word:string,pos:int,ahead:int,around:array<string>>>"
    found = written(mapped(rows.select("id", "_k1", "_k2", "text"), placing(needed, size), schema), "word-places")
    keys = ["_k1", "_k2"]
    start = F.col("p.pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    there = F.array_join(F.slice("p.around", F.col("p.ahead") - F.col("offset") + 1, F.col("size")), " ")
    places = found.select(*keys, "n_words", F.explode("places").alias("p")).withColumn("word", F.col("p.word"))
    matched = (
        places.join(prefixes, "word").where(inside).where(there == F.col("window"))
        .select(*keys, start.alias("start"), "size", "window")
    )
    matched = written(matched.distinct(), "window-matches")
    hit = (
        matched.select(*keys, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos"))
        .distinct().groupBy(*keys).agg(F.count("*").alias("n_hit"))
    )
    of = (
        matched.select(*keys, "window").distinct().join(item_windows, "window")
        .groupBy(*keys).agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    joined = found.select("id", *keys, "n_words").join(hit.join(of, keys), keys, "left")
    return joined.withColumn("n_hit", F.coalesce("n_hit", F.lit(0))).withColumn(
        "items", F.coalesce("items", F.array().cast("array<string>"))
    )


def decontaminated(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no window of an item occurs."""
    hit = contaminated(documents, items, doc_id, text).where("n_hit > 0").select("_k1", "_k2").distinct()
    rows = packed(documents.withColumn(doc_id, F.col(doc_id).cast("long")), [doc_id, text])
    return unpacked(rows.join(hit, ["_k1", "_k2"], "left_anti"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT id, size, p, array_to_string(w[p : p + size - 1], ' ') AS win
  FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM docs, sizes)
), matched AS (
  SELECT id, p, size, item_id FROM doc_windows JOIN item_windows USING (size, win)
), hit AS (
  SELECT id, count(DISTINCT pos) AS n_hit FROM (SELECT id, unnest(range(p, p + size)) AS pos FROM matched) GROUP BY id
), of_items AS (
  SELECT id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM matched GROUP BY id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (id) LEFT JOIN of_items USING (id)
"""
