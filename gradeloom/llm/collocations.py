"""Collocations: phrases of two to four words by counts of padded windows and their rolled-up prefixes.

Every word of a piece gives one window: the word and its three leads, padded
where the piece ends. Equal windows are counted, and that is the only count of
n-grams: a phrase of k words occurs where a window starts with it, so
`ROLLUP` over the window's columns sums up all shorter prefixes, down to single
words and to the words of a language.

Most windows of a large corpus are rare, and would be shuffled for nothing. So a
window is padded also where no phrase can go on that is frequent enough: its
prefixes are counted first in a sketch by hash, which never counts too low. A
phrase with enough occurrences, and each of its prefixes, passes the sketch, so
what is reported doesn't depend on it. The sketch has about as many slots as the
corpus has words, summed up over slots in blocks; only one bit per slot is
broadcast, at most `MOST_SLOTS` bits. Beyond that it pads less, with equal results.

A text is cut at `[.,;:!?]` and line breaks into pieces, these at spaces and
tabs into words, A-Z lowered. Null texts are empty; a null language is `und`, as
is the language of that name. Repeated rows count each. Ids and other columns are
not read. A piece is in one task; longer texts are taken piece by piece. An empty
table, or one without frequent phrases, gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import mapped, table, written
from gradeloom.operators.spread import join_unique, partitions

LEAST, KEPT_PERCENT, FIRST = 30, 80, 2000
COLUMNS = ["w1", "w2", "w3", "w4"]
#: Slots of the sketch, and slots of one block of it.
LEAST_SLOTS, MOST_SLOTS, BLOCK = 1 << 16, 1 << 30, 1 << 16
#: Words that are made windows at once, slot numbers that a task gathers before it sums them, bytes of a text at once.
AT_ONCE, GATHERED, BYTES = 1 << 18, 2 << 20, 4 << 20

#: Ends a piece; no byte of UTF-8.
_END = b"\xff"
_CUTS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _END * 10)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: str) -> Iterator[list[bytes]]:
    """Words in order, `_END` after each piece, in lists that hold whole pieces."""
    data = text.encode().lower().translate(_CUTS)
    at = 0
    while at < len(data):
        cut = data.find(_END, at + BYTES)
        cut = len(data) if cut < 0 else cut + 1
        # What splits here is space and tab: the other white space has become piece ends.
        words = data[at:cut].replace(_END, b" \xff ").split()
        if words:
            words.append(_END)
            yield words
        at = cut


class Windows:
    """The windows of some texts as columns of word numbers; 0 is padding."""

    def __init__(self, groups: list[tuple[str, list[bytes]]]):
        import xxhash

        self.langs = list(dict.fromkeys(lang for lang, _ in groups))
        of_lang = {lang: i for i, lang in enumerate(self.langs)}
        numbers: dict[bytes, int] = {_END: 0}
        flat = np.fromiter((numbers.setdefault(w, len(numbers)) for _, words in groups for w in words), np.int64)
        self.words = list(numbers)
        lang = np.repeat([of_lang[x] for x, _ in groups], [len(words) for _, words in groups])
        is_word = flat > 0
        columns = [flat[is_word]]
        for k in range(1, 4):
            lead = np.append(flat[k:], np.zeros(min(k, len(flat)), np.int64))[is_word]
            columns.append(np.where(columns[-1] > 0, lead, 0))
        self.lang, self.columns = lang[is_word], columns
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        self.lang_hashes = np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in self.langs], np.uint64)

    def slots(self, slots: int) -> Iterator[np.ndarray]:
        """For the prefixes of 2, 3 and 4 words, the slot of each window, in 32 bits."""
        h = self.lang_hashes[self.lang] ^ self.hashes[self.columns[0]]
        for column in self.columns[1:]:
            h = (h * _ODD) ^ self.hashes[column]
            h ^= h >> np.uint64(29)
            yield (((h * _ODD) >> np.uint64(20)) & np.uint64(slots - 1)).astype(np.uint32)

    def padded(self, bits: np.ndarray) -> None:
        """Pads each window behind its longest prefix whose slots are all marked."""
        goes_on = np.ones(len(self.lang), bool)
        for k, slot in enumerate(self.slots(len(bits) * 8), 1):
            goes_on &= (bits[slot >> np.uint32(3)] >> (slot & np.uint32(7)).astype(np.uint8) & 1) > 0
            self.columns[k] = np.where(goes_on, self.columns[k], 0)

    def counted(self) -> pa.RecordBatch:
        """Distinct windows: lang, w1 to w4 (null: padding), n."""
        size = len(self.words)

        def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            distinct, number = np.unique(values, return_inverse=True)
            return distinct, number

        head, of_head = numbered((self.lang * size + self.columns[0]) * size + self.columns[1])
        tail, of_tail = numbered(self.columns[2] * size + self.columns[3])
        both, n = np.unique(of_head * len(tail) + of_tail, return_counts=True)
        head, tail = head[both // max(1, len(tail))], tail[both % max(1, len(tail))]
        words = pa.array(self.words[1:], pa.binary()).cast(pa.string())
        langs = pa.array(self.langs, pa.string()).take(pa.array(head // size // size))
        columns = [head // size % size, head % size, tail // size, tail % size]
        taken = [words.take(pa.array(c - 1, mask=c == 0)) for c in columns]
        return pa.RecordBatch.from_arrays([langs, *taken, pa.array(n, pa.int64())], ["lang", *COLUMNS, "n"])


def in_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[Windows]:
    """Batches (lang, text) as windows of some `AT_ONCE` words at a time."""
    groups, n = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            name = lang.as_py()
            for words in pieces(text.as_py()):
                groups.append((name, words))
                n += len(words)
                if n >= AT_ONCE:
                    yield Windows(groups)
                    groups, n = [], 0
    if groups:
        yield Windows(groups)


# --- the sketch -------------------------------------------------------------------------------


def block_rows(slots: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Counted slots as one row per block: numbers inside the block, then their counts, compressed."""
    found, n = np.unique(slots, return_counts=True)
    blocks = found // np.uint32(BLOCK)
    starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(found) else np.zeros(0, int)
    for a, b in zip(starts, [*starts[1:], len(found)], strict=True):
        inside = (found[a:b] % np.uint32(BLOCK)).astype("<u2")
        steps = np.diff(inside, prepend=np.uint16(0)).astype("<u2")
        yield int(blocks[a]), zlib.compress(steps.view("u1").reshape(-1, 2).T.tobytes() + n[a:b].astype("<u4").view("u1").reshape(-1, 4).T.tobytes(), 1)


def counts_in(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), "u1")
    k = len(planes) // 6
    steps = np.ascontiguousarray(planes[: 2 * k].reshape(2, k).T).view("<u2").ravel()
    n = np.ascontiguousarray(planes[2 * k :].reshape(4, k).T).view("<u4").ravel()
    return np.cumsum(steps.astype(np.int64)), n.astype(np.int64)


def rows_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["block", "data"]
    )


def sketcher(slots: int) -> Callable:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0
        for windows in in_windows(batches):
            for column, slot in zip(windows.columns[1:], windows.slots(slots), strict=True):
                gathered.append(slot[column > 0])
                n += len(gathered[-1])
            if n >= GATHERED:
                yield rows_batch(list(block_rows(np.concatenate(gathered))))
                gathered, n = [], 0
        if n:
            yield rows_batch(list(block_rows(np.concatenate(gathered))))

    return sketch


def marker(least: int) -> Callable:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of their block, to one row of bits per block."""
        at, total = None, None

        def bits() -> pa.RecordBatch:
            return rows_batch([(at, np.packbits(total >= least, bitorder="little").tobytes())])

        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != block:
                    if at is not None:
                        yield bits()
                    at, total = block, np.zeros(BLOCK, np.int64)
                places, n = counts_in(data)
                total[places] += n
        if at is not None:
            yield bits()

    return mark


def slots_for(rows: DataFrame) -> int:
    """A power of two that is about the number of words, by the texts' bytes."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (size // 6).bit_length()))


def marked(rows: DataFrame, slots: int, least: int) -> np.ndarray:
    """One bit per slot: whether its prefixes have enough occurrences together."""
    counted = mapped(rows, sketcher(slots), "block int, data binary")
    ordered = counted.repartition("block").sortWithinPartitions("block")
    bits = np.zeros(slots // 8, np.uint8)
    for row in ordered.mapInArrow(marker(least), "block int, data binary").toLocalIterator(prefetchPartitions=False):
        bits[row["block"] * (BLOCK // 8) :][: BLOCK // 8] = np.frombuffer(row["data"], np.uint8)
    return bits


# --- counts, scores, ranks --------------------------------------------------------------------


def prefix_counts(documents: DataFrame, text: str, lang: str, least: int) -> DataFrame:
    """(lang, words, n) of all phrases of up to four words with `least` occurrences; no words: all of the language."""
    spark = documents.sparkSession
    rows = documents.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    bits = spark.sparkContext.broadcast(marked(rows, slots_for(rows), least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for windows in in_windows(batches):
            windows.padded(bits.value)
            yield windows.counted()

    layout = "lang string, w1 string, w2 string, w3 string, w4 string, n long"
    windows = mapped(rows, count, layout).groupBy("lang", *COLUMNS).agg(F.sum("n").alias("n"))
    summed = windows.rollup("lang", *COLUMNS).agg(F.sum("n").alias("n"), F.grouping_id().alias("rolled"))
    # A null in a column that is not rolled up is padding: the window is counted by its shorter prefix.
    words = {15: 0, 7: 1, 3: 2, 1: 3, 0: 4}
    whole = reduce(
        lambda a, b: a | b,
        [(F.col("rolled") == r) & (F.col(COLUMNS[k - 1]).isNotNull() if k else F.lit(True)) for r, k in words.items()],
    )
    frequent = summed.where(whole & ((F.col("n") >= least) | (F.col("rolled") == 15)))
    return frequent.select("lang", F.array_compact(F.array(*COLUMNS)).alias("words"), "n")


def phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def key(words: Column) -> Column:
    """Language and phrase as one value; words have no tab."""
    return F.concat(F.col("lang"), F.lit("\t"), phrase(words))


def wide(column: str) -> Column:
    """For products that may pass 64 bits."""
    return F.col(column).cast("decimal(20,0)")


def collocations(
    documents: DataFrame, text: str = "text", lang: str = "lang",
    least: int = LEAST, kept_percent: int = KEPT_PERCENT, first: int = FIRST,
) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = written(prefix_counts(documents, text, lang, least), "phrase-counts")
    length = F.size("words")
    candidates = counts.where(length > 1).select("lang", "words", F.col("n").alias("a"))
    # A part occurs at least as often as its phrase, so all parts are among the counts.
    parts = counts.where(length.between(1, 3)).select(key(F.col("words")).alias("part"), "n")
    cuts = written(candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1))), "phrase-cuts")
    ends = {
        "l": F.slice("words", F.lit(1), F.col("k")),
        "r": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")),
    }
    for name, words in ends.items():
        cuts = join_unique(cuts.withColumn("part", key(words)), parts.withColumnRenamed("n", name), "part", "inner").drop("part")
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("words") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda at: F.slice("words", at, n)),
        )
    )
    longer = candidates.where(length > 2).select("lang", F.explode(inner).alias("words"), "a")
    longer = longer.groupBy("lang", "words").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "words"], "left").where(
        F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * kept_percent)
    )
    totals = counts.where(length == 0).select(F.col("lang").alias("_lang"), F.col("n").alias("n"))
    rows = kept.select("lang", phrase(F.col("words")).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    # The first of each share, and of these the first of all: no task sorts a language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shared = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(partitions(rows))))
    shared = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)))
    ranked = shared.where(F.col("rank") <= first).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= first).join(totals, F.col("lang") == F.col("_lang")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM lists
), grams AS (
  SELECT lang, w[p : p + k - 1] AS words, k FROM places, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE p + k - 1 <= len(w)
), counts AS (
  SELECT lang, words, len(words) AS k, count(*) AS f FROM grams GROUP BY lang, words HAVING count(*) >= 30
), totals AS (
  SELECT lang, count(*) AS n FROM places GROUP BY lang
), cuts AS (
  SELECT c.lang, c.words, c.f AS a, j, x.f AS l, y.f AS r,
    CAST(2000000 * CAST(c.f AS HUGEINT) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM counts WHERE k > 1) c
  JOIN counts x ON x.lang = c.lang AND x.words = c.words[1 : j]
  JOIN counts y ON y.lang = c.lang AND y.words = c.words[j + 1 : c.k]
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, j) = 1
), inner_parts AS (
  SELECT lang, words[s : s + m - 1] AS words, f
  FROM (SELECT lang, words, f, k, unnest(range(2, k)) AS m FROM counts WHERE k > 2), (SELECT unnest([1, 2, 3]) AS s)
  WHERE s + m - 1 <= k
), longer AS (
  SELECT lang, words, max(f) AS f FROM inner_parts GROUP BY lang, words
), kept AS (
  SELECT s.*, array_to_string(s.words, ' ') AS phrase
  FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.words = s.words
  WHERE g.f IS NULL OR 100 * CAST(g.f AS HUGEINT) < 80 * CAST(a AS HUGEINT)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
