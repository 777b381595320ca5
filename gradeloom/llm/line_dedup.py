"""Removal of line runs that the corpus has had before, in Spark expressions only.

Lines with a word are the letters of one long text. Prefix doubling gives every
line position the rank of its suffix among all suffixes, compared by their
first 1, 2, 4, ... lines: a rank is the number of suffixes that sort before, so
the suffixes that share their first n lines stand side by side in the suffix
array, as the interval of a longest common prefix of at least n lines. A run of
any length is named by the intervals of two powers of two that cover it.

A repeated run counts if it has `least_words` words. Every such run is covered
by runs that are as short as they can be from their first or from their last
line, so only these are looked up: the copies of one form an interval, and all
but the first copy, by document id and line, are deleted. A copy that overlaps
the first one is no copy of its own and stays, so the first is always whole:
of thirty equal lines of five words, ten stay.

Lines that occur once can't be in a repeated run, so positions are reduced to
repeated lines before any doubling; as each line has a word, runs have no more
lines than `least_words`, and the number of rounds is its logarithm.

Null texts stay null, and lines without a word stay. Null ids come last in the
order. Rows that agree in id and text count as one document and are changed
alike. Other columns pass through. An empty table gives an empty table. A very
long text is a value of one task when it is split and put together again; its
lines are rows in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import WORD, packed, table, written

LEAST_WORDS = 50
#: Occurrences that are put in order in one task, about, and ranks that one group of followers spans.
AT_ONCE, SPAN = 50_000, 1 << 16

DOC = ["_k1", "_k2"]


def before(window: Window, count: str) -> Column:
    return F.coalesce(F.sum(count).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered_lines(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Lines with a word: document key and id, seq among these lines, line number, words, two hashes."""
    every = F.transform(
        F.split(F.col(f"_row.`{text}`"), "\n", -1), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))
    )
    with_word = F.filter(every, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(
        *DOC, F.col(f"_row.`{doc_id}`").cast("long").alias("id"), F.posexplode(with_word).alias("seq", "x")
    ).select(
        *DOC,
        "id",
        "seq",
        F.col("x.pos").alias("pos"),
        F.regexp_count("x.line", F.lit(WORD)).alias("words"),
        F.xxhash64("x.line").alias("h1"),
        F.xxhash64(F.lit(7), "x.line").alias("h2"),
    )


def repeated_positions(lines: DataFrame) -> DataFrame:
    """The positions of lines that occur more than once, with rank `r0` by their line alone.

    Ranks start at 1. Distinct lines are few against their occurrences, and they
    are summed up in ranges of the hash, so no order over all of them is needed.
    """
    ids = written(
        lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "repeated-lines"
    )
    total = ids.agg(F.sum("n")).first()[0] or 0
    bits = max(1, (total // AT_ONCE).bit_length())
    ranged = ids.withColumn("range", F.shiftright("h1", 64 - bits))
    ranges = ranged.groupBy("range").agg(F.sum("n").alias("n"))
    offsets = ranges.select("range", before(Window.orderBy("range"), "n").alias("offset"))
    inside = before(Window.partitionBy("range").orderBy("h1", "h2"), "n")
    ranked = ranged.withColumn("inside", inside).join(offsets, "range")
    ranked = ranked.select("h1", "h2", (F.col("inside") + F.col("offset") + 1).alias("r0"))
    # Rows that agree in id and text have the same keys: one of them is enough.
    found = lines.join(ranked, ["h1", "h2"]).drop("h1", "h2").dropDuplicates([*DOC, "seq"])
    return written(found, "line-positions")


def doubled(positions: DataFrame, level: int) -> DataFrame:
    """Adds the rank by the first 2 ** (level + 1) lines, from the ranks by half as many.

    The new rank of a pair (rank, rank that many lines on) is the old rank plus
    the suffixes of the same old rank whose second rank is smaller. Those are
    counted in two steps, over spans of the second rank and inside a span, so
    that a line with very many followers is no single group.
    """
    old, new, step = f"r{level}", f"r{level + 1}", 1 << level
    in_doc = Window.partitionBy(*DOC).orderBy("seq")
    follows = F.lead("seq", step).over(in_doc) == F.col("seq") + step
    pairs = positions.withColumn("b", F.when(follows, F.lead(old, step).over(in_doc)).otherwise(0))
    counts = pairs.groupBy(F.col(old).alias("a"), "b").agg(F.count("*").alias("n"))
    counts = counts.withColumn("span", F.floor(F.col("b") / SPAN))
    spans = counts.groupBy("a", "span").agg(F.sum("n").alias("n"))
    spans = spans.select("a", "span", before(Window.partitionBy("a").orderBy("span"), "n").alias("first"))
    inside = before(Window.partitionBy("a", "span").orderBy("b"), "n")
    ranked = counts.withColumn("inside", inside).join(spans, ["a", "span"])
    ranked = ranked.select("a", F.col("b").alias("b2"), (F.col("a") + F.col("first") + F.col("inside")).alias(new))
    joined = pairs.join(ranked, (F.col(old) == F.col("a")) & (F.col("b") == F.col("b2")))
    return written(joined.drop("a", "b", "b2"), f"line-ranks-{level + 1}")


def shortest_runs(positions: DataFrame, least_words: int) -> DataFrame:
    """Runs (document, id, start, size) of repeated lines that have enough words and none to spare.

    From each line on, as few lines as reach the number of words, and up to each
    line as few as reach it. With the words before a line as its place, the
    lines in reach are those whose place is in a frame of fixed width.
    """
    in_doc = Window.partitionBy(*DOC).orderBy("seq")
    runs = positions.withColumn("run", F.col("seq") - F.row_number().over(in_doc))
    in_run = Window.partitionBy(*DOC, "run")
    upto = F.sum("words").over(in_run.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    placed = runs.withColumn("upto", upto).withColumn("place", F.col("upto") - F.col("words"))
    counted = placed.select(
        *DOC,
        "id",
        "seq",
        "upto",
        (F.sum("words").over(in_run) - F.col("place")).alias("rest"),
        F.count("*").over(in_run.orderBy("place").rangeBetween(0, least_words - 1)).alias("on"),
        F.count("*").over(in_run.orderBy("upto").rangeBetween(1 - least_words, 0)).alias("back"),
    )
    forward = F.when(F.col("rest") >= least_words, F.struct(F.col("seq").alias("start"), F.col("on").alias("size")))
    backward = F.when(
        F.col("upto") >= least_words,
        F.struct((F.col("seq") - F.col("back") + 1).cast("int").alias("start"), F.col("back").alias("size")),
    )
    both = F.array_distinct(F.array_compact(F.array(forward, backward)))
    return counted.select(*DOC, "id", F.explode(both).alias("w")).select(*DOC, "id", "w.start", "w.size")


def later_copies(documents: DataFrame, doc_id: str, text: str, least_words: int) -> DataFrame:
    """Line numbers to delete: the document's key, `removed` (ascending array)."""
    lines = written(numbered_lines(packed(documents, [doc_id, text]), doc_id, text), "lines")
    positions = repeated_positions(lines)
    levels = max(least_words, 1).bit_length()
    ranks = positions
    for level in range(levels - 1):
        ranks = doubled(ranks, level)
    names = [f"r{level}" for level in range(levels)]
    rank = ranks.select(*DOC, F.col("seq").alias("at"), F.array(*names).alias("ranks"))
    # The largest power of two not above the size; the two parts overlap unless it is the size.
    level = F.length(F.bin("size")) - 1
    runs = shortest_runs(positions, least_words).withColumn("level", level.cast("int"))
    runs = runs.withColumn("tail", (F.col("start") + F.col("size") - F.expr("shiftleft(1, level)")).cast("int"))
    for place, name in (("start", "a"), ("tail", "b")):
        runs = runs.join(rank.withColumnRenamed("at", place), [*DOC, place]).withColumn(name, F.get("ranks", "level")).drop("ranks")
    interval = ["size", "a", "b"]
    where = F.struct(F.col("id").isNull(), "id", *DOC, "start").alias("where")
    runs = written(runs.select(*interval, where, *DOC, "start"), "line-runs")
    first = runs.groupBy(*interval).agg(F.min("where").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    same = (F.col("_k1") == F.col("first._k1")) & (F.col("_k2") == F.col("first._k2"))
    overlaps = same & (F.col("start") < F.col("first.start") + F.col("size"))
    later = runs.join(first, interval).where((F.col("where") > F.col("first")) & ~overlaps)
    deleted = later.select(*DOC, F.explode(F.sequence("start", (F.col("start") + F.col("size") - 1).cast("int"))).alias("seq"))
    return (
        positions.select(*DOC, "seq", "pos")
        .join(deleted.distinct(), [*DOC, "seq"])
        .groupBy(*DOC)
        .agg(F.sort_array(F.collect_list("pos")).alias("removed"))
    )


def without(text: Column, removed: Column) -> Column:
    """A text without the lines of the given numbers.

    Numbers to remove and numbered lines are sorted together, so that a line to
    remove stands right behind its number; no list is searched for each line.
    """
    lines = F.transform(
        F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.lit(1).alias("is_line"), x.alias("line"))
    )
    marks = F.transform(
        removed, lambda i: F.struct(i.alias("pos"), F.lit(0).alias("is_line"), F.lit(None).cast("string").alias("line"))
    )
    both = F.sort_array(F.concat(lines, marks))
    ahead = F.concat(F.array(F.lit(-1)), F.transform(both, lambda x: F.when(x["is_line"] == 0, x["pos"]).otherwise(-1)))
    kept = F.zip_with(both, F.slice(ahead, F.lit(1), F.size(both)), lambda x, p: F.when((x["is_line"] == 1) & (x["pos"] != p), x["line"]))
    return F.array_join(F.filter(kept, lambda x: x.isNotNull()), "\n")


def dedup_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with later copies of line runs deleted: struct `_row` (as before), `text`, `removed`."""
    found = later_copies(documents, doc_id, text, least_words)
    joined = packed(documents, [doc_id, text]).join(found, DOC, "left")
    old = F.col(f"_row.`{text}`")
    return joined.select(
        "_row", F.when(F.col("removed").isNull(), old).otherwise(without(old, F.col("removed"))).alias("text"), "removed"
    )


def replaced(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with their own columns, the text shortened, and its length with it where there is such a column."""
    new = dedup_lines(documents, doc_id, text, least_words)
    columns = {
        text: F.col("text"),
        n_chars: F.when(F.col("removed").isNull(), F.col(f"_row.`{n_chars}`")).otherwise(F.length("text"))
        if n_chars in documents.columns
        else None,
    }
    return new.select(
        *[
            (columns[c].cast(documents.schema[c].dataType).alias(c) if c in columns else F.col(f"_row.`{c}`"))
            for c in documents.columns
        ]
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        F.col("_row.doc_id").alias("doc_id"),
        "text",
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")), 256).alias("removed_sha256"),
    )


OP6_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents
), every AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM every WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), placed AS (
  SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS upto, upto - words AS place,
    CAST(sum(words) OVER (PARTITION BY doc_id) AS BIGINT) - place AS rest
  FROM numbered
), counted AS (
  SELECT *,
    count(*) OVER (PARTITION BY doc_id ORDER BY place RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS onward,
    count(*) OVER (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) AS back
  FROM placed
), runs AS (
  SELECT doc_id, seq AS first, onward AS size FROM counted WHERE rest >= 50
  UNION SELECT doc_id, seq - back + 1, back FROM counted WHERE upto >= 50
), lists AS (
  SELECT doc_id, list(line ORDER BY seq) AS all_lines FROM numbered GROUP BY doc_id
), named AS (
  SELECT doc_id, first, size, array_to_string(all_lines[first : first + size - 1], chr(10)) AS content
  FROM runs JOIN lists USING (doc_id)
), copies AS (
  SELECT *, row_number() OVER by_place AS nth, first_value(doc_id) OVER by_place AS doc0, first_value(first) OVER by_place AS first0
  FROM named WINDOW by_place AS (PARTITION BY content ORDER BY doc_id, first)
), later AS (
  SELECT doc_id, first, size FROM copies WHERE nth > 1 AND NOT (doc_id = doc0 AND first < first0 + size)
), gone AS (
  SELECT DISTINCT doc_id, seq FROM (SELECT doc_id, unnest(range(first, first + size)) AS seq FROM later)
), removed AS (
  SELECT doc_id, list(pos ORDER BY pos) AS removed FROM gone JOIN numbered USING (doc_id, seq) GROUP BY doc_id
), kept AS (
  SELECT e.doc_id, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM every e JOIN removed r USING (doc_id) WHERE NOT list_contains(r.removed, e.pos) GROUP BY e.doc_id
)
SELECT d.doc_id, CASE WHEN r.removed IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
  CAST(coalesce(len(r.removed), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(r.removed, ','), '')) AS removed_sha256
FROM documents d LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
