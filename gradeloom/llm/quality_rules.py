"""Quality rules per document and per host.

A document fails by itself if it has too few words or repeats itself. All rule
failures are then counted by host. A host's failure rate is drawn towards what
all hosts show, by a beta prior fitted to the hosts' counts. A host is rejected,
with all its documents, if its rate is almost surely above the mean of the hosts
by a margin. Hosts that differ by no more than chance are all drawn to the mean.

Null text is a text without words. A null host is a host of its own. Rows with
the same id stay apart. An empty table gives an empty table. Texts of any length
are counted whole, inside one task each. Other columns of the documents, of any
name, don't come into the result; there are no ties to break.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import mapped, table, texts, written

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. The first two decide on a document; the others only count for its host."""

    least_words: int = 50
    most_repeat_percent: int = 50
    most_symbol_percent: int = 10
    most_dup_line_percent: int = 30
    #: A host is rejected if its drawn rate, less `sure` standard deviations of it, is above the mean by more than this.
    most_excess: float = 0.2
    sure: float = 3.0
    #: Documents that the prior is worth at least, so that single documents of small hosts decide nothing.
    least_prior: float = 1.0


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    often: set = set()
    for w in windows:
        (often if w in seen else seen).add(w)
    count, end = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            count += i + 3 - max(i, end)
            end = i + 3
    return count


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(lines) - len(set(lines))


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, host, text) to the counts of each text."""
    for batch in batches:
        columns: list[list[int]] = [[], [], [], [], [], []]
        for text in texts(batch):
            # Splitting bytes splits at exactly the six bytes that the word pattern leaves out.
            words = text.encode().split()
            counts = (
                len(words),
                len(b"".join(words).decode()),
                sum(map(text.count, SYMBOLS)),
                dup_lines(text),
                repeat_words(words),
                text.count("\n") + 1,
            )
            for column, value in zip(columns, counts, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)],
            ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"],
        )


def document_rules(documents: DataFrame, rules: Rules, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Counts of each document, `base_failed`, and `failed` (any rule)."""
    rows = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text")
    )
    counted = mapped(
        rows,
        measure,
        "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, n_lines long",
    )
    base = (F.col("n_words") < rules.least_words) | (
        100 * F.col("n_repeat_words") > rules.most_repeat_percent * F.col("n_words")
    )
    symbols = 100 * F.col("n_symbols") > rules.most_symbol_percent * F.col("word_chars")
    lines = 100 * F.col("n_dup_lines") > rules.most_dup_line_percent * F.col("n_lines")
    return counted.withColumn("base_failed", base).withColumn("failed", base | symbols | lines)


def host_verdicts(measured: DataFrame, rules: Rules) -> DataFrame:
    """One row per host: its documents, its failures, its drawn rate, and whether it is rejected.

    Hosts' failures are taken as beta-binomial. `rho`, the correlation of two
    documents of one host, follows from the squared deviations of the hosts'
    rates, weighted by documents, less what chance alone gives them; the prior
    is worth 1 / rho - 1 documents. The mean weighs each rate by its precision
    under that rho, so that a host of a third of all documents is not the mean.
    """
    counts = measured.groupBy("host").agg(
        F.count("*").alias("host_docs"), F.count_if("failed").alias("host_failed")
    )
    hosts = written(counts, "host-counts")
    n, x = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    sums = hosts.agg(
        F.sum(n).alias("n"), F.sum(x).alias("x"), F.sum(n * n).alias("nn"), F.sum(x * x / n).alias("xx"),
        (F.count("*") - 1).alias("free"),
    ).withColumn("p", F.col("x") / F.col("n"))
    chance = F.col("p") * (1 - F.col("p"))
    spread = F.col("xx") - F.col("x") * F.col("p")
    room = F.col("n") - F.col("nn") / F.col("n") - F.col("free")
    # Without room (single hosts, or hosts of one document each) nothing tells hosts from chance.
    estimate = F.when((chance > 0) & (room > 0), (spread / chance - F.col("free")) / room).otherwise(0.0)
    rho = sums.select(F.greatest(F.lit(0.0), F.least(estimate, F.lit(1 / (1 + rules.least_prior))))).scalar()
    known = hosts.withColumn("rho", rho)
    weight = n / (1 + F.col("rho") * (n - 1))
    mean = known.agg(F.sum(weight * x / n) / F.sum(weight)).scalar()
    pull = (1 - F.col("rho")) / (1 - F.col("rho") + F.col("rho") * n)
    rate = F.col("host_rate")
    deviation = F.sqrt(rate * (1 - rate) * F.col("rho") / (1 + F.col("rho") * n))
    return (
        known.withColumn("mean", mean)
        .withColumn("host_rate", F.col("mean") * pull + x / n * (1 - pull))
        .select(
            "host", "host_docs", "host_failed", "host_rate",
            (rate - rules.sure * deviation > F.col("mean") + rules.most_excess).alias("host_rejected"),
        )
    )


def quality_rules(documents: DataFrame, rules: Rules = Rules(), **columns: str) -> DataFrame:
    """Documents with their counts, their host's verdict and `kept`.

    The counts are written once to the shared folder and read for the hosts and
    for the documents, so that texts are read once.
    """
    measured = written(document_rules(documents, rules, **columns), "quality-counts")
    # A host may hold a third of the rows; its verdicts are few, so the join is
    # a broadcast while they are small, and else one whose large parts Spark splits.
    verdicts = host_verdicts(measured, rules).withColumnRenamed("host", "_host")
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "host_docs", "host_failed", "kept",
    )


OP5_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), positions AS (
  SELECT id, unnest(range(1, len(w) - 1)) AS p, w FROM words
), windows AS (
  SELECT id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS win FROM positions
), often AS (
  SELECT id, p FROM windows QUALIFY count(*) OVER (PARTITION BY id, win) > 1
), covered AS (
  SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([p, p + 1, p + 2]) AS p FROM often) GROUP BY id
), lines AS (
  SELECT id, count(*) - count(DISTINCT l) AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY id
), counted AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    len(string_split(text, chr(10))) AS n_lines
  FROM words LEFT JOIN covered USING (id) LEFT JOIN lines USING (id)
), ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS failed
  FROM counted
), hosts AS (
  SELECT source, count(*) AS host_docs, count(*) FILTER (failed) AS host_failed FROM ruled GROUP BY source
), sums AS (
  SELECT CAST(sum(host_docs) AS DOUBLE) AS n, sum(host_failed) / n AS p, count(*) - 1 AS free,
    n - sum(CAST(host_docs AS DOUBLE) * host_docs) / n - free AS room,
    sum(host_docs * (host_failed / host_docs - (SELECT sum(host_failed) / sum(host_docs) FROM hosts)) ** 2) AS spread
  FROM hosts
), fitted AS (
  SELECT CASE WHEN p * (1 - p) > 0 AND room > 0 THEN least(greatest((spread / (p * (1 - p)) - free) / room, 0), 0.5) ELSE 0 END AS rho
  FROM sums
), mean AS (
  SELECT sum(host_failed / (1 + rho * (host_docs - 1))) / sum(host_docs / (1 + rho * (host_docs - 1))) AS m FROM hosts, fitted
), posterior AS (
  SELECT *, CASE WHEN rho > 0 THEN (host_failed + m * (1 / rho - 1)) / (host_docs + 1 / rho - 1) ELSE m END AS rate,
    CASE WHEN rho > 0 THEN sqrt(rate * (1 - rate) / (host_docs + 1 / rho)) ELSE 0 END AS deviation
  FROM hosts, fitted, mean
), drawn AS (
  SELECT *, rate - 3 * deviation > m + 0.2 AS rejected FROM posterior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_docs, host_failed,
  NOT base_failed AND NOT rejected AS kept
FROM ruled JOIN drawn ON ruled.source IS NOT DISTINCT FROM drawn.source
"""
