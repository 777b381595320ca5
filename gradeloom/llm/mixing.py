"""Mixing sources to target weights by systematic sampling, in Spark expressions only.

Every source gets a target: a share of the wanted words by weight, at most
`most` times what it has; what that leaves over goes to the others by weight.
A document's expected copies are its source's target over its source's words.
Documents of a source are put in the order of size, their expected copies are
summed up, a random offset is added, and a document is taken once for each
whole number that the sum passes at it. As the order is by size, the words
taken miss the target by no more than twice the largest document.

Null text has no words; such documents are in the mix like others but add
nothing. Null sources are one source, the last. The offset comes from the seed
and the source's name, and ties in size are ordered by a hash of the id, the id
and the text, so reruns agree and repeated rows share their copies alike. An
empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import WORD, keyed, packed, table, written


@dataclass(frozen=True)
class Mix:
    #: Weights of the sources in their order, repeating.
    weights: tuple[int, ...] = (3, 1, 2)
    #: Wanted words per hundred words there are.
    percent: int = 150
    #: Times a source's words that its target reaches at most.
    most: int = 2
    seed: str = "mix"
    #: Rows of a source and size that are put in order in one task, about.
    at_once: int = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """Sources (source, source_size, target, rate, offset) from documents (source, size).

    After the counting there is one row per source, and only those rows are
    ordered as a whole: by name for the weights, and by the ratio of limit and
    weight to find which sources stop at their limit.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w) for w in mix.weights])
    weighed = sources.select(
        "source",
        "source_size",
        F.get(weights, F.pmod(place, F.lit(len(mix.weights)))).cast("long").alias("weight"),
    ).withColumn("most", F.col("source_size") * mix.most)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # Price: words per weight if exactly the sources before stop at their limit.
    wanted = F.sum("source_size").over(every) * mix.percent / 100
    left = wanted - F.coalesce(F.sum("most").over(before), F.lit(0))
    price = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    priced = weighed.withColumn("price", price)
    fits = F.when(F.col("most") >= F.col("weight") * F.col("price"), F.col("price"))
    # Where a source more stops than has to, the price is lower, so the largest one counts.
    final = priced.withColumn("price", F.max(fits).over(every))
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.coalesce("price", F.lit(float("inf"))))
    name = F.concat(F.lit(mix.seed), F.coalesce(F.concat(F.lit("/"), "source"), F.lit("")))
    return final.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
        (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / 2.0**32).alias("offset"),
    )


def before_in(window: Window, count: str) -> Column:
    return F.coalesce(F.sum(count).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def sampled(documents: DataFrame, mix: Mix) -> DataFrame:
    """Adds source_size, target and copies to rows (id, source, size, tie, ...).

    A row's place in its source is the sum of three counts: rows of smaller
    size, rows of its size whose hash begins with smaller digits, and its place
    among the rows that share those digits. Each is counted over groups of
    bounded size; the number of digits follows from the number of rows.
    """
    rows = documents.count()
    digits = 0
    while rows > mix.at_once * 16**digits:
        digits += 1
    hashed = documents.withColumn("hash", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    hashed = hashed.withColumn("part", F.substring("hash", 1, digits))
    group = ["source", "size"]
    parts = hashed.groupBy(*group, "part").agg(F.count("*").alias("n"))
    in_size = parts.withColumn("before_part", before_in(Window.partitionBy(*group).orderBy("part"), "n"))
    per_size = parts.groupBy(*group).agg(F.sum("n").alias("n"))
    in_source = per_size.withColumn("before_size", before_in(Window.partitionBy("source").orderBy("size"), "n"))
    offsets = in_size.select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), "before_part"
    ).join(
        in_source.select(F.col("source").alias("s2"), F.col("size").alias("z2"), "before_size"),
        F.col("s").eqNullSafe(F.col("s2")) & (F.col("z") == F.col("z2")),
    )
    rates = targets(documents, mix).withColumnRenamed("source", "s3")
    offsets = offsets.join(rates, F.col("s").eqNullSafe(F.col("s3"))).drop("s2", "z2", "s3")
    inside = Window.partitionBy(*group, "part").orderBy("hash", F.col("id").asc_nulls_first(), "tie")
    ranked = hashed.withColumn("inside", F.row_number().over(inside))
    placed = ranked.join(
        offsets,
        F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p")),
    ).drop("s", "z", "p")
    place = F.col("before_size") + F.col("before_part") + F.col("inside")
    passed = F.floor(F.col("offset") + place * F.col("rate")) - F.floor(F.col("offset") + (place - 1) * F.col("rate"))
    return placed.withColumn("copies", passed).drop("before_size", "before_part", "inside", "part", "hash", "rate", "offset")


def mix_sources(
    documents: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """The mix: each document as many times as it is taken, with its columns and `copy` from 1.

    A column `copy` that the documents have is replaced.
    """
    keys = packed_by_all(documents)
    rows = written(sizes_of(documents, doc_id, source, text, keys), "mix-sizes")
    taken = sampled(rows, mix).where(F.col("copies") > 0).groupBy("_k1", "_k2").agg(F.sum("copies").alias("_c"))
    # Rows that agree in all columns are told apart by no order, so they come
    # once per group and are repeated by the sum of the group's copies.
    held = keys.dropDuplicates(["_k1", "_k2"])
    chosen = held.join(taken, ["_k1", "_k2"]).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_c")).alias("_copy"))
    return chosen.select("_row.*", "_copy").drop("copy").withColumnRenamed("_copy", "copy")


def packed_by_all(documents: DataFrame) -> DataFrame:
    """`packed` with keys of all columns, whatever they are called."""
    names = [f"`{c}`" for c in documents.columns]
    row = F.struct(*[F.col(c) for c in names]).alias("_row")
    rows = documents.select(row, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)])
    return keyed(rows, [f"_c{i}" for i in range(len(names))]).select("_row", "_k1", "_k2")


def sizes_of(documents: DataFrame, doc_id: str, source: str, text: str, keys: DataFrame | None = None) -> DataFrame:
    """(id, source, size, tie) and the row key of each document, or the key that `keys` gives it."""
    keys = packed(documents, [doc_id, source, text]) if keys is None else keys
    return keys.select(
        F.col(f"_row.`{doc_id}`").alias("id"),
        F.col(f"_row.`{source}`").cast("string").alias("source"),
        n_words(F.col(f"_row.`{text}`")).alias("size"),
        F.col("_k1").alias("tie"),
        "_k1",
        "_k2",
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rows = written(sizes_of(documents, "doc_id", "source", "text"), "mix-sizes")
    return sampled(rows, Mix()).select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )


OP9_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight
  FROM docs GROUP BY source
), priced AS (
  SELECT *, 2 * source_size AS most,
    (CAST(sum(source_size) OVER () * 150 AS DOUBLE) / 100 - coalesce(sum(2 * source_size) OVER before, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS price
  FROM sources
  WINDOW before AS (ORDER BY 2 * source_size / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
    least(CAST(most AS DOUBLE), weight * max(price) FILTER (most >= weight * price) OVER ()) AS target,
    CAST('0x' || substr(md5('mix' || coalesce('/' || source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM priced
), placed AS (
  SELECT doc_id, size, source_size, target, u,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY docs.source ORDER BY size, md5(doc_id::VARCHAR), doc_id) AS place
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
), passed AS (
  SELECT *, CAST(floor(u + place * rate) - floor(u + (place - 1) * rate) AS BIGINT) AS copies FROM placed
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM passed
"""
