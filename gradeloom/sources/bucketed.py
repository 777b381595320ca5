"""Tables that lie in buckets of a key, so that joins and aggregations on it need no shuffle.

    path/part-...              rows, a file per bucket, sorted by the key
    path/_layout/layout.json   key, number of buckets and columns; written last

The layout stands beside the rows, as the catalog of a session may not outlive
it: `read` makes the table known to the session that reads. A key with very
many rows is one file, so tables should be folded to about a row per key before
they are written here.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from gradeloom.operators.spread import partitions
from gradeloom.sources import files

LAYOUT, FILE = "_layout", "layout.json"


def _name(path: str) -> str:
    """The table's name in the session's catalog, one per path."""
    return f"bucketed_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:32]}"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def write(rows: DataFrame, path: str, key: str, buckets: int | None = None) -> None:
    """Writes rows to a new path in buckets of the key, as many as the session has partitions by default.

    Tables that are to be joined need the same number. The rows are shuffled
    once here, to a task per bucket, so each bucket is one file.
    """
    spark, buckets = rows.sparkSession, buckets or partitions(rows)
    if files.exists(spark, path):
        raise ValueError(f"there is something at {path!r} already")
    placed = rows.repartition(buckets, _quoted(key))
    placed.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(_name(path))
    layout = {"key": key, "buckets": buckets, "columns": rows.schema.json()}
    files.create(spark, json.dumps(layout), path, LAYOUT, FILE)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table at the path, with its buckets; a write that did not end is not read."""
    if not files.exists(spark, path, LAYOUT, FILE):
        raise ValueError(f"no whole bucketed table at {path!r}")
    if not spark.catalog.tableExists(_name(path)):
        found = spark.read.schema("key string, buckets int, columns string").json(f"{path}/{LAYOUT}").first()
        _register(spark, path, found["key"], found["buckets"], found["columns"])
    return spark.table(_name(path))


def _register(spark: SparkSession, path: str, key: str, buckets: int, columns: str) -> None:
    schema = StructType.fromJson(json.loads(columns))
    fields = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_name(path)} ({fields}) USING parquet "
        f"CLUSTERED BY ({_quoted(key)}) SORTED BY ({_quoted(key)}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )

