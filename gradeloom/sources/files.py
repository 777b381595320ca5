"""Files as Spark's own file systems see them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str, *below: str):
    """The file system of a path, and the path below it, as JVM objects."""
    place = spark._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *below]))
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str, *below: str) -> bool:
    files, place = located(spark, path, *below)
    return files.exists(place)


def names(spark: SparkSession, path: str, *below: str) -> dict[str, int]:
    """Names in a folder with the time each was changed, in milliseconds; none where there is no folder."""
    files, place = located(spark, path, *below)
    if not files.exists(place):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in files.listStatus(place)}


def delete(spark: SparkSession, path: str, *below: str) -> None:
    files, place = located(spark, path, *below)
    files.delete(place, True)


def create(spark: SparkSession, text: str, path: str, *below: str) -> bool:
    """Writes a small file that must not be there yet; False if it is."""
    files, place = located(spark, path, *below)
    try:
        out = files.create(place, False)
    except Exception:
        if files.exists(place):
            return False
        raise
    try:
        out.write(text.encode())
    finally:
        out.close()
    return True
