"""Row keys, written tables and Python batches that the operators share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.session import scratch_path

#: Bytes that split words: space and the five control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back; cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds `_k1` and `_k2`: 128 bits from the given columns, never null.

    Rows that agree in these columns share the key, whether or not the id is
    unique, so every operator treats repeated rows alike.
    """
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    nulls = [F.col(c).isNull() for c in columns]
    return df.withColumns({"_k1": F.xxhash64(*cols, *nulls), "_k2": F.xxhash64(F.lit(1), *cols, *nulls)})


def packed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows as one struct column `_row`, beside `_k1` and `_k2`: extra columns of any name can't clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    return keyed(df.select(row, *[F.col(f"`{c}`") for c in columns]), columns).select("_row", "_k1", "_k2")


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def remainder(column: str, divisor: int) -> Column:
    """crc32 of an id written as text, modulo a divisor; a null id counts as remainder 1."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor, F.lit(1))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


class Blocks:
    """Sums of large integer arrays over all rows of a table.

    Every task adds up its rows in arrays of fixed size and emits them in blocks
    of `WIDTH` numbers, compressed. Blocks meet by number: a reducer reads them
    in order and holds one sum at a time, so its memory is bounded however many
    tasks there were.
    """

    WIDTH = 1 << 15
    SCHEMA = "array int, block int, data binary"

    @classmethod
    def emit(cls, arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for number, values in enumerate(arrays):
            flat = values.ravel()
            for block in range(0, len(flat), cls.WIDTH):
                part = flat[block : block + cls.WIDTH]
                if part.any():
                    yield cls.batch(number, block // cls.WIDTH, part)

    @staticmethod
    def batch(number: int, block: int, part: np.ndarray) -> pa.RecordBatch:
        # A byte plane after the other; those that are zero throughout are left out.
        used = 8 if part.min() < 0 else max(1, (int(part.max()).bit_length() + 7) // 8)
        planes = part.astype("<i8").view("u1").reshape(-1, 8)[:, :used]
        data = bytes([used]) + zlib.compress(planes.T.tobytes(), 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([block], pa.int32()), pa.array([data], pa.binary())],
            ["array", "block", "data"],
        )

    @staticmethod
    def numbers(data: bytes) -> np.ndarray:
        planes = np.frombuffer(zlib.decompress(data[1:]), "u1").reshape(data[0], -1)
        found = np.zeros((planes.shape[1], 8), "u1")
        found[:, : data[0]] = planes.T
        return found.view("<i8").ravel()

    @classmethod
    def summed(cls, emitted: DataFrame) -> DataFrame:
        """One row per (array, block)."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total = None, None
            for batch in batches:
                for number, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if at == (number, block):
                        total += cls.numbers(data)
                        continue
                    if at is not None:
                        yield cls.batch(*at, total)
                    at, total = (number, block), cls.numbers(data).copy()
            if at is not None:
                yield cls.batch(*at, total)

        ordered = emitted.repartition("array", "block").sortWithinPartitions("array", "block")
        return ordered.mapInArrow(add, cls.SCHEMA)

    @classmethod
    def gathered(cls, emitted: DataFrame, sizes: list[int]) -> list[np.ndarray]:
        """The sums as arrays of the given sizes on the driver; their total size is the bound."""
        arrays = [np.zeros(n, np.int64) for n in sizes]
        for row in cls.summed(emitted).toLocalIterator(prefetchPartitions=False):
            part = cls.numbers(row["data"])
            arrays[row["array"]][row["block"] * cls.WIDTH :][: len(part)] = part
        return arrays


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
