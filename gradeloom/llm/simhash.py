"""Near-duplicates by SimHash fingerprints and BK-trees.

Fingerprints link if they differ in at most two bits. Among the distinct
fingerprints, links are found in BK-trees: a node's children are keyed by their
Hamming distance to it, and a search with radius r at distance d follows only
the children keyed d - r to d + r.

One tree over a corpus grows with it, and so would a broadcast of it. So trees
are sharded such that no link crosses shards: cut the 64 bits in three parts,
and two fingerprints that differ in at most two bits agree in one part. Each
part and value of it is a shard; its fingerprints, each at once node and query,
go to the task that builds and searches the tree, and a search needs just three
shards. A shard of more than `NODES` fingerprints is cut further, its free bits
in three parts again; after three cuts 20 bits are free at the most, which
bounds a tree by itself. Nothing is dropped or capped.

From each shard come only the links that join its groups to fewer (a spanning
forest), so a dense group of n fingerprints gives n - 1 links and not n * n / 2.

Null or empty texts have fingerprint zero and link like any other. Null ids
don't count as smallest while there are others. Rows that agree in id and text
are alike. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import keyed, mapped, packed, table, texts, union_all, unpacked, written
from gradeloom.llm.components import components

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Fingerprints of a shard above which it is cut.
NODES = 4096
#: Shingles whose bits are counted at a time.
AT_ONCE = 1 << 16


def fingerprint(text: str) -> int:
    """SimHash over 3-word shingles, as a signed number of 64 bits."""
    import xxhash

    words = text.encode().lower().split()  # bytes: lowers A-Z and splits at the six bytes only
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        hashes = [digest(line[s:e], SEED) for s, e in zip(starts[at : at + AT_ONCE], stops[at : at + AT_ONCE], strict=False)]
        counts += bit_counts(np.array(hashes, "<u8"))
    bits = 2 * counts > n
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (..., text) with the text replaced by its fingerprint."""
    for batch in batches:
        found = pa.array([fingerprint(t) for t in texts(batch)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], "fp"])


class Tree:
    """BK-tree: nodes are [value, {distance: child}]."""

    def __init__(self, value: int):
        self.root: list = [value, {}]

    def near(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root]
        while todo:
            node, children = todo.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                found.append(node)
            if len(children) <= 2 * radius + 1:
                todo.extend(child for key, child in children.items() if d - radius <= key <= d + radius)
            else:
                todo.extend(children[key] for key in range(d - radius, d + radius + 1) if key in children)
        return found

    def add(self, value: int) -> None:
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = [value, {}]
                return
            node = child


def forest(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links between distinct values of a shard that suffice to connect what is linked."""
    tree, parent = Tree(values[0]), {v: v for v in values}

    def top(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for value in values[1:]:
        for near in tree.near(value, radius):
            a, b = top(near), top(value)
            if a != b:
                parent[b] = a
                yield near, value
        tree.add(value)


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, part, fp) in the order of shards to links (a, b); holds one shard at a time."""
    mask64 = (1 << 64) - 1
    kept = np.zeros((0, 3), np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        found: list[tuple[int, int]] = []
        edges = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [len(rows)]])
        for i in np.flatnonzero(stops - starts > 1):
            values = [v & mask64 for v in rows[starts[i] : stops[i], 2].tolist()]
            found.extend(forest(values, RADIUS))
        a, b = (np.array([x[i] for x in found], np.uint64).view(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        rows = np.concatenate([kept, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)])
        last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield links(rows[:cut])
        kept = rows[cut:]
    if len(kept):
        yield links(kept)


def thirds(mask: int) -> list[int]:
    """The mask with a third more of the bits that it leaves free, for each third."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [0, len(free) // 3, 2 * len(free) // 3, len(free)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shards(fingerprints: DataFrame, nodes: int = NODES) -> DataFrame:
    """Distinct fingerprints (fp) as rows (mask, part, fp), each in three shards or more."""
    masks, rest, done = [0], fingerprints.withColumn("mask", F.lit(0).cast("long")), []
    for cut in range(3):
        into = F.map_from_entries(
            F.array(*[F.struct(F.lit(signed(m)), F.array(*[F.lit(signed(x)) for x in thirds(m)])) for m in masks])
        )
        masks = [x for m in masks for x in thirds(m)]
        dealt = rest.select("fp", F.explode(into[F.col("mask")]).alias("mask"))
        dealt = dealt.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        if cut == 2:
            done.append(dealt)
            break
        large = written(dealt.groupBy("mask", "part").count().where(F.col("count") > nodes).drop("count"), "large-shards")
        if large.isEmpty():
            done.append(dealt)
            break
        done.append(dealt.join(large, ["mask", "part"], "left_anti"))
        rest = dealt.join(large, ["mask", "part"], "left_semi").select("fp", "mask")
    return union_all([d.select("mask", "part", "fp") for d in done])


def linked(fingerprints: DataFrame, nodes: int = NODES) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp) within the radius."""
    dealt = shards(fingerprints, nodes).repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
    return mapped(dealt, search, "a long, b long")


def grouped(rows: DataFrame, nodes: int = NODES) -> DataFrame:
    """Adds `first` to rows (id, fp, _k1, _k2): the least row (no_id, id, _k1, _k2) of its group."""
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "_k1", "_k2")
    distinct = written(rows.groupBy("fp").agg(F.min(place).alias("least")), "fingerprints")
    roots = components(linked(distinct.select("fp"), nodes)).withColumnsRenamed({"a": "fp", "b": "root"})
    with_root = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = with_root.groupBy("root").agg(F.min("least").alias("first"))
    return rows.join(with_root.join(least, "root").select("fp", "first"), "fp")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", nodes: int = NODES) -> DataFrame:
    """Documents as (id, fp, _k1, _k2, first); `first.id` is the smallest id of the group."""
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = keyed(rows, ["id", "text"]).select("id", "_k1", "_k2", "text")
    found = written(mapped(rows, fingerprinted, "id long, _k1 long, _k2 long, fp long"), "simhash")
    return grouped(found, nodes)


def one_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, each group of near-duplicates reduced to its row with the smallest id; repeated rows to one."""
    keep = near_duplicates(documents, doc_id, text).select("first._k1", "first._k2").distinct()
    # The key hashes the id as text, as `keyed` does for any type of id.
    rows = packed(documents.withColumn(doc_id, F.col(doc_id).cast("long")), [doc_id, text])
    return unpacked(rows.join(keep, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"),
    )
