"""Main text of web pages by wrappers inferred for each host.

A page is read as a stream of block elements and text slots. The streams of a
host are aligned one after the other into one union-free regular expression,
the host's wrapper: neighbours that agree fold into repeated groups, what only
some pages have becomes optional, and texts become slots. All pages take part:
equal streams are dropped first, the rest meet in bounded shares of a host and
then share by share, and a worker holds one wrapper at a time.

The wrapper's slots, with the text that all pages of the host have in them, say
where the main text is: inside the article elements, or else in the element that
holds most of the text that isn't links. A page's text is that of its slots
that the wrapper marks. A page with no text there (a host may have pages of
several kinds) is treated as a host of its own.

Null and empty pages give an empty text. A null or odd URL has the host ''.
Rows are independent, so repeated ids stay. An empty table gives an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import mapped, table, texts, written
from gradeloom.llm.html_tree import Page, expression, merged, slot_paths

#: Streams of a host that are aligned in one task, about.
AT_ONCE = 1000
#: Share of a part's text that a part of it must hold to stand for it, and of links that makes a slot a menu.
MOST, LINKS = 0.7, 0.5


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (host, text) to (host, stream, slots)."""
    slot = pa.struct([("path", pa.string()), ("chars", pa.int64()), ("links", pa.int64())])
    for batch in batches:
        found, slots = [], []
        for source in texts(batch):
            page = Page(source)
            found.append(json.dumps(page.skeleton(), separators=(",", ":"), ensure_ascii=False))
            slots.append([{"path": p, "chars": c, "links": n} for p, (c, n) in weighed(page.slots).items()])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.string()), pa.array(slots, pa.list_(slot))], ["host", "stream", "slots"]
        )


def weighed(slots: list[tuple[str, str, int]]) -> dict[str, tuple[int, int]]:
    """Characters, and characters in links, by path."""
    sums: dict[str, tuple[int, int]] = {}
    for path, text, links in slots:
        c, n = sums.get(path, (0, 0))
        sums[path] = (c + len(text), n + links)
    return sums


def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, share, stream) in the order of host and share to one wrapper for each."""

    def row(at: tuple, wrapper: list) -> pa.RecordBatch:
        text = json.dumps(wrapper, separators=(",", ":"), ensure_ascii=False)
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]], pa.string()), pa.array([at[1]], pa.int64()), pa.array([text], pa.string())],
            ["host", "share", "stream"],
        )

    at, wrapper = None, None
    for batch in batches:
        for host, share, stream in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tree = json.loads(stream)
            if at == (host, share):
                wrapper = merged(wrapper, tree)
                continue
            if at is not None:
                yield row(at, wrapper)
            at, wrapper = (host, share), tree
    if at is not None:
        yield row(at, wrapper)


def content_paths(slots: dict[str, tuple[int, int]]) -> list[str]:
    """Which slots, given their characters and link characters, hold the main text."""
    usable = {p: (c, n) for p, (c, n) in slots.items() if "!" not in p}
    for mark in ("^", "~"):
        inside = [p for p in usable if mark in p]
        if any(usable[p][0] > 0 for p in inside):
            return sorted(inside)
    usable = {p: (c, n) for p, (c, n) in usable.items() if n <= LINKS * c}
    total: dict[str, int] = {}
    for path, (chars, _) in usable.items():
        parts = path.split(">")
        for i in range(1, len(parts) + 1):
            key = ">".join(parts[:i])
            total[key] = total.get(key, 0) + chars
    region = ""
    blocks = (">p", ">h1", ">h2", ">h3", ">h4", ">h5", ">h6", ">li", ">pre", ">blockquote", ">td", ">table", ">ul", ">ol")
    while True:
        below = [
            k for k in total
            if k.startswith(f"{region}>") and ">" not in k[len(region) + 1 :] and not k[len(region) :].startswith(blocks)
        ]
        best = max(below, key=lambda k: (total[k], k), default=None)
        if best is None or total[best] < MOST * total.get(region, total[best]):
            break
        region = best
    return sorted(p for p in usable if p == region or p.startswith(f"{region}>"))


def marking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, stream, slots) to (host, wrapper, content)."""
    for batch in batches:
        hosts, wrappers, marks = [], [], []
        for host, stream, slots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tree = json.loads(stream)
            sums = {s["path"]: (s["chars"], s["links"]) for s in slots or []}
            known = {p: sums.get(p, (0, 0)) for p in slot_paths(tree)} | sums
            hosts.append(host)
            wrappers.append(expression(tree))
            marks.append(content_paths(known))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(wrappers, pa.string()), pa.array(marks, pa.list_(pa.string()))],
            ["host", "wrapper", "content"],
        )


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row per host: host, wrapper (an expression over elements and text slots), content (paths of its main slots)."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("text"))
    found = written(
        mapped(rows, streams, "host string, stream string, slots array<struct<path:string,chars:long,links:long>>"),
        "page-streams",
    )
    distinct = written(found.select("host", "stream").distinct(), "distinct-streams")
    shares = 1 + distinct.count() // AT_ONCE
    dealt = distinct.withColumn("share", F.pmod(F.xxhash64("stream"), F.lit(shares))).select("host", "share", "stream")

    def gather(df: DataFrame) -> DataFrame:
        ordered = df.repartition("host", "share").sortWithinPartitions("host", "share", "stream")
        return mapped(ordered, align, "host string, share long, stream string")

    whole = gather(gather(dealt).withColumn("share", F.lit(0).cast("long")))
    slots = (
        found.select("host", F.explode("slots").alias("s"))
        .groupBy("host", "s.path").agg(F.sum("s.chars").alias("chars"), F.sum("s.links").alias("links"))
        .groupBy("host").agg(F.collect_list(F.struct("path", "chars", "links")).alias("slots"))
    )
    joined = whole.join(slots, "host", "left").select("host", "stream", "slots")
    return mapped(joined, marking, "host string, wrapper string, content array<string>")


def main_text(source: str, content: set[str]) -> str:
    """The text of a page's slots that are in the content, or else of those that the page alone suggests."""
    slots = Page(source).slots
    found = [t for p, t, _ in slots if p in content]
    if not found:
        own = set(content_paths(weighed(slots)))
        found = [t for p, t, _ in slots if p in own]
    return " ".join(found)


def extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (page_id, url, content, text) to (page_id, url, text, n_chars)."""
    for batch in batches:
        sets: dict[tuple, set] = {}
        out = []
        for paths, source in zip(batch.column(2).to_pylist(), texts(batch), strict=True):
            key = tuple(paths or ())
            out.append(main_text(source, sets.setdefault(key, set(key))))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as (page_id, url, text, n_chars)."""
    wrappers = written(infer_wrappers(pages, url, html), "wrappers")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        host_of(F.col(url)).alias("host"),
        F.col(html).cast("string").alias("text"),
    )
    # One row per host: Spark broadcasts them while they are small.
    joined = rows.join(wrappers.select("host", "content"), "host", "left").select("page_id", "url", "content", "text")
    return mapped(joined, extracting, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
