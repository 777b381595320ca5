"""Filling the matrix: recorded replies, or calls through a pluggable client."""

from __future__ import annotations

import datetime as dt
import json
import math
import time
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom import fixed
from gradeloom.session import scratch_path
from gradeloom.sources import files

KEYS = ["model", "provider", "item_id"]

# One call: (request body, row of key columns) -> reply, as a dict or JSON text.
Client = Callable[[dict, dict], object]


class RateLimited(Exception):
    """The provider answered 429; `retry_after` is that header's value, if any."""

    def __init__(self, message: str = "rate limited (429)", retry_after: str | float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


class TransportError(Exception):
    """The request never got an answer: dropped connection, time-out."""


def retry_wait(retry_after, attempt: int, max_backoff: float, now: dt.datetime | None = None) -> float:
    """Seconds to wait: the header in seconds or date form (HTTP or ISO), else 2^attempt up to a cap."""
    text = "" if retry_after is None else str(retry_after).strip()
    try:
        seconds = float(text)
        if math.isfinite(seconds):
            return max(0.0, seconds)
        text = ""
    except ValueError:
        pass
    for read in (parsedate_to_datetime, dt.datetime.fromisoformat):
        try:
            until = read(text)
        except (TypeError, ValueError):
            continue
        if until.tzinfo is None:
            until = until.replace(tzinfo=dt.timezone.utc)
        return max(0.0, (until - (now or dt.datetime.now(dt.timezone.utc))).total_seconds())
    return min(max_backoff, 2.0**attempt)


def provider_limits() -> dict:
    """The usual limits of the known providers, as options of `infer`."""
    return {
        "min_interval_ms": dict(fixed.MIN_INTERVAL_MS),
        "max_retries": dict(fixed.MAX_RETRIES),
        "max_backoff_s": dict(fixed.MAX_BACKOFF_SECONDS_OF),
    }


def _of(setting, provider: str, default):
    """A setting for all providers, or a dict of it by provider."""
    return setting.get(provider, default) if isinstance(setting, dict) else setting


def _caller(client_factory, lanes: int, min_interval_ms, max_retries, max_backoff):
    """Per-task function that sends one request under the interval and retry rules."""
    client = client_factory()
    last_start: dict[str, float] = {}

    def send(body: dict, row: dict):
        provider = row["provider"]
        interval = _of(min_interval_ms, provider, 0) * lanes / 1000.0
        attempt = 0
        while True:
            wait = last_start.get(provider, float("-inf")) + interval - time.monotonic()
            if wait > 0:
                time.sleep(wait)
            last_start[provider] = time.monotonic()
            try:
                return client(body, row), attempt + 1
            except (RateLimited, TransportError, ConnectionError, TimeoutError) as err:
                if attempt >= _of(max_retries, provider, 0):
                    err.attempts = attempt + 1
                    raise
                longest = _of(max_backoff, provider, fixed.MAX_BACKOFF_SECONDS)
                time.sleep(retry_wait(getattr(err, "retry_after", None), attempt, longest))
                attempt += 1

    return send


def infer(
    requests: DataFrame,
    client_factory: Callable[[], Client],
    max_concurrency: int = 8,
    min_interval_ms: int | dict[str, int] = 0,
    max_retries: int | dict[str, int] = 5,
    max_backoff_s: float | dict[str, float] = fixed.MAX_BACKOFF_SECONDS,
) -> DataFrame:
    """One reply per request row; adds raw, error, started_ms, elapsed_ms, attempts.

    Rows are dealt to `max_concurrency` lanes by key hash, one task per lane, so
    a provider with most of the rows still uses every lane. Each lane waits the
    interval times the number of lanes, which keeps the total rate of a provider
    under its limit. The limits hold for every provider, or by provider where
    they are dicts. A failing call becomes an error row, never an exception.
    Only 429 and transport errors are retried. Rows without a request, and rows
    that carry an error already, pass through without a call.
    """
    added = [
        T.StructField("raw", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("started_ms", T.LongType()),
        T.StructField("elapsed_ms", T.LongType()),
        T.StructField("attempts", T.IntegerType()),
    ]
    kept = [f for f in requests.schema.fields if f.name not in {a.name for a in added}]
    schema = T.StructType([*kept, *added])
    names = [f.name for f in kept]
    known_error = F.col("error") if "error" in requests.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = _caller(client_factory, max_concurrency, min_interval_ms, max_retries, max_backoff_s)
        for batch in batches:
            made: dict[str, list] = {a.name: [] for a in added}
            for row in batch.select(["request", "_error", *KEYS]).to_pylist():
                raw, error, begun, elapsed, tries = None, row.pop("_error"), None, None, 0
                # Nothing to ask: e.g. a row to judge that has no answer, or an item that is no item.
                if row["request"] is not None and error is None:
                    begun, started, tries = int(time.time() * 1000), time.monotonic(), 1
                    try:
                        reply, tries = send(json.loads(row["request"]), row)
                        raw = reply if isinstance(reply, str) else json.dumps(reply, ensure_ascii=False)
                    except Exception as err:  # noqa: BLE001 - any failure belongs to this row alone
                        error = str(err) or type(err).__name__
                        tries = getattr(err, "attempts", 1)
                    elapsed = int((time.monotonic() - started) * 1000)
                for name, value in zip(made, (raw, error, begun, elapsed, tries), strict=True):
                    made[name].append(value)
            # Input columns pass through as they are; only the keys and the body were decoded.
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            columns = [pa.array(values, kind) for values, kind in zip(made.values(), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], names=[*names, *made])

    lane = F.pmod(F.xxhash64(*KEYS), F.lit(max_concurrency)).cast("int")
    asked = requests.select(*names, known_error.alias("_error"))
    return asked.repartitionById(max_concurrency, lane).mapInArrow(run, schema)


def resume_keys(df: DataFrame) -> list[str]:
    """What a call is known by: the pair, and the session where there is one."""
    return [*(["session_id"] if "session_id" in df.columns else []), *KEYS]


def infer_to(
    requests: DataFrame,
    path: str,
    client_factory: Callable[[], Client],
    calls_per_commit: int = 10_000,
    max_concurrency: int = 8,
    **options,
) -> DataFrame:
    """`infer` into a table, leaving out the calls that it holds a reply to.

    Replies are written before anything reads them, so a later failure never
    repeats a paid call, and about `calls_per_commit` of them are committed at a
    time. Failed calls are asked again. Returns the latest row of each asked
    call, replies before failures.

    The requests are evaluated once, when they are dealt: each lane's calls go
    to files by their place in the lane, and every commit reads the files of its
    own places alone, however many commits there are. These files, which hold
    the request bodies, are removed with the commit; replies are stored without
    bodies. A run that was cut off goes on behind the last commit when it is
    called again.
    """
    spark = requests.sparkSession
    if spark.conf.get("spark.speculation", "false") == "true":
        raise ValueError("spark.speculation would send requests twice; turn it off")
    keys = resume_keys(requests)
    dealt = _dealt(requests, path, keys, max_concurrency, max(1, calls_per_commit // max_concurrency))
    asked = scratch_path(spark, "asked")
    spark.read.parquet(dealt).select(*keys).distinct().write.parquet(asked)
    for name in sorted(files.names(spark, dealt), key=_place):
        if _place(name) >= 0:
            share = spark.read.schema(requests.schema).parquet(f"{dealt}/{name}")
            replies = infer(share, client_factory, max_concurrency, **options).drop("request")
            replies.write.mode("append").parquet(path)
            files.delete(spark, dealt, name)
    stored = spark.read.parquet(path).join(spark.read.parquet(asked), keys, "left_semi")
    payload = [c for c in stored.columns if c not in keys]
    latest = F.max_by(F.struct(*payload), F.struct(F.col("raw").isNotNull(), F.coalesce("started_ms", F.lit(0))))
    return stored.groupBy(*keys).agg(latest.alias("_latest")).select(*keys, "_latest.*")


#: Rows that need no call are dealt to this place.
ANSWERED = -1


def _place(name: str) -> int:
    """The place that a folder of dealt requests holds; other names come before all."""
    return int(name.removeprefix("_place=")) if name.startswith("_place=") else ANSWERED


def _dealt(requests: DataFrame, path: str, keys: list[str], lanes: int, at_once: int) -> str:
    """Writes the requests by their place in their lane, `at_once` to a place, and returns where.

    Lanes are those of `infer`. Those with a reply are kept apart, for their keys.
    """
    spark = requests.sparkSession
    rows = requests.withColumn("_done", F.lit(False))
    if files.exists(spark, path, "_SUCCESS"):
        done = spark.read.parquet(path).where(F.col("raw").isNotNull() | (F.col("attempts") == 0))
        rows = requests.join(done.select(*keys, F.lit(True).alias("_done")).distinct(), keys, "left")
        rows = rows.withColumn("_done", F.coalesce("_done", F.lit(False)))
    lane = F.pmod(F.xxhash64(*KEYS), F.lit(lanes)).cast("int")
    in_lane = rows.repartitionById(lanes, lane).sortWithinPartitions("_done")
    # Calls to make come first in a lane, so that their places have no gaps.
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    place = F.when(F.col("_done"), ANSWERED).otherwise(F.floor(nth / at_once).cast("int"))
    dealt = scratch_path(spark, "dealt")
    in_lane.withColumn("_place", place).drop("_done").write.partitionBy("_place").parquet(dealt)
    return dealt


def replay_responses(matrix: DataFrame, recorded: DataFrame, unique: bool = False) -> DataFrame:
    """Replies from a recorded table instead of a live endpoint.

    The first recorded reply of a pair counts (smallest `recorded_at` where that
    column exists). `unique` says that there is one per pair, which saves the
    pass that folds them. Recordings of a session answer that session only. A
    pair without a reply becomes an error row; one with an error keeps it.
    """
    keys = resume_keys(recorded) if "session_id" in matrix.columns else KEYS
    payload = [c for c in recorded.columns if c not in {*keys, "session_id"}]
    if unique:
        one_each = recorded.select(*keys, F.struct(*payload).alias("_reply"), F.lit(True).alias("_found"))
    else:
        order = F.struct(*(["recorded_at"] if "recorded_at" in payload else []), F.xxhash64(*payload))
        one_each = recorded.groupBy(*keys).agg(
            F.min_by(F.struct(*payload), order).alias("_reply"), F.lit(True).alias("_found")
        )
    known_error = F.col("_reply.error") if "error" in payload else F.lit(None).cast("string")
    before = F.col("_before") if "error" in matrix.columns else F.lit(None).cast("string")
    given = [c for c in payload if c != "error"]
    return (
        matrix.withColumnRenamed("error", "_before").join(one_each, keys, "left")
        .withColumns({c: F.when(before.isNull(), F.col(f"_reply.{c}")) for c in given})
        .withColumn("error", F.coalesce(before, F.when(F.col("_found").isNull(), "no recorded response"), known_error))
        .drop("_reply", "_found", "_before")
    )
