"""Verdicts that come late, sessions that end, progress, and folders of micro-batches."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gradeloom import scratch_path
from gradeloom.operators import summary
from gradeloom.sources import files
from gradeloom.streaming import live

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def land(spark, data, schema, path):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


REPLY = "observation_id string, replied_at timestamp"
VERDICT = "observation_id string, judged_at timestamp, score double"


def watch(spark, base):
    replies = spark.readStream.schema(REPLY).parquet(f"{base}/replies")
    verdicts = spark.readStream.schema(VERDICT).parquet(f"{base}/verdicts")
    query = live.stream_verdicts(replies, verdicts, f"{base}/out", f"{base}/state")
    query.awaitTermination()
    return query


def test_verdicts_meet_replies_in_any_order(spark):
    base = scratch_path(spark, "verdicts")
    # b's verdict is read before its reply; c gets none; d's comes after its time.
    land(spark, [("a", at(0)), ("c", at(1)), ("d", at(2))], REPLY, f"{base}/replies")
    land(spark, [("b", at(4), 2.0), ("a", at(3), 1.0)], VERDICT, f"{base}/verdicts")
    watch(spark, base)
    assert {r["observation_id"]: (r["score"], r["kind"]) for r in rows(live.read_verdicts(spark, f"{base}/out"))} == {"a": (1.0, "verdict")}
    land(spark, [("b", at(3)), ("x", at(200))], REPLY, f"{base}/replies")
    land(spark, [("y", at(195), 5.0), ("d", at(190), None)], VERDICT, f"{base}/verdicts")
    watch(spark, base)
    found = {r["observation_id"]: (r["score"], r["kind"]) for r in rows(live.read_verdicts(spark, f"{base}/out"))}
    assert found == {"a": (1.0, "verdict"), "b": (2.0, "verdict"), "c": (None, "expired"), "d": (None, "expired")}
    land(spark, [("z", at(400))], REPLY, f"{base}/replies")
    land(spark, [("d", at(400), 4.0), ("d", at(396), 3.0), (None, at(399), 1.0)], VERDICT, f"{base}/verdicts")
    watch(spark, base)
    found = {r["observation_id"]: (r["score"], r["kind"]) for r in rows(live.read_verdicts(spark, f"{base}/out"))}
    # The unscored verdict of d came late: it is a correction, and so is y, which has no reply at all.
    assert found["d"] == (None, "correction") and found["y"] == (5.0, "correction") and found["x"] == (None, "expired")
    # Folded at any batch, the rest reads the same.
    live.compact(spark, f"{base}/out", live.latest_verdict())
    live.vacuum(spark, f"{base}/out")
    assert {r["observation_id"]: (r["score"], r["kind"]) for r in rows(live.read_verdicts(spark, f"{base}/out"))} == found


RESULT = "session_id string, model string, ts timestamp, score double, error string"


def test_ended_sessions_leave_the_state(spark):
    base = scratch_path(spark, "closed")
    kept = []
    for part in range(5):
        # 200 sessions a part, each a day after the part before.
        data = [(f"s{part}-{i}", "m", at(1440 * part + k), float(k), None) for i in range(200) for k in (1, 3)]
        data += [("s-long", "m", at(1440 * part), None if part == 2 else 4.0, "x" if part == 3 else None)]
        land(spark, data, RESULT, f"{base}/in")
        stream = spark.readStream.schema(RESULT).parquet(f"{base}/in")
        query = live.stream_closed_sessions(stream, f"{base}/out", f"{base}/state")
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    # 1000 sessions passed; only those of the newest part are held.
    assert max(kept) <= 2 * 201
    found = {r["session_id"]: r for r in rows(live.read_closed_sessions(spark, f"{base}/out"))}
    assert len(found) == 801
    assert (found["s0-7"]["n"], found["s0-7"]["mean_score"], found["s0-7"]["unscored"]) == (2, 2.0, 0)
    # It was closed four times; its totals add up: 4, 4, none, an error.
    assert (found["s-long"]["n"], found["s-long"]["mean_score"], found["s-long"]["unscored"]) == (2, 4.0, 1)
    live.compact(spark, f"{base}/out", live.merged())
    assert {r["session_id"]: r for r in rows(live.read_closed_sessions(spark, f"{base}/out"))} == found


@pytest.mark.parametrize("daily", [False, True])
def test_progress_ends_as_in_batch(spark, daily):
    base = scratch_path(spark, "progress")
    schema = "session_id string, position long, elapsed_ms long, total long, ts timestamp"
    every = [(f"s{i % 3}", i // 3 + 1, None if i % 5 == 0 else i, 20, at(i * 100)) for i in range(45)]
    options = {"time_column": "ts", "watermark": "1 hour"} if daily else {}
    for part in range(3):
        land(spark, every[part * 15 : part * 15 + 15], schema, f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        live.stream_progress(stream, f"{base}/out", f"{base}/state", **options).awaitTermination()
        now = {r["session_id"]: r for r in rows(live.read_progress(spark, f"{base}/out", daily))}
        batch = summary.progress(spark.createDataFrame(every[: part * 15 + 15], schema).drop("ts"))
        last = {r["session_id"]: r for r in rows(batch.where(F.col("completed") == 5 * (part + 1)))}
        assert now.keys() == last.keys()
        for name, r in now.items():
            for c in ("completed", "total", "remaining", "mean_ms", "eta_ms"):
                assert r[c] == pytest.approx(last[name][c])


def test_snapshots_take_the_place_of_batches(spark):
    path = scratch_path(spark, "batches")
    for b in range(4):
        spark.createDataFrame([("a", b), (f"b{b}", b)], "g string, v int").write.parquet(f"{path}/batch_id={b}")
    # A batch without a success mark has died: nobody reads it.
    spark.createDataFrame([("dead", 0)], "g string, v int").write.parquet(f"{path}/batch_id=4")
    files.delete(spark, path, "batch_id=4", "_SUCCESS")
    read = lambda: sorted((r["g"], r["v"]) for r in live.newest(("g",))(live.landed(spark, path)).collect())
    before = read()
    assert ("a", 3) in before and "dead" not in dict(before)
    assert live.compact(spark, path, live.newest(("g",))) == 2
    assert live.compact(spark, path, live.newest(("g",))) == 2
    assert read() == before
    live.vacuum(spark, path)
    assert read() == before and "batch_id=0" not in files.names(spark, path) and "batch_id=3" in files.names(spark, path)
    with pytest.raises(ValueError, match="no batch"):
        live.landed(spark, scratch_path(spark, "none"))
