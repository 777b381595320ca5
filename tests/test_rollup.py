"""Kept totals: equal to the full report, late scores, reruns, bucket scale, what is read."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gradeloom import schemas, scratch_path
from gradeloom.operators import report, rollup, sinks
from gradeloom.plans import evaluation
from gradeloom.plans.report import add_late_scores, rolled_report, stored_report
from gradeloom.sources import commits, files, store

SCORES = f"{schemas.SCORES}, session_id string"
T0 = dt.datetime(2024, 1, 1)


def made_up(spark, seed, n=400, sessions=4):
    """Random generations and scores: missing models, tags and latencies, ties, a few values below 0."""
    draw = random.Random(seed)
    gens, scores = [], []
    for i in range(n):
        session = f"eval-{min(draw.randrange(2 * sessions), sessions - 1)}"
        model = draw.choice(["a", "b", "c:free", None, ""])
        tags = draw.choice([None, [], ["dataset:x", "provider:p:eu"], ["provider:q", "dataset:y", "dataset:x"], ["dataset:y"]])
        latency = draw.choice([None, 1.0, 2.0, draw.random(), draw.lognormvariate(0, 3), 0.0, -draw.random()])
        gens.append((f"o{i}", session, draw.choice([f"eval:m:i{i}", "x"]), model, tags, latency, draw.choice([None, i]), i,
                     draw.random(), T0 + dt.timedelta(minutes=draw.randrange(n)), "text"))
        for _ in range(draw.randrange(4)):
            name, value = draw.choice([("llm-judge-score", draw.randrange(6)), ("json-schema-valid", draw.randrange(2)),
                                       ("response-truncated", 1), ("llm-judge-error", None), ("own", 3)])
            scores.append((f"o{i}", name, None if value is None else float(value), None, "NUMERIC", None, session))
    scores.append(("nobody", "llm-judge-score", 5.0, None, "NUMERIC", None, "eval-0"))
    return spark.createDataFrame(gens, schemas.GENERATIONS), spark.createDataFrame(scores, SCORES)


def close(found, expected, keys=("model",)):
    """Both reports' rows, floats as near as sums in another order are."""
    def key(r):
        return [(r[k] is not None, r[k]) for k in keys]

    found, expected = sorted(rows(found), key=key), sorted(rows(expected), key=key)
    assert len(found) == len(expected) > 0 and found[0].keys() == expected[0].keys()
    for a, b in zip(found, expected, strict=True):
        for name in a:
            same = pytest.approx(b[name], rel=1e-9) if isinstance(b[name], float) else b[name]
            assert a[name] == same, (name, a, b)


@pytest.mark.parametrize("seed,by", [(1, ("model",)), (2, ("model", "provider")), (3, ("provider", "model"))])
def test_the_report_from_kept_totals_is_the_full_one(spark, seed, by):
    gens, scores = made_up(spark, seed)
    path = scratch_path(spark, "rollup")
    rollup.write_rollup(gens, scores, path)
    close(rollup.rollup_report(rollup.read_rollup(spark, path), by), report.model_report(gens, scores, by), by)
    some = gens.where(F.col("session_id").isin("eval-1", "eval-2"))
    close(rollup.rollup_report(rollup.read_rollup(spark, path, ["eval-1", "eval-2"]), by), report.model_report(some, scores, by), by)
    listed = spark.createDataFrame([("eval-1",), ("eval-2",), ("eval-2",)], "session_id string")
    close(rollup.rollup_report(rollup.read_rollup(spark, path, listed, "y"), by),
          report.model_report(report.filter_dataset(some, "y"), scores, by), by)


def test_generations_are_read_in_one_pass_over_one_shuffle(spark):
    gens, _ = made_up(spark, 4)
    path = scratch_path(spark, "gens")
    gens.write.parquet(path)
    plan = rollup.generation_partials(spark.read.schema(schemas.GENERATIONS).parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "output#" not in plan.split("ReadSchema")[1]


def test_late_scores_add_up_and_replace_themselves(spark):
    gens, scores = made_up(spark, 5)
    base = scratch_path(spark, "store")
    late = F.pmod(F.hash("observation_id", "name"), F.lit(3))
    sinks.write_generations(gens, f"{base}/generations", "one")
    sinks.write_scores(scores.where(late == 0), f"{base}/scores", "one", gens)
    sinks.write_sessions(gens.groupBy("session_id").agg(F.min("start_time").alias("created_at")).withColumn("environment", F.lit("e")),
                         f"{base}/sessions", "one")
    rollup.write_rollup(gens, scores.where(late == 0), f"{base}/rollup", "one")
    for part in (1, 2, 2):
        add_late_scores(spark, base, scores.where(late == part), f"late-{part}")
    close(rolled_report(spark, base, 30_000), report.model_report(gens, scores))
    close(stored_report(spark, base, 30_000), report.model_report(gens, scores))
    close(rolled_report(spark, base, 30_000, all=True), report.model_report(gens, scores))
    close(rolled_report(spark, base, 30_000, last=2, dataset_id="x"), stored_report(spark, base, 30_000, last=2, dataset_id="x"))
    # Another attempt at a session does away with what came late to the one before.
    one = gens.where("session_id = 'eval-1'")
    rollup.write_rollup(one, scores.limit(0), f"{base}/rollup")
    rest = scores.where("session_id <> 'eval-1'")
    close(rollup.rollup_report(rollup.read_rollup(spark, f"{base}/rollup")), report.model_report(gens, rest))
    # Folded, and with what is not seen any more removed, it is the same.
    assert rollup.compact_rollup(spark, f"{base}/rollup") == 2
    commits.vacuum(spark, f"{base}/rollup", older_than_hours=-1)
    close(rollup.rollup_report(rollup.read_rollup(spark, f"{base}/rollup")), report.model_report(gens, rest))
    # Without generations in the way: the report needs none.
    files.delete(spark, f"{base}/generations")
    assert rolled_report(spark, base, 30_000).count() > 0
    with pytest.raises(ValueError):
        rollup.add_scores(one, scores, f"{base}/rollup", "run")


def test_a_stored_run_keeps_its_totals(spark):
    from test_evaluation import judge_json, plan, run

    base, done = scratch_path(spark, "store"), run(spark, plan(spark), judge_json)
    for _ in range(2):
        evaluation.store(done, base, "test", rollup=True)
        close(rolled_report(spark, base, 30_000), stored_report(spark, base, 30_000))


def test_no_rows_and_no_scores(spark):
    gens, scores = made_up(spark, 6, 30)
    path = scratch_path(spark, "rollup")
    rollup.write_rollup(gens.limit(0), scores, path, sessions=gens)
    assert rollup.rollup_report(rollup.read_rollup(spark, path)).count() == 0
    rollup.write_rollup(gens, scores.limit(0), path)
    close(rollup.rollup_report(rollup.read_rollup(spark, path)), report.model_report(gens, scores.limit(0)))


def test_buckets_ascend_with_their_values(spark):
    draw = random.Random(7)
    values = [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), 1.0, 1.0000001]
    values += [draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 300) for _ in range(3000)]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", rollup.bucket_of(F.col("v")).alias("b"),
                                                                            rollup.middle_of(rollup.bucket_of(F.col("v"))).alias("m"))
    got = [(r["v"], r["b"], r["m"]) for r in found.orderBy("v").collect()]
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:], strict=False))
    assert all((b > 0) == (v > 0) and (b < 0) == (v < 0) for v, b, _ in got)
    assert all(m == pytest.approx(v, rel=0.002) for v, _, m in got if 1e-300 < abs(v) < 1e300)


@pytest.mark.parametrize(
    "numbers,limit,expected",
    [([], 3, []), ([4], 3, [(4, 4)]), ([1, 2, 3, 9], 3, [(1, 3), (9, 9)]), ([1, 5, 6, 20, 40], 2, [(1, 20), (40, 40)]), ([1, 5, 9], 1, [(1, 9)])],
)
def test_ranges(numbers, limit, expected):
    assert rollup.ranges_of(numbers, limit) == expected


def test_exact_quantiles_read_the_wanted_buckets_alone(spark):
    n = 400_000
    gens = spark.range(n).select(
        F.col("id").cast("string").alias("observation_id"), F.lit("eval-1").alias("session_id"), F.lit("eval:m:i").alias("trace_name"),
        F.lit("m").alias("model"), F.lit(None).cast("array<string>").alias("tags"), F.exp(F.rand(1) * 8).alias("latency"),
        F.lit(1).cast("long").alias("tokens_in"), F.lit(1).cast("long").alias("tokens_out"), F.lit(0.5).alias("total_cost"),
        F.lit(T0).cast("timestamp").alias("start_time"), F.lit("x").alias("output"),
    )
    path = scratch_path(spark, "rollup")
    rollup.write_rollup(gens, made_up(spark, 8, 2)[1], path)
    rolled = rollup.read_rollup(spark, path)
    found = rollup.rolled_quantiles(rolled, ["model"], {"p50": 0.5, "p95": 0.95})
    (row,) = found.collect()
    stored = [r["value"] for r in rolled.where("kind = 'values'").orderBy("value").select("value").collect()]
    assert len(stored) == n
    for name, q in (("p50", 0.5), ("p95", 0.95)):
        at = (n - 1) * q
        low = int(at)
        assert row[name] == pytest.approx(stored[low] + (stored[low + 1] - stored[low]) * (at - low))
    (rough,) = rollup.rolled_quantiles(rolled, ["model"], {"p50": 0.5, "p95": 0.95}, exact=False).collect()
    assert rough["p50"] == pytest.approx(row["p50"], rel=0.004) and rough["p95"] == pytest.approx(row["p95"], rel=0.004)
    assert scanned(found) < n / 4 < scanned(rolled.where("kind = 'values'"))


def scanned(df):
    """Rows that come out of the scans of a plan once it has run."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "FileSourceScanExec":
            total = max(total, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total
