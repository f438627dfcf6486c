"""Skew-safe building blocks against brute force, with one key holding most rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from groundmetrics.operators import scale as sc
from groundmetrics.operators import timeline as tl

KEY = ["scene", "row_index"]


@pytest.fixture(scope="module")
def telemetry(spark):
    rng = random.Random(7)
    rows = [("s", 0, i, rng.randint(0, 4000), float(i % 9)) for i in range(600)]  # hot key with equal stamps
    rows += [("s", k, 1000 + 40 * k + i, rng.randint(0, 4000), float(i)) for k in range(1, 6) for i in range(20)]
    return rows, spark.createDataFrame(rows, "scene string, row_index bigint, file_seq bigint, t_us bigint, v double")


@pytest.mark.parametrize("width", [50, 700, 10_000])
def test_nearest_sample(spark, telemetry, width):
    rows, samples = telemetry
    rng = random.Random(1)
    targets = [(i, "s", rng.randint(0, 7), rng.randint(-300, 4300)) for i in range(300)]
    t = spark.createDataFrame(targets, "tid bigint, scene string, row_index bigint, target bigint")
    got = {r.tid: (r.t_us, r.file_seq) for r in sc.nearest_sample(t, samples, KEY, "target", "t_us", "file_seq", ["file_seq", "v"], width).collect()}
    assert len(got) == len(targets)
    for tid, _, key, at in targets:
        mine = [r for r in rows if r[1] == key]
        best = min(mine, key=lambda r: (abs(r[3] - at), r[3], r[2])) if mine else None
        assert got[tid] == ((best[3], best[2]) if best else (None, None))


def test_plans_have_no_cross_product(spark, telemetry):
    _, samples = telemetry
    near = sc.nearest_sample(samples.select(*KEY, F.col("t_us").alias("target")), samples, KEY, "target", "t_us", "file_seq", ["v"], 500)
    pts = samples.withColumn("gaze", F.struct(*[F.col("v").alias(a) for a in "xyz"]))
    band = tl.neighbour_stats(pts.select(*KEY, "t_us", "gaze"), pts, KEY, 100, ["gaze"])
    for df in (near, band):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_neighbour_stats(spark, telemetry):
    rows, samples = telemetry
    pts = samples.withColumn("gaze", F.struct(F.col("v").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))
    cands = pts.filter("file_seq % 50 = 0").select(*KEY, "file_seq", "t_us", "gaze")
    got = {r.file_seq: (r.gaze_neighbours, r.gaze_move) for r in tl.neighbour_stats(cands, pts, KEY, 100, ["gaze"]).collect()}
    for r in rows:
        if r[2] % 50 == 0:
            near = [abs(o[4] - r[4]) for o in rows if o[1] == r[1] and 1 < abs(o[3] - r[3]) <= 100]
            assert got[r[2]][0] == len(near)
            assert got[r[2]][1] == (pytest.approx(sum(near) / len(near)) if near else None)


def test_bucket_rank_and_lead(spark, telemetry):
    rows, samples = telemetry
    ranked = {r.file_seq: r["rank"] for r in sc.bucket_rank(samples, KEY, "t_us", "rank", 137, ["file_seq"]).collect()}
    led = {r.file_seq: r.nxt for r in sc.bucket_lead(samples, KEY, "t_us", ["file_seq"], 137, "nxt").collect()}
    for key in range(6):
        mine = sorted((r[3], r[2]) for r in rows if r[1] == key)
        for i, (_, seq) in enumerate(mine):
            assert ranked[seq] == i + 1
            assert led[seq] == (mine[i + 1][0] if i + 1 < len(mine) else None)


def test_global_rank(spark, telemetry):
    rows, samples = telemetry
    got = {r.file_seq: r["rank"] for r in sc.global_rank(samples, ["v", "file_seq"], "rank").collect()}
    assert [s for s, _ in sorted(got.items(), key=lambda kv: kv[1])] == [r[2] for r in sorted(rows, key=lambda r: (r[4], r[2]))]


def test_binned_quantiles(spark, telemetry):
    rows, samples = telemetry
    qs = {"lo": 0.05, "mid": 0.5, "hi": 0.975}
    got = {r.row_index: r for r in sc.binned_quantiles(samples, ["row_index"], "v", qs, bins=5).collect()}
    builtin = {r.row_index: r for r in sc.exact_quantiles(samples, ["row_index"], {n: ("v", q) for n, q in qs.items()}).collect()}
    for key in range(6):
        values = sorted(r[4] for r in rows if r[1] == key)
        assert got[key].mid == pytest.approx(statistics.median(values))
        for n in qs:
            assert got[key][n] == pytest.approx(builtin[key][n])
    whole = sc.binned_quantiles(samples, [], "v", {"mid": 0.5}, bins=3).first()
    assert whole.mid == pytest.approx(statistics.median(r[4] for r in rows))


def test_first_by_and_partitioning(spark, telemetry):
    _, samples = telemetry
    first = sorted(map(tuple, sc.first_by(samples, KEY, ["t_us", "file_seq"]).collect()))
    assert first == sorted(map(tuple, sc.first_by(samples.repartition(1), KEY, ["t_us", "file_seq"]).collect()))
    assert first == sorted(map(tuple, sc.first_by(samples.repartition(8), KEY, ["t_us", "file_seq"]).collect()))


def test_temporal_nms(spark):
    rng = random.Random(2)
    rows = [("s", k, rng.randint(0, 100), round(rng.random(), 3), rng.random() < 0.3, rng.random() < 0.3) for k in range(20) for _ in range(15)]
    df = spark.createDataFrame(rows, "scene string, row_index bigint, t_us bigint, score double, gaze boolean, hand boolean")
    got = {}
    for r in tl.temporal_nms(df, KEY, 3, 12, quota=["gaze", "hand"]).collect():
        got.setdefault(r.row_index, []).append((r.t_us, r.score))
    for k in range(20):
        ranked = sorted((r for r in rows if r[1] == k), key=lambda r: (-r[3], r[2], r[4], r[5]))
        picked = []
        far = lambda r: all(abs(r[2] - p[2]) >= 12 for p in picked)
        for cue in (4, 5):
            hit = next((r for r in ranked if r[cue] and far(r)), None)
            picked += [hit] if hit else []
        for r in ranked:
            if len(picked) < 3 and far(r):
                picked.append(r)
        assert sorted(got[k]) == sorted((p[2], p[3]) for p in picked)


def test_sides_that_grow_are_not_broadcast(spark, telemetry):
    """Small tables look broadcastable; an exploded window or the slices of a series must not be sent through the driver."""
    samples = telemetry[1].withColumn("p", F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z")))
    events = samples.groupBy(*KEY).agg(F.min("t_us").alias("t_start"), F.max("t_us").alias("t_end"))
    targets = samples.select(*KEY, F.col("t_us").alias("target"))
    plans = [
        tl.inside_samples(events, samples, KEY, 500, ["file_seq"]),
        sc.nearest_sample(targets, samples, KEY, "target", "t_us", "file_seq", ["file_seq"], 500),
        tl.neighbour_stats(samples, samples, KEY, 500, ["p"]),
        sc.bucket_rank(samples, KEY, "t_us", "rank", 500, ["file_seq"]),
    ]
    for df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_partitions_follow_the_rows(spark, telemetry, monkeypatch):
    """More rows give more partitions than the session's, so that what one task sorts does not grow."""
    monkeypatch.setattr(sc, "dealt", lambda df, cols, source, rows=None, real=sc.dealt: real(df, cols, source, 20))
    telemetry = telemetry[1]
    n = telemetry.count() // 20 + 1
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = sc.nearest_sample(telemetry.select(*KEY, F.col("t_us").alias("target")), telemetry, KEY, "target", "t_us", "file_seq", ["file_seq"], 500)
    assert f", {n}), REPARTITION_BY_NUM" in near._jdf.queryExecution().executedPlan().toString()
    assert near.count() == telemetry.count()


def test_values_behind_quantiles_are_planned_once(spark):
    """Both forms read written values; the expression behind them stays out of the plan."""
    big = spark.range(200).select(F.lit(1).alias("k"), F.sin(F.col("id").cast("double")).alias("v"))
    out = sc.exact_quantiles(big, ["k"], {"mid": ("v", 0.5)}, limit=10)
    assert "SIN(" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = statistics.median(r.v for r in big.collect())
    assert abs(out.first().mid - want) < 1e-12


def test_assignment_work_is_not_repeated(spark):
    """A summary reads its detail once: no Python evaluation is left in the plan."""
    from groundmetrics.operators import points as pt

    same = F.pandas_udf(lambda c: c, "array<double>")
    detail = spark.range(4).select(
        F.lit("s").alias("scene"), F.lit(True).alias("parse_ok"), F.lit(True).alias("exact"),
        *[F.lit(1).alias(c) for c in ("tp", "fp", "fn", "cardinality_error", "duplicate_count", "pred_count", "undefined_gt")],
        *[F.lit(1).alias(f"{m}_{n}") for m in ("tp", "fp", "fn") for n in ("0_5", "1_0", "2_0")],
        *[same(F.array(F.col("id").cast("double"))).alias(c) for c in ("margin_errors", "euclidean_errors", "scene_norm_errors")])
    out = pt.point_summary(detail, ["scene"])
    assert "ArrowEvalPython" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first().median_margin == 1.5


def test_error_extremes_computes_errors_once(spark):
    from groundmetrics.operators import aggregate as ag

    df = spark.range(40).select(F.lit("s").alias("scene"), F.col("id").alias("row_index"), (F.col("id") * 7 % 40).cast("double").alias("e"))
    out = ag.error_extremes(df.repartition(3), "e", 2)
    assert sorted((r.side, r.e) for r in out.collect()) == [("highest", 38.0), ("highest", 39.0), ("lowest", 0.0), ("lowest", 1.0)]
    assert "Range" not in out._jdf.queryExecution().executedPlan().toString()
