"""As-of joins in one shuffle and projections whose steps are not written out again."""

import random

import pytest
from pyspark.sql import functions as F

from groundmetrics.functions import geometry as geo
from groundmetrics.operators import scale as sc
from groundmetrics.operators import timeline as tl

KEY = ["scene", "row_index"]
POINT = "struct<x:double,y:double,z:double>"
VIEW = f"k bigint, cameraPosition {POINT}, cameraRotation struct<x:double,y:double,z:double,w:double>, cameraFOV double, p {POINT}"


def series(spark):
    rng = random.Random(11)
    rows = [("s", 0, i, rng.randint(0, 4000)) for i in range(500)]  # a long series with equal stamps
    rows += [("s", k, 1000 * k + i, rng.randint(0, 4000)) for k in range(1, 5) for i in range(20)]
    targets = [(i, "s", rng.randint(0, 6), rng.randint(-300, 4300)) for i in range(200)]
    samples = spark.createDataFrame(rows, "scene string, row_index bigint, file_seq bigint, t_us bigint")
    return rows, targets, samples, spark.createDataFrame(targets, "tid bigint, scene string, row_index bigint, target bigint")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("limit", [50_000, 200, 10])
def test_long_and_short_series_agree_with_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(sc, "TASK_ROWS", limit)  # none, one or most of the series are cut into slices
    rows, targets, samples, t = series(spark)
    got = {r.tid: (r.t_us, r.file_seq) for r in sc.nearest_sample(t, samples, KEY, "target", "t_us", "file_seq", ["file_seq"], 300).collect()}
    want = {}
    for tid, _, key, at in targets:
        best = min((r for r in rows if r[1] == key), key=lambda r: (abs(r[3] - at), r[3], r[2]), default=None)
        want[tid] = (best[3], best[2]) if best else (None, None)
    assert got == want


def test_short_series_need_one_shuffle(spark):
    _, _, samples, t = series(spark)
    near = sc.nearest_sample(t, samples, KEY, "target", "t_us", "file_seq", ["file_seq"], 300)
    assert exchanges(near) == 1
    assert exchanges(near.groupBy(*KEY).count()) == 1


def test_panel_manifest_moves_each_side_once(spark):
    from groundmetrics.plans.panels import panel_manifest

    # event windows, samples with targets, referents, anchors
    assert exchanges(panel_manifest(spark, "/root/testdata/sf0.001")) == 4


def views(spark):
    rng = random.Random(3)
    some = lambda n, s=4.0: tuple(rng.uniform(-s, s) for _ in range(n))
    rows = [(k, some(3), some(4, 1.0), rng.choice([0.0, 60.0, 90.0, 120.0, 180.0]), some(3)) for k in range(300)]
    rows += [(300, None, some(4, 1.0), 90.0, some(3)), (301, some(3), None, 90.0, some(3)), (302, some(3), some(4, 1.0), None, some(3)), (303, some(3), some(4, 1.0), 90.0, None)]
    return spark.createDataFrame(rows, VIEW)


@pytest.mark.parametrize("mode", ["bounded", "tolerant", "square_unbounded"])
def test_projection_columns_equal_the_expression(spark, mode):
    cam = ("cameraPosition", "cameraRotation", "cameraFOV")
    df = views(spark)
    out = geo.with_projection(df.withColumn("one", geo.project_point(*cam, F.col("p"), 200, 100, mode)), "two", *cam, F.col("p"), 200, 100, mode)
    assert out.columns == [*df.columns, "one", "two"]
    rows = out.collect()
    assert all(r.one == r.two for r in rows) and 10 < sum(r.one is not None for r in rows) < 300


def test_steps_of_a_projection_are_not_repeated(spark):
    cam = ("cameraPosition", "cameraRotation", "cameraFOV")
    df = views(spark)
    plan = df.select(geo.project_point(*cam, F.col("p"), 200, 100).alias("uv")).select("uv.u", "uv.v")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("TAN(") == 1
    eye = F.struct(F.lit(True).alias("isEyeOpen"), F.col("p").alias("gazePoint"), F.col("p").alias("cameraHitPoint"))
    seen = tl.projected_samples(df.withColumn("t_us", F.col("k") * 1000).withColumn("eyeGaze", eye), 200, 100)
    cands = seen.select("k", "t_us", "gaze_uv", "camera").localCheckpoint()
    moved = tl.pixel_stats(cands, seen, ["k"], 5000, 200, 100)
    assert moved._jdf.queryExecution().optimizedPlan().toString().count("TAN(") == 1
