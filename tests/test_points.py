"""3D scoring: golden cases, brute-force comparison and invariances."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundmetrics.operators import aggregate as ag
from groundmetrics.operators import nearest as nn
from groundmetrics.operators import points as pt
from groundmetrics.operators import sets as st

ANCHORS = [("a", 0.0, 0.0, 0.0), ("b", 2.0, 0.0, 0.0), ("c", 5.0, 0.0, 0.0)]


def frames(spark, anchors, gt, preds, factor=1.0):
    a = spark.createDataFrame([("s", i, n, x * factor, y * factor, z * factor) for i, (n, x, y, z) in enumerate(anchors)],
                              "scene string, anchor_seq bigint, anchor_id string, x double, y double, z double")
    g = spark.createDataFrame([("s", 0, i, n) for i, n in enumerate(gt)], "scene string, row_index bigint, gt_seq bigint, label string")
    p = spark.createDataFrame([("s", 0, i, x * factor, y * factor, z * factor) for i, (x, y, z) in enumerate(preds)],
                              "scene string, row_index bigint, pred_seq bigint, x double, y double, z double")
    k = spark.createDataFrame([("s", 0)], "scene string, row_index bigint")
    return k, p, st.build_gt(g, a.drop("anchor_seq")), a, g


def margin(spark, anchors, gt, preds, factor=1.0):
    k, p, arrays, a, _ = frames(spark, anchors, gt, preds, factor)
    return pt.margin_metrics(k, p, arrays, a, len(anchors)).first()


def sets(spark, anchors, gt, preds):
    k, p, arrays, a, _ = frames(spark, anchors, gt, preds)
    points = arrays.select("scene", "row_index", F.inline("gt")).withColumnRenamed("id", "anchor_id")
    return pt.anchor_set_metrics(k, p, points, a).first()


@pytest.mark.parametrize("preds,expected", [([(0, 0, 0)], (1, 0, 0)), ([(0, 0, 0), (5, 0, 0)], (1, 1, 0)), ([], (0, 0, 1))])
def test_margin_golden(spark, preds, expected):
    m = margin(spark, ANCHORS, ["a"], preds)
    assert (m.tp_1_0, m.fp_1_0, m.fn_1_0) == expected


def test_nearest_recovery(spark):
    m = sets(spark, [("a", 0, 0, 0), ("b", 10, 0, 0)], ["b"], [(9.9, 0, 0)])
    assert m.exact and m.f1 == 1.0


def test_multi_target_and_missing(spark):
    four = [("a", 0, 0, 0), ("b", 5, 0, 0), ("c", 10, 0, 0), ("d", 0, 5, 0)]
    both = sets(spark, four, ["a", "b"], [(0.1, 0, 0), (4.9, 0, 0)])
    assert (both.tp, both.fp, both.fn, both.exact) == (2, 0, 0, True)
    one = sets(spark, four, ["a", "b"], [(0, 0, 0)])
    assert (one.tp, one.fp, one.fn, one.exact) == (1, 0, 1, False)
    twice = sets(spark, four, ["a"], [(0, 0, 0), (0.1, 0, 0)])
    assert not twice.exact and twice.duplicate_count == 1


def test_scale_invariance(spark):
    one = margin(spark, ANCHORS, ["a", "b"], [(0.4, 0.1, 0), (2.5, 0, 0)])
    seven = margin(spark, ANCHORS, ["a", "b"], [(0.4, 0.1, 0), (2.5, 0, 0)], 7.0)
    assert sorted(one.margin_errors) == pytest.approx(sorted(seven.margin_errors), abs=1e-9)
    assert sorted(seven.euclidean_errors) == pytest.approx([7 * e for e in sorted(one.euclidean_errors)])


def test_undefined_margin(spark):
    m = margin(spark, ANCHORS, ["a", "b", "c"], [(0, 0, 0), (1, 0, 0)])
    assert (m.undefined_gt, m.tp_1_0, m.fp_1_0, m.fn_1_0) == (3, 0, 2, 0)


def best_total(cost):
    n, m = len(cost), len(cost[0])
    if n <= m:
        return min(sum(cost[i][c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))
    return best_total([list(r) for r in zip(*cost)])


def test_assignment_is_optimal():
    rng = random.Random(3)
    for _ in range(150):
        n, m = rng.randint(1, 5), rng.randint(1, 6)
        cost = [[rng.random() for _ in range(m)] for _ in range(n)]
        flat = [(i, j, cost[i][j]) for i in range(n) for j in range(m)]
        pairs = pt.assign_pairs([f[0] for f in flat], [f[1] for f in flat], [f[2] for f in flat], n, m)
        assert len(pairs) == min(n, m) and len({p[0] for p in pairs}) == len(pairs) == len({p[1] for p in pairs})
        assert sum(p[2] for p in pairs) == pytest.approx(best_total(cost))


def test_assignment_prunes_a_hot_interaction(spark):
    """One interaction owns nearly all predictions; keeping max_gt candidates per target changes nothing."""
    rng = random.Random(5)
    rows = [("s", 0, p, g, rng.random()) for p in range(400) for g in range(3)]
    rows += [("s", 1, p, g, rng.random()) for p in range(3) for g in range(3)]
    costs = spark.createDataFrame(rows, "scene string, row_index bigint, pred_seq bigint, gt_seq bigint, cost double")
    got = {r.row_index: r for r in pt.assign_min_cost(costs, 3).collect()}
    used_p, used_g, greedy = set(), set(), 0.0
    for c, p, g in sorted((r[4], r[2], r[3]) for r in rows if r[1] == 0):
        if p not in used_p and g not in used_g:
            used_p.add(p), used_g.add(g)
            greedy += c
    assert got[0].n_pred == 400 and sum(p["cost"] for p in got[0].pairs) == pytest.approx(greedy)
    small = [[next(r[4] for r in rows if r[1] == 1 and r[2] == p and r[3] == g) for g in range(3)] for p in range(3)]
    assert sum(p["cost"] for p in got[1].pairs) == pytest.approx(best_total(small))


def test_cell_descent_equals_brute_force(spark):
    rng = random.Random(11)
    anchors = [("s", i, f"n{i}", rng.gauss(0, 1), rng.gauss(0, 9), rng.choice([0.0, rng.random()])) for i in range(700)]
    anchors += [("s", 700 + i, f"n{700 + i}", *anchors[i][3:]) for i in range(5)]  # repeated places: inventory order decides
    points = [("s", i, rng.gauss(0, 3), rng.gauss(0, 15), rng.gauss(0, 1)) for i in range(120)] + [("s", 120 + i, *anchors[i][3:]) for i in range(5)]
    a = spark.createDataFrame(anchors, "scene string, anchor_seq bigint, anchor_id string, x double, y double, z double")
    p = spark.createDataFrame(points, "scene string, pid bigint, x double, y double, z double")
    assert not nn.fits_in_arrays(a)
    got = {r.pid: r.nearest_id for r in nn.nearest_anchor(p, a).collect()}
    for _, pid, x, y, z in points:
        best = min(anchors, key=lambda q: (math.sqrt((q[3] - x) ** 2 + (q[4] - y) ** 2 + (q[5] - z) ** 2), q[1]))
        assert got[pid] == best[2]
    small = a.filter("anchor_seq < 100")
    one = {r.pid: r.nearest_id for r in nn.nearest_anchor(p, small).collect()}
    assert one == {r.pid: r.nearest_id for r in nn.nearest_by_cells(p, small).collect()}


def test_directional_reasons(spark):
    xyz = "struct<x:double,y:double,z:double>"
    gt = [{"gt_seq": 0, "id": "a", "point": {"x": 0.0, "y": 0.0, "z": 5.0}}]
    o, p = {"x": 0.0, "y": 0.0, "z": 0.0}, {"x": 0.0, "y": 3.0, "z": 3.0}
    rows = [(0, True, o, p, gt), (1, False, o, p, gt), (2, True, o, None, gt), (3, True, None, p, gt), (4, True, o, p, []), (5, True, o, o, gt)]
    df = spark.createDataFrame(rows, f"i int, parse_ok boolean, camera {xyz}, point {xyz}, gt array<struct<gt_seq:bigint,id:string,point:{xyz}>>")
    got = {r.i: (r.invalid_reason, r.angle_deg) for r in pt.directional_match(df).collect()}
    assert got[0][0] == "" and got[0][1] == pytest.approx(45.0)
    assert [got[i][0] for i in range(1, 6)] == ["parse_invalid", "missing_point", "missing_camera", "missing_gt_anchors", "degenerate_camera_or_gt_direction"]


def test_inventories_of_any_size(spark):
    """Nearest, nearest negative and spacing over 600 and 5,000 anchors against brute force, with equal points and shared names."""
    rng = np.random.default_rng(11)
    anchors, xyz = [], {}
    for scene, n in (("a", 600), ("b", 5000), ("c", 3)):
        p = np.round(rng.random((n, 3)) * [10, 10, 2], 2)
        p[5 % n] = p[0]
        xyz[scene] = p
        anchors += [(scene, i, f"{scene}{i - i % 2 if i < 20 else i}", *map(float, p[i])) for i in range(n)]
    inventory = spark.createDataFrame(anchors, "scene string, anchor_seq bigint, anchor_id string, x double, y double, z double")
    names = {(s, i): name for s, i, name, *_ in anchors}
    assert not nn.fits_in_arrays(inventory)
    events, want = [], {}
    for row in range(60):
        scene = "abc"[row % 3]
        ids = rng.choice(len(xyz[scene]), size=min(1 + row % 9, len(xyz[scene])), replace=False).tolist()
        taken = {names[scene, i] for i in ids}
        items = [(i, names[scene, i], tuple(map(float, xyz[scene][i]))) for i in sorted(ids)]
        events.append((scene, row, items))
        free = np.array([names[scene, i] not in taken for i in range(len(xyz[scene]))])
        for i in ids:
            d = np.sqrt(((xyz[scene][free] - xyz[scene][i]) ** 2).sum(axis=1))
            want[row, i] = d.min() if len(d) else None
    gt = spark.createDataFrame(events, "scene string, row_index bigint, gt array<struct<gt_seq:bigint,id:string,point:struct<x:double,y:double,z:double>>>")
    got = {(r.row_index, g.gt_seq): g.negative for r in nn.nearest_negative(gt, inventory).collect() for g in r.gt}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    gaps = {r.scene: r for r in nn.anchor_spacing(inventory).collect()}
    for scene, p in xyz.items():
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        assert gaps[scene].n == len(p) and gaps[scene].mean_gap == pytest.approx(d.min(axis=1).mean())
        assert gaps[scene].median_gap == pytest.approx(np.median(d.min(axis=1)))


def test_bootstrap_interval_against_resampling(spark):
    """The interval of hash-group weights next to plain resampling of interactions; NULL values and a missing partner."""
    rng = np.random.default_rng(2)
    full = [("s", i, bool(rng.random() < 0.6), bool(rng.random() < 0.8)) for i in range(900)]
    other = [("v", "s", i, h if rng.random() < 0.7 else (None if rng.random() < 0.2 else bool(rng.random() < 0.4))) for _, i, h, _ in full] + [("v", "s", 5000, True)]
    f = spark.createDataFrame(full, "scene string, row_index bigint, hit boolean, evaluable boolean")
    a = spark.createDataFrame(other, "variant string, scene string, row_index bigint, hit boolean")
    keys = ["scene", "row_index"]
    got = ag.paired_bootstrap(ag.pair_runs(f, a, keys, {"hit": "evaluable"}), ["variant"], keys, groups=1 << 20).first()
    mask = np.array([m for *_, m in full], float)
    d = np.array([float(bool(o[3])) - float(h) for (_, _, h, _), o in zip(full, other, strict=False)])
    at = rng.integers(0, 900, (4000, 900))
    low, high = np.percentile((d * mask)[at].sum(1) / mask[at].sum(1), [2.5, 97.5])
    assert got.pairs == 900 and got.delta == pytest.approx((d * mask).sum() / mask.sum())
    assert got.ci95_low == pytest.approx(low, abs=0.01) and got.ci95_high == pytest.approx(high, abs=0.01)
    assert ag.paired_bootstrap(ag.pair_runs(f.limit(0), a, keys, {"hit": None}), ["variant"], keys).count() == 0
    w = ag.bootstrap_weights(np.arange(200), np.arange(500), 1)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and len(ag.poisson_steps()) > 8
