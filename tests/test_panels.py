"""2D matching, hand boxes and baselines against plain-Python versions."""

import math
import random

from pyspark.sql import functions as F

from groundmetrics.operators import baselines as bl
from groundmetrics.operators import panels as pn
from groundmetrics.operators import timeline as tl


def slow_match(preds, gts, threshold, joint):
    gts = [g for g in gts if g["ok"] or not joint]
    matched, tp, fp = set(), 0, 0
    for p in preds:
        live = [g for g in gts if g["referent"] not in matched]
        named = [g for g in live if g["label"] == p["label"]]
        near = sorted((math.hypot((p["x"] - g["u"]) * 1280, (p["y"] - g["v"]) * 720), i) for i, g in enumerate(named or live) if g["panel"] == p["panel"])
        if near and near[0][0] <= threshold:
            tp += 1
            matched.add((named or live)[near[0][1]]["referent"])
        else:
            fp += 1
    return tp, fp, max(0, len({g["referent"] for g in gts}) - tp)


def test_greedy_match(spark):
    rng = random.Random(4)
    preds, gts = [], []
    for k in range(40):
        preds += [("s", k, i, rng.choice(["Red box", "cup", "x"]), f"P{rng.randint(1, 2)}", rng.random() * 0.3, rng.random() * 0.3) for i in range(rng.randint(0, 6))]
        gts += [("s", k, i, r, f"P{rng.randint(1, 2)}", rng.random() * 0.3, rng.random() * 0.3, 1280, 720, rng.random() < 0.6)
                for i, r in enumerate(rng.sample(["red_box", "cup", "lamp", "door"], rng.randint(0, 4)))]
    p = spark.createDataFrame(preds, "scene string, row_index bigint, pred_seq bigint, mention string, pred_panel string, x_norm double, y_norm double")
    g = spark.createDataFrame(gts, "scene string, row_index bigint, manifest_seq bigint, referent string, panel_id string, gt_u double, gt_v double, image_width int, image_height int, evidence_acceptable boolean")
    keys = spark.createDataFrame([("s", k) for k in range(40)], "scene string, row_index bigint")
    listed = pn.greedy_match(keys, p, g).collect()
    rounds = {r.row_index: r for r in pn.greedy_match(keys, p, g, limit=1).collect()}  # answers of two points and more go round by round
    assert len(rounds) == 40
    for row in listed:
        for name in pn.match_names():
            a, b = row[name], rounds[row.row_index][name]
            assert (a.tp, a.fp, a.fn) == (b.tp, b.fp, b.fn) and abs(a.dist - b.dist) < 1e-9
        mine = [dict(label="".join(c for c in q[3].lower() if c.isalnum()), panel=q[4], x=q[5], y=q[6]) for q in preds if q[1] == row.row_index]
        truth = [dict(referent=q[3], label="".join(c for c in q[3].lower() if c.isalnum()), panel=q[4], u=q[5], v=q[6], ok=q[9]) for q in gts if q[1] == row.row_index]
        for t in (50, 100, 150, 200):
            for kind, joint in (("point", False), ("joint", True)):
                m = row[f"{kind}_{t}"]
                assert (m.tp, m.fp, m.fn) == slow_match(mine, truth, float(t), joint)
                assert m.tp + m.fp == len(mine)


def hand_sample(spark, joints, tracked=True):
    xyz = "struct<x:double,y:double,z:double>"
    hand = f"struct<joints:array<struct<id:int,position:{xyz}>>>"
    row = [(1, {"x": 0.0, "y": 0.0, "z": 0.0}, {"x": 0.0, "y": 0.0, "z": 0.0, "w": 1.0}, 90.0,
            {"isLeftHandTracked": False, "isRightHandTracked": tracked, "leftHand": None,
             "rightHand": {"joints": [{"id": i, "position": dict(zip("xyz", j))} for i, j in enumerate(joints)]}})]
    return spark.createDataFrame(row, f"sid int, cameraPosition {xyz}, cameraRotation struct<x:double,y:double,z:double,w:double>, cameraFOV double, "
                                      f"handData struct<isLeftHandTracked:boolean,isRightHandTracked:boolean,leftHand:{hand},rightHand:{hand}>")


def test_hand_boxes(spark):
    seen = tl.hand_boxes(hand_sample(spark, [(-0.04, -0.04, 1.0), (0.04, 0.04, 1.0)]), ["sid"], 256, 256).first()
    assert seen.status == "masked" and seen.mask_fraction > 0.1
    off = tl.hand_boxes(hand_sample(spark, [(2.5, 0.0, 1.0)]), ["sid"], 128, 128).first()
    assert off.status == "tracked_offscreen" and off.mask_fraction == 0
    none = tl.hand_boxes(hand_sample(spark, [(0.0, 0.0, 1.0)], tracked=False), ["sid"], 128, 128).first()
    assert none.status == "no_tracked_hand" and none.mask_fraction == 0


def slow_dedup(points, r, k):
    out = []
    for p in points:
        if len(out) < k and all(math.dist(p, q) >= r for q in out):
            out.append(p)
    return out


def slow_fuse(gaze, hand, r, k):
    out, used = [], set()
    for g in gaze:
        free = [(math.dist(g, h), i) for i, h in enumerate(hand) if i not in used]
        if free and min(free)[0] <= max(1.0, 2 * r):
            i = min(free)[1]
            used.add(i)
            out.append(tuple((a + b) / 2 for a, b in zip(g, hand[i])))
        else:
            out.append(g)
    return slow_dedup(out + [h for i, h in enumerate(hand) if i not in used], r, k)


def test_baselines(spark):
    rng = random.Random(9)
    lists = [([tuple(rng.uniform(0, 3) for _ in range(3)) for _ in range(rng.randint(0, 3))] for _ in range(2)) for _ in range(60)]
    lists = [tuple(pair) for pair in lists]
    rows = [(i, [dict(zip("xyz", p)) for p in g], [dict(zip("xyz", p)) for p in h]) for i, (g, h) in enumerate(lists)]
    pts = "array<struct<x:double,y:double,z:double>>"
    df = spark.createDataFrame(rows, f"i int, g {pts}, h {pts}")
    out = df.select("i", bl.radius_dedup(F.col("g"), 1.0, 2).alias("d"), bl.fuse_points(F.col("g"), F.col("h"), 0.6, 3).alias("f")).collect()
    for r in out:
        g, h = lists[r.i]
        assert [tuple(p) for p in r.d] == slow_dedup(g, 1.0, 2)
        assert [tuple(p) for p in r.f] == slow_fuse(g, h, 0.6, 3)


def test_2d_runs_shuffle_line_items_once(spark):
    """Manifest and answers cross the network once each, dealt by order; the three modes of a run share that pass."""
    import __spark_entry__ as entry

    for name in ("evaluate_2d", "greedy_match", "point_distance"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "ENSURE_REQUIREMENTS" not in plan.replace("BroadcastExchange", ""), name
        assert plan.count("REPARTITION_BY_NUM") <= 3, name


def test_modes_together_equal_modes_alone(spark):
    manifest = [("s", k, i, f"r{k % 3 + i % 2}", f"P{i % 2 + 1}", 0.1 * i, 0.2, 1280, 720, True, True, i != 1) for k in range(6) for i in range(4)]
    m = spark.createDataFrame(manifest, "scene string, row_index bigint, manifest_seq bigint, referent string, panel_id string, gt_u double, gt_v double, image_width int, "
                                        "image_height int, projection_valid boolean, evidence_acceptable boolean, frame_extracted boolean")
    answers = [("s", k, i, "r1", f"p{i % 3}", 0.1 * i, 0.21, 0.05 * i if i % 2 else None, 0.1) for k in range(5) for i in range(5)]
    answers += [("t", 0, 0, "r1", "P1", 0.1, 0.2, None, None)]  # the same row_index in another scene
    p = spark.createDataFrame(answers, "scene string, row_index bigint, pred_seq bigint, mention string, pred_panel string, x_norm double, y_norm double, sheet_x_norm double, sheet_y_norm double")
    modes = ("panel", "sheet", "auto")
    together = pn.evaluate_2d(m, p, modes)
    for mode in modes:
        alone = pn.evaluate_2d(m, p, mode)
        assert alone.count() == 6
        assert sorted(map(str, alone.collect())) == sorted(map(str, together.filter(F.col("mode") == mode).drop("mode").collect()))
