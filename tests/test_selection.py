"""Panel selection, record masking and answer recovery against plain versions and small cases."""

import json
import math

from pyspark.sql import functions as F

from groundmetrics.functions import payload as pl
from groundmetrics.operators import aggregate as ag
from groundmetrics.operators import batch as bt
from groundmetrics.operators import parsing as ps
from groundmetrics.operators import sets as st
from groundmetrics.operators import timeline as tl

SAMPLE = ("k string, file_seq bigint, t_us bigint, cameraPosition struct<x:double,y:double,z:double>, "
          "cameraRotation struct<x:double,y:double,z:double,w:double>, cameraFOV double, eyeGaze struct<isEyeOpen:boolean,"
          "gazePoint:struct<x:double,y:double,z:double>,cameraHitPoint:struct<x:double,y:double,z:double>>")
EVENT = "k string, e bigint, t_start bigint, t_end bigint, offset_us bigint"
S = 1_000_000


def panels(spark, events, samples, n=2, gap=S, **kw):
    ev, sm = spark.createDataFrame(events, EVENT), spark.createDataFrame(samples, SAMPLE)
    out = tl.select_panels(ev, sm, ["k"], ["k", "e"], n, 0.5, S, gap, 10 * S, size=(200, 100), **kw)
    return sorted((r.k, r.e, r.panel_index, r.video_us, r.t_us, round(r.score, 6), r.reason) for r in out.collect())


def turned(angle):
    return (0.0, math.sin(angle / 2), 0.0, math.cos(angle / 2))


def test_panels_follow_gaze_stability_and_spacing(spark):
    # a camera turned to +x sees the gaze straight ahead until it wanders from 3 s on
    seen = [("a", i, i * S // 2, (0.0, 0.0, 0.0), turned(math.pi / 2), 90.0, (True, (5.0, 0.0, 4.0 if i in (6, 8) else 0.0), None)) for i in range(10)]
    got = panels(spark, [("a", 1, 100, 4 * S + 100, 100)], seen, n=2, gap=2 * S)
    # neighbours within 1 s are equal up to 1.5 s: full marks, the earliest first; next 2 s on, with one stray neighbour
    assert [g[3:5] for g in got] == [(100, 0), (2 * S + 100, 2 * S)]
    assert got[0][5:] == (2.15, "gaze:gazePoint;gaze_stability:1.00;camera_stability:1.00")
    # x = -4 of a depth of 5 at half-width 10: 40 pixels for one of four neighbours
    assert abs(got[1][5] - (1 + 0.9 * (1 - 10.0 / 280) + 0.25)) < 1e-6


def test_panels_fall_back_and_uniform(spark):
    closed = [("a", i, i * S, (0.0, 0.0, 0.0), turned(0.0), 90.0, (False, (0.0, 0.0, 5.0), None)) for i in range(4)]
    behind = [("b", i, i * S, (0.0, 0.0, 0.0), turned(math.pi), 90.0, (None, None, (0.0, 0.0, 5.0))) for i in range(4)]
    events = [("a", 1, 0, 3 * S, 0), ("b", 2, 0, 3 * S, 0), ("none", 3, 10, 10 + S, 10)]
    got = panels(spark, events, closed + behind)
    assert [g[:4] for g in got] == [("a", 1, 1, 0), ("a", 1, 2, 3 * S), ("b", 2, 1, 0), ("b", 2, 2, 3 * S), ("none", 3, 1, 10), ("none", 3, 2, 10 + S)]
    assert {g[6] for g in got} == {"uniform_fallback:no_positive_evidence"} and {g[5] for g in got} == {0.0}
    assert [g[3:5] for g in panels(spark, events[2:], closed, n=1, strategy="uniform")] == [(10 + S // 2, S // 2)]
    assert panels(spark, [], []) == []


def test_single_sample_scores_without_neighbours(spark):
    alone = [("a", 0, 0, None, turned(0.0), 90.0, (True, (0.0, 0.0, 5.0), None)), ("b", 1, 0, (0.0, 0.0, 0.0), turned(0.0), 90.0, (True, None, (0.0, 0.0, 5.0)))]
    got = panels(spark, [("a", 1, 0, S, 0), ("b", 1, 0, S, 0)], alone)
    assert [(g[0], g[5], g[6].split(";")[0]) for g in got if g[5] > 0] == [("b", 1.15, "gaze:cameraHitPoint")]


def test_spaced_picks_equal_the_greedy_walk(spark):
    rows = [(k, t * 7919 % 101, (t * 31 + k) % 6 / 2.0) for k in range(4) for t in range(25 * (k + 1))]
    got = tl.spaced_picks(spark.createDataFrame(rows, "k int, t_us int, score double"), ["k"], 4, 9).collect()
    want = set()
    for k in range(4):
        taken = []
        for score, t in sorted({(-s, t) for q, t, s in rows if q == k and s > 0}):
            if len(taken) < 4 and all(abs(t - u) >= 9 for u in taken):
                taken.append(t)
        want |= {(k, t) for t in taken}
    assert {(r.k, r.t_us) for r in got} == want and len(got) == len(want)


def test_masks_on_one_line_and_words_of_an_instruction(spark):
    many = ("Event:\nevent_id: e\ninstruction_text: see image: b.jpg and hand_valid: no\nutterance_text: that\nScene bounds:\nEvidence:\n- P1:\n  image: a.jpg\n"
            "  relative_sample_time_seconds: 1\n  selection_score: 2\n    gaze_valid: True\n    hand_valid: True\n    P1_HAND: [1]\n  scale_cues_world_units:")
    one = " ".join("event_id: e instruction_text: take it Scene bounds: s - P1: image: a.jpg gaze_valid: True hand_valid: True scale_cues_world_units:".split())
    rows = bt.mask_context(spark.createDataFrame([(1, many), (2, one), (3, ""), (4, None)], "i int, context_text string")).collect()
    text = {(r.i, r.variant): r.context_text for r in rows}
    assert len(rows) == 4 * len(bt.VARIANTS) and text[1, "full"] == many and text[2, "full"] == one
    assert "see image: b.jpg and hand_valid: no" in text[1, "no_gaze_hand"] and "hand_valid: True" not in text[1, "no_gaze_hand"]
    assert text[1, "no_visual"] == many.replace("image: a.jpg", f"image: {bt.MASKED_IMAGE}")
    assert "instruction_text" not in text[1, "no_instruction"] and "\nScene bounds:\n" in text[1, "no_instruction"]
    assert text[2, "no_instruction"] == "event_id: e Scene bounds: s - P1: image: a.jpg gaze_valid: True hand_valid: True scale_cues_world_units:"
    assert text[2, "no_gaze"] == one.replace(" gaze_valid: True", "")
    assert {text[3, v] for v in bt.VARIANTS} == {""} and {text[4, v] for v in bt.VARIANTS} == {None}


def test_peak_from_the_second_block_and_panels_from_text(spark):
    raw = ["```json\n{broken: }\n``` then ```json {\"peak_time_seconds\": 4, \"confidence\": 2, \"primary_panel_id\": \"p3\"} ```",
           "Peak-Time seconds = 99; panel id: P7, also p1 and P7", "only P2", "", None]
    df = spark.createDataFrame([(i, r, 0.0, 10.0) for i, r in enumerate(raw)], "i int, raw string, t_start double, t_end double")
    got = {r.i: (r.peak_source, r.peak_seconds, r.confidence, r.panel_id, r.candidate_panel_ids) for r in ps.peak_time(df).collect()}
    assert got[0] == ("json", 4.0, 1.0, "P3", []) and got[1] == ("text", 10.0, 0.5, "P7", ["P7", "P1"])
    assert got[2] == ("fallback", 5.0, 0.0, "P2", ["P2"]) and got[3] == got[4] == ("fallback", 5.0, 0.0, None, [])


def test_canonical_json_against_the_json_module(spark):
    same = ['{"b": [1, {"y": "\\u00e9", "x": 2.50}], "a": null}', '{ "a":null,"b":[1.0,{"x":2.5,"y":"é"}] }', '{"a":null,"b":[10e-1,{"x":25e-1,"y":"é"}]}']
    other = ['{"b": [1, {"y": "é", "x": 2.5}]}', '{"b": [{"y": "é", "x": 2.5}, 1], "a": null}', '{"b": [1, {"y": "é.0", "x": 2.5}], "a": null}',
             '{"b": [1, {"y": "7.0", "x": 2.5}], "a": null}', '{"b": [1, {"y": "7", "x": 2.5}], "a": null}', '{"b": [1, {"y": "q\\"1.0", "x": 2.5}], "a": true}']
    df = spark.createDataFrame([(t,) for t in same + other], "t string").select("t", pl.canonical_json("t").alias("c"))
    got = {r.t: r.c for r in df.collect()}
    assert len({got[t] for t in same}) == 1 and len({got[t] for t in same + other}) == 1 + len(other)
    assert all(json.loads(c) == json.loads(t) for t, c in got.items())
    odd = spark.createDataFrame([("[1]",), ('{"p":[1]}',), ("",), (None,), ("{",), ('{"p":[]}',)], "t string")
    assert [r.c for r in odd.select(pl.canonical_json("t", "p").alias("c")).collect()] == ['{"p":[1]}'] * 2 + ['{"p":[]}'] * 4
    assert [r.c for r in odd.select(pl.canonical_json("t").alias("c")).collect()][2:5] == [None] * 3


def test_null_groups_are_not_the_overall_row(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 4)], "scene string, n int")
    rows = ag.grouping_sets(df, [[], ["scene"]], [F.sum("n").alias("n")]).collect()
    assert {(r.partition, r.n) for r in rows} == {("overall", 7), ("a", 1), ("missing", 6)}


def test_last_repair_of_a_cell_counts(spark):
    table = spark.createDataFrame([("s", 1, "old"), ("s", 2, "old")], "scene string, row_index bigint, v string")
    repairs = spark.createDataFrame([("s", 1, "v", "z", 1), ("s", 1, "v", "b", 2)], "scene string, row_index bigint, column string, new_value string, seq int")
    fixed, log = st.apply_repairs(table, repairs, ["scene", "row_index"], ["v"], order="seq")
    assert {(r.row_index, r.v) for r in fixed.collect()} == {(1, "b"), (2, "old")} and log.count() == 1


def test_selection_keys_need_not_hold_the_scene(spark):
    aliases = spark.createDataFrame([("s", "Box", "box_1", 1), ("t", "Box", "box_9", 1)], "scene string, alias string, anchor_id string, anchor_seq int")
    rows = spark.createDataFrame([(1, "s", "entity", "language", "", ["box"]), (2, "t", "entity", "language", "", ["BOX", "cup"])],
                                 "i int, scene string, referent_type string, primary_source string, note string, names array<string>")
    got = {r.i: (r.response_status, r.resolved) for r in ps.validate_selection(rows, aliases, ["i"]).collect()}
    assert got == {1: ("ok", ["box_1"]), 2: ("partial_invalid_object_name", ["box_9"])}


def test_rows_at_quantiles_equal_a_full_sort(spark):
    def plain(data, quantiles):
        full = sorted((v, i) for v, i in data if v is not None and v == v)
        return {(q, int((len(full) - 1) * q) + 1, *full[int((len(full) - 1) * q)]) for q in quantiles} if full else set()

    def ours(data, quantiles, accuracy):
        df = spark.createDataFrame(data, "v double, i bigint")
        return [(r.quantile, r["rank"], r.v, r.i) for r in ag.quantile_rows(df, "v", quantiles, ["i"], accuracy=accuracy).collect()]

    quantiles = (0.0, 0.1, 0.101, 0.5, 0.99, 1.0)
    even = [((i * 7919) % 3001 / 7.0, i) for i in range(3000)] + [(None, -1), (float("nan"), -2)]
    hot = [(5.0 if i % 3 else float(i), i) for i in range(900)] + [(1e300, 1000)]
    for data in (even, hot, [(2.0, 1)], [(None, 1)]):
        for accuracy in (10, 1000):
            got = ours(data, quantiles, accuracy)
            assert len(got) == len(set(got)) and set(got) == plain(data, quantiles)
