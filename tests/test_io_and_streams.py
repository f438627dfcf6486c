"""Readers, sinks, parsers, rendering and streaming jobs."""

import json

import pytest
from pyspark.sql import functions as F

from groundmetrics.functions import text as tx
from groundmetrics.operators import audit as au
from groundmetrics.operators import batch as bt
from groundmetrics.operators import panels as pn
from groundmetrics.operators import parsing as ps
from groundmetrics.operators import sets as st
from groundmetrics.sources import readers as rd
from groundmetrics.sources import sinks as sk
from groundmetrics.streaming import jobs


def test_parse_points_golden(spark):
    cases = {
        '{"points_3d": [{"referent": "box", "point": [1, 2, 3], "confidence": 2}]}': (True, "", 1), '{"points_3d": []}': (True, "", 0),
        'text ```json\n{"points_3d": [{"point": [1, 2, 3]}]}\n```': (True, "", 1), '{"points_3d": [{"point": [1, 2]}]}': (False, "point_entry_0_wrong_dimension", 0),
        '{"points_3d": [{"point": [1, NaN, 2]}]}': (False, None, 0), "": (False, "empty_output", 0), "{broken": (False, "invalid_json", 0),
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    for r in ps.parse_points(df).collect():
        ok, reason, n = cases[r.raw]
        assert r.parse_ok == ok and len(r.points) == n and (reason is None or r.invalid_reason == reason)


def test_text_helpers(spark):
    row = spark.range(1).select(
        tx.unique_by_key(F.array(F.lit("Red Box"), F.lit("red_box"), F.lit(""), F.lit("cup"))).alias("u"),
        tx.clean_phrase(F.lit("This red_box, there"), F.lit("")).alias("p"), tx.clean_phrase(F.lit("it"), F.lit("")).alias("only"),
        tx.representative(F.array(*[F.lit(i) for i in range(6)]), 3).alias("r"), tx.finite_double(F.lit(" NaN ")).alias("nan"),
        tx.parse_iso(F.lit("2024-01-02T03:04:05.1234567Z")).cast("string").alias("ts"), tx.finite_int(F.lit("7.9"), lenient=True).alias("n"),
        tx.drop_lines(F.lit("keep\nSecret x\nalso"), ["secret"]).alias("lines"), tx.filename_ts(F.lit("a/ScreenRecord_2024-01-02-03_04_05.mp4")).cast("string").alias("f"),
    ).first()
    assert row.u == ["Red Box", "cup"] and row.p == "red box." and row.only == "it." and row.r == [0, 2, 5] and row.nan is None
    assert row.ts == "2024-01-02 03:04:05.123456" and row.n == 7 and row.lines == "keep\nalso" and row.f == "2024-01-02 03:04:05"


def test_readers(spark, tmp_path):
    (tmp_path / "scene1_anchor_table.tsv").write_text("﻿object_name\tx_world\ty_world\tz_world\taliases\nbox\t1\t2\t3\tcrate; red box\n\t1\t1\t1\t\nbad\t1\tx\t3\t\n")
    inv = rd.read_anchors(spark, str(tmp_path / "scene1_anchor_table.tsv")).collect()
    assert [(r.scene, r.anchor_id, r.y, r.aliases) for r in inv] == [("scene1", "box", 2.0, ["crate", "red box"])]

    logs = tmp_path / "scene1"
    logs.mkdir()
    sample = lambda s: json.dumps({"timestamp": f"2024-01-01T00:00:0{s}.1234567Z", "cameraPosition": {"x": s, "y": 0, "z": 0}, "cameraFOV": 60})
    (logs / "good.json").write_text("[" + sample(0) + "," + sample(1) + "]")
    (logs / "gap.json").write_text("[" + sample(0) + "\n" + sample(1))
    (logs / "lines.json").write_text(sample(0) + ",\n" + sample(1) + ",\n" + sample(2) + "\n")
    (logs / "junk.json").write_text("[{oops")
    samples, bad = rd.read_telemetry(spark, str(logs))
    counts = {r.f: r.n for r in samples.groupBy(F.regexp_extract("file_path", r"([^/]+)$", 1).alias("f")).agg(F.count("t_us").alias("n")).collect()}
    assert counts == {"good.json": 2, "gap.json": 2, "lines.json": 3}
    assert [r.file_path.endswith("junk.json") for r in bad.collect()] == [True]
    assert samples.filter("cameraPosition.x = 2").first().scene == "scene1"

    keys = tmp_path / "keys.txt"
    keys.write_text("# head\nscene:1:5\n\nscene2:7\nbroken\n")
    good, wrong = rd.read_keys(spark, str(keys))
    assert sorted(map(tuple, good.collect())) == [("scene2", 7), ("scene:1", 5)] and [r.line for r in wrong.collect()] == ["broken"]

    preds = tmp_path / "preds"
    preds.mkdir()
    (preds / "row_3.json").write_text('{"scene": "s"}')
    (preds / "row_9.json").write_text('{"scene": "s", "row_index": "4"}')
    assert sorted(r.row_index for r in rd.read_predictions_json(spark, str(preds)).collect()) == [3, 4]

    meta = tmp_path / "media"
    meta.mkdir()
    (meta / "metadata_1.json").write_text("{oops")
    (meta / "metadata_2.json").write_text('{"timestamp": "2024-01-01T00:00:00Z"}')
    assert rd.read_metadata(spark, str(meta)).first().file_name == "metadata_2.json"
    assert rd.list_files(spark, str(preds)).count() == 2
    assert rd.content_hash(spark, str(preds)).select("digest").distinct().count() == 2
    summary = tmp_path / "scene7_match_eval_summary.json"
    summary.write_text('{"total": 3}')
    assert rd.read_summaries(spark, str(summary)).first().scene == "scene7"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, 0.5, True), ("s", 2, None, False)], "scene string, n int, v double, ok boolean")
    sk.write_table(df, str(tmp_path / "t"), ["scene", "v", "ok", "absent"], missing="UNKNOWN")
    back = rd.read_delimited(spark, str(tmp_path / "t"), types={"v": "double"}, sep=",")
    assert sorted((r.v or -1, r.ok, r.absent) for r in back.collect()) == [(-1, "False", "UNKNOWN"), (0.5, "True", "UNKNOWN")]
    assert sk.to_markdown(df.orderBy("n"), ["scene", "v"]).splitlines()[2:] == ["| s | 0.5000 |", "| s | - |"]
    sk.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_no_ground_truth_in_model_facing_rows(spark):
    ev = spark.createDataFrame([("s", 0, "secret"), ("s", 1, "x")], "scene string, row_index bigint, target_description string")
    gt = spark.createDataFrame([("s", 0, "a")], "scene string, row_index bigint, gt_ids string")
    facing, hidden = pn.evidence_manifest(ev, gt)
    assert au.forbidden_columns(facing, pn.GT_COLUMNS) == [] and facing.count() == 1 and hidden.count() == 1


def test_masked_text_is_a_subsequence(spark):
    text = ("event_id: e\ninstruction_text: take it Scene bounds:\n- P1:\n  image: a.jpg\n  relative_sample_time_seconds: 1\n  selection_score: 2\n  selection_reason: r\n"
            "  camera_context_world:\n    gaze_valid: True\n    hand_valid: True\n  primary_copyable_gaze_point_hypotheses:\n    P1_GAZE: [1, 2, 3]\n"
            "  secondary_copyable_hand_point_hypotheses:\n    P1_HAND: [1, 2, 3]\n  scale_cues_world_units:\n    camera_to_gaze_hit_distance: 3\n")
    rows = bt.mask_context(spark.createDataFrame([(text,)], "context_text string")).collect()
    assert len(rows) == len(bt.VARIANTS)
    for r in rows:
        masked = iter(text)
        assert all(c in masked for c in r.context_text.replace("[visual_evidence_withheld]", ""))
        assert ("P1_GAZE: [" in r.context_text) == (r.variant not in ("no_gaze", "no_gaze_hand"))
        assert ("P1_HAND: [" in r.context_text) == (r.variant not in ("no_hand", "no_hand_strict", "no_gaze_hand"))


def test_fingerprint_is_order_free_and_exact_form_is_guarded(spark):
    a = spark.createDataFrame([("g", k) for k in "bca"], "g string, k string")
    x, y = (au.set_fingerprint(d, ["g"], F.col("k")).first() for d in (a, a.orderBy("k")))
    assert x == y
    assert au.set_fingerprint_text(a, ["g"], F.col("k")).first().sha256 == __import__("hashlib").sha256(b"a\nb\nc").hexdigest()
    with pytest.raises(ValueError):
        au.set_fingerprint_text(a, ["g"], F.col("k"), limit=2)


def test_merge_aliases(spark):
    row = spark.range(1).select(st.merge_aliases(F.array(F.lit("Box")), F.array(F.lit("b-o-x"), F.lit("crate"))).alias("m")).first()
    assert row.m == ["Box", "crate"]


def test_streams(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    rows = [("s", i % 5, "r1", f"2024-01-01T00:00:{i:02d}Z", "{}", i % 2 == 0, 1, 1, 0) for i in range(20)]
    names = ("scene", "row_index", "run", "ts", "parsed_json", "parse_ok", "tp", "fp", "fn")
    (land / "a.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    q = jobs.ingest_predictions(jobs.prediction_stream(spark, str(land)), out, mark)
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 5

    expected = spark.createDataFrame([("r1", 40)], "run string, expected bigint")
    stream = jobs.prediction_stream(spark, str(land))
    for name, df, check in (
        ("gm_progress", jobs.progress(stream, expected), lambda r: (r.done, r.share) == (20, 0.5)),
        ("gm_running", jobs.running_metrics(stream), lambda r: (r.tp, r.micro_precision, r.micro_recall) == (20, 0.5, 1.0)),
    ):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        assert check(spark.table(name).first())
    feed = stream.withColumn("gaze_valid", F.col("parse_ok"))
    q = jobs.gaze_segments(feed, "5 seconds", "0 seconds").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "seg")).option(
        "checkpointLocation", str(tmp_path / "segmark")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "seg")).agg(F.max("n_samples")).first()[0] == 1
