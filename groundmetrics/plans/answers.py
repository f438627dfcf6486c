"""Answer parsing and validation, batch scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundmetrics.functions import text as tx
from groundmetrics.operators import batch as bt
from groundmetrics.operators import parsing as ps
from groundmetrics.operators import sets as st
from groundmetrics.plans.closed_set import rounded
from groundmetrics.operators.scale import spread
from groundmetrics.plans.views import registry, view

query, QUERIES, ORACLES = registry()


@query("""SELECT scene, row_index, pred_seq, CASE code WHEN 0 THEN 'empty_output' WHEN 1 THEN 'invalid_json' WHEN 4 THEN 'invalid_json'
        WHEN 3 THEN 'point_entry_0_wrong_dimension' WHEN 5 THEN 'missing_or_nonarray_points_3d' WHEN 6 THEN 'point_entry_0_missing_point'
        WHEN 7 THEN 'point_entry_1_not_object' WHEN 8 THEN 'point_entry_0_invalid_confidence' WHEN 9 THEN 'point_entry_0_nonfinite_or_not_number'
        ELSE '' END AS invalid_reason, code IN (2, 10, 11) AS parse_ok, CASE WHEN code IN (2, 11) THEN 1 ELSE 0 END::BIGINT AS n_points,
        CASE WHEN code IN (2, 11) THEN round(x + y + z, 9) ELSE 0 END AS coord_sum, CASE WHEN code IN (2, 11) THEN least(y, 1.0) END AS confidence
    FROM @v_raw""")
def parse_points(spark, sf):
    out = ps.parse_points(spread(view(spark, sf, "v_raw")))
    total = F.aggregate("points", F.lit(0.0), lambda s, p: s + p["point"]["x"] + p["point"]["y"] + p["point"]["z"])
    return out.select(*st.KEY, "pred_seq", "invalid_reason", "parse_ok", F.size("points").cast("bigint").alias("n_points"),
                      F.round(total, 9).alias("coord_sum"), F.get(F.col("points")["confidence"], 0).alias("confidence"))


@query("""SELECT scene, row_index, pred_seq, CASE WHEN code IN (2, 7, 8, 11) THEN 1 ELSE 0 END::BIGINT AS n_points FROM @v_raw""")
def reread_points(spark, sf):
    raw = spread(view(spark, sf, "v_raw"))
    inner = F.when(F.col("code") == 2, F.regexp_extract("raw", r"(?s)json\s*(\{.*\})\s*```", 1)).otherwise(F.col("raw"))
    return raw.select(*st.KEY, "pred_seq", F.size(ps.reread_points(inner)).cast("bigint").alias("n_points"))


@query("""SELECT scene, row_index, pred_seq, CASE code WHEN 0 THEN 'no_json_object' WHEN 3 THEN 'point_3d_wrong_dimension' WHEN 4 THEN 'missing_point_3d'
        WHEN 5 THEN 'point_3d_nonfinite_or_not_number' ELSE '' END AS invalid_reason, code IN (1, 2) AS parse_ok,
        CASE WHEN code IN (1, 2) THEN x END AS x, CASE WHEN code IN (1, 2) THEN z END AS z FROM @v_raw_point""")
def parse_point(spark, sf):
    out = ps.parse_point(spread(view(spark, sf, "v_raw_point").drop("x", "y", "z")))
    return out.select(*st.KEY, "pred_seq", "invalid_reason", "parse_ok", "point.x", "point.z")


@query("""SELECT scene, row_index, pred_seq, code % 4 > 0 AS parse_ok, CASE WHEN code % 4 > 0 THEN 1 ELSE 0 END::BIGINT AS n_referents,
        CASE WHEN code % 4 > 0 THEN name || ' // x' END AS mention, CASE WHEN code % 4 > 0 THEN 'P' || panel END AS panel_id,
        CASE WHEN code % 4 > 0 AND xn <= 1 THEN xn END AS x_norm, CASE WHEN code % 4 > 0 AND yn <= 1 THEN yn END AS y_norm,
        CASE WHEN code % 4 > 0 THEN 'gaze_crop' END AS coordinate_space FROM @v_raw_refs""")
def parse_referents(spark, sf):
    out = ps.parse_referents(spread(view(spark, sf, "v_raw_refs")))
    first = F.get("referents", 0)
    return out.select(*st.KEY, "pred_seq", "parse_ok", F.size("referents").cast("bigint").alias("n_referents"),
                      *[first[c].alias(c) for c in ("mention", "panel_id", "x_norm", "y_norm", "coordinate_space")])


LABEL_JSON = """SELECT scene, row_index, pred_seq, code, name, CASE code % 4
    WHEN 0 THEN concat('{"parsed_response": {"selected_object_names": ["', name, '", "', lower(name), '", "extra one"], "selected_object_name": "Extra-One"}}')
    WHEN 1 THEN concat('{"adjusted_response": {"selected_objects": [{"object_name": "', name, '"}, {"selected_object_name": "other"}]}, "resolved_object_row": {"object_name": "other"}}')
    WHEN 2 THEN concat('{"parsed_response": {"selected_object_names": "', name, '; b/c|', name, '"}, "resolved_object_rows": [{"object_name": "d"}]}')
    ELSE '{"parsed_response": {}}' END AS payload FROM @v_raw_base"""


@query("""SELECT scene, row_index, pred_seq, CASE code % 4 WHEN 0 THEN name || ',extra one' WHEN 1 THEN name || ',other' WHEN 2 THEN name || ',b,c,d' ELSE '' END AS labels
    FROM @v_raw_base""")
def collect_labels(spark, sf):
    out = spread(view(spark, sf, LABEL_JSON))
    return out.select(*st.KEY, "pred_seq", F.concat_ws(",", ps.collect_labels("payload")).alias("labels"))


PICKS = """SELECT scene, row_index, pred_seq, code, CASE WHEN code % 6 = 5 THEN '' WHEN code % 6 = 4 THEN 'none' ELSE 'entity' END AS referent_type,
    CASE code % 6 WHEN 0 THEN 'gazePoint' WHEN 1 THEN 'visual_only' WHEN 2 THEN 'radar' WHEN 4 THEN 'none' ELSE 'gazePoint' END AS primary_source,
    CASE WHEN l_linenumber > 3 THEN 'gaze was off' ELSE 'clear' END AS note,
    CASE WHEN code = 6 THEN '' WHEN l_linenumber = 1 THEN 'ghost' WHEN l_linenumber = 2 THEN concat(name, ',ghost,', lower(name)) ELSE name END AS picked, name, l_linenumber
    FROM @v_raw_base"""


@query(f"""WITH p AS ({PICKS}), r AS (SELECT p.*, a.anchor_id, len(list_filter(string_split(picked, ','), n -> n <> '')) AS n,
        (picked LIKE '%ghost%')::INT AS ghost, (picked LIKE '%NATION%' AND a.anchor_id IS NOT NULL) AS good,
        CASE WHEN picked LIKE '%NATION%' AND a.anchor_id IS NULL THEN CASE WHEN l_linenumber = 2 THEN 2 ELSE 1 END ELSE 0 END AS lost
        FROM p LEFT JOIN @v_anchors a ON p.scene = a.scene AND p.name = a.anchor_id),
    s AS (SELECT *, ghost + lost AS bad, referent_type = 'none' OR primary_source = 'none' AS isnone, primary_source <> 'radar' AS known FROM r)
    SELECT scene, row_index, pred_seq, CASE WHEN isnone THEN CASE WHEN referent_type <> '' THEN 'ok' ELSE 'incomplete' END
        WHEN bad > 0 AND NOT good THEN 'invalid_object_name' WHEN bad > 0 THEN 'partial_invalid_object_name'
        WHEN primary_source = 'gazePoint' AND n = 0 THEN 'incomplete' WHEN NOT known THEN 'inconsistent_source'
        WHEN referent_type <> '' THEN 'ok' ELSE 'incomplete' END AS response_status,
        CASE WHEN NOT isnone AND good THEN anchor_id ELSE '' END AS resolved,
        CASE WHEN isnone THEN 0 ELSE bad + (NOT known)::INT + (primary_source = 'gazePoint' AND n = 0)::INT
            + (primary_source = 'visual_only' AND note NOT LIKE '%gaze%')::INT END::BIGINT AS n_warnings FROM s""")
def validate_selection(spark, sf):
    picks = view(spark, sf, PICKS).withColumn("names", tx.split_names("picked", "gt"))
    inv = view(spark, sf, "v_aliases").withColumn("aliases", tx.split_names("aliases"))
    out = ps.validate_selection(picks, st.alias_entries(inv), [*st.KEY, "pred_seq"])
    return out.select(*st.KEY, "pred_seq", "response_status", F.concat_ws(",", "resolved").alias("resolved"),
                      F.size("warnings").cast("bigint").alias("n_warnings"))


@query("""SELECT event_id, code IN (1, 5, 6, 7, 8) AS valid, CASE WHEN code = 1 THEN 'none' WHEN code > 4 THEN 'entity' END AS referent_type,
        CASE WHEN code > 4 THEN least(u, 1.0) END AS u_norm, CASE WHEN code = 1 THEN 0.4 WHEN code > 4 THEN least(value / 50, 1.0) END AS confidence FROM @v_responses""")
def validate_response(spark, sf):
    out = ps.validate_response(view(spark, sf, "v_responses"))
    return out.select("event_id", F.col("response").isNotNull().alias("valid"), "response.referent_type", "response.u_norm", "response.confidence")


@query("""SELECT event_type, count(*) AS total, count(*) FILTER (code IN (1, 5, 6, 7, 8)) AS ok_count, count(*) FILTER (code = 1) AS none_count,
        count(*) FILTER (code = 0) AS warning_count, round(avg(CASE WHEN code = 1 THEN 0.4 WHEN code > 4 THEN least(value / 50, 1.0) END), 6) AS mean_confidence
    FROM @v_responses GROUP BY 1""")
def batch_summary(spark, sf):
    required = ["referent_type", "primary_source", "prior_usage", "confidence"]
    d = ps.validate_response(view(spark, sf, "v_responses"))
    d = d.withColumn("warnings", F.when(F.col("raw").startswith("{") | F.col("raw").startswith("ok"), F.array().cast("array<string>")).otherwise(ps.missing_fields("raw", required)))
    return rounded(ps.batch_summary(d, ["event_type"]), "mean_confidence")


@query("""SELECT event_id, CASE code WHEN 3 THEN 'fallback' WHEN 1 THEN 'text' ELSE 'json' END AS peak_source,
        round(CASE WHEN code = 3 THEN t_start + 15 ELSE greatest(t_start, least(t_end, value)) END, 6) AS peak_seconds,
        round(CASE code WHEN 0 THEN least(value / 40, 1.0) WHEN 1 THEN 0.7 WHEN 2 THEN 0.25 ELSE 0 END, 6) AS confidence, code <> 3 AS parse_ok,
        CASE code WHEN 0 THEN 'P2' WHEN 1 THEN 'P4' WHEN 3 THEN CASE WHEN event_id % 8 = 7 THEN 'P5' END END AS panel_id,
        CASE code WHEN 0 THEN 'P2,P7' WHEN 1 THEN 'P9,P4' WHEN 2 THEN '' ELSE CASE event_id % 8 WHEN 3 THEN '' ELSE 'P5,P3' END END AS candidates FROM @v_peaks""")
def peak_time(spark, sf):
    out = ps.peak_time(view(spark, sf, "v_peaks"))
    return rounded(out, "peak_seconds", "confidence").select("event_id", "peak_source", "peak_seconds", "confidence", "parse_ok", "panel_id",
                                                              F.concat_ws(",", "candidate_panel_ids").alias("candidates"))


MODS = """SELECT o_orderkey AS row_index, concat(CASE o_orderpriority WHEN '1-URGENT' THEN 'Vision, eye' WHEN '2-HIGH' THEN 'hands;video;image'
    WHEN '3-MEDIUM' THEN 'none' WHEN '5-LOW' THEN 'camera sonar' ELSE ' gaze ' END, CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '3-MEDIUM' THEN ',gaze_prior' ELSE '' END) AS ablation,
    o_orderpriority, o_orderstatus FROM @orders"""


@query(f"""WITH m AS ({MODS}) SELECT row_index, CASE o_orderpriority WHEN '1-URGENT' THEN 'gaze,visual' WHEN '2-HIGH' THEN CASE o_orderstatus WHEN 'P' THEN 'gaze,hand,visual' ELSE 'hand,visual' END
        WHEN '3-MEDIUM' THEN '' WHEN '5-LOW' THEN CASE o_orderstatus WHEN 'P' THEN 'gaze,structured_geometry' ELSE 'structured_geometry' END ELSE 'gaze' END AS modalities,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'sonar' ELSE '' END AS unknown FROM m""")
def parse_modalities(spark, sf):
    known, unknown = ps.parse_modalities("ablation")
    return view(spark, sf, MODS).select("row_index", F.concat_ws(",", known).alias("modalities"), F.concat_ws(",", unknown).alias("unknown"))


def _predict(batch):
    """Stand-in predictor: rejects negative balances, echoes the price otherwise."""
    if (batch["o_totalprice"] < 5000).any():
        raise ValueError("price below range")
    return [f"price={int(p)}" for p in batch["o_totalprice"]]


@query("""SELECT scene, row_index, CASE WHEN o_totalprice < 5000 THEN '' ELSE 'price=' || CAST(floor(o_totalprice) AS BIGINT) END AS raw_output,
        CASE WHEN o_totalprice < 5000 THEN 'ValueError: price below range' ELSE '' END AS error_message FROM @v_keys WHERE o_orderstatus <> 'F'""")
def score_batch(spark, sf):
    keys = view(spark, sf, "v_keys")
    return bt.score_batch(keys.select(*st.KEY, "o_totalprice"), keys.filter("o_orderstatus = 'F'"), _predict)
