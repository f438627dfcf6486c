"""3D point grounding: nearest anchors, assignment, margins, angles and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundmetrics.functions import geometry as geo
from groundmetrics.operators import aggregate as ag
from groundmetrics.operators import audit as au
from groundmetrics.operators import nearest as nn
from groundmetrics.operators import points as pt
from groundmetrics.operators import sets as st
from groundmetrics.operators.scale import spread
from groundmetrics.plans.closed_set import rounded
from groundmetrics.plans.views import registry, view

query, QUERIES, ORACLES = registry()


def col3(prefix: str = ""):
    return tuple(F.col(prefix + a) for a in "xyz")


def gt_arrays(spark, sf):
    return st.build_gt(view(spark, sf, "v_gt"), view(spark, sf, "v_anchors").drop("anchor_seq"))


def anchors_of(spark, sf):
    return view(spark, sf, "v_anchors")


def max_gt(spark, sf) -> int:
    """Bound on GT anchors of one interaction: the largest scene inventory."""
    return anchors_of(spark, sf).groupBy("scene").count().agg(F.max("count")).first()[0]


DIST = "sqrt(({0}x - {1}x) * ({0}x - {1}x) + ({0}y - {1}y) * ({0}y - {1}y) + ({0}z - {1}z) * ({0}z - {1}z))"


def dist_sql(a: str, b: str) -> str:
    return DIST.format(a, b)


@query(f"""SELECT p.scene, p.row_index, p.pred_seq, a.anchor_id, round({dist_sql('p.', 'a.')}, 6) AS dist
    FROM @v_preds p JOIN (SELECT scene, row_index, arg_min(anchor_id, gt_seq) AS anchor_id, arg_min(x, gt_seq) AS x,
        arg_min(y, gt_seq) AS y, arg_min(z, gt_seq) AS z FROM @v_gt_points GROUP BY 1, 2) a
    ON p.scene = a.scene AND p.row_index = a.row_index""")
def vec_distance(spark, sf):
    first = gt_arrays(spark, sf).select(*st.KEY, F.element_at("gt", 1).alias("g"))
    joined = view(spark, sf, "v_preds").join(first, st.KEY)
    d = geo.distance(col3(), F.col("g.point"))
    return joined.select(*st.KEY, "pred_seq", F.col("g.id").alias("anchor_id"), F.round(d, 6).alias("dist"))


NEAR_SQL = f"""near AS (
    SELECT p.scene, p.row_index, p.pred_seq, a.anchor_id AS nearest_id, {dist_sql('p.', 'a.')} AS nearest_dist
    FROM @v_preds p JOIN @v_anchors a ON p.scene = a.scene
    QUALIFY row_number() OVER (PARTITION BY p.scene, p.row_index, p.pred_seq ORDER BY {dist_sql('p.', 'a.')}, a.anchor_seq) = 1)"""


@query(f"WITH {NEAR_SQL} SELECT scene, row_index, pred_seq, nearest_id, round(nearest_dist, 6) AS nearest_dist FROM near")
def nearest_anchor(spark, sf):
    out = nn.nearest_anchor(spread(view(spark, sf, "v_preds")), anchors_of(spark, sf))
    return rounded(out.select(*st.KEY, "pred_seq", "nearest_id", "nearest_dist"), "nearest_dist")


NEG_SQL = f"""neg AS (
    SELECT g.scene, g.row_index, g.anchor_id, min({dist_sql('g.', 'a.')}) AS negative
    FROM @v_gt_points g JOIN @v_anchors a ON g.scene = a.scene
    WHERE NOT EXISTS (SELECT 1 FROM @v_gt_points h WHERE h.scene = g.scene AND h.row_index = g.row_index AND h.anchor_id = a.anchor_id)
    GROUP BY 1, 2, 3)"""


@query(f"WITH {NEG_SQL} SELECT scene, row_index, anchor_id, round(negative, 6) AS negative FROM neg")
def nearest_negative(spark, sf):
    out = nn.nearest_negative(gt_arrays(spark, sf), anchors_of(spark, sf)).select(*st.KEY, F.inline("gt"))
    return out.filter("negative IS NOT NULL").select(*st.KEY, F.col("id").alias("anchor_id"), F.round("negative", 6).alias("negative"))


BOUNDS_SQL = """bounds AS (
    SELECT scene, quantile_cont(x, 0.05) AS x_q05, quantile_cont(y, 0.05) AS y_q05, quantile_cont(z, 0.05) AS z_q05,
        quantile_cont(x, 0.95) AS x_q95, quantile_cont(y, 0.95) AS y_q95, quantile_cont(z, 0.95) AS z_q95
    FROM @v_anchors GROUP BY 1)"""
BOUND_COLS = [f"{a}_q{q}" for q in ("05", "95") for a in "xyz"]
DIAG_SQL = """sqrt((x_q95 - x_q05) * (x_q95 - x_q05) + (y_q95 - y_q05) * (y_q95 - y_q05) + (z_q95 - z_q05) * (z_q95 - z_q05))"""


@query(f"""WITH {BOUNDS_SQL} SELECT scene, {', '.join(f'round({c}, 6) AS {c}' for c in BOUND_COLS)},
    round({DIAG_SQL}, 6) AS robust_diagonal FROM bounds""")
def robust_bounds(spark, sf):
    return rounded(nn.robust_bounds(anchors_of(spark, sf)), *BOUND_COLS, "robust_diagonal")


GAP_SQL = f"""gaps AS (SELECT a.scene, a.anchor_seq, min({dist_sql('a.', 'b.')}) AS gap FROM @v_anchors a JOIN @v_anchors b
    ON a.scene = b.scene AND a.anchor_seq <> b.anchor_seq GROUP BY 1, 2),
spacing AS (SELECT scene, count(*) AS n, avg(gap) AS mean_gap, quantile_cont(gap, 0.05) AS p05,
    quantile_cont(gap, 0.5) AS median_gap, quantile_cont(gap, 0.95) AS p95 FROM gaps GROUP BY 1)"""
GAPS = ("mean_gap", "p05", "median_gap", "p95")


@query(f"WITH {GAP_SQL} SELECT scene, n, {', '.join(f'round({c}, 6) AS {c}' for c in GAPS)} FROM spacing")
def anchor_spacing(spark, sf):
    return rounded(nn.anchor_spacing(anchors_of(spark, sf)), *GAPS)


@query(f"""WITH {BOUNDS_SQL}, {GAP_SQL},
    lost AS (SELECT g.scene, g.row_index, count(*) AS n FROM @v_gt g LEFT JOIN @v_anchors a
        ON g.scene = a.scene AND g.label = a.anchor_id WHERE a.anchor_id IS NULL GROUP BY 1, 2),
    head AS (SELECT scene, string_agg(CAST(row_index AS VARCHAR), ',' ORDER BY row_index) AS unresolved_rows FROM (
        SELECT *, row_number() OVER (PARTITION BY scene ORDER BY row_index) AS r FROM lost) WHERE r <= 50 GROUP BY 1),
    tot AS (SELECT scene, count(*) AS n_unresolved_rows, sum(n)::BIGINT AS n_unresolved FROM lost GROUP BY 1),
    rng AS (SELECT scene, count(DISTINCT row_index) AS interactions, min(row_index) AS first_row, max(row_index) AS last_row FROM @v_gt GROUP BY 1)
    SELECT scene, interactions, first_row, last_row, n, round(mean_gap, 6) AS mean_gap, round({DIAG_SQL}, 6) AS robust_diagonal,
        coalesce(n_unresolved_rows, 0) AS n_unresolved_rows, coalesce(n_unresolved, 0) AS n_unresolved,
        coalesce(unresolved_rows, '') AS unresolved_rows
    FROM rng JOIN bounds USING (scene) LEFT JOIN spacing USING (scene) LEFT JOIN tot USING (scene) LEFT JOIN head USING (scene)""")
def scene_audit(spark, sf):
    out = nn.scene_audit(view(spark, sf, "v_gt"), anchors_of(spark, sf))
    out = out.withColumn("unresolved_rows", F.concat_ws(",", F.col("unresolved_rows").cast("array<string>")))
    return rounded(out, "mean_gap", "robust_diagonal").select(
        "scene", "interactions", "first_row", "last_row", "n", "mean_gap", "robust_diagonal",
        "n_unresolved_rows", "n_unresolved", "unresolved_rows",
    )


SET3D_SQL = f"""{NEAR_SQL},
ids AS (SELECT scene, row_index, id, max(g) AS g, sum(p) AS n FROM (
        SELECT scene, row_index, nearest_id AS id, 0 AS g, 1 AS p FROM near
        UNION ALL SELECT scene, row_index, anchor_id, 1, 0 FROM @v_gt_points) GROUP BY 1, 2, 3),
per AS (SELECT scene, row_index, count(*) FILTER (g = 1 AND n > 0) AS tp, count(*) FILTER (g = 0) AS fp,
        count(*) FILTER (g = 1 AND n = 0) AS fn, sum(n)::BIGINT AS pred_count, sum(g)::BIGINT AS gt_count FROM ids GROUP BY 1, 2),
set3d AS (SELECT k.scene, k.row_index, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn,
        coalesce(pred_count, 0) AS pred_count, coalesce(gt_count, 0) AS gt_count FROM @v_keys k LEFT JOIN per USING (scene, row_index))"""


@query(f"""WITH {SET3D_SQL}
    SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision,
        CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall,
        CASE WHEN tp > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1,
        pred_count - tp - fp AS duplicate_count, fp = 0 AND fn = 0 AND pred_count = tp AS exact,
        abs(pred_count - gt_count) AS cardinality_error FROM set3d""")
def anchor_set_metrics(spark, sf):
    out = pt.anchor_set_metrics(view(spark, sf, "v_keys"), view(spark, sf, "v_preds"), view(spark, sf, "v_gt_points"), anchors_of(spark, sf))
    return rounded(out, "precision", "recall", "f1")


@query()
def assign_min_cost(spark, sf):
    gt = gt_arrays(spark, sf).select(*st.KEY, F.inline("gt"))
    costs = pt._pair_costs(view(spark, sf, "v_preds"), gt, lambda d: d)
    out = pt.assign_min_cost(costs, max_gt(spark, sf))
    total = F.aggregate("pairs", F.lit(0.0), lambda s, p: s + p["cost"])
    return out.select(*st.KEY, "n_pred", "n_gt", F.size("pairs").alias("n_pairs"), F.round(total, 6).alias("total_cost"))


def margin_detail(spark, sf):
    return pt.margin_metrics(view(spark, sf, "v_keys"), view(spark, sf, "v_preds"), gt_arrays(spark, sf),
                             anchors_of(spark, sf), max_gt(spark, sf))


@query()
def margin_metrics(spark, sf):
    d = margin_detail(spark, sf).drop("margin_errors", "euclidean_errors")
    return rounded(d, "f1_0_5", "f1_1_0", "f1_2_0")


@query()
def scene_norm_error(spark, sf):
    out = pt.scene_norm_errors(view(spark, sf, "v_preds"), gt_arrays(spark, sf), anchors_of(spark, sf), max_gt(spark, sf))
    return out.select(*st.KEY, F.size("scene_norm_errors").alias("n"),
                      F.round(F.aggregate("scene_norm_errors", F.lit(0.0), lambda s, e: s + e), 6).alias("error_sum"))


@query()
def point_summary(spark, sf):
    sets = pt.anchor_set_metrics(view(spark, sf, "v_keys"), view(spark, sf, "v_preds"), view(spark, sf, "v_gt_points"), anchors_of(spark, sf))
    margins = margin_detail(spark, sf).drop("gt_count", "pred_count")
    norms = pt.scene_norm_errors(view(spark, sf, "v_preds"), gt_arrays(spark, sf), anchors_of(spark, sf), max_gt(spark, sf))
    detail = sets.join(margins, st.KEY).join(norms, st.KEY, "left").withColumn("parse_ok", F.col("pred_count") > 0)
    out = pt.point_summary(detail, ["scene"])
    return rounded(out, *[f.name for f in out.schema.fields if f.dataType.simpleString() == "double"])


def answers(spark, sf):
    rows = view(spark, sf, "v_answers").join(gt_arrays(spark, sf), st.KEY, "left")
    return rows.withColumn("point", geo.point("x", "y", "z")).withColumn("camera", geo.point("cam_x", "cam_y", "cam_z"))


ANGLE_SQL = f"""rays AS (
    SELECT a.*, g.anchor_id, g.gt_seq, a.x - cam_x AS px, a.y - cam_y AS py, a.z - cam_z AS pz,
        g.x - cam_x AS qx, g.y - cam_y AS qy, g.z - cam_z AS qz
    FROM @v_answers a JOIN @v_gt_points g ON a.scene = g.scene AND a.row_index = g.row_index),
angles AS (
    SELECT *, CASE WHEN np > 1e-9 AND nq > 1e-9 THEN degrees(acos(greatest(-1.0, least(1.0, (px * qx + py * qy + pz * qz) / (np * nq))))) END AS angle
    FROM (SELECT *, sqrt(px * px + py * py + pz * pz) AS np, sqrt(qx * qx + qy * qy + qz * qz) AS nq FROM rays)),
best AS (SELECT scene, row_index, angle, anchor_id FROM angles WHERE angle IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY scene, row_index ORDER BY angle, gt_seq) = 1),
directional AS (
    SELECT a.scene, a.row_index, CASE WHEN NOT parse_ok THEN 'parse_invalid' WHEN a.x IS NULL THEN 'missing_point'
        WHEN cam_x IS NULL THEN 'missing_camera' WHEN g.n IS NULL THEN 'missing_gt_anchors'
        WHEN b.angle IS NULL THEN 'degenerate_camera_or_gt_direction' ELSE '' END AS invalid_reason, b.angle, b.anchor_id
    FROM @v_answers a LEFT JOIN best b USING (scene, row_index)
    LEFT JOIN (SELECT scene, row_index, count(*) AS n FROM @v_gt_points GROUP BY 1, 2) g USING (scene, row_index))"""


@query(f"""WITH {ANGLE_SQL} SELECT scene, row_index, anchor_id, round(angle, 6) AS angle FROM angles WHERE angle IS NOT NULL""")
def angular_error(spark, sf):
    rows = answers(spark, sf).select(*st.KEY, "camera", "point", F.inline("gt"))
    rows = rows.toDF(*st.KEY, "camera", "pred", "gt_seq", "anchor_id", "truth")
    angle = geo.angular_error_deg("camera", "pred", "truth")
    return rows.select(*st.KEY, "anchor_id", F.round(angle, 6).alias("angle")).filter("angle IS NOT NULL")


@query(f"""WITH {ANGLE_SQL} SELECT scene, row_index, invalid_reason, CASE WHEN invalid_reason = '' THEN anchor_id END AS matched_id,
    CASE WHEN invalid_reason = '' THEN round(angle, 6) END AS angle_deg FROM directional""")
def directional_match(spark, sf):
    out = pt.directional_match(answers(spark, sf))
    return out.select(*st.KEY, "invalid_reason", "matched_id", F.round("angle_deg", 6).alias("angle_deg"))


ACC_SQL = "count(*) AS total, count(e) AS valid, round(count(e) / count(*), 6) AS valid_rate, round(avg(e), 6) AS mean_error_deg, round(quantile_cont(e, 0.5), 6) AS median_error_deg, " + ", ".join(
    f"round(count(*) FILTER (e <= {t}) / count(*), 6) AS acc_at_{t}_all, CASE WHEN count(e) > 0 THEN round(count(*) FILTER (e <= {t}) / count(e), 6) ELSE 0 END AS acc_at_{t}_valid"
    for t in (5, 10, 15, 20, 30))


def accuracy(spark, sf):
    out = pt.angular_accuracy(pt.directional_match(answers(spark, sf)), ["scene"])
    return rounded(out, *[f.name for f in out.schema.fields if f.dataType.simpleString() == "double"])


@query(f"""WITH {ANGLE_SQL} SELECT scene, {ACC_SQL} FROM (
    SELECT scene, CASE WHEN invalid_reason = '' THEN angle END AS e FROM directional) GROUP BY 1""")
def angular_accuracy(spark, sf):
    return accuracy(spark, sf)


@query(f"""WITH {ANGLE_SQL}, s AS (SELECT scene, {ACC_SQL} FROM (
        SELECT scene, CASE WHEN invalid_reason = '' THEN angle END AS e FROM directional) GROUP BY 1)
    SELECT scene, valid_rate >= 0.98 AS valid_rate_ok, median_error_deg <= 15 AS median_ok, acc_at_20_all >= 0.6 AS acc20_ok,
        coalesce(valid_rate >= 0.98 AND median_error_deg <= 15 AND acc_at_20_all >= 0.6, false) AS accepted FROM s""")
def acceptance_gates(spark, sf):
    return au.acceptance_gates(accuracy(spark, sf)).select("scene", "valid_rate_ok", "median_ok", "acc20_ok", "accepted")


@query(f"""WITH {ANGLE_SQL}, e AS (SELECT scene, row_index, round(angle, 6) AS angle_deg FROM directional WHERE invalid_reason = '')
    (SELECT *, 'lowest' AS side FROM e ORDER BY angle_deg, scene, row_index LIMIT 6)
    UNION ALL (SELECT *, 'highest' FROM e ORDER BY angle_deg DESC, scene, row_index LIMIT 6)""")
def error_extremes(spark, sf):
    out = pt.directional_match(answers(spark, sf)).select(*st.KEY, F.round("angle_deg", 6).alias("angle_deg"))
    return ag.error_extremes(out, "angle_deg")


@query("""WITH r AS (SELECT scene, row_index, o_totalprice, row_number() OVER (ORDER BY o_totalprice, scene, row_index) AS rank,
        count(*) OVER () AS n FROM @v_keys)
    SELECT q AS quantile, scene, row_index, o_totalprice, rank FROM r
    JOIN (SELECT unnest([0.1, 0.5, 0.9, 0.99, 1.0])::DOUBLE AS q) ON rank = floor((n - 1) * q) + 1""")
def quantile_rows(spark, sf):
    keys = view(spark, sf, "v_keys").select(*st.KEY, "o_totalprice")
    out = ag.quantile_rows(keys, "o_totalprice", (0.1, 0.5, 0.9, 0.99, 1.0))
    return out.select("quantile", *st.KEY, "o_totalprice", "rank")


@query("""SELECT scene, row_index, anchor_id, min(gt_seq) AS gt_seq, round(arg_min(x, gt_seq), 6) AS x, round(arg_min(y, gt_seq), 6) AS y,
        round(arg_min(z, gt_seq), 6) AS z
    FROM (SELECT g.scene, g.row_index, g.gt_seq, g.label AS anchor_id, a.x, a.y, a.z FROM @v_gt g LEFT JOIN @v_anchors a
        ON g.scene = a.scene AND g.label = a.anchor_id) WHERE x IS NOT NULL
    GROUP BY scene, row_index, anchor_id, round(x, 6), round(y, 6), round(z, 6)""")
def distinct_gt_points(spark, sf):
    anchors = anchors_of(spark, sf).withColumnRenamed("anchor_id", "label").drop("anchor_seq")
    rows = view(spark, sf, "v_gt").join(anchors, ["scene", "label"], "left").withColumnRenamed("label", "anchor_id")
    return rounded(pt.distinct_gt_points(rows), "x", "y", "z").select(*st.KEY, "anchor_id", "gt_seq", "x", "y", "z")
