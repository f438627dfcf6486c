"""Projected-2D grounding: layout, coordinates, matching, panel choice, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundmetrics.operators import panels as pn
from groundmetrics.operators import timeline as tl
from groundmetrics.operators.scale import by_keys, nearest_sample
from groundmetrics.operators.sets import KEY
from groundmetrics.plans import timeline as tq
from groundmetrics.plans.closed_set import rounded
from groundmetrics.plans.points3d import gt_arrays
from groundmetrics.plans.views import by_order, registry, view

query, QUERIES, ORACLES = registry()


def manifest(spark, sf):
    """Manifest rows with the gaze-to-anchor pixel distance and the evidence rank; line items are dealt by order, nothing after that moves."""
    m = view(spark, sf, "v_manifest", by_order(spark, sf))
    m = m.withColumn("video_time", F.col("video_time").cast("double"))
    dist = F.hypot((F.col("gt_u") - F.col("gaze_u")) * 1280.0, (F.col("gt_v") - F.col("gaze_v")) * 720.0)
    return pn.evidence_rank(m.withColumn("gaze_anchor_distance_px", F.round(dist, 2)), [*KEY, "referent"], 1)


RANK_SQL = """ranked AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY scene, row_index, referent, ok ORDER BY dist, panel_index, manifest_seq) END AS r FROM (
    SELECT *, projection_valid AND gaze_projection_valid AS ok,
        round(sqrt(((gt_u - gaze_u) * 1280) ** 2 + ((gt_v - gaze_v) * 720) ** 2), 2) AS dist FROM @v_manifest))"""


@query(f"""WITH {RANK_SQL} SELECT scene, row_index, referent, count(*) AS n_rows, count(r) AS n_ranked,
    count(*) FILTER (r <= 1) AS n_acceptable, round(min(dist) FILTER (r = 1), 1) AS best_px FROM ranked GROUP BY 1, 2, 3""")
def evidence_rank(spark, sf):
    m = manifest(spark, sf)
    return m.groupBy(*KEY, "referent").agg(
        F.count("*").alias("n_rows"), F.count("evidence_rank").alias("n_ranked"), F.count_if("evidence_acceptable").alias("n_acceptable"),
        F.round(F.min(F.when(F.col("evidence_rank") == 1, F.col("gaze_anchor_distance_px"))), 1).alias("best_px"),
    )


LAYOUT_SQL = """layout AS (SELECT scene, row_index, panel_id, CAST(p AS INTEGER) AS position, 12 + p % 2 * 492 AS x0, 12 + p // 2 * 314 AS y0,
        996::BIGINT AS sheet_w, CAST(ceil(n / 2) * 302 + (ceil(n / 2) + 1) * 12 AS BIGINT) AS sheet_h
    FROM (SELECT *, row_number() OVER (PARTITION BY scene, row_index ORDER BY panel_id) - 1 AS p, count(*) OVER (PARTITION BY scene, row_index) AS n
        FROM (SELECT DISTINCT scene, row_index, panel_id FROM @v_manifest WHERE frame_extracted)))"""


def layout_of(spark, sf):
    return pn.sheet_layout(view(spark, sf, "v_manifest").filter("frame_extracted"), columns=2)


@query(f"WITH {LAYOUT_SQL} SELECT * FROM layout")
def sheet_layout(spark, sf):
    return layout_of(spark, sf)


META_SQL = """meta AS (SELECT scene, row_index, panel_id, bool_or(frame_extracted) AS panel_known, min(gaze_u) * 0.5 AS l, min(gaze_v) * 0.5 AS t,
    max(gaze_u) * 0.4 + 0.55 AS r, max(gaze_v) * 0.4 + 0.55 AS b, max(panel_score) > 0.3 AS canvas FROM @v_manifest GROUP BY 1, 2, 3)"""


@query(f"""WITH {META_SQL}, j AS (
    SELECT p.*, m.l, m.t, m.r, m.b, coalesce(panel_known, false) AS known, CASE WHEN canvas THEN 0.6 END AS fe,
        CASE p.coordinate_space WHEN 'Gaze Crop' THEN 'gaze_crop' WHEN 'full-panel' THEN 'full_panel' ELSE '' END AS space
    FROM @v_refs2d p LEFT JOIN meta m ON p.scene = m.scene AND p.row_index = m.row_index AND p.pred_panel = m.panel_id),
    k AS (SELECT *, CASE WHEN known AND space = '' AND fe IS NOT NULL AND x_norm <= fe THEN 'paired_canvas_left_to_full_panel'
        WHEN known AND space = '' AND fe IS NOT NULL AND x_norm >= 0.62 THEN 'paired_canvas_right_crop_to_full_panel'
        WHEN known AND space = 'gaze_crop' THEN 'gaze_crop_to_full_panel' ELSE 'none' END AS tr FROM j)
    SELECT scene, row_index, pred_seq, tr AS coordinate_transform,
        round(CASE tr WHEN 'none' THEN x_norm WHEN 'paired_canvas_left_to_full_panel' THEN x_norm / fe
            WHEN 'gaze_crop_to_full_panel' THEN least(1, l + x_norm * (r - l)) ELSE least(1, l + (x_norm - 0.62) / 0.38 * (r - l)) END, 6) AS x_norm,
        round(CASE WHEN tr IN ('none', 'paired_canvas_left_to_full_panel') THEN y_norm ELSE least(1, t + y_norm * (b - t)) END, 6) AS y_norm FROM k""")
def map_coordinates(spark, sf):
    m = view(spark, sf, "v_manifest")
    meta = m.groupBy(*KEY, "panel_id").agg(
        F.bool_or("frame_extracted").alias("panel_known"), (F.min("gaze_u") * 0.5).alias("left"), (F.min("gaze_v") * 0.5).alias("top"),
        (F.max("gaze_u") * 0.4 + 0.55).alias("right"), (F.max("gaze_v") * 0.4 + 0.55).alias("bottom"),
        F.when(F.max("panel_score") > 0.3, 0.6).alias("full_end"), F.when(F.max("panel_score") > 0.3, 0.62).alias("crop_start"),
    )
    preds = view(spark, sf, "v_refs2d").withColumnRenamed("pred_panel", "panel_id")
    out = pn.map_coordinates(preds, meta, "auto")
    return rounded(out, "x_norm", "y_norm").select(*KEY, "pred_seq", "coordinate_transform", "x_norm", "y_norm")


GT2D_SQL = f"""{RANK_SQL}, gt2d AS (SELECT * FROM ranked WHERE projection_valid
    QUALIFY row_number() OVER (PARTITION BY scene, row_index, panel_id, referent ORDER BY manifest_seq) = 1)"""


@query(f"""WITH {GT2D_SQL}, {LAYOUT_SQL},
    g AS (SELECT gt2d.*, l.x0 + gt_u * 480 AS sx, l.y0 + gt_v * 270 AS sy FROM gt2d JOIN layout l USING (scene, row_index, panel_id)),
    p AS (SELECT r.*, coalesce(sheet_x_norm * sheet_w, x0 + x_norm * 480) AS px, coalesce(sheet_y_norm * sheet_h, y0 + y_norm * 270) AS py
        FROM @v_refs2d r LEFT JOIN layout l ON r.scene = l.scene AND r.row_index = l.row_index AND r.pred_panel = l.panel_id),
    d AS (SELECT p.scene, p.row_index, p.pred_seq,
        CASE WHEN pred_panel = panel_id THEN sqrt(((x_norm - gt_u) * 1280) ** 2 + ((y_norm - gt_v) * 720) ** 2) END AS dp,
        sqrt((px - sx) ** 2 + (py - sy) ** 2) AS ds, sheet_x_norm IS NULL AS no_sheet FROM p JOIN g ON p.scene = g.scene AND p.row_index = g.row_index)
    SELECT scene, row_index, pred_seq, round(min(dp), 6) AS panel_px, round(min(ds), 6) AS sheet_px,
        round(min(CASE WHEN no_sheet THEN dp ELSE ds END), 6) AS auto_px FROM d GROUP BY 1, 2, 3""")
def point_distance(spark, sf):
    lists = pn.boards(manifest(spark, sf), F.col("frame_extracted"), False, columns=2).filter(F.size("_g") > 0)
    preds = view(spark, sf, "v_refs2d", by_order(spark, sf)).select(*KEY, "pred_seq", "pred_panel", "x_norm", "y_norm", "sheet_x_norm", "sheet_y_norm")
    near = pn.with_sheet_points(pn.beside(lists, preds, "inner"), columns=2)
    out = pn.point_distances(near)
    return rounded(out, "panel_px", "sheet_px", "auto_px")


@query(f"""WITH {GT2D_SQL}
    SELECT p.scene, p.row_index, round(min(sqrt(((x_norm - gt_u) * 1280) ** 2 + ((y_norm - gt_v) * 720) ** 2)), 6) AS min_distance_px
    FROM @v_refs2d p JOIN gt2d g ON p.scene = g.scene AND p.row_index = g.row_index AND p.pred_panel = g.panel_id GROUP BY 1, 2""")
def min_point_distance(spark, sf):
    out = pn.min_distance(view(spark, sf, "v_refs2d"), pn.distinct_gt(manifest(spark, sf)))
    return rounded(out, "min_distance_px")


FAMILY_COLUMNS = [f"{n}_{c}" for n in pn.match_names() for c in ("tp", "fp", "fn")]


def fold_sql(modes: str, pairs: str) -> str:
    """The greedy walk as a recursive query. Expects ``keys``, ``p`` (predictions with rank ``k``) and ``g`` (GT points); ``pairs`` is the
    distance of p and g in mode m.mode. Gives ``last``: taken referents and summed distance per interaction, mode and family."""
    return f"""
    modes AS (SELECT unnest({modes}) AS mode),
    fam(fam, lim, joint, by_order) AS (VALUES ('time', 0.0, true, true), {", ".join(f"('{k}_{int(t)}', {t}, {str(k == 'joint').lower()}, false)" for k in ("point", "joint") for t in pn.THRESHOLDS)}),
    d AS (SELECT p.scene, p.row_index, p.k, m.mode, {pairs} AS d, g.manifest_seq AS seq, g.referent, coalesce(g.r <= 1, false) AS ok,
            p.label <> '' AND p.label = g.label AS named, p.pred_panel = g.panel_id AS here
        FROM p JOIN g USING (scene, row_index), modes m),
    q AS (SELECT scene, row_index, mode, k,
            coalesce(list(struct_pack(d := d, referent := referent, ok := ok, named := named) ORDER BY d, seq) FILTER (d IS NOT NULL), []) AS near,
            coalesce(list(struct_pack(d := 0.0::DOUBLE, referent := referent, ok := ok, named := named) ORDER BY seq) FILTER (here), []) AS inside,
            coalesce(list(struct_pack(referent := referent, ok := ok)) FILTER (named), []) AS names, min(d) AS min_px FROM d GROUP BY 1, 2, 3, 4),
    qk AS (SELECT *, row_number() OVER (PARTITION BY scene, row_index, mode ORDER BY k) AS i FROM q),
    st AS (SELECT scene, row_index, mode, fam, lim, joint, by_order, 0::BIGINT AS i, []::VARCHAR[] AS taken, 0.0::DOUBLE AS dist FROM keys, modes, fam
        UNION ALL
        SELECT scene, row_index, mode, fam, lim, joint, by_order, i, CASE WHEN b IS NULL THEN taken ELSE list_append(taken, b.referent) END, dist + coalesce(b.d, 0)
        FROM (SELECT s.*, CASE WHEN best.d <= s.lim THEN best END AS b FROM (
            SELECT s.scene, s.row_index, s.mode, s.fam, s.lim, s.joint, s.by_order, qk.i, s.taken, s.dist,
                list_filter(CASE WHEN s.by_order THEN qk.inside ELSE qk.near END, lambda c: (NOT s.joint OR c.ok) AND NOT list_contains(s.taken, c.referent)
                    AND (c.named OR len(list_filter(qk.names, lambda n: (NOT s.joint OR n.ok) AND NOT list_contains(s.taken, n.referent))) = 0))[1] AS best
            FROM st s JOIN qk ON s.scene = qk.scene AND s.row_index = qk.row_index AND s.mode = qk.mode AND qk.i = s.i + 1) s)),
    last AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY scene, row_index, mode, fam ORDER BY i DESC) = 1),
    total AS (SELECT scene, row_index, count(DISTINCT referent) AS n_any, count(DISTINCT referent) FILTER (coalesce(r <= 1, false)) AS n_ok FROM g GROUP BY 1, 2),
    said AS (SELECT scene, row_index, count(*) AS n FROM p GROUP BY 1, 2),
    least AS (SELECT scene, row_index, mode, min(min_px) AS px FROM q GROUP BY 1, 2, 3),
    res AS (SELECT l.*, len(l.taken) AS tp, coalesce(n, 0) - len(l.taken) AS fp, greatest(coalesce(CASE WHEN joint THEN n_ok ELSE n_any END, 0) - len(l.taken), 0) AS fn,
            coalesce(n, 0) AS n, coalesce(n_any, 0) AS n_any, coalesce(n_ok, 0) AS n_ok, px
        FROM last l LEFT JOIN total USING (scene, row_index) LEFT JOIN said USING (scene, row_index) LEFT JOIN least USING (scene, row_index, mode))"""


PANEL_PX = "CASE WHEN p.pred_panel = g.panel_id THEN sqrt(((p.x_norm - g.gt_u) * 1280) ** 2 + ((p.y_norm - g.gt_v) * 720) ** 2) END"
LABEL_SQL = r"regexp_replace(lower(trim({})), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def wide(columns: list[str]) -> str:
    """One column per metric family and count out of ``res``."""
    return ", ".join(f"max({c.rsplit('_', 1)[1]}) FILTER (fam = '{c.rsplit('_', 1)[0]}') AS {c}" for c in columns)


MATCH_SQL = f"""WITH RECURSIVE {GT2D_SQL}, keys AS (SELECT scene, row_index FROM @v_keys),
    g AS (SELECT *, {LABEL_SQL.format("referent")} AS label FROM gt2d),
    p AS (SELECT *, {LABEL_SQL.format("coalesce(mention, '')")} AS label, row_number() OVER (PARTITION BY scene, row_index ORDER BY pred_seq) AS k FROM @v_refs2d),
    {fold_sql("['panel']", PANEL_PX)}"""


def totals_sql(by: str) -> str:
    """Sums per group with the ratios of every family, and mean matched distances at 100 px."""
    div = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / ({b})::DOUBLE ELSE 0 END"
    cols = []
    for n in pn.match_names():
        tp, fp, fn = f"{n}_tp", f"{n}_fp", f"{n}_fn"
        cols += [tp, fp, fn, f"round({div(tp, f'({tp} + {fp})')}, 6) AS {n}_precision", f"round({div(tp, f'({tp} + {fn})')}, 6) AS {n}_recall",
                 f"round({div(f'2 * {tp}', f'(2 * {tp} + {fp} + {fn})')}, 6) AS {n}_f1"]
    cols += [f"round({div(f'{k}_100_dist', f'{k}_100_tp')}, 6) AS mean_{k}_distance_px_100" for k in ("point", "joint")]
    sums = ", ".join(f"CAST(sum({c}) FILTER (fam = '{n}') AS BIGINT) AS {n}_{c}" for n in pn.match_names() for c in ("tp", "fp", "fn"))
    dist = ", ".join(f"sum(dist) FILTER (fam = '{k}_100') AS {k}_100_dist" for k in ("point", "joint"))
    return f"SELECT {by}, events, {', '.join(cols)} FROM (SELECT {by}, count(*) FILTER (fam = 'time') AS events, {sums}, {dist} FROM res GROUP BY {by})"


def match_detail(spark, sf):
    by = by_order(spark, sf)
    return pn.greedy_match(view(spark, sf, "v_keys", by), view(spark, sf, "v_refs2d", by), pn.distinct_gt(manifest(spark, sf)))


@query(f"{MATCH_SQL} SELECT scene, row_index, {wide([c for c in FAMILY_COLUMNS if not c.startswith('time')])} FROM res GROUP BY 1, 2")
def greedy_match(spark, sf):
    d = match_detail(spark, sf)
    names = [n for n in pn.match_names() if n != "time"]
    return d.select(*KEY, *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in names for c in ("tp", "fp", "fn")])


@query(f"{MATCH_SQL} SELECT scene, row_index, {wide([c for c in FAMILY_COLUMNS if c.startswith('time')])} FROM res GROUP BY 1, 2")
def greedy_time_match(spark, sf):
    return match_detail(spark, sf).select(*KEY, *[F.col(f"time.{c}").alias(f"time_{c}") for c in ("tp", "fp", "fn")])


@query(f"{MATCH_SQL} {totals_sql('scene')}")
def summary_2d(spark, sf):
    out = pn.summary_2d(match_detail(spark, sf), ["scene"])
    return rounded(out, *[f.name for f in out.schema.fields if f.dataType.simpleString() == "double"])


SPACE_PX = f"""CASE WHEN m.mode = 'panel' OR m.mode = 'auto' AND (p.sheet_x_norm IS NULL OR p.sheet_y_norm IS NULL) THEN {PANEL_PX}
    ELSE sqrt((p.px - g.sx) ** 2 + (p.py - g.sy) ** 2) END"""
RUN_SQL = f"""WITH RECURSIVE {GT2D_SQL}, keys AS (SELECT DISTINCT scene, row_index FROM @v_manifest),
    pan AS (SELECT scene, row_index, panel_id, bool_or(frame_extracted) AS has FROM @v_manifest GROUP BY 1, 2, 3),
    pos AS (SELECT *, row_number() OVER (PARTITION BY scene, row_index ORDER BY panel_id) - 1 AS i, count(*) OVER (PARTITION BY scene, row_index) AS n
        FROM (SELECT *, bool_or(has) OVER (PARTITION BY scene, row_index) AS any_has FROM pan) WHERE has OR NOT any_has),
    lay AS (SELECT scene, row_index, panel_id, 12 + i % 4 * 492 AS x0, 12 + i // 4 * 314 AS y0, 1980 AS sw, ceil(n / 4) * 302 + (ceil(n / 4) + 1) * 12 AS sh FROM pos),
    size AS (SELECT scene, row_index, max(sw) AS sw, max(sh) AS sh FROM lay GROUP BY 1, 2),
    g AS (SELECT gt2d.*, {LABEL_SQL.format("referent")} AS label, x0 + gt_u * 480 AS sx, y0 + gt_v * 270 AS sy FROM gt2d JOIN lay USING (scene, row_index, panel_id)),
    named AS (SELECT scene, row_index, pred_seq, {LABEL_SQL.format("coalesce(mention, '')")} AS label,
            CASE WHEN upper(trim(pred_panel)) LIKE 'P%' THEN upper(trim(pred_panel)) ELSE 'P' || upper(trim(pred_panel)) END AS pred_panel,
            {", ".join(f"CASE WHEN {c} BETWEEN 0 AND 1 THEN {c} END AS {c}" for c in ("x_norm", "y_norm", "sheet_x_norm", "sheet_y_norm"))}
        FROM @v_answers2d WHERE trim(pred_panel) <> ''),
    p AS (SELECT a.*, row_number() OVER (PARTITION BY scene, row_index ORDER BY pred_seq) AS k,
            CASE WHEN sheet_x_norm IS NOT NULL AND sheet_y_norm IS NOT NULL THEN sheet_x_norm * size.sw WHEN x_norm IS NOT NULL AND y_norm IS NOT NULL THEN x0 + x_norm * 480 END AS px,
            CASE WHEN sheet_x_norm IS NOT NULL AND sheet_y_norm IS NOT NULL THEN sheet_y_norm * size.sh WHEN x_norm IS NOT NULL AND y_norm IS NOT NULL THEN y0 + y_norm * 270 END AS py
        FROM named a JOIN size USING (scene, row_index) LEFT JOIN lay l ON l.scene = a.scene AND l.row_index = a.row_index AND l.panel_id = a.pred_panel),
    {fold_sql("['panel', 'sheet', 'auto']", SPACE_PX)}"""

def runs_2d(spark, sf):
    """The three coordinate modes over the same manifest and answers."""
    m, answers = manifest(spark, sf), view(spark, sf, "v_answers2d", by_order(spark, sf))
    return pn.evaluate_2d(m, answers, ("panel", "sheet", "auto"))


@query(f"""{RUN_SQL} SELECT scene, row_index, mode, max(n_any) AS gt_referent_count, max(n_ok) AS time_evaluable_referent_count, max(n) AS prediction_count,
    {wide(FAMILY_COLUMNS)}, round(max(px), 4) AS min_point_distance_px FROM res GROUP BY 1, 2, 3""")
def evaluate_2d(spark, sf):
    flat = [F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in pn.match_names() for c in ("tp", "fp", "fn")]
    return runs_2d(spark, sf).select(*KEY, "mode", "gt_referent_count", "time_evaluable_referent_count", "prediction_count", *flat, F.round("min_point_distance_px", 4).alias("min_point_distance_px"))


@query(f"{RUN_SQL} {totals_sql('scene, mode')}")
def evaluate_2d_summary(spark, sf):
    out = pn.summary_2d(runs_2d(spark, sf), ["scene", "mode"])
    return rounded(out, *[f.name for f in out.schema.fields if f.dataType.simpleString() == "double"])


@query("""WITH one AS (SELECT * FROM @v_manifest WHERE frame_extracted
        QUALIFY row_number() OVER (PARTITION BY scene, row_index, panel_id ORDER BY panel_index, video_time, manifest_seq) = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY scene, row_index ORDER BY panel_index) AS i, count(*) OVER (PARTITION BY scene, row_index) AS c FROM one)
    SELECT scene, row_index, 'first' AS strategy, panel_id FROM n WHERE i = 1 UNION ALL
    SELECT scene, row_index, 'middle', panel_id FROM n WHERE i = c // 2 + 1 UNION ALL
    SELECT scene, row_index, 'highest_score', arg_min(panel_id, panel_index) FROM (
        SELECT *, max(panel_score) OVER (PARTITION BY scene, row_index) AS top FROM one) WHERE panel_score = top GROUP BY 1, 2""")
def choose_panel(spark, sf):
    m = view(spark, sf, "v_manifest", by_order(spark, sf)).filter("frame_extracted")
    # the reference order of equal (panel, time) rows is the manifest order
    return pn.choose_panels(m.withColumn("video_time", F.struct("video_time", "manifest_seq")))


@query("""WITH v AS (SELECT scene, row_index, pred_panel, count(*) AS votes, min(pred_seq) AS first_seq, arg_min(mention, pred_seq) AS first_mention
        FROM @v_refs2d GROUP BY 1, 2, 3)
    SELECT 'first' AS policy, * FROM v QUALIFY row_number() OVER (PARTITION BY scene, row_index ORDER BY first_seq) = 1
    UNION ALL SELECT 'majority', * FROM v QUALIFY row_number() OVER (PARTITION BY scene, row_index ORDER BY votes DESC, first_seq) = 1
    UNION ALL SELECT 'all_unique', * FROM v""")
def panel_vote(spark, sf):
    items = view(spark, sf, "v_refs2d")
    cols = [*KEY, "pred_panel", "votes", "first_seq", "first_mention"]
    parts = [pn.panel_vote(items, p).select(F.lit(p).alias("policy"), *cols) for p in ("first", "majority", "all_unique")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


DET = """SELECT scene, row_index, pred_seq, d AS det_seq, ((price + 41 * d) % 10) / 10 AS det_score, ((price * 3 + 211 * d) % 900) AS x1,
    ((price * 7 + 97 * d) % 500) AS y1, ((price * 3 + 211 * d) % 900) + 40 + price % 300 AS x2, ((price * 7 + 97 * d) % 500) + 30 + price % 180 AS y2
    FROM @v_refs2d, (SELECT 1 AS d UNION ALL SELECT 2) k WHERE price % 9 >= 1"""


@query(f"""WITH pan AS (SELECT scene, row_index, panel_id, 1280.0::DOUBLE AS w, 720.0::DOUBLE AS h FROM @v_manifest WHERE frame_extracted GROUP BY 1, 2, 3),
    r AS (SELECT p.*, pan.w, pan.h FROM @v_refs2d p LEFT JOIN pan ON p.scene = pan.scene AND p.row_index = pan.row_index AND p.pred_panel = pan.panel_id),
    d AS ({DET}),
    c AS (SELECT r.*, det_seq, det_score, x1, y1, x2, y2, det_score - 0.5 * coalesce(sqrt(((x1 + x2) / 2 - x_norm * w) ** 2 + ((y1 + y2) / 2 - y_norm * h) ** 2)
            / sqrt(w * w + h * h), 0) AS val, count(det_seq) OVER (PARTITION BY r.scene, r.row_index, r.pred_seq) AS n_boxes
        FROM r LEFT JOIN d ON r.scene = d.scene AND r.row_index = d.row_index AND r.pred_seq = d.pred_seq),
    best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY scene, row_index, pred_seq ORDER BY val DESC NULLS LAST, det_seq) = 1),
    s AS (SELECT *, CASE WHEN w IS NULL THEN 'missing_panel_frame' WHEN det_seq IS NULL THEN 'no_box' ELSE 'detected' END AS box_status FROM best)
    SELECT scene, row_index, pred_seq, pred_panel, n_boxes, box_status,
        round(CASE WHEN box_status = 'detected' THEN least(1, greatest(0, greatest(x1, least(x2, x_norm * w)) / w)) ELSE x_norm END, 11) AS x_norm,
        round(CASE WHEN box_status = 'detected' THEN least(1, greatest(0, greatest(y1, least(y2, y_norm * h)) / h)) ELSE y_norm END, 11) AS y_norm,
        round(CASE WHEN box_status = 'detected' THEN det_score END, 11) AS det_score FROM s""")
def refine_boxes(spark, sf):
    out = pn.refine_with_boxes(view(spark, sf, "v_refs2d"), view(spark, sf, "v_manifest"), view(spark, sf, DET))
    return rounded(out, "x_norm", "y_norm", "det_score", digits=11)


UNIFORM_SQL = """panels AS (SELECT e.*, i + 1 AS panel_index, t_start + CAST(round((t_end - t_start) / 1000000 * i / 2.0::DOUBLE * 1000000) AS BIGINT) AS target_us
    FROM @v_events e, (SELECT unnest([0, 1, 2]) AS i)),
picked AS (SELECT p.scene, p.row_index, p.day, p.panel_index, s.t_us, s.* EXCLUDE (scene, row_index, day, t_us) FROM panels p
    JOIN @v_samples s ON p.scene = s.scene AND p.row_index = s.row_index
    QUALIFY row_number() OVER (PARTITION BY p.scene, p.row_index, p.day, p.panel_index ORDER BY abs(s.t_us - p.target_us), s.t_us, s.file_seq) = 1)"""
AU, AV = (s.replace("az", "a.z").replace("ax", "a.x").replace("ay", "a.y") for s in tq.uv_sql("a"))


@query(f"""WITH {UNIFORM_SQL},
    refs AS (SELECT DISTINCT scene, row_index, label AS referent FROM @v_gt),
    j AS (SELECT k.scene, k.row_index, k.day, k.panel_index, r.referent, k.t_us, a.anchor_id,
        CASE WHEN a.z - cz > 1e-6 AND {AU} BETWEEN 0 AND 1 AND {AV} BETWEEN 0 AND 1 THEN {AU} END AS u,
        CASE WHEN a.z - cz > 1e-6 AND {AU} BETWEEN 0 AND 1 AND {AV} BETWEEN 0 AND 1 THEN {AV} END AS v,
        CASE WHEN eye_open AND {tq.on_image('g')} THEN {tq.uv_sql('g')[0]} END AS gu, CASE WHEN eye_open AND {tq.on_image('g')} THEN {tq.uv_sql('g')[1]} END AS gv
        FROM picked k LEFT JOIN refs r USING (scene, row_index) LEFT JOIN @v_anchors a ON a.scene = k.scene AND a.anchor_id = r.referent),
    s AS (SELECT *, CASE WHEN referent IS NULL THEN 'missing_gt_referents' WHEN anchor_id IS NULL THEN 'missing_anchor' WHEN u IS NULL THEN 'projection_invalid'
        ELSE 'point_evaluable' END AS status, u IS NOT NULL AND gu IS NOT NULL AS ok, round(sqrt(((u - gu) * 1280) ** 2 + ((v - gv) * 720) ** 2), 2) AS px FROM j)
    SELECT scene, row_index, day, CAST(panel_index AS INTEGER) AS panel_index, referent, t_us, status, u IS NOT NULL AS projection_valid,
        CASE WHEN ok THEN CAST(row_number() OVER (PARTITION BY scene, row_index, day, referent, ok ORDER BY px, panel_index) AS INTEGER) END AS evidence_rank FROM s""")
def panel_manifest(spark, sf):
    ev = tq.events(spark, sf)
    grid = tl.uniform_grid(F.lit(0.0), (F.col("t_end") - F.col("t_start")) / tl.US, 3)
    at = tl.explode_grid(ev, grid, "offset").withColumn("panel_index", F.col("grid_index") + 1)
    at = at.withColumn("target_us", F.col("t_start") + F.round(F.col("offset") * tl.US).cast("bigint"))
    s = tl.cue_columns(tq.samples(spark, sf))
    near = nearest_sample(at.select(*tq.EVENT, "panel_index", "target_us"), s, KEY, "target_us", "t_us", "file_seq",
                          ["file_seq", "gaze", "cameraPosition", "cameraRotation", "cameraFOV"], tq.SLICE,
                          ev.select(*KEY, F.lit(3).alias("n")))
    # dealt by interaction as the panels are, so that neither the distinct referents nor the join and the ranks move them again
    refs = by_keys(view(spark, sf, "v_gt").select(*KEY, F.col("label").alias("referent")), KEY, s).distinct()
    out = pn.panel_manifest(near, refs, view(spark, sf, "v_anchors"), tq.EVENT, tq.W, tq.H)
    return out.select(*tq.EVENT, "panel_index", "referent", "t_us", "status", "projection_valid", "evidence_rank")


@query(f"""WITH {tq.SELECT_SQL} SELECT e.scene, e.row_index, e.day, CAST(panel_index AS INTEGER) AS panel_index, t_us, round(score, 6) AS score, gaze_valid, hand_valid
    FROM evidence e WHERE EXISTS (SELECT 1 FROM @v_gt_points g WHERE g.scene = e.scene AND g.row_index = e.row_index)""")
def evidence_manifest(spark, sf):
    facing, _hidden = pn.evidence_manifest(tq.evidence(spark, sf), gt_arrays(spark, sf))
    return facing.select(*tq.EVENT, "panel_index", "t_us", F.round("score", 6).alias("score"), "gaze_valid", "hand_valid")
