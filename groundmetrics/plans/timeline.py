"""Telemetry: relative time, grids, as-of and interval joins, evidence selection, segments, hand boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundmetrics.functions import cues
from groundmetrics.functions import geometry as geo
from groundmetrics.functions import text as tx
from groundmetrics.operators import baselines as bl
from groundmetrics.operators import timeline as tl
from groundmetrics.operators.scale import nearest_sample
from groundmetrics.operators.sets import KEY
from groundmetrics.plans.closed_set import rounded
from groundmetrics.plans.views import HOUR_US, registry, view

query, QUERIES, ORACLES = registry()

EVENT = [*KEY, "day"]
STEP_S = 3600.0
WINDOW = 6 * HOUR_US
GAP = 2 * HOUR_US
SLICE = HOUR_US // 6
W, H = 1280, 720


def samples(spark, sf):
    """Telemetry in its nested shape."""
    point = lambda x, y, z: F.struct(*[F.col(c).alias(a) if isinstance(c, str) else c.alias(a) for c, a in zip((x, y, z), "xyz")])
    joints = F.array(
        F.struct(F.lit(8).alias("id"), point(F.col("hx") - 0.04, "hy", "hz").alias("position")),
        F.struct(F.lit(9).alias("id"), point(F.col("hx") + 0.04, "hy", "hz").alias("position")),
    )
    none = F.lit(None).cast("struct<joints:array<struct<id:int,position:struct<x:double,y:double,z:double>>>>")
    return view(spark, sf, "v_samples").select(
        *KEY, "day", "file_seq", "t_us", "event_type",
        point("cx", "cy", "cz").alias("cameraPosition"),
        F.struct(*[F.lit(v).alias(a) for v, a in zip((0.0, 0.0, 0.0, 1.0), "xyzw")]).alias("cameraRotation"),
        F.lit(90.0).alias("cameraFOV"),
        F.struct(
            F.col("eye_open").alias("isEyeOpen"), point("gx", "gy", "gz").alias("gazePoint"), point("cx", "cy", "cz").alias("gazeOrigin"),
            F.lit(None).cast("struct<x:double,y:double,z:double>").alias("gazeVector"),
            point("gx", "gy", F.col("gz") + 9.0).alias("cameraHitPoint"),
        ).alias("eyeGaze"),
        F.struct(
            F.lit(False).alias("isLeftHandTracked"), F.col("hand_tracked").alias("isRightHandTracked"), none.alias("leftHand"),
            F.struct(joints.alias("joints")).alias("rightHand"), point("hx", "hy", "hz").alias("rightIndexFingerRayHitPoint"),
        ).alias("handData"),
    )


def events(spark, sf):
    return view(spark, sf, "v_events").drop("n_samples")


@query("""SELECT scene, row_index, file_seq, (t_us - min(t_us) OVER w) / 1000000 AS t_rel,
        min(day) OVER w <> max(day) OVER w AS cross_day FROM @v_samples WINDOW w AS (PARTITION BY scene, row_index)""")
def relative_time(spark, sf):
    return tl.relative_time(view(spark, sf, "v_samples").select(*KEY, "file_seq", "t_us")).drop("t_us")


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN epoch_us(ts) - CASE event_id % 3 WHEN 1 THEN 7200000000 ELSE 0 END END AS parsed_us
    FROM @events""")
def parse_iso(spark, sf):
    stamps = view(spark, sf, "v_stamps")
    return stamps.select("event_id", F.unix_micros(tx.parse_iso("stamp")).alias("parsed_us"))


GRID_SQL = """durs AS (SELECT *, (t_end - t_start) / 1000000 AS dur FROM @v_events),
grid AS (
    SELECT scene, row_index, day, t_start, t_end, t_peak, unnest(list_transform(
        generate_series(0, CAST(floor((dur + 1e-6) / 3600) AS BIGINT)), k -> k * 3600.0::DOUBLE)) AS off FROM durs WHERE dur > 0
    UNION ALL SELECT scene, row_index, day, t_start, t_end, t_peak, 0.0 FROM durs WHERE dur <= 0
    UNION ALL SELECT scene, row_index, day, t_start, t_end, t_peak, dur / 2 FROM durs
        WHERE dur > 0 AND abs(dur / 2 - round(dur / 2 / 3600) * 3600) > 900),
targets AS (SELECT *, t_start + CAST(round(off * 1000000) AS BIGINT) AS target_us FROM grid)"""


@query(f"""WITH {GRID_SQL},
    u AS (SELECT scene, row_index, day, dur, unnest(generate_series(0, 4)) AS i FROM durs),
    f AS (SELECT scene, row_index, day, dur, unnest(generate_series(0, CAST(floor((least(dur, 10.0) + 1e-6) * 2) AS BIGINT))) AS i FROM durs)
    SELECT scene, row_index, day, 'dense' AS kind, off AS t FROM grid
    UNION ALL SELECT scene, row_index, day, 'uniform', 0.0 + greatest(dur - 0.0, 0.0) * i / 4.0::DOUBLE FROM u
    UNION ALL SELECT scene, row_index, day, 'fps', 0.0 + i / 2.0::DOUBLE FROM f
    UNION ALL SELECT scene, row_index, day, 'ratio', 0.0 + greatest(dur - 0.0, 0.0) * r FROM durs, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS r)
    UNION ALL SELECT scene, row_index, day, 'inner', CASE WHEN s = 0 THEN CASE WHEN dur > 0 THEN 0.0 + dur * 0.1::DOUBLE ELSE 0.0 END
        ELSE CASE WHEN dur > 0 THEN dur - dur * 0.1::DOUBLE ELSE dur END END FROM durs, (SELECT unnest([0, 1]) AS s)
    UNION ALL SELECT scene, row_index, day, 'clip', 0.0 + i / fps FROM (
        SELECT *, unnest(generate_series(0, least(CAST(floor(greatest(dur, 1e-6) * fps) AS BIGINT), 15))) AS i FROM (
            SELECT *, greatest(1.0::DOUBLE, least(8.0::DOUBLE, 16.0::DOUBLE / greatest(dur, 1e-6))) AS fps FROM durs))""")
def time_grid(spark, sf):
    ev = events(spark, sf).withColumn("dur", (F.col("t_end") - F.col("t_start")) / tl.US)
    zero, dur = F.lit(0.0), F.col("dur")
    low, high = tl.inner_margin(zero, dur, 0.1)
    kinds = {
        "dense": tl.dense_grid(zero, dur, STEP_S), "uniform": tl.uniform_grid(zero, dur, 5), "fps": tl.fps_grid(zero, dur, 2.0, 10.0),
        "ratio": tl.ratio_grid(zero, dur), "inner": F.array(low, high), "clip": tl.clip_grid(zero, dur, 16),
    }
    grids = F.array(*[F.struct(F.lit(k).alias("kind"), g.alias("grid")) for k, g in kinds.items()])
    return ev.select(*EVENT, F.inline(grids)).select(*EVENT, "kind", F.explode("grid").alias("t"))


NEAREST_SQL = f"""{GRID_SQL},
found AS (SELECT t.scene, t.row_index, t.day, t.target_us, s.t_us, s.file_seq
    FROM (SELECT DISTINCT scene, row_index, day, target_us FROM targets) t JOIN @v_samples s ON t.scene = s.scene AND t.row_index = s.row_index
    QUALIFY row_number() OVER (PARTITION BY t.scene, t.row_index, t.day, t.target_us ORDER BY abs(s.t_us - t.target_us), s.t_us, s.file_seq) = 1)"""


def grid_targets(spark, sf):
    ev = events(spark, sf)
    grid = tl.explode_grid(ev, tl.dense_grid(F.lit(0.0), (F.col("t_end") - F.col("t_start")) / tl.US, STEP_S), "offset")
    return grid.select(*EVENT, (F.col("t_start") + F.round(F.col("offset") * tl.US).cast("bigint")).alias("target_us"))


@query(f"WITH {NEAREST_SQL} SELECT * FROM found")
def asof_nearest(spark, sf):
    targets = grid_targets(spark, sf).distinct()
    flat = view(spark, sf, "v_samples").select(*KEY, "t_us", "file_seq")
    return nearest_sample(targets, flat, KEY, "target_us", "t_us", "file_seq", ["file_seq"], SLICE)


@query(f"""WITH w AS (SELECT scene, row_index, day, t_peak, t_peak - {HOUR_US // 2} AS t_start, t_peak + {HOUR_US // 2} AS t_end FROM @v_events),
    inside AS (SELECT w.*, s.file_seq FROM w JOIN @v_samples s ON w.scene = s.scene AND w.row_index = s.row_index AND s.t_us BETWEEN w.t_start AND w.t_end),
    near AS (SELECT w.*, s.file_seq FROM w JOIN @v_samples s ON w.scene = s.scene AND w.row_index = s.row_index
        ANTI JOIN inside i ON w.scene = i.scene AND w.row_index = i.row_index AND w.day = i.day
        QUALIFY row_number() OVER (PARTITION BY w.scene, w.row_index, w.day ORDER BY abs(s.t_us - w.t_peak), s.t_us, s.file_seq) = 1)
    SELECT scene, row_index, day, fallback, count(*) AS n, sum(file_seq)::BIGINT AS seq_sum FROM (
        SELECT *, false AS fallback FROM inside UNION ALL SELECT *, true FROM near) GROUP BY 1, 2, 3, 4""")
def interval_join(spark, sf):
    ev = events(spark, sf).select(
        *EVENT, "t_peak", (F.col("t_peak") - HOUR_US // 2).alias("t_start"), (F.col("t_peak") + HOUR_US // 2).alias("t_end")
    )
    flat = view(spark, sf, "v_samples").select(*KEY, "t_us", "file_seq")
    rows = tl.window_samples(ev, flat, KEY, HOUR_US, ["file_seq"])
    return rows.groupBy(*EVENT, "fallback").agg(F.count("*").alias("n"), F.sum("file_seq").alias("seq_sum"))


@query("""SELECT scene, row_index, count(*) FILTER (eye_open) AS n_gaze, count(*) FILTER (hand_tracked) AS n_hand,
        count(*) AS n_origin, count(*) AS n_camera, round(sum(hx), 7) AS origin_x_sum,
        count(*) FILTER (eye_open AND sqrt((gx - cx) * (gx - cx) + (gy - cy) * (gy - cy) + (gz - cz) * (gz - cz)) > 1e-9) AS n_direction
    FROM @v_samples GROUP BY 1, 2""")
def valid_cues(spark, sf):
    s = samples(spark, sf)
    origin = cues.hand_origin()
    return s.groupBy(*KEY).agg(
        F.count(cues.gaze_hit()).alias("n_gaze"), F.count(cues.hand_hit()).alias("n_hand"), F.count(origin).alias("n_origin"),
        F.count_if(cues.valid_camera()).alias("n_camera"), F.round(F.sum(origin["x"]), 7).alias("origin_x_sum"),
        F.count(cues.gaze_direction()).alias("n_direction"),
    )


def move_sql(cue: str, ok: str) -> str:
    d = f"sqrt((a.{cue}x - b.{cue}x) * (a.{cue}x - b.{cue}x) + (a.{cue}y - b.{cue}y) * (a.{cue}y - b.{cue}y) + (a.{cue}z - b.{cue}z) * (a.{cue}z - b.{cue}z))"
    return f"CASE WHEN {ok.format('a')} AND {ok.format('b')} THEN {d} END"


STATS_SQL = f"""{NEAREST_SQL},
cands AS (SELECT DISTINCT f.scene, f.row_index, f.day, s.* EXCLUDE (scene, row_index, day) FROM found f JOIN @v_samples s ON f.file_seq = s.file_seq),
stats AS (SELECT a.scene, a.row_index, a.t_us, avg(gd) AS gaze_move, count(gd) AS gaze_neighbours, avg(hd) AS hand_move,
        count(hd) AS hand_neighbours, avg(cd) AS camera_move, count(cd) AS camera_neighbours FROM (
    SELECT a.scene, a.row_index, a.t_us, {move_sql('g', '{}.eye_open')} AS gd, {move_sql('h', '{}.hand_tracked')} AS hd, {move_sql('c', 'true')} AS cd
    FROM (SELECT DISTINCT ON (scene, row_index, t_us) * FROM cands) a JOIN @v_samples b ON a.scene = b.scene AND a.row_index = b.row_index
        AND abs(a.t_us - b.t_us) > 1 AND abs(a.t_us - b.t_us) <= {WINDOW}) a GROUP BY 1, 2, 3)"""


@query(f"""WITH {STATS_SQL} SELECT c.scene, c.row_index, c.day, c.t_us, round(gaze_move, 6) AS gaze_move, coalesce(gaze_neighbours, 0) AS gaze_neighbours,
    round(hand_move, 6) AS hand_move, coalesce(hand_neighbours, 0) AS hand_neighbours, round(camera_move, 6) AS camera_move,
    coalesce(camera_neighbours, 0) AS camera_neighbours FROM cands c LEFT JOIN stats USING (scene, row_index, t_us)""")
def neighbor_stability(spark, sf):
    s = tl.cue_columns(samples(spark, sf))
    cands = tl.candidate_samples(events(spark, sf), s, KEY, STEP_S, SLICE, ["file_seq", "gaze", "hand", "camera", "gaze_valid"])
    out = tl.neighbour_stats(cands, s, KEY, WINDOW, ("gaze", "hand", "camera"))
    stats = [f"{c}_{m}" for c in ("gaze", "hand", "camera") for m in ("move", "neighbours")]
    return rounded(out, "gaze_move", "hand_move", "camera_move").select(*EVENT, "t_us", *stats)


def stab_sql(ok: str, cue: str, scale: str) -> str:
    return f"CASE WHEN NOT {ok} THEN 0.0 WHEN {cue}_move IS NULL THEN 0.35 ELSE greatest(0.0, 1.0 - {cue}_move / {scale}) END"


SCORE_SQL = f"""{STATS_SQL},
scored AS (SELECT c.scene, c.row_index, c.day, c.t_us, c.file_seq, c.eye_open AS gaze_valid, c.hand_tracked AS hand_valid, gx, gy, gz, hx, hy, hz,
        CASE WHEN eye_open THEN 1.5::DOUBLE + 0.8::DOUBLE * ({stab_sql('eye_open', 'gaze', '4.0')})::DOUBLE ELSE 0.0 END
        + CASE WHEN hand_tracked THEN 1.1::DOUBLE + 0.7::DOUBLE * ({stab_sql('hand_tracked', 'hand', '4.0')})::DOUBLE ELSE 0.0 END
        + (0.3::DOUBLE + 0.4::DOUBLE * ({stab_sql('true', 'camera', '0.35')})::DOUBLE) AS score
    FROM cands c LEFT JOIN stats USING (scene, row_index, t_us))"""


@query(f"WITH {SCORE_SQL} SELECT scene, row_index, day, t_us, gaze_valid, hand_valid, round(score, 6) AS score FROM scored")
def evidence_score(spark, sf):
    s = tl.cue_columns(samples(spark, sf))
    cands = tl.candidate_samples(events(spark, sf), s, KEY, STEP_S, SLICE, ["file_seq", "gaze", "hand", "camera", "gaze_valid"])
    out = tl.evidence_score(cands, s, KEY, WINDOW)
    return out.select(*EVENT, "t_us", "gaze_valid", "hand_valid", F.round("score", 6).alias("score"))


def far(acc: str, t: str, gap: int) -> str:
    return f"len(list_filter({acc}, lambda e: abs(e.time - {t}) < {gap})) = 0"


SELECT_SQL = f"""{SCORE_SQL},
ranked AS (SELECT scene, row_index, day, list(struct_pack(neg := -score, time := t_us, g := gaze_valid, h := hand_valid, seq := file_seq,
        gx := gx, gy := gy, gz := gz, hx := hx, hy := hy, hz := hz) ORDER BY -score, t_us) AS c FROM scored WHERE score > 0 GROUP BY 1, 2, 3),
p1 AS (SELECT *, list_slice(list_filter(c, lambda x: x.g), 1, 1) AS p FROM ranked),
p2 AS (SELECT scene, row_index, day, c, list_concat(p, list_slice(list_filter(c, lambda x: x.h AND {far('p', 'x.time', GAP)}), 1, 1)) AS p FROM p1),
p3 AS (SELECT scene, row_index, day, list_reduce(list_transform(c, lambda x: [x]), lambda acc, x:
        CASE WHEN len(acc) < 3 AND {far('acc', 'x[1].time', GAP)} THEN list_concat(acc, x) ELSE acc END, p) AS p FROM p2),
flat AS (SELECT scene, row_index, day, unnest(p) AS s FROM p3),
evidence AS (SELECT scene, row_index, day, row_number() OVER (PARTITION BY scene, row_index, day ORDER BY s.time) AS panel_index,
        s.time AS t_us, -s.neg AS score, s.g AS gaze_valid, s.h AS hand_valid, s.seq AS file_seq, s.gx AS gx, s.gy AS gy, s.gz AS gz,
        s.hx AS hx, s.hy AS hy, s.hz AS hz FROM flat)"""


def evidence(spark, sf):
    return tl.select_evidence(events(spark, sf), samples(spark, sf), KEY, EVENT, STEP_S, WINDOW, GAP, 3, SLICE)


@query(f"""WITH {SELECT_SQL} SELECT scene, row_index, day, CAST(panel_index AS INTEGER) AS panel_index, t_us, round(score, 6) AS score,
    gaze_valid, hand_valid, file_seq FROM evidence""")
def select_evidence(spark, sf):
    return evidence(spark, sf).select(*EVENT, "panel_index", "t_us", F.round("score", 6).alias("score"), "gaze_valid", "hand_valid", "file_seq")


PANEL_WINDOW, PANEL_GAP, PANELS = 4 * HOUR_US, 3 * HOUR_US, 3
TURN = "CASE event_id % 4 WHEN 1 THEN 0.4 WHEN 2 THEN -0.4 WHEN 3 THEN 1.2 ELSE 0.0 END"


def turned_samples(spark, sf):
    """Telemetry whose cameras turn about the vertical axis and zoom; the gaze sometimes has a camera hit point only."""
    s = samples(spark, sf).withColumn("event_id", F.col("file_seq"))
    half = F.expr(TURN).cast("double") / 2.0
    turn = F.struct(F.lit(0.0).alias("x"), F.sin(half).alias("y"), F.lit(0.0).alias("z"), F.cos(half).alias("w"))
    eye = F.col("eyeGaze").withField("gazePoint", F.when(F.col("event_id") % 5 != 0, F.col("eyeGaze.gazePoint")))
    return s.withColumn("cameraRotation", turn).withColumn("cameraFOV", (70 + F.col("event_id") % 3 * 15).cast("double")).withColumn("eyeGaze", eye)


def video_events(spark, sf):
    """Event windows on a video clock that is ahead of or behind the samples, some of them after the last sample."""
    ev = events(spark, sf).withColumn("offset_us", (F.col("row_index") % 3 - 1) * (HOUR_US // 2))
    late = F.when(F.col("row_index") % 11 == 0, 60 * 24 * HOUR_US).otherwise(0)
    return ev.select(*EVENT, *[(F.col(c) + F.col("offset_us") + late).alias(c) for c in ("t_start", "t_end")], "offset_us")


PANEL_SQL = f"""ev AS (SELECT scene, row_index, day, t_start + off + late AS t_start, t_end + off + late AS t_end, off AS offset_us FROM (
    SELECT *, (row_index % 3 - 1) * {HOUR_US // 2} AS off, CASE WHEN row_index % 11 = 0 THEN {60 * 24 * HOUR_US} ELSE 0 END AS late FROM @v_events)),
seen AS (SELECT scene, row_index, t_us, file_seq, cx, cy, cz, event_id % 5 = 0 AS second, eye_open, turn, tan(radians(fov) / 2) AS half, px - cx AS dx, gy - cy AS dy, pz - cz AS dz FROM (
    SELECT *, {TURN} AS turn, 70 + event_id % 3 * 15 AS fov, gx AS px, CASE WHEN event_id % 5 = 0 THEN gz + 9.0 ELSE gz END AS pz FROM (SELECT *, file_seq AS event_id FROM @v_samples))),
cam AS (SELECT *, dx * cos(turn) - dz * sin(turn) AS x, dx * sin(turn) + dz * cos(turn) AS z FROM seen),
img AS (SELECT *, CASE WHEN z > 1e-6 THEN (x / (z * half * (1280.0::DOUBLE / 720.0::DOUBLE)) + 1) * 0.5 END AS u, CASE WHEN z > 1e-6 THEN (1 - dy / (z * half)) * 0.5 END AS v FROM cam),
proj AS (SELECT scene, row_index, t_us, file_seq, cx, cy, cz, second, coalesce(eye_open AND u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1, false) AS ok, u * 1280 AS u, v * 720 AS v FROM img),
ends AS (SELECT scene, row_index, min(t_us) AS a, max(t_us) AS z FROM @v_samples GROUP BY 1, 2),
part AS (SELECT ev.*, greatest(a, t_start - offset_us) AS low, (least(z, t_end - offset_us) - greatest(a, t_start - offset_us)) / 1000000 AS dur FROM ev JOIN ends USING (scene, row_index)),
steps AS (SELECT *, unnest(list_transform(generate_series(0, CAST(floor((dur + 1e-6) / 3600) AS BIGINT)), k -> k * 3600.0::DOUBLE)) AS o FROM part WHERE dur > 0
    UNION ALL SELECT *, 0.0 FROM part WHERE dur <= 0
    UNION ALL SELECT *, dur / 2 FROM part WHERE dur > 0 AND abs(dur / 2 - round(dur / 2 / 3600) * 3600) > 900),
hits AS (SELECT g.scene, g.row_index, g.day, g.t_start, g.t_end, g.offset_us, p.* EXCLUDE (scene, row_index)
    FROM (SELECT DISTINCT *, low + CAST(round(o * 1000000) AS BIGINT) AS at FROM steps) g JOIN proj p ON g.scene = p.scene AND g.row_index = p.row_index
    QUALIFY row_number() OVER (PARTITION BY g.scene, g.row_index, g.day, g.at ORDER BY abs(p.t_us - g.at), p.t_us, p.file_seq) = 1),
cand AS (SELECT DISTINCT * FROM hits WHERE t_us + offset_us BETWEEN t_start - 1 AND t_end + 1),
moves AS (SELECT c.scene, c.row_index, c.t_us, avg(CASE WHEN s.ok THEN sqrt((s.u - c.u) * (s.u - c.u) + (s.v - c.v) * (s.v - c.v)) END) AS gaze,
        avg(sqrt((s.cx - c.cx) * (s.cx - c.cx) + (s.cy - c.cy) * (s.cy - c.cy) + (s.cz - c.cz) * (s.cz - c.cz))) AS camera
    FROM (SELECT DISTINCT ON (scene, row_index, t_us) * FROM cand WHERE ok) c JOIN proj s ON c.scene = s.scene AND c.row_index = s.row_index
        AND abs(s.t_us - c.t_us) > 1 AND abs(s.t_us - c.t_us) <= {PANEL_WINDOW} GROUP BY 1, 2, 3),
points AS (SELECT c.*, 1.0::DOUBLE + CASE WHEN gaze IS NULL THEN 0.15::DOUBLE ELSE 0.9::DOUBLE * greatest(0.0, 1.0 - gaze / 280.0::DOUBLE) END
        + CASE WHEN camera IS NULL THEN 0.0 ELSE 0.25::DOUBLE * greatest(0.0, 1.0 - camera / 0.35::DOUBLE) END AS score,
        'gaze:' || CASE WHEN second THEN 'cameraHitPoint' ELSE 'gazePoint' END AS reason
    FROM cand c LEFT JOIN moves USING (scene, row_index, t_us) WHERE ok),
lists AS (SELECT scene, row_index, day, list(struct_pack(time := t_us, video := t_us + offset_us, score := score, reason := reason) ORDER BY -score, t_us) AS c FROM points GROUP BY 1, 2, 3),
greedy AS (SELECT scene, row_index, day, list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) < {PANELS} AND {far('acc', 'x[1].time', PANEL_GAP)}
        THEN list_concat(acc, x) ELSE acc END) AS p FROM lists),
best AS (SELECT scene, row_index, day, unnest(p) AS s FROM greedy),
chosen AS (SELECT scene, row_index, day, row_number() OVER (PARTITION BY scene, row_index, day ORDER BY s.time) AS panel_index, s.video AS video_us, s.time AS t_us, s.score AS score, s.reason AS reason FROM best),
even AS (SELECT scene, row_index, day, i + 1 AS panel_index, t_start + CAST(round((t_end - t_start) / 1000000 * i / {PANELS - 1}.0::DOUBLE * 1000000) AS BIGINT) AS video_us, offset_us
    FROM (SELECT *, unnest(generate_series(0, {PANELS - 1})) AS i FROM ev)),
spare AS (SELECT scene, row_index, day, panel_index, video_us, video_us - offset_us AS t_us, 0.0 AS score, 'uniform_fallback:no_positive_evidence' AS reason FROM even ANTI JOIN best USING (scene, row_index, day))"""


@query(f"""WITH {PANEL_SQL} SELECT scene, row_index, day, CAST(panel_index AS INTEGER) AS panel_index, video_us, t_us, round(score, 6) AS score, reason
    FROM (SELECT * FROM chosen UNION ALL SELECT * FROM spare)""")
def select_panels(spark, sf):
    out = tl.select_panels(video_events(spark, sf), turned_samples(spark, sf), KEY, EVENT, PANELS, STEP_S, PANEL_WINDOW, PANEL_GAP, SLICE, (W, H))
    return rounded(out, "score").withColumn("reason", F.regexp_extract("reason", "^[^;]*", 0))


SEG_D = "sqrt((gx - a.x) * (gx - a.x) + (gy - a.y) * (gy - a.y) + (gz - a.z) * (gz - a.z))"
SEG_SQL = f"""seg AS (SELECT e.scene, e.row_index, e.day, CAST(floor((s.t_us - e.t_start) / {2 * HOUR_US}) AS BIGINT) AS segment, s.t_us, gx, gy, gz
    FROM @v_events e JOIN @v_samples s ON e.scene = s.scene AND e.row_index = s.row_index AND s.t_us >= e.t_start AND s.t_us < e.t_end WHERE eye_open),
n AS (SELECT scene, row_index, day, segment, count(*) AS n_gaze FROM seg GROUP BY ALL HAVING count(*) >= 2),
pairs AS (SELECT seg.scene, row_index, day, segment, n_gaze, anchor_id, t_us, {SEG_D} AS d FROM seg JOIN n USING (scene, row_index, day, segment)
    JOIN @v_anchors a ON seg.scene = a.scene),
low AS (SELECT *, min(d) OVER (PARTITION BY scene, row_index, day, segment, anchor_id) AS min_d FROM pairs),
stats AS (SELECT scene, row_index, day, segment, n_gaze, anchor_id, min_d, min(t_us) FILTER (d = min_d) AS nearest_us,
    count(*) FILTER (d <= min_d + 0.75) AS close_frames FROM low GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY scene, row_index, day, segment ORDER BY min_d, close_frames DESC, anchor_id) AS r FROM stats),
segments AS (SELECT scene, row_index, day, segment, n_gaze, min(min_d) AS best_d, arg_min(nearest_us, r) AS t_us,
    n_gaze / (1.0::DOUBLE + min(min_d)) AS score, string_agg(anchor_id || ':' || close_frames, ',' ORDER BY r) AS nearest
    FROM rk WHERE r <= 3 GROUP BY ALL)"""


def segments(spark, sf):
    s = tl.segment_cues(samples(spark, sf))
    return tl.timeline_segments(events(spark, sf), s, view(spark, sf, "v_anchors"), KEY, EVENT, 2 * HOUR_US, SLICE)


@query(f"""WITH {SEG_SQL.replace('GROUP BY ALL HAVING', 'GROUP BY 1, 2, 3, 4 HAVING').replace('segment, n_gaze, min(min_d)', 'segment, any_value(n_gaze) AS n_gaze, min(min_d)').replace('n_gaze / (1.0', 'any_value(n_gaze) / (1.0').replace('r <= 3 GROUP BY ALL', 'r <= 3 GROUP BY 1, 2, 3, 4')}
    SELECT scene, row_index, day, segment, n_gaze, t_us, round(best_d, 6) AS best_d, round(score, 6) AS score, nearest FROM segments""")
def timeline_segments(spark, sf):
    out = segments(spark, sf)
    names = F.transform("nearest", lambda a: F.concat_ws(":", a["anchor_id"], a["close_frames"].cast("string")))
    return rounded(out.withColumn("nearest", F.concat_ws(",", names)), "best_d", "score").select(
        *EVENT, "segment", "n_gaze", "t_us", "best_d", "score", "nearest"
    )


@query(f"""WITH inside AS (SELECT e.scene, e.row_index, e.day, e.t_start, e.t_end, CAST(floor((s.t_us - e.t_start) / {2 * HOUR_US}) AS BIGINT) AS segment,
        s.t_us, s.file_seq, gx, gy, gz, eye_open, hand_tracked
        FROM @v_events e JOIN @v_samples s ON e.scene = s.scene AND e.row_index = s.row_index AND s.t_us >= e.t_start AND s.t_us < e.t_end),
    n AS (SELECT scene, row_index, day, segment, any_value(t_start) + segment * {2 * HOUR_US} AS start_us, any_value(t_end) AS t_end,
        count(*) FILTER (eye_open) AS n_gaze, count(*) FILTER (hand_tracked) AS n_hand
        FROM inside GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (eye_open) >= 2),
    seg AS (SELECT *, row_number() OVER (PARTITION BY scene, row_index, day, segment ORDER BY t_us, file_seq) AS at FROM inside WHERE eye_open),
    d AS (SELECT seg.scene, row_index, day, segment, anchor_id, t_us, {SEG_D} AS d FROM seg JOIN @v_anchors a ON seg.scene = a.scene),
    low AS (SELECT *, min(d) OVER (PARTITION BY scene, row_index, day, segment, anchor_id) AS min_d FROM d),
    stats AS (SELECT scene, row_index, day, segment, anchor_id, min_d, min(t_us) FILTER (d = min_d) AS nearest_us, count(*) FILTER (d <= min_d + 0.75) AS close_frames
        FROM low GROUP BY 1, 2, 3, 4, 5, 6),
    best AS (SELECT * FROM stats QUALIFY row_number() OVER (PARTITION BY scene, row_index, day, segment ORDER BY min_d, close_frames DESC, anchor_id) = 1)
    SELECT n.scene, n.row_index, n.day, n.segment, n.start_us, least(n.start_us + {2 * HOUR_US}, n.t_end) AS end_us, n.n_gaze, n.n_hand,
        b.anchor_id, b.close_frames, round(e.gy, 6) AS eye_y, CASE WHEN abs(m.t_us - b.nearest_us) > 1000 THEN m.t_us END AS middle_us,
        CASE WHEN abs(m.t_us - b.nearest_us) > 1000 THEN round(m.gx, 6) END AS middle_x
    FROM n JOIN best b USING (scene, row_index, day, segment)
    JOIN seg m ON m.scene = n.scene AND m.row_index = n.row_index AND m.day = n.day AND m.segment = n.segment AND m.at = n.n_gaze // 2 + 1
    JOIN (SELECT * FROM seg QUALIFY row_number() OVER (PARTITION BY scene, row_index, day, segment, t_us ORDER BY file_seq) = 1) e
        ON e.scene = n.scene AND e.row_index = n.row_index AND e.day = n.day AND e.segment = n.segment AND e.t_us = b.nearest_us""")
def segment_evidence(spark, sf):
    first, eye, middle = F.get("nearest", 0), F.get("eye_cues", 0), F.get("eye_cues", 1)
    return segments(spark, sf).select(
        *EVENT, "segment", "start_us", "end_us", "n_gaze", "n_hand", first["anchor_id"].alias("anchor_id"), first["close_frames"].alias("close_frames"),
        F.round(eye["gaze"]["y"], 6).alias("eye_y"), middle["t_us"].alias("middle_us"), F.round(middle["gaze"]["x"], 6).alias("middle_x"),
    )


NMS_GAP = tl.segment_gap(2 * HOUR_US)


@query(f"""WITH {SEG_SQL.replace('GROUP BY ALL HAVING', 'GROUP BY 1, 2, 3, 4 HAVING').replace('segment, n_gaze, min(min_d)', 'segment, any_value(n_gaze) AS n_gaze, min(min_d)').replace('n_gaze / (1.0', 'any_value(n_gaze) / (1.0').replace('r <= 3 GROUP BY ALL', 'r <= 3 GROUP BY 1, 2, 3, 4')},
    ranked AS (SELECT scene, row_index, day, list([struct_pack(neg := -score, time := t_us)] ORDER BY -score, t_us) AS c FROM segments GROUP BY 1, 2, 3),
    picked AS (SELECT scene, row_index, day, unnest(list_reduce(c, lambda acc, x: CASE WHEN len(acc) < 2 AND {far('acc', 'x[1].time', NMS_GAP)}
        THEN list_concat(acc, x) ELSE acc END)) AS s FROM ranked)
    SELECT scene, row_index, day, CAST(row_number() OVER (PARTITION BY scene, row_index, day ORDER BY s.time) AS INTEGER) AS panel_index, s.time AS t_us,
        round(-s.neg, 6) AS score FROM picked""")
def temporal_nms(spark, sf):
    out = tl.temporal_nms(segments(spark, sf), EVENT, 2, NMS_GAP)
    return rounded(out, "score")


PROJ = "(({c}x - cx) / (({c}z{dz} - cz) * tan(radians(90.0) / 2) * (1280.0 / 720.0)) + 1) * 0.5"
PROJ_V = "(1 - ({c}y - cy) / (({c}z{dz} - cz) * tan(radians(90.0) / 2))) * 0.5"


def uv_sql(c: str, dz: str = "") -> tuple[str, str]:
    return PROJ.format(c=c, dz=dz), PROJ_V.format(c=c, dz=dz)


def on_image(c: str, dz: str = "") -> str:
    u, v = uv_sql(c, dz)
    return f"({c}z{dz} - cz > 1e-6 AND {u} BETWEEN 0 AND 1 AND {v} BETWEEN 0 AND 1)"


@query(f"""WITH t AS (SELECT *, lead(t_us) OVER (PARTITION BY scene, row_index ORDER BY t_us, file_seq) AS nxt FROM @v_samples)
    SELECT scene, row_index, file_seq, CASE WHEN nxt IS NULL THEN 60000000 ELSE greatest(60000000, least({6 * HOUR_US}, nxt - t_us)) END AS dwell_us
    FROM t WHERE eye_open AND {on_image('g')}""")
def dwell_segments(spark, sf):
    out = tl.dwell_segments(samples(spark, sf), KEY, SLICE, 60_000_000, 6 * HOUR_US)
    uv = geo.project_point("cameraPosition", "cameraRotation", "cameraFOV", F.col("eyeGaze.gazePoint"), W, H)
    shown = out.filter(~F.col("eyeGaze.isEyeOpen").eqNullSafe(False) & uv.isNotNull())
    return shown.select(*KEY, "file_seq", "dwell_us")


@query(f"""SELECT scene, row_index, file_seq, round({uv_sql('g')[0]}, 13) AS u, round({uv_sql('g')[1]}, 13) AS v
    FROM @v_samples WHERE {on_image('g')}""")
def project_point(spark, sf):
    uv = geo.project_point("cameraPosition", "cameraRotation", "cameraFOV", F.col("eyeGaze.gazePoint"), W, H)
    out = samples(spark, sf).select(*KEY, "file_seq", uv.alias("uv")).filter("uv IS NOT NULL")
    return out.select(*KEY, "file_seq", F.round("uv.u", 13).alias("u"), F.round("uv.v", 13).alias("v"))


@query("""WITH h AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY scene, row_index, day) AS n FROM @v_samples
        WINDOW w AS (PARTITION BY scene, row_index, day ORDER BY t_us, file_seq))
    SELECT scene, row_index, day, count(*) AS n_samples, count(*) FILTER (eye_open) AS eye_open_count, count(*) FILTER (hand_tracked) AS right_tracked,
        round(avg(cx), 9) AS mean_camera_x, round(avg(cy), 9) AS mean_camera_y, 2.0::DOUBLE AS mean_right_joints,
        round(max(hx) FILTER (r - 1 = n // 2), 9) AS middle_x FROM h GROUP BY 1, 2, 3""")
def window_summary(spark, sf):
    out = tl.window_summary(samples(spark, sf), EVENT, HOUR_US)
    out = out.withColumn("middle_x", F.col("middle_hit.x"))
    return rounded(out, "mean_camera_x", "mean_camera_y", "middle_x", digits=9).select(
        *EVENT, "n_samples", "eye_open_count", "right_tracked", "mean_camera_x", "mean_camera_y", "mean_right_joints", "middle_x"
    )


@query("""WITH h AS (SELECT *, row_number() OVER (PARTITION BY scene, row_index, day ORDER BY t_us, file_seq) - 1 AS r,
        count(*) OVER (PARTITION BY scene, row_index, day) AS n FROM @v_samples)
    SELECT scene, row_index, day, r AS position, file_seq FROM h
    WHERE n <= 3 OR r IN (0, CAST(round_even((n - 1) / 2.0, 0) AS BIGINT), n - 1)""")
def representative(spark, sf):
    flat = view(spark, sf, "v_samples").select(*EVENT, "t_us", "file_seq")
    return tl.representative_rows(flat, EVENT, 3, HOUR_US).select(*EVENT, "position", "file_seq")


@query(f"""WITH src AS (
        SELECT scene, row_index, day, t_us, file_seq, 0 AS rank, 'gazePoint' AS source, {uv_sql('g')[0]} AS u, {uv_sql('g')[1]} AS v, gx AS px FROM @v_samples WHERE {on_image('g')}
        UNION ALL SELECT scene, row_index, day, t_us, file_seq, 1, 'cameraHitPoint', {uv_sql('g', ' + 9')[0]}, {uv_sql('g', ' + 9')[1]}, gx FROM @v_samples WHERE {on_image('g', ' + 9')}
        UNION ALL SELECT scene, row_index, day, t_us, file_seq, 2, 'rightIndexFingerRayHitPoint', {uv_sql('h')[0]}, {uv_sql('h')[1]}, hx FROM @v_samples WHERE {on_image('h')}),
    best AS (SELECT *, min(rank) OVER (PARTITION BY scene, row_index, day) AS top FROM src),
    used AS (SELECT *, row_number() OVER (PARTITION BY scene, row_index, day ORDER BY t_us, file_seq) - 1 AS r,
        count(*) OVER (PARTITION BY scene, row_index, day) AS n FROM best WHERE rank = top)
    SELECT scene, row_index, day, any_value(source) AS source, count(*) AS sample_count, quantile_cont(u, 0.5)::FLOAT::DOUBLE AS u_norm,
        quantile_cont(v, 0.5)::FLOAT::DOUBLE AS v_norm, round(max(px) FILTER (r = n // 2), 12) AS point_x FROM used GROUP BY 1, 2, 3""")
def spatial_prior(spark, sf):
    sources = {
        "gazePoint": F.col("eyeGaze.gazePoint"), "cameraHitPoint": F.col("eyeGaze.cameraHitPoint"),
        "rightIndexFingerRayHitPoint": F.col("handData.rightIndexFingerRayHitPoint"),
    }
    out = tl.spatial_prior(samples(spark, sf), EVENT, sources, W, H, HOUR_US)
    out = out.withColumn("point_x", F.col("point.x"))
    # single precision hides last-bit differences without decimal rounding ties
    out = out.withColumns({c: F.col(c).cast("float").cast("double") for c in ("u_norm", "v_norm")})
    return rounded(out, "point_x", digits=12).select(*EVENT, "source", "sample_count", "u_norm", "v_norm", "point_x")


@query("""WITH c AS (SELECT *, CASE WHEN row_index % 7 <> 0 THEN first_us // 1000000 * 1000000 END AS video_us FROM @v_capture),
    d AS (SELECT *, (meta_us - video_us) / 1000000 AS delta FROM c)
    SELECT scene, row_index, round(coalesce((first_us - CASE WHEN meta_us IS NULL THEN video_us WHEN video_us IS NULL OR abs(delta) <= 1 THEN meta_us
            WHEN delta < 0 THEN video_us - 500000 ELSE video_us + 500000 END) / 1000000, 0), 6) AS offset_seconds,
        CASE WHEN meta_us IS NULL AND video_us IS NULL THEN 'no_metadata_or_video_time' WHEN meta_us IS NULL THEN 'fallback_video_no_metadata'
            WHEN video_us IS NULL THEN 'fallback_metadata_no_video_time' WHEN abs(delta) <= 1 THEN 'metadata_within_threshold'
            WHEN delta < 0 THEN 'metadata_early_use_video_minus_bias' ELSE 'metadata_late_use_video_plus_bias' END AS offset_source FROM d""")
def clock_offset(spark, sf):
    cap = view(spark, sf, "v_capture").withColumn("video_us", F.unix_micros(tx.filename_ts("file_name")))
    return rounded(tl.clock_offset(cap), "offset_seconds").select(*KEY, "offset_seconds", "offset_source")


BOX_SQL = f"""joint AS (
    SELECT scene, row_index, file_seq, hand_tracked, cx, cy, cz, hx + d AS hx, hy, hz FROM @v_samples, (SELECT unnest([-0.04, 0.04])::DOUBLE AS d)),
seen AS (SELECT *, {uv_sql('h')[0]} * 1280 AS px, {uv_sql('h')[1]} * 720 AS py, hz - cz AS depth FROM joint
    WHERE hand_tracked AND hz - cz > 1e-6 AND {uv_sql('h')[0]} BETWEEN -0.5 AND 1.5 AND {uv_sql('h')[1]} BETWEEN -0.5 AND 1.5),
agg AS (SELECT file_seq, min(px) AS l, max(px) AS r, min(py) AS t, max(py) AS b,
    greatest(48.0, least(360.0, 720 / (2 * tan(radians(90.0) / 2)) * 0.1 / greatest(min(depth), 0.05))) AS m FROM seen GROUP BY 1),
edges AS (SELECT file_seq, greatest(0.0, l - m) AS x1, greatest(0.0, t - m) AS y1, least(1280.0, r + m) AS x2, least(720.0, b + m) AS y2 FROM agg),
px AS (SELECT file_seq, round(x1, 2) AS x1, round(y1, 2) AS y1, round(x2, 2) AS x2, round(y2, 2) AS y2 FROM edges WHERE x2 > x1 AND y2 > y1),
boxes AS (SELECT s.scene, s.row_index, s.file_seq, x1, y1, x2, y2,
    coalesce(CASE WHEN x1 IS NOT NULL THEN greatest(0, least(round_even(x2, 0), 1279) - least(round_even(x1, 0), 1279) + 1) * greatest(0, least(round_even(y2, 0), 719) - least(round_even(y1, 0), 719) + 1) END, 0)
        / (1280.0 * 720.0)::DOUBLE AS mask_fraction, hand_tracked FROM @v_samples s LEFT JOIN px ON s.file_seq = px.file_seq),
status AS (SELECT *, CASE WHEN mask_fraction > 0 THEN 'masked' WHEN NOT hand_tracked THEN 'no_tracked_hand' ELSE 'tracked_offscreen' END AS status FROM boxes)"""


def boxes(spark, sf):
    return tl.hand_boxes(samples(spark, sf), [*KEY, "file_seq"], W, H)


@query(f"""WITH {BOX_SQL} SELECT scene, row_index, file_seq, x1, y1, x2, y2, round(mask_fraction, 6) AS mask_fraction, status FROM status""")
def hand_boxes(spark, sf):
    out = boxes(spark, sf).select(*KEY, "file_seq", "rightHand_box.*", "mask_fraction", "status")
    return rounded(out, "mask_fraction")


@query(f"""WITH {BOX_SQL} SELECT scene, count(*) AS n, count(*) FILTER (status = 'masked') AS masked,
    count(*) FILTER (status = 'no_tracked_hand') AS no_tracked_hand, count(*) FILTER (status = 'tracked_offscreen') AS tracked_offscreen,
    round(avg(mask_fraction), 6) AS mean_fraction, round(max(mask_fraction), 6) AS max_fraction, count(*) FILTER (mask_fraction > 0.25) AS over_25,
    count(*) FILTER (mask_fraction > 0.5) AS over_50, round(quantile_cont(mask_fraction, 0.5), 6) AS median_fraction FROM status GROUP BY 1""")
def mask_stats(spark, sf):
    return rounded(tl.mask_stats(boxes(spark, sf), ["scene"]), "mean_fraction", "max_fraction", "median_fraction")


def evidence_frames(spark, sf):
    frame = F.struct("panel_index", "gaze", "hand", "gaze_valid", "hand_valid")
    return evidence(spark, sf).groupBy(*EVENT).agg(F.array_sort(F.collect_list(frame)).alias("frames"))


P3 = "sqrt((p.x - q[1].x) * (p.x - q[1].x) + (p.y - q[1].y) * (p.y - q[1].y) + (p.z - q[1].z) * (p.z - q[1].z))"


@query(f"""WITH {SELECT_SQL},
    pts AS (SELECT scene, row_index, day, list([struct_pack(x := gx, y := gy, z := gz)] ORDER BY panel_index) FILTER (gaze_valid) AS c FROM evidence GROUP BY 1, 2, 3),
    kept AS (SELECT scene, row_index, day, CASE WHEN c IS NULL THEN [] ELSE list_reduce(c, lambda acc, q: CASE WHEN len(acc) < 3 AND
        len(list_filter(acc, lambda p: {P3} < 8)) = 0 THEN list_concat(acc, q) ELSE acc END) END AS k FROM pts)
    SELECT scene, row_index, day, len(k) AS n_points, round(coalesce(list_sum(list_transform(k, lambda p: p.x + p.y + p.z)), 0), 6) AS coord_sum FROM kept""")
def radius_dedup(spark, sf):
    ev = evidence_frames(spark, sf)
    kept = ev.withColumn("_p", bl.radius_dedup(bl.valid_points(F.col("frames"), "gaze", "gaze_valid"), 8.0, 3))
    return kept.select(*EVENT, F.size("_p").cast("bigint").alias("n_points"), F.round(coord_sum("_p"), 6).alias("coord_sum"))


def coord_sum(c: str):
    return F.aggregate(c, F.lit(0.0), lambda s, p: s + p["x"] + p["y"] + p["z"])


@query()
def fuse_points(spark, sf):
    ev = evidence_frames(spark, sf)
    gaze, hand = (bl.valid_points(F.col("frames"), c, f"{c}_valid") for c in ("gaze", "hand"))
    fused = ev.withColumn("_g", gaze).withColumn("_h", hand).withColumn("_p", bl.fuse_points(F.col("_g"), F.col("_h"), 8.0, 3))
    return fused.select(*EVENT, F.size("_p").alias("n_points"), F.round(coord_sum("_p"), 6).alias("coord_sum"))


@query()
def cue_baselines(spark, sf):
    out = bl.cue_baselines(evidence_frames(spark, sf), 8.0, 3)
    return out.select(*EVENT, "method", F.size("points").alias("n_points"), F.round(coord_sum("points"), 6).alias("coord_sum"))
