"""Time-series operators over telemetry samples.

An interaction may be arbitrarily long, so nothing here sorts or collects all samples of one key in a
single task: joins go through (key, time slice), orderings through bucketed ranks, and only candidate
lists that a time grid bounds are ever turned into arrays. Times are whole microseconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundmetrics.functions import cues
from groundmetrics.functions import geometry as geo
from groundmetrics.functions import text as tx
from groundmetrics.operators.scale import bucket_lead, bucket_rank, dealt, exact_quantiles, first_by, nearest_sample, shuffled, small_side, top_k
from groundmetrics.operators.sets import KEY
from groundmetrics.session import checkpointed

US = 1_000_000


def relative_time(samples: DataFrame, keys: Sequence[str] = KEY, time: str = "t_us") -> DataFrame:
    """Seconds since the first sample, and whether the series crosses a calendar day."""
    keys = list(keys)
    dated = samples.filter(F.col(time).isNotNull())
    first = dated.groupBy(*keys).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    day = [F.to_date(F.timestamp_micros(c)) for c in ("_t0", "_t1")]
    first = first.withColumn("cross_day", day[0] != day[1])
    return dated.join(first, keys).withColumn("t_rel", (F.col(time) - F.col("_t0")) / US).drop("_t0", "_t1")


# ---------------------------------------------------------------- time grids

def uniform_grid(start: Column, end: Column, panels: int) -> Column:
    """``panels`` points including both ends (the middle for a single one)."""
    if panels <= 1:
        return F.array((start + end) / 2.0)
    span = F.greatest(end - start, F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(panels - 1)), lambda i: start + span * i / float(panels - 1))


def dense_grid(start: Column, end: Column, step: float, floor: float = 0.05) -> Column:
    """Steps from start to end, plus the midpoint unless a step is already near it."""
    step = max(floor, step)
    n = F.floor((end - start + 1e-6) / step).cast("int")
    grid = F.transform(F.sequence(F.lit(0), n), lambda i: start + i * step)
    mid = (start + end) / 2.0
    near = F.exists(grid, lambda t: F.abs(mid - t) <= step * 0.25)
    return F.when(end <= start, F.array(start)).otherwise(F.when(near, grid).otherwise(F.array_sort(F.array_append(grid, mid))))


def fps_grid(start: Column, end: Column, fps: float, max_duration: float | None = None) -> Column:
    stop = F.greatest(start, end)
    if max_duration is not None:
        stop = F.least(stop, start + max_duration)
    n = F.floor((stop - start + 1e-6) * fps).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: start + i / F.lit(float(fps)))


def ratio_grid(start: Column, end: Column, ratios: Sequence[float] = (0.25, 0.5, 0.75)) -> Column:
    span = F.greatest(end - start, F.lit(0.0))
    return F.array(*[start + span * r for r in ratios])


def bin_centres(start: Column, end: Column, bins: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: start + (end - start) * (i + 0.5) / float(bins))


def clip_grid(start: Column, end: Column, max_frames: int) -> Column:
    """Frame times of a clip sampled at ``clamp(max_frames / duration, 1, 8)`` frames per second."""
    span = F.greatest(end - start, F.lit(1e-6))
    fps = F.greatest(F.lit(1.0), F.least(F.lit(8.0), F.lit(float(max_frames)) / span))
    n = F.least(F.floor(span * fps).cast("int"), F.lit(max_frames - 1))
    return F.transform(F.sequence(F.lit(0), n), lambda i: start + i / fps)


def inner_margin(start: Column, end: Column, ratio: float) -> tuple[Column, Column]:
    cut = (end - start) * min(0.45, max(0.0, ratio))
    ok = (end > start) & F.lit(ratio > 0)
    return F.when(ok, start + cut).otherwise(start), F.when(ok, end - cut).otherwise(end)


def explode_grid(events: DataFrame, grid: Column, out: str = "t") -> DataFrame:
    return events.select("*", F.posexplode(grid).alias("grid_index", out))


# ---------------------------------------------------------------- joins

def inside_samples(events: DataFrame, samples: DataFrame, keys: Sequence[str], width: int, payload: Sequence[str]) -> DataFrame:
    """Samples inside ``[t_start, t_end]`` of each event: windows are cut into time slices, so this is an
    equi-join on (key, slice) with the range as a residual condition."""
    keys = list(keys)
    first, last = (F.floor(F.col(c) / width) for c in ("t_start", "t_end"))
    sliced = events.withColumn("_b", F.explode(F.sequence(first, last)))
    s = samples.select(*keys, "t_us", *payload).withColumn("_b", F.floor(F.col("t_us") / width))
    return shuffled(sliced).join(s, [*keys, "_b"]).filter(F.col("t_us").between(F.col("t_start"), F.col("t_end"))).drop("_b")


def window_samples(events: DataFrame, samples: DataFrame, keys: Sequence[str], width: int, payload: Sequence[str]) -> DataFrame:
    """Samples of each event window; an event without any gets the one nearest to ``t_peak``."""
    inside = inside_samples(events, samples, keys, width, payload)
    full = inside.withColumn("fallback", F.lit(False))
    ids = list(events.columns)
    empty = events.join(inside.select(*ids).distinct(), ids, "left_anti")
    near = nearest_sample(empty, samples, keys, "t_peak", "t_us", payload[0], payload, width)
    near = near.filter("t_us IS NOT NULL").withColumn("fallback", F.lit(True))
    return full.unionByName(near.select(*full.columns))


def _beside(candidates: DataFrame, samples: DataFrame, keys: Sequence[str], window: int, how: str) -> DataFrame:
    """Candidates (``_t``) with the samples (``_u``) within ``window``; stamps within a microsecond are the candidate itself.

    Both sides are bucketed by ``window``, samples also into the two adjacent buckets, so all neighbours of a candidate meet it in the
    bucket of its own time (``_b``) and what is grouped by key and bucket afterwards stays where it is.
    """
    home = F.floor(F.col("_u") / window)
    c = candidates.withColumn("_b", F.floor(F.col("_t") / window))
    s = samples.withColumn("_b", F.explode(F.array(home - 1, home, home + 1))).withColumnsRenamed({k: f"_of_{k}" for k in (*keys, "_b")})
    c = dealt(c, [*keys, "_b"], samples)
    s = dealt(s, [f"_of_{k}" for k in (*keys, "_b")], samples)
    gap = F.abs(F.col("_u") - F.col("_t"))
    same = (gap > 1) & (gap <= window)
    for k in (*keys, "_b"):
        same = same & (F.col(k) == F.col(f"_of_{k}"))
    return c.join(shuffled(s), same, how)


def ordered_means(pairs: DataFrame, keys: Sequence[str], values: dict[str, Column], order: Sequence[Column]) -> DataFrame:
    """``keys``, the mean of each of ``values`` as ``<name>_move`` and its count as ``<name>_neighbours``.

    A sum of doubles depends on its order in the last bits, and with it which of two candidates of equal score comes first. The values
    are therefore added in the given ``order``, as running sums whose last one counts; partial sums would be added as tasks end.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = pairs.withColumns({f"_d_{n}": d for n, d in values.items()})
    out = out.withColumns({**{f"_sum_{n}": F.sum(f"_d_{n}").over(upto) for n in values}, **{f"{n}_neighbours": F.count(f"_d_{n}").over(upto) for n in values},
                           "_more": F.lead(F.lit(True)).over(w)}).filter("_more IS NULL")
    means = [(F.col(f"_sum_{n}") / F.nullif(F.col(f"{n}_neighbours"), F.lit(0))).alias(f"{n}_move") for n in values]
    return out.select(*keys, *means, *[f"{n}_neighbours" for n in values])


def _last_first(samples: DataFrame) -> list[str]:
    """Names of the columns that order samples, those recorded last first; ``file_seq`` may be absent."""
    return [c for c in ("file_seq", "t_us") if c in samples.columns]


def neighbour_stats(candidates: DataFrame, samples: DataFrame, keys: Sequence[str], window: int, cues_: Sequence[str]) -> DataFrame:
    """Candidates plus mean distance and count of the neighbours within ``window``, per cue column.

    A sample meets at most the candidates of three buckets of ``window`` width. Neighbours are added from the last recorded to the first.
    """
    keys, order = list(keys), _last_first(samples)
    rest = [c for c in candidates.columns if c not in keys and c not in ("t_us", *cues_)]
    c = candidates.withColumn("_row", F.struct(*candidates.columns)).select(
        *keys, F.col("t_us").alias("_t"), *[F.col(p).alias(f"_c_{p}") for p in cues_], "_row"
    )
    s = samples.select(*keys, F.col("t_us").alias("_u"), *[F.col(o).alias(f"_o_{o}") for o in order], *[F.col(p).alias(f"_s_{p}") for p in cues_])
    pairs = _beside(c, s, keys, window, "left")
    moves = {p: geo.distance(F.col(f"_c_{p}"), F.col(f"_s_{p}")) for p in cues_}
    per = ordered_means(pairs, [*keys, "_b", "_t", "_row"], moves, [F.desc(f"_o_{o}") for o in order])
    stats = [c for p in cues_ for c in (f"{p}_move", f"{p}_neighbours")]
    return per.select(*keys, F.col("_t").alias("t_us"), *[F.col("_row")[c].alias(c) for c in (*cues_, *rest)], *stats)


def stability(present: Column, move: Column, scale: float, alone: float = 0.35) -> Column:
    """1 when still, 0 at ``scale`` or when the cue is absent, ``alone`` without neighbours."""
    return F.when(~present, 0.0).when(move.isNull(), alone).otherwise(F.greatest(F.lit(0.0), 1.0 - move / scale))


def evidence_score(candidates: DataFrame, samples: DataFrame, keys: Sequence[str], window: int,
                   scales: dict[str, float] | None = None) -> DataFrame:
    """3D cue score of candidate samples with ``gaze, hand, camera`` point columns and ``gaze_valid``."""
    scales = scales or {"gaze": 4.0, "hand": 4.0, "camera": 0.35}
    names = ("gaze", "hand", "camera")
    df = neighbour_stats(candidates, samples, keys, window, names)
    df = df.withColumn("hand_valid", F.col("hand").isNotNull()).withColumn("camera_valid", F.col("camera").isNotNull())
    for n in names:
        df = df.withColumn(f"{n}_stability", stability(F.col(n).isNotNull(), F.col(f"{n}_move"), scales[n]))
    weights = {"gaze": (1.5, 0.8), "hand": (1.1, 0.7), "camera": (0.3, 0.4)}  # fixed values
    score, reasons = F.lit(0.0), []
    for n, (base, gain) in weights.items():
        ok = F.col(f"{n}_valid")
        score = score + F.when(ok, base + gain * F.col(f"{n}_stability")).otherwise(0.0)
        reasons.append(F.when(ok, F.format_string(f"{n}_valid:{n}_stability=%.2f:neighbors=%d",
                                                  f"{n}_stability", f"{n}_neighbours")).otherwise(f"{n}_invalid"))
    return df.withColumn("score", score).withColumn("reason", F.concat_ws(";", *reasons)).drop(*[f"{n}_move" for n in names])


def pixel_score(projected: Column, move_px: Column, camera_move: Column) -> Column:
    """2D cue score: 1 for a projected gaze, up to 0.9 for a still one (0.15 if unknown), up to 0.25 for a still camera."""
    gaze = F.when(move_px.isNull(), 0.15).otherwise(0.9 * F.greatest(F.lit(0.0), 1.0 - move_px / 280.0))
    cam = F.when(camera_move.isNull(), 0.0).otherwise(0.25 * F.greatest(F.lit(0.0), 1.0 - camera_move / 0.35))
    return F.when(projected.isNull(), 0.0).otherwise(1.0 + gaze + cam)


def projected_samples(samples: DataFrame, width_px: int, height_px: int) -> DataFrame:
    """Adds ``gaze_uv`` (the gaze point on the image of its own camera, NULL off it), ``gaze_source`` and ``camera``."""
    s = samples.withColumn("_view", cues.gaze_world_point()).withColumn("camera", cues.whole(F.col("cameraPosition")))
    s = geo.with_projection(s, "gaze_uv", F.col("camera"), F.col("cameraRotation"), "cameraFOV", F.col("_view.point"), width_px, height_px)
    return s.withColumn("gaze_source", F.when(F.col("gaze_uv").isNotNull(), F.col("_view.source"))).drop("_view")


def pixel_stats(candidates: DataFrame, samples: DataFrame, keys: Sequence[str], window: int, width_px: int, height_px: int) -> DataFrame:
    """``gaze_move`` in pixels and ``camera_move`` in world units around each distinct candidate sample (``keys, t_us``).

    Both are means over the samples within ``window`` that carry the cue, NULL without any. A sample that
    serves several events is aggregated once, and only its two cues travel; (key, slice) joins keep a long
    series spread over tasks. Samples are added from the last recorded to the first.
    """
    keys, order = list(keys), _last_first(samples)
    c = candidates.groupBy(*keys, F.col("t_us").alias("_t")).agg(F.any_value("gaze_uv").alias("_uv"), F.any_value("camera").alias("_camera"))
    # no filter on the cues: pushed below the steps of the projection, it would write them out again
    s = samples.select(*keys, F.col("t_us").alias("_u"), *[F.col(o).alias(f"_o_{o}") for o in order], "gaze_uv", "camera")
    pairs = _beside(c, s, keys, window, "inner")
    du, dv = ((F.col("gaze_uv")[a] - F.col("_uv")[a]) * float(n) for a, n in (("u", width_px), ("v", height_px)))
    moves = {"gaze": F.sqrt(du * du + dv * dv), "camera": geo.distance(F.col("camera"), F.col("_camera"))}
    moved = ordered_means(pairs, [*keys, "_b", "_t"], moves, [F.desc(f"_o_{o}") for o in order])
    return moved.select(*keys, F.col("_t").alias("t_us"), "gaze_move", "camera_move")


def panel_score(candidates: DataFrame, samples: DataFrame, keys: Sequence[str], window: int, width_px: int, height_px: int) -> DataFrame:
    """2D cue ``score`` and ``reason`` of candidate samples from ``projected_samples``."""
    keys = list(keys)
    moved = pixel_stats(candidates.filter("gaze_uv IS NOT NULL"), samples, keys, window, width_px, height_px)
    d = candidates.join(moved, [*keys, "t_us"], "left")

    def told_of(name: str, scale: float) -> Column:
        steady = F.greatest(F.lit(0.0), 1.0 - F.col(f"{name}_move") / scale)
        return F.when(F.col(f"{name}_move").isNull(), f"{name}_stability:unknown").otherwise(F.format_string(f"{name}_stability:%.2f", steady))

    told = F.concat_ws(";", F.concat(F.lit("gaze:"), F.col("gaze_source")), told_of("gaze", 280.0), told_of("camera", 0.35))
    reason = F.when(F.col("gaze_uv").isNull(), "no_projected_gaze").otherwise(told)
    return d.withColumn("score", pixel_score(F.col("gaze_uv"), F.col("gaze_move"), F.col("camera_move"))).withColumn("reason", reason).drop("gaze_move", "camera_move")


def spaced_picks(candidates: DataFrame, keys: Sequence[str], k: int, gap: int, score: str = "score", time: str = "t_us") -> DataFrame:
    """Greedy picks by score (the earlier one on a tie), no two closer than ``gap``, at most ``k`` per event, none without a score.

    Each round takes the best candidate left of every event by an aggregate that combines before the
    shuffle, and the next round leaves out what lies too near to the picks so far (at most ``k`` per
    event). No event's candidates are gathered, however long the event is.
    """
    keys = list(keys)
    base = checkpointed(candidates.filter(F.col(score) > 0).withColumn("_neg", -F.col(score)))
    picks = None
    for _ in range(k):
        left = base
        if picks is not None:
            taken = picks.groupBy(*keys).agg(F.collect_list(time).alias("_taken"))
            left = base.join(taken, keys).filter(~F.exists("_taken", lambda t: F.abs(F.col(time) - t) < gap)).drop("_taken")
        best = checkpointed(first_by(left, keys, ["_neg", time]))
        picks = best if picks is None else picks.unionByName(best)
    return picks.drop("_neg")


def select_panels(events: DataFrame, samples: DataFrame, keys: Sequence[str], event_keys: Sequence[str], panels: int, step: float, window: int,
                  gap: int, width: int, size: tuple[int, int] = (1280, 720), strategy: str = "evidence") -> DataFrame:
    """Panels of each event: ``event_keys, panel_index, video_us, t_us, score, reason``, by time.

    ``t_start`` and ``t_end`` are video times, ``offset_us`` is video minus sample time. ``uniform`` spaces the panels
    evenly; ``evidence`` takes the best nearest samples of a dense grid over the part of the window that has samples.
    Events without any positive score, also those without samples, get the uniform panels, marked as fallback.
    """
    keys, event_keys = list(keys), list(event_keys)
    span = (F.col("t_end") - F.col("t_start")) / US

    def uniform(rows: DataFrame, reason: str) -> DataFrame:
        at = explode_grid(rows, uniform_grid(F.lit(0.0), span, panels), "_off")
        video = F.col("t_start") + F.round(F.col("_off") * US).cast("bigint")
        return at.select(*event_keys, video.alias("video_us"), (video - F.col("offset_us")).alias("t_us"),
                         F.lit(0.0).alias("score"), F.lit(reason).alias("reason"), (F.col("grid_index") + 1).alias("panel_index"))

    columns = [*event_keys, "panel_index", "video_us", "t_us", "score", "reason"]
    if strategy == "uniform":
        return uniform(events, "uniform").select(*columns)
    s = projected_samples(samples, *size).select(*keys, "file_seq", "t_us", "gaze_uv", "gaze_source", "camera")
    ends = s.groupBy(*keys).agg(F.min("t_us").alias("_first"), F.max("t_us").alias("_last"))
    ev = events.select(*event_keys, "t_start", "t_end", "offset_us").join(ends, keys)
    low = F.greatest(F.col("_first"), F.col("t_start") - F.col("offset_us"))
    high = F.least(F.col("_last"), F.col("t_end") - F.col("offset_us"))
    # no grid has more points than its steps, both ends and the middle
    counts = ev.select(*keys, (F.floor(F.greatest(high - low, F.lit(0)) / US / step) + 2).alias("n"))
    ev = ev.withColumn("_low", low).withColumn("_grid", dense_grid(F.lit(0.0), (high - low) / US, step))
    targets = ev.select(*event_keys, "t_start", "t_end", "offset_us", "_low", F.explode("_grid").alias("_off"))
    targets = targets.select(*event_keys, "t_start", "t_end", "offset_us", (F.col("_low") + F.round(F.col("_off") * US).cast("bigint")).alias("target_us"))
    near = nearest_sample(targets, s, keys, "target_us", "t_us", "file_seq", ["gaze_uv", "gaze_source", "camera"], width, counts)
    near = near.withColumn("video_us", F.col("t_us") + F.col("offset_us")).filter(F.col("video_us").between(F.col("t_start") - 1, F.col("t_end") + 1))
    cands = near.select(*event_keys, *[k for k in keys if k not in event_keys], "t_us", "video_us", "gaze_uv", "gaze_source", "camera").distinct()
    cands = checkpointed(cands)  # read for the motion around each sample and for the scores
    picked = spaced_picks(panel_score(cands, s, keys, window, *size).select(*event_keys, "t_us", "video_us", "score", "reason"), event_keys, panels, gap)
    by_time = Window.partitionBy(*event_keys).orderBy("video_us")
    chosen = picked.withColumn("panel_index", F.row_number().over(by_time)).select(*columns)
    rest = events.join(picked.select(*event_keys).distinct(), event_keys, "left_anti")
    return chosen.unionByName(uniform(rest, "uniform_fallback:no_positive_evidence").select(*columns))


def _pick(ranked: Column, picked: Column, gap, k: int, ok=lambda c: F.lit(True), once: bool = False) -> Column:
    def step(acc: Column, c: Column) -> Column:
        far = ~F.exists(acc, lambda p: F.abs(p["time"] - c["time"]) < gap)
        return F.when((F.size(acc) < k) & ok(c) & far, F.array_append(acc, c)).otherwise(acc)

    if not once:
        return F.aggregate(ranked, picked, step)
    fits = F.filter(ranked, lambda c: ok(c) & ~F.exists(picked, lambda p: F.abs(p["time"] - c["time"]) < gap))
    return F.when(F.size(picked) < k, F.concat(picked, F.slice(fits, 1, 1))).otherwise(picked)


def _flag(name: str):
    return lambda c: c[name]


def temporal_nms(candidates: DataFrame, keys: Sequence[str], k: int, gap, score: str = "score", time: str = "t_us",
                 payload: Sequence[str] = (), quota: Sequence[str] = (), reserve: str | None = None) -> DataFrame:
    """Greedy picks by score with a minimum time distance, at most ``k``, re-ordered by time.

    ``quota`` columns (booleans) each get one pick first. Rows with ``reserve > 0`` only serve events
    in which nothing else scores above zero; they are then taken as they are. Candidates of an event come from its time grid,
    so a list holds at most duration / step entries.
    """
    keys = list(keys)
    item = F.struct((-F.col(score)).alias("neg"), F.col(time).alias("time"),
                    *[F.col(c) for c in dict.fromkeys([*quota, *payload]) if c not in (time, score)])
    lists = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_ranked"))
    if reserve:
        spare = F.filter("_ranked", lambda c: c[reserve] > 0)
        lists = lists.withColumn("_spare", spare).withColumn("_ranked", F.filter("_ranked", lambda c: c[reserve] == 0))
        lists = lists.withColumn("_ranked", F.filter("_ranked", lambda c: c["neg"] < 0))
    none = F.slice("_ranked", 1, 0)
    lists = lists.withColumn("_picked", none)
    for q in quota:
        lists = lists.withColumn("_picked", _pick(F.col("_ranked"), F.col("_picked"), gap, k, _flag(q), once=True))
    lists = lists.withColumn("_picked", _pick(F.col("_ranked"), F.col("_picked"), gap, k))
    if reserve:
        back = F.transform(F.slice("_spare", 1, k), lambda c: c.withField("neg", F.lit(-0.0)).withField("reason", F.lit("fallback_ratio")))
        lists = lists.withColumn("_picked", F.when(F.size("_ranked") > 0, F.col("_picked")).otherwise(back))
    by_time = F.array_sort(F.transform("_picked", lambda p: F.struct(p["time"].alias("_t"), p.alias("_p"))))
    rows = lists.select(*keys, F.posexplode(by_time).alias("_i", "_e"))
    extra = [c for c in dict.fromkeys([*quota, *payload]) if c not in (time, score)]
    return rows.select(
        *keys, (F.col("_i") + 1).alias("panel_index"), F.col("_e._t").alias(time),
        (-F.col("_e._p.neg")).alias(score), *[F.col("_e._p")[c].alias(c) for c in extra],
    )


def cue_columns(samples: DataFrame) -> DataFrame:
    """Adds ``gaze, hand, camera`` points and ``gaze_valid`` to nested samples."""
    return samples.select(
        "*", cues.gaze_hit().alias("gaze"), cues.hand_hit().alias("hand"),
        F.when(cues.valid_camera(), cues.whole(F.col("cameraPosition"))).alias("camera"),
        (cues.gaze_hit().isNotNull() | cues.gaze_direction().isNotNull()).alias("gaze_valid"),
    )


def candidate_samples(events: DataFrame, samples: DataFrame, keys: Sequence[str], step: float, width: int, payload: Sequence[str],
                      ratios: bool = False) -> DataFrame:
    """Nearest sample of every dense-grid point of each event; a sample found twice counts once.

    With ``ratios`` the 25 / 50 / 75 percent points are looked up in the same pass (``ratio_index`` 1-3).
    """
    span = (F.col("t_end") - F.col("t_start")) / US
    dense = F.transform(dense_grid(F.lit(0.0), span, step), lambda t: F.struct(t.alias("offset"), F.lit(0).alias("ratio_index")))
    if ratios:
        extra = F.transform(ratio_grid(F.lit(0.0), span), lambda t, i: F.struct(t.alias("offset"), (i + 1).alias("ratio_index")))
        dense = F.concat(dense, extra)
    targets = events.select("*", F.inline(dense))
    targets = targets.withColumn("target_us", F.col("t_start") + F.round(F.col("offset") * US).cast("bigint")).drop("offset")
    near = nearest_sample(targets, samples, keys, "target_us", "t_us", "file_seq", payload, width)
    near = near.filter("t_us IS NOT NULL").drop("target_us")
    return dealt(near, [*keys, "t_us"], samples).distinct()


def select_evidence(events: DataFrame, samples: DataFrame, keys: Sequence[str], event_keys: Sequence[str], step: float,
                    window: int, gap: int, max_frames: int, width: int) -> DataFrame:
    """Target-free frames: dense grid, nearest samples, cue score, one gaze and one hand pick, then by score.

    Events whose candidates all score zero fall back to the samples at 25 / 50 / 75 percent.
    """
    with_cues = cue_columns(samples)
    payload = ["file_seq", "gaze", "hand", "camera", "gaze_valid"]
    cands = candidate_samples(events, with_cues, keys, step, width, payload, ratios=True)
    scored = evidence_score(cands, with_cues, keys, window)
    extra = ["file_seq", "gaze", "hand", "camera", "reason", "ratio_index"]
    return temporal_nms(scored, event_keys, max_frames, gap, payload=extra, quota=["gaze_valid", "hand_valid"], reserve="ratio_index").drop("ratio_index")


SEGMENT_CUES = ("file_seq", "gaze", "gaze_origin", "gaze_vector", "hand_hit")


def segment_cues(samples: DataFrame) -> DataFrame:
    """Adds what segments read of nested samples: ``gaze, gaze_origin, gaze_vector, hand_hit`` (right hand not flagged as lost)."""
    def seen(name: str) -> Column:
        p = cues.whole(F.col(f"eyeGaze.{name}"))
        return F.when(geo.nonzero(p), p)

    return samples.select("*", cues.gaze_hit().alias("gaze"), seen("gazeOrigin").alias("gaze_origin"), seen("gazeVector").alias("gaze_vector"),
                          cues.hand_hit("right_not_lost").alias("hand_hit"))


def fill_windows(events: DataFrame, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing ``t_start`` / ``t_end`` become the first / last sample time of the key."""
    ends = samples.groupBy(*keys).agg(F.min("t_us").alias("_first"), F.max("t_us").alias("_last"))
    filled = events.join(ends, list(keys), "left")
    return filled.withColumn("t_start", F.coalesce("t_start", "_first")).withColumn("t_end", F.coalesce("t_end", "_last")).drop("_first", "_last")


def segmented_samples(events: DataFrame, samples: DataFrame, keys: Sequence[str], duration: int, width: int) -> DataFrame:
    """Samples and their half-open ``segment``, counted from the event's start; the last segment ends with the event.

    Events are cut into slices no shorter than a segment, so a long event becomes about as many rows as it has segments.
    Works on a stream of samples too (the events are then a table). Samples without a cue stay: as a filter on nested cues their
    absence would multiply the optimizer's constraints.
    """
    s = inside_samples(events, samples, keys, max(width, duration), SEGMENT_CUES)
    s = s.filter(F.col("t_us") < F.col("t_end")).withColumn("segment", F.floor((F.col("t_us") - F.col("t_start")) / duration))
    start = F.col("t_start") + F.col("segment") * duration
    return s.withColumn("start_us", start).withColumn("end_us", F.least(start + duration, F.col("t_end")))


def eye(c: Column | None = None) -> Column:
    """What is kept of a cue."""
    names = ("t_us", "gaze", "gaze_origin", "gaze_vector")
    return F.struct(*[(F.col(n) if c is None else c[n]).alias(n) for n in names])


def eye_cues(nearest: Column, middle: Column) -> Column:
    """The cue nearest to the best anchor's moment, and the middle one unless it is within a millisecond of the first."""
    return F.when(F.abs(middle["t_us"] - nearest["t_us"]) > US // 1000, F.array(nearest, middle)).otherwise(F.array(nearest))


def timeline_segments(events: DataFrame, samples: DataFrame, anchors: DataFrame, keys: Sequence[str], event_keys: Sequence[str],
                      duration: int, width: int, top: int = 3, slack: float = 0.75) -> DataFrame:
    """Half-open segments anchored at each event's start: ``event_keys, segment, start_us, end_us, t_us, n_gaze, n_hand, best_d, nearest,
    eye_cues, score``.

    Segments need two gaze samples; events without any, scenes without anchors and empty windows give no row. Samples of equal time are
    taken by ``file_seq``. Distances to all anchors are reduced to minima before they leave their task; only the anchors that can be
    among the first ``top`` (ties included) meet the samples a second time, as one short array per segment.
    """
    seg = [*event_keys, "segment"]
    extra = [c for c in ("scene",) if c not in seg]
    s = checkpointed(segmented_samples(events, samples, keys, duration, width).select(*seg, *extra, "start_us", "end_us", "t_us", *SEGMENT_CUES))
    counts = s.groupBy(*seg).agg(F.first("start_us").alias("start_us"), F.first("end_us").alias("end_us"),
                                 F.count("gaze").alias("n_gaze"), F.count("hand_hit").alias("n_hand")).filter("n_gaze >= 2")
    gaze = s.filter("gaze IS NOT NULL")
    a = small_side(anchors.select("scene", "anchor_id", F.struct("x", "y", "z").alias("_a")))
    pairs = gaze.join(a, "scene").select(*seg, "anchor_id", "_a", "t_us", geo.distance("gaze", "_a").alias("d"))
    low = pairs.groupBy(*seg, "anchor_id", "_a").agg(F.min("d").alias("min_d"), F.min_by("t_us", F.struct("d", "t_us")).alias("nearest_us"))
    place = F.rank().over(Window.partitionBy(*seg).orderBy("min_d"))
    first = low.withColumn("_place", place).filter(F.col("_place") <= top)
    short = first.groupBy(*seg).agg(F.collect_list(F.struct("anchor_id", "_a", "min_d", "nearest_us")).alias("_short"))
    again = gaze.select(*seg, "t_us", *SEGMENT_CUES).join(short, seg).select(*seg, "t_us", *SEGMENT_CUES, F.inline("_short"))
    stats = again.groupBy(*seg, "anchor_id", "_a").agg(
        F.first("min_d").alias("min_d"), F.first("nearest_us").alias("nearest_us"),
        F.count_if(geo.distance("gaze", "_a") <= F.col("min_d") + slack).alias("close_frames"),
        F.min_by(eye(), F.struct(F.abs(F.col("t_us") - F.col("nearest_us")), "t_us", "file_seq")).alias("_eye"),
    )
    ranked = top_k(stats, seg, [F.col("min_d"), F.desc("close_frames"), F.col("anchor_id"), F.col("_a.x"), F.col("_a.y"), F.col("_a.z")], top, "anchor_rank")
    best = ranked.groupBy(*seg).agg(
        F.min_by("nearest_us", "anchor_rank").alias("t_us"), F.min("min_d").alias("best_d"), F.min_by("_eye", "anchor_rank").alias("_eye"),
        F.array_sort(F.collect_list(F.struct("anchor_rank", "anchor_id", "min_d", "nearest_us", "close_frames"))).alias("nearest"),
    )
    numbered = bucket_rank(gaze.select(*seg, "t_us", *SEGMENT_CUES), seg, "t_us", "_rank", width, ["file_seq"])
    middle = numbered.join(counts.select(*seg, "n_gaze"), seg).filter(F.col("_rank") == F.floor(F.col("n_gaze") / 2) + 1)
    middle = middle.select(*seg, eye().alias("_middle"))
    out = counts.join(best, seg).join(middle, seg).withColumn("eye_cues", eye_cues(F.col("_eye"), F.col("_middle")))
    out = out.withColumn("score", F.col("n_gaze") / (1.0 + F.col("best_d")))
    return out.select(*seg, "start_us", "end_us", "t_us", "n_gaze", "n_hand", "best_d", "nearest", "eye_cues", "score")


def segment_gap(duration: int) -> int:
    return max(US // 4, duration * 3 // 4)


def dwell_segments(samples: DataFrame, keys: Sequence[str], width: int, shortest: int, longest: int) -> DataFrame:
    """Time to the next sample (of any validity), clamped; the last sample of a key gets the minimum."""
    timed = bucket_lead(samples, keys, "t_us", ["file_seq"], width, "_next")
    gap = F.when(F.col("_next").isNull(), F.lit(shortest)).otherwise(
        F.greatest(F.lit(shortest), F.least(F.lit(longest), F.col("_next") - F.col("t_us")))
    )
    return timed.withColumn("dwell_us", gap).drop("_next")


def representative_rows(rows: DataFrame, keys: Sequence[str], k: int, width: int) -> DataFrame:
    """Rows at ``k`` evenly spread positions of each ordered group, found by rank instead of by list."""
    keys = list(keys)
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = bucket_rank(rows, keys, "t_us", "_rank", width, ["file_seq"]).join(n, keys)
    step = (F.col("_n") - 1) / F.lit(float(max(k - 1, 1)))
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(step * i).cast("bigint"))
    wanted = F.when(F.col("_n") <= k, F.array(F.col("_rank") - 1)).otherwise(
        spread if k > 1 else F.array(F.floor(F.col("_n") / 2))
    )
    return ranked.filter(F.array_contains(wanted, F.col("_rank") - 1)).withColumn("position", F.col("_rank") - 1).drop("_rank", "_n")


def window_summary(rows: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Counts, eye and hand tracking totals, mean camera position, mean joint counts and the middle non-zero ray hit."""
    keys = list(keys)
    joints = [F.size(f"handData.{side}.joints") for side in ("leftHand", "rightHand")]
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), F.count_if("eyeGaze.isEyeOpen").alias("eye_open_count"),
        F.count_if("handData.isLeftHandTracked").alias("left_tracked"), F.count_if("handData.isRightHandTracked").alias("right_tracked"),
        *[F.avg(f"cameraPosition.{a}").alias(f"mean_camera_{a}") for a in "xyz"],
        *[F.coalesce(F.avg(F.when(j >= 0, j)), F.lit(0.0)).alias(f"mean_{n}_joints") for n, j in zip(("left", "right"), joints)],
    )
    hits = rows.withColumn("_hit", cues.whole(F.col("handData.rightIndexFingerRayHitPoint"))).filter(geo.nonzero(F.col("_hit")))
    n = hits.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = bucket_rank(hits.select(*keys, "t_us", "file_seq", "_hit"), keys, "t_us", "_rank", width, ["file_seq"])
    middle = ranked.join(n, keys).filter(F.col("_rank") - 1 == F.floor(F.col("_n") / 2))
    return base.join(middle.select(*keys, F.col("_hit").alias("middle_hit")), keys, "left")


def spatial_prior(rows: DataFrame, keys: Sequence[str], sources: dict[str, Column], width_px: int, height_px: int, slice_us: int) -> DataFrame:
    """First source, in order, with any projectable sample: median u and v, its middle world point and the count."""
    keys = list(keys)
    stacked = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("source"), p.alias("point")) for i, (n, p) in enumerate(sources.items())])
    flat = rows.select(*keys, "t_us", "file_seq", "cameraPosition", "cameraRotation", "cameraFOV", F.explode(stacked).alias("_s"))
    uv = geo.project_point("cameraPosition", "cameraRotation", "cameraFOV", F.col("_s.point"), width_px, height_px)
    hit = flat.select(*keys, "t_us", "file_seq", "_s.*", uv.alias("uv")).filter("point IS NOT NULL AND uv IS NOT NULL")
    hit = hit.select(*keys, "t_us", "file_seq", "rank", "source", "point", F.col("uv.u").alias("u"), F.col("uv.v").alias("v"))
    best = hit.groupBy(*keys).agg(F.min("rank").alias("rank"))
    # projected once; counts, medians and ranks read these few columns
    used = checkpointed(hit.join(best, [*keys, "rank"]))
    n = used.groupBy(*keys, "source").agg(F.count("*").alias("sample_count"))
    uv = exact_quantiles(used, keys, {"u_norm": ("u", 0.5), "v_norm": ("v", 0.5)})
    ranked = bucket_rank(used.select(*keys, "t_us", "file_seq", "point"), keys, "t_us", "_rank", slice_us, ["file_seq"])
    middle = ranked.join(n, keys).filter(F.col("_rank") - 1 == F.floor(F.col("sample_count") / 2))
    return n.join(uv, keys).join(middle.select(*keys, "point"), keys)


def clock_offset(df: DataFrame, strategy: str = "hybrid", threshold: float = 1.0, bias: float = 0.5, manual: float = 0.0) -> DataFrame:
    """Seconds between the capture clock and the first sample, with the rule that was used.

    Needs ``first_us, meta_us, video_us``.
    """
    meta, video = F.col("meta_us"), F.col("video_us")
    delta = (meta - video) / US
    shift = int(bias * US)
    if strategy == "metadata":
        start, rule = meta, F.when(meta.isNotNull(), "metadata")
    elif strategy == "video_filename":
        start, rule = video, F.when(video.isNotNull(), "video_filename")
    else:
        start = (F.when(meta.isNull(), video).when(video.isNull() | (F.abs(delta) <= threshold), meta)
                 .when(delta < 0, video - shift).otherwise(video + shift))
        rule = (F.when(meta.isNull() & video.isNull(), None).when(meta.isNull(), "fallback_video_no_metadata")
                .when(video.isNull(), "fallback_metadata_no_video_time").when(F.abs(delta) <= threshold, "metadata_within_threshold")
                .when(delta < 0, "metadata_early_use_video_minus_bias").otherwise("metadata_late_use_video_plus_bias"))
    offset = F.coalesce((F.col("first_us") - start) / US, F.lit(0.0)) + manual
    source = F.when(F.col("first_us").isNull(), "no_sample_timestamp").otherwise(F.coalesce(rule, F.lit("no_metadata_or_video_time")))
    return df.withColumn("offset_seconds", offset).withColumn("offset_source", source)


def event_payload(events: DataFrame, peaks: DataFrame, window: DataFrame, representatives: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nested event record: peak sample, up to five samples around it, three representative ones."""
    keys = list(keys)
    sample = F.struct("t_us", "file_seq", "gaze", "hand", "camera")
    near = top_k(window, keys, [F.col("t_us"), F.col("file_seq")], 5)
    around = near.groupBy(*keys).agg(F.array_sort(F.collect_list(sample)).alias("peak_window_samples"))
    rep = representatives.groupBy(*keys).agg(F.array_sort(F.collect_list(sample)).alias("representative_samples"))
    peak = peaks.select(*keys, sample.alias("peak"))
    return events.join(peak, keys, "left").join(around, keys, "left").join(rep, keys, "left")


def annotation_template(media: DataFrame, peak_ratio: float = 0.5) -> DataFrame:
    """``t_start = 0, t_end = duration, t_peak = ratio * duration`` clamped into the clip."""
    peak = F.greatest(F.lit(0.0), F.least(F.col("duration"), F.col("duration") * peak_ratio))
    return media.select("*", F.lit(0.0).alias("t_start"), peak.alias("t_peak"), F.col("duration").alias("t_end"))


def hand_boxes(samples: DataFrame, ids: Sequence[str], width: int, height: int, world_margin: float = 0.10,
               low: float = 48.0, high: float = 360.0) -> DataFrame:
    """Boxes around projected joints of tracked hands, one row per sample with both sides and the masked fraction."""
    focal = geo.focal_pixels(F.col("cameraFOV"), height)
    out = samples
    for side, flag in (("leftHand", "isLeftHandTracked"), ("rightHand", "isRightHandTracked")):
        joints = F.when(F.coalesce(F.col(f"handData.{flag}"), F.lit(False)), F.col(f"handData.{side}.joints"))
        seen = F.filter(F.transform(joints, lambda j: geo.project_point(
            "cameraPosition", "cameraRotation", "cameraFOV", j["position"], width, height, "tolerant")), lambda p: p.isNotNull())
        out = out.withColumn(f"_{side}", seen)
        xs, ys = F.transform(f"_{side}", lambda p: p["u"] * float(width)), F.transform(f"_{side}", lambda p: p["v"] * float(height))
        depth = F.array_min(F.col(f"_{side}")["depth"])
        margin = F.greatest(F.lit(low), F.least(F.lit(high), focal * world_margin / F.greatest(depth, F.lit(0.05))))
        edge = [
            F.greatest(F.lit(0.0), F.array_min(xs) - margin), F.greatest(F.lit(0.0), F.array_min(ys) - margin),
            F.least(F.lit(float(width)), F.array_max(xs) + margin), F.least(F.lit(float(height)), F.array_max(ys) + margin),
        ]
        box = F.struct(*[F.round(e, 2).alias(n) for e, n in zip(edge, ("x1", "y1", "x2", "y2"))])
        ok = (F.size(f"_{side}") > 0) & (edge[2] > edge[0]) & (edge[3] > edge[1])
        out = out.withColumn(f"{side}_box", F.when(ok, box))
    tracked = F.coalesce(F.col("handData.isLeftHandTracked"), F.lit(False)) | F.coalesce(F.col("handData.isRightHandTracked"), F.lit(False))

    def corner(box: Column, name: str, top: int) -> Column:
        return F.least(F.bround(box[name]), F.lit(float(top)))

    def area(x1, y1, x2, y2) -> Column:
        return F.greatest(F.lit(0.0), x2 - x1 + 1) * F.greatest(F.lit(0.0), y2 - y1 + 1)

    a, b = ([corner(F.col(f"{s}_box"), n, t) for n, t in (("x1", width - 1), ("y1", height - 1), ("x2", width - 1), ("y2", height - 1))]
            for s in ("leftHand", "rightHand"))
    overlap = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    both = F.col("leftHand_box").isNotNull() & F.col("rightHand_box").isNotNull()
    # least/greatest skip NULLs, so a missing box must be ruled out explicitly
    one = [F.when(F.col(f"{s}_box").isNotNull(), area(*c)).otherwise(0.0) for s, c in (("leftHand", a), ("rightHand", b))]
    pixels = one[0] + one[1] - F.when(both, overlap).otherwise(0.0)
    status = F.when(pixels > 0, "masked").when(~tracked, "no_tracked_hand").otherwise("tracked_offscreen")
    return out.select(*ids, "leftHand_box", "rightHand_box", (pixels / float(width * height)).alias("mask_fraction"), status.alias("status"))


def mask_stats(boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean / median / maximum mask fraction and how often a quarter or half of the image is masked."""
    # written once: the box arithmetic is a large expression, and its four readers would each carry it through the optimizer
    boxes = checkpointed(boxes.select(*by, "mask_fraction", "status"))
    base = boxes.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("masked", "no_tracked_hand", "tracked_offscreen")],
        F.avg("mask_fraction").alias("mean_fraction"), F.max("mask_fraction").alias("max_fraction"),
        F.count_if(F.col("mask_fraction") > 0.25).alias("over_25"), F.count_if(F.col("mask_fraction") > 0.5).alias("over_50"),
    )
    return base.join(exact_quantiles(boxes, by, {"median_fraction": ("mask_fraction", 0.5)}), list(by), "left")


def first_sample(samples: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return first_by(samples, keys, ["t_us", "file_seq"])
