"""Deterministic cue baselines: radius dedup, gaze-hand fusion, prediction tables.

Point lists come from selected evidence frames, so they hold at most ``max_frames`` points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundmetrics.functions import geometry as geo

POINT = "struct<x:double,y:double,z:double>"


def valid_points(frames: Column, point: str, flag: str) -> Column:
    """Points of the frames whose validity flag is not false."""
    used = F.filter(frames, lambda f: ~f[flag].eqNullSafe(False) & f[point].isNotNull())
    return F.transform(used, lambda f: f[point])


def radius_dedup(points: Column, radius: float, k: int) -> Column:
    """Keep a point unless an already kept one is closer than ``radius``; at most ``k``."""
    def step(kept: Column, p: Column) -> Column:
        near = F.exists(kept, lambda q: geo.distance(p, q) < radius)
        return F.when(near | (F.size(kept) >= k), kept).otherwise(F.array_append(kept, p))

    return F.aggregate(points, F.array().cast(f"array<{POINT}>"), step)


def fuse_points(gaze: Column, hand: Column, radius: float, k: int) -> Column:
    """Average each gaze point with the nearest unused hand point within ``max(1, 2 * radius)``.

    Unmatched points stay as they are, leftovers of the hand follow, and the result is deduplicated.
    """
    limit = max(1.0, 2.0 * radius)
    start = F.struct(F.array().cast(f"array<{POINT}>").alias("out"), F.array().cast("array<int>").alias("used"))

    def step(state: Column, g: Column) -> Column:
        scored = F.transform(hand, lambda h, i: F.struct(geo.distance(g, h).alias("d"), i.alias("i"), h.alias("h")))
        free = F.filter(scored, lambda s: ~F.array_contains(state["used"], s["i"]))
        best = F.array_min(F.transform(free, lambda s: F.struct(s["d"].alias("d"), s["i"].alias("i"))))
        take = best.isNotNull() & (best["d"] <= limit)
        h = F.get(hand, best["i"])
        mean = F.struct(*[((g[a] + h[a]) / 2.0).alias(a) for a in "xyz"])
        return F.struct(
            F.array_append(state["out"], F.when(take, mean).otherwise(g)).alias("out"),
            F.when(take, F.array_append(state["used"], best["i"])).otherwise(state["used"]).alias("used"),
        )

    # a one-element transform binds the walked state once
    def finish(state: Column) -> Column:
        rest = F.filter(F.transform(hand, lambda h, i: F.when(~F.array_contains(state["used"], i), h)), lambda h: h.isNotNull())
        return F.concat(state["out"], rest)

    walked = F.transform(F.array(F.aggregate(gaze, start, step)), finish)
    return radius_dedup(F.get(walked, 0), radius, k)


def cue_baselines(evidence: DataFrame, radius: float, k: int) -> DataFrame:
    """Three prediction tables from one pass over the evidence rows (``frames`` array per interaction)."""
    gaze = radius_dedup(valid_points(F.col("frames"), "gaze", "gaze_valid"), radius, k)
    hand = radius_dedup(valid_points(F.col("frames"), "hand", "hand_valid"), radius, k)
    df = evidence.withColumn("_gaze", gaze).withColumn("_hand", hand)
    df = df.withColumn("_fused", fuse_points(F.col("_gaze"), F.col("_hand"), radius, k))
    methods = F.array(*[
        F.struct(F.lit(n).alias("method"), F.col(c).alias("points"))
        for n, c in (("gaze_copy", "_gaze"), ("hand_copy", "_hand"), ("gaze_hand_fusion", "_fused"))
    ])
    keys = [c for c in evidence.columns if c != "frames"]
    rows = df.select(*keys, F.inline(methods))
    entries = F.transform("points", lambda p: F.struct(F.col("method").alias("referent"), p.alias("point"), F.lit(0.5).alias("confidence")))
    return rows.select(*keys, "method", "points", F.to_json(F.struct(entries.alias("points_3d"))).alias("parsed_json"))


