"""3D point scoring: assignment, nearest-anchor sets, margin and scene-normalised errors, angles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundmetrics.functions import geometry as geo
from groundmetrics.operators.nearest import nearest_anchor, nearest_negative, robust_bounds
from groundmetrics.operators.scale import exact_quantiles, small_side, top_k
from groundmetrics.operators.sets import KEY, prf, ratio
from groundmetrics.session import checkpointed

EXACT_LIMIT = 14
PAIRS = "array<struct<pred_seq:bigint,gt_seq:bigint,cost:double>>"


def min_cost_rows(cost: np.ndarray | Sequence[Sequence[float]]) -> list[int]:
    """Column of each row in a minimum-cost assignment (rows <= columns), by shortest augmenting paths.

    At most ``EXACT_LIMIT`` points a side: plain numbers are faster here than arrays of that length.
    """
    cost = cost.tolist() if isinstance(cost, np.ndarray) else cost
    n, m = len(cost), len(cost[0])
    u, v = [0.0] * n, [0.0] * m
    owner = [-1] * m
    inf = float("inf")
    for i in range(n):
        dist, back = [inf] * m, [-1] * m
        done = [False] * m
        row, col = i, -1
        base = 0.0
        while row >= 0:
            costs, low = cost[row], u[row]
            best, at = inf, -1
            for c in range(m):
                if not done[c]:
                    step = base + costs[c] - low - v[c]
                    if step < dist[c]:
                        dist[c], back[c] = step, col
                    if at < 0 or dist[c] < best:
                        best, at = dist[c], c
            col, base = at, best
            done[col] = True
            row = owner[col]
        for c in range(m):
            if done[c]:
                if owner[c] >= 0:
                    u[owner[c]] += base - dist[c]
                v[c] -= base - dist[c]
        u[i] += base
        while col >= 0:
            before = back[col]
            owner[col] = owner[before] if before >= 0 else i
            col = before
    out = [-1] * n
    for c, r in enumerate(owner):
        if r >= 0:
            out[r] = c
    return out


def assign_pairs(pred: Sequence[int], gt: Sequence[int], cost: Sequence[float], n_pred: int, n_gt: int) -> list[tuple]:
    """Match one interaction: minimum total cost up to ``EXACT_LIMIT`` per side, cheapest-first beyond."""
    if max(n_pred, n_gt) > EXACT_LIMIT:
        used_p, used_g, out = set(), set(), []
        for c, p, g in sorted(zip(cost, pred, gt)):
            if p not in used_p and g not in used_g:
                used_p.add(p)
                used_g.add(g)
                out.append((p, g, c))
        return out
    ps, gs = sorted(set(pred)), sorted(set(gt))
    if min(len(ps), len(gs)) == 1:
        c, p, g = min(zip(cost, pred, gt))
        return [(p, g, c)]
    at_p, at_g = {p: i for i, p in enumerate(ps)}, {g: i for i, g in enumerate(gs)}
    rest = sum(cost) + 1.0
    turned = len(ps) > len(gs)
    rows, cols, at_r, at_c = (gs, ps, at_g, at_p) if turned else (ps, gs, at_p, at_g)
    grid = [[rest] * len(cols) for _ in rows]
    for p, g, c in zip(pred, gt, cost):
        r, k = (g, p) if turned else (p, g)
        grid[at_r[r]][at_c[k]] = c
    pairs = enumerate(min_cost_rows(grid))
    if turned:
        return [(cols[c], rows[r], grid[r][c]) for r, c in pairs]
    return [(rows[r], cols[c], grid[r][c]) for r, c in pairs]


def _assign(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for *lists, n_pred, n_gt in batches:
        yield pd.Series([
            [{"pred_seq": p, "gt_seq": g, "cost": c} for p, g, c in assign_pairs(ps.tolist(), gs.tolist(), cs.tolist(), int(a), int(b))]
            for ps, gs, cs, a, b in zip(*lists, n_pred, n_gt)
        ])


def assign_min_cost(costs: DataFrame, max_gt: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Assignment per interaction from ``keys, pred_seq, gt_seq, cost`` rows.

    Only the ``max_gt`` cheapest predictions of a GT point can be matched to it (with more predictions
    than that, one of the cheaper ones is always free), so each list below holds at most
    ``max_gt * max_gt`` entries even if one interaction owns a third of all predictions.
    """
    keys = list(keys)
    n = costs.groupBy(*keys, "gt_seq").agg(F.count("*").alias("_np"))
    sizes = n.groupBy(*keys).agg(F.max("_np").alias("n_pred"), F.count("*").alias("n_gt"))
    near = top_k(costs, [*keys, "gt_seq"], [F.col("cost"), F.col("pred_seq")], max_gt)
    lists = near.groupBy(*keys).agg(F.collect_list(F.struct("pred_seq", "gt_seq", "cost")).alias("_pairs"))
    solved = lists.join(sizes, keys).withColumn("pairs", F.pandas_udf(_assign, PAIRS)("_pairs.pred_seq", "_pairs.gt_seq", "_pairs.cost", "n_pred", "n_gt"))
    return solved.select(*keys, "n_pred", "n_gt", "pairs")


def anchor_set_metrics(keys: DataFrame, preds: DataFrame, gt_points: DataFrame, anchors: DataFrame) -> DataFrame:
    """Nearest-anchor set scores per interaction; *exact* also needs that no anchor was hit twice."""
    near = nearest_anchor(preds, anchors).select(*KEY, F.col("nearest_id").alias("id"), F.lit(0).alias("g"), F.lit(1).alias("p"))
    gt = gt_points.select(*KEY, F.col("anchor_id").alias("id"), F.lit(1).alias("g"), F.lit(0).alias("p"))
    per_id = near.unionByName(gt).groupBy(*KEY, "id").agg(F.max("g").alias("g"), F.sum("p").alias("n"))
    hit = (F.col("g") == 1) & (F.col("n") > 0)
    per = per_id.groupBy(*KEY).agg(
        F.count_if(hit).alias("tp"), F.count_if((F.col("g") == 0) & (F.col("n") > 0)).alias("fp"),
        F.count_if((F.col("g") == 1) & (F.col("n") == 0)).alias("fn"), F.sum("n").alias("pred_count"),
        F.sum("g").alias("gt_count"),
    )
    rows = keys.select(*KEY).join(per, KEY, "left").fillna(0)
    p, r, f1 = prf("tp", "fp", "fn", 0.0)
    dup = F.col("pred_count") - F.col("tp") - F.col("fp")
    return rows.select(
        "*", p.alias("precision"), r.alias("recall"), f1.alias("f1"), dup.alias("duplicate_count"),
        ((F.col("fp") == 0) & (F.col("fn") == 0) & (dup == 0)).alias("exact"),
        F.abs(F.col("pred_count") - F.col("gt_count")).alias("cardinality_error"),
    )


def gt_margins(gt: DataFrame, anchors: DataFrame) -> DataFrame:
    """``gt_count`` and the GT items with a defined ``margin`` (half the distance to the closest other anchor)."""
    rows = nearest_negative(gt, anchors)
    items = F.transform("gt", lambda g: F.struct(g["gt_seq"].alias("gt_seq"), g["point"].alias("point"), (0.5 * g["negative"]).alias("margin")))
    defined = F.filter(items, lambda g: g["margin"] > 1e-12)
    return rows.select(*KEY, F.size("gt").cast("bigint").alias("gt_count"), defined.alias("defined"))


def _pair_costs(preds: DataFrame, gt_rows: DataFrame, cost) -> DataFrame:
    """Prediction x GT costs inside an interaction; the GT side is a set of inventory objects."""
    joined = gt_rows.join(preds.select(*KEY, "pred_seq", "x", "y", "z"), KEY)
    d = geo.distance((F.col("x"), F.col("y"), F.col("z")), F.col("point"))
    return joined.select(*KEY, "pred_seq", "gt_seq", cost(d).alias("cost"))


def margin_metrics(keys: DataFrame, preds: DataFrame, gt: DataFrame, anchors: DataFrame, max_gt: int,
                   thresholds: Sequence[float] = (0.5, 1.0, 2.0)) -> DataFrame:
    """Margin-normalised matching per interaction: counts and F1 at each threshold, plus the error lists."""
    # written once: unnesting the list would repeat the search for negatives in the filters that Spark derives, and two joins read it
    items = checkpointed(gt_margins(gt, anchors))
    n_pred = preds.groupBy(*KEY).agg(F.count("*").alias("pred_count"))
    costs = _pair_costs(preds, items.select(*KEY, F.inline("defined")), lambda d: d / (F.col("margin") + 1e-12))
    solved = assign_min_cost(costs, max_gt).select(*KEY, "pairs")
    rows = keys.select(*KEY).join(items, KEY, "left").join(n_pred, KEY, "left").join(solved, KEY, "left")
    rows = rows.withColumn("defined_gt", F.greatest(F.size("defined"), F.lit(0)).cast("bigint")).fillna(0, ["gt_count", "defined_gt", "pred_count"])
    empty = F.array().cast("array<double>")
    margins = F.map_from_entries(F.transform("defined", lambda g: F.struct(g["gt_seq"], g["margin"])))
    rows = rows.withColumn("_m", margins)
    errors = F.coalesce(F.col("pairs")["cost"], empty)
    euclid = F.coalesce(F.transform("pairs", lambda p: p["cost"] * (F.element_at("_m", p["gt_seq"]) + 1e-12)), empty)
    rows = rows.withColumn("margin_errors", errors).withColumn("euclidean_errors", euclid)
    out = rows.withColumn("undefined_gt", F.col("gt_count") - F.col("defined_gt"))
    names = []
    for t in thresholds:
        tag = str(t).replace(".", "_")
        tp = F.size(_up_to("margin_errors", t)).cast("bigint")
        out = out.withColumn(f"tp_{tag}", tp)
        # no prediction: no FP; predictions without any defined GT: all of them are FP
        out = out.withColumn(f"fp_{tag}", F.col("pred_count") - F.col(f"tp_{tag}"))
        out = out.withColumn(f"fn_{tag}", F.col("defined_gt") - F.col(f"tp_{tag}"))
        out = out.withColumn(f"f1_{tag}", prf(f"tp_{tag}", f"fp_{tag}", f"fn_{tag}", 0.0)[2])
        names += [f"{m}_{tag}" for m in ("tp", "fp", "fn", "f1")]
    return out.select(*KEY, "gt_count", "pred_count", "undefined_gt", *names, "margin_errors", "euclidean_errors")


def _up_to(errors: str, threshold: float) -> Column:
    return F.filter(errors, lambda e: e <= threshold)


def scene_norm_errors(preds: DataFrame, gt: DataFrame, anchors: DataFrame, max_gt: int) -> DataFrame:
    """Euclidean assignment errors divided by the scene's robust diagonal."""
    items = gt.select(*KEY, F.inline("gt"))
    solved = assign_min_cost(_pair_costs(preds, items, lambda d: d), max_gt)
    diag = small_side(robust_bounds(anchors).select("scene", "robust_diagonal")).filter("robust_diagonal > 1e-12")
    joined = solved.join(diag, "scene")
    errors = F.transform("pairs", lambda p: p["cost"] / F.col("robust_diagonal"))
    return joined.select(*KEY, errors.alias("scene_norm_errors"))


def point_summary(detail: DataFrame, by: Sequence[str]) -> DataFrame:
    """3D summary: rates from rows, means and exact medians over the flattened error lists."""
    by = list(by)
    # written once: the assignment behind it would otherwise run for every mean, size check and median below
    detail = checkpointed(detail)
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    p, r, f1 = prf(tp, fp, fn, 0.0)
    margin_f1 = [
        prf(F.sum(f"tp_{t}"), F.sum(f"fp_{t}"), F.sum(f"fn_{t}"), 0.0)[2].alias(f"margin_f1_{t}") for t in ("0_5", "1_0", "2_0")
    ]
    rates = detail.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("parse_ok").alias("valid"),
        p.alias("precision"), r.alias("recall"), f1.alias("f1"),
        F.avg(F.col("exact").cast("double")).alias("exact_rate"), F.avg("cardinality_error").alias("mean_cardinality_error"),
        (F.sum("duplicate_count") / F.greatest(F.lit(1), F.sum("pred_count"))).alias("duplicate_rate"),
        F.sum("undefined_gt").alias("undefined_gt"), *margin_f1,
    )
    out = rates
    for c in ("margin_errors", "euclidean_errors", "scene_norm_errors"):
        name = c.removesuffix("_errors")
        flat = detail.select(*by, F.explode(c).alias("e"))
        median = exact_quantiles(flat, by, {f"median_{name}": ("e", 0.5)})
        out = out.join(flat.groupBy(*by).agg(F.avg("e").alias(f"mean_{name}")), by, "left").join(median, by, "left")
    return out


def directional_match(rows: DataFrame) -> DataFrame:
    """Smallest angle between the predicted ray and the rays to the GT anchors.

    Needs ``parse_ok, camera, point, gt``; adds ``angle_deg, matched_id, invalid_reason``.
    """
    scored = F.filter(
        F.transform("gt", lambda g: F.struct(
            geo.angular_error_deg(F.col("camera"), F.col("point"), g["point"]).alias("angle"),
            g["gt_seq"].alias("gt_seq"), g["id"].alias("id"))),
        lambda s: s["angle"].isNotNull(),
    )
    rows = rows.withColumn("_best", F.array_min(scored))
    reason = (
        F.when(~F.col("parse_ok"), "parse_invalid")
        .when(F.col("point").isNull(), "missing_point")
        .when(F.col("camera").isNull(), "missing_camera")
        .when(F.coalesce(F.size("gt"), F.lit(0)) <= 0, "missing_gt_anchors")
        .when(F.col("_best").isNull(), "degenerate_camera_or_gt_direction")
        .otherwise("")
    )
    ok = F.col("invalid_reason") == ""
    return (
        rows.withColumn("invalid_reason", reason)
        .withColumn("angle_deg", F.when(ok, F.col("_best.angle")))
        .withColumn("matched_id", F.when(ok, F.col("_best.id")))
        .drop("_best")
    )


def angular_accuracy(rows: DataFrame, by: Sequence[str], thresholds: Sequence[int] = (5, 10, 15, 20, 30)) -> DataFrame:
    err = F.col("angle_deg")
    n, valid = F.count("*"), F.count(err)
    cols: list[Column] = []
    for t in thresholds:
        hits = F.count_if(err <= t)
        cols += [ratio(hits, n, 0.0).alias(f"acc_at_{t}_all"), ratio(hits, valid, 0.0).alias(f"acc_at_{t}_valid")]
    rates = rows.groupBy(*by).agg(
        n.alias("total"), valid.alias("valid"), ratio(valid, n, 0.0).alias("valid_rate"),
        F.avg(err).alias("mean_error_deg"), *cols,
    )
    return rates.join(exact_quantiles(rows, by, {"median_error_deg": ("angle_deg", 0.5)}), list(by), "left")


def distinct_gt_points(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Distinct (name, rounded coordinates) of an event, first occurrence kept; rows without coordinates drop out."""
    full = rows.filter("anchor_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    rounded = [F.round(a, digits).alias(f"_{a}") for a in "xyz"]
    first = full.select("*", *rounded).groupBy(*KEY, "anchor_id", "_x", "_y", "_z").agg(
        F.min("gt_seq").alias("gt_seq"), *[F.min_by(a, "gt_seq").alias(a) for a in "xyz"]
    )
    return first.drop("_x", "_y", "_z")
