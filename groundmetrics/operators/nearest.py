"""Nearest-anchor lookups.

Scene inventories are small, so a scene travels as one broadcast row holding its anchor array and each
point is resolved in place: no exploded pairs and no shuffle. Inventories above ``SCENE_ANCHORS`` take
``nearest_by_cells`` instead, an exact descent through nested grid cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundmetrics.functions import geometry as geo
from groundmetrics.functions.text import let
from groundmetrics.operators.scale import BROADCAST_ROWS, _size_checks, top_k

SCENE_ANCHORS = 512


def scene_arrays(anchors: DataFrame) -> DataFrame:
    """One row per scene with its anchors in inventory order."""
    item = F.struct("anchor_seq", "anchor_id", "x", "y", "z")
    return anchors.groupBy("scene").agg(F.array_sort(F.collect_list(item)).alias("anchors"))


def fits_in_arrays(anchors: DataFrame, per_scene: int = SCENE_ANCHORS, total: int = BROADCAST_ROWS) -> bool:
    """Size check behind the array form: anchors of the largest scene, and anchors overall."""
    key = (anchors.sparkSession.sparkContext.applicationId, anchors.semanticHash(), per_scene, total)
    if key not in _size_checks:
        sizes = anchors.groupBy("scene").agg(F.count("*").alias("n"))
        largest, overall = sizes.agg(F.max("n"), F.sum("n")).first()
        _size_checks[key] = (largest or 0) <= per_scene and (overall or 0) <= total
    return _size_checks[key]


def with_inventory(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """Attach the scene's anchor array; refuses inventories that do not fit (use ``nearest_by_cells``)."""
    if not fits_in_arrays(anchors):
        raise ValueError("inventory too large for array form")
    return df.join(F.broadcast(scene_arrays(anchors)), "scene", "left")


def closest(anchors: Column, point) -> Column:
    """``STRUCT<dist, anchor_id>`` of the closest anchor; the first in inventory order on a tie."""
    p = geo.vec(point)
    return let(F.transform(anchors, lambda a: geo.distance(a, p)), lambda ds: let(F.array_min(ds), lambda d: F.struct(
        d.alias("dist"), F.get(anchors, (F.array_position(ds, d) - 1).cast("int"))["anchor_id"].alias("anchor_id"))))


def nearest_anchor(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adds ``nearest_id`` and ``nearest_dist`` to points with ``scene, x, y, z``."""
    if not fits_in_arrays(anchors):
        return nearest_by_cells(points, anchors)
    joined = with_inventory(points, anchors)
    best = joined.withColumn("_best", closest(F.col("anchors"), (F.col("x"), F.col("y"), F.col("z"))))
    return best.select(*points.columns, F.col("_best.anchor_id").alias("nearest_id"), F.col("_best.dist").alias("nearest_dist"))


AXES = ("x", "y", "z")


def _cells(anchors: DataFrame, levels: int, fan: int) -> DataFrame:
    """Anchors with their nested cells ``_c0`` ... ``_c<levels>``, ``fan`` per axis and level, inside the scene's box."""
    box = anchors.groupBy("scene").agg(*[f(a).alias(f"_{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])

    def cell(level: int) -> Column:
        n = fan ** level
        span = lambda a: F.greatest(F.col(f"_hi{a}") - F.col(f"_lo{a}"), F.lit(1e-12))
        parts = [F.least(F.floor((F.col(a) - F.col(f"_lo{a}")) / span(a) * n), F.lit(n - 1)) for a in AXES]
        return F.concat_ws("/", *[p.cast("string") for p in parts])

    return anchors.join(box, "scene").select("scene", "anchor_seq", "anchor_id", *AXES, *[cell(i).alias(f"_c{i}") for i in range(levels + 1)])


def k_nearest_by_cells(points: DataFrame, anchors: DataFrame, levels: int = 5, fan: int = 4) -> DataFrame:
    """(scene, x, y, z, neighbours) for points with their own ``k``: the k nearest anchors, closest first (ties in inventory order).

    Inventories may have any size. Anchors are bucketed into nested cells. Points walk down level by level: the cells whose largest
    possible distances come first and that together hold k anchors set a limit, and a cell stays a candidate only while its smallest
    possible distance does not exceed it. Every step is an equi-join on (scene, cell) and a running count over a point's few candidates.
    Fewer than k anchors in the scene: all of them. Of equal points the largest ``k`` counts.
    """
    celled = _cells(anchors, levels, fan)
    point = ["scene", *AXES]
    frontier = points.groupBy(*point).agg(F.max("k").alias("k")).withColumn("_cell", F.lit("0/0/0"))
    for level in range(1, levels + 1):
        boxes = celled.groupBy("scene", F.col(f"_c{level - 1}").alias("_cell"), F.col(f"_c{level}").alias("_child")).agg(
            F.count("*").alias("_n"), *[f(a).alias(f"_b_{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
        near, far = F.lit(0.0), F.lit(0.0)
        for a in AXES:
            lo, hi, p = F.col(f"_b_lo{a}"), F.col(f"_b_hi{a}"), F.col(a)
            gap, reach = F.greatest(F.lit(0.0), lo - p, p - hi), F.greatest(F.abs(p - lo), F.abs(hi - p))
            near, far = near + gap * gap, far + reach * reach
        cand = frontier.join(boxes, ["scene", "_cell"]).select(*point, "k", "_child", "_n", near.alias("_near"), far.alias("_far"))
        per = Window.partitionBy(*point)
        held = F.sum("_n").over(per.orderBy("_far", "_child").rowsBetween(Window.unboundedPreceding, 0))
        limit = F.min(F.when(F.col("_held") >= F.col("k"), F.col("_far"))).over(per)
        cand = cand.withColumn("_held", held).withColumn("_limit", limit)
        # the slack absorbs rounding in the squared bounds; it only keeps a few more candidates
        kept = cand.filter(F.col("_limit").isNull() | (F.col("_near") <= F.col("_limit") * (1 + 1e-9) + 1e-12))
        frontier = kept.select(*point, "k", F.col("_child").alias("_cell"))
    leaves = celled.select("scene", F.col(f"_c{levels}").alias("_cell"), "anchor_seq", "anchor_id", *[F.col(a).alias(f"_a{a}") for a in AXES])
    dist = geo.distance(tuple(F.col(a) for a in AXES), tuple(F.col(f"_a{a}") for a in AXES))
    pairs = frontier.join(leaves, ["scene", "_cell"]).select(*point, "k", dist.alias("dist"), "anchor_seq", "anchor_id")
    rank = F.row_number().over(Window.partitionBy(*point).orderBy("dist", "anchor_seq"))
    best = pairs.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("k"))
    return best.groupBy(*point).agg(F.array_sort(F.collect_list(F.struct("dist", "anchor_seq", "anchor_id"))).alias("neighbours"))


def nearest_by_cells(points: DataFrame, anchors: DataFrame, levels: int = 5, fan: int = 4) -> DataFrame:
    """Exact nearest anchor for inventories of any size."""
    found = k_nearest_by_cells(points.select("scene", *AXES, F.lit(1).alias("k")), anchors, levels, fan)
    out = points.join(found, ["scene", *AXES], "left")
    one = F.get("neighbours", F.lit(0))
    return out.select(*points.columns, one["anchor_id"].alias("nearest_id"), one["dist"].alias("nearest_dist"))


def nearest_negative(gt: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adds, to each GT item of ``scene, row_index, gt``, the distance to the closest non-GT anchor (NULL if there is none)."""
    if not fits_in_arrays(anchors):
        return negative_by_cells(gt, anchors)
    joined = with_inventory(gt, anchors)
    ids = F.col("gt")["id"]
    negatives = F.filter("anchors", lambda a: ~F.array_contains(ids, a["anchor_id"]))

    def items(free: Column) -> Column:
        return F.transform("gt", lambda g: F.struct(
            g["gt_seq"].alias("gt_seq"), g["id"].alias("id"), g["point"].alias("point"),
            F.array_min(F.transform(free, lambda a: geo.distance(a, g["point"]))).alias("negative"),
        ))

    # bound once: as a column of its own the filtered inventory would be written into the loop over the items again
    return joined.withColumn("gt", let(negatives, items)).select(*gt.columns)


def negative_by_cells(gt: DataFrame, anchors: DataFrame) -> DataFrame:
    """``nearest_negative`` for inventories of any size: of a GT item's |GT| + 1 nearest anchors, at least one is no GT of its event."""
    names = F.size(F.array_distinct("gt.id"))
    items = gt.select("scene", "row_index", F.col("gt.id").alias("_ids"), names.alias("_names"), F.inline("gt"))
    # Anchors that share a name are excluded together: count the inventory's rows per name.
    twins = anchors.groupBy("scene", "anchor_id").agg(F.count("*").alias("_n")).groupBy("scene").agg(F.max("_n").alias("_twins"))
    at = [F.col("point")[a].alias(a) for a in AXES]
    wanted = items.join(twins, "scene").select("scene", *at, (F.col("_names") * F.col("_twins") + 1).alias("k"))
    found = k_nearest_by_cells(wanted, anchors)
    near = items.select("*", *at).join(found, ["scene", *AXES], "left")
    free = F.filter("neighbours", lambda a: ~F.array_contains("_ids", a["anchor_id"]))
    item = F.struct("gt_seq", "id", "point", F.get(free, F.lit(0))["dist"].alias("negative"))
    back = near.groupBy("scene", "row_index").agg(F.array_sort(F.collect_list(item)).alias("_gt"))
    return gt.join(back, ["scene", "row_index"], "left").withColumn("gt", F.coalesce("_gt", F.array().cast(back.schema["_gt"].dataType))).select(*gt.columns)


def robust_bounds(anchors: DataFrame) -> DataFrame:
    """5 / 95 percent bounds per axis (linear interpolation) and their diagonal."""
    q = F.array(F.lit(0.05), F.lit(0.95))
    out = anchors.groupBy("scene").agg(*[F.percentile(a, q).alias(f"_{a}") for a in "xyz"])
    lows = [F.col(f"_{a}")[0].alias(f"{a}_q05") for a in "xyz"]
    highs = [F.col(f"_{a}")[1].alias(f"{a}_q95") for a in "xyz"]
    diag = geo.distance(tuple(F.col(f"_{a}")[0] for a in "xyz"), tuple(F.col(f"_{a}")[1] for a in "xyz"))
    return out.select("scene", *lows, *highs, diag.alias("robust_diagonal"))


def anchor_spacing(anchors: DataFrame) -> DataFrame:
    """Distance of each anchor to its nearest other anchor: count, mean, median and 5 / 95 percent."""
    if fits_in_arrays(anchors):
        joined = with_inventory(anchors, anchors)
        me = (F.col("x"), F.col("y"), F.col("z"))
        others = F.filter("anchors", lambda a: a["anchor_seq"] != F.col("anchor_seq"))
        gap = joined.select("scene", F.array_min(F.transform(others, lambda a: geo.distance(a, me))).alias("gap"))
    else:
        found = k_nearest_by_cells(anchors.select("scene", *AXES, F.lit(2).alias("k")), anchors)
        others = F.filter("neighbours", lambda a: a["anchor_seq"] != F.col("anchor_seq"))
        gap = anchors.join(found, ["scene", *AXES]).select("scene", F.get(others, F.lit(0))["dist"].alias("gap"))
    q = F.percentile("gap", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return gap.filter("gap IS NOT NULL").groupBy("scene").agg(
        F.count("*").alias("n"), F.avg("gap").alias("mean_gap"), q.alias("_q")
    ).select("scene", "n", "mean_gap", F.col("_q")[0].alias("p05"), F.col("_q")[1].alias("median_gap"), F.col("_q")[2].alias("p95"))


def scene_audit(gt_rows: DataFrame, anchors: DataFrame, keep: int = 50) -> DataFrame:
    """Per scene: interactions, index range, robust bounds, spacing, and the first unresolved GT rows."""
    rng = gt_rows.groupBy("scene").agg(
        F.count_distinct("row_index").alias("interactions"), F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row")
    )
    names = anchors.select("scene", F.col("anchor_id").alias("label"))
    lost = gt_rows.join(F.broadcast(names) if fits_in_arrays(anchors) else names, ["scene", "label"], "left_anti")
    rows = lost.groupBy("scene", "row_index").agg(F.count("*").alias("n_lost"))
    head = top_k(rows, ["scene"], [F.col("row_index")], keep)
    head = head.groupBy("scene").agg(F.array_sort(F.collect_list("row_index")).alias("unresolved_rows"))
    totals = rows.groupBy("scene").agg(F.count("*").alias("n_unresolved_rows"), F.sum("n_lost").alias("n_unresolved"))
    out = rng.join(robust_bounds(anchors), "scene").join(anchor_spacing(anchors), "scene", "left")
    return out.join(totals, "scene", "left").join(head, "scene", "left").fillna(0, ["n_unresolved_rows", "n_unresolved"])
