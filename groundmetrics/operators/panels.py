"""Projected-2D grounding: manifests, sheet layout, coordinate mapping, greedy matching and summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundmetrics.functions import geometry as geo
from groundmetrics.functions import text as tx
from groundmetrics.operators.scale import first_by, shuffled, small_side
from groundmetrics.operators.sets import KEY, prf

THRESHOLDS = (50.0, 100.0, 150.0, 200.0)


def panel_number(c: Column | str) -> Column:
    return F.coalesce(tx.finite_int(F.regexp_replace(F.upper(tx.norm_text(c)), "P", "")), F.lit(999).cast("bigint"))


def sheet_layout(panels: DataFrame, columns: int = 4, panel_w: int = 480, panel_h: int = 270, label_h: int = 32, gutter: int = 12) -> DataFrame:
    """Position of each panel on the contact sheet of its interaction, and the sheet size.

    Panels are made distinct first, so the numbered list is as short as the set of panel names.
    """
    one = panels.select(*KEY, F.upper(tx.norm_text("panel_id")).alias("panel_id")).filter("panel_id <> ''").distinct()
    per = Window.partitionBy(*KEY)
    pos = F.row_number().over(per.orderBy(panel_number("panel_id"), "panel_id")) - 1
    out = one.withColumn("position", pos).withColumn("_n", F.count("*").over(per))
    x0, y0 = geo.sheet_cell(F.col("position"), columns, panel_w, panel_h, label_h, gutter)
    rows = F.ceil(F.col("_n") / columns)
    sheet_w = columns * panel_w + (columns + 1) * gutter
    return out.select(
        *KEY, "panel_id", "position", x0.cast("bigint").alias("x0"), y0.cast("bigint").alias("y0"),
        F.lit(sheet_w).cast("bigint").alias("sheet_w"), (rows * (panel_h + label_h) + (rows + 1) * gutter).cast("bigint").alias("sheet_h"),
    )


def evidence_rank(rows: DataFrame, keys: Sequence[str], top_k: int) -> DataFrame:
    """Rank valid rows by (gaze distance, panel index); the best ``top_k`` are acceptable, the others keep no rank.

    A group is one referent of one interaction, i.e. at most one row per panel.
    """
    ok = F.col("projection_valid") & F.col("gaze_projection_valid") & F.col("gaze_anchor_distance_px").isNotNull()
    order = Window.partitionBy(*keys, ok).orderBy("gaze_anchor_distance_px", "panel_index")
    rank = F.when(ok, F.row_number().over(order))
    return rows.withColumn("evidence_rank", rank).withColumn("evidence_acceptable", F.coalesce(rank <= top_k, F.lit(False)))


def distinct_gt(manifest: DataFrame) -> DataFrame:
    """2D GT points: valid projections, the first one per (panel, referent)."""
    valid = manifest.filter(F.col("projection_valid") & F.col("gt_u").isNotNull() & F.col("gt_v").isNotNull())
    return first_by(valid, [*KEY, "panel_id", "referent"], ["manifest_seq"])


def map_coordinates(preds: DataFrame, meta: DataFrame, policy: str = "auto") -> DataFrame:
    """Map crop or paired-canvas coordinates back to the full panel, with the transform that was applied.

    ``meta`` holds ``left, top, right, bottom`` of the crop and ``full_end, crop_start`` of the canvas.
    """
    if policy == "none":
        return preds.withColumn("coordinate_transform", F.lit("none"))
    j = preds.join(meta, [*KEY, "panel_id"], "left")
    x, y = F.col("x_norm"), F.col("y_norm")
    space = tx.coordinate_space("coordinate_space")
    has = x.isNotNull() & y.isNotNull() & F.col("panel_known")
    box, canvas = F.col("left").isNotNull(), F.col("full_end").isNotNull()
    left = has & canvas & (x <= F.col("full_end"))
    right = has & canvas & box & (x > F.col("full_end")) & (x >= F.col("crop_start"))
    crop = has & box & (space == "gaze_crop")
    if policy == "paired_canvas_map":
        crop = crop & ~canvas
    else:
        left, right = left & (space == ""), right & (space == "")
    kind = (F.when(left, "paired_canvas_left_to_full_panel").when(right, "paired_canvas_right_crop_to_full_panel")
            .when(crop, "gaze_crop_to_full_panel").otherwise("none"))
    j = j.withColumn("coordinate_transform", kind)
    in_crop = F.when(F.col("coordinate_transform") == "gaze_crop_to_full_panel", x).otherwise(
        tx.clamp((x - F.col("crop_start")) / F.greatest(F.lit(1e-6), 1.0 - F.col("crop_start")), 0.0, 1.0))
    is_left = F.col("coordinate_transform") == "paired_canvas_left_to_full_panel"
    moved = F.col("coordinate_transform") != "none"
    new_x = (F.when(is_left, tx.clamp(x / F.col("full_end"), 0.0, 1.0))
             .when(moved, tx.clamp(F.col("left") + in_crop * (F.col("right") - F.col("left")), 0.0, 1.0)).otherwise(x))
    new_y = (F.when(is_left, tx.clamp(y, 0.0, 1.0))
             .when(moved, tx.clamp(F.col("top") + y * (F.col("bottom") - F.col("top")), 0.0, 1.0)).otherwise(y))
    return j.withColumn("raw_x_norm", x).withColumn("raw_y_norm", y).withColumn("_x", new_x).withColumn("_y", new_y).drop(
        "x_norm", "y_norm", *[c for c in meta.columns if c not in (*KEY, "panel_id")]
    ).withColumnsRenamed({"_x": "x_norm", "_y": "y_norm"})


def point_distance(mode: str = "panel") -> Column:
    """Pixel distance of a joined (prediction, GT) pair.

    ``panel``: same panel, image pixels. ``sheet``: contact-sheet pixels. ``auto``: sheet when the
    prediction carries sheet coordinates, panel otherwise.
    """
    w, h = F.col("image_width"), F.col("image_height")
    same = F.col("pred_panel") == F.col("panel_id")
    panel = F.when(same, F.hypot(F.col("x_norm") * w - F.col("gt_u") * w, F.col("y_norm") * h - F.col("gt_v") * h))
    sheet = F.hypot(F.col("pred_sheet_x") - F.col("gt_sheet_x"), F.col("pred_sheet_y") - F.col("gt_sheet_y"))
    if mode == "panel":
        return panel
    if mode == "sheet":
        return sheet
    return F.when(F.col("sheet_x_norm").isNull() | F.col("sheet_y_norm").isNull(), panel).otherwise(sheet)


def sheet_points(gt: DataFrame, layout: DataFrame, panel_w: int = 480, panel_h: int = 270) -> DataFrame:
    """Sheet pixels of GT points: letterboxed image content inside the panel."""
    cw, ch, px, py = geo.letterbox(F.col("image_width"), F.col("image_height"), panel_w, panel_h)
    j = gt.join(layout, [*KEY, "panel_id"])
    return j.withColumn("gt_sheet_x", F.col("x0") + px + F.col("gt_u") * cw).withColumn("gt_sheet_y", F.col("y0") + py + F.col("gt_v") * ch)


def prediction_sheet_points(preds: DataFrame, layout: DataFrame, panel_w: int = 480, panel_h: int = 270) -> DataFrame:
    """Sheet pixels of predictions: own sheet coordinates if both are there, else the panel area of the named panel."""
    place = layout.select(*KEY, F.col("panel_id").alias("pred_panel"), "x0", "y0")
    size = layout.groupBy(*KEY).agg(F.first("sheet_w").alias("sheet_w"), F.first("sheet_h").alias("sheet_h"))
    j = preds.join(place, [*KEY, "pred_panel"], "left").join(size, KEY, "left")
    own = F.col("sheet_x_norm").isNotNull() & F.col("sheet_y_norm").isNotNull()
    there = F.col("x_norm").isNotNull() & F.col("y_norm").isNotNull()
    at = lambda s, p: F.when(own, s).when(there, p)
    sx = at(F.col("sheet_x_norm") * F.col("sheet_w"), F.col("x0") + F.col("x_norm") * panel_w)
    sy = at(F.col("sheet_y_norm") * F.col("sheet_h"), F.col("y0") + F.col("y_norm") * panel_h)
    return j.withColumn("pred_sheet_x", sx).withColumn("pred_sheet_y", sy).drop("x0", "y0", "sheet_w", "sheet_h")


def match_names(thresholds: Sequence[float] = THRESHOLDS) -> list[str]:
    return ["time", *[f"{kind}_{int(t)}" for kind in ("point", "joint") for t in thresholds]]


def panel_name(c: Column | str) -> Column:
    """Panel names as answers spell them: trimmed, upper case, a missing ``P`` added; NULL when empty."""
    name = F.upper(tx.norm_text(c))
    return F.when(name == "", F.lit(None)).when(name.startswith("P"), name).otherwise(F.concat(F.lit("P"), name))


def listed_gt(gt: DataFrame, sheet: bool = False) -> Column:
    """A GT point as an element of ``_g``, in manifest order when sorted."""
    extra = [F.col("gt_sheet_x").alias("sx"), F.col("gt_sheet_y").alias("sy")] if sheet else []
    return F.struct("manifest_seq", "referent", tx.label_key("referent", "alnum").alias("label"), F.upper(tx.norm_text("panel_id")).alias("panel"),
                    F.col("gt_u").alias("u"), F.col("gt_v").alias("v"), F.col("image_width").cast("double").alias("w"), F.col("image_height").cast("double").alias("h"),
                    F.coalesce("evidence_acceptable", F.lit(False)).alias("ok"), *extra)


def with_codes(lists: DataFrame) -> DataFrame:
    """Adds to each GT point its ``code`` (4 * place of its referent + 2 * acceptable), and the numbers of referents, all and acceptable."""
    out = lists.withColumn("_refs", F.array_distinct(F.col("_g")["referent"]))
    code = lambda g: F.array_position("_refs", g["referent"]).cast("int") * 4 + F.when(g["ok"], 2).otherwise(0)
    ok = F.size(F.array_distinct(F.filter("_g", lambda g: g["ok"])["referent"]))
    out = out.withColumns({"gt_referent_count": F.size("_refs").cast("bigint"), "time_evaluable_referent_count": ok.cast("bigint")})
    return out.withColumn("_g", F.transform("_g", lambda g: g.dropFields("referent").withField("code", code(g)))).drop("_refs")


def gt_lists(gt: DataFrame, mode: str = "panel") -> DataFrame:
    """The GT points of each interaction in manifest order (at most referents x panels), with codes and counts."""
    return with_codes(gt.groupBy(*KEY).agg(F.sort_array(F.collect_list(listed_gt(gt, mode != "panel"))).alias("_g")))


def boards(manifest: DataFrame, usable: Column, all_if_none: bool, columns: int = 4, panel_w: int = 480, panel_h: int = 270, label_h: int = 32, gutter: int = 12) -> DataFrame:
    """One row per interaction of the manifest: the names of the panels on its sheet in order (``_names``), the sheet size and its GT points with
    sheet pixels (``_g``), the first one per (panel, referent); points of panels that are not on the sheet take no part.

    ``usable`` says which rows put their panel on the sheet; with ``all_if_none`` all panels are, where no row does. Everything is one
    grouping by interaction: rows that are already dealt by it are not moved again.
    """
    valid = F.coalesce(F.col("projection_valid") & F.col("gt_u").isNotNull() & F.col("gt_v").isNotNull(), F.lit(False))
    seen = Window.partitionBy(*KEY, "_ok", "panel_id", "referent").orderBy("manifest_seq")
    rows = manifest.withColumn("_ok", valid & F.coalesce(F.col("_counts"), F.lit(True)) if "_counts" in manifest.columns else valid)
    rows = rows.withColumn("_first", F.row_number().over(seen) == 1)
    cw, ch, px, py = geo.letterbox(F.col("image_width"), F.col("image_height"), panel_w, panel_h)
    rows = rows.withColumn("gt_sheet_x", px + F.col("gt_u") * cw).withColumn("gt_sheet_y", py + F.col("gt_v") * ch)
    name = F.upper(tx.norm_text("panel_id"))
    panel = F.struct(panel_number("panel_id").alias("number"), name.alias("name"))
    there = name != ""
    out = rows.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.when(F.col("_ok") & F.col("_first"), listed_gt(rows, True)))).alias("_g"),
        F.collect_set(F.when(there & usable, panel)).alias("_used"), F.collect_set(F.when(there, panel)).alias("_all"))
    names = F.when(F.size("_used") > 0, F.col("_used")).otherwise(F.col("_all")) if all_if_none else F.col("_used")
    out = out.withColumn("_names", F.sort_array(names)["name"]).drop("_used", "_all")

    def placed(g: Column) -> Column:
        x0, y0 = geo.sheet_cell(F.array_position("_names", g["panel"]) - 1, columns, panel_w, panel_h, label_h, gutter)
        return g.withField("sx", x0 + g["sx"]).withField("sy", y0 + g["sy"])

    on_sheet = F.filter("_g", lambda g: F.array_contains("_names", g["panel"]))
    out = out.withColumn("_g", F.transform(on_sheet, placed))
    sheet_rows = F.ceil(F.size("_names") / columns)
    return out.withColumn("sheet_w", F.lit(columns * panel_w + (columns + 1) * gutter)).withColumn("sheet_h", sheet_rows * (panel_h + label_h) + (sheet_rows + 1) * gutter)


def with_sheet_points(rows: DataFrame, columns: int = 4, panel_w: int = 480, panel_h: int = 270, label_h: int = 32, gutter: int = 12) -> DataFrame:
    """Predictions beside their board: adds ``pred_sheet_x/y`` as ``prediction_sheet_points`` does."""
    place = F.array_position("_names", F.col("pred_panel"))
    x0, y0 = geo.sheet_cell(F.when(place > 0, place - 1), columns, panel_w, panel_h, label_h, gutter)
    own = F.col("sheet_x_norm").isNotNull() & F.col("sheet_y_norm").isNotNull()
    there = F.col("x_norm").isNotNull() & F.col("y_norm").isNotNull()
    sx = F.when(own, F.col("sheet_x_norm") * F.col("sheet_w")).when(there, x0 + F.col("x_norm") * panel_w)
    sy = F.when(own, F.col("sheet_y_norm") * F.col("sheet_h")).when(there, y0 + F.col("y_norm") * panel_h)
    return rows.withColumn("pred_sheet_x", sx).withColumn("pred_sheet_y", sy)


def beside(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join by interaction. ``row_index`` is the join key and ``scene`` a condition (equal: neither lower nor higher), so that sides dealt by
    ``row_index`` alone meet where they are; as a second key it would have both shuffled once more."""
    r = right.withColumnsRenamed({"scene": "_scene", "row_index": "_row"})
    here = (F.col("row_index") == F.col("_row")) & (F.col("scene") <= F.col("_scene")) & (F.col("scene") >= F.col("_scene"))
    return left.join(shuffled(r), here, how).drop("_scene", "_row")


def pair_space(rows: DataFrame, modes: Sequence[str] = ("panel",), reach: float = max(THRESHOLDS)) -> DataFrame:
    """What each prediction can be matched with, from predictions beside the ``_g`` of their interaction (``_said`` marks real ones).

    For each mode, ``near_px_*`` / ``near_*``: GT points within ``reach``, closest first (ties in manifest order); a code is 4 * referent
    + 2 * acceptable + same label; ``min_px_*``: the smallest distance of all. ``in_panel``: acceptable GT points of the named panel in
    manifest order, same codes. ``named``: referents of the same label, same codes. Distances follow ``point_distance``; in ``sheet`` and
    ``auto`` mode the lists have sheet pixels and the rows ``pred_sheet_x/y``, and pairs may cross panels.
    """
    rows = rows.withColumns({"_panel": panel_name("pred_panel"), "_label": tx.label_key("mention", "alnum")})
    same = lambda g: (F.col("_label") != "") & (g["label"] == F.col("_label"))
    code = lambda g: g["code"] + F.when(same(g), 1).otherwise(0)

    def scored(points: Column, distance) -> Column:
        pairs = F.transform(points, lambda g: F.struct(distance(g).alias("d"), g["manifest_seq"].alias("seq"), code(g).alias("code")))
        return F.sort_array(F.filter(pairs, lambda c: c["d"].isNotNull()))

    here = F.filter("_g", lambda g: g["panel"] == F.col("_panel"))
    inside = scored(here, lambda g: F.hypot((F.col("x_norm") - g["u"]) * g["w"], (F.col("y_norm") - g["v"]) * g["h"]))
    rows = rows.withColumns({
        "in_panel": F.transform(F.filter(here, lambda g: g["ok"]), code), "named": F.array_distinct(F.transform(F.filter("_g", same), code)), "_d_panel": inside})
    if set(modes) != {"panel"}:
        rows = rows.withColumn("_d_sheet", scored(F.col("_g"), lambda g: F.hypot(F.col("pred_sheet_x") - g["sx"], F.col("pred_sheet_y") - g["sy"])))
    lists = {m: F.col(f"_d_{m}") for m in ("panel", "sheet")}
    if "auto" in modes:
        lists["auto"] = F.when(F.col("sheet_x_norm").isNull() | F.col("sheet_y_norm").isNull(), lists["panel"]).otherwise(lists["sheet"])
    found = []
    for m in modes:
        near = F.filter(lists[m], lambda c: c["d"] <= reach)
        found += [F.get(lists[m], F.lit(0))["d"].alias(f"min_px_{m}"), _filled(near["d"], "double").alias(f"near_px_{m}"), _filled(near["code"], "int").alias(f"near_{m}")]
    return rows.select(*KEY, "_said", "pred_seq", "gt_referent_count", "time_evaluable_referent_count", _filled(F.col("in_panel"), "int").alias("in_panel"),
                       _filled(F.col("named"), "int").alias("named"), *found)


def point_distances(rows: DataFrame) -> DataFrame:
    """Smallest distance of each prediction in the three modes, from predictions beside their board; pairs never leave their row."""
    pairs = rows.select(*KEY, "pred_seq", "pred_panel", "x_norm", "y_norm", "sheet_x_norm", "sheet_y_norm", "pred_sheet_x", "pred_sheet_y", F.explode("_g").alias("_p"))
    names = {"panel": "panel_id", "u": "gt_u", "v": "gt_v", "w": "image_width", "h": "image_height", "sx": "gt_sheet_x", "sy": "gt_sheet_y"}
    pairs = pairs.withColumns({c: F.col(f"_p.{f}") for f, c in names.items()})
    return pairs.groupBy(*KEY, "pred_seq").agg(*[F.min(point_distance(m)).alias(f"{m}_px") for m in ("panel", "sheet", "auto")])


def _filled(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def _parts(column: pa.Array) -> tuple[list, list]:
    """Offsets and flat values of a list column without NULL lists."""
    return column.offsets.to_pylist(), column.values.to_pylist()


def _take(codes: list[int], at: int, end: int, taken: int, wanted: int) -> int | None:
    """Place of the first code whose referent is free and that has all bits of ``wanted``."""
    for i in range(at, end):
        c = codes[i]
        if c & wanted == wanted and not taken >> (c >> 2) & 1:
            return i
    return None


ANSWER_POINTS = 5_000


def match_rows(rows: DataFrame, modes: Sequence[str], thresholds: Sequence[float], limit: int = ANSWER_POINTS) -> DataFrame:
    """One row per interaction and mode from the joined rows of ``pair_space``: sequential matching in order of ``pred_seq``.

    The rows are numbered by a window over the interaction, which is what keeps an interaction in one task and in order; they
    are then read as a stream whose state is the set of taken referents (as bits) per family. An answer of any length needs no
    list; ``limit`` rows are held as Python values at once.
    """
    modes, families = list(modes), [(t, 2 * joint) for joint in (0, 1) for t in thresholds]
    order = Window.partitionBy(*KEY).orderBy("pred_seq")
    numbered = pair_space(rows, modes, max(thresholds)).withColumn("_place", F.row_number().over(order))
    counted = ("gt_referent_count", "time_evaluable_referent_count")
    size = 1 + len(modes) * len(families)
    fields = pa.schema([("scene", pa.string()), ("row_index", pa.int64()), *[(c, pa.int64()) for c in (*counted, "prediction_count")],
                        ("tp", pa.list_(pa.int64())), ("dist", pa.list_(pa.float64())), ("px", pa.list_(pa.float64()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, taken = None, []
        for batch in batches:
            done = []
            for start in range(0, batch.num_rows, limit):
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(start, limit).columns], schema=batch.schema)
                col = lambda c: part.column(part.schema.get_field_index(c))
                heads = [col(c).to_pylist() for c in (*KEY, *counted)]
                place, said = col("_place").to_pylist(), col("_said").to_pylist()
                (here_at, here), (named_at, named) = _parts(col("in_panel")), _parts(col("named"))
                near = [(*_parts(col(f"near_{m}")), _parts(col(f"near_px_{m}"))[1], col(f"min_px_{m}").to_pylist()) for m in modes]
                for i, first in enumerate(place):
                    if first == 1:
                        if row is not None:
                            done.append(row)
                        row, taken = [*(h[i] for h in heads), 0, [0] * size, [0.0] * size, [None] * len(modes)], [0] * size
                    if not said[i]:
                        continue
                    row[4] += 1
                    tp, dist, px = row[5:]
                    every = good = 0
                    for c in named[named_at[i]:named_at[i + 1]]:
                        every |= 1 << (c >> 2)
                        good |= (c >> 1 & 1) << (c >> 2)
                    if here_at[i] < here_at[i + 1]:
                        hit = _take(here, here_at[i], here_at[i + 1], taken[0], 3 if good & ~taken[0] else 2)
                        if hit is not None:
                            taken[0] |= 1 << (here[hit] >> 2)
                            tp[0] += 1
                    f = 0
                    for m, (at, codes, away, least) in enumerate(near):
                        if least[i] is not None and (px[m] is None or least[i] < px[m]):
                            px[m] = least[i]
                        a, b = at[i], at[i + 1]
                        if a == b:
                            f += len(families)
                            continue
                        for threshold, joint in families:
                            f += 1
                            hit = _take(codes, a, b, taken[f], joint | bool((good if joint else every) & ~taken[f]))
                            if hit is not None and away[hit] <= threshold:
                                taken[f] |= 1 << (codes[hit] >> 2)
                                tp[f] += 1
                                dist[f] += away[hit]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * len(fields), fields.types)], schema=fields)
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, fields.types)], schema=fields)

    kinds = ", ".join(f"{c} bigint" for c in (*counted, "prediction_count"))
    folded = numbered.mapInArrow(fold, f"scene string, row_index bigint, {kinds}, tp array<bigint>, dist array<double>, px array<double>")

    def counts(at: int, joint: bool) -> Column:
        tp, there = F.get("tp", F.lit(at)), F.col("time_evaluable_referent_count" if joint else "gt_referent_count")
        return F.struct(tp.alias("tp"), (F.col("prediction_count") - tp).alias("fp"), F.greatest(there - tp, F.lit(0).cast("bigint")).alias("fn"), F.get("dist", F.lit(at)).alias("dist"))

    def of(m: int, name: str) -> Column:
        found = [counts(1 + m * len(families) + i, bool(joint)).alias(n) for i, (n, (_, joint)) in enumerate(zip(match_names(thresholds)[1:], families))]
        return F.struct(F.lit(name).alias("mode"), counts(0, True).alias("time"), *found, F.get("px", F.lit(m)).alias("min_point_distance_px"))

    each = folded.select(*KEY, *counted, "prediction_count", F.inline(F.array(*[of(m, n) for m, n in enumerate(modes)])))
    return each.select(*KEY, "mode", *match_names(thresholds), "prediction_count", *counted, "min_point_distance_px")


def greedy_match(keys: DataFrame, preds: DataFrame, gt: DataFrame, thresholds: Sequence[float] = THRESHOLDS,
                 limit: int = ANSWER_POINTS, mode: str = "panel") -> DataFrame:
    """Sequential matching of one answer's points to the manifest; a struct of ``tp, fp, fn, dist`` per metric family, counts of
    predictions and referents, and the smallest distance.

    Predictions are taken in order; each takes the nearest free referent (of its own label while one is free) if that lies within the
    threshold. Keys, GT points and predictions meet once, dealt by interaction (``match_rows``).
    """
    own = ["x_norm", "y_norm", *(["pred_sheet_x", "pred_sheet_y"] if mode != "panel" else []), *(["sheet_x_norm", "sheet_y_norm"] if mode == "auto" else [])]
    said = preds.select(*KEY, "pred_seq", "mention", "pred_panel", *own, F.lit(True).alias("_said"))
    numbers = ("gt_referent_count", "time_evaluable_referent_count")
    lists = beside(keys.select(*KEY).distinct(), gt_lists(gt, mode)).withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in numbers})
    return match_rows(beside(lists, said), [mode], thresholds, limit).drop("mode")


def evaluate_2d(manifest: DataFrame, preds: DataFrame, mode: str | Sequence[str] = "panel", thresholds: Sequence[float] = THRESHOLDS, columns: int = 4) -> DataFrame:
    """Detail of a 2D run, a row per interaction of the manifest: counts, a struct per metric family, the smallest distance.

    ``mode`` says where distances are taken: ``panel`` (image pixels of the named panel), ``sheet`` (contact sheet, across panels) or ``auto``
    (sheet for predictions with both sheet coordinates, else panel); several modes give a row each, with a column ``mode``, from one pass.
    Answers name panels in any case, with or without ``P``; those without a panel are no predictions, and coordinates outside [0, 1] count
    as missing. Panels without a frame are not on the sheet, unless none has one; GT points of a panel that is not on the sheet take no part.
    Summaries: ``summary_2d``.
    """
    rows = manifest.withColumns({"panel_id": panel_name("panel_id"), "referent": tx.norm_text("referent")})
    rows = rows.withColumn("_counts", (F.col("image_width") > 0) & (F.col("image_height") > 0) & (F.col("referent") != "") & F.col("panel_id").isNotNull())
    lists = with_codes(boards(rows, F.coalesce("frame_extracted", F.lit(True)), True, columns))
    unit = lambda c: F.when(F.col(c).between(0.0, 1.0), F.col(c)).alias(c)
    coords = ["x_norm", "y_norm", "sheet_x_norm", "sheet_y_norm"]
    answers = preds.select(*KEY, "pred_seq", "mention", panel_name("pred_panel").alias("pred_panel"), *map(unit, coords), F.lit(True).alias("_said")).filter(F.col("pred_panel").isNotNull())
    joined = with_sheet_points(beside(lists, answers), columns)
    out = match_rows(joined, [mode] if isinstance(mode, str) else mode, thresholds)
    return out.drop("mode") if isinstance(mode, str) else out


def summary_2d(detail: DataFrame, by: Sequence[str], thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Nine metric families x (TP, FP, FN, P, R, F1) and the mean matched distance at 100 px."""
    aggs: list[Column] = [F.count("*").alias("events")]
    for n in match_names(thresholds):
        tp, fp, fn = (F.sum(f"{n}.{c}") for c in ("tp", "fp", "fn"))
        p, r, f1 = prf(tp, fp, fn, 0.0)
        aggs += [tp.alias(f"{n}_tp"), fp.alias(f"{n}_fp"), fn.alias(f"{n}_fn"), p.alias(f"{n}_precision"), r.alias(f"{n}_recall"), f1.alias(f"{n}_f1")]
    for kind in ("point", "joint"):
        hit = F.sum(f"{kind}_100.tp")
        aggs.append(F.when(hit > 0, F.sum(f"{kind}_100.dist") / hit).otherwise(0.0).alias(f"mean_{kind}_distance_px_100"))
    return detail.groupBy(*by).agg(*aggs)


def min_distance(preds: DataFrame, gt: DataFrame, mode: str = "panel") -> DataFrame:
    """Smallest distance over the prediction x GT pairs of an interaction (same panel for ``panel`` mode)."""
    on = [*KEY, "panel_id"] if mode == "panel" else KEY
    left = preds.withColumn("panel_id", F.col("pred_panel")) if mode == "panel" else preds
    d = point_distance(mode)
    return left.join(gt, on).groupBy(*KEY).agg(F.min(d).alias("min_distance_px"))


STRATEGIES = ("first", "middle", "highest_score")


def choose_panels(panels: DataFrame, strategies: Sequence[str] = STRATEGIES, payload: Sequence[str] = ("panel_id",)) -> DataFrame:
    """``KEY, strategy, payload``: one panel per event and strategy (ties: panel index, then time), all from one pass.

    Only what the choice and ``payload`` read travels. If ``panels`` are dealt by event, nothing is shuffled. An event has at most one
    row per panel name in the window.
    """
    payload = list(payload)
    need = dict.fromkeys([*KEY, "panel_id", "panel_index", "video_time", "panel_score", *payload])
    one = first_by(panels.select(*need), [*KEY, "panel_id"], ["panel_index", "video_time"])
    # the id last, so that panels of equal index and time come in one order everywhere
    order = [F.col("panel_index"), F.col("video_time"), F.col("panel_id")]
    per = Window.partitionBy(*KEY)
    one = one.withColumn("_i", F.row_number().over(per.orderBy(*order))).withColumn("_n", F.count("*").over(per))
    row, score = F.struct(*payload), F.coalesce("panel_score", F.lit(0.0))
    picks = {
        "first": F.min_by(row, F.col("_i")),
        "middle": F.any_value(F.when(F.col("_i") == F.floor(F.col("_n") / 2) + 1, row), F.lit(True)),
        "highest_score": F.min_by(row, F.struct(-score, F.col("_i"))),
    }
    wanted = F.array(*[F.struct(F.lit(s).alias("strategy"), picks[s].alias("_row")) for s in strategies])
    out = one.groupBy(*KEY).agg(wanted.alias("_picks")).select(*KEY, F.inline("_picks"))
    return out.select(*KEY, "strategy", *[F.col("_row")[c].alias(c) for c in payload])


def choose_panel(panels: DataFrame, strategy: str = "highest_score") -> DataFrame:
    """One panel per event, with all its columns: ``first``, ``middle`` or ``highest_score`` (ties: panel index, then time)."""
    rest = [c for c in panels.columns if c not in KEY]
    return choose_panels(panels, (strategy,), rest).select(*panels.columns)


def panel_vote(items: DataFrame, policy: str = "majority") -> DataFrame:
    """Panel named by an answer: ``first``, ``majority`` (tie: first seen) or ``all_unique``."""
    per = items.groupBy(*KEY, "pred_panel").agg(
        F.count("*").alias("votes"), F.min("pred_seq").alias("first_seq"), F.min_by("mention", "pred_seq").alias("first_mention")
    )
    if policy == "all_unique":
        return per
    pick = F.struct(F.lit(0) if policy == "first" else -F.col("votes"), F.col("first_seq"))
    rest = ["pred_panel", "votes", "first_seq", "first_mention"]
    best = per.groupBy(*KEY).agg(F.min_by(F.struct(*rest), pick).alias("_b"))
    return best.select(*KEY, "_b.*")


def biased_panel(items: DataFrame, primary: Column, low: int, high: int, bonus: float) -> DataFrame:
    """Panel by preferred number range (bonus plus triangular weight) and +1 for the primary; first wins on a tie."""
    n = panel_number("pred_panel")
    centre, spread = (low + high) / 2.0, max((high - low) / 2.0, 1.0)
    inside = n.between(low, high)
    weight = F.greatest(F.lit(0.0), 1.0 - F.abs(n - centre) / (spread + 1.0))
    score = F.when(F.col("pred_panel") == primary, 1.0).otherwise(0.0) + F.when(inside, bonus + weight).otherwise(0.1)
    best = items.groupBy(*KEY).agg(F.min_by(F.struct("pred_panel", score.alias("panel_bias")), F.struct(-score, F.col("pred_seq"))).alias("_b"))
    return best.select(*KEY, "_b.*")


def refine_with_boxes(preds: DataFrame, panels: DataFrame, detections: DataFrame, mode: str = "vl_point_nearest",
                      point_mode: str = "vl_point_nearest", weight: float = 0.5, fallback: bool = True) -> DataFrame:
    """Replace predicted points by a point of the best detection box of that prediction.

    The panel row prefers a valid projection; the box maximises ``score - weight * distance`` (the
    distance counts from the predicted or the gaze point, by ``mode``).
    """
    pick = F.min_by(F.struct("image_width", "image_height", "gaze_u", "gaze_v", "gaze_projection_valid"),
                    F.struct(~F.col("projection_valid"), F.col("manifest_seq")))
    pan = panels.filter("frame_extracted").groupBy(*KEY, "panel_id").agg(pick.alias("_panel"))
    rows = preds.join(pan.withColumnRenamed("panel_id", "pred_panel"), [*KEY, "pred_panel"], "left")
    w, h = F.col("_panel.image_width").cast("double"), F.col("_panel.image_height").cast("double")
    unit = tx.unit_gate(F.col("x_norm")).isNotNull() & tx.unit_gate(F.col("y_norm")).isNotNull()
    vl = [F.when(unit, F.col(c) * s) for c, s in (("x_norm", w), ("y_norm", h))]
    gaze = [F.when(F.col("_panel.gaze_projection_valid"), F.col(f"_panel.{c}") * s) for c, s in (("gaze_u", w), ("gaze_v", h))]
    rows = rows.withColumns({"_vx": vl[0], "_vy": vl[1], "_gx": gaze[0], "_gy": gaze[1], "_w": w, "_h": h})
    boxes = rows.join(detections, [*KEY, "pred_seq"], "left")
    ref = {"vl_point_nearest": ("_vx", "_vy"), "gaze_nearest": ("_gx", "_gy")}.get(mode)
    far = geo.box_distance(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col(ref[0]), F.col(ref[1]), F.col("_w"), F.col("_h")) if ref else F.lit(None)
    value = F.col("det_score") - weight * F.coalesce(far, F.lit(0.0))
    box = F.struct("x1", "y1", "x2", "y2", "det_score")
    chosen = boxes.groupBy(*KEY, "pred_seq").agg(
        F.count("det_seq").alias("n_boxes"),
        F.max_by(box, F.when(F.col("det_seq").isNotNull(), F.struct(value, -F.col("det_seq")))).alias("_box"),
        *[F.first(c).alias(c) for c in ("pred_panel", "x_norm", "y_norm", "_vx", "_vy", "_gx", "_gy", "_w", "_h")],
    )
    b = F.col("_box")
    px, py = {"vl_point_nearest": ("_vx", "_vy"), "gaze_nearest": ("_gx", "_gy")}.get(point_mode, (None, None))
    cx, cy = geo.box_center((b["x1"], b["y1"], b["x2"], b["y2"]))
    near = F.col(px).isNotNull() if px else F.lit(False)
    x = F.when(near, tx.clamp(F.col(px), b["x1"], b["x2"])).otherwise(cx) if px else cx
    y = F.when(near, tx.clamp(F.col(py), b["y1"], b["y2"])).otherwise(cy) if py else cy
    status = F.when(F.col("_w").isNull(), "missing_panel_frame").when(b.isNull(), "no_box").otherwise("detected")
    found = F.col("box_status") == "detected"
    keep = F.col("x_norm") if fallback else F.lit(None).cast("double")
    keep_y = F.col("y_norm") if fallback else F.lit(None).cast("double")
    out = chosen.withColumn("box_status", status)
    return out.select(
        *KEY, "pred_seq", "pred_panel", "n_boxes", "box_status",
        F.when(found, tx.clamp(x / F.col("_w"), 0.0, 1.0)).otherwise(keep).alias("x_norm"),
        F.when(found, tx.clamp(y / F.col("_h"), 0.0, 1.0)).otherwise(keep_y).alias("y_norm"),
        F.when(found, b["det_score"]).alias("det_score"),
    )


def panel_manifest(panels: DataFrame, referents: DataFrame, anchors: DataFrame, event_keys: Sequence[str], width: int, height: int,
                   top_k: int = 1, csv_compatible: bool = True) -> DataFrame:
    """(event x referent x panel) rows with anchor and gaze projections, status and evidence rank.

    ``panels`` carries the sample picked for each panel (NULL when there was none), ``referents`` the
    named targets of an interaction.
    """
    a = small_side(anchors.select("scene", F.col("anchor_id").alias("referent"), F.struct("x", "y", "z").alias("anchor")))
    cam = ("cameraPosition", "cameraRotation", "cameraFOV")
    # the gaze belongs to the panel: projected before the panel meets its referents
    panels = geo.with_projection(panels, "_gaze", *cam, F.col("gaze"), width, height)
    rows = panels.join(shuffled(referents), KEY, "left").join(a, ["scene", "referent"], "left")
    rows = geo.with_projection(rows, "_gt", *cam, F.col("anchor"), width, height)
    dist = F.hypot((F.col("_gt.u") - F.col("_gaze.u")) * width, (F.col("_gt.v") - F.col("_gaze.v")) * height)
    digits = (6, 2) if csv_compatible else (15, 15)
    rows = rows.select(
        *event_keys, "panel_index", "referent", "t_us",
        F.round("_gt.u", digits[0]).alias("gt_u"), F.round("_gt.v", digits[0]).alias("gt_v"),
        F.col("_gt").isNotNull().alias("projection_valid"), F.col("_gaze").isNotNull().alias("gaze_projection_valid"),
        F.round(dist, digits[1]).alias("gaze_anchor_distance_px"),
        F.when(F.col("referent").isNull(), "missing_gt_referents").when(F.col("t_us").isNull(), "no_timed_samples")
        .when(F.col("anchor").isNull(), "missing_anchor").when(F.col("_gt").isNull(), "projection_invalid")
        .otherwise("point_evaluable").alias("status"),
    )
    return evidence_rank(rows, [*event_keys, "referent"], top_k)


GT_COLUMNS = ("gt", "gt_count", "gt_ids", "anchor_id", "referent", "target_description")


def evidence_manifest(evidence: DataFrame, gt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model-facing evidence rows and the hidden GT rows of the same interactions, kept apart.

    Interactions without GT are excluded before any further work.
    """
    facing = evidence.join(gt.select(*KEY), KEY, "left_semi")
    facing = facing.select(*[c for c in facing.columns if c not in GT_COLUMNS])
    hidden = gt.join(facing.select(*KEY).distinct(), KEY, "left_semi")
    return facing, hidden


