"""Inventories, label canonicalisation, set scoring, key-set comparison and merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundmetrics.functions import text as tx
from groundmetrics.operators.scale import first_by, small_side, within_rows

KEY = ["scene", "row_index"]

# Header spellings accepted for each inventory field.
NAME_HEADERS = ("object_name", "anchor_id", "物体名称")
AXIS_HEADERS = {a: (f"{a}_world", f"location_{a}", a) for a in "xyz"}
ALIAS_HEADERS = ("aliases", "alias", "object_aliases")


def _present(df: DataFrame, names: Sequence[str], cast=tx.norm_text) -> Column | None:
    have = {c.lower(): c for c in df.columns}
    found = [cast(F.col(f"`{have[n]}`")) for n in names if n in have]
    return F.coalesce(*found) if found else None


def normalize_inventory(df: DataFrame) -> DataFrame:
    """Header variants to ``scene, anchor_seq, anchor_id, x, y, z, aliases``; incomplete rows drop out."""
    name = _present(df, NAME_HEADERS, lambda c: F.nullif(tx.norm_text(c), F.lit("")))
    axes = {a: _present(df, h, tx.finite_double) for a, h in AXIS_HEADERS.items()}
    if name is None or any(v is None for v in axes.values()):
        raise ValueError("inventory needs a name column and three coordinate columns")
    aliases = _present(df, ALIAS_HEADERS)
    out = df.select(
        "scene", F.col("anchor_seq"), name.alias("anchor_id"), *[v.alias(a) for a, v in axes.items()],
        (tx.split_names(aliases) if aliases is not None else F.array().cast("array<string>")).alias("aliases"),
    )
    return out.filter("anchor_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


def alias_entries(inventory: DataFrame) -> DataFrame:
    """One row per spelling: the name itself, then its aliases, in inventory order."""
    spellings = F.concat(F.array("anchor_id"), "aliases")
    rows = inventory.select("scene", "anchor_seq", "anchor_id", F.posexplode(spellings).alias("alias_pos", "alias"))
    return rows.withColumn("key", tx.label_key("alias")).filter("key <> ''")


def alias_map(inventory: DataFrame) -> DataFrame:
    """``scene, key -> canonical``; a later spelling overwrites an earlier one."""
    last = first_by(alias_entries(inventory), ["scene", "key"], ["anchor_seq", "alias_pos"], last=True)
    return last.select("scene", "key", F.col("anchor_id").alias("canonical"))


def canonicalize(df: DataFrame, aliases: DataFrame, label: str = "label", out: str = "canonical") -> DataFrame:
    """Resolve labels through the alias map, then through the rewritten key; NULL when unsupported."""
    side = F.broadcast if within_rows(aliases) else (lambda d: d)
    direct = side(aliases.select("scene", F.col("key").alias("_k"), F.col("canonical").alias("_direct")))
    second = side(aliases.select("scene", F.col("key").alias("_f"), F.col("canonical").alias("_rewritten")))
    keyed = df.withColumn("_k", tx.label_key(label)).withColumn("_f", tx.fallback_label_key(F.col("_k")))
    joined = keyed.join(direct, ["scene", "_k"], "left").join(second, ["scene", "_f"], "left")
    return joined.withColumn(out, F.coalesce("_direct", "_rewritten")).select(*df.columns, out)


def label_flags(gt: DataFrame, pred: DataFrame, label: str = "label") -> DataFrame:
    """``key, label, in_gt, in_pred`` — one row per distinct label of an interaction."""
    left = gt.select(*KEY, label, F.lit(1).alias("in_gt"), F.lit(0).alias("in_pred"))
    right = pred.select(*KEY, label, F.lit(0).alias("in_gt"), F.lit(1).alias("in_pred"))
    both = left.unionByName(right).filter(F.col(label).isNotNull() & (F.col(label) != ""))
    return both.groupBy(*KEY, label).agg(F.max("in_gt").alias("in_gt"), F.max("in_pred").alias("in_pred"))


def ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(empty).cast("double"))


def prf(tp, fp, fn, empty: float | None = None) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 from counts; ``empty`` is the value of an undefined ratio."""
    tp, fp, fn = (F.col(c) if isinstance(c, str) else c for c in (tp, fp, fn))
    p, r = ratio(tp, tp + fp, empty), ratio(tp, tp + fn, empty)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(empty).cast("double"))
    return p, r, f1


def score_sets(keys: DataFrame, flags: DataFrame) -> DataFrame:
    """Set-match detail for every key (keys without labels get zero counts)."""
    hit, gt, pred = F.col("in_gt") * F.col("in_pred"), F.col("in_gt"), F.col("in_pred")
    counts = flags.groupBy(*KEY).agg(
        F.sum(hit).alias("tp"), F.sum(pred - hit).alias("fp"), F.sum(gt - hit).alias("fn")
    )
    rows = keys.join(counts, KEY, "left").fillna(0, ["tp", "fp", "fn"])
    p, r, f1 = prf("tp", "fp", "fn")
    n_gt = F.col("tp") + F.col("fn")
    return (
        rows.withColumn("gt_count", n_gt)
        .withColumn("evaluable", n_gt > 0)
        .withColumn("hit", F.col("tp") > 0)
        .withColumn("exact", (n_gt > 0) & (F.col("fp") == 0) & (F.col("fn") == 0))
        .withColumn("set_precision", p)
        .withColumn("set_recall", r)
        .withColumn("set_f1", f1)
    )


def set_overlap(flags: DataFrame, label: str = "label") -> DataFrame:
    """Sorted matched / extra / missed labels; lists hold distinct inventory labels, so the inventory bounds them."""

    def names(cond: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.expr(cond), F.col(label))))

    return flags.groupBy(*KEY).agg(
        names("in_gt = 1 AND in_pred = 1").alias("tp_labels"),
        names("in_gt = 0").alias("fp_labels"),
        names("in_pred = 0").alias("fn_labels"),
    )


def build_gt(match_eval: DataFrame, anchors: DataFrame) -> DataFrame:
    """Ordered GT anchors per interaction from referent names; first occurrence of a name counts.

    The list is a set of inventory objects, so its length is bounded by the scene inventory.
    """
    named = match_eval.join(
        small_side(anchors.withColumnRenamed("anchor_id", "label")), ["scene", "label"]
    )
    first = named.groupBy(*KEY, "label", "x", "y", "z").agg(F.min("gt_seq").alias("gt_seq"))
    item = F.struct("gt_seq", F.col("label").alias("id"), F.struct("x", "y", "z").alias("point"))
    return first.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("gt"))


def select_rows(df: DataFrame, scenes: Sequence[str] | None = None, start: int = 0, limit: int | None = None,
                keys: DataFrame | None = None) -> DataFrame:
    """Rows by scene and index range; an explicit key table overrides both."""
    if keys is not None:
        return df.join(keys.select(*KEY), KEY, "left_semi")
    out = df.filter(F.col("row_index") >= start)
    if limit is not None:
        out = out.filter(F.col("row_index") < start + limit)
    return out.filter(F.col("scene").isin(*scenes)) if scenes else out


def positional_slice(ranked: DataFrame, start: int, limit: int, rank: str = "rank") -> DataFrame:
    """Slice by 1-based rank inside the scene (see ``scale.bucket_rank``)."""
    return ranked.filter((F.col(rank) > start) & (F.col(rank) <= start + limit))


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that lack a required value, one row per missing column."""
    missing = F.array_compact(F.array(*[F.when(tx.is_missing(c), F.lit(c)) for c in columns]))
    return df.withColumn("missing_column", F.explode(missing))


def last_wins(df: DataFrame, keys: Sequence[str], seq: str = "file_seq") -> DataFrame:
    return first_by(df, keys, [seq], last=True)


def merge_first_wins(sources: Sequence[DataFrame], keys: Sequence[str] = KEY) -> DataFrame:
    """First source that has a key wins; ``n_sources`` counts how many had it."""
    tagged = [s.withColumn("source_order", F.lit(i)) for i, s in enumerate(sources)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), "source_order").alias("_r"), F.count_distinct("source_order").alias("n_sources")
    )
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest], "n_sources")


def merge_strict(shards: Sequence[DataFrame], keys: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """Union of shards with differing columns, and the keys that break the no-duplicates rule."""
    rows = shards[0]
    for s in shards[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    duplicates = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return rows, duplicates


def expected_grid(counts: DataFrame, chunk: int = 100_000) -> DataFrame:
    """``scene, n`` to one row per expected ``row_index`` (0-based), generated chunk by chunk over many tasks."""
    starts = counts.filter("n > 0").select("scene", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk))).alias("_c"))
    starts = starts.repartition("scene", "_c")
    last = F.least(F.col("n"), (F.col("_c") + 1) * chunk) - 1
    return starts.select("scene", F.explode(F.sequence(F.col("_c") * chunk, last)).alias("row_index"))


def completion_targets(grid: DataFrame, preds: DataFrame) -> DataFrame:
    """Keys still to run: missing from the predictions, or present but not parsed."""
    state = preds.groupBy(*KEY).agg(F.bool_or("parse_ok").alias("_ok"))
    joined = grid.join(state, KEY, "left")
    reason = F.when(F.col("_ok").isNull(), "missing_prediction").when(~F.col("_ok"), "parse_failed")
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").drop("_ok")


def apply_supplements(original: DataFrame, attempts: DataFrame, targets: DataFrame) -> DataFrame:
    """Latest attempt replaces the original row of a target key; other keys keep the original."""
    wanted = attempts.join(targets.select(*KEY), KEY, "left_semi")
    rows = original.withColumn("attempt", F.lit(0)).unionByName(wanted, allowMissingColumns=True)
    return first_by(rows, KEY, ["attempt"], last=True)


def symmetric_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only, labelled ``added`` or ``removed``."""
    tagged = before.select(*keys, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(
        after.select(*keys, F.lit(0).alias("_b"), F.lit(1).alias("_a"))
    )
    seen = tagged.groupBy(*keys).agg(F.max("_b").alias("_b"), F.max("_a").alias("_a"))
    change = F.when(F.col("_a") > F.col("_b"), "added").when(F.col("_b") > F.col("_a"), "removed")
    return seen.withColumn("change", change).filter("change IS NOT NULL").drop("_a", "_b")


def drop_repeated_content(rows: DataFrame, keys: Sequence[str], digest: str, order: str) -> DataFrame:
    """First row per (key, digest)."""
    return first_by(rows, [*keys, digest], [order])


def apply_repairs(table: DataFrame, repairs: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply ``key, column, new_value`` repairs; returns the repaired table and the change log.

    Of several repairs of one cell the last by ``order`` counts; without an order the largest value does.
    """
    def settled(c: str) -> Column:
        new = F.when(F.col("column") == c, F.col("new_value"))
        if order:
            return F.max_by(new, F.when(new.isNotNull(), F.col(order)))
        return F.max(new)

    wide = repairs.groupBy(*keys).agg(*[settled(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(wide, list(keys), "left")
    fixed = joined.select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns]
    )
    changes = F.array_compact(F.array(*[
        F.when(F.col(f"_new_{c}").isNotNull() & ~F.col(f"_new_{c}").eqNullSafe(F.col(c)),
               F.struct(F.lit(c).alias("column"), F.col(c).alias("old_value"), F.col(f"_new_{c}").alias("new_value")))
        for c in columns
    ]))
    return fixed, joined.select(*keys, F.inline(changes))


def merge_aliases(current: Column | str, extra: Column | str) -> Column:
    """Append aliases whose key is not there yet."""
    arrays = [F.col(c) if isinstance(c, str) else c for c in (current, extra)]
    return tx.unique_by_key(F.concat(*arrays))


def merge_fields(base: DataFrame, override: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer merge; a non-empty override value wins."""
    o = override.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns])
    joined = base.join(o, list(keys), "full")
    merged = [
        F.coalesce(F.nullif(tx.norm_text(f"_o_{c}"), F.lit("")), F.col(c), F.lit("")).alias(c) for c in columns
    ]
    return joined.select(*keys, *merged)


def impacted_rows(df: DataFrame, label: str, arrays: Sequence[str]) -> DataFrame:
    cond = F.lit(False)
    for a in arrays:
        cond = cond | F.array_contains(a, label)
    return df.filter(cond)


def first_mentions(df: DataFrame, key: str, text: str) -> DataFrame:
    """Ordered unique names of long texts: one row per (row, label key) with its first spelling."""
    names = df.select(key, F.posexplode(tx.split_names(text)).alias("pos", "name"))
    keyed = names.withColumn("label_key", tx.label_key("name"))
    return keyed.groupBy(key, "label_key").agg(F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"))


def union_runs(runs: Mapping[str, DataFrame], column: str = "model") -> DataFrame:
    """One long fact table instead of one file per model or variant."""
    out = None
    for name, df in runs.items():
        tagged = df.withColumn(column, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def natural_sort_key(c: Column | str, width: int = 12) -> Column:
    """Zero-pad digit runs so that text order equals natural order."""
    col = F.col(c) if isinstance(c, str) else c
    parts = F.regexp_extract_all(col, F.lit(r"(\d+|\D+)"), 1)
    return F.concat_ws("", F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, width, "0")).otherwise(p)))


def resolve_assets(listing: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Per directory, the file of the first pattern with a match; several matches are an error status."""
    priority = F.lit(None).cast("int")
    for i, pattern in reversed(list(enumerate(patterns))):
        priority = F.when(F.col("file").rlike(pattern), F.lit(i)).otherwise(priority)
    ranked = listing.withColumn("priority", priority)
    per_level = ranked.groupBy("directory", "priority").agg(F.count("*").alias("n"), F.min("file").alias("file"))
    best = per_level.groupBy("directory").agg(
        F.min_by(F.struct("priority", "n", "file"), F.when(F.col("priority").isNotNull(), F.col("priority"))).alias("_b")
    )
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_b.n") > 1, "ambiguous").otherwise("ok")
    return best.select(
        "directory", status.alias("status"), F.col("_b.priority").alias("priority"),
        F.when(status == "ok", F.col("_b.file")).alias("file"),
    )


def scene_order(df: DataFrame, order: DataFrame) -> DataFrame:
    """Sort by a custom scene rank, then row index."""
    return df.join(small_side(order), "scene", "left").orderBy("scene_rank", "row_index")


def row_numbers(df: DataFrame, partition: Sequence[str], order: Sequence[Column | str], out: str = "row_number") -> DataFrame:
    """Plain window numbering for short lists (instruction sheets, inventories)."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
