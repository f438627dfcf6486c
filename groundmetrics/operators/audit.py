"""Key health, fingerprints, consistency checks and audit tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundmetrics.functions import payload as pl
from groundmetrics.operators.scale import small_side
from groundmetrics.operators.sets import KEY


def alias_collisions(entries: DataFrame) -> DataFrame:
    """Label keys that lead to more than one anchor of a scene."""
    return (
        entries.groupBy("scene", "key")
        .agg(F.count_distinct("anchor_id").alias("n_anchors"), F.min("anchor_id").alias("first_anchor"),
             F.max("anchor_id").alias("last_anchor"))
        .filter("n_anchors > 1")
    )


def inventory_defects(inventory: DataFrame, forbidden: Sequence[str] = ()) -> DataFrame:
    """Empty, duplicate, forbidden or coordinate-less anchors, one row per defect."""
    n = inventory.groupBy("scene", "anchor_id").agg(F.count("*").alias("copies"))
    joined = inventory.join(n, ["scene", "anchor_id"], "left")
    coords = [F.col(a).isNull() | F.isnan(a) | (F.abs(a) == float("inf")) for a in "xyz"]
    defects = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("anchor_id"), F.lit("")) == "", F.lit("empty_name")),
        F.when(F.col("copies") > 1, F.lit("duplicate_name")),
        F.when(F.col("anchor_id").isin(*forbidden) if forbidden else F.lit(False), F.lit("forbidden_name")),
        F.when(coords[0] | coords[1] | coords[2], F.lit("nonfinite_point")),
    ))
    return joined.select("scene", "anchor_id", F.explode(defects).alias("defect"))


def mapping_audit(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    joined = actual.join(small_side(expected), list(keys), "left")
    return joined.withColumn("agrees", F.col("actual").eqNullSafe(F.col("expected")))


def loader_counts(loaders: Mapping[str, DataFrame]) -> DataFrame:
    """Anchors of the same inventory as seen by several loaders."""
    out = None
    for name, df in loaders.items():
        n = df.groupBy("scene").agg(F.count_distinct("anchor_id").alias("n")).withColumn("loader", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out


def taxonomy_stats(keys: DataFrame, gt: DataFrame, taxonomy: DataFrame, category: str) -> DataFrame:
    """Per scene: anchors of the category, interactions, and interactions that touch the category."""
    wanted = taxonomy.filter(F.col("category") == category)
    touched = gt.join(small_side(wanted.select("scene", "canonical")), ["scene", "canonical"], "left_semi")
    touched = touched.select(*KEY).distinct().groupBy("scene").agg(F.count("*").alias("touched"))
    total = keys.groupBy("scene").agg(F.count("*").alias("interactions"))
    anchors = taxonomy.groupBy("scene").agg(F.count_if(F.col("category") == category).alias("taxonomy_anchors"))
    return anchors.join(total, "scene").join(touched, "scene", "left").fillna(0, ["touched"])


def taxonomy_orphans(taxonomy: DataFrame, inventory: DataFrame) -> DataFrame:
    """Taxonomy entries without an anchor in the inventory."""
    names = inventory.select("scene", F.col("anchor_id").alias("canonical"))
    return taxonomy.join(names, ["scene", "canonical"], "left_anti")


def key_health(rows: DataFrame, expected: DataFrame, keys: Sequence[str] = KEY, by: Sequence[str] = ()) -> DataFrame:
    """Rows, unique keys, duplicates, missing and extra against the expected keys, in one pass over both."""
    by = list(by)
    tagged = rows.select(*by, *keys, F.lit(1).alias("_r"), F.lit(0).alias("_e")).unionByName(
        expected.select(*by, *keys, F.lit(0).alias("_r"), F.lit(1).alias("_e"))
    )
    per_key = tagged.groupBy(*by, *keys).agg(F.sum("_r").alias("_r"), F.max("_e").alias("_e"))
    have = F.col("_r") > 0
    return per_key.groupBy(*by).agg(
        F.sum("_r").alias("rows"), F.count_if(have).alias("unique_keys"),
        (F.sum("_r") - F.count_if(have)).alias("duplicates"),
        F.count_if(~have & (F.col("_e") == 1)).alias("missing"),
        F.count_if(have & (F.col("_e") == 0)).alias("extra"),
    )


def key_diff(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Keys of ``left`` labelled ``common`` or ``missing``, and those only in ``right`` as ``extra``."""
    k = list(keys)
    tagged = left.select(*k, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*k, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    seen = tagged.groupBy(*k).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    side = F.when(F.col("_l") + F.col("_r") == 2, "common").when(F.col("_l") == 1, "missing").otherwise("extra")
    return seen.select(*k, side.alias("side"))


def _digest_part(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def set_fingerprint(df: DataFrame, by: Sequence[str], text: Column) -> DataFrame:
    """Order-free fingerprint of a key set: count, sum and xor of SHA-256 words (any size, partial aggregation)."""
    d = df.select(*by, F.sha2(text, 256).alias("_d"))
    return d.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(_digest_part(F.col("_d"), 1)).alias("hash_sum"),
        F.bit_xor(_digest_part(F.col("_d"), 9)).alias("hash_xor"),
    )


def set_fingerprint_text(df: DataFrame, by: Sequence[str], text: Column, limit: int = 1_000_000,
                         trailing_newline: bool = False) -> DataFrame:
    """SHA-256 over the sorted newline-joined keys, for exchange with files that store that digest.

    It has to see a whole group as one string, so groups above ``limit`` are refused; compare those
    with ``set_fingerprint``, which decides set equality at any size.
    """
    largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest > limit:
        raise ValueError(f"group of {largest} keys: use set_fingerprint")
    joined = F.concat_ws("\n", F.array_sort(F.collect_list(text)))
    if trailing_newline:
        joined = F.concat(joined, F.lit("\n"))
    return df.groupBy(*by).agg(F.sha2(joined, 256).alias("sha256"))


def variant_consistency(rows: DataFrame, variant: str, baseline: str, keys: Sequence[str], value: str) -> DataFrame:
    """Per variant: same keys as the baseline, and same ground truth on every row.

    The baseline is matched once per key; ``matched`` counts baseline keys found, so that missing and
    extra keys show up without a full join per variant.
    """
    base = rows.filter(F.col(variant) == baseline)
    base_size = base.agg(F.count("*").alias("_n_base"))
    b = base.select(*keys, F.col(value).alias("_base"), F.lit(True).alias("_found"))
    joined = rows.join(b, list(keys), "left")
    per = joined.groupBy(variant).agg(
        F.count("*").alias("n_rows"), F.count_if("_found").alias("n_matched"),
        F.bool_and(F.coalesce("_found", F.lit(False)) & F.col(value).eqNullSafe(F.col("_base"))).alias("same_gt"),
    )
    per = per.crossJoin(F.broadcast(base_size))  # one row
    return per.select(
        variant, "n_rows", ((F.col("n_rows") == F.col("_n_base")) & (F.col("n_matched") == F.col("_n_base"))).alias("same_keys"),
        "same_gt",
    )


def cross_checks(prints: DataFrame, by: Sequence[str]) -> DataFrame:
    """Equality of fingerprints and row counts across the models of an experiment, with a JSON verdict."""
    same = F.count_distinct("hash_sum", "hash_xor") == 1
    out = prints.groupBy(*by).agg(
        F.count("*").alias("n_models"), same.alias("same_keys"), (F.min("n") == F.max("n")).alias("same_rows"),
        F.bool_and("finite").alias("finite_metrics"),
    )
    checks = F.struct("same_keys", "same_rows", "finite_metrics")
    return out.withColumn("passed", F.col("same_keys") & F.col("same_rows") & F.col("finite_metrics")).withColumn(
        "checks_json", F.to_json(checks)
    )


def denominator_audit(detail: DataFrame) -> DataFrame:
    """Reasons why a row is outside a denominator, long form: one row per (key, reason)."""
    reasons = F.array_compact(F.array(
        F.when(F.col("n_unmapped") > 0, F.lit("unmapped_gt")),
        F.when(F.col("n_pred") == 0, F.lit("missing_prediction")),
        F.when(~F.col("evaluable"), F.lit("excluded_no_mapped_gt")),
        F.when(~F.col("valid_output"), F.lit("invalid_output")),
    ))
    return detail.select(*KEY, F.explode(reasons).alias("reason"))


def audit_context(df: DataFrame, expectations: DataFrame, text: str, variant: str = "variant") -> DataFrame:
    """Per rendered record: which payload flags contradict the expectation of its variant."""
    t = F.col(text)
    flags = {
        "has_visual_path": t.contains("image:") & ~t.contains("image: [visual_evidence_withheld]"),
        "has_gaze_payload": t.rlike(r"\bP\d+_GAZE:\s*\["),
        "has_hand_payload": t.rlike(r"\bP\d+_HAND:\s*\["),
        "has_instruction_value": t.rlike(r"instruction_text:[ ]*\S"),
        "contains_nan_or_inf": F.lower(t).rlike(r"\b(nan|[+-]?inf(inity)?)\b"),
    }
    flagged = df.withColumns(flags).join(small_side(expectations), variant)
    broken = F.array_compact(F.array(*[
        F.when(F.col(f) != F.col(f"expect_{f}"), F.lit(f)) for f in flags if f"expect_{f}" in expectations.columns
    ], F.when(F.col("contains_nan_or_inf"), F.lit("contains_nan_or_inf"))))
    return flagged.withColumn("failures", broken)


def forbidden_columns(df: DataFrame, forbidden: Sequence[str]) -> list[str]:
    """Columns of a model-facing table that would leak ground truth."""
    return sorted(c for c in df.columns if c in set(forbidden))


def metric_reproduction(recomputed: DataFrame, stored: DataFrame, on: Sequence[str], metrics: Sequence[str], eps: float = 1e-12) -> DataFrame:
    s = stored.select(*on, *[F.col(m).alias(f"_s_{m}") for m in metrics])
    joined = recomputed.join(small_side(s), list(on), "full")
    checks = [(F.abs(F.col(m) - F.col(f"_s_{m}")) <= eps).alias(f"ok_{m}") for m in metrics]
    return joined.select(*on, *checks)


def same_as_baseline(rows: DataFrame, variant: str, baseline: str, keys: Sequence[str], payload: str, list_key: str | None = "points_3d") -> DataFrame:
    """Rows of each variant, and how many hold the baseline's JSON payload in every field, however it is spelled.

    Payloads travel as 128 bits of the SHA-256 of their canonical form, not as texts.
    """
    canon = rows.select(variant, *keys, F.substring(F.sha2(pl.canonical_json(payload, list_key), 256), 1, 32).alias("_p"))
    base = canon.filter(F.col(variant) == baseline).select(*keys, F.col("_p").alias("_b"), F.lit(1).alias("_f"))
    joined = canon.join(base, list(keys), "left")
    same = F.col("_f").isNotNull() & F.col("_p").eqNullSafe(F.col("_b"))
    return joined.groupBy(variant).agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"))


def acceptance_gates(summary: DataFrame) -> DataFrame:
    gates = [
        (F.col("valid_rate") >= 0.98).alias("valid_rate_ok"),
        (F.col("median_error_deg") <= 15.0).alias("median_ok"),
        (F.col("acc_at_20_all") >= 0.60).alias("acc20_ok"),
    ]
    out = summary.select("*", *gates)
    return out.withColumn("accepted", F.coalesce(F.col("valid_rate_ok") & F.col("median_ok") & F.col("acc20_ok"), F.lit(False)))


def export_evidence(gt: DataFrame, pred: DataFrame, detail: DataFrame) -> DataFrame:
    """One row per interaction: ground truth, prediction and detail side by side (keys checked by ``key_health``)."""
    joined = gt.join(pred, KEY, "left").join(detail, KEY, "left")
    return joined.withColumn("unified_id", F.concat_ws("::", "scene", F.col("row_index").cast("string")))


def run_registry(runs: DataFrame, prints: DataFrame, summaries: DataFrame, on: Sequence[str]) -> DataFrame:
    """Run dimension with fingerprints and headline metrics."""
    return runs.join(small_side(prints), list(on), "left").join(small_side(summaries), list(on), "left")
