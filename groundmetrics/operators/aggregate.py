"""Corpus metrics: micro/macro scores, grouping sets, roll-ups, deltas and bootstrap intervals."""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundmetrics.operators.scale import global_rank, small_side
from groundmetrics.operators.sets import prf, ratio
from groundmetrics.session import checkpointed



def micro_prf(df: DataFrame, by: Sequence[str] = (), empty: float | None = 0.0) -> DataFrame:
    sums = df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f1 = prf("tp", "fp", "fn", empty)
    return sums.select(*by, "tp", "fp", "fn", p.alias("micro_precision"), r.alias("micro_recall"), f1.alias("micro_f1"))


def macro_columns() -> list[Column]:
    """Per-row means over evaluable rows: undefined rows skipped, and the same with undefined as zero."""
    ok = F.col("evaluable")
    return [
        F.avg(F.when(ok, F.col("set_precision"))).alias("macro_precision"),
        F.avg(F.when(ok, F.col("set_recall"))).alias("macro_recall"),
        F.avg(F.when(ok, F.col("set_f1"))).alias("macro_f1_defined"),
        F.avg(F.when(ok, F.coalesce("set_f1", F.lit(0.0)))).alias("macro_f1_zero"),
    ]


def anchor_columns() -> list[Column]:
    """Counts behind the closed-set rate table."""
    ok = F.col("evaluable")
    return [
        F.count("*").alias("num_total"),
        F.count_if(ok).alias("num_evaluable"),
        F.count_if("valid_output").alias("valid_output_count"),
        F.count_if("hit").alias("hit_count"),
        F.count_if(ok & F.col("hit")).alias("hit_mapped_count"),
        F.count_if(ok & F.col("exact")).alias("exact_count"),
        F.sum(F.when(ok, F.coalesce("set_f1", F.lit(0.0))).otherwise(0.0)).alias("f1_sum"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
    ]


def anchor_rates(counts: DataFrame) -> DataFrame:
    """Ratios from the counts of ``anchor_columns`` (so that roll-ups recompute them)."""
    total, ok = F.col("num_total"), F.col("num_evaluable")
    p, r, f1 = prf("tp", "fp", "fn", 0.0)
    rates = {
        "coverage": ratio(ok, total, 0.0), "valid_output_rate": ratio(F.col("valid_output_count"), total, 0.0),
        "hit_all": ratio(F.col("hit_count"), total, 0.0), "hit_mapped": ratio(F.col("hit_mapped_count"), ok, 0.0),
        "exact": ratio(F.col("exact_count"), ok, 0.0), "set_f1_macro": ratio(F.col("f1_sum"), ok, 0.0),
        "micro_precision": p, "micro_recall": r, "micro_f1": f1,
    }
    keep = [c for c in counts.columns if c != "f1_sum"]
    return counts.select(*keep, *[v.alias(k) for k, v in rates.items()])


def target_bucket(count: Column | str, zero: str = "multi_target") -> Column:
    """Single / multi target label; ``zero`` says where rows without targets go."""
    n = F.col(count) if isinstance(count, str) else count
    return F.when(n == 1, "single_target").when(n > 1, "multi_target").otherwise(zero)


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column], label: str = "partition",
                  missing: str = "missing") -> DataFrame:
    """Several partitions in one pass; ``label`` names the partition of each row, a NULL group by ``missing``.

    Which columns a row is grouped by is read from the grouping itself, so a NULL group is not the overall row.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        *[F.grouping(c).alias(f"_out_{c}") for c in columns], *aggregates
    )
    names = [F.when(F.col(f"_out_{c}") == 0, F.coalesce(F.col(c).cast("string"), F.lit(missing))) for c in columns]
    return grouped.withColumn(label, F.coalesce(*names, F.lit("overall"))).drop(*[f"_out_{c}" for c in columns], *columns)


def summary_rollup(df: DataFrame, outer: str, inner: str, total: str = "ALL") -> DataFrame:
    """Counts per (outer, inner) plus one ``total`` row per outer value; ratios are recomputed. A NULL inner value stays NULL."""
    counts = df.groupingSets([[F.col(outer), F.col(inner)], [F.col(outer)]], outer, inner).agg(F.grouping(inner).alias("_all"), *anchor_columns())
    return anchor_rates(counts.withColumn(inner, F.when(F.col("_all") == 1, total).otherwise(F.col(inner))).drop("_all"))


def delta_vs_baseline(summary: DataFrame, variant: str, baseline: str, on: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric minus the baseline's metric of the same partition; summaries are small, the check guards it."""
    base = summary.filter(F.col(variant) == baseline).select(*on, *[F.col(m).alias(f"_b_{m}") for m in metrics])
    joined = summary.join(small_side(base), list(on), "left")
    return joined.select(
        variant, *on, *metrics,
        *[(F.col(m) - F.coalesce(f"_b_{m}", F.lit(0.0))).alias(f"delta_{m}") for m in metrics],
    )


BOOTSTRAP_GROUPS, BOOTSTRAP_REPS = 1024, 10_000
# Odd 32-bit multipliers of the weight hash; the SQL counterpart uses the same ones.
HASH_REP, HASH_GROUP, HASH_MIX = 0x9E3779B1, 0x85EBCA77, 0x45D9F3B


def poisson_steps() -> list[int]:
    """Ends of the 32-bit hash ranges of Poisson(1) weights 0, 1, 2, ...: the weight of a hash is the number of ends at or below it."""
    steps, term, total, k = [], math.exp(-1.0), 0.0, 0
    while int((total + term) * 2**32) < 2**32 - 1:
        total += term
        steps.append(int(total * 2**32))
        k += 1
        term /= k
    return steps


def bootstrap_weights(reps: np.ndarray, groups: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) weights (repetitions x groups), a pure function of repetition, group and seed."""
    low = np.uint64(0xFFFFFFFF)
    x = (reps.astype(np.uint64)[:, None] * np.uint64(HASH_REP) + groups.astype(np.uint64)[None, :] * np.uint64(HASH_GROUP) + np.uint64(seed)) & low
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(HASH_MIX)) & low
    x ^= x >> np.uint64(16)
    return np.searchsorted(np.array(poisson_steps(), np.uint64), x, side="right").astype(np.float64)


def bootstrap_group(keys: Sequence[str], groups: int) -> Column:
    """Group of an interaction: the first 32 bits of the MD5 of its key, modulo ``groups``."""
    return F.conv(F.substring(F.md5(F.concat_ws("::", *keys).cast("binary")), 1, 8), 16, 10).cast("bigint") % groups


def pair_runs(full: DataFrame, ablations: DataFrame, keys: Sequence[str], metrics: Mapping[str, str | None]) -> DataFrame:
    """(other columns of ``ablations``, keys, metric, full_value, ablation_value, mask): both runs' values of the same interaction.

    ``metrics`` names the value columns and, for each, the mask column of the full run (None: every interaction counts). Interactions
    that one of the runs lacks are left out; NULL values count as 0 and NULL masks as false.
    """
    values = list(metrics)
    masks = sorted({m for m in metrics.values() if m})
    base = full.select(*keys, *[F.col(v).cast("double").alias(f"_f_{v}") for v in values], *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(f"_m_{m}") for m in masks])
    by = [c for c in ablations.columns if c not in (*keys, *values, *masks)]
    joined = ablations.select(*by, *keys, *[F.col(v).cast("double").alias(v) for v in values]).join(base, list(keys))
    zero = F.lit(0.0)
    rows = F.array(*[F.struct(F.lit(v).alias("metric"), F.coalesce(F.col(f"_f_{v}"), zero).alias("full_value"), F.coalesce(F.col(v), zero).alias("ablation_value"),
                              (F.col(f"_m_{m}") if m else F.lit(1.0)).alias("mask")) for v, m in metrics.items()])
    return joined.select(*by, *keys, F.inline(rows))


def paired_bootstrap(pairs: DataFrame, by: Sequence[str], keys: Sequence[str], reps: int = BOOTSTRAP_REPS, seed: int = 2027, groups: int = BOOTSTRAP_GROUPS) -> DataFrame:
    """Percentile interval of (ablation - full) for masked means, from the rows of ``pair_runs``.

    Interactions fall into ``groups`` hash groups that are summed by Spark (three numbers per group, combined before the shuffle); every
    repetition draws one Poisson(1) weight per group. With fewer interactions than groups that is a bootstrap of interactions,
    beyond that one of random groups, with the same expected interval. A task sees at most ``groups`` rows per metric, whatever the
    input, and no row per repetition ever exists. Repetitions without any weight have difference 0.
    """
    by = [*by, "metric"]
    weight = lambda c: F.sum(F.col("mask") * F.col(c))
    sums = pairs.groupBy(*by, bootstrap_group(keys, groups).alias("_group")).agg(
        weight("full_value").alias("_full"), weight("ablation_value").alias("_ablation"), F.sum("mask").alias("_mask"), F.count("*").alias("_n"))

    def draw(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = frame[["_full", "_ablation", "_mask"]].to_numpy(np.float64)
        number = frame["_group"].to_numpy(np.int64)
        diffs = []
        for start in range(0, reps, 500):
            full, ablation, mask = (bootstrap_weights(np.arange(start, min(start + 500, reps)), number, seed) @ values).T
            diffs.append((ablation - full) / np.where(mask == 0, 1.0, mask))
        low, high = np.percentile(np.concatenate(diffs), [2.5, 97.5])
        full, ablation, mask = values.sum(axis=0)
        mask = mask or 1.0
        return pd.DataFrame([(*key, int(frame["_n"].sum()), full / mask, ablation / mask, (ablation - full) / mask, low, high, bool(low > 0 or high < 0))])

    kinds = ", ".join(f"{pairs.schema[c].name} {pairs.schema[c].dataType.simpleString()}" for c in by)
    # Tiny rows, dear draws: one partition per core, which adaptive execution would otherwise merge into one.
    sums = sums.repartition(pairs.sparkSession.sparkContext.defaultParallelism, *by)
    return sums.groupBy(*by).applyInPandas(draw, f"{kinds}, pairs bigint, full_value double, ablation_value double, delta double, ci95_low double, ci95_high double, significant boolean")


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def before_after(before: DataFrame, after: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long comparison of two result snapshots."""
    b = unpivot_metrics(before, ids, metrics).withColumnRenamed("value", "before_value")
    a = unpivot_metrics(after, ids, metrics).withColumnRenamed("value", "after_value")
    joined = b.join(a, [*ids, "metric"], "full")
    return joined.withColumn("change", F.col("after_value") - F.col("before_value"))


def value_counts(df: DataFrame, columns: Sequence[str], count: str = "n") -> DataFrame:
    """Counter ordered by (-count, label)."""
    return df.groupBy(*columns).agg(F.count("*").alias(count)).orderBy(F.desc(count), *columns)


def counter_map(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Counts of a small closed label set as one map per group."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(label, "n")))
    return counts.groupBy(*by).agg(F.map_from_entries(entries).alias("counts"))


def error_extremes(df: DataFrame, error: str, k: int = 6, tie: Sequence[str] = ("scene", "row_index")) -> DataFrame:
    """``k`` lowest and ``k`` highest finite errors; both sides are top-k, no global sort.

    The errors are written once: each side would otherwise compute all that lies behind them.
    """
    finite = checkpointed(df.filter(F.col(error).isNotNull() & ~F.isnan(error)))
    low = finite.orderBy(F.asc(error), *tie).limit(k).withColumn("side", F.lit("lowest"))
    high = finite.orderBy(F.desc(error), *tie).limit(k).withColumn("side", F.lit("highest"))
    return low.unionByName(high)


def quantile_rows(df: DataFrame, value: str, quantiles: Sequence[float], ties: Sequence[str] = ("scene", "row_index"), rank: str = "rank",
                  accuracy: int = 10_000) -> DataFrame:
    """Rows at ranks ``int((n - 1) * q) + 1`` by ``value``, then ``ties``; rows without a number take no part.

    A mergeable sketch gives a bracket of values around each rank, one more scan counts exactly what lies
    below and inside the brackets, and only the rows inside are sorted. If a count shows a rank outside its bracket, all rows are.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    marks = [min(1.0, max(0.0, q + side * 3.0 / accuracy)) for q in quantiles for side in (-1, 1)]
    v = F.col(value)
    head = rows.agg(F.count("*").alias("n"), F.percentile_approx(v, marks, accuracy).alias("marks"), F.min(v).alias("low"), F.max(v).alias("high")).first()
    spans: list[tuple] = []
    for low, high in sorted(zip(head.marks[::2], head.marks[1::2])) if head.n else []:
        if spans and low <= spans[-1][1]:
            low, high = spans[-1][0], max(high, spans.pop()[1])
        spans.append((low, high))

    def inside(span: tuple) -> Column:
        return v.between(F.lit(span[0]), F.lit(span[1]))

    at = [int((head.n - 1) * q) for q in quantiles] if head.n else []
    counts = rows.agg(F.count("*"), *[c for s in spans for c in (F.count_if(v < F.lit(s[0])), F.count_if(inside(s)))]).first()[1:]
    # (rows below, rows inside, rows of earlier brackets) of each bracket
    known = [(counts[2 * i], counts[2 * i + 1], sum(counts[1:2 * i:2])) for i in range(len(spans))]
    if not all(any(below <= r < below + n for below, n, _ in known) for r in at):
        spans, known = [(head.low, head.high)], [(0, head.n, 0)]
    near = rows.filter(functools.reduce(Column.__or__, [inside(s) for s in spans], F.lit(False)))
    picks = [(float(q), r + 1, r - below + before + 1) for q, r in zip(quantiles, at) for below, n, before in known if below <= r < below + n]
    wanted = df.sparkSession.createDataFrame(picks, f"quantile double, {rank} bigint, _place bigint")
    # one row per quantile
    return global_rank(near, [value, *ties], "_place").join(F.broadcast(wanted), "_place").drop("_place")
