"""Building blocks that keep hot keys spread over many tasks.

* small sides are broadcast only after a row count; larger ones join by shuffle,
* "first/last of group" goes through aggregates with map-side combine, never through ``collect_list``,
* ordered work inside a key is cut into time or rank buckets, and only one summary row per bucket
  is carried from one bucket to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundmetrics.session import checkpointed

BROADCAST_ROWS = 500_000


_size_checks: dict[tuple, bool | int] = {}


def within_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``limit`` rows.

    The verdict is remembered per plan: it only steers the join strategy, never the result.
    """
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), limit)
    if key not in _size_checks:
        _size_checks[key] = df.limit(limit + 1).count() <= limit
    return _size_checks[key]


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast after a row count; above the limit the join stays a shuffled one (AQE splits skew)."""
    return F.broadcast(df) if within_rows(df, limit) else df


def shuffled(df: DataFrame) -> DataFrame:
    """A side that grows with the data: joined by sort and merge, whatever its size is estimated at.

    Estimates start from compressed files and do not count what an explode multiplies, so such a side could be sent to the driver
    and broadcast. Skewed partitions are still split by AQE.
    """
    return df.hint("merge")


TASK_ROWS = 50_000


def partitions_for(source: DataFrame, rows: int = TASK_ROWS) -> int | None:
    """How many partitions of ``rows`` rows ``source`` has, None if the session's shuffle partitions are enough. ``source`` should be
    cheap to count, a scan or a checkpoint."""
    key = (source.sparkSession.sparkContext.applicationId, source.semanticHash(), "rows")
    if key not in _size_checks:
        _size_checks[key] = source.count()
    n = _size_checks[key] // rows + 1
    return n if n > int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, cols: Sequence[Column | str], source: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Hash partitions by ``cols``, as many as ``source`` has ``rows``, if those are more than the session's shuffle partitions.

    What a task sorts then stays the same while the data grows.
    """
    n = partitions_for(source, rows)
    return df.repartition(n, *cols) if n else df


def by_keys(df: DataFrame, keys: Sequence[str], source: DataFrame) -> DataFrame:
    """Hash partitions by ``keys``, as ``merged_nearest`` leaves its rows for samples ``source``."""
    n = partitions_for(source)
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan that has fewer splits than cores before costly per-row work; large scans pass through."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key: the one with the lowest (or highest) ``order``; partial aggregation before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    ordering = F.struct(*order) if len(order) > 1 else F.col(order[0])
    row = df.groupBy(*keys).agg(pick(F.struct(*rest), ordering).alias("_row"))
    return row.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key; Spark prunes to ``k`` per task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def bucket_rank(df: DataFrame, keys: Sequence[str], order: str, out: str, width: int = 1_000_000,
                ties: Sequence[str] = ()) -> DataFrame:
    """1-based rank by a whole-number column (``ties`` settle equal values).

    Each task sorts one ``width``-wide slice of the number range, so it holds at most ``width`` rows
    of a key however large the key is; slice counts are summed up separately.
    """
    b = df.withColumn("_b", F.floor(F.col(order) / width))
    counts = b.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order, *ties)
    ranked = b.withColumn("_rn", F.row_number().over(inside))
    joined = ranked.join(shuffled(offsets), [*keys, "_b"])
    return joined.withColumn(out, F.col("_off") + F.col("_rn")).drop("_b", "_n", "_rn", "_off")


def global_rank(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """1-based rank over the whole table for any ordering.

    The table is range-sorted (balanced even when one value holds a third of the rows, as long as the
    ordering ends in a unique column), materialised, and numbered from per-partition row counts.
    """
    low = (1 << 33) - 1
    placed = checkpointed(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    # one row per shuffle partition: small by construction
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        placed.withColumn("_p", part)
        .join(F.broadcast(offsets), "_p")
        .withColumn(out, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(low)) + 1)
        .drop("_p", "_mid", "_off")
    )


def bucket_lead(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], width: int, out: str) -> DataFrame:
    """Time of the next row of the key; rows are ordered inside time slices, slices are chained by their first time."""
    b = df.withColumn("_b", F.floor(F.col(time) / width))
    inside = Window.partitionBy(*keys, "_b").orderBy(time, *order)
    firsts = b.groupBy(*keys, "_b").agg(F.min(time).alias("_first"))
    chain = Window.partitionBy(*keys).orderBy("_b")
    following = firsts.select(*keys, "_b", F.lead("_first").over(chain).alias("_next_first"))
    return (
        b.withColumn("_lead", F.lead(time).over(inside))
        .join(shuffled(following), [*keys, "_b"])
        .withColumn(out, F.coalesce("_lead", "_next_first"))
        .drop("_b", "_lead", "_next_first")
    )


def nearest_sample(
    targets: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    target_time: str,
    sample_time: str,
    seq: str,
    payload: Sequence[str],
    width: int,
    target_counts: DataFrame | None = None,
) -> DataFrame:
    """Two-sided as-of join: the sample closest in time to each target, the earlier one on a tie.

    Of samples that share a stamp the one of the lowest ``seq`` counts. The samples and targets of a key are merged in one sort, unless
    there are more than ``TASK_ROWS`` of them: such keys are cut into slices of ``width`` (``sliced_nearest``), so that no task gets
    a whole long series. Neither form makes a cross product. Targets of a key without samples get NULLs. ``target_counts`` (``keys, n``,
    any number of rows a key) spares the counting of targets.
    """
    keys = list(keys)
    cols = [sample_time, *[p for p in payload if p != sample_time]]
    samples, targets = samples.dropna(subset=[sample_time, seq]), targets.dropna(subset=[*keys, target_time])
    counts = targets.select(*keys, F.lit(1).alias("n")) if target_counts is None else target_counts
    long = crowded(samples, counts, keys)
    if long is None:
        return merged_nearest(targets, samples, keys, target_time, sample_time, seq, cols)
    long = F.broadcast(long)
    few, many = ([side.join(long, keys, how) for side in (targets, samples)] for how in ("left_anti", "left_semi"))
    near = merged_nearest(*few, keys, target_time, sample_time, seq, cols)
    return near.unionByName(sliced_nearest(*many, keys, target_time, sample_time, seq, cols, width))


def crowded(samples: DataFrame, counts: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame | None:
    """Keys whose samples and ``n`` of ``counts`` are more than ``limit``, None without any. They are at most as many as there are ``limit`` rows."""
    limit = limit or TASK_ROWS
    rows = samples.select(*keys, F.lit(1).cast("bigint").alias("n")).unionByName(counts.select(*keys, F.col("n").cast("bigint")))
    many = rows.groupBy(*keys).agg(F.sum("n").alias("_n")).filter(F.col("_n") > limit).select(*keys)
    key = (samples.sparkSession.sparkContext.applicationId, many.semanticHash(), limit, "crowded")
    if key not in _size_checks:
        _size_checks[key] = bool(many.head(1))
    return many if _size_checks[key] else None


def merged_nearest(targets: DataFrame, samples: DataFrame, keys: list[str], target_time: str, sample_time: str, seq: str, cols: list[str]) -> DataFrame:
    """``nearest_sample`` in one shuffle and one sort, a key in one task; the rows come out hash partitioned by ``keys``."""
    rest = [c for c in targets.columns if c not in keys and c != target_time]
    t = targets.select(*keys, F.col(target_time).alias("_t"), F.struct(F.lit(1).alias("_one"), *rest).alias("_target"))
    s = samples.select(*keys, F.col(sample_time).alias("_t"), F.col(seq).alias("_seq"), F.struct(*cols).alias("_s"))
    both = dealt(t.unionByName(s, allowMissingColumns=True).withColumn("_late", F.col("_target").isNotNull()), keys, samples)

    # at equal times samples come first, the lowest seq before the others, which do not count
    order = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY _t, _late, _seq)"
    both = both.withColumn("_same", F.expr(f"lag(_t) {order}").eqNullSafe(F.col("_t")))
    both = both.withColumn("_s", F.when(~F.col("_same"), F.col("_s")))
    near = both.select(
        *keys, "_t", "_target",
        F.expr(f"lag(_s) IGNORE NULLS {order}").alias("_prev"),
        F.expr(f"lead(_s) IGNORE NULLS {order}").alias("_next"),
    ).filter("_target IS NOT NULL")
    return _nearer(near, keys, target_time, sample_time, rest, cols)


def _nearer(near: DataFrame, keys: list[str], target_time: str, sample_time: str, rest: list[str], cols: list[str]) -> DataFrame:
    prev, nxt = F.col("_prev"), F.col("_next")
    first = nxt.isNull() | (F.col("_t") - prev[sample_time] <= nxt[sample_time] - F.col("_t"))
    found = near.select(*keys, "_t", "_target", F.when(first, prev).otherwise(nxt).alias("_pick"))
    return found.select(
        *keys, F.col("_t").alias(target_time), *[F.col("_target")[c].alias(c) for c in rest],
        *[F.col("_pick")[c].alias(c) for c in cols],
    )


def sliced_nearest(targets: DataFrame, samples: DataFrame, keys: list[str], target_time: str, sample_time: str, seq: str, cols: list[str],
                   width: int) -> DataFrame:
    """``nearest_sample`` of long series.

    Samples that share a stamp are first reduced to the lowest ``seq``. Both sides are then merged and
    sorted per (key, time slice); the last/first sample of each slice is carried across empty slices.
    """
    stamped = dealt(samples.withColumn("_t", F.col(sample_time)), [*keys, "_t"], samples)
    s = stamped.groupBy(*keys, "_t").agg(F.min_by(F.struct(*cols), seq).alias("_s"))
    rest = [c for c in targets.columns if c not in keys and c != target_time]
    t = targets.select(*keys, F.col(target_time).alias("_t"), F.struct(F.lit(1).alias("_one"), *rest).alias("_target"))
    both = t.unionByName(s, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / width))
    both = dealt(both, [*keys, "_b"], samples)

    # at equal times the sample row comes first, so that it counts as "not later"
    inside = f"OVER (PARTITION BY {', '.join(keys)}, _b ORDER BY _t, isnotnull(_target))"
    local = both.select(
        *keys, "_b", "_t", "_target",
        F.expr(f"lag(_s) IGNORE NULLS {inside}").alias("_prev"),
        F.expr(f"lead(_s) IGNORE NULLS {inside}").alias("_next"),
    ).filter("_target IS NOT NULL")

    edge = F.when(F.col("_s").isNotNull(), F.col("_t"))
    slices = both.groupBy(*keys, "_b").agg(F.min_by("_s", edge).alias("_first"), F.max_by("_s", edge).alias("_last"))
    chain = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY _b)"
    carry = dealt(slices, keys, samples).select(
        *keys, "_b",
        F.expr(f"lag(_last) IGNORE NULLS {chain}").alias("_before"),
        F.expr(f"lead(_first) IGNORE NULLS {chain}").alias("_after"),
    )
    near = local.join(shuffled(dealt(carry, [*keys, "_b"], samples)), [*keys, "_b"])
    near = near.select(*keys, "_t", "_target", F.coalesce("_prev", "_before").alias("_prev"), F.coalesce("_next", "_after").alias("_next"))
    return _nearer(near, keys, target_time, sample_time, rest, cols)


GROUP_ROWS = 1_000_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], quantiles: dict[str, tuple[str, float]], limit: int = GROUP_ROWS) -> DataFrame:
    """Exact quantiles ``{name: (column, q)}`` per group, by the built-in aggregate while groups are small.

    The built-in keeps every distinct value of a group in one buffer, so the largest group is counted
    first; above ``limit`` rows ``binned_quantiles`` finds the same numbers without such a buffer.
    """
    keys = list(keys)
    df = df.select(*keys, *dict.fromkeys(c for c, _ in quantiles.values()))
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(keys), limit)
    if key not in _size_checks:
        _size_checks[key] = (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= limit
    if _size_checks[key]:
        return df.groupBy(*keys).agg(*[F.percentile(c, q).alias(n) for n, (c, q) in quantiles.items()])
    out = None
    for name, (column, q) in quantiles.items():
        one = binned_quantiles(df, keys, column, {name: q})
        out = one if out is None else (out.join(one, keys, "full") if keys else out.crossJoin(F.broadcast(one)))
    return out


def binned_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], bins: int = 4096) -> DataFrame:
    """Exact linearly interpolated quantiles for groups of any size.

    The built-in ``percentile`` keeps every distinct value of a group in one buffer. Here equal values
    are counted first, each group is cut into ``bins`` value ranges whose counts locate the wanted
    ranks, and only the few ranges that hold one are ordered.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    # read three times below; written once, neither the work nor the plan behind the values is repeated
    rows = checkpointed(rows)
    spans = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))
    span = F.col("_hi") - F.col("_lo")
    bin_of = F.when(span > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / span * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    binned = (rows.join(spans, keys) if keys else rows.crossJoin(F.broadcast(spans))).withColumn("_bin", bin_of)
    counts = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_c"), F.first("_n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    wanted = []
    for name, q in quantiles.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            wanted.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank.cast("bigint").alias("rank"),
                                   (at - F.floor(at)).alias("w")))
    ranks = counts.withColumn("_w", F.explode(F.array(*wanted))).filter(
        (F.col("_w.rank") >= F.col("_before")) & (F.col("_w.rank") < F.col("_before") + F.col("_c"))
    )
    needed = ranks.groupBy(*keys, "_bin").agg(F.first("_before").alias("_before"), F.collect_list("_w").alias("_ws"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v")
    cells = binned.select(*keys, "_bin", "_v", "_c").join(needed, [*keys, "_bin"])
    last = F.col("_before") + F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("_last", last).withColumn("_w", F.explode("_ws")).filter(
        (F.col("_w.rank") < F.col("_last")) & (F.col("_w.rank") >= F.col("_last") - F.col("_c"))
    )
    out = []
    for name in quantiles:
        def pick(side: str, field: str = "_v", name=name) -> Column:
            return F.max(F.when((F.col("_w.name") == name) & (F.col("_w.side") == side), F.col(field)))

        lo, hi, w = pick("lo"), pick("hi"), pick("lo", "_w.w")
        out.append((lo * (1.0 - w) + hi * w).alias(name))
    return cells.groupBy(*keys).agg(*out)
