"""Closed-set selection: inventories, labels, set matching and its summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundmetrics.functions import text as tx
from groundmetrics.operators import aggregate as ag
from groundmetrics.operators import sets as st
from groundmetrics.operators.scale import bucket_rank
from groundmetrics.plans.views import registry, view

query, QUERIES, ORACLES = registry()


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


WS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)"
KEY_SQL = r"regexp_replace(lower(trim({}, " + WS + r")), '[\s_\-]+', '', 'g')"


def key_sql(c: str) -> str:
    return KEY_SQL.format(c)


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    raw = view(spark, sf, "v_aliases").join(
        view(spark, sf, "v_anchors").drop("anchor_seq"), ["scene", "anchor_id"]
    )
    return st.normalize_inventory(raw.withColumnsRenamed({"anchor_id": "object_name", "x": "x_world", "y": "y_world", "z": "z_world"}))


def alias_table(spark: SparkSession, sf: str) -> DataFrame:
    inv = view(spark, sf, "v_aliases").withColumn("aliases", tx.split_names("aliases"))
    return st.alias_map(inv)


def set_flags(spark: SparkSession, sf: str) -> DataFrame:
    aliases = alias_table(spark, sf)
    gt = st.canonicalize(view(spark, sf, "v_gt"), aliases)
    pred = st.canonicalize(view(spark, sf, "v_mentions"), aliases)
    return st.label_flags(gt, pred, "canonical")


def set_detail(spark: SparkSession, sf: str) -> DataFrame:
    return st.score_sets(view(spark, sf, "v_keys"), set_flags(spark, sf))


ALIAS_SQL = f"""alias_entries AS (
    SELECT scene, anchor_seq, anchor_id, 0 AS pos, anchor_id AS alias FROM @v_aliases
    UNION ALL
    SELECT scene, anchor_seq, anchor_id, unnest(generate_series(1, len(parts))) AS pos, unnest(parts) AS alias
    FROM (SELECT *, list_filter(list_transform(string_split_regex(aliases, '[,;/|]+'), p -> trim(p, {WS})), p -> p <> '') AS parts
          FROM @v_aliases)),
alias_map AS (
    SELECT scene, {key_sql('alias')} AS key, arg_max(anchor_id, anchor_seq * 100 + pos) AS canonical
    FROM alias_entries GROUP BY 1, 2)"""


def canon_sql(source: str) -> str:
    return f"""SELECT s.*, coalesce(a.canonical, b.canonical) AS canonical
        FROM (SELECT *, {key_sql('label')} AS k FROM {source}) s
        LEFT JOIN alias_map a ON s.scene = a.scene AND s.k = a.key
        LEFT JOIN alias_map b ON s.scene = b.scene AND b.key =
            CASE WHEN regexp_matches(s.k, '^fork\\d+$') THEN 'forklift' || substr(s.k, 5)
                 WHEN regexp_matches(s.k, '^direct\\d+$') THEN 'truck' || substr(s.k, 7) END"""


DETAIL_SQL = f"""{ALIAS_SQL},
flags AS (
    SELECT scene, row_index, canonical, max(g) AS in_gt, max(p) AS in_pred FROM (
        SELECT scene, row_index, canonical, 1 AS g, 0 AS p FROM ({canon_sql('@v_gt')})
        UNION ALL
        SELECT scene, row_index, canonical, 0, 1 FROM ({canon_sql('@v_mentions')}))
    WHERE canonical IS NOT NULL GROUP BY 1, 2, 3),
counts AS (
    SELECT scene, row_index, sum(in_gt * in_pred)::BIGINT AS tp, sum(in_pred - in_gt * in_pred)::BIGINT AS fp,
           sum(in_gt - in_gt * in_pred)::BIGINT AS fn FROM flags GROUP BY 1, 2),
base AS (
    SELECT k.*, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn
    FROM @v_keys k LEFT JOIN counts USING (scene, row_index)),
detail AS (
    SELECT *, tp + fn AS gt_count, tp + fn > 0 AS evaluable, tp > 0 AS hit, tp + fn > 0 AND fp = 0 AND fn = 0 AS exact,
           CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS set_precision,
           CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS set_recall,
           CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END AS set_f1,
           o_orderstatus <> 'F' AS valid_output
    FROM base)"""


@query(f"""SELECT v.scene, v.anchor_id, x, y, z, len(list_filter(list_transform(
        string_split_regex(aliases, '[,;/|]+'), p -> trim(p)), p -> p <> '')) AS n_aliases
    FROM @v_aliases v JOIN @v_anchors a ON v.scene = a.scene AND v.anchor_seq = a.anchor_seq""")
def anchor_scan(spark, sf):
    inv = inventory(spark, sf)
    return inv.select("scene", "anchor_id", "x", "y", "z", F.size("aliases").cast("bigint").alias("n_aliases"))


@query(f"""SELECT {key_sql('label')} AS match_key, regexp_replace(lower(trim(label)), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS alnum_key,
        count(*) AS n FROM @v_mentions GROUP BY 1, 2""")
def label_key(spark, sf):
    m = view(spark, sf, "v_mentions")
    return m.groupBy(tx.label_key("label").alias("match_key"), tx.label_key("label", "alnum").alias("alnum_key")).agg(
        F.count("*").alias("n")
    )


@query(f"""WITH names AS (
        SELECT doc_id, unnest(generate_series(1, len(parts))) AS p, unnest(parts) AS name
        FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[,;/|]+'), x -> trim(x, {WS})), x -> x <> '') AS parts
              FROM @documents))
    SELECT doc_id, {key_sql('name')} AS label_key, CAST(min(p) - 1 AS INTEGER) AS pos, arg_min(name, p) AS name
    FROM names GROUP BY 1, 2""")
def unique_by_key(spark, sf):
    return st.first_mentions(view(spark, sf, "SELECT doc_id, text FROM @documents"), "doc_id", "text")


@query(f"""WITH {ALIAS_SQL}
    SELECT scene, label, canonical, count(*) AS n FROM ({canon_sql('@v_mentions')}) GROUP BY 1, 2, 3""")
def canonicalize(spark, sf):
    out = st.canonicalize(view(spark, sf, "v_mentions"), alias_table(spark, sf))
    return out.groupBy("scene", "label", "canonical").agg(F.count("*").alias("n"))


@query("""SELECT k.scene, k.row_index, count(p.pred_seq) AS n_points, count(p.pred_seq) = 0 AS missing_prediction
    FROM @v_keys k LEFT JOIN @v_preds p ON k.scene = p.scene AND k.row_index = p.row_index GROUP BY 1, 2""")
def left_join_missing(spark, sf):
    n = view(spark, sf, "v_preds").groupBy(*st.KEY).agg(F.count("*").alias("n_points"))
    joined = view(spark, sf, "v_keys").select(*st.KEY).join(n, st.KEY, "left").fillna(0, ["n_points"])
    return joined.withColumn("missing_prediction", F.col("n_points") == 0)


@query("""SELECT scene, row_index, arg_max(label, gt_seq) AS label, max(gt_seq) AS file_seq FROM @v_gt GROUP BY 1, 2""")
def last_wins(spark, sf):
    rows = view(spark, sf, "v_gt").withColumnRenamed("gt_seq", "file_seq")
    return st.last_wins(rows, st.KEY)


@query("""WITH w AS (SELECT max(row_index) AS hi FROM @v_keys)
    SELECT g.scene, count(*) AS n, min(row_index) AS first_row, max(row_index) AS last_row
    FROM @v_gt g, w WHERE g.scene IN ('scene0', 'scene2') AND row_index >= 100 AND row_index < 100 + hi GROUP BY 1""")
def select_rows(spark, sf):
    hi = view(spark, sf, "SELECT max(row_index) AS hi FROM @v_keys").first()["hi"]
    rows = st.select_rows(view(spark, sf, "v_gt"), ["scene0", "scene2"], 100, hi)
    return rows.groupBy("scene").agg(
        F.count("*").alias("n"), F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row")
    )


@query("""SELECT scene, row_index, o_orderpriority FROM (
        SELECT *, row_number() OVER (PARTITION BY scene ORDER BY row_index) AS rank FROM @v_keys)
    WHERE rank > 25 AND rank <= 125""")
def positional_slice(spark, sf):
    ranked = bucket_rank(view(spark, sf, "v_keys"), ["scene"], "row_index", "rank", 10_000)
    return st.positional_slice(ranked, 25, 100).select(*st.KEY, "o_orderpriority")


@query(f"""WITH {DETAIL_SQL}
    SELECT scene, row_index, tp, fp, fn, evaluable, hit, exact, round(set_precision, 6) AS set_precision,
           round(set_recall, 6) AS set_recall, round(set_f1, 6) AS set_f1 FROM detail""")
def set_match(spark, sf):
    d = set_detail(spark, sf).drop("gt_count", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return rounded(d, "set_precision", "set_recall", "set_f1")


@query(f"""WITH {DETAIL_SQL}
    SELECT scene, row_index,
        coalesce(string_agg(canonical, ',' ORDER BY canonical) FILTER (in_gt = 1 AND in_pred = 1), '') AS tp_labels,
        coalesce(string_agg(canonical, ',' ORDER BY canonical) FILTER (in_gt = 0), '') AS fp_labels,
        coalesce(string_agg(canonical, ',' ORDER BY canonical) FILTER (in_pred = 0), '') AS fn_labels
    FROM flags GROUP BY 1, 2""")
def set_overlap(spark, sf):
    out = st.set_overlap(set_flags(spark, sf), "canonical")
    return out.select(*st.KEY, *[F.concat_ws(",", c).alias(c) for c in ("tp_labels", "fp_labels", "fn_labels")])


MICRO = """sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
    round(sum(tp) / (sum(tp) + sum(fp)), 6) AS micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS micro_recall,
    round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1"""


@query(f"WITH {DETAIL_SQL} SELECT scene, {MICRO} FROM detail GROUP BY 1")
def micro_prf(spark, sf):
    out = ag.micro_prf(set_detail(spark, sf), ["scene"])
    return rounded(out, "micro_precision", "micro_recall", "micro_f1")


@query(f"""WITH {DETAIL_SQL}
    SELECT scene, round(avg(set_precision) FILTER (evaluable), 6) AS macro_precision,
        round(avg(set_recall) FILTER (evaluable), 6) AS macro_recall,
        round(avg(set_f1) FILTER (evaluable), 6) AS macro_f1_defined,
        round(avg(coalesce(set_f1, 0)) FILTER (evaluable), 6) AS macro_f1_zero FROM detail GROUP BY 1""")
def macro_prf(spark, sf):
    out = set_detail(spark, sf).groupBy("scene").agg(*ag.macro_columns())
    return rounded(out, "macro_precision", "macro_recall", "macro_f1_defined", "macro_f1_zero")


RATES_SQL = """count(*) AS num_total, count(*) FILTER (evaluable) AS num_evaluable,
    count(*) FILTER (valid_output) AS valid_output_count, count(*) FILTER (hit) AS hit_count,
    count(*) FILTER (evaluable AND hit) AS hit_mapped_count, count(*) FILTER (evaluable AND exact) AS exact_count,
    sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
    round(count(*) FILTER (evaluable) / count(*), 6) AS coverage,
    round(count(*) FILTER (valid_output) / count(*), 6) AS valid_output_rate,
    round(count(*) FILTER (hit) / count(*), 6) AS hit_all,
    CASE WHEN count(*) FILTER (evaluable) > 0 THEN round(count(*) FILTER (evaluable AND hit) / count(*) FILTER (evaluable), 6) ELSE 0 END AS hit_mapped,
    CASE WHEN count(*) FILTER (evaluable) > 0 THEN round(count(*) FILTER (evaluable AND exact) / count(*) FILTER (evaluable), 6) ELSE 0 END AS exact,
    coalesce(round(avg(coalesce(set_f1, 0)) FILTER (evaluable), 6), 0) AS set_f1_macro,
    CASE WHEN sum(tp) + sum(fp) > 0 THEN round(sum(tp) / (sum(tp) + sum(fp)), 6) ELSE 0 END AS micro_precision,
    CASE WHEN sum(tp) + sum(fn) > 0 THEN round(sum(tp) / (sum(tp) + sum(fn)), 6) ELSE 0 END AS micro_recall,
    CASE WHEN sum(tp) > 0 THEN round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) ELSE 0 END AS micro_f1"""
RATES = ("coverage", "valid_output_rate", "hit_all", "hit_mapped", "exact", "set_f1_macro",
         "micro_precision", "micro_recall", "micro_f1")


def run_detail(spark, sf) -> DataFrame:
    """Set detail with the run attributes: variant, validity of the output, target bucket."""
    d = set_detail(spark, sf).withColumn("valid_output", F.col("o_orderstatus") != "F")
    return d.withColumnRenamed("o_orderpriority", "variant").withColumn(
        "bucket", ag.target_bucket("gt_count", "zero_mapped_target")
    )


RUN_SQL = f"""{DETAIL_SQL},
runs AS (SELECT *, o_orderpriority AS variant,
    CASE WHEN gt_count = 1 THEN 'single_target' WHEN gt_count > 1 THEN 'multi_target' ELSE 'zero_mapped_target' END AS bucket
    FROM detail)"""


@query(f"WITH {RUN_SQL} SELECT variant, {RATES_SQL} FROM runs GROUP BY 1")
def anchor_aggregate(spark, sf):
    out = ag.anchor_rates(run_detail(spark, sf).groupBy("variant").agg(*ag.anchor_columns()))
    return rounded(out, *RATES)


@query(f"""WITH {RUN_SQL} SELECT coalesce(scene, bucket, 'overall') AS partition, {RATES_SQL}
    FROM runs GROUP BY GROUPING SETS ((), (scene), (bucket))""")
def grouping_sets(spark, sf):
    out = ag.grouping_sets(run_detail(spark, sf), [[], ["scene"], ["bucket"]], ag.anchor_columns())
    return rounded(ag.anchor_rates(out), *RATES)


@query(f"""WITH {RUN_SQL} SELECT variant, coalesce(scene, 'ALL') AS scene, {RATES_SQL}
    FROM runs GROUP BY GROUPING SETS ((variant, scene), (variant))""")
def summary_rollup(spark, sf):
    return rounded(ag.summary_rollup(run_detail(spark, sf), "variant", "scene"), *RATES)


@query(f"""WITH {RUN_SQL}, s AS (SELECT variant, bucket, {RATES_SQL} FROM runs GROUP BY 1, 2)
    SELECT s.variant, s.bucket, s.hit_all, s.exact, s.set_f1_macro,
        round(s.hit_all - coalesce(b.hit_all, 0), 5) AS delta_hit_all, round(s.exact - coalesce(b.exact, 0), 5) AS delta_exact,
        round(s.set_f1_macro - coalesce(b.set_f1_macro, 0), 5) AS delta_set_f1_macro
    FROM s LEFT JOIN s b ON b.variant = '1-URGENT' AND s.bucket = b.bucket""")
def delta_vs_baseline(spark, sf):
    s = ag.anchor_rates(run_detail(spark, sf).groupBy("variant", "bucket").agg(*ag.anchor_columns()))
    out = ag.delta_vs_baseline(rounded(s, *RATES), "variant", "1-URGENT", ["bucket"], ["hit_all", "exact", "set_f1_macro"])
    return rounded(out, "delta_hit_all", "delta_exact", "delta_set_f1_macro", digits=5)


@query(f"""WITH {DETAIL_SQL}
    SELECT 'predicted' AS counter, canonical AS label, count(*) AS n FROM flags WHERE in_pred = 1 GROUP BY 2
    UNION ALL SELECT 'matched', canonical, count(*) FROM flags WHERE in_pred = 1 AND in_gt = 1 GROUP BY 2
    UNION ALL SELECT 'unsupported', trim(label), count(*) FROM ({canon_sql('@v_gt')}) WHERE canonical IS NULL GROUP BY 2""")
def label_counts(spark, sf):
    flags = set_flags(spark, sf).filter("in_pred = 1")
    kinds = F.when(F.col("in_gt") == 1, F.array(F.lit("predicted"), F.lit("matched"))).otherwise(F.array(F.lit("predicted")))
    seen = flags.select(F.explode(kinds).alias("counter"), F.col("canonical").alias("label"))
    lost = st.canonicalize(view(spark, sf, "v_gt"), alias_table(spark, sf)).filter("canonical IS NULL")
    lost = lost.select(F.lit("unsupported").alias("counter"), tx.norm_text("label").alias("label"))
    return ag.value_counts(seen.unionByName(lost), ["counter", "label"])


@query(f"""WITH {ALIAS_SQL}
    SELECT scene, row_index, count(*) AS n_mentions FROM (
        SELECT scene, row_index, label, canonical FROM ({canon_sql('@v_mentions')})
        UNION ALL SELECT scene, row_index, label, canonical FROM ({canon_sql('@v_gt')}))
    WHERE label = 'NATION_3' OR canonical = 'NATION_3' GROUP BY 1, 2""")
def impacted_rows(spark, sf):
    aliases = alias_table(spark, sf)
    rows = st.canonicalize(view(spark, sf, "v_mentions"), aliases).drop("pred_seq").unionByName(
        st.canonicalize(view(spark, sf, "v_gt"), aliases).drop("gt_seq")
    )
    lists = rows.select(*st.KEY, F.array("label").alias("cleaned"), F.array("canonical").alias("mapped"))
    hit = st.impacted_rows(lists, "NATION_3", ["cleaned", "mapped"])
    return hit.groupBy(*st.KEY).agg(F.count("*").alias("n_mentions"))


@query("""SELECT scene, row_index, count(*) AS gt_count, string_agg(anchor_id, ',' ORDER BY gt_seq) AS gt_ids,
        round(sum(x + y + z), 6) AS coord_sum FROM @v_gt_points GROUP BY 1, 2""")
def build_gt(spark, sf):
    gt = st.build_gt(view(spark, sf, "v_gt"), view(spark, sf, "v_anchors").drop("anchor_seq"))
    total = F.aggregate("gt", F.lit(0.0), lambda s, g: s + g["point"]["x"] + g["point"]["y"] + g["point"]["z"])
    return gt.select(*st.KEY, F.size("gt").cast("bigint").alias("gt_count"), F.concat_ws(",", "gt.id").alias("gt_ids"),
                     F.round(total, 6).alias("coord_sum"))


@query(f"""WITH {ALIAS_SQL}
    SELECT scene, {key_sql('alias')} AS key, count(DISTINCT anchor_id) AS n_anchors, min(anchor_id) AS first_anchor,
        max(anchor_id) AS last_anchor FROM alias_entries GROUP BY 1, 2 HAVING count(DISTINCT anchor_id) > 1""")
def alias_collisions(spark, sf):
    from groundmetrics.operators.audit import alias_collisions as collide

    inv = view(spark, sf, "v_aliases").withColumn("aliases", tx.split_names("aliases"))
    return collide(st.alias_entries(inv))


@query(f"""WITH {ALIAS_SQL}, got AS ({canon_sql('@v_gt')}), t AS (
        SELECT scene, label, max(canonical) AS actual, count(*) AS n FROM got GROUP BY 1, 2)
    SELECT t.scene, label, actual, a.anchor_id AS expected, n, actual IS NOT DISTINCT FROM a.anchor_id AS agrees
    FROM t LEFT JOIN @v_anchors a ON t.scene = a.scene AND t.label = a.anchor_id""")
def mapping_audit(spark, sf):
    from groundmetrics.operators.audit import mapping_audit as audit

    got = st.canonicalize(view(spark, sf, "v_gt"), alias_table(spark, sf))
    actual = got.groupBy("scene", "label").agg(F.max("canonical").alias("actual"), F.count("*").alias("n"))
    expected = view(spark, sf, "v_anchors").select("scene", F.col("anchor_id").alias("label"), F.col("anchor_id").alias("expected"))
    return audit(actual, expected, ["scene", "label"])


TAX_SQL = """taxonomy AS (SELECT scene, anchor_id AS canonical,
    CASE WHEN anchor_seq < 13 THEN 'location_region' ELSE 'object' END AS category FROM @v_anchors)"""


@query(f"""WITH {DETAIL_SQL}, {TAX_SQL},
    touched AS (SELECT f.scene, f.row_index, count(*) FILTER (category = 'location_region') AS n_region
        FROM flags f JOIN taxonomy t ON f.scene = t.scene AND f.canonical = t.canonical WHERE in_gt = 1 GROUP BY 1, 2),
    anchors AS (SELECT scene, count(*) FILTER (category = 'location_region') AS taxonomy_anchors FROM taxonomy GROUP BY 1)
    SELECT scene, taxonomy_anchors, count(*) AS interactions, count(*) FILTER (n_region > 0) AS touched
    FROM @v_keys LEFT JOIN touched USING (scene, row_index) JOIN anchors USING (scene) GROUP BY 1, 2""")
def taxonomy_stats(spark, sf):
    from groundmetrics.operators.audit import taxonomy_stats as stats

    tax = view(spark, sf, "v_anchors").select(
        "scene", F.col("anchor_id").alias("canonical"),
        F.when(F.col("anchor_seq") < 13, "location_region").otherwise("object").alias("category"),
    )
    gt = set_flags(spark, sf).filter("in_gt = 1")
    return stats(view(spark, sf, "v_keys"), gt, tax, "location_region")


def entry_query(spark: SparkSession, sf: str) -> DataFrame:
    """Set-match quality per scene and overall, micro and macro, in one grouping-set pass."""
    out = ag.grouping_sets(run_detail(spark, sf), [[], ["scene"], ["bucket"]], ag.anchor_columns() + ag.macro_columns())
    return ag.anchor_rates(out)

