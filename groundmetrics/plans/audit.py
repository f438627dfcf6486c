"""Merges, completion, audits, fingerprints, record rendering and run comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundmetrics.functions import geometry as geo
from groundmetrics.functions import text as tx
from groundmetrics.operators import aggregate as ag
from groundmetrics.operators import audit as au
from groundmetrics.operators import batch as bt
from groundmetrics.operators import nearest as nn
from groundmetrics.operators import sets as st
from groundmetrics.plans import closed_set as cs
from groundmetrics.plans import timeline as tq
from groundmetrics.plans.closed_set import rounded
from groundmetrics.plans.views import registry, view

query, QUERIES, ORACLES = registry()
KEY = st.KEY

# Overlapping shards of one prediction run: each order status is held by one or two of them.
SHARDS = {
    "a": "SELECT scene, row_index, 'a' AS shard, o_totalprice, o_orderstatus <> 'F' AS parse_ok FROM @v_keys WHERE o_orderstatus IN ('F', 'O')",
    "b": "SELECT scene, row_index, 'b' AS shard, o_totalprice + 1 AS o_totalprice, o_totalprice > 100000 AS parse_ok FROM @v_keys WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority <> '5-LOW'",
}


@query(f"""WITH u AS (SELECT *, 0 AS o FROM ({SHARDS['a']}) UNION ALL SELECT *, 1 FROM ({SHARDS['b']}))
    SELECT scene, row_index, arg_min(shard, o) AS shard, arg_min(o_totalprice, o) AS o_totalprice, count(*) AS n_sources FROM u GROUP BY 1, 2""")
def merge_first_wins(spark, sf):
    out = st.merge_first_wins([view(spark, sf, SHARDS[s]) for s in "ab"])
    return out.select(*KEY, "shard", "o_totalprice", "n_sources")


@query(f"""SELECT scene, row_index, count(*) AS n FROM (SELECT scene, row_index FROM ({SHARDS['a']}) UNION ALL SELECT scene, row_index FROM ({SHARDS['b']}))
    GROUP BY 1, 2 HAVING count(*) > 1""")
def merge_strict(spark, sf):
    _rows, duplicates = st.merge_strict([view(spark, sf, SHARDS["a"]), view(spark, sf, SHARDS["b"]).drop("o_totalprice")])
    return duplicates


@query(f"""WITH s AS (SELECT scene, row_index, bool_or(parse_ok) AS ok FROM (SELECT * FROM ({SHARDS['a']}) UNION ALL SELECT * FROM ({SHARDS['b']})) GROUP BY 1, 2)
    SELECT k.scene, k.row_index, CASE WHEN ok IS NULL THEN 'missing_prediction' ELSE 'parse_failed' END AS reason
    FROM @v_keys k LEFT JOIN s USING (scene, row_index) WHERE ok IS NULL OR NOT ok""")
def completion_targets(spark, sf):
    preds = view(spark, sf, SHARDS["a"]).unionByName(view(spark, sf, SHARDS["b"]))
    return st.completion_targets(view(spark, sf, "v_keys").select(*KEY), preds)


@query(f"""WITH o AS (SELECT scene, row_index, shard, 0 AS attempt FROM ({SHARDS['a']})),
    t AS (SELECT scene, row_index FROM @v_keys WHERE o_totalprice > 200000),
    u AS (SELECT * FROM o UNION ALL SELECT b.scene, b.row_index, b.shard, 1 FROM ({SHARDS['b']}) b SEMI JOIN t ON b.scene = t.scene AND b.row_index = t.row_index)
    SELECT scene, row_index, arg_max(shard, attempt) AS shard, max(attempt) AS attempt FROM u GROUP BY 1, 2""")
def apply_supplements(spark, sf):
    attempts = view(spark, sf, SHARDS["b"]).select(*KEY, "shard", F.lit(1).alias("attempt"))
    out = st.apply_supplements(view(spark, sf, SHARDS["a"]).select(*KEY, "shard"), attempts, view(spark, sf, "v_keys").filter("o_totalprice > 200000"))
    return out.select(*KEY, "shard", "attempt")


@query("""WITH e AS (SELECT scene, max(row_index) // 4 + 1 AS n FROM @v_keys GROUP BY 1),
    g AS (SELECT scene, unnest(generate_series(0, n - 1)) AS i FROM e)
    SELECT scene, count(*) AS n, max(i) AS last_index FROM g GROUP BY 1""")
def expected_grid(spark, sf):
    n = view(spark, sf, "v_keys").groupBy("scene").agg((F.floor(F.max("row_index") / 4) + 1).alias("n"))
    return st.expected_grid(n).groupBy("scene").agg(F.count("*").alias("n"), F.max("row_index").alias("last_index"))


@query("""SELECT scene, row_index, CASE WHEN g AND p THEN 'common' WHEN g THEN 'missing' ELSE 'extra' END AS side FROM (
    SELECT scene, row_index, bool_or(s = 'g') AS g, bool_or(s = 'p') AS p FROM (
        SELECT scene, row_index, 'g' AS s FROM @v_gt UNION ALL SELECT scene, row_index, 'p' FROM @v_preds) GROUP BY 1, 2)""")
def key_diff(spark, sf):
    return au.key_diff(view(spark, sf, "v_gt"), view(spark, sf, "v_preds"))


@query("""SELECT scene, label, CASE WHEN a THEN 'added' ELSE 'removed' END AS change FROM (
    SELECT scene, row_index, label, bool_or(s = 'b') AS b, bool_or(s = 'a') AS a FROM (
        SELECT scene, row_index, label, 'b' AS s FROM @v_gt UNION ALL SELECT scene, row_index, trim(label), 'a' FROM @v_mentions) GROUP BY 1, 2, 3)
    WHERE a <> b""")
def symmetric_diff(spark, sf):
    before = view(spark, sf, "v_gt")
    after = view(spark, sf, "v_mentions").withColumn("label", tx.norm_text("label"))
    return st.symmetric_diff(before, after, [*KEY, "label"]).drop("row_index")


REPAIRS = """SELECT concat('scene', CAST(l_orderkey % 4 AS STRING)) AS scene, l_orderkey AS row_index,
    CASE WHEN l_linestatus = 'O' THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS column, l_returnflag AS new_value FROM @lineitem WHERE l_quantity > 40"""


@query(f"""WITH r AS (SELECT scene, row_index, "column", max(new_value) AS new_value FROM ({REPAIRS.replace('AS column', 'AS "column"')}) GROUP BY 1, 2, 3),
    l AS (SELECT k.scene, k.row_index, r."column", CASE r."column" WHEN 'o_orderstatus' THEN o_orderstatus ELSE o_orderpriority END AS old_value, new_value
        FROM @v_keys k JOIN r ON k.scene = r.scene AND k.row_index = r.row_index)
    SELECT * FROM l WHERE old_value IS DISTINCT FROM new_value""")
def apply_repairs(spark, sf):
    _fixed, log = st.apply_repairs(view(spark, sf, "v_keys"), view(spark, sf, REPAIRS), KEY, ["o_orderstatus", "o_orderpriority"])
    return log


BASE_FIELDS = "SELECT c_custkey AS event_id, c_mktsegment AS instruction_text, '' AS utterance_text FROM @customer"
OVER_FIELDS = """SELECT s_suppkey * 2 AS event_id, CASE WHEN s_nationkey % 2 = 0 THEN s_name ELSE '  ' END AS instruction_text, s_name AS utterance_text FROM @supplier"""


@query(f"""SELECT coalesce(b.event_id, o.event_id) AS event_id, coalesce(nullif(trim(o.instruction_text), ''), b.instruction_text, '') AS instruction_text,
        coalesce(nullif(trim(o.utterance_text), ''), b.utterance_text, '') AS utterance_text FROM ({BASE_FIELDS}) b FULL JOIN ({OVER_FIELDS}) o ON b.event_id = o.event_id""")
def merge_fields(spark, sf):
    return st.merge_fields(view(spark, sf, BASE_FIELDS), view(spark, sf, OVER_FIELDS), ["event_id"], ["instruction_text", "utterance_text"])


SAMPLES = "SELECT concat('scene', CAST(c_custkey % 4 AS STRING)) AS scene, c_custkey, concat('sample_', CAST(c_custkey AS STRING)) AS sample_id FROM @customer"


@query(f"""WITH a AS (SELECT scene, row_index, row_number() OVER (PARTITION BY scene ORDER BY row_index) AS position FROM @v_keys),
    b AS (SELECT scene, sample_id, row_number() OVER (PARTITION BY scene ORDER BY c_custkey) AS position FROM ({SAMPLES}))
    SELECT scene, position, row_index, sample_id FROM a JOIN b USING (scene, position)""")
def positional_join(spark, sf):
    out = bt.positional_join(view(spark, sf, "v_keys").select(*KEY), view(spark, sf, SAMPLES), "row_index", "c_custkey", 10_000)
    return out.select("scene", "position", "row_index", "sample_id")


RULES = """SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 'broken' ELSE concat(CAST(c_custkey * 8 AS STRING), '-', CAST(c_custkey * 8 + c_nationkey % 5 AS STRING), ':',
    CAST(c_nationkey % 4 AS STRING), ':', CAST(c_custkey AS STRING)) END AS rule FROM @customer"""
INSTR = "SELECT CAST(p_size % 4 AS BIGINT) AS instruction_scene, p_partkey AS instruction_order, p_name AS instruction_text, CASE WHEN p_size > 25 THEN p_brand END AS target_description FROM @part"


@query(f"""WITH r AS (SELECT c_custkey, c_custkey * 8 AS s, c_nationkey % 5 AS len, CAST(c_nationkey % 4 AS BIGINT) AS sc, c_nationkey FROM @customer),
    x AS (SELECT *, unnest(generate_series(0, len)) AS o FROM r WHERE c_nationkey <> 7),
    y AS (SELECT c_custkey, s + o AS manifest_id, sc AS instruction_scene, c_custkey + o AS instruction_order FROM x
        UNION ALL SELECT c_custkey, NULL, NULL, NULL FROM r WHERE c_nationkey = 7)
    SELECT c_custkey, manifest_id, instruction_order, coalesce(target_description, instruction_text) AS target_description,
        CASE WHEN manifest_id IS NULL THEN 'invalid_rule' WHEN o_orderkey IS NULL THEN 'missing_manifest' WHEN instruction_text IS NULL THEN 'missing_instruction' ELSE 'ok' END AS status
    FROM y LEFT JOIN @orders ON o_orderkey = manifest_id LEFT JOIN ({INSTR}) i USING (instruction_scene, instruction_order)""")
def range_assign(spark, sf):
    manifest = view(spark, sf, "SELECT o_orderkey AS manifest_id, CAST(o_orderkey AS STRING) AS event_id FROM @orders")
    out = bt.range_assign(view(spark, sf, RULES), manifest, view(spark, sf, INSTR))
    return out.select("c_custkey", "manifest_id", "instruction_order", "target_description", "status")


VIDEOS = "SELECT c_custkey AS event_id, CASE WHEN c_nationkey = 3 THEN '' ELSE concat('v', CAST(c_custkey % 997 AS STRING)) END AS video_path FROM @customer"
OFFSETS = """SELECT concat('v', CAST(o_custkey AS STRING)) AS video_path, o_orderkey AS manifest_seq,
    CASE o_orderstatus WHEN 'F' THEN '' WHEN 'P' THEN 'NaN' ELSE CAST(o_totalprice AS STRING) END AS offset FROM @orders"""


@query(f"""WITH o AS (SELECT 'v' || o_custkey AS video_path, arg_min(o_totalprice, o_orderkey) AS o FROM @orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT event_id, coalesce(o, 0) AS offset_seconds, CASE WHEN video_path = '' THEN 'none:no_video' WHEN o IS NULL THEN 'default_zero:no_manifest_match' ELSE 'manifest' END AS offset_source
    FROM ({VIDEOS}) LEFT JOIN o USING (video_path)""")
def offset_lookup(spark, sf):
    return bt.offset_lookup(view(spark, sf, VIDEOS), view(spark, sf, OFFSETS)).select("event_id", "offset_seconds", "offset_source")


@query("""WITH t AS (SELECT scene, row_index, row_number() OVER (ORDER BY row_index, scene) - 1 AS i, count(*) OVER () AS n FROM @v_keys WHERE o_orderstatus <> 'F')
    SELECT scene, row_index, i // CAST(ceil(n / 7) AS BIGINT) AS chunk, i % 7 AS turn FROM t""")
def assign_shards(spark, sf):
    keys, done = view(spark, sf, "v_keys"), view(spark, sf, "v_keys").filter("o_orderstatus = 'F'")
    a = bt.assign_shards(keys, done, 7, width=10_000).withColumnRenamed("shard", "chunk")
    b = bt.assign_shards(keys, done, 7, round_robin=True, width=10_000).withColumnRenamed("shard", "turn")
    return a.join(b, KEY)


# Run facts: a baseline and two variants, one of them incomplete and one with changed ground truth and answers.
# Payloads differ in spelling, in form (bare list, object, no JSON) or in one field.
RUNS = """SELECT 'full' AS variant, scene, row_index, o_orderpriority AS gt, o_totalprice AS score, CASE WHEN row_index % 11 = 5 THEN NULL WHEN row_index % 7 = 3 THEN '[{"x": 1}]'
        ELSE concat('{"points_3d": [{"x": ', row_index, '.50, "label": "', o_orderpriority, '.0 "}, {"x": 2, "label": "é"}], "confidence": 0.5, "note": null}') END AS payload FROM @v_keys
    UNION ALL SELECT 'no_gaze', scene, row_index, o_orderpriority, o_totalprice / 2, CASE WHEN row_index % 11 = 5 THEN 'no answer' WHEN row_index % 7 = 3 THEN '{"points_3d":[{"x":1.0}]}'
        ELSE concat('{ "note":null, "confidence":5e-1, "points_3d":[{"label":"', o_orderpriority, '.0 ", "x":', row_index, '.5},{"label":"\\u00e9","x":2.0}] }') END FROM @v_keys WHERE o_orderstatus <> 'P'
    UNION ALL SELECT 'no_hand', scene, row_index, CASE WHEN o_totalprice > 400000 THEN 'other' ELSE o_orderpriority END, o_totalprice + 1,
        CASE WHEN o_orderstatus = 'F' THEN '{"points_3d": []}' WHEN row_index % 7 = 3 THEN '[{"x": 1}, null]'
            ELSE concat('{"points_3d": [{"x": ', row_index, '.50, "label": "', o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN '"' ELSE '.0 "' END,
                '}, {"x": 2, "label": "é"}], "confidence": ', CASE WHEN row_index % 5 = 0 THEN '0.25' ELSE '0.5' END, ', "note": null}') END FROM @v_keys"""


@query(f"""SELECT variant, count(*) AS rows, count(DISTINCT (scene, row_index)) AS unique_keys, count(*) - count(DISTINCT (scene, row_index)) AS duplicates,
        (SELECT count(*) FROM @v_keys) - count(DISTINCT (scene, row_index)) AS missing, 0::BIGINT AS extra FROM ({RUNS}) GROUP BY 1""")
def key_health(spark, sf):
    rows = view(spark, sf, RUNS)
    variants = rows.select("variant").distinct()
    expected = view(spark, sf, "v_keys").select(*KEY).crossJoin(F.broadcast(variants))  # one row per run
    return au.key_health(rows, expected, KEY, ["variant"])


@query(f"""WITH r AS ({RUNS}), b AS (SELECT * FROM r WHERE variant = 'full')
    SELECT r.variant, count(*) AS n_rows, count(*) = (SELECT count(*) FROM b) AND count(b.gt) = (SELECT count(*) FROM b) AS same_keys,
        bool_and(r.gt IS NOT DISTINCT FROM b.gt) AS same_gt FROM r LEFT JOIN b ON r.scene = b.scene AND r.row_index = b.row_index GROUP BY 1""")
def variant_consistency(spark, sf):
    return au.variant_consistency(view(spark, sf, RUNS), "variant", "full", KEY, "gt")


def hash_sql(start: int) -> str:
    return f"('0x' || substr(sha256(scene || '::' || row_index), {start}, 8))::BIGINT"


PRINT_SQL = f"""prints AS (SELECT variant, scene, count(*) AS n, sum({hash_sql(1)})::BIGINT AS hash_sum, bit_xor({hash_sql(9)}) AS hash_xor,
    bool_and(isfinite(score)) AS finite FROM ({RUNS}) GROUP BY 1, 2)"""


def prints(spark, sf):
    rows = view(spark, sf, RUNS)
    p = au.set_fingerprint(rows, ["variant", "scene"], F.concat_ws("::", "scene", F.col("row_index").cast("string")))
    ok = rows.groupBy("variant", "scene").agg(F.bool_and(tx.finite_double("score").isNotNull()).alias("finite"))
    return p.join(ok, ["variant", "scene"])


@query(f"WITH {PRINT_SQL} SELECT variant, scene, n, hash_sum, hash_xor FROM prints")
def set_fingerprint(spark, sf):
    return prints(spark, sf).drop("finite")


@query(f"""WITH {PRINT_SQL}, c AS (SELECT scene, count(*) AS n_models, count(DISTINCT (hash_sum, hash_xor)) = 1 AS same_keys, min(n) = max(n) AS same_rows,
        bool_and(finite) AS finite_metrics FROM prints GROUP BY 1)
    SELECT *, same_keys AND same_rows AND finite_metrics AS passed,
        '{{"same_keys":' || same_keys || ',"same_rows":' || same_rows || ',"finite_metrics":' || finite_metrics || '}}' AS checks_json FROM c""")
def cross_checks(spark, sf):
    return au.cross_checks(prints(spark, sf), ["scene"])


@query(f"""WITH r AS (SELECT variant, scene, row_index, CASE WHEN NOT coalesce(json_valid(payload), false) THEN '{{"points_3d":[]}}'
        WHEN payload LIKE '[%' THEN '{{"points_3d":' || payload || '}}' ELSE payload END AS payload FROM ({RUNS})),
    leaves AS (SELECT variant, scene, row_index, (SELECT list(fullkey || CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN ' ' || CAST(atom AS DOUBLE) ELSE type || coalesce(atom ->> '$', '') END
        ORDER BY fullkey) FROM json_tree(payload)) AS leaf FROM r),
    b AS (SELECT * FROM leaves WHERE variant = 'full')
    SELECT r.variant, count(*) AS n, count(*) FILTER (r.leaf = b.leaf) AS n_same FROM leaves r LEFT JOIN b ON r.scene = b.scene AND r.row_index = b.row_index GROUP BY 1""")
def same_as_baseline(spark, sf):
    return au.same_as_baseline(view(spark, sf, RUNS), "variant", "full", KEY, "payload")


@query(f"""WITH {cs.DETAIL_SQL}, lost AS (SELECT scene, row_index, count(*) AS n FROM ({cs.canon_sql('@v_gt')}) WHERE canonical IS NULL GROUP BY 1, 2)
    SELECT scene, row_index, unnest(list_filter(['unmapped_gt', 'missing_prediction', 'excluded_no_mapped_gt', 'invalid_output'], lambda r:
        CASE r WHEN 'unmapped_gt' THEN coalesce(n, 0) > 0 WHEN 'missing_prediction' THEN tp + fp = 0 WHEN 'excluded_no_mapped_gt' THEN NOT evaluable
            ELSE NOT valid_output END)) AS reason FROM detail LEFT JOIN lost USING (scene, row_index)""")
def denominator_audit(spark, sf):
    lost = st.canonicalize(view(spark, sf, "v_gt"), cs.alias_table(spark, sf)).filter("canonical IS NULL")
    d = cs.run_detail(spark, sf).join(lost.groupBy(*KEY).agg(F.count("*").alias("n_unmapped")), KEY, "left")
    return au.denominator_audit(d.fillna(0, ["n_unmapped"]).withColumn("n_pred", F.col("tp") + F.col("fp")))


@query(f"""WITH {cs.DETAIL_SQL} SELECT scene, true AS ok_micro_f1, true AS ok_micro_precision FROM detail GROUP BY 1""")
def metric_reproduction(spark, sf):
    d = cs.run_detail(spark, sf)
    stored = ag.anchor_rates(ag.grouping_sets(d, [[], ["scene"]], ag.anchor_columns())).withColumnRenamed("partition", "scene").filter("scene <> 'overall'")
    again = ag.micro_prf(d, ["scene"])
    return au.metric_reproduction(again, stored, ["scene"], ["micro_f1", "micro_precision"])


@query(f"""WITH {cs.DETAIL_SQL}, s AS (SELECT scene, row_index,
        coalesce(string_agg(canonical, ',' ORDER BY canonical) FILTER (in_gt = 1), '') AS gt_labels,
        coalesce(string_agg(canonical, ',' ORDER BY canonical) FILTER (in_pred = 1), '') AS pred_labels FROM flags GROUP BY 1, 2)
    SELECT scene, row_index, scene || '::' || row_index AS unified_id, coalesce(gt_labels, '') AS gt_labels, coalesce(pred_labels, '') AS pred_labels, tp, fp, fn
    FROM detail LEFT JOIN s USING (scene, row_index)""")
def export_evidence(spark, sf):
    flags = cs.set_flags(spark, sf)

    def side(flag: str, name: str):
        rows = flags.filter(F.col(flag) == 1).groupBy(*KEY).agg(F.array_sort(F.collect_set("canonical")).alias(name))
        return view(spark, sf, "v_keys").select(*KEY).join(rows, KEY, "left").withColumn(name, F.concat_ws(",", name))

    detail = cs.set_detail(spark, sf).select(*KEY, "tp", "fp", "fn")
    return au.export_evidence(side("in_gt", "gt_labels"), side("in_pred", "pred_labels"), detail)


@query(f"""WITH {cs.RUN_SQL}, b AS (SELECT scene, {cs.MICRO} FROM runs GROUP BY 1), a AS (SELECT scene, {cs.MICRO} FROM runs WHERE valid_output GROUP BY 1)
    SELECT b.scene, m AS metric, CASE m WHEN 'micro_f1' THEN b.micro_f1 ELSE b.micro_recall END AS before_value,
        CASE m WHEN 'micro_f1' THEN a.micro_f1 ELSE a.micro_recall END AS after_value,
        round(CASE m WHEN 'micro_f1' THEN a.micro_f1 - b.micro_f1 ELSE a.micro_recall - b.micro_recall END, 5) AS change
    FROM b JOIN a USING (scene), (SELECT unnest(['micro_f1', 'micro_recall']) AS m)""")
def before_after(spark, sf):
    d = cs.run_detail(spark, sf)
    before, after = (rounded(ag.micro_prf(x, ["scene"]), "micro_f1", "micro_recall") for x in (d, d.filter("valid_output")))
    return rounded(ag.before_after(before, after, ["scene"], ["micro_f1", "micro_recall"]), "change", digits=5)


ABLATED = {
    # variant: (hit, exact, set_f1) of the ablation run, in terms of the full run's columns
    "no_gaze": ("hit AND row_index % 3 <> 1", "exact AND row_index % 4 <> 1", "set_f1 * 0.9"),
    "no_hand": ("hit", "exact OR row_index % 97 = 5", "CASE WHEN row_index % 5 = 2 THEN set_recall ELSE set_f1 END"),
}
ABLATED_SQL = " UNION ALL ".join(f"SELECT '{v}' AS variant, scene, row_index, {h} AS hit, {e} AS exact, {f} AS set_f1 FROM {{0}} WHERE o_orderstatus <> '{o}'"
                                 for (v, (h, e, f)), o in zip(ABLATED.items(), ("P", "X"), strict=True))
MIX_SQL = "(xor({0}, {0} >> 16) * " + str(ag.HASH_MIX) + ") & 4294967295"


@query(f"""WITH {cs.DETAIL_SQL}, abl AS ({ABLATED_SQL.format("detail")}),
    pairs AS (SELECT a.variant, a.scene, a.row_index, unnest([
            struct_pack(metric := 'hit', f := coalesce(d.hit, false)::INT::DOUBLE, a := coalesce(a.hit, false)::INT::DOUBLE, m := 1.0::DOUBLE),
            struct_pack(metric := 'exact', f := coalesce(d.exact, false)::INT::DOUBLE, a := coalesce(a.exact, false)::INT::DOUBLE, m := coalesce(d.evaluable, false)::INT::DOUBLE),
            struct_pack(metric := 'set_f1', f := coalesce(d.set_f1, 0), a := coalesce(a.set_f1, 0), m := coalesce(d.evaluable, false)::INT::DOUBLE)]) AS x
        FROM abl a JOIN detail d USING (scene, row_index)),
    gs AS (SELECT variant, x.metric AS metric, ('0x' || left(md5(scene || '::' || row_index), 8))::BIGINT % {ag.BOOTSTRAP_GROUPS} AS g,
            sum(x.m * x.f) AS f, sum(x.m * x.a) AS a, sum(x.m) AS m, count(*) AS n FROM pairs GROUP BY 1, 2, 3),
    h0 AS (SELECT rep, g, (rep * {ag.HASH_REP} + g * {ag.HASH_GROUP} + 2027) & 4294967295 AS x FROM range({ag.BOOTSTRAP_REPS}) r(rep), range({ag.BOOTSTRAP_GROUPS}) q(g)),
    h1 AS (SELECT rep, g, {MIX_SQL.format("x")} AS x FROM h0), h2 AS (SELECT rep, g, {MIX_SQL.format("x")} AS x FROM h1),
    w AS (SELECT rep, g, {" + ".join(f"(xor(x, x >> 16) >= {t})::INT" for t in ag.poisson_steps())} AS w FROM h2),
    st AS (SELECT variant, metric, rep, (sum(w * a) - sum(w * f)) / CASE WHEN sum(w * m) = 0 THEN 1 ELSE sum(w * m) END AS diff FROM gs JOIN w USING (g) GROUP BY 1, 2, 3),
    ci AS (SELECT variant, metric, quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi FROM st GROUP BY 1, 2),
    pt AS (SELECT variant, metric, sum(n)::BIGINT AS n, sum(f) / greatest(sum(m), 1) AS f, sum(a) / greatest(sum(m), 1) AS a FROM gs GROUP BY 1, 2)
    SELECT variant, metric, n AS pairs, round(f, 6) AS full_value, round(a, 6) AS ablation_value, round(a - f, 6) AS delta,
        round(lo, 6) AS ci95_low, round(hi, 6) AS ci95_high, lo > 0 OR hi < 0 AS significant FROM pt JOIN ci USING (variant, metric)""")
def paired_bootstrap(spark, sf):
    full = cs.set_detail(spark, sf)
    ablations = [full.filter(F.col("o_orderstatus") != o).select(F.lit(v).alias("variant"), *KEY, F.expr(h).alias("hit"), F.expr(e).alias("exact"), F.expr(f).alias("set_f1"))
                 for (v, (h, e, f)), o in zip(ABLATED.items(), ("P", "X"), strict=True)]
    pairs = ag.pair_runs(full, ablations[0].unionByName(ablations[1]), KEY, {"hit": None, "exact": "evaluable", "set_f1": "evaluable"})
    out = ag.paired_bootstrap(pairs, ["variant"], KEY)
    return rounded(out, "full_value", "ablation_value", "delta", "ci95_low", "ci95_high")


WORDS = ", ".join(f"'{w}'" for w in tx.DEICTIC_WORDS)
EDGE = "' .,:;\"'''"


@query(f"""WITH a AS (SELECT doc_id, trim(regexp_replace(translate(trim(text, {cs.WS}), '_-', '  '), '\\s+', ' ', 'g'), {EDGE}) AS p, trim(text, {cs.WS}) AS raw FROM @documents),
    b AS (SELECT *, trim(regexp_replace(list_aggregate(list_transform(regexp_extract_all(p, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+|[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'),
            t -> CASE WHEN lower(t) IN ({WORDS}) THEN ' ' ELSE t END), 'string_agg', ''), '\\s+', ' ', 'g'), {EDGE}) AS s FROM a),
    c AS (SELECT doc_id, lower(coalesce(nullif(coalesce(nullif(s, ''), p), ''), nullif(raw, ''), 'object')) AS f FROM b)
    SELECT doc_id, md5(CASE WHEN f LIKE '%.' THEN f ELSE f || '.' END) AS phrase_md5 FROM c""")
def clean_phrase(spark, sf):
    docs = view(spark, sf, "SELECT doc_id, text FROM @documents")
    return docs.select("doc_id", F.md5(tx.clean_phrase("text", F.lit("")).cast("binary")).alias("phrase_md5"))


@query(f"""SELECT conv_id, turn, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(left(t, 57)) || '...' END AS short
    FROM (SELECT conv_id, turn, trim(regexp_replace(trim(text, {cs.WS}), '\\s+', ' ', 'g')) AS t FROM @conversations)""")
def compress_text(spark, sf):
    return view(spark, sf, "SELECT * FROM @conversations").select("conv_id", "turn", tx.compress_text("text", 60).alias("short"))


@query("""SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN '/secure/' || substr(url, 9) WHEN starts_with(url, 'http://') THEN '/plain/' || substr(url, 8) ELSE url END AS path,
        'p_' || page_id || '/' || regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS event_path FROM @pages""")
def rewrite_path(spark, sf):
    pages = view(spark, sf, "SELECT page_id, url FROM @pages")
    made = tx.render_template("p_{id}/{name}", {"id": "page_id", "name": tx.sanitize_token("url")})
    return pages.select("page_id", tx.rewrite_path("url", [("https://", "/secure/"), ("http://", "/plain/")]).alias("path"), made.alias("event_path"))


LISTING = """SELECT concat('sample_', CAST(o_custkey AS STRING)) AS directory, CASE o_orderstatus WHEN 'F' THEN concat('ScreenRecord_', CAST(o_orderkey AS STRING), '.mp4')
    WHEN 'P' THEN concat('clip', CAST(o_orderkey AS STRING), '.mov') ELSE concat('notes', CAST(o_orderkey AS STRING), '.txt') END AS file FROM @orders"""


@query(f"""WITH p AS (SELECT directory, file, CASE WHEN file LIKE 'ScreenRecord%' THEN 0 WHEN file LIKE '%.mov' THEN 1 END AS priority FROM ({LISTING})),
    b AS (SELECT directory, min(priority) AS priority FROM p GROUP BY 1),
    c AS (SELECT b.directory, b.priority, count(p.file) AS n, min(p.file) AS file FROM b LEFT JOIN p ON b.directory = p.directory AND b.priority = p.priority GROUP BY 1, 2)
    SELECT directory, CASE WHEN priority IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status, priority, CASE WHEN n = 1 THEN file END AS file FROM c""")
def resolve_assets(spark, sf):
    return st.resolve_assets(view(spark, sf, LISTING), [r"^ScreenRecord_.*\.mp4$", r"\.mov$"])


@query("""SELECT event_id, left_, top_, right_, bottom_ FROM (SELECT event_id, greatest(0, least(1280 - 324, round_even(greatest(0, least(956, cx - 162)), 0))) / 1280 AS left_,
        round_even(greatest(0, least(396, cy - 162)), 0) / 720 AS top_, least(1280, round_even(greatest(0, least(956, cx - 162)), 0) + 324) / 1280 AS right_,
        least(720, round_even(greatest(0, least(396, cy - 162)), 0) + 324) / 720 AS bottom_
    FROM (SELECT event_id, least(1, value / 100) * 1280 AS cx, CASE WHEN event_type = 'error' THEN 0.5 ELSE least(1, value / 60) END * 720 AS cy FROM @events))""")
def crop_bbox(spark, sf):
    ev = view(spark, sf, "SELECT event_id, value / 100 AS u, CASE WHEN event_type = 'error' THEN NULL ELSE value / 60 END AS v FROM @events")
    box = geo.crop_bbox("u", "v", F.lit(1280), F.lit(720), 0.45)
    return ev.withColumn("b", box).select("event_id", *[F.col(f"b.{c}").alias(f"{c}_") for c in ("left", "top", "right", "bottom")])


@query("""WITH a AS (SELECT event_id, value / 100 AS h FROM @events)
    SELECT event_id, round(sin(2 * h), 6) AS forward_x, round(cos(2 * h), 6) AS forward_z, round(cos(2 * h), 6) AS right_x, 1.0::DOUBLE AS up_y FROM a""")
def camera_basis(spark, sf):
    # a turn by 2h about the vertical axis
    ev = view(spark, sf, "SELECT event_id, value / 100 AS h FROM @events")
    q = (F.lit(0.0), F.sin("h"), F.lit(0.0), F.cos("h"))
    basis = geo.camera_basis(q)
    return ev.select("event_id", F.round(basis["forward"]["x"], 6).alias("forward_x"), F.round(basis["forward"]["z"], 6).alias("forward_z"),
                     F.round(basis["right"]["x"], 6).alias("right_x"), F.round(basis["up"]["y"], 6).alias("up_y"))


TEMPLATE = "Event:\n[EVENT_BLOCK]\nScene bounds:\n[SCENE_BOUNDS_BLOCK]\nEvidence:\n[EVIDENCE_BLOCK]\n"


def contexts(spark, sf):
    ev = tq.evidence(spark, sf)
    gaze_d, hand_d = (F.round(geo.distance("camera", c), 3) for c in ("gaze", "hand"))
    frame = F.struct(
        "panel_index", F.concat(F.lit("P"), F.col("panel_index").cast("string")).alias("panel_id"),
        F.concat(F.lit("frames/"), F.col("file_seq").cast("string"), F.lit(".jpg")).alias("image"), F.round(F.col("t_us") / 1e6, 3).alias("seconds"),
        F.round("score", 3).alias("score"), "reason", "camera", "gaze", "hand", "gaze_valid", "hand_valid", gaze_d.alias("gaze_distance"), hand_d.alias("hand_distance"),
    )
    rows = ev.groupBy(*tq.EVENT).agg(F.array_sort(F.collect_list(frame)).alias("frames"))
    bounds = nn.robust_bounds(view(spark, sf, "v_anchors"))
    bounds = bounds.select("scene", F.struct(*[c for c in bounds.columns if c != "scene"]).alias("bounds"))
    rows = rows.join(F.broadcast(bounds), "scene")  # one row per scene of a bounded inventory
    rows = rows.withColumn("event_id", F.concat_ws("_", "scene", F.col("row_index").cast("string"), F.col("day").cast("string")))
    rows = rows.withColumn("instruction_text", F.concat(F.lit("Pick up item "), F.col("row_index").cast("string")))
    rows = rows.withColumn("utterance_text", F.when(F.col("row_index") % 2 == 0, "this one"))
    return bt.render_context(rows, TEMPLATE)


def counted(text: str, pattern: str):
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


PER_EVENT = """per AS (SELECT scene, row_index, day, count(*) AS n_frames, count(*) FILTER (gaze_valid) AS n_gaze, count(*) FILTER (hand_valid) AS n_hand FROM evidence GROUP BY 1, 2, 3)"""


@query(f"""WITH {tq.SELECT_SQL}, {PER_EVENT} SELECT scene, row_index, day, n_frames, n_gaze, n_hand,
    'event_id: ' || scene || '_' || row_index || '_' || day AS first_line, row_index % 2 = 0 AS has_utterance FROM per""")
def render_context(spark, sf):
    c = contexts(spark, sf)
    t = "context_text"
    return c.select(*tq.EVENT, counted(t, r"(?m)^- P\d+:$").alias("n_frames"), counted(t, r"_GAZE: \[").alias("n_gaze"), counted(t, r"_HAND: \[").alias("n_hand"),
                    F.get(F.split(t, "\n"), 1).alias("first_line"), F.contains(F.col(t), F.lit("utterance_text: this one")).alias("has_utterance"))


NO_G, NO_H = "variant IN ('no_gaze', 'no_gaze_hand')", "variant IN ('no_hand', 'no_hand_strict', 'no_gaze_hand')"
VARIANT_SQL = "(SELECT unnest([" + ", ".join(f"'{v}'" for v in bt.VARIANTS) + "]) AS variant)"


@query(f"""WITH {tq.SELECT_SQL}, {PER_EVENT} SELECT scene, row_index, day, variant, CASE WHEN {NO_G} THEN 0 ELSE n_gaze END AS n_gaze,
    CASE WHEN {NO_H} THEN 0 ELSE n_hand END AS n_hand, CASE WHEN {NO_G} OR {NO_H} THEN 0 ELSE n_frames END AS n_scores,
    CASE WHEN variant = 'no_visual' THEN 0 ELSE n_frames END AS n_images FROM per, {VARIANT_SQL}""")
def mask_context(spark, sf):
    m = bt.mask_context(contexts(spark, sf))
    t = "context_text"
    return m.select(*tq.EVENT, "variant", counted(t, r"_GAZE: \[").alias("n_gaze"), counted(t, r"_HAND: \[").alias("n_hand"),
                    counted(t, "selection_score:").alias("n_scores"), counted(t, r"image: frames/").alias("n_images"))


@query(f"""WITH {tq.SELECT_SQL}, {PER_EVENT} SELECT variant, count(*) AS n_records,
    count(*) FILTER (variant NOT IN ('no_gaze', 'no_gaze_hand') AND n_gaze = 0) AS n_failed FROM per, {VARIANT_SQL} GROUP BY 1""")
def leakage_audit(spark, sf):
    masked = bt.mask_context(contexts(spark, sf))
    expected = spark.createDataFrame(
        [(v, v != "no_visual", v not in ("no_gaze", "no_gaze_hand"), v != "no_instruction") for v in bt.VARIANTS],
        "variant string, expect_has_visual_path boolean, expect_has_gaze_payload boolean, expect_has_instruction_value boolean",
    )
    out = au.audit_context(masked, expected, "context_text")
    return out.groupBy("variant").agg(F.count("*").alias("n_records"), F.count_if(F.size("failures") > 0).alias("n_failed"))
