"""Adapter views: the domain's tables derived from the driver tables, one SQL text for both engines."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

from groundmetrics.operators.scale import partitions_for

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000

VIEWS: dict[str, str] = {
    # Anchor inventory: one object per (scene, nation), so at most 4 x 25 rows at any scale.
    "v_anchors": """
        SELECT concat('scene', CAST(s_suppkey % 4 AS STRING)) AS scene,
               CAST(s_nationkey AS BIGINT) AS anchor_seq,
               min(n_name) AS anchor_id,
               min_by(s_acctbal, s_suppkey) / 1000 AS x,
               CAST(s_nationkey AS DOUBLE) AS y,
               CAST(min(s_suppkey) % 13 AS DOUBLE) AS z
        FROM @supplier JOIN @nation ON s_nationkey = n_nationkey
        GROUP BY s_suppkey % 4, s_nationkey""",
    "v_aliases": """
        SELECT scene, anchor_seq, anchor_id,
               concat(lower(replace(anchor_id, '_', '-')), '; obj ', CAST(anchor_seq AS STRING),
                      '|forklift_', CAST(anchor_seq AS STRING), ', Mark-', CAST(anchor_seq % 7 AS STRING)) AS aliases
        FROM @v_anchors""",
    # Every interaction, with or without targets.
    "v_keys": """
        SELECT concat('scene', CAST(o_orderkey % 4 AS STRING)) AS scene, o_orderkey AS row_index,
               o_orderpriority, o_orderstatus, o_totalprice
        FROM @orders""",
    "v_gt": """
        SELECT concat('scene', CAST(l_orderkey % 4 AS STRING)) AS scene, l_orderkey AS row_index,
               (l_linenumber * 10000000 + l_partkey) * 100000 + l_suppkey AS gt_seq, n_name AS label
        FROM @lineitem JOIN @nation ON l_suppkey % 25 = n_nationkey
        WHERE l_returnflag <> 'N'""",
    "v_mentions": """
        SELECT concat('scene', CAST(l_orderkey % 4 AS STRING)) AS scene, l_orderkey AS row_index,
               (l_linenumber * 10000000 + l_partkey) * 100000 + l_suppkey AS pred_seq,
               CASE l_partkey % 6 WHEN 0 THEN n_name WHEN 1 THEN concat(' ', lower(n_name))
                    WHEN 2 THEN concat('OBJ_', CAST(n_nationkey AS STRING))
                    WHEN 3 THEN concat('fork ', CAST(n_nationkey AS STRING))
                    WHEN 4 THEN concat('mark ', CAST(n_nationkey % 7 AS STRING))
                    ELSE concat('thing', CAST(n_nationkey % 3 AS STRING)) END AS label
        FROM @lineitem JOIN @nation ON l_suppkey % 25 = n_nationkey
        WHERE l_linestatus = 'O'""",
    "v_gt_points": """
        SELECT g.scene, g.row_index, min(g.gt_seq) AS gt_seq, a.anchor_seq, a.anchor_id, a.x, a.y, a.z
        FROM @v_gt g JOIN @v_anchors a ON g.scene = a.scene AND g.label = a.anchor_id
        GROUP BY g.scene, g.row_index, a.anchor_seq, a.anchor_id, a.x, a.y, a.z""",
    "v_preds": """
        SELECT concat('scene', CAST(l_orderkey % 4 AS STRING)) AS scene, l_orderkey AS row_index,
               (l_linenumber * 10000000 + l_partkey) * 100000 + l_suppkey AS pred_seq,
               l_quantity / 5 AS x, abs(l_discount) * 250 AS y, abs(l_tax) * 150 AS z
        FROM @lineitem WHERE l_linestatus = 'O'""",
    # 2D answers and the panel manifest they are scored against (three panels per interaction).
    "v_refs2d": """
        SELECT concat('scene', CAST(l_orderkey % 4 AS STRING)) AS scene, l_orderkey AS row_index,
               (l_linenumber * 10000000 + l_partkey) * 100000 + l_suppkey AS pred_seq,
               CASE WHEN l_partkey % 2 = 0 THEN lower(n_name) ELSE 'thing' END AS mention,
               concat('P', CAST(l_linenumber % 3 + 1 AS STRING)) AS pred_panel,
               l_quantity / 50 AS x_norm, abs(l_discount) * 10 AS y_norm,
               CASE WHEN l_tax > 0.06 THEN l_quantity / 60 END AS sheet_x_norm, CASE WHEN l_tax > 0.06 THEN abs(l_tax) * 5 END AS sheet_y_norm,
               CASE l_partkey % 4 WHEN 0 THEN 'Gaze Crop' WHEN 1 THEN 'full-panel' ELSE '' END AS coordinate_space,
               l_extendedprice AS price
        FROM @lineitem JOIN @nation ON l_suppkey % 25 = n_nationkey
        WHERE l_linestatus = 'O'""",
    # Answers as models spell them: every line item, panel names in four spellings or missing, coordinates partly out of range.
    "v_answers2d": """
        SELECT concat('scene', CAST(l_orderkey % 4 AS STRING)) AS scene, l_orderkey AS row_index,
               (l_linenumber * 10000000 + l_partkey) * 100000 + l_suppkey AS pred_seq,
               CASE WHEN l_partkey % 2 = 0 THEN lower(n_name) WHEN l_partkey % 7 = 0 THEN NULL ELSE 'thing' END AS mention,
               CASE l_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN concat(' p', CAST(l_linenumber % 3 + 1 AS STRING))
                    WHEN 2 THEN CAST(l_linenumber % 3 + 1 AS STRING) WHEN 3 THEN 'P7' WHEN 4 THEN '  '
                    ELSE concat('P', CAST(l_linenumber % 3 + 1 AS STRING)) END AS pred_panel,
               CASE WHEN l_partkey % 13 >= 1 THEN l_quantity / 48 END AS x_norm, abs(l_discount) * 10 AS y_norm,
               CASE WHEN l_tax > 0.05 THEN l_quantity / 49 END AS sheet_x_norm, CASE WHEN l_tax > 0.06 THEN abs(l_tax) * 5 END AS sheet_y_norm
        FROM @lineitem JOIN @nation ON l_suppkey % 25 = n_nationkey""",
    "v_manifest": """
        SELECT scene, row_index, referent, gt_seq * 3 + panel_index AS manifest_seq, panel_index,
               concat('P', CAST(panel_index AS STRING)) AS panel_id,
               ((price + 137 * panel_index) % 100) / 100 AS gt_u, ((price + 59 * panel_index) % 80) / 80 AS gt_v,
               (price + panel_index) % 7 >= 1 AS projection_valid, ((price + 31 * panel_index) % 100) / 100 AS gaze_u,
               ((price + 17 * panel_index) % 60) / 60 AS gaze_v, (price + panel_index) % 5 >= 1 AS gaze_projection_valid,
               1280 AS image_width, 720 AS image_height, price % 11 >= 1 AS frame_extracted,
               (price % 13) / 13 AS panel_score, panel_index * 1.5 AS video_time
        FROM (SELECT g.*, p.panel_index FROM (
                SELECT concat('scene', CAST(l_orderkey % 4 AS STRING)) AS scene, l_orderkey AS row_index, n_name AS referent,
                       min((l_linenumber * 10000000 + l_partkey) * 100000 + l_suppkey) AS gt_seq,
                       min_by(l_extendedprice, (l_linenumber * 10000000 + l_partkey) * 100000 + l_suppkey) AS price
                FROM @lineitem JOIN @nation ON l_suppkey % 25 = n_nationkey WHERE l_returnflag <> 'N' GROUP BY l_orderkey, n_name) g,
              (SELECT 1 AS panel_index UNION ALL SELECT 2 UNION ALL SELECT 3) p) m""",
    # Raw model answers, one per line item, damaged in twelve ways by part number.
    "v_raw_base": """
        SELECT concat('scene', CAST(l_orderkey % 4 AS STRING)) AS scene, l_orderkey AS row_index,
               (l_linenumber * 10000000 + l_partkey) * 100000 + l_suppkey AS pred_seq, l_partkey % 12 AS code, n_name AS name,
               l_quantity / 5 AS x, abs(l_discount) * 250 AS y, abs(l_tax) * 150 AS z,
               concat(CAST(l_quantity / 5 AS STRING), ', ', CAST(abs(l_discount) * 250 AS STRING), ', ', CAST(abs(l_tax) * 150 AS STRING)) AS xyz,
               l_quantity, l_tax, l_linenumber, l_suppkey
        FROM @lineitem JOIN @nation ON l_suppkey % 25 = n_nationkey""",
    "v_raw": """
        SELECT scene, row_index, pred_seq, code, x, y, z, CASE code
            WHEN 0 THEN '  ' WHEN 1 THEN concat('{"points_3d": [{"point": [', xyz)
            WHEN 2 THEN concat('Answer: ```json', chr(10), body, chr(10), '``` done {')
            WHEN 3 THEN '{"points_3d": [{"point": [1.0, 2.0]}]}' WHEN 4 THEN 'no object here [1, 2]'
            WHEN 5 THEN '{"points": []}' WHEN 6 THEN '{"points_3d": [{"point": 5}]}'
            WHEN 7 THEN concat('{"points_3d": [{"point": [', xyz, ']}, 7]}')
            WHEN 8 THEN concat('{"points_3d": [{"point": [', xyz, '], "confidence": "high"}]}')
            WHEN 9 THEN '{"points_3d": [{"point": [1.5, true, 2]}]}' WHEN 10 THEN '{"points_3d": []}' ELSE body END AS raw
        FROM (SELECT *, concat('{"points_3d": [{"referent": "', name, ' {a}", "point": [', xyz, '], "confidence": ', CAST(y AS STRING), '}]}') AS body
              FROM @v_raw_base) b""",
    "v_raw_point": """
        SELECT scene, row_index, pred_seq, code % 6 AS code, x, y, z, CASE code % 6 WHEN 0 THEN concat('none at all ', xyz)
            WHEN 1 THEN concat('{"point_3d": {"x": ', CAST(x AS STRING), ', "y": ', CAST(y AS STRING), ', "z": ', CAST(z AS STRING), '}}')
            WHEN 2 THEN concat('Sure. ```json', chr(10), '{"point_3d": [', xyz, ',], }', chr(10), '```')
            WHEN 3 THEN concat('{"point_3d": [', xyz, ', 1]}') WHEN 4 THEN concat('{"point": [', xyz, ']}')
            ELSE '{"point_3d": {"x": 1, "y": null, "z": 2}}' END AS raw
        FROM @v_raw_base""",
    "v_raw_refs": """
        SELECT scene, row_index, pred_seq, code, name, l_quantity / 40 AS xn, abs(l_tax) * 10 AS yn, l_linenumber AS panel, CASE code % 4
            WHEN 0 THEN 'I cannot tell' WHEN 1 THEN concat('```json', chr(10), item, ' // note "x"', chr(10), '], }', chr(10), '```')
            WHEN 2 THEN concat('Result: ', item, '],}') ELSE concat(item, ', 5 ]}') END AS raw
        FROM (SELECT *, concat('{"referents": [{"mention": " ', name, ' // x", "panel_id": "', CASE WHEN l_linenumber % 2 = 0 THEN 'p' ELSE '' END,
                CAST(l_linenumber AS STRING), '", "x_norm": ', CAST(l_quantity / 40 AS STRING), ', "y_norm": "', CAST(abs(l_tax) * 10 AS STRING),
                '", "source": "Zoom-Crop", "confidence": ', CAST(l_quantity / 25 AS STRING), '}') AS item FROM @v_raw_base) b""",
    # Keyframe and peak answers, one per event row.
    "v_responses": """
        SELECT event_id, event_type, value, value / 100 AS u, event_id % 9 AS code, CASE event_id % 9
            WHEN 0 THEN 'unclear' WHEN 1 THEN '{"referent_type": "none", "primary_source": "none", "prior_usage": "no_prior", "confidence": 0.4}'
            WHEN 2 THEN '{"referent_type": "none", "primary_source": "fused", "prior_usage": "no_prior", "confidence": 0.4}'
            WHEN 3 THEN '{"referent_type": "thing", "primary_source": "fused", "prior_usage": "no_prior", "u_norm": 0.2, "v_norm": 0.3, "confidence": 0.4}'
            WHEN 4 THEN '{"referent_type": "entity", "primary_source": "fused", "prior_usage": "no_prior", "u_norm": null, "v_norm": 0.3, "confidence": 0.4}'
            ELSE concat('ok ```json {"referent_type": " Entity", "primary_source": "gazePoint", "prior_usage": "near_prior", "u_norm": ', CAST(value / 100 AS STRING),
                ', "v_norm": "0.25", "confidence": ', CAST(value / 50 AS STRING), ',} ```') END AS raw
        FROM @events""",
    "v_peaks": """
        SELECT event_id, event_id % 4 AS code, value, CAST(event_id % 20 AS DOUBLE) AS t_start, CAST(event_id % 20 AS DOUBLE) + 30 AS t_end, CASE event_id % 4
            WHEN 0 THEN concat('{"peak_time_seconds": ', CAST(value AS STRING), ', "confidence": ', CAST(value / 40 AS STRING), ', "panel_id": " p2", "candidate_panel_ids": ["p2", " P7 "]}')
            WHEN 1 THEN concat('The panel timestamp seconds: ', CAST(value AS STRING), ' with Confidence = 0.7, like p9; Panel-ID: p4, P9')
            WHEN 2 THEN concat('{"primary_panel_timestamp_seconds": "', CAST(value AS STRING), '", "confidence": 0.25, }')
            ELSE CASE event_id % 8 WHEN 3 THEN 'nothing usable' ELSE 'unclear: p5 or P3' END END AS raw
        FROM @events""",
    # One 3D answer per interaction: the last predicted point, a camera where one was logged.
    "v_answers": """
        SELECT k.scene, k.row_index, k.o_orderstatus <> 'P' AS parse_ok, p.x, p.y, p.z,
               CASE WHEN o_totalprice > 20000 THEN CAST(k.row_index % 7 AS DOUBLE) END AS cam_x,
               CAST(k.row_index % 5 AS DOUBLE) AS cam_y, CAST(k.row_index % 3 AS DOUBLE) AS cam_z
        FROM @v_keys k LEFT JOIN (
            SELECT scene, row_index, max_by(x, pred_seq) AS x, max_by(y, pred_seq) AS y, max_by(z, pred_seq) AS z
            FROM @v_preds GROUP BY scene, row_index) p
          ON k.scene = p.scene AND k.row_index = p.row_index""",
    "v_samples": f"""
        SELECT concat('scene', CAST(user_id % 4 AS STRING)) AS scene, user_id AS row_index,
               event_id AS file_seq, @EPOCH_US(ts) AS t_us,
               CAST(floor(@EPOCH_US(ts) / {DAY_US}) AS BIGINT) AS day,
               value / 50 AS gx, CAST(event_id % 25 AS DOUBLE) AS gy, CAST(event_id % 13 AS DOUBLE) + 1 AS gz,
               event_type <> 'error' AS eye_open,
               event_type IN ('click', 'purchase') AS hand_tracked,
               value / 40 AS hx, CAST(event_id % 11 AS DOUBLE) AS hy, CAST(event_id % 7 AS DOUBLE) + 1 AS hz,
               CAST(user_id % 7 AS DOUBLE) + value / 1000 AS cx, value / 500 AS cy, 0.0 * value AS cz,
               event_type, value
        FROM @events""",
    # Per user: first sample, capture-metadata clock and recording name (each sometimes missing or off).
    "v_capture": """
        SELECT scene, row_index, first_us,
               CASE row_index % 5 WHEN 0 THEN NULL WHEN 1 THEN first_us - 300000 WHEN 2 THEN first_us - 5000000
                    WHEN 3 THEN first_us + 4000000 ELSE first_us - 900000 END AS meta_us,
               CASE row_index % 7 WHEN 0 THEN 'clip.mp4'
                    ELSE concat('ScreenRecord_', @FILE_STAMP(first_us), '.mp4') END AS file_name
        FROM (SELECT scene, row_index, min(t_us) AS first_us FROM @v_samples GROUP BY scene, row_index) f""",
    # Sample stamps as logged text: seven and more fractional digits, zones, some broken.
    "v_stamps": """
        SELECT event_id, CASE WHEN event_type = 'error' THEN concat('bad ', @ISO(ts))
                    ELSE concat(@ISO(ts), CAST(event_id % 1000 AS STRING),
                                CASE event_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' ELSE '' END) END AS stamp
        FROM @events""",
    # One event window per user and day.
    "v_events": """
        SELECT scene, row_index, day, min(t_us) AS t_start, max(t_us) AS t_end,
               CAST(floor((min(t_us) + max(t_us)) / 2) AS BIGINT) AS t_peak, count(*) AS n_samples
        FROM @v_samples GROUP BY scene, row_index, day""",
}

_NAME = re.compile(r"@(v_\w+|[a-z]+)\b")
_ARROW = re.compile(r"\b([a-z]) -> ")
_MACRO = re.compile(r"@([A-Z_]+)\((\w+)\)")

# Calls that the two engines spell differently: name -> (Spark, DuckDB).
MACROS = {
    "EPOCH_US": ("unix_micros(CAST({0} AS TIMESTAMP))", "epoch_us({0})"),
    "FILE_STAMP": ("date_format(timestamp_micros({0}), 'yyyy-MM-dd-HH_mm_ss')", "strftime(make_timestamp({0}), '%Y-%m-%d-%H_%M_%S')"),
    "ISO": ("date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")", "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f')"),
}


def _expand(sql: str, table) -> str:
    def sub(m: re.Match) -> str:
        name = m.group(1)
        if name in VIEWS:
            return f"({_expand(VIEWS[name], table)})"
        if name in TABLES:
            return table(name)
        raise KeyError(name)

    return _NAME.sub(sub, sql)


def duck(sql: str) -> str:
    """The text with views inlined, for DuckDB (which spells lambdas ``lambda x: ...``)."""
    sql = _ARROW.sub(r"lambda \1: ", sql)
    return _MACRO.sub(lambda m: MACROS[m[1]][1].format(m[2]), _expand(sql, lambda t: t))


_schemas: dict = {}


def _table(spark: SparkSession, sf_dir: str, table: str, by: tuple | None = None) -> str:
    """Temp view over one driver table, its rows dealt by a column if ``by`` (column, partitions) is given; its schema is inferred once
    per session, its files are listed anew."""
    path = f"{sf_dir}/{table}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    name = f"gm_{table}_{zlib.crc32(sf_dir.encode()):08x}"
    rows = spark.read.schema(_schemas[key]).parquet(path)
    if by:
        name, rows = f"{name}_dealt", rows.repartition(by[1], by[0])
    rows.createOrReplaceTempView(name)
    return name


def view(spark: SparkSession, sf_dir: str, sql: str, by: dict[str, tuple] | None = None) -> DataFrame:
    """A view name or a query over views, as a DataFrame.

    Tables named in ``by`` are hash partitioned by a column as they are read, before anything is joined, exploded or grouped: what is
    grouped or joined by that column afterwards stays where it is.
    """
    if sql in VIEWS:
        sql = VIEWS[sql]
    text = _expand(sql, lambda t: _table(spark, sf_dir, t, (by or {}).get(t)))
    return spark.sql(_MACRO.sub(lambda m: MACROS[m[1]][0].format(m[2]), text))


def by_order(spark: SparkSession, sf_dir: str, rows: int = 100_000) -> dict[str, tuple]:
    """``by`` of a view: orders and line items dealt by order, one partition per ``rows`` line items if those are more than the session's."""
    n = partitions_for(view(spark, sf_dir, "SELECT l_orderkey FROM @lineitem"), rows) or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return {"orders": ("o_orderkey", n), "lineitem": ("l_orderkey", n)}


def registry():
    """A ``query(sql)`` decorator with its dictionaries of queries and DuckDB texts."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def register(fn):
            queries[fn.__name__] = fn
            if sql is not None:
                oracles[fn.__name__] = duck(sql)
            return fn

        return register

    return query, queries, oracles
