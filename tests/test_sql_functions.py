"""SQL functions against the same expressions from Python; the brace scan against a walk over characters."""

import random

import pytest
from pyspark.sql import functions as F

from groundmetrics.functions import payload as pl
from groundmetrics.functions import sql
from groundmetrics.operators import parsing as ps


def walk(text):
    """First balanced object, character by character."""
    start = (text or "").find("{")
    depth, inside, i = 0, False, start
    while 0 <= i < len(text or ""):
        ch = text[i]
        if inside and ch == "\\":
            i += 1
        elif ch == '"':
            inside = not inside
        elif not inside and ch in "{}":
            depth += 1 if ch == "{" else -1
            if not depth:
                return text[start:i + 1]
        i += 1
    return None


def test_brace_scan_equals_a_walk(spark):
    r = random.Random(11)
    texts = ["".join(r.choice(['{', '}', '"', '\\', 'a', '\n', '{"k": "', '"}', "é"]) for _ in range(r.randrange(25))) for _ in range(3000)]
    texts += [None, "", "}{", '{"a\\', '{"a":"' + "\\n" * 20_000 + '"} tail', "x" * 50_000 + "{}", "{" * 3000 + "}" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pl.extract_json("t").alias("j"))
    assert "ArrowEvalPython" not in df._jdf.queryExecution().toString()
    for row in df.collect():
        assert row.j == walk(texts[row.i]), repr(texts[row.i])[:200]


@pytest.fixture(scope="module")
def data(spark):
    sql.register(spark)
    texts = [' Fork 3 ', "N/A", "null", "12", "-7.9", "NaN", "TRUE", "a; b|c", "it's \"x\"", "2024-01-02T03:04:05.1234567Z", "ScreenRecord_2024-01-02-03_04_05.mp4", "Zoom Crop",
             'x {"points_3d": [{"referent": "b", "point": [1, 2, 3], "confidence": 2}, {"point": [4, 5, 6]}]}', '{"points_3d": [{"point": [1, 2]}]}', "", None,
             '```json\n{"referents": [{"mention": "m", "panel_id": "2", "x_norm": 0.5, "y_norm": 3}]}\n```', '{"parsed_response": {"selected_object_names": ["A", "a"]}}', "fork12",
             '{"points_3d": [{"point": [1, 2, 3]}, {"point": [1]}]}']
    points = "named_struct('x', {0}, 'y', 1.5D, 'z', 2 * {0})"
    point = lambda e: points.format(f"CAST({e} AS DOUBLE)")
    joints = f"named_struct('joints', array(named_struct('id', 8, 'position', {point('i')}), named_struct('id', 2, 'position', {point('3')})))"
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").selectExpr(
        "*", "t AS mention", "'the red box' AS instruction", "array(t, upper(t), '') AS names", "i / 7D AS v", f"{point('i')} AS p", f"{point('3 - i')} AS q0",
        "named_struct('x', 0.1D * i, 'y', 0.2D, 'z', 0.3D, 'w', 0.9D) AS rotation", f"{point('0')} AS camera", "60D AS fov", "1280D AS width", "720D AS height",
        f"named_struct('isEyeOpen', i % 3 <> 0, 'gazePoint', {point('i')}, 'gazeOrigin', {point('1')}, 'gazeVector', {point('2')}, 'cameraHitPoint', {point('4')}) AS eyeGaze",
        f"named_struct('isLeftHandTracked', false, 'isRightHandTracked', i % 2 = 0, 'leftHand', {joints}, 'rightHand', {joints}, 'rightIndexFingerRayHitPoint', {point('i')}) AS handData",
        f"{point('i')} AS cameraPosition")
    df = df.withColumn("cameraRotation", F.col("rotation"))
    df.createOrReplaceTempView("sql_cases")
    return df


@pytest.mark.parametrize("name", sorted(sql.SCALARS))
def test_scalar_equals_python(spark, data, name):
    params, made = sql.SCALARS[name]
    rotation = "q STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE, w" in params
    d = data.withColumn("q", F.col("rotation" if rotation else "q0"))
    d.createOrReplaceTempView("sql_cases_q")
    args = [p.split()[0] for p in _split(params)]
    got = spark.sql(f"SELECT i, to_json(struct({name}({', '.join(args)}) AS r)) AS r FROM sql_cases_q").collect()
    want = d.select("i", F.to_json(F.struct(made().alias("r"))).alias("r")).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}
    assert len({r.r for r in want}) > 1 or name == "gm_valid_camera"


def _split(params):
    depth, out = 0, [""]
    for ch in params:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def test_table_functions(spark, data):
    got = spark.sql("SELECT s.i, p.* FROM sql_cases s, LATERAL gm_points_of(s.t) p").collect()
    made = ps.parse_points(data.select("i", "t"), "t").select("i", "parse_ok", "invalid_reason", F.posexplode_outer("points").alias("k", "e"))
    assert {(r.i, r.parse_ok, r.invalid_reason, r.point_index, r.referent, r.point) for r in got} == {
        (r.i, r.parse_ok, r.invalid_reason, r.k, r.e and r.e.referent, r.e and r.e.point) for r in made.collect()}
    rows = spark.sql("SELECT s.i, p.* FROM sql_cases s, LATERAL gm_referents_of(s.t) p WHERE p.mention IS NOT NULL").collect()
    assert [(r.i, r.referent_index, r.panel_id, r.x_norm, r.y_norm) for r in rows] == [(16, 0, "P2", 0.5, None)]
