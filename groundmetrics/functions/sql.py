"""The scalar and table functions by name in SQL: ``register(spark)``, then ``spark.sql("SELECT gm_label_key(name) ...")``.

Every function is a temporary SQL function whose body is the text of the Column expression used from Python, so the two cannot
differ, Catalyst inlines it, and no Python worker runs. Classic sessions only: the text of an expression is read from the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from groundmetrics.functions import cues
from groundmetrics.functions import geometry as geo
from groundmetrics.functions import payload as pl
from groundmetrics.functions import text as tx
from groundmetrics.operators import parsing as ps

POINT = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>"
QUAT = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE, w: DOUBLE>"
JOINTS = f"STRUCT<joints: ARRAY<STRUCT<id: INT, position: {POINT}>>>"
EYE = f"eyeGaze STRUCT<isEyeOpen: BOOLEAN, gazePoint: {POINT}, gazeOrigin: {POINT}, gazeVector: {POINT}, cameraHitPoint: {POINT}>"
HAND = (f"handData STRUCT<isLeftHandTracked: BOOLEAN, isRightHandTracked: BOOLEAN, leftHand: {JOINTS}, rightHand: {JOINTS}, "
        f"rightIndexFingerRayHitPoint: {POINT}>")
_c, _T, _PQ = F.col, "t STRING", f"p {POINT}, q {POINT}"
_CAMERA = f"camera {POINT}, rotation {QUAT}, fov DOUBLE, p {POINT}, width DOUBLE, height DOUBLE"


def _basis() -> Column:
    return F.struct(*[v.alias(n) for n, v in geo.camera_basis(_c("q")).items()])


def _project(mode: str):
    return lambda: geo.project_point(_c("camera"), _c("rotation"), _c("fov"), _c("p"), _c("width"), _c("height"), mode)


# name -> parameters, expression over them
SCALARS = {
    "gm_norm_text": (_T, lambda: tx.norm_text("t")),
    "gm_is_missing": (_T, lambda: tx.is_missing("t")),
    "gm_finite_double": (_T, lambda: tx.finite_double("t")),
    "gm_finite_int": (_T, lambda: tx.finite_int("t")),
    "gm_lenient_int": (_T, lambda: tx.finite_int("t", lenient=True)),
    "gm_as_bool": (_T, lambda: tx.as_bool("t")),
    "gm_label_key": (_T, lambda: tx.label_key("t")),
    "gm_alnum_key": (_T, lambda: tx.label_key("t", "alnum")),
    "gm_fallback_label_key": (_T, lambda: tx.fallback_label_key(_c("t"))),
    "gm_split_names": (_T, lambda: tx.split_names("t")),
    "gm_unique_by_key": ("names ARRAY<STRING>", lambda: tx.unique_by_key("names")),
    "gm_parse_iso": (_T, lambda: tx.parse_iso("t")),
    "gm_filename_ts": (_T, lambda: tx.filename_ts("t")),
    "gm_sanitize_token": (_T, lambda: tx.sanitize_token("t")),
    "gm_clean_phrase": ("mention STRING, instruction STRING", lambda: tx.clean_phrase("mention", "instruction")),
    "gm_coordinate_space": (_T, lambda: tx.coordinate_space("t")),
    "gm_unit_gate": ("v DOUBLE", lambda: tx.unit_gate("v")),
    "gm_distance": (_PQ, lambda: geo.distance("p", "q")),
    "gm_normalize": (f"p {POINT}", lambda: geo.normalize(_c("p"))),
    "gm_camera_basis": (f"q {QUAT}", _basis),
    "gm_project_point": (_CAMERA, _project("bounded")),
    "gm_project_point_unbounded": (_CAMERA, _project("square_unbounded")),
    "gm_angular_error_deg": (f"camera {POINT}, {_PQ}", lambda: geo.angular_error_deg("camera", "p", "q")),
    "gm_gaze_hit": (EYE, cues.gaze_hit),
    "gm_gaze_direction": (EYE, cues.gaze_direction),
    "gm_gaze_world_point": (EYE, cues.gaze_world_point),
    "gm_hand_hit": (HAND, cues.hand_hit),
    "gm_hand_origin": (HAND, cues.hand_origin),
    "gm_valid_camera": (f"cameraPosition {POINT}, cameraRotation {QUAT}", cues.valid_camera),
    "gm_extract_json": (_T, lambda: pl.extract_json("t")),
    "gm_canonical_json": (_T, lambda: pl.canonical_json("t")),
    "gm_strict_points": (_T, lambda: ps.strict_points("t")),
    "gm_reread_points": (_T, lambda: ps.reread_points("t")),
    "gm_referents": (_T, lambda: ps.referents("t")),
    "gm_collect_labels": (_T, lambda: ps.collect_labels("t")),
}

# name -> parameters, body; one row per point / referent, a rejected answer gives one row without any
TABLES = {
    "gm_points_of": (_T, """SELECT r.parse_ok, r.invalid_reason, i AS point_index, e.referent, e.point, e.confidence
        FROM (SELECT gm_strict_points(t) AS r) LATERAL VIEW OUTER posexplode(r.points) x AS i, e""",
                     f"parse_ok BOOLEAN, invalid_reason STRING, point_index INT, referent STRING, point {POINT}, confidence DOUBLE"),
    "gm_referents_of": (_T, """SELECT r.parse_ok, i AS referent_index, e.mention, e.panel_id, e.coordinate_space, e.x_norm, e.y_norm, e.confidence
        FROM (SELECT gm_referents(t) AS r) LATERAL VIEW OUTER posexplode(r.referents) x AS i, e""",
                        "parse_ok BOOLEAN, referent_index INT, mention STRING, panel_id STRING, coordinate_space STRING, x_norm DOUBLE, y_norm DOUBLE, "
                        "confidence DOUBLE"),
}

_PIECES = re.compile(r"(?P<text>'(?:[^'\\]|\\.)*')|(?<![\w`.])(?P<call>[-+*/%<>=!|&^~]+|and|or|not|in)(?=\()|(?<![\w`.])(?P<real>\d+\.\d+(?:E-?\d+)?|Infinity)(?![\w.])", re.S)


def sql_text(c: Column) -> str:
    """The expression in SQL: operators are printed as calls, which SQL takes in back quotes, and doubles without a suffix."""
    def piece(m: re.Match) -> str:
        if m["call"]:
            return f"`{m['call']}`"
        return m["text"] or f"double('{m['real']}')"

    return _PIECES.sub(piece, c._jc.node().sql())


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session; returns their names."""
    for name, (params, made) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURN {sql_text(made())}")
    for name, (params, body, returned) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS TABLE ({returned}) RETURN {body}")
    return [*SCALARS, *TABLES]
