"""Validity rules of telemetry cues over nested sample columns.

A sample row carries ``cameraPosition, cameraRotation, cameraFOV, eyeGaze, handData``.
A missing flag is not the same as a false flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundmetrics.functions import geometry as geo

FINGER_JOINTS = (8, 9, 10, 11, 12)  # fixed values: joint ids of the pointing finger


def _eye_usable() -> Column:
    return F.col("eyeGaze").isNotNull() & ~F.col("eyeGaze.isEyeOpen").eqNullSafe(False)


def whole(p: Column) -> Column:
    """The point, or NULL if any component is missing."""
    return geo.point(p["x"], p["y"], p["z"])


def gaze_hit() -> Column:
    p = whole(F.col("eyeGaze.gazePoint"))
    return F.when(_eye_usable() & geo.nonzero(p), p)


def gaze_direction() -> Column:
    hit, origin = gaze_hit(), whole(F.col("eyeGaze.gazeOrigin"))
    along = geo.normalize(geo.sub(hit, origin))
    return F.when(_eye_usable(), F.coalesce(along, geo.normalize(whole(F.col("eyeGaze.gazeVector")))))


def gaze_world_point() -> Column:
    """Gaze point, else the camera hit point, with its source name."""
    first, second = whole(F.col("eyeGaze.gazePoint")), whole(F.col("eyeGaze.cameraHitPoint"))
    picked = F.when(geo.nonzero(first), F.struct(first.alias("point"), F.lit("gazePoint").alias("source"))).when(
        geo.nonzero(second), F.struct(second.alias("point"), F.lit("cameraHitPoint").alias("source"))
    )
    return F.when(_eye_usable(), picked)


def hand_hit(rule: str = "any_tracked") -> Column:
    """``any_tracked``: left or right hand flagged; ``right_not_lost``: right hand not flagged as lost."""
    hand = F.col("handData")
    if rule == "any_tracked":
        ok = F.coalesce(hand["isRightHandTracked"], F.lit(False)) | F.coalesce(hand["isLeftHandTracked"], F.lit(False))
    else:
        ok = hand.isNotNull() & ~hand["isRightHandTracked"].eqNullSafe(False)
    p = whole(hand["rightIndexFingerRayHitPoint"])
    return F.when(ok & geo.nonzero(p), p)


def hand_origin() -> Column:
    """Mean position of the pointing-finger joints of the right hand, else of all its joints."""
    joints = F.col("handData.rightHand.joints")
    finger = F.filter(joints, lambda j: j["id"].isin(*FINGER_JOINTS))
    used = F.filter(F.transform(F.when(F.size(finger) > 0, finger).otherwise(joints), lambda j: whole(j["position"])),
                    lambda p: p.isNotNull())
    n = F.size(used)

    def mean(axis: str) -> Column:
        return F.aggregate(used, F.lit(0.0), lambda s, p: s + p[axis]) / n

    return F.when(n > 0, geo.point(mean("x"), mean("y"), mean("z")))


def valid_camera() -> Column:
    return whole(F.col("cameraPosition")).isNotNull() & F.col("cameraRotation").isNotNull()
