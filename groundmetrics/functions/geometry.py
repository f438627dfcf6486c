"""Vector, quaternion, camera and box arithmetic as Column expressions (no UDF)."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundmetrics.functions.text import clamp, let

Vec = tuple[Column, ...]


def vec(c: Column | str | Vec, axes: str = "xyz") -> Vec:
    """Components of a struct column (tuples pass through)."""
    if isinstance(c, tuple):
        return c
    base = F.col(c) if isinstance(c, str) else c
    return tuple(base[a] for a in axes)


def point(x, y, z) -> Column:
    """Struct point, NULL when any part is NULL."""
    parts = [F.col(p) if isinstance(p, str) else p for p in (x, y, z)]
    built = F.struct(*[p.cast("double").alias(a) for p, a in zip(parts, "xyz")])
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), built)


def as_point(v: Vec) -> Column:
    return point(*v)


def add(a, b) -> Vec:
    return tuple(p + q for p, q in zip(vec(a), vec(b)))


def sub(a, b) -> Vec:
    return tuple(p - q for p, q in zip(vec(a), vec(b)))


def scale(a, k) -> Vec:
    return tuple(p * k for p in vec(a))


def dot(a, b) -> Column:
    x, y, z = (p * q for p, q in zip(vec(a), vec(b)))
    return x + y + z


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def distance(a, b) -> Column:
    return norm(sub(a, b))


def normalize(a, eps: float = 1e-9) -> Column:
    length = norm(a)
    return F.when(length > eps, as_point(scale(a, F.lit(1.0) / length)))


def nonzero(a, eps: float = 1e-6) -> Column:
    x, y, z = (F.abs(p) > eps for p in vec(a))
    return x | y | z


def quat_multiply(a: Vec, b: Vec) -> Vec:
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (
        aw * bx + bw * ax + (ay * bz - az * by),
        aw * by + bw * ay + (az * bx - ax * bz),
        aw * bz + bw * az + (ax * by - ay * bx),
        aw * bw - (ax * bx + ay * by + az * bz),
    )


def quat_conjugate(q) -> Vec:
    x, y, z, w = vec(q, "xyzw")
    return -x, -y, -z, w


def quat_rotate(v, q) -> Vec:
    q = vec(q, "xyzw")
    turned = quat_multiply(quat_multiply(q, (*vec(v), F.lit(0.0))), quat_conjugate(q))
    return turned[:3]


def camera_basis(rotation) -> dict[str, Column]:
    axes = {"right": (1.0, 0.0, 0.0), "up": (0.0, 1.0, 0.0), "forward": (0.0, 0.0, 1.0)}
    return {n: normalize(quat_rotate(tuple(F.lit(v) for v in a), rotation)) for n, a in axes.items()}


def to_camera(cam_pos, cam_rot, p) -> Vec:
    return quat_rotate(sub(p, cam_pos), quat_conjugate(cam_rot))


# Steps of a projection, each over the named values of the one before: offset and inverse rotation, half-turned quaternion, camera
# coordinates and half-angle, image coordinates. Written out as one expression, every use of a coordinate would repeat the rotation.

def _offset(cam_pos, cam_rot, p) -> dict[str, Column]:
    return dict(zip(("dx", "dy", "dz", "qx", "qy", "qz", "qw"), (*sub(p, cam_pos), *quat_conjugate(cam_rot))))


def _half_turned(c) -> dict[str, Column]:
    q = tuple(c(n) for n in ("qx", "qy", "qz", "qw"))
    a = quat_multiply(q, (c("dx"), c("dy"), c("dz"), F.lit(0.0)))
    return dict(zip(("ax", "ay", "az", "aw", "qx", "qy", "qz", "qw"), (*a, *q)))


def _in_camera(c, fov: Column) -> dict[str, Column]:
    a, (x, y, z, w) = (tuple(c(f"{k}{n}") for n in "xyzw") for k in "aq")
    return dict(zip(("x", "y", "z", "half"), (*quat_multiply(a, (-x, -y, -z, w))[:3], F.tan(F.radians(F.when((fov > 0.0) & (fov < 180.0), fov)) / 2.0))))


def _on_plane(c, width: Column, height: Column, mode: str) -> dict[str, Column]:
    z = F.when(c("z") > 1e-6, c("z"))  # NULL behind the camera, which also keeps the divisions safe
    half = F.when(c("half") > 0.0, c("half"))  # likewise without an opening angle
    across = half if mode == "square_unbounded" else half * (width / height)
    return {"u": (c("x") / (z * across) + 1.0) * 0.5, "v": (1.0 - c("y") / (z * half)) * 0.5, "depth": z, "half": half}


def _gated(c, mode: str) -> Column:
    u, v = c("u"), c("v")
    ok = c("depth").isNotNull() & c("half").isNotNull()
    if mode == "bounded":
        ok = ok & u.between(0.0, 1.0) & v.between(0.0, 1.0)
    elif mode == "tolerant":
        ok = ok & u.between(-0.5, 1.5) & v.between(-0.5, 1.5)
    return F.when(ok, F.struct(u.alias("u"), v.alias("v"), c("depth").alias("depth")))


def _size(fov, width, height) -> tuple[Column, Column, Column]:
    fov = F.col(fov) if isinstance(fov, str) else fov
    return fov, *(n if isinstance(n, Column) else F.lit(float(n)) for n in (width, height))


def project_point(cam_pos, cam_rot, fov, p, width, height, mode: str = "bounded") -> Column:
    """Project a world point to normalised image coordinates ``STRUCT<u, v, depth>``.

    ``bounded``: aspect-aware, NULL off the image. ``tolerant``: aspect-aware, keeps half an image
    beyond each edge. ``square_unbounded``: one half-angle for both axes, no gate.
    """
    fov, width, height = _size(fov, width, height)

    def bound(values: dict[str, Column]) -> Column:
        return F.struct(*[v.cast("double").alias(n) for n, v in values.items()])

    image = bound(_offset(cam_pos, cam_rot, p))
    image = let(image, lambda s: bound(_half_turned(s.getField)))
    image = let(image, lambda s: bound(_in_camera(s.getField, fov)))
    image = let(image, lambda s: bound(_on_plane(s.getField, width, height, mode)))
    return let(image, lambda s: _gated(s.getField, mode))


def with_projection(df: DataFrame, out: str, cam_pos, cam_rot, fov, p, width, height, mode: str = "bounded") -> DataFrame:
    """Adds ``project_point`` as column ``out``, its steps as columns of their own, which Spark compiles; a bound expression it interprets.

    The field of view is bound in every step: a projection with a bound value is compiled apart from the next one. Together they would
    make one method too long for the JVM to optimise (measured: 15.7 s against 3.5 s for 600,000 rows on 2 cores).
    """
    fov, width, height = _size(fov, width, height)
    kept = df.columns
    here = lambda n: F.col(f"_p_{n}")

    def step(rows: DataFrame, values: dict[str, Column], angle: Column) -> DataFrame:
        return rows.select(*kept, let(angle, lambda f: f).alias("_p_fov"), *[v.cast("double").alias(f"_p_{n}") for n, v in values.items()])

    rows = step(df, _offset(cam_pos, cam_rot, p), fov)
    rows = step(rows, _half_turned(here), here("fov"))
    rows = step(rows, _in_camera(here, here("fov")), here("fov"))
    rows = step(rows, _on_plane(here, width, height, mode), here("fov"))
    return rows.select(*kept, _gated(here, mode).alias(out))


def angular_error_deg(camera, predicted, truth) -> Column:
    a, b = sub(predicted, camera), sub(truth, camera)
    na, nb = norm(a), norm(b)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))
    return F.when((na > 1e-9) & (nb > 1e-9), F.degrees(F.acos(cosine)))


def crop_bbox(u, v, width, height, ratio: float) -> Column:
    """Square crop around a point (image centre when missing), kept inside the image, normalised."""
    u, v, width, height = (F.col(c) if isinstance(c, str) else c for c in (u, v, width, height))
    width, height = width.cast("double"), height.cast("double")
    side = F.greatest(F.lit(32.0), F.floor(F.least(width, height) * min(0.9, max(0.1, ratio))).cast("double"))

    def edge(center, size):
        mid = clamp(F.coalesce(center, F.lit(0.5)), 0.0, 1.0) * size
        return F.bround(clamp(mid - side / 2.0, 0.0, F.greatest(F.lit(0.0), size - side)))

    left, top = edge(u, width), edge(v, height)
    return F.struct(
        (left / width).alias("left"), (top / height).alias("top"),
        (F.least(width, left + side) / width).alias("right"),
        (F.least(height, top + side) / height).alias("bottom"),
    )


def box_center(box) -> Vec:
    x1, y1, x2, y2 = vec(box, ("x1", "y1", "x2", "y2")) if not isinstance(box, tuple) else box
    return (x1 + x2) / 2.0, (y1 + y2) / 2.0


def box_distance(box, px, py, width, height) -> Column:
    """Distance of a point to the box centre in image diagonals."""
    cx, cy = box_center(box)
    return F.hypot(cx - px, cy - py) / F.greatest(F.lit(1.0), F.hypot(width, height))


def focal_pixels(fov, height) -> Column:
    return height / (2.0 * F.tan(F.radians(fov) / 2.0))


def sheet_cell(position: Column, columns: int, panel_w: int, panel_h: int, label_h: int, gutter: int) -> tuple[Column, Column]:
    """Top-left corner of the ``position``-th (0-based) panel on a contact sheet."""
    col = F.pmod(position, F.lit(columns))
    row = F.floor(position / columns)
    return gutter + col * (panel_w + gutter), gutter + row * (panel_h + label_h + gutter)


def letterbox(width: Column, height: Column, panel_w: int, panel_h: int) -> tuple[Column, Column, Column, Column]:
    """Content width, content height and paddings of an image fitted into a panel."""
    k = F.least(F.lit(float(panel_w)) / width, F.lit(float(panel_h)) / height)
    cw, ch = width * k, height * k
    return cw, ch, (panel_w - cw) / 2.0, (panel_h - ch) / 2.0


