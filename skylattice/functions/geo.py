"""Geometry as Catalyst expressions: frames of reference, angles, projection. No UDFs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def wrap_to_pi(a: Column) -> Column:
    """Angle in [-pi, pi), by the floored remainder."""
    return F.pmod(a + F.lit(math.pi), F.lit(TAU)) - F.lit(math.pi)


def bearing(x: Column, y: Column) -> Column:
    return F.atan2(y, x)


def horizontal(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def norm3(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def quaternion_yaw(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.atan2(2.0 * (w * z + x * y), 1.0 - 2.0 * (y * y + z * z))


def ned_to_map(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """North-east-down to map axes and back: the same flip."""
    return x, -y, -z


def ned_to_engine(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Engine centimetres: x stays, y turns, z points up."""
    return 100.0 * x, -100.0 * y, 100.0 * z


def map_yaw_to_engine_degrees(yaw: Column) -> Column:
    return -F.degrees(yaw)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def inside_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    return x.between(box[0], box[1]) & y.between(box[2], box[3])


def reflected(p: Column, v: Column, lo: float, hi: float, restitution: float = 0.8) -> Column:
    """Velocity after a bounce at the walls lo and hi of one axis."""
    outward = ((p <= lo) & (v < 0)) | ((p >= hi) & (v > 0))
    return F.when(outward, -v * restitution).otherwise(v)


def centering_offset(dx: Column, dy: Column, yaw: Column, gain: float = 10.0, cap: float = 8.0) -> tuple[Column, Column]:
    """Lateral shift (x, y), at most cap long, by which a target off the bore-sight comes back to it: across the bearing,
    gain metres for each radian between bearing and yaw."""
    to = F.atan2(dy, dx)
    size = clamp(gain * wrap_to_pi(to - yaw), -cap, cap)
    return -F.sin(to) * size, F.cos(to) * size


def frustum_wedge(x: Column, y: Column, yaw: Column, hfov_deg: Column, length: float) -> Column:
    """The triangle a camera sees on the ground plane: an array of three points, the camera first."""
    corner = lambda a: F.struct((x + length * F.cos(a)).alias("x"), (y + length * F.sin(a)).alias("y"))
    half = F.radians(hfov_deg) / 2.0
    return F.array(F.struct(x.alias("x"), y.alias("y")), corner(yaw - half), corner(yaw + half))


def box_corners(x: Column, y: Column, ground: Column, heading: Column, length: float = 4.6, width: float = 2.0, height: float = 1.6) -> Column:
    """The eight corners of a car-sized box on the ground: ahead before behind, left before right, low before high."""
    c, s = F.cos(heading), F.sin(heading)
    corner = lambda a, b, h: F.struct((x + a * c - b * s).alias("x"), (y + a * s + b * c).alias("y"), (ground + h).alias("z"))
    return F.array(*[corner(a * length / 2, b * width / 2, h) for a in (1, -1) for b in (1, -1) for h in (0.0, height)])


def valid_pose(x: Column, y: Column, z: Column, qw: Column, qx: Column, qy: Column, qz: Column) -> Column:
    """Whether all seven numbers are finite and the pose isn't exactly the identity, which stands for a missing object."""
    parts = (x, y, z, qw, qx, qy, qz)
    known = F.lit(True)
    for c in parts:
        known = known & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    origin = (F.abs(x) < 1e-6) & (F.abs(y) < 1e-6) & (F.abs(z) < 1e-6) & (F.abs(qw - 1.0) < 1e-6)
    return known & ~F.coalesce(origin, F.lit(False))


def intrinsics(text: Column, scale: float = 1.0) -> Column:
    """struct<w, h, fx, fy, cx, cy> of a camera line "id PINHOLE w h fx fy cx cy", scaled; null if it isn't one. Sizes in
    pixels are rounded half to even."""
    part = F.split(F.trim(text), r"\s+")
    number = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double") * scale
    values = [F.bround(number(3), 0).cast("int").alias("w"), F.bround(number(4), 0).cast("int").alias("h"), *[number(i).alias(n) for i, n in ((5, "fx"), (6, "fy"), (7, "cx"), (8, "cy"))]]
    return F.when((F.size(part) >= 8) & number(8).isNotNull(), F.struct(*values))


Matrix = list[list[Column]]


def product(a: Matrix, b: Matrix) -> Matrix:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]


def turned(m: Matrix, x: list[Column], transposed: bool = False) -> list[Column]:
    return [sum((m[j][i] if transposed else m[i][j]) * x[j] for j in range(3)) for i in range(3)]


def extrinsics(yaw_deg: Column, pitch_deg: Column, roll_deg: Column) -> Matrix:
    """World-to-camera rotation: roll, then yaw (turned over), then pitch, then the axes of an image (right, down, ahead)."""
    one, none = F.lit(1.0), F.lit(0.0)
    (cy, sy), (cp, sp), (cr, sr) = ((F.cos(F.radians(a)), F.sin(F.radians(a))) for a in (-yaw_deg, pitch_deg, roll_deg))
    pitch = [[cp, none, sp], [none, one, none], [-sp, none, cp]]
    yaw = [[cy, -sy, none], [sy, cy, none], [none, none, one]]
    roll = [[one, none, none], [none, cr, -sr], [none, sr, cr]]
    m = product(product(pitch, yaw), roll)
    return [[-c for c in m[1]], [-c for c in m[2]], m[0]]


def packed(m: Matrix) -> Column:
    """The matrix as one array column, so that its terms are computed once a row."""
    return F.array(*[c for row in m for c in row])


def unpacked(c: Column) -> Matrix:
    return [[c[3 * i + j] for j in range(3)] for i in range(3)]


def projected(rotation: Matrix, camera: list[Column], point: list[Column], k: Column) -> tuple[Column, Column, Column, Column]:
    """u, v, depth, valid of a world point: -1 for pixels at or behind the camera plane; valid lies in the image."""
    x, y, z = turned(rotation, [p - c for p, c in zip(point, camera)])
    ahead = z > 1e-6
    u, v = (F.when(ahead, k[f"f{n}"] * c / z + k[f"c{n}"]).otherwise(-1.0) for n, c in (("x", x), ("y", y)))
    return u, v, z, ahead & (u >= 0) & (u < k["w"]) & (v >= 0) & (v < k["h"])


def ground_point(rotation: Matrix, camera: list[Column], u: Column, v: Column, k: Column, ground: Column) -> tuple[Column, Column]:
    """x, y where a pixel's ray meets the plane z = ground; null if it is parallel to it or leads away from it."""
    ray = turned(rotation, [(u - k["cx"]) / k["fx"], (v - k["cy"]) / k["fy"], F.lit(1.0)], transposed=True)
    t = F.when(F.abs(ray[2]) > 1e-9, (ground - camera[2]) / ray[2])
    return tuple(F.when(t > 0, camera[i] + t * ray[i]) for i in (0, 1))


def camera_frame(dx: Column, dy: Column, dz: Column, yaw: Column, pitch_deg: Column, forward: Column, down: Column) -> tuple[Column, Column, Column]:
    """Offset in NED to camera axes (depth, right, below), for a camera mounted ahead of and below the body."""
    c, s = F.cos(yaw), F.sin(yaw)
    f = c * dx + s * dy - forward
    r = -s * dx + c * dy
    d = dz - down
    cp, sp = F.cos(F.radians(pitch_deg)), F.sin(F.radians(pitch_deg))
    return cp * f + sp * d, r, -sp * f + cp * d


def pixel(depth: Column, right: Column, below: Column, hfov_deg: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Pinhole projection; null at or behind the camera plane."""
    focal = (width / 2.0) / F.tan(F.radians(hfov_deg) / 2.0)
    ahead = depth > 1e-3
    return F.when(ahead, width / 2.0 + focal * right / depth), F.when(ahead, height / 2.0 + focal * below / depth)


def in_view(bearing_off: Column, half_fov: Column) -> Column:
    return F.abs(wrap_to_pi(bearing_off)) <= half_fov


def visibility_score(visible: Column, off: Column, half: Column) -> Column:
    """0 unseen, 1 in the centre or where the bearing is unknown, down to 0.1 at the edge of the view."""
    graded = 0.1 + 0.9 * F.greatest(F.lit(0.0), 1.0 - F.abs(off) / half)
    return F.when(~visible, 0.0).when(off.isNull() | half.isNull(), 1.0).otherwise(graded)
