"""Scene geometry as columns: no Python runs per row, so every plan stays in generated code.

World frame: z up, right is +x, front is +y. Camera frame: x right, y down, z forward.
Poses are camera to world, 16 numbers row by row. Lengths are metres, sizes centimetres.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The eight compass labels, counter-clockwise from the right.
DIR8 = ("right", "front-right", "front", "front-left", "left", "back-left", "back", "back-right")
NEAR_M, MEDIUM_M = 1.0, 2.5
SAME_DEPTH_M = 0.15
SAME_VISIBILITY = 0.05
SAME_LEVEL_M = 0.15
STRAIGHT = 0.3
VERTICAL_SHARE = 0.5
MOTION_DEGREES = 8.0
IMAGE = (640.0, 480.0)

Vector = Sequence[Column]


def col3(prefix: str, names: str = "xyz") -> list[Column]:
    return [F.col(f"{prefix}{n}") for n in names]


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded, and without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def tidy_fast(c: Column, digits: int = 6) -> Column:
    """`tidy` in arithmetic on doubles, halves away from zero, for rows so many that decimals would take most of the time."""
    scaled, unit = c * F.lit(10.0**digits), F.lit(10.0**digits)
    whole = F.rint(scaled)
    whole = F.when(F.abs(scaled - whole) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(whole)
    # From 2^52 on, doubles have no halves; nothing is left to round but by decimals.
    return F.when(F.abs(scaled) < 2.0**52, whole / unit).otherwise(F.round(c, digits)) + F.lit(0.0)


def dot(a: Vector, b: Vector) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def minus(a: Vector, b: Vector) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def euclid(a: Vector, b: Vector) -> Column:
    return norm(minus(a, b))


def point_box_distance(p: Vector, low: Vector, high: Vector, centre: Vector) -> Column:
    """Distance to the nearest point of a box, or to the centre where the box is missing."""
    near = [F.greatest(lo, F.least(x, hi)) for x, lo, hi in zip(p, low, high, strict=True)]
    known = low[0].isNotNull() & high[0].isNotNull()
    return F.when(known, euclid(p, near)).otherwise(euclid(p, centre))


def distance_bucket(d: Column) -> Column:
    return F.when(d < NEAR_M, "near").when(d < MEDIUM_M, "medium").otherwise("far")


def dir8(x: Column, y: Column) -> Column:
    """The compass label of a horizontal vector; each label spans 45 degrees around its axis."""
    degrees = F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))
    sector = (F.floor((degrees + 22.5) / 45.0) % 8).cast("int")
    return F.element_at(F.array(*[F.lit(s) for s in DIR8]), sector + 1)


def dir4(x: Column, y: Column) -> Column:
    return F.when(F.abs(x) > F.abs(y), F.when(x > 0, "right").otherwise("left")).otherwise(F.when(y > 0, "front").otherwise("back"))


def dir6(x: Column, y: Column, z: Column) -> Column:
    """The dominant signed axis of a camera-frame vector; of equal ones x comes first, then z."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    return (
        F.when((ax >= ay) & (ax >= az), F.when(x > 0, "right").otherwise("left"))
        .when(az >= ay, F.when(z > 0, "front").otherwise("back"))
        .otherwise(F.when(y < 0, "up").otherwise("down"))
    )


def detailed_direction(x: Column, y: Column, z: Column) -> Column:
    """dir8, with up or down where the height outweighs half the horizontal part."""
    flat = F.sqrt(x * x + y * y)
    return F.when(F.abs(z) > VERTICAL_SHARE * flat, F.when(z > 0, "up").otherwise("down")).otherwise(dir8(x, y))


def single_direction(right: Column, front: Column, up: Column) -> Column:
    """dir8, or up-/down- with the dominant axis, or up, down and overlap over one spot."""
    flat = F.sqrt(right * right + front * front)
    height = F.when(up > 0, "up").otherwise("down")
    axis = F.when(F.abs(right) >= F.abs(front), F.when(right > 0, "right").otherwise("left")).otherwise(F.when(front > 0, "front").otherwise("back"))
    return (
        F.when(flat < 1e-8, F.when(F.abs(up) < 1e-8, "overlap").otherwise(height))
        .when(F.abs(up) > VERTICAL_SHARE * flat, F.concat_ws("-", height, axis))
        .otherwise(dir8(right, front))
    )


def relative_direction(stand: Vector, face: Vector, query: Vector) -> Column:
    """Where `query` lies for someone at `stand` who faces `face`."""
    f, q = minus(face, stand), minus(query, stand)
    fn, qn = norm(f) + 1e-8, norm(q) + 1e-8
    fx, fy, qx, qy = f[0] / fn, f[1] / fn, q[0] / qn, q[1] / qn
    ahead, right = fx * qx + fy * qy, fy * qx - fx * qy
    side = F.when(right > 0, "right").otherwise("left")
    way = F.when(ahead > 0, "front").otherwise("back")
    return F.when(F.abs(ahead) < STRAIGHT, side).when(F.abs(right) < STRAIGHT, way).otherwise(F.concat_ws("-", way, side))


def coarse_direction(label: Column, difficulty: str) -> Column:
    """easy knows left, and right for all else; medium names one axis, front first; hard keeps the label."""
    if difficulty == "easy":
        return F.when(label.contains("left"), "left").otherwise("right")
    if difficulty == "medium":
        first = [F.when(label.contains(way), way) for way in ("front", "left", "right")]
        return F.coalesce(*first, F.lit("back"))
    return label


def depth_order(z1: Column, z2: Column, label1: Column, label2: Column, same: float = SAME_DEPTH_M) -> Column:
    return F.when(F.abs(z1 - z2) <= same, "same").when(z1 < z2, label1).otherwise(label2)


def area_ratio(box: Sequence[Column], image: tuple[float, float] = IMAGE) -> Column:
    w, h = F.greatest(F.lit(0.0), box[2] - box[0]), F.greatest(F.lit(0.0), box[3] - box[1])
    return w * h / max(1.0, image[0] * image[1])


def visibility_score(visibility: Column, ratio: Column, occluded: Column, truncated: Column) -> Column:
    return 0.75 * visibility + 0.25 * ratio - 0.03 * occluded.cast("int") - 0.02 * truncated.cast("int")


def compare_visibility(s1: Column, s2: Column, n1: Column, n2: Column, same: float = SAME_VISIBILITY) -> Column:
    """image1, image2, same or neither; null where a label is not unique in an image."""
    return (
        F.when((n1 > 1) | (n2 > 1), F.lit(None))
        .when((n1 == 0) & (n2 == 0), "neither")
        .when(n1 == 0, "image2")
        .when(n2 == 0, "image1")
        .when(F.abs(s1 - s2) <= same, "same")
        .when(s1 > s2, "image1")
        .otherwise("image2")
    )


def elevation(z1: Column, z2: Column, same: float = SAME_LEVEL_M) -> Column:
    """How the second camera stands to the first."""
    return F.when(F.abs(z2 - z1) <= same, "same_level").when(z2 > z1, "higher").otherwise("lower")


def rotation(ax: Column, ay: Column, az: Column) -> list[Column]:
    """Nine numbers of the rotation by an angle-axis vector; the identity for a vector of no length."""
    theta = F.sqrt(ax * ax + ay * ay + az * az)
    still = theta < 1e-12
    safe = F.when(still, F.lit(1.0)).otherwise(theta)
    x, y, z = ax / safe, ay / safe, az / safe
    s, c = F.sin(theta), F.cos(theta)
    v = 1 - c
    full = [c + x * x * v, x * y * v - z * s, x * z * v + y * s, y * x * v + z * s, c + y * y * v, y * z * v - x * s, z * x * v - y * s, z * y * v + x * s, c + z * z * v]
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    return [F.when(still, F.lit(e)).otherwise(m) for e, m in zip(eye, full, strict=True)]


def to_camera(p: Vector, r: Vector, t: Vector) -> list[Column]:
    """A world point in a camera's frame: the transposed rotation of p - t."""
    d = minus(p, t)
    return [r[i] * d[0] + r[3 + i] * d[1] + r[6 + i] * d[2] for i in range(3)]


def to_world(p: Vector, r: Vector, t: Vector) -> list[Column]:
    return [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] + t[i] for i in range(3)]


def matrix_product(a: Vector, b: Vector) -> list[Column]:
    """Product of two 4x4 matrices of 16 columns each."""
    return [dot([a[4 * i + k] for k in range(4)], [b[4 * k + j] for k in range(4)]) for i in range(4) for j in range(4)]


def relative_rotation(r2: Vector, r1: Vector) -> list[Column]:
    """r2 times the transpose of r1."""
    return [dot([r2[3 * i + k] for k in range(3)], [r1[3 * j + k] for k in range(3)]) for i in range(3) for j in range(3)]


def signed_yaw(f1x: Column, f1z: Column, f2x: Column, f2z: Column) -> Column:
    """Degrees from one forward vector to the next in the (x, z) plane; 0 where one vanishes."""
    n1, n2 = F.sqrt(f1x * f1x + f1z * f1z), F.sqrt(f2x * f2x + f2z * f2z)
    ax, az, bx, bz = f1x / n1, f1z / n1, f2x / n2, f2z / n2
    turn = F.degrees(F.atan2(ax * bz - az * bx, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ax * bx + az * bz))))
    return F.when((n1 < 1e-8) | (n2 < 1e-8), 0.0).otherwise(turn)


def motion(yaw: Column, x: Column, y: Column, z: Column) -> Column:
    """A camera's motion: a turn of 8 degrees or more, else its strongest axis, two where the second is strong.

    Of equal axes the lateral one is stronger, then depth; two are named in that order.
    """
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    most, length = F.greatest(ax, ay, az), F.sqrt(x * x + y * y + z * z)
    second = F.greatest(F.least(ax, ay), F.least(F.greatest(ax, ay), az))
    strong = (second >= 1e-8) & (second / most >= 0.35) & (second / length >= 0.25)
    across, along, height = (x > 0, "right", "left"), (z > 0, "front", "back"), (y < 0, "up", "down")

    def both(one: tuple, two: tuple) -> Column:
        named = [F.when(two[0], f"{way}-{two[1]}").otherwise(f"{way}-{two[2]}") for way in one[1:]]
        return F.when(one[0], named[0]).otherwise(named[1])

    pair = F.when((ay <= ax) & (ay <= az), both(across, along)).when((az <= ax) & (az < ay), both(across, height)).otherwise(both(along, height))
    moved = F.when(most < 1e-8, "same").when(strong, pair).otherwise(dir6(x, y, z))
    return F.when(F.abs(yaw) >= MOTION_DEGREES, F.when(yaw > 0, "left").otherwise("right")).otherwise(moved)


def box_corners(c: Vector, half: Vector) -> Column:
    """The eight corners of an axis-aligned box as an array of structs."""
    corners = [F.struct(*[(c[i] + s[i] * half[i]).alias("xyz"[i]) for i in range(3)]) for s in [(a, b, d) for a in (-1, 1) for b in (-1, 1) for d in (-1, 1)]]
    return F.array(*corners)


def project(p: Vector, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """Pixel of a camera-frame point, null behind the camera."""
    ahead = p[2] > 0
    return F.when(ahead, fx * p[0] / p[2] + cx), F.when(ahead, fy * p[1] / p[2] + cy)


def back_project(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    return [(u - cx) * depth / fx, (v - cy) * depth / fy, depth]


def occluded(z: Column, depth: Column) -> Column:
    return (z - depth) / (depth + 1e-6) > 0.001


def sky_direction(right: Column, down: Column) -> Column:
    """Which side of the image the world's up is on, from how its right and down lean upward; the first of equals."""
    lean = F.greatest(-down, -right, down, right)
    return F.when(-down == lean, "Up").when(-right == lean, "Left").when(down == lean, "Down").otherwise("Right")


def vector_between(camera_a: Column, camera_b: Column, world_a: Column, world_b: Column) -> tuple[list[Column], Column]:
    """From a to b in the camera's frame where both have three finite numbers there, else in the world's; and which of the two."""
    finite = lambda c: F.coalesce((F.size(c) >= 3) & ~F.exists(F.slice(c, 1, 3), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    seen = finite(camera_a) & finite(camera_b)
    at = lambda c, i: F.get(c, F.lit(i))
    d = [F.when(seen, at(camera_b, i) - at(camera_a, i)).otherwise(at(world_b, i) - at(world_a, i)) for i in range(3)]
    return d, F.when(seen, "camera").otherwise("world")


def dimensions(box: Column, size: Column) -> Column:
    """An object's three sides: of its box of six numbers, else its size, else 1 each."""
    of_box = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.abs(F.get(box, i + 3) - F.get(box, i)))
    return F.when(F.size(box) == 6, of_box).when(F.size(size) >= 3, F.slice(size, 1, 3)).otherwise(F.array(*[F.lit(1.0)] * 3))


def turned_intrinsics(sky: Column, width: Column, height: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> dict[str, Column]:
    """A camera's numbers after the turn, by quarters, that brings the sky up."""
    side = sky.isin("Left", "Right")
    swap = lambda a, b: F.when(side, b).otherwise(a)
    return {
        "width": swap(width, height),
        "height": swap(height, width),
        "fx": swap(fx, fy),
        "fy": swap(fy, fx),
        "cx": F.when(sky == "Left", height - 1 - cy).when(sky == "Down", width - 1 - cx).when(sky == "Right", cy).otherwise(cx),
        "cy": F.when(sky == "Left", cx).when(sky == "Down", height - 1 - cy).when(sky == "Right", width - 1 - cx).otherwise(cy),
    }


def turned_rotation(sky: Column, r: Vector) -> list[Column]:
    """The rotation of a pose after the same turn: its first two columns change places and signs."""
    out = []
    for i in range(3):
        a, b, c = r[3 * i], r[3 * i + 1], r[3 * i + 2]
        out += [F.when(sky == "Left", -b).when(sky == "Down", -a).when(sky == "Right", b).otherwise(a), F.when(sky == "Left", a).when(sky == "Down", -b).when(sky == "Right", -a).otherwise(b), c]
    return out


def surface_points(size: Vector, steps: int) -> Column:
    """Points of an even grid on the six faces of a box around the origin, to six digits, each once."""
    steps = max(2, steps)
    at = lambda s: F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct(F.round(s / 2 * (i * 2.0 / (steps - 1) - 1), 6).alias("v"), ((i == 0) | (i == steps - 1)).alias("edge")))
    cells = F.flatten(F.transform(at(size[0]), lambda x: F.flatten(F.transform(at(size[1]), lambda y: F.transform(at(size[2]), lambda z: F.struct(x["v"].alias("x"), y["v"].alias("y"), z["v"].alias("z"), (x["edge"] | y["edge"] | z["edge"]).alias("on")))))))
    return F.array_distinct(F.transform(F.filter(cells, lambda p: p["on"]), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))))
