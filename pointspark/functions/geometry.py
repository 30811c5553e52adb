"""Column expressions on vectors, matrices and boxes.

A rigid transform is twelve scalar columns, row by row, so that applying one is
plain arithmetic inside generated code. Names: {prefix}00 .. {prefix}23.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROWS = range(3)
COLS = range(4)


def names(prefix: str) -> list[str]:
    return [f"{prefix}{i}{j}" for i in ROWS for j in COLS]


def columns(prefix: str) -> list[Column]:
    return [F.col(n) for n in names(prefix)]


def from_array(m: str | Column, prefix: str) -> list[Column]:
    """Twelve named columns from a row-major array of 12 or 16."""
    m = F.col(m) if isinstance(m, str) else m
    return [F.get(m, 4 * i + j).alias(f"{prefix}{i}{j}") for i in ROWS for j in COLS]


def identity() -> list[Column]:
    return [F.lit(1.0 if i == j else 0.0) for i in ROWS for j in COLS]


def apply(m: list[Column], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """m . (x, y, z, 1)."""
    return tuple(m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3] for i in ROWS)


def multiply(a: list[Column], b: list[Column]) -> list[Column]:
    """a . b, both rigid."""
    out = []
    for i in ROWS:
        for j in COLS:
            v = a[4 * i] * b[j] + a[4 * i + 1] * b[4 + j] + a[4 * i + 2] * b[8 + j]
            out.append(v + a[4 * i + 3] if j == 3 else v)
    return out


def invert(m: list[Column]) -> list[Column]:
    """The inverse of a rigid transform: transposed rotation, and what that makes of the shift."""
    out = []
    for i in ROWS:
        shift = -(m[i] * m[3] + m[4 + i] * m[7] + m[8 + i] * m[11])
        out += [m[i], m[4 + i], m[8 + i], shift]
    return out


def determinant(m: list[Column]) -> Column:
    a, b, c, d, e, f, g, h, i = (m[4 * r + k] for r in ROWS for k in ROWS)
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def affine_inverse(m: list[Column]) -> list[Column]:
    """The inverse of any affine transform by cofactors; null where it is singular."""
    a, b, c, d, e, f, g, h, i = (m[4 * r + k] for r in ROWS for k in ROWS)
    det = determinant(m)
    cof = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    inv = [F.try_divide(v, det) for v in cof]
    out = []
    for r in ROWS:
        row = inv[3 * r : 3 * r + 3]
        out += [*row, -(row[0] * m[3] + row[1] * m[7] + row[2] * m[11])]
    return out


def rotation_angle(m: list[Column]) -> Column:
    """The angle of a rotation, from its trace."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0] + m[5] + m[10] - F.lit(1.0)) / F.lit(2.0))))


def shift_length(m: list[Column]) -> Column:
    return F.sqrt(m[3] * m[3] + m[7] * m[7] + m[11] * m[11])


def rotation(axis: str, angle: Column) -> list[Column]:
    """Rotation about x, y or z as a rigid transform without shift."""
    c, s, o, i = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    table = {"x": [i, o, o, o, c, -s, o, s, c], "y": [c, o, s, o, i, o, -s, o, c], "z": [c, -s, o, s, c, o, o, o, i]}[axis]
    return [table[3 * r + k] if k < 3 else o for r in ROWS for k in COLS]


def turn_about(axis: list[Column], angle: Column) -> list[Column]:
    """Rotation by angle about an axis of any length, which must not be zero."""
    a, c, s = normalize(axis), F.cos(angle), F.sin(angle)
    skew = {(0, 1): -a[2], (0, 2): a[1], (1, 0): a[2], (1, 2): -a[0], (2, 0): -a[1], (2, 1): a[0]}
    cell = lambda i, j: a[i] * a[j] * (F.lit(1.0) - c) + (c if i == j else skew[i, j] * s)
    return [cell(i, j) if j < 3 else F.lit(0.0) for i in ROWS for j in COLS]


def from_rotation_vector(v: list[Column]) -> list[Column]:
    """The rotation about v by its length; none for a zero vector."""
    return turn_about(v, length(v))


def rotation_vector(m: list[Column]) -> list[Column]:
    """The axis of a rotation, as long as its angle in [0, pi]."""
    half = [(m[9] - m[6]) / 2, (m[2] - m[8]) / 2, (m[4] - m[1]) / 2]
    sine, cosine = length(half), (m[0] + m[5] + m[10] - F.lit(1.0)) / 2
    angle = F.atan2(sine, cosine)
    # half a turn has no skew part: the axis then is the longest column of (m + 1) / 2
    size = [F.sqrt(F.greatest((m[5 * i] + F.lit(1.0)) / 2, F.lit(0.0))) for i in ROWS]
    longest = [(size[i] >= size[(i + 1) % 3]) & (size[i] >= size[(i + 2) % 3]) for i in ROWS]
    columns_ = [[(m[4 * j + i] + m[4 * i + j]) / 4 / size[i] if i != j else size[i] for j in ROWS] for i in ROWS]
    out = []
    for j in ROWS:
        axis = F.when(longest[0], columns_[0][j]).when(longest[1], columns_[1][j]).otherwise(columns_[2][j])
        out.append(F.when(sine > 1e-9, half[j] / sine * angle).when(cosine > 0, half[j]).otherwise(axis * angle))
    return out


def from_euler(axes: str, angles: list[Column]) -> list[Column]:
    """Turns about fixed axes one after the other: the first of axes is applied first."""
    out = rotation(axes[0], angles[0])
    for axis, angle in zip(axes[1:], angles[1:], strict=True):
        out = multiply(rotation(axis, angle), out)
    return out


def yaw_pitch_roll(yaw: Column, pitch: Column, roll: Column, shift: list[Column], roll_first: bool = True) -> list[Column]:
    """A pose by yaw about z, pitch about y and roll about x; roll is applied first, or else pitch."""
    order = ("x", roll), ("y", pitch)
    (a, first), (b, second) = order if roll_first else order[::-1]
    m = from_euler(a + b + "z", [first, second, yaw])
    return [shift[i // 4] if i % 4 == 3 else v for i, v in enumerate(m)]


def look_at(eye: list[Column], target: list[Column], up: list[Column]) -> list[Column]:
    """From the world to a camera at eye: z ahead, x to its left, y up."""
    ahead = normalize([t - e for t, e in zip(target, eye, strict=True)])
    left = normalize(cross(normalize(up), ahead))
    above = cross(ahead, left)
    return invert([v for i in ROWS for v in (left[i], above[i], ahead[i], eye[i])])


# ---- transforms of sixteen columns, row by row


def whole(m: list[Column]) -> list[Column]:
    """A rigid transform with its last row."""
    return [*m, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]


def orthographic(near: Column, far: Column) -> list[Column]:
    """Depths from near to far go to 0 to 1."""
    o, i, d = F.lit(0.0), F.lit(1.0), far - near
    return [i, o, o, o, o, i, o, o, o, o, i / d, -near / d, o, o, o, i]


def perspective(degrees: Column, near: Column, far: Column) -> list[Column]:
    """A field of view of so many degrees goes to -1 to 1, depths from near to far to 0 to 1, after the division by z."""
    o, i = F.lit(0.0), F.lit(1.0)
    wide, deep = i / F.tan(F.radians(degrees) / 2), far / (far - near)
    return [wide, o, o, o, o, wide, o, o, o, o, deep, -near * deep, o, o, i, o]


def multiply_whole(a: list[Column], b: list[Column]) -> list[Column]:
    return [dot(a[4 * i : 4 * i + 4], [b[4 * k + j] for k in range(4)]) for i in range(4) for j in range(4)]


def project(m: list[Column], x: Column, y: Column, z: Column) -> list[Column]:
    """A point through sixteen columns, divided by its last coordinate; null where that is zero."""
    point = [x, y, z, F.lit(1.0)]
    h = [dot(m[4 * i : 4 * i + 4], point) for i in range(4)]
    return [F.try_divide(v, h[3]) for v in h[:3]]


def inverse_whole(m: list[Column]) -> list[Column]:
    """The inverse by the minors of the upper and the lower two rows; null where there is none."""
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    minor = lambda r, p: m[4 * r + p[0]] * m[4 * r + 4 + p[1]] - m[4 * r + p[1]] * m[4 * r + 4 + p[0]]
    high, low = {p: minor(0, p) for p in pairs}, {p: minor(2, p) for p in pairs}
    sign = lambda p: F.lit(1.0 if sum(p) % 2 else -1.0)
    rest = lambda p: tuple(k for k in range(4) if k not in p)
    det = sum((sign(p) * high[p] * low[rest(p)] for p in pairs[1:]), sign(pairs[0]) * high[pairs[0]] * low[rest(pairs[0])])
    out = []
    for i in range(4):
        a, b, c = [k for k in range(4) if k != i]
        for j in range(4):
            # without row j and column i: the other row of its half, and a minor of the other half
            row, part = m[4 * (j ^ 1) : 4 * (j ^ 1) + 4], low if j < 2 else high
            cofactor = row[a] * part[b, c] - row[b] * part[a, c] + row[c] * part[a, b]
            out.append(F.try_divide(cofactor if (i + j) % 2 == 0 else -cofactor, det))
    return out


def solve_two(a: list[Column], b: list[Column]) -> list[Column]:
    """x of a . x = b for a of four columns, row by row; null where the determinant is below 1e-10."""
    det = a[0] * a[3] - a[1] * a[2]
    found = a[3] * b[0] - a[1] * b[1], a[0] * b[1] - a[2] * b[0]
    return [F.when(F.abs(det) >= 1e-10, v / det) for v in found]


def translation(x: Column, y: Column, z: Column) -> list[Column]:
    m = identity()
    m[3], m[7], m[11] = x, y, z
    return m


def scaling(x: Column, y: Column, z: Column) -> list[Column]:
    m = [F.lit(0.0)] * 12
    m[0], m[5], m[10] = x, y, z
    return m


def dot(a: list[Column], b: list[Column]) -> Column:
    out = a[0] * b[0]
    for p, q in zip(a[1:], b[1:], strict=True):
        out = out + p * q
    return out


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def length(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: list[Column]) -> list[Column]:
    """a at length 1; a zero vector stays zero."""
    n = length(a)
    return [F.when(n > 0, v / n).otherwise(F.lit(0.0)) for v in a]


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    d = [p - q for p, q in zip(a, b, strict=True)]
    return dot(d, d)


def box_overlap_cells(lo1: list[Column], hi1: list[Column], lo2: list[Column], hi2: list[Column]) -> Column:
    """Cells that two boxes of whole cells share, both ends included."""
    out = None
    for a, b, c, d in zip(lo1, hi1, lo2, hi2, strict=True):
        side = F.greatest(F.least(b, d) - F.greatest(a, c) + 1, F.lit(0))
        out = side if out is None else out * side
    return out


def box_iou_cells(lo1: list[Column], hi1: list[Column], lo2: list[Column], hi2: list[Column]) -> Column:
    """Intersection over union of boxes of whole cells; 1 where one holds the other."""
    inside = lambda a, b, c, d: F.when(sum_and([(x >= y) & (p <= q) for x, p, y, q in zip(a, b, c, d, strict=True)]), True).otherwise(False)
    both = box_overlap_cells(lo1, hi1, lo2, hi2)
    one, two = box_overlap_cells(lo1, hi1, lo1, hi1), box_overlap_cells(lo2, hi2, lo2, hi2)
    iou = both.cast("double") / (one + two - both).cast("double")
    return F.when(inside(lo1, hi1, lo2, hi2) | inside(lo2, hi2, lo1, hi1), F.lit(1.0)).otherwise(iou)


def box_iou(lo1: list[Column], hi1: list[Column], lo2: list[Column], hi2: list[Column]) -> Column:
    """Intersection over union of boxes with real sides."""

    def volume(lo: list[Column], hi: list[Column]) -> Column:
        out = None
        for a, b in zip(lo, hi, strict=True):
            side = F.greatest(b - a, F.lit(0.0))
            out = side if out is None else out * side
        return out

    lo = [F.greatest(a, b) for a, b in zip(lo1, lo2, strict=True)]
    hi = [F.least(a, b) for a, b in zip(hi1, hi2, strict=True)]
    both = volume(lo, hi)
    return F.coalesce(F.try_divide(both, volume(lo1, hi1) + volume(lo2, hi2) - both), F.lit(0.0))


def sum_and(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def collinear(points: str) -> Column:
    """Whether all of an array of structs (x, y) stand on the line through the first two distinct ones."""
    first = F.get(points, 0)
    other = F.get(F.filter(points, lambda p: (p["x"] != first["x"]) | (p["y"] != first["y"])), 0)
    off = lambda p: (other["x"] - first["x"]) * (p["y"] - first["y"]) != (other["y"] - first["y"]) * (p["x"] - first["x"])
    return other.isNull() | ~F.exists(points, off)


def triangulate(polygon: list[tuple[float, float]]) -> list[tuple[tuple[float, float], ...]]:
    """Triangles of a simple polygon of at least three corners, by cutting ears. Raises ValueError where none is left to cut."""
    if len(polygon) < 3:
        raise ValueError("a polygon has three corners at least")

    def turn(a, b, c) -> float:
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    ring = list(polygon)
    if sum(turn((0.0, 0.0), a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) < 0:
        ring.reverse()
    out = []
    while len(ring) > 3:
        for k in range(len(ring)):
            a, b, c = ring[k - 1], ring[k], ring[(k + 1) % len(ring)]
            area = turn(a, b, c)
            within = lambda p, a=a, b=b, c=c: turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0
            if area == 0 or area > 0 and not any(within(p) for p in ring if p not in (a, b, c)):
                if area:
                    out.append((a, b, c))
                del ring[k]
                break
        else:
            raise ValueError("the polygon crosses itself")
    if turn(*ring):
        out.append(tuple(ring))
    return out


def in_triangles(x: Column, y: Column, triangles: list[tuple[tuple[float, float], ...]]) -> Column:
    """Whether a point is strictly inside one of the triangles."""
    out = F.lit(False)
    for a, b, c in triangles:
        sides = [(q[0] - p[0], q[1] - p[1], p) for p, q in ((a, b), (b, c), (c, a))]
        inside = sum_and([F.lit(dx) * (y - F.lit(p[1])) - F.lit(dy) * (x - F.lit(p[0])) > 0 for dx, dy, p in sides])
        out = out | inside
    return out
