"""Scalar column functions: bits of labels, numbers, colours, strings and map projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- labels: 16 bits of class below 16 bits of instance


def semantic(label: Column) -> Column:
    return label.bitwiseAND(F.lit(0xFFFF))


def instance(label: Column) -> Column:
    return F.shiftright(label, 16).bitwiseAND(F.lit(0xFFFF))


def pack(sem: Column, inst: Column) -> Column:
    return F.shiftleft(inst.cast("bigint"), 16).bitwiseOR(sem.cast("bigint"))


#: Classes above this move.
STATIC_MOST = 200


def is_moving(label: Column) -> Column:
    return semantic(label) > STATIC_MOST


# ---- numbers


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, v))


def lerp(t: Column, a: Column, b: Column) -> Column:
    return (F.lit(1.0) - t) * a + t * b


def modulo(a: Column, b: Column) -> Column:
    """The remainder that has the sign of b."""
    return F.pmod(a, b)


def round_half_up(v: Column) -> Column:
    return F.floor(v + F.lit(0.5)).cast("bigint")


def is_power_of_two(v: Column) -> Column:
    return (v > 0) & (v.bitwiseAND(v - 1) == 0)


def next_power_of_two(v: Column) -> Column:
    """The smallest power of two that is not below v (v >= 1)."""
    x = v - 1
    for shift in (1, 2, 4, 8, 16):
        x = x.bitwiseOR(F.shiftright(x, shift))
    return x + 1


def truncate(v: Column) -> Column:
    """Toward zero."""
    return v.cast("int")


# ---- strings


def split_nonempty(text: Column, separator: str) -> Column:
    return F.filter(F.split(text, separator), lambda x: x != "")


def zero_pad(number: Column, digits: int = 6) -> Column:
    """At least so many digits; longer numbers stay whole."""
    s = number.cast("string")
    return F.when(F.length(s) >= digits, s).otherwise(F.lpad(s, digits, "0"))


def clock(seconds: Column) -> Column:
    """hh:mm:ss of whole seconds."""
    two = lambda v: zero_pad(v.cast("bigint"), 2)
    return F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.floor(seconds / 60) % 60), two(seconds % 60))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


# ---- map projection

EARTH_RADIUS = 6378137.0


def mercator(lat: Column, lon: Column, scale: Column) -> tuple[Column, Column]:
    """Metres east and north at the given scale (the cosine of the first latitude)."""
    x = scale * lon * F.lit(math.pi * EARTH_RADIUS / 180)
    y = scale * F.lit(EARTH_RADIUS) * F.ln(F.tan((lat + F.lit(90.0)) * F.lit(math.pi / 360)))
    return x, y


# ---- colours


def hsi_to_rgb(h: Column, s: Column, i: Column) -> tuple[Column, Column, Column]:
    """Hue in radians, saturation and intensity in [0, 1]; the sectors are thirds of the circle."""
    third = 2 * math.pi / 3
    low = i * (F.lit(1.0) - s)

    def peak(angle: Column) -> Column:
        return i * (F.lit(1.0) + s * F.cos(angle) / F.cos(F.lit(math.pi / 3) - angle))

    first, second, last = h, h - F.lit(third), h - F.lit(2 * third)
    fill = lambda p, o: F.lit(3.0) * i - (p + o)
    p1, p2, p3 = peak(first), peak(second), peak(last)
    in1, in2 = h < F.lit(third), h < F.lit(2 * third)
    r = F.when(in1, p1).when(in2, low).otherwise(fill(p3, low))
    g = F.when(in1, fill(p1, low)).when(in2, p2).otherwise(low)
    b = F.when(in1, low).when(in2, fill(p2, low)).otherwise(p3)
    one = F.lit(1.0)
    return tuple(F.greatest(F.lit(0.0), F.least(one, c)) for c in (r, g, b))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """All in [0, 1]; grey has hue 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    sixth = F.when(d == 0, F.lit(0.0)).when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, (b - r) / d + 2.0).otherwise((r - g) / d + 4.0)
    return sixth / 6.0, F.when(top == 0, F.lit(0.0)).otherwise(d / top), top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    def channel(shift: float) -> Column:
        k = F.pmod(h * 6.0 + F.lit(shift), F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, F.lit(4.0) - k, F.lit(1.0)))

    return channel(5.0), channel(3.0), channel(1.0)


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    """Channels in [0, 1] as one number, red lowest."""
    byte = lambda c: F.floor(clamp(c, F.lit(0.0), F.lit(1.0)) * 255 + F.lit(0.5)).cast("int")
    return byte(r).bitwiseOR(F.shiftleft(byte(g), 8)).bitwiseOR(F.shiftleft(byte(b), 16))


def unpack_rgb(n: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(n, s).bitwiseAND(F.lit(255)) / F.lit(255.0) for s in (0, 8, 16))


def ramp(v: Column, stops: tuple[tuple[float, float, float], ...], last: int) -> tuple[Column, Column, Column]:
    """A colour ramp over evenly spaced stops that runs one stop behind v.

    In the k-th of the even parts of [0, 1] (at most the last) the colour goes
    from stop k - 1 to stop k; in the first it stays at the first stop.
    """
    t = clamp(v, F.lit(0.0), F.lit(1.0)) * (len(stops) - 1)
    k = F.least(F.floor(t).cast("int"), F.lit(last))
    way = t - k
    at = lambda c, i: F.get(F.array(*[F.lit(float(x[c])) for x in stops]), i)
    return tuple(at(c, F.greatest(k - 1, F.lit(0))) * (F.lit(1.0) - way) + at(c, k) * way for c in range(3))


# The stops of the colour ramps.
MAGMA = (
    (0.001462, 0.000466, 0.013866),
    (0.316654, 0.07169, 0.48538),
    (0.716387, 0.214982, 0.47529),
    (0.9867, 0.535582, 0.38221),
    (0.987053, 0.991438, 0.749504),
)
VIRIDIS = (
    (0.267004, 0.004874, 0.329415),
    (0.229739, 0.322361, 0.545706),
    (0.127568, 0.566949, 0.550556),
    (0.369214, 0.788888, 0.382914),
    (0.993248, 0.906157, 0.143936),
)
JET = (
    (0.0, 0.0, 0.5),
    (0.0, 0.0, 0.945632798573975),
    (0.0, 0.3, 1.0),
    (0.0, 0.692156862745098, 1.0),
    (0.16129032258064513, 1.0, 0.8064516129032259),
    (0.4901960784313725, 1.0, 0.4775458570524984),
    (0.8064516129032256, 1.0, 0.16129032258064513),
    (1.0, 0.7705156136528688, 0.0),
    (1.0, 0.40740740740740755, 0.0),
    (0.9456327985739753, 0.029774872912127992, 0.0),
)


def magma(v: Column) -> tuple[Column, Column, Column]:
    return ramp(v, MAGMA, 3)


def viridis(v: Column) -> tuple[Column, Column, Column]:
    return ramp(v, VIRIDIS, 3)


def jet(v: Column) -> tuple[Column, Column, Column]:
    return ramp(v, JET, 9)


def label_colour(label: Column) -> tuple[Column, Column, Column]:
    """A colour in bytes for a label, the same in every run: black for 0; up to 1024 without bright greens."""
    byte = lambda seed, n: F.pmod(F.xxhash64(label.cast("long"), F.lit(seed)), F.lit(n)).cast("int")
    black = lambda c: F.when(label == 0, F.lit(0)).otherwise(c)
    return black(byte(1, 256)), black(F.when(label <= 1024, byte(2, 180)).otherwise(byte(2, 256))), black(byte(3, 256))


def gamma(v: Column, g: float) -> Column:
    return F.pow(v, F.lit(1.0 / g))
