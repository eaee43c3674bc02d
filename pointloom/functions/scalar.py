"""Column expressions: opacity and scale spaces, colour, rotations, projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the constant of the first spherical-harmonics band.
SH_C0 = 0.28209479177387814
GOLDEN_ANGLE = 137.508


def sigmoid(c: Column) -> Column:
    """The logistic function; the argument is clipped to ±50."""
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), c))))


def logit(p: Column, guard: float = 1e-8) -> Column:
    return F.ln(p / (1.0 - p + guard))


def to_log_scale(s: Column, guard: float = 1e-8) -> Column:
    return F.ln(F.abs(s) + guard)


def from_log_scale(s: Column) -> Column:
    return F.exp(s)


def rgb_to_sh(c: Column) -> Column:
    return (c - 0.5) / SH_C0


def sh_to_rgb(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c * SH_C0 + 0.5))


def rotation_matrix(degrees: tuple[float, float, float]) -> list[list[float]]:
    """Extrinsic x, y, z rotations: R = Rz Ry Rx. Computed once, on the driver."""
    (a, b, c) = map(math.radians, degrees)
    sa, ca, sb, cb, sc, cc = math.sin(a), math.cos(a), math.sin(b), math.cos(b), math.sin(c), math.cos(c)
    return [
        [cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa],
        [sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa],
        [-sb, cb * sa, cb * ca],
    ]


def rotation_quaternion(degrees: tuple[float, float, float]) -> tuple[float, float, float, float]:
    """(w, x, y, z) of the same rotation."""
    (a, b, c) = (math.radians(d) / 2 for d in degrees)
    sa, ca, sb, cb, sc, cc = math.sin(a), math.cos(a), math.sin(b), math.cos(b), math.sin(c), math.cos(c)
    return (cc * cb * ca + sc * sb * sa, cc * cb * sa - sc * sb * ca, cc * sb * ca + sc * cb * sa, sc * cb * ca - cc * sb * sa)


def applied(matrix: list[list[float]], xyz: tuple[Column, Column, Column]) -> list[Column]:
    return [sum((xyz[k] * row[k] for k in (1, 2)), xyz[0] * row[0]) for row in matrix]


def composed(q: tuple[float, float, float, float], r: tuple[Column, Column, Column, Column]) -> list[Column]:
    """The normalised product q·r of quaternions, w first."""
    w, x, y, z = q
    rw, rx, ry, rz = r
    out = [rw * w - rx * x - ry * y - rz * z, rx * w + rw * x + rz * y - ry * z, ry * w - rz * x + rw * y + rx * z, rz * w + ry * x - rx * y + rw * z]
    norm = F.sqrt(out[0] * out[0] + out[1] * out[1] + out[2] * out[2] + out[3] * out[3])
    return [F.when(norm > 0, c / norm).otherwise(c) for c in out]


def camera_space(xyz: tuple[Column, Column, Column], r: dict[str, Column], t: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """World to camera for a camera-to-world pose with rotation r['ij'] and translation t."""
    d = [xyz[k] - t[k] for k in range(3)]
    return tuple(r[f"0{j}"] * d[0] + r[f"1{j}"] * d[1] + r[f"2{j}"] * d[2] for j in range(3))


def world_space(cam: tuple[Column, Column, Column], r: dict[str, Column], t: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return tuple(r[f"{i}0"] * cam[0] + r[f"{i}1"] * cam[1] + r[f"{i}2"] * cam[2] + t[i] for i in range(3))


def pinhole(x: Column, y: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    return fx * x / z + cx, fy * y / z + cy


def quaternion_of(m: dict[str, Column]) -> list[Column]:
    """(w, x, y, z) of a rotation matrix, by the largest of trace and diagonal."""
    r = lambda i, j: m[f"{i}{j}"]
    trace = r(0, 0) + r(1, 1) + r(2, 2)
    s0 = F.sqrt(trace + 1.0) * 2.0
    forms = [(s0 / 4.0, (r(2, 1) - r(1, 2)) / s0, (r(0, 2) - r(2, 0)) / s0, (r(1, 0) - r(0, 1)) / s0)]
    for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        s = F.sqrt(1.0 + r(i, i) - r(j, j) - r(k, k)) * 2.0
        v = {0: (r(k, j) - r(j, k)) / s, 1 + i: s / 4.0, 1 + j: (r(j, i) + r(i, j)) / s, 1 + k: (r(k, i) + r(i, k)) / s}
        forms.append((v[0], v[1], v[2], v[3]))
    first = trace > 0
    second = (r(0, 0) > r(1, 1)) & (r(0, 0) > r(2, 2))
    return [F.when(first, forms[0][c]).when(second, forms[1][c]).when(r(1, 1) > r(2, 2), forms[2][c]).otherwise(forms[3][c]) for c in range(4)]


def palette(i: Column, chroma: float = 200.0, lift: int = 55) -> list[Column]:
    """(r, g, b) of the i-th colour: hues a golden angle apart, lifted towards white.

    Each channel is the same ramp of the hue (in sixths of the circle), turned by a third of the circle.
    """
    h = ((i * GOLDEN_ANGLE) % 360.0) / 60.0

    def channel(turn: int) -> Column:
        k = (h + float(turn)) % 6.0
        fall = F.greatest(F.lit(0.0), F.least(F.lit(1.0), k, 4.0 - k))
        return (F.floor(F.round(chroma * (1.0 - fall), 9)).cast("int") + lift).cast("int")

    return [channel(turn) for turn in (5, 3, 1)]


def inverse(m: list[list[Column]]) -> list[list[Column]]:
    """The inverse of a 4 x 4 matrix: cofactors over the determinant; null where it is singular.

    The 2 x 2 minors of the upper and the lower two rows give both, so nothing is expanded twice.
    """
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    minors = lambda a, b: {p: m[a][p[0]] * m[b][p[1]] - m[a][p[1]] * m[b][p[0]] for p in pairs}
    upper, lower = minors(0, 1), minors(2, 3)
    rest = lambda *gone: tuple(k for k in range(4) if k not in gone)
    sign = {p: (-1) ** (p[0] + p[1] + 1) for p in pairs}
    det = sum((upper[p] * lower[rest(*p)] * float(sign[p]) for p in pairs[1:]), upper[pairs[0]] * lower[rest(*pairs[0])] * float(sign[pairs[0]]))

    def cofactor(i: int, j: int) -> Column:
        """Of row i and column j: the other row of its half times the minors of the other half."""
        other, half = i ^ 1, lower if i < 2 else upper
        a, b, c = rest(j)
        minor = m[other][a] * half[b, c] - m[other][b] * half[a, c] + m[other][c] * half[a, b]
        return minor if (i + j) % 2 == 0 else -minor

    known = F.when(det != 0, det)
    return [[cofactor(j, i) / known for j in range(4)] for i in range(4)]
