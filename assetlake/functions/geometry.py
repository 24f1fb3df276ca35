"""Column expressions on points, voxels and vectors; all stay inside the JVM."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class order (ties go to the earlier), analytic face types by code, colours by class.
CLASS_ORDER = ("BOUNDARY", "BSPLINE_SURFACE", "PLANE", "TORUS", "CONE", "SPHERE", "CYLINDER")
FACE_TYPES = ("PLANE", "CYLINDER", "CONE", "SPHERE", "TORUS")
DEFAULT_TYPE = "BSPLINE_SURFACE"


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def cell(p, res: int) -> Column:
    """Grid cell of a coordinate in [-1, 1]: single precision in, clipped to [0, res - 1]."""
    at = F.floor((c(p).cast("float").cast("double") + 1) / 2 * res)
    return F.least(F.greatest(at, F.lit(0)), F.lit(res - 1)).cast("int")


def flat_index(x, y, z, res: int) -> Column:
    return (cell(x, res) * (res * res) + cell(y, res) * res + cell(z, res)).cast("long")


def flat_to_coords(i, res: int) -> tuple[Column, Column, Column]:
    i = c(i)
    return (F.floor(i / (res * res)) % res).cast("int"), (F.floor(i / res) % res).cast("int"), (i % res).cast("int")


def voxel_center(v, res: int, frame: str = "signed") -> Column:
    """Middle of a cell in [-1, 1], or in [-0.5, 0.5]."""
    return (c(v) + 0.5) * 2 / res - 1 if frame == "signed" else (c(v) + 0.5) / res - 0.5


def unit_cell(p, res: int) -> Column:
    """Cell of a coordinate in [-0.5, 0.5], truncated."""
    return ((c(p) + 0.5) * res).cast("int")


def total(values) -> Column:
    return reduce(lambda a, b: a + b, values)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a, floor: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(c(a), lambda x: x / n)


def dot3(a, b) -> Column:
    """``dot`` of arrays of three, without a function call for each element; added up in the same order."""
    return total([F.lit(0.0), *[F.get(c(a), F.lit(i)).cast("double") * F.get(c(b), F.lit(i)) for i in range(3)]])


def vector_angle(a, b, floor: float = 1e-12) -> Column:
    """Degrees between two directions in space, sign ignored."""
    size = lambda v: F.greatest(F.sqrt(dot3(v, v)), F.lit(floor))
    cosine = F.abs(dot3(a, b)) / (size(a) * size(b))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine))))


def cosine(a, b, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def map_pairs(a, b, f) -> Column:
    return F.zip_with(c(a), c(b), f)


def sum_of(a) -> Column:
    return F.aggregate(c(a), F.lit(0.0), lambda s, x: s + x)


def spread_bits(v) -> Column:
    """Ten bits of ``v`` with two gaps after each."""
    v = c(v).cast("int")
    out = F.lit(0)
    for i in range(10):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v, i).bitwiseAND(1), 3 * i))
    return out


def zorder_code(x, y, z, perm: tuple[int, int, int] = (0, 1, 2)) -> Column:
    """Bits interleaved, the first axis highest; ``perm`` swaps axes."""
    axes = (x, y, z)
    a, b, d = (axes[i] for i in perm)
    return F.shiftleft(spread_bits(a), 2).bitwiseOR(F.shiftleft(spread_bits(b), 1)).bitwiseOR(spread_bits(d))


def hilbert_code(x, y, z, bits: int = 10) -> Column:
    """Position on the Hilbert curve, by Skilling's transform from the highest bit down."""
    left, right = (lambda a, k, n=n: F.call_function(n, a, k) for n in ("shiftleft", "shiftright"))
    start = F.array(*[c(v).cast("int") for v in (x, y, z)])
    high = F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1))

    def turn(state, i, k):
        """One axis at one bit: flip the first axis, or swap low bits with it."""
        low = left(F.lit(1), k) - 1
        on = right(state[i], k).bitwiseAND(1) == 1
        swap = state[0].bitwiseXOR(state[i]).bitwiseAND(low)
        first = F.when(on, state[0].bitwiseXOR(low)).otherwise(state[0].bitwiseXOR(swap))
        own = F.when(on, state[i]).otherwise(state[i].bitwiseXOR(swap))
        return F.array(first, *[own if j == i else state[j] for j in (1, 2)])

    steps = F.flatten(F.transform(high, lambda k: F.array(*[F.struct(k.alias("k"), F.lit(i).alias("i")) for i in range(3)])))
    state = F.aggregate(steps, start, lambda s, o: F.when(o["i"] == 0, turn(s, 0, o["k"])).when(o["i"] == 1, turn(s, 1, o["k"])).otherwise(turn(s, 2, o["k"])))
    gray = F.transform(F.array(state), lambda s: F.array(s[0], s[1].bitwiseXOR(s[0]), s[2].bitwiseXOR(s[1].bitwiseXOR(s[0]))))[0]
    flip = lambda g: F.aggregate(high, F.lit(0), lambda t, k: F.when(right(g[2], k).bitwiseAND(1) == 1, t.bitwiseXOR(left(F.lit(1), k) - 1)).otherwise(t))
    out = F.transform(F.array(gray), lambda g: F.transform(g, lambda a: a.bitwiseXOR(flip(g))))[0]
    spread = F.transform(out, lambda a: F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0), lambda s, k: s.bitwiseOR(left(right(a, k).bitwiseAND(1), 3 * k))))
    return F.transform(F.array(spread), lambda s: F.shiftleft(s[0], 2).bitwiseOR(F.shiftleft(s[1], 1)).bitwiseOR(s[2]))[0]


def face_type_name(code) -> Column:
    known = F.create_map(*[F.lit(v) for i, n in enumerate(FACE_TYPES) for v in (i, n)])
    return F.coalesce(known[c(code).cast("int")], F.lit(DEFAULT_TYPE))


#: Fixed colours of the classes 0 to 7, red, green and blue.
CLASS_COLORS = (
    (0.12, 0.47, 0.71), (1.00, 0.50, 0.05), (0.17, 0.63, 0.17), (0.84, 0.15, 0.16),
    (0.58, 0.40, 0.74), (0.55, 0.34, 0.29), (0.89, 0.47, 0.76), (0.50, 0.50, 0.50),
)


def class_id(name: Column, classes: list[str] | tuple[str, ...]) -> Column:
    """0-based place of a class name, -1 if it is none."""
    return F.array_position(F.array(*[F.lit(x) for x in classes]), name) - 1


def class_color(one_hot: Column) -> Column:
    """Colour of the largest of 8 channels, the first of equal ones; of 7 channels the first class is taken as missing."""
    padded = F.when(F.size(one_hot) == len(CLASS_COLORS) - 1, F.concat(F.array(F.lit(0.0)), one_hot.cast("array<double>"))).otherwise(one_hot.cast("array<double>"))
    palette = F.array(*[F.array(*[F.lit(v) for v in rgb]) for rgb in CLASS_COLORS])
    return F.get(palette, (F.array_position(padded, F.array_max(padded)) - 1).cast("int"))


def rotation_free_inverse(matrix: list[list[Column]]) -> list[list[Column]]:
    """Inverse of a rigid 4x4: transpose the rotation, rotate the shift back."""
    r = [[matrix[j][i] for j in range(3)] for i in range(3)]
    t = [-total(r[i][j] * matrix[j][3] for j in range(3)) for i in range(3)]
    return [[*r[i], t[i]] for i in range(3)]


def hammersley(i, n: int, offset: tuple[float, float] = (0.0, 0.0), remap: bool = False) -> tuple[Column, Column]:
    """(yaw phi, pitch theta) of point i of n on the sphere."""
    i = c(i).cast("int")
    v = total(F.shiftright(i, k).bitwiseAND(1) * 0.5 ** (k + 1) for k in range(30))
    u = i / F.lit(float(n)) + offset[0] / n
    v = v + offset[1]
    if remap:
        u = F.when(u < 0.25, 2 * u).otherwise(2 * u / 3 + 1 / 3)
    return v * (2 * math.pi), F.acos(1 - 2 * u) - math.pi / 2


def camera_distance(fov_degrees, radius, margin: float = 1.3, least: float = 1.0) -> Column:
    return F.greatest(c(radius) * margin / F.tan(F.radians(c(fov_degrees)) / 2), F.lit(least))


def camera_position(yaw, pitch, r) -> tuple[Column, Column, Column]:
    yaw, pitch, r = c(yaw), c(pitch), c(r)
    return r * F.sin(yaw) * F.cos(pitch), r * F.cos(yaw) * F.cos(pitch), r * F.sin(pitch)


def time_bin(t, bins: int = 10) -> Column:
    """Bin [e_i, e_i+1) by the float edges i * (1 / bins); 1.0 falls into bin ``bins``."""
    edges = [i * (1.0 / bins) for i in range(bins)] + [1.0]
    return total((c(t) >= F.lit(e)).cast("int") for e in edges) - 1


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-c(x)))


def to_half(x: Column) -> Column:
    """The nearest number of half precision (ties to even), as double; beyond 65504 infinite."""
    x = x.cast("double")
    a = F.abs(x)
    near = F.floor(F.log2(a))  # may be one off beside a power of two
    e = F.greatest(F.when(F.pow(F.lit(2.0), near + 1) <= a, near + 1).when(F.pow(F.lit(2.0), near) > a, near - 1).otherwise(near), F.lit(-14))
    unit = F.pow(F.lit(2.0), e - 10)
    rounded = F.rint(x / unit) * unit
    return F.when(a.isNull() | F.isnan(a) | (a == 0) | (a == float("inf")), x).when(F.abs(rounded) > 65504, F.signum(x) * float("inf")).otherwise(rounded)


def softmax(a) -> Column:
    a = c(a)
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / sum_of(e))


def rescale_time(t, r: float) -> Column:
    return r * c(t) / (1 + (r - 1) * c(t))
