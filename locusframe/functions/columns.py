"""Scalar functions as Column expressions; all stay inside generated JVM code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def over(a: Column, b: Column) -> Column:
    """a / b; null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


# --- features -------------------------------------------------------------------------------


def add_feature(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def delete_feature(df: DataFrame, name: str) -> DataFrame:
    """df without a column; the last one stays."""
    if name not in df.columns:
        raise KeyError(name)
    if len(df.columns) == 1:
        raise ValueError("the last feature cannot be deleted")
    return df.drop(name)


def list_features(df: DataFrame) -> list[str]:
    return sorted(df.columns)


def has_feature(df: DataFrame, name: str) -> bool:
    return name in df.columns


def log_view(c: Column | str) -> Column:
    """log10; null at and below zero."""
    return F.log10(col(c))


def normalise(c: Column, lo: Column, hi: Column, top: float) -> Column:
    """(v - min) / (max - min) * top, as for 8-bit, 16-bit and float images."""
    return over(c - lo, hi - lo) * F.lit(float(top))


def rotate(x: Column, y: Column, cx: Column, cy: Column, angle: float) -> Point:
    """A point turned about (cx, cy) by an angle in radians, in polar form."""
    dx, dy = x - cx, y - cy
    r, a = F.sqrt(dx * dx + dy * dy), F.atan2(dy, dx) + F.lit(angle)
    return cx + r * F.cos(a), cy + r * F.sin(a)


# --- distances, areas, predicates -----------------------------------------------------------


def distance2(a: Sequence[Column], b: Sequence[Column]) -> Column:
    terms = [(p - q) * (p - q) for p, q in zip(a, b, strict=True)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.sqrt(distance2(a, b))


def heron_area(a: Column, b: Column, c: Column) -> Column:
    """Area of a triangle from its sides."""
    s = (a + b + c) / 2
    return F.sqrt(F.abs(s * (s - a) * (s - b) * (s - c)))


def cross_area(a: Point, b: Point, c: Point) -> Column:
    """Area of a triangle from its corners."""
    return F.abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2


def _ring(pts: Column) -> Column:
    """Each corner of an array with the next one, the last with the first."""
    n = F.size(pts)
    return F.zip_with(pts, F.concat(F.slice(pts, 2, n), F.slice(pts, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _total(pairs: Column, term) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, e: acc + term(e.p, e.q))


def polygon_area(pts: Column) -> Column:
    """Trapezoid sum over an array of structs (x, y)."""
    return F.abs(_total(_ring(pts), lambda p, q: (q.x - p.x) * (q.y + p.y) / 2))


def polygon_fan_area(pts: Column) -> Column:
    """Sum of Heron triangles about the mean corner."""
    n = F.size(pts)
    cx = F.aggregate(pts, F.lit(0.0), lambda s, p: s + p.x) / n
    cy = F.aggregate(pts, F.lit(0.0), lambda s, p: s + p.y) / n
    d = lambda ax, ay, bx, by: F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    return _total(_ring(pts), lambda p, q: heron_area(d(p.x, p.y, q.x, q.y), d(p.x, p.y, cx, cy), d(q.x, q.y, cx, cy)))


def polygon_perimeter(pts: Column) -> Column:
    return _total(_ring(pts), lambda p, q: F.sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)))


def side(p: Point, a: Point, b: Point) -> Column:
    """Twice the signed area of (p, a, b)."""
    return (p[0] - b[0]) * (a[1] - b[1]) - (a[0] - b[0]) * (p[1] - b[1])


def in_triangle(p: Point, a: Point, b: Point, c: Point) -> Column:
    """Boundary included."""
    d = [side(p, a, b), side(p, b, c), side(p, c, a)]
    neg = (d[0] < 0) | (d[1] < 0) | (d[2] < 0)
    pos = (d[0] > 0) | (d[1] > 0) | (d[2] > 0)
    return ~(neg & pos)


def cross3(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = a[0] * b[0]
    for p, q in zip(a[1:], b[1:], strict=True):
        out = out + p * q
    return out


def add(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, ...]:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def sub(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, ...]:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def length(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Sequence[Column]) -> tuple[Column, ...]:
    n = length(a)
    return tuple(F.when(n > 0, p / n) for p in a)


def same_side(p, a, b, c, d) -> Column:
    """Whether p lies on d's side of the plane (a, b, c), or on it."""
    n = cross3(sub(b, a), sub(c, a))
    return dot(n, sub(d, a)) * dot(n, sub(p, a)) >= 0


def in_tetrahedron(p, a, b, c, d) -> Column:
    return same_side(p, a, b, c, d) & same_side(p, b, c, d, a) & same_side(p, c, d, a, b) & same_side(p, d, a, b, c)


def tetra_volume(a, b, c, d) -> Column:
    return F.abs(dot(sub(a, d), cross3(sub(b, d), sub(c, d)))) / 6


def orientation(a: Point, b: Point, c: Point) -> Column:
    """0 collinear, 1 clockwise, 2 counter-clockwise."""
    v = (b[1] - a[1]) * (c[0] - b[0]) - (b[0] - a[0]) * (c[1] - b[1])
    return F.when(v == 0, 0).when(v > 0, 1).otherwise(2)


def on_segment(a: Point, p: Point, b: Point) -> Column:
    """Whether p, collinear with a and b, lies between them."""
    return (p[0] <= F.greatest(a[0], b[0])) & (p[0] >= F.least(a[0], b[0])) & (p[1] <= F.greatest(a[1], b[1])) & (p[1] >= F.least(a[1], b[1]))


def segments_meet(a: Point, b: Point, c: Point, d: Point) -> Column:
    o1, o2, o3, o4 = orientation(a, b, c), orientation(a, b, d), orientation(c, d, a), orientation(c, d, b)
    touch = ((o1 == 0) & on_segment(a, c, b)) | ((o2 == 0) & on_segment(a, d, b)) | ((o3 == 0) & on_segment(c, a, d)) | ((o4 == 0) & on_segment(c, b, d))
    return ((o1 != o2) & (o3 != o4)) | touch


def circle_segment_hits(c: Point, r: Column, a: Point, b: Point) -> Column:
    """Array of points (x, y) where a segment meets a circle."""
    dx, dy, fx, fy = b[0] - a[0], b[1] - a[1], a[0] - c[0], a[1] - c[1]
    qa, qb, qc = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - r * r
    disc = qb * qb - 4 * qa * qc
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    ts = F.array((-qb - root) / (2 * qa) + 0.0, (-qb + root) / (2 * qa) + 0.0)  # no negative zero beside zero
    inside = F.filter(F.array_distinct(ts), lambda t: (t >= 0) & (t <= 1))
    hits = F.transform(inside, lambda t: F.struct((a[0] + t * dx).alias("x"), (a[1] + t * dy).alias("y")))
    return F.when((disc >= 0) & (qa > 0), hits).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def circular_segment_area(r: Column, h: Column) -> Column:
    """Of a circle of radius r cut at distance h from its centre."""
    return r * r * F.acos(h / r) - h * F.sqrt(r * r - h * h)


def point_in_rect(p: Point, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return p[0].between(x0, x1) & p[1].between(y0, y1)


def rect_in_circle(c: Point, r: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = F.greatest(c[0] - x0, x1 - c[0]), F.greatest(c[1] - y0, y1 - c[1])
    return dx * dx + dy * dy <= r * r


def closest_on_line(p: Point, a: Point, b: Point) -> Point:
    """Foot of p on the line through a and b."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) * over(F.lit(1.0), dx * dx + dy * dy)
    return a[0] + t * dx, a[1] + t * dy


def lines_cross(a: Point, b: Point, c: Point, d: Point) -> Point:
    """Where two lines cross; null if they are parallel."""
    den = (a[0] - b[0]) * (c[1] - d[1]) - (a[1] - b[1]) * (c[0] - d[0])
    p, q = a[0] * b[1] - a[1] * b[0], c[0] * d[1] - c[1] * d[0]
    one = lambda v: F.when(den != 0, v / den)
    return one(p * (c[0] - d[0]) - (a[0] - b[0]) * q), one(p * (c[1] - d[1]) - (a[1] - b[1]) * q)


def line_at(x: Column, a: Point, b: Point) -> Column:
    """y of the line through a and b at x; null if it is vertical."""
    return F.when(b[0] != a[0], a[1] + (x - a[0]) * (b[1] - a[1]) / (b[0] - a[0]))


def point_at(a: Point, b: Point, d: Column) -> Point:
    """The point at distance d from a towards b."""
    n = distance(a, b)
    return a[0] + over((b[0] - a[0]) * d, n), a[1] + over((b[1] - a[1]) * d, n)


# --- rounding, colours, strings -------------------------------------------------------------


def round_up(v: Column, step: float) -> Column:
    """To the next multiple of step."""
    return F.ceil(v / F.lit(float(step))) * F.lit(float(step))


def round_away(v: Column) -> Column:
    """Away from zero."""
    return F.when(v < 0, F.floor(v)).otherwise(F.ceil(v))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    two = lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def linear_light(v: Column) -> Column:
    """sRGB component in 0..255 to linear light."""
    s = v / 255
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * linear_light(r) + 0.7152 * linear_light(g) + 0.0722 * linear_light(b)


def lightness(y: Column) -> Column:
    """CIE L* of a luminance."""
    return F.when(y <= 216 / 24389, y * (24389 / 27)).otherwise(F.pow(y, F.lit(1 / 3)) * 116 - 16)


def contrast(l1: Column, l2: Column) -> Column:
    return (F.greatest(l1, l2) + 0.05) / (F.least(l1, l2) + 0.05)


def random_colour(key: Column, seed: int, dark: bool = False) -> Column:
    """A bright (or dark) colour as an array of three numbers, from a hash of key and seed."""
    part = lambda k: F.pmod(F.xxhash64(F.lit(seed), key, F.lit(k)), F.lit(128)) + (0 if dark else 128)
    return F.array(part(0), part(1), part(2))


def split_text(c: Column, sep: str) -> Column:
    import re

    return F.split(c, re.escape(sep))


def palette_colour(v: Column, lo: float, hi: float, palette: Sequence[str]) -> Column:
    """The palette's entry for a value's place in lo..hi; ends are clamped."""
    n = len(palette)
    k = F.greatest(F.lit(1), F.least(F.lit(n), F.width_bucket(v, F.lit(float(lo)), F.lit(float(hi)), F.lit(n)))).cast("int")
    return F.element_at(F.array(*map(F.lit, palette)), k)


def spread(df: DataFrame, value: Column, selected: Column, vertices: str, sentinel: float | None = None) -> DataFrame:
    """One row for each vertex with its primitive's value; unselected primitives give the sentinel."""
    v = F.when(selected, value).otherwise(F.lit(sentinel))
    return df.select("*", v.alias("primitive_value"), F.posexplode(vertices).alias("vertex_no", "vertex"))


def moved_from(p: Sequence[Column], cell: Sequence[Column], centre: Sequence[Column], factor: float) -> tuple[Column, ...]:
    """A point of a cell, moved with its cell away from a centre: by ``factor`` times the cell's distance from it."""
    return tuple(v + (c - o) * factor for v, c, o in zip(p, cell, centre, strict=True))


def depth(p: Sequence[Column], eye: Sequence[Column], ahead: Sequence[Column]) -> Column:
    """How far a point lies before an eye that looks ahead; rows in descending order of it are drawn back to front."""
    return dot(sub(p, eye), unit(ahead))


def face_normal(a, b, c) -> tuple[Column, ...]:
    return unit(cross3(sub(b, a), sub(c, a)))


def sphere_points(df: DataFrame, radius: float, seed: int) -> DataFrame:
    """Uniform points on a sphere by normalised Gaussians; columns x, y, z."""
    d = df.withColumns({c: F.randn(seed + i) for i, c in enumerate(("_a", "_b", "_c"))})
    n = length([F.col("_a"), F.col("_b"), F.col("_c")])
    return d.withColumns({c: F.col(s) / n * radius for c, s in zip("xyz", ("_a", "_b", "_c"), strict=True)}).drop("_a", "_b", "_c")


def turn(degrees: float) -> float:
    return degrees * math.pi / 180
