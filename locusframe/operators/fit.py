"""Model fits on aggregates of a few rows; sums are distributed, the solving is local."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import levenberg


def linear(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """slope and intercept of y over x."""
    c = lambda n: F.col(n).cast("double")
    aggs = [F.regr_slope(c(y), c(x)).alias("slope"), F.regr_intercept(c(y), c(x)).alias("intercept")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def linear_through_zero(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg((F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("slope"))


def curve_fit(points: DataFrame, x: str, y: str, model, start: Sequence[float], rows: int = 100_000) -> np.ndarray:
    """Least squares by damped Gauss-Newton. The curve must have at most ``rows`` points: it is an aggregate, not the data."""
    got = points.select(x, y).limit(rows + 1).toPandas()
    if len(got) > rows:
        raise ValueError("aggregate the curve first")
    got = got.sort_values(x)
    return levenberg(model, got[x].to_numpy(float), got[y].to_numpy(float), start)


def lee(n: np.ndarray, p: Sequence[float]) -> np.ndarray:
    """p**n * (1 - p)."""
    return np.power(p[0], n) * (1 - p[0])


def decay_half_life(t: np.ndarray, p: Sequence[float]) -> np.ndarray:
    """a + b * exp(-t / c)."""
    return p[0] + p[1] * np.exp(-t / p[2])


def decay(t: np.ndarray, p: Sequence[float]) -> np.ndarray:
    """a * exp(-b * t)."""
    return p[0] * np.exp(-p[1] * t)


def dark_time(histogram: DataFrame, value: str = "value", count: str = "count") -> int:
    """Longest dark time to allow: trunc(3 * c + 0.5) of the decay fitted to off-time counts."""
    top = histogram.agg(F.max(count)).first()[0] or 1
    a, b, c = curve_fit(histogram, value, count, decay_half_life, (0.0, float(top), 2.0))
    return int(3 * c + 0.5)


def voronoi_reference(x: Column, dimension: int = 2) -> Column:
    """Density of normalised cell sizes of a random (Poisson) pattern."""
    if dimension == 2:
        return F.lit(343 / 15 * math.sqrt(7 / (2 * math.pi))) * F.pow(x, F.lit(2.5)) * F.exp(-3.5 * x)
    return F.lit(3125 / 24) * F.pow(x, F.lit(4.0)) * F.exp(-5 * x)


def voronoi_threshold(cells: DataFrame, envelope: float = 0.999, bins: int = 100, dimension: int = 2) -> float | None:
    """Where the measured density of normalised cell sizes first falls to the random pattern's or below."""
    from .select import envelope as trim
    from .stats import first_crossing, histogram, probability

    kept = trim(cells, "measure", envelope, "loc_id")
    mean = kept.agg(F.avg("measure")).first()[0]
    if not mean:
        return None
    h = probability(histogram(kept.select((F.col("measure") / mean).alias("s")), "s", bins))
    curve = h.withColumn("model", voronoi_reference(F.col("centre"), dimension))
    got = first_crossing(curve.where("bin > 0"), "pdf", "model").first()[0]
    return None if got is None else got * mean


def nena_model(d: np.ndarray, p: Sequence[float]) -> np.ndarray:
    """Pairs of one emitter (Rayleigh), of near ones (Gaussian), and a linear background; six parameters."""
    s, area, near, at, width, slope = p
    return area * d / (2 * s * s) * np.exp(-(d**2) / (4 * s * s)) + near * np.exp(-((d - at) ** 2) / (2 * width**2)) + slope * d


def nena(distances: DataFrame, column: str = "distance", top: float = 150.0) -> float:
    """Localization precision from distances of consecutive-frame neighbours, in unit bins up to ``top``."""
    d = distances.where(F.col(column).between(0, top))
    n = d.count()
    if not n:
        return float("nan")
    h = d.groupBy(F.floor(column).cast("int").alias("bin")).agg((F.count(F.lit(1)) / n).alias("p")).select((F.col("bin") + 0.5).alias("x"), "p")
    peak = h.orderBy(F.desc("p")).first()["x"]
    p = curve_fit(h, "x", "p", nena_model, (max(peak / math.sqrt(2), 0.5), 1.0, 1e-3, 2 * peak + 10, 20.0, 1e-6))
    return abs(float(p[0]))


def sphere_fit(locs: DataFrame) -> DataFrame:
    """cx, cy, cz, r by linear least squares: |p|^2 = 2 c.p + k, from the normal equations' sums."""
    m = locs.agg(*[F.avg(a).alias(a) for a in "xyz"]).first()
    c = {a: F.col(a) - F.lit(m[a]) for a in "xyz"}  # centred, for condition
    one = F.lit(1.0)
    terms = [2 * c["x"], 2 * c["y"], 2 * c["z"], one]
    rhs = c["x"] ** 2 + c["y"] ** 2 + c["z"] ** 2
    sums = [F.sum(terms[i] * terms[j]) for i in range(4) for j in range(i, 4)] + [F.sum(t * rhs) for t in terms]
    got = list(locs.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
    a = np.zeros((4, 4))
    for v, (i, j) in zip(got, [(i, j) for i in range(4) for j in range(i, 4)], strict=False):
        a[i, j] = a[j, i] = v
    p = np.linalg.solve(a, np.array(got[10:], float))
    r = math.sqrt(p[3] + p[0] ** 2 + p[1] ** 2 + p[2] ** 2)
    row = [(float(p[0] + m["x"]), float(p[1] + m["y"]), float(p[2] + m["z"]), float(r))]
    return locs.sparkSession.createDataFrame(row, "cx double, cy double, cz double, r double")


def project_on_sphere(locs: DataFrame, cx: float, cy: float, cz: float, r: float) -> DataFrame:
    d = {"x": F.col("x") - cx, "y": F.col("y") - cy, "z": F.col("z") - cz}
    n = F.sqrt(d["x"] ** 2 + d["y"] ** 2 + d["z"] ** 2)
    return locs.withColumns({a: F.lit(c) + v / n * r for (a, v), c in zip(d.items(), (cx, cy, cz), strict=True)})


def ellipsoid_fit(locs: DataFrame, form: str = "general") -> dict[str, np.ndarray]:
    """centre, semi-axes (longest first) and rotation (rows) of the quadric through the points, from sums of its terms.

    form: ``general``, ``aligned`` (axes along x, y and z: no mixed terms) or ``round`` (aligned, with equal axes in x and y).
    """
    m = locs.agg(*[F.avg(a).alias(a) for a in "xyz"], *[F.stddev_pop(a).alias(f"s{a}") for a in "xyz"]).first()
    scale = max(m["sx"], m["sy"], m["sz"]) or 1.0
    x, y, z = ((F.col(a) - F.lit(m[a])) / F.lit(scale) for a in "xyz")
    square = {"general": [x * x, y * y, z * z, 2 * x * y, 2 * x * z, 2 * y * z], "aligned": [x * x, y * y, z * z], "round": [x * x + y * y, z * z]}[form]
    t = [*square, 2 * x, 2 * y, 2 * z]
    n = len(t)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = [F.sum(t[i] * t[j]) for i, j in pairs] + [F.sum(v) for v in t]
    got = [float(v) for v in locs.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    a = np.zeros((n, n))
    for v, (i, j) in zip(got, pairs, strict=False):
        a[i, j] = a[j, i] = v
    v = np.linalg.solve(a, np.array(got[len(pairs) :]))
    mixed = v[3:6] if form == "general" else np.zeros(3)
    own = v[[0, 0, 1]] if form == "round" else v[:3]
    q = np.array([[own[0], mixed[0], mixed[1]], [mixed[0], own[1], mixed[2]], [mixed[1], mixed[2], own[2]]])
    c = -np.linalg.solve(q, v[-3:])
    level = 1 + c @ q @ c
    w, axes = np.linalg.eigh(q / level)
    order = np.argsort(w)
    radii = 1 / np.sqrt(np.abs(w[order]))
    return {"centre": c * scale + np.array([m["x"], m["y"], m["z"]]), "axes": radii * scale, "rotation": axes.T[order]}


def regularise(locs: DataFrame, cell: float) -> DataFrame:
    """The mean point of each cube of space."""
    k = [F.floor(F.col(a) / F.lit(cell)).alias(f"k{a}") for a in "xyz"]
    return locs.groupBy(*k).agg(*[F.avg(a).alias(a) for a in "xyz"], F.count(F.lit(1)).alias("n")).drop("kx", "ky", "kz")


def regularise_sectors(locs: DataFrame, cx: float, cy: float, cz: float, steps: int = 36) -> DataFrame:
    """The mean point of each sector of polar and azimuthal angle about a centre."""
    dx, dy, dz = F.col("x") - cx, F.col("y") - cy, F.col("z") - cz
    r = F.sqrt(dx * dx + dy * dy + dz * dz)
    w = math.pi / (steps // 2)
    az, po = F.floor((F.atan2(dy, dx) + math.pi) / w).alias("ka"), F.floor(F.acos(dz / r) / w).alias("kp")
    return locs.groupBy(az, po).agg(*[F.avg(a).alias(a) for a in "xyz"], F.count(F.lit(1)).alias("n")).drop("ka", "kp")


# Names of the modes.
NORMALISATIONS = (
    "Norm-Self", "Norm-FirstDiff", "Norm-MaxDiff", "Norm-MinDiff", "Norm-Diff", "Diff-Norm", "Raw-Differences", "Norm-Diffs-Only-NoRescale", "Raw-Distances",
)


def normalise_distances(d: Column, mode: str) -> Column:
    """An array of ascending distances made a scale-free input, in one of nine ways.

    Self: over the largest distance; FirstDiff, MaxDiff, MinDiff: differences over the first, largest or smallest
    one; Norm-Diff: differences of distances over the largest distance; Diff-Norm: differences over their sum;
    Norm-Diffs-Only-NoRescale: differences over the first distance; the raw forms are left as they are.
    """
    n = F.size(d)
    diff = F.zip_with(F.slice(d, 2, F.greatest(n - 1, F.lit(0))), F.slice(d, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    over = lambda a, by: F.transform(a, lambda v: F.when(by != 0, v / by))
    total = F.aggregate(diff, F.lit(0.0), lambda s, v: s + v)
    forms = {
        "Norm-Self": lambda: over(d, F.array_max(d)), "Norm-FirstDiff": lambda: over(diff, F.get(diff, F.lit(0))),
        "Norm-MaxDiff": lambda: over(diff, F.array_max(diff)), "Norm-MinDiff": lambda: over(diff, F.array_min(diff)),
        "Norm-Diff": lambda: over(diff, F.array_max(d)), "Diff-Norm": lambda: over(diff, total), "Raw-Differences": lambda: diff,
        "Norm-Diffs-Only-NoRescale": lambda: over(diff, F.get(d, F.lit(0))), "Raw-Distances": lambda: d,
    }
    if mode not in forms:
        raise ValueError(f"unknown mode {mode}")
    return forms[mode]()


def classify_with(df: DataFrame, features: Sequence[str], predict, schema: str, threshold: float = 0.5) -> DataFrame:
    """df with a model's output. predict(matrix) -> one column of scores (0.5 threshold) or several (largest wins)."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            s = np.asarray(predict(np.stack([np.asarray(pdf[c].tolist()) for c in features], -1)))
            label = (s.reshape(-1) >= threshold).astype(int) if s.ndim == 1 or s.shape[1] == 1 else s.argmax(1)
            yield pdf.assign(label=pd.Series(label, index=pdf.index))

    return df.mapInPandas(run, schema)
