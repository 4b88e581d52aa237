"""Ripley's K and L functions with edge correction."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import pairs_within, sites  # noqa: F401  a test watches the first one


def radii(lo: float = 10.0, hi: float = 200.0, step: float = 10.0) -> list[float]:
    out, r = [], float(lo)
    while r <= hi + 1e-9 * step:
        out.append(r)
        r += step
    return out


def edge_factor(x: Column, y: Column, r: Column, box: tuple[float, float, float, float]) -> Column:
    """1 / share of a circle's arc about (x, y) inside the box, for any edges that it meets, opposite ones too.

    Beyond an edge at distance d lies an arc of 2 * acos(d / r); arcs of neighbouring edges share what
    exceeds a right angle between them, about the corner.
    """
    x0, y0, x1, y1 = (F.lit(float(v)) for v in box)
    half = [F.acos(F.least(d / r, F.lit(1.0))) for d in (x - x0, y - y0, x1 - x, y1 - y)]
    lost = F.lit(0.0)
    for a, b in zip(half, half[1:] + half[:1], strict=True):
        lost = lost + 2 * a - F.greatest(a + b - math.pi / 2, F.lit(0.0))
    return F.lit(2 * math.pi) / F.greatest(F.lit(2 * math.pi) - lost, F.lit(1e-9))


def _edge_factors(x: np.ndarray, y: np.ndarray, r: float, box: tuple[float, float, float, float]) -> np.ndarray:
    """``edge_factor`` on arrays."""
    x0, y0, x1, y1 = box
    out = np.ones(len(x))
    edge = np.flatnonzero(np.minimum(np.minimum(x - x0, x1 - x), np.minimum(y - y0, y1 - y)) < r)
    x, y = x[edge], y[edge]
    half = [np.arccos(np.minimum(d / r, 1.0)) for d in (x - x0, y - y0, x1 - x, y1 - y)]
    lost = sum(2 * a - np.maximum(a + b - math.pi / 2, 0.0) for a, b in zip(half, half[1:] + half[:1], strict=True))
    out[edge] = 2 * math.pi / np.maximum(2 * math.pi - lost, 1e-9)
    return out


def disc_sums(x: np.ndarray, y: np.ndarray, n: np.ndarray, own: np.ndarray, rs: Sequence[float], h: float, box: tuple[float, float, float, float], corrected: bool) -> np.ndarray:
    """For each radius the sum of factor * neighbours (strictly nearer, sites count n times) over the pairs that ``own`` sites have
    with sites of their strip (of height h, counted from the box) and, both ways, with those of the strips above.

    The part of a strip inside a circle is a range in the order of x. Its ends are found by search for the least and
    the greatest distance of the strips; only what lies between the two is compared one by one.
    """
    strip = np.floor((y - box[1]) / h).astype(np.int64)
    order = np.lexsort((x, strip))
    x, y, own, strip = x[order], y[order], own[order], strip[order]
    n = n[order].astype(float)
    first = np.flatnonzero(np.r_[True, strip[1:] != strip[:-1]])
    ends = np.r_[first, len(x)]
    low, high = np.minimum.reduceat(y, first), np.maximum.reduceat(y, first)
    r = np.array(rs, float)
    r2 = r * r
    g = np.stack([_edge_factors(x, y, v, box) * n for v in rs]) if corrected else None
    upto = np.r_[0.0, np.cumsum(n)]
    gupto = np.concatenate([np.zeros((len(r), 1)), np.cumsum(g, 1)], 1) if corrected else None
    tiny = 4e-16 * np.abs(x).max(initial=0.0)
    total = np.zeros(len(r))
    for s in range(len(first)):
        mine = ends[s] + np.flatnonzero(own[ends[s] : ends[s + 1]])
        if not len(mine):
            continue
        xa, ya, na = x[mine], y[mine], n[mine]
        for t in range(s, len(first)):
            least, most = (low[t] - high[s], high[t] - low[s]) if t > s else (0.0, high[s] - low[s])
            some = np.flatnonzero(r > least * (1 - 1e-12))
            if not len(some):
                break
            xt, base = x[ends[t] : ends[t + 1]], ends[t]
            q = r2[some]
            far = (np.sqrt(np.maximum(q - least * least, 0.0) + 1e-13 * q) + tiny)[:, None]
            near = (np.sqrt(np.maximum(q - most * most - 1e-13 * q, 0.0)) - tiny)[:, None]
            left, right = xa - far, xa + far
            l1 = np.searchsorted(xt, left.ravel(), "left").reshape(left.shape)
            r1 = np.searchsorted(xt, right.ravel(), "right").reshape(right.shape)
            l2, r2_ = l1, r1
            inner = near > 0
            if most > least or not inner.all():
                l2 = np.where(inner, np.searchsorted(xt, (xa - near).ravel(), "right").reshape(l1.shape), l1)
                r2_ = np.where(inner, np.searchsorted(xt, (xa + near).ravel(), "left").reshape(l1.shape), l1)
            else:  # one height each: next to nothing lies between, told by the outermost of each range
                open_ = (l1 < r1) & ((xt[np.minimum(l1, len(xt) - 1)] <= xa - near) | (xt[r1 - 1] >= xa + near))
                if open_.any():
                    i, k = np.nonzero(open_)
                    l2, r2_ = l1.copy(), r1.copy()
                    l2[i, k] = np.searchsorted(xt, xa[k] - near[i, 0], "right")
                    r2_[i, k] = np.searchsorted(xt, xa[k] + near[i, 0], "left")
            if l2 is not l1:
                r2_ = np.maximum(r2_, l2)
            count = upto[base + r2_] - upto[base + l2]
            if l2 is not l1:
                i, k, at = _between(l1, l2, r2_, r1)
                at = at + base
                ok = (xa[k] - x[at]) * (xa[k] - x[at]) + (ya[k] - y[at]) * (ya[k] - y[at]) < q[i]
                i, k, at = i[ok], k[ok], at[ok]
                count += np.bincount(i * len(xa) + k, n[at], count.size).reshape(count.shape)
            if t == s:
                count = count - 1  # all but the point itself
            if not corrected:
                total[some] += (1 if t == s else 2) * (count @ na)
                continue
            total[some] += (count * g[np.ix_(some, mine)]).sum(1)
            if t > s:
                total[some] += (gupto[some[:, None], base + r2_] - gupto[some[:, None], base + l2]) @ na
                if l2 is not l1:
                    total += np.bincount(some[i], g[some[i], at] * na[k], len(r))
    return total


def _between(l1: np.ndarray, l2: np.ndarray, r2: np.ndarray, r1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, place) of all places from l1 up to l2 and from r2 up to r1."""
    out = []
    for lo, hi in ((l1, l2), (r2, r1)):
        i, k = np.nonzero(hi > lo)
        m = hi[i, k] - lo[i, k]
        start = np.repeat(np.cumsum(m) - m, m)
        out.append((np.repeat(i, m), np.repeat(k, m), np.repeat(lo[i, k], m) + np.arange(m.sum()) - start))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


#: A tile with its margin has so many sites at most, as far as smaller tiles help.
TILE_SITES = 1_500_000


def k_function(locs: DataFrame, lo: float = 10.0, hi: float = 200.0, step: float = 10.0, corrected: bool = True) -> DataFrame:
    """(radius, k, l). Sites (equal coordinates) go to tiles with margins of the largest radius, where neighbours are counted
    in strips (strictly nearer than each radius), not listed.

    k(r) = sum over points of factor * neighbours / density / n;  l = sqrt(k / pi) - r.
    """
    rs = radii(lo, hi, step)
    n, x0, x1, y0, y1 = locs.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    box = (math.floor(x0), math.floor(y0), math.ceil(x1), math.ceil(y1))
    density = n / ((box[2] - box[0]) * (box[3] - box[1]))
    s = sites(locs.select("loc_id", "x", "y").where("x is not null and y is not null"), ["x", "y"])
    reach = rs[-1] * (1 + 1e-9)
    cell = s.groupBy(F.floor(F.col("x") / reach).alias("cx"), F.floor(F.col("y") / reach).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    all_, dense, used = cell.agg(F.sum("n"), F.max("n"), F.count(F.lit(1))).first()
    side = 2 * reach
    while side > reach / 2 and (4 * side / reach + 2) * (side / reach + 2) * dense > TILE_SITES:
        side /= 2
    wide, tall = 4 * side, side
    h = max(min(math.sqrt(used * reach * reach / all_), rs[0] / 2), rs[0] / 64)
    tile = lambda c, at, size: F.floor((F.col(c) + F.lit(at)) / F.lit(size))
    span = [F.explode(F.sequence(tile("x", -reach, wide), tile("x", reach, wide))).alias("tx"), F.explode(F.sequence(tile("y", -reach, tall), tile("y", 1.001 * h, tall))).alias("ty")]
    parts = s.select("x", "y", "n", span[0]).select("x", "y", "n", "tx", span[1])
    parts = parts.withColumn("own", (F.col("tx") == tile("x", 0.0, wide)) & (F.col("ty") == tile("y", 0.0, tall)))
    tasks = max(8, min(2000, math.ceil(used * reach * reach / (wide * tall))))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        got = disc_sums(*[pdf[c].to_numpy() for c in ("x", "y", "n", "own")], rs, h, box, corrected)
        return pd.DataFrame({"i": np.arange(len(rs), dtype=np.int32), "c": got})

    sums = parts.repartition(tasks, "tx", "ty").groupBy("tx", "ty").applyInPandas(work, "i int, c double")
    k = sums.groupBy("i").agg((F.sum("c") / F.lit(density) / F.lit(n)).alias("k"))
    frame = locs.sparkSession.createDataFrame([(i, r) for i, r in enumerate(rs)], "i int, radius double")
    out = frame.join(k, "i", "left").select("radius", F.coalesce("k", F.lit(0.0)).alias("k"))
    return out.withColumn("l", F.sqrt(F.col("k") / math.pi) - F.col("radius"))
