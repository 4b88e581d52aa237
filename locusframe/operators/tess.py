"""Delaunay triangulations and Voronoi cells.

Points of a large set are dealt to square tiles, each with a halo of its
neighbours' points; a tile with too many points is split, in rounds, so that
clusters do not fill one task. A triangle found in a tile stands if its circumcircle lies
in the tile with halo: no other point can be inside, so it belongs to the
triangulation of all points. Points whose every triangle stands are done. The
few others, at the hull and in thin regions, are triangulated once more by
themselves; of that, the part outside the triangles that stand is the rest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if, stash
from .kernels import Delaunay2D, circumcircles, clip_cell, clip_polyhedron, delaunay_3d, hull_3d

#: Points that one task triangulates, and halo width in mean point distances.
TASK_POINTS = 20_000
HALO = 6.0
FACES = "v array<long>, measure double"


def _faces(ids: np.ndarray, x: np.ndarray, y: np.ndarray, tri: np.ndarray) -> pd.DataFrame:
    v = np.sort(ids[tri], 1) if len(tri) else np.zeros((0, 3), np.int64)
    a = np.abs((x[tri[:, 1]] - x[tri[:, 0]]) * (y[tri[:, 2]] - y[tri[:, 0]]) - (x[tri[:, 2]] - x[tri[:, 0]]) * (y[tri[:, 1]] - y[tri[:, 0]])) / 2
    return pd.DataFrame({"v": pd.Series(v.tolist(), dtype=object), "measure": a})


def _sorted(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("loc_id", kind="stable")
    return pdf["loc_id"].to_numpy(), pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)


def _in_one(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, x, y = _sorted(pdf)
    return _faces(ids, x, y, Delaunay2D(x, y).triangles())


def _tile(key, pdf):
    """Triangles of a tile that stand (kind 0), and its own points that are not done (kind 1)."""
    x0, y0, side, halo = key
    ids, x, y = _sorted(pdf)
    d = Delaunay2D(x, y)
    tri = d.triangles()
    cx, cy, r = circumcircles(x, y, tri) if len(tri) else (np.zeros(0),) * 3
    r = r * (1 + 1e-9)  # beyond rounding
    stands = (cx - r > x0 - halo) & (cx + r < x0 + side + halo) & (cy - r > y0 - halo) & (cy + r < y0 + side + halo)
    around = np.bincount(tri.reshape(-1), minlength=len(ids)) if len(tri) else np.zeros(len(ids), int)
    sure = np.bincount(tri[stands].reshape(-1), minlength=len(ids)) if len(tri) else np.zeros(len(ids), int)
    hull = np.zeros(len(ids), bool)
    for (u, v), w in d.third.items():
        if w < 0:
            hull[[u, v]] = True
    edge = 1e-9 * (abs(x0) + abs(y0) + side)  # a point on a border may be two tiles' own
    mine = (x >= x0 - edge) & (x <= x0 + side + edge) & (y >= y0 - edge) & (y <= y0 + side + edge)
    todo = mine & ((around != sure) | hull | (around == 0))
    f = _faces(ids, x, y, tri[stands])
    f["kind"] = 0
    o = pd.DataFrame({"v": pd.Series([[int(i)] for i in ids[todo]], dtype=object), "measure": 0.0, "kind": 1})
    return pd.concat([f, o], ignore_index=True)


def tiles(p: DataFrame, side: float, halo: float, task_points: int) -> DataFrame:
    """Points (loc_id, x, y) dealt to tiles (x0, y0, side, halo), each with what lies in its halo.

    A tile with more than four times task_points is cut into k x k ones with halos k times narrower, until none is left.
    """
    wide = 1 + 1e-6
    at = {c: F.explode(F.sequence(F.floor((F.col(c) - halo * wide) / side), F.floor((F.col(c) + halo * wide) / side))) for c in ("x", "y")}
    dealt = p.withColumn("tx", at["x"]).withColumn("ty", at["y"])
    dealt = dealt.select("loc_id", "x", "y", (F.col("tx") * side).alias("x0"), (F.col("ty") * side).alias("y0"), F.lit(side).alias("side"), F.lit(halo).alias("halo"))
    for _ in range(30):
        k = F.least(F.ceil(F.sqrt(F.count(F.lit(1)) / task_points)), F.lit(256)).cast("int")
        heavy = stash(dealt.groupBy("x0", "y0", "side").agg(F.count(F.lit(1)).alias("n"), k.alias("k")).where(F.col("n") > 4 * task_points).drop("n"), "heavy")
        if heavy.isEmpty():
            break
        d = dealt.join(broadcast_if(heavy, 1_000_000), ["x0", "y0", "side"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
        s, h = F.col("side") / F.col("k"), F.col("halo") / F.col("k")
        for c, o in (("x", "x0"), ("y", "y0")):
            lo, hi = F.floor((F.col(c) - F.col(o) - h * wide) / s), F.floor((F.col(c) - F.col(o) + h * wide) / s)
            lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.col("k") - 1)
            d = d.withColumn(f"i{c}", F.explode(F.when(F.col("k") == 1, F.array(F.lit(0).cast("bigint"))).when(lo <= hi, F.sequence(lo, hi))))
        dealt = stash(d.select("loc_id", "x", "y", (F.col("x0") + F.col("ix") * s).alias("x0"), (F.col("y0") + F.col("iy") * s).alias("y0"), s.alias("side"), h.alias("halo")), "dealt")
    return dealt


def _rest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Triangles of the points that are not done, outside those that stand. edge_a, edge_b: open sides, as directed edges."""
    pts = pdf[pdf["loc_id"].notna()]
    ids, x, y = _sorted(pts.astype({"loc_id": np.int64}))
    at = {int(i): k for k, i in enumerate(ids)}
    sides = pdf[pdf["edge_a"].notna()]
    third = Delaunay2D(x, y).third
    walls = {(at[int(a)], at[int(b)]) for a, b in zip(sides["edge_a"], sides["edge_b"], strict=True)}
    todo = list(walls) if walls else [next(iter(k for k, w in third.items() if w >= 0 and min(k) >= 0), None)]
    seen: set[tuple[int, ...]] = set()
    while todo:
        e = todo.pop()
        if e is None or e not in third:
            continue
        u, v = e
        w = third[u, v]
        t = tuple(sorted((u, v, w)))
        if t[0] < 0 or t in seen:
            continue
        seen.add(t)
        todo += [(b, a) for a, b in ((u, v), (v, w), (w, u)) if (a, b) not in walls]
    return _faces(ids, x, y, np.array(sorted(seen), np.int64).reshape(-1, 3))


def delaunay(locs: DataFrame, task_points: int = TASK_POINTS) -> DataFrame:
    """(face_id, v, measure): triangles of points (loc_id, x, y), vertices ascending, area; face ids in order of v."""
    return number_faces(_triangles(locs, task_points))


def _triangles(locs: DataFrame, task_points: int) -> DataFrame:
    """(v, measure): as ``delaunay``, without face ids."""
    p = locs.select(F.col("loc_id").cast("long").alias("loc_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = stash(p.groupBy("x", "y").agg(F.min("loc_id").alias("loc_id")).select("loc_id", "x", "y"), "places")  # copies have no triangles
    n, x0, x1, y0, y1 = p.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if n <= task_points:
        return p.groupBy(F.lit("all")).applyInPandas(_in_one, FACES)
    area = max((x1 - x0) * (y1 - y0), 1e-12)
    side = math.sqrt(area * task_points / n)
    halo = min(HALO * math.sqrt(area / n), side)
    dealt = tiles(p, side, halo, task_points)
    got = stash(dealt.groupBy("x0", "y0", "side", "halo").applyInPandas(_tile, f"{FACES}, kind int"), "tiles")
    stand = stash(got.where("kind = 0").groupBy("v").agg(F.max("measure").alias("measure")), "stand")
    open_ids = got.where("kind = 1").select(F.col("v")[0].alias("loc_id")).distinct()
    open_pts = stash(p.join(open_ids, "loc_id"), "open")
    # Sides of standing triangles that no other one shares, as directed edges seen from outside.
    c = lambda k: p.select(F.col("loc_id").alias(f"i{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    tri = stand.select(*[F.col("v")[k].alias(f"i{k}") for k in range(3)])
    near = tri
    for k in range(3):
        near = near.join(open_ids.select(F.col("loc_id").alias(f"i{k}"), F.lit(1).alias(f"o{k}")), f"i{k}", "left")
    near = near.where("coalesce(o0, 0) + coalesce(o1, 0) + coalesce(o2, 0) >= 2")
    for k in range(3):
        near = near.join(c(k), f"i{k}")
    ccw = F.expr("(x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0) > 0")
    ring = [F.struct(F.when(ccw, F.col(f"i{b}")).otherwise(F.col(f"i{a}")).alias("edge_a"), F.when(ccw, F.col(f"i{a}")).otherwise(F.col(f"i{b}")).alias("edge_b")) for a, b in ((0, 1), (1, 2), (2, 0))]
    e = near.select(F.explode(F.array(*ring)).alias("e")).select("e.*")
    both = e.groupBy(F.least("edge_a", "edge_b").alias("lo"), F.greatest("edge_a", "edge_b").alias("hi")).agg(F.count(F.lit(1)).alias("n"), F.first("edge_a").alias("edge_a"), F.first("edge_b").alias("edge_b"))
    o = open_ids.select("loc_id")
    sides = both.where("n = 1").join(o.withColumnRenamed("loc_id", "edge_a"), "edge_a", "left_semi").join(o.withColumnRenamed("loc_id", "edge_b"), "edge_b", "left_semi")
    null = lambda t: F.lit(None).cast(t)
    task = open_pts.select("loc_id", "x", "y", null("long").alias("edge_a"), null("long").alias("edge_b")).unionByName(
        sides.select(null("long").alias("loc_id"), null("double").alias("x"), null("double").alias("y"), "edge_a", "edge_b")
    )
    rest = task.groupBy(F.lit("all")).applyInPandas(_rest, FACES)
    return stand.unionByName(rest).groupBy("v").agg(F.max("measure").alias("measure"))


def number_faces(faces: DataFrame) -> DataFrame:
    """faces with face_id 0, 1, ... in the order of v: counts by first vertex, then places within it."""
    from pyspark.sql import Window

    from .stats import running_total

    f = stash(faces.select("v", "measure", F.col("v")[0].alias("_v0")), "faces")
    base = running_total(f.groupBy("_v0").agg(F.count(F.lit(1)).alias("_n")), [], "_v0", "_n").select("_v0", "_before")
    place = F.row_number().over(Window.partitionBy("_v0").orderBy("v")) - 1
    return f.withColumn("_p", place).join(base, "_v0").select((F.col("_before") + F.col("_p")).cast("long").alias("face_id"), "v", "measure")


def face_edges(faces: DataFrame) -> DataFrame:
    """(face_id, edge_no, a, b, neigh): each side and the face across it, null at the hull."""
    k = F.array(*[F.struct(F.lit(i).alias("edge_no"), F.col("v")[i].alias("a"), F.col("v")[(i + 1) % 3].alias("b")) for i in range(3)])
    e = faces.select("face_id", F.explode(k).alias("e")).select("face_id", "e.edge_no", F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b"))
    pair = e.groupBy("a", "b").agg(F.min("face_id").alias("lo"), F.max("face_id").alias("hi"))
    out = e.join(pair, ["a", "b"])
    neigh = F.when(F.col("lo") == F.col("hi"), F.lit(None)).otherwise(F.when(F.col("face_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")))
    return out.select("face_id", "edge_no", "a", "b", neigh.alias("neigh"))


def with_corners(faces: DataFrame, locs: DataFrame, axes=("x", "y"), corners: int | None = None) -> DataFrame:
    """faces with x0, y0, x1, ... of their vertices: one join on the exploded vertices, then a pivot by place."""
    v = faces.select("face_id", F.posexplode("v").alias("k", "loc_id")).join(locs.select("loc_id", *axes), "loc_id")
    n = corners or (4 if len(axes) == 3 else 3)
    cols = [F.max(F.when(F.col("k") == i, F.col(a))).alias(f"{a}{i}") for i in range(n) for a in axes]
    return faces.join(v.groupBy("face_id").agg(*cols), "face_id")


def facets(faces: DataFrame) -> DataFrame:
    """(face_id, edge_no, a, b, c, neigh): each triangle of a tetrahedron and the one across it, null at the hull."""
    v = F.col("v")
    k = F.array(*[F.struct(F.lit(i).alias("edge_no"), F.array_sort(F.array(*[v[j] for j in range(4) if j != i])).alias("t")) for i in range(4)])
    e = faces.select("face_id", F.explode(k).alias("e")).select("face_id", "e.edge_no", F.col("e.t")[0].alias("a"), F.col("e.t")[1].alias("b"), F.col("e.t")[2].alias("c"))
    pair = e.groupBy("a", "b", "c").agg(F.min("face_id").alias("lo"), F.max("face_id").alias("hi"))
    neigh = F.when(F.col("lo") == F.col("hi"), F.lit(None)).otherwise(F.when(F.col("face_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")))
    return e.join(pair, ["a", "b", "c"]).select("face_id", "edge_no", "a", "b", "c", neigh.alias("neigh"))


def with_edge_lengths(faces: DataFrame, locs: DataFrame, space: bool = False) -> DataFrame:
    """faces with ``edges``: the lengths of their sides (of tetrahedra all six, in x, y and z)."""
    if space:
        f = with_corners(faces, locs, ("x", "y", "z"))
        far = lambda i, j: F.sqrt(sum((F.col(f"{a}{i}") - F.col(f"{a}{j}")) ** 2 for a in "xyz"))
        return f.withColumn("edges", F.array(*[far(i, j) for i in range(4) for j in range(i)]))
    f = with_corners(faces, locs)
    d = lambda i, j: F.sqrt((F.col(f"x{i}") - F.col(f"x{j}")) ** 2 + (F.col(f"y{i}") - F.col(f"y{j}")) ** 2)
    return f.withColumn("edges", F.array(d(0, 1), d(1, 2), d(2, 0)))


def vertex_links(faces: DataFrame) -> DataFrame:
    """(a, b) for vertices that share a side, both ways."""
    v = F.col("v")
    n = F.size("v")
    pairs = F.flatten(F.transform(v, lambda p: F.transform(F.filter(v, lambda q: q != p), lambda q: F.struct(p.alias("a"), q.alias("b")))))
    return faces.where(n > 1).select(F.explode(pairs).alias("e")).select("e.a", "e.b").distinct()


def _inner_cells(locs: DataFrame, faces: DataFrame, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Cells (loc_id, measure) that the box does not touch, and all dual sides (loc_id, neigh) of some length, in built-in functions.

    A triangle gives each corner what the perpendicular bisectors of its sides cut off, up to its circumcentre (signed).
    """
    f = with_corners(faces, locs)
    dot = lambda k, i, j: sum((F.col(f"{a}{i}") - F.col(f"{a}{k}")) * (F.col(f"{a}{j}") - F.col(f"{a}{k}")) for a in "xy")
    cot = lambda k, i, j: dot(k, i, j) / (2 * F.col("measure"))
    part = lambda i, j, k: (dot(i, j, j) * cot(k, i, j) + dot(i, k, k) * cot(j, i, k)) / 8
    bx, by, cx, cy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("x2") - F.col("x0"), F.col("y2") - F.col("y0")
    d = 2 * (bx * cy - cx * by)
    f = f.withColumn("ux", F.col("x0") + (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d)
    f = f.withColumn("uy", F.col("y0") + (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d)
    within = (F.col("ux") > box[0]) & (F.col("ux") < box[2]) & (F.col("uy") > box[1]) & (F.col("uy") < box[3])
    f = stash(f.where("measure > 0").select("v", "ux", "uy", within.alias("within"), F.array(part(0, 1, 2), part(1, 2, 0), part(2, 0, 1)).alias("part")), "corners")
    edge = F.explode(F.array(*[F.struct(F.col("v")[i].alias("a"), F.col("v")[j].alias("b")) for i, j in ((0, 1), (1, 2), (0, 2))])).alias("e")
    e = f.select(edge, "ux", "uy").groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("n"), (F.max("ux") - F.min("ux")).alias("w"), (F.max("uy") - F.min("uy")).alias("h"))
    e = stash(e.select("a", "b", "n", ((F.col("w") > 0) | (F.col("h") > 0)).alias("long")), "dual")
    hull = e.where("n = 1").select(F.explode(F.array("a", "b")).alias("loc_id")).distinct()
    corner = F.explode(F.arrays_zip(F.col("v").alias("loc_id"), F.col("part").alias("part"))).alias("c")
    cells = f.select(corner, "within").groupBy("c.loc_id").agg(F.sum("c.part").alias("measure"), F.bool_and("within").alias("within"))
    cells = cells.where("within").join(hull, "loc_id", "left_anti").select("loc_id", "measure")
    sides = e.where("long").select(F.explode(F.array(F.struct(F.col("a").alias("loc_id"), F.col("b").alias("neigh")), F.struct(F.col("b").alias("loc_id"), F.col("a").alias("neigh")))).alias("s"))
    return cells, sides.select("s.loc_id", "s.neigh")


def voronoi(locs: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (loc_id, measure, density, is_border) and their sides (loc_id, neigh).

    Cells are clipped to the points' box widened by one. A neighbour counts if
    its side is left after clipping. A cell without area gets the largest one.
    density = (1 + neighbours) / (area + neighbours' areas). Copies of a
    point have no cell. Cells inside the box come from their triangles; only
    those at the hull or with a corner beyond the box are clipped one by one.
    """
    x0, x1, y0, y1 = locs.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    box = (x0 - 1, y0 - 1, x1 + 1, y1 + 1)
    at = locs.select("loc_id", "x", "y")
    inner, dual = _inner_cells(at, faces, box)
    inner = stash(inner, "inner")
    link = vertex_links(faces).join(inner.select(F.col("loc_id").alias("a")), "a", "left_anti")
    link = link.join(at.select(F.col("loc_id").alias("b"), F.col("x").alias("nx"), F.col("y").alias("ny")), "b")
    star = link.groupBy(F.col("a").alias("loc_id")).agg(F.sort_array(F.collect_list(F.struct("b", "nx", "ny"))).alias("star")).join(at, "loc_id")
    star = star.select("loc_id", "x", "y", F.col("star.b").alias("b"), F.col("star.nx").alias("nx"), F.col("star.ny").alias("ny"))

    def work(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                area, left, cut = clip_cell(r.x, r.y, r.nx, r.ny, box)
                rows.append((r.loc_id, area, [int(r.b[k]) for k in left], cut))
            yield pd.DataFrame(rows, columns=["loc_id", "measure", "neigh", "is_border"])

    outer = stash(star.mapInPandas(work, "loc_id long, measure double, neigh array<long>, is_border boolean"), "outer")
    raw = inner.select("loc_id", "measure", F.lit(False).alias("is_border")).unionByName(outer.drop("neigh"))
    largest = raw.agg(F.max("measure")).first()[0]
    cells = raw.withColumn("measure", F.when(F.col("measure") > 0, F.col("measure")).otherwise(F.lit(largest)))
    sides = dual.join(inner.select("loc_id"), "loc_id", "left_semi").unionByName(outer.select("loc_id", F.explode("neigh").alias("neigh")))
    sides = stash(sides, "sides")
    near = sides.join(cells.select(F.col("loc_id").alias("neigh"), F.col("measure").alias("m")), "neigh")
    near = near.groupBy("loc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("m"))
    out = cells.join(near, "loc_id", "left")
    density = (1 + F.coalesce("k", F.lit(0))) / (F.col("measure") + F.coalesce("m", F.lit(0.0)))
    return out.select("loc_id", "measure", density.alias("density"), "is_border"), sides


def delaunay3(locs: DataFrame) -> DataFrame:
    """(face_id, v, measure): tetrahedra of points (loc_id, x, y, z) and volumes; one task, for sets of some thousand points."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("loc_id", kind="stable").drop_duplicates(["x", "y", "z"])
        p, ids = pdf[["x", "y", "z"]].to_numpy(float), pdf["loc_id"].to_numpy()
        t = delaunay_3d(p)
        vol = np.abs(np.linalg.det(p[t[:, 1:]] - p[t[:, :1]])) / 6 if len(t) else np.zeros(0)
        return pd.DataFrame({"v": pd.Series(np.sort(ids[t], 1).tolist(), dtype=object), "measure": vol})

    return number_faces(locs.select("loc_id", "x", "y", "z").groupBy(F.lit("all")).applyInPandas(work, FACES))


def voronoi3(locs: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of points in space, clipped to the box widened by a hundredth of its least side; cells and sides as in the plane."""
    ends = locs.agg(*[f(a) for a in "xyz" for f in (F.min, F.max)]).first()
    lo, hi = np.array(ends[0::2], float), np.array(ends[1::2], float)
    pad = float((hi - lo).min()) / 100 or 1e-9
    lo, hi = lo - pad, hi + pad
    at = locs.select("loc_id", "x", "y", "z")
    link = vertex_links(faces).join(at.select(F.col("loc_id").alias("b"), *[F.col(a).alias(f"n{a}") for a in "xyz"]), "b")
    star = link.groupBy(F.col("a").alias("loc_id")).agg(F.sort_array(F.collect_list(F.struct("b", "nx", "ny", "nz"))).alias("s")).join(at, "loc_id")
    star = star.select("loc_id", "x", "y", "z", *[F.col(f"s.{c}").alias(c) for c in ("b", "nx", "ny", "nz")])

    def work(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                vol, left, cut = clip_polyhedron(np.array([r.x, r.y, r.z]), np.stack([r.nx, r.ny, r.nz], 1), lo, hi)
                rows.append((r.loc_id, vol, [int(r.b[k]) for k in left], cut))
            yield pd.DataFrame(rows, columns=["loc_id", "measure", "neigh", "is_border"])

    raw = stash(star.mapInPandas(work, "loc_id long, measure double, neigh array<long>, is_border boolean"), "cells")
    largest = raw.agg(F.max("measure")).first()[0]
    cells = raw.withColumn("measure", F.when(F.col("measure") > 0, F.col("measure")).otherwise(F.lit(largest)))
    sides = raw.select("loc_id", F.explode("neigh").alias("neigh"))
    near = sides.join(cells.select(F.col("loc_id").alias("neigh"), F.col("measure").alias("m")), "neigh").groupBy("loc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("m"))
    density = (1 + F.coalesce("k", F.lit(0))) / (F.col("measure") + F.coalesce("m", F.lit(0.0)))
    return cells.join(near, "loc_id", "left").select("loc_id", "measure", density.alias("density"), "is_border"), sides


def delaunay_on_sphere(locs: DataFrame, centre: tuple[float, float, float] | None = None, radius: float | None = None, task_points: int = 4 * TASK_POINTS) -> DataFrame:
    """(face_id, v, measure): triangulation of points projected on their sphere = faces of the projected points' hull.

    Up to task_points one task makes the hull's planar image; more go in tiles, as in the plane: seen from one of the points
    (the one farthest to z, by smallest id), the sphere is a plane where circles stay circles. Its triangulation are the faces
    without that point, and the point makes one more face with each side of the plane's hull. Copies have no faces.
    """
    from .fit import sphere_fit

    if centre is None or radius is None:
        s = sphere_fit(locs).first()
        centre, radius = (s["cx"], s["cy"], s["cz"]), s["r"]
    c = {a: F.col(a) - F.lit(float(m)) for a, m in zip("xyz", centre, strict=True)}
    norm = F.nullif(F.sqrt(sum(v * v for v in c.values())), F.lit(0.0))  # a point at the centre has no place on the sphere
    on = locs.select(F.col("loc_id").cast("long").alias("loc_id"), *[(v / norm).alias(a) for a, v in c.items()]).where("x * x + y * y + z * z > 0.5")
    on = stash(on.groupBy("x", "y", "z").agg(F.min("loc_id").alias("loc_id")), "sphere")
    top = on.agg(F.max(F.struct("z", -F.col("loc_id"), "x", "y")).alias("t")).first()["t"]
    if top is None:
        return number_faces(on.select(F.array("loc_id").alias("v"), F.lit(0.0).alias("measure")))
    pole, n = -top[1], np.array([top["x"], top["y"], top["z"]])
    u = np.cross(n, [1.0, 0.0, 0.0] if abs(n[0]) < 0.6 else [0.0, 1.0, 0.0])
    u /= np.linalg.norm(u)
    along = lambda d: sum(F.col(a) * F.lit(float(k)) for a, k in zip("xyz", d, strict=True))
    away = F.greatest(sum((F.col(a) - F.lit(float(k))) * (F.col(a) - F.lit(float(k))) for a, k in zip("xyz", n, strict=True)) / 2, F.lit(1e-300))  # 1 - cosine
    flat = stash(on.where(F.col("loc_id") != pole).select("loc_id", (along(u) / away).alias("x"), (along(np.cross(n, u)) / away).alias("y")), "plane")
    f = stash(_triangles(flat, task_points).select("v"), "plane")
    side = F.explode(F.array(*[F.struct(F.col("v")[i].alias("a"), F.col("v")[j].alias("b")) for i, j in ((0, 1), (1, 2), (0, 2))])).alias("e")
    rim = f.select(side).groupBy("e.a", "e.b").count().where("count = 1").select(F.array_sort(F.array("a", "b", F.lit(pole).cast("long"))).alias("v"))
    v = stash(f.select("v").unionByName(rim), "faces").withColumn("face_id", F.monotonically_increasing_id())
    g = with_corners(v, on.select("loc_id", *[(F.col(a) * radius).alias(a) for a in "xyz"]), ("x", "y", "z"), 3)
    d = [[F.col(f"{a}{i}") - F.col(f"{a}0") for a in "xyz"] for i in (1, 2)]
    cross = [d[0][i] * d[1][j] - d[0][j] * d[1][i] for i, j in ((1, 2), (2, 0), (0, 1))]
    return number_faces(g.select("v", (F.sqrt(sum(x * x for x in cross)) / 2).alias("measure")))


def voronoi_on_sphere(locs: DataFrame, faces: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Cells of points on a sphere about the origin: each face gives its corners what the perpendicular bisectors of
    its sides cut off (signed, up to its circumcentre); sides as in the plane; no border."""
    n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    f = with_corners(faces, locs.select("loc_id", *[(F.col(a) / n * radius).alias(a) for a in "xyz"]), ("x", "y", "z"))
    dot = lambda k, i, j: sum((F.col(f"{a}{i}") - F.col(f"{a}{k}")) * (F.col(f"{a}{j}") - F.col(f"{a}{k}")) for a in "xyz")
    cot = lambda k, i, j: dot(k, i, j) / (2 * F.col("measure"))
    part = lambda i, j, k: (dot(i, j, j) * cot(k, i, j) + dot(i, k, k) * cot(j, i, k)) / 8
    corner = [F.struct(F.col("v")[i].alias("loc_id"), part(i, j, k).alias("part")) for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]
    share = f.where("measure > 0").select(F.explode(F.array(*corner)).alias("e")).select("e.*")
    cells = share.groupBy("loc_id").agg(F.sum("part").alias("measure"))
    sides = vertex_links(faces).select(F.col("a").alias("loc_id"), F.col("b").alias("neigh"))
    near = sides.join(cells.select(F.col("loc_id").alias("neigh"), F.col("measure").alias("m")), "neigh").groupBy("loc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("m"))
    out = cells.join(near, "loc_id").select("loc_id", "measure", ((1 + F.col("k")) / (F.col("measure") + F.col("m"))).alias("density"), F.lit(False).alias("is_border"))
    return out, sides
