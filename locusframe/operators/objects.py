"""Objects from faces, cells, labels and clusters, and what is measured on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stash
from .graph import clusters
from .kernels import Delaunay2D, bounding_ellipsoid, chain_edges, circumcircles, hull_2d, hull_3d, mesh_volume, pca, shoelace
from .stats import relabel
from .tess import face_edges, facets, with_edge_lengths

FWHM = 2.35


def objects_from_faces(faces: DataFrame, locs: DataFrame, cut_distance: float | None = None, min_locs: int = 3, max_locs: int | None = None,
                       min_area: float | None = None, max_area: float | None = None, rois: DataFrame | None = None) -> dict[str, DataFrame]:
    """objects (object_id, n_locs, measure, cx, cy), object_locs, object_faces, object_outline (object_id, a, b).

    Faces (in one region with all corners, if rois) whose sides are at most
    cut_distance long are joined over shared sides; objects out of range go.
    object_id is 1, 2, ... in the order of the smallest face. Tetrahedra are
    joined over shared triangles; objects then have a cz, outlines a corner c.
    """
    widths = [r[0] for r in faces.select(F.size("v")).distinct().limit(3).collect()]
    if len(widths) > 1:
        raise ValueError("triangles and tetrahedra in one set of faces")
    space = widths == [4]
    axes, ends = (("x", "y", "z"), ("a", "b", "c")) if space else (("x", "y"), ("a", "b"))
    if rois is not None:
        from .roi import matches

        inside = matches(locs, rois)
        v = faces.select("face_id", F.explode("v").alias("loc_id")).join(inside, "loc_id").groupBy("face_id", "roi_id").agg(F.count(F.lit(1)).alias("k"))
        faces = faces.join(v.where(F.col("k") == (4 if space else 3)).select("face_id").distinct(), "face_id", "left_semi")
    if cut_distance is not None:
        ok = F.forall("edges", lambda e: e * e <= F.lit(cut_distance**2))
        faces = with_edge_lengths(faces, locs, space).where(ok).select("face_id", "v", "measure")
    faces = stash(faces.select("face_id", "v", "measure"), "kept_faces")
    edges = stash((facets if space else face_edges)(faces), "face_edges")
    links = edges.where("neigh is not null and face_id < neigh").select(F.col("face_id").alias("a"), F.col("neigh").alias("b"))
    comp = clusters(faces, links, key="face_id")
    f = faces.join(comp, "face_id")
    member = f.select("cluster", F.explode("v").alias("loc_id")).distinct()
    size = member.join(locs.select("loc_id", *axes), "loc_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("n_locs"), *[F.avg(a).alias(f"c{a}") for a in axes])
    obj = f.groupBy("cluster").agg(F.sum("measure").alias("measure")).join(size, "cluster")
    from .select import object_filter

    obj = stash(object_filter(obj, min_locs, max_locs, min_area, max_area), "objects")
    obj = relabel(obj, "cluster", "object_id").withColumn("object_id", F.col("object_id") + 1)
    ids = stash(obj, "numbered")
    key = ids.select("cluster", "object_id")
    outline = edges.where("neigh is null").select("face_id", *ends).join(comp, "face_id").join(key, "cluster").select("object_id", *ends)
    return {
        "objects": ids.select("object_id", "n_locs", "measure", *[f"c{a}" for a in axes]),
        "object_locs": member.join(key, "cluster").select("object_id", "loc_id"),
        "object_faces": f.join(key, "cluster").select("object_id", "face_id"),
        "object_outline": outline,
    }


def objects_from_cells(cells: DataFrame, faces: DataFrame, locs: DataFrame, factor: float, average: float, **limits) -> dict[str, DataFrame]:
    """Objects of faces whose corners all have density >= factor * average."""
    from .select import faces_of_selected

    sel = cells.select("loc_id", (F.col("density") >= F.lit(factor * average)).alias("selected"))
    ok = faces_of_selected(faces, sel).where("selected").select("face_id")
    return objects_from_faces(faces.join(ok, "face_id", "left_semi"), locs, **limits)


def cluster_sweep(cells: DataFrame, sides: DataFrame, average: float, start: float = 1.0, stop: float = 2.0, step: float = 0.5, min_locs: int = 1, max_locs: int | None = None) -> DataFrame:
    """(factor, loc_id, cluster): components of dense cells over their sides for each factor; 0 for none."""
    out, f = None, start
    while f <= stop + 1e-9:
        dense = stash(cells.where(F.col("density") >= f * average).select("loc_id"), "dense")
        links = sides.where("loc_id < neigh").select(F.col("loc_id").alias("a"), F.col("neigh").alias("b"))
        links = links.join(dense.withColumnRenamed("loc_id", "a"), "a", "left_semi").join(dense.withColumnRenamed("loc_id", "b"), "b", "left_semi")
        c = relabel(clusters(dense, links, min_locs, max_locs), "cluster", "n").select("loc_id", F.coalesce(F.col("n") + 1, F.lit(0)).alias("cluster"))
        one = cells.select(F.lit(f).alias("factor"), "loc_id").join(c, "loc_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(0)))
        out = one if out is None else out.unionByName(one)
        f += step
    return out.select("factor", "loc_id", "cluster")


def _per_object(work, schema: str):
    def run(df: DataFrame) -> DataFrame:
        return df.groupBy("object_id").applyInPandas(work, f"object_id long, {schema}")

    return run


def convex_hulls(member: DataFrame) -> DataFrame:
    """(object_id, n_locs, measure): hull area of each object's points (object_id, x, y)."""

    def work(key, pdf):
        return pd.DataFrame([(key[0], len(pdf), shoelace(hull_2d(pdf[["x", "y"]].to_numpy(float))))], columns=["object_id", "n_locs", "measure"])

    return _per_object(work, "n_locs long, measure double")(member.select("object_id", "x", "y"))


#: How an object's shape is made from its points.
SHAPES = ("triangulation", "convex_hull", "alpha_shape")


def shapes(member: DataFrame, mode: str = "triangulation", alpha: float = float("inf")) -> DataFrame:
    """(object_id, n_locs, measure): area of each object's shape. alpha_shape: triangles with a circumradius up to alpha."""
    if mode not in SHAPES:
        raise ValueError(f"unknown shape {mode}")
    if mode == "convex_hull":
        return convex_hulls(member)

    def work(key, pdf):
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        t = Delaunay2D(x, y).triangles()
        a = np.abs((x[t[:, 1]] - x[t[:, 0]]) * (y[t[:, 2]] - y[t[:, 0]]) - (x[t[:, 2]] - x[t[:, 0]]) * (y[t[:, 1]] - y[t[:, 0]])) / 2 if len(t) else np.zeros(0)
        if mode == "alpha_shape" and len(t):
            a = a[circumcircles(x, y, t)[2] <= alpha]
        return pd.DataFrame([(key[0], len(pdf), float(a.sum()))], columns=["object_id", "n_locs", "measure"])

    return _per_object(work, "n_locs long, measure double")(member.select("object_id", "x", "y"))


def convex_hulls3(member: DataFrame) -> DataFrame:
    """(object_id, n_locs, measure): hull volume of each object's points (object_id, x, y, z)."""

    def work(key, pdf):
        p = pdf[["x", "y", "z"]].to_numpy(float)
        return pd.DataFrame([(key[0], len(pdf), mesh_volume(p - p.mean(0), hull_3d(p)))], columns=["object_id", "n_locs", "measure"])

    return _per_object(work, "n_locs long, measure double")(member.select("object_id", "x", "y", "z"))


def hull_outlines(member: DataFrame) -> DataFrame:
    """(object_id, seq, x, y): hull corners, counter-clockwise."""

    def work(key, pdf):
        h = hull_2d(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"object_id": key[0], "seq": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    return _per_object(work, "seq long, x double, y double")(member.select("object_id", "x", "y"))


def outline_rings(outline: DataFrame) -> DataFrame:
    """(object_id, ring, seq, loc_id): outline edges (object_id, a, b) chained to polygons."""

    def work(key, pdf):
        e = list(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True))
        link: dict[int, list[int]] = {}
        for a, b in sorted(e):
            link.setdefault(a, []).append(b)
            link.setdefault(b, []).append(a)
        directed = []
        while link:  # walk undirected edges into directed ones
            at = min(link)
            while link.get(at):
                to = link[at].pop(0)
                link[to].remove(at)
                directed.append((at, to))
                at = to
            link = {k: v for k, v in link.items() if v}
        rows = [(key[0], r, s, v) for r, ring in enumerate(chain_edges(directed)) for s, v in enumerate(ring)]
        return pd.DataFrame(rows, columns=["object_id", "ring", "seq", "loc_id"])

    return _per_object(work, "ring long, seq long, loc_id long")(outline)


def pca_2d(member: DataFrame) -> DataFrame:
    """(object_id, major, minor, size, circ, angle) of points (object_id, x, y), in built-in functions.

    The axis comes from the covariance sums; sigma is the population deviation
    of the unsigned distances to an axis; an axis length is 2 * 2.35 * sigma.
    """
    g = member.groupBy("object_id").agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("sxy"), F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy")
    )
    g = g.withColumn("angle", F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")) / 2)
    d = member.select("object_id", "x", "y").join(g, "object_id")
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    along = F.abs(dx * F.cos("angle") + dy * F.sin("angle"))
    across = F.abs(dy * F.cos("angle") - dx * F.sin("angle"))
    out = d.groupBy("object_id").agg((F.stddev_pop(along) * FWHM).alias("a"), (F.stddev_pop(across) * FWHM).alias("b"), F.max("angle").alias("angle"))
    major, minor = F.greatest("a", "b"), F.least("a", "b")
    return out.select(
        "object_id", (2 * major).alias("major"), (2 * minor).alias("minor"), ((major + minor)).alias("size"), F.when(major > 0, minor / major).alias("circ"), "angle"
    )


def pca_3d(member: DataFrame) -> DataFrame:
    """(object_id, major, minor, minor2, size) of points in space."""

    def work(key, pdf):
        p = pdf[["x", "y", "z"]].to_numpy(float)
        if len(p) < 2:
            return pd.DataFrame([(key[0], 0.0, 0.0, 0.0, 0.0)], columns=["object_id", "major", "minor", "minor2", "size"])
        c, axes = pca(p)
        s = np.sort(np.std(np.abs((p - c) @ axes.T), axis=0) * FWHM)[::-1]
        return pd.DataFrame([(key[0], *(2 * s), float(2 * s.mean()))], columns=["object_id", "major", "minor", "minor2", "size"])

    return _per_object(work, "major double, minor double, minor2 double, size double")(member.select("object_id", "x", "y", "z"))


def ellipses(member: DataFrame, axes=("x", "y")) -> DataFrame:
    """(object_id, cx, cy[, cz], semi-axes longest first) of the smallest enclosing ellipse or ellipsoid, within 1 %."""
    names = [f"c{a}" for a in axes] + [f"axis{i}" for i in range(len(axes))]

    def work(key, pdf):
        c, r = bounding_ellipsoid(pdf[list(axes)].to_numpy(float))
        return pd.DataFrame([(key[0], *c, *r)], columns=["object_id", *names])

    return _per_object(work, ", ".join(f"{n} double" for n in names))(member.select("object_id", *axes))


def features(objects: DataFrame, member: DataFrame) -> DataFrame:
    """object_id, n_locs, area, size, circ, major, minor."""
    return objects.select("object_id", "n_locs", F.col("measure").alias("area")).join(pca_2d(member).select("object_id", "size", "circ", "major", "minor"), "object_id")


def features_3d(objects: DataFrame, member: DataFrame, surface: DataFrame | None = None) -> DataFrame:
    out = objects.select("object_id", "n_locs", F.col("measure").alias("volume")).join(pca_3d(member), "object_id")
    return out if surface is None else out.join(surface, "object_id", "left")


def centroids(member: DataFrame, objects: DataFrame | None = None, axes=("x", "y")) -> DataFrame:
    """One row for each object: mean position, with the object's features."""
    c = member.groupBy("object_id").agg(*[F.avg(a).alias(a) for a in axes])
    return c if objects is None else c.join(objects, "object_id")


def _with_vertex(faces: DataFrame, vertices: DataFrame, k: str) -> DataFrame:
    """faces with xk, yk, zk of their vertex k. Vertices may come out of an explode, whose size Spark takes for that of its input: no broadcast by it."""
    v = vertices.select("mesh_id", F.col("vertex_id").alias(k), *[F.col(a).alias(f"{a}{k}") for a in "xyz"])
    return faces.join(v.hint("merge"), ["mesh_id", k])


def mesh_measures(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, n_vertices, volume, surface): vertices (mesh_id, vertex_id, x, y, z), faces (mesh_id, a, b, c); under 5 vertices: none."""
    n = vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_vertices")).where("n_vertices >= 5")
    f = faces
    for k in "abc":
        f = _with_vertex(f, vertices, k)
    vol = F.expr("(xa * (yb * zc - yc * zb) - ya * (xb * zc - xc * zb) + za * (xb * yc - xc * yb)) / 6")
    from ..functions.columns import cross3, length, sub

    c = lambda k: tuple(F.col(f"{a}{k}") for a in "xyz")
    area = length(cross3(sub(c("b"), c("a")), sub(c("c"), c("a")))) / 2
    return f.groupBy("mesh_id").agg(F.abs(F.sum(vol)).alias("volume"), F.sum(area).alias("surface")).join(n.hint("merge"), "mesh_id")


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, vertex_id, nx, ny, nz): unit mean of the normals of incident faces."""
    from ..functions.columns import cross3, sub, unit

    f = faces
    for k in "abc":
        f = _with_vertex(f, vertices, k)
    c = lambda k: tuple(F.col(f"{a}{k}") for a in "xyz")
    n = unit(cross3(sub(c("b"), c("a")), sub(c("c"), c("a"))))
    f = f.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vertex_id"), *[v.alias(k) for v, k in zip(n, ("nx", "ny", "nz"), strict=True)])
    m = f.groupBy("mesh_id", "vertex_id").agg(*[F.avg(k).alias(k) for k in ("nx", "ny", "nz")])
    u = unit((F.col("nx"), F.col("ny"), F.col("nz")))
    return m.select("mesh_id", "vertex_id", *[v.alias(k) for v, k in zip(u, ("nx", "ny", "nz"), strict=True)])


def skeleton_features(segments: DataFrame) -> DataFrame:
    """(skeleton_id, length, n): segments (skeleton_id, segment_id, seq, x, y, z)."""
    from pyspark.sql import Window

    w = Window.partitionBy("skeleton_id", "segment_id").orderBy("seq")
    d2 = sum(((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in "xyz"), F.lit(0.0))
    return segments.withColumn("d", F.sqrt(d2)).groupBy("skeleton_id").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length"), F.count(F.lit(1)).alias("n"))


def alpha_faces(faces: DataFrame, locs: DataFrame, alpha: float) -> DataFrame:
    """Faces whose circumradius is at most alpha: the alpha shape's interior."""
    f = with_edge_lengths(faces, locs)
    r = F.col("edges")[0] * F.col("edges")[1] * F.col("edges")[2] / (4 * F.col("measure"))
    return f.where((F.col("measure") > 0) & (r <= alpha)).select("face_id", "v", "measure")


def optimal_alpha(faces: DataFrame, locs: DataFrame) -> float:
    """The smallest alpha whose shape is one piece that holds every point, by bisection over circumradii."""
    f = with_edge_lengths(faces, locs).where("measure > 0")
    r = stash(f.select("face_id", "v", "measure", (F.col("edges")[0] * F.col("edges")[1] * F.col("edges")[2] / (4 * F.col("measure"))).alias("r")), "radii")
    n = r.select(F.explode("v")).distinct().count()
    lo, hi = r.agg(F.min("r"), F.max("r")).first()
    for _ in range(24):
        mid = (lo + hi) / 2
        kept = r.where(F.col("r") <= mid)
        one = kept.select(F.explode("v")).distinct().count() == n
        if one:
            e = face_edges(kept).where("neigh is not null and face_id < neigh").select(F.col("face_id").alias("a"), F.col("neigh").alias("b"))
            one = clusters(kept, e, key="face_id").select("cluster").distinct().count() == 1
        lo, hi = (lo, mid) if one else (mid, hi)
        if hi - lo <= 1e-6 * hi:
            break
    return hi
