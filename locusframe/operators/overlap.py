"""Overlaps of objects of two colours, from outlines or from polygons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stash
from . import objects, spatial, tess
from .kernels import clip_polygons, shoelace


def sample_outlines(outline: DataFrame, locs: DataFrame, step: float = 0.5) -> DataFrame:
    """(x, y): points along outline edges (object_id, a, b), ends included, at most ``step`` apart."""
    end = lambda k: locs.select(F.col("loc_id").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    e = outline.select("a", "b").distinct().join(end("a"), "a").join(end("b"), "b")
    n = F.greatest(F.lit(1), F.ceil(F.sqrt((F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2) / step)).cast("int")
    e = e.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), n)))
    t = F.col("i") / F.col("n")
    return e.select((F.col("xa") + (F.col("xb") - F.col("xa")) * t).alias("x"), (F.col("ya") + (F.col("yb") - F.col("ya")) * t).alias("y")).distinct()


def sample_surfaces(outline: DataFrame, locs: DataFrame, step: float = 0.5) -> DataFrame:
    """(x, y, z): points on outline triangles (object_id, a, b, c), corners included, at most ``step`` apart along their sides."""
    f = outline.select("a", "b", "c").distinct()
    for k in "abc":
        f = f.join(locs.select(F.col("loc_id").alias(k), *[F.col(c).alias(f"{c}{k}") for c in "xyz"]), k)
    side = lambda p, q: F.sqrt(sum((F.col(f"{c}{p}") - F.col(f"{c}{q}")) ** 2 for c in "xyz"))
    n = F.greatest(F.lit(1), F.ceil(F.greatest(side("a", "b"), side("b", "c"), side("c", "a")) / step)).cast("int")
    f = f.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), n))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("i"))))
    u, v = F.col("i") / F.col("n"), F.col("j") / F.col("n")
    return f.select(*[F.round(F.col(f"{c}a") * (1 - u - v) + F.col(f"{c}b") * u + F.col(f"{c}c") * v, 9).alias(c) for c in "xyz"]).distinct()


def object_colocalization(one: dict[str, DataFrame], two: dict[str, DataFrame], step: float = 0.5, min_points: int = 5) -> dict[str, DataFrame]:
    """Overlaps between the objects of two colours, both in the plane or both in space.

    one, two: locs, faces, object_faces and object_outline of each colour. The
    outlines are sampled and triangulated together; the faces whose centroid
    lies in an object of both colours are joined over shared sides, those of
    one pair of objects together. Gives overlaps (overlap_id, object1, object2,
    measure) of at least min_points corners, and overlap_faces. The samples of
    objects in space are triangulated in one task, and what of an overlap their
    tetrahedra cut off by other ones counts as an overlap of its own.
    """
    kinds = {r[0] for c in (one, two) for r in c["faces"].select(F.size("v")).distinct().limit(3).collect()}
    if len(kinds) > 1:
        raise ValueError("objects of two colours must have the same dimension")
    if kinds == {4}:
        return _together(one, two, [sample_surfaces(c["object_outline"], c["locs"], step) for c in (one, two)], "xyz", min_points)
    return _together(one, two, [sample_outlines(c["object_outline"], c["locs"], step) for c in (one, two)], "xy", min_points)


def _together(one: dict[str, DataFrame], two: dict[str, DataFrame], pts: list[DataFrame], axes: str, min_points: int) -> dict[str, DataFrame]:
    space = len(axes) == 3
    p = pts[0].unionByName(pts[1]).distinct()
    p = stash(p.withColumn("loc_id", F.abs(F.xxhash64(*axes))), "samples")
    faces = stash(tess.delaunay3(p) if space else tess.delaunay(p), "sample_faces")
    corner = tess.with_corners(faces, p, tuple(axes))
    k = len(axes) + 1
    centre = corner.select(F.col("face_id").alias("loc_id"), *[(sum(F.col(f"{c}{i}") for i in range(k)) / k).alias(c) for c in axes])
    centre = stash(centre, "centres")
    held = faces.select("face_id", "v", "measure")
    for k, c in enumerate((one, two), 1):
        f = tess.with_corners(c["faces"].join(c["object_faces"].select("face_id"), "face_id", "left_semi"), c["locs"], tuple(axes))
        at = (spatial.locate_in_space if space else spatial.locate)(centre, f).where("face_id is not null").withColumnRenamed("face_id", "f")
        obj = c["object_faces"].select(F.col("face_id").alias("f"), F.col("object_id").alias(f"object{k}"))
        held = held.join(at.join(obj, "f").select(F.col("loc_id").alias("face_id"), f"object{k}"), "face_id")
    held = stash(held, "shared_faces")
    edge = (tess.facets if space else tess.face_edges)(held.select("face_id", "v", "measure")).where("neigh is not null and face_id < neigh")
    who = held.select("face_id", "object1", "object2")
    same = edge.join(who, "face_id").join(who.select(F.col("face_id").alias("neigh"), F.col("object1").alias("p1"), F.col("object2").alias("p2")), "neigh")
    links = same.where("object1 = p1 and object2 = p2").select(F.col("face_id").alias("a"), F.col("neigh").alias("b"))
    from .graph import clusters

    comp = held.join(clusters(held, links, key="face_id"), "face_id")
    size = comp.select("cluster", F.explode("v").alias("p")).distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("n_locs"))
    over = comp.groupBy("cluster").agg(F.first("object1").alias("object1"), F.first("object2").alias("object2"), F.sum("measure").alias("measure"))
    over = stash(over.join(size.where(F.col("n_locs") >= min_points), "cluster"), "overlaps")
    from .stats import relabel

    ids = stash(relabel(over, "cluster", "overlap_id").withColumn("overlap_id", F.col("overlap_id") + 1), "numbered")
    return {
        "overlaps": ids.select("overlap_id", "object1", "object2", "measure"),
        "overlap_faces": comp.join(ids.select("cluster", "overlap_id"), "cluster").select("overlap_id", "face_id"),
    }


def polygon_intersections(one: DataFrame, two: DataFrame, cell: float) -> DataFrame:
    """(id1, id2, measure, parts): overlaps of simple polygons (id, pts array<struct<x,y>>), as convex pieces.

    Boxes meet in grid cells, an equi-join; each pair is clipped once.
    """

    def boxed(df: DataFrame, k: int) -> DataFrame:
        xs, ys = F.transform("pts", lambda p: p.x), F.transform("pts", lambda p: p.y)
        d = df.select(F.col("id").alias(f"id{k}"), F.col("pts").alias(f"pts{k}"), *[F.floor(f(v) / cell).alias(n) for n, f, v in (("a", F.array_min, xs), ("b", F.array_max, xs), ("c", F.array_min, ys), ("d", F.array_max, ys))])
        return d.withColumn("cx", F.explode(F.sequence("a", "b"))).withColumn("cy", F.explode(F.sequence("c", "d"))).drop("a", "b", "c", "d")

    pairs = boxed(one, 1).select("id1", "cx", "cy").join(boxed(two, 2).select("id2", "cx", "cy"), ["cx", "cy"]).select("id1", "id2").distinct()
    pairs = pairs.join(one.select(F.col("id").alias("id1"), F.col("pts").alias("p1")), "id1").join(two.select(F.col("id").alias("id2"), F.col("pts").alias("p2")), "id2")

    def work(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a, b = (np.array([(q["x"], q["y"]) for q in p], float) for p in (r.p1, r.p2))
                got = clip_polygons(a, b)
                if got:
                    rows.append((r.id1, r.id2, sum(map(shoelace, got)), [[{"x": float(x), "y": float(y)} for x, y in g] for g in got]))
            yield pd.DataFrame(rows, columns=["id1", "id2", "measure", "parts"]).astype({"id1": "int64", "id2": "int64", "measure": "float64"})

    schema = "id1 long, id2 long, measure double, parts array<array<struct<x:double,y:double>>>"
    return pairs.select(F.col("id1").cast("long"), F.col("id2").cast("long"), "p1", "p2").mapInPandas(work, schema)


def sampled_objects(locs: DataFrame, cut_distance: float, **limits) -> dict[str, DataFrame]:
    """locs, faces and objects of one colour, as object_colocalization takes them; in space if locs has z."""
    faces = stash(tess.delaunay3(locs) if "z" in locs.columns else tess.delaunay(locs), "faces")
    return {"locs": locs, "faces": faces, **objects.objects_from_faces(faces, locs, cut_distance, **limits)}
