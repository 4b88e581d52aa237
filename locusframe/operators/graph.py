"""Connected components in written tables, and what is built on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stash

#: Up to so many links, components are found in one task; more, in rounds over written tables.
ONE_TASK = 300_000


def _in_one(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest reachable vertex by hooking and pointer jumping on arrays."""
    v, ends = np.unique(pdf[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    p = np.arange(len(v))
    while True:
        pa, pb = p[a], p[b]
        apart = pa != pb
        if not apart.any():
            return pd.DataFrame({"v": v, "label": v[p]})
        np.minimum.at(p, np.maximum(pa[apart], pb[apart]), np.minimum(pa[apart], pb[apart]))
        while (p != p[p]).any():
            p = p[p]


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(v, label): each vertex of the links (a, b) and the smallest vertex of its component.

    Each round hangs a vertex under its smallest neighbour, flattens the trees
    by pointer jumping and contracts the links, which at least halves the
    vertices that still have links. Every round is a written table. A set of
    links of checked small size (one_task; 0: never) is settled in one task instead.
    """
    edges = stash(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b"), "links")
    if one_task and edges.count() <= one_task:
        return edges.groupBy(F.lit("all")).applyInPandas(_in_one, "v long, label long")
    edges = stash(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label: DataFrame | None = None
    while not edges.isEmpty():
        tree = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")).select(F.col("a").alias("v"), "p")
        tree = stash(tree, "tree")
        while True:
            up = tree.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            higher = stash(tree.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "tree")
            tree, moved = higher.select("v", "p"), not higher.where("moved").isEmpty()
            if not moved:
                break
        if label is None:
            label = tree.withColumnRenamed("p", "label")
        else:
            root = tree.select(F.col("v").alias("label"), "p")
            label = label.join(root, "label", "left").select("v", F.coalesce("p", "label").alias("label"))
        ends = [tree.select(F.col("v").alias(x), F.col("p").alias(f"p{x}")) for x in "ab"]
        edges = edges.join(ends[0], "a").join(ends[1], "b").where("pa != pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        edges = stash(edges.distinct(), "edges")
        label = stash(label, "labels")
    return label if label is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("label"))


def clusters(vertices: DataFrame, links: DataFrame, min_size: int = 1, max_size: int | None = None, key: str = "loc_id") -> DataFrame:
    """(key, cluster): components of the vertices over the links; cluster is the smallest member, null if its size is out of range."""
    comp = components(links)
    v = vertices.select(key).join(comp, F.col(key) == F.col("v"), "left").select(key, F.coalesce("label", key).alias("cluster"))
    size = v.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    ok = F.col("_n") >= min_size
    if max_size is not None:
        ok = ok & (F.col("_n") <= max_size)
    return v.join(size, "cluster").select(key, F.when(ok, F.col("cluster")).alias("cluster"))


def pixel_links(pixels: DataFrame, diagonal: bool = True) -> DataFrame:
    """Links between neighbouring pixels (x, y[, z], id): 8 (26) neighbours, or 4 (6) without diagonals."""
    axes = [a for a in ("x", "y", "z") if a in pixels.columns]
    steps = [()]
    for _ in axes:
        steps = [(*s, d) for s in steps for d in (-1, 0, 1)]
    steps = [s for s in steps if s > tuple(0 for _ in axes) and (diagonal or sum(map(abs, s)) == 1)]
    shifts = F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(axes, s, strict=True)]) for s in steps])
    moved = pixels.select(F.col("id").alias("a"), *axes, F.explode(shifts).alias("s"))
    moved = moved.select("a", *[(F.col(a) + F.col(f"s.{a}")).alias(a) for a in axes])
    return moved.join(pixels.select(F.col("id").alias("b"), *axes), axes).select("a", "b")


def image_components(pixels: DataFrame, lo: float, hi: float, diagonal: bool = True) -> DataFrame:
    """Connected regions of pixels (x, y[, z], value) within lo..hi: adds label 1, 2, ... in the order of first pixels."""
    from .stats import relabel

    axes = [a for a in ("z", "y", "x") if a in pixels.columns]
    kept = pixels.where(F.col("value").between(lo, hi))
    code = None
    for a in axes:  # a pixel's number in scan order
        code = F.col(a).cast("long") if code is None else code * (1 << 20) + F.col(a)
    kept = stash(kept.withColumn("id", code), "pixels")
    out = clusters(kept, pixel_links(kept, diagonal), key="id")
    out = relabel(out, "cluster", "label").select("id", (F.col("label") + 1).alias("label"))
    return kept.join(out, "id").drop("id")


def label_sizes(labels: DataFrame) -> DataFrame:
    """Pixels for each label, background 0 left out."""
    return labels.where("label > 0").groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def merge_segments(ends: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(segment_id, skeleton): segments whose ends lie closer than the tolerance. ends: segment_id, x, y, z, two rows each."""
    from .spatial import pairs_within

    pts = ends.select(F.col("segment_id").alias("loc_id"), "x", "y", "z")
    near = pairs_within(pts, pts, tolerance, strict=True, axes=("x", "y", "z"))
    links = near.where("a < b").select("a", "b").distinct()
    return clusters(ends.select("segment_id").distinct(), links, key="segment_id").withColumnRenamed("cluster", "skeleton")
