"""Tracks and blinking: step lengths, displacement curves, frame linking, photophysics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import fits, stash

#: So many points are compared with their whole next frame.
LAST = 1_000


def steps(points: DataFrame, axes=("x", "y")) -> DataFrame:
    """points (track_id, seq, axes) with ``step``: the distance from the point before, null at the start."""
    w = Window.partitionBy("track_id").orderBy("seq")
    d2 = None
    for a in axes:
        t = (F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w))
        d2 = t if d2 is None else d2 + t
    return points.withColumn("step", F.sqrt(d2))


def track_features(points: DataFrame, axes=("x", "y")) -> DataFrame:
    """(track_id, n, length, t0)."""
    frame = F.col("frame") if "frame" in points.columns else F.col("seq")
    s = steps(points, axes).withColumn("_f", frame)
    return s.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.min("_f").alias("t0"))


def displacement(points: DataFrame, max_lag: int | None = None, axes=("x", "y")) -> DataFrame:
    """(track_id, lag, mean_displacement, msd) for all lags (up to max_lag): mean distance, and its square's mean."""
    lo = points.select("track_id", F.col("seq").alias("s0"), *[F.col(a).alias(f"{a}0") for a in axes])
    hi = points.select("track_id", F.col("seq").alias("s1"), *[F.col(a).alias(f"{a}1") for a in axes])
    if max_lag is not None:  # an equi-join on the later point instead of all pairs of a track
        lo = lo.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).withColumn("s1", F.col("s0") + F.col("lag"))
        pairs = lo.join(hi, ["track_id", "s1"])
    else:
        pairs = lo.join(hi, "track_id").where("s1 > s0").withColumn("lag", F.col("s1") - F.col("s0"))
    d2 = None
    for a in axes:
        t = (F.col(f"{a}1") - F.col(f"{a}0")) * (F.col(f"{a}1") - F.col(f"{a}0"))
        d2 = t if d2 is None else d2 + t
    return pairs.groupBy("track_id", "lag").agg(F.avg(F.sqrt(d2)).alias("mean_displacement"), F.avg(d2).alias("msd"))


def diffusion(points: DataFrame, lags: int = 4, axes=("x", "y")) -> DataFrame:
    """(track_id, diffusion): slope of the line through the first lags of the displacement curve."""
    d = displacement(points, lags, axes)
    return d.groupBy("track_id").agg(F.regr_slope("mean_displacement", F.col("lag").cast("double")).alias("diffusion"))


def run_starts(points: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """points with ``run``: 1, 2, ... counting changes of value in order."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return points.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def photophysics(frames: DataFrame, key: str = "emitter_id") -> DataFrame:
    """Per emitter, from its frames: total_on, n_on, n_off, blinks, total_off, lifetime."""
    f = frames.select(key, F.col("frame").cast("long").alias("frame")).distinct()
    w = Window.partitionBy(key).orderBy("frame")
    gap = F.col("frame") - F.lag("frame").over(w) - 1
    g = f.withColumn("gap", F.coalesce(gap, F.lit(0)))
    off = F.sum(F.when(F.col("gap") > 0, 1).otherwise(0))
    return g.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_on"), (off + 1).alias("n_on"), off.alias("n_off"), off.alias("blinks"),
        F.sum("gap").alias("total_off"), (F.max("frame") - F.min("frame") + 1).alias("lifetime"),
    )


def next_frame_nearest(locs: DataFrame, axes=("x", "y"), reach: float | None = None) -> DataFrame:
    """(loc_id, other, distance): each point's nearest one in the next frame that has any.

    Frames are numbered over their distinct values, and the join is by frame
    and grid cell. Without a reach, cells begin as wide as a frame's mean point
    distance and double for the points that found none; the last few are
    compared with their whole next frame.
    """
    from .stats import relabel

    f = relabel(locs.select("frame").distinct(), "frame", "f")
    p = stash(locs.select("loc_id", "frame", *axes).join(f, "frame"), "frames")
    a = p.select("loc_id", F.col("f").alias("fa"), *axes)
    b = p.select(F.col("loc_id").alias("other"), (F.col("f") - 1).alias("fa"), *[F.col(c).alias(f"{c}_b") for c in axes])

    def best(a: DataFrame, r: float | None) -> DataFrame:
        on, q, d2 = ["fa"], b, None
        for c in axes:
            if r is not None:
                a = a.withColumn(f"c{c}", F.floor(F.col(c) / r))
                q = q.withColumn(f"c{c}", F.explode(F.array(*[F.floor(F.col(f"{c}_b") / r) + d for d in (-1, 0, 1)])))
                on.append(f"c{c}")
            t = (F.col(c) - F.col(f"{c}_b")) * (F.col(c) - F.col(f"{c}_b"))
            d2 = t if d2 is None else d2 + t
        near = a.join(q, on).withColumn("d2", d2)
        if r is not None:
            near = near.where(F.col("d2") <= r * r)
        g = near.groupBy("loc_id").agg(F.min(F.struct("d2", "other")).alias("m"))
        return g.select("loc_id", F.col("m.other").alias("other"), F.sqrt("m.d2").alias("distance"))

    if reach is not None:
        return best(a, reach)
    n, frames, *ends = p.agg(F.count(F.lit(1)), F.max("f"), *[F.max(c) - F.min(c) for c in axes]).first()
    if not n or not frames:
        return best(a.limit(0), None)
    open_points = a.where(F.col("fa") < frames).dropna(subset=list(axes))
    r = max(max(float(e) for e in ends) / max(1.0, n / (frames + 1)) ** (1 / len(axes)), 1e-9)
    out = None
    while True:
        got = stash(best(open_points, None if fits(open_points, LAST) else r), "nearest")
        out = got if out is None else out.unionByName(got)
        open_points = stash(open_points.join(got.select("loc_id"), "loc_id", "left_anti"), "open")
        if open_points.isEmpty():
            return out
        r *= 2


def _link_block(pdf: pd.DataFrame, radius: float, max_dark: int) -> pd.DataFrame:
    """Greedy linking in file order within one block of points that may depend on each other."""
    pdf = pdf.sort_values(["frame", "loc_id"], kind="stable")
    frame, x, y = pdf["frame"].to_numpy(), pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
    ids = pdf["loc_id"].to_numpy()
    used = np.zeros(len(pdf), bool)
    emitter = np.zeros(len(pdf), np.int64)
    values, first = np.unique(frame, return_index=True)
    last = np.append(first[1:], len(pdf))
    index = {int(v): (int(a), int(b)) for v, a, b in zip(values, first, last, strict=True)}
    for i in range(len(pdf)):
        if used[i]:
            continue
        used[i], emitter[i] = True, ids[i]
        bx, by, at = x[i], y[i], int(frame[i])
        seen = at
        while at - seen <= max_dark:
            at += 1
            if at - seen > max_dark + 1 or at > values[-1]:
                break
            if at not in index:
                continue
            a, b = index[at]
            free = np.flatnonzero(~used[a:b]) + a
            if not len(free):
                continue
            d2 = (x[free] - bx) ** 2 + (y[free] - by) ** 2
            k = int(np.argmin(d2))
            if d2[k] < radius * radius:
                j = int(free[k])
                used[j], emitter[j] = True, ids[i]
                bx, by = (bx + x[j]) / 2, (by + y[j]) / 2
                seen = at
    return pd.DataFrame({"loc_id": ids, "emitter_id": emitter})


def link_frames(locs: DataFrame, radius: float = 50.0, max_dark: int = 10) -> DataFrame:
    """(loc_id, emitter_id): points of later frames joined to the emitter whose running centre is nearest.

    Greedy in the order (frame, loc_id); strictly within the radius of the
    running centre (c + p) / 2; at most max_dark frames without a point between
    two. A step never spans more than the radius from a centre, and the centre
    lies within the radius of the last point taken, so two points that can
    follow each other are less than 2 * radius apart and at most max_dark + 1
    frames. Blocks are components of that relation, found by a grid join; each
    one is linked by itself, and blocks do not depend on each other.
    """
    from .graph import clusters

    reach = 2 * radius
    p = locs.select("loc_id", "x", "y", F.col("frame").cast("long").alias("frame"))
    span = max_dark + 1
    a = p.select(F.col("loc_id").alias("a"), "x", "y", "frame").withColumns({"cx": F.floor(F.col("x") / reach), "cy": F.floor(F.col("y") / reach), "cf": F.floor(F.col("frame") / span)})
    b = p.select(F.col("loc_id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("frame").alias("fb"))
    b = b.withColumn("cx", F.explode(F.array(*[F.floor(F.col("xb") / reach) + d for d in (-1, 0, 1)])))
    b = b.withColumn("cy", F.explode(F.array(*[F.floor(F.col("yb") / reach) + d for d in (-1, 0, 1)])))
    b = b.withColumn("cf", F.explode(F.array(*[F.floor(F.col("fb") / span) - d for d in (0, 1)])))
    d2 = (F.col("x") - F.col("xb")) ** 2 + (F.col("y") - F.col("yb")) ** 2
    links = a.join(b, ["cx", "cy", "cf"]).where((d2 < reach * reach) & F.expr(f"fb > frame and fb - frame <= {span}"))
    # Points of one frame compete for the same later ones; those are linked through them.
    block = clusters(p, stash(links.select("a", "b"), "links"))
    with_block = stash(p.join(block, "loc_id"), "blocks")

    # A block of one point is an emitter by itself. The others are dealt out many to a task and linked
    # together: points of different blocks are never near enough to be taken for one another.
    size = with_block.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sized = stash(with_block.join(size, "cluster"), "sized")
    parts = max(1, min(4096, 1 + sized.where("n > 1").count() // 2000))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return _link_block(pdf, radius, max_dark)

    many = sized.where("n > 1").withColumn("part", F.pmod(F.xxhash64("cluster"), F.lit(parts))).select("part", "loc_id", "x", "y", "frame")
    linked = many.groupBy("part").applyInPandas(work, "loc_id long, emitter_id long")
    alone = sized.where("n = 1").select(F.col("loc_id").cast("long").alias("loc_id"), F.col("loc_id").cast("long").alias("emitter_id"))
    return linked.unionByName(alone)


def merged_features(locs: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each emitter: barycentre, first frame, photophysics, summed intensity."""
    j = locs.join(links, "loc_id")
    aggs = [F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("frame").alias("frame"), F.count(F.lit(1)).alias("n_locs")]
    if "intensity" in locs.columns:
        aggs.append(F.sum("intensity").alias("intensity"))
    return j.groupBy("emitter_id").agg(*aggs).join(photophysics(j), "emitter_id")


def blink_histograms(links: DataFrame, locs: DataFrame) -> DataFrame:
    """(kind, value, count): distribution of blinks per emitter and of lengths of on and off runs."""
    f = locs.join(links, "loc_id").select("emitter_id", F.col("frame").cast("long").alias("frame")).distinct()
    w = Window.partitionBy("emitter_id").orderBy("frame")
    g = f.withColumn("gap", F.coalesce(F.col("frame") - F.lag("frame").over(w) - 1, F.lit(0)))
    g = g.withColumn("run", F.sum(F.when(F.col("gap") > 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    on = g.groupBy("emitter_id", "run").count().select(F.lit("on").alias("kind"), F.col("count").alias("value"))
    off = g.where("gap > 0").select(F.lit("off").alias("kind"), F.col("gap").alias("value"))
    blinks = g.groupBy("emitter_id").agg(F.max("run").alias("value")).select(F.lit("blinks").alias("kind"), "value")
    return on.unionByName(off).unionByName(blinks).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("count"))


def link_totals(locs: DataFrame, links: DataFrame) -> DataFrame:
    """original, emitters, suppressed points and single (uncorrected) emitters."""
    per = links.groupBy("emitter_id").count()
    return per.agg(
        F.sum("count").alias("original"), F.count(F.lit(1)).alias("emitters"), (F.sum("count") - F.count(F.lit(1))).alias("suppressed"),
        F.sum(F.when(F.col("count") == 1, 1).otherwise(0)).alias("uncorrected"),
    )
