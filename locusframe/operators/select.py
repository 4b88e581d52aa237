"""Selections: predicates over features, exact sampling, selections carried over to faces and objects."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Bounds = Mapping[str, tuple[float | None, float | None]]


def in_range(c: Column | str, lo: float | None, hi: float | None) -> Column:
    """lo <= v <= hi; an open end is None; null is outside."""
    c = F.col(c) if isinstance(c, str) else c
    tests = [c.isNotNull()]
    if lo is not None:
        tests.append(c >= F.lit(lo))
    if hi is not None:
        tests.append(c <= F.lit(hi))
    return reduce(lambda a, b: a & b, tests)


def predicate(bounds: Bounds, log: frozenset[str] | set[str] = frozenset()) -> Column:
    """All features within their bounds; those in ``log`` by their log10."""
    tests = [in_range(F.log10(F.col(k)) if k in log else F.col(k), lo, hi) for k, (lo, hi) in bounds.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def select(df: DataFrame, bounds: Bounds, log=frozenset()) -> DataFrame:
    return df.where(predicate(bounds, log))


def mark(df: DataFrame, bounds: Bounds, log=frozenset(), name: str = "selected") -> DataFrame:
    return df.withColumn(name, predicate(bounds, log))


def change_bounds(bounds: Bounds, feature: str, lo: float | None, hi: float | None) -> dict:
    """Bounds with those of one feature replaced."""
    return {**bounds, feature: (lo, hi)}


def reset_bounds(bounds: Bounds, feature: str) -> dict:
    return {k: v for k, v in bounds.items() if k != feature}


def invert(df: DataFrame, name: str = "selected") -> DataFrame:
    return df.withColumn(name, ~F.col(name))


def density_factor(df: DataFrame, factor: float, average: float, density: str = "density") -> DataFrame:
    """Rows of at least factor times the average density."""
    return df.where(F.col(density) >= F.lit(factor * average))


def cut_distance(faces: DataFrame, d: float, edges: str = "edges") -> DataFrame:
    """Faces all of whose edges are at most d long."""
    return faces.where(F.forall(edges, lambda e: e * e <= F.lit(d * d)))


def border_cells(cells: DataFrame) -> DataFrame:
    return cells.where("is_border")


def border_faces(face_edges: DataFrame) -> DataFrame:
    """Faces with a missing neighbour."""
    return face_edges.groupBy("face_id").agg(F.bool_or(F.col("neigh").isNull()).alias("b")).where("b").select("face_id")


def gather(df: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows by an index table (pos, key), order and repeats kept."""
    return index.join(df, key).orderBy("pos")


def keep_share(df: DataFrame, share: float, key: str, seed: int) -> DataFrame:
    """Exactly floor(n * share) rows, the same ones for one seed."""
    n = df.count()
    k = int(n * share)
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    if k >= n:
        return df
    return df.withColumn("_h", h).orderBy("_h", key).limit(k).drop("_h")


def faces_of_selected(faces: DataFrame, locs: DataFrame) -> DataFrame:
    """(face_id, selected): whether all vertices of a face are selected. faces: face_id, v; locs: loc_id, selected."""
    v = faces.select("face_id", F.explode("v").alias("loc_id"))
    return v.join(locs.select("loc_id", "selected"), "loc_id", "left").groupBy("face_id").agg(F.bool_and(F.coalesce("selected", F.lit(False))).alias("selected"))


def faces_of_labels(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """(face_id, label): the label on which all vertices agree, else null. labels: loc_id, label."""
    v = faces.select("face_id", F.explode("v").alias("loc_id")).join(labels, "loc_id", "left")
    one = (F.min("label") == F.max("label")) & (F.count("label") == F.count(F.lit(1)))
    return v.groupBy("face_id").agg(F.when(one, F.min("label")).alias("label"))


def select_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def locs_of_objects(locs: DataFrame, object_locs: DataFrame, objects: DataFrame, density: DataFrame | None = None) -> DataFrame:
    """Localizations of the given objects, with their density where there is one."""
    out = locs.join(object_locs.join(objects.select("object_id"), "object_id", "left_semi"), "loc_id")
    return out if density is None else out.join(density.select("loc_id", "density"), "loc_id", "left")


def object_filter(objects: DataFrame, min_locs=None, max_locs=None, min_area=None, max_area=None, area: str = "measure") -> DataFrame:
    return objects.where(predicate({"n_locs": (min_locs, max_locs), area: (min_area, max_area)}))


def envelope(df: DataFrame, feature: str, share: float, key: str) -> DataFrame:
    """The floor(n * share) rows of smallest feature."""
    k = int(df.where(F.col(feature).isNotNull()).count() * share)
    return df.where(F.col(feature).isNotNull()).orderBy(feature, key).limit(k)


def crop(df: DataFrame, box: Mapping[str, tuple[float, float]], strict: bool = False) -> DataFrame:
    """Rows inside a box, borders in (or out, if strict)."""
    if not strict:
        return df.where(predicate(box))
    return df.where(reduce(lambda a, b: a & b, [(F.col(c) > lo) & (F.col(c) < hi) for c, (lo, hi) in box.items()]))


def threshold(df: DataFrame, lo: float, hi: float, value: str = "value") -> DataFrame:
    return df.where(in_range(value, lo, hi))


def labels_by_feature(pixels: DataFrame, features: DataFrame, feature: str, lo: float, hi: float) -> DataFrame:
    """Pixels (x, y, value: label) whose label's feature lies in range; the rest become 0."""
    ok = features.where(in_range(feature, lo, hi)).select(F.col("label").alias("value"), F.lit(True).alias("_ok"))
    return pixels.join(ok, "value", "left").withColumn("value", F.when(F.col("_ok"), F.col("value")).otherwise(0)).drop("_ok")
