import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import columns as C
from locusframe.operators import fit, roi, select, stats, tracks
from locusframe.operators import coloc as K


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def P(*v):
    return tuple(F.lit(float(x)) for x in v)


def col(spark, values, name="v"):
    return spark.createDataFrame([(float(x),) for x in values], f"{name} double")


def test_triangle_345(spark):
    a, b, c = P(0, 0), P(3, 0), P(0, 4)
    got = one(spark, C.heron_area(*P(3, 4, 5)), C.cross_area(a, b, c), C.in_triangle(P(1, 1), a, b, c), C.in_triangle(P(3, 4), a, b, c), C.in_triangle(P(0, 0), a, b, c))
    assert got == [6.0, 6.0, True, False, True]


def test_space_predicates(spark):
    t = [P(0, 0, 0), P(1, 0, 0), P(0, 1, 0), P(0, 0, 1)]
    got = one(spark, C.in_tetrahedron(P(0.1, 0.1, 0.1), *t), C.in_tetrahedron(P(1, 1, 1), *t), C.tetra_volume(*t))
    assert got[:2] == [True, False] and got[2] == pytest.approx(1 / 6)


def test_segments_lines_circles(spark):
    got = one(
        spark, C.segments_meet(P(0, 0), P(2, 2), P(0, 2), P(2, 0)), C.segments_meet(P(0, 0), P(1, 1), P(2, 2), P(3, 3)), C.lines_cross(P(0, 0), P(2, 2), P(0, 2), P(2, 0))[0],
        C.line_at(F.lit(3.0), P(0, 1), P(1, 2)), C.point_at(P(0, 0), P(3, 4), F.lit(10.0))[1], F.size(C.circle_segment_hits(P(0, 0), F.lit(1.0), P(-2, 0), P(2, 0))),
        C.circular_segment_area(*P(1, 0)), C.rect_in_circle(P(0, 0), F.lit(2.0), *P(-1, -1, 1, 1)),
    )
    assert got[:7] == pytest.approx([True, False, 1.0, 4.0, 8.0, 2, math.pi / 2]) and got[7]


def test_polygon_areas(spark):
    pts = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    assert one(spark, C.polygon_area(pts), C.polygon_fan_area(pts), C.polygon_perimeter(pts)) == pytest.approx([4, 4, 8])


def test_delete_keeps_last(spark):
    df = spark.range(1).withColumn("x", F.lit(1))
    assert C.list_features(C.delete_feature(df, "x")) == ["id"]
    with pytest.raises(ValueError):
        C.delete_feature(C.delete_feature(df, "x"), "id")


def test_five_numbers(spark):
    r = stats.stats(col(spark, [1, 2, 3, 4]), "v").first()
    assert (r["mean"], r["median"], r["min"], r["max"]) == (2.5, 3.0, 1.0, 4.0) and r["sigma"] == pytest.approx(math.sqrt(1.25))
    assert stats.true_median(col(spark, [1, 2, 3, 4]), "v") == 2.5


def test_empty_statistics(spark):
    e = col(spark, [])
    assert stats.stats(e, "v").first()["n"] == 0 and stats.true_median(e, "v") is None and stats.quantile(e, "v", 0.5) is None


def test_histogram_five(spark):
    h = stats.histogram(col(spark, range(5)), "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [1] * 5 and [r["centre"] for r in h] == [0.5, 1.5, 2.5, 3.5, 4.5]


def test_order_statistics_by_counting(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=5000), 2)
    got = stats.order_statistics(col(spark, v), [0, 1234, 2500, 4999], parts=16, small=50)
    assert got == {k: np.sort(v)[k] for k in (0, 1234, 2500, 4999)}


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, 30.0), (5, None)], "id int, v double")
    for method, want in (("average", [1, 2.5, 2.5, 4, None]), ("min", [1, 2, 2, 4, None]), ("max", [1, 3, 3, 4, None])):
        assert [r["rank"] for r in stats.rank(df, "v", method).orderBy("id").collect()] == want


def test_spearman_reversed(spark):
    df = spark.createDataFrame([("a", float(i), float(5 - i)) for i in range(1, 5)], "color string, x double, y double")
    assert K.spearman(df, "x", "y").first()["rho"] == pytest.approx(-1)


def test_manders(spark):
    df = spark.createDataFrame([("a", 2.0, "coloc"), ("a", 4.0, "coloc"), ("a", 6.0, "high_density"), ("a", 9.0, "background")], "color string, d1 double, class string")
    assert K.manders(df).first()["manders"] == 0.5


def test_conjunction(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (None, 25)], "a int, b int")
    assert select.select(df, {"a": (1, 2), "b": (20, 30)}).collect() == [(2, 20)]


def test_photophysics(spark):
    r = tracks.photophysics(spark.createDataFrame([(1, f) for f in (1, 2, 5, 6)], "emitter_id int, frame int")).first()
    assert [r[k] for k in ("total_on", "n_on", "n_off", "blinks", "total_off", "lifetime")] == [4, 2, 1, 1, 2, 6]


def test_track(spark):
    p = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(((0, 0), (3, 4), (3, 4)))], "track_id int, seq int, x double, y double")
    assert tracks.track_features(p).first()["length"] == 5
    assert {r["lag"]: r["mean_displacement"] for r in tracks.displacement(p).collect()} == {1: 2.5, 2: 5.0}


def test_regions(spark):
    rois = spark.createDataFrame(
        [(1, "polygon", [(0.0, 0.0, 0.0), (2.0, 0.0, 0.0), (2.0, 2.0, 0.0), (0.0, 2.0, 0.0)], None), (2, "sphere", [(9.0, 9.0, 9.0)], 1.0), (3, "line", [(0.0, 0.0, 0.0), (5.0, 5.0, 0.0)], None)],
        "roi_id int, kind string, pts array<struct<x:double,y:double,z:double>>, radius double",
    )
    locs = spark.createDataFrame([(1, 1.0, 1.0, 0.0), (2, 3.0, 1.0, 0.0), (3, 0.0, 0.0, 0.0), (4, 9.0, 9.0, 10.0), (5, 9.0, 9.0, 10.5)], "loc_id int, x double, y double, z double")
    assert {r["loc_id"]: r["roi"] for r in roi.first_roi(locs, rois).collect()} == {1: 1, 2: 0, 3: 1, 4: 2, 5: 0}


def test_fits(spark):
    t = np.arange(0, 30, 1.0)
    df = spark.createDataFrame([(float(a), float(2 + 5 * math.exp(-a / 4))) for a in t], "t double, y double")
    assert fit.curve_fit(df, "t", "y", fit.decay_half_life, (0, 1, 1)) == pytest.approx([2, 5, 4], rel=1e-5)
    rng = np.random.default_rng(3)
    u = rng.normal(size=(300, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    p = u * np.array([5, 3, 2]) + np.array([10, 20, 30])
    got = fit.ellipsoid_fit(spark.createDataFrame(p.tolist(), "x double, y double, z double"))
    assert got["centre"] == pytest.approx([10, 20, 30], abs=1e-6) and got["axes"] == pytest.approx([5, 3, 2], abs=1e-6)


def test_all_distance_modes(spark):
    d = F.array(F.lit(1.0), F.lit(3.0), F.lit(7.0))
    want = {
        "Norm-Self": [1 / 7, 3 / 7, 1], "Norm-FirstDiff": [1, 2], "Norm-MaxDiff": [0.5, 1], "Norm-MinDiff": [1, 2], "Norm-Diff": [2 / 7, 4 / 7], "Diff-Norm": [1 / 3, 2 / 3],
        "Raw-Differences": [2, 4], "Norm-Diffs-Only-NoRescale": [2, 4], "Raw-Distances": [1, 3, 7],
    }
    assert set(want) == set(fit.NORMALISATIONS)
    for mode, w in want.items():
        assert one(spark, fit.normalise_distances(d, mode))[0] == pytest.approx(w)
