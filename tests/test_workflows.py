"""Edge arcs by numbers, cells by nearest sites, macros of two colours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators import ripley, roi, tess
from locusframe.plans import macro
from locusframe.plans.views import pts

SF = "/root/testdata/sf0.001"


def test_edge_factors_are_shares_of_arcs(spark):
    """Circles that meet no edge, one, two adjacent ones, opposite ones, three and a corner."""
    box = (0.0, 0.0, 10.0, 4.0)
    rows = [(5.0, 2.0, 1.0), (5.0, 0.5, 1.0), (0.5, 0.5, 0.6), (0.5, 0.5, 1.0), (5.0, 2.0, 3.0), (1.0, 2.0, 3.0), (0.0, 0.0, 2.0), (9.0, 3.9, 3.5), (5.0, 1.0, 4.5)]
    df = spark.createDataFrame(rows, "x double, y double, r double")
    got = [v["f"] for v in df.select("x", "y", "r", ripley.edge_factor(F.col("x"), F.col("y"), F.col("r"), box).alias("f")).collect()]
    a = (np.arange(400_000) + 0.5) / 400_000 * 2 * np.pi
    for f, (x, y, r) in zip(got, rows, strict=True):
        px, py = x + r * np.cos(a), y + r * np.sin(a)
        assert f == pytest.approx(1 / ((px > box[0]) & (px < box[2]) & (py > box[1]) & (py < box[3])).mean(), rel=1e-4)


def test_cells_hold_what_is_nearest_to_their_site(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random((150, 2)) * 100, 2)
    locs = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "loc_id long, x double, y double")
    cells, sides = tess.voronoi(locs, tess.delaunay(locs))
    near = {i: [] for i in range(len(p))}
    for r in sides.collect():
        near[r["loc_id"]].append(r["neigh"])
    q = rng.random((4000, 2)) * 100
    d = ((q[:, None] - p[None]) ** 2).sum(2)
    site = d.argmin(1)
    for i in range(len(p)):  # nearer to i than to the neighbours of its cell: nearest of all
        inside = (d[:, [i]] <= d[:, near[i]]).all(1)
        assert (inside == (site == i)).all()
    lo, hi = p.min(0) - 1, p.max(0) + 1
    many = lo + rng.random((200_000, 2)) * (hi - lo)
    share = np.bincount(np.concatenate([((c[:, None] - p[None]) ** 2).sum(2).argmin(1) for c in np.array_split(many, 20)]), minlength=len(p)) / len(many)
    area = np.array([r["measure"] for r in cells.orderBy("loc_id").collect()]) / np.prod(hi - lo)
    assert np.abs(area - share).max() < 5 * np.sqrt(area.max() / len(many))


def test_two_colour_macro(spark):
    """Two Voronoi diagrams, paired densities, classes and coefficients in regions, then nearest distances of objects."""
    p = pts(spark, SF)
    f, o = (p.where(F.col("color") == c).drop("color") for c in "FO")
    d = macro.Dataset(spark, {"F": f, "O": o, "DetectionSet": f})
    d.tables["ROIs"] = spark.createDataFrame([(1, "rectangle", [(0.0, 0.0, 0.0), (500.0, 500.0, 0.0)], None), (2, "circle", [(500.0, 500.0, 0.0)], 300.0)], "roi_id int, kind string, pts array<struct<x:double,y:double,z:double>>, radius double")
    macro.run(
        d,
        '{"MainWindow": {"computeColocalization": {"datasetNames": ["F", "O"]}}}\n{"Colocalization": {"computeCoefficients": {"color1": 1.0, "color2": 1.0, "correction": true, "inROIs": true}}}\n'
        '{"DetectionSet": {"computeVoronoi": {}}}\n{"DelaunayTriangulation": {"applyCutDistance": {"distance": 60}}}\n{"DelaunayTriangulation": {"createFilteredObjects": {"cutDistance": 60, "minLocs": 5}}}\n'
        '{"ObjectList": {"computeNearestNeighMulticolor": {"reference": "O"}}}\n{"VoronoiDiagram": {"clustersForChallenge": {"from": 1.0, "to": 1.5, "step": 0.5, "minNbLocs": 3}}}',
    )
    paired = d.table("Colocalization")
    assert paired.count() == f.count() + o.count()
    c = {(r["roi"], r["color"]): r for r in d.table("Coefficients").collect()}
    inside = roi.matches(p, d.table("ROIs")).join(p.where("color in ('F', 'O')"), "loc_id").groupBy("roi_id", "color").count().collect()
    assert {(r["roi_id"], r["color"]): r["count"] for r in inside} == {k: r["n_background"] + r["n_high_density"] + r["n_coloc"] for k, r in c.items()}
    assert all(-1 <= r["rho"] <= 1 and (r["manders"] is None or 0 <= r["manders"] <= 1) for r in c.values())
    near = d.table("NearestDistances").collect()
    assert len(near) == d.table("ObjectList").count() > 0 and all(r["to_outline"] >= 0 for r in near)
    assert {r["factor"] for r in d.table("ClusterIndices").select("factor").distinct().collect()} == {1.0, 1.5}
    assert [s.command for s in d.record] == ["computeColocalization", "computeCoefficients", "computeVoronoi", "applyCutDistance", "createFilteredObjects", "computeNearestNeighMulticolor", "clustersForChallenge"]


def test_inverted_and_logarithmic_selection(spark):
    df = spark.createDataFrame([(i, float(10**i)) for i in range(5)], "loc_id long, x double")
    d = macro.run(macro.Dataset(spark, {"DetectionSet": df}), '{"DetectionSet": {"histogram": {"feature": "x", "action": "log", "value": true}}}\n{"DetectionSet": {"histogram": {"feature": "x", "min": 1, "max": 3}}}')
    assert sorted(r["loc_id"] for r in d.selected("DetectionSet").collect()) == [1, 2, 3]
    macro.run(d, '{"DetectionSet": {"invertSelection": {}}}')
    assert sorted(r["loc_id"] for r in d.selected("DetectionSet").collect()) == [0, 4]
    macro.run(d, '{"DetectionSet": {"invertSelection": {}}}\n{"DetectionSet": {"histogram": {"feature": "x", "action": "log", "value": false}}}')
    assert [r["loc_id"] for r in d.selected("DetectionSet").collect()] == [0]


def test_tiles_of_a_cluster_are_split(spark):
    """Points that nearly all lie in one tile give the triangulation that one task makes of them, and no tile keeps many."""
    rng = np.random.default_rng(3)
    p = np.round(np.vstack([rng.normal(size=(1500, 2)) * 0.3 + 50, rng.random((300, 2)) * 100, rng.normal(size=(700, 2)) * 0.01 + 20, np.full((40, 2), 7.0)]), 5)
    locs = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "loc_id long, x double, y double")
    dealt = tess.tiles(locs, 20.0, 5.0, 60)
    counts = [r["count"] for r in dealt.groupBy("x0", "y0", "side").count().collect()]
    assert max(counts) <= 240 and len(counts) > 20
    whole = {tuple(r["v"]) for r in tess.delaunay(locs).collect()}
    assert {tuple(r["v"]) for r in tess.delaunay(locs, task_points=60).collect()} == whole


def test_heavy_tails_fill_many_ranges(spark):
    from locusframe.operators import stats

    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 100 == 0, F.col("id") * 1e12).otherwise((F.col("id") % 997) / 1e6).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would share a range otherwise
    try:
        rows = stats.in_order(df.repartition(8), F.col("v"), F.col("id"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in rows.groupBy("_part").count().collect()) < 10_000
    got = {r["id"]: r["place"] for r in stats.argsort(df, "v", "id").collect()}
    want = df.toPandas().sort_values(["v", "id"]).reset_index(drop=True)
    assert [got[i] for i in want["id"]] == list(range(20_000))
    total = stats.running_total(df.withColumn("one", F.lit(1)), [], "id", "one", ascending=False).select("id", "_before").collect()
    assert all(r["_before"] == 19_999 - r["id"] for r in total)


def test_next_frame_far_away(spark):
    from locusframe.operators import tracks

    rng = np.random.default_rng(4)
    rows = [(i, int(f), float(x), float(y)) for i, (f, x, y) in enumerate(zip(rng.integers(0, 6, 3000) * 3, rng.random(3000) * 100, rng.random(3000), strict=True))]
    rows += [(5000, 0, 1e6, 1e6), (5001, 15, 3.0, 3.0), (5002, 0, None, 1.0)]
    locs = spark.createDataFrame(rows, "loc_id long, frame long, x double, y double")
    near = {r["loc_id"]: (r["other"], r["distance"]) for r in tracks.next_frame_nearest(locs).collect() if r["distance"] is not None}
    p = [r for r in rows if r[2] is not None]
    for i, f, x, y in p:
        later = [(np.hypot(x - a, y - b), j) for j, g, a, b in p if g == f + 3]
        assert (i in near) == bool(later)
        if later:
            assert near[i][1] == pytest.approx(min(later)[0])


def test_overlap_of_objects_in_space(spark):
    """Two hulls of points in cubes that overlap by half, and one apart."""
    from locusframe.operators import kernels, overlap

    rng = np.random.default_rng(6)
    one, two = rng.random((40, 3)), rng.random((40, 3)) + [0.5, 0.0, 0.0]
    df = lambda p: spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "loc_id long, x double, y double, z double")
    a, b = overlap.sampled_objects(df(np.vstack([one, one + 20])), 3.0), overlap.sampled_objects(df(two), 3.0)
    got = overlap.object_colocalization(a, b, step=0.25)["overlaps"].collect()

    def inside(p, q):
        h = kernels.hull_3d(p)
        n = np.cross(p[h[:, 1]] - p[h[:, 0]], p[h[:, 2]] - p[h[:, 0]])
        n *= np.sign(((p.mean(0) - p[h[:, 0]]) * n).sum(1))[:, None]
        return ((q[:, None] - p[h[:, 0]][None]) * n[None]).sum(2).min(1) >= 0

    q = rng.random((40_000, 3)) * [1.5, 1.0, 1.0]
    share = (inside(one, q) & inside(two, q)).mean() * 1.5
    assert {(r["object1"], r["object2"]) for r in got} == {(1, 1)} and sum(r["measure"] for r in got) == pytest.approx(share, rel=0.15)
    flat = overlap.sampled_objects(df(two).drop("z"), 3.0)
    with pytest.raises(ValueError):
        overlap.object_colocalization(a, flat)


@pytest.mark.parametrize("kind", ["random", "grid", "surface", "plane"])
def test_tetrahedra_fill_the_hull(kind):
    """Also of points many of which lie in planes and on spheres."""
    import itertools

    from locusframe.operators import kernels

    rng = np.random.default_rng(12)
    p = rng.random((60, 3))
    if kind == "grid":
        p = np.array(list(itertools.product(range(4), repeat=3)), float)
    if kind == "surface":
        h = p[kernels.hull_3d(p)]
        p = np.unique(np.round(np.concatenate([h[:, 0] * a / 4 + h[:, 1] * b / 4 + h[:, 2] * (4 - a - b) / 4 for a in range(5) for b in range(5 - a)]), 9), axis=0)
    if kind == "plane":
        p[:, 2] = p[:, 0] + p[:, 1]
        assert len(kernels.hull_3d(p)) == 0 and len(kernels.delaunay_3d(p)) == 0
        return
    t = kernels.delaunay_3d(p)
    volume = np.abs(np.linalg.det(p[t[:, 1:]] - p[t[:, :1]])) / 6
    assert volume.sum() == pytest.approx(kernels.mesh_volume(p - p.mean(0), kernels.hull_3d(p)), rel=1e-6)
    if kind == "random":
        def empty(s):
            m = p[list(s[1:])] - p[s[0]]
            c = np.linalg.solve(m, (m**2).sum(1) / 2)
            return not (((p - p[s[0]] - c) ** 2).sum(1) < (c**2).sum() * (1 - 1e-9)).any()

        few = p[:25]
        p = few
        assert {tuple(x) for x in kernels.delaunay_3d(few).tolist()} == {s for s in itertools.combinations(range(25), 4) if empty(s)}
