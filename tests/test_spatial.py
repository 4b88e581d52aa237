import numpy as np
import pytest

from locusframe.operators import graph, kernels, objects, ripley, spatial, tess, tracks


def cloud(spark, p, **extra):
    names = ["loc_id", *("xyz"[: p.shape[1]]), *extra]
    rows = [(i, *map(float, q), *(v[i] for v in extra.values())) for i, q in enumerate(p)]
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def random_points():
    rng = np.random.default_rng(7)
    return np.round(rng.random((400, 2)) * 100, 1)


def test_radius_against_all_pairs(spark, random_points):
    p = random_points
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    got = {r["loc_id"]: r["density"] for r in spatial.density_within(cloud(spark, p), 7.5).collect()}
    assert got == {i: int((d2[i] < 7.5**2).sum()) for i in range(len(p))}


def test_strict_and_inclusive(spark):
    df = cloud(spark, np.array([[0.0, 0.0], [1.0, 0.0]]))
    assert {r["density"] for r in spatial.density_within(df, 1.0).collect()} == {1}
    assert spatial.neighbours(df, 1.0).count() == 2


def test_plus_shapes(spark):
    arm = np.array([[0, 0], [1, 0], [-1, 0], [0, 1], [0, -1]], float)
    df = cloud(spark, np.vstack([arm, arm + 100]))
    got = {r["loc_id"]: r["cluster"] for r in spatial.dbscan(df, 1.0, 4).collect()}
    assert got == {i: (i if i in (0, 5) else None) for i in range(10)}
    full = {r["loc_id"]: r["cluster"] for r in spatial.dbscan(df, 1.0, 4, border=True).collect()}
    assert full == {i: (0 if i < 5 else 5) for i in range(10)}


def test_nearest_against_all_pairs(spark, random_points):
    p = random_points
    df = cloud(spark, p)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {r["a"]: [] for r in df.selectExpr("loc_id as a").collect()}
    for r in spatial.nearest(df, df, 3, skip_self=True, cell=0.5).orderBy("a", "rank").collect():
        got[r["a"]].append(r["distance"])
    for i in range(len(p)):
        assert got[i] == pytest.approx(np.sort(d[i])[:3])


def test_nearest_with_few_points(spark):
    a, b = cloud(spark, np.array([[0.0, 0.0], [500.0, 0.0]])), cloud(spark, np.array([[1.0, 0.0]]))
    assert {(r["a"], r["b"], r["distance"]) for r in spatial.nearest(a, b, 4).collect()} == {(0, 0, 1.0), (1, 0, 499.0)}
    assert spatial.nearest(a, b.limit(0), 1).count() == 0


def test_components_both_ways(spark):
    rng = np.random.default_rng(2)
    e = rng.integers(0, 60, (45, 2)).tolist()
    df = spark.createDataFrame(e, "a long, b long")
    got = [{r["v"]: r["label"] for r in graph.components(df, n).collect()} for n in (0, 1000)]
    assert got[0] == got[1]
    par = list(range(60))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    assert all(find(v) == k for v, k in got[0].items())


def test_long_chain(spark):
    df = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r["label"] for r in graph.components(df, 0).collect()} == {0}


def test_square_and_empty_circles(spark):
    f = tess.delaunay(cloud(spark, np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float))).collect()
    assert sorted(r["v"] for r in f) == [[0, 1, 2], [0, 2, 3]] and sum(r["measure"] for r in f) == 1


@pytest.mark.parametrize("kind", ["uniform", "rows", "clustered"])
def test_tiles_give_the_triangulation_of_all(spark, kind):
    rng = np.random.default_rng(5)
    p = rng.random((700, 2)) * 100
    if kind == "rows":
        p[:, 1] = np.round(p[:, 1] / 5) * 5
    if kind == "clustered":
        p[:400] = 50 + rng.normal(size=(400, 2))
    df = cloud(spark, p)
    one = {tuple(r["v"]) for r in tess.delaunay(df).collect()}
    many = [tuple(r["v"]) for r in tess.delaunay(df, task_points=60).collect()]
    assert len(many) == len(set(many)) and set(many) == one
    hull = kernels.shoelace(kernels.hull_2d(p))
    tri = np.array(sorted(one))
    q = p[tri]
    area = np.abs((q[:, 1, 0] - q[:, 0, 0]) * (q[:, 2, 1] - q[:, 0, 1]) - (q[:, 2, 0] - q[:, 0, 0]) * (q[:, 1, 1] - q[:, 0, 1])).sum() / 2
    assert area == pytest.approx(hull)
    cx, cy, r = kernels.circumcircles(p[:, 0], p[:, 1], tri)
    inside = np.hypot(p[:, 0][None] - cx[:, None], p[:, 1][None] - cy[:, None]) < r[:, None] * (1 - 1e-7)
    assert not inside.any()


def test_collinear_and_copies(spark):
    assert tess.delaunay(cloud(spark, np.array([[0, 0], [1, 1], [2, 2]], float))).count() == 0
    assert tess.delaunay(cloud(spark, np.array([[0, 0], [1, 0], [0, 1], [0, 0]], float))).count() == 1


def test_cells_fill_the_box(spark, random_points):
    p = np.unique(random_points, axis=0)
    df = cloud(spark, p)
    cells, sides = tess.voronoi(df, tess.delaunay(df))
    box = (np.ptp(p[:, 0]) + 2) * (np.ptp(p[:, 1]) + 2)
    assert cells.selectExpr("sum(measure)").first()[0] == pytest.approx(box)
    pairs = {(r["loc_id"], r["neigh"]) for r in sides.collect()}
    assert pairs == {(b, a) for a, b in pairs}


def test_space_cells_and_hulls(spark):
    rng = np.random.default_rng(4)
    p = rng.random((60, 3))
    df = cloud(spark, p)
    faces = tess.delaunay3(df)
    hull = kernels.mesh_volume(p - p.mean(0), kernels.hull_3d(p))
    assert faces.selectExpr("sum(measure)").first()[0] == pytest.approx(hull)
    pad = np.ptp(p, axis=0).min() / 100
    cells, _ = tess.voronoi3(df, faces)
    assert cells.selectExpr("sum(measure)").first()[0] == pytest.approx(np.prod(np.ptp(p, axis=0) + 2 * pad), rel=1e-6)


def test_sphere_triangulation(spark):
    rng = np.random.default_rng(6)
    u = rng.normal(size=(80, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    f = tess.delaunay_on_sphere(cloud(spark, u * 3 + 1))
    assert f.count() == 2 * 80 - 4
    cells, _ = tess.voronoi_on_sphere(cloud(spark, u), f, 3.0)
    assert cells.selectExpr("sum(measure)").first()[0] == pytest.approx(f.selectExpr("sum(measure)").first()[0])


def test_objects_of_two_blobs(spark):
    g = np.array([[i, j] for i in range(4) for j in range(4)], float)
    df = cloud(spark, np.vstack([g, g + 50]))
    got = objects.objects_from_faces(tess.delaunay(df), df, 2.0)
    rows = got["objects"].orderBy("object_id").collect()
    assert [(r["object_id"], r["n_locs"], r["measure"]) for r in rows] == [(1, 16, 9.0), (2, 16, 9.0)]
    rings = objects.outline_rings(got["object_outline"]).groupBy("object_id", "ring").count().collect()
    assert sorted(r["count"] for r in rings) == [12, 12]
    hulls = objects.convex_hulls(got["object_locs"].join(df, "loc_id")).collect()
    assert {r["measure"] for r in hulls} == {9.0}


def test_objects_in_space(spark):
    from locusframe.plans import macro

    g = np.random.default_rng(8).random((30, 3))
    df = cloud(spark, np.vstack([g, g + [0, 0, 50]]))
    d = macro.Dataset(spark, {"DetectionSet": df})
    macro.run(d, '{"DetectionSet": {"computeDelaunay": {}}}\n{"DelaunayTriangulation": {"createFilteredObjects": {"cutDistance": 5}}}')
    rows = d.table("ObjectList").orderBy("object_id").collect()
    hull = kernels.hull_3d(g)
    assert [r["n_locs"] for r in rows] == [30, 30]
    assert [r["measure"] for r in rows] == pytest.approx([kernels.mesh_volume(g - g.mean(0), hull)] * 2, rel=1e-6)
    assert sorted(r["cz"] for r in rows) == pytest.approx([g[:, 2].mean(), g[:, 2].mean() + 50])
    outline = d.table("ObjectOutline")
    sides = {frozenset((r["a"], r["b"], r["c"])) for r in outline.collect() if r["a"] < 30}
    assert sides == {frozenset(map(int, t)) for t in hull}
    ball = spark.createDataFrame([(1, "sphere", [(0.5, 0.5, 0.5)], 0.55)], "roi_id int, kind string, pts array<struct<x:double,y:double,z:double>>, radius double")
    faces = d.table("DelaunayTriangulation")
    within = set(np.flatnonzero(((g - 0.5) ** 2).sum(1) <= 0.55**2).tolist())
    want = {r["face_id"] for r in faces.collect() if set(r["v"]) <= within}
    got = objects.objects_from_faces(faces, df, rois=ball)["object_faces"]
    assert want and {r["face_id"] for r in got.collect()} == want


def test_overlap_of_two_squares(spark):
    from locusframe.operators import overlap

    g = np.array([[i, j] for i in range(5) for j in range(5)], float)
    one = overlap.sampled_objects(cloud(spark, np.vstack([g, g + 100])), 2.0)
    two = overlap.sampled_objects(cloud(spark, np.vstack([g + np.array([2.0, 1.0]), g + 300])), 2.0)
    got = overlap.object_colocalization(one, two)["overlaps"].collect()
    assert [(r["overlap_id"], r["object1"], r["object2"]) for r in got] == [(1, 1, 1)] and got[0]["measure"] == pytest.approx(6)


def test_polygons_clip(spark):
    from locusframe.operators import overlap

    square = lambda x, y: [(x, y), (x + 4.0, y), (x + 4.0, y + 4.0), (x, y + 4.0)]
    schema = "id long, pts array<struct<x:double,y:double>>"
    one = spark.createDataFrame([(1, square(0.0, 0.0)), (2, square(50.0, 0.0))], schema)
    two = spark.createDataFrame([(7, square(2.0, 1.0)), (8, square(200.0, 0.0))], schema)
    got = overlap.polygon_intersections(one, two, 3.0).collect()
    assert [(r["id1"], r["id2"], r["measure"]) for r in got] == [(1, 7, 6.0)]


def test_concave_polygons_clip(spark):
    from locusframe.operators import overlap

    schema = "id long, pts array<struct<x:double,y:double>>"
    u = [(0.0, 0.0), (6.0, 0.0), (6.0, 5.0), (4.0, 5.0), (4.0, 2.0), (2.0, 2.0), (2.0, 5.0), (0.0, 5.0)]
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    one = spark.createDataFrame([(1, box(2.5, 3.0, 3.5, 4.0)), (2, box(1.0, 1.0, 5.0, 4.0)), (3, [(x, 5.0 - y) for x, y in u])], schema)
    two = spark.createDataFrame([(7, u), (8, u[::-1])], schema)
    got = {(r["id1"], r["id2"]): r for r in overlap.polygon_intersections(one, two, 3.0).collect()}
    assert {k: r["measure"] for k, r in got.items()} == pytest.approx({(2, 7): 8.0, (2, 8): 8.0, (3, 7): 20.0, (3, 8): 20.0})
    assert sum(kernels.shoelace(np.array(p)) for p in got[2, 7]["parts"]) == pytest.approx(8.0)


def test_cells_on_a_sphere_are_voronoi_cells(spark):
    u = np.random.default_rng(9).normal(size=(2000, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    u = u[:500]
    df = cloud(spark, u)
    cells, _ = tess.voronoi_on_sphere(df, tess.delaunay_on_sphere(df, (0.0, 0.0, 0.0), 3.0), 3.0)
    got = np.array([r["measure"] for r in cells.orderBy("loc_id").collect()])
    probe = np.random.default_rng(10).normal(size=(400_000, 3))
    probe /= np.linalg.norm(probe, axis=1, keepdims=True)
    near = np.concatenate([(q @ u.T).argmax(1) for q in np.array_split(probe, 40)])
    want = np.bincount(near, minlength=500) / len(probe) * 4 * np.pi * 9
    assert np.abs(got - want).mean() / want.mean() < 0.05


def test_alpha_of_one_piece(spark):
    g = np.array([[i, j] for i in range(5) for j in range(5)], float)
    df = cloud(spark, g)
    f = tess.delaunay(df)
    a = objects.optimal_alpha(f, df)
    assert objects.alpha_faces(f, df, a * 1.001).selectExpr("sum(measure)").first()[0] == pytest.approx(16)


def test_pixels(spark):
    px = spark.createDataFrame([(0, 0, 5.0), (1, 1, 5.0), (4, 4, 5.0), (4, 5, 1.0)], "x long, y long, value double")
    got = {(r["x"], r["y"]): r["label"] for r in graph.image_components(px, 2, 9).collect()}
    assert got == {(0, 0): 1, (1, 1): 1, (4, 4): 2}
    assert len({r["label"] for r in graph.image_components(px, 2, 9, diagonal=False).collect()}) == 3


def test_segments_to_skeletons(spark):
    e = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0005), (2, 2.0, 0.0, 0.0), (3, 9.0, 9.0, 9.0), (3, 8.0, 9.0, 9.0)], "segment_id long, x double, y double, z double")
    assert {r["segment_id"]: r["skeleton"] for r in graph.merge_segments(e).collect()} == {1: 1, 2: 1, 3: 3}


def test_isolated_pair_ripley(spark):
    p = np.array([[0, 0], [100, 100], [50, 50], [55, 50]], float)
    k = ripley.k_function(cloud(spark, p), 10, 10, 10, corrected=False).first()["k"]
    assert k == pytest.approx(2 / (4 / 1e4) / 4)


def test_linking_against_plain_loop(spark):
    import pandas as pd

    rng = np.random.default_rng(9)
    n = 250
    pdf = pd.DataFrame({"loc_id": np.arange(n), "x": rng.random(n) * 60, "y": rng.random(n) * 60, "frame": rng.integers(0, 40, n)})
    whole = tracks._link_block(pdf, 5.0, 3).set_index("loc_id")["emitter_id"].to_dict()
    got = tracks.link_frames(spark.createDataFrame(pdf), 5.0, 3).toPandas().set_index("loc_id")["emitter_id"].to_dict()
    assert got == whole
