"""What the findings of round 2 were about, on small inputs."""

import itertools

import numpy as np
import pytest

from locusframe.operators import kernels, ripley, spatial, tess
from locusframe.plans import catalog


def test_tiles_agree_on_cocircular_points(spark):
    """A lattice in tiles: every square is cut in the same way by all of them, and copies change nothing."""
    g = np.array(list(itertools.product(range(20), repeat=2)), float)
    p = g[np.random.default_rng(3).permutation(len(g))]
    rows = [(i + len(p) * k, float(x), float(y)) for k in range(2) for i, (x, y) in enumerate(p)]
    f = tess.delaunay(spark.createDataFrame(rows, "loc_id long, x double, y double"), 100)
    hull = tess.face_edges(f).where("neigh is null").count()
    got = {tuple(r["v"]) for r in f.collect()}
    assert got == {tuple(t) for t in np.sort(kernels.Delaunay2D(p[:, 0], p[:, 1]).triangles(), 1).tolist()}
    assert len(got) + hull == 2 * len(p) - 2


def _heaps(seed: int, n: int = 120, copies: int = 5) -> np.ndarray:
    """Rows (loc_id, x, y, frame): places with copies, frames of copies may differ."""
    rng = np.random.default_rng(seed)
    at = np.round(rng.random((n, 2)) * 60, 1)
    p = np.concatenate([at] * copies)
    return np.column_stack([np.arange(len(p)), p, rng.integers(0, 6, len(p))])


def _near(p: np.ndarray, eps: float) -> np.ndarray:
    d = p[:, None, 1:3] - p[None, :, 1:3]
    return (d**2).sum(2) <= eps * eps


def test_heaps_of_copies_are_counted_once(spark, monkeypatch):
    """Counts, clusters and rings of copies as of single points; joins meet each place once."""
    p = _heaps(5)
    df = spark.createDataFrame([(int(i), float(x), float(y), int(f)) for i, x, y, f in p], "loc_id long, x double, y double, frame int")
    met = []
    pairs = spatial.pairs_within

    def watched(a, b, *rest, **named):
        met.append(a.count())
        return pairs(a, b, *rest, **named)

    monkeypatch.setattr(spatial, "pairs_within", watched)
    monkeypatch.setattr(ripley, "pairs_within", watched)
    near = _near(p, 4.0) & ~np.eye(len(p), dtype=bool)
    soon = near & (np.abs(p[:, None, 3] - p[None, :, 3]) < 2)
    for want, dt in ((near, None), (soon, 2)):
        got = {r["loc_id"]: r["n"] for r in spatial.neighbour_counts(df, 4.0, max_dt=dt).collect()}
        assert got == {i: int(c) for i, c in enumerate(want.sum(1)) if c}
    for want, dt in ((near, None), (soon, 2)):
        core = want.sum(1) >= 12
        reach = want & core[:, None] & core[None]
        label = np.arange(len(p))
        for _ in range(len(p)):
            new = np.where(reach, label[None], len(p)).min(1)
            label, old = np.minimum(label, new), label
            if (label == old).all():
                break
        got = {r["loc_id"]: r["cluster"] for r in spatial.dbscan(df, 4.0, 12, max_dt=dt).collect()}
        assert got == {i: int(label[i]) if core[i] else None for i in range(len(p))}
        assert 0 < core.sum() < len(p)
    k = [r["k"] for r in ripley.k_function(df, 2.0, 6.0, 2.0, corrected=False).orderBy("radius").collect()]
    d2 = ((p[:, None, 1:3] - p[None, :, 1:3]) ** 2).sum(2)
    box = np.prod(np.ceil(p[:, 1:3].max(0)) - np.floor(p[:, 1:3].min(0)))
    assert np.allclose(k, [((d2 < r * r).sum() - len(p)) / (len(p) / box) / len(p) for r in (2.0, 4.0, 6.0)])
    assert max(met) < len(p) and min(met) <= len(p) // 5


def test_exploded_vertices_are_not_broadcast(spark, sf):
    """Their size is not known before they are made."""
    plan = catalog.queries()["mesh_measures"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("task_points", [60, 20_000])
def test_sphere_in_tiles_is_the_hull(spark, task_points):
    """Faces of points on a sphere, in one task and in tiles, are those of their hull; copies have none."""
    p = np.random.default_rng(8).normal(size=(300, 3))
    p *= 5 / np.linalg.norm(p, axis=1, keepdims=True)
    rows = [(i + 300 * k, *map(float, q)) for k in range(2) for i, q in enumerate(p)]
    f = tess.delaunay_on_sphere(spark.createDataFrame(rows, "loc_id long, x double, y double, z double"), (0.0, 0.0, 0.0), 5.0, task_points)
    got = {tuple(r["v"]): r["measure"] for r in f.collect()}
    h = kernels.hull_3d(p)
    area = np.linalg.norm(np.cross(p[h[:, 1]] - p[h[:, 0]], p[h[:, 2]] - p[h[:, 0]]), axis=1) / 2
    want = {tuple(t): a for t, a in zip(np.sort(h, 1).tolist(), area, strict=True)}
    assert got.keys() == want.keys() and len(got) == 2 * 300 - 4
    assert all(abs(got[t] - a) < 1e-9 for t, a in want.items())


def test_tetrahedra_take_time_in_proportion():
    """Eight times the points take about eight times as long, not sixty-four; points on two lines have far more tetrahedra than points."""
    import time

    def seconds(n):
        t = time.process_time()
        kernels.delaunay_3d(np.random.default_rng(n).random((n, 3)))
        return time.process_time() - t

    seconds(100)
    assert seconds(4000) < 18 * seconds(500)
    s = np.linspace(0, 1, 40)
    lines = np.concatenate([np.column_stack([s, 0 * s, 0 * s]), np.column_stack([0 * s, s, 1 + 0 * s])])
    assert len(kernels.delaunay_3d(lines)) >= 39 * 39
