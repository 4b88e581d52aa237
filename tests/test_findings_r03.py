"""What the findings of round 3 were about, on small inputs."""

import math

import numpy as np
import pytest

from locusframe.operators import ripley, spatial


def _clusters(p: np.ndarray, eps: float, min_pts: int, border: bool) -> dict:
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    near = (d2 <= eps * eps) & ~np.eye(len(p), dtype=bool)
    core = near.sum(1) >= min_pts
    reach = near & core[:, None] & core[None]
    label = np.arange(len(p))
    while True:
        new = np.minimum(np.where(reach, label[None], len(p)).min(1), label)
        if (new == label).all():
            break
        label = new
    out = {i: int(label[i]) if core[i] else None for i in range(len(p))}
    if border:
        for i in np.flatnonzero(~core & (near & core[None]).any(1)):
            j = min(np.flatnonzero(near[i] & core), key=lambda k: (d2[i, k], k))
            out[int(i)] = int(label[j])
    return out


def _cloud(kind: str) -> np.ndarray:
    rng = np.random.default_rng(4)
    if kind == "heaps":  # full cells, thin ones and single points
        return np.concatenate([rng.normal((10, 10), 1.5, (150, 2)), rng.normal((16, 12), 0.7, (60, 2)), rng.random((120, 2)) * 40])
    if kind == "walls":  # full cells that only inner points link: the outermost ones lie too far from each other
        left = np.column_stack([np.full(60, 1.0), rng.random(60) * 0.1])
        right = np.column_stack([np.full(60, 3.9), rng.random(60) * 0.1])
        return np.concatenate([left, right, [[1.2, 1.3], [3.7, -1.3], [1.15, 0.05], [3.15, 0.05]], right + [6, 0], right + [9.05, 0]])
    return rng.random((250, 3)) * [6, 6, 4]


@pytest.mark.parametrize(("kind", "min_pts", "border"), [("heaps", 4, True), ("heaps", 5, False), ("walls", 5, True), ("space", 6, True)])
def test_clusters_by_cells(spark, kind, min_pts, border):
    """Clusters are those of single points, whatever cells are full."""
    p = _cloud(kind)
    axes = ["x", "y", "z"][: p.shape[1]]
    rows = [(i, *map(float, q)) for i, q in enumerate(p)] + [(len(p), math.nan, *[0.0] * (len(axes) - 1)), (len(p) + 1, *[None] * len(axes))]
    df = spark.createDataFrame(rows, "loc_id long, " + ", ".join(f"{a} double" for a in axes))
    got = {r["loc_id"]: r["cluster"] for r in spatial.dbscan(df, 2.0 if kind != "space" else 1.0, min_pts, border=border, axes=axes).collect()}
    want = _clusters(p, 2.0 if kind != "space" else 1.0, min_pts, border) | {len(p): None, len(p) + 1: None}
    assert got == want and 0 < sum(c is not None for c in got.values()) < len(rows)


def test_points_of_full_cells_do_not_meet(spark, monkeypatch):
    """in a dense cloud of distinct points no point is compared with its neighbours."""
    met = []
    pairs = spatial.pairs_within

    def watched(a, b, *rest, **named):
        met.append(b.count())
        return pairs(a, b, *rest, **named)

    monkeypatch.setattr(spatial, "pairs_within", watched)
    p = np.random.default_rng(2).random((4000, 2)) * 20
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "loc_id long, x double, y double")
    got = spatial.dbscan(df, 2.0, 8, border=True, keep=["x"]).groupBy("cluster").count().collect()
    assert [tuple(r) for r in got] == [(0, 4000)] and sum(met) < 400


@pytest.mark.parametrize("kind", ["anywhere", "lattice", "rows"])
def test_discs_are_counted_in_strips(kind):
    """Sums over strips of any height are those over all pairs, ties on a radius included."""
    rng = np.random.default_rng(1)
    p = rng.random((300, 2)) * [60, 50] + 1000
    p = np.unique(np.round(p) if kind == "lattice" else np.column_stack([p[:, 0], np.floor(p[:, 1] * 2.4) / 2.4]) if kind == "rows" else p, axis=0)
    n, rs, box = rng.integers(1, 4, len(p)), [2.0, 4.0, 6.0, 10.0], (1000, 1000, 1060, 1050)
    d2 = (p[:, None, 0] - p[None, :, 0]) ** 2 + (p[:, None, 1] - p[None, :, 1]) ** 2
    for corrected in (False, True):
        want = [(((d2 < r * r) * n[None]).sum(1) - 1) @ (n * (ripley._edge_factors(p[:, 0], p[:, 1], r, box) if corrected else 1)) for r in rs]
        for h in (0.05, 0.4, 1.0, 7.0):
            assert np.allclose(ripley.disc_sums(p[:, 0], p[:, 1], n, np.ones(len(p), bool), rs, h, box, corrected), want, rtol=1e-12)


@pytest.mark.parametrize("corrected", [False, True])
def test_ripley_lists_no_pairs(spark, monkeypatch, corrected):
    """no join of points with their neighbours; sums over many tiles are those over all pairs."""
    met = []
    pairs = ripley.pairs_within
    monkeypatch.setattr(ripley, "pairs_within", lambda *a, **named: met.append(1) or pairs(*a, **named))
    p = np.random.default_rng(6).random((500, 2)) * [90, 70] + [0, 5]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "loc_id long, x double, y double")
    k = [r["k"] for r in ripley.k_function(df, 2.0, 6.0, 2.0, corrected=corrected).orderBy("radius").collect()]
    box = (*np.floor(p.min(0)).tolist(), *np.ceil(p.max(0)).tolist())
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    size = (box[2] - box[0]) * (box[3] - box[1])
    want = [((d2 < r * r).sum(1) - 1) @ (ripley._edge_factors(p[:, 0], p[:, 1], r, box) if corrected else np.ones(len(p))) * size / len(p) ** 2 for r in (2.0, 4.0, 6.0)]
    assert np.allclose(k, want, rtol=1e-10) and not met
