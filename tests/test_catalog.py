import pytest

from locusframe.plans import catalog


def test_cut_distances_do_not_follow_the_size(spark, monkeypatch):
    seen = []

    class Stop(Exception):
        pass

    def cut(*args, **limits):
        seen.append(next(a for a in args if isinstance(a, float)))
        raise Stop

    monkeypatch.setattr(catalog.objects, "objects_from_faces", cut)
    monkeypatch.setattr(catalog.overlap, "sampled_objects", cut)
    monkeypatch.setattr(catalog, "_triangulation", lambda spark, sf_dir: (catalog.pts(spark, sf_dir), None))
    for size in ("sf0.001", "sf0.01"):
        for name in ("delaunay_objects", "object_colocalization"):
            with pytest.raises(Stop):
                catalog.queries()[name](spark, f"/root/testdata/{size}")
    assert seen == [8.0, 14.0] * 2


def test_space_takes_all_points(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert catalog._space(spark, sf_dir).count() == catalog.table(spark, sf_dir, "part").count() == 2000
