import json

import pytest
from pyspark.sql import functions as F

from locusframe.operators import objects
from locusframe.plans import macro
from locusframe.sources import files
from locusframe.streaming import blinks


def test_table_with_header_garbage_and_copies(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z,i,f\n1,2,3,9,0\n1,2,3,8,1\n4.5abc,oops,1e1,7,2\n\n7,8,9\n")
    df = files.read_locs(spark, str(tmp_path / "a.csv"), {"x": 0, "y": 1, "z": 2, "frame": 4}, 44, calibration_xy=2.0, calibration_t=10.0)
    rows = [tuple(r) for r in df.select("id", "x", "y", "z", "frame").orderBy("id").collect()]
    assert rows == [(1, 2.0, 4.0, 3.0, 0.0), (2, 9.0, 0.0, 10.0, 20.0), (3, 14.0, 16.0, 9.0, 0.0)]
    with pytest.raises(ValueError):
        files.read_locs(spark, "a.csv", {"x": 0})


def test_structures(spark, tmp_path):
    atom = "ATOM  {:5d}  CA  ALA {}{:4d}    {:8.3f}{:8.3f}{:8.3f}\n"
    (tmp_path / "a.pdb").write_text("MODEL        1\n" + atom.format(1, "A", 1, 1, 2, 3) + atom.format(2, "A", 2, 4, 5, 6) + atom.format(3, "B", 7, 7, 8, 9))
    rows = [tuple(r) for r in files.read_structure(spark, str(tmp_path / "a.pdb")).orderBy("x").collect()]
    assert rows == [(10.0, 20.0, 30.0, 1, 0, 1), (40.0, 50.0, 60.0, 1, 1, 1), (70.0, 80.0, 90.0, 2, 0, 1)]
    head = "".join(f"_atom_site.{n}\n" for n in ("group_PDB", "Cartn_x", "Cartn_y", "Cartn_z", "auth_asym_id", "auth_seq_id", "pdbx_PDB_model_num"))
    (tmp_path / "a.cif").write_text("loop_\n" + head + "ATOM 1 2 3 A 5 1\nATOM 4 5 6 A 6 1\n#\n")
    rows = [tuple(r) for r in files.read_structure(spark, str(tmp_path / "a.cif")).orderBy("x").collect()]
    assert rows == [(10.0, 20.0, 30.0, 1, 0, 1), (40.0, 50.0, 60.0, 1, 1, 1)]


def test_regions_there_and_back(spark, tmp_path):
    (tmp_path / "r.txt").write_text("3\nPolygonROI\n3 0 0 4 0 0 4\nCircleROI\n1 2 3\nRectangleROI\n0 1 2 3\n")
    a = files.read_rois(spark, str(tmp_path / "r.txt"))
    files.write_rois(a, str(tmp_path / "out"))
    b = files.read_rois(spark, str(tmp_path / "out"))
    assert a.orderBy("roi_id").collect() == b.orderBy("roi_id").collect() and a.count() == 3


def test_writers(spark, tmp_path):
    locs = spark.createDataFrame([(1, 1.0, 10.0, 0), (2, 2.0, 100.0, 1), (3, 3.0, -1.0, 2)], "loc_id long, x double, y double, frame long")
    files.write_feature(locs, "y", str(tmp_path / "f"), log=True)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "f")).collect()) == ["1.0", "2.0"]
    links = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "loc_id long, emitter_id long")
    assert sorted(r[0] for r in files.merged_lines(locs, links, "x").collect()) == ["1,1.0,2.0", "3,3.0"]
    assert files.stack(locs, locs).agg(F.max("frame")).first()[0] == 5
    o = spark.createDataFrame([(1, 7)], "loc_id long, object_id long")
    assert {r["loc_id"]: r["object_id"] for r in files.locs_with_objects(locs, o).collect()} == {1: 7, 2: 0, 3: 0}
    store = files.Settings(str(tmp_path / "p.json"))
    store.save({"a": 1})
    assert store.save({"b": 2}) == {"a": 1, "b": 2} == store.load()


def test_meshes(spark):
    v = [(1, i, float(i & 1), float(i >> 1 & 1), float(i >> 2)) for i in range(8)]
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    f = [(1, a, b, c) for a, b, c, d in quads] + [(1, a, c, d) for a, b, c, d in quads]
    vertices, faces = spark.createDataFrame(v, "mesh_id int, vertex_id int, x double, y double, z double"), spark.createDataFrame(f, "mesh_id int, a int, b int, c int")
    m = objects.mesh_measures(vertices, faces).first()
    assert (m["volume"], m["surface"], m["n_vertices"]) == pytest.approx((1, 6, 8))
    assert objects.vertex_normals(vertices, faces).count() == 8
    assert files.mesh_text(vertices, faces, 1).count() == 20


def test_macro(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f"{i % 5},{i // 5}\n" for i in range(25)))
    text = "\n".join(
        [
            json.dumps({"MainWindow": {"open": {"path": str(tmp_path / "a.csv"), "x": 0, "y": 1, "separator": 44}}}),
            '{"DetectionSet": {"computeDelaunay": {}}}',
            '{"DetectionSet": {"computeVoronoi": {}}}',
            '{"DelaunayTriangulation": {"createFilteredObjects": {"cutDistance": 2}}}',
            json.dumps({"ObjectList": {"saveStatsObjs": {"path": str(tmp_path / "stats")}}}),
        ]
    )
    d = macro.run(macro.Dataset(spark), text)
    assert d.table("ObjectList").first()["measure"] == 16 and d.table("VoronoiDiagram").count() == 25 and len(d.record) == 5
    assert spark.read.option("header", True).csv(str(tmp_path / "stats")).count() == 1
    with pytest.raises(ValueError, match="unknown command"):
        macro.parse('{"DetectionSet": {"nothing": {}}}')
    many = macro.run_many(spark, text.splitlines()[0], [str(tmp_path / "a.csv")])
    assert next(iter(many.values())).table("DetectionSet").count() == 25


def test_stream_of_sessions(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", float(m)) for m in (0, 5, 50)]
    spark.createDataFrame(rows, "emitter_id int, ts string, x double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("emitter_id int, ts timestamp, x double").parquet(str(tmp_path / "in"))
    q = blinks.on_times(s).writeStream.format("memory").queryName("runs").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("runs").collect()) == [1, 2]


def test_streams_of_counts(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", float(m)) for h in (0, 1) for m in (0, 5, 50)]
    spark.createDataFrame(rows, "ts string, x double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("ts timestamp, x double").parquet(str(tmp_path / "in"))
    for name, df in (("hours", blinks.frame_counts(stream())), ("bins", blinks.running_histogram(stream(), "x", 0.0, 10.0))):
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["n"], round(r["x"], 3)) for r in spark.table("hours").collect()) == [(3, 18.333)] * 2
    assert sorted((r["bin"], r["count"]) for r in spark.table("bins").collect()) == [(0, 4), (5, 2)]
