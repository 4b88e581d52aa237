"""One query for each operator that no larger query shows: readers and writers, geometry, selections, tessellation, fits, plugins."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import plugins
from ..operators import coloc, fit, objects, roi, select, stats, tess
from ..runtime import shared_dir, stash
from ..sources import files
from . import macro
from .catalog import _COLOC, _ROI_SQL, _SQL, _boxed, _paired, pts, query, r6, rois, rounded, table

LI = "lineitem"


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- readers and writers --------------------------------------------------------------------


@query("""WITH c AS (SELECT c_nationkey + 1 AS chain, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 3 AS residue,
  c_custkey % 900 + 0.125 AS x, c_nationkey * 7.5 AS y FROM customer), k AS (SELECT *, dense_rank() OVER (ORDER BY chain) AS nth FROM c)
SELECT CAST(nth AS BIGINT) AS chain, CAST(residue AS BIGINT) AS residue, count(*) AS n, round(sum(x * 10), 4) AS sx, round(sum(y * 10), 4) AS sy, round(sum(-1.5 * 10), 4) AS sz FROM k GROUP BY 1, 2""")
def structure_file(spark, sf_dir):
    """Customers written as atoms of a structure file, a chain for each nation, and read again."""
    path = scratch(spark, "structure") + ".pdb"
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    residue = F.floor((F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1) / 3)
    line = F.format_string("ATOM  %5d  CA  ALA %s%4d    %8.3f%8.3f%8.3f", F.col("c_custkey") % 100000, F.char(F.lit(65) + F.col("c_nationkey")), residue % 10000, F.col("c_custkey") % 900 + 0.125, F.col("c_nationkey") * 7.5, F.lit(-1.5))
    c.select("c_nationkey", "c_custkey", line.alias("value")).coalesce(1).sortWithinPartitions("c_nationkey", "c_custkey").select("value").write.text(path)
    atoms = files.read_structure(spark, path)
    return atoms.groupBy(F.col("chain").cast("long").alias("chain"), F.col("residue").cast("long").alias("residue")).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(a), 4).alias(f"s{a}") for a in "xyz"])


@query("SELECT count(*) AS n, round(sum(x), 4) AS sx, round(sum(y), 4) AS sy, count(*) AS last FROM (SELECT DISTINCT s_acctbal AS x, s_suppkey * 1.5 AS y FROM supplier)")
def many_files(spark, sf_dir):
    """A folder of text files, read as one table."""
    path = scratch(spark, "many")
    files.write_locs(table(spark, sf_dir, "supplier").selectExpr("s_acctbal as a", "s_suppkey * 1.5d as b", "s_nationkey as c").repartition(3, "c"), path)
    got = files.read_many(spark, path, columns={"x": 0, "y": 1})
    return got.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("y"), 4).alias("sy"), F.max("id").alias("last"))


@query("SELECT n_nationkey, n_name, 1 AS reader FROM nation UNION ALL SELECT r_regionkey, r_name, 2 FROM region")
def readers_by_extension(spark, sf_dir):
    """A reader that is there for Parquet, and one that is registered here for another extension."""
    path = scratch(spark, "region") + ".regions"
    table(spark, sf_dir, "region").write.json(path)
    loaders = files.Loaders()
    loaders.register(("regions",), lambda spark, path, **_: spark.read.schema("r_regionkey long, r_name string").json(path))
    one = loaders.load(spark, f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.lit(1).alias("reader"))
    return one.unionByName(loaders.load(spark, path).select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"), F.lit(2).alias("reader")))


@query("""SELECT * FROM (VALUES (1, 'circle', 20106.192983, 502.654825), (2, 'rectangle', 48000.0, 940.0), (3, 'triangle', 30000.0, 832.455532), (4, 'polygon', 63100.0, 1260.845782), (5, 'line', NULL, 1272.792206)) v(roi_id, kind, area, perimeter)""")
def roi_file(spark, sf_dir):
    path = scratch(spark, "rois") + ".txt"
    files.write_rois(rois(spark), path)
    k, p, r = F.col("kind"), F.col("pts"), F.col("radius")
    return files.read_rois(spark, path).select("roi_id", "kind", r6(roi.area(k, p, r)).alias("area"), r6(roi.perimeter(k, p, r)).alias("perimeter"))


@query("SELECT 'plain' AS kind, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer UNION ALL SELECT 'log', count(*), round(sum(log10(c_acctbal)), 2) FROM customer WHERE c_acctbal > 0")
def feature_file(spark, sf_dir):
    out = []
    for kind in ("plain", "log"):
        path = scratch(spark, "feature")
        files.write_feature(table(spark, sf_dir, "customer"), "c_acctbal", path, kind == "log")
        out.append(spark.read.text(path).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total")))
    return out[0].unionByName(out[1])


@query("SELECT o_orderstatus AS color, count(*) AS n, round(sum(o_totalprice), 2) AS d1, round(sum(o_custkey * 0.5), 2) AS d2 FROM orders GROUP BY 1")
def pair_density_files(spark, sf_dir):
    path = scratch(spark, "pairs")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("color"), F.col("o_orderkey").alias("loc_id"), F.col("o_totalprice").alias("d1"), (F.col("o_custkey") * 0.5).alias("d2"))
    files.write_pairs(o, path)
    back = spark.read.option("header", True).option("sep", "\t").schema("id long, density1 double, density2 double, color string").csv(path)
    return back.groupBy("color").agg(F.count("id").alias("n"), F.round(F.sum("density1"), 2).alias("d1"), F.round(F.sum("density2"), 2).alias("d2"))


@query("""SELECT 'distances' AS name, 'index object,distance to centroids,distance to outline' AS header, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier
UNION ALL SELECT 'ripley', 'Radius,K value,L value', 50, round(sum(i), 2) FROM range(1, 51) t(i) UNION ALL SELECT 'overlaps', 'overlap,object1,object2,measure', count(*), round(sum(l_quantity), 2) FROM lineitem""")
def result_files(spark, sf_dir):
    """Tables of nearest distances, of Ripley's functions and of overlaps, as files with their headers."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("object_id"), F.col("s_acctbal").alias("to_centre"), F.col("s_acctbal").alias("to_outline"))
    k = spark.range(1, 51).select(F.col("id").cast("double").alias("radius"), F.col("id").cast("double").alias("k"), F.lit(0.0).alias("l"))
    o = table(spark, sf_dir, LI).selectExpr("l_orderkey * 10 + l_linenumber as overlap_id", "l_partkey as object1", "l_suppkey as object2", "l_quantity as measure")
    out = None
    for name, write, df, column in (("distances", files.write_distances, s, 1), ("ripley", files.write_ripley, k, 1), ("overlaps", files.write_overlaps, o, 3)):
        path = scratch(spark, name)
        write(df, path)
        back = spark.read.option("header", True).option("sep", "\t").csv(path)
        got = back.agg(F.lit(name).alias("name"), F.lit(",".join(back.columns)).alias("header"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col(f"`{back.columns[column]}`").cast("double")), 2).alias("total"))
        out = got if out is None else out.unionByName(got)
    return out


@query("""WITH f AS (SELECT event_id, user_id, date_diff('hour', TIMESTAMP '2020-01-01', date_trunc('hour', ts)) AS frame FROM events)
SELECT user_id || ',' || string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY frame, event_id) AS value FROM f GROUP BY user_id""")
def merged_lines(spark, sf_dir):
    from .views import frames

    f = frames(spark, sf_dir).withColumn("tag", F.col("loc_id"))
    return files.merged_lines(f.select("loc_id", "frame", "tag"), f.select("loc_id", F.col("user_id").alias("emitter_id")), "tag")


@query("""SELECT '<circle cx="' || s_suppkey || '.000" cy="' || s_nationkey || '.500" r="2.000" fill="' || CASE WHEN s_acctbal < 0 THEN 'red' ELSE 'blue' END || '"/>' AS value FROM supplier""")
def svg_points(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("x"), (F.col("s_nationkey") + 0.5).alias("y"), "s_acctbal")
    return files.svg_circles(s, F.when(F.col("s_acctbal") < 0, "red").otherwise("blue"), 2.0)


def _tetra_meshes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A tetrahedron with a right corner for each nation, as large as its key."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("mesh_id"), (F.col("n_nationkey") + 1).cast("double").alias("s"))
    v = n.withColumn("vertex_id", F.explode(F.array(*map(F.lit, range(4))))).selectExpr("mesh_id", "vertex_id", "if(vertex_id = 1, s, 0d) as x", "if(vertex_id = 2, s, 0d) as y", "if(vertex_id = 3, s, 0d) as z")
    f = n.select("mesh_id", F.explode(F.array(*[F.struct(*[F.lit(i).alias(k) for i, k in zip(t, "abc", strict=True)]) for t in ((0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3))])).alias("t")).select("mesh_id", "t.*")
    return v, f


@query("""SELECT n_nationkey AS mesh_id, 'v ' || x || ' ' || y || ' ' || z AS value FROM (SELECT n_nationkey, i, CASE i WHEN 1 THEN n_nationkey + 1.0::DOUBLE ELSE 0.0 END AS x,
  CASE i WHEN 2 THEN n_nationkey + 1.0::DOUBLE ELSE 0.0 END AS y, CASE i WHEN 3 THEN n_nationkey + 1.0::DOUBLE ELSE 0.0 END AS z FROM nation, range(4) t(i))
UNION ALL SELECT n_nationkey, f FROM nation, (VALUES ('f 1 3 2'), ('f 1 2 4'), ('f 1 4 3'), ('f 2 3 4')) u(f)""")
def mesh_files(spark, sf_dir):
    """Meshes written as tables, and the text of each."""
    path = scratch(spark, "mesh")
    files.write_mesh(*_tetra_meshes(spark, sf_dir), path)
    v, f = (spark.read.parquet(f"{path}/{t}") for t in ("vertices", "faces"))
    return files.mesh_lines(v, f).select(F.col("mesh_id").cast("long").alias("mesh_id"), "value")


@query("""SELECT n_nationkey AS mesh_id, i AS vertex_id, round(CASE i WHEN 0 THEN -1 / sqrt(3) WHEN 1 THEN (1 / sqrt(3)) / sqrt((1 / sqrt(3)) ** 2 + 2 * (1 / sqrt(3) - 1) ** 2) ELSE (1 / sqrt(3) - 1) / sqrt((1 / sqrt(3)) ** 2 + 2 * (1 / sqrt(3) - 1) ** 2) END, 6) AS nx
FROM nation, range(4) t(i)""")
def mesh_normals(spark, sf_dir):
    """Normals at the corners of a tetrahedron: the mean of its faces' normals, of length one."""
    n = objects.vertex_normals(*_tetra_meshes(spark, sf_dir))
    return n.select(F.col("mesh_id").cast("long").alias("mesh_id"), F.col("vertex_id").cast("long").alias("vertex_id"), r6("nx").alias("nx"))


@query("SELECT * FROM (VALUES ('colour', 'red'), ('radius', '7'), ('step', '2')) v(name, value)")
def parameter_store(spark, sf_dir):
    """Parameters saved twice in the shared folder; the second save keeps what it does not name."""
    store = files.Settings(scratch(spark, "settings") + ".json", spark)
    store.save({"radius": 5, "colour": "red"})
    store.save({"radius": 7, "step": 2})
    return spark.createDataFrame([(k, str(v)) for k, v in store.load().items()], "name string, value string")


# --- features and geometry ------------------------------------------------------------------


@query("SELECT p_partkey, p_size * 2 AS double_size, 'double_size,p_partkey,p_size' AS features FROM part")
def edited_features(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    p = C.delete_feature(C.add_feature(p, "double_size", F.col("p_size") * 2), "p_type")
    assert C.has_feature(p, "double_size") and not C.has_feature(p, "p_type")
    return p.select("p_partkey", "double_size", F.lit(",".join(C.list_features(p))).alias("features"))


_TETRA = ((0.0, 0.0, 0.0), (61.3, 0.0, 0.0), (0.0, 57.7, 0.0), (0.0, 0.0, 19.1))


@query("SELECT l_orderkey, l_linenumber, l_quantity / 61.3 + l_linenumber * 5 / 57.7 + l_discount * 100 / 19.1 <= 1 AS holds FROM lineitem")
def in_tetrahedra(spark, sf_dir):
    p = (F.col("l_quantity"), (F.col("l_linenumber") * 5).cast("double"), F.col("l_discount") * 100)
    corners = [tuple(map(F.lit, c)) for c in _TETRA]
    return table(spark, sf_dir, LI).select("l_orderkey", "l_linenumber", C.in_tetrahedron(p, *corners).alias("holds"))


@query("""SELECT l_orderkey, l_linenumber, round(1800 * (2 * acos(l_quantity / 60) - sin(2 * acos(l_quantity / 60))), 5) AS segment,
 (l_quantity - 25) ** 2 + (l_linenumber - 4) ** 2 <= 400 AND (l_quantity + 3 - 25) ** 2 + (l_linenumber - 4) ** 2 <= 400 AND (l_quantity - 25) ** 2 + (l_linenumber + 2 - 4) ** 2 <= 400 AND (l_quantity + 3 - 25) ** 2 + (l_linenumber + 2 - 4) ** 2 <= 400 AS holds FROM lineitem""")
def circles(spark, sf_dir):
    """The segment that a chord cuts from a circle, and rectangles inside a circle."""
    x, y = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return table(spark, sf_dir, LI).select(
        "l_orderkey", "l_linenumber", F.round(C.circular_segment_area(F.lit(60.0), x), 5).alias("segment"), C.rect_in_circle((F.lit(25.0), F.lit(4.0)), F.lit(20.0), x, y, x + 3, y + 2).alias("holds")
    )


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_linenumber * 1.0 AS y, l_discount * 100 - 5 AS dx, l_tax * 100 + 1 AS dy FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN round(dx - dy, 6) <> 0 THEN round(x + dx * (x - y) / (dy - dx), 6) END AS meet, round(x + 2 * dx / sqrt(dx * dx + dy * dy), 6) AS two_on FROM s""")
def lines(spark, sf_dir):
    """Where lines through points meet the diagonal, and the points at distance two on them."""
    x, y = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    a, b = (x, y), (x + F.col("l_discount") * 100 - 5, y + F.col("l_tax") * 100 + 1)
    diagonal = (F.lit(0.0), F.lit(0.0)), (F.lit(1.0), F.lit(1.0))
    same = F.round(F.col("l_discount") * 100 - 5, 6) == F.round(F.col("l_tax") * 100 + 1, 6)
    return table(spark, sf_dir, LI).select("l_orderkey", "l_linenumber", F.when(~same, r6(C.lines_cross(a, b, *diagonal)[0])).alias("meet"), r6(C.point_at(a, b, F.lit(2.0))[0]).alias("two_on"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -ceil(-c_acctbal) ELSE ceil(c_acctbal) END AS away FROM customer")
def rounded_away(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.round_away(F.col("c_acctbal")).cast("double").alias("away"))


@query("SELECT count(*) AS n, true AS bright, true AS dark, true AS spread FROM part")
def random_colours(spark, sf_dir):
    """Colours of parts: bright ones from 128 to 255, dark ones below, and means in the middle within five standard errors."""
    p = table(spark, sf_dir, "part").select(C.random_colour(F.col("p_partkey"), 1).alias("b"), C.random_colour(F.col("p_partkey"), 1, dark=True).alias("d"))
    within = lambda c, lo, hi: F.bool_and(F.forall(c, lambda v: (v >= lo) & (v <= hi)))
    even = F.abs(F.avg(F.col("b")[0]) - 191.5) <= 5 * 128 / F.sqrt(12 * F.count(F.lit(1)))
    return p.agg(F.count(F.lit(1)).alias("n"), within("b", 128, 255).alias("bright"), within("d", 0, 127).alias("dark"), even.alias("spread"))


@query("""WITH f AS (SELECT l_orderkey AS face_id, sum(l_quantity) AS q, list(l_linenumber ORDER BY l_linenumber) AS v FROM lineitem GROUP BY 1)
SELECT face_id, unnest(v) AS vertex, CASE WHEN q > 100 THEN q ELSE -1.0 END AS primitive_value FROM f""")
def spread_features(spark, sf_dir):
    """A face's feature at each of its vertices, with a sentinel where the face is not selected."""
    f = table(spark, sf_dir, LI).groupBy(F.col("l_orderkey").alias("face_id")).agg(F.sum("l_quantity").alias("q"), F.array_sort(F.collect_list("l_linenumber")).alias("v"))
    return C.spread(f, F.col("q"), F.col("q") > 100, "v", -1.0).select("face_id", "vertex", "primitive_value")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_linenumber * 2.0 AS b, l_partkey % 17 + 1.0 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(b * c / sqrt((b * c) ** 2 + (a * c) ** 2 + (a * b) ** 2), 6) AS nx, round(a * b / sqrt((b * c) ** 2 + (a * c) ** 2 + (a * b) ** 2), 6) AS nz FROM t""")
def face_normals(spark, sf_dir):
    """Normals of triangles that cut the three axes."""
    zero = F.lit(0.0)
    a, b, c = (F.col("l_quantity"), zero, zero), (zero, F.col("l_linenumber") * 2.0, zero), (zero, zero, F.col("l_partkey") % 17 + 1.0)
    n = C.face_normal(a, b, c)
    return table(spark, sf_dir, LI).select("l_orderkey", "l_linenumber", r6(n[0]).alias("nx"), r6(n[2]).alias("nz"))


@query("""WITH p AS (SELECT l_orderkey AS k, list({'x': l_partkey % 100 + 0.5, 'y': l_suppkey % 50 * 1.0} ORDER BY l_linenumber, l_partkey, l_suppkey) AS pts FROM lineitem GROUP BY 1 HAVING count(*) >= 3),
m AS (SELECT *, list_avg(list_transform(pts, lambda p: p.x)) AS mx, list_avg(list_transform(pts, lambda p: p.y)) AS my FROM p)
SELECT k, round(list_sum(list_transform(range(1, len(pts) + 1), lambda i: abs((pts[i].x - mx) * (pts[i % len(pts) + 1].y - my) - (pts[i % len(pts) + 1].x - mx) * (pts[i].y - my)) / 2)), 4) AS area FROM m""")
def fan_areas(spark, sf_dir):
    pt = F.struct(F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), (F.col("l_partkey") % 100 + 0.5).alias("x"), (F.col("l_suppkey") % 50 * 1.0).alias("y"))
    g = table(spark, sf_dir, LI).groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(pt)).alias("pts")).where(F.size("pts") >= 3)
    return g.select("k", F.round(C.polygon_fan_area(F.col("pts")), 4).alias("area"))


# --- selections -----------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06")
def reset_selection(spark, sf_dir):
    bounds = select.reset_bounds({"l_quantity": (10, 30), "l_discount": (0.02, 0.06)}, "l_quantity")
    return select.select(table(spark, sf_dir, LI), bounds).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_size > 25")
def border_cells(spark, sf_dir):
    return select.border_cells(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > 25).alias("is_border"))).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def chosen_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return select.select_ids(table(spark, sf_dir, "customer"), ids, "c_custkey").select("c_custkey")


# --- objects and tessellation ---------------------------------------------------------------


@query("""WITH p AS (SELECT s_suppkey AS k, d.i AS i, d.a AS a, (s_nationkey + 1) * d.i * (4 - d.a) * 1.0 AS v FROM supplier, (SELECT i, a FROM range(1, 5) t(i), range(1, 4) u(a)) d),
w AS (SELECT k, a, sqrt(avg(u * u) - avg(u) ** 2) * 2.35 AS s FROM (SELECT p.k, q.a, CASE WHEN p.a = q.a THEN p.v ELSE 0 END AS u FROM p JOIN (SELECT DISTINCT k, a FROM p) q ON p.k = q.k) GROUP BY 1, 2)
SELECT k AS object_id, 24 AS n_locs, 2.5 AS volume, round(2 * max(s), 5) AS major, round(2 * min(s), 5) AS minor2, round(2 * avg(s), 5) AS size FROM w GROUP BY 1""")
def features_in_space(spark, sf_dir):
    """Objects of 24 points on three axes, with known main directions."""
    d = F.explode(F.array(*[F.struct(F.lit(s * i).alias("i"), F.lit(a).alias("a")) for a in (1, 2, 3) for i in (1, 2, 3, 4) for s in (1, -1)])).alias("d")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("object_id"), (F.col("s_nationkey") + 1).alias("k"), d)
    axis = lambda n: F.when(F.col("d.a") == n, F.col("k") * F.col("d.i") * (4 - n)).otherwise(0).cast("double")
    member = s.select("object_id", axis(1).alias("x"), axis(2).alias("y"), axis(3).alias("z"))
    o = member.groupBy("object_id").agg(F.count(F.lit(1)).cast("int").alias("n_locs"), F.lit(2.5).alias("measure"))
    return objects.features_3d(o, member).select("object_id", "n_locs", "volume", *[F.round(c, 5).alias(c) for c in ("major", "minor2", "size")])


@query("SELECT p_partkey AS object_id, 2 AS rings, 8 AS corners FROM part")
def outline_rings(spark, sf_dir):
    """Two squares of edges in any order for each part, chained."""
    e = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((2, 3), (0, 1), (3, 0), (1, 2), (6, 5), (4, 7), (7, 6), (5, 4))])).alias("e")
    out = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"), e).select("object_id", (F.col("object_id") * 10 + F.col("e.a")).alias("a"), (F.col("object_id") * 10 + F.col("e.b")).alias("b"))
    r = objects.outline_rings(out)
    return r.groupBy("object_id").agg(F.countDistinct("ring").cast("int").alias("rings"), F.countDistinct("loc_id").cast("int").alias("corners"))


_SUPPLIERS = "s AS (SELECT s_suppkey AS id, s_acctbal / 10 AS x, (s_suppkey * 379 % 1009) * 1.0 AS y FROM supplier)"


def _suppliers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("loc_id"), (F.col("s_acctbal") / 10).alias("x"), (F.col("s_suppkey") * 379 % 1009).cast("double").alias("y"))


#: Triangles whose circumcircle holds no other point, by their definition: centre and squared radius of all triples.
_EMPTY = f"""{_SUPPLIERS}, t AS (SELECT a.id AS a, b.id AS b, c.id AS c, a.x AS x, a.y AS y, b.x - a.x AS bx, b.y - a.y AS bw, c.x - a.x AS cx, c.y - a.y AS cy FROM s a JOIN s b ON a.id < b.id JOIN s c ON b.id < c.id),
d AS (SELECT *, 2 * (bx * cy - cx * bw) AS d FROM t WHERE bx * cy <> cx * bw),
o AS (SELECT a, b, c, abs(d) / 4 AS area, (cy * (bx * bx + bw * bw) - bw * (cx * cx + cy * cy)) / d AS ux, (bx * (cx * cx + cy * cy) - cx * (bx * bx + bw * bw)) / d AS uy, x, y FROM d),
e AS (SELECT a, b, c, area, x + ux AS mx, y + uy AS my FROM o WHERE NOT EXISTS (SELECT 1 FROM s WHERE (s.x - o.x - ux) ** 2 + (s.y - o.y - uy) ** 2 < (ux * ux + uy * uy) * (1 - 1e-9)))"""


@query(f"WITH {_EMPTY} SELECT a, b, c, round(area, 4) AS area FROM e")
def supplier_triangles(spark, sf_dir):
    """The triangulation of all suppliers as points, in tiles; SQL takes the triangles with empty circumcircles."""
    f = tess.delaunay(_suppliers(spark, sf_dir))
    return f.select(F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), F.col("v")[2].alias("c"), F.round("measure", 4).alias("area"))


@query(f"""WITH {_EMPTY}, k AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS face_id, a, b, c FROM e),
g AS (SELECT face_id, a AS p, b AS q FROM k UNION ALL SELECT face_id, b, c FROM k UNION ALL SELECT face_id, a, c FROM k)
SELECT g.face_id, g.p AS a, g.q AS b, h.face_id AS neigh FROM g LEFT JOIN g h ON g.p = h.p AND g.q = h.q AND g.face_id <> h.face_id""")
def supplier_neighbours(spark, sf_dir):
    """Sides of the suppliers' triangles with the triangle across each."""
    return tess.face_edges(stash(tess.delaunay(_suppliers(spark, sf_dir)), "faces")).select("face_id", "a", "b", "neigh")


@query(f"""WITH RECURSIVE {_EMPTY}, k AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS face_id, a, b, c, area FROM e),
sd AS (SELECT face_id, a AS p, b AS q FROM k UNION ALL SELECT face_id, b, c FROM k UNION ALL SELECT face_id, a, c FROM k),
far AS (SELECT DISTINCT face_id FROM sd JOIN s u ON u.id = p JOIN s v ON v.id = q WHERE (u.x - v.x) ** 2 + (u.y - v.y) ** 2 > 16900),
g AS (SELECT * FROM sd WHERE face_id NOT IN (SELECT face_id FROM far)), nb AS (SELECT g.face_id AS a, h.face_id AS b FROM g JOIN g h ON g.p = h.p AND g.q = h.q AND g.face_id <> h.face_id),
reach(root, f) AS (SELECT DISTINCT face_id, face_id FROM g UNION SELECT root, nb.b FROM reach JOIN nb ON reach.f = nb.a),
lab AS (SELECT f AS face_id, min(root) AS cluster FROM reach GROUP BY 1),
m AS (SELECT DISTINCT cluster, unnest([a, b, c]) AS id FROM lab JOIN k USING (face_id)),
ob AS (SELECT cluster, sum(area) AS measure FROM lab JOIN k USING (face_id) GROUP BY 1), n AS (SELECT cluster, count(*) AS n_locs, avg(x) AS cx, avg(y) AS cy FROM m JOIN s USING (id) GROUP BY 1)
SELECT dense_rank() OVER (ORDER BY cluster) AS object_id, n_locs, round(measure, 4) AS measure, round(cx, 6) AS cx, round(cy, 6) AS cy FROM ob JOIN n USING (cluster) WHERE n_locs >= 4""")
def supplier_objects(spark, sf_dir):
    """Objects of suppliers' triangles whose sides are at most 130 long, joined over shared sides."""
    p = _suppliers(spark, sf_dir)
    got = objects.objects_from_faces(stash(tess.delaunay(p), "faces"), p, 130.0, min_locs=4)["objects"]
    return got.select("object_id", "n_locs", F.round("measure", 4).alias("measure"), r6("cx").alias("cx"), r6("cy").alias("cy"))


@query(f"""WITH {_EMPTY}, v AS (SELECT unnest([a, b, c]) AS id, mx, my, a, b, c FROM e), box AS (SELECT min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1 FROM s),
nb AS (SELECT id, count(DISTINCT n) AS n_sides FROM (SELECT id, unnest([a, b, c]) AS n FROM v) WHERE n <> id GROUP BY 1),
ok AS (SELECT id FROM v, box GROUP BY id, x0 HAVING bool_and(mx > x0 AND mx < x1 AND my > y0 AND my < y1) AND count(*) = (SELECT n_sides FROM nb WHERE nb.id = v.id)),
k AS (SELECT v.id, mx, my, atan2(my - s.y, mx - s.x) AS t FROM v JOIN s USING (id) WHERE v.id IN (SELECT id FROM ok)),
r AS (SELECT id, mx, my, coalesce(lead(mx) OVER w, first_value(mx) OVER w) AS qx, coalesce(lead(my) OVER w, first_value(my) OVER w) AS qy FROM k WINDOW w AS (PARTITION BY id ORDER BY t))
SELECT id AS loc_id, n_sides, round(abs(sum(mx * qy - qx * my)) / 2, 3) AS measure FROM r JOIN nb USING (id) GROUP BY 1, 2""")
def supplier_cells(spark, sf_dir):
    """Voronoi cells of suppliers that the box leaves whole; SQL sorts the centres of the empty circles about each supplier."""
    p = _suppliers(spark, sf_dir)
    cells, sides = tess.voronoi(p, stash(tess.delaunay(p), "faces"))
    n = sides.groupBy("loc_id").agg(F.count(F.lit(1)).alias("n_sides"))
    return cells.where("not is_border").join(n, "loc_id").select("loc_id", "n_sides", F.round("measure", 3).alias("measure"))


_NATIONS = "p AS (SELECT n_nationkey AS id, (n_nationkey * 37 + 11) % 101 * 1.0 AS x, (n_nationkey * 53 + 29) % 103 * 1.0 AS y, (n_nationkey * 71 + 5) % 107 * 1.0 AS z FROM nation)"


def _nations(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("loc_id"), ((k * 37 + 11) % 101).cast("double").alias("x"), ((k * 53 + 29) % 103).cast("double").alias("y"), ((k * 71 + 5) % 107).cast("double").alias("z"))


_TETRAHEDRA = f"""WITH {_NATIONS}, t AS (SELECT a.id AS a, b.id AS b, c.id AS c, d.id AS d, a.x AS x, a.y AS y, a.z AS z, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz,
  d.x - a.x AS wx, d.y - a.y AS wy, d.z - a.z AS wz FROM p a JOIN p b ON a.id < b.id JOIN p c ON b.id < c.id JOIN p d ON c.id < d.id),
k AS (SELECT *, vy * wz - vz * wy AS fx, vz * wx - vx * wz AS fy, vx * wy - vy * wx AS fz, wy * uz - wz * uy AS gx, wz * ux - wx * uz AS gy, wx * uy - wy * ux AS gz, uy * vz - uz * vy AS hx, uz * vx - ux * vz AS hy, ux * vy - uy * vx AS hz,
  ux * ux + uy * uy + uz * uz AS u2, vx * vx + vy * vy + vz * vz AS v2, wx * wx + wy * wy + wz * wz AS w2 FROM t),
o AS (SELECT *, 2 * (ux * fx + uy * fy + uz * fz) AS det FROM k WHERE ux * fx + uy * fy + uz * fz <> 0),
q AS (SELECT a, b, c, d, x, y, z, abs(det) / 12 AS volume, (u2 * fx + v2 * gx + w2 * hx) / det AS mx, (u2 * fy + v2 * gy + w2 * hy) / det AS my, (u2 * fz + v2 * gz + w2 * hz) / det AS mz FROM o),
k4 AS (SELECT a AS v0, b AS v1, c AS v2, d AS v3, volume FROM q WHERE NOT EXISTS (SELECT 1 FROM p WHERE (p.x - q.x - mx) ** 2 + (p.y - q.y - my) ** 2 + (p.z - q.z - mz) ** 2 < (mx * mx + my * my + mz * mz) * (1 - 1e-9)))"""


@query(_TETRAHEDRA + " SELECT v0, v1, v2, v3, round(volume, 4) AS volume FROM k4")
def nation_tetrahedra(spark, sf_dir):
    """The triangulation in space of all nations as points; SQL takes the tetrahedra with empty circumspheres."""
    f = tess.delaunay3(_nations(spark, sf_dir))
    return f.select(*[F.col("v")[i].alias(f"v{i}") for i in range(4)], F.round("measure", 4).alias("volume"))


_CUSTOMERS = "c AS (SELECT c_custkey AS id, (c_custkey * 379 % 1009) / 10.09 + 0.0013 AS x, (c_custkey * 577 % 1013) / 10.13 + 0.0017 AS y, (c_custkey * 733 % 1019) / 10.19 + 0.0019 AS z FROM customer)"


@query(f"""WITH {_NATIONS}, {_CUSTOMERS}, t(face_id, i0, i1, i2, i3) AS (SELECT r_regionkey * 2, r_regionkey, r_regionkey + 5, r_regionkey + 10, r_regionkey + 15 FROM region UNION ALL SELECT r_regionkey * 2 + 1, r_regionkey, r_regionkey + 6, r_regionkey + 12, r_regionkey + 17 FROM region),
k AS (SELECT face_id, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, d.x - a.x AS vx, d.y - a.y AS vy, d.z - a.z AS vz, e.x - a.x AS wx, e.y - a.y AS wy, e.z - a.z AS wz
  FROM t JOIN p a ON a.id = i0 JOIN p b ON b.id = i1 JOIN p d ON d.id = i2 JOIN p e ON e.id = i3),
q AS (SELECT c.id, face_id, c.x - ax AS px, c.y - ay AS py, c.z - az AS pz, k.*, ux * (vy * wz - vz * wy) - uy * (vx * wz - vz * wx) + uz * (vx * wy - vy * wx) AS det FROM c, k),
l AS (SELECT id, face_id, (px * (vy * wz - vz * wy) - py * (vx * wz - vz * wx) + pz * (vx * wy - vy * wx)) / det AS a, (ux * (py * wz - pz * wy) - uy * (px * wz - pz * wx) + uz * (px * wy - py * wx)) / det AS b,
  (ux * (vy * pz - vz * py) - uy * (vx * pz - vz * px) + uz * (vx * py - vy * px)) / det AS g FROM q WHERE det <> 0),
h AS (SELECT id, min(face_id) AS face_id FROM l WHERE a >= 0 AND b >= 0 AND g >= 0 AND a + b + g <= 1 GROUP BY 1)
SELECT c.id AS loc_id, h.face_id FROM c LEFT JOIN h USING (id)""")
def located_in_space(spark, sf_dir):
    """The first tetrahedron of nations that holds each customer as a point."""
    p = _nations(spark, sf_dir)
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r"))
    t = None
    for odd, step in ((0, (0, 5, 10, 15)), (1, (0, 6, 12, 17))):
        one = r.select((F.col("r") * 2 + odd).alias("face_id"), F.array(*[F.col("r") + s for s in step]).alias("v"), F.lit(0.0).alias("measure"))
        t = one if t is None else t.unionByName(one)
    k = F.col("c_custkey")
    axes = {a: (k * m % d) / (d / 100) + o for a, m, d, o in (("x", 379, 1009, 0.0013), ("y", 577, 1013, 0.0017), ("z", 733, 1019, 0.0019))}
    c = table(spark, sf_dir, "customer").select(k.alias("loc_id"), *[v.alias(a) for a, v in axes.items()])
    from ..operators import spatial

    return spatial.locate_in_space(c, tess.with_corners(t, p, ("x", "y", "z")))


@query(f"""WITH {_NATIONS}, o AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p) SELECT p.id AS loc_id, round(p.x + (p.x - o.x) * 0.5, 6) AS x, round(p.y + (p.y - o.y) * 0.5, 6) AS y,
  round((p.x * 1 + p.y * 2 + (p.z + 10) * 2) / 3, 6) AS depth FROM p, o""")
def moved_cells(spark, sf_dir):
    """Points moved from their common centre, and their depth before an eye."""
    p = _nations(spark, sf_dir)
    m = p.agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    xyz, centre = tuple(F.col(a) for a in "xyz"), tuple(F.col(f"m{a}") for a in "xyz")
    x, y, _ = C.moved_from(xyz, xyz, centre, 0.5)
    d = C.depth(xyz, (F.lit(0.0), F.lit(0.0), F.lit(-10.0)), (F.lit(1.0), F.lit(2.0), F.lit(2.0)))
    return p.crossJoin(F.broadcast(m)).select("loc_id", r6(x).alias("x"), r6(y).alias("y"), r6(d).alias("depth"))  # m is one row


@query("SELECT user_id AS skeleton_id, count(*) AS n, count(DISTINCT event_type) AS segments, round(sum(value), 4) AS sx FROM events GROUP BY 1")
def skeleton_files(spark, sf_dir):
    path = scratch(spark, "skeletons")
    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    files.write_skeletons(table(spark, sf_dir, "events").select(F.col("user_id").alias("skeleton_id"), F.col("event_type").alias("segment_id"), k.alias("seq"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")), path)
    return spark.read.parquet(path).groupBy("skeleton_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("segment_id").alias("segments"), F.round(F.sum("x"), 4).alias("sx"))


@query(_TETRAHEDRA + " SELECT 1 AS object_id, (SELECT count(*) FROM p) AS n_locs, round(sum(volume), 3) AS measure FROM k4")
def hull_in_space(spark, sf_dir):
    """The hull of all nations as points in space; SQL adds up the tetrahedra that fill it."""
    h = objects.convex_hulls3(_nations(spark, sf_dir).withColumn("object_id", F.lit(1).cast("long")))
    return h.withColumn("measure", F.round("measure", 3))


@query("""SELECT n_nationkey AS mesh_id, i AS n, 'v ' || CASE i WHEN 1 THEN n_nationkey + 1.0::DOUBLE ELSE 0.0 END || ' ' || CASE i WHEN 2 THEN n_nationkey + 1.0::DOUBLE ELSE 0.0 END || ' ' || CASE i WHEN 3 THEN n_nationkey + 1.0::DOUBLE ELSE 0.0 END AS value
FROM nation, range(4) t(i) UNION ALL SELECT n_nationkey, i, 'vn ' || i * 0.5::DOUBLE || ' 0.0 ' || 1.0::DOUBLE FROM nation, range(4) t(i)""")
def heat_files(spark, sf_dir):
    """Vertices and their vectors of every mesh as text lines."""
    v, _ = _tetra_meshes(spark, sf_dir)
    n = v.select("mesh_id", "vertex_id", (F.col("vertex_id") * 0.5).cast("double").alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return files.heat_lines(v, n).select(F.col("mesh_id").cast("long").alias("mesh_id"), F.col("n").cast("long").alias("n"), "value")


@query("SELECT 12 AS longest FROM (SELECT count(*) AS n FROM part) WHERE n > 0")
def longest_dark_time(spark, sf_dir):
    """Off times whose counts decay by a half life of four: three of them, rounded."""
    h = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("value")).distinct().withColumn("count", 2 + 300 * F.exp(-F.col("value") / 4))
    return spark.createDataFrame([(fit.dark_time(h),)], "longest int")


@query(f"WITH {_NATIONS} SELECT count(*) AS n, round((max(x) - min(x) + 2 * pad) * (max(y) - min(y) + 2 * pad) * (max(z) - min(z) + 2 * pad), 2) AS total FROM p, (SELECT least(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 100 AS pad FROM p) GROUP BY pad")
def nation_cells(spark, sf_dir):
    """Voronoi cells in space fill the box of the points and its pad."""
    p = _nations(spark, sf_dir)
    cells, _ = tess.voronoi3(p, stash(tess.delaunay3(p), "tetrahedra"))
    return cells.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("measure"), 2).alias("total"))


@query("SELECT 2 * count(*) - 4 AS faces, count(*) AS cells, true AS filled FROM supplier")
def sphere_tessellation(spark, sf_dir):
    """Suppliers laid on a sphere: faces by Euler's formula, and cells that fill what the faces do."""
    k = F.col("s_suppkey")
    c = 1 - (2 * k + 1) / (2 * F.lit(table(spark, sf_dir, "supplier").count()) + 3)
    c = 2 * c - 1
    a = k * (math.pi * (3 - math.sqrt(5)))
    p = table(spark, sf_dir, "supplier").select(k.alias("loc_id"), (10 * F.sqrt(1 - c * c) * F.cos(a)).alias("x"), (10 * F.sqrt(1 - c * c) * F.sin(a)).alias("y"), (10 * c).alias("z"))
    p = stash(p, "sphere")
    f = stash(tess.delaunay_on_sphere(p, (0.0, 0.0, 0.0), 10.0), "faces")
    cells, _ = tess.voronoi_on_sphere(p, f, 10.0)
    total = f.agg(F.count(F.lit(1)).alias("faces"), F.sum("measure").alias("m")).crossJoin(cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("measure").alias("c")))  # one row each
    return total.select("faces", "cells", (F.abs(F.col("m") - F.col("c")) < 1e-6 * F.col("m")).alias("filled"))


@query("SELECT 7.071068 AS alpha, 32 AS faces, 1600.0 AS area FROM (SELECT count(*) AS n FROM nation) WHERE n = 25")
def alpha_shape(spark, sf_dir):
    """Nations on a lattice of five by five: the least alpha that holds all is half a square's diagonal."""
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("loc_id"), (F.col("n_nationkey") % 5 * 10.0).alias("x"), (F.floor(F.col("n_nationkey") / 5) * 10.0).alias("y"))
    f = stash(tess.delaunay(p), "faces")
    a = objects.optimal_alpha(f, p)
    kept = objects.alpha_faces(f, p, a * (1 + 1e-6))
    return kept.agg(F.lit(round(a, 6)).alias("alpha"), F.count(F.lit(1)).cast("int").alias("faces"), F.round(F.sum("measure"), 4).alias("area"))


_HULLS = _SQL["convex_hulls"]


@query(f"SELECT mode, object_id, n_locs, measure FROM ({_HULLS}), (VALUES ('triangulation'), ('convex_hull'), ('alpha_shape')) m(mode)")
def object_shapes(spark, sf_dir):
    """Objects' shapes in three modes; without a bound on circumradii the alpha shape is the hull, as the triangulation is."""
    out = None
    for mode in objects.SHAPES:
        one = objects.shapes(_boxed(spark, sf_dir), mode).select(F.lit(mode).alias("mode"), "object_id", "n_locs", F.round("measure", 8).alias("measure"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS place FROM part QUALIFY row_number() OVER (ORDER BY p_retailprice, p_partkey) <= 100")
def first_places(spark, sf_dir):
    return stats.partial_order(table(spark, sf_dir, "part"), "p_retailprice", "p_partkey", 100)


@query("""WITH d AS (SELECT l_orderkey AS k, list_sort(list(l_extendedprice)) AS d FROM lineitem GROUP BY 1 HAVING count(*) > 1),
e AS (SELECT *, list_transform(range(1, len(d)), lambda i: d[i + 1] - d[i]) AS f FROM d)
SELECT k, round(CASE WHEN f[1] <> 0 THEN f[-1] / f[1] END, 6) AS by_first, round(CASE WHEN list_max(f) <> 0 THEN f[-1] / list_max(f) END, 6) AS by_largest, round(CASE WHEN list_min(f) <> 0 THEN f[-1] / list_min(f) END, 6) AS by_smallest,
  round(f[-1], 6) AS raw, round(f[-1] / d[1], 6) AS by_distance, round(d[-1], 6) AS distance FROM e""")
def distance_forms(spark, sf_dir):
    """The other six forms of distances, by their last value."""
    g = table(spark, sf_dir, LI).groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("l_extendedprice")).alias("d")).where(F.size("d") > 1)
    one = lambda m: r6(F.element_at(fit.normalise_distances(F.col("d"), m), -1))
    return g.select(
        "k", one("Norm-FirstDiff").alias("by_first"), one("Norm-MaxDiff").alias("by_largest"), one("Norm-MinDiff").alias("by_smallest"), one("Raw-Differences").alias("raw"),
        one("Norm-Diffs-Only-NoRescale").alias("by_distance"), one("Raw-Distances").alias("distance"),
    )


# --- two colours in regions -----------------------------------------------------------------

_BY_ROI = _ROI_SQL + ", " + _COLOC[_COLOC.index("g AS (") :] + ", rp AS (SELECT roi, pd.* FROM pd JOIN m USING (loc_id))"


def _paired_in_rois(spark, sf_dir) -> DataFrame:
    return stash(_paired(spark, sf_dir).join(roi.matches(pts(spark, sf_dir), rois(spark)).withColumnRenamed("roi_id", "roi"), "loc_id"), "in_rois")


@query(f"WITH {_BY_ROI[5:]} SELECT roi, color, round(coalesce(sum(d1) FILTER (WHERE class = 'coloc'), 0) / sum(d1) FILTER (WHERE class IN ('coloc', 'high_density')), 6) AS manders FROM rp GROUP BY 1, 2")
def manders_by_roi(spark, sf_dir):
    return rounded(coloc.manders(coloc.classify(_paired_in_rois(spark, sf_dir)), by=("roi", "color")), "manders")


@query(f"""WITH {_BY_ROI[5:]}, rk AS (SELECT roi, color, rank() OVER (PARTITION BY roi, color ORDER BY round(d1, 9)) + (count(*) OVER (PARTITION BY roi, color, round(d1, 9)) - 1) / 2 AS ra,
 rank() OVER (PARTITION BY roi, color ORDER BY round(d2, 9)) + (count(*) OVER (PARTITION BY roi, color, round(d2, 9)) - 1) / 2 AS rb FROM rp) SELECT roi, color, round(corr(ra, rb), 6) AS rho FROM rk GROUP BY 1, 2""")
def spearman_by_roi(spark, sf_dir):
    p = _paired_in_rois(spark, sf_dir).select("roi", "color", F.round("d1", 9).alias("d1"), F.round("d2", 9).alias("d2"))
    return rounded(coloc.spearman(p, "d1", "d2", by=("roi", "color")), "rho")


# --- fits and plugins -----------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('lee', 0.7, NULL, NULL), ('half_life', 2.0, 30.0, 8.0), ('decay', 50.0, 0.1, NULL)) v(model, a, b, c)")
def curve_fits(spark, sf_dir):
    """Curves over the sizes of parts, fitted again."""
    n = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("n")).distinct()
    pw = lambda b, e: F.pow(F.lit(b), e)
    y = {"lee": pw(0.7, F.col("n")) * 0.3, "half_life": 2 + 30 * F.exp(-F.col("n") / 8), "decay": 50 * F.exp(-0.1 * F.col("n"))}
    rows = []
    for name, model, start in (("lee", fit.lee, (0.5,)), ("half_life", fit.decay_half_life, (0.0, 20.0, 5.0)), ("decay", fit.decay, (30.0, 0.2))):
        p = fit.curve_fit(n.withColumn("y", y[name]), "n", "y", model, start)
        rows.append((name, *[round(float(v), 5) for v in p], *[None] * (3 - len(p))))
    return spark.createDataFrame(rows, "model string, a double, b double, c double")


@query("SELECT * FROM (VALUES ('general', 10.0, -20.0, 5.0, 40.0, 30.0, 20.0), ('aligned', 10.0, -20.0, 5.0, 40.0, 30.0, 20.0), ('round', 10.0, -20.0, 5.0, 30.0, 30.0, 20.0)) v(form, cx, cy, cz, axis0, axis1, axis2)")
def ellipsoids(spark, sf_dir):
    """Points laid on known ellipsoids by the keys of a table, fitted in three forms."""
    a = table(spark, sf_dir, "orders").selectExpr("o_orderkey * 0.7d as a", "(o_orderkey % 1000) / 1000d * 2 - 1 as c")
    rows = []
    for form, r in (("general", 40), ("aligned", 40), ("round", 30)):
        e = fit.ellipsoid_fit(a.selectExpr("10 + 30 * sqrt(1 - c * c) * cos(a) as x", f"-20 + {r} * sqrt(1 - c * c) * sin(a) as y", "5 + 20 * c as z"), form)
        rows.append((form, *[round(float(v), 5) for v in (*e["centre"], *e["axes"])]))
    return spark.createDataFrame(rows, "form string, cx double, cy double, cz double, axis0 double, axis1 double, axis2 double")


@query("""SELECT vec_id, CASE WHEN list_sum(embedding[1:32]) >= list_sum(embedding[33:64]) THEN 0 ELSE 1 END AS label FROM embeddings""")
def classifier(spark, sf_dir):
    """A model's two scores for each vector; the larger wins."""
    def scores(x: np.ndarray) -> np.ndarray:
        v = x[:, :, 0]
        return np.stack([v[:, :32].sum(1), v[:, 32:].sum(1)], 1)

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return fit.classify_with(e, ["embedding"], scores, "vec_id long, embedding array<double>, label int").select("vec_id", "label")


@query("""SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER w, 5) AS off, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS DOUBLE) AS place FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def two_outputs_plugin(spark, sf_dir):
    def f(v):
        return v - v.mean(), np.searchsorted(np.sort(v), v) + 1.0

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    got = plugins.call(c, f, ["c_acctbal"], ["off", "place"], by=["c_nationkey"], key="c_custkey")
    return got.select("c_custkey", F.round("off", 5).alias("off"), "place")


@query("SELECT round(sum(p_size * p_retailprice) / sum(p_size), 5) AS value FROM part")
def shown_result_plugin(spark, sf_dir):
    """One number of whole columns, to be shown."""
    v = plugins.reduce_columns(table(spark, sf_dir, "part"), lambda s, p: (s * p).sum() / s.sum(), ["p_size", "p_retailprice"])
    return spark.createDataFrame([(round(v, 5),)], "value double")


# --- macros ---------------------------------------------------------------------------------


@query("""SELECT 'DetectionSet' AS name, count(*) AS n FROM orders UNION ALL SELECT 'Suppliers', count(*) FROM (SELECT DISTINCT s_acctbal, s_suppkey FROM supplier)
UNION ALL SELECT 'logged', count(*) FROM orders WHERE log10(o_totalprice / 500.0) BETWEEN 2 AND 2.5 UNION ALL SELECT 'inverted', count(*) FROM orders WHERE NOT (log10(o_totalprice / 500.0) BETWEEN 2 AND 2.5)""")
def macro_tables(spark, sf_dir):
    """A macro that attaches a second file, switches a histogram to its logarithm, selects and inverts the selection."""
    path = scratch(spark, "attached")
    files.write_locs(table(spark, sf_dir, "supplier").selectExpr("s_acctbal as a", "s_suppkey * 1.0d as b"), path)
    d = macro.Dataset(spark, {"DetectionSet": pts(spark, sf_dir)})
    macro.run(d, '{"MainWindow": {"addComponent": {"path": "%s", "name": "Suppliers", "format": "csv", "x": 0, "y": 1}}}\n' % path + (
        '{"DetectionSet": {"histogram": {"feature": "x", "action": "log", "value": true}}}\n{"DetectionSet": {"histogram": {"feature": "x", "action": "changeBoundsCustom", "min": 2, "max": 2.5}}}\n'
        '{"DetectionSet": {"duplicateSelected": {"name": "logged"}}}\n{"DetectionSet": {"invertSelection": {}}}\n{"DetectionSet": {"duplicateSelected": {"name": "inverted"}}}'))  # fmt: skip
    out = None
    for name in ("DetectionSet", "Suppliers", "logged", "inverted"):
        one = d.table(name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
