"""Queries of single operators that the whole queries of the catalog do not show by themselves."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import coloc, fit, graph, objects, select, spatial, stats
from ..runtime import shared_dir
from ..sources import files
from .catalog import PTS, pts, query, r6, rounded, table

LI = "lineitem"


@query("SELECT DISTINCT l_orderkey AS face_id FROM lineitem WHERE l_linenumber % 4 = 0")
def border_faces(spark, sf_dir):
    e = table(spark, sf_dir, LI).select(F.col("l_orderkey").alias("face_id"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_partkey")).alias("neigh"))
    return select.border_faces(e)


@query("SELECT l_orderkey AS face_id FROM lineitem GROUP BY 1 HAVING max(l_quantity) <= 30")
def cut_distance(spark, sf_dir):
    f = table(spark, sf_dir, LI).groupBy(F.col("l_orderkey").alias("face_id")).agg(F.collect_list("l_quantity").alias("edges"))
    return select.cut_distance(f, 30.0).select("face_id")


@query("SELECT p_partkey FROM part WHERE p_retailprice >= 1.001 * (SELECT avg(p_retailprice) FROM part)")
def density_factor(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("density"))
    return select.density_factor(p, 1.001, p.agg(F.avg("density")).first()[0]).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN s.s_acctbal BETWEEN 0 AND 5000 THEN l_suppkey ELSE 0 END AS value FROM lineitem LEFT JOIN supplier s ON s_suppkey = l_suppkey")
def labels_by_feature(spark, sf_dir):
    px = table(spark, sf_dir, LI).select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("value"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("label"), "s_acctbal")
    return select.labels_by_feature(px, s, "s_acctbal", 0, 5000)


@query(f"WITH {PTS} SELECT loc_id, o_custkey AS object_id, CASE WHEN loc_id % 2 = 0 THEN x END AS density FROM pts JOIN orders ON o_orderkey = loc_id WHERE o_custkey % 10 = 0")
def locs_of_objects(spark, sf_dir):
    p, o = pts(spark, sf_dir), table(spark, sf_dir, "orders")
    link = o.select(F.col("o_orderkey").alias("loc_id"), F.col("o_custkey").alias("object_id"))
    chosen = link.where("object_id % 10 = 0").select("object_id").distinct()
    density = p.where("loc_id % 2 = 0").select("loc_id", F.col("x").alias("density"))
    return select.locs_of_objects(p.select("loc_id"), link, chosen, density)


@query("SELECT DISTINCT o_orderkey AS loc_id, o_custkey AS object_id FROM orders WHERE o_orderkey % 3 <> 0")
def outline_locs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    e = o.where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("a"), F.col("o_orderkey").alias("b"))
    return files.outline_locs(o.select(F.col("o_orderkey").alias("loc_id")), e).select("loc_id", "object_id")


@query("SELECT s_suppkey AS id, s_acctbal, s_nationkey FROM supplier")
def object_stats(spark, sf_dir):
    return files.object_stats(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("object_id"), "s_nationkey", "s_acctbal"))


@query("""WITH e AS (SELECT user_id, event_type, event_id, value, sqrt((value - lag(value) OVER w) ** 2 + 1.0) AS d FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
SELECT user_id AS skeleton_id, round(coalesce(sum(d), 0), 4) AS length, count(*) AS n FROM e GROUP BY 1""")
def skeleton_features(spark, sf_dir):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("skeleton_id"), F.col("event_type").alias("segment_id"), k.alias("seq"), F.col("value").alias("x"), k.cast("double").alias("y"), F.lit(0.0).alias("z"))
    return objects.skeleton_features(s).withColumn("length", F.round("length", 4))


@query("SELECT i AS segment_id, i - i % 3 AS skeleton FROM range(300) t(i)")
def merged_segments(spark, sf_dir):
    """Segments laid end to end in threes."""
    s = spark.range(300).selectExpr("id as segment_id", "cast(id div 3 as double) * 100 + id % 3 as x0")
    ends = s.selectExpr("segment_id", "x0 as x", "0d as y", "0d as z").unionByName(s.selectExpr("segment_id", "x0 + 1 as x", "0.0002d as y", "0d as z"))
    return graph.merge_segments(ends)


@query("SELECT p_partkey AS mesh_id, round(CAST(p_size AS DOUBLE) ** 3, 4) AS volume, round(6.0 * p_size ** 2, 4) AS surface, 8 AS n_vertices FROM part")
def mesh_measures(spark, sf_dir):
    """Cubes as large as parts."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mesh_id"), F.col("p_size").cast("double").alias("s"))
    v = p.withColumn("vertex_id", F.explode(F.sequence(F.lit(0), F.lit(7)))).selectExpr("mesh_id", "vertex_id", "s * (vertex_id & 1) as x", "s * ((vertex_id div 2) & 1) as y", "s * (vertex_id div 4) as z")
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    tri = [(a, b, c) for a, b, c, d in quads] + [(a, c, d) for a, b, c, d in quads]
    f = p.select("mesh_id", F.explode(F.array(*[F.struct(*[F.lit(i).alias(k) for i, k in zip(t, "abc", strict=True)]) for t in tri])).alias("t")).select("mesh_id", "t.*")
    return objects.mesh_measures(v, f).select("mesh_id", F.round("volume", 4).alias("volume"), F.round("surface", 4).alias("surface"), F.col("n_vertices").cast("int"))


@query("""SELECT l_orderkey, l_linenumber,
 CASE WHEN (a2 - a1) = 0 THEN NULL ELSE round(l_discount + (25 - l_quantity) * (l_tax * 10 - l_discount) / (a2 - a1), 9) END AS y_at FROM (SELECT *, l_quantity AS a1, CAST(l_linenumber * 9 AS DOUBLE) AS a2 FROM lineitem)""")
def line_algebra(spark, sf_dir):
    a, b = (F.col("l_quantity"), F.col("l_discount")), ((F.col("l_linenumber") * 9).cast("double"), F.col("l_tax") * 10)
    return table(spark, sf_dir, LI).select("l_orderkey", "l_linenumber", F.round(C.line_at(F.lit(25.0), a, b), 9).alias("y_at"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, CAST(l_linenumber AS DOUBLE) AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, x BETWEEN 10 AND 40 AND y BETWEEN 2 AND 5 AS in_rect, x = 10 OR x < 10 AND (x + 15 >= 10) AS crosses FROM s""")
def rectangle_and_segments(spark, sf_dir):
    """A horizontal segment of length 15 from each point against the line x = 10."""
    x, y = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return table(spark, sf_dir, LI).select(
        "l_orderkey", "l_linenumber", C.point_in_rect((x, y), F.lit(10.0), F.lit(2.0), F.lit(40.0), F.lit(5.0)).alias("in_rect"),
        C.segments_meet((x, y), (x + 15, y), (F.lit(10.0), F.lit(-100.0)), (F.lit(10.0), F.lit(100.0))).alias("crosses"),
    )


@query("SELECT CAST(k AS INTEGER) AS k, round(343 / 15.0 * sqrt(7 / (2 * pi())) * (k / 10.0) ** 2.5 * exp(-3.5 * k / 10.0), 6) AS plane, round(3125 / 24.0 * (k / 10.0) ** 4 * exp(-5 * k / 10.0), 6) AS space FROM range(1, 40) t(k)")
def random_cell_sizes(spark, sf_dir):
    k = spark.range(1, 40).select(F.col("id").cast("int").alias("k"))
    x = F.col("k") / 10.0
    return k.select("k", r6(fit.voronoi_reference(x, 2)).alias("plane"), r6(fit.voronoi_reference(x, 3)).alias("space"))


@query("""WITH h AS (SELECT CAST(floor(c_acctbal / 1000) AS INTEGER) AS bin, count(*) AS n FROM customer GROUP BY 1) SELECT min(bin) FILTER (WHERE n <= 130 + bin) AS threshold FROM h""")
def first_crossing(spark, sf_dir):
    h = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_acctbal") / 1000).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return stats.first_crossing(h.withColumn("m", F.col("bin") + 130), "n", "m", "bin")


@query("SELECT round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 4) AS slope FROM lineitem")
def line_through_zero(spark, sf_dir):
    return fit.linear_through_zero(table(spark, sf_dir, LI), "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"))


@query("""WITH p AS (SELECT l_quantity + 1 AS x, l_discount * 100 + 1 AS y, l_linenumber * 3.0 AS z FROM lineitem), s AS (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM p)
SELECT round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, count(*) AS n FROM s GROUP BY floor((atan2(y, x) + pi()) / (pi() / 18)), floor(acos(z / r) / (pi() / 18))""")
def regularised_sectors(spark, sf_dir):
    p = table(spark, sf_dir, LI).selectExpr("l_quantity + 1 as x", "l_discount * 100 + 1 as y", "l_linenumber * 3.0d as z")
    return fit.regularise_sectors(p, 0.0, 0.0, 0.0).select(*[F.round(a, 9).alias(a) for a in "xyz"], "n")


@query("""SELECT l_orderkey, l_linenumber, round(10 * x / r, 6) AS x, round(10 * y / r, 6) AS y, round(10 * z / r, 6) AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM
 (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y, l_linenumber * 3.0 AS z FROM lineitem))""")
def on_sphere(spark, sf_dir):
    p = table(spark, sf_dir, LI).selectExpr("l_orderkey", "l_linenumber", "l_quantity x", "l_discount * 100 y", "l_linenumber * 3.0d z")
    return rounded(fit.project_on_sphere(p, 0.0, 0.0, 0.0, 10.0), "x", "y", "z")


@query("SELECT c_custkey AS face_id, c_custkey % 7 AS object1, c_custkey % 5 AS object2 FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0")
def shared_faces(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("face_id"))
    one = c.select(F.col("face_id").alias("loc_id"), F.when(F.col("face_id") % 2 == 0, F.col("face_id") % 7).alias("object"))
    two = c.select(F.col("face_id").alias("loc_id"), F.when(F.col("face_id") % 3 == 0, F.col("face_id") % 5).alias("object"))
    return coloc.shared_faces(c, one, two)


@query("SELECT o_orderkey AS loc_id, o_custkey AS object_id, c_nationkey AS other_object FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0")
def locs_in_other(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("loc_id"), F.col("o_custkey").alias("object_id"), F.col("o_custkey").alias("face_id"))
    f = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("face_id"), F.col("c_nationkey").alias("object_id"))
    return coloc.locs_in_other(o, f)


@query("SELECT p_partkey, p_retailprice >= 1200 AND p_size % 2 = 1 AND p_size <= 40 AS selected FROM part")
def border_correction(spark, sf_dir):
    c = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_retailprice as d1", "p_size % 2 = 0 as is_border", "cast(p_size as double) as measure")
    return coloc.border_correction(c, 1200.0, 40.0).select("p_partkey", "selected")


@query("""WITH d AS (SELECT l_partkey * 0.5 AS x, l_suppkey * 2.0 AS y, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT round(sum(x), 3) AS sx, round(sum(y), 3) AS sy, count(*) AS n, max(n_) AS last FROM d, (SELECT count(*) AS n_ FROM d)""")
def text_file_round_trip(spark, sf_dir):
    """Localizations written as text and read again by column index."""
    path = f"{shared_dir(spark)}/round-trip-{uuid.uuid4().hex}"
    li = table(spark, sf_dir, LI).selectExpr("l_partkey * 0.5d as x", "l_suppkey * 2.0d as y", "l_quantity as q")
    files.write_locs(li, path)
    back = files.read_locs(spark, path, {"x": 1, "y": 2, "frame": 0}, 44)
    return back.agg(F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("y"), 3).alias("sy"), F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS off, true AS fair FROM orders")
def random_sphere_points(spark, sf_dir):
    """A point on a sphere for each order: how many, how many lie off it, and whether means and means of squares of the
    coordinates are those of a uniform spread, within five standard errors (r / sqrt(3n) and r**2 * sqrt(4 / 45n))."""
    s = C.sphere_points(pts(spark, sf_dir).select("loc_id"), 5.0, 3)
    off = F.abs(C.length([F.col(a) for a in "xyz"]) - 5.0) > 1e-9
    n = F.count(F.lit(1))
    fair = F.lit(True)
    for a in "xyz":
        fair = fair & (F.abs(F.avg(a)) <= 5 * 5.0 / F.sqrt(3 * n)) & (F.abs(F.avg(F.col(a) * F.col(a)) - 25.0 / 3) <= 5 * 25.0 * F.sqrt(F.lit(4.0) / (45 * n)))
    return s.agg(n.alias("n"), F.sum(off.cast("long")).alias("off"), fair.alias("fair"))


@query(f"SELECT s_suppkey, round(100 / ({4 * math.pi!r} * (s_suppkey + 1) * (s_suppkey + 1)), 9) AS density FROM supplier")
def sphere_density(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(stats.sphere_density(F.lit(100.0), F.col("s_suppkey") + 1), 9).alias("density"))


@query(f"""WITH {PTS}, e AS (SELECT a.loc_id AS a, b.loc_id AS b FROM pts a JOIN pts b ON a.loc_id <> b.loc_id AND abs(a.x - b.x) <= 8 AND abs(a.y - b.y) <= 8 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 64 AND abs(a.loc_id % 50 - b.loc_id % 50) < 10)
SELECT a, count(*) AS n FROM e GROUP BY 1""")
def region_query_in_time(spark, sf_dir):
    p = pts(spark, sf_dir).withColumn("frame", F.col("loc_id") % 50)
    return spatial.neighbour_counts(p, 8.0, max_dt=10).select(F.col("loc_id").alias("a"), "n")
