"""All queries of the engine by name, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import plugins
from ..operators import coloc, fit, graph, objects, overlap, ripley, roi, select, spatial, stats, tess, tracks
from ..runtime import stash
from ..sources import files
from . import macro
from .views import FRAMES, PTS, TRACKS, frames, pts, table, track_points, two_colours

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more, single  # noqa: F401  register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import more, single  # noqa: F401

    return dict(_SQL)


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


#: The radius of neighbour queries, the same at every size.
RADIUS = 10.0
R10 = str(RADIUS)
#: Pairs of points within the radius by SQL: a join on grid cells.
NEAR = f"""g AS (SELECT *, CAST(floor(x / r) AS BIGINT) AS cx, CAST(floor(y / r) AS BIGINT) AS cy FROM (SELECT *, {R10} AS r FROM pts)),
near AS (SELECT a.loc_id AS a, b.loc_id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, a.r AS r, b.color AS color_b
  FROM g a JOIN (SELECT g.*, cx + dx AS kx, cy + dy AS ky FROM g, (VALUES (-1), (0), (1)) u(dx), (VALUES (-1), (0), (1)) v(dy)) b ON a.cx = b.kx AND a.cy = b.ky)"""


# --- sources --------------------------------------------------------------------------------


@query("""WITH raw AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS p, l_partkey * 0.5 AS x, l_suppkey * 0.5 AS y, l_quantity * 2.0 AS frame FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY l_orderkey, l_linenumber, p) AS k FROM raw)
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, p) AS id, x, y, frame FROM d WHERE k = 1""")
def load_calibrate_dedup(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("p"), F.col("l_partkey").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"), F.col("l_quantity").alias("frame")
    )
    order = ["l_orderkey", "l_linenumber", "p"]
    d = files.distinct_places(files.calibrate(raw, 0.5, 1.0, 2.0), order)
    one = d.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_n"))
    base = stats.running_total(one, [], "l_orderkey", "_n").select("l_orderkey", "_before")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "p"))
    return d.withColumn("_p", place).join(base, "l_orderkey").select((F.col("_before") + F.col("_p")).cast("long").alias("id"), "x", "y", "frame")


@query(f"""WITH {FRAMES}, a AS (SELECT * FROM fr WHERE user_id % 2 = 0), b AS (SELECT * FROM fr WHERE user_id % 2 = 1)
SELECT loc_id, frame, x FROM a UNION ALL SELECT loc_id, frame + (SELECT max(frame) + 1 FROM a), x FROM b""")
def stack_sets(spark, sf_dir):
    f = frames(spark, sf_dir)
    both = [f.where(F.col("user_id") % 2 == k).select("loc_id", "frame", "x") for k in (0, 1)]
    return files.stack(*both)


@query(f"WITH {FRAMES} SELECT count(*) AS n, max(frame) + 1 AS n_frames, CAST(floor(min(x)) AS BIGINT) AS min_x, CAST(ceil(max(x)) AS BIGINT) AS max_x FROM fr")
def describe_set(spark, sf_dir):
    return files.describe_set(frames(spark, sf_dir).select("loc_id", "frame", "x"))


@query(f"WITH {PTS}, c AS (SELECT (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM pts) SELECT loc_id, round((x - mx) / 100, 8) AS x, round((y - my) / 100, 8) AS y FROM pts, c")
def scale_for_network(spark, sf_dir):
    scaled, _ = files.scale_for_network(pts(spark, sf_dir).drop("color"))
    return scaled.select("loc_id", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


@query(f"WITH {PTS} SELECT loc_id, round(x, 6) AS x, round(y, 6) AS y FROM pts")
def rescale_from_network(spark, sf_dir):
    scaled, centre = files.scale_for_network(pts(spark, sf_dir).drop("color"))
    return rounded(files.rescale_from_network(scaled, centre), "x", "y")


# --- scalar functions -----------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS log_balance FROM customer")
def log_view(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", r6(C.log_view("c_acctbal")).alias("log_balance"))


@query(f"""WITH {PTS}, c AS (SELECT (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM pts)
SELECT loc_id, round(mx + sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) * cos(atan2(y - my, x - mx) + 0.5), 5) AS x,
  round(my + sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) * sin(atan2(y - my, x - mx) + 0.5), 5) AS y FROM pts, c""")
def rotate(spark, sf_dir):
    p = pts(spark, sf_dir)
    m = p.agg(*[((F.min(a) + F.max(a)) / 2).alias(a) for a in "xy"]).first()
    x, y = C.rotate(F.col("x"), F.col("y"), F.lit(m["x"]), F.lit(m["y"]), 0.5)
    return p.select("loc_id", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


@query("""SELECT p_partkey, round((p_retailprice - lo) / (hi - lo) * 255, 6) AS u8, round((p_retailprice - lo) / (hi - lo), 6) AS f
FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)""")
def normalise_image(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lo, hi = p.agg(F.min("p_retailprice"), F.max("p_retailprice")).first()
    v = F.col("p_retailprice")
    return p.select("p_partkey", r6(C.normalise(v, F.lit(lo), F.lit(hi), 255)).alias("u8"), r6(C.normalise(v, F.lit(lo), F.lit(hi), 1)).alias("f"))


_TRI = ("l_partkey % 97", "l_suppkey % 89", "l_quantity", "l_linenumber * 7.0", "l_orderkey % 83", "l_discount * 100")


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for e, n in zip(_TRI, ('ax', 'ay', 'bx', 'bw', 'cx', 'cy'), strict=True))} FROM lineitem),
s AS (SELECT *, sqrt((ax - bx) ** 2 + (ay - bw) ** 2) AS ab, sqrt((bx - cx) ** 2 + (bw - cy) ** 2) AS bc, sqrt((cx - ax) ** 2 + (cy - ay) ** 2) AS ca FROM t)
SELECT l_orderkey, l_linenumber, round(sqrt(abs((ab + bc + ca) / 2 * ((ab + bc + ca) / 2 - ab) * ((ab + bc + ca) / 2 - bc) * ((ab + bc + ca) / 2 - ca))), 4) AS heron,
  round(abs((bx - ax) * (cy - ay) - (cx - ax) * (bw - ay)) / 2, 4) AS by_corners, round((ax + bx + cx) / 3, 6) AS mx, round(ab, 6) AS side,
  NOT (((20 - bx) * (ay - bw) - (ax - bx) * (20 - bw) < 0 OR (20 - cx) * (bw - cy) - (bx - cx) * (20 - cy) < 0 OR (20 - ax) * (cy - ay) - (cx - ax) * (20 - ay) < 0)
   AND ((20 - bx) * (ay - bw) - (ax - bx) * (20 - bw) > 0 OR (20 - cx) * (bw - cy) - (bx - cx) * (20 - cy) > 0 OR (20 - ax) * (cy - ay) - (cx - ax) * (20 - ay) > 0)) AS holds
FROM s""")
def triangles(spark, sf_dir):
    names = ("ax", "ay", "bx", "by", "cx", "cy")
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(f"cast({e} as double)").alias(n) for e, n in zip(_TRI, names, strict=True)])
    a, b, c = [(F.col(f"{k}x"), F.col(f"{k}y")) for k in "abc"]
    p = (F.lit(20.0), F.lit(20.0))
    return t.select(
        "l_orderkey", "l_linenumber", F.round(C.heron_area(C.distance(a, b), C.distance(b, c), C.distance(c, a)), 4).alias("heron"),
        F.round(C.cross_area(a, b, c), 4).alias("by_corners"), r6((a[0] + b[0] + c[0]) / 3).alias("mx"), r6(C.distance(a, b)).alias("side"), C.in_triangle(p, a, b, c).alias("holds"),
    )


@query("""WITH p AS (SELECT l_orderkey AS k, list({'x': l_partkey % 100 + 0.5, 'y': l_suppkey % 50 * 1.0} ORDER BY l_linenumber, l_partkey, l_suppkey) AS pts FROM lineitem GROUP BY 1 HAVING count(*) >= 3)
SELECT k, len(pts) AS n, round(abs(list_sum(list_transform(range(1, len(pts) + 1), lambda i:
  (pts[i % len(pts) + 1].x - pts[i].x) * (pts[i % len(pts) + 1].y + pts[i].y) / 2))), 4) AS area,
 round(list_sum(list_transform(range(1, len(pts) + 1), lambda i: sqrt((pts[i % len(pts) + 1].x - pts[i].x) ** 2 + (pts[i % len(pts) + 1].y - pts[i].y) ** 2))), 4) AS perimeter FROM p""")
def polygons(spark, sf_dir):
    pt = F.struct(F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), (F.col("l_partkey") % 100 + 0.5).alias("x"), (F.col("l_suppkey") % 50 * 1.0).alias("y"))
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(pt)).alias("pts"))
    g = g.where(F.size("pts") >= 3)
    return g.select("k", F.size("pts").cast("long").alias("n"), F.round(C.polygon_area(F.col("pts")), 4).alias("area"), F.round(C.polygon_perimeter(F.col("pts")), 4).alias("perimeter"))


@query("""WITH c AS (SELECT p_partkey, p_size * 5 AS r, p_partkey % 256 AS g, (p_size * 3 + 7) % 256 AS b FROM part),
l AS (SELECT *, list_transform([r, g, b], lambda v: CASE WHEN v / 255.0 <= 0.04045 THEN v / 255.0 / 12.92 ELSE pow((v / 255.0 + 0.055) / 1.055, 2.4) END) AS s FROM c),
y AS (SELECT *, 0.2126 * s[1] + 0.7152 * s[2] + 0.0722 * s[3] AS lum FROM l)
SELECT p_partkey, '#' || printf('%02x', r) || printf('%02x', g) || printf('%02x', b) AS hex, round(lum, 6) AS lum,
  round(CASE WHEN lum <= 216 / 24389.0 THEN lum * (24389 / 27.0) ELSE pow(lum, 1 / 3.0) * 116 - 16 END, 5) AS light,
  round((greatest(lum, 1.0) + 0.05) / (least(lum, 1.0) + 0.05), 5) AS contrast, ceil(r / 7.0) * 7.0 AS up FROM y""")
def colours(spark, sf_dir):
    c = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 5).alias("r"), (F.col("p_partkey") % 256).alias("g"), ((F.col("p_size") * 3 + 7) % 256).alias("b"))
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    lum = C.luminance(r, g, b)
    return c.select(
        "p_partkey", C.hex_colour(r, g, b).alias("hex"), r6(lum).alias("lum"), F.round(C.lightness(lum), 5).alias("light"),
        F.round(C.contrast(lum, F.lit(1.0)), 5).alias("contrast"), C.round_up(r, 7).alias("up"),
    )


@query("""SELECT p_partkey, len(string_split(p_type, ' ')) AS words, list_extract(['low', 'mid', 'high', 'top'],
  CAST(least(4, greatest(1, floor((p_retailprice - 900.0) / 300.0) + 1)) AS INTEGER)) AS shade FROM part""")
def palette(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.size(C.split_text(F.col("p_type"), " ")).cast("long").alias("words"), C.palette_colour(F.col("p_retailprice"), 900.0, 2100.0, ["low", "mid", "high", "top"]).alias("shade"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS ax, l_discount * 100 AS ay, l_partkey % 50 * 1.0 AS bx, l_suppkey % 50 * 1.0 AS bw FROM lineitem WHERE NOT (l_quantity = l_partkey % 50 AND l_discount * 100 = l_suppkey % 50)),
q AS (SELECT *, (bx - ax) ** 2 + (bw - ay) ** 2 AS qa, 2 * ((ax - 25) * (bx - ax) + (ay - 20) * (bw - ay)) AS qb, (ax - 25) ** 2 + (ay - 20) ** 2 - 225 AS qc FROM s),
t AS (SELECT *, qb * qb - 4 * qa * qc AS disc FROM q)
SELECT l_orderkey, l_linenumber, CASE WHEN disc < 0 THEN 0 ELSE len(list_filter(list_distinct([(-qb - sqrt(greatest(disc, 0))) / (2 * qa), (-qb + sqrt(greatest(disc, 0))) / (2 * qa)]), lambda v: v >= 0 AND v <= 1)) END AS hits,
  round(ax + ((25 - ax) * (bx - ax) + (20 - ay) * (bw - ay)) / qa * (bx - ax), 6) AS foot_x FROM t""")
def circle_hits(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity ax", "l_discount * 100 ay", "l_partkey % 50 * 1.0d bx", "l_suppkey % 50 * 1.0d by").where("not (ax = bx and ay = by)")
    a, b, c = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), (F.lit(25.0), F.lit(20.0))
    return s.select("l_orderkey", "l_linenumber", F.size(C.circle_segment_hits(c, F.lit(15.0), a, b)).cast("long").alias("hits"), r6(C.closest_on_line(c, a, b)[0]).alias("foot_x"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) * l_tax - l_discount * l_linenumber AS cz,
  round(sqrt(l_quantity ** 2 + l_discount ** 2 + l_tax ** 2), 6) AS len, round(l_quantity * l_linenumber + l_discount * l_tax + l_tax * l_quantity, 6) AS dot FROM lineitem""")
def vectors(spark, sf_dir):
    a = [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")]
    b = [F.col("l_linenumber").cast("double"), F.col("l_tax"), F.col("l_quantity")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.cross3(a, b)[2].alias("cz"), r6(C.length(a)).alias("len"), r6(C.dot(a, b)).alias("dot"))


# --- selections -----------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 AND l_discount BETWEEN 0.02 AND 0.06 AND l_extendedprice > 0 AND log10(l_extendedprice) <= 4.5")
def conjunctive_selection(spark, sf_dir):
    bounds = select.change_bounds({"l_quantity": (10, 30), "l_discount": (0.02, 0.06)}, "l_extendedprice", None, 4.5)
    return select.select(table(spark, sf_dir, "lineitem"), bounds, {"l_extendedprice"}).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, NOT (l_quantity BETWEEN 10 AND 30) AS selected FROM lineitem")
def inverted_selection(spark, sf_dir):
    return select.invert(select.mark(table(spark, sf_dir, "lineitem"), {"l_quantity": (10, 30)})).select("l_orderkey", "l_linenumber", "selected")


@query("SELECT s.pos, c_custkey, c_acctbal FROM (SELECT unnest(range(20)) AS pos) s JOIN customer ON c_custkey = (s.pos * 7) % 10 + 1")
def gather_rows(spark, sf_dir):
    idx = spark.range(20).select(F.col("id").alias("pos"), ((F.col("id") * 7) % 10 + 1).alias("c_custkey"))
    return select.gather(table(spark, sf_dir, "customer"), idx, "c_custkey").select("pos", "c_custkey", "c_acctbal")


@query(f"WITH {PTS} SELECT loc_id FROM pts QUALIFY row_number() OVER (ORDER BY md5('7:' || loc_id), loc_id) <= floor((SELECT count(*) FROM pts) * 0.3)")
def keep_share(spark, sf_dir):
    return select.keep_share(pts(spark, sf_dir), 0.3, "loc_id", 7).select("loc_id")


@query("SELECT p_partkey FROM part QUALIFY row_number() OVER (ORDER BY p_retailprice, p_partkey) <= floor((SELECT count(*) FROM part) * 0.95)")
def envelope(spark, sf_dir):
    return select.envelope(table(spark, sf_dir, "part"), "p_retailprice", 0.95, "p_partkey").select("p_partkey")


@query(f"WITH {PTS} SELECT loc_id FROM pts WHERE x > 100 AND x < 400 AND y > 200 AND y < 900")
def crop_strict(spark, sf_dir):
    return select.crop(pts(spark, sf_dir), {"x": (100, 400), "y": (200, 900)}, strict=True).select("loc_id")


@query(f"WITH {PTS}, o AS (SELECT CAST(floor(x / 20) AS BIGINT) * 1000 + CAST(floor(y / 20) AS BIGINT) AS object_id, count(*) AS n_locs, (max(x) - min(x)) * (max(y) - min(y)) AS measure FROM pts GROUP BY 1) SELECT object_id, n_locs FROM o WHERE n_locs BETWEEN 4 AND 20 AND measure BETWEEN 10 AND 350")
def object_filter(spark, sf_dir):
    p = pts(spark, sf_dir).withColumn("object_id", F.floor(F.col("x") / 20) * 1000 + F.floor(F.col("y") / 20))
    o = p.groupBy("object_id").agg(F.count(F.lit(1)).alias("n_locs"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("measure"))
    return select.object_filter(o, 4, 20, 10, 350).select("object_id", "n_locs")


@query("""WITH f AS (SELECT l_orderkey AS face_id, list_distinct(list(l_partkey)) AS v FROM lineitem GROUP BY 1)
SELECT face_id, len(list_filter(v, lambda p: p % 3 = 0)) = len(v) AS selected,
 CASE WHEN len(list_distinct(list_transform(v, lambda p: p % 2))) = 1 THEN v[1] % 2 END AS label FROM f""")
def face_selections(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    f = li.groupBy(F.col("l_orderkey").alias("face_id")).agg(F.collect_set("l_partkey").alias("v"))
    ids = li.select(F.col("l_partkey").alias("loc_id")).distinct()
    sel = select.faces_of_selected(f, ids.withColumn("selected", F.col("loc_id") % 3 == 0))
    return sel.join(select.faces_of_labels(f, ids.withColumn("label", F.col("loc_id") % 2)), "face_id")


_ROIS = [
    (1, "circle", [(200.0, 300.0, 0.0)], 80.0), (2, "rectangle", [(500.0, 100.0, 0.0), (650.0, 420.0, 0.0)], None),
    (3, "triangle", [(100.0, 600.0, 0.0), (300.0, 600.0, 0.0), (200.0, 900.0, 0.0)], None),
    (4, "polygon", [(550.0, 300.0, 0.0), (900.0, 310.0, 0.0), (880.0, 700.0, 0.0), (700.0, 450.0, 0.0)], None), (5, "line", [(0.0, 0.0, 0.0), (900.0, 900.0, 0.0)], None),
]


def rois(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ROIS, files.ROI_SCHEMA)


_S3 = "((x - {2}) * ({1} - {3}) - ({0} - {2}) * (y - {3}))"


def _tri_sql(a, b, c) -> str:
    s = [_S3.format(*p, *q) for p, q in ((a, b), (b, c), (c, a))]
    return f"NOT (({' OR '.join(f'{k} < 0' for k in s)}) AND ({' OR '.join(f'{k} > 0' for k in s)}))"


def _poly_sql(p) -> str:
    e = [f"CASE WHEN ({p[i][1]} > y) <> ({p[j][1]} > y) AND x < ({p[j][0]} - {p[i][0]}) * (y - {p[i][1]}) / nullif({p[j][1]} - {p[i][1]}, 0) + {p[i][0]} THEN 1 ELSE 0 END" for i, j in zip(range(len(p)), [*range(1, len(p)), 0], strict=True)]
    return f"({' + '.join(e)}) % 2 = 1"


_ROI_SQL = f"""WITH {PTS}, m AS (
  SELECT loc_id, 1 AS roi FROM pts WHERE (x - 200) ** 2 + (y - 300) ** 2 <= 6400 UNION ALL
  SELECT loc_id, 2 FROM pts WHERE x BETWEEN 500 AND 650 AND y BETWEEN 100 AND 420 UNION ALL
  SELECT loc_id, 3 FROM pts WHERE {_tri_sql(*[p[:2] for p in _ROIS[2][2]])} UNION ALL
  SELECT loc_id, 4 FROM pts WHERE {_poly_sql([p[:2] for p in _ROIS[3][2]])})"""


@query(_ROI_SQL + " SELECT DISTINCT loc_id FROM m")
def locs_in_rois(spark, sf_dir):
    return roi.in_any(pts(spark, sf_dir), rois(spark)).select("loc_id")


@query(_ROI_SQL + " SELECT pts.loc_id, coalesce(min(roi), 0) AS roi FROM pts LEFT JOIN m USING (loc_id) GROUP BY 1")
def first_roi(spark, sf_dir):
    return roi.first_roi(pts(spark, sf_dir), rois(spark)).select("loc_id", "roi")


@query("""SELECT * FROM (VALUES (1, 20106.192983, 502.654825), (2, 48000.0, 940.0), (3, 30000.0, 832.455532), (4, 63100.0, 1260.845782), (5, NULL, 1272.792206)) v(roi_id, area, perimeter)""")
def roi_measures(spark, sf_dir):
    k, p, r = F.col("kind"), F.col("pts"), F.col("radius")
    return rois(spark).select("roi_id", r6(roi.area(k, p, r)).alias("area"), r6(roi.perimeter(k, p, r)).alias("perimeter"))


# --- spatial joins --------------------------------------------------------------------------


@query(f"WITH {PTS}, {NEAR} SELECT a AS loc_id, count(*) AS density FROM near WHERE d2 < r * r GROUP BY a")
def density_within(spark, sf_dir):
    p = pts(spark, sf_dir)
    return spatial.density_within(p, RADIUS)


@query(f"WITH {PTS}, {NEAR} SELECT a AS loc_id, count(*) AS density FROM near WHERE d2 <= r * r GROUP BY a")
def density_within_inclusive(spark, sf_dir):
    p = pts(spark, sf_dir)
    return spatial.density_within(p, RADIUS, strict=False)


@query(f"WITH {PTS}, {NEAR} SELECT a, count(*) AS n FROM near WHERE d2 <= r * r AND a <> b GROUP BY a")
def region_query(spark, sf_dir):
    p = pts(spark, sf_dir)
    return spatial.neighbour_counts(p, RADIUS).select(F.col("loc_id").alias("a"), "n")


_DBSCAN = f"""WITH RECURSIVE {PTS}, {NEAR}, nb AS (SELECT a, b, d2 FROM near WHERE d2 <= r * r AND a <> b),
core AS (SELECT a AS v FROM nb GROUP BY a HAVING count(*) >= 8),
e AS (SELECT a, b FROM nb WHERE a IN (SELECT v FROM core) AND b IN (SELECT v FROM core)),
reach(root, v) AS (SELECT v, v FROM core UNION SELECT root, e.b FROM reach JOIN e ON reach.v = e.a WHERE e.b > 0),
lab AS (SELECT v AS loc_id, min(root) AS cluster FROM reach GROUP BY v),
ok AS (SELECT cluster FROM lab GROUP BY cluster HAVING count(*) >= 2)"""


@query(_DBSCAN + " SELECT loc_id, lab.cluster FROM pts LEFT JOIN (SELECT * FROM lab WHERE cluster IN (SELECT cluster FROM ok)) lab USING (loc_id)")
def dbscan(spark, sf_dir):
    p = pts(spark, sf_dir)
    return spatial.dbscan(p, RADIUS, 8, 2).select("loc_id", "cluster")


@query(_DBSCAN + """, bl AS (SELECT a AS loc_id, arg_min(lab.cluster, [d2, b]) AS cluster FROM nb JOIN lab ON b = lab.loc_id WHERE a NOT IN (SELECT v FROM core) GROUP BY a),
al AS (SELECT * FROM lab UNION ALL SELECT * FROM bl) SELECT loc_id, al.cluster FROM pts LEFT JOIN al USING (loc_id)""")
def dbscan_with_border(spark, sf_dir):
    p = pts(spark, sf_dir)
    return spatial.dbscan(p, RADIUS, 8, 1, border=True).select("loc_id", "cluster")


@query(_DBSCAN + """ SELECT cluster AS object_id, count(*) AS n_locs, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy, round(min(x), 6) AS min_x, round(max(y), 6) AS max_y
FROM lab JOIN pts USING (loc_id) WHERE cluster IN (SELECT cluster FROM ok) GROUP BY 1""")
def dbscan_objects(spark, sf_dir):
    p = pts(spark, sf_dir)
    m = spatial.dbscan(p, RADIUS, 8, 2, keep=["x", "y"]).where("cluster is not null")
    g = m.groupBy(F.col("cluster").alias("object_id")).agg(F.count(F.lit(1)).alias("n_locs"), F.round(F.avg("x"), 9).alias("cx"), F.round(F.avg("y"), 9).alias("cy"), F.min("x").alias("min_x"), F.max("y").alias("max_y"))
    return rounded(g, "min_x", "max_y")


@query(f"""WITH {PTS}, two AS (SELECT * FROM pts WHERE color IN ('F', 'O')),
n AS (SELECT a.loc_id, b.loc_id AS other, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM two a JOIN two b ON a.color <> b.color AND abs(a.x - b.x) < 120 AND abs(a.y - b.y) < 120)
SELECT loc_id, other, round(sqrt(d2), 6) AS distance FROM n QUALIFY row_number() OVER (PARTITION BY loc_id ORDER BY d2, other) = 1""")
def nearest_other_colour(spark, sf_dir):
    got = spatial.nearest_of_other_colour(two_colours(spark, sf_dir).withColumn("v", F.col("x")), "v")
    return got.select("loc_id", "other", r6("distance").alias("distance"))


@query(f"""WITH {PTS}, n AS (SELECT a.loc_id, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2, b.loc_id AS other FROM pts a JOIN pts b ON a.loc_id <> b.loc_id AND abs(a.x - b.x) < 100 AND abs(a.y - b.y) < 100),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY loc_id ORDER BY d2, other) <= 5)
SELECT loc_id, round(min(sqrt(d2)), 6) AS first, round(max(sqrt(d2)), 6) AS fifth, round(sum(sqrt(d2)), 5) AS total FROM k GROUP BY 1""")
def distance_table(spark, sf_dir):
    d = spatial.distance_table(pts(spark, sf_dir), 5)
    v = F.col("distances")
    return d.select("loc_id", r6(v[0]).alias("first"), r6(v[4]).alias("fifth"), F.round(F.aggregate(v, F.lit(0.0), lambda s, e: s + e), 5).alias("total"))


@query(f"""WITH {PTS}, f AS (SELECT CAST(i AS BIGINT) * 20 + j AS face_id, i * 50.0 AS x0, j * 50.0 AS y0 FROM range(20) a(i), range(20) b(j)),
t AS (SELECT face_id * 2 AS face_id, x0, y0, x0 + 50 AS x1, y0 AS y1, x0 AS x2, y0 + 50 AS y2 FROM f UNION ALL SELECT face_id * 2 + 1, x0 + 50, y0, x0 + 50, y0 + 50, x0, y0 + 50 FROM f),
h AS (SELECT loc_id, min(face_id) AS face_id FROM pts JOIN t ON x BETWEEN least(x0, x1, x2) AND greatest(x0, x1, x2) AND y BETWEEN least(y0, y1, y2) AND greatest(y0, y1, y2)
 AND NOT (((x - x1) * (y0 - y1) - (x0 - x1) * (y - y1) < 0 OR (x - x2) * (y1 - y2) - (x1 - x2) * (y - y2) < 0 OR (x - x0) * (y2 - y0) - (x2 - x0) * (y - y0) < 0)
 AND ((x - x1) * (y0 - y1) - (x0 - x1) * (y - y1) > 0 OR (x - x2) * (y1 - y2) - (x1 - x2) * (y - y2) > 0 OR (x - x0) * (y2 - y0) - (x2 - x0) * (y - y0) > 0)) GROUP BY 1)
SELECT pts.loc_id, face_id FROM pts LEFT JOIN h USING (loc_id)""")
def point_location(spark, sf_dir):
    f = spark.range(400).selectExpr("id as face_id", "cast(id div 20 as double) * 50 as x0", "cast(id % 20 as double) * 50 as y0")
    a = f.selectExpr("face_id * 2 as face_id", "x0", "y0", "x0 + 50 as x1", "y0 as y1", "x0 as x2", "y0 + 50 as y2")
    b = f.selectExpr("face_id * 2 + 1 as face_id", "x0 + 50 as x0", "y0", "x0 + 0d + 50 as x1", "y0 + 50 as y1", "x0 as x2", "y0 + 50 as y2")
    return spatial.locate(pts(spark, sf_dir), a.unionByName(b))


@query(f"""WITH {FRAMES}, d AS (SELECT *, dense_rank() OVER (ORDER BY frame) AS f FROM fr),
n AS (SELECT a.loc_id, b.loc_id AS other, (a.x - b.x) * (a.x - b.x) AS d2 FROM d a JOIN d b ON b.f = a.f + 1)
SELECT loc_id, other, round(sqrt(d2), 6) AS distance FROM n QUALIFY row_number() OVER (PARTITION BY loc_id ORDER BY d2, other) = 1""")
def next_frame_nearest(spark, sf_dir):
    return rounded(tracks.next_frame_nearest(frames(spark, sf_dir), axes=("x",)), "distance")


@query("SELECT l_partkey AS value FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1 HAVING count(*) > 1")
def shared_values(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("vertices"))
    return spatial.shared_values(g)


@query(f"""WITH {PTS}, c AS (SELECT CAST(floor(x / 50) AS BIGINT) * 1000 + CAST(floor(y / 50) AS BIGINT) AS object_id, avg(x) AS x, avg(y) AS y FROM pts WHERE color = 'F' GROUP BY 1),
o AS (SELECT CAST(floor(x / 50) AS BIGINT) * 1000 + CAST(floor(y / 50) AS BIGINT) AS object_id, x, y FROM pts WHERE color = 'F'), ref AS (SELECT x, y FROM pts WHERE color = 'O'),
tc AS (SELECT object_id, min(sqrt((c.x - r.x) ** 2 + (c.y - r.y) ** 2)) AS d FROM c JOIN ref r ON abs(c.x - r.x) < 200 AND abs(c.y - r.y) < 200 GROUP BY 1),
tt AS (SELECT object_id, min(sqrt((o.x - r.x) ** 2 + (o.y - r.y) ** 2)) AS d FROM o JOIN ref r ON abs(o.x - r.x) < 200 AND abs(o.y - r.y) < 200 GROUP BY 1)
SELECT object_id, round(tc.d, 6) AS to_centre, round(tt.d, 6) AS to_outline FROM tc JOIN tt USING (object_id) WHERE tc.d < 10 AND tt.d < 10""")
def outline_distances(spark, sf_dir):
    p = pts(spark, sf_dir).withColumn("object_id", F.floor(F.col("x") / 50) * 1000 + F.floor(F.col("y") / 50))
    mine, ref = p.where("color = 'F'"), p.where("color = 'O'").select("x", "y")
    centres = mine.groupBy("object_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return rounded(spatial.outline_distances(centres, mine, ref, 10.0), "to_centre", "to_outline")


# --- statistics -----------------------------------------------------------------------------


@query("""SELECT count(*) AS n, round(avg(v), 6) AS mean, list_sort(list(v))[count(*) // 2 + 1] AS median, round(stddev_pop(v), 6) AS sigma, min(v) AS min, max(v) AS max FROM (SELECT l_extendedprice AS v FROM lineitem)""")
def five_numbers(spark, sf_dir):
    return rounded(stats.stats(table(spark, sf_dir, "lineitem"), "l_extendedprice"), "mean", "sigma")


@query("""WITH s AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 99 AS st FROM lineitem),
c AS (SELECT CAST(floor((l_extendedprice - lo) / st) AS INTEGER) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, round(lo + (b + 0.5) * st, 6) AS centre, coalesce(n, 0) AS count FROM range(100) r(b) CROSS JOIN s LEFT JOIN c ON c.bin = b""")
def histogram(spark, sf_dir):
    return rounded(stats.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice"), "centre")


@query("""WITH v AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_extendedprice BETWEEN 20000 AND 60000), c AS (SELECT CAST(floor((v - 20000) / (40000 / 49.0)) AS INTEGER) AS bin, count(*) AS n FROM v GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, round(20000 + (b + 0.5) * (40000 / 49.0), 6) AS centre, coalesce(n, 0) AS count FROM range(50) r(b) LEFT JOIN c ON c.bin = b""")
def histogram_bounds(spark, sf_dir):
    return rounded(stats.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 50, 20000.0, 60000.0), "centre")


@query("""WITH m AS (SELECT avg(l_quantity) AS mu FROM lineitem), c AS (SELECT count(*) AS n, avg((l_quantity - mu) ** 2) AS m2, avg((l_quantity - mu) ** 3) AS m3, avg((l_quantity - mu) ** 4) AS m4 FROM lineitem, m)
SELECT n, round(mu, 6) AS mean, round(m2, 6) AS var_pop, round(m2 * n / (n - 1), 6) AS var_samp, round(m3 / m2 ** 1.5, 6) AS skewness, round(m4 / m2 ** 2, 6) AS kurtosis FROM c, m""")
def moments(spark, sf_dir):
    return rounded(stats.moments(table(spark, sf_dir, "lineitem"), "l_quantity"), "mean", "var_pop", "var_samp", "skewness", "kurtosis")


@query("SELECT round(avg(c_acctbal), 6) AS mean, round(var_samp(c_acctbal), 4) AS variance, round(stddev_samp(c_acctbal), 6) AS sigma FROM customer")
def sample_statistics(spark, sf_dir):
    return stats.sample_stats(table(spark, sf_dir, "customer"), "c_acctbal").select(r6("mean").alias("mean"), F.round("variance", 4).alias("variance"), r6("sigma").alias("sigma"))


@query("""SELECT median(c_acctbal) AS true_median, list_sort(list(c_acctbal))[CAST(floor(0.9 * count(*)) AS INTEGER) + 1] AS q90, round(quantile_cont(c_acctbal, 0.37), 6) AS q37 FROM customer""")
def quantiles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    row = (stats.true_median(c, "c_acctbal"), stats.quantile(c, "c_acctbal", 90), round(stats.interpolated_quantile(c, "c_acctbal", 0.37), 6))
    return spark.createDataFrame([row], "true_median double, q90 double, q37 double")


@query(f"WITH {PTS} SELECT color, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM pts GROUP BY 1")
def bounding_boxes(spark, sf_dir):
    return stats.bounding_box(pts(spark, sf_dir), ["color"])


@query(f"""WITH {PTS} SELECT count(*) AS n, (ceil(max(x)) - floor(min(x))) * (ceil(max(y)) - floor(min(y))) AS box,
 round(count(*) / ((ceil(max(x)) - floor(min(x))) * (ceil(max(y)) - floor(min(y)))), 9) AS density, round((ceil(max(x)) - floor(min(x))) * (ceil(max(y)) - floor(min(y))) / count(*), 6) AS per_loc FROM pts""")
def average_density(spark, sf_dir):
    return stats.average_density(pts(spark, sf_dir)).select("n", "box", F.round("density", 9).alias("density"), r6("per_loc").alias("per_loc"))


@query("""SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS average, rank() OVER (ORDER BY p_size) AS low,
 rank() OVER (ORDER BY p_size) + count(*) OVER (PARTITION BY p_size) - 1 AS high, rank() OVER (ORDER BY p_size DESC) AS down, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS place FROM part""")
def ranks(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    for name, method, up in (("average", "average", True), ("low", "min", True), ("high", "max", True), ("down", "min", False)):
        p = stats.rank(p, "p_size", method, up, name=name)
    return p.join(stats.argsort(table(spark, sf_dir, "part"), "p_size", "p_partkey"), "p_partkey").drop("p_size")


@query("""WITH s AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 19 AS st FROM customer), c AS (SELECT CAST(floor((c_acctbal - lo) / st) AS INTEGER) AS bin, count(*) AS n FROM customer, s GROUP BY 1),
h AS (SELECT CAST(b AS INTEGER) AS bin, lo + (b + 0.5) * st AS centre, coalesce(n, 0) AS count, st FROM range(20) r(b) CROSS JOIN s LEFT JOIN c ON c.bin = b)
SELECT bin, round(sum(count) OVER (ORDER BY bin) / sum(count) OVER (), 6) AS cdf, round(count / (sum(count) OVER () * st), 9) AS pdf FROM h""")
def distribution_curves(spark, sf_dir):
    h = stats.histogram(table(spark, sf_dir, "customer"), "c_acctbal", 20)
    return stats.probability(stats.cumulative(h)).select("bin", r6("cdf").alias("cdf"), F.round("pdf", 9).alias("pdf"))


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS dense FROM orders")
def dense_labels(spark, sf_dir):
    return stats.relabel(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "dense")


@query("""WITH q AS (SELECT list_sort(list(c_acctbal)) AS v, count(*) AS n FROM customer), p AS (SELECT v[CAST(floor(0.25 * n) AS INTEGER) + 1] AS q25, v[CAST(floor(0.75 * n) AS INTEGER) + 1] AS q75 FROM q)
SELECT q25, q75, round(q75 + 1.5 * (q75 - q25), 6) AS cutoff FROM p""")
def iqr_cutoff(spark, sf_dir):
    c = stats.iqr_cutoff(table(spark, sf_dir, "customer"), "c_acctbal")
    return spark.createDataFrame([(c["q25"], c["q75"], round(c["cutoff"], 6))], "q25 double, q75 double, cutoff double")


# --- tracks ---------------------------------------------------------------------------------


@query(f"""WITH {TRACKS}, s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM tp WINDOW w AS (PARTITION BY track_id ORDER BY seq))
SELECT track_id, count(*) AS n, round(coalesce(sum(step), 0), 4) AS length, min(seq) AS t0 FROM s GROUP BY 1""")
def track_features(spark, sf_dir):
    return tracks.track_features(track_points(spark, sf_dir)).withColumn("length", F.round("length", 4))


@query(f"""WITH {TRACKS}, d AS (SELECT a.track_id, b.seq - a.seq AS lag, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM tp a JOIN tp b ON a.track_id = b.track_id AND b.seq > a.seq)
SELECT track_id, lag, round(avg(sqrt(d2)), 5) AS mean_displacement, round(avg(d2), 8) AS msd FROM d GROUP BY 1, 2""")
def displacement_curves(spark, sf_dir):
    return tracks.displacement(track_points(spark, sf_dir)).select("track_id", "lag", F.round("mean_displacement", 5).alias("mean_displacement"), F.round("msd", 8).alias("msd"))


@query(f"""WITH {TRACKS}, d AS (SELECT a.track_id, b.seq - a.seq AS lag, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS m FROM tp a JOIN tp b ON a.track_id = b.track_id AND b.seq - a.seq BETWEEN 1 AND 4 GROUP BY 1, 2)
SELECT track_id, round(regr_slope(m, lag), 5) AS diffusion FROM d GROUP BY 1""")
def diffusion(spark, sf_dir):
    return tracks.diffusion(track_points(spark, sf_dir)).withColumn("diffusion", F.round("diffusion", 5))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e""")
def run_starts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return tracks.run_starts(e, "user_id", "event_id", "event_type").select("user_id", "event_id", "run")


_PHOTO = f"""{FRAMES}, f AS (SELECT DISTINCT user_id AS emitter_id, frame FROM fr),
g AS (SELECT *, coalesce(frame - lag(frame) OVER (PARTITION BY emitter_id ORDER BY frame) - 1, 0) AS gap FROM f)"""


@query(f"""WITH {_PHOTO} SELECT emitter_id, count(*) AS total_on, count(*) FILTER (WHERE gap > 0) + 1 AS n_on, count(*) FILTER (WHERE gap > 0) AS n_off, count(*) FILTER (WHERE gap > 0) AS blinks,
 CAST(sum(gap) AS BIGINT) AS total_off, max(frame) - min(frame) + 1 AS lifetime FROM g GROUP BY 1""")
def photophysics(spark, sf_dir):
    return tracks.photophysics(frames(spark, sf_dir).withColumnRenamed("user_id", "emitter_id"))


@query(f"""WITH {_PHOTO}, r AS (SELECT *, sum(CASE WHEN gap > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY emitter_id ORDER BY frame) AS run FROM g),
a AS (SELECT 'on' AS kind, count(*) AS value FROM r GROUP BY emitter_id, run UNION ALL SELECT 'off', gap FROM r WHERE gap > 0 UNION ALL SELECT 'blinks', max(run) FROM r GROUP BY emitter_id)
SELECT kind, CAST(value AS BIGINT) AS value, count(*) AS count FROM a GROUP BY 1, 2""")
def blink_histograms(spark, sf_dir):
    f = frames(spark, sf_dir)
    return tracks.blink_histograms(f.select("loc_id", F.col("user_id").alias("emitter_id")), f)


def _blinking(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    f = frames(spark, sf_dir).select("loc_id", "frame")
    return f.join(e.select(F.col("event_id").alias("loc_id"), (F.col("value") % 100).alias("x"), (F.col("user_id") * 10.0).alias("y"), F.col("value").alias("intensity")), "loc_id")


@query()
def merged_emitters(spark, sf_dir):
    """Frame linking and features of merged emitters; tests compare linking with a plain loop."""
    locs = _blinking(spark, sf_dir)
    links = stash(tracks.link_frames(locs, 4.0, 10), "links")
    return rounded(tracks.merged_features(locs, links), "x", "y", "intensity")


@query()
def link_totals(spark, sf_dir):
    locs = _blinking(spark, sf_dir)
    return tracks.link_totals(locs, tracks.link_frames(locs, 4.0, 10))


# --- spatial correlation --------------------------------------------------------------------


@query(f"""WITH {PTS}, r AS (SELECT (i + 1) * {R10} / 2 AS radius FROM range(8) t(i)), s AS (SELECT count(*) AS n, (ceil(max(x)) - floor(min(x))) * (ceil(max(y)) - floor(min(y))) AS box FROM pts),
d AS (SELECT (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM pts a JOIN pts b ON abs(a.x - b.x) < 4 * {R10} AND abs(a.y - b.y) < 4 * {R10} AND a.loc_id <> b.loc_id),
k AS (SELECT radius, (SELECT count(*) FROM d WHERE d2 < radius * radius) / (n / box) / n AS k FROM r, s)
SELECT round(radius, 6) AS radius, round(k, 4) AS k, round(sqrt(k / pi()) - radius, 5) AS l FROM k""")
def ripley_uncorrected(spark, sf_dir):
    p = pts(spark, sf_dir)
    r = RADIUS / 2
    return ripley.k_function(p, r, 8 * r, r, corrected=False).select(r6("radius").alias("radius"), F.round("k", 4).alias("k"), F.round("l", 5).alias("l"))


@query(f"""WITH {PTS}, s AS (SELECT count(*) AS n, floor(min(x)) AS x0, ceil(max(x)) AS x1, floor(min(y)) AS y0, ceil(max(y)) AS y1 FROM pts), r AS (SELECT (i + 1) * {R10} / 2 AS radius FROM range(4) t(i)),
d AS (SELECT a.loc_id, any_value(a.x) AS x, any_value(a.y) AS y, radius, count(*) AS c FROM pts a JOIN pts b ON abs(a.x - b.x) < 2 * {R10} AND abs(a.y - b.y) < 2 * {R10} AND a.loc_id <> b.loc_id JOIN r ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < radius * radius GROUP BY a.loc_id, radius),
e AS (SELECT radius, c, n, x1, x0, y1, y0, list_transform([x - x0, y - y0, x1 - x, y1 - y], lambda v: acos(least(v / radius, 1))) AS a FROM d, s),
l AS (SELECT *, 2 * list_sum(a) - list_sum(list_transform(range(1, 5), lambda i: greatest(a[i] + a[i % 4 + 1] - pi() / 2, 0))) AS lost FROM e),
k AS (SELECT radius, sum(2 * pi() / greatest(2 * pi() - lost, 1e-9) * c) / any_value(n / ((x1 - x0) * (y1 - y0))) / any_value(n) AS k FROM l GROUP BY radius)
SELECT round(radius, 6) AS radius, round(k, 4) AS k, round(sqrt(k / pi()) - radius, 5) AS l FROM k""")
def ripley_corrected(spark, sf_dir):
    p = pts(spark, sf_dir)
    r = RADIUS / 2
    return ripley.k_function(p, r, 4 * r, r).select(r6("radius").alias("radius"), F.round("k", 4).alias("k"), F.round("l", 5).alias("l"))


# --- colocalization -------------------------------------------------------------------------

_COLOC = f"""{PTS}, {NEAR}, den AS (SELECT a AS loc_id, count(*) AS density FROM near WHERE d2 < r * r GROUP BY a),
two AS (SELECT loc_id, x, y, color, density FROM pts JOIN den USING (loc_id) WHERE color IN ('F', 'O')), nd AS (SELECT *, density / avg(density) OVER (PARTITION BY color) AS d1 FROM two),
nn AS (SELECT a.loc_id, b.d1 AS d2 FROM nd a JOIN nd b ON a.color <> b.color AND abs(a.x - b.x) < 120 AND abs(a.y - b.y) < 120 QUALIFY row_number() OVER (PARTITION BY a.loc_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.loc_id) = 1),
pd AS (SELECT loc_id, color, d1, d2, CASE WHEN d1 >= 1 AND d2 >= 1 THEN 'coloc' WHEN d1 >= 1 THEN 'high_density' ELSE 'background' END AS class FROM nd JOIN nn USING (loc_id))"""


def _paired(spark, sf_dir) -> DataFrame:
    p = pts(spark, sf_dir)
    den = spatial.density_within(p, RADIUS)
    return coloc.paired_densities(stash(p.join(den, "loc_id").where(F.col("color").isin("F", "O")), "coloured"))


@query(f"WITH {_COLOC} SELECT loc_id, color, round(d1, 6) AS d1, round(d2, 6) AS d2, class FROM pd")
def coloc_classes(spark, sf_dir):
    return rounded(coloc.classify(_paired(spark, sf_dir)), "d1", "d2")


@query(f"WITH {_COLOC} SELECT color, CAST(count(*) FILTER (WHERE class = 'background') AS BIGINT) AS n_background, CAST(count(*) FILTER (WHERE class = 'high_density') AS BIGINT) AS n_high_density, CAST(count(*) FILTER (WHERE class = 'coloc') AS BIGINT) AS n_coloc FROM pd GROUP BY 1")
def coloc_counts(spark, sf_dir):
    return coloc.class_counts(coloc.classify(_paired(spark, sf_dir)))


@query(f"WITH {_COLOC} SELECT color, round(coalesce(sum(d1) FILTER (WHERE class = 'coloc'), 0) / sum(d1) FILTER (WHERE class IN ('coloc', 'high_density')), 6) AS manders FROM pd GROUP BY 1")
def manders(spark, sf_dir):
    return rounded(coloc.manders(coloc.classify(_paired(spark, sf_dir))), "manders")


@query(f"""WITH {_COLOC}, rk AS (SELECT color, rank() OVER (PARTITION BY color ORDER BY round(d1, 9)) + (count(*) OVER (PARTITION BY color, round(d1, 9)) - 1) / 2 AS ra,
 rank() OVER (PARTITION BY color ORDER BY round(d2, 9)) + (count(*) OVER (PARTITION BY color, round(d2, 9)) - 1) / 2 AS rb FROM pd)
SELECT color, round(corr(ra, rb), 6) AS rho FROM rk GROUP BY 1""")
def spearman(spark, sf_dir):
    p = _paired(spark, sf_dir).select("color", F.round("d1", 9).alias("d1"), F.round("d2", 9).alias("d2"))
    return rounded(coloc.spearman(p, "d1", "d2"), "rho")


_OVERLAPS = "ov AS (SELECT l_orderkey * 10 + l_linenumber AS overlap_id, l_partkey % 50 AS object1, l_suppkey % 37 AS object2, l_quantity AS measure FROM lineitem)"


def _overlaps(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as overlap_id", "l_partkey % 50 as object1", "l_suppkey % 37 as object2", "l_quantity as measure")


@query(f"WITH {_OVERLAPS} SELECT object1 AS object_id, count(DISTINCT object2) AS n_partners, count(*) AS n_overlaps, array_to_string(list_sort(list(DISTINCT object2)), ',') AS partners FROM ov GROUP BY 1")
def overlap_summary(spark, sf_dir):
    return coloc.overlap_links(_overlaps(spark, sf_dir), "object1").withColumn("partners", F.concat_ws(",", F.col("partners").cast("array<string>")))


@query(f"WITH {_OVERLAPS}, o AS (SELECT i AS object_id, 10000.0 + i AS measure FROM range(37) t(i)) SELECT object_id, round(100 * coalesce(s, 0) / measure, 6) AS percent FROM o LEFT JOIN (SELECT object2 AS object_id, sum(measure) AS s FROM ov GROUP BY 1) USING (object_id)")
def overlap_ratio(spark, sf_dir):
    o = spark.range(37).select(F.col("id").alias("object_id"), (F.col("id") + 10000.0).alias("measure"))
    return rounded(coloc.overlap_ratio(_overlaps(spark, sf_dir), o, "object2"), "percent")


# --- images and graphs ----------------------------------------------------------------------

_PIX = f"{PTS}, px AS (SELECT CAST(floor(x / 20) AS BIGINT) AS x, CAST(floor(y / 20) AS BIGINT) AS y, count(*) AS value FROM pts GROUP BY 1, 2)"


def _pixels(spark, sf_dir) -> DataFrame:
    return pts(spark, sf_dir).groupBy(F.floor(F.col("x") / 20).alias("x"), F.floor(F.col("y") / 20).alias("y")).agg(F.count(F.lit(1)).alias("value"))


_CUT = "(SELECT quantile_disc(value, 0.8) FROM px)"
_CC = f"""WITH RECURSIVE {_PIX}, k AS (SELECT y * 1048576 + x AS id, x, y FROM px WHERE value >= {_CUT}),
reach(root, id, x, y) AS (SELECT id, id, x, y FROM k UNION SELECT root, k.id, k.x, k.y FROM reach JOIN k ON abs(k.x - reach.x) <= 1 AND abs(k.y - reach.y) <= 1),
lab AS (SELECT id, any_value(x) AS x, any_value(y) AS y, min(root) AS root FROM reach GROUP BY id), num AS (SELECT x, y, dense_rank() OVER (ORDER BY root) AS label FROM lab)"""


def _components(spark, sf_dir) -> DataFrame:
    px = stash(_pixels(spark, sf_dir), "px")
    n = px.count()
    k = max(0, -(-n * 8 // 10) - 1)
    cut = stats.order_statistics(px.select(F.col("value").cast("double").alias("v")), [k])[k]
    return graph.image_components(px, cut, 1e18)


@query(_CC + " SELECT x, y, label FROM num")
def image_components(spark, sf_dir):
    return _components(spark, sf_dir).select("x", "y", "label")


@query(_CC + " SELECT label, count(*) AS size FROM num GROUP BY 1")
def label_volumes(spark, sf_dir):
    return graph.label_sizes(_components(spark, sf_dir))


@query(f"WITH {_PIX} SELECT x, y, value FROM px WHERE value BETWEEN 3 AND 9")
def image_threshold(spark, sf_dir):
    return select.threshold(_pixels(spark, sf_dir), 3, 9)


# --- tessellation and objects ---------------------------------------------------------------


def _triangulation(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = pts(spark, sf_dir)
    return p, stash(tess.delaunay(p), "faces")


@query()
def delaunay(spark, sf_dir):
    """Triangles and areas; tests check empty circles, Euler's formula and the hull's area."""
    _, f = _triangulation(spark, sf_dir)
    return f.select("face_id", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), F.col("v")[2].alias("c"), r6("measure").alias("measure"))


@query(f"""WITH {PTS} SELECT CAST(2 * count(DISTINCT (x, y)) - 2 AS BIGINT) AS faces_and_hull FROM pts""")
def delaunay_euler(spark, sf_dir):
    """Triangles plus hull edges: 2n - 2 for n distinct places."""
    _, f = _triangulation(spark, sf_dir)
    hull = tess.face_edges(f).where("neigh is null").count()
    return f.agg((F.count(F.lit(1)) + F.lit(hull)).alias("faces_and_hull"))


@query()
def voronoi(spark, sf_dir):
    """Cells clipped to the box widened by one; tests check that areas fill it."""
    p, f = _triangulation(spark, sf_dir)
    cells, _ = tess.voronoi(p, f)
    return rounded(cells, "measure").withColumn("density", F.round("density", 9))


@query(f"WITH {PTS} SELECT round((max(x) - min(x) + 2) * (max(y) - min(y) + 2), 2) AS total FROM pts")
def voronoi_total(spark, sf_dir):
    p, f = _triangulation(spark, sf_dir)
    cells, _ = tess.voronoi(p, f)
    return cells.agg(F.round(F.sum("measure"), 2).alias("total"))


@query()
def delaunay_objects(spark, sf_dir):
    p, f = _triangulation(spark, sf_dir)
    got = objects.objects_from_faces(f, p, 8.0, min_locs=5, max_locs=500)
    member = got["object_locs"].join(p, "loc_id")
    return rounded(objects.features(got["objects"], member), "area", "size", "circ", "major", "minor")


@query()
def voronoi_objects(spark, sf_dir):
    p, f = _triangulation(spark, sf_dir)
    cells, _ = tess.voronoi(p, f)
    avg = stats.average_density(p).first()["density"]
    return rounded(objects.objects_from_cells(cells, f, p, 1.2, avg, min_locs=5)["objects"], "measure", "cx", "cy")


@query()
def cluster_sweep(spark, sf_dir):
    p, f = _triangulation(spark, sf_dir)
    cells, sides = tess.voronoi(p, f)
    avg = stats.average_density(p).first()["density"]
    return objects.cluster_sweep(stash(cells, "cells"), stash(sides, "sides"), avg, min_locs=3)


@query()
def voronoi_colocalization(spark, sf_dir):
    """Paired Voronoi densities of two colours, classes with border correction, and Spearman's rho for each colour."""
    cells = None
    for k in ("F", "O"):
        p = pts(spark, sf_dir).where(F.col("color") == k)
        one = tess.voronoi(p, tess.delaunay(p))[0].join(p, "loc_id")
        cells = one if cells is None else cells.unionByName(one)
    cells = stash(cells, "cells")
    paired = coloc.paired_densities(cells)
    cut = stats.iqr_cutoff(cells, "measure")["cutoff"]
    d = coloc.border_correction(coloc.normalised_density(cells), 1.0, cut).select("loc_id", "selected")
    classed = coloc.classify(paired.join(d, "loc_id"), correct=True)
    return rounded(coloc.manders(classed).join(coloc.class_counts(classed), "color").join(coloc.spearman(paired, "d1", "d2"), "color"), "manders", "rho")


@query()
def object_colocalization(spark, sf_dir):
    """Overlaps of Delaunay objects of two colours; tests check known squares."""
    p = pts(spark, sf_dir)
    r = 14.0
    one, two = [overlap.sampled_objects(p.where(F.col("color") == k).select("loc_id", "x", "y"), r, min_locs=8) for k in ("F", "O")]
    return rounded(overlap.object_colocalization(one, two, step=r / 4)["overlaps"], "measure")


@query(f"""WITH {PTS}, m AS (SELECT color AS c, CAST(floor(x / 40) AS BIGINT) * 1000 + CAST(floor(y / 40) AS BIGINT) AS id, loc_id, x, y FROM pts WHERE color IN ('F', 'O')),
e AS (SELECT a.c, a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bw FROM m a JOIN m b ON a.c = b.c AND a.id = b.id AND a.loc_id <> b.loc_id),
h AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.c = e.c AND m.id = e.id AND ((bx - ax) * (m.y - ay) - (bw - ay) * (m.x - ax) < 0
  OR ((bx - ax) * (m.y - ay) - (bw - ay) * (m.x - ax) = 0 AND (m.x - ax) * (m.x - bx) + (m.y - ay) * (m.y - bw) > 0)))),
ok AS (SELECT c, id FROM h GROUP BY 1, 2 HAVING count(*) >= 3), g AS (SELECT h.* FROM h JOIN ok USING (c, id)),
x AS (SELECT a.id, a.ax, a.ay, a.bx - a.ax AS ux, a.bw - a.ay AS uy, b.bx - b.ax AS vx, b.bw - b.ay AS vy, b.ax - a.ax AS wx, b.ay - a.ay AS wy FROM g a JOIN g b ON a.id = b.id AND a.c = 'F' AND b.c = 'O'),
i AS (SELECT a.id, a.ax AS x, a.ay AS y FROM g a JOIN ok o ON o.id = a.id AND o.c <> a.c WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.id = a.id AND b.c <> a.c AND (b.bx - b.ax) * (a.ay - b.ay) - (b.bw - b.ay) * (a.ax - b.ax) < 0)
  UNION ALL SELECT id, ax + (wx * vy - wy * vx) / (ux * vy - uy * vx) * ux, ay + (wx * vy - wy * vx) / (ux * vy - uy * vx) * uy FROM x
  WHERE ux * vy <> uy * vx AND (wx * vy - wy * vx) / (ux * vy - uy * vx) BETWEEN 0 AND 1 AND (wx * uy - wy * ux) / (ux * vy - uy * vx) BETWEEN 0 AND 1),
k AS (SELECT *, atan2(y - avg(y) OVER (PARTITION BY id), x - avg(x) OVER (PARTITION BY id)) AS t FROM i),
s AS (SELECT id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM k WINDOW w AS (PARTITION BY id ORDER BY t))
SELECT id AS id1, id AS id2, round(abs(sum(x * ny - nx * y)) / 2, 4) AS measure FROM s GROUP BY id HAVING abs(sum(x * ny - nx * y)) / 2 > 1e-7""")
def polygon_intersections(spark, sf_dir):
    """Hulls of two colours in coarse tiles, clipped against each other."""
    def hulls(k):
        m = pts(spark, sf_dir).where(F.col("color") == k).select((F.floor(F.col("x") / 40) * 1000 + F.floor(F.col("y") / 40)).alias("object_id"), "x", "y")
        h = objects.hull_outlines(m).groupBy(F.col("object_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda e: F.struct(e.x.alias("x"), e.y.alias("y"))).alias("pts"))
        return stash(h.where(F.size("pts") > 2), "hulls")

    return overlap.polygon_intersections(hulls("F"), hulls("O"), 40.0).where("measure > 1e-7").select("id1", "id2", F.round("measure", 4).alias("measure"))


_BOXED = f"{PTS}, m AS (SELECT CAST(floor(x / 50) AS BIGINT) * 1000 + CAST(floor(y / 50) AS BIGINT) AS object_id, x, y, loc_id FROM pts)"


def _boxed(spark, sf_dir) -> DataFrame:
    return pts(spark, sf_dir).select((F.floor(F.col("x") / 50) * 1000 + F.floor(F.col("y") / 50)).alias("object_id"), "x", "y", "loc_id")


@query(f"""WITH {_BOXED}, g AS (SELECT object_id, avg(x) AS mx, avg(y) AS my, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS t FROM m GROUP BY 1),
d AS (SELECT object_id, abs((x - mx) * cos(t) + (y - my) * sin(t)) AS u, abs((y - my) * cos(t) - (x - mx) * sin(t)) AS v FROM m JOIN g USING (object_id)),
s AS (SELECT object_id, stddev_pop(u) * 2.35 AS a, stddev_pop(v) * 2.35 AS b FROM d GROUP BY 1)
SELECT object_id, round(2 * greatest(a, b), 4) AS major, round(2 * least(a, b), 4) AS minor, round(a + b, 4) AS size FROM s""")
def object_pca(spark, sf_dir):
    return objects.pca_2d(_boxed(spark, sf_dir)).select("object_id", *[F.round(c, 4).alias(c) for c in ("major", "minor", "size")])


@query(f"WITH {_BOXED} SELECT object_id, round(avg(x), 9) AS x, round(avg(y), 9) AS y FROM m GROUP BY 1")
def object_centroids(spark, sf_dir):
    c = objects.centroids(_boxed(spark, sf_dir))
    return c.select("object_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(f"WITH {_BOXED} SELECT pts.loc_id, coalesce(object_id, 0) AS object_id FROM pts LEFT JOIN (SELECT * FROM m WHERE object_id % 2 = 1) USING (loc_id)")
def locs_with_objects(spark, sf_dir):
    m = _boxed(spark, sf_dir).where("object_id % 2 = 1").select("loc_id", "object_id")
    return files.locs_with_objects(pts(spark, sf_dir).select("loc_id"), m)


@query(f"""WITH {_BOXED}, e AS (SELECT a.object_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bw FROM m a JOIN m b ON a.object_id = b.object_id AND a.loc_id <> b.loc_id),
h AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM m c WHERE c.object_id = e.object_id AND ((bx - ax) * (c.y - ay) - (bw - ay) * (c.x - ax) < 0
  OR ((bx - ax) * (c.y - ay) - (bw - ay) * (c.x - ax) = 0 AND (c.x - ax) * (c.x - bx) + (c.y - ay) * (c.y - bw) > 0)))),
g AS (SELECT object_id, sum(ax * bw - bx * ay) / 2 AS area FROM h GROUP BY 1)
SELECT object_id, n_locs, round(coalesce(abs(area), 0), 8) AS measure FROM (SELECT object_id, count(*) AS n_locs FROM m GROUP BY 1) LEFT JOIN g USING (object_id)""")
def convex_hulls(spark, sf_dir):
    return objects.convex_hulls(_boxed(spark, sf_dir)).withColumn("measure", F.round("measure", 8))


@query()
def bounding_ellipses(spark, sf_dir):
    return rounded(objects.ellipses(_boxed(spark, sf_dir)), "cx", "cy", "axis0", "axis1")


def _space(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("loc_id"), F.col("p_retailprice").alias("x"), (F.col("p_partkey") * 37 % 1009).cast("double").alias("y"), (F.col("p_partkey") * 91 % 997).cast("double").alias("z"))


@query()
def tetrahedra(spark, sf_dir):
    """A triangulation in space of all points, as one task's kernel."""
    f = tess.delaunay3(_space(spark, sf_dir))
    return f.select("face_id", *[F.col("v")[i].alias(f"v{i}") for i in range(4)], r6("measure").alias("measure"))


# --- fits -----------------------------------------------------------------------------------


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY 1")
def linear_fit(spark, sf_dir):
    g = fit.linear(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return g.select("l_returnflag", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y, l_linenumber * 3.0 AS z FROM lineitem)
SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM p GROUP BY floor(x / 7), floor(y / 7), floor(z / 7)""")
def regularised(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").selectExpr("l_quantity x", "l_discount * 100 y", "l_linenumber * 3.0d z")
    return rounded(fit.regularise(p, 7.0), "x", "y", "z")


@query("SELECT 10.0 AS cx, -20.0 AS cy, 5.0 AS cz, 30.0 AS r")
def sphere_fit(spark, sf_dir):
    """Points laid on a known sphere by the keys of a table."""
    p = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k").selectExpr("k * 0.7d as a", "(k % 1000) / 1000d * 2 - 1 as c")
    p = p.selectExpr("10 + 30 * sqrt(1 - c * c) * cos(a) as x", "-20 + 30 * sqrt(1 - c * c) * sin(a) as y", "5 + 30 * c as z")
    return rounded(fit.sphere_fit(p), "cx", "cy", "cz", "r")


@query("""WITH d AS (SELECT l_orderkey AS k, list_sort(list(l_extendedprice)) AS d FROM lineitem GROUP BY 1 HAVING count(*) > 1)
SELECT k, round(d[1] / d[-1], 6) AS self_first, round((d[2] - d[1]) / d[-1], 6) AS norm_diff, round(CASE WHEN d[-1] <> d[1] THEN (d[2] - d[1]) / (d[-1] - d[1]) END, 6) AS diff_norm FROM d""")
def distance_inputs(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("l_extendedprice")).alias("d")).where(F.size("d") > 1)
    one = lambda m: r6(fit.normalise_distances(F.col("d"), m)[0])
    return g.select("k", one("Norm-Self").alias("self_first"), one("Norm-Diff").alias("norm_diff"), one("Diff-Norm").alias("diff_norm"))


@query()
def voronoi_threshold(spark, sf_dir):
    p, f = _triangulation(spark, sf_dir)
    cells, _ = tess.voronoi(p, f)
    return spark.createDataFrame([(fit.voronoi_threshold(stash(cells, "cells")),)], "threshold double")


@query()
def localization_precision(spark, sf_dir):
    d = tracks.next_frame_nearest(_blinking(spark, sf_dir))
    return spark.createDataFrame([(round(fit.nena(d), 3),)], "precision double")


# --- plugins and macros ---------------------------------------------------------------------


def _zscore(v):
    return (v - v.mean()) / v.std()


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w, 5) AS z FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def column_plugin(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    got = plugins.call(c, _zscore, ["c_acctbal"], "z", by=["c_nationkey"], key="c_custkey")
    return got.select("c_custkey", F.round("z", 5).alias("z"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount + l_tax, 6) AS v FROM lineitem")
def elementwise_plugin(spark, sf_dir):
    f = plugins.elementwise(lambda a, b, c: a * b + c)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(f("l_quantity", "l_discount", "l_tax")).alias("v"))


@query(f"WITH {PTS}, s AS (SELECT * FROM pts WHERE x BETWEEN 100 AND 600), n AS (SELECT a.loc_id, count(*) AS density FROM s a JOIN s b ON abs(a.x - b.x) < 10 AND abs(a.y - b.y) < 10 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 100 GROUP BY 1) SELECT loc_id, density FROM n WHERE density >= 3")
def macro_run(spark, sf_dir):
    d = macro.Dataset(spark, {"DetectionSet": pts(spark, sf_dir)})
    macro.run(d, '{"DetectionSet": {"histogram": {"feature": "x", "action": "changeBoundsCustom", "min": 100, "max": 600}}}\n{"DetectionSet": {"duplicateSelected": {}}}\n'
              '{"DetectionSet": {"computeDensityWithRadius": {"radius": 10}}}\n{"DetectionSet": {"histogram": {"feature": "density", "min": 3}}}')  # fmt: skip
    return d.selected("DetectionSet").select("loc_id", "density")
