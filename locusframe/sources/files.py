"""Reading and writing localization tables, structures, regions and results."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if

# --- localization text files ----------------------------------------------------------------

#: A number at the beginning of a cell; anything else reads as 0.
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def number(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, NUMBER, 1).try_cast("double"), F.lit(0.0))


def read_locs(spark: SparkSession, path: str, columns: Mapping[str, int], separator: str | int = ",", calibration_xy: float = 1.0,
              calibration_z: float = 1.0, calibration_t: float = 1.0) -> DataFrame:
    """Localizations with the named columns picked by index, calibrated, equal coordinates once, ``id`` and ``loc_id`` 1, 2, ...

    The first line is a header. The separator is a character or its code. x and
    y are required. Rows keep the order of files and lines.
    """
    if "x" not in columns or "y" not in columns:
        raise ValueError("x and y are required")
    sep = chr(separator) if isinstance(separator, int) else separator
    import re

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_order"))
    head = Window.partitionBy("_file").orderBy("_block", "_order")
    lines = lines.withColumn("_n", F.row_number().over(head)).where("_n > 1 and trim(value) != ''")
    cells = F.split("value", re.escape(sep))
    df = lines.select("_file", "_n", *[number(F.get(cells, F.lit(i))).alias(c) for c, i in columns.items()])
    return finish(df, ["_file", "_n"], calibration_xy, calibration_z, calibration_t)


def calibrate(df: DataFrame, xy: float = 1.0, z: float = 1.0, t: float = 1.0) -> DataFrame:
    by = {"x": xy, "y": xy, "z": z, "frame": t}
    return df.withColumns({c: F.col(c) * k for c, k in by.items() if c in df.columns and k != 1.0})


def distinct_places(df: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each place (x, y[, z])."""
    axes = [a for a in ("x", "y", "z") if a in df.columns]
    w = Window.partitionBy(*axes).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def number_rows(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """df with 1, 2, ... in order: counts by file, then places in the file."""
    first = order[0]
    base = df.groupBy(first).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(F.lit(0)).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(F.col(first).alias("_f"), F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_b"))
    place = F.row_number().over(Window.partitionBy(first).orderBy(*order))
    return df.withColumn("_p", place).join(base, F.col(first).eqNullSafe(F.col("_f"))).withColumn(name, F.col("_b") + F.col("_p")).drop("_b", "_p", "_f")


def finish(df: DataFrame, order: list[str], xy: float, z: float, t: float) -> DataFrame:
    out = number_rows(distinct_places(calibrate(df, xy, z, t), order), order)
    return out.withColumn("loc_id", F.col("id").cast("long")).drop(*order)


def read_many(spark: SparkSession, pattern: str, **options) -> DataFrame:
    """All files of a pattern or folder as one table with ``file``."""
    path = os.path.join(pattern, "*.csv") if "*" not in pattern and not pattern.endswith(".csv") else pattern
    return read_locs(spark, path, **options)


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of PDB or mmCIF files: x, y, z (times ten), chain (from 1), residue (from 0 in its chain), model (from 1)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("o"))
    if path.lower().endswith((".cif", ".mmcif")):
        return _mmcif(lines)
    v = F.col("value")
    cut = lambda a, n: F.trim(F.substring(v, a, n))
    w = Window.partitionBy("file").orderBy("o")
    model = F.sum(F.when(v.startswith("MODEL"), 1).otherwise(0)).over(w)
    atoms = lines.withColumn("m", F.greatest(model, F.lit(1))).where(v.startswith("ATOM") | v.startswith("HETATM"))
    atoms = atoms.select("file", "o", "m", F.substring(v, 22, 1).alias("ch"), F.concat(cut(23, 4), F.substring(v, 27, 1)).alias("res"), *[(number(cut(a, 8)) * 10).alias(c) for c, a in zip("xyz", (31, 39, 47), strict=True)])
    return _chains(atoms)


def _chains(atoms: DataFrame) -> DataFrame:
    w = Window.partitionBy("file", "m").orderBy("o")
    new_chain = F.when(F.lag("ch").over(w).eqNullSafe(F.col("ch")), 0).otherwise(1)
    a = atoms.withColumn("_nc", new_chain).withColumn("chain", F.sum("_nc").over(w))
    wc = Window.partitionBy("file", "m", "chain").orderBy("o")
    new_res = F.when(F.lag("res").over(wc).eqNullSafe(F.col("res")), 0).otherwise(1)
    a = a.withColumn("_nr", new_res).withColumn("residue", F.sum("_nr").over(wc) - 1)
    return a.select("x", "y", "z", "chain", "residue", F.col("m").alias("model"))


def _mmcif(lines: DataFrame) -> DataFrame:
    """The _atom_site loop: column names in its head, then one atom a line."""
    w = Window.partitionBy("file").orderBy("o")
    head = lines.where(F.col("value").startswith("_atom_site.")).withColumn("k", F.row_number().over(w) - 1)
    names = head.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct(F.trim(F.expr("substr(value, 12)")), "k"))).alias("at"))
    body = lines.where(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM")).join(broadcast_if(names, 10_000), "file")
    cells = F.split(F.trim("value"), r"\s+")
    get = lambda n: F.get(cells, F.col("at")[n].cast("int"))
    atoms = body.select(
        "file", "o", F.coalesce(get("pdbx_PDB_model_num").try_cast("int"), F.lit(1)).alias("m"), F.coalesce(get("auth_asym_id"), get("label_asym_id")).alias("ch"),
        F.coalesce(get("auth_seq_id"), get("label_seq_id")).alias("res"), *[(number(get(f"Cartn_{c}")) * 10).alias(c) for c in "xyz"],
    )
    return _chains(atoms)


class Loaders:
    """Readers by file extension; the first that is registered for one and gives rows wins."""

    def __init__(self):
        self.readers: list[tuple[tuple[str, ...], Callable]] = []
        self.register(("csv", "txt", "xls"), read_locs)
        self.register(("pdb", "ent", "cif", "mmcif"), lambda spark, path, **_: read_structure(spark, path))
        self.register(("parquet",), lambda spark, path, **_: spark.read.parquet(path))

    def register(self, extensions: tuple[str, ...], reader: Callable) -> None:
        self.readers.append((extensions, reader))

    def load(self, spark: SparkSession, path: str, **options) -> DataFrame:
        ext = path.rsplit(".", 1)[-1].lower()
        for extensions, reader in self.readers:
            if ext in extensions:
                return reader(spark, path, **options)
        raise ValueError(f"no reader for .{ext}")


# --- tables put together --------------------------------------------------------------------


def stack(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both; frames of the second go on after the first's last one."""
    if "frame" in first.columns and "frame" in second.columns:
        last = first.agg(F.coalesce(F.max("frame"), F.lit(-1))).first()[0]
        second = second.withColumn("frame", F.col("frame") + F.lit(last + 1))
    return first.unionByName(second, allowMissingColumns=True)


def describe_set(df: DataFrame) -> DataFrame:
    """n, n_frames and the box of whole numbers."""
    axes = [a for a in ("x", "y", "z") if a in df.columns]
    box = [f.alias(f"{n}_{a}") for a in axes for n, f in (("min", F.floor(F.min(a))), ("max", F.ceil(F.max(a))))]
    frames = (F.max("frame") + 1) if "frame" in df.columns else F.lit(None).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"), frames.alias("n_frames"), *box)


# --- regions --------------------------------------------------------------------------------

ROI_SCHEMA = "roi_id int, kind string, pts array<struct<x:double,y:double,z:double>>, radius double"
# Type names of the region format.
_KINDS = {"LineROI": "line", "CircleROI": "circle", "SphereROI": "sphere", "PolygonROI": "polygon", "RectangleROI": "rectangle", "TriangleROI": "triangle", "PlaneROI": "plane", "PolyplaneROI": "polyplane"}
_CORNERS = {"line": 2, "rectangle": 2, "triangle": 3}


def _text(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small file, by Spark, so that any store will do."""
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect()).splitlines()


def read_rois(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a .txt file (count, then a type line and numbers each) or a .rgn file (type 1: rectangle, else polygon)."""
    rows, lines = [], [x.strip() for x in _text(spark, path) if x.strip()]
    if path.lower().endswith(".rgn"):
        for line in lines:
            fields = [f.strip().split() for f in line.split(",")]
            by = {f[0]: f[1:] for f in fields if f}
            kind = "rectangle" if by.get("0", ["0"])[0] == "1" else "polygon"
            v = [float(x) for x in by.get("2", by.get("6", []))[(1 if kind == "polygon" else 0) :]]
            if kind == "rectangle" and len(v) >= 4:
                v = [v[0], v[1], v[0] + v[2], v[1] + v[3]]
            rows.append((len(rows) + 1, kind, [(a, b, 0.0) for a, b in zip(v[0::2], v[1::2], strict=False)], None))
    else:
        at = 1
        for _ in range(int(lines[0])):
            kind = _KINDS[lines[at].split()[0]]
            at += 1
            v: list[float] = []
            while at < len(lines) and lines[at].split()[0] not in _KINDS:
                v += [float(x) for x in lines[at].split()]
                at += 1
            radius = None
            if kind == "circle":
                pts, radius = [(v[0], v[1], 0.0)], v[2]
            elif kind == "sphere":
                pts, radius = [(v[0], v[1], v[2])], v[3]
            elif kind in _CORNERS:
                pts = [(v[2 * i], v[2 * i + 1], 0.0) for i in range(_CORNERS[kind])]
            else:
                pts = [(v[1 + 2 * i], v[2 + 2 * i], 0.0) for i in range(int(v[0]))]
            rows.append((len(rows) + 1, kind, pts, radius))
    return spark.createDataFrame(rows, ROI_SCHEMA)


def write_rois(rois: DataFrame, path: str) -> None:
    """A .txt file of regions; regions are few and are put together by the driver."""
    back = {v: k for k, v in _KINDS.items()}
    rows = rois.orderBy("roi_id").collect()
    out = [str(len(rows))]
    for r in rows:
        out.append(back[r["kind"]])
        p = r["pts"]
        if r["kind"] == "circle":
            out.append(f"{p[0]['x']!r} {p[0]['y']!r} {r['radius']!r}")
        elif r["kind"] == "sphere":
            out.append(f"{p[0]['x']!r} {p[0]['y']!r} {p[0]['z']!r} {r['radius']!r}")
        else:
            xy = " ".join(f"{q['x']!r} {q['y']!r}" for q in p)
            out.append(xy if r["kind"] in _CORNERS else f"{len(p)} {xy}")
    rois.sparkSession.createDataFrame([("\n".join(out),)], "value string").coalesce(1).write.mode("overwrite").text(path)


# --- results --------------------------------------------------------------------------------


def write_locs(df: DataFrame, path: str, features: list[str] | None = None, sep: str = ",") -> None:
    """All features (or those named), sorted by name, with a header in each part."""
    df.select(*(features or sorted(df.columns))).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_feature(df: DataFrame, feature: str, path: str, log: bool = False) -> None:
    """One value a line."""
    v = F.log10(feature) if log else F.col(feature)
    df.select(v.cast("string").alias("value")).where("value is not null").write.mode("overwrite").text(path)


def object_stats(objects: DataFrame) -> DataFrame:
    return objects.select(F.col("object_id").alias("id"), *sorted(c for c in objects.columns if c != "object_id"))


def locs_with_objects(locs: DataFrame, object_locs: DataFrame) -> DataFrame:
    """All localizations with their object, 0 for none."""
    return locs.join(object_locs, "loc_id", "left").withColumn("object_id", F.coalesce("object_id", F.lit(0)))


def outline_locs(locs: DataFrame, outline: DataFrame) -> DataFrame:
    """Localizations on outlines (object_id, a, b)."""
    ends = outline.select("object_id", F.explode(F.array("a", "b")).alias("loc_id")).distinct()
    return locs.join(ends, "loc_id")


def write_pairs(paired: DataFrame, path: str) -> None:
    """id, density1, density2 in a folder for each colour."""
    paired.select("color", F.col("loc_id").alias("id"), F.col("d1").alias("density1"), F.col("d2").alias("density2")).write.mode("overwrite").partitionBy("color").option("header", True).option("sep", "\t").csv(path)


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


# Headers of exported tables.
DISTANCES = {"object_id": "index object", "to_centre": "distance to centroids", "to_outline": "distance to outline"}
RIPLEY = {"radius": "Radius", "k": "K value", "l": "L value"}
OVERLAPS = {"overlap_id": "overlap", "object1": "object1", "object2": "object2", "measure": "measure"}


def write_named(df: DataFrame, names: Mapping[str, str], path: str) -> None:
    write_table(df.select(*[F.col(c).alias(n) for c, n in names.items()]), path)


def write_distances(distances: DataFrame, path: str) -> None:
    """Nearest distances of objects, as outline_distances gives them."""
    write_named(distances, DISTANCES, path)


def write_ripley(curve: DataFrame, path: str) -> None:
    write_named(curve, RIPLEY, path)


def write_overlaps(overlaps: DataFrame, path: str) -> None:
    write_named(overlaps, OVERLAPS, path)


def merged_lines(locs: DataFrame, links: DataFrame, feature: str) -> DataFrame:
    """One text line for each emitter: its id, then the feature of its members in frame order."""
    g = locs.join(links, "loc_id").groupBy("emitter_id").agg(F.array_sort(F.collect_list(F.struct("frame", "loc_id", F.col(feature).alias("v")))).alias("m"))
    values = F.transform("m", lambda e: e.v.cast("string"))
    return g.select(F.concat_ws(",", F.col("emitter_id").cast("string"), F.concat_ws(",", values)).alias("value"))


def scale_for_network(locs: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Coordinates from the box centre over 100, and the centre."""
    axes = [a for a in ("x", "y", "z") if a in locs.columns]
    r = locs.agg(*[((F.min(a) + F.max(a)) / 2).alias(a) for a in axes]).first()
    centre = {a: float(r[a]) for a in axes}
    return locs.withColumns({a: (F.col(a) - c) / 100 for a, c in centre.items()}), centre


def rescale_from_network(locs: DataFrame, centre: Mapping[str, float]) -> DataFrame:
    return locs.withColumns({a: F.col(a) * 100 + c for a, c in centre.items()})


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    faces.write.mode("overwrite").parquet(f"{path}/faces")


def mesh_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(mesh_id, k, n, value): text lines v / f of every mesh, in the order of k and n; vertex numbers count from 1."""
    v = vertices.select("mesh_id", F.lit(0).alias("k"), F.col("vertex_id").alias("n"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value"))
    f = faces.select("mesh_id", F.lit(1).alias("k"), F.col("a").alias("n"), F.concat_ws(" ", F.lit("f"), F.col("a") + 1, F.col("b") + 1, F.col("c") + 1).alias("value"))
    return v.unionByName(f)


def mesh_text(vertices: DataFrame, faces: DataFrame, mesh_id: int) -> DataFrame:
    """One mesh as text lines, in order."""
    one = [df.where(F.col("mesh_id") == mesh_id) for df in (vertices, faces)]
    return mesh_lines(*one).orderBy("k", "n", "value").select("value")


def heat_lines(vertices: DataFrame, normals: DataFrame) -> DataFrame:
    """(mesh_id, n, k, value): lines v and vn of every mesh, in the order of n and k."""
    v = vertices.select("mesh_id", F.col("vertex_id").alias("n"), F.lit(0).alias("k"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value"))
    m = normals.select("mesh_id", F.col("vertex_id").alias("n"), F.lit(1).alias("k"), F.concat_ws(" ", F.lit("vn"), "nx", "ny", "nz").alias("value"))
    return v.unionByName(m)


def write_skeletons(segments: DataFrame, path: str) -> None:
    """Segments (skeleton_id, segment_id, seq, x, y, z) as a table dealt out by skeleton, in order."""
    segments.repartition("skeleton_id").sortWithinPartitions("skeleton_id", "segment_id", "seq").write.mode("overwrite").parquet(path)


def svg_circles(locs: DataFrame, colour: Column, size: float = 1.0) -> DataFrame:
    """Selected points as SVG circle elements."""
    return locs.select(F.format_string('<circle cx="%.3f" cy="%.3f" r="%.3f" fill="%s"/>', F.col("x").cast("double"), F.col("y").cast("double"), F.lit(float(size)), colour).alias("value"))


class Settings:
    """A JSON file of parameters; saving merges into what is there. With a session it lies wherever Spark's file systems reach."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark = path, spark

    def _store(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def load(self) -> dict:
        if self.spark is not None:
            where, store = self._store()
            return json.loads("\n".join(_text(self.spark, self.path))) if store.exists(where) else {}
        if not os.path.exists(self.path):
            return {}
        with open(self.path) as f:
            return json.load(f)

    def save(self, values: Mapping) -> dict:
        merged = {**self.load(), **values}
        text = json.dumps(merged, indent=2, sort_keys=True)
        if self.spark is not None:
            where, store = self._store()
            out = store.create(where, True)
            out.write(bytearray(text.encode()))
            out.close()
        else:
            with open(self.path, "w") as f:
                f.write(text)
        return merged
