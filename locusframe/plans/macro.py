"""Macros: one JSON object a line, {"component": {"command": {parameters}}}, run on named tables.

Every line becomes a step that is checked against a registry before anything
runs; an unknown component or command raises. Steps are lazy DataFrame
transforms, so a whole macro is planned by Catalyst as one query up to a sink.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ripley, select, spatial, stats, tracks
from ..sources import files


@dataclass
class Step:
    component: str
    command: str
    parameters: dict

    def text(self) -> str:
        return json.dumps({self.component: {self.command: self.parameters}}, sort_keys=True)


@dataclass
class Dataset:
    """Named tables of one data set and the selection of each."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    bounds: dict[str, dict] = field(default_factory=dict)
    #: Features of each table whose bounds are those of their log10.
    logs: dict[str, set] = field(default_factory=dict)
    #: Tables whose selection is inverted.
    inverted: set[str] = field(default_factory=set)
    average: float = 0.0
    #: What was run, ready to be saved and run again.
    record: list[Step] = field(default_factory=list)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no table {name}")
        return self.tables[name]

    def selected(self, name: str) -> DataFrame:
        chosen = select.predicate(self.bounds.get(name, {}), self.logs.get(name, set()))
        return self.table(name).where(~F.coalesce(chosen, F.lit(False)) if name in self.inverted else chosen)


Command = Callable[[Dataset, dict], None]
_REGISTRY: dict[tuple[str, str], Command] = {}


def command(component: str, name: str) -> Callable[[Command], Command]:
    """Registers a function as a command; plugins use it too."""

    def put(f: Command) -> Command:
        _REGISTRY[component, name] = f
        return f

    return put


def commands() -> list[tuple[str, str]]:
    return sorted(_REGISTRY)


def parse(text: str) -> list[Step]:
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        got = json.loads(line)
        if not isinstance(got, dict):
            raise ValueError(f"line {n}: an object is expected")
        for component, body in got.items():
            for name, parameters in body.items():
                if (component, name) not in _REGISTRY:
                    raise ValueError(f"line {n}: unknown command {component}.{name}")
                out.append(Step(component, name, parameters if isinstance(parameters, dict) else {"value": parameters}))
    return out


def run(data: Dataset, text: str) -> Dataset:
    for step in parse(text):
        _REGISTRY[step.component, step.command](data, step.parameters)
        data.record.append(step)
    return data


def run_many(spark: SparkSession, text: str, paths: list[str]) -> dict[str, Dataset]:
    """The macro for each file, with the path of its ``open`` step replaced."""
    out = {}
    for path in paths:
        steps = parse(text)
        for s in steps:
            if s.command == "open":
                s.parameters = {**s.parameters, "path": path}
        out[path] = run(Dataset(spark), "\n".join(s.text() for s in steps))
    return out


# --- commands -------------------------------------------------------------------------------


@command("MainWindow", "open")
def _open(d: Dataset, p: dict) -> None:
    names = ("x", "y", "z", "frame", "intensity", "sigmaXY", "sigmaZ")
    columns = {k: int(p[k]) for k in names if k in p}
    d.tables["DetectionSet"] = files.Loaders().load(
        d.spark, p["path"], columns=columns, separator=p.get("separator", ","), calibration_xy=p.get("calibration_xy", 1.0),
        calibration_z=p.get("calibration_z", 1.0), calibration_t=p.get("calibration_t", 1.0),
    ) if p["path"].rsplit(".", 1)[-1].lower() in ("csv", "txt", "xls") else files.Loaders().load(d.spark, p["path"])


@command("MainWindow", "addComponent")
def _add_component(d: Dataset, p: dict) -> None:
    """Another file's table beside those that are there, under a name; ``format`` stands for a missing extension."""
    path, name = p["path"], p["name"]
    ext = p.get("format", path.rsplit(".", 1)[-1].lower())
    columns = {k: int(p[k]) for k in ("x", "y", "z", "frame", "intensity") if k in p}
    d.tables[name] = files.read_locs(d.spark, path, columns, p.get("separator", ",")) if ext in ("csv", "txt", "xls") else files.Loaders().load(d.spark, path)


@command("MainWindow", "close")
def _close(d: Dataset, p: dict) -> None:
    d.tables.clear()
    d.bounds.clear()
    d.logs.clear()
    d.inverted.clear()


def _on_each(name: str):
    """Registers a command for each kind of table that has features."""

    def put(f):
        for component in ("DetectionSet", "DelaunayTriangulation", "VoronoiDiagram", "ObjectList"):
            command(component, name)(lambda d, p, c=component: f(d, c, p))
        return f

    return put


@_on_each("histogram")
def _histogram(d: Dataset, component: str, p: dict) -> None:
    feature, action = p.get("feature"), p.get("action", "changeBoundsCustom")
    bounds = d.bounds.setdefault(component, {})
    if action in ("changeBoundsCustom", "changeHistogramBounds"):
        bounds[feature] = (p.get("min"), p.get("max"))
    elif action == "log":
        logs = d.logs.setdefault(component, set())
        (logs.add if p.get("value", True) else logs.discard)(feature)
    elif action == "reset":
        bounds.pop(feature, None)
    elif action == "delete":
        from ..functions.columns import delete_feature

        d.tables[component] = delete_feature(d.table(component), feature)
    elif action == "save":
        files.write_feature(d.selected(component), feature, p["path"], bool(p.get("log", False)))
    else:
        raise ValueError(f"unknown histogram action {action}")
    if action == "changeHistogramBounds":
        d.tables["Histogram"] = stats.histogram(d.table(component), feature, int(p.get("bins", 100)), p.get("min"), p.get("max"))


@_on_each("invertSelection")
def _invert(d: Dataset, component: str, p: dict) -> None:
    d.inverted ^= {component}


@_on_each("duplicateSelected")
def _duplicate(d: Dataset, component: str, p: dict) -> None:
    d.tables[p.get("name", component)] = d.selected(component)


@_on_each("saveFeatures")
def _save(d: Dataset, component: str, p: dict) -> None:
    files.write_locs(d.selected(component), p["path"], sep=p.get("separator", ","))


@command("DetectionSet", "keepPercentageOfLocalizations")
def _keep(d: Dataset, p: dict) -> None:
    d.tables["DetectionSet"] = select.keep_share(d.table("DetectionSet"), float(p["percentage"]), "loc_id", int(p.get("seed", 0)))


@command("DetectionSet", "computeDensityWithRadius")
def _density(d: Dataset, p: dict) -> None:
    locs = d.table("DetectionSet").drop("density")
    d.tables["DetectionSet"] = locs.join(spatial.density_within(locs, float(p["radius"])), "loc_id")


@command("DetectionSet", "DBSCAN")
def _dbscan(d: Dataset, p: dict) -> None:
    locs = d.selected("DetectionSet")
    d.tables["Clusters"] = spatial.dbscan(locs, float(p.get("radius", 50)), int(p.get("minNb", 20)), int(p.get("minNbForCluster", 1)))


@command("DetectionSet", "clean")
def _clean(d: Dataset, p: dict) -> None:
    locs = d.selected("DetectionSet")
    links = tracks.link_frames(locs, float(p.get("radius", 50)), int(p.get("maxDarkTime", 10)))
    d.tables["Cleaned"] = tracks.merged_features(locs, links)


@command("DetectionSet", "KRipley")
def _ripley(d: Dataset, p: dict) -> None:
    d.tables["KRipley"] = ripley.k_function(d.selected("DetectionSet"), float(p.get("minRadius", 10)), float(p.get("maxRadius", 200)), float(p.get("step", 10)))


@command("DetectionSet", "rotate")
def _rotate(d: Dataset, p: dict) -> None:
    from ..functions.columns import rotate

    locs = d.table("DetectionSet")
    b = locs.agg(*[((F.min(a) + F.max(a)) / 2).alias(a) for a in "xy"]).first()
    x, y = rotate(F.col("x"), F.col("y"), F.lit(b["x"]), F.lit(b["y"]), float(p["angle"]))
    d.tables["DetectionSet"] = locs.withColumns({"x": x, "y": y})


@command("DetectionSet", "computeDelaunay")
def _delaunay(d: Dataset, p: dict) -> None:
    from ..operators import tess

    if "DelaunayTriangulation" not in d.tables:
        locs = d.table("DetectionSet")
        d.tables["DelaunayTriangulation"] = tess.delaunay_on_sphere(locs) if p.get("onSphere") else tess.delaunay3(locs) if "z" in locs.columns else tess.delaunay(locs)


@command("DetectionSet", "computeVoronoi")
def _voronoi(d: Dataset, p: dict) -> None:
    from ..operators import tess

    if "VoronoiDiagram" not in d.tables:
        _delaunay(d, p)
        locs, faces = d.table("DetectionSet"), d.table("DelaunayTriangulation")
        cells, sides = (tess.voronoi3 if "z" in locs.columns else tess.voronoi)(locs, faces)
        d.tables["VoronoiDiagram"], d.tables["VoronoiSides"] = cells, sides
        d.average = stats.average_density(locs).first()["density"]


@command("DelaunayTriangulation", "createFilteredObjects")
def _objects(d: Dataset, p: dict) -> None:
    from ..operators import objects

    got = objects.objects_from_faces(
        d.selected("DelaunayTriangulation"), d.table("DetectionSet"), float(p.get("cutDistance", 50)) if p.get("useDistance", True) else None,
        int(p.get("minLocs", 3)), int(p["maxLocs"]) if "maxLocs" in p else None, p.get("minArea"), p.get("maxArea"),
    )
    d.tables |= {"ObjectList": got["objects"], "ObjectLocs": got["object_locs"], "ObjectOutline": got["object_outline"]}


@command("VoronoiDiagram", "densityFactor")
def _factor(d: Dataset, p: dict) -> None:
    d.bounds.setdefault("VoronoiDiagram", {})["density"] = (float(p["factor"]) * d.average, None)


@command("VoronoiDiagram", "createFilteredObjects")
def _cell_objects(d: Dataset, p: dict) -> None:
    from ..operators import objects

    lo = d.bounds.get("VoronoiDiagram", {}).get("density", (0.0, None))[0] or 0.0
    got = objects.objects_from_cells(d.table("VoronoiDiagram"), d.table("DelaunayTriangulation"), d.table("DetectionSet"), 1.0, lo, min_locs=int(p.get("minLocs", 3)))
    d.tables |= {"ObjectList": got["objects"], "ObjectLocs": got["object_locs"], "ObjectOutline": got["object_outline"]}


@command("DelaunayTriangulation", "applyCutDistance")
def _cut(d: Dataset, p: dict) -> None:
    from ..operators import tess

    locs = d.table("DetectionSet")
    faces = tess.with_edge_lengths(d.table("DelaunayTriangulation"), locs, space="z" in locs.columns)
    d.tables["DelaunayTriangulation"] = select.cut_distance(faces, float(p.get("distance", p.get("value", 50)))).select("face_id", "v", "measure")


@command("VoronoiDiagram", "clustersForChallenge")
def _sweep(d: Dataset, p: dict) -> None:
    from ..operators import objects

    d.tables["ClusterIndices"] = objects.cluster_sweep(
        d.table("VoronoiDiagram"), d.table("VoronoiSides"), d.average, float(p.get("from", 1.0)), float(p.get("to", 2.0)), float(p.get("step", 0.5)),
        int(p.get("minNbLocs", 1)), int(p["maxNbLocs"]) if "maxNbLocs" in p else None,
    )


@command("MainWindow", "computeColocalization")
def _colocalize(d: Dataset, p: dict) -> None:
    """Voronoi diagrams of two named tables, or of the two colours of DetectionSet, and their paired densities."""
    from ..operators import coloc, tess
    from ..runtime import stash

    names = p.get("datasetNames") or [r[0] for r in d.table("DetectionSet").select("color").distinct().orderBy("color").limit(3).collect()]
    if len(names) != 2:
        raise ValueError("two data sets are needed")
    cells = None
    for name in names:
        locs = (d.table(name) if p.get("datasetNames") else d.table("DetectionSet").where(F.col("color") == name)).select("loc_id", "x", "y")
        one = tess.voronoi(locs, stash(tess.delaunay(locs), "faces"))[0].join(locs, "loc_id").withColumn("color", F.lit(name))
        cells = one if cells is None else cells.unionByName(one)
    d.tables["ColocCells"] = stash(cells, "cells")
    d.tables["Colocalization"] = stash(coloc.paired_densities(d.tables["ColocCells"]), "paired")


@command("Colocalization", "computeCoefficients")
def _coefficients(d: Dataset, p: dict) -> None:
    """Classes, then counts, Manders and Spearman for each colour (and region, with inROIs)."""
    from ..operators import coloc, roi

    cells, paired = d.table("ColocCells"), d.table("Colocalization")
    t1, t2, correct = float(p.get("color1", 1.0)), float(p.get("color2", 1.0)), bool(p.get("correction", True))
    if correct:
        cut = stats.iqr_cutoff(cells, "measure")["cutoff"]
        paired = paired.join(coloc.border_correction(coloc.normalised_density(cells), t1, cut).select("loc_id", "color", "selected"), ["loc_id", "color"])
    classed, by = coloc.classify(paired, t1, t2, correct), ["color"]
    if p.get("inROIs"):
        classed = classed.join(roi.matches(cells, d.table("ROIs")).withColumnRenamed("roi_id", "roi"), "loc_id")
        by = ["roi", "color"]
    d.tables["ColocClasses"] = classed
    d.tables["Coefficients"] = coloc.class_counts(classed, by).join(coloc.manders(classed, by), by).join(coloc.spearman(classed, "d1", "d2", by), by)


@command("MainWindow", "computeObjectColocalization")
def _object_colocalization(d: Dataset, p: dict) -> None:
    """Overlaps of the objects of two tables of localizations."""
    from ..operators import overlap

    cut = float(p.get("cutDistance", 50))
    one, two = (overlap.sampled_objects(d.table(n).select("loc_id", *[a for a in "xyz" if a in d.table(n).columns]), cut, min_locs=int(p.get("minLocs", 3))) for n in p["datasetNames"])
    d.tables["ObjectOverlaps"] = overlap.object_colocalization(one, two, step=float(p.get("step", 0.5)))["overlaps"]


@command("ObjectList", "computeNearestNeighMulticolor")
def _nearest_objects(d: Dataset, p: dict) -> None:
    """Distances of objects, from centroid and outline, to the nearest point of a reference table."""
    from ..operators import objects

    locs = d.table("DetectionSet")
    member = d.table("ObjectLocs").join(locs.select("loc_id", "x", "y"), "loc_id").select("object_id", "x", "y")
    corners = d.table("ObjectOutline").select("object_id", F.explode(F.array("a", "b")).alias("loc_id")).distinct().join(locs.select("loc_id", "x", "y"), "loc_id")
    top = p.get("maxDistance")
    d.tables["NearestDistances"] = spatial.outline_distances(objects.centroids(member), corners.select("object_id", "x", "y"), d.table(p["reference"]).select("x", "y"), float(top) if top is not None else None)


@command("ObjectList", "saveStatsObjs")
def _save_stats(d: Dataset, p: dict) -> None:
    files.write_table(files.object_stats(d.selected("ObjectList")), p["path"], p.get("separator", ","))


@command("ObjectList", "saveLocsObjs")
def _save_locs(d: Dataset, p: dict) -> None:
    files.write_table(files.locs_with_objects(d.table("DetectionSet"), d.table("ObjectLocs")), p["path"], p.get("separator", ","))


@command("Object", "loadROIs")
def _load_rois(d: Dataset, p: dict) -> None:
    d.tables["ROIs"] = files.read_rois(d.spark, p["path"])


@command("Object", "saveROIs")
def _save_rois(d: Dataset, p: dict) -> None:
    files.write_rois(d.table("ROIs"), p["path"])


@command("DetectionSet", "selectLocsInROIs")
def _in_rois(d: Dataset, p: dict) -> None:
    from ..operators import roi

    d.tables["DetectionSet"] = roi.in_any(d.table("DetectionSet"), d.table("ROIs"))


@command("PythonWidget", "apply")
def _apply(d: Dataset, p: dict) -> None:
    from ..functions.plugins import call

    c = p.get("component", "DetectionSet")
    d.tables[c] = call(d.table(c), p["function"], p["inputs"], p["output"], by=p.get("by", ()))
