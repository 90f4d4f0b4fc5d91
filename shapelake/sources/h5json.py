"""Shape models in HDF5/JSON, the HDF Group's text form of HDF5 files.

The layout of a model, below its path in the file: `representer` (attributes `name` and `datasetType`) with `points`
(components x points) and `cells` (corners x cells); `model` with `mean` (positions, point by point), `pcaBasis`
(coordinates x rank), `pcaVariance` and `noiseVariance`; `version` at the root. A file may list its models in `catalog`.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.plans.pdm import XYZ, ShapeModel
from shapelake.sources.tables import write_bytes

#: The kinds of a representer's domain by the number of a cell's corners (0: points only), and back.
DOMAINS = {0: "POINT_SET", 2: "LINE_MESH", 3: "POLYGON_MESH", 4: "VOLUME_MESH"}


class H5Json:
    """Groups and datasets of an HDF5/JSON text by their paths."""

    def __init__(self, text: str | bytes):
        whole = json.loads(text)
        if not {"root", "groups"} <= set(whole):
            raise ValueError("not an HDF5/JSON file")
        self.groups: dict[str, dict] = {}
        self.datasets: dict[str, dict] = {}
        todo = [("/", whole["root"])]
        while todo:
            path, key = todo.pop()
            if path in self.groups:
                continue
            group = self.groups[path] = whole["groups"][key]
            for link in group.get("links", []):
                below = f"{path.rstrip('/')}/{link['title']}"
                if link.get("collection") == "groups":
                    todo.append((below, link["id"]))
                elif link.get("collection") == "datasets":
                    self.datasets[below] = whole["datasets"][link["id"]]

    def __contains__(self, path: str) -> bool:
        return path in self.datasets or path in self.groups

    def value(self, path: str) -> Any:
        """A dataset as an array, or as a number or string where it is a scalar."""
        if path not in self.datasets:
            raise KeyError(f"no dataset {path}")
        found = self.datasets[path]
        value = found["value"]
        if found.get("shape", {}).get("class") == "H5S_SCALAR" or not isinstance(value, list):
            return value
        return np.array(value).reshape(found["shape"].get("dims", np.shape(value)))

    def attribute(self, path: str, name: str) -> Any:
        holder = self.groups.get(path) or self.datasets.get(path) or {}
        for a in holder.get("attributes", []):
            if a["name"] == name:
                return a["value"]
        raise KeyError(f"no attribute {name} of {path}")

    def children(self, path: str) -> list[str]:
        return sorted(link["title"] for link in self.groups[path].get("links", []))


def _typed(value: Any) -> tuple[dict, dict, Any]:
    """(type, shape, value) as HDF5/JSON has them."""
    if isinstance(value, str):
        return {"charSet": "H5T_CSET_UTF8", "class": "H5T_STRING", "length": "H5T_VARIABLE", "strPad": "H5T_STR_NULLTERM"}, {"class": "H5S_SCALAR"}, value
    a = np.asarray(value)
    kind = {"base": "H5T_STD_I64LE", "class": "H5T_INTEGER"} if a.dtype.kind in "iu" else {"base": "H5T_IEEE_F64LE", "class": "H5T_FLOAT"}
    return kind, {"class": "H5S_SCALAR"} if a.ndim == 0 else {"class": "H5S_SIMPLE", "dims": list(a.shape)}, a.tolist()


def h5json_text(datasets: dict[str, Any], attributes: dict[str, dict[str, Any]]) -> str:
    """The text of a file with these datasets, by path, and attributes of groups; groups are made as needed."""
    paths = {"/"} | set(attributes)
    for path in list(datasets) + list(attributes):
        parts = path.strip("/").split("/")
        paths |= {"/" + "/".join(parts[:k]) for k in range(1, len(parts))}
    ids = {p: str(uuid.uuid5(uuid.NAMESPACE_URL, p)) for p in paths | set(datasets)}
    made = lambda given: [dict(zip(("name", "type", "shape", "value"), (n, *_typed(v)))) for n, v in given.items()]
    groups = {}
    for p in sorted(paths):
        inside = sorted(x for x in ids if x != "/" and (x.rsplit("/", 1)[0] or "/") == p)
        links = [{"class": "H5L_TYPE_HARD", "title": x.rsplit("/", 1)[1], "collection": "datasets" if x in datasets else "groups", "id": ids[x]} for x in inside]
        groups[ids[p]] = {"alias": [p], "attributes": made(attributes.get(p, {})), "links": links}
    stored = {ids[p]: {"alias": [p], "attributes": [], **dict(zip(("type", "shape", "value"), _typed(v)))} for p, v in datasets.items()}
    return json.dumps({"apiVersion": "1.1.1", "root": ids["/"], "groups": groups, "datasets": stored})


def below(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def version_of(file: H5Json, representer: str) -> tuple[int, int]:
    """(major, minor); representers of the oldest files have no version, which is 0.8."""
    if "/version/majorVersion" in file:
        return int(file.value("/version/majorVersion")), int(file.value("/version/minorVersion"))
    if representer in ("vtkPolyDataRepresenter", "itkMeshRepresenter"):
        return 0, 8
    raise ValueError("the file has no version")


def read_h5json_model(spark: SparkSession, path: str, model_path: str = "/") -> ShapeModel:
    """A model of points, lines, triangles or tetrahedra in 2-D or 3-D, versions 0.8, 0.9 and 1.x.

    In version 0.8 the basis is scaled by the standard deviations, which is undone. The file is read as a whole.
    """
    content = spark.read.format("binaryFile").load(path).select("content").first()
    if content is None:
        raise ValueError(f"no file {path}")
    file = H5Json(bytes(content.content))
    representer = below(model_path, "representer")
    kind = file.attribute(representer, "datasetType")
    if kind not in DOMAINS.values():
        raise ValueError(f"models of {kind} are not supported")
    points = np.asarray(file.value(below(model_path, "representer/points")), float).T
    n, d = points.shape
    mean = np.asarray(file.value(below(model_path, "model/mean")), float).reshape(n, d) - points
    variance = np.atleast_1d(np.asarray(file.value(below(model_path, "model/pcaVariance")), float))
    basis = np.asarray(file.value(below(model_path, "model/pcaBasis")), float).reshape(n * d, len(variance))
    version = version_of(file, file.attribute(representer, "name"))
    if version == (0, 8):
        deviation = np.sqrt(variance)
        basis = basis * np.where(deviation > 1e-8, 1 / np.where(deviation > 1e-8, deviation, 1), 0)
    elif version != (0, 9) and version[0] != 1:
        raise ValueError(f"version {version[0]}.{version[1]} is not supported")
    names, cells = XYZ[:d], None
    if kind != "POINT_SET":
        rows = np.asarray(file.value(below(model_path, "representer/cells"))).T
        cells = spark.createDataFrame([(k, [int(v) for v in c]) for k, c in enumerate(rows)], "cell_id long, pids array<long>")
    reference = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "point_id long, " + ", ".join(f"{c} double" for c in names))
    table = [(i, k, float(mean[i, k]), basis[i * d + k].tolist()) for i in range(n) for k in range(d)]
    return ShapeModel(reference, spark.createDataFrame(table, "point_id long, component int, mean double, basis array<double>"), variance, cells, names)


def write_h5json_model(model: ShapeModel, path: str, model_path: str = "/") -> None:
    """As version 0.9. One file, so the model has to fit the driver; points are numbered in the order of their ids."""
    spark, names = model.points.sparkSession, list(model.names)
    reference = model.reference.orderBy("point_id").toPandas()
    rows = model.points.orderBy("point_id", "component").toPandas()
    points = reference[names].to_numpy(float)
    if len(rows) != points.size:
        raise ValueError("the model lacks components of points")
    basis = np.stack(rows.basis.to_numpy()) if len(rows) else np.zeros((0, model.rank))
    datasets: dict[str, Any] = {
        "/version/majorVersion": 0, "/version/minorVersion": 9, below(model_path, "representer/points"): points.T,
        below(model_path, "model/mean"): (points + rows["mean"].to_numpy().reshape(points.shape)).ravel(), below(model_path, "model/noiseVariance"): np.zeros(1),
        below(model_path, "model/pcaBasis"): basis, below(model_path, "model/pcaVariance"): np.asarray(model.variance, float),
    }
    corners = 0
    if model.cells is not None:
        number = {int(p): k for k, p in enumerate(reference.point_id)}
        cells = [[number[int(p)] for p in c] for c in model.cells.orderBy("cell_id").toPandas().pids]
        corners = len(cells[0]) if cells else 3
        datasets[below(model_path, "representer/cells")] = np.array(cells, int).reshape(-1, corners).T
    attributes = {below(model_path, "representer"): {"name": "itkStandardMeshRepresenter", "version/majorVersion": "0", "version/minorVersion": "9", "datasetType": DOMAINS[corners]}}
    write_bytes(spark, h5json_text(datasets, attributes).encode(), path)


def read_h5json_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(name, type, path) of the models a file lists."""
    file = H5Json(bytes(spark.read.format("binaryFile").load(path).select("content").first().content))
    names = file.children("/catalog") if "/catalog" in file else []
    rows = [(n, file.value(f"/catalog/{n}/modelType"), file.value(f"/catalog/{n}/modelPath")) for n in names]
    return spark.createDataFrame(rows, "name string, type string, path string").orderBy(F.col("name"))
