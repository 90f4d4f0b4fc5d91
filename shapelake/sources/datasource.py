"""spark.read.format("shapelake_mesh"): mesh files as rows through the Python Data Source API."""

from __future__ import annotations

import glob

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shapelake.sources.formats import MeshData
from shapelake.sources.tables import READERS, suffix


class MeshSource(DataSource):
    """Options: path (a file or pattern every executor sees), table (points or cells)."""

    @classmethod
    def name(cls) -> str:
        return "shapelake_mesh"

    def schema(self) -> str:
        if self.options.get("table", "points") == "cells":
            return "file string, cell_id long, pids array<long>"
        return "file string, point_id long, x double, y double, z double, value double"

    def reader(self, schema) -> MeshReader:
        return MeshReader(self.options["path"], self.options.get("table", "points"))


class MeshReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition):
        name = partition.value
        with open(name, "rb") as f:
            mesh: MeshData = READERS[suffix(name)](f.read())
        if self.table == "cells":
            for k, c in enumerate(mesh.cells.tolist()):
                yield (name, k, c)
        else:
            for k, p in enumerate(mesh.points.tolist()):
                yield (name, k, *p, None if mesh.values is None else float(mesh.values[k]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MeshSource)
