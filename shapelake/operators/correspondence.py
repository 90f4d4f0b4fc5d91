"""Points of one surface as points of another: correspondences and properties seen through them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.operators.mesh import Mesh

WEIGHTS = ("u", "v", "w")


@dataclass(frozen=True)
class SurfaceCorrespondence:
    """cells: (cell_id, to_cell, corners array<int>): corner k of a cell lies at corner corners[k] of its target cell."""

    cells: DataFrame

    @staticmethod
    def between(source: Mesh, target: Mesh, points: DataFrame) -> SurfaceCorrespondence:
        """Of cells that have the same corners under (point_id, to_point), in any order; others correspond to none."""
        names = source.corner_rows().join(points.select("point_id", "to_point"), "point_id")
        own = names.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("k", "to_point"))).alias("c"))
        own = own.filter(F.size("c") == source.corners).select("cell_id", F.transform("c", lambda s: s["to_point"]).alias("tp"))
        there = target.cells.select(F.col("cell_id").alias("to_cell"), "pids", F.array_sort("pids").alias("key"))
        first = there.groupBy("key").agg(F.min(F.struct("to_cell", "pids")).alias("m")).select("key", "m.*")
        met = own.withColumn("key", F.array_sort("tp")).join(first, "key")
        return SurfaceCorrespondence(met.select("cell_id", "to_cell", F.transform("tp", lambda p: (F.array_position("pids", p) - 1).cast("int")).alias("corners")))

    @staticmethod
    def of_compaction(mesh: Mesh, compacted: Mesh, ids: DataFrame) -> SurfaceCorrespondence:
        """From a compacted mesh (see Mesh.compact) to the one it came from."""
        return SurfaceCorrespondence.between(compacted, mesh, ids.select("point_id", F.col("old_id").alias("to_point")))

    def corresponding(self, at: DataFrame) -> DataFrame:
        """Rows of `at` (cell_id, u, v, w, further columns) at their points of the target surface."""
        more = [c for c in at.columns if c not in ("cell_id", *WEIGHTS)]
        weights = F.array(*[F.col(c) for c in WEIGHTS])
        moved = [F.get(weights, (F.array_position("corners", F.lit(k)) - 1).cast("int")).alias(c) for k, c in enumerate(WEIGHTS)]
        return at.join(self.cells, "cell_id").select(*more, F.col("to_cell").alias("cell_id"), *moved)


def warped_property(underlying: Mesh, correspondence: SurfaceCorrespondence, at: DataFrame, value: str = "value") -> DataFrame:
    """A point property of the underlying mesh at points of another surface that corresponds to it."""
    return underlying.surface_property(correspondence.corresponding(at), value)
