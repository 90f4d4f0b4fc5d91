"""Meshes as two DataFrames: points (point_id, x, y, z, ...) and cells (cell_id, pids array)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapelake.storage import saved
from shapelake.functions import barycentric as bc
from shapelake.functions.vector import Vec
from shapelake.operators.spatial import eps_join, line_candidates, nearest, nearest_candidates

XYZ = ("x", "y", "z")


@dataclass(frozen=True)
class Mesh:
    """Lines, triangles or tetrahedra, by the length of pids."""

    points: DataFrame
    cells: DataFrame
    corners: int = 3

    def with_points(self, points: DataFrame) -> Mesh:
        return Mesh(points, self.cells, self.corners)

    # --- topology

    def corner_rows(self) -> DataFrame:
        """(cell_id, k, point_id): corner k of each cell."""
        return self.cells.select("cell_id", F.posexplode("pids").alias("k", "point_id"))

    def adjacent_cells_of_points(self) -> DataFrame:
        return self.corner_rows().select("point_id", "cell_id").distinct()

    def adjacent_points(self) -> DataFrame:
        """(point_id, neighbour) of points that share a cell, both ways."""
        pair = self.cells.select(F.explode("pids").alias("point_id"), "pids").select("point_id", F.explode("pids").alias("neighbour"))
        return pair.filter("point_id <> neighbour").distinct()

    def adjacent_cells(self) -> DataFrame:
        """(cell_id, neighbour) of cells that share a point."""
        own = self.adjacent_cells_of_points()
        return own.join(own.toDF("point_id", "neighbour"), "point_id").filter("cell_id <> neighbour").select("cell_id", "neighbour").distinct()

    def adjacent_points_of_cells(self) -> DataFrame:
        """(cell_id, neighbour): points next to a cell's corners that aren't its own."""
        near = self.adjacent_cells_of_points().join(self.adjacent_points(), "point_id").select("cell_id", F.col("neighbour").alias("point_id")).distinct()
        return near.join(self.corner_rows().select("cell_id", "point_id"), ["cell_id", "point_id"], "left_anti").withColumnRenamed("point_id", "neighbour")

    def facets(self) -> DataFrame:
        """(cell_id, facet): each cell's sides, a side being the ascending ids of all corners but one."""
        n = self.corners
        sides = F.array(*[F.array_sort(F.array(*[F.get("pids", F.lit(j)) for j in range(n) if j != k])) for k in range(n)])
        return self.cells.select("cell_id", F.explode(sides).alias("facet"))

    def boundary_facets(self) -> DataFrame:
        """Sides that an odd number of cells have."""
        return self.facets().groupBy("facet").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select("facet")

    def boundary_points(self) -> DataFrame:
        return self.boundary_facets().select(F.explode("facet").alias("point_id")).distinct()

    def boundary_cells(self) -> DataFrame:
        """Cells that have a boundary side."""
        return self.facets().join(self.boundary_facets(), "facet", "left_semi").select("cell_id").distinct()

    # --- geometry

    def cornered(self, names: Sequence[str] = XYZ, properties: Sequence[str] = ()) -> DataFrame:
        """The cells with their corners' coordinates as a0.x, a1.x, ..., each an equi-join on the corner's id."""
        out = self.cells
        for k in range(self.corners):
            p = self.points.select(F.col("point_id").alias(f"__p{k}"), F.struct(*names, *properties).alias(f"a{k}"))
            out = out.withColumn(f"__p{k}", F.get("pids", F.lit(k))).join(p, f"__p{k}").drop(f"__p{k}")
        return out

    def corner_vecs(self, names: Sequence[str] = XYZ) -> list[Vec]:
        return [Vec.from_struct(F.col(f"a{k}"), names) for k in range(self.corners)]

    def measures(self, names: Sequence[str] = XYZ) -> DataFrame:
        """(cell_id, measure): length, area or volume."""
        f = {2: lambda a, b: (b - a).norm(), 3: bc.heron_area, 4: bc.tetrahedron_volume}[self.corners]
        return self.cornered(names).select("cell_id", f(*self.corner_vecs(names)).alias("measure"))

    def measure(self, names: Sequence[str] = XYZ) -> DataFrame:
        return self.measures(names).agg(F.sum("measure").alias("measure"))

    def cell_normals(self) -> DataFrame:
        n = bc.normal(*self.corner_vecs())
        return self.cornered().select("cell_id", "pids", *n.columns("nx", "ny", "nz"))

    def vertex_normals(self) -> DataFrame:
        """Mean of the unit normals of the cells at a point, made a unit vector."""
        per_point = self.cell_normals().select(F.explode("pids").alias("point_id"), "nx", "ny", "nz").groupBy("point_id").agg(*[F.avg(c).alias(c) for c in ("nx", "ny", "nz")])
        return per_point.select("point_id", *Vec.of("nx", "ny", "nz").normalized().columns("nx", "ny", "nz"))

    # --- subsets

    def keep(self, points: DataFrame) -> Mesh:
        """The given points (by point_id), and cells all of whose corners are among them. The joins are merged, never broadcast by the driver."""
        kept = points.select("point_id").hint("merge")
        corners = self.corner_rows().join(kept, "point_id", "left_semi").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
        whole = corners.filter(F.col("n") == self.corners).select("cell_id").hint("merge")
        return Mesh(self.points.join(kept, "point_id", "left_semi"), self.cells.join(whole, "cell_id", "left_semi"), self.corners)

    def clip(self, drop: Column) -> Mesh:
        """Without the points where the predicate is true."""
        return self.keep(self.points.filter(~drop))

    def mask_points(self, keep: Column) -> Mesh:
        return self.keep(self.points.filter(keep))

    def mask_cells(self, keep: Column) -> Mesh:
        return Mesh(self.points, self.cells.filter(keep), self.corners)

    def mask_with_plane(self, origin: Sequence[float], normal: Sequence[float]) -> Mesh:
        return self.mask_points((Vec.of(*XYZ) - Vec.of(*origin)).dot(Vec.of(*normal)) >= 0)

    def compact(self) -> tuple[Mesh, DataFrame]:
        """Only points that a cell uses, numbered from 0 in the order of their ids; and (old_id, point_id)."""
        used = self.points.join(self.corner_rows().select("point_id").distinct(), "point_id", "left_semi")
        ids = numbered(used.select(F.col("point_id").alias("old_id")), "old_id", "point_id")
        moved = self.corner_rows().withColumnRenamed("point_id", "old_id").join(ids, "old_id")
        cells = moved.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "point_id"))), lambda s: s["point_id"]).alias("pids"))
        points = used.withColumnRenamed("point_id", "old_id").join(ids, "old_id").drop("old_id")
        return Mesh(points, cells, self.corners), ids

    def join(self, other: Mesh) -> Mesh:
        """Both meshes as one; the other's ids are moved beyond this one's."""
        top = self.points.agg((F.coalesce(F.max("point_id"), F.lit(-1)) + 1).alias("np")).crossJoin(self.cells.agg((F.coalesce(F.max("cell_id"), F.lit(-1)) + 1).alias("nc")))
        points = other.points.crossJoin(F.broadcast(top)).withColumn("point_id", F.col("point_id") + F.col("np")).drop("np", "nc")
        cells = other.cells.crossJoin(F.broadcast(top)).withColumn("cell_id", F.col("cell_id") + F.col("nc")).withColumn("pids", F.transform("pids", lambda p: p + F.col("np"))).drop("np", "nc")
        return Mesh(self.points.unionByName(points), self.cells.unionByName(cells), self.corners)

    def outer_surface(self) -> Mesh:
        """Boundary triangles of a tetrahedral mesh, turned so that their normals point away from the fourth corner."""
        face = lambda k: F.struct(F.array_sort(F.array(*[F.get("pids", F.lit(j)) for j in range(4) if j != k])).alias("facet"), F.get("pids", F.lit(k)).alias("inner"))
        own = self.cells.select(F.explode(F.array(*[face(k) for k in range(4)])).alias("f")).select("f.facet", "f.inner")
        outer = own.join(self.boundary_facets(), "facet", "left_semi").groupBy("facet").agg(F.min("inner").alias("inner"))
        tets = Mesh(self.points, outer.select(F.col("facet").alias("key"), F.concat("facet", F.array("inner")).alias("pids")), 4).cornered()
        volume = bc.signed_volume(*self.corner_vecs())
        turned = F.when(volume > 0, F.array(F.get("key", F.lit(0)), F.get("key", F.lit(2)), F.get("key", F.lit(1)))).otherwise(F.col("key"))
        return Mesh(self.points, numbered(tets.select("key", turned.alias("pids")), "key", "cell_id").drop("key"), 3)

    # --- properties

    def averaged_point_property(self, cell_values: DataFrame, value: str = "value", reducer: Callable[[Column], Column] = F.avg) -> DataFrame:
        """(point_id, value): reduces the values of the cells at a point."""
        return self.corner_rows().join(cell_values, "cell_id").groupBy("point_id").agg(reducer(F.col(value)).alias(value))

    def averaged_cell_property(self, point_values: DataFrame, value: str = "value") -> DataFrame:
        return self.corner_rows().join(point_values, "point_id").groupBy("cell_id").agg(F.avg(value).alias(value))

    def surface_property(self, at: DataFrame, value: str = "value") -> DataFrame:
        """Blend of the point property at (cell_id, u, v, w) rows."""
        corners = self.cornered((value,))
        w = Vec.of("u", "v", "w")
        return at.join(corners, "cell_id").select(*at.columns, bc.interpolate(w, [F.col(f"a{k}.{value}") for k in range(3)]).alias(value))

    # --- spatial queries

    def closest_on_surface(self, queries: DataFrame, size: float) -> DataFrame:
        """q_id, d2, cell_id, u, v, w, case of the nearest point of the surface for each (q_id, x, y, z).

        Candidates come from a descent over boxes of triangles (see nearest_candidates); size: about a triangle's.
        Ties go to the smaller cell_id.
        """
        corners = self.cornered().select("cell_id", "a0", "a1", "a2")
        pairs = nearest_candidates(queries, self.boxes(), size).withColumnRenamed("item_id", "cell_id")
        a, b, c = self.corner_vecs()
        p = Vec.from_struct(F.col("p"))
        rows = pairs.join(queries.select("q_id", F.struct(*XYZ).alias("p")), "q_id").join(corners, "cell_id")
        two = rows.select("q_id", "cell_id", "p", "a0", "a1", "a2").withColumns(bc.triangle_candidates(p, a, b, c))
        hit = bc.closest_of(F.col("flat"), F.col("edge"), p, a, b, c)
        rows = two.select("q_id", F.struct(hit["d2"].alias("d2"), F.col("cell_id"), *[hit[k].alias(k) for k in ("u", "v", "w", "case")]).alias("m"))
        return rows.groupBy("q_id").agg(F.min("m").alias("m")).select("q_id", "m.*")

    def boxes(self) -> DataFrame:
        """Items (see Levels) of the cells: their boxes and first corners."""
        corners = self.cornered()
        ends = [f(*[F.col(f"a{k}.{n}") for k in range(self.corners)]).alias(f"{e}_{n}") for n in XYZ for e, f in (("lo", F.least), ("hi", F.greatest))]
        return corners.select(F.col("cell_id").alias("item_id"), *ends, *[F.col(f"a0.{n}").alias(f"rep_{n}") for n in XYZ])

    def distance_to(self, other: Mesh, size: float) -> DataFrame:
        """(q_id, d): the distance of each vertex to the nearest point of another mesh's surface."""
        points = self.points.select(F.col("point_id").alias("q_id"), *XYZ)
        return other.closest_on_surface(points, size).select("q_id", F.sqrt("d2").alias("d"))

    def containment_spheres(self) -> DataFrame:
        """(cell_id, cx, cy, cz, radius): the least sphere around each cell."""
        n = self.corners
        corners = self.cornered().select("cell_id", F.array(*[F.col(f"a{k}.{c}") for k in range(n) for c in XYZ]).alias("v"))

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    centre, radius = bc.containment_spheres(np.stack(pdf.v.to_numpy()).reshape(-1, n, 3))
                    yield pd.DataFrame({"cell_id": pdf.cell_id, "cx": centre[:, 0], "cy": centre[:, 1], "cz": centre[:, 2], "radius": radius})

        return corners.mapInPandas(run, "cell_id long, cx double, cy double, cz double, radius double")

    def intersections(self, lines: DataFrame, size: float = 1.0) -> DataFrame:
        """line_id, cell_id, t, u, v, w where lines (line_id, ox, oy, oz, dx, dy, dz) meet triangles, both ways.

        Candidates come from a descent over boxes of triangles (see line_candidates); size: about a triangle's.
        """
        ends = [f"{e}{n}" for e in ("o", "d") for n in XYZ]
        pairs = line_candidates(lines.select(F.col("line_id").alias("q_id"), *[F.col(c).alias(f"{c[0]}_{c[1]}") for c in ends]), self.boxes(), size)
        rows = pairs.toDF("line_id", "cell_id").join(lines.select("line_id", *ends), "line_id").join(self.cornered(), "cell_id")
        hit = bc.line_triangle(Vec.of("ox", "oy", "oz"), Vec.of("dx", "dy", "dz"), *self.corner_vecs())
        return rows.filter(hit["hit"]).select("line_id", "cell_id", *[hit[k].alias(k) for k in ("t", "u", "v", "w")])


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """Adds `out`: 0, 1, ... in the order of the column, without gathering all rows in one task.

    Rows are dealt by ranges of the key; each range is numbered on its own and starts where the ranges before end.
    """
    dealt = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()).transform(saved)
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return dealt.withColumn("__own", own).join(starts, "__part").withColumn(out, F.col("__own") + F.col("__start")).drop("__part", "__own", "__start")


def hausdorff(a: DataFrame, b: DataFrame, start: float) -> DataFrame:
    """Symmetric Hausdorff distance of two point sets (point_id, x, y, z)."""
    one = lambda p, q: nearest(p, q, start, query_id="point_id", point_id="point_id").agg(F.max(F.sqrt("d2")).alias("d"))
    return one(a, b).union(one(b, a)).agg(F.max("d").alias("hausdorff"))


def average_distance(a: DataFrame, b: DataFrame, start: float) -> DataFrame:
    """Mean distance of the points of a to their nearest of b: one direction only."""
    return nearest(a, b, start, query_id="point_id", point_id="point_id").agg(F.avg(F.sqrt("d2")).alias("avg_distance"))


def average_surface_distance(a: Mesh, b: Mesh, size: float) -> DataFrame:
    """Mean distance of a's vertices to b's surface: one direction only."""
    return a.distance_to(b, size).agg(F.avg("d").alias("avg_distance"))


def surface_hausdorff(a: Mesh, b: Mesh, size: float) -> DataFrame:
    """Largest distance of a vertex of either mesh to the other's surface."""
    return a.distance_to(b, size).unionByName(b.distance_to(a, size)).agg(F.max("d").alias("hausdorff"))


def dice(inside_a: Column, inside_b: Column, samples: DataFrame) -> DataFrame:
    """2 |A and B| / (|A| + |B|) over sample points."""
    n = lambda c: F.sum(c.cast("double"))
    return samples.agg(F.try_divide(2 * n(inside_a & inside_b), n(inside_a) + n(inside_b)).alias("dice"))


def within(points: DataFrame, others: DataFrame, eps: float) -> DataFrame:
    return eps_join(points, others, eps, query_id="point_id", point_id="point_id")


def decimate(mesh: Mesh, size: float) -> Mesh:
    """Vertex clustering: points of a grid cell become their mean; cells that collapse go. Not the quadric method."""
    key = [F.floor(F.col(n) / size).alias(f"g{n}") for n in XYZ]
    mean = mesh.points.groupBy(*key).agg(F.min("point_id").alias("to"), *[F.avg(n).alias(n) for n in XYZ])
    moved = mesh.points.select("point_id", *key).join(mean, [f"g{n}" for n in XYZ]).select("point_id", "to")
    corners = mesh.corner_rows().join(moved, "point_id").groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "to"))), lambda s: s["to"]).alias("pids"))
    return Mesh(mean.select(F.col("to").alias("point_id"), *XYZ), corners.filter(F.size(F.array_distinct("pids")) == mesh.corners), mesh.corners)


def sample_on_surface(mesh: Mesh, n: int, seed: int) -> DataFrame:
    """(sample_id, cell_id, u, v, w): n points uniform over the area.

    Each cell gets its share of n (whole part, and one more by the fraction as a seeded draw), uniform inside: no
    cumulative sum over all cells is needed.
    """
    area = mesh.measures()
    share = area.crossJoin(area.agg(F.sum("measure").alias("total"))).withColumn("m", F.col("measure") / F.col("total") * n)
    times = share.withColumn("k", (F.floor("m") + (F.rand(seed) < F.col("m") - F.floor("m")).cast("long")).cast("int")).filter("k > 0")
    rows = times.select("cell_id", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("i")).withColumn("s", F.sqrt(F.rand(seed + 1))).withColumn("t", F.rand(seed + 2))
    return rows.select(F.monotonically_increasing_id().alias("sample_id"), "cell_id", (1 - F.col("s")).alias("u"), (F.col("s") * (1 - F.col("t"))).alias("v"), (F.col("s") * F.col("t")).alias("w"))
