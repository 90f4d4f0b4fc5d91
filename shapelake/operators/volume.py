"""Tetrahedral queries, images of meshes, mesh interpolators and line meshes."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelake.functions import barycentric as bc
from shapelake.functions.vector import Vec
from shapelake.operators.grid import Grid
from shapelake.operators.mesh import XYZ, Mesh, numbered
from shapelake.operators.spatial import nearest


def containing_cells(mesh: Mesh, queries: DataFrame, size: float) -> DataFrame:
    """q_id, cell_id, w0..w3: the tetrahedron of least id that holds each (q_id, x, y, z); others give no row.

    Tetrahedra are spread over the grid cells their boxes meet, queries lie in one: an equi-join.
    """
    t, q, keys = mesh.cornered(), queries, []
    for n in XYZ:
        low, high = (f(*[F.col(f"a{k}.{n}") for k in range(4)]) for f in (F.least, F.greatest))
        t = t.withColumn(f"__{n}", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
        q = q.withColumn(f"__{n}", F.floor(F.col(n) / size))
        keys.append(f"__{n}")
    w = bc.in_tetrahedron(Vec.of(*XYZ), *mesh.corner_vecs())
    rows = q.join(t, keys).select("q_id", "cell_id", *w.columns("w0", "w1", "w2", "w3"))
    inside = rows.filter(bc.in_cell(Vec.of("w0", "w1", "w2", "w3")))
    return inside.groupBy("q_id").agg(F.min(F.struct("cell_id", "w0", "w1", "w2", "w3")).alias("m")).select("q_id", "m.*")


def faces(mesh: Mesh) -> Mesh:
    """All distinct faces of the tetrahedra as a triangle mesh."""
    return Mesh(mesh.points, numbered(mesh.facets().select(F.col("facet").alias("pids")).distinct(), "pids", "cell_id"), 3)


def closest_in_volume(mesh: Mesh, queries: DataFrame, radius: float) -> DataFrame:
    """q_id, inside, d2, x, y, z, cell_id, weights of the closest point of the volume to each (q_id, x, y, z).

    A point in a tetrahedron is its own closest point: d2 is 0, cell_id the tetrahedron, weights its four. Else cell_id
    is the nearest triangle of the outer surface (see Mesh.outer_surface) and weights are its three.
    """
    held = containing_cells(mesh, queries, radius).join(queries.select("q_id", *XYZ), "q_id")
    inside = held.select("q_id", F.lit(True).alias("inside"), F.lit(0.0).alias("d2"), *XYZ, "cell_id", F.array("w0", "w1", "w2", "w3").alias("weights"))
    surface = mesh.outer_surface()
    hits = surface.closest_on_surface(queries.join(inside, "q_id", "left_anti"), radius).join(surface.cornered(), "cell_id")
    at = [(F.col("u") * F.col(f"a0.{n}") + F.col("v") * F.col(f"a1.{n}") + F.col("w") * F.col(f"a2.{n}")).alias(n) for n in XYZ]
    return inside.unionByName(hits.select("q_id", F.lit(False).alias("inside"), "d2", *at, "cell_id", F.array("u", "v", "w").alias("weights")))


def volume_intersections(mesh: Mesh, lines: DataFrame) -> DataFrame:
    """line_id, t of the points where lines meet faces of the tetrahedra."""
    return faces(mesh).intersections(lines).select("line_id", "t").distinct()


def has_intersection(mesh: Mesh, lines: DataFrame) -> DataFrame:
    hits = (mesh if mesh.corners == 3 else faces(mesh)).intersections(lines).select("line_id").distinct().withColumn("hit", F.lit(True))
    return lines.select("line_id").join(hits, "line_id", "left").select("line_id", F.coalesce("hit", F.lit(False)).alias("hit"))


# --- images of a surface


def _near(mesh: Mesh, grid: Grid, radius: float) -> DataFrame:
    """Grid points with the nearest surface point c and the direction from it."""
    points = grid.points(mesh.points.sparkSession).withColumnRenamed("voxel_id", "q_id")
    hit = mesh.closest_on_surface(points, radius).join(mesh.cornered(), "cell_id")
    c = [F.col("u") * F.col(f"a0.{n}") + F.col("v") * F.col(f"a1.{n}") + F.col("w") * F.col(f"a2.{n}") for n in XYZ]
    return hit.join(points, "q_id").select("q_id", "d2", "cell_id", *XYZ, *[x.alias(f"c{n}") for x, n in zip(c, XYZ)], "a0", "a1", "a2")


def distance_image(mesh: Mesh, grid: Grid, radius: float) -> DataFrame:
    """(voxel_id, value, gx, gy, gz): unsigned distance to the surface and its unit gradient (NULL on the surface)."""
    away = Vec.of(*XYZ) - Vec.of("cx", "cy", "cz")
    return _near(mesh, grid, radius).select(F.col("q_id").alias("voxel_id"), F.sqrt("d2").alias("value"), *away.normalized().columns("gx", "gy", "gz"))


def binary_image(mesh: Mesh, grid: Grid, radius: float) -> DataFrame:
    """(voxel_id, value): 1 where the normal of the nearest cell points from the voxel to the surface (inside)."""
    n = bc.normal(*[Vec.from_struct(F.col(f"a{k}")) for k in range(3)])
    inside = n.dot(Vec.of("cx", "cy", "cz") - Vec.of(*XYZ)) > 0
    return _near(mesh, grid, radius).select(F.col("q_id").alias("voxel_id"), F.coalesce(inside, F.lit(False)).cast("int").alias("value"))


# --- interpolators: a field on mesh points as a field on space


def nearest_neighbour(queries: DataFrame, values: DataFrame, start: float) -> DataFrame:
    """(q_id, value) of the nearest of (point_id, x, y, z, value)."""
    near = nearest(queries, values, start, point_id="point_id")
    return near.join(values.select(F.col("point_id").alias("p_id"), "value"), "p_id").select("q_id", "value")


def on_surface(mesh: Mesh, queries: DataFrame, radius: float, value: str = "value") -> DataFrame:
    """(q_id, value): project to the surface, then blend the corners' values."""
    return mesh.surface_property(mesh.closest_on_surface(queries, radius), value).select("q_id", value)


def in_volume(mesh: Mesh, queries: DataFrame, size: float, value: str = "value") -> DataFrame:
    """(q_id, value) by barycentric weights of the tetrahedron that holds the point; outside the mesh no row."""
    at = containing_cells(mesh, queries, size)
    blend = bc.interpolate(Vec.of("w0", "w1", "w2", "w3"), [F.col(f"a{k}.{value}") for k in range(4)])
    return at.join(mesh.cornered((value,)), "cell_id").select("q_id", blend.alias(value))


# --- lines


def consistent_directions(mesh: Mesh, line: Column | None = None) -> Mesh:
    """A line mesh whose cells run on from one another; every point has at most two cells.

    Lines are apart by a key (one line if there is none); each is walked in a group of its own, which is sequential by nature.
    """
    cells = mesh.cells.withColumn("line", F.lit(0) if line is None else line)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        at: dict[int, list[int]] = {}
        ends = {c: tuple(map(int, p)) for c, p in zip(pdf.cell_id, pdf.pids)}
        for c, (a, b) in ends.items():
            at.setdefault(a, []).append(c)
            at.setdefault(b, []).append(c)
        if any(len(v) > 2 for v in at.values()):
            raise ValueError("a point has more than two line cells")
        left, out = set(ends), []
        starts = sorted(p for p, v in at.items() if len(v) == 1) + sorted(at)
        for p in starts:
            while (mine := sorted(c for c in at[p] if c in left)):
                c = mine[0]
                left.remove(c)
                a, b = ends[c]
                other = b if a == p else a
                out.append((c, [p, other]))
                p = other
        return pd.DataFrame(out, columns=["cell_id", "pids"])

    return Mesh(mesh.points, cells.groupBy("line").applyInPandas(walk, "cell_id long, pids array<long>"), 2)


def line_normals(mesh: Mesh) -> DataFrame:
    """(cell_id, nx, ny) of a plane line mesh: the direction turned by a right angle."""
    a, b = (Vec.from_struct(F.col(f"a{k}"), ("x", "y")) for k in range(2))
    d = (b - a).normalized()
    return mesh.cornered(("x", "y")).select("cell_id", d[1].alias("nx"), (-d[0]).alias("ny"))


