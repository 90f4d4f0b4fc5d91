"""Further queries: files written and read back, geometry, kernels, processes and models with closed forms in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shapelake.functions import barycentric as bc
from shapelake.functions import scalar as sc
from shapelake.functions import transform as tf
from shapelake.functions.vector import Mat, Vec
from shapelake.model_queries import QUERIES, SQL, _reference, _shapes
from shapelake.operators import grid as gr
from shapelake.operators import mesh as ms
from shapelake.operators import volume as vo
from shapelake.operators.correspondence import SurfaceCorrespondence, warped_property
from shapelake.operators.field import EVERYWHERE
from shapelake.operators.mesh import Mesh
from shapelake.plans import discrete, gp, kernels, linalg, mcmc, pdm, register
from shapelake.queries import MESH, P1, TET, _image, grid_of, p1, part_mesh, query, r, t, tet_mesh
from shapelake.sources import h5json as hj
from shapelake.sources import landmarks as lm
from shapelake.sources import tables as tb
from shapelake.storage import fresh_path

XYZ = ("x", "y", "z")

# --- files: written to the shared folder and read back


def _plain(mesh: Mesh) -> Mesh:
    return Mesh(mesh.points.select("point_id", *XYZ, "value"), mesh.cells, mesh.corners)


@query(f"WITH {MESH} SELECT point_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(value, 6) AS value FROM pts")
def vtk_points(spark, d):
    path = fresh_path(spark, "mesh.vtk")
    tb.write_mesh(spark, _plain(part_mesh(spark, d)), path, "value")
    return tb.mesh_of(spark, path).points.select("point_id", *[r(c).alias(c) for c in (*XYZ, "value")])


@query(f"WITH {MESH} SELECT row_number() OVER (ORDER BY cell_id) - 1 AS cell_id, pids[1] AS a, pids[2] AS b, pids[3] AS c FROM cells")
def vtk_cells(spark, d):
    path = fresh_path(spark, "mesh.vtk")
    tb.write_mesh(spark, _plain(part_mesh(spark, d)), path)
    return tb.mesh_of(spark, path).cells.select("cell_id", *[F.element_at("pids", k + 1).alias(n) for k, n in enumerate("abc")])


@query(f"WITH {TET} SELECT row_number() OVER (ORDER BY cell_id) - 1 AS cell_id, pids[1] AS a, pids[2] AS b, pids[3] AS c, pids[4] AS d FROM tets")
def vtk_tetrahedra(spark, d):
    path = fresh_path(spark, "tetrahedra.vtk")
    tb.write_mesh(spark, _plain(tet_mesh(spark, d)), path)
    return tb.mesh_of(spark, path).cells.select("cell_id", *[F.element_at("pids", k + 1).alias(n) for k, n in enumerate("abcd")])


TETS = f"WITH {TET} SELECT row_number() OVER (ORDER BY cell_id) - 1 AS cell_id, pids[1] AS a, pids[2] AS b, pids[3] AS c, pids[4] AS d FROM tets"


def _tets_through(spark, d, kind):
    path = fresh_path(spark, f"tetrahedra.{kind}")
    tb.write_mesh(spark, _plain(tet_mesh(spark, d)), path, "value")
    return tb.mesh_of(spark, path)


@query(TETS)
def vtu_tetrahedra(spark, d):
    return _tets_through(spark, d, "vtu").cells.select("cell_id", *[F.element_at("pids", k + 1).alias(n) for k, n in enumerate("abcd")])


@query(f"WITH {MESH} SELECT point_id, round(x, 6) AS x, round(z, 6) AS z, round(value, 6) AS value FROM pts")
def inp_points(spark, d):
    return _tets_through(spark, d, "inp").points.select("point_id", *[r(c).alias(c) for c in ("x", "z", "value")])


def _line_mesh(spark, d, flipped: bool = False) -> Mesh:
    """The vertices of `part` in a row, every other piece of which may run backwards."""
    points = part_mesh(spark, d).points
    top = points.agg(F.max("point_id").alias("top"))
    i = F.col("point_id")
    ends = F.when(F.lit(flipped) & (i % 2 == 1), F.array(i + 1, i)).otherwise(F.array(i, i + 1))
    return Mesh(points, points.select(i, "point_id").toDF("cell_id", "point_id").crossJoin(F.broadcast(top)).filter("point_id < top").select("cell_id", ends.alias("pids")), 2)


LINE = f"{MESH}, lc AS (SELECT point_id AS cell_id, [point_id, point_id + 1] AS pids FROM pts WHERE point_id < (SELECT max(point_id) FROM pts))"


@query(f"WITH {LINE} SELECT cell_id, pids[1] AS a, pids[2] AS b FROM lc")
def vtk_lines(spark, d):
    path = fresh_path(spark, "lines.vtk")
    tb.write_mesh(spark, _plain(_line_mesh(spark, d)), path)
    return tb.mesh_of(spark, path).cells.select("cell_id", F.element_at("pids", 1).alias("a"), F.element_at("pids", 2).alias("b"))


@query(f"WITH {MESH} SELECT count(*) AS cells, round(sum(sqrt(ux*ux+uy*uy+uz*uz) / 2), 2) AS area, (SELECT count(DISTINCT point_id) FROM corner) AS points FROM nrm0")
def stl_surface(spark, d):
    """STL has corners only: points come back as distinct corners."""
    path = fresh_path(spark, "mesh.stl")
    tb.write_mesh(spark, _plain(part_mesh(spark, d)), path)
    back = tb.mesh_of(spark, path)
    return back.cells.agg(F.count(F.lit(1)).alias("cells")).crossJoin(back.measure().select(r("measure", 2).alias("area"))).crossJoin(back.points.agg(F.count(F.lit(1)).alias("points")))


@query(f"WITH {MESH} SELECT point_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, (point_id % 256)::DOUBLE AS red, (point_id * 7 % 256)::DOUBLE AS green, 255.0::DOUBLE AS alpha FROM pts")
def ply_colours(spark, d):
    path = fresh_path(spark, "mesh.ply")
    m = part_mesh(spark, d)
    rgba = F.array((F.col("point_id") % 256) / 255, (F.col("point_id") * 7 % 256) / 255, F.lit(0.0), F.lit(1.0))
    tb.write_mesh(spark, m.with_points(m.points.select("point_id", *XYZ, rgba.alias("rgba"))), path)
    back = tb.mesh_of(spark, path).points
    return back.select("point_id", *[r(c).alias(c) for c in XYZ], *[F.round(F.element_at("rgba", k) * 255, 6).alias(n) for k, n in ((1, "red"), (2, "green"), (4, "alpha"))])


@query(f"WITH {MESH} SELECT point_id, round(x * 2 + 1, 6) AS x, round(y * 2 + 1, 6) AS y, (point_id % 256)::DOUBLE AS red FROM pts")
def colour_mesh_transform(spark, d):
    """A mesh with vertex colours moves with its colours."""
    m = part_mesh(spark, d)
    coloured = m.with_points(m.points.withColumn("rgba", F.array((F.col("point_id") % 256) / 255)))
    moved = tf.translation(1, 1, 1).compose(tf.scaling(2, 3)).on(coloured.points, XYZ)
    return moved.select("point_id", r("x").alias("x"), r("y").alias("y"), F.round(F.element_at("rgba", 1) * 255, 6).alias("red"))


@query("SELECT p_partkey AS voxel_id, p_size::DOUBLE AS value FROM part")
def vtk_image(spark, d):
    path, grid = fresh_path(spark, "image.vtk"), grid_of(spark, d, (40,), (0.5, 2.0))
    tb.write_image(spark, grid, _image(spark, d), path)
    return tb.read_image(spark, path)[1].select("voxel_id", r("value").alias("value"))


@query("SELECT p_partkey AS voxel_id, p_size AS value FROM part")
def nifti_image(spark, d):
    """A 3-D image as NIfTI, read as another type."""
    path, grid = fresh_path(spark, "image.nii"), grid_of(spark, d, (5, 8), (0.5, 2.0, 1.0))
    tb.write_image(spark, grid, _image(spark, d), path, "i2")
    return tb.read_image(spark, path, "int")[1].select("voxel_id", F.col("value").cast("long").alias("value"))


@query("SELECT unnest([0, 1, 2]) AS axis, unnest([5, 8, (SELECT (max(p_partkey) + 40) // 40 FROM part)])::BIGINT AS size, unnest([0.5, 2.0, 1.0])::DOUBLE AS spacing, 'short' AS kind")
def nifti_header(spark, d):
    path, grid = fresh_path(spark, "image.nii"), grid_of(spark, d, (5, 8), (0.5, 2.0, 1.0))
    tb.write_image(spark, grid, _image(spark, d), path, "i2")
    back = tb.read_image(spark, path)[0]
    return spark.createDataFrame([(k, int(n), round(float(s), 6), tb.scalar_type(spark, path)) for k, (n, s) in enumerate(zip(back.size, back.spacing))], "axis int, size long, spacing double, kind string")


def _landmarks(spark, d):
    i = F.col("c_custkey")
    return t(spark, d, "customer").select(i.cast("string").alias("id"), F.array(F.col("c_acctbal"), (i % 7).cast("double"), (i / 8.0)).alias("coord"))


LANDMARKS = "SELECT c_custkey::VARCHAR AS id, round(c_acctbal, 6) AS x, (c_custkey % 7)::DOUBLE AS y, round(c_custkey / 8.0, 6)::DOUBLE AS z FROM customer"


def _shown(landmarks):
    return landmarks.select("id", *[r(F.element_at("coord", k + 1)).alias(n) for k, n in enumerate(XYZ)])


@query(LANDMARKS)
def landmarks_csv(spark, d):
    path = fresh_path(spark, "landmarks.csv")
    lm.write_csv(_landmarks(spark, d), path)
    return _shown(lm.read_csv(spark, path))


@query(LANDMARKS)
def landmarks_json(spark, d):
    path = fresh_path(spark, "landmarks.json")
    none = F.lit(None)
    lm.write_json(_landmarks(spark, d).select("*", none.cast("string").alias("description"), none.cast("array<double>").alias("stddevs"), none.cast("array<array<double>>").alias("pcvectors")), path)
    return _shown(lm.read_json(spark, path))


@query(LANDMARKS)
def landmarks_csv_lines(spark, d):
    """From rows of text, as a stream gives them."""
    lines = _landmarks(spark, d).select(F.concat_ws(", ", "id", *[F.element_at("coord", k).cast("string") for k in (1, 2, 3)]).alias("value"))
    return _shown(lm.from_csv_lines(lines.unionByName(spark.createDataFrame([("# a comment",)], "value string"))))


@query(LANDMARKS)
def landmarks_json_texts(spark, d):
    texts = _landmarks(spark, d).select(F.to_json(F.array(F.struct("id", F.col("coord").alias("coordinates")))).alias("value"))
    return _shown(lm.from_json_texts(texts))


COORDINATES = "e AS (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(embedding::DOUBLE[]) AS v FROM embeddings)"


@query(f"WITH {COORDINATES} SELECT round(sum(s), 4) AS total FROM (SELECT var_samp(v) AS s FROM e GROUP BY k)")
def model_files(spark, d):
    """The total variance of a model of all shapes, once it has been written and read."""
    path = fresh_path(spark, "model")
    shapes = _shapes(spark, d)
    tb.write_model(pdm.pca_model(_reference(shapes), shapes), path)
    return spark.createDataFrame([(round(float(tb.read_model(spark, path, "shape model").variance.sum()), 4),)], "total double")


@query(f"WITH {COORDINATES} SELECT round(sum(s), 4) AS total FROM (SELECT var_samp(v) AS s FROM e GROUP BY k)")
def model_hdf5_json(spark, d):
    """The same by way of an HDF5/JSON file."""
    path, shapes = fresh_path(spark, "model.json"), _shapes(spark, d)
    hj.write_h5json_model(pdm.pca_model(_reference(shapes), shapes), path)
    return spark.createDataFrame([(round(float(hj.read_h5json_model(spark, path).variance.sum()), 4),)], "total double")


@query(f"WITH {MESH} SELECT k AS item_id, count(*) AS n, round(avg(z) + k, 6) AS z, (SELECT count(*) - 1 FROM pts) AS refused FROM pts, (SELECT unnest([0, 1, 2]) AS k) GROUP BY k")
def shape_collection(spark, d):
    """Three files in correspondence with the mesh and one that lacks a point, read as a collection."""
    folder, m = fresh_path(spark, "shapes"), _plain(part_mesh(spark, d))
    for k in range(4):
        moved = m.with_points(m.points.withColumn("z", F.col("z") + k))
        tb.write_mesh(spark, moved.mask_points(F.col("point_id") > 0) if k == 3 else moved, f"{folder}/{k}.vtk")
    shapes, refused = tb.read_shapes(spark, f"{folder}/*.vtk", m.points)
    found = shapes.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), r(F.avg("z")).alias("z"))
    return found.crossJoin(F.broadcast(refused.agg(F.max("n").alias("refused"))))


@query("SELECT 'shape model' AS kind, '1.1' AS version, false AS has_cells")
def model_catalog(spark, d):
    path = fresh_path(spark, "model")
    shapes = _shapes(spark, d)
    tb.write_model(pdm.pca_model(_reference(shapes), shapes, rank=2), path)
    return tb.read_catalog(spark, path).select("kind", "version", "has_cells")


# --- models


@query(f"WITH {COORDINATES}, c AS (SELECT k // 3 AS point_id, a.k % 3 AS i, b.k % 3 AS j, a.v, b.v AS w FROM e a JOIN e b USING (vec_id) WHERE a.k // 3 = b.k // 3) SELECT point_id, i::INT AS i, j::INT AS j, round(covar_samp(v, w), 6) + 0 AS cov FROM c GROUP BY ALL".replace("SELECT k // 3", "SELECT a.k // 3"))
def model_covariance(spark, d):
    """Every point's covariance by the model of full rank; the components after the 64th are constant and left out."""
    shapes = _shapes(spark, d)
    cov = pdm.pca_model(_reference(shapes), shapes).covariance()
    return cov.filter("point_id * 3 + i < 64 AND point_id * 3 + j < 64").select("point_id", "i", "j", (r("cov") + 0).alias("cov"))


@query(f"WITH {COORDINATES}, m AS (SELECT k // 3 AS point_id, k % 3 AS c, avg(v) AS v FROM e GROUP BY ALL) SELECT point_id, round(max(CASE WHEN c = 0 THEN v END), 6) AS x, round(coalesce(max(CASE WHEN c = 1 THEN v END), 0), 6) AS y, round(coalesce(max(CASE WHEN c = 2 THEN v END), 0), 6) AS z FROM m GROUP BY point_id")
def model_mean(spark, d):
    shapes = _shapes(spark, d)
    mean = pdm.pca_model(_reference(shapes), shapes, rank=3).truncate(1).mean()
    return mean.select("point_id", *[r(c).alias(c) for c in XYZ])


@query(f"WITH {COORDINATES} SELECT round(sum(s) + 3, 4) AS total, 65::BIGINT AS rank FROM (SELECT var_samp(v) AS s FROM e GROUP BY k)")
def model_augmented(spark, d):
    """A direction that no shape has, of variance 3, adds it to the total and one to the rank."""
    shapes = _shapes(spark, d)
    m = pdm.pca_model(_reference(shapes), shapes)
    extra = m.points.select("point_id", "component", F.array(F.when((F.col("point_id") == 21) & (F.col("component") == 2), 1.0).otherwise(0.0)).alias("basis"))
    out = m.augment(extra, np.array([3.0]))
    return spark.createDataFrame([(round(float(out.variance.sum()), 4), out.rank)], "total double, rank long")


@query("SELECT p_partkey AS point_id, round(p_size + 2 * 0.5 * (p_partkey % 3), 6) AS value, round((p_partkey % 40) + 3 * 0.25, 6) AS x FROM part")
def intensity_model_instance(spark, d):
    """A model of positions and values with one basis each: moved by its coefficients."""
    points = part_mesh(spark, d).points.select("point_id", *XYZ)
    zero = F.lit(0.0).alias("mean")
    shape = pdm.ShapeModel(points, points.select("point_id", F.explode(F.array(*map(F.lit, range(3)))).alias("component")).select("point_id", "component", zero, F.array(F.when(F.col("component") == 0, 0.25).otherwise(0.0)).alias("basis")), np.array([9.0]))
    base = _image(spark, d).toDF("point_id", "value")
    values = pdm.ShapeModel(base, base.select("point_id", F.lit(0).alias("component"), zero, F.array(0.5 * (F.col("point_id") % 3)).alias("basis")), np.array([4.0]), None, ("value",))
    return discrete.VolumeIntensityModel(shape, values).instance([1.0], [1.0]).select("point_id", r("value").alias("value"), r("x").alias("x"))


# --- domains and masks


@query(f"WITH {P1} SELECT count(*) AS n FROM p1")
def whole_space(spark, d):
    return EVERYWHERE.filter(p1(spark, d), XYZ).agg(F.count(F.lit(1)).alias("n"))


@query("WITH q AS (SELECT p_partkey, [(p_size / 4.0 - 1) / 0.5, ((p_partkey % 30) + 2) / 2.0, (p_partkey % 50 * 0.5 - 0.5) / 1.5]::DOUBLE[] AS c FROM part) SELECT p_partkey, (c[1] - floor(c[1] + 0.5) <= 1e-8 AND floor(c[1] + 0.5) < 10 AND c[2] - floor(c[2] + 0.5) <= 1e-8 AND floor(c[2] + 0.5) < 10 AND c[3] - floor(c[3] + 0.5) <= 1e-8 AND floor(c[3] + 0.5) < 20) AS on_grid FROM q")
def grid_points_defined(spark, d):
    grid = gr.Grid((1.0, -2.0, 0.5), (0.5, 2.0, 1.5), (10, 10, 20))
    q = t(spark, d, "part").select("p_partkey", (F.col("p_size") / 4.0).alias("x"), (F.col("p_partkey") % 30).cast("double").alias("y"), (F.col("p_partkey") % 50 * 0.5).alias("z"))
    return q.select("p_partkey", grid.on_grid(Vec.of(*XYZ)).alias("on_grid"))


@query(f"WITH {MESH} SELECT cell_id FROM cells WHERE cell_id % 3 <> 0")
def mask_cells(spark, d):
    return part_mesh(spark, d).mask_cells(F.col("cell_id") % 3 != 0).cells.select("cell_id")


@query(f"WITH {MESH} SELECT cell_id FROM cells WHERE pids[1] % 5 <> 0 AND pids[2] % 5 <> 0 AND pids[3] % 5 <> 0")
def mask_points(spark, d):
    return part_mesh(spark, d).mask_points(F.col("point_id") % 5 != 0).cells.select("cell_id")


# --- geometry

TRIANGLE_D2 = """e AS (SELECT *, bx-ax ux, b_y-ay uy, bz-az uz, cx-ax vx, cy-ay vy, cz-az vz, px-ax wx, py-ay wy, pz-az wz FROM q, tri),
g AS (SELECT *, ux*ux+uy*uy+uz*uz uu, ux*vx+uy*vy+uz*vz uv, vx*vx+vy*vy+vz*vz vv, wx*ux+wy*uy+wz*uz wu, wx*vx+wy*vy+wz*vz wv, wx*wx+wy*wy+wz*wz ww FROM e),
h AS (SELECT *, uu*vv-uv*uv AS det, (vv*wu-uv*wv)/(uu*vv-uv*uv) AS s, (uu*wv-uv*wu)/(uu*vv-uv*uv) AS t_,
      least(greatest(wu/uu, 0), 1) AS t0, least(greatest(wv/vv, 0), 1) AS t1, least(greatest((wv - wu - uv + uu)/(uu - 2*uv + vv), 0), 1) AS t2 FROM g),
o AS (SELECT q_id, cell_id, CASE WHEN s >= 0 AND t_ >= 0 AND s + t_ <= 1 THEN greatest(ww - s*wu - t_*wv, 0)
      ELSE least(ww - 2*t0*wu + t0*t0*uu, ww - 2*t1*wv + t1*t1*vv,
                 (wx - ux - t2*(vx-ux))*(wx - ux - t2*(vx-ux)) + (wy - uy - t2*(vy-uy))*(wy - uy - t2*(vy-uy)) + (wz - uz - t2*(vz-uz))*(wz - uz - t2*(vz-uz))) END AS d2 FROM h)"""
SURFACE_QUERIES = "q AS (SELECT c_custkey AS q_id, c_custkey % 39 + 0.3::DOUBLE AS px, c_custkey % 4 + 0.6::DOUBLE AS py, c_acctbal / 2000 AS pz FROM customer)"


@query(f"WITH {MESH}, {SURFACE_QUERIES}, {TRIANGLE_D2} SELECT q_id, round(min(d2), 6) AS d2 FROM o GROUP BY q_id")
def surface_d2(spark, d):
    """Squared distance of points to the surface."""
    i = F.col("c_custkey")
    q = t(spark, d, "customer").select(i.alias("q_id"), (i % 39 + 0.3).alias("x"), (i % 4 + 0.6).alias("y"), (F.col("c_acctbal") / 2000).alias("z"))
    return part_mesh(spark, d).closest_on_surface(q, 1.0).select("q_id", r("d2").alias("d2"))


@query(f"WITH {MESH}, q AS (SELECT point_id AS q_id, x AS px, y AS py, z + 0.75 AS pz FROM pts WHERE point_id IN (SELECT point_id FROM corner)), {TRIANGLE_D2}, n AS (SELECT min(d2) AS d2 FROM o GROUP BY q_id) SELECT round(avg(sqrt(d2)), 6) AS avg_distance FROM n")
def surface_avg_distance(spark, d):
    """Mean distance of a lifted mesh's vertices to the mesh."""
    m = part_mesh(spark, d).compact()[0]
    lifted = m.with_points(m.points.withColumn("z", F.col("z") + 0.75))
    return ms.average_surface_distance(lifted, m, 1.0).select(r("avg_distance").alias("avg_distance"))


@query(f"WITH {MESH}, q AS (SELECT (p_partkey)::BIGINT AS q_id, p_partkey % 10 * 4.0::DOUBLE AS px, (p_partkey // 10) % 10 * 0.5::DOUBLE AS py, (p_partkey // 100)::DOUBLE * 2.5 AS pz FROM (SELECT unnest(range(0, 300)) AS p_partkey)), {TRIANGLE_D2} SELECT q_id AS voxel_id, round(sqrt(min(d2)), 6) AS value FROM o GROUP BY q_id")
def mesh_distance_image(spark, d):
    """The unsigned distance image of the surface on a grid of 10 x 10 x 3."""
    grid = gr.Grid((0.0, 0.0, 0.0), (4.0, 0.5, 2.5), (10, 10, 3))
    return vo.distance_image(part_mesh(spark, d), grid, 1.0).select("voxel_id", r("value").alias("value"))


@query(f"WITH {MESH} SELECT DISTINCT point_id AS q_id, value FROM pts WHERE point_id IN (SELECT point_id FROM corner)")
def surface_interpolation(spark, d):
    """At the surface's own vertices the interpolated field has their values."""
    m = part_mesh(spark, d).compact()
    back = m[1].select("point_id", "old_id")
    at = m[0].points.select(F.col("point_id").alias("q_id"), *XYZ)
    return vo.on_surface(m[0], at, 1.0).join(back, F.col("q_id") == F.col("point_id")).select(F.col("old_id").alias("q_id"), r("value").alias("value"))


@query(f"WITH {MESH}, v AS (SELECT point_id, x, y, z, value FROM pts), q AS (SELECT c_custkey AS q_id, c_acctbal / 250 AS x, (c_custkey % 5)::DOUBLE AS y, (c_custkey % 6) + 0.1::DOUBLE AS z FROM customer) SELECT q_id, arg_min(value, (d2, point_id)) AS value FROM (SELECT q_id, point_id, value, (q.x-v.x)*(q.x-v.x)+(q.y-v.y)*(q.y-v.y)+(q.z-v.z)*(q.z-v.z) AS d2 FROM q, v) GROUP BY q_id")
def nearest_interpolation(spark, d):
    i = F.col("c_custkey")
    q = t(spark, d, "customer").select(i.alias("q_id"), (F.col("c_acctbal") / 250).alias("x"), (i % 5).cast("double").alias("y"), (i % 6 + 0.1).alias("z"))
    return vo.nearest_neighbour(q, part_mesh(spark, d).points.select("point_id", *XYZ, "value"), 1.0).select("q_id", "value")


@query("SELECT p_partkey AS q_id, p_size::DOUBLE AS value FROM part")
def bspline_at_voxels(spark, d):
    """The cubic B-spline interpolation goes through the voxels' values."""
    grid = grid_of(spark, d, (40,))
    return gr.interpolate(grid.points(spark), gr.bspline_coefficients(_image(spark, d), grid, 3), grid, ("x", "y"), "voxel_id", 3).select("q_id", r("value").alias("value"))


@query("WITH n AS (SELECT (max(p_partkey) + 40) // 40 AS n FROM part) SELECT i AS q_id, round(1 + 2 * (i % 39 + 0.5) - 3 * (i // 39 + 0.5), 6)::DOUBLE AS value, 2.0::DOUBLE AS g0, -3.0::DOUBLE AS g1 FROM n, (SELECT unnest(range(0, 39 * ((SELECT n FROM n) - 1))) AS i)")
def linear_image_gradient(spark, d):
    """Value and gradient, between the voxels, of an image that is linear in its position."""
    grid = grid_of(spark, d, (40,))
    image = grid.points(spark).select("voxel_id", (1 + 2 * F.col("x") - 3 * F.col("y")).alias("value"))
    q = gr.Grid((0.5, 0.5), (1.0, 1.0), (39, max(grid.size[1] - 1, 1))).points(spark)
    out = gr.interpolate_with_gradient(q, image, grid, ("x", "y"), "voxel_id", 1)
    return out.select("q_id", *[r(c).alias(c) for c in ("value", "g0", "g1")])


@query(f"WITH {TET}, s AS (SELECT *, sqrt((bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay)+(bz-az)*(bz-az)) * sqrt((dx-cx)*(dx-cx)+(dy-cy)*(dy-cy)+(dz-cz)*(dz-cz)) AS p, sqrt((cx-ax)*(cx-ax)+(cy-ay)*(cy-ay)+(cz-az)*(cz-az)) * sqrt((dx-bx)*(dx-bx)+(dy-b_y)*(dy-b_y)+(dz-bz)*(dz-bz)) AS q, sqrt((dx-ax)*(dx-ax)+(dy-ay)*(dy-ay)+(dz-az)*(dz-az)) * sqrt((cx-bx)*(cx-bx)+(cy-b_y)*(cy-b_y)+(cz-bz)*(cz-bz)) AS o FROM tv) SELECT cell_id, round(vol, 6) + 0 AS volume, CASE WHEN abs(vol) > 0.01 THEN round(sqrt(greatest((p+q+o)*(p+q-o)*(p-q+o)*(-p+q+o), 0)) / (24 * abs(vol)), 3) END AS circumradius FROM s")
def tetrahedron_spheres(spark, d):
    """Signed volume and radius of the sphere through the corners (where the volume is not tiny)."""
    m = tet_mesh(spark, d)
    corners = m.corner_vecs()
    volume = bc.signed_volume(*corners)
    radius = (bc.circumcenter(*corners) - corners[0]).norm()
    return m.cornered().select("cell_id", (r(volume) + 0).alias("volume"), F.when(F.abs(volume) > 0.01, r(radius, 3)).alias("circumradius"))


PQ = f"{P1}, v AS (SELECT l_orderkey, l_linenumber, x px, y py, z pz, 10.0::DOUBLE ax, 2.0::DOUBLE ay, 1.0::DOUBLE az, 20.0::DOUBLE ux, 5.0::DOUBLE uy, -1.0::DOUBLE uz FROM p1), w AS (SELECT *, ((px-ax)*ux+(py-ay)*uy+(pz-az)*uz)/(ux*ux+uy*uy+uz*uz) AS s FROM v)"


@query(f"WITH {PQ}, k AS (SELECT *, least(greatest(s, 0), 1) AS t_ FROM w) SELECT l_orderkey, l_linenumber, round(t_, 6) AS t, round((px-ax-t_*ux)*(px-ax-t_*ux)+(py-ay-t_*uy)*(py-ay-t_*uy)+(pz-az-t_*uz)*(pz-az-t_*uz), 6) AS segment, round((px-ax-s*ux)*(px-ax-s*ux)+(py-ay-s*uy)*(py-ay-s*uy)+(pz-az-s*uz)*(pz-az-s*uz), 6) AS line, (px-ax-s*ux)*(px-ax-s*ux)+(py-ay-s*uy)*(py-ay-s*uy)+(pz-az-s*uz)*(pz-az-s*uz) <= 9 AS sphere FROM k")
def segment_distances(spark, d):
    """Of points to a segment and its line, and whether the line meets a sphere of radius 3 around them."""
    p, a, u = Vec.of(*XYZ), Vec.of(10.0, 2.0, 1.0), Vec.of(20.0, 5.0, -1.0)
    b = a + u
    return p1(spark, d).select("l_orderkey", "l_linenumber", r(bc.segment_parameter(p, a, b)).alias("t"), r(bc.segment_distance2(p, a, b)).alias("segment"), r(bc.line_distance2(p, a, u)).alias("line"), bc.line_meets_sphere(a, u, p, F.lit(3.0)).alias("sphere"))


@query("SELECT p_partkey, (p_size * 3 + (p_partkey % 7) * 2 - 5)::BIGINT AS dot, (p_size + 3)::BIGINT AS sx, (p_size * 4)::BIGINT AS scaled, (p_size * (2 * 6 - 5 * 1) - (p_partkey % 7) * (1 * 6 - 5 * 4) + 3 * (1 * 1 - 2 * 4))::BIGINT AS det FROM part")
def integer_vectors(spark, d):
    i, s = F.col("p_partkey") % 7, F.col("p_size")
    a, b = Vec((s, i, F.lit(-1))), Vec((F.lit(3), F.lit(2), F.lit(5)))
    m = Mat(((s, i, F.lit(3)), (F.lit(1), F.lit(2), F.lit(5)), (F.lit(4), F.lit(1), F.lit(6))))
    return t(spark, d, "part").select("p_partkey", *[c.cast("long").alias(n) for c, n in ((a.dot(b), "dot"), ((a + b)[0], "sx"), ((a * 4)[0], "scaled"), (m.det(), "det"))])


@query(f"WITH {P1}, c AS (SELECT *, (x - 25) / 10 AS a, (y - 5) / 5 AS b FROM p1) SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(a) <= 2.4 AND abs(b) <= 2.4 THEN exp(-(a*a+b*b)/(2*0.64)) / (2*pi()*0.64) ELSE 0 END, 6) AS gauss, CASE WHEN abs(a) < 0.75 AND abs(b) < 0.75 THEN round(1 / 2.25, 6) ELSE 0 END::DOUBLE AS box FROM c")
def point_filters(spark, d):
    parts = [(F.col("x") - 25) / 10, (F.col("y") - 5) / 5]
    return p1(spark, d).select("l_orderkey", "l_linenumber", r(sc.gaussian_filter(parts, 0.8)).alias("gauss"), r(sc.box_filter(parts, 1.5)).alias("box"))


TURN = "a AS (SELECT cos(0.4) AS c, sin(0.4) AS s), w AS (SELECT l_orderkey, l_linenumber, x, y, c, s FROM p1, a)"
CENTER = (2.0, 1.0)


@query(f"WITH {P1}, {TURN} SELECT l_orderkey, l_linenumber, round(2.5 * x, 6) AS sx, round(c*(x-2)-s*(y-1)+2+3, 6) AS rx, round(s*(x-2)+c*(y-1)+1-4, 6) AS ry, round(c*(x+3-2)-s*(y-4-1)+2, 6) AS tx, round(2.5*(c*(x-2)-s*(y-1)+2)+3, 6) AS mx, round(2.5*(s*(x-2)+c*(y-1)+1)-4, 6) AS my FROM w")
def transformation_families(spark, d):
    """Scaling, both rigid orders and a similarity, each from its space."""
    p = Vec.of("x", "y")
    move, angle = (3.0, -4.0), (0.4,)
    rigid, similar = tf.rigid_space(CENTER)((*move, *angle)), tf.similarity_space(CENTER)((*move, 2.5, *angle))
    before = tf.rotation_after_translation(angle, CENTER, move)
    columns = [(tf.scaling_space(2)((2.5,))(p)[0], "sx"), (rigid(p)[0], "rx"), (rigid(p)[1], "ry"), (before(p)[0], "tx"), (similar(p)[0], "mx"), (similar(p)[1], "my")]
    return p1(spark, d).select("l_orderkey", "l_linenumber", *[r(c).alias(n) for c, n in columns])


@query("SELECT i AS k, round(-1.5 + 0.06 * i, 6)::DOUBLE AS first, round(-1.2 + 0.05 * i, 6)::DOUBLE AS second, round(1.4 - 0.04 * i, 6)::DOUBLE AS third, round(sin(0.07 * i) + 0, 6) + 0 AS plane FROM (SELECT unnest(range(0, 40)) AS i)")
def euler_angles(spark, d):
    """Angles found again from their rotation matrices."""
    rows = []
    for i in range(40):
        back = tf.euler_angles(tf.rotation_matrix((-1.5 + 0.06 * i, -1.2 + 0.05 * i, 1.4 - 0.04 * i)))
        rows.append((i, *[round(float(a), 6) for a in back], round(float(np.sin(tf.euler_angles(tf.rotation_matrix((0.07 * i,)))[0])), 6) + 0.0))
    return spark.createDataFrame(rows, "k long, first double, second double, third double, plane double")


@query("SELECT * FROM (VALUES ('shift', 0, 1.0::DOUBLE, 0.0::DOUBLE), ('shift', 1, 0.0, 1.0), ('turn', 0, round(-sin(0.4) * 3 - cos(0.4) * 2, 5), round(cos(0.4) * 3 - sin(0.4) * 2, 5)), ('scale', 0, 5.0, 3.0), ('position', 0, round(cos(0.4), 5), round(sin(0.4), 5)), ('position', 1, round(-sin(0.4), 5), round(cos(0.4), 5))) AS v(kind, k, dx, dy)")
def jacobians(spark, d):
    """Derivatives at the point (5, 3) by the parameters of a shift, a turn about (2, 1) and a scaling, and by the position."""
    at, rows = np.array([5.0, 3.0]), []
    turn = tf.rotation_space(CENTER)((0.4,))
    for kind, m in (("shift", tf.translation_space(2)((1.0, 2.0)).parameter_jacobian(at)), ("turn", turn.parameter_jacobian(at)), ("scale", tf.scaling_space(2)((2.0,)).parameter_jacobian(at)), ("position", turn.position_jacobian(at))):
        rows += [(kind, k, round(float(m[0, k]), 5), round(float(m[1, k]), 5)) for k in range(m.shape[1])]
    return spark.createDataFrame(rows, "kind string, k int, dx double, dy double")


# --- topology


@query(f"WITH {LINE} SELECT unnest([pids[1], pids[2]]) AS point_id, unnest([pids[2], pids[1]]) AS neighbour FROM lc")
def line_adjacent_points(spark, d):
    return _line_mesh(spark, d).adjacent_points()


@query(f"WITH {LINE}, p AS (SELECT unnest(pids) AS p FROM lc) SELECT p AS point_id FROM p GROUP BY p HAVING count(*) % 2 = 1")
def line_ends(spark, d):
    return _line_mesh(spark, d).boundary_points()


@query(f"WITH {LINE} SELECT cell_id, pids[1] AS a, pids[2] AS b FROM lc")
def line_directions(spark, d):
    """Pieces of which every other runs backwards, made to run on from one another."""
    out = vo.consistent_directions(_line_mesh(spark, d, flipped=True))
    return out.cells.select("cell_id", F.element_at("pids", 1).alias("a"), F.element_at("pids", 2).alias("b"))


@query(f"WITH {TET}, c AS (SELECT cell_id, unnest(pids) AS p FROM tets) SELECT DISTINCT a.p AS point_id, b.p AS neighbour FROM c a JOIN c b USING (cell_id) WHERE a.p <> b.p")
def tet_adjacent_points(spark, d):
    return tet_mesh(spark, d).adjacent_points()


@query(f"WITH {TET}, c AS (SELECT cell_id, unnest(pids) AS p FROM tets) SELECT DISTINCT a.cell_id, b.cell_id AS neighbour FROM c a JOIN c b USING (p) WHERE a.cell_id <> b.cell_id")
def tet_adjacent_cells(spark, d):
    return tet_mesh(spark, d).adjacent_cells()


@query(f"WITH {MESH} SELECT cell_id, round((x + 2 * y + 3 * z) / 6, 6) AS value FROM (SELECT cell_id, a.value AS x, b.value AS y, c.value AS z FROM cells JOIN pts a ON a.point_id = pids[1] JOIN pts b ON b.point_id = pids[2] JOIN pts c ON c.point_id = pids[3])")
def corresponding_property(spark, d):
    """A property seen from a surface whose cells have their corners turned by one."""
    m = part_mesh(spark, d)
    turned = Mesh(m.points, m.cells.select("cell_id", F.array(*[F.element_at("pids", k) for k in (2, 3, 1)]).alias("pids")))
    c = SurfaceCorrespondence.between(turned, m, m.points.select("point_id", F.col("point_id").alias("to_point")))
    at = turned.cells.select("cell_id", F.col("cell_id").alias("name"), F.lit(2 / 6).alias("u"), F.lit(3 / 6).alias("v"), F.lit(1 / 6).alias("w"))
    return warped_property(m, c, at).select(F.col("name").alias("cell_id"), r("value").alias("value"))


# --- kernels


def _sizes(spark, d):
    return t(spark, d, "part").select((F.col("p_size") / 4.0).alias("x")).distinct()


SIZES = "s AS (SELECT DISTINCT p_size / 4.0::DOUBLE AS x FROM part)"


@query(f"WITH {SIZES} SELECT a.x AS x, b.x AS y, round(2 * (exp(-(a.x-b.x)*(a.x-b.x)/9) + 0.25 * exp(-(a.x-b.x)*(a.x-b.x)/25)) * exp(-(a.x-b.x)*(a.x-b.x)/4), 8) AS k FROM s a, s b")
def kernel_algebra(spark, d):
    k = 2 * ((kernels.gaussian(3.0) + kernels.gaussian(5.0, 0.5)) * kernels.gaussian(2.0))
    s = _sizes(spark, d)
    return s.crossJoin(s.withColumnRenamed("x", "y")).select("x", "y", r(k.column(Vec.of("x"), Vec.of("y")), 8).alias("k"))


B3 = "CASE WHEN abs({0}) < 1 THEN 2.0 / 3 - {0} * {0} + 0.5 * abs({0}) * {0} * {0} WHEN abs({0}) < 2 THEN (2 - abs({0})) * (2 - abs({0})) * (2 - abs({0})) / 6 ELSE 0 END"


def _block_rows(spark, d, kernel):
    """A kernel's matrix over the distinct sizes, of which there are at most fifty."""
    x = np.array(sorted(row.x for row in _sizes(spark, d).collect()))
    k = kernel(x[:, None])
    return spark.createDataFrame([(float(a), float(b), round(float(k[i, j]), 8) + 0.0) for i, a in enumerate(x) for j, b in enumerate(x)], "x double, y double, k double")


@query(f"WITH {SIZES}, n AS (SELECT unnest(range(-8, 40)) AS n) SELECT a.x AS x, b.x AS y, round(sum(({B3.format('(2 * a.x - n)')}) * ({B3.format('(2 * b.x - n)')})), 8) + 0 AS k FROM s a, s b, n GROUP BY 1, 2")
def kernel_bspline(spark, d):
    return _block_rows(spark, d, lambda x: kernels.bspline_kernel(3, 1).block(x, x))


@query(f"WITH {SIZES} SELECT a.x AS x, b.x AS y, round(3 * (exp(-(a.x-b.x)*(a.x-b.x)/9) + exp(-4*(a.x-b.x)*(a.x-b.x)/9)) * exp(-(a.x-b.x)*(a.x-b.x)/16), 8) AS k FROM s a, s b")
def kernel_matrix_valued(spark, d):
    """An entry of sums, products and compositions of diagonal matrix kernels; entries off the diagonal are 0."""
    one = kernels.diagonal([kernels.gaussian(7.0), kernels.gaussian(3.0)])
    k = (one + one.compose(lambda v: 2 * v)) * kernels.diagonal(kernels.gaussian(4.0), 2) * 3.0

    def entry(x):
        block = k.block(x, x)
        assert not block[0::2, 1::2].any()
        return block[1::2, 1::2]

    return _block_rows(spark, d, entry)


@query(f"WITH {COORDINATES}, p AS (SELECT vec_id, k, v FROM e WHERE k < 6) SELECT a.k::INT AS i, b.k::INT AS j, round(covar_samp(a.v, b.v), 6) + 0 AS k FROM p a JOIN p b USING (vec_id) GROUP BY 1, 2")
def kernel_sample_covariance(spark, d):
    """Between two points of three components: the covariance of all items there."""
    e = t(spark, d, "embeddings").select(F.slice("embedding", 1, 6).cast("array<double>").alias("v")).toPandas()
    k = kernels.sample_covariance(np.array([[0.0], [1.0]]), np.stack(e.v.to_numpy()).reshape(len(e), 2, 3))
    block = k.block(np.array([[0.1], [0.9]]), np.array([[0.1], [0.9]]))
    return spark.createDataFrame([(i, j, round(float(block[i, j]), 6) + 0.0) for i in range(6) for j in range(6)], "i int, j int, k double")


# --- processes

TIMES = "e AS (SELECT event_id, hour(ts) + minute(ts) / 60.0::DOUBLE AS x FROM events)"


def _times(spark, d):
    return t(spark, d, "events").select("event_id", (F.hour("ts") + F.minute("ts") / 60.0).alias("x"))


GP = gp.GaussianProcess(lambda x: 2 * x, kernels.diagonal(kernels.gaussian(4.0, 3.0), 1))


@query(f"WITH {TIMES} SELECT event_id, round(2 * x + 9 * exp(-(x - 12) * (x - 12) / 16) / (9 + 0.5) * (30 - 24), 6) AS mean FROM e")
def gp_one_observation(spark, d):
    """A process with mean 2 x, seen once: 30 at 12 with noise 0.5."""
    return GP.posterior(np.array([[12.0]]), np.array([[30.0]]), 0.5).predict(_times(spark, d), ["x"], "event_id", ["mean"]).select("event_id", r("mean").alias("mean"))


@query(f"WITH {TIMES} SELECT DISTINCT x, round(2 * x, 6) AS mean, round(9 - 81 * exp(-(x - 12) * (x - 12) / 8) / 9.5, 6) AS variance FROM e WHERE x = floor(x)")
def gp_marginals(spark, d):
    """Prior mean and posterior variance at every full hour."""
    x = np.array(sorted(row.x for row in _times(spark, d).filter("x = floor(x)").select("x").distinct().collect()))[:, None]
    after = GP.posterior(np.array([[12.0]]), np.array([[30.0]]), 0.5).marginal(x)
    return spark.createDataFrame([(float(a), float(m), round(float(v), 6)) for a, m, v in zip(x.ravel(), GP.marginal(x).mean, np.diag(after.cov))], "x double, mean double, variance double")


@query("SELECT round(-0.5 * 36 / 9.5 - 0.5 * ln(9.5) - 0.5 * ln(2 * pi()), 6) AS process, round(-0.5 * 36 / 9.5 - 0.5 * ln(9.5) - 0.5 * ln(2 * pi()), 6) AS discrete")
def gp_marginal_likelihoods(spark, d):
    x = np.arange(24.0)[:, None]
    of = discrete.DiscreteProcess.of(GP, x)
    rows = (GP.marginal_likelihood(x[12:13], np.array([[30.0]]), 0.5), of.marginal_likelihood([12], np.array([[30.0]]), 0.5))
    return spark.createDataFrame([tuple(round(float(v), 6) for v in rows)], "process double, discrete double")


@query("SELECT i AS point_id, round(2 * i + 9 * exp(-(i - 12) * (i - 12) / 16.0) / 9.5 * 6, 6) AS mean, round(9 - 81 * exp(-(i - 12) * (i - 12) / 8.0) / 9.5, 6) AS variance FROM (SELECT unnest(range(0, 24)) AS i)")
def discrete_process(spark, d):
    """A process on 24 points, conditioned on one of them."""
    post = discrete.DiscreteProcess.of(GP, np.arange(24.0)[:, None]).posterior([12], np.array([[30.0]]), 0.5)
    return spark.createDataFrame([(i, round(float(post.mean[i, 0]), 6), round(float(post.marginal_at(i).cov[0, 0]), 6)) for i in range(24)], "point_id long, mean double, variance double")


@query(f"WITH {MESH}, f AS (SELECT x AS x0, y AS y0, z AS z0 FROM pts ORDER BY point_id LIMIT 1) SELECT point_id, round(exp(-((x-x0)*(x-x0)+(y-y0)*(y-y0)+(z-z0)*(z-z0)) / 64), 6) AS l FROM pts, f")
def cholesky_first_column(spark, d):
    """Of a stationary kernel's matrix the first pivot is the first point, its column the kernel to it."""
    p = part_mesh(spark, d).points.select("point_id", *XYZ)
    return linalg.tall_pivoted_cholesky(p, kernels.gaussian(8.0), list(XYZ), 1).select("point_id", r(F.element_at("l", 1)).alias("l"))


NORMAL = "m AS (SELECT avg(l_quantity) AS mx, avg(l_discount * 100) AS my, covar_samp(l_quantity, l_quantity) AS a, covar_samp(l_quantity, l_discount * 100) AS b, covar_samp(l_discount * 100, l_discount * 100) AS c FROM lineitem), v AS (SELECT *, (a + c) / 2 AS h, sqrt((a - c) * (a - c) / 4 + b * b) AS g FROM m)"


@query(f"WITH {NORMAL} SELECT unnest([0, 1]) AS k, unnest([round(h + g, 4), round(h - g, 4)]) AS variance, unnest([round(mx, 6), round(my, 6)]) AS mean FROM v")
def mvn_principal_components(spark, d):
    from shapelake.operators import stats as st

    rows = t(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    n = gp.Mvn.from_moments(st.moments(rows, ("x", "y")).first(), ("x", "y"))
    return spark.createDataFrame([(k, round(v, 4), round(float(n.marginal([k]).mean[0]), 6)) for k, (_, v) in enumerate(n.principal_components())], "k int, variance double, mean double")


# --- optimisers, registration, chains


@query("SELECT * FROM (VALUES ('lbfgs', 3.0::DOUBLE, -2.0::DOUBLE), ('gradient_descent', 3.0, -2.0)) AS v(method, x, y)")
def minimisers(spark, d):
    """Both end at the minimum of a paraboloid."""
    cost = lambda p: (float((p[0] - 3) ** 2 + 2 * (p[1] + 2) ** 2), np.array([2 * (p[0] - 3), 4 * (p[1] + 2)]))
    ends = [("lbfgs", list(linalg.lbfgs(cost, np.zeros(2)))[-1]), ("gradient_descent", list(linalg.gradient_descent(cost, np.zeros(2), 200))[-1])]
    return spark.createDataFrame([(name, *[round(float(x), 3) + 0.0 for x in s.parameters]) for name, s in ends], "method string, x double, y double")


@query("SELECT k, value FROM (VALUES (0, 1.0::DOUBLE), (1, 2.0), (2, 3.0), (3, 0.3), (4, -0.2), (5, 0.5), (6, 1.5)) AS v(k, value)")
def similarity3d(spark, d):
    """A known shift, three angles and a scale, found from the vertices of `part` before and after."""
    p = part_mesh(spark, d).points.select(F.col("point_id").alias("id"), *XYZ)
    moved = tf.similarity((1, 2, 3), 1.5, (0.3, -0.2, 0.5), (0, 0, 0)).on(p, XYZ)
    fit = register.landmark_fit(register.match_landmarks(p, moved, XYZ), XYZ, similarity=True)
    shift, scale, angles = fit.parameters[:3], fit.parameters[3], fit.parameters[4:]
    return spark.createDataFrame([(k, round(float(v), 4)) for k, v in enumerate((*shift, *angles, scale))], "k int, value double")


@query("WITH v AS (SELECT l_quantity * 2 + 5 - l_extendedprice / 1000 AS r FROM lineitem) SELECT round(avg(r * r), 4) AS mean_squares, round(avg(CASE WHEN r < 1.345 THEN r * r / 2 ELSE 1.345 * (r - 1.345 / 2) END), 4) AS huber, round(avg(2 * r * 2), 4) AS slope, 26.0::DOUBLE AS penalty FROM v")
def metric_values(spark, d):
    """Losses of an image 2 x at points moved by 2.5, their derivative by the shift, and the regulariser at (1, 5)."""
    samples = t(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("f"))
    image = lambda x: (2 * x[:, 0], np.full((len(x), 1), 2.0))
    of = lambda loss: register.PointwiseMetric(samples, ("x",), "f", image, tf.translation_space(1), loss).value_and_derivative(np.array([2.5]))
    squares, slope = of(register.squared_loss)
    return spark.createDataFrame([(round(squares, 4), round(of(register.huber_loss())[0], 4), round(float(slope[0]), 4), float(register.l2_regulariser(np.array([1.0, 5.0]))[0]))], "mean_squares double, huber double, slope double, penalty double")


@query("SELECT 0.3::DOUBLE AS tx, -0.2::DOUBLE AS ty")
def registration_end(spark, d):
    """Where the registration of a shifted bump ends."""
    end = QUERIES["registration_fit"](spark, d).orderBy(F.col("iteration").desc()).limit(1)
    return end.select(F.round("tx", 3).alias("tx"), F.round("ty", 3).alias("ty"))


@query("SELECT c AS chain_id, s AS step, true AS accepted, 'Identity' AS generated_by, round(-0.5 * 4 / 9 - ln(3 * sqrt(2 * pi())), 6) AS logp FROM (SELECT unnest(range(0, 4)) AS c), (SELECT unnest(range(0, 30, 5)) AS s)")
def identity_chains(spark, d):
    """Chains that propose to stay: every state is accepted and has the start's density."""
    out = mcmc.chains(spark, mcmc.identity(), mcmc.gaussian_evaluator(1.0, 3.0), [3.0], 4, 10, 30, 5)
    return out.select("chain_id", "step", "accepted", "generated_by", r("logp").alias("logp"))


@query("SELECT event_id, round(-0.5 * (value - 50) * (value - 50) / 400 - ln(20 * sqrt(2 * pi())) - 0.5 * (x - 12) * (x - 12) / 36 - ln(6 * sqrt(2 * pi())), 6) AS logp FROM (SELECT event_id, value, hour(ts) + minute(ts) / 60.0::DOUBLE AS x FROM events WHERE value IS NOT NULL)")
def product_density(spark, d):
    """Log density of a product of two evaluators at every event."""
    from shapelake.plans.fitting import pair_evaluator

    f = pair_evaluator(mcmc.gaussian_evaluator(50.0, 20.0), mcmc.gaussian_evaluator(12.0, 6.0), 1)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(logp=[f(np.array([v, x])) for v, x in zip(pdf["value"], pdf["x"])])[["event_id", "logp"]]

    rows = _times(spark, d).join(t(spark, d, "events").select("event_id", "value"), "event_id").filter("value IS NOT NULL").select("event_id", "value", "x")
    return rows.mapInPandas(run, "event_id long, logp double").select("event_id", r("logp").alias("logp"))


# --- searches, profiles, samplers and low-rank processes

P3 = "p3 AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
L1 = "list_sum(list_transform(list_zip(a.v, b.v), lambda q: abs(q[1] - q[2])))"


@query(f"WITH {P3} SELECT q_id, p_id, round(d, 6) AS d, k::INT AS rank FROM (SELECT a.vec_id AS q_id, b.vec_id AS p_id, {L1} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {L1}, b.vec_id) AS k FROM p3 a JOIN p3 b ON a.vec_id <> b.vec_id) WHERE k <= 3")
def knn_l1(spark, d):
    """By the sum of absolute differences."""
    from shapelake.operators import spatial as sp

    e = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    near = sp.knn(e.toDF("q_id", "q_vec"), e.toDF("p_id", "p_vec"), 3, exclude_same_id=True, metric="l1")
    return near.select("q_id", "p_id", r("d2").alias("d"), "rank")


LINES = "l AS (SELECT c_custkey AS line_id, c_acctbal / 300 AS ox, (c_custkey % 40) + 0.37::DOUBLE AS oy, -5.0::DOUBLE AS oz, 0.01::DOUBLE AS dx, 0.02::DOUBLE AS dy, 1.0::DOUBLE AS dz FROM customer)"


@query(f"WITH {MESH}, {LINES}, h AS (SELECT *, bx-ax e1x, by_-ay e1y, bz-az e1z, cx-ax e2x, cy-ay e2y, cz-az e2z, ox-ax sx, oy-ay sy, oz-az sz FROM (SELECT cell_id, ax, ay, az, bx, b_y AS by_, bz, cx, cy, cz FROM tri), l), "
       "k AS (SELECT *, dy*e2z-dz*e2y hx, dz*e2x-dx*e2z hy, dx*e2y-dy*e2x hz, sy*e1z-sz*e1y qx, sz*e1x-sx*e1z qy, sx*e1y-sy*e1x qz FROM h), "
       "m AS (SELECT *, e1x*hx+e1y*hy+e1z*hz AS det FROM k), "
       "n AS (SELECT line_id, (sx*hx+sy*hy+sz*hz)/det AS u, (dx*qx+dy*qy+dz*qz)/det AS v FROM m WHERE abs(det) > 1e-12) "
       "SELECT line_id, line_id IN (SELECT line_id FROM n WHERE u >= 0 AND v >= 0 AND u + v <= 1) AS hit FROM l")  # fmt: skip
def lines_that_hit(spark, d):
    """Whether each customer's line meets the surface."""
    i = F.col("c_custkey")
    lines = t(spark, d, "customer").select(i.alias("line_id"), (F.col("c_acctbal") / 300).alias("ox"), (i % 40 + 0.37).alias("oy"), F.lit(-5.0).alias("oz"), F.lit(0.01).alias("dx"), F.lit(0.02).alias("dy"), F.lit(1.0).alias("dz"))
    return vo.has_intersection(part_mesh(spark, d), lines)


@query(f"WITH {MESH}, q AS (SELECT c_custkey AS q_id, c_acctbal / 250 AS x, (c_custkey % 5)::DOUBLE AS y, (c_custkey % 6) + 0.1::DOUBLE AS z FROM customer), n AS (SELECT q_id, arg_min(point_id, (d2, point_id)) AS point_id FROM (SELECT q_id, point_id, (q.x-v.x)*(q.x-v.x)+(q.y-v.y)*(q.y-v.y)+(q.z-v.z)*(q.z-v.z) AS d2 FROM q, pts v) GROUP BY q_id) SELECT q_id, round(x + 1, 6) AS x, round(y * 2, 6) AS y, round(z - point_id % 3, 6) AS z FROM n JOIN pts USING (point_id)")
def shape_as_transformation(spark, d):
    """Points go where the nearest vertex of the reference goes."""
    i, m = F.col("c_custkey"), part_mesh(spark, d).points.select("point_id", *XYZ)
    moved = m.select("point_id", (F.col("x") + 1).alias("x"), (F.col("y") * 2).alias("y"), (F.col("z") - F.col("point_id") % 3).alias("z"))
    q = t(spark, d, "customer").select(i.alias("q_id"), (F.col("c_acctbal") / 250).alias("x"), (i % 5).cast("double").alias("y"), (i % 6 + 0.1).alias("z"))
    return discrete.mesh_to_transformation(m, moved, q, 1.0).select("q_id", *[r(c).alias(c) for c in XYZ])


@query("SELECT vec_id AS item_id, 0.0::DOUBLE AS error FROM embeddings")
def members_project_to_themselves(spark, d):
    """The model of full rank holds every shape it was made of."""
    shapes = _shapes(spark, d)
    errors = pdm.projection_errors(pdm.pca_model(_reference(shapes), shapes), shapes)
    return errors.select("item_id", (F.round("error", 2) + 0).alias("error"))


NORMALS = "v AS (SELECT point_id, avg(nx) AS x, avg(ny) AS y, avg(nz) AS z FROM corner JOIN nrm USING (cell_id) GROUP BY point_id), vn AS (SELECT point_id, x / sqrt(x*x+y*y+z*z) AS nx, y / sqrt(x*x+y*y+z*z) AS ny, z / sqrt(x*x+y*y+z*z) AS nz FROM v)"


@query(f"WITH {MESH}, {NORMALS}, o AS (SELECT unnest(range(0, 5)) AS k) SELECT point_id, k::INT AS k, round(2 * (x + (k - 2) * 0.5 * nx) - (y + (k - 2) * 0.5 * ny) + 3 * (z + (k - 2) * 0.5 * nz), 6) + 0 AS intensity, round(CASE WHEN abs(2 * nx - ny + 3 * nz) > 1e-9 THEN sign(2 * nx - ny + 3 * nz) / 5 ELSE 0 END, 6) + 0 AS feature FROM pts JOIN vn USING (point_id), o WHERE abs(2 * nx - ny + 3 * nz) > 1e-6")
def normal_profiles(spark, d):
    """Profiles along the normals in a linear image: intensities, and differences over their sum."""
    from shapelake.plans import asm

    m = part_mesh(spark, d)
    rows = m.points.select("point_id", *XYZ).join(m.vertex_normals(), "point_id")
    image = lambda x: 2 * x[:, 0] - x[:, 1] + 3 * x[:, 2]
    offsets = asm.offsets_of(5, 0.5)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                p, n = pdf[list(XYZ)].to_numpy(float), pdf[["nx", "ny", "nz"]].to_numpy(float)
                yield pdf[["point_id"]].assign(i=list(asm.profile_features(image, p, n, offsets, False)), f=list(asm.profile_features(image, p, n, offsets)))

    slope = F.abs(2 * F.col("nx") - F.col("ny") + 3 * F.col("nz")) > 1e-6
    made = rows.filter(slope).mapInPandas(run, "point_id long, i array<double>, f array<double>")
    return made.select("point_id", F.posexplode(F.arrays_zip("i", "f")).alias("k", "x")).select("point_id", "k", (r("x.i") + 0).alias("intensity"), (r("x.f") + 0).alias("feature"))


@query("WITH im AS (SELECT p_partkey AS v, p_partkey % 40 AS x, p_partkey // 40 AS y, p_size::DOUBLE AS s FROM part), g AS (SELECT v, (coalesce(lead(s) OVER a, s) - coalesce(lag(s) OVER a, s)) / greatest((lead(s) OVER a IS NOT NULL)::INT + (lag(s) OVER a IS NOT NULL)::INT, 1) AS gx, (coalesce(lead(s) OVER b, s) - coalesce(lag(s) OVER b, s)) / greatest((lead(s) OVER b IS NOT NULL)::INT + (lag(s) OVER b IS NOT NULL)::INT, 1) AS gy FROM im WINDOW a AS (PARTITION BY y ORDER BY x), b AS (PARTITION BY x ORDER BY y)) SELECT v AS voxel_id, round(sqrt(gx * gx + gy * gy), 6) AS value FROM g")
def image_gradient_magnitude(spark, d):
    """The preprocessing of an image for a fit."""
    from shapelake.plans import asm

    return asm.gradient_magnitude(_image(spark, d), grid_of(spark, d, (40,)), 2).select("voxel_id", r("value").alias("value"))


@query("WITH n AS (SELECT (max(p_partkey) + 40) // 40 AS n FROM part) SELECT p_partkey AS sample_id, (p_partkey % 40 * 0.5)::DOUBLE AS x, (p_partkey // 40 * 2.0)::DOUBLE AS y, round(1 / (40 * 0.5 * n * 2.0), 9)::DOUBLE AS density FROM part, n")
def grid_sampler(spark, d):
    from shapelake.operators import samplers

    return samplers.on_grid(spark, grid_of(spark, d, (40,), (0.5, 2.0))).select("sample_id", "x", "y", F.round("density", 9).alias("density"))


@query("SELECT event_id, round(4 * s / (25 + 4 * n), 6) AS mean FROM events, (SELECT sum(value) AS s, count(value) AS n FROM events)")
def low_rank_regression(spark, d):
    """A constant of variance 4, learned from the values of all events with noise 25."""
    one = gp.LowRank(lambda x: np.zeros((len(x), 1)), np.array([4.0]), lambda x: np.ones((len(x), 1)), 1)
    rows = _times(spark, d).join(t(spark, d, "events").select("event_id", "value"), "event_id")
    return gp.table_regression(one, rows, ["x"], "value", 25.0, "event_id").select("event_id", r("mean").alias("mean"))


@query("WITH h AS (SELECT hour(ts) AS h, avg(value) AS y FROM events GROUP BY 1), m AS (SELECT count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM h) SELECT round(-0.5 * (q / 25 - 4 * s * s / (25 * (25 + 4 * n))) - 0.5 * ((n - 1) * ln(25) + ln(25 + 4 * n)) - 0.5 * n * ln(2 * pi()), 4) AS likelihood FROM m")
def low_rank_likelihood(spark, d):
    """Of the same constant, given the mean values of the hours."""
    one = gp.LowRank(lambda x: np.zeros((len(x), 1)), np.array([4.0]), lambda x: np.ones((len(x), 1)), 1)
    h = t(spark, d, "events").groupBy(F.hour("ts").alias("h")).agg(F.avg("value").alias("y")).toPandas()
    return spark.createDataFrame([(round(one.marginal_likelihood(h[["h"]].to_numpy(float), h[["y"]].to_numpy(float), 25.0), 4),)], "likelihood double")


__all__ = ["QUERIES", "SQL"]
