"""Queries for the driver over the TPC-H-like tables: point sets, fields, meshes and models made of their columns.

P1: lineitem (quantity, 100 * discount, 100 * tax) as 3-D points; P2: events (value over time) as a 1-D field;
P3: embeddings as 64-D points, label as shape; the mesh of `part`: vertex i at (i % 40, i div 40, p_size / 10), two
triangles for each square of neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapelake.functions import barycentric as bc
from shapelake.functions import scalar as sc
from shapelake.functions import transform as tf
from shapelake.functions.color import RGB, RGBA
from shapelake.functions.vector import Mat, Vec
from shapelake.operators import grid as gr
from shapelake.operators import spatial as sp
from shapelake.operators import stats as st
from shapelake.operators.field import DifferentiableField, Box, Domain, Field, half_space, unvectorize, vectorize
from shapelake.operators.mesh import Mesh, numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WIDTH = 40


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, places: int = 6):
    return F.round(c, places)


def p1(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))


P1 = "p1 AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem)"


def p3(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


P3 = "p3 AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
D2 = "list_sum(list_transform(list_zip(a.v, b.v), lambda q: (q[1] - q[2]) * (q[1] - q[2])))"


def part_mesh(spark, d) -> Mesh:
    i = F.col("p_partkey")
    rows = t(spark, d, "part").select(i.alias("point_id"), (i % WIDTH).cast("double").alias("x"), F.floor(i / WIDTH).cast("double").alias("y"), (F.col("p_size") / 10.0).alias("z"), F.col("p_retailprice").alias("value"))
    n = rows.agg(F.max("point_id").alias("top"))
    base = rows.select(F.col("point_id").alias("i")).crossJoin(F.broadcast(n)).filter((F.col("i") % WIDTH < WIDTH - 1) & (F.col("i") + WIDTH + 1 <= F.col("top")))
    at = lambda k: F.col("i") + k
    two = F.explode(F.array(F.struct((F.col("i") * 2).alias("cell_id"), F.array(at(0), at(1), at(WIDTH)).alias("pids")), F.struct((F.col("i") * 2 + 1).alias("cell_id"), F.array(at(1), at(WIDTH + 1), at(WIDTH)).alias("pids"))))
    return Mesh(rows, base.select(two.alias("c")).select("c.*"))


MESH = f"""pts AS (SELECT p_partkey AS point_id, (p_partkey % {WIDTH})::DOUBLE AS x, (p_partkey // {WIDTH})::DOUBLE AS y, p_size / 10.0 AS z, p_retailprice AS value FROM part),
base AS (SELECT point_id AS i FROM pts WHERE point_id % {WIDTH} < {WIDTH - 1} AND point_id + {WIDTH + 1} <= (SELECT max(point_id) FROM pts)),
cells AS (SELECT i * 2 AS cell_id, [i, i + 1, i + {WIDTH}] AS pids FROM base UNION ALL SELECT i * 2 + 1, [i + 1, i + {WIDTH + 1}, i + {WIDTH}] FROM base),
corner AS (SELECT cell_id, unnest(range(0, 3)) AS k, unnest(pids) AS point_id FROM cells),
tri AS (SELECT cell_id, pids, a.x ax, a.y ay, a.z az, b.x bx, b.y b_y, b.z bz, c.x cx, c.y cy, c.z cz FROM cells JOIN pts a ON a.point_id = pids[1] JOIN pts b ON b.point_id = pids[2] JOIN pts c ON c.point_id = pids[3]),
nrm0 AS (SELECT *, (b_y-ay)*(cz-az)-(bz-az)*(cy-ay) AS ux, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS uy, (bx-ax)*(cy-ay)-(b_y-ay)*(cx-ax) AS uz FROM tri),
nrm AS (SELECT cell_id, pids, ux/sqrt(ux*ux+uy*uy+uz*uz) AS nx, uy/sqrt(ux*ux+uy*uy+uz*uz) AS ny, uz/sqrt(ux*ux+uy*uy+uz*uz) AS nz FROM nrm0),
ap AS (SELECT DISTINCT a.point_id, b.point_id AS neighbour FROM corner a JOIN corner b USING (cell_id) WHERE a.point_id <> b.point_id),
edges AS (SELECT cell_id, list_sort([pids[j[1]], pids[j[2]]]) AS facet FROM cells, (SELECT unnest([[1, 2], [1, 3], [2, 3]]) AS j)),
bnd AS (SELECT facet FROM edges GROUP BY facet HAVING count(*) % 2 = 1)"""


def tet_mesh(spark, d) -> Mesh:
    """Tetrahedra over the mesh's lower triangles with the vertex two rows on as the tip."""
    m = part_mesh(spark, d)
    top = m.points.agg(F.max("point_id").alias("top"))
    cells = m.cells.filter("cell_id % 2 = 0").crossJoin(F.broadcast(top)).withColumn("tip", F.element_at("pids", 1) + 2 * WIDTH + 1).filter("tip <= top")
    return Mesh(m.points, cells.select("cell_id", F.concat("pids", F.array("tip")).alias("pids")), 4)


TET = MESH + f""", tets AS (SELECT cell_id, list_append(pids, pids[1] + {2 * WIDTH + 1}) AS pids FROM cells WHERE cell_id % 2 = 0 AND pids[1] + {2 * WIDTH + 1} <= (SELECT max(point_id) FROM pts)),
tc AS (SELECT cell_id, t.pids, a.x ax, a.y ay, a.z az, b.x bx, b.y b_y, b.z bz, c.x cx, c.y cy, c.z cz, d.x dx, d.y dy, d.z dz
       FROM tets t JOIN pts a ON a.point_id = pids[1] JOIN pts b ON b.point_id = pids[2] JOIN pts c ON c.point_id = pids[3] JOIN pts d ON d.point_id = pids[4]),
tv AS (SELECT *, ((bx-ax)*((cy-ay)*(dz-az)-(cz-az)*(dy-ay)) + (b_y-ay)*((cz-az)*(dx-ax)-(cx-ax)*(dz-az)) + (bz-az)*((cx-ax)*(dy-ay)-(cy-ay)*(dx-ax))) / 6 AS vol FROM tc)"""


# --- joins


def _nn(spark, d, k):
    e = p3(spark, d)
    return sp.knn(e.select(F.col("vec_id").alias("q_id"), F.col("v").alias("q_vec")), e.select(F.col("vec_id").alias("p_id"), F.col("v").alias("p_vec")), k, exclude_same_id=True)


@query(f"WITH {P3} SELECT q_id, p_id, round(d2, 6) AS d2 FROM (SELECT a.vec_id AS q_id, b.vec_id AS p_id, {D2} AS d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY {D2}, b.vec_id) AS k FROM p3 a JOIN p3 b ON a.vec_id <> b.vec_id) WHERE k = 1")
def nn_1(spark, d):
    return _nn(spark, d, 1).select("q_id", "p_id", r("d2").alias("d2"))


@query(f"WITH {P3} SELECT q_id, p_id, round(d2, 6) AS d2, k::INT AS rank FROM (SELECT a.vec_id AS q_id, b.vec_id AS p_id, {D2} AS d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY {D2}, b.vec_id) AS k FROM p3 a JOIN p3 b ON a.vec_id <> b.vec_id) WHERE k <= 5")
def knn_k(spark, d):
    return _nn(spark, d, 5).select("q_id", "p_id", r("d2").alias("d2"), "rank")


@query(f"WITH {P3} SELECT a.vec_id AS q_id, b.vec_id AS p_id, round({D2}, 6) AS d2 FROM p3 a JOIN p3 b ON a.vec_id <> b.vec_id WHERE sqrt({D2}) <= 1.05")
def eps_range(spark, d):
    e = p3(spark, d)
    near = sp.eps_vectors(e.select(F.col("vec_id").alias("q_id"), F.col("v").alias("q_vec")), e.select(F.col("vec_id").alias("p_id"), F.col("v").alias("p_vec")), 1.05, exclude_same_id=True)
    return near.select("q_id", "p_id", r("d2").alias("d2"))


def _labels(spark, d, a, b):
    e = p3(spark, d)
    pick = lambda k, i, v: e.filter(F.col("label") == k).select(F.col("vec_id").alias(i), F.col("v").alias(v))
    return sp.knn(pick(a, "q_id", "q_vec"), pick(b, "p_id", "p_vec"), 1)


ONE = f"(SELECT min({D2}) AS d2 FROM p3 a, p3 b WHERE a.label = {{0}} AND b.label = {{1}} GROUP BY a.vec_id)"


@query(f"WITH {P3} SELECT round(max(sqrt(d2)), 6) AS hausdorff FROM (SELECT * FROM {ONE.format(0, 1)} UNION ALL SELECT * FROM {ONE.format(1, 0)})")
def metric_hausdorff(spark, d):
    return _labels(spark, d, 0, 1).unionByName(_labels(spark, d, 1, 0)).agg(r(F.max(F.sqrt("d2"))).alias("hausdorff"))


@query(f"WITH {P3} SELECT round(avg(sqrt(d2)), 6) AS avg_distance FROM {ONE.format(0, 1)}")
def metric_avg_distance(spark, d):
    return _labels(spark, d, 0, 1).agg(r(F.avg(F.sqrt("d2"))).alias("avg_distance"))


@query(f"WITH {P1}, q AS (SELECT c_custkey AS q_id, c_acctbal / 200 AS x, (c_custkey % 11)::DOUBLE AS y, (c_custkey % 9)::DOUBLE AS z FROM customer WHERE c_custkey % 50 = 0), p AS (SELECT l_orderkey * 8 + l_linenumber AS p_id, x, y, z FROM p1) SELECT q_id, p_id, round(d2, 6) AS d2 FROM (SELECT q_id, p_id, (q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)+(q.z-p.z)*(q.z-p.z) AS d2 FROM q, p) WHERE sqrt(d2) <= 0.4999")
def eps_grid_join(spark, d):
    q = t(spark, d, "customer").filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("q_id"), (F.col("c_acctbal") / 200).alias("x"), (F.col("c_custkey") % 11).cast("double").alias("y"), (F.col("c_custkey") % 9).cast("double").alias("z"))
    p = p1(spark, d).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("p_id"), "x", "y", "z")
    return sp.eps_join(q, p, 0.4999).select("q_id", "p_id", r("d2").alias("d2"))


@query("WITH q AS (SELECT c_custkey AS q_id, c_acctbal / 250 AS x, c_custkey / 37.0 AS y FROM customer), p AS (SELECT p_partkey AS p_id, (p_partkey % 40)::DOUBLE AS x, p_size::DOUBLE AS y FROM part) SELECT q_id, arg_min(p_id, (d2, p_id)) AS p_id, round(min(d2), 6) AS d2 FROM (SELECT q_id, p_id, (q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y) AS d2 FROM q, p) GROUP BY q_id")
def nearest_2d(spark, d):
    q = t(spark, d, "customer").select(F.col("c_custkey").alias("q_id"), (F.col("c_acctbal") / 250).alias("x"), (F.col("c_custkey") / 37.0).alias("y"))
    p = t(spark, d, "part").select(F.col("p_partkey").alias("p_id"), (F.col("p_partkey") % 40).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"))
    return sp.nearest(q, p, 1.0, ("x", "y")).select("q_id", "p_id", r("d2").alias("d2"))


@query("SELECT c_custkey, o_orderkey, o_orderpriority FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def landmark_match(spark, d):
    """Landmarks with the same id in two sets, the first match of each."""
    first = t(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderkey", "o_orderpriority")).alias("m"))
    return t(spark, d, "customer").join(first, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "m.o_orderkey", "m.o_orderpriority")


@query("SELECT event_id, (props->>'k')::BIGINT AS k, props->>'missing' AS missing FROM events")
def landmark_parse_json(spark, d):
    parsed = F.from_json("props", "k BIGINT, missing STRING")
    return t(spark, d, "events").select("event_id", parsed["k"].alias("k"), parsed["missing"].alias("missing"))


@query(f"WITH {P1}, s AS (SELECT DISTINCT x, y, z FROM p1 WHERE l_orderkey % 50 = 0) SELECT l_orderkey, l_linenumber FROM p1 WHERE EXISTS (SELECT 1 FROM s WHERE s.x = p1.x AND s.y = p1.y AND s.z = p1.z)")
def point_lookup(spark, d):
    p = p1(spark, d)
    return sp.exact_point(p, p.filter("l_orderkey % 50 = 0"), ("x", "y", "z")).select("l_orderkey", "l_linenumber")


# --- filters


@query(f"WITH {P1} SELECT l_orderkey, l_linenumber, x, round(y, 6) AS y FROM p1 WHERE x BETWEEN 10 AND 20 AND l_orderkey BETWEEN 100 AND 9000")
def box_region(spark, d):
    p = t(spark, d, "lineitem").withColumn("k", F.col("l_orderkey"))
    inside = Box.of((10, 100), (20, 9000)).filter(p, ("l_quantity", "l_orderkey"))
    return inside.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), r(F.col("l_discount") * 100).alias("y"))


A, B = Box.of((10, 0, 0), (30, 5, 8)), Box.of((20, 2, 1), (50, 10, 4))
SQL_A, SQL_B = "(x BETWEEN 10 AND 30 AND y BETWEEN 0 AND 5 AND z BETWEEN 0 AND 8)", "(x BETWEEN 20 AND 50 AND y BETWEEN 2 AND 10 AND z BETWEEN 1 AND 4)"


@query(f"WITH {P1} SELECT l_orderkey, l_linenumber FROM p1 WHERE {SQL_A} OR {SQL_B}")
def domain_union(spark, d):
    return A.union(B).filter(p1(spark, d), ("x", "y", "z")).select("l_orderkey", "l_linenumber")


@query(f"WITH {P1} SELECT l_orderkey, l_linenumber FROM p1 WHERE {SQL_A} AND {SQL_B}")
def domain_intersection(spark, d):
    return A.intersection(B).filter(p1(spark, d), ("x", "y", "z")).select("l_orderkey", "l_linenumber")


@query(f"WITH {P1} SELECT l_orderkey, l_linenumber FROM p1 WHERE x / 2 BETWEEN 10 AND 30 AND y / 2 BETWEEN 0 AND 5 AND z / 2 BETWEEN 0 AND 8")
def domain_warp(spark, d):
    return A.warp(lambda p: p / 2).filter(p1(spark, d), ("x", "y", "z")).select("l_orderkey", "l_linenumber")


@query(f"WITH {P1} SELECT l_orderkey, l_linenumber FROM p1 WHERE (x - 25) * 1.0 + (y - 5) * -2.0 + (z - 4) * 0.5 >= 0")
def half_space_filter(spark, d):
    return half_space((25, 5, 4), (1, -2, 0.5)).filter(p1(spark, d), ("x", "y", "z")).select("l_orderkey", "l_linenumber")


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value)")
def nan_as_missing(spark, d):
    return t(spark, d, "events").filter(F.col("value").isNotNull() & ~F.isnan("value")).select("event_id", "value")


# --- fields over events: time of day in hours


def _time(spark, d):
    s = F.hour("ts") + F.minute("ts") / 60.0
    return t(spark, d, "events").select("event_id", s.alias("x"), "value")


TIME = "e AS (SELECT event_id, hour(ts) + minute(ts) / 60.0::DOUBLE AS x, value FROM events)"
MORNING, DAY = Box.of((6.0,), (14.0,)), Box.of((9.0,), (18.0,))
WAVE = DifferentiableField(lambda p: F.sin(p[0]), MORNING, lambda p: Vec((F.cos(p[0]),)))
SLOPE = Field(lambda p: p[0] * 2.0 + 1.0, DAY)


@query(f"WITH {TIME} SELECT event_id, CASE WHEN x BETWEEN 9 AND 14 THEN round(sin(x) + (x * 2 + 1), 6) END AS plus, CASE WHEN x BETWEEN 9 AND 14 THEN round(sin(x) - (x * 2 + 1), 6) END AS minus, CASE WHEN x BETWEEN 9 AND 14 THEN round(sin(x) * (x * 2 + 1), 6) END AS times, CASE WHEN x BETWEEN 6 AND 14 THEN round(sin(x) * 3, 6) END AS scaled FROM e")
def field_arith(spark, d):
    p = Vec.of("x")
    return _time(spark, d).select("event_id", r((WAVE + SLOPE)(p)).alias("plus"), r((WAVE - SLOPE)(p)).alias("minus"), r(WAVE.times(SLOPE)(p)).alias("times"), r((WAVE * 3.0)(p)).alias("scaled"))


@query(f"WITH {TIME} SELECT event_id, CASE WHEN x BETWEEN 6 AND 14 THEN round(sin(x), 6) END AS lifted FROM e")
def field_lift(spark, d):
    return _time(spark, d).select("event_id", r(WAVE.lift_values(Vec.of("x"))).alias("lifted"))


@query(f"WITH {TIME} SELECT event_id, round(CASE WHEN x BETWEEN 6 AND 14 THEN sin(x) ELSE -9 END, 6) AS value FROM e")
def field_discretize(spark, d):
    return WAVE.discretize(_time(spark, d).select("event_id", "x"), ("x",), -9.0).select("event_id", r("value").alias("value"))


@query(f"WITH {TIME} SELECT event_id, CASE WHEN x * 0.5 + 4 BETWEEN 6 AND 14 THEN round(sin(x * 0.5 + 4), 6) END AS value, CASE WHEN x * 0.5 + 4 BETWEEN 6 AND 14 THEN round(0.5 * cos(x * 0.5 + 4), 6) END AS slope FROM e")
def field_compose(spark, d):
    move = lambda p: p * 0.5 + Vec.of(4.0)
    inner = WAVE.compose_linear(move, lambda g: g * 0.5)
    return _time(spark, d).select("event_id", r(inner(Vec.of("x"))).alias("value"), r(inner.differentiate(Vec.of("x"))[0]).alias("slope"))


@query(f"WITH {P1} SELECT point_id * 3 + c - 1 AS k, round([x, y, z][c], 6) AS value FROM (SELECT l_orderkey * 8 + l_linenumber AS point_id, x, y, z FROM p1), (SELECT unnest([1, 2, 3]) AS c)")
def field_vectorize(spark, d):
    p = p1(spark, d).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"), "x", "y", "z")
    return vectorize(p, ("x", "y", "z")).select("k", r("value").alias("value"))


@query("SELECT p_partkey AS point_id, p_size::DOUBLE AS x, p_retailprice AS y FROM part")
def field_unvectorize(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return unvectorize(vectorize(p, ("x", "y")), ("x", "y"))


@query("SELECT p_partkey AS point_id, round(p_size + 0.1 * (p_partkey % 7), 6) AS x, round(p_retailprice - (p_partkey % 5), 6) AS y FROM part")
def warp_points(spark, d):
    i = F.col("p_partkey")
    base = t(spark, d, "part")
    points = base.select(i.alias("point_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    moves = base.select(i.alias("point_id"), (0.1 * (i % 7)).alias("x"), (-(i % 5)).cast("double").alias("y"))
    return tf.warp(points, moves, ("x", "y")).select("point_id", r("x").alias("x"), r("y").alias("y"))


# --- aggregations


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS x, round(avg(l_discount), 6) AS y, round(avg(l_tax), 6) AS z FROM lineitem GROUP BY 1")
def center_of_mass(spark, d):
    p = t(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    return st.center_of_mass(p, ("x", "y", "z"), ("l_returnflag",)).select("l_returnflag", *[r(c).alias(c) for c in "xyz"])


BOXED = "min(x) AS min_x, max(x) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z"


@query(f"WITH {P1} SELECT {BOXED} FROM p1")
def bounding_box(spark, d):
    return st.bounding_box(p1(spark, d), ("x", "y", "z")).select("min_x", "max_x", *[r(f"{k}_{n}").alias(f"{k}_{n}") for n in "yz" for k in ("min", "max")])


@query(f"WITH {P1} SELECT round((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 4) AS volume FROM p1")
def box_volume(spark, d):
    return st.bounding_box(p1(spark, d), ("x", "y", "z")).select(r("volume", 4).alias("volume"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_x, round(avg(l_extendedprice), 4) AS mean_y, round(covar_samp(l_quantity, l_quantity), 6) AS cov_x_x, round(covar_samp(l_quantity, l_extendedprice), 2) AS cov_x_y, round(covar_samp(l_extendedprice, l_extendedprice), 0) AS cov_y_y FROM lineitem GROUP BY 1")
def mvn_moments(spark, d):
    p = t(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    places = {"mean_x": 6, "mean_y": 4, "cov_x_x": 6, "cov_x_y": 2, "cov_y_y": 0}
    return st.moments(p, ("x", "y"), ("l_returnflag",)).select("l_returnflag", "n", *[r(c, k).alias(c) for c, k in places.items()])


MVN = "m AS (SELECT avg(l_quantity) AS mx, avg(l_discount) AS my, covar_samp(l_quantity, l_quantity) AS cxx, covar_samp(l_quantity, l_discount) AS cxy, covar_samp(l_discount, l_discount) AS cyy FROM lineitem)"
MAHA = "(cyy * (l_quantity - mx) * (l_quantity - mx) - 2 * cxy * (l_quantity - mx) * (l_discount - my) + cxx * (l_discount - my) * (l_discount - my)) / (cxx * cyy - cxy * cxy)"


def _mvn(spark, d):
    p = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return p.crossJoin(F.broadcast(st.moments(p, ("x", "y"))))


COV = ("cov_x_x", "cov_x_y", "cov_y_y")


@query(f"WITH {MVN} SELECT l_orderkey, l_linenumber, round(-({MAHA}) / 2 - ln(cxx * cyy - cxy * cxy) / 2 - ln(2 * pi()), 6) AS logpdf FROM lineitem, m")
def mvn_logpdf_2d(spark, d):
    value = st.log_pdf_2d(Vec.of("x", "y"), Vec.of("mean_x", "mean_y"), *map(F.col, COV))
    return _mvn(spark, d).select("l_orderkey", "l_linenumber", r(value).alias("logpdf"))


@query(f"WITH {MVN} SELECT l_orderkey, l_linenumber, round(sqrt({MAHA}), 6) AS distance FROM lineitem, m")
def mahalanobis_2d(spark, d):
    value = F.sqrt(st.mahalanobis2_2d(Vec.of("x", "y"), Vec.of("mean_x", "mean_y"), *map(F.col, COV)))
    return _mvn(spark, d).select("l_orderkey", "l_linenumber", r(value).alias("distance"))


@query("WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, covar_samp(l_quantity, l_quantity) AS cxx, covar_samp(l_quantity, l_extendedprice) AS cxy, covar_samp(l_extendedprice, l_extendedprice) AS cyy FROM lineitem) SELECT q, round(my + cxy / cxx * (q - mx), 4) AS mean, round(cyy - cxy * cxy / cxx, 0) AS variance FROM m, (SELECT unnest(range(1, 51))::DOUBLE AS q)")
def mvn_conditional_2d(spark, d):
    """Price given the quantity."""
    p = t(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    q = spark.range(1, 51).select(F.col("id").cast("double").alias("q"))
    slope = F.col("cov_x_y") / F.col("cov_x_x")
    return st.moments(p, ("x", "y")).crossJoin(q).select("q", r(F.col("mean_y") + slope * (F.col("q") - F.col("mean_x")), 4).alias("mean"), r(F.col("cov_y_y") - F.col("cov_x_y") * F.col("cov_x_y") / F.col("cov_x_x"), 0).alias("variance"))


@query(f"WITH {TIME} SELECT round(sum(CASE WHEN x BETWEEN 6 AND 14 THEN sin(x) ELSE 0 END * 24) / count(*), 6) AS integral FROM e")
def integrate_scalar(spark, d):
    return st.integrate_scalar(_time(spark, d), WAVE(Vec.of("x")), F.lit(1 / 24)).select(r("integral").alias("integral"))


@query(f"WITH {TIME} SELECT round(sum(sin(x) * 24) / (count(*) - 1), 6) AS ix, round(sum(x * 24) / (count(*) - 1), 6) AS iy FROM e")
def integrate_vector(spark, d):
    v = Vec((F.sin("x"), F.col("x")))
    return st.integrate_vector(_time(spark, d), v, F.lit(1 / 24), ("ix", "iy")).select(r("ix").alias("ix"), r("iy").alias("iy"))


@query("SELECT round(avg((l_quantity - l_discount * 500) * (l_quantity - l_discount * 500)), 6) AS mean_squares, round(avg(CASE WHEN l_quantity - l_discount * 500 < 1.345 THEN (l_quantity - l_discount * 500) * (l_quantity - l_discount * 500) / 2 ELSE 1.345 * ((l_quantity - l_discount * 500) - 1.345 / 2) END), 6) AS huber FROM lineitem")
def image_losses(spark, d):
    diff = F.col("l_quantity") - F.col("l_discount") * 500
    return t(spark, d, "lineitem").agg(r(st.mean_squares(diff)).alias("mean_squares"), r(st.huber(diff)).alias("huber"))


B3 = "CASE WHEN abs({0}) < 1 THEN 2.0 / 3 - {0} * {0} + 0.5 * abs({0}) * {0} * {0} WHEN abs({0}) < 2 THEN (2 - abs({0})) * (2 - abs({0})) * (2 - abs({0})) / 6 ELSE 0 END"
HIST = f"""b AS (SELECT min(l_quantity) lf, max(l_quantity) hf, min(l_extendedprice) lm, max(l_extendedprice) hm, count(*) n FROM lineitem),
s AS (SELECT floor((l_quantity - lf) / ((hf + 1 - lf) / 30))::BIGINT AS f, (l_extendedprice - lm) / ((hm + 1 - lm) / 30) AS x, n FROM lineitem, b),
w AS (SELECT f, floor(x)::BIGINT + k AS m, x - (floor(x) + k) AS u, n FROM s, (SELECT unnest([-1, 0, 1, 2]) AS k)),
h AS (SELECT f, m, sum(({B3.format('u')}) / n) AS p FROM w WHERE ({B3.format('u')}) > 0 GROUP BY f, m)"""


@query(f"WITH {HIST} SELECT f, m, round(p, 8) AS p FROM h")
def mi_histogram(spark, d):
    return st.joint_histogram(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select("f", "m", r("p", 8).alias("p"))


@query(f"WITH {HIST}, pf AS (SELECT f, sum(p) AS pf FROM h GROUP BY f), pm AS (SELECT m, sum(p) AS pm FROM h GROUP BY m) SELECT round(-sum(p * ln(p / (pf * pm))), 6) AS neg_mi FROM h JOIN pf USING (f) JOIN pm USING (m)")
def mutual_information(spark, d):
    joint = st.joint_histogram(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return st.mutual_information(joint).select(r("neg_mi").alias("neg_mi"))


@query("SELECT event_type, count(*) AS n, round(avg((value > 50)::INT), 6) AS ratio FROM events GROUP BY 1")
def acceptance_ratio(spark, d):
    """Events as a chain: the type made the proposal, values above 50 were accepted."""
    chain = t(spark, d, "events").select(F.col("event_type"), (F.col("value") > 50).alias("accepted"))
    return chain.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("accepted").cast("int"))).alias("ratio"))


@query("SELECT user_id, min(event_id) AS event_id, value FROM events JOIN (SELECT user_id, max(value) AS value FROM events GROUP BY user_id) USING (user_id, value) GROUP BY user_id, value")
def best_sample(spark, d):
    best = t(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("value", (-F.col("event_id")).alias("k"))).alias("m"))
    return best.select("user_id", (-F.col("m.k")).alias("event_id"), "m.value")


@query("SELECT user_id, event_id, step FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events) WHERE step % 10 = 0")
def stepped_log(spark, d):
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return t(spark, d, "events").select("user_id", "event_id", step.cast("long").alias("step")).filter("step % 10 = 0")


@query("SELECT label, k::INT AS k, round(avg(v), 6) AS mean FROM (SELECT label, unnest(range(0, 64)) AS k, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY label, k")
def mean_shape(spark, d):
    rows = p3(spark, d).select("label", F.posexplode("v").alias("k", "x"))
    return rows.groupBy("label", "k").agg(r(F.avg("x")).alias("mean"))


@query("WITH e AS (SELECT vec_id, label, unnest(range(0, 64)) AS k, unnest(embedding::DOUBLE[]) AS v FROM embeddings), m AS (SELECT label, k, avg(v) AS m FROM e GROUP BY label, k) SELECT vec_id, k::INT AS k, round(v - m, 6) AS displacement FROM e JOIN m USING (label, k)")
def displacement_field(spark, d):
    rows = p3(spark, d).select("vec_id", "label", F.posexplode("v").alias("k", "x"))
    mean = rows.groupBy("label", "k").agg(F.avg("x").alias("m"))
    return rows.join(mean, ["label", "k"]).select("vec_id", "k", r(F.col("x") - F.col("m")).alias("displacement"))


@query("WITH m AS (SELECT label, k, avg(v) AS v FROM (SELECT label, unnest(range(0, 64)) AS k, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY label, k) SELECT a.label AS i, b.label AS j, round(sum(a.v * b.v), 6) AS g FROM m a JOIN m b USING (k) GROUP BY 1, 2")
def gram_matrix(spark, d):
    rows = p3(spark, d).select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x"))
    other = rows.toDF("j", "k", "y")
    return rows.join(other, "k").groupBy(F.col("label").alias("i"), "j").agg(r(F.sum(F.col("x") * F.col("y"))).alias("g"))


@query("WITH o AS (SELECT p_partkey, row_number() OVER (ORDER BY ((p_partkey + 5) * 1103515245 + 12345) % 2147483648, p_partkey) - 1 AS o, count(*) OVER () // 7 AS size FROM part) SELECT p_partkey, CASE WHEN o < size * 7 THEN o // size ELSE -1 END AS fold FROM o")
def cv_folds(spark, d):
    items = t(spark, d, "part").select("p_partkey")
    return st.folds(items, "p_partkey", 7, items.count(), 5).withColumn("fold", F.coalesce("fold", F.lit(-1).cast("long")))


# --- kernels and splines


@query("WITH s AS (SELECT DISTINCT p_size::DOUBLE AS x FROM part) SELECT a.x AS x, b.x AS y, round(4 * exp(-(a.x - b.x) * (a.x - b.x) / 100), 8) AS k FROM s a, s b")
def kernel_gauss_matrix(spark, d):
    from shapelake.plans.kernels import gaussian

    s = t(spark, d, "part").select(F.col("p_size").cast("double").alias("x")).distinct()
    return s.crossJoin(s.withColumnRenamed("x", "y")).select("x", "y", r(gaussian(10.0, 2.0).column(Vec.of("x"), Vec.of("y")), 8).alias("k"))


@query("WITH s AS (SELECT DISTINCT p_size::DOUBLE AS x FROM part) SELECT a.x AS x, b.x AS y, round(exp(-(a.x - b.x) * (a.x - b.x) / 100) + 0.25 * exp(-4 * (a.x - b.x) * (a.x - b.x) / 100) + 0.0625 * exp(-16 * (a.x - b.x) * (a.x - b.x) / 100), 8) AS k FROM s a, s b")
def kernel_multiscale(spark, d):
    from shapelake.plans.kernels import gaussian, multiscale

    s = t(spark, d, "part").select(F.col("p_size").cast("double").alias("x")).distinct()
    return s.crossJoin(s.withColumnRenamed("x", "y")).select("x", "y", r(multiscale(gaussian(10.0), 0, 3).column(Vec.of("x"), Vec.of("y")), 8).alias("k"))


@query(f"WITH s AS (SELECT p_partkey, p_size / 10.0 - 2.5 AS x FROM part) SELECT p_partkey, CASE WHEN abs(x) < 0.5 THEN 1.0 WHEN abs(x) = 0.5 THEN 0.5 ELSE 0.0 END::DOUBLE AS b0, round(CASE WHEN abs(x) < 1 THEN 1 - abs(x) ELSE 0 END, 8)::DOUBLE AS b1, round(CASE WHEN abs(x) < 0.5 THEN 0.75 - x * x WHEN abs(x) < 1.5 THEN 0.5 * (1.5 - abs(x)) * (1.5 - abs(x)) ELSE 0 END, 8)::DOUBLE AS b2, round({B3.format('x')}, 8)::DOUBLE AS b3 FROM s")
def bspline_basis(spark, d):
    x = F.col("p_size") / 10.0 - 2.5
    return t(spark, d, "part").select("p_partkey", sc.bspline(x, 0).alias("b0"), *[r(sc.bspline(x, k), 8).alias(f"b{k}") for k in (1, 2, 3)])


# --- grids and interpolation

GRID = gr.Grid((1.0, -2.0, 0.5), (0.5, 2.0, 1.5), (10, 10, 20))


@query("SELECT p_partkey, p_partkey % 10 AS i, p_partkey // 10 % 10 AS j, p_partkey // 100 % 20 AS k, 1 + 0.5 * (p_partkey % 10)::DOUBLE AS x, -2 + 2.0::DOUBLE * (p_partkey // 10 % 10) AS y, 0.5 + 1.5::DOUBLE * (p_partkey // 100 % 20) AS z FROM part")
def grid_index(spark, d):
    i, j, k = GRID.index(F.col("p_partkey"))
    return t(spark, d, "part").select("p_partkey", i.alias("i"), j.alias("j"), k.alias("k"), *GRID.point([i, j, k]).columns("x", "y", "z"))


@query("WITH q AS (SELECT p_partkey, p_size / 9.0 AS x, p_partkey / 100.0 AS y, p_retailprice / 100 AS z FROM part) SELECT p_partkey, least(greatest(floor((x - 1) / 0.5 + 0.5), 0), 9)::BIGINT + 10 * least(greatest(floor((y + 2) / 2 + 0.5), 0), 9)::BIGINT + 100 * least(greatest(floor((z - 0.5) / 1.5 + 0.5), 0), 19)::BIGINT AS voxel_id FROM q")
def grid_nearest(spark, d):
    q = t(spark, d, "part").select("p_partkey", (F.col("p_size") / 9.0).alias("x"), (F.col("p_partkey") / 100.0).alias("y"), (F.col("p_retailprice") / 100).alias("z"))
    return q.select("p_partkey", GRID.voxel_id(GRID.nearest_index(Vec.of("x", "y", "z"))).alias("voxel_id"))


def _image(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("voxel_id"), F.col("p_size").cast("double").alias("value"))


def grid_of(spark, d, width: tuple[int, ...], spacing: tuple[float, ...] | None = None) -> gr.Grid:
    """The grid whose voxels are the rows of `part`: given sizes along the first axes, as many as it takes along the last."""
    n = t(spark, d, "part").agg(F.coalesce(F.max("p_partkey"), F.lit(0)) + 1).first()[0]
    step = 1
    for w in width:
        step *= w
    return gr.Grid((0.0,) * (len(width) + 1), spacing or (1.0,) * (len(width) + 1), (*width, max(-(-n // step), 1)))


def last(step: int) -> str:
    """SQL for the size of that grid's last axis."""
    return f"(SELECT (max(p_partkey) + {step}) // {step} FROM part)"


IMAGE = "im AS (SELECT p_partkey AS v, p_size::DOUBLE AS s FROM part)"


@query(f"WITH {IMAGE}, n AS (SELECT {last(1)} AS n), q AS (SELECT c_custkey AS q_id, c_acctbal / 10000 * n AS c, n FROM customer, n) SELECT q_id, round((1 - (c - floor(c))) * a.s + (c - floor(c)) * b.s, 6) AS value FROM q JOIN im a ON a.v = least(greatest(floor(c), 0), n - 1)::BIGINT JOIN im b ON b.v = least(greatest(floor(c) + 1, 0), n - 1)::BIGINT")
def linear_interp_1d(spark, d):
    grid = grid_of(spark, d, ())
    q = t(spark, d, "customer").select(F.col("c_custkey").alias("q_id"), (F.col("c_acctbal") / 10000 * grid.size[0]).alias("x"))
    return gr.interpolate(q, _image(spark, d), grid, ("x",)).select("q_id", r("value").alias("value"))


def _taps_sql(width: tuple[int, ...]) -> str:
    """Multilinear interpolation with clamped taps, unit spacing and origin 0; q has n, the size of the last axis."""
    ids, step, dim = [], 1, len(width) + 1
    for k in range(dim):
        ids.append(f"least(greatest(floor(c{k})::BIGINT + t{k}, 0), {width[k] if k < dim - 1 else 'n'} - 1) * {step}")
        step *= width[k] if k < dim - 1 else 1
    w = " * ".join(f"CASE WHEN t{k} = 0 THEN 1 - (c{k} - floor(c{k})) ELSE c{k} - floor(c{k}) END" for k in range(dim))
    taps = ", ".join(f"(SELECT unnest([0, 1]) AS t{k})" for k in range(dim))
    return f"SELECT q_id, round(sum(w * im.s), 6) AS value FROM (SELECT q_id, {' + '.join(ids)} AS v, {w} AS w FROM q, {taps}) JOIN im USING (v) GROUP BY q_id"


@query(f"WITH {IMAGE}, n AS (SELECT {last(40)} AS n), q AS (SELECT c_custkey AS q_id, c_acctbal / 250 AS c0, (c_custkey % 97) / 97.0::DOUBLE * n AS c1, n FROM customer, n) " + _taps_sql((40,)))
def linear_interp_2d(spark, d):
    grid = grid_of(spark, d, (40,))
    q = t(spark, d, "customer").select(F.col("c_custkey").alias("q_id"), (F.col("c_acctbal") / 250).alias("x"), ((F.col("c_custkey") % 97) / 97.0 * grid.size[1]).alias("y"))
    return gr.interpolate(q, _image(spark, d), grid, ("x", "y")).select("q_id", r("value").alias("value"))


@query(f"WITH {IMAGE}, n AS (SELECT {last(40)} AS n), q AS (SELECT c_custkey AS q_id, c_acctbal / 2500 AS c0, (c_custkey % 97) / 12.3 AS c1, (c_custkey % 89) / 89.0::DOUBLE * n AS c2, n FROM customer, n) " + _taps_sql((5, 8)))
def linear_interp_3d(spark, d):
    grid = grid_of(spark, d, (5, 8))
    q = t(spark, d, "customer").select(F.col("c_custkey").alias("q_id"), (F.col("c_acctbal") / 2500).alias("x"), ((F.col("c_custkey") % 97) / 12.3).alias("y"), ((F.col("c_custkey") % 89) / 89.0 * grid.size[2]).alias("z"))
    return gr.interpolate(q, _image(spark, d), grid, ("x", "y", "z")).select("q_id", r("value").alias("value"))


@query(f"WITH {IMAGE}, n AS (SELECT {last(40)} AS n), q AS (SELECT i AS q_id, (i % 79) * 0.5 AS c0, (i // 79) * 0.5 AS c1, n FROM n, (SELECT unnest(range(0, 79 * (2 * {last(40)} - 1))) AS i)) " + _taps_sql((40,)))
def resample(spark, d):
    """The image of `part` on a grid twice as fine."""
    grid = grid_of(spark, d, (40,))
    fine = gr.Grid((0.0, 0.0), (0.5, 0.5), tuple(2 * n - 1 for n in grid.size)).points(spark)
    return gr.interpolate(fine, _image(spark, d), grid, ("x", "y"), "voxel_id").select("q_id", r("value").alias("value"))


# --- meshes


@query(f"WITH {MESH} SELECT cell_id, round(sqrt(ux*ux+uy*uy+uz*uz) / 2, 6) AS area FROM nrm0")
def tri_area(spark, d):
    return part_mesh(spark, d).measures().select("cell_id", r("measure").alias("area"))


@query(f"WITH {MESH} SELECT cell_id, round(nx, 6) + 0 AS nx, round(ny, 6) + 0 AS ny, round(nz, 6) + 0 AS nz FROM nrm")
def cell_normals(spark, d):
    return part_mesh(spark, d).cell_normals().select("cell_id", *[(r(c) + 0).alias(c) for c in ("nx", "ny", "nz")])


@query(f"WITH {MESH}, v AS (SELECT point_id, avg(nx) AS x, avg(ny) AS y, avg(nz) AS z FROM corner JOIN nrm USING (cell_id) GROUP BY point_id) SELECT point_id, round(x / sqrt(x*x+y*y+z*z), 6) AS nx, round(y / sqrt(x*x+y*y+z*z), 6) AS ny, round(z / sqrt(x*x+y*y+z*z), 6) AS nz FROM v")
def vertex_normals(spark, d):
    return part_mesh(spark, d).vertex_normals().select("point_id", *[r(c).alias(c) for c in ("nx", "ny", "nz")])


@query(f"WITH {MESH} SELECT point_id, neighbour FROM ap")
def adjacent_points(spark, d):
    return part_mesh(spark, d).adjacent_points()


@query(f"WITH {MESH} SELECT DISTINCT a.cell_id, b.cell_id AS neighbour FROM corner a JOIN corner b USING (point_id) WHERE a.cell_id <> b.cell_id")
def adjacent_cells(spark, d):
    return part_mesh(spark, d).adjacent_cells()


@query(f"WITH {MESH} SELECT DISTINCT cell_id, neighbour FROM corner JOIN ap USING (point_id) WHERE NOT EXISTS (SELECT 1 FROM corner o WHERE o.cell_id = corner.cell_id AND o.point_id = neighbour)")
def adjacent_points_of_cells(spark, d):
    return part_mesh(spark, d).adjacent_points_of_cells()


@query(f"WITH {MESH} SELECT facet[1] AS a, facet[2] AS b FROM bnd")
def boundary_edges(spark, d):
    return part_mesh(spark, d).boundary_facets().select(F.element_at("facet", 1).alias("a"), F.element_at("facet", 2).alias("b"))


@query(f"WITH {MESH} SELECT DISTINCT unnest(facet) AS point_id FROM bnd")
def boundary_points(spark, d):
    return part_mesh(spark, d).boundary_points()


@query(f"WITH {MESH} SELECT DISTINCT cell_id FROM edges JOIN bnd USING (facet)")
def boundary_cells(spark, d):
    return part_mesh(spark, d).boundary_cells()


KEPT = "kept AS (SELECT point_id FROM pts WHERE NOT (z > 4.5)), kc AS (SELECT cell_id, pids FROM cells WHERE pids[1] IN (SELECT point_id FROM kept) AND pids[2] IN (SELECT point_id FROM kept) AND pids[3] IN (SELECT point_id FROM kept))"


@query(f"WITH {MESH}, {KEPT} SELECT cell_id, pids[1] AS a, pids[2] AS b, pids[3] AS c FROM kc")
def mesh_clip(spark, d):
    return part_mesh(spark, d).clip(F.col("z") > 4.5).cells.select("cell_id", *[F.element_at("pids", k + 1).alias(n) for k, n in enumerate("abc")])


@query(f"WITH {MESH}, {KEPT}, used AS (SELECT point_id, row_number() OVER (ORDER BY point_id) - 1 AS n FROM (SELECT DISTINCT unnest(pids) AS point_id FROM kc)) SELECT cell_id, x.n AS a, y.n AS b, z.n AS c FROM kc JOIN used x ON x.point_id = pids[1] JOIN used y ON y.point_id = pids[2] JOIN used z ON z.point_id = pids[3]")
def mesh_compact(spark, d):
    compact, _ = part_mesh(spark, d).clip(F.col("z") > 4.5).compact()
    return compact.cells.select("cell_id", *[F.element_at("pids", k + 1).alias(n) for k, n in enumerate("abc")])


@query(f"WITH {MESH} SELECT cell_id, pids[1] AS a FROM cells UNION ALL SELECT cell_id + (SELECT max(cell_id) + 1 FROM cells), pids[1] + (SELECT max(point_id) + 1 FROM pts) FROM cells")
def mesh_join(spark, d):
    m = part_mesh(spark, d)
    return m.join(m).cells.select("cell_id", F.element_at("pids", 1).alias("a"))


@query(f"WITH {MESH}, k AS (SELECT point_id FROM pts WHERE (x - 20) * 1.0 + (y - 2) * 1.0 + (z - 2) * 0.5 >= 0) SELECT cell_id FROM cells WHERE pids[1] IN (FROM k) AND pids[2] IN (FROM k) AND pids[3] IN (FROM k)")
def mask_plane(spark, d):
    return part_mesh(spark, d).mask_with_plane((20, 2, 2), (1, 1, 0.5)).cells.select("cell_id")


@query(f"WITH {MESH} SELECT point_id, round(avg(value), 6) AS value FROM corner JOIN (SELECT cell_id, (cell_id % 13)::DOUBLE AS value FROM cells) USING (cell_id) GROUP BY point_id")
def averaged_point_property(spark, d):
    m = part_mesh(spark, d)
    values = m.cells.select("cell_id", (F.col("cell_id") % 13).cast("double").alias("value"))
    return m.averaged_point_property(values).select("point_id", r("value").alias("value"))


@query(f"WITH {MESH} SELECT cell_id, round(avg(value), 6) AS value FROM corner JOIN pts USING (point_id) GROUP BY cell_id")
def averaged_cell_property(spark, d):
    m = part_mesh(spark, d)
    return m.averaged_cell_property(m.points.select("point_id", "value")).select("cell_id", r("value").alias("value"))


@query(f"WITH {MESH} SELECT cell_id, round(0.2 * a.value + 0.3 * b.value + 0.5 * c.value, 6) AS value FROM cells JOIN pts a ON a.point_id = pids[1] JOIN pts b ON b.point_id = pids[2] JOIN pts c ON c.point_id = pids[3]")
def surface_property(spark, d):
    m = part_mesh(spark, d)
    at = m.cells.select("cell_id", F.lit(0.2).alias("u"), F.lit(0.3).alias("v"), F.lit(0.5).alias("w"))
    return m.surface_property(at).select("cell_id", r("value").alias("value"))


@query(f"WITH {MESH}, a AS (SELECT cell_id, sqrt(ux*ux+uy*uy+uz*uz) / 2 AS area FROM nrm0) SELECT cell_id, round(sum(area) OVER (ORDER BY cell_id), 4) AS upto FROM a")
def area_cdf(spark, d):
    """Running area by cell, in two steps: by chunks of 4,096 ids, then within a chunk."""
    area = part_mesh(spark, d).measures().withColumn("chunk", F.floor(F.col("cell_id") / 4096))
    sums = area.groupBy("chunk").agg(F.sum("measure").alias("s"))
    before = sums.select("chunk", (F.sum("s").over(Window.orderBy("chunk")) - F.col("s")).alias("before"))
    own = F.sum("measure").over(Window.partitionBy("chunk").orderBy("cell_id"))
    return area.withColumn("own", own).join(before, "chunk").select("cell_id", r(F.col("own") + F.col("before"), 4).alias("upto"))


@query(f"WITH {TET} SELECT cell_id, round(abs(vol), 6) AS volume FROM tv")
def tet_volume(spark, d):
    return tet_mesh(spark, d).measures().select("cell_id", r("measure").alias("volume"))


@query(f"WITH {TET}, f AS (SELECT list_sort(list_filter(pids, lambda q: q <> pids[k])) AS facet FROM tets, (SELECT unnest([1, 2, 3, 4]) AS k)) SELECT facet[1] AS a, facet[2] AS b, facet[3] AS c FROM f GROUP BY facet HAVING count(*) % 2 = 1")
def tet_outer_surface(spark, d):
    s = tet_mesh(spark, d).outer_surface().cells.select(F.array_sort("pids").alias("f"))
    return s.select(*[F.element_at("f", k + 1).alias(n) for k, n in enumerate("abc")])


BARY = """WITH p AS (SELECT p_partkey, p_size / 50.0 AS px, p_partkey % 17 / 17.0 AS py FROM part),
w AS (SELECT *, (1.0 * 2.0 - 0.3 * 0.2) AS d FROM p)
SELECT p_partkey, round(1 - ((px * 2.0 - py * 0.3) / d) - ((py * 1.0 - px * 0.2) / d), 6)::DOUBLE AS u, round((px * 2.0 - py * 0.3) / d, 6)::DOUBLE AS v, round((py * 1.0 - px * 0.2) / d, 6)::DOUBLE AS w FROM w"""


@query(BARY)
def barycentric_3(spark, d):
    """In the triangle (0, 0), (1, 0.2), (0.3, 2)."""
    p = t(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("px"), (F.col("p_partkey") % 17 / 17.0).alias("py"))
    w = bc.in_triangle(Vec.of("px", "py"), Vec.of(0, 0), Vec.of(1, 0.2), Vec.of(0.3, 2))
    return p.select("p_partkey", *[r(x).alias(n) for x, n in zip(w.parts, "uvw")])


@query("SELECT p_partkey, round(1 - x - y - z, 6)::DOUBLE AS a, round(x, 6)::DOUBLE AS b, round(y, 6)::DOUBLE AS c, round(z, 6)::DOUBLE AS d, (x >= -1e-8 AND y >= -1e-8 AND z >= -1e-8 AND 1 - x - y - z >= -1e-8) AS inside FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS x, p_partkey % 17 / 34.0::DOUBLE AS y, p_partkey % 5 / 9.0::DOUBLE - 0.1 AS z FROM part)")
def barycentric_4(spark, d):
    """In the tetrahedron of the origin and the unit vectors."""
    i = F.col("p_partkey")
    p = t(spark, d, "part").select(i, (F.col("p_size") / 50.0).alias("x"), (i % 17 / 34.0).alias("y"), (i % 5 / 9.0 - 0.1).alias("z"))
    w = bc.in_tetrahedron(Vec.of("x", "y", "z"), Vec.of(0, 0, 0), Vec.of(1, 0, 0), Vec.of(0, 1, 0), Vec.of(0, 0, 1))
    return p.select(i, *[r(x).alias(n) for x, n in zip(w.parts, "abcd")], bc.in_cell(w).alias("inside"))


# --- transformations and registration


def _plane(spark, d):
    return t(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 50).cast("double").alias("y"))


PLANE = "p AS (SELECT c_custkey, c_acctbal / 1000 AS x, (c_custkey % 50)::DOUBLE AS y FROM customer)"


@query(f"WITH {PLANE} SELECT c_custkey, round(x + 3, 6) AS x, round(y - 2, 6) AS y FROM p")
def translate(spark, d):
    return tf.translation(3, -2).on(_plane(spark, d), ("x", "y")).select("c_custkey", r("x").alias("x"), r("y").alias("y"))


TURN = "round(1 + cos(0.5) * (x - 1) - sin(0.5) * (y - 2), 6) AS x, round(2 + sin(0.5) * (x - 1) + cos(0.5) * (y - 2), 6) AS y"


@query(f"WITH {PLANE} SELECT c_custkey, {TURN} FROM p")
def rotate(spark, d):
    return tf.rotation((0.5,), (1, 2)).on(_plane(spark, d), ("x", "y")).select("c_custkey", r("x").alias("x"), r("y").alias("y"))


@query(f"WITH {PLANE}, q AS (SELECT c_custkey, 1 + cos(0.5) * (x - 1) - sin(0.5) * (y - 2) AS x, 2 + sin(0.5) * (x - 1) + cos(0.5) * (y - 2) AS y FROM p) SELECT c_custkey, round(2 * x + 3, 6) AS x, round(2 * y - 2, 6) AS y FROM q")
def compose(spark, d):
    return tf.similarity((3, -2), 2.0, (0.5,), (1, 2)).on(_plane(spark, d), ("x", "y")).select("c_custkey", r("x").alias("x"), r("y").alias("y"))


@query(f"WITH {PLANE} SELECT c_custkey, round(x, 6) AS x, round(y, 6) AS y FROM p")
def invert(spark, d):
    there = tf.similarity((3, -2), 2.0, (0.5,), (1, 2))
    return there.inverse().on(there.on(_plane(spark, d), ("x", "y")), ("x", "y")).select("c_custkey", r("x").alias("x"), r("y").alias("y"))


def _pairs(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 1000).alias("ax"), F.col("c_nationkey").cast("double").alias("ay"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") / 1000).alias("bx"), F.col("s_nationkey").cast("double").alias("by"))
    return c.join(s, "k")


PAIRS = "p AS (SELECT c_acctbal / 1000 AS ax, c_nationkey::DOUBLE AS ay, s_acctbal / 1000 AS bx, s_nationkey::DOUBLE AS b_y FROM customer JOIN supplier ON c_custkey = s_suppkey), m AS (SELECT avg(ax) ma, avg(ay) na, avg(bx) mb, avg(b_y) nb, covar_pop(ax, b_y) - covar_pop(ay, bx) AS s, covar_pop(ax, bx) + covar_pop(ay, b_y) AS c, var_pop(ax) + var_pop(ay) AS v FROM p)"


def _fit_sql(k):
    return f"WITH {PAIRS}, f AS (SELECT *, atan2(s, c) AS angle, {k} AS scale FROM m) SELECT round(angle, 6) AS angle, round(scale, 6)::DOUBLE AS scale, round(mb - scale * (cos(angle) * ma - sin(angle) * na), 6) AS tx, round(nb - scale * (sin(angle) * ma + cos(angle) * na), 6) AS ty FROM f"


@query(_fit_sql("1.0"))
def rigid2d(spark, d):
    return st.rigid_2d(_pairs(spark, d)).select(*[r(c).alias(c) for c in ("angle", "scale", "tx", "ty")])


@query(_fit_sql("sqrt(s * s + c * c) / v"))
def similarity2d(spark, d):
    return st.rigid_2d(_pairs(spark, d), scaled=True).select(*[r(c).alias(c) for c in ("angle", "scale", "tx", "ty")])


# --- colours, scalars, vectors

PIX = "p AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS cr, (p_partkey % 100) / 80.0::DOUBLE AS cg, (p_partkey % 7) / 7.0::DOUBLE AS cb, (p_partkey % 11) / 10.0::DOUBLE AS ca FROM part)"


def _pixels(spark, d):
    i = F.col("p_partkey")
    return t(spark, d, "part").select(i, (F.col("p_size") / 50.0).alias("cr"), (i % 100 / 80.0).alias("cg"), (i % 7 / 7.0).alias("cb"), (i % 11 / 10.0).alias("ca"))


@query(f"WITH {PIX} SELECT p_partkey, round((cr + cg + cb) / 3, 6) AS gray, round(cr * 0.3 + cg * 0.59 + cb * 0.11, 6) AS luminance, round(least(greatest(cg, 0), 1), 6) AS clamped_g, round(cr * cr + cg * cg + cb * cb, 6) AS dot, (cr BETWEEN 0 AND 1 AND cg BETWEEN 0 AND 1 AND cb BETWEEN 0 AND 1) AS ok, round(cr * 0.25 + 0.5 * 0.75, 6) AS blend_r FROM p")
def rgb_ops(spark, d):
    c = RGB.of("cr", "cg", "cb")
    return _pixels(spark, d).select("p_partkey", r(c.gray()).alias("gray"), r(c.luminance()).alias("luminance"), r(c.clamped()[1]).alias("clamped_g"), r(c.dot(c)).alias("dot"), c.in_bounds().alias("ok"), r(c.blend(RGB.of(0.5, 0.5, 0.5), 0.25)[0]).alias("blend_r"))


@query(f"WITH {PIX} SELECT p_partkey, round(cr * ca + 0.2 * (1 - ca) * 0.8, 6) AS o_r, round(cg * ca + 0.4 * (1 - ca) * 0.8, 6) AS o_g, round(cb * ca + 0.6 * (1 - ca) * 0.8, 6) AS o_b, round(ca + (1 - ca) * 0.8, 6) AS o_a FROM p")
def rgba_over(spark, d):
    o = RGBA.of("cr", "cg", "cb", "ca").over(RGBA.of(0.2, 0.4, 0.6, 0.8))
    return _pixels(spark, d).select("p_partkey", *[r(x).alias(n) for x, n in zip(o.parts, ("o_r", "o_g", "o_b", "o_a"))])


@query("SELECT p_partkey, CASE WHEN b >= 128 THEN b - 256 ELSE b END AS as_byte, b AS as_ubyte, CASE WHEN s >= 32768 THEN s - 65536 ELSE s END AS as_short, s AS as_ushort FROM (SELECT p_partkey, (p_partkey * 37) % 256 AS b, (p_partkey * 7919) % 65536 AS s FROM part)")
def scalar_cast(spark, d):
    i = F.col("p_partkey")
    return t(spark, d, "part").select(i, sc.convert(i * 37, "byte").cast("long").alias("as_byte"), sc.convert(i * 37, "ubyte").cast("long").alias("as_ubyte"), sc.convert(i * 7919, "short").cast("long").alias("as_short"), sc.convert(i * 7919, "ushort").cast("long").alias("as_ushort"))


@query("SELECT p_partkey, floor((p_partkey % 256) * l + (p_size) * (1 - l) + 0.5)::BIGINT AS blended FROM (SELECT *, (p_partkey % 10) / 10.0::DOUBLE AS l FROM part)")
def integer_blend(spark, d):
    i = F.col("p_partkey")
    return t(spark, d, "part").select(i, sc.blend(i % 256, F.col("p_size"), i % 10 / 10.0, "int").cast("long").alias("blended"))


VEC = "v AS (SELECT l_orderkey, l_linenumber, l_quantity AS ax, l_discount * 100 AS ay, l_tax * 100 AS az, l_tax * 50 AS bx, l_quantity / 10 AS b_y, 3.0::DOUBLE AS bz FROM lineitem)"


@query(f"WITH {VEC} SELECT l_orderkey, l_linenumber, round(ax * bx + ay * b_y + az * bz, 6) AS dot, round(sqrt(ax * ax + ay * ay + az * az), 6) AS norm, round(ay * bz - az * b_y, 6) AS cx, round(az * bx - ax * bz, 6) AS cy, round(ax * b_y - ay * bx, 6) AS cz, round(ax / sqrt(ax * ax + ay * ay + az * az), 6) AS ux, round(ay * b_y, 6) AS ey, round(ax * bz, 6) AS outer_xz FROM v")
def vector_algebra(spark, d):
    a, b = Vec.of("ax", "ay", "az"), Vec.of("bx", "by", "bz")
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("ax"), (F.col("l_discount") * 100).alias("ay"), (F.col("l_tax") * 100).alias("az"), (F.col("l_tax") * 50).alias("bx"), (F.col("l_quantity") / 10).alias("by"), F.lit(3.0).alias("bz"))
    return rows.select("l_orderkey", "l_linenumber", r(a.dot(b)).alias("dot"), r(a.norm()).alias("norm"), *[r(x).alias(n) for x, n in zip(a.cross(b).parts, ("cx", "cy", "cz"))], r(a.normalized()[0]).alias("ux"), r(a.elementwise(b)[1]).alias("ey"), r(a.outer(b).rows[0][2]).alias("outer_xz"))


@query("WITH m AS (SELECT p_partkey, p_size + 1.0::DOUBLE AS a, (p_partkey % 5)::DOUBLE AS b, (p_partkey % 3)::DOUBLE AS c, p_size + 7.0::DOUBLE AS d FROM part) SELECT p_partkey, round(a * d - b * c, 6) AS det, round(d / (a * d - b * c), 6) AS inv_a, round(-b / (a * d - b * c), 6) + 0 AS inv_b, round(a * a + b * c, 6) AS sq_a, round(a * 2 + b * 3, 6) AS mv FROM m")
def matrix_algebra(spark, d):
    i, s = F.col("p_partkey"), F.col("p_size")
    m = Mat.of([[s + 1.0, (i % 5).cast("double")], [(i % 3).cast("double"), s + 7.0]])
    inv = m.inv()
    return t(spark, d, "part").select(i, r(m.det()).alias("det"), r(inv.rows[0][0]).alias("inv_a"), (r(inv.rows[0][1]) + 0).alias("inv_b"), r((m @ m).rows[0][0]).alias("sq_a"), r(m.apply(Vec.of(2, 3))[0]).alias("mv"))


@query("SELECT p_partkey, round(p_size * cos(a), 6) AS px, round(p_size * sin(a), 6) AS py, round(p_size * sin(0.5) * cos(a), 6) AS sx, round(p_size * cos(0.5), 6) AS sz FROM (SELECT *, p_partkey / 100.0::DOUBLE AS a FROM part)")
def polar_points(spark, d):
    a, s = F.col("p_partkey") / 100.0, F.col("p_size")
    p, q = Vec.polar(s, a), Vec.spherical(s, 0.5, a)
    return t(spark, d, "part").select("p_partkey", r(p[0]).alias("px"), r(p[1]).alias("py"), r(q[0]).alias("sx"), r(q[2]).alias("sz"))


@query("SELECT event_id, round(-((value - 50) / 20) * ((value - 50) / 20) / 2 - ln(20 * sqrt(2 * pi())), 6) AS logp FROM events")
def gaussian_log_density(spark, d):
    return t(spark, d, "events").select("event_id", r(st.gaussian_log_density(F.col("value"), 50.0, 20.0)).alias("logp"))


__all__ = ["QUERIES", "SQL", "Domain", "T", "numbered", "p1", "p3", "part_mesh", "tet_mesh"]
