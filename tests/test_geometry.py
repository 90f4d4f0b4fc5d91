import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.functions import barycentric as bc
from shapelake.functions import transform as tf
from shapelake.functions.scalar import blend3, bspline, convert
from shapelake.functions.vector import Mat, Vec
from shapelake.operators.field import Box, Domain, Field


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_vector_identities(spark):
    a, b = Vec.of(1, 2, 3), Vec.of(-2, 0.5, 4)
    row = one(spark, a.cross(b).dot(a), a.dot(b), (a + b - b).norm2(), a.normalized().norm(), a.outer(b).rows[1][2])
    assert np.allclose(row, [0, 11, 14, 1, 8])
    assert one(spark, Vec.of(0, 0).normalized()[0])[0] is None


def test_matrix_inverse(spark):
    m = Mat.of([[2, 1, 0], [1, 3, 1], [0, 1, 4]])
    row = one(spark, *[x for r in (m @ m.inv()).rows for x in r], m.det())
    assert np.allclose(row[:9], np.eye(3).ravel()) and math.isclose(row[9], 18)
    assert one(spark, Mat.of([[1, 2], [2, 4]]).inv().rows[0][0])[0] is None


def test_integer_kinds_wrap(spark):
    v = F.lit(300)
    assert tuple(one(spark, convert(v, "byte"), convert(v, "ubyte"), convert(-v, "ubyte"), convert(F.lit(2.9), "int"))) == (44, 44, 212, 2)


def test_integer_barycentric_blend_rounds_twice(spark):
    w = [F.lit(1 / 3)] * 3
    assert one(spark, blend3([F.lit(0), F.lit(1), F.lit(0)], w, "int"))[0] == 1


def test_bspline_partition_of_unity(spark):
    for order in (1, 2, 3):
        total = F.lit(0.0)
        for k in range(-3, 4):
            total = total + bspline(F.lit(0.3) - k, order)
        assert math.isclose(one(spark, total)[0], 1)
    with pytest.raises(ValueError):
        bspline(F.lit(0.0), 4)


@pytest.mark.parametrize("p,case,d2", [((0.2, 0.2, 2), "triangle", 4), ((-1, -1, 0), "point", 2), ((0.5, -1, 0), "line", 1)])
def test_closest_on_triangle(spark, p, case, d2):
    corners = Vec.of(0, 0, 0), Vec.of(1, 0, 0), Vec.of(0, 1, 0)
    df = spark.range(1).withColumns(bc.triangle_candidates(Vec.of(*p), *corners))
    hit = bc.closest_of(F.col("flat"), F.col("edge"), Vec.of(*p), *corners)
    row = df.select(hit["case"].alias("case"), hit["d2"].alias("d2"), (hit["u"] + hit["v"] + hit["w"]).alias("s")).first()
    assert row.case == case and math.isclose(row.d2, d2) and math.isclose(row.s, 1)


def test_degenerate_triangle_is_a_segment(spark):
    corners = Vec.of(0, 0, 0), Vec.of(1, 0, 0), Vec.of(2, 0, 0)
    df = spark.range(1).withColumns(bc.triangle_candidates(Vec.of(1.5, 1, 0), *corners))
    assert math.isclose(df.select(bc.closest_of(F.col("flat"), F.col("edge"), Vec.of(1.5, 1, 0), *corners)["d2"]).first()[0], 1)


def test_circumcenter(spark):
    c = bc.circumcenter(Vec.of(1, 0, 0), Vec.of(-1, 0, 0), Vec.of(0, 1, 0), Vec.of(0, 0, 1))
    assert np.allclose(one(spark, *c.parts), 0)


def test_transformations_invert_and_compose():
    x = np.random.default_rng(0).normal(size=(5, 3))
    for t in (tf.similarity((1, 2, 3), 1.5, (0.1, 0.2, 0.3), (1, 1, 1)), tf.inverse_similarity((0.1, 0.2, 0.3), (0, 0, 0), 2.0, (1, 0, 0))):
        assert np.allclose(t.inverse().numpy(t.numpy(x)), x)
    a, b = tf.translation(1, 2, 3), tf.rotation((0.4, 0.5, 0.6), (1, 0, 0))
    assert np.allclose(a.compose(b).numpy(x), a.numpy(b.numpy(x)))
    assert np.allclose(tf.euler_angles(tf.rotation_matrix((0.4, 0.5, 0.6))), (0.4, 0.5, 0.6))
    assert tf.rigid_space((0, 0, 0)).size == 6 and tf.similarity_space((0, 0)).size == 4
    with pytest.raises(ValueError):
        tf.translation_space(3)((1.0,))


def test_parameter_jacobian():
    t = tf.rotation_space((0.0, 0.0))((0.3,))
    x = np.array([2.0, 1.0])
    expect = np.array([-math.sin(0.3) * 2 - math.cos(0.3), math.cos(0.3) * 2 - math.sin(0.3)])
    assert np.allclose(t.parameter_jacobian(x)[:, 0], expect, atol=1e-6)


def test_fields_are_undefined_outside(spark):
    f = Field(lambda p: p[0] * 2, Box.of((0.0,), (1.0,)))
    df = spark.createDataFrame([(0.5,), (2.0,)], "x double")
    assert [r[0] for r in df.select(f(Vec.of("x"))).collect()] == [1.0, None]
    with pytest.raises(Exception, match="outside"):
        df.select(f.strict(Vec.of("x"))).collect()
    assert Box.of((0, 0), (2, 3)).volume == 6
    both = Domain(lambda p: p[0] > 0).intersection(Domain(lambda p: p[0] < 1))
    assert df.filter(both.contains(Vec.of("x"))).count() == 1


def test_box_filter_reaches_the_reader(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("double").alias("x"), F.lit("a").alias("other")).write.parquet(str(tmp_path / "p"))
    plan = Box.of((3.0,), (7.0,)).filter(spark.read.parquet(str(tmp_path / "p")), ("x",)).select("x")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,3.0)" in plan and "ReadSchema: struct<x:double>" in plan
