import numpy as np
import pytest

from shapelake.functions import transform as tf
from shapelake.plans import pdm
from shapelake.sources import formats as fm
from shapelake.sources import landmarks as lm
from shapelake.sources import tables as tb
from shapelake.streaming.moments import windowed_moments

POINTS = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.5]], float)


@pytest.mark.parametrize("kind", ["vtk", "stl", "ply"])
def test_mesh_round_trip(spark, tmp_path, kind):
    path = tmp_path / f"m.{kind}"
    path.write_bytes(tb.WRITERS[kind](fm.MeshData(POINTS, np.array([[0, 1, 2], [0, 1, 3]]))))
    m = tb.mesh_of(spark, str(path))
    assert m.points.count() == 4 and m.cells.count() == 2
    assert abs(m.measure().first()[0] - (0.5 + 0.75)) < 1e-6
    tb.write_mesh(spark, m, str(tmp_path / f"again.{kind}"))
    assert abs(tb.mesh_of(spark, str(tmp_path / f"again.{kind}")).measure().first()[0] - 1.25) < 1e-6


def test_tetrahedra_lines_and_values():
    tet = fm.read_vtk(fm.write_vtk(fm.MeshData(POINTS, np.array([[0, 1, 2, 3]]), np.array([1, 2, 3, 4], np.int16))))
    assert tet.cells.tolist() == [[0, 1, 2, 3]] and tet.values.dtype == np.int16
    assert fm.read_vtk(fm.write_vtk(fm.MeshData(POINTS, np.array([[0, 1], [1, 2]])))).cells.tolist() == [[0, 1], [1, 2]]


def test_corrected_drops_unused_points():
    m = fm.corrected(fm.MeshData(POINTS, np.zeros((0, 3), int), polygons=[[3, 1, 0]]))
    assert m.points.tolist() == [POINTS[3].tolist(), POINTS[1].tolist(), POINTS[0].tolist()] and m.cells.tolist() == [[0, 1, 2]]


def test_ply_colours():
    m = fm.read_ply(fm.write_ply(fm.MeshData(POINTS, np.array([[0, 1, 2]]), rgba=np.full((4, 4), 0.2))))
    assert np.allclose(m.rgba, 0.2)


@pytest.mark.parametrize("dtype", ["i1", "u1", "i2", "u2", "i4", "u4", "f4", "f8"])
@pytest.mark.parametrize("kind", ["vtk", "nii"])
def test_image_round_trip(spark, tmp_path, dtype, kind):
    x = fm.ImageData(np.array([1.0, 2, 3]), np.array([1.0, 2, 0.5]), (2, 4, 3), np.arange(42, 66).astype(dtype))
    path = tmp_path / f"i.{kind}"
    path.write_bytes(tb.WRITERS[kind](x))
    grid, values = tb.read_image(spark, str(path))
    assert grid.size == (2, 4, 3) and np.allclose(grid.spacing, (1, 2, 0.5)) and np.allclose(grid.origin, (1, 2, 3))
    assert [r.value for r in values.orderBy("voxel_id").collect()] == list(range(42, 66))
    if kind == "vtk":
        assert np.dtype(fm.VTK_TYPES[tb.scalar_type(spark, str(path))]) == np.dtype(dtype)


def test_nifti_directions():
    turn = tf.rotation_matrix((0.3, 0.1, -0.2))
    x = fm.ImageData(np.array([5.0, 6, 7]), np.array([1.0, 1, 2]), (2, 2, 2), np.arange(8).astype("f4"), turn)
    y = fm.read_nifti(fm.write_nifti(x))
    assert np.allclose(y.directions, turn, atol=1e-6) and np.allclose(y.origin, x.origin)


def test_unknown_suffix():
    with pytest.raises(ValueError):
        tb.suffix("a.xyz")


def test_landmarks(spark, tmp_path):
    (tmp_path / "l.csv").write_text("# comment\n# id, x, y, z\na, 1, 2.5, 3\nb , 4,5,6\n")
    rows = lm.read_csv(spark, str(tmp_path / "l.csv")).orderBy("id").collect()
    assert [(r.id, r.coord) for r in rows] == [("a", [1.0, 2.5, 3.0]), ("b", [4.0, 5.0, 6.0])]
    lines = spark.read.text(str(tmp_path / "l.csv"))
    assert lm.from_csv_lines(lines, dim=2).filter("id = 'b'").first().coord == [4.0, 5.0]
    lm.write_csv(lm.read_csv(spark, str(tmp_path / "l.csv")), str(tmp_path / "out"))
    assert lm.read_csv(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "l.json").write_text('[{"id": "a", "coordinates": [1, 2, 3], "extensions": {"k": 1}}, {"id": "b", "coordinates": [4, 5, 6], "description": "d", "uncertainty": {"stddevs": [2, 1, 1], "pcvectors": [[1, 0, 0], [0, 1, 0], [0, 0, 1]]}}]')
    got = lm.read_json(spark, str(tmp_path / "l.json"))
    assert got.filter("id = 'b'").select(lm.covariance(got.stddevs, got.pcvectors, 3)).first()[0] == [4, 0, 0, 0, 1, 0, 0, 0, 1]
    lm.write_json(got, str(tmp_path / "j"))
    assert {(r.id, tuple(r.coord)) for r in lm.from_json_texts(spark.read.text(str(tmp_path / "j"))).collect()} == {("a", (1, 2, 3)), ("b", (4, 5, 6))}


def test_model_bundle(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, p, *map(float, rng.normal(size=3))) for i in range(4) for p in range(6)]
    shapes = spark.createDataFrame(rows, "item_id long, point_id long, x double, y double, z double")
    ref = shapes.filter("item_id = 0").drop("item_id")
    m = pdm.pca_model(ref, shapes)
    tb.write_model(m, str(tmp_path / "m"))
    again = tb.read_model(spark, str(tmp_path / "m"))
    assert np.allclose(again.variance, m.variance)
    a, b = (sorted(map(tuple, x.instance([1.0, 0.5]).collect())) for x in (m, again))
    assert np.allclose(a, b)


def test_handlers():
    tb.register_handler("h", "1", len, len)
    assert tb.find_handler("h", "1") == (len, len)
    with pytest.raises(ValueError):
        tb.register_handler("h", "1", len, len)
    with pytest.raises(KeyError):
        tb.find_handler("h", "2")


def test_windowed_moments_on_a_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 1.0D value, 'a' k UNION ALL SELECT timestamp'2024-01-01 00:20:00', 3.0D, 'a' UNION ALL SELECT timestamp'2024-01-01 05:00:00', 9.0D, 'a'").coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("ts timestamp, value double, k string").parquet(str(tmp_path / "s"))
    q = windowed_moments(stream, "ts", "value", "k").writeStream.outputMode("append").format("memory").queryName("moments").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT n, mean, var FROM moments").collect()
    assert [tuple(r) for r in rows] == [(2, 2.0, 2.0)]


def vtu(kind, packed=False, raw=False):
    """A file of one tetrahedron and one hexagon-like cell, its arrays in a given form."""
    import base64
    import zlib

    arrays = [("points", "Float32", np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [5, 5, 5]], "<f4")), ("connectivity", "Int64", np.array([0, 1, 2, 0, 1, 2, 3], "<i8")), ("offsets", "Int32", np.array([3, 7], "<i4")), ("types", "UInt8", np.array([5, 10], "u1")), ("v", "Float64", np.arange(5) * 1.5)]
    appended, parts = b"", {}

    def code(a):
        b = a.tobytes()
        if packed:
            half = len(b) // 2 + 1
            blocks = [zlib.compress(x) for x in (b[:half], b[half:])]
            head = np.array([2, half, len(b) - half, *map(len, blocks)], "<u4").tobytes()
            return head + b"".join(blocks) if raw else base64.b64encode(head) + base64.b64encode(b"".join(blocks))
        head = np.array([len(b)], "<u4").tobytes()
        return head + b if raw else base64.b64encode(head + b)

    for name, type_, a in arrays:
        n = f'NumberOfComponents="{3 if name == "points" else 1}"'
        if kind == "appended":
            parts[name] = f'<DataArray type="{type_}" Name="{name}" {n} format="appended" offset="{len(appended)}"/>'
            appended += code(a)
        else:
            body = code(a).decode() if kind == "binary" else " ".join(map(str, a.ravel().tolist()))
            parts[name] = f'<DataArray type="{type_}" Name="{name}" {n} format="{kind}">{body}</DataArray>'
    more = 'compressor="vtkZLibDataCompressor"' if packed else ""
    tail = (f'<AppendedData encoding="{"raw" if raw else "base64"}">_'.encode() + appended + b"</AppendedData>") if appended else b""
    text = f'<VTKFile type="UnstructuredGrid" byte_order="LittleEndian" {more}><UnstructuredGrid><Piece NumberOfPoints="5" NumberOfCells="2"><PointData>{parts["v"]}</PointData><Points>{parts["points"]}</Points><Cells>{parts["connectivity"]}{parts["offsets"]}{parts["types"]}</Cells></Piece></UnstructuredGrid>'
    return text.encode() + tail + b"</VTKFile>"


@pytest.mark.parametrize("form", [("ascii",), ("binary",), ("binary", True), ("appended",), ("appended", True), ("appended", False, True), ("appended", True, True)])
def test_vtu_in_all_forms(form):
    from shapelake.sources import unstructured as us

    m = us.read_vtu(vtu(*form))
    assert m.points.shape == (5, 3) and m.cells.tolist() == [[0, 1, 2, 3]] and m.values.tolist() == [0, 1.5, 3, 4.5, 6]


def test_tetrahedra_through_text_files():
    from shapelake.sources import unstructured as us

    m = fm.MeshData(np.random.default_rng(1).normal(0, 1, (6, 3)), np.array([[0, 1, 2, 3], [2, 3, 4, 5]]), np.arange(6) / 3)
    for read, write in ((us.read_vtu, us.write_vtu), (us.read_inp, us.write_inp)):
        for values in (m.values, None):
            back = read(write(fm.MeshData(m.points, m.cells, values)))
            assert np.array_equal(back.points, m.points) and np.array_equal(back.cells, m.cells) and (back.values is None if values is None else np.array_equal(back.values, values))
    other = b"# made by hand\n4 2 0 0 0\n10 0 0 0\n20 1 0 0\n30 0 1 0\n40 0 0 1\n1 1 tri 10 20 30\n2 1 tet 10 20 30 40\n"
    assert us.read_inp(other).cells.tolist() == [[0, 1, 2, 3]]


def test_binary_ply_is_read_as_tables():

    for order, fmt in (("<", "binary_little_endian"), (">", "binary_big_endian")):
        head = f"ply\nformat {fmt} 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face {{}}\nproperty list uchar int vertex_indices\nend_header\n"
        v = np.zeros(4, np.dtype([("x", order + "f4"), ("y", order + "f4"), ("z", order + "f4"), ("c", "u1", 3)]))
        v["x"], v["c"] = np.arange(4), [[255, 0, 51]] * 4
        f3 = np.zeros(2, np.dtype([("n", "u1"), ("i", order + "i4", 3)]))
        f3["n"], f3["i"] = 3, [[0, 1, 2], [1, 2, 3]]
        m = fm.read_ply(head.format(2).encode() + v.tobytes() + f3.tobytes())
        assert m.points[:, 0].tolist() == [0, 1, 2, 3] and m.cells.tolist() == [[0, 1, 2], [1, 2, 3]] and np.allclose(m.rgba[0], [1, 0, 0.2, 1])
        quad = np.uint8(4).tobytes() + np.array([0, 1, 2, 3], order + "i4").tobytes()
        m = fm.read_ply(head.format(3).encode() + v.tobytes() + f3[:1].tobytes() + quad + f3[1:].tobytes())
        assert m.cells.tolist() == [[0, 1, 2], [0, 1, 2], [0, 2, 3], [1, 2, 3]]


def test_models_in_hdf5_json(spark, tmp_path):
    from shapelake.sources import h5json as hj

    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (5, 4, 3))
    shapes = spark.createDataFrame([(i, p, *map(float, x[i, p])) for i in range(5) for p in range(4)], "item_id long, point_id long, x double, y double, z double")
    ref = spark.createDataFrame([(p, *map(float, x[0, p])) for p in range(4)], "point_id long, x double, y double, z double")
    table = lambda m: sorted((r.point_id, r.component, round(r["mean"], 9), tuple(np.round(r.basis, 9))) for r in m.points.collect())
    for corners, kind in ((0, "POINT_SET"), (2, "LINE_MESH"), (3, "POLYGON_MESH"), (4, "VOLUME_MESH")):
        cells = None if not corners else spark.createDataFrame([(0, list(range(corners)))], "cell_id long, pids array<long>")
        model = pdm.pca_model(ref, shapes, cells)
        path = str(tmp_path / f"m{corners}.json")
        hj.write_h5json_model(model, path, "/models/one")
        file = hj.H5Json(open(path).read())
        assert file.attribute("/models/one/representer", "datasetType") == kind and file.value("/models/one/model/pcaBasis").shape == (12, 4)
        back = hj.read_h5json_model(spark, path, "/models/one")
        assert table(back) == table(model) and np.allclose(back.variance, model.variance) and back.names == ("x", "y", "z")
        assert (back.cells is None) if not corners else back.cells.first().pids == list(range(corners))
    basis = np.eye(6)[:, :2]
    parts = {"/representer/points": np.arange(6.0).reshape(2, 3), "/model/mean": np.arange(6.0), "/model/pcaVariance": np.array([4.0, 9.0]), "/model/pcaBasis": basis * [2, 3]}
    attributes = {"/representer": {"name": "vtkPolyDataRepresenter", "datasetType": "POINT_SET"}}
    (tmp_path / "old.json").write_text(hj.h5json_text(parts, attributes))
    old = hj.read_h5json_model(spark, str(tmp_path / "old.json"))
    assert old.names == ("x", "y") and [r.basis for r in old.points.orderBy("point_id", "component").collect()] == basis.tolist()
    listed = {"/catalog/b/modelType": "POLYGON_MESH_MODEL", "/catalog/b/modelPath": "/b", "/catalog/a/modelType": "UNKNOWN", "/catalog/a/modelPath": "/a"}
    (tmp_path / "list.json").write_text(hj.h5json_text(listed, {}))
    assert [tuple(r) for r in hj.read_h5json_catalog(spark, str(tmp_path / "list.json")).collect()] == [("a", "UNKNOWN", "/a"), ("b", "POLYGON_MESH_MODEL", "/b")]
    for version, name in (((0, 7), "itkStandardMeshRepresenter"), (None, "itkStandardMeshRepresenter")):
        more = {} if version is None else {"/version/majorVersion": version[0], "/version/minorVersion": version[1]}
        (tmp_path / "bad.json").write_text(hj.h5json_text(parts | more, {"/representer": {"name": name, "datasetType": "POINT_SET"}}))
        with pytest.raises(ValueError):
            hj.read_h5json_model(spark, str(tmp_path / "bad.json"))
    with pytest.raises(ValueError):
        hj.H5Json("{}")
