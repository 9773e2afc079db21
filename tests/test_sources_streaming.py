"""Headers and transform files from literals, round trips, and streams."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegrid.functions.fields import DisplacementFieldTransform
from framegrid.functions.transforms import AffineTransform
from framegrid.operators.framed import frame_table
from framegrid.plans import anatomy
from framegrid.plans.declare import ArrayCoordinates, CoordinateSystem, ReferenceFrame
from framegrid.plans.grid import Grid
from framegrid.sources import headers, nifti_files, transform_files
from framegrid.streaming.points import sample_at, window_average

FIXED, MOVING = transform_files.lps_frame("fixed"), transform_files.lps_frame("moving")
AFFINE = """#Insight Transform File V1.0
#Transform 0
Transform: AffineTransform_double_3_3
Parameters: 1 0 0 0 2 0 0 0 1 5 6 7
FixedParameters: 1 1 1
"""


def test_text_transforms():
    t = transform_files.itk_transform(AFFINE, fixed=FIXED, moving=MOVING)
    np.testing.assert_allclose(t.transform_point([[1, 1, 1], [0, 2, 0]]), [[6, 7, 8], [5, 9, 7]])
    euler = AFFINE.replace("AffineTransform_double_3_3", "Euler3DTransform_double_3_3").replace("Parameters: 1 0 0 0 2 0 0 0 1 5 6 7", f"Parameters: 0 0 {math.pi / 2} 0 0 0")
    np.testing.assert_allclose(transform_files.itk_transform(euler, fixed=FIXED, moving=MOVING).transform_point([[2, 1, 1]]), [[1, 2, 1]], atol=1e-12)
    v = AFFINE.replace("AffineTransform_double_3_3", "VersorRigid3DTransform_double_3_3").replace("1 0 0 0 2 0 0 0 1 5 6 7", f"0 0 {math.sin(math.pi / 4)} 1 0 0")
    np.testing.assert_allclose(transform_files.itk_transform(v, fixed=FIXED, moving=MOVING).transform_point([[2, 1, 1]]), [[2, 2, 1]], atol=1e-12)
    two = """#Insight Transform File V1.0
Transform: CompositeTransform_double_3_3
Transform: TranslationTransform_double_3_3
Parameters: 1 0 0
FixedParameters:
Transform: AffineTransform_double_3_3
Parameters: 2 0 0 0 2 0 0 0 2 0 0 0
FixedParameters: 0 0 0
"""
    np.testing.assert_allclose(transform_files.itk_transform(two, fixed=FIXED, moving=MOVING).transform_point([[1, 1, 1]]), [[3, 2, 2]])
    for bad in ("", "Transform: X", AFFINE.replace("Affine", "Zork")):
        with pytest.raises(ValueError):
            transform_files.itk_transform(bad, fixed=FIXED, moving=MOVING)


def test_rotation_orders_differ():
    a, b = transform_files.euler_3d(0.3, 0.4, 0.5, True), transform_files.euler_3d(0.3, 0.4, 0.5, False)
    for m in (a, b):
        np.testing.assert_allclose(m @ m.T, np.eye(3), atol=1e-12)
    assert np.abs(a - b).max() > 0.01


def test_parameter_files():
    text = """// comment
(Transform "EulerTransform") (FixedImageDimension 2)
(TransformParameters 1.5707963267948966 1 0)
(CenterOfRotationPoint 0 0)
(HowToCombineTransforms "Compose")
"""
    plane = [transform_files.lps_frame(n, 2) for n in "ab"]
    m = transform_files.parse_parameter_text(text)
    t = transform_files.parameter_transform([m], fixed=plane[0], moving=plane[1])
    np.testing.assert_allclose(t.transform_point([[1, 0]]), [[1, 1]], atol=1e-12)
    with pytest.raises(ValueError):
        transform_files.parse_parameter_text("(A 1) rubbish")
    spline = {"Transform": ["BSplineTransform"], "FixedImageDimension": [2.0], "GridSize": [5.0, 6.0], "GridSpacing": [1.0, 1.0], "GridOrigin": [0.0, 0.0], "GridDirection": [1.0, 0.0, 0.0, 1.0], "TransformParameters": [1.0] * 30 + [2.0] * 30}
    b = transform_files.parameter_transform([spline], fixed=plane[0], moving=plane[1])
    np.testing.assert_allclose(b.transform_point([[2.2, 2.7], [100, 100]]), [[3.2, 4.7], [100, 100]])


def test_warp_then_affine_has_a_declared_inverse_only():
    mid = ReferenceFrame.local(FIXED.coordinate_system)
    t = AffineTransform.from_matrix(np.eye(3), source=ArrayCoordinates(("a", "b", "c"), ("1",) * 3), target=FIXED, translation=[0] * 3)
    g = Grid(t, {a: (a, np.arange(4)) for a in "abc"})
    back = Grid(t.with_endpoints(target=mid), {a: (a, np.arange(4)) for a in "abc"})
    warp = DisplacementFieldTransform(g, np.full((4, 4, 4, 3), 0.5), target=mid)
    inverse = DisplacementFieldTransform(back, np.full((4, 4, 4, 3), -0.5), target=FIXED)
    affine = AffineTransform.from_matrix(np.eye(3) * 2, source=mid, target=MOVING, translation=[0] * 3)
    chain = transform_files.warp_and_affine(warp, affine, inverse)
    np.testing.assert_allclose(chain.transform_point([[1, 1, 1]]), [[3, 3, 3]])
    np.testing.assert_allclose(chain.declared_inverse().transform_point([[3, 3, 3]]), [[1, 1, 1]])


def slices(zs, **more):
    base = {"ImageOrientationPatient": [1, 0, 0, 0, 1, 0], "PixelSpacing": [0.75, 0.5], "Rows": 4, "Columns": 5, "SliceThickness": 2.0, "FrameOfReferenceUID": "1.2.3"}
    return [{**base, "ImagePositionPatient": [-10, 20, z], **more} for z in zs]


def test_dicom_stacks():
    s = headers.dicom_stack(slices([6.0, 0.0, 3.0]))
    assert s.order == (1, 2, 0) and s.grid.frame.identifier == ("dicom", "1.2.3") and "uniform-slices" in s.report
    np.testing.assert_allclose(s.grid.point_at(slice=1, row=2, column=3), [-10 + 1.5, 20 + 1.5, 3])
    np.testing.assert_allclose(s.grid.intervals["k"][0], [-1 / 3, 1 / 3])
    odd = headers.dicom_stack(slices([0.0, 2.0, 5.0]))
    assert "slice_offset" in odd.grid.coordinates and odd.grid.coordinates["slice_offset"][1].tolist() == [0, 2, 5]
    for bad in ([*slices([0.0]), *slices([0.0])], [*slices([0.0]), *slices([3.0], Rows=9)], [*slices([0.0]), *slices([3.0], ImagePositionPatient=[0, 20, 3])], []):
        with pytest.raises(ValueError):
            headers.dicom_stack(bad)
    shared = {k: v for k, v in slices([0.0])[0].items() if k != "ImagePositionPatient"}
    many = headers.dicom_enhanced(shared, [{"ImagePositionPatient": [0, 0, z]} for z in (0, 1, 2)], frame_indices=[0, 2])
    assert many.grid.sizes["slice"] == 2
    with pytest.raises(ValueError):
        headers.dicom_enhanced(shared, [{"Rows": 1, "ImagePositionPatient": [0, 0, 0]}])


def test_dicom_order_of_a_table(spark):
    rows = [("a", f"s{k}", [0.0, 0.0, z], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]) for k, z in enumerate([4.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "series string, sop string, position array<double>, orientation array<double>")
    assert [(r["sop"], r["slice"], r["gap"]) for r in headers.dicom_order(df).orderBy("slice").collect()] == [("s1", 0, None), ("s2", 1, 2.0), ("s0", 2, 2.0)]


def test_nifti_headers_round_trip():
    system = anatomy.patient_coordinate_system("LPS")
    frame = ReferenceFrame.declared("t", "p", system)
    c, s = math.cos(0.5), math.sin(0.5)
    for m in (np.array([[c, -s, 0], [s, c, 0], [0, 0, 3]]), np.array([[0, 0, 2], [0, 1.5, 0], [1, 0, 0]]), np.array([[1, 0.3, 0], [0, 1, 0], [0, 0, 1]])):
        t = AffineTransform.from_matrix(m, source=ArrayCoordinates(("i", "j", "k"), ("1",) * 3, sample_offset=(0.5,) * 3), target=frame, translation=[4, 5, 6])
        g = Grid(t, {a: (a, np.arange(n)) for a, n in zip("ijk", (3, 4, 5), strict=True)})
        h = headers.parse_nifti_header(headers.build_nifti_header(headers.nifti_header(g)))
        back = headers.nifti_grid(h, frame=frame.with_coordinate_system(anatomy.patient_coordinate_system("RAS")))
        np.testing.assert_allclose(back.points() * [-1, -1, 1], g.points(), atol=1e-5)
        if h["qform_code"]:
            q = headers.nifti_grid(h, xform="qform")
            np.testing.assert_allclose(q.points() * [-1, -1, 1], g.points(), atol=1e-5)
            assert q.frame.is_anonymous
    with pytest.raises(ValueError):
        headers.parse_nifti_header(b"x" * 400)
    with pytest.raises(ValueError):
        headers.nifti_grid({**h, "sform_code": 0, "qform_code": 0})
    assert headers.nifti_grid({**h, "sform_code": 4}).frame.identifier == ("template", "mni152")


def test_nifti_files(spark, tmp_path):
    frame = ReferenceFrame.declared("t", "p", anatomy.patient_coordinate_system("RAS"))
    t = AffineTransform.from_matrix(np.diag([1.0, 2.0, 3.0]), source=ArrayCoordinates(("i", "j", "k"), ("1",) * 3, sample_offset=(0.5,) * 3), target=frame, translation=[0] * 3)
    g = Grid(t, {a: (a, np.arange(n)) for a, n in zip("ijk", (3, 4, 5), strict=True)})
    df = g.to_df(spark, coordinates=False).withColumn("value", (F.col("pos_i") + 10 * F.col("pos_j") + 100 * F.col("pos_k")).cast("double"))
    nifti_files.write_nifti(frame_table(df, g), f"{tmp_path}/v.nii")
    back = nifti_files.read_nifti(spark, f"{tmp_path}/v.nii", frame=frame)
    assert back.grid.sizes == g.sizes and back.df.filter("value <> pos_i + 10 * pos_j + 100 * pos_k").count() == 0 and back.df.count() == 60
    assert headers.read_nifti_headers(spark, str(tmp_path)).first()["sizes"] == [3, 4, 5]
    with pytest.raises(ValueError):
        nifti_files.voxels(struct.pack("<i", 348) + b"\0" * 400)


def test_ngff_transformations():
    m = headers.ngff_affine
    seq = {"type": "sequence", "transformations": [{"type": "scale", "scale": [2, 3]}, {"type": "translation", "translation": [1, 1]}]}
    np.testing.assert_allclose(m(seq, 2) @ [1, 1, 1], [3, 4, 1])
    np.testing.assert_allclose(m({"type": "mapAxis", "mapAxis": [1, 0]}, 2) @ [5, 7, 1], [7, 5, 1])
    by = {"type": "byDimension", "transformations": [{"input_axes": [1], "output_axes": [0], "transformation": {"type": "scale", "scale": [2]}}, {"input_axes": [0], "output_axes": [1], "transformation": {"type": "translation", "translation": [3]}}]}
    np.testing.assert_allclose(m(by, 2) @ [5, 7, 1], [14, 8, 1])
    np.testing.assert_allclose(m({"type": "affine", "affine": [[1, 2, 3], [4, 5, 6]]}, 2) @ [12, 2, 1], [19, 64, 1])
    for bad in ({"type": "displacements", "path": "x"}, {"type": "rotation", "rotation": [[1, 1], [0, 1]]}, {"type": "bijection", "forward": seq, "inverse": seq}, {"type": "mapAxis", "mapAxis": [0, 0]}, {"type": "byDimension", "transformations": by["transformations"][:1]}):
        with pytest.raises(ValueError):
            m(bad, 2)


def test_ngff_levels():
    ms = {"axes": [{"name": "c", "type": "channel"}, {"name": "y", "type": "space", "unit": "micrometer"}, {"name": "x", "type": "space", "unit": "micrometer"}],
          "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1, 0.5, 0.5]}]}, {"path": "1", "coordinateTransformations": [{"type": "scale", "scale": [1, 1, 1]}, {"type": "translation", "translation": [0, 0.25, 0.25]}]}],
          "coordinateTransformations": [{"type": "scale", "scale": [1, 10, 10]}]}
    g = headers.ngff_grid(ms, (2, 4, 6), level=1)
    assert g.frame.units == ("um", "um") and g.dims == ("y", "x")
    np.testing.assert_allclose(g.point_at(y=1, x=2), [12.5, 22.5])
    assert headers.ngff_level(g, "1")["coordinateTransformations"][0]["scale"] == [10, 10]
    assert headers.ngff_axes(g.frame)[0] == {"name": "y", "type": "space", "unit": "micrometer"}
    ms["datasets"][0]["coordinateTransformations"][0]["scale"][0] = 2
    with pytest.raises(ValueError):
        headers.ngff_grid(ms, (2, 4, 6))


def test_geotiff_and_cf():
    profile = {"crs": {"kind": "projected", "unit": "metre", "axes": ["E", "N"], "authority": "EPSG", "code": 32633}, "transform": (30, 0, 1000, 0, -30, 2000), "width": 4, "height": 3}
    g = headers.geotiff_grid(profile)
    np.testing.assert_allclose(g.point_at(row=0, column=0), [1015, 1985])
    assert g.frame.identifier == ("epsg", "32633") and g.transform.source.sample_offset == (0.5, 0.5)
    np.testing.assert_allclose(headers.geotiff_grid(profile, area_or_point="Point").point_at(row=0, column=0), [1000, 2000])
    with pytest.raises(ValueError):
        headers.geotiff_grid({**profile, "crs": {"kind": "geographic"}})
    cf = headers.cf_grid({"lon": {"values": [10.0, 20.0], "units": "degrees_west"}, "lat": {"values": [0.0, 1.0, 2.0], "units": "degrees_north", "bounds": [[-0.5, 0.5], [0.5, 1.5], [1.5, 2.5]]}})
    np.testing.assert_allclose(cf.points()[0, 0], [-10, 0])
    assert cf.dims == ("lat", "lon") and cf.axis("lat").intervals is not None and cf.frame.is_anonymous
    seam = headers.cf_grid({"lon": {"values": [0.0, 350.0], "units": "degrees_east", "bounds": [[355.0, 5.0], [345.0, 355.0]]}, "lat": {"values": [0.0], "units": "degrees_north"}})
    np.testing.assert_allclose(seam.intervals["lon"][0], [-5, 5])
    with pytest.raises(ValueError):
        headers.cf_grid({"lon": {"values": [0.0], "units": "degrees_east"}})


# Streams ---------------------------------------------------------------------------------------------


def surface(spark):
    frame = ReferenceFrame.declared("t", "plane", CoordinateSystem(("X", "Y"), ("mm", "mm")))
    t = AffineTransform.from_matrix(np.eye(2), source=ArrayCoordinates(("a", "b"), ("1", "1"), sample_offset=(0.5, 0.5)), target=frame, translation=[0, 0])
    g = Grid(t, {"a": ("a", np.arange(5)), "b": ("b", np.arange(4))})
    return frame_table(g.to_df(spark, coordinates=False).withColumn("value", (F.col("pos_a") + 10 * F.col("pos_b")).cast("double")), g)


def run(query):
    q = query.writeStream.format("memory").queryName("out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()


@pytest.mark.parametrize("method", ["nearest", "linear"])
def test_a_stream_of_points_samples_a_static_table(spark, tmp_path, method):
    rows = [(n, 0.3 * n, 0.2 * n) for n in range(16)]
    points = spark.createDataFrame(rows, "n long, X double, Y double")
    points.write.parquet(f"{tmp_path}/p")
    stream = spark.readStream.schema(points.schema).parquet(f"{tmp_path}/p")
    run(sample_at(stream, surface(spark), method=method, fill_value=-1.0))
    got = {r["n"]: r["value"] for r in spark.table("out").collect()}
    batch = {r["n"]: r["value"] for r in sample_at(points, surface(spark), method=method, fill_value=-1.0).collect()}
    assert got == batch
    for n, x, y in rows:
        inside = x <= 4 and y <= 3
        want = x + 10 * y if method == "linear" else math.floor(x + 0.5) + 10 * math.floor(y + 0.5)
        assert got[n] == pytest.approx(want if inside else -1)


def test_event_time_averages(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 3.0), ("b", "2024-01-01 01:10:00", 5.0), ("a", "2024-01-02 00:00:00", 7.0)], "k string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e")
    run(window_average(stream, time="ts", value="value", keys=["k"], width="1 hour"))
    got = sorted((r["k"], r["mean"], r["n"]) for r in spark.table("out").collect())
    assert got == [("a", 2.0, 2), ("b", 5.0, 1)]
