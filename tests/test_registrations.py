"""Transform files of numbers and images, relations between frames, and directions of east, north and up."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegrid.functions.tensors import EastNorthUp
from framegrid.functions.transforms import GeodeticToCartesian, SphericalToCartesian
from framegrid.plans.anatomy import patient_frame
from framegrid.plans.declare import CoordinateSystem, ReferenceFrame
from framegrid.sources import headers, transform_files
from framegrid.sources.registrations import checked_matrix, equipment_transform, registrations

FIXED, MOVING = transform_files.lps_frame("fixed"), transform_files.lps_frame("moving")


def mat(order="<", **matrices):
    return b"".join(struct.pack(f"{order}5i", 1000 * (order == ">"), len(v), 1, 0, len(k) + 1) + k.encode() + b"\0" + struct.pack(f"{order}{len(v)}d", *v) for k, v in matrices.items())


@pytest.mark.parametrize("order", "<>")
def test_mat_files(tmp_path, order):
    data = mat(order, AffineTransform_double_3_3=[2, 0, 0, 0, 1, 0, 0, 0, 1, 5, 6, 7], fixed=[1, 0, 0])
    (tmp_path / "a.mat").write_bytes(data)
    t = transform_files.read_itk_transform(f"{tmp_path}/a.mat", fixed=FIXED, moving=MOVING)
    np.testing.assert_allclose(t.transform_point([[3, 1, 1]]), [[2 * (3 - 1) + 1 + 5, 7, 8]])
    for bad in (data[:-4], b"x" * 40, mat(order, fixed=[0, 0, 0]), mat(order, AffineTransform_double_3_3=[np.nan] * 12, fixed=[0, 0, 0]), mat(order, AffineTransform_double_2_2=[1.0] * 6, fixed=[0, 0])):
        with pytest.raises(ValueError):
            transform_files.itk_mat_transform(bad, fixed=FIXED, moving=MOVING)


def image(v, spacing=2.0):
    """Displacements (z, y, x, component) with nodes from the origin of RAS."""
    z, y, x, n = v.shape
    head = {"dim": [5, x, y, z, 1, n, 1, 1], "pixdim": [1.0, spacing, spacing, spacing, 1, 1, 0, 0], "xyzt_units": 2, "sform_code": 1, "qform_code": 0,
            "srow_x": [spacing, 0, 0, 0], "srow_y": [0, spacing, 0, 0], "srow_z": [0, 0, spacing, 0]}
    raw = bytearray(headers.build_nifti_header(head))
    raw[70:74] = struct.pack("<2h", 64, 64)
    raw[108:120] = struct.pack("<3f", 352, 1, 0)
    return bytes(raw) + b"\0" * 4 + np.moveaxis(v, -1, 0).astype("<f8").tobytes()


def test_displacement_images(tmp_path):
    v = np.random.default_rng(2).normal(size=(3, 4, 5, 3))
    (tmp_path / "w.nii.gz").write_bytes(gzip.compress(image(v)))
    t = transform_files.read_itk_transform(f"{tmp_path}/w.nii.gz", fixed=FIXED, moving=MOVING)
    # Node (x, y, z) = (3, 1, 2) lies at RAS (6, 2, 4), LPS (-6, -2, 4).
    node = np.array([-6.0, -2.0, 4.0])
    np.testing.assert_allclose(t.transform_point([node]), [node + v[2, 1, 3]])
    np.testing.assert_allclose(t.transform_point([node + [1, 0, 0]]), [node + [1, 0, 0] + (v[2, 1, 3] + v[2, 1, 2]) / 2])
    np.testing.assert_allclose(t.transform_point([[50.0, 0, 0]]), [[50, 0, 0]])
    flat = transform_files.displacement_image(image(v[:1, :, :, :2]), fixed=transform_files.lps_frame("a", 2), moving=transform_files.lps_frame("b", 2))
    np.testing.assert_allclose(flat.transform_point([[-4.0, -2.0]]), [[-4, -2] + v[0, 1, 2, :2]])
    with pytest.raises(ValueError):
        transform_files.displacement_image(image(v[..., :2]), fixed=FIXED, moving=MOVING)
    with pytest.raises(ValueError):
        transform_files.itk_transform("#Insight Transform File V1.0\n" + "Transform: TranslationTransform_double_3_3\nParameters: 1 0 0\n" * 2, fixed=FIXED, moving=MOVING)


TURN = [0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1]
SHIFT = [1, 0, 0, 10, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]


def entry(values, kind="RIGID"):
    return {"FrameOfReferenceTransformationMatrix": values, "FrameOfReferenceTransformationMatrixType": kind}


def item(*entries, uid="1.1"):
    return {"FrameOfReferenceUID": uid, "MatrixRegistrationSequence": [{"MatrixSequence": list(entries)}]}


def test_registrations():
    one, two = registrations({"FrameOfReferenceUID": "1.9", "RegistrationSequence": [item(entry(TURN), entry(SHIFT)), item(entry(np.diag([2, 3, 4, 1]).ravel(), "RIGID_SCALE"), uid="1.2")]})
    assert one.source == patient_frame("1.1") and two.source == patient_frame("1.2") and one.target == two.target == patient_frame("1.9")
    # The shift acts first.
    np.testing.assert_allclose(one.transform_point([[1, 0, 0]]), [[1, 11 + 2, 3]])
    for bad in (
        {"RegistrationSequence": [item(entry(TURN))]}, {"FrameOfReferenceUID": "1.9"}, {"FrameOfReferenceUID": "1.9", "RegistrationSequence": [item(entry(TURN), uid=None)]},
        {"FrameOfReferenceUID": "1.9", "RegistrationSequence": [item()]}, {"FrameOfReferenceUID": "1.9", "RegistrationSequence": [item(entry(TURN, "BENT"))]},
        {"FrameOfReferenceUID": "1.9", "RegistrationSequence": [], "SOPClassUID": "1.2.840.10008.5.1.4.1.1.66.3"},
    ):
        with pytest.raises(ValueError):
            registrations(bad)
    for values, kind in (([1.0] * 15, "AFFINE"), (np.diag([2.0, 1, 1, 1]), "RIGID"), (np.diag([-1.0, 1, 1, 1]), "RIGID"), (np.diag([1.0, 1, 1, 2]), "AFFINE"), (np.diag([0.0, 1, 1, 1]), "RIGID_SCALE")):
        with pytest.raises(ValueError):
            checked_matrix(values, kind)


def test_equipment():
    assert equipment_transform({}) is None
    given = {"ImageToEquipmentMappingMatrix": TURN, "EquipmentCoordinateSystemIdentification": "ISOCENTER", "FrameOfReferenceUID": "1.1", "Manufacturer": "m"}
    a, b = equipment_transform(given), equipment_transform(given)
    np.testing.assert_allclose(a.transform_point([[1, 0, 0]]), [[1, 3, 3]])
    assert a.source == patient_frame("1.1") and a.target != b.target and dict(a.target.definition)["Manufacturer"] == "m"
    for bad in ({**given, "EquipmentCoordinateSystemIdentification": "TABLE"}, {**given, "FrameOfReferenceUID": None}):
        with pytest.raises(ValueError):
            equipment_transform(bad)


def test_directions(spark):
    axes, units, roles = ("longitude", "latitude", "radius"), ("degrees_east", "degrees_north", "m"), ("longitude", "latitude", "radius")
    ball = ReferenceFrame.declared("t", "ball", CoordinateSystem(axes, units, representation="spherical", axis_roles=roles))
    centred = ReferenceFrame.declared("t", "centred", CoordinateSystem(("x", "y", "z"), ("m",) * 3))
    enu = EastNorthUp(ball)
    df = spark.createDataFrame([(90.0, 0.0, 1.0), (0.0, 90.0, 1.0)], ["lon", "lat", "r"])
    cols = enu.directions([F.col("lon"), F.col("lat"), F.col("r")])
    got = np.array([[list(r)] for r in df.select(*[c.alias(f"c{i}{k}") for i, row in enumerate(cols) for k, c in enumerate(row)]).collect()]).reshape(2, 3, 3)
    np.testing.assert_allclose(got[0].T, [[-1, 0, 0], [0, 0, 1], [0, 1, 0]], atol=1e-12)
    np.testing.assert_allclose(got[1].T, [[0, 1, 0], [-1, 0, 0], [0, 0, 1]], atol=1e-12)
    chart = SphericalToCartesian(ball, centred)
    assert enu.matches(chart) and enu.matches(chart.inverse()) and not enu.matches(None) and not EastNorthUp(centred).matches(chart)
    assert not enu.matches(GeodeticToCartesian)


def test_cf_figures_and_units():
    figure = headers.cf_figure
    assert figure(None) is None and figure({"grid_mapping_name": "latitude_longitude"}) is None
    assert figure({"grid_mapping_name": "latitude_longitude", "earth_radius": 6.0}) == {"semi_major_axis": 6.0, "inverse_flattening": 0.0}
    assert figure({"grid_mapping_name": "latitude_longitude", "semi_major_axis": 10.0, "semi_minor_axis": 9.0})["inverse_flattening"] == 10
    for bad in ({"grid_mapping_name": "mercator"}, {"longitude_of_prime_meridian": 2.3}, {"semi_major_axis": 9.0, "semi_minor_axis": 10.0}, {"semi_major_axis": -1.0},
                {"semi_major_axis": 10.0, "semi_minor_axis": 9.0, "inverse_flattening": 300.0}):
        with pytest.raises(ValueError):
            figure({"grid_mapping_name": "latitude_longitude", **bad})
    lat = {"values": [0.0, 0.1], "units": "radians", "standard_name": "latitude"}
    lon = {"values": [0.0, 3.0], "units": "rad", "standard_name": "longitude", "bounds": [[-1.5, 1.5], [-1.8, 1.5]]}
    g = headers.cf_grid({"lon": lon, "lat": lat}, figure={"semi_major_axis": 10.0, "inverse_flattening": 10.0})
    assert g.frame.units == ("rad", "rad") and g.frame.coordinate_system.representation == "geodetic"
    with pytest.raises(ValueError):
        headers.cf_grid({"lon": lon, "lat": {**lat, "units": "K"}})


def test_cf_tables(spark):
    from framegrid.sources.cf_tables import cf_table

    df = spark.createDataFrame([(t, x, y, t + 10.0 * x + y) for t in range(2) for x in (350.0, 0.0, 10.0) for y in (-1.0, 1.0)], "time long, lon double, lat float, value double")
    cells = {"lon": {350.0: (345.0, 355.0), 0.0: (355.0, 5.0), 10.0: (5.0, 15.0)}}
    attributes = {"lon": {"units": "degrees_east"}, "lat": {"units": "degrees_north"}}
    out = cf_table(df, attributes, carried=("time",), bounds=cells, grid_mapping={"grid_mapping_name": "latitude_longitude", "earth_radius": 6371229.0})
    assert out.grid.sizes == {"lat": 2, "lon": 3} and out.df.count() == 12 and out.grid.frame.coordinate_system.representation == "spherical"
    np.testing.assert_allclose(out.grid.intervals["lon"], [[-5, 5], [5, 15], [345, 355]])
    assert out.df.filter("pos_lon = 2 and lon <> 350 or pos_lat = 0 and lat <> -1").count() == 0
    with pytest.raises(ValueError):
        cf_table(df, attributes, bounds={"lon": {350.0: (345.0, 355.0)}})
