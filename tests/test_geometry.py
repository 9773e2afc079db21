"""Declarations, point maps, grids and positions against NumPy."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framegrid.functions import tensors, transforms, units
from framegrid.functions.fields import BSPLINE, DISPLACEMENT, BSplineTransform, DisplacementFieldTransform, PositionFieldTransform, field_map, sample_displacement_field
from framegrid.functions.transforms import AffineTransform, CartesianToGeodetic, CartesianToSpherical, GeodeticToCartesian, SphericalToCartesian, compose
from framegrid.operators.diagnostics import AffineClass, affine_class
from framegrid.plans import anatomy, encoding
from framegrid.plans.declare import ArrayCoordinates, CoordinateSystem, DirectionVocabulary, ReferenceFrame
from framegrid.plans.grid import Grid, pos
from framegrid.plans.sampling import Axis

XYZ = CoordinateSystem(("x", "y", "z"), ("mm",) * 3)


def frame(name="f", system=XYZ):
    return ReferenceFrame.declared("test", name, system)


def volume_grid(offset=0.5):
    source = ArrayCoordinates(("k", "j", "i"), ("1",) * 3, sample_offset=(offset,) * 3)
    c, s = math.cos(0.3), math.sin(0.3)
    m = np.array([[0, -s, c], [0, c, s], [1, 0, 0]]) * np.array([2.0, 0.5, 0.5])
    t = AffineTransform.from_matrix(m, source=source, target=frame(system=anatomy.patient_coordinate_system()), translation=[1, 2, 3])
    return Grid(t, {"k": ("k", np.arange(8)), "j": ("j", np.arange(10)), "i": ("i", np.arange(12))})


# Declarations -----------------------------------------------------------------------------------------


def test_directions_are_explicit_and_paired():
    v = DirectionVocabulary("v", ["west-to-east", "down-to-up"])
    assert v.opposite("west-to-east") == "east-to-west"
    for bad in (["RAI"], ["a-to-a"], ["a-to-b", "b-to-a"], []):
        with pytest.raises(ValueError):
            DirectionVocabulary("v", bad)


@pytest.mark.parametrize(
    "args",
    [
        dict(axes=("x", "x"), units=("m", "m")),
        dict(axes=("x",), units=("deg",)),
        dict(axes=("x",), units=("m",), orientation=("left-to-right",)),
        dict(axes=("a", "b"), units=("deg", "deg"), representation="spherical", axis_roles=("longitude", "longitude")),
        dict(axes=("a", "b"), units=("m", "deg"), representation="geodetic", axis_roles=("longitude", "latitude")),
        dict(axes=("x",), units=()),
    ],
)
def test_ambiguous_systems_are_refused(args):
    with pytest.raises(ValueError):
        CoordinateSystem(args.pop("axes"), args.pop("units"), **args)


def test_frames_compare_by_identity_and_typed_metadata():
    a, b = frame("a"), frame("b")
    assert a != b and a == frame("a")
    c = lambda v: ReferenceFrame.declared("n", "x", XYZ, context={"c": v})
    assert c(1) != c(True) and c(1).conflicts_with(c(1.0)) and not c(1).is_equivalent_frame(c(1.0))
    assert ReferenceFrame.anonymous(XYZ) != ReferenceFrame.anonymous(XYZ)
    assert a.is_equivalent_frame(a.with_coordinate_system(CoordinateSystem(("u", "v", "w"), ("mm",) * 3)))
    with pytest.raises(ValueError):
        ReferenceFrame.declared("local", "x", XYZ)


def test_axis_codes():
    s = anatomy.patient_coordinate_system("LPS")
    codes = s.axis_codes([0.1, -3, 0.0])
    assert (codes[0].axis, codes[0].direction) == ("y", "posterior-to-anterior")
    assert codes[0].angle == pytest.approx(math.degrees(math.atan2(0.1, 3)))


# Maps ------------------------------------------------------------------------------------------------


def columns_equal(spark, transform, points, tol=1e-9):
    names = [f"c{k}" for k in range(points.shape[1])]
    df = spark.createDataFrame([[int(n), *map(float, p)] for n, p in enumerate(points)], ["n", *names])
    out = df.select("n", *[c.alias(f"o{k}") for k, c in enumerate(transforms.columns_of(transform, [F.col(c) for c in names]))]).orderBy("n").collect()
    got = np.array([list(r)[1:] for r in out])
    np.testing.assert_allclose(got, transform.transform_point(points), atol=tol, rtol=1e-12)


def test_affine_columns_composition_and_inverse(spark):
    rng = np.random.default_rng(1)
    a = AffineTransform.from_matrix(rng.normal(size=(3, 3)), source=frame("a"), target=frame("b"), translation=rng.normal(size=3))
    b = AffineTransform.from_matrix(rng.normal(size=(3, 3)), source=frame("b"), target=frame("c"), translation=rng.normal(size=3))
    p = rng.normal(size=(20, 3))
    ab = compose(a, b)
    assert type(ab) is AffineTransform
    np.testing.assert_allclose(ab.transform_point(p), b.transform_point(a.transform_point(p)))
    np.testing.assert_allclose(ab.inverse().transform_point(ab.transform_point(p)), p)
    columns_equal(spark, ab, p)
    with pytest.raises(ValueError):
        compose(b, a)
    flat = AffineTransform.from_matrix(np.zeros((3, 3)), source=frame("a"), target=frame("b"), translation=[0] * 3)
    with pytest.raises(ValueError):
        flat.inverse()
    assert transforms.transform_named(a, {"x": 1, "y": [2, 3], "z": 0})["x"].shape == (2,)


def test_conditioning_is_judged_after_scaling():
    m = np.diag([1e-200, 1.0, 1e200])
    np.testing.assert_allclose(np.diag(transforms.equilibrated_inverse(m)), [1e200, 1, 1e-200])
    with pytest.raises(ValueError):
        transforms.equilibrated_inverse([[1, 1], [1, 1 + 1e-16]])


SPHERE = ReferenceFrame.declared("t", "s", CoordinateSystem(("lon", "lat", "r"), ("deg", "deg", "pc"), representation="spherical", axis_roles=("longitude", "latitude", "radius")))
GEO = ReferenceFrame.declared("t", "g", CoordinateSystem(("lat", "lon", "h"), ("rad", "deg", "m"), representation="geodetic", axis_roles=("latitude", "longitude", "height")))


@pytest.mark.parametrize(
    ("forward", "points"),
    [
        (SphericalToCartesian(SPHERE, SPHERE.with_coordinate_system(CoordinateSystem(("x", "y", "z"), ("pc",) * 3))), [[10, 20, 3], [350, -89, 1], [0, 90, 2]]),
        (GeodeticToCartesian(GEO, GEO.with_coordinate_system(CoordinateSystem(("x", "y", "z"), ("m",) * 3))), [[0.5, 10, 100], [-1.5, 200, -5000], [math.pi / 2, 0, 7]]),
    ],
)
def test_charts_there_and_back(spark, forward, points):
    p = np.array(points, float)
    q = forward.transform_point(p)
    columns_equal(spark, forward, p, 1e-6)
    back = forward.inverse()
    assert isinstance(back, CartesianToSpherical | CartesianToGeodetic)
    np.testing.assert_allclose(back.transform_point(q), p, atol=1e-8)
    columns_equal(spark, back, q, 1e-7)
    h, at = 1e-6, p[:1]
    numeric = np.stack([(forward.transform_point(at + h * e) - forward.transform_point(at - h * e))[0] / (2 * h) for e in np.eye(3)], -1)
    np.testing.assert_allclose(forward.jacobian(at)[0], numeric, rtol=1e-5, atol=1e-2)
    rows = forward.local_frame(p[:2])
    np.testing.assert_allclose(rows @ np.swapaxes(rows, -1, -2), np.broadcast_to(np.eye(3), rows.shape), atol=1e-12)


def test_longitudes_start_where_they_are_told():
    back = CartesianToSpherical(SPHERE.with_coordinate_system(CoordinateSystem(("x", "y", "z"), ("pc",) * 3)), SPHERE, longitude_start=-180)
    assert back.transform_point([[0, -1, 0]])[0, 0] == -90


def test_latitude_beyond_the_pole_and_depths_are_refused():
    g = GeodeticToCartesian(GEO, GEO.with_coordinate_system(CoordinateSystem(("x", "y", "z"), ("m",) * 3)))
    for p in ([2.0, 0, 0], [0, 0, -7e6]):
        with pytest.raises(ValueError):
            g.transform_point([p])


class Square:
    """A user's map: NumPy only."""

    source, target = frame("a"), frame("b")

    def transform_point(self, points):
        return np.asarray(points) ** 2

    def jacobian(self, at):
        return np.einsum("...i,ij->...ij", 2 * np.asarray(at), np.eye(3))


def test_a_users_map_runs_in_arrow_batches(spark):
    a = AffineTransform.from_matrix(np.eye(3) * 2, source=frame("b"), target=frame("c"), translation=[1, 0, 0])
    columns_equal(spark, compose(Square(), a), np.arange(12.0).reshape(4, 3))


def test_declared_inverses():
    a = AffineTransform.from_matrix(np.eye(3) * 2, source=frame("a"), target=frame("b"), translation=[1, 0, 0])
    b = AffineTransform.from_matrix(np.eye(3) * 0.4, source=frame("b"), target=frame("a"), translation=[0, 0, 0])
    pair = transforms.DeclaredInversePair(a, b).forward
    assert not hasattr(pair, "inverse") and pair.declared_inverse().declared_inverse() == pair
    chain = compose(pair, AffineTransform.from_matrix(np.eye(3), source=frame("b"), target=frame("c"), translation=[1, 1, 1]))
    np.testing.assert_allclose(chain.declared_inverse().transform_point([[2, 2, 2]]), [[0.4] * 3])


def test_coordinate_system_changes():
    lps = frame("p", anatomy.patient_coordinate_system("LPS"))
    ras = lps.with_coordinate_system(anatomy.patient_coordinate_system("RAS"))
    np.testing.assert_array_equal(transforms.coordinate_system_change(lps, ras).matrix, np.diag([-1, -1, 1]))
    with pytest.raises(ValueError):
        transforms.coordinate_system_change(lps, frame("q", ras.coordinate_system))
    with pytest.raises(ValueError):
        transforms.coordinate_system_change(lps, lps.with_coordinate_system(anatomy.patient_coordinate_system("RAS", "cm")))


# Axes and grids ---------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=2, max_size=12, unique=True), st.booleans(), st.lists(st.floats(-150, 150), max_size=10))
def test_positions_and_coordinates_are_inverse(values, down, points):
    v = np.array(sorted(values, reverse=down))
    if np.abs(np.diff(v)).min() < 1e-6:
        return
    axis = Axis("a", "a", v)
    p = axis.positions(np.array(points), outside="extrapolate")
    np.testing.assert_allclose(axis.coordinates(p), points, atol=1e-6, rtol=1e-9)
    np.testing.assert_array_equal(axis.coordinates(np.arange(len(v))), v)
    inside = (np.array(points) >= v.min()) & (np.array(points) <= v.max())
    assert (~np.isnan(axis.positions(np.array(points))) >= inside).all()


@pytest.mark.parametrize("values", [[0, 1, 2, 3], [10.0, 8.0, 5.0, 1.0], [0.0, 2.0, 5.0, 5.5, 100.0], [3.0]])
def test_position_columns(spark, values):
    axis = Axis("a", "a", np.array(values), 0.5 if len(values) > 1 else None)
    c = np.concatenate((np.linspace(min(values) - 3, max(values) + 3, 41), np.array(values, float)))
    df = spark.createDataFrame([(n, float(x)) for n, x in enumerate(c)], "n long, c double")
    for domain, outside in (("samples", "nan"), ("cells", "nan"), ("samples", "extrapolate")):
        if len(values) == 1 and outside == "extrapolate":
            continue
        got = [r[0] for r in df.orderBy("n").select(axis.position_column(F.col("c"), domain=domain, outside=outside)).collect()]
        np.testing.assert_allclose(got, axis.positions(c, domain=domain, outside=outside), atol=1e-12)
    if len(values) > 1:
        p = np.linspace(-1, len(values), 23)
        df = spark.createDataFrame([(n, float(x)) for n, x in enumerate(p)], "n long, p double")
        got = [r[0] for r in df.orderBy("n").select(axis.coordinate_column(F.col("p"))).collect()]
        np.testing.assert_allclose(got, axis.coordinates(p), atol=1e-12)


def test_cells_of_descending_axes_reach_backwards():
    assert Axis("a", "a", np.array([3, 2, 1]), 0.25).extent() == (0.75, 0.25)
    assert Axis("a", "a", np.array([1, 2, 3]), 0.25).extent() == (0.25, 0.75)
    with pytest.raises(ValueError):
        Axis("a", "a", np.array([1]), 0.5).extent()
    assert Axis("a", "a", np.array([1.0]), 0.5, [[0, 2]]).extent() == (0.5, 0.5)


@pytest.mark.parametrize("cells", [[[0, 1], [2, 1]], [[0, 1], [0.5, 0.9]], [[0, 1], [1, np.inf]], [[0, 1]]])
def test_bad_intervals_are_refused(cells):
    with pytest.raises(ValueError):
        Axis("a", "a", np.array([0.5, 1.5]), None, cells)


@pytest.mark.parametrize("values", [np.array([True]), np.array(["a"]), np.array([1j]), np.array(["2020"], "datetime64[D]")])
def test_coordinates_are_real_numbers(values):
    with pytest.raises(TypeError):
        Axis("a", "a", values)


def test_grid_points_positions_and_table(spark):
    g = volume_grid()
    p = g.points()
    np.testing.assert_allclose(p[2, 3, 4], g.point_at(k=2, j=3, i=4))
    index = np.array([[2.5, 3.25, 4], [0, 0, 0], [7, 9, 11]])
    np.testing.assert_allclose(g.positions_at(g.points_at(index)), index, atol=1e-9)
    with pytest.raises(ValueError):
        g.points_at([[-0.4, 0, 0]])
    g.points_at([[-0.4, 0, 0]], domain="cells")
    rows = g.to_df(spark, points=True).orderBy("pos_k", "pos_j", "pos_i").collect()
    assert len(rows) == 960
    np.testing.assert_allclose([[r["x"], r["y"], r["z"]] for r in rows], p.reshape(-1, 3), atol=1e-9)
    lattice = g.lattice()
    np.testing.assert_allclose(lattice.spacing, [2, 0.5, 0.5])
    np.testing.assert_allclose(lattice.transform_point(index), g.points_at(index))
    df = spark.createDataFrame(p.reshape(-1, 3)[::37].tolist(), ["x", "y", "z"])
    got = df.select(*[c.alias(d) for d, c in g.position_columns([F.col(c) for c in "xyz"]).items()]).collect()
    np.testing.assert_allclose([list(r) for r in got], g.positions_at(p.reshape(-1, 3)[::37]), atol=1e-9)


def test_selection_keeps_points():
    g = volume_grid()
    s = g.isel(k=3, j=slice(8, 1, -2), i=[5, 0])
    assert s.dims == ("j", "i") and dict(s.sizes) == {"j": 4, "i": 2}
    np.testing.assert_allclose(s.points()[1, 0], g.point_at(k=3, j=6, i=5))
    assert g.sel(j=slice(2, 4)).sizes["j"] == 3
    with pytest.raises(KeyError):
        s.sel(k=3)
    with pytest.raises(IndexError):
        g.isel(k=8)
    assert g.transpose("i", "j", "k").is_coincident(g.transpose("i", "j", "k")) and not g.is_coincident(s)
    moved = Grid(g.transform.with_endpoints(), {"k": ("k", np.arange(8) + 1e-8), "j": ("j", np.arange(10)), "i": ("i", np.arange(12))})
    assert g.is_coincident(moved) and g != moved


def test_orientation_reorientation_and_cardinal_targets():
    source = ArrayCoordinates(("k", "j", "i"), ("1",) * 3, sample_offset=(0.5,) * 3)
    t = AffineTransform.from_matrix([[0, 0, 1], [0, 1, 0], [3, 0, 0]], source=source, target=frame("p", anatomy.patient_coordinate_system()), translation=[-2.5, -2, 0])
    k = np.arange(4)
    g = Grid(t, {"k": ("k", k), "j": ("j", np.arange(5)), "i": ("i", np.arange(6))})
    assert anatomy.orientation_codes(g) == "SPL"
    r = anatomy.reoriented(g, "RIP")
    assert anatomy.orientation_codes(r) == "RIP"
    assert {tuple(x) for x in r.points().reshape(-1, 3)} == {tuple(x) for x in g.points().reshape(-1, 3)}
    c = anatomy.cardinal_grid(g, "sagittal", spacing=1.0)
    assert anatomy.orientation_codes(c) == "RIP" and dict(c.sizes) == {"k": 6, "j": 12, "i": 5}
    with pytest.raises(ValueError):
        anatomy.tokens("LR")


def test_affine_classes():
    c, s = math.cos(1), math.sin(1)
    h = lambda m, t=(0, 0): np.block([[np.array(m, float), np.array(t, float)[:, None]], [np.zeros((1, 2)), np.ones((1, 1))]])
    cases = [(h(np.eye(2)), "IDENTITY"), (h(np.eye(2), (1, 0)), "TRANSLATION"), (h([[c, -s], [s, c]]), "RIGID"), (h([[2 * c, -2 * s], [2 * s, 2 * c]]), "SIMILARITY"), (h([[1, 1], [0, 1]]), "AFFINE"), (h([[-1, 0], [0, 1]]), "AFFINE")]
    assert [affine_class(m).name for m, _ in cases] == [n for _, n in cases]
    assert AffineClass.RIGID.at_most(AffineClass.SIMILARITY)


# Fields ------------------------------------------------------------------------------------------------


def plane_grid(n=8):
    f = ReferenceFrame.declared("t", "plane", CoordinateSystem(("x", "y"), ("mm",) * 2))
    t = AffineTransform.from_matrix([[0.5, 0], [0, 2.0]], source=ArrayCoordinates(("a", "b"), ("1", "1"), sample_offset=(0.5, 0.5)), target=f, translation=[1, -1])
    return Grid(t, {"a": ("a", np.arange(n)), "b": ("b", np.arange(n))})


@pytest.mark.parametrize("make", [DisplacementFieldTransform, BSplineTransform])
def test_field_jacobians_and_table_form(spark, make):
    rng = np.random.default_rng(2)
    g = plane_grid()
    field = make(g, rng.normal(size=(8, 8, 2)) * 0.1, exterior="identity")
    p = g.points_at(rng.uniform(1.05, 5.9, size=(40, 2)))
    h = 1e-6
    numeric = np.stack([(field.transform_point(p + h * e) - field.transform_point(p - h * e)) / (2 * h) for e in np.eye(2)], -1)
    np.testing.assert_allclose(field.jacobian(p), numeric, atol=1e-6)
    far = np.array([[100.0, 100.0]])
    np.testing.assert_array_equal(field.transform_point(far), far)
    nodes = spark.createDataFrame([(a, b, *map(float, field.values[a, b])) for a in range(8) for b in range(8)], "pos_a long, pos_b long, ux double, uy double")
    every = np.concatenate((p, far))
    pts = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(every)], "n long, x double, y double")
    kind = DISPLACEMENT if field.kind == DISPLACEMENT else BSPLINE
    for nodes_in_array in (0, 1000):
        out = field_map(pts, nodes, g, keys=["n"], components=["ux", "uy"], kind=kind, exterior="identity", array_nodes=nodes_in_array).orderBy("n").collect()
        np.testing.assert_allclose([[r["x"], r["y"]] for r in out], field.transform_point(every), atol=1e-9)
        assert [r["inside"] for r in out] == [True] * 40 + [False]
    with pytest.raises(Exception, match="lacks nodes"):
        field_map(pts, nodes.filter("pos_a <> 3"), g, keys=["n"], components=["ux", "uy"], kind=kind, exterior="identity").collect()


def test_field_supports_and_exteriors():
    g = plane_grid()
    u = np.ones((8, 8, 2))
    assert DisplacementFieldTransform(g, u).transform_point(g.points_at([[-0.5, 0]], domain="cells"))[0, 0] == pytest.approx(0.75 + 1)
    with pytest.raises(ValueError):
        DisplacementFieldTransform(g, u).transform_point(g.points_at([[7.5, 0]], domain="cells"))
    with pytest.raises(ValueError):
        BSplineTransform(g, u).transform_point(g.points_at([[0.9, 3]]))
    near = DisplacementFieldTransform(g, u, exterior="nearest").transform_point([[1000.0, 0]])
    np.testing.assert_allclose(near, [[1001, 1]])
    with pytest.raises(ValueError):
        PositionFieldTransform(g, u, target=g.frame, exterior="nearest")
    positions = PositionFieldTransform(g, g.points() * 3, target=g.frame)
    np.testing.assert_allclose(positions.transform_point([[2.0, 4.0]]), [[6, 12]])
    t = AffineTransform.from_matrix(np.eye(2) * 2, source=g.frame, target=g.frame, translation=[0, 1])
    sampled = sample_displacement_field(t, g)
    p = g.points_at([[2.3, 4.7]])
    np.testing.assert_allclose(sampled.transform_point(p), t.transform_point(p))


# Tensors -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", [tensors.VECTOR, tensors.COVECTOR, tensors.SECOND_ORDER_CONTRAVARIANT_TENSOR, tensors.SYMMETRIC_SECOND_ORDER_COVARIANT_TENSOR, tensors.CROSS_PRODUCT_PSEUDOVECTOR, tensors.TWO_FORM_DUAL_PSEUDOVECTOR])
@pytest.mark.parametrize("constant", [True, False])
def test_tensor_law(spark, kind, constant):
    rng = np.random.default_rng(4)
    j = rng.normal(size=(3, 3))
    v = rng.normal(size=(3,) * kind.order)
    want = tensors.transform_tensor_components(v, j, kind)
    df = spark.createDataFrame([(v.tolist(), j.ravel().tolist())], "v array<double>, j array<double>" if kind.order == 1 else "v array<array<double>>, j array<double>")
    m = j.tolist() if constant else [[F.col("j")[3 * a + b] for b in range(3)] for a in range(3)]
    got = np.array(df.select(tensors.tensor_columns(F.col("v"), m, kind)).first()[0])
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_cross_products_and_contractions_are_respected():
    rng = np.random.default_rng(5)
    j, a, b = rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    law = lambda v, k: tensors.transform_tensor_components(v, j, k)
    cross = law(np.cross(a, b), tensors.CROSS_PRODUCT_PSEUDOVECTOR)
    np.testing.assert_allclose(cross, np.cross(law(a, tensors.VECTOR), law(b, tensors.VECTOR)), rtol=1e-8)
    np.testing.assert_allclose(law(a, tensors.VECTOR) @ law(b, tensors.COVECTOR), a @ b)
    with pytest.raises(ValueError):
        law(a, tensors.ORTHOGONAL_PSEUDOVECTOR)
    q = tensors.polar_orthogonal_factor(j)
    np.testing.assert_allclose(q @ q.T, np.eye(3), atol=1e-12)


def test_packing_round_trips(spark):
    m = np.array([[1, 2, 3], [2, 4, 5], [3, 5, 6]], float)
    df = spark.createDataFrame([(m.tolist(),)], "m array<array<double>>")
    for p in (tensors.SymmetricPacking.voigt(), tensors.SymmetricPacking.mandel(), tensors.SymmetricPacking.upper_triangular(), tensors.SymmetricPacking.lower_triangular()):
        packed = df.select(p.pack(F.col("m")).alias("p"))
        assert np.allclose(packed.select(p.unpack(F.col("p"))).first()[0], m)
    mandel = tensors.SymmetricPacking.mandel()
    row = np.array(df.select(mandel.pack(F.col("m"))).first()[0])
    assert row @ row == pytest.approx((m * m).sum())
    assert tensors.SymmetricPacking.voigt().labels("xyz") == ["xx", "yy", "zz", "yz", "xz", "xy"]


def test_units(spark):
    assert units.canonical("millimetres") == "mm" and units.canonical("furlong") == "furlong" and units.udunits_name("µm") == "micrometer"
    df = spark.createDataFrame([("second",), ("zork",), (None,)], "u string")
    assert [r[0] for r in df.select(units.canonical_column(F.col("u"))).collect()] == ["s", "zork", None]


# Encoding -----------------------------------------------------------------------------------------------


def test_values_round_trip():
    g = plane_grid()
    charts = SphericalToCartesian(SPHERE, SPHERE.with_coordinate_system(CoordinateSystem(("x", "y", "z"), ("pc",) * 3)))
    a = AffineTransform.from_matrix(np.eye(3), source=charts.target, target=frame("q"), translation=[1, 2, 3])
    field = DisplacementFieldTransform(g, np.random.default_rng(0).normal(size=(8, 8, 2)))
    pair = transforms.DeclaredInversePair(a, a.inverse()).backward
    for value in (volume_grid(), g, charts, charts.inverse(), compose(charts, a), pair, field, tensors.CROSS_PRODUCT_PSEUDOVECTOR, tensors.SymmetricPacking.mandel(), anatomy.PATIENT, frame()):
        text = encoding.encode(value)
        assert encoding.decode(text) == value and encoding.encode(encoding.decode(text)) == text
    arrays = {}
    big = DisplacementFieldTransform(plane_grid(40), np.zeros((40, 40, 2)))
    text = encoding.encode(big, arrays=arrays)
    assert len(arrays) == 1 and next(iter(arrays)).startswith("sha256:") and encoding.decode(text, arrays=arrays) == big
    with pytest.raises(encoding.MissingArrayError):
        encoding.decode(text)
    with pytest.raises(encoding.MalformedDataError):
        encoding.decode(text, arrays={k: v + 1 for k, v in arrays.items()})


def test_reading_is_strict():
    good = json.loads(encoding.encode(frame()))
    cases = [("{", encoding.MalformedDataError), (json.dumps({**good, "schema_version": 9}), encoding.UnsupportedVersionError), (json.dumps({**good, "value": {"kind": "zork"}}), encoding.UnknownKindError), (json.dumps({**good, "value": {"kind": "me:zork"}}), encoding.MissingDecoderError), (json.dumps({**good, "value": {"kind": "affine"}}), encoding.MalformedDataError)]
    for text, error in cases:
        with pytest.raises(error):
            encoding.decode(text)
    with pytest.raises(encoding.DecoderResultError):
        encoding.decode(json.dumps({**good, "value": {"kind": "me:x"}}), decoders={"me:x": lambda d: None})
    assert encoding.decode(json.dumps({**good, "value": {"kind": "me:x", "data": 5}}), decoders={"me:x": lambda d: d}) == 5


def test_position_column_names():
    assert pos("k") == "pos_k"
