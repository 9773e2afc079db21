"""Framed tables: what keeps, drops or refuses the declaration; resampling against NumPy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.functions import tensors
from framegrid.functions.transforms import AffineTransform
from framegrid.operators import boxes
from framegrid.operators.components import declare_components, resample_components
from framegrid.operators.cubic import prefilter
from framegrid.operators.diagnostics import coincidence
from framegrid.operators.framed import AlignmentError, FramedDF, frame_columns, frame_table, grid_coordinates
from framegrid.operators.resample import is_same_grid, locate, resample
from framegrid.plans import encoding
from framegrid.plans.declare import ArrayCoordinates, CoordinateSystem, ReferenceFrame
from framegrid.plans.grid import Grid, index_coordinate
from framegrid.plans.periodic import longitude_of, poles_of

PLANE = ReferenceFrame.declared("t", "plane", CoordinateSystem(("X", "Y"), ("mm", "mm")))


def plane(nx=4, ny=3, step=3, frame=PLANE, offset=0.5):
    t = AffineTransform.from_matrix(np.eye(2), source=ArrayCoordinates(("x", "y"), ("mm", "mm"), sample_offset=(offset, offset)), target=frame, translation=[0, 0])
    return Grid(t, {"y": ("y", np.arange(ny)), "x": ("x", np.arange(nx) * step)})


def table(spark, grid, fn=lambda *i: float(sum(10**k * v for k, v in enumerate(i))), extra=()):
    rows = [(*i, *e, fn(*i) + sum(e)) for i in itertools.product(*[range(grid.sizes[d]) for d in grid.dims]) for e in ([(x,) for x in extra] or [()])]
    names = [f"pos_{d}" for d in grid.dims] + (["band"] if extra else []) + ["value"]
    kinds = ", ".join(f"{n} {'double' if n == 'value' else 'long'}" for n in names)
    return frame_table(spark.createDataFrame(rows, kinds), grid, carried=["band"] if extra else [])


@pytest.fixture(scope="module")
def image(spark):
    return table(spark, plane())


def cells(framed, *keys):
    df = framed.df if isinstance(framed, FramedDF) else framed
    return {tuple(r[k] for k in keys): r["value"] for r in df.collect()}


def test_selection_follows_the_grid(image):
    s = image.isel(x=slice(None, None, -2), y=[2, 0, 2])
    assert s.grid == image.grid.isel(x=slice(None, None, -2), y=[2, 0, 2])
    got = {(r["pos_y"], r["pos_x"]): (r["y"], r["x"], r["value"]) for r in s.df.collect()}
    assert len(got) == 6 and got[(0, 0)] == (2.0, 9.0, 32.0) and got[(1, 1)] == (0.0, 3.0, 10.0)
    one = image.isel(y=1)
    assert one.geometry_dims == ("x",) and one.df.count() == 4 and "pos_y" not in one.df.columns
    assert cells(image.sel(x=5, method="nearest"), "pos_y") == cells(image.isel(x=2), "pos_y")
    assert cells(image.sel(x=slice(3, 9)), "pos_y", "x") == {k: v for k, v in cells(image, "pos_y", "x").items() if k[1] >= 3}
    assert image.head(x=2).df.count() == 6 and image.tail(x=1).grid.coordinates["x"][1].tolist() == [9] and image.thin(x=2).grid.sizes["x"] == 2
    assert image.isel(x=slice(0, 0)).roll(x=1, roll_coords=True).df.count() == 0
    assert image.isel(y=slice(1, 2)).squeeze("y").geometry_dims == ("x",)


@pytest.mark.parametrize(
    ("call", "error"),
    [
        (lambda f: f.isel(x=np.array([[0, 1]])), ValueError),
        (lambda f: f.isel(y=1, drop=True), ValueError),
        (lambda f: f.isel(y=1).sel(y=1), KeyError),
        (lambda f: f.sel(x=1), KeyError),
        (lambda f: f.isel(x=9), IndexError),
        (lambda f: f.coarsen(x=2), ValueError),
        (lambda f: f.groupby("y"), ValueError),
        (lambda f: f.stack(p=("y", "x")), ValueError),
        (lambda f: f.pad(x=(1, 1)), ValueError),
        (lambda f: f.interp(x=[1.5]), ValueError),
        (lambda f: f.concat([f], "y"), ValueError),
        (lambda f: f.assign_coords(x=[0]), ValueError),
        (lambda f: f.drop_vars("x"), ValueError),
        (lambda f: f.align(f, "override"), ValueError),
        (lambda f: f.align(f.isel(x=slice(1, 3)), "exact"), AlignmentError),
        (lambda f: f.rename(x="value"), ValueError),
    ],
)
def test_what_would_be_wrong_is_refused_before_anything_runs(image, call, error):
    with pytest.raises(error):
        call(image)


def test_layout_changes(image):
    assert image.transpose("x", "y").geometry_dims == ("x", "y")
    r = image.rename(x="column", value="v")
    assert r.grid.transform.source.axes == ("column", "y") and {"pos_column", "column", "v"} <= set(r.df.columns)
    s = image.swap_dims({"x": "c"})
    assert s.geometry_dims == ("y", "c") and "x" in s.df.columns and s.isel(c=[3, 1]).df.count() == 6
    e = image.expand_dims(band=[0, 1])
    assert e.carried == ("band",) and e.df.count() == 24
    c = cells(image.roll(x=1), "pos_y", "pos_x")
    assert c[(0, 0)] == 30.0 and image.roll(x=1).grid == image.grid
    assert image.roll(x=1, roll_coords=True).grid.coordinates["x"][1].tolist() == [9, 0, 3, 6]
    m = cells(image.shift(x=1), "pos_y", "pos_x")
    assert math.isnan(m[(0, 0)]) and m[(0, 1)] == 0.0
    w = cells(image.rolling(x=2), "pos_y", "pos_x")
    assert math.isnan(w[(0, 0)]) and w[(0, 1)] == 5.0


def test_arithmetic(spark, image):
    assert cells(image + image, "pos_y", "pos_x")[(2, 3)] == 64.0
    assert cells(1 - image, "pos_y", "pos_x")[(0, 1)] == -9.0
    assert cells((image / 2).astype("int"), "pos_y", "pos_x")[(2, 3)] == 16
    assert cells(image.where(lambda c: c > 2, 0.0), "pos_y", "pos_x")[(1, 0)] == 0.0
    part = image.isel(x=slice(1, 3))
    both = image + part
    assert both.grid == part.grid and both.df.count() == 6
    plain = spark.createDataFrame([(3.0, 100.0), (6.0, 200.0), (99.0, 0.0)], "x double, value double")
    mixed = image + plain
    assert mixed.grid.sizes["x"] == 2 and cells(mixed, "y", "x")[(2.0, 6.0)] == 222.0
    wrong = plain.withMetadata("x", {"units": "cm"})
    with pytest.raises(ValueError, match="units"):
        image + wrong
    with pytest.raises(ValueError, match="unindexed"):
        image.isel(y=1) + spark.createDataFrame([(0.0, 1.0)], "y double, value double")


def test_identity_is_never_inferred_from_numbers(spark, image):
    other = ReferenceFrame.declared("t", "other", PLANE.coordinate_system)
    with pytest.raises(ValueError, match="resample"):
        image + table(spark, plane(frame=other))
    unnamed = table(spark, plane(frame=ReferenceFrame.anonymous(PLANE.coordinate_system)))
    with pytest.raises(ValueError, match="anonymous"):
        unnamed + image
    named = unnamed.assume_frame(PLANE)
    assert cells(named + image, "pos_y", "pos_x")[(0, 1)] == 20.0
    with pytest.raises(ValueError):
        image.assume_frame(other)
    with pytest.raises(ValueError):
        resample(image.df, image.grid, plane(frame=other))


def test_outer_alignment_is_a_product_of_unions(image):
    a, b = image.isel(x=slice(0, 2), y=slice(0, 2)), image.isel(x=slice(1, 4), y=slice(1, 3))
    left, _, _ = a.align(b, "outer")
    got = cells(left, "y", "x")
    assert len(got) == 12 and sum(math.isnan(v) for v in got.values()) == 8
    assert image.isel(x=[0]).reindex_like(image).df.filter(F.isnan("value")).count() == 9
    merged = image.merge(image.rename(value="second").map_values(lambda c: c * 2))
    assert merged.values == ("value", "second") and merged.df.filter("second <> 2 * value").count() == 0
    new = image.assign_at(image.isel(x=[1]).map_values(lambda c: c * 0 - 1))
    assert sum(v == -1 for v in cells(new, "pos_y", "pos_x").values()) == 3


def test_reductions_keep_the_declaration_only_with_all_geometry(spark, image):
    assert isinstance(image.sum("y"), DataFrame) and not isinstance(image.mean("y"), FramedDF)
    bands = table(spark, plane(), extra=(0, 100))
    kept = bands.mean("band")
    assert isinstance(kept, FramedDF) and kept.carried == () and cells(kept, "pos_y", "pos_x")[(0, 1)] == 60.0
    assert bands.quantile(0.5, "band", "x").count() == 3
    assert bands.isel(band=1).df.count() == 12 and bands.sel(band=100).carried == ()
    assert bands.isel(band=[1]).carried == ("band",)
    assert bands.sizes() == {"y": 3, "x": 4, "band": 2}
    assert bands.coarsen(band=1000).df.count() == 12
    again = image._with(image.df.withColumn("t", F.lit(0)), carried=("t",)).concat([image._with(image.df.withColumn("t", F.lit(1)), carried=("t",))], "t")
    assert again.carried == ("t",) and again.df.count() == 24


def test_binding(spark):
    g = plane()
    assert grid_coordinates(spark, g).df.count() == 12 and index_coordinate("d", 3, start=2)[1].tolist() == [2, 3, 4]
    df = spark.createDataFrame([(0, 0, 1.0)], "pos_y long, pos_x long, value double")
    with pytest.raises(ValueError):
        frame_table(df, g, check=True)
    with pytest.raises(ValueError):
        frame_table(df.withColumn("x", F.lit(1)), g)
    rows = spark.createDataFrame([(5.0, 1.0), (2.0, 2.0), (9.0, 3.0)], "s double, value double")
    line = ReferenceFrame.declared("t", "line", CoordinateSystem(("L",), ("mm",)))
    t = AffineTransform.from_matrix([[1.0]], source=ArrayCoordinates(("s",), ("mm",)), target=line, translation=[0])
    assert {r["s"]: r["pos_s"] for r in frame_columns(rows, t).df.collect()} == {2.0: 0, 5.0: 1, 9.0: 2}
    with pytest.raises(TypeError):
        frame_columns(rows.withColumn("s", F.current_timestamp()), t)


def test_tables_carry_their_declaration_through_parquet(spark, image, tmp_path):
    encoding.encode_table(image).write.parquet(f"{tmp_path}/t")
    raw = spark.read.parquet(f"{tmp_path}/t")
    back = encoding.decode_table(raw)
    assert back.grid == image.grid and cells(back, "pos_y", "pos_x") == cells(image, "pos_y", "pos_x")
    with pytest.raises(encoding.MalformedDataError):
        encoding.decode_table(raw.select("pos_x"))
    long = table(spark, plane(nx=1500, ny=1))
    encoding.write_dataset(long, f"file://{tmp_path}/d")
    assert encoding.read_dataset(spark, f"file://{tmp_path}/d").grid == long.grid
    side = spark.read.parquet(f"file://{tmp_path}/d/arrays")
    assert side.count() == 1 and encoding.verify_arrays(side).count() == 0
    assert encoding.verify_arrays(side.withColumn("data", F.lit(b"x"))).count() == 1


# Resampling -------------------------------------------------------------------------------------------


def volume():
    t = AffineTransform.from_matrix(np.eye(3), source=ArrayCoordinates(("k", "j", "i"), ("1",) * 3, sample_offset=(0.5,) * 3), target=SPACE, translation=[0, 0, 0])
    return Grid(t, {"k": ("k", np.arange(4)), "j": ("j", np.arange(5)), "i": ("i", np.arange(6))})


SPACE = ReferenceFrame.declared("t", "space", CoordinateSystem(("X", "Y", "Z"), ("mm",) * 3))


def rotated(n=5, name="abc"):
    c, s = math.cos(0.4), math.sin(0.4)
    t = AffineTransform.from_matrix(np.array([[1, 0, 0], [0, c, -s], [0, s, c]]) * 0.8, source=ArrayCoordinates(tuple(name), ("1",) * 3, sample_offset=(0.5,) * 3), target=SPACE, translation=[0.3, 0.6, -0.2])
    return Grid(t, {a: (a, np.arange(n)) for a in name})


def array_of(df, grid, column="value"):
    out = np.full([grid.sizes[d] for d in grid.dims], np.inf)
    for r in df.collect():
        out[tuple(r[f"pos_{d}"] for d in grid.dims)] = r[column]
    return out


def numpy_linear(values, p):
    out = np.zeros(p.shape[:-1])
    gone = np.zeros(p.shape[:-1])
    inside = ((p >= -1e-9) & (p <= np.array(values.shape) - 1 + 1e-9)).all(-1)
    q = np.clip(p, 0, np.array(values.shape) - 1)
    for bits in itertools.product((0, 1), repeat=p.shape[-1]):
        low = np.floor(q)
        w = np.prod(np.where(np.array(bits), q - low, 1 - (q - low)), axis=-1)
        at = np.minimum(low + np.array(bits), np.array(values.shape) - 1).astype(int)
        v = values[tuple(np.moveaxis(at, -1, 0))]
        out += np.where(np.isnan(v), 0, w * np.nan_to_num(v))
        gone += np.where(np.isnan(v), w, 0)
    return np.where(inside, np.where(gone > 1e-9, np.nan, out), -5)


@pytest.mark.parametrize("hole", [False, True])
def test_linear_is_multilinear_and_missing_weight_is_nan(spark, hole):
    g, target = volume(), rotated()
    v = np.random.default_rng(1).normal(size=(4, 5, 6))
    if hole:
        v[1, 2, 3] = np.nan
    src = table(spark, g, lambda *i: float(v[i]))
    got = array_of(resample(src.df, g, target, fill_value=-5.0), target)
    want = numpy_linear(v, g.positions_at(target.points(), outside="extrapolate"))
    np.testing.assert_allclose(got, want, atol=1e-9)
    assert np.isnan(want).any() == hole and (want == -5).any()


@pytest.mark.parametrize("method", ["nearest", "linear", "cubic"])
@pytest.mark.parametrize("carried", [(), (0, 100)])
def test_tiles_give_what_joins_give(spark, monkeypatch, method, carried):
    """Small tiles, a target that leaves the source, and for the simple methods a hole."""
    from framegrid.operators import tiles

    g, target = volume(), rotated(7)
    v = np.random.default_rng(2).normal(size=(4, 5, 6))
    src = table(spark, g, lambda *i: float(v[i]), extra=carried)
    df = src.df if method == "cubic" else src.df.filter("not (pos_k = 1 and pos_j = 2 and pos_i = 3)")
    keys = [*["pos_" + d for d in "abc"], *src.carried]
    joined = resample(df, g, target, carried=src.carried, method=method, fill_value=-5.0, domain="cells")
    want = {tuple(r[k] for k in keys): r["value"] for r in joined.collect()}
    monkeypatch.setattr(tiles, "MIN_TARGET", 0)
    monkeypatch.setattr(tiles, "CELLS", 1500)
    tiled = resample(df, g, target, carried=src.carried, method=method, fill_value=-5.0, domain="cells")
    assert "FlatMapGroupsInArrow" in tiled._jdf.queryExecution().optimizedPlan().toString()
    got = {tuple(r[k] for k in keys): r["value"] for r in tiled.collect()}
    assert got.keys() == want.keys() and len(got) == 343 * max(1, len(carried))
    for k, x in want.items():
        assert x == pytest.approx(got[k], abs=1e-9, nan_ok=True), k


def test_a_missing_row_is_a_missing_value(spark):
    g = plane()
    src = table(spark, g).df.filter("not (pos_x = 1 and pos_y = 1)")
    half = Grid(g.transform, {"y": ("y", np.array([1.0, 1.5])), "x": ("x", np.array([0.0, 3.0]))})
    out = array_of(resample(src, g, half), half)
    assert out[0, 0] == 1.0 and np.isnan(out[0, 1]) and np.isnan(out[1, 1])
    with pytest.raises(Exception, match="no row"):
        resample(src, g, half, method="nearest", missing_rows="raise").collect()


def test_uneven_and_descending_axes_take_the_general_path(spark):
    t = AffineTransform.from_matrix(np.eye(1), source=ArrayCoordinates(("s",), ("mm",), sample_offset=(0.25,)), target=ReferenceFrame.declared("t", "l", CoordinateSystem(("L",), ("mm",))), translation=[0])
    g = Grid(t, {"s": ("s", np.array([9.0, 5.0, 2.0, 0.0]))})
    target = Grid(t, {"s": ("s", np.linspace(-2, 11, 27))})
    src = table(spark, g, lambda i: [1.0, 20.0, 300.0, 4000.0][i])
    got = array_of(resample(src.df, g, target, fill_value=-5.0), target)
    c = np.linspace(-2, 11, 27)
    want = np.where((c >= 0) & (c <= 9), np.interp(c, [0, 2, 5, 9], [4000, 300, 20, 1]), -5)
    np.testing.assert_allclose(got, want)
    held = array_of(resample(src.df, g, target, fill_value=-5.0, domain="cells"), target)
    inside = (c >= -0.25 * 2) & (c <= 9 + 0.75 * 4)
    assert ((held != -5) == inside).all() and held[c > 9][0] == 1.0


def test_nearest_keeps_whole_numbers_and_same_grids_are_copied(spark):
    g = plane()
    src = table(spark, g).astype("int")
    near = resample(src.df, g, plane(nx=7, step=2), method="nearest", fill_value=-1)
    assert dict(near.dtypes)["value"] == "int" and near.filter("value = -1").count() == 6
    assert dict(resample(src.df, g, g, method="nearest").dtypes)["value"] == "double"
    flipped = Grid(AffineTransform.from_matrix([[0, -1], [1, 0]], source=ArrayCoordinates(("y", "x"), ("mm",) * 2), target=PLANE, translation=[9, 0]), {"y": ("y", np.arange(3)), "x": ("x", np.arange(4) * 3)})
    assert is_same_grid(locate(g, flipped)) and not is_same_grid(locate(g, plane(step=2)))
    got = array_of(resample(src.df, g, flipped), flipped)
    np.testing.assert_array_equal(got, np.array([[10 * (3 - x) + y for x in range(4)] for y in range(3)]))


def test_cubic_reproduces_samples_and_smooth_functions(spark):
    line = ReferenceFrame.declared("t", "l", CoordinateSystem(("L",), ("mm",)))
    t = AffineTransform.from_matrix(np.eye(1), source=ArrayCoordinates(("s",), ("1",)), target=line, translation=[0])
    g = Grid(t, {"s": ("s", np.arange(80))})
    src = table(spark, g, lambda i: math.sin(0.2 * i))
    same = Grid(t, {"s": ("s", np.arange(80) * 1.0 + 1e-7)})
    np.testing.assert_allclose(array_of(resample(src.df, g, same, method="cubic", fill_value=0.0), same)[:-1], np.sin(0.2 * np.arange(79)), atol=1e-6)
    edge = Grid(t, {"s": ("s", np.array([0.0, 0.5]))})
    assert abs(array_of(resample(src.df, g, edge, method="cubic"), edge)[0]) < 1e-9
    between = Grid(t, {"s": ("s", np.arange(30, 50) + 0.37)})
    np.testing.assert_allclose(array_of(resample(src.df, g, between, method="cubic"), between), np.sin(0.2 * (np.arange(30, 50) + 0.37)), atol=2e-5)
    with pytest.raises(Exception, match="missing value"):
        resample(src.map_values(lambda c: F.when(F.col("pos_s") == 30, F.lit(float("nan"))).otherwise(c)).df, g, between, method="cubic").collect()
    c = prefilter(np.ones(5))
    np.testing.assert_allclose(c, 1)


def test_carried_labels_have_rows_outside_too(spark):
    g = plane()
    src = table(spark, g, extra=(0, 100))
    far = Grid(g.transform, {"y": ("y", np.array([500])), "x": ("x", np.array([0]))})
    out = src.resample_to(far, fill_value=-7.0)
    assert {(r["band"], r["value"]) for r in out.df.collect()} == {(0, -7.0), (100, -7.0)}
    none = Grid(g.transform, {"y": ("y", np.zeros(0)), "x": ("x", np.array([0]))})
    assert src.resample_to(none).df.count() == 0
    with pytest.raises(ValueError):
        resample(src.df, g.isel(x=slice(0, 0)), far)
    with pytest.raises(ValueError):
        src.rename(value="y2").resample_to(far.transpose(), method="quartic")


def test_the_source_is_cut_to_what_the_target_reaches(spark):
    g = plane(nx=1000, ny=1000, step=1)
    src = table(spark, plane(nx=2, ny=2)).df
    target = Grid(g.transform, {"y": ("y", np.array([500.5, 501])), "x": ("x", np.array([2.25, 3]))})
    plan = resample(src, g, target)._jdf.queryExecution().optimizedPlan().toString()
    assert "499" in plan or "500" in plan


# Seams, poles, boxes ------------------------------------------------------------------------------------

GLOBE = ReferenceFrame.declared("t", "globe", CoordinateSystem(("lon", "lat"), ("deg", "deg"), representation="spherical", axis_roles=("longitude", "latitude")))


def globe(lons, lats):
    t = AffineTransform.from_matrix(np.eye(2), source=ArrayCoordinates(("lon", "lat"), ("deg", "deg"), sample_offset=(0.5, 0.5)), target=GLOBE, translation=[0, 0])
    return Grid(t, {"lat": ("lat", np.asarray(lats, float)), "lon": ("lon", np.asarray(lons, float))})


def test_longitudes_are_global_or_regional():
    lon = lambda v: longitude_of(g := globe(v, [0, 1]), g.axis("lon"))
    assert lon(np.arange(36) * 10.0).is_global and lon(np.arange(36) * 10.0).count == 36
    closing = lon(np.arange(37) * 10.0)
    assert closing.is_global and closing.count == 36
    assert not lon(np.arange(20) * 10.0).is_global


@pytest.mark.parametrize("lons", [np.arange(8) * 45.0, np.arange(8)[::-1] * 45.0 - 90, np.arange(9) * 45.0])
def test_interpolation_goes_round(spark, lons):
    g = globe(lons, [0, 10])
    f = lambda a: np.round(np.cos(np.radians(a)) * 50, 6)
    src = table(spark, g, lambda j, i: float(f(lons[i])))
    target = globe([-30, 350, 710, 22.5], [5])
    got = array_of(resample(src.df, g, target), target)[0]
    base = np.arange(-360, 1081, 45.0)
    np.testing.assert_allclose(got, np.interp([-30, 350, 710, 22.5], base, f(base)), atol=1e-6)


def test_a_region_is_found_from_any_turn(spark):
    g = globe([170, 180, 190], [0, 10])
    src = table(spark, g, lambda j, i: float(i))
    target = globe([-175, 185, 545, 100], [0])
    np.testing.assert_allclose(array_of(resample(src.df, g, target, fill_value=-1.0), target)[0], [1.5, 1.5, 1.5, -1])


@pytest.mark.parametrize(("lats", "kind"), [([70, 80, 90], "odd"), ([65, 75, 85], "even"), ([40, 50, 60], None)])
def test_rows_continue_across_the_pole(spark, lats, kind):
    lons = np.arange(8) * 45.0
    g = globe(lons, lats)
    found = poles_of(g)
    assert (found.high if found else None) == kind
    if kind != "even":
        return
    smooth = lambda lat, lon: math.cos(math.radians(lat)) * math.cos(math.radians(lon))
    src = table(spark, g, lambda j, i: smooth(lats[j], lons[i]))
    target = globe([0.0, 90.0], [88, 90])
    got = array_of(resample(src.df, g, target, fill_value=-9.0), target)
    np.testing.assert_allclose(got[:, 0], [(3 / 10 * -1 + 7 / 10) * smooth(85, 0), 0], atol=1e-9)
    past = globe([0.0], [91])
    assert array_of(resample(src.df, g, past, fill_value=-9.0), past)[0, 0] == -9


def test_box_averages_of_unit_slabs():
    source = np.stack([np.arange(10.0), np.arange(10.0) + 1], 1)
    rows = lambda w: list(zip(w.target.tolist(), w.source.tolist(), w.weight.tolist(), strict=True))
    found = boxes.average_weights(source, np.array([[0, 5], [5, 10], [0.5, 2], [9.5, 11]]))
    mean = lambda j: sum(w * i for t, i, w in rows(found) if t == j)
    assert (mean(0), mean(1)) == (2, 7) and mean(2) == pytest.approx(2 / 3)
    np.testing.assert_allclose(found.coverage, [1, 1, 1, 1 / 3])
    shared = boxes.average_weights(np.array([[0.0, 2], [1, 3]]), np.array([[0.0, 3]]))
    assert dict((i, w) for _, i, w in rows(shared)) == pytest.approx({0: 0.5, 1: 0.5})
    at = boxes.point_weights(source, np.array([0.5, 3.0, 20.0]))
    assert rows(at) == [(0, 0, 1.0), (1, 2, 0.5), (1, 3, 0.5)] and at.coverage.tolist() == [1, 1, 0]


def test_box_weights_equal_a_fine_sum():
    """Against values sampled on a fine even line, for cells with gaps, overlaps and any order."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        cells = lambda n: np.sort(rng.integers(0, 40, (n, 2)), axis=1) + [0, 1]
        source, target = cells(6).astype(float), cells(4).astype(float)
        found, x = boxes.average_weights(source, target), np.arange(0.005, 41, 0.01)
        held = (source[:, :1] <= x) & (x < source[:, 1:])
        share = held / np.maximum(held.sum(0), 1)
        for j, (lo, hi) in enumerate(target):
            inside = (x >= lo) & (x < hi)
            covered = inside & held.any(0)
            got = np.zeros(6)
            got[found.source[found.target == j]] = found.weight[found.target == j]
            np.testing.assert_allclose(found.coverage[j], covered.sum() / inside.sum(), atol=1e-9)
            np.testing.assert_allclose(got, share[:, covered].sum(1) / max(1, covered.sum()), atol=1e-9)


def test_many_cells_need_no_loop():
    n = 200_000
    source = np.stack([np.arange(n), np.arange(n) + 1], 1).astype(float)
    found = boxes.average_weights(source, source + 0.5)
    assert len(found.weight) == 2 * n - 1 and abs(found.weight.sum() - n) < 1e-6
    assert len(boxes.point_weights(source, source[:, 0] + 0.25).weight) == n


def slabs(cells, name="s"):
    line = ReferenceFrame.declared("t", "l", CoordinateSystem(("L",), ("mm",)))
    c = np.array(cells, float)
    t = AffineTransform.from_matrix(np.eye(1), source=ArrayCoordinates((name,), ("mm",), sample_offset=(0.5,)), target=line, translation=[0])
    return Grid(t, {name: (name, c.mean(1))}, intervals={name: c})


def test_box_methods_refuse_and_fill(spark):
    g = slabs([[0, 1], [1, 2], [4, 6]])
    src = table(spark, g, lambda i: [1.0, float("nan"), 3.0][i])
    target = slabs([[0, 1], [0, 2], [3.5, 5], [2, 3]], "b")
    got = array_of(resample(src.df, g, target, method="step", support="average", fill_value=-1.0), target)
    assert got[0] == 1 and np.isnan(got[1]) and got[2] == 3 and got[3] == -1
    strict = array_of(resample(src.df, g, target, method="step", support="average", fill_value=-1.0, min_coverage=0.9), target)
    assert strict[2] == -1
    with pytest.raises(ValueError):
        resample(src.astype("int").df, g, target, method="step")
    with pytest.raises(ValueError):
        resample(src.df, g, target, method="step", domain="cells")
    over = slabs([[0, 2], [1, 3]])
    with pytest.raises(ValueError):
        resample(table(spark, over).df, over, target, method="step")


# Components ----------------------------------------------------------------------------------------------


def test_component_declarations_change_basis_and_resample(spark):
    from framegrid.plans.anatomy import patient_coordinate_system

    lps = ReferenceFrame.declared("t", "p", patient_coordinate_system("LPS"))
    t = AffineTransform.from_matrix(np.eye(3), source=ArrayCoordinates(("k", "j", "i"), ("1",) * 3), target=lps, translation=[0] * 3)
    g = Grid(t, {a: (a, np.arange(2)) for a in "kji"})
    df = table(spark, g).df.withColumn("v", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    framed = FramedDF(df.drop("value"), g, (), ("v",))
    tensor = declare_components(framed, "v", tensors.VECTOR)
    ras = lps.with_coordinate_system(patient_coordinate_system("RAS"))
    assert tensor.change_basis(ras).framed.df.first()["v"] == [-1.0, -2.0, 3.0]
    assert tensor.change_basis(ras).declaration.basis == ras
    with pytest.raises(ValueError):
        tensor.change_basis(ras, units="cm")
    with pytest.raises(ValueError):
        tensor.combine(tensor.change_basis(ras), lambda a, b: a + b)
    assert tensor.combine(tensor, lambda a, b: a + b).framed.df.first()["v"] == [2.0, 4.0, 6.0]
    assert isinstance(tensor.select_component(0, name="vx"), FramedDF)
    moved = ReferenceFrame.declared("t", "q", patient_coordinate_system("LPS"))
    twist = AffineTransform.from_matrix([[0, -2, 0], [2, 0, 0], [0, 0, 2]], source=moved, target=lps, translation=[1, 0, 0])
    t2 = AffineTransform.from_matrix(np.eye(3) * 0.25, source=ArrayCoordinates(("k", "j", "i"), ("1",) * 3), target=moved, translation=[0, 0, 0])
    target = Grid(t2, {a: (a, np.arange(2)) for a in "kji"})
    for how, want in (("jacobian", [1.0, -0.5, 1.5]), ("polar", [2.0, -1.0, 3.0])):
        out = resample_components(framed.df, g, target, column="v", size=3, kind=tensors.VECTOR, transform=twist, reorientation=how)
        rows = [r["v"] for r in out.collect() if not math.isnan(r["v"][0])]
        assert rows and np.allclose(rows, want)
    with pytest.raises(ValueError):
        resample_components(framed.df, g, target, column="v", size=3, kind=tensors.VECTOR, transform=twist, fill_value=7.0)


def test_nearest_sample_and_first_failure(image):
    from framegrid.operators.diagnostics import first_failure

    assert image.nearest_to({"X": 7.4, "Y": 0.2}).df.first()["value"] == 20.0
    with pytest.raises(ValueError):
        image.nearest_to({"X": 70.0, "Y": 0.2})
    row = first_failure(image.df, F.col("value") > 11, image.geometry_dims).first()
    assert row["n"] == 7 and tuple(row["first"]) == (0, 2)
    assert first_failure(image.df, F.lit(False), image.geometry_dims).first()["first"] is None


def test_coincidence_report(spark):
    g = plane()
    a = g.to_df(spark, points=True)
    row = coincidence(a, a.withColumn("X", F.col("X") + 0.25), g).first()
    assert (row["n"], row["maximum"]) == (12, 0.25)


# Fields in tiles ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["displacement", "bspline", "position"])
@pytest.mark.parametrize("turned", [False, True])
def test_tiles_through_a_field_equal_joins(spark, monkeypatch, kind, turned):
    """One kernel for field and source against the general plan, for every exterior."""
    from framegrid.functions.fields import BSplineTransform, DisplacementFieldTransform, PositionFieldTransform
    from framegrid.operators import tiles

    rng = np.random.default_rng(3)
    plane = ReferenceFrame.declared("t", "a", CoordinateSystem(("x", "y"), ("1", "1")))
    moved = ReferenceFrame.declared("t", "b", CoordinateSystem(("x", "y"), ("1", "1")))
    even = lambda m, t, to, names: AffineTransform.from_matrix(m, source=ArrayCoordinates(names, ("1", "1"), sample_offset=(0.5, 0.5)), target=to, translation=t)
    source = Grid(even(np.diag([1.0, 0.5]), [0, 0], plane, ("i", "j")), {"i": ("i", np.arange(20)), "j": ("j", np.arange(30))})
    values = source.to_df(spark, coordinates=False).withColumn("value", F.sin(F.col("pos_i") * 1.7) + F.cos(F.col("pos_j") * 0.9))
    nodes = Grid(even(np.diag([3.0, 4.0]), [-1, 0.5], moved, ("a", "b")), {"a": ("a", np.arange(8)), "b": ("b", np.arange(5))})
    m = [[0.31, 0.07], [-0.05, 0.22]] if turned else [[0.0, 0.31], [0.22, 0.0]]
    target = Grid(even(np.array(m), [-2, -1], moved, ("u", "v")), {"u": ("u", np.arange(70)), "v": ("v", np.arange(60))})
    make = {"displacement": DisplacementFieldTransform, "bspline": BSplineTransform, "position": PositionFieldTransform}[kind]
    given = rng.normal(size=(8, 5, 2)) + (np.stack(np.meshgrid(np.arange(8.0) * 2, np.arange(5.0) * 3, indexing="ij"), -1) if kind == "position" else 0)
    for exterior in ("raise",) if kind == "position" else ("raise", "identity", "nearest"):
        field = make(nodes, given, target=plane, exterior=exterior)
        for method in ("linear", "nearest") if exterior == "identity" else ("linear",):
            both = []
            for least in (1, 1 << 40):
                monkeypatch.setattr(tiles, "MIN_TARGET", least)
                out = resample(values, source, target, transform=field, method=method, fill_value=-9.0)
                both.append(array_of(out, target))
            np.testing.assert_allclose(both[0], both[1], atol=1e-9)
            assert (both[0] != -9).sum() > 200
