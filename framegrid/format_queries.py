"""Registered queries over headers, transform files, encodings and streams, with their SQL."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegrid.functions.fields import DisplacementFieldTransform
from framegrid.functions.transforms import AffineTransform, transform_frame
from framegrid.functions.units import canonical_column
from framegrid.plans import encoding
from framegrid.plans.anatomy import patient_coordinate_system
from framegrid.plans.declare import ArrayCoordinates, ReferenceFrame
from framegrid.plans.grid import Grid
from framegrid.queries import FILL, SURFACE_SQL, _field_points, framed, read
from framegrid.sources import headers, transform_files
from framegrid.streaming.points import sample_at, window_average

FIXED, MOVING = transform_files.lps_frame("fixed"), transform_files.lps_frame("moving")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared one; a private one only on a single machine without a setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="framegrid-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4()}"


def _points(spark: SparkSession, grid: Grid) -> DataFrame:
    """All samples of a grid with their points, rounded."""
    out = grid.to_df(spark, coordinates=False, points=True)
    return out.select(*[f"pos_{d}" for d in grid.dims], *[F.round(a, 6).alias(a) for a in grid.frame.axes])


# Headers ------------------------------------------------------------------------------------------------------


def dicom_stack_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three slices given out of order, columns 0.5 and rows 0.75 apart."""
    base = {"ImageOrientationPatient": [1, 0, 0, 0, 1, 0], "PixelSpacing": [0.75, 0.5], "Rows": 4, "Columns": 5, "SliceThickness": 2.0, "FrameOfReferenceUID": "1.2.3"}
    stack = headers.dicom_stack([{**base, "ImagePositionPatient": [-10, 20, z]} for z in (6.0, 0.0, 3.0)])
    out = _points(spark, stack.grid)
    return out.toDF(*[f"pos_{d}" for d in stack.grid.dims], "x", "y", "z").select("pos_slice", "pos_row", "pos_column", "x", "y", "z")


DICOM_SQL = """select s.range as pos_slice, r.range as pos_row, c.range as pos_column, round(-10 + 0.5::double * c.range, 6) as x, round(20 + 0.75::double * r.range, 6) as y,
  round(3.0::double * s.range, 6) as z from range(3) s, range(4) r, range(5) c"""


def dicom_frames_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames picked from four of one multi-frame header."""
    shared = {"ImageOrientationPatient": [0, 1, 0, 0, 0, -1], "PixelSpacing": [2.0, 1.5], "Rows": 3, "Columns": 2, "SliceThickness": 4.0, "FrameOfReferenceUID": "1.2.4"}
    many = headers.dicom_enhanced(shared, [{"ImagePositionPatient": [-4.0 * k, 1.0, 2.0]} for k in range(4)], frame_indices=[1, 3])
    out = _points(spark, many.grid)
    return out.toDF(*[f"pos_{d}" for d in many.grid.dims], "x", "y", "z").select("pos_slice", "pos_row", "pos_column", "x", "y", "z")


DICOM_FRAMES_SQL = """select s.range as pos_slice, r.range as pos_row, c.range as pos_column, round(-4 - 8.0::double * s.range, 6) as x, round(1 + 1.5::double * c.range, 6) as y,
  round(2 - 2.0::double * r.range, 6) as z from range(2) s, range(3) r, range(2) c"""


def dicom_slice_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of many series, put in order along each series' normal, with the gaps between them."""
    rows = read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("series"), F.col("p_partkey").cast("string").alias("sop"),
        F.array(F.lit(1.0), F.lit(2.0), F.col("p_partkey") * F.lit(0.5)).alias("position"),
        F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)]).alias("orientation"),
    )
    out = headers.dicom_order(rows)
    return out.select("series", "sop", F.col("slice").cast("long").alias("slice"), F.round(F.coalesce("gap", F.lit(FILL)), 6).alias("gap"))


DICOM_ORDER_SQL = f"""select p_brand as series, p_partkey::varchar as sop, (row_number() over w - 1)::bigint as slice,
  round(coalesce(0.5::double * p_partkey - lag(0.5::double * p_partkey) over w, {FILL}), 6) as gap from part window w as (partition by p_brand order by p_partkey)"""


def nifti_header_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid written as a header and read again: the same points, in the header's own axes."""
    frame = ReferenceFrame.declared("framegrid", "scan", patient_coordinate_system("LPS"))
    t = AffineTransform.from_matrix([[0, 0, 2], [0, 1.5, 0], [1, 0, 0]], source=ArrayCoordinates(("i", "j", "k"), ("1",) * 3, sample_offset=(0.5,) * 3), target=frame, translation=[4, 5, 6])
    grid = Grid(t, {a: (a, np.arange(n)) for a, n in zip("ijk", (3, 4, 5), strict=True)})
    back = headers.nifti_grid(headers.build_nifti_header(headers.nifti_header(grid)))
    out = _points(spark, back)
    return out.toDF(*[f"pos_{d}" for d in back.dims], "r", "a", "s").select("pos_i", "pos_j", "pos_k", "r", "a", "s")


NIFTI_SQL = """select i.range as pos_i, j.range as pos_j, k.range as pos_k, round(-(2.0::double * k.range + 4), 6) as r, round(-(1.5::double * j.range + 5), 6) as a,
  round(1.0::double * i.range + 6, 6) as s from range(3) i, range(4) j, range(5) k"""


def ngff_level_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = lambda *x: {"type": "scale", "scale": list(x)}
    levels = [{"path": "0", "coordinateTransformations": [scale(1, 0.5, 0.5)]}, {"path": "1", "coordinateTransformations": [scale(1, 1, 1), {"type": "translation", "translation": [0, 0.25, 0.25]}]}]
    axes = [{"name": "c", "type": "channel"}, {"name": "y", "type": "space", "unit": "micrometer"}, {"name": "x", "type": "space", "unit": "micrometer"}]
    grid = headers.ngff_grid({"axes": axes, "datasets": levels, "coordinateTransformations": [scale(1, 10, 10)]}, (2, 4, 6), level=1)
    return _points(spark, grid).toDF("pos_y", "pos_x", "y", "x")


NGFF_SQL = "select a.range as pos_y, b.range as pos_x, round(10.0::double * a.range + 2.5, 6) as y, round(10.0::double * b.range + 2.5, 6) as x from range(4) a, range(6) b"


def geotiff_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = {"crs": {"kind": "projected", "unit": "metre", "axes": ["E", "N"], "authority": "EPSG", "code": 32633}, "transform": (30, 0, 1000, 0, -30, 2000), "width": 4, "height": 3}
    grid = headers.geotiff_grid(profile)
    return _points(spark, grid).toDF(*[f"pos_{d}" for d in grid.dims], "e", "n").select("pos_row", "pos_column", "e", "n")


GEOTIFF_SQL = """select r.range as pos_row, c.range as pos_column, round(1000 + 30.0::double * (c.range + 0.5), 6) as e, round(2000 - 30.0::double * (r.range + 0.5), 6) as n
  from range(3) r, range(4) c"""


def cf_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitudes west count negative."""
    grid = headers.cf_grid({"lon": {"values": [10.0, 20.0, 35.0], "units": "degrees_west"}, "lat": {"values": [0.0, 1.0, 2.5], "units": "degrees_north"}})
    return _points(spark, grid).toDF("pos_lat", "pos_lon", "lon", "lat")


CF_SQL = "select a.range as pos_lat, b.range as pos_lon, -([10.0, 20.0, 35.0]::double[])[b.range + 1] as lon, ([0.0, 1.0, 2.5]::double[])[a.range + 1] as lat from range(3) a, range(3) b"

# Transform files ---------------------------------------------------------------------------------------------


def _xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    axes = dict(zip(FIXED.axes, ("l_quantity", "l_discount", "l_tax"), strict=True))
    return rows.select("l_orderkey", "l_linenumber", *[F.col(c).alias(a) for a, c in axes.items()])


def _mapped(rows: DataFrame, transform, names: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    out = transform_frame(rows, transform, prefix="to_")
    return out.select("l_orderkey", "l_linenumber", *[F.round(f"to_{a}", 6).alias(n) for a, n in zip(transform.target.axes, names, strict=True)])


def itk_text_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composite file: its members are listed from the last applied to the first."""
    text = """#Insight Transform File V1.0
Transform: CompositeTransform_double_3_3
Transform: TranslationTransform_double_3_3
Parameters: 1 0 0
FixedParameters:
Transform: AffineTransform_double_3_3
Parameters: 2 0 0 0 2 0 0 0.5 2 0 0 1
FixedParameters: 0 0 0
"""
    return _mapped(_xyz(spark, sf_dir), transform_files.itk_transform(text, fixed=FIXED, moving=MOVING))


ITK_SQL = """select l_orderkey, l_linenumber, round(2 * l_quantity + 1, 6) as x, round(2 * l_discount, 6) as y, round(0.5 * l_discount + 2 * l_tax + 1, 6) as z from lineitem"""


def parameter_file_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane rotation about a centre, from a parameter file's text."""
    text = """// a comment
(Transform "EulerTransform") (FixedImageDimension 2)
(TransformParameters 0.5 1 -2)
(CenterOfRotationPoint 3 4)
(HowToCombineTransforms "Compose")
"""
    a, b = transform_files.lps_frame("a", 2), transform_files.lps_frame("b", 2)
    t = transform_files.parameter_transform([transform_files.parse_parameter_text(text)], fixed=a, moving=b)
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias(a.axes[0]), (F.col("l_discount") * 100).alias(a.axes[1]))
    return _mapped(rows, t, ("x", "y"))


PARAMETER_SQL = f"""with p as (select l_orderkey, l_linenumber, l_quantity - 3 as u, l_discount * 100 - 4 as v from lineitem)
select l_orderkey, l_linenumber, round({math.cos(0.5)!r}::double * u - {math.sin(0.5)!r}::double * v + 3 + 1, 6) as x,
  round({math.sin(0.5)!r}::double * u + {math.cos(0.5)!r}::double * v + 4 - 2, 6) as y from p"""


def _warp(inverse: bool = False):
    """A shift by half a unit on nodes that cover the points, then a doubling; both with declared inverses."""
    mid = ReferenceFrame.local(FIXED.coordinate_system, identifier="framegrid-mid")
    nodes = AffineTransform.from_matrix(np.eye(3) * 60, source=ArrayCoordinates(("a", "b", "c"), ("1",) * 3), target=FIXED, translation=[-60] * 3)
    g, back = (Grid(t, {a: (a, np.arange(4)) for a in "abc"}) for t in (nodes, nodes.with_endpoints(target=mid)))
    warp = DisplacementFieldTransform(g, np.full((4, 4, 4, 3), 0.5), target=mid)
    undo = DisplacementFieldTransform(back, np.full((4, 4, 4, 3), -0.5), target=FIXED)
    chain = transform_files.warp_and_affine(warp, AffineTransform.from_matrix(np.eye(3) * 2, source=mid, target=MOVING, translation=[1, 0, 0]), undo)
    return chain.declared_inverse() if inverse else chain


def warp_affine_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(_xyz(spark, sf_dir), _warp())


WARP_SQL = """select l_orderkey, l_linenumber, round(2 * (l_quantity + 0.5) + 1, 6) as x, round(2 * (l_discount + 0.5), 6) as y, round(2 * (l_tax + 0.5), 6) as z from lineitem"""


def declared_inverse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared inverse of the warp and doubling."""
    t = _warp(True)
    rows = _xyz(spark, sf_dir).toDF("l_orderkey", "l_linenumber", *t.source.axes)
    return _mapped(rows, t)


INVERSE_SQL = """select l_orderkey, l_linenumber, round((l_quantity - 1) / 2 - 0.5, 6) as x, round(l_discount / 2 - 0.5, 6) as y, round(l_tax / 2 - 0.5, 6) as z from lineitem"""

# Units, encodings ---------------------------------------------------------------------------------------------


def unit_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of units in a column, brought to one each."""
    spelled = F.element_at(F.array(*[F.lit(x) for x in ("millimeter", "mm", "degree", "second", "metre")]), F.col("p_size") % 5 + 1)
    return read(spark, sf_dir, "part").select("p_partkey", canonical_column(spelled).alias("unit"))


UNITS_SQL = "select p_partkey, (['mm', 'mm', 'deg', 's', 'm'])[p_size % 5 + 1] as unit from part"


def encoded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A framed table with its declaration as text in the schema, decoded and used again."""
    back = encoding.decode_table(encoding.encode_table(framed(spark, sf_dir)))
    out = back.isel(q=slice(0, 10)).frame_coordinates()
    return out.df.select("pos_q", "pos_d", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("value", 4).alias("value"))


ENCODED_SQL = f"with {SURFACE_SQL} select pos_q, pos_d, (pos_q + 1)::double as x, pos_d::double as y, round(value, 4) as value from cells where pos_q < 10"


def dataset_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A framed table written as a dataset and read again; a plain mean follows from the grid read."""
    path = shared_path(spark, "dataset")
    encoding.write_dataset(framed(spark, sf_dir), path)
    return encoding.read_dataset(spark, path).mean("q").select("pos_d", "d", F.round("value", 4).alias("value"))


DATASET_SQL = f"with {SURFACE_SQL} select pos_d, pos_d::double as d, round(avg(value), 4) as value from cells group by 1, 2"

# Streams ------------------------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there, into files, and read those."""
    path = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_sample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of points that samples the price surface as it goes by."""
    points = _field_points(spark, sf_dir)
    schema = read(spark, sf_dir, "orders").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/orders.parquet*")
    stream = stream.select("o_orderkey", (F.col("o_custkey") % 500 * 0.1 + 0.35).alias("x"), (F.col("o_orderkey") % 110 * 0.1 - 0.05).alias("y")).select(*points.columns)
    out = _streamed(spark, sample_at(stream, framed(spark, sf_dir), method="linear", fill_value=FILL), "sampled")
    return out.select("o_orderkey", F.round("value", 4).alias("value"))


STREAM_SQL = f"""
with {SURFACE_SQL}, pts as (select o_orderkey, o_custkey % 500 * 0.1::double + 0.35::double - 1 as p, o_orderkey % 110 * 0.1::double - 0.05::double as r from orders),
c as (select *, p >= -1e-9 and p <= 49 + 1e-9 and r >= -1e-9 and r <= 10 + 1e-9 as inside, least(greatest(p, 0), 49) as cp, least(greatest(r, 0), 10) as cr from pts),
w as (select *, floor(cp) as i, floor(cr) as j, cp - floor(cp) as fp, cr - floor(cr) as fr from c)
select o_orderkey, round(case when inside then (1 - fp) * (1 - fr) * a.value + fp * (1 - fr) * coalesce(b.value, 0) + (1 - fp) * fr * coalesce(d.value, 0)
  + fp * fr * coalesce(e.value, 0) else {FILL} end, 4) as value
from w left join cells a on a.pos_q = i and a.pos_d = j left join cells b on b.pos_q = i + 1 and b.pos_d = j
left join cells d on d.pos_q = i and d.pos_d = j + 1 left join cells e on e.pos_q = i + 1 and e.pos_d = j + 1
"""


def window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over target cells of six hours of event time, by type."""
    events = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.sqrt(F.abs("value")).alias("root"))
    out = window_average(events, time="ts", value="root", keys=["event_type"], width="6 hours")
    return out.select((F.unix_micros("start") / 3_600_000_000).cast("long").alias("hour"), "event_type", F.round("mean", 4).alias("mean"), "n")


WINDOW_SQL = """select (epoch_us(ts) // 21600000000 * 6)::bigint as hour, event_type, round(avg(sqrt(abs(value))), 4) as mean, count(value) as n from events group by 1, 2"""

ALL = [
    (dicom_stack_points, DICOM_SQL), (dicom_frames_points, DICOM_FRAMES_SQL), (dicom_slice_order, DICOM_ORDER_SQL), (nifti_header_points, NIFTI_SQL),
    (ngff_level_points, NGFF_SQL), (geotiff_points, GEOTIFF_SQL), (cf_points, CF_SQL), (itk_text_map, ITK_SQL), (parameter_file_map, PARAMETER_SQL),
    (warp_affine_map, WARP_SQL), (declared_inverse_map, INVERSE_SQL), (unit_spellings, UNITS_SQL), (encoded_table, ENCODED_SQL),
    (dataset_round_trip, DATASET_SQL), (stream_sample_linear, STREAM_SQL), (window_means, WINDOW_SQL),
]

__all__ = ["ALL"]
