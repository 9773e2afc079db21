"""Registered queries over pixel and transform files, relations and CF tables, with their SQL. Pixel files are
written from the price surface and read block by block."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegrid.format_queries import FIXED, MOVING, _mapped, _xyz, shared_path
from framegrid.functions.tensors import EastNorthUp
from framegrid.functions.transforms import AffineTransform
from framegrid.operators.framed import frame_table
from framegrid.plans.anatomy import patient_coordinate_system
from framegrid.plans.declare import ArrayCoordinates, ReferenceFrame
from framegrid.plans.grid import Grid
from framegrid.queries import _PLACES_SQL, EARTH, FILL, PLANE, SURFACE_SQL, _places, framed, surface
from framegrid.sources.blocks import write_whole
from framegrid.sources.cf_tables import cf_table
from framegrid.sources.dicom_files import read_dicom
from framegrid.sources.headers import build_nifti_header
from framegrid.sources.nifti_files import read_nifti, write_nifti
from framegrid.sources.rasters import read_geotiff, read_ngff
from framegrid.sources.registrations import registrations
from framegrid.sources.transform_files import read_itk_transform

#: The surface has 50 by 11 cells whatever the table's size.
SHAPE = (50, 11)


def _image(spark: SparkSession, sf_dir: str) -> np.ndarray:
    out = np.full(SHAPE, FILL)
    for q, d, v in surface(spark, sf_dir).select("pos_q", "pos_d", "value").collect():
        out[q, d] = v
    return out


def _blocks(v: np.ndarray, size: int) -> list[tuple[tuple[int, int], bytes]]:
    """Square blocks in row order, the last ones padded."""
    padded = np.pad(v, [(0, -n % size) for n in v.shape])
    return [((r // size, c // size), padded[r : r + size, c : c + size].astype("<f8").tobytes()) for r in range(0, v.shape[0], size) for c in range(0, v.shape[1], size)]


def _geotiff(v: np.ndarray, size: int = 16) -> bytes:
    """One band of deflated tiles, in EPSG:32633, pixels 30 wide and 20 high."""
    blocks = [zlib.compress(b) for _, b in _blocks(v, size)]
    fields = [
        (256, "I", [v.shape[1]]), (257, "I", [v.shape[0]]), (258, "H", [64]), (259, "H", [8]), (277, "H", [1]), (322, "I", [size]), (323, "I", [size]),
        (324, "I", [0] * len(blocks)), (325, "I", [len(b) for b in blocks]), (339, "H", [3]), (33550, "d", [30.0, 20.0, 0.0]), (33922, "d", [0, 0, 0, 1000.0, 2000.0, 0]),
        (34735, "H", [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32633]),
    ]
    tail = 8 + 2 + 12 * len(fields) + 4
    data_at = tail + sum(n for _, t, x in fields if (n := struct.calcsize(f"<{len(x)}{t}")) > 4)
    starts = (data_at + np.cumsum([0, *map(len, blocks)])[:-1]).tolist()
    table, extra = struct.pack("<H", len(fields)), b""
    for tag, letter, values in fields:
        raw = struct.pack(f"<{len(values)}{letter}", *(starts if tag == 324 else values))
        table += struct.pack("<HHI", tag, {"H": 3, "I": 4, "d": 12}[letter], len(values))
        table += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", tail + len(extra))
        extra += raw if len(raw) > 4 else b""
    return b"II*\0" + struct.pack("<I", 8) + table + b"\0" * 4 + extra + b"".join(blocks)


def geotiff_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of a tiled file, with the points of its pixels."""
    path = f"{shared_path(spark, 'geotiff')}/surface.tif"
    write_whole(path, _geotiff(_image(spark, sf_dir)))
    out = read_geotiff(spark, path, window={"row": (5, 40), "column": (0, 9)}).frame_coordinates()
    return out.df.select("band", "pos_row", "pos_column", F.round("e", 6).alias("e"), F.round("n", 6).alias("n"), F.round("value", 4).alias("value"))


_ALL_CELLS = f"all_cells as (select q.range as q, d.range as d, coalesce(value, {FILL}) as value from range(50) q cross join range(11) d left join cells on pos_q = q.range and pos_d = d.range)"
GEOTIFF_SQL = f"""with {SURFACE_SQL}, {_ALL_CELLS} select 1::bigint as band, q - 5 as pos_row, d as pos_column, round(1000 + 30.0::double * (d + 0.5), 6) as e,
  round(2000 - 20.0::double * (q + 0.5), 6) as n, round(value, 4) as value from all_cells where q >= 5 and q < 40 and d < 9"""


def ngff_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level of two channels in chunks of 16 by 16; a chunk left out holds the fill value."""
    path, v = shared_path(spark, "ngff"), _image(spark, sf_dir)
    axes = [{"name": "c", "type": "channel"}, {"name": "y", "type": "space", "unit": "micrometer"}, {"name": "x", "type": "space", "unit": "micrometer"}]
    image = {"axes": axes, "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1, 2, 0.5]}]}]}
    write_whole(f"{path}/.zattrs", json.dumps({"multiscales": [image]}).encode())
    array = {"shape": [2, *SHAPE], "chunks": [1, 16, 16], "dtype": "<f8", "order": "C", "compressor": {"id": "zlib"}, "fill_value": FILL, "filters": None}
    write_whole(f"{path}/0/.zarray", json.dumps(array).encode())
    for c in range(2):
        for at, block in _blocks(v * (c + 1), 16):
            if (c, *at) != (1, 2, 0):
                write_whole(f"{path}/0/{c}.{at[0]}.{at[1]}", zlib.compress(block))
    out = read_ngff(spark, path, window={"y": (10, 50)}).frame_coordinates(prefix="at_")
    return out.df.select("c", "pos_y", "pos_x", F.round("at_y", 6).alias("y"), F.round("at_x", 6).alias("x"), F.round("value", 4).alias("value"))


NGFF_SQL = f"""with {SURFACE_SQL}, {_ALL_CELLS} select c.range as c, q - 10 as pos_y, d as pos_x, round(2.0::double * q, 6) as y, round(0.5::double * d, 6) as x,
  round(case when c.range = 1 and q >= 32 and q < 48 then {FILL} else value * (c.range + 1) end, 4) as value from all_cells, range(2) c where q >= 10"""


def _dicom(v: np.ndarray, number: int, z: float) -> bytes:
    """One slice, little-endian with explicit kinds."""
    text = {0x00080018: f"1.2.{number}", 0x0020000E: "1.2.9", 0x00200052: "1.2.8"}
    decimal = {0x00180050: "2.5", 0x00200032: f"-10\\20\\{z}", 0x00200037: "1\\0\\0\\0\\1\\0", 0x00280030: "0.75\\0.5", 0x00281052: "0", 0x00281053: "0.001"}
    short = {0x00280010: v.shape[0], 0x00280011: v.shape[1], 0x00280100: 16, 0x00280103: 1}
    out = b""
    for tag, kind, raw in sorted(
        [(t, b"UI", x.encode() + b"\0" * (len(x) % 2)) for t, x in text.items()] + [(t, b"DS", x.encode() + b" " * (len(x) % 2)) for t, x in decimal.items()]
        + [(t, b"US", struct.pack("<H", x)) for t, x in short.items()]
    ):
        out += struct.pack("<HH", tag >> 16, tag & 0xFFFF) + kind + struct.pack("<H", len(raw)) + raw
    data = v.astype("<i2").tobytes()
    syntax = b"1.2.840.10008.1.2.1\0"
    meta = struct.pack("<HH", 2, 0x10) + b"UI" + struct.pack("<H", len(syntax)) + syntax
    return b"\0" * 128 + b"DICM" + meta + out + struct.pack("<HH", 0x7FE0, 0x10) + b"OW\0\0" + struct.pack("<I", len(data)) + data


def dicom_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five slices of ten rows, named against their order along the normal."""
    path, v = shared_path(spark, "dicom"), np.rint(_image(spark, sf_dir) * 1000)
    for k in range(5):
        write_whole(f"{path}/{9 - k}.dcm", _dicom(v[10 * k : 10 * k + 10], k, 3.0 * k))
    out, _ = read_dicom(spark, path, series_uid="1.2.9")
    out = out.frame_coordinates(prefix="at_")
    names = dict(zip(out.grid.frame.axes, "xyz", strict=True))
    return out.df.select("pos_slice", "pos_row", "pos_column", *[F.round(f"at_{a}", 6).alias(n) for a, n in names.items()], F.round("value", 4).alias("value"))


DICOM_SQL = f"""with {SURFACE_SQL}, {_ALL_CELLS} select q // 10 as pos_slice, q % 10 as pos_row, d as pos_column, round(-10 + 0.5::double * d, 6) as x,
  round(20 + 0.75::double * (q % 10), 6) as y, round(3.0::double * (q // 10), 6) as z, round(round(value * 1000) * 0.001::double, 4) as value from all_cells"""


def nifti_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface as two planes of a volume, written and read again in part."""
    frame = ReferenceFrame.declared("framegrid", "scan", patient_coordinate_system("RAS"))
    source = ArrayCoordinates(("i", "j", "k"), ("1",) * 3, sample_offset=(0.5,) * 3)
    t = AffineTransform.from_matrix(np.diag([1.0, 2.0, 3.0]), source=source, target=frame, translation=[4, 5, 6])
    grid = Grid(t, {a: (a, np.arange(n)) for a, n in zip("ijk", (*SHAPE, 2), strict=True)})
    planes = surface(spark, sf_dir).withColumn("pos_k", F.explode(F.expr("sequence(0L, 1L)")))
    volume = planes.select(F.col("pos_q").alias("pos_i"), F.col("pos_d").alias("pos_j"), "pos_k", (F.col("value") + F.col("pos_k")).alias("value"))
    path = f"{shared_path(spark, 'nifti')}/surface.nii"
    write_nifti(frame_table(volume, grid), path)
    out = read_nifti(spark, path, frame=frame, window={"i": (20, 50), "k": (1, 2)})
    return out.df.filter(~F.isnan("value")).select("pos_i", "pos_j", "pos_k", F.round("value", 4).alias("value"))


NIFTI_SQL = f"with {SURFACE_SQL} select pos_q - 20 as pos_i, pos_d as pos_j, 0::bigint as pos_k, round(value + 1, 4) as value from cells where pos_q >= 20"


def claimed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth quantity, counted down and doubled: the result claims the source samples' cells."""
    source = framed(spark, sf_dir)
    labels = source.grid.axis("q").flat
    held = Grid(source.grid.transform, source.grid.coordinates, intervals={"q": np.stack([labels - 0.5, labels + 0.5], 1)})
    own = ArrayCoordinates(("u", "v"), ("1", "1"), sample_offset=(0.5, None))
    t = AffineTransform.from_matrix([[-0.5, 0], [0, 1]], source=own, target=PLANE, translation=[0, 0.25])
    target = Grid(t, {"u": ("u", -2.0 * np.arange(50, 0, -5)), "v": ("v", np.arange(10))})
    out = frame_table(source.df.select("pos_q", "pos_d", "value"), held).resample_to(target, fill_value=FILL)
    low, high = (F.element_at(F.array(*[F.lit(float(x)) for x in out.grid.intervals["u"][:, k]]), (F.col("pos_u") + 1).cast("int")) for k in (0, 1))
    return out.df.select("pos_u", "pos_v", low.alias("low"), high.alias("high"), F.round("value", 4).alias("value"))


CLAIMS_SQL = f"""with {SURFACE_SQL}, {_ALL_CELLS} select u.range as pos_u, v.range as pos_v, (-2 * (50 - 5 * u.range) - 1)::double as low, (-2 * (50 - 5 * u.range) + 1)::double as high,
  round(0.75::double * a.value + 0.25::double * b.value, 4) as value from range(10) u cross join range(10) v
  join all_cells a on a.q = 49 - 5 * u.range and a.d = v.range join all_cells b on b.q = a.q and b.d = a.d + 1"""

# Transform files of numbers and images, relations, CF tables --------------------------------------------------


def itk_mat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shear about a centre, from a MATLAB file."""
    path, out = f"{shared_path(spark, 'mat')}/affine.mat", b""
    for name, v in (("AffineTransform_double_3_3", [1, 0.5, 0, 0, 2, 0, 0, 0, 1, 3, -1, 0]), ("fixed", [0, 4, 0])):
        out += struct.pack("<5i", 0, len(v), 1, 0, len(name) + 1) + name.encode() + b"\0" + struct.pack(f"<{len(v)}d", *v)
    write_whole(path, out)
    return _mapped(_xyz(spark, sf_dir), read_itk_transform(path, fixed=FIXED, moving=MOVING))


MAT_SQL = """select l_orderkey, l_linenumber, round(l_quantity + 0.5 * (l_discount - 4) + 3, 6) as x, round(2 * (l_discount - 4) + 4 - 1, 6) as y, round(l_tax, 6) as z from lineitem"""


def displacement_image_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of displacements that grow along its first axis; points outside its cells stay."""
    sizes = (5, 3, 2)
    head = {"dim": [5, *sizes, 1, 3, 1, 1], "pixdim": [1.0, 8.0, 8.0, 8.0, 1, 1, 0, 0], "xyzt_units": 2, "sform_code": 1, "qform_code": 0,
            "srow_x": [-8, 0, 0, 0], "srow_y": [0, -8, 0, 8], "srow_z": [0, 0, 8, -4]}
    raw = bytearray(build_nifti_header(head))
    raw[70:74], raw[108:120] = struct.pack("<2h", 64, 64), struct.pack("<3f", 352, 1, 0)
    u = np.broadcast_to(np.arange(5.0), (3, 1, 2, 3, 5)) * np.array([1.0, 0.0, -2.0]).reshape(3, 1, 1, 1, 1)
    path = f"{shared_path(spark, 'warp')}/warp.nii"
    write_whole(path, bytes(raw) + b"\0" * 4 + u.astype("<f8").tobytes())
    return _mapped(_xyz(spark, sf_dir), read_itk_transform(path, fixed=FIXED, moving=MOVING))


WARP_IMAGE_SQL = """with p as (select *, case when l_quantity < 36 then least(greatest(l_quantity / 8, 0), 4) else 0 end as u from lineitem)
select l_orderkey, l_linenumber, round(l_quantity + u, 6) as x, round(l_discount, 6) as y, round(l_tax - 2 * u, 6) as z from p"""


def registration_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two matrices of one item: the last listed acts first."""
    turn, shift = [0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1], [2, 0, 0, 10, 0, 2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1]
    parts = [{"FrameOfReferenceTransformationMatrix": m, "FrameOfReferenceTransformationMatrixType": k} for m, k in ((turn, "RIGID"), (shift, "RIGID_SCALE"))]
    item = {"FrameOfReferenceUID": "1.1", "MatrixRegistrationSequence": [{"MatrixSequence": parts}]}
    (t,) = registrations({"FrameOfReferenceUID": "1.2", "RegistrationSequence": [item]})
    return _mapped(_xyz(spark, sf_dir).toDF("l_orderkey", "l_linenumber", *t.source.axes), t)


REGISTRATION_SQL = """select l_orderkey, l_linenumber, round(-2 * l_discount + 1, 6) as x, round(2 * l_quantity + 10 + 2, 6) as y, round(2 * l_tax + 3, 6) as z from lineitem"""


def enu_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """East and north at each place, as vectors in Earth-centred axes."""
    rows = _places(spark, sf_dir)
    m = EastNorthUp(EARTH).directions([F.col("lon"), F.col("lat"), F.col("h")])
    whole = lambda c: F.when(F.abs(c) < 5e-7, 0.0).otherwise(F.round(c, 6))
    return rows.select("l_orderkey", "l_linenumber", *[whole(m[i][k]).alias(f"{n}_{a}") for k, n in enumerate(("east", "north")) for i, a in enumerate("xyz")])


_DIRECTIONS = {
    "east_x": "-sin(radians(lon))", "east_y": "cos(radians(lon))", "east_z": "0.0::double", "north_x": "-sin(radians(lat)) * cos(radians(lon))",
    "north_y": "-sin(radians(lat)) * sin(radians(lon))", "north_z": "cos(radians(lat))",
}
DIRECTIONS_SQL = f"""with {_PLACES_SQL} select l_orderkey, l_linenumber,
  {", ".join(f"case when abs({x}) < 5e-7 then 0.0::double else round({x}, 6) end as {n}" for n, x in _DIRECTIONS.items())} from p"""


def cf_table_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface as a table of longitudes west and latitudes, framed by its own labels, points and all."""
    rows = surface(spark, sf_dir).select((F.col("pos_q") * 2.0 + 1).alias("west"), (F.col("pos_d") - 5.0).alias("lat"), "value")
    out = cf_table(rows, {"west": {"units": "degrees_west"}, "lat": {"units": "degrees_north"}}, grid_mapping={"grid_mapping_name": "latitude_longitude", "earth_radius": 6371229.0})
    return out.frame_coordinates(prefix="at_").df.select("pos_west", "pos_lat", F.col("at_longitude").alias("longitude"), F.col("at_latitude").alias("latitude"), F.round("value", 4).alias("value"))


CF_TABLE_SQL = f"""with {SURFACE_SQL} select dense_rank() over (order by pos_q) - 1 as pos_west, dense_rank() over (order by pos_d) - 1 as pos_lat, (-2 * pos_q - 1)::double as longitude,
  (pos_d - 5)::double as latitude, round(value, 4) as value from cells"""

ALL = [
    (itk_mat_map, MAT_SQL), (displacement_image_map, WARP_IMAGE_SQL), (registration_map, REGISTRATION_SQL), (enu_directions, DIRECTIONS_SQL), (cf_table_points, CF_TABLE_SQL),
    (geotiff_pixels, GEOTIFF_SQL), (ngff_pixels, NGFF_SQL), (dicom_pixels, DICOM_SQL), (nifti_voxels, NIFTI_SQL), (claimed_cells, CLAIMS_SQL),
]

__all__ = ["ALL"]
