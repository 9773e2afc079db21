"""Pixel readers against arrays written here, and the cells a resampled result claims."""

import gzip
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegrid.functions.transforms import AffineTransform
from framegrid.operators.framed import frame_table
from framegrid.plans import anatomy
from framegrid.plans.declare import ArrayCoordinates, CoordinateSystem, ReferenceFrame
from framegrid.plans.grid import Grid
from framegrid.sources import dicom_files, nifti_files, rasters
from framegrid.sources.blocks import block_rows


def cube(df, names, shape):
    """The values of a long table as an array; every position has one row."""
    rows = df.select(*names, "value").collect()
    out = np.full(shape, np.nan)
    for r in rows:
        out[tuple(r[:-1])] = r[-1]
    assert len(rows) == np.prod(shape)
    return out


def test_blocks_cover_a_window(spark):
    v = np.arange(7 * 5, dtype=float).reshape(7, 5)

    def opened():
        return lambda at: None if at == (1, 1) else v[at[0] * 3 : at[0] * 3 + 3, at[1] * 2 : at[1] * 2 + 2]

    got = cube(block_rows(spark, ("a", "b"), v.shape, (3, 2), opened, window={"a": (2, 6), "b": (1, 5)}, fill=-1.0), ["pos_a", "pos_b"], (4, 4))
    want = v.copy()
    want[3:6, 2:4] = -1
    np.testing.assert_array_equal(got, want[2:6, 1:5])
    assert block_rows(spark, ("a", "b"), v.shape, (3, 2), opened).count() == 35 - 6
    assert block_rows(spark, ("a", "b"), v.shape, (3, 2), opened, window={"a": (2, 2)}).count() == 0
    with pytest.raises(ValueError):
        block_rows(spark, ("a", "b"), v.shape, (3, 2), opened, window={"a": (0, 8)})


def lzw_packed(data):
    """Codes most significant bit first, with the width one entry early."""
    table, codes, last, width = {bytes([k]): k for k in range(256)}, [(256, 9)], b"", 9
    n = 258
    for byte in data:
        if last + bytes([byte]) in table:
            last += bytes([byte])
            continue
        codes.append((table[last], width))
        table[last + bytes([byte])] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        last = bytes([byte])
        if n == 4094:
            codes.append((256, width))
            table, n, width = {bytes([k]): k for k in range(256)}, 258, 9
    codes += [(table[last], width), (257, width)]
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))


def test_lzw_round_trip():
    rng = np.random.default_rng(1)
    for data in (b"aaaaaaaaaa", bytes(rng.integers(0, 4, 300, dtype=np.uint8)), bytes(rng.integers(0, 256, 30_000, dtype=np.uint8))):
        assert rasters.lzw(lzw_packed(data)) == data


def tiff(v, *, order="<", big=False, tile=None, strip=4, compression=1, predictor=1, planar=1, nodata=None, skip=(), code=32633, raster=1):
    """A file of the (band, row, column) array ``v``."""
    bands, height, width = v.shape
    kind = {"u": 1, "i": 2, "f": 3}[v.dtype.kind]
    rows, cols = tile or (strip, width)
    blocks = []
    for plane in ([v[b : b + 1] for b in range(bands)] if planar == 2 else [v]):
        for r in range(0, height, rows):
            for c in range(0, width, cols):
                part = np.zeros((rows if tile else min(rows, height - r), cols, len(plane)), v.dtype)
                cut = np.moveaxis(plane[:, r : r + rows, c : c + cols], 0, -1)
                part[: cut.shape[0], : cut.shape[1]] = cut
                if predictor == 2:
                    part[:, 1:] = part[:, 1:] - part[:, :-1].copy()
                data = part.astype(part.dtype.newbyteorder(order)).tobytes()
                if predictor == 3:
                    n = len(plane)
                    by = part.astype(part.dtype.newbyteorder(">")).reshape(len(part), -1).view(np.uint8).reshape(len(part), -1, v.dtype.itemsize)
                    by = np.moveaxis(by, 2, 1).reshape(len(part), -1, n)
                    by[:, 1:] = by[:, 1:] - by[:, :-1].copy()
                    data = by.tobytes()
                blocks.append(b"" if len(blocks) in skip else {1: bytes, 8: zlib.compress, 5: lzw_packed}[compression](data))
    fields = [(256, "I", [width]), (257, "I", [height]), (258, "H", [v.dtype.itemsize * 8] * bands), (259, "H", [compression]), (277, "H", [bands]), (284, "H", [planar]),
              (317, "H", [predictor]), (339, "H", [kind] * bands), (33550, "d", [2.0, 3.0, 0.0]), (33922, "d", [0, 0, 0, 100.0, 200.0, 0]),
              (34735, "H", [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, raster, 3072, 0, 1, code])]
    fields += [(322, "H", [cols]), (323, "H", [rows])] if tile else [(278, "H", [rows])]
    fields += [(42113, "s", [nodata])] if nodata else []
    names = (324, 325) if tile else (273, 279)
    fields = sorted([*fields, (names[0], "Q" if big else "I", [0] * len(blocks)), (names[1], "I", [len(b) for b in blocks])])
    types = {"H": 3, "I": 4, "s": 2, "d": 12, "Q": 16}
    size, inline, head = (20, 8, 16) if big else (12, 4, 8)
    at = head + (8 if big else 2) + size * len(fields) + (8 if big else 4)
    raw = {}
    for tag, letter, values in fields:
        raw[tag] = values[0].encode() + b"\0" if letter == "s" else struct.pack(f"{order}{len(values)}{letter}", *values)
        at += len(raw[tag]) if len(raw[tag]) > inline else 0
    starts = np.cumsum([at, *map(len, blocks)])[:-1]
    raw[names[0]] = struct.pack(f"{order}{len(blocks)}{'Q' if big else 'I'}", *starts)
    word = "Q" if big else "I"
    out = (b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, head) if big else struct.pack(f"{order}HI", 42, head))
    out += struct.pack(f"{order}{'Q' if big else 'H'}", len(fields))
    place, tail = head + (8 if big else 2) + size * len(fields) + (8 if big else 4), b""
    for tag, letter, values in fields:
        out += struct.pack(f"{order}HH{word}", tag, types[letter], len(raw[tag]) if letter == "s" else len(values))
        if len(raw[tag]) > inline:
            out += struct.pack(f"{order}{word}", place + len(tail))
            tail += raw[tag]
        else:
            out += raw[tag].ljust(inline, b"\0")
    return out + b"\0" * (8 if big else 4) + tail + b"".join(blocks)


@pytest.mark.parametrize(
    "options",
    [
        {"dtype": "u1"}, {"dtype": "i2", "order": ">", "tile": (16, 16), "compression": 8, "predictor": 2}, {"dtype": "f4", "tile": (16, 16), "compression": 8, "predictor": 3},
        {"dtype": "f8", "big": True, "planar": 2, "compression": 5}, {"dtype": "u2", "big": True, "order": ">", "tile": (16, 32), "compression": 5, "predictor": 2},
        {"dtype": "f8", "order": ">", "compression": 8, "predictor": 3, "planar": 2},
    ],
)
def test_geotiff_pixels(spark, tmp_path, options):
    v = (np.random.default_rng(3).normal(100, 30, (2, 21, 37)).clip(0, 250)).astype(options["dtype"])
    path = f"{tmp_path}/a.tif"
    with open(path, "wb") as f:
        f.write(tiff(v, **{k: x for k, x in options.items() if k != "dtype"}))
    got = rasters.read_geotiff(spark, path, window={"row": (3, 20), "column": (5, 37)})
    assert got.grid.sizes == {"row": 17, "column": 32} and got.carried == ("band",) and got.grid.frame.identifier == ("epsg", "32633")
    np.testing.assert_allclose(got.grid.point_at(row=0, column=0), [100 + 2 * 5.5, 200 - 3 * 3.5])
    shifted = got.df.withColumn("b", F.col("band") - 1)
    np.testing.assert_array_equal(cube(shifted, ["b", "pos_row", "pos_column"], (2, 17, 32)), v[:, 3:20, 5:].astype(float))
    one = rasters.read_geotiff(spark, path, bands=[2])
    assert [r[0] for r in one.df.select("band").distinct().collect()] == [2]
    np.testing.assert_array_equal(cube(one.df, ["pos_row", "pos_column"], (21, 37)), v[1].astype(float))


def test_geotiff_metadata_and_refusals(spark, tmp_path):
    v = np.arange(12.0).reshape(1, 4, 3)
    path = f"{tmp_path}/a.tif"
    with open(path, "wb") as f:
        f.write(tiff(v, strip=2, nodata="-9", skip=(1,), raster=2, code=32767))
    got = rasters.read_geotiff(spark, path)
    assert got.df.schema["value"].metadata == {"nodata": -9.0}
    np.testing.assert_array_equal(cube(got.df, ["pos_row", "pos_column"], (4, 3)), np.concatenate([v[0, :2], np.full((2, 3), -9.0)]))
    np.testing.assert_allclose(got.grid.point_at(row=0, column=0), [100, 200])
    own = {"kind": "projected", "unit": "metre", "axes": ("N", "E"), "northing_first": True, "authority": "EPSG", "code": 3035}
    np.testing.assert_allclose(rasters.read_geotiff(spark, path, crs=own).grid.point_at(row=1, column=0), [197, 100])
    for bad in ({"bands": [2]}, {"bands": [1, 1]}, {"crs": {**own, "kind": "geographic"}}):
        with pytest.raises(ValueError):
            rasters.read_geotiff(spark, path, **bad)
    with open(path, "wb") as f:
        f.write(b"no raster")
    with pytest.raises(ValueError):
        rasters.read_geotiff(spark, path)


AXES = [{"name": "c", "type": "channel"}, {"name": "y", "type": "space", "unit": "micrometer"}, {"name": "x", "type": "space", "unit": "micrometer"}]
IMAGE = {"axes": AXES, "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1, 2, 3]}]}]}


def store(root, v, chunks, *, version, codec=None, fill=0, skip=(), order="C"):
    import zstandard

    (root / "0").mkdir(parents=True)
    if version == 2:
        (root / ".zattrs").write_text(json.dumps({"multiscales": [IMAGE]}))
        meta = {"shape": v.shape, "chunks": chunks, "dtype": v.dtype.str, "order": order, "compressor": {"id": codec} if codec else None, "fill_value": fill, "dimension_separator": "/", "filters": None}
        (root / "0/.zarray").write_text(json.dumps(meta))
    else:
        (root / "zarr.json").write_text(json.dumps({"attributes": {"ome": {"multiscales": [IMAGE]}}}))
        codecs = [*([{"name": "transpose", "configuration": {"order": [2, 0, 1]}}] if order == "T" else []), {"name": "bytes", "configuration": {"endian": "big"}}]
        codecs += [{"name": codec}] if codec else []
        meta = {"node_type": "array", "shape": v.shape, "data_type": v.dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "fill_value": fill, "codecs": codecs}
        (root / "0/zarr.json").write_text(json.dumps(meta))
    pack = {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress, "zstd": lambda b: zstandard.ZstdCompressor().compress(b)}[codec]
    for at in np.ndindex(*[-(-n // c) for n, c in zip(v.shape, chunks, strict=True)]):
        if at in skip:
            continue
        part = np.zeros(chunks, v.dtype)
        cut = v[tuple(slice(k * c, k * c + c) for k, c in zip(at, chunks, strict=True))]
        part[tuple(slice(n) for n in cut.shape)] = cut
        part = part.transpose(2, 0, 1) if order == "T" else part
        data = (part if version == 2 else part.astype(part.dtype.newbyteorder(">"))).tobytes(order="F" if order == "F" else "C")
        path = root / "0" / ("c/" if version == 3 else "") / "/".join(map(str, at))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(pack(data))


@pytest.mark.parametrize(
    "options", [{"version": 2, "codec": "zlib"}, {"version": 2, "codec": "zstd", "order": "F"}, {"version": 2}, {"version": 3, "codec": "gzip", "order": "T"}, {"version": 3, "codec": "zstd"}]
)
def test_ngff_pixels(spark, tmp_path, options):
    v = np.random.default_rng(5).integers(0, 1000, (2, 9, 11)).astype("u2")
    store(tmp_path / "s", v, (1, 4, 5), skip=((1, 0, 1),), fill=7, **options)
    want = v.astype(float)
    want[1, 0:4, 5:10] = 7
    got = rasters.read_ngff(spark, f"{tmp_path}/s", window={"y": (2, 9)})
    assert got.carried == ("c",) and got.grid.dims == ("y", "x") and got.grid.frame.units == ("um", "um")
    np.testing.assert_allclose(got.grid.point_at(y=0, x=1), [4, 3])
    np.testing.assert_array_equal(cube(got.df, ["c", "pos_y", "pos_x"], (2, 7, 11)), want[:, 2:])


def test_ngff_refusals(spark, tmp_path):
    v = np.zeros((1, 2, 2), "f4")
    store(tmp_path / "a", v, (1, 2, 2), version=2, fill=None, skip=((0, 0, 0),))
    assert rasters.read_ngff(spark, f"{tmp_path}/a").df.count() == 0
    (tmp_path / "a/0/.zarray").write_text(json.dumps({"shape": [1, 2, 2], "chunks": [1, 2, 2], "dtype": "<f4", "compressor": {"id": "blosc"}}))
    for bad in ("a", "none"):
        with pytest.raises(ValueError):
            rasters.read_ngff(spark, f"{tmp_path}/{bad}")


def element(tag, kind, value, explicit=True):
    if isinstance(value, list):
        value = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + x + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) for x in value)
    elif isinstance(value, str):
        value = value.encode() + b" " * (len(value) % 2)
    elif isinstance(value, int):
        value = struct.pack("<H", value)
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF)
    if not explicit:
        return head + struct.pack("<I", len(value)) + value
    return head + kind.encode() + (struct.pack("<HI", 0, len(value)) if kind in ("OW", "SQ") else struct.pack("<H", len(value))) + value


def dicom(path, v, elements, syntax=dicom_files.EXPLICIT):
    explicit = syntax != dicom_files.IMPLICIT
    own = {0x00280010: ("US", v.shape[-2]), 0x00280011: ("US", v.shape[-1]), 0x00280100: ("US", 16), 0x00280103: ("US", 1), 0x7FE00010: ("OW", v.astype("<i2").tobytes())}
    body = b"".join(element(t, *x, explicit) for t, x in sorted({**elements, **own}.items()))
    if syntax == dicom_files.DEFLATED:
        c = zlib.compressobj(wbits=-15)
        body = c.compress(body) + c.flush()
    with open(path, "wb") as f:
        f.write(b"\0" * 128 + b"DICM" + element(0x00020010, "UI", syntax) + body)


@pytest.mark.parametrize("syntax", [dicom_files.EXPLICIT, dicom_files.IMPLICIT, dicom_files.DEFLATED])
def test_dicom_series(spark, tmp_path, syntax):
    v = np.random.default_rng(6).integers(-50, 50, (4, 3, 5))
    for n, k in enumerate((2, 0, 3, 1)):
        fields = {0x00080018: ("UI", f"1.{k}"), 0x0020000E: ("UI", "9.9"), 0x00200052: ("UI", "7.7"), 0x00200032: ("DS", f"1\\2\\{3 + 2.5 * k}"), 0x00200037: ("DS", "1\\0\\0\\0\\1\\0"),
                  0x00280030: ("DS", "0.5\\0.25"), 0x00180050: ("DS", "2.5"), 0x00281052: ("DS", "-10"), 0x00281053: ("DS", "2")}
        dicom(f"{tmp_path}/{n}.dcm", v[k], fields, syntax)
    got, stack = dicom_files.read_dicom(spark, str(tmp_path), series_uid="9.9")
    assert stack.order == (1, 3, 0, 2) or sorted(stack.order) == [0, 1, 2, 3]
    np.testing.assert_array_equal(cube(got.df, ["pos_slice", "pos_row", "pos_column"], v.shape), 2 * v - 10.0)
    np.testing.assert_allclose(got.grid.point_at(slice=1, row=1, column=2), [1.5, 2.5, 5.5])
    raw, _ = dicom_files.read_dicom(spark, str(tmp_path), modality_lut=False)
    assert raw.df.agg(F.sum("value")).first()[0] == v.sum()
    assert dicom_files.read_dicom_headers(spark, str(tmp_path)).select("series").distinct().count() == 1
    with pytest.raises(ValueError):
        dicom_files.read_dicom(spark, str(tmp_path), series_uid="1")


def test_dicom_frames(spark, tmp_path):
    v = np.random.default_rng(7).integers(0, 99, (3, 2, 2))
    group = lambda *x: b"".join(x)
    shared = group(element(0x00209116, "SQ", [element(0x00200037, "DS", "1\\0\\0\\0\\1\\0")]), element(0x00289110, "SQ", [group(element(0x00180050, "DS", "1"), element(0x00280030, "DS", "1\\1"))]))
    frames = [element(0x00209113, "SQ", [element(0x00200032, "DS", f"0\\0\\{-k}")]) + element(0x00289145, "SQ", [element(0x00281052, "DS", str(k)) + element(0x00281053, "DS", "1")]) for k in range(3)]
    dicom(f"{tmp_path}/m.dcm", v, {0x00280008: ("IS", "3"), 0x0020000E: ("UI", "9"), 0x52009229: ("SQ", [shared]), 0x52009230: ("SQ", frames)})
    got, _ = dicom_files.read_dicom(spark, f"{tmp_path}/m.dcm", frame_indices=[0, 2])
    np.testing.assert_array_equal(cube(got.df, ["pos_slice", "pos_row", "pos_column"], (2, 2, 2)), np.stack([v[2] + 2.0, v[0]]))
    with pytest.raises(ValueError):
        dicom_files.parse_dicom(b"\0" * 200)


def test_nifti_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nifti_files, "BLOCK_BYTES", 200)
    frame = ReferenceFrame.declared("t", "p", anatomy.patient_coordinate_system("RAS"))
    t = AffineTransform.from_matrix(np.eye(3), source=ArrayCoordinates(("i", "j", "k"), ("1",) * 3, sample_offset=(0.5,) * 3), target=frame, translation=[0] * 3)
    g = Grid(t, {a: (a, np.arange(n)) for a, n in zip("ijk", (3, 4, 5), strict=True)})
    df = g.to_df(spark, coordinates=False).withColumn("value", (F.col("pos_i") + 10 * F.col("pos_j") + 100 * F.col("pos_k")).cast("double"))
    path = f"{tmp_path}/v.nii"
    nifti_files.write_nifti(frame_table(df, g), path)
    with open(path, "rb") as f:
        data = f.read()
    with gzip.open(path + ".gz", "wb") as f:
        f.write(data)
    for p in (path, path + ".gz"):
        got = nifti_files.read_nifti(spark, p, frame=frame, window={"k": (1, 4), "i": (1, 3)})
        assert got.grid.sizes == {"i": 2, "j": 4, "k": 3} and got.df.count() == 24
        assert got.df.filter("value <> pos_i + 1 + 10 * pos_j + 100 * (pos_k + 1)").count() == 0
        np.testing.assert_allclose(got.grid.point_at(i=0, j=0, k=0), [1, 0, 1])


def test_claimed_cells(spark):
    plane = ReferenceFrame.declared("t", "plane", CoordinateSystem(("x", "y"), ("m", "m")))

    def grid(matrix, x, y, cells=None, offset=None, shift=(0, 0)):
        source = ArrayCoordinates(("a", "b"), ("1", "1"), sample_offset=(offset, offset))
        return Grid(AffineTransform.from_matrix(matrix, source=source, target=plane, translation=shift), {"a": ("a", x), "b": ("b", y)}, intervals=cells)

    cells = np.array([[0.0, 1.0], [1.0, 3.0], [3.0, 4.0]])
    source = grid(np.eye(2), np.array([0.5, 2.0, 3.5]), np.arange(4.0), {"a": cells})
    table = frame_table(source.to_df(spark, coordinates=False).withColumn("value", F.col("pos_a").cast("double")), source)
    met = table.resample_to(grid([[-2, 0], [0, 1]], np.array([-1.75, -1.0]), np.array([0.5, 1.5])))
    np.testing.assert_allclose(met.grid.intervals["a"], [[-2, -1.5], [-1.5, -0.5]])
    assert set(met.grid.intervals) == {"a"} and met.df.count() == 4
    for other in (grid(np.eye(2), np.array([0.5, 1.0]), np.arange(2.0)), grid([[0.8, -0.6], [0.6, 0.8]], np.array([0.5, 2.0]), np.arange(2.0)),
                  grid(np.eye(2), np.array([0.5, 2.0]), np.arange(2.0), offset=0.0)):
        assert not table.resample_to(other).grid.intervals
    wide = grid(np.eye(2), np.array([1.0, 3.0]), np.arange(4.0), {"a": np.array([[0.0, 2.0], [2.0, 4.0]])})
    mean = table.resample_to(wide, method="step", support="average")
    np.testing.assert_allclose(mean.grid.intervals["a"], [[0, 2], [2, 4]])
    assert not table.resample_to(wide, method="step").grid.intervals
