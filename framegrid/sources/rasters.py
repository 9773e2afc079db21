"""Pixels of projected GeoTIFF files and of NGFF (OME-Zarr) levels as framed tables, read block by block."""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from framegrid.operators.framed import FramedDF, frame_table
from framegrid.plans.declare import ReferenceFrame
from framegrid.plans.grid import Grid
from framegrid.sources.blocks import File, block_rows, checked_window, read_whole
from framegrid.sources.headers import geotiff_grid, ngff_grid

# TIFF ---------------------------------------------------------------------------------------------------

# Tags, field types, sample kinds, keys and unit codes of the format (fixed values).
_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "strip_offsets", 277: "samples", 278: "strip_rows", 279: "strip_bytes",
         284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_bytes", 339: "kind",
         33550: "scale", 33922: "tiepoints", 34264: "matrix", 34735: "keys", 42113: "nodata"}
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}
_LISTS = ("strip_offsets", "strip_bytes", "tile_offsets", "tile_bytes")
_MODEL, _RASTER, _PROJECTED, _LINEAR_UNIT = 1024, 1025, 3072, 3076
_UNITS = {9001: "metre", 9002: "foot", 9003: "US_survey_foot"}
_USER_DEFINED = 32767


def tiff_header(file: File) -> dict[str, Any]:
    """The first image's fields. Lists with one entry for each block stay in the file, as (type, number, place)."""
    head = file.read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(f"{order}Q", file.read(8, 8))[0] if big else struct.unpack(f"{order}I", head[4:])[0]
    width = 8 if big else 2
    n = struct.unpack(f"{order}{'Q' if big else 'H'}", file.read(at, width))[0]
    size, inline = (20, 8) if big else (12, 4)
    table = file.read(at + width, n * size)
    out: dict[str, Any] = {"order": order}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HH{'Q' if big else 'I'}", table, k * size)
        if tag not in _TAGS or kind not in _TYPES:
            continue
        letter = _TYPES[kind]
        length = struct.calcsize(f"={letter}") * count
        place = at + width + k * size + size - inline
        if length > inline:
            place = struct.unpack_from(f"{order}{'Q' if big else 'I'}", table, k * size + size - inline)[0]
        if _TAGS[tag] in _LISTS:
            out[_TAGS[tag]] = (letter, count, place)
        else:
            data = file.read(place, length)
            out[_TAGS[tag]] = data.rstrip(b"\0").decode("latin-1") if letter == "s" else struct.unpack(f"{order}{count}{letter}", data)
    for name, default in (("samples", 1), ("planar", 1), ("compression", 1), ("predictor", 1), ("kind", 1), ("bits", 1)):
        out.setdefault(name, (default,))
    if len(set(out["bits"])) != 1 or out["bits"][0] not in (8, 16, 32, 64) or len(set(out["kind"])) != 1 or out["kind"][0] not in _KINDS:
        raise ValueError("samples are whole bytes, all of one kind")
    return out


def tiff_profile(header: Mapping[str, Any], *, crs: Mapping[str, Any] | None = None) -> tuple[dict[str, Any], str]:
    """(profile, Area or Point) for ``geotiff_grid``. ``crs`` replaces what the file's keys say.

    The keys hold no axis order: easting comes first unless ``crs`` says otherwise.
    """
    keys = header.get("keys", ())
    found = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4) if keys[k + 1] == 0}
    if crs is None:
        kind = {1: "projected", 2: "geographic", 3: "geocentric"}.get(found.get(_MODEL), "unknown")
        crs = {"kind": kind, "unit": _UNITS.get(found.get(_LINEAR_UNIT, 9001), "metre"), "axes": ("E", "N")}
        if found.get(_LINEAR_UNIT, 9001) not in _UNITS:
            raise ValueError(f"linear unit {found[_LINEAR_UNIT]} is not known; give the reference system")
        if found.get(_PROJECTED, _USER_DEFINED) != _USER_DEFINED:
            crs |= {"authority": "EPSG", "code": found[_PROJECTED]}
    if "matrix" in header:
        m = header["matrix"]
        affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif "scale" in header and len(header.get("tiepoints", ())) == 6:
        (sx, sy), (i, j, _, x, y, _) = header["scale"][:2], header["tiepoints"]
        affine = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        raise ValueError("the file has no affine georeference")
    profile = {"crs": crs, "transform": affine, "width": header["width"][0], "height": header["height"][0]}
    return profile, "Point" if found.get(_RASTER) == 2 else "Area"


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table and 257 ends."""
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, last, width, held, bits = list(single), [], b"", 9, 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = list(single), b"", 9
            continue
        if code > len(table) or code == len(table) and not last:
            raise ValueError("the data is not LZW")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        # Codes grow one entry before the table is full.
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def _inflated(data: bytes, compression: int, length: int) -> bytes:
    if compression == 1:
        return data
    if compression in (8, 32946):
        return zlib.decompress(data)
    if compression == 5:
        return lzw(data)
    if compression == 50000:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=length)
    raise ValueError(f"compression {compression} is not supported")


def _entry(file: File, header: Mapping[str, Any], name: str, k: int) -> int:
    letter, _, place = header[name]
    size = struct.calcsize(f"={letter}")
    return struct.unpack(f"{header['order']}{letter}", file.read(place + k * size, size))[0]


def _tiff_layout(header: Mapping[str, Any]) -> tuple[int, int, str]:
    """Rows and columns of a block, and the kind of block."""
    if "tile_width" in header:
        return header["tile_height"][0], header["tile_width"][0], "tile"
    return min(header.get("strip_rows", header["height"])[0], header["height"][0]), header["width"][0], "strip"


def tiff_block(file: File, header: Mapping[str, Any], band: int, row: int, column: int) -> np.ndarray | None:
    """The samples of one band in the block at a block row and column; None if the file leaves it out."""
    rows, cols, kind = _tiff_layout(header)
    samples, planar = header["samples"][0], header["planar"][0] == 2
    down, across = -(-header["height"][0] // rows), -(-header["width"][0] // cols)
    k = row * across + column + (band * down * across if planar else 0)
    length = _entry(file, header, f"{kind}_bytes", k)
    if length == 0:
        return None
    n = 1 if planar else samples
    dtype = np.dtype(f"{header['order']}{_KINDS[header['kind'][0]]}{header['bits'][0] // 8}")
    whole = rows if kind == "tile" else min(rows, header["height"][0] - row * rows)
    data = _inflated(file.read(_entry(file, header, f"{kind}_offsets", k), length), header["compression"][0], whole * cols * n * dtype.itemsize)
    predictor = header["predictor"][0]
    if predictor == 3:
        # Each line holds the most significant bytes of all samples first, as differences of bytes.
        lines = np.frombuffer(data, np.uint8, whole * cols * n * dtype.itemsize).reshape(whole, -1, n)
        summed = np.cumsum(lines, axis=1, dtype=np.uint8).reshape(whole, dtype.itemsize, cols * n)
        v = np.ascontiguousarray(np.moveaxis(summed, 1, 2)).view(dtype.newbyteorder(">")).reshape(whole, cols, n)
    else:
        v = np.frombuffer(data, dtype, whole * cols * n).reshape(whole, cols, n)
        if predictor == 2:
            v = np.cumsum(v.astype(dtype.newbyteorder("=")), axis=1, dtype=dtype.newbyteorder("="))
    return v[:, :, 0 if planar else band]


def read_geotiff(spark: SparkSession, path: str, *, frame: ReferenceFrame | None = None, bands: Sequence[int] | None = None,
                 crs: Mapping[str, Any] | None = None, window: Mapping[str, tuple[int, int]] | None = None) -> FramedDF:
    """One projected file's pixels, with bands counted from 1 as a carried column.

    Only blocks that reach the ``window`` of rows and columns are read, by range. The nodata value is
    stated in the value column's metadata; pixels are not masked or scaled.
    """
    header = tiff_header(File(path))
    count = header["samples"][0]
    chosen = list(range(1, count + 1)) if bands is None else list(bands)
    if not chosen or len(set(chosen)) != len(chosen) or any(not 1 <= b <= count for b in chosen):
        raise ValueError(f"bands are distinct numbers from 1 to {count}")
    profile, kind = tiff_profile(header, crs=crs)
    grid = geotiff_grid(profile, area_or_point=kind)
    if frame is not None:
        grid = Grid.of(grid.transform.with_endpoints(target=frame), grid.axes, grid.dims)
    rows, cols, _ = _tiff_layout(header)

    def opened():
        file = File(path)
        return lambda at: None if (v := tiff_block(file, header, chosen[at[0]] - 1, at[1], at[2])) is None else v[None]

    sizes = (len(chosen), profile["height"], profile["width"])
    nodata = float(header["nodata"]) if header.get("nodata", "").strip() else None
    df = block_rows(spark, ("band", "row", "column"), sizes, (1, rows, cols), opened, labels=("band",), window=window, item_bytes=header["bits"][0] // 8, fill=nodata if nodata is not None else 0.0)
    df = df.withColumn("band", F.element_at(F.array(*[F.lit(int(b)) for b in chosen]), (F.col("band") + 1).cast("int")).cast("long"))
    if nodata is not None:
        df = df.withMetadata("value", {"nodata": nodata})
    bounds = checked_window(("row", "column"), sizes[1:], window)
    return frame_table(df, grid.isel(**{d: slice(*b) for d, b in zip(("row", "column"), bounds, strict=True)}), carried=("band",))


# Zarr ---------------------------------------------------------------------------------------------------


def _fill(value: Any, dtype: np.dtype) -> float | None:
    if value is None:
        return None
    named = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}
    return named[value] if isinstance(value, str) and value in named else float(np.dtype(dtype).type(value))


def zarr_array(uri: str) -> dict[str, Any]:
    """Shape, chunks, type, order, codecs, fill and chunk names of an array of format 2 or 3."""
    if (text := read_whole(f"{uri}/zarr.json")) is not None:
        m = json.loads(text)
        if m.get("node_type") != "array" or m["chunk_grid"]["name"] != "regular":
            raise ValueError(f"{uri} is not an array of regular chunks")
        encoding = m.get("chunk_key_encoding", {"name": "default"})
        dtype, axes, codecs = np.dtype(m["data_type"]), None, []
        for c in m["codecs"]:
            options = c.get("configuration", {})
            if c["name"] == "bytes":
                dtype = dtype.newbyteorder(">" if options.get("endian") == "big" else "<")
            elif c["name"] == "transpose":
                axes = [int(k) for k in options["order"]]
            elif c["name"] in ("gzip", "zstd", "crc32c"):
                codecs.append(c["name"])
            else:
                raise ValueError(f"codec {c['name']!r} is not supported")
        default = encoding["name"] == "default"
        separator = encoding.get("configuration", {}).get("separator", "/" if default else ".")
        return {"shape": m["shape"], "chunks": m["chunk_grid"]["configuration"]["chunk_shape"], "dtype": dtype, "axes": axes, "codecs": codecs[::-1],
                "fill": _fill(m.get("fill_value"), dtype), "prefix": f"c{separator}" if default else "", "separator": separator}
    if (text := read_whole(f"{uri}/.zarray")) is None:
        raise FileNotFoundError(f"{uri} holds no array")
    m = json.loads(text)
    if m.get("filters"):
        raise ValueError("filters are not supported")
    kind = (m.get("compressor") or {}).get("id")
    if kind not in (None, "gzip", "zlib", "zstd"):
        raise ValueError(f"codec {kind!r} is not supported")
    dtype, n = np.dtype(m["dtype"]), len(m["shape"])
    return {"shape": m["shape"], "chunks": m["chunks"], "dtype": dtype, "axes": list(range(n))[::-1] if m.get("order") == "F" else None, "codecs": [kind] if kind else [],
            "fill": _fill(m.get("fill_value"), dtype), "prefix": "", "separator": m.get("dimension_separator", ".")}


def zarr_chunk(uri: str, array: Mapping[str, Any], at: Sequence[int]) -> np.ndarray | None:
    """One chunk's values; None if the store leaves it out."""
    data = read_whole(f"{uri}/{array['prefix']}{array['separator'].join(map(str, at))}")
    if data is None:
        return None
    for codec in array["codecs"]:
        if codec == "crc32c":
            data = data[:-4]
        elif codec == "zstd":
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        else:
            data = zlib.decompress(data, 47)
    axes = array["axes"]
    shape = array["chunks"] if axes is None else [array["chunks"][k] for k in axes]
    v = np.frombuffer(data, array["dtype"], math.prod(shape)).reshape(shape)
    return v if axes is None else v.transpose(np.argsort(axes))


def ngff_metadata(uri: str) -> list[dict[str, Any]]:
    """The multiscales of a group, of 0.4 (.zattrs) or 0.5 (zarr.json)."""
    if (text := read_whole(f"{uri}/zarr.json")) is not None:
        found = json.loads(text).get("attributes", {}).get("ome", {}).get("multiscales")
    else:
        found = json.loads(read_whole(f"{uri}/.zattrs") or b"{}").get("multiscales")
    if not found:
        raise ValueError(f"{uri} holds no multiscale image")
    return found


def read_ngff(spark: SparkSession, store: str, *, multiscale: int = 0, level: int = 0, frame: ReferenceFrame | None = None,
              window: Mapping[str, tuple[int, int]] | None = None) -> FramedDF:
    """One level's values; axes without space or time are carried columns of their names, counted from 0.

    Only chunks that reach the ``window`` are read. Chunks the store leaves out hold the fill value, or
    have no rows if it states none.
    """
    image = ngff_metadata(store)[multiscale]
    uri = f"{store.rstrip('/')}/{image['datasets'][level]['path']}"
    array = zarr_array(uri)
    grid = ngff_grid(image, array["shape"], level=level, frame=frame)
    names = [a["name"] for a in image["axes"]]
    labels = tuple(n for n in names if n not in grid.dims)

    def opened():
        return lambda at: zarr_chunk(uri, array, at)

    df = block_rows(spark, names, array["shape"], array["chunks"], opened, labels=labels, window=window, fill=array["fill"], item_bytes=array["dtype"].itemsize)
    bounds = dict(zip(names, checked_window(names, array["shape"], window), strict=True))
    return frame_table(df, grid.isel(**{d: slice(*bounds[d]) for d in grid.dims}), carried=labels)
