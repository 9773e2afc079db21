"""Voxels of NIfTI files as framed tables, read by byte ranges."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Mapping
from typing import Any

import numpy as np
from pyspark.sql import SparkSession

from framegrid.operators.framed import FramedDF, frame_table
from framegrid.plans.grid import pos
from framegrid.sources.blocks import File, block_rows, checked_window, read_whole, write_whole
from framegrid.sources.headers import build_nifti_header, nifti_grid, nifti_header, parse_nifti_header

# Data type codes of the format (fixed values).
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}

#: Planes of about so many bytes together are read at once.
BLOCK_BYTES = 16 << 20


def _layout(head: bytes) -> tuple[np.dtype, int, float, float, list[int]]:
    """(type, first byte, slope, intercept, sizes) of the voxels behind a header."""
    h = parse_nifti_header(head)
    order = "<" if int.from_bytes(head[:4], "little") == 348 else ">"
    code = int(np.frombuffer(head, f"{order}i2", 1, 70)[0])
    if code not in DTYPES:
        raise ValueError(f"data type {code} is not supported")
    offset, slope, inter = (float(x) for x in np.frombuffer(head, f"{order}f4", 3, 108))
    return np.dtype(f"{order}{DTYPES[code]}"), int(offset) or 352, slope, inter, [int(n) for n in h["dim"][1 : int(h["dim"][0]) + 1]]


def _scaled(v: np.ndarray, slope: float, inter: float) -> np.ndarray:
    return v * slope + inter if slope not in (0.0, 1.0) or slope != 0 and inter else v


def voxels(data: bytes) -> np.ndarray:
    """All values, scaled by slope and intercept, with the first axis fastest as stored."""
    kind, offset, slope, inter, sizes = _layout(data)
    return _scaled(np.frombuffer(data, kind, int(np.prod(sizes)), offset).astype(float), slope, inter).reshape(sizes[::-1])


def _head(file: File) -> bytes:
    start = file.read(0, min(file.size, 4096))
    return zlib.decompressobj(47).decompress(start, 352) if start[:2] == b"\x1f\x8b" else start[:352]


def read_nifti(spark: SparkSession, path: str, *, window: Mapping[str, tuple[int, int]] | None = None, **options: Any) -> FramedDF:
    """One file's voxels in long form.

    Tasks read byte ranges, each some planes, and only those that reach the ``window``. A gzipped file
    can only be read from its start: one task reads all of it.
    """
    file = File(path)
    head = _head(file)
    grid = nifti_grid(head, **options)
    kind, first, slope, inter, _ = _layout(head)
    zipped = file.read(0, 2) == b"\x1f\x8b"
    dims = grid.dims[::-1]
    sizes = [grid.sizes[d] for d in dims]
    plane = sizes[-1] * sizes[-2]
    planes = sizes[-3] if zipped else max(1, min(sizes[-3], BLOCK_BYTES // max(1, plane * kind.itemsize)))

    def opened():
        if zipped:
            v = voxels(gzip.decompress(read_whole(path))).reshape(sizes)
            return lambda at: v
        own = File(path)

        def load(at):
            k = at[-3] * planes
            n = min(planes, sizes[-3] - k)
            outer = at[0] if len(sizes) == 4 else 0
            start = first + (outer * sizes[-3] + k) * plane * kind.itemsize
            v = np.frombuffer(own.read(start, n * plane * kind.itemsize), kind).astype(float)
            return _scaled(v, slope, inter).reshape([1] * (len(sizes) - 3) + [n, *sizes[-2:]])

        return load

    block = [*([sizes[0] if zipped else 1] if len(sizes) == 4 else []), planes, *sizes[-2:]]
    df = block_rows(spark, dims, sizes, block, opened, window=window)
    bounds = dict(zip(dims, checked_window(dims, sizes, window), strict=True))
    return frame_table(df, grid.isel(**{d: slice(*bounds[d]) for d in grid.dims}))


def write_nifti(framed: FramedDF, path: str, *, max_voxels: int = 1 << 27) -> None:
    """A small framed volume as one file; the format is a single array, so its size is checked."""
    grid = framed.grid
    if grid.count() > max_voxels:
        raise ValueError("the volume is too large for one file; resample or select a part")
    out = np.full([grid.sizes[d] for d in grid.dims], np.nan)
    for r in framed.df.select(*[pos(d) for d in grid.dims], framed.values[0]).toLocalIterator():
        out[tuple(r[:-1])] = r[-1]
    head = bytearray(build_nifti_header(nifti_header(grid)))
    head[70:74] = np.array([64, 64], "<i2").tobytes()
    head[108:120] = np.array([352, 1, 0], "<f4").tobytes()
    write_whole(path, bytes(head) + b"\0" * 4 + out.transpose().astype("<f8").tobytes())
