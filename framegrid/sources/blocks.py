"""Arrays cut into blocks in files: every task reads the byte ranges of its own blocks and makes rows of them."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegrid.plans.grid import pos

#: About so many bytes of decoded values are read by one task.
TASK_BYTES = 128 << 20

Load = Callable[[tuple[int, ...]], "np.ndarray | None"]


def _located(uri: str) -> tuple[Any, str]:
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri[5:]
    return fs.FileSystem.from_uri(uri)


class File:
    """A file of any file system that Arrow knows, read by ranges."""

    def __init__(self, uri: str):
        system, path = _located(uri)
        self._file = system.open_input_file(path)
        self.size = self._file.size()

    def read(self, start: int, length: int) -> bytes:
        data = self._file.read_at(length, start)
        if len(data) != length:
            raise ValueError(f"the file ends before byte {start + length}")
        return data


def read_whole(uri: str) -> bytes | None:
    """A small file's bytes; None if there is none."""
    system, path = _located(uri)
    try:
        with system.open_input_file(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def write_whole(uri: str, data: bytes) -> None:
    """A small file, with the folders above it."""
    system, path = _located(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as f:
        f.write(data)


def checked_window(dims: Sequence[str], sizes: Sequence[int], window: Mapping[str, tuple[int, int]] | None) -> list[tuple[int, int]]:
    """The first position and the one after the last along each dimension."""
    if extra := set(window or {}) - set(dims):
        raise ValueError(f"a window over unknown dimensions {sorted(extra)}")
    out = []
    for d, n in zip(dims, sizes, strict=True):
        lo, hi = (window or {}).get(d, (0, n))
        if not 0 <= lo <= hi <= n:
            raise ValueError(f"the window {lo} to {hi} does not lie in the {n} positions of {d!r}")
        out.append((int(lo), int(hi)))
    return out


def block_rows(spark: SparkSession, dims: Sequence[str], sizes: Sequence[int], block: Sequence[int], opened: Callable[[], Load], *,
               labels: Sequence[str] = (), first_label: int = 0, window: Mapping[str, tuple[int, int]] | None = None, fill: float | None = None,
               item_bytes: int = 8, rows_per_batch: int = 200_000) -> DataFrame:
    """(pos_<dim>, value) of an array; only blocks that reach the window are read, each by one task.

    ``opened`` runs once in a task and gives the function from block numbers to the block's values, which
    may be larger than the rest of the array at its end, or None where the file holds no such block: its
    samples are ``fill``, or have no row. Positions count from the window's start. Dimensions among
    ``labels`` become columns of their own name with numbers from ``first_label``. Values are doubles.
    """
    bounds = checked_window(dims, sizes, window)
    block = [max(1, min(int(b), n)) if n else 1 for b, n in zip(block, sizes, strict=True)]
    start = [lo // b for (lo, _), b in zip(bounds, block, strict=True)]
    counts = [max(0, -(-hi // b) - s) if hi > lo else 0 for (lo, hi), b, s in zip(bounds, block, start, strict=True)]
    total = math.prod(counts)
    names = [d if d in labels else pos(d) for d in dims]
    base = [first_label if d in labels else -lo for d, (lo, _) in zip(dims, bounds, strict=True)]

    def run(batches):
        load = opened()
        for batch in batches:
            for number in batch.column(0).to_pylist():
                at = [int(k) + s for k, s in zip(np.unravel_index(number, counts), start, strict=True)]
                lows = [max(lo, k * b) for k, b, (lo, _) in zip(at, block, bounds, strict=True)]
                highs = [min(hi, (k + 1) * b) for k, b, (_, hi) in zip(at, block, bounds, strict=True)]
                values = load(tuple(at))
                if values is None:
                    if fill is None:
                        continue
                    part = np.full([h - w for w, h in zip(lows, highs, strict=True)], fill)
                else:
                    part = values[tuple(slice(w - k * b, h - k * b) for w, h, k, b in zip(lows, highs, at, block, strict=True))]
                for first in range(0, part.size, rows_per_batch):
                    flat = np.arange(first, min(first + rows_per_batch, part.size))
                    index = np.unravel_index(flat, part.shape)
                    cols = [pa.array((i + w + c).astype(np.int64)) for i, w, c in zip(index, lows, base, strict=True)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(part[index].astype(float))], [*names, "value"])

    tasks = max(1, min(total, max(spark.sparkContext.defaultParallelism, total * math.prod(block) * item_bytes // TASK_BYTES)))
    schema = ", ".join([*[f"`{n}` long" for n in names], "value double"])
    return spark.range(0, total, 1, tasks).select(F.col("id")).mapInArrow(run, schema)
