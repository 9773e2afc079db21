"""Resampling by tiles: the strategy for large targets under an affine index map, or one bent by a field.

The target is cut into tiles. For each tile the box of source positions it can need follows from the map,
so source rows are sent, once for each tile that reads them, to where the tile is made, and one NumPy
kernel call fills the whole tile. Target samples are never shuffled or joined: only source rows move, at
most a small multiple of their number. Tiles are sized so that both a tile and its source box stay
within CELLS, which bounds the memory of a task whatever the grids' sizes.

A field's displacements are bounded by those of its nodes, since its weights are not negative and sum to
1, so the box of a tile is known without evaluating it; the kernel then evaluates field and source at once.

Which tiles read which rows is itself a join: source positions fall into blocks, and each tile lists the
blocks that its box touches. Both lists are made on the executors from ranges of numbers.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrid.operators.labels import with_labels
from framegrid.plans.declare import ROUNDING_ALLOWANCE
from framegrid.plans.grid import pos

#: Most target samples of a tile, and most source positions of its box.
CELLS = 1 << 17
#: Targets of fewer samples are gathered by joins, which need no Python.
MIN_TARGET = 50_000


def tile_sides(matrix: np.ndarray, sizes: Sequence[int], margin: int, spread: np.ndarray | float = 0.0) -> list[int]:
    """Sides of a tile, halved along its longest until tile and source box fit CELLS.

    ``spread`` is how much wider a field makes the box; a box that it alone makes larger stays so.
    """
    sides = [max(1, int(n)) for n in sizes]

    def box() -> float:
        reach = np.abs(matrix) @ (np.array(sides, float) - 1) + 2 * margin + 2 + spread
        return float(np.prod(reach))

    while (np.prod(sides, dtype=float) > CELLS or box() > CELLS) and max(sides) > 1:
        k = int(np.argmax(sides))
        sides[k] = (sides[k] + 1) // 2
    return sides


def fits(plan: Any, method: str) -> bool:
    """Whether tiles apply: an affine index map, source dimensions alone, and a target worth a kernel."""
    if plan.lattice is None and plan.bent is None or plan.target.count() < MIN_TARGET or not plan.source.dims:
        return False
    matrix, _, low, high = _index_map(plan)
    sides = tile_sides(matrix, [plan.target.sizes[d] for d in plan.target.dims], _margin(method), high - low)
    return np.prod(sides) >= 64


def _index_map(plan: Any) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, shift, low, high): source positions are matrix i + shift and between low and high more."""
    if plan.lattice is not None:
        none = np.zeros(len(plan.source.dims))
        return plan.lattice.matrix, plan.lattice.translation, none, none
    return plan.bent.matrix, plan.bent.shift, *plan.bent.spread()


def _margin(method: str) -> int:
    return 2 if method == "cubic" else 1


def tile_gather(plan: Any, values: DataFrame, value_columns: Sequence[str], carried: Sequence[str], *, method: str, fill_value: float, domain: str) -> DataFrame:
    """pos_* of the target, the carried columns and double value columns."""
    spark, source, target = values.sparkSession, plan.source, plan.target
    matrix, shift, below, above = _index_map(plan)
    sizes = [target.sizes[d] for d in target.dims]
    margin = _margin(method)
    sides = tile_sides(matrix, sizes, margin, above - below)
    counts = [-(-n // s) for n, s in zip(sizes, sides, strict=True)]
    n_tiles = int(np.prod(counts, dtype=object))
    shape = [source.sizes[d] for d in source.dims]
    reach = np.abs(matrix) @ (np.array(sides, float) - 1) + (above - below)
    block = [int(max(1, min(n, np.ceil(r + 2 * margin + 2)))) for n, r in zip(shape, reach, strict=True)]

    # Tiles with the corners of their boxes, as columns of a range.
    tiles = spark.range(n_tiles).withColumnRenamed("id", "tile")
    inner, starts = 1, []
    for s, c in list(zip(sides, counts, strict=True))[::-1]:
        starts.insert(0, F.expr(f"pmod(tile div {inner}L, {c}L) * {s}L"))
        inner *= c
    lows, highs = [], []
    for k, d in enumerate(source.dims):
        low: Column = F.lit(float(shift[k] + below[k]))
        high: Column = F.lit(float(shift[k] + above[k]))
        for j in range(len(sizes)):
            a, m = starts[j].cast("double"), float(matrix[k, j])
            b = F.least(a + (sides[j] - 1), F.lit(float(sizes[j] - 1)))
            low, high = (low + a * m, high + b * m) if m >= 0 else (low + b * m, high + a * m)
        n = shape[k]
        lows.append(F.greatest(F.lit(0), F.least(F.floor(low) - margin, F.lit(n - 1))).cast("long").alias(f"lo_{d}"))
        highs.append(F.greatest(F.lit(0), F.least(F.ceil(high) + margin, F.lit(n - 1))).cast("long").alias(f"hi_{d}"))
    boxes = tiles.select("tile", *lows, *highs)
    needs, part = boxes, F.lit(0).cast("long")
    for k, d in enumerate(source.dims):
        needs = needs.withColumn(f"b_{d}", F.explode(F.sequence(F.expr(f"lo_{d} div {block[k]}L"), F.expr(f"hi_{d} div {block[k]}L"))))
        part = part * -(-shape[k] // block[k]) + F.col(f"b_{d}")
    needs = needs.withColumn("block", part).drop(*[f"b_{d}" for d in source.dims])

    number: Column = F.lit(0).cast("long")
    cell: Column = F.lit(0).cast("long")
    for k, d in enumerate(source.dims):
        cell = cell * shape[k] + F.col(pos(d))
        per = -(-shape[k] // block[k])
        number = number * per + F.expr(f"{pos(d)} div {block[k]}L")
    rows = values.select(*[pos(d) for d in source.dims], *carried, *[F.col(v).cast("double").alias(v) for v in value_columns])
    inside = F.lit(True)
    for d in source.dims:
        inside = inside & F.col(pos(d)).between(F.col(f"lo_{d}"), F.col(f"hi_{d}"))
    # The tile list is small beside the rows; it is broadcast while its size, known from the grids, allows.
    sent = rows.withColumn("block", number).join(F.broadcast(needs) if n_tiles * 8 <= 200_000 else needs, "block").filter(inside)
    # A position is sent as one number; the kernel takes it apart.
    sent = sent.select("tile", *carried, cell.alias("cell"), *value_columns)
    # Each tile and label has a row of its own, so that tiles without source rows are filled too.
    frame = with_labels(tiles, values, carried) if carried else tiles
    empty = frame.select("tile", *carried, F.lit(-1).cast("long").alias("cell"), *[F.lit(None).cast("double").alias(v) for v in value_columns])
    out_schema = ", ".join([*[f"{pos(d)} long" for d in target.dims], *[f"{v} double" for v in value_columns]])
    kinds = {f.name: f.dataType.simpleString() for f in values.schema.fields}
    if carried:
        out_schema += ", " + ", ".join(f"`{c}` {kinds[c]}" for c in carried)
    kernel = _kernel(matrix, shift, sizes, sides, counts, shape, [source.axis_along(d).extent(domain) for d in source.dims], method, margin,
                     fill_value, [pos(d) for d in target.dims], tuple(value_columns), tuple(carried),
                     _shared(spark, plan.bent) if plan.lattice is None else None)
    return sent.union(empty).groupBy("tile", *carried).applyInArrow(kernel, out_schema)


def _shared(spark: Any, bent: Any) -> Any:
    """The field's map for the workers; its nodes are within the bound of an array field."""
    return spark.sparkContext.broadcast(bent)


def _kernel(matrix, shift, sizes, sides, counts, shape, extents, method, margin, fill, target_cols, value_columns, carried, bent=None):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tile = key[0].as_py()
        index = []
        for s, c, n in list(zip(sides, counts, sizes, strict=True))[::-1]:
            tile, at = divmod(tile, c)
            index.insert(0, np.arange(at * s, min(at * s + s, n)))
        grid = np.meshgrid(*index, indexing="ij")
        flat = [g.ravel() for g in grid]
        places = [sum((m * i for m, i in zip(row, flat, strict=True)), np.zeros(len(flat[0]))) + t for row, t in zip(matrix, shift, strict=True)]
        inside, clipped = np.ones(len(flat[0]), bool), []
        if bent is not None:
            field = bent.value.field
            u, held = field.on_box(index, bent.value.to_node, bent.value.nodes_at)
            if field.exterior == "identity":
                u = np.where(held[:, None], u, 0.0)
            elif field.exterior == "raise":
                inside &= held
            places = [x + u @ row for x, row in zip(places, bent.value.push, strict=True)]
        for p, n, (before, after) in zip(places, shape, extents, strict=True):
            inside &= (p >= -before - 1e-9) & (p <= n - 1 + after + 1e-9)
            clipped.append(np.clip(p, 0, n - 1))
        low = [max(0, int(np.floor(c.min())) - margin) for c in clipped]
        high = [min(n - 1, int(np.ceil(c.max())) + margin) for c, n in zip(clipped, shape, strict=True)]
        local = [h - lo + 1 for lo, h in zip(low, high, strict=True)]
        number = table.column("cell").to_numpy()
        use = number >= 0
        got = np.unravel_index(np.where(use, number, 0), shape)
        for g, lo, h in zip(got, low, high, strict=True):
            use &= (g >= lo) & (g <= h)
        cell = np.zeros(int(use.sum()), np.int64)
        for g, lo, n in zip(got, low, local, strict=True):
            cell = cell * n + (g[use] - lo)
        columns = {}
        for v in value_columns:
            box = np.full(int(np.prod(local)), np.nan)
            box[cell] = table.column(v).to_numpy(zero_copy_only=False)[use]
            columns[v] = np.where(inside, _gather(box, local, [c - lo for c, lo in zip(clipped, low, strict=True)], method), fill)
        out = [pa.array(f.astype(np.int64)) for f in flat] + [pa.array(columns[v]) for v in value_columns]
        names = [*target_cols, *value_columns]
        for k, c in enumerate(carried):
            out.append(pa.array([key[1 + k].as_py()], key[1 + k].type).take(pa.array(np.zeros(len(flat[0]), np.int64))))
            names.append(c)
        return pa.Table.from_arrays(out, names=names)

    return run


def _gather(box: np.ndarray, shape: Sequence[int], p: Sequence[np.ndarray], method: str) -> np.ndarray:
    """Values at local positions; NaN where missing values have more than rounding's weight."""
    if method == "nearest":
        at = np.zeros(len(p[0]), np.int64)
        for x, n in zip(p, shape, strict=True):
            at = at * n + np.minimum(np.floor(x + 0.5).astype(np.int64), n - 1)
        return box[at]
    if method == "linear" and not np.isnan(box).any():
        return _interpolated(box, shape, p)
    taps = []
    for x, n in zip(p, shape, strict=True):
        i = np.floor(x).astype(np.int64)
        f = x - i
        if method == "linear":
            taps.append([(i, 1 - f), (np.minimum(i + 1, n - 1), f)])
        else:
            g = 1 - f
            w = (g**3 / 6, (4 - 6 * f**2 + 3 * f**3) / 6, (4 - 6 * g**2 + 3 * g**3) / 6, f**3 / 6)
            taps.append([(np.clip(i + k - 1, 0, n - 1), w[k]) for k in range(4)])
    missing = np.isnan(box)
    holes = bool(missing.any())
    filled = np.where(missing, 0.0, box) if holes else box
    total, gone = np.zeros(len(p[0])), np.zeros(len(p[0])) if holes else None
    for combo in itertools.product(*taps):
        at, w = combo[0][0], combo[0][1]
        for (i, x), n in zip(combo[1:], list(shape)[1:], strict=True):
            at, w = at * n + i, w * x
        total += w * filled[at]
        if holes:
            gone += np.abs(w) * missing[at]
    return np.where(gone > ROUNDING_ALLOWANCE, np.nan, total) if holes else total


def _interpolated(box: np.ndarray, shape: Sequence[int], p: Sequence[np.ndarray]) -> np.ndarray:
    """Linear values of a box without missing samples: corners picked by one index, interpolated axis by axis."""
    first, parts, step = 0, [], 1
    for x, n in list(zip(p, shape, strict=True))[::-1]:
        i = np.minimum(np.floor(x), max(n - 2, 0))
        first = first + i.astype(np.int64) * step
        parts.insert(0, (x - i, 1 - (x - i), step if n > 1 else 0))
        step *= n

    def along(k: int, offset: int) -> np.ndarray:
        if k == len(parts):
            return box[offset:].take(first)
        f, g, stride = parts[k]
        low = along(k + 1, offset)
        if stride:
            high = along(k + 1, offset + stride)
            low *= g
            high *= f
            low += high
        return low

    return along(0, 0)
