"""Cubic B-spline resampling: prefilter blocks of whole lines, then gather 4**d weighted taps."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrid.plans.grid import pos

#: The pole of the cubic spline's prefilter.
POLE = np.sqrt(3.0) - 2.0


#: Most samples of a block of lines, unless one line is longer.
BLOCK = 1 << 18


def prefilter(lines: np.ndarray) -> np.ndarray:
    """B-spline coefficients along the last axis of lines that are mirrored at their edges, the edge sample repeated.

    So the coefficient before the first equals the first, and a tap beyond an edge takes the edge's. The
    recursion runs on the lines with 24 mirrored values at each end, beyond which the pole's influence is
    below rounding, so its start does not matter inside.
    """
    if not np.isfinite(lines).all():
        raise ValueError("cubic resampling cannot read a missing value")
    if lines.shape[-1] < 2:
        return lines
    halo = 24
    widths = [(0, 0)] * (lines.ndim - 1) + [(halo, halo)]
    c = np.moveaxis(np.pad(lines.astype(float), widths, mode="symmetric"), -1, 0) * ((1 - POLE) * (1 - 1 / POLE))
    c[0] /= 1 - POLE
    for k in range(1, len(c)):
        c[k] += POLE * c[k - 1]
    c[-1] *= POLE / (POLE - 1)
    for k in range(len(c) - 2, -1, -1):
        c[k] = POLE * (c[k + 1] - c[k])
    return np.moveaxis(c[halo:-halo], 0, -1)


def basis(f: Column) -> list[Column]:
    """Weights of the taps floor(p) - 1 to floor(p) + 2."""
    g = F.lit(1.0) - f
    return [g * g * g / 6, (F.lit(4.0) - F.lit(6.0) * f * f + F.lit(3.0) * f * f * f) / 6, (F.lit(4.0) - F.lit(6.0) * g * g + F.lit(3.0) * g * g * g) / 6, f * f * f / 6]


def basis_derivative(f: Column) -> list[Column]:
    g = F.lit(1.0) - f
    return [-g * g / 2, (F.lit(3.0) * f * f - F.lit(4.0) * f) / 2, (F.lit(4.0) * g - F.lit(3.0) * g * g) / 2, f * f / 2]


def filtered(values: DataFrame, source: Any, carried: Sequence[str], value_columns: Sequence[str]) -> DataFrame:
    """Coefficients of a dense table whose positions ``source`` states.

    A grid of up to BLOCK samples is filtered as a whole, one group for each label. A larger one is
    filtered dimension by dimension in blocks of whole lines, so that a group holds at most BLOCK
    samples, or one line, and a call filters many lines at once.
    """
    keys, dims = [pos(d) for d in source.dims], list(source.dims)
    current = values.select(*keys, *carried, *[F.col(v).cast("double").alias(v) for v in value_columns])
    schema, sizes = current.schema, source.sizes
    if source.count() <= BLOCK:
        group = [F.lit(0).alias("whole")] if not carried else [F.col(c) for c in carried]
        return current.groupBy(*group).applyInPandas(_filter_block(dims, [sizes[d] for d in dims], dims, tuple(value_columns)), schema)
    for d in dims:
        sides = _block_sides([1 if e == d else sizes[e] for e in dims], max(1, BLOCK // sizes[d]))
        group = [F.expr(f"{pos(e)} div {side}L").alias(f"block_{e}") for e, side in zip(dims, sides, strict=True) if e != d]
        run = _filter_block(dims, [sizes[e] if e == d else 0 for e in dims], [d], tuple(value_columns))
        current = current.groupBy(*group, *carried).applyInPandas(run, schema)
    return current


def _block_sides(sizes: Sequence[int], most: int) -> list[int]:
    """Sides of a block of at most ``most`` lines, halved along the longest from ``sizes`` on."""
    sides = [max(1, int(n)) for n in sizes]
    while np.prod(sides, dtype=float) > most and max(sides) > 1:
        k = int(np.argmax(sides))
        sides[k] = (sides[k] + 1) // 2
    return sides


def _filter_block(dims: Sequence[str], lengths: Sequence[int], along: Sequence[str], value_columns: tuple[str, ...]):
    """Filter a full box of samples along some dimensions; ``lengths`` are those that the box must have there."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([pos(d) for d in dims])
        at = [pdf[pos(d)].to_numpy() for d in dims]
        first = [int(x.min()) for x in at]
        shape = [int(x.max()) - lo + 1 for x, lo in zip(at, first, strict=True)]
        number = np.zeros(len(pdf), np.int64)
        for x, lo, n in zip(at, first, shape, strict=True):
            number = number * n + (x - lo)
        whole = all(lo == 0 and n == m for d, lo, n, m in zip(dims, first, shape, lengths, strict=True) if d in along)
        if not whole or len(number) != int(np.prod(shape)) or (np.diff(number) != 1).any():
            raise ValueError("cubic resampling needs a row for every source sample")
        for v in value_columns:
            box = pdf[v].to_numpy(float).reshape(shape)
            for d in along:
                k = list(dims).index(d)
                box = np.moveaxis(prefilter(np.moveaxis(box, k, -1)), -1, k)
            pdf[v] = box.ravel()
        return pdf

    return run


def cubic_gather(plan: Any, frame: DataFrame, values: DataFrame, value_columns: Sequence[str], carried: Sequence[str]) -> DataFrame:
    from framegrid.operators.resample import _join, source_indices, weighted_sum

    dims = plan.source.dims
    if plan.poles is not None or any(plan.source.axis_along(d).size < 2 for d in dims):
        raise ValueError("cubic resampling needs two samples along each axis and no pole")
    coefficients = filtered(values, plan.source, carried, value_columns)
    taps = []
    for offsets in itertools.product(range(4), repeat=len(dims)):
        weight, at = F.lit(1.0), {}
        for d, k in zip(dims, offsets, strict=True):
            low = F.floor(F.col(f"p_{d}"))
            weight = weight * basis(F.col(f"p_{d}") - low)[k]
            at[d] = (low + (k - 1)).cast("long")
        taps.append(F.struct(weight.alias("w"), *[c.alias(f"i_{d}") for d, c in source_indices(plan, at)[0].items()]))
    used = F.filter(F.array(*taps), lambda t: t["w"] != 0)
    wide = frame.withColumn("tap", F.explode_outer(used))
    wide = wide.select(*frame.columns, F.coalesce("tap.w", F.lit(0.0)).alias("w"), *[F.col(f"tap.i_{d}").alias(f"i_{d}") for d in dims])
    return weighted_sum(_join(plan, wide, coefficients, carried), plan, frame, value_columns, carried)
