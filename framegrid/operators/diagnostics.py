"""Reports on maps over a table of points, and the classification of affine maps."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrid.functions.tensors import det_columns
from framegrid.functions.transforms import AffineTransform, columns_of, jacobian_columns_of
from framegrid.operators.labels import numbered
from framegrid.plans.grid import Grid, pos


def _sources(transform: Any, columns: Sequence[str] | None) -> list[Column]:
    return [F.col(c).cast("double") for c in columns or transform.source.axes]


def jacobian_determinants(points: DataFrame, transform: Any, columns: Sequence[str] | None = None) -> DataFrame:
    """``points`` with the determinant of the Jacobian at each."""
    if len(transform.source.axes) != len(transform.target.axes):
        raise ValueError("a determinant needs as many target as source axes")
    return points.withColumn("determinant", det_columns(jacobian_columns_of(transform, _sources(transform, columns))))


def jacobian_determinant_report(points: DataFrame, transform: Any, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: number of points, least determinant, and the fraction that is zero or less (folds)."""
    each = jacobian_determinants(points, transform, columns)
    return each.agg(
        F.count(F.lit(1)).alias("n"), F.min("determinant").alias("minimum"), F.avg((F.col("determinant") <= 0).cast("double")).alias("folded_fraction")
    )


def round_trip_residuals(points: DataFrame, forward: Any, backward: Any, columns: Sequence[str] | None = None) -> DataFrame:
    """``points`` with the residual of each axis after going there and back, and its length."""
    if forward.source != backward.target or forward.target != backward.source:
        raise ValueError("the two maps do not lead there and back")
    start = _sources(forward, columns)
    back = columns_of(backward, columns_of(forward, start))
    made = {f"residual_{a}": b - s for a, b, s in zip(forward.source.axes, back, start, strict=True)}
    out = points.withColumns(made)
    length = F.sqrt(reduce(lambda a, b: a + b, (F.col(c) * F.col(c) for c in made)))
    return out.withColumn("distance", length)


def round_trip_residual_report(points: DataFrame, forward: Any, backward: Any, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: number of points, greatest distance and root mean square."""
    each = round_trip_residuals(points, forward, backward, columns)
    return each.agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("maximum"), F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("rms"))


class AffineClass(Enum):
    """Kinds of affine maps, each included in the next."""

    IDENTITY = 0
    TRANSLATION = 1
    RIGID = 2
    SIMILARITY = 3
    AFFINE = 4

    def at_most(self, other: AffineClass) -> bool:
        return self.value <= other.value


def affine_class(affine: AffineTransform | np.ndarray, *, tolerance: float = 1e-9, offset_tolerance: float = 1e-9) -> AffineClass:
    """The narrowest class that holds within the tolerances; a reflection is affine, not rigid."""
    if isinstance(affine, AffineTransform):
        m, t = affine.matrix, affine.translation
    else:
        h = np.asarray(affine, float)
        m, t = h[:-1, :-1], h[:-1, -1]
    n = len(m)
    if m.shape != (n, n):
        raise ValueError("only a square map has a class")
    if np.abs(m - np.eye(n)).max() <= tolerance:
        return AffineClass.IDENTITY if np.abs(t).max(initial=0) <= offset_tolerance else AffineClass.TRANSLATION
    scale = abs(np.linalg.det(m)) ** (1 / n)
    if scale == 0 or np.linalg.det(m) < 0 or np.abs(m.T @ m / scale**2 - np.eye(n)).max() > tolerance:
        return AffineClass.AFFINE
    return AffineClass.RIGID if abs(scale - 1) <= tolerance else AffineClass.SIMILARITY


def axis_statistics(df: DataFrame, coordinate: str) -> DataFrame:
    """One row: count, ends, least and greatest step, and ``deviation``, the greatest distance of a label
    from its place on the even line between both ends (0 for up to two labels).

    For an axis too long for the driver: labels are deduplicated and ranked by range partitions, and
    steps across a partition's edge are found by carrying each partition's last label into the next.
    """
    labels = df.select(F.col(coordinate).cast("double").alias("v")).distinct()
    parts = labels.repartitionByRange("v").sortWithinPartitions("v")

    def steps(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, first, last, n, lo, hi = TaskContext.get().partitionId(), None, None, 0, float("inf"), float("-inf")
        for batch in batches:
            v = batch.column(0).to_numpy()
            if not len(v):
                continue
            d = np.diff(v if last is None else np.append(last, v))
            first, last, n = v[0] if first is None else first, v[-1], n + len(v)
            lo, hi = min(lo, d.min(initial=np.inf)), max(hi, d.max(initial=-np.inf))
        if n:
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
            row = [pa.array([x], k) for x, k in zip((part, float(first), float(last), n, float(lo), float(hi)), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(row, ["part", "first", "last", "n", "lo", "hi"])

    from pyspark.sql import Window

    each = parts.mapInArrow(steps, "part int, first double, last double, n long, lo double, hi double")
    gap = F.col("first") - F.lag("last").over(Window.orderBy("part"))
    wide = each.withColumn("gap", gap)
    ends = wide.agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.least(F.min("lo"), F.min("gap")).alias("least_step"), F.greatest(F.max("hi"), F.max("gap")).alias("greatest_step"),
    )
    # One row beside each label: it is broadcast whatever the axis' length.
    even = F.col("first") + F.col("number") * (F.col("last") - F.col("first")) / F.greatest(F.col("n") - 1, F.lit(1))
    off = numbered(labels, "v").join(F.broadcast(ends.select("n", "first", "last")), F.lit(True)).agg(F.max(F.abs(F.col("v") - even)).alias("deviation"))
    return ends.join(F.broadcast(off), F.lit(True))


def first_failure(df: DataFrame, failed: Column, dims: Sequence[str]) -> DataFrame:
    """One row: how many rows fail, and the position of the first in the order of the dimensions (null if none)."""
    place = F.struct(*[F.col(pos(d)) for d in dims])
    return df.agg(F.count_if(failed).alias("n"), F.min(F.when(failed, place)).alias("first"))


def coincidence(a: DataFrame, b: DataFrame, grid: Grid) -> DataFrame:
    """One row: the greatest distance between two point tables of one grid's positions."""
    keys, axes = [pos(d) for d in grid.dims], grid.frame.axes
    joined = a.select(*keys, *axes).join(b.select(*keys, *[F.col(x).alias(f"b_{x}") for x in axes]), keys)
    gap = F.sqrt(reduce(lambda p, q: p + q, ((F.col(x) - F.col(f"b_{x}")) ** 2 for x in axes)))
    return joined.agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("maximum"))
