"""Streams of points and events against static declarations.

Point maps are stateless, so they run on a stream as on a table. Sampling a static framed table joins the
stream with its rows; averages over target cells of time are windowed aggregates with a watermark.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.functions.transforms import transform_frame
from framegrid.operators.framed import FramedDF
from framegrid.plans.grid import pos

__all__ = ["sample_at", "transform_frame", "window_average"]


def sample_at(points: DataFrame, framed: FramedDF, *, columns: Sequence[str] | None = None, method: str = "nearest", fill_value: float = float("nan"), domain: str = "samples",
              broadcast_rows: int = 500_000) -> DataFrame:
    """The table's values at points given in its frame, as further columns of ``points``.

    Each of the one (nearest) or 2**d (linear) source samples of a point is a stream-static equi-join, so
    no state is kept and batch and stream give the same rows. Points outside get ``fill_value``; a value
    with weight on a missing sample is NaN.
    """
    grid, values = framed.grid, framed.values
    if method not in ("nearest", "linear"):
        raise ValueError("streams sample by 'nearest' or 'linear'")
    at = grid.position_columns([F.col(c).cast("double") for c in columns or grid.frame.axes], domain=domain)
    dims = grid.dims
    out = points.withColumns({f"p_{d}": F.greatest(F.lit(0.0), F.least(c, F.lit(float(grid.sizes[d] - 1)))) for d, c in at.items()} | {"outside": F.isnan(next(iter(at.values())))})
    table = framed.df.select(*[F.col(pos(d)).alias(f"s_{d}") for d in dims], *values)
    # A table with carried labels has a row for each, a number that the grid does not bound.
    table = F.broadcast(table) if grid.count() <= broadcast_rows and not framed.carried else table
    parts: list[tuple[Any, str]] = []
    for k, bits in enumerate(itertools.product((0, 1), repeat=len(dims)) if method == "linear" else [()]):
        weight, on = F.lit(1.0), F.lit(True)
        renamed = table.select(*[F.col(f"s_{d}").alias(f"s{k}_{d}") for d in dims], *[F.col(v).cast("double").alias(f"v{k}_{v}") for v in values])
        for n, d in enumerate(dims):
            p = F.col(f"p_{d}")
            if method == "nearest":
                i = F.floor(p + 0.5)
            else:
                low, b = F.floor(p), bits[n]
                weight = weight * (p - low if b else F.lit(1.0) - (p - low))
                i = low + b
            on = on & (F.least(i.cast("long"), F.lit(grid.sizes[d] - 1)) == F.col(f"s{k}_{d}"))
        out = out.join(renamed, on, "left").drop(*[f"s{k}_{d}" for d in dims])
        parts.append((weight, f"v{k}_"))
    made = {}
    for v in values:
        total = F.lit(0.0)
        for w, prefix in parts:
            x = F.coalesce(F.col(f"{prefix}{v}"), F.lit(float("nan")))
            total = total + F.when(w > 1e-9, w * x).otherwise(F.lit(0.0))
        made[v] = F.when(F.col("outside"), F.lit(fill_value)).otherwise(total)
    return out.select(*points.columns, *[c.alias(v) for v, c in made.items()])


def window_average(events: DataFrame, *, time: str, value: str, keys: Sequence[str] = (), width: str, slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Means over even target cells of event time: start, end, keys, mean and count.

    Rows later than ``lateness`` are dropped by the watermark, which also bounds the state kept.
    """
    cells = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, lateness).groupBy(cells.alias("cell"), *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select(F.col("cell.start").alias("start"), F.col("cell.end").alias("end"), *keys, "mean", "n")
