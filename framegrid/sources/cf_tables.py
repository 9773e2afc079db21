"""Tables with longitude and latitude columns under CF attributes, framed on the grid of their labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.operators.framed import FramedDF
from framegrid.operators.labels import axis_labels
from framegrid.operators.resample import BROADCAST_ROWS
from framegrid.plans.declare import ReferenceFrame
from framegrid.plans.grid import pos
from framegrid.sources.headers import cf_figure, cf_grid


def cf_table(df: DataFrame, attributes: Mapping[str, Mapping[str, Any]], *, values: Sequence[str] = ("value",), carried: Sequence[str] = (),
             bounds: Mapping[str, Mapping[float, tuple[float, float]]] | None = None, grid_mapping: Mapping[str, Any] | None = None,
             frame: ReferenceFrame | None = None) -> FramedDF:
    """Bind a long table by its longitude and latitude columns; other coordinates stay as ``carried``.

    ``attributes`` holds the CF attributes of the columns, and ``bounds``, where there are any, the cell of
    each label. The distinct labels of both columns come to the driver; positions follow by a join on them.
    """
    labels = {name: axis_labels(df, name) for name in attributes}
    coordinates: dict[str, dict[str, Any]] = {}
    for name, own in labels.items():
        coordinates[name] = {**attributes[name], "values": own}
        if bounds and name in bounds:
            if lacking := [float(x) for x in own if float(x) not in bounds[name]]:
                raise ValueError(f"labels {lacking[:3]} of {name!r} have no bounds")
            coordinates[name]["bounds"] = np.array([bounds[name][float(x)] for x in own])
    grid = cf_grid(coordinates, frame=frame, figure=cf_figure(grid_mapping))
    out = df
    for name in (a.name for a in grid.axes):
        table = pa.table({name: labels[name], pos(name): np.arange(len(labels[name]))})
        small = df.sparkSession.createDataFrame(table).withColumn(name, F.col(name).cast(df.schema[name].dataType))
        out = out.join(F.broadcast(small) if len(labels[name]) <= BROADCAST_ROWS else small, name)
    return FramedDF(out, grid, tuple(carried), tuple(values))
