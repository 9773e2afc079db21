"""FramedDF: a DataFrame with the declaration of its samples, through every operation.

Long form: one row per sample, ``pos_<dim>`` and one column per source axis for the geometry, one column
per carried dimension, and value columns. Operations that keep the declaration true return a FramedDF,
those that reduce geometry return a plain DataFrame, and those that would make it wrong raise before
anything runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegrid.functions.transforms import AffineTransform, compose, coordinate_system_change
from framegrid.operators.labels import axis_labels, numbered, with_labels
from framegrid.plans.declare import ReferenceFrame
from framegrid.plans.grid import Grid, pos
from framegrid.plans.sampling import Axis

JOINS = ("inner", "outer", "left", "right", "exact")


class AlignmentError(ValueError):
    """Labels or declarations of two tables do not fit."""


def frame_difference(a: ReferenceFrame, b: ReferenceFrame) -> str:
    """Why two frames do not combine, and what would help."""
    for side, f in (("left", a), ("right", b)):
        if f.is_anonymous and a.identifier != b.identifier:
            return f"{side} operand is anonymous; call assume_frame if it is known to be the same space"
    if a.identifier != b.identifier:
        return f"incompatible framed coordinate mappings: {a} and {b}; resample one or call assume_frame"
    return "incompatible framed coordinate mappings: one frame, different grids; resample one onto the other"


@dataclass(frozen=True)
class FramedDF:
    """A table, its grid, its carried dimensions and its value columns."""

    df: DataFrame
    grid: Grid
    carried: tuple[str, ...] = ()
    values: tuple[str, ...] = ("value",)

    # Construction and inspection -----------------------------------------------------------------

    @property
    def is_framed(self) -> bool:
        return True

    @property
    def coordinate_transform(self) -> Any:
        return self.grid.transform

    @property
    def reference_frame(self) -> ReferenceFrame:
        return self.grid.frame

    @property
    def geometry_dims(self) -> tuple[str, ...]:
        return self.grid.dims

    def sizes(self) -> dict[str, int]:
        """Sizes of all dimensions; those of carried ones are counted in one pass."""
        out = dict(self.grid.sizes)
        if self.carried:
            row = self.df.agg(*[F.count_distinct(c).alias(c) for c in self.carried]).first()
            out |= {c: row[c] for c in self.carried}
        return out

    def unframe(self) -> DataFrame:
        return self.df

    def keys(self) -> list[str]:
        return [pos(d) for d in self.grid.dims] + list(self.carried)

    def geometry_columns(self) -> list[str]:
        return [pos(d) for d in self.grid.dims] + [a.name for a in self.grid.axes]

    def _with(self, df: DataFrame, grid: Grid | None = None, **more: Any) -> FramedDF:
        return replace(self, df=df, grid=grid or self.grid, **more)

    # Selection -----------------------------------------------------------------------------------

    def isel(self, drop: bool = False, **indexers: Any) -> FramedDF:
        """Select by position. Geometry keys follow the grid; carried ones filter by ranked label."""
        if drop and any(d in self.grid.dims for d in indexers):
            raise ValueError("dropping a scalar coordinate would corrupt the binding; call unframe()")
        df, geometry = self.df, {}
        for d, key in indexers.items():
            if d in self.grid.dims:
                geometry[d] = key
            elif d in self.carried:
                df = _carried_isel(df, d, key)
            else:
                raise ValueError(f"{d!r} is not a dimension")
        grid = self.grid.isel(**geometry)
        carried = tuple(c for c in self.carried if not (c in indexers and isinstance(indexers[c], int | np.integer)))
        for d, key in geometry.items():
            axis = self.grid.axis_along(d)
            df = _select(df, d, axis, key)
        return self._with(df, grid, carried=carried)

    def sel(self, method: str | None = None, drop: bool = False, **labels: Any) -> FramedDF:
        """Select by coordinate or carried label; a slice includes both ends."""
        keys, df, carried = {}, self.df, self.carried
        names = {a.name: a for a in self.grid.axes}
        for name, label in labels.items():
            if name in self.carried:
                df, carried = (df.filter(F.col(name) == F.lit(label)), tuple(c for c in carried if c != name)) if not isinstance(label, list | tuple) else (df.filter(F.col(name).isin(list(label))), carried)
                continue
            axis = names.get(name) or self.grid.axis_along(name)
            keys[axis.dim] = axis.label_indices(label, method)
        return self._with(df, carried=carried).isel(drop=drop, **keys)

    def nearest_to(self, point: Mapping[str, float]) -> FramedDF:
        """The sample nearest in position to a point of the frame, given by axis name; outside raises."""
        at = self.grid.positions_at([[point[a] for a in self.grid.frame.axes]], domain="cells")[0]
        return self.isel(**{d: int(min(max(np.floor(p + 0.5), 0), self.grid.sizes[d] - 1)) for d, p in zip(self.grid.dims, at, strict=True)})

    def head(self, **n: int) -> FramedDF:
        return self.isel(**{d: slice(0, k) for d, k in n.items()})

    def tail(self, **n: int) -> FramedDF:
        return self.isel(**{d: slice(max(0, self.grid.sizes[d] - k), None) for d, k in n.items()})

    def thin(self, **n: int) -> FramedDF:
        return self.isel(**{d: slice(None, None, k) for d, k in n.items()})

    def squeeze(self, *dims: str) -> FramedDF:
        sizes = self.sizes()
        for d in dims:
            if sizes[d] != 1:
                raise ValueError(f"{d!r} has {sizes[d]} samples")
        return self.isel(**{d: 0 for d in dims})

    # Layout --------------------------------------------------------------------------------------

    def transpose(self, *dims: str) -> FramedDF:
        return self._with(self.df, self.grid.transpose(*[d for d in dims if d in self.grid.dims]))

    def rename(self, **names: str) -> FramedDF:
        """Rename dimensions, source axes, carried dimensions or values; a name of both dim and axis renames both."""
        t, grid = self.grid.transform, self.grid
        axes_named = {k: v for k, v in names.items() if k in t.source.axes}
        taken = set(self.df.columns) - set(names)
        if clash := taken & set(names.values()):
            raise ValueError(f"names {sorted(clash)} are taken")
        if axes_named:
            if type(t) is not AffineTransform:
                raise ValueError("this transform cannot rename source axes")
            t = t.with_endpoints(source=t.source.with_axes(axes_named))
        dims = {d: names.get(d, d) for d in grid.dims}
        axes = [Axis(names.get(a.name, a.name), None if a.dim is None else dims[a.dim], a.values, a.offset, a.intervals) for a in grid.axes]
        renamed = {k: v for k, v in names.items() if k in self.df.columns} | {pos(k): pos(v) for k, v in dims.items() if k != v}
        return FramedDF(
            self.df.withColumnsRenamed(renamed), Grid.of(t, axes, [dims[d] for d in grid.dims]),
            tuple(names.get(c, c) for c in self.carried), tuple(names.get(v, v) for v in self.values),
        )

    def swap_dims(self, names: Mapping[str, str]) -> FramedDF:
        """Rename dimensions alone; source axes keep their names."""
        dims = {d: names.get(d, d) for d in self.grid.dims}
        axes = [replace(a, dim=None if a.dim is None else dims[a.dim]) for a in self.grid.axes]
        df = self.df.withColumnsRenamed({pos(k): pos(v) for k, v in dims.items() if k != v})
        return self._with(df, Grid.of(self.grid.transform, axes, [dims[d] for d in self.grid.dims]))

    def expand_dims(self, **labels: Sequence[Any]) -> FramedDF:
        df = self.df
        for name, values in labels.items():
            if name in df.columns:
                raise ValueError(f"column {name!r} exists")
            df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
        return self._with(df, carried=(*self.carried, *labels))

    def roll(self, roll_coords: bool = False, **shifts: int) -> FramedDF:
        """Values go round along a dimension; with ``roll_coords`` the samples go with them."""
        out = self
        for d, k in shifts.items():
            n = out.grid.sizes[d]
            if n == 0:
                continue
            moved = F.pmod(F.col(pos(d)) + F.lit(k), F.lit(n)).cast("long")
            axis = out.grid.axis_along(d)
            if roll_coords:
                grid = out.grid.isel(**{d: np.roll(np.arange(n), k)})
                out = out._with(out.df.withColumn(pos(d), moved), grid)
            else:
                df = out.df.withColumn(pos(d), moved)
                out = out._with(df.withColumn(axis.name, out.grid.coordinate(axis)))
        return out

    def shift(self, **shifts: int) -> FramedDF:
        """Values move along a dimension; places that get none are NaN."""
        out = self
        for d, k in shifts.items():
            n, others = out.grid.sizes[d], [c for c in out.keys() if c != pos(d)]
            moved = out.df.select(*others, (F.col(pos(d)) + k).alias(pos(d)), *[F.col(v).cast("double").alias(f"new_{v}") for v in out.values]).filter(F.col(pos(d)).between(0, n - 1))
            joined = out.df.drop(*out.values).join(moved, out.keys(), "left")
            df = joined.select(*[c for c in out.df.columns if c not in out.values], *[F.coalesce(f"new_{v}", F.lit(float("nan"))).alias(v) for v in out.values])
            out = out._with(df)
        return out

    def rolling(self, agg: Callable[[Column], Column] = F.avg, **windows: int) -> FramedDF:
        """An aggregate over the last samples along one dimension; NaN where the window is not full."""
        (d, n), = windows.items()
        w = Window.partitionBy(*[c for c in self.keys() if c != pos(d)]).orderBy(pos(d)).rowsBetween(1 - n, 0)
        made = {v: F.when(F.count(F.lit(1)).over(w) == n, agg(F.col(v)).over(w)).otherwise(F.lit(float("nan"))) for v in self.values}
        return self._with(self.df.withColumns(made))

    # Arithmetic ----------------------------------------------------------------------------------

    def map_values(self, fn: Callable[[Column], Column]) -> FramedDF:
        """Apply a column function to every value column."""
        return self._with(self.df.withColumns({v: fn(F.col(v)) for v in self.values}))

    def astype(self, kind: str) -> FramedDF:
        return self.map_values(lambda c: c.cast(kind))

    def combine(self, other: Any, fn: Callable[[Column, Column], Column], how: str = "inner", reverse: bool = False) -> FramedDF:
        """Align with another table (framed or plain) or a scalar, and combine values by position of their columns."""
        if not isinstance(other, FramedDF | DataFrame):
            return self.map_values(lambda c: fn(F.lit(other), c) if reverse else fn(c, F.lit(other)))
        left, right, names = self.align(other, how)
        if len(names) != len(self.values):
            raise ValueError("the operands have different numbers of value columns")
        joined = _equi_join(left.df, right, _common(left, right), "inner" if how == "exact" else how if how in ("inner", "outer", "left", "right") else "inner", names)
        made = [fn(F.col(f"r_{b}"), F.col(a)).alias(a) if reverse else fn(F.col(a), F.col(f"r_{b}")).alias(a) for a, b in zip(self.values, names, strict=True)]
        extra = [c for c in right.columns if c not in left.df.columns and c not in names and not c.startswith("pos_")]
        rest = [c for c in left.df.columns if c not in self.values]
        return replace(left, df=joined.select(*rest, *extra, *made), carried=(*left.carried, *extra))

    def __add__(self, other: Any) -> FramedDF:
        return self.combine(other, lambda a, b: a + b)

    def __radd__(self, other: Any) -> FramedDF:
        return self.combine(other, lambda a, b: a + b, reverse=True)

    def __sub__(self, other: Any) -> FramedDF:
        return self.combine(other, lambda a, b: a - b)

    def __rsub__(self, other: Any) -> FramedDF:
        return self.combine(other, lambda a, b: a - b, reverse=True)

    def __mul__(self, other: Any) -> FramedDF:
        return self.combine(other, lambda a, b: a * b)

    def __rmul__(self, other: Any) -> FramedDF:
        return self.combine(other, lambda a, b: a * b, reverse=True)

    def __truediv__(self, other: Any) -> FramedDF:
        return self.combine(other, lambda a, b: F.try_divide(a.cast("double"), b))

    def __neg__(self) -> FramedDF:
        return self.map_values(lambda c: -c)

    def where(self, condition: Callable[[Column], Column], other: Any = float("nan")) -> FramedDF:
        return self.map_values(lambda c: F.when(condition(c), c).otherwise(F.lit(other)))

    # Alignment -----------------------------------------------------------------------------------

    def align(self, other: FramedDF | DataFrame, how: str = "inner") -> tuple[FramedDF, DataFrame, list[str]]:
        """This table on the joined labels, the other's rows for them, and the other's value columns.

        Labels are joined axis by axis, as an outer alignment of several axes is the product of their
        unions. A plain table supplies values only; its coordinate columns must be source axes.
        """
        if how == "override":
            raise ValueError("join='override' is unsupported for framed coordinates")
        if how not in JOINS:
            raise ValueError(f"unknown join {how!r}")
        if isinstance(other, FramedDF):
            self._check_same(other.grid)
            axes = {a.name: a for a in other.grid.axes}
            names = list(other.values)
            table = other.df
        else:
            axes = _plain_axes(self.grid, other)
            names = [c for c in other.columns if c not in axes and c not in self.carried and c not in self.df.columns or c in self.values]
            table = other
            for a in self.grid.axes:
                if a.dim is None and a.name in other.columns:
                    if other.filter(F.col(a.name) != F.lit(a.flat[0].item())).limit(1).count():
                        raise ValueError(f"conflicting unindexed coordinate {a.name!r}")
        merged, moved = [], {}
        for a in self.grid.axes:
            b = axes.get(a.name)
            if a.dim is None or b is None:
                merged.append(a)
                continue
            if b.dim is None:
                raise AlignmentError(f"cannot align objects on coordinate {a.name!r} because of conflicting indexes")
            joined = _join_labels(a, b, how)
            merged.append(joined)
            if not np.array_equal(joined.flat, a.flat):
                moved[a.name] = joined
        grid = Grid.of(self.grid.transform, merged, self.grid.dims)
        left = self._on(grid, moved, fill=how in ("outer", "right"))
        geometry = [a.name for a in self.grid.axes if a.name in table.columns]
        shared = table.select(*geometry, *[c for c in self.carried if c in table.columns], *[c for c in table.columns if c not in geometry and c not in self.carried and not c.startswith("pos_")])
        return left, shared, names

    def _check_same(self, other: Grid) -> None:
        if self.grid.transform != other.transform or {a.name: (a.dim, a.offset) for a in self.grid.axes} != {a.name: (a.dim, a.offset) for a in other.axes}:
            raise ValueError(frame_difference(self.grid.frame, other.frame))
        for a in self.grid.axes:
            b = other.axis(a.name)
            if a.dim is None and not np.array_equal(a.values, b.values):
                raise ValueError(f"conflicting fixed coordinate {a.name!r}")
            if (a.intervals is None) != (b.intervals is None):
                raise ValueError(f"intervals along {a.name!r} are declared on one side only")

    def _on(self, grid: Grid, moved: Mapping[str, Axis], fill: bool) -> FramedDF:
        """Renumber to the joined labels; with ``fill`` every label has a row."""
        if not moved and not fill:
            return self
        df = self.df
        if fill:
            labels = grid.to_df(df.sparkSession)
            if self.carried:
                labels = with_labels(labels, df, self.carried)
            keys = [*[a.name for a in grid.axes if a.dim is not None], *self.carried]
            own = df.select(*keys, *[c for c in df.columns if c not in keys and c not in self.geometry_columns()])
            joined = labels.join(own, keys, "left")
            filled = {v: F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))) for v in self.values}
            return self._with(joined.withColumns(filled).select(*self.df.columns), grid)
        for name, axis in moved.items():
            table = df.sparkSession.createDataFrame(pa.table({"label": axis.flat.astype(float), "at": np.arange(axis.size)}))
            df = df.join(F.broadcast(table) if axis.size <= 500_000 else table, F.col(name).cast("double") == F.col("label")).withColumn(pos(axis.dim), F.col("at")).drop("label", "at")
        return self._with(df.select(*self.df.columns), grid)

    def reindex_like(self, other: FramedDF) -> FramedDF:
        """Rows for the other table's labels; NaN where this one has none."""
        self._check_same(other.grid)
        return self._on(other.grid, {}, fill=True)

    def concat(self, others: Sequence[FramedDF], dim: str) -> FramedDF:
        """Stack tables of one grid along a carried dimension."""
        if dim in self.grid.dims:
            raise ValueError("concatenation along geometry is unsupported; call unframe()")
        df = self.df
        for o in others:
            if o.grid != self.grid:
                self._check_same(o.grid)
                raise AlignmentError("concatenated tables need one grid; align them first")
            df = df.unionByName(o.df)
        return self._with(df, carried=self.carried if dim in self.carried else (*self.carried, dim))

    def merge(self, other: FramedDF | DataFrame, how: str = "inner") -> FramedDF:
        """One table with the value columns of both."""
        left, right, names = self.align(other, how)
        if clash := set(names) & set(self.values):
            raise ValueError(f"value columns {sorted(clash)} are in both tables")
        keys = _common(left, right)
        joined = left.df.join(right.select(*keys, *names), keys, "left" if how in ("outer", "left", "right") else "inner")
        return replace(left, df=joined, values=(*self.values, *names))

    def assign_at(self, other: FramedDF) -> FramedDF:
        """Replace the values at the other table's labels; the declaration of this one stays."""
        self._check_same(other.grid)
        for a in other.grid.axes:
            if a.dim is not None and not np.isin(a.flat, self.grid.axis(a.name).flat).all():
                raise KeyError(f"labels along {a.name!r} are not in the destination")
        keys = [*[a.name for a in self.grid.axes if a.dim is not None], *self.carried]
        new = other.df.select(*keys, *[F.col(v).alias(f"new_{v}") for v in other.values], F.lit(True).alias("met"))
        made = [F.when(F.col("met"), F.col(f"new_{b}")).otherwise(F.col(a)).alias(a) for a, b in zip(self.values, other.values, strict=True)]
        return self._with(self.df.join(new, keys, "left").select(*[c for c in self.df.columns if c not in self.values], *made))

    # Reductions ----------------------------------------------------------------------------------

    def reduce(self, agg: Callable[[Column], Column], *dims: str) -> FramedDF | DataFrame:
        """Aggregate over dimensions: the declaration stays only if all geometry does."""
        gone = set(dims) & set(self.grid.dims)
        if unknown := set(dims) - set(self.grid.dims) - set(self.carried):
            raise ValueError(f"{sorted(unknown)} are not dimensions")
        carried = tuple(c for c in self.carried if c not in dims)
        made = [agg(F.col(v)).alias(v) for v in self.values]
        if gone:
            kept = [c for d in self.grid.dims if d not in gone for c in (pos(d), self.grid.axis_along(d).name)]
            return self.df.groupBy(*kept, *carried).agg(*made)
        return self._with(self.df.groupBy(*self.geometry_columns(), *carried).agg(*made), carried=carried)

    def mean(self, *dims: str) -> FramedDF | DataFrame:
        return self.reduce(F.avg, *dims)

    def sum(self, *dims: str) -> FramedDF | DataFrame:
        return self.reduce(F.sum, *dims)

    def quantile(self, q: float, *dims: str) -> FramedDF | DataFrame:
        return self.reduce(lambda c: F.percentile(c, q), *dims)

    def coarsen(self, agg: Callable[[Column], Column] = F.avg, **windows: int) -> FramedDF:
        """Aggregate runs of a carried (whole-numbered) dimension."""
        if set(windows) & set(self.grid.dims):
            raise ValueError("cannot coarsen geometry dimensions; call unframe()")
        df = self.df.withColumns({c: F.floor(F.col(c) / n).cast("long") for c, n in windows.items()})
        return self._with(df.groupBy(*self.geometry_columns(), *self.carried).agg(*[agg(F.col(v)).alias(v) for v in self.values]))

    # Refusals ------------------------------------------------------------------------------------

    def _refused(self, why: str) -> Any:
        raise ValueError(f"{why}; call unframe()")

    def groupby(self, *_: Any, **__: Any) -> Any:
        return self._refused("grouping would corrupt the binding")

    def pad(self, *_: Any, **__: Any) -> Any:
        return self._refused("cannot pad geometry dimensions")

    def stack(self, *_: Any, **__: Any) -> Any:
        return self._refused("cannot stack geometry dimensions")

    def interp(self, *_: Any, **__: Any) -> Any:
        return self._refused("cannot interpolate geometry dimensions; use resample_to")

    def assign_coords(self, *_: Any, **__: Any) -> Any:
        return self._refused("replacing coordinates would corrupt the binding")

    def drop_vars(self, *_: Any, **__: Any) -> Any:
        return self._refused("dropping coordinates would corrupt the binding")

    # Frames and resampling -----------------------------------------------------------------------

    def assume_frame(self, frame: ReferenceFrame) -> FramedDF:
        """State that this table's (anonymous) frame is ``frame``; its points are rewritten in that system."""
        own = self.grid.frame
        if not own.is_anonymous and not own.is_equivalent_frame(frame):
            raise ValueError(f"{own} has an identity of its own; relate it to {frame} with a transform")
        named = frame.with_coordinate_system(own.coordinate_system)
        t = self.grid.transform.with_endpoints(target=named)
        if named != frame:
            t = compose(t, coordinate_system_change(named, frame))
        return self._with(self.df, Grid.of(t, self.grid.axes, self.grid.dims))

    def resample_to(self, target: Grid | FramedDF, **options: Any) -> FramedDF:
        """Values on another grid; see ``resample``. Cells are those the result can claim; see ``claimed_intervals``."""
        from framegrid.operators.claims import claimed_grid
        from framegrid.operators.resample import relate, resample

        grid = target.grid if isinstance(target, FramedDF) else target
        if clash := set(self.values) & {a.name for a in grid.axes}:
            raise ValueError(f"columns {sorted(clash)} would collide with the target's coordinates")
        out = resample(self.df, self.grid, grid, value_columns=self.values, carried=self.carried, **options)
        grid = claimed_grid(self.grid, grid, relate(grid.frame, self.grid.frame, options.get("transform")), options.get("support", "point"))
        return FramedDF(out.withColumns({a.name: grid.coordinate(a) for a in grid.axes}), grid, self.carried, self.values)

    def frame_coordinates(self, names: Sequence[str] | None = None, prefix: str = "") -> FramedDF:
        """The points of the samples as further columns."""
        from framegrid.functions.transforms import columns_of

        out = columns_of(self.grid.transform, [F.col(a).cast("double") for a in self.grid.transform.source.axes])
        wanted = dict(zip(self.grid.frame.axes, out, strict=True))
        return self._with(self.df.withColumns({f"{prefix}{n}": wanted[n] for n in names or self.grid.frame.axes}))


def frame_table(df: DataFrame, grid: Grid, *, carried: Sequence[str] = (), values: Sequence[str] = ("value",), check: bool = False) -> FramedDF:
    """Bind a long-form table with ``pos_*`` columns to a grid; coordinate columns are added from it.

    With ``check`` the rows are counted against the grid (one pass over the keys).
    """
    if missing := [pos(d) for d in grid.dims if pos(d) not in df.columns]:
        raise ValueError(f"the table lacks {missing}")
    if clash := [a.name for a in grid.axes if a.name in df.columns]:
        raise ValueError(f"columns {clash} exist; drop them or let them be replaced")
    out = FramedDF(df.withColumns({a.name: grid.coordinate(a) for a in grid.axes}), grid, tuple(carried), tuple(values))
    if check:
        wide = [F.min(pos(d)).alias(f"lo_{d}") for d in grid.dims] + [F.max(pos(d)).alias(f"hi_{d}") for d in grid.dims]
        row = df.agg(F.count(F.lit(1)).alias("n"), *wide).first()
        labels = df.select(*carried).distinct().count() if carried else 1
        if row["n"] != grid.count() * labels or any(row["n"] and (row[f"lo_{d}"] < 0 or row[f"hi_{d}"] >= n) for d, n in grid.sizes.items()):
            raise ValueError(f"{row['n']} rows do not fill the grid's {grid.count()} samples")
    return out


def frame_columns(df: DataFrame, transform: Any, *, carried: Sequence[str] = (), values: Sequence[str] = ("value",), intervals: Mapping[str, Any] | None = None,
                  ascending: bool = True) -> FramedDF:
    """Bind a table by its coordinate columns: each source axis' distinct labels become its dimension.

    Only the labels, one-dimensional and distinct, come to the driver, at most MAX_LABELS of an axis;
    positions are attached by a join.
    """
    coordinates, out = {}, df
    for name in transform.source.axes:
        kind = df.schema[name].dataType
        if isinstance(kind, T.TimestampType | T.DateType | T.StringType | T.BooleanType):
            raise TypeError(f"coordinates of {name!r} must be real numbers; convert {kind.simpleString()} explicitly")
        labels = axis_labels(df, name)
        labels = labels if ascending else labels[::-1]
        coordinates[name] = (name, labels)
        table = df.sparkSession.createDataFrame(pa.table({name: labels, pos(name): np.arange(len(labels))})).withColumn(name, F.col(name).cast(kind))
        out = out.join(F.broadcast(table) if len(labels) <= 500_000 else table, name)
    return FramedDF(out, Grid(transform, coordinates, intervals=intervals), tuple(carried), tuple(values))


def grid_coordinates(spark: SparkSession, grid: Grid) -> FramedDF:
    """A table of a grid's samples without values."""
    return FramedDF(grid.to_df(spark), grid, (), ())


def _select(df: DataFrame, dim: str, axis: Axis, key: Any) -> DataFrame:
    """Filter and renumber a position column; order and repeats of a list are kept by a join."""
    p = F.col(pos(dim))
    if isinstance(key, int | np.integer):
        return df.filter(p == F.lit(int(key) % axis.size)).drop(pos(dim))
    index = axis.indices(key)
    if isinstance(key, slice):
        start, _, step = key.indices(axis.size)
        if not len(index):
            return df.filter(F.lit(False))
        lo, hi = int(index.min()), int(index.max())
        df = df.filter(p.between(lo, hi) & (F.pmod(p - F.lit(start), F.lit(abs(step))) == 0) if abs(step) != 1 else p.between(lo, hi))
        return df.withColumn(pos(dim), ((p - F.lit(start)) / F.lit(step)).cast("long"))
    if len(index) and len(np.unique(index)) == len(index) and (np.diff(index) > 0).all() and len(index) <= 64:
        df = df.filter(p.isin([int(i) for i in index]))
        return df.withColumn(pos(dim), F.element_at(F.create_map(*[F.lit(int(x)) for k, i in enumerate(index) for x in (i, k)]), p).cast("long"))
    table = df.sparkSession.createDataFrame(pa.table({"old": np.asarray(index, np.int64), "new": np.arange(len(index))}))
    return df.join(F.broadcast(table) if len(index) <= 500_000 else table, p == F.col("old")).withColumn(pos(dim), F.col("new")).drop("old", "new")


def _carried_isel(df: DataFrame, dim: str, key: Any) -> DataFrame:
    """Rows of the labels at the positions ``key`` in their order; only their number comes to the driver."""
    labels = df.select(dim).distinct()
    n = labels.count()
    if isinstance(key, int | np.integer):
        if not -n <= key < n:
            raise IndexError(f"{dim!r} has {n} labels")
        one = labels.sort(dim).offset(int(key) % n).limit(1)
        return df.join(F.broadcast(one.select(F.col(dim).alias("wanted"))), F.col(dim).eqNullSafe(F.col("wanted")), "left_semi").drop(dim)
    if isinstance(key, slice):
        start, stop, step = key.indices(n)
        chosen = np.arange(start, stop, step)
    else:
        chosen = Axis(dim, dim, np.arange(n)).indices(key)
    order = numbered(labels, dim)
    picked = df.sparkSession.createDataFrame(pa.table({"number": np.unique(np.asarray(chosen, np.int64))}))
    wanted = order.join(picked, "number", "left_semi").select(F.col(dim).alias("wanted"))
    return df.join(wanted, F.col(dim).eqNullSafe(F.col("wanted")), "left_semi")


def _plain_axes(grid: Grid, table: DataFrame) -> dict[str, Axis]:
    """The labels of a plain table along the source axes it has columns for."""
    out = {}
    for a in grid.axes:
        if a.name in table.columns and a.dim is not None:
            unit = table.schema[a.name].metadata.get("units")
            own = grid.transform.source.units[grid.transform.source.axes.index(a.name)]
            if unit is not None and unit != own:
                raise ValueError(f"coordinate {a.name!r} declares units = {unit!r}, the binding {own!r}")
            out[a.name] = Axis(a.name, a.dim, axis_labels(table, a.name))
    return out


def _join_labels(a: Axis, b: Axis, how: str) -> Axis:
    x, y = a.flat, b.flat
    if np.array_equal(x, y):
        return a
    if how == "exact":
        raise AlignmentError(f"cannot align objects with join='exact': labels along {a.name!r} differ")
    if how == "left":
        return a
    if how == "right":
        labels = y
    elif how == "inner":
        labels = x[np.isin(x, y)]
    else:
        labels = np.union1d(x, y)
        if len(x) > 1 and x[0] > x[-1]:
            labels = labels[::-1]
    cells = None
    if a.intervals is not None:
        known = dict(zip(x.tolist(), a.intervals.tolist(), strict=True)) | (dict(zip(y.tolist(), b.intervals.tolist(), strict=True)) if b.intervals is not None else {})
        if any(v not in known for v in labels.tolist()):
            raise AlignmentError(f"a label along {a.name!r} has no interval")
        cells = np.array([known[v] for v in labels.tolist()])
    whole = a.values.dtype.kind == "i" and (labels == np.rint(labels)).all()
    return Axis(a.name, a.dim, labels.astype(np.int64) if whole else labels, a.offset, cells)


def _common(left: FramedDF, right: DataFrame) -> list[str]:
    varying = [a.name for a in left.grid.axes if a.dim is not None]
    return [c for c in (*varying, *left.carried) if c in right.columns]


def _equi_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, names: Sequence[str]) -> DataFrame:
    extra = [c for c in right.columns if c not in left.columns and c not in names]
    renamed = right.select(*keys, *extra, *[F.col(n).alias(f"r_{n}") for n in names])
    if not keys:
        return left.crossJoin(F.broadcast(renamed))
    return left.join(renamed, list(keys), "inner" if how == "inner" else "left")
