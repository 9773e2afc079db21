"""Grids: samplings without values, and what can be asked of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from types import MappingProxyType
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framegrid.functions.transforms import AffineTransform, columns_of
from framegrid.plans.declare import LATTICE_TOLERANCE, ArrayCoordinates, ReferenceFrame
from framegrid.plans.sampling import EXTRAPOLATE, RAISE, SAMPLES, Axis, Lattice, lattice_of


def pos(dim: str) -> str:
    """The name of a dimension's position column."""
    return f"pos_{dim}"


def index_coordinate(dim: str, size: int, *, start: int = 0) -> tuple[str, np.ndarray]:
    """The coordinate spec of an axis that counts its samples."""
    if isinstance(size, bool) or size < 0:
        raise ValueError("a size is not negative")
    return dim, np.arange(start, start + size)


@dataclass(frozen=True, eq=False)
class Grid:
    """A transform and the coordinates of its source axes, with cells where they are declared.

    A coordinate is ``(dim, values)`` along a dimension of its own, or a number for a fixed axis.
    """

    transform: Any
    axes: tuple[Axis, ...]
    dims: tuple[str, ...]

    def __init__(self, transform: Any, coordinates: Mapping[str, Any], *, intervals: Mapping[str, Any] | None = None, dims: Sequence[str] | None = None):
        source = transform.source
        if not isinstance(source, ArrayCoordinates):
            raise TypeError("a grid's transform starts at ArrayCoordinates")
        if not isinstance(transform.target, ReferenceFrame):
            raise TypeError("a grid's transform ends at a ReferenceFrame")
        if set(coordinates) != set(source.axes):
            raise ValueError(f"coordinates are for {sorted(coordinates)}, the transform needs {sorted(source.axes)}")
        if extra := set(intervals or {}) - set(source.axes):
            raise ValueError(f"intervals for unknown axes {sorted(extra)}")
        axes = []
        for name, offset in zip(source.axes, source.sample_offset, strict=True):
            spec = coordinates[name]
            dim, values = spec if isinstance(spec, tuple) else (None, spec)
            axes.append(Axis(name, dim, values, offset, (intervals or {}).get(name)))
        order = tuple(c[0] for c in coordinates.values() if isinstance(c, tuple))
        if len(set(order)) != len(order):
            raise ValueError("two source axes vary along one dimension")
        self._fill(transform, axes, order if dims is None else dims)

    def _fill(self, transform: Any, axes: Sequence[Axis], dims: Sequence[str]) -> None:
        if sorted(dims) != sorted(a.dim for a in axes if a.dim is not None):
            raise ValueError("dimensions do not fit the coordinates")
        for k, v in (("transform", transform), ("axes", tuple(axes)), ("dims", tuple(dims))):
            object.__setattr__(self, k, v)

    @classmethod
    def of(cls, transform: Any, axes: Sequence[Axis], dims: Sequence[str]) -> Grid:
        out = cls.__new__(cls)
        out._fill(transform, axes, dims)
        return out

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Grid) and self.transform == other.transform and self.axes == other.axes and self.dims == other.dims

    def __hash__(self) -> int:
        return hash((self.transform, self.axes, self.dims))

    @property
    def frame(self) -> ReferenceFrame:
        return self.transform.target

    @property
    def sizes(self) -> Mapping[str, int]:
        return MappingProxyType({d: self.axis_along(d).size for d in self.dims})

    @property
    def coordinates(self) -> Mapping[str, Any]:
        return MappingProxyType({a.name: (a.dim, a.values) if a.dim is not None else a.values for a in self.axes})

    @property
    def intervals(self) -> Mapping[str, np.ndarray]:
        return MappingProxyType({a.name: a.intervals for a in self.axes if a.intervals is not None})

    def axis(self, name: str) -> Axis:
        return next(a for a in self.axes if a.name == name)

    def axis_along(self, dim: str) -> Axis:
        found = [a for a in self.axes if a.dim == dim]
        if not found:
            raise ValueError(f"{dim!r} is not a dimension of this grid, {self.dims}")
        return found[0]

    # Points --------------------------------------------------------------------------------------

    def _order(self) -> list[Axis]:
        """Axes as the transform takes them."""
        return [self.axis(a) for a in self.transform.source.axes]

    def point_at(self, **positions: int) -> np.ndarray:
        if set(positions) != set(self.dims):
            raise ValueError(f"positions are for {sorted(positions)}, the grid has {sorted(self.dims)}")
        at = []
        for a in self._order():
            if a.dim is None:
                at.append(a.flat[0])
                continue
            k = positions[a.dim]
            if isinstance(k, bool | np.bool_) or not isinstance(k, int | np.integer):
                raise TypeError("a position is an integer")
            if not 0 <= k < a.size:
                raise IndexError(f"position {k} is outside {a.dim!r}")
            at.append(a.flat[k])
        return self.transform.transform_point(np.array(at))

    def points(self) -> np.ndarray:
        """All points as an array over the dimensions; for small grids."""
        shape = tuple(self.sizes.values())
        index = dict(zip(self.dims, np.indices(shape), strict=True))
        return self.transform.transform_point(
            np.stack([np.full(shape, a.flat[0]) if a.dim is None else a.flat[index[a.dim]] for a in self._order()], axis=-1)
        )

    def points_at(self, positions: Any, *, domain: str = SAMPLES, outside: str = RAISE) -> np.ndarray:
        p = np.asarray(positions, float)
        if p.shape[-1] != len(self.dims):
            raise ValueError("positions have one number for each dimension")
        at, bad = [], np.zeros(p.shape[:-1], bool)
        for a in self._order():
            if a.dim is None:
                at.append(np.full(p.shape[:-1], a.flat[0]))
                continue
            x = p[..., self.dims.index(a.dim)]
            before, after = a.extent(domain)
            bad |= (x < -before - 1e-9) | (x > a.size - 1 + after + 1e-9)
            at.append(a.coordinates(x))
        if outside == RAISE and bad.any():
            raise ValueError("a position lies outside the grid")
        out = self.transform.transform_point(np.stack(at, axis=-1))
        return out if outside == EXTRAPOLATE else np.where(bad[..., None], np.nan, out)

    def _inverse(self) -> Any:
        if not hasattr(self.transform, "inverse"):
            raise TypeError("positions need an invertible transform")
        return self.transform.inverse()

    def positions_at(self, points: Any, *, domain: str = SAMPLES, outside: str = RAISE) -> np.ndarray:
        q = self._inverse().transform_point(points)
        out = np.zeros((*q.shape[:-1], len(self.dims)))
        bad = np.zeros(q.shape[:-1], bool)
        for k, a in enumerate(self._order()):
            slack = 8 * float(np.finfo(float).eps) * max(1.0, float(np.abs(points).max(initial=0)))
            x = a.positions(q[..., k], domain=domain if a.dim else SAMPLES, outside="nan" if outside == RAISE else outside, roundoff=slack)
            bad |= np.isnan(x)
            if a.dim is not None:
                out[..., self.dims.index(a.dim)] = x
        if outside == RAISE and bad.any():
            raise ValueError("a point lies outside the grid")
        out[bad] = np.nan
        return out

    def lattice(self, dims: Sequence[str] | None = None, *, tolerance: float = LATTICE_TOLERANCE) -> Lattice:
        return lattice_of(self.transform, self.axes, tuple(dims or self.dims), tolerance)

    # Selection -----------------------------------------------------------------------------------

    def isel(self, **indexers: Any) -> Grid:
        if missing := set(indexers) - set(self.dims):
            raise ValueError(f"{sorted(missing)} are not dimensions of this grid")
        axes = [a.take(indexers[a.dim]) if a.dim in indexers else a for a in self.axes]
        kept = {a.dim for a in axes}
        return Grid.of(self.transform, axes, [d for d in self.dims if d in kept])

    def sel(self, method: str | None = None, **labels: Any) -> Grid:
        keys = {}
        for name, label in labels.items():
            axis = next((a for a in self.axes if a.name == name), None) or self.axis_along(name)
            key = axis.label_indices(label, method)
            keys[axis.dim] = key
        return self.isel(**keys)

    def transpose(self, *dims: str) -> Grid:
        order = dims or tuple(reversed(self.dims))
        if sorted(order) != sorted(self.dims):
            raise ValueError("transpose names every dimension once")
        return Grid.of(self.transform, self.axes, order)

    # Tables --------------------------------------------------------------------------------------

    def count(self) -> int:
        return int(np.prod([a.size for a in self.axes if a.dim is not None], dtype=object))

    def to_df(self, spark: SparkSession, *, coordinates: bool = True, points: bool = False) -> DataFrame:
        """One row per sample: positions, coordinates by axis name and, if asked, the target point.

        The rows are unravelled from a range on the executors, so a grid of any size costs the driver nothing.
        """
        df = spark.range(self.count())
        df = df.select(*[_unravel(self.dims, self.sizes, d).alias(pos(d)) for d in self.dims])
        if coordinates or points:
            df = df.withColumns({a.name: self.coordinate(a) for a in self.axes})
        if points:
            out = columns_of(self.transform, [F.col(a) for a in self.transform.source.axes])
            df = df.withColumns(dict(zip(self.transform.target.axes, out, strict=True)))
        return df

    def coordinate(self, axis: Axis) -> Column:
        return F.lit(float(axis.flat[0])) if axis.dim is None else axis.index_column(F.col(pos(axis.dim)))

    def position_columns(self, points: Sequence[Column], *, domain: str = SAMPLES, outside: str = "nan") -> dict[str, Column]:
        """Fractional positions of target points; a row outside along any axis is NaN along all."""
        inv = self._inverse()
        q = inv.raw_columns(points) if type(inv) is AffineTransform else columns_of(inv, points)
        out, bad = {}, F.lit(False)
        for a, c in zip(self._order(), q, strict=True):
            p = a.position_column(c, domain=domain if a.dim else SAMPLES, outside=outside)
            bad = bad | F.isnan(p)
            if a.dim is not None:
                out[a.dim] = p
        return {d: F.when(bad, F.lit(float("nan"))).otherwise(out[d]) for d in self.dims}

    def point_columns(self, positions: Mapping[str, Column], *, domain: str = SAMPLES, outside: str = "nan") -> list[Column]:
        """Target points of fractional positions."""
        at, bad = [], F.lit(False)
        for a in self._order():
            if a.dim is None:
                at.append(F.lit(float(a.flat[0])))
                continue
            x = positions[a.dim]
            before, after = a.extent(domain)
            bad = bad | (x < F.lit(-before - 1e-9)) | (x > F.lit(a.size - 1 + after + 1e-9))
            at.append(a.coordinate_column(x))
        out = columns_of(self.transform, at)
        if outside == EXTRAPOLATE:
            return out
        wrong = F.raise_error(F.lit("a position lies outside the grid")).cast("double") if outside == RAISE else F.lit(float("nan"))
        return [F.when(bad, wrong).otherwise(c) for c in out]

    def is_coincident(self, other: Grid, *, tolerance: float = LATTICE_TOLERANCE) -> bool:
        """Whether both grids have their samples at the same points, within ``tolerance`` of the smallest step."""
        if not self.frame.is_equivalent_frame(other.frame) or self.dims != other.dims or dict(self.sizes) != dict(other.sizes):
            return False
        if type(self.transform) is type(other.transform) is AffineTransform:
            # Along each dimension the difference of affine maps is largest at an end of some axis sample.
            a, b = _separable(self), _separable(other)
            gap = np.abs(a[0] - b[0]).max() + sum(np.abs(a[1][d] - b[1][d]).max(initial=0) for d in self.dims)
            least = min((np.linalg.norm(np.diff(a[1][d], axis=0), axis=1).min() for d in self.dims if self.sizes[d] > 1), default=1.0)
            if gap <= tolerance * least:
                return True
        return bool(np.abs(self.points() - other.points()).max(initial=0) <= tolerance * _least_step(self))


def _separable(grid: Grid) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    t, order = grid.transform, grid._order()
    start = t.transform_point(np.array([a.flat[0] for a in order]))
    return start, {a.dim: (a.flat - a.flat[0])[:, None] * t.matrix[:, k][None, :] for k, a in enumerate(order) if a.dim is not None}


def _least_step(grid: Grid) -> float:
    p = grid.points()
    steps = [np.linalg.norm(np.diff(p, axis=k), axis=-1).min() for k in range(len(grid.dims)) if p.shape[k] > 1]
    return float(min(steps, default=1.0))


def _unravel(dims: Sequence[str], sizes: Mapping[str, int], dim: str) -> Column:
    k = list(dims).index(dim)
    inner = int(np.prod([sizes[d] for d in dims[k + 1 :]], dtype=object)) or 1
    return F.expr(f"pmod(id div {inner}L, {max(sizes[dim], 1)}L)")
