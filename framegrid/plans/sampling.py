"""One axis of samples: positions, coordinates, cells, and their Spark expressions.

Axis coordinates are one-dimensional and held on the driver; sample values never are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from framegrid.plans.declare import (
    EXACT_STEP_TOLERANCE,
    INTERVAL_ROUNDOFF_FACTOR,
    INTERVAL_TOLERANCE,
    LATTICE_TOLERANCE,
    POSITION_SLACK,
    SINGLE_SAMPLE_TOLERANCE,
)

SAMPLES, CELLS = "samples", "cells"
RAISE, NAN, EXTRAPOLATE = "raise", "nan", "extrapolate"
NAN_COL = float("nan")


def uniform_step(values: np.ndarray, tolerance: float) -> float | None:
    """The step if all values lie within ``tolerance`` steps of an even spacing."""
    n = len(values)
    if n < 2:
        return None
    step = (float(values[-1]) - float(values[0])) / (n - 1)
    if step == 0 or np.abs(values - (values[0] + step * np.arange(n))).max() > tolerance * abs(step):
        return None
    return step


def check_intervals(intervals: np.ndarray, values: np.ndarray, offset: float | None) -> np.ndarray:
    """Finite cells [lo, hi] with lo < hi that hold their sample, at ``offset`` of the width if it is given."""
    cells = np.array(intervals, float)
    if cells.shape != (len(values), 2) or not np.isfinite(cells).all():
        raise ValueError("intervals are one finite [lo, hi] for each sample")
    width = cells[:, 1] - cells[:, 0]
    if (width <= 0).any():
        raise ValueError("an interval's lower bound lies below its upper")
    slack = np.maximum(INTERVAL_TOLERANCE * width, INTERVAL_ROUNDOFF_FACTOR * np.abs(cells).max(axis=1))
    if (values < cells[:, 0] - slack).any() or (values > cells[:, 1] + slack).any():
        raise ValueError("a sample lies outside its interval")
    if offset is not None and (np.abs(cells[:, 0] + offset * width - values) > slack).any():
        raise ValueError("an interval disagrees with the declared sample offset")
    cells.setflags(write=False)
    return cells


@dataclass(frozen=True, eq=False)
class Axis:
    """Samples along one source axis; ``dim`` is None for an axis fixed at one value."""

    name: str
    dim: str | None
    values: np.ndarray
    offset: float | None = None
    intervals: np.ndarray | None = None

    def __post_init__(self) -> None:
        v = np.asarray(self.values)
        if v.dtype.kind not in "iuf":
            raise TypeError(f"coordinates of {self.name!r} must be real numbers, not {v.dtype}")
        if v.ndim > 1 or (v.ndim == 0) != (self.dim is None):
            raise ValueError(f"axis {self.name!r} is one-dimensional along a dimension, or a scalar without one")
        v = np.array(v, np.int64 if v.dtype.kind in "iu" else float)
        if v.dtype.kind == "f":
            if not np.isfinite(v).all():
                raise ValueError(f"coordinates of {self.name!r} must be finite")
            v = v + 0.0
        v.setflags(write=False)
        object.__setattr__(self, "values", v)
        if self.intervals is not None:
            object.__setattr__(self, "intervals", check_intervals(self.intervals, np.atleast_1d(v), self.offset))

    def __eq__(self, other: object) -> bool:
        return (
            isinstance(other, Axis) and (self.name, self.dim, self.offset) == (other.name, other.dim, other.offset)
            and np.array_equal(self.values, other.values) and (self.intervals is None) == (other.intervals is None)
            and (self.intervals is None or np.array_equal(self.intervals, other.intervals))
        )

    def __hash__(self) -> int:
        return hash((self.name, self.dim, self.values.tobytes()))

    @property
    def size(self) -> int:
        return self.values.size

    @property
    def flat(self) -> np.ndarray:
        return np.atleast_1d(self.values).astype(float)

    def check_monotonic(self) -> None:
        d = np.diff(self.flat)
        if len(d) and not ((d > 0).all() or (d < 0).all()):
            raise ValueError(f"coordinates of {self.name!r} are not strictly monotonic")

    @property
    def step(self) -> float | None:
        """The exact step of an even axis; of a single sample the width of its declared interval."""
        if self.size == 1 and self.intervals is not None:
            return float(self.intervals[0, 1] - self.intervals[0, 0])
        return uniform_step(self.flat, EXACT_STEP_TOLERANCE)

    def extent(self, domain: str = CELLS) -> tuple[float, float]:
        """How far the cells reach before the first and behind the last sample, in positions."""
        if domain == SAMPLES:
            return 0.0, 0.0
        n = self.size
        if self.intervals is not None:
            lo, hi = float(self.intervals[:, 0].min()), float(self.intervals[:, 1].max())
            p = self.positions(np.array([lo, hi]), domain=SAMPLES, outside=EXTRAPOLATE)
            return -float(p.min()), float(p.max()) - (n - 1)
        if self.offset is None:
            return 0.0, 0.0
        if n < 2:
            raise ValueError(f"one sample along {self.name!r} has no cell without a declared interval")
        s = self.offset
        return (s, 1 - s) if self.flat[-1] > self.flat[0] else (1 - s, s)

    # NumPy forms ---------------------------------------------------------------------------------

    def positions(self, coords: np.ndarray, *, domain: str = SAMPLES, outside: str = NAN, roundoff: float = 0.0) -> np.ndarray:
        c, v, n = np.asarray(coords, float), self.flat, self.size
        if n == 0:
            raise ValueError(f"axis {self.name!r} has no sample")
        self.check_monotonic()
        step = self.step
        if n == 1 and (step is None or domain == SAMPLES and outside != EXTRAPOLATE and self.intervals is None):
            near = np.abs(c - v[0]) <= np.maximum(SINGLE_SAMPLE_TOLERANCE * np.maximum(1, np.maximum(abs(v[0]), np.abs(c))), roundoff)
            return self._reported(np.where(near, 0.0, np.nan), outside)
        if step is not None:
            p = (c - v[0]) / step
        else:
            up = v[-1] > v[0]
            w = v if up else v[::-1]
            i = np.clip(np.searchsorted(w, c, "right") - 1, 0, n - 2)
            p = i + (c - w[i]) / (w[i + 1] - w[i])
            p = p if up else n - 1 - p
        if outside == EXTRAPOLATE:
            return p
        before, after = self.extent(domain)
        with np.errstate(invalid="ignore"):
            bad = (p < -before - POSITION_SLACK) | (p > n - 1 + after + POSITION_SLACK) | np.isnan(p)
        return self._reported(np.where(bad, np.nan, np.clip(p, -before, n - 1 + after)), outside)

    def _reported(self, p: np.ndarray, outside: str) -> np.ndarray:
        if outside == RAISE and np.isnan(p).any():
            raise ValueError(f"a point lies outside along {self.name!r}")
        return p

    def coordinates(self, positions: np.ndarray) -> np.ndarray:
        p, v, n = np.asarray(positions, float), self.flat, self.size
        if n == 1:
            step = self.step
            if step is None and (np.abs(p) > POSITION_SLACK).any():
                raise ValueError(f"one sample along {self.name!r} has no step")
            return v[0] + p * (step or 0.0)
        i = np.clip(np.floor(p), 0, n - 2).astype(np.int64)
        f, d = p - i, v[i + 1] - v[i]
        return np.where(f < 0, v[i] + f * d, np.where(f > 1, v[i + 1] + (f - 1) * d, (1 - f) * v[i] + f * v[i + 1]))

    # Column forms --------------------------------------------------------------------------------

    def literal(self) -> Column:
        return F.array(*[F.lit(float(x)) for x in self.flat])

    def coordinate_column(self, position: Column) -> Column:
        """The coordinate at a fractional position."""
        v, n = self.flat, self.size
        if n == 1:
            step = self.step
            if step is None:
                return F.when(F.abs(position) <= POSITION_SLACK, F.lit(float(v[0]))).otherwise(F.raise_error(F.lit(f"one sample along {self.name!r} has no step")).cast("double"))
            return F.lit(float(v[0])) + position * F.lit(step)
        if (step := uniform_step(v, 0.0)) is not None:
            i = F.greatest(F.lit(0.0), F.least(F.floor(position).cast("double"), F.lit(float(n - 2))))
            lo, hi = F.lit(float(v[0])) + i * F.lit(step), F.lit(float(v[0])) + (i + 1) * F.lit(step)
        else:
            at = F.greatest(F.lit(0), F.least(F.floor(position).cast("int"), F.lit(n - 2)))
            i, lo, hi = at.cast("double"), F.element_at(self.literal(), at + 1), F.element_at(self.literal(), at + 2)
        f = position - i
        d = hi - lo
        return F.when(f < 0, lo + f * d).when(f > 1, hi + (f - 1) * d).otherwise((1 - f) * lo + f * hi)

    def index_column(self, index: Column) -> Column:
        """The coordinate of a whole position."""
        v = self.flat
        if not self.size:
            return F.lit(None).cast("double")
        if (step := uniform_step(v, 0.0)) is not None:
            return F.lit(float(v[0])) + index.cast("double") * F.lit(step)
        return F.element_at(self.literal(), index.cast("int") + 1) if self.size > 1 else F.lit(float(v[0]))

    def position_column(self, coord: Column, *, domain: str = SAMPLES, outside: str = NAN, roundoff: float = 0.0) -> Column:
        """The fractional position of a coordinate; outside is NaN, an error, or extrapolated.

        An even axis needs arithmetic only. An uneven one is searched in a literal array, by halving, so a
        row costs log2(n) comparisons and there is no join.
        """
        v, n = self.flat, self.size
        if n == 0:
            raise ValueError(f"axis {self.name!r} has no sample")
        self.check_monotonic()
        step = self.step
        if n == 1 and (step is None or domain == SAMPLES and outside != EXTRAPOLATE and self.intervals is None):
            limit = F.greatest(SINGLE_SAMPLE_TOLERANCE * F.greatest(F.lit(1.0), F.lit(abs(float(v[0]))), F.abs(coord)), F.lit(float(roundoff)))
            p = F.when(F.abs(coord - F.lit(float(v[0]))) <= limit, F.lit(0.0)).otherwise(F.lit(NAN_COL))
            return self._reported_column(p, outside)
        if step is not None:
            p = (coord - F.lit(float(v[0]))) / F.lit(step)
        else:
            up = v[-1] > v[0]
            w = v if up else v[::-1]
            table = F.array(*[F.lit(float(x)) for x in w])
            i = _halving(table, coord, n)
            lo, hi = F.element_at(table, i + 1), F.element_at(table, i + 2)
            p = i.cast("double") + (coord - lo) / (hi - lo)
            p = p if up else F.lit(float(n - 1)) - p
        if outside == EXTRAPOLATE:
            return p
        before, after = self.extent(domain)
        inside = (p >= -before - POSITION_SLACK) & (p <= n - 1 + after + POSITION_SLACK) & ~F.isnan(p)
        clipped = F.greatest(F.lit(-before), F.least(p, F.lit(n - 1 + after)))
        return self._reported_column(F.when(inside, clipped).otherwise(F.lit(NAN_COL)), outside)

    def _reported_column(self, p: Column, outside: str) -> Column:
        if outside != RAISE:
            return p
        return F.when(F.isnan(p), F.raise_error(F.lit(f"a point lies outside along {self.name!r}")).cast("double")).otherwise(p)

    # Selection -----------------------------------------------------------------------------------

    def take(self, key) -> Axis:
        """The axis after a selection by position: an int fixes it, slices, lists and masks keep its dimension."""
        values, cells = np.atleast_1d(self.values), self.intervals
        if isinstance(key, bool | np.bool_):
            raise TypeError("a bool is not a position")
        if isinstance(key, int | np.integer):
            if not -self.size <= key < self.size:
                raise IndexError(f"position {key} is outside {self.name!r}")
            k = int(key) % self.size
            return Axis(self.name, None, values[k], self.offset, None if cells is None else cells[k : k + 1])
        index = self.indices(key)
        return Axis(self.name, self.dim, values[index], self.offset, None if cells is None else cells[index])

    def indices(self, key) -> np.ndarray:
        if isinstance(key, slice):
            return np.arange(self.size)[key]
        k = np.asarray(key)
        if k.ndim != 1:
            raise ValueError("vectorized indexing changes geometry dimensions; call unframe()")
        if k.dtype == bool:
            if len(k) != self.size:
                raise IndexError("a mask has one entry for each sample")
            return np.flatnonzero(k)
        if k.size == 0:
            return np.zeros(0, np.int64)
        if k.dtype.kind not in "iu":
            raise TypeError("positions are integers")
        if (k < -self.size).any() or (k >= self.size).any():
            raise IndexError(f"a position is outside {self.name!r}")
        return k % self.size

    def label_indices(self, label, method: str | None = None):
        """The position key that a label, list or inclusive slice of labels stands for."""
        v = self.flat
        if self.dim is None:
            raise KeyError(f"source axis {self.name!r} is fixed and cannot be selected by label")
        if isinstance(label, slice):
            if label.step is not None:
                raise ValueError("a label slice has no step")
            self.check_monotonic()
            up = self.size < 2 or v[-1] > v[0]
            lo, hi = (label.start, label.stop) if up else (label.stop, label.start)
            inside = np.ones(len(v), bool)
            if lo is not None:
                inside &= v >= lo
            if hi is not None:
                inside &= v <= hi
            at = np.flatnonzero(inside)
            return slice(int(at[0]), int(at[-1]) + 1) if len(at) else slice(0, 0)
        wanted = np.asarray(label, float)
        if wanted.ndim > 1:
            raise ValueError("vectorized indexing changes geometry dimensions; call unframe()")
        found = []
        for x in np.atleast_1d(wanted):
            d = np.abs(v - x)
            k = int(np.argmin(d)) if len(d) else -1
            if k < 0 or (method is None and d[k] != 0):
                raise KeyError(f"label {x:g} is not along {self.name!r}")
            found.append(k)
        return found[0] if wanted.ndim == 0 else found


def _halving(table: Column, x: Column, n: int) -> Column:
    """The index of the last of n - 1 brackets whose lower label does not exceed x, as an int column.

    The steps are folded with a bound variable: written out, each would repeat the one before it.
    """
    widths = [1 << k for k in range(max(1, math.ceil(math.log2(max(2, n)))) - 1, -1, -1)]

    def step(at: Column, width: Column) -> Column:
        ahead = F.least(at + width, F.lit(n - 2))
        return F.when(F.element_at(table, ahead + 1) <= x, ahead).otherwise(at)

    return F.aggregate(F.array(*[F.lit(w) for w in widths]), F.lit(0), step)


@dataclass(frozen=True)
class Lattice:
    """The even case: sample 0's point, and the step along each dimension."""

    dims: tuple[str, ...]
    sizes: tuple[int, ...]
    origin: np.ndarray
    matrix: np.ndarray

    @property
    def spacing(self) -> np.ndarray:
        return np.linalg.norm(self.matrix, axis=0)

    @property
    def direction(self) -> np.ndarray:
        return self.matrix / self.spacing

    @property
    def affine(self) -> np.ndarray:
        n, k = self.matrix.shape
        out = np.zeros((n + 1, k + 1))
        out[:n, :k], out[:n, k], out[n, k] = self.matrix, self.origin, 1
        return out

    def transform_point(self, positions) -> np.ndarray:
        return np.asarray(positions, float) @ self.matrix.T + self.origin


def lattice_of(transform, axes: Sequence[Axis], dims: Sequence[str], tolerance: float = LATTICE_TOLERANCE) -> Lattice:
    """The lattice of evenly spaced axes under an affine map."""
    from framegrid.functions.transforms import AffineTransform

    if type(transform) is not AffineTransform:
        raise ValueError("a lattice needs an affine transform")
    by_axis: Mapping[str, Axis] = {a.name: a for a in axes}
    by_dim = {a.dim: a for a in axes if a.dim is not None}
    if set(dims) != set(by_dim):
        raise ValueError(f"lattice dimensions are {sorted(by_dim)}, not {sorted(dims)}")
    start = np.array([by_axis[a].flat[0] for a in transform.source.axes])
    cols = []
    for d in dims:
        axis = by_dim[d]
        step = uniform_step(axis.flat, tolerance) if axis.size > 1 else axis.step
        if step is None:
            raise ValueError(f"coordinates along {d!r} are not evenly spaced")
        cols.append(transform.matrix[:, transform.source.axes.index(axis.name)] * step)
    return Lattice(tuple(dims), tuple(by_dim[d].size for d in dims), transform.matrix @ start + transform.translation, np.stack(cols, axis=1))
