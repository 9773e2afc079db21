"""Longitude axes that close on themselves, and rows that continue across a pole."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from framegrid.functions.transforms import AffineTransform
from framegrid.plans.declare import CARTESIAN, LATITUDE, LONGITUDE, POSITION_SLACK, full_turn
from framegrid.plans.grid import Grid
from framegrid.plans.sampling import CELLS, SAMPLES, Axis


def _role_axis(grid: Grid, axis: Axis, role: str) -> tuple[float, float, float] | None:
    """(slope, offset, turn) of the frame's axis with ``role`` if this source axis alone drives it."""
    system = grid.frame.coordinate_system
    if system.representation == CARTESIAN or type(grid.transform) is not AffineTransform:
        return None
    j, m = system.axis_of(role), grid.transform.matrix
    k = grid.transform.source.axes.index(axis.name)
    if m[j, k] == 0 or np.count_nonzero(m[j]) != 1 or np.count_nonzero(m[:, k]) != 1:
        return None
    return float(m[j, k]), float(grid.transform.translation[j]), full_turn(system.units[j])


def _tolerance(v: np.ndarray) -> float:
    steps = np.abs(np.diff(v))
    return min(4 * float(np.spacing(np.float32(np.abs(v).max()))), 0.01 * float(steps.min())) + 1e-6 * float(steps.max())


@dataclass(frozen=True)
class Longitude:
    """A longitude axis in its own units; ``count`` samples close the circle if it is global."""

    axis: Axis
    period: float
    is_global: bool
    count: int

    def position_column(self, c: Column, domain: str) -> tuple[Column, Column]:
        v = self.axis.flat
        if not self.is_global:
            before, after = self.axis.extent(domain)
            ends = self.axis.coordinates(np.array([-before, self.axis.size - 1 + after])) if self.axis.size > 1 else v[[0, 0]]
            low = float(ends.min())
            # A point on the lower edge may lie a rounding below it: it must not turn up a whole period on.
            turned = F.pmod(c - F.lit(low), F.lit(self.period))
            turned = F.when(turned >= F.lit(self.period * (1 - 1e-12)), F.lit(0.0)).otherwise(turned)
            p = self.axis.position_column(F.lit(low) + turned, domain=domain)
            return p, ~F.isnan(p)
        up = v[1] > v[0]
        w = v[: self.count] if up else v[: self.count][::-1]
        ring = Axis(self.axis.name, self.axis.dim, np.append(w, w[0] + self.period))
        p = ring.position_column(F.lit(float(w[0])) + F.pmod(c - F.lit(float(w[0])), F.lit(self.period)), domain=SAMPLES, outside="extrapolate")
        n = float(self.count)
        p = F.least(p, F.lit(n)) if up else F.pmod(F.lit(n - 1) - p, F.lit(n))
        return p, F.lit(True)


def longitude_of(grid: Grid, axis: Axis) -> Longitude | None:
    found = _role_axis(grid, axis, LONGITUDE)
    if found is None or axis.dim is None or axis.size < 2:
        return None
    axis.check_monotonic()
    period, v = found[2] / abs(found[0]), axis.flat
    w = v if v[1] > v[0] else v[::-1]
    tol, widest = _tolerance(v), float(np.diff(w).max())
    seam = w[0] + period - w[-1]
    if axis.intervals is not None:
        cells = axis.intervals[np.argsort(axis.intervals[:, 0])]
        closed = np.abs(cells[1:, 0] - cells[:-1, 1]).max(initial=0) <= tol and abs(cells[-1, 1] - cells[0, 0] - period) <= tol
        return Longitude(axis, period, bool(closed), axis.size)
    if abs(seam) <= tol and axis.size > 2:
        return Longitude(axis, period, True, axis.size - 1)
    return Longitude(axis, period, bool(tol < seam <= widest + tol), axis.size)


@dataclass(frozen=True)
class Poles:
    """How rows go on past each end of a latitude axis: "odd" has a row on the pole, "even" straddles it."""

    latitude: Axis
    longitude: Longitude
    low: str | None
    high: str | None
    #: Slope, offset and full turn of the angle along the axis.
    mapping: tuple[float, float, float]

    def extended(self) -> tuple[Axis, int]:
        """The axis with a mirrored row at each end that has a pole, and how many lie in front."""
        v, poles = self.latitude.flat, self._pole_labels()
        rows = list(v)
        if self.low:
            rows.insert(0, 2 * poles[0] - v[1 if self.low == "odd" else 0])
        if self.high:
            rows.append(2 * poles[1] - v[-2 if self.high == "odd" else -1])
        return Axis(self.latitude.name, self.latitude.dim, np.array(rows)), int(bool(self.low))

    def _pole_labels(self) -> tuple[float, float]:
        slope, offset, turn = self.mapping
        a, b = ((-turn / 4 - offset) / slope, (turn / 4 - offset) / slope)
        return (a, b) if (a < b) == (self.latitude.flat[1] > self.latitude.flat[0]) else (b, a)

    def position_column(self, c: Column, domain: str) -> tuple[Column, Column]:
        """The position on the unextended axis, -1 to n, and whether the row lies inside."""
        axis, front = self.extended()
        labels = self._pole_labels()
        lo, hi = min(labels), max(labels)
        step = float(np.abs(np.diff(self.latitude.flat)).min())
        at = F.greatest(F.lit(lo), F.least(c, F.lit(hi)))
        p = axis.position_column(at, outside="extrapolate") - F.lit(float(front))
        before, after = self.latitude.extent(domain)
        n = self.latitude.size
        first, last = (-1.0 if self.low else -before - POSITION_SLACK), (n if self.high else n - 1 + after + POSITION_SLACK)
        beyond = (c < F.lit(lo - POSITION_SLACK * step)) | (c > F.lit(hi + POSITION_SLACK * step))
        return p, (p >= F.lit(float(first))) & (p <= F.lit(float(last))) & ~beyond

    def fold(self, row: Column, column: Column) -> tuple[Column, Column, Column]:
        """(row, column, crossed) of a row index from -1 to n."""
        n, half = self.latitude.size, self.longitude.count // 2
        under, over = row < 0, row > n - 1
        own = F.when(under, F.lit(1 if self.low == "odd" else 0)).when(over, F.lit(n - 2 if self.high == "odd" else n - 1)).otherwise(row)
        return own.cast("long"), F.when(under | over, F.pmod(column + half, F.lit(self.longitude.count))).otherwise(column), under | over


def poles_of(grid: Grid) -> Poles | None:
    """Pole rules of a global grid with antipodal meridians; None where no row continues across a pole."""
    lats = [(a, m) for a in grid.axes if a.dim is not None and a.size > 1 and (m := _role_axis(grid, a, LATITUDE))]
    lons = [x for a in grid.axes if (x := longitude_of(grid, a)) is not None]
    if not lats or not lons or not lons[0].is_global or lons[0].count % 2:
        return None
    lon, (lat, mapping) = lons[0], lats[0]
    v = lon.axis.flat[: lon.count]
    half, way = lon.count // 2, 1 if v[1] > v[0] else -1
    if np.abs(v[half:] - v[:half] - way * lon.period / 2).max() > _tolerance(v):
        return None
    slope, offset, turn = mapping
    angles, tol, widest = slope * lat.flat + offset, _tolerance(slope * lat.flat + offset), float(np.abs(np.diff(slope * lat.flat)).max())

    def kind(angle: float) -> str | None:
        gap = turn / 4 - abs(angle)
        if abs(gap) <= tol:
            return "odd"
        return "even" if tol < 2 * gap <= widest + tol else None

    found = Poles(lat, lon, kind(angles[0]), kind(angles[-1]), mapping)
    return found if found.low or found.high else None


__all__ = ["CELLS", "Longitude", "Poles", "longitude_of", "poles_of"]
