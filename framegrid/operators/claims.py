"""Cells that a resampled result can claim: those of source samples that the target meets exactly."""

from __future__ import annotations

from typing import Any

import numpy as np

from framegrid.functions.transforms import AffineTransform, compose
from framegrid.operators.boxes import separable, slab_tolerance
from framegrid.plans.declare import ROUNDING_ALLOWANCE
from framegrid.plans.grid import Grid
from framegrid.plans.sampling import EXTRAPOLATE, SAMPLES, Axis, check_intervals


def _met(source: Axis, labels: np.ndarray) -> np.ndarray | None:
    """The positions of source samples that lie at all the labels."""
    if not source.size:
        return None
    p = source.positions(labels, domain=SAMPLES, outside=EXTRAPOLATE)
    whole = np.rint(p)
    fits = np.isfinite(p) & (np.abs(p - whole) <= ROUNDING_ALLOWANCE) & (whole >= 0) & (whole < source.size)
    return whole.astype(np.int64) if fits.all() else None


def claimed_intervals(source: Grid, target: Grid, chain: Any, support: str = "point") -> dict[str, np.ndarray]:
    """Cells by target axis, for the map ``chain`` from target to source coordinates.

    An axis that selects source samples takes their cells, brought back by the map, unless they disagree
    with the target's sample offset. Under average support the cells must also be the target's own for
    that; every other axis then keeps the target's cells, over which its values were averaged.
    """
    if type(chain) is not AffineTransform or chain.matrix.shape[0] != chain.matrix.shape[1]:
        return {}
    try:
        driven = separable(chain)
    except ValueError:
        return {}
    if any(not name for name, _, _ in driven.values()):
        return {}
    out: dict[str, np.ndarray] = {}
    for name, (driver, slope, offset) in driven.items():
        own, axis = source.axis(name), target.axis(driver)
        at = _met(own, offset + slope * axis.flat)
        if support == "average" and at is not None and axis.intervals is not None:
            moved = np.sort(offset + slope * axis.intervals, axis=1)
            if own.intervals is None or (np.abs(moved - own.intervals[at]) > slab_tolerance(moved)[:, None]).any():
                at = None
        if support == "average" and at is None:
            if axis.intervals is not None:
                out[driver] = axis.intervals
        elif at is not None and own.intervals is not None:
            cells = np.sort((own.intervals[at] - offset) / slope, axis=1)
            try:
                out[driver] = check_intervals(cells, axis.flat, axis.offset)
            except ValueError:
                continue
    return out


def claimed_grid(source: Grid, target: Grid, over: Any, support: str = "point") -> Grid:
    """The target with the cells that a result on it can claim, and no others."""
    claims = claimed_intervals(source, target, compose(target.transform, over, source.transform.inverse()), support)
    if not claims and all(a.intervals is None for a in target.axes):
        return target
    return Grid.of(target.transform, [Axis(a.name, a.dim, a.values, a.offset, claims.get(a.name)) for a in target.axes], target.dims)
