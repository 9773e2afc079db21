"""Resampling from a framed table onto a grid.

A plan is made on the driver: the frames are related, the map from target samples to source positions
is composed to one affine map where that is possible, and a way to gather is chosen. What runs is made
of DataFrame operations: generate the target, locate, gather by integer positions, weigh and sum.

How values are gathered is left to the optimizer: the source joins on integer positions, and is broadcast
only when its size, which a grid states, is below a bound. Before the join the source is cut to the box
that the target can reach, a plain predicate on its position columns that reaches the scan.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrid.functions.fields import POSITION, FieldTransform
from framegrid.functions.transforms import AffineTransform, CompositeTransform, compose, coordinate_system_change, identity, masked_columns_of
from framegrid.operators import tiles
from framegrid.operators.boxes import box_resample
from framegrid.operators.cubic import cubic_gather, filtered
from framegrid.operators.labels import with_labels
from framegrid.plans.declare import ROUNDING_ALLOWANCE, ArrayCoordinates, ReferenceFrame
from framegrid.plans.grid import Grid, pos
from framegrid.plans.periodic import Poles, longitude_of, poles_of
from framegrid.plans.sampling import CELLS, EXACT_STEP_TOLERANCE, SAMPLES, uniform_step

NEAREST, LINEAR, CUBIC, STEP, OVERLAP_MEAN = "nearest", "linear", "cubic", "step", "overlap_mean"
METHODS = (NEAREST, LINEAR, CUBIC, STEP, OVERLAP_MEAN)
#: A gathered side of at most so many rows, by the sizes its grid states, is broadcast.
BROADCAST_ROWS = 500_000
NAN = float("nan")


def relate(target: ReferenceFrame, source: ReferenceFrame, transform: Any = None) -> Any:
    """The map from the target's frame to the source's; refuses to guess a relation."""
    if transform is not None:
        if transform.source != target or transform.target != source:
            raise ValueError("the transform's endpoints must be the target's frame and the source's frame")
        return transform
    if target == source:
        return identity(target)
    if target.is_equivalent_frame(source):
        return coordinate_system_change(target, source)
    raise ValueError(f"{target} and {source} are not one space; give a transform or adopt the frame")


@dataclass(frozen=True)
class Located:
    """How target samples find their source positions."""

    source: Grid
    target: Grid
    chain: Any
    lattice: AffineTransform | None
    poles: Poles | None = None
    bent: BentMap | None = None


def locate(source: Grid, target: Grid, transform: Any = None, poles: bool = True) -> Located:
    """Compose target coordinates -> target frame -> source frame -> source coordinates.

    Without ``poles`` rows do not go on across a pole.
    """
    if source.count() == 0:
        raise ValueError("the source has no sample")
    over = relate(target.frame, source.frame, transform)
    if not hasattr(source.transform, "inverse"):
        raise TypeError("the source's transform has no inverse")
    chain = compose(target.transform, over, source.transform.inverse())
    across = poles_of(source) if poles else None
    if across:
        return Located(source, target, chain, None, across)
    return Located(source, target, chain, _lattice_map(chain, source, target), None, _bent_map(chain, source, target))


def _from_positions(t: AffineTransform, grid: Grid) -> tuple[np.ndarray, np.ndarray] | None:
    """(matrix, shift) from whole positions of ``grid`` to the points of ``t``; None where an axis is uneven."""
    shift, by_dim = t.translation.copy(), {}
    for k, name in enumerate(t.source.axes):
        axis = grid.axis(name)
        step = axis.step if axis.size > 1 else 0.0
        if axis.dim is not None and axis.size > 0 and step is None:
            return None
        shift = shift + t.matrix[:, k] * (float(axis.flat[0]) if axis.size else 0.0)
        if axis.dim is not None:
            by_dim[axis.dim] = t.matrix[:, k] * (step or 0.0)
    return np.array([by_dim[d] for d in grid.dims]).reshape(len(grid.dims), len(shift)).T, shift


def _to_positions(grid: Grid, axes: Sequence[str]) -> tuple[np.ndarray, np.ndarray] | None:
    """(matrix, shift) from coordinates along ``axes`` to positions by dimension; None where an axis is uneven,
    goes round or has no dimension."""
    matrix, shift = np.zeros((len(grid.dims), len(axes))), np.zeros(len(grid.dims))
    if any(a.dim is None for a in grid.axes):
        return None
    for k, name in enumerate(axes):
        axis = grid.axis(name)
        step = uniform_step(axis.flat, EXACT_STEP_TOLERANCE)
        if step is None or longitude_of(grid, axis) is not None:
            return None
        n = grid.dims.index(axis.dim)
        matrix[n, k], shift[n] = 1 / step, -float(axis.flat[0]) / step
    return matrix, shift


def _lattice_map(chain: Any, source: Grid, target: Grid) -> AffineTransform | None:
    """One affine map from whole target positions to source positions, where all axes are even."""
    if type(chain) is not AffineTransform:
        return None
    start, end = _from_positions(chain, target), _to_positions(source, chain.target.axes)
    if start is None or end is None:
        return None
    a, b = (ArrayCoordinates(list(g.dims), [None] * len(g.dims)) for g in (target, source))
    return AffineTransform.from_matrix(end[0] @ start[0], source=a, target=b, translation=end[0] @ start[1] + end[1])


@dataclass(frozen=True)
class BentMap:
    """Source positions of whole target positions i through a field of nodes: M i + s + P u(A i + a).

    ``u`` are the field's values at the node positions A i + a, where A is ``to_node``. A displacement
    field adds them to the point; a position field's are the point, so M is zero.
    """

    field: FieldTransform
    matrix: np.ndarray
    shift: np.ndarray
    push: np.ndarray
    to_node: np.ndarray
    before: AffineTransform
    coordinates: tuple[tuple[int | None, np.ndarray], ...]

    def nodes_at(self, index: Sequence[np.ndarray]) -> np.ndarray:
        """Node positions of target positions, rounded as the columns of ``before`` are, so that a point on
        the edge of the field's support falls on the same side in every plan."""
        cols = [np.full(len(index[0]), values[0]) if k is None else values[index[k]] for k, values in self.coordinates]
        points = []
        for row, t in zip(self.before.matrix, self.before.translation, strict=True):
            terms = [c if m == 1 else c * m for m, c in zip(row, cols, strict=True) if m != 0]
            terms += [np.full(len(index[0]), t)] if t != 0 or not terms else []
            points.append(reduce(lambda a, b: a + b, terms))
        return self.field._to_index.transform_point(np.stack(points, -1))

    def spread(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest P u by source dimension: weights are not negative and sum to 1."""
        flat = self.field.values.reshape(-1, self.field.values.shape[-1]).astype(float)
        ends = np.stack([self.push * flat.min(0), self.push * flat.max(0)])
        low, high = ends.min(0).sum(1), ends.max(0).sum(1)
        return (np.minimum(low, 0), np.maximum(high, 0)) if self.field.exterior == "identity" else (low, high)


def _bent_map(chain: Any, source: Grid, target: Grid) -> BentMap | None:
    """The chain as a BentMap if it is one field with affine maps around it and all axes are even."""
    members = list(chain.transforms) if isinstance(chain, CompositeTransform) else [chain]
    fields = [k for k, t in enumerate(members) if isinstance(t, FieldTransform)]
    if len(fields) != 1 or len(members) != 3 or fields != [1] or any(type(t) is not AffineTransform for t in (members[0], members[2])):
        return None
    before, field, after = members
    if field.kind == POSITION and field.exterior == "identity":
        return None
    start, end = _from_positions(before, target), _to_positions(source, after.target.axes)
    if start is None or end is None or not target.dims:
        return None
    push = end[0] @ after.matrix
    shift = end[0] @ after.translation + end[1]
    moved = np.zeros((len(source.dims), len(target.dims))) if field.kind == POSITION else push @ start[0]
    shift = shift if field.kind == POSITION else shift + push @ start[1]
    axes = [target.axis(name) for name in before.source.axes]
    coordinates = tuple((None if a.dim is None else target.dims.index(a.dim), a.flat.astype(float)) for a in axes)
    return BentMap(field, moved, shift, push, field._to_index.matrix @ start[0], before, coordinates)


def position_columns(plan: Located, domain: str) -> tuple[dict[str, Column], Column]:
    """Clipped source positions by source dimension, and whether the row lies inside."""
    source = plan.source
    if plan.lattice is not None:
        raw = plan.lattice.raw_columns([F.col(pos(d)).cast("double") for d in plan.target.dims])
        found = dict(zip(source.dims, raw, strict=True))
        inside, out = F.lit(True), {}
        for d in source.dims:
            axis = source.axis_along(d)
            n, (before, after) = axis.size, axis.extent(domain)
            p = found[d]
            if n == 1 and (before, after) == (0.0, 0.0):
                inside = inside & (F.abs(p) <= F.lit(1e-9))
            inside = inside & (p >= F.lit(-before - 1e-9)) & (p <= F.lit(n - 1 + after + 1e-9))
            out[d] = F.greatest(F.lit(0.0), F.least(p, F.lit(float(n - 1))))
        return out, inside
    coords, inside = masked_columns_of(plan.chain, [_target_coordinate(plan.target, a) for a in plan.chain.source.axes])
    out: dict[str, Column] = {}
    for c, name in zip(coords, plan.chain.target.axes, strict=True):
        axis = source.axis(name)
        lon = longitude_of(source, axis)
        polar = plan.poles is not None and axis.name == plan.poles.latitude.name
        if lon is not None:
            p, ok = lon.position_column(c, domain)
        elif polar:
            p, ok = plan.poles.position_column(c, domain)
        else:
            p = axis.position_column(c, domain=domain if axis.dim else SAMPLES)
            ok = ~F.isnan(p)
        inside = inside & ok
        if axis.dim is not None:
            limit = float(axis.size - 1) if lon is None or not lon.is_global else float(lon.count)
            first = -1.0 if polar and plan.poles.low else 0.0
            limit += 1.0 if polar and plan.poles.high else 0.0
            out[axis.dim] = F.greatest(F.lit(first), F.least(p, F.lit(limit)))
    return out, inside


def _target_coordinate(target: Grid, name: str) -> Column:
    return target.coordinate(target.axis(name))


def reach(plan: Located, margin: int) -> dict[str, tuple[int, int]]:
    """The box of source positions that the target can need, by source dimension; only for lattice maps."""
    if plan.lattice is None:
        return {}
    ends = [(0, max(0, n - 1)) for n in (plan.target.sizes[d] for d in plan.target.dims)]
    corners = np.array(list(itertools.product(*ends)), float).reshape(1 << len(ends), len(ends))
    p = plan.lattice.transform_point(corners)
    out = {}
    for k, d in enumerate(plan.source.dims):
        n = plan.source.sizes[d]
        lo = int(np.clip(np.floor(p[:, k].min()) - margin, 0, n - 1))
        hi = int(np.clip(np.ceil(p[:, k].max()) + margin, 0, n - 1))
        out[d] = (lo, hi)
    return out


def cropped(values: DataFrame, box: Mapping[str, tuple[int, int]]) -> DataFrame:
    for d, (lo, hi) in box.items():
        values = values.filter(F.col(pos(d)).between(lo, hi))
    return values


def is_same_grid(plan: Located) -> bool:
    """A signed permutation with whole offsets, within 1e-9 at all corners: values are copied."""
    if plan.lattice is None:
        return False
    m, t = plan.lattice.matrix, plan.lattice.translation
    r = np.rint(m)
    if (np.abs(r).sum(axis=0) > 1).any() or (np.abs(r).sum(axis=1) != 1).any():
        return False
    sizes = np.array([plan.target.sizes[d] for d in plan.target.dims], float)
    return bool((np.abs(m - r) @ np.maximum(sizes - 1, 0) + np.abs(t - np.rint(t)) <= 1e-9).all())


def _gathered(source: Grid, values: DataFrame, carried: Sequence[str]) -> DataFrame:
    """``values`` marked for broadcast where the grid bounds its rows; with labels it has a row for each."""
    return F.broadcast(values) if source.count() <= BROADCAST_ROWS and not carried else values


def resample(
    values: DataFrame,
    source: Grid,
    target: Grid,
    *,
    value_columns: Sequence[str] = ("value",),
    carried: Sequence[str] = (),
    transform: Any = None,
    method: str = LINEAR,
    fill_value: float = NAN,
    domain: str = SAMPLES,
    support: str = "point",
    min_coverage: float = 0.5,
    return_coverage: bool = False,
    missing_rows: str = "nan",
    poles: bool = True,
    reversed_at_poles: Sequence[str] = (),
) -> DataFrame:
    """Values of the long-form table ``values`` (pos_*, carried, value columns) at ``target``'s samples.

    Returns pos_* of the target, the carried columns and the value columns. A target sample outside the
    source gets ``fill_value``; a value with more than rounding's weight on NaN is NaN. A source sample
    without a row counts as NaN (``missing_rows="nan"``), or raises where it is needed ("raise").
    Every target sample has a row for each label of the carried dimensions. Across a pole the row of the
    opposite meridian follows, unless ``poles`` is false; values of ``reversed_at_poles`` change sign there.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if domain not in (SAMPLES, CELLS):
        raise ValueError(f"unknown domain {domain!r}")
    clash = (set(carried) | set(value_columns)) & ({pos(d) for d in target.dims} | set(target.transform.target.axes))
    if clash:
        raise ValueError(f"columns {sorted(clash)} would collide with the target's")
    if missing := [c for c in (*[pos(d) for d in source.dims], *carried, *value_columns) if c not in values.columns]:
        raise ValueError(f"the source table lacks {missing}")
    plan = locate(source, target, transform, poles)
    kinds = {f.name: f.dataType.simpleString() for f in values.schema.fields}
    if method in (STEP, OVERLAP_MEAN):
        return box_resample(
            plan, values, value_columns, carried, method=method, support=support, fill_value=fill_value, domain=domain,
            min_coverage=min_coverage, return_coverage=return_coverage,
        )
    if return_coverage or support != "point":
        raise ValueError("coverage and average support belong to the box methods")
    margin = 1
    values = values.select(*[pos(d) for d in source.dims], *carried, *value_columns)
    # Cubic coefficients depend on whole lines, and the filter checks that none of their samples lacks.
    values = values if method == CUBIC else cropped(values, reach(plan, margin))
    # The kernel works in double, which would not keep a copied bigint.
    exact = method == NEAREST and any(kinds[v] == "bigint" for v in value_columns)
    if tiles.fits(plan, method) and missing_rows == "nan" and not exact and not (method == CUBIC and any(n < 2 for n in source.sizes.values())):
        coefficients = filtered(values, source, carried, value_columns) if method == CUBIC else values
        out = tiles.tile_gather(plan, coefficients, value_columns, carried, method=method, fill_value=float(fill_value), domain=domain)
        made = [_typed(F.col(v), kinds[v], method, fill_value).alias(v) for v in value_columns]
        return out.select(*[pos(d) for d in target.dims], *carried, *made)
    frame = target.to_df(values.sparkSession, coordinates=False)
    positions, inside = position_columns(plan, domain)
    frame = frame.withColumns({**{f"p_{d}": F.when(inside, c) for d, c in positions.items()}})
    if carried:
        frame = with_labels(frame, values, carried)
    if method == NEAREST or is_same_grid(plan):
        out = _nearest(plan, frame, values, value_columns, carried, reversed_at_poles)
    elif method == LINEAR:
        out = _linear(plan, frame, values, value_columns, carried, reversed_at_poles)
    else:
        out = cubic_gather(plan, frame, values, value_columns, carried)
    first = F.lit(True)
    for d in source.dims:
        first = first & F.col(f"p_{d}").isNotNull()
    result = []
    for v in value_columns:
        value = F.col(v)
        if missing_rows == "raise":
            value = F.coalesce(value, F.raise_error(F.lit("a needed source sample has no row")).cast(kinds[v]))
        result.append(F.when(first, _typed(value, kinds[v], method, fill_value)).otherwise(_typed(F.lit(fill_value), kinds[v], method, fill_value)).alias(v))
    return out.select(*[pos(d) for d in target.dims], *carried, *result)


def _typed(value: Column, kind: str, method: str, fill_value: float) -> Column:
    """The result's type: whole numbers stay under nearest if the fill is one, floats stay, the rest is double."""
    whole = kind in ("tinyint", "smallint", "int", "bigint", "boolean")
    if method == NEAREST and whole and not _is_nan(fill_value) and float(fill_value).is_integer():
        return F.coalesce(F.when(~F.isnan(value.cast("double")), value.cast(kind)), F.lit(fill_value).cast(kind))
    kind = "float" if kind == "float" else "double"
    return F.coalesce(value.cast(kind), F.lit(NAN).cast(kind))


def _is_nan(x: Any) -> bool:
    return isinstance(x, float) and x != x


def _nearest(plan: Located, frame: DataFrame, values: DataFrame, value_columns: Sequence[str], carried: Sequence[str], turned: Sequence[str] = ()) -> DataFrame:
    """Gather join on the nearest whole position; a half goes up."""
    at, crossed = source_indices(plan, {d: F.floor(F.col(f"p_{d}") + F.lit(0.5)).cast("long") for d in plan.source.dims})
    joined = _join(plan, frame.withColumns({f"i_{d}": c for d, c in at.items()} | ({"crossed": crossed} if turned else {})), values, carried)
    return joined.withColumns({v: F.when(F.col("crossed"), -F.col(v)).otherwise(F.col(v)) for v in turned}) if turned else joined


def source_indices(plan: Located, index: Mapping[str, Column]) -> tuple[dict[str, Column], Column]:
    """Whole positions brought into the source, and whether they lie past a pole.

    A longitude goes round, a row past a pole comes back on the opposite meridian.
    """
    out, crossed = {}, F.lit(False)
    for d, k in index.items():
        axis = plan.source.axis_along(d)
        lon = longitude_of(plan.source, axis)
        if lon is not None and lon.is_global:
            out[d] = F.pmod(k, F.lit(lon.count)).cast("long")
        elif plan.poles is not None and axis.name == plan.poles.latitude.name:
            out[d] = k
        else:
            out[d] = F.greatest(F.lit(0), F.least(k, F.lit(axis.size - 1)))
    if plan.poles is not None:
        lat, lon = plan.poles.latitude.dim, plan.poles.longitude.axis.dim
        out[lat], out[lon], crossed = plan.poles.fold(out[lat], out[lon])
    return out, crossed


def _join(plan: Located, frame: DataFrame, values: DataFrame, carried: Sequence[str]) -> DataFrame:
    right = values.select(*[F.col(pos(d)).alias(f"s_{d}") for d in plan.source.dims], *[F.col(c).alias(f"k_{c}") for c in carried], *[c for c in values.columns if not c.startswith("pos_") and c not in carried])
    on = F.lit(True)
    for d in plan.source.dims:
        on = on & (F.col(f"i_{d}") == F.col(f"s_{d}"))
    for c in carried:
        on = on & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    return frame.join(_gathered(plan.source, right, carried), on, "left").drop(*[f"s_{d}" for d in plan.source.dims], *[f"k_{c}" for c in carried])


def _linear(plan: Located, frame: DataFrame, values: DataFrame, value_columns: Sequence[str], carried: Sequence[str], turned: Sequence[str] = ()) -> DataFrame:
    """Corner join: at most 2**d weighted rows per target sample, summed by map-side aggregation."""
    dims = plan.source.dims
    corners = F.array(*[F.struct(*_corner(plan, dims, bits)) for bits in itertools.product((0, 1), repeat=len(dims))])
    used = F.filter(corners, lambda c: c["w"] > 0)
    wide = frame.withColumn("corner", F.explode_outer(used))
    turns = [F.col("corner.crossed").alias("crossed")] if turned else []
    wide = wide.select(*frame.columns, F.coalesce("corner.w", F.lit(0.0)).alias("w"), *[F.col(f"corner.i_{d}").alias(f"i_{d}") for d in dims], *turns)
    return weighted_sum(_join(plan, wide, values, carried), plan, frame, value_columns, carried, turned)


def weighted_sum(joined: DataFrame, plan: Located, frame: DataFrame, value_columns: Sequence[str], carried: Sequence[str], turned: Sequence[str] = ()) -> DataFrame:
    """Sum of w * v with NaN and absent values as zero, or NaN if they have more than rounding's weight."""
    keys = [pos(d) for d in plan.target.dims]
    sums = []
    for v in value_columns:
        x = F.col(v).cast("double")
        gone = x.isNull() | F.isnan(x)
        x = F.when(F.col("crossed"), -x).otherwise(x) if v in turned else x
        sums.append(F.sum(F.when(gone, F.lit(0.0)).otherwise(F.col("w") * x)).alias(f"sum_{v}"))
        sums.append(F.sum(F.when(gone, F.abs(F.col("w"))).otherwise(F.lit(0.0))).alias(f"gone_{v}"))
    places = [F.first(f"p_{d}").alias(f"p_{d}") for d in plan.source.dims]
    out = joined.groupBy(*keys, *carried).agg(*sums, *places)
    return out.select(
        *keys, *carried, *[f"p_{d}" for d in plan.source.dims],
        *[F.when(F.col(f"gone_{v}") > ROUNDING_ALLOWANCE, F.lit(NAN)).otherwise(F.col(f"sum_{v}")).alias(v) for v in value_columns],
    )


def _corner(plan: Located, dims: Sequence[str], bits: Sequence[int]) -> list[Column]:
    weight, at = F.lit(1.0), {}
    for d, b in zip(dims, bits, strict=True):
        p = F.col(f"p_{d}")
        low = F.floor(p)
        f = p - low
        weight = weight * (f if b else F.lit(1.0) - f)
        at[d] = (low + b).cast("long")
    found, crossed = source_indices(plan, at)
    return [weight.alias("w"), *[c.alias(f"i_{d}") for d, c in found.items()], crossed.alias("crossed")]
