"""Deformations given on a grid of nodes: displacement, B-spline and position fields.

A field whose nodes fit a stated bound is held as an array and evaluated in Arrow batches, so it composes
with any other map. A field of any size is a table of nodes: points are joined with the 2**d or 4**d nodes
around them on integer positions and the weighted nodes are summed.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegrid.functions.transforms import AffineTransform, Steps, checked
from framegrid.operators.cubic import basis
from framegrid.plans.declare import Endpoint
from framegrid.plans.grid import Grid, pos

DISPLACEMENT, BSPLINE, POSITION = "displacement", "bspline", "position"
EXTERIORS = ("raise", "identity", "nearest")
#: Up to so many taps of a point are written out in generated code; more would pass what the JVM compiles.
UNROLLED_TAPS = 16
#: Nodes held as an array may take so many bytes at most.
MAX_ARRAY_BYTES = 256 << 20


def _support(grid: Grid, kind: str) -> list[tuple[float, float]]:
    out = []
    for d in grid.dims:
        axis = grid.axis_along(d)
        n = axis.size
        if kind == BSPLINE:
            if n < 4:
                raise ValueError("a B-spline field needs four nodes along each axis")
            out.append((1.0, float(n - 2)))
        elif kind == POSITION:
            out.append((0.0, float(n - 1)))
        else:
            before, after = axis.extent() if n > 1 else (0.0, 0.0)
            out.append((-before, n - 1 + after))
    return out


def _basis(f: np.ndarray) -> np.ndarray:
    g = 1 - f
    return np.stack([g**3 / 6, (4 - 6 * f**2 + 3 * f**3) / 6, (4 - 6 * g**2 + 3 * g**3) / 6, f**3 / 6], -1)


def _slope(f: np.ndarray) -> np.ndarray:
    g = 1 - f
    return np.stack([-(g**2) / 2, (3 * f**2 - 4 * f) / 2, (4 * g - 3 * g**2) / 2, f**2 / 2], -1)


@dataclass(frozen=True, eq=False)
class FieldTransform:
    """A map defined by values at a grid's samples. The grid lies in the source frame and is even.

    ``closed`` tells whether a point exactly on the upper end of the support belongs to it.
    """

    kind: str
    grid: Grid
    values: np.ndarray
    target: Endpoint
    exterior: str = "raise"
    closed: bool = False

    def __post_init__(self) -> None:
        v = np.asarray(self.values)
        v = v if v.dtype in (np.float32, np.float64) else v.astype(float)
        if v.nbytes > MAX_ARRAY_BYTES:
            raise ValueError("the field is too large for an array; use field_map with a table of nodes")
        if v.shape != (*self.grid.sizes.values(), len(self.target.axes)) or not np.isfinite(v).all():
            raise ValueError("field values are finite, one component of each target axis for each node")
        if self.exterior not in EXTERIORS or self.kind == POSITION and self.exterior == "nearest":
            raise ValueError(f"exterior {self.exterior!r} is not one of this field's")
        if self.kind != POSITION and len(self.target.axes) != len(self.grid.frame.axes):
            raise ValueError("a displacement keeps the number of axes")
        object.__setattr__(self, "values", v)
        object.__setattr__(self, "_to_index", _index_map(self.grid))
        _support(self.grid, self.kind)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, FieldTransform) and all(getattr(self, k) == getattr(other, k) for k in ("kind", "grid", "target", "exterior", "closed")) and np.array_equal(self.values, other.values)

    def __hash__(self) -> int:
        return hash((self.kind, self.grid, self.target, self.exterior))

    @property
    def source(self) -> Endpoint:
        return self.grid.frame

    def _located(self, points: Any) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(points, clipped continuous indices, inside)."""
        x = np.asarray(points, float)
        p = self._to_index.transform_point(x)
        support = np.array(_support(self.grid, self.kind))
        high = p <= support[:, 1] if self.closed or self.kind == POSITION else p < support[:, 1]
        inside = ((p >= support[:, 0]) & high).all(axis=-1)
        if self.exterior == "raise" and not inside.all():
            raise ValueError("a point lies outside the field")
        n = np.array(list(self.grid.sizes.values()))
        lo, hi = (support[:, 0], support[:, 1]) if self.kind == BSPLINE else (np.zeros(len(n)), n - 1.0)
        return x, np.clip(p, lo, hi), inside

    def _sum(self, p: np.ndarray, derivative: int | None = None) -> np.ndarray:
        """The field at indices ``p``, or its derivative by one index."""
        sizes = list(self.grid.sizes.values())
        weights, first = [], []
        for k, n in enumerate(sizes):
            x = p[..., k]
            if self.kind == BSPLINE:
                i = np.clip(np.floor(x), 1, n - 3).astype(np.int64)
                weights.append((_slope if derivative == k else _basis)(x - i))
                first.append(i - 1)
            else:
                i = np.clip(np.floor(x), 0, max(n - 2, 0)).astype(np.int64)
                f = x - i
                one = np.ones_like(f)
                weights.append(np.stack([-one, one] if derivative == k else [1 - f, f], -1) if n > 1 else np.stack([one * (derivative != k)], -1))
                first.append(i)
        out = 0.0
        for taps in itertools.product(*[range(w.shape[-1]) for w in weights]):
            w = 1.0
            for k, t in enumerate(taps):
                w = w * weights[k][..., t]
            out = out + w[..., None] * self.values[tuple(i + t for i, t in zip(first, taps, strict=True))].astype(float)
        return out

    def axis_weights(self, k: int, p: np.ndarray) -> tuple[int, np.ndarray]:
        """(first node, weights of the nodes from it on) along node axis ``k`` for each clipped index of ``p``."""
        n = list(self.grid.sizes.values())[k]
        if self.kind == BSPLINE:
            i = np.clip(np.floor(p), 1, n - 3).astype(np.int64)
            taps, first = _basis(p - i), i - 1
        else:
            i = np.clip(np.floor(p), 0, max(n - 2, 0)).astype(np.int64)
            f = p - i
            taps, first = (np.stack([1 - f, f], -1) if n > 1 else np.ones((len(p), 1))), i
        low = int(first.min())
        out = np.zeros((len(p), int(first.max()) - low + taps.shape[-1]))
        rows = np.arange(len(p))
        for t in range(taps.shape[-1]):
            out[rows, first - low + t] += taps[:, t]
        return low, out

    def on_box(self, index: Sequence[np.ndarray], matrix: np.ndarray, nodes_at: Callable[[Sequence[np.ndarray]], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(values, inside) for all i in the product of ``index``, whose node positions ``nodes_at`` gives.

        They grow as ``matrix`` i, up to rounding. Where each node axis follows one index alone, its weights are a small matrix and the box is
        contracted axis by axis, with 4 + 4 + 4 instead of 4 * 4 * 4 products for a cubic field.
        """
        support, sizes = _support(self.grid, self.kind), list(self.grid.sizes.values())
        shape = tuple(len(x) for x in index)
        own = [np.flatnonzero(np.abs(row) > 1e-14 * np.abs(matrix).max()) for row in matrix]
        apart = all(len(x) == 1 for x in own) and len({int(x[0]) for x in own}) == len(own) == len(index)
        closed = self.closed or self.kind == POSITION

        def clipped(k: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lo, hi = support[k]
            within = (p >= lo) & ((p <= hi) if closed else (p < hi))
            a, b = (lo, hi) if self.kind == BSPLINE else (0.0, sizes[k] - 1.0)
            return np.clip(p, a, b), within

        inside = np.ones(shape, bool)
        if not apart:
            p = nodes_at([g.ravel() for g in np.meshgrid(*index, indexing="ij")])
            found = [clipped(k, p[:, k]) for k in range(p.shape[1])]
            return self._sum(np.stack([at for at, _ in found], -1)), np.all([within for _, within in found], axis=0)
        box, order = self.values, [int(x[0]) for x in own]
        parts = []
        for k, j in enumerate(order):
            along = [index[j] if n == j else np.full(len(index[j]), x[0]) for n, x in enumerate(index)]
            at, within = clipped(k, nodes_at(along)[:, k])
            inside &= within.reshape([-1 if n == j else 1 for n in range(len(shape))])
            low, weights = self.axis_weights(k, at)
            parts.append(weights)
            box = np.take(box, np.arange(low, low + weights.shape[1]), axis=k)
        out = box.astype(float)
        for w in parts:  # the first axis is contracted and goes to the end, behind the components
            out = np.tensordot(out, w, axes=(0, 1))
        # now (component, node axes in order); put them in the order of the index
        out = np.moveaxis(out, 0, -1).transpose([*np.argsort(order).tolist(), len(order)])
        return out.reshape(-1, out.shape[-1]), inside.ravel()

    def masked_columns(self, cols: Sequence[Column]) -> tuple[list[Column], Column]:
        """Target coordinates and whether the point is supported; an unsupported point is returned unchanged."""
        n, field = len(self.target.axes), replace(self, exterior="identity") if self.exterior == "raise" else self
        schema = T.StructType([*[T.StructField(f"c{k}", T.DoubleType()) for k in range(n)], T.StructField("inside", T.BooleanType())])

        @F.pandas_udf(schema)
        def mapped(*parts: pd.Series) -> pd.DataFrame:
            x = np.stack([p.to_numpy(float) for p in parts], axis=-1)
            out = pd.DataFrame(field.transform_point(x), columns=[f"c{k}" for k in range(n)])
            out["inside"] = field._located(x)[2]
            return out

        result = mapped(*[c.cast("double") for c in cols])
        inside = result["inside"] if self.exterior == "raise" else F.lit(True)
        return [result[f"c{k}"] for k in range(n)], inside

    def transform_point(self, points: Any) -> np.ndarray:
        x, p, inside = self._located(points)
        value = self._sum(p)
        if self.kind != POSITION:
            value = x + value
        elif self.exterior == "identity":
            return np.where(inside[..., None], value, x)
        return np.where(inside[..., None], value, x) if self.exterior == "identity" else value

    def jacobian(self, at: Any) -> np.ndarray:
        x, p, inside = self._located(at)
        raw = self._to_index.transform_point(x)
        by_index = np.stack([self._sum(p, k) for k in range(p.shape[-1])], axis=-1)
        free = (raw == p) | (self.kind == BSPLINE)
        by_index = by_index * np.where(free, 1.0, 0.0)[..., None, :]
        out = by_index @ self._to_index.matrix
        eye = np.eye(len(self.target.axes), x.shape[-1])
        if self.kind != POSITION:
            out = out + eye
        return np.where(inside[..., None, None], out, eye) if self.exterior == "identity" else out


def _index_map(grid: Grid) -> AffineTransform:
    """Frame points to continuous node indices; the node axes must be even."""
    lattice = grid.lattice()
    from framegrid.plans.declare import ArrayCoordinates

    forward = AffineTransform.from_matrix(lattice.matrix, source=ArrayCoordinates(list(grid.dims), [None] * len(grid.dims)), target=grid.frame, translation=lattice.origin)
    return forward.inverse()


def DisplacementFieldTransform(grid: Grid, values: Any, *, target: Endpoint | None = None, exterior: str = "raise") -> FieldTransform:  # noqa: N802
    """x + u(x), multilinear in the nodes."""
    return FieldTransform(DISPLACEMENT, grid, values, target or grid.frame, exterior)


def BSplineTransform(grid: Grid, coefficients: Any, *, target: Endpoint | None = None, exterior: str = "raise", closed: bool = False) -> FieldTransform:  # noqa: N802
    """x + u(x) with cubic B-spline coefficients, which are not prefiltered."""
    return FieldTransform(BSPLINE, grid, coefficients, target or grid.frame, exterior, closed)


def PositionFieldTransform(grid: Grid, values: Any, *, target: Endpoint, exterior: str = "raise") -> FieldTransform:  # noqa: N802
    """The target point itself at each node."""
    return FieldTransform(POSITION, grid, values, target, exterior)


def field_map(points: DataFrame, nodes: DataFrame, grid: Grid, *, keys: Sequence[str], components: Sequence[str], kind: str = DISPLACEMENT,
              exterior: str = "raise", closed: bool = False, target_axes: Sequence[str] | None = None, array_nodes: int = 100_000, broadcast_nodes: int = 500_000) -> DataFrame:
    """Map a table of points through a field whose nodes are a table (pos_*, components).

    ``keys`` tell the rows of ``points`` apart. The result has keys, the target axes and ``inside``. What
    is done follows from the number of nodes, which the grid states: up to ``array_nodes`` they become one
    row of arrays that is broadcast, and a point's nodes are picked by index, without a shuffle; up to
    ``broadcast_nodes`` the nodes are broadcast to a join; beyond that the join shuffles on node positions.
    A node that a point needs and that has no row raises, whichever way is taken.
    """
    to_index, dims = _index_map(grid), grid.dims
    source = [F.col(a).cast("double") for a in grid.frame.axes]
    raw = to_index.raw_columns(source)
    support, frame = _support(grid, kind), points
    inside = F.lit(True)
    cols: dict[str, Column] = {}
    for d, p, (lo, hi) in zip(dims, raw, support, strict=True):
        upper = p <= F.lit(hi) if closed or kind == POSITION else p < F.lit(hi)
        inside = inside & (p >= F.lit(lo)) & upper
        a, b = (lo, hi) if kind == BSPLINE else (0.0, float(grid.sizes[d] - 1))
        cols[f"p_{d}"] = F.greatest(F.lit(a), F.least(p, F.lit(b)))
    if exterior == "raise":
        cols = {k: F.when(inside, c).otherwise(F.raise_error(F.lit("a point lies outside the field")).cast("double")) for k, c in cols.items()}
    frame = frame.withColumns({**cols, "inside": inside})
    taps = []
    for offsets in itertools.product(range(4 if kind == BSPLINE else 2), repeat=len(dims)):
        w, at = F.lit(1.0), []
        for d, t in zip(dims, offsets, strict=True):
            n, p = grid.sizes[d], F.col(f"p_{d}")
            if kind == BSPLINE:
                i = F.greatest(F.lit(1.0), F.least(F.floor(p).cast("double"), F.lit(float(n - 3))))
                w, i = w * basis(p - i)[t], i + F.lit(float(t - 1))
            else:
                i = F.greatest(F.lit(0.0), F.least(F.floor(p).cast("double"), F.lit(float(max(n - 2, 0)))))
                f = p - i
                w, i = w * (f if t else F.lit(1.0) - f), F.least(i + F.lit(float(t)), F.lit(float(n - 1)))
            at.append(i.cast("long").alias(f"i_{d}"))
        taps.append(F.struct(w.alias("w"), *at))
    names = target_axes or grid.frame.axes
    if grid.count() <= array_nodes and len(taps) <= UNROLLED_TAPS and min(grid.sizes.values()) > 1:
        return _unrolled(frame, nodes, grid, keys, components, kind, exterior, names)
    if grid.count() <= array_nodes:
        return _picked(frame, nodes, grid, taps, keys, components, kind, exterior, names)
    wide = frame.withColumn("tap", F.explode(F.filter(F.array(*taps), lambda t: t["w"] != 0)))
    wide = wide.select(*frame.columns, "tap.w", *[f"tap.i_{d}" for d in dims])
    right = nodes.select(*[F.col(pos(d)).alias(f"i_{d}") for d in dims], *[F.col(c).cast("double").alias(f"node_{k}") for k, c in enumerate(components)])
    joined = wide.join(F.broadcast(right) if grid.count() <= broadcast_nodes else right, [f"i_{d}" for d in dims], "left")
    node = lambda k: F.when(F.col(f"node_{k}").isNull(), F.raise_error(F.lit("the field lacks nodes")).cast("double")).otherwise(F.col(f"node_{k}"))
    sums = [F.sum(F.col("w") * node(k)).alias(f"u_{k}") for k in range(len(components))]
    places = [F.first(a).cast("double").alias(f"x_{k}") for k, a in enumerate(grid.frame.axes)]
    out = joined.groupBy(*keys).agg(*sums, *places, F.first("inside").alias("inside"))
    made = []
    for k, a in enumerate(names):
        value = F.col(f"u_{k}") if kind == POSITION else F.col(f"x_{k}") + F.col(f"u_{k}")
        if exterior == "identity":
            value = F.when(F.col("inside"), value).otherwise(F.col(f"x_{k}"))
        made.append(checked(value, "a field result").alias(a))
    return out.select(*keys, *made, "inside")


def _unrolled(frame: DataFrame, nodes: DataFrame, grid: Grid, keys: Sequence[str], components: Sequence[str], kind: str, exterior: str, names: Sequence[str]) -> DataFrame:
    """``field_map`` with the nodes in one broadcast row and the taps written out in generated code.

    The lower node and the weights along each dimension are columns, shared by all components; a tap's
    node lies a fixed number of places behind the lowest.
    """
    table, dims = _node_arrays(nodes, grid, components), list(grid.dims)
    steps = Steps(frame.join(F.broadcast(table), F.lit(True)))
    number, weights = F.lit(1), []
    for d in dims:
        n, p = grid.sizes[d], F.col(f"p_{d}")
        low, high = (1.0, n - 3.0) if kind == BSPLINE else (0.0, n - 2.0)
        i = steps.one(F.greatest(F.lit(low), F.least(F.floor(p).cast("double"), F.lit(high))))
        f = steps.one(p - i)
        weights.append(steps.keep(*(basis(f) if kind == BSPLINE else [F.lit(1.0) - f, f])))
        number = number + (i.cast("int") - (1 if kind == BSPLINE else 0)) * F.lit(int(np.prod([grid.sizes[e] for e in dims[dims.index(d) + 1 :]], dtype=np.int64)))
    first = steps.one(number)
    strides = [int(np.prod([grid.sizes[e] for e in dims[k + 1 :]], dtype=np.int64)) for k in range(len(dims))]
    taps = list(itertools.product(*[range(len(w)) for w in weights]))
    products = steps.keep(*[reduce(lambda a, b: a * b, (w[t] for w, t in zip(weights, tap, strict=True))) for tap in taps])
    places = [first + F.lit(sum(t * s for t, s in zip(tap, strides, strict=True))) for tap in taps]
    made = []
    for k, a in enumerate(names):
        total = reduce(lambda x, y: x + y, (w * F.element_at(F.col(f"nodes_{k}"), at) for w, at in zip(products, places, strict=True)))
        x = F.col(grid.frame.axes[k]).cast("double") if k < len(grid.frame.axes) else F.lit(0.0)
        value = total if kind == POSITION else x + total
        if exterior == "identity":
            value = F.when(F.col("inside"), value).otherwise(x)
        made.append(checked(value, "a field result").alias(a))
    return steps.df.select(*keys, *made, "inside")


def _node_arrays(nodes: DataFrame, grid: Grid, components: Sequence[str]) -> DataFrame:
    """One row: an array of each component in grid order; a grid with missing nodes raises."""
    number: Column = F.lit(0).cast("long")
    for d in grid.dims:
        number = number * grid.sizes[d] + F.col(pos(d))
    own = nodes.select(number.alias("n"), *[F.col(c).cast("double").alias(f"node_{k}") for k, c in enumerate(components)])
    rows = F.array_sort(F.collect_list(F.struct("n", *[f"node_{k}" for k in range(len(components))])))
    table = own.agg(rows.alias("rows"))
    sound = (F.size("rows") == grid.count()) & (F.element_at("rows", -1)["n"] == grid.count() - 1)
    whole = F.when(sound, F.col("rows")).otherwise(F.raise_error(F.lit("the field lacks nodes")).cast(table.schema["rows"].dataType))
    return table.select(*[_component(whole, k).alias(f"nodes_{k}") for k in range(len(components))])


def _picked(frame: DataFrame, nodes: DataFrame, grid: Grid, taps: list[Column], keys: Sequence[str], components: Sequence[str], kind: str, exterior: str, names: Sequence[str]) -> DataFrame:
    """``field_map`` with the nodes in one broadcast row, picked by index tap after tap."""
    table = _node_arrays(nodes, grid, components)
    placed = frame.withColumn("taps", F.array(*taps)).crossJoin(F.broadcast(table))
    made = []
    for k, a in enumerate(names):
        total = F.aggregate("taps", F.lit(0.0), _added(grid, f"nodes_{k}"))
        x = F.col(grid.frame.axes[k]).cast("double") if k < len(grid.frame.axes) else F.lit(0.0)
        value = total if kind == POSITION else x + total
        if exterior == "identity":
            value = F.when(F.col("inside"), value).otherwise(x)
        made.append(checked(value, "a field result").alias(a))
    return placed.select(*keys, *made, "inside")


def _component(rows: Column, k: int) -> Column:
    return F.transform(rows, lambda r: r[f"node_{k}"])


def _added(grid: Grid, column: str):
    """One more tap: its weight times the node at its index."""

    def step(total: Column, tap: Column) -> Column:
        number: Column = F.lit(0).cast("long")
        for d in grid.dims:
            number = number * grid.sizes[d] + tap[f"i_{d}"]
        return total + tap["w"] * F.element_at(F.col(column), (number + 1).cast("int"))

    return step


def sample_displacement_field(transform: Any, grid: Grid, *, exterior: str = "raise") -> FieldTransform:
    """The displacements of any map at a grid's samples, as a field."""
    if len(transform.target.axes) != len(grid.frame.axes):
        raise ValueError("a displacement keeps the number of axes")
    p = grid.points()
    return DisplacementFieldTransform(grid, transform.transform_point(p) - p, target=transform.target, exterior=exterior)


def sample_displacement_table(spark: Any, transform: Any, grid: Grid) -> DataFrame:
    """As ``sample_displacement_field`` for a grid of any size: a table (pos_*, u_<axis>)."""
    from framegrid.functions.transforms import columns_of

    df = grid.to_df(spark, points=True)
    out = columns_of(transform, [F.col(a) for a in grid.frame.axes])
    return df.select(*[pos(d) for d in grid.dims], *[(c - F.col(a)).alias(f"u_{a}") for c, a in zip(out, grid.frame.axes, strict=True)])
