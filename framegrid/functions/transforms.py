"""Point maps: affine, composite, chart transitions, declared inverses.

Every built-in map is given twice from one formula: as Spark columns, so that it stays in generated
code, and on NumPy arrays for the driver's few points. A user's own map needs the NumPy form alone and
runs through an Arrow-batched function.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegrid.plans.declare import (
    CARTESIAN,
    HEIGHT,
    INVERSE_CONDITION_LIMIT,
    LATITUDE,
    LONGITUDE,
    RADIUS,
    SPHERICAL,
    CoordinateSystem,
    Endpoint,
    ReferenceFrame,
    full_turn,
)


@runtime_checkable
class SupportsPoints(Protocol):
    """The least a point map offers: its endpoints, and points of shape (..., source axes) to (..., target axes)."""

    @property
    def source(self) -> Endpoint: ...

    @property
    def target(self) -> Endpoint: ...

    def transform_point(self, points: Any) -> np.ndarray: ...


def _points(points: Any, n: int) -> np.ndarray:
    out = np.asarray(points)
    if out.dtype.kind not in "iuf":
        raise TypeError("points must be real numbers")
    out = out.astype(float)
    if out.ndim < 1 or out.shape[-1] != n:
        raise ValueError(f"points need {n} coordinates, not {out.shape[-1:]}")
    return out


def let(value: Column, use: Any) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used.

    For single expressions; ``transform_frame`` keeps the steps of a map as columns instead, which stay in
    generated code.
    """
    return F.transform(F.array(value), use)[0]


#: Columns for the steps of a map are named after this and dropped with its result.
STEP_PREFIX = "framegrid_step_"


class Steps:
    """A table that grows by named steps: each value is computed once, in generated code.

    Every step is a projection of its own. The optimizer merges projections only where no value of
    weight would be computed twice.
    """

    def __init__(self, df: DataFrame):
        self.df, self.n = df, sum(c.startswith(STEP_PREFIX) for c in df.columns)

    def keep(self, *values: Column) -> list[Column]:
        names = [f"{STEP_PREFIX}{self.n + k}" for k in range(len(values))]
        self.df, self.n = self.df.withColumns(dict(zip(names, values, strict=True))), self.n + len(values)
        return [F.col(x) for x in names]

    def one(self, value: Column) -> Column:
        return self.keep(value)[0]


def checked(value: Column, what: str) -> Column:
    """``value``; a row where it is not finite raises when it is computed."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit(f"{what} is not finite")).cast("double")).otherwise(value)


def equilibrated_inverse(matrix: Any) -> np.ndarray:
    """The inverse; refuses zero rows or columns and, after scaling both to unit norm, a condition over the limit."""
    m = np.asarray(matrix, float)
    if m.ndim != 2 or m.shape[0] != m.shape[1]:
        raise ValueError("only a square matrix has an inverse")
    peak = np.abs(m).max(axis=1, initial=0)
    if not peak.all():
        raise ValueError("matrix has a zero row")
    rows = np.linalg.norm(m / peak[:, None], axis=1) * peak
    scaled = m / rows[:, None]
    cols = np.linalg.norm(scaled, axis=0)
    if not cols.all():
        raise ValueError("matrix has a zero column")
    scaled = scaled / cols[None, :]
    if np.linalg.cond(scaled) > INVERSE_CONDITION_LIMIT:
        raise ValueError("matrix is too ill-conditioned to invert")
    return np.linalg.inv(scaled) / rows[None, :] / cols[:, None]


@dataclass(frozen=True, eq=False)
class AffineTransform:
    """x -> M x + t between two endpoints."""

    source: Endpoint
    target: Endpoint
    matrix: np.ndarray
    translation: np.ndarray

    def __init__(self, *, source: Endpoint, target: Endpoint, target_axes: Sequence[str], basis_vectors: Mapping[str, Sequence[float]], translation: Sequence[float]):
        if tuple(target_axes) != tuple(target.axes):
            raise ValueError(f"target axes {tuple(target_axes)} are not those of the target, {target.axes}")
        if set(basis_vectors) != set(source.axes):
            raise ValueError(f"basis vectors are for {sorted(basis_vectors)}, the source has {sorted(source.axes)}")
        columns = [np.asarray(basis_vectors[a], float) for a in source.axes]
        if any(c.shape != (len(target.axes),) for c in columns):
            raise ValueError("a basis vector has one component for each target axis")
        self._fill(source, target, np.stack(columns, axis=1) if columns else np.zeros((len(target.axes), 0)), translation)

    @classmethod
    def from_matrix(cls, matrix: Any, *, source: Endpoint, target: Endpoint, source_axes: Sequence[str] | None = None,
                    target_axes: Sequence[str] | None = None, translation: Any = None) -> AffineTransform:
        """From a linear matrix with ``translation``, or from a homogeneous one without."""
        for given, own in ((source_axes, source.axes), (target_axes, target.axes)):
            if given is not None and tuple(given) != tuple(own):
                raise ValueError(f"axes {tuple(given)} are not those of the endpoint, {own}")
        m, (n, k) = np.asarray(matrix, float), (len(target.axes), len(source.axes))
        if m.shape == (n + 1, k + 1) and translation is None:
            if not np.array_equal(m[-1], [0.0] * k + [1.0]):
                raise ValueError("the last row of a homogeneous matrix is 0 ... 0 1")
            m, translation = m[:-1, :-1], m[:-1, -1]
        out = cls.__new__(cls)
        out._fill(source, target, m, np.zeros(n) if translation is None else translation)
        return out

    def _fill(self, source: Endpoint, target: Endpoint, matrix: Any, translation: Any) -> None:
        m, t = np.array(matrix, float) + 0.0, np.array(translation, float) + 0.0
        if m.shape != (len(target.axes), len(source.axes)) or t.shape != (len(target.axes),):
            raise ValueError("the matrix does not fit its endpoints")
        if not (np.isfinite(m).all() and np.isfinite(t).all()):
            raise ValueError("a transform is finite")
        m.setflags(write=False)
        t.setflags(write=False)
        for k, v in (("source", source), ("target", target), ("matrix", m), ("translation", t)):
            object.__setattr__(self, k, v)

    def __eq__(self, other: object) -> bool:
        return (
            type(other) is type(self) and self.source == other.source and self.target == other.target
            and np.array_equal(self.matrix, other.matrix) and np.array_equal(self.translation, other.translation)
        )

    def __hash__(self) -> int:
        return hash((self.source, self.target, self.matrix.tobytes(), self.translation.tobytes()))

    def transform_point(self, points: Any) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            out = _points(points, len(self.source.axes)) @ self.matrix.T + self.translation
        if not np.isfinite(out).all():
            raise ValueError("an affine result is not finite")
        return out

    def columns(self, cols: Sequence[Column]) -> list[Column]:
        return [checked(x, "an affine result") for x in self.raw_columns(cols)]

    def raw_columns(self, cols: Sequence[Column]) -> list[Column]:
        """The columns without the check that they are finite; zero coefficients are left out."""
        out = []
        for row, t in zip(self.matrix, self.translation, strict=True):
            terms = [c if m == 1 else c * F.lit(float(m)) for m, c in zip(row, cols, strict=True) if m != 0]
            if t != 0 or not terms:
                terms.append(F.lit(float(t)))
            out.append(reduce(lambda a, b: a + b, terms).cast("double"))
        return out

    def jacobian(self, at: Any = None) -> np.ndarray:
        if at is None:
            return self.matrix
        p = _points(at, len(self.source.axes))
        return np.broadcast_to(self.matrix, (*p.shape[:-1], *self.matrix.shape))

    def jacobian_columns(self, cols: Sequence[Column]) -> list[list[Column]]:
        return [[F.lit(float(x)) for x in row] for row in self.matrix]

    def inverse(self) -> AffineTransform:
        inv = equilibrated_inverse(self.matrix)
        return AffineTransform.from_matrix(inv, source=self.target, target=self.source, translation=-(inv @ self.translation))

    def with_endpoints(self, *, source: Endpoint | None = None, target: Endpoint | None = None) -> AffineTransform:
        return AffineTransform.from_matrix(self.matrix, source=source or self.source, target=target or self.target, translation=self.translation)

    def homogeneous(self) -> np.ndarray:
        out = np.zeros((self.matrix.shape[0] + 1, self.matrix.shape[1] + 1))
        out[:-1, :-1], out[:-1, -1], out[-1, -1] = self.matrix, self.translation, 1
        return out


def identity(endpoint: Endpoint, target: Endpoint | None = None) -> AffineTransform:
    return AffineTransform.from_matrix(np.eye(len(endpoint.axes)), source=endpoint, target=target or endpoint, translation=np.zeros(len(endpoint.axes)))


def columns_of(transform: Any, cols: Sequence[Column]) -> list[Column]:
    """The target coordinates as columns: Catalyst expressions for a built-in map, else one Arrow function."""
    if hasattr(transform, "columns"):
        return transform.columns(cols)
    n = len(transform.target.axes)
    schema = T.StructType([T.StructField(f"c{k}", T.DoubleType()) for k in range(n)])

    @F.pandas_udf(schema)
    def mapped(*parts: pd.Series) -> pd.DataFrame:
        out = np.asarray(transform.transform_point(np.stack([p.to_numpy(float) for p in parts], axis=-1)), float)
        if out.shape != (len(parts[0]), n) or not np.isfinite(out).all():
            raise ValueError("a transform must return finite points, one for each given")
        return pd.DataFrame(out, columns=[f"c{k}" for k in range(n)])

    result = mapped(*[c.cast("double") for c in cols])
    return [result[f"c{k}"] for k in range(n)]


def stepped_columns_of(transform: Any, steps: Steps, cols: Sequence[Column]) -> list[Column]:
    """As ``columns_of``, with the map's intermediate values and its result as columns of a growing table."""
    if hasattr(transform, "stepped"):
        return transform.stepped(steps, cols)
    return steps.keep(*columns_of(transform, cols))


def masked_columns_of(transform: Any, cols: Sequence[Column]) -> tuple[list[Column], Column]:
    """As ``columns_of``, with a column that tells where the map holds: a field that raises outside its
    support is not asked there, and neither is any member behind it."""
    members = transform.transforms if isinstance(transform, CompositeTransform) else (transform,)
    cols, valid = list(cols), F.lit(True)
    for t in members:
        if hasattr(t, "masked_columns"):
            cols, inside = t.masked_columns(cols)
            valid = valid & inside
        else:
            cols = columns_of(t, cols)
    return cols, valid


def jacobian_columns_of(transform: Any, cols: Sequence[Column]) -> list[list[Column]]:
    """Rows of the Jacobian as columns; a map without the column form is called in Arrow batches."""
    if hasattr(transform, "jacobian_columns"):
        return transform.jacobian_columns(cols)
    if not hasattr(transform, "jacobian"):
        raise TypeError("this transform has no Jacobian")
    n, k = len(transform.target.axes), len(transform.source.axes)

    @F.pandas_udf("array<double>")
    def flat(*parts: pd.Series) -> pd.Series:
        out = np.asarray(transform.jacobian(np.stack([p.to_numpy(float) for p in parts], axis=-1)), float)
        return pd.Series(list(out.reshape(len(parts[0]), n * k)))

    result = flat(*[c.cast("double") for c in cols])
    return [[result[i * k + j] for j in range(k)] for i in range(n)]


@dataclass(frozen=True)
class CompositeTransform:
    """Members applied from first to last."""

    transforms: tuple[Any, ...]

    def __post_init__(self) -> None:
        if len(self.transforms) < 2:
            raise ValueError("a composite needs two members")
        for a, b in zip(self.transforms, self.transforms[1:], strict=False):
            if a.target != b.source:
                raise ValueError("a member's target is not the next one's source")

    @property
    def source(self) -> Endpoint:
        return self.transforms[0].source

    @property
    def target(self) -> Endpoint:
        return self.transforms[-1].target

    def transform_point(self, points: Any) -> np.ndarray:
        for t in self.transforms:
            points = t.transform_point(points)
        return points

    def columns(self, cols: Sequence[Column]) -> list[Column]:
        for t in self.transforms:
            cols = columns_of(t, cols)
        return list(cols)

    def stepped(self, steps: Steps, cols: Sequence[Column]) -> list[Column]:
        for t in self.transforms:
            cols = stepped_columns_of(t, steps, cols)
        return list(cols)

    def jacobian(self, at: Any) -> np.ndarray:
        out = None
        for t in self.transforms:
            j = t.jacobian(at)
            out = j if out is None else j @ out
            at = t.transform_point(at)
        return out

    def jacobian_columns(self, cols: Sequence[Column]) -> list[list[Column]]:
        out = None
        for t in self.transforms:
            j = jacobian_columns_of(t, cols)
            out = j if out is None else matmul_columns(j, out)
            cols = columns_of(t, cols)
        return out

    def inverse(self) -> Any:
        return compose(*[t.inverse() for t in reversed(self.transforms)])

    def declared_inverse(self) -> Any:
        return compose(*[exact_or_declared_inverse(t) for t in reversed(self.transforms)])


def matmul_columns(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[reduce(lambda x, y: x + y, (a[i][k] * b[k][j] for k in range(len(b)))) for j in range(len(b[0]))] for i in range(len(a))]


def compose(*transforms: Any) -> Any:
    """One map for a chain; neighbouring affine members are multiplied here, Catalyst would not reassociate them."""
    flat = [m for t in transforms for m in (t.transforms if isinstance(t, CompositeTransform) else (t,))]
    if not flat:
        raise ValueError("nothing to compose")
    out = [flat[0]]
    for t in flat[1:]:
        last = out[-1]
        if last.target != t.source:
            raise ValueError("a member's target is not the next one's source")
        if type(last) is AffineTransform and type(t) is AffineTransform:
            out[-1] = AffineTransform.from_matrix(
                t.matrix @ last.matrix, source=last.source, target=t.target, translation=t.matrix @ last.translation + t.translation
            )
        else:
            out.append(t)
    return out[0] if len(out) == 1 else CompositeTransform(tuple(out))


@dataclass(frozen=True)
class DeclaredInversePair:
    """Two maps that a producer declares to be inverse to each other; nothing verifies it."""

    forward_map: Any
    backward_map: Any

    def __post_init__(self) -> None:
        if self.forward_map.source != self.backward_map.target or self.forward_map.target != self.backward_map.source:
            raise ValueError("the two directions do not join the same endpoints")

    @property
    def forward(self) -> PairedTransform:
        return PairedTransform(self, True)

    @property
    def backward(self) -> PairedTransform:
        return PairedTransform(self, False)


@dataclass(frozen=True)
class PairedTransform:
    """One direction of a declared pair. It has no exact ``inverse``, only a ``declared_inverse``."""

    pair: DeclaredInversePair
    is_forward: bool

    @property
    def _map(self) -> Any:
        return self.pair.forward_map if self.is_forward else self.pair.backward_map

    @property
    def source(self) -> Endpoint:
        return self._map.source

    @property
    def target(self) -> Endpoint:
        return self._map.target

    def transform_point(self, points: Any) -> np.ndarray:
        return self._map.transform_point(points)

    def columns(self, cols: Sequence[Column]) -> list[Column]:
        return columns_of(self._map, cols)

    def jacobian(self, at: Any) -> np.ndarray:
        return self._map.jacobian(at)

    def jacobian_columns(self, cols: Sequence[Column]) -> list[list[Column]]:
        return jacobian_columns_of(self._map, cols)

    def declared_inverse(self) -> PairedTransform:
        return PairedTransform(self.pair, not self.is_forward)


def exact_or_declared_inverse(transform: Any) -> Any:
    if isinstance(transform, CompositeTransform):
        return transform.declared_inverse()
    if hasattr(transform, "declared_inverse"):
        return transform.declared_inverse()
    if hasattr(transform, "inverse"):
        return transform.inverse()
    raise TypeError("this transform has neither an exact nor a declared inverse")


def transform_named(transform: Any, values: Mapping[str, Any]) -> dict[str, np.ndarray]:
    """Evaluate by axis name; values broadcast against each other."""
    if set(values) != set(transform.source.axes):
        raise ValueError(f"values are for {sorted(values)}, the source has {sorted(transform.source.axes)}")
    given = np.broadcast_arrays(*[np.asarray(values[a]) for a in transform.source.axes])
    out = transform.transform_point(np.stack([g.astype(float) for g in given], axis=-1))
    return {a: out[..., k] for k, a in enumerate(transform.target.axes)}


def transform_frame(df: DataFrame, transform: Any, columns: Mapping[str, str] | None = None, prefix: str = "") -> DataFrame:
    """``df`` with the target axes as columns, from the source axes' columns by name."""
    names = columns or {a: a for a in transform.source.axes}
    cols = [F.col(names[a]).cast("double") for a in transform.source.axes]
    if not hasattr(transform, "stepped"):
        return df.withColumns({f"{prefix}{a}": c for a, c in zip(transform.target.axes, columns_of(transform, cols), strict=True)})
    steps = Steps(df)
    out = transform.stepped(steps, cols)
    made = steps.df.withColumns({f"{prefix}{a}": c for a, c in zip(transform.target.axes, out, strict=True)})
    return made.drop(*[c for c in made.columns if c.startswith(STEP_PREFIX) and c not in df.columns])


def coordinate_system_change(source: ReferenceFrame, target: ReferenceFrame) -> AffineTransform:
    """The signed permutation between two systems of one frame; nothing is rescaled."""
    if not source.is_equivalent_frame(target):
        raise ValueError(f"{source} and {target} are not one space; relate them with an explicit transform")
    a, b = source.coordinate_system, target.coordinate_system
    if a.representation != b.representation or len(a.axes) != len(b.axes):
        raise ValueError("the systems differ in representation or number of axes")
    m = np.zeros((len(b.axes),) * 2)

    def same(i: int, j: int) -> None:
        if a.units[i] != b.units[j] or a.axis_types[i] != b.axis_types[j]:
            raise ValueError(f"axes {a.axes[i]!r} and {b.axes[j]!r} differ in unit or type")

    if a.representation != CARTESIAN:
        if sorted(map(str, a.axis_roles)) != sorted(map(str, b.axis_roles)):
            raise ValueError("the systems differ in their axis roles")
        for j, role in enumerate(b.axis_roles):
            i = a.axis_roles.index(role) if role is not None else j
            if role is None and (a.axis_roles[j] is not None or a.axes[j] != b.axes[j]):
                raise ValueError("axes without a role must be the same at the same place")
            same(i, j)
            m[j, i] = 1
    else:
        if a.vocabulary != b.vocabulary:
            raise ValueError("the systems use different vocabularies")
        for j, token in enumerate(b.orientation):
            if token is None:
                if a.orientation[j] is not None or a.axes[j] != b.axes[j]:
                    raise ValueError("unoriented axes must be the same at the same place")
                same(j, j)
                m[j, j] = 1
                continue
            pair = b.vocabulary.pair(token)
            found = [i for i, t in enumerate(a.orientation) if t in pair]
            if not found:
                raise ValueError(f"no source axis lies along {token!r}")
            same(found[0], j)
            m[j, found[0]] = 1 if a.orientation[found[0]] == token else -1
    return AffineTransform.from_matrix(m, source=source, target=target, translation=np.zeros(len(b.axes)))


# Charts ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Chart:
    source: Endpoint
    target: Endpoint

    def _angular(self) -> CoordinateSystem:
        end = self.source if self._forward else self.target
        return end.coordinate_system

    def __post_init__(self) -> None:
        a, c = (self.source, self.target) if self._forward else (self.target, self.source)
        for end in (a, c):
            if not isinstance(end, ReferenceFrame):
                raise TypeError("a chart joins two reference frames")
        if a.coordinate_system.representation != self._kind or c.coordinate_system.representation != CARTESIAN:
            raise ValueError(f"a {self._kind} and a Cartesian frame are needed")
        if len(a.axes) != 3 or len(c.axes) != 3 or self._third not in a.coordinate_system.axis_roles:
            raise ValueError("a chart has three axes on both sides")
        if {c.units[0]} != set(c.units) or a.units[a.coordinate_system.axis_of(self._third)] != c.units[0]:
            raise ValueError("lengths of a chart share one unit")

    def _order(self) -> tuple[int, int, int]:
        s = self._angular()
        return s.axis_of(LONGITUDE), s.axis_of(LATITUDE), s.axis_of(self._third)

    def _scale(self) -> tuple[float, float]:
        s, (i, j, _) = self._angular(), self._order()
        return 2 * math.pi / full_turn(s.units[i]), 2 * math.pi / full_turn(s.units[j])


class _Forward(_Chart):
    _forward = True

    def columns(self, cols: Sequence[Column]) -> list[Column]:
        return self._forward_columns(cols, lambda c: c)

    def _forward_columns(self, cols: Sequence[Column], once: Any) -> list[Column]:
        """The map's columns; ``once`` may make a step of a value that is used several times."""
        (i, j, k), (su, sv) = self._order(), self._scale()
        lon, lat, third = once(cols[i] * F.lit(su)), cols[j], cols[k]
        quarter = full_turn(self._angular().units[j]) / 4
        pole = F.abs(lat) >= F.lit(quarter)
        off = F.abs(lat) > F.lit(quarter * (1 + 1e-12))
        cos = once(F.when(pole, F.lit(0.0)).otherwise(F.cos(lat * F.lit(sv))))
        sin = F.when(pole, F.signum(lat)).otherwise(F.sin(lat * F.lit(sv)))
        sin = once(F.when(off, F.raise_error(F.lit("a latitude lies beyond the pole")).cast("double")).otherwise(sin))
        a, b2 = self._ellipse()
        n = once(F.lit(a) / F.sqrt(cos * cos + F.lit(b2) * sin * sin))
        flat = once((n + third) * cos)
        x, y, z = once(flat * F.cos(lon)), once(flat * F.sin(lon)), once((n * F.lit(b2) + third) * sin)
        low = third <= -n * F.lit(b2) if a else third < F.lit(0.0)
        if a and b2 < 1:
            low = low | (F.sqrt(x * x + y * y + z * z) <= F.lit((1 - b2) * a / math.sqrt(b2)))
        z = F.when(low, F.raise_error(F.lit("a point lies below what the chart can invert")).cast("double")).otherwise(z)
        return [x, y, z]

    def stepped(self, steps: Steps, cols: Sequence[Column]) -> list[Column]:
        return self._forward_columns(cols, steps.one)

    def transform_point(self, points: Any) -> np.ndarray:
        p = _points(points, 3)
        (i, j, k), (su, sv) = self._order(), self._scale()
        lon, lat, third = p[..., i] * su, p[..., j], p[..., k]
        quarter = full_turn(self._angular().units[j]) / 4
        if (np.abs(lat) > quarter * (1 + 1e-12)).any():
            raise ValueError("a latitude lies beyond the pole")
        pole = np.abs(lat) >= quarter
        cos, sin = np.where(pole, 0.0, np.cos(lat * sv)), np.where(pole, np.sign(lat), np.sin(lat * sv))
        a, b2 = self._ellipse()
        n = a / np.sqrt(cos**2 + b2 * sin**2)
        flat = (n + third) * cos
        out = np.stack([flat * np.cos(lon), flat * np.sin(lon), (n * b2 + third) * sin], axis=-1)
        low = third <= -n * b2 if a else third < 0
        if a and b2 < 1:
            low = low | (np.linalg.norm(out, axis=-1) <= (1 - b2) * a / math.sqrt(b2))
        if np.any(low) or not np.isfinite(out).all():
            raise ValueError("a point lies below what the chart can invert")
        return out

    def jacobian(self, at: Any) -> np.ndarray:
        p = _points(at, 3)
        (i, j, k), (su, sv) = self._order(), self._scale()
        lon, lat, h = p[..., i] * su, p[..., j] * sv, p[..., k]
        a, b2 = self._ellipse()
        sl, cl, sp, cp = np.sin(lon), np.cos(lon), np.sin(lat), np.cos(lat)
        w = np.sqrt(cp**2 + b2 * sp**2)
        n, m = a / w, a * b2 / w**3
        out = np.zeros((*p.shape[:-1], 3, 3))
        out[..., :, i] = np.stack([-(n + h) * cp * sl, (n + h) * cp * cl, np.zeros_like(lon)], -1) * su
        out[..., :, j] = np.stack([-(m + h) * sp * cl, -(m + h) * sp * sl, (m + h) * cp], -1) * sv
        out[..., :, k] = np.stack([cp * cl, cp * sl, sp], -1)
        return out

    def jacobian_columns(self, cols: Sequence[Column]) -> list[list[Column]]:
        (i, j, k), (su, sv) = self._order(), self._scale()
        lon, lat, h = cols[i] * F.lit(su), cols[j] * F.lit(sv), cols[k]
        a, b2 = self._ellipse()
        sl, cl, sp, cp = F.sin(lon), F.cos(lon), F.sin(lat), F.cos(lat)
        w = F.sqrt(cp * cp + F.lit(b2) * sp * sp)
        n, m = F.lit(a) / w, F.lit(a * b2) / (w * w * w)
        by = {
            i: [-(n + h) * cp * sl * F.lit(su), (n + h) * cp * cl * F.lit(su), F.lit(0.0)],
            j: [-(m + h) * sp * cl * F.lit(sv), -(m + h) * sp * sl * F.lit(sv), (m + h) * cp * F.lit(sv)],
            k: [cp * cl, cp * sl, sp],
        }
        return [[by[c][r] for c in range(3)] for r in range(3)]

    def local_frame(self, at: Any) -> np.ndarray:
        """Unit vectors east, north and up at each point, as rows."""
        p = _points(at, 3)
        (i, j, _), (su, sv) = self._order(), self._scale()
        lon, lat = p[..., i] * su, p[..., j] * sv
        return enu_rows(np.sin(lon), np.cos(lon), np.sin(lat), np.cos(lat))


def enu_rows(sl, cl, sp, cp) -> np.ndarray:
    zero = np.zeros_like(sl)
    return np.stack([np.stack([-sl, cl, zero], -1), np.stack([-sp * cl, -sp * sl, cp], -1), np.stack([cp * cl, cp * sl, sp], -1)], -2)


class _Backward(_Chart):
    _forward = False

    def _start(self) -> float:
        return self.longitude_start

    def columns(self, cols: Sequence[Column]) -> list[Column]:
        x, y, z = cols
        lon, lat, third = self._solve_columns(x, y, z)
        return self._placed(lon, lat, third, F.pmod, F.lit)

    def transform_point(self, points: Any) -> np.ndarray:
        p = _points(points, 3)
        lon, lat, third = self._solve(p[..., 0], p[..., 1], p[..., 2])
        return np.stack(self._placed(lon, lat, third, np.remainder, float), axis=-1)

    def _placed(self, lon, lat, third, mod, lit):
        (i, j, k), (su, sv), s = self._order(), self._scale(), self._angular()
        turn, start = full_turn(s.units[i]), self._start()
        out = [None] * 3
        out[i] = mod(lon / lit(su) - lit(start), lit(turn)) + lit(start)
        out[j], out[k] = lat / lit(sv), third
        return out


@dataclass(frozen=True)
class SphericalToCartesian(_Forward):
    _kind, _third = SPHERICAL, RADIUS

    def _ellipse(self) -> tuple[float, float]:
        return 0.0, 1.0

    def inverse(self) -> CartesianToSpherical:
        return CartesianToSpherical(self.target, self.source)


@dataclass(frozen=True)
class CartesianToSpherical(_Backward):
    """Longitudes lie in [longitude_start, longitude_start + one turn)."""

    longitude_start: float = 0.0
    _kind, _third = SPHERICAL, RADIUS

    def _solve_columns(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        flat = F.hypot(x, y)
        return F.atan2(y, x), F.atan2(z, flat), F.hypot(flat, z)

    def _solve(self, x, y, z):
        flat = np.hypot(x, y)
        return np.arctan2(y, x), np.arctan2(z, flat), np.hypot(flat, z)

    def inverse(self) -> SphericalToCartesian:
        return SphericalToCartesian(self.target, self.source)


@dataclass(frozen=True)
class GeodeticToCartesian(_Forward):
    semi_major: float = 6378137.0
    inverse_flattening: float = 298.257223563
    _kind, _third = "geodetic", HEIGHT

    def _ellipse(self) -> tuple[float, float]:
        f = 1 / self.inverse_flattening if self.inverse_flattening else 0.0
        return self.semi_major, (1 - f) ** 2

    def inverse(self) -> CartesianToGeodetic:
        return CartesianToGeodetic(self.target, self.source, semi_major=self.semi_major, inverse_flattening=self.inverse_flattening)


@dataclass(frozen=True)
class CartesianToGeodetic(_Backward):
    """The closed solution of the quartic for points outside the evolute; longitudes as in CartesianToSpherical."""

    longitude_start: float = 0.0
    semi_major: float = 6378137.0
    inverse_flattening: float = 298.257223563
    _kind, _third = "geodetic", HEIGHT

    def _squared(self) -> float:
        f = 1 / self.inverse_flattening if self.inverse_flattening else 0.0
        return 1 - (1 - f) ** 2

    def _solve_columns(self, x: Column, y: Column, z: Column):
        e2 = F.lit(self._squared())
        flat = F.hypot(x, y)
        p, q = (flat / self.semi_major) ** 2, (z / self.semi_major) ** 2 * (1 - self._squared())
        k = let(F.struct(p.alias("p"), q.alias("q")), lambda g: let(self._quartic(g["p"], g["q"], F.cbrt, F.sqrt, let), lambda u: let(F.sqrt(u * u + self._squared() ** 2 * g["q"]), lambda v: let(e2 * (u + v - g["q"]) / (2 * v), lambda w: (u + v) / (F.sqrt(w * w + u + v) + w)))))
        solved = let(k, lambda k: let(k * flat / (k + e2), lambda d: let(F.hypot(d, z), lambda far: F.struct((2 * F.atan2(z, far + d)).alias("lat"), ((k + e2 - 1) / k * far).alias("h")))))
        return F.atan2(y, x), solved["lat"], solved["h"]

    def stepped(self, steps: Steps, cols: Sequence[Column]) -> list[Column]:
        x, y, z = steps.keep(*cols)
        e2, a = self._squared(), self.semi_major
        flat = steps.one(F.hypot(x, y))
        p, q = steps.keep((flat / a) ** 2, (z / a) ** 2 * (1 - e2))
        u = steps.one(self._quartic(p, q, F.cbrt, F.sqrt, lambda value, use: use(steps.one(value))))
        v = steps.one(F.sqrt(u * u + e2 * e2 * q))
        w = steps.one(F.lit(e2) * (u + v - q) / (v * 2))
        k = steps.one((u + v) / (F.sqrt(w * w + u + v) + w))
        d = steps.one(k * flat / (k + e2))
        far = steps.one(F.hypot(d, z))
        return self._placed(F.atan2(y, x), 2 * F.atan2(z, far + d), (k + e2 - 1) / k * far, F.pmod, F.lit)

    def _quartic(self, p, q, cbrt, sqrt, bind):
        """The real root of the resolvent, from the squared scaled distances from the axis and the equator."""
        e4 = self._squared() ** 2
        r = (p + q - e4) / 6.0

        def root(r):
            return bind(e4 * p * q / (4.0 * r * r * r), lambda s: bind(cbrt(1.0 + s + sqrt(s * (2.0 + s))), lambda t: r * (1.0 + t + 1.0 / t)))

        return bind(r, root)

    def _solve(self, x, y, z):
        e2, a = self._squared(), self.semi_major
        flat = np.hypot(x, y)
        p, q = (flat / a) ** 2, (z / a) ** 2 * (1 - e2)
        u = self._quartic(p, q, np.cbrt, np.sqrt, lambda value, use: use(value))
        v = np.sqrt(u * u + e2 * e2 * q)
        w = e2 * (u + v - q) / (2 * v)
        k = (u + v) / (np.sqrt(w * w + u + v) + w)
        d = k * flat / (k + e2)
        far = np.hypot(d, z)
        return np.arctan2(y, x), 2 * np.arctan2(z, far + d), (k + e2 - 1) / k * far

    def inverse(self) -> GeodeticToCartesian:
        return GeodeticToCartesian(self.target, self.source, semi_major=self.semi_major, inverse_flattening=self.inverse_flattening)
