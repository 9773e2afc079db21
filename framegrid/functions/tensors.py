"""Tensor components: how they respond to a change of basis, and packed symmetric storage."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CONTRA, CO = "contravariant", "covariant"
ORTHOGONALITY_TOLERANCE = 1e-6
SYMMETRY_TOLERANCE = 1e-6


@dataclass(frozen=True)
class TensorType:
    """Variance of each slot, behaviour under reflection (``odd``), and density weight."""

    variance: tuple[str, ...] = ()
    odd: bool = False
    weight: float = 0.0
    symmetric: bool = False
    orthogonal_only: bool = False

    def __post_init__(self) -> None:
        if any(v not in (CONTRA, CO) for v in self.variance):
            raise ValueError("a slot is contravariant or covariant")
        if not math.isfinite(self.weight):
            raise ValueError("a density weight is finite")
        if self.symmetric and (len(self.variance) != 2 or len(set(self.variance)) != 1):
            raise ValueError("symmetry needs two slots of one variance")

    @property
    def order(self) -> int:
        return len(self.variance)


SCALAR = TensorType()
PSEUDOSCALAR = TensorType(odd=True)
VECTOR = TensorType((CONTRA,))
COVECTOR = TensorType((CO,))
SECOND_ORDER_CONTRAVARIANT_TENSOR = TensorType((CONTRA, CONTRA))
SYMMETRIC_SECOND_ORDER_CONTRAVARIANT_TENSOR = TensorType((CONTRA, CONTRA), symmetric=True)
SYMMETRIC_SECOND_ORDER_COVARIANT_TENSOR = TensorType((CO, CO), symmetric=True)
CROSS_PRODUCT_PSEUDOVECTOR = TensorType((CO,), odd=True, weight=1.0)
TWO_FORM_DUAL_PSEUDOVECTOR = TensorType((CONTRA,), odd=True, weight=-1.0)
ORTHOGONAL_PSEUDOVECTOR = TensorType((CONTRA,), odd=True, orthogonal_only=True)


def _check_map(j: np.ndarray, kind: TensorType) -> None:
    if kind.orthogonal_only and not np.allclose(j @ np.swapaxes(j, -1, -2), np.eye(j.shape[-1]), atol=ORTHOGONALITY_TOLERANCE):
        raise ValueError("this tensor type changes under orthogonal maps only")


def transform_tensor_components(values: Any, linear_map: Any, kind: TensorType) -> np.ndarray:
    """sign(det J)^odd |det J|^weight and one factor J or J^-T for each slot; components are the last axes."""
    v, j = np.asarray(values), np.asarray(linear_map, float)
    if v.dtype.kind == "b":
        raise TypeError("tensor components are numbers")
    n = j.shape[-1]
    if kind.order and v.shape[-kind.order :] != (n,) * kind.order:
        raise ValueError(f"components need {(n,) * kind.order} as their last sizes")
    _check_map(j, kind)
    inv = np.swapaxes(np.linalg.inv(j), -1, -2) if CO in kind.variance else None
    out = v.astype(np.result_type(v.dtype, float))
    for k, slot in enumerate(kind.variance):
        m = j if slot == CONTRA else inv
        at = out.ndim - kind.order + k
        out = np.moveaxis(np.einsum("...ij,...j->...i", m if m.ndim == 2 else m.reshape(*m.shape[:-2], *(1,) * (kind.order - 1), *m.shape[-2:]), np.moveaxis(out, at, -1)), -1, at)
    sign, log = np.linalg.slogdet(j)
    factor = (sign if kind.odd else np.abs(sign)) * (np.exp(kind.weight * log) if kind.weight else 1.0)
    return out * np.reshape(factor, np.shape(factor) + (1,) * kind.order)


def _dot(row: Sequence[Column | float], parts: Sequence[Column]) -> Column:
    terms = [c * (F.lit(float(m)) if isinstance(m, int | float | np.floating) else m) for m, c in zip(row, parts, strict=True)]
    return reduce(lambda a, b: a + b, terms)


def det_columns(j: Sequence[Sequence[Column]]) -> Column:
    """The determinant of a matrix of columns, up to 3 x 3."""
    n = len(j)
    if n == 1:
        return j[0][0]
    if n == 2:
        return j[0][0] * j[1][1] - j[0][1] * j[1][0]
    if n == 3:
        return (
            j[0][0] * (j[1][1] * j[2][2] - j[1][2] * j[2][1])
            - j[0][1] * (j[1][0] * j[2][2] - j[1][2] * j[2][0])
            + j[0][2] * (j[1][0] * j[2][1] - j[1][1] * j[2][0])
        )
    raise ValueError("per-row determinants go up to 3 x 3")


def inverse_columns(j: Sequence[Sequence[Column]]) -> list[list[Column]]:
    """The inverse of a matrix of columns by its adjugate, up to 3 x 3; a zero determinant gives null."""
    n, det = len(j), det_columns(j)
    if n == 1:
        return [[F.try_divide(F.lit(1.0), det)]]
    out = []
    for i in range(n):
        row = []
        for k in range(n):
            minor = [[j[a][b] for b in range(n) if b != i] for a in range(n) if a != k]
            row.append(F.try_divide(F.lit(float((-1) ** (i + k))) * det_columns(minor), det))
        out.append(row)
    return out


def tensor_columns(components: Column, j: Sequence[Sequence[Any]], kind: TensorType) -> Column:
    """The law on an array column (nested for two slots), with a constant or per-row matrix; stays in the JVM."""
    n = len(j)
    constant = all(isinstance(x, int | float | np.floating) for r in j for x in r)
    if constant:
        m = np.array(j, float)
        _check_map(m, kind)
        inv_t = (np.linalg.inv(m).T if CO in kind.variance else m).tolist()
        sign, log = np.linalg.slogdet(m)
        factor: Column = F.lit(float((sign if kind.odd else 1.0) * (math.exp(kind.weight * log) if kind.weight else 1.0)))
    else:
        inv = inverse_columns(j) if CO in kind.variance else None
        inv_t = [[inv[b][a] for b in range(n)] for a in range(n)] if inv else j
        det = det_columns(j)
        factor = F.lit(1.0)
        if kind.weight:
            factor = factor * F.exp(F.lit(kind.weight) * F.log(F.abs(det)))
        if kind.odd:
            factor = factor * F.signum(det)
    maps = [j if v == CONTRA else inv_t for v in kind.variance]
    if kind.order == 0:
        return components * factor
    if kind.order == 1:
        parts = [components[i] for i in range(n)]
        return F.array(*[_dot(row, parts) * factor for row in maps[0]])
    if kind.order == 2:
        half = [[_dot(maps[0][i], [components[k][b] for k in range(n)]) for b in range(n)] for i in range(n)]
        return F.array(*[F.array(*[_dot(maps[1][k], half[i]) * factor for k in range(n)]) for i in range(n)])
    raise ValueError("array columns hold tensors up to order 2")


def polar_orthogonal_factor(j: Any) -> np.ndarray:
    """The orthogonal matrix nearest to J; refuses a singular one."""
    u, s, vt = np.linalg.svd(np.asarray(j, float))
    if (s[..., -1] <= s[..., 0] * 1e-14).any():
        raise ValueError("a singular matrix has no polar factor")
    return u @ vt


def polar_column(j: Sequence[Sequence[Column]]) -> Column:
    """The polar factor of a per-row matrix as a flat array: there is no SVD in SQL, so Arrow batches run NumPy."""
    n = len(j)

    @F.pandas_udf("array<double>")
    def factor(*parts: pd.Series) -> pd.Series:
        m = np.stack([p.to_numpy(float) for p in parts], axis=-1).reshape(-1, n, n)
        return pd.Series(list(polar_orthogonal_factor(m).reshape(-1, n * n)))

    return factor(*[c for row in j for c in row])


@dataclass(frozen=True)
class SymmetricPacking:
    """Which pairs a packed symmetric tensor stores, and the factor on those off the diagonal."""

    size: int
    pairs: tuple[tuple[int, int], ...]
    off_diagonal: float = 1.0

    def __post_init__(self) -> None:
        want = {(i, k) for i in range(self.size) for k in range(i, self.size)}
        if {tuple(sorted(p)) for p in self.pairs} != want or len(self.pairs) != len(want):
            raise ValueError("a packing names every pair once")

    @classmethod
    def voigt(cls, size: int = 3) -> SymmetricPacking:
        return cls(size, _voigt(size))

    @classmethod
    def mandel(cls, size: int = 3) -> SymmetricPacking:
        return cls(size, _voigt(size), math.sqrt(2))

    @classmethod
    def upper_triangular(cls, size: int = 3) -> SymmetricPacking:
        return cls(size, tuple((i, k) for i in range(size) for k in range(i, size)))

    @classmethod
    def lower_triangular(cls, size: int = 3) -> SymmetricPacking:
        return cls(size, tuple((i, k) for i in range(size) for k in range(i + 1)))

    def labels(self, axes: Sequence[str]) -> list[str]:
        return [axes[i] + axes[k] for i, k in self.pairs]

    def pack(self, full: Column, *, check: bool = True, tolerance: float = SYMMETRY_TOLERANCE) -> Column:
        """Nested array to packed array; an asymmetric row raises unless ``check`` is off, which takes the mean."""
        out = []
        for i, k in self.pairs:
            a, b = full[i][k], full[k][i]
            x = a if i == k else (a + b) / 2
            if check and i != k:
                scale = F.greatest(F.abs(a), F.abs(b))
                x = F.when(F.abs(a - b) > F.lit(tolerance) * scale, F.raise_error(F.lit("a tensor is not symmetric")).cast("double")).otherwise(x)
            out.append(x * F.lit(self.off_diagonal if i != k else 1.0))
        return F.array(*out)

    def unpack(self, packed: Column) -> Column:
        at = {tuple(sorted(p)): n for n, p in enumerate(self.pairs)}
        cell = lambda i, k: packed[at[tuple(sorted((i, k)))]] / F.lit(self.off_diagonal if i != k else 1.0)
        return F.array(*[F.array(*[cell(i, k) for k in range(self.size)]) for i in range(self.size)])


def _voigt(size: int) -> tuple[tuple[int, int], ...]:
    """Diagonal first, then the pairs of the upper triangle from its last column upwards."""
    return tuple((i, i) for i in range(size)) + tuple((i, k) for k in range(size - 1, 0, -1) for i in range(k - 1, -1, -1)) if size != 3 else (
        (0, 0), (1, 1), (2, 2), (1, 2), (0, 2), (0, 1),
    )


def enu_matrix_columns(longitude: Column, latitude: Column) -> list[list[Column]]:
    """Cartesian to east, north, up, from angles in radians."""
    sl, cl, sp, cp = F.sin(longitude), F.cos(longitude), F.sin(latitude), F.cos(latitude)
    return [[-sl, cl, F.lit(0.0)], [-sp * cl, -sp * sl, cp], [cp * cl, cp * sl, sp]]


@dataclass(frozen=True)
class EastNorthUp:
    """The basis east, north, up, which varies by point; ``base`` is the angular frame it is taken at."""

    base: Any

    def _radians(self, columns: Sequence[Column]) -> tuple[Column, Column]:
        from framegrid.plans.declare import LATITUDE, LONGITUDE, full_turn

        s = self.base.coordinate_system
        i, j = s.axis_of(LONGITUDE), s.axis_of(LATITUDE)
        return columns[i] * F.lit(2 * math.pi / full_turn(s.units[i])), columns[j] * F.lit(2 * math.pi / full_turn(s.units[j]))

    def matrix(self, columns: Sequence[Column]) -> list[list[Column]]:
        return enu_matrix_columns(*self._radians(columns))

    def inverse_matrix(self, columns: Sequence[Column]) -> list[list[Column]]:
        m = self.matrix(columns)
        return [[m[b][a] for b in range(3)] for a in range(3)]

    def directions(self, columns: Sequence[Column]) -> list[list[Column]]:
        """Unit vectors in the Earth-centred axes, a column for each of east, north and, where the base has
        a third axis, up; defined at the poles too."""
        return [row[: len(self.base.axes)] for row in self.inverse_matrix(columns)]

    def matches(self, transition: Any) -> bool:
        """Whether a chart transition runs between the base and Earth-centred axes; a geodetic base has no
        ellipsoid of its own, so any fits."""
        from framegrid.functions.transforms import CartesianToGeodetic, CartesianToSpherical, GeodeticToCartesian, SphericalToCartesian

        spherical = self.base.coordinate_system.representation == "spherical"
        if isinstance(transition, SphericalToCartesian if spherical else GeodeticToCartesian):
            return transition.source == self.base
        return isinstance(transition, CartesianToSpherical if spherical else CartesianToGeodetic) and transition.target == self.base
