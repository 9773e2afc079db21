"""Tensor components of framed tables: declaration, change of basis, symmetric packing, resampling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrid.functions.tensors import EastNorthUp, SymmetricPacking, TensorType, inverse_columns, polar_column, polar_orthogonal_factor, tensor_columns
from framegrid.functions.transforms import AffineTransform, columns_of, coordinate_system_change, jacobian_columns_of
from framegrid.operators.framed import FramedDF
from framegrid.operators.resample import relate, resample
from framegrid.plans.declare import CARTESIAN, ReferenceFrame
from framegrid.plans.grid import Grid, pos

JACOBIAN, POLAR = "jacobian", "polar"


@dataclass(frozen=True)
class ComponentDeclaration:
    """A value column's array holds components of this type in this basis; ``packing`` if symmetric ones are packed."""

    column: str
    kind: TensorType
    basis: ReferenceFrame | EastNorthUp
    packing: SymmetricPacking | None = None


@dataclass(frozen=True)
class TensorDF:
    """A framed table whose one array column is a declared tensor."""

    framed: FramedDF
    declaration: ComponentDeclaration

    def clear(self) -> FramedDF:
        return self.framed

    def select_component(self, *index: int, name: str) -> FramedDF:
        """One component as a plain value: no longer a tensor, so the declaration goes."""
        c = F.col(self.declaration.column)
        for i in index:
            c = c[i]
        df = self.framed.df.withColumn(name, c).drop(self.declaration.column)
        return replace(self.framed, df=df, values=tuple(v for v in self.framed.values if v != self.declaration.column) + (name,))

    def combine(self, other: TensorDF, fn: Any) -> TensorDF:
        """Element-wise sum or difference of equally declared tensors."""
        if replace(other.declaration, column=self.declaration.column) != self.declaration:
            raise ValueError("tensor declarations differ; change one basis first")
        if self.declaration.kind.order != 1 and self.declaration.packing is None:
            raise ValueError("element-wise operations need a flat array")
        joined = self.framed.combine(other.framed, lambda a, b: F.zip_with(a, b, fn))
        return TensorDF(joined, self.declaration)

    def unpack(self) -> TensorDF:
        d = self.declaration
        if d.packing is None:
            raise ValueError("the components are not packed")
        df = self.framed.df.withColumn(d.column, d.packing.unpack(F.col(d.column)))
        return TensorDF(replace(self.framed, df=df), replace(d, packing=None))

    def pack(self, packing: SymmetricPacking, *, check: bool = True) -> TensorDF:
        d = self.declaration
        if not d.kind.symmetric or d.packing is not None:
            raise ValueError("only unpacked symmetric tensors can be packed")
        df = self.framed.df.withColumn(d.column, packing.pack(F.col(d.column), check=check))
        return TensorDF(replace(self.framed, df=df), replace(d, packing=packing))

    def change_basis(self, basis: ReferenceFrame | EastNorthUp | Any, *, units: str | None = None) -> TensorDF:
        """Components in another system of the same space, or in a basis that varies by sample.

        Such a basis is east, north, up, or any object with ``base`` (a frame), ``matrix`` and
        ``inverse_matrix``, which take the coordinate columns and return rows of columns.

        ``units`` is needed exactly when the change alters the axes' units, as components then change theirs.
        """
        d = self.declaration
        if d.packing is not None:
            return self.unpack().change_basis(basis, units=units).pack(d.packing)
        old, new = d.basis, basis
        matrix: Sequence[Sequence[Any]]
        if isinstance(old, ReferenceFrame) and isinstance(new, ReferenceFrame):
            if (old.units != new.units) != (units is not None):
                raise ValueError("units= is given exactly when the basis changes units")
            matrix = coordinate_system_change(old, new).matrix.tolist()
        else:
            field = old if isinstance(new, ReferenceFrame) else new
            grid = self.framed.grid
            if not grid.frame.is_equivalent_frame(field.base):
                raise ValueError("the basis field belongs to another space")
            points = columns_of(grid.transform, [F.col(a).cast("double") for a in grid.transform.source.axes])
            matrix = field.matrix(points) if field is new else field.inverse_matrix(points)
        df = self.framed.df.withColumn(d.column, tensor_columns(F.col(d.column), matrix, d.kind))
        return TensorDF(replace(self.framed, df=df), replace(d, basis=new))


def declare_components(framed: FramedDF, column: str, kind: TensorType, *, basis: ReferenceFrame | EastNorthUp | None = None,
                       packing: SymmetricPacking | None = None) -> TensorDF:
    if column not in framed.values:
        raise ValueError(f"{column!r} is not a value column")
    if packing is not None and not kind.symmetric:
        raise ValueError("only symmetric tensors are packed")
    if not framed.df.schema[column].dataType.simpleString().startswith("array<"):
        raise TypeError("components are an array column")
    return TensorDF(framed, ComponentDeclaration(column, kind, basis or framed.grid.frame, packing))


def _pole_signs(basis: ReferenceFrame | EastNorthUp, frame: ReferenceFrame, size: int) -> list[float] | None:
    """The factor of each component on the opposite meridian past a pole; None where the basis has no rule."""
    if isinstance(basis, EastNorthUp):
        return [-1.0, -1.0, *[1.0] * (size - 2)] if basis.base == frame else None
    return [1.0] * size if basis.coordinate_system.representation == CARTESIAN else None


def resample_components(values: DataFrame, source: Grid, target: Grid, *, column: str, size: int, kind: TensorType, carried: Sequence[str] = (), transform: Any = None,
                        method: str = "linear", fill_value: float = float("nan"), reorientation: str | Any = JACOBIAN,
                        basis: ReferenceFrame | EastNorthUp | None = None) -> DataFrame:
    """Interpolate components in the source's basis, then carry them to the target's frame.

    The basis is the source frame's own, or one given for a target in the source's frame, in which the
    result is then written too. Across a pole the components of a Cartesian basis go on as they are; of
    an east, north, up basis over the source's frame east and north are reversed on the opposite
    meridian. A chart's own basis has no limit at a pole, so there no row goes on across it and targets
    beyond the last row are filled.

    With T from target to source points the components change by L = (DT)^-1 at each target sample, or by
    its polar factor, or by what a function of the matrix returns. ``fill_value`` is NaN or 0, as any
    other constant would not survive the change.
    """
    if not (fill_value != fill_value or fill_value == 0):
        raise ValueError("components are filled with NaN or 0 only")
    if kind.order not in (1, 2):
        raise ValueError("components of order 1 or 2 are resampled")
    index = [(i,) for i in range(size)] if kind.order == 1 else [(i, k) for i in range(size) for k in range(size)]
    names = ["c_" + "_".join(map(str, i)) for i in index]
    cells = [F.col(column)[i[0]] if len(i) == 1 else F.col(column)[i[0]][i[1]] for i in index]
    wide = values.select(*[pos(d) for d in source.dims], *carried, *[c.alias(n) for c, n in zip(cells, names, strict=True)])
    signs = _pole_signs(basis or source.frame, source.frame, size)
    turned = [n for n, i in zip(names, index, strict=True) if signs is not None and np.prod([signs[k] for k in i]) < 0]
    out = resample(wide, source, target, value_columns=names, carried=carried, transform=transform, method=method, fill_value=fill_value, poles=signs is not None, reversed_at_poles=turned)
    over = relate(target.frame, source.frame, transform)
    if basis is not None and basis != source.frame:
        if transform is not None or target.frame != source.frame:
            raise ValueError("a basis of its own is kept within the source's frame; change the basis first")
        matrix: Sequence[Sequence[Any]] = np.eye(size).tolist()
    elif type(over) is AffineTransform:
        linear = np.linalg.inv(over.matrix)
        linear = linear if reorientation == JACOBIAN else polar_orthogonal_factor(linear) if reorientation == POLAR else np.asarray(reorientation(linear[None])[0], float)
        matrix = linear.tolist()
    else:
        points = columns_of(target.transform, [target.coordinate(target.axis(a)) for a in target.transform.source.axes])
        inverse = inverse_columns(jacobian_columns_of(over, points))
        if reorientation == POLAR:
            flat = polar_column(inverse)
            inverse = [[flat[i * size + k] for k in range(size)] for i in range(size)]
        elif reorientation != JACOBIAN:
            raise TypeError("a function reorients under affine maps; use 'jacobian' or 'polar' here")
        matrix = inverse
    array: Column = F.array(*[F.col(n) for n in names]) if kind.order == 1 else F.array(*[F.array(*[F.col(f"c_{i}_{k}") for k in range(size)]) for i in range(size)])
    return out.select(*[pos(d) for d in target.dims], *carried, tensor_columns(array, matrix, kind).alias(column))
