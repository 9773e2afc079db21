"""Immutable declarations: directions, coordinate systems, frames and array coordinates.

They live on the driver, hold no data, compare by value and refuse what would be ambiguous. Units are
open strings compared exactly; nothing is converted implicitly.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any, NamedTuple

import numpy as np

CARTESIAN, SPHERICAL, GEODETIC = "cartesian", "spherical", "geodetic"
LONGITUDE, LATITUDE, RADIUS, HEIGHT = "longitude", "latitude", "radius", "height"
LOCAL_NAMESPACE = "local"
ANONYMOUS_NAMESPACE = "anonymous"
ROLES = ("physical", "index", "derived")

# Numerical contract of positions, lattices and intervals (fixed values).
LATTICE_TOLERANCE = 1e-6
POSITION_SLACK = 1e-9
SINGLE_SAMPLE_TOLERANCE = 8 * float(np.finfo(float).eps)
EXACT_STEP_TOLERANCE = 1e-12
INTERVAL_TOLERANCE = 1e-9
INTERVAL_ROUNDOFF_FACTOR = 8 * float(np.finfo(float).eps)
ROUNDING_ALLOWANCE = 1e-9
INVERSE_CONDITION_LIMIT = 1 / (10 * float(np.finfo(float).eps))

# Unit spellings of plain, eastward and northward angles (fixed values).
_DEGREES = ("deg", "degree", "degrees")
_EAST = ("degrees_east", "degree_east", "degreeE", "degreesE", "degree_E", "degrees_E")
_NORTH = ("degrees_north", "degree_north", "degreeN", "degreesN", "degree_N", "degrees_N")
_RADIANS = ("rad", "radian", "radians")
ANGULAR = frozenset((*_DEGREES, *_EAST, *_NORTH, *_RADIANS))

Metadata = Mapping[str, "str | int | float | bool | None"]


def full_turn(unit: str | None) -> float:
    """One turn in ``unit``, which must be an angular spelling."""
    if unit in _RADIANS:
        return 2 * math.pi
    if unit in ANGULAR:
        return 360.0
    raise ValueError(f"{unit!r} is not an angular unit")


def _name(value: Any, what: str) -> str:
    if not isinstance(value, str):
        raise TypeError(f"{what} must be a string, not {type(value).__name__}")
    if not value or value != value.strip():
        raise ValueError(f"{what} {value!r} must be non-empty without outer white space")
    return value


def _names(values: Sequence[str], what: str) -> tuple[str, ...]:
    if isinstance(values, str):
        raise TypeError(f"{what} must be a sequence of strings")
    out = tuple(_name(v, what) for v in values)
    if len(set(out)) != len(out):
        raise ValueError(f"{what} repeat: {out}")
    return out


def _each(values: Sequence[Any] | None, n: int, what: str) -> tuple[Any, ...]:
    out = (None,) * n if values is None else tuple(values)
    if len(out) != n:
        raise ValueError(f"{len(out)} {what} for {n} axes")
    return out


def _items(values: Metadata | None) -> tuple[tuple[str, Any], ...]:
    out = []
    for k, v in sorted((values or {}).items()):
        if v is not None and not isinstance(v, str | bool | int | float):
            raise TypeError(f"metadata {k!r} must be a flat scalar")
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError(f"metadata {k!r} must be finite")
        out.append((_name(k, "metadata name"), v))
    return tuple(out)


def _typed(items: tuple[tuple[str, Any], ...]) -> tuple:
    """Items with their types, so that True, 1 and 1.0 differ."""
    return tuple((k, type(v).__name__, v) for k, v in items)


@dataclass(frozen=True)
class DirectionVocabulary:
    """A closed set of directions ``<from>-to-<to>``, each with its opposite."""

    identifier: str
    directions: frozenset[str]

    def __init__(self, identifier: str, directions: Iterable[str]):
        tokens: set[str] = set()
        for d in directions:
            a, b = self.ends(d)
            if d in tokens:
                raise ValueError(f"direction {d!r} repeats or is another's opposite")
            tokens |= {d, f"{b}-to-{a}"}
        if not tokens:
            raise ValueError("a vocabulary needs a direction")
        object.__setattr__(self, "identifier", _name(identifier, "identifier"))
        object.__setattr__(self, "directions", frozenset(tokens))

    @staticmethod
    def ends(token: str) -> tuple[str, str]:
        parts = _name(token, "direction").split("-to-")
        if len(parts) != 2 or parts[0] == parts[1] or any(not p or p != p.strip() for p in parts):
            raise ValueError(f"direction {token!r} is not of the form '<from>-to-<to>'; bare codes are ambiguous")
        return parts[0], parts[1]

    def check(self, token: str) -> str:
        if token not in self.directions:
            raise ValueError(f"direction {token!r} is not in vocabulary {self.identifier!r}")
        return token

    def opposite(self, token: str) -> str:
        a, b = self.ends(self.check(token))
        return f"{b}-to-{a}"

    def pair(self, token: str) -> frozenset[str]:
        return frozenset((self.check(token), self.opposite(token)))


class AxisCode(NamedTuple):
    """The oriented axis nearest to a vector, the direction along it, and the angle left in degrees."""

    axis: str
    direction: str
    angle: float


@dataclass(frozen=True)
class CoordinateSystem:
    """Ordered axes with units, types, a representation and, where known, orientation or angular roles."""

    axes: tuple[str, ...]
    units: tuple[str | None, ...]
    axis_types: tuple[str | None, ...] = ()
    representation: str = CARTESIAN
    vocabulary: DirectionVocabulary | None = None
    orientation: tuple[str | None, ...] = ()
    axis_roles: tuple[str | None, ...] = ()

    def __init__(
        self,
        axes: Sequence[str],
        units: Sequence[str | None],
        *,
        axis_types: Sequence[str | None] | None = None,
        representation: str = CARTESIAN,
        vocabulary: DirectionVocabulary | None = None,
        orientation: Sequence[str | None] | None = None,
        axis_roles: Sequence[str | None] | None = None,
    ):
        names = _names(axes, "axes")
        if not names:
            raise ValueError("a coordinate system needs an axis")
        n = len(names)
        given = _each(units, n, "units")
        types, turned, roles = _each(axis_types, n, "axis types"), _each(orientation, n, "orientations"), _each(axis_roles, n, "axis roles")
        if representation not in (CARTESIAN, SPHERICAL, GEODETIC):
            raise ValueError(f"unknown representation {representation!r}")
        if any(t is not None for t in turned):
            if vocabulary is None:
                raise ValueError("an orientation needs a vocabulary")
            if representation != CARTESIAN:
                raise ValueError("axes of an angular system cannot be oriented")
            pairs = [vocabulary.pair(t) for t in turned if t is not None]
            if len(set(pairs)) != len(pairs):
                raise ValueError("two axes point along one direction pair")
        else:
            vocabulary = None
        if representation == CARTESIAN and any(r is not None for r in roles):
            raise ValueError("a Cartesian system has no axis roles")
        if representation != CARTESIAN:
            third = RADIUS if representation == SPHERICAL else HEIGHT
            if roles.count(LONGITUDE) != 1 or roles.count(LATITUDE) != 1 or roles.count(third) > 1:
                raise ValueError("an angular system has one longitude, one latitude and at most one third role")
            if bad := [r for r in roles if r not in (None, LONGITUDE, LATITUDE, third)]:
                raise ValueError(f"axis role {bad[0]!r} does not belong to a {representation} system")
        for u, r in zip(given, roles, strict=True):
            if u is not None:
                _name(u, "unit")
            allowed = {LONGITUDE: (*_DEGREES, *_EAST, *_RADIANS), LATITUDE: (*_DEGREES, *_NORTH, *_RADIANS)}.get(r or "")
            if allowed is not None and u not in allowed:
                raise ValueError(f"unit {u!r} is not one of a {r}")
            if allowed is None and u in ANGULAR:
                raise ValueError(f"angular unit {u!r} on an axis without an angular role")
        for k, v in (
            ("axes", names), ("units", given), ("axis_types", types), ("representation", representation),
            ("vocabulary", vocabulary), ("orientation", turned), ("axis_roles", roles),
        ):
            object.__setattr__(self, k, v)

    def axis_of(self, role: str) -> int | None:
        return self.axis_roles.index(role) if role in self.axis_roles else None

    def axis_codes(self, vector: Sequence[float]) -> tuple[AxisCode, ...]:
        """Oriented axes by growing angle to ``vector``; equal angles keep the axes' order."""
        if self.representation != CARTESIAN or self.vocabulary is None:
            raise ValueError("axis codes need a Cartesian system with oriented axes")
        v = np.asarray(vector, float)
        if v.shape != (len(self.axes),) or not np.isfinite(v).all() or not v.any():
            raise ValueError("a finite non-zero vector with one component for each axis is needed")
        unit = {u for u, o in zip(self.units, self.orientation, strict=True) if o is not None}
        if len(unit) > 1:
            raise ValueError("angles need one unit on all oriented axes")
        v = v / np.abs(v).max()
        out = []
        for x, axis, token in zip(v / np.linalg.norm(v), self.axes, self.orientation, strict=True):
            if token is not None:
                rest = math.sqrt(max(0.0, 1 - x * x))
                out.append(AxisCode(axis, token if x >= 0 else self.vocabulary.opposite(token), math.degrees(math.atan2(rest, abs(x)))))
        return tuple(sorted(out, key=lambda c: c.angle))


@dataclass(frozen=True)
class ReferenceFrame:
    """The identity of a space, and the coordinate system its points are written in.

    Two frames are one space only if identifier, definition and context agree; numbers never decide.
    """

    identifier: tuple[str, str]
    coordinate_system: CoordinateSystem
    definition_items: tuple[tuple[str, Any], ...] = ()
    context_items: tuple[tuple[str, Any], ...] = ()
    role: str | None = field(default=None, compare=False)
    display_items: tuple[tuple[str, Any], ...] = field(default=(), compare=False)

    @classmethod
    def declared(cls, namespace: str, value: str, coordinate_system: CoordinateSystem, *, role: str | None = None,
                 definition: Metadata | None = None, context: Metadata | None = None, display: Metadata | None = None) -> ReferenceFrame:
        if _name(namespace, "namespace") in (LOCAL_NAMESPACE, ANONYMOUS_NAMESPACE):
            raise ValueError(f"namespace {namespace!r} is reserved")
        return cls((namespace, _name(value, "identifier")), coordinate_system, _items(definition), _items(context), role, _items(display))

    @classmethod
    def local(cls, coordinate_system: CoordinateSystem, *, identifier: str | None = None, role: str | None = None,
              definition: Metadata | None = None, context: Metadata | None = None, display: Metadata | None = None) -> ReferenceFrame:
        """A space created on purpose and shared by passing the object (or its identifier)."""
        return cls((LOCAL_NAMESPACE, identifier or uuid.uuid4().hex), coordinate_system, _items(definition), _items(context), role, _items(display))

    @classmethod
    def anonymous(cls, coordinate_system: CoordinateSystem, *, identifier: str | None = None, role: str | None = None,
                  definition: Metadata | None = None, display: Metadata | None = None) -> ReferenceFrame:
        """Geometry without a known identity: equal to nothing but itself."""
        return cls((ANONYMOUS_NAMESPACE, identifier or uuid.uuid4().hex), coordinate_system, _items(definition), (), role, _items(display))

    def __post_init__(self) -> None:
        if not isinstance(self.coordinate_system, CoordinateSystem):
            raise TypeError("a frame needs a CoordinateSystem")
        if self.role is not None:
            _name(self.role, "role")

    @property
    def is_anonymous(self) -> bool:
        return self.identifier[0] == ANONYMOUS_NAMESPACE

    @property
    def axes(self) -> tuple[str, ...]:
        return self.coordinate_system.axes

    @property
    def units(self) -> tuple[str | None, ...]:
        return self.coordinate_system.units

    @property
    def definition(self) -> Metadata:
        return MappingProxyType(dict(self.definition_items))

    @property
    def context(self) -> Metadata:
        return MappingProxyType(dict(self.context_items))

    @property
    def display(self) -> Metadata:
        return MappingProxyType(dict(self.display_items))

    def with_coordinate_system(self, coordinate_system: CoordinateSystem) -> ReferenceFrame:
        """The same space written in another system."""
        return ReferenceFrame(self.identifier, coordinate_system, self.definition_items, self.context_items, self.role, self.display_items)

    def is_equivalent_frame(self, other: ReferenceFrame) -> bool:
        return self.identifier == other.identifier and self._described() == other._described()

    def conflicts_with(self, other: ReferenceFrame) -> bool:
        return self.identifier == other.identifier and self._described() != other._described()

    def _described(self) -> tuple:
        return _typed(self.definition_items), _typed(self.context_items)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, ReferenceFrame) and self.is_equivalent_frame(other) and self.coordinate_system == other.coordinate_system

    def __hash__(self) -> int:
        return hash((self.identifier, self._described(), self.coordinate_system))

    def __str__(self) -> str:
        return "an anonymous frame" if self.is_anonymous else f"frame {self.identifier[0]}:{self.identifier[1]}"


@dataclass(frozen=True)
class ArrayCoordinates:
    """A table's own coordinate columns as the endpoint of a transform.

    ``sample_offset`` tells where a sample sits in its cell, from 0 (lower edge) to 1; None: no cell.
    """

    axes: tuple[str, ...]
    units: tuple[str | None, ...]
    axis_types: tuple[str | None, ...] = ()
    sample_offset: tuple[float | None, ...] = ()

    def __init__(self, axes: Sequence[str], units: Sequence[str | None], *, axis_types: Sequence[str | None] | None = None,
                 sample_offset: Sequence[float | None] | float | None = None):
        names = _names(axes, "axes")
        n = len(names)
        if isinstance(sample_offset, int | float):
            sample_offset = (sample_offset,) * n
        offsets = tuple(None if o is None else float(o) + 0.0 for o in _each(sample_offset, n, "sample offsets"))
        if any(o is not None and not 0 <= o <= 1 for o in offsets):
            raise ValueError("a sample offset lies in [0, 1]")
        object.__setattr__(self, "axes", names)
        object.__setattr__(self, "units", _each(units, n, "units"))
        object.__setattr__(self, "axis_types", _each(axis_types, n, "axis types"))
        object.__setattr__(self, "sample_offset", offsets)

    def with_axes(self, renamed: Mapping[str, str]) -> ArrayCoordinates:
        return ArrayCoordinates([renamed.get(a, a) for a in self.axes], self.units, axis_types=self.axis_types, sample_offset=self.sample_offset)


Endpoint = ReferenceFrame | ArrayCoordinates


def axes_of(endpoint: Endpoint) -> tuple[str, ...]:
    return endpoint.axes


def system_of(endpoint: Endpoint) -> CoordinateSystem | None:
    return endpoint.coordinate_system if isinstance(endpoint, ReferenceFrame) else None
