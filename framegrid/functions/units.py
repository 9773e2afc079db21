"""Spellings of units, on the driver and as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical spellings and their variants (fixed values of common usage).
SPELLINGS = {
    "m": ("meter", "metre", "meters", "metres"),
    "mm": ("millimeter", "millimetre", "millimeters", "millimetres"),
    "cm": ("centimeter", "centimetre", "centimeters", "centimetres"),
    "um": ("micrometer", "micrometre", "micrometers", "micrometres", "micron", "microns", "µm", "μm"),
    "nm": ("nanometer", "nanometre", "nanometers", "nanometres"),
    "km": ("kilometer", "kilometre", "kilometers", "kilometres"),
    "s": ("second", "seconds", "sec"),
    "ms": ("millisecond", "milliseconds", "msec"),
    "us": ("microsecond", "microseconds", "µs", "μs"),
    "min": ("minute", "minutes"),
    "h": ("hour", "hours", "hr"),
    "d": ("day", "days"),
    "Hz": ("hertz",),
    "deg": ("degree", "degrees"),
    "rad": ("radian", "radians"),
    "1": ("dimensionless", "unitless"),
}
#: Canonical spellings and the names that udunits and NGFF use (fixed values).
LONG_NAMES = {
    "m": "meter", "mm": "millimeter", "cm": "centimeter", "um": "micrometer", "nm": "nanometer", "km": "kilometer", "s": "second",
    "ms": "millisecond", "us": "microsecond", "min": "minute", "h": "hour", "d": "day", "Hz": "hertz", "deg": "degree", "rad": "radian",
}
_CANONICAL = {v: k for k, own in SPELLINGS.items() for v in (k, *own)}


def canonical(unit: str) -> str:
    """The short spelling; an unknown unit is returned as it is, since units are open strings."""
    if not isinstance(unit, str):
        raise TypeError("a unit is a string")
    return _CANONICAL.get(unit, unit)


def udunits_name(unit: str) -> str:
    short = canonical(unit)
    if short not in LONG_NAMES:
        raise ValueError(f"{unit!r} has no known long name")
    return LONG_NAMES[short]


def canonical_column(unit: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in _CANONICAL.items() for x in pair])
    return F.coalesce(F.element_at(table, unit), unit)
