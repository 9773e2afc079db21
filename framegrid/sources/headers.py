"""Grids from the headers of image formats, and back. Headers come as mappings, JSON or raw bytes."""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegrid.functions.transforms import AffineTransform
from framegrid.functions.units import canonical, udunits_name
from framegrid.plans.anatomy import PATIENT, patient_coordinate_system, patient_frame
from framegrid.plans.declare import ArrayCoordinates, CoordinateSystem, ReferenceFrame
from framegrid.plans.grid import Grid

# DICOM ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Stack:
    """A grid of slices, the order of the given slices in it, and codes of the decisions taken."""

    grid: Grid
    order: tuple[int, ...]
    report: tuple[str, ...]


def dicom_stack(slices: Sequence[Mapping[str, Any]], *, frame: ReferenceFrame | None = None, orientation_tolerance: float = 1e-4, slice_tolerance: float = 0.01) -> Stack:
    """Classic slices as one grid: ordered by position along the normal, uniform or with slice offsets.

    Each slice has ImagePositionPatient, ImageOrientationPatient, PixelSpacing, Rows, Columns and, where
    known, SliceThickness and FrameOfReferenceUID.
    """
    if not slices:
        raise ValueError("no slices")
    report: list[str] = []
    first = slices[0]
    o = np.asarray(first["ImageOrientationPatient"], float).reshape(2, 3)
    for s in slices:
        if np.abs(np.asarray(s["ImageOrientationPatient"], float).reshape(2, 3) - o).max() > orientation_tolerance:
            raise ValueError("slices differ in orientation")
        for k in ("Rows", "Columns", "PixelSpacing"):
            if not np.allclose(np.asarray(s[k], float), np.asarray(first[k], float), rtol=1e-6):
                raise ValueError(f"slices differ in {k}")
        if s.get("FrameOfReferenceUID") != first.get("FrameOfReferenceUID"):
            raise ValueError("slices have different frames of reference")
    r = o[0] / np.linalg.norm(o[0])
    if abs(r @ o[1] / np.linalg.norm(o[1])) > orientation_tolerance:
        raise ValueError("row and column directions are not orthogonal")
    c = o[1] - (o[1] @ r) * r
    c /= np.linalg.norm(c)
    if np.abs(c - o[1]).max() > 0 or np.abs(r - o[0]).max() > 0:
        report.append("orientation-orthonormalised")
    normal = np.cross(r, c)
    points = np.array([s["ImagePositionPatient"] for s in slices], float)
    along = points @ normal
    order = np.argsort(along, kind="stable")
    points, along = points[order], along[order]
    row_spacing, col_spacing = (float(x) for x in first["PixelSpacing"])
    if len(slices) > 1:
        gaps = np.diff(along)
        mean = float(gaps.mean())
        if (gaps <= slice_tolerance * mean).any():
            raise ValueError("two slices lie at one position")
        shift = points - points[0] - np.outer(along - along[0], normal)
        if np.abs(shift).max() > slice_tolerance * min(row_spacing, col_spacing):
            raise ValueError("slices are shifted in their plane")
        uniform = bool(np.abs(along - (along[0] + mean * np.arange(len(along)))).max() <= slice_tolerance * mean)
    else:
        mean, uniform = float(first.get("SpacingBetweenSlices") or first.get("SliceThickness") or 1.0), True
    uid = first.get("FrameOfReferenceUID")
    if frame is None:
        frame = patient_frame(uid) if uid else ReferenceFrame.anonymous(patient_coordinate_system())
        report.append("frame-from-uid" if uid else "frame-anonymous")
    thick = [s.get("SliceThickness") for s in slices]
    has = all(t is not None and float(t) > 0 for t in thick)
    report.append("uniform-slices" if uniform else "slice-offsets")
    half = np.array([float(t) for t in thick])[order] / 2 if has else None
    n = np.arange(len(slices))
    if uniform:
        axis, unit, column, values, cells = "k", "1", normal * mean, n, None if half is None else np.stack([n - half / mean, n + half / mean], 1)
    else:
        v = along - along[0]
        axis, unit, column, values, cells = "slice_offset", "mm", normal, v, None if half is None else np.stack([v - half, v + half], 1)
    source = ArrayCoordinates((axis, "j", "i"), (unit, "1", "1"), sample_offset=(0.5 if has else None, 0.5, 0.5))
    t = AffineTransform.from_matrix(np.stack([column, c * row_spacing, r * col_spacing], axis=1), source=source, target=frame, translation=points[0])
    coords = {axis: ("slice", values), "j": ("row", np.arange(int(first["Rows"]))), "i": ("column", np.arange(int(first["Columns"])))}
    grid = Grid(t, coords, intervals={axis: cells} if cells is not None else None)
    return Stack(grid, tuple(int(k) for k in order), tuple(report))


def dicom_enhanced(shared: Mapping[str, Any], frames: Sequence[Mapping[str, Any]], *, frame_indices: Sequence[int] | None = None, **options: Any) -> Stack:
    """A multi-frame object: what its frames share and what each has of its own, never both."""
    chosen = range(len(frames)) if frame_indices is None else frame_indices
    merged = []
    for k in chosen:
        if both := set(shared) & set(frames[k]):
            raise ValueError(f"{sorted(both)} are given for all frames and for frame {k}")
        merged.append({**shared, **frames[k]})
    return dicom_stack(merged, **options)


def dicom_order(headers: DataFrame) -> DataFrame:
    """Slices of many series ordered by position along their normal, for headers that are a table.

    Needs columns series, sop, position and orientation (arrays of doubles); adds ``slice`` from 0, the
    distance along the normal and the gap to the slice before.
    """
    from pyspark.sql import Window

    o, p = F.col("orientation"), F.col("position")
    normal = [o[1] * o[5] - o[2] * o[4], o[2] * o[3] - o[0] * o[5], o[0] * o[4] - o[1] * o[3]]
    along = sum((n * p[k] for k, n in enumerate(normal[1:], 1)), normal[0] * p[0])
    w = Window.partitionBy("series").orderBy("along", "sop")
    placed = headers.withColumn("along", along)
    return placed.withColumns({"slice": F.row_number().over(w) - 1, "gap": F.col("along") - F.lag("along").over(w)})


def modality_values(stored: Any, slope: float = 1.0, intercept: float = 0.0) -> Any:
    """Stored pixel values as physical ones."""
    return stored * slope + intercept


# NIfTI ----------------------------------------------------------------------------------------------

# Offsets and codes of the 348-byte header (fixed values of the format).
_NIFTI = {"dim": (40, "8h"), "pixdim": (76, "8f"), "xyzt_units": (123, "B"), "toffset": (136, "f"), "qform_code": (252, "h"), "sform_code": (254, "h"),
          "quatern": (256, "3f"), "qoffset": (268, "3f"), "srow_x": (280, "4f"), "srow_y": (296, "4f"), "srow_z": (312, "4f")}
_SPACE_UNITS = {1: "m", 2: "mm", 3: "um"}
_TIME_UNITS = {8: "s", 16: "ms", 24: "us"}
_TEMPLATES = {3: "talairach", 4: "mni152"}


def parse_nifti_header(data: bytes) -> dict[str, Any]:
    """The geometry fields of a raw header."""
    for order in "<>":
        if len(data) >= 348 and struct.unpack_from(f"{order}i", data)[0] == 348:
            break
    else:
        raise ValueError("not a NIfTI-1 header")
    out = {}
    for name, (at, kind) in _NIFTI.items():
        v = struct.unpack_from(order + kind, data, at)
        out[name] = v[0] if len(v) == 1 else list(v)
    return out


def build_nifti_header(fields: Mapping[str, Any]) -> bytes:
    """A raw little-endian header with the given geometry fields."""
    out = bytearray(348)
    struct.pack_into("<i", out, 0, 348)
    for name, value in fields.items():
        at, kind = _NIFTI[name]
        struct.pack_into("<" + kind, out, at, *(value if isinstance(value, Sequence) else [value]))
    out[344:348] = b"n+1\0"
    return bytes(out)


def _quaternion(h: Mapping[str, Any]) -> np.ndarray:
    b, c, d = (float(x) for x in h["quatern"])
    # Stored in single precision: a half turn leaves a rest that is rounding only.
    rest = 1 - b * b - c * c - d * d
    a = math.sqrt(rest) if rest > 3 * float(np.finfo(np.float32).eps) else 0.0
    r = np.array([
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
    ])
    p = [float(x) for x in h["pixdim"]]
    flip = -1.0 if p[0] < 0 else 1.0
    return np.column_stack([r * np.array([p[1], p[2], p[3] * flip]), h["qoffset"]])


def nifti_grid(header: Mapping[str, Any] | bytes, *, frame: ReferenceFrame | None = None, xform: str = "best", spatial_unit: str | None = None, time: bool = False) -> Grid:
    """``best`` takes the sform, then the qform; codes 3 and 4 name template frames, others none."""
    h = parse_nifti_header(header) if isinstance(header, bytes) else header
    s, q = int(h["sform_code"]), int(h["qform_code"])
    use = {"best": "sform" if s > 0 else "qform", "sform": "sform", "qform": "qform"}[xform]
    code = s if use == "sform" else q
    if code <= 0:
        raise ValueError(f"the header has no {use}")
    m = np.array([h["srow_x"], h["srow_y"], h["srow_z"]], float) if use == "sform" else _quaternion(h)
    units = int(h.get("xyzt_units", 0))
    unit = spatial_unit or _SPACE_UNITS.get(units & 7)
    if unit is None:
        raise ValueError("the header states no spatial unit; give one")
    if frame is None:
        system = patient_coordinate_system("RAS", unit)
        frame = ReferenceFrame.declared("template", _TEMPLATES[code], system) if code in _TEMPLATES else ReferenceFrame.anonymous(system)
    dim, pixdim = [int(x) for x in h["dim"]], [float(x) for x in h["pixdim"]]
    names, types, offsets = ["i", "j", "k"], ["1"] * 3, [0.5] * 3
    matrix, shift = m[:, :3], m[:, 3]
    coords: dict[str, Any] = {a: (a, np.arange(max(1, n))) for a, n in zip(names, dim[1:4], strict=True)}
    if time:
        if dim[0] < 4 or pixdim[4] <= 0:
            raise ValueError("the header states no time step")
        t_unit = _TIME_UNITS.get(units & 56)
        if t_unit is None:
            raise ValueError("the header states no time unit")
        system = frame.coordinate_system
        frame = frame.with_coordinate_system(
            CoordinateSystem((*system.axes, "t"), (*system.units, t_unit), vocabulary=system.vocabulary, orientation=(*system.orientation, None))
        )
        big = np.zeros((4, 4))
        big[:3, :3], big[3, 3] = matrix, pixdim[4]
        matrix, shift = big, np.append(shift, float(h.get("toffset", 0.0)))
        names, types, offsets = [*names, "t"], [*types, "1"], [*offsets, None]
        coords["t"] = ("t", np.arange(dim[4]))
    source = ArrayCoordinates(names, types, sample_offset=offsets)
    return Grid(AffineTransform.from_matrix(matrix, source=source, target=frame, translation=shift), coords)


def nifti_header(grid: Grid, *, dims: Sequence[str] | None = None, xform_code: int = 1) -> dict[str, Any]:
    """Header fields of an even three-dimensional grid in a patient frame: always RAS, the qform only if orthogonal."""
    system = grid.frame.coordinate_system
    if system.vocabulary != PATIENT or len(system.axes) != 3 or any(o is None for o in system.orientation):
        raise ValueError("a header needs a patient frame with three oriented axes")
    from framegrid.functions.transforms import coordinate_system_change

    lattice = grid.lattice(dims)
    ras = grid.frame.with_coordinate_system(patient_coordinate_system("RAS", system.units[0]))
    change = coordinate_system_change(grid.frame, ras)
    m = change.matrix @ lattice.matrix
    t = change.matrix @ lattice.origin
    steps = np.linalg.norm(m, axis=0)
    unit = {v: k for k, v in _SPACE_UNITS.items()}.get(canonical(system.units[0]))
    if unit is None:
        raise ValueError(f"unit {system.units[0]!r} has no code")
    d = m / steps
    out: dict[str, Any] = {
        "dim": [3, *lattice.sizes, 1, 1, 1, 1], "pixdim": [1.0, *steps.tolist(), 0, 0, 0, 0], "xyzt_units": unit, "sform_code": xform_code, "qform_code": 0,
        "srow_x": [*m[0].tolist(), float(t[0])], "srow_y": [*m[1].tolist(), float(t[1])], "srow_z": [*m[2].tolist(), float(t[2])],
    }
    if np.abs(d.T @ d - np.eye(3)).max() < 1e-6:
        sign = 1.0 if np.linalg.det(d) > 0 else -1.0
        r = d * np.array([1, 1, sign])
        a = math.sqrt(max(0.0, 1 + np.trace(r))) / 2
        if a > 1e-6:
            quat = [(r[2, 1] - r[1, 2]) / (4 * a), (r[0, 2] - r[2, 0]) / (4 * a), (r[1, 0] - r[0, 1]) / (4 * a)]
        else:
            k = int(np.argmax(np.diag(r)))
            v = (r[:, k] + np.eye(3)[:, k]) / math.sqrt(2 * (1 + r[k, k]))
            quat = v.tolist()
        out |= {"qform_code": xform_code, "quatern": [float(x) for x in quat], "qoffset": t.tolist(), "pixdim": [sign, *steps.tolist(), 0, 0, 0, 0]}
    return out


# NGFF -------------------------------------------------------------------------------------------------


def ngff_affine(spec: Mapping[str, Any], n: int) -> np.ndarray:
    """The homogeneous matrix of a coordinate transformation over ``n`` axes."""
    kind, out = spec.get("type"), np.eye(n + 1)
    if "path" in spec and kind in ("affine", "scale", "translation", "rotation", "displacements", "coordinates"):
        raise ValueError("transformations backed by arrays are not supported")
    if kind == "identity":
        return out
    if kind == "scale":
        out[range(n), range(n)] = [float(x) for x in spec["scale"]]
    elif kind == "translation":
        out[:n, n] = [float(x) for x in spec["translation"]]
    elif kind == "affine":
        out[:n, :] = np.asarray(spec["affine"], float).reshape(n, n + 1)
    elif kind == "rotation":
        r = np.asarray(spec["rotation"], float).reshape(n, n)
        if np.abs(r @ r.T - np.eye(n)).max() > 1e-9:
            raise ValueError("a rotation is orthogonal")
        out[:n, :n] = r
    elif kind == "mapAxis":
        order = [int(k) for k in spec["mapAxis"]]
        if sorted(order) != list(range(n)):
            raise ValueError("an axis map is a permutation")
        out[:n, :n] = np.eye(n)[order]
    elif kind == "sequence":
        for part in spec["transformations"]:
            out = ngff_affine(part, n) @ out
    elif kind == "byDimension":
        seen: set[int] = set()
        out[:n, :n] = 0
        for part in spec["transformations"]:
            ins, outs = [int(k) for k in part["input_axes"]], [int(k) for k in part["output_axes"]]
            if seen & set(outs) or len(ins) != len(outs):
                raise ValueError("every output axis is covered once")
            seen |= set(outs)
            own = ngff_affine(part["transformation"], len(ins))
            for a, i in enumerate(outs):
                out[i, n] = own[a, -1]
                for b, j in enumerate(ins):
                    out[i, j] = own[a, b]
        if seen != set(range(n)):
            raise ValueError("every output axis is covered once")
    elif kind == "bijection":
        out = ngff_affine(spec["forward"], n)
        if np.abs(ngff_affine(spec["inverse"], n) @ out - np.eye(n + 1)).max() > 1e-12:
            raise ValueError("the two directions of a bijection are not inverse")
    else:
        raise ValueError(f"transformation {kind!r} is not supported")
    return out


def ngff_grid(multiscale: Mapping[str, Any], shape: Sequence[int], *, level: int = 0, frame: ReferenceFrame | None = None) -> Grid:
    """One level of a multiscale: level and image transformations are folded, channel axes must be identity and are dropped."""
    axes = multiscale["axes"]
    n = len(axes)
    m = np.eye(n + 1)
    for spec in (*multiscale["datasets"][level].get("coordinateTransformations", ()), *multiscale.get("coordinateTransformations", ())):
        m = ngff_affine(spec, n) @ m
    keep = [k for k, a in enumerate(axes) if a.get("type") in ("space", "time")]
    for k in set(range(n)) - set(keep):
        if m[k, k] != 1 or np.count_nonzero(m[k]) != 1 or np.count_nonzero(m[:, k]) != 1:
            raise ValueError(f"axis {axes[k]['name']!r} is not mapped to itself")
    names = [axes[k]["name"] for k in keep]
    units = [canonical(axes[k]["unit"]) if axes[k].get("unit") else None for k in keep]
    types = [axes[k].get("type") for k in keep]
    if frame is None:
        frame = ReferenceFrame.anonymous(CoordinateSystem(names, units, axis_types=types))
    source = ArrayCoordinates(names, ["1"] * len(keep), sample_offset=[0.5 if t == "space" else None for t in types])
    t = AffineTransform.from_matrix(m[np.ix_(keep, keep)], source=source, target=frame, translation=m[keep, n])
    return Grid(t, {a: (a, np.arange(shape[k])) for a, k in zip(names, keep, strict=True)})


def ngff_level(grid: Grid, path: str) -> dict[str, Any]:
    """Dataset entry and axes of a grid; only maps without rotation can be written as scale and translation."""
    lattice = grid.lattice()
    m = lattice.matrix
    if np.abs(m - np.diag(np.diag(m))).max() > 0 or (np.diag(m) <= 0).any():
        return {"path": path, "coordinateTransformations": [{"type": "affine", "affine": np.column_stack([m, lattice.origin]).tolist()}]}
    return {
        "path": path,
        "coordinateTransformations": [{"type": "scale", "scale": np.diag(m).tolist()}, {"type": "translation", "translation": lattice.origin.tolist()}],
    }


def ngff_axes(frame: ReferenceFrame) -> list[dict[str, Any]]:
    s = frame.coordinate_system
    return [{"name": a, **({"type": t} if t else {}), **({"unit": udunits_name(u)} if u and u != "1" else {})} for a, u, t in zip(s.axes, s.units, s.axis_types, strict=True)]


# GeoTIFF and CF ------------------------------------------------------------------------------------------


def crs_frame(crs: Mapping[str, Any]) -> ReferenceFrame:
    """The frame of a projected reference system; an authority's code declares it, otherwise it is anonymous.

    ``crs`` has kind, unit, axes (in the authority's order) and, where known, authority and code.
    """
    if crs.get("kind") != "projected":
        raise ValueError(f"a {crs.get('kind')} system is not a projected plane")
    system = CoordinateSystem([a.lower() for a in crs["axes"]], [canonical(crs["unit"])] * 2)
    if crs.get("authority") and crs.get("code"):
        return ReferenceFrame.declared(str(crs["authority"]).lower(), str(crs["code"]), system)
    return ReferenceFrame.anonymous(system)


def geotiff_grid(profile: Mapping[str, Any], *, area_or_point: str = "Area") -> Grid:
    """A raster's grid: the affine is moved to pixel centres, axes take the authority's order."""
    frame = crs_frame(profile["crs"])
    a, b, c, d, e, f = (float(x) for x in profile["transform"][:6])
    m = np.array([[b, a], [e, d]])
    half = 0.5 if area_or_point == "Area" else 0.0
    origin = np.array([c, f]) + m @ [half, half]
    if profile["crs"].get("northing_first"):
        m, origin = m[::-1], origin[::-1]
    source = ArrayCoordinates(("row", "column"), ("1", "1"), sample_offset=(0.5, 0.5) if area_or_point == "Area" else None)
    t = AffineTransform.from_matrix(m, source=source, target=frame, translation=origin)
    return Grid(t, {"row": ("row", np.arange(int(profile["height"]))), "column": ("column", np.arange(int(profile["width"])))})


_CF_ROLES = {"longitude": ("degrees_east", "degree_east", "degrees_E", "degree_E"), "latitude": ("degrees_north", "degree_north", "degrees_N", "degree_N")}
_PLAIN_DEGREES, _RADIANS = ("degree", "degrees", "deg"), ("radian", "radians", "rad")


def cf_figure(mapping: Mapping[str, Any] | None) -> dict[str, float] | None:
    """The figure of the Earth that a grid mapping's attributes state; None if they state none. An inverse
    flattening of 0 is a sphere."""
    if mapping is None:
        return None
    if mapping.get("grid_mapping_name") != "latitude_longitude":
        raise ValueError(f"grid mapping {mapping.get('grid_mapping_name')!r} is not latitude_longitude")
    given = {k: float(mapping[k]) for k in ("longitude_of_prime_meridian", "earth_radius", "semi_major_axis", "semi_minor_axis", "inverse_flattening") if k in mapping}
    if given.pop("longitude_of_prime_meridian", 0.0) != 0:
        raise ValueError("longitudes count from another meridian")
    if not all(math.isfinite(v) and v >= 0 for v in given.values()):
        raise ValueError("a figure has finite lengths")
    a, b, inverse = given.get("semi_major_axis"), given.get("semi_minor_axis"), given.get("inverse_flattening")
    if a is None:
        return {"semi_major_axis": given["earth_radius"], "inverse_flattening": 0.0} if "earth_radius" in given else None
    if b is not None and b > a:
        raise ValueError("the minor axis is the longer")
    if inverse is None:
        inverse = 0.0 if b is None or b == a else a / (a - b)
    elif b is not None and abs(a - (a / inverse if inverse else 0.0) - b) > 1e-6 * a:
        raise ValueError("the axes and the flattening disagree")
    return {"semi_major_axis": a, "inverse_flattening": inverse}


def cf_grid(coordinates: Mapping[str, Mapping[str, Any]], *, frame: ReferenceFrame | None = None, figure: Mapping[str, float] | None = None) -> Grid:
    """Longitude and latitude columns with CF attributes: values, units, standard_name and, if given, bounds.

    West- and south-positive labels stay as they are; the transform negates them. Cells that cross the
    seam are unwrapped when their width exceeds half a turn and the label lies outside.
    """
    found: dict[str, tuple[str, float]] = {}
    for name, c in coordinates.items():
        unit = c.get("units", "")
        for role, units in _CF_ROLES.items():
            west = unit in (("degrees_west", "degree_west") if role == "longitude" else ("degrees_south", "degree_south"))
            if c.get("standard_name") == role or unit in units or west:
                if not west and unit not in (*units, *_PLAIN_DEGREES, *_RADIANS):
                    raise ValueError(f"{name!r} is a {role} in {unit!r}")
                if role in found:
                    raise ValueError(f"two coordinates are a {role}")
                found[role] = (name, -1.0 if west else 1.0)
    if set(found) != {"longitude", "latitude"}:
        raise ValueError("a longitude and a latitude are needed")
    kind = "geodetic" if figure and figure.get("inverse_flattening") else "spherical"
    if frame is None:
        own = ["rad" if coordinates[found[r][0]].get("units") in _RADIANS else u for r, u in (("longitude", "degrees_east"), ("latitude", "degrees_north"))]
        system = CoordinateSystem(("longitude", "latitude"), own, representation=kind, axis_roles=("longitude", "latitude"))
        frame = ReferenceFrame.anonymous(system, definition={k: repr(float(v)) for k, v in (figure or {}).items()})
    names, m, intervals, offsets, coords = [], np.zeros((2, 2)), {}, [], {}
    for k, role in enumerate(("longitude", "latitude")):
        name, sign = found[role]
        v = np.asarray(coordinates[name]["values"], float)
        m[k, k] = sign
        names.append(name)
        coords[name] = (name, v)
        offset = 0.5 if coordinates[name].get("bounds") is None else None
        if coordinates[name].get("bounds") is not None:
            b = np.sort(np.asarray(coordinates[name]["bounds"], float), axis=1)
            if role == "longitude":
                turn = 2 * math.pi if coordinates[name].get("units") in _RADIANS else 360.0
                outside = b[:, 1] - b[:, 0] > turn / 2
                up = outside & (np.abs(b[:, 1] - v) < np.abs(v - b[:, 0]))
                b = np.where(outside[:, None], np.where(up[:, None], np.stack([b[:, 1], b[:, 0] + turn], 1), np.stack([b[:, 1] - turn, b[:, 0]], 1)), b)
            share = (v - b[:, 0]) / (b[:, 1] - b[:, 0])
            if np.ptp(share) <= 1e-6:
                offset, intervals[name] = float(np.clip(share.mean(), 0, 1)), b
        offsets.append(offset)
    source = ArrayCoordinates(names, [coordinates[n].get("units") for n in names], sample_offset=offsets)
    t = AffineTransform.from_matrix(m, source=source, target=frame, translation=[0, 0])
    return Grid(t, coords, intervals=intervals or None, dims=names[::-1])


def read_nifti_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, sizes, matrix, sform_code, qform_code) of all .nii files under a path, one task a file's first bytes."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = parse_nifti_header(bytes(data.as_buffer()[:348]))
                rows.append((p, h["dim"][1 : h["dim"][0] + 1], [float(x) for k in ("srow_x", "srow_y", "srow_z") for x in h[k]], h["sform_code"], h["qform_code"]))
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "sizes", "matrix", "sform_code", "qform_code"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.nii").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, sizes array<int>, matrix array<double>, sform_code int, qform_code int")
