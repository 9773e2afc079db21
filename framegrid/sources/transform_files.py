"""Registration results: text transform files, parameter files, and their assembly.

Both kinds of file state a map from fixed to moving points, in LPS millimetres.
"""

from __future__ import annotations

import gzip
import math
import re
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

import numpy as np

from framegrid.functions.fields import BSplineTransform, DisplacementFieldTransform
from framegrid.functions.transforms import AffineTransform, DeclaredInversePair, compose
from framegrid.plans.declare import ArrayCoordinates, CoordinateSystem, ReferenceFrame
from framegrid.plans.grid import Grid
from framegrid.sources.blocks import read_whole


def check_space(frame: ReferenceFrame, n: int) -> None:
    """A frame fit for such a file: Cartesian, ``n`` axes, one length unit."""
    if frame.coordinate_system.representation != "cartesian" or len(frame.axes) != n or len(set(frame.units)) != 1:
        raise ValueError(f"{frame} needs {n} Cartesian axes of one unit")


def stage_frames(fixed: ReferenceFrame, moving: ReferenceFrame, n: int, given: Sequence[ReferenceFrame] | None) -> list[ReferenceFrame]:
    """The frames between ``n`` stages: those given, or local ones in the fixed frame's system."""
    if given is not None:
        if len(given) != n - 1:
            raise ValueError(f"{n} stages have {n - 1} frames between them")
        return [fixed, *given, moving]
    return [fixed, *[ReferenceFrame.local(fixed.coordinate_system) for _ in range(n - 1)], moving]


def _centred(matrix: Any, centre: Any, translation: Any, source: ReferenceFrame, target: ReferenceFrame) -> AffineTransform:
    """y = A (x - c) + c + t."""
    m, c = np.asarray(matrix, float), np.asarray(centre, float)
    return AffineTransform.from_matrix(m, source=source, target=target, translation=c - m @ c + np.asarray(translation, float))


def _rotation(axis: int, angle: float) -> np.ndarray:
    i, j = [(1, 2), (2, 0), (0, 1)][axis]
    out = np.eye(3)
    out[i, i] = out[j, j] = math.cos(angle)
    out[j, i] = math.sin(angle)
    out[i, j] = -out[j, i]
    return out


def euler_3d(x: float, y: float, z: float, zyx: bool) -> np.ndarray:
    rx, ry, rz = (_rotation(k, a) for k, a in enumerate((x, y, z)))
    return rz @ ry @ rx if zyx else rz @ rx @ ry


def versor(v: Sequence[float]) -> np.ndarray:
    """The rotation of a unit quaternion given by its vector part."""
    x, y, z = v
    w = math.sqrt(max(0.0, 1 - x * x - y * y - z * z))
    cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + 2 * w * cross + 2 * cross @ cross


def _linear(kind: str, p: list[float], f: list[float], source: ReferenceFrame, target: ReferenceFrame) -> AffineTransform:
    n = len(source.axes)
    c = f[:n] if len(f) >= n else [0.0] * n
    if kind.startswith(("Affine", "MatrixOffset")):
        return _centred(np.reshape(p[: n * n], (n, n)), c, p[n * n :], source, target)
    if kind.startswith("Translation"):
        return AffineTransform.from_matrix(np.eye(n), source=source, target=target, translation=p)
    if kind.startswith("Identity"):
        return AffineTransform.from_matrix(np.eye(n), source=source, target=target, translation=[0.0] * n)
    if kind.startswith(("Euler2D", "Rigid2D")):
        r = _rotation(2, p[0])[:2, :2]
        return _centred(r, c, p[1:3], source, target)
    if kind.startswith("Similarity2D"):
        return _centred(p[0] * _rotation(2, p[1])[:2, :2], c, p[2:4], source, target)
    if kind.startswith("Euler3D"):
        return _centred(euler_3d(*p[:3], zyx=len(f) > 3 and f[3] != 0), c, p[3:6], source, target)
    if kind.startswith("VersorRigid3D"):
        return _centred(versor(p[:3]), c, p[3:6], source, target)
    if kind.startswith("Versor"):
        return _centred(versor(p[:3]), c, [0.0] * 3, source, target)
    if kind.startswith("Similarity3D"):
        return _centred(p[6] * versor(p[:3]), c, p[3:6], source, target)
    if kind.startswith("Scale"):
        return _centred(np.diag(p[:n]), c, [0.0] * n, source, target)
    raise ValueError(f"transform type {kind!r} is not supported")


def parse_itk_text(text: str) -> list[tuple[str, list[float], list[float]]]:
    """(type, parameters, fixed parameters) of each transform of a text file."""
    out: list[tuple[str, list[float], list[float]]] = []
    for line in text.splitlines():
        key, _, rest = line.partition(":")
        if key == "Transform":
            out.append((rest.strip(), [], []))
        elif key in ("Parameters", "FixedParameters"):
            if not out:
                raise ValueError("parameters come before any transform")
            (out[-1][1] if key == "Parameters" else out[-1][2]).extend(float(x) for x in rest.split())
    if not out or not text.lstrip().startswith("#Insight Transform File"):
        raise ValueError("not a transform file")
    return out


def itk_transform(text: str, *, fixed: ReferenceFrame, moving: ReferenceFrame, intermediate_frames: Sequence[ReferenceFrame] | None = None) -> Any:
    """The map of a text file. Of a composite the member that was added last is applied first."""
    parts = parse_itk_text(text)
    if parts[0][0].startswith("CompositeTransform"):
        parts = parts[1:][::-1]
    elif len(parts) > 1:
        raise ValueError("several transforms without a composite have no stated order")
    if not parts:
        raise ValueError("a composite without members")
    frames = stage_frames(fixed, moving, len(parts), intermediate_frames)
    made = []
    for (kind, p, f), a, b in zip(parts, frames, frames[1:], strict=False):
        name, _, size = kind.partition("_")
        n = int(re.search(r"_(\d+)_\d+$", kind)[1]) if re.search(r"_(\d+)_\d+$", kind) else len(a.axes)
        check_space(a, n)
        check_space(b, n)
        if name.startswith("BSplineTransform"):
            made.append(_itk_bspline(p, f, n, a, b))
        else:
            made.append(_linear(name, p, f, a, b))
    return compose(*made)


def _node_grid(sizes: Sequence[int], origin: Any, spacing: Any, direction: Any, frame: ReferenceFrame, offset: float | None = None) -> Grid:
    """Nodes by their array dimensions, last axis first, so values reshape from a file's x-fastest order."""
    n = len(sizes)
    names = [f"n{k}" for k in range(n)]
    m = np.asarray(direction, float).reshape(n, n) * np.asarray(spacing, float)
    t = AffineTransform.from_matrix(m, source=ArrayCoordinates(names, ["1"] * n, sample_offset=[offset] * n), target=frame, translation=origin)
    return Grid(t, {names[k]: (names[k], np.arange(sizes[k])) for k in range(n)}, dims=names[::-1])


def _itk_bspline(p: list[float], f: list[float], n: int, source: ReferenceFrame, target: ReferenceFrame):
    sizes = [int(x) for x in f[:n]]
    grid = _node_grid(sizes, f[n : 2 * n], f[2 * n : 3 * n], f[3 * n :], source)
    values = np.reshape(p, (n, *sizes[::-1]))
    return BSplineTransform(grid, np.moveaxis(values, 0, -1), target=target, exterior="identity")


# Number types of the MATLAB level 4 format (fixed values).
_MAT_TYPES = {0: "f8", 1: "f4", 2: "i4", 3: "i2", 4: "u2", 5: "u1"}


def parse_mat(data: bytes) -> dict[str, np.ndarray]:
    """The full real matrices of a MATLAB level 4 file, by name, each as one run of values."""
    out, at = {}, 0
    while at < len(data):
        order = "<" if int.from_bytes(data[at : at + 4], "little") < 5000 else ">"
        if len(data) < at + 20:
            raise ValueError("not a MATLAB level 4 file")
        kind, rows, columns, imaginary, length = np.frombuffer(data, f"{order}i4", 5, at).tolist()
        machine, other, number, shape = kind // 1000, kind // 100 % 10, kind // 10 % 10, kind % 10
        if machine != (order == ">") or other or number not in _MAT_TYPES or shape or imaginary or length < 1 or min(rows, columns) < 0:
            raise ValueError("not a MATLAB level 4 file of full real matrices")
        dtype, start = np.dtype(f"{order}{_MAT_TYPES[number]}"), at + 20 + length
        if len(data) < start + rows * columns * dtype.itemsize:
            raise ValueError("the file ends within a matrix")
        out[data[at + 20 : start - 1].decode("latin-1")] = np.frombuffer(data, dtype, rows * columns, start).astype(float)
        at = start + rows * columns * dtype.itemsize
    return out


def itk_mat_transform(data: bytes, *, fixed: ReferenceFrame, moving: ReferenceFrame) -> AffineTransform:
    """The linear map of a ``.mat`` file, which holds its parameters by type and ``fixed``."""
    found = parse_mat(data)
    kinds = [k for k in found if k != "fixed"]
    if len(kinds) != 1 or "fixed" not in found or not all(np.isfinite(v).all() for v in found.values()):
        raise ValueError("a file holds one transform and its fixed parameters, all finite")
    name, size = kinds[0].partition("_")[0], re.search(r"_(\d+)_\d+$", kinds[0])
    n = int(size[1]) if size else len(fixed.axes)
    check_space(fixed, n)
    check_space(moving, n)
    return _linear(name, found[kinds[0]].tolist(), found["fixed"].tolist(), fixed, moving)


def displacement_image(data: bytes, *, fixed: ReferenceFrame, moving: ReferenceFrame) -> Any:
    """The field of a NIfTI image of vectors: x + u(x), nothing moved outside its cells. Vectors are in
    LPS, the header's points in RAS."""
    from framegrid.sources.headers import nifti_grid
    from framegrid.sources.nifti_files import voxels

    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    v, nodes = voxels(data), nifti_grid(data[:352], spatial_unit="mm").transform
    n = len(v) if v.ndim == 5 else 0
    if n not in (2, 3) or v.shape[1] != 1 or n == 2 and v.shape[2] != 1:
        raise ValueError("an image of displacements has sizes x, y, z, 1, 3 or x, y, 1, 1, 2")
    check_space(fixed, n)
    check_space(moving, n)
    turn = np.array([-1.0, -1.0, 1.0])
    m, origin = nodes.matrix * turn[:, None], nodes.translation * turn
    if n == 2 and (np.abs(m[2, :2]).max() > 1e-6 or np.abs(m[:2, 2]).max() > 1e-6):
        raise ValueError("a plane of displacements lies across the axes")
    sizes = v.shape[::-1][:n]
    grid = _node_grid(sizes, origin[:n], [1.0] * n, m[:n, :n], fixed, 0.5)
    return DisplacementFieldTransform(grid, np.moveaxis(v.reshape(n, *sizes[::-1]), 0, -1), target=moving, exterior="identity")


def read_itk_transform(path: str, **options: Any) -> Any:
    """A text, ``.mat`` or NIfTI transform file; HDF5 files need a reader that is not here."""
    data = read_whole(path)
    if data is None:
        raise FileNotFoundError(path)
    if path.lower().endswith((".tfm", ".txt")):
        return itk_transform(data.decode(), **options)
    if path.lower().endswith(".mat"):
        return itk_mat_transform(data, **options)
    if path.lower().endswith((".nii", ".nii.gz")):
        return displacement_image(data, **options)
    raise ValueError("transform files are .tfm, .txt, .mat, .nii or .nii.gz; convert others first")


# Parameter files ---------------------------------------------------------------------------------------

_ENTRY = re.compile(r'\(\s*(\w+)\s*((?:"[^"]*"|[^"()])*)\)')


def parse_parameter_text(text: str) -> dict[str, list[Any]]:
    """Entries ``(Name value ...)``; comments begin with ``//``."""
    clean = re.sub(r"//[^\n]*", "", text)
    out: dict[str, list[Any]] = {}
    for name, body in _ENTRY.findall(clean):
        if name in out:
            raise ValueError(f"parameter {name!r} repeats")
        out[name] = [a[1:-1] if a.startswith('"') else float(a) for a in re.findall(r'"[^"]*"|[^\s"]+', body)]
    if not out or _ENTRY.sub("", clean).strip():
        raise ValueError("not a parameter file")
    return out


def parameter_transform(maps: Sequence[Mapping[str, Sequence[Any]]], *, fixed: ReferenceFrame, moving: ReferenceFrame,
                        intermediate_frames: Sequence[ReferenceFrame] | None = None) -> Any:
    """The chain of parameter maps, first applied first."""
    if any(m.get("HowToCombineTransforms", ["Compose"])[0] != "Compose" for m in maps):
        raise ValueError("only composed transforms are supported")
    frames, made = stage_frames(fixed, moving, len(maps), intermediate_frames), []
    for m, a, b in zip(maps, frames, frames[1:], strict=False):
        kind, p = str(m["Transform"][0]), [float(x) for x in m["TransformParameters"]]
        n = int(m["FixedImageDimension"][0])
        check_space(a, n)
        check_space(b, n)
        if kind == "BSplineTransform":
            if m.get("BSplineTransformSplineOrder", [3])[0] not in (3, 3.0):
                raise ValueError("only cubic splines are supported")
            sizes = [int(x) for x in m["GridSize"]]
            grid = _node_grid(sizes, m["GridOrigin"], m["GridSpacing"], np.reshape(m["GridDirection"], (n, n)).T, a)
            # grid indices may begin elsewhere
            if any(m.get("GridIndex", [0] * n)):
                raise ValueError("a grid index other than 0 is not supported")
            made.append(BSplineTransform(grid, np.moveaxis(np.reshape(p, (n, *sizes[::-1])), 0, -1), target=b, exterior="identity"))
            continue
        c = [float(x) for x in m.get("CenterOfRotationPoint", [0.0] * n)]
        names = {"TranslationTransform": "Translation", "AffineTransform": "Affine"}
        if kind == "EulerTransform":
            zyx = str(m.get("ComputeZYX", ["false"])[0]).lower() == "true"
            made.append(_linear("Euler2D" if n == 2 else "Euler3D", p, [*c, float(zyx)] if n == 3 else c, a, b))
        elif kind in names:
            made.append(_linear(names[kind], p, c, a, b))
        elif kind == "SimilarityTransform":
            made.append(_linear("Similarity2D" if n == 2 else "Similarity3D", p, c, a, b))
        else:
            raise ValueError(f"transform {kind!r} is not supported")
    return compose(*made)


def read_parameter_files(paths: Sequence[str], **options: Any) -> Any:
    return parameter_transform([parse_parameter_text(Path(p).read_text()) for p in paths], **options)


def warp_and_affine(warp: Any, affine: AffineTransform, inverse_warp: Any = None) -> Any:
    """A registration of a warp, then an affine map; an inverse warp is a declared inverse, not a proven one."""
    first = DeclaredInversePair(warp, inverse_warp).forward if inverse_warp is not None else warp
    return compose(first, affine)


def lps_frame(identifier: str, n: int = 3) -> ReferenceFrame:
    """A frame for such files when nothing better is known."""
    names = ("x", "y", "z")[:n]
    return ReferenceFrame.declared("registration", identifier, CoordinateSystem(names, ("mm",) * n))
