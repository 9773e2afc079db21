"""Relations between frames that DICOM objects state, from their elements as mappings by keyword."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

import numpy as np

from framegrid.functions.transforms import AffineTransform
from framegrid.plans.anatomy import patient_frame
from framegrid.plans.declare import CoordinateSystem, ReferenceFrame

RIGID, RIGID_SCALE, AFFINE = "RIGID", "RIGID_SCALE", "AFFINE"
_DEFORMABLE = "1.2.840.10008.5.1.4.1.1.66.3"
_ISOCENTER = "ISOCENTER"


def checked_matrix(values: Any, kind: str, tolerance: float = 1e-4) -> np.ndarray:
    """A homogeneous matrix given row by row, of the kind it claims to be."""
    if kind not in (RIGID, RIGID_SCALE, AFFINE):
        raise ValueError(f"{kind!r} is no kind of matrix")
    m = np.asarray(values, float)
    if m.size != 16 or not np.isfinite(m).all():
        raise ValueError("a matrix has 16 finite values")
    m = m.reshape(4, 4)
    if np.abs(m[3] - [0, 0, 0, 1]).max() > tolerance:
        raise ValueError("a matrix ends with the row 0 0 0 1")
    linear = m[:3, :3]
    size = np.linalg.norm(linear, axis=0)
    if kind == RIGID and (np.abs(linear.T @ linear - np.eye(3)).max() > tolerance or np.linalg.det(linear) < 0):
        raise ValueError("a rigid matrix is a rotation with a translation")
    if kind == RIGID_SCALE and ((size == 0).any() or np.abs((linear / size).T @ (linear / size) - np.eye(3)).max() > tolerance):
        raise ValueError("a rigid matrix with scale has orthogonal columns")
    return m


def _between(m: np.ndarray, source: ReferenceFrame, target: ReferenceFrame) -> AffineTransform:
    return AffineTransform.from_matrix(m[:3, :3], source=source, target=target, translation=m[:3, 3])


def equipment_transform(elements: Mapping[str, Any], *, tolerance: float = 1e-4) -> AffineTransform | None:
    """The map from the patient to the equipment; None where the object states none.

    Each call makes its own equipment frame: two objects that name one device are not thereby in one space.
    """
    if elements.get("ImageToEquipmentMappingMatrix") is None:
        return None
    if elements.get("EquipmentCoordinateSystemIdentification") != _ISOCENTER:
        raise ValueError(f"the equipment's system must be {_ISOCENTER}")
    if not elements.get("FrameOfReferenceUID"):
        raise ValueError("the object names no frame of reference")
    known = {k: str(elements[k]) for k in ("EquipmentCoordinateSystemIdentification", "Manufacturer", "DeviceSerialNumber") if elements.get(k)}
    system = CoordinateSystem(("x", "y", "z"), ("mm",) * 3, axis_types=("space",) * 3)
    m = checked_matrix(elements["ImageToEquipmentMappingMatrix"], RIGID, tolerance)
    return _between(m, patient_frame(elements["FrameOfReferenceUID"]), ReferenceFrame.anonymous(system, definition=known))


def registrations(elements: Mapping[str, Any], *, tolerance: float = 1e-4) -> tuple[AffineTransform, ...]:
    """The maps of a spatial registration into its own frame, one for each item in their order.

    An item's matrices are multiplied as listed, so the last one acts on a point first.
    """
    if elements.get("SOPClassUID") == _DEFORMABLE:
        raise ValueError("deformable registrations are not supported")
    if not elements.get("FrameOfReferenceUID") or "RegistrationSequence" not in elements:
        raise ValueError("a registration has a frame of reference and items")
    target, out = patient_frame(elements["FrameOfReferenceUID"]), []
    for k, item in enumerate(elements["RegistrationSequence"]):
        if not item.get("FrameOfReferenceUID"):
            raise ValueError(f"item {k} names no frame of reference")
        groups = item.get("MatrixRegistrationSequence") or ()
        if len(groups) != 1 or not groups[0].get("MatrixSequence"):
            raise ValueError(f"item {k} needs one group of matrices")
        parts = [checked_matrix(x.get("FrameOfReferenceTransformationMatrix", ()), x.get("FrameOfReferenceTransformationMatrixType", ""), tolerance) for x in groups[0]["MatrixSequence"]]
        out.append(_between(reduce(np.matmul, parts), patient_frame(item["FrameOfReferenceUID"]), target))
    return tuple(out)
