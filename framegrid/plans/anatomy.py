"""Anatomical names of directions, and grid operations that use them."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np

from framegrid.functions.transforms import AffineTransform
from framegrid.plans.declare import ArrayCoordinates, CoordinateSystem, DirectionVocabulary, ReferenceFrame
from framegrid.plans.grid import Grid
from framegrid.plans.sampling import CELLS, SAMPLES, Axis

ASSIGNMENT_TOLERANCE, COVERAGE_TOLERANCE = 1e-6, 1e-9
PATIENT = DirectionVocabulary("anatomy", ("right-to-left", "anterior-to-posterior", "inferior-to-superior"))
#: The letter that a direction increases toward (fixed values).
LETTERS = {
    "R": "left-to-right", "L": "right-to-left", "A": "posterior-to-anterior",
    "P": "anterior-to-posterior", "S": "inferior-to-superior", "I": "superior-to-inferior",
}
LPS, RAS = "LPS", "RAS"
#: Orientations of the dimensions (through-plane first) of standard planes (fixed values).
PLANES = {"axial": "SPL", "coronal": "PIL", "sagittal": "RIP"}


def tokens(orientation: str | Sequence[str]) -> tuple[str, ...]:
    """Direction tokens of letters or tokens; each direction pair once."""
    if isinstance(orientation, str):
        orientation = PLANES.get(orientation, orientation)
        if bad := [c for c in orientation if c not in LETTERS]:
            raise ValueError(f"{bad[0]!r} is not a direction letter")
    out = tuple(LETTERS.get(c, c) for c in orientation)
    if len({PATIENT.pair(t) for t in out}) != len(out):
        raise ValueError("two dimensions point along one direction pair")
    return out


def patient_coordinate_system(orientation: str | Sequence[str] = LPS, unit: str = "mm", *, axes: Sequence[str] = ("x", "y", "z")) -> CoordinateSystem:
    return CoordinateSystem(axes, (unit,) * 3, vocabulary=PATIENT, orientation=tokens(orientation))


def _steps(grid: Grid) -> np.ndarray:
    return grid.lattice().matrix


def _assignment(vectors: np.ndarray) -> tuple[int, ...]:
    """The frame axis of each dimension, one to one, with the greatest sum of |cos|; a tie is refused."""
    cos = np.abs(vectors / np.linalg.norm(vectors, axis=0))
    found = sorted(((sum(cos[p, k] for k, p in enumerate(perm)), perm) for perm in itertools.permutations(range(len(cos)), cos.shape[1])), reverse=True)
    if len(found) > 1 and found[0][0] - found[1][0] <= ASSIGNMENT_TOLERANCE:
        raise ValueError("the grid's orientation is ambiguous")
    return found[0][1]


def orientation_codes(grid: Grid, *, letters: bool = True) -> str | tuple[str, ...]:
    """For each dimension, the direction its index increases toward."""
    system = grid.frame.coordinate_system
    if system.vocabulary is None or any(o is None for o in system.orientation):
        raise ValueError("orientation codes need a frame with oriented axes")
    m = _steps(grid)
    out = [system.orientation[j] if m[j, k] >= 0 else system.vocabulary.opposite(system.orientation[j]) for k, j in enumerate(_assignment(m))]
    if not letters:
        return tuple(out)
    names = {v: k for k, v in LETTERS.items()}
    return "".join(names[t] for t in out)


def reoriented(grid: Grid, orientation: str | Sequence[str]) -> Grid:
    """Dimensions permuted and reversed to the orientation; no sample moves."""
    want, have = tokens(orientation), orientation_codes(grid, letters=False)
    order, flips = [], {}
    for t in want:
        k = next((k for k, h in enumerate(have) if t in PATIENT.pair(h)), None)
        if k is None:
            raise ValueError(f"no dimension lies along {t!r}")
        order.append(grid.dims[k])
        if have[k] != t:
            flips[grid.dims[k]] = slice(None, None, -1)
    return grid.isel(**flips).transpose(*order)


def cardinal_grid(grid: Grid, orientation: str | Sequence[str], *, spacing: float | Sequence[float] | None = None, dims: Sequence[str] = ("k", "j", "i"), cover: str = CELLS) -> Grid:
    """An even grid along the frame's axes that covers all cells (or samples) of ``grid``."""
    system, want = grid.frame.coordinate_system, tokens(orientation)
    axes = []
    for t in want:
        j = next((j for j, o in enumerate(system.orientation) if o is not None and t in system.vocabulary.pair(o)), None)
        if j is None:
            raise ValueError(f"no frame axis lies along {t!r}")
        axes.append((j, 1.0 if system.orientation[j] == t else -1.0))
    m = _steps(grid)
    if spacing is None:
        owner = _assignment(m)
        sizes = np.linalg.norm(m, axis=0)
        steps = [float(sizes[owner.index(j)]) for j, _ in axes]
    else:
        steps = [float(s) for s in (spacing if isinstance(spacing, Sequence) else [spacing] * 3)]
    if any(s <= 0 or not math.isfinite(s) for s in steps):
        raise ValueError("spacing is positive")
    ends = []
    for d in grid.dims:
        axis = grid.axis_along(d)
        before, after = axis.extent(cover)
        ends.append((-before, axis.size - 1 + after))
    corners = grid.points_at(np.array(list(itertools.product(*ends))), domain=cover)
    matrix, origin, coords = np.zeros((3, 3)), np.zeros(3), {}
    for k, ((j, sign), step) in enumerate(zip(axes, steps, strict=True)):
        lo, hi = float(corners[:, j].min()), float(corners[:, j].max())
        width = hi - lo
        n = max(1, math.ceil(width / step - COVERAGE_TOLERANCE)) if cover == CELLS else max(1, math.ceil(width / step - COVERAGE_TOLERANCE) + 1)
        middle = (lo + hi) / 2
        matrix[j, k] = sign * step
        origin[j] = middle - sign * step * (n - 1) / 2
        coords[dims[k]] = (dims[k], np.arange(n))
    source = ArrayCoordinates(dims, ("1",) * 3, sample_offset=(0.5,) * 3)
    return Grid(AffineTransform.from_matrix(matrix, source=source, target=grid.frame, translation=origin), coords)


def patient_frame(uid: str, orientation: str = LPS) -> ReferenceFrame:
    """The frame a Frame of Reference UID names."""
    return ReferenceFrame.declared("dicom", uid, patient_coordinate_system(orientation))


__all__ = ["LPS", "PATIENT", "RAS", "SAMPLES", "Axis", "cardinal_grid", "orientation_codes", "patient_coordinate_system", "patient_frame", "reoriented", "tokens"]
