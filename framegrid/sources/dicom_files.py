"""Headers and pixels of uncompressed DICOM files: one task reads a file, slices are placed by their headers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegrid.operators.framed import FramedDF, frame_table
from framegrid.plans.declare import ReferenceFrame
from framegrid.plans.grid import pos
from framegrid.sources.headers import Stack, dicom_enhanced, dicom_stack, modality_values

# Syntaxes, tags and value kinds of the standard (fixed values).
IMPLICIT, EXPLICIT, DEFLATED, BIG_ENDIAN = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
TAGS = {
    0x00080018: ("SOPInstanceUID", "UI"), 0x0020000E: ("SeriesInstanceUID", "UI"), 0x00200052: ("FrameOfReferenceUID", "UI"), 0x00200032: ("ImagePositionPatient", "DS"),
    0x00200037: ("ImageOrientationPatient", "DS"), 0x00280030: ("PixelSpacing", "DS"), 0x00180050: ("SliceThickness", "DS"), 0x00180088: ("SpacingBetweenSlices", "DS"),
    0x00281052: ("RescaleIntercept", "DS"), 0x00281053: ("RescaleSlope", "DS"), 0x00280008: ("NumberOfFrames", "DS"), 0x00280002: ("SamplesPerPixel", "US"),
    0x00280010: ("Rows", "US"), 0x00280011: ("Columns", "US"), 0x00280100: ("BitsAllocated", "US"), 0x00280103: ("PixelRepresentation", "US"),
    0x52009229: ("SharedFunctionalGroupsSequence", "SQ"), 0x52009230: ("PerFrameFunctionalGroupsSequence", "SQ"), 0x00209113: ("PlanePositionSequence", "SQ"),
    0x00209116: ("PlaneOrientationSequence", "SQ"), 0x00289110: ("PixelMeasuresSequence", "SQ"), 0x00289145: ("PixelValueTransformationSequence", "SQ"),
}
_PIXELS, _ITEM, _ITEM_END, _SEQUENCE_END = 0x7FE00010, 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
_LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}
_UNDEFINED = 0xFFFFFFFF
_MANY = ("ImagePositionPatient", "ImageOrientationPatient", "PixelSpacing")

#: Slices of one series, whose headers are plan metadata.
MAX_SLICES = 65_536


class _Reader:
    """Elements of a byte string in one syntax."""

    def __init__(self, data: bytes, explicit: bool, order: str):
        self.data, self.explicit, self.order, self.at = data, explicit, order, 0

    def _take(self, kind: str) -> Any:
        out = struct.unpack_from(self.order + kind, self.data, self.at)
        self.at += struct.calcsize("=" + kind)
        return out[0] if len(out) == 1 else out

    def _tag(self) -> tuple[int, str, int]:
        """(tag, kind, length) of the element that begins here."""
        group, element = self._take("HH")
        tag = group << 16 | element
        if tag in (_ITEM, _ITEM_END, _SEQUENCE_END):
            return tag, "", self._take("I")
        if not self.explicit:
            return tag, TAGS.get(tag, ("", "UN"))[1], self._take("I")
        kind = self.data[self.at : self.at + 2]
        self.at += 2
        if kind in _LONG:
            self.at += 2
            return tag, kind.decode("latin-1"), self._take("I")
        return tag, kind.decode("latin-1"), self._take("H")

    def _items(self, length: int) -> Iterator[dict[str, Any]]:
        end = len(self.data) if length == _UNDEFINED else self.at + length
        while self.at < end:
            tag, _, size = self._tag()
            if tag == _SEQUENCE_END:
                return
            if tag != _ITEM:
                raise ValueError("a sequence holds something other than items")
            yield self.dataset(len(self.data) if size == _UNDEFINED else self.at + size)

    def dataset(self, end: int) -> dict[str, Any]:
        """Known elements up to ``end`` or the end of an item; of pixels their (place, length)."""
        out: dict[str, Any] = {}
        while self.at + 8 <= end:
            tag, kind, length = self._tag()
            if tag in (_ITEM_END, _SEQUENCE_END):
                break
            if tag == _PIXELS:
                if length == _UNDEFINED:
                    raise ValueError("compressed pixels are not supported")
                out["PixelData"] = (self.at, length)
                self.at += length
                continue
            if kind == "SQ" or length == _UNDEFINED:
                items = list(self._items(length))
                if tag in TAGS:
                    out[TAGS[tag][0]] = items
                continue
            raw = self.data[self.at : self.at + length]
            self.at += length
            if tag not in TAGS:
                continue
            name, known = TAGS[tag]
            if known == "US":
                out[name] = struct.unpack_from(f"{self.order}H", raw)[0]
            elif text := raw.decode("latin-1").strip("\0 "):
                numbers = [float(x) for x in text.split("\\")] if known == "DS" else []
                out[name] = text if known == "UI" else numbers if name in _MANY else numbers[0]
        return out


def parse_dicom(data: bytes) -> tuple[dict[str, Any], bytes, str]:
    """(elements, the bytes that places refer to, byte order) of a file."""
    if data[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    meta = _Reader(data, True, "<")
    meta.at, syntax = 132, EXPLICIT
    while meta.at + 8 <= len(data) and data[meta.at : meta.at + 2] == b"\x02\x00":
        tag, _, length = meta._tag()
        if tag == 0x00020010:
            syntax = data[meta.at : meta.at + length].decode("latin-1").strip("\0 ")
        meta.at += length
    if syntax not in (IMPLICIT, EXPLICIT, DEFLATED, BIG_ENDIAN):
        raise ValueError(f"transfer syntax {syntax} is compressed or not known")
    body = zlib.decompress(data[meta.at :], -15) if syntax == DEFLATED else data[meta.at :]
    order = ">" if syntax == BIG_ENDIAN else "<"
    return _Reader(body, syntax != IMPLICIT, order).dataset(len(body)), body, order


def _group(groups: Mapping[str, Any]) -> dict[str, Any]:
    """The elements of a frame's functional groups, taken out of their sequences."""
    return {name: v for items in groups.values() if isinstance(items, list) for item in items[:1] if isinstance(item, dict) for name, v in item.items()}


def pixels(elements: Mapping[str, Any], body: bytes, order: str, modality_lut: bool = True) -> np.ndarray:
    """(frame, row, column) of a file; with ``modality_lut`` rescaled by slope and intercept."""
    if elements.get("SamplesPerPixel", 1) != 1 or elements["BitsAllocated"] not in (8, 16, 32):
        raise ValueError("pixels have one sample of 8, 16 or 32 bits")
    place, _ = elements["PixelData"]
    shape = (int(elements.get("NumberOfFrames", 1)), elements["Rows"], elements["Columns"])
    kind = f"{order}{'i' if elements.get('PixelRepresentation') else 'u'}{elements['BitsAllocated'] // 8}"
    v = np.frombuffer(body, kind, int(np.prod(shape)), place).reshape(shape).astype(float)
    if not modality_lut:
        return v
    frames = elements.get("PerFrameFunctionalGroupsSequence", [{}] * shape[0])
    shared = _group((elements.get("SharedFunctionalGroupsSequence") or [{}])[0])
    for k, groups in enumerate(frames):
        own = {**elements, **shared, **_group(groups)}
        v[k] = modality_values(v[k], own.get("RescaleSlope", 1.0), own.get("RescaleIntercept", 0.0))
    return v


_HEADER = ("path string, sop string, series string, frame_uid string, position array<double>, orientation array<double>, spacing array<double>, "
           "thickness double, rows int, columns int, frames int")  # fmt: skip


def read_dicom_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a file with the fields that place its slice; fields it lacks are null. Fits ``dicom_order``."""
    names = ("SOPInstanceUID", "SeriesInstanceUID", "FrameOfReferenceUID", "ImagePositionPatient", "ImageOrientationPatient", "PixelSpacing", "SliceThickness", "Rows", "Columns")
    kinds = [pa.string()] * 4 + [pa.list_(pa.float64())] * 3 + [pa.float64()] + [pa.int32()] * 3

    def run(batches):
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = parse_dicom(data.as_py())[0]
                row = [at, *[found.get(n) for n in names], int(found.get("NumberOfFrames", 1))]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _HEADER.split(", ")])

    return _files(spark, path).mapInArrow(run, _HEADER)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _rows(spark: SparkSession, files: DataFrame, places: Mapping[Any, int], many: bool, dims: tuple[str, ...], modality_lut: bool) -> DataFrame:
    """One row a pixel; ``places`` gives a slice's position by its file or, in a file of many, by its frame."""

    def run(batches):
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not many and at not in places:
                    continue
                v = pixels(*parse_dicom(data.as_py()), modality_lut)
                rows, columns = (x.ravel() for x in np.indices(v.shape[1:]))
                for k, image in enumerate(v):
                    slot = places.get(k if many else at)
                    if slot is not None:
                        cols = [np.full(image.size, slot, np.int64), rows.astype(np.int64), columns.astype(np.int64), image.ravel()]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [*[pos(d) for d in dims], "value"])

    return files.mapInArrow(run, ", ".join([*[f"{pos(d)} long" for d in dims], "value double"]))


def read_dicom(spark: SparkSession, path: str, *, series_uid: str | None = None, frame_indices: list[int] | None = None, modality_lut: bool = True,
               frame: ReferenceFrame | None = None) -> tuple[FramedDF, Stack]:
    """A series of single slices, or one multi-frame file, as a framed volume and the stack it came from.

    Headers of the series, one row a slice, come to the driver; pixels do not.
    """
    headers = read_dicom_headers(spark, path)
    if series_uid is not None:
        headers = headers.filter(F.col("series") == series_uid)
    found = headers.limit(MAX_SLICES + 1).collect()
    if len(found) > MAX_SLICES:
        raise ValueError(f"more than {MAX_SLICES} files; choose a series")
    if not found or len({r["series"] for r in found}) != 1:
        raise ValueError("the files are of no series or of several; choose one")
    files, many = _files(spark, path), found[0]["frames"] > 1
    if many:
        if len(found) > 1:
            raise ValueError("a multi-frame object is one file")
        files = files.filter(F.col("path") == found[0]["path"])
        elements = parse_dicom(bytes(files.first()["content"]))[0]
        base = {k: v for k, v in elements.items() if k in ("Rows", "Columns", "FrameOfReferenceUID")}
        shared = base | _group((elements.get("SharedFunctionalGroupsSequence") or [{}])[0])
        frames = [_group(g) for g in elements["PerFrameFunctionalGroupsSequence"]]
        chosen = list(range(len(frames))) if frame_indices is None else list(frame_indices)
        stack = dicom_enhanced(shared, frames, frame_indices=chosen, frame=frame)
        places = {chosen[k]: n for n, k in enumerate(stack.order)}
    else:
        if frame_indices is not None:
            raise ValueError("frames are chosen of a multi-frame object")
        fields = {"ImagePositionPatient": "position", "ImageOrientationPatient": "orientation", "PixelSpacing": "spacing", "Rows": "rows", "Columns": "columns",
                  "SliceThickness": "thickness", "FrameOfReferenceUID": "frame_uid"}
        stack = dicom_stack([{k: r[c] for k, c in fields.items() if r[c] is not None} for r in found], frame=frame)
        places = {found[k]["path"]: n for n, k in enumerate(stack.order)}
    return frame_table(_rows(spark, files, places, many, stack.grid.dims, modality_lut), stack.grid), stack
