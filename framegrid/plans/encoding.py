"""Declarations as versioned JSON, strictly read, and tables that carry them in column metadata.

Large arrays are kept apart by content: an encoded value names ``sha256:...`` and the array is a row of a
side table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, MutableMapping
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegrid.functions import fields, tensors
from framegrid.functions import transforms as tf
from framegrid.operators.framed import FramedDF
from framegrid.plans.declare import ArrayCoordinates, CoordinateSystem, DirectionVocabulary, ReferenceFrame
from framegrid.plans.grid import Grid
from framegrid.plans.sampling import Axis

SCHEMA_VERSION = 1
METADATA_KEY = "framegrid"
#: Arrays of more bytes than this go to the side table if one is given.
INLINE_BYTES = 4096


class EncodingError(ValueError):
    """A value cannot be written or read."""


class UnsupportedVersionError(EncodingError):
    pass


class UnknownKindError(EncodingError):
    pass


class MissingDecoderError(EncodingError):
    pass


class MalformedDataError(EncodingError):
    pass


class DecoderResultError(EncodingError):
    pass


class MissingArrayError(EncodingError):
    pass


def digest(array: np.ndarray) -> str:
    """The content's name: SHA-256 over type and shape, then the little-endian bytes in C order."""
    a = np.ascontiguousarray(array)
    a = a.astype(a.dtype.newbyteorder("<"))
    h = hashlib.sha256(f"{a.dtype.str}:{','.join(map(str, a.shape))}\n".encode())
    h.update(a.tobytes())
    return f"sha256:{h.hexdigest()}"


class _Writer:
    def __init__(self, arrays: MutableMapping[str, np.ndarray] | None):
        self.arrays = arrays

    def array(self, a: Any) -> Any:
        a = np.asarray(a)
        if self.arrays is not None and a.nbytes > INLINE_BYTES:
            name = digest(a)
            self.arrays[name] = a
            return {"ref": name}
        return {"dtype": a.dtype.str.lstrip("<>|="), "shape": list(a.shape), "data": a.ravel().tolist()}

    def value(self, x: Any) -> Any:
        if x is None:
            return None
        for kind, (cls, write, _) in _KINDS.items():
            if type(x) is cls and (kind_of := write(self, x)) is not None and kind_of.get("_kind", kind) == kind:
                return {"kind": kind, **{k: v for k, v in kind_of.items() if k != "_kind"}}
        if hasattr(x, "to_data") and hasattr(x, "kind"):
            if ":" not in x.kind:
                raise EncodingError("the kind of a user's value is '<namespace>:<name>'")
            return {"kind": x.kind, "kind_version": getattr(x, "kind_version", 1), "data": x.to_data()}
        raise UnknownKindError(f"{type(x).__name__} has no encoding")


class _Reader:
    def __init__(self, decoders: Mapping[str, Callable[[Any], Any]], arrays: Mapping[str, np.ndarray]):
        self.decoders, self.arrays = decoders, arrays

    def array(self, d: Any) -> np.ndarray:
        if "ref" in d:
            if d["ref"] not in self.arrays:
                raise MissingArrayError(f"array {d['ref']} is not given")
            a = np.asarray(self.arrays[d["ref"]])
            if digest(a) != d["ref"]:
                raise MalformedDataError(f"array {d['ref']} has other content")
            return a
        return np.array(d["data"], d["dtype"]).reshape(d["shape"])

    def value(self, d: Any) -> Any:
        if d is None:
            return None
        if not isinstance(d, Mapping) or not isinstance(d.get("kind"), str):
            raise MalformedDataError("an encoded value is an object with a kind")
        kind = d["kind"]
        if kind in _KINDS:
            try:
                return _KINDS[kind][2](self, d)
            except (KeyError, TypeError, IndexError, AttributeError) as e:
                raise MalformedDataError(f"{kind} is malformed: {e}") from e
        if ":" in kind:
            if kind not in self.decoders:
                raise MissingDecoderError(f"no decoder for {kind!r}")
            out = self.decoders[kind](d.get("data"))
            if out is None:
                raise DecoderResultError(f"the decoder of {kind!r} returned nothing")
            return out
        raise UnknownKindError(f"unknown kind {kind!r}")


def _plain(cls: type, *names: str):
    """Writer and reader of a frozen class whose arguments are plain values."""
    return cls, lambda w, x: {n: _jsonable(getattr(x, n)) for n in names}, lambda r, d: cls(*[_tupled(d[n]) for n in names])


def _jsonable(x: Any) -> Any:
    return [_jsonable(i) for i in x] if isinstance(x, tuple) else x


def _tupled(x: Any) -> Any:
    return tuple(_tupled(i) for i in x) if isinstance(x, list) else x


def _system(r: _Reader, d: Any) -> CoordinateSystem:
    return CoordinateSystem(
        d["axes"], d["units"], axis_types=d["axis_types"], representation=d["representation"], vocabulary=r.value(d["vocabulary"]),
        orientation=d["orientation"] if d["vocabulary"] else None, axis_roles=d["axis_roles"],
    )


def _frame(r: _Reader, d: Any) -> ReferenceFrame:
    return ReferenceFrame(tuple(d["identifier"]), r.value(d["coordinate_system"]), _tupled(d["definition"]), _tupled(d["context"]), d["role"], _tupled(d["display"]))


def _grid(r: _Reader, d: Any) -> Grid:
    axes = [Axis(a["name"], a["dim"], r.array(a["values"]), a["offset"], None if a["intervals"] is None else r.array(a["intervals"])) for a in d["axes"]]
    return Grid.of(r.value(d["transform"]), axes, d["dims"])


def _pair(w: _Writer, x: tf.PairedTransform) -> dict:
    return {"pair": w.value(x.pair), "is_forward": x.is_forward}


def _chart(cls: type, *names: str):
    return (
        cls,
        lambda w, x: {"source": w.value(x.source), "target": w.value(x.target), **{n: getattr(x, n) for n in names}},
        lambda r, d: cls(r.value(d["source"]), r.value(d["target"]), **{n: d[n] for n in names}),
    )


def _affine(r: _Reader, d: Any) -> tf.AffineTransform:
    return tf.AffineTransform.from_matrix(r.array(d["matrix"]), source=r.value(d["source"]), target=r.value(d["target"]), translation=r.array(d["translation"]))


def _field(r: _Reader, d: Any) -> fields.FieldTransform:
    return fields.FieldTransform(d["field_kind"], r.value(d["grid"]), r.array(d["values"]), r.value(d["target"]), d["exterior"], d["closed"])


_KINDS: dict[str, tuple[type, Callable[[_Writer, Any], dict], Callable[[_Reader, Any], Any]]] = {
    "direction_vocabulary": (
        DirectionVocabulary,
        lambda w, x: {"identifier": x.identifier, "directions": sorted({min(x.pair(t)) for t in x.directions})},
        lambda r, d: DirectionVocabulary(d["identifier"], d["directions"]),
    ),
    "coordinate_system": (
        CoordinateSystem,
        lambda w, x: {
            "axes": list(x.axes), "units": list(x.units), "axis_types": list(x.axis_types), "representation": x.representation,
            "vocabulary": w.value(x.vocabulary), "orientation": list(x.orientation), "axis_roles": list(x.axis_roles),
        },
        _system,
    ),
    "reference_frame": (
        ReferenceFrame,
        lambda w, x: {
            "identifier": list(x.identifier), "coordinate_system": w.value(x.coordinate_system), "definition": _jsonable(x.definition_items),
            "context": _jsonable(x.context_items), "role": x.role, "display": _jsonable(x.display_items),
        },
        _frame,
    ),
    "array_coordinates": (
        ArrayCoordinates,
        lambda w, x: {"axes": list(x.axes), "units": list(x.units), "axis_types": list(x.axis_types), "sample_offset": list(x.sample_offset)},
        lambda r, d: ArrayCoordinates(d["axes"], d["units"], axis_types=d["axis_types"], sample_offset=d["sample_offset"]),
    ),
    "affine": (
        tf.AffineTransform,
        lambda w, x: {"source": w.value(x.source), "target": w.value(x.target), "matrix": w.array(x.matrix), "translation": w.array(x.translation)},
        _affine,
    ),
    "composite": (
        tf.CompositeTransform,
        lambda w, x: {"transforms": [w.value(t) for t in x.transforms]},
        lambda r, d: tf.CompositeTransform(tuple(r.value(t) for t in d["transforms"])),
    ),
    "spherical_to_cartesian": _chart(tf.SphericalToCartesian),
    "cartesian_to_spherical": _chart(tf.CartesianToSpherical, "longitude_start"),
    "geodetic_to_cartesian": _chart(tf.GeodeticToCartesian, "semi_major", "inverse_flattening"),
    "cartesian_to_geodetic": _chart(tf.CartesianToGeodetic, "longitude_start", "semi_major", "inverse_flattening"),
    "declared_inverse_pair": (
        tf.DeclaredInversePair,
        lambda w, x: {"forward": w.value(x.forward_map), "backward": w.value(x.backward_map)},
        lambda r, d: tf.DeclaredInversePair(r.value(d["forward"]), r.value(d["backward"])),
    ),
    "paired": (tf.PairedTransform, _pair, lambda r, d: tf.PairedTransform(r.value(d["pair"]), d["is_forward"])),
    "field": (
        fields.FieldTransform,
        lambda w, x: {"field_kind": x.kind, "grid": w.value(x.grid), "values": w.array(x.values), "target": w.value(x.target), "exterior": x.exterior, "closed": x.closed},
        _field,
    ),
    "grid": (
        Grid,
        lambda w, x: {
            "transform": w.value(x.transform), "dims": list(x.dims),
            "axes": [{"name": a.name, "dim": a.dim, "values": w.array(a.values), "offset": a.offset, "intervals": None if a.intervals is None else w.array(a.intervals)} for a in x.axes],
        },
        _grid,
    ),
    "tensor_type": _plain(tensors.TensorType, "variance", "odd", "weight", "symmetric", "orthogonal_only"),
    "symmetric_packing": _plain(tensors.SymmetricPacking, "size", "pairs", "off_diagonal"),
}


def encode(value: Any, *, arrays: MutableMapping[str, np.ndarray] | None = None) -> str:
    """Canonical JSON of a declaration; arrays over INLINE_BYTES go to ``arrays`` if it is given."""
    return json.dumps({"schema_version": SCHEMA_VERSION, "value": _Writer(arrays).value(value)}, sort_keys=True, allow_nan=False)


def decode(data: str, *, decoders: Mapping[str, Callable[[Any], Any]] | None = None, arrays: Mapping[str, np.ndarray] | None = None) -> Any:
    """Read what ``encode`` wrote; only the given decoders run for kinds of users."""
    try:
        d = json.loads(data)
    except ValueError as e:
        raise MalformedDataError("not JSON") from e
    if not isinstance(d, dict) or "schema_version" not in d:
        raise MalformedDataError("no schema version")
    if d["schema_version"] != SCHEMA_VERSION:
        raise UnsupportedVersionError(f"version {d['schema_version']} cannot be read")
    return _Reader(decoders or {}, arrays or {}).value(d.get("value"))


# Tables ----------------------------------------------------------------------------------------------


def encode_table(framed: FramedDF, *, arrays: MutableMapping[str, np.ndarray] | None = None) -> DataFrame:
    """The table with its declaration in the metadata of its first value column; Parquet keeps it."""
    note = {"grid": encode(framed.grid, arrays=arrays), "carried": list(framed.carried), "values": list(framed.values)}
    name = framed.values[0] if framed.values else framed.geometry_columns()[0]
    return framed.df.withMetadata(name, {**framed.df.schema[name].metadata, METADATA_KEY: json.dumps(note)})


def decode_table(df: DataFrame, *, decoders: Mapping[str, Callable[[Any], Any]] | None = None, arrays: Mapping[str, np.ndarray] | None = None) -> FramedDF:
    """Bind a table again by its metadata; a raw read is unframed until then."""
    notes = [f.metadata[METADATA_KEY] for f in df.schema.fields if METADATA_KEY in f.metadata]
    if len(notes) != 1:
        raise MalformedDataError("the table carries no declaration" if not notes else "the table carries several declarations")
    note = json.loads(notes[0])
    return FramedDF(df, decode(note["grid"], decoders=decoders, arrays=arrays), tuple(note["carried"]), tuple(note["values"]))


def write_dataset(framed: FramedDF, path: str) -> None:
    """Parquet of the values, and a side table of the arrays that the declaration names."""
    arrays: dict[str, np.ndarray] = {}
    encode_table(framed, arrays=arrays).write.mode("overwrite").parquet(f"{path}/values")
    rows = [(k, a.dtype.str.lstrip("<>|="), list(a.shape), a.astype(a.dtype.newbyteorder("<")).tobytes()) for k, a in arrays.items()]
    framed.df.sparkSession.createDataFrame(rows, "digest string, dtype string, shape array<int>, data binary").write.mode("overwrite").parquet(f"{path}/arrays")


def read_dataset(spark: SparkSession, path: str, *, decoders: Mapping[str, Callable[[Any], Any]] | None = None) -> FramedDF:
    rows = spark.read.parquet(f"{path}/arrays").collect()
    arrays = {r["digest"]: np.frombuffer(bytes(r["data"]), f"<{r['dtype']}").reshape(r["shape"]) for r in rows}
    return decode_table(spark.read.parquet(f"{path}/values"), decoders=decoders, arrays=arrays)


def verify_arrays(table: DataFrame) -> DataFrame:
    """The digests of a side table whose content no longer has them; none for a sound table."""
    kinds = F.concat(F.when(F.col("dtype").isin("i1", "u1", "b1"), F.lit("|")).otherwise(F.lit("<")), "dtype")
    head = F.concat(kinds, F.lit(":"), F.concat_ws(",", F.transform("shape", lambda x: x.cast("string"))), F.lit("\n"))
    own = F.concat(F.lit("sha256:"), F.sha2(F.concat(head.cast("binary"), F.col("data")), 256))
    return table.filter(own != F.col("digest")).select("digest")
