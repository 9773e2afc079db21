"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only where none is configured and all runs on one machine.

    On a cluster a folder of the driver's is out of the executors' sight, so there a missing setting raises.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="framegrid-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    spark = df.sparkSession
    shared_dir(spark)
    return df.checkpoint(eager=True)


#: Rows in an Arrow batch, where the session has Spark's own default of 10,000.
BATCH_ROWS = 500


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: Any) -> DataFrame:
    """``mapInArrow`` in batches fit for whole documents.

    A batch is held several times on its way through the JVM and Python, and documents are long, so the
    session's rows in a batch are lowered from the default; a session's own choice is left alone.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def map_rows(
    df: DataFrame,
    fn: Callable[..., tuple | None],
    schema: str,
    setup: Callable[[], tuple] | None = None,
) -> DataFrame:
    """Apply ``fn(*row)`` to every row of ``df`` and keep what it returns.

    ``fn`` gets the columns as Python values and returns one output tuple, or None to drop the row.
    ``setup`` runs once a task; what it returns is passed to ``fn`` first.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    arrow = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        first = setup() if setup else ()
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            rows = [r for r in (fn(*first, *x) for x in zip(*cols, strict=True)) if r is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t.type) for i, t in enumerate(arrow)], schema=arrow
            )

    return map_batches(df, run, out)


_TYPES = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
}


def _arrow(kind: str) -> pa.DataType:
    if kind in _TYPES:
        return _TYPES[kind]
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    if kind.startswith("struct<"):
        fields, depth, start = [], 0, 7
        for i, ch in enumerate(kind[:-1] + ",", 0):
            depth += (ch == "<") - (ch == ">")
            if ch == "," and depth <= 1:
                name, _, of = kind[start:i].partition(":")
                fields.append((name, _arrow(of)))
                start = i + 1
        return pa.struct(fields)
    raise TypeError(kind)


def utf8(column: str):
    """The bytes of a string column, without a copy on the JVM side."""
    return F.col(column).cast("binary")
