"""Labels of carried dimensions: a row for each of them, and the distinct ones of an axis as plan metadata."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a product are dealt by so many parts of the labels.
PARTS = 8
#: Most labels of one axis that the driver holds as plan metadata, 128 MB.
MAX_LABELS = 1 << 24


def with_labels(frame: DataFrame, values: DataFrame, carried: Sequence[str]) -> DataFrame:
    """``frame`` with a row for each distinct combination of the ``carried`` columns of ``values``.

    The result is a product by definition, but it is made by an equal join: labels are dealt to PARTS
    parts and each row asks for all parts. So any number of labels is shuffled and spilled like any
    join, and the optimizer broadcasts them where their measured size is small.
    """
    labels = values.select(*carried).distinct().withColumn("label_part", F.pmod(F.xxhash64(*carried), F.lit(PARTS)).cast("int"))
    asked = frame.withColumn("label_part", F.explode(F.array(*[F.lit(k) for k in range(PARTS)])))
    return asked.join(labels, "label_part").drop("label_part")


def axis_labels(df: DataFrame, name: str) -> np.ndarray:
    """The distinct labels of a column in ascending order, as an array; more than MAX_LABELS raise."""
    found = df.select(name).distinct().limit(MAX_LABELS + 1).toArrow().column(0)
    if len(found) > MAX_LABELS:
        raise ValueError(f"{name!r} has over {MAX_LABELS} labels; an axis of that length is declared by a grid")
    if found.null_count:
        raise ValueError(f"coordinates of {name!r} hold null")
    return np.sort(found.to_numpy())


def numbered(labels: DataFrame, name: str) -> DataFrame:
    """(``name``, number): distinct labels with their place in order: ranked in ranges, shifted by the ranges before."""
    parts = labels.select(name).repartitionByRange(name).withColumn("part", F.spark_partition_id())
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(name)) - 1)
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return ranked.join(before, "part").select(name, (F.col("rank") + F.col("before")).cast("long").alias("number"))
