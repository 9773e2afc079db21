"""Quality selection by importance resampling.

Two generative models of hashed word n-grams are counted: one of target texts, one of all raw texts. The
ratio of a document's likelihoods under them is its importance, ``log_ratio``, the sum over its n-grams.
A sample without replacement in proportion to weights is the top k of the log weights plus Gumbel noise.

The weight sampled by is a tempered importance, the ratio to the power of 1 / sqrt(n) for n n-grams
(``log_weight`` = ``log_ratio`` / sqrt(n)): the sum grows with n and its chance part with sqrt(n), so with
the plain ratio a text's length would decide alone, hundreds of nats against noise of about one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrid.llm.common import cut, map_batches

BUCKETS = 10_000
PRIOR = 1_000.0
KEEP_SHARE = 0.75
#: The target model is fitted on so many labelled documents at most.
TARGET_ROWS = 20_000
SEED = 20_240_601
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_IN_WORD = np.array([b > 32 or not (b == 32 or 9 <= b <= 13) for b in range(256)], np.int8)


class Hasher:
    """Buckets of a text's words and word pairs, lower-cased; ASCII white space separates words.

    A word's hash is a polynomial in its bytes, modulo 2**64. Prefix sums of the text's bytes times the
    powers of the base give all words' hashes at once: the difference at a word's two ends, scaled back
    by the power at its start.
    """

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = np.uint64(buckets)
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.up = np.concatenate(([np.uint64(1)], np.full(n, _BASE))).cumprod(dtype=np.uint64)
            self.down = np.concatenate(([np.uint64(1)], np.full(n, _INVERSE))).cumprod(dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = _IN_WORD[data]
        step = np.diff(inside)
        starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if not len(starts):
            return np.zeros(0, np.int64)
        if len(data) >= len(self.up):
            self._grow(2 * len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        h = (sums[stops] - sums[starts]) * self.down[starts] * _MIX
        h ^= h >> np.uint64(29)
        pairs = h[:-1] * _BASE + h[1:]
        pairs ^= pairs >> np.uint64(31)
        return (np.concatenate((h, pairs)) % self.buckets).astype(np.int64)


def ngram_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows of the one string column of ``texts``.

    Each task sends its non-zero buckets once, so the driver gets ``buckets`` sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = Hasher(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += np.bincount(hashed(t), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in map_batches(texts, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log p_target - log p_raw of each bucket.

    The raw model has one count more in each bucket; the target model has ``prior`` counts spread as the
    raw model is, so that an n-gram the few target texts lack tells little.
    """
    q = (raw + 1) / (raw.sum() + len(raw))
    return np.log((target + prior * q) / (target.sum() + prior)) - np.log(q)


def gumbel(id_col: str, seed: int = SEED) -> Column:
    """Standard Gumbel noise that follows from the id and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 12).cast("double")
    return -F.log(-F.log((bits + 0.5) / F.lit(float(1 << 52))))


def _radix_floor(rows: DataFrame, bits: str, k: int) -> tuple[int, int]:
    """(the k-th largest value of the long column ``bits``, how many rows with that value belong to the k).

    Found by ranges of bits: each of four passes counts the rows by the next 16 bits, so the driver gets
    at most 2**16 counts a pass and nothing is sorted. There are at least k rows, and k is at least 1.
    """
    left, prefix = k, 0
    for step in range(4):
        shift = 48 - 16 * step
        part = rows.filter(F.shiftright(bits, shift + 16) == F.lit(prefix)) if step else rows
        counts = part.groupBy(F.shiftright(bits, shift).alias("d")).agg(F.count("*").alias("n")).collect()
        for d, n in sorted(((r["d"], r["n"]) for r in counts), reverse=True):
            if n >= left:
                prefix = d
                break
            left -= n
    return prefix, left


def top(keys: DataFrame, k: int) -> DataFrame:
    """``keys`` (doc_id, gumbel_key) with a boolean ``selected``, true for exactly the k largest keys.

    Of rows with a key equal to the k-th, those that stand first are taken. The rows are written to the
    shared folder first, where they keep their places.
    """
    rows = cut(keys.withColumns({"order_bits": _ordered_bits(F.col("gumbel_key")), "place": F.lit(-1).cast("long") - F.monotonically_increasing_id()}))
    if k <= 0 or rows.count() <= k:
        return rows.drop("order_bits", "place").withColumn("selected", F.lit(k > 0))
    floor, left = _radix_floor(rows, "order_bits", k)
    ties = rows.filter(F.col("order_bits") == F.lit(floor))
    last = _radix_floor(ties, "place", left)[0]
    chosen = (F.col("order_bits") > F.lit(floor)) | (F.col("order_bits") == F.lit(floor)) & (F.col("place") >= F.lit(last))
    return rows.withColumn("selected", chosen).drop("order_bits", "place")


def _ordered_bits(x: Column) -> Column:
    """A long that orders as the finite double ``x`` does, from its value in steps of 2**-40."""
    return F.round(x * F.lit(float(1 << 40))).cast("long")


def target_texts(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(text) of documents that some label calls good and none toxic.

    At most ``target_rows`` of them, those with the least hash of their id, so that their ids can be
    broadcast and no text is shuffled. Labels with a null id are left out and count once an id.
    """
    good = (
        labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("of"))
        .agg(F.max("quality").alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("bad"))
        .filter("good = 1 and bad = 0").select("of")
        .orderBy(F.xxhash64("of"), "of").limit(target_rows)
    )
    return docs.join(F.broadcast(good), F.col("doc_id") == F.col("of"), "left_semi").select("text")


def resample(docs: DataFrame, target: DataFrame, keep_share: float = KEEP_SHARE, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_ratio, log_weight, gumbel_key, selected): one row per row of ``docs``.

    ``target`` has the target texts in a column ``text``. ``log_ratio`` is the log of the ratio of the
    text's likelihoods under both models, ``log_weight`` that divided by the square root of the number of
    n-grams (see above); a null or wordless text has 0 for both from 0 n-grams. Exactly ``keep_share`` of
    the rows, to the next whole row, are selected. Repeated rows and null ids share their noise; of equal
    keys at the end those that stand first are taken. An empty table gives an empty result; a text of any
    length is counted whole; further columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    ratio = spark.sparkContext.broadcast(log_ratio(ngram_counts(target.select("text"), buckets), ngram_counts(texts.select("text"), buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher(buckets)
        for batch in batches:
            n, total = [], []
            for t in batch.column(1).to_pylist():
                at = hashed(t)
                n.append(len(at))
                total.append(float(ratio.value[at].sum()))
            weight = np.array(total) / np.sqrt(np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(weight, pa.float64())], ["doc_id", "n_grams", "log_ratio", "log_weight"]
            )

    scored = map_batches(texts, run, "doc_id long, n_grams long, log_ratio double, log_weight double")
    keyed = scored.withColumn("gumbel_key", F.col("log_weight") + gumbel("doc_id", seed))
    return top(keyed, -(-int(docs.count() * keep_share * 1_000_000) // 1_000_000))
