"""Language identification: sparse multinomial logistic regression on character n-grams.

Hashed counts of one to three characters are weighted by TF-IDF and scaled to unit length. The weights
are fitted by follow-the-regularised-leader with an elastic-net penalty, which leaves most of them at
exactly zero; a temperature fitted on rows held back from that calibrates the score.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrid.llm.common import map_batches

BUCKETS = 1 << 15
#: About so many labelled documents of each language are learned from, those with the least hash of id and text,
#: and of all languages together about SAMPLE_ROWS at most, so that what the driver gets does not grow.
SAMPLE_PER_LANG = 600
SAMPLE_ROWS = 24_000
#: Languages that are learned, the most frequent ones: a model has BUCKETS weights for each.
MAX_LANGS = 256
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.8, 1.0, 0.02, 0.01
UNKNOWN = "und"
MIN_SCORE = 0.5
_LETTER = re.compile(r"[^\W\d_]")
_SHIFT = np.uint32(32 - 15)
_M = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the lower-cased text's runs of one to three characters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c <= 32, np.uint32(32), c)
    total = np.bincount((c * _M[0]) >> _SHIFT, minlength=BUCKETS)
    if len(c) > 1:
        total += np.bincount((c[:-1] * _M[1] + c[1:] * _M[2]) >> _SHIFT, minlength=BUCKETS)
    if len(c) > 2:
        total += np.bincount((c[:-2] * _M[3] + c[1:-1] * _M[4] + c[2:] * _M[5]) >> _SHIFT, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its calibrated probability; (``und``, 0) without a letter or a model."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(*ngram_counts(text)) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(min(1.0, p[k]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[int, str, np.ndarray, np.ndarray]]) -> Model:
    """Fit on (id, language, buckets, counts) rows; every fifth by its id's hash only calibrates."""
    langs = tuple(sorted({r[1] for r in rows}))
    k, df = len(langs), np.zeros(BUCKETS)
    for _, _, at, _ in rows:
        df[at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    model = Model(langs, idf, np.zeros((BUCKETS, k)), np.zeros(k))
    fold = [(i * 0x9E3779B97F4A7C15 >> 32) % 5 == 0 for i, *_ in rows]
    number = {lang: j for j, lang in enumerate(langs)}
    data = [(np.append(at, BUCKETS), np.append(model.vector(at, c), 1.0), number[lang]) for _, lang, at, c in rows]
    fitted = [x for x, held in zip(data, fold, strict=True) if not held] or data
    held = [x for x, held in zip(data, fold, strict=True) if held] or data

    def weights(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    rng = np.random.default_rng(7)
    for _ in range(EPOCHS if k > 1 else 0):
        for j in rng.permutation(len(fitted)):
            at, x, y = fitted[j]
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = weights(slice(None))
    logits = np.array([x @ w[at] for at, x, _ in held])
    truth = np.array([y for _, _, y in held])
    temperature = _calibrate(logits, truth) if k > 1 else 1.0
    return Model(langs, idf, w[:-1], w[-1], temperature)


def _calibrate(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        return -float(np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(truth)), truth], 1e-12)).mean())

    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, sample_rows: int = SAMPLE_ROWS, max_langs: int = MAX_LANGS) -> Model:
    """Learn from about ``per_lang`` documents of each language among those that are not held out.

    Rows with a null id, text or language, or without a letter, are left out, and rows that repeat id,
    text and language count once. With many languages fewer documents of each are taken, so that all are
    about ``sample_rows`` at most, and beyond ``max_langs`` languages the most frequent are learned (of
    equally frequent ones the first in their order). Executors turn the chosen texts into n-gram counts;
    the driver gets those alone, at most BUCKETS of them for a document.
    """
    usable = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.col("lang").cast("string").alias("lang")).filter(
        "id is not null and text is not null and lang is not null"
    ).filter(~held_out("id"))
    most = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    if not sizes:
        return Model((), np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0))
    scale, per_lang = 1 << 30, max(1, min(per_lang, sample_rows // len(sizes)))
    limits = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(scale, scale * per_lang // n + 1))])
    # try_element_at gives null, which drops the row, for a language beyond the most frequent
    chosen = usable.filter(F.pmod(F.xxhash64("id", "text"), F.lit(scale)) < F.try_element_at(limits, F.col("lang")))

    def counted(batches):
        for batch in batches:
            rows = [(i, lang, *ngram_counts(t)) for i, t, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True) if _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2].astype(np.int32).tobytes() for r in rows], pa.binary()),
                    pa.array([r[3].astype(np.int64).tobytes() for r in rows], pa.binary()),
                ],
                ["id", "lang", "at", "counts"],
            )

    rows = map_batches(chosen, counted, "id long, lang string, at binary, counts binary").distinct().collect()
    return train(
        [
            (i, lang, at, counts)
            for i, lang, at, counts in sorted(
                ((r["id"], r["lang"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["counts"], np.int64)) for r in rows), key=lambda r: (r[0], r[1], r[2].tobytes(), r[3].tobytes())
            )
        ]
    ) if rows else Model((), np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of ``docs``, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0. Of equally probable languages the
    first in their order is taken. Repeated rows are predicted alike; a null id is passed on and not held
    out; a text of any length counts whole; further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    thin = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return map_batches(thin, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, min_score: float = MIN_SCORE, accept: Callable[[str], bool] | None = None) -> DataFrame:
    """Documents with a recognised language of at least ``min_score``, all columns kept, no shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(at).to_pylist()]
            mask = [lang != UNKNOWN and score >= min_score and (accept is None or accept(lang)) for lang, score in found]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return map_batches(docs, run, docs.schema)
