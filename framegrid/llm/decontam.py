"""Benchmark decontamination by spaced-seed hashing.

A seed hashes the words that a fixed mask selects and ignores the others, so a substituted word in an
ignored place does not hide an overlap. The seeds of every place of every document are joined with the
seeds of the benchmark items; around each hit both texts are compared word by word along the hit's
diagonal, and the best run with substitutions decides.

The masks follow from the item's length, the least run and the identity, so that every overlap holds an
unchanged seed: k substitutions cut a run into k + 1 blocks of equal words, and were all of them of at
most w words, two neighbours would have just w.

The benchmark is the query set: its index is broadcast in blocks of at most ``block_words`` words, each
block held against all documents in one pass, so a benchmark of any size stays within that bound.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.llm.common import map_batches, utf8

MIN_WORDS = 13
MIN_IDENTITY = 0.8
BLOCK_WORDS = 200_000
_PUNCT = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))
_BETWEEN = frozenset("Pc Pd Ps Pe Pi Pf Po Zs Zl Zp".split())
_UPPER = bytes(range(0x41, 0x5B))
_CLEAN = bytes.maketrans(_PUNCT + _UPPER, b" " * len(_PUNCT) + _UPPER.lower())


def _ranges(codes: list[int]) -> str:
    """The code points, ascending, as ranges of a character class."""
    runs = [[c for _, c in g] for _, g in groupby(enumerate(codes), lambda x: x[1] - x[0])]
    return "".join(f"{re.escape(chr(x[0]))}-{re.escape(chr(x[-1]))}" for x in runs)


#: Marks and spaces beyond ASCII, with the break of no width that stands between Thai and Khmer words.
_MARKS = re.compile(f"[{_ranges([c for c in range(0x80, 0x1F000) if c == 0x200B or unicodedata.category(chr(c)) in _BETWEEN])}]")
#: Each character of a script without spaces (Thai, Lao, Tibetan, Burmese, Khmer, kana, Han) with the signs
#: that combine with it.
_UNSPACED = re.compile(
    "[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"
    "\U00020000-\U0003ffff][" + _ranges([c for a, b in ((0xE00, 0x1100), (0x1780, 0x1800), (0x3040, 0x3100)) for c in range(a, b) if unicodedata.category(chr(c))[0] == "M"]) + "]*"
)
_CHUNK_BYTES = 4_000_000
_FILTER_BITS = 22


def words_of(data: bytes | None) -> list[bytes]:
    """Lower-cased words; white space and punctuation separate them. In scripts without spaces each
    character is a word."""
    if not data:
        return []
    if not data.isascii():
        text = data.decode("utf-8", "replace").lower()
        data = _UNSPACED.sub(r" \g<0> ", _MARKS.sub(" ", text)).encode()
    return data.translate(_CLEAN).split()


def _random(n: int, x: int) -> np.ndarray:
    """n odd 64-bit values of a fixed linear congruential sequence."""
    out = []
    for _ in range(n):
        x = (x * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (2**64 - 1)
        out.append((x ^ x >> 31) | 1)
    return np.array(out, np.uint64)


def _seeds(values: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each place of ``values``, a 64-bit value for each word."""
    n = len(values) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    picks = [i for i, c in enumerate(mask) if c == "1"]
    total, part = np.zeros(n, np.uint64), np.empty(n, np.uint64)
    for i, m in zip(picks, _random(len(picks), 0x9E3779B97F4A7C15), strict=True):
        total += np.multiply(values[i : i + n], m, out=part)
    return total


@lru_cache(1 << 16)
def masks_of(n: int, min_words: int = MIN_WORDS, identity: float = MIN_IDENTITY) -> tuple[str, ...]:
    """The masks of which one is met in every overlap with an item of ``n`` words; words that a mask of
    ``1`` selects are hashed, those of ``0`` are ignored."""
    length = np.arange(max(1, min(min_words, n)), n + 1)
    equal = np.maximum(np.ceil(identity * length - 1e-9).astype(np.int64), np.minimum(length, 2))
    blocks = length - equal + 1
    sure = int((-(-equal // blocks)).min())
    # Blocks of at most ``sure`` words, ``lack`` words short of that in all: two neighbours lack nothing.
    lack = sure * blocks - equal
    if ((lack < 0) | (lack < blocks // 2)).all():
        return "1" * (sure + 1), "1" * sure + "0" + "1" * sure
    return ("1" * sure,)


class Index:
    """The words and seeds of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, bytes | None]], min_words: int = MIN_WORDS, identity: float = MIN_IDENTITY):
        split = [(i, words_of(t)) for i, t in items]
        split = [(i, w) for i, w in split if w]
        self.item_ids = [i for i, _ in split]
        self.vocabulary: dict[bytes, int] = {}
        for _, words in split:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.items = [np.array([self.vocabulary[w] for w in words], np.int64) for _, words in split]
        self.values = _random(len(self.vocabulary) + 1, 0x243F6A8885A308D3)
        self.tables = []
        of: dict[str, list[int]] = {}
        for k, x in enumerate(self.items):
            for mask in masks_of(len(x), min_words, identity):
                of.setdefault(mask, []).append(k)
        self.gap = max(map(len, of), default=0)
        for mask, own in of.items():
            seeds = [_seeds(self.values[self.items[k]], mask) for k in own]
            h = np.concatenate([*seeds, np.zeros(0, np.uint64)])
            item = np.repeat(np.array(own), [len(x) for x in seeds])
            place = np.concatenate([*[np.arange(len(x)) for x in seeds], np.zeros(0, np.int64)])
            order = np.argsort(h, kind="stable")
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[h >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables.append((mask, h[order], item[order], place[order].astype(np.int64), maybe))

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place, item, item place) of every seed hit."""
        values = self.values[ids]
        for mask, h, item, place, maybe in self.tables:
            seeds = _seeds(values, mask)
            if not len(seeds) or not len(h):
                continue
            at = np.flatnonzero(maybe[seeds >> np.uint64(64 - _FILTER_BITS)])
            lo, hi = np.searchsorted(h, seeds[at], "left"), np.searchsorted(h, seeds[at], "right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                yield from ((p, k, q) for k, q in zip(item[a:b].tolist(), place[a:b].tolist(), strict=True))


def best_run(same: np.ndarray, identity: float = MIN_IDENTITY) -> tuple[int, int, int]:
    """(start, length, matches) of the longest run that begins and ends with a match and of whose words
    at least ``identity`` match; the first of equals."""
    hits = np.flatnonzero(same)
    if not len(hits):
        return 0, 0, 0
    # A run from hit a to hit b has b-a+1 matches over hits[b]-hits[a]+1 words.
    value = np.arange(len(hits)) - identity * hits
    lowest, best = np.minimum.accumulate(value), (0, 1, 1)
    for b in range(len(hits)):
        a = int(np.searchsorted(-lowest[: b + 1], -(value[b] + 1 - identity + 1e-9), "left"))
        if a <= b and (n := int(hits[b] - hits[a]) + 1) > best[1]:
            best = (int(hits[a]), n, b - a + 1)
    return best


Overlap = tuple[int, int, int, int, int]


def overlaps(index: Index, texts: list[bytes | None], min_words: int, identity: float) -> list[list[Overlap]]:
    """For each text, (item_id, text word, item word, words, matches) of the best overlap with each item."""
    get, starts, parts, size = index.vocabulary.get, [], [], 0
    for t in texts:
        words = words_of(t)
        starts.append(size)
        parts += [np.fromiter(map(get, words, repeat(0)), np.int32, len(words)), np.zeros(index.gap, np.int32)]
        size += len(words) + index.gap
    ids, bounds = np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(starts)
    found: list[set[tuple[int, int]]] = [set() for _ in texts]
    for p, k, q in index.hits(ids):
        found[int(np.searchsorted(bounds, p, "right")) - 1].add((k, p - q))
    out: list[list[Overlap]] = [[] for _ in texts]
    for n in range(len(texts)):
        start, end = starts[n], (starts[n + 1] if n + 1 < len(starts) else size) - index.gap
        best: dict[int, Overlap] = {}
        for k, d in sorted(found[n]):
            item = index.items[k]
            a, b = max(0, start - d), min(len(item), end - d)
            same, least = ids[a + d : b + d] == item[a:b], min(min_words, len(item))
            if np.count_nonzero(same) < identity * least - 1e-9:
                continue
            at, length, matches = best_run(same, identity)
            if length >= least and (k not in best or matches > best[k][4]):
                best[k] = (index.item_ids[k], a + at + d - start, a + at, length, matches)
        out[n] = [best[k] for k in sorted(best)]
    return out


def _chunks(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t or b"")
        if size >= _CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
    yield chunk


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, bytes | None]]]:
    rows, size = [], 0
    for i, t in benchmark.select(F.col(id_col).cast("long"), utf8(text_col)).toLocalIterator():
        t = None if t is None else bytes(t)
        n = len(words_of(t))
        if rows and size + n > block_words:
            yield rows
            rows, size = [], 0
        rows.append((i, t))
        size += n
    if rows:
        yield rows


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    min_words: int = MIN_WORDS,
    identity: float = MIN_IDENTITY,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_match): the best overlap of each document
    with each benchmark item, where one exists.

    An overlap is a run of at least ``min_words`` aligned words (all of a shorter item) that begins and
    ends with equal words and of whose words at least ``identity`` are equal. Null and empty texts
    overlap with nothing; null ids are passed on; repeated rows give repeated results; items with the
    same text each get their row. Every overlap is found, also with an item of one word, which is met
    wherever that word stands. Of equally good overlaps with an item the first diagonal's counts, and the
    first run on it. Texts of any length are read whole; empty tables give an empty result; further
    columns are not read. A block holds whole items, so an item longer than ``block_words`` is a block.
    """
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_match long"
    names = [x.split()[0] for x in schema.split(", ")]
    texts = docs.select(F.col("doc_id").cast("long"), utf8("text"))
    for block in _blocks(benchmark, "item_id", "text", block_words):
        shared = spark.sparkContext.broadcast(Index(block, min_words, identity))

        def search(batches, shared=shared):
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for chunk in _chunks(batch.column(1).to_pylist()):
                    found = overlaps(shared.value, chunk, min_words, identity)
                    rows += [(i, *x) for i, own in zip(ids, found) for x in own]
                    ids = ids[len(chunk) :]
                cols = [pa.array([r[c] for r in rows], pa.int64()) for c in range(6)]
                yield pa.RecordBatch.from_arrays(cols, names)

        part = map_batches(texts, search, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    min_words: int = MIN_WORDS,
    identity: float = MIN_IDENTITY,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without the rows whose text overlaps with an item, all columns kept, no shuffle.

    Null, empty and repeated rows are judged each by its own text; columns of any name pass through.
    """
    spark, at = docs.sparkSession, docs.columns.index("text")
    for block in _blocks(benchmark, "item_id", "text", block_words):
        shared = spark.sparkContext.broadcast(Index(block, min_words, identity))

        def clean(batches, shared=shared):
            for batch in batches:
                keep: list[bool] = []
                for chunk in _chunks(batch.column(at).cast(pa.binary()).to_pylist()):
                    keep += [not x for x in overlaps(shared.value, chunk, min_words, identity)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = map_batches(docs, clean, docs.schema)
    return docs
