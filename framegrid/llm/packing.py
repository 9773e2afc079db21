"""Order-preserving packing by dynamic programming.

Documents become one stream of token ids in table order, each followed by an end id. Windows of at most
``capacity`` ids are cut from the stream; a cut costs the padding it leaves plus a penalty that depends
on where it falls: nothing at a document's end, little at a sentence's end, more elsewhere. The least
total is found exactly. With ``f`` the cost up to a boundary, ``f[j] = penalty[j] + capacity - pos[j] +
min(f[i] + pos[i])`` over the boundaries ``i`` within ``capacity`` before ``j``; that minimum slides
along the stream, so a monotone queue gives every transition in constant amortised time.

A task packs its own rows in blocks of ``block_tokens``: all windows but a block's last are final, the
last is carried into the next block. Memory is thus bounded by the block, whatever the table's size.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from struct import pack as pack_ids
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.llm.common import map_batches

CAPACITY = 2048
END_ID = 1
SENTENCE_PENALTY = 2
WORD_PENALTY = 16
#: Stretches without a sentence's end get a boundary every so many tokens.
WORD_STEP = 32
BLOCK_TOKENS = 1 << 20
PIECES, WORDS = 250_000, 1_000_000
#: Letters before this are Latin; their lower case and composition are the same in every Unicode version.
_NOT_LATIN = "\u0250"
#: ASCII punctuation without the apostrophe, which the tokenizer's contractions begin with.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit values.

    The tokenizer separates white space, letters and other characters before it merges, so a text's ids
    are those of its pieces between spaces and line ends, and a piece of letters with punctuation behind
    it has the ids of both parts. A word of Latin letters that is lower-cased and composed already passes
    the tokenizer's normalisers and splitter unchanged, so it goes to its merge model directly, in the
    byte alphabet that model uses. Ids of pieces and words are kept in bounded caches; what has another
    shape is encoded as it stands, and so is a text that holds a special token's string.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.alphabet = byte_alphabet()
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            if any(c in token for c in ".!?"):
                self.ends[i] = True

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = text.replace("\n", " ").split(" ")
        found = self.pieces
        try:
            return b"".join(map(found.__getitem__, pieces))
        except KeyError:
            self._learn([p for p in dict.fromkeys(pieces) if p not in found])
        return b"".join(map(self.pieces.__getitem__, pieces)) if len(found) <= PIECES else self._restart(pieces)

    def _restart(self, pieces: list[str]) -> bytes:
        """The ids of ``pieces``; the cache of pieces is emptied after them."""
        out = b"".join(map(self.pieces.__getitem__, pieces))
        self.pieces.clear()
        return out

    def _learn(self, pieces: list[str]) -> None:
        parts, new = [], {}
        words = self.words
        for p in pieces:
            core = p.rstrip(_TAIL)
            if core.isalpha() and "Σ" not in core and (low := core.lower()).isalpha():
                tail = p[len(core) :]
            else:
                low, tail = p, ""
            parts.append((p, low, tail))
            if low not in words:
                new[low] = None
            if tail not in words:
                new[tail] = None
        if len(words) > WORDS:
            words.clear()
            new = {x: None for _, low, tail in parts for x in (low, tail)}
        other = []
        for word in new:
            if word.isalpha() and max(word) < _NOT_LATIN and word.islower() and is_normalized("NFC", word):
                mapped = word.encode().decode("latin-1").translate(self.alphabet)
                found = [t.id for t in self.merge(mapped)]
                words[word] = pack_ids(f"<{len(found)}I", *found)
            else:
                other.append(word)
        for word, encoded in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            words[word] = np.array(encoded.ids, "<u4").tobytes()
        for p, low, tail in parts:
            self.pieces[p] = words[low] + words[tail]


def byte_alphabet() -> dict[int, int]:
    """The printable character that byte-level models use for each byte: itself, or the next from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 0x100 + n for n, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that its caches serve all of its tasks."""
    return Encoder(path)


def windows(positions: list[int], penalties: list[int], capacity: int = CAPACITY) -> list[int]:
    """The positions of the best cuts, from positions[0] to positions[-1], both included.

    ``positions`` rise by at most ``capacity``; ``penalties[j]`` is the cost of a cut at positions[j].
    Of equal totals the latest start of each window is taken.
    """
    n = len(positions)
    came, queue = [0] * n, deque([(positions[0], 0)])
    start = positions[0]
    for j in range(1, n):
        p = positions[j]
        while positions[queue[0][1]] < p - capacity:
            queue.popleft()
        value, i = queue[0]
        came[j] = i
        # f[j] + pos[j]: the padding's -pos[j] cancels
        mine = value + capacity + penalties[j]
        while queue and queue[-1][0] >= mine:
            queue.pop()
        queue.append((mine, j))
    out, j = [positions[-1]], n - 1
    while positions[j] > start:
        j = came[j]
        out.append(positions[j])
    return out[::-1]


def _boundaries(tokens: np.ndarray, ends: np.ndarray, doc_ends: list[int]) -> tuple[list[int], list[int]]:
    """(positions, penalties) of all places where a cut may fall, the stream's begin and end included."""
    n = len(tokens)
    penalty = np.full(n + 1, -1, np.int32)
    stops = np.flatnonzero(ends[tokens]) + 1
    penalty[stops] = SENTENCE_PENALTY
    # a sentence does not end before more punctuation
    penalty[stops[(stops < n)][ends[tokens[stops[stops < n]]]]] = -1
    penalty[doc_ends] = 0
    penalty[0] = penalty[n] = 0
    at = np.flatnonzero(penalty >= 0)
    long = np.flatnonzero(np.diff(at) > 2 * WORD_STEP)
    for k in long.tolist():
        penalty[at[k] + WORD_STEP : at[k + 1] - WORD_STEP // 2 : WORD_STEP] = WORD_PENALTY
    at = np.flatnonzero(penalty >= 0)
    return at.tolist(), penalty[at].tolist()


class Packer:
    """Packs a stream of (key, ids) documents; yields (key, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, ends: np.ndarray, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS):
        self.ends, self.capacity, self.block = ends, capacity, max(block_tokens, 4 * capacity)
        self.docs: deque[list] = deque()  # [key, ids left, ids before, ids in all]
        self.size = self.sequence = 0

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        ids += END_ID.to_bytes(4, "little")
        self.docs.append([key, ids, 0, len(ids) // 4])
        self.size += len(ids) // 4
        if self.size >= self.block:
            yield from self.flush(False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        if not self.size:
            return
        tokens = np.frombuffer(b"".join(d[1] for d in self.docs), "<u4")
        doc_ends = np.cumsum([len(d[1]) // 4 for d in self.docs]).tolist()
        cuts = windows(*_boundaries(tokens, self.ends, doc_ends), self.capacity)
        if not last:
            cuts = cuts[:-1]
        for a, b in zip(cuts, cuts[1:], strict=False):
            left, offset = b - a, 0
            while left:
                d = self.docs[0]
                take = min(left, len(d[1]) // 4)
                piece = d[1][: 4 * take]
                yield d[0], d[2], take, zlib.crc32(piece), d[3], self.sequence, offset
                left, offset = left - take, offset + take
                if 4 * take == len(d[1]):
                    self.docs.popleft()
                else:
                    d[1], d[2] = d[1][4 * take :], d[2] + take
            self.size -= b - a
            self.sequence += 1


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    Every row of ``docs`` is packed, in table order and without a shuffle; a null or empty text is its
    end id alone, repeated rows are packed as often as they occur, a null id is passed on, further
    columns are not read, an empty table gives no piece. ``sequence_id`` holds the task's number in its
    upper bits, so a task that runs again makes the same sequences.
    """
    path = path or tokenizer_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        encode = encoder(path)
        packer, base = Packer(encode.ends, capacity, block_tokens), TaskContext.get().partitionId() << 40

        def made(rows):
            rows = [(*r[:5], base + r[5], r[6]) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(7)], names)

        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.extend(packer.add(key, encode(text)))
            yield made(rows)
        yield made(packer.flush())

    schema = ", ".join(f"{x} long" for x in names)
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
