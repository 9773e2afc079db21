"""Quality rules: a decision list learned from labelled statistics by sequential covering.

Statistics of each text are counted once. Rules that reject are grown as conjunctions of thresholds on
one part of the labelled rows, by information gain, and pruned on the other; a rule that isn't precise
there is not used. The list is emitted as one ordered ``CASE WHEN`` over the statistics, so scoring is
a Spark expression that can be read, stored and edited.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegrid.llm.common import map_batches

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits")
PREFIX = "framegrid_stat_"
#: At most so many labelled documents, those with the least hash of their id, are learned from.
SAMPLE_ROWS = 8_000
MIN_WORDS = 50
MIN_PRECISION = 0.95
MIN_COVER = 5
MAX_RULES = 16
MAX_CONDITIONS = 4
THRESHOLDS = 48

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"
_TAILS = bytes(range(0x80, 0xC0))


def statistics(data: bytes | None) -> tuple[int, ...]:
    """The values of STATS for one UTF-8 text; all 0 for null.

    Words are runs of other characters than space and tab to carriage return. ``n_dup_lines`` counts the
    \\n-split lines with a word that equal an earlier one, ``n_repeat_words`` the words that lie in a
    three-word window which the text holds twice or more.
    """
    data = data or b""
    words = data.split()
    n = len(words)
    if not n:
        return (0, 0, len(data) - len(data.translate(None, _SYMBOLS)), 0, 0, 0, 0, 0, 0)
    place = {w: i for i, w in enumerate(set(words))}
    repeated = 0
    if n > 3:
        ids = np.fromiter(map(place.__getitem__, words), np.int64, n)
        v = len(place)
        if v < 1 << 21:
            codes = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        else:
            pairs = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)[1]
            codes = pairs * v + ids[2:]
        ordered = np.sort(codes)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            first = np.isin(codes, np.unique(twice))
            inside = np.zeros(n, bool)
            for k in range(3):
                inside[k : n - 2 + k] |= first
            repeated = int(inside.sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        n,
        len(data.translate(None, _SPACE + _TAILS)),
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(place),
        len(data) - len(data.translate(None, bytes(range(65, 91)))),
        len(data) - len(data.translate(None, b"0123456789")),
    )


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a long column for each of STATS, named with PREFIX; no shuffle."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema, *(T.StructField(PREFIX + s, T.LongType(), False) for s in STATS)])

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            cols = np.array(rows, np.int64).reshape(len(rows), len(STATS)).T
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cols)], names=[*batch.schema.names, *(PREFIX + s for s in STATS)])

    return map_batches(docs, run, schema)


def features() -> dict[str, Column]:
    """What rules may test, as expressions over the statistics."""
    s = {k: F.col(PREFIX + k).cast("double") for k in STATS}
    words, chars, lines = (F.greatest(s[k], F.lit(1.0)) for k in ("n_words", "word_chars", "n_lines"))
    return {
        "mean_word_chars": s["word_chars"] / words,
        "symbols_per_word": s["n_symbols"] / words,
        "dup_line_share": s["n_dup_lines"] / lines,
        "repeat_word_share": s["n_repeat_words"] / words,
        # log V / log N hardly depends on a text's length, as the plain share of distinct words does
        "vocabulary_growth": F.log1p(s["n_distinct"]) / F.log1p(words),
        "upper_share": s["n_upper"] / chars,
        "digit_share": s["n_digits"] / chars,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    rejected: int
    clean: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def __str__(self) -> str:
        parts = [f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions]
        return f"reject if {' and '.join(parts)} ({self.rejected} bad, {self.clean} clean)"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a text that none of them holds for is kept."""

    rules: tuple[Rule, ...] = ()

    def fired(self) -> Column:
        """The number of the first rule that rejects, from 1; 0 if none."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            test = F.lit(True)
            for c in rule.conditions:
                test = test & c.column()
            out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - math.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, first: frozenset[str]) -> tuple[list[Condition], str | None]:
    """Conditions added by the greatest gain until no clean row is left, and the feature it began with.

    The first condition tests one of ``first``; of equal gains the first feature, side and threshold in
    their order win. A later, tighter condition on the first one's feature takes its place further back,
    so the list's own first entry need not tell where the rule began.
    """
    live, out, began = np.ones(len(bad), bool), [], None
    while len(out) < MAX_CONDITIONS and (live & ~bad).any():
        p0, n0 = int((live & bad).sum()), int((live & ~bad).sum())
        best: tuple[float, Condition] | None = None
        for name, values in x.items():
            if not out and name not in first:
                continue
            own, is_bad = values[live], bad[live]
            marks = np.unique(np.quantile(own, np.linspace(0, 1, THRESHOLDS)))
            marks = (marks[1:] + marks[:-1]) / 2
            if not len(marks):
                continue
            over = own[None, :] > marks[:, None]
            for above, inside in ((True, over), (False, ~over)):
                gain = _gain((inside & is_bad).sum(1).astype(float), (inside & ~is_bad).sum(1).astype(float), p0, n0)
                k = int(np.argmax(gain))
                if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-12):
                    best = (float(gain[k]), Condition(name, above, float(marks[k])))
        if best is None:
            break
        began = began or best[1].feature
        live &= best[1].holds(x)
        # a tighter threshold on the same side takes the place of the looser one
        out = [c for c in out if (c.feature, c.above) != (best[1].feature, best[1].above)] + [best[1]]
    return out, began


def _prune(conditions: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """The shortest prefix of the conditions with the best worth on rows they were not grown on."""
    best, keep, live = -2.0, 0, np.ones(len(bad), bool)
    for k, c in enumerate(conditions, 1):
        live &= c.holds(x)
        p, n = int((live & bad).sum()), int((live & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best + 1e-12:
            best, keep = worth, k
    return conditions[:keep]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, turn: np.ndarray) -> DecisionList:
    """Rules for the rows marked ``bad``; ``turn`` tells the rows that rules are pruned on.

    A rule that does not hold out takes its starting feature off ``first``, so each rule is tried at most
    once for each feature and learning ends on any labels, noise included.
    """
    rules: list[Rule] = []
    left, first = np.ones(len(bad), bool), frozenset(x)
    while len(rules) < MAX_RULES and first and (left & bad & ~turn).any() and (left & ~bad & ~turn).any():
        of = lambda m: {k: v[m] for k, v in x.items()}
        grow, check = left & ~turn, left & turn
        grown, began = _grow(of(grow), bad[grow], first)
        conditions = _prune(grown, of(check), bad[check])
        if not conditions:
            break
        rule = Rule(tuple(conditions), 0, 0)
        hit, held = rule.holds(x) & left, rule.holds(x) & check
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        everywhere = rule.holds(x)
        wrong = int((everywhere & ~bad).sum())
        if p < MIN_COVER or p < MIN_PRECISION * (p + n) or int((everywhere & bad).sum()) < MIN_PRECISION * int(everywhere.sum()):
            # not precise where it was not grown: begin with another feature
            first -= {began}
            continue
        rules.append(Rule(tuple(conditions), int((hit & bad).sum()), wrong))
        left, first = left & ~hit, frozenset(x)
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learn from at most ``sample_rows`` labelled documents of ``docs``.

    Labels with a null id or quality are left out; a document with several labels counts as good if one
    of them says so; of documents that share an id one is used. Without labelled documents of both
    kinds the list is empty.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
        .filter("id is not null and quality is not null")
        .groupBy("id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")
    stats = with_statistics(texts)
    # of rows that share an id the least statistics count, whichever way the rows lie
    one = stats.groupBy("id").agg(F.min("quality").alias("quality"), F.min(F.struct(*[PREFIX + k for k in STATS])).alias("least")).select("id", "quality", "least.*")
    rows = one.select("id", "quality", *[v.alias(k) for k, v in features().items()]).toPandas().sort_values("id")
    if not len(rows):
        return DecisionList()
    x = {k: rows[k].to_numpy(float) for k in features()}
    turn = (rows["id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(3) == 0
    return learn(x, rows["quality"].to_numpy() == 0, turn)


def base_failed() -> Column:
    words, repeated = F.col(PREFIX + "n_words"), F.col(PREFIX + "n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeated > 50 * words)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """(doc_id, the five base counts, base_failed, rule, kept): one row per row of ``docs``.

    A null or empty text has no words and fails the base. ``rule`` is the number of the rejecting rule,
    0 if none. Repeated rows are judged alike; further columns are not read.
    """
    stats = with_statistics(docs.select("doc_id", "text"))
    fired = rules.fired()
    return stats.select(
        "doc_id",
        *[F.col(PREFIX + s).alias(s) for s in STATS[:5]],
        base_failed().alias("base_failed"),
        fired.alias("rule"),
        (~base_failed() & (fired == 0)).alias("kept"),
    )


def keep(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents that the base and the rules keep, with all their columns and without a shuffle.

    Columns of any name pass through, also those that begin with PREFIX: they are numbered meanwhile.
    """
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    judged = with_statistics(numbered, f"c{docs.columns.index('text')}").filter(~base_failed() & (rules.fired() == 0))
    return judged.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
