"""Learned operators: statistics against brute force, held-out accuracy, exact selection."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framegrid.llm import importance, langid, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n\t#*É€𝒜 ")), max_size=60))
def test_statistics(text):
    assert rules.statistics(text.encode())[:5] == brute_statistics(text)


def test_statistics_of_null_and_empty():
    assert rules.statistics(None) == rules.statistics(b"") == (0,) * len(rules.STATS)


def corpus(n=240):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = [word() + ("%%%" if bad and rng.random() < 0.7 else "") for _ in range(rng.randint(60, 120))]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_rules_learn_conjunctions_that_hold_out(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learned = rules.fit(docs.filter("doc_id < 160"), marks)
    assert learned.rules and all(len(r.conditions) >= 1 for r in learned.rules)
    got = {r["doc_id"]: r["kept"] for r in rules.judge(docs.filter("doc_id >= 160"), learned).collect()}
    assert np.mean([got[i] == (i % 3 != 0) for i in range(160, 240)]) > 0.95
    kept = rules.keep(docs, learned)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {i for i in got if got[i]}


def test_decision_list_is_one_ordered_conditional(spark):
    a = rules.Rule((rules.Condition("symbols_per_word", True, 0.5),), 1, 0)
    b = rules.Rule((rules.Condition("mean_word_chars", True, 3.0), rules.Condition("mean_word_chars", False, 9.0)), 1, 0)
    docs = spark.createDataFrame([(1, "aaaa " * 60), (2, "# * " * 40), (3, "ab " * 60), (4, "#aaaa #aaaa " * 30)], "doc_id long, text string")
    got = {r["doc_id"]: r["rule"] for r in rules.judge(docs, rules.DecisionList((a, b))).collect()}
    assert got == {1: 2, 2: 1, 3: 0, 4: 1}


@pytest.mark.parametrize("seed", range(24))
def test_learning_ends_on_labels_that_are_noise(seed):
    """Also where a rule's tightened first condition has moved behind the others."""
    import signal

    rng = np.random.default_rng(seed)
    n = 600
    x = {f"f{k}": np.round(rng.random(n), 2 if seed % 2 else 9) for k in range(7)}
    bad, turn = rng.random(n) < 0.3, rng.random(n) < 0.3

    def late(*_):
        raise TimeoutError("learning does not end")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(20)
    try:
        learned = rules.learn(x, bad, turn)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    assert len(learned.rules) <= rules.MAX_RULES
    for rule in learned.rules:
        hit = rule.holds(x)
        assert (hit & bad).sum() >= rules.MIN_PRECISION * hit.sum()


def test_columns_named_like_statistics_and_with_dots_pass(spark):
    docs = spark.createDataFrame([(1, "word " * 20 + " ".join(f"w{i}" for i in range(80)), 7, 8)], "doc_id long, text string, framegrid_stat_n_words int, `a.b` int")
    kept = rules.keep(docs, rules.DecisionList())
    assert kept.columns == docs.columns
    assert [tuple(r)[2:] for r in kept.collect()] == [(7, 8)]


def test_of_documents_that_share_an_id_the_same_is_learned_from_in_any_order(spark):
    rows, labels = corpus(90)
    rows += [(i, "x " * 70, "en") for i in range(0, 90, 9)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    b = spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string").repartition(5)
    assert rules.fit(a, marks) == rules.fit(b, marks)


@pytest.mark.parametrize("rows", [[], [(1, None, None), (None, "x", "en"), (2, "", "en"), (2, "", "en")]])
def test_operators_take_empty_and_null_rows(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, kept string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.fit(docs, none) == rules.DecisionList()
    assert not any(r["kept"] for r in rules.judge(docs, rules.DecisionList()).collect())
    assert rules.keep(docs, rules.DecisionList()).columns == docs.columns
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] is not None)
    out = importance.resample(docs, importance.target_texts(docs, none))
    assert out.count() == len(rows)


def languages(n=400):
    rng = random.Random(4)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "eéèàg"}
    rows = []
    for i in range(n):
        lang = sorted(letters)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(letters[lang]) for _ in range(4)) for _ in range(30)), lang))
    return rows


def test_language_held_out_accuracy_sparsity_and_calibration(spark):
    rows = languages()
    # Held-out rows lie about their language: nothing may be learned from them.
    told = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    docs = spark.createDataFrame(told, "doc_id long, text string, lang string")
    model = langid.fit(docs, per_lang=60)
    assert model.langs == ("aa", "bb", "cc")
    assert 0 < (model.weights != 0).mean() < 0.2
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i]["held_out"] for i, _ in held)
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, "123 !?"), (2, None), (3, ""), (4, "é")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, model).collect()} | {4: "x"} == {1: "und", 2: "und", 3: "und", 4: "x"}
    kept = langid.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() > 0.9 * len(rows)


def test_the_sample_is_bounded_over_languages_and_copies(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.choice('abcd')}{i % 40}" for _ in range(5)), f"l{i % 40:02d}") for i in range(2000)]
    rows += [(7777, "the same text again", "l00")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept, train = [], langid.train
    try:
        langid.train = lambda found: kept.append(found) or train(found[:50])
        langid.fit(docs, sample_rows=200, max_langs=30)
    finally:
        langid.train = train
    found = kept[0]
    assert 50 < len(found) < 400
    assert len({r[1] for r in found}) <= 30 and sum(r[0] == 7777 for r in found) <= 1


def test_temperature_is_the_minimum_of_the_loss():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(3000, 3)) * 4
    truth = np.array([rng.choice(3, p=langid._softmax(z / 2.5)) for z in logits])
    assert abs(langid._calibrate(logits, truth) - 2.5) < 0.3


# Importance -----------------------------------------------------------------------------------------


def test_word_hashes_follow_from_the_words_alone():
    h = importance.Hasher(1 << 40)
    a, b = h("Alpha beta\ngamma"), h("  alpha\tBETA gamma beta ")
    assert len(a) == 3 + 2 and len(b) == 4 + 3
    assert a[:3].tolist() == b[:3].tolist() and b[1] == b[3]
    assert a[3:].tolist() == b[4:6].tolist()
    assert len(h(None)) == len(h(" \n")) == 0
    assert len(h("é" * 200_000)) == 1
    words = [f"w{i}é" for i in range(5000)]
    assert len(set(h(" ".join(words))[:5000].tolist())) == 5000


def test_top_k_is_exact(spark):
    rng = random.Random(8)
    keys = [(i, rng.gauss(0, 3)) for i in range(500)]
    df = spark.createDataFrame(keys, "doc_id long, gumbel_key double").repartition(7)
    for k in (0, 1, 7, 250, 499, 500, 900):
        got = {r["doc_id"] for r in importance.top(df, k).filter("selected").collect()}
        assert got == {i for i, _ in sorted(keys, key=lambda x: -x[1])[:k]}


def test_top_k_is_exact_under_ties(spark):
    keys = [(i // 3, float(i % 4)) for i in range(120)] + [(None, 2.0)] * 40
    df = spark.createDataFrame(keys, "doc_id long, gumbel_key double").repartition(6)
    for k in (1, 29, 30, 31, 75, 101, 150):
        out = importance.top(df, k).collect()
        assert len(out) == len(keys) and sum(r["selected"] for r in out) == k
        least = min(r["gumbel_key"] for r in out if r["selected"])
        assert all(r["selected"] for r in out if r["gumbel_key"] > least)


def test_weights_are_the_ratio_of_both_models(spark):
    """Against the models counted in plain Python."""
    texts = ["a b a c", "b c d", "a a a a", None, "", "zz a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    target = spark.createDataFrame([("a b c",), ("a a",)], "text string")
    buckets = 64
    grams = lambda t: importance.Hasher(buckets)(t).tolist()
    raw, good = np.ones(buckets), np.zeros(buckets)
    for t in texts:
        for g in grams(t):
            raw[g] += 1
    for t in ("a b c", "a a"):
        for g in grams(t):
            good[g] += 1
    q = raw / raw.sum()
    p = (good + importance.PRIOR * q) / (good.sum() + importance.PRIOR)
    for r in importance.resample(docs, target, 0.5, buckets).collect():
        own = grams(texts[r["doc_id"]])
        want = sum(np.log(p[g] / q[g]) for g in own)
        assert r["n_grams"] == len(own)
        assert abs(r["log_ratio"] - want) < 1e-9 and abs(r["log_weight"] - want / max(1, len(own)) ** 0.5) < 1e-9


def test_target_like_texts_weigh_more(spark):
    rows = [(i, ("good " * 40 + f"x{i}") if i % 2 else ("bad " * 40 + f"y{i}"), "en") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = importance.resample(docs, importance.target_texts(docs, labels), keep_share=0.5).collect()
    assert sum(r["selected"] for r in out) == 50
    assert all((r["log_weight"] > 0) == (r["doc_id"] % 2 == 1) for r in out)
    again = importance.resample(docs.repartition(5), importance.target_texts(docs, labels), keep_share=0.5).collect()
    assert {r["doc_id"] for r in out if r["selected"]} == {r["doc_id"] for r in again if r["selected"]}


def test_counts_cover_every_row(spark):
    docs = spark.createDataFrame([("a b",), ("a",), (None,)], "text string").repartition(3)
    counts = importance.ngram_counts(docs, 1000)
    want = np.zeros(1000, np.int64)
    for t in ("a b", "a"):
        np.add.at(want, importance.Hasher(1000)(t), 1)
    assert counts.tolist() == want.tolist()
