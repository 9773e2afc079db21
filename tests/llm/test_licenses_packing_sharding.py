"""License scans, packing and sharding against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from framegrid.llm import licenses, packing, sharding

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(words):
    out = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(out)


PARTS = ["MIT", "License", "mit-license", "apache", "license", "general public", "public license", "é", "x1", ", ", "\n", "mitlicense", "general", "𝒜"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30))
def test_base_phrases_are_all_places(parts):
    text = " ".join(parts)
    n, hits = licenses.Scanner(licenses.patterns()).hits(text.encode())
    words = brute_words(text)
    assert n == len(words)
    assert sorted((h.first_word, h.label) for h in hits if h.base) == brute_base(words)


def test_edited_notices_are_verified_with_their_spans():
    rng = random.Random(6)
    scanner = licenses.Scanner(licenses.patterns())
    for phrase, label in licenses.NOTICES:
        k = min(licenses.MAX_EDITS, len(phrase) // licenses.EDIT_EVERY)
        chars = list(phrase)
        for i in rng.sample([i for i, c in enumerate(chars) if c != " "], k):
            chars[i] = "z"
        before = " ".join(f"w{i}" for i in range(50))
        n, hits = scanner.hits(f"{before} {''.join(chars)} after that".encode())
        found = [h for h in hits if h.label == label and not h.base]
        assert found and found[0].edits <= k and found[0].first_word == 50, phrase
        assert found[0].last_word == 50 + len(phrase.split()) - 1
        far = "".join(c if c == " " or rng.random() < 0.5 else "z" for c in phrase)
        _, none = scanner.hits(far.encode())
        whole = regex.search(f"(?:{phrase}){{e<={k}}}", far)
        assert bool([h for h in none if h.label == label and not h.base and h.edits <= k]) <= bool(whole)


def test_pigeonhole_candidates_lose_no_match():
    rng = random.Random(1)
    p = licenses.Pattern(" abcdefgh ijklmnop ", "x", 2, False)
    scanner, fuzzy = licenses.Scanner([p]), regex.compile("(?: abcdefgh ijklmnop ){e<=2}")
    for _ in range(400):
        s = list("abcdefgh ijklmnop")
        for _ in range(rng.randint(0, 4)):
            i, op = rng.randrange(len(s)), rng.random()
            s[i : i + (op < 0.7)] = [] if op < 0.3 else [rng.choice("qxab")]
        text = f" foo {''.join(s)} bar "
        assert bool(scanner.scan(text)) == bool(fuzzy.search(text)), text


def test_notices_back_to_back_keep_all_their_spans():
    scanner = licenses.Scanner([licenses.Pattern(" gnu affero general public license ", "agpl", 2, False)])
    worse, best = "gnu afero general public license", "gnu affero general public license"
    for parts in ([worse, best], [best, worse], [worse, best, worse], [worse, worse], [worse, best, best, worse]):
        found = scanner.scan(f" {' '.join(parts)} ")
        assert [e for _, _, _, e in found] == [int(p == worse) for p in parts]
        assert all(b <= c + 1 for (_, _, b, _), (_, c, _, _) in zip(found, found[1:]))


def test_license_rows(spark):
    rows = [(1, None), (2, ""), (3, "MIT License. the mit\nlicense"), (3, "MIT License. the mit\nlicense"), (None, "apache license"), (4, "Licensed under the Apache Licence, Version 2.0")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, labels string")
    got = licenses.digest(licenses.scan(docs)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert (by[1]["n_words"], by[1]["n_base"], by[1]["first_word"], by[1]["base_labels"], by[1]["score"]) == (0, 0, None, "", 0.0)
    assert (by[3]["n_base"], by[3]["first_word"], by[3]["last_word"], by[3]["labels"]) == (2, 0, 3, "mit")
    assert (by[4]["n_base"], by[4]["base_labels"], by[4]["labels"]) == (0, "", "apache") and 0 < by[4]["score"] < 1
    assert licenses.digest(licenses.scan(docs.limit(0))).count() == 0


# Packing ------------------------------------------------------------------------------------------------


def brute_cost(positions, penalties, capacity):
    best = [0] + [None] * (len(positions) - 1)
    for j in range(1, len(positions)):
        best[j] = min(best[i] + capacity - (positions[j] - positions[i]) + penalties[j] for i in range(j) if best[i] is not None and positions[j] - positions[i] <= capacity)
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10), st.integers(0, 9)), min_size=1, max_size=30), st.integers(10, 25))
def test_windows_have_the_least_cost(steps, capacity):
    positions, penalties = [3], [0]
    for s, p in steps:
        positions.append(positions[-1] + s)
        penalties.append(p)
    cuts = packing.windows(positions, penalties, capacity)
    assert cuts[0] == positions[0] and cuts[-1] == positions[-1]
    price = dict(zip(positions, penalties, strict=True))
    cost = sum(capacity - (b - a) + price[b] for a, b in zip(cuts, cuts[1:], strict=False))
    assert all(b - a <= capacity for a, b in zip(cuts, cuts[1:], strict=False))
    assert cost == brute_cost(positions, penalties, capacity)


TEXTS = ["", "Hello, world. It's 3pm!", "don't can't ’ve", "ÉCOLE naïve Straße ΣΑΣ İstanbul", "a b\tc\rd\x1ce", "<|endoftext|> x", "é café.", "日本語。 テスト", "a  b\n\nc", "x" * 3000, "'s're", "1234 5.6.7", "Ångstrom", "ᄀ ᅡ ᆨ", "a'b c'll.d"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def test_pieces_have_the_tokenizers_ids(tokenizer):
    encode = packing.Encoder(packing.tokenizer_path())
    rng = random.Random(0)
    mixed = [" ".join(rng.choice(TEXTS) for _ in range(5)) for _ in range(40)]
    for t in TEXTS + mixed:
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pieces_of_any_text(text):
    from tokenizers import Tokenizer

    t = getattr(test_pieces_of_any_text, "_t", None) or (Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path()))
    test_pieces_of_any_text._t = t
    assert np.frombuffer(t[1](text), "<u4").tolist() == t[0].encode(text, add_special_tokens=False).ids


def test_every_latin_letter_takes_the_right_path(tokenizer):
    encode = packing.Encoder(packing.tokenizer_path())
    for code in range(0x250):
        for t in (chr(code), f"a{chr(code)}", f"{chr(code)}b", f"a{chr(code)}c."):
            assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, hex(code)


def test_small_caches_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "PIECES", 3)
    monkeypatch.setattr(packing, "WORDS", 3)
    encode = packing.Encoder(packing.tokenizer_path())
    for t in TEXTS * 2:
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_every_id_lies_in_one_piece(spark, tokenizer, block):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["one", "two.", "three", "four!", "five"]) for _ in range(rng.choice([0, 3, 50, 900])))) for i in range(120)]
    rows += [(900, None), (901, ""), (None, "x"), (5, "again"), (902, "word " * 9000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, start string").repartition(3)
    got = packing.pack(docs, block_tokens=block).collect()
    sequences = defaultdict(list)
    for r in got:
        assert r["length"] > 0
        sequences[r["sequence_id"]].append(r)
    used = 0
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        assert sum(r["length"] for r in own) <= 2048
        used += sum(r["length"] for r in own)
    assert used > 0.9 * 2048 * (len(sequences) - 3)
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for i, text in rows:
        if i == 5:
            continue
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[i], key=lambda r: r["start"])
        at = 0
        for r in own:
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sum(r["length"] for r in pieces[5]) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows if i == 5)
    assert packing.pack(docs.limit(0)).count() == 0


# Sharding -----------------------------------------------------------------------------------------------


def brute_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.integers(1, 60))
def test_jump_hash(keys, n):
    got = sharding.jump_hash(np.array(keys, np.uint64), n).tolist()
    assert got == [brute_jump(k, n) for k in keys]
    more = sharding.jump_hash(np.array(keys, np.uint64), n + 1).tolist()
    assert all(b in (a, n) for a, b in zip(got, more, strict=True))


def test_shards(spark):
    rows = [(i, f"t{i % 7}") for i in range(1000)] + [(3, "t3"), (None, None), (-5, "é")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, shard string").repartition(5)
    got = sharding.shard(docs, 16).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        assert r["shard"] == brute_jump((r["doc_id"] or 0) % 2**64, 16)
        assert r["grown_shard"] == brute_jump((r["doc_id"] or 0) % 2**64, 17)
        slots[r["shard"]].append(r)
    for own in slots.values():
        own.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        ids = [r["doc_id"] for r in own if r["doc_id"] is not None]
        assert ids == sorted(ids)
    by = {r["doc_id"]: r for r in got}
    assert (by[None]["size"], by[None]["text_crc32"], by[-5]["size"], by[-5]["text_crc32"]) == (1, 0, 3, zlib.crc32("é".encode()))
    assert max(Counter(r["shard"] for r in got).values()) < 110
    assert sharding.shard(docs.limit(0), 16).count() == 0


def test_every_planted_notice_is_found_also_beside_others():
    """Notices with up to the allowed edits, back to back or apart, in any number; and no label that none is for."""
    rng = random.Random(21)
    scanner = licenses.Scanner(licenses.patterns())
    fuzzy = [p for p in licenses.patterns() if not p.base]
    for _ in range(150):
        words, planted = [], []
        for _ in range(rng.randint(1, 4)):
            words += ["".join(rng.choice("qxzvw") for _ in range(5)) for _ in range(rng.randint(0, 3))]
            p = rng.choice(fuzzy)
            inner = list(p.text.strip())
            places = [k for k, c in enumerate(inner) if c != " "]
            for k in rng.sample(places, rng.randint(0, p.edits)):
                inner[k] = rng.choice("qxzvw")
            planted.append((p.label, len(words)))
            words += "".join(inner).split(" ")
        n, hits = scanner.hits(" ".join(words).encode())
        assert n == len(words)
        found = {(h.label, h.first_word) for h in hits}
        for label, at in planted:
            assert any(x == label and abs(y - at) <= 1 for x, y in found), (planted, sorted(found), words)
