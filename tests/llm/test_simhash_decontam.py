"""Near-duplicates and decontamination against brute force on small tables."""

import itertools
import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from framegrid.llm import decontam, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "Éa", "the", "x y", "\t", "\n", " ", "ß"]), max_size=40))
def test_fingerprint_is_the_majority_of_shingle_bits(parts):
    text = " ".join(parts)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_long_text_takes_the_histogram_path():
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(2000))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_masks_cover_every_pair_within_the_radius(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    assert any(fp & m == other & m for m in simhash.covering_masks(range(64)))


def test_masks_keep_about_half_of_the_bits():
    assert all(30 <= m.bit_count() <= 36 for m in simhash.covering_masks(range(64)))


def union_find(nodes, pairs):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        up[root(a)] = root(b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("bucket", [512, 8])
def test_links_connect_as_all_pairs_do(spark, bucket):
    """Also with buckets so small that the crowded group is split twice."""
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    core = rng.getrandbits(64)
    for _ in range(150):
        x = core
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    want = union_find(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3])
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    rows = simhash.links(df, bucket).collect()
    found = [(r["u"] % 2**64, r["v"] % 2**64) for r in rows]
    assert all((a ^ b).bit_count() for a, b in found)
    got = union_find(fps, found)
    groups = lambda m: sorted(sorted(n for n in fps if m[n] == r) for r in set(m.values()))
    assert groups(want) == groups(got)
    assert len(found) < 20 * len(fps)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in rows], DOCS)


BASE = " ".join(f"w{i}" for i in range(200))


def test_near_duplicates_with_nulls_ties_and_repeats(spark):
    rows = [(5, BASE), (3, BASE + " tail"), (9, None), (8, ""), (8, ""), (11, "one"), (None, BASE), (12, "ONE")]
    got = sorted(((r["id"], r["component_id"]) for r in simhash.near_duplicates(documents(spark, rows)).collect()), key=str)
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert (fps[5] ^ fps[3]).bit_count() <= 3
    assert got == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (8, 8), (11, 11), (None, 3), (12, 11)], key=str)


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark, [(5, BASE), (3, BASE), (3, BASE), (7, "alone here now"), (None, BASE)])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 7]


def test_an_id_in_two_components_loses_only_surplus_rows(spark):
    """Ids repeat with different texts, ids are null, columns have odd names; the map of bits is full or empty."""
    rng = random.Random(13)
    texts = [" ".join(f"{k}-{i}" for i in range(60)) for k in range(12)]
    rows = [(rng.choice([1, 2, 3, 4, None]), rng.choice(texts) + rng.choice(["", " end"])) for _ in range(150)] + [(5, None), (5, ""), (6, "alone")]
    fps = {t: brute_fingerprint(t) for _, t in rows}
    every = sorted(set(fps.values()))
    root = union_find(every, [(a, b) for a, b in itertools.combinations(every, 2) if (a ^ b).bit_count() <= 3])
    docs = documents(spark, rows).withColumnRenamed("source", "a.b").withColumnRenamed("fp", "hash")
    for bits in (simhash.MAP_BITS, 64):
        before, simhash.MAP_BITS = simhash.MAP_BITS, bits
        try:
            kept = simhash.drop_near_duplicates(docs)
            got = [(r[0], r[1]) for r in kept.collect()]
        finally:
            simhash.MAP_BITS = before
        assert kept.columns == docs.columns
        assert sorted(root[fps[t]] for _, t in got) == sorted(set(root.values()))
        for i, t in got:
            least = min((x is None, x or 0) for x, y in rows if root[fps[y]] == root[fps[t]])
            assert (i is None, i or 0) == least


def test_empty_tables(spark):
    assert simhash.drop_near_duplicates(documents(spark, [])).count() == 0
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(documents(spark, [(1, BASE)]), bench).count() == 0
    full = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    assert decontam.contamination(documents(spark, []), full).count() == 0


# Decontamination ------------------------------------------------------------------------------------


def brute_overlaps(item, doc, min_words, identity):
    """The longest run on any diagonal that begins and ends with a match and is dense enough."""
    best = 0
    for d in range(-len(item), len(doc) + 1):
        same = [i for i in range(len(item)) if 0 <= i + d < len(doc) and item[i] == doc[i + d]]
        for a in range(len(same)):
            for b in range(a, len(same)):
                n = same[b] - same[a] + 1
                if b - a + 1 >= identity * n - 1e-9:
                    best = max(best, n)
    return best >= min(min_words, len(item))


def test_best_run_is_the_longest_dense_one():
    import numpy as np

    rng = random.Random(5)
    for _ in range(200):
        same = [rng.random() < 0.7 for _ in range(rng.randint(0, 25))]
        start, n, hits = decontam.best_run(np.array(same, bool), 0.8)
        want = max((b - a + 1 for a in range(len(same)) for b in range(a, len(same)) if same[a] and same[b] and sum(same[a : b + 1]) >= 0.8 * (b - a + 1) - 1e-9), default=0)
        assert n == want
        assert hits == sum(same[start : start + n])


def test_substituted_passages_are_found_and_clean_ones_are_not(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [[word() for _ in range(rng.randint(15, 40))] for _ in range(12)]
    rows, leaked = [], set()
    for i in range(80):
        doc = [word() for _ in range(rng.randint(10, 80))]
        if i % 2:
            item = list(items[i % 12])
            for k in rng.sample(range(1, len(item) - 1), len(item) // 8):
                item[k] = word()
            doc[5:5] = [w.upper() + ("," if rng.random() < 0.2 else "") for w in item]
            leaked.add((i, i % 12))
        rows.append((i, " ".join(doc)))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    docs = documents(spark, rows)
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contamination(docs, bench).collect()}
    brute = {(i, k) for i, t in rows for k, x in enumerate(items) if brute_overlaps(x, [w.decode() for w in decontam.words_of(t.encode())], 13, 0.8)}
    assert found == brute
    assert leaked <= found
    blocks = {(r["doc_id"], r["item_id"]) for r in decontam.contamination(docs, bench, block_words=60).collect()}
    assert blocks == found
    kept = decontam.drop_contaminated(docs, bench, block_words=60)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in found}


def test_decontamination_of_null_empty_and_repeated_rows(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    docs = documents(spark, [(1, None), (2, ""), (3, passage), (3, passage), (None, passage)])
    bench = spark.createDataFrame([(7, passage), (8, passage), (9, None), (None, "")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["n_words"], r["n_match"]) for r in decontam.contamination(docs, bench).collect()), key=str)
    assert got == sorted([(d, i, 20, 20) for d in (3, 3, None) for i in (7, 8)], key=str)


def test_case_and_punctuation_beyond_ascii_do_not_hide_a_leak(spark):
    passage = "Élan « vital » naïve façade cœur été là où ça va très bien ici même aujourd'hui"
    docs = documents(spark, [(1, "xx " + passage.upper().replace("«", "").replace("»", ""))])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert decontam.contamination(docs, bench).count() == 1


def test_every_overlap_with_an_item_of_any_length_is_found():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [[word() for _ in range(n)] for n in (*range(1, 21), 25, 30)]
    index = decontam.Index([(k, " ".join(x).encode()) for k, x in enumerate(items)])
    for k, item in enumerate(items):
        inner = range(1, len(item) - 1)
        most = int(0.2 * len(item) + 1e-9)
        places = list(itertools.combinations(inner, min(most, len(inner))))
        docs = []
        for gone in rng.sample(places, min(len(places), 300)):
            docs.append([word() for _ in range(3)] + [word() if i in gone else w for i, w in enumerate(item)] + [word()])
        found = decontam.overlaps(index, [" ".join(d).encode() for d in docs], 13, 0.8)
        for doc, own in zip(docs, found, strict=True):
            assert brute_overlaps(item, doc, 13, 0.8)
            assert k in [o[0] for o in own], (len(item), doc)


@pytest.mark.parametrize(("n", "identity"), [(4, 0.8), (5, 0.8), (7, 0.8), (10, 0.8), (11, 0.8), (12, 0.8), (15, 0.8), (16, 0.8), (15, 0.7), (14, 0.6)])
def test_masks_meet_every_run_of_an_item(n, identity):
    masks = decontam.masks_of(n, 13, identity)
    for size in range(min(13, n), n + 1):
        for same in itertools.product("01", repeat=size - 2 if size > 1 else 0):
            run = "1" + "".join(same) + "1" if size > 1 else "1"
            if run.count("1") >= identity * size - 1e-9:
                assert any(all(run[p + i] == "1" for i, c in enumerate(m) if c == "1") for m in masks for p in range(size - len(m) + 1)), run


@pytest.mark.parametrize("item", ["中华人民共和国的首都是哪一座城市", "日本で一番高い山の名前は何ですか", "เมืองหลวงของประเทศไทยคือเมืองอะไร"])
def test_items_in_scripts_without_spaces_are_found(spark, item):
    changed = item[:5] + ("x" if item[0] == "เ" else "啊") + item[6:]
    docs = documents(spark, [(1, f"前文{item}。后文"), (2, f"ก่อน {changed}"), (3, item[:4]), (4, "another text, clean")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.contamination(docs, bench).collect()} == {1, 2}
    assert {r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()} == {3, 4}
