"""Sketches, bit maps and near duplicates against brute force."""

import random
import re

import numpy as np
import pytest

from tessera.llm import linking, minhash

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, width):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def brute(rows, width, percent):
    sets = sets_of(rows, width)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def edited(r, base, words, most):
    own = list(base)
    for _ in range(r.randrange(0, most + 1)):
        own[r.randrange(len(own))] = r.choice(words)
    return own


def fixture(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for size in (2, 5, 9, 12, 40, 90, 200, 200, 320):
        base = [r.choice(words) for _ in range(size)]
        for k in range(16):
            rows.append((n := n + 1, " ".join(edited(r, base, words, max(1, size // 12))) + (" Tail" if k % 5 == 0 else "")))
    shared = " ".join(words[:50])
    rows += [(n := n + 1, f"{shared} {' '.join(r.choice(words) for _ in range(r.choice((4, 12, 30))))}") for _ in range(40)]
    rows += [(n := n + 1, t) for t in (None, "", "one", "One", "one two", "ONE two", "one two three", " \n", "x y z", "long " * 3000 + "end", "Long " * 2999 + "end")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block", "first", "kept"), [(1, 4096, 8, 1 << 18), (2, 8, 1, 4)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, seed, block, first, kept):
    for name, value in (("BLOCK", block), ("FIRST", first), ("KEPT", kept), ("MEMBERS_PER_TASK", block)):
        monkeypatch.setattr(linking, name, value)
    rows = fixture(seed)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).selectExpr("*", "1 AS node", "2 AS `a.b`", "3 AS key", "4 AS h")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(rows, 2, 80)


def test_null_and_repeated_identifiers(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (2, text + " x"), (2, text + " x"), (None, text.upper().lower()), (None, "alone here now"), (9, None), (10, "  ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(docs).collect()))
    assert got == [(0, 0, True), (0, 2, False), (2, 2, True), (2, 2, True), (3, 2, False), (9, 9, True), (10, 10, True)]


def test_an_empty_table_and_other_names(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(1, "a b c d"), (2, "A b c d")], "`my.id` long, `te.xt` string")
    assert sorted(r["component_id"] for r in minhash.near_duplicates(docs, "my.id", "te.xt").collect()) == [1, 1]


@pytest.mark.parametrize("n", [1, 2, 7, 60, 384, 5000])
def test_every_coordinate_fills_and_agreement_is_the_similarity(n):
    """Mean and spread of the agreement over many pairs of one similarity."""
    r, size = np.random.default_rng(n), minhash.BANDS * minhash.ROWS
    shared, own = max(1, round(0.8 * n)), n - max(1, round(0.8 * n))
    doc, token = [], []
    pairs = 60 if n < 1000 else 12
    for k in range(pairs):
        both = r.integers(0, 1 << 63, shared, dtype=np.uint64)
        for side in range(2):
            token.append(np.concatenate((both, r.integers(0, 1 << 63, own, dtype=np.uint64))))
            doc.append(np.full(n, 2 * k + side))
    table = minhash.sketches(np.concatenate(doc), np.concatenate(token), 2 * pairs)
    assert not (table == np.uint64(0xFFFFFFFFFFFFFFFF)).any()
    agree = (table[::2] == table[1::2]).mean(1)
    jaccard = shared / (shared + 2 * own)
    assert abs(agree.mean() - jaccard) < 5 * np.sqrt(jaccard * (1 - jaccard) / size / pairs) + 0.002
    assert agree.std() < 1.6 * np.sqrt(jaccard * (1 - jaccard) / size) + 1e-9


def test_sketches_do_not_depend_on_the_batch():
    r = np.random.default_rng(5)
    sizes = [0, 3, 40, 900]
    tokens = [r.integers(0, 1 << 63, n, dtype=np.uint64) for n in sizes]
    whole = minhash.sketches(np.repeat(np.arange(4), sizes), np.concatenate(tokens), 4, 48)
    for i, own in enumerate(tokens):
        assert (minhash.sketches(np.zeros(len(own), np.int64), own, 1, 48)[0] == whole[i]).all()


@pytest.mark.parametrize("percent", [80, 90])
def test_bit_maps_rule_out_no_link(percent):
    r = np.random.default_rng(percent)
    base = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (3, 30, 60, 100, 130, 2000)]
    sets = [np.unique(np.concatenate((b[k:], r.integers(0, 1 << 63, k, dtype=np.uint64)))) for b in base for k in (0, 1, len(b) // 20, len(b) // 10, len(b) // 8, len(b) // 2)]
    n = len(sets)
    maps = linking.Maps(list(range(n)), list(range(n)), [len(s) for s in sets], [linking.bit_map(s).tobytes() for s in sets])
    found = np.concatenate(list(linking.passing(maps, maps, percent)))
    passed = {(a, b) for a, _, b, _, _ in found.tolist()}
    links = {(i, j) for i in range(n) for j in range(n) if i != j and linking.linked(sets[i], sets[j], percent)}
    assert links <= passed and len(passed) < 0.2 * n * n
    few, more = linking.fewest(found, 1)
    assert len({tuple(x) for x in np.sort(few[:, [1, 3]], 1).tolist()}) == len(few) and not more
