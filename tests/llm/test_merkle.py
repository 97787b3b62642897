"""The Merkle manifest against a tree built by hand."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(i, source, lang, n, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(leaves):
    """Root, and for each leaf its steps (siblings before, siblings behind)."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        for leaf, k in enumerate(at):
            steps[leaf].append((runs[k // 8][: k % 8], runs[k // 8][k % 8 + 1 :]))
        at, level = [k // 8 for k in at], [sha("".join(r)) for r in runs]
    return level[0], steps


def brute(rows):
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        lowered = text is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        leaf = leaf_of(i, source, lang, n, text)
        groups[lang].append((i is not None, i or 0, leaf, leaf_of(i, source, lang, n, text.translate(LOWER)) if lowered else leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = [tree([x[2] for x in sorted(groups[g])]) for g in order]
    root, above = tree([r for r, _ in below]) if below else (None, [])
    out = []
    for g, (subroot, steps), over in zip(order, below, above, strict=True):
        for (known, i, leaf, given), own in zip(sorted(groups[g]), steps, strict=True):
            proof = own + over
            for before, behind in proof:
                given = sha("".join([*before, given, *behind]))
            out.append((i if known else None, leaf, subroot, root, sha("".join("".join(b + a) for b, a in proof)), given, given == root))
    return out


def rows_of(n, langs, seed):
    r = random.Random(seed)
    texts = ["Some Text", "", None, "ÀÉ Ünï", "lower only", "x" * 5000 + "Y"]
    out = [(r.randrange(3 * n), r.choice(texts) and f"{r.choice(texts)} {i}", r.choice(langs), r.choice(["s", "é", None]), r.choice([None, i])) for i in range(n)]
    return out + [(None, "No Id", "en", None, None), (None, None, None, None, None), (5, "Twice", "en", "s", 1), (5, "Twice", "en", "s", 1), (5, "Other", "en", "s", 1)]


@pytest.mark.parametrize(("n", "langs", "piece", "leaves"), [(0, ["en"], 4, 4), (300, ["en"], 7, 20), (700, ["en", "en", "en", "de", None, "é", "Z"], 64, 100), (150, [f"l{i}" for i in range(70)], 16, 30)])
def test_proofs_are_those_of_a_tree_by_hand(spark, tmp_path, monkeypatch, n, langs, piece, leaves):
    monkeypatch.setattr(merkle, "PIECE", piece)
    monkeypatch.setattr(merkle, "RANGE_LEAVES", leaves)
    rows = rows_of(n, langs, n)
    spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS leaf", "2 AS `group`", "3 AS `a.b`").write.parquet(f"{tmp_path}/documents.parquet")
    out = [tuple(r) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(out, key=key) == sorted(brute(rows), key=key)


def test_an_empty_table_has_no_proofs(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_one_row_is_its_own_root(spark):
    row = (9, "Text", "en", "s", 4)
    got = merkle.manifest(spark.createDataFrame([row], DOCS)).first()
    assert (got.root, got.subroot, got.proof) == (got.leaf, got.leaf, []) and got.leaf == leaf_of(9, "s", "en", 4, "Text")


@pytest.mark.parametrize(("start", "count", "total"), [(0, 8, 8), (3, 30, 40), (8, 56, 64), (61, 9, 70), (5, 2, 9), (0, 1, 1)])
def test_pieces_build_what_they_can(start, count, total):
    nodes = [sha(str(i)).encode() for i in range(total)]
    levels, seen = merkle.local_levels(nodes[start : start + count], start, total), set()
    for level, (first, hashes, low, high) in enumerate(levels):
        for i in range(first, first + len(hashes)):
            if not low <= i < high:
                seen |= set(range(i * 8**level, min((i + 1) * 8**level, total)))
    assert seen == set(range(start, start + count))  # each leaf is below one ragged node


def test_names_with_dots_and_other_groups(spark):
    docs = spark.createDataFrame([(str(i), i % 3, f"t{i}") for i in range(40)], "`my.id` string, `grp.x` int, `te.xt` string")
    got = merkle.manifest(docs, ident="my.id", group="grp.x", columns=("my.id", "te.xt")).collect()
    assert len(got) == 40 and len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == 3
    spark_fold = merkle.manifest(docs, ident="my.id", group="grp.x", columns=("my.id", "te.xt"))
    assert spark_fold.where(merkle.fold(spark_fold.leaf, spark_fold.proof) == spark_fold.root).count() == 40
