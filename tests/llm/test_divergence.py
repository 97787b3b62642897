"""Divergence of sources against sums over the whole vocabulary."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import divergence as own

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    rows = [((x[2] or ""), (x[3] or ""), TERM.findall((x[1] or "").translate(LOWER))) for x in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in rows:
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    kept = {lang: sorted(t for t, n in docs[lang].items() if n >= least) for lang in {r[0] for r in rows}}

    def chances(lang, count):
        total = sum(count[t] for t in kept[lang]) + 5 * len(kept[lang])
        return {t: 1 + 10**9 * (count[t] + 5) // total for t in kept[lang]}

    of_lang = {lang: chances(lang, sum((c for (g, _), c in counts.items() if g == lang), Counter())) for lang in kept}
    p = {g: chances(g[0], c) for g, c in counts.items()}
    out = []
    for g in p:
        pairs = [(-sum(abs(p[g][t] - p[h][t]) for t in kept[g[0]]), h[1].encode()) for h in p if h[0] == g[0] and h != g]
        terms = [(of_lang[g[0]][t] - p[g][t], t.encode()) for t in kept[g[0]] if counts[g][t] and p[g][t] > of_lang[g[0]][t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(*g, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(seed, n=240):
    r = random.Random(seed)
    words = ["the", "The", "of", "x1y", "don't", "été", "Été", "漢字", "😀", "end.", "z" * 300, "#*", "A", "rare-one", "\x7f", "ÀB"]
    text = lambda: " ".join(r.choices(words, range(len(words), 0, -1), k=r.randrange(40)))
    return [(i, r.choice([text(), text(), text(), None, ""]), r.choice(["en", "en", "de", None]), r.choice(["hot", "hot", "hot", "b", "é", None, ""]), 1) for i in range(n)]


@pytest.mark.parametrize(("seed", "least", "top", "sent"), [(1, 3, 4, 1 << 18), (2, 12, 50, 4), (3, 1000, 50, 1 << 18)])
def test_values_are_sums_over_the_vocabulary(spark, monkeypatch, seed, least, top, sent):
    monkeypatch.setattr(own, "GATHERED", sent)
    monkeypatch.setattr(own, "SENT", sent)
    rows = rows_of(seed) + rows_of(seed)[:20] + [(900, "only here " * 20_000, "fr", "long", 1), (901, None, "fr", None, 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS term", "2 AS `count`", "3 AS `a.b`", "4 AS value")
    assert sorted(tuple(r) for r in own.divergence(docs, least_docs=least, top=top).collect()) == brute(rows, least, top)


def test_an_empty_table_has_no_groups(spark):
    assert own.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_columns_of_any_name_and_one_source(spark):
    rows = [("a b a", "en", 1), ("b c", "en", 1)]
    got = own.divergence(spark.createDataFrame(rows, "`te.xt` string, `la.ng` string, `so.urce` int"), "la.ng", "so.urce", "te.xt", least_docs=1).collect()
    assert got == []  # one source has no others, and no term is likelier in it than in its language


def test_counts_beyond_nine_digits_stay_exact(spark):
    one = spark.createDataFrame([(8_999_999_999_999, 10**13, 7)], "c long, n long, v long")
    assert one.select(own.probability("c", "n", "v").alias("p")).first().p == 1 + 10**9 * (8_999_999_999_999 + 5) // (10**13 + 35)
