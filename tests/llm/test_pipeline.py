"""The pipeline against the stages written out by hand on a small fixture."""

import random
import re
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from tessera.llm import mixing, pieces  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_stages_take_effect_in_order(spark, tmp_path):
    import public_tokenizers

    r = random.Random(2)
    words = [f"word{i}" for i in range(900)]
    base = [" ".join(r.choice(words) for _ in range(80)) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[0].upper(), "en", "s0", 1), (101, base[1] + " one more", "en", "s1", 1), (102, "too short", "en", "s0", 1), (103, None, None, None, None), (104, base[2], "en", "s0", 1)]
    folder = f"{tmp_path}/sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = [(13 + 4 - 2, set(range(12)) | {100, 101, 104}), (13, set(range(12)) | {101}), (12, set(range(12)))]
    for (name, stage), (_, ids) in zip(corpus_pipeline.STAGES[:3], left, strict=False):
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert {x.doc_id for x in docs.collect()} == ids, name
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, folder).collect()
    sizes = Counter()
    for x in docs.collect():
        sizes[x.source] += len(WORD.findall(x.text))
    taken = Counter()
    for x in mixed:
        taken[x.source] += len(WORD.findall(x.text))
        assert x.n_chars == len(x.text)
    assert taken == {s: int(n) for s, n in mixing.budgets(list(sizes.items())).items()}
    table = pieces.load(public_tokenizers.path(corpus_pipeline.MODEL))
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(table.decode(x.ids) for x in out) == Counter(x.text for x in mixed)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_jaccard", "source_mix", "sentencepiece"]
