"""Divergence of sources: how far the term probabilities of each two sources of a language lie apart.

An inverted index holds, for each term of a language, the sources that have it (postings). A pair
of sources starts at V times the difference that two zero counts make, and postings correct it. With
p the probability of a term in a source and z that of a term it doesn't have, the correction of a
pair (a, b) for one term is

    (|pa - zb| - |za - zb|) + (|pb - za| - |za - zb|) - 2 overlap,

where overlap is what the ranges [za, pa] and [zb, pb] share. The first two parts depend on a
source's count and on the other source alone, so they are taken once for each distinct count and
multiplied by its terms; terms that both sources have add the third where it isn't zero. No pair
is compared over the whole vocabulary. Terms that a source has more often than its language are
ranked by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, materialise, named, release
from tessera.llm.words import Texts, Words, slices

#: Documents of a language that a kept term is in at least, what is added to each count, the scale of probabilities, terms in a report.
LEAST_DOCS, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Rows of counts that a task gathers before it adds them up, and beyond which sums are sent on.
GATHERED, SENT = 1 << 19, 1 << 18

#: Letters are A-Z, lower-cased, a-z and all bytes above 127; any other byte parts terms.
_TERMS = np.full(256, 32, np.uint8)
_TERMS[128:] = np.arange(128, 256)
_TERMS[[ord(c) for c in LOWER]] = _TERMS[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]


def term_counts(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, count, docs of a batch of lang, source, text."""
    texts = Texts(batch.column("text"))
    texts.bytes = _TERMS[texts.bytes]
    words = Words(texts)
    langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    of_doc = langs.indices.to_numpy() * np.int64(len(sources.dictionary)) + sources.indices.to_numpy()
    distinct = max(len(words.distinct), 1)
    in_doc, times = np.unique(words.doc * distinct + words.code, return_counts=True)
    rows, place = np.unique(of_doc[in_doc // distinct] * distinct + in_doc % distinct, return_inverse=True)
    group, term = rows // distinct, rows % distinct
    return pa.table(
        {
            "lang": langs.dictionary.take(pa.array(group // max(len(sources.dictionary), 1))),
            "source": sources.dictionary.take(pa.array(group % max(len(sources.dictionary), 1))),
            "term": words.distinct.take(pa.array(term)).cast(pa.large_string()),
            "count": np.bincount(place, weights=times, minlength=len(rows)).astype(np.int64),
            "docs": np.bincount(place, minlength=len(rows)).astype(np.int64),
        }
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of term_counts(): a task sends a term of a group on once, or again for each SENT rows that it holds."""
    held, rows = [], 0

    def added() -> pa.Table:
        summed = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("count", "sum"), ("docs", "sum")])
        return summed.rename_columns(["lang", "source", "term", "count", "docs"])

    for batch in batches:
        for part in slices(batch, "text"):
            held.append(term_counts(part))
            rows += held[-1].num_rows
            if rows >= GATHERED:
                held = [added()]
                rows = held[0].num_rows
                if rows >= SENT:
                    yield from held[0].cast(_SHAPE).to_batches(max_chunksize=1 << 14)
                    held, rows = [], 0
    if held:
        yield from added().cast(_SHAPE).to_batches(max_chunksize=1 << 14)


_SHAPE = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])


def probability(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE (count + ADDED) / (total + ADDED x terms)), in whole numbers; 0 without terms."""
    exact = f"1 + ((CAST({count} AS decimal(19, 0)) + {ADDED}) * {SCALE}) div ({total} + {ADDED} * {terms})"
    return F.expr(f"CASE WHEN {terms} = 0 THEN 0L ELSE {exact} END")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language the others (`pair`) and its terms (`term`).

    Null texts, languages and sources count as ''. Terms are runs of A-Z (lower-cased), a-z and
    characters beyond ASCII in whole texts of any length; a language keeps those that are in
    least_docs of its rows. A pair's value is the sum, over the kept terms, of the difference of
    the two sources' probabilities, 0 where no term is kept; all are ranked, the largest first. A
    term's value is how far its probability in the source is above that in the language; the
    first top are ranked. Equal values are ranked by the UTF-8 bytes of the item. Repeated rows
    count each. An empty table gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    own = lambda c: F.coalesce(named(c).cast("string"), F.lit(""))
    slim = docs.select(own(lang).alias("lang"), own(source).alias("source"), named(text).alias("text"))
    sums = [F.sum("count").alias("count"), F.sum("docs").alias("docs")]
    counts = materialise(slim.mapInArrow(_counted, "lang string, source string, term string, count long, docs long").groupBy("lang", "source", "term").agg(*sums), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count")).where(F.col("docs") >= least_docs).select("lang", "term", "lang_count")
    postings = materialise(counts.join(kept, ["lang", "term"]), "postings")
    release(spark, counts)
    # A row a language, and a row a source.
    languages = postings.groupBy("lang", "term").agg(F.first("lang_count").alias("c")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("lang_n"))
    totals = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = slim.select("lang", "source").distinct().join(languages, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["v", "lang_n", "n"])
    groups = materialise(groups.withColumn("zero", probability("0", "n", "v")), "groups")
    scored = postings.join(groups, ["lang", "source"]).withColumns({"p": probability("count", "n", "v"), "q": probability("lang_count", "lang_n", "v")})
    scored = materialise(scored.select("lang", "source", "term", "p", "q", "zero"), "scored")
    release(spark, postings)

    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    apart = F.abs(F.col("zero") - F.col("other_zero"))
    starts = groups.join(other, "lang").where(F.col("source") != F.col("other")).select("lang", "source", "other", (F.col("v") * apart).alias("value"))
    alike = scored.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("terms"))
    one = F.col("terms") * (F.abs(F.col("p") - F.col("other_zero")) - apart)
    single = alike.join(other, "lang").where((F.col("source") != F.col("other")) & (one != 0)).groupBy("lang", "source", "other").agg(F.sum(one).alias("value"))
    second = scored.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("zero").alias("other_zero"))
    overlap = F.least("p", "other_p") - F.greatest("zero", "other_zero")
    both = scored.join(second, ["lang", "term"]).where((F.col("source") < F.col("other")) & (overlap > 0)).groupBy("lang", "source", "other").agg(F.sum(-2 * overlap).alias("value"))
    pairs = starts.unionByName(_both_ways(single)).unionByName(_both_ways(both)).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    pairs = ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value"))
    terms = scored.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.unionByName(ranked(terms).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counts USING (lang, source) GROUP BY ALL),
every AS (
  SELECT g.lang, g.source, k.term, coalesce(counts.c, 0) AS c,
         1 + {SCALE}::HUGEINT * (coalesce(counts.c, 0) + {ADDED}) // (g.n + {ADDED} * l.v) AS p, 1 + {SCALE}::HUGEINT * (k.c + {ADDED}) // (l.n + {ADDED} * l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang LEFT JOIN counts ON counts.lang = g.lang AND counts.source = g.source AND counts.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM every WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM rows)
WHERE part = 'pair' OR rank <= {TOP}
"""
