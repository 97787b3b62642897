"""Queries of weighting, budgets, splits, interleaving and packing over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import mixing
from tessera.operators.order import first_n, with_ordinal
from tessera.plans.base import query
from tessera.session import table

_ORD = "o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord FROM documents)"


def _ordered(spark, d):
    return with_ordinal(table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), ["doc_id"], ["source"])


def _weighted(name: str, weight: float):
    sql = f"WITH {_ORD} SELECT doc_id, source, unnest(range(1, 1 + (floor(ord * {weight}) - floor((ord - 1) * {weight}))::INT)) AS copy FROM o"

    @query(name, sql)
    def run(spark, d):
        return mixing.weighted_repeat(_ordered(spark, d), weight).select("doc_id", "source", F.col("copy").cast("long").alias("copy"))

    return run


_weighted("weighted_mix_half", 0.5)
_weighted("weighted_mix_2_5", 2.5)


@query("min_length_16", "SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 16")
def min_length_16(spark, d):
    return table(spark, d, "documents").where(F.char_length(T.strip_u(F.col("text"))) >= 16).select("doc_id")


@query("max_docs_per_source", f"WITH {_ORD} SELECT doc_id, source FROM o WHERE ord <= 7")
def max_docs_per_source(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return first_n(docs, ["source"], ["doc_id"], 7)


@query("byte_budget", """WITH b AS (SELECT doc_id, source, strlen(text) + 1 AS bytes FROM documents),
  r AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
  SELECT doc_id, source, bytes FROM r WHERE before < 40000""")  # fmt: skip
def byte_budget(spark, d):
    """Documents of each source until its byte budget is crossed, the crossing one included."""
    rows = table(spark, d, "documents").select("doc_id", "source", (F.octet_length("text") + 1).cast("long").alias("bytes"))
    return mixing.byte_budget(rows, "bytes", ["source"], ["doc_id"], 40_000)


@query("ordinal_split", "SELECT doc_id, CASE WHEN (row_number() OVER (ORDER BY doc_id) - 1) % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM documents")
def ordinal_split(spark, d):
    rows = with_ordinal(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    return mixing.ordinal_split(rows, 10).select("doc_id", "split")


@query("tail_split", """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) > (SELECT count(*) - floor(count(*) * 0.05) FROM documents) THEN 'val' ELSE 'train' END AS split
  FROM documents""")  # fmt: skip
def tail_split(spark, d):
    return mixing.tail_split(table(spark, d, "documents").select("doc_id"), 0.05, ["doc_id"]).select("doc_id", "split")


@query("lane_mix", """WITH b AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'distill' WHEN lang = 'de' THEN 'original' ELSE 'clean' END AS bucket FROM documents),
  o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS ord FROM b), t AS (SELECT ceil(count(*) / 0.6) AS total FROM b WHERE bucket = 'distill')
  SELECT doc_id, bucket FROM o, t WHERE ord <= CASE bucket WHEN 'distill' THEN ord WHEN 'original' THEN round_even(total * 0.35, 0) ELSE round_even(total * 0.05, 0) END""")  # fmt: skip
def lane_mix(spark, d):
    """60 : 35 : 5 around a lane that is used up; the others rounded half to even and cut by order. English, German and all other documents are the three lanes."""
    bucket = F.when(F.col("lang") == "en", "distill").when(F.col("lang") == "de", "original").otherwise("clean")
    docs = table(spark, d, "documents").select("doc_id", bucket.alias("bucket"))
    lead = docs.where("bucket = 'distill'")
    targets = mixing.mix_targets(lead.count(), (0.60, 0.35, 0.05))
    others = [docs.where(F.col("bucket") == b).orderBy("doc_id").limit(n) for b, n in zip(("original", "clean"), targets[1:], strict=True)]
    return lead.unionByName(others[0]).unionByName(others[1])


@query("mix_source_counts", """WITH l AS (SELECT lang, source FROM documents) SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM l GROUP BY lang""")
def mix_source_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


@query("interleave", """WITH s AS (SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS slot, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents)
  SELECT doc_id, slot, place FROM s ORDER BY place, slot LIMIT 200""")  # fmt: skip
def interleave(spark, d):
    """Four streams in turn, the first 200 rows."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    streams = [docs.where(F.col("lang") == x).select("doc_id") for x in ("en", "de", "fr", "es")]
    return mixing.interleave(streams, "doc_id", 200).select("doc_id", "slot", "place")


@query("chunk_docs", """SELECT doc_id, chunk, sha1(substr(text, (chunk * 1000 + 1)::BIGINT, 1000)) AS chunk_sha1
  FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 1000)::BIGINT)) AS chunk FROM documents)""")  # fmt: skip
def chunk_docs(spark, d):
    out = mixing.chunks(table(spark, d, "documents").select("doc_id", "text"), size=1000)
    return out.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.sha1("text").alias("chunk_sha1"))


@query("token_windows", """WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents),
  x AS (SELECT doc_id, w, unnest(range(0, ((len(w) - 65) // 32 + 1)::BIGINT)) AS win FROM w WHERE len(w) >= 65)
  SELECT doc_id, win AS window, sha1(array_to_string(w[(win * 32 + 1):(win * 32 + 64)], ' ')) AS window_sha1 FROM x""")  # fmt: skip
def token_windows(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("w"))
    out = mixing.windows(words, "w", 64, 32)
    return out.select("doc_id", F.col("window").cast("long").alias("window"), F.sha1(F.array_join("w", " ")).alias("window_sha1"))


@query("modulo_recycle", """WITH h AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark)
  SELECT r.i AS case_id, h.item_id FROM range(0, 500) r(i) JOIN h ON r.i % h.n = h.i""")  # fmt: skip
def modulo_recycle(spark, d):
    """Case i takes row i mod n."""
    hard = with_ordinal(table(spark, d, "benchmark").select("item_id"), ["item_id"])
    n = hard.count()
    cases = spark.range(500).select(F.col("id").alias("case_id"), (F.col("id") % n + 1).alias("ord"))
    return cases.join(hard, "ord").select("case_id", "item_id")


@query("task_expansion", """WITH s AS (SELECT DISTINCT lang FROM documents) SELECT lang AS spec, i AS sample, CASE WHEN i % 2 = 0 THEN 'easy' ELSE 'hard' END AS mode,
  ['plain', 'terse', 'steps'][(i % 3 + 1)::INT] AS variant, substr('ABCD', (i % 4 + 1)::INT, 1) AS expected FROM s, range(0, 12) r(i)""")  # fmt: skip
def task_expansion(spark, d):
    """Each spec with a number of samples; mode, variant and expected answer cycle."""
    specs = table(spark, d, "documents").select(F.col("lang").alias("spec")).distinct()
    rows = specs.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("sample", F.col("sample").cast("long"))
    pick = lambda options: F.element_at(F.array(*map(F.lit, options)), (F.col("sample") % len(options) + 1).cast("int"))
    return rows.select("spec", "sample", pick(["easy", "hard"]).alias("mode"), pick(["plain", "terse", "steps"]).alias("variant"), pick(list("ABCD")).alias("expected"))
