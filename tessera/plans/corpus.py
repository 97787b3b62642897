"""Queries of cleaning, auditing, set operations and chunking over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import corpus
from tessera.operators.order import first_wins
from tessera.plans.base import query
from tessera.session import table, work_dir
from tessera.sources import readers

_REASON = """CASE WHEN length(t) < 64 THEN 'short' WHEN length(t) > 500000 THEN 'long'
  WHEN (length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) + length(regexp_replace(t, '[^\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{FF66}-\\x{FF9F}]', '', 'g'))) / length(t) < 0.4 THEN 'low_alnum_cjk_ratio'
  WHEN list_max(map_values(list_histogram(string_split(t, '')))) / length(t) >= 0.3 THEN 'single_char'
  WHEN coalesce(list_max(map_values(list_histogram(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 4)))), 0) >= 30 THEN 'line_repeat' END"""
NORM = """regexp_replace(regexp_replace(regexp_replace(text, '[\\t\\x{A0}]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"""
CLEANED = f"""n AS (SELECT doc_id, source, lang, {NORM} AS t FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, source, lang, t, {_REASON} AS reason FROM n),
m AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, sha1(left(t, 512)) ORDER BY doc_id) > 1 THEN 'dup' ELSE reason END AS final FROM r)"""
_AUDIT = f"""n AS (SELECT doc_id, source, {NORM} AS t FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, source, t, {_REASON} AS reason,
  row_number() OVER (PARTITION BY sha1(t) ORDER BY doc_id) > 1 AS dup_exact,
  row_number() OVER (PARTITION BY sha1(left(t, 512)) ORDER BY doc_id) > 1 AS dup_prefix FROM n WHERE t <> ''),
f AS (SELECT source, count(*) AS docs, count(*) FILTER (reason IS NOT NULL) AS low_quality, count(*) FILTER (dup_exact) AS exact_duplicates,
  count(*) FILTER (dup_prefix) AS prefix_duplicates, round(sum(length(t)) / count(*), 3) AS avg_chars FROM a GROUP BY source)"""


@query("clean_counters", f"""WITH {CLEANED} SELECT source, count(*) AS seen, count(*) FILTER (final IS NULL) AS kept,
  count(*) FILTER (final = 'short') AS drop_short, count(*) FILTER (final = 'long') AS drop_long, count(*) FILTER (final = 'low_alnum_cjk_ratio') AS drop_ratio,
  count(*) FILTER (final = 'single_char') AS drop_singlechar, count(*) FILTER (final = 'line_repeat') AS drop_linerepeat, count(*) FILTER (final = 'dup') AS drop_dup
  FROM m GROUP BY source""")  # fmt: skip
def clean_counters(spark, d):
    return corpus.clean_counters(table(spark, d, "documents"))


@query("quality_reasons", f"WITH {CLEANED} SELECT doc_id, length(t) AS chars, coalesce(reason, 'ok') AS reason FROM r")
def quality_reasons(spark, d):
    rows = corpus.cleaned(table(spark, d, "documents"))
    return rows.select("doc_id", F.char_length("text").alias("chars"), F.coalesce("reason", F.lit("ok")).alias("reason"))


@query("clean_docs", f"WITH {CLEANED} SELECT doc_id, source, sha1(t) AS text_sha1 FROM m WHERE final IS NULL")
def clean_docs(spark, d):
    return corpus.clean_documents(table(spark, d, "documents")).select("doc_id", "source", T.exact_hash(F.col("text")).alias("text_sha1"))


@query("audit_by_source", f"WITH {_AUDIT} SELECT * FROM f")
def audit_by_source(spark, d):
    return corpus.audit_by_file(corpus.audit_rows(table(spark, d, "documents")))


@query("audit_simhash")
def audit_simhash(spark, d):
    return corpus.audit_by_file(corpus.audit_rows(table(spark, d, "documents"), simhash=True))


@query("audit_rollup", f"""WITH {_AUDIT} SELECT count(*) AS files, sum(docs)::BIGINT AS total_docs, sum(low_quality)::BIGINT AS low_quality,
  sum(exact_duplicates)::BIGINT AS exact_duplicates, sum(prefix_duplicates)::BIGINT AS prefix_duplicates FROM f""")  # fmt: skip
def audit_rollup(spark, d):
    files = corpus.audit_by_file(corpus.audit_rows(table(spark, d, "documents")))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("docs").alias("total_docs"), *(F.sum(c).alias(c) for c in ("low_quality", "exact_duplicates", "prefix_duplicates")))


@query("issue_rate_topk", f"""WITH {_AUDIT} SELECT source, round((low_quality + prefix_duplicates) / docs, 6) AS issue_rate FROM f
  ORDER BY (low_quality + prefix_duplicates) / docs DESC, source LIMIT 20""")  # fmt: skip
def issue_rate_topk(spark, d):
    rated = corpus.issue_rates(corpus.audit_by_file(corpus.audit_rows(table(spark, d, "documents"))))
    return rated.orderBy(F.desc("issue_rate"), "source").limit(20).select("source", F.round("issue_rate", 6).alias("issue_rate"))


_LINES = f"""l AS (SELECT source, doc_id, doc_id % 50 = 0 AS bad, CASE doc_id % 50 WHEN 1 THEN left(text, 30) || chr(10) || chr(10) || text WHEN 2 THEN ' ' ELSE text END AS text FROM documents WHERE source IS NOT NULL),
n AS (SELECT source, doc_id, {NORM} AS t FROM l WHERE NOT bad), a AS (SELECT source, doc_id, t, {_REASON} AS reason, row_number() OVER (PARTITION BY sha1(t) ORDER BY source, doc_id) > 1 AS dup_exact,
  row_number() OVER (PARTITION BY sha1(left(t, 512)) ORDER BY source, doc_id) > 1 AS dup_prefix FROM n WHERE t <> ''),
e AS (SELECT source, count(*) FILTER (bad OR text IS NULL) AS parse_errors, count(*) FILTER (NOT bad AND {NORM} = '') AS empty_text FROM l GROUP BY source),
f AS (SELECT source, count(*) AS docs, count(*) FILTER (reason IS NOT NULL) AS low_quality, count(*) FILTER (dup_exact) AS exact_duplicates, count(*) FILTER (dup_prefix) AS prefix_duplicates, round(sum(length(t)) / count(*), 3) AS avg_chars FROM a GROUP BY source)"""


@query("audit_folder", f"""WITH {_LINES} SELECT source, docs, parse_errors, empty_text, low_quality, exact_duplicates, prefix_duplicates, avg_chars, round((parse_errors + empty_text + low_quality + prefix_duplicates) / docs, 6) AS issue_rate, false AS zero_bytes FROM e JOIN f USING (source)
  UNION ALL SELECT '', 0, 0, 0, 0, 0, 0, 0.0, 1.0, true""")  # fmt: skip
def audit_folder(spark, d):
    """A folder with a file of lines for each source and one without bytes: some lines don't parse, some have a prompt and a response, some no text."""
    folder, k = work_dir(spark, "audited"), F.col("doc_id") % 50
    text = F.coalesce("text", F.lit("{"))
    line = F.when((k == 0) | F.col("text").isNull(), "{not-json").when(k == 1, F.to_json(F.struct(F.substring("text", 1, 30).alias("prompt"), F.col("text").alias("response")))).otherwise(F.to_json(F.struct(F.when(k == 2, " ").otherwise(text).alias("text"))))
    rows = table(spark, d, "documents").where("source IS NOT NULL").select("doc_id", line.alias("value"), F.col("source").alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").select("value", "part").write.partitionBy("part").text(folder)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/empty.txt")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place).close()
    audits = corpus.audit_files(readers.files_below(spark, folder, ".txt"), readers.audit_jsonl(spark, folder, True, "*.txt"))
    shown = ["docs", "parse_errors", "empty_text", "low_quality", "exact_duplicates", "prefix_duplicates", "avg_chars"]
    return audits.select(F.regexp_extract("file", r"part=([^/]*)/", 1).alias("source"), *shown, F.round("issue_rate", 6).alias("issue_rate"), (F.col("bytes") == 0).alias("zero_bytes"))


@query("top_dup_prefixes", f"""WITH {_AUDIT}, c AS (SELECT sha1(left(t, 512)) AS prefix_hash, count(*) AS n, min(doc_id) AS first_doc FROM a GROUP BY 1),
  top AS (SELECT * FROM c ORDER BY n DESC, first_doc LIMIT 20) SELECT prefix_hash, n FROM top WHERE n > 1""")  # fmt: skip
def top_dup_prefixes(spark, d):
    """The 20 most common prefixes (ties by first appearance), and of these those that repeat."""
    norm = corpus.cleaned(table(spark, d, "documents")).select("doc_id", F.col("text").alias("t")).where("t <> ''")
    counts = norm.groupBy(T.prefix_hash(F.col("t")).alias("prefix_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return counts.orderBy(F.desc("n"), "first_doc").limit(20).where("n > 1").select("prefix_hash", "n")


@query("reason_histogram", f"WITH {_AUDIT} SELECT reason, count(*) AS n FROM a WHERE reason IS NOT NULL GROUP BY reason")
def reason_histogram(spark, d):
    rows = corpus.audit_rows(table(spark, d, "documents"))
    return rows.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("unique_docs", f"WITH {CLEANED} SELECT count(DISTINCT left(t, 512)) AS unique_docs FROM r WHERE reason IS NULL")
def unique_docs(spark, d):
    rows = corpus.cleaned(table(spark, d, "documents")).where(F.col("reason").isNull())
    return rows.agg(F.countDistinct(T.prefix_hash(F.col("text"))).alias("unique_docs"))


@query("union_distinct", """WITH u AS (SELECT text, 0 AS o, doc_id AS id FROM documents UNION ALL SELECT text, 1, item_id FROM benchmark),
  k AS (SELECT *, row_number() OVER (PARTITION BY sha1(text) ORDER BY o, id) AS n FROM u) SELECT o, count(*) AS n FROM k WHERE n = 1 GROUP BY o""")  # fmt: skip
def union_distinct(spark, d):
    """Distinct union across two inputs, the first input winning."""
    docs = table(spark, d, "documents").select("text", F.lit(0).alias("o"), F.col("doc_id").alias("id"))
    both = docs.unionByName(table(spark, d, "benchmark").select("text", F.lit(1).alias("o"), F.col("item_id").alias("id")))
    keyed = both.select(F.sha1("text").alias("k"), F.struct("o", "id").alias("at"))
    return first_wins(keyed, ["k"], "at", []).groupBy(F.col("at.o").alias("o")).agg(F.count(F.lit(1)).alias("n"))


@query("text_measures", """SELECT doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS alnum,
  list_max(map_values(list_histogram(string_split(text, '')))) AS top_char,
  sha1(lower(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))) AS fingerprint_sha1,
  sha1(left(text, 512)) AS prefix_sha1 FROM documents""")  # fmt: skip
def text_measures(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.alnum_count(t).alias("alnum"), T.top_char_count(t).alias("top_char"), F.sha1(T.fingerprint(t)).alias("fingerprint_sha1"), T.prefix_hash(t).alias("prefix_sha1"))


@query("near_copies_simhash")
def near_copies_simhash(spark, d):
    """Documents by simhash with more than one member."""
    from tessera.functions.verifiers import simhash64

    rows = table(spark, d, "documents").select("doc_id", simhash64(T.normalize(F.col("text"))).alias("simhash"))
    return rows.groupBy("simhash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("distinct_sketches", """WITH s AS (SELECT source, count(DISTINCT text) AS n FROM documents GROUP BY source UNION ALL SELECT 'all sources', count(DISTINCT text) FROM documents)
  SELECT source, n, true AS near, true AS merged FROM s""")  # fmt: skip
def distinct_sketches(spark, d):
    """Distinct texts by source and in all: exact, whether the sketch is within 2 %, and whether the merged sketches of the sources say what one sketch of all documents says."""
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("-")).alias("source"), "text")
    key, estimate = F.sha2("text", 256), F.hll_sketch_estimate("sketch")
    by_source = corpus.distinct_sketches(docs, ["source"], key)
    whole = corpus.distinct_sketches(docs.withColumn("source", F.lit("all sources")), ["source"], key).select("source", estimate.alias("of_all"))
    union = corpus.merged_sketches(by_source, []).select(F.lit("all sources").alias("source"), estimate.alias("estimate")).join(whole, "source")
    told = by_source.select("source", estimate.alias("estimate"), F.lit(None).cast("long").alias("of_all")).unionByName(union.select("source", "estimate", "of_all"))
    exact = docs.groupBy("source").agg(F.countDistinct(key).alias("n")).unionByName(docs.agg(F.countDistinct(key).alias("n")).select(F.lit("all sources").alias("source"), "n"))
    near = F.abs(F.col("estimate") - F.col("n")) <= F.greatest(F.lit(1.0), 0.02 * F.col("n"))
    return exact.join(told, "source").select("source", "n", near.alias("near"), F.coalesce(F.col("of_all") == F.col("estimate"), F.lit(True)).alias("merged"))
