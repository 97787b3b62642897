"""Quality rules with host verdicts.

Each document is measured, the rules' failures are counted by host, each host's failure rates
are shrunk towards a beta prior fitted to all hosts (method of moments), and the verdict on a
host is joined back to its documents. What a host may fail is taken from the same prior: a host
is rejected where a shrunk rate is a multiple of what hosts fail on average.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import free_names, materialise, named
from tessera.llm.words import Texts, Words, encoded, grouped, mixed, slices

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Document rules: SQL that is true for a failure. The first two are the base rules.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
BASE = ("short", "repeats")
#: A host is rejected when the shrunk failure rate of some rule is above so many times the prior's mean,
#: a limit that is held between the two others.
HOST_TIMES, HOST_LEAST, HOST_MOST = 3.0, 0.25, 0.5
#: Rejected hosts are broadcast up to this count, and joined by a shuffle beyond it.
BROADCAST_HOSTS = 200_000


def repeated_words(words: Words, n_docs: int, width: int = 3) -> np.ndarray:
    """For each text the words inside width-word windows that the text has twice or more."""
    count = len(words.code) - width + 1
    if count <= 0:
        return np.zeros(n_docs, np.int64)
    at = np.flatnonzero(words.doc[:count] == words.doc[width - 1 :])
    parts = (words.doc[at], *(words.code[at + i] for i in range(width)))
    order, new = grouped(mixed(*parts), *parts)
    twice = ~new
    twice[:-1] |= ~new[1:]
    covered = np.zeros(len(words.code), bool)
    for i in range(width):
        covered[at[order[twice]] + i] = True
    return np.bincount(words.doc[covered], minlength=n_docs)[:n_docs]


def duplicate_lines(texts: Texts) -> np.ndarray:
    """For each text the \\n-split lines with a word that equal an earlier line of it."""
    breaks = texts.bytes == 10
    starts = np.unique(np.concatenate((texts.ends[:-1][np.diff(texts.ends) > 0], np.flatnonzero(breaks) + 1)))
    starts = starts[starts < len(texts.bytes)]
    if not len(starts):
        return np.zeros(texts.n, np.int64)
    kept = np.concatenate(([0], np.cumsum(~breaks, dtype=np.int64)))
    lengths = np.diff(np.append(kept[starts], kept[-1]))
    doc = np.searchsorted(texts.ends, starts, "right") - 1
    code, lines = encoded(texts.bytes[~breaks], lengths)
    worded = np.array([bool(x.strip(b" \t\n\v\f\r")) for x in lines.to_pylist()], bool)[code]
    doc, code = doc[worded], code[worded]
    order, new = grouped(mixed(doc, code), doc, code)
    return np.bincount(doc[order[~new]], minlength=texts.n)[: texts.n]


def measures(texts: pa.Array) -> list[pa.Array]:
    """The MEASURES of each text."""
    whole = Texts(texts)
    words = Words(whole)
    values = (
        words.per_doc,
        whole.sums(words.inside & ((whole.bytes & 0xC0) != 0x80)),
        whole.sums(_IS_SYMBOL[whole.bytes]),
        duplicate_lines(whole),
        repeated_words(words, whole.n),
    )
    return [pa.array(v.astype(np.int64)) for v in values]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column of each batch is a text; its MEASURES stand in its place, the other columns stay."""
    for batch in batches:
        text = batch.schema.names[-1]
        for part in slices(batch, text):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *measures(part.column(text))], names=[*part.schema.names[:-1], *MEASURES])


def _measures_beside(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in arrays:
        parts = [pa.StructArray.from_arrays(measures(p.column("text")), names=list(MEASURES)) for p in slices(pa.RecordBatch.from_arrays([texts], names=["text"]))]
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(m, pa.int64()) for m in MEASURES]))


def measure(docs: DataFrame, ident: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """__ident, __host and the MEASURES of each row's whole text; null counts as empty."""
    slim = docs.select(named(ident).alias("__ident"), named(host).alias("__host"), named(text).alias("__text"))
    shape = f"__ident {slim.schema['__ident'].dataType.simpleString()}, __host {slim.schema['__host'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES)
    return slim.mapInArrow(_measured, shape)


def host_verdicts(measured: DataFrame, rules: dict[str, str] | None = None, times: float = HOST_TIMES, least: float = HOST_LEAST, most: float = HOST_MOST) -> DataFrame:
    """For each host: docs, shrunk_<rule> for each rule, host_rejected.

    The prior of a rule is Beta(m k, (1 - m) k) with the mean m and variance v of the hosts'
    rates and k = m (1 - m) / v - 1, at least 1; equal rates of all hosts give k = 1000. A host is
    rejected where a shrunk rate is above times x m, held between least and most.
    """
    rules = rules or RULES
    failed = [F.sum(F.expr(f"CASE WHEN {sql} THEN 1 ELSE 0 END")).alias(f"__f_{name}") for name, sql in rules.items()]
    counts = materialise(measured.groupBy("__host").agg(F.count(F.lit(1)).alias("docs"), *failed), "hosts")  # read for the prior and for the rates
    rate = lambda name: F.col(f"__f_{name}") / F.col("docs")
    prior = counts.agg(*(f for name in rules for f in (F.avg(rate(name)).alias(f"m_{name}"), F.var_pop(rate(name)).alias(f"v_{name}")))).first()
    mean = {name: prior[f"m_{name}"] or 0.0 for name in rules}

    def shrunk(name: str) -> Column:
        m, v = mean[name], prior[f"v_{name}"] or 0.0
        k = max(1.0, m * (1 - m) / v - 1) if v > 0 else 1000.0
        return (F.col(f"__f_{name}") + m * k) / (F.col("docs") + k)

    rated = counts.select("__host", "docs", *(shrunk(name).alias(f"shrunk_{name}") for name in rules))
    above = F.lit(False)
    for name in rules:
        above = above | (F.col(f"shrunk_{name}") > max(least, min(most, times * mean[name])))
    return rated.withColumn("host_rejected", F.coalesce(above, F.lit(False)))


def quality(docs: DataFrame, ident: str = "doc_id", host: str = "source", text: str = "text", **limits: float) -> DataFrame:
    """ident, the MEASURES, base_failed, kept and host_rejected for each row of docs.

    kept is false for a document that fails a base rule or whose host is rejected. Null texts
    count as empty and fail as short; a null host is a host of its own; repeated rows are
    measured each; a text of any length is measured whole; there are no ties, as every rule and
    host is judged by itself; an empty table gives an empty result; other columns are not looked at.
    """
    measured = materialise(measure(docs, ident, host, text), "quality")
    verdicts = host_verdicts(measured, **limits).withColumnRenamed("__host", "__verdict_host")
    failed = F.expr(" OR ".join(f"({RULES[name]})" for name in BASE))
    return measured.join(verdicts, F.col("__host").eqNullSafe(F.col("__verdict_host")), "left").select(
        F.col("__ident").alias(ident),
        *MEASURES,
        failed.alias("base_failed"),
        (~failed & ~F.col("host_rejected")).alias("kept"),
        "host_rejected",
    )


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", **limits: float) -> DataFrame:
    """The rows of docs that quality() keeps, with their columns, whatever these are named.

    Hosts are judged in a first pass over the texts; in a second one a document's text alone goes
    to Python, and its measures come back beside its row, so that no text is written or shuffled,
    and repeated and null identifiers don't matter. Nulls, repeated rows and empty tables are as
    in quality().
    """
    own, rejected_host = free_names(docs, "measures", "rejected")
    judged = docs.select(named(host).alias("__host"), named(text).alias("__text"))
    measured = judged.mapInArrow(_measured, StructType([judged.schema["__host"], *(StructField(m, LongType()) for m in MEASURES)]))
    rejected = materialise(host_verdicts(measured, **limits).where("host_rejected").select(F.col("__host").alias(rejected_host)), "rejected")
    rejected = F.broadcast(rejected) if rejected.count() <= BROADCAST_HOSTS else rejected
    # Called non-deterministic, as conditions on its fields would otherwise call it once each.
    beside = arrow_udf(_measures_beside, StructType([StructField(m, LongType()) for m in MEASURES]), ArrowUDFType.SCALAR_ITER).asNondeterministic()
    failed = " OR ".join(f"({RULES[name]})" for name in BASE)
    for m in MEASURES:
        failed = re.sub(rf"\b{m}\b", f"{own}.{m}", failed)
    good = docs.withColumn(own, beside(named(text))).where(~F.expr(failed))
    return good.join(rejected, named(host).eqNullSafe(F.col(rejected_host)), "left_anti").select(*map(named, docs.columns))


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = f"""
WITH words AS (
  SELECT doc_id, coalesce(source, '\\0') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS k FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT words.doc_id, host, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
counts AS (
  SELECT host, count(*) AS docs, {", ".join(f"sum(CASE WHEN {sql} THEN 1 ELSE 0 END) AS f_{name}" for name, sql in RULES.items())}
  FROM m GROUP BY host),
prior AS (SELECT {", ".join(f"avg(f_{n} / docs) AS m_{n}, var_pop(f_{n} / docs) AS v_{n}" for n in RULES)} FROM counts),
verdicts AS (
  SELECT host, {" OR ".join(f"(f_{n} + m_{n} * k_{n}) / (docs + k_{n}) > greatest({HOST_LEAST}, least({HOST_MOST}, {HOST_TIMES} * m_{n}))" for n in RULES)} AS host_rejected
  FROM (SELECT *, {", ".join(f"CASE WHEN v_{n} > 0 THEN greatest(1.0, m_{n} * (1 - m_{n}) / v_{n} - 1) ELSE 1000.0 END AS k_{n}" for n in RULES)} FROM counts, prior))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({RULES["short"]} OR {RULES["repeats"]}) AS base_failed,
       NOT ({RULES["short"]} OR {RULES["repeats"]}) AND NOT host_rejected AS kept, host_rejected
FROM m JOIN verdicts USING (host)
"""
