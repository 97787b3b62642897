"""Queries of evaluation statistics over labels and events as outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import statistics as st
from tessera.operators.order import with_ordinal
from tessera.plans.base import query
from tessera.session import table

_S = "s AS (SELECT event_type AS \"group\", user_id % 7 AS benchmark, user_id // 7 % 10 AS block, avg(value) AS score FROM events GROUP BY ALL)"


def _scores(spark, d):
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("group"), (F.col("user_id") % 7).alias("benchmark"), (F.floor(F.col("user_id") / 7) % 10).alias("block")).agg(F.avg("value").alias("score"))
    return s.withColumn("group_ord", F.ascii("group") * 256 + F.ascii(F.substring("group", 2, 1)))


def _complete(s, keys):
    """The blocks that have all groups of the table, which are numbered by name in group_ord."""
    groups = s.select("group").distinct()
    numbered = with_ordinal(groups, ["group"], [], "group_ord").withColumn("group_ord", F.col("group_ord") - 1)
    full = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).join(groups.agg(F.count(F.lit(1)).alias("c")), "c").drop("c")
    return s.drop("group_ord").join(full, keys).join(F.broadcast(numbered), "group")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("kfold", """WITH c AS (SELECT lang, quality AS correct, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM labels JOIN documents USING (doc_id)),
  f AS (SELECT lang, place % greatest(1, least(5, n)) AS fold, avg(correct) AS a FROM c GROUP BY 1, 2), m AS (SELECT lang, count(*) AS fold_count, avg(a) AS mean, coalesce(stddev_samp(a), 0) AS std FROM f GROUP BY 1)
  SELECT lang, fold_count, round(mean, 6) AS mean, round(std, 6) AS std, round(std / sqrt(fold_count), 6) AS sem, round(greatest(0, mean - 1.96 * std / sqrt(fold_count)), 6) AS ci95_low, round(least(1, mean + 1.96 * std / sqrt(fold_count)), 6) AS ci95_high FROM m""")  # fmt: skip
def kfold(spark, d):
    cases = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", F.col("quality").alias("correct"))
    placed = with_ordinal(cases, ["doc_id"], ["lang"]).withColumn("place", F.col("ord") - 1)
    return _rounded(st.fold_accuracy(placed, 5, ["lang"]), "mean", "std", "sem", "ci95_low", "ci95_high")


@query("group_summary", f"""WITH {_S}, m AS (SELECT benchmark, "group", count(*) AS n, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS std FROM s GROUP BY 1, 2)
  SELECT benchmark, "group", n, round(mean, 6) AS mean, round(std, 6) AS std, round(std / sqrt(n), 6) AS sem, round(mean - 1.96 * std / sqrt(n), 6) AS ci95_low, round(mean + 1.96 * std / sqrt(n), 6) AS ci95_high FROM m""")  # fmt: skip
def group_summary(spark, d):
    return _rounded(st.group_summary(_scores(spark, d), ["benchmark", "group"]), "mean", "std", "sem", "ci95_low", "ci95_high")


@query("block_ranks", f"""WITH {_S} SELECT benchmark, block, "group", rank() OVER (PARTITION BY benchmark, block ORDER BY score) + (count(*) OVER (PARTITION BY benchmark, block, score) - 1) / 2.0 AS rank FROM s""")
def block_ranks(spark, d):
    return st.block_ranks(_scores(spark, d), ["benchmark", "block"]).select("benchmark", "block", "group", "rank")


@query("friedman", f"""WITH {_S}, r AS (SELECT benchmark, "group", rank() OVER (PARTITION BY benchmark, block ORDER BY score) + (count(*) OVER (PARTITION BY benchmark, block, score) - 1) / 2.0 AS rank FROM s),
  g AS (SELECT benchmark, "group", sum(rank) AS r, count(*) AS n FROM r GROUP BY 1, 2), x AS (SELECT benchmark, count(*) AS groups, max(n) AS blocks, sum(r * r) AS s FROM g GROUP BY 1)
  SELECT benchmark, groups, blocks, round(greatest(0, 12.0 / (blocks * groups * (groups + 1)) * s - 3.0 * blocks * (groups + 1)), 6) AS statistic FROM x""")  # fmt: skip
def friedman(spark, d):
    return _rounded(st.friedman(_scores(spark, d), ["benchmark"]), "statistic")


@query("pairwise_deltas", f"""WITH {_S} SELECT a.benchmark, a."group" AS "left", b."group" AS "right", round(avg(a.score) - avg(b.score), 6) AS mean_delta, count(*) AS n
  FROM s a JOIN s b ON a.benchmark = b.benchmark AND a.block = b.block AND a."group" < b."group" GROUP BY 1, 2, 3""")  # fmt: skip
def pairwise_deltas(spark, d):
    return _rounded(st.paired(_scores(spark, d), ["benchmark"]).select("benchmark", "left", "right", "mean_delta", F.size("diffs").alias("n")), "mean_delta")


@query("perm_exact", f"""WITH {_S}, p AS (SELECT a.benchmark, a."group" AS l, b."group" AS r, list(a.score - b.score ORDER BY a.block) AS d
  FROM s a JOIN s b ON a.benchmark = b.benchmark AND a.block = b.block AND a."group" < b."group" GROUP BY 1, 2, 3),
  m AS (SELECT benchmark, l, r, d, abs(list_sum(d)) / len(d) AS obs, unnest(range(0, (1 << len(d))::BIGINT)) AS mask FROM p),
  f AS (SELECT benchmark, l, r, mask, any_value(obs) AS obs, abs(sum(CASE WHEN (mask >> (i - 1)::BIGINT) & 1 = 1 THEN d[i] ELSE -d[i] END)) / count(*) AS v FROM (SELECT *, unnest(range(1, len(d) + 1)) AS i FROM m) GROUP BY 1, 2, 3, 4)
  SELECT benchmark, l AS "left", r AS "right", round(CASE WHEN any_value(obs) = 0 THEN 1.0 ELSE least(1.0, (1 + count(*) FILTER (v >= obs - 1e-12)) / (1.0 + count(*))) END, 6) AS p_value FROM f GROUP BY 1, 2, 3""")  # fmt: skip
def perm_exact(spark, d):
    return _rounded(st.pairwise(_scores(spark, d), ["benchmark"]).select("benchmark", "left", "right", "p_value"), "p_value")


_FLIPS = """d AS (SELECT a.benchmark, a."group" AS l, b."group" AS r, list(a.score - b.score ORDER BY a.block) AS d, avg(a.score) - avg(b.score) AS delta
  FROM s a JOIN s b ON a.benchmark = b.benchmark AND a.block = b.block AND a."group" < b."group" GROUP BY 1, 2, 3),
  k AS (SELECT benchmark, l, r, d, abs(list_sum(d)) / len(d) AS obs, unnest(range(0, (1 << len(d))::BIGINT)) AS mask FROM d),
  f AS (SELECT benchmark, l, r, mask, any_value(obs) AS obs, abs(sum(CASE WHEN (mask >> (i - 1)::BIGINT) & 1 = 1 THEN d[i] ELSE -d[i] END)) / count(*) AS v FROM (SELECT *, unnest(range(1, len(d) + 1)) AS i FROM k) GROUP BY 1, 2, 3, 4),
  w AS (SELECT benchmark, l, r, CASE WHEN any_value(obs) = 0 THEN 1.0 ELSE least(1.0, (1 + count(*) FILTER (v >= obs - 1e-12)) / (1.0 + count(*))) END AS p FROM f GROUP BY 1, 2, 3)"""


@query("group_report", f"""WITH {_S}, {_FLIPS}, r AS (SELECT benchmark, "group", rank() OVER (PARTITION BY benchmark, block ORDER BY score) + (count(*) OVER (PARTITION BY benchmark, block, score) - 1) / 2.0 AS rank FROM s),
  g AS (SELECT benchmark, "group", sum(rank) AS r, count(*) AS n FROM r GROUP BY 1, 2), x AS (SELECT benchmark, count(*) AS k, max(n) AS b, sum(r * r) AS q FROM g GROUP BY 1)
  SELECT benchmark, 'summary' AS kind, "group" AS name, round(avg(score), 6) AS value, count(*) AS n, round(coalesce(stddev_samp(score), 0) / sqrt(count(*)), 6) AS sem, NULL::DOUBLE AS p_value FROM s GROUP BY 1, 3
  UNION ALL SELECT benchmark, 'pairwise', l || '-' || r, round(delta, 6), len(d), NULL, round(p, 6) FROM d JOIN w USING (benchmark, l, r)
  UNION ALL SELECT benchmark, 'omnibus', 'friedman', round(greatest(0, 12.0 / (b * k * (k + 1)) * q - 3.0 * b * (k + 1)), 6), b, NULL, NULL FROM x WHERE k >= 3""")  # fmt: skip
def group_report(spark, d):
    """The whole comparison; the omnibus p-value comes from a seeded generator, which SQL has not (friedman_sampled has it)."""
    return _rounded(st.group_report(_scores(spark, d), ["benchmark"], permutations=0).select("benchmark", "kind", "name", "value", "n", "sem", "p_value"), "value", "sem", "p_value")


@query("perm_sampled")
def perm_sampled(spark, d):
    """All pairs by 10,000 random flips of a seeded generator (more than 16 blocks are sampled)."""
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("group"), F.lit(1).alias("benchmark"), F.col("user_id").alias("block")).agg(F.avg("value").alias("score"))
    return _rounded(st.pairwise_sampled(_complete(s, ["block"]), ["benchmark"]).select("benchmark", "left", "right", "mean_delta", "p_value"), "mean_delta", "p_value")


@query("friedman_sampled")
def friedman_sampled(spark, d):
    return _rounded(st.friedman_sampled(_complete(_scores(spark, d), ["benchmark", "block"]), ["benchmark"]), "statistic", "p_value")


_C = "c AS (SELECT event_type AS benchmark, user_id % 4 + 1 AS L, user_id // 4 AS case_idx, max((event_id % 3 = 0)::INT) AS correct FROM events GROUP BY 1, 2, 3)"


@query("loop_metrics", f"""WITH {_C}, a AS (SELECT benchmark, L, avg(correct) AS acc FROM c GROUP BY 1, 2), b AS (SELECT benchmark, min(L) AS base FROM c GROUP BY 1),
  f AS (SELECT c.benchmark, case_idx, correct AS shallow FROM c JOIN b ON c.benchmark = b.benchmark AND c.L = b.base),
  p AS (SELECT c.benchmark, c.L, avg((shallow = 0 AND correct = 1)::INT) AS sc, avg((shallow = 1 AND correct = 0)::INT) AS ot, avg(shallow) AS base FROM c JOIN f USING (benchmark, case_idx) GROUP BY 1, 2)
  SELECT a.benchmark, a.L AS "L", round(a.acc, 6) AS accuracy, round(a.acc - base, 6) AS loop_gain, round(a.acc - coalesce(q.acc, base), 6) AS marginal_gain, round(sc, 6) AS self_correction_rate, round(ot, 6) AS overthinking_rate
  FROM a JOIN p USING (benchmark, L) LEFT JOIN a q ON q.benchmark = a.benchmark AND q.L = a.L - 1""")  # fmt: skip
def loop_metrics(spark, d):
    u = F.col("user_id")
    cases = table(spark, d, "events").groupBy(F.col("event_type").alias("benchmark"), (u % 4 + 1).alias("L"), F.floor(u / 4).alias("case_idx")).agg(F.max((F.col("event_id") % 3 == 0).cast("int")).alias("correct"))
    return _rounded(st.loop_metrics(cases, ["benchmark"]), "accuracy", "loop_gain", "marginal_gain", "self_correction_rate", "overthinking_rate")


@query("best_of_k", """WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, least(1.0, value / 40) AS score FROM events),
  u AS (SELECT user_id, coalesce(min(attempt) FILTER (score >= 1), max(attempt)) AS used FROM t WHERE attempt <= 4 GROUP BY 1)
  SELECT user_id, max(used) AS attempts, round(max(score), 6) AS best, (max(score) > 0)::INT AS correct FROM t JOIN u USING (user_id) WHERE attempt <= used AND attempt <= 4 GROUP BY 1""")  # fmt: skip
def best_of_k(spark, d):
    rows = with_ordinal(table(spark, d, "events").select("user_id", "event_id", F.least(F.lit(1.0), F.col("value") / 40).alias("score")), ["event_id"], ["user_id"], "attempt")
    return _rounded(st.best_of(rows.where("attempt <= 4"), ["user_id"]), "best")


@query("benchmark_rates", """SELECT event_type AS benchmark, round(avg((value > 20)::INT), 6) AS accuracy, round(sum(value) * 1000 / greatest(1, count(*)), 3) AS latency_ms_per_case, round(count(*) / greatest(1e-9, sum(value)), 6) AS tokens_per_sec FROM events GROUP BY 1""")
def benchmark_rates(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "events").groupBy(F.col("event_type").alias("benchmark")).agg(
        F.round(F.avg((F.col("value") > 20).cast("int")), 6).alias("accuracy"), F.round(F.sum("value") * 1000 / F.greatest(F.lit(1), n), 3).alias("latency_ms_per_case"), F.round(n / F.greatest(F.lit(1e-9), F.sum("value")), 6).alias("tokens_per_sec")
    )


@query("perplexity", "SELECT lang, round(exp(sum(ln(1 + n_chars)) / greatest(1, count(*))), 4) AS ppl FROM documents GROUP BY 1")
def perplexity(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.round(F.exp(F.sum(F.log1p("n_chars")) / F.greatest(F.lit(1), F.count(F.lit(1)))), 4).alias("ppl"))


@query("sweep_headline", "SELECT min(value) AS min_value, max(value) AS max_value FROM events WHERE event_type = 'view'")
def sweep_headline(spark, d):
    return table(spark, d, "events").where("event_type = 'view'").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))


@query("group_advantage", "SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-6), 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)")
def group_advantage(spark, d):
    return _rounded(st.advantage(table(spark, d, "events"), ["user_id"], "value").select("event_id", "advantage"), "advantage")


@query("masked_mean", "SELECT round(avg(m), 6) AS mean FROM (SELECT sum(value * (event_id % 2)) / greatest(sum(event_id % 2), 1) AS m FROM events GROUP BY user_id)")
def masked_mean(spark, d):
    return _rounded(st.masked_mean(table(spark, d, "events").withColumn("mask", F.col("event_id") % 2), "user_id", "value", "mask"), "mean")


@query("kl_and_preference", "SELECT event_id, round(exp(value / 100) - value / 100 - 1, 8) AS kl, round(ln(1 + exp(-(value / 10 - 1.5))), 8) AS loss FROM events")
def kl_and_preference(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(st.kl_estimate(v / 100), 8).alias("kl"), F.round(st.preference_loss(v / 10, F.lit(1.0), 0.5), 8).alias("loss"))


@query("schedules", """SELECT i AS step, round(CASE WHEN i < 100 THEN 0.001 * (i + 1) / 100 ELSE 0.0001 + 0.0009 * 0.5 * (1 + cos(pi() * least(1.0, (i - 100) / 900.0))) END, 9) AS lr,
  round(1.0 * (1 - least(i, 500) / 500.0) + 0.2 * (least(i, 500) / 500.0), 9) AS lambda FROM range(0, 1200) r(i)""")  # fmt: skip
def schedules(spark, d):
    s = F.col("id")
    return spark.range(1200).select(s.alias("step"), F.round(st.learning_rate(s, 1e-3, 100, 1000, 1e-4), 9).alias("lr"), F.round(st.annealed(s, 1.0, 0.2, 500), 9).alias("lambda"))


@query("validation_probe", "SELECT round(avg(value), 6) AS val_loss, count(*) AS batches FROM (SELECT value FROM events ORDER BY event_id LIMIT 500)")
def validation_probe(spark, d):
    return st.validation_probe(table(spark, d, "events").select("event_id", "value"), "value", "event_id", 500).withColumn("val_loss", F.round("val_loss", 6))


@query("entropy_floor", "SELECT user_id, round(avg(0.05 * (event_id % 10) / 9.0 + 0.01 * (1 - (event_id % 10) / 9.0)), 6) AS floor FROM events GROUP BY user_id")
def entropy_floor(spark, d):
    """The floor at each event's level, by user."""
    e = table(spark, d, "events").select("user_id", st.entropy_floor((F.col("event_id") % 10) / 9.0, 0.05, 0.01).alias("f"))
    return e.groupBy("user_id").agg(F.round(F.avg("f"), 6).alias("floor"))
