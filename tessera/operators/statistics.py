"""Fold, rank and permutation statistics over paired outcomes, and evaluation reductions."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpoint

EXACT_PAIRS = 16


def _spread(n: Column, mean: Column, sd: Column, clip: bool) -> dict[str, Column]:
    sem = sd / F.sqrt(F.greatest(n, F.lit(1)))
    low, high = mean - 1.96 * sem, mean + 1.96 * sem
    return {"sem": sem, "ci95_low": F.greatest(low, F.lit(0.0)) if clip else low, "ci95_high": F.least(high, F.lit(1.0)) if clip else high}


def fold_accuracy(cases: DataFrame, folds: int, group: list[str], place: str = "place", correct: str = "correct") -> DataFrame:
    """Mean, sample deviation and clipped 95 % interval of the accuracies of folds place mod k (place from 0).

    k is folds, at least 1 and at most the number of cases of the group.
    """
    sized = cases.groupBy(*group).agg(F.greatest(F.lit(1), F.least(F.lit(folds), F.count(F.lit(1)))).alias("k"))
    rows = cases.join(sized, group)
    by_fold = rows.groupBy(*group, (F.col(place) % F.col("k")).alias("fold")).agg(F.avg(F.col(correct).cast("double")).alias("a"))
    out = by_fold.groupBy(*group).agg(F.count(F.lit(1)).alias("fold_count"), F.avg("a").alias("mean"), F.coalesce(F.stddev_samp("a"), F.lit(0.0)).alias("std"))
    return out.withColumns(_spread(F.col("fold_count"), F.col("mean"), F.col("std"), clip=True))


def group_summary(scores: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    out = scores.groupBy(*group).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std"))
    return out.withColumns(_spread(F.col("n"), F.col("mean"), F.col("std"), clip=False))


def block_ranks(scores: DataFrame, block: list[str], score: str = "score", name: str = "rank") -> DataFrame:
    """Rank within the block, ties at their mean."""
    ordered, ties = Window.partitionBy(*block).orderBy(score), Window.partitionBy(*block, score)
    return scores.withColumn(name, F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def friedman(scores: DataFrame, by: list[str], group: str = "group", block: str = "block") -> DataFrame:
    """groups, blocks and the Friedman statistic, not below 0 and without correction for ties."""
    sums = block_ranks(scores, [*by, block]).groupBy(*by, group).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    out = sums.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("blocks"), F.sum(F.col("r") * F.col("r")).alias("s"))
    q = 12.0 / (F.col("blocks") * F.col("groups") * (F.col("groups") + 1)) * F.col("s") - 3.0 * F.col("blocks") * (F.col("groups") + 1)
    return out.select(*by, "groups", "blocks", F.greatest(q, F.lit(0.0)).alias("statistic"))


def exact_sign_flips(diffs: Column) -> Column:
    """Two-sided exact sign-flip p-value of paired differences, null beyond EXACT_PAIRS of them; both counts start at one."""
    diffs = F.when(F.size(diffs) <= EXACT_PAIRS, diffs)
    n = F.size(diffs)
    observed = F.abs(F.aggregate(diffs, F.lit(0.0), lambda a, x: a + x)) / n
    flipped = lambda mask: F.abs(
        F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + F.when(F.getbit(mask, i) == 1, F.get(diffs, i)).otherwise(-F.get(diffs, i)))
    ) / n
    masks = F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), n).cast("long") - 1)
    extreme = F.size(F.filter(masks, lambda m: flipped(m) >= observed - 1e-12))
    return F.when(observed == 0, 1.0).when(observed.isNotNull(), F.least(F.lit(1.0), (extreme + 1) / (F.size(masks) + 1)))


def paired(scores: DataFrame, by: list[str], group: str = "group", block: str = "block", order: str = "group_ord", score: str = "score") -> DataFrame:
    """by, left, right, diffs (by block), mean_delta of all pairs of groups in order."""
    keys = [*by, block]
    left = scores.select(*keys, F.col(group).alias("left"), F.col(order).alias("i"), F.col(score).alias("a"))
    right = scores.select(*keys, F.col(group).alias("right"), F.col(order).alias("j"), F.col(score).alias("b"))
    both = left.join(right, keys).where("i < j")
    diffs = F.transform(F.array_sort(F.collect_list(F.struct(block, (F.col("a") - F.col("b")).alias("d")))), lambda x: x["d"])
    return both.groupBy(*by, "left", "right", "i", "j").agg(diffs.alias("diffs"), (F.avg("a") - F.avg("b")).alias("mean_delta"))


def pairwise(scores: DataFrame, by: list[str], permutations: int = 10_000, seed: int = 0, **names) -> DataFrame:
    """Each pair of groups with a p-value: exact up to EXACT_PAIRS blocks, by random flips beyond."""
    pairs = checkpoint(paired(scores, by, **names), "pairs")
    few = F.size("diffs") <= EXACT_PAIRS
    exact = pairs.where(few).withColumn("p_value", exact_sign_flips(F.col("diffs"))).drop("diffs", "i", "j")
    return exact.unionByName(_sampled(pairs.where(~few), permutations, seed))


def sampled_sign_flips(diffs: list[float], permutations: int, seed: int) -> float:
    """The p-value by random flips of CPython's generator, exact for few pairs."""
    from statistics import mean

    observed = abs(mean(diffs))
    if observed == 0:
        return 1.0
    if len(diffs) <= EXACT_PAIRS:
        samples = ([d if mask >> i & 1 else -d for i, d in enumerate(diffs)] for mask in range(1 << len(diffs)))
        total = 1 << len(diffs)
    else:
        total = max(1, permutations)
        return min(1.0, (1 + _extreme_flips(diffs, observed - 1e-12, total, random.Random(seed))) / (1 + total))
    return min(1.0, (1 + sum(abs(mean(s)) >= observed - 1e-12 for s in samples)) / (1 + total))


def _extreme_flips(diffs: list[float], limit: float, total: int, generator: random.Random) -> int:
    """How many of total random flips have an absolute mean of limit or more.

    numpy draws what generator.random() would, many flips at once; means too close to the limit
    for its sums are taken anew, exactly rounded.
    """
    from statistics import mean

    import numpy as np

    *key, at = generator.getstate()[1]
    twister = np.random.RandomState()
    twister.set_state(("MT19937", np.array(key, dtype=np.uint32), at))
    d, found = np.array(diffs, dtype=float), 0
    margin, step = 1e-12 * float(np.abs(d).max()), max(1, (1 << 20) // len(d))
    for start in range(0, total, step):
        signed = np.where(twister.random_sample((min(step, total - start), len(d))) < 0.5, d, -d)
        means = np.abs(signed.mean(axis=1))
        close = np.abs(means - limit) <= margin
        found += int((means[~close] >= limit).sum()) + sum(abs(mean(row)) >= limit for row in signed[close].tolist())
    return found


def pairwise_sampled(scores: DataFrame, by: list[str], permutations: int = 10_000, seed: int = 0, **names) -> DataFrame:
    """Each pair of groups with its own seed, in Python for the generator's sake."""
    return _sampled(paired(scores, by, **names), permutations, seed)


def _sampled(pairs: DataFrame, permutations: int, seed: int) -> DataFrame:
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = [sampled_sign_flips(list(d), permutations, seed + int(i) * 1009 + int(j)) for d, i, j in zip(f.diffs, f.i, f.j, strict=True)]
            yield f.drop(columns=["diffs", "i", "j"]).assign(p_value=p)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.drop("diffs", "i", "j").schema.fields)
    return pairs.mapInPandas(run, f"{kinds}, p_value double")


def friedman_sampled(scores: DataFrame, by: list[str], permutations: int = 10_000, seed: int = 0, group: str = "group", block: str = "block", order: str = "group_ord") -> DataFrame:
    """Friedman statistic with a within-block shuffle p-value (CPython's generator), a benchmark at a time."""
    import numpy as np
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.sort_values(order, kind="stable").pivot(index=block, columns=order, values="score").sort_index()
        k, n = wide.shape[1], len(wide)

        # A shuffle takes the ranks of a block along; ties and missing scores as pandas ranks them.
        ranked = np.nan_to_num(wide.rank(axis=1).to_numpy())

        def statistic(ranks: np.ndarray) -> float:
            sums = ranks.sum(axis=0)
            return max(0.0, 12.0 / (n * k * (k + 1)) * float((sums * sums).sum()) - 3.0 * n * (k + 1))

        observed, generator, extreme = statistic(ranked), random.Random(seed), 1
        for _ in range(max(1, permutations)):
            shuffled = ranked.tolist()
            for own in shuffled:
                generator.shuffle(own)
            extreme += statistic(np.array(shuffled)) >= observed - 1e-12
        return frame[by].head(1).assign(statistic=observed, p_value=min(1.0, extreme / (1 + max(1, permutations))))

    kinds = ", ".join(f"`{c}` {scores.schema[c].dataType.simpleString()}" for c in by)
    return scores.groupBy(*by).applyInPandas(run, f"{kinds}, statistic double, p_value double")


def check_paired(scores: DataFrame, by: list[str], group: str = "group") -> DataFrame:
    """Fail when the groups of a benchmark have different numbers of scores."""
    sizes = scores.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.countDistinct("n").alias("kinds"))
    return sizes.withColumn("ok", F.assert_true(F.col("kinds") == 1, F.lit("paired comparisons need equal numbers of scores")).isNull()).select(*by, "ok")


def loop_metrics(cases: DataFrame, by: list[str], depth: str = "L", case: str = "case_idx", correct: str = "correct") -> DataFrame:
    """Gain of each depth over the first and the one just below, cases mended and spoilt against the first."""
    accuracy = cases.groupBy(*by, depth).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"))
    base = cases.groupBy(*by).agg(F.min(depth).alias("base"))
    first = cases.join(base, by).where(F.col(depth) == F.col("base")).select(*by, case, F.col(correct).alias("shallow"))
    pairs = cases.join(first, [*by, case]).groupBy(*by, depth).agg(
        F.avg((~F.col("shallow").cast("boolean") & F.col(correct).cast("boolean")).cast("double")).alias("self_correction_rate"),
        F.avg((F.col("shallow").cast("boolean") & ~F.col(correct).cast("boolean")).cast("double")).alias("overthinking_rate"),
        F.avg(F.col("shallow").cast("double")).alias("base_accuracy"),
    )
    below = accuracy.select(*by, (F.col(depth) + 1).alias(depth), F.col("accuracy").alias("before"))
    out = accuracy.join(pairs, [*by, depth]).join(below, [*by, depth], "left")
    gain = F.col("accuracy") - F.col("base_accuracy")
    return out.select(*by, depth, "accuracy", gain.alias("loop_gain"), F.coalesce(F.col("accuracy") - F.col("before"), gain).alias("marginal_gain"), "self_correction_rate", "overthinking_rate")


def best_of(attempts: DataFrame, by: list[str], attempt: str = "attempt", score: str = "score") -> DataFrame:
    """Attempts used until the first full score, the best score among these, and whether it is above 0."""
    full = F.min(F.when(F.col(score) >= 1, F.col(attempt)))
    stop = attempts.groupBy(*by).agg(F.coalesce(full, F.max(attempt)).alias("used"))
    return attempts.join(stop, by).where(F.col(attempt) <= F.col("used")).groupBy(*by).agg(F.max("used").alias("attempts"), F.max(score).alias("best")).withColumn("correct", (F.col("best") > 0).cast("int"))


def advantage(rewards: DataFrame, group: list[str], reward: str = "reward", eps: float = 1e-6) -> DataFrame:
    w = Window.partitionBy(*group)
    return rewards.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + eps))


def masked_mean(tokens: DataFrame, sequence: str, value: str, mask: str) -> DataFrame:
    """The mean over sequences of each one's mean over masked tokens (at least one in the divisor)."""
    per = tokens.groupBy(sequence).agg((F.sum(F.col(value) * F.col(mask)) / F.greatest(F.sum(mask), F.lit(1))).alias("m"))
    return per.agg(F.avg("m").alias("mean"))


def kl_estimate(delta: Column) -> Column:
    return F.exp(delta) - delta - 1


def preference_loss(chosen: Column, rejected: Column, margin: float = 0.0) -> Column:
    return F.log1p(F.exp(-(chosen - rejected - margin)))


def learning_rate(step: Column, lr: float, warmup: int, total: int, low: float = 0.0, schedule: str = "cosine") -> Column:
    done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / max(1, total - warmup)))
    after = {"constant": F.lit(lr), "linear": lr + (low - lr) * done}.get(schedule, low + (lr - low) * 0.5 * (1 + F.cos(F.pi() * done)))
    return F.when(step < warmup, lr * (step + 1) / max(1, warmup)).otherwise(after)


def annealed(step: Column, start: float, end: float, steps: int) -> Column:
    if steps <= 0:
        return F.lit(end)
    t = F.least(step, F.lit(steps)) / steps
    return start * (1 - t) + end * t


def entropy_floor(level: Column, start: float, end: float) -> Column:
    return start * level + end * (1 - level)


def reward_composition(rows: DataFrame, group: list[str]) -> DataFrame:
    """reward_mean, reward_std (of the group as a whole), correct_rate and format_rate of each rollout group; nulls are passed over."""
    return rows.groupBy(*group).agg(F.avg("reward").alias("reward_mean"), F.stddev_pop("reward").alias("reward_std"), F.avg("correct").alias("correct_rate"), F.avg("format").alias("format_rate"))


def clip_fraction(tokens: DataFrame, group: list[str], ratio: str, mask: str, epsilon: float) -> DataFrame:
    """The share of a group's unmasked tokens whose probability ratio is further than epsilon from 1; 0 without any."""
    far = (F.abs(F.col(ratio) - 1) > epsilon).cast("double") * F.col(mask)
    return tokens.groupBy(*group).agg((F.coalesce(F.sum(far), F.lit(0.0)) / F.greatest(F.sum(mask), F.lit(1))).alias("clip_frac"))


def validation_probe(batches: DataFrame, loss: str, order: str, most: int) -> DataFrame:
    """The mean loss of the first `most` batches."""
    return batches.orderBy(order).limit(most).agg(F.avg(loss).alias("val_loss"), F.count(F.lit(1)).alias("batches"))


def group_report(scores: DataFrame, by: list[str], permutations: int = 10_000, seed: int = 0, group: str = "group", block: str = "block") -> DataFrame:
    """by, kind, name, value, n, std, sem, ci95_low, ci95_high, p_value, method of the full comparison.

    Means of the groups (`summary`), mean deltas of all pairs with sign-flip p-values (`pairwise`) and, where there are three groups or
    more, the Friedman statistic (`omnibus`), whose p-value is taken from random shuffles unless permutations is 0.
    """
    none = lambda *names: {n: F.lit(None).cast("string" if n == "method" else "double") for n in names}
    spread = ("std", "sem", "ci95_low", "ci95_high")
    columns = [*by, "kind", "name", "value", "n", *spread, "p_value", "method"]
    means = group_summary(scores, [*by, group]).withColumns({"kind": F.lit("summary"), "name": F.col(group).cast("string"), "value": F.col("mean"), "n": F.col("n").cast("long"), **none("p_value", "method")})
    sizes = paired(scores, by, group, block).select(*by, "left", "right", F.size("diffs").cast("long").alias("n"))
    deltas = pairwise(scores, by, max(1, permutations), seed, group=group, block=block).join(sizes, [*by, "left", "right"])
    deltas = deltas.withColumns({"kind": F.lit("pairwise"), "name": F.concat_ws("-", "left", "right"), "value": F.col("mean_delta"), "method": F.lit(f"paired_permutation_{permutations}"), **none(*spread)})
    omnibus = friedman(scores, by, group, block).where("groups >= 3").withColumns({"kind": F.lit("omnibus"), "name": F.lit("friedman"), "value": F.col("statistic"), "n": F.col("blocks").cast("long"), **none(*spread)})
    if permutations:
        omnibus = omnibus.join(friedman_sampled(scores, by, permutations, seed, group, block).drop("statistic"), by).withColumn("method", F.lit(f"friedman_within_block_permutation_{permutations}"))
    else:
        omnibus = omnibus.withColumns(none("p_value", "method"))
    return means.select(columns).unionByName(deltas.select(columns)).unionByName(omnibus.select(columns))


def report_markdown(report: DataFrame, by: list[str]) -> DataFrame:
    """by, markdown: a table of the groups, of their comparisons and, if there is one, of the omnibus test. A comparison is a few rows."""
    number = lambda c, digits: F.coalesce(F.format_string(f"%.{digits}f", c), F.lit("-"))
    line = (
        F.when(F.col("kind") == "summary", F.format_string("| %s | %d | %.4f | %.4f | %.4f | [%.4f, %.4f] |", "name", "n", "value", "std", "sem", "ci95_low", "ci95_high"))
        .when(F.col("kind") == "pairwise", F.concat(F.lit("| "), F.replace("name", F.lit("-"), F.lit(" - ")), F.lit(" | "), number(F.col("value"), 4), F.lit(" | "), number(F.col("p_value"), 6), F.lit(" | "), F.coalesce("method", F.lit("-")), F.lit(" |")))
        .otherwise(F.concat(F.lit("| Friedman | "), number(F.col("value"), 4), F.lit(" | "), number(F.col("p_value"), 6), F.lit(" | "), F.coalesce("method", F.lit("-")), F.lit(" |")))
    )
    lines = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", line.alias("line"))))), lambda x: x["line"])
    heads = {"summary": ["| group | n | mean | sd | sem | 95% CI |", "|---|---:|---:|---:|---:|---:|"], "pairwise": ["", "| comparison | mean delta | p | method |", "|---|---:|---:|---|"], "omnibus": ["", "| omnibus | statistic | p | method |", "|---|---:|---:|---|"]}
    grouped = report.groupBy(*by).agg(*(lines(kind).alias(kind) for kind in heads))
    parts = [F.when((F.size(kind) > 0) | F.lit(kind != "omnibus"), F.concat(F.array(*map(F.lit, head)), F.col(kind))).otherwise(F.array().cast("array<string>")) for kind, head in heads.items()]
    title = F.concat(F.lit("### "), F.concat_ws(" ", *(F.col(c).cast("string") for c in by)))
    return grouped.select(*by, F.concat(F.array_join(F.concat(F.array(title, F.lit("")), *parts), "\n"), F.lit("\n")).alias("markdown"))
