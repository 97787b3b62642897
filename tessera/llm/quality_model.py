"""Quality scores of documents by kernel ridge regression on their statistics.

Random Fourier features approximate a Gaussian kernel over standardised document statistics.
Each partition sums its normal equations, one sum for each fold; the sums are added up, the
ridge system is solved on the driver (its size is the number of features), and the scores of
folds left out calibrate the final ones by isotonic regression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, named
from tessera.llm.host_quality import duplicate_lines, repeated_words
from tessera.llm.words import Texts, Words, slices

#: Random features, their kernel's width as a share of sqrt(statistics), ridge penalty per row, and seed.
FEATURES, WIDTH, PENALTY, SEED = 256, 0.7, 1e-4, 11
#: Raw scores from LOW to HIGH are calibrated in so many steps.
STEPS, LOW, HIGH = 4096, -1.0, 2.0
#: Folds by crc32 of the identifier; the last parameter is never learnt from.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7

STATISTICS = (
    "words", "word_chars", "symbols", "duplicate_lines", "repeated_words", "upper", "digits", "exclamations", "stops",
    "commas", "beyond_ascii", "bars", "at_signs", "line_breaks", "distinct_words", "short_words", "long_words",
    "longest_word", "entropy", "other_marks", "capitalised", "shouted",
)


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_SYMBOL, _DIGIT, _UPPER, _LETTER = _flags("#*$%&<>"), _flags("0123456789"), _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK = _flags("\"'()[]{}=+-_/\\^~`:;")


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; null and empty texts have zeros."""
    texts = Texts(column)
    words = Words(texts)
    data, n = texts.bytes, words.per_doc
    per_word = lambda x: x / np.maximum(n, 1)
    size = np.maximum(np.diff(texts.ends), 1)
    of = lambda flags: texts.sums(flags)
    doc_of = words.doc
    pairs = np.unique(doc_of * np.int64(max(len(words.distinct), 1)) + words.code)
    distinct = np.bincount(pairs // max(len(words.distinct), 1), minlength=texts.n)[: texts.n]
    longest = np.zeros(texts.n)
    np.maximum.at(longest, doc_of, words.lengths)
    some = lambda flags: np.bincount(doc_of[flags], minlength=texts.n)[: texts.n]
    first_upper = _UPPER[data[words.starts]] if len(words.starts) else np.zeros(0, bool)
    uppers = np.concatenate(([0], np.cumsum(_UPPER[data], dtype=np.int64)))
    upper_in = uppers[words.starts + words.lengths] - uppers[words.starts]
    entropy = np.zeros(texts.n)
    for i in range(texts.n):
        own = data[texts.ends[i] : texts.ends[i + 1]]
        if len(own):
            p = np.bincount(own, minlength=256)
            p = p[p > 0] / len(own)
            entropy[i] = -(p * np.log2(p)).sum()
    columns = (
        np.log1p(n),
        per_word(of(words.inside & ((data & 0xC0) != 0x80))),
        per_word(of(_SYMBOL[data])),
        per_word(duplicate_lines(texts)) * 10,
        per_word(repeated_words(words, texts.n)),
        of(_UPPER[data]) / np.maximum(of(_LETTER[data]), 1),
        of(_DIGIT[data]) / size * 10,
        per_word(of(data == 33)),
        per_word(of(data == 46)),
        per_word(of(data == 44)),
        of(data >= 0x80) / size,
        per_word(of(data == 124)),
        per_word(of(data == 64)) * 10,
        per_word(of(data == 10)) * 10,
        per_word(distinct),
        per_word(some(words.lengths <= 3)),
        per_word(some(words.lengths >= 12)),
        np.log1p(longest),
        entropy,
        of(_MARK[data]) / size * 10,
        per_word(some(first_upper)),
        per_word(some((upper_in >= 3) & (2 * upper_in > words.lengths))),
    )
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


def measure(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """__ident and stats (array) of each row's whole text."""
    slim = docs.select(named(ident).alias("__ident"), named(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                rows = statistics(part.column("__text"))
                ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
                yield pa.RecordBatch.from_arrays([part.column("__ident"), pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))], names=["__ident", "stats"])

    return slim.mapInArrow(run, f"__ident {slim.schema['__ident'].dataType.simpleString()}, stats array<double>")


class Model:
    """Standardisation, random features, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.turn = random.normal(size=(len(mean), features)) / (width * np.sqrt(len(mean)))
        self.shift = random.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(self.size)
        self.at, self.level = np.array([LOW, HIGH]), np.array([0.5, 0.5])

    @property
    def size(self) -> int:
        return 1 + len(self.mean) + len(self.shift)

    def design(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.shift)) * np.cos(x @ self.turn + self.shift)
        return np.hstack([np.ones((len(x), 1)), x, z])

    def raw(self, stats: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.design(stats) @ (self.weights if weights is None else weights)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """From 0 to 1; the small share of the raw score keeps the order inside flat steps."""
        raw = self.raw(stats)
        return 0.999 * np.interp(raw, self.at, self.level) + 0.001 / (1 + np.exp(-4 * np.clip(raw - 0.5, -9, 9)))


def solve(gram: np.ndarray, target: np.ndarray, rows: float, penalty: float = PENALTY) -> np.ndarray:
    ridge = np.full(len(target), penalty * max(rows, 1.0))
    ridge[0] = 1e-9
    return np.linalg.lstsq(gram + np.diag(ridge), target, rcond=None)[0]


def isotonic(score: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and levels of the rising step function nearest to good / count (pool adjacent violators)."""
    pooled: list[list[float]] = []
    for s, g, c in zip(score, good, count, strict=True):
        pooled.append([s * c, g, c])
        while len(pooled) > 1 and pooled[-2][1] / pooled[-2][2] >= pooled[-1][1] / pooled[-1][2]:
            last = pooled.pop()
            pooled[-1] = [a + b for a, b in zip(pooled[-1], last, strict=True)]
    # One more good and one more bad row in all keep the ends off 0 and 1.
    return np.array([s / c for s, _, c in pooled]), np.array([(g + 0.01) / (c + 0.02) for _, g, c in pooled])


def fold(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string")) % FOLDS, F.lit(0)).cast("int")


def fit(labelled: DataFrame, features: int = FEATURES) -> Model:
    """Fit on all rows of (stats, fold, label 0/1).

    A statistic that never varies is left at 0. Without rows, or with one class only, the model
    gives that class's share (0.5 without rows) to everything.
    """
    size = len(STATISTICS)
    spread = labelled.agg(F.count(F.lit(1)).alias("n"), *(f(F.col("stats")[i]).alias(f"{f.__name__}{i}") for i in range(size) for f in (F.avg, F.stddev_pop))).first()
    mean = np.array([spread[f"avg{i}"] or 0.0 for i in range(size)])
    deviation = np.array([spread[f"stddev_pop{i}"] or 0.0 for i in range(size)])
    model = Model(mean, np.where(deviation > 1e-12, deviation, 1e12), features)
    if not spread["n"]:
        return model
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(model)
    width = model.size

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, target, rows = np.zeros((FOLDS, width, width)), np.zeros((FOLDS, width)), np.zeros(FOLDS)
        for batch in batches:
            stats, label, of = _matrix(batch.column("stats")), batch.column("label").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)
            for k in np.unique(of):
                z = shared.value.design(stats[of == k])
                gram[k] += z.T @ z
                target[k] += z.T @ label[of == k]
                rows[k] += (of == k).sum()
        for k in np.flatnonzero(rows):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.concatenate((gram[k].ravel(), target[k], rows[k : k + 1])).tobytes()], pa.binary())], names=["fold", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("fold").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(raw)
        for k, value in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([value.tobytes()], pa.binary())], names=["fold", "sums"])

    shape = "fold int, sums binary"
    partial = labelled.select("stats", "fold", F.col("label").cast("double").alias("label")).mapInArrow(sums, shape)
    folds: dict[int, np.ndarray] = {}
    for r in partial.repartition(8).mapInArrow(added, shape).collect():  # 8 x FOLDS rows at most
        folds[r["fold"]] = folds.get(r["fold"], 0) + np.frombuffer(r["sums"])
    split = lambda v: (v[: width * width].reshape(width, width), v[width * width : -1], v[-1])
    total = sum(folds.values())
    model.weights = solve(*split(total))
    without = {k: solve(*split(total - v)) if len(folds) > 1 else model.weights for k, v in folds.items()}
    fitted = spark.sparkContext.broadcast((model, without))

    def raw_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fitted_model, of_fold = fitted.value
            stats, of = _matrix(batch.column("stats")), batch.column("fold").to_numpy(zero_copy_only=False)
            raw = np.zeros(len(of))
            for k in np.unique(of):
                raw[of == k] = fitted_model.raw(stats[of == k], of_fold[k])
            step = np.clip((raw - LOW) / (HIGH - LOW) * STEPS, 0, STEPS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(raw), batch.column("label")], names=["step", "raw", "label"])

    left_out = labelled.select("stats", "fold", F.col("label").cast("double").alias("label")).mapInArrow(raw_scores, "step int, raw double, label double")
    steps = left_out.groupBy("step").agg(F.avg("raw").alias("raw"), F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("step").collect()  # STEPS rows at most
    model.at, model.level = isotonic(*(np.array([r[c] for r in steps], float) for c in ("raw", "good", "n")))
    return model


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def quality_scores(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """ident, held_out, score and predicted for each row of docs.

    Only labels of rows outside the held-out fold are learnt from; null labels and labels of no
    document are passed over, and of several labels of one identifier the mean counts. Null texts count
    as empty; null identifiers are in fold 0 and have no label; repeated rows are scored each;
    an empty table gives an empty result; other columns are not looked at.
    """
    measured = materialise(measure(docs, ident, text), "quality-stats")
    known = labels.where(named(label).isNotNull() & (fold(named(ident)) != HELD_OUT)).groupBy(named(ident).alias("__ident")).agg(F.avg(named(label)).alias("label"))
    labelled = materialise(measured.join(known, "__ident").select("stats", fold(F.col("__ident")).alias("fold"), "label"), "quality-labelled")
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("__ident"), pa.array(model.value.score(_matrix(batch.column("stats"))))], names=["__ident", "score"])

    scored = measured.mapInArrow(run, f"__ident {measured.schema['__ident'].dataType.simpleString()}, score double")
    return scored.select(
        F.col("__ident").alias(ident),
        (fold(F.col("__ident")) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
