"""Column functions over text: normalisation, quality rules, fingerprints, answer extraction."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Fixed values of the cleaning rules.
MIN_CHARS, MAX_CHARS = 64, 500_000
MIN_ALNUM_CJK_RATIO, MAX_SINGLE_CHAR_RATIO = 0.4, 0.3
MAX_LINE_REPEAT, MIN_REPEATED_LINE = 30, 4
DEDUP_HASH_PREFIX = 512
CJK = r"぀-ゟ゠-ヿ一-鿿ｦ-ﾟ"

#: Characters that NFKC never changes alone or together; texts of these skip the Arrow function.
_STABLE = r"^[\x00-\x9f¡-§©«-®°±¶·»¿-ı]*$"


@F.pandas_udf(StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC; only texts that it may change are sent to Python."""
    return F.coalesce(_nfkc(F.when(~text.rlike(_STABLE), text)), text)


def strip_u(text: Column) -> Column:
    """Take Unicode white space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize(text: Column, compatibility: bool = True) -> Column:
    """NFKC, tabs and no-break spaces to one space, three or more line breaks to two, strip."""
    text = nfkc(text) if compatibility else text
    return strip_u(F.regexp_replace(F.regexp_replace(text, "[\t ]+", " "), "\n{3,}", "\n\n"))


def alnum_count(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def cjk_count(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, f"[^{CJK}]", ""))


@F.pandas_udf(IntegerType())
def _top_char_count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: max(Counter(t).values(), default=0), na_action="ignore").astype("Int32")


def top_char_count(text: Column) -> Column:
    """Occurrences of the most common character, in time in proportion to the text whatever its alphabet."""
    return _top_char_count(text)


def max_line_repeat(text: Column) -> Column:
    """Most occurrences of one stripped line of MIN_REPEATED_LINE or more characters: a run in the sorted lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip_u), lambda x: F.char_length(x) >= MIN_REPEATED_LINE)
    start = F.struct(F.lit(None).cast("string").alias("line"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, line: Column) -> Column:
        run = F.when(acc["line"] == line, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(line.alias("line"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.array_sort(lines), start, step, lambda acc: acc["best"])


def quality_reason(text: Column) -> Column:
    """The first rule that a text fails, null if it passes all."""
    n = F.char_length(text)
    return (
        F.when(n < MIN_CHARS, "short")
        .when(n > MAX_CHARS, "long")
        .when((alnum_count(text) + cjk_count(text)) / n < MIN_ALNUM_CJK_RATIO, "low_alnum_cjk_ratio")
        .when(top_char_count(text) / n >= MAX_SINGLE_CHAR_RATIO, "single_char")
        .when(max_line_repeat(text) >= MAX_LINE_REPEAT, "line_repeat")
    )


@functools.cache
def _classes() -> np.ndarray:
    """For each code point how often it counts for the ratio: once as a letter or number, once as CJK."""
    table = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), np.uint8, 0x110000)
    for first, last in zip(CJK[::3], CJK[2::3], strict=True):
        table[ord(first) : ord(last) + 1] += 1
    return table


def clean_text(text: str) -> tuple[str, str | None]:
    """A text normalised as by normalize(), and the first rule that it fails as by quality_reason()."""
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if "\t" in text or "\xa0" in text:
        text = re.sub("[\t\xa0]+", " ", text)
    if "\n\n\n" in text:
        text = re.sub("\n{3,}", "\n\n", text)
    text = text.strip()
    n = len(text)
    if not MIN_CHARS <= n <= MAX_CHARS:
        return text, "short" if n < MIN_CHARS else "long"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if int(_classes()[points].sum()) / n < MIN_ALNUM_CJK_RATIO:
        return text, "low_alnum_cjk_ratio"
    most = np.bincount(points).max() if points.max() < 1 << 14 else np.unique(points, return_counts=True)[1].max()
    if most / n >= MAX_SINGLE_CHAR_RATIO:
        return text, "single_char"
    if text.count("\n") >= MAX_LINE_REPEAT - 1:
        lines = Counter(x for x in map(str.strip, text.split("\n")) if len(x) >= MIN_REPEATED_LINE)
        if max(lines.values(), default=0) >= MAX_LINE_REPEAT:
            return text, "line_repeat"
    return text, None


_CLEANED = StructType([StructField("text", StringType()), StructField("reason", StringType())])


@F.pandas_udf(_CLEANED)
def _clean(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([(None, None) if t is None else clean_text(t) for t in s], columns=["text", "reason"], dtype=object)


def clean(text: Column) -> Column:
    """A struct of the normalised text and the first rule that it fails (null if it passes all), by one pass over the text; nulls for null."""
    return _clean.asNondeterministic()(text)  # its fields would otherwise be conditions that each call it again


def prefix_hash(text: Column) -> Column:
    return F.sha1(F.substring(text, 1, DEDUP_HASH_PREFIX))


def exact_hash(text: Column) -> Column:
    return F.sha1(text)


def fingerprint(text: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.regexp_replace(strip_u(text), r"(?U)\s+", " "))


def truthy(text: Column) -> Column:
    """Null for the empty string, so that coalesce() reads as `a or b`."""
    return F.nullif(text, F.lit(""))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.char_length(text))))


def fill(template: str, fields: dict[str, Column]) -> Column:
    """Literal, sequential {field} substitution; missing values are empty."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return strip_u(out)


def chat_text(prompt: Column, response: Column, system: Column | None = None) -> Column:
    system = F.lit(None).cast("string") if system is None else system
    return F.concat_ws("\n\n", F.when(strip_u(system) != "", F.concat(F.lit("System: "), strip_u(system))), F.concat(F.lit("User: "), strip_u(prompt)), F.concat(F.lit("Assistant: "), strip_u(response)))


def file_safe(repo: Column) -> Column:
    """A repository id as a file name."""
    return F.regexp_replace(F.replace(repo, F.lit("/"), F.lit("__")), r"[^A-Za-z0-9_.-]", "_")


def duration_label(seconds: Column) -> Column:
    """Seconds as 5s, 2m 5s or 3h 2m; null as -."""
    total = F.bround(seconds).cast("long")
    part = lambda c, unit: F.concat(c.cast("long").cast("string"), F.lit(unit))
    return (
        F.when(seconds.isNull(), "-")
        .when(total < 60, part(total, "s"))
        .when(total < 3600, F.concat_ws(" ", part(F.floor(total / 60), "m"), part(total % 60, "s")))
        .otherwise(F.concat_ws(" ", part(F.floor(total / 3600), "h"), part(F.floor(total / 60) % 60, "m")))
    )


# Answers in responses.

TAGGED = r"(?s)<think>(.*?)</think>\s*<answer>(.*?)</answer>"
FENCED = r"(?is)```(?:python|py|json|rust|rs|go|typescript|ts|csharp|c#|cs)?\s*\n?(.*?)```"
#: Fences of teachers' answers and of code to run; FENCED is that of responses.
CODE_FENCED, RUN_FENCED = r"(?is)```(?:python|py|json)?\s*\n?(.*?)```", r"(?s)```(?:python|py)?\s*\n?(.*?)```"
NUMBER = r"-?\d+(?:\.\d+)?"
REFUSAL = r"(?i)\b(?:i\s+(?:can'?t|cannot|won'?t)\s+help|sorry[, ]+i\s+(?:can'?t|cannot)|i(?:'| a)?m sorry)\b"
FALLBACK = r"(?is)\b(?:normalized from teacher output|def\s+solve\(\).*return\s+None|i\s+(?:can'?t|cannot|won'?t)\s+help|sorry[, ]+i\s+(?:can'?t|cannot))\b"


def tagged_answer(response: Column) -> Column:
    """The answer of a think/answer pair; null if absent, blank or over four times as long as the thought."""
    think, answer = strip_u(F.regexp_extract(response, TAGGED, 1)), strip_u(F.regexp_extract(response, TAGGED, 2))
    sound = response.rlike(TAGGED) & (think != "") & (answer != "") & (F.char_length(answer) <= 4 * F.char_length(think))
    return F.when(sound, answer)


def unfenced(response: Column, fence: str = FENCED) -> Column:
    """The first fenced block, or the whole without one."""
    return strip_u(F.when(response.rlike(fence), F.regexp_extract(response, fence, 1)).otherwise(response))


def last_number(text: Column) -> Column:
    plain = F.regexp_replace(F.replace(strip_u(text), F.lit(","), F.lit("")), r"\.+$", "")
    return F.try_element_at(F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(0)), F.lit(-1))


def gold_number(reference: Column) -> Column:
    pattern = r"####\s*(-?\d+(?:\.\d+)?)"
    return F.coalesce(truthy(F.regexp_extract(reference, pattern, 1)), last_number(reference))


def last_choice(text: Column) -> Column:
    return F.upper(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?i)\b([A-E])\b"), F.lit(1)), F.lit(-1)))


def ngram_excess(text: Column, n: int = 5, most: int = 3) -> Column:
    """Occurrences of n-grams of words beyond `most` each, from runs in the sorted n-grams."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    of = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    grams = F.flatten(F.transform(F.array(words), of))  # the words are split once, not once for each n-gram
    start = F.struct(F.lit(None).cast("string").alias("gram"), F.lit(0).alias("run"), F.lit(0).alias("over"))

    def step(acc: Column, gram: Column) -> Column:
        run = F.when(acc["gram"] == gram, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(gram.alias("gram"), run.alias("run"), (acc["over"] + (run > most).cast("int")).alias("over"))

    return F.aggregate(F.array_sort(grams), start, step, lambda acc: acc["over"])
