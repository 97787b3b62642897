"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are found by one pattern, with the text around them, by SQL functions. A random
forest over a candidate's length, character transitions, dictionary coverage, path and
neighbouring words, trained from labelled findings, tells secrets from what only looks alike.
Neither finding nor scoring leaves the JVM.

The dictionary is the vocabulary of the documents that are scanned: words of letters with
COMMON_COUNT occurrences or more. The transition model is the share of each letter behind each
other one in that vocabulary, so letters of a random key are improbable where those of a word of
the corpus' languages are not. What neighbouring words and path parts say of a candidate is
learnt from the labelled findings, as the logarithm of the odds of a secret beside each.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, named

#: Words that name a secret.
NEAR_SECRET = r"(?i)(secret|token|passw|pwd|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private)"
#: What stands before an assigned value: a name with a NEAR_SECRET word, an assignment, a quote or scheme.
ASSIGNED = rf"{NEAR_SECRET.replace('(?i)(', '(?i:')}[\w.-]{{0,24}}[\"'`]?\]?[ \t]{{0,4}}[=:]{{1,2}}>?[ \t]{{0,4}}[\"'`]?(?i:(?:bearer|basic)[ \t])?"
#: Private key headers; values of any length that are assigned to such a name, quoted ones to their quote
#: and others to a delimiter; runs of 16 or more key characters with a digit. '=' only pads the end of a run.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"
    rf"|(?<=[=:>\"'`\s])(?<=[=:]>?[ \t]{{0,4}}[\"'`]?(?i:(?:bearer|basic)[ \t])?)(?<={ASSIGNED})(?!-----BEGIN |//|(?i:bearer|basic)[ \t])(?:"
    r"(?<=\")[^\s\"]++(?=\")|(?<=')[^\s']++(?=')|(?<=`)[^\s`]++(?=`)"
    r"|(?<![\"'`])(?![=:>])[^\s\"'`&;,#<>(){}\[\]|]*[^\s\"'`&;,#<>(){}\[\]|.:])"
    r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+(?:={1,2}+(?![A-Za-z0-9_+/=-]|[\"'`][^\s,;)}\]]))?+"
)
#: Words of context on either side, on the candidate's line; a context ends at the next candidate, but holds one that the value is assigned to.
CONTEXT_WORDS = 8
JOINED = r"^[\"'`]?\]?[ \t]*[=:]{1,2}>?[ \t]*[\"'`]?$"
#: Least letters of a word of the vocabulary, and the occurrences of a common word.
LETTERS, COMMON_COUNT = 3, 20
#: Words beside a candidate on its line whose odds are learnt, on either side.
WORDS_BESIDE = 3
NEAR_OTHER = r"(?i)(sha-?\d|hash|commit|checksum|digest|md5|uuid|guid|card|isbn|version|revision|etag|build|integrity|order|phone)"
PLACEHOLDER = r"(?i)(example|sample|dummy|your|placeholder|changeme|xxxx|0000|1234567|abcdef|test)"
BENIGN_PATH = r"(?i)(test|spec|example|sample|fixture|doc|mock|demo)"
FEATURES = (
    "log_length", "class_changes", "transitions", "digits", "uppers", "marks", "distinct", "hex_only", "digits_only", "coverage", "placeholder",
    "path_benign", "path_odds", "near_secret", "near_other", "beside_odds", "assigned", "quoted", "key_header", "known_prefix",
)
KNOWN_PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|ya29|eyJ|npm_|hf_)"
TREES, DEPTH, SEED = 24, 7, 5
#: Rows of the built-in labelled findings.
LABELLED_ROWS = 6_000


def _near(gap: Column, ahead: bool) -> Column:
    """The CONTEXT_WORDS words of a gap that are next to a candidate on its line, with what stands between them."""
    line = F.substring_index(gap, "\n", -1 if ahead else 1)
    words = F.regexp_extract_all(line, F.lit("[^A-Za-z]++[A-Za-z]*+|[A-Za-z]++"), F.lit(0)) if ahead else F.regexp_extract_all(line, F.lit("[A-Za-z]++[^A-Za-z]*+|[^A-Za-z]++"), F.lit(0))
    return F.array_join(F.reverse(F.slice(F.reverse(words), 1, CONTEXT_WORDS + 1)) if ahead else F.slice(words, 1, CONTEXT_WORDS + 1), "")


def find_candidates(docs: DataFrame, ident: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """ident, path, start_char, end_char, candidate, before, after for each candidate of the whole texts.

    start_char and end_char count code points from 0, the end not included. before and after are
    the neighbouring words on the line. Null and empty texts
    and tables have no candidates; repeated rows have theirs each; other columns are not looked at.
    """
    whole = docs.select(
        named(ident).alias("__ident"),
        named(path).cast("string").alias("__path"),
        F.regexp_extract_all(named(text), F.lit(CANDIDATE), F.lit(0)).alias("__found"),
        named(text).alias("__text"),
    ).where(F.size("__found") > 0)
    gaps = whole.withColumn("__gaps", F.split("__text", CANDIDATE, -1)).drop("__text")
    ends = F.aggregate(
        F.sequence(F.lit(0), F.size("__found") - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, i: F.struct(
            (acc["at"] + F.char_length(F.get("__gaps", i)) + F.char_length(F.get("__found", i))).alias("at"),
            F.array_append(acc["starts"], acc["at"] + F.char_length(F.get("__gaps", i))).alias("starts"),
        ),
    )
    gaps = gaps.withColumn("__starts", ends["starts"])
    each = F.transform(
        "__found",
        lambda found, i: F.struct(
            found.alias("candidate"),
            F.get("__starts", i).alias("start_char"),
            _near(F.when((i > 0) & F.get("__gaps", i).rlike(JOINED), F.concat(F.get("__found", i - 1), F.get("__gaps", i))).otherwise(F.get("__gaps", i)), True).alias("before"),
            _near(F.get("__gaps", i + 1), False).alias("after"),
        ),
    )
    one = gaps.select("__ident", "__path", F.explode(each).alias("__c"))
    return one.select(
        F.col("__ident").alias(ident),
        F.col("__path").alias("path"),
        F.col("__c.start_char").cast("long").alias("start_char"),
        (F.col("__c.start_char") + F.char_length("__c.candidate")).cast("long").alias("end_char"),
        F.col("__c.candidate").alias("candidate"),
        F.col("__c.before").alias("before"),
        F.col("__c.after").alias("after"),
    )


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n of the words of LETTERS letters or more in the whole texts, in lower case: counts by a pre-aggregated shuffle."""
    words = F.regexp_extract_all(F.lower(named(text)), F.lit(rf"(?<![a-z])[a-z]{{{LETTERS},}}+"), F.lit(0))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def transition_table(words: DataFrame) -> dict[str, float]:
    """For each pair of letters the logarithm of the second's share behind the first in common words; pairs never seen count once."""
    pairs = words.where(F.col("n") >= COMMON_COUNT).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    seen = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # 676 rows at most
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    out = {}
    for a in letters:
        total = sum(seen.get(a + b, 0) + 1 for b in letters)
        out |= {a + b: math.log((seen.get(a + b, 0) + 1) / total) for b in letters}
    return out


@dataclass(frozen=True)
class Knowledge:
    """What the features take from a corpus and from labelled findings. words: word, n, a table of the common ones."""

    words: DataFrame
    transitions: dict[str, float]
    beside: dict[str, float]
    path: dict[str, float]


def _line(context: Column, end: bool) -> Column:
    """What of a context stands on the candidate's line."""
    return F.regexp_extract(F.coalesce(context, F.lit("")), r"([^\n]*)$" if end else r"^([^\n]*)", 1)


def beside_words(before: Column, after: Column) -> Column:
    """The words beside a candidate on its line, marked by their side."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]{2,}"), F.lit(0))
    left, right = words(_line(before, True)), words(_line(after, False))
    marked = lambda a, side: F.transform(a, lambda w: F.concat(F.lit(side), w))
    return F.concat(marked(F.slice(F.reverse(left), 1, WORDS_BESIDE), "<"), marked(F.slice(right, 1, WORDS_BESIDE), ">"))


def path_parts(path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(path, F.lit(""))), F.lit("[a-z]{2,}"), F.lit(0)))


def odds(labelled: DataFrame, parts: Column) -> dict[str, float]:
    """For each part the logarithm of the odds of a secret with it, drawn towards the overall odds; as many as the labelled rows have."""
    each = labelled.select(F.col("secret").cast("double").alias("s"), F.explode(F.array_distinct(parts)).alias("part"))
    rows = each.groupBy("part").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n")).collect()  # a few for each labelled row
    whole = labelled.agg(F.avg(F.col("secret").cast("double"))).first()[0]
    mean = min(max(whole if whole is not None else 0.5, 0.01), 0.99)
    share = {r["part"]: (r["s"] + 4 * mean) / (r["n"] + 4) for r in rows}
    return {k: math.log(p / (1 - p)) - math.log(mean / (1 - mean)) for k, p in share.items()}


def _looked_up(table: dict[str, float], parts: Column) -> Column:
    """The values of those parts that the table knows; the table is a constant of the plan."""
    known = F.from_json(F.lit(json.dumps(table)), "map<string,double>")
    return F.filter(F.transform(parts, lambda p: F.try_element_at(known, p)), lambda x: x.isNotNull())


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _coverage(findings: DataFrame, words: DataFrame) -> DataFrame:
    """candidate, coverage: the share of its characters in common words, for each distinct candidate.

    Its runs of letters are cut at capitals too, as in clientSecret, and looked up by a join.
    """
    runs = F.regexp_extract_all(F.regexp_replace("candidate", r"([a-z])([A-Z])", "$1 $2"), F.lit(rf"[A-Za-z]{{{LETTERS},}}"), F.lit(0))
    each = findings.select("candidate").where("candidate IS NOT NULL").distinct().select("candidate", F.explode_outer(F.transform(runs, F.lower)).alias("word"))
    covered = F.sum(F.when(F.col("n").isNotNull(), F.char_length("word")).otherwise(0))
    return each.join(words, "word", "left").groupBy("candidate").agg(covered.alias("__covered")).select(F.col("candidate").alias("__candidate"), "__covered")


def _featured(findings: DataFrame, known: Knowledge) -> DataFrame:
    c, before, after = F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    size = F.greatest(F.char_length(c), F.lit(1))
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / size
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    runs = F.regexp_count(c, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"))
    near = _line(before, True)
    low = F.lower(c)
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(2))), lambda p: p.rlike("^[a-z]{2}$"))
    steps = _looked_up(known.transitions, pairs)
    values: dict[str, Column] = {
        "log_length": F.log(size.cast("double")),
        "class_changes": (runs - 1) / size,
        "transitions": F.coalesce(F.try_divide(_total(steps), F.size(steps)), F.lit(0.0)),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "marks": share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(64)),
        "hex_only": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "digits_only": flag(c.rlike("^[0-9=/+_-]+$")),
        "coverage": F.coalesce("__covered", F.lit(0)) / size,
        "placeholder": flag(c.rlike(PLACEHOLDER)),
        "path_benign": flag(F.col("path").rlike(BENIGN_PATH)),
        "path_odds": _total(_looked_up(known.path, path_parts(F.col("path")))),
        "near_secret": flag(near.rlike(NEAR_SECRET)),
        "near_other": flag(near.rlike(NEAR_OTHER)),
        "beside_odds": _total(_looked_up(known.beside, beside_words(before, after))),
        "assigned": flag(before.rlike(r"[=:]>?\s*[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "key_header": flag(c.startswith("-----BEGIN")),
        "known_prefix": flag(c.rlike(KNOWN_PREFIX)),
    }
    covered = findings.join(_coverage(findings, known.words), F.col("candidate") == F.col("__candidate"), "left")
    return covered.withColumns({f"__{k}": v.cast("double") for k, v in values.items()}).drop("__candidate", "__covered")


#: Words of look-alike values in the built-in findings.
PLAIN_WORDS = (
    "account", "admin", "branch", "build", "cache", "client", "column", "config", "count", "data", "default", "error", "event", "file", "final",
    "group", "image", "index", "item", "label", "level", "list", "local", "main", "model", "name", "node", "number", "object", "order", "page",
    "path", "point", "project", "query", "record", "release", "report", "request", "result", "section", "server", "session", "source", "stage",
    "start", "state", "table", "task", "text", "time", "title", "token", "user", "value", "version",
)


def labelled_findings(spark: SparkSession, rows: int = LABELLED_ROWS, seed: str = "labelled") -> DataFrame:
    """candidate, before, after, path, secret: labelled findings of the usual kinds, from a seed."""
    r = lambda name: F.sha2(F.concat_ws(":", F.lit(f"{seed}:{name}"), F.col("id")), 256)
    pick = lambda name, options: F.element_at(F.array(*map(F.lit, options)), (F.conv(F.substring(r(name), 1, 7), 16, 10).cast("int") % len(options)) + 1)
    hexes = r("h")
    base62 = F.translate(F.base64(F.unhex(F.concat(r("b"), r("c")))), "+/=", "xK7")
    digits = F.translate(F.concat(r("d"), r("e")), "abcdef", "490372")
    words = F.concat_ws("_", *(pick(f"w{i}", PLAIN_WORDS) for i in range(4)), F.substring(digits, 1, 2))
    hex_length, key_length = F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), F.col("id").cast("int") % 3 + 1), F.lit(20) + F.col("id").cast("int") % 25
    any_hex = F.when(F.col("id") % 5 == 0, F.upper(F.substring(hexes, F.lit(1), hex_length))).otherwise(F.substring(hexes, F.lit(1), hex_length))
    secret_before = F.concat(pick("ws", ("", "set ", "my ", "export ", "\n", "  ")), pick("n", ("token", "secret", "api_key", "apiKey", "password", "auth_token", "ACCESS_KEY", "TOKEN", "client_secret", "Authorization")), pick("eq", (" = \"", "=", ": ", ": '", "=\"", " = '", ": Bearer ")))
    letters = F.translate(base62, "0123456789", "qRtYpLkJhG")
    short_length = F.lit(7) + F.col("id").cast("int") % 7
    password = F.concat(F.substring(base62, F.lit(1), short_length), pick("pm", ("!", "#7", "@9", "$3x", "", "%2B")))
    plain_value = F.concat(pick("pv", ("", "", "get_", "my-", "$", "${")), pick("pw", (*PLAIN_WORDS, "none", "null", "true", "false", "str", "the", "required", "invalid", "Smith", "never", "None", "and")))
    plain_value = F.when(plain_value.startswith("${"), F.concat(plain_value, F.lit("}"))).otherwise(plain_value)
    other_before = F.concat(pick("wo", ("", "see ", "the ", "\n")), pick("o", ("commit ", "sha256: ", "sha1=", "checksum = \"", "md5 ", "etag: \"", "uuid=", "revision ", "integrity: ", "build ", "order ", "card ")))
    plain_before = pick("p", ("this one ", "some of it, ", "item ", "\n", "line ", "", "call ", "under ", "| "))
    uuid = F.concat_ws("-", *(F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    kinds = [  # candidate, before, secret
        (any_hex, secret_before, True),
        (F.substring(base62, F.lit(1), key_length), secret_before, True),
        (F.concat(pick("pre", ("AKIA", "ghp_", "sk_live_", "xoxb-", "AIza", "hf_")), F.substring(base62, 1, 24)), F.when(F.col("id") % 2 == 0, secret_before).otherwise(plain_before), True),
        (any_hex, secret_before, True),
        (F.concat(F.substring(base62, 1, 12), F.lit("/"), F.substring(base62, 20, 27)), secret_before, True),
        (any_hex, other_before, False),
        (F.substring(digits, 1, 16), F.when(F.col("id") % 2 == 0, other_before).otherwise(plain_before), False),
        (words, F.when(F.col("id") % 2 == 0, secret_before).otherwise(plain_before), False),
        (uuid, other_before, False),
        (F.concat(pick("ph", ("your_api_key_here_", "xxxxxxxxxxxxxxxx", "example_token_value_", "0000000000000000", "changeme-changeme-")), F.substring(digits, 1, 1)), secret_before, False),
        (F.concat(F.lit("20"), F.substring(digits, 1, 2), F.lit("-01-02T03-04-"), F.substring(digits, 3, 2)), plain_before, False),
        (F.concat(F.lit("/srv/"), words), plain_before, False),
        (F.substring(digits, 1, 16), secret_before, False),
        (password, secret_before, True),
        (F.substring(letters, F.lit(1), key_length), secret_before, True),
        (plain_value, secret_before, False),
    ]
    kind = (F.col("id") % len(kinds)).cast("int")
    choose = lambda i: F.element_at(F.array(*(F.lit(k[i]) if isinstance(k[i], bool) else k[i] for k in kinds)), kind + 1)
    return spark.range(0, rows, 1, 4).select(
        choose(0).alias("candidate"),
        choose(1).alias("before"),
        F.when(choose(1).rlike("\"$"), F.lit("\" ")).when(choose(1).rlike("'$"), F.lit("' ")).otherwise(F.lit(" ")).alias("after"),
        pick("path", ("src0", "app/main.py", "web", "tests/test_api.py", "docs/guide.md", "srv", "src12", "lib/util.go")).alias("path"),
        choose(2).alias("secret"),
    )


@dataclass(frozen=True)
class Detector:
    """A fitted forest and what its features look up."""

    forest: RandomForestClassificationModel
    known: Knowledge


def train_forest(labelled: DataFrame, words: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Detector:
    """Fit on labelled findings (candidate, before, after, path, secret), a table that fits the driver; null labels and candidates are passed over.

    words is the vocabulary() of the corpus; its common words are written and kept for scoring.
    A table without labelled findings is an error of the forest.
    """
    rows = labelled.where(F.col("secret").isNotNull() & F.col("candidate").isNotNull())
    counted = materialise(words, "vocabulary")
    common = counted.where(F.col("n") >= COMMON_COUNT)
    known = Knowledge(common, transition_table(counted), odds(rows, beside_words(F.col("before"), F.col("after"))), odds(rows, path_parts(F.col("path"))))
    ready = _assembled(rows, known).select("__features", F.col("secret").cast("double").alias("__label"))
    forest = RandomForestClassifier(featuresCol="__features", labelCol="__label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
    return Detector(forest.fit(materialise(ready, "findings")), known)


def _assembled(findings: DataFrame, known: Knowledge) -> DataFrame:
    return VectorAssembler(inputCols=[f"__{f}" for f in FEATURES], outputCol="__features").transform(_featured(findings, known))


def masked(candidate: Column) -> Column:
    """A candidate's first two characters and its length."""
    return F.concat(F.left(candidate, F.lit(2)), F.lit("...("), F.char_length(candidate).cast("string"), F.lit(")"))


def scan_secrets(docs: DataFrame, detector: Detector, ident: str = "doc_id", text: str = "text", path: str = "source", threshold: float = 0.5, clear: bool = False) -> DataFrame:
    """ident, start_char, end_char, candidate_sha256, masked, score, secret [, candidate] for each candidate of docs.

    The candidates are those of find_candidates(), written once. A null path is the empty path; null and empty texts have
    no candidates; a very long text is searched whole; repeated rows have their candidates each;
    an empty table gives an empty result; other columns are not looked at.
    """
    found = materialise(find_candidates(docs, ident, text, path), "candidates")
    forest = detector.forest.setProbabilityCol("__p").setRawPredictionCol("__raw").setPredictionCol("__predicted")
    score = F.round(vector_to_array("__p")[1], 6)
    scored = forest.transform(_assembled(found, detector.known))
    shown = [F.sha2("candidate", 256).alias("candidate_sha256"), masked(F.col("candidate")).alias("masked"), score.alias("score"), (score >= threshold).alias("secret")]
    return scored.select(named(ident), "start_char", "end_char", *shown, *(["candidate"] if clear else []))


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_secrets(docs, train_forest(labelled_findings(spark), vocabulary(docs)))
