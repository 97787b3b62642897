"""Named sources below a root folder: what is ingested, from which files and by which projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import text as T
from tessera.operators import records as R
from tessera.sources import readers

TURNS = "array<struct<from:string,role:string,value:string,content:string>>"
#: Columns of the detection sources beside the text; a source that lacks one leaves it null.
LABELS = ("label", "category", "severity", "confidence", "language", "nsfw_label", "instruction", "target")


@dataclass(frozen=True)
class Entry:
    """One block of a registry: files below the root, how they are read, and what text they give."""

    stem: str
    path: str
    kind: str  # jsonl, array or parquet
    schema: str
    text: Callable[[], Column]
    most_files: int | None = None
    labels: dict[str, Callable[[], Column]] = field(default_factory=dict)
    dataset: str = ""


def _first(*names: str) -> Callable[[], Column]:
    return lambda: R.plain(*names)


def _conversation() -> Column:
    turns = F.transform("conversations", lambda t: F.struct(F.coalesce(T.truthy(t["from"]), t["role"]).alias("role"), F.coalesce(T.truthy(t["value"]), t["content"]).alias("content")))
    return R.render_turns(turns)


_CHAT, _TEXT, _TASK = f"conversations {TURNS}", "text STRING, original_text STRING", "instruction STRING, output STRING, response STRING"


def _instructed() -> Column:
    return R.instruction_output(F.col("instruction"), F.coalesce(T.truthy(F.col("output")), F.col("response")))


# Fixed values of the registry: stems, places and slices.
PRETRAIN = (
    Entry("webdataset_alpaca_ja", "datasets/FreedomIntelligence_alpaca-gpt4-japanese/alpaca-gpt4-japanese.json", "array", _CHAT, _conversation),
    Entry("webdataset_sharegpt_ja", "datasets/FreedomIntelligence_sharegpt-japanese/sharegpt-japanese.json", "array", _CHAT, _conversation),
    Entry("webdataset_fujiki_ja", "datasets/fujiki_japanese_hh-rlhf-49k/data/*.parquet", "parquet", "prompt STRING, chosen STRING, text STRING", lambda: R.chosen_only(F.col("prompt"), F.coalesce(T.truthy(F.col("chosen")), F.col("text")))),
    Entry("webdataset_oasst2", "datasets/OpenAssistant_oasst2/2023-11-05_oasst2_ready.messages.jsonl.gz", "jsonl", "role STRING, text STRING", lambda: R.message(F.col("role"), F.col("text"))),
    Entry("webdataset_wizard_vicuna", "datasets/ehartford_wizard_vicuna_70k_unfiltered/wizard_vicuna_dataset_unfiltered.json", "array", _CHAT, _conversation),
    Entry("webdataset_slimpajama", "datasets/cerebras_SlimPajama-627B/test/chunk1/*.jsonl.zst", "jsonl", _TEXT, _first("text", "original_text"), most_files=200),
    Entry("webdataset_coding", "coding_dataset/*.jsonl", "jsonl", _TEXT, _first("text", "original_text")),
    Entry("webdataset_coding_train", "coding_training_data/*.jsonl", "jsonl", _TASK, _instructed),
    Entry("webdataset_domain_knowledge", "domain_knowledge_collected/*_cleaned.jsonl", "jsonl", _TASK, _instructed),
    Entry("webdataset_phi35", "phi35_integrated/phi35_ppo_optimized_integrated.jsonl", "jsonl", _TEXT, _first("text", "original_text")),
)

def _or(name: str, default: str) -> Callable[[], Column]:
    """A field, or the default where it is missing."""
    return lambda: F.coalesce(F.col(name).cast("string"), F.lit(default))


def _col(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


# Fixed values of the detection registry: stems, places, fields, defaults and names.
_NSFW = "text STRING, nsfw_label STRING, category STRING, nsfw_severity STRING, nsfw_confidence DOUBLE, language STRING"
_FOUR = "instruction STRING, input STRING, output STRING, four_class_label STRING, category STRING, nsfw_label STRING, language STRING"
_OF_NSFW = {"label": _or("nsfw_label", "unknown"), "category": _or("category", ""), "severity": _col("nsfw_severity"), "confidence": _col("nsfw_confidence"), "language": _col("language")}
_OF_DRUG = {"label": _or("category", "unknown"), "language": _col("language")}
_OF_FOUR = {"label": _or("four_class_label", "unknown"), "category": _or("category", ""), "nsfw_label": _col("nsfw_label"), "instruction": _col("instruction"), "target": _col("output"), "language": _col("language")}
_OF_NOVELS = {"label": lambda: F.lit("nsfw_raw"), "category": lambda: F.lit("japanese_nsfw_fiction")}
DETECTION = (
    *(Entry(f"detection_nsfw_{s}", f"nsfw_detection_dataset/nsfw_detection_{s}.jsonl", "jsonl", _NSFW, _first("text"), labels=_OF_NSFW, dataset="nsfw_detection") for s in ("train", "val")),
    *(Entry(f"detection_drug_{s}", f"drug_pharmaceutical_detection_dataset/drug_pharmaceutical_detection_{s}.jsonl", "jsonl", "text STRING, category STRING, language STRING", _first("text"), labels=_OF_DRUG, dataset="drug_detection") for s in ("train", "val")),
    Entry("detection_4class_qlora", "nsfw_drug_detection_qlora_training_data/*.jsonl", "jsonl", _FOUR, _first("input"), labels=_OF_FOUR, dataset="nsfw_drug_qlora"),
    Entry("detection_elizezen_nsfw", "datasets/Elizezen_japanese-nsfw-syosetsu-dataset/nsfw_0.json", "array", "text STRING, content STRING, data array<struct<text:string,content:string>>", _first("text", "content"), labels=_OF_NOVELS, dataset="elizezen_nsfw_syosetsu"),
    *(Entry(f"detection_nsfw_safe_{s}", f"datasets/eliasalbouzidi_NSFW-Safe-Dataset/data/{s}-*.parquet", "parquet", "text STRING, content STRING, label STRING", _first("text", "content"), labels={"label": _or("label", "unknown")}, dataset="eliasalbouzidi_nsfw_safe") for s in ("train", "test")),
)


def _files(spark: SparkSession, pattern: str) -> list[str]:
    """The files of a pattern, by name; none if there are none. Names only are read."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(f.getPath().toString() for f in found or ())


def _read(spark: SparkSession, entry: Entry, files: list[str]) -> DataFrame:
    """The entry's fields. Parquet files may have them as other types, or lack some; an array may also be the field `data` of an object."""
    if entry.kind == "parquet":
        rows = spark.read.parquet(*files)
        fields = StructType.fromDDL(entry.schema).fields
        return rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    if entry.kind == "array":
        rows = spark.read.schema(entry.schema).option("multiLine", True).json(files)
        if "data" not in rows.columns:
            return rows
        nested = F.struct(*(c for c in rows.columns if c != "data"))
        return rows.select(F.explode(F.coalesce("data", F.array(nested))).alias("o")).select("o.*")
    return readers.jsonl(spark, files, entry.schema)


def ingest(spark: SparkSession, root: str, entries: tuple[Entry, ...], least: int = 32) -> DataFrame:
    """stem, text [, labels, source_dataset] of all entries whose files are there, as one union.

    Texts are stripped, and those of less than `least` characters are left out. Entries of one
    stem are one corpus. No entry with files gives an empty table.
    """
    frames = []
    for entry in entries:
        if files := _files(spark, f"{root}/{entry.path}")[: entry.most_files]:
            labels = [entry.labels[n]().cast("string").alias(n) if n in entry.labels else F.lit(None).cast("string").alias(n) for n in LABELS]
            rows = _read(spark, entry, files).select(F.lit(entry.stem).alias("stem"), T.strip_u(entry.text()).alias("text"), *labels, F.lit(entry.dataset).alias("source_dataset"))
            frames.append(rows.where(F.char_length("text") >= least))
    shape = "stem STRING, text STRING, " + ", ".join(f"{n} STRING" for n in LABELS) + ", source_dataset STRING"
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], shape)


def expanded(spark: SparkSession, entries: list[dict]) -> list[dict]:
    """Manifest entries with one entry for each file: a folder stands for its files, by name, .txt ones for txt and .jsonl ones for other types."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for e in entries:
        place = jvm.org.apache.hadoop.fs.Path(e["path"])
        files = place.getFileSystem(conf)
        if not (files.exists(place) and files.getFileStatus(place).isDirectory()):
            out.append(dict(e))
            continue
        ending, found, walk = ".txt" if e["type"] == "txt" else ".jsonl", [], files.listFiles(place, True)
        while walk.hasNext():
            name = walk.next().getPath().toString()
            if name.endswith(ending):
                found.append(name)
        out += [e | {"path": name} for name in sorted(found)]
    return out


def landed(spark: SparkSession, root: str, repo: str, config: str = "default", split: str = "train") -> DataFrame:
    """A remote dataset's split as it was landed: Parquet at root/<repo, file-safe>/<config>/<split>."""
    place = "".join(c if c.isalnum() or c in "_.-" else "_" for c in repo.replace("/", "__"))
    return spark.read.parquet(f"{root}/{place}/{config}/{split}")


def landed_configs(spark: SparkSession, root: str, repo: str, configs: list[str], split: str = "train") -> DataFrame:
    """Several configs of a dataset one after another, each row with its config."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (landed(spark, root, repo, c, split).withColumn("config", F.lit(c)) for c in configs))
