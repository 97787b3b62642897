"""Sinks: JSON lines, budgets, token files, reports, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def write_jsonl(rows: DataFrame, path: str, least: int = 32, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """JSON lines of rows whose text has `least` characters or more, by partition columns if given."""
    out = rows.where(F.char_length(T.strip_u(F.col("text"))) >= least).write.mode(mode)
    (out.partitionBy(*by) if by else out).json(path)


def within_budget(rows: DataFrame, budget: int, group: str = "source", order: str = "ord") -> DataFrame:
    """Rows of each group whose JSON lines before them are below the byte budget; the crossing row is in."""
    from tessera.operators.mixing import byte_budget

    sized = rows.withColumn("__size", F.octet_length(F.to_json(F.struct(*rows.columns))) + 1)
    return byte_budget(sized, "__size", [group], [order], budget).drop("__size")


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def rolling_slot(sequence: int, keep: int) -> str:
    """The slot that a rolling checkpoint overwrites."""
    return f"slot_{sequence % keep:02d}"


def csv_report(rows: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV file with a fixed header; columns that rows lack are empty."""
    rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report(totals: DataFrame, details: DataFrame, title: str, most: int = 20) -> tuple[str, str]:
    """JSON and Markdown of a one-row total and its first details."""
    total = totals.first().asDict()
    rows = [r.asDict() for r in details.limit(most).collect()]
    lines = [f"# {title}", "", *(f"- {k}: {v}" for k, v in total.items())]
    if rows:
        lines += ["", "| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join(str(v) for v in r.values()) + " |" for r in rows)]
    return json.dumps({"summary": total, "details": rows}, ensure_ascii=False, indent=2, default=str), "\n".join(lines) + "\n"


def yaml_manifest(entries: list[dict]) -> str:
    """A list of flat mappings as YAML; strings are JSON-quoted, which YAML reads as they are."""
    out = []
    for e in entries:
        for i, (k, v) in enumerate(e.items()):
            out.append(f"{'- ' if not i else '  '}{k}: {json.dumps(v, ensure_ascii=False)}")
    return "\n".join(out) + "\n"


def file_digests(spark, path: str) -> DataFrame:
    """name, length, sha256 of each file's bytes, for a bill of materials."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256")).orderBy("name")


def spdx(digests: DataFrame, name: str) -> dict:
    """An SPDX document of the files' digests."""
    files = [{"fileName": r["name"], "SPDXID": f"SPDXRef-File-{i}", "checksums": [{"algorithm": "SHA256", "checksumValue": r["sha256"]}]} for i, r in enumerate(digests.collect())]
    return {"spdxVersion": "SPDX-2.3", "name": name, "SPDXID": "SPDXRef-DOCUMENT", "dataLicense": "CC0-1.0", "files": files}
