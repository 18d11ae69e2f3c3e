"""JSON, JSON lines and CSV in and out, tolerant of broken input; atomic single files."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAX_METADATA_BYTES, MAX_TEXT_BYTES = 10_000_000, 5_000_000


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of JSON-lines files; lines that are no objects are dropped."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select(F.from_json("value", StructType(kind.fields).add("__bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    return parsed.where("r is not null and r.__bad is null").select("r.*").drop("__bad")


def read_json_lists(spark: SparkSession, path: str, element: str) -> DataFrame:
    """Elements of JSON files that hold an object, a list, or {"results": [...]}; other files give no rows."""
    text = spark.read.text(path, wholetext=True).where(F.octet_length("value") <= MAX_METADATA_BYTES).select(F.trim("value").alias("v"))
    kind = StructType.fromDDL(element)
    as_list = F.from_json("v", f"array<{kind.simpleString()}>")
    wrapped = F.from_json("v", f"results array<{kind.simpleString()}>").getField("results")
    single = F.array(F.from_json("v", kind))
    whole = F.try_parse_json("v")
    rows = F.when(F.startswith("v", F.lit("[")), as_list).when(wrapped.isNotNull(), wrapped).otherwise(single)
    return text.where(whole.isNotNull()).select(F.explode(rows).alias("r")).where("r is not null").select("r.*")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines with sorted keys, written by the executors."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined by commas."""
    flat = [F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c).cast("string").alias(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_document(path: str | Path, value: Any) -> None:
    """One JSON or text file, replaced in one step."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, default=str)
    fd, tmp = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, target)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise


def read_document(path: str | Path, default: Any = None) -> Any:
    """A JSON file's value; missing or broken: the default."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return default


def markdown_table(rows: Iterable[Any], columns: list[str]) -> str:
    """A small collected table as Markdown."""
    cells = lambda values: "| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in values) + " |"
    return "\n".join([cells(columns), cells(["---"] * len(columns)), *(cells([r[c] for c in columns]) for r in rows)])
