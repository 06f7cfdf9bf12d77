"""Journals, ledgers, caches and cursors as JSON files, each with its own way with broken content."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "struct<mailbox:string,uid:bigint,attachment_index:int,sha256:string,saved_path:string>"
ENTRY = f"seq bigint, registry string, entry_key string, recorded_at string, updated_at string, deleted boolean, fields map<string,string>, source {SOURCE}"
META = "registry string, description string, field_columns array<string>, field_docs map<string,string>"
VERDICT = "key string, flagged boolean, reasons array<string>, at string"
SAVED = (
    "saved_at string, mailbox string, uid bigint, attachment_index int, original_filename string, saved_path string, size_bytes bigint, sha256 string, "
    "content_type string, message_subject string, message_from string, message_date string, screening_flagged boolean"
)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def lines(spark: SparkSession, path: str, schema: str, required: str | None = None) -> DataFrame:
    """JSON lines; broken lines, and lines without the required key, are left out. A missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    row = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.try_parse_json("value").alias("j"))
    good = row.filter("j IS NOT NULL AND r IS NOT NULL").select("r.*")
    return good.filter((F.col(required).isNotNull()) & (F.col(required) != "")) if required else good


def append(rows: DataFrame, path: str) -> None:
    """Add rows as JSON lines."""
    rows.write.mode("append").json(path)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """A registry journal."""
    return lines(spark, path, ENTRY, "entry_key")


def meta(spark: SparkSession, path: str) -> DataFrame:
    """Declarations of registries; missing or broken ones count as empty."""
    return lines(spark, path, META, "registry")


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Remembered verdicts."""
    return lines(spark, path, VERDICT, "key")


def saved_files(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of saved attachments."""
    return lines(spark, path, SAVED, "sha256")


def registry_names(of: DataFrame) -> DataFrame:
    """Registries by name, in byte order."""
    return of.select("registry").distinct().orderBy("registry")


def load_cursors(path: str) -> dict[str, dict]:
    """Cursors by mailbox. A missing file has none; a broken one raises, for a lost cursor would mean reading all again unnoticed."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    if not isinstance(got, dict):
        raise ValueError(f"{path} holds no cursors")
    return got


def save_cursors(path: str, cursors: dict[str, dict]) -> None:
    """Replace the file as a whole."""
    temp = f"{path}.new"
    with open(temp, "w", encoding="utf-8") as f:
        json.dump(cursors, f, ensure_ascii=False, sort_keys=True)
    os.replace(temp, path)
