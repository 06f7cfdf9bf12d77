"""Keeping registries current from a stream of changes, and saving files once, with writes that can be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sievewright.operators.changes import KEY, fold_changes
from sievewright.operators.files import safe_name, write_files
from sievewright.operators.memo import first_of_content, not_yet_saved, screened
from sievewright.sources.journals import exists


#: Parts of the state by the hash of the key; a batch rewrites those that its keys fall into.
BUCKETS = 64


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda *x: jvm.org.apache.hadoop.fs.Path("/".join((path, *x)))


def _versions(spark: SparkSession, path: str, before: float = float("inf")) -> dict[int, list[int]]:
    """Complete versions of each bucket, ascending."""
    fs, at = _fs(spark, path)
    out: dict[int, list[int]] = {}
    for s in fs.listStatus(at()) if fs.exists(at()) else ():
        name = s.getPath().getName()
        if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) < before and fs.exists(at(name, "_SUCCESS")):
            for part in fs.listStatus(at(name)):
                if (bucket := part.getPath().getName()).startswith("bucket="):
                    out.setdefault(int(bucket[7:]), []).append(int(name[1:]))
    return {b: sorted(v) for b, v in out.items()}


def _read(spark: SparkSession, path: str, last: dict[int, int]) -> DataFrame | None:
    return spark.read.parquet(*[f"{path}/v{v}/bucket={b}" for b, v in sorted(last.items())]) if last else None


def current_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The last complete state under ``path``; None before the first."""
    return _read(spark, path, {b: v[-1] for b, v in _versions(spark, path).items()})


def fold_batch(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: batch n writes version n of the buckets that its keys fall into, from their version before.

    A repeated batch writes the same again. Versions that no repetition can ask for any more are deleted.
    """

    def apply(changes: DataFrame, batch: int) -> None:
        spark = changes.sparkSession
        bucket = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")
        touched = {r[0] for r in changes.select(bucket.alias("b")).distinct().collect()}  # BUCKETS at most
        older = {b: v for b, v in _versions(spark, path, batch).items() if b in touched}
        state = _read(spark, path, {b: v[-1] for b, v in older.items()})
        new = fold_changes(changes, state).withColumn("bucket", bucket)
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{batch}")
        fs, at = _fs(spark, path)
        for b, versions in older.items():
            for v in versions[:-1]:
                fs.delete(at(f"v{v}", f"bucket={b}"), True)

    return apply


def stream_registry(changes: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A query that folds a stream of changes into the state under ``path``; start it with a trigger."""
    return changes.writeStream.foreachBatch(fold_batch(path)).option("checkpointLocation", checkpoint)


def save_batch(ledger: str, folder: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: append files whose content is new, the first of each content, to a ledger.

    With ``folder`` their bytes (``data``) are written there by the executors, under names with the hash of the content.
    """

    def apply(files: DataFrame, batch: int) -> None:
        spark = files.sparkSession
        known = spark.read.parquet(ledger).filter(f"batch <> {batch}") if exists(spark, ledger) else spark.createDataFrame([], "sha256 string")
        new = not_yet_saved(first_of_content(files), known)
        if folder:
            new = write_files(safe_name(new), folder)
        new.selectExpr("*", f"{batch}L AS batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(ledger)

    return apply


def screen_batch(text: str, cache: str, out: str, screen: Callable[[Column], Column], mark: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: append rows with the verdict on their text to ``out``; a text that any batch has met is not screened again."""

    def apply(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        write = lambda df, to: df.selectExpr("*", f"{batch}L AS batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(to)
        none = spark.createDataFrame([], "key string, flagged boolean, reasons array<string>")
        before = spark.read.parquet(cache).filter(f"batch <> {batch}").drop("batch") if exists(spark, cache) else none
        write(screened(rows, text, before, screen, mark)[1], cache)
        write(screened(rows, text, spark.read.parquet(cache).drop("batch"), screen, mark)[0], out)

    return apply
