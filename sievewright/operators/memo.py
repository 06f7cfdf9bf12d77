"""Remembering expensive verdicts by a hash of the text, and files by a hash of their content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def memo_key(text: Column, fingerprint: str) -> Column:
    """The key of a text under a configuration: SHA-256 of fingerprint, NUL, text."""
    return F.sha2(F.concat(F.lit(fingerprint), F.lit("\x00"), text), 256)


def fingerprint(version: str, languages: str, *settings: object) -> str:
    """What verdicts depend on besides the text, joined by pipes."""
    return "|".join([version, languages, *map(str, settings)])


def remembered(cache: DataFrame, order: str | None = None) -> DataFrame:
    """One verdict per key; the latest if ``order`` is given. Rows without a key are left out."""
    good = cache.filter("key IS NOT NULL AND key <> ''")
    if order is None:
        return good.dropDuplicates(["key"])
    return good.groupBy("key").agg(F.max_by(F.struct("flagged", "reasons"), F.col(order)).alias("_v")).select("key", "_v.*")


def screened(texts: DataFrame, text: str, cache: DataFrame, screen: Callable[[Column], Column], mark: str) -> tuple[DataFrame, DataFrame]:
    """(every row of ``texts`` with key, flagged and reasons, the verdicts that were not in the cache).

    Each distinct text is screened once, and only if the cache lacks it. Null texts get no verdict.
    """
    keyed = texts.withColumn("key", memo_key(F.col(text), mark))
    known = remembered(cache).select("key", "flagged", "reasons")
    missing = keyed.filter(F.col(text).isNotNull()).select("key", F.col(text).alias("_t")).dropDuplicates(["key"]).join(known, "key", "left_anti")
    new = missing.select("key", screen(F.col("_t")).alias("reasons")).select("key", (F.size("reasons") > 0).alias("flagged"), "reasons")
    return keyed.join(known.unionByName(new), "key", "left"), new


def first_of_content(files: DataFrame, sha: str = "sha256", order: str = "seq") -> DataFrame:
    """The first row per content hash. Rows without a hash are all kept out."""
    row = F.struct(*[F.col(c) for c in files.columns])
    return files.filter(F.col(sha).isNotNull()).groupBy(F.col(sha).alias("_s")).agg(F.min_by(row, F.col(order)).alias("_r")).select("_r.*")


def not_yet_saved(files: DataFrame, ledger: DataFrame, sha: str = "sha256") -> DataFrame:
    """Files whose content the ledger of saved files does not have."""
    return files.join(ledger.select(F.col(sha).alias("_saved")).filter("_saved IS NOT NULL").distinct(), F.col(sha) == F.col("_saved"), "left_anti")


def unique_names(files: DataFrame, taken: DataFrame, name: str = "name", order: str = "seq") -> DataFrame:
    """``files`` with ``unique_name``: the name, or the name with -1, -2 … before its extension.

    Names that are taken, or would be taken by a file before it, are not given; numbers start after
    the highest one in use for that name, so that no search per file is needed.
    """
    from pyspark.sql import Window

    from sievewright.functions.text import insert_before_extension

    stem = F.regexp_replace(F.col("taken_name"), r"(?s)-[0-9]{1,9}(\.[^.]*)?$", "$1")
    number = F.coalesce(F.regexp_extract("taken_name", r"(?s)-([0-9]{1,9})(\.[^.]*)?$", 1).try_cast("bigint"), F.lit(0))
    names = taken.select(F.col(name).alias("taken_name")).filter("taken_name IS NOT NULL").distinct()
    # a taken name stands for itself, and as a numbered form of its stem
    used = names.select(F.col("taken_name").alias("_base"), F.lit(0).cast("bigint").alias("_n")).unionByName(names.select(stem.alias("_base"), number.alias("_n")))
    top = used.groupBy("_base").agg(F.max("_n").alias("_top"))
    rank = F.row_number().over(Window.partitionBy(name).orderBy(order)).cast("bigint")
    joined = files.withColumn("_rank", rank).join(top, F.col(name) == F.col("_base"), "left")
    nth = F.when(F.col("_top").isNull(), F.col("_rank") - 1).otherwise(F.col("_top") + F.col("_rank"))
    return joined.withColumn("unique_name", F.when(nth == 0, F.col(name)).otherwise(insert_before_extension(F.col(name), F.concat(F.lit("-"), nth.cast("string"))))).drop("_rank", "_base", "_top")
