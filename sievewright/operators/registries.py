"""Registries: keyed entries with columns that drift, kept as an append-only journal of whole snapshots or of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of one journal line at most.
LINE_BYTES = 1 << 20


def compact(journal: DataFrame, key: list[str], order: str = "seq", deleted: str = "deleted") -> DataFrame:
    """Last write wins: the last snapshot per key unless it is a removal, with ``first_order``, where the key first appeared.

    A removal never resets the first appearance. Rows with a null or empty key are left out. Aggregated, not windowed: a hot key shrinks on the map side.
    """
    good = journal
    for k in key:
        good = good.filter(F.col(k).isNotNull() & (F.col(k) != ""))
    row = F.struct(*[F.col(c) for c in journal.columns])
    last = good.groupBy(*key).agg(F.max_by(row, F.col(order)).alias("_last"), F.min(order).alias("first_order"))
    return last.select("_last.*", "first_order").filter(~F.coalesce(F.col(deleted), F.lit(False)))


def undeclared(entries: DataFrame, meta: DataFrame) -> DataFrame:
    """(registry, entry_key, undeclared) of entries that have fields which their registry does not declare, sorted."""
    m = meta.select(F.col("registry").alias("_r"), F.col("field_columns").alias("_c"))
    extra = F.array_sort(F.array_except(F.map_keys("fields"), F.coalesce("_c", F.array().cast("array<string>"))))
    return entries.join(F.broadcast(m), entries["registry"] == m["_r"], "left").select(*[c for c in entries.columns], extra.alias("undeclared")).filter(F.size("undeclared") > 0)


def column_order(fields: DataFrame, meta: DataFrame) -> DataFrame:
    """(registry, field_name, position): declared columns in order, then undeclared ones by first use and name.

    ``fields`` has (registry, field_name, first_order) of every field ever set.
    """
    declared = meta.select("registry", F.posexplode("field_columns").alias("pos", "field_name"))
    first = fields.groupBy("registry", "field_name").agg(F.min("first_order").alias("first_order"))
    new = first.join(declared.select(F.col("registry").alias("_r"), F.col("field_name").alias("_f")), (F.col("registry") == F.col("_r")) & (F.col("field_name") == F.col("_f")), "left_anti")
    every = declared.select("registry", "field_name", F.lit(0).alias("late"), F.col("pos").cast("bigint").alias("at")).unionByName(new.select("registry", "field_name", F.lit(1).alias("late"), F.col("first_order").alias("at")))
    return every.select("registry", "field_name", F.row_number().over(Window.partitionBy("registry").orderBy("late", "at", "field_name")).alias("position"))


def info(meta: DataFrame, entries: DataFrame) -> DataFrame:
    """Registries by name with their description, columns, field documentation and number of entries."""
    n = entries.groupBy(F.col("registry").alias("_r")).agg(F.count("*").alias("n"))
    docs = F.transform("field_columns", lambda c: F.concat(c, F.lit("="), F.coalesce(F.col("field_docs")[c], F.lit(""))))
    return meta.join(n, meta["registry"] == n["_r"], "left").select("registry", "description", F.array_join("field_columns", ",").alias("columns"), F.array_join(docs, ";").alias("docs"), F.coalesce("n", F.lit(0)).alias("n_entries")).orderBy("registry")


def newest_entries(entries: DataFrame, limit: int) -> DataFrame:
    """Newest first by ``recorded_at``; entries of one instant in the order of their first appearance."""
    return entries.orderBy(F.desc("recorded_at"), F.asc("first_order")).limit(limit)


def without(journal: DataFrame, registry: str) -> DataFrame:
    """A journal without one registry."""
    return journal.filter(~F.col("registry").eqNullSafe(F.lit(registry)))


def removal(entries: DataFrame, registry: str, key: str) -> DataFrame:
    """The tombstone of an entry: one row if it exists, else none."""
    return entries.filter((F.col("registry") == registry) & (F.col("entry_key") == key)).select("registry", "entry_key", F.lit(True).alias("deleted"))


def line_bytes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``line_bytes``, the size of each as a JSON line."""
    return rows.withColumn("line_bytes", F.octet_length(F.to_json(F.struct(*[F.col(c) for c in rows.columns]))))


def fitting_lines(rows: DataFrame) -> DataFrame:
    """Rows as JSON lines, with those over the size limit left out; :func:`line_bytes` tells which these are."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("value")).filter(F.octet_length("value") <= LINE_BYTES)


def pivot(fields: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """One row per entry with a column per field; ``columns`` are known beforehand, so no pass collects them."""
    return fields.groupBy(*key).pivot("field_name", columns).agg(F.first("value"))
