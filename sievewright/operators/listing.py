"""Listing a mailbox: predicates, the newest messages, and the exact cut after the limit."""

from __future__ import annotations

from datetime import datetime, time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Messages listed unless asked otherwise, and at most; the same for registry entries.
LIST, LIST_MOST, ENTRIES, ENTRIES_MOST = 20, 100, 50, 500


def clamp(n: int | None, default: int, most: int) -> int:
    """An argument within 1 and ``most``."""
    return min(max(1, default if n is None else int(n)), most)


def selected(messages: DataFrame, unseen_only: bool = False, since_uid: int | None = None, since: datetime | None = None) -> DataFrame:
    """Messages that a search finds: unseen, with a UID above ``since_uid``, received on the day of ``since`` or later.

    Null flags count as unseen. A null internal date is not found by a search for a day.
    """
    out = messages
    if unseen_only:
        out = out.filter(~F.coalesce(F.array_contains("flags", "\\Seen"), F.lit(False)))
    if since_uid is not None:
        out = out.filter(F.col("uid") > since_uid)
    if since is not None:
        # from the first moment of the day: unlike a function of the column, that reaches the scan
        out = out.filter(F.col("internal_date") >= F.lit(datetime.combine(since.date(), time.min)).cast("timestamp_ntz"))
    return out


def newest(messages: DataFrame, limit: int, since: datetime | None = None, by: str | None = None) -> DataFrame:
    """The ``limit`` messages with the highest UIDs, of the whole or of each ``by``, and only then those after the exact moment.

    The cut comes after the limit, so fewer than ``limit`` may remain although more were found.
    """
    if by is None:
        top = messages.orderBy(F.desc("uid")).limit(limit)
    else:
        rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("uid")))
        top = messages.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")
    return top if since is None else top.filter(after(F.col("internal_date"), since))


def after(moment: Column, since: datetime) -> Column:
    """If a moment is after ``since``; a null one passes."""
    return moment.isNull() | (moment > F.lit(since.replace(tzinfo=None)).cast("timestamp_ntz"))


def counts(messages: DataFrame, found: DataFrame, listed: DataFrame, by: str = "mailbox") -> DataFrame:
    """Per mailbox: messages in it, messages found, messages listed."""
    n = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    out = n(messages, "total_messages").join(n(found, "matched"), by, "left").join(n(listed, "n_listed"), by, "left")
    return out.select(by, "total_messages", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("n_listed", F.lit(0)).alias("n_listed"))


def attachment_refs(parts: Column) -> Column:
    """Of array<struct<filename, content_type, disposition, size_bytes_encoded>>, the parts that are attachments, without content."""
    kept = F.filter(parts, lambda p: (F.coalesce(p["filename"], F.lit("")) != "") | F.lower(p["disposition"]).eqNullSafe(F.lit("attachment")))
    return F.transform(kept, lambda p: F.struct(p["filename"].alias("filename"), F.lower(p["content_type"]).alias("content_type"), p["size_bytes_encoded"].alias("size_bytes_encoded")))
