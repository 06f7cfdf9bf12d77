"""Cursors: how far a mailbox has been worked off. They move only forward within an epoch; a new epoch starts anew."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.sources.journals import load_cursors, save_cursors


def get_cursor(path: str, mailbox: str) -> dict:
    """The cursor of a mailbox, or that there is none."""
    c = load_cursors(path).get(mailbox)
    return {"mailbox": mailbox, "exists": c is not None, **(c or {})}


def set_cursor(path: str, mailbox: str, uid_validity: int, last_uid: int, now: datetime | None = None) -> dict:
    """Move a cursor; raises on a UID or epoch that isn't positive and on a move backwards within one epoch."""
    if uid_validity < 1 or last_uid < 0:
        raise ValueError("uid_validity must be positive and last_uid not negative")
    cursors = load_cursors(path)
    old = cursors.get(mailbox)
    if old and old["uid_validity"] == uid_validity and last_uid < old["last_uid"]:
        raise ValueError(f"the cursor of {mailbox} stands at {old['last_uid']} and does not move back")
    at = (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    cursors[mailbox] = {"uid_validity": uid_validity, "last_uid": last_uid, "updated_at": at}
    save_cursors(path, cursors)
    return {"mailbox": mailbox, **cursors[mailbox]}


def advance(requests: DataFrame, order: str = "seq") -> DataFrame:
    """Requested moves (mailbox, uid_validity, last_uid, order) with ``accepted`` and ``stands_at``, as if made one by one.

    Within a run of requests of one epoch a move is accepted if it isn't below all accepted before it, which
    is the running maximum; a change of the epoch starts a new run.
    """
    w = Window.partitionBy("mailbox").orderBy(order)
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = requests.withColumn("_new", F.when(F.lag("uid_validity").over(w).eqNullSafe(F.col("uid_validity")), 0).otherwise(1)).withColumn("_run", run)
    in_run = Window.partitionBy("mailbox", "_run").orderBy(order)
    before = F.max("last_uid").over(in_run.rowsBetween(Window.unboundedPreceding, -1))
    out = marked.withColumn("accepted", F.coalesce(F.col("last_uid") >= before, F.lit(True))).withColumn("stands_at", F.max("last_uid").over(in_run.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("_new", "_run")


def pending(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Messages beyond their mailbox's cursor; all of those of another epoch or without a cursor."""
    c = cursors.select(F.col("mailbox").alias("_m"), F.col("uid_validity").alias("_v"), F.col("last_uid").alias("_u"))
    j = messages.join(c, messages["mailbox"] == c["_m"], "left")
    new_epoch = F.col("_v").isNull() | (F.col("_v") != F.col("uid_validity"))
    return j.filter(new_epoch | (F.col("uid") > F.col("_u"))).withColumn("rescan", new_epoch & F.col("_v").isNotNull()).drop("_m", "_v", "_u")
