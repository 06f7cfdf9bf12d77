"""Applying a feed of inserts, updates and removals as a commutative fold.

Every change becomes a few *marks*: one per field that it sets, one if it removes the entry, one that
says that the entry was touched. A mark's place is the struct (instant, seq, writer). The state keeps, per
entry and mark, the maximum of the struct (place, payload). A maximum is associative, commutative and
idempotent, so order of delivery, repetition and the split into batches cannot matter, partial aggregation
shrinks a hot entry on the map side, and the state of one run is simply more input of the next. Removals
stay in the state as marks, so that a change that arrives late still meets the removal that beats it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["registry", "entry_key"]
#: Kinds of marks.
FIELD, TOUCH, REMOVED, SOURCE = "field", "touch", "removed", "source"
# The parts of a source, each kept by itself.
SOURCE_PARTS = {"mailbox": "string", "uid": "bigint", "attachment_index": "int", "sha256": "string", "saved_path": "string"}
#: Parts into which an entry's changes are spread where its last removal is held against them.
SALTS = 16


def instant_ns(text: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 text, null where it can't be read; digits beyond nine are cut."""
    t = F.upper(F.trim(text))
    beyond = F.rpad(F.regexp_extract(t, r"\.[0-9]{6}([0-9]{1,3})", 1), 3, "0")
    return F.unix_micros(t.try_cast("timestamp")) * F.lit(1000) + F.when(F.length(t) > 27, F.coalesce(beyond.try_cast("int"), F.lit(0))).otherwise(F.lit(0))


def marks(changes: DataFrame, source: bool = False) -> DataFrame:
    """The marks of a change feed: (registry, entry_key, mark, field, top struct(at_ns, seq, writer, value)).

    Null or blank keys are ignored. A change without a readable instant is placed before all dated ones; a
    null seq or writer before all others at the same instant. Null and empty values set nothing. A removal
    sets no field, whatever its map holds. With ``source`` every part of a change's source is a mark too; an empty text and the UID 0 are none.
    """
    c = changes
    place = [F.coalesce(instant_ns(c["updated_at"]), instant_ns(c["recorded_at"])).alias("at_ns"), c["seq"].alias("seq"), c["writer"].alias("writer")]
    kind = "struct<mark:string,field:string,value:string>"
    sets = F.transform(F.map_entries(F.map_filter(c["fields"], lambda k, v: v.isNotNull() & (v != ""))), lambda e: F.struct(F.lit(FIELD).alias("mark"), e["key"].alias("field"), e["value"].alias("value")).cast(kind))
    one = lambda mark: F.array(F.struct(F.lit(mark).alias("mark"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")).cast(kind))
    if source:
        text = {p: c["source"][p].cast("string") for p in SOURCE_PARTS}
        parts = F.array(*[F.when(v.isNotNull() & (v != "") & ((F.lit(p) != "uid") | (v != "0")), F.struct(F.lit(SOURCE).alias("mark"), F.lit(p).alias("field"), v.alias("value")).cast(kind)) for p, v in text.items()])
        sets = F.concat(F.coalesce(sets, F.array().cast(f"array<{kind}>")), F.array_compact(parts))
    said = F.when(F.coalesce(c["deleted"], F.lit(False)), one(REMOVED)).otherwise(F.concat(one(TOUCH), F.coalesce(sets, F.array().cast(f"array<{kind}>"))))
    return (
        c.filter(c["entry_key"].isNotNull() & c["entry_key"].rlike(r"[^\s\p{Z}]"))
        .select(c["registry"], c["entry_key"], *place, F.explode(said).alias("m"))
        .select(*KEY, F.col("m.mark").alias("mark"), F.col("m.field").alias("field"), F.struct("at_ns", "seq", "writer", F.col("m.value").alias("value")).alias("top"))
    )


def fold_changes(changes: DataFrame, state: DataFrame | None = None, source: bool = False) -> DataFrame:
    """The state after ``changes``, from the state before if there is one; same columns as :func:`marks`.

    One row per entry and mark, tombstones included. ``fold(a + b) == fold(b, fold(a)) == fold(a, fold(b))``
    for any split into batches. An empty feed gives the former state.
    """
    every = marks(changes, source)
    if state is not None:
        every = every.unionByName(state.select(*every.columns))
    return every.groupBy(*KEY, "mark", "field").agg(F.max("top").alias("top"))


def live_marks(state: DataFrame) -> DataFrame:
    """The marks that no removal beats, without the removals.

    The state holds one row per entry and field, so the window meets what is left of a hot entry only.
    """
    place = F.struct("top.at_ns", "top.seq", "top.writer")
    gone = F.max(F.when(F.col("mark") == REMOVED, place)).over(Window.partitionBy(*KEY))
    return state.withColumn("gone", gone).filter((F.col("mark") != REMOVED) & (F.col("gone").isNull() | (place > F.col("gone")))).drop("gone")


def live_fields(state: DataFrame) -> DataFrame:
    """One row per non-empty field of each current entry: registry, entry_key, field_name, value, at_ns, seq, writer."""
    m = live_marks(state).filter(F.col("mark") == FIELD)
    return m.select(*KEY, F.col("field").alias("field_name"), "top.value", "top.at_ns", "top.seq", "top.writer")


def current_entries(state: DataFrame) -> DataFrame:
    """One row per current entry with its merged fields; an entry that only ever got empty values has an empty map."""
    pair = F.when(F.col("mark") == FIELD, F.struct(F.col("field").alias("key"), F.col("top.value").alias("value")))
    return (
        live_marks(state)
        .groupBy(*KEY)
        .agg(F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("fields"), F.max("top.at_ns").alias("changed_ns"))
        .select(*KEY, "fields", "changed_ns")
    )


def first_recorded(changes: DataFrame, state: DataFrame) -> DataFrame:
    """(registry, entry_key, recorded_at): when each current entry was first recorded, after its last removal if it had one.

    The removal is held against all changes of its entry, which are spread for it: a hot entry meets in no one task.
    """
    c = changes.filter(changes["entry_key"].rlike(r"[^\s\p{Z}]") & ~F.coalesce("deleted", F.lit(False)))
    place = F.struct(F.coalesce(instant_ns(F.col("updated_at")), instant_ns(F.col("recorded_at"))).alias("at_ns"), "seq", "writer")
    salt = F.pmod(F.xxhash64("seq", "writer"), F.lit(SALTS)).cast("int")
    rows = c.select(*KEY, place.alias("place"), "recorded_at", salt.alias("salt"))
    gone = state.filter(F.col("mark") == REMOVED).select(*[F.col(k).alias(f"_{k}") for k in KEY], F.struct("top.at_ns", "top.seq", "top.writer").alias("gone"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    on = [rows[k].eqNullSafe(gone[f"_{k}"]) for k in KEY] + [rows["salt"] == gone["_salt"]]
    after = rows.join(gone, on, "left").filter(F.col("gone").isNull() | (F.col("place") > F.col("gone")))
    return after.groupBy(*KEY).agg(F.min_by("recorded_at", F.when(F.col("recorded_at").isNotNull(), F.col("place"))).alias("recorded_at"))


def merged_entries(changes: DataFrame) -> DataFrame:
    """Current entries with merged fields, the source with each part by its last change, and when the entry was first recorded."""
    state = fold_changes(changes, source=True)
    m = live_marks(state)
    pair = F.when(F.col("mark") == FIELD, F.struct(F.col("field").alias("key"), F.col("top.value").alias("value")))
    part = lambda p, t: F.max(F.when((F.col("mark") == SOURCE) & (F.col("field") == p), F.col("top.value"))).cast(t).alias(p)
    every = m.groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("fields"), *[part(p, t) for p, t in SOURCE_PARTS.items()])
    first = first_recorded(changes, state).select(*[F.col(k).alias(f"_{k}") for k in KEY], "recorded_at")
    on = [every[k].eqNullSafe(first[f"_{k}"]) for k in KEY]
    return every.join(first, on, "left").select(*KEY, "fields", F.struct(*SOURCE_PARTS).alias("source"), "recorded_at")
