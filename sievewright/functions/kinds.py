"""Predicates on MIME types, file names and dates."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# First bytes, in hexadecimal, and the type they show; the first that fits wins.
MAGIC = (("255044462d", "application/pdf"), ("89504e470d0a1a0a", "image/png"), ("ffd8ff", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("504b0304", "application/zip"), ("1f8b08", "application/x-gzip"), ("3c3f786d6c", "text/xml; charset=utf-8"))


def is_nested_message(content_type: Column, filename: Column) -> Column:
    """If an attachment is itself a message."""
    return F.coalesce(F.lower(content_type).isin("message/rfc822", "message/global"), F.lit(False)) | F.coalesce(F.lower(filename).endswith(".eml"), F.lit(False))


def is_text(content_type: Column) -> Column:
    """If a type is text or a text-based format."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    return t.startswith("text/") | t.isin("application/xml", "application/json") | t.endswith("+xml") | t.endswith("+json")


def sniffed_type(declared: Column, data: Column) -> Column:
    """The declared type, or what the first bytes show where none or only octet-stream was declared."""
    head = F.lower(F.hex(F.substring(data, 1, 16)))
    guess = F.lit("application/octet-stream")
    for magic, name in reversed(MAGIC):
        guess = F.when(head.startswith(magic), F.lit(name)).otherwise(guess)
    return F.when(F.coalesce(declared, F.lit("")).isin("", "application/octet-stream"), guess).otherwise(declared)


def invoice_candidate(content_type: Column, filename: Column, data: Column) -> Column:
    """``xml``, ``pdf`` or null: what an attachment is probed as; XML wins."""
    t, n = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(filename, F.lit("")))
    xml = n.endswith(".xml") | t.isin("application/xml", "text/xml") | t.endswith("+xml")
    pdf = n.endswith(".pdf") | (t == "application/pdf") | F.lower(F.hex(F.substring(data, 1, 5))).eqNullSafe(F.lit("255044462d"))
    return F.when(xml, F.lit("xml")).when(pdf, F.lit("pdf"))


def valid_registry_name(name: Column) -> Column:
    """Lower-case letters, digits, dash and underscore, at most 40, not beginning with a sign."""
    return F.coalesce(name.rlike(r"\A[a-z0-9][a-z0-9_-]{0,39}\z"), F.lit(False))


def parse_since(text: str) -> datetime:
    """A moment in UTC from RFC 3339, ``YYYY-MM-DD HH:MM:SS`` or ``YYYY-MM-DD``; raises on anything else."""
    for kind in ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            t = datetime.strptime(text, kind)
        except ValueError:
            continue
        return t.astimezone(UTC) if t.tzinfo else t.replace(tzinfo=UTC)
    raise ValueError(f"not a date: {text!r}")


def since_moment(text: Column) -> Column:
    """:func:`parse_since` as a column; null where the text is no date."""
    rfc = F.when(text.rlike(r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z"), text.try_cast("timestamp"))
    plain = F.when(text.rlike(r"\A\d{4}-\d\d-\d\d( \d\d:\d\d:\d\d)?\z"), text.try_cast("timestamp"))
    return F.coalesce(rfc, plain)


def cii_date(text: Column) -> Column:
    """Eight bytes become a date with dashes, whatever they are; everything else stays, trimmed."""
    t = F.trim(text)
    return F.when(F.octet_length(t) == 8, F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 100))).otherwise(t)


def rfc3339(moment: Column) -> Column:
    """UTC to the second."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def nonempty(value: Column) -> Column:
    """If a text value counts as set: not null and not only white space."""
    return F.coalesce(value.rlike(r"[^\s\u0085\p{Z}]"), F.lit(False))
