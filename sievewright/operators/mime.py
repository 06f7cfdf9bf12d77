"""Messages as bytes into headers, one text body and a flat list of attachments, nested messages included."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from email import policy
from email.message import EmailMessage
from email.parser import BytesParser
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How deep messages within messages are opened.
DEPTH = 3
SCHEMA = (
    "subject string, message_from string, message_to string, sent_at timestamp, text string, html string, "
    "attachments array<struct<att_index:int,filename:string,content_type:string,size_bytes:bigint,sha256:string,via:string,data:binary>>"
)


def _is_attachment(part: EmailMessage) -> bool:
    """Attached by its disposition, by a file name, or as anything but text shown in place."""
    how = part.get_content_disposition()
    return how == "attachment" or bool(part.get_filename()) or (part.get_content_maintype() != "text" and how != "inline")


def _nested(part: EmailMessage) -> bool:
    return part.get_content_type() in ("message/rfc822", "message/global") or (part.get_filename() or "").lower().endswith(".eml")


def _content(part: EmailMessage) -> bytes | None:
    """The decoded bytes; null if they can't be decoded."""
    try:
        if part.get_content_maintype() == "message":
            return part.get_payload(0).as_bytes()
        return part.get_payload(decode=True)
    except Exception:  # whatever a broken part raises, it keeps its place
        return None


def _collect(message: EmailMessage, via: str, depth: int, out: list[dict]) -> None:
    for part in message.iter_parts() if message.is_multipart() and message.get_content_maintype() == "multipart" else [message]:
        if part.get_content_maintype() == "multipart":
            _collect(part, via, depth, out)
            continue
        if not _is_attachment(part):
            continue
        data, name = _content(part), part.get_filename()
        out.append({"att_index": len(out), "filename": name, "content_type": part.get_content_type(), "size_bytes": None if data is None else len(data), "sha256": None if data is None else hashlib.sha256(data).hexdigest(), "via": via, "data": data})
        if data is not None and _nested(part) and depth < DEPTH:
            inner = BytesParser(policy=policy.default).parsebytes(data)
            _collect(inner, f"{via} > {name or 'message'}" if via else name or "message", depth + 1, out)


def _body(message: EmailMessage, kind: str) -> str | None:
    """The first part of a text kind that isn't empty and isn't attached."""
    for part in message.walk():
        if part.get_content_type() == kind and part.get_content_disposition() != "attachment" and not part.get_filename():
            raw = part.get_payload(decode=True) or b""
            try:
                text = raw.decode(part.get_content_charset() or "utf-8", "replace")
            except LookupError:
                text = raw.decode("utf-8", "replace")
            if text.strip():
                return text
        if part.get_content_maintype() == "message":
            break
    return None


def parse_message(raw: bytes) -> dict:
    """Everything of one message; broken headers become null."""
    m = BytesParser(policy=policy.default).parsebytes(raw)

    def header(name: str) -> str | None:
        try:
            v = m[name]
            return None if v is None else str(v)
        except Exception:
            return None

    try:
        sent = parsedate_to_datetime(header("Date") or "")
        sent = sent.astimezone() if sent.tzinfo is None else sent
    except (TypeError, ValueError):
        sent = None
    attachments: list[dict] = []
    _collect(m, "", 0, attachments)
    return {"subject": header("Subject"), "message_from": header("From"), "message_to": header("To"), "sent_at": sent, "text": _body(m, "text/plain"), "html": _body(m, "text/html"), "attachments": attachments}


def parsed(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """``messages`` without ``raw`` but with the parsed columns and ``text_body``: plain text, else the text of the HTML.

    Attachments are in depth-first order, an opened message before what it holds; a part that can't be decoded keeps its index with null size and hash.
    """
    from sievewright.functions.text import html_to_text

    kept = [c for c in messages.columns if c != raw]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.select(*kept).schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [parse_message(bytes(b or b"")) for b in pdf[raw]]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            out = pdf[kept].reset_index(drop=True)
            for n in names:
                out[n] = [r[n] for r in rows]
            out["sent_at"] = pd.to_datetime(out["sent_at"], utc=True).dt.tz_localize(None)
            yield out

    df = messages.mapInPandas(run, f"{fields}, {SCHEMA}")
    return df.withColumn("text_body", F.coalesce("text", html_to_text(F.col("html")))).drop("text", "html")


def attachments(messages: DataFrame, key: list[str]) -> DataFrame:
    """One row per attachment of parsed messages with the message's key."""
    return messages.select(*key, F.explode("attachments").alias("a")).select(*key, "a.*")
