"""The whole surface in one object: listing, reading, saving, invoices, registries and cursors over one folder.

Each method is a thin composition of the operators; whatever scans is a Spark job, whatever is a single
small answer is returned as plain Python.
"""

from __future__ import annotations

import base64
import hashlib
import os
import threading
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import kinds, screening, text
from sievewright.operators import invoices, listing, memo, mime, registries, workbook
from sievewright.sources import journals, mailbox
from sievewright.sources.config import Config
from sievewright.streaming import cursors


WITHHELD = "the invoice was flagged as a possible prompt injection and is withheld; ask for the quarantined view of its attachment"
_INVISIBLE = {ord(ch): None for ch in text.INVISIBLE}


class Workspace:
    """Mail under ``config.mailbox_root``; journals, ledger, workbook and cursors under ``config.root``."""

    def __init__(self, spark: SparkSession, config: Config, *more: screening.Screener, detector: Callable[[Column], Column] | None = None) -> None:
        self.spark, self.config = spark, config
        os.makedirs(config.root, exist_ok=True)
        mailbox.register(spark)
        gates = {"heuristic": screening.heuristic}
        if not {"any", "*"} & set(config.languages):
            gates["script"] = screening.script_gate(config.languages)
            if detector:
                gates["language"] = lambda t: screening.language_gate(config.languages, detector(t))(t)
        self.screen = screening.chain(*[gates[s] for s in (*config.screeners, "language") if s in gates], *more)
        self.mark = memo.fingerprint("1", ",".join(config.languages), *config.screeners, *[getattr(m, "__qualname__", repr(m)) for m in more], getattr(detector, "__qualname__", ""))
        self._lock, self._verdicts = threading.Lock(), threading.Lock()

    def _path(self, name: str) -> str:
        return os.path.join(self.config.root, name)

    # Mail ---------------------------------------------------------------------------------------------------

    def messages(self, box: str, raw: bool = True) -> DataFrame:
        return self.spark.read.format("mailbox").option("raw", str(raw).lower()).load(self.config.mailbox_root).filter(F.col("mailbox") == box)

    def _reasons(self, texts: list[str | None]) -> list[list[str]]:
        """The reasons against each text, remembered ones first; each other text is screened once, and its verdict remembered."""
        key = {t: hashlib.sha256(f"{self.mark}\x00{t}".encode("utf-8", "surrogatepass")).hexdigest() for t in texts if t}
        at = self._path(self.config.verdicts) if self.config.verdicts else ""
        known = {"": []}
        if at and key:
            cache = memo.remembered(journals.verdicts(self.spark, at), "at").filter(F.col("key").isin(list(set(key.values()))))
            known |= {r["key"]: list(r["reasons"] or []) for r in cache.collect()}
        new = sorted({t for t in key if key[t] not in known})
        if new:
            found = self.spark.createDataFrame([(t,) for t in new], "t string").select("t", F.coalesce(self.screen(F.col("t")), screening.none_found()).alias("r")).collect()
            known |= {key[r["t"]]: list(r["r"]) for r in found}
            if at:
                with self._verdicts:
                    journals.append(self.spark.createDataFrame([(key[r["t"]], bool(r["r"]), list(r["r"]), _now()) for r in found], journals.VERDICT), at)
        return [known[key.get(t, "") if t else ""] for t in texts]

    def _guarded(self, texts: list[str | None], include: bool) -> tuple[list[str | None], list[str]]:
        """(each text as it is shown, the reasons against all of them in order)."""
        reasons = self._reasons(texts)
        shown = [t if t is None else screening.NOTICE % ", ".join(r) if r and not include else t.translate(_INVISIBLE) for t, r in zip(texts, reasons)]
        return shown, [x for r in reasons for x in r]

    def _page(self, body: str | None, offset: int, limit: int) -> dict:
        return self.spark.createDataFrame([(body or "",)], "t string").select(text.page(F.col("t"), offset, limit).alias("p")).first()["p"].asDict()

    def list_messages(self, box: str = "INBOX", limit: int | None = None, unseen_only: bool = False, since_uid: int | None = None, since_date: str | None = None, include_flagged: bool = False) -> dict:
        """The newest messages that are found, with flagged strings redacted, file names too.

        Found and counted without opening a message; only those listed are read.
        """
        since = kinds.parse_since(since_date) if since_date else None
        every = self.messages(box, raw=False).drop("raw")
        found = listing.selected(every, unseen_only, since_uid, since)
        n = listing.clamp(limit, listing.LIST, listing.LIST_MOST)
        top = listing.newest(found, n, since).select("uid", "uid_validity").collect()  # at most LIST_MOST
        out = []
        if top:
            raw = self.messages(box).filter(F.col("uid").isin([r["uid"] for r in top]) & F.col("uid_validity").isin(list({r["uid_validity"] for r in top})))
            names = F.transform("attachments", lambda a: a["filename"]).alias("attachments")
            rows = mime.parsed(raw).select("uid", "uid_validity", "internal_date", "flags", "size_bytes", "message_from", "subject", names).collect()
            wanted = {(r["uid"], r["uid_validity"]) for r in top}
            out = sorted((r.asDict(True) for r in rows if (r["uid"], r["uid_validity"]) in wanted), key=lambda m: -m["uid"])
        self._reasons([t for m in out for t in (m["subject"], m["message_from"], *m["attachments"])])  # all at once
        for m in out:
            (m["subject"], m["message_from"], *m["attachments"]), m["reasons"] = self._guarded([m["subject"], m["message_from"], *m["attachments"]], include_flagged)
        epoch = every.agg(F.max("uid_validity")).first()[0]
        return {"mailbox": box, "uid_validity": epoch, "total_messages": every.count(), "matched": found.count(), "count": len(out), "messages": out}

    def _one(self, box: str, uid: int) -> DataFrame:
        if uid < 1:
            raise ValueError("uid must be positive")
        got = self.messages(box).filter(F.col("uid") == uid).orderBy(F.desc("uid_validity")).limit(1)
        if got.isEmpty():
            raise LookupError(f"no message {uid} in {box}")
        return mime.parsed(got)

    def read_message(self, uid: int, box: str = "INBOX", offset: int = 0, limit: int = 0, include_flagged: bool = False) -> dict:
        """One message with its body page by page; each string is redacted by itself, file names and their origin too, the verdict is for all of them."""
        names = ("att_index", "filename", "content_type", "size_bytes", "sha256", "via")
        files = F.transform("attachments", lambda a: F.struct(*[a[n].alias(n) for n in names])).alias("attachments")
        m = self._one(box, uid).select("subject", "message_from", "message_to", "sent_at", "text_body", files).first().asDict(True)
        texts = [m["subject"], m["message_from"], m["text_body"], *[f[k] for f in m["attachments"] for k in ("filename", "via")], m["message_to"]]
        (subject, sender, body, *parts, to), reasons = self._guarded(texts, include_flagged)
        files = [f | {"filename": parts[2 * i], "via": parts[2 * i + 1]} for i, f in enumerate(m["attachments"])]
        return {"subject": subject, "message_from": sender, "message_to": to, "sent_at": m["sent_at"], "body": self._page(body, offset, limit), "reasons": reasons, "attachments": files, "uid": uid, "mailbox": box, "flagged": bool(reasons)}

    def _attachment(self, uid: int, index: int, box: str) -> dict:
        if index < 0:
            raise ValueError("attachment_index must not be negative")
        rows = mime.attachments(self._one(box, uid), ["uid", "subject", "message_from", "sent_at"]).filter(F.col("att_index") == index)
        got = rows.withColumn("kind", kinds.sniffed_type(F.col("content_type"), F.col("data"))).withColumn("nested", kinds.is_nested_message(F.col("content_type"), F.col("filename"))).withColumn("textual", kinds.is_text(F.col("kind"))).first()
        if got is None:
            raise LookupError(f"message {uid} has no attachment {index}")
        return got.asDict(True)

    def read_attachment(self, uid: int, index: int, box: str = "INBOX", offset: int = 0, limit: int = 0, include_flagged: bool = False) -> dict:
        """Text page by page, a nested message as text, other files as base64 with an address; too large ones raise."""
        a = self._attachment(uid, index, box)
        data = bytes(a["data"] or b"")
        if len(data) > self.config.inline_bytes:
            raise ValueError(f"the attachment has {len(data)} bytes; at most {self.config.inline_bytes} are read inline")
        readable = a["nested"] or a["textual"]
        body = None if not readable else mime.parse_message(data)["text"] or "" if a["nested"] else data.decode("utf-8", "replace")
        (name, via, body), reasons = self._guarded([a["filename"], a["via"], body], include_flagged)
        head = {"uid": uid, "attachment_index": index, "filename": name, "via": via, "content_type": a["kind"], "sha256": a["sha256"], "reasons": reasons, "flagged": bool(reasons)}
        if not readable:
            return head | {"uri": f"mail://{box}/{uid}/attachments/{index}", "base64": base64.b64encode(data).decode()}
        return head | {"body": self._page(body, offset, limit)}

    def read_quarantined(self, uid: int, box: str = "INBOX", index: int | None = None, offset: int = 0, limit: int = 0) -> dict:
        """Flagged content as data: screened for the report, defused, page by page."""
        body = self._one(box, uid).first()["text_body"] if index is None else bytes(self._attachment(uid, index, box)["data"] or b"").decode("utf-8", "replace")
        one = self.spark.createDataFrame([(body or "",)], "t string")
        return one.select(text.page(text.defuse(F.col("t")), offset, limit).alias("body"), self.screen(F.col("t")).alias("reasons")).first().asDict(True)

    def save_attachment(self, uid: int, index: int, box: str = "INBOX", name: str | None = None) -> dict:
        """Save a file once per content, under a safe and free name; the ledger tells where."""
        with self._lock:
            a = self._attachment(uid, index, box)
            if a["data"] is None:
                raise ValueError("the attachment can't be decoded")
            path = self._path("saved.jsonl")
            known = journals.saved_files(self.spark, path).filter(F.col("sha256") == a["sha256"]).orderBy("saved_at").limit(1).collect()
            if known and os.path.exists(known[0]["saved_path"]):
                return known[0].asDict() | {"duplicate": True}
            folder = self._path("attachments")
            os.makedirs(folder, exist_ok=True)
            one = self.spark.createDataFrame([(name or a["filename"] or "", 0)], "name string, seq int")
            safe = one.select(text.hash_suffix(text.sanitize_filename(F.col("name"), f"attachment-{index}"), F.lit(a["sha256"])).alias("name"), "seq")
            taken = self.spark.createDataFrame([(f,) for f in os.listdir(folder)], "name string")
            free = memo.unique_names(safe, taken).first()["unique_name"]
            at = os.path.join(folder, free)
            with open(os.open(at, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
                f.write(bytes(a["data"]))
            flagged = bool(self._reasons([a["filename"]])[0])
            row = (_now(), box, uid, index, a["filename"], at, len(a["data"]), a["sha256"], a["content_type"], a["subject"], a["message_from"], str(a["sent_at"] or ""), flagged)
            saved = self.spark.createDataFrame([row], journals.SAVED)
            journals.append(saved, path)
            return saved.first().asDict() | {"duplicate": False}

    def get_attached_invoice(self, uid: int, box: str = "INBOX", include_flagged: bool = False, index: int | None = None) -> list[dict]:
        """Every invoice attached to a message, or to one attachment; one whose prose is flagged is withheld with its file name and a note.

        Raises if there is none, with the attachments that were tried, whose names are guarded as well.
        """
        files = mime.attachments(self._one(box, uid), ["uid"])
        files = files if index is None else files.filter(F.col("att_index") == index)
        found = invoices.of_attachments(files).withColumn("reasons", self.screen(invoices.screen_text(F.col("invoice"), F.col("filename"), F.col("via"))))
        bad = (F.size("reasons") > 0) & F.lit(not include_flagged)
        shown = lambda c: F.when(~bad, F.col(c))
        rows = found.select("att_index", text.strip_invisible(shown("filename")).alias("filename"), text.strip_invisible(shown("via")).alias("via"), "sha256", shown("embedded_xml").alias("embedded_xml"), shown("invoice").alias("invoice"), "reasons", F.when(bad, F.lit(WITHHELD)).alias("note")).orderBy("att_index").collect()
        if not rows:
            kind = kinds.invoice_candidate(F.col("content_type"), F.col("filename"), F.col("data"))
            tried = files.filter(kind.isNotNull()).select("att_index", "filename").orderBy("att_index").collect()
            (log,), _ = self._guarded(["; ".join(f"{r['att_index']}: {r['filename']}" for r in tried)], False)
            raise LookupError(f"no invoice that can be read in message {uid}" + (f"; tried {log}" if tried else ""))
        return [r.asDict(True) for r in rows]

    # Registries ---------------------------------------------------------------------------------------------

    def _journal(self) -> DataFrame:
        return journals.entries(self.spark, self._path("entries.jsonl"))

    def _meta(self) -> DataFrame:
        m = journals.lines(self.spark, self._path("registries.jsonl"), f"seq bigint, dropped boolean, {journals.META}", "registry")
        last = m.groupBy("registry").agg(F.max_by(F.struct(*[F.col(c) for c in m.columns]), "seq").alias("r")).select("r.*")
        return last.filter("NOT coalesce(dropped, false)").drop("dropped")

    def _live(self) -> DataFrame:
        since = self._meta().select(F.col("registry").alias("_r"), F.col("seq").alias("_s"))
        born = journals.lines(self.spark, self._path("registries.jsonl"), f"seq bigint, dropped boolean, {journals.META}", "registry").filter("dropped").groupBy(F.col("registry").alias("_d")).agg(F.max("seq").alias("_gone"))
        j = self._journal().join(since, F.col("registry") == F.col("_r"), "left_semi").join(born, F.col("registry") == F.col("_d"), "left").filter("_gone IS NULL OR seq > _gone").drop("_d", "_gone")
        return registries.compact(j, ["registry", "entry_key"])

    def _next(self) -> int:
        a = self._journal().agg(F.max("seq")).first()[0] or 0
        b = journals.lines(self.spark, self._path("registries.jsonl"), "seq bigint, registry string", "registry").agg(F.max("seq")).first()[0] or 0
        return max(a, b) + 1

    def _declare(self, row: tuple) -> None:
        journals.append(self.spark.createDataFrame([row], f"seq bigint, dropped boolean, {journals.META}"), self._path("registries.jsonl"))

    def add_registry(self, name: str, description: str = "", fields: list[dict] | None = None) -> dict:
        """Create a registry, or add fields to it; items of ``fields`` that are no name with a description are skipped."""
        if not self.spark.range(1).select(kinds.valid_registry_name(F.lit(name)).alias("ok")).first()["ok"]:
            raise ValueError(f"bad registry name {name!r}")
        with self._lock:
            old = self._meta().filter(F.col("registry") == name).collect()
            columns, docs = (list(old[0]["field_columns"] or []), dict(old[0]["field_docs"] or {})) if old else ([], {})
            for f in fields or []:
                if isinstance(f, dict) and isinstance(f.get("name"), str) and f["name"].strip():
                    if f["name"] not in columns:
                        columns.append(f["name"])
                    docs[f["name"]] = str(f.get("description") or docs.get(f["name"], ""))
            self._declare((self._next(), False, name, description or (old[0]["description"] if old else ""), columns, docs))
            self._write_workbook()
        return {"registry": name, "created": not old, "columns": columns}

    def registries(self) -> list[dict]:
        """All registries by name with their columns and number of entries."""
        return [r.asDict() for r in registries.info(self._meta(), self._live()).collect()]

    def record_entry(self, registry: str, key: str, fields: dict, source: dict | None = None) -> dict:
        """Insert or merge an entry: set values overwrite, empty ones erase nothing, undeclared fields become columns."""
        if not key.strip() or not fields:
            raise ValueError("an entry needs a key and fields")
        clean = {_plain(k): _plain(v) for k, v in fields.items()}
        with self._lock:
            meta = self._meta().filter(F.col("registry") == registry).collect()
            if not meta:
                raise LookupError(f"no registry {registry!r}")
            old = self._live().filter((F.col("registry") == registry) & (F.col("entry_key") == key)).collect()
            before = old[0].asDict(True) if old else None
            new = {k: v for k, v in clean.items() if v is not None and v.strip()}
            merged = {**(before["fields"] or {} if before else {}), **new}
            src = {k: v for k, v in (source or {}).items() if v is not None}
            whole = {**((before or {}).get("source") or {}), **src} if before or src else None
            now = _now()
            row = (self._next(), registry, key, before["recorded_at"] if before else now, now if before else None, False, merged, tuple((whole or {}).get(k) for k in ("mailbox", "uid", "attachment_index", "sha256", "saved_path")) if whole else None)
            line = self.spark.createDataFrame([row], journals.ENTRY)
            size = registries.line_bytes(line).first()["line_bytes"]
            if size > registries.LINE_BYTES:
                raise ValueError(f"the entry takes {size} bytes; a line of the journal has at most {registries.LINE_BYTES}")
            journals.append(line, self._path("entries.jsonl"))
            columns = list(meta[0]["field_columns"] or [])
            fresh = sorted(k for k in clean if k not in columns)
            if fresh:
                self._declare((self._next(), False, registry, meta[0]["description"], columns + fresh, meta[0]["field_docs"]))
            self._write_workbook()
            total = self._live().filter(F.col("registry") == registry).count()
        return {"registry": registry, "key": key, "action": "merge" if before else "insert", "undeclared": fresh, "total": total}

    def list_entries(self, registry: str, limit: int | None = None) -> list[dict]:
        """The newest entries of a registry; raises if there is no such registry."""
        if self._meta().filter(F.col("registry") == registry).isEmpty():
            raise LookupError(f"no registry {registry!r}")
        n = listing.clamp(limit, listing.ENTRIES, listing.ENTRIES_MOST)
        return [r.asDict(True) for r in registries.newest_entries(self._live().filter(F.col("registry") == registry), n).collect()]

    def remove_entry(self, registry: str, key: str) -> bool:
        """Mark an entry as removed; False if it does not exist."""
        with self._lock:
            gone = registries.removal(self._live(), registry, key)
            if gone.isEmpty():
                return False
            row = (self._next(), registry, key, None, _now(), True, None, None)
            journals.append(self.spark.createDataFrame([row], journals.ENTRY), self._path("entries.jsonl"))
            self._write_workbook()
            return True

    def drop_registry(self, registry: str) -> None:
        """Forget a registry with all its entries; raises if there is none."""
        with self._lock:
            if self._meta().filter(F.col("registry") == registry).isEmpty():
                raise LookupError(f"no registry {registry!r}")
            self._declare((self._next(), True, registry, None, None, None))
            self._write_workbook()

    def _write_workbook(self) -> None:
        """The workbook with all registries, newest entries first."""
        sheets = {}
        live = self._live()
        for m in self._meta().orderBy("registry").toLocalIterator():
            columns = list(m["field_columns"] or [])
            own = live.filter(F.col("registry") == m["registry"]).orderBy(F.desc("recorded_at"), F.asc("first_order"))
            sheets[m["registry"]] = (columns, (self._cells(r, columns) for r in own.toLocalIterator()))
        workbook.write_workbook(self._path("registries.xlsx"), sheets)

    def _cells(self, r, columns: list[str]) -> list:  # noqa: ANN001
        s, f = r["source"], r["fields"] or {}
        file = os.path.basename(s["saved_path"]) if s and s["saved_path"] else ""
        if file and self.config.doc_link:
            from urllib.parse import quote_plus

            file = self.config.doc_link.replace("{filename}", quote_plus(file, safe="~"))
        return [r["entry_key"], *[f.get(c) for c in columns], file, s["uid"] if s else None, r["recorded_at"], r["updated_at"]]

    # Cursors ------------------------------------------------------------------------------------------------

    def get_cursor(self, box: str = "INBOX") -> dict:
        """How far a mailbox has been worked off."""
        return cursors.get_cursor(self._path("cursors.json"), box)

    def set_cursor(self, uid_validity: int, last_uid: int, box: str = "INBOX") -> dict:
        """Move the cursor after the work up to it is done."""
        with self._lock:
            return cursors.set_cursor(self._path("cursors.json"), box, uid_validity, last_uid)


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _plain(v: object) -> str | None:
    """A field name or value as text without invisible characters; lists and objects as JSON."""
    import json

    if v is None:
        return None
    s = v if isinstance(v, str) else ("true" if v else "false") if isinstance(v, bool) else json.dumps(v, ensure_ascii=False)
    return s.translate(_INVISIBLE)
