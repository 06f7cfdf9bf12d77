"""A mailbox as a data source, in batches and as a stream.

A mailbox is a folder ``<root>/<mailbox>/<uid_validity>/<uid>[.flags].eml``; flags are letters as in Maildir (``S`` seen,
``F`` flagged, ``R`` answered). Filters on mailbox, UID and epoch are answered from the names, before a file is opened, and
bytes are read only if the column is asked for through ``raw=true`` (the default).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "mailbox string, uid_validity bigint, uid bigint, internal_date timestamp, flags array<string>, size_bytes bigint, raw binary"
#: Messages that one task reads.
CHUNK = 500
_FILE = re.compile(r"^(\d+)(?:\.([A-Z]+))?\.eml$")
_FLAGS = {"S": "\\Seen", "F": "\\Flagged", "R": "\\Answered", "D": "\\Draft", "T": "\\Deleted"}


@dataclass
class _Part(InputPartition):
    """Files that one task reads."""

    files: list[tuple[str, int, int, str, str]]


def _epochs(root: str) -> Iterator[tuple[str, int, str]]:
    for mailbox in sorted(os.listdir(root)) if os.path.isdir(root) else ():
        at = os.path.join(root, mailbox)
        numbers = [e for e in os.listdir(at) if e.isdigit()] if os.path.isdir(at) else []
        for epoch in sorted(numbers, key=int):
            if os.path.isdir(os.path.join(at, epoch)):
                yield mailbox, int(epoch), os.path.join(at, epoch)


def _messages(folder: str) -> list[tuple[int, str, str]]:
    found = [(int(m[1]), m[2] or "", e.path) for e in os.scandir(folder) if (m := _FILE.match(e.name))]
    return sorted(found)


def _rows(part: _Part, raw: bool) -> Iterator[tuple]:
    for mailbox, epoch, uid, letters, path in part.files:
        s = os.stat(path)
        data = None
        if raw:
            with open(path, "rb") as f:
                data = f.read()
        yield mailbox, epoch, uid, datetime.fromtimestamp(int(s.st_mtime), UTC), [_FLAGS.get(x, x) for x in letters], s.st_size, data


def _split(files: list[tuple[str, int, int, str, str]]) -> list[_Part]:
    return [_Part(files[i : i + CHUNK]) for i in range(0, len(files), CHUNK)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.raw = options["path"], options.get("raw", "true") == "true"
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what names can answer; give the rest back to Spark."""
        compare = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
        for f in filters:
            column = getattr(f, "attribute", (None,))
            if type(f) in compare and len(column) == 1 and column[0] in ("mailbox", "uid", "uid_validity"):
                self.tests.append((column[0], compare[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[_Part]:
        files = []
        for mailbox, epoch, folder in _epochs(self.root):
            if all(t(mailbox if c == "mailbox" else epoch, v) for c, t, v in self.tests if c != "uid"):
                files += [(mailbox, epoch, u, letters, p) for u, letters, p in _messages(folder) if all(t(u, v) for c, t, v in self.tests if c == "uid")]
        return _split(files)

    def read(self, partition: _Part | None) -> Iterator[tuple]:
        return _rows(partition, self.raw) if partition else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are {mailbox: {uid_validity: last_uid}}: every epoch is read to its end, an older one too when a newer has begun."""

    def __init__(self, options: dict) -> None:
        self.root, self.raw = options["path"], options.get("raw", "true") == "true"
        self.listed: dict[tuple[str, str], tuple[str, list[tuple[int, str, str]]]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out: dict[str, dict[str, int]] = {}
        self.listed.clear()
        for mailbox, epoch, folder in _epochs(self.root):
            found = _messages(folder)
            self.listed[mailbox, str(epoch)] = folder, found
            out.setdefault(mailbox, {})[str(epoch)] = found[-1][0] if found else 0
        return out

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        if not self.listed:  # a batch that is run again after a restart
            self.latestOffset()
        files = []
        for mailbox, epochs in end.items():
            for epoch, last in epochs.items():
                since = start.get(mailbox, {}).get(epoch, 0)
                folder, found = self.listed.get((mailbox, epoch), ("", []))
                files += [(mailbox, int(epoch), u, letters, p) for u, letters, p in found if since < u <= last]
        return _split(files)

    def read(self, partition: _Part) -> Iterator[tuple]:
        return _rows(partition, self.raw)

    def commit(self, end: dict) -> None:
        """Nothing to keep: the checkpoint has the offsets."""


class MailboxSource(DataSource):
    """``spark.read.format("mailbox")`` and ``spark.readStream.format("mailbox")``; options ``path`` and ``raw``."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailboxSource)
