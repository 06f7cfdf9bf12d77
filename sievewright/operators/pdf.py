"""Files embedded in PDF documents, and the invoice among them.

Objects are read one after the other, in the file and in its object streams, without the cross-reference table, which is often broken in
invoices. A stream has the length that its dictionary states if its end is there, and ends at its end mark otherwise.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cached_property

# Names that the standards give to an invoice in a PDF document, in small letters.
INVOICE_NAMES = ("factur-x.xml", "zugferd-invoice.xml", "xrechnung.xml", "cii.xml")
#: Bytes that one stream may inflate to; a longer one is no invoice.
MOST_BYTES = 64 << 20

_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+\d{1,5}\s+obj\b")
_BODY_END = re.compile(rb"(?<!end)stream(?:\r\n|\n|\r)?|endobj")
_STREAM = re.compile(rb"(?<!end)stream(?:\r\n|\n|\r)?")
_LENGTH = re.compile(rb"/Length\s+(\d+)(?!\s+\d+\s+R)")
_FILE_OF = re.compile(rb"/(?:UF|F)\s+(\d+)\s+\d+\s+R")
_EMBEDS = re.compile(rb"/EF\s*(?:<<(.*?)>>|(\d+)\s+\d+\s+R)", re.DOTALL)
_NAME = re.compile(rb"/(UF|F)\s*(?:\(((?:[^()\\]|\\.)*)\)|<([0-9A-Fa-f\s]*)>)", re.DOTALL)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.DOTALL)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def _inflated(data: bytes) -> bytes | None:
    """What a stream inflates to, as far as it is whole; null if it isn't deflated or too long."""
    z = zlib.decompressobj()
    try:
        out = z.decompress(data, MOST_BYTES)
    except zlib.error:
        return None
    return None if z.unconsumed_tail else out


def _string(literal: bytes | None, digits: bytes | None) -> str:
    """A text string: escapes undone, UTF-16 with a byte order mark or else one byte a character."""
    if literal is not None:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else _ESCAPED.get(m[1], m[1]), literal)
    else:
        packed = b"".join((digits or b"").split())
        raw = bytes.fromhex((packed + b"0" * (len(packed) % 2)).decode())
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


class Pdf:
    """The objects of a document: of each number the last one with its dictionary and, if it has one, its stream."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.heads: dict[int, bytes] = {}
        self.streams: dict[int, tuple[int, int]] = {}
        at = 0
        while m := _OBJECT.search(data, at):
            number, end = int(m[1]), _BODY_END.search(data, m.end())
            stop = end.start() if end else len(data)
            self.heads[number] = data[m.end() : stop]
            self.streams.pop(number, None)
            if end and end.group() != b"endobj":
                self.streams[number] = self._extent(self.heads[number], end.end())
                stop = self.streams[number][1]
            at = max(stop, m.end())
        for number in [n for n, head in self.heads.items() if b"/ObjStm" in head and n in self.streams]:
            self._open(number)

    def _extent(self, head: bytes, begin: int) -> tuple[int, int]:
        if m := _LENGTH.search(head):
            end = begin + int(m[1])
            if self.data[end : end + 32].lstrip().startswith(b"endstream"):
                return begin, end
        end = self.data.find(b"endstream", begin)
        end = len(self.data) if end < 0 else end
        # the line break before the mark is not part of the stream
        for mark in (b"\n", b"\r"):
            if end > begin and self.data[end - 1 : end] == mark:
                end -= 1
        return begin, end

    def _open(self, number: int) -> None:
        """The objects within an object stream; those of the file itself come later and win."""
        body = self.content(number)
        n, first = (re.search(rb"/%s\s+(\d+)" % key, self.heads[number]) for key in (b"N", b"First"))
        if body is None or not n or not first:
            return
        start = int(first[1])
        numbers = [int(v) for v in body[:start].split()[: 2 * int(n[1])] if v.isdigit()]
        places = sorted(zip(numbers[1::2], numbers[::2]))
        for i, (place, inner) in enumerate(places):
            end = places[i + 1][0] if i + 1 < len(places) else len(body) - start
            self.heads.setdefault(inner, body[start + place : start + end])

    def content(self, number: int) -> bytes | None:
        """The stream of an object, inflated if it says so or shows it."""
        if number not in self.streams:
            return None
        begin, end = self.streams[number]
        raw = self.data[begin:end]
        if b"FlateDecode" in self.heads[number]:
            return _inflated(raw)
        return raw

    @cached_property
    def files(self) -> list[tuple[str, bytes]]:
        """(name, content) of every embedded file, in the order of the objects that name them."""
        out = []
        for head in list(self.heads.values()):
            embeds = _EMBEDS.search(head)
            if not embeds:
                continue
            inner = embeds[1] if embeds[1] is not None else self.heads.get(int(embeds[2]), b"")
            names = {m[1]: _string(m[2], m[3]) for m in _NAME.finditer(head[: embeds.start()] + head[embeds.end() :])}
            target = _FILE_OF.search(inner)
            if target and names and (body := self.content(int(target[1]))) is not None:
                out.append((names.get(b"UF") or names.get(b"F") or "", body))
        return out

    def contents(self) -> Iterator[bytes]:
        """All streams, each as its dictionary says and then in the other way, for dictionaries are wrong at times."""
        known = sorted((begin, end, b"FlateDecode" in self.heads[number]) for number, (begin, end) in self.streams.items())
        for begin, end, deflated in [*known, *self._loose([(b, e) for b, e, _ in known])]:
            raw = self.data[begin:end]
            inflated = _inflated(raw)
            for body in (inflated, raw) if deflated else (raw, inflated):
                if body is not None:
                    yield body

    def _loose(self, known: list[tuple[int, int]]) -> Iterator[tuple[int, int, bool]]:
        """Streams between the known ones, to which no object belongs."""
        for free, until in zip([0, *(end for _, end in known)], [*(begin for begin, _ in known), len(self.data)]):
            for m in _STREAM.finditer(self.data, free, until):
                if m.end() < until:
                    yield *self._extent(b"", m.end()), False


def invoice_in(data: bytes | None, is_invoice) -> tuple[str | None, str | None]:  # noqa: ANN001
    """(text, name) of the invoice in a document: a file under a standard name, else the only XML file, else a stream that is one.

    The name is ``pdf stream`` for a stream that no file names. (null, null) if there is none.
    """
    if not data:
        return None, None
    pdf = Pdf(data)
    standard = [f for f in pdf.files if f[0].lower() in INVOICE_NAMES]
    xml = [f for f in pdf.files if f[0].lower().endswith(".xml")]
    for name, body in standard[:1] or (xml if len(xml) == 1 else []):
        return body.decode("utf-8-sig", "replace"), name
    for body in pdf.contents():
        if is_invoice(body):
            return body.decode("utf-8-sig", "replace"), "pdf stream"
    return None, None
