"""A workbook with a sheet per registry, written without any spreadsheet library."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

# Columns before and after a registry's own.
BEFORE, AFTER = ("Key",), ("Quelle", "Mail-UID", "Erfasst", "Aktualisiert")
_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"


def sheet_names(registries: Iterable[str]) -> dict[str, str]:
    """A sheet name for each registry: 31 bytes at most, numbered where cutting made two equal."""
    out: dict[str, str] = {}
    for r in registries:
        name = r.encode()[:31].decode("utf-8", "ignore")
        n = 1
        while name in out.values():
            n += 1
            tail = f"~{n}"
            name = r.encode()[: 31 - len(tail)].decode("utf-8", "ignore") + tail
        out[r] = name
    return out


def _column(i: int) -> str:
    s = ""
    while i >= 0:
        s, i = chr(65 + i % 26) + s, i // 26 - 1
    return s


def _sheet(header: list[str], rows: Iterable[list]) -> tuple[str, list[str]]:
    links: list[str] = []
    out = [f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{_NS}" xmlns:r="{_REL}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>']
    refs: list[str] = []
    for n, row in enumerate([header, *rows], 1):
        cells = []
        for i, v in enumerate(row):
            at = f"{_column(i)}{n}"
            if v is None or v == "":
                continue
            if isinstance(v, bool):
                cells.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, int | float):
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
            else:
                style = ' s="1"' if n == 1 else ""
                clean = "".join(ch for ch in str(v) if ch in "\t\n\r" or ord(ch) > 31)
                cells.append(f'<c r="{at}" t="inlineStr"{style}><is><t xml:space="preserve">{escape(clean)}</t></is></c>')
                if n > 1 and clean.startswith(("http://", "https://", "file://")):
                    links.append(clean)
                    refs.append(f'<hyperlink ref="{at}" r:id="rId{len(links)}"/>')
        out.append(f'<row r="{n}">{"".join(cells)}</row>')
    out.append("</sheetData>" + (f"<hyperlinks>{''.join(refs)}</hyperlinks>" if refs else "") + "</worksheet>")
    return "".join(out), links


def write_workbook(path: str, sheets: dict[str, tuple[list[str], Iterable[list]]]) -> bool:
    """Write {registry: (own columns, rows)} to ``path`` as a whole, or remove the file if there are no registries.

    Rows have the key, the own columns, source, UID, recorded and updated; addresses become links, the header is bold and
    frozen. A workbook is a file for people: its rows come through the driver one by one. The file appears only when complete.
    """
    if not sheets:
        if os.path.exists(path):
            os.remove(path)
        return False
    names = sheet_names(sheets)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".xlsx")
    os.close(fd)
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    n = len(sheets)
    with zipfile.ZipFile(temp, "w", zipfile.ZIP_DEFLATED) as z:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, n + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(names.values(), 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_NS}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PKG}/relationships">{rels}<Relationship Id="rId{n + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{_NS}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for i, (own, rows) in enumerate(sheets.values(), 1):
            text, links = _sheet([*BEFORE, *own, *AFTER], rows)
            z.writestr(f"xl/worksheets/sheet{i}.xml", text)
            if links:
                targets = "".join(f'<Relationship Id="rId{k}" Type="{_REL}/hyperlink" Target="{escape(u, {chr(34): "&quot;"})}" TargetMode="External"/>' for k, u in enumerate(links, 1))
                z.writestr(f"xl/worksheets/_rels/sheet{i}.xml.rels", f'{head}<Relationships xmlns="{_PKG}/relationships">{targets}</Relationships>')
    os.replace(temp, path)
    return True
