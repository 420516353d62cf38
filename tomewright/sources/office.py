"""Word, spreadsheet and presentation packages to text, with the standard library only."""

from __future__ import annotations

import datetime
import io
import re
import xml.etree.ElementTree as ET
import zipfile

MAX_ENTRY = 64 << 20
MAX_ROWS, MAX_COLUMNS = 20_000, 1000
# Built-in number formats that show dates or times, and day zero.
# Number formats that show dates, and those that show a time of day only.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
TIME_FORMATS = {18, 19, 20, 21, 45, 46, 47}
DAY_ZERO = datetime.datetime(1899, 12, 30)


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attribute(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _find(e: ET.Element, name: str):
    return (x for x in e.iter() if _local(x) == name)


class Package:
    """A ZIP package of XML parts; parts that are missing, too large or broken read as None."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = {i.filename: i.file_size for i in self.zip.infolist() if not i.is_dir()}

    def xml(self, name: str) -> ET.Element | None:
        if self.names.get(name, MAX_ENTRY + 1) > MAX_ENTRY:
            return None
        data = self.zip.read(name)
        if b"<!DOCTYPE" in data[:1024] or b"<!ENTITY" in data:  # no entity expansion
            return None
        try:
            return ET.fromstring(data)
        except ET.ParseError:
            return None

    def relations(self, part: str) -> dict[str, str]:
        folder, _, file = part.rpartition("/")
        root = self.xml(f"{folder}/_rels/{file}.rels" if folder else f"_rels/{file}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            path = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}".lstrip("/")
            while "/../" in path:
                path = re.sub(r"[^/]+/\.\./", "", path, count=1)
            out[r.get("Id", "")] = path
        return out


def zip_entries(data: bytes) -> list[tuple[str, int, bytes | None]]:
    """(name, size, content or None if too large) of every file in an archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [
            (i.filename, i.file_size, z.read(i) if i.file_size <= MAX_ENTRY else None)
            for i in z.infolist()
            if not i.is_dir()
        ]


def docx_blocks(data: bytes) -> list[tuple[str, str]]:
    """(kind, text): h1 to h6, li, p, and table rows with tabs between cells."""
    body = Package(data).xml("word/document.xml")

    def text_of(e: ET.Element) -> str:
        out = []
        for x in e.iter():
            if _local(x) == "t":
                out.append(x.text or "")
            elif _local(x) in ("tab",):
                out.append("\t")
            elif _local(x) in ("br", "cr"):
                out.append("\n")
        return "".join(out)

    def kind_of(p: ET.Element) -> str:
        style = next((_attribute(x, "val") or "" for x in _find(p, "pStyle")), "")
        if m := re.match(r"(?i)heading\s*([1-6])$", style):
            return f"h{m[1]}"
        if style.lower() in ("title", "subtitle"):
            return "h1" if style.lower() == "title" else "h2"
        return "li" if next(_find(p, "numPr"), None) is not None or style.lower().startswith("list") else "p"

    def walk(parent: ET.Element):
        for e in parent:
            if _local(e) == "p":
                if t := text_of(e).strip():
                    yield kind_of(e), t
            elif _local(e) == "tbl":
                for row in (r for r in e if _local(r) == "tr"):
                    cells = (c for c in row if _local(c) == "tc")
                    yield "row", "\t".join("\n".join(text_of(p) for p in _find(c, "p")).strip() for c in cells)
            elif _local(e) in ("body", "sdt", "sdtContent"):
                yield from walk(e)

    return list(walk(body)) if body is not None else []


def _column_of(ref: str) -> int:
    """The column that a cell reference begins with; -1 without one."""
    m = re.match(r"[A-Za-z]+", ref or "")
    column = 0
    for ch in m[0].upper() if m else "":
        column = column * 26 + ord(ch) - 64
    return column - 1


def _row_of(ref: str) -> int:
    """The row that a reference ends with; -1 without one."""
    m = re.search(r"\d+$", ref or "")
    return int(m[0]) - 1 if m else -1


def excel_date(serial: float, fmt: int = 14, code: str = "") -> str:
    """A serial number as the format shows it: a date, a time of day, or both."""
    moment = DAY_ZERO + datetime.timedelta(milliseconds=int(serial * 86_400_000 + 0.5))
    if fmt in TIME_FORMATS or (code and not re.search("(?i)[ymd]", code)):
        short = fmt in (20, 45) or (code and not re.search("(?i)s", code))
        return moment.strftime("%H:%M" if short else "%H:%M:%S")
    both = fmt == 22 or re.search("(?i)h", code)
    return f"{moment.year}-{moment:%m-%d %H:%M:%S}" if both else f"{moment.year}-{moment:%m-%d}"


def _number(raw: str, fmt: int, code: str) -> str:
    try:
        x = float(raw)
    except ValueError:
        return raw
    if x != x or x in (float("inf"), float("-inf")):
        return raw
    plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    if fmt in DATE_FORMATS or re.search("(?i)[ymd]", plain):
        try:
            return excel_date(x, fmt, code)
        except OverflowError:
            return raw
    if fmt in (9, 10) or "%" in code:
        return f"{x * 100:.{2 if fmt == 10 or '.00' in code else 0}f}%"
    if fmt in (4, 37, 38, 39, 40) or re.search("[$€£¥]", code):
        return f"{'-' if x < 0 else ''}{abs(x):,.2f}"
    return raw


def _placed(part: ET.Element):
    """(row, column, cell): a row or cell without a reference comes after the one before it.

    A row without a number takes that of its first cell that has one.
    """
    next_row = 0
    for r in _find(part, "row"):
        named = (at for x in (r, *r) if (at := _row_of(x.get("r", ""))) >= 0)
        row = next(named, next_row)
        next_row, next_column = row + 1, 0
        for c in r:
            if _local(c) == "c":
                column = at if (at := _column_of(c.get("r", ""))) >= 0 else next_column
                next_column = column + 1
                yield row, column, c


def xlsx_cells(data: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of every filled cell, sheets in workbook order."""
    pack = Package(data)
    book, links = pack.xml("xl/workbook.xml"), pack.relations("xl/workbook.xml")
    shared_part, styles = pack.xml("xl/sharedStrings.xml"), pack.xml("xl/styles.xml")
    shared = []
    if shared_part is not None:
        shared = ["".join(t.text or "" for t in _find(si, "t")) for si in shared_part if _local(si) == "si"]
    codes, formats = {}, []
    if styles is not None:
        codes = {int(_attribute(f, "numFmtId") or 0): _attribute(f, "formatCode") or "" for f in _find(styles, "numFmt")}
        xfs = next(_find(styles, "cellXfs"), None)
        formats = [int(_attribute(x, "numFmtId") or 0) for x in (xfs if xfs is not None else ())]
    out = []
    for sheet in _find(book, "sheet") if book is not None else ():
        part = pack.xml(links.get(_attribute(sheet, "id") or "", ""))
        if part is None:
            continue
        for row, column, c in _placed(part):
            if not (row < MAX_ROWS and column < MAX_COLUMNS):
                continue
            kind = c.get("t", "n")
            raw = next((v.text or "" for v in c if _local(v) == "v"), "")
            if kind == "s":
                text = shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in _find(c, "t"))
            elif kind == "b":
                text = "TRUE" if raw == "1" else "FALSE"
            elif kind == "d":
                text = raw.replace("T", " ", 1).removesuffix("Z")
            elif kind == "n" and raw:
                style = int(c.get("s", 0) or 0)
                fmt = formats[style] if style < len(formats) else 0
                text = _number(raw, fmt, codes.get(fmt, ""))
            else:
                text = raw
            if text != "":
                out.append((sheet.get("name", ""), row, column, text))
    return out


def xlsx_text(cells: list[tuple[str, int, int, str]]) -> str:
    """Sheets one after the other, a line a row, tabs between the columns from the first filled one."""
    sheets: dict[str, dict[int, dict[int, str]]] = {}
    for sheet, row, column, text in cells:
        sheets.setdefault(sheet, {}).setdefault(row, {})[column] = text
    out = []
    for sheet, rows in sheets.items():
        left = min(min(r) for r in rows.values())
        right = max(max(r) for r in rows.values())
        lines = ["\t".join(r.get(c, "") for c in range(left, right + 1)).rstrip("\t") for _, r in sorted(rows.items())]
        out.append("\n".join([sheet, *lines]))
    return "\n\n".join(out)


def pptx_slides(data: bytes) -> list[tuple[int, str, str]]:
    """(number, title, text) of the slides in presentation order."""
    pack = Package(data)
    deck, links = pack.xml("ppt/presentation.xml"), pack.relations("ppt/presentation.xml")
    out = []
    for n, s in enumerate(_find(deck, "sldId") if deck is not None else (), 1):
        rid = next((v for k, v in s.attrib.items() if k.endswith("}id")), "")
        part = pack.xml(links.get(rid, ""))
        if part is None:
            continue
        title, lines = "", []
        for shape in part.iter():
            if _local(shape) not in ("sp", "graphicFrame"):
                continue
            kind = next((_attribute(p, "type") for p in _find(shape, "ph")), None)
            paras = ["".join(t.text or "" for t in _find(p, "t")) for p in _find(shape, "p")]
            paras = [p for p in paras if p.strip()]
            if kind in ("title", "ctrTitle") and not title:
                title = " ".join(paras)
            else:
                lines += paras
        out.append((n, title, "\n".join(lines)))
    return out
