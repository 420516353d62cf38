"""Bytes to text and text formats to documents (pure functions; see ``files`` for the source)."""

from __future__ import annotations

import html as html_module
import json
import re

#: Encodings tried in order when a file is not UTF-8, and the limits.
ENCODINGS = ("gb18030", "gbk", "big5", "shift_jis", "euc_kr", "cp1252")
BINARY_HEAD, BINARY_SHARE, BAD_SHARE, CSV_ROWS = 8192, 0.02, 0.004, 20_000


def decode_text(data: bytes) -> tuple[str | None, str]:
    """(text, encoding); (None, 'binary') for data that is not text."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name
    head = data[:BINARY_HEAD]
    if head and head.count(0) > BINARY_SHARE * len(head):
        return None, "binary"
    text = data.decode("utf-8", "replace")
    if not text or text.count("�") < BAD_SHARE * len(text):
        return text, "utf-8"
    for name in ENCODINGS:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return text, "utf-8"


def parse_csv(text: str, delimiter: str | None = None, limit: int = CSV_ROWS) -> list[list[str]]:
    """Rows of strings: the first line's tabs and commas choose the separator, quotes double, empty rows go."""
    first = text.split("\n", 1)[0]
    sep = delimiter or ("\t" if first.count("\t") > first.count(",") else ",")
    rows, row, cell, quoted, i = [], [], [], False, 0
    n = len(text)
    while i < n and len(rows) < limit:
        ch = text[i]
        if quoted:
            if ch == '"' and text[i + 1 : i + 2] == '"':
                cell.append('"')
                i += 1
            elif ch == '"':
                quoted = False
            else:
                cell.append(ch)
        elif ch == '"':
            quoted = True
        elif ch == sep:
            row.append("".join(cell))
            cell = []
        elif ch == "\n":
            rows.append([*row, "".join(cell)])
            row, cell = [], []
        elif ch != "\r":
            cell.append(ch)
        i += 1
    if (cell or row) and len(rows) < limit:
        rows.append([*row, "".join(cell)])
    return [r for r in rows if any(c != "" for c in r)]


def html_text(source: str) -> str:
    from tomewright.functions.text import py_decode_entities, py_normalize_whitespace

    out = re.sub(r"<(script|style).*?</\1>", " ", source, flags=re.I | re.S)
    out = re.sub(r"<br\s*/?>", "\n", out, flags=re.I)
    out = re.sub(r"</(p|div|li|h[1-6]|tr|section|article|blockquote|pre)>", "\n", out, flags=re.I)
    return py_normalize_whitespace(py_decode_entities(re.sub(r"<[^>]*>", "", out)))


def readable_html(source: str | None) -> str:
    """HTML to show: scripts, frames and comments out, the rest sanitised."""
    out = re.sub(r"(?is)<(script|style|iframe|object|embed|link|meta|noscript).*?</\1>", "", source or "")
    return sanitize_html(re.sub(r"(?s)<!--.*?-->", "", out))


# What sanitised HTML may hold.
TAGS = set(
    "p br strong b em i u s del ins mark sub sup h1 h2 h3 h4 h5 h6 ul ol li blockquote pre code hr table thead tbody tfoot "
    "tr th td caption colgroup col a img figure figcaption span div input section details summary".split()
)
ATTRIBUTES = set(
    "href title alt src class style colspan rowspan data-lang data-type data-checked type checked disabled target rel "
    "width height id start".split()
)
_DROPPED = "script|style|iframe|object|embed|link|meta|base|form|svg|math"
_URL = re.compile(r"^(https?:|mailto:|tel:|data:image/(png|jpe?g|gif|webp);base64,|#|/|\./)", re.I)
_STYLE = re.compile(r"expression\s*\(|javascript:", re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def sanitize_html(source: str | None) -> str:
    """Only known tags and attributes, no scripts, no event handlers, no script URLs."""
    out = re.sub(r"<!--.*?-->", "", source or "", flags=re.S)
    out = re.sub(rf"<({_DROPPED})\b.*?</\1\s*>", "", out, flags=re.I | re.S)
    out = re.sub(rf"</?({_DROPPED})\b[^>]*>", "", out, flags=re.I)

    def tag(m: re.Match) -> str:
        closing, name, rest = m[1], m[2].lower(), m[3]
        if name not in TAGS:
            return ""
        if closing:
            return f"</{name}>"
        kept = []
        for a in _ATTRIBUTE.finditer(rest):
            key, value = a[1].lower(), next((v for v in a.groups()[1:] if v is not None), "")
            bad_url = key in ("href", "src") and not _URL.match(value.strip())
            if key in ATTRIBUTES and not bad_url and not (key == "style" and _STYLE.search(value)):
                kept.append(f' {key}="{html_module.escape(value)}"')
        if name == "a" and "target=" in rest:
            kept.append(' rel="noopener noreferrer"')
        return f"<{name}{''.join(kept)}>"

    return re.sub(r"<\s*(/?)\s*([a-zA-Z0-9-]+)([^<>]*)>", tag, out)


def markdown_html(source: str | None) -> str:
    """Headings, fences, rules, quotes, lists, tables and paragraphs with inline marks."""

    def inline(s: str) -> str:
        s = html_module.escape(s, quote=False)
        s = re.sub(r"`([^`]+)`", r"<code>\1</code>", s)
        s = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", r'<img src="\2" alt="\1">', s)
        s = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', s)
        s = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", s)
        s = re.sub(r"\*([^*]+)\*", r"<em>\1</em>", s)
        return re.sub(r"~~([^~]+)~~", r"<del>\1</del>", s)

    lines, out, i = (source or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"), [], 0
    while i < len(lines):
        line = lines[i]
        if line.startswith("```"):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].startswith("```")), len(lines))
            code = html_module.escape("\n".join(lines[i + 1 : end]), quote=False)
            out.append(f'<pre data-lang="{html_module.escape(line[3:].strip())}"><code>{code}</code></pre>')
            i = end + 1
        elif m := re.match(r"^\s{0,3}(#{1,6})\s+(.*)$", line):
            out.append(f"<h{len(m[1])}>{inline(m[2].strip())}</h{len(m[1])}>")
            i += 1
        elif re.match(r"^\s*([-*_])(\s*\1){2,}\s*$", line):
            out.append("<hr>")
            i += 1
        elif line.lstrip().startswith(">"):
            end = next((j for j in range(i, len(lines)) if not lines[j].lstrip().startswith(">")), len(lines))
            inner = "\n".join(re.sub(r"^\s*>\s?", "", x) for x in lines[i:end])
            out.append(f"<blockquote>{markdown_html(inner)}</blockquote>")
            i = end
        elif "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?[\s:|-]*-[\s:|-]*$", lines[i + 1]):
            cells = lambda x: [inline(c.strip()) for c in x.strip().strip("|").split("|")]
            end = next((j for j in range(i + 2, len(lines)) if "|" not in lines[j]), len(lines))
            head = "".join(f"<th>{c}</th>" for c in cells(line))
            body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in cells(x)) + "</tr>" for x in lines[i + 2 : end])
            out.append(f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
            i = end
        elif m := re.match(r"^\s*([-*+]|\d+\.)\s+", line):
            kind, item = ("ol" if m[1][0].isdigit() else "ul"), re.compile(r"^\s*(?:[-*+]|\d+\.)\s+(.*)$")
            items = []
            while i < len(lines) and (x := item.match(lines[i])):
                task = re.match(r"^\[([ xX])\]\s+(.*)$", x[1])
                done = f'<input type="checkbox" disabled{" checked" if task and task[1] != " " else ""}> ' if task else ""
                items.append(f"<li>{done}{inline(task[2] if task else x[1])}</li>")
                i += 1
            out.append(f"<{kind}>{''.join(items)}</{kind}>")
        elif line.strip():
            end = next((j for j in range(i, len(lines)) if not lines[j].strip()), len(lines))
            out.append("<p>" + "<br>".join(inline(x) for x in lines[i:end]) + "</p>")
            i = end
        else:
            i += 1
    return "\n".join(out)


def json_pretty(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, indent=2)
    except ValueError:
        return None
