"""Text functions as DataFrame expressions, evaluated in the JVM.

Lengths and positions count code points. Null texts behave as empty ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# CJK ranges, their subset that word counts use, and both stop-word lists.
CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"
HAN = "㐀-䶿一-鿿豈-﫿"
EN_STOP_WORDS = (
    "a an the and or but if then than that this these those of in on at to for from by with without into over under "
    "is are was were be been being am do does did done have has had having will would shall should can could may might must "
    "it its it's as not no nor so such too very can't cannot we you they he she i me my our your their his her them us "
    "about above after again against all also any because before below between both during each few more most other some only "
    "own same s t don now here there when where why how what which who whom while very just"
).split()
ZH_STOP_WORDS = (
    "的 了 和 是 在 我 有 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 他 她 它 们 与 及 或 而 但 因 "
    "所以 如果 我们 你们 他们 这个 那个 什么 怎么 如何 可以 需要 进行 通过 以及 其中 对于 关于 根据 由于 并且 但是 因此 例如 "
    "一些 这些 那些"
).split()
STOP_WORDS = list(dict.fromkeys(EN_STOP_WORDS + ZH_STOP_WORDS))
RUNS = f"[{CJK}]+|[a-z0-9][a-z0-9_+#.-]*"
KEYWORD_WEIGHTS = {"cjk": 1.0, "long": 1.6, "short": 1.2}


def empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def all_tokens(text: Column) -> Column:
    """Runs of the lower-cased text; a CJK run of two or more gives its overlapping pairs."""
    runs = F.regexp_extract_all(F.lower(empty(text)), F.lit(f"({RUNS})"), 1)
    pairs = F.transform(
        runs,
        lambda r: F.when(
            r.rlike(f"^[{CJK}]") & (F.length(r) > 1),
            F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))),
        ).otherwise(F.array(r)),
    )
    # most texts have no CJK character, and then the runs are the tokens
    return F.when(empty(text).rlike(f"[{CJK}]"), F.flatten(pairs)).otherwise(runs)


def tokens(text: Column) -> Column:
    """Index terms: tokens without single Latin characters and stop words."""
    return F.filter(
        all_tokens(text), lambda t: ((F.length(t) > 1) | t.rlike(f"^[{CJK}]")) & ~t.isin(STOP_WORDS)
    )


_PY_RUNS = re.compile(RUNS)
_PY_CJK = re.compile(f"[{CJK}]")
_STOP = frozenset(STOP_WORDS)


def py_tokens(text: str | None) -> list[str]:
    """:func:`tokens` for the sequential operators and for literal queries."""
    out = []
    for run in _PY_RUNS.findall((text or "").lower()):
        if _PY_CJK.match(run):
            out += [run] if len(run) == 1 else [run[k : k + 2] for k in range(len(run) - 1)]
        elif len(run) > 1:
            out.append(run)
    return [t for t in out if t not in _STOP]


def query_terms(q: str | None) -> list[str]:
    """Distinct words of a literal query, CJK runs with their pairs, longest first; case kept."""
    terms: dict[str, None] = {}
    for piece in re.findall(f"[A-Za-z0-9_+#.-]+|[{CJK}]+", (q or "").strip()):
        terms[piece] = None
        if _PY_CJK.match(piece) and len(piece) > 1:
            terms.update(dict.fromkeys(piece[k : k + 2] for k in range(len(piece) - 1)))
    return sorted(terms, key=lambda t: -len(t))


def normalize_whitespace(text: Column) -> Column:
    out = F.regexp_replace(empty(text), "\r\n?", "\n")
    out = F.regexp_replace(out, " ", " ")
    out = F.regexp_replace(out, "[ \t]+\n", "\n")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def py_normalize_whitespace(text: str | None) -> str:
    out = re.sub("\r\n?", "\n", text or "").replace(" ", " ")
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+\n", "\n", out)).strip().strip("﻿")


# Characters and entities that HTML text needs.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
HTML_ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#0?39;|&apos;", "'"),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&hellip;", "…"),
)


def escape_html(text: Column) -> Column:
    out = empty(text)
    for raw, shown in HTML_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def decode_entities(text: Column) -> Column:
    """Named and numeric references; ``&amp;`` last, so that it is never decoded twice.

    Texts without an ampersand, the most, go through no expression at all.
    """

    def numbers(source: Column, pattern: str, base: int) -> Column:
        # cut at the references: text, number, text, number, ... and join with characters
        def joined(parts: Column) -> Column:
            tail = F.transform(
                F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                lambda p: F.concat(
                    _character(F.conv(F.substring_index(p, "\u0002", 1), base, 10).cast("bigint")),
                    F.substr(p, F.instr(p, "\u0002") + 1),
                ),
            )
            return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))

        return _once(F.split(F.regexp_replace(source, pattern, "\u0001$1\u0002"), "\u0001"), joined)

    def replaced(source: Column, test: str, pattern: str, base: int) -> Column:
        return _once(source, lambda t: F.when(t.rlike(test), numbers(t, pattern, base)).otherwise(t))

    def decoded(raw: Column) -> Column:
        out = raw
        for pattern, shown in HTML_ENTITIES:
            out = F.regexp_replace(out, f"(?i){pattern}", shown)
        for test, pattern, base in (
            ("&#[0-9]{1,7};", "&#([0-9]{1,7});", 10),
            ("(?i)&#x[0-9a-f]{1,6};", "(?i)&#x([0-9a-f]{1,6});", 16),
        ):
            out = replaced(out, test, pattern, base)
        return F.regexp_replace(out, "(?i)&amp;", "&")

    return _once(empty(text), lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


def py_decode_entities(text: str) -> str:
    """:func:`decode_entities` of one text."""
    for pattern, shown in HTML_ENTITIES:
        text = re.sub(pattern, shown, text, flags=re.I)

    def character(base: int):
        return lambda m: chr(n) if 0 < (n := int(m[1], base)) < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    text = re.sub(r"&#([0-9]{1,7});", character(10), text)
    text = re.sub(r"&#x([0-9a-f]{1,6});", character(16), text, flags=re.I)
    return re.sub("&amp;", "&", text, flags=re.I)


def _character(code: Column) -> Column:
    """The character of a code point, by way of its UTF-32 bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def strip_tags(html: Column) -> Column:
    out = F.regexp_replace(empty(html), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</(p|div|li|h[1-6]|tr|section|article|blockquote|pre)>", "\n")
    return F.regexp_replace(out, r"<[^>]*>", "")


def html_to_text(html: Column) -> Column:
    return normalize_whitespace(decode_entities(strip_tags(html)))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(empty(html), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def markdown_to_text(md: Column) -> Column:
    out = empty(md)
    for pattern, shown in (
        (r"(?s)```.*?```", " "),
        (r"`([^`]+)`", "$1"),
        (r"!\[[^\]]*\]\([^)]*\)", " "),
        (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"(?m)^\s{0,3}#{1,6}\s+", ""),
        (r"(?m)^\s*>\s?", ""),
        (r"[*_~]{1,3}", ""),
        (r"\|", " "),
        (r"\r\n?", "\n"),
        (r"\n{3,}", "\n\n"),
    ):
        out = F.regexp_replace(out, pattern, shown)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def markdown_headings(md: Column, limit: int = 60) -> Column:
    found = F.regexp_extract_all(empty(md), F.lit(r"(?m)^\s{0,3}(#{1,6}\s+[^\n]*)$"), 1)
    return F.slice(F.transform(found, lambda h: F.trim(F.regexp_replace(h, r"^#{1,6}\s+", ""))), 1, limit)


def sentences(text: Column) -> Column:
    """Sentences of the text with its white space collapsed; those of one character go."""
    flat = F.trim(F.regexp_replace(empty(text), r"\s+", " "))
    parts = F.split(flat, r"(?<=[。！？!?；;])\s*|(?<=\.)\s+(?=[A-Z0-9])")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) > 1)


_PY_SENTENCE = re.compile(r"(?<=[。！？!?；;])\s*|(?<=\.)\s+(?=[A-Z0-9])")


def py_sentences(text: str | None) -> list[str]:
    flat = re.sub(r"\s+", " ", text or "").strip()
    return [p.strip() for p in _PY_SENTENCE.split(flat) if len(p.strip()) > 1] if flat else []


def py_sections(text: str | None) -> list[tuple[str, str]]:
    """(heading, body) of the parts that ATX headings open."""
    out, heading, body, begun = [], "", [], False
    for line in (text or "").split("\n"):
        m = re.match(r"^\s{0,3}#{1,6}\s+(.*)$", line)
        if m:
            if begun:
                out.append((heading, body))
            heading, body, begun = m[1].strip(), [], True
        else:
            body.append(line)
            begun = True
    if begun:
        out.append((heading, body))
    cleaned = [(h, py_normalize_whitespace("\n".join(b))) for h, b in out]
    return [(h, b) for h, b in cleaned if h or b]


def word_count(text: Column) -> Column:
    return F.regexp_count(empty(text), F.lit(f"[{HAN}]")) + F.regexp_count(empty(text), F.lit("[A-Za-z0-9_]+"))


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(words / 380 + 0.5)).cast("int")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def py_truncate(text: str, n: int) -> str:
    return text if len(text) <= n else text[: n - 1] + "…"


def snippet(text: Column, terms: list[str], radius: int = 110, fallback: int = 200) -> Column:
    """The earliest match of a term with ``radius`` characters around it, or the text's head."""
    body = empty(text)
    low = F.lower(body)
    found = F.filter(
        F.array(*[F.struct(F.instr(low, t.lower()).alias("at"), F.lit(i).alias("i"), F.lit(len(t)).alias("n")) for i, t in enumerate(terms)])
        if terms
        else F.array().cast("array<struct<at:int,i:int,n:int>>"),
        lambda x: x["at"] > 0,
    )
    best = F.array_min(found)
    start = F.greatest(F.lit(0), best["at"] - 1 - radius)
    end = F.least(F.length(body), best["at"] - 1 + best["n"] + radius)
    around = F.concat(
        F.when(start > 0, "…").otherwise(""),
        F.substr(body, start + 1, end - start),
        F.when(end < F.length(body), "…").otherwise(""),
    )
    head = F.concat(F.substring(body, 1, fallback), F.when(F.length(body) > fallback, "…").otherwise(""))
    return F.when(F.size(found) > 0, around).otherwise(head)


def highlight(text: Column, terms: list[str]) -> Column:
    """The text escaped for HTML with every match of a term in ``<mark>``, longest terms first."""
    parts = [re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", t) for t in sorted(terms, key=lambda t: -len(t)) if t]
    if not parts:
        return escape_html(text)
    marked = F.regexp_replace(empty(text), "(?i)(" + "|".join(parts) + ")", "\u0001$1\u0002")
    out = F.replace(escape_html(marked), F.lit("\u0001"), F.lit("<mark>"))
    return F.replace(out, F.lit("\u0002"), F.lit("</mark>"))


def strip_think(text: Column) -> Column:
    out = F.regexp_replace(empty(text), r"(?is)<think(ing)?>.*?</think(ing)?>", "")
    return F.regexp_replace(out, r"(?i)</?think(ing)?>", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9一-鿿]+", "-"), "^-|-$", "")


def safe_file_name(name: Column, fallback: str = "untitled") -> Column:
    base = F.element_at(F.split(empty(name), r"[\\/]"), -1)
    clean = F.regexp_replace(base, r'[\x00-\x1f<>:"|?*]', "_")
    clean = F.substring(F.trim(F.regexp_replace(clean, r"\s+", " ")), 1, 180)
    return F.when(clean == "", fallback).otherwise(clean)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(empty(name), r"^.+\.([^.]*)$", 1))


def fixed(v: Column, digits: int) -> Column:
    """``v`` with decimals, rounded by its exact value, ties to even, as C's printf does.

    Java's formatter rounds the shortest decimal that reads back as ``v``, and ties up. ``v`` is not
    negative and a whole number over a power of two, so its fraction times ``one`` is exact.
    """
    one = 10**digits
    units = F.floor(v) * one + F.rint((v - F.floor(v)) * one).cast("long")
    return F.concat(F.floor(units / one), F.lit("."), F.lpad((units % one).cast("string"), digits, "0"))


def format_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024**2, F.concat(fixed(n / 1024, 1), F.lit(" KB")))
        .when(n < 1024**3, F.concat(fixed(n / 1024**2, 1), F.lit(" MB")))
        .otherwise(F.concat(fixed(n / 1024**3, 2), F.lit(" GB")))
    )


def to_array(value: Column) -> Column:
    """A JSON array, or comma-separated text, as an array of strings."""
    text = F.trim(empty(value))
    listed = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(
        F.when(text.startswith("["), F.from_json(text, "array<string>")), listed
    )


def normalize_tags(value: Column) -> Column:
    """Tags trimmed, without leading #, 32 characters at most, the first of each spelling, 20 at most."""
    clean = F.transform(
        to_array(value), lambda t: F.substring(F.regexp_replace(F.trim(t), "^#+", ""), 1, 32)
    )
    seen = F.aggregate(
        F.filter(clean, lambda t: t != ""),
        F.array().cast("array<string>"),
        lambda out, t: F.when(F.exists(out, lambda x: F.lower(x) == F.lower(t)), out).otherwise(
            F.concat(out, F.array(t))
        ),
    )
    return F.slice(seen, 1, 20)


def keyword_weight(term: Column, tf: Column) -> Column:
    kind = (
        F.when((F.length(term) == 2) & term.rlike(f"^[{CJK}]"), KEYWORD_WEIGHTS["cjk"])
        .when(F.length(term) >= 3, KEYWORD_WEIGHTS["long"])
        .otherwise(KEYWORD_WEIGHTS["short"])
    )
    return tf * kind * F.log(F.lit(2) + F.length(term))


def keywords_of(candidates: Column, limit: int) -> Column:
    """The first ``limit`` of ranked terms, leaving out any that contains a chosen one or is in it."""
    return F.aggregate(
        candidates,
        F.array().cast("array<string>"),
        lambda out, t: F.when(
            (F.size(out) >= limit) | F.exists(out, lambda k: F.contains(k, t) | F.contains(t, k)), out
        ).otherwise(F.concat(out, F.array(t))),
    )


def py_keywords(text: str | None, limit: int = 12) -> list[str]:
    import math

    tf: dict[str, int] = {}
    for t in py_tokens(text):
        tf[t] = tf.get(t, 0) + 1

    def weight(term: str, n: int) -> float:
        cjk = len(term) == 2 and _PY_CJK.match(term)
        return n * (1.0 if cjk else 1.6 if len(term) >= 3 else 1.2) * math.log(2 + len(term))

    out: list[str] = []
    for term, n in sorted(tf.items(), key=lambda x: -weight(*x)):
        if len(term) >= 2 and not any(term in k or k in term for k in out):
            out.append(term)
            if len(out) >= limit:
                break
    return out


# Preview kinds of file extensions.
PREVIEW_KINDS = {
    "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "xls": "xlsx", "pptx": "pptx", "txt": "text", "md": "markdown",
    "markdown": "markdown", "csv": "csv", "tsv": "csv", "json": "code", "xml": "code", "yml": "code", "yaml": "code",
    "html": "html", "htm": "html", "log": "text", "ini": "code", "toml": "code", "sql": "code", "png": "image",
    "jpg": "image", "jpeg": "image", "gif": "image", "webp": "image", "bmp": "image", "svg": "image", "mp3": "audio",
    "wav": "audio", "m4a": "audio", "mp4": "video", "webm": "video", "mov": "video", "zip": "archive",
    "rar": "archive", "7z": "archive",
}
CODE_EXTENSIONS = (
    "js mjs cjs ts tsx jsx py java c h cpp hpp cs go rs rb php swift kt scala sh bash zsh ps1 bat sql r lua pl dart vue "
    "svelte css scss less graphql proto dockerfile makefile"
).split()
TEXT_EXTENSIONS = "txt log ini conf cfg env properties gitignore editorconfig".split()


def preview_kind(ext: Column, mime: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in PREVIEW_KINDS.items() for x in pair])
    e = F.lower(empty(ext))
    out = F.coalesce(kinds[e], F.when(e.isin(CODE_EXTENSIONS), "code"), F.when(e.isin(TEXT_EXTENSIONS), "text"))
    for kind in ("image", "audio", "video", "text"):
        out = F.coalesce(out, F.when(empty(mime).startswith(f"{kind}/"), kind))
    return F.coalesce(out, F.lit("binary"))
