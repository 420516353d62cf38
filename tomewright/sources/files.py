"""File sources: a tree of files to documents, archives to entries, line streams to rows."""

from __future__ import annotations

import io
import itertools
import re
from collections.abc import Iterator
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.functions import crypto
from tomewright.functions.text import PREVIEW_KINDS, CODE_EXTENSIONS, TEXT_EXTENSIONS

DOCUMENT = "ok boolean, kind string, text string, html string, pages array<struct<index:int,text:string>>, meta map<string,string>, warning string"
#: Limits, each a parameter; what they cut is named in ``warning``.
MAX_TEXT = 8 << 20
MAX_FILE = 256 << 20


def kind_of(name: str, mime: str = "") -> str:
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else name.lower()
    if ext in PREVIEW_KINDS:
        return PREVIEW_KINDS[ext]
    if ext in CODE_EXTENSIONS:
        return "code"
    if ext in TEXT_EXTENSIONS:
        return "text"
    return next((k for k in ("image", "audio", "video", "text") if mime.startswith(f"{k}/")), "binary")


def table_html(rows: list[list[str]]) -> str:
    body = "".join("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in r) + "</tr>" for r in rows)
    return f"<table><tbody>{body}</tbody></table>" if rows else ""


def blocks_html(blocks: list[tuple[str, str]]) -> str:
    """HTML of (kind, text) blocks: headings, paragraphs, runs of list items and of table rows."""
    out = []
    for kind, run in itertools.groupby(blocks, key=lambda b: b[0]):
        texts = [escape(t) for _, t in run]
        if kind == "li":
            out.append("<ul>" + "".join(f"<li>{t}</li>" for t in texts) + "</ul>")
        elif kind == "row":
            cells = ("".join(f"<td>{c}</td>" for c in t.split("\t")) for t in texts)
            out.append("<table><tbody>" + "".join(f"<tr>{c}</tr>" for c in cells) + "</tbody></table>")
        else:
            out += [f"<{kind}>{t}</{kind}>" for t in texts]
    return "".join(out)


def extract_document(data: bytes, name: str, mime: str = "", most_text: int = MAX_TEXT) -> dict:
    """One document of any known format; a broken file gives ``ok`` false and a warning, never an error."""
    from tomewright.functions.text import py_normalize_whitespace
    from tomewright.sources import decode, office, pdf

    kind = kind_of(name, mime)
    out = {"ok": True, "kind": kind, "text": "", "html": "", "pages": [], "meta": {}, "warning": ""}
    try:
        if kind == "pdf":
            found = pdf.extract(data)
            out["pages"] = [{"index": i, "text": t} for i, t in found["pages"]]
            out |= {"ok": found["ok"], "warning": found["warning"], "text": "\n\n".join(t for _, t in found["pages"])}
            out["meta"] |= {k: v for k, v in found["meta"].items() if v}
        elif kind == "docx":
            blocks = office.docx_blocks(data)
            out |= {"text": "\n".join(t for _, t in blocks), "html": blocks_html(blocks)}
        elif kind == "xlsx":
            out["text"] = office.xlsx_text(office.xlsx_cells(data))
            sheets = out["text"].split("\n\n") if out["text"] else []
            grids = ((x.split("\n")[0], [r.split("\t") for r in x.split("\n")[1:]]) for x in sheets)
            out["html"] = "".join(f"<h3>{escape(sheet)}</h3>{table_html(rows)}" for sheet, rows in grids)
        elif kind == "pptx":
            slides = office.pptx_slides(data)
            out["pages"] = [{"index": n, "text": f"{a}\n{b}".strip()} for n, a, b in slides]
            out["text"] = "\n\n".join(p["text"] for p in out["pages"])
            shown = (f"<h3>{escape(a)}</h3><p>{escape(b)}</p>" for _, a, b in slides)
            out["html"] = "".join(f"<section>{x}</section>" for x in shown)
        elif kind in ("image", "audio", "video", "binary", "archive"):
            out["ok"] = False
            out["warning"] = "no text in this kind of file"
        else:
            text, encoding = decode.decode_text(data)
            out["meta"]["encoding"] = encoding
            if text is None:
                return out | {"ok": False, "warning": "binary data"}
            out["text"] = text
            if kind == "markdown":
                out["html"] = decode.sanitize_html(decode.markdown_html(text))
                out["meta"]["headings"] = "\n".join(re.findall(r"(?m)^\s{0,3}#{1,6}\s+(.*)$", text)[:60])
            elif kind == "html":
                title = re.search(r"<title[^>]*>(.*?)</title>", text, re.I | re.S)
                out |= {"text": decode.html_text(text), "html": decode.sanitize_html(text)}
                out["meta"]["title"] = re.sub(r"\s+", " ", title[1]).strip() if title else ""
            elif kind == "csv":
                rows = decode.parse_csv(text)
                out["text"] = "\n".join("\t".join(r) for r in rows)
                out["meta"]["rows"] = str(len(rows))
                out["html"] = table_html(rows)
                if len(rows) >= decode.CSV_ROWS:
                    out["warning"] = f"rows cut at {decode.CSV_ROWS}"
            elif kind == "code":
                out["meta"]["lines"] = str(text.count("\n") + 1)
                out["html"] = f"<pre><code>{escape(text)}</code></pre>"
                if name.lower().endswith(".json"):
                    pretty = decode.json_pretty(text)
                    out["text"], out["warning"] = (pretty, "") if pretty is not None else (text, "invalid JSON")
            else:
                out["meta"]["lines"] = str(text.count("\n") + 1)
    except Exception as e:  # a hostile file must not fail the job
        out |= {"ok": False, "warning": f"{type(e).__name__}: {e}"[:500]}
    whole = py_normalize_whitespace(out["text"])
    if len(whole) > most_text:
        out["warning"] = "; ".join(filter(None, [out["warning"], f"text cut at {most_text} characters"]))
    out["text"] = whole[:most_text]
    return out


def documents(files: DataFrame, most_text: int = MAX_TEXT) -> DataFrame:
    """Documents of (path, content) rows, as ``binaryFile`` reads them; null content was not read."""
    schema = T.StructType([T.StructField("path", T.StringType()), *T.StructType.fromDDL(DOCUMENT)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                path, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                doc = extract_document(data or b"", path.rsplit("/", 1)[-1], "", most_text)
                if data is None:
                    doc |= {"ok": False, "warning": "not read: larger than the limit"}
                yield pa.RecordBatch.from_pylist([{"path": path, **doc}], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def read_tree(spark: SparkSession, root: str, pattern: str = "*", most: int = MAX_FILE, key: bytes | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of a folder and all below it.

    Files of more than ``most`` bytes are listed with null content, unread. With a ``key``,
    sealed content is opened and plain content left as it is; ``length`` is that of the file.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    large = reader.load(root).where(F.col("length") > most).withColumn("content", F.lit(None).cast("binary"))
    read = reader.load(root).where(F.col("length") <= most)
    if key is not None:
        read = read.withColumn("content", crypto.unseal(F.col("content"), key))
    return read.unionByName(large)


def byte_range(content: Column, start: int, length: int) -> Column:
    return F.substring(content, start + 1, length)


def archive_entries(files: DataFrame) -> DataFrame:
    """(path, name, size, content) of every file in ZIP archives; broken archives give no rows."""
    schema = "path string, name string, size long, content binary"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zipfile
        from tomewright.sources.office import zip_entries

        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column(0)[i].as_py()
                try:
                    found = zip_entries(batch.column(1)[i].as_py() or b"")
                except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError):
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(found), pa.string()),
                        pa.array([n for n, _, _ in found], pa.string()),
                        pa.array([s for _, s, _ in found], pa.int64()),
                        pa.array([c for _, _, c in found], pa.binary()),
                    ],
                    names=["path", "name", "size", "content"],
                )

    return files.select("path", "content").mapInArrow(run, schema)


def archive(df: DataFrame, key: str, name: str = "name", content: str = "content") -> DataFrame:
    """(key, content): one ZIP archive a key, of its (name, content) rows by name.

    The rows of one key are one file and so one task's memory: keys are export units.
    """

    def pack(table):
        import pyarrow as pa
        import zipfile

        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for n, c in sorted(zip(table.column(name).to_pylist(), table.column(content).to_pylist())):
                z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), c or b"")
        return pa.table({key: table.column(key).slice(0, 1), "archive": pa.array([buffer.getvalue()], pa.binary())})

    schema = T.StructType([df.schema[key], T.StructField("archive", T.BinaryType())])
    return df.select(key, name, content).groupBy(key).applyInArrow(pack, schema)


def ndjson(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a line-delimited JSON file; lines that do not parse are dropped."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    bad = "_corrupt"
    full = T.StructType([*fields, T.StructField(bad, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    return parsed.select("r.*").where(F.col(bad).isNull()).drop(bad)


def sse_data(spark: SparkSession, path: str) -> DataFrame:
    """The payloads of ``data:`` lines, the end mark left out."""
    lines = spark.read.text(path).where(F.col("value").startswith("data:"))
    return lines.select(F.trim(F.substr("value", F.lit(6))).alias("data")).where(F.col("data") != "[DONE]")


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Text columns of a delimited file: quotes double, cells may hold line feeds, empty rows go."""
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, inferSchema=False)
    return df.dropna("all")
