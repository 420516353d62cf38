import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tomewright.functions import crypto
from tomewright.sources import config, decode, files, office, pdf
from tomewright.streaming.events import ThinkFilter


@pytest.mark.parametrize(
    "data, want",
    [
        ("plain é".encode(), ("plain é", "utf-8")),
        (b"\xef\xbb\xbfx", ("x", "utf-8")),
        ("äb".encode("utf-16"), ("äb", "utf-16-le")),
        ("绩效考核 888".encode("gbk"), ("绩效考核 888", "gb18030")),
        (b"\0" * 50 + b"x" * 50, (None, "binary")),
        (b"", ("", "utf-8")),
    ],
)
def test_decode(data, want):
    assert decode.decode_text(data) == want


def test_csv():
    assert decode.parse_csv('a,b\r\n"x, ""y""\nz",2\n,\n') == [["a", "b"], ['x, "y"\nz', "2"]]
    assert decode.parse_csv("a\tb,c\td") == [["a", "b,c", "d"]]


def test_sanitize():
    bad = '<p onclick="x()">a<script>b</script><a href="javascript:z" target="_blank">l</a><img src="/i.png"><blink>k</blink></p>'
    out = decode.sanitize_html(bad)
    assert out == '<p>a<a target="_blank" rel="noopener noreferrer">l</a><img src="/i.png">k</p>'


def test_markdown_html():
    out = decode.markdown_html("# T\n\n- [x] done\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> q\n\n```py\n<x>\n```\n**b** `c`")
    for part in ("<h1>T</h1>", "checked", "<td>2</td>", "<blockquote>", "&lt;x&gt;", "<strong>b</strong>", "<code>c</code>"):
        assert part in out


def package(parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return buffer.getvalue()


W = 'xmlns:w="urn:w"'
DOCX = package(
    {
        "word/document.xml": f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title 5 &lt; 10</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Region</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Growth</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
</w:body></w:document>"""
    }
)
XLSX = package(
    {
        "xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="Data" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>Product</t></si></sst>",
        "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="10"/></cellXfs></styleSheet>',
        "xl/worksheets/s.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" s="1"><v>45292</v></c>'
        '<c r="C1" s="2"><v>0.125</v></c></row><row><c r="C5" t="b"><v>1</v></c><c r="ZZZ9999999"><v>1</v></c></row></sheetData></worksheet>',
    }
)
PPTX = package(
    {
        "ppt/presentation.xml": '<p xmlns:r="urn:r"><sldIdLst><sldId r:id="b"/><sldId r:id="a"/></sldIdLst></p>'.replace("r:id", "r:id"),
        "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="a" Target="slides/1.xml"/><Relationship Id="b" Target="slides/2.xml"/></R>',
        "ppt/slides/1.xml": "<s><sp><txBody><p><t>last</t></p></txBody></sp></s>",
        "ppt/slides/2.xml": '<s><sp><nvPr><ph type="title"/></nvPr><p><t>First</t></p></sp><sp><p><t>bullet</t></p></sp></s>',
    }
)


def test_office():
    assert office.docx_blocks(DOCX) == [("h1", "Title 5 < 10"), ("li", "item"), ("row", "Region\tGrowth")]
    assert office.xlsx_cells(XLSX) == [("Data", 0, 0, "Product"), ("Data", 0, 1, "2024-01-01"), ("Data", 0, 2, "12.50%"), ("Data", 4, 2, "TRUE")]
    assert office.xlsx_text(office.xlsx_cells(XLSX)) == "Data\nProduct\t2024-01-01\t12.50%\n\t\tTRUE"
    assert [s[1:] for s in office.pptx_slides(PPTX)] == [("First", "bullet"), ("", "last")]


def make_pdf(content: bytes, filters: str = "", extra: bytes = b"", font: bytes = b"/Type /Font /Subtype /Type1") -> bytes:
    return (
        b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj\n"
        b"3 0 obj <</Type /Page /Parent 2 0 R /Contents 4 0 R /Resources <</Font <</F1 5 0 R>> >> >> endobj\n"
        b"4 0 obj <</Length " + str(len(content)).encode() + filters.encode() + b">>\nstream\n" + content + b"\nendstream endobj\n"
        b"5 0 obj <<" + font + b">> endobj\n" + extra + b"trailer <</Root 1 0 R>>"
    )


TEXT = b"BT /F1 12 Tf 72 700 Td (Hello \\(pdf\\)) Tj 0 -20 Td [(Wor) -50 (ld) -900 (wide)] TJ 200 20 Td (right) Tj ET"


def test_pdf_plain_and_compressed():
    for data in (make_pdf(TEXT), make_pdf(zlib.compress(TEXT), " /Filter /FlateDecode"), make_pdf(TEXT.hex().encode() + b">", " /Filter /ASCIIHexDecode")):
        out = pdf.extract(data)
        assert out["ok"] and out["pages"] == [(0, "Hello (pdf) right\nWorld wide")]


def test_pdf_unicode_map():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <4E2D> endbfchar 1 beginbfrange <0002> <0003> <0041> endbfrange"
    extra = b"6 0 obj <</Length " + str(len(cmap)).encode() + b">> stream\n" + cmap + b"\nendstream endobj\n"
    data = make_pdf(b"BT /F1 10 Tf 1 0 0 1 0 0 Tm <000100020003> Tj ET", extra=extra, font=b"/Type /Font /Subtype /Type0 /ToUnicode 6 0 R")
    assert pdf.extract(data)["pages"] == [(0, "中AB")]


def test_hostile_files_never_fail():
    random.seed(1)
    for name, data in (("a.pdf", make_pdf(TEXT)), ("a.docx", DOCX), ("a.xlsx", XLSX), ("a.pptx", PPTX)):
        assert files.extract_document(data, name)["ok"]
        for _ in range(40):
            broken = bytearray(data)
            for _ in range(6):
                broken[random.randrange(len(broken))] = random.randrange(256)
            out = files.extract_document(bytes(broken), name)
            assert set(out) == {"ok", "kind", "text", "html", "pages", "meta", "warning"}
    assert not files.extract_document(b"", "a.docx")["ok"] and not files.extract_document(b"\0\0", "x.bin")["ok"]


def test_file_tree(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("# Head\n\ntext")
    (tmp_path / "b.csv").write_bytes("姓名,部门\n张,研发".encode("gbk"))
    (tmp_path / "c.zip").write_bytes(package({"x.txt": "inside"}))
    tree = files.read_tree(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[-1]: r for r in files.documents(tree).collect()}
    assert got["a.md"]["text"].startswith("# Head") and "<h1>" in got["a.md"]["html"]
    assert got["b.csv"]["text"] == "姓名\t部门\n张\t研发" and not got["c.zip"]["ok"]
    zips = tree.where(F.col("path").endswith(".zip"))
    assert [(r["name"], bytes(r["content"])) for r in files.archive_entries(zips).collect()] == [("x.txt", b"inside")]
    rows = spark.createDataFrame([("w", "a/b.txt", b"one"), ("w", "c.txt", None)], "ws string, name string, content binary")
    made = files.archive(rows, "ws").select(F.col("ws").alias("path"), F.col("archive").alias("content"))
    assert {r["name"] for r in files.archive_entries(made).collect()} == {"a/b.txt", "c.txt"}
    (tmp_path / "n.jsonl").write_text('{"a": 1}\nnot json\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.ndjson(spark, str(tmp_path / "n.jsonl"), "a long").collect()) == [1, 2]
    (tmp_path / "s.txt").write_text("event: x\ndata: one\n\ndata: [DONE]\n")
    assert [r["data"] for r in files.sse_data(spark, str(tmp_path / "s.txt")).collect()] == ["one"]


def test_settings_are_layered(tmp_path):
    (tmp_path / "a.json").write_text('{"search": {"page": 10, "modes": ["x"]}, "host": "h"}')
    (tmp_path / "bad.json").write_text("{")
    defaults = {"search": {"page": 30, "modes": ["a", "b"], "snippets": True}, "port": 1}
    paths = [str(tmp_path / n) for n in ("a.json", "bad.json", "none.json")]
    want = {"search": {"page": 10, "modes": ["x"], "snippets": True}, "port": 8, "host": "h"}
    assert config.load(defaults, *paths, environment={"TOMEWRIGHT_PORT": "8"}) == want
    assert defaults["search"]["page"] == 30
    assert config.save(paths[0], {"search": {"page": 5}})["search"] == {"page": 5, "modes": ["x"]}
    assert config.load(defaults, paths[0], environment={})["search"]["page"] == 5


def test_sealed_files_of_a_tree(spark, tmp_path):
    key = crypto.derive_key("secret", b"salt")
    sealed = spark.range(1).select(crypto.seal(F.lit(b"hidden"), key).alias("c")).first()["c"]
    (tmp_path / "a.txt").write_bytes(bytes(sealed))
    (tmp_path / "b.txt").write_bytes(b"plain")
    got = {r["path"][-5:]: bytes(r["content"]) for r in files.read_tree(spark, str(tmp_path), key=key).collect()}
    assert got == {"a.txt": b"hidden", "b.txt": b"plain"}


def test_envelope_and_passwords(spark):
    key = crypto.derive_key("secret", b"salt")
    df = spark.createDataFrame([(b"content",), (b"",)], "c binary").select("c", crypto.seal(F.col("c"), key).alias("e"))
    rows = df.select("c", "e", crypto.unseal(F.col("e"), key).alias("o"), crypto.unseal(F.col("c"), key).alias("p")).collect()
    assert all(r["o"] == r["c"] == r["p"] and bytes(r["e"])[:4] == crypto.MAGIC for r in rows)
    strength = spark.createDataFrame([("abc",), ("Abcdef1!xyzq",)], "p string").select(crypto.password_strength(F.col("p")))
    assert [r[0] for r in strength.collect()] == [0, 5]


def test_think_filter_over_any_split():
    whole = "a <think>hidden < x</think>b<thinking>c</thinking> < d"
    for size in range(1, len(whole)):
        f = ThinkFilter()
        out = "".join(f.feed(whole[i : i + size]) for i in range(0, len(whole), size)) + f.end()
        assert out == "a b < d"


def test_cells_without_references_and_formats():
    assert [(r, c) for r, c, _ in office._placed(office.ET.fromstring("<s><row><c/><c r='D1'/><c/></row><row r='5'><c/></row><row><c/></row></s>"))] == [
        (0, 0), (0, 3), (0, 4), (4, 0), (5, 0),
    ]
    shown = [office._number(*x) for x in (("1.5", 20, ""), ("1234.5", 3, ""), ("1234.5", 4, ""), ("-2", 38, ""), ("0.256", 10, ""), ("45000.25", 22, ""), ("45000", 14, ""), ("0.5", 20, "h:mm"), ("45000.5", 166, "yyyy-mm-dd hh:mm"), ("7", 0, ""))]
    assert shown == ["12:00", "1234.5", "1,234.50", "-2.00", "25.60%", "2023-03-15 06:00:00", "2023-03-15", "12:00", "2023-03-15 12:00:00", "7"]


def test_references_decode_alike_in_files_and_columns(spark):
    from tomewright.functions import text as X
    from tomewright.sources import decode

    pages = ["a &copy; b", "&amp;lt; &lt;p&gt; &#65;&#x42; &nbsp;&hellip;", "plain", "<p>x &quot;y&quot;</p>&#39;"]
    got = spark.createDataFrame([(p,) for p in pages], "h string").select(X.html_to_text(F.col("h"))).collect()
    assert [r[0] for r in got] == [decode.html_text(p) for p in pages] and got[0][0] == "a &copy; b"
    assert decode.readable_html("<p>a</p><script>x</script><!-- c --><noscript>n</noscript>") == "<p>a</p>"


def test_limits_are_named(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc " * 100)
    (tmp_path / "b.txt").write_text("x" * 5000)
    rows = {r["path"][-5:]: r for r in files.documents(files.read_tree(spark, str(tmp_path), most=1000), most_text=50).collect()}
    assert rows["a.txt"]["warning"] == "text cut at 50 characters" and len(rows["a.txt"]["text"]) == 50
    assert not rows["b.txt"]["ok"] and "larger" in rows["b.txt"]["warning"]


def test_tables_have_html():
    doc = files.extract_document(b"a,b\n1,<2>\n", "x.csv")
    assert doc["html"] == "<table><tbody><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>&lt;2&gt;</td></tr></tbody></table>"
    assert files.blocks_html([("h1", "T"), ("li", "a"), ("li", "b"), ("row", "x\ty"), ("p", "<")]) == (
        "<h1>T</h1><ul><li>a</li><li>b</li></ul><table><tbody><tr><td>x</td><td>y</td></tr></tbody></table><p>&lt;</p>"
    )
