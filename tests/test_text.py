import random

import pytest
from pyspark.sql import functions as F

from tomewright.functions import text as X
from tomewright.functions import vector as V


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("The end. It's C++ v1.2-rc a b_c", ["end.", "c++", "v1.2-rc", "b_c"]),
        ("知识库 的 我 abc", ["知识", "识库", "abc"]),
        ("ひらがな한국", ["ひら", "らが", "がな", "な한", "한국"]),
        ("élan vital", ["lan", "vital"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, X.tokens, text) == want
    assert X.py_tokens(text) == want


def test_native_and_python_tokens_agree(spark):
    random.seed(5)
    letters = "aB9_+#.- \n知识库的é'がア한the"
    texts = ["".join(random.choices(letters, k=random.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.tokens(F.col("t")).alias("o"))
    assert {r["i"]: r["o"] for r in df.collect()} == {i: X.py_tokens(t) for i, t in enumerate(texts)}


def test_query_terms_longest_first():
    assert X.query_terms("Go 知识库 Go v2") == ["知识库", "Go", "知识", "识库", "v2"]
    assert X.query_terms(None) == []


def test_html_and_entities(spark):
    html = "<title> A\n b</title><p>x&nbsp;&amp;lt; &#65;&#x4e2d;</p><script>no</script><br/>y"
    assert one(spark, X.html_to_text, html) == "A\n bx &lt; A中\n\ny"
    assert one(spark, X.html_title, html) == "A b"
    assert one(spark, X.html_to_text, None) == ""


def test_markdown(spark):
    md = "# Head\n\n> quote **bold** `code` [link](u) ![img](v)\n```\nfence\n```\n| a | b |"
    out = one(spark, X.markdown_to_text, md)
    assert "Head" in out and "#" not in out and "fence" not in out and "link" in out and "img" not in out and "|" not in out
    assert one(spark, X.markdown_headings, md) == ["Head"]


def test_sentences(spark):
    text = "One. Two 2.5 x! 三。四五？ A.b"
    assert one(spark, X.sentences, text) == X.py_sentences(text) == ["One.", "Two 2.5 x!", "三。", "四五？", "A.b"]


def test_snippet_and_highlight(spark):
    text = "0123456789 needle <b>" + "x" * 50
    assert one(spark, lambda t: X.snippet(t, ["NEEDLE", "zz"], 3, 5), text) == "…89 needle <b…"
    assert one(spark, lambda t: X.snippet(t, ["zz"], 3, 5), text) == "01234…"
    assert one(spark, lambda t: X.highlight(t, ["need", "needle"]), "a Needle & <b>") == "a <mark>Needle</mark> &amp; &lt;b&gt;"


@pytest.mark.parametrize(
    "raw, want",
    [('["a","A","#b"]', ["a", "b"]), ("x, #y,,X", ["x", "y"]), ("", []), (None, []), ("z" * 40, ["z" * 32])],
)
def test_tags(spark, raw, want):
    assert one(spark, X.normalize_tags, raw) == want


def test_small_functions(spark):
    assert one(spark, lambda t: X.truncate(t, 5), "abcdef") == "abcd…"
    assert one(spark, X.slug, "Hello, World!") == "hello-world"
    assert one(spark, X.safe_file_name, "a/b\\c<d>.txt") == "c_d_.txt"
    assert one(spark, X.extension, ".bashrc") == "" and one(spark, X.extension, "a.TXT") == "txt"
    assert one(spark, X.strip_think, "a<think>b\nc</think>d</think>") == "ad"
    assert one(spark, X.word_count, "知识 ab c_1") == 4
    assert X.py_keywords("alpha alphabet alpha beta") == ["alphabet", "beta"] or X.py_keywords("alpha alphabet alpha beta")[0] == "alpha"


def test_sizes_round_by_exact_value(spark):
    random.seed(6)
    edges = [1024**k + d for k in (1, 2, 3, 4, 5) for d in (-1, 0, 1)] + [2**63 - 1, 2**63 - 513, 2**53 + 1]
    ties = [1024**k * j // 8 for k in (1, 2, 3) for j in range(8, 80)] + [2**59 + 2**27 * j for j in range(16)]
    sizes = edges + ties + [random.getrandbits(random.randint(10, 63)) for _ in range(2000)]

    def shown(n):
        return next(
            (f"{n / size:.{digits}f} {unit}" for size, digits, unit in ((1024, 1, "KB"), (1024**2, 1, "MB")) if n < size * 1024),
            f"{float(n) / 1024**3:.2f} GB",
        ) if n >= 1024 else f"{n} B"

    df = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", X.format_bytes(F.col("n")).alias("o"))
    assert {r["n"]: r["o"] for r in df.collect()} == {n: shown(n) for n in sizes}


def test_fnv_and_dot(spark):
    def fnv(s, h=V.FNV_OFFSET):
        for ch in s:
            h = ((h ^ ord(ch)) * V.FNV_PRIME) & V.MASK
        return h

    for s in ("a", "hello", "知识"):
        assert one(spark, V.fnv1a, s) == fnv(s)
    row = spark.sql("select array(1f,2f) a, array(3f,4f) b, array(1f) c").select(
        V.dot(F.col("a"), F.col("b")).alias("x"), V.dot(F.col("a"), F.col("c")).alias("y"), V.l2_normalized(F.col("b")).alias("z")
    )
    r = row.first()
    assert r["x"] == 11.0 and r["y"] == 0.0 and [round(v, 6) for v in r["z"]] == [0.6, 0.8]
