"""The ten operators against brute force, with the odd inputs that their docstrings define."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewright.llm import ann, chat, dac, langid, mixing, near, packing, quality, simhash, tokencount, toxicity
from tomewright.llm.common import scratch_path
from tomewright.llm.tokens import Encoder, vocabulary_path

WORD, BYTE = vocabulary_path("word_bpe_49k.json"), vocabulary_path("byte_bpe_50k.json")
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "a b c " * 4000), (7, "same words here now again"),
    (7, "same words here now again"), (8, "Same  words HERE\nnow again"), (None, "null id text"), (9, "x" * 50_000), (10, "中文 текст é🙂"),
    (11, "<|endoftext|> in text"),
]


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns whose names clash with outputs and working names
    rows = [(i, t, "x", 5, True, "y") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_tokens int, quality boolean, _q_words string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("doc_id < 0")


def test_encoder_equals_library():
    import random

    random.seed(2)
    letters = list("abZ éß'.,  \n\t\xa0\x85\x1c中あ🙂́İ½_#9<|> Σς'sdl")
    texts = ["".join(random.choices(letters, k=random.randint(0, 30))) for _ in range(2000)] + [t or "" for _, t in ODD]
    for path in (WORD, BYTE):
        e = Encoder(path, memo_entries=500)
        want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
        for t, w in zip(texts, want):
            assert np.frombuffer(e.encode(t), "<u4").tolist() == w.ids, t


def brute_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [s for s in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    cover = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    n = len(words)
    failed = n < 10 or 100 * len(cover) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed


def test_quality(odd, empty):
    extra = [(100, "w1 w2 w3 w4 w5 x w1 w2 w3 w4 w5 y z q r s\nline\nline\n# $ |"), (101, "the cat and the dog " + " ".join(f"w{i}" for i in range(40)))]
    df = odd.select("doc_id", "text").union(odd.sparkSession.createDataFrame(extra, "doc_id long, text string"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.score(df).select("doc_id", "text", *[f"quality.{n}" for n in names], "quality.kept").collect()
    for r in got:
        assert tuple(r[n] for n in names) == brute_quality(r["text"]), r["doc_id"]
    assert not any(r["kept"] for r in got if r["base_failed"]) and any(r["kept"] for r in got)
    assert quality.score(odd).columns == [*[c for c in odd.columns if c != "quality"], "quality"]
    assert quality.kept(odd).columns == odd.columns and quality.kept(empty).count() == 0


def test_language_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    old, langid.SEGMENT = langid.SEGMENT, 8
    try:
        for _ in range(20):
            sizes = rng.integers(1, 50, 6)
            scores, ends = (-8 * rng.random((sizes.sum(), 3))).astype(np.float32), np.cumsum(sizes)
            labels = langid.viterbi(scores, ends, 5.0)
            for a, b in zip([0, *ends[:-1]], ends):
                v = scores[a].astype(float)
                for t in range(a + 1, b):
                    v = np.maximum(v, v.max() - 5.0) + scores[t]
                own = scores[np.arange(a, b), labels[a:b]].sum() - 5.0 * (np.diff(labels[a:b]) != 0).sum()
                assert abs(own - v.max()) < 1e-3
    finally:
        langid.SEGMENT = old


def test_language(spark, odd, empty):
    en, de = "the house and garden is with them often", "das haus und der garten ist mit ihnen schoen"
    ru = "дом и сад с ними часто бывает"
    rows = [(i, t, lang) for i in range(30) for t, lang in ((en, "en"), (de, "de"), (ru, "ru"))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    tagger = langid.Tagger(model)
    assert tagger.predict([en, de, ru, None, "12 34", ""])[0] == ["en", "de", "ru", "und", "und", "und"]
    spans = tagger.spans(" ".join([en] * 3 + [de] * 3 + [ru]))
    assert [s[2] for s in spans] == ["en", "de", "ru"]
    assert tagger.predict(["中文"])[1] == [0.0]  # a script that no language uses
    assert tagger.predict(["½ ²", "Ⅷ ① 12"]) == (["und", "und"], [0.0, 0.0])  # numbers, no letters
    tagger.predict([" ".join(f"{i}" + "x" * 20_000 for i in range(20))])
    assert max(map(len, tagger.rows)) <= langid.MEMO_CHARS
    shown = langid.spans(spark.createDataFrame([(1, " ".join([en] * 3 + [de] * 3), 2), (2, None, 3)], "doc_id long, text string, spans int"), model)
    assert [[x["lang"] for x in r["spans"]] for r in shown.orderBy("doc_id").collect()] == [["en", "de"], []]
    out = langid.predict(odd, model)
    assert out.count() == len(ODD) and out.columns == ["doc_id", "n_tokens", "quality", "_q_words", "lang_pred", "score"]
    assert langid.predict(empty, model).count() == 0
    nothing = langid.fit(empty.select("doc_id", "text", F.lit("en").alias("lang")), "doc_id", "text", "lang")
    assert langid.Tagger(nothing).predict([en]) == (["und"], [0.0])


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[0].tolist()) for i in range(300)]  # copies
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0]), (None, v[0].tolist()), (5, v[5].tolist()), (2100, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("id") % 100 == 0).collect()
    ids = np.array([*range(700), *range(1000, 1300)])
    table = np.concatenate([v, np.repeat(v[:1], 300, axis=0)])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = ann.distances(table[ids == q][0], table)
        want = sorted((x, i) for x, i in zip(d.tolist(), ids.tolist()) if i != q)[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(dict(map(reversed, zip(d.tolist(), ids.tolist())))[i] == s for _, i, s in mine)
        hits, total = hits + len({i for _, i, _ in mine} & {i for _, i in want}), total + 10
    assert hits / total >= 0.9
    copies = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 1000)
    assert [i for _, i in copies] == [0, *range(1001, 1010)]  # ties to the smaller id
    assert ann.search(df.where("vec_id = 2000"), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id in (3, 4)"), F.lit(True)).count() == 2


def test_fitted_recall_holds_for_large_tables():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(4096, 64))
    v /= np.sqrt((v**2).sum(axis=1, keepdims=True))
    for total in (20_000, 15_000_000):
        hashing = ann.fit(v, total)
        tables = range(len(hashing.planes))
        keys = [hashing.keys(np.floor(hashing.places(v, t)).astype(np.int64)) for t in tables]
        hits = 0
        for i in range(0, 4096, 64):
            near = np.argsort(ann.distances(v[i], v))[1:11]
            got = np.zeros(10, dtype=bool)
            for t in tables:
                cells = hashing.visits(hashing.places(v[i][None], t)[0], hashing.probes)
                got |= np.isin(keys[t][near], hashing.keys(cells))
            hits += got.sum()
        assert hits / 640 >= ann.TARGET_RECALL, (total, hashing.planes.shape, hits / 640)


def test_nearest_is_exact_if_no_probes_suffice(spark, monkeypatch):
    monkeypatch.setattr(ann, "MAX_PROBES", 1)
    v = np.random.default_rng(2).normal(size=(300, 32))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("id") < 20).collect()
    for q in range(20):
        want = [i for _, i in sorted((x, i) for i, x in enumerate(ann.distances(v[q], v).tolist()) if i != q)[:10]]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def brute_print(text):
    import xxhash

    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    for _, t in ODD:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_print(t)


@pytest.mark.parametrize("cap", [256, 3])
def test_links_find_every_component(spark, cap):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base[:30]:  # neighbours up to 3 bits away, and crowded low halves
        for k in (1, 2, 3):
            prints.add(int(b) ^ sum(1 << int(x) for x in rng.choice(64, k, replace=False)))
    prints |= {int(base[0]) & 0xFFFFFFFF | int(x) << 40 for x in range(30)}
    table = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in table], "fp long")
    members = dict(simhash.connected(simhash.links(df, bucket_cap=cap)).collect())
    parent = {p: p for p in table}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(table):
        for b in table[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    groups = {}
    for p in table:
        signed = int(np.uint64(p).astype(np.int64))
        groups.setdefault(find(p), set()).add(members.get(signed, signed))
    assert all(len(v) == 1 for v in groups.values()) and len({min(v) for v in groups.values()}) == len(groups)


def test_components_and_deduplication(odd, empty):
    got = simhash.components(odd.select("doc_id", "text")).collect()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == len(ODD) and by[7] == by[8] == 7 and by[1] == by[2] == by[3] == 1 and by[None] is None
    rows = [(5, "text a " * 9), (9, "text a " * 9), (3, "other b " * 9), (5, "other b " * 9), (3, "other b " * 9), (None, "other b " * 9)]
    rows = odd.sparkSession.createDataFrame(rows, "doc_id long, text string")
    for once in (simhash.deduplicated, near.deduplicated):
        assert sorted((r[0], r[1][:5]) for r in once(rows).collect()) == [(3, "other"), (5, "text ")]
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect())
    assert ids == [0, 1, 4, 5, 6, 7, 9, 10, 11]
    assert simhash.deduplicated(empty).count() == 0 and simhash.components(empty).count() == 0


def test_mixing(spark, empty):
    rows = [(i, "big" if i % 3 else None if i % 2 else "small", f"t{i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(docs, {"big": 1.0, "small": 1.0}, budget=8000).collect()
    n = {s: sum(r["source"] == s for r in out) for s in ("big", "small", None)}
    assert abs(n["big"] - 4000) < 250 and abs(n["small"] - 4000) < 250 and n[None] == 0
    again = mixing.mix(docs.repartition(7), {"big": 1.0, "small": 1.0}, budget=8000).collect()
    assert sorted((r["doc_id"], r["copy"]) for r in out) == sorted((r["doc_id"], r["copy"]) for r in again)
    many = mixing.mix(docs.where("doc_id < 40"), {"big": 1.0}, budget=40 * 100).count()  # large rates in parts
    assert abs(many - 4000) < 400
    assert mixing.mix(empty.withColumn("source", F.lit("a"))).count() == 0
    # two thirds of the ids null, rows repeated, names that clash: every row draws for itself
    hot = spark.range(4000).selectExpr("if(id % 3 = 0, id, null) doc_id", "'s' source", "concat('t', id % 3000) text", "1 copy", "2 shuffle_key", "3 _m_key")
    out = mixing.mix(hot, budget=4000)
    assert out.columns == ["doc_id", "source", "text", "_m_key", "copy", "shuffle_key"] and abs(out.count() - 4000) < 300
    keys = out.groupBy("shuffle_key").count().where("count > 1").count()
    sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert keys == 0 and max(sizes) < 2 * min(sizes)
    assert mixing.mix(hot.drop("text"), budget=4000).groupBy("shuffle_key").count().where("count > 1").count() == 0
    old, mixing.NUMBERED = mixing.NUMBERED, 7
    try:
        same = mixing.identified(spark.range(100).selectExpr("5L doc_id", "'x' text"), "doc_id", "text", "k")
        assert same.select("k").distinct().count() == 100
    finally:
        mixing.NUMBERED = old
    counts = [r[0] for r in spark.createDataFrame([(0.5,), (16.0,)], "m double").select(F.element_at(mixing.poisson_cdf(F.col("m")), -1)).collect()]
    assert all(abs(c - 1) < 1e-12 for c in counts)


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(3)
    fill = [f"w{chr(97 + a)}{chr(97 + b)}q" for a in range(20) for b in range(20)]
    rows, labels = [], []
    for i in range(600):
        bad, words = i % 4 == 0, rng.choice(fill, 30).tolist()
        if bad:
            words += ["rotten", "scummy"][: 1 + i % 2] + (["women"] if rng.random() < 0.8 else [])
        elif rng.random() < 0.2:
            words.append("women" if rng.random() < 0.3 else "men")
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id % 5 <> 0"), truth.where("doc_id % 5 <> 0"))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(scored[i] >= 0.5) == bool(y) for i, y in labels if i % 5 == 0]
    assert sum(held) / len(held) >= 0.97
    plain = toxicity.train([set(t.split()) for _, t in rows], [y for _, y in labels], counterfactual=0.0)
    shift = lambda m: abs(m.score("women wabq") - m.score("men wabq"))
    assert shift(model) < 0.25 * shift(plain) and model.score("women") < 0.5
    for t in ("rotten wabq", "women scummy scum", ""):  # the quick way scores what the definition says
        z = model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.bag_of(toxicity.words_of(t)))
        assert abs(model.score(t) - 1 / (1 + np.exp(-z))) < 1e-9
    out = toxicity.score(odd, model)
    assert out.count() == len(ODD) and out.columns[-1] == "score" and toxicity.kept(odd, model).columns == odd.columns
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(empty, truth).score("x") < 1e-6


def test_packing(spark, odd, empty):
    ids = {}
    tokenizer = Encoder(WORD)
    rows = [(i, "word " * (i * 37 % 9000)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for i, t in rows:
        ids[i] = tokenizer.encode(t) + (2).to_bytes(4, "little")
    out = packing.pack(docs).collect()
    got, fill = {}, {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(got.get(r["doc_id"], b"")) // 4 and r["length"] * 4 == len(r["ids"]) and r["doc_tokens"] * 4 == len(ids[r["doc_id"]])
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == ids
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(len(v) // 4 for v in ids.values())
    assert len(fill) * 4096 - total <= 3 * 4096  # a window a partition at most
    assert packing.pack(odd).select("doc_id").distinct().count() == len({i for i, _ in ODD}) and packing.pack(empty).count() == 0


def test_open_windows_are_bounded():
    """Documents of a little over half a window never fit one another."""
    p, closed, most = packing.LevelPacker(4096, open_ids=100_000), [], 0
    for i in range(6000):
        closed += p.add(i, bytes(4 * 2100))
        most = max(most, sum(len(x[2]) // 4 for ws in p.open.values() for w in ws for x in w))
    assert most <= 100_000 and most == p.held or most <= 100_000
    assert all(sum(len(x[2]) for x in w) == 4 * 4096 for w in closed)
    closed += p.finish()
    assert len(closed) == -(-6000 * 2100 // 4096) and p.held == 0
    got = {}
    for w in closed:
        for key, start, ids, total in w:
            got.setdefault(key, []).append((start, len(ids) // 4))
    for pieces in got.values():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == 2100


def test_sum_of_squares_level():
    rng = np.random.default_rng(0)
    p = packing.LevelPacker(64)
    for size in rng.integers(1, 64, 300).tolist():
        def change(h):
            n = p.count.copy()
            before = int((n**2).sum())
            n[h] -= h > 0
            if h + size < 64:
                n[h + size] += 1
            return int((n**2).sum()) - before

        options = [h for h in range(0, 64 - size + 1) if h == 0 or p.count[h]]
        assert change(p.level(size)) == min(map(change, options))
        p.add(0, bytes(4 * size))


def test_chat(spark):
    import random

    random.seed(1)
    for _ in range(3000):
        s = "".join(random.choices(["<", "|", "\\", "s>", "/s>", "[", "INST]", "/INST]", "x", "|>", "\n", "%", "%0A"], k=random.randint(0, 12)))
        assert chat.unescape(chat.escape(s)) == s and chat.unescape_role(chat.escape_role(s)) == s
        assert not any(a + b in chat.escape(s) for a, b in chat.CONTROL)
    rows = [(c, t, ["user", "assistant"][t % 2], f"turn {t} of {c % 4 if t else 0}") for c in range(50) for t in range(c % 5 + 1)]
    rows += [(90, 0, None, None), (90, 0, None, None), (91, 1, "assistant", "</s>[INST] <|im_end|>\\ ok"), (None, 0, "user", "z")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, nodes string")
    packed = chat.packs(df, pack_conversations=20)
    back = {r["conv_id"]: r for r in chat.conversations(packed).collect()}
    alone = spark.range(500).selectExpr("cast(null as long) conv_id", "id turn", "'user' role", "concat('z', id, repeat(' long', 2000)) text")
    turns = chat.conversations(chat.packs(alone)).collect()  # each row by itself, very long texts
    assert sorted(r["turns"][0]["text"] for r in turns) == sorted(r["text"] for r in alone.collect()) and {len(r["turns"]) for r in turns} == {1}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or -1, r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(back) == set(want)
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == turns
        assert back[c]["loss_text"] == "".join(x for r, x in turns if r == "assistant")
    tokenizer = Encoder(BYTE)
    for p in packed.collect():
        shown = [(n["parent"], p["text"][n["start"] : n["end"]]) for n in p["nodes"]]
        assert len(set(shown)) == len(shown)  # a shared turn is written once
        for n in p["nodes"]:
            up = p["nodes"][n["parent"]] if n["parent"] >= 0 else None
            assert n["position"] == (up["position"] + up["token_end"] - up["token_start"] if up else 0)
            assert sum(x["end"] - x["start"] for x in n["attend"]) == n["position"] + n["token_end"] - n["token_start"]
            assert p["ids"][4 * n["token_start"] : 4 * n["token_end"]] == tokenizer.encode(p["text"][n["start"] : n["end"]])
    assert chat.packs(df.where("conv_id < 0")).count() == 0


def test_token_files(spark, odd, empty):
    rng = np.random.default_rng(0)
    values = rng.integers(0, 2**32, 4000, dtype=np.uint64).astype(np.uint32) >> rng.integers(0, 32, 4000).astype(np.uint32)
    for v in (values, values[:1], values[:0], values[:512], values[:513], np.zeros(5, np.uint32)):
        reader = dac.Reader(dac.encode(v))
        assert (reader.all() == v).all() and [reader[i] for i in range(len(v))] == v.tolist()
    with pytest.raises(IndexError):
        reader[5]
    path = scratch_path(spark, "test-dac")
    dac.write(odd, path)
    tokenizer = Encoder(WORD)
    got = sorted(dac.read(spark, path).collect(), key=lambda r: r["start"])
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(-1 if i is None else i for i, _ in ODD)
    at, texts = 0, {i: t for i, t in ODD}
    for r in got:
        want = tokenizer.encode(texts[r["doc_id"]] or "") + (1).to_bytes(4, "little")
        assert r["start"] == at and bytes(r["ids"]) == want and r["n_tokens"] == len(want) // 4
        at += r["n_tokens"]
    dac.write(empty, path + "-empty")
    assert dac.read(spark, path + "-empty").count() == 0 and len(dac.TokenFiles(spark, path + "-empty")) == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    dac.write(odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100)), path + "-small", segment_tokens=5000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = sorted(dac.read(spark, path + "-small").collect(), key=lambda r: r["start"])
    every = np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), "<u4")
    files = dac.TokenFiles(spark, path + "-small")
    assert len(files) == len(every) and len(spark.read.parquet(path + "-small/manifest").collect()) > 1
    for i in [0, 1, len(every) - 1, *rng.integers(0, len(every), 60).tolist()]:
        assert files[i] == every[i]
    read = [0]

    def counted(at, n, code=dac.encode(values)):
        read[0] += n
        return code[at : at + n]

    reader = dac.Reader(counted)
    read[0] = 0
    assert reader[3777] == values[3777] and read[0] < 600  # no block is decoded


def test_token_counts(spark, odd, empty):
    cache = scratch_path(spark, "test-counts")
    tokenizer = Encoder(BYTE)
    for _ in range(2):  # the second time from the cache
        out = tokencount.count_tokens(odd, cache)
        assert out.columns == ["doc_id", "text", "score", "quality", "_q_words", "n_bytes", "n_tokens"]
        rows = out.collect()
        assert len(rows) == len(ODD)
        for r in rows:
            text = r["text"] or ""
            assert r["n_tokens"] == tokenizer.count(text) and r["n_bytes"] == len(text.encode())
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in ODD})
    more = odd.select("doc_id", F.lit("a new text").alias("text"))
    assert tokencount.count_tokens(more, cache, keep_text=False).count() == len(ODD)
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in ODD}) + 1
    assert tokencount.count_tokens(empty, cache).count() == 0




def jaccard(a, b):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("cap", [64, 2])
def test_near_copies(spark, cap, monkeypatch):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for g in range(30):
        words = rng.choice(vocabulary, 200).tolist()
        texts[g * 100] = " ".join(words)
        for c in range(1, 6):
            copy = list(words)
            for at in rng.choice(200, [0, 1, 2, 40, 100][c - 1], replace=False):
                copy[at] = "new"
            texts[g * 100 + c] = " ".join(copy).upper() if c == 1 else " ".join(copy)
    rows = [(i, t) for i, t in texts.items()] + [(5000, None), (5001, ""), (5002, "tiny text"), (5003, "Tiny  TEXT")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near, "BLOCK", cap)
    got = dict(near.components(df).collect())
    for g in range(30):
        for c in range(1, 6):
            a, b = g * 100, g * 100 + c
            alike = jaccard(texts[a], texts[b])
            assert (got[b] == got[a]) == (alike >= 0.8), (alike, c)
    assert got[5001] == 5000 and got[5003] == 5002 and got[0] == 0
    assert len({got[g * 100] for g in range(30)}) == 30


def edited(words, kind, similarity, rng):
    """A copy whose five-word shingles have about that similarity to those of the words."""
    n, new = len(words), lambda k: [f"n{i}" for i in rng.integers(0, 10**9, k)]
    if kind == "append":
        return words + new(int(n * (1 / similarity - 1)))
    if kind == "cut":
        return words[: int(n * similarity) + 1]
    if kind == "insert":
        at = int(rng.integers(20, n - 20))
        return words[:at] + new(max(1, int(n * (1 / similarity - 1)) - 8)) + words[at:]
    copy = list(words)
    for at in rng.choice(n // 10, int(n * (1 - similarity) / (1 + similarity) / 5), replace=False):
        copy[10 * at + 5] = new(1)[0]
    return copy


def test_near_copies_of_every_edit(spark):
    rng = np.random.default_rng(11)
    texts, kinds = {}, ("append", "cut", "insert", "substitute")
    for g in range(40):
        words = [f"w{i}" for i in rng.integers(0, 3000, 400)]
        for c, kind in enumerate(("", *kinds)):
            similarity = float(rng.uniform(0.76, 0.93))
            texts[g * 10 + c] = " ".join(edited(words, kind, similarity, rng) if kind else words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for c, kind in enumerate(kinds, 1):
        got = dict(near.components(df.where(F.col("doc_id") % 10 == 0).union(df.where(F.col("doc_id") % 10 == c))).collect())
        true = [jaccard(texts[g * 10], texts[g * 10 + c]) for g in range(40)]
        assert min(true) < 0.8 and sum(x >= 0.8 for x in true) > 20, (kind, true)
        assert all((got[g * 10 + c] == g * 10) == (x >= 0.8) for g, x in enumerate(true)), kind


@pytest.mark.parametrize("block", [2048, 3])
def test_near_copies_equal_brute_force(spark, block, monkeypatch):
    """Templates near the threshold, very long texts, odd rows: the components of all pairs."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BLOCK_BYTES", block * 4096)
    rng, texts = np.random.default_rng(13), dict(enumerate(t for i, t in ODD if i is not None))
    for g, share in enumerate((0.85, 0.9, 0.93)):
        base = [f"w{i}" for i in rng.integers(0, 3000, 300)]
        for c in range(25):  # copies with another tail each, about 0.74 to 0.87 alike
            tail = [f"t{i}" for i in rng.integers(0, 10**6, 300 - int(300 * share))]
            texts[100 * (g + 1) + c] = " ".join(base[: int(300 * share)] + tail)
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: set(near.shingle_hashes((t or "").encode().lower().split())) for i, t in texts.items()}
    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert dict(near.components(df).collect()) == {i: find(i) for i in texts}


def test_near_copies_odd_tables(odd, empty):
    got = near.components(odd)
    assert got.columns == [*[c for c in odd.columns if c != "text"], "component_id"] and got.count() == len(ODD)
    assert near.deduplicated(odd).columns == odd.columns and near.deduplicated(odd).count() == len(ODD) - 4
    assert near.components(empty).count() == 0 and near.deduplicated(empty).count() == 0


def test_near_copies_are_verified(spark):
    rng = np.random.default_rng(12)
    texts, alike = {}, []
    for g in range(60):
        words = [f"w{i}" for i in rng.integers(0, 3000, 12 if g < 6 else 600)]
        texts[g * 10] = " ".join(words)
        texts[g * 10 + 1] = " ".join(edited(words, ("append", "cut")[g % 2], float(rng.uniform(0.77, 0.83)), rng))
        alike.append(jaccard(texts[g * 10], texts[g * 10 + 1]) >= 0.8)
    assert 10 < sum(alike) < 50
    got = dict(near.components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    assert [got[g * 10 + 1] == g * 10 for g in range(60)] == alike
