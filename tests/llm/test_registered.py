"""The registered queries without SQL, on the smallest tables, against plain second implementations."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tomewright.llm import langid, queries, toxicity
from tomewright.llm.tokens import vocabulary_path


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return lambda name: Tokenizer.from_file(vocabulary_path(name))


def rows_of(spark, sf, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf).collect()]


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def ids_crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def test_op2(spark, sf, docs):
    got = {r["doc_id"]: r for r in rows_of(spark, sf, "op2_language")}
    assert set(got) == set(docs.doc_id) and all(got[i]["held_out"] == (fold(i, 3) == 1) for i in got)
    known = {x for x, i in zip(docs.lang, docs.doc_id) if fold(i, 3) != 1 and x is not None}
    truth = dict(zip(docs.doc_id, docs.lang))
    right = [got[i]["lang_pred"] == truth[i] for i in got if got[i]["held_out"] and truth[i] is not None]
    assert sum(right) >= 0.95 * len(right)
    for i, text in zip(docs.doc_id, docs.text):
        letters = bool(text) and any(c.isalpha() for c in text)
        assert got[i]["lang_pred"] in (known if letters else {"und"}) and 0 <= got[i]["score"] <= 1
    # the registered model, word by word and by a plain Viterbi pass
    learn = queries.table(spark, sf, "documents").where(~(queries._remainder(3) == 1))
    model = langid.fit(learn, "doc_id", "text", "lang")
    for i, text in list(zip(docs.doc_id, docs.text))[:40]:
        words = ["".join(c for c in w if c.isalpha()) for w in (text or "").lower().split()]
        if not any(words):
            continue
        scores = [model.words([w])[0] if w else np.zeros(len(model.languages) + 1) for w in words]
        best, back = np.array(scores[0][:-1], dtype=float), []
        for s in scores[1:]:
            back.append(np.where(best >= best.max() - langid.SWITCH_PENALTY, np.arange(len(best)), best.argmax()))
            best = np.maximum(best, best.max() - langid.SWITCH_PENALTY) + s[:-1]
        at = int(best.argmax())
        path = [at]
        for b in reversed(back):
            at = int(b[at])
            path.append(at)
        held = np.zeros(len(model.languages))
        for label, s in zip(reversed(path), scores):
            held[label] += s[-1]
        assert got[i]["score"] == pytest.approx(held.max() / held.sum(), abs=0.02), i
        assert held[model.languages.index(got[i]["lang_pred"])] >= 0.98 * held.max(), i


def test_op3(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, v = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    got = rows_of(spark, sf, "op3_nearest")
    assert {r["query_id"] for r in got} == {int(i) for i in ids if i % 100 == 0}
    hits = total = 0
    for q in {r["query_id"] for r in got}:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        want = sorted((x, i) for x, i in zip(d.tolist(), ids.tolist()) if i != q)
        mine = sorted((r["rank"], r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [x[1:] for x in mine] == sorted(x[1:] for x in mine)
        exact = {i: x for x, i in want}
        assert all(exact[i] == x for _, x, i in mine)
        hits, total = hits + len({i for _, _, i in mine} & {i for _, i in want[:10]}), total + 10
    assert hits >= 0.9 * total


def test_op4(spark, sf, docs):
    import xxhash

    got = {r["doc_id"]: r for r in rows_of(spark, sf, "op4_simhash")}
    prints = {}
    for i, text in zip(docs.doc_id, docs.text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_op6(spark, sf, docs):
    got = {r["doc_id"]: r for r in rows_of(spark, sf, "op6_toxicity")}
    assert set(got) == set(docs.doc_id)
    model = queries.toxicity_model(spark, sf)
    for i, text in zip(docs.doc_id, docs.text):
        r = got[i]
        z = model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.bag_of(toxicity.words_of(text)))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9) and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (fold(i, 5) == 0)
    one = toxicity.score(queries.table(spark, sf, "documents"), model)  # labels, lang, source and doc_id say nothing
    assert one.select("doc_id", "score").where("score < 0 or score > 1").count() == 0


def test_op7(spark, sf, docs, library):
    tokenizer, got, sequences = library("word_bpe_49k.json"), {}, {}
    for r in rows_of(spark, sf, "op7_packing"):
        got.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(got) == set(docs.doc_id)
    total = 0
    for i, text in zip(docs.doc_id, docs.text):
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(got[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == ids_crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
        total += at
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= total // 4096 + 4


def test_op8(spark, sf):
    talks = spark.read.parquet(f"{sf}/conversations.parquet").toPandas()
    want = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in talks.sort_values(["conv_id", "turn"]).itertuples():
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r["conv_id"]: r for r in rows_of(spark, sf, "op8_chat")}
    assert set(got) == set(want)
    for conv, turns in want.items():
        said = "".join(text for role, text in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(said)) and r["formatted_chars"] > len(whole)
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_op9(spark, sf, docs, library):
    tokenizer, start = library("word_bpe_49k.json"), 0
    got = {r["doc_id"]: r for r in rows_of(spark, sf, "op9_token_files")}
    for i, text in sorted(zip(docs.doc_id, docs.text)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert got.pop(i) == {"doc_id": i, "start": start, "n_tokens": len(ids), "ids_crc32": ids_crc(ids)}
        start += len(ids)
    assert not got


def test_op10(spark, sf, docs, library):
    tokenizer = library("byte_bpe_50k.json")
    got = {r["doc_id"]: r for r in rows_of(spark, sf, "op10_token_counts")}
    for i, text in zip(docs.doc_id, docs.text):
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert got.pop(i) == {"doc_id": i, "n_bytes": len((text or "").encode()), "n_tokens": n, "over_limit": n > 1024}
    assert not got
