"""Language identification of mixed-language text.

Training counts the character trigrams of a bounded sample of labelled texts, by
language, into a hashed table; it also records which scripts each language is written
in. A word's candidates are the languages of its script; each gets the mean-centred sum
of its trigrams' log-probabilities. A Viterbi pass over the words of a text, with a
penalty for changing the language, labels spans; a text's language is the one whose
spans hold most letters.

The pass is vectorised over a batch: texts are cut into segments, each segment's best
score from every first to every last language is computed for all segments at once,
segments are chained per text, and the labels are traced back the same way. Whole texts
are read, whatever their length, and the cost is linear in the words.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text
whose script no learned language uses gets the most frequent learned language with score
0; with nothing to learn from every text is ``und``; repeated rows stay; input columns
named like the outputs are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, without

#: Training texts a language (expected number: rows are drawn by a hash of their id).
TRAIN_PER_LANGUAGE = 1500
BUCKETS = 1 << 16
SMOOTHING = 0.5
SWITCH_PENALTY = 12.0
#: A word says at most this much (log-probability) for or against a language.
WORD_CAP = 8.0
#: A language is written in a script if that holds this share of its training letters.
SCRIPT_SHARE = 0.01
SEGMENT = 128
#: Words in a worker's memo, and the longest word kept.
MEMO_WORDS = 500_000
MEMO_CHARS = 40

# First code points of script ranges; a range lasts up to the next.
SCRIPTS = (
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0900, "Devanagari"),
    (0x0980, "Indic"),
    (0x0E00, "Thai"),
    (0x0E80, "SoutheastAsian"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Ethiopic"),
    (0x1780, "Khmer"),
    (0x1800, "Other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x3040, "Kana"),
    (0x3100, "Other"),
    (0x3400, "Han"),
    (0xA000, "Other"),
    (0xAC00, "Hangul"),
    (0xD800, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Other"),
    (0x20000, "Han"),
    (0x30000, "Other"),
)
_STARTS = np.array([a for a, _ in SCRIPTS])
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])

_RUNS = re.compile(r"[^\W\d_]+")


def letters_of(word: str) -> str:
    """The characters of letter categories: a Roman numeral or one half is a number, no letter."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def has_letter(text: str) -> bool:
    first = _RUNS.search(text)
    return first is not None and (any(map(str.isalpha, first[0])) or any(map(str.isalpha, text)))


def scripts_of(codes: np.ndarray) -> np.ndarray:
    return _SCRIPT_OF[np.searchsorted(_STARTS, codes, side="right") - 1]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each trigram, first trigram of each word, letters, script of each word).

    A word is a non-empty string of letters; its trigrams include a mark at either end.
    """
    text = "^" + "$^".join(words) + "$"
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    h = codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)
    h = (h ^ (h >> np.uint64(15))) * np.uint64(0x27D4EB2F)
    buckets = ((h >> np.uint64(13)) % np.uint64(BUCKETS)).astype(np.int64)
    inside = np.ones(len(buckets), dtype=bool)  # not across two words
    inside[starts[1:] - 1] = False
    inside[starts[1:] - 2] = False
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return buckets[inside], firsts, sizes, scripts_of(codes[starts + 1])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # [bucket, language] log-probabilities
    scripts: np.ndarray  # [script, language] allowed
    default: int  # the most frequent language

    def words(self, words: list[str]) -> np.ndarray:
        """[word, language + 1]: centred, capped log-scores, and the number of letters."""
        buckets, firsts, sizes, script = trigrams(words)
        sums = np.add.reduceat(self.table[buckets], firsts, axis=0)
        allowed = self.scripts[script]
        known = allowed.any(axis=1)
        best = np.where(allowed, sums, -np.inf).max(axis=1, initial=-np.inf)
        scores = np.where(allowed, np.maximum(sums - np.where(known, best, 0)[:, None], -WORD_CAP), -WORD_CAP)
        scores[~known] = 0
        return np.column_stack([scores, np.where(known, sizes, 0)]).astype(np.float32)


def viterbi(scores: np.ndarray, ends: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of every word of texts laid one after the other.

    ``scores`` is [word, language]; ``ends`` are the texts' end positions, all non-empty.
    """
    n, k = scores.shape
    starts = np.concatenate([[0], ends[:-1]])
    counts = -(-(ends - starts) // SEGMENT)
    first_of = np.concatenate([[0], np.cumsum(counts)[:-1]])
    total = int(counts.sum())
    text_of = np.repeat(np.arange(len(ends)), counts)
    at = starts[text_of] + (np.arange(total) - first_of[text_of]) * SEGMENT
    length = np.minimum(SEGMENT, ends[text_of] - at)
    steps = int(length.max())
    # words past a segment's end score 0: staying put costs nothing there
    where = at[:, None] + np.arange(steps)
    grid = np.where((np.arange(steps) < length[:, None])[:, :, None], scores[np.minimum(where, n - 1)], 0)

    def forward(begin: np.ndarray, trace: list | None) -> np.ndarray:
        """``begin`` [..., k] is the score before each segment; ties prefer staying."""
        now = begin
        for t in range(steps):
            e = grid[:, t] if now.ndim == 2 else grid[:, None, t]
            jump = now.max(axis=-1, keepdims=True) - penalty
            if trace is not None:
                trace.append((now >= jump, now.argmax(axis=-1)))
            now = np.maximum(now, jump) + e
        return now

    across = np.full((k, k), -np.inf, dtype=np.float32)
    np.fill_diagonal(across, 0)
    moves = forward(np.broadcast_to(across, (total, k, k)), None)
    begin = np.zeros((total, k), dtype=np.float32)
    for j in range(int(counts.max()) - 1):  # chain: segment j to j + 1 of every long text
        s = first_of[counts > j + 1] + j
        begin[s + 1] = (begin[s][:, :, None] + moves[s]).max(axis=1)
    trace: list = []
    finish = forward(begin, trace)
    last = first_of + counts - 1
    end_label = np.zeros(total, dtype=np.int64)
    end_label[last] = finish[last].argmax(axis=1)
    for j in range(int(counts.max()) - 1, 0, -1):
        s = first_of[counts > j] + j
        end_label[s - 1] = (begin[s] + moves[s, :, end_label[s]]).argmax(axis=1)
    labels = np.zeros((total, steps), dtype=np.int64)
    now, rows = end_label, np.arange(total)
    for t in range(steps - 1, -1, -1):
        labels[:, t] = now
        stay, best = trace[t]
        now = np.where(stay[rows, now], now, best)
    out = np.zeros(n, dtype=np.int64)
    valid = np.arange(steps) < length[:, None]
    out[where[valid]] = labels[valid]
    return out


class Tagger:
    """Labels texts with a model, keeping a bounded memo of word scores."""

    def __init__(self, model: Model):
        self.model = model
        k = len(model.languages) + 1
        self.rows: dict[str, int] = {}
        self.used = 1
        self.scores = np.zeros((1024, k), dtype=np.float32)  # row 0: no letters

    def _rows_of(self, tokens: list[str]) -> np.ndarray:
        rows = self.rows
        new = [w for w in set(tokens) if w not in rows]
        if new:
            if max(len(rows), self.used) + len(new) > MEMO_WORDS:
                rows.clear()
                self.used, self.scores = 1, self.scores[:1024]
                new = list(set(tokens))
            letters = list(map(letters_of, new))
            real = [(w, x) for w, x in zip(new, letters) if x]
            rows.update((w, 0) for w, x in zip(new, letters) if not x)
            if real:
                base, need = self.used, self.used + len(real)
                self.used = need
                if need > len(self.scores):
                    grown = np.zeros((max(need, 2 * len(self.scores)), self.scores.shape[1]), dtype=np.float32)
                    grown[: len(self.scores)] = self.scores
                    self.scores = grown
                self.scores[base:need] = self.model.words([x for _, x in real])
                rows.update((w, base + i) for i, (w, _) in enumerate(real))
        found = np.fromiter(map(rows.__getitem__, tokens), np.int64, len(tokens))
        for w in new:
            if len(w) > MEMO_CHARS:
                del rows[w]
        return found

    def label(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[list[str]], list[np.ndarray]]:
        """Per text: the label of each word, the words, and the letters of each word."""
        tokens = [t.lower().split() if t else [] for t in texts]
        rows = self._rows_of([w for ws in tokens for w in ws])  # may replace self.scores
        found = self.scores[rows]
        sizes = np.array([len(ws) for ws in tokens], dtype=np.int64)
        some = sizes > 0
        ends = np.cumsum(sizes)
        labels = (
            viterbi(found[:, :-1], ends[some]) if some.any() else np.zeros(0, dtype=np.int64)
        )
        cuts = ends[:-1]
        return np.split(labels, cuts), tokens, np.split(found[:, -1], cuts)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        k = len(self.model.languages)
        if not k:
            return ["und"] * len(texts), [0.0] * len(texts)
        every_label, _, every_letter = self.label(texts)
        for text, labels, letters in zip(texts, every_label, every_letter):
            if text is None or not has_letter(text):
                names.append("und")
                scores.append(0.0)
                continue
            held = np.bincount(labels, weights=letters, minlength=k)
            whole = held.sum()
            best = int(held.argmax()) if whole else self.model.default
            names.append(self.model.languages[best])
            scores.append(float(held[best] / whole) if whole else 0.0)
        return names, scores

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first word, word after the last, language) of the runs of one label."""
        if not self.model.languages:
            return []
        (labels,), _, _ = self.label([text])
        cuts = [0, *(np.nonzero(np.diff(labels))[0] + 1).tolist(), len(labels)]
        return [(a, b, self.model.languages[labels[a]]) for a, b in zip(cuts, cuts[1:]) if b > a]


def fit(
    df: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = TRAIN_PER_LANGUAGE
) -> Model:
    """A model from rows of known language: about ``per_language`` texts of each, by hash of the id.

    The driver receives the number of rows of each language and the hashed table (at most
    ``BUCKETS`` rows a language), whatever the size of the input.
    """
    lang = col(lang_col).cast("string")
    labelled = df.where(col(lang_col).isNotNull() & col(text_col).isNotNull())
    sizes = dict(labelled.groupBy(lang.alias("lang")).count().collect())
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPT_NAMES), 0), dtype=bool), 0)
    drawn: Column = F.lit(False)
    for name, n in sizes.items():
        rate = min(1.0, per_language / n)
        # the lowest 2^53 hash values as a uniform draw
        draw = F.pmod(F.xxhash64(col(id_col).cast("string")), F.lit(1 << 53)) / float(1 << 53)
        drawn = drawn | ((lang == name) & (draw < rate))
    order = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [x for w in _RUNS.findall(text.lower()) if (x := letters_of(w))]
                if not words:
                    continue
                k = order[name]
                if k not in held:
                    held[k] = np.zeros(BUCKETS + len(SCRIPT_NAMES), dtype=np.int64)
                buckets, _, letters, script = trigrams(words)
                held[k][:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                held[k][BUCKETS:] += np.bincount(script, weights=letters, minlength=len(SCRIPT_NAMES)).astype(
                    np.int64
                )
        for k, counts in held.items():
            at = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                names=["k", "at", "n"],
            )

    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    sampled = labelled.where(drawn).select(lang.alias("lang"), col(text_col).cast("string").alias("text"))
    parts = sampled.mapInArrow(count, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n"))
    found = parts.toPandas()
    counts[found["at"].to_numpy(), found["k"].to_numpy()] = found["n"].to_numpy()
    grams, script = counts[:BUCKETS], counts[BUCKETS:]
    used = grams.sum(axis=1) > 0
    smooth = grams + SMOOTHING
    table = np.log(smooth / (grams.sum(axis=0) + SMOOTHING * max(1, used.sum())))
    table[~used] = 0.0  # a trigram of no language says nothing
    allowed = script >= SCRIPT_SHARE * np.maximum(1, script.sum(axis=0))
    default = languages.index(max(languages, key=lambda x: (sizes[x], x)))
    return Model(languages, table.astype(np.float32), allowed, default)


def predict(
    df: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score"
) -> DataFrame:
    """``df``'s columns but the text, with the predicted language and its share of the letters."""
    keep = without(df, text_col, lang_out, score_out)
    rest = df.select(*keep)
    fields = [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]
    schema = T.StructType([*rest.schema.fields, *fields])
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, bounded

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tagger = Tagger(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, scores = tagger.predict(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=schema.names,
                )

    text = col(text_col).cast("string").alias(fresh(rest, "_l_text"))
    return df.select(*keep, text).mapInArrow(run, schema)


def spans(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """``df``'s columns but the text, and its runs of one language.

    (first word, word after the last, language), words being separated by white space; null
    texts and texts without a word have none.
    """
    keep = without(df, text_col, out_col)
    rest = df.select(*keep)
    run_type = "struct<first:int,after:int,lang:string>"
    schema = T.StructType([*rest.schema.fields, *T.StructType.fromDDL(f"`{out_col}` array<{run_type}>").fields])
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, bounded

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        tagger, kind = Tagger(shared.value), to_arrow_type(schema[out_col].dataType)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [
                    [{"first": a, "after": b, "lang": lang} for a, b, lang in tagger.spans(t)]
                    for t in part.column(part.num_columns - 1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, kind)], names=schema.names)

    text = col(text_col).cast("string").alias(fresh(rest, "_l_text"))
    return df.select(*keep, text).mapInArrow(run, schema)
