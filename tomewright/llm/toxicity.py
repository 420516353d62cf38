"""Toxicity: a counterfactual-regularised logistic classifier.

Features are the words of a text, their first 4 to 7 letters, and whether two or three
different words begin with the same letters, each present or not; the classifier keeps
the ``MAX_FEATURES`` that tell the classes apart best in training, among those whose
chi-square statistic reaches ``MIN_CHI2``.
A labelled text that names a group is copied with every identity term swapped for
another of its kind, and the loss penalises the squared change of the score between the
two, so that the mere mention of a group moves the score little, however the labels are
distributed over groups.

Training uses a bounded sample (about ``TRAIN_PER_CLASS`` texts of either class, drawn
by a hash of the id) and weighs the classes back to their shares. Scoring is one pass
over the words of every whole text, without a shuffle.

Defined results: null and empty texts get the score of a text without features; without
labels, or with labels of one kind only, the score is the share of that kind (0 without
any); repeated rows stay; labels and documents with a null id do not meet, so such rows are
scored but not learned from; input columns named like the outputs are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, without, written

TRAIN_PER_CLASS = 4000
MAX_FEATURES = 2000
MIN_TEXTS = 8
MIN_CHI2 = 25.0
PREFIXES = range(4, 8)
#: Features are made for these numbers of different words with one beginning.
REPEATS = (2, 3)
L2 = 1e-4
COUNTERFACTUAL = 4.0
MEMO_WORDS = 200_000

#: Identity terms by kind; a term is swapped for the others of its line.
IDENTITY = (
    "women men girls boys females males",
    "woman man girl boy female male",
    "muslims christians jews hindus buddhists atheists catholics",
    "muslim christian jewish hindu buddhist atheist catholic",
    "gay lesbian straight bisexual transgender queer heterosexual",
    "black white asian latino african european arab mexican",
    "immigrants refugees natives foreigners citizens",
    "immigrant refugee native foreigner citizen",
    "disabled deaf blind autistic",
)
SWAPS = {w: [x for x in line.split() if x != w] for line in IDENTITY for w in line.split()}

_NOTHING = ((), ())
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    """The word itself (with an end mark) and its prefixes."""
    return [word + "$", *[word[:k] for k in PREFIXES if len(word) >= k]]


def bag_of(words: set[str]) -> set[str]:
    """All features of a text, given its words."""
    bag = {f for w in words for f in features_of(w)}
    begins = Counter(w[:k] for w in words for k in PREFIXES if len(w) >= k)
    bag.update(f"{p}#{n}" for p, c in begins.items() for n in REPEATS if c >= n)
    return bag


def swapped(words: set[str], turn: int) -> set[str]:
    """``words`` with every identity term replaced by the ``turn``-th other of its kind."""
    return {SWAPS[w][turn % len(SWAPS[w])] if w in SWAPS else w for w in words}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    memo: dict[str, tuple] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        return self.score_words(words_of(text))

    def score_words(self, words: set[str]) -> float:
        """The score of ``bag_of(words)``, looking only at features with a weight."""
        memo, weights = self.memo, self.weights
        found: set[str] = set()
        begins: list[str] = []
        for w in words:
            got = memo.get(w)
            if got is None:
                counted = [w[:k] for k in PREFIXES if len(w) >= k]
                got = (
                    tuple(f for f in features_of(w) if f in weights),
                    tuple(p for p in counted if any(f"{p}#{n}" in weights for n in REPEATS)),
                )
                if len(memo) < MEMO_WORDS and len(w) <= 40:
                    memo[w] = got if got[0] or got[1] else _NOTHING
            if got is not _NOTHING:
                found.update(got[0])
                begins += got[1]
        for p, c in Counter(begins).items():
            found.update(f for n in REPEATS if c >= n and (f := f"{p}#{n}") in weights)
        z = self.bias + sum(weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sparse(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(column of each entry, row of each entry)."""
    return (
        np.array([c for r in rows for c in r], dtype=np.int64),
        np.repeat(np.arange(len(rows)), [len(r) for r in rows]),
    )


def chi_square(a, b, positives, negatives):
    """Of a feature in ``a`` of the positives and ``b`` of the negatives (numbers or columns)."""
    p, q, m = a / positives, b / negatives, (a + b) / (positives + negatives)
    return (p - q) * (p - q) / (m * (1 - m) * (1 / positives + 1 / negatives) + 1e-12)


def train(texts: list[set[str]], labels: list[int], weights: list[float] | None = None, **options) -> Model:
    """Fit on sets of words, all in memory (:func:`fit` does the same over a table)."""
    sizes = (labels.count(0), labels.count(1))
    seen = (Counter(), Counter())
    for t, label in zip(texts, labels):
        seen[label].update(bag_of(t))
    gain = {}
    if all(sizes):
        for f in seen[0].keys() | seen[1].keys():
            if seen[1][f] + seen[0][f] >= MIN_TEXTS:
                gain[f] = chi_square(seen[1][f], seen[0][f], sizes[1], sizes[0])
    best = sorted((f for f in gain if gain[f] >= MIN_CHI2), key=lambda f: (-gain[f], f))[:MAX_FEATURES]
    return optimise(best, [example(t, set(best)) for t in texts], labels, weights, **options)


def example(words: set[str], known: set[str]) -> tuple[list[str], list[list[str]]]:
    """The known features of a text, and of each of its swaps."""
    turns = max((len(SWAPS[x]) for x in words if x in SWAPS), default=0)
    swaps = [sorted(bag_of(swapped(words, turn)) & known) for turn in range(turns)]
    return sorted(bag_of(words) & known), swaps


def optimise(
    best: list[str],
    examples: list[tuple[list[str], list[list[str]]]],
    labels: list[int],
    weights: list[float] | None = None,
    counterfactual: float = COUNTERFACTUAL,
    steps: int = 800,
) -> Model:
    """Weights of the features ``best``. ``counterfactual`` weighs score changes under swaps."""
    y = np.array(labels, dtype=np.float64)
    w = np.ones(len(y)) if weights is None else np.array(weights, dtype=np.float64)
    share = float((w * y).sum() / w.sum()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Model({}, 30.0 if share else -30.0)
    index = {f: i for i, f in enumerate(best)}

    def rows(bag) -> list[int]:
        return [index[f] for f in bag]

    cols, at = _sparse([rows(bag) for bag, _ in examples])
    # every swap of a text that names a group: entries with +1 for the text, -1 for the swap
    plus, minus, pair_weight = [], [], []
    for (bag, swaps), wt in zip(examples, w):
        for swap in swaps:
            plus.append(rows(bag))
            minus.append(rows(swap))
            pair_weight.append(wt / len(swaps))
    pc, pr = _sparse(plus)
    mc, mr = _sparse(minus)
    pair_weight = np.array(pair_weight)
    n, total = len(index), w.sum()
    v, bias = np.zeros(n), float(np.log(share / (1 - share)))
    # diagonal curvature bounds make plain accelerated gradient steps safe
    size = np.bincount(at, minlength=len(y)).astype(float) + 1
    curve = np.bincount(cols, weights=(w * size)[at], minlength=n) / (4 * total) + L2
    if len(plus):
        both = np.bincount(pr, minlength=len(plus)) + np.bincount(mr, minlength=len(plus))
        for c, r in ((pc, pr), (mc, mr)):
            curve += 2 * counterfactual * np.bincount(c, weights=(pair_weight * both)[r], minlength=n) / total
    bias_curve = float((w * size).sum() / (4 * total))
    look, look_bias, momentum = v.copy(), bias, 1.0
    for _ in range(steps):
        z = look_bias + np.bincount(at, weights=look[cols], minlength=len(y))
        error = w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        slope = np.bincount(cols, weights=error[at], minlength=n) + L2 * look
        if len(plus):
            change = np.bincount(pr, weights=look[pc], minlength=len(plus)) - np.bincount(
                mr, weights=look[mc], minlength=len(plus)
            )
            push = 2 * counterfactual * pair_weight * change / total
            slope += np.bincount(pc, weights=push[pr], minlength=n) - np.bincount(
                mc, weights=push[mr], minlength=n
            )
        new = look - slope / curve
        new_bias = look_bias - error.sum() / bias_curve
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = new + (momentum - 1) / after * (new - v)
        look_bias = new_bias + (momentum - 1) / after * (new_bias - bias)
        v, bias, momentum = new, new_bias, after
    return Model({f: float(v[i]) for f, i in index.items() if v[i]}, float(bias))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = TRAIN_PER_CLASS,
) -> Model:
    """A model from texts and their labels (1, or 0; other labels are left out), joined by id.

    The sample is drawn from the labels, so it is bounded before it meets the texts: a
    broadcast join of about ``2 * per_class`` ids, and the texts are not shuffled.
    Features are counted on the executors. The driver receives two counts, the
    ``MAX_FEATURES`` best features, and which of them about ``2 * per_class`` texts and
    their swaps have, whatever the size of the input.
    """
    labelled = labels.where(col(label_col).isin(0, 1)).select(col(id_col), col(label_col))
    sizes = {int(k): n for k, n in labelled.groupBy(col(label_col)).count().collect()}
    rates = {k: min(1.0, per_class / n) for k, n in sizes.items()}
    draw = F.pmod(F.xxhash64(col(id_col).cast("string")), F.lit(1 << 53)) / float(1 << 53)
    drawn = F.lit(False)
    for k, rate in rates.items():
        drawn = drawn | ((col(label_col) == k) & (draw < rate))

    def words(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            bags = [sorted(words_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bags, pa.list_(pa.string()))], names=["label", "words"]
            )

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                seen = (Counter(), Counter())
                for label, bag in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seen[label].update(bag_of(set(bag)))
                both = list(seen[0].keys() | seen[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(both, pa.string()),
                        pa.array([seen[1][f] for f in both], pa.int64()),
                        pa.array([seen[0][f] for f in both], pa.int64()),
                    ],
                    names=["f", "a", "b"],
                )

    picked = docs.select(col(id_col), col(text_col)).join(F.broadcast(labelled.where(drawn)), id_col)
    sampled = picked.select(
        col(label_col).cast("int").alias("label"), col(text_col).cast("string").alias("text")
    )
    sample = written(sampled.mapInArrow(words, "label int, words array<string>"), "toxicity-sample")
    taken = dict(sample.groupBy("label").count().collect())
    best: list[str] = []
    if len(taken) == 2:
        totals = sample.mapInArrow(count, "f string, a long, b long").groupBy("f").agg(
            F.sum("a").alias("a"), F.sum("b").alias("b")
        )
        gain = chi_square(F.col("a"), F.col("b"), F.lit(float(taken[1])), F.lit(float(taken[0])))
        ranked = totals.where(F.col("a") + F.col("b") >= MIN_TEXTS).withColumn("gain", gain)
        top = ranked.where(F.col("gain") >= MIN_CHI2).orderBy(F.desc("gain"), "f").limit(MAX_FEATURES)
        best = [r["f"] for r in top.select("f").collect()]
    known = set(best)

    def examples(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [example(set(bag), known) for bag in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f for f, _ in found], pa.list_(pa.string())),
                    pa.array([s for _, s in found], pa.list_(pa.list_(pa.string()))),
                ],
                names=["label", "bag", "swaps"],
            )

    schema = "label int, bag array<string>, swaps array<array<string>>"
    rows = sorted(sample.mapInArrow(examples, schema).collect(), key=repr)  # tasks end in any order
    truth = [r["label"] for r in rows]
    return optimise(best, [(r["bag"], r["swaps"]) for r in rows], truth, [1 / rates[k] for k in truth])


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``df``'s columns (the text included) and the probability of label 1."""
    keep = without(df, out_col)
    rest = df.select(*keep)
    at = [c.lower() for c in rest.columns].index(text_col.lower())
    schema = T.StructType([*rest.schema.fields, T.StructField(out_col, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # MAX_FEATURES at most

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = Model(*shared.value)
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=schema.names
            )

    return rest.mapInArrow(run, schema)


def kept(df: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``df`` that score below ``limit``, columns unchanged."""
    out = fresh(df, "_x_score")
    return score(df, model, text_col, out).where(col(out) < limit).select(*[col(c) for c in df.columns])
