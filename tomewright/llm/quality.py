"""Quality rules: a table of thresholds compiled into one projection.

``counts_of`` states every count of a text as a DataFrame expression (built-in
functions and higher-order functions only); ``compile_rules`` turns a threshold table
into one boolean expression over them. Nothing is shuffled: the work on a document is
one row's work, so a hot source, a long text or thousands of copies change nothing.

Defined results: a null text counts as empty; an empty text has zero words and is not
kept; ratios over zero words are 0; rows keep their multiplicity; a column of the input
that has the name of the output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, let, without

#: Common function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with this is in it on for as was are by an or from at he she they not but which",
    "le la les de des du et un une que qui dans pour est sur pas avec au en il elle ne se son plus par",
    "der die das und ist von den mit ein eine nicht zu auf für im dem des sich auch es an als ich sie",
    "el los las y una con por para su al lo del como se no más esta este o pero sus",
)


def stop_words() -> list[str]:
    words = sorted({w for line in STOP_WORDS for w in line.split()})
    return words + [w.capitalize() for w in words]


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [least, most]; None leaves that side open.

    The rule holds for texts of ``from_words`` words or more; a ratio over a few words
    says nothing.
    """

    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The threshold table in production use, calibrated to keep clean prose in four languages.
RULES = (
    Rule("n_words", least=10),
    Rule("repeat_word_pct", most=20),
    Rule("mean_word_chars", least=2, most=14),
    Rule("symbols_per_word", most=0.1),
    Rule("stop_word_ratio", least=0.04, from_words=25),
    Rule("dup_line_ratio", most=0.5),
    Rule("bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_ratio", most=0.5),
)
#: The rules that every table starts from; they are reported apart.
BASE_MEASURES = ("n_words", "repeat_word_pct")

REPEAT_WINDOW = 5


def _repeat_words(words: Column, window: int) -> Column:
    """Words in ``window``-word windows that occur twice or more in the array.

    Windows are compared by their 64-bit hash. Texts without a repeat stop after a
    set of longs; the others sort (hash, position) pairs and measure the union of the
    intervals of repeated windows.
    """

    def covered(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        twice = F.filter(
            pairs,
            lambda e, j: ((j > 0) & (F.get(pairs, j - 1)["h"] == e["h"]))
            | ((j < last) & (F.get(pairs, j + 1)["h"] == e["h"])),
        )
        return let(
            F.sort_array(F.transform(twice, lambda e: e["i"])),
            lambda at: F.aggregate(
                F.transform(
                    at, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - p, F.lit(window)))
                ),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    def of_hashes(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(
                F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
                covered,
            )
        )

    grams = F.transform(
        F.sequence(F.lit(0), F.size(words) - window),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]),
    )
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(grams, of_hashes)).cast("long")


def counts_of(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Every count by name. ``words`` and ``lines`` are arrays made by :func:`score`.

    ``words`` are runs of characters other than ASCII white space; ``lines`` are the
    line-feed separated lines that hold a word.
    """
    n_words = F.size(words).cast("long")
    word_chars = F.length(F.array_join(words, "")).cast("long")
    n_symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")
    n_lines = F.size(lines).cast("long")
    n_dup = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
    stops = stop_words()
    n_stop = F.size(F.filter(words, lambda w: w.isin(stops))).cast("long")
    n_repeat = _repeat_words(words, REPEAT_WINDOW)
    n_bullet = F.size(F.filter(lines, lambda s: s.rlike(r"^[ \t]*[-*•]"))).cast("long")
    n_ellipsis = F.size(F.filter(lines, lambda s: s.rlike(r"(\.\.\.|…)[ \t\r]*$"))).cast("long")

    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "n_lines": n_lines,
        "n_stop_words": n_stop,
        "n_bullet_lines": n_bullet,
        "n_ellipsis_lines": n_ellipsis,
    }


COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_stop_words",
    "n_bullet_lines",
    "n_ellipsis_lines",
)


def compile_rules(rules, value) -> Column:
    """One boolean: every rule holds. ``value(measure)`` gives a measure's column."""
    out = F.lit(True)
    for r in rules:
        short = (value("n_words") < r.from_words) if r.from_words else F.lit(False)
        if r.least is not None:
            out = out & (short | (value(r.measure) >= r.least))
        if r.most is not None:
            out = out & (short | (value(r.measure) <= r.most))
    return out


def score(df: DataFrame, text_col: str = "text", out_col: str = "quality", rules=RULES) -> DataFrame:
    """``df`` with a struct column ``out_col`` of all counts, ratios, ``base_failed`` and ``kept``."""
    t, w, s = (fresh(df, x) for x in ("_q_text", "_q_words", "_q_lines"))
    keep = without(df, out_col)
    text = df.select("*", F.coalesce(col(text_col).cast("string"), F.lit("")).alias(t))
    split = text.select(
        "*",
        F.array_remove(F.split(col(t), r"[ \t-\r]+"), "").alias(w),
        F.filter(F.split(col(t), "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias(s),
    )
    every = counts_of(col(t), col(w), col(s))
    # plain columns, not a struct: the optimizer would inline a struct's parts at every use
    at = {c: fresh(df, f"_q_{c}") for c in COUNTS}
    counted = split.select(*keep, *[every[c].alias(at[c]) for c in COUNTS])

    def over(part: str, whole: str) -> Column:
        return F.coalesce(col(at[part]) / F.nullif(col(at[whole]), F.lit(0).cast("long")), F.lit(0.0))

    ratios = {
        "repeat_word_pct": 100 * over("n_repeat_words", "n_words"),
        "mean_word_chars": over("word_chars", "n_words"),
        "symbols_per_word": over("n_symbols", "n_words"),
        "stop_word_ratio": over("n_stop_words", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "bullet_line_ratio": over("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": over("n_ellipsis_lines", "n_lines"),
    }
    value = lambda m: ratios[m] if m in ratios else col(at[m])
    base = [r for r in rules if r.measure in BASE_MEASURES]
    rest = [r for r in rules if r.measure not in BASE_MEASURES]
    base_failed = ~compile_rules(base, value)
    return counted.select(
        *keep,
        F.struct(
            *[col(at[c]).alias(c) for c in COUNTS],
            *[v.alias(k) for k, v in ratios.items()],
            base_failed.alias("base_failed"),
            (~base_failed & compile_rules(rest, value)).alias("kept"),
        ).alias(out_col),
    )


def kept(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``df`` that every rule keeps, columns unchanged."""
    q, flag = fresh(df, "_q"), fresh(df, "_q_kept")
    names = [col(c) for c in df.columns]
    # an expression that is not deterministic keeps the filter above the projection;
    # pushed below, it would hold every measure once more for each of its uses
    still = F.monotonically_increasing_id() >= 0
    scored = score(df, text_col, q, rules).select(*names, (col(q)["kept"] & still).alias(flag))
    return scored.where(col(flag)).select(*names)
