"""Mixing sources to target weights by Poisson replication.

A source of n documents and target weight w gets the mean repetition rate
w * budget / n. Each document draws its number of copies from a Poisson distribution of
that mean by inversion of a uniform number, a hash of seed, id, text and occurrence, so the
draw does not depend on partitions or retries. Copies are exploded and dealt by a hash of
the same and the copy; sorted by it inside each partition, the whole is one random order.

The occurrence is 0 for all but rows that repeat both the id and the text: these are
numbered, so that each has a draw and a place of its own. Only their keys are counted and
only if there are any is a join made; a key of more than ``NUMBERED`` rows is numbered in
as many parts as it has times that, by position.

Built-in functions only. Sources are counted by a partial aggregate and their rates come
back by a join: a broadcast one while there are at most ``BROADCAST_SOURCES`` sources, a
plain one beyond that, which adaptive skew handling splits if a source is hot. The only
other shuffle deals the copies evenly, hot source or not.

Defined results: a null source is a source; sources missing from ``weights`` get no
copies; rows with a null or repeated id draw by their texts, repeated rows by their
occurrence, each for itself; without a text column rows of one id are repeated rows; an
empty table gives an empty result; input columns named like the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, let, without, written

SEED = 17
#: Rates above this are drawn as a sum of Poisson numbers of smaller means.
MAX_MEAN = 16.0
#: A Poisson number of mean MAX_MEAN exceeds this with a probability below 2^-80.
MAX_COUNT = 100
BROADCAST_SOURCES = 10_000
#: Repeated rows of one id and text that one task numbers.
NUMBERED = 100_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / float(1 << 52)


def poisson_cdf(mean: Column) -> Column:
    """P(X <= 0), ..., P(X <= MAX_COUNT) of a Poisson number of mean at most MAX_MEAN."""
    start = F.struct(
        F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all")
    )

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        c = state["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(state["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_COUNT)), start, step, lambda s: s["all"])


def identified(df: DataFrame, id_col: str, text_col: str, key_col: str) -> DataFrame:
    """``df`` with ``key_col``: id, digest of the text and occurrence, a string of each row's own."""
    id_text = F.coalesce(col(id_col).cast("string"), F.lit("null"))
    has_text = text_col.lower() in {c.lower() for c in df.columns}
    digest = F.md5(F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")) if has_text else F.lit("")
    base = F.concat_ws("|", id_text, digest)
    b, n, at = (fresh(df, x) for x in ("_m_base", "_m_times", "_m_at"))
    counts = df.groupBy(base.alias(b)).agg(F.count("*").alias(n)).where(col(n) > 1)
    counts = written(counts, "mix-repeated")
    if counts.isEmpty():
        return df.withColumn(key_col, F.concat_ws("|", base, F.lit("0")))
    every = df.withColumn(key_col, base)
    once = every.join(counts, col(key_col) == col(b), "left_anti")
    parts = F.ceil(col(n) / NUMBERED).cast("long")
    again = every.join(counts, col(key_col) == col(b)).withColumn(
        at, F.pmod(F.monotonically_increasing_id(), parts)
    )
    number = F.row_number().over(Window.partitionBy(b, at).orderBy(F.lit(1))) - 1
    number = (number * parts + col(at)).cast("string")
    names = [col(c) for c in df.columns]
    return once.select(*names, F.concat_ws("|", col(key_col), F.lit("0")).alias(key_col)).union(
        again.select(*names, F.concat_ws("|", col(key_col), number).alias(key_col))
    )


def mix(
    df: DataFrame,
    weights: dict[str, float] | None = None,
    budget: float | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    exponent: float = 0.5,
    seed: int = SEED,
    copy_col: str = "copy",
    order_col: str = "shuffle_key",
    text_col: str = "text",
) -> DataFrame:
    """``df``'s columns, ``copy_col`` (from 1) and ``order_col`` (ascending in a partition).

    ``weights`` are target shares of the sources, in any unit; without them a source's
    share goes with its number of documents to the power ``exponent``. ``budget`` is the
    expected number of rows of the result (default: as many as the input has).
    """
    spark = df.sparkSession
    keep = without(df, copy_col, order_col)
    s, n, weight = (fresh(df, x) for x in ("_m_source", "_m_n", "_m_weight"))
    source = col(source_col).cast("string")
    counts = written(df.groupBy(source.alias(s)).agg(F.count("*").alias(n)), "mix-counts")
    if weights is None:
        share = F.pow(col(n).cast("double"), F.lit(float(exponent)))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(col(s).eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    weighted = counts.select(s, n, share.alias(weight))
    whole = weighted.agg(F.sum(weight), F.sum(n), F.count("*")).first()
    parts, cdf = fresh(df, "_m_parts"), fresh(df, "_m_cdf")
    rate = col(weight) * ((budget if budget is not None else whole[1] or 0) / (whole[0] or 1.0)) / col(n)
    rates = weighted.select(
        s, rate.alias(weight), F.greatest(F.lit(1), F.ceil(rate / MAX_MEAN)).cast("int").alias(parts)
    ).select(s, parts, poisson_cdf(col(weight) / col(parts)).alias(cdf))
    rates = written(rates, "mix-rates")
    if whole[2] <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    drawn, key_col = fresh(df, "_m_copies"), fresh(df, "_m_key")
    key = col(key_col)
    draws = F.aggregate(
        F.sequence(F.lit(1), col(parts)),
        F.lit(0),
        lambda total, part: total
        + let(
            uniform(F.lit(str(seed)), key, part.cast("string")),
            lambda u: F.size(F.filter(col(cdf), lambda c: c <= u)),
        ),
    )
    copies = (
        identified(df, id_col, text_col, key_col)
        .join(rates, source.eqNullSafe(col(s)))
        .select(*keep, key_col, draws.alias(drawn))
        .where(col(drawn) > 0)
        .select(*keep, key_col, F.explode(F.sequence(F.lit(1), col(drawn))).alias(copy_col))
    )
    order = F.conv(
        F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), key, col(copy_col).cast("string"))), 1, 15),
        16,
        10,
    ).cast("long")
    dealt = copies.select(*keep, copy_col, order.alias(order_col))
    return dealt.repartition(col(order_col)).sortWithinPartitions(col(order_col))
