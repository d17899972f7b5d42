"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of all documents over its present
share. A document's copies are the Poisson quantile, at that rate, of a number in [0, 1)
hashed from its id and a seed, so a retried task or a second run draws the same copies.
Hashes have 52 bits, so rates below 2e-16 draw nothing. Only DataFrame functions are used.

Nulls, ties and the rest: a null source is a source of its own; documents of equal id
get equal numbers of copies (a null id counts as one id); a source without a weight, or
of weight zero, is drawn zero times; no documents give no rows; input columns are kept,
and one named `copy` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycohort.llm.common import if_small

#: Sources up to which their rates, some KB each, are broadcast; more are joined by key.
MOST_BROADCAST = 2_000

#: Values of a hash that has 52 bits, which a double holds exactly.
_HASH_RANGE = float(2**52)


def smoothed_weights(docs: DataFrame, exponent: float) -> DataFrame:
    """(source, weight): the number of documents of each source to the power `exponent`."""
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(
        "source", F.pow(F.col("n").cast("double"), F.lit(exponent)).alias("weight")
    )


def repetition_rates(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, rate): mean copies of a document, for weights of any positive sum.

    Rates have nine significant digits, so the order in which weights were summed leaves none
    of them different, and a rare draw of a huge source keeps its rate.
    """
    present = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    known = present.join(
        weights.select(F.col("source").alias("w_source"), F.greatest("weight", F.lit(0.0)).alias("w")),
        F.col("source").eqNullSafe(F.col("w_source")),
        "left",
    ).select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    totals = known.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w")).first()
    all_n, all_w = totals["all_n"] or 0, totals["all_w"] or 0.0
    share = F.col("w") / F.lit(all_w) if all_w > 0 else F.lit(0.0)
    rate = share * F.lit(all_n) / F.col("n")
    return known.select("source", F.format_string("%.8e", rate).cast("double").alias("rate"))


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the parts' MD5."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(_HASH_RANGE)


def _cumulative(rate: str) -> Column:
    """P(X <= k) of a Poisson number for k = 0, 1, ... until the rest is below 1e-16.

    Probabilities are carried as logarithms, so high rates do not underflow.
    """
    last = F.ceil(F.col(rate) + 12 * F.sqrt(F.col(rate)) + 30).cast("int")
    start = F.struct(
        (-F.col(rate)).alias("log_p"),
        F.exp(-F.col(rate)).alias("total"),
        F.array(F.exp(-F.col(rate))).alias("steps"),
    )

    def step(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.log(F.col(rate)) - F.log(k.cast("double"))
        total = state["total"] + F.exp(log_p)
        return F.struct(
            log_p.alias("log_p"),
            total.alias("total"),
            F.concat(state["steps"], F.array(total)).alias("steps"),
        )

    steps = F.aggregate(F.sequence(F.lit(1), last), start, step)["steps"]
    return F.when(F.col(rate) > 0, steps).otherwise(F.array(F.lit(1.0)))


def poisson_mixture(docs: DataFrame, weights: DataFrame, seed: str) -> DataFrame:
    """Every document repeated by its Poisson count, with `copy` from 1, globally shuffled.

    Rows are dealt to partitions and ordered in them by a hash of id, copy and seed.
    """
    rates = repetition_rates(docs, weights).select(
        F.col("source").alias("__rate_source"), _cumulative("rate").alias("__steps")
    )
    number = hashed_uniform(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    counted = (
        docs.join(if_small(rates, MOST_BROADCAST), F.col("source").eqNullSafe(F.col("__rate_source")))
        .withColumn("__u", number)
        .withColumn("__n", F.size(F.filter("__steps", lambda p: p <= F.col("__u"))))
        .drop("__rate_source", "__steps", "__u")
        .where(F.col("__n") > 0)
    )
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("copy"))
    return copies.withColumn("__order", order).repartition("__order").sortWithinPartitions("__order").drop("__order")
