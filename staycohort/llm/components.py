"""Connected components of a graph held in tables, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycohort.llm.common import join_spread, materialised


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every node's larger neighbours to its smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    # a node with very many neighbours meets its least one in parts
    up = join_spread(both.where(F.col("b") > F.col("a")), least, "a", ["b"])
    return up.select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie every node and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    tied = join_spread(down, least, "a", ["b"]).where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of `edges` (a, b of one ordered type) and the least node
    of its component. Each round is stored; it ends when a round changes no edge."""
    old = materialised(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = old.agg(mark).first()[0]
    while True:
        new = materialised(_small_star(_large_star(old)))
        after = new.agg(mark).first()[0]
        if after == before:
            break
        old, before = new, after
    roots = new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return new.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
