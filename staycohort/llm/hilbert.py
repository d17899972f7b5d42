"""Approximate nearest neighbours by inner product, over shifted Hilbert curves.

Candidates are split by norm into bands, at quantiles ever closer to the greatest norms, as
far as norms differ by more than `EVEN`. A band's vectors are scaled by its largest norm and
given one more component that makes them unit vectors, so that inner products order them as
distances do. Every query searches every band; only the few rows of the top band are scanned
whole. Each curve projects the vectors at random to a few dimensions, shifts the grid and
takes the place on a Hilbert curve as key. Keys are cut at their quantiles into ranges of a
number of rows; a row goes to its range of every curve, a query to its own range and those
beside it, and every range ranks its rows for its queries. A query's lists are merged over
ranges and curves. Equal places on a curve are ordered differently on each curve.

A window is a number of neighbours along the curve, by rank: a query sees at least `reach(n)` of
a band's n rows on each side, SCALE * n^POWER. How far true neighbours lie apart along a curve
depends on the data; the power was measured on vectors without any structure, where it is
hardest, and being below one it makes the products of a query grow more slowly than the rows. The
README has recall and products against brute force. Where a window holds more rows than a
task should, it is several ranges; where a range is asked by more queries than a task should
answer, they are split, and its rows are repeated for each part.

Products inside a range are found as matrices, whose last bit depends on the place in the
matrix; those of the best rows, and of all that come within rounding of them, are worked out
again component by component, in one order, so equal vectors have equal scores everywhere.

Equal vectors are one candidate, of which the rows of least ids can be in a list, as many as it
has places and one more for the query itself. Equal query vectors are searched once. So copies
of one vector make no range large, and none of them is missed where one is found.

Nulls, ties and the rest: vectors that are null, zero, hold nulls or non-finite numbers,
or are not of the most common length take no part, as query or as candidate; rows without
an id neither; equal products are ranked by id; repeated ids count as one row, of the
greatest vector; fewer candidates than places give all of them; other columns are unused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staycohort.llm.common import join_spread, materialised

CURVES, DIMENSIONS, BITS = 32, 8, 4
#: A query sees SCALE * n^POWER of n rows on each side of its place on a curve at least.
SCALE, POWER = 0.035, 0.82
#: Rows of the top band, which is scanned whole unless it has twice as many of equal norms;
#: rows of a range, queries that it answers in one task, and ranges of a curve, after which
#: ranges get larger. The ends of all ranges of all curves reach every task.
TOP_ROWS, MOST_RANGE, MOST_ASKS, MOST_RANGES = 200, 20_000, 20_000, 20_000
#: Norms up to this ratio may share a band whatever their quantiles.
EVEN = 1.2
_TIE_BITS = 22


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of points with `bits`-bit coordinates (one row each)."""
    x = grid.astype(np.int64).copy()
    n, dims = x.shape
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in range(dims):
            inside = (x[:, axis] >> level) & 1 == 1
            swap = np.where(inside, 0, (x[:, 0] ^ x[:, axis]) & low)
            x[:, 0] ^= np.where(inside, low, swap)
            x[:, axis] ^= swap
    for axis in range(1, dims):
        x[:, axis] ^= x[:, axis - 1]
    flip = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = (key << 1) | ((x[:, axis] >> level) & 1)
    return key


def _hashed(ids: np.ndarray, curve: int) -> np.ndarray:
    """Hashes of `_TIE_BITS` bits, in an order of its own on each curve."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32)) ^ np.uint64(curve)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - _TIE_BITS)).astype(np.int64)


class Curves:
    """Keys of vectors of `size` components on every curve."""

    def __init__(self, size: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.size = size
        self.axes = rng.normal(size=(CURVES, DIMENSIONS, size + 1))
        self.axes /= np.linalg.norm(self.axes, axis=2, keepdims=True)
        self.shifts = rng.uniform(-0.1, 0.1, (CURVES, DIMENSIONS))

    def keys(self, vectors: np.ndarray, ids: np.ndarray, scales: np.ndarray) -> np.ndarray:
        """One row of keys per curve; `scales` are the largest norms of the vectors' bands, or a query's own norm."""
        scaled = vectors / scales[:, None]
        last = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1, keepdims=True)))
        unit = np.concatenate([scaled, last], 1)
        spread = 6 / math.sqrt(self.size + 1)
        out = []
        for number, (axes, shift) in enumerate(zip(self.axes, self.shifts, strict=True)):
            place = (unit @ axes.T) / spread + 0.5 + shift
            grid = np.clip(place * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            out.append((hilbert_keys(grid, BITS) << _TIE_BITS) | _hashed(ids, number))
        return np.stack(out)


def band_edges(norms: list[float]) -> list[float]:
    """Upper ends of all bands but the top one, from the least norm, ascending quantiles and the greatest norm."""
    start, edges = norms[0], []
    for edge, beyond in zip(norms[1:-1], norms[2:], strict=True):
        if beyond > EVEN * start and edge < norms[-1]:
            edges.append(edge)
            start = edge
    return sorted(set(edges))


def reach(n: int, scale: float = SCALE) -> int:
    """Rows that a query sees on each side of its place, of `n`."""
    return max(1, math.ceil(scale * n**POWER))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, size)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, one for each id."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = sizes["size"] if sizes else 0
    return rows.where(F.size("embedding") == size).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))


def _norm() -> Column:
    return F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))


def neighbours(
    embeddings: DataFrame,
    is_query: Column,
    places: int,
    seed: int = 11,
    scale: float = SCALE,
    most_range: int = MOST_RANGE,
    most_asks: int = MOST_ASKS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `places` best rows found for every query row.

    `is_query` is a condition on vec_id.
    """
    of_vector = Window.partitionBy("embedding").orderBy("vec_id")
    rows = materialised(usable(embeddings))
    # the limit stands right above the window, so each task keeps that many of a vector at most
    numbered = rows.withColumn("nth", F.row_number().over(of_vector)).where(F.col("nth") <= places + 1)
    vectors = numbered.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.collect_list("vec_id").alias("ids"))
    candidates = materialised(vectors.select("vec_id", "ids", "embedding", _norm().alias("norm")))
    copies = candidates.select("vec_id", "ids")
    queries = rows.where(is_query)
    searched = materialised(
        queries.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "embedding", F.lit(0).alias("band"))
    )

    facts = candidates.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("size")).first()
    total, size = facts["n"], facts["size"] or 1
    curves = Curves(size, seed)
    edges: list[float] = []
    if total > TOP_ROWS:
        top = TOP_ROWS / total
        tails = [4.0**-k for k in range(1, 16) if 4.0**-k > top]
        at = [0.0, *[1 - t for t in tails], 1 - top, 1.0]
        edges = band_edges(candidates.agg(F.percentile_approx("norm", at, 100_000)).first()[0])
    band = reduce(add, [(F.col("norm") > e).cast("int") for e in edges], F.lit(0))
    candidates = candidates.select("vec_id", "embedding", band.alias("band"), "norm")
    of_band = candidates.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm")).collect()
    scales = np.ones(len(edges) + 1)
    asked_by = searched.count()
    ranges, beside, splits = ({b: 0 for b in range(len(edges) + 1)} for _ in range(3))
    for row in of_band:
        b, n = row["band"], row["n"]
        scales[b] = row["norm"]
        window = reach(n, scale)
        whole = bool(edges) and b == len(edges) and n <= 2 * TOP_ROWS
        ranges[b] = 1 if whole else math.ceil(n / max(min(window, most_range), n / MOST_RANGES))
        beside[b] = 0 if whole else math.ceil(window * ranges[b] / n)
        asks = asked_by / CURVES if whole else asked_by * min(1, (2 * beside[b] + 1) / ranges[b])
        splits[b] = max(1, math.ceil(asks / most_asks))

    def keys_of(as_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, vectors = batch["vec_id"].to_numpy(), _matrix(batch["embedding"], size)
                scale = np.linalg.norm(vectors, axis=1) if as_query else scales[batch["band"].to_numpy()]
                for number, key in enumerate(curves.keys(vectors, ids, scale)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ids), number), pa.int32()), batch["band"], pa.array(key), batch["vec_id"], batch["embedding"]],
                        ["curve", "band", "key", "vec_id", "embedding"],
                    )

        return run

    kind = dict(rows.dtypes)["embedding"]
    candidates = candidates.select("vec_id", "embedding", "band")
    cut = [b for b, n in ranges.items() if n > 1]
    cuts = {(b, number): np.zeros(0, np.int64) for b in ranges for number in range(CURVES)}
    if cut:
        placed = candidates.where(F.col("band").isin(cut)).mapInArrow(
            keys_of(False), f"curve int, band int, key bigint, vec_id bigint, embedding {kind}"
        )
        at = {n: [i / n for i in range(1, n)] for n in {ranges[b] for b in cut}}
        for n, shares in at.items():
            of_n = placed.where(F.col("band").isin([b for b in cut if ranges[b] == n]))
            found = of_n.groupBy("band", "curve").agg(F.percentile_approx("key", shares, max(10_000, 20 * n)).alias("cuts")).collect()
            cuts |= {(row["band"], row["curve"]): np.array(row["cuts"], np.int64) for row in found}

    def dealt(as_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in keys_of(as_query)(batches):
                if not batch.num_rows:
                    continue
                curve, keys, ids = batch["curve"][0].as_py(), batch["key"].to_numpy(), batch["vec_id"].to_numpy()
                for b, n in ranges.items():
                    if not n:
                        continue
                    own = np.searchsorted(cuts[b, curve], keys, "right")
                    # A band of one range is whole on every curve; a query reads it once.
                    asks = _hashed(ids, CURVES) % CURVES == curve if n == 1 else True
                    here = asks if as_query else batch["band"].to_numpy() == b
                    near = beside[b] if as_query else 0
                    for step in range(-near, near + 1):
                        keep = np.flatnonzero(here & (own + step >= 0) & (own + step < n))
                        part = batch.take(pa.array(keep))
                        mine = _hashed(ids[keep], CURVES + 1) % splits[b]
                        for split in range(1 if as_query else splits[b]):
                            yield pa.RecordBatch.from_arrays(
                                [
                                    part["curve"],
                                    pa.array(np.full(len(keep), b), pa.int32()),
                                    pa.array(own[keep] + step, pa.int32()),
                                    pa.array(mine if as_query else np.full(len(keep), split), pa.int32()),
                                    pa.array(np.full(len(keep), as_query)),
                                    part["vec_id"],
                                    part["embedding"],
                                ],
                                ["curve", "band", "range", "split", "asks", "vec_id", "embedding"],
                            )

        return run

    def best_of_range(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table["asks"].to_numpy()
        ids = table["vec_id"].to_numpy()
        vectors = _matrix(table["embedding"].combine_chunks(), size)
        rows_ids, rows = ids[~asks], vectors[~asks]
        by_id = np.argsort(rows_ids)
        rows_ids, rows = rows_ids[by_id], rows[by_id]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        questions, question_ids = vectors[asks], ids[asks]
        longest = np.sqrt((rows**2).sum(1).max(initial=0))
        for start in range(0, len(questions), 128):
            block = questions[start : start + 128]
            products = block @ rows.T
            for question, query, line in zip(block, question_ids[start : start + 128], products, strict=True):
                near = np.arange(len(line))
                if len(line) > places + 1:
                    least = np.partition(line, len(line) - places - 1)[len(line) - places - 1]
                    near = np.flatnonzero(line >= least - 1e-12 * longest * np.sqrt(question @ question))
                exact = np.cumsum(rows[near] * question, axis=1)[:, -1]  # one after the other, whatever the block
                best = np.argsort(-exact, kind="stable")[: places + 1]
                out.append((np.full(len(best), query), rows_ids[near[best]], exact[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(
            {"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "product": pa.array(columns[2], pa.float64())}
        )

    schema = f"curve int, band int, range int, split int, asks boolean, vec_id bigint, embedding {kind}"
    lists = (
        candidates.mapInArrow(dealt(False), schema)
        .union(searched.mapInArrow(dealt(True), schema))
        .groupBy("curve", "band", "range", "split")
        .applyInArrow(best_of_range, "query_id bigint, vec_id bigint, product double")
    )
    by_product = Window.partitionBy("query_id").orderBy(F.desc("product"), "vec_id")
    nearest = materialised(
        lists.groupBy("query_id", "vec_id")
        .agg(F.max("product").alias("product"))
        .withColumn("place", F.row_number().over(by_product))
        .where(F.col("place") <= places + 1)
    )
    rows_of = F.transform("ids", lambda i: F.struct((-F.col("product")).alias("order"), i.alias("vec_id"), F.col("product").alias("product")))
    merged = (
        join_spread(nearest, copies, "vec_id", ["query_id"])
        .groupBy("query_id")
        .agg(F.array_sort(F.flatten(F.collect_list(rows_of))).alias("found"))
        .join(searched.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
        .select("embedding", "found")
    )
    others = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding")
    return (
        join_spread(asked, merged, "embedding", ["query_id"])
        .select("query_id", F.posexplode(F.slice(others, 1, places)).alias("at", "one"))
        .select(
            "query_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("one.vec_id").alias("vec_id"),
            F.col("one.product").alias("score"),
        )
    )
