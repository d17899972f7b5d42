"""SimHash near-duplicates, with candidates pruned along rings of segments.

A fingerprint's bit is the majority of that bit over the XXH64 hashes of a text's word
shingles. Fingerprints are cut into `limit + 1` segments on a ring. If two differ in at
most `limit` bits, some segment starts a chain along the ring in which every first `l`
segments together differ in at most `l * limit / (limit + 1)` bits, rounded down: none in
the first segment, at most one in the first two, and so on. So a distinct fingerprint is
filed, for each segment, under that segment and each variant of the next one with at most
one bit flipped; fingerprints filed together are checked chain length by chain length, and
the last length is the whole Hamming distance.

A file of more than `MOST_FILED` fingerprints is dense, as where a template is filled in
slightly differently over and over. It is filed again under the chain's next segment: two
chains of three segments differ there in at most two bits, so both with at most one bit
flipped meet. Files that are dense even so are cut into blocks, and every two blocks are a
file of their own: no task holds more than two blocks, and no pair of a file is left out.
Within one file only links that join different groups so far are reported, so a dense group
gives as many links as members, not as many as pairs, and a file ends as soon as it is one
group; the components are the same.

Rows meet their fingerprint's component, and fingerprints the name of it, in parts, so copies
that are a third of all documents, or one large component, are dealt over tasks.

Nulls, ties and the rest: a null or wordless text has fingerprint zero and links like any
other; a text of fewer words than a shingle is one shingle; a bit set in exactly half of
the hashes is 0; a component is named by its smallest doc_id (null if all are null);
repeated rows have equal fingerprints; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from staycohort.llm.common import join_spread, materialised, row_key, small_batches
from staycohort.llm.components import components

BITS = 64
SEED = 42
#: Fingerprints of a file; larger ones are split.
MOST_FILED = 4000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int) -> int:
    """The signed 64-bit SimHash of a text's shingles of `width` words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = (ends - sizes + 1)[: len(words) - width + 1].tolist()
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    n = len(hashes)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = np.array(hashes[k : k + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, width: int) -> DataFrame:
    """`docs` and a column `__fp` (bigint)."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py(), width) for t in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "__fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())]))


def segments(limit: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of the `limit + 1` segments."""
    if not 2 <= limit <= 30:
        raise ValueError("the bit distance must be from 2 to 30")
    edges = [BITS * i // (limit + 1) for i in range(limit + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _files(fp: Column, limit: int) -> Column:
    """Every key under which a fingerprint is filed: the chain's first segment as it is
    and the next with at most one bit flipped."""
    parts = segments(limit)
    keys = []
    for i, (start, size) in enumerate(parts):
        next_start, next_size = parts[(i + 1) % len(parts)]
        first = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << size) - 1))
        second = F.shiftrightunsigned(fp, next_start).bitwiseAND(F.lit((1 << next_size) - 1))
        base = F.lit(i << 58).bitwiseOR(F.shiftleft(first, next_size)).bitwiseOR(second)
        keys.append(base)
        keys += [base.bitwiseXOR(F.lit(1 << bit)) for bit in range(next_size)]
    return F.array(*keys)


def _rings(limit: int) -> np.ndarray:
    """[segment][l - 1]: the mask of the first l segments of the chain from `segment`."""
    masks = [((1 << size) - 1) << start for start, size in segments(limit)]
    out = np.zeros((len(masks), len(masks)), np.uint64)
    for i in range(len(masks)):
        chain = 0
        for k in range(len(masks)):
            chain |= masks[(i + k) % len(masks)]
            out[i, k] = chain
    return out


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray, limit: int, rings: np.ndarray) -> np.ndarray:
    """Positions of the pairs whose chains from segment `start` stay in every budget."""
    differ = (a ^ b).view(np.uint64)
    alive = np.arange(len(a))
    for length in range(2, limit + 2):
        budget = length * limit // (limit + 1)
        chain = rings[start[alive], length - 1]
        alive = alive[np.bitwise_count(differ[alive] & chain) <= budget]
    return alive


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _forest(keys: np.ndarray, fps: np.ndarray, segment: np.ndarray, limit: int, rings: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the fingerprints filed under each key; rows sorted by key."""
    n = len(keys)
    parent = np.arange(n)
    label = parent.copy()
    found: list[tuple[int, int]] = []
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)
    of_file = np.repeat(np.arange(len(first)), np.diff(first, append=n))
    left = np.arange(n - 1)
    step = 1
    while True:
        left = left[left + step < n]
        left = left[of_file[left] == of_file[left + step]]
        if not len(left):
            return found
        apart = left[label[left] != label[left + step]]
        good = apart[linked(fps[apart], fps[apart + step], segment[apart], limit, rings)]
        for i in good.tolist():
            a, b = _root(parent, i), _root(parent, i + step)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((int(fps[i]), int(fps[i + step])))
        if len(good):
            label = parent
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
            parent = label.copy()
            one_group = np.minimum.reduceat(label, first) == np.maximum.reduceat(label, first)
            left = left[~one_group[of_file[left]]]
        step += 1


def _split(filed: DataFrame, most_filed: int, refile: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of files that are not dense, and of dense ones under the keys `refile` gives them, with `n` of the old file."""
    part = F.pmod(F.xxhash64("fp"), F.lit(64)).cast("int")
    filed = filed.withColumn("part", part)
    counts = filed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("key").agg(F.sum("n").alias("n"), F.collect_list("part").alias("parts"))
    dense = materialised(sizes.where(F.col("n") > most_filed).select("key", "n", F.explode("parts").alias("part")))
    if dense.isEmpty():
        return filed.drop("part"), dense.limit(0)
    sparse = filed.join(dense.select("key", "part"), ["key", "part"], "left_anti").drop("part")
    again = filed.join(dense, ["key", "part"]).select("fp", "segment", F.explode(refile).alias("key"))
    return sparse, materialised(again)


def _longer_chain(limit: int) -> Column:
    """The keys under which a row of a dense file is filed again: the chain's third segment, at most one bit flipped."""
    parts = segments(limit)
    keys = None
    for i in range(len(parts)):
        start, size = parts[(i + 2) % len(parts)]
        third = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << size) - 1))
        near = F.array(third, *[third.bitwiseXOR(F.lit(1 << bit)) for bit in range(size)])
        # a hash, as both keys do not fit: files that meet by chance cost time and change nothing
        named = F.transform(near, lambda x: F.xxhash64(F.col("key"), x))
        keys = F.when(F.col("segment") == i, named) if keys is None else keys.when(F.col("segment") == i, named)
    return keys


def _blocks(most_filed: int) -> Column:
    """The keys of the pairs of blocks that a row of a dense file belongs to."""
    blocks = F.ceil(F.col("n") / F.lit(most_filed / 2)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit("block")), blocks).cast("int")
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.xxhash64(F.col("key"), F.least(x, own), F.greatest(x, own)))


def _filed(fingerprints: DataFrame, limit: int) -> DataFrame:
    """(fp, key, segment): every fingerprint in all its files, in as many parts as a shuffle has.

    Few rows become many here. They are dealt by a hash of `fp`: a frame that is dealt by `fp`
    already, into few parts as its rows are few, would be taken as it is.
    """
    tasks = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        fingerprints.repartition(tasks, F.xxhash64("fp"))
        .select("fp", F.explode(_files(F.col("fp"), limit)).alias("key"))
        .withColumn("segment", F.shiftrightunsigned("key", 58).cast("int"))
    )


def links(fingerprints: DataFrame, limit: int, most_filed: int = MOST_FILED) -> DataFrame:
    """(a, b): links between distinct fingerprints (`fp`) that join every pair of them that
    differs in at most `limit` bits, directly or through others filed under the same key."""
    filed = materialised(_filed(fingerprints, limit))
    sparse, dense = _split(filed, most_filed, _longer_chain(limit))
    if not dense.isEmpty():
        middle, denser = _split(dense, most_filed, _blocks(most_filed))
        sparse = sparse.unionByName(middle)
        if not denser.isEmpty():
            sparse = sparse.unionByName(denser)
    sorted_files = sparse.select("fp", "segment", "key").repartition("key").sortWithinPartitions("key", "fp")
    rings = _rings(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, segment = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch["key"].to_numpy()])
            fps = np.concatenate([fps, batch["fp"].to_numpy()])
            segment = np.concatenate([segment, batch["segment"].to_numpy()])
            # the last key may go on in the next batch
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield _as_batch(_forest(keys[:whole], fps[:whole], segment[:whole], limit, rings))
            keys, fps, segment = keys[whole:], fps[whole:], segment[whole:]
        yield _as_batch(_forest(keys, fps, segment, limit, rings))

    return sorted_files.mapInArrow(run, "a bigint, b bigint").distinct()


def _as_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"]
    )


def _classes(fingerprinted: DataFrame, limit: int) -> DataFrame:
    """(fp, root): every distinct fingerprint and the root of its component."""
    distinct = fingerprinted.select(F.col("__fp").alias("fp")).distinct()
    roots = components(links(distinct, limit))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, width: int, limit: int) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    found = materialised(with_fingerprint(docs.select("doc_id", "text"), width).select("doc_id", "__fp"))
    classes = materialised(_classes(found, limit))
    least = found.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("least"))
    smallest = classes.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialised(join_spread(classes, smallest, "root", ["fp"]).select(F.col("fp").alias("__fp"), "component_id"))
    named = join_spread(found, of, "__fp", ["doc_id"])
    return named.select("doc_id", F.col("__fp").alias("fp"), "component_id")


def keep_one(docs: DataFrame, width: int, limit: int) -> DataFrame:
    """One document of each component: of its smallest doc_id, then of its least text hash."""
    slim = with_fingerprint(docs.select("doc_id", "text"), width)
    found = materialised(slim.select("doc_id", *row_key(), "__fp"))
    first = F.struct(F.col("doc_id").isNull(), "key_id", "key_text")
    kept = (
        found.groupBy(F.col("__fp").alias("fp"))
        .agg(F.min(first).alias("first"))
        .join(_classes(found, limit), "fp")
        .groupBy("root")
        .agg(F.min("first").alias("one"))
        .select(F.col("one.key_id").alias("__one_id"), F.col("one.key_text").alias("__one_text"))
        .distinct()
    )
    id_key, text_key = row_key()
    keyed = docs.withColumns({"__key_id": id_key, "__key_text": text_key})
    same = (F.col("__key_id") == F.col("__one_id")) & (F.col("__key_text") == F.col("__one_text"))
    rows = keyed.join(kept, same, "left_semi").dropDuplicates(["__key_id", "__key_text"])
    return rows.select(*docs.columns)
