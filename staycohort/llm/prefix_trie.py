"""The trie of conversation prefixes, as balanced parentheses cut into shards.

Every distinct sequence of first turns is a node. A node is named by a polynomial of its turns'
hashes modulo 2^127 - 1, so names of stretches join: the turns of a conversation are numbered and
named within ranges of all turns, and what lies before a range is added, so a conversation that
holds a third of all turns is spread over tasks.

A node belongs to the conversation of least id that passes it; the nodes of one conversation are
the end of its path, a chain. Chains are sorted by where they leave which others (deepest first,
then by id), which is depth-first order, and the sums of their lengths number all nodes in
preorder. A shard is a range of these numbers, so all shards are alike large whatever is common.

A shard writes its nodes as parentheses: one opens a node, and between a node and the next those
close that the next one does not lie below. The running excess of open ones is kept with the
least and greatest of its blocks; findclose, the first place behind with less excess, climbs over
blocks that stay above. Between a node and its close, counts of `()` pairs are its leaves, and
cumulative savings of the opened nodes its savings. What stays open at a shard's end is a spine
that later shards share: a shard keeps, for every parenthesis of earlier shards that it closes,
what it had counted until then, and a spine's node adds that of the shard which closes it and
the totals of the shards between. A shard also closes what the first node after it does not lie
below, so the first shard behind whose own or next node is not below a node closes that.

Nulls, ties and the rest: rows without a conv_id belong to no conversation; a null role or text is
empty; turns are ordered by turn (null first), then by role and text joined by a line end;
repeated rows are turns of their own; a conversation without turns is a member of the root; no
conversations give no rows; other columns are unused; remainders of negative ids are those of SQL.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staycohort.llm.common import materialised, small_batches
from staycohort.llm.excess import RangeMinMax

#: Nodes of a shard, and shards whose totals reach every task.
SHARD_NODES, MOST_SHARDS = 1 << 15, 50_000
#: Turns that a conversation may take over from another one.
MOST_TAKEN = 8
#: Parts in which conversations that pass a node meet; depths and ids that are joined at once.
PARTS, DEPTHS, IDS = 256, 4096, 4096

_PRIME = (1 << 127) - 1
_BASE = int.from_bytes(hashlib.blake2b(b"conversation prefix", digest_size=15).digest(), "little")
_ROOT = bytes(16)


def _powers(most: int = 512) -> list[int]:
    out = [1]
    for _ in range(most):
        out.append(out[-1] * _BASE % _PRIME)
    return out


_POWER = _powers()


def _shifted(name: int, turns: int) -> int:
    """What a prefix of this name adds to the name of a sequence that has `turns` more turns."""
    return name * (_POWER[turns] if turns < len(_POWER) else pow(_BASE, turns, _PRIME)) % _PRIME


def _number(name: bytes | None) -> int:
    return int.from_bytes(name or b"", "little")


def _name(number: int) -> bytes:
    return number.to_bytes(16, "little")


def turn_hash(role: str, text: str) -> int:
    said = role.encode("utf-8", "surrogatepass")
    data = len(said).to_bytes(8, "little") + said + text.encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, digest_size=15).digest(), "little") + 1


def named_turns(conversations: DataFrame, with_texts: bool = False) -> DataFrame:
    """(conv_id, part, place, name, size), stored: of each turn its place from 1, the name of
    its conversation's turns up to it, and the bytes of its text. `part`: a range of all turns.
    `with_texts`: role and text, too."""
    empty = F.lit("")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    order = F.concat("role", F.lit("\n"), "text")
    ranged = (
        rows.withColumn("order", F.substring(order, 1, 40))
        .repartitionByRange("conv_id", "turn", "order")
        .drop("order")
        .withColumn("part", F.spark_partition_id())
        .sortWithinPartitions("conv_id", "turn", order)
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, name = None, 0, 0
        for batch in batches:
            places, names, sizes = [], [], []
            for conv, role, text in zip(*[batch[c].to_pylist() for c in ("conv_id", "role", "text")], strict=True):
                if conv != current:
                    current, place, name = conv, 0, 0
                place, name = place + 1, (name * _BASE + turn_hash(role, text)) % _PRIME
                places.append(place)
                names.append(_name(name))
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
            columns = [pa.array(places, pa.int64()), pa.array(names, pa.binary()), pa.array(sizes, pa.int64())]
            said = [batch[c] for c in texts]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["part"], *columns, *said], ["conv_id", "part", "place", "name", "size", *texts])

    texts = ["role", "text"] if with_texts else []
    schema = ", ".join(["conv_id bigint, part int, place bigint, name binary, size bigint", *(f"{c} string" for c in texts)])
    walked = materialised(ranged.mapInArrow(walk, schema))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before, name = None, 0, 0
        for batch in batches:
            out = []
            for conv, part, n, own in zip(*[batch[c].to_pylist() for c in ("conv_id", "part", "n", "name")], strict=True):
                if conv != current:
                    current, before, name = conv, 0, 0
                out.append((conv, part, before, _name(name)))
                before, name = before + n, (_shifted(name, n) + _number(own)) % _PRIME
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "before", "name_before"])

    ends = walked.groupBy("conv_id", "part").agg(F.max("place").alias("n"), F.max_by("name", "place").alias("name"))
    starts = (
        ends.repartition("conv_id")
        .sortWithinPartitions("conv_id", "part")
        .mapInArrow(carry, "conv_id bigint, part int, before bigint, name_before binary")
    )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch["name"].to_pylist()
            for i, b in enumerate(batch["before"].to_pylist()):
                if b:
                    old = _shifted(_number(batch["name_before"][i].as_py()), batch["place"][i].as_py())
                    names[i] = _name((old + _number(names[i])) % _PRIME)
            place = pa.array(batch["before"].to_numpy() + batch["place"].to_numpy())
            columns = [batch["conv_id"], batch["part"], place, pa.array(names, pa.binary()), batch["size"], *(batch[c] for c in texts)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "place", "name", "size", *texts])

    joined = walked.join(starts, ["conv_id", "part"]).select("conv_id", "part", "place", "name", "size", *texts, "before", "name_before")
    return materialised(joined.mapInArrow(settle, schema))


_PLAN = (
    "conv_id bigint, taken bigint, kept bigint, shift binary, ends binary, "
    "firsts array<struct<depth: bigint, node: binary, size: bigint>>"
)


def _plans(turns: DataFrame, base: Column, taken: Column) -> DataFrame:
    """Per conversation, stored: how many turns are taken over from another one, how many it
    has of them, those turns, what they add to the names of the own turns that follow, and the
    name of the whole."""
    first = F.when(F.col("place") <= MOST_TAKEN, F.struct("place", "name", "size"))
    known = turns.groupBy("conv_id").agg(
        F.max("place").alias("n"), F.max_by("name", "place").alias("whole"), F.array_sort(F.collect_list(first)).alias("own")
    )
    own = known.select("conv_id", "n", "whole", "own", base.cast("bigint").alias("base"), taken.cast("bigint").alias("taken"))
    others = known.select(F.col("conv_id").alias("base"), F.col("own").alias("other"))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                taken, n = row["taken"], row["n"]
                if not 0 <= taken <= MOST_TAKEN:
                    raise ValueError(f"a conversation takes over 0 to {MOST_TAKEN} turns, not {taken}")
                firsts = (row["other"] or [])[:taken]
                joint = _number(firsts[-1]["name"]) if firsts else 0
                cut = _number(row["own"][taken - 1]["name"]) if 0 < taken <= n else 0
                shift = (joint - cut) % _PRIME
                ends = (_number(row["whole"]) + _shifted(shift, n - taken)) % _PRIME if n > taken else joint
                out.append(
                    {
                        "conv_id": row["conv_id"],
                        "taken": taken,
                        "kept": len(firsts),
                        "shift": _name(shift),
                        "ends": _name(ends),
                        "firsts": [{"depth": x["place"], "node": x["name"], "size": x["size"]} for x in firsts],
                    }
                )
            step = pa.struct([("depth", pa.int64()), ("node", pa.binary()), ("size", pa.int64())])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(step)]
            names = ["conv_id", "taken", "kept", "shift", "ends", "firsts"]
            yield pa.RecordBatch.from_pylist(out, pa.schema(list(zip(names, kinds, strict=True))))

    return materialised(own.join(others, "base", "left").mapInArrow(plan, _PLAN))


def _steps(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, depth, node, size), stored: every node but the root that a conversation passes."""
    firsts = plans.select("conv_id", F.inline("firsts"))
    # a conversation's plan meets its turns range by range, so a long one is spread
    of_part = turns.select("conv_id", "part").distinct().join(plans.select("conv_id", "taken", "kept", "shift"), "conv_id")
    own = turns.join(of_part, ["conv_id", "part"]).where(F.col("place") > F.col("taken"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, taken = batch["place"].to_numpy(), batch["taken"].to_numpy()
            names = batch["name"].to_pylist()
            for i, (shift, k) in enumerate(zip(batch["shift"].to_pylist(), (place - taken).tolist(), strict=True)):
                if shift != _ROOT:
                    names[i] = _name((_number(names[i]) + _shifted(_number(shift), k)) % _PRIME)
            depth = pa.array(batch["kept"].to_numpy() + place - taken)
            yield pa.RecordBatch.from_arrays([batch["conv_id"], depth, pa.array(names, pa.binary()), batch["size"]], ["conv_id", "depth", "node", "size"])

    own = own.select("conv_id", "place", "name", "size", "taken", "kept", "shift")
    return materialised(firsts.union(own.mapInArrow(follow, "conv_id bigint, depth bigint, node binary, size bigint")))


def _ends_hash(plans: DataFrame) -> DataFrame:
    """(node, ends_sha256) of every node at which a conversation ends; ids meet in blocks."""
    blocks = (
        plans.groupBy(F.col("ends").alias("node"), F.expr(f"conv_id div {IDS}").alias("block"))
        .agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
        .repartition("node")
        .sortWithinPartitions("node", "block")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running = None, hashlib.sha256()

        def sent(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"]
            )

        for batch in batches:
            done = []
            for node, ids in zip(batch["node"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if node == current:
                    running.update(b",")
                else:
                    if current is not None:
                        done.append((current, running.hexdigest()))
                    current, running = node, hashlib.sha256()
                running.update(ids.encode())
            yield sent(done)
        yield sent([(current, running.hexdigest())] if current is not None else [])

    return blocks.mapInArrow(digest, "node binary, ends_sha256 string")


def _preorder(steps: DataFrame, members: int, least: int) -> tuple[DataFrame, int]:
    """All nodes with their preorder numbers, and how many there are.

    (number, node, depth, conv_id, parent_conv_id, n_convs, n_children, size)
    """
    rows = steps.withColumn("part", F.pmod(F.xxhash64("conv_id"), F.lit(PARTS)).cast("int"))
    nodes = (
        rows.groupBy("node", "part")
        .agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n"), F.min("depth").alias("depth"), F.min("size").alias("size"))
        .groupBy("node")
        .agg(
            F.min("owner").alias("owner"), F.sum("n").alias("n_convs"), F.min("depth").alias("depth"),
            F.min("size").alias("size"), F.collect_list("part").alias("parts"),
        )
    )
    nodes = materialised(nodes)
    owners = nodes.select("node", "owner", F.explode("parts").alias("part"))
    # owners never fall along a path, and each further one has a conversation at least as long,
    # so a path of few owners is what is gathered: at most the root of twice the number of turns
    paths = (
        rows.join(owners, ["node", "part"])
        .groupBy("conv_id", "owner")
        .agg(F.min("depth").alias("first"), F.max("depth").alias("last"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("first", "owner", "last"))).alias("path"))
        .withColumn("end", F.element_at("path", -1))
        .where(F.col("end.owner") == F.col("conv_id"))
    )
    chains = paths.select(
        F.col("conv_id").alias("owner"),
        F.col("end.first").alias("first"),
        F.col("end.last").alias("last"),
        F.get("path", F.size("path") - 2)["owner"].alias("above"),
        F.flatten(F.transform("path", lambda x: F.array(-x["first"], x["owner"]))).alias("order"),
    )
    # the part is stored with the rows, so both sums below see the same ranges
    ranged = materialised(chains.repartitionByRange("order").withColumn("part", F.spark_partition_id()))
    length = F.col("last") - F.col("first") + 1
    sums = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum(length).alias("n")).collect())
    before, total = [], 1  # the root is number 0
    for part, n in sums:
        before.append((part, total))
        total += n
    offsets = steps.sparkSession.createDataFrame(before, "part int, before bigint")
    inside = Window.partitionBy("part").orderBy("order")
    numbered = ranged.withColumn("start", F.sum(length).over(inside) - length).join(F.broadcast(offsets), "part")
    of_depths = numbered.select(
        "owner", "first", "last", "above", (F.col("before") + F.col("start")).alias("start"),
        F.explode(F.expr(f"sequence(first div {DEPTHS}, last div {DEPTHS})")).alias("depths"),
    )
    leaving = ranged.groupBy(F.col("above").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("heads"))
    known = nodes.withColumn("depths", F.expr(f"depth div {DEPTHS}")).join(of_depths, ["owner", "depths"])
    known = known.join(leaving.where(F.col("owner").isNotNull()), ["owner", "depth"], "left").select(
        (F.col("start") + F.col("depth") - F.col("first")).alias("number"),
        "node",
        "depth",
        F.col("owner").alias("conv_id"),
        F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.coalesce("above", F.lit(least))).alias("parent_conv_id"),
        "n_convs",
        ((F.col("depth") < F.col("last")).cast("bigint") + F.coalesce("heads", F.lit(0))).alias("n_children"),
        "size",
    )
    tops = ranged.where(F.col("first") == 1).agg(F.count(F.lit(1)).alias("n_children"))
    root = tops.select(
        F.lit(0).cast("bigint").alias("number"), F.lit(_ROOT).alias("node"), F.lit(0).cast("bigint").alias("depth"),
        F.lit(least).cast("bigint").alias("conv_id"), F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.lit(members).cast("bigint").alias("n_convs"), "n_children", F.lit(0).cast("bigint").alias("size"),
    )
    return known.union(root), total


class Parentheses:
    """A shard's nodes, given by their depths in preorder, as parentheses.

    `following`: the depth of the node after the shard (0 behind the last one). Only
    parentheses of the shard's own nodes are written; those of earlier shards that close here
    are `foreign`: (least depth, greatest depth, place before which they close).
    """

    def __init__(self, depth: np.ndarray, following: int) -> None:
        n = len(depth)
        after = np.append(depth[1:], following)
        top = np.minimum.accumulate(depth)  # the least depth whose node is of this shard
        closing = np.maximum(0, depth - np.maximum(after, top) + 1)
        self.opens = np.arange(n) + np.cumsum(closing) - closing
        sign = np.full(n + int(closing.sum()), -1, np.int64)
        sign[self.opens] = 1
        self.excess = np.cumsum(sign)
        self.blocks = RangeMinMax(self.excess)
        pair = np.zeros(len(sign) + 1, np.int64)
        pair[2:] = (sign[:-1] == 1) & (sign[1:] == -1)
        self.pairs = np.cumsum(pair)  # [p]: `()` pairs whose close stands before p
        down = np.flatnonzero(after < top)
        self.foreign = list(zip(after[down].tolist(), (top[down] - 1).tolist(), (self.opens[down] + closing[down] + 1).tolist(), strict=True))

    def find_close(self) -> np.ndarray:
        """Of each node the place of its close; the number of places if it stays open."""
        return self.blocks.first_below(self.opens, self.excess[self.opens])

    def leaves(self, close: np.ndarray) -> np.ndarray:
        """`()` pairs from each node to its close."""
        return self.pairs[np.minimum(close + 1, len(self.excess))] - self.pairs[self.opens]

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """[p]: the weights of nodes that open before place p."""
        out = np.zeros(len(self.excess) + 1, np.int64)
        out[self.opens + 1] = weight
        return np.cumsum(out)


_SHARDED = (
    "shard bigint, node binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, closed_in bigint, to_depth bigint"
)
_SHARD_SCHEMA = pa.schema(
    [(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in _SHARDED.split(", ")]
)


def _shard(rows: pa.RecordBatch, number: int, shards: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of a shard's nodes as far as it goes, and rows without a node for what it had
    counted when it closed nodes of earlier shards. `shards`: (first depth, least depth) of each."""
    depth = rows["depth"].to_numpy().astype(np.int64)
    following = int(shards[number + 1, 0]) if number + 1 < len(shards) else 0
    written = Parentheses(depth, following)
    close = written.find_close()
    saving = (rows["n_convs"].to_numpy() - 1) * rows["size"].to_numpy()
    sums = written.sums(saving)
    saved = sums[np.minimum(close, len(written.excess))] - sums[written.opens]
    is_open = close == len(written.excess)
    closed_in = np.zeros(len(depth), np.int64)
    if is_open.any():
        # from the next shard on, the first one with a node, or one after it, not below this node
        reach = np.minimum(shards[number + 1 :, 1], np.append(shards[number + 2 :, 0], 0))
        least = np.minimum.accumulate(reach)
        closed_in = number + 1 + np.searchsorted(-least, -depth)
    columns = {c: rows[c] for c in ("node", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children")}
    columns |= {
        "shard": pa.array(np.full(len(depth), number)),
        "n_leaves": pa.array(written.leaves(close)),
        "saved_tokens": pa.array(saved),
        "closed_in": pa.array(closed_in, pa.int64(), mask=~is_open),
        "to_depth": pa.nulls(len(depth), pa.int64()),
    }
    yield pa.RecordBatch.from_pydict({c: columns[c] for c in _SHARD_SCHEMA.names}, _SHARD_SCHEMA)
    for low, high, place in written.foreign:
        for start in range(low, high + 1, DEPTHS):
            step = {"shard": number, "depth": start, "to_depth": min(high, start + DEPTHS - 1)}
            step |= {"n_leaves": int(written.pairs[place]), "saved_tokens": int(sums[place])}
            yield pa.RecordBatch.from_pylist([step], _SHARD_SCHEMA)


def _counted(nodes: DataFrame, total: int, shard_nodes: int) -> DataFrame:
    """The nodes with n_leaves and saved_tokens of their subtrees."""
    width = max(shard_nodes, math.ceil(total / MOST_SHARDS))
    placed = materialised(nodes.withColumn("shard", F.expr(f"number div {width}")))
    edges = placed.groupBy("shard").agg(F.min_by("depth", "number").alias("first"), F.min("depth").alias("least"))
    # two numbers a shard, of at most MOST_SHARDS
    shards = np.array([(r["first"], r["least"]) for r in sorted(edges.collect())], np.int64).reshape(-1, 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            number = batch["shard"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[0]["shard"][0].as_py() != int(number[a]):
                    yield from _shard(_joined(held), held[0]["shard"][0].as_py(), shards)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from _shard(_joined(held), held[0]["shard"][0].as_py(), shards)

    found = materialised(placed.repartition("shard").sortWithinPartitions("shard", "number").mapInArrow(count, _SHARDED))
    names = ["node", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    own = found.where(F.col("node").isNotNull())
    leaf, saving = (F.col("n_children") == 0).cast("bigint"), (F.col("n_convs") - 1) * F.col("size")
    totals = sorted(placed.groupBy("shard").agg(F.sum(leaf).alias("l"), F.sum(saving).alias("s")).collect())
    leaves, saved = (np.cumsum([0, *(r[k] for r in totals)]).tolist() for k in ("l", "s"))
    sums = nodes.sparkSession.createDataFrame(
        [(k, leaves[k], saved[k]) for k in range(len(leaves))], "k bigint, sum_leaves bigint, sum_saved bigint"
    )

    def up_to(key: str) -> DataFrame:
        return F.broadcast(sums.select(F.col("k").alias(key), F.col("sum_leaves").alias(f"{key}_leaves"), F.col("sum_saved").alias(f"{key}_saved")))

    closers = found.where(F.col("node").isNull()).select(
        F.col("shard").alias("closed_in"),
        F.explode(F.sequence("depth", "to_depth")).alias("depth"),
        F.col("n_leaves").alias("last_leaves"),
        F.col("saved_tokens").alias("last_saved"),
    )
    spine = (
        own.where(F.col("closed_in").isNotNull())
        .join(closers, ["closed_in", "depth"])
        .withColumn("after", F.col("shard") + 1)
        .join(up_to("after"), "after")
        .join(up_to("closed_in"), "closed_in")
        .withColumn("n_leaves", F.col("n_leaves") + F.col("closed_in_leaves") - F.col("after_leaves") + F.col("last_leaves"))
        .withColumn("saved_tokens", F.col("saved_tokens") + F.col("closed_in_saved") - F.col("after_saved") + F.col("last_saved"))
    )
    return own.where(F.col("closed_in").isNull()).select(*names).union(spine.select(*names))


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def prefix_trie(
    conversations: DataFrame, base: Column | None = None, taken: Column | None = None, shard_nodes: int = SHARD_NODES
) -> DataFrame:
    """One row per node: node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    `base` and `taken`, over conv_id: a conversation's first `taken` turns, at most
    `MOST_TAKEN`, are replaced by those of the conversation `base`.
    """
    small_batches(conversations.sparkSession)
    turns = named_turns(conversations)
    plans = _plans(turns, base if base is not None else F.col("conv_id"), taken if taken is not None else F.lit(0))
    facts = plans.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    nodes, total = _preorder(_steps(turns, plans), facts["n"], facts["least"])
    if not facts["n"]:
        nodes, total = nodes.limit(0), 0
    counted = _counted(nodes, total, shard_nodes).join(_ends_hash(plans), "node", "left")
    nothing = hashlib.sha256().hexdigest()
    return counted.select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
