"""Chat formatting over a prefix tree of turns.

Conversations that share their first turns share the nodes of those turns. Each node is
written once, as tokens, in depth-first order within its tree (one tree per first turn),
with position ids that count along its own conversation and the intervals of the packed
sequence that it may attend to: its ancestors'. A conversation is the tokens of its intervals,
and is read back from them alone.

A node belongs to the conversation of least id that passes it, so the nodes that belong to
one conversation are the end of its path, a chain, and a path is a few stretches, each of one
owner: owners never fall along a path, and each further one has a conversation at least as
long, so a path has at most as many stretches as the root of twice the number of turns.
Stretches are sums over the path's nodes by owner; the turns themselves are never gathered.
Chains are sorted by where they leave which others (deepest first, then by id), which is
depth-first order, and a running sum of their lengths places them. The sums are taken within
ranges of that order and then over ranges, and along a chain within blocks of depths and then
over blocks, so neither a tree that holds a third of all conversations nor a conversation
that holds a third of all turns is in one task. To read, intervals and packed nodes meet in
blocks of the packed sequence, and what very many conversations share is dealt out by them.

A turn is written `<|im_start|>role, newline, text<|im_end|>, newline`. A backslash in a
role or text is doubled, one is put after the first character of every control string in
it, and a newline in a role becomes backslash and semicolon; reading undoes this.

Nulls, ties and the rest: rows without a conv_id belong to no conversation and are left
out; a null role or text is empty; turns are ordered by turn (null first), then role and
text joined by a line end, and repeated rows are turns of their own; no conversations give no rows; other
columns are unused.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staycohort.llm.common import join_spread, materialised, small_batches
from staycohort.llm.prefix_trie import named_turns

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that steer one or another chat template; inside texts they are escaped.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED_ROLE = "assistant"
#: Turns of a conversation, and tokens of the packed sequence, that are worked on together.
DEPTHS, BLOCK = 1024, 4096

_FIRST = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\([\\;])?")


def escape(text: str) -> str:
    return _FIRST.sub(r"\g<0>\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"\\": "\\", ";": "\n", None: ""}[m[1]], text) if "\\" in text else text


def parts_of(role: str, text: str) -> tuple[str, str, str]:
    """A written turn: what stands before its text, the text, and what stands after."""
    return f"{START}{escape(role)}".replace("\n", "\\;") + "\n", escape(text), f"{END}\n"


def read_turn(written: str) -> tuple[str, str]:
    """Role and text of a written turn."""
    role, text = written.removeprefix(START).removesuffix(f"{END}\n").split("\n", 1)
    return unescape(role), unescape(text)


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@dataclass(frozen=True)
class ChatTree:
    """`nodes`: node, tree, depth, role, ids, learned (text under the loss mask), text_from
    and text_to (its tokens), start (place in the tree's packed sequence), position (id of
    the first token) and ancestors (intervals of the packed sequence).
    `conversations`: conv_id, tree and its intervals. `paths`: conv_id, depth and node, for
    callers; reading back needs the packed sequence and the intervals only."""

    nodes: DataFrame
    paths: DataFrame
    conversations: DataFrame


def _encoded(nodes: DataFrame, path: str) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            written = [parts_of(r, t) for r, t in zip(batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            ids = [x.ids for x in tokenizer.encode_batch([p for turn in written for p in turn], add_special_tokens=False)]
            heads, bodies, tails = ids[0::3], ids[1::3], ids[2::3]
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in ("node", "owner", "depth", "role")]
                + [
                    pa.array([a + b + c for a, b, c in zip(heads, bodies, tails, strict=True)], pa.list_(pa.int32())),
                    pa.array([len(a) for a in heads], pa.int32()),
                    pa.array([len(a) + len(b) for a, b in zip(heads, bodies, strict=True)], pa.int32()),
                ],
                ["node", "owner", "depth", "role", "ids", "text_from", "text_to"],
            )

    schema = "node binary, owner bigint, depth int, role string, ids array<int>, text_from int, text_to int"
    return nodes.mapInArrow(encode, schema)


def _stretches(steps: DataFrame) -> DataFrame:
    """Per conversation of `steps` (conv_id, depth, owner, size): tree, the stretches of its
    path by owner (owner, depth, size, position) and the sort key of its own chain."""
    by_owner = steps.groupBy("conv_id", "owner").agg(F.min("depth").alias("depth"), F.sum("size").alias("size"))
    paths = by_owner.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "owner", "size"))).alias("path"))
    ends = F.aggregate(
        "path",
        F.array(F.lit(0).cast("bigint")),
        lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x["size"])),
    )
    placed = F.zip_with(
        "path",
        F.slice("ends", 1, F.size("path")),
        lambda x, position: F.struct(x["owner"].alias("owner"), x["depth"].alias("depth"), x["size"].alias("size"), position.alias("position")),
    )
    return paths.withColumn("ends", ends).select(
        "conv_id",
        F.col("path")[0]["owner"].alias("tree"),
        F.flatten(F.transform("path", lambda x: F.array(-x["depth"].cast("bigint"), x["owner"]))).alias("order"),
        placed.alias("stretches"),
    )


def _chain_starts(stretches: DataFrame) -> DataFrame:
    """(owner, start, position): where each chain begins in its tree's packed sequence."""
    last = F.element_at("stretches", -1)
    chains = stretches.where(last["owner"] == F.col("conv_id")).select(
        "tree", "order", F.col("conv_id").alias("owner"), last["size"].alias("size"), last["position"].alias("position")
    )
    # the part is stored with the rows, so both sums below see the same ranges
    ranged = materialised(chains.repartitionByRange("tree", "order").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("tree", "part").agg(F.sum("size").alias("all"))
    over_parts = Window.partitionBy("tree").orderBy("part")
    before = sums.select("tree", "part", (F.sum("all").over(over_parts) - F.col("all")).alias("before"))
    inside = Window.partitionBy("tree", "part").orderBy("order")
    return ranged.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(before, ["tree", "part"]).select(
        "owner", "position", (F.col("before") + F.col("inside")).alias("start")
    )


def _ahead(encoded: DataFrame) -> DataFrame:
    """Nodes with `ahead`: the tokens of their chain before them, summed in blocks of depths."""
    size = F.size("ids").cast("bigint")
    blocks = encoded.withColumn("depths", F.expr(f"depth div {DEPTHS}"))
    sums = blocks.groupBy("owner", "depths").agg(F.sum(size).alias("all"))
    over_blocks = Window.partitionBy("owner").orderBy("depths")
    before = sums.select("owner", "depths", (F.sum("all").over(over_blocks) - F.col("all")).alias("before"))
    inside = Window.partitionBy("owner", "depths").orderBy("depth")
    return (
        blocks.withColumn("inside", F.sum(size).over(inside) - size)
        .join(before, ["owner", "depths"])
        .withColumn("ahead", F.col("before") + F.col("inside"))
        .drop("depths", "before", "inside")
    )


def format_conversations(conversations: DataFrame, tokenizer_path: str) -> ChatTree:
    """The packed trees of all conversations."""
    small_batches(conversations.sparkSession)
    turns = named_turns(conversations, with_texts=True).select(
        "conv_id", (F.col("place") - 1).cast("int").alias("depth"), F.col("name").alias("node"), "role", "text"
    )
    owners = turns.groupBy("node").agg(F.min("conv_id").alias("owner"))
    paths = materialised(join_spread(turns.select("conv_id", "depth", "node"), owners, "node", ["conv_id"]))
    # a node's text is its owner's; the owner passes it at one depth
    owned = paths.where(F.col("owner") == F.col("conv_id")).select("conv_id", "depth", "node", "owner")
    texts = turns.select("conv_id", "depth", "role", "text").join(owned, ["conv_id", "depth"])
    encoded = materialised(_encoded(texts.select("node", "owner", "depth", "role", "text"), tokenizer_path))

    sizes = encoded.select("node", F.size("ids").cast("bigint").alias("size"))
    stretches = materialised(_stretches(join_spread(paths, sizes, "node", ["conv_id"])))
    starts = materialised(_chain_starts(stretches))

    passed = stretches.select("conv_id", "tree", F.posexplode("stretches").alias("nth", "one")).withColumn("owner", F.col("one.owner"))
    placed = materialised(
        join_spread(passed, starts.select("owner", "start"), "owner", ["conv_id"])
        .groupBy("conv_id", "tree")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("nth", "start", (F.col("start") + F.col("one.size")).alias("stop")))),
                lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")),
            ).alias("intervals")
        )
    )
    of_chain = starts.join(placed.withColumnRenamed("conv_id", "owner"), "owner")
    nodes = (
        join_spread(_ahead(encoded), of_chain, "owner", ["depth"])
        .withColumn("start_here", F.col("start") + F.col("ahead"))
        .withColumn("above", F.slice("intervals", 1, F.size("intervals") - 1))
        .select(
            "node",
            "tree",
            "depth",
            "role",
            "ids",
            (F.col("role") == LEARNED_ROLE).alias("learned"),
            "text_from",
            "text_to",
            F.col("start_here").alias("start"),
            (F.col("position") + F.col("ahead")).alias("position"),
            F.when(F.col("ahead") == 0, F.col("above"))
            .otherwise(F.concat("above", F.array(F.struct(F.col("start").alias("start"), F.col("start_here").alias("stop")))))
            .alias("ancestors"),
        )
    )
    return ChatTree(materialised(nodes), paths.select("conv_id", "depth", "node"), placed)


def _read_intervals(tree: ChatTree) -> DataFrame:
    """(conv_id, position, ids, learned, text_from, text_to): what lies in a conversation's intervals.

    Intervals and nodes meet in blocks of the packed sequence; the blocks that very many
    conversations see are repeated for up to 64 parts of them.
    """
    tokens = F.size("ids").cast("bigint")
    packed = tree.nodes.select("tree", "start", "position", "ids", "learned", "text_from", "text_to", (F.col("start") + tokens).alias("stop"))
    blocks = packed.groupBy("tree", F.expr(f"start div {BLOCK}").alias("block")).agg(
        F.collect_list(F.struct("start", "stop", "position", "ids", "learned", "text_from", "text_to")).alias("held")
    )
    one = tree.conversations.select("conv_id", "tree", F.inline("intervals")).where("start < stop")
    asked = one.withColumn("block", F.explode(F.expr(f"sequence(start div {BLOCK}, (stop - 1) div {BLOCK})")))
    keyed = asked.withColumn("seen", F.struct("tree", "block")).drop("tree", "block")
    held = blocks.select(F.struct("tree", "block").alias("seen"), "held")
    inside = F.filter("held", lambda x: (x["start"] >= F.col("start")) & (x["stop"] <= F.col("stop")))
    return join_spread(keyed, held, "seen", ["conv_id"]).select("conv_id", F.inline(inside).alias(*_HELD)).drop("start", "stop")


_HELD = ("start", "stop", "position", "ids", "learned", "text_from", "text_to")


def read_back(tree: ChatTree, tokenizer_path: str) -> DataFrame:
    """Per conversation, from the packed tokens in its intervals: conv_id, n_turns, turns_sha256
    (of role, newline, text, newline a turn), loss_chars and loss_sha256 (of the text under the
    loss mask), formatted_chars (code points of the written turns). Position ids must count its
    tokens without a gap; else ValueError."""
    rows = _read_intervals(tree).repartition("conv_id").sortWithinPartitions("conv_id", "position")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        current, state, following = None, None, 0

        def closed(done: list) -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [[]] * len(names)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        def row(conv: int, state: list) -> tuple:
            return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            done = []
            ids = batch["ids"].to_pylist()
            begin, stop = batch["text_from"].to_numpy(), batch["text_to"].to_numpy()
            written = tokenizer.decode_batch(ids, skip_special_tokens=False)
            masked = tokenizer.decode_batch([x[a:b] for x, a, b in zip(ids, begin, stop, strict=True)], skip_special_tokens=False)
            told = zip(batch["conv_id"].to_pylist(), batch["position"].to_pylist(), ids, written, masked, batch["learned"].to_pylist(), strict=True)
            for conv, position, tokens, turn, inside, learned in told:
                if conv != current:
                    if state is not None:
                        done.append(row(current, state))
                    current, state, following = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], 0
                if position != following:
                    raise ValueError(f"conversation {conv}: a turn at position {position} follows {following} tokens")
                following += len(tokens)
                role, text = read_turn(turn)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[4] += len(turn)
                if learned:
                    text = unescape(inside)
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
            yield closed(done)
        yield closed([row(current, state)] if state is not None else [])

    return rows.mapInArrow(
        read,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
