"""Language-model scores by the likelihood of every segmentation into subwords.

The pieces are those of an existing `sentencepiece` vocabulary. Its scores, which rank the
pieces, start a unigram model; rounds of expectation maximisation over all training words
re-estimate it. A text is a sequence of words and an end; a piece that begins a word
carries the mark of a space, so no piece crosses from word to word and the lattice of a
text is the chain of its words' lattices. A word's probability is summed over all its
segmentations by a forward recursion in logarithms, once for each distinct word of the
corpus; a text's is the product of its words' and the end's. A character that is no piece
is spelled by its byte pieces.

Word counts hold every word and live in a table. Texts meet them in two ways: the most
frequent words, at most `HEAD_WORDS`, are broadcast, those longer than `HEAD_BYTES` by their
SHA-256; every other word of a text is joined with the table, where it is rare by construction
and so no join key is hot.

Nulls, ties and the rest: a null or empty text is the end alone; A-Z are lower-cased; a
null id belongs to the training rows unless said otherwise by the caller's `held_out`;
repeated rows are scored alike, each giving a row; without training rows the model is the
vocabulary's own ranking; other columns are unused.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycohort.llm.common import materialised, row_key, small_batches

#: Frequent words that are broadcast at most, and the longest in bytes that are not named by a digest.
HEAD_WORDS, HEAD_BYTES = 150_000, 64
#: Distinct words that a task counts before it hands them on.
COUNTED_WORDS = 300_000
#: Words whose lattices are worked out together, and cells (words by length) at once.
GATHERED_WORDS, LATTICE_CELLS = 20_000, 400_000
ROUNDS = 2
_SMOOTHING = 0.1
_SPACE = "▁"
_CHARACTER_BITS = 21
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


@dataclass(frozen=True)
class Pieces:
    """A vocabulary as a trie of characters. Step k goes by character `steps[k] % 2**21` from
    node `steps[k] >> 21` to node k + 1, node 0 being the root; `piece` is the id at each
    node, -1 for none; `spelled`: ids of the byte pieces; `end`: the id of the end of a
    text; `log_p`: natural logarithms by id."""

    steps: np.ndarray
    reached: np.ndarray
    piece: np.ndarray
    spelled: np.ndarray
    end: int
    log_p: np.ndarray

    def weighted(self, log_p: np.ndarray) -> Pieces:
        return replace(self, log_p=log_p)

    def step(self, nodes: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The nodes reached, -1 where no piece goes on so."""
        wanted = (nodes << _CHARACTER_BITS) | characters
        at = np.minimum(np.searchsorted(self.steps, wanted), len(self.steps) - 1)
        return np.where(self.steps[at] == wanted, self.reached[at], -1)


def load_pieces(path: str) -> Pieces:
    """The vocabulary of a sentencepiece model; the piece of rank r starts at odds 1 / (r + 10)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    steps: dict[int, int] = {}
    piece = [-1]
    for i in range(n):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
            continue
        node = 0
        for character in model.id_to_piece(i):
            key = (node << _CHARACTER_BITS) | ord(character)
            if key not in steps:
                steps[key] = len(piece)
                piece.append(-1)
            node = steps[key]
        piece[node] = i
    keys = np.array(sorted(steps), np.int64)
    by_score = np.argsort([-model.get_score(i) for i in range(n)], kind="stable")
    odds = np.empty(n)
    odds[by_score] = 1 / (np.arange(n) + 10.0)
    spelled = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    return Pieces(
        keys, np.array([steps[k] for k in keys.tolist()]), np.array(piece), spelled, model.eos_id(), np.log(odds / odds.sum())
    )


class Lattices:
    """The lattices of words of one length, with all forward sums.

    `ending[e]` holds (start, rows, ids): the words in which a piece lies between two
    positions, and which piece. `bytes_of[e]` holds (rows, ids a row) for the characters
    before e that are no piece and are spelled in bytes.
    """

    def __init__(self, characters: np.ndarray, pieces: Pieces) -> None:
        count, size = characters.shape
        self.pieces, self.size = pieces, size
        self.ending: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(size + 1)]
        self.bytes_of: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(size + 1)]
        for start in range(size):
            rows, nodes = np.arange(count), np.zeros(count, np.int64)
            for end in range(start + 1, size + 1):
                nodes = pieces.step(nodes, characters[rows, end - 1])
                alive = nodes >= 0
                rows, nodes = rows[alive], nodes[alive]
                if not len(rows):
                    break
                ids = pieces.piece[nodes]
                whole = ids >= 0
                if whole.any():
                    self.ending[end].append((start, rows[whole], ids[whole]))
            single = np.zeros(count, bool)
            if self.ending[start + 1] and self.ending[start + 1][-1][0] == start:
                single[self.ending[start + 1][-1][1]] = True
            for character in np.unique(characters[~single, start]):
                rows = np.flatnonzero(~single & (characters[:, start] == character))
                spelled = chr(character).encode("utf-8", "surrogatepass")
                self.bytes_of[start + 1].append((rows, pieces.spelled[list(spelled)]))
        self.forward = np.full((count, size + 1), -np.inf)
        self.forward[:, 0] = 0
        for end in range(1, size + 1):
            for start, rows, ids in self.ending[end]:
                reach = self.forward[rows, start] + pieces.log_p[ids]
                self.forward[rows, end] = np.logaddexp(self.forward[rows, end], reach)
            for rows, ids in self.bytes_of[end]:
                reach = self.forward[rows, end - 1] + pieces.log_p[ids].sum()
                self.forward[rows, end] = np.logaddexp(self.forward[rows, end], reach)

    def add_expected(self, times: np.ndarray, into: np.ndarray) -> None:
        """Add to `into` how often each piece is expected in `times` copies of the words."""
        log_p, forward = self.pieces.log_p, self.forward
        share = np.zeros_like(forward)  # copies whose segmentation has a border here
        share[:, -1] = times
        for end in range(self.size, 0, -1):
            for start, rows, ids in self.ending[end]:
                part = share[rows, end] * np.exp(forward[rows, start] + log_p[ids] - forward[rows, end])
                share[rows, start] += part
                np.add.at(into, ids, part)
            for rows, ids in self.bytes_of[end]:
                part = share[rows, end] * np.exp(forward[rows, end - 1] + log_p[ids].sum() - forward[rows, end])
                share[rows, end - 1] += part
                np.add.at(into, ids, part.sum())


def lattices(found: list[bytes], pieces: Pieces) -> Iterator[tuple[np.ndarray, Lattices]]:
    """Places in `found` and the lattices of the words there, by length, in bounded parts."""
    texts = [_SPACE + w.decode("utf-8", "surrogatepass") for w in found]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for size in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == size)
        most = max(1, LATTICE_CELLS // size)
        for k in range(0, len(places), most):
            part = places[k : k + most]
            data = "".join([texts[i] for i in part]).encode("utf-32-le", "surrogatepass")
            yield part, Lattices(np.frombuffer(data, "<u4").reshape(len(part), size).astype(np.int64), pieces)


def log_likelihoods(found: list[bytes], pieces: Pieces) -> np.ndarray:
    """Natural logarithms of the words' probabilities over all their segmentations."""
    out = np.zeros(len(found))
    for places, lattice in lattices(found, pieces):
        out[places] = lattice.forward[:, -1]
    return out


def expected_counts(found: list[bytes], times: np.ndarray, pieces: Pieces) -> np.ndarray:
    """How often each piece is expected in so many copies of each word."""
    into = np.zeros(len(pieces.log_p))
    for places, lattice in lattices(found, pieces):
        lattice.add_expected(times[places], into)
    return into


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, so that many words of one length meet."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= GATHERED_WORDS:
            yield pa.Table.from_batches(kept)
            kept = []
    if kept:
        yield pa.Table.from_batches(kept)


def word_counts(docs: DataFrame, held_out: Column) -> DataFrame:
    """(word, trained, other): occurrences in training rows and in held-out rows."""
    small_batches(docs.sparkSession)

    def as_batch(train: Counter, other: Counter) -> pa.RecordBatch:
        names = list(train.keys() | other.keys())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.binary()),
                pa.array([train[w] for w in names], pa.int64()),
                pa.array([other[w] for w in names], pa.int64()),
            ],
            ["word", "trained", "other"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, out in zip(batch["text"], batch["out"], strict=True):
                counters[bool(out.as_py())].update(words(text.as_py()))
            if len(counters[0]) + len(counters[1]) > COUNTED_WORDS:
                yield as_batch(*counters)
                counters = (Counter(), Counter())
        yield as_batch(*counters)

    partial = docs.select("text", held_out.alias("out")).mapInArrow(count, "word binary, trained bigint, other bigint")
    return partial.groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("other").alias("other"))


def fit(counts: DataFrame, texts: int, pieces: Pieces, rounds: int = ROUNDS) -> Pieces:
    """The model after `rounds` of expectation maximisation over the training words.

    Each round sends one number per piece of the vocabulary to the driver.
    """
    trained = counts.where("trained > 0").select("word", "trained")
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], pieces: Pieces = pieces) -> Iterator[pa.RecordBatch]:
            into = np.zeros(len(pieces.log_p))
            for table in _gathered(batches):
                into += expected_counts(table["word"].to_pylist(), table["trained"].to_numpy().astype(float), pieces)
            at = np.nonzero(into)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(into[at])], ["piece", "n"])

        summed = trained.mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        expected = np.full(len(pieces.log_p), _SMOOTHING)
        for row in summed:
            expected[row["piece"]] += row["n"]
        expected[pieces.end] += texts
        pieces = pieces.weighted(np.log(expected / expected.sum()))
    return pieces


def with_likelihood(counts: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, trained, log_p) of every distinct word; log_p to base 10."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            found = log_likelihoods(table["word"].to_pylist(), pieces) / math.log(10)
            yield from table.append_column("log_p", pa.array(found, pa.float64())).to_batches()

    return counts.select("word", "trained").mapInArrow(run, "word binary, trained bigint, log_p double")


def _head_limit(counts: DataFrame) -> int:
    """The least number of occurrences that at most HEAD_WORDS words reach."""
    total = F.col("trained") + F.col("other")
    sizes = counts.groupBy(F.floor(F.log2(total) * 16).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
    kept, limit = 0, math.inf
    for row in sorted(sizes, key=lambda r: -r["size"]):
        kept += row["n"]
        if kept > HEAD_WORDS:
            break
        limit = row["size"]
    return limit


def _head_name(word: bytes) -> bytes:
    """What a word is called in the broadcast head; a digest begins with a space, as no word does."""
    return word if len(word) <= HEAD_BYTES else b" " + hashlib.sha256(word).digest()


def _head_name_column() -> Column:
    digest = F.concat(F.lit(bytearray(b" ")), F.unhex(F.sha2("word", 256)))
    return F.when(F.length("word") <= HEAD_BYTES, F.col("word")).otherwise(digest)


@dataclass(frozen=True)
class Totals:
    """Training tokens, distinct ones, and training texts; a text's end is a token."""

    tokens: int
    distinct: int
    texts: int

    def base(self, count: int) -> float:
        return math.log10((count + 1) / (self.tokens + self.distinct + 1))


def totals(counts: DataFrame, texts: int) -> Totals:
    row = counts.agg(F.sum("trained").alias("n"), F.sum((F.col("trained") > 0).cast("bigint")).alias("v")).first()
    return Totals((row["n"] or 0) + texts, (row["v"] or 0) + (texts > 0), texts)


def scored(docs: DataFrame, held_out: Column, pieces: Pieces, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = materialised(word_counts(source, F.col("held_out")))
    total = totals(counts, source.where(~F.col("held_out")).count())
    model = fit(counts, total.texts, pieces, rounds)

    limit = _head_limit(counts)
    size = F.floor(F.log2(F.col("trained") + F.col("other")) * 16)
    in_head = size >= F.lit(limit)
    head = with_likelihood(counts.where(in_head), model).select(_head_name_column(), "trained", "log_p").collect()
    shared = docs.sparkSession.sparkContext.broadcast({bytes(w): (int(c > 0), total.base(c), p) for w, c, p in head})
    end_known, end_base = int(total.texts > 0), total.base(total.texts)
    end_log_p = float(model.log_p[model.end]) / math.log(10)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            keys = zip(*[batch[c].to_pylist() for c in ("key_id", "key_text", "text")], strict=True)
            for key_id, key_text, text in keys:
                n, known, base, score = 1, end_known, end_base, end_log_p
                for word, times in Counter(words(text)).items():
                    n += times
                    found = frequent.get(_head_name(word))
                    if found is None:
                        for column, value in zip(columns, (key_id, key_text, word, times, 0, 0, 0.0, 0.0), strict=True):
                            column.append(value)
                    else:
                        known += times * found[0]
                        base += times * found[1]
                        score += times * found[2]
                # the text's own row: its word holds a space, as no word of a text does
                own = b" " + struct.pack("<qq", key_id, key_text)
                for column, value in zip(columns, (key_id, key_text, own, 0, n, known, base, score), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = ["key_id", "key_text", "word", "times", "n", "known", "base", "score"]
    kinds = ("bigint", "bigint", "binary", "bigint", "bigint", "bigint", "double", "double")
    id_key, text_key = row_key()
    met = source.select(id_key, text_key, "text").mapInArrow(meet, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    rare = with_likelihood(counts.where(~in_head), model).withColumnRenamed("word", "rare_word")
    base = F.log10((F.col("trained") + 1) / F.lit(float(total.tokens + total.distinct + 1)))
    summed = (
        met.join(rare, F.col("word") == F.col("rare_word"), "left")
        .groupBy("key_id", "key_text")
        .agg(
            F.sum((F.col("times") == 0).cast("bigint")).alias("copies"),
            F.sum("n").alias("n"),
            F.sum(F.col("known") + F.col("times") * F.coalesce((F.col("trained") > 0).cast("bigint"), F.lit(0))).alias("known"),
            F.sum(F.col("base") + F.col("times") * F.coalesce(base, F.lit(0.0))).alias("base"),
            F.sum(F.col("score") + F.col("times") * F.coalesce("log_p", F.lit(0.0))).alias("score"),
        )
    )
    return source.select("doc_id", "held_out", id_key, text_key).join(summed, ["key_id", "key_text"]).select(
        "doc_id",
        "held_out",
        (F.col("n") / F.col("copies")).cast("bigint").alias("n_tokens"),
        (F.col("known") / F.col("copies")).cast("bigint").alias("n_known"),
        F.lit(total.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
    )
