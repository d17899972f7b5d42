"""Removal of long repeats, found by recompression.

Words become 64-bit names. A run of equal words gets one name; then rounds of pairing
follow: a hash of a name and the round puts it on the left or the right side, and each
neighbouring left-right pair gets a new name, hashed from the two. Names depend on content
alone, so they are global without a dictionary and every document goes through all rounds
where it lies; no table of names is built or joined. Equal stretches of text get equal
symbols in their interior. Every symbol carries the stretch of words that decides it; a
window of words that holds this stretch has the symbol wherever the window occurs. So a
symbol that occurs once in the whole corpus rules out all windows around it; symbols meet
in one shuffle. What is left is verified on the words: the remaining windows meet by a
128-bit digest of their bytes, those that meet no other are ruled out too, and the words of
the others are removed. A window inside which no symbol is decided, as in a long run, is
never ruled out early, so no repeat is missed; names that happen to be equal only let more
windows through to the digests.

Rows are sent where symbols and windows meet; a symbol or window that already repeats
within the rows a task holds is sent there once, and its other rows are spread, so a
passage that a third of all documents share makes no hot key. Documents of equal words
meet as wholes first, and one of them stands for all in the search for windows. Columns
that differ from row to row lie side by side in what is shuffled, and rows in their order
in the documents, so that a block of rows compresses to little more than its digests.

A row is known by its id where no id has two texts, which is looked up first; a row without
id by 128 bits hashed from its text; and if ids do have several texts, every row by its id
and 64 bits more. Rows of one key are equal rows, and judged alike.

Nulls, ties and the rest: a null text has no words and stays null unless joined; all occurrences of a repeat go, the
first too; fewer words than a window are never touched; rows equal in id and text are each
other's repeat; other columns are kept; no documents give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from staycohort.llm.common import materialised, small_batches

WINDOW = 35
#: Rounds of pairing: symbols of about seven words, decided by about three times as many.
ROUNDS = 7
#: Bytes of text that a task parses at once.
PARSED_BYTES = 2_000_000
#: Bytes of text whose words are named at once; naming takes some 27 bytes for each.
NAMED_BYTES = 1 << 18

_FAR = 1 << 40
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return _mix(a * _U(0x9E3779B97F4A7C15) + _mix(b + _U(salt)))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = _mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))


def word_names(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of some UTF-8 text, hashed from all their bytes, and where each begins."""
    names, begins, start = [], [], 0
    while start < len(data) or not names:
        gap = _GAP.search(data, start + NAMED_BYTES)
        stop = gap.start() if gap else len(data)
        some, at = _names_of_piece(data[start:stop])
        names.append(some)
        begins.append(at + start)
        start = stop
    return np.concatenate(names), np.concatenate(begins)


def _names_of_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    text = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[text]
    change = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begins, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    if not len(begins):
        return np.zeros(0, _U), begins
    sizes = ends - begins
    first = np.cumsum(sizes) - sizes
    powers = np.full(int(sizes.max()), 0x9E3779B97F4A7C15, _U)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    weighted = _LETTER[text[inside]] * powers[np.arange(int(sizes.sum())) - np.repeat(first, sizes)]
    return _mix(np.add.reduceat(weighted, first) + sizes.astype(_U)), begins


def symbols(names: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The last round's symbols of documents laid end to end (`doc`: of each word).

    Returned by position: name, doc, and `low`, `high`: the words that decide the symbol
    are low to high - 1. Where a document's edge decides, low or high is far outside.
    """
    n = len(names)
    if not n:
        return {k: np.zeros(0, np.int64) for k in ("name", "doc", "low", "high")}
    first = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])]))
    length = np.diff(first, append=n)
    name, d = names[first], doc[first]
    name = np.where(length > 1, _pair(name, length.astype(_U), 1), name)
    joined = d[1:] == d[:-1]
    low = np.where(np.concatenate([[False], joined]), first - 1, -_FAR)
    high = np.where(np.concatenate([joined, [False]]), first + length + 1, _FAR)
    for number in range(rounds):
        right = (_mix(name + _U(0xD6E8FEB86659FD93 + number)) >> _U(63)).astype(bool)
        joined = d[1:] == d[:-1]
        merged = np.concatenate([joined & ~right[:-1] & right[1:], [False]])
        absorbed = np.concatenate([[False], merged[:-1]])
        after_low = np.concatenate([np.where(joined, low[1:], _FAR), [_FAR]])
        after_high = np.concatenate([np.where(joined, high[1:], _FAR), [_FAR]])
        before_low = np.concatenate([[-_FAR], np.where(joined, low[:-1], -_FAR)])
        before_high = np.concatenate([[-_FAR], np.where(joined, high[:-1], -_FAR)])
        # a left symbol depends on the next one, a lone right symbol on the one before
        name = np.where(merged, _pair(name, np.append(name[1:], _U(0)), 2), name)
        low, high = (
            np.where(right, np.minimum(low, before_low), np.minimum(low, after_low)),
            np.where(right, np.maximum(high, before_high), np.maximum(high, after_high)),
        )
        keep = ~absorbed
        name, d, low, high = name[keep], d[keep], low[keep], high[keep]
    return {"name": name.view(np.int64), "doc": d, "low": low, "high": high}


def window_digests(data: bytes, places: np.ndarray) -> np.ndarray:
    """The 128-bit digests (two numbers a row) of the windows that begin at these words of a text."""
    words = data.split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[places].tolist(), ends[places + (WINDOW - 1)].tolist(), strict=True)
    return np.frombuffer(b"".join([xxh3_128_digest(joined[a:b]) for a, b in spans]), "<i8").reshape(-1, 2)


def _reversed(places: np.ndarray) -> np.ndarray:
    """Places with their eight bytes in reverse, or back: the low bytes, which differ from row
    to row, then come last, beside the next column's."""
    return places.astype(np.int64).byteswap()


@dataclass(frozen=True)
class _Part:
    """Some rows of a batch, laid end to end: `rows`, `data` of each, and by word its name
    and place in `rows`; `begin` has the first word of each row and the number of all."""

    rows: range
    data: list[bytes]
    names: np.ndarray
    doc: np.ndarray
    begin: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.begin)


def _parts(batch: pa.RecordBatch) -> Iterator[_Part]:
    """Parts of a batch of bounded size; a longer text is a part of its own."""
    data, size, begin = [], 0, 0
    texts = batch["text"]
    for row in range(batch.num_rows):
        data.append((texts[row].as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(data[-1]) + 1
        if size >= PARSED_BYTES or row == batch.num_rows - 1:
            names, at = word_names(b" ".join(data))
            starts = np.cumsum([0, *(len(d) + 1 for d in data)])[:-1]
            doc = np.searchsorted(starts, at, "right") - 1
            yield _Part(range(begin, row + 1), data, names, doc, np.searchsorted(doc, np.arange(len(data) + 1)))
            data, size, begin = [], 0, row + 1


def _whole(data: bytes) -> int:
    """A name for all words of a text together."""
    return int.from_bytes(xxh3_128_digest(b" ".join(data.split()), seed=5)[:8], "little", signed=True)


def _send_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(spread, key_text, place, sym, key_id): symbols by place (reversed) in their document,
    and each document as a whole with place -1. spread: 0 once here, 1 the first of several
    here, from 2 a further one."""
    for batch in batches:
        key_id, key_text = batch["key_id"].to_numpy(), batch["key_text"].to_numpy()
        for part in _parts(batch):
            found = symbols(part.names, part.doc)
            sizes = np.bincount(found["doc"], minlength=len(part.data))
            place = np.arange(len(found["doc"])) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            long = np.flatnonzero(part.sizes >= WINDOW)
            wholes = np.array([_whole(part.data[i]) for i in long], np.int64)
            sym = np.concatenate([found["name"], wholes])
            of = np.concatenate([found["doc"], long]) + part.rows.start
            idx = np.concatenate([place, np.full(len(long), -1)])
            _, first, where, times = np.unique(sym, return_index=True, return_inverse=True, return_counts=True)
            spread = np.where(times[where] == 1, 0, 2 + np.arange(len(sym)))
            spread[first[times > 1]] = 1
            spread[(idx == -1) & (spread > 1)] = 1  # one document in all is to stand for the others
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread, pa.int32()), pa.array(key_text[of]), pa.array(_reversed(idx)), pa.array(sym), pa.array(key_id[of])],
                ["spread", "key_text", "place", "sym", "key_id"],
            )


def _shared_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by symbol, those whose symbol occurs elsewhere. Of documents equal as
    wholes the first gets idx -2, the others -1."""
    pending: pa.RecordBatch | None = None
    last_sym: int | None = None

    def sift(rows: pa.Table, known_before: int | None, following: int | None) -> pa.RecordBatch:
        sym, spread, idx = rows["sym"].to_numpy(), rows["spread"].to_numpy(), _reversed(rows["place"].to_numpy())
        same = sym[1:] == sym[:-1]
        before = np.concatenate([[known_before is not None and sym[0] == known_before], same])
        after = np.concatenate([same, [following is not None and sym[-1] == following]])
        idx = np.where((idx == -1) & ~before, -2, idx)
        keep = before | after | (spread > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[c].to_numpy()[keep]) for c in ("key_id", "key_text")] + [pa.array(idx[keep], pa.int32())],
            ["key_id", "key_text", "idx"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        if pending is not None:
            yield sift(pending, last_sym, batch["sym"][0].as_py())
            last_sym = pending["sym"][-1].as_py()
        pending = batch
    if pending is not None:
        yield sift(pending, last_sym, None)


def _lists(batch: pa.RecordBatch, column: str, rows: range) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in the rows' lists, and the place in `rows` of each."""
    part = batch[column].slice(rows.start, len(rows))
    sizes = np.array([0 if n is None else n for n in part.value_lengths().to_pylist()], np.int64)
    return part.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(rows)), sizes)


def _candidates(part: _Part, shared: np.ndarray, of: np.ndarray) -> np.ndarray:
    """By word, whether the window from there holds no symbol that occurs once in the corpus."""
    found = symbols(part.names, part.doc)
    first = np.searchsorted(found["doc"], np.arange(len(part.data)))
    lone = np.ones(len(found["doc"]), bool)
    inner = shared >= 0
    lone[first[of[inner]] + shared[inner]] = False
    doc = found["doc"][lone]
    last = part.begin[1:][doc] - WINDOW
    start = np.maximum(found["high"][lone] - WINDOW, part.begin[doc])
    stop = np.minimum(found["low"][lone], last) + 1
    real = start < stop
    n = len(part.names) + 1
    ruled_out = np.cumsum(np.bincount(start[real], minlength=n) - np.bincount(stop[real], minlength=n))[:-1]
    return (ruled_out == 0) & (np.arange(len(part.names)) <= part.begin[1:][part.doc] - WINDOW)


def _searched(batch: pa.RecordBatch) -> Iterator[tuple[_Part, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts with their candidate windows, and by row whether it has copies and whether one
    of them searches in its place."""
    for part in _parts(batch):
        shared, of = _lists(batch, "__shared", part.rows)
        copied, first = np.zeros(len(part.data), bool), np.zeros(len(part.data), bool)
        copied[of[shared < 0]] = True
        first[of[shared == -2]] = True
        yield part, _candidates(part, shared, of), copied, copied & ~first


def _send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c, known, key_id, key_text, pos) of the candidate windows; of those that repeat
    here one row, marked as known to repeat."""
    for batch in batches:
        key_id, key_text = batch["__key_id"].to_numpy(), batch["__key_text"].to_numpy()
        for part, windows, _, silent in _searched(batch):
            at = np.flatnonzero(windows & ~silent[part.doc])
            if not len(at):
                continue
            rows, begins = np.unique(part.doc[at], return_index=True)
            pieces = zip(rows.tolist(), np.split(at, begins[1:]), strict=True)
            digests = np.concatenate([window_digests(part.data[i], p - part.begin[i]) for i, p in pieces])
            h, c = digests[:, 0], digests[:, 1]
            order = np.lexsort((c, h))
            differs = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])])
            first = order[differs]
            known = np.diff(np.flatnonzero(differs), append=len(order)) > 1
            in_place = np.argsort(first)
            first, known = first[in_place], known[in_place]
            of = part.doc[at[first]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h[first]),
                    pa.array(c[first]),
                    pa.array(known),
                    pa.array(key_id[of + part.rows.start]),
                    pa.array(key_text[of + part.rows.start]),
                    pa.array(at[first] - part.begin[of], pa.int32()),
                ],
                ["h", "c", "known", "key_id", "key_text", "pos"],
            )


def _send_windows_to_meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(known, key_text, place, h, c, key_id): the rows of `_send_windows`, place reversed."""
    for rows in _send_windows(batches):
        place = pa.array(_reversed(rows["pos"].to_numpy()))
        yield pa.RecordBatch.from_arrays(
            [rows["known"], rows["key_text"], place, rows["h"], rows["c"], rows["key_id"]],
            ["known", "key_text", "place", "h", "c", "key_id"],
        )


def _lone_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by window hash, those that meet no other."""
    pending: pa.RecordBatch | None = None
    before: tuple[int, int] | None = None

    def sift(rows: pa.RecordBatch, before: tuple | None, following: tuple | None) -> pa.RecordBatch:
        h, c = rows["h"].to_numpy(), rows["c"].to_numpy()
        same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        again = np.concatenate([[before == (h[0], c[0])], same]) | np.concatenate([same, [following == (h[-1], c[-1])]])
        keep = ~(again | rows["known"].to_numpy(zero_copy_only=False))
        pos = pa.array(_reversed(rows["place"].to_numpy()[keep]), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[k].to_numpy()[keep]) for k in ("key_id", "key_text")] + [pos], ["key_id", "key_text", "pos"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        if pending is not None:
            yield sift(pending, before, (batch["h"][0].as_py(), batch["c"][0].as_py()))
            before = (pending["h"][-1].as_py(), pending["c"][-1].as_py())
        pending = batch
    if pending is not None:
        yield sift(pending, before, None)


def _covered(part: _Part, windows: np.ndarray, copied: np.ndarray, lone: np.ndarray, of: np.ndarray) -> np.ndarray:
    """By word, whether it lies in a window that occurs elsewhere."""
    repeated = windows.copy()
    repeated[part.begin[of] + lone] = False
    at = np.flatnonzero(repeated)
    n = len(part.names) + WINDOW
    edges = np.bincount(at, minlength=n) - np.bincount(at + WINDOW, minlength=n)
    return (np.cumsum(edges)[: len(part.names)] > 0) | copied[part.doc]


def cut(data: bytes, covered: np.ndarray) -> str:
    """A text without the covered words and the white space after each of them."""
    spans = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    parts = [data[: spans[0]]]
    parts += [data[spans[i] : spans[i + 1]] for i in np.flatnonzero(~covered)]
    return b"".join(parts).decode("utf-8", "surrogatepass")


def _keys(by_id: bool) -> list[Column]:
    """Two numbers that tell rows of different id or text apart; `by_id`: no id has two texts."""
    no_id, text = F.col("doc_id").isNull(), F.xxhash64("text", F.col("text").isNull())
    return [
        F.when(no_id, F.xxhash64(F.lit("no id"), "text")).otherwise(F.col("doc_id").cast("bigint")).alias("key_id"),
        F.when(no_id, text.bitwiseOR(F.lit(1))).otherwise(F.lit(0) if by_id else text.bitwiseAND(F.lit(-2))).cast("bigint").alias("key_text"),
    ]


def _ids_have_one_text(docs: DataFrame) -> bool:
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text", F.col("text").isNull()).alias("h"))
    return texts.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").isEmpty()


def remove_repeats(docs: DataFrame, joined: bool = False) -> DataFrame:
    """`docs` without repeated windows, and n_words, n_removed of each.

    `joined`: a text becomes its kept words with one space between; else what is kept
    stays laid out as it was.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    by_id = _ids_have_one_text(docs)
    texts = docs.select(*_keys(by_id), "text")  # only below do keys stand beside the caller's columns
    sent = texts.mapInArrow(_send_symbols, "spread int, key_text bigint, place bigint, sym bigint, key_id bigint")
    part = F.when(F.col("spread") < 2, 0).otherwise(F.col("spread"))
    met = sent.repartition("sym", part).sortWithinPartitions("sym", "spread", "key_id", "key_text", "place")
    shared = materialised(
        met.mapInArrow(_shared_symbols, "key_id bigint, key_text bigint, idx int")
        .groupBy(F.col("key_id").alias("__key_id"), F.col("key_text").alias("__key_text"))
        .agg(F.collect_set("idx").alias("__shared"))
    )

    id_key, text_key = _keys(by_id)
    keyed = docs.select(*kept).withColumns({"__key_id": id_key, "__key_text": text_key})
    keys = ["__key_id", "__key_text"]
    searched = keyed.join(shared, keys, "left")
    # all columns, so that the texts dealt out by key for this search serve the end again
    windows = searched.mapInArrow(
        _send_windows_to_meet, "known boolean, key_text bigint, place bigint, h bigint, c bigint, key_id bigint"
    )
    lone = (
        windows.repartition("h")
        .sortWithinPartitions("h", "c")
        .mapInArrow(_lone_windows, "key_id bigint, key_text bigint, pos int")
        .groupBy(F.col("key_id").alias("__key_id"), F.col("key_text").alias("__key_text"))
        .agg(F.collect_set("pos").alias("__lone"))
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, totals, removed = [], [], []
            texts = batch["text"]
            for part, windows, copied, _ in _searched(batch):
                covered = _covered(part, windows, copied, *_lists(batch, "__lone", part.rows))
                gone = np.bincount(part.doc[covered], minlength=len(part.data))
                totals += part.sizes.tolist()
                removed += gone.tolist()
                for i, data in enumerate(part.data):
                    own = covered[part.begin[i] : part.begin[i + 1]]
                    if joined:
                        words = data.split()
                        left = b" ".join(words if not gone[i] else [words[k] for k in np.flatnonzero(~own)])
                        out.append(left.decode("utf-8", "surrogatepass"))
                    else:
                        out.append(cut(data, own) if gone[i] else texts[part.rows[i]].as_py())
            columns = {c: batch[c] for c in kept} | {"text": pa.array(out, pa.string())}
            columns |= {"n_words": pa.array(totals, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    fields = docs.select(*kept).schema.fields + [T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")]
    return searched.join(lone, keys, "left").mapInArrow(finish, T.StructType(fields))
