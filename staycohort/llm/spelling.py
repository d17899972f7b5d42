"""Spelling variants: words one edit apart, grouped under the most frequent spelling.

Words are counted from all texts. Two words that differ by one inserted, deleted or replaced
character agree before it and after it, so, cut in two halves, they agree in one of them: a
word is filed under its first half, to meet words that differ later, and under the rest, to
meet words that differ earlier (once by its own length and once as the longer word of a pair).
What a file does not fix is its stretch. A file of more than `MOST_FILED` words is filed again
with its stretch cut in two, until stretches are one character wide, so no group is large
whatever words are common.

Inside a file the stretches are sorted and scanned by dynamic programming: a word goes down the
sorted list with a band of three columns of its edit matrix, keeps the rows that the next
stretch shares with the last one (their longest common prefix), works out the others, and where
a row has no entry below two skips all stretches that share that prefix. A row of the band has
three entries of 0, 1 or 2 (two or more), so it is one of 27 states, and the next row follows
from the state and from which of three characters agree. All words of a task go down their
lists together. A pair is reported in the one file whose stretch holds the place where the two
words first differ.

Nulls, ties and the rest: a null text has no words; a null id is written as nothing; of near
words equally frequent the smaller in code-point order is the form; repeated rows count again,
each with the deletions of its id; a word without near words has n_near 0; no documents give
no rows; other columns are unused.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from staycohort.llm.common import materialised, small_batches
from staycohort.llm.excess import RangeMinMax

#: Shortest words, least occurrences, and how much more frequent a form must be.
LEAST_LENGTH, LEAST_TIMES, FORM_RATIO = 7, 2, 10
#: One distinct run in so many of a document loses a character.
DELETE_ONE_IN = 31
#: Words of a file that are scanned together; larger files are filed again.
MOST_FILED = 200
#: Words a task holds before it sends their counts on, and rows it scans at once.
KEPT_WORDS, SCANNED_ROWS = 200_000, 60_000
#: Parts of a file that is being filed again.
PARTS = 64

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FILED = "file bigint, part int, length int, low int, high int, word string, n bigint"


def _damaged(run: str, start: int) -> str:
    """The run without one character, if its hash says so. `start`: the hash of what stands before it."""
    h = zlib.crc32(run.encode(), start)
    if h % DELETE_ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n) of all words of at least this length and frequency."""
    small_batches(docs.sparkSession)
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % max(1, least_length))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                if not text.is_valid:
                    continue
                lowered = text.as_buffer().to_pybytes().translate(_LOWER).decode("utf-8", "surrogatepass")
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(runs.findall(lowered)).items():
                    word = _damaged(run, start)
                    if len(word) >= least_length:
                        found[word] += n
                if len(found) >= KEPT_WORDS:
                    yield sent()
                    found.clear()
        yield sent()

    words = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


def _key(word: str, length: int, low: int, high: int) -> int:
    rest = word[len(word) - (length - high) :] if high < length else ""
    return xxh64_intdigest(f"{length} {low} {high} {word[:low]} {rest}") - (1 << 63)


def _file(words: list[str], stretches: list[list[tuple[int, int, int]]], n: pa.Array) -> pa.RecordBatch:
    """Each word in its files: (length of the shorter word of a pair, stretch from, to)."""
    rows = [(_key(w, *s), *s) for w, each in zip(words, stretches, strict=True) for s in each]
    file, length, low, high = zip(*rows, strict=True) if rows else ((), (), (), ())
    of = pa.array(np.repeat(np.arange(len(words)), [len(x) for x in stretches]))
    word = pa.array(words, pa.string()).take(of)
    parts = [zlib.crc32(w.encode()) % PARTS for w in words]
    columns = [pa.array(file, pa.int64()), pa.array(parts, pa.int32()).take(of)]
    columns += [pa.array(x, pa.int32()) for x in (length, low, high)] + [word, n.take(of)]
    return pa.RecordBatch.from_arrays(columns, ["file", "part", "length", "low", "high", "word", "n"])


def _halves(length: int, low: int, high: int) -> list[tuple[int, int, int]]:
    middle = (low + high) // 2
    return [(length, low, middle), (length, middle, high)] if low < middle else [(length, low, high)]


def filed(words: DataFrame, most_filed: int) -> DataFrame:
    """Every word in all its files, each of at most `most_filed` words or a stretch of one character."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = batch["word"].to_pylist()
            yield _file(each, [[s for k in (len(w), len(w) - 1) if k > 0 for s in _halves(k, 0, k)] for w in each], batch["n"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = zip(*[batch[c].to_pylist() for c in ("length", "low", "high")], strict=True)
            yield _file(batch["word"].to_pylist(), [_halves(*s) for s in old], batch["n"])

    rows = materialised(words.select("word", "n").mapInArrow(first, _FILED))
    done = []
    while True:
        # a file's words are counted in parts, and meet the verdict in the same parts
        counts = rows.where("high - low > 1").groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"))
        sizes = counts.groupBy("file").agg(F.sum("n").alias("all"), F.collect_set("part").alias("parts"))
        dense = materialised(sizes.where(F.col("all") > most_filed).select("file", F.explode("parts").alias("part")))
        if dense.isEmpty():
            return _union([*done, rows])
        done.append(rows.join(dense, ["file", "part"], "left_anti").select(*rows.columns))
        of_dense = rows.join(dense, ["file", "part"], "left_semi").select(*rows.columns)
        rows = materialised(of_dense.mapInArrow(again, _FILED))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def _band_table() -> np.ndarray:
    """[state * 8 + agreements]: the next row of the band. A state is its entries in base 3."""
    table = np.zeros(27 * 8, np.uint8)
    for state in range(27):
        old = [state % 3, state // 3 % 3, state // 9]
        for agree in range(8):
            new: list[int] = []
            for k in range(3):
                ways = [old[k] + (not agree >> k & 1)]
                ways += [old[k + 1] + 1] if k < 2 else []
                ways += [new[k - 1] + 1] if k else []
                new.append(min(2, *ways))
            table[state * 8 + agree] = new[0] + 3 * new[1] + 9 * new[2]
    return table


_NEXT_ROW = _band_table()
_ENTRY = np.array([[s % 3, s // 3 % 3, s // 9] for s in range(27)], np.uint8)
#: Row 0 of the band: nothing left of the first column, then 0 and 1.
_TOP_ROW = 2 + 3 * 0 + 9 * 1
#: The row of a word against itself: one off the diagonal on either side.
_SAME_ROW = 1 + 3 * 0 + 9 * 1
_DEAD = 2 + 3 * 2 + 9 * 2


def common_prefixes(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of each stretch and the one before: the length of their common prefix; -1 where a group begins."""
    out = np.full(len(begin) + 1, -1, np.int64)
    left = np.flatnonzero(group[1:] == group[:-1]) + 1
    out[left] = 0
    depth = 0
    while len(left):
        left = left[np.minimum(size[left], size[left - 1]) > depth]
        left = left[flat[begin[left] + depth] == flat[begin[left - 1] + depth]]
        depth += 1
        out[left] = depth
    return out


def near_stretches(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) of stretches of a group, a before b, one edit apart, and their common prefixes.

    Stretches are sorted in each group; `flat` holds one byte before and two after each.
    """
    n = len(begin)
    common = common_prefixes(flat, begin, size, group)
    ahead = RangeMinMax(common)
    bands = np.cumsum(size + 3) - (size + 3)  # rows 0 to size + 1 of each word's band
    rows = np.full(int((size + 3).sum()), _SAME_ROW, np.uint8)
    rows[bands] = _TOP_ROW
    word = np.arange(n)
    at = word + 1
    shared = common[at]
    word, at, shared = word[shared >= 0], at[shared >= 0], shared[shared >= 0]
    prefix = shared.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(word):
        depth = shared.copy()
        state = rows[bands[word] + depth]
        dead = state == _DEAD
        going = np.flatnonzero((depth < size[at]) & ~dead)
        while len(going):
            w, t, d = word[going], at[going], depth[going]
            letter, own = flat[begin[t] + d], begin[w] + d
            agree = (flat[own - 1] == letter) + 2 * (flat[own] == letter) + 4 * (flat[own + 1] == letter)
            new = _NEXT_ROW[state[going] * np.intp(8) + agree]
            d = d + 1
            rows[bands[w] + d] = new
            state[going], depth[going] = new, d
            over = new == _DEAD
            dead[going[over]] = True
            going = going[~over & (d < size[t])]
        column = size[word] - size[at] + 1
        ends = np.flatnonzero(~dead & (column >= 0) & (column <= 2))
        ends = ends[_ENTRY[state[ends], column[ends]] == 1]
        if len(ends):
            found.append((word[ends], at[ends], prefix[ends]))
        following = at + 1
        if dead.any():
            following[dead] = ahead.first_below(following[dead], depth[dead])
        shared = common[following]
        inside = shared >= 0
        word, at, shared = word[inside], following[inside], shared[inside]
        prefix = np.minimum(prefix[inside], shared)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    a, b, c = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b, c


def _pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Links of whole files, rows sorted by file and stretch: (word, near, near_n), both ways."""
    words = batch["word"].to_pylist()
    file, length, low, high = (batch[c].to_numpy().astype(np.int64) for c in ("file", "length", "low", "high"))
    # one byte a character: words hold none beyond U+00FF
    whole = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size) - size
    stretch = size - length + high - low
    flat = np.zeros(int((stretch + 3).sum()), np.uint8)
    begin = np.cumsum(stretch + 3) - (stretch + 3) + 1
    inner = np.arange(int(stretch.sum())) - np.repeat(np.cumsum(stretch) - stretch, stretch)
    flat[np.repeat(begin, stretch) + inner] = whole[np.repeat(first + low, stretch) + inner]
    a, b, prefix = near_stretches(flat, begin, stretch, file)
    own = (high[a] == length[a]) | (prefix < high[a] - low[a])  # else another file reports it
    own &= (size[a] == length[a]) | (size[b] == length[b])  # two longer words meet as words of their own length
    a, b = a[own], b[own]
    same = [_same_file(words[i], words[j], int(length[i]), int(low[i]), int(high[i])) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    a, b = a[same], b[same]
    left, right = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
    return pa.RecordBatch.from_arrays([batch["word"].take(left), batch["word"].take(right), batch["n"].take(right)], ["word", "near", "near_n"])


def _same_file(a: str, b: str, length: int, low: int, high: int) -> bool:
    """Whether two words that met by a hash agree outside the stretch."""
    return a[:low] == b[:low] and a[len(a) - (length - high) :] == b[len(b) - (length - high) :] if high < length else a[:low] == b[:low]


def links(words: DataFrame, most_filed: int = MOST_FILED) -> DataFrame:
    """(word, near, near_n): every two words one edit apart, both ways, each pair once."""
    stretch = F.expr("substring(word, low + 1, char_length(word) - length + high - low)")
    rows = filed(words, most_filed).repartition("file").sortWithinPartitions("file", stretch)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < SCANNED_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            file = table["file"].to_numpy()
            whole = int(np.searchsorted(file, file[-1]))  # the last file may go on
            if whole:
                yield _pairs(table.slice(0, whole))
            held = [table.slice(whole)]
        rest = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
        if rest:
            yield _pairs(rest[0])

    return rows.mapInArrow(scan, "word string, near string, near_n bigint")


def _roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root): where following (word, form) ends, for chains of at most `longest` steps."""
    now, steps = materialised(forms.select("word", F.col("form").alias("root"))), 1
    while steps < longest:
        onward = now.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        now = materialised(
            now.join(onward, F.col("root") == F.col("__word"), "left").select("word", F.coalesce("__root", "root").alias("root"))
        )
        steps *= 2
    return now


def spelling_groups(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_times: int = LEAST_TIMES,
    ratio: int = FORM_RATIO,
    most_filed: int = MOST_FILED,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    A form is at least `ratio` times as frequent as its word, so a chain of forms has at most
    log(greatest n) / log(ratio) steps, and half of it is jumped in each round.
    """
    words = materialised(vocabulary(docs, least_length, least_times))
    by_word = links(words, most_filed).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.max("near_n").alias("__most"),
        F.min_by("near", F.struct(-F.col("near_n"), F.col("near"))).alias("__near"),
    )
    known = words.join(by_word, "word", "left").withColumn("__found", F.col("__most") >= F.lit(ratio) * F.col("n"))
    known = materialised(
        known.select(
            "word",
            F.when(F.col("__found"), F.col("__near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(F.col("__found"), F.col("__most")).alias("form_n"),
        )
    )
    most, longest = words.agg(F.max("n")).first()[0] or 0, 0
    while most >= ratio:
        most, longest = most // ratio, longest + 1
    roots = _roots(known.where(F.col("form").isNotNull()), longest)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
