"""BPE encoding by depth-first walks of a trie of distinct words, and decoding.

The encoding of a word's prefix is fixed by its last token and the encoding of what comes
before it: among the vocabulary's tokens that end the prefix, exactly one may follow the
last token of the rest. A trie node therefore needs one token, and its children extend it.
The distinct new words of a batch are walked in sorted order, which is the trie's
depth-first order: the stack holds the states of the prefix shared with the word before,
so each shared prefix is worked out once. Two tokens may stand side by side if no merge
across their border would have been applied before both were complete.

The file is a `tokenizers` JSON of a BPE model with word ends over byte-level characters,
a normalizer of NFC, white space and lower case, and a pre-tokenizer that keeps the
matches of one pattern. Special tokens inside a text are found first, as that library does.

Nulls, ties and the rest: a null or empty text has no tokens and decodes to an empty
text; of equal merges the left one is applied first; repeated rows are encoded alike;
other columns are kept, and ones named ids or decoded are replaced.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from staycohort.llm.common import small_batches

#: Words whose encodings a task keeps between batches: up to so many of late, and as many before,
#: and of so many characters.
KEPT_WORDS, KEPT_CHARACTERS = 350_000, 16_000_000

_NEVER = float("inf")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class TrieEncoder:
    """Encodes words of a vocabulary; `path` names the JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.ids, **self.specials}.items()}
        ids = self.ids
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = ids[left], ids[right]
            self.rank.setdefault((a, b), rank)
            self.halves.setdefault(ids[left + right], (a, b, rank))
        self._ends: dict[int, list[tuple[int, float, float]]] = {}
        self._starts: dict[int, list[tuple[int, float, float]]] = {}
        self._may_follow: dict[tuple[int, int], bool] = {}
        self._whole: dict[str, int | None] = {}
        self.endings = {t[k:] for t in ids for k in range(len(t.removesuffix(self.suffix)))}
        self.longest = max(len(t.removesuffix(self.suffix)) for t in ids)
        self.characters = byte_characters()
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        spaces = r"\t-\r \x85\xa0  -     　"
        self.chunks = regex.compile(f"[^{spaces}]+").findall
        self.words = regex.compile(split.replace(r"[^\s", f"[^{spaces}")).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.characters_kept = 0

    def _spine(self, token: int, side: int, kept: dict) -> list[tuple[int, float, float]]:
        """The tokens that stood at one end of `token` while it was built: each with
        the rank that made it and the rank that used it up."""
        if token not in kept:
            spine, used = [], _NEVER
            at: int = token
            while True:
                made = self.halves.get(at)
                spine.append((at, made[2] if made else -1, used))
                if not made:
                    break
                at, used = made[side], made[2]
            kept[token] = spine
        return kept[token]

    def _first_crossing(self, left: int, right: int) -> float:
        """The least rank of a merge across the border of two tokens while they are built."""
        least = _NEVER
        for a, a_made, a_used in self._spine(left, 1, self._ends):
            for b, b_made, b_used in self._spine(right, 0, self._starts):
                rank = self.rank.get((a, b))
                if rank is not None and a_made < rank > b_made and rank < a_used and rank <= b_used:
                    least = min(least, rank)
        return least

    def may_follow(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self._may_follow.get(pair)
        if known is None:
            if len(self._may_follow) > 2_000_000:
                self._may_follow.clear()
            known = self._may_follow[pair] = self._first_crossing(left, right) == _NEVER
        return known

    def whole(self, text: str) -> int | None:
        """The id of a token that encodes as itself; None for any other string."""
        if text not in self.ids:
            return None
        if text not in self._whole:
            token = self.ids[text]
            made = self.halves.get(token)
            stands = True
            if made:
                a, b, rank = made
                stands = self._first_crossing(a, b) == rank
                stands = stands and self.whole(self.tokens[a]) is not None and self.whole(self.tokens[b]) is not None
            self._whole[text] = token if stands else None
        return self._whole[text]

    def _last_token(self, letters: str, end: int, mark: str, tokens: list[int]) -> tuple[int, int]:
        """The last token of letters[:end] + mark, and where it starts."""
        ids, follows = self.ids, self._may_follow
        # one token fits, so the order of trial is free: short ones first, to stop early
        for start in range(end - 1, max(0, end - self.longest) - 1, -1):
            piece = letters[start:end] + mark if mark else letters[start:end]
            if piece not in self.endings:
                break
            if piece in ids:
                token = self._whole[piece] if piece in self._whole else self.whole(piece)
                if token is None:
                    continue
                if start == 0 or (follows.get((tokens[start], token)) or self.may_follow(tokens[start], token)):
                    return token, start
        raise ValueError(f"no token of the vocabulary ends {letters[:end] + mark!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each distinct word, by one depth-first walk."""
        spell = self.characters.__getitem__
        # printable ASCII stands for itself
        spelled = sorted((w if w.isascii() and w.isprintable() else "".join(map(spell, w.encode("utf-8"))), w) for w in set(words))
        out: dict[str, tuple[int, ...]] = {}
        tokens, starts, before = [-1], [-1], ""
        for letters, word in spelled:
            shared = 0
            for a, b in zip(before, letters, strict=False):
                if a != b:
                    break
                shared += 1
            shared = min(shared, len(tokens) - 1)
            del tokens[shared + 1 :], starts[shared + 1 :]
            for end in range(shared + 1, len(letters)):
                token, start = self._last_token(letters, end, "", tokens)
                tokens.append(token)
                starts.append(start)
            token, at = self._last_token(letters, len(letters), self.suffix, tokens)
            found = [token]
            while at > 0:
                found.append(tokens[at])
                at = starts[at]
            out[word] = tuple(found[::-1])
            before = letters
        return out

    def split(self, text: str) -> list[str]:
        """Words of a text in which no special token stands."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words(text.lower())

    def pieces(self, text: str) -> list[str]:
        """Words and, as they are, special tokens of a text, in order."""
        if not self.special or not self.special.search(text):
            return self.split(text)
        parts = self.special.split(text)
        return list(chain.from_iterable([p] if i % 2 else self.split(p) for i, p in enumerate(parts)))

    def _chunks(self, text: str | None) -> list[str]:
        """Parts of a text between white space, which no word or special token crosses."""
        if not text:
            return []
        # str.split also parts at these four, which are no white space to the model
        return self.chunks(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self._chunks(t) for t in texts]
        present = set(chain.from_iterable(split))
        if len(self.known) + len(present) > KEPT_WORDS or self.characters_kept > KEPT_CHARACTERS:
            self.older, self.known, self.characters_kept = self.known, {}, 0
        missing = present.difference(self.known)
        self.characters_kept += sum(map(len, missing))
        for chunk in missing & self.older.keys():
            self.known[chunk] = self.older[chunk]
        new = {c: self.pieces(c) for c in missing.difference(self.known)}
        ids_of_word = self.encode_words(set(chain.from_iterable(new.values())).difference(self.specials))
        ids_of_word.update({s: (i,) for s, i in self.specials.items()})
        for chunk, words in new.items():
            self.known[chunk] = (
                ids_of_word[words[0]] if len(words) == 1 else tuple(chain.from_iterable(map(ids_of_word.__getitem__, words)))
            )
        ids_of = self.known.__getitem__
        return [list(chain.from_iterable(map(ids_of, chunks))) for chunks in split]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings with a space between, as a model without a decoder does."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def encoder(path: str) -> TrieEncoder:
    """The encoder of this process; its kept words serve the tasks that follow, too."""
    return TrieEncoder(path)


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with `ids` (array of int) and `decoded`, the ids decoded again."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    source = docs.select(*kept)
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        gc.disable()  # kept words form no cycles, and scanning them over and over is slow
        try:
            for batch in batches:
                found = coder.encode(batch.column(at).to_pylist())
                ends = np.cumsum([0, *map(len, found)])
                flat = np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                decoded = pa.array([coder.decode(x) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, ids, decoded], [*kept, "ids", "decoded"])
        finally:
            gc.enable()  # the worker goes on with other stages

    fields = [*source.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return source.mapInArrow(run, T.StructType(fields))
