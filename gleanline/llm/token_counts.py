"""Token counts of a byte-pair vocabulary with word ends, by a whole-token shortcut.

Which strings of the vocabulary come out as one token when encoded alone is proved once, on the driver, by merging
every one of them; not all do, since merges are taken by rank. A piece of text between the splits of the tokenizer
that is such a string counts one. Only the others are merged, each distinct one of a batch once.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, words_of

LIMIT = 2048
#: Longer pieces are merged with a heap, one by one.
SHORT = 64
NEVER = np.iinfo(np.int64).max
#: Words whose counts a worker remembers between batches.
REMEMBERED = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """The merges of a vocabulary file in the format of `tokenizers`."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        vocab, end, letters = model["vocab"], model["end_of_word_suffix"], _letters()
        self.special = [x["content"] for x in content["added_tokens"]]
        self.pattern = content["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.inner = np.array([vocab[c] for c in letters])
        self.final = np.array([vocab[c + end] for c in letters])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        left, right, made = (np.array([vocab[x] for x in c]) for c in zip(*((a, b, a + b) for a, b in pairs), strict=True))
        born = np.full(self.size, len(pairs))
        born[self.inner] = born[self.final] = -1
        np.minimum.at(born, made, np.arange(len(pairs)))
        if (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            # all pairs of the least rank are merged at once, which is right only if no merge makes a lower one
            raise ValueError("a merge uses a token that a later merge makes")
        key = left * self.size + right
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], order, made[order]
        byte = {c: b for b, c in enumerate(letters)}
        self.words: list[bytes] = [bytes(byte[c] for c in t.removesuffix(end)) for t in vocab if t.endswith(end) and t != end]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NEVER if it has none, and the token it makes."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = self.keys[at] == key
        return np.where(there, self.ranks[at], NEVER), self.made[at]

    def _symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        out, ends = self.inner[raw], np.cumsum(sizes)
        out[ends - 1] = self.final[raw[ends - 1]]
        return out, ends - sizes

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word; no word is empty."""
        out = np.array([0 if len(w) <= SHORT else self._long(w) for w in words], np.int64)
        short = np.flatnonzero(out == 0)
        if not len(short):
            return out
        symbols, starts = self._symbols([words[i] for i in short])
        word = np.repeat(np.arange(len(short)), np.diff(np.append(starts, len(symbols))))
        while len(symbols):
            same = np.append(word[1:] == word[:-1], False)
            rank, made = self.find(symbols, np.append(symbols[1:], 0))
            rank[~same] = NEVER
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(word)))
            best = np.minimum.reduceat(rank, first)
            done = best == NEVER
            out[short[word[first[done]]]] = size[done]
            chosen = (rank == np.repeat(best, size)) & (rank != NEVER)
            # of overlapping pairs, which are equal letters in a row, the first, third, ... are merged
            at = np.arange(len(word))
            run = at - np.maximum.accumulate(np.where(chosen, -1, at)) - 1
            chosen &= run % 2 == 0
            symbols = np.where(chosen, made, symbols)
            keep = np.repeat(~done, size)
            keep[1:] &= ~chosen[:-1]
            symbols, word = symbols[keep], word[keep]
        return out

    def _long(self, word: bytes) -> int:
        symbols, _ = self._symbols([word])
        rank, made = self.find(symbols[:-1], symbols[1:])
        heap = [(r, i, m) for i, (r, m) in enumerate(zip(rank.tolist(), made.tolist(), strict=True)) if r != NEVER]
        heapq.heapify(heap)
        ids, n = symbols.tolist(), len(symbols)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        known: dict[tuple[int, int], tuple[int, int] | None] = {}

        def pair(i: int) -> tuple[int, int] | None:
            key = ids[i], ids[after[i]]
            if key not in known:
                r, m = self.find(np.array([key[0]]), np.array([key[1]]))
                known[key] = None if r[0] == NEVER else (int(r[0]), int(m[0]))
            return known[key]

        while heap:
            r, i, m = heapq.heappop(heap)
            if ids[i] < 0 or after[i] >= n or pair(i) != (r, m):
                continue  # one of the two has been merged since
            gone = after[i]
            ids[i], ids[gone], after[i] = m, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            for k in (i, before[i]):
                if k >= 0 and after[k] < n and (found := pair(k)):
                    heapq.heappush(heap, (found[0], k, found[1]))
        return left


@cache
def merges(path: str) -> Merges:
    return Merges(path)


def whole_tokens(path: str) -> np.ndarray:
    """Which words of the vocabulary, in its order, are one token when encoded alone."""
    model = merges(path)
    return model.counts(model.words) == 1


class Counter:
    """Counts tokens like the library does by default: special strings are tokens, none are added."""

    def __init__(self, path: str, proved: np.ndarray):
        self.model = merges(path)
        texts = (w.decode("utf-8", "replace") for w, good in zip(self.model.words, proved, strict=True) if good)
        self.whole = {t for t in texts if "�" not in t}
        self.split = regex.compile(self.model.pattern + r"|\n")
        self.special = regex.compile("|".join(map(regex.escape, self.model.special)))
        self.known: dict[str, int] = {}
        self.merged = 0

    @staticmethod
    def normal(text: str) -> str:
        """Composed and lower-cased, each letter by itself: a sigma at a word's end has no form of its own."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def words(self, words: list[str]) -> np.ndarray:
        """Tokens of each distinct word, none of which holds ASCII white space."""
        out = np.zeros(len(words), np.int64)
        parts, owner = [], []
        for i, word in enumerate(words):
            if word in self.whole:
                out[i] = 1
            elif (before := self.known.get(word)) is not None:
                out[i] = before
            else:
                rest = [word]
                if "<|" in word:
                    rest = self.special.split(word)
                    out[i] += len(rest) - 1
                parts += rest
                owner += [i] * len(rest)
        if not parts:
            return out
        at, found, rest, rest_of = 0, np.zeros(len(parts), np.int64), {}, []
        for piece in self.split.findall("\n".join(map(self.normal, parts))):
            if piece == "\n":
                at += 1
            elif piece in self.whole:
                found[at] += 1
            else:
                rest_of.append((at, rest.setdefault(piece, len(rest))))
        if rest:
            sizes = self.model.counts([p.encode() for p in rest])
            self.merged += len(rest)
            rows, pieces = np.array(rest_of).T
            np.add.at(found, rows, sizes[pieces])
        np.add.at(out, owner, found)
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        self.known.update((words[i], int(out[i])) for i in set(owner) if len(words[i]) <= SHORT)
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null is empty. White space between words makes and changes no token."""
        words = words_of(texts, lower=False)
        sums = np.concatenate([[0], np.cumsum(self.words(words.values.to_pylist())[words.codes])])
        return sums[words.starts[1:]] - sums[words.starts[:-1]]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str, proved: np.ndarray) -> Counter:
    """One for each Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, proved)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of `docs` (doc_id, text); other columns are not read.

    A null text is empty and has no tokens. Rows that repeat, or have no doc_id, are counted like others; no rows give
    none. Texts are counted whole, whatever their length. Letters newer than Python's Unicode tables are not lower-cased. The file at `vocabulary` has to be there on every machine.
    """
    path = vocabulary or default_vocabulary()
    proved = whole_tokens(path)  # a byte for each word of the vocabulary goes to the tasks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = counter(path, proved)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).cast(pa.int64())
            tokens = [tokens_of(batch["text"].slice(start, stop - start)) for start, stop in slices(batch["text"])]
            found = np.concatenate([np.zeros(0, np.int64), *tokens])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], sizes, pa.array(found), pa.array(found > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
