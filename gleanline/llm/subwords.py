"""Texts as averages of hashed word and character n-gram features, computed once per distinct word of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import Words, hashes, mixed


def ngrams(values: pa.Array, sizes: range, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word between `<` and `>`: buckets, and the word of each."""
    texts = [f"<{w}>" for w in values.to_pylist()]
    length = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), length)
    found, words = [], []
    for n in sizes:
        count = len(points) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : k + count]
        inside = owner[:count] == owner[n - 1 :]
        found.append((mixed(h[inside]) % np.uint64(buckets)).astype(np.int64))
        words.append(owner[:count][inside])
    none = np.zeros(0, np.int64)
    return np.concatenate(found or [none]), np.concatenate(words or [none])


#: Words whose n-grams are in memory at a time: about 100 bytes for each of their characters.
WORDS_AT_ONCE = 1 << 13


class Features:
    """`own` buckets for words and `grams` for n-grams; a text's vector is the average over all its features."""

    def __init__(self, own: int, grams: int, sizes: range):
        self.own, self.grams, self.sizes = own, grams, sizes
        self.width = own + grams

    def of_words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        at, word = ngrams(words.values, self.sizes, self.grams)
        if self.own:
            known = (hashes(words.values) % np.uint64(self.own)).astype(np.int64) if len(words.values) else np.zeros(0, np.int64)
            at = np.concatenate([known, at + self.own])
            word = np.concatenate([np.arange(len(known)), word])
        return at, word

    def vectors(self, words: Words) -> np.ndarray:
        """(texts, width) averages; zeros without words."""
        at, word = self.of_words(words)
        order = np.argsort(word, kind="stable")
        at, size = at[order], np.bincount(word, minlength=len(words.values))
        starts = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros((len(words.starts) - 1, self.width), np.float32)
        for i, (a, b) in enumerate(zip(words.starts[:-1], words.starts[1:], strict=True)):
            codes, times = np.unique(words.codes[a:b], return_counts=True)
            n = size[codes]
            where = np.arange(n.sum()) + np.repeat(starts[codes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(codes) else np.zeros(0, int)
            counted = np.bincount(at[where], weights=np.repeat(times, n), minlength=self.width)
            out[i] = counted / max(1.0, counted.sum())
        return out

    def projected(self, words: Words, table: np.ndarray) -> np.ndarray:
        """`vectors(words) @ table`, without the vectors. Distinct words are cut up WORDS_AT_ONCE at a time."""
        kinds, n = len(words.values), len(words.starts) - 1
        size, by_word = np.empty(kinds), np.empty((table.shape[1], kinds))
        for a in range(0, kinds, WORDS_AT_ONCE):
            few = words.values.slice(a, WORDS_AT_ONCE)
            at, word = self.of_words(Words(words.codes[:0], words.starts[:1], few))
            size[a : a + len(few)] = np.bincount(word, minlength=len(few))
            for k in range(table.shape[1]):
                by_word[k, a : a + len(few)] = np.bincount(word, weights=table[at, k], minlength=len(few))
        rows = words.rows()
        total = np.maximum(np.bincount(rows, weights=size[words.codes], minlength=n), 1.0)
        out = np.empty((n, table.shape[1]))
        for k in range(table.shape[1]):
            out[:, k] = np.bincount(rows, weights=by_word[k][words.codes], minlength=n) / total
        return out


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a missing id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def share(doc_id: Column) -> Column:
    """A number in 0..1 that depends on the id alone."""
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))
