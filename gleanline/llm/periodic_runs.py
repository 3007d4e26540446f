"""Runs of periodic words, found on a harmonic grid with a longest-common-extension index over a difference cover.

Of the suffixes of a batch only those at positions of a difference cover are sorted. Any two positions reach two
sampled ones after the same few words, so an extension compares those words and asks a sparse table of minima over
the sampled suffixes' common prefixes for the rest. For every period q the words at 0, q, 2q, ... are compared with
their next; where two are equal, the extensions to both sides tell the whole stretch. A run of period q is at least
2q long and so holds such a pair. The pairs of all periods are n/1 + n/2 + n/3 + ... in number.

The texts of a batch are one sequence, cut by separators of which no two are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices, words_of

#: Residues modulo PERIOD of which every difference occurs.
COVER = (1, 5, 11, 24, 25, 27)
PERIOD = 31
LEAST = 12
#: So many pairs of the grid are extended at once.
PAIRS = 1 << 19
COLUMNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _shifts() -> np.ndarray:
    """For residues a and b the least step after which both are in the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = np.flatnonzero(inside[a : a + PERIOD] & inside[b : b + PERIOD])[0]
    return out


SHIFTS = _shifts()
SLOTS = np.full(PERIOD, -1)
SLOTS[list(COVER)] = np.arange(len(COVER))


class Extensions:
    """Longest common extensions to the right in a sequence of numbers.

    The sequence ends with separators: numbers that occur once. A block that holds one differs from all others, so
    no comparison leaves its text.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = np.concatenate([codes, codes.max(initial=0) + 1 + np.arange(2 * PERIOD, dtype=codes.dtype)])
        blocks = -(-len(codes) // PERIOD)
        self.places = (np.arange(blocks)[:, None] * PERIOD + np.array(COVER)).ravel()
        self.places = self.places[self.places < len(codes)]
        self._sort()

    def _sort(self) -> None:
        """Ranks of the sampled suffixes by doubling, and the minima over common prefixes of neighbours."""
        n = len(self.places)
        bits = max(1, int(self.codes.max()).bit_length())
        at_once = max(1, 62 // bits)
        rank, open_ = np.zeros(n, np.int64), np.arange(n)
        for step in range(0, PERIOD, at_once):
            key = np.zeros(len(open_), np.int64)
            for k in range(step, min(step + at_once, PERIOD)):
                key = (key << bits) | self.codes[self.places[open_] + k]
            open_ = self._refine(rank, open_, key)
            if not len(open_):
                break
        # rank at one level tells equal blocks of `reach` words; the levels give common prefixes below
        levels, reach = [(PERIOD, rank.copy())], PERIOD
        while len(open_):
            later = open_ + reach // PERIOD * len(COVER)
            open_ = self._refine(rank, open_, rank[later])
            reach *= 2
            levels.append((reach, rank.copy()))
        self.rank = rank
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        self.table = [self._neighbours(order, levels[:-1])]
        width = 1
        while 2 * width <= len(self.table[0]):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    @staticmethod
    def _refine(rank: np.ndarray, open_: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Split groups of equal rank by `key`; a rank is the number of suffixes before the group. What is still tied."""
        order = np.lexsort((key, rank[open_]))
        open_, key = open_[order], key[order]
        old = rank[open_]
        head = np.ones(len(open_), bool)
        head[1:] = old[1:] != old[:-1]
        new = head.copy()
        new[1:] |= key[1:] != key[:-1]
        at = np.arange(len(open_))
        first = np.maximum.accumulate(np.where(new, at, 0))
        group = np.maximum.accumulate(np.where(head, at, 0))
        rank[open_] = old + first - group
        tied = ~new
        tied[:-1] |= ~new[1:]
        return open_[tied]

    def _neighbours(self, order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Common prefix of each sampled suffix with the next in order."""
        a, b = order[:-1].copy(), order[1:].copy()
        out = np.zeros(len(a), np.int32)
        for reach, rank in reversed(levels):
            # a suffix that was alone at a lower level keeps its rank, so equal ranks are equal blocks
            same = np.flatnonzero(rank[a] == rank[b])
            out[same] += reach
            a[same] += reach // PERIOD * len(COVER)
            b[same] += reach // PERIOD * len(COVER)
        return out + self._compare(self.places[a], self.places[b], np.full(len(a), PERIOD))

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, up to `most`."""
        out, left = np.zeros(len(i), np.int32), np.flatnonzero(most > 0)
        for k in range(int(most.max(initial=0))):
            left = left[(most[left] > k) & (self.codes[i[left] + k] == self.codes[j[left] + k])]
            if not len(left):
                break
            out[left] += 1
        return out

    def _sampled(self, at: np.ndarray) -> np.ndarray:
        return self.rank[at // PERIOD * len(COVER) + SLOTS[at % PERIOD]]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and from j on; no i equals its j."""
        shift = SHIFTS[i % PERIOD, j % PERIOD]
        out = self._compare(i, j, shift)
        far = np.flatnonzero(out == shift)
        low, high = self._sampled(i[far] + shift[far]), self._sampled(j[far] + shift[far])
        low, high = np.minimum(low, high), np.maximum(low, high)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            here = np.flatnonzero(level == k)
            row = self.table[k]
            out[far[here]] += np.minimum(row[low[here]], row[high[here] - (1 << int(k))])
        return out


def runs_of(codes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs of a sequence that begins and ends with a separator, by start, then period.

    `longest` is the length of the longest text in it.
    """
    n = len(codes)
    there = back = None
    found, i, q, waiting = [], [], [], 0

    def extend() -> None:
        nonlocal there, back
        if there is None:
            there, back = Extensions(codes), Extensions(codes[::-1].copy())
        a, period = np.concatenate(i), np.repeat(*map(np.array, zip(*q, strict=True)))
        before = back(n - a, n - a - period)
        length = before + period + there(a, a + period)
        long = length >= np.maximum(LEAST, 2 * period)
        start, length, period = (a - before)[long], length[long], period[long]
        order = np.lexsort((period, length, start))
        start, length, period = start[order], length[order], period[order]
        new = np.ones(len(start), bool)  # the smallest period of a stretch comes first
        new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        found.append((start[new], length[new], period[new]))
        i.clear()
        q.clear()

    for period in range(1, max(longest // 2, LEAST - 1) + 1):
        grid = codes[::period]
        hits = np.flatnonzero(grid[:-1] == grid[1:]) * period
        if len(hits):
            i.append(hits)
            q.append((period, len(hits)))
            waiting += len(hits)
            if waiting >= PAIRS:
                extend()
                waiting = 0
    if waiting:
        extend()
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _batch(doc_id: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    words = words_of(texts, lower=False)
    n, counts = len(texts), words.counts
    codes = np.empty(len(words.codes) + n + 1, np.int64)
    at = np.arange(len(words.codes)) + words.rows() + 1  # text i begins after i + 1 separators
    codes[at] = words.codes
    cuts = words.starts + np.arange(n + 1)
    codes[cuts] = len(words.values) + np.arange(n + 1)
    start, length, period = runs_of(codes, int(counts.max(initial=0)))
    row = np.searchsorted(cuts, start, side="right") - 1
    change = np.zeros(len(codes) + 1, np.int32)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change)[at] == 0
    ends = np.concatenate([[0], np.cumsum(kept)])[words.starts]
    left = words.values.cast(pa.large_string()).take(pa.array(words.codes[kept]))
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), left), pa.scalar(" ", pa.large_string()))
    runs = pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in (start - cuts[row] - 1, length, period)], ["start", "length", "period"]
    )
    bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())
    return pa.RecordBatch.from_arrays(
        [doc_id, pa.array(counts), pa.ListArray.from_arrays(bounds, runs), collapsed.cast(pa.string())],
        ["doc_id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs and collapsed for every row of `docs` (doc_id, text); other columns are not read.

    Words lie between ASCII white space. A run is a stretch of words with smallest period q of at least 2q and 12
    words that no neighbour extends; runs come by start, then period. `collapsed` joins by a blank the words that no
    run holds after its first q. A null text has no words, no runs and an empty string. Rows that repeat, or have no
    doc_id, are rows of their own; no rows give none. A text of any length is looked at whole.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch["text"]):
                yield _batch(batch["doc_id"].slice(start, stop - start), batch["text"].slice(start, stop - start))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(look, COLUMNS)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of every tenth document by checksum repeat from some word on."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size("words").cast("long")
    a = F.expr("g % n")
    some = docs.select("doc_id", "text", h.alias("h"), g.alias("g")).withColumn("words", F.when(F.expr("h % 10 = 0"), words))
    some = some.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, a))
    some = some.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.expr("concat_ws(' ', transform(words, (w, i) -> IF(i < a, w, words[CAST(a + (i - a) % p AS INT)])))")
    return some.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and checksums of the runs and of what is left."""

    def sha(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    said = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    return found.withColumn("best", best).select(
        "doc_id",
        "n_words",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        sha(said).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def runs_query(docs: DataFrame) -> DataFrame:
    """The digest over all documents, of which every tenth was made periodic."""
    return digest(periodic_runs(planted(docs)))
