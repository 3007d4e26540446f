"""Packing token sequences into windows by minimum bin slack.

Documents are cut at multiples of the window; what is left over is a histogram of lengths below the window, which is
bounded by the window and goes to the driver. There each step takes the longest length left and asks a bitset
subset-sum which multiset of the others comes closest to the rest of the window; the counts are read back from the
bitsets, and the pattern is used as often as the histogram allows. The plan has a bounded number of patterns, whatever
the number of documents. Pieces find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, store

WINDOW = 2048
#: Pieces of one length are ranked in so many parts.
PARTS = 256
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A blank that is not a single one between two characters of words.
ODD_BLANK = rf"^ | $|[{SPACE}] | [{SPACE}]"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Ids of a byte-level BPE file in the format of `tokenizers`; strings of special tokens are ordinary text.

    A blank between two words always starts a token, so each distinct word of a batch is encoded once, with the blank
    before it. Texts with other blanks are encoded whole.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {x["content"] for x in content["added_tokens"]}
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(letter[c] for c in t): i for t, i in content["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.blank = np.zeros(max(ranks.values()) + 1, bool)
        self.blank[[i for t, i in ranks.items() if t.startswith(b" ")]] = True

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, ODD_BLANK)
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        flat = lists.flatten()
        later = np.ones(len(flat), bool)
        later[ends[:-1]] = False
        firsts = self.encoding.encode_ordinary_batch(pc.if_else(odd, texts, pc.list_element(lists, 0)).to_pylist(), num_threads=1)
        coded = pc.dictionary_encode(flat.filter(pa.array(later)))
        codes, values = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(values.to_pylist())) if len(values) else [], np.uint32)
        starts = np.flatnonzero(self.blank[ids]) if len(ids) else np.zeros(0, np.int64)
        if len(starts) != len(values):
            raise AssertionError("a blank inside a word")
        sizes = np.diff(np.append(starts, len(ids)))
        length = sizes[codes]
        cuts = np.concatenate([[0], np.cumsum(length)])
        all_ids = ids[np.arange(cuts[-1]) + np.repeat(starts[codes] - cuts[:-1], length)] if len(codes) else ids
        ends -= np.arange(len(ends))  # without the first words
        for i, first in enumerate(firsts):
            yield np.concatenate([np.array(first, np.uint32), all_ids[cuts[ends[i]] : cuts[ends[i + 1]]]])


@cache
def _encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def pieces(docs: DataFrame, vocabulary: str | None = None, end: int = 1, window: int = WINDOW, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of the documents' ids followed by `end`.

    With `ids` also the ids themselves.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary or default_vocabulary())
        for batch in batches:
            for start, stop in slices(batch["text"]):
                part = batch.slice(start, stop - start)
                rows, values = [], []
                for k, found in enumerate(encode(part["text"])):
                    whole = np.append(found, np.uint32(end)).astype("<u4")
                    for at in range(0, len(whole), window):
                        piece = whole[at : at + window]
                        rows.append((k, at, len(piece), zlib.crc32(piece.tobytes()), len(whole)))
                        if ids:
                            values.append(piece)
                at, *columns = (pa.array(np.array(c, np.int64)) for c in zip(*rows, strict=True))
                columns = [part["doc_id"].take(at), *columns]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if ids:
                    columns.append(pa.array(values, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *["ids"] * ids])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * ids
    )


def fill(left: dict[int, int], window: int) -> dict[int, int]:
    """How many pieces of each length fill one window best, the longest length being among them."""
    longest = max(left)
    room, reach, steps = window - longest, 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in left if x <= room), reverse=True):
        most = min(left[length] - (length == longest), room // length)
        part = 1
        while most > 0:  # counts up to `most` as sums of powers of two and a rest
            part = min(part, most)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            most -= part
            part *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {longest: 1}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            at -= length * part
            taken[length] = taken.get(length, 0) + part
    return taken


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after, first sequence, pieces of the length in a sequence, offset of the first)."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    out, sequence = [], 0
    while left:
        taken = fill(left, window)
        times = min(left[n] // c for n, c in taken.items())
        offset = 0
        for n, c in sorted(taken.items(), reverse=True):
            out.append((n, used[n], used[n] + c * times, sequence, c, offset))
            offset += n * c
            used[n] += c * times
            left[n] -= c * times
            if not left[n]:
                del left[n]
        sequence += times
    return out


def placed(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of `cut` with sequence_id and offset.

    Pieces of a length are ranked in PARTS parts, whose starts come from counts, so that a frequent length is spread.
    """
    counts = {n: c for n, c in cut.groupBy("length").count().collect()}  # at most `window` rows
    segments = np.array(plan(counts, window), np.int64).reshape(-1, 6)
    segments = segments[np.lexsort((segments[:, 1], segments[:, 0]))]
    salted = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(PARTS)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("length", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        salted.join(sums, ["length", "part"])
        .withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
        .drop("part", "before")
    )

    names = list(cut.columns)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = segments[:, 0] * (1 << 44) + segments[:, 1]
        for batch in batches:
            rank, length = batch["rank"].to_numpy(), batch["length"].to_numpy()
            s = segments[np.searchsorted(first, length * (1 << 44) + rank, side="right") - 1]
            k = rank - s[:, 1]
            columns = [batch[c] for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(s[:, 3] + k // s[:, 4]), pa.array(s[:, 5] + k % s[:, 4] * length)],
                names=[*names, "sequence_id", "offset"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(find, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str | None = None, end: int = 1, window: int = WINDOW, ids: bool = False) -> DataFrame:
    """One row per piece of `docs` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows without doc_id, or that share one, are packed like others. Within a
    sequence the pieces lie without gaps from offset 0. No rows give no rows.
    """
    return placed(store(pieces(docs, vocabulary, end, window, ids)), window)
