"""SentencePiece BPE encoding and decoding by suffix-array matching.

The distinct words of a batch are laid out as one text, whose suffixes are sorted by as many characters as the longest
piece has. A binary search for every piece gives the range of its occurrences: the edges of a graph over positions.
Edges are relaxed in the order of their ends. The last piece of a prefix's encoding is the one edge into its end whose
predecessor stands beside it in the encoding of the two pieces alone; merges never cross a boundary that stays, so
encodings are made of such neighbours and no other chain is.

The model must have pieces by merge rank, blanks written as U+2581 at the start of pieces only, no other normalisation
than a blank before the text, and byte pieces for unknown characters; `Codec` checks this.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

BLANK = "\u2581"


#: Words whose ids a process keeps; before there are more, it drops all but those that it met most often.
WORDS_KEPT = 1 << 20
#: Characters of new words whose suffixes are sorted together.
BATCH_CHARS = 600_000
#: Places for the answers on pairs of neighbours that are looked at first.
NEAR = 1 << 19


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Pieces of a model file and the neighbours met so far."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        probe = " A  \ufb01\t\u00bd "
        if model.normalize(probe) != BLANK + probe.replace(" ", BLANK):
            raise ValueError("the model changes texts")
        plain = [i for i in range(count) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): (-model.get_score(i), i) for i in plain}
        if any(BLANK in p.lstrip(BLANK) for p in self.rank):
            raise ValueError("pieces go beyond a blank")
        self.count = count
        self.byte = {b: model.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        raw = {i: bytes([b]) for b, i in self.byte.items()} | {i: model.id_to_piece(i).replace(BLANK, " ").encode() for i in plain}
        self.raw = [raw.get(i, b"") for i in range(count)]
        self.text = {i: p for p, (_, i) in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.plain = sorted(self.rank)
        self.ids = np.array([self.rank[p][1] for p in self.plain], np.int64)
        self.sizes = np.array([len(p) for p in self.plain], np.int64)
        self.alone = {i: self.merged(p) == [i] for p, (_, i) in self.rank.items()}
        self.own = np.zeros(count, bool)
        self.own[[i for i, ok in self.alone.items() if ok]] = True
        self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.near, self.near_fits = np.full(NEAR, -1, np.int64), np.zeros(NEAR, bool)
        self.spelling = pa.array(self.raw, pa.binary())
        self.known: dict[str, int] = {}
        self.token, self.first, self.n_ids = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int32)

    def forget_words(self) -> None:
        """Keep the words of the most slices, half of WORDS_KEPT at most and none that was met once."""
        often = np.argsort(-self.met, kind="stable")[: WORDS_KEPT // 2]
        keep = np.sort(often[self.met[often] > 1])
        names, n = list(self.known), self.n_ids[keep]
        starts = np.cumsum(n) - n
        self.token = self.token[np.arange(n.sum()) + np.repeat(self.first[keep] - starts, n)]
        self.first, self.n_ids, self.met = starts, n, self.met[keep] // 2
        self.known = {names[i]: k for k, i in enumerate(keep.tolist())}

    def merged(self, text: str) -> list[int]:
        """The encoding by merging: the best-ranked pair of neighbours first, the leftmost of equals. Used on short texts."""
        parts = list(text)
        while True:
            best = min(
                ((self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank),
                default=None,
            )
            if best is None:
                return [self.rank[p][1] if p in self.rank else self.count + ord(p) for p in parts]
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def neighbours(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two pieces stay apart when encoded together; new pairs are worked out once per process."""
        width = self.count + 0x110000
        asked = left * width + right
        place = (left * 40_503 + right * 2_654_435_761 >> 7) & (NEAR - 1)
        out = self.near_fits[place]
        far = np.flatnonzero(self.near[place] != asked)
        if not len(far):
            return out
        kinds, back = np.unique(asked[far], return_inverse=True)
        at = np.searchsorted(self.pairs, kinds)
        known = np.zeros(len(kinds), bool)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == kinds[inside]
        new = kinds[~known]
        if len(new):
            spell = lambda i: self.text[i] if i < self.count else chr(i - self.count)
            fits = np.array([self.merged(spell(x // width) + spell(x % width)) == [x // width, x % width] for x in new.tolist()], bool)
            # Both are sorted: new pairs go between the known ones.
            spots = np.searchsorted(self.pairs, new)
            self.pairs, self.fits = np.insert(self.pairs, spots, new), np.insert(self.fits, spots, fits)
            at = np.searchsorted(self.pairs, kinds)
        out[far] = self.fits[at][back]
        self.near[place[far]] = asked[far]
        self.near_fits[place[far]] = out[far]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        length = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n, stops = len(points), np.cumsum(length)
        begins = stops - length
        end_of = np.repeat(stops, length)
        # Characters as dense numbers from 1 in the order of their code points; 0 ends a word.
        alphabet = np.unique(np.concatenate([points, np.frombuffer("".join(self.plain).encode("utf-32-le"), np.uint32)]))
        bits = int(len(alphabet) + 1).bit_length()
        per = 63 // bits
        dense = np.searchsorted(alphabet, points) + 1
        windows = -(-self.longest // per)

        def keys(dense: np.ndarray, ends: np.ndarray, fill: int) -> list[np.ndarray]:
            """The first characters from each position up to its end, `per` of them to a number; then `fill`."""
            padded, out = np.concatenate([dense, np.zeros(windows * per, np.int64)]), []
            here = np.arange(len(dense))
            for k in range(windows):
                key = np.zeros(len(dense), np.int64)
                for j in range(k * per, (k + 1) * per):
                    key = (key << bits) | np.where(here + j < ends, padded[j : j + len(dense)], fill)
                out.append(key)
            return out

        suffix = keys(dense, end_of, 0)
        order = np.lexsort(suffix[::-1])
        p_points = np.frombuffer("".join(self.plain).encode("utf-32-le"), np.uint32).astype(np.int64)
        p_stops = np.cumsum(self.sizes)
        p_dense, p_ends, first = np.searchsorted(alphabet, p_points) + 1, np.repeat(p_stops, self.sizes), p_stops - self.sizes
        low, high = ([k[first] for k in keys(p_dense, p_ends, fill)] for fill in (0, (1 << bits) - 1))
        lo, hi = _ranges([s[order] for s in suffix], low, high)
        found = hi - lo
        which = np.repeat(np.arange(len(found)), found)
        start = order[np.arange(found.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(found)[:-1]]), found)]
        piece, size = self.ids[which], self.sizes[which]
        single = np.zeros(n, bool)
        single[start[size == 1]] = True
        odd = np.flatnonzero(~single)  # characters without a piece stand for their bytes
        start = np.concatenate([start, odd])
        piece = np.concatenate([piece, self.count + points[odd]])
        size = np.concatenate([size, np.ones(len(odd), np.int64)])

        # Relax the edges in the order of their ends; ends at one distance from the start of their word go together.
        stop = start + size
        begin = np.repeat(begins, length)
        depth = stop - begin[start]
        by_depth = np.lexsort((stop, depth))
        start, piece, size, stop, depth = (x[by_depth] for x in (start, piece, size, stop, depth))
        cuts = np.searchsorted(depth, np.arange(1, (depth[-1] if len(depth) else 0) + 2))
        last, step = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s, p = start[a:b], piece[a:b]
            opening = s == begin[s]
            good = np.zeros(b - a, bool)
            good[opening] = np.where(p[opening] < self.count, self.own[np.minimum(p[opening], self.count - 1)], True)
            # Positions are shared by the end of a word and the start of the next, which `opening` tells apart.
            later = np.flatnonzero(~opening)
            later = later[last[s[later]] >= 0]
            good[later] = self.neighbours(last[s[later]], p[later])
            last[stop[a:b][good]] = p[good]
            step[stop[a:b][good]] = size[a:b][good]
        tokens, owners, at = [], [], stops.copy()
        active = np.flatnonzero(length > 0)
        while len(active):
            here = at[active]
            if (last[here] < 0).any():
                raise AssertionError("a word without an encoding")
            tokens.append(last[here])
            owners.append(active)
            at[active] -= step[here]
            active = active[at[active] > begins[active]]
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        back = np.concatenate([np.full(len(t), -k) for k, t in enumerate(tokens)])
        order = np.lexsort((back, owner))
        token, owner = token[order], owner[order]
        if (token >= self.count).any():
            spelled = [[t] if t < self.count else [self.byte[x] for x in chr(t - self.count).encode("utf-8", "replace")] for t in token.tolist()]
            owner = np.repeat(owner, [len(x) for x in spelled])
            token = np.array([i for x in spelled for i in x], np.int64)
        return token, np.bincount(owner, minlength=len(words))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; null and empty texts have none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        empty = pc.equal(texts, "")
        texts = pc.if_else(empty, "", pc.binary_join_element_wise(pa.scalar(BLANK), pc.replace_substring(texts, " ", BLANK), ""))
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(b"".join(x.as_buffer() for x in texts), np.uint8) if len(texts) else np.zeros(0, np.uint8)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        # Words start at a blank after something else; the end of a line, which no longer piece holds, is one too.
        mark = np.zeros(len(data) + 4, bool)
        mark[: max(0, len(data) - 2)] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        cut = mark[: len(data)].copy()
        cut[3:] &= ~mark[: max(0, len(data) - 3)]
        if not any("\n" in p for p in self.plain):
            line = data == 10
            cut |= line
            cut[1:] |= line[:-1]
        cut[edges[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cut)
        offsets = np.append(starts, len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
        coded = pc.dictionary_encode(words)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        at = self.learned(coded.dictionary.to_pylist())[codes]
        length = self.n_ids[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        flat = self.token[np.arange(ends[-1]) + np.repeat(self.first[at] - ends[:-1], length)]
        return pa.ListArray.from_arrays(ends[np.searchsorted(starts, edges)].astype(np.int32), pa.array(flat))

    def learned(self, words: list[str]) -> np.ndarray:
        """The place of each word in `first` and `n_ids`; words that this process has not met are encoded together."""
        new = [w for w in words if w not in self.known]
        if len(self.known) and len(self.known) + len(new) > WORDS_KEPT:
            self.forget_words()
            new = [w for w in words if w not in self.known]
        stops = np.cumsum([len(w) for w in new]) if new else np.zeros(0, int)
        start = 0
        while start < len(new):  # batches of bounded size; a longer word is one of its own
            stop = max(start + 1, int(np.searchsorted(stops, (stops[start - 1] if start else 0) + BATCH_CHARS, side="right")))
            token, count = self.encode_words(new[start:stop])
            self.first = np.concatenate([self.first, len(self.token) + np.cumsum(count) - count])
            self.token, self.n_ids = np.concatenate([self.token, token.astype(np.int32)]), np.concatenate([self.n_ids, count])
            self.known |= {w: len(self.known) + k for k, w in enumerate(new[start:stop])}
            start = stop
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
        at = np.fromiter((self.known[w] for w in words), np.int64, len(words))
        self.met[at] += 1
        return at

    def decode(self, ids: list[int]) -> str:
        """The text of some ids, without the blank before it; bytes that are no text become U+FFFD."""
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def spelled(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """`decode` of each stretch of ids, all of them looked up at once."""
        parts = self.spelling.take(pa.array(ids))
        _, offsets, data = parts.buffers()
        stops = np.frombuffer(offsets, np.int32)[edges].tolist() if len(ids) else [0] * len(edges)
        data = memoryview(data) if data is not None else memoryview(b"")
        texts = [str(data[a:b], "utf-8", "replace") for a, b in zip(stops[:-1], stops[1:], strict=True)]
        return [text[1:] if text.startswith(" ") else text for text in texts]


def _ranges(columns: list[np.ndarray], low: list[np.ndarray], high: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where rows from `low` to `high` stand among rows that are sorted by several numbers.

    Low and high differ from the number on in which a piece ends; numbers after it hold no bound.
    """
    lo, hi = np.searchsorted(columns[0], low[0]), np.searchsorted(columns[0], high[0], side="right")
    for k in range(1, len(columns)):
        more = np.flatnonzero((lo < hi) & (low[k - 1] == high[k - 1]))
        bounds = lo[more], hi[more]
        lo[more], hi[more] = _search(columns[k], low[k][more], *bounds, False), _search(columns[k], high[k][more], *bounds, True)
    return lo, hi


def _search(column: np.ndarray, values: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each value between its own bounds, all values at once."""
    lo, hi = lo.copy(), hi.copy()
    while (apart := lo < hi).any():
        mid = (lo + hi) // 2
        here = column[np.minimum(mid, len(column) - 1)]
        go = (here <= values if right else here < values) & apart
        lo, hi = np.where(go, mid + 1, lo), np.where(apart & ~go, mid, hi)
    return lo


@cache
def _codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text and ids of every row of `docs` (doc_id, text).

    Ids are those of the model's own library. Null and empty texts have no ids. Rows are encoded one by one whatever
    their doc_id; equal texts have equal ids; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model or default_model())
        for batch in batches:
            for start, stop in slices(batch["text"]):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text"], codec.encode(part["text"])], names=["doc_id", "text", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """`rows` (doc_id, text, ids) with `decoded`, the text that the ids spell, and `ids_crc32` of their 32-bit words.

    A null list is empty. U+2581 and a blank are one character to the model; it comes back as a blank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model or default_model())
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                lists = [x or [] for x in part["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"], part["text"], part["ids"],
                        pa.array([codec.decode(x) for x in lists], pa.string()),
                        pa.array([zlib.crc32(np.array(x, "<u4").tobytes()) for x in lists], pa.int64()),
                    ],
                    names=["doc_id", "text", "ids", "decoded", "ids_crc32"],
                )

    return rows.select("doc_id", "text", "ids").mapInArrow(
        run, "doc_id long, text string, ids array<int>, decoded string, ids_crc32 long"
    )


def codec_query(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Digests of `encoded` and then `decoded`, in one pass: doc_id, n_ids, ids_crc32, decoded_sha256, round_trip.

    Both directions share a Python worker, so that texts and ids stay in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model or default_model())
        for batch in batches:
            for start, stop in slices(batch["text"]):
                part = batch.slice(start, stop - start)
                lists = codec.encode(part["text"])
                ids, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
                data, rows = memoryview(ids.astype("<u4")), []
                for k, (text, spelled) in enumerate(zip(part["text"].to_pylist(), codec.spelled(ids, edges), strict=True)):
                    digest = hashlib.sha256(spelled.encode()).hexdigest()
                    crc = zlib.crc32(data[edges[k] : edges[k + 1]])
                    rows.append((int(edges[k + 1] - edges[k]), crc, digest, spelled == (text or "").replace(BLANK, " ")))
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    )
