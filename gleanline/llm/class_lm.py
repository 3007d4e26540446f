"""Language-model scoring with Brown classes.

Every word of the training texts is put into a class by exchange clustering: each word moves to the class that raises
the likelihood of the class bigrams most. The FREQUENT most frequent words move one by one on the driver, until no move
is left, while all others are in classes by their ending. Then all others move, in rounds over the whole input: tasks
count the classes beside each word, and tasks that hold all counts of a word choose its class against the table of class
bigrams. Only words that no training text has stay in a class by ending. The probability of a text is the product of
class transitions and of word emissions, whose counts come from all training texts.

Texts are cut into blocks of bounded size. A block's distinct words go to buckets by their hash, as one row per block
and bucket, and counts and classes come back to the block; so a word crosses the network once per block, not per use.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, hashes, slices, store, words_of
from .subwords import remainder

#: Words that move one by one before the others, their classes, and the classes by ending from which all others start.
FREQUENT, CLASSES, ENDINGS = 600, 32, 16
#: Rounds in which all other words move; they end before when one raises the likelihood by less than LEAST_ROUND a token.
ROUNDS, LEAST_ROUND = 3, 1e-3
SMOOTH = 0.1
LEAST_GAIN = 1e-9
MOST_BUCKETS = 1024
#: Counts beside words that a task weighs at a time, against every class.
WEIGHED = 1 << 15
BLOCK_BYTES = 12 << 20


def ending(words: pa.Array) -> np.ndarray:
    """Class by the last two characters of each word."""
    tails = pc.dictionary_encode(pc.utf8_slice_codeunits(words, -2))
    known = np.array([zlib.crc32(t.encode()) % ENDINGS for t in tails.dictionary.to_pylist()], np.int64)
    return known[tails.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int64)


def blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks of `docs` (doc_id, text, train): rows of words (block, bucket, first, words, n) and of texts (block, doc_id, codes).

    A block's words are numbered bucket by bucket; `words` are those from number `first` on, with blanks between them,
    and `n` counts each in training texts.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch["text"], BLOCK_BYTES):
                part = batch.slice(start, stop - start)
                words = words_of(part["text"])
                train = part["train"].to_numpy(zero_copy_only=False)
                kinds, texts = len(words.values), len(part)
                n = np.bincount(words.codes, weights=train[words.rows()], minlength=kinds).astype(np.int32)
                block = uuid.uuid4().int >> 65
                bucket = (hashes(words.values) % np.uint64(buckets)).astype(np.int32) if kinds else np.zeros(0, np.int32)
                order = np.argsort(bucket, kind="stable")
                held, first = np.unique(bucket[order], return_index=True)
                edges = pa.array(np.append(first, kinds).astype(np.int32))
                lists = pa.ListArray.from_arrays(edges, words.values.take(pa.array(order)))
                rows = len(held)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, block)), pa.array(held), pa.array(first.astype(np.int32)), pc.binary_join(lists, " "),
                        pa.ListArray.from_arrays(edges, pa.array(n[order])), pa.nulls(rows, pa.int64()),
                        pa.nulls(rows, pa.bool_()), pa.nulls(rows, pa.list_(pa.int32())),
                    ],
                    names=NAMES,
                )
                place = np.empty(kinds, np.int32)
                place[order] = np.arange(kinds, dtype=np.int32)
                codes = pa.ListArray.from_arrays(words.starts.astype(np.int32), pa.array(place[words.codes]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(texts, block)), pa.nulls(texts, pa.int32()), pa.nulls(texts, pa.int32()),
                        pa.nulls(texts, pa.string()), pa.nulls(texts, pa.list_(pa.int32())), part["doc_id"], part["train"], codes,
                    ],
                    names=NAMES,
                )

    return docs.select("doc_id", "text", "train").mapInArrow(
        cut, "block long, bucket int, first int, words string, n array<int>, doc_id long, train boolean, codes array<int>"
    )


NAMES = ["block", "bucket", "first", "words", "n", "doc_id", "train", "codes"]


def _bytes(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Stretches of an array of bytes as binary values."""
    return pa.Array.from_buffers(
        pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data, np.uint8))]
    )


def _joined(values: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.uint8)


def _lists(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All elements of the lists, and where each list starts and ends among them."""
    lists = values.combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def counted(words: DataFrame) -> DataFrame:
    """Rows of words with the number of each in its bucket, its count in all training texts and its ending.

    A bucket's words are numbered from the most frequent on, equal ones in the order of their bytes. A bucket's row without
    a block has its first FREQUENT training words, with blanks between them, `c` of each, and the number of its training
    words per ending (`ids`).
    """

    def count(table: pa.Table) -> pa.Table:
        lists = pc.split_pattern(table["words"].combine_chunks(), " ")
        n, edges = _lists(table["n"])
        coded = pc.dictionary_encode(lists.flatten())
        codes, kinds = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        c = np.bincount(codes, weights=n, minlength=len(kinds)).astype(np.int64)
        order = pc.sort_indices(pa.table({"c": c, "word": kinds}), [("c", "descending"), ("word", "ascending")]).to_numpy()
        ids = np.empty(len(order), np.int32)
        ids[order] = np.arange(len(order), dtype=np.int32)
        last = ending(kinds)
        rows, offsets, bucket = len(table), pa.array(edges.astype(np.int32)), table["bucket"][0]
        out = pa.table(
            {
                "block": table["block"], "bucket": table["bucket"], "first": table["first"],
                "ids": pa.ListArray.from_arrays(offsets, pa.array(ids[codes])),
                "c": pa.ListArray.from_arrays(offsets, pa.array(c[codes])),
                "label": _bytes(last[codes], edges), "word": pa.nulls(rows, pa.string()),
            }
        )
        top = order[:FREQUENT][c[order[:FREQUENT]] > 0]
        per = np.bincount(last[c > 0], minlength=ENDINGS)
        own = pa.table(
            {
                "block": pa.nulls(1, pa.int64()), "bucket": pa.array([bucket.as_py()], pa.int32()), "first": pa.nulls(1, pa.int32()),
                "ids": pa.array([per], pa.list_(pa.int32())), "c": pa.array([c[top]], pa.list_(pa.int64())),
                "label": pa.nulls(1, pa.binary()), "word": pa.array([" ".join(kinds.take(pa.array(top)).to_pylist())]),
            }
        )
        return pa.concat_tables([out, own])

    return words.select("block", "bucket", "first", "words", "n").groupBy("bucket").applyInArrow(
        count, "block long, bucket int, first int, ids array<int>, c array<long>, label binary, word string"
    )


LABELLED = "block long, bucket int, first int, ids array<int>, c array<long>, label binary"


def started(met: DataFrame, top: dict[int, list[int]], classes: int) -> DataFrame:
    """Rows of words of `counted` with their first classes: those of `top` (by bucket, in order of their ids), else by ending."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids, edges = _lists(pa.chunked_array([batch["ids"]]))
            label = _joined(batch["label"]) + np.uint8(classes)
            for k, bucket in enumerate(batch["bucket"].to_pylist()):
                few = np.array(top.get(bucket, []), np.uint8)
                here, own = ids[edges[k] : edges[k + 1]], label[edges[k] : edges[k + 1]]
                placed = here < len(few)
                own[placed] = few[here[placed]]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("block", "bucket", "first", "ids", "c")], _bytes(label, edges)], names=["block", "bucket", "first", "ids", "c", "label"])

    return met.select("block", "bucket", "first", "ids", "c", "label").mapInArrow(start, LABELLED)


def _labels(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Class and training count of each word of a block, by its number there."""
    rows = rows.sort_by("first")
    return _joined(rows["label"]).astype(np.int64), _lists(rows["c"])[0]


def _chain(texts: pa.Table, label: np.ndarray, end_class: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words, their number per text, and the classes of words and ends in a row, with where the ends go."""
    codes, edges = _lists(texts["codes"])
    return codes, np.diff(edges), np.insert(label[codes], edges[1:], end_class), edges[1:]


def beside(labelled: DataFrame, texts: DataFrame, k: int, whole: bool) -> DataFrame:
    """How often classes stand beside each word in training texts, and (rows without bucket) each block's table of class bigrams.

    A word has `sizes` slots, the number of a class after it or `k` + the class before it; `times` are cut at 255, and
    `more` has the full ones of those. Without `whole` only tables come out.
    """
    schema = "block long, bucket int, first int, ids array<int>, c array<long>, label binary, sizes binary, slots binary, times binary, more array<int>, pairs array<long>"

    def count(rows: pa.Table, texts: pa.Table) -> pa.Table:
        rows, texts = rows.sort_by("first"), texts.filter(texts["train"])
        label, _ = _labels(rows)
        codes, _, chain, stops = _chain(texts, label, k - 1)
        before = np.concatenate([[k - 1], chain[:-1]])
        pairs = np.bincount(before * k + chain, minlength=k * k)
        table = pa.table(
            {f: pa.nulls(1, t) for f, t in _FIELDS} | {"pairs": pa.array([pairs], pa.list_(pa.int64()))}
        )
        if not whole or not len(rows):
            return table
        word = np.ones(len(chain), bool)
        word[stops + np.arange(len(stops))] = False
        spot = np.flatnonzero(word)
        base = codes.astype(np.int64) * (2 * k)
        found = np.concatenate([base + chain[spot + 1], base + k + before[spot]]).astype(np.int64)
        found.sort()
        new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(found)))
        found = found[new]
        per = np.bincount(found // (2 * k), minlength=len(label))
        ids, edges = _lists(rows["ids"])
        at = np.concatenate([[0], np.cumsum(per)])[edges]
        large = times >= 255
        more_at = np.concatenate([[0], np.cumsum(large)])[at].astype(np.int32)
        out = pa.table(
            {c: rows[c] for c in ("block", "bucket", "first", "ids", "c", "label")}
            | {
                "sizes": _bytes(per, edges), "slots": _bytes(found % (2 * k), at), "times": _bytes(np.minimum(times, 255), at),
                "more": pa.ListArray.from_arrays(pa.array(more_at), pa.array(times[large].astype(np.int32))),
                "pairs": pa.nulls(len(rows), pa.list_(pa.int64())),
            }
        )
        return pa.concat_tables([out, table])

    return labelled.groupBy("block").cogroup(texts.groupBy("of_block")).applyInArrow(count, schema)


_FIELDS = [
    ("block", pa.int64()), ("bucket", pa.int32()), ("first", pa.int32()), ("ids", pa.list_(pa.int32())), ("c", pa.list_(pa.int64())),
    ("label", pa.binary()), ("sizes", pa.binary()), ("slots", pa.binary()), ("times", pa.binary()), ("more", pa.list_(pa.int32())),
]


def best_classes(beside: np.ndarray, label: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood of the class bigrams in `table` most; the last one and empty ones are closed.

    `beside` has for each word the counts of classes after it, then before it. Words are weighed one by one, each
    without its own counts in its class.
    """
    k = len(table)
    cells, totals = np.hstack([table, table.T]), table.sum(1)
    cell_worth, total_worth = _xlogx(cells), _xlogx(totals)
    closed = totals == 0  # to an empty class all words would go at once
    closed[k - 1] = True
    n = beside[:, :k].sum(1)
    out = label.copy()
    filled = np.count_nonzero(beside, axis=1)
    stops = np.cumsum(filled)
    start = 0
    while start < len(label):
        stop = max(start + 1, int(np.searchsorted(stops, (stops[start - 1] if start else 0) + WEIGHED, side="right")))
        part, own, count = beside[start:stop], label[start:stop], n[start:stop]
        row, slot = np.nonzero(part)
        times = part[row, slot]
        every = np.arange(len(part))
        gain = _xlogx(cells.T[slot] + times[:, None]) - cell_worth.T[slot]
        here = own[row]
        gain[np.arange(len(row)), here] = cell_worth[here, slot] - _xlogx(cells[here, slot] - times)
        summed = np.zeros((len(part), k))
        some = np.flatnonzero(filled[start:stop])
        if len(some):
            summed[some] = np.add.reduceat(gain, np.searchsorted(row, some), axis=0)
        price = _xlogx(totals + count[:, None]) - total_worth
        price[every, own] = total_worth[own] - _xlogx(totals[own] - count)
        summed -= 2 * price
        summed[:, closed] = -np.inf
        best = summed.argmax(1)
        better = summed[every, best] > summed[every, own] + LEAST_GAIN * totals.sum()
        out[start:stop] = np.where(better, best, own)
        start = stop
    return out


def moved(seen: DataFrame, table: np.ndarray, fixed: dict[int, int]) -> DataFrame:
    """Rows of words with new classes; rows without a block have the training words that each class gains by the moves.

    The first `fixed` words of a bucket and words of no training text stay.
    """
    k = len(table)

    def move(rows: pa.Table) -> pa.Table:
        ids, edges = _lists(rows["ids"])
        label = np.zeros(int(ids.max()) + 1, np.int64)
        label[ids] = _joined(rows["label"])
        slots, times, more = _joined(rows["slots"]), _joined(rows["times"]).astype(np.float64), _lists(rows["more"])[0]
        times[times == 255] = more
        word = np.repeat(ids, _joined(rows["sizes"])).astype(np.int64)
        around = np.bincount(word * (2 * k) + slots, weights=times, minlength=len(label) * 2 * k).reshape(-1, 2 * k)
        free = np.flatnonzero(around.any(1))
        free = free[free >= fixed.get(rows["bucket"][0].as_py(), 0)]
        new = label.copy()
        new[free] = best_classes(around[free], label[free], table)
        gained = np.bincount(new[free], minlength=k) - np.bincount(label[free], minlength=k)
        out = pa.table({c: rows[c] for c in ("block", "bucket", "first", "ids", "c")} | {"label": _bytes(new[ids], edges)})
        stats = pa.table({f: pa.nulls(1, t) for f, t in _FIELDS[:6]} | {"c": pa.array([gained], pa.list_(pa.int64()))}).select(out.column_names)
        return pa.concat_tables([out, stats])

    return seen.where("bucket IS NOT NULL").drop("pairs").groupBy("bucket").applyInArrow(move, LABELLED)


def _summed(rows: DataFrame, column: str, size: int) -> np.ndarray:
    """The sum of lists of at most `size` numbers, place by place."""
    out = np.zeros(size)
    for at, n in rows.select(F.posexplode(column).alias("at", "n")).groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out


def likelihood(table: np.ndarray) -> float:
    """The log-likelihood of class bigrams, up to a constant."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def bigrams(docs: DataFrame, frequent: list[str]) -> np.ndarray:
    """Counts of neighbouring symbols in the training texts of `docs`: frequent words, endings, and the end of a text.

    Each task adds up a table whose size the number of symbols bounds.
    """
    end = len(frequent) + ENDINGS
    width = end + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = pa.array(frequent, pa.string()), np.zeros(width * width, np.int64)
        for batch in batches:
            for start, stop in slices(batch["text"], BLOCK_BYTES):
                words = words_of(batch["text"].slice(start, stop - start))
                at = pc.index_in(words.values, known)
                symbol = np.where(pc.is_valid(at).to_numpy(zero_copy_only=False), pc.fill_null(at, 0).to_numpy(zero_copy_only=False), len(frequent) + ending(words.values))
                chain = np.insert(symbol[words.codes], words.starts[1:], end)  # an end after each text
                before = np.concatenate([[end], chain[:-1]])
                total += np.bincount(before * width + chain, minlength=width * width)
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(total[pairs])], names=["pair", "n"])

    counted = docs.where("train").select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(width * width)
    for pair, n in counted.collect():  # at most width * width rows
        out[pair] = n
    return out.reshape(width, width)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, words: int, classes: int = CLASSES) -> np.ndarray:
    """The class of each symbol. The first `words` symbols, in order of frequency, move; each other one is a class.

    A move is judged by the sum of n log n over class bigrams less that over class counts on either side, the
    log-likelihood of the class bigram model up to a constant. It ends when no word has a move that gains more than
    LEAST_GAIN per token, which is above the error of sums.
    """
    least = LEAST_GAIN * counts.sum()
    classes = min(classes, words)
    label = np.concatenate([np.arange(words) % max(1, classes), classes + np.arange(len(counts) - words)]).astype(int)
    k = classes + len(counts) - words
    one = np.zeros((len(counts), k))
    one[np.arange(len(counts)), label] = 1
    table = one.T @ counts @ one
    moved = 1
    while moved:
        moved = 0
        for w in range(words):
            old = label[w]
            out_, in_, own = counts[w] @ one, counts[:, w] @ one, counts[w, w]
            out_[old] -= own
            in_[old] -= own
            # Take w out of its class, then see what each class would gain by it.
            table[old] -= out_
            table[:, old] -= in_
            table[old, old] -= own
            # Other words' bigrams with w fill one cell of each class whichever class w goes to.
            rows, columns = table.sum(1) + in_, table.sum(0) + out_
            every = np.arange(classes)
            new_rows, new_columns = table[every] + out_, table[:, every].T + in_
            gain = (_xlogx(new_rows) - _xlogx(table[every])).sum(1) + (_xlogx(new_columns) - _xlogx(table[:, every].T)).sum(1)
            cell = table[every, every]
            gain -= _xlogx(cell + out_[every]) + _xlogx(cell + in_[every]) - 2 * _xlogx(cell)
            gain += _xlogx(cell + out_[every] + in_[every] + own) - _xlogx(cell)
            plus_out, plus_in = out_.sum() + own, in_.sum() + own
            gain -= _xlogx(rows[every] + plus_out) - _xlogx(rows[every]) + _xlogx(columns[every] + plus_in) - _xlogx(columns[every])
            best = int(np.argmax(gain)) if gain.max() > gain[old] + least else old
            table[best] += out_
            table[:, best] += in_
            table[best, best] += own
            if best != old:
                one[w, old], one[w, best] = 0, 1
                label[w] = best
                moved += 1
    return label


def scored(docs: DataFrame, train) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 of the class model's probability) per row.

    `train` is a column of `docs` (doc_id, text) that is true for rows to learn from. A null or empty text is its end
    token alone. Without training texts nothing is known and both models give each token its smoothed share. Rows that
    share a doc_id are scored one by one; rows without doc_id are scored and learned from like others.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(train, F.lit(False)).alias("train"))
    spark = docs.sparkSession
    buckets = min(MOST_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = store(blocks(docs, buckets))
    texts = cut.where("codes IS NOT NULL").select(F.col("block").alias("of_block"), "doc_id", "train", "codes")
    met = store(counted(cut.where("words IS NOT NULL")))
    # The driver gets FREQUENT words of each of MOST_BUCKETS buckets at most.
    top: list[tuple[int, bytes, int]] = []
    for r in met.where("block IS NULL").select("bucket", "word", "c").toLocalIterator():
        own = [(-c, w.encode(), r.bucket) for w, c in zip(r.word.split(" "), r.c, strict=False)]
        top = sorted(top + own)[:FREQUENT]
    frequent = [w.decode() for _, w, _ in top]
    per_ending = _summed(met.where("block IS NULL"), "ids", ENDINGS)
    pairs = bigrams(docs, frequent)
    label = exchange(pairs, len(frequent))
    width, classes = len(pairs), int(label.max()) + 1
    end_class = classes - 1

    # Training words of each class, the end of a text among them, and the table of class bigrams.
    v_class = np.zeros(classes)
    v_class[label[len(frequent) : len(frequent) + ENDINGS]] = per_ending
    for w, e in zip(label, ending(pa.array(frequent, pa.string())), strict=False):
        v_class[w] += 1
        v_class[label[len(frequent) + e]] -= 1
    v_class[end_class] = pairs.sum(0)[-1] > 0
    one = np.zeros((width, classes))
    one[np.arange(width), label] = 1
    table = one.T @ pairs @ one
    by_bucket: dict[int, list[int]] = {}
    for k, (_, _, bucket) in enumerate(top):  # within a bucket in the order of ids
        by_bucket.setdefault(bucket, []).append(int(label[k]))
    labelled = store(started(met.where("block IS NOT NULL"), by_bucket, classes - ENDINGS - 1))
    forget(met)
    if per_ending.sum() > len(frequent):
        fixed = {b: len(x) for b, x in by_bucket.items()}
        seen = store(beside(labelled, texts, classes, True))
        for turn in range(ROUNDS):
            new = store(moved(seen, table, fixed))
            gained = _summed(new.where("block IS NULL"), "c", classes)
            new_labelled = new.where("block IS NOT NULL")
            forget(seen)
            seen = store(beside(new_labelled, texts, classes, turn < ROUNDS - 1))
            new_table = _summed(seen.where("bucket IS NULL"), "pairs", classes * classes).reshape(classes, classes)
            better = likelihood(new_table) - likelihood(table)
            if better <= 0:
                forget(new)
                break
            forget(labelled)
            labelled, table, v_class = new_labelled, new_table, v_class + gained
            if better < LEAST_ROUND * table.sum():
                break
        forget(seen)

    n_class = table.sum(0)
    tokens, distinct = float(n_class.sum()), float(v_class.sum())
    emit = np.log10(n_class + SMOOTH * (v_class + 1))
    moves = np.log10((table + SMOOTH) / (table.sum(1, keepdims=True) + SMOOTH * classes))
    end_count, base_room = float(n_class[end_class]), float(np.log10(tokens + SMOOTH * (distinct + 1)))

    def score(words: pa.Table, texts: pa.Table) -> pa.Table:
        label, c = _labels(words)
        codes, size, chain, stops = _chain(texts, label, end_class)
        known = np.insert(c[codes].astype(np.float64), stops, end_count)
        before = np.concatenate([[end_class], chain[:-1]])
        row = np.repeat(np.arange(len(size)), size + 1)
        total = lambda x: np.bincount(row, weights=x, minlength=len(size))
        numerator = total(np.log10(known + SMOOTH))
        return pa.table(
            {
                "doc_id": texts["doc_id"],
                "train": texts["train"],
                "n_tokens": pa.array(size + 1),
                "n_known": pa.array(total(known > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(size), int(tokens))),
                "base_score": pa.array(numerator - base_room * (size + 1)),
                "score": pa.array(numerator + total(moves[before, chain] - emit[chain])),
            }
        )

    return labelled.select("block", "first", "c", "label").groupBy("block").cogroup(texts.groupBy("of_block")).applyInArrow(
        score, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def lm_query(docs: DataFrame) -> DataFrame:
    found = scored(docs, remainder(F.col("doc_id").cast("long"), 10) != 0)
    return found.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
