"""Ranked lexical search: term-at-a-time over short posting lists, document-at-a-time over the long ones.

The items that are searched for come in blocks of bounded size. A block's vocabulary goes to every task, and the
documents become rows of its terms' frequencies, from which the document frequencies are counted. Then every partition
ranks its own documents, batch by batch: the short lists of an item are summed into one list of accumulators, which
takes part as one more list with a known bound. Of these lists, those whose bounds together stay below the item's
worst kept score cannot bring in a document by themselves: documents come from the others, range by range, and the rest is looked
up only for those that can still enter. Worst kept scores go on from batch to batch, so that most documents are skipped.
A partition returns no more than the wanted number of documents per item; the best of these are the answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, Words, slices, store, words_of

TOP = 50
#: Text of the items in one block, about.
BLOCK_BYTES = 4 << 20
#: A list is short if it holds at most this share of the documents of a batch.
SHORT = 1 / 16
#: Documents of one step of the document-at-a-time part.
RANGE = 2048
NO_ID = np.iinfo(np.int64).max

_OTHER = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_LETTERS = bytes.maketrans(UPPER.encode() + _OTHER, LOWER.encode() + b" " * len(_OTHER))


def terms_of(texts: pa.Array) -> Words:
    """Stretches of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = texts.buffers()[2]
    data = bytes(data.slice(int(ends[0]), int(ends[-1] - ends[0]))).translate(_LETTERS) if data else b""
    return words_of(pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(data)), lower=False)


def frequencies(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """doc_id, n (all terms), and the codes and frequencies of the terms in `vocabulary`; documents without a term go."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch["text"]):
                words = terms_of(batch["text"].slice(start, stop - start))
                code = pc.fill_null(pc.index_in(words.values, vocabulary), -1).to_numpy(zero_copy_only=False)[words.codes]
                there = code >= 0
                pairs, tf = np.unique(words.rows()[there] * len(vocabulary) + code[there], return_counts=True)
                row, code = np.divmod(pairs, max(len(vocabulary), 1))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=stop - start))]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (code, tf)]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(start, stop - start), pa.array(words.counts), *lists], ["doc_id", "n", "codes", "tfs"]
                ).filter(pa.array(words.counts > 0))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        count, "doc_id long, n long, codes array<int>, tfs array<int>"
    )


class Postings:
    """Lists of (document, contribution to a score) of a batch, by term."""

    def __init__(self, code: np.ndarray, row: np.ndarray, worth: np.ndarray, terms: int, documents: int):
        order = np.lexsort((row, code))
        self.row, self.worth, self.documents = row[order], worth[order], documents
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=terms))])
        self.sizes = np.diff(self.ends)
        self.bounds = np.zeros(terms, np.int64)
        full = np.flatnonzero(self.sizes)
        if len(full):
            self.bounds[full] = np.maximum.reduceat(self.worth, self.ends[full])

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.ends[term], self.ends[term + 1])
        return self.row[part], self.worth[part]


class Best:
    """The highest scores of one item so far, equal ones by ascending id."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids, self.least = top, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.top:
            self.least = int(self.scores[-1])  # one that equals it can still have the smaller id


def search(lists: Postings, terms: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Add the documents of a batch that belong to the best of an item; how many documents were scored."""
    terms = terms[lists.sizes[terms] > 0]
    short = lists.sizes[terms] <= max(1, lists.documents * SHORT)
    parts, least = [lists.list(t) for t in terms[~short]], best.least
    if short.any():
        rows, worth = (np.concatenate(x) for x in zip(*map(lists.list, terms[short]), strict=True))
        sums = np.bincount(rows, worth, lists.documents).astype(np.int64)  # whole numbers below 2 ** 53
        parts.append((rows := np.flatnonzero(sums), sums := sums[rows]))
        if len(sums) >= best.top:  # so many documents score no less than their accumulators say
            least = max(least, int(np.partition(sums, -best.top)[-best.top]))
    bounds = np.array([p[1].max(initial=0) for p in parts], np.int64)
    order = np.argsort(bounds, kind="stable")
    parts, bounds = [parts[k] for k in order], bounds[order]
    together = np.cumsum(bounds)
    scored, edges = 0, np.arange(0, lists.documents + RANGE, RANGE)
    cuts = [np.searchsorted(rows, edges) for rows, _ in parts]
    for block in range(len(edges) - 1):
        first = int(np.searchsorted(together, least))  # lists before it stay below the least score to be kept together
        if first == len(parts):
            break
        got = np.zeros(RANGE, np.int64)
        for (rows, worth), cut in zip(parts[first:], cuts[first:], strict=True):
            part = slice(cut[block], cut[block + 1])
            got[rows[part] - edges[block]] += worth[part]
        found = np.flatnonzero(got)
        got = got[found]
        found += edges[block]
        for k in range(first - 1, -1, -1):
            can = got + together[k] >= least
            found, got = found[can], got[can]
            part = slice(cuts[k][block], cuts[k][block + 1])
            rows, worth = parts[k][0][part], parts[k][1][part]
            if not len(found) or not len(rows):
                continue
            at = np.minimum(np.searchsorted(rows, found), len(rows) - 1)
            got += np.where(rows[at] == found, worth[at], 0)
        scored += len(found)
        good = got >= least
        if good.any():
            best.add(got[good], ids[found[good]])
            least = max(least, best.least)
    return scored


def ranked_in_parts(tf: DataFrame, item_ids: list[int | None], terms: list[np.ndarray], weights: np.ndarray, n: int, total: int, top: int) -> DataFrame:
    """The best documents of every item in each partition of `tf`."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in terms]
        for batch in batches:
            sizes = pc.list_value_length(batch["codes"]).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            code, tf = (batch[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("codes", "tfs"))
            m = 50 + 50 * batch["n"].to_numpy() * n // total
            worth = weights[code] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
            lists = Postings(code, row, worth, len(weights), len(sizes))
            ids = pc.fill_null(batch["doc_id"], NO_ID).to_numpy(zero_copy_only=False)
            for own, found in zip(terms, best, strict=True):
                search(lists, own, ids, found)
        for item, found in zip(item_ids, best, strict=True):
            if len(found.ids):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * len(found.ids), pa.int64()),
                        pa.array(found.ids, mask=found.ids == NO_ID),
                        pa.array(found.scores),
                    ],
                    ["item_id", "doc_id", "score"],
                )

    return tf.mapInArrow(rank, "item_id long, doc_id long, score long")


def _block(docs: DataFrame, rows: list, top: int) -> DataFrame:
    words = terms_of(pa.array([r.text for r in rows], pa.string()))
    by_item: dict[int | None, set[int]] = {}
    for i, r in enumerate(rows):
        by_item.setdefault(r.item_id, set()).update(words.codes[words.starts[i] : words.starts[i + 1]].tolist())
    item_ids, terms = list(by_item), [np.array(sorted(t), np.int64) for t in by_item.values()]
    tf = store(frequencies(docs, words.values))
    n, total = tf.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words.values), np.int64)
    for code, count in tf.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # the block's vocabulary at most
        df[code] = count
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    return ranked_in_parts(tf, item_ids, terms, weights, n, total, top)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` best documents (doc_id, text) for every item (item_id, text).

    Rows of one item_id, null among them, are one item with the terms of all. A null text has no terms. Documents that
    repeat, or share a doc_id, take ranks of their own; those without doc_id count like others and come last among equal
    scores. Items without a match, and empty tables, give no rows. Other columns are not read. Texts are read whole,
    once for each block of about BLOCK_BYTES of item text.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    found = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # about BLOCK_BYTES
        if rows:
            found.append(_block(docs, rows, top))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    every = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order))
    return every.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def oracle(top: int = TOP) -> str:
    """The same ranking by a full join, as DuckDB SQL."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def terms(key: str, table: str) -> str:
        return f"SELECT {key}, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{pattern}')) AS term FROM {table}"

    return f"""
WITH numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
doc_terms AS ({terms("r, doc_id", "numbered")}),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM doc_terms GROUP BY r, doc_id, term),
sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
item_terms AS (SELECT DISTINCT item_id, term FROM ({terms("item_id", "benchmark")})),
weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM tf, totals GROUP BY term, n_docs
),
worth AS (
    SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS worth
    FROM tf JOIN sizes USING (r) JOIN weights USING (term), totals
),
scores AS (
    SELECT item_id, r, doc_id, sum(worth)::BIGINT AS score FROM item_terms JOIN worth USING (term) GROUP BY item_id, r, doc_id
),
best AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= {top}
"""
