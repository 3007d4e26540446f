"""Nearest vectors through an inverted file: lists around centroids, a few of them probed, exact cosines of what is in them.

Centroids are fitted on a bounded sample, every row is put into the list of its nearest centroid. How many lists a query
probes is chosen on the same sample, so that the wanted share of true neighbours is found there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows that centroids are fitted on, and queries among them that choose the number of probes.
FIT_ROWS, TUNE_QUERIES = 20_000, 300
#: There are about as many lists as a list has rows, up to this number.
MOST_LISTS = 4096
ROUNDS = 12
#: Rows and queries of one list that meet in one group.
GROUP_ROWS, GROUP_QUERIES = 8192, 2048
#: Queries that are held against all rows at once.
QUERY_BLOCK = 4096
_FOUND = "query_id long, id long, semantic double"


@dataclass
class Index:
    centroids: np.ndarray
    probes: int


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero vector stays zero and is similar to nothing."""
    norms = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return unit(np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1))


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.where("vector IS NOT NULL").select(F.col("id").cast("long"), F.col("vector").cast("array<double>"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by id."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _means(rows: np.ndarray, lists: int) -> np.ndarray:
    """Centroids by k-means on the sphere; an empty list takes the row that fits worst."""
    centroids = rows[np.linspace(0, len(rows) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        fit = rows @ centroids.T
        own = fit.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = rows[np.argsort(fit[np.arange(len(rows)), own])[: len(empty)]]
        centroids = unit(sums)
    return centroids


def _probes(rows: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """The least number of lists that hold the wanted share of the true neighbours of some sampled rows."""
    own = (rows @ centroids.T).argmax(1)
    asked = np.linspace(0, len(rows) - 1, min(TUNE_QUERIES, len(rows))).astype(int)
    scores = rows[asked] @ rows.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(rows) - 1)]
    order = np.argsort(-(rows[asked] @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
    needed = np.take_along_axis(place, own[near], 1).ravel()
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else 1


def fit(rows: DataFrame, k: int = 10, recall: float = 0.95) -> Index:
    """Centroids and number of probes from FIT_ROWS rows, chosen by a hash of their id. Input: id, vector."""
    rows = _vectors(rows)
    count = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow()
    if not sample.num_rows:
        return Index(np.zeros((1, 0)), 1)
    values = matrix(sample["vector"])
    lists = min(MOST_LISTS, max(1, round(count**0.5)), len(values))
    centroids = _means(values, lists)
    return Index(centroids, _probes(values, centroids, k, recall))


def assign(rows: DataFrame, index: Index) -> DataFrame:
    """(id, vector, list) of every row with a vector."""
    centroids = index.centroids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = (matrix(batch["vector"]) @ centroids.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.int32())], ["id", "vector", "list"])

    return _vectors(rows).mapInArrow(place, "id long, vector array<double>, list int")


def _probed(queries: DataFrame, index: Index) -> DataFrame:
    """(id, vector, list) once for each list that a query probes."""
    centroids, probes = index.centroids, min(index.probes, len(index.centroids))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argpartition(-(matrix(batch["vector"]) @ centroids.T), probes - 1, axis=1)[:, :probes]
            row = pa.array(np.repeat(np.arange(batch.num_rows), probes))
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(row), batch["vector"].take(row), pa.array(near.ravel(), pa.int32())], ["id", "vector", "list"]
            )

    return _vectors(queries).mapInArrow(probe, "id long, vector array<double>, list int")


def _in_parts(rows: DataFrame, most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a part of their list of about `most` rows, and the number of parts of each list."""
    parts = cut_lineage(rows.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(f"{name}s")))
    return rows.join(parts, "list").withColumn(name, F.pmod(F.xxhash64("id"), F.col(f"{name}s")).cast("int")).drop(f"{name}s"), parts


def search(assigned: DataFrame, queries: DataFrame, index: Index, k: int = 10) -> DataFrame:
    """(query_id, id, semantic, place): the k most similar rows of the probed lists, ties by id, a row's own id left out.

    Lists are cut into parts on both sides, so that a list with a third of all rows is many groups. A group returns k
    rows per query at most.
    """
    rows, row_parts = _in_parts(assigned, GROUP_ROWS, "part")
    asked, query_parts = _in_parts(cut_lineage(_probed(queries, index)), GROUP_QUERIES, "side")
    rows = rows.join(query_parts, "list").withColumn("side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).drop("sides")
    asked = asked.join(row_parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, names = left["id"].to_numpy(), right["id"].to_numpy()
            for name, score in zip(names, matrix(right["vector"]) @ matrix(left["vector"]).T, strict=True):
                score[ids == name] = -np.inf
                best = _best(score, ids, k)
                best = best[score[best] > -np.inf]
                for column, values in zip(out, (np.full(len(best), name), ids[best], score[best]), strict=True):
                    column.append(values)
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "id", "semantic"])

    keys = ["list", "part", "side"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, _FOUND)
    return _top(found, k)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("semantic"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def exact(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The same from all rows: blocks of about QUERY_BLOCK queries go to the tasks, each returns its k best per query."""
    rows, queries = _vectors(rows), _vectors(queries)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        if not asked.num_rows:
            continue
        names, values = asked["id"].to_numpy(), matrix(asked["vector"])

        def compare(batches: Iterator[pa.RecordBatch], names=names, values=values) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch["id"].to_numpy()
                scores = values @ matrix(batch["vector"]).T
                scores[names[:, None] == ids[None, :]] = -np.inf
                picked = [_best(s, ids, k) for s in scores]
                query = np.repeat(np.arange(len(names)), [len(p) for p in picked])
                place = np.concatenate(picked)
                real = scores[query, place] > -np.inf
                query, place = query[real], place[real]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[query]), pa.array(ids[place]), pa.array(scores[query, place])], ["query_id", "id", "semantic"]
                )

        found = rows.mapInArrow(compare, _FOUND)
        out = found if out is None else out.unionByName(found)
    empty = rows.sparkSession.createDataFrame([], _FOUND)
    return _top(empty if out is None else out, k)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row: queries, neighbours (true ones), recall (share of them that was found)."""
    hits = true.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    by_query = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    return by_query.agg(F.count("*").alias("queries"), F.sum("n").alias("neighbours"), (F.sum("hits") / F.sum("n")).alias("recall"))
