"""Finalists of many profiles over one corpus, without scoring every profile against every document.

Keyword scores come from posting lists with the highest part of each list and of each list's blocks. A document whose
bound stays below the worst place of a profile is never joined with that profile's terms. The order and the scores of
what is returned equal full scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..session import cut_lineage, stored
from . import retrieve

#: Documents of one block of a posting list, about.
BLOCK_ROWS = 8
#: Profiles whose vectors go to a task at once, about.
PROFILE_BLOCK = 1024
#: Bounds are sums in another order than the scores they bound.
SLACK = 1e-6


def impacts(documents: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gram, id, block, part) of every posting of a query term, (profile_id, gram, w), and one row about the corpus.

    `part` is what a posting adds to a score for a weight of one; `w` is the term's weight times its idf.
    """
    wanted = retrieve.query_terms(terms)
    postings = retrieve.posting_lists(documents, wanted)
    corpus = cut_lineage(
        postings.where("gram = ''").agg(
            F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("length"), F.lit(0.0)), F.lit(1.0)).alias("avg_length")
        )
    )
    n, average = corpus.select("n").scalar(), corpus.select("avg_length").scalar()
    saturation = F.col("tf") + fv.BM25_K1 * (1 - fv.BM25_B + fv.BM25_B * F.col("length") / average)
    lists = cut_lineage(
        postings.where("gram <> ''").select(
            "gram",
            "id",
            F.pmod(F.xxhash64("id"), F.ceil(n / BLOCK_ROWS)).alias("block"),
            (F.col("tf") * (fv.BM25_K1 + 1) / saturation).alias("part"),
        )
    )
    frequency = lists.groupBy("gram").agg(F.count("*").alias("df"), F.max("part").alias("most"))
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = wanted.join(frequency, "gram").select("profile_id", "gram", (F.col("weight") * idf).alias("w"), "most")
    return lists, stored(weighted), corpus


def _best(rows: DataFrame, score: str, top: int, by: str = "profile_id") -> DataFrame:
    """The `top` highest rows of each profile; ties go to the smaller id. Tasks keep so many before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round(score, 6)), "id")
    return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= top)


def _worst_place(rows: DataFrame, score: str, top: int) -> DataFrame:
    """(profile_id, least): the score of place `top`; profiles with fewer rows have none."""
    best = _best(rows, score, top)
    return best.groupBy("profile_id").agg(F.min(score).alias("least"), F.count("*").alias("_n")).where(F.col("_n") == top).drop("_n")


def keyword_of(pairs: DataFrame, lists: DataFrame, weighted: DataFrame) -> DataFrame:
    """(profile_id, id, keyword) of the given pairs, 0 without a common term. Reads only their postings."""
    pairs = pairs.select("profile_id", "id").distinct()
    found = pairs.join(weighted, "profile_id").join(lists, ["gram", "id"])
    scores = found.groupBy("profile_id", "id").agg(F.sum(F.col("w") * F.col("part")).alias("keyword"))
    return pairs.join(scores, ["profile_id", "id"], "left").withColumn("keyword", F.coalesce("keyword", F.lit(0.0)))


def candidates(lists: DataFrame, weighted: DataFrame, top: int) -> DataFrame:
    """(profile_id, id) of the documents that can be among the `top` by keywords.

    The `top` highest postings of each term give a first worst place. Terms are added up from the weakest as long as
    all of them together stay below it: a document needs one of the other terms. Of those that have one, the bound of
    the weak terms is taken in the document's own block.
    """
    by_gram = Window.partitionBy("gram").orderBy(F.desc("part"), "id")
    champions = lists.withColumn("_place", F.row_number().over(by_gram)).where(F.col("_place") <= top).drop("_place")
    partial = champions.join(weighted, "gram").groupBy("profile_id", "id").agg(F.sum(F.col("w") * F.col("part")).alias("known"))
    least = _worst_place(partial, "known", top)
    rising = Window.partitionBy("profile_id").orderBy(F.col("w") * F.col("most"), "gram").rowsBetween(Window.unboundedPreceding, 0)
    split = stored(
        weighted.join(least, "profile_id", "left")
        .withColumn("least", F.coalesce("least", F.lit(0.0)))
        .withColumn("weak", F.sum(F.col("w") * F.col("most")).over(rising) < F.col("least") - SLACK)
    )
    strong = lists.join(split.where("NOT weak").select("profile_id", "gram", "w", "least"), "gram")
    found = strong.groupBy("profile_id", "id", "block").agg(F.sum(F.col("w") * F.col("part")).alias("known"), F.first("least").alias("least"))
    highest = lists.groupBy("gram", "block").agg(F.max("part").alias("most_here"))
    rest = (
        split.where("weak").join(highest, "gram").groupBy("profile_id", "block").agg(F.sum(F.col("w") * F.col("most_here")).alias("rest"))
    )
    bound = F.col("known") + F.coalesce("rest", F.lit(0.0))
    bounded = found.join(rest, ["profile_id", "block"], "left").withColumn("bound", bound).where(F.col("bound") >= F.col("least") - SLACK)
    bounded = cut_lineage(bounded.select("profile_id", "id", "known", "bound"))
    # With all strong terms known the worst place is higher than before.
    return (
        bounded.join(_worst_place(bounded, "known", top), "profile_id", "left")
        .where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)
        .select("profile_id", "id")
    )


def top_keyword(documents: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    """(profile_id, id, keyword, place): the `top` documents of each profile by BM25, ties to six digits by id.

    Input: documents(id, body), terms(profile_id, term, weight). The corpus is all of `documents`, for every profile.
    """
    lists, weighted, _ = impacts(documents, terms)
    return _top(lists, weighted, top)


def _top(lists: DataFrame, weighted: DataFrame, top: int) -> DataFrame:
    scored = keyword_of(candidates(lists, weighted, top), lists, weighted)
    return _best(scored, "keyword", top).withColumnRenamed("_place", "place")


# --- vectors -----------------------------------------------------------------------------------


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch["vector"].flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)


def _extremes(vectors: DataFrame, names: np.ndarray, profiles: np.ndarray, top: int) -> DataFrame:
    """(profile_id, id, metered, semantic) of the highest of each task, overall and among metered, and of the lowest."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list] = {"high": [None] * len(names), "metered": [None] * len(names), "low": [None] * len(names)}

        def keep(kind: str, p: int, score: np.ndarray, ids: np.ndarray, most: int, sign: int) -> None:
            if kept[kind][p] is not None:
                score, ids = np.concatenate([kept[kind][p][0], score]), np.concatenate([kept[kind][p][1], ids])
            order = np.lexsort((ids, sign * score))[:most]
            kept[kind][p] = score[order], ids[order]

        for batch in batches:
            scores = profiles @ _unit(_matrix(batch)).T
            ids = batch["id"].to_numpy()
            metered = batch["metered"].to_numpy(zero_copy_only=False).astype(bool)
            for p, score in enumerate(scores):
                keep("high", p, score, ids, top, -1)
                keep("low", p, score, ids, 1, 1)
                if metered.any():
                    keep("metered", p, score[metered], ids[metered], top, -1)
        for kind, found in kept.items():
            for p, one in enumerate(found):
                if one is not None:
                    score, ids = one
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(names[p], len(ids))), pa.array(ids), pa.array([kind] * len(ids)), pa.array(score)],
                        ["profile_id", "id", "kind", "semantic"],
                    )

    return vectors.mapInArrow(look, "profile_id long, id long, kind string, semantic double")


def _reaching(vectors: DataFrame, names: np.ndarray, profiles: np.ndarray, least: np.ndarray, least_metered: np.ndarray) -> DataFrame:
    """(profile_id, id, semantic) of the pairs whose cosine reaches what the profile asks for."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = profiles @ _unit(_matrix(batch)).T
            metered = batch["metered"].to_numpy(zero_copy_only=False).astype(bool)
            p, d = np.nonzero((scores >= least[:, None]) | (metered[None, :] & (scores >= least_metered[:, None])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[p]), batch["id"].take(pa.array(d)), pa.array(scores[p, d]), pa.array(metered[d])],
                ["profile_id", "id", "semantic", "metered"],
            )

    return vectors.mapInArrow(look, "profile_id long, id long, semantic double, metered boolean")


# --- both --------------------------------------------------------------------------------------


def _rescaled(column: str) -> Column:
    low, high = F.col(f"low_{column}"), F.col(f"high_{column}")
    return F.when(high - low < 1e-9, 0.5).otherwise((F.col(column) - low) / (high - low))


def _hybrid() -> Column:
    return fv.SEMANTIC_WEIGHT * _rescaled("semantic") + fv.KEYWORD_WEIGHT * _rescaled("keyword")


def _least_keyword(lists: DataFrame, weighted: DataFrame, corpus: DataFrame) -> DataFrame:
    """(profile_id, low_keyword): 0 unless every document holds a term of the profile.

    One document without any term of any profile settles it for all; only a corpus without such a document has its
    lists read for each profile.
    """
    held = lists.select("id").distinct().count()
    if held < corpus.select("n").first()[0]:
        return weighted.select("profile_id").distinct().withColumn("low_keyword", F.lit(0.0))
    every = lists.join(weighted, "gram").groupBy("profile_id", "id").agg(F.sum(F.col("w") * F.col("part")).alias("keyword"))
    low = every.groupBy("profile_id").agg(F.count("*").alias("held"), F.min("keyword").alias("least"))
    return low.select("profile_id", F.when(F.col("held") == held, F.col("least")).otherwise(0.0).alias("low_keyword"))


def ranked_by_bound(documents: DataFrame, profiles: DataFrame, terms: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """(profile_id, id, semantic, keyword, hybrid) of all that can be in the `top`, overall or of metered documents.

    Input: documents(id, body, vector, metered) with one row per id, profiles(profile_id, profile_vector),
    terms(profile_id, term, weight). Documents without a vector are no part of the corpus. Second comes the table of
    pairs whose keyword score was computed. The result is what `retrieve.finalists` needs for `top`.

    Vectors of about PROFILE_BLOCK profiles at a time go to the tasks, where one product gives a batch's cosines; only the
    extremes and, in a second pass, pairs that can still get a place come out of it.
    """
    documents = documents.where("vector IS NOT NULL")
    lists, weighted, corpus = impacts(documents.select("id", "body"), terms)
    vectors = cut_lineage(documents.select("id", F.col("vector").cast("array<double>").alias("vector"), F.coalesce("metered", F.lit(False)).alias("metered")))
    by_words = cut_lineage(_top(lists, weighted, top))
    ranges = _least_keyword(lists, weighted, corpus).join(
        by_words.groupBy("profile_id").agg(F.max("keyword").alias("high_keyword")), "profile_id"
    )
    owners = profiles.where("profile_vector IS NOT NULL").select("profile_id", F.col("profile_vector").cast("array<double>").alias("vector"))
    parts = max(1, -(-owners.count() // PROFILE_BLOCK))
    owners = cut_lineage(owners.withColumn("part", F.pmod(F.xxhash64("profile_id"), F.lit(parts))))
    used = sorted(r.part for r in owners.select("part").distinct().collect())  # a number for each block
    if not used:
        spark = documents.sparkSession
        pairs = "profile_id long, id long, semantic double"
        return spark.createDataFrame([], f"{pairs}, keyword double, hybrid double"), spark.createDataFrame([], pairs)
    out = [_block(owners.where(F.col("part") == part).drop("part"), vectors, lists, weighted, by_words, ranges, top) for part in used]
    return _union([x[0] for x in out]), _union([x[1] for x in out])


def _union(frames: list[DataFrame]) -> DataFrame:
    first = frames[0]
    for frame in frames[1:]:
        first = first.unionByName(frame)
    return first


def _block(
    owners: DataFrame, vectors: DataFrame, lists: DataFrame, weighted: DataFrame, by_words: DataFrame, ranges: DataFrame, top: int
) -> tuple[DataFrame, DataFrame]:
    rows = owners.collect()  # about PROFILE_BLOCK rows
    names = np.array([r.profile_id for r in rows], np.int64)
    matrix = _unit(np.array([r.vector for r in rows], np.float64))
    extremes = cut_lineage(_extremes(vectors, names, matrix, top))
    scale = extremes.groupBy("profile_id").agg(F.min("semantic").alias("low_semantic"), F.max("semantic").alias("high_semantic"))
    scale = cut_lineage(scale.join(ranges, "profile_id", "left").fillna(0.0, ["low_keyword", "high_keyword"]))
    # Exact scores of some documents that are likely to win give the worst places to be reached.
    by_vector = extremes.where("kind <> 'low'").select("profile_id", "id")
    seeds = by_vector.unionByName(by_words.select("profile_id", "id")).join(owners.select("profile_id"), "profile_id", "left_semi").distinct()
    semantic = (
        seeds.join(vectors, "id")
        .join(owners.withColumnRenamed("vector", "own"), "profile_id")
        .select("profile_id", "id", "metered", retrieve.cosine(F.col("vector"), F.col("own")).alias("semantic"))
    )
    known = semantic.join(keyword_of(seeds, lists, weighted), ["profile_id", "id"]).join(scale, "profile_id").withColumn("hybrid", _hybrid())
    known = cut_lineage(known.select("profile_id", "id", "metered", "hybrid"))
    least = (
        scale.join(_worst_place(known, "hybrid", top).withColumnRenamed("least", "all_"), "profile_id", "left")
        .join(_worst_place(known.where("metered"), "hybrid", top).withColumnRenamed("least", "metered_"), "profile_id", "left")
        .fillna(float("-inf"), ["all_", "metered_"])
    )
    least = cut_lineage(least)

    # The cosine that a pair needs if its keyword score were the highest.
    def cut(place: str) -> Column:
        flat = F.col("high_semantic") - F.col("low_semantic") < 1e-9
        best_words = F.when(F.col("high_keyword") - F.col("low_keyword") < 1e-9, 0.5).otherwise(1.0)
        share = (F.col(place) - SLACK - fv.KEYWORD_WEIGHT * best_words) / fv.SEMANTIC_WEIGHT
        return F.when(flat, F.lit(float("-inf"))).otherwise(F.col("low_semantic") + share * (F.col("high_semantic") - F.col("low_semantic")))

    cuts = {r.profile_id: r for r in least.select("profile_id", cut("all_").alias("a"), cut("metered_").alias("m")).collect()}  # one row a profile
    near = cut_lineage(_reaching(vectors, names, matrix, np.array([cuts[n].a if n in cuts else np.inf for n in names]), np.array([cuts[n].m if n in cuts else np.inf for n in names])))
    # What the terms can add in the document's own block.
    blocks = lists.select("id", "block").distinct()
    highest = lists.groupBy("gram", "block").agg(F.max("part").alias("most_here"))
    placed = near.join(blocks, "id", "left")
    asked = placed.select("profile_id", "block").distinct()
    rest = (
        asked.join(weighted, "profile_id").join(highest, ["gram", "block"]).groupBy("profile_id", "block").agg(F.sum(F.col("w") * F.col("most_here")).alias("keyword"))
    )
    bound = placed.join(rest, ["profile_id", "block"], "left").withColumn("keyword", F.coalesce("keyword", F.lit(0.0))).join(least, "profile_id")
    can = (_hybrid() >= F.col("all_") - SLACK) | (F.col("metered") & (_hybrid() >= F.col("metered_") - SLACK))
    open_ = cut_lineage(bound.where(can).select("profile_id", "id", "semantic"))
    scored = keyword_of(open_, lists, weighted).join(open_, ["profile_id", "id"]).join(scale, "profile_id")
    return scored.select("profile_id", "id", "semantic", "keyword", _hybrid().alias("hybrid")), open_
