"""Finalists by bounds and the inverted file of vectors against full scoring."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanline.operators import retrieve, shortlist, vector_index


@pytest.fixture(scope="module")
def corpus(spark):
    rng, numbers = random.Random(4), np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = []
    for i in range(600):
        body = " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))
        rows.append((i, body, None if i % 97 == 5 else numbers.normal(size=8).tolist(), i % 7 == 0))
    rows += [(1000 + k, rows[3][1], rows[3][2], False) for k in range(5)] + [(2000, None, [0.0] * 8, True), (2001, "w1 w2 w3", [1.0] * 8, None)]
    docs = spark.createDataFrame(rows, "id long, body string, vector array<float>, metered boolean").repartition(4).cache()
    owners = spark.createDataFrame([(p, numbers.normal(size=8).tolist()) for p in range(9)], "profile_id long, profile_vector array<float>")
    listed = [(p, t, float(rng.choice([1.0, 0.6]))) for p in range(9) for t in {*rng.sample(words, 12), "w0", "w1 w0", "w5"}]
    return docs, owners, spark.createDataFrame(listed, "profile_id long, term string, weight double").cache()


def plain(rows, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows.select(*columns).collect())


@pytest.mark.parametrize("top", [1, 10])
def test_top_keyword_equals_full_scoring(corpus, top):
    docs, _, terms = corpus
    full = {}
    for r in retrieve.bm25(docs, terms).collect():
        full.setdefault(r.profile_id, []).append((-round(r.keyword, 6), r.id))
    expected = sorted((p, i, -s) for p, rows in full.items() for s, i in sorted(rows)[:top])
    assert plain(shortlist.top_keyword(docs, terms, top), "profile_id", "id", "keyword") == expected


def test_few_documents_are_scored(corpus):
    """Of all documents that share a term with a profile, most are never joined with its terms."""
    docs, _, terms = corpus
    lists, weighted, _ = shortlist.impacts(docs, terms)
    share = lists.join(weighted, "gram").select("profile_id", "id").distinct().count()
    assert shortlist.candidates(lists, weighted, 3).count() < share / 5


@pytest.mark.parametrize("holes", [True, False])
def test_finalists_equal_full_scoring(corpus, holes):
    """Also where every document holds a term, so that the lowest keyword score is not zero."""
    docs, owners, terms = corpus
    if not holes:
        docs = docs.withColumn("body", F.concat(F.lit("w0 "), F.coalesce("body", F.lit(""))))
    with_vector = docs.where("vector IS NOT NULL")
    pairs = with_vector.select("id", "vector").join(owners.select("profile_id"))
    full = retrieve.rank(pairs.select("profile_id", "id", "vector"), owners, retrieve.bm25(with_vector, terms))
    metered = docs.where("metered").select("id")
    got, scored = shortlist.ranked_by_bound(docs, owners, terms, 8)
    columns = ("profile_id", "id", "chosen_by", "semantic", "keyword", "hybrid")
    assert plain(retrieve.finalists(got, metered, 8, 2), *columns) == plain(retrieve.finalists(full, metered, 8, 2), *columns)
    assert scored.count() < pairs.count() * 2 / 3


def test_profiles_in_blocks(corpus, monkeypatch):
    docs, owners, terms = corpus
    whole, _ = shortlist.ranked_by_bound(docs, owners, terms, 4)
    monkeypatch.setattr(shortlist, "PROFILE_BLOCK", 2)
    parts, _ = shortlist.ranked_by_bound(docs, owners, terms, 4)
    none = docs.where("false").select("id")
    assert plain(retrieve.finalists(parts, none, 4, 0), "profile_id", "id") == plain(retrieve.finalists(whole, none, 4, 0), "profile_id", "id")


def test_fewer_documents_than_places(spark, corpus):
    docs, owners, terms = corpus
    few = docs.where("id < 3")
    got, _ = shortlist.ranked_by_bound(few, owners, terms, 8)
    assert got.count() == 3 * 9
    assert shortlist.top_keyword(docs.where("false"), terms, 5).count() == 0
    assert shortlist.ranked_by_bound(docs, owners.where("false"), terms, 8)[0].count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16)) * 2
    rows = [(i, (centres[rng.integers(30)] + rng.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(5000 + i, [1.0] * 16) for i in range(1500)] + [(9001, [0.0] * 16), (9002, None)]
    return spark.createDataFrame(rows, "id long, vector array<float>").repartition(4).cache()


def brute(vectors, k):
    rows = [(r.id, np.array(r.vector)) for r in vectors.collect() if r.vector is not None]
    ids, values = np.array([i for i, _ in rows]), vector_index.unit(np.array([v for _, v in rows]))
    out = {}
    for i, v in zip(ids, values, strict=True):
        if i % 50 == 0:
            score = np.round(values @ v, 9)
            score[ids == i] = -9
            out[int(i)] = {int(x) for x in ids[np.lexsort((ids, -score))[:k]]}
    return out


def test_exact_equals_brute_force(vectors):
    got = {}
    for r in vector_index.exact(vectors, vectors.where("id % 50 = 0 AND id < 4000"), 5).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert got == {q: n for q, n in brute(vectors, 5).items() if q < 4000}


def test_inverted_file_reaches_its_recall(vectors, monkeypatch):
    """A list of 1500 equal vectors is cut into parts on both sides."""
    monkeypatch.setattr(vector_index, "GROUP_ROWS", 100)
    monkeypatch.setattr(vector_index, "GROUP_QUERIES", 10)
    index = vector_index.fit(vectors)
    assert index.probes < len(index.centroids) / 2
    queries = vectors.where("id % 50 = 0")
    found = vector_index.search(vector_index.assign(vectors, index), queries, index).cache()
    assert found.groupBy("query_id").count().where("count <> 10").count() == 0
    row = vector_index.recall(found.where("query_id < 4000"), vector_index.exact(vectors, queries.where("id < 4000"))).first()
    assert row.recall >= 0.9 and row.neighbours == row.queries * 10
    twins = found.where("query_id = 5000").collect()
    assert sorted(r.id for r in twins) == list(range(5001, 5011))


def test_empty_index(spark, vectors):
    none = vectors.where("false")
    index = vector_index.fit(none)
    assert vector_index.search(vector_index.assign(none, index), none, index).count() == 0
    assert vector_index.exact(vectors, none).count() == 0


def test_postings_of_a_document_lie_together(corpus):
    """Its terms are added up where it was read; only sums are shuffled."""
    docs, _, terms = corpus
    postings = retrieve.posting_lists(docs, retrieve.query_terms(terms))
    places = postings.select("id", F.spark_partition_id().alias("part")).distinct().groupBy("id").count()
    assert places.where("count > 1").count() == 0


def test_postings_equal_counting_by_hand(spark, monkeypatch):
    """Also of texts cut into several parts, of terms whose hash other grams have, and without text."""
    monkeypatch.setattr(retrieve, "COUNTED_TOKENS", 5)
    monkeypatch.setattr(retrieve, "GRAM_BUCKETS", 8)
    texts = ["a b c a b c", "c++ a, b; a b", "", None, "x", "b c a b c a b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string").coalesce(1)
    terms = spark.createDataFrame([(0, t, 1.0) for t in ("a", "A B", "b c a", "c++ a", "zz")], "profile_id long, term string, weight double")
    got = {(r.id, r.gram): (r.length, r.tf) for r in retrieve.posting_lists(docs, retrieve.query_terms(terms)).collect()}
    expected = {}
    for i, text in enumerate(texts):
        words = None if text is None else text.replace(",", "").replace(";", "").split()
        expected[i, ""] = (None if words is None else len(words), 1)
        for gram in ("a", "a b", "b c a", "c++ a", "zz"):
            n = gram.count(" ") + 1
            tf = sum(words[k : k + n] == gram.split() for k in range(len(words))) if words else 0
            if tf:
                expected[i, gram] = (len(words), tf)
    assert got == expected
