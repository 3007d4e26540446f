"""The corpus pipeline on a small folder: what each stage keeps, and that its parts fit."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from test_llm_operators import LOW, lines, shingles  # noqa: F401


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(9), []
    for i in range(40):
        lang = rng.choice(["en", "de", "fr"])
        rows.append((i, lines(rng, lang, 4), lang, "s", 0))
    rows.append((40, rows[0][1], "en", "s", 0))
    rows.append((41, rows[1][1] + " " + rows[1][1].replace("\n", " "), rows[1][2], "s", 0))
    rows.append((42, "the token = abcdef123 " + lines(rng, "en", 2), "en", "s", 0))
    rows += [(43, None, None, "s", 0), (44, "12 34 !", "en", None, 0), (45, rows[2][1].replace("\n", " "), "en", "s", 0)]
    rows.append((46, rows[45][1].replace(" ", "\n", 1), "en", "s", 0))
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "MinHash near-dedup", "secret scans", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language ID"](spark, docs, folder)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(docs) - ids(known) == {43, 44} and known.columns == docs.columns
    cleaned = stage["line dedup"](spark, known, folder)
    assert 40 not in ids(cleaned) and ids(cleaned) <= ids(known) and cleaned.columns == docs.columns
    assert cleaned.where("n_chars <> char_length(text)").count() == 0
    single = stage["MinHash near-dedup"](spark, known, folder)
    sets = {r.doc_id: shingles(r.text, 5) for r in known.collect()}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0}
    assert ids(known) - ids(single) == {b for _, b in near} and single.columns == docs.columns
    hidden = stage["secret scans"](spark, single, folder)
    assert ids(hidden) == ids(single) and hidden.where(F.col("text").contains("abcdef123")).count() == 0


def test_keys_do_not_outlive_their_header(spark, folder):
    rng = random.Random(4)
    bodies = ["\n".join("".join(rng.choices("abcdefXYZ0123456789+/", k=64)) for _ in range(5)) for _ in range(2)]
    key = "the text\n-----BEGIN RSA PRIVATE KEY-----\n{}\n-----END RSA PRIVATE KEY-----\nand more words {}"
    data = [(k, key.format(b, k), "en", "s", 0) for k, b in enumerate(bodies)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    left = stage["secret scans"](spark, stage["line dedup"](spark, docs, folder), folder)
    assert not any(line in r.text for r in left.collect() for b in bodies for line in b.split("\n"))


def test_unlabelled_documents_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    known = dict(corpus_pipeline.STAGES)["language ID"](spark, docs, folder)
    rows = known.select("doc_id", "lang").collect()
    assert sorted(r.doc_id for r in rows) == [k for k in range(47) if k not in (43, 44)] and {r.lang for r in rows} == {None}
    assert known.columns == docs.columns


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert set(out.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    assert out.groupBy("doc_id").agg(F.sum("length") == F.max("doc_tokens")).where("NOT `(sum(length) = max(doc_tokens))`").count() == 0
