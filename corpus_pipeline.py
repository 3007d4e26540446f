"""From raw documents to packed training windows: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm import language_id, line_dedup, near_dedup, packing, secret_scan
from gleanline.llm.shared import store


def _resized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with `n_chars` telling the size of the text as it is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without text, go; `lang` becomes the predicted language.

    The model learns from the labelled languages of the same documents. Where none has a label, `lang` stays as it is.
    Texts in none of the learned languages stay with the nearest one: the score does not tell them apart (see README).
    """
    model = language_id.learn(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")))
    if not model.classes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, model).where(F.col("lang_pred") != language_id.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; a document goes when no line with a word is left of it.

    Private keys are hidden before: a header that repeats another document's would go and leave the key's body unmarked.
    """
    cleaned = line_dedup.dedup_lines(secret_scan.masked(docs, (secret_scan.KEY,)))
    return _resized(cleaned.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the first document stays."""
    groups = near_dedup.near_groups(docs, width=5, percent=80)
    gone = store(groups.where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct())
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti").select(docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind; every document stays."""
    return _resized(secret_scan.masked(docs), docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its window and its place there."""
    return packing.pack(docs)


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", hide_secrets),
    ("packing", pack_windows),
]

#: Learned models and tokenizers cannot be said in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
