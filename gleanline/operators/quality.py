"""Choosing the best of several text extractions of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import numeric_tokens, prose_quality, word_integrity


def measure(variants: DataFrame) -> DataFrame:
    """Replace the text of each variant by its measurements. Input: doc_id, method, position, text."""
    return variants.select(
        "doc_id",
        "method",
        "position",
        word_integrity(F.col("text")).alias("integrity"),
        numeric_tokens(F.col("text")).alias("numbers"),
        prose_quality(F.col("text")).alias("quality"),
    )


def pick_best(measured: DataFrame) -> DataFrame:
    """One row per document: readable variants by numbers kept, then prose; else the most intact.

    Earlier positions win ties. Only measurements take part, texts stay where they are.
    """
    readable = F.col("integrity") >= fv.MIN_WORD_INTEGRITY
    preference = F.struct(
        readable.cast("int").alias("readable"),
        F.when(readable, F.size("numbers").cast("double")).otherwise(F.col("integrity")).alias("first"),
        F.when(readable, F.col("quality")).otherwise(0.0).alias("second"),
        (-F.col("position")).alias("earlier"),
    )
    # The numbers of all variants are a set per document: bounded by its distinct numbers.
    return (
        measured.groupBy("doc_id")
        .agg(
            F.max_by(F.struct("method", "numbers", "integrity"), preference).alias("best"),
            F.array_distinct(F.flatten(F.collect_set("numbers"))).alias("all_numbers"),
        )
        .select(
            "doc_id",
            F.col("best.method").alias("method"),
            F.array_sort(F.array_except("all_numbers", "best.numbers")).alias("lost"),
        )
    )


def review_warnings(profile: Column) -> Column:
    """What a person should look at before the profile is used."""
    experiences = profile["experiences"]
    bullets = F.flatten(F.transform(experiences, lambda e: F.coalesce(e["bullets"], F.array().cast("array<struct<id:string,text:string,action:string,context:string,result:string,skills:array<string>>>"))))
    total = F.coalesce(F.size(bullets), F.lit(0))
    bare = F.coalesce(F.size(F.filter(bullets, lambda b: F.coalesce(b["result"], F.lit("")) == "")), F.lit(0))
    empty = F.filter(experiences, lambda e: F.coalesce(F.size(e["bullets"]), F.lit(0)) == 0)
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.size(experiences), F.lit(0)) == 0, "no experience"),
            F.when(F.coalesce(F.size(profile["skills"]["hard"]), F.lit(0)) == 0, "no technical skill"),
            F.when(F.coalesce(profile["email"], F.lit("")) == "", "no email"),
            F.when((total > 0) & (bare == total), "no measurable result").when(
                bare > total * 0.7,
                F.concat(bare.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" without result")),
            ),
            F.when(F.size(empty) > 0, F.concat(F.lit("empty: "), F.array_join(F.transform(empty, lambda e: e["id"]), ", "))),
        )
    )
