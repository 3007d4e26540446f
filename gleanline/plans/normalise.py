"""The normalisation job: one projection from raw postings to canonical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import language, rules, salary, text
from ..operators.resolve import simhash


def normalise(raw: DataFrame) -> DataFrame:
    """All field normalisations in a single select; no shuffle, no Python.

    The fingerprint needs one aggregation over word shingles and is added by `with_fingerprint`.
    """
    clean = text.html_to_text(F.col("description"))
    tidy = raw.withColumns(
        {
            "description_clean": clean,
            "title": text.tidy_title(F.col("title")),
            "place": rules.split_location(F.col("location"), F.col("country")),
            "raw_title": F.col("title"),
            "raw_country": F.col("country"),
        }
    )
    structured = salary.from_structured(
        F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"), F.col("salary_period")
    )
    passed_on = [
        "source", "external_id", "url", "apply_url", "ats_type", "ats_board_token", "ats_job_id",
        "posted_at", "publisher",
    ]
    keep = ["id"] if "id" in raw.columns else []
    return tidy.select(
        *keep,
        *passed_on,
        "title",
        text.strip(F.col("company")).alias("company"),
        text.company_key(F.col("company")).alias("company_normalized"),
        text.employer_block(F.col("company")).alias("employer"),
        text.canonical_key(F.col("company"), F.col("title"), F.col("place.city")).alias("canonical_key"),
        text.content_hash(F.concat_ws("\n", "title", "description_clean")).alias("content_hash"),
        F.col("location").alias("location_raw"),
        "place.city",
        "place.region",
        "place.country",
        rules.work_mode(
            F.col("raw_title"), F.col("location"), F.col("is_remote"), F.col("description_clean")
        ).alias("work_mode"),
        salary.choose(structured, F.col("salary_text"), F.col("raw_country")).alias("salary"),
        rules.contract_type(
            F.col("contract_hint"), F.col("raw_title"), F.col("description_clean")
        ).alias("contract_type"),
        rules.seniority(F.col("seniority_hint"), F.col("raw_title")).alias("seniority"),
        rules.job_family(F.col("title")).alias("job_family"),
        F.col("description").alias("description_raw"),
        "description_clean",
        language.detect(
            F.coalesce(text.empty_to_null(F.col("description_clean")), F.col("title"))
        ).alias("lang"),
    )


def with_fingerprint(postings: DataFrame, id_column: str = "id") -> DataFrame:
    """Add the similarity fingerprint of the text, or of the title where there is no text."""
    body = F.coalesce(text.empty_to_null(F.col("description_clean")), F.col("title"))
    prints = simhash(postings.select(id_column, body.alias("body")), id_column, "body")
    return postings.join(prints, id_column, "left")
