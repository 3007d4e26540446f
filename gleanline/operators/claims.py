"""Claim verification: every generated statement against the facts it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import numbers_in

VIOLATION = "doc_id bigint, rule string, place string, detail string"


def provenance(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Verdict per claim: NULL when its fact exists under its parent.

    claims(doc_id, parent_id, position, source_id, ...), facts(doc_id, parent_id, fact_id). A
    missing parent, a fact of another parent and a missing fact are told apart.
    """
    parents = facts.groupBy("doc_id", "parent_id").agg(F.lit(True).alias("has_parent"))
    exact = facts.select("doc_id", "parent_id", F.col("fact_id").alias("source_id")).distinct().withColumn("has_fact", F.lit(True))
    anywhere = facts.select("doc_id", F.col("fact_id").alias("source_id")).distinct().withColumn("elsewhere", F.lit(True))
    verdict = (
        F.when(F.col("has_parent").isNull(), "esperienza-inesistente")
        .when(F.col("has_fact"), F.lit(None))
        .when(F.col("elsewhere"), "bullet-di-un-altra-esperienza")
        .otherwise("bullet-inesistente")
    )
    return (
        claims.join(parents, ["doc_id", "parent_id"], "left")
        .join(exact, ["doc_id", "parent_id", "source_id"], "left")
        .join(anywhere, ["doc_id", "source_id"], "left")
        .withColumn("verdict", verdict)
        .drop("has_parent", "has_fact", "elsewhere")
    )


def fact_text(fact: dict[str, Column]) -> Column:
    """Everything a fact states: its text and its action, context and result."""
    return F.concat_ws(" ", *[F.nullif(fact[n], F.lit("")) for n in ("text", "action", "context", "result")])


def invented_numbers(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims with the numbers their own fact does not contain. Needs doc_id, source_id/fact_id, text."""
    sources = facts.select("doc_id", F.col("fact_id").alias("source_id"), numbers_in(F.col("text")).alias("known"))
    return claims.join(sources, ["doc_id", "source_id"]).withColumn(
        "invented", F.array_except(numbers_in(F.col("text")), F.col("known"))
    ).drop("known")


def unsupported_summary_numbers(summaries: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, value): numbers of a summary found nowhere in the facts of its document.

    An anti-join on values; the facts of a document are never brought together.
    """
    stated = summaries.select("doc_id", F.explode(numbers_in(F.col("text"))).alias("value")).distinct()
    known = facts.select("doc_id", F.explode(numbers_in(F.col("text"))).alias("value"))
    return stated.join(known, ["doc_id", "value"], "left_anti")


def skill_key(skill: Column) -> Column:
    """Letters, digits, + and #: c++ and c# stay different from c."""
    return F.regexp_replace(F.lower(skill), "[^a-z0-9+#]", "")


def undeclared_skills(claimed: DataFrame, known: DataFrame) -> DataFrame:
    """Claimed skills whose declared source is no known skill of the document."""
    keys = known.select("doc_id", skill_key(F.col("skill")).alias("key")).where("key <> ''")
    return claimed.withColumn("key", skill_key(F.coalesce("source", F.lit("")))).join(keys, ["doc_id", "key"], "left_anti").drop("key")


def unsupported_extras(extras: DataFrame, pool: DataFrame) -> DataFrame:
    """Extra statements with a rule each breaks: unknown id, or numbers its entry does not have."""
    entries = pool.select("doc_id", F.col("fact_id").alias("source_id"), numbers_in(F.col("text")).alias("known"))
    rule = F.when(F.col("known").isNull(), "informazione-inesistente").when(
        F.size(F.array_except(numbers_in(F.col("text")), F.col("known"))) > 0, "cifra-inventata"
    )
    return extras.join(entries, ["doc_id", "source_id"], "left").withColumn("rule", rule).where("rule IS NOT NULL").drop("known")


def violations(claims: DataFrame, facts: DataFrame, summaries: DataFrame, claimed: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, rule, place, detail): all broken rules as rows."""

    def place(column: str) -> Column:
        return F.concat(F.lit("experience["), F.col("parent_id"), F.lit("].bullet["), F.col(column).cast("string"), F.lit("]"))

    judged = provenance(claims, facts).where("verdict IS NOT NULL")
    missing_parent = F.col("verdict") == "esperienza-inesistente"
    unfounded = judged.select(
        "doc_id",
        F.col("verdict").alias("rule"),
        F.when(missing_parent, F.concat(F.lit("experience["), F.col("parent_id"), F.lit("]"))).otherwise(place("position")).alias("place"),
        F.when(missing_parent, F.col("parent_id")).otherwise(F.col("source_id")).alias("detail"),
    ).distinct()
    numeric = invented_numbers(claims, facts).where(F.size("invented") > 0).select(
        "doc_id", F.lit("cifra-inventata").alias("rule"), place("position").alias("place"), F.col("source_id").alias("detail")
    )
    summary = unsupported_summary_numbers(summaries, facts).groupBy("doc_id").agg(F.count("*").alias("n")).select(
        "doc_id", F.lit("cifra-inventata").alias("rule"), F.lit("summary").alias("place"), F.col("n").cast("string").alias("detail")
    )
    skills = undeclared_skills(claimed, known).select(
        "doc_id",
        F.lit("skill-non-dichiarata").alias("rule"),
        F.concat(F.lit("skills["), F.col("position").cast("string"), F.lit("]")).alias("place"),
        F.col("text").alias("detail"),
    )
    return unfounded.unionByName(numeric).unionByName(summary).unionByName(skills)


def verdicts(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, violations, passes): a document passes iff nothing was found."""
    counts = found.groupBy("doc_id").agg(F.count("*").alias("violations"))
    return documents.select("doc_id").distinct().join(counts, "doc_id", "left").select(
        "doc_id", F.coalesce("violations", F.lit(0)).alias("violations"), F.col("violations").isNull().alias("passes")
    )


def feedback_lines(found: DataFrame) -> DataFrame:
    """One correction line per violation, ready to be sent back to the generator."""
    return found.select("doc_id", F.concat_ws(" ", F.lit("-"), "place", F.lit("—"), "rule", "detail").alias("line"))


GENERATED_SCHEMA = (
    "summary string, top_keywords array<string>, "
    "experience array<struct<id:string,bullets:array<struct<text:string,source_id:string>>>>"
)


def side_by_side(pairs: DataFrame) -> DataFrame:
    """Generated bullets next to the originals they name; a vanished original is NULL.

    Input: doc_id, generated (GENERATED_SCHEMA), profile with experiences(id, company, role, bullets).
    Both documents are in one row, so originals are found without a join.
    """
    rows = pairs.select("doc_id", "profile", F.posexplode("generated.experience").alias("exp_pos", "exp"))
    rows = rows.select("doc_id", "profile", "exp_pos", F.col("exp.id").alias("exp_id"), F.posexplode("exp.bullets").alias("pos", "b"))
    experiences = F.col("profile.experiences")
    own = F.filter(experiences, lambda e: e["id"] == F.col("exp_id"))
    originals = F.filter(F.flatten(F.transform(experiences, lambda e: e["bullets"])), lambda b: b["id"] == F.col("b.source_id"))
    return rows.select(
        "doc_id",
        "exp_pos",
        "pos",
        F.coalesce(F.get(own, F.lit(0))["role"], F.col("exp_id")).alias("role"),
        F.coalesce(F.get(own, F.lit(0))["company"], F.lit("")).alias("company"),
        F.col("b.text").alias("text"),
        F.col("b.source_id").alias("source_id"),
        F.get(originals, F.lit(0))["text"].alias("original"),
    )
