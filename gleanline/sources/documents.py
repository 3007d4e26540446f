"""Nested JSON documents: candidate profile, application answers, settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROFILE_SCHEMA = (
    "contact struct<full_name:string,email:string,city:string>, headline string, "
    "experiences array<struct<id:string,company:string,role:string,start:string,end:string,"
    "bullets:array<struct<id:string,text:string>>>>, "
    "education array<struct<id:string>>, projects array<struct<id:string>>, certifications array<struct<id:string>>"
)
ANSWERS_SCHEMA = (
    "full_name string, email string, phone string, city string, country string, linkedin_url string, "
    "work_authorization map<string,string>, languages map<string,string>, notice_period_days int, "
    "salary_expectation_min int, salary_expectation_max int, salary_note string, salary_currency string"
)
_MONTH = r"^\d{4}-(0[1-9]|1[0-2])$"


def _ids(items: Column) -> Column:
    return F.coalesce(F.transform(items, lambda x: x["id"]), F.array().cast("array<string>"))


def profile_problems(profile: Column) -> Column:
    """What makes a profile unusable: repeated ids, months in another form, an end before its start."""
    experiences = profile["experiences"]
    bullets = F.flatten(F.transform(experiences, lambda e: e["bullets"]))
    ids = F.concat(_ids(experiences), _ids(bullets), _ids(profile["education"]), _ids(profile["projects"]), _ids(profile["certifications"]))
    repeated = F.array_sort(
        F.array_distinct(F.filter(ids, lambda x: F.size(F.filter(ids, lambda y: y == x)) > 1))
    )
    bad_month = F.exists(
        experiences, lambda e: ~e["start"].rlike(_MONTH) | ~F.coalesce(e["end"], F.lit("2000-01")).rlike(_MONTH)
    )
    reversed_ = F.exists(experiences, lambda e: F.coalesce(e["end"] < e["start"], F.lit(False)))
    return F.array_compact(
        F.array(
            F.when(profile["contact"]["full_name"].isNull(), "malformed"),
            F.when(F.size(repeated) > 0, F.concat(F.lit("repeated ids: "), F.array_join(repeated, ","))),
            F.when(bad_month, "month not in YYYY-MM"),
            F.when(reversed_, "end before start"),
        )
    )


def load_answers(answers: Column) -> Column:
    """Answers with country codes in capitals and language codes in small letters."""
    upper = F.map_from_entries(
        F.transform(F.map_entries(answers["work_authorization"]), lambda e: F.struct(F.upper(e["key"]), e["value"]))
    )
    lower = F.map_from_entries(
        F.transform(F.map_entries(answers["languages"]), lambda e: F.struct(F.lower(e["key"]), e["value"]))
    )
    return (
        answers.withField("work_authorization", upper)
        .withField("languages", lower)
        .withField("country", F.upper(answers["country"]))
        .withField("salary_currency", F.upper(F.coalesce(answers["salary_currency"], F.lit("EUR"))))
    )


def answer_problems(answers: Column) -> Column:
    """Answers that cannot be right."""
    low, high = answers["salary_expectation_min"], answers["salary_expectation_max"]
    codes = F.map_keys(answers["work_authorization"])
    return F.array_compact(
        F.array(
            F.when(F.exists(codes, lambda code: ~code.rlike("^[A-Za-z]{2}$")), "work_authorization"),
            F.when(F.exists(F.map_keys(answers["languages"]), lambda code: ~code.rlike("^[A-Za-z]{2,3}$")), "languages"),
            F.when(~answers["country"].rlike("^[A-Za-z]{2}$"), "country"),
            F.when(~answers["notice_period_days"].between(0, 365), "notice_period_days"),
            F.when(high < low, "salary range"),
        )
    )


def answer_gaps(answers: Column) -> Column:
    """What is still missing before an application can be sent."""

    def blank(name: str) -> Column:
        return F.coalesce(answers[name], F.lit("")) == ""

    def no_entries(name: str) -> Column:
        return F.coalesce(F.size(F.map_keys(answers[name])), F.lit(0)) == 0

    return F.array_compact(
        F.array(
            F.when(blank("phone"), "phone"),
            F.when(no_entries("work_authorization"), "work_authorization"),
            F.when(no_entries("languages"), "languages"),
            F.when(answers["salary_expectation_min"].isNull() & answers["salary_note"].isNull(), "salary expectation"),
            F.when(blank("linkedin_url"), "linkedin"),
            F.when(answers["notice_period_days"].isNull(), "notice period"),
        )
    )


# --- settings: hand-edited JSON read defensively --------------------------------------------------


def _kind(settings: Column, key: str) -> Column:
    """Type name of a JSON member, NULL when absent."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(settings), f"$.{key}", "variant"))


def whole_number(settings: Column, key: str, fallback: int) -> Column:
    """Integer member; booleans, text and fractions give the fallback."""
    value = F.try_variant_get(F.try_parse_json(settings), f"$.{key}", "bigint")
    return F.when(_kind(settings, key) == "BIGINT", value).otherwise(F.lit(fallback).cast("long"))


def clamped_number(settings: Column, key: str, fallback: int, low: int, high: int) -> Column:
    """Number or numeric text, truncated and kept inside its range; booleans count as 0 and 1."""
    raw = F.get_json_object(settings, f"$.{key}")
    kind = _kind(settings, key)
    number = (
        F.when(kind == "BOOLEAN", (raw == "true").cast("long"))
        .when(kind == "STRING", F.when(F.trim(raw).rlike(r"^[+-]?\d+$"), F.trim(raw).try_cast("bigint")))
        .otherwise(F.try_variant_get(F.try_parse_json(settings), f"$.{key}", "double").try_cast("bigint"))
    )
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(number, F.lit(fallback).cast("long"))))


def allowed_values(settings: Column, key: str, allowed: list[str]) -> Column:
    """Members of a list that the enumeration knows; anything but a list is empty."""
    values = F.from_json(F.get_json_object(settings, f"$.{key}"), "array<string>")
    none = F.array().cast("array<string>")
    return F.coalesce(F.filter(values, lambda v: v.isin(allowed)), none)
