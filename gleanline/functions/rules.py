"""Ordered rule tables turned into CASE expressions: categories and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import comparison_key, lookup, strip


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive search with Unicode word boundaries; NULL text never matches."""
    return F.coalesce(text.rlike(f"(?iU){pattern}"), F.lit(False))


def first_match(rules: list[tuple[str, str]], text: Column) -> Column:
    """Label of the first rule that hits, NULL when none does."""
    chain = F.when(matches(text, rules[0][1]), rules[0][0])
    for label, pattern in rules[1:]:
        chain = chain.when(matches(text, pattern), label)
    return chain


def opening_of(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def work_mode(
    title: Column, location: Column, is_remote: Column, description: Column, chars: int | None = None
) -> Column:
    """Title and place, then the feed's flag, then the text; `chars` (e.g. WORK_MODE_CHARS) reads its opening alone."""
    headline = F.concat_ws("\n", title, location)
    opening = opening_of(description, chars)
    hybrid_text = matches(opening, fv.HYBRID_PATTERN)
    return (
        F.when(matches(headline, fv.HYBRID_PATTERN), "hybrid")
        .when(is_remote & hybrid_text, "hybrid")
        .when(is_remote, "remote")
        .when(matches(headline, fv.REMOTE_PATTERN), "remote")
        .when(matches(headline, fv.ONSITE_PATTERN), "on_site")
        .when(~is_remote, "on_site")
        .when(hybrid_text, "hybrid")
        .when(matches(opening, fv.REMOTE_PATTERN), "remote")
        .otherwise("unknown")
    )


def contract_type(hint: Column, title: Column, description: Column, chars: int | None = None) -> Column:
    """Hint and title first, the text only when they are silent; `chars` (e.g. CONTRACT_CHARS) reads its opening alone."""
    stated = F.concat_ws(" ", F.when(hint != "", hint), title)
    return F.coalesce(
        first_match(fv.CONTRACT_RULES, stated),
        first_match(fv.CONTRACT_RULES, opening_of(description, chars)),
        F.lit("unknown"),
    )


def seniority(hint: Column, title: Column) -> Column:
    return F.coalesce(
        first_match(fv.SENIORITY_RULES, hint),
        first_match(fv.SENIORITY_RULES, title),
        F.lit("unknown"),
    )


def job_family(title: Column) -> Column:
    return first_match(fv.FAMILY_RULES, title)


def seniority_rank(level: Column) -> Column:
    return lookup(fv.SENIORITY_RANK, level)


def split_location(raw: Column, declared: Column) -> Column:
    """Struct of city, region and country code; a declared country wins over the text."""
    stated = F.when(declared != "", F.substring(F.upper(declared), 1, 2))
    parts = F.filter(
        F.transform(F.split(raw, r"(?U)[,/]|\s+[-–]\s+"), strip), lambda p: p != ""
    )
    count = F.coalesce(F.size(parts), F.lit(0))
    named = F.when(count > 0, lookup(fv.COUNTRY_NAMES, comparison_key(F.try_element_at(parts, F.lit(-1)))))
    places = F.when(named.isNotNull(), F.slice(parts, F.lit(1), F.greatest(count - 1, F.lit(0)))).otherwise(
        parts
    )
    city = F.get(places, F.lit(0))
    return F.struct(
        F.when(~comparison_key(city).isin(fv.NON_PLACES), city).alias("city"),
        F.get(places, F.lit(1)).alias("region"),
        F.coalesce(stated, named).alias("country"),
    )


def direct_application_tier(apply_url: Column, ats_type: Column) -> Column:
    """Who can open the form: known platform, generic form, or only a link."""
    return (
        F.when(F.coalesce(apply_url, F.lit("")) == "", "c_manual")
        .when(ats_type.isin(fv.DIRECT_ATS), "a_auto")
        .otherwise("b_assisted")
    )


def seniority_from_months(months: Column) -> Column:
    chain = F.when(months >= fv.SENIORITY_MONTHS[-1][0], fv.SENIORITY_MONTHS[-1][1])
    for floor, level in reversed(fv.SENIORITY_MONTHS[:-1]):
        chain = chain.when(months >= floor, level)
    return chain
