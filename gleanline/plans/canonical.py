"""The posting view in canonical form, for Spark and for DuckDB.

Both keep the stored language and the raw text, so that comparisons do not depend on detection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import rules, salary, text
from ..session import evaluate_once
from . import twin
from .catalog_text import duck_places, duck_salaries
from .registry import Tables
from .views import duck, view

COLUMNS = (
    "id source title company location_raw description lang n_chars quality toxic status score posted_at apply_url "
    "ats_type url publisher"
).split()


def canonical(t: Tables, columns: tuple[str, ...] | None = None, where: Column | None = None) -> DataFrame:
    """The canonical postings, or only some of their columns.

    Derived columns are computed once, behind a step that the optimizer does not look through. So a query names the
    `columns` it needs, and what can be asked of the posting itself comes as `where`: both reach the file scan.
    """
    c = F.col
    structured = salary.from_structured(c("salary_min"), c("salary_max"), c("salary_currency"), c("salary_period"))
    rows = view(t, "posting")
    rows = (rows if where is None else rows.where(where)).withColumns(
        {
            "place": rules.split_location(c("location"), c("country")),
            "pay": salary.choose(structured, c("salary_text"), c("country")),
            "location_raw": c("location"),
        }
    )
    canon = {
        **{n: c(n) for n in COLUMNS},
        "title": text.tidy_title(c("title")),
        "company_normalized": text.company_key(c("company")),
        **{n: c(f"place.{n}") for n in ("city", "region", "country")},
        "work_mode": rules.work_mode(c("title"), c("location"), c("is_remote"), c("description")),
        "contract_type": rules.contract_type(c("contract_hint"), c("title"), c("description")),
        "seniority": rules.seniority(c("seniority_hint"), c("title")),
        "job_family": rules.job_family(text.tidy_title(c("title"))),
        "salary_is_stated": c("pay.is_stated"),
        **{f"salary_{n}": c(f"pay.{n}") for n in ("min", "max", "currency", "period", "eur_year_max")},
        "is_active": c("id") % 10 != 9,
        "first_seen_at": F.coalesce("posted_at", F.lit("2024-02-01").cast("timestamp")),
        "reached_stage": F.when(c("quality").isNull(), 0).when(c("id") % 4 == 0, 2).otherwise(1),
    }
    return evaluate_once(rows.select(*[canon[n].alias(n) for n in columns or canon]))


def duck_canonical() -> str:
    """CTEs v_posting and canon."""
    raw_kept = ", ".join(f"p.{n}" for n in COLUMNS if n not in ("title", "location_raw"))
    return f"""v_posting AS MATERIALIZED ({duck('posting')}), canon AS MATERIALIZED (
      SELECT {raw_kept}, p.location AS location_raw, {twin.tidy_title('p.title')} AS title,
        {twin.company('p.company')} AS company_normalized, p.city, p.region, p.country,
        {twin.work_mode('p.title', 'p.location', 'p.is_remote', 'p.description')} AS work_mode,
        {twin.contract_type('p.contract_hint', 'p.title', 'p.description')} AS contract_type,
        {twin.seniority('p.seniority_hint', 'p.title')} AS seniority,
        {twin.first_match(fv.FAMILY_RULES, twin.tidy_title('p.title'))} AS job_family,
        s.salary_is_stated, s.amount_min AS salary_min, s.amount_max AS salary_max, s.currency AS salary_currency,
        s.period AS salary_period, s.eur_max AS salary_eur_year_max, p.id % 10 <> 9 AS is_active,
        coalesce(p.posted_at, TIMESTAMP '2024-02-01') AS first_seen_at,
        CASE WHEN p.quality IS NULL THEN 0 WHEN p.id % 4 = 0 THEN 2 ELSE 1 END AS reached_stage
      FROM {duck_places()} p JOIN (SELECT id, salary_is_stated, amount_min, amount_max, currency, period, eur_max FROM {duck_salaries()}) s USING (id))"""
