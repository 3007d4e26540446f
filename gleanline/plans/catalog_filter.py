"""Queries over the hard filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, rules
from ..functions import fixed_values as fv
from ..operators import filters
from ..session import evaluate_once
from . import twin
from .canonical import canonical, duck_canonical
from .registry import Tables, query
from .views import view

c = F.col
_LATE = "TIMESTAMP '1999-02-20 12:00:00'"
ASOF = "2024-02-20 12:00:00"
CRITERIA = filters.MatchCriteria(
    countries=("IT", "DE", "ES", "CH"),
    seniority="mid",
    languages=("en", "de", "es"),
    authorized_countries=("IT", "DE", "ES"),
    home_city="Milano",
    excluded_contract_types=("internship",),
    excluded_work_modes=("on_site",),
    blocked_companies=("Company 5 Holding", "company 11"),
    max_age_days=45,
    min_salary_eur_year=40000,
)


def asof():
    return F.lit(ASOF).cast("timestamp")


def judged(t: Tables):
    return evaluate_once(canonical(t).withColumn("rejected", filters.rejection(CRITERIA.columns(), asof())))


_RANK = {k: v for k, v in fv.SENIORITY_RANK.items()}
_TESTS = {
    "azienda": f"company_normalized IN ({twin.company(twin.quote('Company 5 Holding'))}, {twin.company(twin.quote('company 11'))})",
    "lingua": "lang <> '' AND lower(lang) NOT IN ('en', 'de', 'es')",
    "livello": f"seniority <> 'unknown' AND abs({twin.case_map(_RANK, 'seniority')} - 2) > 1",
    "paese": "country IS NOT NULL AND country NOT IN ('IT', 'DE', 'ES', 'CH') AND work_mode <> 'remote'",
    "sponsorship": "country IS NOT NULL AND country NOT IN ('IT', 'DE', 'ES')",
    "città": f"work_mode <> 'remote' AND city IS NOT NULL AND {twin.key('city')} <> 'milano'",
    "contratto": "contract_type = 'internship'",
    "modalità": "work_mode = 'on_site'",
    "età": f"{twin.elapsed_days('posted_at', f'TIMESTAMP {twin.quote(ASOF)}')} > 45",
    "retribuzione": "salary_is_stated AND salary_eur_year_max <> 0 AND salary_eur_year_max < 40000",
}
_DETAILS = {
    "azienda": "company || ' è in blocklist'",
    "lingua": "'annuncio in ' || lang || ', lingue dichiarate: nessuna corrispondenza'",
    "livello": "seniority || ' contro mid (+/-1)'",
    "paese": "country || ' è fuori dai mercati scelti'",
    "sponsorship": "'servirebbe autorizzazione al lavoro in ' || country",
    "città": "city || ' non è Milano e l''annuncio non è remoto'",
    "contratto": "contract_type",
    "modalità": "work_mode",
    "età": f"'pubblicato ' || {twin.elapsed_days('posted_at', f'TIMESTAMP {twin.quote(ASOF)}')} || ' giorni fa'",
    "retribuzione": "'fino a ' || salary_eur_year_max || ' EUR/anno dichiarati'",
}


def duck_judged() -> str:
    kind = "CASE " + " ".join(f"WHEN {t} THEN '{k}'" for k, t in _TESTS.items()) + " END"
    reason = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{k}: ' || {d}" for k, d in _DETAILS.items()) + " END"
    return (
        f"{duck_canonical()}, judged AS MATERIALIZED (SELECT *, {reason} AS reason "
        f"FROM (SELECT *, {kind} AS kind FROM canon))"
    )


@query(
    "f01_candidates",
    f"WITH {duck_canonical()} SELECT id, status, {twin.iso('posted_at')} AS posted_at FROM canon "
    "WHERE is_active AND status NOT IN ('hidden', 'applied') AND reached_stage < 2",
)
def candidates(t: Tables):
    rows = canonical(t)
    matches = rows.select(c("id").alias("job_id"), "status", "reached_stage")
    out = filters.candidates(rows.drop("reached_stage"), matches)
    return out.select("id", "status", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"))


@query("f02_first_reason", f"WITH {duck_judged()} SELECT id, kind, reason FROM judged")
def first_reason(t: Tables):
    return judged(t).select("id", c("rejected.kind").alias("kind"), filters.reason_text(c("rejected")).alias("reason"))


def _single(criteria: filters.MatchCriteria):
    """A query of one filter alone: the same reason column with every other filter off."""

    def build(t: Tables):
        reason = filters.rejection(criteria.columns(), asof())
        return canonical(t).select("id", reason["kind"].alias("kind"))

    return build


def _alone(*kinds: str) -> str:
    arms = " ".join(f"WHEN {_TESTS[k]} THEN '{k}'" for k in kinds)
    return f"WITH {duck_canonical()} SELECT id, CASE {arms} END AS kind FROM canon"


_OFF = {"max_age_days": 0, "restrict_to_home_city": False}
for _name, _kinds, _criteria in [
    ("f03_blocked_company", ["azienda"], dict(blocked_companies=CRITERIA.blocked_companies)),
    ("f04_language", ["lingua"], dict(languages=CRITERIA.languages)),
    ("f05_seniority", ["livello"], dict(seniority="mid")),
    ("f06_market", ["paese", "sponsorship"], dict(countries=CRITERIA.countries, authorized_countries=CRITERIA.authorized_countries)),
    ("f07_home_city", ["città"], dict(home_city="Milano", restrict_to_home_city=True)),
    ("f08_contract_and_mode", ["contratto", "modalità"], dict(excluded_contract_types=("internship",), excluded_work_modes=("on_site",))),
    ("f10_minimum_salary", ["retribuzione"], dict(min_salary_eur_year=40000)),
]:
    query(_name, _alone(*_kinds))(_single(filters.MatchCriteria(**{**_OFF, **_criteria})))


@query(
    "f09_age_in_days",
    f"SELECT o_orderkey, {twin.elapsed_days('o_orderdate', _LATE)} AS days, "
    f"{twin.elapsed_days('o_orderdate', _LATE)} > 45 AS too_old FROM orders",
)
def age_in_days(t: Tables):
    days = dates.elapsed_days(c("o_orderdate"), F.lit("1999-02-20 12:00:00").cast("timestamp"))
    return t.orders.select("o_orderkey", days.alias("days"), (days > 45).alias("too_old"))


@query(
    "f11_rejection_counts",
    f"WITH {duck_judged()} SELECT kind, count(*) AS postings FROM judged GROUP BY 1",
)
def rejection_counts(t: Tables):
    return filters.rejection_counts(judged(t))


# One JSON document of each kind per customer: settings with wrong types, answers, profile.
_DOCS = """
SELECT c_custkey AS profile_id,
  CASE c_custkey % 4 WHEN 0 THEN NULL
    WHEN 1 THEN '{"languages":["EN","it"],"seniority":"senior","max_age_days":true,"home_city":"  "}'
    WHEN 2 THEN '{"countries":["it","de",""],"seniority":"boss","seniority_tolerance":2,"excluded_work_modes":["on_site","moon"],"blocked_companies":["Acme S.r.l."],"max_age_days":30}'
    ELSE '{"authorized_countries":["ch"],"restrict_to_home_city":false,"min_salary_eur_year":30000,"home_city":"Roma"}' END AS settings,
  CASE c_custkey % 3 WHEN 0 THEN NULL
    WHEN 1 THEN '{"languages":{"fr":"B2"},"work_authorization":{"it":"citizen","us":"requires_sponsorship"},"city":"Torino"}'
    ELSE '{"languages":{},"work_authorization":{},"city":""}' END AS answers,
  CASE WHEN c_custkey % 5 > 0 THEN '{"language_codes":["DE"],"city":"Milano"}' END AS profile,
  c_nationkey * 5 AS months
FROM {customer}
"""


@query(
    "f12_resolve_criteria",
    f"""SELECT profile_id, countries, seniority, tolerance, languages, authorized, home_city, max_age_days, modes, blocked,
      array_to_string(list_filter([CASE WHEN languages = '' THEN 'languages' END, CASE WHEN authorized = '' THEN 'work authorization' END,
        CASE WHEN restrict_city AND home_city IS NULL THEN 'city' END], lambda x: x IS NOT NULL), ',') AS inactive
    FROM (SELECT profile_id, CASE WHEN k4 = 2 THEN 'IT,DE' ELSE '{','.join(fv.DEFAULT_MARKETS)}' END AS countries,
      CASE WHEN k4 = 1 THEN 'senior' ELSE CASE WHEN months >= 102 THEN 'lead' WHEN months >= 66 THEN 'senior' WHEN months >= 30 THEN 'mid' WHEN months >= 1 THEN 'junior' ELSE 'intern' END END AS seniority,
      CASE WHEN k4 = 2 THEN 2 ELSE 1 END AS tolerance,
      CASE WHEN k4 = 1 THEN 'en,it' WHEN k3 = 1 THEN 'fr' WHEN k5 > 0 THEN 'de' ELSE '' END AS languages,
      CASE WHEN k4 = 3 THEN 'CH' WHEN k3 = 1 THEN 'IT' ELSE '' END AS authorized,
      CASE WHEN k4 = 3 THEN 'Roma' WHEN k3 = 1 THEN 'Torino' WHEN k5 > 0 THEN 'Milano' END AS home_city,
      CASE WHEN k4 = 2 THEN 30 ELSE 45 END AS max_age_days, CASE WHEN k4 = 2 THEN 'on_site' ELSE '' END AS modes,
      CASE WHEN k4 = 2 THEN 'acme' ELSE '' END AS blocked, k4 <> 3 AS restrict_city
    FROM (SELECT c_custkey AS profile_id, c_custkey % 4 AS k4, c_custkey % 3 AS k3, c_custkey % 5 AS k5, c_nationkey * 5 AS months FROM customer))""",
)
def resolve_criteria(t: Tables):
    docs = t.sql(_DOCS).select(
        "profile_id",
        F.from_json("settings", filters.SETTINGS_SCHEMA).alias("s"),
        F.from_json("answers", "languages map<string,string>, work_authorization map<string,string>, city string").alias("a"),
        F.from_json("profile", "language_codes array<string>, city string").alias("p"),
        rules.seniority_from_months(c("months")).alias("level"),
    )
    out = docs.select("profile_id", filters.resolve_criteria(c("s"), c("a"), c("p"), c("level")).alias("k"))
    return out.select(
        "profile_id",
        F.array_join("k.countries", ",").alias("countries"), "k.seniority", c("k.seniority_tolerance").alias("tolerance"),
        F.array_join("k.languages", ",").alias("languages"), F.array_join("k.authorized_countries", ",").alias("authorized"),
        "k.home_city", "k.max_age_days", F.array_join("k.excluded_work_modes", ",").alias("modes"),
        F.array_join("k.blocked_companies", ",").alias("blocked"), F.array_join(filters.inactive_filters(c("k")), ",").alias("inactive"),
    )


_LIMIT = 1998 * 12 + 6
_INTERVALS = """
SELECT o_custkey AS profile_id, year(o_orderdate) * 12 + month(o_orderdate) AS start,
  CASE WHEN o_orderkey % 11 > 0 THEN year(o_orderdate) * 12 + month(o_orderdate) + o_orderkey % 14 - 1 END AS end_month
FROM {orders}
"""
_MONTHS = f"""iv AS (SELECT profile_id, start, least(coalesce(end_month, {_LIMIT}), {_LIMIT}) AS fin FROM ({_INTERVALS.replace('{orders}', 'orders')})
    WHERE coalesce(end_month, {_LIMIT}) >= start AND start <= {_LIMIT}),
  mk AS (SELECT *, CASE WHEN start > 1 + max(fin) OVER (PARTITION BY profile_id ORDER BY start, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM iv),
  isl AS (SELECT *, sum(opens) OVER (PARTITION BY profile_id ORDER BY start, fin ROWS UNBOUNDED PRECEDING) AS island FROM mk),
  exp AS (SELECT profile_id, CAST(sum(e - s + 1) AS BIGINT) AS months FROM (SELECT profile_id, island, min(start) AS s, max(fin) AS e FROM isl GROUP BY 1, 2) GROUP BY 1)"""


def experience(t: Tables):
    intervals = t.sql(_INTERVALS).withColumnRenamed("end_month", "end")
    return filters.experience_months(intervals, F.lit(_LIMIT))


@query("f13_experience_months", f"WITH {_MONTHS} SELECT profile_id, months FROM exp")
def experience_months(t: Tables):
    return experience(t)


@query(
    "f14_derived_seniority",
    f"""WITH {_MONTHS} SELECT profile_id, CASE WHEN months >= 102 THEN 'lead' WHEN months >= 66 THEN 'senior'
      WHEN months >= 30 THEN 'mid' WHEN months >= 1 THEN 'junior' ELSE 'intern' END AS seniority FROM exp""",
)
def derived_seniority(t: Tables):
    return experience(t).select("profile_id", rules.seniority_from_months(c("months")).alias("seniority"))
