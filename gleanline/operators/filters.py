"""Explainable hard filters: one reason column, one scan, both outcomes."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, rules
from ..functions import fixed_values as fv
from ..functions.text import comparison_key, company_key, strip


@dataclass(frozen=True)
class MatchCriteria:
    """What makes a posting worth reading. Empty lists and None switch a filter off."""

    countries: tuple[str, ...] = ()
    remote_ignores_country: bool = True
    seniority: str = "unknown"
    seniority_tolerance: int = 1
    languages: tuple[str, ...] = ()
    authorized_countries: tuple[str, ...] = ()
    home_city: str | None = None
    restrict_to_home_city: bool = True
    excluded_contract_types: tuple[str, ...] = ()
    excluded_work_modes: tuple[str, ...] = ()
    blocked_companies: tuple[str, ...] = ()
    max_age_days: int = 45
    min_salary_eur_year: int | None = None
    stage2_top_n: int = 100
    stage2_reserved_floor: int = 10

    def columns(self) -> dict[str, Column]:
        """Literals for one profile; a job over many profiles passes joined columns instead."""
        out = {}
        for field in fields(self):
            value = getattr(self, field.name)
            if isinstance(value, tuple):
                out[field.name] = F.array(*[F.lit(v) for v in value]).cast("array<string>")
            elif value is None:
                out[field.name] = F.lit(None).cast("string" if field.name == "home_city" else "int")
            else:
                out[field.name] = F.lit(value)
        return out


def profile_columns(alias: str = "criteria") -> dict[str, Column]:
    """Criteria read from a joined struct column, one row per profile and posting."""
    return {field.name: F.col(f"{alias}.{field.name}") for field in fields(MatchCriteria)}


def candidates(
    postings: DataFrame, matches: DataFrame, rescore: bool = False, limit: int | None = None
) -> DataFrame:
    """Active postings without a decision and, unless rescoring, without a score; with a limit the newest."""
    settled = F.col("status").isin(fv.DECIDED_STATUSES)
    if not rescore:
        settled = settled | (F.col("reached_stage") >= 2)
    done = matches.where(settled).select("job_id")
    rows = postings.where("is_active").join(done, postings["id"] == done["job_id"], "left_anti")
    if limit is None:
        return rows
    return rows.orderBy(F.col("posted_at").desc_nulls_last(), F.col("first_seen_at").desc(), "id").limit(limit)


#: Profiles whose criteria meet the postings in one pass, about.
PROFILE_BLOCK = 256
_JUDGED_BY = (
    "id", "company", "lang", "seniority", "country", "city", "work_mode", "contract_type", "posted_at", "salary_is_stated", "salary_eur_year_max",
)


def judge_profiles(postings: DataFrame, matches: DataFrame, criteria: DataFrame, now: Column) -> DataFrame:
    """(profile_id, id, rejected) of every active posting that a profile has not decided on or scored.

    Input: postings with what `rejection` reads, or `salary` as a struct; matches(profile_id, job_id, status,
    reached_stage); criteria(profile_id and the fields of MatchCriteria). Criteria come in blocks of about
    PROFILE_BLOCK profiles as constants of the plan, so that postings are read once a block and nothing is shuffled
    but the pairs that are settled.
    """
    if "salary" in postings.columns:
        postings = postings.withColumns({"salary_is_stated": F.col("salary.is_stated"), "salary_eur_year_max": F.col("salary.eur_year_max")})
    rows = postings.where("is_active").select(*_JUDGED_BY)
    settled = F.col("status").isin(fv.DECIDED_STATUSES) | (F.col("reached_stage") >= 2)
    done = matches.where(settled).select("profile_id", F.col("job_id").alias("id")).distinct()
    own = criteria.select("profile_id", *[f.name for f in fields(MatchCriteria)])
    kind = f"array<{own.schema.simpleString()}>"
    blocks = max(1, -(-own.count() // PROFILE_BLOCK))
    out = None
    for block in range(blocks):
        some = own.where(F.pmod(F.xxhash64("profile_id"), F.lit(blocks)) == block)
        texts = [r.j for r in some.select(F.to_json(F.struct(*own.columns)).alias("j")).collect()]  # about PROFILE_BLOCK
        if not texts:
            continue
        listed = F.from_json(F.lit("[" + ",".join(texts) + "]"), kind)
        asked = rows.withColumn("criteria", F.explode(listed)).withColumn("profile_id", F.col("criteria.profile_id"))
        judged = asked.join(done, ["profile_id", "id"], "left_anti").select("profile_id", "id", rejection(profile_columns(), now).alias("rejected"))
        out = judged if out is None else out.unionByName(judged)
    if out is None:
        return rows.where("false").select(F.lit(0).cast("long").alias("profile_id"), "id", F.lit(None).cast("struct<kind:string,detail:string>").alias("rejected"))
    return out


def in_list(value: Column, members: Column) -> Column:
    return F.coalesce(F.array_contains(members, value), F.lit(False))


def accepts_seniority(level: Column, own: Column, tolerance: Column) -> Column:
    """Within tolerance; an unknown level on either side passes."""
    distance = F.abs(rules.seniority_rank(level) - rules.seniority_rank(own))
    return (level == "unknown") | (own == "unknown") | (distance <= tolerance)


def rejection(c: dict[str, Column], now: Column) -> Column:
    """struct(kind, detail) of the first filter that rejects the posting, NULL when it passes.

    Reads company, lang, seniority, country, city, work_mode, contract_type, posted_at,
    salary_is_stated and salary_eur_year_max. A missing value never rejects.
    """
    col = F.col
    remote = col("work_mode") == "remote"
    country = F.nullif(F.upper("country"), F.lit(""))
    city = F.nullif(strip(col("city")), F.lit(""))
    age = dates.elapsed_days(col("posted_at"), now)
    listed = [
        (
            "azienda",
            in_list(company_key(col("company")), F.transform(c["blocked_companies"], company_key)),
            F.concat(col("company"), F.lit(" è in blocklist")),
        ),
        (
            "lingua",
            (F.size(c["languages"]) > 0) & (col("lang") != "") & ~in_list(F.lower("lang"), c["languages"]),
            F.concat(F.lit("annuncio in "), col("lang"), F.lit(", lingue dichiarate: nessuna corrispondenza")),
        ),
        (
            "livello",
            ~accepts_seniority(col("seniority"), c["seniority"], c["seniority_tolerance"]),
            F.concat(
                col("seniority"), F.lit(" contro "), c["seniority"], F.lit(" (+/-"),
                c["seniority_tolerance"].cast("string"), F.lit(")"),
            ),
        ),
        (
            "paese",
            country.isNotNull()
            & (F.size(c["countries"]) > 0)
            & ~in_list(country, c["countries"])
            & ~(remote & c["remote_ignores_country"]),
            F.concat(country, F.lit(" è fuori dai mercati scelti")),
        ),
        (
            "sponsorship",
            country.isNotNull() & (F.size(c["authorized_countries"]) > 0) & ~in_list(country, c["authorized_countries"]),
            F.concat(F.lit("servirebbe autorizzazione al lavoro in "), country),
        ),
        (
            "città",
            c["restrict_to_home_city"]
            & (c["home_city"] != "")
            & ~remote
            & (comparison_key(city) != comparison_key(c["home_city"]))
            & city.isNotNull(),
            F.concat(city, F.lit(" non è "), c["home_city"], F.lit(" e l'annuncio non è remoto")),
        ),
        ("contratto", in_list(col("contract_type"), c["excluded_contract_types"]), col("contract_type")),
        ("modalità", in_list(col("work_mode"), c["excluded_work_modes"]), col("work_mode")),
        (
            "età",
            (c["max_age_days"] != 0) & (age > c["max_age_days"]),
            F.concat(F.lit("pubblicato "), age.cast("string"), F.lit(" giorni fa")),
        ),
        (
            "retribuzione",
            (c["min_salary_eur_year"] != 0)
            & col("salary_is_stated")
            & (col("salary_eur_year_max") != 0)
            & (col("salary_eur_year_max") < c["min_salary_eur_year"]),
            F.concat(F.lit("fino a "), col("salary_eur_year_max").cast("string"), F.lit(" EUR/anno dichiarati")),
        ),
    ]
    reasons = [
        F.when(test, F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))) for kind, test, detail in listed
    ]
    return F.coalesce(*reasons)


def reason_text(rejected: Column, chars: int | None = None) -> Column:
    """"kind: detail", or its first `chars` (e.g. REASON_CHARS)."""
    reason = F.concat(rejected["kind"], F.lit(": "), rejected["detail"])
    return reason if chars is None else F.substring(reason, 1, chars)


def rejection_counts(judged: DataFrame) -> DataFrame:
    """Postings per rejection kind; passed ones under NULL."""
    return judged.groupBy(F.col("rejected.kind").alias("kind")).agg(F.count("*").alias("postings"))


# --- criteria from stored documents ------------------------------------------------------------

SETTINGS_SCHEMA = (
    "countries array<string>, remote_ignores_country boolean, seniority string, seniority_tolerance int, "
    "languages array<string>, authorized_countries array<string>, home_city string, "
    "restrict_to_home_city boolean, excluded_contract_types array<string>, excluded_work_modes array<string>, "
    "blocked_companies array<string>, max_age_days int, min_salary_eur_year int, stage2_top_n int, "
    "stage2_reserved_floor int"
)


def _filled(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def resolve_criteria(settings: Column, answers: Column, profile: Column, derived_level: Column) -> Column:
    """Criteria struct per profile row: saved setting, then answers, then profile, then default.

    `settings` has SETTINGS_SCHEMA; `answers` has languages map, work_authorization map and city;
    `profile` has language_codes array and city.
    """
    lower, upper = (lambda v: F.lower(v)), (lambda v: F.upper(v))
    none = F.array().cast("array<string>")
    languages = F.coalesce(
        F.transform(_filled(settings["languages"]), lower),
        _filled(F.map_keys(answers["languages"])),
        F.transform(_filled(profile["language_codes"]), lower),
        none,
    )
    allowed = F.filter(
        F.map_entries(answers["work_authorization"]), lambda e: e["value"].isin(fv.AUTHORISED_STATES)
    )
    authorized = F.coalesce(
        F.transform(_filled(settings["authorized_countries"]), upper),
        F.transform(allowed, lambda e: F.upper(e["key"])),
        none,
    )
    saved_level = F.when(settings["seniority"].isin(list(fv.SENIORITY_RANK)), settings["seniority"])
    city = F.coalesce(
        F.nullif(strip(settings["home_city"]), F.lit("")),
        F.nullif(answers["city"], F.lit("")),
        F.nullif(profile["city"], F.lit("")),
    )

    def members(values: Column, allowed_values: list[str]) -> Column:
        return F.coalesce(F.filter(values, lambda v: v.isin(allowed_values)), none)

    codes = F.filter(F.transform(settings["countries"], upper), lambda v: strip(v) != "")
    blocked = F.transform(settings["blocked_companies"], company_key)
    values = {
        "countries": F.coalesce(_filled(codes), F.array(*[F.lit(m) for m in fv.DEFAULT_MARKETS])),
        "remote_ignores_country": F.coalesce(settings["remote_ignores_country"], F.lit(True)),
        "seniority": F.coalesce(saved_level, derived_level, F.lit("unknown")),
        "seniority_tolerance": F.coalesce(settings["seniority_tolerance"], F.lit(1)),
        "languages": languages,
        "authorized_countries": authorized,
        "home_city": city,
        "restrict_to_home_city": F.coalesce(settings["restrict_to_home_city"], F.lit(True)),
        "excluded_contract_types": members(settings["excluded_contract_types"], fv.CONTRACT_TYPES),
        "excluded_work_modes": members(settings["excluded_work_modes"], fv.WORK_MODES),
        "blocked_companies": F.coalesce(blocked, none),
        "max_age_days": F.coalesce(settings["max_age_days"], F.lit(45)),
        "min_salary_eur_year": settings["min_salary_eur_year"],
        "stage2_top_n": F.coalesce(settings["stage2_top_n"], F.lit(100)),
        "stage2_reserved_floor": F.coalesce(settings["stage2_reserved_floor"], F.lit(10)),
    }
    return F.struct(*[v.alias(k) for k, v in values.items()])


def inactive_filters(criteria: Column) -> Column:
    """Names of the filters that cannot work for lack of data."""
    return F.array_compact(
        F.array(
            F.when(F.size(criteria["languages"]) == 0, "languages"),
            F.when(F.size(criteria["authorized_countries"]) == 0, "work authorization"),
            F.when(criteria["seniority"] == "unknown", "seniority"),
            F.when(criteria["restrict_to_home_city"] & criteria["home_city"].isNull(), "city"),
        )
    )


# --- experience --------------------------------------------------------------------------------


def experience_months(intervals: DataFrame, limit: Column) -> DataFrame:
    """(profile_id, months): months covered by the intervals, overlaps and touching months merged.

    Input: profile_id, start, end as month ordinals; an open end runs to `limit`, a later one is cut
    there and one that starts later does not count yet. Intervals that start in the same month are merged first, map-side, so that a profile is
    never longer than the number of distinct months, whatever its number of rows.
    """
    valid = intervals.select(
        "profile_id", "start", F.least(F.coalesce("end", limit), limit).alias("end"),
        F.coalesce("end", limit).alias("stated_end"),
    ).where((F.col("stated_end") >= F.col("start")) & (F.col("start") <= limit))
    starts = valid.groupBy("profile_id", "start").agg(F.max("end").alias("end"))
    ordered = Window.partitionBy("profile_id").orderBy("start")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = starts.withColumn("opens", (before.isNull() | (F.col("start") > before + 1)).cast("int"))
    islands = marked.withColumn("island", F.sum("opens").over(ordered))
    spans = islands.groupBy("profile_id", "island").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    return spans.groupBy("profile_id").agg(F.sum(F.col("e") - F.col("s") + 1).alias("months"))
