"""Payload mappers: one select per feed from its JSON to the common raw posting.

Every mapper takes a column of JSON text called `payload` and, where the request decided something
the payload does not repeat, a column for it (`country`, `board`, `names`, `now`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import fixed_values as fv
from ..functions.text import lookup, strip, unescape
from .raw import company_name, guarded_id, raw_posting


def _text(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _positive(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number > 0, number)


def _open(df: DataFrame, schema: str) -> DataFrame:
    return df.withColumn("e", F.from_json("payload", schema))


def _complete(*names: str) -> Column:
    test = F.lit(True)
    for name in names:
        test = test & (F.coalesce(F.col(f"e.{name}"), F.lit("")) != "")
    return test


def _mapped(rows: DataFrame, source: str, fields: dict[str, Column]) -> DataFrame:
    fields = {**fields, "source": F.lit(source), "raw": F.col("payload")}
    fields["external_id"] = guarded_id(fields["external_id"])
    return rows.select(*raw_posting(fields))


def _e(path: str) -> Column:
    return F.col(f"e.{path}")


def adzuna(df: DataFrame) -> DataFrame:
    """Nested names; a predicted salary is no salary; currency follows the requested country."""
    rows = _open(
        df,
        "id string, title string, company struct<display_name:string>, location struct<display_name:string>, "
        "redirect_url string, description string, created string, salary_min string, salary_max string, "
        "salary_is_predicted string, contract_type string, contract_time string",
    ).where(_complete("id", "title"))
    stated = F.coalesce(_e("salary_is_predicted"), F.lit("0")) != "1"
    low, high = F.when(stated, _positive(_e("salary_min"))), F.when(stated, _positive(_e("salary_max")))
    paid = F.coalesce(low, high).isNotNull()
    return _mapped(rows, "adzuna", {
        "external_id": _e("id"),
        "title": _e("title"),
        "company": F.coalesce(_text(_e("company.display_name")), F.lit(fv.UNDECLARED_COMPANY)),
        "url": F.coalesce(_e("redirect_url"), F.lit("")),
        "description": F.coalesce(_e("description"), F.lit("")),
        "location": _text(_e("location.display_name")),
        "country": F.upper("country"),
        "posted_at": dates.parse_iso(_e("created")),
        "salary_min": low,
        "salary_max": high,
        "salary_currency": F.when(paid, lookup(fv.PREDICTED_FEED_CURRENCIES, F.lower("country"))),
        "salary_period": F.when(paid, "yearly"),
        "contract_hint": _text(F.trim(F.concat_ws(" ", _e("contract_type"), _e("contract_time")))),
    })


def arbeitnow(df: DataFrame) -> DataFrame:
    """Description escaped once too often; the board is German; types are joined."""
    rows = _open(
        df,
        "slug string, title string, company_name string, url string, description string, location string, "
        "remote boolean, created_at double, job_types array<string>",
    ).where(_complete("slug", "title", "company_name"))
    fallback = F.concat(F.lit("https://www.arbeitnow.com/jobs/companies/"), _e("slug"))
    return _mapped(rows, "arbeitnow", {
        "external_id": _e("slug"),
        "title": _e("title"),
        "company": _e("company_name"),
        "url": F.coalesce(_text(_e("url")), fallback),
        "description": unescape(F.coalesce(_e("description"), F.lit(""))),
        "location": _text(_e("location")),
        "country": F.lit("DE"),
        "is_remote": _e("remote"),
        "posted_at": dates.from_epoch(_e("created_at")),
        "contract_hint": _text(F.array_join(_e("job_types"), ", ")),
    })


def jooble(df: DataFrame) -> DataFrame:
    """The text is an excerpt, the salary free text, the publisher the site it came from."""
    rows = _open(
        df,
        "id string, title string, company string, link string, snippet string, location string, updated string, "
        "salary string, type string, source string",
    ).where(_complete("id", "title", "link"))
    return _mapped(rows, "jooble", {
        "external_id": _e("id"),
        "title": _e("title"),
        "company": F.coalesce(_text(_e("company")), F.lit(fv.UNDECLARED_COMPANY)),
        "url": _e("link"),
        "description": F.coalesce(_e("snippet"), F.lit("")),
        "location": _text(_e("location")),
        "country": F.col("country"),
        "posted_at": dates.parse_iso(_e("updated")),
        "salary_text": _text(_e("salary")),
        "contract_hint": _text(_e("type")),
        "publisher": _text(_e("source")),
    })


def jsearch(df: DataFrame) -> DataFrame:
    """Short uid before long id; place without its "via" tail; direct link among the options."""
    rows = _open(
        df,
        "job_uid string, job_id string, job_title string, employer_name string, job_publisher string, "
        "job_employment_type string, job_apply_link string, job_apply_is_direct boolean, "
        "apply_options array<struct<apply_link:string,is_direct:boolean>>, job_description string, job_city string, "
        "job_state string, job_country string, job_location string, job_is_remote boolean, job_posted_at string, "
        "job_posted_at_timestamp double, job_posted_at_datetime_utc string, job_min_salary string, "
        "job_max_salary string, job_salary_string string, job_salary_period string",
    ).withColumn("uid", F.coalesce(_text(_e("job_uid")), _text(_e("job_id")))).where(
        F.col("uid").isNotNull() & _complete("job_title")
    )
    placed = F.concat_ws(", ", _text(_e("job_city")), _text(_e("job_state")))
    loose = strip(F.regexp_replace(strip(_e("job_location")), r"(?U)\s*[•·|]\s*.*$", ""))
    direct = F.filter(_e("apply_options"), lambda o: o["is_direct"] & (o["apply_link"] != ""))
    own_link = F.when(_e("job_apply_is_direct"), _text(_e("job_apply_link")))
    seconds = F.when(_e("job_posted_at_timestamp") > 0, _e("job_posted_at_timestamp"))
    return _mapped(rows, "jsearch", {
        "external_id": F.col("uid"),
        "title": _e("job_title"),
        "company": F.coalesce(_text(_e("employer_name")), F.lit(fv.UNDECLARED_COMPANY)),
        "url": F.coalesce(_e("job_apply_link"), F.lit("")),
        "description": F.coalesce(_e("job_description"), F.lit("")),
        "location": F.coalesce(_text(placed), _text(loose)),
        "country": F.substring(F.upper(F.coalesce(_text(_e("job_country")), F.col("country"))), 1, 2),
        "is_remote": _e("job_is_remote"),
        "posted_at": F.coalesce(
            dates.parse_iso(_e("job_posted_at_datetime_utc")),
            F.timestamp_seconds(seconds),
            dates.relative_date(_e("job_posted_at"), F.col("now")),
        ),
        "salary_min": _positive(_e("job_min_salary")),
        "salary_max": _positive(_e("job_max_salary")),
        "salary_text": _text(_e("job_salary_string")),
        "salary_period": lookup(fv.FEED_PERIODS, F.upper(_e("job_salary_period"))),
        "contract_hint": _text(_e("job_employment_type")),
        "publisher": _text(_e("job_publisher")),
        "apply_url": F.coalesce(own_link, F.get(direct, F.lit(0))["apply_link"]),
    })


def remoteok(df: DataFrame) -> DataFrame:
    """The legal notice is no posting; zero pay is no pay; yearly dollars and remote by convention."""
    rows = _open(
        df,
        "legal string, id string, position string, company string, url string, description string, location string, "
        "epoch double, salary_min string, salary_max string, apply_url string, tags array<string>",
    ).where(_e("legal").isNull() & _complete("id", "position", "company", "url"))
    low = _positive(_e("salary_min"))
    return _mapped(rows, "remoteok", {
        "external_id": _e("id"),
        "title": _e("position"),
        "company": _e("company"),
        "url": _e("url"),
        "description": F.coalesce(_e("description"), F.lit("")),
        "location": _text(_e("location")),
        "is_remote": F.lit(True),
        "posted_at": dates.from_epoch(_e("epoch")),
        "salary_min": low,
        "salary_max": _positive(_e("salary_max")),
        "salary_currency": F.when(low.isNotNull(), "USD"),
        "salary_period": F.when(low.isNotNull(), "yearly"),
        "apply_url": _text(_e("apply_url")),
    })


def remotive(df: DataFrame) -> DataFrame:
    """The place is where the candidate may live."""
    rows = _open(
        df,
        "id string, title string, company_name string, url string, description string, "
        "candidate_required_location string, publication_date string, salary string, job_type string, tags array<string>",
    ).where(_complete("id", "title", "company_name", "url"))
    return _mapped(rows, "remotive", {
        "external_id": _e("id"),
        "title": _e("title"),
        "company": _e("company_name"),
        "url": _e("url"),
        "description": F.coalesce(_e("description"), F.lit("")),
        "location": _text(_e("candidate_required_location")),
        "is_remote": F.lit(True),
        "posted_at": dates.parse_iso(_e("publication_date")),
        "salary_text": _text(_e("salary")),
        "contract_hint": _text(_e("job_type")),
    })


# --- company boards: payloads name the board, ids are prefixed with it ----------------------------


def _board_rows(df: DataFrame, schema: str, array: bool) -> DataFrame:
    """One row per entry of a board payload, `{"jobs": [...]}` or a bare array."""
    entries = f"array<struct<{schema}>>"
    if array:
        return df.withColumn("e", F.explode(F.from_json("payload", entries)))
    parsed = df.withColumn("doc", F.from_json("payload", f"name string, jobs {entries}"))
    return parsed.withColumn("e", F.explode("doc.jobs"))


def _board_fields(kind: str, key: Column, title: Column) -> dict[str, Column]:
    return {
        "external_id": F.concat_ws(":", "board", key),
        "title": title,
        "ats_type": F.lit(kind),
        "ats_board_token": F.col("board"),
        "ats_job_id": key,
    }


def greenhouse(df: DataFrame) -> DataFrame:
    """Escaped HTML; first publication before last update."""
    rows = _board_rows(
        df,
        "id:string,title:string,absolute_url:string,content:string,location:struct<name:string>,first_published:string,"
        "updated_at:string,company_name:string",
        array=False,
    ).where(_complete("id", "title", "absolute_url"))
    return _mapped(rows, "greenhouse", {
        **_board_fields("greenhouse", _e("id"), _e("title")),
        "company": company_name(F.col("board"), F.col("names"), _e("company_name")),
        "url": _e("absolute_url"),
        "description": unescape(F.coalesce(_e("content"), F.lit(""))),
        "location": _e("location.name"),
        "posted_at": dates.parse_iso(F.coalesce(_text(_e("first_published")), _e("updated_at"))),
        "apply_url": _e("absolute_url"),
    })


def lever(df: DataFrame) -> DataFrame:
    """The description comes in three parts: introduction, titled lists, closing notes."""
    rows = _board_rows(
        df,
        "id:string,text:string,hostedUrl:string,applyUrl:string,categories:struct<location:string,commitment:string>,"
        "country:string,workplaceType:string,createdAt:bigint,description:string,"
        "lists:array<struct<text:string,content:string>>,additional:string",
        array=True,
    ).where(_complete("id", "text", "hostedUrl"))

    def section(block: Column) -> Column:
        body = F.coalesce(block["content"], F.lit(""))
        titled = F.concat(F.lit("<h3>"), block["text"], F.lit("</h3><ul>"), body, F.lit("</ul>"))
        return F.when(F.coalesce(block["text"], F.lit("")) != "", titled).otherwise(body)

    sections = F.coalesce(F.transform(_e("lists"), section), F.array().cast("array<string>"))
    parts = F.concat(F.array(F.coalesce(_e("description"), F.lit(""))), sections, F.array(F.coalesce(_e("additional"), F.lit(""))))
    place = F.lower(_e("workplaceType"))
    return _mapped(rows, "lever", {
        **_board_fields("lever", _e("id"), _e("text")),
        "company": company_name(F.col("board"), F.col("names"), F.lit(None).cast("string")),
        "url": _e("hostedUrl"),
        "description": F.array_join(F.filter(parts, lambda p: strip(p) != ""), "\n"),
        "location": _e("categories.location"),
        "country": _text(F.substring(F.upper(_e("country")), 1, 2)),
        "is_remote": F.when(place != "", place == "remote"),
        "posted_at": dates.from_epoch_millis(_e("createdAt")),
        "contract_hint": _e("categories.commitment"),
        "apply_url": F.coalesce(_text(_e("applyUrl")), _e("hostedUrl")),
    })


def ashby(df: DataFrame) -> DataFrame:
    """Unlisted postings are gone; the compensation summary is the salary text."""
    rows = _board_rows(
        df,
        "id:string,title:string,jobUrl:string,applyUrl:string,isListed:boolean,descriptionHtml:string,"
        "descriptionPlain:string,location:string,isRemote:boolean,publishedAt:string,employmentType:string,"
        "compensation:struct<compensationTierSummary:string>",
        array=False,
    ).where(_complete("id", "title", "jobUrl") & F.coalesce(_e("isListed"), F.lit(True)))
    return _mapped(rows, "ashby", {
        **_board_fields("ashby", _e("id"), _e("title")),
        "company": company_name(F.col("board"), F.col("names"), F.lit(None).cast("string")),
        "url": _e("jobUrl"),
        "description": F.coalesce(_text(_e("descriptionHtml")), _e("descriptionPlain"), F.lit("")),
        "location": _e("location"),
        "is_remote": _e("isRemote"),
        "posted_at": dates.parse_iso(_e("publishedAt")),
        "salary_text": _text(_e("compensation.compensationTierSummary")),
        "contract_hint": _e("employmentType"),
        "apply_url": F.coalesce(_text(_e("applyUrl")), _e("jobUrl")),
    })


def workable(df: DataFrame) -> DataFrame:
    """Requirements and benefits are separate fields; the level is stated in words."""
    rows = _board_rows(
        df,
        "shortcode:string,title:string,url:string,shortlink:string,city:string,country:string,"
        "locations:array<struct<countryCode:string>>,telecommuting:boolean,published_on:string,created_at:string,"
        "employment_type:string,experience:string,application_url:string,description:string,requirements:string,benefits:string",
        array=False,
    ).withColumn("link", F.coalesce(_text(_e("url")), _text(_e("shortlink")))).where(
        _complete("shortcode", "title") & F.col("link").isNotNull()
    )
    code = F.get(_e("locations"), F.lit(0))["countryCode"]
    return _mapped(rows, "workable", {
        **_board_fields("workable", _e("shortcode"), _e("title")),
        "company": company_name(F.col("board"), F.col("names"), F.col("doc.name")),
        "url": F.col("link"),
        "description": F.concat_ws("\n", *[_text(_e(n)) for n in ("description", "requirements", "benefits")]),
        "location": _text(F.concat_ws(", ", _text(_e("city")), _text(_e("country")))),
        "country": _text(F.substring(F.upper(code), 1, 2)),
        "is_remote": _e("telecommuting"),
        "posted_at": dates.parse_iso(F.coalesce(_text(_e("published_on")), _e("created_at"))),
        "contract_hint": _e("employment_type"),
        "seniority_hint": _e("experience"),
        "apply_url": F.coalesce(_text(_e("application_url")), F.col("link")),
    })


MAPPERS = {
    f.__name__: f for f in (adzuna, arbeitnow, jooble, jsearch, remoteok, remotive, greenhouse, lever, ashby, workable)
}
