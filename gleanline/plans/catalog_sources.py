"""Queries over feeds, payload mapping and stored documents.

Payloads are JSON composed from the posting view, so every mapper reads as many rows as there are
documents; the twins state the mapped values directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions import fixed_values as fv
from ..operators import calibrate, serve
from ..session import cut_lineage
from ..sources import documents, feeds, markup, raw, tables
from . import twin
from .registry import Tables, query
from .views import view, with_views

c = F.col
STAMP = "yyyy-MM-dd HH:mm:ss"
NOW = "2024-06-01 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


SHOWN = [n for n in raw.RAW_COLUMNS if n not in ("raw", "description", "posted_at")]


def shown(rows):
    return rows.select(
        *SHOWN, F.md5("description").alias("description"), F.date_format("posted_at", STAMP).alias("posted_at")
    )


def duck_raw(source: str, fields: dict[str, str], where: str = "true") -> str:
    """The expected raw postings of a feed, straight from the posting view."""
    filled = {"source": f"'{source}'", "description": "''", "ats_type": "'unknown'", **fields}
    kinds = {"boolean": "BOOLEAN", "double": "DOUBLE", "string": "VARCHAR"}
    columns = [f"CAST({filled.get(n, 'NULL')} AS {kinds[raw.RAW_TYPES[n]]}) AS {n}" for n in SHOWN]
    columns.append(f"md5({filled['description']}) AS description")
    columns.append(f"{filled.get('posted_at', 'NULL')} AS posted_at")
    return with_views("posting", body=f"SELECT {', '.join(columns)} FROM v_posting WHERE {where}")


def _iso(column: str) -> str:
    return twin.iso(column)


def payload(fields: dict, wrap=None):
    body = F.struct(*[v.alias(k) for k, v in fields.items()])
    return F.to_json(body if wrap is None else wrap(body))


def text_id():
    return F.concat(F.lit("p"), c("id").cast("string"))


# --- common schema -----------------------------------------------------------------------------

_BAD = "CASE WHEN id % 17 = 3 THEN 'missing title' WHEN id % 17 = 5 THEN 'malformed' END"


@query(
    "s01_raw_schema",
    with_views(
        "posting",
        body=f"SELECT CASE WHEN {_BAD} IS NULL THEN external_id END AS external_id, CASE WHEN {_BAD} IS NULL THEN {_iso('posted_at')} END AS posted_at, "
        f"CASE WHEN {_BAD} IS NULL THEN is_remote END AS is_remote, {_BAD} AS reason FROM v_posting",
    ),
)
def raw_schema(t: Tables):
    fields = {
        "source": c("source"), "external_id": c("external_id"), "title": F.when(c("id") % 17 != 3, c("title")), "company": c("company"),
        "url": c("url"), "description": c("description"), "is_remote": c("is_remote"),
        "posted_at": F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss"),
    }
    line = payload(fields)
    lines = view(t, "posting").select(F.when(c("id") % 17 == 5, F.substring(line, 1, 30)).otherwise(line).alias("value"))
    valid, bad = raw.check(lines)
    good = valid.select("external_id", F.date_format("posted_at", STAMP).alias("posted_at"), "is_remote", F.lit(None).cast("string").alias("reason"))
    none = F.lit(None)
    return good.unionByName(
        bad.select(none.cast("string").alias("external_id"), none.cast("string").alias("posted_at"), none.cast("boolean").alias("is_remote"), "reason")
    )


@query("s02_long_ids", "SELECT doc_id, CASE WHEN length(text) > 300 THEN 'sha256:' || sha256(text) ELSE text END AS external_id FROM documents")
def long_ids(t: Tables):
    return t.documents.select("doc_id", raw.guarded_id(c("text")).alias("external_id"))


_STAMPS = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN substr(CAST(ts AS STRING), 1, 19) WHEN 1 THEN replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T') || 'Z'
  WHEN 2 THEN substr(CAST(ts AS STRING), 1, 10) WHEN 3 THEN replace(substr(CAST(ts AS STRING), 1, 16), ' ', 'T') || '+02:00' WHEN 4 THEN 'soon' ELSE '' END AS text,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id * 1000 END AS seconds
FROM {events}
"""


@query(
    "s03_timestamps",
    """SELECT event_id, strftime(CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('day', ts)
        WHEN 3 THEN date_trunc('minute', ts) - INTERVAL '2' HOUR END, '%Y-%m-%d %H:%M:%S') AS iso,
      strftime(CASE WHEN event_id % 5 > 0 THEN to_timestamp(event_id * 1000) AT TIME ZONE 'UTC' END, '%Y-%m-%d %H:%M:%S') AS from_seconds,
      strftime(CASE WHEN event_id % 5 > 0 THEN to_timestamp(event_id) AT TIME ZONE 'UTC' END, '%Y-%m-%d %H:%M:%S') AS from_millis FROM events""",
)
def timestamps(t: Tables):
    return t.sql(_STAMPS).select(
        "event_id",
        F.date_format(dates.parse_iso(c("text")), STAMP).alias("iso"),
        F.date_format(dates.from_epoch(c("seconds")), STAMP).alias("from_seconds"),
        F.date_format(dates.from_epoch_millis(c("seconds")), STAMP).alias("from_millis"),
    )


_PHRASE = """
SELECT event_id, CASE event_id % 9 WHEN 0 THEN CAST(event_id % 20 + 1 AS STRING) || ' giorni fa' WHEN 1 THEN 'vor ' || CAST(event_id % 9 + 1 AS STRING) || ' Stunden'
  WHEN 2 THEN 'Yesterday' WHEN 3 THEN 'una settimana fa' WHEN 4 THEN 'hace 3 meses' WHEN 5 THEN 'oggi' WHEN 6 THEN 'a day ago' WHEN 7 THEN 'qualche giorno' ELSE 'n/d' END AS phrase
FROM {events}
"""


@query(
    "s04_relative_dates",
    f"""SELECT event_id, strftime(TIMESTAMP '{NOW}' - CASE event_id % 9 WHEN 0 THEN (event_id % 20 + 1) * INTERVAL '1' DAY WHEN 1 THEN (event_id % 9 + 1) * INTERVAL '1' HOUR
      WHEN 2 THEN INTERVAL '1' DAY WHEN 3 THEN INTERVAL '7' DAY WHEN 4 THEN INTERVAL '90' DAY WHEN 5 THEN INTERVAL '0' DAY WHEN 6 THEN INTERVAL '1' DAY END, '%Y-%m-%d %H:%M:%S') AS posted_at FROM events""",
)
def relative_dates(t: Tables):
    posted = dates.relative_date(c("phrase"), now())
    return t.sql(_PHRASE).select("event_id", F.date_format(posted, STAMP).alias("posted_at"))


# --- mappers -----------------------------------------------------------------------------------


def iso_z():
    return F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")


@query(
    "s05_feed_adzuna",
    duck_raw("adzuna", {
        "external_id": "'p' || id", "title": "title", "company": "CASE WHEN id % 5 = 0 THEN 'Azienda non dichiarata' ELSE company END", "url": "url",
        "description": "description", "location": "location", "country": "'IT'", "posted_at": _iso("posted_at"),
        "salary_min": "CASE WHEN id % 3 > 0 THEN salary_min END", "salary_max": "CASE WHEN id % 3 > 0 THEN salary_max END",
        "salary_currency": "CASE WHEN id % 3 > 0 AND salary_min > 0 THEN 'EUR' END", "salary_period": "CASE WHEN id % 3 > 0 AND salary_min > 0 THEN 'yearly' END",
        "contract_hint": "nullif(trim(coalesce(contract_hint, '') || CASE WHEN id % 2 = 0 THEN ' full_time' ELSE '' END), '')",
    }),
)
def feed_adzuna(t: Tables):
    entry = payload({
        "id": text_id(), "title": c("title"), "company": F.struct(F.when(c("id") % 5 > 0, c("company")).alias("display_name")),
        "location": F.struct(c("location").alias("display_name")), "redirect_url": c("url"), "description": c("description"), "created": iso_z(),
        "salary_min": c("salary_min"), "salary_max": c("salary_max"), "salary_is_predicted": F.when(c("id") % 3 == 0, "1").otherwise("0"),
        "contract_type": c("contract_hint"), "contract_time": F.when(c("id") % 2 == 0, "full_time"),
    })
    return shown(feeds.adzuna(view(t, "posting").select(entry.alias("payload"), F.lit("it").alias("country"))))


@query(
    "s06_feed_arbeitnow",
    duck_raw("arbeitnow", {
        "external_id": "'p' || id", "title": "title", "company": "company", "url": "CASE WHEN id % 4 = 0 THEN 'https://www.arbeitnow.com/jobs/companies/p' || id ELSE url END",
        "description": "'<p>' || replace(description, '&', '&') || '</p>'", "location": "location", "country": "'DE'", "is_remote": "is_remote",
        "posted_at": _iso("posted_at"), "contract_hint": "CASE WHEN id % 2 = 0 THEN 'Full-time, Remote' END",
    }, "length(replace(description, '&', '')) = length(description) OR true"),
)
def feed_arbeitnow(t: Tables):
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(c("description"), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    entry = payload({
        "slug": text_id(), "title": c("title"), "company_name": c("company"), "url": F.when(c("id") % 4 > 0, c("url")),
        "description": F.concat(F.lit("&lt;p&gt;"), escaped, F.lit("&lt;/p&gt;")), "location": c("location"), "remote": c("is_remote"),
        "created_at": F.unix_timestamp("posted_at"), "job_types": F.when(c("id") % 2 == 0, F.array(F.lit("Full-time"), F.lit("Remote"))),
    })
    return shown(feeds.arbeitnow(view(t, "posting").select(entry.alias("payload"))))


@query(
    "s07_feed_jooble",
    duck_raw("jooble", {
        "external_id": "'p' || id", "title": "title", "company": "CASE WHEN id % 5 = 0 THEN 'Azienda non dichiarata' ELSE company END", "url": "url",
        "description": "description", "location": "location", "country": "'IT'", "posted_at": _iso("posted_at"), "salary_text": "salary_text",
        "contract_hint": "nullif(contract_hint, '')", "publisher": "publisher",
    }),
)
def feed_jooble(t: Tables):
    entry = payload({
        "id": text_id(), "title": c("title"), "company": F.when(c("id") % 5 > 0, c("company")).otherwise(""), "link": c("url"),
        "snippet": c("description"), "location": c("location"), "updated": F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS"),
        "salary": c("salary_text"), "type": c("contract_hint"), "source": c("publisher"),
    })
    return shown(feeds.jooble(view(t, "posting").select(entry.alias("payload"), F.lit("IT").alias("country"))))


@query(
    "s08_feed_jsearch",
    duck_raw("jsearch", {
        "external_id": "CASE WHEN id % 2 = 0 THEN 'p' || id ELSE 'long:' || id END", "title": "title", "company": "company", "url": "coalesce(url, '')",
        "description": "description", "location": "CASE WHEN id % 4 = 0 THEN 'Ivrea, TO' ELSE 'Ivrea TO' END", "country": "CASE WHEN country IS NULL THEN 'IT' ELSE upper(country) END",
        "is_remote": "is_remote", "posted_at": f"CASE WHEN id % 3 = 0 THEN {_iso('posted_at')} WHEN id % 3 = 1 THEN '2023-11-14 22:13:20' ELSE strftime(TIMESTAMP '{NOW}' - INTERVAL '4' DAY, '%Y-%m-%d %H:%M:%S') END",
        "salary_min": "nullif(salary_min, 0)", "salary_max": "nullif(salary_max, 0)", "salary_text": "salary_text", "salary_period": "CASE WHEN id % 2 = 0 THEN 'yearly' ELSE 'hourly' END",
        "contract_hint": "nullif(contract_hint, '')", "publisher": "publisher",
        "apply_url": "CASE WHEN id % 3 = 0 THEN url WHEN id % 3 = 1 THEN 'https://direct.example.com/' || id END",
    }, "posted_at IS NOT NULL OR id % 3 > 0 OR true").replace("CASE WHEN id % 3 = 0 THEN strftime(posted_at, '%Y-%m-%d %H:%M:%S')", f"CASE WHEN id % 3 = 0 THEN coalesce(strftime(posted_at, '%Y-%m-%d %H:%M:%S'), strftime(TIMESTAMP '{NOW}' - INTERVAL '4' DAY, '%Y-%m-%d %H:%M:%S'))"),
)
def feed_jsearch(t: Tables):
    k = c("id") % 3
    option = lambda link, direct: F.struct(link.alias("apply_link"), F.lit(direct).alias("is_direct"))
    direct = F.concat(F.lit("https://direct.example.com/"), c("id").cast("string"))
    entry = payload({
        "job_uid": F.when(c("id") % 2 == 0, text_id()), "job_id": F.concat(F.lit("long:"), c("id").cast("string")), "job_title": c("title"),
        "employer_name": c("company"), "job_publisher": c("publisher"), "job_employment_type": c("contract_hint"), "job_apply_link": c("url"),
        "job_apply_is_direct": k == 0, "apply_options": F.when(k == 1, F.array(option(c("url"), False), option(direct, True))),
        "job_description": c("description"), "job_city": F.when(c("id") % 4 == 0, "Ivrea"), "job_state": F.when(c("id") % 4 == 0, "TO"),
        "job_country": c("country"), "job_location": F.lit("Ivrea TO     •  tramite LinkedIn"), "job_is_remote": c("is_remote"),
        "job_posted_at": F.lit("4 giorni fa"), "job_posted_at_timestamp": F.when(k == 1, 1700000000), "job_posted_at_datetime_utc": F.when(k == 0, iso_z()),
        "job_min_salary": c("salary_min"), "job_max_salary": c("salary_max"), "job_salary_string": c("salary_text"),
        "job_salary_period": F.when(c("id") % 2 == 0, "year").otherwise("HOUR"),
    })
    return shown(feeds.jsearch(view(t, "posting").select(entry.alias("payload"), F.lit("it").alias("country"), now().alias("now"))))


@query(
    "s09_feed_remoteok",
    duck_raw("remoteok", {
        "external_id": "'p' || id", "title": "title", "company": "company", "url": "url", "description": "description", "location": "location",
        "is_remote": "true", "posted_at": _iso("posted_at"), "salary_min": "nullif(salary_min, 0)", "salary_max": "nullif(salary_max, 0)",
        "salary_currency": "CASE WHEN salary_min > 0 THEN 'USD' END", "salary_period": "CASE WHEN salary_min > 0 THEN 'yearly' END", "apply_url": "apply_url",
    }, "id % 20 > 0"),
)
def feed_remoteok(t: Tables):
    """Every twentieth row is the legal notice."""
    entry = payload({
        "legal": F.when(c("id") % 20 == 0, "terms"), "id": text_id(), "position": c("title"), "company": c("company"), "url": c("url"),
        "description": c("description"), "location": c("location"), "epoch": F.unix_timestamp("posted_at"),
        "salary_min": F.coalesce("salary_min", F.lit(0.0)), "salary_max": F.coalesce("salary_max", F.lit(0.0)), "apply_url": c("apply_url"),
    })
    return shown(feeds.remoteok(view(t, "posting").select(entry.alias("payload"))))


@query(
    "s10_feed_remotive",
    duck_raw("remotive", {
        "external_id": "CAST(id + 1 AS VARCHAR)", "title": "title", "company": "company", "url": "url", "description": "description", "location": "location",
        "is_remote": "true", "posted_at": _iso("posted_at"), "salary_text": "salary_text", "contract_hint": "nullif(contract_hint, '')",
    }),
)
def feed_remotive(t: Tables):
    entry = payload({
        "id": c("id") + 1, "title": c("title"), "company_name": c("company"), "url": c("url"), "description": c("description"),
        "candidate_required_location": c("location"), "publication_date": F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss"),
        "salary": c("salary_text"), "job_type": c("contract_hint"),
    })
    return shown(feeds.remotive(view(t, "posting").select(entry.alias("payload"))))


_BOARD = "'acme-' || id % 3"
_BOARD_NAME = "CASE id % 3 WHEN 0 THEN 'Acme Inc.' ELSE {f} END"


def board_rows(t: Tables, entry):
    names = F.create_map(F.lit("acme-0"), F.lit("Acme Inc."))
    board = F.concat(F.lit("acme-"), (c("id") % 3).cast("string"))
    return view(t, "posting").select(entry.alias("payload"), board.alias("board"), names.alias("names"))


def board_fields(kind: str, key: str = "'p' || id") -> dict[str, str]:
    return {
        "external_id": f"{_BOARD} || ':' || {key}", "title": "title", "url": "url", "ats_type": f"'{kind}'",
        "ats_board_token": _BOARD, "ats_job_id": key, "posted_at": _iso("posted_at"), "description": "description", "location": "location",
    }


def in_jobs(body):
    return F.struct(F.lit("Payload Name").alias("name"), F.array(body).alias("jobs"))


@query(
    "s11_feed_greenhouse",
    duck_raw("greenhouse", {
        **board_fields("greenhouse"), "company": _BOARD_NAME.format(f="company"), "apply_url": "url",
        "posted_at": f"coalesce({_iso('posted_at')}, '2024-05-05 00:00:00')", "description": "'<p>x &amp; y</p>' || lang",
    }),
)
def feed_greenhouse(t: Tables):
    entry = payload({
        "id": text_id(), "title": c("title"), "absolute_url": c("url"), "content": F.concat(F.lit("&lt;p&gt;x &amp;amp; y&lt;/p&gt;"), c("lang")),
        "location": F.struct(c("location").alias("name")), "first_published": iso_z(), "updated_at": F.lit("2024-05-05"), "company_name": c("company"),
    }, in_jobs)
    return shown(feeds.greenhouse(board_rows(t, entry)))


@query(
    "s12_feed_lever",
    duck_raw("lever", {
        **board_fields("lever"), "company": _BOARD_NAME.format(f="'Acme ' || id % 3"), "country": "upper(country)", "contract_hint": "contract_hint",
        "is_remote": "CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END", "apply_url": "coalesce(apply_url, url)",
        "description": "lang || chr(10) || '<h3>Need</h3><ul><li>' || title || '</li></ul>' || chr(10) || 'plain' || CASE WHEN id % 2 = 0 THEN chr(10) || source ELSE '' END",
    }),
)
def feed_lever(t: Tables):
    block = lambda title, body: F.struct(title.alias("text"), body.alias("content"))
    lists = F.array(block(F.lit("Need"), F.concat(F.lit("<li>"), c("title"), F.lit("</li>"))), block(F.lit(""), F.lit("plain")))
    entry = payload({
        "id": text_id(), "text": c("title"), "hostedUrl": c("url"), "applyUrl": c("apply_url"),
        "categories": F.struct("location", c("contract_hint").alias("commitment")), "country": c("country"),
        "workplaceType": F.when(c("id") % 3 == 0, "Remote").when(c("id") % 3 == 1, "onsite"), "createdAt": F.unix_millis("posted_at"),
        "description": c("lang"), "lists": lists, "additional": F.when(c("id") % 2 == 0, c("source")).otherwise(" "),
    }, F.array)
    return shown(feeds.lever(board_rows(t, entry)))


@query(
    "s13_feed_ashby",
    duck_raw("ashby", {
        **board_fields("ashby"), "company": _BOARD_NAME.format(f="'Acme ' || id % 3"), "is_remote": "is_remote", "salary_text": "salary_text",
        "contract_hint": "contract_hint", "apply_url": "coalesce(apply_url, url)",
    }, "id % 7 > 0"),
)
def feed_ashby(t: Tables):
    """Every seventh posting is unlisted."""
    entry = payload({
        "id": text_id(), "title": c("title"), "jobUrl": c("url"), "applyUrl": c("apply_url"), "isListed": F.when(c("id") % 7 == 0, False),
        "descriptionHtml": F.when(c("id") % 2 == 0, c("description")), "descriptionPlain": c("description"), "location": c("location"),
        "isRemote": c("is_remote"), "publishedAt": iso_z(), "employmentType": c("contract_hint"),
        "compensation": F.struct(c("salary_text").alias("compensationTierSummary")),
    }, in_jobs)
    return shown(feeds.ashby(board_rows(t, entry)))


@query(
    "s14_feed_workable",
    duck_raw("workable", {
        **board_fields("workable"), "company": _BOARD_NAME.format(f="'Payload Name'"), "location": "CASE WHEN id % 2 = 0 THEN 'Milano, Italy' ELSE 'Italy' END",
        "country": "upper(country)", "is_remote": "is_remote", "contract_hint": "contract_hint", "seniority_hint": "seniority_hint", "apply_url": "coalesce(apply_url, url)",
        "posted_at": f"coalesce({_iso('posted_at')}, '2024-05-05 00:00:00')", "description": "description || chr(10) || lang",
    }),
)
def feed_workable(t: Tables):
    entry = payload({
        "shortcode": text_id(), "title": c("title"), "url": F.when(c("id") % 2 == 0, c("url")), "shortlink": c("url"), "city": F.when(c("id") % 2 == 0, "Milano"),
        "country": F.lit("Italy"), "locations": F.when(c("country").isNotNull(), F.array(F.struct(c("country").alias("countryCode")))),
        "telecommuting": c("is_remote"), "published_on": F.date_format("posted_at", STAMP), "created_at": F.lit("2024-05-05"),
        "employment_type": c("contract_hint"), "experience": c("seniority_hint"), "application_url": c("apply_url"),
        "description": c("description"), "requirements": F.lit(""), "benefits": c("lang"),
    }, in_jobs)
    return shown(feeds.workable(board_rows(t, entry)))


@query(
    "s15_company_names",
    """SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'Named ' || n_name WHEN 1 THEN s_name ELSE 'Nation ' || s_nationkey || ' Board' END AS company
       FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def company_names(t: Tables):
    rows = t.supplier.join(t.nation, t.supplier["s_nationkey"] == t.nation["n_nationkey"])
    token = F.concat(F.lit("nation-"), c("s_nationkey").cast("string"), F.lit("-board"))
    names = F.when(c("s_nationkey") % 3 == 0, F.create_map(token, F.concat(F.lit("Named "), c("n_name")))).otherwise(
        F.from_json(F.lit("{}"), "map<string,string>")
    )
    named = raw.company_name(token, names, F.when(c("s_nationkey") % 3 == 1, c("s_name")))
    return rows.select("s_suppkey", named.alias("company"))


_KEYWORDS = ["senior software developer", "data qa", "Sviluppatore backend"]
_WANTED = sorted({w for k in _KEYWORDS for w in k.lower().split()} - set(fv.TITLE_STOPWORDS))


@query(
    "s16_title_filter",
    with_views(
        "posting",
        body=f"SELECT id, len(list_filter({twin.array(_WANTED)}, lambda w: list_contains(t, w) OR (length(w) >= 4 AND len(list_filter(t, lambda x: starts_with(x, w))) > 0))) > 0 AS relevant "
        "FROM (SELECT id, regexp_extract_all(lower(title || ' ' || description), '[a-z0-9+#]+') AS t FROM v_posting)",
    ),
)
def title_filter(t: Tables):
    keywords = F.array(*[F.lit(k) for k in _KEYWORDS])
    relevant = raw.title_matches(c("title"), c("description"), keywords)
    return view(t, "posting").select("id", relevant.alias("relevant"))


@query("s17_drop_repeats", "SELECT source, lang || length(text) % 40 AS external_id FROM documents GROUP BY ALL")
def drop_repeats(t: Tables):
    key = F.concat("lang", (F.length("text") % 40).cast("string"))
    return raw.drop_repeats(t.documents.select("source", key.alias("external_id")))


@query(
    "s18_cap_per_feed",
    "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 15",
)
def cap_per_feed(t: Tables):
    return raw.cap_per_feed(t.documents.select("source", "doc_id"), 15, "doc_id")


_FAM = twin.first_match(fv.FAMILY_RULES, "title")
_SYN = twin.case_map(fv.KEYWORD_SYNONYMS, "k")


@query(
    "s19_search_keywords",
    with_views(
        "posting",
        body=f"""SELECT id, array_to_string((en || list_filter(list_transform(en, lambda k: {_SYN}), lambda k: k IS NOT NULL))[1:6], ',') AS keywords
      FROM (SELECT id, list_filter(CASE WHEN head = fam THEN [head] ELSE [head, fam] END, lambda k: k IS NOT NULL) AS en
        FROM (SELECT id, lower({twin.tidy_title('title')}) AS head, lower({_FAM}) AS fam FROM v_posting))""",
    ),
)
def search_keywords(t: Tables):
    words = raw.search_keywords(text.tidy_title(c("title")), F.array(c("title"), F.lit("Sales Jedi"), c("title")))
    return view(t, "posting").select("id", F.array_join(words, ",").alias("keywords"))


def metrics(t: Tables):
    rows = t.documents.select(
        "source", F.when(c("doc_id") % 3 == 0, "new").otherwise("key").alias("matched_by"), (c("source") == "src3").alias("failed"), (c("doc_id") % 2).alias("api_calls")
    )
    return raw.feed_metrics(rows)


_METRICS = "SELECT source, count(*) AS fetched, count_if(doc_id % 3 = 0) AS new, CAST(sum(doc_id % 2) AS BIGINT) AS api_calls, CASE WHEN source = 'src3' THEN 'failed' ELSE 'ok' END AS status FROM documents GROUP BY 1"


@query("s20_feed_metrics", _METRICS)
def feed_metrics(t: Tables):
    return metrics(t)


_RUN_ROWS = """
SELECT d.doc_id, d.source, CASE WHEN d.doc_id % 3 = 0 THEN 'new' ELSE 'key' END AS matched_by, d.doc_id % 97 = 3 AS failed, d.doc_id % 2 AS api_calls,
  TIMESTAMP '2024-01-01 00:00:00' + (d.doc_id % 1000) * INTERVAL '1' SECOND AS fetched_at, 'line ' || CAST(d.doc_id % 10 AS STRING) AS error,
  d.doc_id = f.first_id AS is_first
FROM {documents} d JOIN (SELECT text, min(doc_id) AS first_id FROM {documents} GROUP BY text) f ON f.text = d.text
"""


@query(
    "s20_feed_run",
    f"""SELECT source, count(*) AS fetched, count_if(matched_by = 'new') AS new, count_if(NOT is_first) AS duplicate, CAST(sum(api_calls) AS BIGINT) AS api_calls,
      (epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) / 1000000.0 AS elapsed, min(error) FILTER (failed) AS error, CASE WHEN count_if(failed) > 0 THEN 'failed' ELSE 'ok' END AS status
    FROM ({_RUN_ROWS.replace('{documents}', 'documents')}) GROUP BY 1""",
)
def feed_run(t: Tables):
    """Metrics taken while the day's rows are written."""
    feeds = sorted(r.source for r in t.documents.where("source IS NOT NULL").select("source").distinct().collect())
    run = raw.FeedRun(feeds)
    cut_lineage(run.watch(t.sql(_RUN_ROWS)))
    return run.rows(t.spark)


_GROUPS = "(SELECT count(DISTINCT text) FROM documents)"


@query(
    "s21_share_duplicates",
    f"WITH m AS ({_METRICS}), s AS (SELECT sum(fetched) AS total FROM m) SELECT source, CAST(round_even((total - {_GROUPS}) * fetched / total, 0) AS BIGINT) AS duplicate FROM m, s",
)
def share_duplicates(t: Tables):
    groups = t.documents.agg(F.count_distinct("text")).scalar()
    return raw.share_duplicates(metrics(t), groups).select("source", "duplicate")


@query(
    "s22_batch_status",
    with_views("run", body="SELECT strftime(batch_id, '%Y-%m-%d') || source AS batch, CASE WHEN count_if(status = 'failed') = 0 THEN 'ok' WHEN count_if(status = 'failed') = count(*) THEN 'failed' ELSE 'partial' END AS status FROM v_run GROUP BY 1"),
)
def batch_status(t: Tables):
    """A batch is one day of one feed here, so that all three outcomes occur."""
    runs = view(t, "run").withColumn("batch_id", F.concat(F.date_format("batch_id", "yyyy-MM-dd"), "source"))
    return serve.batch_status(runs).withColumnRenamed("batch_id", "batch")


_RAW = """
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'jooble' ELSE 'jsearch' END AS adapter,
  CASE event_id % 4 WHEN 0 THEN '{"job_publisher":" LinkedIn ","source":"x.com"}' WHEN 1 THEN '{"job_publisher":"  ","source":"' || event_type || '.com"}' WHEN 2 THEN '{"source":"y.com"}' ELSE props END AS raw
FROM {events}
"""


@query(
    "s23_backfill_publisher",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'LinkedIn' WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN event_type || '.com' END WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 'y.com' END END AS publisher FROM events",
)
def backfill_publisher(t: Tables):
    return t.sql(_RAW).select("event_id", raw.backfill_publisher(c("raw"), c("adapter")).alias("publisher"))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(
    "s24_csv_cells",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS table_rows FROM {n}" for n in _TABLES),
)
def csv_cells(t: Tables):
    """Rows each table would export; the cells themselves are rendered and counted."""
    parts = []
    for name in _TABLES:
        cells = tables.csv_cells(getattr(t, name))
        filled = F.count(F.concat_ws(",", *cells.columns))
        parts.append(cells.agg(filled.alias("table_rows")).select(F.lit(name).alias("table_name"), "table_rows"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "s25_label_sheet",
    with_views("posting", body=f"SELECT id AS match_id, '' AS label, title, company, score, (score * 3) % 101 AS must_have_coverage, coalesce(apply_url, url) AS url FROM v_posting WHERE score >= 0 ORDER BY score DESC, id LIMIT 30"),
)
def label_sheet(t: Tables):
    rows = view(t, "posting").withColumn("match_id", c("id"))
    scored = rows.withColumns({n: (c("score") * (i + 3)) % 101 for i, n in enumerate(calibrate.CRITERIA)})
    return calibrate.export_sheet(scored).select("match_id", "label", "title", "company", "score", "must_have_coverage", "url")


@query(
    "s26_read_labels",
    "SELECT doc_id AS match_id, CASE doc_id % 5 WHEN 1 THEN doc_id % 100 + 0.5 ELSE doc_id % 100 END AS label, CASE WHEN doc_id % 3 = 0 THEN 50 ELSE quality * 100 END AS must_have_coverage FROM labels WHERE doc_id % 5 NOT IN (0, 2)",
)
def read_labels(t: Tables):
    k = c("doc_id") % 5
    number = (c("doc_id") % 100).cast("string")
    label = F.when(k == 0, "  ").when(k == 1, F.concat(number, F.lit(",5"))).when(k == 2, "boh").otherwise(number)
    rows = t.labels.select(
        c("doc_id").alias("match_id"), label.alias("label"),
        *[F.when(c("doc_id") % 3 > 0, (c("quality") * 100).cast("string")).otherwise("").alias(n) for n in calibrate.CRITERIA],
    )
    return calibrate.read_labels(rows).select("match_id", "label", "must_have_coverage")


# --- documents ---------------------------------------------------------------------------------


@query(
    "s27_profile_problems",
    """SELECT o_orderkey AS profile_id, array_to_string(list_filter(CASE WHEN o_orderkey % 10 = 9 THEN ['malformed'] ELSE [CASE WHEN o_orderkey % 3 = 0 THEN 'repeated ids: b1' END,
      CASE WHEN o_orderkey % 4 = 0 THEN 'month not in YYYY-MM' END, CASE WHEN o_orderkey % 5 = 0 THEN 'end before start' END] END, lambda x: x IS NOT NULL), '; ') AS problems FROM orders""",
)
def profile_problems(t: Tables):
    k = c("o_orderkey")
    bullet = lambda name: F.struct(name.alias("id"), F.lit("t").alias("text"))
    job = F.struct(
        F.lit("e1").alias("id"), c("o_orderpriority").alias("company"), F.lit("r").alias("role"),
        F.when(k % 4 == 0, "2001-1").otherwise("2001-05").alias("start"),
        F.when(k % 5 == 0, "1999-02").alias("end"), F.array(bullet(F.lit("b1")), bullet(F.when(k % 3 == 0, "b1").otherwise("b2"))).alias("bullets"),
    )
    doc = F.to_json(F.struct(F.struct(F.lit("Ann").alias("full_name")).alias("contact"), F.array(job).alias("experiences"), F.array(F.struct(F.lit("p1").alias("id"))).alias("projects")))
    broken = F.when(k % 10 == 9, F.lit("null")).otherwise(doc)
    profile = F.from_json(broken, documents.PROFILE_SCHEMA)
    return t.orders.select(k.alias("profile_id"), profile.alias("p")).select(
        "profile_id", F.array_join(documents.profile_problems(c("p")), "; ").alias("problems")
    )


@query(
    "s28_answers",
    """SELECT c_custkey AS profile_id, 'IT' AS countries, CASE WHEN c_custkey % 4 = 0 THEN 'en' ELSE 'it' END AS languages, array_to_string(list_filter([CASE WHEN c_custkey % 6 = 0 THEN 'notice_period_days' END,
        CASE WHEN c_custkey % 5 = 0 THEN 'salary range' END], lambda x: x IS NOT NULL), ',') AS problems,
      array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'phone' END, CASE WHEN c_custkey % 3 > 0 THEN 'linkedin' END], lambda x: x IS NOT NULL), ',') AS gaps FROM customer""",
)
def answers(t: Tables):
    k = c("c_custkey")
    doc = payload({
        "full_name": c("c_name"), "phone": F.when(k % 2 == 1, "+39 02"), "work_authorization": F.create_map(F.lit("it"), F.lit("citizen")),
        "languages": F.create_map(F.when(k % 4 == 0, "EN").otherwise("IT"), F.lit("B2")), "notice_period_days": F.when(k % 6 == 0, 500).otherwise(30),
        "salary_expectation_min": F.lit(30000), "salary_expectation_max": F.when(k % 5 == 0, 20000).otherwise(40000), "linkedin_url": F.when(k % 3 == 0, "https://l.example"),
    })
    rows = t.customer.select(k.alias("profile_id"), F.from_json(doc, documents.ANSWERS_SCHEMA).alias("a"))
    loaded = rows.withColumn("a", documents.load_answers(c("a")))
    return loaded.select(
        "profile_id", F.array_join(F.map_keys("a.work_authorization"), ",").alias("countries"), F.array_join(F.map_keys("a.languages"), ",").alias("languages"),
        F.array_join(documents.answer_problems(c("a")), ",").alias("problems"), F.array_join(documents.answer_gaps(c("a")), ",").alias("gaps"),
    )


_SETTINGS = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"n":true,"days":"14","modes":["remote","moon"]}' WHEN 1 THEN '{"n":' || CAST(user_id AS STRING) || ',"days":1,"modes":"remote"}'
  WHEN 2 THEN '{"n":"7","days":999}' WHEN 3 THEN '{"n":2.5,"days":"soon","modes":["hybrid","on_site"]}' WHEN 4 THEN 'not json' ELSE props END AS settings
FROM {events}
"""


@query(
    "s29_settings",
    """SELECT event_id, CASE event_id % 6 WHEN 1 THEN user_id ELSE 45 END AS n, CASE event_id % 6 WHEN 0 THEN 14 WHEN 1 THEN 3 WHEN 2 THEN 60 ELSE 7 END AS days,
      CASE event_id % 6 WHEN 0 THEN 'remote' WHEN 3 THEN 'hybrid,on_site' ELSE '' END AS modes FROM events""",
)
def settings(t: Tables):
    low, high = fv.FOLLOW_UP_DAYS_RANGE
    return t.sql(_SETTINGS).select(
        "event_id", documents.whole_number(c("settings"), "n", 45).alias("n"),
        documents.clamped_number(c("settings"), "days", 7, low, high).alias("days"),
        F.array_join(documents.allowed_values(c("settings"), "modes", fv.WORK_MODES), ",").alias("modes"),
    )


@query(
    "s30_messages",
    """SELECT conv_id * 1000 + turn AS id, 'm' || turn || '@x' AS message_id, 'Jöb <hr@x.example>' AS sender, 'Re: ' || role AS subject, '2024-03-05 10:00:00' AS sent_at,
      'm' || (turn - 1) || '@x r@x' AS refs, CASE WHEN turn % 3 = 1 THEN 'Hi' || chr(10) || chr(10) || '- one' ELSE 'Hello ' || role END AS body FROM conversations WHERE turn % 5 <> 4""",
)
def messages(t: Tables):
    """One message per turn: plain, HTML only, or undated (dropped)."""
    turn = c("turn").cast("string")
    html = F.lit("<p>Hi</p><ul><li>one</li></ul>")
    head = [
        F.concat(F.lit("Message-ID: m"), turn, F.lit("@x")), F.lit("From: =?utf-8?q?J=C3=B6b?= <hr@x.example>"), F.concat(F.lit("Subject: Re: "), c("role")),
        F.when(c("turn") % 5 != 4, "Date: Tue, 5 Mar 2024 12:00:00 +0200"), F.concat(F.lit("In-Reply-To: m"), (c("turn") - 1).cast("string"), F.lit("@x")), F.lit("References: r@x"),
        F.when(c("turn") % 3 == 1, "Content-Type: text/html; charset=utf-8").otherwise("Content-Type: text/plain; charset=utf-8"),
    ]
    body = F.when(c("turn") % 3 == 1, html).otherwise(F.concat(F.lit("Hello "), c("role")))
    content = F.concat_ws("\r\n", *head, F.lit(""), body)
    files = t.conversations.select((c("conv_id") * 1000 + c("turn")).cast("string").alias("path"), F.encode(content, "UTF-8").alias("content"))
    out = markup.parse_messages(files)
    return out.select(
        c("path").cast("long").alias("id"), "message_id", "sender", "subject", F.date_format("sent_at", STAMP).alias("sent_at"),
        F.array_join("references", " ").alias("refs"), "body",
    )


@query(
    "s31_sync_feeds",
    "SELECT source AS adapter, CASE WHEN stored THEN 'Stored ' ELSE 'Feed ' END || source AS display_name, CASE WHEN stored THEN false ELSE CAST(regexp_extract(source, '[0-9]+') AS INT) % 3 = 0 END AS enabled "
    "FROM (SELECT source, CAST(regexp_extract(source, '[0-9]+') AS INT) % 2 = 0 AS stored FROM (SELECT DISTINCT source FROM documents))",
)
def sync_feeds(t: Tables):
    """Even feeds are stored (switched off by hand), all feeds are known."""
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    names = t.documents.select("source").distinct()
    stored = names.where(number % 2 == 0).select(c("source").alias("adapter"), F.concat(F.lit("Stored "), "source").alias("display_name"), F.lit(False).alias("enabled"))
    keys = F.when(number % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("KEY")))
    known = names.select(c("source").alias("adapter"), F.concat(F.lit("Feed "), "source").alias("display_name"), keys.alias("required_settings"))
    return raw.sync_feeds(stored, known)


@query("n01_html_to_text_strict")
def html_to_text_strict(t: Tables):
    out = markup.html_to_text_strict(t.pages, "page_id", "html")
    return out.select("page_id", F.md5("text").alias("digest"), F.length("text").alias("chars"))
