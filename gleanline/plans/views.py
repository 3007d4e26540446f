"""Derived views over the driver tables.

One SQL text per view, valid in Spark SQL and in DuckDB, so both sides of a comparison see the same
rows. Every view keeps all rows of its table; only columns are composed. Table names are written
{name}: Spark binds them to DataFrames, DuckDB gets plain names.
"""

from __future__ import annotations

from .registry import Tables

_ROLES = [
    "Senior Software Engineer", "Backend Developer", "Sales Jedi", "Data Engineer",
    "Machine Learning Engineer", "Tech Lead", "Softwareentwickler", "Frontend Developer (Hybrid)",
    "Junior Data Analyst", "Site Reliability Engineer", "Principal Engineer", "Sviluppatore Java",
    "Android Developer", "Software Engineering Intern", "Product Manager Remote",
    "Fullstack Developer",
]
_PLACES = [
    "Milano, Italia", "Berlin / Germany", "Remote", None, "Italia", "San Francisco, CA",
    "Zürich, Schweiz", "Roma - Lazio - Italy", "Madrid, España", "Amsterdam, Netherlands",
    "Europe", "Milano, MI, Italia",
]


def _case(key: str, values: list) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else repr(v) if isinstance(v, str) else v}"
        for i, v in enumerate(values)
    )
    return f"CASE {key} {arms} END"


POSTING = f"""
SELECT d.doc_id AS id, d.source, CAST(d.doc_id AS STRING) AS external_id,
  {_case('d.doc_id % 16', _ROLES)} || {_case('d.doc_id % 5', [' (m/w/d)', ' - f/m/d', '', '', ''])} AS title,
  'Company ' || CAST(d.doc_id % 13 AS STRING) || {_case('d.doc_id % 4', [' S.r.l.', ' GmbH', '', ' Holding'])} AS company,
  'https://jobs.example.com/' || CAST(d.doc_id AS STRING) AS url,
  d.text AS description,
  {_case('d.doc_id % 12', _PLACES)} AS location,
  {_case('d.doc_id % 7', [None, 'it', None, 'DE', None, 'us', None])} AS country,
  {_case('d.doc_id % 3', [None, 'true', 'false'])} = 'true' AS is_remote,
  CASE WHEN d.doc_id % 11 = 10 THEN NULL
       ELSE TIMESTAMP '2024-01-01 00:00:00' + (d.doc_id % 2000) * INTERVAL '1' HOUR END AS posted_at,
  CASE WHEN d.doc_id % 6 = 0 THEN CAST(20000 + (d.doc_id % 50) * 1000 AS DOUBLE) END AS salary_min,
  CASE WHEN d.doc_id % 12 = 0 THEN CAST(30000 + (d.doc_id % 50) * 1000 AS DOUBLE) END AS salary_max,
  CASE WHEN d.doc_id % 6 = 0 THEN {_case('d.doc_id % 4', ['EUR', 'USD', None, 'gbp'])} END AS salary_currency,
  CASE WHEN d.doc_id % 18 = 0 THEN 'yearly' END AS salary_period,
  CASE d.doc_id % 9
    WHEN 1 THEN CAST(25 + d.doc_id % 20 AS STRING) || '.000 - ' || CAST(45 + d.doc_id % 20 AS STRING) || '.000 EUR annui'
    WHEN 2 THEN CAST(10 + d.doc_id % 30 AS STRING) || ' €/ora'
    WHEN 4 THEN '$' || CAST(100 + d.doc_id % 90 AS STRING) || '.4K - $290.6K'
    WHEN 5 THEN '1.' || CAST(500 + d.doc_id % 400 AS STRING) || ' € al mese x 14 mensilità'
    WHEN 7 THEN 'competitive salary'
    WHEN 8 THEN CAST(30 + d.doc_id % 30 AS STRING) || ',000 per year' END AS salary_text,
  {_case('d.doc_id % 8', [None, 'Full-time', 'Part-time', None, 'Freelance', 'Tempo determinato', '', None])} AS contract_hint,
  {_case('d.doc_id % 10', [None, None, 'Mid-Senior level', None, 'Entry level', None, None, 'Middle', None, None])} AS seniority_hint,
  CASE WHEN d.doc_id % 4 = 1 THEN 'https://apply.example.com/' || CAST(d.doc_id AS STRING) END AS apply_url,
  {_case('d.doc_id % 6', ['unknown', 'greenhouse', 'unknown', 'taleo', 'unknown', 'lever'])} AS ats_type,
  CASE WHEN d.doc_id % 6 = 1 THEN 'board-' || CAST(d.doc_id % 97 AS STRING) END AS ats_board_token,
  CASE WHEN d.doc_id % 6 = 1 THEN CAST(d.doc_id AS STRING) END AS ats_job_id,
  {_case('d.doc_id % 5', ['LinkedIn', 'www.indeed.com', None, '  ', 'hireskys.com'])} AS publisher,
  d.lang, d.n_chars, l.quality, l.toxic,
  CASE WHEN l.toxic = 1 THEN 'hidden' WHEN l.quality = 0 THEN 'applied'
       WHEN l.quality = 1 THEN {_case('d.doc_id % 3', ['new', 'seen', 'shortlist'])} ELSE 'new' END AS status,
  CASE WHEN l.quality IS NULL THEN NULL ELSE (d.doc_id * 37) % 101 END AS score
FROM {{documents}} d LEFT JOIN {{labels}} l ON l.doc_id = d.doc_id
"""

# Near-copies sit in different sources of one language, so the language stands for the employer.
LISTING = """
SELECT doc_id AS id, source, lang AS company_normalized,
  lang || '|' || split_part(text, chr(10), 1) || '|' AS canonical_key,
  text AS description_clean, n_chars, CAST(doc_id AS STRING) AS external_id,
  CASE doc_id % 6 WHEN 1 THEN 'greenhouse' WHEN 3 THEN 'taleo' WHEN 5 THEN 'lever' ELSE 'unknown' END AS ats_type,
  CASE WHEN doc_id % 12 = 1 THEN 'board-' || CAST(doc_id % 97 AS STRING) END AS ats_board_token,
  CASE WHEN doc_id % 2 = 1 THEN 'job-' || CAST(doc_id AS STRING) END AS ats_job_id,
  doc_id % 3 = 0 AS salary_is_stated, CAST(20000 + doc_id % 1000 AS BIGINT) AS salary_min,
  CASE WHEN doc_id % 2 = 0 THEN CAST(30000 + doc_id % 1000 AS BIGINT) END AS salary_max,
  CASE doc_id % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' END AS salary_currency,
  CASE WHEN doc_id % 7 < 5 THEN 'yearly' ELSE 'monthly' END AS salary_period,
  CAST(20000 + doc_id % 900 AS BIGINT) AS salary_eur_year_min, CASE WHEN doc_id % 2 = 0 THEN CAST(30000 + doc_id % 900 AS BIGINT) END AS salary_eur_year_max,
  'hash-' || CAST(doc_id AS STRING) AS content_hash, CASE WHEN doc_id % 11 > 0 THEN lang END AS lang,
  CASE WHEN doc_id % 13 > 0 THEN 'Title ' || CAST(doc_id AS STRING) ELSE '' END AS title,
  CASE doc_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'remote' WHEN 2 THEN 'hybrid' ELSE 'on_site' END AS work_mode,
  CASE WHEN doc_id % 3 = 1 THEN 'permanent' ELSE 'unknown' END AS contract_type,
  CASE doc_id % 5 WHEN 0 THEN 'senior' WHEN 1 THEN 'mid' ELSE 'unknown' END AS seniority,
  CASE WHEN doc_id % 2 = 0 THEN 'Family ' || CAST(doc_id % 9 AS STRING) END AS job_family,
  CASE WHEN doc_id % 4 = 0 THEN 'City ' || CAST(doc_id % 10 AS STRING) END AS city,
  CASE WHEN doc_id % 5 = 0 THEN 'IT' END AS country,
  CASE WHEN doc_id % 2 = 1 THEN 'https://apply.example.com/' || CAST(doc_id AS STRING) END AS apply_url,
  'https://jobs.example.com/' || CAST(doc_id AS STRING) AS url,
  TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 2000) * INTERVAL '1' HOUR AS posted_at
FROM {documents}
"""

APPLICATION = """
SELECT o.o_orderkey AS application_id, o.o_orderkey AS match_id, c.c_custkey AS customer_id,
  translate(substr(md5(c.c_name), 1, 8), '0123456789', 'ghijklmnop') || ' S.r.l.' AS company,
  CASE o.o_orderstatus
    WHEN 'F' THEN CASE o.o_orderkey % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'offer' WHEN 2 THEN 'withdrawn' ELSE 'interview' END
    WHEN 'O' THEN CASE o.o_orderkey % 4 WHEN 0 THEN 'submitted' WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'interview' ELSE 'submitted' END
    ELSE CASE o.o_orderkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'needs_human' ELSE 'failed' END END AS status,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'a_auto' WHEN 1 THEN 'b_assisted' ELSE 'c_manual' END AS tier,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE o.o_orderkey % 101 END AS score,
  o.o_orderdate AS submitted_at,
  CASE WHEN o.o_orderkey % 7 = 0 THEN o.o_orderdate + INTERVAL '3' DAY END AS follow_up_due_at,
  CASE WHEN o.o_orderkey % 5 = 0 THEN o.o_orderdate + INTERVAL '2' DAY END AS last_email_checked_at,
  o.o_orderdate + (o.o_orderkey % 30) * INTERVAL '1' DAY AS updated_at,
  o.o_orderpriority AS priority
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
"""

MAIL = """
SELECT event_id, user_id AS application_id, 'm' || CAST(event_id AS STRING) AS message_id, ts AS sent_at,
  CASE event_type WHEN 'signup' THEN 'ack' WHEN 'click' THEN 'interview' WHEN 'error' THEN 'rejection'
    WHEN 'purchase' THEN 'request_info' ELSE 'other' END AS classification,
  'm' || CAST(event_id - user_id AS STRING) AS reference_id,
  CASE WHEN event_type = 'view' THEN 'Newsletter <news@' || event_type || '.example>'
    ELSE 'HR <jobs@' || translate(substr(md5('Customer#' || lpad(CAST(user_id AS STRING), 9, '0')), 1, 8), '0123456789', 'ghijklmnop') || '.example>' END AS sender,
  'Re: your application ' || CAST(event_id AS STRING) AS subject
FROM {events}
"""

USAGE = """
SELECT event_id, ts AS occurred_at, event_type AS purpose,
  CASE user_id % 3 WHEN 0 THEN 'model-small' WHEN 1 THEN 'model-large' ELSE 'model-test' END AS model,
  CAST(regexp_replace(props, '[^0-9]', '') AS BIGINT) % 5 AS calls,
  CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens
FROM {events}
"""

RUN = """
SELECT event_id AS run_id, CAST(ts AS DATE) AS batch_id, 'src' || CAST(user_id % 20 AS STRING) AS source,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, ts AS started_at,
  CAST(regexp_replace(props, '[^0-9]', '') AS BIGINT) AS jobs_fetched,
  CAST(regexp_replace(props, '[^0-9]', '') AS BIGINT) % 7 AS jobs_new,
  CAST(regexp_replace(props, '[^0-9]', '') AS BIGINT) % 3 AS api_calls
FROM {events}
"""

REQUEST = """
SELECT event_id AS request_id, event_type AS request_type, props AS payload,
  CASE user_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' ELSE 'cancelled' END AS status,
  user_id % 4 AS attempts, CAST(3 AS BIGINT) AS max_attempts, ts AS created_at,
  CASE WHEN user_id % 5 > 0 THEN ts + (event_id % 90) * INTERVAL '1' MINUTE END AS claimed_at,
  CASE WHEN user_id % 5 > 1 THEN ts + (event_id % 90 + 5) * INTERVAL '1' MINUTE END AS finished_at
FROM {events}
"""

VIEWS = {
    "posting": POSTING, "listing": LISTING, "application": APPLICATION, "mail": MAIL,
    "usage": USAGE, "run": RUN, "request": REQUEST,
}


def view(tables: Tables, name: str):
    return tables.sql(VIEWS[name])


def duck(name: str) -> str:
    """The view as a DuckDB subquery body (plain table names; no global replace of digits there)."""
    text = VIEWS[name].replace("'[^0-9]', ''", "'[^0-9]', '', 'g'")
    for table in ("documents", "labels", "orders", "customer", "events"):
        text = text.replace("{" + table + "}", table)
    return text


def with_views(*names: str, body: str) -> str:
    """A DuckDB statement whose CTEs are the named views, called v_<name>."""
    ctes = ", ".join(f"v_{n} AS MATERIALIZED ({duck(n)})" for n in names)
    return f"WITH RECURSIVE {ctes} {body}" if body.lstrip().startswith(",") else f"WITH {ctes} {body}"
