"""Queries over serving and reporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import salary
from ..functions import fixed_values as fv
from ..operators import serve
from ..session import cut_lineage
from . import twin
from .canonical import canonical, duck_canonical
from .catalog_filter import duck_judged, judged
from .registry import Tables, query
from .views import duck, view, with_views

c = F.col
STAMP = "yyyy-MM-dd HH:mm:ss"
NOW = "2024-01-30 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def links(t: Tables):
    return view(t, "posting").select("id", "source", "publisher")


REQUEST = serve.MatchFilters.parse(
    {"min": "20", "mode": "remote,hybrid,on_site,moon", "country": "it,de,ch,1", "pub": ["LinkedIn", "hireskys.com"], "sort": "salary", "per": "10", "page": "2"}
)
_LISTED = (
    "reached_stage >= 1 AND score IS NOT NULL AND is_active AND score >= 20 AND work_mode IN ('remote', 'hybrid', 'on_site') "
    "AND country IN ('IT', 'DE', 'CH') AND publisher IN ('LinkedIn', 'hireskys.com')"
)


def _listed(t: Tables):
    """The requested rows; the score is asked of the postings before anything is derived."""
    needed = ("id", "score", "title", "work_mode", "country", "status", "is_active", "reached_stage", "salary_eur_year_max")
    return serve.list_matches(canonical(t, needed, c("score") >= REQUEST.min_score), links(t), REQUEST)


@query("w01_match_list", f"WITH {duck_canonical()} SELECT id, score, title, work_mode, country FROM canon WHERE {_LISTED}")
def match_list(t: Tables):
    return _listed(t).select("id", "score", "title", "work_mode", "country")


@query(
    "w02_sort_modes",
    "WITH o AS (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END AS d FROM orders) "
    "SELECT 'recent' AS sort, o_orderkey AS id FROM (SELECT * FROM o ORDER BY d DESC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50) "
    "UNION ALL SELECT 'score', o_orderkey FROM (SELECT * FROM o ORDER BY o_totalprice DESC NULLS LAST, d DESC NULLS LAST, o_orderkey LIMIT 50)",
)
def sort_modes(t: Tables):
    rows = t.orders.select(
        c("o_orderkey").alias("id"), c("o_totalprice").alias("score"), F.when(c("o_orderkey") % 9 > 0, c("o_orderdate")).alias("posted_at")
    )
    parts = [
        rows.orderBy(*serve.MatchFilters(sort=s).order()).limit(50).select(F.lit(s).alias("sort"), "id") for s in ("recent", "score")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "w03_page",
    f"WITH {duck_canonical()}, r AS (SELECT * FROM canon WHERE {_LISTED}), s AS (SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 10.0) AS BIGINT)) AS page_count FROM r) "
    "SELECT id, total, page_count FROM (SELECT * FROM r ORDER BY salary_eur_year_max DESC NULLS LAST, score DESC NULLS LAST, id OFFSET 10 LIMIT 10) p, s",
)
def page(t: Tables):
    rows = cut_lineage(_listed(t))  # two questions about the same rows
    summary = serve.page_summary(rows, REQUEST.per_page)
    shown = serve.page_of(rows, REQUEST.order(), REQUEST.page, REQUEST.per_page)
    return shown.select("id", *[summary.select(n).scalar().alias(n) for n in ("total", "page_count")])


_DEEP = "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n, count(*) OVER () AS total FROM orders"


@query(
    "w03_deep_pages",
    f"SELECT id, CAST(n AS BIGINT) AS n, page FROM (SELECT id, n, CAST((n - 1) // 25 + 1 AS INT) AS page, CAST((total - 1) // 25 + 1 AS INT) AS last FROM ({_DEEP})) WHERE page IN (1, 100, last)",
)
def deep_pages(t: Tables):
    """The first, the hundredth and the last page of all orders, each read from its own range."""
    rows = t.orders.select(c("o_orderkey").alias("id"), "o_totalprice")
    pages = serve.Pages(rows, [F.desc("o_totalprice"), c("id")])
    wanted = sorted({1, 100, pages.last(25)})
    shown = [pages.page(p, 25).withColumn("page", F.lit(p)) for p in wanted]
    out = shown[0]
    for one in shown[1:]:
        out = out.unionByName(one)
    return out.select("id", "n", "page")


@query(
    "w04_posting_feeds",
    with_views("posting", body="SELECT match_id, array_to_string(list_sort(list(DISTINCT coalesce(nullif(trim(publisher), ''), source))), ',') AS sources "
    "FROM (SELECT id % 200 AS match_id, * FROM v_posting) GROUP BY 1"),
)
def posting_feeds(t: Tables):
    feeds = serve.posting_feeds(links(t).withColumn("id", c("id") % 200))
    return feeds.select(c("id").alias("match_id"), F.array_join("sources", ",").alias("sources"))


@query(
    "w05_match_detail",
    f"WITH {duck_canonical()} SELECT c.id, title, score, work_mode, coalesce(nullif(trim(publisher), ''), source) AS sources, quality AS must_have FROM canon c WHERE c.id = 0",
)
def match_detail(t: Tables):
    rows = canonical(t, ("id", "title", "score", "work_mode"), c("id") == 0)
    requirements = t.labels.select(c("doc_id").alias("id"), c("quality").alias("must_have"))
    out = serve.match_detail(rows, requirements, links(t), 0)
    return out.withColumn("sources", F.array_join("sources", ","))


@query(
    "w06_filter_menus",
    f"""WITH {duck_canonical()} SELECT 'country' AS menu, country AS value, count(*) AS n FROM canon WHERE country IS NOT NULL AND score IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'feed', source, count(*) FROM canon GROUP BY 2
      UNION ALL SELECT * FROM (SELECT 'publisher', publisher, count(*) AS n FROM canon WHERE publisher IS NOT NULL GROUP BY 2 HAVING count(*) >= 3 ORDER BY n DESC, publisher LIMIT 12)""",
)
def filter_menus(t: Tables):
    return serve.filter_menus(canonical(t, ("country", "score")), links(t))


@query(
    "w07_counters",
    f"WITH {duck_canonical()} SELECT count_if(status = 'new') AS new, count_if(status = 'shortlist') AS shortlist, count_if(status = 'applied') AS applied, count(*) AS total FROM canon WHERE reached_stage >= 1 AND score IS NOT NULL",
)
def counters(t: Tables):
    return serve.counters(canonical(t, ("status", "score", "reached_stage")))


@query(
    "w08_set_status",
    "SELECT o_orderkey, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN 'hidden' END, o_orderstatus) AS status FROM orders LEFT JOIN labels l ON l.doc_id = o_orderkey",
)
def set_status(t: Tables):
    rows = t.orders.select("o_orderkey", c("o_orderstatus").alias("status"))
    changes = t.labels.select(c("doc_id").alias("o_orderkey"), F.lit("hidden").alias("new_status"))
    return serve.set_status(rows, changes, "o_orderkey")


@query(
    "w09_flat_list",
    with_views("posting", body="SELECT id, title, score, status FROM v_posting WHERE score >= 30 AND status = 'shortlist' ORDER BY score DESC, id LIMIT 20"),
)
def flat_list(t: Tables):
    return serve.flat_list(view(t, "posting").select("id", "title", "score", "status"), 30, "shortlist")


@query(
    "w11_tracked_applications",
    with_views("application", body=f"SELECT application_id, company, status, {twin.iso('updated_at')} AS updated_at FROM v_application WHERE status IN {twin.in_list(fv.TRACKED_STATUSES)} ORDER BY v_application.updated_at DESC, application_id OFFSET 15 LIMIT 15"),
)
def tracked_applications(t: Tables):
    out = serve.tracked_applications(view(t, "application"), 2)
    return out.select("application_id", "company", "status", F.date_format("updated_at", STAMP).alias("updated_at"))


_ACTION = "CASE application_id % 4 WHEN 0 THEN 'set' WHEN 1 THEN 'submit' WHEN 2 THEN 'approve' END"
_NEW = "CASE application_id % 3 WHEN 0 THEN 'withdrawn' WHEN 1 THEN 'interview' ELSE 'draft' END"
_CHANGED = f"""(SELECT *, CASE WHEN action = 'set' AND wanted IN {twin.in_list(fv.TRACKED_STATUSES)} THEN wanted WHEN action = 'submit' AND status = 'needs_human' THEN 'submitted' WHEN action = 'approve' THEN 'approved' END AS target
  FROM (SELECT *, {_ACTION} AS action, {_NEW} AS wanted FROM v_application))"""


@query(
    "w12_manual_changes",
    with_views(
        "application",
        body=f"SELECT application_id, coalesce(target, status) AS status, CASE WHEN target IS NOT NULL THEN '{NOW}' ELSE {twin.iso('updated_at')} END AS updated_at, "
        f"CASE WHEN action <> 'approve' AND target <> status THEN CASE WHEN action = 'submit' THEN 'submitted' ELSE 'status_changed' END END AS event FROM {_CHANGED}",
    ),
)
def manual_changes(t: Tables):
    apps = view(t, "application")
    changes = apps.select("application_id", F.expr(_ACTION).alias("action"), F.expr(_NEW).alias("new_status"))
    snapshot, events = serve.change_applications(apps, changes.where("action IS NOT NULL"), now())
    named = events.select("application_id", c("event_type").alias("event"))
    return snapshot.join(named, "application_id", "left").select(
        "application_id", "status", F.date_format("updated_at", STAMP).alias("updated_at"), "event"
    )


_LINK = "SELECT l_orderkey AS match_id, 'src' || CAST(l_suppkey % 6 AS STRING) AS source, CASE WHEN l_linenumber = 2 THEN 'LinkedIn' END AS publisher, l_shipdate AS fetched_at FROM {lineitem}"


@query(
    "w13_response_rates",
    with_views(
        "application",
        body=f""", lk AS ({_LINK.replace('{lineitem}', 'lineitem')}), ff AS (SELECT match_id, arg_min(coalesce(publisher, source), (fetched_at, source)) AS feed FROM lk GROUP BY 1),
      r AS MATERIALIZED (SELECT a.*, feed FROM v_application a LEFT JOIN ff USING (match_id) WHERE status IN {twin.in_list(fv.MEASURED_STATUSES)}),
      x AS (SELECT 'feed' AS dimension, coalesce(feed, 'n.d.') AS label, status FROM r UNION ALL SELECT 'band', {twin.band('score')}, status FROM r UNION ALL SELECT 'tier', tier, status FROM r)
      SELECT dimension, label, count(*) AS total, count_if(status IN {twin.in_list(fv.REPLIED_STATUSES)}) AS replied,
        CAST(floor(count_if(status IN {twin.in_list(fv.REPLIED_STATUSES)}) / count(*) * 100 + 0.5) AS BIGINT) AS rate FROM x GROUP BY 1, 2""",
    ),
)
def response_rates(t: Tables):
    """Links of one time and source count in the order of the table, as `arg_min` of the SQL reads them in one thread."""
    links = Tables(t.spark, t.folder)
    links.lineitem = t.lineitem.select("*", c("_metadata.file_path").alias("l_file"), c("_metadata.row_index").alias("l_row"))
    rows = links.sql(_LINK.replace(" FROM", ", l_file, l_row FROM"))
    return serve.response_rates(view(t, "application"), rows, ("l_file", "l_row"))


@query(
    "w14_run_history",
    with_views(
        "run",
        body="SELECT run_id, strftime(batch_id, '%Y-%m-%d') AS batch, source, status, 'Feed ' || source AS display_name FROM v_run "
        "JOIN (SELECT batch_id FROM v_run GROUP BY 1 ORDER BY max(started_at) DESC, batch_id OFFSET 15 LIMIT 15) USING (batch_id)",
    ),
)
def run_history(t: Tables):
    runs = view(t, "run")
    sources = runs.select("source").distinct().withColumn("display_name", F.concat(F.lit("Feed "), "source"))
    out = serve.run_history(runs, sources, 2)
    return out.select("run_id", F.date_format("batch_id", "yyyy-MM-dd").alias("batch"), "source", "status", "display_name")


_SINCE = "2024-01-10 00:00:00"
_USAGE = f"SELECT purpose, model, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(DISTINCT CAST(occurred_at AS DATE)) AS active_days FROM v_usage WHERE occurred_at >= TIMESTAMP '{_SINCE}' GROUP BY 1, 2"


def summary(t: Tables):
    return serve.usage_summary(view(t, "usage"), F.lit(_SINCE).cast("timestamp"))


@query("w15_usage_summary", with_views("usage", body=_USAGE))
def usage_summary(t: Tables):
    return summary(t)


# The price setting, once per region: every row holds the same object, as a settings snapshot would.
_PRICES = '{"model-small":{"input_per_million":0.25,"output_per_million":1.5,"currency":"EUR"},"model-large":{"input_per_million":"3","output_per_million":15},"model-bad":{"input_per_million":"x"},"note":"hand-made"}'


def prices(t: Tables):
    return serve.price_table(t.region.select(F.lit(_PRICES).alias("value"))).distinct()


_DUCK_PRICES = "p(model, inp, outp, currency) AS (VALUES ('model-small', 0.25, 1.5, 'EUR'), ('model-large', 3.0, 15.0, 'USD'))"
_DUCK_COSTS = f", u AS ({_USAGE}), {_DUCK_PRICES}, k AS (SELECT purpose, model, input_tokens / 1e6 * CAST(inp AS DOUBLE) + output_tokens / 1e6 * CAST(outp AS DOUBLE) AS cost, currency FROM u LEFT JOIN p USING (model))"


@query(
    "w16_costs",
    with_views("usage", body=f"{_DUCK_COSTS} SELECT purpose, model, round(cost, 6) AS cost, currency FROM k UNION ALL SELECT 'total', NULL, round(sum(cost), 6), currency FROM k GROUP BY currency"),
)
def costs(t: Tables):
    rows = serve.usage_costs(summary(t), prices(t))
    totals = serve.cost_totals(rows).select(F.lit("total").alias("purpose"), F.lit(None).cast("string").alias("model"), c("total").alias("cost"), "currency")
    return rows.unionByName(totals).withColumn("cost", F.round("cost", 6))


@query(
    "w17_price_table",
    "SELECT 'm' || p_partkey AS model, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END AS input_per_million, p_size * 2.0 AS output_per_million, "
    "CASE WHEN p_size % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM part WHERE p_partkey % 7 > 0",
)
def price_table(t: Tables):
    """One settings object per part; every seventh price is malformed."""
    part = t.part.withColumn("rate", F.when(c("p_partkey") % 3 == 0, F.concat(F.lit('"'), c("p_size").cast("string"), F.lit('"'))).otherwise(c("p_retailprice").cast("string")))
    bad = c("p_partkey") % 7 == 0
    value = F.concat(
        F.lit('{"m'), c("p_partkey").cast("string"), F.lit('":{"input_per_million":'), F.when(bad, '"x"').otherwise(c("rate")),
        F.lit(',"output_per_million":'), (c("p_size") * 2).cast("string"), F.when(c("p_size") % 2 == 0, ',"currency":"EUR"').otherwise(""), F.lit('},"note":"by hand"}'),
    )
    return serve.price_table(part.select(value.alias("value")))


@query("w18_usage_to_write", with_views("usage", body="SELECT event_id, purpose, model, calls FROM v_usage WHERE calls > 0"))
def usage_to_write(t: Tables):
    return serve.usage_to_write(view(t, "usage")).select("event_id", "purpose", "model", "calls")


@query(
    "w19_run_summary",
    f"WITH {duck_judged()}, v_run AS ({duck('run')}) "
    "SELECT count(DISTINCT source) AS feeds, array_to_string(list_sort(list(DISTINCT source) FILTER (status = 'failed')), ',') AS failed_feeds, CAST(sum(jobs_fetched) AS BIGINT) AS fetched, CAST(sum(jobs_new) AS BIGINT) AS new, CAST(sum(jobs_fetched - jobs_new) AS BIGINT) AS updated, "
    f"(SELECT CAST(sum(input_tokens + output_tokens) AS BIGINT) FROM ({duck('usage')})) AS tokens, "
    "(SELECT count(*) FROM judged WHERE kind IS NULL) AS examined, (SELECT count(score) FROM judged WHERE kind IS NULL) AS scored, (SELECT count(*) FROM judged WHERE kind IS NULL AND score >= 60) AS above_threshold FROM v_run",
)
def run_summary(t: Tables):
    passed = judged(t).where("rejected IS NULL")
    return serve.run_summary(view(t, "run"), passed, view(t, "usage"), 60)


@query(
    "w20_new_requests",
    with_views("request", body="SELECT request_id FROM v_request w WHERE NOT EXISTS (SELECT 1 FROM v_request o WHERE o.status IN ('pending', 'running') AND o.request_type = w.request_type AND o.payload = w.payload AND o.request_id % 3 = 0) AND w.request_id % 3 > 0"),
)
def new_requests(t: Tables):
    """Every third logged request is the log, the others ask again with reordered JSON."""
    rows = view(t, "request")
    wanted = rows.where("request_id % 3 > 0").withColumn("payload", F.regexp_replace("payload", ": ", ":"))
    return serve.new_requests(wanted, rows.where("request_id % 3 = 0")).select("request_id")


@query(
    "w21_stale_requests",
    with_views("request", body=f"SELECT request_id, CASE WHEN attempts < max_attempts THEN 'pending' ELSE 'failed' END AS next_status FROM v_request WHERE status = 'running' AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(claimed_at) > 3600000000"),
)
def stale_requests(t: Tables):
    return serve.stale_requests(view(t, "request"), now()).select("request_id", "next_status")


@query(
    "w22_latest_requests",
    with_views(
        "request",
        body=f""", a AS (SELECT *, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(finished_at)) / 60000000.0 AS age FROM v_request),
      n AS (SELECT * FROM a WHERE status IN ('pending', 'running') OR age < 1440 QUALIFY row_number() OVER (PARTITION BY request_type, payload ORDER BY created_at DESC, request_id DESC) = 1)
      SELECT request_type, request_id, status FROM n WHERE CASE WHEN status IN ('done', 'cancelled') THEN age <= 30 WHEN status = 'failed' THEN age <= 1440 ELSE true END""",
    ),
)
def latest_requests(t: Tables):
    return serve.latest_requests(view(t, "request"), now()).select("request_type", "request_id", "status")


@query(
    "w23_liveness",
    f"""WITH s AS (SELECT user_id AS worker, CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) / 60000000.0) AS BIGINT) AS minutes FROM events GROUP BY 1)
      SELECT worker, minutes, minutes < 2 AS online, CASE WHEN minutes < 1 THEN 'adesso' WHEN minutes < 60 THEN minutes || ' min fa' WHEN minutes < 1440 THEN minutes // 60 || ' h fa'
        WHEN minutes < 2880 THEN 'ieri' ELSE minutes // 1440 || ' g fa' END AS ago FROM s""",
)
def liveness(t: Tables):
    beats = t.events.select(c("user_id").alias("worker"), c("ts").alias("seen_at"))
    return serve.liveness(beats, F.lit("2024-01-31 00:00:00").cast("timestamp"))


_PAID = """
SELECT p_partkey AS id, CASE WHEN p_size % 5 > 0 THEN CAST(floor(p_retailprice * 31) AS BIGINT) END AS lo,
  CASE WHEN p_size % 3 > 0 THEN CAST(floor(p_retailprice * 31) AS BIGINT) + (p_size % 2) * 1000 END AS hi,
  CASE p_partkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'SEK' WHEN 3 THEN NULL ELSE 'PLN' END AS currency,
  CASE p_partkey % 4 WHEN 0 THEN 'hourly' WHEN 1 THEN 'monthly' WHEN 2 THEN NULL ELSE 'yearly' END AS period, p_partkey % 7 > 0 AS stated
FROM {part}
"""
_NUM = "replace(printf('%,d', {x}), ',', '.')"


@query(
    "w24_salary_label",
    f"""SELECT id, CASE WHEN NOT stated THEN 'n.d.' WHEN lo <> 0 AND hi <> 0 AND lo <> hi THEN {_NUM.format(x='lo')} || '–' || {_NUM.format(x='hi')} || unit
      WHEN coalesce(lo, hi) <> 0 THEN {_NUM.format(x='coalesce(lo, hi)')} || unit ELSE 'n.d.' END AS label
    FROM (SELECT *, ' ' || coalesce({twin.case_map(fv.DISPLAY_SYMBOLS, 'currency')}, currency, '') || coalesce({twin.case_map(fv.DISPLAY_PERIODS, "coalesce(period, 'yearly')")}, '') AS unit FROM ({_PAID.replace('{part}', 'part')}))""",
)
def salary_label(t: Tables):
    pay = F.struct(c("stated").alias("is_stated"), c("lo").alias("min"), c("hi").alias("max"), "currency", "period")
    return t.sql(_PAID).select("id", pay.alias("pay")).select("id", salary.label(c("pay")).alias("label"))
