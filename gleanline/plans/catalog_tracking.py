"""Queries over application tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import rubric, tracking
from . import twin
from .registry import Tables, query
from .views import view, with_views

c = F.col
NOW = "1999-02-20 12:00:00"
STAMP = "yyyy-MM-dd HH:mm:ss"


def now():
    return F.lit(NOW).cast("timestamp")


def applications(t: Tables):
    return view(t, "application").withColumn("company_normalized", text.company_key(c("company")))


def mails(t: Tables):
    """Messages with references; those of a tenth of the users lost their id."""
    rows = view(t, "mail")
    return rows.withColumns(
        {"references": F.array("reference_id"), "message_id": F.when(c("application_id") % 10 == 9, "").otherwise(c("message_id"))}
    )


def seen_events(t: Tables):
    """Timeline so far: every message of type ack was read before."""
    payload = F.to_json(F.struct("message_id"))
    return mails(t).where("classification = 'ack'").select(
        "application_id", F.lit("email_received").alias("event_type"), payload.alias("payload")
    )


_MAILS = "mails AS MATERIALIZED (SELECT * REPLACE (CASE WHEN application_id % 10 = 9 THEN '' ELSE message_id END AS message_id) FROM v_mail)"
_CONTEXT = f"""apps AS MATERIALIZED (SELECT *, {twin.company('company')} AS company_normalized FROM v_application), {_MAILS},
  ctx AS MATERIALIZED (SELECT application_id, company_normalized, CAST(coalesce(last_email_checked_at, submitted_at) AS DATE) AS since,
    list_sort(list(DISTINCT m.message_id) FILTER (m.message_id <> '')) AS known FROM apps LEFT JOIN (SELECT application_id, message_id FROM mails WHERE classification = 'ack') m USING (application_id)
    WHERE status IN ('submitted', 'acknowledged', 'interview') GROUP BY ALL)"""


def context_and_known(t: Tables):
    context = tracking.waiting_context(applications(t))
    return context, tracking.known_messages(context, seen_events(t))


@query(
    "t01_waiting_context",
    with_views("application", "mail", body=f", {_CONTEXT} SELECT application_id, strftime(since, '%Y-%m-%d') AS since, CAST(coalesce(len(known), 0) AS BIGINT) AS known_ids FROM ctx"),
)
def waiting_context(t: Tables):
    context, known = context_and_known(t)
    counts = known.groupBy("application_id").agg(F.count("*").alias("n"))
    return context.join(counts, "application_id", "left").select(
        "application_id", F.date_format("since", "yyyy-MM-dd").alias("since"), F.coalesce("n", F.lit(0)).alias("known_ids")
    )


_HAY = twin.key("sender || ' ' || subject")
_TOKEN = twin.company("company")


@query(
    "t02_looks_related",
    with_views(
        "application", "mail",
        body=f"SELECT event_id, len(list_filter(string_split({_TOKEN}, ' '), lambda w: length(w) >= 4 AND contains({_HAY}, w))) > 0 AS related "
        "FROM v_mail m JOIN v_application a USING (application_id)",
    ),
)
def looks_related(t: Tables):
    pairs = view(t, "mail").join(applications(t), "application_id")
    return pairs.select("event_id", tracking.looks_related(c("company_normalized"), c("sender"), c("subject")).alias("related"))


@query(
    "t03_thread_relation",
    with_views("application", "mail", body=f", {_CONTEXT} SELECT DISTINCT ctx.application_id, message_id FROM mails JOIN ctx ON list_contains(coalesce(known, []), reference_id)"),
)
def thread_relation(t: Tables):
    known = context_and_known(t)[1]
    return tracking.in_thread(mails(t), known).select("application_id", "message_id").distinct()


_RELATED = f"""hays AS MATERIALIZED (SELECT *, {_HAY} AS hay FROM mails),
  rel AS MATERIALIZED (SELECT DISTINCT ctx.application_id, h.message_id, h.sent_at FROM ctx JOIN hays h ON h.sent_at >= ctx.since
    AND (len(list_filter(string_split(company_normalized, ' '), lambda w: length(w) >= 4 AND contains(hay, w))) > 0 OR list_contains(coalesce(known, []), reference_id)))"""


def related(t: Tables):
    context, known = context_and_known(t)
    return known, tracking.correlate(context, known, mails(t))


@query(
    "t04_correlate",
    with_views("application", "mail", body=f", {_CONTEXT}, {_RELATED} SELECT application_id, message_id, {twin.iso('sent_at')} AS sent_at FROM rel"),
)
def correlate(t: Tables):
    return related(t)[1].withColumn("sent_at", F.date_format("sent_at", STAMP))


@query(
    "t05_unseen",
    with_views("application", "mail", body=f", {_CONTEXT}, {_RELATED} SELECT application_id, message_id, {twin.iso('sent_at')} AS sent_at FROM rel JOIN ctx USING (application_id) WHERE message_id = '' OR NOT list_contains(coalesce(known, []), message_id)"),
)
def unseen(t: Tables):
    known, found = related(t)
    return tracking.unseen(found, known).withColumn("sent_at", F.date_format("sent_at", STAMP))


def _stub_classifier(prompt: str):
    """Stands in for an external classifier."""
    kind = "interview" if "Beverbe" in prompt else "ack" if len(prompt) % 2 else "other"
    return f'{{"classification":"{kind}"}}', len(prompt) // 4, 5


@query("t06_classify")
def classify(t: Tables):
    """Replies are the conversation turns."""
    prompt = F.concat_ws("\n", F.lit("Testo:"), text.strip(c("text")))
    prompts = t.conversations.select((c("conv_id") * 1000 + c("turn")).alias("id"), prompt.alias("prompt"))
    out = rubric.assess(prompts, _stub_classifier)
    return out.select("id", F.get_json_object("answer", "$.classification").alias("classification"), "error")


_REPLY = "CASE classification WHEN 'ack' THEN 'acknowledged' WHEN 'interview' THEN 'interview' WHEN 'rejection' THEN 'rejected' END"
_RANK = "CASE {x} WHEN 'submitted' THEN 0 WHEN 'acknowledged' THEN 1 WHEN 'interview' THEN 2 WHEN 'rejected' THEN 3 WHEN 'offer' THEN 3 ELSE -1 END"
# Step-by-step fold over the messages of each application in date order.
_FOLD = f"""m AS MATERIALIZED (SELECT application_id, message_id, sent_at, {_REPLY} AS target, row_number() OVER (PARTITION BY application_id ORDER BY sent_at, message_id) AS n FROM v_mail),
  fold(application_id, n, old_status, status, sent_at, message_id) AS (SELECT application_id, CAST(0 AS BIGINT), status, status, CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR) FROM v_application
    UNION ALL SELECT f.application_id, m.n, f.status, CASE WHEN f.status NOT IN ('rejected', 'offer', 'withdrawn', 'failed') AND target IS NOT NULL
        AND {_RANK.format(x='target')} >= {_RANK.format(x='f.status')} THEN target ELSE f.status END, m.sent_at, m.message_id
      FROM fold f JOIN m ON m.application_id = f.application_id AND m.n = f.n + 1)"""


@query(
    "t07_fold_statuses",
    with_views("application", "mail", body=f", {_FOLD} SELECT application_id, arg_max(status, n) AS status FROM fold GROUP BY 1"),
)
def fold_statuses(t: Tables):
    return tracking.fold_statuses(view(t, "application").select("application_id", "status"), view(t, "mail"))


@query(
    "t08_timeline",
    with_views(
        "application", "mail",
        body=f""", {_FOLD} SELECT application_id, 'email_received' AS event_type, {twin.iso('sent_at')} AS occurred_at, message_id || '/' || classification AS detail FROM v_mail
      UNION ALL SELECT application_id, 'status_changed', '{NOW}', old_status || '/' || status FROM fold WHERE old_status <> status""",
    ),
)
def timeline(t: Tables):
    rows = tracking.timeline(view(t, "application").select("application_id", "status"), view(t, "mail"), now())
    detail = F.concat_ws("/", *[F.get_json_object("payload", f"$.{k}") for k in ("message_id", "classification", "from", "to")])
    return rows.select("application_id", "event_type", F.date_format("occurred_at", STAMP).alias("occurred_at"), detail.alias("detail"))


@query(
    "t09_advance_mark",
    with_views(
        "application", "mail",
        body=f", {_CONTEXT} SELECT a.application_id, CASE WHEN ctx.application_id IS NOT NULL THEN '{NOW}' ELSE {twin.iso('last_email_checked_at')} END AS checked_at FROM apps a LEFT JOIN ctx USING (application_id)",
    ),
)
def advance_mark(t: Tables):
    apps = applications(t)
    out = tracking.advance_mark(apps, tracking.waiting_context(apps), now())
    return out.select("application_id", F.date_format("last_email_checked_at", STAMP).alias("checked_at"))


_DUE = f"SELECT application_id, company, {twin.elapsed_days('submitted_at', f'TIMESTAMP {twin.quote(NOW)}')} AS days_silent FROM v_application WHERE status IN ('submitted', 'acknowledged', 'interview') AND follow_up_due_at IS NULL AND {twin.elapsed_days('submitted_at', f'TIMESTAMP {twin.quote(NOW)}')} >= 7"


@query("t10_follow_ups", with_views("application", body=_DUE))
def follow_ups(t: Tables):
    return tracking.follow_ups(view(t, "application"), 7, now()).select("application_id", "company", "days_silent")


@query(
    "t11_reminders",
    with_views("application", body=f"SELECT application_id, days_silent, company || ' — ' || days_silent || ' giorni' AS line FROM ({_DUE})"),
)
def reminders(t: Tables):
    return tracking.reminders(tracking.follow_ups(view(t, "application"), 7, now()))


@query(
    "t12_daily_cap",
    "SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= 50 AS allowed FROM events",
)
def daily_cap(t: Tables):
    return tracking.daily_cap(t.events.select("event_id", "ts"), 50).select("event_id", "allowed")


@query(
    "t13_first_contact",
    with_views(
        "application",
        body="SELECT application_id, count_if(status <> 'draft') OVER (PARTITION BY company) - CAST(status <> 'draft' AS INT) <= 0 AND application_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click') AS first_contact FROM v_application",
    ),
)
def first_contact(t: Tables):
    prepared = t.events.where("event_type = 'click'").select(c("user_id").alias("application_id"))
    return tracking.needs_confirmation(applications(t), prepared)


_TIER = "CASE WHEN apply_url IS NULL THEN 'c_manual' WHEN ats_type IN ('greenhouse', 'lever', 'ashby', 'workable') THEN 'a_auto' ELSE 'b_assisted' END"


@query("t14_tier", with_views("posting", body=f"SELECT id, {_TIER} AS tier FROM v_posting"))
def tier(t: Tables):
    return view(t, "posting").select("id", rules.direct_application_tier(c("apply_url"), c("ats_type")).alias("tier"))


@query(
    "t15_add_applications",
    with_views(
        "application", "posting",
        body=f"SELECT match_id, status, tier FROM v_application WHERE match_id % 2 = 0 UNION ALL SELECT id, 'draft', {_TIER} FROM v_posting "
        "WHERE id NOT IN (SELECT match_id FROM v_application WHERE match_id % 2 = 0)",
    ),
)
def add_applications(t: Tables):
    """Even applications exist already; every posting wants one."""
    existing = view(t, "application").where("match_id % 2 = 0")
    return tracking.add_applications(existing, view(t, "posting").withColumnRenamed("id", "match_id"))
