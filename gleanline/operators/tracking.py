"""Application tracking: correlate messages, fold statuses, follow up, guard and route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import fixed_values as fv
from ..functions.rules import direct_application_tier
from ..functions.text import comparison_key, lookup

_GRAM = 4


def waiting_context(applications: DataFrame) -> DataFrame:
    """Waiting applications with the day to search from: the last check, else the submission."""
    since = F.to_date(F.coalesce("last_email_checked_at", "submitted_at"))
    waiting = applications.where(F.col("status").isin(fv.WAITING_STATUSES))
    return waiting.withColumn("since", since).where("since IS NOT NULL")


def known_messages(context: DataFrame, events: DataFrame) -> DataFrame:
    """(application_id, message_id) read before, for waiting applications.

    Rows and not a list per application: a busy application stays spread over tasks. `events` has
    application_id, event_type and payload (JSON).
    """
    message_id = F.nullif(F.get_json_object("payload", "$.message_id"), F.lit(""))
    seen = events.where("event_type = 'email_received'").select("application_id", message_id.alias("message_id"))
    return seen.where("message_id IS NOT NULL").join(context.select("application_id").hint("merge"), "application_id", "left_semi").distinct()


def in_thread(messages: DataFrame, known: DataFrame) -> DataFrame:
    """(application_id, message_id) pairs where the message refers to a known one of the application."""
    refers = messages.select("message_id", "sent_at", F.explode("references").alias("known_id"))
    return known.select("application_id", F.col("message_id").alias("known_id")).join(refers.hint("merge"), "known_id").drop("known_id").distinct()


def name_tokens(company_normalized: Column) -> Column:
    """Words of the name long enough to be telling."""
    return F.filter(F.split(company_normalized, " "), lambda w: F.length(w) >= _GRAM)


def haystack(sender: Column, subject: Column) -> Column:
    return comparison_key(F.concat_ws(" ", sender, subject))


def looks_related(company_normalized: Column, sender: Column, subject: Column) -> Column:
    """A telling word of the company name is inside sender or subject."""
    hay = haystack(sender, subject)
    return F.exists(name_tokens(company_normalized), lambda token: F.contains(hay, token))


def _grams(text: Column) -> Column:
    length = F.length(text)
    starts = F.when(length >= _GRAM, F.sequence(F.lit(1), F.greatest(length - _GRAM + 1, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(_GRAM))))


def name_hits(applications: DataFrame, words: DataFrame) -> DataFrame:
    """(token, word): every telling name word inside every word of the message headings, as an equi-join.

    `words` has the column word. Neither side has blanks, so a name word is inside a heading if it is inside one of the
    heading's words. Distinct words meet on one four-letter piece of the name word, the piece that occurs in the fewest
    words; only real substrings survive. Pieces are many times their words, which the planner does not know: these
    joins sort, so that none of them passes through the driver.
    """
    tokens = applications.select(F.explode(name_tokens(F.col("company_normalized"))).alias("token")).distinct()
    pieces = words.select("word").distinct().select("word", F.explode(_grams(F.col("word"))).alias("gram"))
    frequency = pieces.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (
        tokens.select("token", F.explode(_grams(F.col("token"))).alias("gram"))
        .join(frequency.hint("merge"), "gram", "left")
        .groupBy("token")
        .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    )
    return rarest.join(pieces.hint("merge"), "gram").where(F.contains("word", "token")).select("token", "word")


def correlate(context: DataFrame, known: DataFrame, messages: DataFrame) -> DataFrame:
    """(application_id, message_id, sent_at): messages of an application by name or by thread.

    `messages` has message_id, sender, subject, sent_at, references (array of ids). Each
    application applies its own date floor.
    """
    app = context.select("application_id", "company_normalized", "since")
    hay = F.array_distinct(F.split(haystack(F.col("sender"), F.col("subject")), " "))
    keyed = messages.select("message_id", "sent_at", F.explode(hay).alias("word")).where(F.length("word") >= _GRAM)
    by_name = (
        app.select("application_id", "since", F.explode(name_tokens(F.col("company_normalized"))).alias("token"))
        .join(name_hits(app, keyed).hint("merge"), "token")
        .join(keyed.hint("merge"), "word")
    )
    by_thread = in_thread(messages, known).join(app.select("application_id", "since").hint("merge"), "application_id")
    wanted = ["application_id", "message_id", "sent_at", "since"]
    found = by_name.select(*wanted).unionByName(by_thread.select(*wanted))
    return found.where(F.col("sent_at") >= F.col("since").cast("timestamp")).drop("since").distinct()


def unseen(related: DataFrame, known: DataFrame) -> DataFrame:
    """Messages not read before for their application; a message without id is always new."""
    anonymous = related.where(F.coalesce(F.col("message_id"), F.lit("")) == "")
    named = related.where("message_id <> ''").join(known.hint("merge"), ["application_id", "message_id"], "left_anti")
    return named.unionByName(anonymous)


# --- status ------------------------------------------------------------------------------------


def next_status(current: Column, classification: Column) -> Column:
    """One step: terminal states stay, a reply never moves a status back."""
    target = lookup(fv.REPLY_STATUS, classification)
    rank = lambda s: F.coalesce(lookup(fv.STATUS_RANK, s), F.lit(-1))
    moves = ~current.isin(fv.TERMINAL_STATUSES) & target.isNotNull() & (rank(target) >= rank(current))
    return F.when(moves, target).otherwise(current)


def status_changes(applications: DataFrame, messages: DataFrame) -> DataFrame:
    """(application_id, occurred_at, message_id, from_status, to_status): one row per real change.

    Input: applications(application_id, status), messages(application_id, message_id, sent_at,
    classification). Statuses only climb and a rejection ends the climb, so the whole fold in date
    order is decided by the first message of each of three classes: three small aggregates per
    application instead of a sorted list of all its messages.
    """
    moment = F.struct("sent_at", "message_id")

    def first(classification: str) -> Column:
        return F.min(F.when(F.col("classification") == classification, moment))

    firsts = messages.groupBy("application_id").agg(
        first("ack").alias("acknowledged"), first("interview").alias("interview"), first("rejection").alias("rejected")
    )
    rows = applications.where(~F.col("status").isin(fv.TERMINAL_STATUSES)).join(firsts, "application_id")
    rank = F.coalesce(lookup(fv.STATUS_RANK, F.col("status")), F.lit(-1))
    ack, talk, no = F.col("acknowledged"), F.col("interview"), F.col("rejected")

    def before(moment_: Column, *others: Column) -> Column:
        test = moment_.isNotNull()
        for other in others:
            test = test & (other.isNull() | (moment_ < other))
        return test

    ack_moves = (rank < 1) & before(ack, talk, no)
    talk_moves = (rank < 2) & before(talk, no)
    after_ack = F.when(ack_moves, "acknowledged").otherwise(F.col("status"))
    changes = F.array(
        F.when(ack_moves, F.struct(ack.alias("at"), F.col("status").alias("from_status"), F.lit("acknowledged").alias("to_status"))),
        F.when(talk_moves, F.struct(talk.alias("at"), after_ack.alias("from_status"), F.lit("interview").alias("to_status"))),
        F.when(
            no.isNotNull(),
            F.struct(
                no.alias("at"),
                F.when(talk_moves, "interview")
                .otherwise(after_ack)
                .alias("from_status"),
                F.lit("rejected").alias("to_status"),
            ),
        ),
    )
    return rows.select("application_id", F.explode(F.array_compact(changes)).alias("c")).select(
        "application_id",
        F.col("c.at.sent_at").alias("occurred_at"),
        F.col("c.at.message_id").alias("message_id"),
        "c.from_status",
        "c.to_status",
    )


def fold_statuses(applications: DataFrame, messages: DataFrame) -> DataFrame:
    """(application_id, status) after all messages."""
    changes = status_changes(applications, messages)
    rank = lookup(fv.STATUS_RANK, F.col("to_status"))
    last = changes.groupBy("application_id").agg(F.max_by("to_status", rank).alias("final"))
    return applications.join(last, "application_id", "left").select(
        "application_id", F.coalesce("final", "status").alias("status")
    )


def timeline(applications: DataFrame, messages: DataFrame, now: Column) -> DataFrame:
    """Events to append: one per message, one per status change."""
    received = messages.select(
        "application_id",
        F.lit("email_received").alias("event_type"),
        F.col("sent_at").alias("occurred_at"),
        F.to_json(F.struct("message_id", "classification")).alias("payload"),
    )
    changed = status_changes(applications, messages).select(
        "application_id",
        F.lit("status_changed").alias("event_type"),
        now.alias("occurred_at"),
        F.to_json(F.struct(F.col("from_status").alias("from"), F.col("to_status").alias("to"))).alias("payload"),
    )
    return received.unionByName(changed)


def advance_mark(applications: DataFrame, checked: DataFrame, now: Column) -> DataFrame:
    """Every checked application remembers the check, with or without new messages."""
    seen = checked.select("application_id").distinct().withColumn("_checked", F.lit(True))
    mark = F.when(F.col("_checked"), now).otherwise(F.col("last_email_checked_at"))
    return applications.join(seen, "application_id", "left").withColumn("last_email_checked_at", mark).drop("_checked")


# --- follow-up ---------------------------------------------------------------------------------


def follow_ups(applications: DataFrame, silent_days: int, now: Column) -> DataFrame:
    """Waiting applications, not flagged yet, silent for at least `silent_days`."""
    days = dates.elapsed_days(F.col("submitted_at"), now)
    waiting = F.col("status").isin(fv.WAITING_STATUSES) & F.col("follow_up_due_at").isNull()
    return applications.where(waiting).withColumn("days_silent", days).where(F.col("days_silent") >= silent_days)


def reminders(due: DataFrame) -> DataFrame:
    """One line per due application, longest silence first."""
    line = F.concat_ws(" — ", "company", F.concat(F.col("days_silent").cast("string"), F.lit(" giorni")))
    return due.select("application_id", "days_silent", line.alias("line")).orderBy(F.desc("days_silent"), "application_id")


# --- guards ------------------------------------------------------------------------------------


def daily_cap(events: DataFrame, cap: int) -> DataFrame:
    """Add `allowed`: fewer than `cap` events came earlier on the same UTC day.

    Needs event_id and ts. Only the first `cap` events of a day are ranked (Spark keeps no more per
    task); the last of them is the day's cut-off, compared with all events.
    """
    day = F.to_date("ts")
    order = Window.partitionBy("day").orderBy("ts", "event_id")
    first = events.select(day.alias("day"), "ts", "event_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap)
    cut = first.groupBy("day").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    return events.withColumn("day", day).join(cut, "day").withColumn(
        "allowed", F.struct("ts", "event_id") <= F.col("last")
    ).drop("last")


def needs_confirmation(applications: DataFrame, prepared: DataFrame) -> DataFrame:
    """(application_id, first_contact): no other non-draft application to the company, never prepared."""
    tried = applications.groupBy("company_normalized").agg(F.count_if(F.col("status") != "draft").alias("tried"))
    done = prepared.select("application_id").distinct().withColumn("prepared", F.lit(True))
    own = (F.col("status") != "draft").cast("int")
    return (
        applications.join(tried, "company_normalized")
        .join(done, "application_id", "left")
        .select("application_id", ((F.col("tried") - own <= 0) & F.col("prepared").isNull()).alias("first_contact"))
    )


def add_applications(applications: DataFrame, wanted: DataFrame) -> DataFrame:
    """Existing rows plus one draft per wanted match that has none. `wanted`: match_id, apply_url, ats_type."""
    fresh = wanted.dropDuplicates(["match_id"]).join(applications.select("match_id"), "match_id", "left_anti")
    drafts = fresh.select(
        "match_id",
        F.lit("draft").alias("status"),
        direct_application_tier(F.col("apply_url"), F.col("ats_type")).alias("tier"),
    )
    return applications.select("match_id", "status", "tier").unionByName(drafts)
