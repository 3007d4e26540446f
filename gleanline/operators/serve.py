"""Serving and reporting: lists, pages, counters, histories, costs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import fixed_values as fv
from ..functions.text import score_band, strip
from ..session import shared_folder


def _number(low: int, high: int, default: int):
    """Reader of one whole number, moved into its range."""

    def read(values: list[str]) -> int:
        text = values[0].strip() if values else ""
        return min(high, max(low, int(text))) if re.fullmatch(r"-?\d+", text) else default

    return read


def _flag(values: list[str]) -> bool:
    return values[:1] == ["1"]


def _several(valid, change=str.strip):
    """Reader of a list that keeps its valid entries; a list beyond the limit is refused, not shortened."""

    def read(values: list[str]) -> tuple[str, ...]:
        entries = [change(v) for value in values for v in value.split(",")]
        kept = tuple(v for v in entries if valid(v))
        if len(kept) > fv.MAX_LISTED:
            raise ValueError(f"more than {fv.MAX_LISTED} values in one filter")
        return kept

    return read


#: Request parameter and reader of each filter.
_REQUEST = {
    "min_score": ("min", _number(*fv.SCORE_RANGE, fv.SCORE_RANGE[0])),
    "work_modes": ("mode", _several(lambda v: v in fv.WORK_MODES)),
    "countries": ("country", _several(lambda v: re.fullmatch(fv.COUNTRY_CODE_PATTERN, v), str.upper)),
    "sources": ("source", _several(lambda v: re.fullmatch(fv.FEED_CODE_PATTERN, v))),
    "publishers": ("pub", _several(lambda v: 0 < len(v) <= fv.MAX_PUBLISHER_CHARS)),
    "only_new": ("new", _flag),
    "hide_seen": ("unseen", _flag),
    "only_shortlist": ("shortlist", _flag),
    "sort": ("sort", lambda values: next((v for v in values[:1] if v in fv.LIST_ORDERS), fv.LIST_ORDERS[0])),
    "page": ("page", _number(1, 1 << 31, 1)),
    "per_page": ("per", _number(*fv.PAGE_SIZE_RANGE, fv.PAGE_SIZE)),
}


@dataclass(frozen=True)
class MatchFilters:
    """Validated list request that compiles to columns."""

    min_score: int = 0
    work_modes: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    publishers: tuple[str, ...] = ()
    only_new: bool = False
    hide_seen: bool = False
    only_shortlist: bool = False
    sort: str = "score"
    page: int = 1
    per_page: int = 25

    @classmethod
    def parse(cls, params: dict[str, str | list[str]]) -> MatchFilters:
        """Read request parameters; anything malformed falls back or is dropped, too long a list is an error."""
        given = {k: v if isinstance(v, list) else [v] for k, v in params.items() if v is not None}
        return cls(**{field: read(given.get(name, [])) for field, (name, read) in _REQUEST.items()})

    def condition(self) -> Column:
        """Plain predicates over stored columns, so that they reach the file scan."""
        test = (F.col("reached_stage") >= 1) & F.col("score").isNotNull() & F.col("is_active")
        if self.min_score > 0:
            test = test & (F.col("score") >= self.min_score)
        if self.work_modes:
            test = test & F.col("work_mode").isin(list(self.work_modes))
        if self.countries:
            test = test & F.col("country").isin(list(self.countries))
        if self.only_new:
            test = test & (F.col("status") == "new")
        if self.only_shortlist:
            test = test & (F.col("status") == "shortlist")
        if self.hide_seen:
            test = test & F.col("status").isin("new", "shortlist", "applied")
        return test

    def order(self) -> list[Column]:
        score, posted = F.col("score").desc_nulls_last(), F.col("posted_at").desc_nulls_last()
        by = {
            "recent": [posted, score],
            "salary": [F.col("salary_eur_year_max").desc_nulls_last(), score],
        }.get(self.sort, [score, posted])
        return [*by, F.col("id")]


def list_matches(matches: DataFrame, links: DataFrame, request: MatchFilters) -> DataFrame:
    """Rows of the match list. `matches` is match joined to posting; `links` has id, source, publisher."""
    rows = matches.where(request.condition())
    if request.sources:
        rows = rows.join(links.where(F.col("source").isin(list(request.sources))).select("id"), "id", "left_semi")
    if request.publishers:
        rows = rows.join(links.where(F.col("publisher").isin(list(request.publishers))).select("id"), "id", "left_semi")
    return rows


def page_of(rows: DataFrame, order: list[Column], page: int, per_page: int) -> DataFrame:
    """One page; a sort with a limit keeps `page * per_page` rows per task, not a global sort."""
    return rows.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


class Pages:
    """Rows in the order of a list, stored in ranges, so that a page reads the ranges it lies in and no others.

    The rows are dealt by range over `order`, which has to be total, and written with a folder per range. The number of
    rows of each range (RANGES at most) is kept; page p is found by its position among them.
    """

    RANGES = 200

    def __init__(self, rows: DataFrame, order: list[Column], path: str | None = None, ranges: int | None = None):
        self.spark, self.order, self.path = rows.sparkSession, order, path or shared_folder(rows.sparkSession)
        self.schema = rows.schema
        dealt = rows.repartitionByRange(ranges or self.RANGES, *order).withColumn("range", F.spark_partition_id())
        dealt.write.partitionBy("range").parquet(self.path)
        counted = self._read().groupBy("range").count().orderBy("range").collect()
        self.starts, self.total = {}, 0
        for r in counted:
            self.starts[r["range"]] = self.total
            self.total += r["count"]

    def _read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema.toDDL()}, `range` INT").parquet(self.path)

    def last(self, per_page: int) -> int:
        return max(1, -(-self.total // per_page))

    def around(self, page: int, per_page: int) -> tuple[DataFrame, int]:
        """The rows of the ranges that a page lies in, and how many rows come before them."""
        first, after = (page - 1) * per_page, page * per_page
        ends = [*self.starts.values(), self.total][1:]
        hit = [r for (r, start), end in zip(self.starts.items(), ends, strict=True) if start < after and end > first]
        return self._read().where(F.col("`range`").isin(hit)).drop("range"), self.starts[hit[0]] if hit else 0

    def page(self, page: int, per_page: int) -> DataFrame:
        """The rows of a page with their place `n` in the whole list; none beyond the last page."""
        rows, before = self.around(page, per_page)
        skipped = (page - 1) * per_page - before
        shown = rows.orderBy(*self.order).offset(skipped).limit(per_page)
        place = F.row_number().over(Window.orderBy(*self.order))  # of a page's rows
        return shown.withColumn("n", (place + before + skipped).cast("long"))


def page_summary(rows: DataFrame, per_page: int) -> DataFrame:
    total = F.count("*")
    return rows.agg(total.alias("total"), F.greatest(F.lit(1), F.ceil(total / per_page)).alias("page_count"))


def feed_name() -> Column:
    """The publisher when there is one, else the feed."""
    return F.coalesce(F.nullif(strip(F.col("publisher")), F.lit("")), F.col("source"))


def posting_feeds(links: DataFrame) -> DataFrame:
    """(id, sources): distinct feed names of a posting, aggregated before any join."""
    return links.groupBy("id").agg(F.array_sort(F.collect_set(feed_name())).alias("sources"))


def match_detail(matches: DataFrame, requirements: DataFrame, links: DataFrame, match_id: int) -> DataFrame:
    """One match with its posting, requirements and feeds; the point filter reaches every scan."""
    one = F.col("id") == match_id
    return (
        matches.where(one)
        .join(requirements.where(one), "id", "left")
        .join(posting_feeds(links.where(one)), "id", "left")
    )


def filter_menus(matches: DataFrame, links: DataFrame, most: int = fv.MENU_PUBLISHERS) -> DataFrame:
    """(menu, value, n): countries of scored postings, feeds in use, the `most` main publishers."""
    countries = matches.where("country IS NOT NULL AND score IS NOT NULL").groupBy(F.col("country").alias("value")).agg(F.count("*").alias("n"))
    feeds = links.groupBy(F.col("source").alias("value")).agg(F.count("*").alias("n"))
    publishers = (
        links.where("publisher IS NOT NULL")
        .groupBy(F.col("publisher").alias("value"))
        .agg(F.count("*").alias("n"))
        .where("n >= 3")
        .orderBy(F.desc("n"), "value")
        .limit(most)
    )
    labelled = [df.select(F.lit(menu).alias("menu"), "value", "n") for menu, df in (("country", countries), ("feed", feeds), ("publisher", publishers))]
    return labelled[0].unionByName(labelled[1]).unionByName(labelled[2])


def counters(matches: DataFrame) -> DataFrame:
    shown = matches.where("reached_stage >= 1 AND score IS NOT NULL")
    return shown.agg(
        F.count_if(F.col("status") == "new").alias("new"),
        F.count_if(F.col("status") == "shortlist").alias("shortlist"),
        F.count_if(F.col("status") == "applied").alias("applied"),
        F.count("*").alias("total"),
    )


def set_status(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Snapshot with the statuses of `changes` (key, new_status) applied."""
    return rows.join(changes, key, "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def flat_list(matches: DataFrame, threshold: int, status: str | None = None, limit: int = 20) -> DataFrame:
    rows = matches.where(F.col("score") >= threshold)
    if status:
        rows = rows.where(F.col("status") == status)
    return rows.orderBy(F.desc("score"), "id").limit(limit)


# --- applications ------------------------------------------------------------------------------


def tracked_applications(applications: DataFrame, page: int, per_page: int = 15) -> DataFrame:
    rows = applications.where(F.col("status").isin(fv.TRACKED_STATUSES))
    return page_of(rows, [F.desc("updated_at"), F.col("application_id")], page, per_page)


def change_applications(applications: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(snapshot, events) after manual changes (application_id, action, new_status).

    action "set" writes any tracked status; "submit" works only from needs_human; "approve" always.
    Events are appended for real changes, except that approvals leave no event.
    """
    both = applications.join(changes, "application_id", "left")
    action = F.col("action")
    target = (
        F.when((action == "set") & F.col("new_status").isin(fv.TRACKED_STATUSES), F.col("new_status"))
        .when((action == "submit") & (F.col("status") == "needs_human"), "submitted")
        .when(action == "approve", "approved")
    )
    decided = both.withColumn("target", target)
    snapshot = decided.select(
        *[
            {
                "status": F.coalesce("target", "status"),
                "updated_at": F.when(F.col("target").isNotNull(), now).otherwise(F.col("updated_at")),
                "submitted_at": F.when((action == "submit") & F.col("target").isNotNull(), now).otherwise(F.col("submitted_at")),
            }
            .get(name, F.col(name))
            .alias(name)
            for name in applications.columns
        ]
    )
    events = decided.where((action != "approve") & (F.col("target") != F.col("status"))).select(
        "application_id",
        F.when(action == "submit", "submitted").otherwise("status_changed").alias("event_type"),
        now.alias("occurred_at"),
        F.to_json(F.struct(F.col("status").alias("from"), F.col("target").alias("to"), F.lit(True).alias("manual"))).alias("payload"),
    )
    return snapshot, events


def response_rates(applications: DataFrame, links: DataFrame, arrival: tuple[str, ...] = ()) -> DataFrame:
    """(dimension, label, total, replied, rate) by first feed, score band and tier.

    A link without a feed name is no feed; unknown times and sources come last. Of links with one time and source the
    first by the columns `arrival` counts, else the least feed name, so that the result does not depend on the order of
    rows. Each application is exploded into its three labels, so one aggregation serves all three.
    """
    known = [x for n in ("fetched_at", "source") for x in (F.col(n).isNull(), F.col(n))]
    order = F.struct(*known, *arrival, feed_name().alias("feed"))
    first_feed = links.where(feed_name().isNotNull()).groupBy("match_id").agg(F.min(order).alias("first")).select("match_id", "first.feed")
    rows = applications.where(F.col("status").isin(fv.MEASURED_STATUSES)).join(first_feed, "match_id", "left")
    labels = F.array(
        F.struct(F.lit("feed").alias("dimension"), F.coalesce("feed", F.lit("n.d.")).alias("label")),
        F.struct(F.lit("band").alias("dimension"), score_band(F.col("score")).alias("label")),
        F.struct(F.lit("tier").alias("dimension"), F.col("tier").alias("label")),
    )
    replied = F.count_if(F.col("status").isin(fv.REPLIED_STATUSES))
    grouped = rows.select("status", F.inline(labels)).groupBy("dimension", "label")
    out = grouped.agg(F.count("*").alias("total"), replied.alias("replied"))
    return out.withColumn("rate", F.floor(F.col("replied") / F.col("total") * 100 + 0.5))


# --- runs, usage, requests ---------------------------------------------------------------------


def run_history(runs: DataFrame, sources: DataFrame, page: int, per_page: int = 15) -> DataFrame:
    """Feed rows of one page of batches, latest batch first."""
    starts = runs.groupBy("batch_id").agg(F.max("started_at").alias("batch_started_at"))
    wanted = page_of(starts, [F.desc("batch_started_at"), F.col("batch_id")], page, per_page)
    return runs.join(wanted, "batch_id").join(sources, "source", "left")


def usage_summary(usage: DataFrame, since: Column) -> DataFrame:
    return (
        usage.where(F.col("occurred_at") >= since)
        .groupBy("purpose", "model")
        .agg(
            F.sum("calls").alias("calls"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.count_distinct(F.to_date("occurred_at")).alias("active_days"),
        )
    )


def price_table(settings: DataFrame) -> DataFrame:
    """(model, input_per_million, output_per_million, currency) out of a JSON object; bad entries drop."""
    entries = settings.select(F.explode(F.from_json("value", "map<string,string>")).alias("model", "entry"))

    def field(name: str) -> Column:
        return F.get_json_object("entry", f"$.{name}")

    prices = entries.where(F.col("entry").startswith("{")).select(
        "model",
        field("input_per_million").try_cast("double").alias("input_per_million"),
        field("output_per_million").try_cast("double").alias("output_per_million"),
        F.coalesce(F.nullif(field("currency"), F.lit("")), F.lit("USD")).alias("currency"),
    )
    return prices.where("input_per_million IS NOT NULL AND output_per_million IS NOT NULL")


def usage_costs(summary: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per purpose and model; a model without a price has no cost."""
    cost = (
        F.col("input_tokens") / 1_000_000 * F.col("input_per_million")
        + F.col("output_tokens") / 1_000_000 * F.col("output_per_million")
    )
    return summary.join(prices, "model", "left").select("purpose", "model", cost.alias("cost"), "currency")


def cost_totals(costs: DataFrame) -> DataFrame:
    """Total per currency; the NULL currency row tells that some models have no price."""
    return costs.groupBy("currency").agg(F.sum("cost").alias("total"), F.count("*").alias("rows"))


def usage_to_write(usage: DataFrame) -> DataFrame:
    return usage.where("calls > 0")


def batch_status(runs: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("status") == "failed")
    status = F.when(failed == 0, "ok").when(failed == F.count("*"), "failed").otherwise("partial")
    return runs.groupBy("batch_id").agg(status.alias("status"))


def run_summary(runs: DataFrame, judged: DataFrame, usage: DataFrame, threshold: int) -> DataFrame:
    """One row over the whole run: feeds, failures, counts (updated: fetched but not new), scores and tokens."""
    feeds = runs.groupBy("source").agg(
        F.max((F.col("status") == "failed").cast("int")).alias("failed"),
        F.sum("jobs_fetched").alias("fetched"),
        F.sum("jobs_new").alias("new"),
    ).agg(
        F.count("*").alias("feeds"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("failed") == 1, F.col("source")))), ",").alias("failed_feeds"),
        F.sum("fetched").alias("fetched"),
        F.sum("new").alias("new"),
        (F.sum("fetched") - F.sum("new")).alias("updated"),
    )
    tokens = usage.agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    scores = judged.agg(
        F.count("*").alias("examined"),
        F.count("score").alias("scored"),
        F.count_if(F.col("score") >= threshold).alias("above_threshold"),
    )
    return feeds.select("*", *[df.select(n).scalar().alias(n) for df in (scores, tokens) for n in df.columns])


def canonical_json(payload: Column) -> Column:
    """Order-free text of a flat JSON object, so that equal payloads are equal strings."""
    entries = F.array_sort(F.map_entries(F.from_json(payload, "map<string,string>")))
    return F.to_json(F.map_from_entries(entries))


def new_requests(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """Wanted requests (request_type, payload) without an identical open one."""
    open_ = log.where(F.col("status").isin(fv.OPEN_REQUEST_STATUSES)).select(
        "request_type", canonical_json(F.col("payload")).alias("key")
    )
    keyed = wanted.withColumn("key", canonical_json(F.col("payload")))
    return keyed.join(open_, ["request_type", "key"], "left_anti").drop("key")


def stale_requests(log: DataFrame, now: Column) -> DataFrame:
    """Running requests whose worker must be gone: retried while attempts last, else failed."""
    age = F.unix_micros(now) - F.unix_micros("claimed_at")
    stale = (F.col("status") == "running") & (age > fv.STALE_AFTER_MINUTES * 60_000_000)
    retry = F.col("attempts") < F.col("max_attempts")
    return log.where(stale).withColumn("next_status", F.when(retry, "pending").otherwise("failed"))


def latest_requests(log: DataFrame, now: Column) -> DataFrame:
    """Latest request per type and payload that is open or finished recently enough to show."""
    longest = max(fv.VISIBLE_MINUTES.values())
    age = (F.unix_micros(now) - F.unix_micros("finished_at")) / 60_000_000
    open_ = F.col("status").isin(fv.OPEN_REQUEST_STATUSES)
    recent = log.withColumn("age", age).where(open_ | (F.col("age") < longest))
    newest = recent.groupBy("request_type", canonical_json(F.col("payload")).alias("key")).agg(
        F.max_by(F.struct("request_id", "status", "age"), F.struct("created_at", "request_id")).alias("r")
    )
    window = F.when(F.col("r.status").isin("done", "cancelled"), fv.VISIBLE_MINUTES["done"]).when(
        F.col("r.status") == "failed", fv.VISIBLE_MINUTES["failed"]
    )
    shown = newest.where(window.isNull() | (F.col("r.age") <= window))
    return shown.select("request_type", "key", "r.request_id", "r.status")


def liveness(beats: DataFrame, now: Column) -> DataFrame:
    """Minutes since the last sign of life per worker, online flag and label. Input: worker, seen_at."""
    last = beats.groupBy("worker").agg(F.max("seen_at").alias("seen_at"))
    minutes = dates.elapsed_minutes(F.col("seen_at"), now)
    return last.select(
        "worker", minutes.alias("minutes"), (minutes < 2).alias("online"), dates.ago_label(minutes).alias("ago")
    )


def top_per_key(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """Best n rows of every key (each task keeps n per key before the shuffle)."""
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n).drop("_n")
