"""The two daily jobs end to end, as plans over DataFrames; the caller writes the results.

Nothing is collected between the steps. Each job cuts its lineage once where a stored table would
stand, so that a lost executor repeats one half and not everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import filters, resolve, retrieve
from ..session import cut_lineage
from ..sources import raw as feeds
from .normalise import normalise, with_fingerprint

_TEXTS = ("description_raw", "description_clean")
#: What the store holds of a posting, beside id, first_seen_at, last_seen_at and is_active.
STORED = (
    "canonical_key", "company", "company_normalized", "employer", "location_raw", "city", "region", "country", "posted_at", "publisher", "source",
    "external_id", "salary", *resolve.APPLICATION, *resolve.TEXT, *resolve.CLASSES, *_TEXTS,
)


_PAY = "struct<is_stated:boolean,min:bigint,max:bigint,currency:string,period:string,eur_year_min:bigint,eur_year_max:bigint>"


def stored_schema() -> str:
    """Of an empty store, for the first day."""
    kinds = {"posted_at": "timestamp", "salary": _PAY, "chars": "int", "simhash": "long"}
    return ", ".join(["id long", *[f"{c} {kinds.get(c, 'string')}" for c in STORED], "first_seen_at timestamp, last_seen_at timestamp, is_active boolean"])


def _keyed_by_employer(rows: DataFrame) -> DataFrame:
    """Postings whose employer is not declared are in no block of near texts."""
    return rows.select("id", "canonical_key", F.col("employer").alias("company_normalized"), "simhash", "chars")


def collect(raw: DataFrame, stored: DataFrame, links: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Raw postings of a day to the next snapshots of the store and of its links.

    `raw` has the common raw columns and a unique `id` in arrival order. `stored` is the current snapshot: id, the
    columns of STORED, first_seen_at, last_seen_at, is_active. `links` are (source, external_id, job_id, url,
    fetched_at, publisher, raw). Of what comes back `store` and `links` are the new snapshots, `variants` the day's
    rows with their group, `postings` the merged ones, `matched` where each belongs and `feeds` a row per feed.
    """
    canonical = cut_lineage(with_fingerprint(normalise(raw)).withColumn("chars", F.length("description_clean")))
    groups = resolve.group_postings(_keyed_by_employer(canonical))
    variants = cut_lineage(canonical.drop(*_TEXTS).join(groups, "id"))
    merged = resolve.merge_variants(variants)
    texts = canonical.select(F.col("id").alias("text_id"), *_TEXTS)
    postings = cut_lineage(merged.join(texts, "text_id").withColumnRenamed("group_id", "id"))
    kept = stored.select("id", "canonical_key", F.col("employer").alias("company_normalized"), "simhash", "is_active")
    matched = cut_lineage(resolve.match_stored(_keyed_by_employer(postings), kept))
    store = _next_store(postings, matched, stored, now)
    # Every variant's link points at the stored row of its group.
    owner = postings.join(matched, "id").select(
        F.col("id").alias("group_id"), F.coalesce("stored_id", resolve.new_id()).alias("job_id")
    )
    payload = raw.select("id", F.col("raw")) if "raw" in raw.columns else raw.select("id", F.lit(None).cast("string").alias("raw"))
    seen = variants.join(owner, "group_id").join(payload, "id")
    # A feed may deliver a posting twice; its last delivery counts.
    last = seen.groupBy("source", "external_id").agg(F.max_by(F.struct("job_id", "url", "publisher", "raw"), "id").alias("l"))
    return {
        "variants": variants,
        "postings": postings,
        "matched": matched,
        "store": store,
        "links": resolve.upsert_links(links, last.select("source", "external_id", "l.*"), now),
        "feeds": _feed_rows(raw, variants, matched),
    }


def _next_store(postings: DataFrame, matched: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    fresh = resolve.insert_new(postings.select("id", *STORED), matched, now).withColumnRenamed("job_id", "id")
    news = postings.join(matched.where("stored_id IS NOT NULL").select("id", "stored_id"), "id")
    # Several groups may hit one stored row; they are merged like variants are before it is refreshed.
    again = resolve.merge_variants(news.select("id", F.col("stored_id").alias("group_id"), *[c for c in STORED if c not in _TEXTS]))
    again = again.withColumnRenamed("group_id", "stored_id").join(postings.select(F.col("id").alias("text_id"), *_TEXTS), "text_id")
    longer = [F.col(c) for c in stored.columns]
    texts = again.select(F.col("stored_id").alias("_id"), F.col("chars").alias("_chars"), *[F.col(c).alias(f"_{c}") for c in _TEXTS])
    refreshed = resolve.refresh_stored(stored.withColumns({"text_id": F.lit(None).cast("long"), "_was": F.coalesce("chars", F.lit(0))}), again, now)
    both = refreshed.join(texts, refreshed["id"] == texts["_id"], "left")
    renewed = {c: F.when(F.col("_chars") > F.col("_was"), F.col(f"_{c}")).otherwise(F.col(c)) for c in _TEXTS}
    return both.withColumns(renewed).select(*longer).unionByName(fresh.select(*stored.columns))


def _feed_rows(raw: DataFrame, variants: DataFrame, matched: DataFrame) -> DataFrame:
    """A row per feed: fetched, new (groups that only new rows of it make), duplicate (rows beyond the day's groups)."""
    rows = variants.select("source", "group_id").join(matched.select(F.col("id").alias("group_id"), "matched_by"), "group_id")
    first = variants.groupBy("group_id").agg(F.min_by("source", "id").alias("source"))
    new = first.join(matched.where("matched_by = 'new'").select(F.col("id").alias("group_id")), "group_id").groupBy("source").agg(F.count("*").alias("new"))
    counts = rows.groupBy("source").agg(F.count("*").alias("fetched")).join(new, "source", "left").fillna(0, ["new"])
    return feeds.share_duplicates(counts, variants.agg(F.count_distinct("group_id")).scalar())


def match(
    postings: DataFrame, matches: DataFrame, criteria: DataFrame, profiles: DataFrame, terms: DataFrame,
    budgeted: DataFrame, now: Column, top: int, reserved: int,
) -> dict[str, DataFrame]:
    """Candidates to finalists for every profile, each over its own batch.

    `postings` is the stored table with vectors in `vector`; `matches` has profile_id, job_id, status, reached_stage;
    `criteria` has profile_id and the columns of `filters.profile_columns`; `profiles` has profile_id and
    profile_vector; `terms` has profile_id, term, weight.
    """
    judged = cut_lineage(filters.judge_profiles(postings, matches, criteria, now))
    with_vector = postings.where("vector IS NOT NULL").select("id", "vector")
    passed = judged.where("rejected IS NULL").select("profile_id", "id").join(with_vector, "id")
    pairs = passed.select("profile_id", "id")
    body = retrieve.lexical_text(F.col("title"), F.col("job_family"), F.col("description_clean"))
    bodies = postings.join(pairs.select("id").distinct(), "id", "left_semi").select("id", body.alias("body"))
    keyword = retrieve.bm25(bodies, terms, pairs)
    ranked = retrieve.rank(passed, profiles, keyword)
    return {
        "rejected": judged.where("rejected IS NOT NULL").select("profile_id", "id", filters.reason_text(F.col("rejected")).alias("reason")),
        "ranked": ranked,
        "finalists": retrieve.finalists(ranked, budgeted, top, reserved),
    }
