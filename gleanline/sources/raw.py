"""The common raw posting: schema, checks, and the selections applied before normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.rules import job_family
from ..functions.text import let, lookup, strip, title_case

RAW_SCHEMA = (
    "source string, external_id string, title string, company string, url string, description string, "
    "location string, country string, is_remote boolean, posted_at string, salary_min double, salary_max double, "
    "salary_currency string, salary_period string, salary_text string, contract_hint string, seniority_hint string, "
    "apply_url string, ats_type string, ats_board_token string, ats_job_id string, publisher string, raw string"
)
RAW_COLUMNS = [part.strip().split(" ")[0] for part in RAW_SCHEMA.split(",")]
RAW_TYPES = dict(part.strip().split(" ") for part in RAW_SCHEMA.split(","))
REQUIRED = ["source", "external_id", "title", "company", "url"]


def guarded_id(value: Column) -> Column:
    """An id too long to store becomes its hash: cutting it would make different ids collide."""
    return F.when(
        F.length(value) > fv.MAX_EXTERNAL_ID, F.concat(F.lit("sha256:"), F.sha2(value, 256))
    ).otherwise(value)


def raw_posting(fields: dict[str, Column]) -> list[Column]:
    """All raw columns in order; what a feed does not state is NULL."""
    filled = {"description": F.lit(""), "ats_type": F.lit("unknown"), **fields}
    columns = []
    for name in RAW_COLUMNS:
        kind = "timestamp" if name == "posted_at" else RAW_TYPES[name]
        columns.append(filled.get(name, F.lit(None)).cast(kind).alias(name))
    return columns


def check(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split JSON lines of the common schema into (valid postings, quarantined lines with a reason)."""
    from ..functions.dates import parse_iso

    schema = RAW_SCHEMA + ", _corrupt string"
    parsed = lines.withColumn(
        "p", F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    missing = F.array_compact(
        F.array(*[F.when(F.coalesce(strip(F.col(f"p.{n}")), F.lit("")) == "", n) for n in REQUIRED])
    )
    reason = F.when(F.col("p._corrupt").isNotNull(), "malformed").when(
        F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ","))
    )
    judged = parsed.withColumn("reason", reason)
    fields = {n: F.col(f"p.{n}") for n in RAW_COLUMNS}
    fields["posted_at"] = parse_iso(F.col("p.posted_at"))
    fields["external_id"] = guarded_id(F.col("p.external_id"))
    fields["ats_type"] = F.coalesce("p.ats_type", F.lit("unknown"))
    fields["description"] = F.coalesce("p.description", F.lit(""))
    valid = judged.where("reason IS NULL").select(*raw_posting(fields))
    return valid, judged.where("reason IS NOT NULL").select(column, "reason")


def read_raw(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed JSON-lines files of the common schema, bad lines set aside."""
    return check(spark.read.text(path))


def company_name(token: Column, names: Column, fallback: Column) -> Column:
    """Configured name of a board, else the one in the payload, else its token in words."""
    return F.coalesce(
        F.try_element_at(names, token), F.nullif(fallback, F.lit("")), title_case(F.translate(token, "-", " "))
    )


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9+#]+)"), 1)


def title_matches(title: Column, extra: Column, keywords: Column) -> Column:
    """Some telling keyword word equals a title word or, from four letters on, starts one."""
    wanted = F.filter(
        F.array_distinct(F.flatten(F.transform(keywords, _tokens))), lambda w: ~w.isin(fv.TITLE_STOPWORDS)
    )

    def present(words: Column) -> Column:
        return F.exists(
            wanted,
            lambda w: F.array_contains(words, w)
            | ((F.length(w) >= 4) & F.exists(words, lambda word: F.startswith(word, w))),
        )

    return (F.size(keywords) == 0) | let(_tokens(F.concat_ws(" ", title, extra)), present)


def drop_repeats(postings: DataFrame) -> DataFrame:
    return postings.dropDuplicates(["source", "external_id"])


def cap_per_feed(postings: DataFrame, cap: int, arrival: str) -> DataFrame:
    """First `cap` rows of every feed in arrival order; tasks keep at most `cap` rows per feed."""
    order = Window.partitionBy("source").orderBy(arrival)
    return postings.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def search_keywords(headline: Column, roles: Column, most: int | None = None) -> Column:
    """Headline and role families, then their synonyms; distinct, in order, the first `most` (e.g. MAX_KEYWORDS) of them."""
    families = F.array_compact(F.transform(roles, lambda r: F.lower(job_family(r))))
    english = F.array_distinct(F.concat(F.array_compact(F.array(F.nullif(F.lower(headline), F.lit("")))), families))
    italian = F.array_compact(F.transform(english, lambda k: lookup(fv.KEYWORD_SYNONYMS, k)))
    found = F.array_distinct(F.concat(english, italian))
    return found if most is None else F.slice(found, 1, most)


# --- feed bookkeeping --------------------------------------------------------------------------


def feed_metrics(postings: DataFrame) -> DataFrame:
    """Run row per feed. Input: source, group_id, matched_by, failed, api_calls."""
    return postings.groupBy("source").agg(
        F.count("*").alias("fetched"),
        F.count_if(F.col("matched_by") == "new").alias("new"),
        F.sum("api_calls").alias("api_calls"),
        F.when(F.max(F.col("failed").cast("int")) == 1, "failed").otherwise("ok").alias("status"),
    )


class FeedRun:
    """Metrics of each feed, taken while its rows pass on their way to a table; no second look at them.

    `feeds` are the names of the configured feeds. Rows need source, group_id, matched_by, fetched_at, failed, error and
    api_calls; a row that is not the first of its group (`is_first` false) is a duplicate. Rows of other feeds are counted
    under no name.
    """

    FIELDS = "source string, fetched long, new long, duplicate long, api_calls long, elapsed double, error string, status string"

    def __init__(self, feeds: list[str], name: str = "feed run"):
        self.feeds, self.seen = feeds, Observation(name)

    def watch(self, rows: DataFrame) -> DataFrame:
        """`rows`, unchanged; the metrics are there once an action has run over them."""
        out = []
        for k, feed in enumerate(self.feeds):
            own = F.col("source") == feed
            at = F.when(own, F.col("fetched_at"))
            out += [
                F.count_if(own).alias(f"fetched_{k}"),
                F.count_if(own & (F.col("matched_by") == "new")).alias(f"new_{k}"),
                F.count_if(own & ~F.col("is_first")).alias(f"duplicate_{k}"),
                F.coalesce(F.sum(F.when(own, F.col("api_calls"))), F.lit(0)).cast("long").alias(f"api_calls_{k}"),
                ((F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1_000_000).alias(f"elapsed_{k}"),
                F.min(F.when(own & F.col("failed"), F.col("error"))).alias(f"error_{k}"),
                F.count_if(own & F.col("failed")).alias(f"failed_{k}"),
            ]
        return rows.observe(self.seen, *out)

    def rows(self, spark: SparkSession) -> DataFrame:
        """One row for each configured feed, those without a posting too."""
        found = self.seen.get
        names = ("fetched", "new", "duplicate", "api_calls", "elapsed", "error")
        table = [
            (feed, *[found[f"{n}_{k}"] for n in names], "failed" if found[f"failed_{k}"] else "ok") for k, feed in enumerate(self.feeds)
        ]
        return spark.createDataFrame(table, self.FIELDS)


def share_duplicates(metrics: DataFrame, groups: Column) -> DataFrame:
    """Spread the batch's duplicates over feeds in proportion to what each fetched (half-even)."""
    total = metrics.agg(F.sum("fetched")).scalar()
    share = F.bround((total - groups) * F.col("fetched") / total).cast("long")
    return metrics.withColumn("duplicate", share)


def backfill_publisher(raw: Column, adapter: Column, chars: int | None = None) -> Column:
    """Publisher out of a stored payload; the key depends on the feed. `chars` (e.g. PUBLISHER_CHARS) shortens it."""
    def stated(key: str) -> Column:
        return F.nullif(F.trim(F.get_json_object(raw, f"$.{key}")), F.lit(""))

    found = F.coalesce(stated("job_publisher"), F.when(adapter == "jooble", stated("source")))
    return found if chars is None else F.substring(found, 1, chars)


def sync_feeds(stored: DataFrame, known: DataFrame) -> DataFrame:
    """Stored feeds untouched plus known ones that are missing; enabled only without required keys."""
    fresh = known.join(stored.select("adapter"), "adapter", "left_anti").select(
        "adapter", "display_name", (F.size("required_settings") == 0).alias("enabled")
    )
    return stored.select("adapter", "display_name", "enabled").unionByName(fresh)
