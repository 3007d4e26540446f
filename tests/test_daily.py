"""The daily jobs end to end on a handful of postings."""

import pytest
from pyspark.sql import functions as F

from gleanline.functions import fixed_values as fv
from gleanline.operators import filters
from gleanline.plans import daily
from gleanline.sources.raw import RAW_COLUMNS, raw_posting

LONG = "Cerchiamo un backend developer con esperienza in Python, FastAPI e PostgreSQL. " * 8


NOW = "2024-06-01 00:00:00"


def stamp(text=NOW):
    return F.lit(text).cast("timestamp")


def raw_rows(spark, rows):
    df = spark.createDataFrame(rows, "id long, source string, external_id string, title string, company string, location string, description string, salary_text string")
    fields = {n: F.col(n) for n in df.columns if n in RAW_COLUMNS}
    fields["url"] = F.concat(F.lit("https://x/"), F.col("external_id"))
    fields["ats_type"] = F.when(F.col("source") == "greenhouse", "greenhouse").otherwise("unknown")
    fields["ats_board_token"] = F.when(F.col("source") == "greenhouse", "acme")
    fields["raw"] = F.concat(F.lit('{"n":'), F.col("id"), F.lit("}"))
    return df.select("id", *raw_posting(fields))


DAY_1 = [
    (1, "adzuna", "a", "Backend Developer", "Acme S.r.l.", "Milano, Italia", LONG, "30.000 - 40.000 EUR annui"),
    (2, "greenhouse", "b", "Backend Developer", "Acme", "Milano, Italia", LONG + "Smart working.", None),
    (3, "jooble", "c", "Backend Developer (Java)", "Acme", "Roma, Italia", LONG, None),
    (4, "lever", "d", "Cuoco", "Globex", "Roma, Italia", "Due righe.", None),
    (5, "adzuna", "e", "Senior Data Engineer", fv.UNDECLARED_COMPANY, "Roma, Italia", LONG, None),
    (6, "jooble", "f", "Data Engineer", fv.UNDECLARED_COMPANY, "Torino, Italia", LONG, None),
]
DAY_2 = [
    (11, "adzuna", "d2", "Cuoco", "Globex", "Roma, Italia", "Due righe e mezza, con orario.", "1.800 EUR al mese"),
    (12, "lever", "d", "Cuoco", "Globex", "Roma, Italia", "Due righe.", None),
    (13, "jooble", "g", "Autista", "Initech", "Napoli, Italia", "Patente C.", None),
]


@pytest.fixture(scope="module")
def days(spark):
    """Two days, the second against what the first one left."""
    store = spark.createDataFrame([], daily.stored_schema())
    links = spark.createDataFrame([], "source string, external_id string, job_id long, url string, fetched_at timestamp, publisher string, raw string")
    first = daily.collect(raw_rows(spark, DAY_1), store, links, stamp())
    second = daily.collect(raw_rows(spark, DAY_2), first["store"], first["links"], stamp("2024-06-02 00:00:00"))
    return first, second


def by_title(out):
    return {r.title: r for r in out["store"].collect()}


def test_collect_groups_and_merges(days):
    first, _ = days
    groups = {r.id: r.group_id for r in first["variants"].collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}  # an employer that is not declared brings nobody together
    best = {r.id: r for r in first["postings"].collect()}
    assert best[1].ats_type == "greenhouse" and best[1].ats_board_token == "acme" and best[1].text_id == 2 and best[1].n_variants == 3
    assert best[1].salary.min == 30000 and best[1].salary.max == 40000 and best[1].salary.eur_year_max == 40000
    assert {r.matched_by for r in first["matched"].collect()} == {"new"}


def test_first_day_fills_the_store(days):
    rows = by_title(days[0])
    assert set(rows) == {"Backend Developer", "Cuoco", "Senior Data Engineer", "Data Engineer"}
    assert rows["Backend Developer"].description_clean.endswith("Smart working.") and rows["Backend Developer"].is_active
    assert rows["Senior Data Engineer"].seniority == "senior"
    links = {r.external_id: r.job_id for r in days[0]["links"].collect()}
    assert links["a"] == links["b"] == links["c"] == rows["Backend Developer"].id and links["d"] == rows["Cuoco"].id
    feeds = {r.source: (r.fetched, r.new) for r in days[0]["feeds"].collect()}
    assert feeds == {"adzuna": (2, 2), "greenhouse": (1, 0), "jooble": (2, 1), "lever": (1, 1)}


def test_second_day_refreshes_what_is_better(days):
    old, new = by_title(days[0]), by_title(days[1])
    assert set(new) == {*old, "Autista"}
    cook = new["Cuoco"]
    assert cook.id == old["Cuoco"].id and cook.description_clean == "Due righe e mezza, con orario."
    assert cook.salary.is_stated and cook.salary.min == 1800 and cook.salary.period == "monthly" and cook.salary.eur_year_min == 21600
    assert str(cook.last_seen_at) == "2024-06-02 00:00:00" and str(cook.first_seen_at) == NOW
    assert new["Backend Developer"] == old["Backend Developer"]
    links = {r.external_id: (r.job_id, str(r.fetched_at)[:10]) for r in days[1]["links"].collect()}
    assert links["d"] == links["d2"] == (cook.id, "2024-06-02") and links["a"][1] == "2024-06-01" and len(links) == 8


def test_collect_of_no_postings_keeps_the_store(spark, days):
    first, _ = days
    again = daily.collect(raw_rows(spark, []), first["store"], first["links"], stamp("2024-06-03 00:00:00"))
    assert sorted(map(tuple, again["store"].collect()), key=str) == sorted(map(tuple, first["store"].collect()), key=str)
    assert again["links"].count() == 6 and again["feeds"].count() == 0


def test_two_profiles_match_what_was_collected(spark, days):
    """The store of the second day goes into matching as it is; each profile has its own criteria, batch and decisions."""
    store = days[1]["store"]
    ids = {t: r.id for t, r in by_title(days[1]).items()}
    vectors = spark.createDataFrame([(i, [1.0, float(k)]) for k, i in enumerate(sorted(ids.values()))], "id long, vector array<float>")
    own = {1: filters.MatchCriteria(seniority="mid", max_age_days=0), 2: filters.MatchCriteria(countries=("FR",), remote_ignores_country=False)}
    criteria = None
    for p, values in own.items():
        row = spark.range(1).select(F.lit(p).cast("long").alias("profile_id"), *[v.alias(n) for n, v in values.columns().items()])
        criteria = row if criteria is None else criteria.unionByName(row)
    matches = spark.createDataFrame([(1, ids["Cuoco"], "applied", 0), (2, ids["Autista"], "new", 1)], "profile_id long, job_id long, status string, reached_stage int")
    profiles = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "profile_id long, profile_vector array<float>")
    terms = spark.createDataFrame([(1, "python", 1.0), (2, "patente", 1.0)], "profile_id long, term string, weight double")
    none = spark.createDataFrame([], "id long")
    out = daily.match(store.join(vectors, "id"), matches, criteria, profiles, terms, none, stamp(), 5, 1)
    reasons = {(r.profile_id, r.id): r.reason for r in out["rejected"].collect()}
    assert {k for k in reasons if k[0] == 2} == {(2, i) for i in ids.values()}  # all are in Italy
    assert {i for p, i in reasons if p == 1} <= set(ids.values()) - {ids["Cuoco"]}
    chosen = {(r.profile_id, r.id) for r in out["finalists"].collect()}
    assert chosen and all(p == 1 for p, _ in chosen) and (1, ids["Cuoco"]) not in chosen
    assert not chosen & set(reasons)


def test_match_explains_and_ranks(spark):
    postings = spark.createDataFrame(
        [
            (1, "Backend Developer", "Acme", LONG, "mid", [1.0, 0.0]),
            (2, "Head of Sales", "Acme", "vendite", "principal", [0.0, 1.0]),
            (3, "Python Developer", "Globex", "python python fastapi", "mid", [0.9, 0.1]),
        ],
        "id long, title string, company string, description_clean string, seniority string, vector array<float>",
    ).withColumns(
        {
            **{n: F.lit(None).cast("string") for n in ("lang", "country", "city", "job_family")},
            "work_mode": F.lit("unknown"), "contract_type": F.lit("unknown"), "is_active": F.lit(True),
            "posted_at": F.lit("2024-05-30").cast("timestamp"), "first_seen_at": F.lit("2024-05-30").cast("timestamp"),
            "salary_is_stated": F.lit(False), "salary_eur_year_max": F.lit(None).cast("long"),
        }
    )
    matches = spark.createDataFrame([], "profile_id long, job_id long, status string, reached_stage int")
    criteria = spark.range(1).select(F.lit(9).cast("long").alias("profile_id"), *[v.alias(n) for n, v in filters.MatchCriteria(seniority="mid").columns().items()])
    profile = spark.createDataFrame([(9, [1.0, 0.0])], "profile_id long, profile_vector array<float>")
    terms = spark.createDataFrame([(9, "python", 1.0)], "profile_id long, term string, weight double")
    out = daily.match(
        postings, matches, criteria, profile, terms,
        spark.createDataFrame([], "id long"), F.lit("2024-06-01").cast("timestamp"), 5, 1,
    )
    assert [(r.id, r.reason) for r in out["rejected"].collect()] == [(2, "livello: principal contro mid (+/-1)")]
    assert {r.id for r in out["finalists"].collect()} == {1, 3}
