"""Operators on small fixtures: invariants, brute-force checks, plan shape."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gleanline.operators import calibrate, claims, filters, resolve, retrieve, rubric, serve, tracking

STAMP = "2024-06-01 12:00:00"


def now():
    return F.lit(STAMP).cast("timestamp")


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_similar_texts_have_close_prints(spark):
    a = "Cerchiamo un backend developer con esperienza in Python, FastAPI e PostgreSQL. " * 4
    b = a + "Offriamo smart working e formazione continua."
    other = "Cercasi cuoco per ristorante di pesce, esperienza in cucina mediterranea. " * 4
    rows = spark.createDataFrame([(0, a), (1, b), (2, other), (3, ""), (4, "due parole")], "id long, t string")
    prints = {r.id: r.simhash for r in resolve.simhash(rows, "id", "t").collect()}
    distance = lambda x, y: bin((prints[x] ^ prints[y]) & (2**64 - 1)).count("1")
    assert distance(0, 1) <= 10 < distance(0, 2)
    assert prints[3] == 0 and prints[4] != 0


def _clusters(seed, centres, members, flips):
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(members):
            value = centre
            for bit in rng.sample(range(64), rng.randint(0, flips)):
                value ^= 1 << bit
            out.append(signed(value))
    return out


@pytest.mark.parametrize("bucket_rows", [2048, 3])
def test_near_prints_match_brute_force(spark, monkeypatch, bucket_rows):
    """Also with buckets split very finely."""
    monkeypatch.setattr(resolve, "BUCKET_ROWS", bucket_rows)
    prints = sorted(set(_clusters(1, 6, 8, 9)))
    df = spark.createDataFrame([("b", p) for p in prints], "block string, simhash long")
    got = {
        (r.a_simhash, r.b_simhash)
        for r in resolve.near_prints(df, df, F.col("a_simhash") < F.col("b_simhash")).collect()
    }
    expected = {(x, y) for x in prints for y in prints if x < y and bin((x ^ y) & (2**64 - 1)).count("1") <= 10}
    assert got == expected and expected


def test_groups_are_the_components_of_the_edges(spark):
    rng = random.Random(2)
    prints = _clusters(3, 5, 9, 8)
    rows = [(i, f"k{rng.randint(0, 60)}", rng.choice("xy"), p, rng.choice([100, 400])) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "id long, canonical_key string, company_normalized string, simhash long, chars int")
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in rows:
        for b in rows:
            near = a[2] == b[2] and min(a[4], b[4]) >= 300 and bin((a[3] ^ b[3]) & (2**64 - 1)).count("1") <= 10
            if a[1] == b[1] or near:
                x, y = sorted((root(a[0]), root(b[0])))
                parent[y] = x
    got = {r.id: r.group_id for r in resolve.group_postings(df).collect()}
    assert got == {i: root(i) for i in range(len(rows))}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    out = resolve.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    got = {r.id: r.component for r in out.collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))


def test_no_edges_no_components(spark):
    assert resolve.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


CANON = (
    "id long, company string, lang string, seniority string, country string, city string, work_mode string, contract_type string, "
    "posted_at timestamp, salary_is_stated boolean, salary_eur_year_max long"
)


def kinds(spark, criteria, **changes):
    base = dict(id=1, company="Acme", lang=None, seniority="unknown", country=None, city=None, work_mode="unknown", contract_type="unknown", posted_at=None, salary_is_stated=False, salary_eur_year_max=None)
    df = spark.createDataFrame([tuple({**base, **changes}.values())], CANON)
    return df.select(filters.rejection(criteria.columns(), now())["kind"]).first()[0]


def test_missing_data_never_rejects(spark):
    strict = filters.MatchCriteria(
        countries=("IT",), seniority="mid", languages=("it",), authorized_countries=("IT",), home_city="Milano", max_age_days=10, min_salary_eur_year=50000,
        excluded_contract_types=("internship",), excluded_work_modes=("on_site",), blocked_companies=("Other",),
    )
    assert kinds(spark, strict) is None


@pytest.mark.parametrize(
    "criteria, changes, kind",
    [
        (dict(blocked_companies=("ACME S.r.l.",)), {}, "azienda"),
        (dict(languages=("it",)), dict(lang="de"), "lingua"),
        (dict(seniority="junior"), dict(seniority="senior"), "livello"),
        (dict(seniority="junior"), dict(seniority="mid"), None),
        (dict(countries=("IT",)), dict(country="us"), "paese"),
        (dict(countries=("IT",)), dict(country="US", work_mode="remote"), None),
        (dict(countries=("IT",), authorized_countries=("IT",)), dict(country="US", work_mode="remote"), "sponsorship"),
        (dict(home_city="Milano"), dict(city="Roma"), "città"),
        (dict(home_city="Milano"), dict(city="MILANO"), None),
        (dict(home_city="Milano", restrict_to_home_city=False), dict(city="Roma"), None),
        (dict(min_salary_eur_year=40000), dict(salary_is_stated=True, salary_eur_year_max=30000), "retribuzione"),
        (dict(min_salary_eur_year=40000), dict(salary_is_stated=False, salary_eur_year_max=30000), None),
    ],
)
def test_single_filters(spark, criteria, changes, kind):
    assert kinds(spark, filters.MatchCriteria(**criteria), **changes) == kind


@pytest.mark.parametrize(
    "intervals, months",
    [
        ([("2020-01", "2020-12")], 12), ([("2020-01", "2020-06"), ("2020-04", "2020-12")], 12), ([("2020-01", "2020-03"), ("2020-04", "2020-06")], 6),
        ([("2020-01", "2020-03"), ("2020-06", "2020-06")], 4), ([("2024-05", None)], 2), ([("2024-05", "2030-01")], 2), ([("2020-05", "2020-01")], None),
        ([("2020-01", "2020-12"), ("2020-02", "2020-03"), ("2020-11", "2021-01")], 13),
    ],
)
def test_experience(spark, intervals, months):
    ordinal = lambda ym: None if ym is None else int(ym[:4]) * 12 + int(ym[5:])
    df = spark.createDataFrame([(1, ordinal(a), ordinal(b)) for a, b in intervals], "profile_id long, start int, `end` int")
    row = filters.experience_months(df, F.lit(2024 * 12 + 6)).first()
    assert (row["months"] if row else None) == months


def test_tokens_keep_technology_names(spark):
    df = spark.createDataFrame([("C++ and C#, Node.js; CI/CD",)], "t string")
    assert df.select(retrieve.tokenize(F.col("t"))).first()[0] == ["c++", "and", "c#", "node.js", "ci/cd"]


def test_bm25_invariants(spark):
    docs = spark.createDataFrame([(1, "java java spring"), (2, "python rest api"), (3, "java"), (4, "")], "id long, body string")
    terms = spark.createDataFrame([(0, "Java", 1.0), (0, "REST API", 1.0), (0, "a b c d", 1.0), (0, "cobol", 1.0)], "profile_id long, term string, weight double")
    got = {r.id: r.keyword for r in retrieve.bm25(docs, terms).collect()}
    assert set(got) == {1, 2, 3} and all(v > 0 for v in got.values())


def test_bm25_of_each_profile_is_that_of_its_batch(spark):
    docs = spark.createDataFrame(
        [(1, "java java spring"), (2, "python rest api"), (3, "java"), (4, ""), (5, "java python rest"), (6, "go")], "id long, body string"
    )
    terms = spark.createDataFrame([(p, t, w) for p in (0, 1, 2) for t, w in (("Java", 1.0), ("rest api", 0.6))], "profile_id long, term string, weight double")
    batches = {0: [1, 2, 4], 1: [1, 3, 5, 6], 2: [4]}
    pairs = spark.createDataFrame([(p, i) for p, ids in batches.items() for i in ids] + [(0, 1)], "profile_id long, id long")
    got = {(r.profile_id, r.id): r.keyword for r in retrieve.bm25(docs, terms, pairs).collect()}
    alone = {
        (p, r.id): r.keyword
        for p, ids in batches.items() for r in retrieve.bm25(docs.where(F.col("id").isin(ids)), terms.where(f"profile_id = {p}")).collect()
    }
    assert set(got) == set(alone) == {(0, 1), (0, 2), (1, 1), (1, 3), (1, 5)}
    assert all(abs(got[k] - alone[k]) < 1e-12 for k in got) and got[0, 1] != got[1, 1]


def test_spread_and_zero_vector(spark):
    flat = spark.createDataFrame([(0, 1, 0.7), (0, 2, 0.7)], "profile_id long, id long, s double")
    assert {r.o for r in retrieve.spread(flat, "s", "o").collect()} == {0.5}
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(retrieve.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


@pytest.mark.parametrize(
    "top, reserved, budget, expected",
    [
        (3, 0, [9], [1, 2, 3]), (3, 1, [], [1, 2, 3]), (3, 1, [9], [1, 2, 9]), (3, 1, [1], [1, 2]), (3, 2, [8, 9, 10], [1, 8, 9]), (2, 5, [9, 10, 8], [8, 9]),
    ],
)
def test_finalists(spark, top, reserved, budget, expected):
    ranked = spark.createDataFrame([(0, i, 1.0 / i) for i in range(1, 11)], "profile_id long, id long, hybrid double")
    ids = spark.createDataFrame([(i,) for i in budget], "id long")
    assert sorted(r.id for r in retrieve.finalists(ranked, ids, top, reserved).collect()) == expected


def test_rubric(spark):
    assert abs(sum(rubric.fv.RUBRIC_WEIGHTS.values()) - 1) < 1e-9
    df = spark.range(1)
    assert df.select(rubric.weighted_total({})).first()[0] == 50
    assert df.select(rubric.weighted_total({n: F.lit(150) for n in rubric.CRITERIA})).first()[0] == 100
    with pytest.raises(ValueError):
        rubric.weighted_total({}, {"a": 0.0})


def test_scorer_failure_stays_in_its_row(spark):
    def scorer(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return "{}", 1, 1

    prompts = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, prompt string")
    got = {r.id: r.error for r in rubric.assess(prompts, scorer).collect()}
    assert got == {1: None, 2: "ValueError: no"}


def test_spearman(spark):
    pairs = spark.createDataFrame([("up", float(i), float(i * i), 1) for i in range(5)] + [("down", float(i), float(-i), 2) for i in range(5)] + [("flat", 1.0, float(i), 1) for i in range(5)], "k string, x double, y double, n long")
    got = {r.k: round(r.rho, 6) for r in calibrate.spearman(pairs, ["k"]).collect()}
    assert got == {"up": 1.0, "down": -1.0, "flat": 0.0}


def test_grid_size(spark):
    grid = calibrate.weight_grid(spark.range(1))
    assert grid.count() == 53130
    assert grid.selectExpr("min(w1+w2+w3+w4+w5+w6) = 20 and max(w1+w2+w3+w4+w5+w6) = 20").first()[0]


def step(current, classification):
    if current in ("rejected", "offer", "withdrawn", "failed"):
        return current
    target = {"interview": "interview", "rejection": "rejected", "ack": "acknowledged"}.get(classification)
    rank = {"submitted": 0, "acknowledged": 1, "interview": 2, "rejected": 3, "offer": 3}
    return target if target and rank[target] >= rank.get(current, -1) else current


def test_status_fold_equals_the_step_by_step_fold(spark):
    rng = random.Random(4)
    statuses = ["submitted", "acknowledged", "interview", "rejected", "withdrawn", "draft"]
    apps = [(i, rng.choice(statuses)) for i in range(120)]
    mails = [(i, f"m{j}", rng.randint(0, 50), rng.choice(["ack", "interview", "rejection", "other", "request_info"])) for i in range(120) for j in range(rng.randint(0, 6))]
    applications = spark.createDataFrame(apps, "application_id long, status string")
    messages = spark.createDataFrame(mails, "application_id long, message_id string, s long, classification string").withColumn("sent_at", F.timestamp_seconds("s"))
    final, changes = {}, set()
    for ident, status in apps:
        for _, mail, _, kind in sorted((m for m in mails if m[0] == ident), key=lambda m: (m[2], m[1])):
            after = step(status, kind)
            if after != status:
                changes.add((ident, mail, status, after))
            status = after
        final[ident] = status
    assert {r.application_id: r.status for r in tracking.fold_statuses(applications, messages).collect()} == final
    got = {(r.application_id, r.message_id, r.from_status, r.to_status) for r in tracking.status_changes(applications, messages).collect()}
    assert got == changes


def test_provenance(spark):
    facts = spark.createDataFrame([(1, "a", "a-1"), (1, "b", "b-1")], "doc_id long, parent_id string, fact_id string")
    claimed = spark.createDataFrame([(1, "a", 0, "a-1"), (1, "a", 1, "b-1"), (1, "a", 2, "x"), (1, "z", 3, "a-1")], "doc_id long, parent_id string, position int, source_id string")
    got = {r.position: r.verdict for r in claims.provenance(claimed, facts).collect()}
    assert got == {0: None, 1: "bullet-di-un-altra-esperienza", 2: "bullet-inesistente", 3: "esperienza-inesistente"}


def test_java_does_not_justify_javascript(spark):
    known = spark.createDataFrame([(1, "Java"), (1, "C++")], "doc_id long, skill string")
    claimed = spark.createDataFrame([(1, 0, "JavaScript", "JavaScript"), (1, 1, "Java", "java"), (1, 2, "C", "c"), (1, 3, "C++", "c++")], "doc_id long, position int, text string, source string")
    assert {r.position for r in claims.undeclared_skills(claimed, known).collect()} == {0, 2}


def test_request_parameters_are_validated():
    f = serve.MatchFilters.parse({"min": "500", "mode": "remote,moon", "country": "it,1,usa", "page": "-3", "per": "1000", "sort": "x"})
    assert (f.min_score, f.work_modes, f.countries, f.page, f.per_page, f.sort) == (100, ("remote",), ("IT",), 1, 100, "score")


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def _applications(spark):
    return spark.createDataFrame([(1, "acme widgets", "2024-01-01"), (2, "o'hara-sons", "2024-01-01")], "application_id long, company_normalized string, since string").withColumn("since", F.to_date("since"))


def _messages(spark):
    rows = [("a", "HR <jobs@acmegroup.example>", "Hi", []), ("b", "x@y.example", "Re: O'Hara-Sons & co", []), ("c", "x@y.example", "no one", ["a"]), ("d", "x@y.example", "wid gets", [])]
    return spark.createDataFrame(rows, "message_id string, sender string, subject string, references array<string>").withColumn("sent_at", now())


def test_correlation_sends_no_pieces_through_the_driver(spark):
    known = spark.createDataFrame([(2, "a")], "application_id long, message_id string")
    found = tracking.correlate(_applications(spark), known, _messages(spark))
    assert "Broadcast" not in _plan(found)
    assert {(r.application_id, r.message_id) for r in found.collect()} == {(1, "a"), (2, "b"), (2, "c")}


def test_unseen_sends_no_known_messages_through_the_driver(spark):
    known = spark.createDataFrame([(1, "a")], "application_id long, message_id string")
    related = spark.createDataFrame([(1, "a"), (1, "b"), (1, ""), (2, "a")], "application_id long, message_id string")
    fresh = tracking.unseen(related, known)
    assert "Broadcast" not in _plan(fresh)
    assert sorted(tuple(r) for r in fresh.collect()) == [(1, ""), (1, "b"), (2, "a")]


def test_probes_do_not_go_through_the_driver(spark):
    prints = spark.createDataFrame([("x", v) for v in _clusters(3, 20, 3, 4)], "block string, simhash long").distinct()
    near = resolve.near_prints(prints, prints, F.col("a_simhash") < F.col("b_simhash"))
    near.collect()  # the plan that ran, with sizes known
    joins = re.findall(r"(\w+Join)(?:\(skew=true\))? \[block#\d+, band#\d+, slot#\d+, part#\d+\]", _plan(near))
    assert set(joins) == {"SortMergeJoin"}


def test_first_feed_does_not_depend_on_the_order_of_rows(spark):
    applications = spark.createDataFrame([(1, "submitted", 50, "a_auto")], "match_id long, status string, score long, tier string")
    links = [(1, "src", "LinkedIn", 7, 1), (1, "src", None, 7, 2), (1, "src", "Indeed", 7, 3)]
    for rows in (links, links[::-1]):
        frame = spark.createDataFrame(rows, "match_id long, source string, publisher string, fetched_at int, n int").coalesce(1)
        for arrival, feed in (((), "Indeed"), (("n",), "LinkedIn")):
            found = serve.response_rates(applications, frame, arrival).where("dimension = 'feed'").collect()
            assert [r.label for r in found] == [feed]


def test_prints_are_made_where_the_text_lies(spark, monkeypatch):
    monkeypatch.setattr(resolve, "SHINGLES", 2)
    rows = spark.createDataFrame([(1, None), (2, "?"), (3, "zwei Wörter"), (4, "a b c d e f g")], "id long, t string")
    prints = resolve.simhash(rows, "id", "t")
    assert "Exchange" not in _plan(prints)

    def expected(shingles):
        hashes = [int(hashlib.md5(s.encode()).hexdigest()[:16], 16) for s in shingles]
        return signed(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))

    letters = ["a b c", "b c d", "c d e", "d e f", "e f g"]
    assert {r.id: r.simhash for r in prints.collect()} == {1: 0, 2: 0, 3: expected(["zwei worter"]), 4: expected(letters)}


def test_grams_are_counted_in_the_row_of_their_id(spark):
    """Rows of one id count together, texts are shuffled once and grams never."""
    rows = [(1, "a b a b a"), (1, "a b"), (2, "C++"), (3, ""), (4, None), (None, "x x"), (5, None), (5, "y")]
    counts = retrieve.ngram_counts(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    plan = counts._jdf.queryExecution().sparkPlan().toString()
    assert "gram" not in "".join(line for line in plan.splitlines() if "Aggregate" in line)
    got = {(r.id, r.gram): r.n for r in counts.collect()}
    first = {"a": 4, "b": 3, "a b": 3, "b a": 2, "a b a": 2, "b a b": 1}
    assert got == {**{(1, g): n for g, n in first.items()}, (2, "c++"): 1, (None, "x"): 2, (None, "x x"): 1, (5, "y"): 1}


def test_ids_and_keys_of_a_store_are_not_broadcast(spark):
    """They compress so well that a limit on shuffled bytes sends tables through the driver that grow with the store."""
    rows = spark.createDataFrame([(1, "acme", "acme|dev|", 7, 400)], "id long, company_normalized string, canonical_key string, simhash long, chars long")
    stored = rows.withColumn("is_active", F.lit(True))
    matched = spark.createDataFrame([(1, None)], "id long, stored_id long")
    fresh = resolve.insert_new(rows.withColumns({"source": F.lit("a"), "external_id": F.lit("1")}), matched, now())
    plans = []
    for df in (fresh, resolve.match_stored(rows, stored)):
        assert df.count() == 1 and len(df.collect()) == 1  # sizes are known while it runs
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert "BroadcastHashJoin" not in plans[0]
    assert not re.search(r"BroadcastHashJoin \[(canonical_key|company_normalized)", plans[1])


def test_prints_are_spread_before_they_multiply(spark):
    """Few prints lie in one partition after a grouping; their probes are made in many."""
    prints = spark.range(1000).select(F.lit("b").alias("block"), F.xxhash64("id").alias("simhash"), "id")
    grouped = prints.groupBy("block", "simhash").agg(F.min("id").alias("id"))
    places = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert places(grouped) == 1 and places(resolve.spread_prints(grouped)) > 1


def test_hot_buckets_equal_those_of_probes(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BUCKET_ROWS", 3)
    rng = random.Random(5)
    rows = [(rng.choice("xy"), signed(rng.getrandbits(4) << 60 | rng.getrandbits(3) << 16 | rng.getrandbits(2))) for _ in range(120)]
    nodes = spark.createDataFrame(rows, "block string, simhash long").distinct().cache()
    n = resolve._probes(nodes).groupBy("block", "band", "slot").count().where("count > 3")
    expected = {(r.block, r.band, r.slot, -(-r["count"] // 3)) for r in n.collect()}
    assert {tuple(r) for r in resolve._hot_buckets(nodes).collect()} == expected != set()
