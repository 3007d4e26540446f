"""What is kept from day to day equals what is worked out at once."""

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from gleanline.operators import kept, resolve
from gleanline.operators.snapshot import Snapshot

SCHEMA = "id long, canonical_key string, company_normalized string, simhash long, chars int"


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def postings(seed, n):
    """Clusters of near prints in three blocks, one with a third of all rows, copies, shared and empty keys."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(n):
        value = centres[0] if rng.random() < 0.3 else rng.choice(centres)
        for bit in rng.sample(range(64), rng.randint(0, 9)):
            value ^= 1 << bit
        block = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "", None])
        key = rng.choice(["||", None, f"k{rng.randrange(n)}", f"k{rng.randrange(6)}|x|"])
        rows.append((i, key, block, signed(value), rng.choice([10, 300, 900])))
    return rows


def brute_groups(rows):
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            same_key = a[1] is not None and a[1] == b[1] and a[1].replace("|", "")
            near = a[2] and a[2] == b[2] and min(a[4], b[4]) >= 300 and bin((a[3] ^ b[3]) & (2**64 - 1)).count("1") <= 10
            if a[0] < b[0] and (same_key or near):
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.fixture(scope="module")
def rows():
    return postings(3, 160)


def test_days_give_the_groups_of_one_batch(spark, rows):
    """Ids arrive in any order, a day may be empty and postings may come again."""
    shuffled = random.Random(1).sample(rows, len(rows))
    state = kept.Groups.start(spark)
    for day in (shuffled[:70], [], shuffled[70:75], shuffled[60:]):
        state = state.add_day(spark.createDataFrame(day, SCHEMA))
    expected = brute_groups(rows)
    assert {r.id: r.root for r in state.parents.collect()} == expected
    assert len(set(expected.values())) < len(rows) * 2 / 3
    whole = resolve.group_postings(spark.createDataFrame(rows, SCHEMA))
    assert {r.id: r.group_id for r in whole.collect()} == expected


def test_only_changed_roots_are_written(spark):
    parents = spark.createDataFrame([(i, i // 10 * 10) for i in range(100)], "id long, root long")
    edges = spark.createDataFrame([(25, 47), (200, 201), (201, 99)], "src long, dst long")
    new = spark.createDataFrame([(200,), (201,), (202,)], "id long")
    changes = {r.id: r.root for r in kept.extend_components(parents, new, edges).collect()}
    assert changes == {i: 20 for i in range(40, 50)} | {200: 90, 201: 90, 202: 202}


def test_kept_matching_equals_the_store(spark, rows):
    stored = spark.createDataFrame(rows[:100], SCHEMA).withColumn("is_active", F.col("id") % 5 != 0)
    incoming = spark.createDataFrame(rows[100:], SCHEMA)
    index = kept.PrintIndex(spark)
    for half in (0, 1):  # two appends
        index.add(stored.where(F.col("id") % 2 == half).select(F.col("company_normalized").alias("block"), "simhash", "id"))
    keys = stored.groupBy("canonical_key").agg(F.min("id").alias("id"))
    got = kept.match_kept(incoming, keys, stored.where("is_active").select("id"), index).collect()
    want = resolve.match_stored(incoming, stored).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r.matched_by for r in want} == {"key", "content", "new"}


def test_near_prints_of_an_index_equal_brute_force(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    stored = [signed(base)] + [signed(base ^ sum(1 << b for b in rng.sample(range(64), k))) for k in range(1, 14) for _ in range(12)]
    index = kept.PrintIndex(spark)
    index.add(spark.createDataFrame([("b", p, i) for i, p in enumerate(stored)] + [("c", signed(base), 999)], "block string, simhash long, id long"))
    asked = spark.createDataFrame([("b", signed(base)), ("z", signed(base))], "block string, simhash long")
    got = {(r.near_id, r.distance) for r in index.near(asked).collect()}
    distance = lambda p: bin((p ^ signed(base)) & (2**64 - 1)).count("1")
    assert got == {(i, distance(p)) for i, p in enumerate(stored) if distance(p) <= 10}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_only_asked_buckets_are_opened(spark):
    index = kept.PrintIndex(spark)
    rng = random.Random(5)
    index.add(spark.createDataFrame([(f"b{i}", signed(rng.getrandbits(64)), i) for i in range(300)], "block string, simhash long, id long"))
    shown = plan(index.near(spark.createDataFrame([("b7", 5)], "block string, simhash long")))
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = \d+", shown)


@pytest.fixture
def table(spark):
    first = spark.range(2000).select("id", F.lit("old").alias("state"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("n"))
    return Snapshot(first, ["id"], buckets=64)


def put(rows, news):
    both = rows.join(news.select("id", F.col("state").alias("new")), "id", "full")
    return both.select("id", F.coalesce("new", "state").alias("state"), "n")


def files(table):
    return {p for p in table._read().inputFiles()}


def test_an_update_writes_its_buckets_only(spark, table):
    before = files(table)
    news = spark.createDataFrame([(i, "new") for i in range(0, 2000, 100)] + [(5000, "new")], "id long, state string")
    log = sorted((r.id, r.change) for r in table.update(news, put).collect())
    assert log == sorted([(i, "update") for i in range(0, 2000, 100)] + [(5000, "insert")])
    assert len(before & files(table)) >= 64 - 21
    rows = {r.id: (r.state, r.n) for r in table.read().collect()}
    assert len(rows) == 2001 and rows[100] == ("new", 100) and rows[101] == ("old", None) and rows[5000] == ("new", None)


def test_replaying_the_log_gives_the_table(spark, table):
    for state, ids in (("a", [1, 2, 3]), ("b", [3, 4, 9000]), ("b", [4])):
        table.update(spark.createDataFrame([(i, state) for i in ids], "id long, state string"), put)
    assert sorted(map(tuple, table.replay().collect()), key=str) == sorted(map(tuple, table.read().collect()), key=str)
    assert table.log(3).count() == 0  # it said what was known
    second = {r.id: r.state for r in table.replay(1).collect()}
    assert second[3] == "a" and second[4] == "old" and 9000 not in second


def test_an_update_without_rows(spark, table):
    before = files(table)
    assert table.update(spark.createDataFrame([], "id long, state string"), put).count() == 0
    assert files(table) == before


def test_asked_values_are_not_kept(spark, monkeypatch):
    """What is written before the join is the prints, not their 548 band values."""
    written = []
    monkeypatch.setattr(kept, "cut_lineage", lambda df: written.append(df.count()) or df)
    index = kept.PrintIndex(spark)
    index.add(spark.createDataFrame([("x", 1, 1)], "block string, simhash long, id long"))
    near = index.near(spark.createDataFrame([("x", 3), ("x", -1)], "block string, simhash long"))
    assert [(r.simhash, r.near_id, r.distance) for r in near.collect()] == [(3, 1, 1)]
    assert written == [2]
