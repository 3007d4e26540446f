"""The catalogue as a whole: registered names, twins, plans."""

import contextlib
import io
import itertools
import re
from datetime import datetime
from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
QUERIES, TWINS = entry.queries(), entry.oracle_sql()

needs_data = pytest.mark.skipif(not Path(SMALL).exists(), reason="driver tables are not here")


def plan(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES)
    assert len(QUERIES) >= 165


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", ["n03_comparison_key", "n17_salary_choice", "n19_normalise", "f02_first_reason", "r08_cosine", "s14_feed_workable", "v02_numbers"])
def test_plans_stay_in_the_jvm(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "Python" not in text and "InPandas" not in text


@needs_data
@pytest.mark.parametrize("name", ["f13_experience_months", "r13_finalists", "s18_cap_per_feed", "t12_daily_cap", "d03_same_key", "w13_response_rates"])
def test_no_window_over_everything(spark, name):
    text = plan(QUERIES[name](spark, SMALL), "simple")
    assert not re.search(r"Window \[[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", text)


@needs_data
@pytest.mark.parametrize("name", ["s18_cap_per_feed", "t12_daily_cap"])
def test_ranked_windows_are_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, SMALL), "simple")


@needs_data
@pytest.mark.parametrize("name", [n for n in QUERIES if n[0] in "dt" or n.startswith(("v0", "c02", "c03"))])
def test_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SMALL), "simple")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["w15_usage_summary"](spark, SMALL))
    assert "PushedFilters" in text and "props" in text
    text = plan(QUERIES["t12_daily_cap"](spark, SMALL))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def twin_rows(spark, folder, name):
    """Rows of a query and of its SQL over the tables in `folder`."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in folder.iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    found, asked = QUERIES[name](spark, str(folder)), con.execute(TWINS[name])
    columns = [c[0] for c in asked.description]
    assert sorted(found.columns) == sorted(columns)
    return sorted(map(tuple, found.select(columns).collect()), key=str), sorted(asked.fetchall(), key=str)


@pytest.fixture
def odd_documents(spark, tmp_path):
    """Texts without words, and characters that have an ASCII form only by compatibility."""
    texts = [None, "", " ", "?!...", "ß", "é", "two wörds", "an…end ﬁne 1½ x² y", "Ǆ ａ ① K", "it's so - so on"]
    rows = [(i, text, [None, "en", "de"][i % 3], "web", None) for i, text in enumerate(t for t in texts for _ in range(2))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return tmp_path


def test_prints_of_odd_texts_equal_the_sql(spark, odd_documents):
    for name in ("d01_simhash", "d02_hamming"):
        found, expected = twin_rows(spark, odd_documents, name)
        assert found == expected


def test_new_rows_of_odd_texts_equal_the_sql(spark, odd_documents):
    found, expected = twin_rows(spark, odd_documents, "d10_insert_new")
    assert found == expected and found


def test_first_feeds_of_links_with_nulls_equal_the_sql(spark, tmp_path):
    stamp = datetime(2024, 1, 2)
    kinds = list(itertools.product((None, 1, 2), (1, 2), (None, stamp)))
    links = [(i, *kind) for i, pair in enumerate(itertools.permutations(kinds, 2)) for kind in pair]
    orders = [(i, 1, "O", stamp, "1-URGENT") for i in range(len(links) // 2)]
    tables = {
        "lineitem": (links, "l_orderkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"),
        "customer": ([(1, "Customer#1")], "c_custkey long, c_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    found, expected = twin_rows(spark, tmp_path, "w13_response_rates")
    assert found == expected and found
