"""Pages by position and reads that leave out what they do not need."""

import contextlib
import io
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleanline.operators import serve

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SMALL).exists(), reason="driver tables are not here")


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def pages(spark):
    rows = spark.range(5003).select("id", (F.col("id") * 7919 % 40).alias("score"), F.lit("x").alias("title"))
    order = [F.desc("score"), F.col("id")]
    return rows, order, serve.Pages(rows, order, ranges=50)


@pytest.mark.parametrize("page", [1, 2, 100, 201, 202])
def test_a_page_equals_its_offset_form(pages, page):
    rows, order, kept = pages
    got = [(r.n, r.id) for r in kept.page(page, 25).orderBy("n").collect()]
    want = [r.id for r in serve.page_of(rows, order, page, 25).collect()]
    assert got == [((page - 1) * 25 + k, i) for k, i in enumerate(want, 1)]
    assert kept.last(25) == 201


def test_a_page_reads_its_ranges_only(pages):
    _, _, kept = pages
    for page in (1, 100, 201):
        around, _ = kept.around(page, 25)
        assert around.count() <= 25 + 2 * 5003 / 50 * 2
        assert re.search(r"PartitionFilters: \[[^]]*range#\d+", plan(around))


def test_pages_of_nothing(spark):
    kept = serve.Pages(spark.range(0).select("id"), [F.col("id")])
    assert kept.last(25) == 1 and kept.page(1, 25).count() == 0


@needs_data
@pytest.mark.parametrize("name,absent", [("w06_filter_menus", "text"), ("w07_counters", "text")])
def test_texts_are_not_read(spark, name, absent):
    shown = plan(entry.queries()[name](spark, SMALL))
    assert not any(f"{absent}:string" in s for s in re.findall(r"ReadSchema: (.*)", shown))


@needs_data
def test_conditions_reach_the_scan(spark):
    shown = plan(entry.queries()["w05_match_detail"](spark, SMALL))
    assert "EqualTo(doc_id,0)" in shown


@needs_data
@pytest.mark.parametrize("name", ["r08_cosine", "r09_spread", "w03_page", "w19_run_summary"])
def test_no_cross_joins_here_either(spark, name):
    shown = plan(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in shown and "NestedLoopJoin" not in shown
