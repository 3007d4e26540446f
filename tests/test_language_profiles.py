"""Languages by rank profiles: bounds, unknown languages, awkward texts."""

import pytest
from pyspark.sql import functions as F

from gleanline.operators import language_profiles

SAMPLES = {
    "en": "We are looking for an experienced software developer to join the team and to work with the other people in the company on the new products. ",
    "de": "Wir suchen einen erfahrenen Entwickler für die Arbeit in unserem Unternehmen und mit den Kollegen in der Stadt an neuen Produkten. ",
    "it": "Cerchiamo uno sviluppatore con esperienza per lavorare nella nostra azienda con gli altri colleghi della sede e sui nuovi prodotti. ",
}
OTHER = {
    "en": "The role is open to all who have worked in a team before and who want to learn more about the business of the company.",
    "de": "Die Stelle ist für alle offen, die schon in einer Gruppe gearbeitet haben und mehr über das Unternehmen lernen wollen.",
    "it": "La posizione è aperta a chi ha già lavorato in gruppo e vuole imparare di più sulle attività della nostra azienda.",
    "fi": "Haemme ohjelmistokehittäjää Helsinkiin, osaamista tarvitaan tietokannoista ja ohjelmoinnista, työ on vakituinen.",
    "tr": "Şirketimiz için deneyimli yazılım geliştirici arıyoruz, adayların veritabanı konusunda bilgi sahibi olması gerekir.",
    "ru": "Мы ищем опытного разработчика программного обеспечения для работы в нашей компании, знание баз данных обязательно.",
}


@pytest.fixture(scope="module")
def known(spark):
    rows = [(lang, text) for lang, text in SAMPLES.items()] + [(None, "nobody said"), ("en", None), ("xx", "")]
    return language_profiles.profiles(spark.createDataFrame(rows, "lang string, text string")).cache()


def test_known_languages_are_found_and_unknown_ones_are_null(spark, known):
    rows = spark.createDataFrame(list(OTHER.items()), "id string, text string")
    found = {r.id: r.lang for r in language_profiles.detect(rows, known, "id", "text").collect()}
    assert found == {"en": "en", "de": "de", "it": "it", "fi": None, "tr": None, "ru": None}


def test_awkward_texts(spark, known):
    rows = [("null", None), ("empty", ""), ("short", "the team and the company"), ("signs", "12 34 !! ?? " * 10), ("long word", "x" * 200_000), ("long", OTHER["de"] * 500)]
    found = {r.id: r.lang for r in language_profiles.detect(spark.createDataFrame(rows, "id string, text string"), known, "id", "text").collect()}
    assert found == {"null": None, "empty": None, "short": None, "signs": None, "long word": None, "long": "de"}


def test_a_close_call_is_null(spark):
    same = spark.createDataFrame([("a", SAMPLES["en"]), ("b", SAMPLES["en"])], "lang string, text string")
    known = language_profiles.profiles(same)
    rows = spark.createDataFrame([(1, SAMPLES["en"])], "id long, text string")
    assert language_profiles.detect(rows, known, "id", "text").first().lang is None


def test_grams_of_a_word(spark):
    row = spark.range(1).select(language_profiles.grams(F.lit("àb")).alias("g")).first()
    assert row.g == ["à", "b", " à", "àb", "b ", " àb", "àb "]


def test_only_texts_are_shuffled(spark):
    known = spark.createDataFrame([("en", "the", 1)], "lang string, gram string, place int")
    rows = spark.createDataFrame(list(OTHER.items()), "id string, text string")
    plan = language_profiles.distances(rows, known, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1


def test_grams_are_counted_inside_the_row(spark):
    rows = spark.createDataFrame(list(OTHER.items()), "id string, text string")
    known = spark.createDataFrame([("en", "the", 1)], "lang string, gram string, place int")
    plan = language_profiles.distances(rows, known, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row for each word or n-gram, which a task would sort and spill


def test_distances_equal_counting_by_rows(spark, known):
    """Two texts of one id are one; places follow count, then the n-gram's characters."""
    texts = [("two", OTHER["en"]), ("two", OTHER["it"]), ("de", OTHER["de"]), ("astral", "𝔞𝔟𝔠 𝔟 the of and " * 9), ("one", "the " * 20)]
    rows = spark.createDataFrame(texts, "id string, text string")
    own = language_profiles._ranked(language_profiles.counts(rows, "id", "text"), "id", language_profiles.PLACES).withColumnRenamed("place", "own")
    profile, places = known.collect(), {}
    for r in own.collect():
        places.setdefault(r.id, {})[r.gram] = r.own
    expected = {}
    for ident, mine in places.items():
        for lang in {r.lang for r in profile}:
            met = [language_profiles.PLACES - abs(mine[r.gram] - r.place) for r in profile if r.lang == lang and r.gram in mine]
            if met:
                expected[ident, lang] = 1 - sum(met) / (len(mine) * language_profiles.PLACES)
    found = {(r.id, r.lang): r.distance for r in language_profiles.distances(rows, known, "id", "text").collect()}
    assert found == pytest.approx(expected, abs=1e-12)
