"""Case tables: input and expected value of every expression."""

import pytest
from pyspark.sql import functions as F

from gleanline.functions import dates, language, numbers, rules, salary, text
from gleanline.sources import raw


def value(spark, build, *inputs):
    """Evaluate an expression of literal columns."""
    names = [f"c{i}" for i in range(len(inputs))]
    kinds = {str: "string", bool: "boolean", float: "double", int: "bigint", type(None): "string"}
    schema = ", ".join(f"{n} {kinds[type(v)]}" for n, v in zip(names, inputs))
    df = spark.createDataFrame([tuple(inputs)], schema) if inputs else spark.range(1)
    return df.select(build(*[F.col(n) for n in names]).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "title, expected",
    [
        ("Full stack developer, Torino", "Fullstack Developer"), ("Software engineer II", "Software Developer"),
        ("iOS developer", "Mobile Developer"), ("Lead machine learning engineer", "Machine Learning Engineer"),
        ("Devops engineer", "DevOps / SRE"), ("Sviluppatore Python", "Software Developer"),
        ("Gardener", None), ("Pizza chef", None),
    ],
)
def test_family(spark, title, expected):
    assert value(spark, rules.job_family, title) == expected


@pytest.mark.parametrize(
    "title, location, remote, description, expected",
    [
        ("Tester", None, True, "A desk by the canal", "remote"),
        ("Tester - hybrid", None, True, "", "hybrid"),
        ("Tester", None, None, "x " * 2000 + "fully remote", "remote"),
        ("Tester", None, None, "We mend bicycles", "unknown"),
        ("Tester", None, True, "three days, hybrid", "hybrid"),
        ("Tester", "in sede", None, "", "on_site"),
        ("Tester", None, False, "remote", "on_site"),
    ],
)
def test_work_mode(spark, title, location, remote, description, expected):
    df = spark.createDataFrame([(title, location, remote, description)], "t string, l string, r boolean, d string")
    assert df.select(rules.work_mode(F.col("t"), F.col("l"), F.col("r"), F.col("d"))).first()[0] == expected


@pytest.mark.parametrize(
    "hint, title, expected",
    [
        ("full-time job", "Tester", "permanent"), ("part-time", "Tester", "part_time"), ("", "Internship in testing", "internship"),
        ("freelance", "Tester", "contract"), ("a tempo determinato", "Tester", "fixed_term"), ("", "Tester", "unknown"),
    ],
)
def test_contract(spark, hint, title, expected):
    assert value(spark, lambda h, t: rules.contract_type(h, t, F.lit("")), hint, title) == expected


@pytest.mark.parametrize(
    "hint, title, expected",
    [
        (None, "Tester, senior", "senior"), (None, "junior tester", "junior"), (None, "Team lead for testing", "lead"),
        (None, "Principal tester", "principal"), (None, "Tester", "unknown"), ("Entry level", "Senior tester", "junior"),
    ],
)
def test_seniority(spark, hint, title, expected):
    assert value(spark, rules.seniority, hint, title) == expected


@pytest.mark.parametrize("title", ["Gärtner (m/w/d)", "Gärtner | h/f", "- Gärtner f/m/d ", "Gärtner"])
def test_tidy_title(spark, title):
    assert value(spark, text.tidy_title, title.rstrip()) == "Gärtner"


@pytest.mark.parametrize(
    "place, declared, expected",
    [
        ("Bari, Italia", None, ("Bari", None, "IT")), ("Leipzig, Germany", None, ("Leipzig", None, "DE")),
        ("Austin, TX", "US", ("Austin", "TX", "US")), ("Germany", None, (None, None, "DE")),
        ("Remote", None, (None, None, None)), (None, "FR", (None, None, "FR")), ("Basel, Germany", "CH", ("Basel", None, "CH")),
    ],
)
def test_location(spark, place, declared, expected):
    assert tuple(value(spark, rules.split_location, place, declared)) == expected


@pytest.mark.parametrize(
    "written, low, high, currency, period, eur_low",
    [
        ("32.500 - 41.000 EUR annui", 32500, 41000, "EUR", "yearly", 32500),
        ("€28.000 all'anno", 28000, None, "EUR", "yearly", 28000),
        ("$100.5K - $120K", 100500, 120000, "USD", "yearly", 92460),
        ("20 €/ora", 20, None, "EUR", "hourly", 34400),
        ("£40,000 per year", 40000, None, "GBP", "yearly", 46800),
        ("2.000 € al mese x 13 mensilità", 2000, None, "EUR", "monthly", 26000),
        ("31.000 - 33.000 annui", 31000, 33000, None, "yearly", None),
    ],
)
def test_salary_text(spark, written, low, high, currency, period, eur_low):
    pay = value(spark, lambda t: salary.parse(t, F.lit(None).cast("string")), written)
    assert (pay["min"], pay["max"], pay["currency"], pay["period"], pay["eur_year_min"]) == (low, high, currency, period, eur_low)


@pytest.mark.parametrize("written", ["", "competitive salary", "salario interessante", None])
def test_silence_is_not_a_salary(spark, written):
    assert value(spark, lambda t: salary.parse(t, F.lit(None).cast("string")), written)["is_stated"] is False


def test_zero_bounds_are_absent(spark):
    pay = value(spark, lambda a, b: salary.from_structured(a, b, F.lit(None).cast("string"), F.lit(None).cast("string")), 0.0, 0.0)
    assert pay["is_stated"] is False


@pytest.mark.parametrize(
    "written, expected",
    [
        ("a&period;b&lpar;c", "a.b(c"), ("1&#150;2", "1–2"), ("&ampx &notit; &notin;", "&x ¬it; ∉"), ("&bogus; & &#0; &#xZ;", "&bogus; & &#0; &#xZ;"),
        ("&eacute&Eacute;&#x1F600;", "éÉ😀"),
    ],
)
def test_character_references(spark, written, expected):
    assert value(spark, text.unescape, written) == expected


def test_html(spark):
    out = value(spark, text.html_to_text, "<p>Cerchiamo:</p><ul><li>Python</li><li>R&amp;D &#233;</li></ul><script>x=1</script>")
    assert "- Python" in out and "- R&D é" in out and "x=1" not in out


@pytest.mark.parametrize(
    "name, expected",
    [("Acme S.r.l.", "acme"), ("ACME GmbH", "acme"), ("Group Holding", "group holding"), ("A. B. Foods", "ab foods"), ("Società Più", "societa piu")],
)
def test_company_key(spark, name, expected):
    assert value(spark, text.company_key, name) == expected


@pytest.mark.parametrize("source, expected", [("Straße ﬁne ½", "strae fine 12"), ("Università", "universita"), (None, ""), ("C++ & co.", "c co")])
def test_comparison_key(spark, source, expected):
    assert value(spark, text.comparison_key, source) == expected


@pytest.mark.parametrize(
    "phrase, days",
    [
        ("4 giorni fa", 4), ("vor 5 Tagen", 5), ("yesterday", 1), ("oggi", 0), ("una settimana fa", 7), ("hace 2 meses", 60),
        ("un giorno fa", 1), ("qualche giorno", None), ("boh", None), ("", None),
    ],
)
def test_relative_date(spark, phrase, days):
    now = F.lit("2024-06-01 12:00:00").cast("timestamp")
    gap = value(spark, lambda p: (F.unix_seconds(now) - F.unix_seconds(dates.relative_date(p, now))) / 86400, phrase)
    assert gap == days


@pytest.mark.parametrize(
    "written, expected",
    [
        ("2024-03-05", "2024-03-05 00:00:00"), ("2024-03-05T10:20:30Z", "2024-03-05 10:20:30"), ("2024-03-05T10:20+02:00", "2024-03-05 08:20:00"),
        ("20240305", "2024-03-05 00:00:00"), ("2024-13-05", None), ("2024", None), ("soon", None), (None, None),
    ],
)
def test_iso(spark, written, expected):
    assert value(spark, lambda t: F.date_format(dates.parse_iso(t), "yyyy-MM-dd HH:mm:ss"), written) == expected


@pytest.mark.parametrize(
    "written, expected",
    [("2024", "2024-01"), ("2024-3", "2024-03"), ("03/2024", "2024-03"), ("2024/03", "2024-03"), ("2024-03-15", "2024-03"), ("presente", None), ("13/2024", "13/2024"), ("spring", "spring")],
)
def test_year_month(spark, written, expected):
    assert value(spark, dates.year_month, written) == expected


@pytest.mark.parametrize(
    "written, expected",
    [
        ("ridotto del 40%", [40.0]), ("da sei ore a venti minuti", [6.0, 20.0]), ("quaranta milioni di righe", [40e6]), ("1.000 utenti", [1000.0]),
        ("1,5 ore", [1.5]), ("40k", [40000.0]), ("all'ottanta per cento", [80.0]), ("ventuno e ventotto", [21.0, 28.0]), ("forty-two", [42.0]), ("niente", []),
    ],
)
def test_numbers(spark, written, expected):
    assert value(spark, numbers.numbers_in, written) == sorted(expected)


@pytest.mark.parametrize(
    "title, keywords, extra, expected",
    [
        ("Bicycle mechanic", ["bicycle courier"], "", True), ("Bicycles and more", ["bicycle courier"], "", True),
        ("Pasticciere", ["bicycle courier"], "", False), ("Senior gardener", ["senior bicycle courier"], "", False),
        ("Night shift", ["courier"], "courier with own van", True), ("Anything", [], "", True),
        ("Iris grower", ["ir"], "", False), ("IR spectroscopy", ["ir"], "", True),
    ],
)
def test_title_filter(spark, title, keywords, extra, expected):
    df = spark.createDataFrame([(title, extra, keywords)], "t string, e string, k array<string>")
    assert df.select(raw.title_matches(F.col("t"), F.col("e"), F.col("k"))).first()[0] is expected


def test_search_keywords_cover_both_languages(spark):
    words = value(spark, lambda h, r: raw.search_keywords(h, F.array(r)), "Software Developer", "Backend Developer")
    assert words == ["software developer", "backend developer", "sviluppatore software", "sviluppatore backend"]


def test_distinct_slugs_skip_taken_numbers(spark):
    out = value(spark, lambda: text.distinct_slugs(F.array(*[F.lit(s) for s in ("a", "a-2", "a", "a")])))
    assert out == ["a", "a-2", "a-3", "a-4"]


@pytest.mark.parametrize("sample, code", [("The quality of the code that we write is important for all of us and for the team", "en"), ("Wir suchen eine Person, die mit uns an der Plattform für den Markt arbeitet und nicht nur", "de"), ("corto", None)])
def test_language(spark, sample, code):
    assert value(spark, language.detect, sample) == code


@pytest.mark.parametrize("minutes, label", [(None, "mai"), (0, "adesso"), (5, "5 min fa"), (125, "2 h fa"), (1500, "ieri"), (3000, "2 g fa")])
def test_ago(spark, minutes, label):
    assert spark.createDataFrame([(minutes,)], "m bigint").select(dates.ago_label(F.col("m"))).first()[0] == label


def test_open_names_can_stay(spark):
    raw = "<p>a&ampb &amp; &copyc &#233;</p>"
    assert value(spark, text.html_to_text, raw) == "a&b & ©c é"
    assert value(spark, lambda c: text.html_to_text(c, open_names=False), raw) == "a&ampb & &copyc é"


def test_prose_quality_cuts_a_text_once(spark):
    """Lines are not stripped to see whether they are filled, and their shape is worked out once for all its uses."""
    rows = [(0, None), (1, ""), (2, "\n \n\t\x1c"), (3, "ab\r \n \nbc d\n\x1f")]
    texts = spark.createDataFrame(rows, "id int, text string")
    made = texts.select("id", text.prose_quality(F.col("text")).alias("q"))
    plan = made._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 1 and plan.count("split(") == 1
    got = {r.id: r.q for r in made.collect()}
    # Two lines of four characters are filled, "ab\\r " and "bc d".
    assert got[0] == got[1] == got[2] == 0.0
    shown = "ab\r \n \nbc d\n\x1f"
    letters = sum(c.isalpha() or c in " \t\n\r\x0b\x0c" for c in shown)
    assert abs(got[3] - (4 / 80 * 0.5 + letters / len(shown) * 0.4 + 0.1)) < 1e-12
