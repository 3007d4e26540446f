"""Tolerant dates: ISO text, epochs, relative phrases, year-months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import strip

_ISO = (
    r"^(\d{4})-?(\d{2})-?(\d{2})"
    r"(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?)?(?:Z|([+-]\d{2})(?::?(\d{2}))?)?)?$"
)


def parse_iso(text: Column) -> Column:
    """ISO 8601 with or without time and zone; no zone means UTC; anything else is NULL."""
    value = strip(text)

    def part(group: int, default: str = "00") -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(value, _ISO, group), F.lit("")), F.lit(default))

    rebuilt = F.concat(
        part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit(" "),
        part(4), F.lit(":"), part(5), F.lit(":"), part(6), F.lit("."), part(7, "0"),
        part(8, "+00"), F.lit(":"), part(9),
    )
    return F.when(value.rlike(_ISO), rebuilt.try_cast("timestamp"))


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds; zero means unknown."""
    return F.timestamp_seconds(F.nullif(seconds.cast("double"), F.lit(0.0)))


def from_epoch_millis(millis: Column) -> Column:
    return F.timestamp_millis(F.nullif(millis.cast("long"), F.lit(0).cast("long")))


def _any_of(text: Column, words: list[str]) -> Column:
    # One pattern instead of a chain of contains(): a single pass over the text.
    return text.rlike("|".join(words))


def relative_date(text: Column, now: Column) -> Column:
    """"4 giorni fa", "vor 5 Tagen", "yesterday": a time before `now`; NULL if not understood."""
    phrase = F.lower(strip(text))
    digits = F.regexp_extract(phrase, "([0-9]+)", 1)
    words = F.regexp_extract_all(phrase, F.lit(r"(?U)([^\W\d_]+)"), 1)
    one = F.exists(words, lambda w: w.isin(fv.ONE_WORDS))
    quantity = F.when(digits != "", digits.try_cast("double")).when(one, 1.0)
    days = F.when(_any_of(phrase, fv.TODAY_WORDS), 0.0).when(
        _any_of(phrase, fv.YESTERDAY_WORDS), 1.0
    )
    for prefixes, length in fv.TIME_UNITS:
        days = days.when(_any_of(phrase, prefixes), quantity * length)
    micros = F.round(days * 86_400_000_000).cast("long")
    return F.timestamp_micros(F.unix_micros(now) - micros)


def elapsed_days(since: Column, until: Column) -> Column:
    """Whole elapsed days, floored; not calendar days."""
    return F.floor((F.unix_micros(until) - F.unix_micros(since)) / 86_400_000_000)


def elapsed_minutes(since: Column, until: Column) -> Column:
    return F.floor((F.unix_micros(until) - F.unix_micros(since)) / 60_000_000)


def ago_label(minutes: Column) -> Column:
    """Coarse distance in time."""
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return (
        F.when(minutes.isNull(), "mai")
        .when(minutes < 1, "adesso")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min fa")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" h fa")))
        .when(days == 1, "ieri")
        .otherwise(F.concat(days.cast("string"), F.lit(" g fa")))
    )


def year_month(text: Column) -> Column:
    """YYYY-MM from the usual spellings; ongoing words are NULL, unknown text is kept."""
    value = strip(text)
    year_first = r"^(\d{4})(?:-(\d{1,2})(?:-\d{1,2})?|[/.](\d{1,2}))$"
    month_first = r"^(\d{1,2})[/.](\d{4})$"
    year = F.when(value.rlike(year_first), F.regexp_extract(value, year_first, 1)).when(
        value.rlike(month_first), F.regexp_extract(value, month_first, 2)
    )
    month = F.when(
        value.rlike(year_first),
        F.concat(F.regexp_extract(value, year_first, 2), F.regexp_extract(value, year_first, 3)),
    ).when(value.rlike(month_first), F.regexp_extract(value, month_first, 1))
    number = month.try_cast("int")
    return (
        F.when(F.lower(value).isin(fv.ONGOING_WORDS), F.lit(None))
        .when(value.rlike(r"^\d{4}$"), F.concat(value, F.lit("-01")))
        .when(number.between(1, 12), F.concat(year, F.lit("-"), F.lpad(number.cast("string"), 2, "0")))
        .otherwise(value)
    )


def month_ordinal(text: Column) -> Column:
    """Months since year zero of a YYYY-MM string."""
    year = F.regexp_extract(text, r"^(\d{4})-(\d{2})$", 1).try_cast("int")
    month = F.regexp_extract(text, r"^(\d{4})-(\d{2})$", 2).try_cast("int")
    return year * 12 + month
