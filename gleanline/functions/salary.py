"""Salaries: structured or free text to one comparable yearly figure in euro."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .rules import first_match
from .text import lookup

SALARY_TYPE = (
    "struct<is_stated:boolean,min:bigint,max:bigint,currency:string,period:string,"
    "eur_year_min:bigint,eur_year_max:bigint>"
)


def not_stated() -> Column:
    empty = [F.lit(None).cast(t) for t in ("bigint", "bigint", "string", "string", "bigint", "bigint")]
    names = ["min", "max", "currency", "period", "eur_year_min", "eur_year_max"]
    return F.struct(
        F.lit(False).alias("is_stated"), *[c.alias(n) for c, n in zip(empty, names, strict=True)]
    )


def infer_period(amount: Column) -> Column:
    """Unit of time by magnitude; NULL in the ambiguous middle."""
    return F.when(amount >= fv.MIN_YEARLY, "yearly").when(amount <= fv.MAX_HOURLY, "hourly")


def eur_per_year(amount: Column, currency: Column, period: Column, instalments: Column) -> Column:
    """Comparable figure; NULL whenever amount, currency or period is unknown."""
    yearly = (
        F.when(period == "hourly", amount * fv.HOURS_PER_YEAR)
        .when(period == "daily", amount * fv.DAYS_PER_YEAR)
        .when(period == "monthly", amount * instalments)
        .when(period == "yearly", amount)
    )
    figure = F.bround(yearly * lookup(fv.EUR_RATES, F.upper(currency)))
    return F.when(amount != 0, figure.try_cast("bigint"))


def build(minimum: Column, maximum: Column, currency: Column, period: Column, instalments: Column) -> Column:
    return F.struct(
        F.lit(True).alias("is_stated"),
        F.when(minimum != 0, minimum.try_cast("bigint")).alias("min"),
        F.when(maximum != 0, maximum.try_cast("bigint")).alias("max"),
        currency.alias("currency"),
        period.alias("period"),
        eur_per_year(minimum, currency, period, instalments).alias("eur_year_min"),
        eur_per_year(maximum, currency, period, instalments).alias("eur_year_max"),
    )


def from_structured(minimum: Column, maximum: Column, currency: Column, period: Column) -> Column:
    """Zero or NULL bounds are absent; without either the salary is not stated."""
    low, high = F.nullif(minimum, F.lit(0.0)), F.nullif(maximum, F.lit(0.0))
    reference = F.coalesce(low, high)
    stated = build(
        low,
        high,
        F.upper(F.coalesce(F.nullif(currency, F.lit("")), F.lit("EUR"))),
        F.coalesce(period, infer_period(reference)),
        F.lit(12),
    )
    return F.when(reference.isNotNull(), stated).otherwise(not_stated())


def amount_value(raw: Column) -> Column:
    """A separator before exactly three digits marks thousands, any other marks decimals."""
    thousand = raw.rlike("[kK]$")
    digits = F.rtrim(F.regexp_replace(raw, r"\s*[kK]?$", ""))
    decimals = F.regexp_extract(digits, r"([^.,]*)$", 1)
    whole = F.regexp_replace(F.regexp_extract(digits, r"^(.*)[.,]", 1), "[.,]", "")
    plain = (
        F.when(~digits.rlike("[.,]"), digits)
        .when(~thousand & (F.length(decimals) == 3), F.concat(whole, decimals))
        .otherwise(F.concat(whole, F.lit("."), decimals))
    )
    return plain.try_cast("double") * F.when(thousand, 1000.0).otherwise(1.0)


def amounts(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({fv.AMOUNT_PATTERN})"), 1)
    return F.filter(F.transform(found, amount_value), lambda v: v > 0)


def stated_currency(text: Column) -> Column:
    symbols = list(fv.CURRENCY_SYMBOLS.items())
    chain = F.when(F.contains(text, F.lit(symbols[0][0])), symbols[0][1])
    for symbol, code in symbols[1:]:
        chain = chain.when(F.contains(text, F.lit(symbol)), code)
    codes = F.upper(F.regexp_extract(text, f"(?iU){fv.CURRENCY_CODE_PATTERN}", 1))
    return chain.otherwise(F.nullif(codes, F.lit("")))


def parse(text: Column, default_currency: Column) -> Column:
    """Salary written in free text; text without a positive number is not stated."""
    values = amounts(text)
    low, second = F.get(values, F.lit(0)), F.get(values, F.lit(1))
    period = F.coalesce(first_match(fv.PERIOD_RULES, text), infer_period(low))
    instalments = F.coalesce(
        F.regexp_extract(text, f"(?iU){fv.INSTALMENTS_PATTERN}", 1).try_cast("int"), F.lit(12)
    )
    currency = F.coalesce(
        stated_currency(text), F.nullif(F.upper(default_currency), F.lit(""))
    )
    stated = build(low, F.when(second >= low, second), currency, period, instalments)
    return F.when(low.isNotNull(), stated).otherwise(not_stated())


def choose(structured: Column, text: Column, country: Column) -> Column:
    """Structured fields win; free text reads its currency from the country."""
    parsed = parse(text, lookup(fv.CURRENCY_BY_COUNTRY, F.upper(country)))
    return F.when(structured["is_stated"], structured).otherwise(parsed)


def label(salary: Column) -> Column:
    """Display text: a range only when the bounds differ, never an estimate."""

    def number(value: Column) -> Column:
        return F.translate(F.format_number(value, 0), ",", ".")

    unit = F.concat(
        F.lit(" "),
        F.coalesce(lookup(fv.DISPLAY_SYMBOLS, salary["currency"]), salary["currency"], F.lit("")),
        F.coalesce(
            lookup(fv.DISPLAY_PERIODS, F.coalesce(salary["period"], F.lit("yearly"))), F.lit("")
        ),
    )
    low, high = salary["min"], salary["max"]
    single = F.nullif(F.coalesce(low, high), F.lit(0))
    return (
        F.when(~salary["is_stated"], "n.d.")
        .when(
            (low != 0) & (high != 0) & (low != high),
            F.concat(number(low), F.lit("–"), number(high), unit),
        )
        .when(single.isNotNull(), F.concat(number(single), unit))
        .otherwise("n.d.")
    )
