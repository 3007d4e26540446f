"""Numbers named in a text, in digits or in Italian and English words."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import literal_map


def _italian(n: int, spelled: dict[int, list[str]]) -> list[str]:
    """Tens and unit in one word; before a vowel sound the tens drop their last letter."""
    unit = [u for u in spelled[n % 10]]
    return [t[: len(t) - (u[0] in "uo")] + u for t in spelled[n - n % 10] for u in unit]


def _english(n: int, spelled: dict[int, list[str]]) -> list[str]:
    return [f"{t}-{u}" for t in spelled[n - n % 10] for u in spelled[n % 10]]


@lru_cache(maxsize=1)
def number_words() -> dict[str, float]:
    """Every spelling of a number that one token can hold, in either language, with its value."""
    out = {word: float(n) for word, n in fv.HUNDREDS.items()}
    for simple, compound in (
        ({**fv.ITALIAN_UNITS, **fv.ITALIAN_TENS}, _italian),
        ({**fv.ENGLISH_UNITS, **fv.ENGLISH_TENS}, _english),
    ):
        spelled: dict[int, list[str]] = {}
        for word, n in simple.items():
            spelled.setdefault(n, []).append(word)
        # A number between two tens is spelled by both; the others have words of their own.
        between = [n for n in range(21, 100) if n % 10 and n - n % 10 in spelled]
        spelled |= {n: [*spelled.get(n, []), *compound(n, spelled)] for n in between}
        out |= {word: float(n) for n, forms in spelled.items() for word in forms}
    return out


def digits_value(token: Column) -> Column:
    """Groups of exactly three digits are thousands, otherwise the last separator is decimal."""
    bare = F.regexp_replace(token, "[.,]+$", "")
    grouped = bare.rlike(r"^\d+(?:[.,]\d{3})+$") | ~bare.rlike("[.,]")
    whole = F.regexp_replace(F.regexp_extract(bare, "^(.*)[.,]", 1), "[.,]", "")
    decimal = F.concat(whole, F.lit("."), F.regexp_extract(bare, "([^.,]*)$", 1))
    return F.when(grouped, F.regexp_replace(bare, "[.,]", "")).otherwise(decimal).try_cast("double")


def numbers_in(text: Column) -> Column:
    """Sorted distinct values; a following multiplier scales, a rate after "per" is skipped."""
    words, multipliers = number_words(), fv.NUMBER_MULTIPLIERS
    tokens = F.regexp_extract_all(F.lower(text), F.lit(f"({fv.NUMBER_TOKEN_PATTERN})"), 1)

    def value(token: Column, index: Column) -> Column:
        previous, following = F.get(tokens, index - 1), F.get(tokens, index + 1)
        is_rate = token.isin(fv.RATE_WORDS) & F.coalesce(previous == "per", F.lit(False))
        # Membership is a hash probe; the map is read only for the few tokens that are numbers.
        base = F.when(token.rlike("^[0-9]"), digits_value(token)).when(
            token.isin(list(words)) & ~is_rate, F.element_at(literal_map(words), token)
        )
        factor = F.when(
            following.isin(list(multipliers)),
            F.element_at(literal_map({k: float(v) for k, v in multipliers.items()}), following),
        )
        return base * F.coalesce(factor, F.lit(1.0))

    found = F.filter(F.transform(tokens, value), lambda v: v.isNotNull())
    return F.array_sort(F.array_distinct(found))
