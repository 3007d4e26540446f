"""Builders of DuckDB expressions that say the same as the Column functions."""

from __future__ import annotations

import re

from ..functions import fixed_values as fv


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def array(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def case_map(entries: dict, key: str) -> str:
    arms = " ".join(
        f"WHEN {quote(k)} THEN {quote(v) if isinstance(v, str) else v}" for k, v in entries.items()
    )
    return f"CASE {key} {arms} END"


def key(x: str) -> str:
    ascii_text = f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"
    return f"coalesce(trim(regexp_replace(lower({ascii_text}), '[^a-z0-9_''-]+', ' ', 'g')), '')"


def company(x: str) -> str:
    marked = f"regexp_replace(' ' || replace({key(x)}, ' ', '  ') || ' ', ' ([a-z]) ', '<\\1>', 'g')"
    joined = f"trim(regexp_replace(replace({marked}, '><', ''), '[<> ]+', ' ', 'g'))"
    kept = (
        f"array_to_string(list_filter(string_split({joined}, ' '), "
        f"lambda w: NOT list_contains({array(fv.COMPANY_SUFFIXES)}, w)), ' ')"
    )
    return f"CASE WHEN {kept} = '' THEN {joined} ELSE {kept} END"


def pattern(rule: str) -> str:
    """RE2 has ASCII word boundaries; spell them as Unicode non-word neighbours."""

    def boundary(match: re.Match) -> str:
        before, after = rule[: match.start()], rule[match.end() :]
        opening = (not before or before[-1] in "|(") and after[:1] not in ("", "|", ")")
        return r"(?:^|[^\pL\pN_])" if opening else r"(?:$|[^\pL\pN_])"

    return quote("(?i)" + re.sub(r"\\b", boundary, rule))


def matches(x: str, rule: str) -> str:
    return f"coalesce(regexp_matches({x}, {pattern(rule)}), false)"


def first_match(rules, x: str) -> str:
    return "CASE " + " ".join(f"WHEN {matches(x, p)} THEN {quote(label)}" for label, p in rules) + " END"


def tidy_title(x: str) -> str:
    bare = f"regexp_replace({x}, '(?i){fv.GENDER_SUFFIX_PATTERN}', '')"
    return f"trim({bare}, ' -–|')"


def work_mode(title: str, location: str, remote: str, text: str) -> str:
    head = f"({title} || chr(10) || coalesce({location}, ''))"
    opening = text
    return f"""CASE WHEN {matches(head, fv.HYBRID_PATTERN)} THEN 'hybrid'
      WHEN {remote} AND {matches(opening, fv.HYBRID_PATTERN)} THEN 'hybrid'
      WHEN {remote} THEN 'remote' WHEN {matches(head, fv.REMOTE_PATTERN)} THEN 'remote'
      WHEN {matches(head, fv.ONSITE_PATTERN)} THEN 'on_site' WHEN NOT {remote} THEN 'on_site'
      WHEN {matches(opening, fv.HYBRID_PATTERN)} THEN 'hybrid'
      WHEN {matches(opening, fv.REMOTE_PATTERN)} THEN 'remote' ELSE 'unknown' END"""


def contract_type(hint: str, title: str, text: str) -> str:
    stated = f"(coalesce({hint}, '') || ' ' || {title})"
    opening = text
    return (
        f"coalesce({first_match(fv.CONTRACT_RULES, stated)}, "
        f"{first_match(fv.CONTRACT_RULES, opening)}, 'unknown')"
    )


def seniority(hint: str, title: str) -> str:
    return (
        f"coalesce({first_match(fv.SENIORITY_RULES, hint)}, "
        f"{first_match(fv.SENIORITY_RULES, title)}, 'unknown')"
    )


def location_parts(raw: str) -> str:
    spaced = f"regexp_replace({raw}, '\\s+[-–]\\s+', ',', 'g')"
    return (
        f"list_filter(list_transform(string_split(replace({spaced}, '/', ','), ','), "
        "lambda p: trim(p)), lambda p: p <> '')"
    )


def country_of(parts: str) -> str:
    return case_map(fv.COUNTRY_NAMES, key(f"{parts}[-1]"))


def amounts(text: str) -> str:
    """Positive numbers of a salary text."""
    digits = "rtrim(regexp_replace(r, '\\s*[kK]?$', ''))"
    k = "regexp_matches(r, '[kK]$')"
    last = f"regexp_extract({digits}, '([^.,]*)$', 1)"
    whole = f"regexp_replace(regexp_extract({digits}, '^(.*)[.,]', 1), '[.,]', '', 'g')"
    plain = (
        f"CASE WHEN NOT regexp_matches({digits}, '[.,]') THEN {digits} "
        f"WHEN NOT {k} AND length({last}) = 3 THEN {whole} || {last} ELSE {whole} || '.' || {last} END"
    )
    value = f"TRY_CAST({plain} AS DOUBLE) * CASE WHEN {k} THEN 1000.0 ELSE 1.0 END"
    found = f"regexp_extract_all({text}, '\\d[\\d.,]*\\s*[kK]?')"
    return f"list_filter(list_transform({found}, lambda r: {value}), lambda v: v > 0)"


def infer_period(x: str) -> str:
    return f"CASE WHEN {x} >= {fv.MIN_YEARLY} THEN 'yearly' WHEN {x} <= {fv.MAX_HOURLY} THEN 'hourly' END"


def eur(amount: str, currency: str, period: str, months: str = "12") -> str:
    yearly = (
        f"CASE {period} WHEN 'hourly' THEN {amount} * {fv.HOURS_PER_YEAR} WHEN 'daily' THEN {amount} * "
        f"{fv.DAYS_PER_YEAR} WHEN 'monthly' THEN {amount} * {months} WHEN 'yearly' THEN {amount} END"
    )
    rate = "CAST(" + case_map(fv.EUR_RATES, f"upper({currency})") + " AS DOUBLE)"
    return f"CASE WHEN {amount} <> 0 THEN CAST(round_even(CAST({yearly} AS DOUBLE) * {rate}, 0) AS BIGINT) END"


def stated_currency(text: str) -> str:
    arms = " ".join(
        f"WHEN contains({text}, {quote(s)}) THEN {quote(c)}" for s, c in fv.CURRENCY_SYMBOLS.items()
    )
    codes = f"upper(regexp_extract({text}, '(?i){fv.CURRENCY_CODE_PATTERN}', 1))"
    return f"CASE {arms} ELSE nullif({codes}, '') END"


def band(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN 'assente' WHEN {x} >= 60 THEN 'alto' "
        f"WHEN {x} >= 45 THEN 'medio' ELSE 'basso' END"
    )


def elapsed_days(since: str, until: str) -> str:
    return f"CAST(floor((epoch_us({until}) - epoch_us({since})) / 86400000000.0) AS BIGINT)"


def terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {quote(fv.TERM_PATTERN)})"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"
