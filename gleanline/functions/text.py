"""Text normalisation as Column -> Column expressions.

Everything here stays in the JVM, so a projection of any number of these fuses into the scan stage.
"""

from __future__ import annotations

import html.entities
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv

# Java's Unicode white space lacks the four ASCII separators that also count as blank here.
_BLANK = r"[\s\x1c-\x1f]"
_FILLED = r"(?U)[^\s\x1c-\x1f]"


def literal_map(entries: dict) -> Column:
    """Constant map column, written as one string so that plans stay small; Catalyst folds it."""
    packed = "\x02".join(f"{key}\x01{value}" for key, value in entries.items())
    constant = F.str_to_map(F.lit(packed), F.lit("\x02"), F.lit("\x01"))
    kind = {int: "bigint", float: "double"}.get(type(next(iter(entries.values()))))
    return constant.cast(f"map<string,{kind}>") if kind else constant


def lookup(entries: dict, key: Column) -> Column:
    """Value of `key` in a constant map, NULL when absent."""
    return F.try_element_at(literal_map(entries), key)


def strip(text: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def empty_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def collapse(text: Column) -> Column:
    """Unix line ends, single spaces, trimmed lines, at most one blank line in a row."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t\u00a0]+", " ")
    text = F.regexp_replace(text, rf"(?U)(?:(?!\n){_BLANK})*\n(?:(?!\n){_BLANK})*", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


@lru_cache(maxsize=2)
def _ascii_foldings(form: str = "NFKD") -> tuple[str, str, dict[str, str]]:
    """Decompositions of a normal form that leave ASCII, read from the Unicode tables.

    Returns the one-to-one pairs as two aligned strings and the one-to-many ones as a map.
    """
    sources, targets, wide = [], [], {}
    for code in range(0xA0, 0x20000):
        char = chr(code)
        folded = unicodedata.normalize(form, char).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            sources.append(char)
            targets.append(folded)
        elif len(folded) > 1:
            wide[char] = folded
    return "".join(sources), "".join(targets), wide


def let(value: Column, use) -> Column:
    """Evaluate `value` once per row and hand it to `use` as a variable."""
    return F.transform(F.array(value), use)[0]


def ascii_fold(text: Column, form: str = "NFKD") -> Column:
    """Decompose and keep the ASCII part. NFKD also spells out ligatures, fractions and the like; NFD only drops accents."""
    sources, targets, wide = _ascii_foldings(form)
    # Ligatures, fractions and squared units expand to several letters. They are rare, so the
    # per-character walk runs only on rows that may hold one (the class is a cheap superset).
    maybe_wide = r"[\u00bc-\u00be\u0132-\uffff\x{10000}-\x{1ffff}]"
    expanded = F.when(
        text.rlike(maybe_wide),
        F.array_join(
            F.transform(F.split(text, ""), lambda c: F.coalesce(lookup(wide, c), c)), ""
        ),
    ).otherwise(text) if wide else text
    folded = F.regexp_replace(F.translate(expanded, sources, targets), r"[^\x00-\x7F]", "")
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(folded)


def comparison_key(text: Column, form: str = "NFKD") -> Column:
    """Accent-free lower-case words separated by single spaces; NULL gives the empty string."""
    # \w is one table lookup per character; the spelled-out class [^a-z0-9_'-] is several times slower.
    words = F.regexp_replace(F.lower(ascii_fold(text, form)), r"[^\w'-]+", " ")
    return F.coalesce(F.trim(words), F.lit(""))


def company_key(name: Column) -> Column:
    """Comparison key without legal-form words; dotted initials are joined first."""
    joined = F.regexp_replace(
        comparison_key(name), r"(?<=^[a-z]| [a-z]) (?=[a-z](?: |$))", ""
    )
    words = F.split(joined, " ")
    kept = F.array_join(F.filter(words, lambda w: ~w.isin(fv.COMPANY_SUFFIXES)), " ")
    return F.when(kept == "", joined).otherwise(kept)


def employer_block(company: Column) -> Column:
    """`company_key`, NULL for the text that feeds give where no employer is declared: such postings are no block."""
    return F.when(F.trim(company) != fv.UNDECLARED_COMPANY, F.nullif(company_key(company), F.lit("")))


def content_hash(text: Column) -> Column:
    return F.sha2(comparison_key(text), 256)


def canonical_key(company: Column, title: Column, city: Column) -> Column:
    """Employer, role and city; absent parts stay as empty fields."""
    return F.concat_ws("|", company_key(company), comparison_key(title), comparison_key(city))


def tidy_title(title: Column) -> Column:
    """Drop a trailing gender marker and the dashes or bars around the title."""
    bare = F.regexp_replace(title, f"(?iU){fv.GENDER_SUFFIX_PATTERN}", "")
    return F.regexp_replace(bare, r"^[ \-–|]+|[ \-–|]+$", "")


# --- HTML --------------------------------------------------------------------------------------


def unescape(text: Column, open_names: bool = True) -> Column:
    """Decode numeric and named character references as HTML5 does.

    Numbers 128 to 159 mean the characters of Windows code page 1252. Without a semicolon only the names that
    HTML5 allows so are decoded, and of those the longest that fits; with `open_names` false, none.
    """
    ended, legacy = _entities()
    open_name = "^(" + "|".join(sorted(legacy, key=lambda n: (-len(n), n))) + ")"
    numeric = r"^#(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));?"

    def decode(piece: Column) -> Column:
        hexadecimal, decimal = (F.nullif(F.regexp_extract(piece, numeric, k), F.lit("")) for k in (1, 2))
        code = F.coalesce(F.conv(hexadecimal, 16, 10), decimal).cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        written = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        char = F.when(code.between(128, 159), F.coalesce(lookup(_windows(), code.cast("string")), written)).when(valid, written)
        name = F.nullif(F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]*);", 1), F.lit(""))
        named = lookup(ended, name)
        start = F.nullif(F.regexp_extract(piece, open_name, 1), F.lit(""))
        return (
            F.when(char.isNotNull(), F.concat(char, F.regexp_replace(piece, numeric, "")))
            .when(named.isNotNull(), F.concat(named, F.substr(piece, F.length(name) + 2)))
            .when(F.lit(open_names) & start.isNotNull(), F.concat(lookup(legacy, start), F.substr(piece, F.length(start) + 1)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    pieces = F.split(text, "&")
    decoded = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(decode(p)))
    return F.when(text.contains("&"), F.array_join(decoded, "")).otherwise(text)


@lru_cache(maxsize=1)
def _entities() -> tuple[dict[str, str], dict[str, str]]:
    """Names that a semicolon ends, and names that need none, with their characters."""
    both = html.entities.html5
    return {n[:-1]: c for n, c in both.items() if n.endswith(";")}, {n: c for n, c in both.items() if not n.endswith(";")}


@lru_cache(maxsize=1)
def _windows() -> dict[str, str]:
    decoded = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
    return {str(n): c for n, c in decoded.items() if c}


def html_to_text(raw: Column, open_names: bool = True) -> Column:
    """Readable text of an HTML fragment: list items become dashes, blocks become lines.

    Names of characters without a semicolon stay as they are if `open_names` is false.

    Regular-expression form, good for well-formed markup. `sources.markup.html_to_text_strict`
    walks the tags with a real parser instead.
    """
    breaking = "|".join(t for t in fv.BREAKING_TAGS if t != "br")
    text = F.regexp_replace(raw, r"(?s)<!--.*?-->|<![^>]*>", "")
    for tag in fv.DROPPED_TAGS:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    text = F.regexp_replace(text, r"(?i)<li\b[^>]*>", "\n- ")
    text = F.regexp_replace(text, rf"(?i)</(?:{breaking})\s*>|<br\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    return collapse(
        F.when(raw.contains("<"), unescape(text, open_names)).otherwise(F.coalesce(raw, F.lit("")))
    )


# --- labels ------------------------------------------------------------------------------------


def feed_label(value: Column) -> Column:
    """One spelling per known portal; unknown names pass through trimmed."""
    key = F.regexp_replace(F.lower(strip(value)), r"^www\.", "")
    key = F.regexp_replace(key, fv.FEED_DOMAIN_PATTERN, "")
    key = F.regexp_replace(key, "[^a-z0-9]", "")
    return F.coalesce(lookup(fv.FEED_LABELS, key), strip(value))


def score_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), "assente")
        .when(score >= 60, "alto")
        .when(score >= 45, "medio")
        .otherwise("basso")
    )


def title_case(text: Column) -> Column:
    """Capital after every non-letter."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def calm_capitals(name: Column) -> Column:
    """Title-case a name written all in capitals; leave any other alone."""
    shouting = (F.upper(name) == name) & (F.lower(name) != name)
    return F.when(shouting, title_case(name)).otherwise(name)


def output_language(lang: Column) -> Column:
    code = F.substring(F.lower(strip(lang)), 1, 2)
    return F.when(code.isin(fv.OUTPUT_LANGUAGES), code).otherwise(fv.DEFAULT_OUTPUT_LANGUAGE)


def slug(text: Column) -> Column:
    """ASCII kebab-case; empty when nothing is left."""
    dashed = F.regexp_replace(F.lower(ascii_fold(text)), r"[\W_]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def distinct_slugs(slugs: Column) -> Column:
    """Make an array of slugs unique in order: repeats get -2, -3, ... (first free number)."""
    empty = F.array().cast("array<string>")

    def step(taken: Column, wanted: Column) -> Column:
        numbered = F.transform(
            F.sequence(F.lit(2), F.size(taken) + 2), lambda n: F.concat(wanted, F.lit("-"), n)
        )
        free = F.filter(numbered, lambda s: ~F.array_contains(taken, s))
        chosen = F.when(F.array_contains(taken, wanted), free[0]).otherwise(wanted)
        return F.array_append(taken, chosen)

    return F.aggregate(slugs, empty, step)


# --- extraction quality ------------------------------------------------------------------------


def clean_extraction(text: Column) -> Column:
    """Undo line-break hyphens and collapse blanks of text taken out of a document."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.translate(text, "\u00a0", " ")
    text = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(text, rf"(?U)(?:(?!\n){_BLANK})*(\n)(?:(?!\n){_BLANK})*", "$1"))


def word_integrity(text: Column) -> Column:
    """Share of letter runs of plausible length; zero without any."""

    def share(words: Column) -> Column:
        plausible = F.filter(words, lambda w: F.length(w) <= fv.MAX_PLAUSIBLE_WORD)
        return F.when(F.size(words) > 0, F.size(plausible) / F.size(words)).otherwise(0.0)

    return let(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), 1), share)


def numeric_tokens(text: Column) -> Column:
    """Distinct numeric tokens, sorted."""
    tokens = F.regexp_extract_all(text, F.lit(f"({fv.NUMERIC_TOKEN_PATTERN})"), 1)
    return F.array_sort(F.array_distinct(tokens))


def prose_quality(text: Column) -> Column:
    """How much an extraction looks like prose: line length, letters, few fragments."""
    # A line is filled if a character that is not blank is found, which its first one mostly is; nothing is stripped.
    filled = F.filter(F.split(text, "\n"), lambda line: line.rlike(_FILLED))
    letters = F.length(F.regexp_replace(text, r"(?U)[^\p{L}\s]+", ""))

    def shape_of(lines: Column) -> Column:
        count = F.size(lines)
        characters = F.aggregate(lines, F.lit(0).cast("long"), lambda total, line: total + F.length(line))
        short = F.size(F.filter(lines, lambda line: F.length(line) <= 3))
        return F.struct(count.alias("count"), characters.alias("characters"), short.alias("short"))

    def quality_of(shape: Column) -> Column:
        quality = (
            F.least(shape["characters"] / shape["count"], F.lit(80.0)) / 80 * 0.5
            + letters / F.length(text) * 0.4
            + (1 - shape["short"] / shape["count"]) * 0.1
        )
        return F.when(shape["count"] > 0, quality).otherwise(0.0)

    return let(let(filled, shape_of), quality_of)
