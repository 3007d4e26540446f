"""Secret scans through a trigram index; DataFrame functions only.

Each rule's regex gives a Boolean query over trigrams: a conjunction of clauses, each a list of alternatives, each a
set of trigrams that must all occur. The inverted index holds (trigram, doc_id) for the trigrams that some rule asks
for. Intersecting its postings leaves the candidates of each rule, and the regex runs on those alone. A rule without
a mandatory trigram runs on every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, store

try:  # the parser of Python's regular expressions
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` (leftmost, not overlapping) whose `group` has `least` characters; shorter ones are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: A private key: its header with all up to the END line, if no other line of five hyphens comes before; where END is
#: missing, with the base64 lines that follow (of 16 characters or more, and a shorter last one). Both repetitions end at
#: 400 lines, twice the length of a 16 384-bit RSA key: Java's regex recurses for each. RE2 allows no counts within them.
KEY = Rule(
    "key",
    r"""-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-(?:-(?:--?)?)?[^-]+){0,400}-{5,}END [A-Z ]*PRIVATE KEY-----"""
    r"""|(?:\s+[A-Za-z0-9-]+: [^\n]*){0,9}(?:[\s\\"'>#,;*|]+"""
    + 15 * "[A-Za-z0-9+/=]"
    + r"""[A-Za-z0-9+/=]+){1,400}(?:\n[A-Za-z0-9+/]{1,15}={0,2}(?m:$))?)?""",
)
#: What the method adds.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    KEY,
)

Clause = frozenset[frozenset[str]]
MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that all hold for every text with a match: some alternative of each has all its trigrams.

    Trigrams are those of the text with A-Z in lower case.
    """
    clauses: list[Clause] = []

    def flush(strings: set[str]) -> None:
        found = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)
        if found and all(found):
            clauses.append(frozenset(x for x in found if not any(y < x for y in found)))

    def strings_of(node) -> set[str] | None:
        """The strings that a node stands for, lower-cased, if they are few."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower() if chr(arg).isascii() else chr(arg)}
        if op is sre.IN:
            out = set()
            for kind, value in arg:
                if kind is not sre.LITERAL:
                    return None
                out.add(chr(value).lower())
            return out if len(out) <= 8 else None
        if op is sre.SUBPATTERN:
            return joined(arg[3])
        if op is sre.BRANCH:
            parts = [joined(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0:2] == (0, 1):
            inner = joined(arg[2])
            return None if inner is None else inner | {""}
        if op is sre.MAX_REPEAT and arg[0] == arg[1] and arg[0] <= 5:
            return joined(list(arg[2]) * arg[0])
        return None

    def joined(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            part = strings_of(node)
            if part is None or len(out) * len(part) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in part}
        return out

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            part = strings_of(node)
            if part is not None and len(run) * len(part) <= MOST_STRINGS:
                run = {a + b for a in run for b in part}
                continue
            flush(run)
            run = part if part is not None else {""}
            if part is None:
                op, arg = node
                if op is sre.SUBPATTERN:
                    walk(arg[3])
                elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                    walk(arg[2])
        flush(run)

    # The flag for either case is all that differs from Java's syntax; lower-casing covers it.
    walk(sre_parse.parse(pattern.replace("(?i:", "(?:")))
    return clauses


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of `docs` (doc_id, text), for the given trigrams of lower-cased texts."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    here = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return docs.select("doc_id", low.alias("low")).select("doc_id", F.explode(here).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[str, list[Clause]]) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query the postings of a document fulfil."""
    held = postings.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))

    def all_of(alternative: frozenset[str]) -> Column:
        return reduce(Column.__and__, [F.array_contains("held", t) for t in sorted(alternative)])

    def any_of(clause: Clause) -> Column:
        return reduce(Column.__or__, [all_of(x) for x in sorted(clause, key=sorted)])

    kinds = F.array(*[F.when(reduce(Column.__and__, map(any_of, q)), F.lit(k)) for k, q in queries.items()])
    return held.select("doc_id", F.array_compact(kinds).alias("kinds")).where(F.size("kinds") > 0)


def _found(rule: Rule, number: int, at: Column) -> Column:
    """One struct per match of a rule: its number, the characters before it since the last match, its length."""
    pattern = F.lit(rule.pattern)
    text = F.when(at, F.col("text"))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.char_length(x))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.char_length(x))
    tested = whole if rule.group == 0 else F.transform(
        F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.char_length(x)
    )
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("len"), tested.alias("group"))
    rows = F.transform(
        F.filter(zipped, lambda x: x["len"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(number).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), (x["group"] >= rule.least).alias("ok")
        ),
    )
    return F.coalesce(rows, F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>"))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and `spans`, an array of (start, kind, end, name) in order, for every row of `docs` (doc_id, text).

    Offsets count code points, the end is exclusive. `kind` is the rule's place in `rules`; spans of different rules
    may overlap. A null text is empty; a text without a match has an empty array. Rows that share a doc_id give a row
    each. The input must list its rows in the same order when a task is repeated, as a scan of files does.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = {kind: q for kind, q in asked.items() if q}
    rows = docs.withColumn("kinds", F.lit(None).cast("array<string>"))
    if indexed:
        trigrams = sorted({t for q in indexed.values() for clause in q for alternative in clause for t in alternative})
        hits = store(candidates(trigram_index(docs, trigrams), indexed))
        rows = docs.join(hits.withColumnRenamed("doc_id", "hit"), F.col("doc_id").eqNullSafe(F.col("hit")), "left")
    found = [
        _found(rule, k, F.array_contains("kinds", rule.kind) if rule.kind in indexed else F.lit(True))
        for k, rule in enumerate(rules)
    ]
    matches = (
        rows.select("rid", "doc_id", F.concat(*found).alias("found"))
        .select("rid", "doc_id", F.inline_outer("found"))
        .repartition("rid")
    )
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = matches.withColumn("end", F.sum((F.col("gap") + F.col("len")).cast("long")).over(upto))
    name = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind") + 1)
    span = F.struct((F.col("end") - F.col("len")).alias("start"), "kind", "end", name.alias("name"))
    return ended.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("ok"), span))).alias("spans")).drop("rid")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def digest(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["name"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return spans.select(
        "doc_id",
        *[count(rule.kind).alias(f"n_{rule.kind}") for rule in BASE],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def _hidden(rule: Rule) -> Column:
    """`text` with the rule's name in brackets for each of its secrets."""
    cut = F.arrays_zip(
        F.split("text", rule.pattern, -1).alias("gap"),
        F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)).alias("tested"),
    )

    def put(x: Column) -> Column:
        secret = F.char_length(x["tested"]) >= rule.least
        return F.concat(x["gap"], F.when(secret, F.lit(f"[{rule.kind}]")).otherwise(F.coalesce(x["whole"], F.lit(""))))

    return F.array_join(F.transform(cut, put), "")


def masked(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """`docs` with every secret replaced by its rule's name in brackets, rule after rule; other columns stay.

    Keys go first: another rule that hides a part of a key's header would leave its body. The candidates come from the trigram index as in `secret_spans`; a null text stays null.
    """
    asked = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = {kind: q for kind, q in asked.items() if q}
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").cast("string").alias("text"), F.lit(None).cast("array<string>").alias("kinds"))
    if indexed:
        trigrams = sorted({t for q in indexed.values() for clause in q for alternative in clause for t in alternative})
        hits = store(candidates(trigram_index(docs, trigrams), indexed)).withColumnRenamed("doc_id", "hit")
        rows = rows.drop("kinds").join(hits, F.col("doc.doc_id").eqNullSafe(F.col("hit")), "left")
    for rule in sorted(rules, key=lambda rule: rule != KEY):
        at = F.array_contains("kinds", rule.kind) if rule.kind in indexed else F.lit(True)
        rows = rows.withColumn("text", F.when(at & F.col("text").rlike(rule.pattern), _hidden(rule)).otherwise(F.col("text")))
    return rows.select(*[F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def oracle(rules: tuple[Rule, ...] = BASE + MORE) -> str:
    """The same rows in DuckDB SQL."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    parts = []
    for k, rule in enumerate(rules):
        pattern = quoted(rule.pattern.replace("{24,}", "+"))
        parts.append(
            f"""SELECT n, {k} AS kind, '{rule.kind}' AS name, i, length(gaps[i]) + length(whole[i]) AS step,
            length(whole[i]) AS len, length(tested[i]) >= {rule.least} AS ok
            FROM (SELECT n, regexp_split_to_array(t, {pattern}) AS gaps, regexp_extract_all(t, {pattern}) AS whole,
            regexp_extract_all(t, {pattern}, {rule.group}) AS tested FROM d) AS x, unnest(range(1, len(whole) + 1)) AS u(i)"""
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT *, sum(step) OVER (PARTITION BY n, kind ORDER BY i) AS stop FROM m),
s AS (SELECT n, kind, name, CAST(stop - len AS BIGINT) AS start, name || ':' || CAST(stop - len AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM e WHERE ok),
g AS (SELECT n, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM s GROUP BY n)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (n)"""
