"""Quality rules whose thresholds adapt to language and source.

Every measure of a text is a whole number, so that a quantile sketch is a table of bucket counts: 64 buckets for each
power of two, kept by their lower bound, which merge by adding. A document is unusual if a measure lies outside the
quartiles of its language and source by more than FENCE interquartile ranges and a tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, store, words_of

FENCE = 3
#: A group of fewer documents takes the merged sketch of its language, or of all documents.
LEAST_GROUP = 200
SYMBOLS, CAPITALS = "[#*$%&|<>]", "[A-Z]"


@dataclass(frozen=True)
class Measure:
    """1000 * part / whole, and how far beyond the fence of the upper (or also the lower) quartile it may lie."""

    name: str
    part: str
    whole: str
    slack: int
    both: bool = False


MEASURES = (
    Measure("word_length", "word_chars", "n_words", 300, True),
    Measure("symbols", "n_symbols", "n_words", 20),
    Measure("dup_lines", "n_dup_lines", "n_lines", 500),
    Measure("repeats", "n_repeat_words", "n_words", 300),
    Measure("capitals", "n_capitals", "word_chars", 50),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def _repeat_words(codes: np.ndarray, rows: np.ndarray, n: int, kinds: int) -> np.ndarray:
    """Words of each text inside a window of three that occurs twice or more in it."""
    out = np.zeros(n, np.int64)
    if len(codes) < 3:
        return out
    inside = rows[:-2] == rows[2:]
    a, b, c = (codes[k : len(codes) - 2 + k][inside].astype(np.int64) for k in range(3))
    own = rows[:-2][inside]
    if kinds < 1 << 21:
        order = np.lexsort(((a << 42) | (b << 21) | c, own))
    else:
        order = np.lexsort((c, b, a, own))
    a, b, c, own = a[order], b[order], c[order], own[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1]) & (own[1:] == own[:-1])
    again = np.zeros(len(a), bool)
    again[1:] |= same
    again[:-1] |= same
    first = np.flatnonzero(inside)[order][again]
    marked = np.zeros(len(codes), bool)
    for k in range(3):
        marked[first + k] = True
    return np.bincount(rows[marked], minlength=n)


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Columns `keep` and COUNTS of every row; a null text has no words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch["text"]):
                part = batch.slice(start, stop - start)
                n = len(part)
                texts = pc.fill_null(part["text"], "")
                words = words_of(texts, lower=False)
                rows = words.rows()
                chars = pc.utf8_length(words.values).to_numpy(zero_copy_only=False)[words.codes]
                lists = pc.split_pattern(texts, "\n")
                coded = pc.dictionary_encode(lists.flatten())
                line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                full = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0d]").to_numpy(zero_copy_only=False)[line]
                at = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))[full]
                lines = np.bincount(at, minlength=n)
                kinds = np.unique(at * len(coded.dictionary) + line[full]) // max(1, len(coded.dictionary))
                counts = (
                    words.counts,
                    np.bincount(rows, weights=chars, minlength=n).astype(np.int64),
                    pc.count_substring_regex(texts, SYMBOLS),
                    lines - np.bincount(kinds, minlength=n),
                    _repeat_words(words.codes, rows, n, len(words.values)),
                    lines,
                    pc.count_substring_regex(texts, CAPITALS),
                )
                arrays = [pa.array(c).cast(pa.int64()) if isinstance(c, np.ndarray) else c.cast(pa.int64()) for c in counts]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in keep], *arrays], names=[*keep, *COUNTS])

    types = {"doc_id": "long"}
    columns = [F.col(c).cast(types.get(c, "string")).alias(c) for c in (*keep, "text")]
    schema = ", ".join([f"{c} {types.get(c, 'string')}" for c in keep] + [f"{c} long" for c in COUNTS])
    return docs.select(*columns).mapInArrow(count, schema)


def value(m: Measure) -> Column:
    return F.expr(f"coalesce(1000 * {m.part} div nullif({m.whole}, 0), 0)")


def bucket(v: Column) -> Column:
    """The lower bound of the bucket of a whole number: six leading binary digits."""
    digits = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, digits), digits)


def sketch(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one quantile sketch per language, source and measure."""
    values = F.array(*[F.struct(F.lit(k).alias("measure"), bucket(value(m)).alias("bucket")) for k, m in enumerate(MEASURES)])
    return counted.where("n_words > 0").select("lang", "source", F.inline(values)).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def fences(sketches: DataFrame) -> DataFrame:
    """(lang, source, lo_0, hi_0, ...) for each language and source of the sketches."""
    groups = ("lang", "source")
    merged = sketches.select(
        F.explode(F.sequence(F.lit(0), F.lit(2))).alias("level"), "lang", "source", "measure", "bucket", "n"
    ).select(
        "level",
        F.when(F.col("level") < 2, F.col("lang")).alias("lang"),
        F.when(F.col("level") < 1, F.col("source")).alias("source"),
        "measure",
        "bucket",
        "n",
    )
    summed = merged.groupBy("level", *groups, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("level", *groups, "measure")
    ranked = summed.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    quartiles = ranked.groupBy("level", *groups, "measure").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("q3"),
    )
    columns = [F.max("total").alias("total")]
    for k, m in enumerate(MEASURES):
        wide = FENCE * (F.col("q3") - F.col("q1")) + m.slack
        columns.append(F.max(F.when(F.col("measure") == k, F.col("q3") + wide)).alias(f"hi_{k}"))
        columns.append(F.max(F.when(F.col("measure") == k, F.col("q1") - wide)).alias(f"lo_{k}"))
    table = store(quartiles.groupBy("level", *groups).agg(*columns))
    names = [f"{side}_{k}" for k in range(len(MEASURES)) for side in ("lo", "hi")]
    level = [table.where(F.col("level") == k).select(F.struct("total", *names).alias(f"f{k}"), *[F.col(g).alias(f"{g}_{k}") for g in groups]) for k in range(3)]
    chosen = (
        level[0]
        .join(level[1], F.col("lang_0").eqNullSafe(F.col("lang_1")), "left")
        .join(level[2].withColumn("one", F.lit(1)), F.col("one") == F.lit(1), "left")
    )
    use = F.when(F.col("f0.total") >= LEAST_GROUP, F.col("f0")).when(F.col("f1.total") >= LEAST_GROUP, F.col("f1")).otherwise(F.col("f2"))
    return chosen.select(F.col("lang_0").alias("f_lang"), F.col("source_0").alias("f_source"), use.alias("f")).select("f_lang", "f_source", *[F.col(f"f.{c}") for c in names])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, unusual (names of measures beyond their fence) and kept, for every row of `docs`.

    Fixed rules: `base_failed` if a text has fewer than 50 words or more than half of its words lie in repeated windows.
    Null and empty texts have no words and fail them. Null languages or sources are groups of their own. Texts without
    words take no part in the sketches. Repeated rows count as often as they come; no rows give no rows.
    """
    counted = store(measured(docs))
    limits = store(fences(sketch(counted)))
    joined = counted.join(
        limits, counted["lang"].eqNullSafe(limits["f_lang"]) & counted["source"].eqNullSafe(limits["f_source"]), "left"
    )
    beyond = []
    for k, m in enumerate(MEASURES):
        outside = bucket(value(m)) > F.col(f"hi_{k}")
        outside = outside | (bucket(value(m)) < F.col(f"lo_{k}")) if m.both else outside
        beyond.append(F.when(outside, F.lit(m.name)))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    unusual = F.array_compact(F.array(*beyond))
    return joined.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), unusual.alias("unusual"), (~failed & (F.size(unusual) == 0)).alias("kept")
    )


def oracle() -> str:
    """The columns of `digest` in DuckDB SQL."""
    def q(v: str) -> str:
        return f"((({v}) >> greatest(length(bin({v})) - 6, 0)) << greatest(length(bin({v})) - 6, 0))"

    values = ", ".join(f"{q(f'CAST(coalesce(1000 * {m.part} // nullif({m.whole}, 0), 0) AS BIGINT)')} AS v_{k}" for k, m in enumerate(MEASURES))
    long = " UNION ALL ".join(f"SELECT lang, source, {k} AS measure, v_{k} AS bucket, {m.slack} AS slack FROM v WHERE n_words > 0" for k, m in enumerate(MEASURES))
    levels = " UNION ALL ".join(
        f"SELECT {k} AS level, {lang} AS lang, {source} AS source, measure, slack, bucket FROM l"
        for k, (lang, source) in enumerate((("lang", "source"), ("lang", "NULL"), ("NULL", "NULL")))
    )
    tests = " OR ".join(
        f"v_{k} > f.hi[{k + 1}]" + (f" OR v_{k} < f.lo[{k + 1}]" if m.both else "") for k, m in enumerate(MEASURES)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT n, i, ws[i] AS word, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT n, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d), unnest(range(1, len(ws) + 1)) AS u(i)),
g AS (SELECT n, i, count(*) OVER (PARTITION BY n, win) > 1 AND win IS NOT NULL AS twice FROM w),
r AS (SELECT n, count(*) AS n_repeat_words FROM (SELECT n, twice OR coalesce(lag(twice) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS hit FROM g WINDOW o AS (PARTITION BY n ORDER BY i)) WHERE hit GROUP BY n),
c AS (SELECT n, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM w GROUP BY n),
li AS (SELECT n, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT n, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM li WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY n),
m AS (SELECT doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN c USING (n) LEFT JOIN ln USING (n) LEFT JOIN r USING (n)),
v AS (SELECT *, {values} FROM m),
l AS ({long}),
x AS ({levels}),
s AS (SELECT level, lang, source, measure, slack, bucket, count(*) AS k FROM x GROUP BY ALL),
y AS (SELECT *, sum(k) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(k) OVER (PARTITION BY level, lang, source, measure) AS total FROM s),
z AS (SELECT level, lang, source, measure, slack, max(total) AS total, min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3 FROM y GROUP BY ALL),
f AS (SELECT level, lang, source, max(total) AS total, list(q3 + {FENCE} * (q3 - q1) + slack ORDER BY measure) AS hi, list(q1 - {FENCE} * (q3 - q1) - slack ORDER BY measure) AS lo FROM z GROUP BY ALL),
p AS (SELECT a.lang, a.source, CASE WHEN a.total >= {LEAST_GROUP} THEN a.hi WHEN b.total >= {LEAST_GROUP} THEN b.hi ELSE e.hi END AS hi,
  CASE WHEN a.total >= {LEAST_GROUP} THEN a.lo WHEN b.total >= {LEAST_GROUP} THEN b.lo ELSE e.lo END AS lo
  FROM f AS a JOIN f AS b ON b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang JOIN f AS e ON e.level = 2 WHERE a.level = 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce({tests}, false) AS kept
FROM v LEFT JOIN p AS f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source"""


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
