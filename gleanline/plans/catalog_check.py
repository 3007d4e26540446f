"""Queries over calibration, claim verification and extraction quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import numbers, text
from ..operators import calibrate, claims, quality
from . import twin
from .registry import Tables, query

c = F.col

# --- calibration -------------------------------------------------------------------------------

_EXAMPLES = """
SELECT l.doc_id AS match_id, CAST(l.quality * 50 + (1 - l.toxic) * 20 + CASE WHEN d.lang = 'en' THEN 10 ELSE 0 END + CASE WHEN d.n_chars > 2000 THEN 20 ELSE 0 END AS DOUBLE) AS label,
  CAST(l.quality * 80 + CASE WHEN d.lang = 'en' THEN 10 ELSE 0 END AS DOUBLE) AS must_have_coverage, CAST((1 - l.toxic) * 70 AS DOUBLE) AS nice_to_have_coverage,
  CAST(CASE d.lang WHEN 'en' THEN 30 WHEN 'de' THEN 60 WHEN 'fr' THEN 90 ELSE 45 END AS DOUBLE) AS seniority_fit,
  CAST(CASE WHEN d.n_chars > 2000 THEN 90 ELSE 40 END AS DOUBLE) AS domain_fit, CAST(l.toxic * 100 AS DOUBLE) AS location_fit, 50.0D AS salary_fit
FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id
"""
_DUCK_EX = "ex AS MATERIALIZED (" + _EXAMPLES.replace("{", "").replace("}", "").replace("50.0D", "CAST(50 AS DOUBLE)") + ")"
_CR = calibrate.CRITERIA
_STEPS = [round(w * 20) for w in fv.RUBRIC_WEIGHTS.values()]
_GRID = "g AS MATERIALIZED (SELECT a.i AS w1, b.i AS w2, c.i AS w3, d.i AS w4, e.i AS w5, 20 - a.i - b.i - c.i - d.i - e.i AS w6 FROM " + ", ".join(
    f"generate_series(0, 20) {n}(i)" for n in "abcde"
) + " WHERE a.i + b.i + c.i + d.i + e.i <= 20)"


def examples(t: Tables):
    return t.sql(_EXAMPLES)


@query(
    "c01_weight_grid",
    f"WITH {_GRID} SELECT r_name, w1, w2, w3, w4, w5, w6 FROM region, g",
)
def weight_grid(t: Tables):
    """The grid once per region."""
    grid = calibrate.weight_grid(t.region.select("r_name"))
    return grid.select("r_name", *[c(w).cast("long").alias(w) for w in calibrate.WEIGHTS])


_RANKS = "rank() OVER (ORDER BY {v}) - 1 + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0"


@query("c02_average_ranks", f"WITH {_DUCK_EX} SELECT match_id, CAST({_RANKS.format(v='label')} AS DOUBLE) AS rank FROM ex")
def average_ranks(t: Tables):
    rows = examples(t)
    ranks = calibrate.average_ranks(rows.select(F.lit(1).alias("n"), "label"), [], "label")
    return rows.join(ranks, "label").select("match_id", "rank")


_TOTAL = " + ".join(f"{n} * {w}" for n, w in zip(_CR, _STEPS, strict=True))


def _duck_rho(x: str, source: str = "ex") -> str:
    return f"(SELECT coalesce(CASE WHEN isnan(r) THEN 0 ELSE r END, 0) FROM (SELECT corr(rx, ry) AS r FROM (SELECT {_RANKS.format(v=x)} AS rx, {_RANKS.format(v='label')} AS ry FROM {source})))"


@query(
    "c03_spearman",
    f"WITH {_DUCK_EX} SELECT criterion, round(rho, 6) AS rho FROM (VALUES " + ", ".join(f"('{n}', {_duck_rho(n)})" for n in _CR) + ") v(criterion, rho)",
)
def spearman(t: Tables):
    sides = F.array(*[F.struct(F.lit(n).alias("criterion"), c(n).alias("x")) for n in _CR])
    pairs = calibrate.compress(examples(t)).select(c("label").alias("y"), "n", F.inline(sides))
    return calibrate.spearman(pairs, ["criterion"]).select("criterion", F.round("rho", 6).alias("rho"))


def _duck_best(source: str, keys: str = "") -> str:
    """Best vector per key over distinct examples with counts."""
    k = f"{keys}, " if keys else ""
    using = f"USING ({keys}, label)" if keys else "USING (label)"
    over = f"PARTITION BY {k}w1, w2, w3, w4, w5, w6 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    pred = " + ".join(f"w{i + 1} * CAST({n} AS BIGINT)" for i, n in enumerate(_CR))
    lab_over = f"{'PARTITION BY ' + keys if keys else ''} ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""z AS MATERIALIZED (SELECT {k}label, {', '.join(_CR)}, count(*) AS n FROM {source} GROUP BY ALL),
      lr AS MATERIALIZED (SELECT {k}label, coalesce(sum(n) OVER ({lab_over}), 0) + (n - 1) / 2 AS ry FROM (SELECT {k}label, sum(n) AS n FROM z GROUP BY ALL)),
      pg AS MATERIALIZED (SELECT {k}w1, w2, w3, w4, w5, w6, {pred} AS p, sum(n) AS n, sum(n * ry) AS sy, sum(n * ry * ry) AS syy FROM z JOIN lr {using}, g GROUP BY ALL),
      sc AS MATERIALIZED (SELECT {k}w1, w2, w3, w4, w5, w6, sum(n) AS c, sum(rx * sy) AS xy, sum(n * rx * rx) AS xx, sum(syy) AS yy FROM (SELECT *, coalesce(sum(n) OVER ({over}), 0) + (n - 1) / 2 AS rx FROM pg) GROUP BY ALL),
      rh AS MATERIALIZED (SELECT *, CAST(c AS DOUBLE) * pow((c - 1) / 2, 2) AS m FROM sc),
      best AS MATERIALIZED (SELECT {k}w1, w2, w3, w4, w5, w6, rho FROM (SELECT *, round(CASE WHEN (xx - m) * (yy - m) <= 0 THEN 0 ELSE (xy - m) / sqrt((xx - m) * (yy - m)) END, 9) AS rho FROM rh)
        QUALIFY row_number() OVER ({'PARTITION BY ' + keys if keys else ''} ORDER BY rho DESC, w1, w2, w3, w4, w5, w6) = 1)"""


@query("c04_best_weights", f"WITH {_DUCK_EX}, {_GRID}, {_duck_best('ex')} SELECT w1, w2, w3, w4, w5, w6, round(rho, 6) AS rho FROM best")
def best_weights(t: Tables):
    out = calibrate.best_weights(calibrate.compress(examples(t)), [])
    return out.select(*[c(w).cast("long").alias(w) for w in calibrate.WEIGHTS], F.round("rho", 6).alias("rho"))


@query(
    "c05_stability",
    f"""WITH {_DUCK_EX}, {_GRID}, h AS MATERIALIZED (SELECT match_id % 2 AS half, * FROM ex), {_duck_best('h', 'half')},
      x AS (SELECT h.half, h.label, {' + '.join(f'w{i + 1} * {n}' for i, n in enumerate(_CR))} AS crossed, {_TOTAL} AS cur FROM h JOIN best ON best.half = 1 - h.half),
      rr AS (SELECT half, rank() OVER (PARTITION BY half ORDER BY crossed) + (count(*) OVER (PARTITION BY half, crossed) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY half ORDER BY cur) + (count(*) OVER (PARTITION BY half, cur) - 1) / 2.0 AS rc,
        rank() OVER (PARTITION BY half ORDER BY label) + (count(*) OVER (PARTITION BY half, label) - 1) / 2.0 AS ry FROM x)
      SELECT half, round(corr(rx, ry), 6) AS cross_rho, round(corr(rc, ry), 6) AS current_rho FROM rr GROUP BY 1""",
)
def stability(t: Tables):
    halves = examples(t).withColumn("half", c("match_id") % 2)
    out = calibrate.stability(calibrate.compress(halves, "half"))
    return out.select("half", F.round("cross_rho", 6).alias("cross_rho"), F.round("current_rho", 6).alias("current_rho"))


_SCORE = " + ".join(f"{n} * CAST({w} AS DOUBLE)" for n, w in fv.RUBRIC_WEIGHTS.items())


@query(
    "c06_current_fit",
    f"WITH {_DUCK_EX}, {_GRID}, {_duck_best('ex')}, ex2 AS (SELECT *, {_TOTAL} AS total FROM ex) SELECT criterion, round(v.rho, 6) AS rho, CASE WHEN criterion = 'total' THEN (SELECT round(avg(abs({_SCORE} - label)), 6) FROM ex) END AS mean_error, "
    "round(best.rho, 6) AS best_rho, round(best.rho - v.rho, 6) < 0.05 AS keep "
    "FROM (VALUES " + ", ".join(f"('{n}', {_duck_rho(n, 'ex2')})" for n in [*_CR, "total"]) + ") v(criterion, rho) LEFT JOIN best ON criterion = 'total'",
)
def current_fit(t: Tables):
    out = calibrate.current_fit(calibrate.compress(examples(t)))
    return out.select("criterion", *[F.round(n, 6).alias(n) for n in ("rho", "mean_error", "best_rho")], "keep")


@query(
    "c07_worst_errors",
    f"WITH {_DUCK_EX} SELECT match_id, label, error, CASE WHEN error > 0 THEN 'sopravvaluta' ELSE 'sottovaluta' END AS sign FROM (SELECT match_id, label, round({_SCORE} - label, 6) AS error FROM ex) ORDER BY abs(error) DESC, match_id LIMIT 5",
)
def worst_errors(t: Tables):
    return calibrate.worst_errors(examples(t))


# --- claims: assistant turns cite facts in user turns ---------------------------------------------

_FACTS = """
SELECT conv_id AS doc_id, 'e' || CAST(turn % 4 AS STRING) AS parent_id, 'b' || CAST(turn AS STRING) AS fact_id,
  text || ' ridotto del ' || CAST(conv_id % 100 AS STRING) || '% in ' || CAST(turn + 2 AS STRING) || ' mesi, ' || CASE turn % 4 WHEN 0 THEN 'sei ore' WHEN 2 THEN 'quaranta milioni di righe' ELSE '1.500 utenti' END AS text
FROM {conversations} WHERE role = 'user'
"""
_CLAIMS = """
SELECT conv_id AS doc_id, 'e' || CAST(CASE WHEN conv_id % 7 = 0 THEN 9 WHEN conv_id % 5 = 0 THEN (turn + 1) % 4 ELSE (turn - 1) % 4 END AS STRING) AS parent_id, turn AS position,
  'b' || CAST(CASE WHEN conv_id % 11 = 0 THEN turn + 100 ELSE turn - 1 END AS STRING) AS source_id,
  'ridotto del ' || CAST(conv_id % 100 + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS STRING) || ' per cento, ' || CASE turn % 4 WHEN 1 THEN '6 h' WHEN 3 THEN '40M righe' ELSE '1500 utenti' END AS text
FROM {conversations} WHERE role = 'assistant'
"""
_SKILLS = """
SELECT conv_id AS doc_id, turn AS position, role || ' C++' AS text, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN 'Node.js ' || CAST(conv_id % 4 AS STRING) ELSE 'c#' END AS source FROM {conversations}
"""
_KNOWN = """
SELECT conv_id AS doc_id, CASE WHEN turn % 2 = 0 THEN 'nodejs' || CAST(turn % 4 AS STRING) ELSE 'C++' END AS skill FROM {conversations}
"""


def _plain(sql: str) -> str:
    return sql.replace("{conversations}", "conversations")


_WORD_VALUES = ", ".join(f"('{w}', {v})" for w, v in numbers.number_words().items())
_FACTORS = ", ".join(f"('{w}', {v})" for w, v in fv.NUMBER_MULTIPLIERS.items())


def duck_numbers(name: str, source: str, keys: str) -> str:
    """CTE `name`(keys, v): distinct numbers of source.text."""
    bare = "rtrim(tok, '.,')"
    value = (
        f"CASE WHEN regexp_matches({bare}, '^\\d+([.,]\\d{{3}})+$') OR NOT regexp_matches({bare}, '[.,]') THEN TRY_CAST(regexp_replace({bare}, '[.,]', '', 'g') AS DOUBLE) "
        f"ELSE TRY_CAST(regexp_replace(regexp_extract({bare}, '^(.*)[.,]', 1), '[.,]', '', 'g') || '.' || regexp_extract({bare}, '([^.,]*)$', 1) AS DOUBLE) END"
    )
    return f"""{name} AS MATERIALIZED (SELECT DISTINCT {keys}, base * coalesce(f.v, 1) AS v FROM (
      SELECT {keys}, nxt, CASE WHEN regexp_matches(tok, '^[0-9]') THEN {value} WHEN tok IN ('cento', 'mille', 'cent') AND prv = 'per' THEN NULL ELSE w.v END AS base FROM (
        SELECT {keys}, l[i] AS tok, l[i + 1] AS nxt, CASE WHEN i > 1 THEN l[i - 1] END AS prv FROM (
          SELECT *, unnest(generate_series(1, len(l))) AS i FROM (SELECT *, regexp_extract_all(lower(text), '[a-zA-Zàèéìòù]+(?:-[a-zA-Z]+)?|\\d[\\d.,]*') AS l FROM {source})))
      LEFT JOIN (VALUES {_WORD_VALUES}) w(k, v) ON w.k = tok) LEFT JOIN (VALUES {_FACTORS}) f(k, v) ON f.k = nxt WHERE base IS NOT NULL)"""


_FX = f"facts AS MATERIALIZED ({_plain(_FACTS)}), claims AS MATERIALIZED ({_plain(_CLAIMS)})"
_VERDICT = """CASE WHEN NOT EXISTS (SELECT 1 FROM facts f WHERE f.doc_id = c.doc_id AND f.parent_id = c.parent_id) THEN 'esperienza-inesistente'
  WHEN EXISTS (SELECT 1 FROM facts f WHERE f.doc_id = c.doc_id AND f.parent_id = c.parent_id AND f.fact_id = c.source_id) THEN NULL
  WHEN EXISTS (SELECT 1 FROM facts f WHERE f.doc_id = c.doc_id AND f.fact_id = c.source_id) THEN 'bullet-di-un-altra-esperienza' ELSE 'bullet-inesistente' END"""


@query("v01_provenance", f"WITH {_FX} SELECT doc_id, position, {_VERDICT} AS verdict FROM claims c")
def provenance(t: Tables):
    return claims.provenance(t.sql(_CLAIMS), t.sql(_FACTS)).select("doc_id", "position", "verdict")


@query(
    "v02_numbers",
    f"WITH d AS (SELECT doc_id, text || ' ridotto del ' || doc_id % 100 || ',5% in ' || doc_id || ' giorni' AS text FROM documents), {duck_numbers('nums', 'd', 'doc_id')} "
    "SELECT doc_id, count(*) AS n, round(sum(CASE WHEN v < 1e6 THEN v ELSE 0 END), 4) AS total, max(v) AS highest FROM nums GROUP BY 1",
)
def numbers_found(t: Tables):
    composed = F.concat(c("text"), F.lit(" ridotto del "), (c("doc_id") % 100).cast("string"), F.lit(",5% in "), c("doc_id").cast("string"), F.lit(" giorni"))
    found = t.documents.select("doc_id", numbers.numbers_in(composed).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.when(x < 1e6, x).otherwise(0.0))
    return found.select("doc_id", F.size("v").cast("long").alias("n"), F.round(total, 4).alias("total"), F.array_max("v").alias("highest"))


_NUMS = f"{duck_numbers('fn', 'facts', 'doc_id, fact_id')}, {duck_numbers('cn', 'claims', 'doc_id, position, source_id')}"
_INVENTED = "(SELECT count(*) FROM cn WHERE cn.doc_id = c.doc_id AND cn.position = c.position AND cn.v NOT IN (SELECT v FROM fn WHERE fn.doc_id = c.doc_id AND fn.fact_id = c.source_id))"


@query(
    "v03_invented_numbers",
    f"WITH {_FX}, {_NUMS} SELECT c.doc_id, position, {_INVENTED} AS invented FROM claims c SEMI JOIN facts f ON f.doc_id = c.doc_id AND f.fact_id = c.source_id",
)
def invented_numbers(t: Tables):
    out = claims.invented_numbers(t.sql(_CLAIMS), t.sql(_FACTS))
    return out.select("doc_id", "position", F.size("invented").cast("long").alias("invented"))


@query(
    "v04_summary_numbers",
    f"WITH {_FX}, {_NUMS} SELECT DISTINCT doc_id, v AS value FROM cn ANTI JOIN fn ON fn.doc_id = cn.doc_id AND fn.v = cn.v",
)
def summary_numbers(t: Tables):
    """Claims play the summary: each number must occur somewhere in the facts of the conversation."""
    return claims.unsupported_summary_numbers(t.sql(_CLAIMS), t.sql(_FACTS))


_SKILL_KEY = "regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9+#]', '', 'g')"


@query(
    "v05_undeclared_skills",
    f"WITH s AS ({_plain(_SKILLS)}), k AS ({_plain(_KNOWN)}) SELECT doc_id, position, text FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = s.doc_id AND {_SKILL_KEY.format(x='skill')} = {_SKILL_KEY.format(x='source')})",
)
def undeclared_skills(t: Tables):
    return claims.undeclared_skills(t.sql(_SKILLS), t.sql(_KNOWN)).select("doc_id", "position", "text")


@query(
    "v06_unsupported_extras",
    f"WITH {_FX}, {_NUMS} SELECT doc_id, position, rule FROM (SELECT doc_id, position, CASE WHEN NOT EXISTS (SELECT 1 FROM facts f WHERE f.doc_id = c.doc_id AND f.fact_id = c.source_id) THEN 'informazione-inesistente' WHEN {_INVENTED} > 0 THEN 'cifra-inventata' END AS rule FROM claims c) WHERE rule IS NOT NULL",
)
def unsupported_extras(t: Tables):
    return claims.unsupported_extras(t.sql(_CLAIMS), t.sql(_FACTS)).select("doc_id", "position", "rule")


@query(
    "v07_verdicts",
    f"""WITH {_FX}, {_NUMS}, s AS ({_plain(_SKILLS)}), k AS ({_plain(_KNOWN)}), vd AS (SELECT *, {_VERDICT} AS verdict FROM claims c),
      viol AS (SELECT DISTINCT doc_id, CASE WHEN verdict = 'esperienza-inesistente' THEN parent_id ELSE position || source_id END AS p FROM vd WHERE verdict IS NOT NULL
        UNION ALL SELECT c.doc_id, 'n' FROM claims c SEMI JOIN facts f ON f.doc_id = c.doc_id AND f.fact_id = c.source_id WHERE {_INVENTED} > 0
        UNION ALL SELECT DISTINCT doc_id, 's' FROM cn ANTI JOIN fn ON fn.doc_id = cn.doc_id AND fn.v = cn.v
        UNION ALL SELECT doc_id, 'k' FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = s.doc_id AND {_SKILL_KEY.format(x='skill')} = {_SKILL_KEY.format(x='source')}))
      SELECT d.doc_id, coalesce(n, 0) AS violations, n IS NULL AS passes FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM viol GROUP BY 1) USING (doc_id)""",
)
def verdicts(t: Tables):
    found = claims.violations(t.sql(_CLAIMS), t.sql(_FACTS), t.sql(_CLAIMS), t.sql(_SKILLS), t.sql(_KNOWN))
    return claims.verdicts(t.conversations.select(c("conv_id").alias("doc_id")), found)


@query(
    "v08_side_by_side",
    """SELECT doc_id, 0 AS pos, 'Dev' AS role, text, text AS original FROM documents
      UNION ALL SELECT doc_id, 1, 'Dev', lang, NULL FROM documents""",
)
def side_by_side(t: Tables):
    """Generated and original bullets per document, read from JSON."""
    bullet = lambda text_, source: F.struct(text_.alias("text"), F.lit(source).alias("source_id"))
    generated = F.to_json(
        F.struct(F.array(F.struct(F.lit("e1").alias("id"), F.array(bullet(c("text"), "b1"), bullet(c("lang"), "gone")).alias("bullets"))).alias("experience"))
    )
    original = F.to_json(
        F.struct(F.array(F.struct(F.lit("e1").alias("id"), F.lit("Acme").alias("company"), F.lit("Dev").alias("role"), F.array(F.struct(F.lit("b1").alias("id"), c("text").alias("text"))).alias("bullets"))).alias("experiences"))
    )
    schema = "experiences array<struct<id:string,company:string,role:string,bullets:array<struct<id:string,text:string>>>>"
    pairs = t.documents.select(
        "doc_id", F.from_json(generated, claims.GENERATED_SCHEMA).alias("generated"), F.from_json(original, schema).alias("profile")
    )
    return claims.side_by_side(pairs).select("doc_id", "pos", "role", "text", "original")


# --- extraction quality ------------------------------------------------------------------------

_BROKEN = "CASE doc_id % 3 WHEN 0 THEN replace({t}, ' ', chr(13) || chr(10)) WHEN 1 THEN replace({t}, 'e ', 'e-' || chr(10)) ELSE {t} END"
_CLEAN = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '\\x{{00a0}}', ' ', 'g'), "
    "'([\\pL\\pN_])-\\n([\\pL\\pN_])', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), ' *(\\n) *', '\\1', 'g'), ' ' || chr(10))"
)


@query(
    "q01_clean_extraction",
    f"SELECT doc_id, md5({_CLEAN.format(x=_BROKEN.format(t='text'))}) AS digest FROM (SELECT doc_id, regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM documents)",
)
def clean_extraction(t: Tables):
    return t.documents.select("doc_id", F.md5(text.clean_extraction(F.expr(_BROKEN.format(t="text")))).alias("digest"))


_WORDS = "regexp_extract_all({x}, '\\pL+')"
_INTEGRITY = f"CASE WHEN len({_WORDS}) > 0 THEN len(list_filter({_WORDS}, lambda w: length(w) <= 18)) / len({_WORDS}) ELSE 0 END"
_NUMTOK = "list_sort(list_distinct(regexp_extract_all({x}, '\\d(?:[\\d.,]*\\d)?%?')))"


@query("q02_word_integrity", f"SELECT doc_id, round({_INTEGRITY.format(x='text')}, 6) AS integrity FROM documents")
def word_integrity(t: Tables):
    return t.documents.select("doc_id", F.round(text.word_integrity(c("text")), 6).alias("integrity"))


_COMPOSED = "{t} || ' 45% di ' || doc_id || ' e 1.200, poi 45%.'"


@query("q03_numeric_tokens", f"SELECT doc_id, array_to_string({_NUMTOK.format(x='(' + _COMPOSED.format(t='text') + ')')}, ' ') AS tokens FROM documents")
def numeric_tokens(t: Tables):
    composed = F.concat(c("text"), F.lit(" 45% di "), c("doc_id").cast("string"), F.lit(" e 1.200, poi 45%."))
    return t.documents.select("doc_id", F.array_join(text.numeric_tokens(composed), " ").alias("tokens"))


_LINES = "list_filter(string_split({x}, chr(10)), lambda l: length(trim(l)) > 0)"
_QUALITY = (
    f"CASE WHEN len({_LINES}) > 0 THEN least(CAST(list_sum(list_transform({_LINES}, lambda l: length(l))) AS DOUBLE) / len({_LINES}), 80) / 80 * CAST(0.5 AS DOUBLE) "
    f"+ CAST(length(regexp_replace({{x}}, '[^\\pL\\s]', '', 'g')) AS DOUBLE) / length({{x}}) * CAST(0.4 AS DOUBLE) "
    f"+ (1 - CAST(len(list_filter({_LINES}, lambda l: length(l) <= 3)) AS DOUBLE) / len({_LINES})) * CAST(0.1 AS DOUBLE) ELSE 0 END"
)


@query("q04_prose_quality", f"SELECT doc_id, round({_QUALITY.format(x='text')}, 6) AS quality FROM documents")
def prose_quality(t: Tables):
    return t.documents.select("doc_id", F.round(text.prose_quality(c("text")), 6).alias("quality"))


_VARIANTS = """
SELECT doc_id, 'fast' AS method, 0 AS position, text || ' circa ' || CAST(doc_id % 50 AS STRING) || ' robot' AS text FROM {documents}
UNION ALL SELECT doc_id, 'layout', 1, CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', '') ELSE text END || ' circa 239 robot, 17% in ' || CAST(doc_id % 50 AS STRING) FROM {documents}
UNION ALL SELECT doc_id, 'ocr', 2, CASE WHEN doc_id % 4 = 0 THEN replace(text, ' ', chr(10)) ELSE text END || ' robot 12 e 13 e 14' FROM {documents}
"""
_MEASURED = f"""m AS MATERIALIZED (SELECT doc_id, method, position, {_INTEGRITY.format(x='text')} AS integrity, {_NUMTOK.format(x='text')} AS numbers, {_QUALITY.format(x='text')} AS quality
    FROM ({_VARIANTS.replace('{documents}', 'documents')})),
  b AS MATERIALIZED (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY integrity >= 0.9 DESC, CASE WHEN integrity >= 0.9 THEN len(numbers) ELSE integrity END DESC, CASE WHEN integrity >= 0.9 THEN quality ELSE 0 END DESC, position) = 1)"""


@query("q05_pick_best", f"WITH {_MEASURED} SELECT doc_id, method FROM b")
def pick_best(t: Tables):
    return quality.pick_best(quality.measure(t.sql(_VARIANTS))).select("doc_id", "method")


@query(
    "q06_lost_numbers",
    f"WITH {_MEASURED}, a AS (SELECT DISTINCT doc_id, unnest(numbers) AS v FROM m) SELECT b.doc_id, coalesce((SELECT string_agg(v, ' ' ORDER BY v) FROM a WHERE a.doc_id = b.doc_id AND NOT list_contains(b.numbers, v)), '') AS lost FROM b",
)
def lost_numbers(t: Tables):
    return quality.pick_best(quality.measure(t.sql(_VARIANTS))).select("doc_id", F.array_join("lost", " ").alias("lost"))


@query(
    "q07_review_warnings",
    """SELECT o_orderkey AS doc_id, array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'no experience' END, CASE WHEN o_orderkey % 3 = 0 THEN 'no technical skill' END,
      CASE WHEN o_orderkey % 7 = 0 THEN 'no email' END, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'no measurable result' END,
      CASE WHEN o_orderkey % 5 > 0 THEN 'empty: e2' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM orders""",
)
def review_warnings(t: Tables):
    none = F.lit(None).cast("string")
    k = c("o_orderkey")
    bullet = F.struct(
        F.lit("b1").alias("id"), c("o_orderpriority").alias("text"), none.alias("action"), none.alias("context"),
        F.when(k % 2 == 1, "ridotto del 10%").alias("result"), F.array(F.lit("x")).alias("skills"),
    )
    job = lambda i, bullets: F.struct(F.lit(i).alias("id"), bullets.alias("bullets"))
    jobs = F.array(job("e1", F.array(bullet)), job("e2", F.slice(F.array(bullet), 1, 0)))
    profile = F.struct(
        F.when(k % 5 > 0, jobs).otherwise(F.slice(jobs, 1, 0)).alias("experiences"),
        F.struct(F.when(k % 3 > 0, F.array(F.lit("sql"))).alias("hard")).alias("skills"),
        F.when(k % 7 > 0, c("o_orderpriority")).alias("email"),
    )
    rows = t.orders.select(k.alias("doc_id"), profile.alias("p"))
    return rows.select("doc_id", F.array_join(quality.review_warnings(c("p")), "; ").alias("warnings"))
