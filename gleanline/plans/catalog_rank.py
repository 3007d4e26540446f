"""Queries over retrieval, ranking and rubric scoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import filters, retrieve, rubric, vector_index
from ..operators import shortlist as by_bound
from ..session import cut_lineage
from . import twin
from .canonical import canonical, duck_canonical
from .catalog_filter import duck_judged, judged
from .registry import Tables, query
from .views import duck, view

c = F.col

# --- profile terms: one nested profile per document, built from its words ------------------------


def profiles(t: Tables):
    w = F.split("text", " ")

    def word(i: int):
        return F.coalesce(F.get(w, F.lit(i)), F.lit(""))

    def bullet(i: int):
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(f"b{i}").alias("id"), word(i).alias("text"), none.alias("action"), none.alias("context"),
            none.alias("result"), F.array(word(i)).alias("skills"),
        )

    def job(i: int):
        return F.struct(
            F.lit(f"e{i}").alias("id"), word(i).alias("company"), word(i + 1).alias("role"), F.lit("2020-01").alias("start"),
            F.lit(None).cast("string").alias("end"), F.array(word(i + 2), word(i + 3)).alias("tech"), F.array(bullet(i + 4)).alias("bullets"),
        )

    project = F.struct(F.lit("p1").alias("id"), word(12).alias("name"), word(12).alias("description"), F.array(word(13), word(0)).alias("tech"))
    profile = F.struct(
        F.concat_ws(" ", word(1), word(2)).alias("headline"),
        F.struct(F.concat(F.array(word(0), word(3)), F.slice(w, 15, F.greatest(F.size(w) - 14, F.lit(0)))).alias("hard"), F.array(word(4)).alias("soft")).alias("skills"),
        F.array(job(2), job(7)).alias("experiences"),
        F.array(project).alias("projects"),
    )
    return t.documents.select(c("doc_id").alias("profile_id"), profile.alias("profile"))


_DUCK_TERMS = """p AS MATERIALIZED (SELECT doc_id, list_transform(generate_series(1, 14), lambda i: coalesce(string_split(text, ' ')[i], '')) AS w, string_split(text, ' ')[15:] AS rest FROM documents),
  raw AS (SELECT doc_id, unnest([w[1], w[4], w[5], w[6], w[10], w[11], w[7], w[12]] || rest) AS term, 1.0 AS weight FROM p
    UNION ALL SELECT doc_id, unnest([w[4], w[9]]), 0.6 FROM p UNION ALL SELECT doc_id, unnest([w[14], w[1]]), 0.5 FROM p
    UNION ALL SELECT doc_id, w[2] || ' ' || w[3], 0.6 FROM p)"""


@query(
    "r01_profile_terms",
    f"WITH {_DUCK_TERMS} SELECT doc_id AS profile_id, lower(trim(term)) AS term, CAST(max(weight) AS DOUBLE) AS weight FROM raw "
    "WHERE length(trim(term)) >= 2 GROUP BY 1, 2",
)
def profile_terms(t: Tables):
    return retrieve.profile_terms(profiles(t))


_DUCK_LEXICAL = "title || ' ' || title || ' ' || title || chr(10) || coalesce(job_family, '') || chr(10) || coalesce(description, '')"


@query("r02_lexical_text", f"WITH {duck_canonical()} SELECT id, md5({_DUCK_LEXICAL}) AS digest FROM canon")
def lexical_text(t: Tables):
    body = retrieve.lexical_text(c("title"), c("job_family"), c("description"))
    return canonical(t).select("id", F.md5(body).alias("digest"))


@query(
    "r03_embedding_text",
    f"""WITH {duck_canonical()} SELECT id, md5(concat_ws(' · ', title, 'presso ' || company, nullif(concat_ws(', ', city, region, country), ''),
      nullif(work_mode, 'unknown'), job_family) || chr(10) || description) AS digest FROM canon""",
)
def embedding_text(t: Tables):
    rows = canonical(t)
    return rows.select("id", F.md5(retrieve.embedding_text({n: c(n) for n in rows.columns})).alias("digest"))


@query(
    "r04_tokenize",
    f"SELECT doc_id, CAST(len({twin.terms('text')}) AS INT) AS n, md5(array_to_string({twin.terms('text')}, ' ')) AS digest FROM documents",
)
def tokenize(t: Tables):
    tokens = t.documents.select("doc_id", retrieve.tokenize(c("text")).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


def _duck_grams(source: str, ident: str, body: str) -> str:
    """Subquery (id, gram): every 1..3-gram occurrence."""
    return f"""(SELECT id, unnest(w) AS gram FROM (SELECT {ident} AS id, {twin.terms(body)} AS w FROM {source})
      UNION ALL SELECT id, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM (SELECT {ident} AS id, {twin.terms(body)} AS w FROM {source})
      UNION ALL SELECT id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM (SELECT {ident} AS id, {twin.terms(body)} AS w FROM {source}))"""


@query(
    "r05_ngram_counts",
    f"SELECT id AS doc_id, count(*) AS grams, CAST(sum(n) AS BIGINT) AS occurrences, max(n) AS highest FROM (SELECT id, gram, count(*) AS n FROM {_duck_grams('documents', 'doc_id', 'text')} GROUP BY 1, 2) GROUP BY 1",
)
def ngram_counts(t: Tables):
    counts = retrieve.ngram_counts(t.documents, "doc_id", "text")
    return counts.groupBy("doc_id").agg(F.count("*").alias("grams"), F.sum("n").alias("occurrences"), F.max("n").alias("highest"))


# --- BM25: benchmark items are the profiles, their words and word pairs the terms ----------------


def item_terms(t: Tables):
    words = F.split("text", " ")
    listed = F.concat(
        F.transform(words, lambda w, i: F.struct(w.alias("term"), F.when(i % 2 == 0, 1.0).otherwise(0.6).alias("weight"))),
        F.array(F.struct(F.concat_ws(" ", words[0], words[1]).alias("term"), F.lit(1.0).alias("weight"))),
    )
    return t.benchmark.select(c("item_id").alias("profile_id"), F.explode(listed).alias("x")).select("profile_id", "x.*")


def _duck_bm25(docs: str) -> str:
    """CTEs up to kw(profile_id, id, keyword) for documents `docs`(id, body)."""
    return f"""rawq AS (SELECT item_id AS profile_id, unnest(string_split(text, ' ')) AS term,
        CASE WHEN generate_subscripts(string_split(text, ' '), 1) % 2 = 1 THEN 1.0 ELSE 0.6 END AS weight FROM benchmark
      UNION ALL SELECT item_id, string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2], 1.0 FROM benchmark),
    q AS MATERIALIZED (SELECT profile_id, array_to_string({twin.terms('term')}, ' ') AS gram, CAST(sum(weight) AS DOUBLE) AS weight FROM rawq
      WHERE len({twin.terms('term')}) BETWEEN 1 AND 3 GROUP BY 1, 2),
    corpus AS (SELECT count(*) AS n, avg(len({twin.terms('body')})) AS avg_length FROM {docs}),
    tf AS MATERIALIZED (SELECT id, gram, count(*) AS tf FROM {_duck_grams(docs, 'id', 'body')} WHERE gram IN (SELECT gram FROM q) GROUP BY 1, 2),
    df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1),
    len_ AS (SELECT id, len({twin.terms('body')}) AS length FROM {docs}),
    kw AS MATERIALIZED (SELECT profile_id, id, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg_length))) AS keyword
      FROM tf JOIN q USING (gram) JOIN df USING (gram) JOIN len_ USING (id), corpus GROUP BY 1, 2)"""


def _duck_batch_bm25() -> str:
    """CTEs up to kw for documents d(id, pid, body): the corpus of a profile is its own batch."""
    parts = _duck_bm25("d")
    shared = parts[: parts.index("corpus AS")]
    return f"""{shared}
    tf AS MATERIALIZED (SELECT id, gram, count(*) AS tf FROM {_duck_grams('d', 'id', 'body')} WHERE gram IN (SELECT gram FROM q) GROUP BY 1, 2),
    len_ AS (SELECT id, pid AS profile_id, len({twin.terms('body')}) AS length FROM d),
    corpus AS (SELECT profile_id, count(*) AS n, coalesce(nullif(avg(length), 0), 1) AS avg_length FROM len_ GROUP BY 1),
    lists AS MATERIALIZED (SELECT profile_id, id, gram, tf, weight, length FROM tf JOIN len_ USING (id) JOIN q USING (profile_id, gram)),
    df AS (SELECT profile_id, gram, count(*) AS df FROM lists GROUP BY 1, 2),
    kw AS MATERIALIZED (SELECT profile_id, id, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg_length))) AS keyword
      FROM lists JOIN df USING (profile_id, gram) JOIN corpus USING (profile_id) GROUP BY 1, 2)"""


@query(
    "r06_bm25",
    f"WITH d AS (SELECT doc_id AS id, text AS body FROM documents), {_duck_bm25('d')} SELECT profile_id, id, round(keyword, 6) AS keyword FROM kw",
)
def bm25(t: Tables):
    scores = retrieve.bm25(t.documents.select(c("doc_id").alias("id"), c("text").alias("body")), item_terms(t))
    return scores.select("profile_id", "id", F.round("keyword", 6).alias("keyword"))


@query(
    "r06_top_keyword",
    f"""WITH d AS (SELECT doc_id AS id, text AS body FROM documents), {_duck_bm25('d')} SELECT profile_id, id, round(keyword, 6) AS keyword, place FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY round(keyword, 6) DESC, id) AS INT) AS place FROM kw) WHERE place <= 10""",
)
def top_keyword(t: Tables):
    """The ten best documents of every profile, by bounds instead of scoring all that share a term."""
    best = by_bound.top_keyword(t.documents.select(c("doc_id").alias("id"), c("text").alias("body")), item_terms(t), 10)
    return best.select("profile_id", "id", F.round("keyword", 6).alias("keyword"), "place")


def _stub_embedding(texts):
    """Stands in for a model: four counts per text."""
    return [[float(len(x)), float(x.count("a")), float(x.count("e")), 1.0] for x in texts]


@query("r07_refresh_vectors")
def refresh_vectors(t: Tables):
    rows = t.documents.join(t.embeddings, t.documents["doc_id"] == t.embeddings["vec_id"], "left").select(
        c("doc_id").alias("id"), c("text").alias("body"), c("embedding").alias("vector"),
        F.when(c("doc_id") % 3 == 0, "old").otherwise("m1").alias("vector_model"),
    )
    out = retrieve.refresh_vectors(rows, _stub_embedding, "m1")
    return out.select("id", F.size("vector").alias("dims"), F.round(F.element_at("vector", 1).cast("double"), 4).alias("first"), "vector_model")


def similarities(t: Tables):
    """(vec_id, label, semantic): every vector against vector 0, the profile."""
    own = t.embeddings.where("vec_id = 0").select("embedding").scalar()
    both = t.embeddings.withColumn("own", own)
    return both.select("vec_id", "label", retrieve.cosine(c("embedding"), c("own")).alias("semantic"))


_COS = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) / sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))"
_DUCK_COS = _COS.format(a="e.embedding", b="z.embedding")


@query(
    "r08_cosine",
    f"SELECT e.vec_id, round({_DUCK_COS}, 6) AS semantic FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) z",
)
def cosine(t: Tables):
    return similarities(t).select("vec_id", F.round("semantic", 6).alias("semantic"))


# Vectors whose id is divisible by 50 ask, all vectors answer.


def _indexed(t: Tables):
    rows = t.embeddings.select(c("vec_id").alias("id"), c("embedding").alias("vector"))
    queries = rows.where("id % 50 = 0")
    index = vector_index.fit(rows)
    return rows, queries, vector_index.search(vector_index.assign(rows, index), queries, index)


@query("r08_vector_search")
def vector_search(t: Tables):
    """Ten neighbours of each query through the inverted file."""
    return _indexed(t)[2].select("query_id", "id", F.round("semantic", 6).alias("semantic"), "place")


@query(
    "r08_index_recall",
    "SELECT count(*) AS queries, CAST(count(*) * least(10, (SELECT count(*) - 1 FROM embeddings)) AS BIGINT) AS neighbours, true AS reached FROM embeddings WHERE vec_id % 50 = 0",
)
def index_recall(t: Tables):
    """Whether the inverted file finds nine of ten true neighbours; `r08_vector_search` has its rows."""
    rows, queries, found = _indexed(t)
    measured = vector_index.recall(found, vector_index.exact(rows, queries))
    return measured.select("queries", "neighbours", (c("recall") >= 0.9).alias("reached"))


@query(
    "r09_spread",
    f"""WITH s AS (SELECT e.vec_id, e.label AS profile_id, {_DUCK_COS} AS semantic FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) z)
      SELECT vec_id, round((semantic - lo) / (hi - lo), 6) AS spread FROM s JOIN (SELECT profile_id, min(semantic) AS lo, max(semantic) AS hi FROM s GROUP BY 1) USING (profile_id)""",
)
def spread(t: Tables):
    """Each label is a batch."""
    rows = similarities(t).withColumnRenamed("label", "profile_id")
    return retrieve.spread(rows, "semantic", "s").select("vec_id", F.round("s", 6).alias("spread"))


# A posting is judged for the profile whose number is its own modulo the number of items, so each
# profile has a batch and every posting is in exactly one.


def ranked(t: Tables):
    items = t.benchmark.agg(F.count("*")).scalar()
    batch = t.documents.join(t.embeddings, t.documents["doc_id"] == t.embeddings["vec_id"]).select(
        c("doc_id").alias("id"), (c("doc_id") % items).alias("profile_id"), c("embedding").alias("vector"), c("text").alias("body"),
    )
    vectors = t.benchmark.join(t.embeddings, c("item_id") == c("vec_id")).select(c("item_id").alias("profile_id"), c("embedding").alias("profile_vector"))
    keyword = retrieve.bm25(batch.select("id", "body"), item_terms(t), batch)
    return retrieve.rank(batch.drop("body"), vectors, keyword)


_DUCK_RANKED = f"""d AS MATERIALIZED (SELECT doc_id AS id, doc_id % (SELECT count(*) FROM benchmark) AS pid, embedding, text AS body FROM documents JOIN embeddings ON vec_id = doc_id),
  {_duck_batch_bm25()},
  s AS MATERIALIZED (SELECT d.id, d.pid AS profile_id, {_COS.format(a='d.embedding', b='v.embedding')} AS semantic, coalesce(kw.keyword, 0) AS keyword
    FROM d JOIN embeddings v ON v.vec_id = d.pid LEFT JOIN kw ON kw.id = d.id AND kw.profile_id = d.pid),
  rk AS MATERIALIZED (SELECT id, profile_id, semantic, keyword, 0.6 * CASE WHEN h1 - l1 < 1e-9 THEN 0.5 ELSE (semantic - l1) / (h1 - l1) END + 0.4 * CASE WHEN h2 - l2 < 1e-9 THEN 0.5 ELSE (keyword - l2) / (h2 - l2) END AS hybrid,
      CASE WHEN h2 - l2 < 1e-9 THEN 0.5 ELSE (keyword - l2) / (h2 - l2) END AS shown
    FROM s JOIN (SELECT profile_id, min(semantic) AS l1, max(semantic) AS h1, min(keyword) AS l2, max(keyword) AS h2 FROM s GROUP BY 1) USING (profile_id))"""


@query(
    "r10_hybrid_rank",
    f"WITH {_DUCK_RANKED} SELECT profile_id, id, round(semantic, 6) AS semantic, round(keyword, 6) AS keyword, round(hybrid, 6) AS hybrid FROM rk",
)
def hybrid_rank(t: Tables):
    rounded = [F.round(n, 6).alias(n) for n in ("semantic", "keyword", "hybrid")]
    return ranked(t).select("profile_id", "id", *rounded)


@query("r11_display_keyword", f"WITH {_DUCK_RANKED} SELECT profile_id, id, round(shown, 6) AS keyword_shown FROM rk")
def display_keyword(t: Tables):
    shown = retrieve.spread(ranked(t), "keyword", "shown")
    return shown.select("profile_id", "id", F.round("shown", 6).alias("keyword_shown"))


def budgeted(t: Tables):
    links = t.documents.select("source", c("doc_id").alias("id"))
    sources = links.select("source").distinct().withColumn(
        "daily_call_budget", F.when(F.regexp_extract("source", "([0-9]+)", 1).cast("int") % 5 == 0, 6)
    )
    return retrieve.budgeted_ids(links, sources)


_DUCK_BUDGET = "SELECT doc_id AS id FROM documents WHERE CAST(regexp_extract(source, '[0-9]+') AS INT) % 5 = 0"


@query("r12_budgeted_ids", _DUCK_BUDGET)
def budgeted_ids(t: Tables):
    return budgeted(t)


@query(
    "r13_finalists",
    f"""WITH {_DUCK_RANKED}, b AS MATERIALIZED ({_DUCK_BUDGET}),
      o AS MATERIALIZED (SELECT profile_id, id, row_number() OVER (PARTITION BY profile_id ORDER BY hybrid DESC, id) AS rn, id IN (SELECT id FROM b) AS metered FROM rk),
      h AS (SELECT profile_id, bool_or(metered) AS any_metered FROM o GROUP BY 1),
      m AS MATERIALIZED (SELECT profile_id, id FROM o JOIN h USING (profile_id) WHERE rn <= CASE WHEN any_metered THEN 6 ELSE 8 END)
      SELECT profile_id, id, 'merit' AS chosen_by FROM m
      UNION ALL SELECT profile_id, id, 'reserve' FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY rn) AS q FROM o ANTI JOIN m USING (profile_id, id) WHERE metered) WHERE q <= 2""",
)
def finalists(t: Tables):
    return retrieve.finalists(ranked(t), budgeted(t), top=8, reserved=2).select("profile_id", "id", "chosen_by")


_METERED = "CAST(regexp_extract(source, '[0-9]+') AS INT) % 5 = 0"
_DUCK_MANY = f"""d AS MATERIALIZED (SELECT doc_id AS id, embedding, text AS body, {_METERED} AS metered FROM documents JOIN embeddings ON vec_id = doc_id),
  {_duck_bm25('d')},
  s AS MATERIALIZED (SELECT d.id, item_id AS profile_id, metered, {_COS.format(a='d.embedding', b='v.embedding')} AS semantic, coalesce(kw.keyword, 0) AS keyword
    FROM d, benchmark JOIN embeddings v ON v.vec_id = item_id LEFT JOIN kw ON kw.id = d.id AND kw.profile_id = item_id),
  rk AS MATERIALIZED (SELECT id, profile_id, metered, 0.6 * CASE WHEN h1 - l1 < 1e-9 THEN 0.5 ELSE (semantic - l1) / (h1 - l1) END + 0.4 * CASE WHEN h2 - l2 < 1e-9 THEN 0.5 ELSE (keyword - l2) / (h2 - l2) END AS hybrid
    FROM s JOIN (SELECT profile_id, min(semantic) AS l1, max(semantic) AS h1, min(keyword) AS l2, max(keyword) AS h2 FROM s GROUP BY 1) USING (profile_id)),
  o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY hybrid DESC, id) AS rn FROM rk),
  m AS MATERIALIZED (SELECT * FROM o JOIN (SELECT profile_id, bool_or(metered) AS any_metered FROM o GROUP BY 1) USING (profile_id) WHERE rn <= CASE WHEN any_metered THEN 6 ELSE 8 END)"""


def many(t: Tables):
    """Every benchmark item is a profile over all documents with a vector."""
    metered = F.regexp_extract("source", "[0-9]+", 0).cast("int") % 5 == 0
    docs = t.documents.join(t.embeddings, t.documents["doc_id"] == t.embeddings["vec_id"]).select(
        c("doc_id").alias("id"), c("text").alias("body"), c("embedding").alias("vector"), metered.alias("metered")
    )
    owners = t.benchmark.join(t.embeddings, c("item_id") == c("vec_id")).select(c("item_id").alias("profile_id"), c("embedding").alias("profile_vector"))
    return by_bound.ranked_by_bound(docs, owners, item_terms(t), 8)


@query(
    "r13_many_profiles",
    f"""WITH {_DUCK_MANY} SELECT profile_id, id, round(hybrid, 6) AS hybrid, 'merit' AS chosen_by FROM m
      UNION ALL SELECT profile_id, id, round(hybrid, 6), 'reserve' FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY rn) AS q FROM o ANTI JOIN m USING (profile_id, id) WHERE metered) WHERE q <= 2""",
)
def many_profiles(t: Tables):
    rows, _ = many(t)
    chosen = retrieve.finalists(rows, budgeted(t), top=8, reserved=2)
    return chosen.select("profile_id", "id", F.round("hybrid", 6).alias("hybrid"), "chosen_by")


@query(
    "r14_top_and_above",
    f"WITH v AS ({duck('posting')}) SELECT id, score, 'top' AS kind FROM (SELECT * FROM v ORDER BY score DESC NULLS LAST, id LIMIT 10) "
    "UNION ALL SELECT id, score, 'above' FROM v WHERE score >= 60",
)
def top_and_above(t: Tables):
    rows = view(t, "posting").select("id", "score")
    return retrieve.top_scored(rows, 10).withColumn("kind", F.lit("top")).unionByName(
        retrieve.above(rows, 60).withColumn("kind", F.lit("above"))
    )


@query(
    "r15_funnel",
    f"""WITH {duck_judged()} SELECT count(*) AS examined, count_if(kind IS NULL) AS passed_filters, count_if(kind IS NULL AND vec_id IS NOT NULL) AS ranked,
      count_if(kind IS NULL AND vec_id IS NOT NULL AND score IS NOT NULL) AS scored FROM judged LEFT JOIN embeddings ON vec_id = id""",
)
def funnel(t: Tables):
    vectors = t.embeddings.select(c("vec_id").alias("id"), F.lit(True).alias("has_vector"))
    rows = judged(t).join(vectors, "id", "left").select(
        c("rejected.kind").alias("kind"), F.coalesce("has_vector", F.lit(False)).alias("has_vector"), "score"
    )
    return retrieve.funnel(rows)


# --- rubric ------------------------------------------------------------------------------------


def _stub_scorer(prompt: str):
    """Deterministic stand-in for an external scorer; fails on some prompts."""
    if len(prompt) % 17 == 0:
        raise ValueError("no answer")
    return f'{{"rationale":"{len(prompt)}"}}', len(prompt) // 4, 10


@query("g01_assess")
def assess(t: Tables):
    rows = canonical(t)
    prompts = rows.select("id", rubric.posting_prompt({n: c(n) for n in rows.columns}).alias("prompt"))
    return rubric.assess(prompts, _stub_scorer)


# An answer per labelled document: out-of-range judgements, missing parts, an extra field.
_ANSWER = """
SELECT l.doc_id AS id, CASE WHEN l.doc_id % 13 = 0 THEN '{"rationale":"incomplete"}' ELSE
  '{"must_have":' || CASE WHEN l.doc_id % 3 = 0 THEN '[]' ELSE '["a","b"]' END || ',"nice_to_have":["x"],"extra":1' ||
  ',"must_have_coverage":' || CAST(l.doc_id * 7 % 130 AS STRING) || ',"nice_to_have_coverage":' || CAST(l.doc_id * 11 % 90 - 10 AS STRING) ||
  ',"seniority_fit":' || CAST(l.doc_id * 5 % 101 AS STRING) || '.7,"domain_fit":' || CAST(l.quality * 60 + l.doc_id % 30 AS STRING) ||
  ',"location_fit":' || CAST(100 - l.toxic * 80 AS STRING) || ',"salary_fit":' || CAST(l.doc_id % 100 AS STRING) ||
  ',"languages_required":[{"code":"EN","level":"B2"},{"code":"en","level":"C1"}],"rationale":"r"}' END AS answer,
  l.doc_id % 2 = 0 AS salary_is_stated
FROM {labels} l
"""


def answers(t: Tables):
    return t.sql(_ANSWER).select("id", "salary_is_stated", rubric.read_assessment(c("answer")).alias("a"))


_DUCK_SCORES = """a AS MATERIALIZED (SELECT doc_id AS id, doc_id % 3 = 0 AS no_must, doc_id % 2 = 0 AS salary_is_stated,
    least(100, doc_id * 7 % 130) AS must_have_coverage, greatest(0, doc_id * 11 % 90 - 10) AS nice_to_have_coverage,
    least(100, doc_id * 5 % 101) AS seniority_fit, quality * 60 + doc_id % 30 AS domain_fit, 100 - toxic * 80 AS location_fit, doc_id % 100 AS salary_fit
  FROM labels WHERE doc_id % 13 <> 0),
  nz AS MATERIALIZED (SELECT * REPLACE (CASE WHEN no_must THEN 50 ELSE must_have_coverage END AS must_have_coverage, CASE WHEN salary_is_stated THEN salary_fit ELSE 50 END AS salary_fit),
    array_to_string(list_filter([CASE WHEN NOT salary_is_stated AND salary_fit <> 50 THEN 'salary_fit' END, CASE WHEN no_must AND must_have_coverage <> 50 THEN 'must_have_coverage' END], lambda x: x IS NOT NULL), ',') AS changed FROM a)"""
_ALL = ", ".join(rubric.CRITERIA)


@query("g02_read_assessment", f"WITH {_DUCK_SCORES} SELECT id, {_ALL} FROM a UNION ALL SELECT doc_id, {', '.join(['NULL'] * 6)} FROM labels WHERE doc_id % 13 = 0")
def read_assessment(t: Tables):
    return answers(t).select("id", *[c(f"a.{n}").alias(n) for n in rubric.CRITERIA])


def neutral(t: Tables):
    fixed, changed = rubric.neutralize_unknowable(c("a"), c("salary_is_stated"))
    return answers(t).where("a IS NOT NULL").select("id", fixed.alias("a"), F.array_join(changed, ",").alias("changed"))


@query("g03_neutralize", f"WITH {_DUCK_SCORES} SELECT id, {_ALL}, changed FROM nz")
def neutralize(t: Tables):
    return neutral(t).select("id", *[c(f"a.{n}").alias(n) for n in rubric.CRITERIA], "changed")


_TOTAL = " + ".join(f"CAST({n} AS DOUBLE) * CAST({w} AS DOUBLE)" for n, w in fv.RUBRIC_WEIGHTS.items())
_SUM = repr(sum(fv.RUBRIC_WEIGHTS.values()))


@query("g04_weighted_total", f"WITH {_DUCK_SCORES} SELECT id, CAST(round_even(({_TOTAL}) / CAST({_SUM} AS DOUBLE), 0) AS INT) AS score FROM nz")
def weighted_total(t: Tables):
    return neutral(t).select("id", rubric.weighted_total({n: c(f"a.{n}") for n in rubric.CRITERIA}).alias("score"))


@query("g05_requirements")
def requirements(t: Tables):
    rows = answers(t).where("a IS NOT NULL").select("id", rubric.requirements(c("a")).alias("r"))
    return rows.select("id", F.array_join("r.must_have", ",").alias("must_have"), F.to_json("r.languages_required").alias("languages"))


def _stage_inputs(t: Tables):
    """Existing matches for half of the postings; new outcomes from filters and ids."""
    # All four inputs come from one evaluation, as they would in the daily job.
    rows = cut_lineage(judged(t).select("id", "rejected", "score", "reached_stage"))
    matches = rows.where("id % 2 = 0").select(
        c("id").alias("job_id"), F.lit("seen").alias("status"), "reached_stage", F.lit("old").alias("filtered_reason"),
        F.lit(0.25).alias("hybrid_score"), F.lit("before").alias("rationale"), F.array(F.lit("old gap")).alias("gaps"), "score", F.lit("2024-01-01").cast("timestamp").alias("scored_at"),
    )
    fresh = rows.where("id % 3 > 0")
    rejected = fresh.where("rejected IS NOT NULL").select(c("id").alias("job_id"), filters.reason_text(c("rejected")).alias("reason"))
    passed = fresh.where("rejected IS NULL").select(c("id").alias("job_id"), (c("id") % 100 / 100).alias("hybrid_score"), (c("id") % 7 / 7).alias("semantic_score"), (c("id") % 9 / 9).alias("keyword_score"))
    scored = passed.where("job_id % 5 = 0").withColumns({
        "score": (c("job_id") % 101).cast("long"), "gaps": F.array(F.lit("x"), c("job_id").cast("string")),
        "rationale": F.concat(F.lit("because "), c("job_id").cast("string")), "scorer": F.lit("model"),
        **{f"{n}_score": (c("job_id") % (k + 11)).cast("double") for k, n in enumerate(rubric.CRITERIA)},
    })
    return matches, rejected, passed.where("job_id % 5 > 0"), scored


@query(
    "g06_upsert_results",
    f"""WITH {duck_judged()}, m AS (SELECT id AS job_id, 'seen' AS status, reached_stage, 'old' AS filtered_reason, 0.25 AS hybrid_score, 'before' AS rationale, score FROM judged WHERE id % 2 = 0),
      n AS (SELECT id AS job_id, CASE WHEN kind IS NOT NULL THEN 0 WHEN id % 5 > 0 THEN 1 ELSE 2 END AS stage, reason, id % 100 / 100 AS hybrid, id % 101 AS new_score FROM judged WHERE id % 3 > 0)
      SELECT coalesce(m.job_id, n.job_id) AS job_id, coalesce(status, 'new') AS status,
        CASE stage WHEN 0 THEN 0 WHEN 1 THEN greatest(coalesce(reached_stage, 0), 1) WHEN 2 THEN 2 ELSE reached_stage END AS reached_stage,
        CASE WHEN stage = 0 THEN reason WHEN stage IS NULL THEN filtered_reason END AS filtered_reason,
        CAST(CASE WHEN stage >= 1 THEN hybrid ELSE hybrid_score END AS DOUBLE) AS hybrid_score, CASE WHEN stage >= 1 THEN n.job_id % 7 / 7 END AS semantic_score,
        CASE WHEN stage >= 1 THEN n.job_id % 9 / 9 END AS keyword_score, CASE WHEN stage = 2 THEN new_score ELSE score END AS score,
        CASE WHEN stage = 2 THEN 'because ' || n.job_id ELSE rationale END AS rationale, CASE WHEN stage = 2 THEN 'model' END AS scorer,
        CASE WHEN stage = 2 THEN 'x,' || n.job_id WHEN m.job_id IS NOT NULL THEN 'old gap' END AS gaps,
        {', '.join(f'CASE WHEN stage = 2 THEN CAST(n.job_id % {k + 11} AS DOUBLE) END AS {n}_score' for k, n in enumerate(rubric.CRITERIA))}
      FROM m FULL JOIN n ON m.job_id = n.job_id""",
)
def upsert_results(t: Tables):
    out = rubric.upsert_results(*_stage_inputs(t), F.lit("2024-06-01").cast("timestamp"))
    return out.drop("scored_at").withColumn("gaps", F.array_join("gaps", ","))


def _scored(t: Tables):
    rows = view(t, "posting").where("score IS NOT NULL").select(c("id").alias("job_id"), "score", "title", "company")
    return rows, rows.where("job_id % 3 = 0")


_FRESH = "SELECT id, score, title, company FROM v WHERE score IS NOT NULL AND id % 3 <> 0"


def _posting_cte(body: str) -> str:
    return f"WITH v AS ({duck('posting')}) {body}"


@query("g07_newly_scored", _posting_cte(_FRESH.replace("id, score, title, company", "id AS job_id")))
def newly_scored(t: Tables):
    return rubric.newly_scored(*_scored(t)).select("job_id")


@query("g08_digest", _posting_cte(f"SELECT id AS job_id, score, score || ' · ' || title || ' · ' || company AS line FROM ({_FRESH}) WHERE score >= 60"))
def digest(t: Tables):
    return rubric.digest(*_scored(t), threshold=60)


# --- flagship ----------------------------------------------------------------------------------


def shortlist(t: Tables):
    """Filters with reasons, then BM25 over what passed; the best hundred per profile."""
    passed = judged(t).where("rejected IS NULL")
    body = retrieve.lexical_text(c("title"), c("job_family"), c("description"))
    scores = retrieve.bm25(passed.select("id", body.alias("body")), item_terms(t))
    best = scores.join(passed.select("id", "title", "company_normalized", "work_mode", "country"), "id")
    order = Window.partitionBy("profile_id").orderBy(F.desc("keyword"), "id")
    return best.withColumn("place", F.row_number().over(order)).where("place <= 100")
