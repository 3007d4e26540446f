"""Rubric scoring around an external scorer, and the snapshot of results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv

CRITERIA = list(fv.RUBRIC_WEIGHTS)
ASSESSMENT_SCHEMA = (
    "must_have array<string>, nice_to_have array<string>, tech_stack array<string>, "
    "min_years_experience int, max_years_experience int, "
    "languages_required array<struct<code:string,level:string>>, remote_policy string, "
    "requires_work_authorization boolean, red_flags array<string>, "
    + ", ".join(f"{c} double" for c in CRITERIA)
    + ", rationale string, gaps array<string>"
)


def posting_prompt(c: dict[str, Column], chars: int | None = None) -> Column:
    """The posting block of a scoring request; `chars` (e.g. PROMPT_CHARS) shortens the description."""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), value)

    place = F.nullif(F.concat_ws(", ", c["city"], c["region"], c["country"]), F.lit(""))
    pay = F.when(~c["salary_is_stated"], f"not stated (salary_fit must be {fv.NEUTRAL_SCORE})").otherwise(
        F.concat_ws("-", F.nullif(c["salary_min"], F.lit(0)), F.nullif(c["salary_max"], F.lit(0)))
    )
    return F.concat_ws(
        "\n",
        line("Title", c["title"]),
        line("Company", c["company"]),
        line("Place", place),
        line("Work mode", c["work_mode"]),
        line("Contract", c["contract_type"]),
        line("Level", c["seniority"]),
        line("Salary", pay),
        c["description"] if chars is None else F.substring(c["description"], 1, chars),
    )


def assess(prompts: DataFrame, scorer: Callable[[str], tuple[str, int, int]]) -> DataFrame:
    """Call `scorer(prompt) -> (answer_json, input_tokens, output_tokens)` for every (id, prompt) row.

    A failing row carries its error and the others go on. Pacing, retries and credentials belong to
    `scorer`; Spark supplies partitions and Arrow batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for ident, prompt in zip(frame["id"], frame["prompt"], strict=True):
                try:
                    answer, used_in, used_out = scorer(prompt)
                    rows.append((ident, answer, None, used_in, used_out))
                except Exception as error:  # noqa: BLE001 - user code
                    rows.append((ident, None, f"{type(error).__name__}: {error}", 0, 0))
            yield pd.DataFrame(rows, columns=["id", "answer", "error", "input_tokens", "output_tokens"])

    schema = "id long, answer string, error string, input_tokens long, output_tokens long"
    return prompts.select("id", "prompt").mapInPandas(run, schema)


def read_assessment(answer: Column) -> Column:
    """Parsed answer with judgements clamped to 0..100; NULL when a required part is missing."""
    parsed = F.from_json(answer, ASSESSMENT_SCHEMA)
    clamped = parsed
    for name in CRITERIA:
        value = F.greatest(F.lit(0.0), F.least(F.lit(100.0), parsed[name])).cast("int")
        clamped = clamped.withField(name, F.when(parsed[name].isNotNull(), value))
    complete = parsed["rationale"].isNotNull()
    for name in CRITERIA:
        complete = complete & parsed[name].isNotNull()
    return F.when(complete, clamped)


def neutralize_unknowable(assessment: Column, salary_is_stated: Column) -> tuple[Column, Column]:
    """(assessment, names changed): criteria without anything to judge go back to neutral."""
    rules = {
        "salary_fit": ~salary_is_stated,
        "must_have_coverage": F.coalesce(F.size(assessment["must_have"]), F.lit(0)) == 0,
        "nice_to_have_coverage": F.coalesce(F.size(assessment["nice_to_have"]), F.lit(0)) == 0,
    }
    out, changed = assessment, []
    for name, unknowable in rules.items():
        out = out.withField(name, F.when(unknowable, fv.NEUTRAL_SCORE).otherwise(assessment[name]))
        changed.append(F.when(unknowable & (assessment[name] != fv.NEUTRAL_SCORE), name))
    return out, F.array_compact(F.array(*changed))


def weighted_total(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean, half-even; an absent criterion is neutral."""
    weights = weights or fv.RUBRIC_WEIGHTS
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("rubric weights sum to zero")
    points = F.lit(0.0)
    for name, weight in weights.items():
        value = scores.get(name, F.lit(None).cast("int"))
        clamped = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(value, F.lit(fv.NEUTRAL_SCORE))))
        points = points + clamped * F.lit(float(weight))
    return F.bround(points / total).cast("int")


def requirements(assessment: Column) -> Column:
    """Requirement fields; the language list becomes a map with lower-case codes (last one wins)."""
    listed = assessment["languages_required"]
    last = F.filter(
        listed,
        lambda entry, i: ~F.exists(
            F.slice(listed, i + 2, F.size(listed)), lambda later: F.lower(later["code"]) == F.lower(entry["code"])
        ),
    )
    languages = F.map_from_entries(
        F.transform(F.coalesce(last, F.array().cast("array<struct<code:string,level:string>>")), lambda e: F.struct(F.lower(e["code"]), e["level"]))
    )
    names = ["must_have", "nice_to_have", "tech_stack", "min_years_experience", "max_years_experience"]
    return F.struct(
        *[assessment[n].alias(n) for n in names],
        languages.alias("languages_required"),
        *[assessment[n].alias(n) for n in ("remote_policy", "requires_work_authorization", "red_flags")],
    )


#: What ranking and scoring leave in the match table.
RANKED = ("hybrid_score", "semantic_score", "keyword_score")
SCORED = ("score", *[f"{c}_score" for c in CRITERIA], "rationale", "gaps", "scorer")


def requirement_rows(scored: DataFrame) -> DataFrame:
    """(job_id, position, kind, term) of a scored posting's requirements: must_have, nice_to_have and tech_stack."""
    kinds = ("must_have", "nice_to_have", "tech_stack")
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("terms")) for k in kinds])
    rows = scored.select("job_id", F.inline(listed))
    return rows.select("job_id", "kind", F.posexplode("terms").alias("position", "term"))


def upsert_results(
    matches: DataFrame, rejected: DataFrame, ranked: DataFrame, scored: DataFrame, now: Column
) -> DataFrame:
    """New snapshot of the match table.

    A rejection sets stage 0 and its reason but keeps an old score; a ranked posting sets its stage
    1 scores; a scored one sets everything. Each posting is in exactly one of the three inputs:
    rejected(job_id, reason), ranked(job_id, RANKED), scored(job_id, RANKED, SCORED). `matches` holds
    the same columns; one that is missing anywhere counts as NULL there.
    """
    kinds = {f.name: f.dataType for df in (matches, ranked, scored) for f in df.schema}

    def completed(df: DataFrame, columns: tuple[str, ...]) -> list[Column]:
        return [F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, T.StringType())).alias(c) for c in columns]

    outcome = (*RANKED, *SCORED)
    news = (
        rejected.select("job_id", "reason", F.lit(0).alias("stage"))
        .unionByName(ranked.select("job_id", *completed(ranked, RANKED), F.lit(1).alias("stage")), True)
        .unionByName(scored.select("job_id", *completed(scored, outcome), F.lit(2).alias("stage")), True)
        .select("job_id", *[F.col(c).alias(f"new_{c}") for c in ("reason", "stage", *outcome)])
    )
    fixed = ("job_id", "status", "reached_stage", "filtered_reason", "scored_at")
    matches = matches.select(*fixed, *completed(matches, outcome))
    both = matches.join(news, "job_id", "full")
    stage = F.col("new_stage")
    old_stage = F.coalesce("reached_stage", F.lit(0))
    return both.select(
        "job_id",
        F.coalesce("status", F.lit("new")).alias("status"),
        F.when(stage == 0, 0).when(stage == 1, F.greatest(old_stage, F.lit(1))).when(stage == 2, 2).otherwise(old_stage).alias("reached_stage"),
        F.when(stage == 0, F.col("new_reason")).when(stage.isNull(), F.col("filtered_reason")).alias("filtered_reason"),
        *[F.when(stage >= 1, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in RANKED],
        *[F.when(stage == 2, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in SCORED],
        F.when(stage == 2, now).otherwise(F.col("scored_at")).alias("scored_at"),
    )


def newly_scored(scored: DataFrame, matches: DataFrame) -> DataFrame:
    """Scored postings that had no match row before, so that a rescore is not announced twice."""
    return scored.join(matches.select("job_id"), "job_id", "left_anti")


def digest(scored: DataFrame, matches: DataFrame, threshold: int) -> DataFrame:
    """New postings at or above the threshold, best first, with a line of text each."""
    line = F.concat_ws(" · ", F.col("score").cast("string"), "title", "company")
    chosen = newly_scored(scored, matches).where(F.col("score") >= threshold)
    return chosen.select("job_id", "score", line.alias("line")).orderBy(F.desc("score"), "job_id")
