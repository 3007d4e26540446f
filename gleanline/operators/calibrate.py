"""Calibration of rubric weights against labels by rank correlation.

Scores and labels are small integers, so everything works on histograms: equal examples are
counted once, and ranks come from counts. The number of labelled rows only matters to the first
aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv

CRITERIA = list(fv.RUBRIC_WEIGHTS)
STEPS = 20  # grid step 0.05
MIN_EXAMPLES, MIN_HALF, MIN_GAIN = 10, 5, 0.05
WEIGHTS = [f"w{i}" for i in range(1, len(CRITERIA) + 1)]


def read_labels(rows: DataFrame) -> DataFrame:
    """Parse a label sheet: blank or non-numeric labels drop, decimal commas pass, gaps are neutral."""
    label = F.regexp_replace(F.trim("label"), ",", ".").try_cast("double")
    numbers = [F.coalesce(F.trim(n).try_cast("double"), F.lit(float(fv.NEUTRAL_SCORE))).alias(n) for n in CRITERIA]
    return rows.select("match_id", label.alias("label"), *numbers).where("label IS NOT NULL")


def compress(examples: DataFrame, *keys: str) -> DataFrame:
    """Distinct examples with their count n."""
    return examples.groupBy(*keys, "label", *CRITERIA).agg(F.count("*").alias("n"))


def weight_grid(rows: DataFrame) -> DataFrame:
    """Give every row all weight vectors of the grid, in integer steps that sum to STEPS.

    Generators only: each row unfolds where it is, the last weight is the remainder.
    """
    used: Column = F.lit(0)
    for name in WEIGHTS[:-1]:
        rows = rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(STEPS) - used)))
        used = used + F.col(name)
    return rows.withColumn(WEIGHTS[-1], F.lit(STEPS) - used)


def average_ranks(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, rank) of a histogram with counts n: ties share their mean rank, from zero."""
    counts = values.groupBy(*keys, value).agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    rank = F.coalesce(before, F.lit(0)) + (F.col("n") - 1) / 2
    return counts.withColumn("rank", rank).drop("n")


def spearman(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, examples, rho) of weighted pairs (keys, x, y, n); 0 when either side is constant."""
    xs = average_ranks(pairs, keys, "x").withColumnRenamed("rank", "rx")
    ys = average_ranks(pairs, keys, "y").withColumnRenamed("rank", "ry")
    ranked = pairs.join(xs, [*keys, "x"]).join(ys, [*keys, "y"])
    sums = ranked.groupBy(*keys).agg(
        F.sum("n").alias("examples"),
        F.sum(F.col("n") * F.col("rx") * F.col("ry")).alias("xy"),
        F.sum(F.col("n") * F.col("rx") * F.col("rx")).alias("xx"),
        F.sum(F.col("n") * F.col("ry") * F.col("ry")).alias("yy"),
    )
    return sums.select(*keys, "examples", _rho(F.col("examples"), F.col("xy"), F.col("xx"), F.col("yy")).alias("rho"))


def _rho(count: Column, xy: Column, xx: Column, yy: Column) -> Column:
    centre = count * F.pow((count - 1) / 2, F.lit(2))
    spread = (xx - centre) * (yy - centre)
    return F.when(spread <= 0, 0.0).otherwise((xy - centre) / F.sqrt(spread))


def grid_scores(examples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, weights, rho) of every weight vector; `examples` is compressed.

    Label ranks are computed once; predictions are ranked inside their weight vector, where they are
    integers. Rows of one vector meet in one partition once, for both the counts and the ranks.
    """
    labels = examples.select(*keys, F.col("label").alias("y"), "n")
    label_rank = average_ranks(labels, keys, "y").select(*keys, F.col("y").alias("label"), F.col("rank").alias("ry"))
    with_rank = examples.join(label_rank, [*keys, "label"])
    prediction = sum(
        (F.col(w) * F.col(c).cast("int") for w, c in zip(WEIGHTS, CRITERIA, strict=True)), start=F.lit(0)
    )
    vector = [*keys, *WEIGHTS]
    predicted = weight_grid(with_rank).select(*vector, prediction.alias("p"), "n", "ry").repartition(*vector)
    groups = predicted.groupBy(*vector, "p").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("ry")).alias("sy"), F.sum(F.col("n") * F.col("ry") * F.col("ry")).alias("syy")
    )
    before = F.sum("n").over(Window.partitionBy(*vector).orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    rx = F.coalesce(before, F.lit(0)) + (F.col("n") - 1) / 2
    sums = groups.withColumn("rx", rx).groupBy(*vector).agg(
        F.sum("n").alias("count"),
        F.sum(F.col("rx") * F.col("sy")).alias("xy"),
        F.sum(F.col("n") * F.col("rx") * F.col("rx")).alias("xx"),
        F.sum("syy").alias("yy"),
    )
    return sums.select(*vector, F.round(_rho(F.col("count"), F.col("xy"), F.col("xx"), F.col("yy")), 9).alias("rho"))


def best_weights(examples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, weights, rho): highest correlation; the first vector in grid order wins ties."""
    scores = grid_scores(examples, keys)
    best = F.min(F.struct((-F.col("rho")).alias("cost"), *WEIGHTS))
    # The literal key keeps one code path for a single calibration.
    return scores.groupBy(*(keys or [F.lit(0).alias("all")])).agg(best.alias("b")).select(
        *keys, *[F.col(f"b.{w}").alias(w) for w in WEIGHTS], (-F.col("b.cost")).alias("rho")
    )


def current_prediction() -> Column:
    """Weighted score with the weights in force, in points."""
    return sum((F.col(c) * F.lit(w) for c, w in fv.RUBRIC_WEIGHTS.items()), start=F.lit(0.0))


def _steps(weight: float) -> int:
    return round(weight * STEPS)


def _current_steps() -> Column:
    return sum((F.col(c) * F.lit(_steps(w)) for c, w in fv.RUBRIC_WEIGHTS.items()), start=F.lit(0.0))


def stability(examples: DataFrame) -> DataFrame:
    """(half, cross_rho, current_rho, holds): weights found on one half, checked on the other.

    `examples` has column half (0 or 1) and is compressed by it.
    """
    found = best_weights(examples, ["half"]).withColumn("half", 1 - F.col("half")).drop("rho")
    both = examples.join(found, "half")
    crossed = sum((F.col(w) * F.col(c) for w, c in zip(WEIGHTS, CRITERIA, strict=True)), start=F.lit(0.0))
    cross = spearman(both.select("half", crossed.alias("x"), F.col("label").alias("y"), "n"), ["half"])
    now = spearman(examples.select("half", _current_steps().alias("x"), F.col("label").alias("y"), "n"), ["half"])
    return (
        cross.where(F.col("examples") >= MIN_HALF)
        .select("half", F.col("rho").alias("cross_rho"))
        .join(now.select("half", F.col("rho").alias("current_rho")), "half")
        .withColumn("holds", F.col("cross_rho") > F.col("current_rho"))
    )


def current_fit(examples: DataFrame) -> DataFrame:
    """(criterion, rho, mean_error, best_rho, keep): each criterion alone and the weighted total; none under 10 examples.

    On the total, `best_rho` is what the best weights of the grid reach; `keep` says that they gain less than
    MIN_GAIN over the weights in force, which noise explains.
    """
    sides = F.array(
        *[F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("x")) for c in CRITERIA],
        F.struct(F.lit("total").alias("criterion"), _current_steps().alias("x")),
    )
    pairs = examples.select(F.col("label").alias("y"), "n", F.inline(sides))
    rho = spearman(pairs, ["criterion"])
    error = examples.agg(
        (F.sum(F.col("n") * F.abs(current_prediction() - F.col("label"))) / F.sum("n")).alias("mean_error")
    ).withColumn("criterion", F.lit("total"))
    best = best_weights(examples, []).select(F.lit("total").alias("criterion"), F.col("rho").alias("best_rho"))
    return (
        rho.where(F.col("examples") >= MIN_EXAMPLES)
        .join(error, "criterion", "left")
        .join(best, "criterion", "left")
        .select("criterion", "rho", "mean_error", "best_rho", (F.round(F.col("best_rho") - F.col("rho"), 6) < MIN_GAIN).alias("keep"))
    )


def worst_errors(examples: DataFrame, n: int = 5) -> DataFrame:
    """Largest disagreements between the score in force and the label. Needs match_id."""
    error = F.round(current_prediction() - F.col("label"), 6)
    sign = F.when(F.col("error") > 0, "sopravvaluta").otherwise("sottovaluta")
    rows = examples.select("match_id", "label", error.alias("error")).withColumn("sign", sign)
    return rows.orderBy(F.desc(F.abs("error")), "match_id").limit(n)


def export_sheet(matches: DataFrame, limit: int = 30, min_score: int = 0) -> DataFrame:
    """Best-scored rows with an empty label column, low scores included on purpose."""
    rows = matches.where(F.col("score") >= min_score).orderBy(F.desc("score"), "match_id").limit(limit)
    return rows.select("match_id", F.lit("").alias("label"), "title", "company", "score", *CRITERIA, F.coalesce("apply_url", "url").alias("url"))
