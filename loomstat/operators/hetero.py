"""Whether effects differ by feature: Cochran's Q over cells, slope differences, and Holm over all of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions.normal import chi_square_tail
from loomstat.functions.student import two_sided_p
from loomstat.operators import inference

CATEGORIES = ("newbie", "mens", "womens", "channel", "zip_code")
NUMBERS = ("recency", "history")


def cells(units: DataFrame, features: Iterable[str], outcomes: Iterable[str], pairs) -> DataFrame:
    """``feature, value, outcome, contrast, a, b, difference, standard_error`` and the arms' statistics in
    each cell. A null value is a cell of its own, ``(missing)``. All features go in one pass."""
    features = list(features)
    rows = inference.long_outcomes(units, outcomes, ("arm", *features))
    values = ", ".join(f"'{f}', coalesce(CAST({f} AS STRING), '(missing)')" for f in features)
    rows = rows.select("arm", "outcome", "y", F.expr(f"stack({len(features)}, {values}) AS (feature, value)"))
    by = ["feature", "value", "outcome"]
    both = inference.contrasts(inference.moments(rows, [*by, "arm"]), pairs, by=by)
    error = F.expr("sqrt(var_a / n_a + var_b / n_b)")
    return both.withColumns({"difference": F.col("mean_a") - F.col("mean_b"), "standard_error": error})


def cell_tests(found: DataFrame) -> DataFrame:
    """Per feature, outcome and contrast: ``k`` cells with a standard error, Q as ``statistic``, k - 1 as ``df``, and p."""
    by = ["feature", "outcome", "contrast", "a", "b"]
    w = found.where("standard_error > 0").withColumn("w", F.expr("1 / (standard_error * standard_error)"))
    pooled = w.groupBy(*by).agg((F.sum(F.expr("w * difference")) / F.sum("w")).alias("estimate"))
    # Squares about the pooled difference keep their digits.
    squares = w.join(pooled, by).groupBy(*by, "estimate").agg(F.sum(F.expr("w * (difference - estimate) * (difference - estimate)")).alias("statistic"), (F.count(F.lit(1)) - 1).cast("double").alias("df"))
    made = squares.select(*by, F.lit("cells").alias("kind"), "estimate", "statistic", "df")
    return made.withColumn("p_value", chi_square_tail("statistic", "CAST(df AS INT)"))


def slope_tests(units: DataFrame, features: Iterable[str], outcomes: Iterable[str], pairs) -> DataFrame:
    """Per feature, outcome and contrast: the difference of the arms' slopes as ``estimate``, its t as
    ``statistic``, ``df``, and p. Sums are about the feature's mean, in one pass after it."""
    features = list(features)
    means = units.agg(*(F.avg(f).alias(f) for f in features)).first()
    centred = units.select("*", *(F.expr(f"CAST({f} AS DOUBLE) - {float(means[f] or 0.0)!r}D").alias(f"_{f}") for f in features))
    rows = inference.long_outcomes(centred, outcomes, ("arm", *(f"_{f}" for f in features)))
    rows = rows.select("arm", "outcome", "y", F.expr(f"stack({len(features)}, {', '.join(f"'{f}', _{f}" for f in features)}) AS (feature, x)")).where("x IS NOT NULL AND y IS NOT NULL")
    fits = rows.groupBy("feature", "outcome", "arm").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("mean"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    # A slope in place of a mean, its squared error in place of a variance over n.
    error = F.expr("try_divide(greatest(syy - try_divide(sxy * sxy, sxx), 0.0D), n - 2) / nullif(sxx, 0.0D) * n")
    both = inference.contrasts(fits.withColumn("var", error), pairs, by=["feature", "outcome"])
    both = both.selectExpr("feature", "outcome", "contrast", "a", "b", "'slope' AS kind", "mean_a - mean_b AS estimate", "try_divide(mean_a - mean_b, sqrt(var_a / n_a + var_b / n_b)) AS statistic", "CAST(n_a + n_b - 4 AS DOUBLE) AS df")
    return both.withColumn("p_value", two_sided_p("statistic", "df"))


def feature_tests(units: DataFrame, outcomes: Iterable[str], pairs, categories: Iterable[str] = CATEGORIES, numbers: Iterable[str] = NUMBERS) -> DataFrame:
    """``feature, outcome, contrast, a, b, kind, estimate, statistic, df, p_value, p_holm`` of all features, outcomes and
    contrasts; Holm's adjustment is over the features and contrasts of an outcome. A feature with
    a single cell has no p-value and takes no part in it."""
    outcomes = list(outcomes)
    found = cell_tests(cells(units, categories, outcomes, pairs)).unionByName(slope_tests(units, numbers, outcomes, pairs))
    return inference.holm(found, ["outcome"], tie=("feature", "contrast"))
