"""Student's t without a special-function library.

With theta = atan(|t| / sqrt(df)), the two-sided tail is the ratio of the integrals of
cos(x)^(df - 1) from theta and from 0 to pi / 2. Both are Simpson sums that end where the
integrand has vanished. Accuracy is lower for df under 3.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 2000


def _integral(start: str, df: str) -> str:
    end = f"least(pi() / 2, ({start}) + 12 / sqrt({df}))"
    step = f"(({end} - ({start})) / {STEPS})"
    return f"{step} / 3 * aggregate(sequence(0, {STEPS}), 0.0D, (s, i) -> s + IF(i = 0 OR i = {STEPS}, 1.0D, IF(i % 2 = 1, 4.0D, 2.0D)) * pow(greatest(cos(({start}) + i * {step}), 0.0D), {df} - 1))"


def two_sided_p(t: str, df: str) -> Column:
    """Column of two-sided p-values from the names of a t and a df column; null for nulls.

    An infinite df (a zero standard error) gives 1.
    """
    theta = f"atan(abs({t}) / sqrt({df}))"
    return F.when(F.col(df) == float("inf"), F.lit(1.0)).otherwise(F.expr(f"({_integral(theta, df)}) / ({_integral('0.0D', df)})"))


def _tail(t: float, df: float) -> float:
    def integral(start: float) -> float:
        end = min(math.pi / 2, start + 12 / math.sqrt(df))
        h = (end - start) / STEPS
        return h / 3 * sum((1 if i in (0, STEPS) else 4 if i % 2 else 2) * max(math.cos(start + i * h), 0.0) ** (df - 1) for i in range(STEPS + 1))

    return integral(math.atan(abs(t) / math.sqrt(df))) / integral(0.0)


def critical(df: float, alpha: float) -> float:
    """The t whose two-sided tail is ``alpha``, by bisection; infinite df: the normal limit."""
    df = min(df, 1e9)
    low, high = 0.0, 1.0
    while _tail(high, df) > alpha and high < 1e9:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _tail(mid, df) > alpha else (low, mid)
    return (low + high) / 2


def critical_udf(alpha: float):
    """Pandas UDF of ``critical`` for the few rows of a table of contrasts."""

    @F.pandas_udf("double")
    def run(df: pd.Series) -> pd.Series:
        return df.map(lambda x: None if pd.isna(x) else critical(x, alpha))

    return run


def format_p(p: Column) -> Column:
    """Text of a p-value: NA, below 0.001 in scientific notation, else four places."""
    return (
        F.when(p.isNull() | F.isnan(p), "NA")
        .when(p == 0, "p < 0.001")
        .when(p < 0.001, F.format_string("p = %.3e", p))
        .otherwise(F.format_string("p = %.4f", p))
    )
