"""Guards and audits of a table of randomised units."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validate_groups(df: DataFrame, arms: Iterable, column: str = "arm") -> DataFrame:
    """``df`` itself, or ValueError unless the non-null arms are exactly ``arms``."""
    seen = set(df.agg(F.collect_set(column)).first()[0])
    if seen != set(arms):
        raise ValueError(f"arms are {sorted(seen)}, expected {sorted(arms)}")
    return df


def binary_violations(df: DataFrame, columns: Iterable[str], strict: bool = False) -> DataFrame:
    """``column, n_bad, n_null`` in one pass. Text that is no number counts as missing, or with
    ``strict`` as bad."""
    counts, columns = [], list(columns)
    for c in columns:
        number = F.expr(f"try_cast({c} AS DOUBLE)")
        bad = number.isNotNull() & ~number.isin(0.0, 1.0)
        if strict:
            bad = bad | (number.isNull() & F.col(c).isNotNull())
        counts += [F.count_if(bad).alias(f"bad_{c}"), F.count_if(number.isNull()).alias(f"null_{c}")]
    pairs = ", ".join(f"'{c}', bad_{c}, null_{c}" for c in columns)
    return df.agg(*counts).select(F.expr(f"stack({len(columns)}, {pairs}) AS (column, n_bad, n_null)"))


def validate_binary(df: DataFrame, columns: Iterable[str], strict: bool = False) -> DataFrame:
    """``df`` itself, or ValueError naming the first column that holds more than 0 and 1."""
    columns = list(columns)
    bad = {r["column"] for r in binary_violations(df, columns, strict).where("n_bad > 0").collect()}
    for c in columns:
        if c in bad:
            raise ValueError(f"column {c} is not binary")
    return df


def missing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``column, n_missing, n_rows``."""
    columns = list(columns)
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in columns))
    return one.select(F.expr(f"stack({len(columns)}, {', '.join(f"'{c}', m_{c}" for c in columns)}) AS (column, n_missing)"), "n_rows")


def arm_ratio(df: DataFrame, shares: dict, column: str = "arm") -> DataFrame:
    """Chi-square of arm counts against planned shares; exact p for three arms (2 df)."""
    counts = [F.count_if(F.col(column) == a).alias(f"n_{a}") for a in shares]
    total = sum((F.col(f"n_{a}") for a in shares), F.lit(0))
    chi = sum(((F.col(f"n_{a}") - total * s) * (F.col(f"n_{a}") - total * s) / (total * s) for a, s in shares.items()), F.lit(0.0))
    out = df.agg(*counts).withColumn("chi2", chi)
    return out.withColumn("p_value", F.exp(-F.col("chi2") / 2)) if len(shares) == 3 else out


def balance(df: DataFrame, features: Iterable[str], pair: tuple) -> DataFrame:
    """``feature, smd``: standardised mean difference of numeric features between two arms."""
    a, b = pair
    features = list(features)
    aggs = [f(F.when(F.col("arm") == arm, F.col(x))).alias(f"{n}_{s}_{x}") for x in features for n, f in (("m", F.avg), ("v", F.var_samp)) for s, arm in (("a", a), ("b", b))]
    rows = ", ".join(f"'{x}', try_divide(m_a_{x} - m_b_{x}, sqrt((v_a_{x} + v_b_{x}) / 2))" for x in features)
    return df.agg(*aggs).select(F.expr(f"stack({len(features)}, {rows}) AS (feature, smd)"))


def category_balance(df: DataFrame, features: Iterable[str], pair: tuple) -> DataFrame:
    """``feature, value, share_a, share_b, smd`` of categories in two arms, nulls as ``(missing)``; the standardised
    difference of two shares, null where both are 0 or 1."""
    a, b = pair
    features = list(features)
    values = ", ".join(f"'{f}', coalesce(CAST({f} AS STRING), '(missing)')" for f in features)
    rows = df.where(F.col("arm").isin(a, b)).select("arm", F.expr(f"stack({len(features)}, {values}) AS (feature, value)"))
    counts = rows.groupBy("feature", "value").agg(F.count_if(F.col("arm") == a).alias("n_a"), F.count_if(F.col("arm") == b).alias("n_b"))
    totals = Window.partitionBy("feature")  # a row per value
    shares = counts.select("feature", "value", (F.col("n_a") / F.sum("n_a").over(totals)).alias("share_a"), (F.col("n_b") / F.sum("n_b").over(totals)).alias("share_b"))
    return shares.withColumn("smd", F.expr("try_divide(share_a - share_b, sqrt((share_a * (1 - share_a) + share_b * (1 - share_b)) / 2))"))


def duplicates(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``n_groups, n_extra``: groups of equal rows, and rows beyond the first of each."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return groups.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_extra"))


def outcome_logic(df: DataFrame) -> DataFrame:
    """Counts of units whose outcomes contradict each other."""
    return df.agg(
        F.count_if(F.expr("conversion = 1 AND visit = 0")).alias("converted_unvisited"), F.count_if(F.expr("spend > 0 AND conversion = 0")).alias("spent_unconverted"), F.count_if(F.col("spend") < 0).alias("negative_spend")
    )
