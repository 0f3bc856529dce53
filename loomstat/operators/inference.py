"""Mean contrasts between arms from sufficient statistics, and multiplicity control."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.student import critical_udf, two_sided_p
from loomstat.operators import resampling


#: Strata up to which their sizes are broadcast.
MOST_STRATA = 10_000


def long_outcomes(units: DataFrame, outcomes: Iterable[str], keys: Iterable[str] = ("arm",)) -> DataFrame:
    """``keys, outcome, y``: one row per unit and outcome."""
    pairs = ", ".join(f"'{o}', CAST({o} AS DOUBLE)" for o in outcomes)
    return units.select(*keys, F.expr(f"stack({len(list(outcomes))}, {pairs}) AS (outcome, y)"))


def moments(rows: DataFrame, by: Iterable[str]) -> DataFrame:
    """``n, n_null, mean, var`` of ``y`` by groups; nulls are counted, not used."""
    return rows.groupBy(*by).agg(F.count("y").alias("n"), F.count_if(F.col("y").isNull()).alias("n_null"), F.avg("y").alias("mean"), F.var_samp("y").alias("var"))


def contrasts(stats: DataFrame, pairs, by: Iterable[str] = ("outcome",)) -> DataFrame:
    """Both arms' statistics side by side for each planned pair (a, b).

    One pass over ``stats``, a row per group and arm, whose plan is not run once for either side.
    """
    by, names = list(by), ("n", "mean", "var")
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    arms = sorted({arm for pair in pairs for arm in pair})
    wide = stats.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by)).groupBy(*by).agg(*(of(arm, c).alias(f"{c}_{k}") for k, arm in enumerate(arms) for c in names))
    side = lambda arm, s: [F.col(f"{c}_{arms.index(arm)}").alias(f"{c}_{s}") for c in names]
    plan = F.array(*(F.struct(F.lit(k).alias("contrast"), F.lit(a).alias("a"), F.lit(b).alias("b"), *side(a, "a"), *side(b, "b")) for k, (a, b) in enumerate(pairs)))
    return wide.select(*by, F.inline(plan)).where("n_a IS NOT NULL AND n_b IS NOT NULL")


def welch(pairs: DataFrame, alpha: float | None = None) -> DataFrame:
    """Welch's test of mean_a - mean_b from ``n_*, mean_*, var_*``.

    A zero standard error gives t 0, infinite df, p 1 and an interval of one point; a group of
    one has no variance, and everything that follows from it is null. With ``alpha`` the
    confidence limits are added.
    """
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    df = pairs.withColumn("difference", F.col("mean_a") - F.col("mean_b")).withColumn("standard_error", F.sqrt(va + vb))
    flat = F.col("standard_error") == 0
    freedom = (va + vb) * (va + vb) / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    df = df.withColumn("welch_df", F.when(flat, F.lit(float("inf"))).when(F.col("standard_error").isNotNull(), freedom))
    df = df.withColumn("t_stat", F.when(flat, F.lit(0.0)).otherwise(F.expr("try_divide(difference, standard_error)"))).withColumn("p_value", two_sided_p("t_stat", "welch_df"))
    if alpha is None:
        return df
    wide = F.when(flat, F.lit(0.0)).otherwise(critical_udf(alpha)("welch_df") * F.col("standard_error"))
    return df.withColumn("ci_low", F.col("difference") - wide).withColumn("ci_high", F.col("difference") + wide)


def holm(df: DataFrame, family: Iterable[str], p: str = "p_value", tie: Iterable[str] = ("contrast",), out: str = "p_holm") -> DataFrame:
    """Holm's step-down adjustment within each family of tests; null p-values stay null."""
    by = Window.partitionBy(*family)
    ranked = by.orderBy(F.col(p).asc_nulls_last(), *tie)
    stepped = (F.count(p).over(by) - F.row_number().over(ranked) + 1) * F.col(p)
    df = df.withColumn("_step", stepped)
    run = F.max("_step").over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), run))).drop("_step")


def draw(*parts: Column | str, modulo: Column) -> Column:
    """A counter-based draw: the first 32 bits of an md5 modulo ``modulo``."""
    key = F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % modulo


def bootstrap_means(rows: DataFrame, replicates: int, seed: int, strata: str = "arm", key: str = "unit_id") -> DataFrame:
    """``rep, strata, mean``: replicate means of ``y``, exactly as many draws with replacement in
    a stratum as it has rows. Null strata take no part. Draws do not depend on partitioning."""
    kept = rows.where(F.col(strata).isNotNull() & F.col("y").isNotNull())
    placed = kept.withColumn("rn", F.row_number().over(Window.partitionBy(strata).orderBy(key)) - 1).select(strata, "rn", "y")
    sizes = kept.groupBy(strata).agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= resampling.MOST_HELD:
        return resampling.drawn_means(placed, replicates, seed, strata)
    # Draw numbers follow from the rows themselves: every row is drawn for once a replicate.
    few = sizes.limit(MOST_STRATA + 1).count() <= MOST_STRATA
    asks = placed.join(F.broadcast(sizes) if few else sizes, strata).select(strata, F.col("rn").alias("k"), "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    picks = asks.select(strata, "rep", draw(F.lit(seed), F.col("rep"), F.col(strata), F.col("k"), modulo=F.col("n")).alias("rn"))
    return picks.join(placed, [strata, "rn"]).groupBy("rep", strata).agg(F.avg("y").alias("mean"))


def poisson_steps() -> list[int]:
    """Cumulative probabilities of Poisson(1), on the scale of the draw."""
    steps, term, total = [], 2.718281828459045**-1, 0.0
    for k in range(12):
        total += term
        steps.append(int(total * 2**32))
        term /= k + 1
    return steps


def poisson_weight(seed: int, key: str = "unit_id", rep: str = "rep") -> Column:
    """How often a unit is drawn in a replicate; the same wherever the row lies."""
    u = draw(F.lit(seed), F.col(rep), F.col(key), modulo=F.lit(2**32))
    return sum((F.when(u >= s, 1).otherwise(0) for s in poisson_steps()), F.lit(0))


def poisson_bootstrap_means(rows: DataFrame, replicates: int, seed: int, strata: str = "arm", key: str = "unit_id") -> DataFrame:
    """``rep, strata, mean`` with independent Poisson(1) weights: no rank and no join, so one pass
    with partial sums whatever the input; the way to resample beyond memory."""
    each = rows.where(F.col(strata).isNotNull() & F.col("y").isNotNull()).select(strata, key, "y", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).withColumn("w", poisson_weight(seed, key))
    return each.groupBy("rep", strata).agg(F.expr("try_divide(sum(w * y), sum(w))").alias("mean"))


def permuted(rows: DataFrame, replicates: int, seed: int, key: str = "unit_id") -> DataFrame:
    """``rep, arm, y``: arms reshuffled over units with their sizes kept; rep 0 is as observed."""
    sizes = sorted((r["arm"], r["n"]) for r in rows.groupBy("arm").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per arm
    each = rows.select(key, "y", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    order = Window.partitionBy("rep").orderBy(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("rep").cast("string"), F.col(key).cast("string"))), key)
    arm, stop = F.lit(sizes[-1][0] if sizes else None).cast(rows.schema["arm"].dataType), sum(n for _, n in sizes)
    for name, n in reversed(sizes):
        arm = F.when(F.col("rn") <= stop, name).otherwise(arm)
        stop -= n
    shuffled = each.withColumn("rn", F.row_number().over(order)).select("rep", arm.alias("arm"), "y")
    return rows.select(F.lit(0).alias("rep"), "arm", "y").union(shuffled)


def _dealt(rows: DataFrame, replicates: int, parts: int = 64) -> DataFrame:
    """Every row once a replicate, ``rep`` from 1, a replicate's rows all in one task.

    What is shuffled is a row per unit and part, not per unit and replicate.
    """
    parts = min(parts, replicates)
    each = rows.withColumn("_part", F.explode(F.sequence(F.lit(1), F.lit(parts)))).repartition(parts, "_part")
    return each.withColumn("rep", F.explode(F.sequence(F.col("_part"), F.lit(replicates), F.lit(parts)))).drop("_part")


def permuted_moments(rows: DataFrame, replicates: int, seed: int, key: str = "unit_id") -> DataFrame:
    """``rep, arm, n, mean, var``: what ``moments`` gives on ``permuted``, rep 0 as observed.

    Each task ranks all units for its own replicates, and the sums, a row per replicate and arm, are
    collected, so that tests may read them more than once. Units beyond what a worker may hold go another
    way: replicates are summed by the leading six bits of the hash that orders them. Only rows of those
    buckets that two arms share are ranked, so that many replicates need no sort of all units.
    """
    arms = sorted((r["arm"], r["n"], r["s"], r["k"]) for r in rows.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.count("y").alias("k")).collect())  # a row per arm
    centre = sum(x[2] or 0.0 for x in arms) / max(1, sum(x[3] for x in arms))
    bounds = [sum(x[1] for x in arms[: i + 1]) for i in range(len(arms))]
    arm_at = lambda rn: F.coalesce(*(F.when(rn <= b, x[0]) for b, x in zip(bounds, arms, strict=True)), F.lit(None)).cast(rows.schema["arm"].dataType)
    by_arm = lambda parts: parts.select("rep", "arm", "n", (F.lit(centre) + F.expr("try_divide(s, n)")).alias("mean"), F.expr("try_divide(greatest(q - s * s / n, 0.0D), n - 1)").alias("var"))
    observed = moments(rows.withColumn("rep", F.lit(0)), ["rep", "arm"]).drop("n_null")
    if bounds and bounds[-1] <= resampling.MOST_HELD:
        sums = resampling.shuffled_sums(rows, replicates, seed, key, bounds, centre)
        # A row per replicate and arm.
        known = rows.sparkSession.createDataFrame(sums.toArrow()).select("rep", F.element_at(F.array(*(F.lit(x[0]).cast(rows.schema["arm"].dataType) for x in arms)), F.col("at") + 1).alias("arm"), "n", "s", "q")
        return observed.union(by_arm(known))
    # Sums of values about the common mean, so that their squares keep their digits.
    each = _dealt(rows.select(key, (F.col("y") - F.lit(centre)).alias("y")), replicates)
    each = each.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("rep").cast("string"), F.col(key).cast("string"))))
    each = each.withColumn("_b", F.concat(F.substring("_h", 1, 1), F.translate(F.substring("_h", 2, 1), "0123456789abcdef", "000044448888cccc")))
    summed = (F.count("y").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    buckets = each.groupBy("rep", "_b").agg(F.count(F.lit(1)).alias("m"), *summed)
    buckets = buckets.withColumn("stop", F.sum("m").over(Window.partitionBy("rep").orderBy("_b"))).withColumn("start", F.col("stop") - F.col("m"))
    shared = sum((F.when((F.col("start") < b) & (F.col("stop") > b), 1).otherwise(0) for b in bounds), F.lit(0)) > 0
    whole = buckets.where(~shared).select("rep", arm_at(F.col("stop")).alias("arm"), "n", "s", "q")
    # At most a row per replicate and bound.
    cut = each.join(F.broadcast(buckets.where(shared).select("rep", "_b", "start")), ["rep", "_b"])
    ranked = cut.withColumn("rn", F.col("start") + F.row_number().over(Window.partitionBy("rep", "_b").orderBy("_h", key)))
    parts = whole.union(ranked.groupBy("rep", arm_at(F.col("rn")).alias("arm")).agg(*summed)).groupBy("rep", "arm").agg(*(F.sum(c).alias(c) for c in "nsq"))
    return observed.union(by_arm(parts))


def permutation_tests(rows: DataFrame, pairs, replicates: int, seed: int, key: str = "unit_id") -> DataFrame:
    """``a, b, p_perm, p_maxt``: randomisation p-values of the Welch statistics of planned pairs,
    each by itself and against the largest statistic of a replicate."""
    t = F.abs(F.expr("try_divide(mean_a - mean_b, sqrt(var_a / n_a + var_b / n_b))"))
    found = contrasts(permuted_moments(rows, replicates, seed, key), pairs, by=["rep"]).select("rep", "a", "b", t.alias("t"))
    # A row per replicate, with the statistics of all pairs; a row per pair observed.
    draws = found.where("rep > 0").withColumn("top", F.max("t").over(Window.partitionBy("rep")))
    seen = F.broadcast(found.where("rep = 0").select("a", "b", F.col("t").alias("t0")))
    p = lambda c: (1 + F.count_if(F.col(c) >= F.col("t0") - 1e-9)) / F.lit(replicates + 1.0)
    return draws.join(seen, ["a", "b"]).groupBy("a", "b").agg(p("t").alias("p_perm"), p("top").alias("p_maxt"))
