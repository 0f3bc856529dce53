"""Heterogeneous effects, cross-fitted learners, and policies.

Base learners are linear in one feature or in all, fitted from sums per fold and arm: the fit without
a fold comes from the other folds' sums, so cross-fitting is one pass. Boosted trees are there too.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstat.operators import resampling
from loomstat.operators.inference import draw, poisson_weight


def cells(units: DataFrame, feature: str, pair: tuple, y: str = "spend") -> DataFrame:
    """``feature, difference, standard_error`` of two arms within each value of a feature."""
    a, b = pair
    part = lambda f, arm: f(F.when(F.col("arm") == arm, F.col(y)))
    stats = units.groupBy(F.col(feature).alias("feature")).agg(*(part(f, arm).alias(f"{n}_{s}") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)) for s, arm in (("a", a), ("b", b))))
    return stats.select("feature", "n_a", "n_b", (F.col("m_a") - F.col("m_b")).alias("difference"), F.expr("sqrt(try_divide(v_a, n_a) + try_divide(v_b, n_b))").alias("standard_error"))


def cochran_q(cell_effects: DataFrame) -> DataFrame:
    """``k, pooled, q``: precision-weighted mean of the cells and their spread around it."""
    w = cell_effects.where("standard_error > 0").withColumn("w", 1 / (F.col("standard_error") * F.col("standard_error")))
    s = w.agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("difference")).alias("s1"), F.sum(F.col("w") * F.col("difference") * F.col("difference")).alias("s2"))
    return s.select("k", F.expr("try_divide(s1, s0)").alias("pooled"), F.expr("s2 - try_divide(s1 * s1, s0)").alias("q"))


def slopes(units: DataFrame, x: str, y: str = "spend") -> DataFrame:
    """Per arm the slope of y on x, its intercept and R squared."""
    return units.groupBy("arm").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def _sums(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    fx, fy = F.col(x), F.col(y)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(fx).alias("sx"), F.sum(fy).alias("sy"), F.sum(fx * fy).alias("sxy"), F.sum(fx * fx).alias("sxx"))


def cross_fit(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """``by, fold, slope, intercept`` of y on x, fitted on all folds but the named one."""
    # About the means of all rows, so that squares keep their digits.
    at_x, at_y = (v or 0.0 for v in rows.agg(F.avg(x), F.avg(y)).first())
    folds = _sums(rows.withColumns({x: F.col(x) - F.lit(at_x), y: F.col(y) - F.lit(at_y)}), [*by, "fold"], x, y)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rest = folds.select(*by, "fold", *((F.sum(c).over(group) - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx")))
    slope = F.expr("coalesce(try_divide(sxy - sx * sy / n, sxx - sx * sx / n), 0.0D)")
    return rest.where("n > 0").withColumn("slope", slope).select(*by, "fold", "slope", (F.lit(at_y) - F.col("slope") * F.lit(at_x) + (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"))


def t_learner(units: DataFrame, x: str = "history", y: str = "spend", folds: int = 5, seed: int = 20260902, arms: tuple = (0, 1, 2)) -> DataFrame:
    """Out-of-fold predictions: ``unit_id, arm, fold, x, y, mu_0, mu_1, ...``. A null x counts as 0."""
    rows = units.select("unit_id", "arm", F.coalesce(F.col(x), F.lit(0.0)).cast("double").alias("x"), F.col(y).cast("double").alias("y"), draw(F.lit(seed), "unit_id", modulo=F.lit(folds)).cast("int").alias("fold"))
    fits = cross_fit(rows, "x", "y", ["arm"])
    wide = fits.groupBy("fold").agg(*(F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{c}_{a}") for a in arms for c in ("slope", "intercept")))
    # A row per fold.
    return rows.join(F.broadcast(wide), "fold").select("unit_id", "arm", "fold", "x", "y", *((F.col(f"intercept_{a}") + F.col(f"slope_{a}") * F.col("x")).alias(f"mu_{a}") for a in arms))


def dr_scores(predictions: DataFrame, treated: int, control: int = 0, share: float = 1 / 3) -> DataFrame:
    """``unit_id, fold, x, phi``: doubly robust pseudo-outcomes under a known assignment share."""
    of = lambda a: F.when(F.col("arm") == a, (F.col("y") - F.col(f"mu_{a}")) / F.lit(share)).otherwise(0.0)
    return predictions.select("unit_id", "fold", "x", (F.col(f"mu_{treated}") - F.col(f"mu_{control}") + of(treated) - of(control)).alias("phi"))


def dr_learner(predictions: DataFrame, treated: tuple = (1, 2), control: int = 0, share: float = 1 / 3) -> DataFrame:
    """``unit_id, arm, fold, y, tau_1, tau_2, ...``: out-of-fold effects, linear in x, fitted on the
    doubly robust pseudo-outcomes of the other folds."""
    out = predictions.select("unit_id", "arm", "fold", "x", "y")
    for t in treated:
        fits = cross_fit(dr_scores(predictions, t, control, share), "x", "phi", []).select("fold", F.col("slope").alias(f"slope_{t}"), F.col("intercept").alias(f"intercept_{t}"))
        out = out.join(F.broadcast(fits), "fold")  # a row per fold
    return out.select("unit_id", "arm", "fold", "y", *((F.col(f"intercept_{t}") + F.col(f"slope_{t}") * F.col("x")).alias(f"tau_{t}") for t in treated))


def _design(units: DataFrame, numbers: tuple, categories: tuple, levels: dict | None = None) -> tuple[DataFrame, list[str], dict]:
    """``units`` with a column for each number (null: its mean) and each value of a category but the first."""
    if levels is None:
        found = units.agg(*(F.avg(c).alias(f"m_{c}") for c in numbers), *(F.stddev_samp(c).alias(f"s_{c}") for c in numbers), *(F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(f"v_{c}") for c in categories)).first()
        levels = {c: (found[f"m_{c}"] or 0.0, found[f"s_{c}"] or 1.0) for c in numbers} | {c: list(found[f"v_{c}"])[1:] for c in categories}
    made = {f"_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(levels[c][0])) - F.lit(levels[c][0])) / F.lit(levels[c][1]) for c in numbers}
    made |= {f"_{c}_{k}": F.coalesce(F.col(c).cast("string") == F.lit(v), F.lit(False)).cast("double") for c in categories for k, v in enumerate(levels[c])}
    return units.withColumns({"_one": F.lit(1.0)} | made), ["_one", *made], levels


NUMBERS, CATEGORIES = ("recency", "history", "newbie", "mens", "womens"), ("channel", "zip_code")


def t_learner_features(units: DataFrame, y: str = "spend", folds: int = 5, seed: int = 20260902, arms: tuple = (0, 1, 2), numbers: tuple = NUMBERS, categories: tuple = CATEGORIES, ridge: float = 1e-6) -> DataFrame:
    """``unit_id, arm, fold, y, mu_0, mu_1, ...``: out-of-fold predictions linear in all features.

    One pass adds up the cross products by arm and fold, whose number the features bound; the driver
    solves a small system for each, with a slight ridge. Null numbers count as the mean, null
    categories as the first value. Units with a null outcome are predicted, not learnt from.
    """
    rows = units.select("unit_id", "arm", *numbers, *categories, F.col(y).cast("double").alias("y"), draw(F.lit(seed), "unit_id", modulo=F.lit(folds)).cast("int").alias("fold"))
    made, names, _ = _design(rows, numbers, categories)
    n = len(names)
    products = [F.sum(F.col(names[i]) * F.col(names[j])) for i in range(n) for j in range(i, n)] + [F.sum(F.col(c) * F.col("y")) for c in names]
    sums = {(r["arm"], r["fold"]): np.array(r["s"], float) for r in made.where("y IS NOT NULL").groupBy("arm", "fold").agg(F.array(*products).alias("s")).collect()}  # arms * folds rows
    upper, weights = np.triu_indices(n), {}
    for arm in arms:
        for fold in range(folds):
            rest = sum((s for (a, f), s in sums.items() if a == arm and f != fold), np.zeros(len(upper[0]) + n))
            gram = np.zeros((n, n))
            gram[upper] = rest[: len(upper[0])]
            gram = gram + np.triu(gram, 1).T
            weights[arm, fold] = np.linalg.solve(gram + ridge * max(1.0, gram[0, 0]) * np.eye(n), rest[len(upper[0]) :])
    one = lambda arm, fold: sum((F.col(c) * F.lit(float(w)) for c, w in zip(names, weights[arm, fold], strict=True)), F.lit(0.0))
    mu = [F.coalesce(*(F.when(F.col("fold") == f, one(a, f)) for f in range(folds))).alias(f"mu_{a}") for a in arms]
    return made.select("unit_id", "arm", "fold", "y", *mu)


def boosted_learner(units: DataFrame, iterations: int = 150, y: str = "spend", folds: int = 5, seed: int = 20260902, arms: tuple = (0, 1, 2), numbers: tuple = NUMBERS, categories: tuple = CATEGORIES) -> DataFrame:
    """``unit_id, arm, fold, y, mu_0, mu_1, ...``: out-of-fold predictions of boosted trees, ``iterations``
    of them for each arm and fold. An arm without units outside a fold predicts its mean, 0 without any."""
    rows = units.select("unit_id", "arm", *numbers, *categories, F.col(y).cast("double").alias("y"), draw(F.lit(seed), "unit_id", modulo=F.lit(folds)).cast("int").alias("fold"))
    made, names, _ = _design(rows, numbers, categories)
    made = VectorAssembler(inputCols=names[1:], outputCol="features").transform(made).select("unit_id", "arm", "fold", "y", "features").persist()
    parts = []
    for fold in range(folds):
        part = made.where(F.col("fold") == fold)
        for arm in arms:
            known = made.where((F.col("fold") != fold) & (F.col("arm") == arm) & F.col("y").isNotNull())
            if known.isEmpty():
                part = part.withColumn(f"mu_{arm}", F.lit(0.0))
            else:
                model = GBTRegressor(featuresCol="features", labelCol="y", predictionCol=f"mu_{arm}", maxIter=iterations, maxDepth=3, stepSize=0.1, seed=seed).fit(known)
                part = model.transform(part)
        parts.append(part.select("unit_id", "arm", "fold", "y", *(f"mu_{a}" for a in arms)))
    return reduce(DataFrame.union, parts)


def _edges(rows: DataFrame, bins: int) -> list[float]:
    """Values of ``score`` at the ranks ceil(k * n / bins), exact whatever the number of rows.

    Approximate quantiles only part the rows: those of a part are counted, and within the parts that
    hold a wanted rank, narrow ones around it, distinct values are ranked. ``rows`` must be fixed.
    """
    around = sorted({min(1.0, max(0.0, k / bins + d)) for k in range(1, bins) for d in (-0.001, 0.001)})
    cuts = sorted(set(rows.agg(F.percentile_approx("score", around, 10_000)).first()[0] or []))
    part = sum((F.when(F.col("score") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    known = rows.where("score IS NOT NULL").select(part.alias("part"), "score")
    sizes = {r["part"]: r["n"] for r in known.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per part
    n, before, wanted = sum(sizes.values()), 0, []
    for p in sorted(sizes):
        wanted += [(k, p, rank - before) for k in range(1, bins) if before < (rank := -(-k * n // bins)) <= before + sizes[p]]
        before += sizes[p]
    if not wanted:
        return []
    run = Window.partitionBy("part").orderBy("score")
    values = known.where(F.col("part").isin(sorted({p for _, p, _ in wanted}))).groupBy("part", "score").agg(F.count(F.lit(1)).alias("n")).withColumn("stop", F.sum("n").over(run))
    at = lambda p, rank: F.min(F.when((F.col("part") == p) & (F.col("stop") >= rank), F.col("score")))
    return list(values.agg(*(at(p, rank).alias(f"e_{k}") for k, p, rank in wanted)).first())


def _binned(predictions: DataFrame, treated: int, control: int, bins: int) -> DataFrame:
    """``unit_id, arm, y, bin`` by falling predicted uplift.

    Bin edges are the scores of exact ranks, found without a sort of all units in one task. Scores are kept
    while that is done: computed anew they could differ in their last digits, and ties part at an edge.
    """
    rows = predictions.where(F.col("arm").isin(treated, control)).select("unit_id", "arm", "y", (F.col(f"mu_{treated}") - F.col(f"mu_{control}")).alias("score")).localCheckpoint()
    at = sum((F.when(F.col("score") <= e, 1).otherwise(0) for e in _edges(rows, bins)), F.lit(0))
    return rows.select("unit_id", "arm", "y", at.alias("bin"))


def uplift_bins(predictions: DataFrame, treated: int = 1, control: int = 0, bins: int = 10) -> DataFrame:
    """``bin, n_t, n_c, uplift, qini`` by falling predicted uplift; qini accumulates over bins."""
    part = lambda f, arm: f(F.when(F.col("arm") == arm, F.col("y")))
    by = _binned(predictions, treated, control, bins).groupBy("bin").agg(part(F.count, treated).alias("n_t"), part(F.count, control).alias("n_c"), part(F.sum, treated).alias("s_t"), part(F.sum, control).alias("s_c"))
    run = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row per bin
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(run)
    qini = total("s_t") - total("s_c") * F.expr("1.0D") * F.sum("n_t").over(run) / F.greatest(F.sum("n_c").over(run), F.lit(1))
    return by.select("bin", "n_t", "n_c", F.expr("try_divide(s_t, n_t) - try_divide(s_c, n_c)").alias("uplift"), qini.alias("qini"))


def uplift_areas(bins: DataFrame) -> DataFrame:
    """``n_bins, auuc, qini``: from uplift_bins, the area under the cumulative gain per treated unit, as a
    trapezoid sum over the shares of units seen, and that area less the one of a random order."""
    rows = bins.select("bin", "qini", (F.col("n_t") + F.col("n_c")).alias("n"))
    run = Window.partitionBy(F.lit(0)).orderBy("bin")  # a row per bin
    whole = Window.partitionBy(F.lit(0))
    steps = rows.withColumns({"width": F.col("n") / F.sum("n").over(whole), "before": F.coalesce(F.lag("qini").over(run), F.lit(0.0)), "last": F.last("qini").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    area = F.sum(F.col("width") * (F.col("before") + F.col("qini")) / 2)
    return steps.agg(F.count(F.lit(1)).alias("n_bins"), area.alias("auuc"), (area - F.max("last") / 2).alias("qini"))


def _limits(column: str, low: str, high: str, alpha: float) -> list:
    return [F.expr(f"percentile({column}, {q})").alias(name) for q, name in ((alpha / 2, low), (1 - alpha / 2, high))]


def _replicated(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Every row once a replicate, ``rep``, with its Poisson weight ``w``; no join, no shuffle."""
    each = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return each.withColumn("w", poisson_weight(seed)).where("w > 0")


def uplift_bin_intervals(predictions: DataFrame, replicates: int = 2000, seed: int = 20260902, treated: int = 1, control: int = 0, bins: int = 10, alpha: float = 0.05) -> DataFrame:
    """``bin, ci_low, ci_high`` of the uplift within each bin, bins held fixed.

    Percentiles over Poisson bootstrap replicates; a replicate in which a bin lacks an arm does
    not count for that bin. Null outcomes take no part.
    """
    drawn = _replicated(_binned(predictions, treated, control, bins).where("y IS NOT NULL"), replicates, seed)
    mean = lambda arm: F.try_divide(F.sum(F.when(F.col("arm") == arm, F.col("w") * F.col("y"))), F.sum(F.when(F.col("arm") == arm, F.col("w"))))
    values = drawn.groupBy("bin", "rep").agg((mean(treated) - mean(control)).alias("uplift"))
    return values.groupBy("bin").agg(*_limits("uplift", "ci_low", "ci_high", alpha))


def _best(arms: tuple):
    """The first of the arms with the largest prediction."""
    top = F.greatest(*(F.col(f"mu_{a}") for a in arms))
    return F.coalesce(*(F.when(F.col(f"mu_{a}") == top, a) for a in arms))


def _value(pick, arms: tuple, share: float) -> tuple:
    """Inverse-probability and doubly robust values of giving a unit the arm ``pick``."""
    mu = F.coalesce(*(F.when(pick == a, F.col(f"mu_{a}")) for a in arms))
    hit = F.when(F.col("arm") == pick, 1.0).otherwise(0.0) / F.lit(share)
    return hit * F.col("y"), mu + hit * (F.col("y") - mu)


def policy_values(predictions: DataFrame, arms: tuple = (0, 1, 2), share: float = 1 / 3) -> DataFrame:
    """``policy, ipw, dr, send_rate`` of sending one arm to all and of each unit's best arm."""
    named = F.array(*(F.struct(F.lit(f"all_{a}").alias("policy"), F.lit(a).alias("pick")) for a in arms), F.struct(F.lit("best").alias("policy"), _best(arms).alias("pick")))
    rows = predictions.select("arm", "y", *(f"mu_{a}" for a in arms), F.inline(named))
    ipw, dr = _value(F.col("pick"), arms, share)
    return rows.groupBy("policy").agg(F.avg(ipw).alias("ipw"), F.avg(dr).alias("dr"), F.avg(F.when(F.col("pick") != arms[0], 1.0).otherwise(0.0)).alias("send_rate"))


def policy_intervals(predictions: DataFrame, replicates: int = 2000, seed: int = 20260902, arms: tuple = (0, 1, 2), share: float = 1 / 3, alpha: float = 0.05) -> DataFrame:
    """``policy, ci_low, ci_high, lead_low, lead_high``: limits of a policy's doubly robust value,
    and of what the best-arm policy is worth beyond it, paired within replicates.

    Predictions are held fixed; percentiles over Poisson bootstrap replicates. A unit whose value
    is null under any policy takes no part. All policies are summed in one pass over units, dealt
    over all cores, and what is shuffled is a row per replicate and task.
    """
    picks = {f"all_{a}": F.lit(a) for a in arms} | {"best": _best(arms)}
    valued = predictions.select("unit_id", *(_value(pick, arms, share)[1].alias(name) for name, pick in picks.items())).na.drop(subset=list(picks))
    means = resampling.weighted_sums(valued, list(picks), replicates, seed, "unit_id").select("rep", *((F.col(name) / F.col("w")).alias(name) for name in picks))
    each = means.select(F.inline(F.array(*(F.struct(F.lit(name).alias("policy"), F.col(name).alias("value"), (F.col("best") - F.col(name)).alias("lead")) for name in picks))))
    return each.groupBy("policy").agg(*_limits("value", "ci_low", "ci_high", alpha), *_limits("lead", "lead_low", "lead_high", alpha))


def cost_grid(values: DataFrame, costs: list[float]) -> DataFrame:
    """``policy, cost, net``: value less a scenario cost per contact, not a real cost."""
    return values.select("policy", F.explode(F.array(*map(F.lit, costs))).alias("cost"), "dr", "send_rate").withColumn("net", F.col("dr") - F.col("cost") * F.col("send_rate"))


def break_even(values: DataFrame, base: str = "all_0") -> DataFrame:
    """``policy, gain, break_even``: what a policy is worth beyond ``base``, and the cost per contact at
    which that is used up; null for a policy that contacts nobody."""
    at = F.max(F.when(F.col("policy") == base, F.col("dr"))).over(Window.partitionBy(F.lit(0)))  # a row per policy
    gain = values.withColumn("gain", F.col("dr") - at)
    return gain.select("policy", "gain", F.expr("try_divide(gain, nullif(send_rate, 0.0D))").alias("break_even"))
