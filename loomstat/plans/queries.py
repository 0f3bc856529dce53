"""Registered queries over the driver's tables, and DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.functions.student import STEPS, format_p
from loomstat.operators import audit, density, eligibility, hetero, inference, market, segments, uplift
from loomstat.sources import files
from loomstat.sources.frames import CONTRASTS, OUTCOMES, UNITS_SQL, corpus, products, read, reviews, units

SEED = 20260902
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def _rounded(df, places: int = 6, **other: int):
    """Floating columns rounded, so that the order of summation does not show."""
    return df.select(*(F.round(c, other.get(c, places)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _sql_integral(start: str, df: str) -> str:
    end = f"least(pi() / 2, ({start}) + 12 / sqrt({df}))"
    step = f"(({end} - ({start})) / {STEPS})"
    return f"{step} / 3 * list_sum(list_transform(range(0, {STEPS + 1}), lambda i: (CASE WHEN i = 0 OR i = {STEPS} THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END) * pow(greatest(cos(({start}) + i * {step}), 0.0::DOUBLE), {df} - 1)))"


_P = f"({_sql_integral('atan(abs(t_stat) / sqrt(welch_df))', 'welch_df')}) / ({_sql_integral('0.0::DOUBLE', 'welch_df')})"
_PAIRS = "(VALUES (0, 1, 0), (1, 2, 0), (2, 1, 2)) AS c(contrast, a, b)"
_LONG = "SELECT arm, 'spend' AS outcome, spend::DOUBLE AS y FROM units UNION ALL SELECT arm, 'visit', visit::DOUBLE FROM units UNION ALL SELECT arm, 'conversion', conversion::DOUBLE FROM units"
_WELCH = f"""
WITH {UNITS_SQL}, long AS ({_LONG}),
s AS (SELECT outcome, arm, count(y) AS n, avg(y) AS mean, var_samp(y) AS var FROM long GROUP BY ALL),
w AS (
  SELECT x.outcome, contrast, a, b, x.n AS n_a, z.n AS n_b, x.mean AS mean_a, z.mean AS mean_b, x.mean - z.mean AS difference,
    sqrt(x.var / x.n + z.var / z.n) AS standard_error,
    pow(x.var / x.n + z.var / z.n, 2) / (pow(x.var / x.n, 2) / (x.n - 1) + pow(z.var / z.n, 2) / (z.n - 1)) AS welch_df
  FROM {_PAIRS} JOIN s x ON x.arm = a JOIN s z ON z.arm = b AND z.outcome = x.outcome
), t AS (SELECT *, difference / standard_error AS t_stat FROM w), p AS (SELECT *, {_P} AS p_value FROM t)"""


def _welch(spark, sf_dir, outcomes=OUTCOMES):
    stats = inference.moments(inference.long_outcomes(units(spark, sf_dir), outcomes), ["outcome", "arm"])
    return inference.welch(inference.contrasts(stats, CONTRASTS))


_WELCH_COLUMNS = ("outcome", "a", "b", "n_a", "n_b", "mean_a", "mean_b", "difference", "standard_error", "welch_df", "t_stat", "p_value")
_WELCH_SELECT = "SELECT outcome, a, b, n_a, n_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(difference, 4) AS difference, round(standard_error, 4) AS standard_error, round(welch_df, 4) AS welch_df, round(t_stat, 6) AS t_stat, round(p_value, 6) AS p_value FROM p"


@_query(_WELCH + _WELCH_SELECT + " WHERE outcome = 'spend'")
def abn_welch_spend(spark, sf_dir):
    return _rounded(_welch(spark, sf_dir, ("spend",)).select(*_WELCH_COLUMNS), 4, t_stat=6, p_value=6)


@_query(_WELCH + _WELCH_SELECT)
def abn_welch_all_outcomes(spark, sf_dir):
    return _rounded(_welch(spark, sf_dir).select(*_WELCH_COLUMNS), 4, t_stat=6, p_value=6)


@_query(_WELCH + """, h AS (
  SELECT *, (count(*) OVER (PARTITION BY outcome) - row_number() OVER (PARTITION BY outcome ORDER BY p_value, contrast) + 1) * p_value AS step,
    row_number() OVER (PARTITION BY outcome ORDER BY p_value, contrast) AS i FROM p)
SELECT outcome, a, b, round(p_value, 6) AS p_value, round(least(1.0::DOUBLE, max(step) OVER (PARTITION BY outcome ORDER BY i)), 6) AS p_holm FROM h""")
def abn_holm(spark, sf_dir):
    return _rounded(inference.holm(_welch(spark, sf_dir), ["outcome"]).select("outcome", "a", "b", "p_value", "p_holm"))


#: The critical value by bisection, 40 halvings of (1, 16).
_CRITICAL = _P.replace("atan(abs(t_stat) / sqrt(welch_df))", "atan((lo + hi) / 2 / sqrt(welch_df))")


@_query(_WELCH.replace("WITH ", "WITH RECURSIVE ", 1) + f""", k AS (SELECT outcome, contrast, welch_df, 1.0::DOUBLE AS lo, 16.0::DOUBLE AS hi, 0 AS i FROM t
  UNION ALL SELECT outcome, contrast, welch_df, CASE WHEN tail > 0.05 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN tail > 0.05 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM (SELECT *, {_CRITICAL} AS tail FROM k WHERE i < 40))
SELECT p.outcome, a, b, round(difference, 4) AS difference, round(difference - (lo + hi) / 2 * standard_error, 4) AS ci_low, round(difference + (lo + hi) / 2 * standard_error, 4) AS ci_high,
  CASE WHEN p_value < 0.001 THEN 'p < 0.001' ELSE printf('p = %.4f', p_value) END AS p_text FROM p JOIN k ON k.outcome = p.outcome AND k.contrast = p.contrast AND i = 40""")
def abn_confidence(spark, sf_dir):
    stats = inference.moments(inference.long_outcomes(units(spark, sf_dir), OUTCOMES), ["outcome", "arm"])
    found = inference.welch(inference.contrasts(stats, CONTRASTS), alpha=0.05)
    return _rounded(found.select("outcome", "a", "b", "difference", "ci_low", "ci_high", format_p(F.col("p_value")).alias("p_text")), 4)


@_query(f"WITH {UNITS_SQL} SELECT c.column AS column, CAST(c.n AS BIGINT) AS n_missing, (SELECT count(*) FROM units) AS n_rows FROM (SELECT 'recency' AS column, count(*) FILTER (recency IS NULL) AS n FROM units UNION ALL SELECT 'history', count(*) FILTER (history IS NULL) FROM units UNION ALL SELECT 'channel', count(*) FILTER (channel IS NULL) FROM units) c")
def audit_missing(spark, sf_dir):
    return audit.missing(units(spark, sf_dir), ("recency", "history", "channel"))


@_query(f"""WITH {UNITS_SQL}, u AS (SELECT CAST(('0x' || substr(md5('7|' || unit_id), 1, 8))::BIGINT % 10 AS INTEGER) AS d FROM units),
c AS (SELECT count(*) FILTER (d < 4) AS n_0, count(*) FILTER (d >= 4 AND d < 7) AS n_1, count(*) FILTER (d >= 7) AS n_2, count(*) / 3.0::DOUBLE AS e FROM u)
SELECT n_0, n_1, n_2, round(pow(n_0 - e, 2) / e + pow(n_1 - e, 2) / e + pow(n_2 - e, 2) / e, 6) AS chi2, round(exp(-(pow(n_0 - e, 2) / e + pow(n_1 - e, 2) / e + pow(n_2 - e, 2) / e) / 2), 6) AS p_value FROM c""")
def audit_arm_ratio(spark, sf_dir):
    d = inference.draw(F.lit(7), "unit_id", modulo=F.lit(10))
    assigned = units(spark, sf_dir).withColumn("arm", F.when(d < 4, 0).when(d < 7, 1).otherwise(2))
    return _rounded(audit.arm_ratio(assigned, {0: 1 / 3, 1: 1 / 3, 2: 1 / 3}))


@_query(f"WITH {UNITS_SQL} SELECT f.feature AS feature, round((ma - mb) / sqrt((va + vb) / 2), 6) AS smd FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS feature, avg({x}) FILTER (arm = 1) AS ma, avg({x}) FILTER (arm = 0) AS mb, var_samp({x}) FILTER (arm = 1) AS va, var_samp({x}) FILTER (arm = 0) AS vb FROM units" for x in ("recency", "history", "newbie", "mens", "womens")) + ") f")
def audit_balance_smd(spark, sf_dir):
    return _rounded(audit.balance(units(spark, sf_dir), ("recency", "history", "newbie", "mens", "womens"), (1, 0)))


@_query(f"""WITH {UNITS_SQL}, r AS (SELECT arm, unnest([{{'feature': 'channel', 'value': coalesce(channel, '(missing)')}}, {{'feature': 'zip_code', 'value': coalesce(zip_code, '(missing)')}}], recursive := true) FROM units WHERE arm IN (0, 1)),
n AS (SELECT feature, value, count(*) FILTER (arm = 1) AS na, count(*) FILTER (arm = 0) AS nb FROM r GROUP BY ALL), h AS (SELECT feature, value, na / sum(na) OVER (PARTITION BY feature) AS pa, nb / sum(nb) OVER (PARTITION BY feature) AS pb FROM n)
SELECT feature, value, round(pa, 6) AS share_a, round(pb, 6) AS share_b, round((pa - pb) / sqrt((pa * (1 - pa) + pb * (1 - pb)) / 2), 6) AS smd FROM h""")
def audit_balance_categories(spark, sf_dir):
    return _rounded(audit.category_balance(units(spark, sf_dir), ("channel", "zip_code"), (1, 0)))


@_query(f"WITH {UNITS_SQL} SELECT count(*) FILTER (conversion = 1 AND visit = 0) AS converted_unvisited, count(*) FILTER (spend > 0 AND conversion = 0) AS spent_unconverted, count(*) FILTER (spend < 0) AS negative_spend FROM units")
def audit_outcome_logic(spark, sf_dir):
    return audit.outcome_logic(units(spark, sf_dir))


@_query("SELECT count(*) AS n_groups, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_extra FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def audit_duplicates(spark, sf_dir):
    return audit.duplicates(read(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))


@_query(f"WITH {UNITS_SQL} SELECT 'visit' AS column, count(*) FILTER (visit NOT IN (0, 1)) AS n_bad, count(*) FILTER (visit IS NULL) AS n_null FROM units UNION ALL SELECT 'newbie', count(*) FILTER (newbie NOT IN (0, 1)), count(*) FILTER (newbie IS NULL) FROM units UNION ALL SELECT 'recency', count(*) FILTER (recency NOT IN (0, 1)), count(*) FILTER (recency IS NULL) FROM units")
def validate_binary_counts(spark, sf_dir):
    return audit.binary_violations(units(spark, sf_dir), ("visit", "newbie", "recency"))


_DRAW = "(('0x' || substr(md5({}), 1, 8))::BIGINT)"
#: Replicates that the SQL repeats, and those of the analysis without SQL: means and permutations, policies.
_REPS = 20
REPLICATIONS, POLICY_REPLICATIONS = 10_000, 2_000
_BOOT = f"""WITH {UNITS_SQL}, p AS (SELECT arm, row_number() OVER (PARTITION BY arm ORDER BY unit_id) - 1 AS rn, spend, count(*) OVER (PARTITION BY arm) AS n FROM units),
d AS (SELECT rep, arm, {_DRAW.format(f"'{SEED}|' || rep || '|' || arm || '|' || rn")} % n AS pick FROM p, range(0, {_REPS}) r(rep)),
m AS (SELECT d.rep, d.arm, avg(p.spend) AS mean FROM d JOIN p ON p.arm = d.arm AND p.rn = d.pick GROUP BY ALL)"""


def _boot(spark, sf_dir, replicates=_REPS):
    return inference.bootstrap_means(units(spark, sf_dir).select("unit_id", "arm", F.col("spend").alias("y")), replicates, SEED)


def _boot_ci(spark, sf_dir, replicates=_REPS):
    means = _boot(spark, sf_dir, replicates).withColumns({"n": F.lit(1), "var": F.lit(0.0)})
    pairs = inference.contrasts(means, CONTRASTS, by=["rep"]).withColumn("d", F.col("mean_a") - F.col("mean_b"))
    return _rounded(pairs.groupBy("a", "b").agg(F.expr("percentile(d, 0.025)").alias("ci_low"), F.expr("percentile(d, 0.975)").alias("ci_high"), F.stddev_samp("d").alias("se")), 4)


@_query(_BOOT + " SELECT CAST(rep AS INTEGER) AS rep, arm, round(mean, 4) AS mean FROM m")
def bootstrap_arm_mean(spark, sf_dir):
    return _rounded(_boot(spark, sf_dir), 4)


@_query(_BOOT + f" SELECT a, b, round(quantile_cont(x.mean - z.mean, 0.025), 4) AS ci_low, round(quantile_cont(x.mean - z.mean, 0.975), 4) AS ci_high, round(stddev_samp(x.mean - z.mean), 4) AS se FROM {_PAIRS} JOIN m x ON x.arm = a JOIN m z ON z.arm = b AND z.rep = x.rep GROUP BY ALL")
def bootstrap_contrast_ci(spark, sf_dir):
    return _boot_ci(spark, sf_dir)


@_query()
def bootstrap_arm_mean_full(spark, sf_dir):
    return _rounded(_boot(spark, sf_dir, REPLICATIONS), 4)


@_query()
def bootstrap_contrast_ci_full(spark, sf_dir):
    return _boot_ci(spark, sf_dir, REPLICATIONS)


_WEIGHT = " + ".join(f"CAST(u >= {s} AS INTEGER)" for s in inference.poisson_steps())
_DRAWN = f"u AS (SELECT unit_id, rep, {_DRAW.format(f"'{SEED}|' || rep || '|' || unit_id")} AS u FROM units, range(0, 200) r(rep))"


@_query(f"WITH {UNITS_SQL}, {_DRAWN}, m AS (SELECT rep, arm, sum(({_WEIGHT}) * spend) / sum({_WEIGHT}) AS mean FROM units JOIN u USING (unit_id) GROUP BY ALL) SELECT arm, round(avg(mean), 4) AS mean, round(stddev_samp(mean), 4) AS se FROM m GROUP BY arm")
def poisson_bootstrap(spark, sf_dir):
    means = inference.poisson_bootstrap_means(units(spark, sf_dir).select("unit_id", "arm", F.col("spend").alias("y")), 200, SEED)
    return _rounded(means.groupBy("arm").agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("se")), 4)


_PERM = f"""WITH {UNITS_SQL}, e AS (SELECT rep, spend, row_number() OVER (PARTITION BY rep ORDER BY md5('{SEED}|' || rep || '|' || unit_id), unit_id) AS rn FROM units, range(1, {_REPS + 1}) r(rep)),
k AS (SELECT count(*) FILTER (arm = 0) AS n0, count(*) FILTER (arm <= 1) AS n1 FROM units),
r AS (SELECT 0 AS rep, arm, spend FROM units UNION ALL SELECT rep, CASE WHEN rn <= n0 THEN 0 WHEN rn <= n1 THEN 1 ELSE 2 END, spend FROM e, k),
s AS (SELECT rep, arm, count(*) AS n, avg(spend) AS mean, var_samp(spend) AS var FROM r GROUP BY ALL),
t AS (SELECT x.rep, contrast, a, b, abs((x.mean - z.mean) / sqrt(x.var / x.n + z.var / z.n)) AS t FROM {_PAIRS} JOIN s x ON x.arm = a JOIN s z ON z.arm = b AND z.rep = x.rep),
o AS (SELECT * FROM t WHERE rep = 0)"""


def _perm(spark, sf_dir):
    rows = inference.permuted(units(spark, sf_dir).select("unit_id", "arm", F.col("spend").alias("y")), _REPS, SEED)
    pairs = inference.contrasts(inference.moments(rows, ["rep", "arm"]), CONTRASTS, by=["rep"])
    t = F.abs(F.expr("try_divide(mean_a - mean_b, sqrt(var_a / n_a + var_b / n_b))"))
    found = pairs.select("rep", "a", "b", t.alias("t"))
    return found.where("rep > 0"), found.where("rep = 0").select("a", "b", F.col("t").alias("t0"))


@_query(_PERM + f" SELECT o.a, o.b, round((1 + count(*) FILTER (t.t >= o.t - 1e-9)) / {_REPS + 1}::DOUBLE, 6) AS p_perm FROM o JOIN t ON t.contrast = o.contrast AND t.rep > 0 GROUP BY o.a, o.b")
def permutation_p(spark, sf_dir):
    draws, seen = _perm(spark, sf_dir)
    return _rounded(draws.join(seen, ["a", "b"]).groupBy("a", "b").agg(((1 + F.count_if(F.col("t") >= F.col("t0") - 1e-9)) / F.lit(_REPS + 1.0)).alias("p_perm")))


@_query(_PERM + f", x AS (SELECT rep, max(t) AS top FROM t WHERE rep > 0 GROUP BY rep) SELECT o.a, o.b, round((1 + (SELECT count(*) FROM x WHERE top >= o.t - 1e-9)) / {_REPS + 1}::DOUBLE, 6) AS p_maxt FROM o")
def maxt_adjusted(spark, sf_dir):
    draws, seen = _perm(spark, sf_dir)
    tops = draws.groupBy("rep").agg(F.max("t").alias("top"))
    each = tops.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CONTRASTS))).alias("c"), "top").select("c.a", "c.b", "top")
    return _rounded(each.join(seen, ["a", "b"]).groupBy("a", "b").agg(((1 + F.count_if(F.col("top") >= F.col("t0") - 1e-9)) / F.lit(_REPS + 1.0)).alias("p_maxt")))


def _perm_full(spark, sf_dir):
    return _rounded(inference.permutation_tests(units(spark, sf_dir).select("unit_id", "arm", F.col("spend").alias("y")), CONTRASTS, REPLICATIONS, SEED))


@_query()
def permutation_p_full(spark, sf_dir):
    return _perm_full(spark, sf_dir).drop("p_maxt")


@_query()
def maxt_adjusted_full(spark, sf_dir):
    return _perm_full(spark, sf_dir).drop("p_perm")


_CELLS = f"""WITH {UNITS_SQL}, c AS (SELECT channel AS feature, count(*) FILTER (arm = 1) AS n_a, count(*) FILTER (arm = 0) AS n_b, avg(spend) FILTER (arm = 1) - avg(spend) FILTER (arm = 0) AS difference,
sqrt(var_samp(spend) FILTER (arm = 1) / count(*) FILTER (arm = 1) + var_samp(spend) FILTER (arm = 0) / count(*) FILTER (arm = 0)) AS standard_error FROM units GROUP BY channel)"""


@_query(_CELLS + " SELECT feature, n_a, n_b, round(difference, 4) AS difference, round(standard_error, 4) AS standard_error FROM c")
def hte_categorical_cells(spark, sf_dir):
    return _rounded(uplift.cells(units(spark, sf_dir), "channel", (1, 0)), 4)


@_query(_CELLS + ", w AS (SELECT *, 1 / pow(standard_error, 2) AS w FROM c) SELECT count(*) AS k, round(sum(w * difference) / sum(w), 4) AS pooled, round(sum(w * difference * difference) - pow(sum(w * difference), 2) / sum(w), 6) AS q FROM w")
def hte_cochran_q(spark, sf_dir):
    return _rounded(uplift.cochran_q(uplift.cells(units(spark, sf_dir), "channel", (1, 0))), 6, pooled=4)


@_query(f"WITH {UNITS_SQL} SELECT arm, round(regr_slope(spend, history), 6) AS slope, round(regr_intercept(spend, history), 3) AS intercept, round(regr_r2(spend, history), 6) AS r2 FROM units GROUP BY arm")
def hte_continuous_slope(spark, sf_dir):
    return _rounded(uplift.slopes(units(spark, sf_dir), "history"), 6, intercept=3)


_HTE = f"""WITH {UNITS_SQL}, long AS (SELECT unit_id, arm, outcome, y FROM (SELECT unit_id, arm, 'spend' AS outcome, spend::DOUBLE AS y FROM units UNION ALL SELECT unit_id, arm, 'visit', visit::DOUBLE FROM units UNION ALL SELECT unit_id, arm, 'conversion', conversion::DOUBLE FROM units)),
fv AS (SELECT unit_id, unnest([{', '.join(f"{{'feature': '{f}', 'value': coalesce(CAST({f} AS VARCHAR), '(missing)')}}" for f in hetero.CATEGORIES)}], recursive := true) FROM units),
s AS (SELECT feature, value, outcome, arm, count(y) AS n, avg(y) AS mean, var_samp(y) AS var FROM fv JOIN long USING (unit_id) GROUP BY ALL),
cell AS (SELECT x.feature, x.value, x.outcome, contrast, a, b, x.n AS n_a, z.n AS n_b, x.mean - z.mean AS difference, sqrt(x.var / x.n + z.var / z.n) AS standard_error FROM {_PAIRS} JOIN s x ON x.arm = a JOIN s z ON z.arm = b AND z.outcome = x.outcome AND z.feature = x.feature AND z.value = x.value),
nx AS (SELECT unit_id, unnest([{', '.join(f"{{'feature': '{f}', 'x': CAST({f} AS DOUBLE) - (SELECT avg({f}) FROM units)}}" for f in hetero.NUMBERS)}], recursive := true) FROM units),
fit AS (SELECT feature, outcome, arm, count(*) AS n, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM nx JOIN long USING (unit_id) WHERE x IS NOT NULL GROUP BY ALL),
sl AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) / sxx AS v FROM fit)"""


@_query(_HTE + " SELECT feature, value, outcome, a, b, n_a, n_b, round(difference, 4) AS difference, round(standard_error, 4) AS standard_error FROM cell")
def hte_cells_all(spark, sf_dir):
    found = hetero.cells(units(spark, sf_dir), hetero.CATEGORIES, OUTCOMES, CONTRASTS)
    return _rounded(found.select("feature", "value", "outcome", "a", "b", "n_a", "n_b", "difference", "standard_error"), 4)


@_query(_HTE + """, ax AS (SELECT unit_id, unnest([{'feature': 'recency', 'x': recency::DOUBLE}, {'feature': 'history', 'x': history::DOUBLE}], recursive := true) FROM units),
sa AS (SELECT feature, outcome, arm, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM ax JOIN long USING (unit_id) GROUP BY ALL)
SELECT feature, outcome, arm, CASE WHEN abs(slope) < 5e-7 THEN 0 ELSE round(slope, 6) END AS slope, round(intercept, 3) AS intercept, round(r2, 6) AS r2 FROM sa""")
def hte_slopes_all(spark, sf_dir):
    rows = inference.long_outcomes(units(spark, sf_dir), OUTCOMES, ("arm", "recency", "history"))
    rows = rows.select("arm", "outcome", "y", F.expr("stack(2, 'recency', CAST(recency AS DOUBLE), 'history', CAST(history AS DOUBLE)) AS (feature, x)"))
    return _rounded(rows.groupBy("feature", "outcome", "arm").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2")), 6, intercept=3)


_P_SLOPE = f"({_sql_integral('atan(abs(statistic) / sqrt(df))', 'df')}) / ({_sql_integral('0.0::DOUBLE', 'df')})"
_SIMPSON = f"list_sum(list_transform(range(0, {STEPS + 1}), lambda i: (CASE WHEN i = 0 OR i = {STEPS} THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END) * exp(-pow(sqrt(statistic) + i * {10 / STEPS!r}::DOUBLE, 2) / 2)))"


@_query(_HTE + f""", cq AS (SELECT feature, outcome, contrast, a, b, 'cells' AS kind, sum(difference / pow(standard_error, 2)) / sum(1 / pow(standard_error, 2)) AS estimate, count(*) - 1.0::DOUBLE AS df FROM cell WHERE standard_error > 0 GROUP BY ALL),
qq AS (SELECT cq.*, sq.statistic FROM cq JOIN (SELECT cell.feature, cell.outcome, cell.contrast, sum(pow((difference - estimate) / standard_error, 2)) AS statistic FROM cell JOIN cq ON cq.feature = cell.feature AND cq.outcome = cell.outcome AND cq.contrast = cell.contrast WHERE standard_error > 0 GROUP BY ALL) sq ON sq.feature = cq.feature AND sq.outcome = cq.outcome AND sq.contrast = cq.contrast),
pq AS (SELECT *, CASE df WHEN 1 THEN {10 / STEPS!r}::DOUBLE / 3 * {_SIMPSON} * sqrt(2 / pi()) WHEN 4 THEN exp(-statistic / 2) * (1 + statistic / 2) WHEN 5 THEN {10 / STEPS!r}::DOUBLE / 3 * {_SIMPSON} * sqrt(2 / pi()) + exp(-statistic / 2) * sqrt(2 * statistic / pi()) * (1 + statistic / 3) END AS p_value FROM qq),
sd AS (SELECT x.feature, x.outcome, contrast, a, b, 'slope' AS kind, x.slope - z.slope AS estimate, (x.slope - z.slope) / sqrt(x.v + z.v) AS statistic, x.n + z.n - 4.0::DOUBLE AS df FROM {_PAIRS} JOIN sl x ON x.arm = a JOIN sl z ON z.arm = b AND z.outcome = x.outcome AND z.feature = x.feature),
al AS (SELECT feature, outcome, contrast, a, b, kind, estimate, statistic, df, p_value FROM pq UNION ALL SELECT feature, outcome, contrast, a, b, kind, estimate, statistic, df, {_P_SLOPE} FROM sd),
rk AS (SELECT *, row_number() OVER w AS i, (count(p_value) OVER (PARTITION BY outcome) - row_number() OVER w + 1) * p_value AS step FROM al WINDOW w AS (PARTITION BY outcome ORDER BY p_value NULLS LAST, feature, contrast))
SELECT feature, outcome, a, b, kind, CASE WHEN abs(estimate) < 5e-7 THEN 0 ELSE round(estimate, 6) END AS estimate, round(statistic, 5) AS statistic, df, round(p_value, 6) AS p_value, CASE WHEN p_value IS NOT NULL THEN round(least(1.0::DOUBLE, max(step) OVER (PARTITION BY outcome ORDER BY i)), 6) END AS p_holm FROM rk""")
def hte_features_holm(spark, sf_dir):
    return _rounded(hetero.feature_tests(units(spark, sf_dir), OUTCOMES, CONTRASTS).drop("contrast"), 6, statistic=5)


_OOF = f"""WITH {UNITS_SQL}, r AS (SELECT unit_id, arm, coalesce(history, 0)::DOUBLE AS x, spend::DOUBLE AS y, CAST({_DRAW.format(f"'{SEED}|' || unit_id")} % 5 AS INTEGER) AS fold FROM units),
f AS (SELECT g.fold, r.arm, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM r JOIN (SELECT unnest(range(0, 5)) AS fold) g ON r.fold <> g.fold GROUP BY ALL),
o AS (SELECT r.*, f0.intercept + f0.slope * x AS mu_0, f1.intercept + f1.slope * x AS mu_1, f2.intercept + f2.slope * x AS mu_2 FROM r JOIN f f0 ON f0.fold = r.fold AND f0.arm = 0 JOIN f f1 ON f1.fold = r.fold AND f1.arm = 1 JOIN f f2 ON f2.fold = r.fold AND f2.arm = 2)"""


@_query(_OOF + " SELECT unit_id, arm, fold, round(y, 2) AS y, round(mu_0, 2) AS mu_0, round(mu_1, 2) AS mu_1, round(mu_2, 2) AS mu_2 FROM o")
def uplift_tlearner(spark, sf_dir):
    return _rounded(uplift.t_learner(units(spark, sf_dir)).drop("x"), 2)


@_query(_OOF + ", d AS (SELECT t, x, CASE t WHEN 1 THEN mu_1 ELSE mu_2 END - mu_0 + CASE WHEN arm = t THEN 3 * (y - CASE t WHEN 1 THEN mu_1 ELSE mu_2 END) ELSE 0 END - CASE WHEN arm = 0 THEN 3 * (y - mu_0) ELSE 0 END AS phi FROM o, (VALUES (1), (2)) v(t)) SELECT t AS treated, round(avg(phi), 3) AS ate, round(regr_slope(phi, x), 5) AS slope FROM d GROUP BY t")
def uplift_drlearner(spark, sf_dir):
    found = uplift.t_learner(units(spark, sf_dir))
    both = [uplift.dr_scores(found, t).agg(F.lit(t).alias("treated"), F.avg("phi").alias("ate"), F.regr_slope("phi", "x").alias("slope")) for t in (1, 2)]
    return _rounded(both[0].union(both[1]), 5, ate=3)


#: Bins of about equal numbers by falling score, edges at the scores of those ranks.
_BINS = """, sc AS (SELECT unit_id, arm, y, mu_1 - mu_0 AS score FROM o WHERE arm IN (0, 1)), ed AS (SELECT list_transform(range(1, 10), lambda k: list_extract(l, CAST(ceil(k * len(l) / 10.0::DOUBLE) AS INTEGER))) AS e FROM (SELECT list(score ORDER BY score) AS l FROM sc)),
bn AS (SELECT unit_id, arm, y, CAST(len(list_filter(e, lambda x: score <= x)) AS INTEGER) AS bin FROM sc, ed),
by_bin AS (SELECT bin, count(y) FILTER (arm = 1) AS n_t, count(y) FILTER (arm = 0) AS n_c, sum(y) FILTER (arm = 1) AS s_t, sum(y) FILTER (arm = 0) AS s_c FROM bn GROUP BY bin),
qc AS (SELECT bin, n_t, n_c, s_t / n_t - s_c / n_c AS uplift, sum(s_t) OVER w - sum(s_c) OVER w * sum(n_t) OVER w / sum(n_c) OVER w AS qini FROM by_bin WINDOW w AS (ORDER BY bin))"""


@_query(_OOF + _BINS + " SELECT bin, n_t, n_c, round(uplift, 2) AS uplift, round(qini, 2) AS qini FROM qc")
def qini_curve(spark, sf_dir):
    return _rounded(uplift.uplift_bins(uplift.t_learner(units(spark, sf_dir))), 2)


_AREAS = ", st AS (SELECT *, (n_t + n_c) / sum(n_t + n_c) OVER () AS width, coalesce(lag(qini) OVER (ORDER BY bin), 0) AS before FROM qc) SELECT {name}count(*) AS n_bins, round(sum(width * (before + qini) / 2), 1) AS auuc, round(sum(width * (before + qini) / 2) - max_by(qini, bin) / 2, 1) AS qini FROM st"


@_query(_OOF + _BINS + _AREAS.format(name=""))
def uplift_area(spark, sf_dir):
    return _rounded(uplift.uplift_areas(uplift.uplift_bins(uplift.t_learner(units(spark, sf_dir)))), 1)


_DR = _OOF + """, ph AS (SELECT t, unit_id, arm, fold, x, y, CASE t WHEN 1 THEN mu_1 ELSE mu_2 END - mu_0 + CASE WHEN arm = t THEN 3 * (y - CASE t WHEN 1 THEN mu_1 ELSE mu_2 END) ELSE 0 END - CASE WHEN arm = 0 THEN 3 * (y - mu_0) ELSE 0 END AS phi FROM o, (VALUES (1), (2)) v(t)),
df AS (SELECT ph.t, g.fold, regr_slope(phi, x) AS slope, regr_intercept(phi, x) AS intercept FROM ph JOIN (SELECT unnest(range(0, 5)) AS fold) g ON ph.fold <> g.fold GROUP BY ALL),
dr AS (SELECT o.unit_id, o.arm, o.fold, o.y, a.intercept + a.slope * x AS tau_1, b.intercept + b.slope * x AS tau_2 FROM o JOIN df a ON a.fold = o.fold AND a.t = 1 JOIN df b ON b.fold = o.fold AND b.t = 2)"""


@_query(_DR + " SELECT unit_id, arm, fold, round(y, 2) AS y, round(tau_1, 2) AS tau_1, round(tau_2, 2) AS tau_2 FROM dr")
def dr_predictions(spark, sf_dir):
    return _rounded(uplift.dr_learner(uplift.t_learner(units(spark, sf_dir))), 2)


def _dr_ranked(spark, sf_dir):
    found = uplift.dr_learner(uplift.t_learner(units(spark, sf_dir)))
    return uplift.uplift_bins(found.select("unit_id", "arm", "y", F.col("tau_1").alias("mu_1"), F.lit(0.0).alias("mu_0")))


@_query(_DR + _BINS.replace("mu_1 - mu_0 AS score FROM o", "tau_1 AS score FROM dr") + " SELECT bin, n_t, n_c, round(uplift, 2) AS uplift, round(qini, 2) AS qini FROM qc")
def qini_curve_dr(spark, sf_dir):
    return _rounded(_dr_ranked(spark, sf_dir), 2)


@_query(_DR + _BINS.replace("mu_1 - mu_0 AS score FROM o", "tau_1 AS score FROM dr") + _AREAS.format(name=""))
def uplift_area_dr(spark, sf_dir):
    return _rounded(uplift.uplift_areas(_dr_ranked(spark, sf_dir)), 1)


@_query()
def uplift_tlearner_features(spark, sf_dir):
    return _rounded(uplift.t_learner_features(units(spark, sf_dir)), 4)


@_query()
def policy_value_features(spark, sf_dir):
    return _rounded(uplift.policy_values(uplift.t_learner_features(units(spark, sf_dir))), 3)


_POLICY = _OOF + """, b AS (SELECT *, CASE WHEN mu_0 >= mu_1 AND mu_0 >= mu_2 THEN 0 WHEN mu_1 >= mu_2 THEN 1 ELSE 2 END AS best FROM o),
a AS (SELECT *, policy, CASE WHEN pick < 0 THEN best ELSE pick END AS choice FROM b, (VALUES ('all_0', 0), ('all_1', 1), ('all_2', 2), ('best', -1)) v(policy, pick)),
v AS (SELECT policy, avg(CASE WHEN arm = choice THEN 3 * y ELSE 0 END) AS ipw, avg(CASE choice WHEN 0 THEN mu_0 WHEN 1 THEN mu_1 ELSE mu_2 END + CASE WHEN arm = choice THEN 3 * (y - CASE choice WHEN 0 THEN mu_0 WHEN 1 THEN mu_1 ELSE mu_2 END) ELSE 0 END) AS dr, avg(CASE WHEN choice <> 0 THEN 1.0::DOUBLE ELSE 0 END) AS send_rate FROM a GROUP BY policy)"""


@_query(_POLICY + " SELECT policy, round(ipw, 3) AS ipw, round(dr, 3) AS dr, round(send_rate, 6) AS send_rate FROM v")
def policy_value(spark, sf_dir):
    return _rounded(uplift.policy_values(uplift.t_learner(units(spark, sf_dir))), 3, send_rate=6)


@_query(_POLICY + f""", s AS (SELECT unit_id, policy, CASE choice WHEN 0 THEN mu_0 WHEN 1 THEN mu_1 ELSE mu_2 END + CASE WHEN arm = choice THEN 3 * (y - CASE choice WHEN 0 THEN mu_0 WHEN 1 THEN mu_1 ELSE mu_2 END) ELSE 0 END AS phi FROM a),
u AS (SELECT unit_id, rep, {_DRAW.format(f"'{SEED}|' || rep || '|' || unit_id")} AS u FROM units, range(0, {_REPS}) r(rep)),
m AS (SELECT rep, policy, sum(({_WEIGHT}) * phi) / sum({_WEIGHT}) AS value FROM s JOIN u USING (unit_id) GROUP BY ALL)
SELECT m.policy, round(quantile_cont(m.value, 0.025), 3) AS ci_low, round(quantile_cont(m.value, 0.975), 3) AS ci_high, round(quantile_cont(b.value - m.value, 0.025), 3) AS lead_low, round(quantile_cont(b.value - m.value, 0.975), 3) AS lead_high
FROM m JOIN m b ON b.rep = m.rep AND b.policy = 'best' GROUP BY m.policy""")
def policy_interval(spark, sf_dir):
    return _rounded(uplift.policy_intervals(uplift.t_learner(units(spark, sf_dir)), _REPS, SEED), 3)


@_query()
def policy_interval_full(spark, sf_dir):
    return _rounded(uplift.policy_intervals(uplift.t_learner(units(spark, sf_dir)), POLICY_REPLICATIONS, SEED), 3)


@_query(_OOF + _BINS + f""", {_DRAWN}, m AS (SELECT bin, rep, sum(({_WEIGHT}) * y) FILTER (arm = 1) / nullif(sum({_WEIGHT}) FILTER (arm = 1), 0) - sum(({_WEIGHT}) * y) FILTER (arm = 0) / nullif(sum({_WEIGHT}) FILTER (arm = 0), 0) AS uplift FROM bn JOIN u USING (unit_id) GROUP BY ALL)
SELECT bin, round(quantile_cont(uplift, 0.025), 2) AS ci_low, round(quantile_cont(uplift, 0.975), 2) AS ci_high FROM m GROUP BY bin""")
def uplift_bin_interval(spark, sf_dir):
    return _rounded(uplift.uplift_bin_intervals(uplift.t_learner(units(spark, sf_dir)), 200, SEED), 2)


@_query(_POLICY + ", z AS (SELECT *, dr - max(dr) FILTER (policy = 'all_0') OVER () AS gain FROM v) SELECT policy, round(gain, 3) AS gain, round(gain / nullif(send_rate, 0), 3) AS break_even FROM z WHERE send_rate > 0")
def break_even_cost(spark, sf_dir):
    return _rounded(uplift.break_even(uplift.policy_values(uplift.t_learner(units(spark, sf_dir)))).where("break_even IS NOT NULL"), 3)


@_query(_POLICY + " SELECT policy, c.cost AS cost, round(dr - c.cost * send_rate, 3) AS net FROM v, (VALUES (0.0::DOUBLE), (100.0), (1000.0)) c(cost)")
def cost_sensitivity(spark, sf_dir):
    values = uplift.policy_values(uplift.t_learner(units(spark, sf_dir)))
    return _rounded(uplift.cost_grid(values, [0.0, 100.0, 1000.0]).select("policy", "cost", "net"), 3)


_REV = "r AS (SELECT l_partkey AS product_id, CAST(ceil(l_quantity / 10) AS INTEGER) AS stars, year(l_shipdate) AS year, l_returnflag <> 'R' AS verified FROM lineitem), pr AS (SELECT p_partkey AS product_id, p_brand AS store, p_type AS form, p_retailprice AS price FROM part)"


def _size_sql(by: str, source: str = "pr") -> str:
    return f", n AS (SELECT product_id, count(*) AS n, sum(stars) AS stars FROM r GROUP BY 1), g AS (SELECT {by}, count(*) AS n_products, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_reviews, sum(stars) / sum(n)::DOUBLE AS mean_stars, avg(price) AS mean_price FROM {source} LEFT JOIN n USING (product_id) GROUP BY {by}) SELECT {by}, n_products, n_reviews, round(mean_stars, 6) AS mean_stars, round(mean_price, 4) AS mean_price, round(n_reviews / sum(n_reviews) OVER (), 6) AS share FROM g"


@_query(f"WITH {_REV}" + _size_sql("form"))
def market_size(spark, sf_dir):
    return _rounded(market.size_by(reviews(spark, sf_dir), products(spark, sf_dir), "form"), 6, mean_price=4)


@_query(f"WITH {_REV}" + _size_sql("store"))
def brand_structure(spark, sf_dir):
    return _rounded(market.size_by(reviews(spark, sf_dir), products(spark, sf_dir), "store"), 6, mean_price=4)


@_query(f"WITH {_REV}, pb AS (SELECT *, CAST((price >= 925) AS INTEGER) + CAST((price >= 950) AS INTEGER) + CAST((price >= 975) AS INTEGER) AS band FROM pr)" + _size_sql("band", "pb"))
def price_bands(spark, sf_dir):
    return _rounded(market.size_by(reviews(spark, sf_dir), market.price_band(products(spark, sf_dir), [925.0, 950.0, 975.0]), "band"), 6, mean_price=4)


@_query(f"""WITH {_REV}, n AS (SELECT product_id, count(*) AS n, avg(stars) AS stars FROM r GROUP BY 1), x AS (SELECT price, n, stars FROM pr JOIN n USING (product_id)), c AS (SELECT avg(price) AS cp, avg(stars) AS cs FROM x)
SELECT CASE WHEN price >= cp THEN 'high' ELSE 'low' END AS price_side, CASE WHEN stars >= cs THEN 'high' ELSE 'low' END AS rating_side, count(*) AS n_products, CAST(sum(n) AS BIGINT) AS n_reviews, round(avg(price), 4) AS mean_price, round(avg(stars), 6) AS mean_stars FROM x, c GROUP BY ALL""")
def positioning(spark, sf_dir):
    return _rounded(market.positioning(reviews(spark, sf_dir), products(spark, sf_dir)), 6, mean_price=4)


@_query("""WITH c AS (SELECT l_partkey, count(*) AS v FROM lineitem GROUP BY 1), o AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n, sum(v) OVER () AS t FROM c)
SELECT max(n) AS n, round(sum(v * v) / max(t) / max(t), 9) AS hhi, round(2 * sum(v * i) / (max(n) * max(t)::DOUBLE) - (max(n) + 1) / max(n)::DOUBLE, 6) AS gini, round(sum(v) FILTER (i > n - ceil(n * 0.1)) / max(t), 6) AS top10_share FROM o""")
def review_concentration(spark, sf_dir):
    per = reviews(spark, sf_dir).groupBy("product_id").agg(F.count(F.lit(1)).alias("n_reviews"))
    return _rounded(market.concentration(per), 6, hhi=9)


@_query(f"WITH {_REV} SELECT CAST(year AS INTEGER) AS year, count(*) AS n, count(*) FILTER (verified) AS n_verified, round(avg(stars), 6) AS mean_stars, count(*) FILTER (stars >= 4) AS n_high FROM r GROUP BY year")
def eda_profile(spark, sf_dir):
    rows = reviews(spark, sf_dir)
    return _rounded(rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("n_verified"), F.avg("stars").alias("mean_stars"), F.count_if(F.col("stars") >= 4).alias("n_high")))


@_query("SELECT count(*) AS n_rows, count(*) FILTER (props IS NOT NULL AND NOT json_valid(props)) AS n_bad, count(*) FILTER (props IS NULL OR trim(props) = '') AS n_empty FROM events")
def jsonl_parse_quality(spark, sf_dir):
    return files.parse_quality(read(spark, sf_dir, "events"), "props", "k long")


@_query(f"WITH {_REV}, o AS (SELECT product_id, form, row_number() OVER (PARTITION BY form ORDER BY md5('{SEED}|' || product_id), product_id) AS k FROM pr) SELECT product_id, form FROM o WHERE k <= 5")
def audit_sample(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("form").orderBy(F.md5(F.concat_ws("|", F.lit(str(SEED)), F.col("product_id").cast("string"))), "product_id")
    return products(spark, sf_dir).withColumn("k", F.row_number().over(order)).where("k <= 5").select("product_id", "form")


def _tf(spark, sf_dir):
    return market.terms(corpus(spark, sf_dir, read(spark, sf_dir, "part").count()))


_TF = r"""WITH c AS (SELECT doc_id % (SELECT count(*) FROM part) AS product_id, text FROM documents), w AS (SELECT product_id, unnest(regexp_split_to_array(lower(text), '\W+')) AS term FROM c),
tf AS (SELECT product_id, term, count(*) AS tf FROM w WHERE length(term) >= 2 GROUP BY ALL), tot AS (SELECT product_id, sum(tf) AS total FROM tf GROUP BY 1)"""


@_query(_TF + " SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM tf GROUP BY term")
def term_freq(spark, sf_dir):
    return _tf(spark, sf_dir).groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


@_query(_TF + " SELECT term, count(*) AS df, round(sum(tf) / (SELECT sum(total) FROM tot)::DOUBLE, 9) AS market, round(sum(tf / total::DOUBLE) / (SELECT count(*) FROM tot), 9) AS product_equal FROM tf JOIN tot USING (product_id) GROUP BY term")
def weighted_terms(spark, sf_dir):
    return _rounded(market.weighted_terms(_tf(spark, sf_dir)), 9)


@_query(_TF + ", d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT product_id, term, tf * (ln((1 + (SELECT count(*) FROM tot)) / (1 + df)::DOUBLE) + 1) AS tfidf FROM tf JOIN d USING (term)), k AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY round(tfidf, 6) DESC, term) AS k FROM s) SELECT product_id, term, round(tfidf, 6) AS tfidf, CAST(k AS INTEGER) AS k FROM k WHERE k <= 3")
def tfidf_top_terms(spark, sf_dir):
    from pyspark.sql import Window

    scored = _rounded(market.tfidf(_tf(spark, sf_dir)))
    return scored.withColumn("k", F.row_number().over(Window.partitionBy("product_id").orderBy(F.col("tfidf").desc(), "term"))).where("k <= 3")


@_query(_TF + ", g AS (SELECT p_partkey AS product_id, CASE WHEN p_retailprice >= 950 THEN 1 ELSE 0 END AS g FROM part), x AS (SELECT term, CAST(sum(CASE WHEN g = 1 THEN tf ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN g = 0 THEN tf ELSE 0 END) AS BIGINT) AS b FROM tf JOIN g USING (product_id) GROUP BY term), n AS (SELECT sum(a) AS na, sum(b) AS nb FROM x) SELECT term, a, b, round(ln((a + 0.5) / (na - a + 0.5)) - ln((b + 0.5) / (nb - b + 0.5)), 6) AS log_odds FROM x, n")
def keyword_contrast_by_price(spark, sf_dir):
    groups = products(spark, sf_dir).select("product_id", F.when(F.col("price") >= 950, 1).otherwise(0).alias("g"))
    return _rounded(market.keyword_contrast(_tf(spark, sf_dir), groups))


_CONTRAST = ", x AS (SELECT term, CAST(sum(CASE WHEN g = 1 THEN tf ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN g = 0 THEN tf ELSE 0 END) AS BIGINT) AS b FROM tf JOIN g USING (product_id) GROUP BY term), n AS (SELECT sum(a) AS na, sum(b) AS nb FROM x) SELECT term, a, b, round(ln((a + 0.5) / (na - a + 0.5)) - ln((b + 0.5) / (nb - b + 0.5)), 6) AS log_odds FROM x, n"
_PER_PRODUCT = ", per AS (SELECT l_partkey AS product_id, count(*) AS n, avg(ceil(l_quantity / 10)) AS stars FROM lineitem GROUP BY 1)"


def _per_product(spark, sf_dir):
    return reviews(spark, sf_dir).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.avg("stars").alias("stars"))


@_query(_TF + _PER_PRODUCT + ", g AS (SELECT product_id, CAST(stars >= 3 AS INTEGER) AS g FROM per)" + _CONTRAST)
def keyword_contrast_by_rating(spark, sf_dir):
    groups = _per_product(spark, sf_dir).select("product_id", F.when(F.col("stars") >= 3, 1).otherwise(0).alias("g"))
    return _rounded(market.keyword_contrast(_tf(spark, sf_dir), groups))


@_query(_TF + _PER_PRODUCT + ", g AS (SELECT product_id, CAST(n > (SELECT avg(n) FROM per) AS INTEGER) AS g FROM per)" + _CONTRAST)
def keyword_contrast_head_tail(spark, sf_dir):
    per = _per_product(spark, sf_dir)
    mean = per.agg(F.avg("n")).first()[0]
    return _rounded(market.keyword_contrast(_tf(spark, sf_dir), per.select("product_id", F.when(F.col("n") > mean, 1).otherwise(0).alias("g"))))


@_query(_TF + """, b AS (SELECT p_type AS g, term, sum(tf) AS a FROM tf JOIN part ON p_partkey = product_id GROUP BY ALL),
x AS (SELECT *, sum(a) OVER (PARTITION BY g) AS na, sum(a) OVER (PARTITION BY term) AS w, sum(a) OVER () AS n FROM b),
l AS (SELECT g, term, CAST(a AS BIGINT) AS a, round(ln((a + 0.5) / (na - a + 0.5)) - ln((w - a + 0.5) / (n - na - w + a + 0.5)), 6) AS log_odds FROM x),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY log_odds DESC, term) AS INTEGER) AS k FROM l) SELECT * FROM k WHERE k <= 10""")
def keywords_by_form(spark, sf_dir):
    return market.group_keywords(_tf(spark, sf_dir), products(spark, sf_dir).select("product_id", F.col("form").alias("g")))


@_query("SELECT lang, CAST(floor(log2(greatest(length(text), 1))) AS BIGINT) AS doublings, count(*) AS n, round(avg(length(text)), 4) AS mean_chars, CAST(max(length(text)) AS INTEGER) AS max_chars FROM documents GROUP BY ALL")
def eda_text_length(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("lang", F.length("text").alias("c"))
    doublings = F.floor(F.log2(F.greatest("c", F.lit(1)))).alias("doublings")
    return _rounded(rows.groupBy("lang", doublings).agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean_chars"), F.max("c").alias("max_chars")), 4)


@_query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY lower(trim(text))")
def dedupe_reviews(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.lower(F.trim("text")).alias("t")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("t")


@_query("WITH o AS (SELECT *, lower(trim(text)) AS k, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY lower(trim(text))) AS copies FROM documents) SELECT doc_id, lang, source, n_chars, copies FROM o WHERE i = 1")
def reviews_keep_first(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    return market.keep_first(rows, F.lower(F.trim("text")), "doc_id").drop("text")


@_query("""SELECT (SELECT count(*) FROM part WHERE p_partkey IS NOT NULL AND length(trim(p_name)) > 0 AND p_retailprice > 0) AS n_valid,
(SELECT count(DISTINCT doc_id % (SELECT count(*) FROM part)) FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')) AS n_with_text, (SELECT count(*) FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')) AS n_reviews""")
def valid_counts(spark, sf_dir):
    valid = market.valid_products(products(spark, sf_dir))
    texts = market.non_empty(corpus(spark, sf_dir, read(spark, sf_dir, "part").count()))
    count = texts.agg(F.count_distinct("product_id").alias("n_with_text"), F.count(F.lit(1)).alias("n_reviews"))
    return count.select(valid.agg(F.count(F.lit(1))).scalar().alias("n_valid"), "n_with_text", "n_reviews")


_PATH = "concat_ws(' > ', p_type, p_brand, p_name)"


@_query(f"SELECT split_part({_PATH}, ' > ', 1) AS top, count(DISTINCT split_part({_PATH}, ' > ', 2)) AS n_middle, count(DISTINCT split_part({_PATH}, ' > ', -1)) AS n_leaves, count(*) AS n_products FROM part GROUP BY 1")
def category_levels(spark, sf_dir):
    rows = products(spark, sf_dir).select(F.concat_ws(" > ", "form", "store", "name").alias("path"))
    level = lambda k: market.category_level("path", k, " > ")
    return rows.groupBy(level(1).alias("top")).agg(F.count_distinct(level(2)).alias("n_middle"), F.count_distinct(level(-1)).alias("n_leaves"), F.count(F.lit(1)).alias("n_products"))


@_query("SELECT p_partkey AS product_id, p_type AS form, p_brand AS store FROM part WHERE p_type IN ('PROMO', 'LARGE') AND p_brand <> 'Brand#2'")
def category_filter(spark, sf_dir):
    rows = products(spark, sf_dir).withColumn("path", F.concat_ws(" > ", "form", "store", "name"))
    return eligibility.in_category(rows, "path", ["PROMO", "LARGE"], ["Brand#2"]).select("product_id", "form", "store")


@_query(f"""WITH {_REV}, n AS (SELECT product_id, count(*) AS n_reviews, avg(stars) AS mean_stars, min(year) AS first_year, max(year) AS last_year, avg(CAST(verified AS INTEGER)) AS verified_share FROM r GROUP BY 1)
SELECT product_id, p_name AS name, store, form, price, CAST((price >= 925) AS INTEGER) + CAST((price >= 950) AS INTEGER) + CAST((price >= 975) AS INTEGER) AS band, coalesce(n_reviews, 0) AS n_reviews, round(mean_stars, 6) AS mean_stars, CAST(first_year AS INTEGER) AS first_year, CAST(last_year AS INTEGER) AS last_year, round(verified_share, 6) AS verified_share
FROM pr JOIN part ON p_partkey = product_id LEFT JOIN n USING (product_id) WHERE length(trim(p_name)) > 0 AND price > 0""")
def product_master(spark, sf_dir):
    found = market.product_master(market.valid_products(products(spark, sf_dir)), reviews(spark, sf_dir), [925.0, 950.0, 975.0])
    return _rounded(found, 6, price=12)


@_query(f"WITH {_REV}, n AS (SELECT product_id, avg(stars) AS s FROM r GROUP BY 1), q AS (SELECT 'price' AS measure, unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS share, unnest(quantile_cont(price, [0.05, 0.25, 0.5, 0.75, 0.95])) AS value FROM pr UNION ALL SELECT 'rating', unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]), unnest(quantile_cont(s, [0.05, 0.25, 0.5, 0.75, 0.95])) FROM n) SELECT measure, share, round(value, 6) AS value FROM q")
def eda_quantiles(spark, sf_dir):
    shares = [0.05, 0.25, 0.5, 0.75, 0.95]
    price = market.quantiles(products(spark, sf_dir), "price", shares).withColumn("measure", F.lit("price"))
    rating = market.quantiles(_per_product(spark, sf_dir), "stars", shares).withColumn("measure", F.lit("rating"))
    return _rounded(price.union(rating).select("measure", "share", "value"))


@_query("""WITH c AS (SELECT l_partkey, count(*) AS v FROM lineitem GROUP BY 1), b AS (SELECT v AS value, count(*) AS c FROM c GROUP BY 1)
SELECT value, round(sum(c) OVER w / sum(c) OVER (), 9) AS share_of_rows, round(sum(value * c) OVER w / sum(value * c) OVER (), 9) AS share_of_value FROM b WINDOW w AS (ORDER BY value)""")
def lorenz_curve(spark, sf_dir):
    per = reviews(spark, sf_dir).groupBy("product_id").agg(F.count(F.lit(1)).alias("n_reviews"))
    return _rounded(market.lorenz(per), 9)


@_query(f"WITH {_REV}" + _size_sql("store") + " ORDER BY n_reviews DESC, store LIMIT 10")
def top_brands(spark, sf_dir):
    return _rounded(market.top(market.size_by(reviews(spark, sf_dir), products(spark, sf_dir), "store"), "store", 10), 6, mean_price=4)


_STOP = ("the", "and", "of", "to", "in", "die", "der", "les", "des", "que", "los")


@_query(_TF + f", d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1) SELECT product_id, term, tf FROM tf JOIN d USING (term) WHERE df >= 3 AND df <= 0.5 * (SELECT count(*) FROM tot) AND term NOT IN ({', '.join(f"'{w}'" for w in _STOP)})")
def filtered_terms(spark, sf_dir):
    stop = spark.range(1).select(F.explode(F.array(*map(F.lit, _STOP))).alias("term"))
    return market.kept_terms(_tf(spark, sf_dir), 3, 0.5, stop)


@_query()
def segment_diagnostics(spark, sf_dir):
    return _rounded(segments.diagnostics(segments.kmeans(read(spark, sf_dir, "embeddings"), 10)))


@_query()
def segment_keywords(spark, sf_dir):
    found = segments.kmeans(read(spark, sf_dir, "embeddings"), 10).select(F.col("vec_id").alias("product_id"), F.col("segment").alias("g"))
    return market.group_keywords(_tf(spark, sf_dir), found)


@_query()
def svd_embedding(spark, sf_dir):
    found = segments.svd_embedding(read(spark, sf_dir, "embeddings"), 8)
    return found.select("vec_id", F.posexplode("coordinates").alias("component", "value"))


@_query()
def kmeans_segments(spark, sf_dir):
    return segments.profiles(segments.kmeans(read(spark, sf_dir, "embeddings"), 10))


@_query()
def kmeans_search(spark, sf_dir):
    return segments.kmeans_search(read(spark, sf_dir, "embeddings"), [5, 10, 20])


@_query()
def segment_agreement(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    one, two = (segments.kmeans(rows, 10, seed=s).select("vec_id", F.col("segment").alias(f"s{s}")) for s in (1, 2))
    return segments.adjusted_rand(one.join(two, "vec_id"), "s1", "s2")


@_query()
def svd_components(spark, sf_dir):
    return segments.singular_values(read(spark, sf_dir, "embeddings"), 8)


@_query("SELECT doc_id, CASE WHEN regexp_matches(text, '[!?]{2,}') THEN 'shouting' WHEN regexp_matches(text, '\\|') THEN 'list' ELSE 'prose' END AS label FROM documents")
def rule_baseline(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", eligibility.rule_label(F.col("text"), [("[!?]{2,}", "shouting"), (r"\|", "list")], "prose").alias("label"))


def _gold(spark, sf_dir, label):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("product_id"), "text")
    gold = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("product_id"), F.col(label).alias("label"))
    return docs.join(gold, "product_id"), docs


@_query()
def eligibility_model(spark, sf_dir):
    return eligibility.calibrated(*_gold(spark, sf_dir, "quality")).select("product_id", "raw", "probability")


@_query()
def form_model(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    gold = docs.withColumn("label", F.array_position(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("lang")) - 1).where("label >= 0")
    return eligibility.forms(gold, docs.select("doc_id", "lang", "text")).select("doc_id", "lang", "form")


@_query()
def density_segments(spark, sf_dir):
    found = density.density_clusters(read(spark, sf_dir, "embeddings"))
    return found.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
