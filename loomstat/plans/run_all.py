"""All stages of the experiment analysis in one session.

python -m loomstat.plans.run_all --data DIR --out DIR: the tables of DIR as units, a CSV folder per
result. Predictions are handed on as a DataFrame and kept as Parquet.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.operators import audit, hetero, inference, uplift
from loomstat.sources.files import write_csv
from loomstat.sources.frames import CONTRASTS, OUTCOMES, units

#: What --quick sets, also over values given beside it; the seed stays.
QUICK = {"folds": 3, "robustness_replications": 100, "policy_bootstrap": 100, "model_iterations": 30}
FEATURES = ("recency", "history", "newbie", "mens", "womens")


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--seed", type=int, default=20260902)
    parser.add_argument("--folds", type=int, default=5)
    parser.add_argument("--robustness-replications", type=int, default=10_000)
    parser.add_argument("--policy-bootstrap", type=int, default=2_000)
    parser.add_argument("--model-iterations", type=int, default=150, help="boosted trees for each arm and fold; 0: predictions linear in all features")
    parser.add_argument("--quick", action="store_true")
    args = parser.parse_args(argv)
    if args.quick:
        vars(args).update(QUICK)
    return args


def stages(frame: DataFrame, args: argparse.Namespace, predictions: DataFrame, linear: DataFrame) -> dict[str, DataFrame]:
    """The results by name; those from 05 on depend on the predictions, the effects of 05 on the ``linear`` ones."""
    stats = inference.moments(inference.long_outcomes(frame, OUTCOMES), ["outcome", "arm"])
    effects = inference.holm(inference.welch(inference.contrasts(stats, CONTRASTS), 0.05), ["outcome"])
    spend = frame.select("unit_id", "arm", F.col("spend").alias("y"))
    means = inference.poisson_bootstrap_means(spend, args.robustness_replications, args.seed).withColumns({"n": F.lit(1), "var": F.lit(0.0)})
    pairs = inference.contrasts(means, CONTRASTS, by=["rep"]).withColumn("d", F.col("mean_a") - F.col("mean_b"))
    intervals = pairs.groupBy("a", "b").agg(F.expr("percentile(d, 0.025)").alias("ci_low"), F.expr("percentile(d, 0.975)").alias("ci_high"))
    tests = inference.permutation_tests(spend, CONTRASTS, args.robustness_replications, args.seed)
    values = uplift.policy_values(predictions)
    return {
        "01_missing": audit.missing(frame, FEATURES),
        "01_balance": audit.balance(frame, FEATURES, (1, 0)),
        "01_category_balance": audit.category_balance(frame, ("channel", "zip_code"), (1, 0)),
        "01_duplicates": audit.duplicates(frame, frame.columns),
        "01_arm_ratio": audit.arm_ratio(frame, {0: 1 / 3, 1: 1 / 3, 2: 1 / 3}),
        "01_outcome_logic": audit.outcome_logic(frame),
        "02_effects": effects,
        # The bootstrap's limits, with the p-values of permutations and of their largest statistics.
        "03_bootstrap": intervals.join(F.broadcast(tests), ["a", "b"], "left"),
        "04_cells": hetero.cells(frame, hetero.CATEGORIES, OUTCOMES, CONTRASTS),
        "04_tests": hetero.feature_tests(frame, OUTCOMES, CONTRASTS),
        "05_uplift_bins": uplift.uplift_bins(predictions),
        "05_uplift_areas": uplift.uplift_areas(uplift.uplift_bins(predictions)),
        "05_dr_effects": uplift.dr_learner(linear),
        "05_uplift_intervals": uplift.uplift_bin_intervals(predictions, args.policy_bootstrap, args.seed),
        "06_policies": values,
        "06_policy_intervals": uplift.policy_intervals(predictions, args.policy_bootstrap, args.seed),
        "07_costs": uplift.cost_grid(values, [0.0, 100.0, 1000.0]),
        "07_break_even": uplift.break_even(values),
    }


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Run every stage in order, the first failure ends the run. Returns the paths written."""
    args = parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    frame = audit.validate_binary(audit.validate_groups(units(spark, args.data), (0, 1, 2)), ("visit", "conversion")).persist()
    path = f"{args.out}/08_oof_predictions"
    learner = {"iterations": args.model_iterations} if args.model_iterations else {}
    learn = uplift.boosted_learner if learner else uplift.t_learner_features
    learn(frame, folds=args.folds, seed=args.seed, **learner).write.mode("overwrite").parquet(path)
    linear = uplift.t_learner(frame, folds=args.folds, seed=args.seed)
    done = [path]
    for name, df in stages(frame, args, spark.read.parquet(path), linear).items():
        done.append(write_csv(df, f"{args.out}/{name}"))
    frame.unpersist()
    return done


if __name__ == "__main__":
    main()
