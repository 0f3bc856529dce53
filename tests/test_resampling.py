import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstat.functions import digests
from loomstat.operators import inference, resampling


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def units(spark, n=500):
    return spark.range(n).selectExpr("id * 7 - 50 AS unit_id", "CAST(id % 3 AS INT) AS arm", "IF(id % 41 = 3, NULL, CAST(pmod(xxhash64(id), 1000) AS DOUBLE)) AS y")


def test_digests_by_array_equal_hashlib():
    for heads, texts in (([b"5|8", b"5|9"], ["|1", "|22", "", "|é", "|4444444"]), ([b"x" * 40], ["a" * 15]), ([b"x" * 40], ["a" * 16, "b"]), ([b""], [""]), ([b"12345678|1"], [f"|{k}" for k in range(995, 1005)])):
        got = digests.Endings(pa.array(["skipped", *texts]).slice(1)).after(heads)
        assert got.tolist() == [[int(hashlib.md5(h + t.encode()).hexdigest()[:8], 16) for t in texts] for h in heads]
    names = [b"%d" % k for k in range(120)]
    assert [k for turn in digests.turns(names, 1000) for k in turn] == list(range(120)) and all(len({len(names[k]) for k in turn}) == 1 for turn in digests.turns(names, 1000))


def test_bootstrap_makes_its_draws_without_a_join(spark, monkeypatch):
    rows = units(spark).withColumn("arm", F.when(F.col("arm") < 2, F.col("arm")))
    fast = inference.bootstrap_means(rows, 130, 5)
    assert "Join" not in plan(fast)  # a row per unit and replicate was joined and shuffled before
    got = {(r["rep"], r["arm"]): r["mean"] for r in fast.collect()}
    monkeypatch.setattr(resampling, "BLOCK", 7)
    small = {(r["rep"], r["arm"]): r["mean"] for r in inference.bootstrap_means(rows.repartition(3), 130, 5).collect()}
    monkeypatch.setattr(resampling, "MOST_HELD", 0)
    joined = {(r["rep"], r["arm"]): r["mean"] for r in inference.bootstrap_means(rows, 130, 5).collect()}
    assert len(got) == 260 and got == pytest.approx(joined) and small == pytest.approx(joined)
    assert inference.bootstrap_means(rows.limit(0), 5, 5).count() == 0


def test_contrasts_run_their_input_once(spark):
    stats = inference.moments(units(spark).withColumn("rep", F.col("unit_id") % 2), ["rep", "arm"])
    assert plan(inference.contrasts(stats, [(1, 0), (0, 2)], by=["rep"])).count("Range (") == 1
    some = spark.createDataFrame([(1, 0, 3, 1.0, None), (1, 1, 2, 2.0, 0.5), (2, 0, 1, 1.0, 1.0), (None, 0, 1, 1.0, 1.0), (None, 1, 1, 1.0, 1.0)], "rep int, arm int, n long, mean double, var double")
    assert [tuple(r) for r in inference.contrasts(some, [(1, 0), (2, 0)], by=["rep"]).collect()] == [(1, 0, 1, 0, 2, 2.0, 0.5, 3, 1.0, None)]


def test_policy_replicates_are_dealt_and_equal_the_expressions(spark):
    from loomstat.operators import uplift

    rows = units(spark).selectExpr("unit_id", "arm", "y", "3.0D + unit_id % 5 AS mu_0", "500.0D AS mu_1", "400.0D + unit_id % 300 AS mu_2").coalesce(1)
    sums = resampling.weighted_sums(rows.na.drop(), ["y", "mu_2"], 115, 5, "unit_id")
    got = {r["rep"]: (r["w"], r["y"], r["mu_2"]) for r in sums.collect()}
    drawn = uplift._replicated(rows.na.drop(), 115, 5).groupBy("rep").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("y"), F.sum(F.col("w") * F.col("mu_2")).alias("m"))
    want = {r["rep"]: (r["w"], r["y"], r["m"]) for r in drawn.collect()}
    assert len(got) == 115 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    intervals = plan(uplift.policy_intervals(rows, 115, 5))
    assert "MapInArrow" in intervals and "md5" not in intervals  # a unit's replicates were exploded in the units' partitions, one of small tables
    endless = rows.na.drop().withColumn("y", F.when(F.col("unit_id") == 20, float("inf")).otherwise(F.col("y")))
    hit = {r["rep"]: r["y"] == float("inf") for r in resampling.weighted_sums(endless, ["y"], 20, 5, "unit_id").collect()}
    assert hit == {r["rep"]: r["hit"] for r in uplift._replicated(endless, 20, 5).groupBy("rep").agg(F.max(F.col("unit_id") == 20).alias("hit")).collect()}


def test_permuted_sums_rank_without_a_window(spark, monkeypatch):
    rows = units(spark, 300).union(spark.range(40).selectExpr("9L AS unit_id", "CAST(id % 2 AS INT) AS arm", "5.0D AS y")).union(spark.range(3).selectExpr("CAST(NULL AS BIGINT)", "1", "5.0D"))
    assert "Window" not in plan(resampling.shuffled_sums(rows, 115, 5, "unit_id", [100, 200, 343], 0.0))  # rows of shared buckets were sorted before
    read = lambda: {(r["rep"], r["arm"]): (r["n"], r["mean"], r["var"]) for r in inference.permuted_moments(rows.repartition(3), 115, 5).collect()}
    fast = read()
    want = {(r["rep"], r["arm"]): (r["n"], r["mean"], r["var"]) for r in inference.moments(inference.permuted(rows, 115, 5), ["rep", "arm"]).collect()}
    monkeypatch.setattr(resampling, "MOST_HELD", 0)
    ranked = read()
    assert len(fast) == 116 * 3 and all(fast[k] == pytest.approx(want[k]) and ranked[k] == pytest.approx(want[k]) for k in want)
    one = units(spark, 9).withColumn("arm", F.lit(1))
    monkeypatch.undo()
    assert {r["n"] for r in inference.permuted_moments(one, 3, 5).collect()} == {8} and inference.permuted_moments(one.limit(0), 3, 5).where("rep > 0").count() == 0


def test_first_bits_in_common_at_an_edge_are_ordered_by_the_whole_digest(spark, monkeypatch):
    rows = units(spark, 60)
    want = {(r["rep"], r["arm"]): (r["n"], r["mean"]) for r in inference.permuted_moments(rows, 6, 5).collect()}
    after = digests.Endings.after
    blunt = lambda self, heads: after(self, heads) >> np.uint32(28)
    whole = lambda sums: {(r["rep"], r["at"]): r["n"] for r in sums.collect()}
    exact = whole(resampling.shuffled_sums(rows, 6, 5, "unit_id", [20, 40, 60], 0.0))
    table = list(zip(*[(f"|{r['unit_id']}".encode(), r["y"]) for r in rows.collect()], strict=True))
    at = resampling.placed_by_digest([b"5|%d" % k for k in range(1, 7)], [digests.Endings(pa.array(table[0]))], pa.array(table[0]), [19, 39])
    monkeypatch.setattr(digests.Endings, "after", blunt)
    tied = resampling.placed_by_digest([b"5|%d" % k for k in range(1, 7)], [digests.Endings(pa.array(table[0]))], pa.array(table[0]), [19, 39])
    assert (at == tied).all() and len(want) == 21
    assert {(k + 1, a): sum(y is not None for y, x in zip(table[1], at[k], strict=True) if x == a) for k in range(6) for a in range(3)} == exact


def test_tests_of_permutations_make_the_replicates_once(spark):
    found = inference.permutation_tests(units(spark), ((1, 0), (2, 0), (1, 2)), 30, 5)
    assert "md5" not in plan(found) and "MapInArrow" not in plan(found)  # p-values of all kinds read sums that are there
    assert all(1 / 31 - 1e-9 <= r["p_perm"] <= r["p_maxt"] <= 1 for r in found.collect())


def test_permuted_sums_in_the_jvm_equal_those_of_workers(spark, monkeypatch):
    read = lambda rows, bounds: {(r["rep"], r["at"]): (r["n"], r["s"], r["q"]) for r in resampling.shuffled_sums(rows, 115, 5, "unit_id", bounds, 3.0).collect()}
    some = units(spark, 900).where("unit_id > 40 OR arm = 1")
    tables = (some, some.limit(1), some.withColumn("unit_id", F.lit(None)), some.selectExpr("repeat('é', int(unit_id % 30)) || unit_id AS unit_id", "y"), some.selectExpr("CAST(NULL AS STRING) AS unit_id", "CAST(NULL AS DOUBLE) AS y"))
    for rows in tables:
        size = rows.count()
        bounds = sorted({max(1, size // 3), max(1, size // 2), size})
        # Where units go by digest is worked out by the JVM, in loops over primitive arrays; a worker's arrays took about eight times as long.
        assert "loomstat_shuffledsums" in plan(resampling.shuffled_sums(rows, 115, 5, "unit_id", bounds, 3.0)).lower()
        near = read(rows.repartition(3, "y"), bounds)
        with monkeypatch.context() as m:
            m.setattr(resampling, "MOST_IN_JVM", 0)
            far = read(rows.repartition(3, "y"), bounds)
        assert len(near) == 115 * len(bounds) and near.keys() == far.keys() and all(near[k] == pytest.approx(far[k]) for k in near)
    assert read(some.limit(0), [4]) == {}


def test_whole_digests_order_units_in_the_jvm_where_first_bits_agree(spark):
    digest = {k: hashlib.md5(b"5|1|%d" % k).digest() for k in range(300_000)}
    order = sorted(digest, key=digest.get)
    shared = [i for i in range(len(order) - 1) if digest[order[i]][:4] == digest[order[i + 1]][:4]]
    assert shared  # pairs of units whose first bits are one
    rows = spark.range(300_000).selectExpr("id AS unit_id", f"IF(id = {order[shared[0]]}, 2D, IF(id = {order[shared[0] + 1]}, 7D, 0D)) AS y")
    got = {r["at"]: (r["n"], r["s"]) for r in resampling.shuffled_sums(rows, 1, 5, "unit_id", [shared[0] + 1, 300_000], 0.0).collect()}
    assert got == {0: (shared[0] + 1, 2.0), 1: (300_000 - shared[0] - 1, 7.0)}
