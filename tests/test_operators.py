import math

import pytest
from pyspark.sql import functions as F
from tests.oracle import differences

from loomstat.functions.student import critical, format_p, two_sided_p
from loomstat.operators import audit, inference, market, segments
from loomstat.plans.queries import ORACLES, QUERIES
from loomstat.sources import files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_student_table(spark):
    rows = spark.createDataFrame([(2.228, 10.0, 0.05), (1.96, 1e6, 0.05), (2.0, 100.0, 0.04821), (-12.706, 1.0, 0.05), (0.0, 5.0, 1.0)], "t double, d double, p double")
    for r in rows.select("p", two_sided_p("t", "d").alias("got")).collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-4)
    assert critical(10, 0.05) == pytest.approx(2.2281, abs=1e-3) and critical(math.inf, 0.05) == pytest.approx(1.95996, abs=1e-3)


def welch(spark, groups):
    rows = spark.createDataFrame([(a, y) for a, ys in groups.items() for y in ys], "arm int, y double")
    pairs = inference.contrasts(inference.moments(rows.withColumn("outcome", F.lit("y")), ["outcome", "arm"]), [(1, 0)])
    return inference.welch(pairs, 0.05).first()


def test_welch_by_hand_and_edges(spark):
    r = welch(spark, {1: [1.0, 2.0, 3.0, 4.0], 0: [2.0, 4.0, 6.0]})
    assert r["difference"] == -1.5 and r["standard_error"] == pytest.approx(math.sqrt(5 / 12 + 4 / 3)) and r["ci_low"] < -1.5 < r["ci_high"]
    back = welch(spark, {0: [1.0, 2.0, 3.0, 4.0], 1: [2.0, 4.0, 6.0]})
    assert back["t_stat"] == pytest.approx(-r["t_stat"]) and back["p_value"] == pytest.approx(r["p_value"])
    flat = welch(spark, {1: [3.0, 3.0], 0: [1.0, 1.0]})
    assert (flat["t_stat"], flat["p_value"], flat["welch_df"], flat["ci_low"], flat["ci_high"]) == (0.0, 1.0, math.inf, 2.0, 2.0)
    one = welch(spark, {1: [3.0], 0: [1.0, 2.0]})
    assert one["t_stat"] is None and one["p_value"] is None and one["difference"] == 1.5


def test_holm_is_monotone_and_at_least_raw(spark):
    rows = spark.createDataFrame([("f", k, p) for k, p in enumerate([0.01, 0.04, 0.03, None])], "outcome string, contrast int, p_value double")
    got = {r["contrast"]: r["p_holm"] for r in inference.holm(rows, ["outcome"]).collect()}
    assert got[0] == pytest.approx(0.03) and got[2] == pytest.approx(0.06) and got[1] == pytest.approx(0.06) and got[3] is None


def test_resampling_does_not_depend_on_partitions(spark):
    rows = spark.range(90).selectExpr("id AS unit_id", "CAST(id % 3 AS INT) AS arm", "CAST(id AS DOUBLE) AS y")
    one, two = ({(r["rep"], r["arm"]): r["mean"] for r in inference.bootstrap_means(rows.repartition(n), 5, 1).collect()} for n in (1, 7))
    assert one == pytest.approx(two) and len(one) == 15
    sizes = inference.permuted(rows, 3, 1).groupBy("rep", "arm").count().collect()
    assert {r["count"] for r in sizes} == {30} and len(sizes) == 12


def test_guards(spark):
    df = spark.createDataFrame([(0, "1", "x"), (1, "0", "2"), (None, "abc", None)], "arm int, a string, b string")
    audit.validate_groups(df, (0, 1))
    with pytest.raises(ValueError):
        audit.validate_groups(df, (0, 1, 2))
    audit.validate_binary(df, ["a"])
    with pytest.raises(ValueError, match="column b"):
        audit.validate_binary(df, ["a", "b"])
    with pytest.raises(ValueError, match="column a"):
        audit.validate_binary(df, ["a"], strict=True)


def test_sources(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_bytes("\ufeff Segment , Spend\nx,1\ny,2\n".encode())
    df = files.read_units(spark, str(path), ["segment", "spend"])
    assert df.columns == ["segment", "spend"] and df.count() == 2
    with pytest.raises(ValueError, match=r"\['arm', 'zip'\]"):
        files.read_units(spark, str(path), ["zip", "arm"])
    out = files.write_csv(df, str(tmp_path / "out"), compression="gzip")
    assert files.read_units(spark, out, ["spend"]).count() == 2
    lines = tmp_path / "r.jsonl"
    lines.write_text('{"k": 1}\nbroken\n')
    rows = files.read_json_lines(spark, str(lines), spark.createDataFrame([], "k long").schema).collect()
    assert sorted((r["k"] or 0, r["_corrupt_record"] or "") for r in rows) == [(0, "broken"), (1, "")]


def test_p_text_and_agreement(spark):
    row = spark.range(1).select(*(format_p(F.lit(x).cast("double")).alias(f"c{k}") for k, x in enumerate((None, 0.0, 0.0002, 0.04)))).first()
    assert tuple(row) == ("NA", "p < 0.001", "p = 2.000e-04", "p = 0.0400")
    same = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "a int, b int")
    assert segments.adjusted_rand(same, "a", "b").first()["ari"] == 1.0
    assert market.concentration(spark.createDataFrame([(1,), (1,), (1,), (1,)], "n_reviews int")).first()["gini"] == pytest.approx(0)


def test_kmeans_search_finds_two_groups(spark):
    rows = spark.createDataFrame([(k, [float(k % 2) * 9 + k / 100, 0.0]) for k in range(40)] + [(40, None)], "vec_id long, embedding array<double>")
    found = {r["k"]: r for r in segments.kmeans_search(rows, [2, 4]).collect()}
    assert [k for k, r in found.items() if r["best"]] == [2] and found[4]["cost"] < found[2]["cost"]
    same = segments.kmeans_search(rows.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0))), [2]).first()
    assert same["silhouette"] is None and not same["best"]


def test_group_keywords_and_positions_on_odd_rows(spark):
    tf = spark.createDataFrame([(1, "x", 5), (1, "y", 1), (2, "y", 5), (2, "z", 5), (3, "w", 9)], "product_id long, term string, tf long")
    groups = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "product_id long, g string")
    got = {(r["g"], r["k"]): r["term"] for r in market.group_keywords(tf, groups, 1).collect()}
    assert got == {("p", 1): "x", ("q", 1): "z"} and market.group_keywords(tf.limit(0), groups).count() == 0
    reviews = spark.createDataFrame([(1, 5), (2, 1), (2, 1)], "product_id long, stars int")
    products = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 9.0)], "product_id long, price double")
    assert sorted((r["price_side"], r["rating_side"], r["n_reviews"]) for r in market.positioning(reviews, products).collect()) == [("high", "low", 2), ("low", "high", 1)]
    assert market.positioning(reviews.limit(0), products).count() == 0


def test_staged_run(spark, tmp_path, monkeypatch):
    from loomstat.plans import run_all

    assert run_all.parse_args(["--data", "d", "--out", "o", "--folds", "9", "--quick"]).folds == 3
    assert run_all.parse_args(["--data", "d", "--out", "o"]).model_iterations == 150 and run_all.QUICK["model_iterations"] == 30
    monkeypatch.setitem(run_all.QUICK, "model_iterations", 2)
    done = run_all.main(["--data", SF, "--out", str(tmp_path), "--quick"], spark)
    assert len(done) == 19 and spark.read.option("header", True).csv(f"{tmp_path}/02_effects").count() == 9


def test_policy_and_bin_intervals_hold_their_estimates(spark):
    from loomstat.operators import uplift

    rows = spark.range(600).selectExpr("id AS unit_id", "CAST(id % 3 AS INT) AS arm", "CAST(id % 7 + 10 * (id % 3) AS DOUBLE) AS y", "3.0D AS mu_0", "13.0D + id % 2 AS mu_1", "23.0D AS mu_2")
    values = {r["policy"]: r["dr"] for r in uplift.policy_values(rows).collect()}
    got = {r["policy"]: r for r in uplift.policy_intervals(rows.repartition(5), 200, 1).collect()}
    assert set(got) == set(values) and all(got[p]["ci_low"] <= v <= got[p]["ci_high"] for p, v in values.items())
    assert got["best"]["lead_low"] == got["best"]["lead_high"] == 0 and got["all_0"]["lead_low"] > 0
    bins = {r["bin"]: r["uplift"] for r in uplift.uplift_bins(rows, bins=2).collect()}
    limits = uplift.uplift_bin_intervals(rows, 200, 1, bins=2).collect()
    assert {r["bin"] for r in limits} == set(bins) and all(r["ci_low"] <= bins[r["bin"]] <= r["ci_high"] for r in limits)
    odd = rows.withColumn("y", F.when(F.col("unit_id") > 5, F.col("y")))
    assert all(r["ci_low"] is not None for r in uplift.policy_intervals(odd, 20, 1).collect())
    assert uplift.policy_intervals(rows.limit(0), 20, 1).count() == uplift.uplift_bin_intervals(rows.limit(0), 20, 1).count() == 0


def test_density_clusters_find_two_groups_and_noise(spark):
    import numpy as np

    from loomstat.operators import density

    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 0.1, (60, 3)), rng.normal(5, 0.1, (60, 3)), [[50, 50, 50]]])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["segment"] for r in density.density_clusters(rows).collect()}
    assert len({got[k] for k in range(60)}) == 1 and len({got[k] for k in range(60, 120)}) == 1 and got[0] != got[60] and got[120] == -1


def test_models_on_known_labels(spark):
    rows = QUERIES["form_model"](spark, SF).groupBy("lang", "form").count().collect()
    right = sum(r["count"] for r in rows if ("de", "en", "es", "fr")[r["form"]] == r["lang"])
    assert right / sum(r["count"] for r in rows) > 0.8


def test_full_replicates_equal_brute_force(spark):
    import hashlib
    import itertools

    rows = [(k, k % 3, None if k == 7 else float((k * 37) % 11 + (30 if k % 3 == 1 else 0))) for k in range(45)]
    df = spark.createDataFrame(rows, "unit_id long, arm int, y double")

    def stat(arms, a, b):
        side = lambda s: [r[2] for r, x in zip(rows, arms, strict=True) if x == s and r[2] is not None]
        part = lambda v: (sum(v) / len(v), (sum(y * y for y in v) - sum(v) ** 2 / len(v)) / (len(v) - 1) / len(v))
        (ma, va), (mb, vb) = part(side(a)), part(side(b))
        return abs(ma - mb) / math.sqrt(va + vb)

    pairs, reps, seen = ((1, 0), (2, 0), (1, 2)), 2000, {}
    for rep in range(reps + 1):
        order = sorted(range(45), key=lambda k: (hashlib.md5(f"5|{rep}|{k}".encode()).hexdigest(), k))
        arms = [0] * 45
        for place, k in enumerate(order):
            arms[k] = place // 15
        seen[rep] = {p: stat([r[1] for r in rows] if rep == 0 else arms, *p) for p in pairs}
    got = {(r["a"], r["b"]): r for r in inference.permutation_tests(df.repartition(3), pairs, reps, 5).collect()}
    for p in pairs:
        assert got[p]["p_perm"] == pytest.approx((1 + sum(seen[r][p] >= seen[0][p] - 1e-9 for r in range(1, reps + 1))) / (reps + 1))
        assert got[p]["p_maxt"] == pytest.approx((1 + sum(max(seen[r].values()) >= seen[0][p] - 1e-9 for r in range(1, reps + 1))) / (reps + 1))
    assert got[1, 0]["p_maxt"] < 0.001 < got[2, 0]["p_perm"]
    one, two = ({(r["rep"], r["arm"]): (r["n"], r["mean"], r["var"]) for r in d.collect()} for d in (inference.permuted_moments(df, 70, 5), inference.moments(inference.permuted(df, 70, 5), ["rep", "arm"])))
    assert len(one) == 213 and all(one[k] == pytest.approx(two[k]) for k in two)
    few, n = df.where("unit_id < 9 AND y IS NOT NULL"), {0: [0, 3, 6], 1: [1, 4], 2: [2, 5, 8]}
    means = {(r["rep"], r["arm"]): r["mean"] for r in inference.bootstrap_means(few, 10_000, 5).collect()}
    pick = lambda rep, a, k: int(hashlib.md5(f"5|{rep}|{a}|{k}".encode()).hexdigest()[:8], 16) % len(n[a])
    assert len(means) == 30_000 and all(means[rep, a] == pytest.approx(sum(rows[n[a][pick(rep, a, k)]][2] for k in range(len(n[a]))) / len(n[a])) for rep, a in itertools.product(range(0, 10_000, 97), n))


def test_full_queries_and_stage_three(spark):
    from loomstat.operators import uplift
    from loomstat.plans import queries, run_all

    assert (queries.REPLICATIONS, queries.POLICY_REPLICATIONS) == (10_000, 2_000)
    found = [r["p_perm"] * 10_001 for r in QUERIES["permutation_p_full"](spark, SF).collect()]
    assert len(found) == 3 and all(x == pytest.approx(round(x), abs=0.01) for x in found)
    frame = queries.units(spark, SF).persist()
    args = run_all.parse_args(["--data", SF, "--out", "o", "--quick"])
    stage = run_all.stages(frame, args, uplift.t_learner(frame), uplift.t_learner(frame))["03_bootstrap"].collect()
    frame.unpersist()
    assert len(stage) == 3 and all(1 / 101 - 1e-9 <= r["p_perm"] <= r["p_maxt"] <= 1 for r in stage)


def test_forms_use_all_labels_and_keep_null_texts(spark, tmp_path):
    # A language that only ids outside the former quarter (hash of the id modulo 4 is 0) have.
    ids = {k: [r["id"] for r in spark.range(400).where((F.pmod(F.xxhash64("id"), F.lit(4)) == 0) == k).limit(30).collect()] for k in (True, False)}
    rows = [(k, "der und das", "de") if i % 2 else (k, "the and of", "en") for i, k in enumerate(ids[True])] + [(k, "le la et", "fr") for k in ids[False]] + [(900, None, "en"), (901, "the and of", "xx"), (902, "the", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["form"] for r in QUERIES["form_model"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[900] is None and got[901] == 1 and all(got[k] == 3 for k in ids[False])


def test_effects_by_every_feature(spark):
    from loomstat.operators import uplift
    from loomstat.plans import queries

    frame = queries.units(spark, SF)
    got = QUERIES["hte_cells_all"](spark, SF).collect()
    assert {(r["feature"], r["outcome"]) for r in got} == {(f, o) for f in ("newbie", "mens", "womens", "channel", "zip_code") for o in ("spend", "visit", "conversion")}
    want = {r["feature"]: r for r in uplift.cells(frame, "zip_code", (2, 0), "conversion").collect()}
    mine = {r["value"]: r for r in got if (r["feature"], r["outcome"], r["a"], r["b"]) == ("zip_code", "conversion", 2, 0)}
    assert mine.keys() == want.keys() and all(mine[k]["difference"] == pytest.approx(want[k]["difference"], abs=1e-4) and mine[k]["n_a"] == want[k]["n_a"] for k in want)
    slopes = {(r["feature"], r["outcome"], r["arm"]): r["slope"] for r in QUERIES["hte_slopes_all"](spark, SF).collect()}
    assert len(slopes) == 18 and all(slopes["recency", "visit", r["arm"]] == pytest.approx(r["slope"], abs=1e-6) for r in uplift.slopes(frame, "recency", "visit").collect())


def test_tails_at_known_values(spark):
    from loomstat.functions.normal import chi_square_tail, two_sided_normal

    rows = spark.createDataFrame([(3.841458820694124, 1), (5.991464547107979, 2), (7.814727903251179, 3), (9.487729036781154, 4), (11.070497693516351, 5), (18.307038053275146, 10), (19.67513757268249, 11), (0.0, 4), (None, 4), (1.0, 0)], "q double, df int")
    got = [r["p"] for r in rows.select(chi_square_tail("q", "df").alias("p")).collect()]
    assert got[:7] == pytest.approx([0.05] * 7, abs=1e-9) and got[7] == pytest.approx(1.0) and got[8:] == [None, None]
    z = spark.createDataFrame([(1.959963984540054,), (-1.959963984540054,), (0.0,), (None,)], "z double").select(two_sided_normal("z").alias("p"))
    got = [r["p"] for r in z.collect()]
    assert got[:3] == pytest.approx([0.05, 0.05, 1.0], abs=1e-9) and got[3] is None


def test_learner_on_all_features_equals_least_squares(spark):
    import numpy as np
    from loomstat.operators import uplift

    rng = np.random.default_rng(4)
    rows = [(k, k % 3, float(rng.normal() + k % 3), None if k % 37 == 0 else float(rng.integers(1, 12)), float(rng.gamma(2.0) * 100), int(k % 2), int(k % 5 == 0), int(k % 7 == 0), rng.choice(["web", "phone", None]), str(rng.choice(["r", "s", "u"]))) for k in range(400)]
    rows = [(*r[:2], None if k % 50 == 0 else r[2] + 0.01 * r[4] + (1.5 if r[8] == "web" else 0.0), *r[3:8], None if r[8] is None else str(r[8]), r[9]) for k, r in enumerate(rows)]
    frame = spark.createDataFrame(rows, "unit_id long, arm int, spend double, recency double, history double, newbie int, mens int, womens int, channel string, zip_code string")
    got = {r["unit_id"]: r for r in uplift.t_learner_features(frame, folds=4, ridge=0.0).collect()}
    recency = np.mean([r[3] for r in rows if r[3] is not None])
    x = np.array([[1.0, recency if r[3] is None else r[3], r[4], r[5], r[6], r[7], r[8] == "web", r[9] == "s", r[9] == "u"] for r in rows], float)
    fold, arm = np.array([got[r[0]]["fold"] for r in rows]), np.array([r[1] for r in rows])
    known = np.array([r[2] is not None for r in rows])
    y = np.array([r[2] or 0.0 for r in rows])
    for f in range(4):
        for a in range(3):
            use = (fold != f) & (arm == a) & known
            weights = np.linalg.lstsq(x[use], y[use], rcond=None)[0]
            mine = [got[k][f"mu_{a}"] for k in np.flatnonzero(fold == f)]
            assert mine == pytest.approx((x[fold == f] @ weights).tolist(), abs=1e-6)
    boosted = uplift.boosted_learner(frame, iterations=3, folds=2).collect()
    assert len(boosted) == 400 and all(r["mu_0"] is not None and r["mu_2"] is not None for r in boosted)


def test_first_rows_valid_rows_and_levels(spark):
    from loomstat.operators import market

    rows = spark.createDataFrame([(2, "a ", "x"), (1, "A", "y"), (None, "a", "z"), (5, None, "n"), (4, None, "m"), (9, "b", None)], "id long, text string, other string")
    got = {(r["id"], r["text"], r["other"], r["copies"]) for r in market.keep_first(rows, F.lower(F.trim("text")), "id").collect()}
    assert got == {(1, "A", "y", 3), (4, None, "m", 2), (9, "b", None, 1)}
    goods = spark.createDataFrame([(1, "n", 2.0), (2, " ", 2.0), (3, "n", 0.0), (None, "n", 2.0), (5, None, 1.0)], "product_id long, name string, price double")
    assert [r["product_id"] for r in market.valid_products(goods).collect()] == [1]
    texts = spark.createDataFrame([("a",), (" \n",), ("",), (None,)], "text string")
    assert market.non_empty(texts).count() == 1 and market.keep_first(rows.limit(0), F.col("text"), "id").count() == 0
    paths = spark.createDataFrame([("a > b > c",), ("a",), ("",), (None,)], "p string")
    assert [tuple(r) for r in paths.select(*(market.category_level("p", k, " > ") for k in (1, 2, -1))).collect()] == [("a", "b", "c"), ("a", None, "a"), (None, None, None), (None, None, None)]


def test_svd_embedding_equals_numpy(spark):
    import numpy as np
    from loomstat.operators import segments

    x = np.random.default_rng(2).normal(size=(200, 6)) * np.array([5, 4, 3, 2, 1, 0.5])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None)], "vec_id long, embedding array<double>")
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert [r["value"] for r in segments.singular_values(rows, 3).orderBy("component").collect()] == pytest.approx(s[:3].tolist())
    got = {r["vec_id"]: r["coordinates"] for r in segments.svd_embedding(rows, 3).collect()}
    assert got[900] is None and np.abs(np.array([got[k] for k in range(200)])) == pytest.approx(np.abs(u[:, :3] * s[:3]), abs=1e-6)
    two = spark.createDataFrame([(0, [0.0, 0.0]), (0, [2.0, 0.0]), (1, [1.0, 5.0])], "segment int, embedding array<double>")
    assert {(r["segment"], r["n"], r["spread"]) for r in segments.diagnostics(two).collect()} == {(0, 2, 1.0), (1, 1, 0.0)}


def test_product_outputs(spark, tmp_path):
    from loomstat.plans import run_products

    done = run_products.main(["--data", SF, "--out", str(tmp_path)], spark)
    assert len(done) == 10 and spark.read.parquet(f"{tmp_path}/reviews_analysis.parquet").count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert spark.read.option("header", True).csv(f"{tmp_path}/product_master").count() == spark.read.parquet(f"{SF}/part.parquet").count()
    texts = spark.read.parquet(f"{tmp_path}/texts_analysis.parquet")
    assert texts.count() == texts.select(F.lower(F.trim("text"))).distinct().count() > 0


def test_bin_edges_are_exact_beyond_ten_thousand_rows(spark):
    from loomstat.operators import uplift

    rows = spark.range(60_000).selectExpr("id AS unit_id", "CAST(id % 2 AS INT) AS arm", "1.0D AS y", "0.0D AS mu_0", "CASE WHEN id % 5 = 0 THEN 7.0D ELSE CAST(pmod(xxhash64(id), 1000003) AS DOUBLE) END AS mu_1")
    scores = sorted(r["mu_1"] for r in rows.collect())
    edges = [scores[-(-k * 60_000 // 10) - 1] for k in range(1, 10)]
    want = {b: sum(sum(s <= e for e in edges) == b for s in scores) for b in range(10)}
    got = {r["bin"]: r["n_t"] + r["n_c"] for r in uplift.uplift_bins(rows.repartition(3)).collect()}
    assert got == {b: n for b, n in want.items() if n}
