import numpy as np
import pytest

from loomstat.operators import density


def frame(spark, x):
    return spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")


def labels(df):
    return {r["vec_id"]: r["segment"] for r in df.collect()}


def groups(found):
    out = {}
    for k, s in found.items():
        out.setdefault(s, set()).add(k)
    return {frozenset(v) for s, v in out.items() if s >= 0}


def test_trees_of_blocks_hold_a_tree_of_all():
    x = np.random.default_rng(3).normal(size=(160, 3))
    x[100:] = x[:60]  # ties
    core = np.sort(density._distances(x, x), axis=1)[:, 5]
    whole = np.maximum(np.maximum(density._distances(x, x), core), core[:, None])
    parts = [np.arange(s, min(s + 30, 160)) for s in range(0, 160, 30)]
    held = []
    for i, a in enumerate(parts):
        for b in parts[i + 1 :]:
            at = np.concatenate([a, b])
            length, one, two = density._tree(x[at], core[at])
            assert length == pytest.approx(whole[at[one], at[two]])
            held.append((length, at[one], at[two]))
    length, one, two = (np.concatenate(c) for c in zip(*held, strict=True))
    kept = density._forest(length, one, two, 160)
    assert len(kept) == 159 and length[kept] == pytest.approx(np.sort(density._tree(x, core)[0]), abs=1e-7)


def test_blocks_change_no_cluster(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.3, (70, 4)) for c in (0, 3, 6)] + [rng.normal(0, 20, (30, 4))])
    rows = frame(spark, x)
    one = labels(density.density_clusters(rows))
    monkeypatch.setattr(density, "BLOCK", 25)
    monkeypatch.setattr(density, "PANELS", 3)
    many = labels(density.density_clusters(rows.repartition(5)))
    assert len(one) == len(many) == 240 and groups(one) == groups(many) and len(groups(one)) == 3
    assert labels(density.density_clusters(rows.limit(1))) == {0: -1} and density.density_clusters(rows.limit(0)).count() == 0


def test_more_vectors_than_one_task_may_take(spark):
    rng = np.random.default_rng(2)
    found = labels(density.density_clusters(frame(spark, np.vstack([rng.uniform(-1, 1, (10_050, 2)), rng.uniform(9, 11, (10_050, 2))]))))  # more than 20,000 raised before
    assert len(found) == 20_100 and not {found[k] for k in range(10_050)} & {found[k] for k in range(10_050, 20_100)} - {-1}
