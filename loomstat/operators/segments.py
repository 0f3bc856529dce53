"""Segmentation: k-means, singular values, cluster profiles, agreement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _features(vectors: DataFrame, vector_col: str) -> DataFrame:
    return vectors.where(F.col(vector_col).isNotNull()).withColumn("features", array_to_vector(F.col(vector_col).cast("array<double>")))


def kmeans(vectors: DataFrame, k: int, seed: int = 20260902, max_iter: int = 20, vector_col: str = "embedding") -> DataFrame:
    """``vectors`` with ``segment``; rows with a null vector are left out."""
    rows = _features(vectors, vector_col)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="segment").fit(rows)
    return model.transform(rows).drop("features")


def kmeans_search(vectors: DataFrame, ks: list[int], seed: int = 20260902, max_iter: int = 20, vector_col: str = "embedding") -> DataFrame:
    """``k, cost, silhouette, best``: k-means at each k, judged by the mean silhouette of squared
    distances, which takes sums by cluster, not pairs. The best has the largest, the smaller k
    at ties. Each k is 2 or more; one that leaves a single cluster, as of equal vectors, has no
    silhouette. Vectors are kept in memory or on disk over the search.
    """
    rows = _features(vectors, vector_col).select("features").persist()
    found = []
    for k in ks:
        model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="segment").fit(rows)
        several = sum(n > 0 for n in model.summary.clusterSizes) > 1
        score = ClusteringEvaluator(featuresCol="features", predictionCol="segment").evaluate(model.transform(rows)) if several else None
        found.append((k, float(model.summary.trainingCost), score))
    rows.unpersist()
    best = max((x for x in found if x[2] is not None), key=lambda x: (x[2], -x[0]), default=(None,))[0]
    return vectors.sparkSession.createDataFrame([(*x, x[0] == best) for x in found], "k int, cost double, silhouette double, best boolean")


def profiles(segmented: DataFrame, label: str = "label") -> DataFrame:
    """``segment, n, n_labels, purity``: size, and the share of the commonest label."""
    by = segmented.groupBy("segment", label).agg(F.count(F.lit(1)).alias("c"))
    return by.groupBy("segment").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_labels"), (F.max("c") / F.sum("c")).alias("purity"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from their contingency table."""
    cell = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    choose = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = cell.agg(choose("c")).first()[0] or 0.0
    left = cell.groupBy(a).agg(F.sum("c").alias("c")).agg(choose("c"), F.sum("c")).first()
    right = cell.groupBy(b).agg(F.sum("c").alias("c")).agg(choose("c")).first()[0] or 0.0
    n = left[1] or 0
    pairs_all = n * (n - 1) / 2
    expected = (left[0] or 0.0) * right / pairs_all if pairs_all else 0.0
    top = ((left[0] or 0.0) + right) / 2 - expected
    return pairs.sparkSession.range(1).select(F.lit(float((both - expected) / top) if top else 1.0).alias("ari"))


def diagnostics(segmented: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``segment, n, share, spread``: size, share of all rows, and the mean squared distance to the centre."""
    parts = segmented.where(F.col(vector_col).isNotNull()).select("segment", F.col(vector_col).cast("array<double>").alias("v")).select("segment", F.posexplode("v").alias("at", "x"))
    # The spread is the sum of the components' variances.
    by = parts.groupBy("segment", "at").agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("var")).groupBy("segment").agg(F.max("n").alias("n"), F.sum("var").alias("spread"))
    return by.select("segment", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"), "spread")


def _gram(vectors: DataFrame, vector_col: str) -> np.ndarray:
    """The matrix of inner products of the components, added up from one partial matrix for each task."""

    def run(batches):
        total = None
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1)
            total = x.T @ x + (0 if total is None else total)
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "x"])

    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("v"))
    sums = rows.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()  # the square of the components
    out = np.zeros(len(sums))
    for r in sums:
        out[r["at"]] = r["x"]
    n = int(round(len(sums) ** 0.5))
    return out.reshape(n, n)


def truncated_svd(vectors: DataFrame, k: int, vector_col: str = "embedding") -> tuple[list[float], np.ndarray]:
    """The ``k`` largest singular values of the rows, without centring, and their directions as columns, the
    largest component of each positive. Vectors of one length without nulls; fewer components give
    fewer values."""
    squares, directions = np.linalg.eigh(_gram(vectors, vector_col))
    order = np.argsort(-squares)[:k]
    directions = directions[:, order]
    if directions.size:
        directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])])
    return np.sqrt(np.maximum(squares[order], 0)).tolist(), directions


def singular_values(vectors: DataFrame, k: int, vector_col: str = "embedding") -> DataFrame:
    """``component, value``: the largest singular values, without centring."""
    values, _ = truncated_svd(vectors, k, vector_col)
    return vectors.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "component int, value double")


def svd_embedding(vectors: DataFrame, k: int, vector_col: str = "embedding", out: str = "coordinates") -> DataFrame:
    """``vectors`` with ``out``: each row's coordinates along the ``k`` directions of truncated_svd, as
    expressions on the array; null for a null vector."""
    _, directions = truncated_svd(vectors, k, vector_col)
    columns = ["array(" + ", ".join(f"{w!r}D" for w in column) + ")" for column in directions.T.tolist()]
    dot = lambda c: f"aggregate(zip_with(CAST(`{vector_col}` AS array<double>), {c}, (x, w) -> x * w), 0.0D, (s, x) -> s + x)"
    return vectors.withColumn(out, F.expr(f"IF(`{vector_col}` IS NULL, NULL, array({', '.join(map(dot, columns))}))"))
