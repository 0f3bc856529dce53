"""Approximate nearest neighbours by inner product in a hash-prefix forest.

Vectors are dealt into shards of a bounded size. In a shard every tree gives each vector a
string of hash bits, signs of random projections about the shard's median, and keeps the
strings sorted. A query descends in each tree to the longest prefix that it shares with the
shard, and then all trees ascend together, one bit at a time, until the vectors under the
prefixes of that length are enough. These candidates are scored exactly, and the best of all
shards remain. To make the largest inner product the nearest, vectors get one more component
that lifts them to equal length; queries have a zero there.

A shard's vectors reach their task once, before the queries, and its forest is built once; the
queries then pass through it in batches. Every query meets every shard, so how many candidates it
sees grows with the table, by the share that recall needs, while memory is bounded by a shard and
a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstat.llm._common import small_batches, table

TREES = 80
BITS = 32
SHARD = 20_000
#: Entries under the trees' prefixes, repeats included, that end the ascent: a share of the
#: shard, but so many at least.
ENOUGH = 0.5
LEAST = 4_096
SEED = 20240917


class Forest:
    """Sorted hash strings of the rows of ``x`` in every tree."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS):
        norms = (x * x).sum(1)
        lifted = np.column_stack([x, np.sqrt(np.maximum(norms.max() - norms, 0))])
        rng = np.random.default_rng(SEED)
        self.bits, self.trees = bits, []
        self.powers = np.left_shift(np.int64(1), np.arange(bits - 1, -1, -1))
        for _ in range(trees):
            plane = rng.normal(size=(lifted.shape[1], bits))
            cast = lifted @ plane
            middle = np.median(cast, axis=0)
            codes = (cast > middle) @ self.powers
            order = np.argsort(codes, kind="stable")
            self.trees.append((plane[:-1], middle, codes[order], order))
        self.x = x

    def candidates(self, queries: np.ndarray, enough: int):
        """Row numbers for each query, those under its prefixes at the length where there are enough."""
        codes = [(queries @ plane > middle) @ self.powers for plane, middle, _, _ in self.trees]
        low = np.zeros((len(self.trees), len(queries)), np.int64)
        high = np.full_like(low, len(self.x))
        open_ = np.ones(len(queries), bool)
        for length in range(self.bits, 0, -1):
            if not open_.any():
                break
            shift = self.bits - length
            at = np.flatnonzero(open_)
            lows, highs = np.empty((len(self.trees), len(at)), np.int64), np.empty((len(self.trees), len(at)), np.int64)
            for t, (_, _, keys, _) in enumerate(self.trees):
                first = codes[t][at] >> shift << shift
                lows[t] = np.searchsorted(keys, first)
                highs[t] = np.searchsorted(keys, first + (np.int64(1) << shift))
            done = (highs - lows).sum(0) >= enough
            low[:, at[done]], high[:, at[done]] = lows[:, done], highs[:, done]
            open_[at[done]] = False
        mark = np.zeros(len(self.x), bool)
        for q in range(len(queries)):
            mark[:] = False
            for t, (_, _, _, order) in enumerate(self.trees):
                mark[order[low[t, q] : high[t, q]]] = True
            yield np.flatnonzero(mark)


def search(vectors: DataFrame, is_query, k: int = 20, shard: int = SHARD, trees: int = TREES, enough: float = ENOUGH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: of the rows where ``is_query`` holds, the ``k`` nearest
    other rows found, by inner product in double precision, ties to the smaller id.

    Rows whose id is null, and vectors that are null, empty, zero or hold a null or non-finite
    component, take no part. Rows that repeat id and vector count once, also where many do; rows of a
    query's id are never its neighbours. Vectors only meet those of their own length. Fewer candidates
    give fewer rows, none an empty result. Other columns are ignored.
    """
    sound = "size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity')) AND exists(v, c -> c <> 0)"
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q")).where("id IS NOT NULL AND v IS NOT NULL").where(sound)
    rows = rows.groupBy("id", "v").agg(F.coalesce(F.max("q"), F.lit(False)).alias("q")).withColumn("dim", F.size("v"))
    shards = max(1, -(-vectors.count() // shard))
    base = rows.select("dim", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "v")
    asks = rows.where("q").select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "v")
    dealt = base.union(asks).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks", "id")

    def matrix(batch) -> tuple[np.ndarray, np.ndarray]:
        flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
        return batch.column("id").to_numpy(), flat.reshape(batch.num_rows, -1)

    def nearest(forest: Forest, ids: np.ndarray, batch) -> pa.RecordBatch:
        out: list[tuple] = []
        query_ids, queries = matrix(batch)
        for query, vector, found in zip(query_ids, queries, forest.candidates(queries, max(LEAST, int(enough * len(ids)))), strict=True):
            found = found[ids[found] != query]
            score = forest.x[found] @ vector
            if len(found) > k:
                bar = np.partition(score, len(score) - k)[len(score) - k]
                found, score = found[score >= bar], score[score >= bar]
            best = np.lexsort((ids[found], -score))[:k]
            out += [(query, i, s) for i, s in zip(ids[found[best]].tolist(), score[best].tolist(), strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.record_batch([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    def run(batches):
        now, held, forest, ids = None, [], None, None
        for batch in batches:
            dim, part, asking = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "asks"))
            edges = [0, *(1 + np.flatnonzero((dim[1:] != dim[:-1]) | (part[1:] != part[:-1]) | (asking[1:] != asking[:-1]))).tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:], strict=False):
                if start == stop:
                    continue
                if now != (dim[start], part[start]):
                    now, held, forest = (dim[start], part[start]), [], None
                if not asking[start]:
                    held.append(matrix(batch.slice(start, stop - start)))
                elif held or forest:
                    if forest is None:
                        ids, x = (np.concatenate(m) for m in zip(*held, strict=True))
                        forest, held = Forest(x, trees), []
                    yield nearest(forest, ids, batch.slice(start, stop - start))

    met = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the 20 nearest of every vector whose id is divisible by 20, among all others."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
