"""Many replicates of counter-based draws, the digests taken by array in Python workers.

Every function deals its replicates, or its units, over all cores, and sends sums on, not draws.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions import native
from loomstat.functions.digests import TURN, Endings, turns

#: Rows of a stratum, or of all arms, that a worker holds at most; beyond, the plans by join and by rank do the same.
MOST_HELD = 20_000_000
#: Units that a task holds in the JVM's heap at most, by estimate 90 bytes each; beyond, a worker does the same.
MOST_IN_JVM = 2_000_000
#: Values of a stratum that are sent in one row.
BLOCK = 4096


def parts_of(rows: DataFrame) -> int:
    """Tasks to deal work over: some for each core."""
    return 4 * rows.sparkSession.sparkContext.defaultParallelism


def _numbers(start: int, stop: int) -> Endings:
    return Endings(pa.array([f"|{k}" for k in range(start, stop)]))


def drawn_means(placed: DataFrame, replicates: int, seed: int, strata: str) -> DataFrame:
    """``rep, strata, mean`` of as many draws with replacement as a stratum of ``placed`` (``strata, rn, y``) has rows.

    A task holds one stratum's values at a time, and makes the draws of its own replicates.
    """
    parts = min(parts_of(placed), replicates)
    kind = placed.schema[strata].dataType.simpleString()
    blocks = placed.groupBy(strata, F.expr(f"rn div {BLOCK}").alias("_block")).agg(F.expr("transform(array_sort(collect_list(struct(rn, CAST(y AS DOUBLE) AS y))), s -> s.y)").alias("_ys"))
    each = blocks.select(strata, F.col(strata).cast("string").cast("binary").alias("_name"), "_block", "_ys", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    dealt = each.repartitionById(parts, "_part").sortWithinPartitions("_part", strata, "_block")

    def strata_of(batches: Iterator[pa.RecordBatch]):
        """The place of a stratum and its values, in order of their ranks."""
        at, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                now = (batch["_part"][k].as_py(), batch["_name"][k].as_py())
                if now != at:
                    if held:
                        yield *at, value, np.concatenate(held)
                    at, value, held = now, batch[strata].slice(k, 1), []
                held.append(batch["_ys"][k].values.to_numpy(zero_copy_only=False))
        if held:
            yield *at, value, np.concatenate(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, name, value, ys in strata_of(batches):
            reps, n = np.arange(part, replicates, parts), len(ys)
            names, sums = [b"%d|%d|%b" % (seed, rep, name) for rep in reps], np.zeros(len(reps))
            for start in range(0, n, TURN):
                ends = _numbers(start, min(n, start + TURN))
                for turn in turns(names, ends.n):
                    sums[turn] += ys[ends.after([names[k] for k in turn]) % np.uint32(n)].sum(axis=1)
            yield pa.record_batch([pa.array(reps, pa.int32()), value.take(pa.array([0] * len(reps))), pa.array(sums / n)], names=["rep", strata, "mean"])

    return dealt.mapInArrow(run, f"rep int, `{strata}` {kind}, mean double")


def placed_by_digest(heads: list[bytes], ends: list[Endings], texts: pa.Array, cuts: list[int]) -> np.ndarray:
    """For each beginning and ending (``texts``, in parts ``ends``) how many ranks of ``cuts`` are below its own, by order of digests."""
    firsts = np.concatenate([e.after(heads) for e in ends], axis=1)
    at = np.zeros(firsts.shape, np.int64)
    if not cuts:
        return at
    edges = np.partition(firsts, cuts, axis=1)[:, cuts]
    for j in range(len(cuts)):
        at += firsts > edges[:, j : j + 1]
    # Units whose first bits are an edge's are ordered by their whole digests.
    for r, j in zip(*np.nonzero((firsts[:, None, :] == edges[:, :, None]).sum(axis=2) > 1), strict=True):
        same = np.flatnonzero(firsts[r] == edges[r, j]).tolist()
        same.sort(key=lambda i, head=heads[r]: hashlib.md5(head + texts[i].as_py(), usedforsecurity=False).digest())
        before = int((firsts[r] < edges[r, j]).sum())
        at[r, same] = np.searchsorted(cuts, np.arange(before, before + len(same)))
    return at


def shuffled_sums(rows: DataFrame, replicates: int, seed: int, key: str, bounds: list[int], centre: float) -> DataFrame:
    """``rep, at, n, s, q`` from rep 1: count, sum and squares of ``y - centre`` over the units that the order of
    their digests puts at the ranks up to ``bounds[at]``. A task holds all units for its replicates, in the JVM where
    they are few enough and it takes compiled sources, else in a worker."""
    parts = min(parts_of(rows), replicates)
    ending = F.coalesce(F.concat(F.lit("|"), F.col(key).cast("string")), F.lit("")).cast("binary")  # as concat_ws leaves out nulls
    units = rows.select(ending.alias("_end"), (F.col("y").cast("double") - F.lit(centre)).alias("y"))
    cuts, kinds = [b - 1 for b in bounds[:-1]], len(bounds)
    packed = units.mapInArrow(_packed, "_ends binary, _lengths binary, _values binary, _known binary")
    each = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part")).repartitionById(parts, "_part")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's rows as one."""
        held = [batch for batch in batches if batch.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            one = lambda c: pa.array([b"".join(table[c].to_pylist())], pa.binary())
            yield pa.record_batch([table["_part"].chunk(0).slice(0, 1), *map(one, _PACKED)], names=["_part", *_PACKED])

    if bounds[-1] <= MOST_IN_JVM and native.registered(rows.sparkSession, "ShuffledSums", "array<array<double>>"):
        joined = each.mapInArrow(whole, "_part int, _ends binary, _lengths binary, _values binary, _known binary")
        sums = F.call_function(native.name_of("ShuffledSums"), "_part", F.lit(parts), F.lit(replicates), F.lit(str(seed)), *_PACKED, F.lit(np.array(cuts, "<i4").tobytes()))
        found = joined.select("_part", F.posexplode(sums).alias("_k", "_sum"))
        rep, value = F.col("_part") + 1 + F.expr(f"_k div {kinds}") * parts, lambda k: F.col("_sum")[k]
        return found.select(rep.cast("int").alias("rep"), (F.col("_k") % kinds).alias("at"), value(0).cast("long").alias("n"), value(1).alias("s"), value(2).alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(whole(batches))
        if not held:
            return
        blob = lambda c: held[0][c][0].as_buffer()
        reps = np.arange(held[0]["_part"][0].as_py() + 1, replicates + 1, parts)
        y, known, lengths = np.frombuffer(blob("_values"), "<f8"), np.frombuffer(blob("_known"), bool), np.frombuffer(blob("_lengths"), "<i4")
        squares, n = y * y, len(y)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        texts = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), blob("_ends")])
        ends = [Endings(texts.slice(k, TURN)) for k in range(0, n, TURN)]
        names = [b"%d|%d" % (seed, rep) for rep in reps]
        for turn in turns(names, n):
            heads = [names[k] for k in turn]
            at = placed_by_digest(heads, ends, texts, cuts)
            for r in range(len(turn)):
                count = np.bincount(at[r] if known.all() else at[r][known], minlength=kinds)
                s, q = (np.bincount(at[r], v, kinds) for v in (y, squares))
                yield pa.record_batch([pa.array(np.full(kinds, reps[turn[r]]), pa.int32()), pa.array(np.arange(kinds), pa.int32()), pa.array(count, pa.int64()), pa.array(s), pa.array(q)], names=["rep", "at", "n", "s", "q"])

    return each.mapInArrow(run, "rep int, at int, n long, s double, q double")


_PACKED = ("_ends", "_lengths", "_values", "_known")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per batch: endings end to end, their lengths, values with 0 for none, and whether they are there."""
    for batch in batches:
        if batch.num_rows:
            texts = batch["_end"].cast(pa.binary())
            offsets = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset :][: batch.num_rows + 1]
            known = batch["y"].is_valid().to_numpy(zero_copy_only=False)
            values = np.where(known, batch["y"].to_numpy(zero_copy_only=False), 0.0)
            ends = texts.buffers()[2][offsets[0] : offsets[-1]].to_pybytes() if offsets[-1] > offsets[0] else b""
            blobs = (ends, np.diff(offsets).astype("<i4").tobytes(), values.astype("<f8").tobytes(), known.tobytes())
            yield pa.record_batch([pa.array([x], pa.binary()) for x in blobs], names=list(_PACKED))


def weighted_sums(rows: DataFrame, values: list[str], replicates: int, seed: int, key: str) -> DataFrame:
    """``rep, w`` and the sum of each of ``values`` under the Poisson weights of ``inference.poisson_weight``.

    A task takes its units through all replicates; what is shuffled is a row per replicate and task.
    """
    from loomstat.operators.inference import poisson_steps

    steps, names = np.array(poisson_steps(), np.uint32), [b"%d|%d" % (seed, rep) for rep in range(replicates)]
    ending = F.coalesce(F.concat(F.lit("|"), F.col(key).cast("string")), F.lit("")).cast("binary")  # as concat_ws leaves out nulls
    dealt = rows.select(ending.alias("_end"), *(F.col(v).cast("double").alias(v) for v in values)).repartition(parts_of(rows), "_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_rows = np.zeros((replicates, len(values) + 1)), False

        def add(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            texts = table["_end"].combine_chunks()
            for start in range(0, len(texts), TURN):
                ends = Endings(texts.slice(start, TURN))
                x = np.column_stack([np.ones(ends.n), *(table[v].slice(start, TURN).to_numpy() for v in values)])
                finite = np.isfinite(x).all()  # an infinite value counts only where it is drawn
                for turn in turns(names, ends.n):
                    u = ends.after([names[k] for k in turn])
                    w = np.zeros(u.shape, np.uint8)
                    for step in steps:
                        w += u >= step
                    sums[turn] += w.astype(float) @ x if finite else np.array([w[k, w[k] > 0] @ x[w[k] > 0] for k in range(len(turn))])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n, any_rows = n + batch.num_rows, True
            if n >= TURN:
                add(held)
                held, n = [], 0
        if held:
            add(held)
        if any_rows:
            yield pa.record_batch([pa.array(np.arange(replicates), pa.int32()), *map(pa.array, sums.T)], names=["rep", "w", *values])

    parts = dealt.mapInArrow(run, "rep int, w double, " + ", ".join(f"`{v}` double" for v in values))
    return parts.groupBy("rep").agg(*(F.sum(c).alias(c) for c in ("w", *values))).where("w > 0")
