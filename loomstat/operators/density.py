"""Density clusters of vectors by a hierarchy of mutual reachability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block: a task holds the distances between all vectors of two at a time.
BLOCK = 1500
#: Vectors of a panel, about, of which a task gets two; and panels at least, where there are blocks enough.
PANEL, PANELS = 12_000, 8


def _distances(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    d = x @ z.T
    d *= -2
    d += (x * x).sum(1)[:, None]
    d += (z * z).sum(1)
    return np.sqrt(np.maximum(d, 0, out=d), out=d)


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` least numbers of each row, or all of them if fewer."""
    return np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d


def _tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning tree under mutual reachability (Prim): lengths and both ends of its edges."""
    n = len(x)
    d = _distances(x, x)
    np.maximum(d, core, out=d)
    np.maximum(d, core[:, None], out=d)
    reach, by = d[0].copy(), np.zeros(n, np.int64)
    left, at = np.arange(n), 0
    lengths, one, two = np.empty(n - 1), np.empty(n - 1, np.int64), np.empty(n - 1, np.int64)
    for k in range(n - 1):
        # Vectors out of the tree stay in the first places.
        last = n - k - 1
        left[at], reach[at], by[at] = left[last], reach[last], by[last]
        if k:
            row = d[two[k - 1]][left[:last]]
            closer = row < reach[:last]
            reach[:last][closer] = row[closer]
            by[:last][closer] = two[k - 1]
        at = int(reach[:last].argmin())
        lengths[k], one[k], two[k] = reach[at], by[at], left[at]
    return lengths, one, two


def _forest(lengths: np.ndarray, one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges of a minimum spanning forest of ``n`` vectors, by rising length (Boruvka)."""
    low, high = np.minimum(one, two), np.maximum(one, two)
    order = np.lexsort((high, low, lengths))
    one, two = low[order], high[order]
    part, kept, alive = np.arange(n), [], np.arange(len(order))
    while True:
        a, b = part[one[alive]], part[two[alive]]
        open_ = a != b
        alive, a, b = alive[open_], a[open_], b[open_]
        if not len(alive):
            break
        best = np.full(n, -1)
        best[a[::-1]] = alive[::-1]
        other = np.full(n, -1)
        other[b[::-1]] = alive[::-1]
        # Edges stand in order, so the smaller place is the shorter one.
        best = np.where((best < 0) | ((other >= 0) & (other < best)), other, best)
        roots = np.flatnonzero(best >= 0)
        chosen = best[roots]
        kept.append(np.unique(chosen))
        ends_a, ends_b = part[one[chosen]], part[two[chosen]]
        to = np.arange(n)
        to[roots] = np.where(ends_a == roots, ends_b, ends_a)
        both = (to[to] == np.arange(n)) & (np.arange(n) < to)  # two parts that chose one edge
        to[both] = np.flatnonzero(both)
        while (to[to] != to).any():
            to = to[to]
        part = to[part]
    return order[np.sort(np.concatenate(kept))] if kept else np.zeros(0, np.int64)


def _flat(n: int, edges: list[tuple[float, int, int]], least: int) -> np.ndarray:
    """Labels from the most stable clusters of the condensed hierarchy; -1 is noise."""
    parent = list(range(n))
    node_of, children, height, size = list(range(n)), {}, {}, dict.fromkeys(range(n), 1)
    leaves = {k: [k] for k in range(n)}

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    fresh = n
    for length, a, b in edges:
        a, b = find(a), find(b)
        children[fresh], height[fresh] = (node_of[a], node_of[b]), length
        size[fresh] = size[node_of[a]] + size[node_of[b]]
        if size[node_of[a]] < size[node_of[b]]:
            a, b = b, a
        parent[b] = a
        node_of[a] = fresh
        fresh += 1
    labels = np.full(n, -1)
    if n < max(2, least):
        return labels

    def points(node):
        stack, found = [node], []
        while stack:
            k = stack.pop()
            if k in children:
                stack += children[k]
            else:
                found += leaves[k]
        return found

    # A cluster runs from its birth down to a split into two that are both large enough.
    chosen: dict[int, float] = {}

    def walk(top):
        order, stack = [], [(top, 0.0)]
        while stack:
            node, birth = stack.pop()
            now, stability = node, 0.0
            while now in children:
                left, right = children[now]
                density = 1 / max(height[now], 1e-12)
                large = [c for c in (left, right) if size[c] >= least]
                if len(large) == 2:
                    stability += (density - birth) * size[now]
                    order.append((node, stability, (left, right)))
                    stack += [(left, density), (right, density)]
                    break
                if not large:
                    stability += (density - birth) * size[now]
                    order.append((node, stability, ()))
                    break
                stability += (density - birth) * (size[now] - size[large[0]])
                now = large[0]
            else:
                order.append((node, stability, ()))
        best: dict[int, tuple[float, list[int]]] = {}
        for node, stability, below in reversed(order):
            under = sum(best[c][0] for c in below)
            if below and (node == top or under > stability):
                best[node] = (under, [x for c in below for x in best[c][1]])
            else:
                best[node] = (stability, [node])
        return best[top][1]

    for label, node in enumerate(sorted(walk(fresh - 1))):
        chosen[node] = label
        labels[points(node)] = label
    return labels


def _matrix(values: pa.ChunkedArray) -> np.ndarray:
    if len(set(values.combine_chunks().value_lengths().to_pylist())) > 1:
        raise ValueError("vectors of different lengths")
    return values.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _pairs(numbered: DataFrame, panels: int, work, columns: list[str], schema: str) -> DataFrame:
    """``work`` on the rows of every two panels, and of every single one if there is but one: a table and the
    pairs of blocks to compare, as places in it. All pairs of blocks of all panels occur once or more."""
    block = BLOCK
    tasks = [(i, j) for i in range(panels) for j in range(i, panels)]
    of = F.array(*(F.array(*(F.lit(t) for t, pair in enumerate(tasks) if p in pair)) for p in range(panels)))
    dealt = numbered.withColumn("task", F.explode(F.element_at(of, F.col("panel") + 1))).repartitionById(len(tasks), "task").select("task", "panel", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            table = pa.Table.from_batches(held).sort_by([("panel", "ascending"), ("id", "ascending")])
            i, j = tasks[table["task"][0].as_py()]
            panel = table["panel"].to_numpy()
            parts = {p: [np.arange(s, min(s + block, stop)) for s in range(start, stop, block)] for p, start, stop in ((p, *np.searchsorted(panel, [p, p + 1]).tolist()) for p in {i, j})}
            yield from work(table, [(a, b) for k, a in enumerate(parts[i]) for b in (parts[j][k:] if i == j else parts[j])])

    return dealt.mapInArrow(run, schema)


def density_clusters(vectors: DataFrame, min_cluster: int = 15, min_samples: int = 5, key: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``key, segment`` (-1: noise). Null vectors are left out.

    Vectors are dealt into panels, and a task compares two, block by block: once for the distances to the
    nearest vectors, once for minimum spanning trees of every two blocks, which together hold one of all
    vectors, whatever ties there are. One task joins the trees and reads the clusters off, from edges alone.
    """
    rows = vectors.where(F.col(vector_col).isNotNull()).select(key, F.col(vector_col).cast("array<double>").alias("v"))
    n = rows.count()
    if not n:
        return rows.select(key, F.lit(-1).alias("segment"))
    panels = max(-(-n // PANEL), min(PANELS, -(-n // BLOCK)))
    rows = rows.withColumn("panel", F.pmod(F.xxhash64(F.col(key), "v"), F.lit(panels)).cast("int"))
    sizes = {r["panel"]: r["count"] for r in rows.groupBy("panel").count().collect()}  # a row per panel
    starts = F.array(*(F.lit(sum(sizes.get(q, 0) for q in range(p))).cast("long") for p in range(panels)))
    # A panel is a partition, in order, so that a row's number is the same whenever it is asked for.
    numbered = rows.repartitionById(panels, "panel").sortWithinPartitions("panel", key, "v").withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    numbered = numbered.select(key, "v", "panel", (F.element_at(starts, F.col("panel") + 1) + F.col("_at")).alias("id"))
    rank = min(min_samples, n - 1)

    def nearest(table: pa.Table, pairs: list) -> Iterator[pa.RecordBatch]:
        x, ids = _matrix(table["v"]), table["id"].to_numpy()
        found: dict[int, np.ndarray] = {}
        starts = {int(p[0]): p for pair in pairs for p in pair}
        for a, b in pairs:
            d = _distances(x[a], x[b])
            for at, near in ((a, d), (b, d.T))[: 1 + (a[0] != b[0])]:
                near = _least(near, rank + 1)
                s = int(at[0])
                found[s] = _least(np.hstack([found[s], near]), rank + 1) if s in found else near
        for s, near in found.items():
            yield pa.record_batch([pa.array(ids[starts[s]]), pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), near.shape[1]).cast(pa.list_(pa.float64()))], names=["id", "near"])

    def trees(table: pa.Table, pairs: list) -> Iterator[pa.RecordBatch]:
        x, core, ids = _matrix(table["v"]), table["core"].to_numpy(), table["id"].to_numpy()
        lengths, one, two = (np.zeros(0, kind) for kind in (float, np.int64, np.int64))
        held = []
        for k, (a, b) in enumerate(pairs):
            at = a if a[0] == b[0] else np.concatenate([a, b])
            length, p, q = _tree(x[at], core[at])
            held.append((length, at[p], at[q]))
            if len(held) == 16 or k == len(pairs) - 1:
                lengths, one, two = (np.concatenate(c) for c in zip((lengths, one, two), *held, strict=True))
                kept = _forest(lengths, one, two, len(ids))
                lengths, one, two, held = lengths[kept], one[kept], two[kept], []
        yield pa.record_batch([pa.array(lengths), pa.array(ids[one]), pa.array(ids[two])], names=["length", "one", "two"])

    near = _pairs(numbered, panels, nearest, ["id", "v"], "id long, near array<double>")
    cores = near.groupBy("id").agg(F.element_at(F.array_sort(F.flatten(F.collect_list("near"))), rank + 1).alias("core"))
    edges = _pairs(numbered.join(cores.hint("merge"), "id"), panels, trees, ["id", "v", "core"], "length double, one long, two long")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            length, one, two = (table[c].to_numpy() for c in ("length", "one", "two"))
            kept = _forest(length, one, two, n)
            labels = _flat(n, list(zip(length[kept].tolist(), one[kept].tolist(), two[kept].tolist(), strict=True)), min_cluster)
            yield pa.record_batch([pa.array(np.arange(n)), pa.array(labels.astype(np.int32))], names=["id", "segment"])

    labels = edges.repartition(1).mapInArrow(label, "id long, segment int")
    return numbered.select("id", key).join(labels.hint("merge"), "id", "left").select(key, F.coalesce("segment", F.lit(-1)).alias("segment"))
