"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the popcounts of 32 segments of two bits. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints, so it is
a lower bound. If it is at most 3, one half of the vector (16 segments) is at most 1 away:
either equal, or one of its counts is larger by one. A grid whose cells are the half vectors
therefore finds all pairs when each fingerprint enters its own cell and asks in its own cell
and in the 16 cells one step up. Every candidate is verified on the bits.

Cells that many fingerprints share are not paired up natively: their members are dealt into
blocks, and each pair of blocks returns a spanning forest of its verified links, which keeps
the components whole with fewer edges than members.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm._common import checkpointed, small_batches, sorted_join, stored, table
from loomstat.llm.components import components

SEED = 42
MAX_BITS = 3
#: Own members of a cell up to which its pairs are made by the join.
COLD = 16
#: Members of one block of a hot cell.
BLOCK = 4096

_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_WEIGHTS = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Unsigned XXH64 of every shingle of the lower-cased text, repeats included."""
    parts = text.encode("utf-8").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Majority vote of each bit; no hashes: zero. Returned as a signed 64-bit number."""
    n = len(hashes)
    if not n:
        return 0
    octets = hashes.view(np.uint8).reshape(n, 8)
    votes = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(_WEIGHTS[votes * 2 > n].sum(dtype=np.uint64).astype(np.int64))


#: Partial fingerprints of a level, and distinct shingles that one covers, about.
PARTIAL, COVER = 24, 4
#: Bits within which fingerprints of similar texts lie: at a Jaccard index of 0.8, ten on average.
WIDE_BITS = 20


def partial_keys(hashes: np.ndarray) -> list[int]:
    """Hashes of partial fingerprints: shingles are dealt by their hashes, and each part that has
    some becomes its SimHash. Similar texts leave some parts untouched. The number of parts
    follows the text, a power of two, and the next smaller one is used too, so that texts of
    similar length have one in common; of many parts the first PARTIAL are taken."""
    distinct = np.unique(hashes)
    out = []
    parts = 1 << max(0, (len(distinct) // COVER).bit_length() - 1)
    for level in {parts, max(1, parts // 2)} if len(distinct) else ():
        where = distinct >> np.uint64(64 - level.bit_length() + 1) if level > 1 else np.zeros(len(distinct), np.uint64)
        few = distinct[where < PARTIAL]
        edges = np.searchsorted(where, np.arange(min(level, PARTIAL) + 1))
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a < b:
                key = xxhash.xxh64_intdigest(b"%d %d %d %d" % (level, k, b - a, fingerprint(few[a:b])))
                out.append(signed(key))
    return out


#: Fewest and most segments of the counts that stand for a set of shingles; a count ends at 255.
SEGMENTS, SEGMENTS_MOST = 128, 8192
#: Most segments of the shorter vector that a set takes into large groups.
COARSE_MOST = 1024
#: Members of one block of a shingle that many sets share.
SET_BLOCK = 1024
#: One text in this many, chosen by its hash, tells which shingles are frequent: those in FREQUENT
#: or more of these texts, the commonest FREQUENT_MOST. That only orders shingles within a text.
SAMPLE, FREQUENT, FREQUENT_MOST = 64, 4, 200_000


def signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def digest(distinct: np.ndarray) -> int:
    """Hash of a sorted array of distinct shingle hashes, signed."""
    return signed(xxhash.xxh64_intdigest(distinct.tobytes()))


def segments(size: int) -> int:
    """Segments for a set of so many shingles, a power of two: four to eight shingles in each."""
    return min(SEGMENTS_MOST, max(SEGMENTS, 1 << (size // 8).bit_length()))


def segment_counts(distinct: np.ndarray) -> bytes:
    """Shingles in each segment of the hashes. The Manhattan distance of two such vectors, the longer
    one folded, is a lower bound of the number of shingles that only one of the sets has."""
    n = segments(len(distinct))
    return np.minimum(np.bincount((distinct % np.uint64(n)).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def coarse_counts(counts: bytes) -> bytes:
    """The counts folded to COARSE_MOST segments at most, which bounds as well, if less closely."""
    if len(counts) <= COARSE_MOST:
        return counts
    return np.minimum(folded(np.frombuffer(counts, np.uint8), COARSE_MOST), 255).astype(np.uint8).tobytes()


def folded(counts: np.ndarray, n: int) -> np.ndarray:
    """Counts of a finer division, along the last axis, as those of ``n`` segments."""
    return counts.reshape(*counts.shape[:-1], -1, n).sum(axis=-2, dtype=np.int32)


def apart(a: bytes, b: bytes) -> int:
    """Manhattan distance of two vectors of counts."""
    n = min(len(a), len(b))
    one, two = (folded(np.frombuffer(x, np.uint8), n) for x in (a, b))
    return int(np.abs(one - two).sum())


def most_apart(sizes, similarity: float):
    """Most shingles that only one of two sets has, given the sum of their sizes."""
    return sizes * ((1 - similarity) / (1 + similarity)) + 1e-9


def prefix(distinct: np.ndarray, similarity: float, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order (frequent, hash), as many as make any two sets at
    the Jaccard index ``similarity`` have one in common. Every order does; this one keeps groups small."""
    n = len(distinct)
    if not n:
        return distinct
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, distinct), len(frequent) - 1)
        common = frequent[at] == distinct
        distinct = np.concatenate([distinct[~common], distinct[common]])
    return distinct[: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, partial: bool = False) -> DataFrame:
    """``doc_id, fp`` of every row; fp is the fingerprint as a signed long. With ``partial`` also the
    array ``keys`` of partial_keys, and ``digest, size, counts, coarse`` of the set of shingles.

    A null or wordless text has fingerprint 0. Ids are passed through, null ids included;
    other columns of ``docs`` are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            hashes = [shingle_hashes(t or "", words) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(map(fingerprint, hashes), pa.int64())]
            if partial:
                columns.append(pa.array(map(partial_keys, hashes), pa.list_(pa.int64())))
                sets = [np.unique(x) for x in hashes]
                columns += [pa.array(map(digest, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(counts := list(map(segment_counts, sets)), pa.binary()), pa.array(map(coarse_counts, counts), pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "fp", "keys", "digest", "size", "counts", "coarse"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long" + ", keys array<long>, digest long, size long, counts binary, coarse binary" * partial)


def _grid(fps: DataFrame) -> DataFrame:
    """``cell, fp, own``: a row for the own cell of each half, and one for each cell one step up."""
    pop = "(x - (shiftrightunsigned(x, 1) & 1431655765))"  # popcounts of 16 two-bit segments
    return (
        fps.selectExpr("fp", "inline(array(struct(0L AS half, fp & 4294967295 AS x), struct(4294967296L AS half, shiftrightunsigned(fp, 32) AS x)))")
        .selectExpr("fp", "half", f"{pop} AS pop")
        .selectExpr(
            "fp",
            "explode(concat(array(struct(half + pop AS cell, true AS own)),"
            " transform(filter(sequence(0, 15), s -> (shiftright(pop, 2 * s) & 3) < 2),"
            " s -> struct(half + pop + shiftleft(1L, 2 * s) AS cell, false AS own)))) AS at",
        )
        .selectExpr("at.cell", "fp", "at.own")
    )


def _manhattan(a: str, b: str) -> str:
    """Manhattan distance of the popcounts of eight-bit segments."""
    return " + ".join(f"abs(bit_count({a} & {255 << s}L) - bit_count({b} & {255 << s}L))" for s in range(0, 56, 8)) + f" + abs(bit_count(shiftrightunsigned({a}, 56)) - bit_count(shiftrightunsigned({b}, 56)))"


def spanning_links(values: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links values at ``max_bits`` or fewer bits."""
    left = np.unique(values).view(np.uint64)
    edges: list[tuple[int, int]] = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            if near.any():
                found, left = left[near], left[~near]
                queue.extend(found)
                edges += [(int(at.astype(np.int64)), int(x)) for x in found.view(np.int64)]
    return edges


def links(fps: DataFrame, max_bits: int = MAX_BITS, nodes: int | None = None) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``) with the same components as
    the graph of all pairs at ``max_bits`` (at most 3) or fewer differing bits. ``nodes``, a bound of their
    number if known, only sets the files of a stored table."""
    if max_bits > MAX_BITS:
        raise ValueError(f"at most {MAX_BITS} bits")
    grid = _grid(fps)
    own = grid.where("own").select("cell", "fp")
    sizes = own.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cold = sorted_join(own, sizes.where(f"n <= {COLD}").select("cell"), "cell").select("cell", F.col("fp").alias("b"))
    bound = F.expr(f"({_manhattan('a', 'b')}) <= {max_bits}")
    exact = F.expr(f"bit_count(a ^ b) <= {max_bits}")
    asks = grid.select("cell", F.col("fp").alias("a"), "own")
    near = sorted_join(asks, cold, [asks["cell"] == cold["cell"], F.expr("IF(own, a < b, a <> b)"), bound, exact]).select("a", "b")
    hot = stored(sizes.where(f"n > {COLD}").select("cell"), "simhash-hot", rows=nodes)
    crowd = grid.join(hot, "cell").select("cell", "fp")
    blocks = crowd.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("parts"))
    dealt = (
        crowd.join(blocks, "cell")
        .withColumn("k", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .selectExpr("cell", "fp", "explode(transform(sequence(0, parts - 1), j -> struct(least(j, k) AS i, greatest(j, k) AS j))) AS at")
        .selectExpr("cell", "fp", "at.i", "at.j")
    )

    def forest(group: pa.Table) -> pa.Table:
        edges = spanning_links(group.column("fp").to_numpy(), max_bits)
        return pa.table([pa.array([x[k] for x in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return near.union(dealt.groupBy("cell", "i", "j").applyInArrow(forest, "a long, b long"))


def similar_links(docs: DataFrame, nodes: DataFrame, words: int, similarity: float, id_col: str = "doc_id", text_col: str = "text", n_nodes: int | None = None) -> DataFrame:
    """Edges ``a, b`` between fingerprints of texts whose shingle sets have at least this Jaccard
    index, among ``nodes`` (``fp, first_id, keys``).

    Texts that share a partial fingerprint are compared with the smallest and the largest
    fingerprint that has it, so candidates are linear in the keys; those within WIDE_BITS are
    verified on their whole texts. Nodes without an id are left out.
    """
    small_batches(docs.sparkSession)
    keyed = nodes.where("first_id IS NOT NULL").select("fp", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    near = sorted_join(keyed, ends, "key").select("fp", F.explode(F.array("low", "high")).alias("to"))
    pairs = near.where(f"bit_count(fp ^ `to`) BETWEEN {MAX_BITS + 1} AND {WIDE_BITS}").select(F.least("fp", "to").alias("a"), F.greatest("fp", "to").alias("b")).distinct()
    pairs = stored(pairs, "simhash-pairs", rows=n_nodes)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(nodes.select("fp", "first_id"), "fp")
    texts = stored(docs.select(F.col(id_col).alias("first_id"), F.col(text_col).alias("text")).join(ends, "first_id").groupBy("fp").agg(F.max("text").alias("text")), "simhash-texts", rows=2 * pairs.count())
    side = lambda c: texts.select(F.col("fp").alias(c), F.col("text").alias(f"text_{c}"))

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both, either = _jaccard(*(np.unique(shingle_hashes(t, words)) for t in (x, y)))
                keep.append(both >= similarity * either - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sorted_join(sorted_join(pairs, side("a"), "a"), side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def _jaccard(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted arrays of distinct values."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both, len(x) + len(y) - both


def frequent_shingles(docs: DataFrame, words: int, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of frequent shingles, at most FREQUENT_MOST of them (1.6 MB)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            hashes = [np.unique(shingle_hashes(t, words)) for t in batch.column(0).to_pylist()]
            if hashes:
                yield pa.record_batch([pa.array(np.concatenate(hashes).view(np.int64))], names=["shingle"])

    text = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    some = text.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).dropDuplicates(["text"])
    counts = some.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {FREQUENT}")
    top = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT_MOST)
    return np.sort(np.array([x.shingle for x in top.select("shingle").toLocalIterator()], np.int64).view(np.uint64))


def close_sets(group: pa.Table, similarity: float) -> pa.Table:
    """Pairs ``a, b`` of digests in ``group`` (``digest, component, size, coarse``), of different
    components, whose sizes and coarse counts allow the Jaccard index ``similarity``."""
    ids, first = np.unique(group.column("digest").to_numpy(), return_index=True)
    sizes = group.column("size").to_numpy()[first]
    order = np.argsort(sizes, kind="stable")
    ids, sizes, first = ids[order], sizes[order], first[order]
    parts = group.column("component").to_numpy()[first]
    counts = group.column("coarse").to_pylist()
    lengths = np.array([len(counts[k]) for k in first])
    ends = np.searchsorted(sizes, sizes / similarity + 1e-9, "right")
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in np.unique(lengths):  # sizes ascend, and so do lengths; partners are of this length or longer
        start, stop = np.searchsorted(lengths, [n, n + 1])
        last = ends[start:stop].max()
        table = np.stack([folded(np.frombuffer(counts[k], np.uint8), n) for k in first[start:last]]).astype(np.int16)
        for k in range(start, stop):
            after = slice(k + 1, ends[k])
            distance = np.abs(table[k + 1 - start : ends[k] - start] - table[k - start]).sum(axis=1, dtype=np.int64)
            near = (distance <= most_apart(sizes[after] + sizes[k], similarity)) & (parts[after] != parts[k])
            right.append(ids[after][near])
            left.append(np.full(len(right[-1]), ids[k]))
    return pa.table([np.concatenate(x) for x in (left, right)], names=["a", "b"])


def missed_links(docs: DataFrame, sets: DataFrame, words: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edges ``a, b`` between components of ``sets`` (``digest, component, size, counts, coarse, first_id``,
    one row for each digest) for all pairs of texts of different components that have at least this
    Jaccard index: none is missed.

    Two such sets have a shingle of their prefixes in common. Only shingles that components share
    are looked at, and groups of copies are one component by now, so they do not come up; of
    shingles with the same members, as those of a shared passage, one is. The members of a large
    group are dealt into blocks, with coarse counts of a bounded size. Sizes and segment counts bound
    the index from above, the counts joined once for each candidate pair; what they let pass is
    verified on whole texts.
    """
    spark = docs.sparkSession
    frequent = frequent_shingles(docs, words, text_col)
    small_batches(spark)
    text = docs.select(F.col(id_col).alias("first_id"), F.col(text_col).cast("string").alias("text"))

    def prefixes(batches):
        for batch in batches:
            found = [np.unique(shingle_hashes(t or "", words)) for t in batch.column(0).to_pylist()]
            shingles = [prefix(x, similarity, frequent).view(np.int64) for x in found]
            yield pa.record_batch([pa.array(map(digest, found), pa.int64()), pa.array(shingles, pa.list_(pa.int64()))], names=["digest", "shingles"])

    n_sets = sets.count()
    firsts = text.select("text").mapInArrow(prefixes, "digest long, shingles array<long>").dropDuplicates(["digest"])
    firsts = stored(firsts, "simhash-prefixes", rows=n_sets)
    names = sets.select("digest", "component")
    keyed = sorted_join(firsts, names, "digest").select("digest", "component", F.explode("shingles").alias("key"))
    of = [F.bit_xor(F.xxhash64("digest", F.lit(salt))).alias(f"of_{salt}") for salt in (1, 2)]
    groups = keyed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"), *of).where("low < high")
    shared = stored(groups.groupBy("n", "of_1", "of_2").agg(F.min("key").alias("key")).select("key", "n"), "simhash-shared", rows=n_sets)
    rows = sorted_join(firsts.select("digest", F.explode("shingles").alias("key")), shared, "key")
    rows = stored(rows, "simhash-members", rows=4 * n_sets)
    members = rows.withColumn("parts", F.ceil(F.col("n") / F.lit(SET_BLOCK)).cast("int"))
    cold = members.where(f"n <= {COLD}").join(sets.select("digest", "component", "size"), "digest").select("key", "digest", "component", "size")
    one, two = (cold.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("digest", "component", "size"))) for side in "ab")
    few = one.join(two, "key").where(f"digest_a < digest_b AND component_a <> component_b AND least(size_a, size_b) >= {similarity} * greatest(size_a, size_b) - 1e-9")
    dealt = (
        sorted_join(members.where(f"n > {COLD}"), sets.select("digest", "component", "size", "coarse"), "digest")
        .withColumn("k", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
        .selectExpr("key", "digest", "component", "size", "coarse", "explode(transform(sequence(0, parts - 1), j -> struct(least(j, k) AS i, greatest(j, k) AS j))) AS at")
        .selectExpr("key", "at.i", "at.j", "digest", "component", "size", "coarse")
    )
    many = dealt.groupBy("key", "i", "j").applyInArrow(lambda group: close_sets(group, similarity), "a long, b long")
    pairs = few.select(F.col("digest_a").alias("a"), F.col("digest_b").alias("b")).union(many.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()

    def bounded(batches):
        for batch in batches:
            near = [apart(a, b) <= most_apart(n, similarity) for n, a, b in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    side = lambda c: sets.select(F.col("digest").alias(c), F.col("size").alias(f"size_{c}"), F.col("counts").alias(f"counts_{c}"))
    known = sorted_join(sorted_join(pairs, side("a"), "a"), side("b"), "b").select("a", "b", (F.col("size_a") + F.col("size_b")).alias("sizes"), "counts_a", "counts_b")
    pairs = stored(known.mapInArrow(bounded, "a long, b long"), "simhash-near", rows=n_sets)

    def digests(batches):
        for batch in batches:
            texts = batch.column(0)
            found = [digest(np.unique(shingle_hashes(t or "", words))) for t in texts.to_pylist()]
            yield pa.record_batch([pa.array(found, pa.int64()), texts], names=["digest", "text"])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct().join(sets.select("digest", "first_id", "component"), "digest")
    n_pairs = pairs.count()
    ends = stored(ends, "simhash-ends", rows=2 * n_pairs)
    known = text.join(ends.select("first_id").where("first_id IS NOT NULL").distinct(), "first_id", "left_semi")
    some = known.union(text.where("first_id IS NULL")).select("text").mapInArrow(digests, "digest long, text string")
    texts = stored(some.groupBy("digest").agg(F.max("text").alias("text")).join(ends.select("digest", "component"), "digest"), "simhash-texts", rows=2 * n_pairs)

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both, either = _jaccard(*(np.unique(shingle_hashes(t or "", words)) for t in (x, y)))
                keep.append(both >= similarity * either - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: texts.select(F.col("digest").alias(c), F.col("component").alias(f"component_{c}"), F.col("text").alias(f"text_{c}"))
    both = sorted_join(sorted_join(pairs, side("a"), "a"), side("b"), "b")
    return both.select(F.col("component_a").alias("a"), F.col("component_b").alias("b"), "text_a", "text_b").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = MAX_BITS, similarity: float | None = None) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``.

    Documents link where their fingerprints differ in at most ``max_bits`` bits; component_id
    is the smallest id reachable, the own included. Equal fingerprints, that of empty texts
    among them, are one node, so groups of copies are never paired. Repeated rows keep their
    rows; a null id gets a row and is never the smallest (null only if its component has no
    other id). An empty table gives an empty result. With ``similarity``, all texts whose shingle
    sets have at least this Jaccard index link too: partial fingerprints link most of them, and
    missed_links the rest.
    """
    partial = similarity is not None
    rows = stored(fingerprints(docs, id_col, text_col, words, partial), "simhash")
    n = rows.count()
    keys = [F.min_by("keys", "doc_id").alias("keys")] if partial else []
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), *keys), n)
    edges = links(nodes.select("fp"), max_bits, n)
    if partial:
        narrow = F.min("fp").alias("fp"), F.max("fp").alias("last_fp"), F.min("doc_id").alias("first_id"), F.first("size").alias("size"), F.first("counts").alias("counts"), F.first("coarse").alias("coarse")
        sets = stored(rows.groupBy("digest").agg(*narrow), "simhash-sets", rows=n)
        # Equal sets whose repeats differ have fingerprints of their own: all of them link to the first.
        same = rows.join(sets.where("fp <> last_fp").select("digest", F.col("fp").alias("a")), "digest").select("a", F.col("fp").alias("b")).where("a <> b")
        edges = edges.union(similar_links(docs, nodes, words, similarity, id_col, text_col, n)).union(same)
    parts = components(edges, nodes=n).withColumnRenamed("node", "fp")
    named = nodes.join(parts, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    if partial:
        named = stored(named, "simhash-named", rows=n)
        sets = stored(sorted_join(sets, named.select("fp", "component"), "fp").select("digest", "component", "size", "counts", "coarse", "first_id"), "simhash-sets", rows=n)
        more = components(missed_links(docs, sets, words, similarity, id_col, text_col), nodes=n).select(F.col("node").alias("component"), F.col("component").alias("lower"))
        named = named.join(more, "component", "left").select("fp", "first_id", F.coalesce("lower", "component").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return rows.join(named.join(lowest, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: fingerprints of all documents over three-word shingles, and their components."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
