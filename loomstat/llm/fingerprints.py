"""Document fingerprints: invertible Bloom lookup sketches of a text's passages.

A text is cut into passages at line breaks and sentence ends. Each distinct passage's 64-bit
digest enters one cell in each of three parts of a sketch; a cell keeps how many digests it got,
their exclusive or, and that of 32-bit checks. Two sketches subtract cell by cell, which leaves
only passages that one version has and the other has not. A cell left with one of them gives
its digest away, which is taken out of its other cells, and so on (peeling).

A sketch of a fixed size, the fingerprint, decodes a few differences. Where peeling fails, it
is tried again larger: the digests of both versions, signed by their side, are dealt over as many
sketches as the counts of the failed difference suggest, and those that fail again are split in
four. What MAX_LEVEL could not decode, which needs colliding hashes, is compared directly, so
likeness is always exact on digests.

Everything runs as SQL expressions on arrays within a row.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstat.llm._common import table

PARTS, SIDE = 3, 4
CELLS = PARTS * SIDE
#: Differences of one sketch that a larger try aims at.
LOAD = 4
MAX_LEVEL = 12
#: Rounds of peeling, after which a larger try is due.
ROUNDS = 5
#: Ranges of ids that documents are sorted in: so many for each shuffle partition, at most MAX_RANGES,
#: cut at quantiles of a sample of so many keys for each range.
RANGES, MAX_RANGES, KEYS = 4, 16_384, 32
_BITS = "array(" + ", ".join(str(1 << j) for j in range(CELLS)) + ")"
#: The cells of a digest, one in each part, as a bit mask by six bits of its hash.
_MASKS = "array(" + ", ".join(str(sum(1 << (SIDE * part + at) for part, at in enumerate(places))) for places in product(range(SIDE), repeat=PARTS)) + ")"
_NONE = "CAST(array() AS array<bigint>)"


def digests(text: str) -> str:
    """SQL for the distinct digests of the passages of a text column or expression."""
    return f"array_distinct(transform(filter(split({text}, '(?<=[.!?|])\\\\s+|\\\\n'), p -> p RLIKE '\\\\S'), p -> xxhash64(p)))"


def _mask(key: str, level: str) -> str:
    return f"element_at({_MASKS}, CAST((xxhash64({key}, {level}) & {SIDE**PARTS - 1}) + 1 AS INT))"


def _check(key: str, level: str) -> str:
    return f"shiftrightunsigned(xxhash64({key}, {level}), 32)"


def sketch(items: str, level: str = "0", sign: str = "1") -> str:
    """SQL for the cells ``b, c, k, x`` (the cell's bit, count, digests, checks) of an array of
    digests, or of structs ``d, c`` with the sign as ``e.c``."""
    d = "e" if sign == "1" else "e.d"
    hashed = f"transform({items}, e -> struct({d} AS d, {sign} AS c, {_mask(d, level)} AS m, {_check(d, level)} AS x))"
    add = "IF((e.m & s.b) = 0, s, named_struct('b', s.b, 'c', s.c + e.c, 'k', s.k ^ e.d, 'x', s.x ^ e.x))"
    return f"transform(array({hashed}), hs -> transform({_BITS}, b -> aggregate(hs, named_struct('b', b, 'c', 0, 'k', 0L, 'x', 0L), (s, e) -> {add})))[0]"


def subtract(one: str, other: str) -> str:
    return f"zip_with({one}, {other}, (p, q) -> named_struct('b', p.b, 'c', p.c - q.c, 'k', p.k ^ q.k, 'x', p.x ^ q.x))"


def peel(cells: str, level: str = "0") -> str:
    """SQL for ``ok, a, b``: whether all was decoded, and the digests that only the first and only the
    second version has."""
    pure = f"array_distinct(transform(filter(s.cells, e -> (e.c = 1 OR e.c = -1) AND e.x = {_check('e.k', level)}), e -> named_struct('k', e.k, 'c', e.c, 'x', e.x, 'm', {_mask('e.k', level)})))"
    taken = "transform(s.cells, e -> aggregate(pure, e, (z, p) -> IF((p.m & z.b) = 0, z, named_struct('b', z.b, 'c', z.c - p.c, 'k', z.k ^ p.k, 'x', z.x ^ p.x))))"
    side = lambda n: f"transform(filter(pure, p -> p.c = {n}), p -> p.k)"
    step = f"transform(array({pure}), pure -> IF(size(pure) = 0, s, named_struct('cells', {taken}, 'a', concat(s.a, {side(1)}), 'b', concat(s.b, {side(-1)}))))[0]"
    done = f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'a', {_NONE}, 'b', {_NONE}), (s, t) -> {step})"
    return f"transform(array({done}), s -> named_struct('ok', forall(s.cells, e -> e.c = 0 AND e.k = 0 AND e.x = 0), 'a', s.a, 'b', s.b))[0]"


def _dealt(items: str, parts: str, of: str) -> str:
    """SQL for an array of arrays: structs dealt by ``of``, a number below ``parts``."""
    return f"filter(transform(sequence(0, {parts} - 1), q -> filter({items}, e -> {of} = q)), t -> size(t) > 0)"


def difference(a: str, b: str, base_a: str, base_b: str) -> str:
    """SQL for ``a, b``: the digests that only array ``a`` or only array ``b`` holds.

    ``base_a`` and ``base_b`` are their sketches of level 0.
    """
    signed = f"concat(transform({a}, d -> struct(d AS d, 1 AS c, xxhash64(d, 11) AS g)), transform({b}, d -> struct(d AS d, -1 AS c, xxhash64(d, 11) AS g)))"
    # The square of a cell's count grows with the differences in it.
    guess = f"least(size({a}) + size({b}), greatest(abs(size({a}) - size({b})), CAST(aggregate(zero, 0, (z, e) -> z + e.c * e.c) DIV {PARTS} AS INT)))"
    # Dealt twice by about the square root, so that the work follows the digests.
    wide = f"greatest(1, CAST(ceil(sqrt(guess / {float(LOAD)}D)) AS INT))"
    start = f"transform(array({wide}), w -> flatten(transform({_dealt(signed, 'w', 'pmod(e.g, w)')}, t -> {_dealt('t', 'w', 'pmod(shiftright(e.g, 20), w)')})))[0]"
    only = lambda one, other: f"array_except(transform(filter(t, e -> e.c = {one}), e -> e.d), transform(filter(t, e -> e.c = {other}), e -> e.d))"
    tried = (
        f"transform(s.todo, t -> named_struct('t', t, 'r', IF(l = {MAX_LEVEL}, named_struct('ok', true, 'a', {only(1, -1)}, 'b', {only(-1, 1)}), {peel(sketch('t', 'l', 'e.c'), 'l')})))"
    )
    found = lambda x: f"concat(s.{x}, flatten(transform(filter(done, y -> y.r.ok), y -> y.r.{x})))"
    again = f"flatten(transform(filter(done, y -> NOT y.r.ok), y -> {_dealt('y.t', '4', '(shiftrightunsigned(e.g, 38 + 2 * l) & 3)')}))"
    step = f"IF(size(s.todo) = 0, s, transform(array({tried}), done -> named_struct('todo', {again}, 'a', {found('a')}, 'b', {found('b')}))[0])"
    larger = f"transform(array(aggregate(sequence(1, {MAX_LEVEL}), named_struct('todo', {start}, 'a', {_NONE}, 'b', {_NONE}), (s, l) -> {step})), s -> named_struct('ok', true, 'a', s.a, 'b', s.b))[0]"
    first = f"IF(guess <= {CELLS}, {peel('zero')}, named_struct('ok', false, 'a', {_NONE}, 'b', {_NONE}))"
    return f"transform(array({subtract(base_a, base_b)}), zero -> transform(array({guess}), guess -> transform(array({first}), first -> IF(first.ok, first, {larger}))[0])[0])[0]"


def likeness(size_a: str, diff: str) -> str:
    """SQL for the Jaccard index of two passage sets, from the size of the first and their
    difference; two empty ones are alike."""
    either = f"({size_a} + size({diff}.b))"
    return f"IF({either} = 0, 1.0D, CAST({size_a} - size({diff}.a) AS DOUBLE) / {either})"


def written(cells: str) -> str:
    """SQL for a sketch as a string: per cell the count, the digests and the checks."""
    return f"array_join(transform({cells}, e -> concat(lower(hex(e.c)), '.', lower(hex(e.k)), '.', lower(hex(e.x)))), ',')"


def _ranges(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``range``, a number that rises with ``key``: ranges of about as many rows each."""
    spark = keyed.sparkSession
    ranges = min(MAX_RANGES, RANGES * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    step = max(1, keyed.count() // (ranges * KEYS))
    some = keyed.select("key").where(F.pmod("key.salt", F.lit(step)) == 0).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    marks = some.select(F.expr(f"array_distinct(transform(sequence(1, {ranges - 1}), i -> try_element_at(keys, CAST(size(keys) * i DIV {ranges} + 1 AS INT))))")).first()[0] if ranges > 1 else []
    marks = [m for m in marks if m is not None]
    if not marks:
        return keyed.withColumn("range", F.lit(0))
    # Found in two steps of about the square root of the ranges.
    wide = max(1, round(len(marks) ** 0.5))
    written_ = lambda ms: "array(" + ", ".join(f"named_struct('flag', {m['flag']}, 'id', {m['id']}L, 'hash', {m['hash']}L, 'salt', {m['salt']}L)" for m in ms) + ")"
    least = lambda x: x.replace(f"{-(2**63)}L", "(-9223372036854775807L - 1L)")
    groups = least("array(" + ", ".join(written_(marks[k : k + wide]) for k in range(0, len(marks), wide)) + ")")
    at = f"size(filter({least(written_(marks[::wide]))}, m -> m <= key))"
    return keyed.withColumn("g", F.expr(at)).withColumn("range", F.expr(f"IF(g = 0, 0, (g - 1) * {wide} + size(filter(element_at({groups}, greatest(g, 1)), m -> m <= key)))")).drop("g")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, a, sketch`` of every row with those of the next document by descending id as
    ``next_text, next_a`` and ``next_sketch``; after the last one come those of the first.

    Rows of equal ids follow by descending hash of their texts, and null ids come last. Rows are
    dealt into ranges of ids, hashes and, for equal rows, places in the input, so an id that many rows
    repeat is split. Within a range a window looks ahead; the first row of the next range is added to
    it as a last one. A row for each range is broadcast, MAX_RANGES at most.
    """
    parts = (F.when(F.col("doc_id").isNull(), 0).otherwise(1).alias("flag"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    rows = _ranges(docs.select("doc_id", "text", F.struct(*parts).alias("key")))
    heads = rows.groupBy("range").agg(F.max("key").alias("key"))
    all_ranges = Window.partitionBy(F.lit(0)).orderBy(F.col("range"))  # a row per range
    before = F.coalesce(F.lead("range").over(all_ranges), F.min("range").over(Window.partitionBy(F.lit(0))))
    heads = heads.select("key.flag", "key.id", "key.hash", before.alias("range"))
    at = rows.select("doc_id", "text", "key.flag", "key.id", "key.hash").join(F.broadcast(heads), ["flag", "id", "hash"])
    ghosts = at.groupBy("range").agg(F.max("doc_id").alias("doc_id"), F.max("text").alias("text")).select("doc_id", "text", "range", F.lit(0).alias("real"), F.lit(0).alias("hash"))
    every = rows.select("doc_id", "text", "range", F.lit(1).alias("real"), "key.hash").union(ghosts.select("doc_id", "text", "range", "real", F.col("hash").cast("long"))).repartition("range")
    every = every.withColumn("a", F.expr(digests("text"))).withColumn("sketch", F.expr(sketch("a")))
    window = Window.partitionBy("range").orderBy(F.col("real").desc(), F.col("doc_id").desc_nulls_last(), F.col("hash").desc(), F.col("text").desc())
    ahead = [F.lead(c).over(window).alias(f"next_{c}") for c in ("text", "a", "sketch")]
    return every.select("doc_id", "text", "a", "sketch", "real", *ahead).where("real = 1").drop("real")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: fingerprints of every document and of its edited text, and their likeness.

    A null text is empty. Ids may be any numbers, null or repeated; the order of rows of equal ids
    is that of ``with_next``. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    cut = "CAST(n_chars DIV 3 AS INT)"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, CAST(n_chars AS INT) - {cut}), substring(next_text, 1, {cut}))"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", "sketch", F.expr(digests("edited")).alias("e"), "next_a", "next_sketch")
    rows = rows.withColumn("edited_sketch", F.expr(sketch("e")))
    rows = rows.withColumns({"de": F.expr(difference("a", "e", "sketch", "edited_sketch")), "dn": F.expr(difference("a", "next_a", "sketch", "next_sketch"))})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(written("sketch")).alias("fingerprint"), F.expr(written("edited_sketch")).alias("edited_fingerprint"),
        F.expr(likeness("size(a)", "de")).alias("near_edited"), F.expr(likeness("size(a)", "dn")).alias("near_next"),
    )
