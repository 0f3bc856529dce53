"""Language-model scoring with a Katz back-off bigram model.

Model. Tokens are the words of a text, lower-cased in A-Z, and one end. With ``c`` the training
counts and ``d_r`` Good-Turing discounts (1 above the cutoff ``K``),

    P1(w)   = d_r r / (N + 1), r = c(w) > 0;  all unknown words together keep the rest of 1
    P(w|h)  = d_r r / (c(h) + 1), r = c(h w) > 0;  else alpha(h) P1(w)
    alpha(h) = (1 - sum of P over the seen followers) / (1 - sum of P1 over the seen followers)

so that every distribution over the training words and the unknown class sums to exactly 1.
The 1 in the denominators keeps one unit of unseen mass for histories whose followers all lie
above the cutoff, where plain Katz would give probability zero. A history that training has
not seen has alpha 1. Where a count of counts is zero or a Good-Turing discount leaves (0, 1],
which happens in tiny corpora, that order uses absolute discounting instead.

Plan. Rows move as packed arrays, not one by one. (1) Texts become chunks of token numbers
with the distinct words' hashes, written once. (2) Each chunk sends its distinct words and
counts to buckets of the hash range; buckets add them up, keep the unigram table and answer
each chunk with a number and the count of its words. (3) Each chunk sends its distinct bigrams,
already counted, to the bucket of the history; buckets add up, and keep the bigram table: the
counts, what alpha needs, and per document the sums that do not depend on the discounts.
(4) When the counts of counts are known, buckets finish their sums, which are added per
document. A history with more than 1/512 of all tokens, or more than HOT_MOST, is dealt over buckets
by its follower; only the partial sums of those go to the driver, a row for each HOT_MOST tokens of the
input at most. A bucket of words gets a blob from every chunk that has one of them, so its memory
grows with the chunks.

``train`` gives the stored tables as rows, words and word pairs with their counts, and ``evaluate``
scores any other texts by them, token by token: the pair's probability, else the back-off weight
of the history, summed from its pairs, times the word's.

Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm._common import fold, small_batches, stored, table
from loomstat.llm.words import tokenise

K = 5
CHUNK_BYTES = 10 << 20
BUCKET_TOKENS = 2_000_000
HOT_SHARE = 512
HOT_LEAST, HOT_MOST = 10_000, BUCKET_TOKENS // 4
#: Keys of the end and of the start of a text; no word holds white space.
END = xxhash.xxh64_intdigest(b"\n")
START = xxhash.xxh64_intdigest(b"\t")


def pack(**arrays) -> bytes:
    """Arrays as bytes: unsigned integers in their smallest width, byte planes, Zstandard."""
    out = {}
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        if a.dtype.kind in "iu" and a.size:
            a = a.astype(np.min_scalar_type(int(a.max())))
        planes = a.view(np.uint8).reshape(a.size, a.itemsize).T if a.size else a
        out[name] = (a.dtype.str, a.size, zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1))
    return pickle.dumps(out, protocol=5)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    out = {}
    for name, (kind, n, data) in pickle.loads(blob).items():
        kind = np.dtype(kind)
        planes = np.frombuffer(zstandard.decompress(data) if n else b"", np.uint8)
        out[name] = np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n) if n else np.empty(0, kind)
    return out


def _deltas(values: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Steps within runs of rising values; a run begins with its first value."""
    out = np.diff(values, prepend=0)
    if len(values):
        first = np.cumsum(run) - run
        out[first] = values[first]
    return out


def _undo_deltas(steps: np.ndarray, run: np.ndarray) -> np.ndarray:
    if not len(steps):
        return steps.astype(np.int64)
    run = run.astype(np.int64)
    total = np.cumsum(steps.astype(np.int64))
    first = np.cumsum(run) - run
    return total - np.repeat(total[first] - steps[first].astype(np.int64), run)


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a 64-bit key by range; does not fall as the key grows."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _chunk(ids: list, texts: list, train: list[bool]) -> dict:
    numbers, lengths, words = tokenise(texts)
    keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    keys = np.append(keys, np.array([END, START], np.uint64))
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    end, start = place[-2:]
    ends = np.cumsum(lengths + 1) - 1
    tokens = np.full(len(numbers) + len(lengths), end, np.int64)
    word_at = np.ones(len(tokens), bool)
    word_at[ends] = False
    tokens[word_at] = place[numbers]
    in_train = np.repeat(np.array(train, bool), lengths + 1)
    counts = np.bincount(tokens[in_train], minlength=len(keys))
    return {
        "words": pack(keys=keys[order], counts=counts),
        "body": pack(tokens=tokens, lengths=lengths + 1, train=np.array(train, np.uint8), marks=np.array([start, end])),
        "ids": ids,
        "tokens": len(tokens),
        "train_tokens": int(in_train.sum()),
        "train_docs": int(sum(train)),
    }


_CHUNK = "chunk_id long, words binary, body binary, ids array<long>, tokens long, train_tokens long, train_docs long"
_FIELDS = ("chunk_id", "words", "body", "ids", "tokens", "train_tokens", "train_docs")


def chunks(docs: DataFrame) -> DataFrame:
    """``doc_id long, text, train`` as chunks of token numbers, stored in the shared folder."""
    small_batches(docs.sparkSession)

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held: tuple[list, list, list] = ([], [], [])
        size = 0

        def flush():
            nonlocal made
            row = _chunk(*held) | {"chunk_id": (part << 32) + made}
            made += 1
            kinds = {"ids": pa.list_(pa.int64()), "words": pa.binary(), "body": pa.binary()}
            return pa.record_batch([pa.array([row[f]], kinds.get(f, pa.int64())) for f in _FIELDS], names=list(_FIELDS))

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for to, x in zip(held, row, strict=True):
                    to.append(x)
                size += len(row[1] or "") + 16
                if size >= CHUNK_BYTES:
                    yield flush()
                    held, size = ([], [], []), 0
        if held[0]:
            yield flush()

    return stored(docs.mapInArrow(run, _CHUNK), "katz-chunks", packed=True)


def discounts(seen: list[int]) -> np.ndarray:
    """Good-Turing discounts d_1..d_K from the counts of counts n_1..n_{K+1}."""
    n = np.array(seen, float)
    r = np.arange(1, K + 1)
    if (n > 0).all():
        tail = (K + 1) * n[K] / n[0]
        if tail < 1:
            d = ((r + 1) * n[1:] / n[:K] / r - tail) / (1 - tail)
            if (d > 0).all() and (d <= 1).all():
                return d
    share = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 and n[1] > 0 else 0.5
    return (r - share) / r


def _probability(count: np.ndarray, total: int, d: np.ndarray, unknown: float) -> np.ndarray:
    """P1 of words with these training counts."""
    factor = np.append(np.append(1.0, d), 1.0)[np.minimum(count, K + 1)]
    return np.where(count > 0, factor * count / (total + 1.0), unknown)


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, inverse, np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)


def _by_bucket(buckets: np.ndarray, n: int):
    edges = np.searchsorted(buckets, np.arange(n + 1))
    return ((b, slice(edges[b], edges[b + 1])) for b in np.flatnonzero(np.diff(edges)))


def _unigrams(parts: DataFrame, n_buckets: int) -> DataFrame:
    """A row for each bucket (the table and its statistics) and for each chunk in it (the answer)."""

    def send(batches):
        for batch in batches:
            for chunk, blob in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                x = unpack(blob)
                keys = x["keys"].astype(np.uint64)
                rows = [(b, chunk, pack(keys=keys[at], counts=x["counts"][at])) for b, at in _by_bucket(_bucket(keys, n_buckets), n_buckets)]
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.binary()))], names=["bucket", "chunk_id", "part"])

    def merge(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        x = [unpack(b) for b in group.column("part").to_pylist()]
        keys, at, counts = _add_up(np.concatenate([y["keys"].astype(np.uint64) for y in x]), np.concatenate([y["counts"] for y in x]))
        number = (bucket << 32) + np.arange(len(keys))  # rises with the key
        rows, done = [], 0
        for chunk, y in zip(group.column("chunk_id").to_pylist(), x, strict=True):
            here = at[done : done + len(y["keys"])]
            done += len(here)
            rows.append((bucket, chunk, pack(numbers=number[here], counts=counts[here]), None))
        seen = [int((counts == r).sum()) for r in range(1, K + 2)]
        rows.append((bucket, None, pack(keys=keys, counts=counts), [int(counts.sum()), int((counts > 0).sum()), *seen]))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return _table(rows, "bucket chunk_id part stats", kinds)

    sent = parts.select("chunk_id", "words").mapInArrow(send, "bucket int, chunk_id long, part binary")
    return stored(sent.groupBy("bucket").applyInArrow(merge, "bucket int, chunk_id long, part binary, stats array<long>"), "katz-unigrams", packed=True)


_SENT = "bucket int, chunk_id long, kind int, part binary, ids array<long>"


def _table(rows: list[tuple], names: str, kinds: tuple) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names.split())


_SENT_KINDS = (pa.int32(), pa.int64(), pa.int8(), pa.binary(), pa.list_(pa.int64()))


def _spread(numbers: np.ndarray, n: int) -> np.ndarray:
    """Buckets of whole numbers, spread by a multiplicative hash."""
    return _bucket((numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), n)


def _bigrams_of(chunk: dict, ids: list, words: dict, chunk_id: int, n_buckets: int, hot_from: int, total: int, distinct: int, train_docs: int) -> list[tuple]:
    """What a chunk sends: its documents' own figures, and its bigrams by bucket."""
    number, count = words["numbers"].astype(np.int64), words["counts"].astype(np.int64)
    tokens, lengths, train = chunk["tokens"].astype(np.int64), chunk["lengths"].astype(np.int64), chunk["train"]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    seen = count[tokens]
    base = np.bincount(doc, weights=np.log10((seen + 1) / (total + distinct + 1)), minlength=len(lengths))
    known = np.bincount(doc[seen > 0], minlength=len(lengths))
    rows = [(int(_spread(np.array([chunk_id]), n_buckets)[0]), chunk_id, 0, pack(base=base, known=known, lengths=lengths, train=train), ids)]

    start = int(chunk["marks"][0])
    count[start] = train_docs  # as a history; it is never predicted
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = start
    hot = count[before] > hot_from
    bucket = _spread(np.where(hot, number[before] * 31 + number[tokens], number[before]), n_buckets)
    code = (bucket * len(number) + before) * len(number) + tokens
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    many = np.diff(np.append(first, len(code)))
    trained = np.add.reduceat(train[doc[order]].astype(np.int64), first)
    h, w, b = before[order][first], tokens[order][first], bucket[order][first]
    for at, where in _by_bucket(b, n_buckets):
        hs = h[where]
        runs = np.flatnonzero(np.diff(hs, prepend=-1))
        uses = slice(first[where.start], first[where.stop] if where.stop < len(first) else len(code))
        run = np.diff(np.append(runs, len(hs)))
        blob = pack(
            h=_deltas(number[hs[runs]], np.array([len(runs)])), h_count=count[hs[runs]], run=run, w=_deltas(number[w[where]], run), w_count=count[w[where]],
            trained=trained[where], held=many[where] - trained[where], doc=doc[order][uses],
        )
        rows.append((int(at), chunk_id, 1, blob, None))
    return rows


_MODEL = "bucket int, grams binary, histories binary, sums binary, seen array<long>, ids array<long>, chunk_id long"


def _merge_bigrams(group: pa.Table, total: int, d1: np.ndarray, unknown: float, hot_from: int) -> pa.Table:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
    rows, bucket, parts = [], group.column("bucket")[0].as_py(), []
    for chunk, kind, blob, ids in zip(*(group.column(c).to_pylist() for c in ("chunk_id", "kind", "part", "ids")), strict=True):
        if kind == 0:
            rows.append((bucket, None, None, blob, None, ids, chunk))
        else:
            x = unpack(blob)
            x["w"] = _undo_deltas(x["w"], x["run"])
            x["h"] = _undo_deltas(x["h"], np.array([len(x["h"])]))
            parts.append((chunk, x))
    if parts:
        join = lambda name: np.concatenate([x[name] for _, x in parts]).astype(np.int64)
        hs, hs_count, w_count, trained = join("h"), join("h_count"), join("w_count"), join("trained")
        h_all, at_run = np.unique(hs, return_inverse=True)
        h_count = np.empty(len(h_all), np.int64)
        h_count[at_run] = hs_count
        h_at = np.repeat(at_run, join("run"))
        w_all, w_at = np.unique(join("w"), return_inverse=True)
        grams, at, r = _add_up(h_at * len(w_all) + w_at, trained)
        low = np.empty(len(grams))
        low[at] = _probability(w_count, total, d1, unknown)
        gram_h = grams // len(w_all)
        some = r > 0
        small = some & (r <= K)
        by_r = np.bincount(gram_h[small] * K + r[small] - 1, minlength=len(h_all) * K).reshape(-1, K)
        above = np.bincount(gram_h[r > K], weights=r[r > K], minlength=len(h_all))
        covered = np.bincount(gram_h[some], weights=low[some], minlength=len(h_all))
        seen = [int((r == k).sum()) for k in range(1, K + 2)]
        value = np.where(some, np.log10(np.maximum(r, 1)) - np.log10(h_count[gram_h] + 1.0), np.log10(low))
        wanted, sums, done = [], [], 0
        for chunk, x in parts:
            here = at[done : done + len(x["w"])]
            done += len(here)
            use = np.repeat(here, x["trained"].astype(np.int64) + x["held"])
            docs, doc_at = np.unique(x["doc"].astype(np.int64), return_inverse=True)
            mine = r[use]
            few = (mine > 0) & (mine <= K)
            backed = (mine == 0) & (h_count[gram_h[use]] > 0)
            wanted.append(np.unique(gram_h[use][backed]))
            sums.append(
                pack(
                    chunk=np.array([chunk]), doc=docs, value=np.bincount(doc_at, weights=value[use], minlength=len(docs)),
                    few=np.bincount(doc_at[few] * K + mine[few] - 1, minlength=len(docs) * K), back_doc=doc_at[backed], back_h=gram_h[use][backed],
                )
            )
        keep = np.unique(np.concatenate([*wanted, np.flatnonzero(h_count > hot_from)]).astype(np.int64))
        histories = pack(place=keep, h=h_all[keep], count=h_count[keep], by_r=by_r[keep].ravel(), above=above[keep].astype(np.int64), covered=covered[keep])
        # Followers rise within a history; histories without any are left out.
        run = np.bincount(gram_h[some], minlength=len(h_all))
        kept = run > 0
        table_ = pack(h=_deltas(h_all[kept], np.array([kept.sum()])), run=run[kept], w=_deltas(w_all[grams[some] % len(w_all)], run[kept]), count=r[some])
        rows.append((bucket, table_, histories, pickle.dumps(sums), seen, None, None))
    return _table(rows, "bucket grams histories sums seen ids chunk_id", kinds)


def _alpha(x: dict, d2: np.ndarray) -> np.ndarray:
    """Back-off weights of histories with these totals."""
    r = np.arange(1, K + 1)
    taken = (x["by_r"].reshape(-1, K) @ (d2 * r) + x["above"]) / (x["count"] + 1.0)
    return (1 - taken) / (1 - x["covered"])


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _learn(docs: DataFrame) -> dict:
    """The stored tables and the totals of a model of the marked rows of ``doc_id, text, train``."""
    parts = chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("train"), F.lit(False)).alias("train")))
    size = parts.agg(F.sum("tokens"), F.sum("train_tokens"), F.sum("train_docs")).first()
    tokens, train_tokens, train_docs = (x or 0 for x in size)
    n_buckets = max(12, -(-tokens // BUCKET_TOKENS))
    hot_from = min(max(train_tokens // HOT_SHARE, HOT_LEAST), max(HOT_MOST, HOT_LEAST))
    words = _unigrams(parts, n_buckets)
    stats = words.where("stats IS NOT NULL").agg(*(F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(K + 3))).first()
    total, distinct, *seen = (x or 0 for x in stats)
    d1 = discounts(seen)
    low = float(sum(d * r * n for d, r, n in zip(d1, range(1, K + 1), seen, strict=False)))
    above = total - sum(r * n for r, n in zip(range(1, K + 1), seen, strict=False))
    unknown = 1 - (low + above) / (total + 1.0)

    def bigrams(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            order = np.argsort(right.column("bucket").to_numpy())
            answers = [unpack(right.column("part")[int(k)].as_py()) for k in order]
            words = {name: np.concatenate([x[name] for x in answers]) for name in ("numbers", "counts")}
            rows = _bigrams_of(unpack(left.column("body")[0].as_py()), left.column("ids")[0].as_py(), words, left.column("chunk_id")[0].as_py(), n_buckets, hot_from, total, distinct, train_docs)
        return _table(rows, "bucket chunk_id kind part ids", _SENT_KINDS)

    sent = (
        parts.select("chunk_id", "body", "ids").groupBy("chunk_id")
        .cogroup(words.where("chunk_id IS NOT NULL").select("chunk_id", "bucket", "part").groupBy("chunk_id"))
        .applyInArrow(bigrams, _SENT.replace("kind int", "kind tinyint"))
    )
    model = stored(sent.groupBy("bucket").applyInArrow(lambda group: _merge_bigrams(group, total, d1, unknown, hot_from), _MODEL), "katz-bigrams", packed=True)
    stats = model.where("seen IS NOT NULL").agg(*(F.sum(F.col("seen")[k]).alias(f"s{k}") for k in range(K + 1))).first()
    d2 = discounts([x or 0 for x in stats])
    return {"words": words, "model": model, "total": total, "train_docs": train_docs, "hot_from": hot_from, "d1": d1, "d2": d2, "unknown": unknown}


@dataclass(frozen=True)
class Model:
    """A stored model: ``unigrams`` (``key, number, count``), ``bigrams`` (``h, w, count`` by number), Good-Turing
    discounts of either order, the training tokens and texts, and the probability of the unknown class."""

    unigrams: DataFrame
    bigrams: DataFrame
    d1: np.ndarray
    d2: np.ndarray
    total: int
    train_docs: int
    unknown: float


def train(docs: DataFrame) -> Model:
    """A model of the marked rows of ``doc_id, text, train``; its tables lie in the shared folder."""
    found = _learn(docs)

    def word_rows(batches):
        for batch in batches:
            for bucket, blob in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                x = unpack(blob)
                keys, counts = x["keys"].astype(np.uint64).view(np.int64), x["counts"].astype(np.int64)
                yield pa.record_batch([pa.array(keys), pa.array((bucket << 32) + np.arange(len(keys))), pa.array(counts)], names=["key", "number", "count"])

    def pair_rows(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                x = unpack(blob)
                run = x["run"].astype(np.int64)
                h = np.repeat(_undo_deltas(x["h"], np.array([len(run)])), run)
                yield pa.record_batch([pa.array(h), pa.array(_undo_deltas(x["w"], run)), pa.array(x["count"].astype(np.int64))], names=["h", "w", "count"])

    unigrams = found["words"].where("chunk_id IS NULL").select("bucket", "part").mapInArrow(word_rows, "key long, number long, count long")
    bigrams = found["model"].where("grams IS NOT NULL").select("grams").mapInArrow(pair_rows, "h long, w long, count long")
    return Model(unigrams, bigrams, found["d1"], found["d2"], found["total"], found["train_docs"], found["unknown"])


def evaluate(model: Model, docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, score`` of every row of ``doc_id, text`` by the stored tables alone.

    A token's probability is that of its pair; where training has not seen the pair, the back-off
    weight of its history times the probability of the word, or of the unknown class. Null and empty
    texts are their end alone, repeated rows are scored each, an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    signed = [k - 2**64 if k >= 2**63 else k for k in (START, END)]

    def tokens(batches):
        for batch in batches:
            numbers, lengths, words = tokenise(batch.column(1).to_pylist())
            keys = np.array([xxhash.xxh64_intdigest(w) for w in words] + [START, END], np.uint64).view(np.int64)
            ends = np.cumsum(lengths + 1) - 1
            at = np.full(len(numbers) + len(lengths), len(words) + 1, np.int64)
            word_at = np.ones(len(at), bool)
            word_at[ends] = False
            at[word_at] = numbers
            before = np.roll(at, 1)
            before[ends - lengths] = len(words)
            row = batch.column(0).take(pa.array(np.repeat(np.arange(len(lengths)), lengths + 1)))
            yield pa.record_batch([row, pa.array(keys[before]), pa.array(keys[at])], names=["row", "before", "key"])

    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "katz-texts").withColumn("row", F.monotonically_increasing_id())
    pairs = rows.select("row", "text").mapInArrow(tokens, "row long, before long, key long").groupBy("row", "before", "key").agg(F.count(F.lit(1)).alias("n"))
    discount = lambda d, r: F.element_at(F.array(*(F.lit(float(x)) for x in (*d, 1.0))), F.least(F.col(r), F.lit(K + 1)).cast("int")) * F.col(r)
    words = model.unigrams.withColumns({"p1": F.when(F.col("count") > 0, discount(model.d1, "count") / (model.total + 1.0)).otherwise(F.lit(float(model.unknown))), "begins": F.when(F.col("key") == signed[0], model.train_docs).otherwise(F.col("count"))})
    sums = (
        model.bigrams.join(words.select(F.col("number").alias("w"), "p1"), "w").groupBy("h").agg(F.sum(discount(model.d2, "count")).alias("taken"), F.sum("p1").alias("covered"))
        .join(words.select(F.col("number").alias("h"), "begins"), "h").select("h", ((1 - F.col("taken") / (F.col("begins") + 1.0)) / (1 - F.col("covered"))).alias("alpha"))
    )
    histories = words.select(F.col("key").alias("before"), F.col("number").alias("h"), "begins").join(sums, "h", "left")
    known = pairs.join(words.select("key", F.col("number").alias("w"), "p1"), "key", "left").join(histories, "before", "left").join(model.bigrams.withColumnRenamed("count", "r"), ["h", "w"], "left")
    low = F.coalesce("alpha", F.lit(1.0)) * F.coalesce("p1", F.lit(float(model.unknown)))
    p = F.when(F.col("r") > 0, discount(model.d2, "r") / (F.col("begins") + 1.0)).otherwise(low)
    found = known.groupBy("row").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.log10(p)).alias("score"))
    return rows.select("row", "doc_id").join(found, "row").select("doc_id", "n_tokens", "score")


def score(docs: DataFrame) -> DataFrame:
    """Train on the rows of ``doc_id, text, train`` that are marked and score all rows.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every
    row, repeated rows included. Null and empty texts are their end alone. Null ids are kept.
    With no training rows every token is of the unknown class, of probability 1. An empty
    table gives an empty result. Other columns are ignored.
    """
    found = _learn(docs)
    model, total, hot_from, d2 = (found[x] for x in ("model", "total", "hot_from", "d2"))
    log_d2 = np.log10(d2)

    def hot_parts(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                x = unpack(blob)
                at = np.flatnonzero(x["count"] > hot_from)
                by_r = x["by_r"].reshape(-1, K)[at] if len(at) else np.empty((0, K), np.int64)
                columns = [pa.array(x[c][at], t) for c, t in (("h", pa.int64()), ("count", pa.int64()), ("above", pa.int64()), ("covered", pa.float64()))]
                yield pa.record_batch([*columns, *(pa.array(by_r[:, k], pa.int64()) for k in range(K))], names=["h", "count", "above", "covered", *(f"r{k}" for k in range(K))])

    of = model.where("histories IS NOT NULL").select("histories").mapInArrow(hot_parts, "h long, count long, above long, covered double, " + ", ".join(f"r{k} long" for k in range(K)))
    hot_rows = of.groupBy("h").agg(F.max("count").alias("count"), *(F.sum(c).alias(c) for c in ("above", "covered", *(f"r{k}" for k in range(K))))).collect()  # a row for each hot_from tokens at most
    hot = {x["h"]: float(_alpha({"by_r": np.array([[x[f"r{k}"] for k in range(K)]]), "above": np.array([x["above"]]), "count": np.array([x["count"]]), "covered": np.array([x["covered"]])}, d2)[0]) for x in hot_rows}

    def finish(batches):
        for batch in batches:
            for bucket, histories, sums, ids, chunk in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if histories is None:
                    rows = [(bucket, chunk, 0, sums, ids)]
                else:
                    x, rows = unpack(histories), []
                    alpha = np.log10(_alpha(x, d2)) if len(x["h"]) else np.empty(0)
                    for k in np.flatnonzero(x["count"] > hot_from):
                        alpha[k] = np.log10(hot[int(x["h"][k])])
                    for part in map(unpack, pickle.loads(sums)):
                        value = part["value"] + part["few"].reshape(-1, K).astype(float) @ log_d2
                        if len(part["back_doc"]):
                            value += np.bincount(part["back_doc"].astype(np.int64), weights=alpha[np.searchsorted(x["place"], part["back_h"])], minlength=len(value))
                        rows.append((bucket, int(part["chunk"][0]), 1, pack(doc=part["doc"], value=value), None))
                yield from _table(rows, "bucket chunk_id kind part ids", _SENT_KINDS).to_batches()

    def per_document(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("kind", "bucket", "part", "ids")), strict=True), key=lambda x: x[:2])
        own, ids = unpack(rows[0][2]), rows[0][3]
        value = np.zeros(len(ids))
        for _, _, blob, _ in rows[1:]:
            x = unpack(blob)
            value[x["doc"].astype(np.int64)] += x["value"]
        n = len(ids)
        return pa.table(
            [pa.array(ids, pa.int64()), pa.array(own["train"] == 0), pa.array(own["lengths"], pa.int64()), pa.array(own["known"], pa.int64()), pa.array([total] * n, pa.int64()), pa.array(own["base"], pa.float64()), pa.array(value)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    done = model.select("bucket", "histories", "sums", "ids", "chunk_id").mapInArrow(finish, _SENT.replace("kind int", "kind tinyint"))
    return done.groupBy("chunk_id").applyInArrow(per_document, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: train on the documents whose fold of 7 is not 2, score all.

    A null doc_id has no fold and counts as training.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs.withColumn("train", F.coalesce(fold(F.col("doc_id"), 7) != 2, F.lit(True))))
