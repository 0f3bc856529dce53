"""Packing documents into fixed-length training sequences.

Documents are tokenised; what exceeds a sequence is cut off in full sequences, and the rests
are packed first-fit decreasing. A tournament tree over the bins' free space finds the first
bin that fits in logarithmic time. Packing runs in randomised groups of documents, each on its
own, so memory is bounded by the group and more documents only mean more groups.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomstat.llm._common import small_batches, stored, table
from loomstat.llm.words import gathered, tokenise

CAPACITY = 4096
END_ID = 2
#: Documents of one group, about.
GROUP_DOCS = 20_000
#: Words that a task remembers, and the longest one in bytes.
CACHE_WORDS = 700_000
CACHE_BYTES = 64
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_TAILS = frozenset((b".", b",", b"!", b"?", b":", b";"))


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    For a byte-level tokenizer that lowers case, drops white space, never joins over it, and takes
    runs of letters by themselves, a text's ids are those of its words. Words that were seen
    are looked up.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        if not self._fits():
            raise ValueError(f"{path} is not a byte-level tokenizer of words as described")
        self.seen: dict[bytes, bytes] = {}
        # The characters that a byte-level tokenizer writes bytes as.
        self.shown = {}
        for byte in range(256):
            printed = 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174
            self.shown[byte] = byte if printed else 256 + sum(1 for k in self.shown.values() if k >= 256)

    def _fits(self) -> bool:
        """Whether a few texts' ids are those of their words, in lower case, letters by themselves."""
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        some = ["Ab cd", "ab  cd\n\tef", "don't stop.", "straße, naïve", " lead", "日本 x1y2!", "A B"]
        whole = all(ids(t) == [k for w in t.split() for k in ids(w)] == ids(t.lower()) for t in some)
        return whole and ids("word.") == ids("word") + ids(".") and ids("ab12") == ids("ab") + ids("12")

    def _each(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode(self, words: set[bytes]) -> dict[bytes, bytes]:
        out, rest, model = {}, [], self.tokenizer.model
        for w in words:
            # Lower-case letters that no normalisation changes are one run: the model's input.
            if _PLAIN.fullmatch(w.decode("utf-8")):
                out[w] = np.array([t.id for t in model.tokenize(w.decode("latin-1").translate(self.shown))], "<u4").tobytes()
            else:
                rest.append(w)
        return out | dict(zip(rest, self._each(rest), strict=True))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        # Markers of special tokens keep their case, so texts that may hold one go as they are.
        marked = {k: t for k, t in enumerate(texts) if t and "<|" in t}
        numbers, lengths, words = tokenise([None if k in marked else t for k, t in enumerate(texts)] if marked else texts)
        parts = list(map(self.seen.get, words))
        new = {w for w, ids in zip(words, parts, strict=True) if ids is None}
        # A mark after a letter is a token of its own.
        tailed = {w for w in new if len(w) > 1 and w[-1:] in _TAILS and w[-2:-1].isalpha()}
        found = self._encode((new - tailed) | (({w[:-1] for w in tailed} | {w[-1:] for w in tailed}) - self.seen.keys()))
        known = lambda w: found[w] if w in found else self.seen[w]
        found |= {w: known(w[:-1]) + known(w[-1:]) for w in tailed}
        out = gathered([found[w] if ids is None else ids for w, ids in zip(words, parts, strict=True)], numbers, lengths)
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        self.seen.update((w, ids) for w, ids in found.items() if len(w) <= CACHE_BYTES)
        for k, ids in zip(marked, self._each([t.encode() for t in marked.values()]), strict=True):
            out[k] = ids
        return out


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, doc_tokens, crcs``: the tokens of each document and the crc32 of each of its
    pieces of ``capacity`` tokens, the last one shorter or as long. Null texts are empty."""
    small_batches(docs.sparkSession)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = _encoder(tokenizer)
        try:
            for batch in batches:
                ids = [x + end for x in encode(batch.column(1).to_pylist())]
                sums = [[zlib.crc32(x[k : k + 4 * capacity]) for k in range(0, len(x), 4 * capacity)] for x in ids]
                yield pa.record_batch([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])
        finally:  # Spark keeps the worker for other stages
            encode.seen.clear()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>")


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each size, by first-fit decreasing; equal sizes go in their order.

    Node k of the tournament tree holds the larger free space of nodes 2k and 2k + 1; leaves are
    the bins in order. Sizes must lie between 1 and ``capacity``.
    """
    width = 1
    while width < len(sizes):
        width *= 2
    tree = [capacity] * (2 * width)
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for item in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size, k = sizes[item], 1
        while k < width:
            k *= 2
            if tree[k] < size:
                k += 1
        out[item] = (k - width, capacity - tree[k])
        tree[k] -= size
        while k > 1:
            k //= 2
            best = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
    return out


_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int | None = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every token of every row lies in exactly one piece; the pieces of a sequence follow one
    another from offset 0. Repeated rows are packed each. Null and empty texts are their end
    token (no piece at all where ``end_id`` is None). An empty table gives an empty result.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    cuts = stored(cut(docs, path, capacity, end_id), "packing")
    n_groups = max(1, -(-cuts.count() // group_docs))
    # The number of a stored row does not change when a task runs again, and no id repeats it.
    dealt = cuts.withColumn("row", F.monotonically_increasing_id()).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(n_groups)))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        doc_id, total, sums = (group.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "crcs"))
        base = group.column("group")[0].as_py() << 32
        at = [k for k, n in enumerate(total) if n]
        places = first_fit_decreasing([(total[k] - 1) % capacity + 1 for k in at], capacity)
        full = 1 + max((p[0] for p in places), default=-1)
        rows = []
        for k, (sequence, offset) in zip(at, places, strict=True):
            last = len(sums[k]) - 1
            for piece, crc in enumerate(sums[k][:last]):
                rows.append((doc_id[k], piece * capacity, capacity, crc, total[k], base + full, 0))
                full += 1
            rows.append((doc_id[k], last * capacity, (total[k] - 1) % capacity + 1, sums[k][last], total[k], base + sequence, offset))
        names = [f.split()[0] for f in _OUT.split(", ")]
        return pa.table([pa.array([r[c] for r in rows], pa.int64()) for c in range(len(names))], names=names)

    return dealt.groupBy("group").applyInArrow(run, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents in sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
