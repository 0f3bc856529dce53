"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

The distinct marked words (a word with the mark that stands for its space) of a batch are
sorted, which is a depth-first walk over their trie; the forward states of a prefix are kept on
a stack and used again by all words that begin with it. Words that a worker has seen before
are looked up.

The forward state of a prefix depends on the kind of the model. In a unigram model it is the
best sum of piece scores, as in any Viterbi search. Under a BPE model the best sum is not what
merging gives; the state is the last piece that merging the prefix ends in. A piece continues
a prefix if merging the two pieces side by side leaves them apart, which one piece at most
does, so the walk finds the merge result with the same sharing. The kind is read from the
model file.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from loomstat.llm._common import small_batches, table

MARK = "▁"
CACHE_WORDS = 1_000_000
CACHE_CHARS = 48
_NORMAL, _BYTE, _USER = 1, 6, 4
_UNIGRAM, _BPE = 1, 2
#: What an unknown character costs below the lowest score in a unigram model.
_UNKNOWN_PENALTY = 10.0


class Model:
    """The pieces of a model file without text normalisation, and the two kinds of search."""

    def __init__(self, path: str):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(open(path, "rb").read())  # the file of a local library, not a table
        rule = proto.normalizer_spec
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix or not rule.escape_whitespaces:
            raise ValueError("only models with the identity rule and a dummy prefix")
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models")
        self.unknown = proto.trainer_spec.unk_id
        self.byte_ids = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == _NORMAL}
        if any(p.type == _USER for p in proto.pieces) or any(MARK in p.strip(MARK) or (p.strip(MARK) and p.lstrip(MARK) != p and p.startswith(MARK * 2)) or p.rstrip(MARK) != p and p.strip(MARK) for p in self.ids):
            raise ValueError("pieces must not reach over a word's mark")
        if any("\n" in p for p in self.ids):
            raise ValueError("pieces must not hold line breaks")
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.longest = max(map(len, self.ids))
        self.lowest = min((self.scores[k] for k in self.ids.values()), default=0.0)
        self.plain = {}  # bytes that an id stands for
        for k, p in enumerate(proto.pieces):
            self.plain[k] = p.piece.replace(MARK, " ").encode() if p.type == _NORMAL else (" ⁇ ".encode() if k == self.unknown else b"")
        for byte, k in self.byte_ids.items():
            self.plain[k] = bytes([byte])
        self.apart: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.seen: dict[str, bytes] = {}

    # Merging, used on pairs of pieces only.
    def _merge(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                piece = self.ids.get(parts[k] + parts[k + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, last: int, piece: int) -> bool:
        """Whether ``piece`` stays whole after ``last`` (-1: a start or an unknown character)."""
        if last < 0:
            if (known := self.whole.get(piece)) is None:
                known = self.whole[piece] = self._merge(self.pieces[piece]) == [self.pieces[piece]]
            return known
        if (known := self.apart.get((last, piece))) is None:
            known = self.apart[last, piece] = self._merge(self.pieces[last] + self.pieces[piece]) == [self.pieces[last], self.pieces[piece]]
        return known

    def _walk_bpe(self, words: list[str]):
        """Token starts and pieces of each sorted word; -1 stands for an unknown character."""
        get, follows, longest = self.ids.get, self._follows, self.longest
        last, start, before = [-1], [0], ""
        for word in words:
            shared = _common(before, word)
            del last[shared + 1 :], start[shared + 1 :]
            for j in range(shared + 1, len(word) + 1):
                for i in range(max(0, j - longest), j):
                    piece = get(word[i:j])
                    if piece is not None and follows(last[i], piece):
                        last.append(piece)
                        start.append(i)
                        break
                else:  # the character is in no piece
                    last.append(-1)
                    start.append(j - 1)
            before = word
            yield word, last, start

    def _walk_unigram(self, words: list[str]):
        get, scores, longest, unknown = self.ids.get, self.scores, self.longest, self.lowest - _UNKNOWN_PENALTY
        best, last, start, before = [0.0], [-1], [0], ""
        for word in words:
            shared = _common(before, word)
            del best[shared + 1 :], last[shared + 1 :], start[shared + 1 :]
            for j in range(shared + 1, len(word) + 1):
                top, at, by = None, 0, -1
                for i in range(max(0, j - longest), j):
                    piece = get(word[i:j])
                    if piece is not None:
                        score = best[i] + scores[piece]
                    elif i == j - 1:
                        score = best[i] + unknown
                        piece = -1
                    else:
                        continue
                    if top is None or score > top:
                        top, at, by = score, i, piece
                best.append(top)
                last.append(by)
                start.append(at)
            before = word
            yield word, last, start

    def _spell(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8")] if self.byte_ids else [self.unknown]

    def search(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of marked words with one mark."""
        out = {}
        for word, last, start in (self._walk_bpe if self.kind == _BPE else self._walk_unigram)(sorted(words)):
            j, path = len(word), []
            while j:
                path.append([last[j]] if last[j] >= 0 else self._spell(word[j - 1]))
                j = start[j]
            out[word] = list(chain.from_iterable(reversed(path)))
        return out

    def _marks(self, n: int) -> list[int]:
        """A run of marks: merging takes the longest piece from the left."""
        out = []
        while n:
            k = next(k for k in range(min(n, self.longest), 0, -1) if MARK * k in self.ids)
            out.append(self.ids[MARK * k])
            n -= k
        return out

    def _with_marks(self, marks: int, ids: list[int]) -> list[int]:
        """A word after ``marks`` more marks; ``ids`` is the word with one."""
        if ids and ids[0] == self.ids.get(MARK):
            return self._marks(marks + 1) + ids[1:]
        return self._marks(marks) + ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        split = [_words(t) if t else [] for t in texts]
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        parts = [list(map(self.seen.get, words)) for words in split]
        gaps = [k for k, found in enumerate(parts) if None in found]
        new = {w for k in gaps for w, x in zip(split[k], parts[k], strict=True) if x is None}
        if self.kind == _UNIGRAM:
            marked = {w: w if w[:1] == "\n" else MARK + MARK * (len(w) - len(w.lstrip(" "))) + w.lstrip(" ") for w in new}
            found = self.search(list(set(marked.values())))
            ids = {w: found[x] for w, x in marked.items()}
        else:
            marked = {w: w if w[:1] == "\n" else MARK + w.lstrip(" ") for w in new}
            found = self.search(list(set(marked.values())))
            ids = {w: self._with_marks(len(w) - len(w.lstrip(" ")), found[x]) if w[:1] == " " else found[x] for w, x in marked.items()}
        extra = {}
        for w, x in ids.items():
            (self.seen if len(w) <= CACHE_CHARS else extra)[w] = np.array(x, "<u4").tobytes()
        for k in gaps:
            parts[k] = [(extra[w] if w in extra else self.seen[w]) if x is None else x for w, x in zip(split[k], parts[k], strict=True)]
        return [b"".join(found) for found in parts]

    def decode(self, ids: bytes | None) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD, control pieces nothing."""
        if not ids:
            return ""
        data = b"".join(map(self.plain.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.decode("utf-8", errors="replace").removeprefix(" ")


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid
    return low


def _words(text: str) -> list[str]:
    """Words of a text without their own mark; further marks before a word stay as spaces.

    No piece holds a line break, so what follows one is a word without a mark, and begins with it.
    """
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " ":
        return _slow_words(text)
    return text.replace("\n", " \n").split(" ")


def _slow_words(text: str) -> list[str]:
    out = []
    for word in re.findall(" +[^ ]*", " " + text):
        head, *lines = word[1:].split("\n")
        out.append(head)
        out += ["\n" + line for line in lines]
    return out


@cache
def _model(path: str) -> Model:
    return Model(path)


def _path(model: str | None) -> str:
    return model or public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text_col`` as a binary column of little-endian unsigned 32-bit
    numbers. Null and empty texts have none. A column named ``out`` is replaced, rows and
    other columns stay as they are."""
    path = _path(model)
    return _mapped(docs, text_col, out, "binary", pa.binary(), lambda texts: _model(path).encode(texts))


def decode(docs: DataFrame, model: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids_col``; null or no ids give the empty text."""
    path = _path(model)
    return _mapped(docs, ids_col, out, "string", pa.string(), lambda ids: list(map(_model(path).decode, ids)))


def _mapped(docs: DataFrame, column: str, out: str, kind: str, arrow, function) -> DataFrame:
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != out]
    at = rest.index(column)

    def run(batches):
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(function(batch.column(at).to_pylist()), arrow)], names=[*rest, out])

    kept = docs.select(*rest)
    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", {out} {kind}")


def library_encode(texts: list[str], model: str | None = None) -> list[list[int]]:
    """What the sentencepiece library gives, to test against."""
    return SentencePieceProcessor(model_file=_path(model)).encode(texts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: ``doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip`` of every document.

    round_trip tells whether the decoded text equals the text (null: the empty text); a text
    with the mark itself comes back with a space in its place.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs)).withColumn("text", F.coalesce("text", F.lit("")))
    return both.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("text") == F.col("decoded")).alias("round_trip"),
    )
