"""Quality classifier by compression.

Two Zstandard dictionaries are trained, one on good and one on bad labelled text. A text is
cut into blocks, and each block is compressed with either dictionary: the dictionary whose
text is alike saves more bytes. The features are normalised differences of the compressed sizes
alone: over the whole text by the sizes and by the text's length, and in its worst and best block. A
logistic regression on labelled texts that the dictionaries have not seen makes them a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstat.llm._common import fold, small_batches, table

#: Labelled texts of each class that a model is fitted on, at most, their bytes together, and the
#: bytes of the longest one: half of them train the dictionary, the other half calibrate, all whole.
SAMPLE_TEXTS = 2000
SAMPLE_BYTES = 16 << 20
LONGEST_BYTES = 1 << 20
#: Bytes of one dictionary, and of the slices of texts that it is trained on.
DICTIONARY_BYTES = 112 << 10
SLICE = 512
BLOCK = 256
LEVEL = 3
THRESHOLD = 0.7


def _dictionary(texts: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on all slices of whole texts; too few of them are its content as they are."""
    slices = [t[k : k + SLICE] for t in texts for k in range(0, len(t), SLICE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, slices, level=LEVEL)
    except zstandard.ZstdError:
        every = -(-sum(map(len, slices)) // DICTIONARY_BYTES) or 1
        return zstandard.ZstdCompressionDict(b"".join(slices[::every])[:DICTIONARY_BYTES] or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the weights of the calibration; without dictionaries a constant."""

    good: bytes
    bad: bytes
    raw: tuple[bool, bool]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scorer(self):
        """A function of one text; compressors are made once and belong to one process."""
        if not self.good or not self.bad:
            constant = float(1 / (1 + np.exp(-self.weights[0])))
            return lambda text: constant
        measure = Measure(self.good, self.bad, self.raw)
        return lambda text: float(1 / (1 + np.exp(-np.clip(np.append(1.0, (measure(text) - self.mean) / self.scale) @ self.weights, -40, 40))))


class Measure:
    """Normalised differences of a text's compressed sizes with two dictionaries."""

    def __init__(self, good: bytes, bad: bytes, raw: tuple[bool, bool] = (False, False)):
        kinds = [zstandard.DICT_TYPE_RAWCONTENT if x else zstandard.DICT_TYPE_FULLDICT for x in raw]
        dicts = [zstandard.ZstdCompressionDict(d, dict_type=kind) for d, kind in zip((good, bad), kinds, strict=True)]
        for d in dicts:
            d.precompute_compress(level=LEVEL)
        self.by = [zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in dicts]
        self.empty = [len(c.compress(b"")) for c in self.by]

    def __call__(self, text: str | None) -> np.ndarray:
        data = (text or "").encode("utf-8")
        # Equal blocks, so that a short rest does not stand for the worst or best one.
        n = max(1, round(len(data) / BLOCK))
        cuts = [len(data) * k // n for k in range(n + 1)]
        blocks = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        good, bad = (np.fromiter((len(c.compress(b)) - e for b in blocks), float, n) for c, e in zip(self.by, self.empty, strict=True))
        each = (bad - good) / (bad + good + 16)
        g, b = good.sum(), bad.sum()
        return np.array([(b - g) / (b + g + 16), each.min(), each.max(), (b - g) / (len(data) + 16)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic regression with a free intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: DataFrame) -> Model:
    """Fit on ``doc_id, text, quality``: of either label the texts with the smallest hashes of their ids,
    at most SAMPLE_TEXTS of them and SAMPLE_BYTES in all, none above LONGEST_BYTES.

    Of texts that repeat an id and a label, the first in order counts. Rows with a null label or text are
    left out. If a label has fewer than four texts, every text gets the share of label 1, 0.5
    without labels. An empty table counts as one without labels; other columns are ignored.
    """
    rows = labelled.where("text IS NOT NULL AND quality IN (0, 1)").select("doc_id", "text", "quality")
    sizes = rows.groupBy("doc_id", "quality").agg(F.max(F.octet_length("text")).alias("n")).where(F.col("n") <= LONGEST_BYTES).withColumn("h", F.xxhash64("doc_id"))
    few = [sizes.where(F.col("quality") == label).orderBy("h", "doc_id").limit(SAMPLE_TEXTS) for label in (1, 0)]
    run = F.sum("n").over(Window.partitionBy("quality").orderBy("h", "doc_id"))  # SAMPLE_TEXTS rows at most
    few = few[0].union(few[1]).withColumn("run", run).where(F.col("run") <= SAMPLE_BYTES).select(F.col("doc_id").alias("few_id"), F.col("quality").alias("label"), "h")
    chosen = rows.join(F.broadcast(few), (F.col("quality") == F.col("label")) & F.col("doc_id").eqNullSafe(F.col("few_id")))
    found = chosen.groupBy("h", "doc_id", "quality").agg(F.min("text").alias("text")).orderBy("h", "doc_id").collect()  # 2 * SAMPLE_BYTES at most
    texts = {label: [r["text"] for r in found if r["quality"] == label] for label in (1, 0)}
    if min(map(len, texts.values())) < 4:
        n1, n0 = len(texts[1]), len(texts[0])
        return Model(b"", b"", (False, False), np.zeros(0), np.ones(0), np.array([np.log((n1 + 0.5) / (n0 + 0.5))]))
    good, bad = (_dictionary([t.encode() for t in texts[k][::2]]) for k in (1, 0))
    raw = (not good.dict_id(), not bad.dict_id())
    measure = Measure(good.as_bytes(), bad.as_bytes(), raw)
    x = np.array([measure(t) for k in (1, 0) for t in texts[k][1::2]])
    y = np.repeat([1.0, 0.0], [len(texts[k][1::2]) for k in (1, 0)])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return Model(good.as_bytes(), bad.as_bytes(), raw, mean, scale, _logistic((x - mean) / scale, y))


def scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` in 0 to 1 from the whole text; null counts as empty.

    An existing column ``score`` is replaced. Repeated rows get equal scores.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "score"]
    at = rest.index(text_col)

    def run(batches):
        scorer = model.scorer()
        for batch in batches:
            score = pa.array([scorer(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.record_batch([*batch.columns, score], names=[*rest, "score"])

    kept = docs.select(*rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", score double"
    return kept.mapInArrow(run, schema)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, quality`` of labelled documents outside the held-out fold (crc32 of the id
    modulo 4 is 2): of either label the SAMPLE_TEXTS rows of ``labels`` with the smallest hashes.

    Choosing on the labels alone bounds what is broadcast, and documents are not shuffled.
    """
    mine = labels.select("doc_id", "quality").where(fold(F.col("doc_id"), 4) != 2).withColumn("h", F.xxhash64("doc_id"))
    few = [mine.where(F.col("quality") == label).orderBy("h", "doc_id").limit(SAMPLE_TEXTS) for label in (1, 0)]
    return docs.select("doc_id", "text").join(F.broadcast(few[0].union(few[1]).select("doc_id", "quality")), "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the score of every document; a null doc_id is never held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    return scores(docs, model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )
