"""A training corpus from raw documents: quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the one before kept; all but
the last return the columns of ``documents``. Stages are written as Parquet in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import packing, quality, secrets, simhash
from loomstat.llm._common import new_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle in the near-duplicate stage.
SHINGLE_WORDS = 5
#: Jaccard index of shingle sets from which texts are near-duplicates.
SIMILARITY = 0.8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score reaches the threshold. The model is fitted on labelled rows of
    this stage's input outside the held-out fold; labels decide nothing else. Where too few are
    labelled for a model, all rows stay."""
    model = quality.fit(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    if not model.good or not model.bad:
        return docs.select(*COLUMNS)
    return quality.scores(docs, model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the row with its smallest doc_id.

    Rows that repeat that id count once. A row with a null id stays only if its component has no
    other id, once.
    """
    found = simhash.near_duplicates(docs, words=SHINGLE_WORDS, similarity=SIMILARITY)
    firsts = found.select(F.col("component_id").alias("first_id")).where("first_id IS NOT NULL").distinct()
    kept = docs.join(firsts, docs["doc_id"] == firsts["first_id"], "left_semi").select(*COLUMNS)
    lone = docs.where("doc_id IS NULL")
    if not found.where("component_id IS NULL").isEmpty():
        kept = kept.union(lone.select(*COLUMNS).dropDuplicates(["text"]))
    return kept.dropDuplicates(["doc_id", "text"])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, every secret in their texts replaced by a mark; n_chars counts the new text."""
    clean = secrets.redact(docs.select(*COLUMNS), secrets.fit(secrets.labelled(spark)))
    clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return clean.select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("packing", pack_sequences)]

#: No stage but the third has an equivalent in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
