"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to a Python worker, at most: bounds its memory when texts are long.
BATCH_ROWS = 1536
BATCH_BYTES = 4 << 20
#: Rows of one file of a narrow intermediate table, about.
FILE_ROWS = 8_192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and the bytes of an Arrow batch for this session.

    Plans are lazy and read the settings when they are executed, so they cannot be put back here.
    All operators share these bounds, and a session's own smaller ones stay.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)([kmgt]?)b?", str(spark.conf.get(key)).lower())
        if not now or not 0 < int(now[1]) << 10 * " kmgt".index(now[2] or " ") <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Where that is unset a temporary folder of this machine
    is set instead if the session runs on this machine alone, as in local tests; on a cluster it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        base = context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"loomstat-{uuid.uuid4().hex}")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: For rows that hold large compressed arrays: no second compression, which would take direct
#: buffers of whole pages, and the size of a page checked at each row, not at each hundredth.
PACKED = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def _in_files(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` in no more partitions than files of about FILE_ROWS rows need, if a bound of its rows is
    known: a small table in a file for each of many shuffle partitions costs more than its contents."""
    return df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))


def stored(df: DataFrame, name: str, packed: bool = False, rows: int | None = None) -> DataFrame:
    """Write ``df``, of at most about ``rows`` rows, to the shared folder and read it back: cuts lineage,
    survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _in_files(df, rows).write.options(**PACKED if packed else {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    shared_dir(df.sparkSession)
    return _in_files(df, rows).checkpoint()


def sorted_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """The inner join of two frames of which neither may be sent through the driver.

    Spark takes exploded rows to be as many as before, and compressed texts and counts as large as
    their files, and would broadcast by that estimate a side that the driver cannot hold.
    """
    return left.hint("merge").join(right.hint("merge"), on)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(col, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(parts))
