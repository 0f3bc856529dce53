"""Sources and sinks: CSV with tidy headers, JSON lines with a count of bad rows, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tidy_names(df: DataFrame) -> DataFrame:
    """Column names stripped and in lower case."""
    return df.toDF(*(c.strip().lower() for c in df.columns))


def require(df: DataFrame, columns) -> DataFrame:
    """``df`` itself, or ValueError with the sorted missing columns."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_units(spark: SparkSession, path: str, required=(), schema: T.StructType | None = None) -> DataFrame:
    """A CSV of randomised units, gzip too. A missing path raises Spark's PATH_NOT_FOUND."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return require(tidy_names(reader.csv(path)), required)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> str:
    """Write a small result as one CSV part, replacing what is there."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("compression", compression).csv(path)
    return path


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under a schema; malformed rows keep their text in ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def parse_quality(json_text: DataFrame, column: str, schema: str) -> DataFrame:
    """``n_rows, n_bad, n_empty`` of a column of JSON documents."""
    parsed = json_text.select(F.col(column).alias("raw"), F.from_json(column, schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("v"))
    return parsed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("raw").isNotNull() & F.col("v._corrupt_record").isNotNull()).alias("n_bad"),
        F.count_if(F.col("raw").isNull() | (F.trim("raw") == "")).alias("n_empty"),
    )
