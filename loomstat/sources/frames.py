"""The analytical frames: randomised units, products and reviews, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUTOFF = "2001-02-01"
CONTRASTS = ((1, 0), (2, 0), (1, 2))
OUTCOMES = ("spend", "visit", "conversion")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per customer: arm, features before the cutoff, outcomes after it."""
    cut = F.lit(CUTOFF).cast("timestamp")
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")
    before, paid = F.col("o_orderdate") < cut, (F.col("o_orderdate") >= cut) & (F.col("o_orderstatus") != "O")
    per = orders.groupBy("o_custkey").agg(
        F.max(F.when(before, F.col("o_orderdate"))).alias("last"),
        F.sum(F.when(before, F.col("o_totalprice"))).alias("history"),
        F.count_if(before).alias("n_before"),
        F.max(F.when(before & F.col("o_orderpriority").startswith("1"), 1).otherwise(0)).alias("mens"),
        F.max(F.when(before & F.col("o_orderpriority").startswith("2"), 1).otherwise(0)).alias("womens"),
        F.max(F.when(~before, 1).otherwise(0)).alias("visit"),
        F.max(F.when(paid, 1).otherwise(0)).alias("conversion"),
        F.coalesce(F.sum(F.when(paid, F.col("o_totalprice"))), F.lit(0.0)).alias("spend"),
    )
    nation = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("zip_code"))
    people = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("channel"))
    joined = people.join(per, people["c_custkey"] == per["o_custkey"], "left").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    return joined.select(
        F.col("c_custkey").alias("unit_id"), (F.col("c_custkey") % 3).cast("int").alias("arm"), zero("visit"), zero("conversion"), F.coalesce("spend", F.lit(0.0)).alias("spend"),
        F.datediff(cut, F.col("last")).alias("recency"), "history", F.when(F.coalesce("n_before", F.lit(0)) <= 5, 1).otherwise(0).alias("newbie"), zero("mens"), zero("womens"), "channel", "zip_code",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("store"), F.col("p_type").alias("form"), F.col("p_retailprice").alias("price"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as reviews: stars from the quantity, the year of shipping, a verified flag."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.ceil(F.col("l_quantity") / 10).cast("int").alias("stars"), F.year("l_shipdate").alias("year"), (F.col("l_returnflag") != "R").alias("verified"), F.col("l_extendedprice").alias("amount"),
    )


def corpus(spark: SparkSession, sf_dir: str, n_products: int) -> DataFrame:
    """``product_id, doc_id, text``: documents dealt over products."""
    return read(spark, sf_dir, "documents").select((F.col("doc_id") % n_products).alias("product_id"), "doc_id", "text")


UNITS_SQL = f"""
units AS (
  SELECT c_custkey AS unit_id, CAST(c_custkey % 3 AS INTEGER) AS arm,
    CAST(coalesce(visit, 0) AS INTEGER) AS visit, CAST(coalesce(conversion, 0) AS INTEGER) AS conversion, coalesce(spend, 0.0::DOUBLE) AS spend,
    date_diff('day', last::DATE, DATE '{CUTOFF}') AS recency, history,
    CASE WHEN coalesce(n_before, 0) <= 5 THEN 1 ELSE 0 END AS newbie,
    coalesce(mens, 0) AS mens, coalesce(womens, 0) AS womens, c_mktsegment AS channel, r_name AS zip_code
  FROM customer
  LEFT JOIN (
    SELECT o_custkey,
      max(o_orderdate) FILTER (o_orderdate < TIMESTAMP '{CUTOFF}') AS last,
      sum(o_totalprice) FILTER (o_orderdate < TIMESTAMP '{CUTOFF}') AS history,
      count(*) FILTER (o_orderdate < TIMESTAMP '{CUTOFF}') AS n_before,
      max(CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' AND o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS mens,
      max(CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' AND o_orderpriority LIKE '2%' THEN 1 ELSE 0 END) AS womens,
      max(CASE WHEN o_orderdate >= TIMESTAMP '{CUTOFF}' THEN 1 ELSE 0 END) AS visit,
      max(CASE WHEN o_orderdate >= TIMESTAMP '{CUTOFF}' AND o_orderstatus <> 'O' THEN 1 ELSE 0 END) AS conversion,
      sum(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '{CUTOFF}' AND o_orderstatus <> 'O') AS spend
    FROM orders GROUP BY o_custkey
  ) ON c_custkey = o_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
)"""
