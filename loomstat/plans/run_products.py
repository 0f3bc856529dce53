"""The outputs of the product analysis: master, reviews, market tables, terms.

python -m loomstat.plans.run_products --data DIR --out DIR: the tables of DIR as products and reviews; reviews and
kept terms as Parquet, every table for a report as a CSV folder.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.operators import market
from loomstat.sources.files import write_csv
from loomstat.sources.frames import corpus, products, reviews

CUTS = [925.0, 950.0, 975.0]


def outputs(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Tables to be kept as Parquet, and those for reports."""
    goods = market.valid_products(products(spark, sf_dir))
    stars = reviews(spark, sf_dir).join(goods.select("product_id"), "product_id", "left_semi")
    texts = market.non_empty(corpus(spark, sf_dir, products(spark, sf_dir).count()))
    texts = market.keep_first(texts, F.lower(F.trim("text")), "doc_id").drop("copies")
    master = market.product_master(goods, stars, CUTS)
    shares = [0.05, 0.25, 0.5, 0.75, 0.95]
    kept = {"reviews_analysis": stars, "texts_analysis": texts, "terms_analysis": market.kept_terms(market.terms(texts), 3, 0.5)}
    report = {
        "product_master": master, "market_size": market.size_by(stars, goods, "form"), "brands": market.size_by(stars, goods, "store"), "positioning": market.positioning(stars, goods),
        "concentration": market.concentration(master), "lorenz": market.lorenz(master), "price_quantiles": market.quantiles(goods, "price", shares, ["form"]),
    }
    return kept, report


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Write everything; returns the paths."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    kept, report = outputs(spark or SparkSession.builder.getOrCreate(), args.data)
    done = []
    for name, df in kept.items():
        done.append(f"{args.out}/{name}.parquet")
        df.write.mode("overwrite").parquet(done[-1])
    return done + [write_csv(df, f"{args.out}/{name}") for name, df in report.items()]


if __name__ == "__main__":
    main()
