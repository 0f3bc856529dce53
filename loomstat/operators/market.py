"""Market structure, concentration and weighted keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def size_by(reviews: DataFrame, products: DataFrame, by: str) -> DataFrame:
    """Products, reviews, mean stars and price, and the share of reviews of each group.

    Reviews are added up per product before they meet the products.
    """
    per = reviews.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.sum("stars").alias("stars"))
    groups = products.join(per, "product_id", "left").groupBy(by).agg(
        F.count(F.lit(1)).alias("n_products"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_reviews"), F.expr("try_divide(sum(stars), sum(n))").alias("mean_stars"), F.avg("price").alias("mean_price")
    )
    return groups.withColumn("share", F.col("n_reviews") / F.sum("n_reviews").over(Window.partitionBy(F.lit(1))))


def category_level(category: str, level: int, separator: str = " ") -> Column:
    """A level, from 1, of a category path in a text column, null where the path is shorter; -1 is the leaf."""
    return F.expr(f"try_element_at(filter(split({category}, '{separator}'), x -> x <> ''), {level})")


def valid_products(products: DataFrame, name: str = "name", price: str = "price") -> DataFrame:
    """Products with an id, a name that is not blank and a positive price."""
    return products.where(F.col("product_id").isNotNull() & (F.length(F.trim(name)) > 0) & (F.col(price) > 0))


def non_empty(reviews: DataFrame, text: str = "text") -> DataFrame:
    """Reviews whose text has more than white space."""
    return reviews.where(F.coalesce(F.col(text), F.lit("")).rlike(r"\S"))


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """Of rows with an equal ``key`` the one with the smallest ``order``, whole, with ``copies``, how many there
    were; a null order comes last, ties go to the smallest row. Counted before the shuffle, so that a
    key of very many rows is no load."""
    columns = [c for c in rows.columns if c != order]
    one = F.struct(F.col(order).isNull().alias("none"), F.col(order), *columns)
    found = rows.groupBy(key.alias("_key")).agg(F.min(one).alias("_first"), F.count(F.lit(1)).alias("copies"))
    return found.select(*(F.col(f"_first.{c}").alias(c) for c in rows.columns), "copies")


def quantiles(rows: DataFrame, column: str, shares: list[float], by: list[str] = ()) -> DataFrame:
    """``by, share, value``: interpolated quantiles from counts of distinct values."""
    found = rows.groupBy(*by).agg(F.percentile(column, F.array(*map(F.lit, shares))).alias("_q"))
    return found.select(*by, F.posexplode("_q").alias("_i", "value")).select(*by, F.element_at(F.array(*map(F.lit, shares)), F.col("_i") + 1).alias("share"), "value")


def product_master(products: DataFrame, reviews: DataFrame, cuts: list[float]) -> DataFrame:
    """``products`` with ``band, n_reviews, mean_stars, first_year, last_year, verified_share``; no reviews count 0."""
    per = reviews.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.avg("stars").alias("mean_stars"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.avg(F.col("verified").cast("int")).alias("verified_share")
    )
    return price_band(products, cuts).join(per, "product_id", "left").withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0)))


def lorenz(shares: DataFrame, value: str = "n_reviews") -> DataFrame:
    """``value, share_of_rows, share_of_value``: the curve, a point for each distinct value in rising order."""
    bins = shares.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    up, whole = Window.partitionBy(F.lit(1)).orderBy("value").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(F.lit(1))
    mass = F.col("value") * F.col("c")
    return bins.select("value", (F.sum("c").over(up) / F.sum("c").over(whole)).alias("share_of_rows"), (F.sum(mass).over(up) / F.sum(mass).over(whole)).alias("share_of_value"))


def top(groups: DataFrame, by: str, k: int, measure: str = "n_reviews") -> DataFrame:
    """The ``k`` rows with the largest ``measure``, ties by the group's name."""
    return groups.orderBy(F.col(measure).desc(), by).limit(k)


def kept_terms(tf: DataFrame, min_df: int, max_share: float, stop_words: DataFrame | None = None) -> DataFrame:
    """``tf`` without terms of fewer than ``min_df`` products or more than ``max_share`` of all, nor those of the
    column ``term`` of ``stop_words``."""
    n = tf.agg(F.count_distinct("product_id")).scalar()
    keep = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_share * n)).select("term")
    if stop_words is not None:
        keep = keep.join(stop_words.select("term"), "term", "left_anti")
    return tf.join(keep, "term", "left_semi")


def price_band(products: DataFrame, cuts: list[float]) -> DataFrame:
    """``products`` with ``band``: how many cuts lie below or at the price."""
    return products.withColumn("band", sum((F.when(F.col("price") >= c, 1).otherwise(0) for c in cuts), F.lit(0)))


def positioning(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """``price_side, rating_side, n_products, n_reviews, mean_price, mean_stars``: products with
    reviews, on either side of the mean price and of the mean of their mean stars.

    A null price or rating is on neither side, and its side is null.
    """
    per = reviews.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.avg("stars").alias("stars"))
    rows = products.select("product_id", "price").join(per, "product_id")
    price, stars = rows.agg(F.avg("price"), F.avg("stars")).first()
    side = lambda c, cut: F.when(F.col(c) >= cut, "high").when(F.col(c) < cut, "low")
    return rows.groupBy(side("price", price).alias("price_side"), side("stars", stars).alias("rating_side")).agg(
        F.count(F.lit(1)).alias("n_products"), F.sum("n").alias("n_reviews"), F.avg("price").alias("mean_price"), F.avg("stars").alias("mean_stars")
    )


def concentration(shares: DataFrame, value: str = "n_reviews") -> DataFrame:
    """``n, hhi, gini, top10_share`` of one value per row.

    Rows with equal values are one row of a distribution, so ranks are summed over the distinct
    values and the window sees only those.
    """
    bins = shares.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy(F.lit(1)).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.withColumn("end", F.sum("c").over(up)).withColumn("all", F.sum("c").over(Window.partitionBy(F.lit(1))))
    ranks = F.col("end") * (F.col("end") + 1) / 2 - (F.col("end") - F.col("c")) * (F.col("end") - F.col("c") + 1) / 2
    top = F.ceil(F.col("all") * 0.1)
    in_top = F.greatest(F.lit(0), F.least(F.col("c"), F.col("end") - (F.col("all") - top)))
    total = F.sum(F.col("v") * F.col("c"))
    sums = ranked.agg(
        F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("v") * F.col("c")) / total / total).alias("hhi"), total.cast("double").alias("t"), F.sum(F.col("v") * ranks).alias("r"), (F.sum(F.col("v") * in_top) / total).alias("top10_share")
    )
    return sums.select("n", "hhi", (2 * F.col("r") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n")).alias("gini"), "top10_share")


def terms(corpus: DataFrame, min_length: int = 2) -> DataFrame:
    """``product_id, term, tf``: lower-cased runs of word characters."""
    words = corpus.select("product_id", F.explode(F.split(F.lower("text"), r"\W+")).alias("term"))
    return words.where(F.length("term") >= min_length).groupBy("product_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def weighted_terms(tf: DataFrame) -> DataFrame:
    """``term, df, market, product_equal``: a term's share of all words, and its mean share over
    products, absent terms counting zero."""
    totals = tf.groupBy("product_id").agg(F.sum("tf").alias("total"))
    by = tf.join(totals, "product_id").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("words"), F.sum(F.col("tf") / F.col("total")).alias("share"))
    # Subqueries of one row: their shuffles are those of the rows above.
    n_words, n_products = totals.agg(F.sum("total").cast("double")).scalar(), totals.agg(F.count(F.lit(1)).cast("double")).scalar()
    return by.select("term", "df", (F.col("words") / n_words).alias("market"), (F.col("share") / n_products).alias("product_equal"))


def tfidf(tf: DataFrame) -> DataFrame:
    """``product_id, term, tfidf`` with the smooth weight ln((1 + n) / (1 + df)) + 1, not normalised."""
    n = tf.agg(F.count_distinct("product_id").cast("double")).scalar()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return tf.join(df, "term").select("product_id", "term", (F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1)).alias("tfidf"))


def keyword_contrast(tf: DataFrame, groups: DataFrame) -> DataFrame:
    """``term, log_odds``: smoothed log-odds of a term in group 1 against group 0.

    ``groups`` has ``product_id`` and ``g``.
    """
    by = tf.join(groups, "product_id").groupBy("term").agg(F.sum(F.when(F.col("g") == 1, F.col("tf")).otherwise(0)).alias("a"), F.sum(F.when(F.col("g") == 0, F.col("tf")).otherwise(0)).alias("b"))
    odds = lambda c: F.log((F.col(c) + 0.5) / (by.agg(F.sum(c).cast("double")).scalar() - F.col(c) + 0.5))
    return by.select("term", "a", "b", (odds("a") - odds("b")).alias("log_odds"))


def group_keywords(tf: DataFrame, groups: DataFrame, k: int = 10) -> DataFrame:
    """``g, term, a, log_odds, k``: the k terms of each group with the largest smoothed log-odds
    against all other groups, ties by term.

    ``groups`` has ``product_id`` and ``g``; products without a group take no part. Counts are
    added up by group and term first; terms beyond k are dropped before the groups are dealt.
    """
    by = tf.join(groups.where("g IS NOT NULL"), "product_id").groupBy("g", "term").agg(F.sum("tf").alias("a"))
    sizes = by.groupBy("g").agg(F.sum("a").alias("na"))
    whole = by.agg(F.sum("a")).scalar()
    rows = by.join(by.groupBy("term").agg(F.sum("a").alias("all")), "term").join(sizes, "g")
    odds = lambda c, n: F.log((c + 0.5) / (n - c + 0.5))
    scored = rows.select("g", "term", "a", F.round(odds(F.col("a"), F.col("na")) - odds(F.col("all") - F.col("a"), whole - F.col("na")), 6).alias("log_odds"))
    return scored.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.col("log_odds").desc(), "term"))).where(F.col("k") <= k)
