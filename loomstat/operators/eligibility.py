"""Product eligibility: a rule baseline, a calibrated model, and a multi-class form model."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_label(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that the text matches; null texts get the default."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(F.coalesce(text.rlike(pattern), F.lit(False)), label).otherwise(out)
    return out


def in_category(products: DataFrame, path: str, wanted: list[str], unwanted: list[str] = (), separator: str = " > ") -> DataFrame:
    """Products whose category path, a text column, has a level among ``wanted`` and none among ``unwanted``;
    a null path has no level."""
    levels = F.split(F.coalesce(F.col(path), F.lit("")), separator)
    has = lambda names: F.arrays_overlap(levels, F.array(*map(F.lit, names))) if names else F.lit(False)
    return products.where(has(list(wanted)) & ~has(list(unwanted)))


def _features(text_col: str, buckets: int) -> list:
    return [RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"\W+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=buckets, binary=True)]


def calibrated(gold: DataFrame, products: DataFrame, text_col: str = "text", label_col: str = "label", key: str = "product_id", buckets: int = 4096) -> DataFrame:
    """``products`` with ``raw`` and ``probability``: logistic regression on four fifths of the gold
    labels, isotonic calibration on the rest. Rows with a null text or label take no part."""
    sound = gold.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).withColumn(label_col, F.col(label_col).cast("double"))
    held = F.pmod(F.xxhash64(key), F.lit(5)) == 0
    model = Pipeline(stages=[*_features(text_col, buckets), LogisticRegression(featuresCol="_tf", labelCol=label_col, regParam=0.01, maxIter=50)]).fit(sound.where(~held))
    raw = lambda df: model.transform(df).withColumn("raw", vector_to_array("probability")[1]).drop("_words", "_tf", "rawPrediction", "probability", "prediction")
    isotonic = IsotonicRegression(featuresCol="raw", labelCol=label_col, predictionCol="probability").fit(raw(sound.where(held)))
    return isotonic.transform(raw(products.where(F.col(text_col).isNotNull())))


def forms(gold: DataFrame, products: DataFrame, text_col: str = "text", label_col: str = "label", buckets: int = 4096) -> DataFrame:
    """``products`` with ``form``, the class index of a multinomial logistic regression fitted on
    all gold rows with a text and a label; null for null texts."""
    sound = gold.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).withColumn(label_col, F.col(label_col).cast("double"))
    model = Pipeline(stages=[*_features(text_col, buckets), LogisticRegression(featuresCol="_tf", labelCol=label_col, family="multinomial", regParam=0.01, maxIter=50)]).fit(sound)
    named = model.transform(products.withColumn("_given", F.col(text_col)).withColumn(text_col, F.coalesce(text_col, F.lit(""))))
    form = F.when(F.col("_given").isNotNull(), F.col("prediction").cast("int"))
    return named.withColumn("form", form).withColumn(text_col, F.col("_given")).drop("_given", "_words", "_tf", "rawPrediction", "probability", "prediction")
