"""Baselines with Spark ML: bag of tokens, and the shuffled-label null that shows leaks."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bag_of_tokens(df: DataFrame, items: str, label: str, key: str, features: int = 1 << 12, shuffle_labels: bool = False, seed: int = 13) -> float:
    """Held-out AUC of a logistic regression on hashed tokens; a fifth of the keys, by hash, is held out.

    With ``shuffle_labels`` each training row takes its label from a seeded hash of its key, with
    the training base rate; what is left above 0.5 is then a leak.
    """
    rows = df.select(F.col(items).alias("items"), F.col(label).cast("double").alias("label"), F.pmod(F.xxhash64(key), F.lit(5)).alias("fold"), F.col(key).alias("key"))
    train, test = rows.filter("fold != 0"), rows.filter("fold = 0")
    if shuffle_labels:
        base = train.agg(F.avg("label")).first()[0]
        train = train.withColumn("label", (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1_000_000)) < base * 1_000_000).cast("double"))
    model = Pipeline(stages=[HashingTF(inputCol="items", outputCol="features", numFeatures=features), LogisticRegression(maxIter=20, regParam=0.01)]).fit(train)
    return BinaryClassificationEvaluator().evaluate(model.transform(test))
