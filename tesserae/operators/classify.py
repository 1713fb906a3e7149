"""Cross-validated binary classifiers on a feature table (MLlib)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similarity import stratified_folds


def cross_validate(rows: DataFrame, features: list[str], label: str = "label", k: int = 5, kind: str = "logistic", seed: int = 42) -> DataFrame:
    """(fold, auc, f1) of a scaled, class-balanced logistic regression or of boosted trees, over rows with an id."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    x = stratified_folds(rows, label, k, seed).withColumn("y", F.col(label).cast("double")).cache()
    spark, out = rows.sparkSession, []
    head = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)]
    for fold in range(k):
        train, test = x.filter(F.col("fold") != fold), x.filter(F.col("fold") == fold)
        share = train.agg(F.avg("y")).first()[0] or 0.0
        train = train.withColumn("wt", F.when(F.col("y") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
        last = LogisticRegression(featuresCol="x", labelCol="y", weightCol="wt", maxIter=30) if kind == "logistic" else GBTClassifier(featuresCol="x", labelCol="y", maxIter=15, maxDepth=3, seed=seed)
        scored = Pipeline(stages=[*head, last]).fit(train).transform(test)
        auc = BinaryClassificationEvaluator(labelCol="y").evaluate(scored)
        n = scored.agg(*[F.sum(((F.col("y") == a) & (F.col("prediction") == b)).cast("int")).alias(f"n{a}{b}") for a, b in ((1, 1), (0, 1), (1, 0))]).first()
        out.append((fold, float(auc), 2.0 * (n[0] or 0) / max(1, 2 * (n[0] or 0) + (n[1] or 0) + (n[2] or 0))))
    x.unpersist()
    return spark.createDataFrame(out, "fold int, auc double, f1 double")
