"""Which features tell groups apart, by a forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_importance(rows: DataFrame, label: str, features: list[str], trees: int = 200, depth: int = 5, seed: int = 42) -> DataFrame:
    """(feature, importance): how much each feature lowers the impurity of `label` over a forest's trees; they sum to 1.

    A missing or non-finite feature counts as 0, rows without a label are left out. No importance is given (all are 0)
    where no split tells labels apart; a table without labelled rows gives no rows.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    value = lambda c: F.coalesce(F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.nanvl(F.col(c).cast("double"), F.lit(0.0))), F.lit(0.0))
    made = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("__group"), *[value(c).alias(f"__f{i}") for i, c in enumerate(features)])
    if made.isEmpty():
        return rows.sparkSession.createDataFrame([], "feature string, importance double")
    made = StringIndexer(inputCol="__group", outputCol="__label", stringOrderType="alphabetAsc").fit(made).transform(made)
    made = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol="__x").transform(made)
    if made.select("__label").distinct().count() == 1:
        found = [0.0] * len(features)
    else:
        forest = RandomForestClassifier(labelCol="__label", featuresCol="__x", numTrees=trees, maxDepth=depth, seed=seed)
        found = forest.fit(made).featureImportances.toArray().tolist()
    return rows.sparkSession.createDataFrame(list(zip(features, found, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")
