"""Multi-class boosted trees on the labeled flows."""

from __future__ import annotations

import time

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsieve.operators.boosting import BoostedTrees, boost
from flowsieve.operators.metrics import classification_report, confusion_wide, report_dict
from flowsieve.operators.split import class_weights, train_test
from flowsieve.runtime import stage
from flowsieve.schema import DOTTED_NAME, FEATURES, Settings, require_columns

PREDICTION = "predicted_label"
Model = BoostedTrees | PipelineModel


def fit(train: DataFrame, settings: Settings = Settings(), label: str = "target_label",
        key: str = "flow_id", features: list[str] = FEATURES, method: str = "boosted"
        ) -> Model:
    """A model from features to ``predicted_label``; apply it with ``predict``.

    ``boosted`` adds trees for all classes together and stops on a validation slice cut from the
    training rows (see ``operators.boosting``); ``forest`` is one random forest. Classes are weighted
    inversely to their size; rows without a label are left out. Features are an allow-list, so no id can leak in.
    """
    require_columns(train, [key, label, *features], "training")
    weights = class_weights(train.filter(F.col(label).isNotNull()), label)
    labels = sorted(r[0] for r in weights.select(label).collect())  # one row per class
    if len(labels) < 2:
        raise ValueError("training needs at least two classes")
    rows = train_test(train.select(key, label, *features), key, label, 0.1, settings.seed + 1)
    rows = rows.join(F.broadcast(weights.select(label, "weight")), label)  # one row per class
    if method == "forest":
        return _forest(rows, settings, label, features)
    number = (F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label)) - 1).cast("int")
    ready = stage(rows.select(*features, number.alias("label"), F.col("weight").cast("double").alias("weight"),
                              (F.col("split") == "test").alias("held")), "training")
    return boost(ready, list(features), [str(v) for v in labels], settings.iterations, settings.depth, settings.learning_rate,
                 settings.patience)


def _forest(rows: DataFrame, settings: Settings, label: str, features: list[str]) -> PipelineModel:
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    ready = stage(assembler.transform(indexer.transform(rows)).select("_features", "_label", "weight"), "training")
    back = IndexToString(inputCol="_predicted", outputCol=PREDICTION, labels=indexer.labels)
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="_label", weightCol="weight", maxDepth=settings.depth,
        seed=settings.seed, numTrees=settings.iterations, predictionCol="_predicted")
    return PipelineModel([assembler, forest.fit(ready), back])


def predict(model: Model, rows: DataFrame, prediction: str = PREDICTION) -> DataFrame:
    """All input columns plus the predicted label. Narrow, so it also runs on a stream."""
    if isinstance(model, BoostedTrees):
        return rows.withColumn(prediction, model.predict(*[F.col(f) for f in model.features]))
    out = rows
    for step in model.stages:
        out = step.transform(out)
    return out.select(*rows.columns, F.col(PREDICTION).alias(prediction))


def feature_importance(spark: SparkSession, model: Model, features: list[str] = FEATURES) -> DataFrame:
    """(Feature, Importance), highest first: shares of the gain of all splits, or of the forest's impurity."""
    if isinstance(model, BoostedTrees):
        features, values = model.features, model.importances()
    else:
        values = next(s for s in model.stages if hasattr(s, "featureImportances")).featureImportances.toArray()
    rows = [(DOTTED_NAME.get(f, f), float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "Feature string, Importance double").orderBy(
        F.desc("Importance"), "Feature")


def train_and_measure(train: DataFrame, test: DataFrame, settings: Settings = Settings(),
                      features: list[str] = FEATURES, label: str = "target_label",
                      key: str = "flow_id", method: str = "boosted",
                      model_file: str = "", importance_file: str = "") -> tuple[Model, dict]:
    """Fit, score the held-out rows, and collect the twelve metrics."""
    started = time.perf_counter()
    model = fit(train, settings, label, key, features, method)
    train_seconds = time.perf_counter() - started

    scored = predict(model, test)
    started = time.perf_counter()
    scored = stage(scored.select(label, PREDICTION), "scored")  # a full pass over the test rows
    seconds = time.perf_counter() - started

    n_train, n_test = train.count(), test.count()
    labels = [r[0] for r in test.select(label).distinct().orderBy(label).collect()]
    matrix = {r["actual"]: [r[v] for v in labels]
              for r in confusion_wide(scored, label, PREDICTION, labels).collect()}
    metrics = {  # the twelve keys are fixed
        "dataset": settings.dataset,
        "train_rows": n_train,
        "test_rows": n_test,
        "train_seconds": train_seconds,
        "prediction_seconds": seconds,
        "latency_per_alert_seconds": seconds / max(n_test, 1),
        "events_per_second": n_test / seconds,
        "classification_report": report_dict(classification_report(scored, label, PREDICTION)),
        "confusion_matrix_labels": labels,
        "confusion_matrix": [matrix[v] for v in labels],
        "model_file": model_file,
        "feature_importance_file": importance_file,
    }
    return model, metrics
