"""Labeled flows against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowsieve.functions.labels import suspicious
from flowsieve.operators.metrics import classification_report, confusion_wide
from flowsieve.operators.truth import tag_attacks
from flowsieve.plans.training import PREDICTION, Model, predict
from flowsieve.schema import VALIDATION_COLUMNS, col_name, require_columns


def relink(labeled: DataFrame, flows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Readable columns back on the labeled rows; a clashing name gets ``_human``.

    Both sides have one row per flow, so the join key cannot be skewed.
    """
    keep = [c for c in (keep or [col_name(c) for c in VALIDATION_COLUMNS]) if c in flows.columns]
    right = flows.select(
        "flow_id", F.col("flow_id").alias("flow_id_human"),
        *[F.col(c).alias(f"{c}_human" if c in labeled.columns else c) for c in keep])
    return labeled.join(right, "flow_id", "left")


def evaluate_attacks(validation: DataFrame, tuples: DataFrame, model: Model | None = None,
                     prediction: str = PREDICTION) -> DataFrame:
    """Add ``Actual_Is_Attack``, the prediction (unless already there), ``Predicted_Is_Attack``."""
    require_columns(validation, ["src_ip", "dest_ip", "dest_port"])
    rows = tag_attacks(validation, tuples)
    if prediction not in rows.columns:
        if model is None:
            raise ValueError(f"no column {prediction} and no model")
        rows = predict(model, rows, prediction)
    return rows.withColumn("Predicted_Is_Attack", suspicious(F.col(prediction)).cast("int"))


def attack_report(evaluated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Binary classification report and the 2 x 2 confusion matrix of labels 0 and 1."""
    pair = ("Actual_Is_Attack", "Predicted_Is_Attack")
    return classification_report(evaluated, *pair), confusion_wide(evaluated, *pair, [0, 1])


def truth_is_one_sided(evaluated: DataFrame) -> bool:
    """Only one class in the ground truth: recall says nothing about this table."""
    return evaluated.select("Actual_Is_Attack").distinct().limit(2).count() < 2
