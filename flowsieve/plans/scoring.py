"""Score fresh logs with a saved model and scaler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowsieve.functions.context import alert_message
from flowsieve.functions.labels import suspicious
from flowsieve.operators.collapse import collapse
from flowsieve.operators.features import apply_scaler, feature_matrix
from flowsieve.plans.training import Model, predict

DIAGNOSIS = "diagnosis"


def is_threat(label: Column, benign_labels: list[str] | None = None) -> Column:
    """Not in ``benign_labels``; by default, every label that names a threat."""
    return suspicious(label) if benign_labels is None else ~label.isin(benign_labels)


def score_flows(flows: DataFrame, model: Model, params: dict, keep: list[str]) -> DataFrame:
    """``keep`` columns and the diagnosis of every flow. Narrow: nothing is shuffled.

    The scaler is only applied, never fitted, so this also runs on a stream.
    """
    copies = flows.withColumns({f"h_{c}": F.col(c) for c in keep})
    rows = apply_scaler(feature_matrix(copies, keep=[f"h_{c}" for c in keep]), params)
    scored = predict(model, rows, DIAGNOSIS)
    return scored.select(*[F.col(f"h_{c}").alias(c) for c in keep], DIAGNOSIS)


def alerts(scored: DataFrame, benign_labels: list[str] | None = None) -> DataFrame:
    """The threats, each with its alert line."""
    threats = scored.filter(is_threat(F.col(DIAGNOSIS), benign_labels))
    return threats.withColumn(
        "message", alert_message(F.col(DIAGNOSIS), F.col("src_ip"), F.col("dest_ip")))


def score_batch(events: DataFrame, model: Model, params: dict,
                benign_labels: list[str] | None = None) -> DataFrame:
    """Alert rows of one batch of events."""
    return alerts(
        score_flows(collapse(events), model, params, ["flow_id", "src_ip", "dest_ip"]), benign_labels)
