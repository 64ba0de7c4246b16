"""The older one-script variant: clusters of 10, one-sentence contexts, exemplar-only labels."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from flowsieve.functions.context import legacy_context_text
from flowsieve.operators.density import density_cluster
from flowsieve.operators.propagate import propagate_legacy
from flowsieve.operators.reduce import principal_components
from flowsieve.operators.select import exemplars, outliers
from flowsieve.plans.labeling import CLUSTER_COLUMNS, flow_features, readable
from flowsieve.runtime import stage
from flowsieve.schema import FEATURES, LEGACY_EMPTY_LABEL

Scorer = Callable[[Iterable[str]], Iterable["tuple[str, float] | None"]]


def zero_shot(contexts: DataFrame, scorer: Scorer) -> DataFrame:
    """(label, score) per context from the user's scorer; no answer gives the default, score 0."""

    def ask(batches):
        for batch in batches:
            answers = [a or (LEGACY_EMPTY_LABEL, 0.0) for a in scorer(list(batch["context"]))]
            yield batch.assign(label=[a[0] for a in answers], score=[float(a[1]) for a in answers])

    return contexts.mapInPandas(ask, StructType([
        *contexts.schema.fields, StructField("label", StringType()), StructField("score", DoubleType())]))


def label_flows(events: DataFrame, scorer: Scorer, eps: float | None = None) -> DataFrame:
    """Features and ``target_label`` per flow."""
    features, _ = flow_features(events)
    reduced, names = principal_components(features, FEATURES)
    clustered = stage(
        density_cluster(reduced, "flow_id", names, eps, min_cluster_size=10).drop(*names), "clustered")
    flows = readable(clustered, CLUSTER_COLUMNS)

    def reviewed(rows: DataFrame) -> DataFrame:
        return stage(zero_shot(rows.select("flow_id", legacy_context_text(rows).alias("context")), scorer),
                     "reviewed")

    return propagate_legacy(
        clustered.select(*FEATURES, "flow_id"), reviewed(exemplars(flows)),
        reviewed(outliers(flows, None))
    ).select(*FEATURES, "target_label", "flow_id")
