"""Confusion matrix and classification report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def confusion_long(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) for the combinations that occur."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n"))


def confusion_wide(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """One row per actual label in ``labels``, one column per predicted label in ``labels``."""
    cells = [
        F.count_if(F.col(predicted) == F.lit(v)).alias(str(v)) for v in labels
    ]
    seen = df.filter(F.col(actual).isin(labels)).groupBy(F.col(actual).alias("actual")).agg(*cells)
    known = df.sparkSession.createDataFrame([(v,) for v in labels], ["actual"])
    known = known.select(F.col("actual").cast(seen.schema["actual"].dataType).alias("actual"))
    return known.join(seen, "actual", "left").fillna(0)


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) per label, then accuracy and two averages.

    A ratio with nothing in the denominator is 0. The accuracy row repeats the accuracy in
    all three score columns and its support is the number of rows.
    """
    cells = confusion_long(df.select(F.col(actual).cast("string").alias("a"),
                                     F.col(predicted).cast("string").alias("p")), "a", "p")
    # One entry per label and role: rows where it is actual, predicted, or both.
    roles = cells.select(F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("bigint").alias("hit")),
    )).alias("s")).select("s.*")
    per = roles.groupBy("label").agg(F.sum("support").alias("support"), F.sum("called").alias("called"),
                                     F.sum("hit").alias("hit"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    per = per.select(
        "label", "support", "hit",
        ratio(F.col("hit"), F.col("called")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("called") + F.col("support")).alias("f1"),
    )
    scores = ["precision", "recall", "f1"]
    total = F.sum("support")
    summary = per.agg(
        total.alias("support"),
        ratio(F.sum("hit"), total).alias("accuracy"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[ratio(F.sum(F.col(s) * F.col("support")), total).alias(f"weighted_{s}") for s in scores],
    )
    summary = summary.select("support", F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), *[F.col("accuracy").alias(s) for s in scores]),
        F.struct(F.lit("macro avg").alias("label"), *[F.col(f"macro_{s}").alias(s) for s in scores]),
        F.struct(F.lit("weighted avg").alias("label"), *[F.col(f"weighted_{s}").alias(s) for s in scores]),
    )).alias("r")).select("r.*", "support")
    return per.select("label", *scores, "support").unionByName(summary)


def report_dict(report: DataFrame) -> dict:
    """The report as a nested dict, as saved with the metrics."""
    out = {}
    for r in report.collect():
        if r["label"] == "accuracy":
            out["accuracy"] = r["precision"]
        else:
            out[r["label"]] = {"precision": r["precision"], "recall": r["recall"],
                               "f1-score": r["f1"], "support": r["support"]}
    return out
