"""Where a running total over ordered keys meets a quota, per group, without sorting.

A histogram of the key's top digit shows the digit in which the quota runs out; the next
pass looks only at rows with that digit, and so on. Each pass is a grouped sum with partial
aggregation, so neither a hot group nor a hot key meets in one task; a group has at most
2^DIGIT sums. Passes end as soon as every cut lies in front of a single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowsieve.runtime import stage

DIGIT = 16
PLACE_BITS = 64


def weighted_cuts(rows: DataFrame, quotas: DataFrame, group: str, keys: dict[str, int], weight: str, nearer: bool = False) -> DataFrame:
    """(group, cut_<key>..., left) for each group of ``quotas`` (group, quota) whose rows weigh more.

    Rows of the group whose keys are, in order, below the cut weigh ``quota - left`` together;
    the row at the cut weighs more than ``left``. A group that fits its quota whole has no row
    here. With ``nearer``, the row at the cut comes below it where that lands nearer to the quota; ``left`` is then negative.
    ``keys`` are non-negative bigints, with the number of bits they use. Together they should be unique within a
    group; rows that share all keys are cut in front of all of them.
    """
    names = list(keys)
    state = quotas.select(group, F.col("quota").cast("double").alias("left"),
                          *[F.lit(0).cast("bigint").alias(f"cut_{k}") for k in names])
    slim = rows.select(group, *names, F.col(weight).alias("_w"))
    for at, key in enumerate(names):
        top = -(-keys[key] // DIGIT) * DIGIT
        for shift in range(top - DIGIT, -1, -DIGIT):
            above = shift + DIGIT
            inside = [F.col(k) == F.col(f"cut_{k}") for k in names[:at]]
            if above < top:
                inside.append(F.shiftright(key, above) == F.shiftright(f"cut_{key}", above))
            near = slim.join(state, group)
            for condition in inside:
                near = near.filter(condition)
            digit = F.shiftright(key, shift).bitwiseAND(F.lit(2 ** DIGIT - 1).cast("bigint"))
            sums = near.groupBy(group, digit.alias("_digit")).agg(F.sum("_w").alias("_w"), F.count("*").alias("_n"))
            upto = F.sum("_w").over(Window.partitionBy(group).orderBy("_digit"))
            first = (
                sums.withColumn("_upto", upto).join(state.select(group, "left"), group)
                .filter(F.col("_upto") > F.col("left")).groupBy(group)
                .agg(F.min_by(F.struct("_digit", (F.col("_upto") - F.col("_w")).alias("_below"), "_n", "_w"), "_digit").alias("f"))
            )
            state = stage(state.join(first, group).select(
                group, (F.col("left") - F.col("f._below")).alias("left"),
                *[(F.col(f"cut_{k}") + F.shiftleft("f._digit", shift)).alias(f"cut_{k}") if k == key
                  else F.col(f"cut_{k}") for k in names],
                F.col("f._n").alias("_n"), F.col("f._w").alias("_at")), "cuts")
            if state.filter("_n > 1").isEmpty() or key == names[-1] and not shift:
                return _behind(state, key, shift) if nearer else state.drop("_n", "_at")
            state = state.drop("_n", "_at")
    return state


def _behind(state: DataFrame, key: str, shift: int) -> DataFrame:
    """Cuts moved behind the row in front of which they lie, where that is nearer to the quota."""
    moves = (F.col("_n") == 1) & (F.col("_at") - F.col("left") < F.col("left"))
    return state.withColumns({
        f"cut_{key}": F.when(moves, F.col(f"cut_{key}") + F.lit(1 << shift).cast("bigint")).otherwise(F.col(f"cut_{key}")),
        "left": F.when(moves, F.col("left") - F.col("_at")).otherwise(F.col("left"))}).drop("_n", "_at")


def below_cut(keys: list[str]):
    """Condition that a row's keys come before the cut."""
    condition = F.lit(False)
    for key in reversed(keys):
        condition = (F.col(key) < F.col(f"cut_{key}")) | ((F.col(key) == F.col(f"cut_{key}")) & condition)
    return condition

