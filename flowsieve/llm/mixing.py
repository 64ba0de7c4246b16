"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every document gets a rate, the expected number of times the mix takes it. Of all rates that
meet each source's token target, entropy balancing (Hainmueller 2012) takes those nearest to
1 in relative entropy, weighted by tokens. The convex dual has one multiplier per source and
the rates are its exponential tilt, rate = exp(multiplier). Newton steps on the dual are
distributed: the gradient and the Hessian of a step are grouped sums over the documents.

Rates become whole copies: the floor of the rate for every document, and one copy more for
documents in hash order while the source's remaining target lasts. So a source ends within
one document of its target, and the choice depends on the rows only, not on partitioning. A mix then goes on behind
the document that did not fit, with those that do, until none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsieve.llm.cuts import PLACE_BITS, below_cut, weighted_cuts
from flowsieve.runtime import stage

WEIGHTS = [5, 2, 1]
SHARE = 1.5
LIMIT = 2
TOLERANCE = 1e-12
MAX_STEPS = 200


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.filter(parts, lambda w: w != "")).cast("bigint")


def source_targets(sources: DataFrame, weights: list[int] = WEIGHTS, share: float = SHARE,
                   limit: int = LIMIT) -> DataFrame:
    """Add ``target`` to (source, source_size): ``share`` of all tokens dealt by weight, none above ``limit`` times its size.

    Weights repeat over the sources by code point, null last. The excess of a full source goes to the others
    by weight until none is above: with the sources in order of limit by weight, a source is full
    if what the fuller ones before it leave would put it above its limit. One row per source.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    by_fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    ranked = (
        sources.withColumn("w", weight)
        .withColumn("room", F.col("source_size") * limit)
        .withColumn("total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("w_rest", F.sum("w").over(every) - F.sum("w").over(by_fill) + F.col("w"))
        .withColumn("before", F.sum("room").over(by_fill) - F.col("room"))
        .withColumn("full", (F.col("total") - F.col("before")) * F.col("w") > F.col("room").cast("double") * F.col("w_rest"))
    )
    left = F.first("total").over(every) - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(every), F.lit(0))
    w_open = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    target = F.when(F.col("full"), F.col("room").cast("double")).otherwise(left * F.col("w") / w_open)
    return ranked.withColumn("target", target).select("source", "source_size", "target")


def tilted_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Add ``rate`` to ``targets`` (skey, source_size, target): Newton steps on the dual until the tokens meet the targets.

    ``sizes`` is (skey, size, n). A source without tokens keeps rate 1.
    """
    state = stage(targets.withColumn("tilt", F.lit(0.0)), "tilt")
    for _ in range(MAX_STEPS):
        tokens = (F.col("n") * F.col("size")).cast("double") * F.exp("tilt")
        mass = sizes.join(state.select("skey", "tilt"), "skey").groupBy("skey").agg(F.sum(tokens).alias("mass"))
        # The gradient is mass - target and the Hessian is mass.
        step = F.when(F.col("mass") > 0, (F.col("target") - F.col("mass")) / F.col("mass")).otherwise(0.0)
        gap = F.when(F.col("mass") > 0, F.abs(F.col("mass") - F.col("target")) / F.col("target")).otherwise(0.0)
        state = stage(state.drop("gap").join(mass, "skey").select(
            *targets.columns, (F.col("tilt") + F.greatest(step, F.lit(-1.0))).alias("tilt"), gap.alias("gap")), "tilt")
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= TOLERANCE:
            return state.withColumn("rate", F.exp("tilt")).drop("tilt", "gap")
    raise RuntimeError(f"rates did not meet the targets in {MAX_STEPS} steps")


def _skey(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit(""))


def mixed(docs: DataFrame, columns: list[str], weights: list[int] = WEIGHTS, share: float = SHARE,
          limit: int = LIMIT, fill: bool = False) -> DataFrame:
    """Each row of (doc_id, text, source) as (row, size, source_size, target, copies); ``row`` holds ``columns``.

    Null text has size 0; null is a source of its own. Rows of a source are taken in the order
    of a digest of doc_id; rows that share it follow in the order they were read, which is the
    same for every run over the same files. A document without words is taken once. An empty
    table gives an empty one. With ``fill`` the rows behind the first that does not fit are taken too, in the same order, as
    far as they fit what is left.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = stage(docs.select(
        F.struct(*columns).alias("row"), "source", _skey().alias("skey"), n_words(F.col("text")).alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("_order"),
        F.monotonically_increasing_id().alias("_place")), "mix_rows")
    sizes = stage(rows.groupBy("skey", "source", "size").agg(F.count("*").alias("n")), "mix_sizes")
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sources, weights, share, limit).withColumn("skey", _skey())
    rates = tilted_rates(sizes.select("skey", "size", "n"), targets.drop("source"))
    plan = stage(rates.withColumn("whole", F.floor(F.round("rate", 9)).cast("bigint")).withColumn(
        "quota", F.col("target") - F.col("whole") * F.col("source_size")), "mix_plan")
    order = ["_order", "_place"]
    cuts = weighted_cuts(rows.select("skey", *order, "size"), plan, "skey", {"_order": 60, "_place": PLACE_BITS}, "size")
    more = (F.col("size") > 0) & (F.col("left").isNull() | below_cut(order))
    if fill:
        rows = rows.join(_filling(rows.select("skey", *order, "size"), cuts, order), "_place", "left")
        more = more | F.col("_fills").isNotNull()
    return (
        rows.join(plan.select("skey", "source_size", "target", "whole"), "skey").join(cuts, "skey", "left")
        .select("row", "size", "source_size", "target",
                F.least(F.col("whole") + more.cast("int"), F.lit(limit)).alias("copies"))
    )


def _filling(rows: DataFrame, cuts: DataFrame, order: list[str]) -> DataFrame:
    """(_place, _fills) of the rows behind the cut that fit what is left, each turn cut again among the rows that still do.

    The row at a cut is larger than what is left behind it, so the open rows get fewer and smaller in each turn.
    """
    slim = ["skey", *order, "size"]
    behind = ~below_cut(order) & (F.col("size") > 0) & (F.col("size") <= F.col("left"))
    open_, found = stage(rows.join(cuts, "skey").filter(behind).select(*slim, "left"), "mix_open"), None
    while found is None or not open_.isEmpty():
        quotas = open_.groupBy("skey").agg(F.first("left").alias("quota"))
        again = weighted_cuts(open_.select(*slim), quotas, "skey", {"_order": 60, "_place": PLACE_BITS}, "size")
        met = open_.drop("left").join(again, "skey", "left")
        fits = met.filter(F.col("left").isNull() | below_cut(order)).select("_place", F.lit(True).alias("_fills"))
        found = fits if found is None else found.unionByName(fits)
        open_ = stage(met.filter(F.col("left").isNotNull() & behind).select(*slim, "left"), "mix_open")
    return stage(found, "mix_filling")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` mixed: every row as often as the mix takes it; columns as they were."""
    found = mixed(docs, docs.columns, **({"fill": True} | options)).filter("copies > 0")
    return found.withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("row.*")
