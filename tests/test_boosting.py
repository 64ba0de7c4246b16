"""Boosted trees against plain numpy and against rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import boosting
from flowsieve.operators.boosting import BoostedTrees, Tree, boost, borders
from flowsieve.plans.training import PREDICTION, feature_importance, fit, predict
from flowsieve.schema import Settings
from flowsieve.sources import tables


def table(spark, n=600, held=0.0, seed=5, wrong=0.0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 20, (n, 3)).astype(float)
    label = np.where(x[:, 0] > 9, 2, np.where(x[:, 1] > 14, 1, 0))
    label = np.where(rng.random(n) < wrong, rng.integers(0, 3, n), label)
    weight = rng.integers(1, 4, n).astype(float)
    rows = [(*map(float, r), int(c), float(w), bool(h)) for r, c, w, h in zip(x, label, weight, rng.random(n) < held)]
    return spark.createDataFrame(rows, "a double, b double, c double, label int, weight double, held boolean"), x, label, weight


def by_hand(x, label, weight, classes, rounds, depth, rate):
    """The same trees from whole arrays: scores and, per tree, the tests."""
    cuts = [np.unique(x[:, j]) for j in range(x.shape[1])]
    scores, tests = np.zeros((len(x), classes)), []
    for _ in range(rounds):
        share = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        g = (share - np.eye(classes)[label]) * weight[:, None]
        h = share * (1 - share) * weight[:, None]
        node, tree = np.zeros(len(x), int), []

        def worth(mask):
            return (g[mask].sum(axis=0) ** 2 / (h[mask].sum(axis=0) + boosting.RIDGE)).sum()

        for level in range(depth):
            best = (boosting.LEAST_GAIN, 0, 0)
            for j, cut in enumerate(cuts):
                for b, border in enumerate(cut):
                    gain = 0.0
                    for k in range(1 << level):
                        left, right = (node == k) & (x[:, j] <= border), (node == k) & (x[:, j] > border)
                        if min(h[left].sum(), h[right].sum()) >= boosting.LEAST_CURVATURE:
                            gain += worth(left) + worth(right) - worth(left | right)
                    if round(gain, 9) > round(best[0], 9):
                        best = (gain, j, b)
            if best[0] <= boosting.LEAST_GAIN:
                break
            tree.append(best[1:])
            node |= (x[:, best[1]] > cuts[best[1]][best[2]]).astype(int) << level
        if not tree:
            break
        for k in range(1 << len(tree)):
            here = node == k
            scores[here] -= rate * g[here].sum(axis=0) / (h[here].sum(axis=0) + boosting.RIDGE)
        tests.append(tree)
    return scores, tests


@pytest.mark.parametrize("gathered", [0, boosting.GATHERED])
def test_equals_whole_arrays(spark, monkeypatch, gathered):
    monkeypatch.setattr(boosting, "GATHERED", gathered)
    monkeypatch.setattr(boosting, "CHECKPOINT_EVERY", 2)
    rows, x, label, weight = table(spark, wrong=0.2)
    model = boost(rows.repartition(5), ["a", "b", "c"], ["p", "q", "r"], 5, 3, 0.3, 50)
    scores, tests = by_hand(x, label, weight, 3, 5, 3, 0.3)
    assert [list(zip(t.features, t.bins)) for t in model.trees] == tests
    assert np.allclose(model.scores(x), scores) and model.losses == [] and model.rounds_trained == 5


def test_many_tasks_add_up_in_steps(spark, monkeypatch):
    rows, *_ = table(spark, 200)
    one = boost(rows.coalesce(1), ["a", "b", "c"], ["p", "q", "r"], 2, 2, 0.3, 50)
    monkeypatch.setattr(boosting, "FAN_IN", 2)
    monkeypatch.setattr(boosting, "GATHERED", 0)
    many = boost(rows.repartition(7), ["a", "b", "c"], ["p", "q", "r"], 2, 2, 0.3, 50)
    assert [(t.features, t.bins) for t in one.trees] == [(t.features, t.bins) for t in many.trees]


def test_stops_while_training(spark):
    """Labels that nothing explains: training ends with patience, and the best round stays."""
    rows, x, label, weight = table(spark, 300, held=0.3, wrong=1.0)
    model = boost(rows, ["a", "b", "c"], ["p", "q", "r"], 60, 3, 0.5, 4)
    best = int(np.argmin(model.losses))
    assert model.rounds_trained == best + 4 < 60 and len(model.trees) == best
    assert len(model.losses) == model.rounds_trained + 1


def test_loss_is_that_of_the_held_rows(spark):
    rows, x, label, weight = table(spark, 300, held=0.4)
    model = boost(rows, ["a", "b", "c"], ["p", "q", "r"], 3, 2, 0.3, 50)
    held = np.array([r["held"] for r in rows.collect()])
    scores = model.scores(x[held])
    each = np.log(np.exp(scores).sum(axis=1)) - scores[np.arange(held.sum()), label[held]]
    assert model.losses[len(model.trees)] == pytest.approx((each * weight[held]).sum() / weight[held].sum())


def test_learns_a_rule_and_stops(spark):
    rows, *_ = table(spark, 1500)
    rows = rows.withColumns({"flow_id": F.monotonically_increasing_id().cast("string"), "target_label": F.col("label").cast("string")})
    model = fit(rows, Settings(), features=["a", "b", "c"])
    assert predict(model, rows).filter(F.col(PREDICTION) != F.col("target_label")).count() == 0
    assert model.rounds_trained < Settings().iterations
    top = {r["Feature"]: r["Importance"] for r in feature_importance(spark, model).collect()}
    assert top["a"] + top["b"] > 0.9 and sum(top.values()) == pytest.approx(1)


def test_missing_values_and_constants(spark):
    rows = [(str(i), None if i % 3 == 0 else float("nan") if i % 3 == 1 else 1.0, 7.0, "x" if i % 3 < 2 else "y") for i in range(90)]
    df = spark.createDataFrame(rows, "flow_id string, a double, b double, target_label string")
    model = fit(df, Settings(iterations=20), features=["a", "b"])
    assert predict(model, df).filter(F.col(PREDICTION) != F.col("target_label")).count() == 0
    constant = fit(df, Settings(iterations=3), features=["b"])
    assert constant.trees == [] and predict(constant, df).select(PREDICTION).distinct().count() == 1
    nothing = fit(df.withColumn("a", F.lit(None).cast("double")), Settings(iterations=3), features=["a"])
    assert nothing.trees == []


def test_borders(spark):
    df = spark.range(1000).select((F.col("id") % 4).cast("double").alias("few"), F.col("id").cast("double").alias("many"))
    few, many = borders(df, ["few", "many"])
    assert few == [0.0, 1.0, 2.0, 3.0] and len(many) == boosting.BINS and max(np.diff(many)) <= 9


def test_saved_model(spark, tmp_path):
    tree = Tree([0, 1], [1, 0], np.arange(8.0).reshape(4, 2), [2.0, 0.5])
    model = BoostedTrees(["a", "b"], ["no", "yes"], [[1.0, 2.0], [5.0]], [tree], [0.7, 0.6], 1)
    tables.save_model(model, str(tmp_path), "d")
    again = tables.load_model(str(tmp_path), "d")
    assert again.trees[0].values.tolist() == tree.values.tolist() and again.importances().tolist() == [0.8, 0.2]
    assert (again.features, again.labels, again.borders, again.losses, again.rounds_trained) == (
        model.features, model.labels, model.borders, model.losses, model.rounds_trained)
    untrained = BoostedTrees(["a"], ["no", "yes"], [[1.0]])
    tables.save_model(untrained, str(tmp_path), "e")
    assert tables.load_model(str(tmp_path), "e").trees == []


def test_missing_column_is_named(spark):
    df = spark.createDataFrame([("1", "x")], "flow_id string, target_label string")
    with pytest.raises(ValueError, match="training.*'a'"):
        fit(df, features=["a"])


def test_equal_rows_are_stored_once(spark):
    """Passes read different rows, not copies; the trees are those of the weights added up."""
    rows, x, label, weight = table(spark, 300, wrong=0.2)
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("copy").repartition(6)
    model = BoostedTrees(["a", "b", "c"], ["p", "q", "r"], borders(many, ["a", "b", "c"]))
    stored = boosting._stored(many, model, 3)
    assert stored.count() == rows.distinct().count()
    assert stored.agg(F.sum("weight")).first()[0] == 20 * weight.sum()
    scores, tests = by_hand(x, label, 20 * weight, 3, 3, 3, 0.3)
    found = boost(many, ["a", "b", "c"], ["p", "q", "r"], 3, 3, 0.3, 50)
    assert [list(zip(t.features, t.bins)) for t in found.trees] == tests and np.allclose(found.scores(x), scores)
