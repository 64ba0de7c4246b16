"""Boosted trees for several classes, trained by histogram passes that stop with the loss.

Every round adds one symmetric tree for all classes together: on each level the same test
splits all nodes, and a leaf holds one value per class. A level is one pass over the rows. Each
task adds up gradients and curvatures of the softmax loss per node, feature and bin; parts of
one feature are summed, and its best split found, in one group; the driver sees one row per
feature, or the sums themselves where they are known to be small. The first pass of a round also gives the loss on the held rows, so training ends in
the loop: ``patience`` rounds without a lower loss, or no split left that gains anything.

Rows are stored as one byte per feature (quantile bins) next to their scores. Rows alike in bins, label,
weight and ``held`` have the same scores throughout, so they are one stored row with the sum of their weights: passes read
as many rows as there are different ones, with few or coarse features far less than the input. A pass applies
the trees since the scores were last written, CHECKPOINT_EVERY rounds at most, so a lost
executor costs no more than that. What passes hold grows with nodes, bins, features and
classes, never with rows: a task's sums are nodes x bins x classes x 2 numbers per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowsieve.runtime import discard, stage

BINS = 128
CHECKPOINT_EVERY = 10
#: Parts of a feature's sums that one group adds up; with more tasks, groups of parts come first.
FAN_IN = 64
#: Bytes of sums, over all tasks, that the driver may add up by itself.
GATHERED = 32 << 20
#: Curvature that a child must hold, and the weight of "no change" in a leaf.
LEAST_CURVATURE, RIDGE = 1.0, 3.0
LEAST_GAIN = 1e-6


@dataclass
class Tree:
    """Tests by level (feature number, bin below or at which a row goes left), and leaf values (leaf, class)."""

    features: list[int]
    bins: list[int]
    values: np.ndarray
    gains: list[float]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row of bins."""
        leaf = np.zeros(len(bins), np.int64)
        for level, (f, b) in enumerate(zip(self.features, self.bins)):
            leaf |= (bins[:, f] > b).astype(np.int64) << level
        return leaf


@dataclass
class BoostedTrees:
    """A trained model. ``losses[r]`` is the held rows' loss after r rounds; trees behind the best round are cut off."""

    features: list[str]
    labels: list[str]
    borders: list[list[float]]
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    rounds_trained: int = 0

    def binned(self, values: np.ndarray) -> np.ndarray:
        """Bins of rows of feature values; a missing value lies below all numbers."""
        out = np.empty(values.shape, np.uint8)
        for j, borders in enumerate(self.borders):
            x = values[:, j]
            out[:, j] = np.searchsorted(borders, np.where(np.isnan(x), -np.inf, x), side="left")
        return out

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Class scores of rows of feature values."""
        bins = self.binned(values)
        out = np.zeros((len(values), len(self.labels)))
        for tree in self.trees:
            out += tree.values[tree.leaves(bins)]
        return out

    def predict(self, *features: Column) -> Column:
        """The label with the highest score; of equal ones the first in alphabetical order."""

        def each(*columns: pa.Array) -> pa.Array:
            values = np.stack([_numbers(c) for c in columns], axis=1)
            return pa.array(self.labels).take(pa.array(self.scores(values).argmax(axis=1)))

        return F.arrow_udf(each, "string")(*[f.cast("double") for f in features])

    def importances(self) -> np.ndarray:
        """Share of each feature in the gain of all splits."""
        out = np.zeros(len(self.features))
        for tree in self.trees:
            np.add.at(out, tree.features, tree.gains)
        return out / out.sum() if out.sum() else out


def _numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=np.float64)


def borders(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Up to ``bins`` borders per feature at equal shares of the rows, from one pass of mergeable summaries.

    A feature with missing values has a border below all numbers.
    """
    shares = [i / bins for i in range(bins)]
    number = [F.nanvl(F.col(f).cast("double"), F.lit(None)) for f in features]
    found = rows.agg(*[F.percentile_approx(x, shares, 100 * bins).alias(f"b{i}") for i, x in enumerate(number)],
                     *[F.count_if(x.isNull()).alias(f"m{i}") for i, x in enumerate(number)]).first()
    return [[-np.inf] * bool(found[f"m{i}"]) + sorted(set(found[f"b{i}"] or [])) for i in range(len(features))]


class _Rows:
    """Columns of one batch of stored rows."""

    def __init__(self, batch: pa.RecordBatch, classes: int) -> None:
        n = batch.num_rows
        self.bins = _fixed(batch.column("bins"), np.uint8).reshape(n, -1)
        self.scores = _fixed(batch.column("scores"), np.float64).reshape(n, classes)
        self.label = batch.column("label").to_numpy()
        self.weight = _numbers(batch.column("weight"))
        self.held = batch.column("held").to_numpy(zero_copy_only=False)


def _fixed(column: pa.Array, kind: type) -> np.ndarray:
    """Values of equal length, laid end to end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if len(column) else np.empty(0, np.uint8)
    return np.ascontiguousarray(data).view(kind)


def _grown(scores: np.ndarray, bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    for tree in trees:
        scores = scores + tree.values[tree.leaves(bins)]
    return scores


def _shares(scores: np.ndarray) -> np.ndarray:
    grown = np.exp(scores - scores.max(axis=1, keepdims=True))
    return grown / grown.sum(axis=1, keepdims=True)


def _sums(classes: int, sizes: list[int], recent: list[Tree], current: Tree):
    """A task's sums: per feature (node, bin, gradient and curvature by class), and as feature -1 the held rows' loss."""
    depth = len(current.features)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(((size + 1) << depth, 2 * classes)) for size in sizes]
        loss, any_rows = np.zeros(2), False
        for batch in batches:
            if not batch.num_rows:
                continue
            any_rows = True
            rows = _Rows(batch, classes)
            scores = _grown(rows.scores, rows.bins, recent)
            if not depth and rows.held.any():
                held = scores[rows.held]
                top = held.max(axis=1)
                each_loss = np.log(np.exp(held - top[:, None]).sum(axis=1)) + top - held[np.arange(len(held)), rows.label[rows.held]]
                loss += [(each_loss * rows.weight[rows.held]).sum(), rows.weight[rows.held].sum()]
            used = ~rows.held
            share, weight, bins = _shares(scores[used]), rows.weight[used, None], rows.bins[used]
            both = np.concatenate([share, share * (1 - share)], axis=1)
            both[np.arange(len(share)), rows.label[used]] -= 1
            both *= weight
            node = current.leaves(bins)
            for j, size in enumerate(sizes):
                if size:
                    key = node * (size + 1) + bins[:, j]
                    for c in range(2 * classes):
                        sums[j][:, c] += np.bincount(key, both[:, c], len(sums[j]))
        if any_rows:
            parts = [(j, s.tobytes()) for j, s in enumerate(sums) if sizes[j]]
            if not depth:
                parts.append((-1, loss.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())],
                                             ["feature", "part"])

    return each


def _added(parts: list[bytes]) -> np.ndarray:
    # In an order of their own, so that repeated runs round alike.
    return np.sum([np.frombuffer(p, np.float64) for p in sorted(parts)], axis=0)


def _sum_parts(group: pa.Table) -> pa.Table:
    feature = group.column("feature")[0].as_py()
    return pa.table({"feature": pa.array([feature], pa.int32()), "part": pa.array([_added(group.column("part").to_pylist()).tobytes()], pa.binary())})


def _best_split(feature: int, added: np.ndarray, classes: int, size: int) -> tuple[float, int, np.ndarray, np.ndarray]:
    """The best bin of a feature to split all nodes at: gain, bin, and the sums (node, class) up to it and in all."""

    def worth(sums: np.ndarray) -> np.ndarray:
        gradient, curvature = sums[..., :classes], sums[..., classes:]
        return (gradient ** 2 / (curvature + RIDGE)).sum(axis=-1)

    if feature < 0:
        return 0.0, 0, added, np.empty(0)
    upto = np.cumsum(added.reshape(-1, size + 1, 2 * classes), axis=1)
    whole = upto[:, -1:]
    below, above = upto[:, :-1], whole - upto[:, :-1]
    open_ = (below[..., classes:].sum(axis=-1) >= LEAST_CURVATURE) & (above[..., classes:].sum(axis=-1) >= LEAST_CURVATURE)
    gains = np.where(open_, worth(below) + worth(above) - worth(whole), 0.0).sum(axis=0)
    at = int(gains.round(9).argmax())
    return float(gains[at]), at, below[:, at], whole[:, 0]


def _splits(rows: DataFrame, tasks: int, classes: int, sizes: list[int], recent: list[Tree], current: Tree) -> list[tuple]:
    """One pass: (feature, gain, bin, sums below, sums in all) of every feature, and for a tree's first level the loss.

    The tasks' sums are added up by feature in groups, one row per feature comes back. Only where all of them together are
    known to be small, as their size follows from the parameters, are they sent to the driver and added up there.
    """
    parts = rows.mapInArrow(_sums(classes, sizes, recent, current), "feature int, part binary")
    if tasks * sum((s + 1 << len(current.features)) * 16 * classes for s in sizes) <= GATHERED:
        found: dict[int, list[bytes]] = {}
        for r in parts.collect():
            found.setdefault(r["feature"], []).append(bytes(r["part"]))
        return [(f, *_best_split(f, _added(p), classes, sizes[f])) for f, p in sorted(found.items())]
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        salt = F.pmod(F.xxhash64("part"), F.lit(tasks)).alias("salt")
        parts = parts.groupBy("feature", salt).applyInArrow(_sum_parts, "feature int, part binary")

    def best(group: pa.Table) -> pa.Table:
        feature = group.column("feature")[0].as_py()
        gain, at, below, total = _best_split(feature, _added(group.column("part").to_pylist()), classes, sizes[feature])
        return pa.table({"feature": pa.array([feature], pa.int32()), "gain": [gain], "bin": pa.array([at], pa.int32()),
                         "below": pa.array([below.tobytes()], pa.binary()), "total": pa.array([total.tobytes()], pa.binary())})

    found = parts.groupBy("feature").applyInArrow(best, "feature int, gain double, bin int, below binary, total binary").collect()
    numbers = lambda b: np.frombuffer(b, np.float64)
    return [(r["feature"], r["gain"], r["bin"], numbers(r["below"]).reshape(-1, 2 * classes) if r["feature"] >= 0 else numbers(r["below"]),
             numbers(r["total"]).reshape(-1, 2 * classes)) for r in found]


def _stored(rows: DataFrame, model: BoostedTrees, classes: int) -> DataFrame:
    """(bins, label, weight, held, scores) of rows (features, label number, weight, held), equal ones added up."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([_numbers(batch.column(f"f{j}")) for j in range(len(model.features))], axis=1)
            packed = pa.array([r.tobytes() for r in model.binned(values)], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, *[batch.column(c) for c in ("label", "weight", "held")]],
                                             ["bins", "label", "weight", "held"])

    chosen = rows.select(*[F.col(f).cast("double").alias(f"f{j}") for j, f in enumerate(model.features)], "label", "weight", "held")
    binned = chosen.mapInArrow(each, "bins binary, label int, weight double, held boolean")
    # Counts are exact, so the summed weight does not depend on the order of rows.
    alike = binned.groupBy("bins", "label", "weight", "held").agg(F.count("*").alias("n"))
    # Even files, few for few rows, since every pass opens them all.
    return stage(alike.hint("rebalance").select("bins", "label", (F.col("weight") * F.col("n")).alias("weight"), "held",
                                                F.lit(bytearray(8 * classes)).alias("scores")), "boosting")


def _with_scores(rows: DataFrame, classes: int, trees: list[Tree]) -> DataFrame:
    """The stored rows with ``trees`` added to their scores, written anew."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _Rows(batch, classes)
                scores = [s.tobytes() for s in _grown(own.scores, own.bins, trees)]
                yield batch.set_column(batch.schema.get_field_index("scores"), "scores", pa.array(scores, pa.binary()))

    return stage(rows.mapInArrow(each, rows.schema), "boosting")


def boost(rows: DataFrame, features: list[str], labels: list[str], rounds: int, depth: int, rate: float, patience: int) -> BoostedTrees:
    """Train on ``rows``: the features, ``label`` (number within ``labels``), ``weight`` and ``held``.

    Held rows are not learned from; their loss ends training after ``patience`` rounds without a lower one, and the
    trees up to the lowest stay. Without held rows all rounds are trained, or as many as gain anything. A missing
    feature value lies below all numbers. The result depends on the rows and on how they lie in files only by rounding.
    """
    classes = len(labels)
    model = BoostedTrees(features, labels, borders(rows, features))
    sizes = [len(b) for b in model.borders]
    stored = _stored(rows, model, classes)
    tasks = stored.rdd.getNumPartitions()
    written = best = 0
    while True:
        recent = model.trees[written:]
        tree = Tree([], [], np.empty(0), [])
        for level in range(depth):
            found = _splits(stored, tasks, classes, sizes, recent, tree)
            for feature, _, _, below, _ in found:
                if feature < 0 and below[1]:
                    model.losses.append(float(below[0] / below[1]))
            if not level:
                if model.losses and model.losses[-1] < model.losses[best]:
                    best = len(model.losses) - 1
                if len(model.trees) == rounds or (model.losses and len(model.trees) - best >= patience):
                    found = []
            top = max((r for r in found if r[0] >= 0), key=lambda r: (round(r[1], 9), -r[0]), default=None)
            if top is None or top[1] <= LEAST_GAIN:
                break
            feature, gain, at, below, total = top
            sums = np.concatenate([below, total - below])
            values = -rate * sums[:, :classes] / (sums[:, classes:] + RIDGE)
            tree = Tree([*tree.features, feature], [*tree.bins, at], values, [*tree.gains, gain])
        if not tree.features:
            break
        model.trees.append(tree)
        if len(model.trees) - written == CHECKPOINT_EVERY:
            last, stored = stored, _with_scores(stored, classes, model.trees[written:])
            written = len(model.trees)
            discard(last)
    discard(stored)
    model.rounds_trained = len(model.trees)
    if model.losses:
        model.trees = model.trees[:best]
    return model
