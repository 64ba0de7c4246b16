"""Prefix trie of conversations by collapsing whole sequences.

Equal conversations are collapsed to one weighted sequence with the list of the conversations that
end there. Sequences that are proper prefixes of others go by an anti-join; the rest are the
leaves. Weights, leaves and the smallest member are then summed over the prefixes of the distinct
sequences, one grouped pass for all depths. Nothing walks the trie level by level.

A prefix is named by its depth and 128 bits: for each turn two 64-bit hashes of its place, role
and text (through SHA-256), combined by exclusive or. So a prefix is a running aggregate, and its
parent's name is its own without the last turn. What a node saves is counted once, at the
sequence of its smallest member; the sum over a subtree is then the sum, over the sequences through
the node, of what lies from its depth on. Both running aggregates go by blocks of BLOCK turns, so a
conversation of any length is split, and a text is never shuffled, only its hash and length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsieve.operators.ranking import number_rows
from flowsieve.operators.skew import lookup_join
from flowsieve.runtime import stage

BLOCK = 1024
#: Ids joined to one string before they meet the rest of their sequence.
CHUNK = 4096
NODE = ["depth", "f1", "f2"]


def marked(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, mark, size): a turn's SHA-256 and code points. Null role or text counts as empty; rows without a key go."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return rows.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("conv"), F.col(order).alias("turn"), role_.alias("role"),
        F.sha2(text_, 256).alias("mark"), F.length(text_).cast("bigint").alias("size"))


def placed(marks: DataFrame) -> DataFrame:
    """(conv, pos, mark, size): turns numbered from 0 in order of turn, nulls first; ties by role, then SHA-256 of the text.

    Numbered over all rows at once by ranges, so a conversation of any length is spread over tasks.
    """
    rows = stage(number_rows(marks, ["conv", "turn", "role", "mark"], "place"), "turns")
    first = rows.groupBy("conv").agg(F.min("place").alias("first"))
    role_and_text = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("mark")), 256))
    return lookup_join(rows, first, ["conv"], "inner").select(
        "conv", (F.col("place") - F.col("first")).alias("pos"), role_and_text.alias("mark"), "size")


def running(rows: DataFrame, group: str, pos: str, values: dict[str, Column], backward: bool = False) -> DataFrame:
    """``rows`` with running aggregates of ``values`` over ``group`` in order of ``pos``, this row included.

    ``values`` are names and aggregates (sums or exclusive ors, which combine with themselves). Blocks of
    BLOCK positions are added up on their own; only groups longer than a block look at blocks before.
    """
    block = F.floor(F.col(pos) / BLOCK) * (-1 if backward else 1)
    rows = stage(rows.withColumn("_block", block), "blocks")
    ahead = F.desc(pos) if backward else F.asc(pos)
    inner = Window.partitionBy(group, "_block").orderBy(ahead).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_{n}": f(F.col(n)).over(inner) for n, f in values.items()})
    long = rows.groupBy(group).agg(F.min("_block").alias("_low"), F.max("_block").alias("_high")).filter("_low < _high")
    blocks = lookup_join(rows, long.select(group), [group], "left_semi").groupBy(group, "_block").agg(
        *[f(F.col(n)).alias(n) for n, f in values.items()])
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = blocks.select(group, "_block", *[f(F.col(n)).over(before).alias(f"_{n}_before") for n, f in values.items()])
    out = lookup_join(out, earlier, [group, "_block"])
    both = {f"run_{n}": f.combine(F.col(f"_{n}"), F.col(f"_{n}_before")) for n, f in values.items()}
    return out.select(*[c for c in rows.columns if c != "_block"], *[c.alias(n) for n, c in both.items()])


class _Running:
    """An aggregate and how two of its results combine; null is nothing."""

    def __init__(self, aggregate, combine) -> None:
        self.aggregate, self.combine_ = aggregate, combine

    def __call__(self, value: Column) -> Column:
        return self.aggregate(value)

    def combine(self, a: Column, b: Column) -> Column:
        return self.combine_(a, F.coalesce(b, F.lit(0).cast("bigint")))


XOR = _Running(F.bit_xor, lambda a, b: a.bitwiseXOR(b))
SUM = _Running(F.sum, lambda a, b: a + b)


def _batch(rows: list[tuple], last: str) -> pa.RecordBatch:
    """Rows of numbers and one string, named ``last``."""
    names = [*NODE, "first", last][:len(rows[0]) - 1] + [last]
    columns = [list(c) for c in zip(*rows)]
    kinds = [pa.int64()] * (len(names) - 1) + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (depth, f1, f2, conv): the ids of one sequence joined, up to CHUNK in a row."""
    key, ids, done = (), [], []
    for batch in batches:
        for *node, conv in zip(*[batch.column(n).to_pylist() for n in (*NODE, "conv")]):
            if ids and (node != key or len(ids) >= CHUNK):
                done.append((*key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = node
            ids.append(conv)
        if done:
            yield _batch(done, "ids")
            done = []
    if ids:
        yield _batch([(*key, ids[0], ",".join(map(str, ids)))], "ids")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks of a sequence, hashed one behind the other."""
    key, state = (), None
    for batch in batches:
        done = []
        for *node, ids in zip(*[batch.column(n).to_pylist() for n in (*NODE, "ids")]):
            if node == key:
                state.update(b"," + ids.encode())
                continue
            if state:
                done.append((*key, state.hexdigest()))
            key, state = node, hashlib.sha256(ids.encode())
        if done:
            yield _batch(done, "ends_sha256")
    if state:
        yield _batch([(*key, state.hexdigest())], "ends_sha256")


def ends(whole: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids of each sequence of ``whole`` (conv, depth, f1, f2).

    Ids are joined where ranges of them lie, so what meets for a hot sequence is one row per CHUNK ids; the
    digest itself reads them in order, one row at a time.
    """
    by = [*NODE, "conv"]
    chunks = whole.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        _chunks, "depth bigint, f1 bigint, f2 bigint, first bigint, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        _digests, "depth bigint, f1 bigint, f2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations ``convs`` (conv), whose turns are ``turns`` (conv, pos, mark, size).

    ``pos`` counts up from 0 without gaps. Columns: conv_id (smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A conversation without turns is a member of the
    root. An empty table has no nodes.
    """
    hashes = {"e1": F.xxhash64("pos", "mark"), "e2": F.xxhash64("mark", "pos", F.lit("second"))}
    steps = stage(running(turns.select("conv", "pos", "size", *[h.alias(n) for n, h in hashes.items()]), "conv", "pos",
                          {"e1": XOR, "e2": XOR}).select(
        "conv", (F.col("pos") + 1).alias("depth"), F.col("run_e1").alias("f1"), F.col("run_e2").alias("f2"), "e1", "e2", "size"), "steps")

    # Whole sequences: equal ones are one, with a weight and its smallest conversation.
    zero = F.lit(0).cast("bigint")
    sums = steps.groupBy("conv").agg(F.count("*").alias("depth"), F.bit_xor("e1").alias("f1"), F.bit_xor("e2").alias("f2"))
    whole = stage(convs.select("conv").distinct().join(sums, "conv", "left").select(
        "conv", *[F.coalesce(c, zero).alias(c) for c in NODE]), "whole")
    sequences = stage(whole.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.count("*").alias("weight")), "sequences")

    # Prefixes of the distinct sequences, the root among them.
    roots = sequences.select("conv", zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), zero.alias("e1"), zero.alias("e2"),
                             zero.alias("size"))
    own = sequences.select("conv", "weight", F.col("depth").alias("length"))
    prefixes = stage(lookup_join(steps.unionByName(roots), own, ["conv"], "inner"), "prefixes")
    proper = prefixes.filter(F.col("depth") < F.col("length")).select(*NODE).distinct()
    leaves = stage(sequences.join(proper, NODE, "left_anti").select("conv", F.lit(1).cast("bigint").alias("leaf")), "leaves")
    prefixes = stage(lookup_join(prefixes, leaves, ["conv"]), "weighted")

    nodes = stage(prefixes.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.coalesce(F.sum("leaf"), zero).alias("n_leaves"),
        F.max("size").alias("size"), F.max("e1").alias("e1"), F.max("e2").alias("e2")), "nodes")
    above = nodes.withColumns({"p_depth": F.col("depth") - 1, "p_f1": F.col("f1").bitwiseXOR(F.col("e1")),
                               "p_f2": F.col("f2").bitwiseXOR(F.col("e2"))})
    parent = [f"p_{c}" for c in NODE]
    children = above.filter("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children")).select(
        *[F.col(f"p_{c}").alias(c) for c in NODE], "n_children")

    # What a node saves stands once, on the sequence of its smallest member.
    worth = nodes.select(F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("worth"))
    valued = prefixes.select("conv", *NODE).join(worth, ["conv", "depth"], "left").withColumn("worth", F.coalesce("worth", zero))
    saved = running(valued, "conv", "depth", {"worth": SUM}, backward=True).groupBy(*NODE).agg(
        F.sum("run_worth").alias("saved_tokens"))

    parents = nodes.select(*[F.col(c).alias(f"p_{c}") for c in NODE], F.col("conv_id").alias("parent_conv_id"))
    out = lookup_join(stage(above, "above"), parents, parent)
    return out.join(children, NODE, "left").join(saved, NODE).join(ends(whole), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
