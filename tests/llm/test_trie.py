"""The trie of conversations against one built by hand."""

import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import trie
from flowsieve.runtime import stage

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(rows, also=()):
    """Nodes of the trie of (conv, turn, role, text) and of the turnless conversations ``also``."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    for c in also:
        convs[c] = []
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in convs.items():
        path = tuple((t[2], t[4]) for t in sorted(turns))
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].add(c)
    out = []
    for path, inside in members.items():
        below = [p for p in members if p[:len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in members)]
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        ids = ",".join(map(str, sorted(ends[path])))
        out.append((min(inside), len(path), min(members[path[:-1]]) if path else None, len(inside),
                    sum(len(p) == len(path) + 1 for p in below), len(leaves), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def built(spark, rows, also=()):
    frame = spark.createDataFrame(rows, SCHEMA) if not hasattr(rows, "columns") else rows
    turns = stage(trie.placed(trie.marked(frame)))
    convs = turns.select("conv").unionByName(spark.createDataFrame([(c,) for c in also], "conv bigint"))
    return sorted(map(tuple, trie.prefix_trie(turns, convs).select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("block", [trie.BLOCK, 2])
def test_equals_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rng = random.Random(block)
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(["", "a", "bb", None, "é😀"]))
            for c in range(60) for t in range(rng.randrange(7))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 130) for t in range(5)]
    rows += [(200, t, "user", f"same {t}") for t in range(3)] + [(None, 1, "user", "lost")] + [(3, 9, "user", "x")] * 2
    assert built(spark, rows, also=[900, 901]) == by_hand(rows, also=[900, 901])


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    rows = [(1, t, "user", "w" * (t % 5)) for t in range(300)] + [(2, t, "user", "w" * (t % 5)) for t in range(150)]
    assert built(spark, rows) == by_hand(rows)


def test_edges(spark):
    rows = [(1, None, None, None), (1, None, None, None), (2, 0, "", ""), (2, 0, "", "")]
    assert built(spark, rows) == by_hand(rows)
    clash = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit(7) for c in ("conv", "pos", "mark", "size", "depth", "place", "f1", "_block", "weight")})
    assert built(spark, clash) == by_hand(rows)
    empty = clash.filter("false")
    assert built(spark, empty) == []


def test_long_lists_of_ends(monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = [(1, 5, 5, c) for c in range(10)] + [(1, 5, 6, 10)] + [(2, 0, 0, c) for c in range(4)]
    parts = [pa.RecordBatch.from_pydict(dict(zip([*trie.NODE, "conv"], map(list, zip(*rows[a:a + 4]))))) for a in range(0, len(rows), 4)]
    chunks = list(trie._chunks(iter(parts)))
    assert max(len(x["ids"].split(",")) for b in chunks for x in b.to_pylist()) == 3
    found = {tuple(x[k] for k in trie.NODE): x["ends_sha256"] for b in trie._digests(iter(chunks)) for x in b.to_pylist()}
    text = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert found == {(1, 5, 5): text(range(10)), (1, 5, 6): text([10]), (2, 0, 0): text(range(4))}
