"""Periodic runs against a search of all periods."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import runs


def every_run(words):
    """(start, length, period) by trying every period at every word."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - start + p >= max(12, 2 * p):
                found.setdefault((start, i - start + p), p)
            i += i == start
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def random_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        size, letters = rng.choice([0, 1, 5, 11, 12, 13, 30, 80, 200]), rng.choice([1, 2, 3, 5, 50])
        words = [rng.randrange(letters) for _ in range(size)]
        if size and rng.random() < 0.6:
            a = rng.randrange(size)
            p = 1 + rng.randrange((size - a) // 2 + 1)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(size)]
        yield words


@pytest.mark.parametrize("points", [runs.BATCH_POINTS, 300])
def test_runs_equal_search(monkeypatch, points):
    monkeypatch.setattr(runs, "BATCH_POINTS", points)
    texts = list(random_texts(5, 250))
    for words, found in zip(texts, runs.find_runs(texts)):
        assert [tuple(r) for r in found.tolist()] == every_run(words)


def test_extensions_equal_comparing():
    rng = np.random.default_rng(3)
    words = np.concatenate([np.tile(rng.integers(0, 3, 40), 5), rng.integers(0, 2, 100), [9]])
    i, j = rng.integers(0, len(words), (2, 3000))
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i, j, runs.Extensions(words).lengths(i, j)):
        want = 0
        while max(a, b) + want < len(words) and words[a + want] == words[b + want]:
            want += 1
        assert n == want


def test_cover_reaches_every_pair():
    for a in range(runs.MODULUS):
        for b in range(runs.MODULUS):
            k = runs.SHIFTS[a, b]
            assert (a + k) % runs.MODULUS in runs.COVER and (b + k) % runs.MODULUS in runs.COVER


def test_long_text_of_one_word():
    assert runs.find_runs([["w"] * 30_000])[0].tolist() == [[0, 30_000, 1]]


def test_collapse_keeps_first_period():
    words = "a b c d".split() * 4 + ["x"]
    assert runs.collapse(words, runs.find_runs([words])[0]) == "a b c d x".split()


def test_edges(edge_docs, no_docs):
    found = {r["doc_id"]: r["f"] for r in edge_docs.filter("doc_id is not null").select(
        "doc_id", runs.periodic_runs(F.col("text")).alias("f")).collect()}
    assert found[1]["n_words"] == 0 and found[1]["runs"] == [] and found[1]["collapsed"] == ""
    assert found[2]["n_words"] == 0 and found[9]["collapsed"] == "one"
    assert found[6]["runs"][0].asDict() == {"start": 0, "length": 40_000, "period": 977}
    assert found[6]["collapsed"] == " ".join(f"w{i}" for i in range(977))
    assert no_docs.select(runs.periodic_runs(F.col("text"))).count() == 0


def test_white_space_is_ascii_only(spark):
    text = " ".join(["a b", "c d"] * 6) + "\t\x0b\x1ce"
    row = spark.createDataFrame([(text,)], "text string").select(runs.periodic_runs(F.col("text")).alias("f")).first()["f"]
    assert row["n_words"] == 13 and row["runs"][0].asDict() == {"start": 0, "length": 12, "period": 2}


def test_longest_run_ties(spark):
    rows = [([(5, 20, 3), (1, 20, 4), (1, 20, 2), (0, 19, 1)],), ([],)]
    got = spark.createDataFrame(rows, f"runs array<{runs.RUN}>").select(runs.longest_run(F.col("runs")).alias("b")).collect()
    assert (got[0]["b"]["start"], got[0]["b"]["period"]) == (1, 2) and got[1]["b"] is None
