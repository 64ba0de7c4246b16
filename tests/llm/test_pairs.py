"""Decontamination, exact and near duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from flowsieve.llm import near
from flowsieve.llm.decontaminate import contamination, decontaminate
from flowsieve.llm.exact import build_slots, exact_groups, find_slots, winners
from pyspark.sql import functions as F


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["Äh", "b", "C", "d7", "é"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 7, 10, 11, 14])))) for i in range(12)]
    items += [(12, None), (13, items[5][1]), (None, "zz yy xx")]
    docs = [(i, ", ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(40)]
    docs += [(100 + i, f"q q {t or ''} q zz yy xx") for i, (_, t) in enumerate(items)] + [(7, docs[7][1]), (None, None)]
    got = contamination(spark.createDataFrame(docs, "doc_id int, text string"),
                        spark.createDataFrame(items, "item_id int, text string").withColumn("key", F.lit(1)))
    windows = {}
    for item, text in items:
        ws = words(text)
        n = min(10, len(ws))
        for s in range(len(ws) - n + 1 if n else 0):
            windows.setdefault(tuple(ws[s:s + n]), set()).add(item)
    want = []
    for doc, text in docs:
        ws, hit, found = words(text), set(), set()
        for w, owners in windows.items():
            for s in range(len(ws) - len(w) + 1):
                if tuple(ws[s:s + len(w)]) == w:
                    hit |= set(range(s, s + len(w)))
                    found |= owners
        want.append((doc, len(ws), len(hit), sorted(str(i) for i in found if i is not None), bool(hit)))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_contamination_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "delta epsilon zeta eta theta iota kappa lamda mu nu"),
                                   (2, "delta epsilon zeta eta theta iota kappa lamda mu nu xi")], "item_id int, text string")
    assert contamination(edge_docs, bench).filter("contaminated").count() == 0
    hit = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda")], "item_id int, text string")
    assert contamination(edge_docs, hit).filter("contaminated and n_hit = 11").count() == 3
    kept = decontaminate(edge_docs, hit)
    assert kept.columns == edge_docs.columns and kept.count() == 7
    assert contamination(no_docs, hit).count() == 0
    assert decontaminate(edge_docs, bench.filter("false")).count() == 10


def test_slots_are_minimal_and_perfect():
    for n in (0, 1, 2, 1000):
        digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        ws = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 4)
        sizes, bits, slot = build_slots(ws)
        assert sorted(slot) == list(range(n))
        assert (find_slots(ws, sizes, bits) == slot).all()


def test_exact_groups(spark, edge_docs, no_docs):
    got = {r["doc_id"]: r for r in exact_groups(edge_docs).collect() if r["kept"]}
    rows = exact_groups(edge_docs).collect()
    assert len(rows) == 10 and sum(r["kept"] for r in rows) == 6
    assert got[4]["group_size"] == 3 and got[2]["group_size"] == 3 and got[2]["keep_id"] == 2
    assert {r["keep_id"] for r in rows if r["doc_id"] == 1} == {2}
    assert exact_groups(no_docs).count() == 0


def test_exact_against_history(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id int, text string")
    history = winners(old.select(F.col("doc_id").cast("bigint").alias("id"), F.unhex(F.sha2("text", 256)).alias("digest"),
                                 F.lit(0).cast("bigint").alias("place")))
    new = spark.createDataFrame([(10, "b"), (11, "c"), (12, "c"), (13, "B")], "doc_id int, text string")
    got = {r["doc_id"]: (r["keep_id"], r["kept"], r["member"]) for r in exact_groups(new, history).collect()}
    assert got == {10: (3, False, True), 11: (12, False, False), 12: (12, True, False), 13: (13, True, False)}


def definition(a, wa, b, wb):
    va, vb = dict(zip(a, wa)), dict(zip(b, wb))
    return sum(1 / sum(max(va.get(y, 0) / va[x], vb.get(y, 0) / vb[x]) for y in {*va, *vb}) for x in va.keys() & vb.keys())


def test_probability_jaccard():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = (np.unique(rng.integers(0, 30, rng.integers(1, 25))) for _ in range(2))
        wa, wb = rng.integers(1, 4, len(a)), rng.integers(1, 4, len(b))
        assert near.probability_jaccard(a, wa, b, wb) == pytest.approx(definition(a, wa, b, wb))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(30):
        pool = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
        a, b = np.sort(pool[:240]), np.sort(pool[40:])
        wa, wb = rng.integers(1, 4, 240), rng.integers(1, 4, 260)
        text = np.repeat([0, 1], [240, 260])
        s = near.signatures(text, np.concatenate([a, b]), np.concatenate([wa, wb]), 2)
        errors.append((s[0] == s[1]).mean() - near.probability_jaccard(a, wa, b, wb))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09


def similarity(s, t):
    def bag(text):
        ws = words(text)
        grams = [tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))] if ws else []
        return {g: grams.count(g) for g in grams}
    a, b = bag(s), bag(t)
    return definition(list(a), list(a.values()), list(b), list(b.values()))


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(8)
    base = [[f"v{rng.randrange(400)}" for _ in range(rng.randrange(4, 120))] for _ in range(12)]
    texts = []
    for ws in base:
        for _ in range(5):
            copy = list(ws)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(copy))
    texts += [texts[0], texts[7].upper(), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["id"]: r["class_id"] for r in near.near_classes(docs).collect()}
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if words(texts[i]) and words(texts[j]) and similarity(texts[i], texts[j]) >= 0.8 and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    assert got == dict(enumerate(label))
    kept = near.dedup(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({*label})


def test_near_edges(edge_docs, no_docs):
    kept = near.dedup(edge_docs)
    rows = kept.collect()
    assert kept.columns == edge_docs.columns
    assert [r["doc_id"] for r in rows if r["text"] and r["text"].startswith("alpha")] == [4]
    assert len(rows) == 8  # three copies became one, texts without words stay
    assert near.dedup(no_docs).count() == 0


def test_classes_name_no_link_counts(spark):
    """Members of one class are not all compared, so no number of links is given."""
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(i, text + f" x{i}") for i in range(5)], "doc_id int, text string")
    found = near.near_classes(docs)
    assert found.columns == ["id", "place", "key", "class_id", "class_place"]
    assert [r["class_id"] for r in found.collect()] == [0] * 5


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("weighted", [0, 4, 1])
def test_block_links_join_what_all_pairs_join(weighted):
    rng = np.random.default_rng(weighted)
    base = rng.integers(-2 ** 60, 2 ** 60, 150)
    items, weights = [np.empty(0, np.int64)], [None]
    for i in range(120):
        text, k = base.copy(), int(rng.integers(0, 45))
        text[rng.choice(150, k, replace=False)] = rng.integers(-2 ** 60, 2 ** 60, k)
        items.append(np.unique(text))
        weights.append(rng.integers(1, 4, len(items[-1])).astype(np.int32) if weighted and i % weighted == 0 else None)
    n = len(items)
    whole = [near._weights(i, w) for i, w in zip(items, weights)]
    mass = near.common_mass(items, weights)
    similar = {(i, j): near.probability_jaccard(items[i], whole[i], items[j], whole[j]) for i in range(n) for j in range(i)}
    for (i, j), s in similar.items():
        assert mass[i, j] == pytest.approx(whole[i][np.isin(items[i], items[j])].sum() / max(1, whole[i].sum()), abs=1e-5)
        assert s <= min(mass[i, j], mass[j, i]) + 1e-6
    found = near.block_links(np.arange(n), items, weights)
    assert all(similar[max(p), min(p)] >= near.SIMILAR for p in found) and len(found) < n
    a, b = roots(n, found), roots(n, [p for p, s in similar.items() if s >= near.SIMILAR])
    assert len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_large_buckets_go_on_in_waves(spark, monkeypatch):
    """Blocks too small for any bucket: waves of leaders find the same classes."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        t = base.copy()
        for at in rng.sample(range(80), rng.randrange(4)):
            t[at] = f"x{rng.randrange(10 ** 9)}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    whole = sorted(map(tuple, near.near_classes(docs).select("id", "class_id").collect()))
    monkeypatch.setattr(near, "BLOCK", 3)
    assert sorted(map(tuple, near.near_classes(docs).select("id", "class_id").collect())) == whole
