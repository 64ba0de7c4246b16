"""Exact dedup against a minimal perfect hash of historical digests.

Historical distinct digests are dealt into buckets by their first bytes. Each bucket gets a
minimal perfect hash by levels of collision-free positions (Limasset et al. 2017): a digest
that is alone at its position of a level's bit array stays there, the others go to the next
level, and its slot is the rank of its bit. A slot holds the whole digest and the winner's
locator. A looked-up digest always has some slot if all its bits are set, so the digest in
the slot is compared byte for byte; digests that differ are not members and are grouped among
themselves.

Rows are reduced to one per digest before anything is looked up, with partial aggregation,
so a text that a third of the rows share is one lookup. Digests are uniform, so buckets are
even and bounded; the index is a table with one row per bucket.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flowsieve.llm.text import text_key
from flowsieve.runtime import stage

BUCKET_DIGESTS = 1_000
LOAD = 1.5
_INDEX = "bucket bigint, sizes array<int>, bits binary, digests binary, ids array<bigint>, places array<bigint>"


def _as_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64).reshape(-1, 4)


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position of each digest in a level's array: all four words of it mixed with the level."""
    h = np.full(len(words), level * 0x9E3779B97F4A7C15 % 2 ** 64, np.uint64)
    for i in range(4):
        h ^= words[:, i]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(size)).astype(np.int64)


def build_slots(words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(size of each level, bits of all levels, slot of each digest) for distinct digests."""
    sizes, bits, place, offset = [], [], np.zeros(len(words), np.int64), 0
    left = np.arange(len(words))
    while len(left):
        size = max(1, ceil(len(left) * LOAD))
        at = _positions(words[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        bits.append(alone)
        sizes.append(size)
        stays = alone[at]
        place[left[stays]] = at[stays] + offset
        left, offset = left[~stays], offset + size
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return sizes, flat, (np.cumsum(flat) - 1)[place] if len(words) else place


def find_slots(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each digest, -1 where no level has its bit set."""
    rank, slot, offset = np.cumsum(bits) - 1, np.full(len(words), -1, np.int64), 0
    left = np.arange(len(words))
    for level, size in enumerate(sizes):
        at = _positions(words[left], level, size) + offset
        hit = bits[at]
        slot[left[hit]] = rank[at[hit]]
        left, offset = left[~hit], offset + size
    return slot


def _build(group: pd.DataFrame) -> pd.DataFrame:
    words = _as_words(group["digest"].tolist())
    sizes, bits, slot = build_slots(words)
    order = np.argsort(slot)
    return pd.DataFrame({
        "bucket": [group["bucket"].iloc[0]], "sizes": [sizes], "bits": [np.packbits(bits).tobytes()],
        "digests": [words[order].tobytes()],
        "ids": [group["id"].astype("Int64").iloc[order].astype(object).where(group["id"].iloc[order].notna(), None).tolist()],
        "places": [group["place"].iloc[order].tolist()]})


def _look_up(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = rows[["digest"]].assign(member=False, id=None, place=None)
    if len(rows) and len(index):
        entry = index.iloc[0]
        words, sizes = _as_words(rows["digest"].tolist()), list(entry["sizes"])
        bits = np.unpackbits(np.frombuffer(entry["bits"], np.uint8), count=sum(sizes)).astype(bool)
        slot = find_slots(words, sizes, bits)
        held = np.frombuffer(entry["digests"], np.uint64).reshape(-1, 4)
        member = (slot >= 0) & (held[np.maximum(slot, 0)] == words).all(axis=1)
        ids, places = entry["ids"], entry["places"]
        out["member"] = member
        out["id"] = [ids[s] if m else None for s, m in zip(slot, member)]
        out["place"] = [places[s] if m else None for s, m in zip(slot, member)]
    return out.astype({"id": "Int64", "place": "Int64"})


def _bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("bigint"), F.lit(buckets))


def winners(rows: DataFrame) -> DataFrame:
    """(digest, id, place, n): the row of each digest with the largest id, then place; null ids come last."""
    return rows.groupBy("digest").agg(F.max(F.struct("id", "place")).alias("w"), F.count("*").alias("n")).select(
        "digest", "w.id", "w.place", "n")


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """Index of (digest, id, place) with distinct digests, one row per bucket."""
    keyed = history.select("digest", "id", "place", _bucket(F.col("digest"), buckets).alias("bucket"))
    return keyed.groupBy("bucket").applyInPandas(_build, _INDEX)


def resolve(groups: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """(digest, n, member, keep_id, keep_place) for distinct digests: members keep the index's winner, others their own."""
    keyed = groups.select("digest", _bucket(F.col("digest"), buckets).alias("bucket"))
    found = keyed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(
        _look_up, "digest binary, member boolean, id bigint, place bigint")
    kept = lambda c: F.when(F.col("member"), F.col(f"f.{c}")).otherwise(F.col(f"g.{c}")).alias(f"keep_{c}")
    return groups.alias("g").join(found.alias("f"), "digest").select("digest", "n", "member", kept("id"), kept("place"))


def absorbed(history: DataFrame, groups: DataFrame) -> DataFrame:
    """Written (digest, id, place, n): the history after new groups, both one row per digest as ``winners`` gives.

    Groups are looked up in the history's index. Members add to their entry, whose winner stays the larger of both;
    nonmembers become entries.
    """
    buckets = max(1, ceil(max(history.count(), groups.count()) / BUCKET_DIGESTS))
    index = stage(build_index(history, buckets), "exact_index")
    found = stage(resolve(groups, index, buckets).join(groups.select("digest", "id", "place"), "digest"), "exact_found")
    best = F.greatest(F.struct("id", "place"), F.struct(F.col("keep_id").alias("id"), F.col("keep_place").alias("place")))
    repeats = found.filter("member").select("digest", best.alias("best"), F.col("n").alias("more"))
    own = F.struct("id", "place")
    old = history.join(repeats, "digest", "left").select(
        "digest", F.coalesce("best", own).alias("w"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    new = found.filter(~F.col("member")).select("digest", own.alias("w"), "n")
    return stage(old.unionByName(new).select("digest", "w.id", "w.place", "n"), "exact_history")


def incremental_groups(docs: DataFrame, step: Column, steps: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, as they are after ``steps`` increments.

    Increment ``step`` (from 0; null counts as 0) is looked up in the perfect hash of all before it. Of rows with equal
    bytes the one with the largest id stays, whichever increment it came in; null ids lose, null texts count as empty.
    Ids are numbers. An empty table gives an empty one.
    """
    rows = stage(docs.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(text_key(F.col(text_col))).alias("digest"),
                             F.monotonically_increasing_id().alias("place"), F.coalesce(step, F.lit(0)).alias("step")), "exact_rows")
    parts = [rows.filter(F.col("step") == i) for i in range(steps)]
    history = stage(winners(parts[0]), "exact_history")
    for part in parts[1:]:
        history = absorbed(history, stage(winners(part), "exact_groups"))
    entry = history.select("digest", F.col("id").alias("keep_id"), F.col("place").alias("keep_place"), F.col("n").alias("group_size"))
    return rows.join(entry, "digest").select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def exact_groups(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, member, text_sha256.

    ``history`` is (digest, id, place) of earlier winners, as ``winners`` gives; without it, ``docs`` is its own
    history. Equal are texts with equal bytes; null counts as empty. A row whose text is in the history keeps
    the history's winner. Otherwise the row with the largest id stays; null ids lose, and of rows that repeat
    an id and a text one stays. ``group_size`` counts rows of ``docs``. An empty table gives an empty one.
    """
    rows = stage(docs.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(text_key(F.col(text_col))).alias("digest"),
                             F.monotonically_increasing_id().alias("place")), "exact_rows")
    groups = stage(winners(rows), "exact_groups")
    known = groups if history is None else history
    buckets = max(1, ceil(max(known.count(), groups.count()) / BUCKET_DIGESTS))
    index = stage(build_index(known, buckets), "exact_index")
    found = stage(resolve(groups, index, buckets), "exact_found")
    stays = F.col("place") == F.col("keep_place")
    if history is not None:
        stays = stays & ~F.col("member")  # a member's winner is a historical row
    return rows.join(found, "digest").select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), stays.alias("kept"), "member",
        F.lower(F.hex("digest")).alias("text_sha256"))
