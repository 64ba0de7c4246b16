"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text is contaminated when it shares a window of ``WINDOW`` consecutive words with a
benchmark item; an item of fewer words is one window.

Winnowing (Schleimer, Wilkerson, Aiken 2003): of every ``WINDOW - GRAM + 1`` consecutive
GRAM-word hashes the smallest is the fingerprint. Those grams are just the ones inside one
window, so equal windows have equal fingerprints and no shared span of a window's length can
be missed. Neighbouring windows mostly share a fingerprint and make one run, which is looked
up once. A run whose fingerprint is known is extended: each of its windows is compared with
the benchmark's windows word by word, so the result is exact.

Plan: one scan of the texts; fingerprints of runs are joined where they arise, with a
broadcast side whose row count is checked; only runs that hit are written. Hits are reduced
per distinct text before they meet the documents, so copies cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowsieve.llm.text import text_key, words
from flowsieve.runtime import stage

WINDOW = 10
GRAM = 5
#: Fingerprints are 8 bytes each; above this many they are joined with a shuffle.
MAX_BROADCAST = 500_000


_RUNS = "array<struct<fp:bigint,length:int,start:int,span:array<string>>>"


def _with_runs(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``runs``: the runs of windows with one fingerprint, for each window length.

    A run is (fp, length, start, words it spans). One column per step: a step reads the one
    before it at several places, so the optimizer keeps them apart and each is made once. For the
    same reason explode them with explode_outer: for a plain explode the optimizer adds a filter
    on the array's size and pushes it, with all the steps in it, down to the scan.
    """
    out = texts.withColumn("_hash", F.transform("ws", lambda w: F.xxhash64(w)))
    size = F.size("ws")
    for n in lengths:
        gram = min(GRAM, n)
        per_window, last = n - gram + 1, size - n  # last: start of the last window

        def steps(upto: Column, column: str, width: int, combine) -> Column:
            if width == 1:
                return F.col(column)
            each = F.transform(F.sequence(F.lit(0), upto),
                               lambda i: combine(*[F.get(column, i + k) for k in range(width)]))
            return F.when(size >= n, each).otherwise(F.array().cast("array<bigint>"))

        out = out.withColumn(f"_gram{n}", steps(size - gram, "_hash", gram, F.xxhash64))
        out = out.withColumn(f"_print{n}", steps(last, f"_gram{n}", per_window, F.least))
        prints = F.col(f"_print{n}")
        out = out.withColumn(f"_start{n}", F.when(size >= n, F.filter(
            F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(prints, i) != F.get(prints, i - 1))))
            .otherwise(F.array().cast("array<int>")))

    def runs(n: int) -> Column:
        starts, prints = F.col(f"_start{n}"), F.col(f"_print{n}")

        def run(s: Column, i: Column) -> Column:
            end = F.coalesce(F.get(starts, i + 1) - 1, size - n) + (n - 1)  # last word of the run's last window
            return F.struct(F.get(prints, s).alias("fp"), F.lit(n).alias("length"), s.alias("start"),
                            F.transform(F.sequence(s, end), lambda j: F.get("ws", j)).alias("span"))

        return F.transform(starts, run)

    found = F.concat(*[runs(n) for n in lengths]) if lengths else F.array()
    return out.withColumn("runs", found.cast(_RUNS)).select(*texts.columns, "runs")


def _windows(span: Column, length: Column) -> Column:
    """Every window of a span as (offset, text); words hold no blank, so the text is exact."""
    return F.transform(F.sequence(F.lit(0), F.size(span) - length),
                       lambda i: F.struct(i.alias("offset"), F.array_join(F.slice(span, i + 1, length), " ").alias("window")))


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(window, items) with each distinct window once, and (fp) with each fingerprint once, both written."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws"))
    items = items.filter(F.size("ws") > 0).withColumn("length", F.least(F.size("ws"), F.lit(WINDOW)))
    lengths = [r[0] for r in items.select("length").distinct().collect()]  # at most WINDOW values
    windows = stage(
        items.select("item", F.explode(_windows(F.col("ws"), F.col("length"))).alias("w"))
        .groupBy(F.col("w.window").alias("window")).agg(F.collect_set("item").alias("items")),
        "windows")
    # An item has windows of its own length only; the shorter lengths of other items do it no harm.
    fps = _with_runs(items.select("ws"), sorted(lengths)).select(F.explode_outer("runs").alias("r"))
    return windows, stage(fps.select("r.fp", "r.length").filter("length is not null").distinct(), "fingerprints")


def shared_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text",
                    max_broadcast: int = MAX_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (id, n_words, key) per row, and (key, start, length, items) per hit window.

    ``key`` stands for the text's content. Null and empty texts have no words and no hits. An
    item without an id marks words but is not listed. Repeated items and rows are harmless; other columns of either table are ignored.
    """
    windows, fps = benchmark_windows(benchmark, item_col, item_text_col)
    lengths = sorted(r[0] for r in fps.select("length").distinct().collect())
    if fps.count() <= max_broadcast:
        fps = F.broadcast(fps)
    texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"),
                        words(F.col(text_col)).alias("ws"))
    # The first element stands for the row itself; its print is the row's own, so it meets no hot key.
    own = F.struct(F.xxhash64("key").alias("fp"), F.lit(0).alias("length"), F.size("ws").alias("start"),
                   F.lit(None).cast("array<string>").alias("span"))
    rows = _with_runs(texts, lengths).select(
        "id", "key", F.explode_outer(F.concat(F.array(own), "runs")).alias("r")).select("id", "key", "r.*")
    known = rows.join(fps.withColumn("known", F.lit(True)), ["fp", "length"], "left").filter("known or length = 0")
    known = stage(known.select("id", "key", "length", "start", "span"), "known_runs")

    own_rows = known.filter("length = 0").select("id", F.col("start").cast("bigint").alias("n_words"), "key")
    spans = known.filter("length > 0").select(
        "key", "length", "start", F.explode(_windows(F.col("span"), F.col("length"))).alias("w"))
    spans = spans.select("key", (F.col("start") + F.col("w.offset")).alias("start"), "length",
                         F.col("w.window").alias("window")).distinct()
    return own_rows, stage(spans.join(windows, "window").drop("window"), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_hit (words inside a hit window), items (sorted ids), contaminated.

    A row without words, or any row against an empty benchmark, has 0 hits. Repeated rows each get their row.
    """
    rows, hits = shared_passages(docs, benchmark, id_col, text_col, item_col, item_text_col)
    by_text = _per_text(hits)
    return rows.join(by_text, "key", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def _per_text(hits: DataFrame) -> DataFrame:
    """Words covered by the union of a text's hit windows, and the items hit.

    Windows of one text are swept by start as a fold over its sorted windows: a text's
    windows are fewer than its words, which were one row already.
    """
    spans = hits.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"),
        F.collect_set("items").alias("sets"))
    swept = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"),
            F.greatest(a["upto"], s["end"]).alias("upto")))
    return spans.select("key", swept["n"].alias("n_hit"),
                        F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that share a window with the benchmark; columns as they were."""
    slim = docs.select(F.col(text_col).alias("text"), F.lit(None).cast("string").alias("id"))
    items = benchmark.select(F.lit("").alias("item_id"), F.col(item_text_col).alias("text"))
    _, hits = shared_passages(slim, items, "id", "text")
    bad = hits.select("key").distinct()
    return docs.join(bad, text_key(docs[text_col]) == bad["key"], "left_anti")
