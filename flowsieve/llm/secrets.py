"""Secret scans over a history of texts with a blob ledger, in DataFrame functions only.

Every version of every path is addressed by the digest of its content. The ledger records
which blob was scanned under which version of which rule, so a run scans only the pairs that
it lacks: new blobs under all rules, and old blobs under rules that are new or changed. A blob is
scanned once however many paths and versions share it, and its findings are joined back to
all of them.

Spans come without Python: the pieces between matches and the matches themselves are two
arrays, and positions are running sums of their lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsieve.llm.text import text_key
from flowsieve.runtime import stage


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if ``group`` has ``least`` characters; raise ``version`` when anything changes."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed values. Letters of the key words count in either case. For the last two, the least length is part
#: of the pattern: a maximal run of a class is a match or not as a whole.
RULES = [
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
]

_MATCH = "array<struct<rule:string,nth:int,gap:int,size:int,counts:boolean>>"


def _matches(text: Column, rule: Rule) -> Column:
    """Matches of a rule in order: characters since the last match, length, and whether it counts."""
    pattern = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    whole, group = F.regexp_extract_all(text, pattern, 0), F.regexp_extract_all(text, pattern, rule.group)
    each = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), group.alias("group")),
        lambda m, i: F.struct(F.lit(rule.name).alias("rule"), i.alias("nth"), F.length(m["gap"]).alias("gap"),
                              F.length(m["whole"]).alias("size"), (F.length(m["group"]) >= rule.least).alias("counts")))
    return F.when(F.rlike(text, pattern), each.cast(_MATCH)).otherwise(F.array().cast(_MATCH))


def addressed(history: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, blob, text) of each version; null text is the empty blob."""
    return history.select(*keys, text_key(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: list[Rule]) -> DataFrame:
    """(blob, rules) with the rules each distinct blob was not scanned under; blobs without any are left out."""
    every = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    pairs = blobs.select("blob").distinct().select("blob", F.explode(every).alias("r")).select("blob", "r.*")
    if ledger is not None:
        pairs = pairs.join(ledger, ["blob", "rule", "version"], "left_anti")
    return pairs.groupBy("blob").agg(F.collect_set("rule").alias("rules"))


def scan(blobs: DataFrame, rules: list[Rule] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New ledger rows (blob, rule, version) and their findings (blob, rule, version, start, end), both written.

    ``blobs`` is (blob, text), repeated as often as it likes: copies are dropped before the
    shuffle. Positions count code points from 0, the end is exclusive.
    """
    texts = blobs.select("blob", "text").dropDuplicates(["blob"])
    if ledger is None:
        todo = texts.withColumn("rules", F.array(*[F.lit(r.name) for r in rules]))
    else:
        todo = texts.join(unseen(blobs, ledger, rules), "blob")
    due = [F.when(F.array_contains("rules", r.name), _matches(F.col("text"), r)).otherwise(F.array().cast(_MATCH))
           for r in rules]
    version = F.element_at(F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.version))]), F.col("rule"))
    # One row per scanned pair, and one per match; nth is null in the former.
    done = F.transform("rules", lambda r: F.struct(
        r.alias("rule"), F.lit(None).cast("int").alias("nth"), F.lit(None).cast("int").alias("gap"),
        F.lit(None).cast("int").alias("size"), F.lit(None).cast("boolean").alias("counts")))
    rows = stage(todo.select("blob", F.explode_outer(F.concat(done, *due)).alias("m")).select("blob", "m.*"), "scanned")
    ledger_rows = rows.filter("nth is null").select("blob", "rule", version.alias("version"))
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "rule").orderBy("nth"))
    findings = rows.filter("nth is not null").withColumn("end", upto).filter("counts").select(
        "blob", "rule", version.alias("version"), (F.col("end") - F.col("size")).alias("start"), "end")
    return ledger_rows, stage(findings, "findings")


def findings_by_row(rows: DataFrame, findings: DataFrame, keys: list[str], rules: list[Rule] = RULES) -> DataFrame:
    """(keys, n_<rule>..., spans) for each row of (keys, blob): its blob's findings joined back.

    ``spans`` is rule:start:end by start, then rule as listed, comma-joined; empty without findings.
    """
    rank = F.element_at(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))]), F.col("rule"))
    per_blob = findings.groupBy("blob").agg(
        *[F.count_if(F.col("rule") == r.name).alias(f"n_{r.name}") for r in rules],
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "rule", "end"))).alias("found"))
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(
        ":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    joined = rows.select(*keys, "blob").join(per_blob.withColumn("spans", spans).drop("found"), "blob", "left")
    return joined.select(*keys, *[F.coalesce(f"n_{r.name}", F.lit(0)).cast("bigint").alias(f"n_{r.name}") for r in rules],
                         F.coalesce("spans", F.lit("")).alias("spans"))


def scan_increments(versions: DataFrame, step: Column, steps: int, rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """Ledger and findings of ``versions`` (blob, text) that arrive in ``steps`` increments, both over all of them.

    Increment ``step`` counts from 0, null as 0. After each the ledger is written, and the next one scans only the blob and
    rule-version pairs that it does not have.
    """
    ledger, findings = scan(versions.filter(F.coalesce(step, F.lit(0)) == 0), rules)
    for i in range(1, steps):
        ledger = stage(ledger, "ledger")
        more, found = scan(versions.filter(step == i), rules, ledger)
        ledger, findings = ledger.unionByName(more), findings.unionByName(found)
    return ledger, findings
