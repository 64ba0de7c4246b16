"""Label rules, label replies and label predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from flowsieve.schema import LABEL_MALFORMED, LABEL_RULES, LABELS, SUSPICIOUS_KEYWORDS


def rule_label(context: Column) -> Column:
    """Label by keyword rules; the first rule with a hit wins."""
    lower = F.lower(context)
    out = None
    for needles, label in LABEL_RULES:
        hit = reduce(Column.__or__, [F.contains(lower, F.lit(n)) for n in needles])
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(LABEL_MALFORMED)


def is_json_value(c: Column) -> Column:
    """True for exactly one JSON value of any kind, with nothing after it."""
    # Written into an array with a second element: text after the value breaks it or adds to it.
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), c, F.lit(",0]"))) == 2, F.lit(False))


def is_json_object(c: Column) -> Column:
    """True for exactly one JSON object with double-quoted keys, with nothing after it."""
    return F.coalesce(c.rlike(r'^\s*\{\s*["}]'), F.lit(False)) & is_json_value(c)


def reply_label(reply: Column, labels: list[str] = LABELS) -> Column:
    """Label named in a JSON reply; a reply outside the vocabulary is malformed behavior.

    Valid JSON that is no object gives null: the caller then falls back to the rules.
    """
    chosen = F.from_json(reply, "label string")["label"]
    return (
        F.when(is_json_object(reply) & chosen.isin(labels), chosen)
        .when(is_json_value(reply) & ~is_json_object(reply), F.lit(None).cast("string"))
        .otherwise(LABEL_MALFORMED)
    )


def label_prompt(labels: list[str] = LABELS) -> str:
    """Instruction text for a labeler: the vocabulary and the expected reply."""
    return "\n- ".join(
        ["Choose exactly one category for the described network flow and reply with a JSON object "
         'whose single key "label" holds the category text. Categories:', *labels]
    )


def suspicious(label: Column) -> Column:
    """True when a label names a threat. Keywords are patterns, matched without case."""
    return F.coalesce(label.rlike("(?i)" + "|".join(SUSPICIOUS_KEYWORDS)), F.lit(False))


def priority(label: Column) -> Column:
    """Triage class of a labeled flow."""
    return F.when(suspicious(label), "High-priority threat").otherwise("Likely noise")
