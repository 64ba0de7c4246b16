"""Surrogates for personal data.

Detected entities are replaced by invented ones of the same kind and format: a phone number
by digits in the same grouping, an e-mail address by letters of the same script and case
around the same signs, a name by one of the same gender and script. The replacement is keyed:
without the key it cannot be recomputed, with it every run agrees.

The same entity gets the same surrogate in all documents, whatever its spelling; names are
replaced part by part, so a later "Mrs. Smith" still points to "Mrs. Jane Smith". A name is found behind a title; its parts are
then replaced wherever the same text has them as capitalised words, so "Jane" and "Smith" alone point to her too. Different entities get different surrogates, and
no surrogate is an entity of the corpus: distinct entities are collected once, drawn
against each other and against all real ones, and those that collide draw again.

Dates, lists of years and book numbers are left alone, though they are written like phone or card numbers: digits in groups are
a phone number only if they are none of these. Titles count in title case and in capitals.

Only documents that a cheap test on the JVM lets through are parsed or shuffled; others pass.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
import sys
import unicodedata
from bisect import bisect_right
from functools import cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from flowsieve.llm.text import text_key
from flowsieve.runtime import stage

#: Titles by gender, and given names and syllables to draw from.
TITLES = {"Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f",
          "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Dr": "x", "Prof": "x"}
GIVEN = {
    "f": "Anna Clara Diana Elena Emma Julia Laura Lena Lucia Maria Marta Mila Nina Nora Olivia Paula Rosa Sara Sofia Vera".split(),
    "m": "Adam Anton Bruno Carlos Daniel David Erik Felix Hugo Jakob Jonas Leon Lukas Marco Martin Oscar Pablo Paul Simon Victor".split(),
    "x": "Alex Andrea Charlie Dominique Eden Jamie Kim Lou Mika Noa Robin Sam Sascha Toni Uli".split(),
}
SYLLABLES = "ba be bo da de do fa fe ga go ha ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa we za zo".split()
#: Code points between two letters of a script that still count as one alphabet, if no letter of the other case is there.
GAP = 8


def _classes(test) -> str:
    """Code points that pass a test, as ranges of a pattern's character class."""
    out, start = [], None
    for o in range(0x300, 0x20000):
        if test(chr(o)):
            start = o if start is None else start
        elif start is not None:
            out.append(f"{chr(start)}-{chr(o - 1)}")
            start = None
    return "".join(out)


#: Vowel signs and other marks, which are parts of words but no letters; a name ends before a possessive s.
_MARKS = _classes(lambda c: unicodedata.category(c) in ("Mn", "Mc"))
_LETTERS = rf"[^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*"
_NAME = rf"{_LETTERS}(?:[-'’](?!s\b){_LETTERS})*"
_TITLE = "|".join(t for title in sorted(TITLES, key=len, reverse=True) for t in dict.fromkeys((title, title.upper())))
_GENDER = {t.upper(): g for t, g in TITLES.items()}
PATTERNS = re.compile(
    r"(?P<email>[\w.%+-]*\w@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{2,39}(?![\w:]|\.\d))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<phone>(?<![\w.+-])(?:\+\d{7,15}|\+\d{1,3}[ .-]\(?\d{1,5}\)?(?:[ .-]?\d{2,8}){1,3}|\+?(?:\d{1,3}[ .-])?(?:\(\d{1,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]\d{2,4}){1,3}"
    r"|\d{3}-\d{4})(?![\w-]|\.\d))"
    rf"|(?P<person>\b(?P<title>{_TITLE})(?P<gap>\.?\ )(?P<names>(?=[^\W\d_a-z]){_NAME}(?:\ (?=[^\W\d_a-z]){_NAME}){{0,2}}))")
_INITIALS = "".join(sorted({t[0] for t in TITLES}))
_TAILS = "|".join(t for title in sorted(TITLES, key=len, reverse=True) for t in dict.fromkeys((title[1:], title[1:].upper())))
#: A text that this does not find holds none of the above. One sign decides at most places, so it is cheap.
QUICK = (r"[@:\p{Nd}A-Z](?:(?<=@)|(?<=:)[0-9A-Fa-f]{0,4}:|(?<=\p{Nd})(?:\P{Nd}{0,3}\p{Nd}){3}|(?<=[A-Z])[A-Z]\p{Nd}{2} ?[A-Z0-9]{4}"
         rf"|(?<=[{_INITIALS}])(?:{_TAILS})\.? [\p{{L}}\p{{N}}])")


_GROUPS = re.compile(r"\d+")
#: Years that stand alone or in lists.
YEARS = range(1500, 2100)


def _is_date(parts: list[str]) -> bool:
    """Year, month and day in one of the usual orders."""
    if len(parts) != 3:
        return False
    a, b, c = (int(p) for p in parts)
    if len(parts[0]) == 4:
        return a in YEARS and 1 <= b <= 12 and 1 <= c <= 31
    return len(parts[2]) in (2, 4) and (len(parts[2]) == 2 or c in YEARS) and 1 <= min(a, b) <= 12 and 1 <= max(a, b) <= 31


def _is_book_number(digits: str) -> bool:
    """An ISBN by its check digit."""
    if len(digits) == 13 and digits[:3] in ("978", "979"):
        return sum(int(d) * (1 + 2 * (i % 2)) for i, d in enumerate(digits)) % 10 == 0
    return len(digits) == 10 and sum(int(d) * (10 - i) for i, d in enumerate(digits)) % 11 == 0


def is_phone(written: str) -> bool:
    """Seven digits or more that are no date, list of years, range or book number; a + or brackets settle it."""
    parts = _GROUPS.findall(written)
    digits = "".join(parts)
    if len(digits) < 7:
        return False
    if "+" in written or "(" in written:
        return True
    if _is_date(parts) or all(len(p) == 4 and int(p) in YEARS for p in parts):
        return False
    return not (len(parts) > 2 and "." not in written and _is_book_number(digits))


def _is_ipv6(written: str) -> bool:
    try:
        return ipaddress.ip_address(written).version == 6 and any(c.isdecimal() for c in written)
    except ValueError:
        return False


class Mention:
    """A part of a text: kind, what identifies the entity, and how this mention writes it."""

    def __init__(self, kind: str, start: int, end: int, written: str):
        self.kind, self.start, self.end, self.written = kind, start, end, written
        if kind == "email" or kind.startswith("name"):
            self.entity = written.lower()
        elif kind == "iban":
            self.entity = written.replace(" ", "")
        elif kind == "ip":
            self.entity = ".".join(str(int(x)) for x in written.split("."))
        elif kind == "ipv6":
            self.entity = str(ipaddress.ip_address(written))
        else:
            self.entity = "".join(str(unicodedata.decimal(c)) for c in written if c.isdecimal())

    def render(self, surrogate: str) -> str:
        """The surrogate in the format of this mention."""
        if self.kind in ("ip", "ipv6"):
            return surrogate
        if self.kind == "email" or self.kind.startswith("name"):
            if self.written.isupper():
                return surrogate.upper()
            return surrogate if self.kind == "email" else "-".join(p[:1].title() + p[1:] for p in surrogate.split("-"))
        signs = iter(surrogate)
        return "".join(_digit(c, next(signs)) if c.isalnum() else c for c in self.written)


def mentions(text: str) -> list[Mention]:
    """All mentions of a text, in order and without overlap."""
    out = []
    for m in PATTERNS.finditer(text):
        kind = m.lastgroup if m["person"] is None else "person"
        if kind != "person":
            kind = next(k for k in ("email", "ip", "ipv6", "iban", "ssn", "card", "phone") if m[k] is not None)
            if kind == "phone" and not is_phone(m[0]) or kind == "ipv6" and not _is_ipv6(m[0]) or kind == "card" and _is_book_number(
                    "".join(_GROUPS.findall(m[0]))):
                continue
            out.append(Mention(kind, m.start(), m.end(), m[0]))
            continue
        gender, at, parts = _GENDER[m["title"].upper()], m.start("names"), m["names"].split(" ")
        for i, part in enumerate(parts):
            kind = "name_last" if i == len(parts) - 1 else f"name_{gender}"
            out.append(Mention(kind, at, at + len(part), part))
            at += len(part) + 1
    return out


def with_repeats(text: str, found: list[Mention]) -> list[Mention]:
    """``found`` and the other places where the text has a found name part as a whole, capitalised word, in order.

    Single letters are no such parts. A part that was found as given and as last name is taken as it was found first.
    """
    kinds: dict[str, str] = {}
    for m in found:
        if m.kind.startswith("name") and len(m.entity) > 1:
            kinds.setdefault(m.entity, m.kind)
    if not kinds:
        return found
    parts = "|".join(map(re.escape, sorted(kinds, key=len, reverse=True)))
    out, at = [], 0
    for m in re.finditer(rf"(?<![\w{_MARKS}])(?:{parts})(?![\w{_MARKS}])", text, re.I):
        while at < len(found) and found[at].end <= m.start():
            out.append(found[at])
            at += 1
        apart = at == len(found) or m.end() <= found[at].start
        if apart and not m[0][0].islower() and m[0].lower() in kinds:
            out.append(Mention(kinds[m[0].lower()], m.start(), m.end(), m[0]))
    return out + found[at:]


class Draw:
    """Keyed draws for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.seed, self.turn = f"{kind}\0{entity}\0{attempt}".encode(), 0
        self.key, self.pool = key, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.new(self.key, self.seed + self.turn.to_bytes(4, "big"), sha256).digest()
            self.turn += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % n


def _digit(like: str, digit: str) -> str:
    """A digit written in the digits of ``like``, if that is one."""
    return chr(ord(like) - unicodedata.decimal(like) + int(digit)) if like.isdecimal() and digit.isdecimal() else digit


def _script(letter: str) -> str:
    return unicodedata.name(letter, "LATIN").split()[0]


@cache
def _alphabets() -> tuple[list[int], list[list[str]], dict[str, list[str]]]:
    """Uncased and lower-case letters outside Latin: first code points, letters of each alphabet, the largest of each script."""
    runs: list[list[str]] = []
    last, before = 0, ""
    for o in range(0x250, sys.maxunicode + 1):
        c = chr(o)
        kind = unicodedata.category(c)
        if kind == "Lu":
            before = ""
        elif kind in ("Ll", "Lo") and (script := _script(c)) != "LATIN":
            if before != kind + script or o - last > GAP:
                runs.append([])
            runs[-1].append(c)
            last, before = o, kind + script
    most: dict[str, list[str]] = {}
    for run in runs:
        script = _script(run[0])
        most[script] = max(most.get(script, []), run, key=len)
    return [ord(run[0]) for run in runs], runs, most


@cache
def _alphabet(letter: str) -> list[str]:
    """Letters that may stand for a lower-case or uncased one: those around it in its script, a to z for Latin."""
    if ord(letter) > 0x24F and (script := _script(letter)) != "LATIN":
        firsts, runs, most = _alphabets()
        run = runs[max(bisect_right(firsts, ord(letter)) - 1, 0)]
        if len(run) < 2 or letter not in _members(run[0]):
            run = most.get(script, [])
        if len(run) > 1:
            return run
    return LATIN


@cache
def _members(first: str) -> frozenset[str]:
    firsts, runs, _ = _alphabets()
    return frozenset(runs[bisect_right(firsts, ord(first)) - 1])


LATIN = [chr(o) for o in range(ord("a"), ord("z") + 1)]


def _like(text: str, draw: Draw) -> str:
    """Digits for digits and other letters for letters of the same script; other signs stay."""
    out = []
    for c in text:
        if c.isdecimal():
            out.append(_digit(c, str(draw.below(10))))
        elif c.isalpha() and unicodedata.category(c) != "Lm":
            lower = c.lower()[0]
            letters = _alphabet(lower)
            letter = letters[draw.below(len(letters))]
            while letter == lower:
                letter = letters[draw.below(len(letters))]
            out.append(letter.upper() if c.isupper() else letter)
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """Replacement of an entity; a later attempt gives another, with more room where the format allows."""
    draw = Draw(key, kind, entity, attempt)
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ipv6":  # the range set aside for examples
        return "2001:db8:" + ":".join(f"{1 + draw.below(0xFFFF):x}" for _ in range(6))
    if kind == "email":
        local, _, domain = entity.partition("@")
        host, _, top = domain.rpartition(".")
        # The same domain gets the same host in all addresses.
        host = _like(host, Draw(key, "host", host, 0)) if "example" not in host.split(".") else host
        more = "".join(chr(97 + draw.below(26)) for _ in range(max(0, 4 - len(local)) + attempt // 4))
        return f"{_like(local, draw)}{more}@{host}.{top}"
    if kind == "iban":
        return entity[:2] + _like(entity[2:], draw)
    if kind.startswith("name"):
        foreign = [c for c in entity if ord(c) > 0x24F and c.isalpha() and _script(c) != "LATIN"]
        if foreign:  # more letters when those of the same length are taken
            return _like(entity, draw) + "".join(_like(foreign[-1], draw) for _ in range(attempt // 4))
        if kind == "name_last":
            return "".join(SYLLABLES[draw.below(len(SYLLABLES))] for _ in range(3 + attempt // 2)) + "nrlst"[draw.below(5)]
        given = GIVEN[kind[-1]]
        name = given[draw.below(len(given))].lower()
        if attempt:  # a second given name when the first ones are taken
            name += "-" + "".join(SYLLABLES[draw.below(len(SYLLABLES))] for _ in range(1 + attempt // 2)) + ("a" if kind[-1] == "f" else "n")
        return name
    if kind == "card" and _luhn(entity) == 0:
        body = entity[0] + _like(entity[1:-1], draw)
        return body + str(-_luhn(body + "0") % 10)
    keep = 1 if kind == "phone" and len(entity) > 10 else 0  # the country code's first digit
    return entity[:keep] + _like(entity[keep:], draw)


#: Attempts after which a format has no room left for another distinct entity.
MAX_ATTEMPTS = 200


def entities(texts: DataFrame) -> DataFrame:
    """(key, kind, entity) of each distinct mention of (key, text)."""

    @F.pandas_udf("array<struct<kind:string,entity:string>>")
    def found(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: [{"kind": k, "entity": e} for k, e in dict.fromkeys((m.kind, m.entity) for m in mentions(t))])

    return texts.select("key", F.explode(found.asNondeterministic()("text")).alias("m")).select("key", "m.*").distinct()


def _drawing(secret: bytes, attempt: int):
    def draw(kinds: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([surrogate(secret, k, e, attempt) for k, e in zip(kinds, names)], dtype=object)

    return F.pandas_udf(draw, "string").asNondeterministic()


def draw_surrogates(known: DataFrame, key: str) -> DataFrame:
    """Written (kind, entity, surrogate) for distinct (kind, entity): one to one, and no surrogate is an entity of its kind.

    Given names are compared over all genders. Each turn keeps the draws that hit nothing and draws the others again.
    """
    secret = key.encode()
    family = F.when(F.col("kind").startswith("name_") & (F.col("kind") != "name_last"), "given").otherwise(F.col("kind"))
    real = stage(known.select("kind", "entity", family.alias("family")), "pii_entities")
    open_, taken = real, None
    for attempt in range(MAX_ATTEMPTS):
        drawn = stage(open_.withColumn("surrogate", _drawing(secret, attempt)("kind", "entity")), "pii_drawn")
        free = drawn.join(real.select("family", F.col("entity").alias("surrogate")).distinct(), ["family", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("family", "surrogate"), ["family", "surrogate"], "left_anti")
        first = free.groupBy("family", "surrogate").agg(F.min(F.struct("entity", "kind")).alias("f")).select(
            "family", "surrogate", "f.entity", "f.kind")
        kept = stage(first, "pii_kept")
        taken = kept if taken is None else taken.unionByName(kept)
        open_ = stage(open_.join(kept.select("kind", "entity"), ["kind", "entity"], "left_anti"), "pii_open")
        if open_.isEmpty():
            return taken.select("kind", "entity", "surrogate")
    raise ValueError("a format has fewer values than the corpus has entities; give such entities another format")


def replace(text: str, table: dict[tuple[str, str], str]) -> str:
    out, at = [], 0
    for m in with_repeats(text, mentions(text)):
        out += [text[at:m.start], m.render(table[m.kind, m.entity])]
        at = m.end
    return "".join(out) + text[at:]


def pseudonymized(docs: DataFrame, key: str, columns: list[str], text_col: str = "text") -> DataFrame:
    """(columns, text, n_entities): every row with its personal data replaced; ``key`` is the secret.

    ``n_entities`` counts distinct entities. Null texts stay null; texts without entities stay as they are. Repeated rows are
    replaced alike. ``columns`` are returned as they were and must not hold personal data themselves.
    """
    slim = docs.select(F.struct(*columns).alias("row"), F.col(text_col).alias("text"))
    maybe = F.coalesce(F.rlike("text", F.lit(QUICK)), F.lit(False))
    plain = slim.filter(~maybe).select("row", "text", F.lit(0).cast("bigint").alias("n_entities"))
    due = slim.filter(maybe).withColumn("key", text_key(F.col("text")))
    found = stage(entities(due.select("key", "text")), "pii_mentions")
    table = draw_surrogates(found.select("kind", "entity").distinct(), key)
    per_text = found.join(table, ["kind", "entity"]).groupBy("key").agg(
        F.collect_list(F.struct("kind", "entity", "surrogate")).alias("table"))
    per_text = stage(per_text, "pii_per_text")

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, tables: pd.Series) -> pd.Series:
        return pd.Series([t if x is None else replace(t, {(e["kind"], e["entity"]): e["surrogate"] for e in x})
                          for t, x in zip(texts, tables)], dtype=object)

    changed = due.join(per_text, "key", "left").select(
        "row", replaced.asNondeterministic()("text", "table").alias("text"),
        F.coalesce(F.size("table"), F.lit(0)).cast("bigint").alias("n_entities"))
    out = plain.unionByName(changed)
    return out.select(*[F.col(f"row.{c}") for c in columns], "text", "n_entities")
