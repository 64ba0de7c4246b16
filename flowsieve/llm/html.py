"""Main text of web pages by two passes of block rules.

A page is cut into blocks, the text between block tags. The first pass decides what it can, on every page:
a block in a menu, footer, advert, form or comment section, or one with many linked characters, is
bad; a long block scores by its stop words. The main element is the article, main or content element that holds most of the
page's good text. Inside it a long block scores one step higher, outside it, or in an article element without good text, every
block one step lower. Short blocks and headings stay open. In the second pass an open block takes the label of its
nearest decided neighbours, inside the main element of those inside, and a heading there that of its section.

Pages are independent: one pass over the table, no shuffle. Parsing is a linear scan of tags;
memory is about 10 times the longest page.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, functions as F

#: Characters from which a block is long.
LONG = 70
#: Share of stop words and of linked characters.
STOP_DENSITY, FEW_STOPS, MAX_LINKS = 0.3, 0.15, 0.35

#: Frequent words of some languages; names of elements, and words of classes and ids.
STOP_WORDS = frozenset("""
the of and a to in is that it was for with as on by this are from at be or an not have which
der die das und in zu den mit von für auf ist im dem nicht ein eine sich als auch es an werden aus
le la les de des et en un une du que qui est dans pour par sur au pas il se ce sont avec
el los las y del se por con una para su al lo como más pero sus es no ha
il che di e per non una sono con del della een het van dat niet zijn o os da do em um
""".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|svg|title|object|select|math|canvas|audio|video"
ASIDE = frozenset("nav footer aside form button menu dialog fieldset head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
ASIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored banner promo promotion cookie cookies
consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments
disqus reply replies share sharing social related recommended teaser newsletter subscribe subscription signup login popup modal
overlay widget widgets toolbar pagination pager copyright disclaimer searchbox""".split())
MAIN_WORDS = frozenset("article articlebody post entry story content main text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?>[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.I | re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[^\W\d_]+")

BAD, MAIN_CLASS, MAIN, ARTICLE, HEADER, LINK = 1, 2, 4, 8, 16, 32
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
Block = tuple[str, int, float, str, int]


def _flags(tag: str, attrs: str, now: int) -> int:
    """What an element adds to its surroundings' flags."""
    flags = now
    if tag in ASIDE:
        flags |= BAD
    elif tag == "article":
        flags |= ARTICLE
    elif tag == "main":
        flags |= MAIN
    elif tag == "a":
        flags |= LINK
    elif tag == "header":  # an article's own header holds its title
        flags |= HEADER if now & (ARTICLE | MAIN) else BAD
    if attrs and tag not in ("html", "body"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "itemprop"):
                parts = set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value)))
                if parts & ASIDE_WORDS and tag != "main":
                    flags |= BAD
                elif "header" in parts and not now & (ARTICLE | MAIN | MAIN_CLASS) and not parts & MAIN_WORDS:
                    flags |= BAD
                elif parts & MAIN_WORDS:
                    flags |= MAIN_CLASS
            elif name == "role":
                flags |= BAD if value in ASIDE_ROLES else MAIN if value == "main" else 0
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(
                    r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                flags |= BAD
    return flags


def blocks(html: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """Blocks in page order, without empty ones, and the elements that may be the main one.

    A block is (text, flags, share of linked characters, innermost block element, innermost possible main element or -1).
    An element is (the one around it or -1, its flags as such an element).
    """
    out: list[Block] = []
    elements: list[tuple[int, int]] = []
    stack: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = total = 0
    block_flags, block_tag, block_element, at = 0, "", -1, 0

    def close() -> None:
        nonlocal parts, linked, total
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, block_flags, linked / max(total, 1), block_tag, block_element))
        parts, linked, total = [], 0, 0

    def say(text: str) -> None:
        nonlocal linked, total, block_flags, block_tag, block_element
        now = stack[-1][1] if stack else 0
        if parts and (now ^ block_flags) & ~LINK:  # an inline element with flags of its own
            close()
        text = unescape(text)
        if not parts:
            block_flags = now & ~LINK
            block_tag = next((t for t, _, _ in reversed(stack) if t in BLOCK), "")
            block_element = stack[-1][2] if stack else -1
        parts.append(text)
        size = len(text.strip())
        total += size
        linked += size if now & LINK else 0

    def leave(tag: str, stop: frozenset = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            say(html[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            close()
        if m["end"]:
            leave(tag)
        elif tag not in VOID and not (m["attrs"] or "").endswith("/"):
            if tag in BLOCK:
                leave("p", CONTAINERS)
            if tag == "li":
                leave("li", LISTS)
            now, element = stack[-1][1:] if stack else (0, -1)
            flags = _flags(tag, m["attrs"] or "", now)
            own = _flags(tag, m["attrs"] or "", 0) & (ARTICLE | MAIN | MAIN_CLASS) if flags & (ARTICLE | MAIN | MAIN_CLASS) else 0
            if own:
                elements.append((element, own))
                element = len(elements) - 1
            stack.append((tag, flags, element))
    if at < len(html):
        say(html[at:])
    close()
    return out, elements


CONTAINERS = frozenset("article aside body blockquote div dd dt fieldset figure footer form header html li main nav section table td th".split())
LISTS = frozenset("ul ol menu".split())


def _main(found: list[Block], stops: list[float], elements: list[tuple[int, int]]) -> tuple[list[bool], list[bool]]:
    """Whether each element lies in the main one, and whether it has none of the page's good text."""
    holds, total = [0] * len(elements), 0
    for (text, flags, links, tag, element), share in zip(found, stops):
        least = STOP_DENSITY if element < 0 else FEW_STOPS
        if not flags & BAD and links <= MAX_LINKS and len(text) >= LONG and tag not in HEADINGS and share >= least:
            total += len(text)
            if element >= 0:
                holds[element] += len(text)
    for i in range(len(elements) - 1, -1, -1):  # an element comes after the one around it
        if elements[i][0] >= 0:
            holds[elements[i][0]] += holds[i]
    kinds = (ARTICLE, MAIN, MAIN_CLASS)
    chosen: set[int] = set()
    if total:
        most = [i for i, n in enumerate(holds) if 2 * n > total]
        first = next(([i for i in most if elements[i][1] & kind] for kind in kinds if any(elements[i][1] & kind for i in most)), [])
        if first:
            chosen = {first[0]}
        elif 2 * sum(n for (around, _), n in zip(elements, holds) if around < 0) > total:
            chosen = {i for i, n in enumerate(holds) if n}
    else:
        seen = {b[4] for b in found if not b[1] & BAD and b[4] >= 0}
        for i in range(len(elements) - 1, -1, -1):
            if i in seen:
                seen.add(elements[i][0])
        kind = next((k for k in kinds if any(elements[i][1] & k for i in seen if i >= 0)), 0)
        chosen = {i for i, (_, own) in enumerate(elements) if own & kind}
    inside: list[bool] = []
    for i, (around, _) in enumerate(elements):
        inside.append(i in chosen or around >= 0 and inside[around])
    return inside, [bool(total) and not n for n in holds]


def classify(found: list[Block], elements: list[tuple[int, int]]) -> list[bool]:
    """Whether each block belongs to the main text."""
    stops = []
    for block in found:
        words = _WORD.findall(block[0].lower())
        stops.append(sum(w in STOP_WORDS for w in words) / max(len(words), 1))
    main, idle = _main(found, stops, elements)
    labels: list[bool | None] = []
    within = []
    for (text, flags, links, tag, element), share in zip(found, stops):
        inside = element >= 0 and main[element]
        within.append(inside and not flags & BAD)
        long = len(text) >= LONG and tag not in HEADINGS
        if flags & BAD or links > MAX_LINKS and not (inside and tag in HEADINGS):
            label: bool | None = False
        elif ("©" in text or "&copy" in text) and not (inside and long):
            label = False
        else:
            score = 1 if not long else 2 if share >= STOP_DENSITY else 1 if share >= FEW_STOPS else 0
            if inside:
                score += long
            elif any(main) or element >= 0 and idle[element]:
                score -= 1
            elif element >= 0:
                score += long
            label = True if score >= 2 else None if score == 1 else False
        labels.append(label)
    before, after = _nearest(labels, within), _nearest(labels[::-1], within[::-1])[::-1]
    section = _sections(found, labels, within)
    out = []
    for i, label in enumerate(labels):
        if label is None:
            left = (before[i], labels[before[i]]) if before[i] >= 0 else None
            right = (len(labels) - 1 - after[i], labels[len(labels) - 1 - after[i]]) if after[i] >= 0 else None
            if within[i]:  # only neighbours inside count; without any the element decides
                left, right = left or right or (i, True), right or left or (i, True)
            else:
                left, right = left or (-1, False), right or (len(labels), False)
            if section[i] is not None:
                label = section[i]
            elif left[1] == right[1]:
                label = left[1]
            elif stops[i] >= STOP_DENSITY and len(found[i][0]) >= LONG:
                label = True
            else:
                label = left[1] if i - left[0] < right[0] - i else right[1]
        out.append(bool(label))
    return out


def _nearest(labels: list[bool | None], within: list[bool]) -> list[int]:
    """The last decided block up to each one, or -1; for a block within the main element, the last one within."""
    out, last, last_within = [], -1, -1
    for i, label in enumerate(labels):
        if label is not None:
            last = i
            last_within = i if within[i] else last_within
        out.append(last_within if within[i] else last)
    return out


def _sections(found: list[Block], labels: list[bool | None], within: list[bool]) -> list[bool | None]:
    """For each open heading within the main element, whether its section has a good block; None where nothing is decided."""
    out: list[bool | None] = [None] * len(found)
    ends: list[bool | None] = [None] * 7  # what is decided from here to the next heading of this level or above
    for i in range(len(found) - 1, -1, -1):
        if not within[i]:
            continue
        tag = found[i][3]
        if labels[i] is not None:
            ends = [bool(e) or labels[i] for e in ends]
        if tag in HEADINGS:
            level = int(tag[1])
            out[i] = ends[level] if labels[i] is None else None
            ends[level:] = [None] * (7 - level)
    return out


def extract(html: str) -> str:
    """Main text of a page: its good blocks joined by one space."""
    found, elements = blocks(html)
    return " ".join(b[0] for b, good in zip(found, classify(found, elements)) if good)


def main_text(html: Column) -> Column:
    """Main text of a page; null and empty pages give an empty one. Whole pages, whatever their length."""

    def each(pages: pd.Series) -> pd.Series:
        return pages.fillna("").map(extract)

    # Not to be copied by the optimizer: a copy would run once more.
    return F.pandas_udf(each, "string").asNondeterministic()(html)
