"""Periodic runs of words, found by difference-cover longest common extensions on a harmonic grid.

A run is a stretch of words with smallest period q (words q apart are equal) of at least
``max(LEAST, 2q)`` words that no neighbouring word extends. Its words and those q further on
are an equal stretch of at least ``max(LEAST - q, q)`` words, so for every period the points at
multiples of that step meet each run (Main, Lorentz 1984; Kolpakov, Kucherov 1999): about
n log n points for n words. At a point, a few words are compared. Where they agree, the longest
common extensions forward and backward give the whole run.

Extensions come from a difference cover (Burkhardt, Kärkkäinen 2003): only suffixes at positions
whose remainder by MODULUS is in COVER are sorted. For any two positions fewer than MODULUS words
have to be compared to reach two sampled ones, and a sparse table of range minima over the
common prefixes of neighbours in sorted order gives the rest.

Texts stay whole. Many texts are handled as one array with separators that occur once, so the
work is done in a few array operations; only texts in which words agree at a point are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F

LEAST = 12
MODULUS, COVER = 13, (0, 1, 3, 9)  # every difference modulo 13 occurs between two members
#: Words and grid points handled in one array; a longer text is an array of its own.
BATCH_WORDS, BATCH_POINTS = 1 << 17, 1 << 19

RUN = "struct<start: bigint, length: bigint, period: bigint>"
FOUND = f"struct<n_words: bigint, runs: array<{RUN}>, collapsed: string>"


def _shifts() -> np.ndarray:
    """For two remainders, the least step that takes both into the cover."""
    inside = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    step = np.arange(MODULUS)
    both = inside[step[:, None, None] + step] & inside[step[None, :, None] + step]
    return both.argmax(axis=2)


SHIFTS = _shifts()


def _dense(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Ranks from a sorting order and marks of the rows that differ from the one before."""
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new) - 1
    return ranks


class Extensions:
    """Longest common extensions to the right in an array of words that ends with a word of its own."""

    def __init__(self, words: np.ndarray) -> None:
        self.n = len(words)
        # Behind the end, words that occur nowhere else.
        self.words = np.concatenate([words, -1 - np.arange(2 * MODULUS)])
        self.minima: list[np.ndarray] | None = None

    def lengths(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from ``i`` and ``j`` on, where ``i`` and ``j`` differ."""
        shift = SHIFTS[i % MODULUS, j % MODULUS]
        found = np.zeros(len(i), np.int64)
        left = np.arange(len(i))
        for k in range(MODULUS):
            near = left[shift[left] > k]
            unequal = near[self.words[i[near] + k] != self.words[j[near] + k]]
            found[unequal] = k
            shift[unequal] = -1
            left = left[shift[left] >= 0]
            if not len(left):
                return found
        if self.minima is None:
            self._sort_samples()
        a, b = self.rank_at[i[left] + shift[left]], self.rank_at[j[left] + shift[left]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1
        rest = np.empty(len(left), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            rest[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
        found[left] = shift[left] + rest
        return found

    def _sort_samples(self) -> None:
        """Order of the sampled suffixes by doubling, and range minima of their neighbours' common prefixes."""
        at = np.concatenate([np.arange(c, self.n, MODULUS) for c in COVER])
        m = len(at)
        index = np.full(self.n + MODULUS, m)
        index[at] = np.arange(m)

        # First by MODULUS words, as many to a number as fit.
        low = int(self.words.min())
        bits = int(self.words.max() - low).bit_length()
        per = max(1, 62 // max(1, bits))
        keys = []
        for first in range(0, MODULUS, per):
            key = np.zeros(m, np.int64)
            for k in range(first, min(first + per, MODULUS)):
                key = (key << bits) | (self.words[at + k] - low)
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.ones(m, bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        ranks = [_dense(order, new)]

        # Then by twice as many each time, until all differ; the rank behind the end is -1.
        span = MODULUS
        while ranks[-1].max() + 1 < m:
            follower = np.append(ranks[-1], -1)[index[np.minimum(at + span, self.n)]]
            key = ranks[-1] * (m + 1) + follower + 1
            order = np.argsort(key, kind="stable")
            new = np.ones(m, bool)
            new[1:] = key[order][1:] != key[order][:-1]
            ranks.append(_dense(order, new))
            span *= 2

        a, b = at[order[:-1]], at[order[1:]]
        common = np.zeros(max(0, m - 1), np.int64)
        for level in range(len(ranks) - 2, -1, -1):
            equal = ranks[level][index[a + common]] == ranks[level][index[b + common]]
            common += np.where(equal, MODULUS << level, 0)
        going = np.ones(len(common), bool)
        for _ in range(MODULUS):
            going &= self.words[a + common] == self.words[b + common]
            common += going
        self.rank_at = np.full(self.n, -1)
        self.rank_at[at] = ranks[-1]
        self.minima = [common]
        while 2 << (len(self.minima) - 1) <= len(common):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))


def _points(n: int) -> int:
    """Upper bound of the grid points of a text of ``n`` words."""
    return int(n * (np.log(max(n, 2)) + 1)) if n >= LEAST else 0


def _grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, position and period of all grid points of the texts at ``starts``, in parts."""
    periods = np.where(sizes >= LEAST, sizes // 2, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(period, LEAST - period)
    count = -(-(sizes[text] - period) // step)
    upto = np.cumsum(count)
    first = 0
    while first < len(text):
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + BATCH_POINTS, "right")))
        part = slice(first, last)
        of = np.repeat(np.arange(first, last), count[part])
        k = np.arange(len(of)) - np.repeat(upto[part] - count[part] - done, count[part])
        yield text[of], starts[text[of]] + k * step[of], period[of]
        first = last


def _agreeing(words: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Grid points whose word returns one period on, as do the two words behind it or the three before it.

    An equal stretch around a point has six words or more. ``words`` has three words of their own at either end.
    """
    kept = np.flatnonzero(words[at] == words[at + period])
    i = at[kept]
    j = i + period[kept]
    ahead = (words[i + 1] == words[j + 1]) & (words[i + 2] == words[j + 2])
    before = (words[i - 1] == words[j - 1]) & (words[i - 2] == words[j - 2]) & (words[i - 3] == words[j - 3])
    return kept[ahead | before]


def _unique_runs(text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period), one per stretch with its smallest period, in order of text, start, period.

    A stretch found with a multiple of its smallest period is the same stretch (Fine, Wilf 1965).
    """
    rows = np.stack([text, start, length, period], axis=1)
    rows = rows[np.lexsort((period, length, start, text))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _runs_of_group(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of the texts at ``starts``: (text, start, length, period), start counted within its text."""
    found = np.empty((0, 4), np.int64)
    forward = None
    for text, at, period in _grid(starts, sizes):
        kept = _agreeing(words, at, period)
        if not len(kept):
            continue
        text, at, period = text[kept], at[kept], period[kept]
        if forward is None:  # a group is one part, or one text in several
            chosen = np.unique(text)
            places = np.cumsum(sizes[chosen] + 1) - sizes[chosen]
            whole = np.full(int((sizes[chosen] + 1).sum()) + 1, -1, np.int64)
            inner = np.repeat(starts[chosen] - places, sizes[chosen])
            filled = np.arange(int(sizes[chosen].sum())) + np.repeat(np.arange(len(chosen)) + 1, sizes[chosen])
            whole[filled] = words[filled + inner]
            gaps = np.flatnonzero(whole < 0)
            whole[gaps] = words.max() + 1 + np.arange(len(gaps))
            move = np.zeros(len(sizes), np.int64)
            move[chosen] = places - starts[chosen]
            forward, backward = Extensions(whole), Extensions(whole[::-1].copy())
        i = at + move[text]
        ahead = forward.lengths(i, i + period)
        behind = backward.lengths(len(whole) - i, len(whole) - i - period)
        length = ahead + behind + period
        long = (ahead > 0) & (length >= np.maximum(LEAST, 2 * period))
        part = np.stack([text, at - behind - starts[text], length, period], axis=1)[long]
        found = _unique_runs(*np.concatenate([found, part]).T)
    return found


def find_runs(texts: list[list]) -> list[np.ndarray]:
    """For each list of words its runs, rows of (start, length, period) in order of start, then period."""
    out: list[np.ndarray] = [np.empty((0, 3), np.int64)] * len(texts)
    first = 0
    while first < len(texts):
        last, words, points = first, 0, 0
        while last < len(texts) and (last == first or (
                words + len(texts[last]) <= BATCH_WORDS and points + _points(len(texts[last])) <= BATCH_POINTS)):
            words, points, last = words + len(texts[last]), points + _points(len(texts[last])), last + 1
        sizes = np.array([len(t) for t in texts[first:last]], np.int64)
        flat = np.empty(int(sizes.sum()), object)
        flat[:] = [w for t in texts[first:last] for w in t]
        ids = pd.factorize(flat)[0].astype(np.int64)
        # Three words of their own at either end; text borders are checked by the extensions.
        ids = np.concatenate([[-1, -2, -3], ids, [-4, -5, -6]])
        starts = np.cumsum(sizes) - sizes + 3
        rows = _runs_of_group(ids, starts, sizes)
        cuts = np.searchsorted(rows[:, 0], np.arange(len(sizes) + 1))
        for k in range(len(sizes)):
            out[first + k] = rows[cuts[k]:cuts[k + 1], 1:]
        first = last
    return out


def collapse(words: list, runs: np.ndarray) -> list:
    """The words without those that a run repeats: of each run its first period stays."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def _found(texts: pa.Array) -> pa.Array:
    # bytes.split cuts at blank and the control characters 9 to 13 alone.
    words = [(t or b"").split() for t in texts.cast(pa.binary()).to_pylist()]
    runs = find_runs(words)
    offsets = np.cumsum([0] + [len(r) for r in runs])
    rows = np.concatenate(runs + [np.empty((0, 3), np.int64)])
    parts = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"])
    return pa.StructArray.from_arrays([
        pa.array([len(w) for w in words], pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts),
        pa.array([b" ".join(collapse(w, r)) for w, r in zip(words, runs)], pa.binary()).cast(pa.string()),
    ], ["n_words", "runs", "collapsed"])


def periodic_runs(text: Column) -> Column:
    """Words, runs and collapsed words of a text: struct of n_words, runs (start, length, period), collapsed.

    Words are the stretches between blanks and the control characters 9 to 13. Runs come by start, then
    period, and overlapping runs are all listed. ``collapsed`` joins the kept words by one blank. A null or
    empty text has no words, no runs and an empty ``collapsed``. Rows are independent of each other.
    """

    def each(texts: pa.Array) -> pa.Array:
        return _found(texts)

    # Not to be copied by the optimizer: a copy would run once more.
    return F.arrow_udf(each, FOUND).asNondeterministic()(text)


def longest_run(runs: Column) -> Column:
    """The longest run; of equally long ones the first, then the one with the smallest period. Null without runs."""
    best = F.array_min(F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    return F.when(F.size(runs) > 0, best)
