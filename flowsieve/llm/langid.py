"""Language identification of mixed texts.

A word is a run of letters. Each word gets a score per language: the log-likelihood of its
letter trigrams (with word edges) under that language's counts. Unicode script ranges narrow
the candidates first: a language competes for a word only if its training texts use the word's
script. Viterbi over the words, with a penalty for every switch, labels spans, so a foreign
passage is its own span while a single odd word is not. The language of a text is the one
whose spans have most letters; the score is their share.

Trigrams are hashed into a fixed number of cells, so the model's size depends on the
languages only. Counts are summed by Spark; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

CELLS = 2 ** 15
#: Rows per language that train the model, about. More do not change cell counts noticeably.
TRAIN_ROWS = 20_000
SWITCH_PENALTY = 12.0
SMOOTHING = 0.5
#: A language uses a script that has this share of its training letters.
SCRIPT_SHARE = 0.01
#: Characters and words handled at once.
SLICE_CHARS = 4_000_000
UNKNOWN = "und"

#: First code point of ranges, with their script; 0 stands for all others.
SCRIPTS = [
    (0x0041, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0),
    (0x0750, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 0), (0x0B80, 11),
    (0x0C00, 12), (0x0C80, 13), (0x0D00, 14), (0x0D80, 0), (0x0E00, 15), (0x0E80, 0), (0x10A0, 16), (0x1100, 17),
    (0x1200, 18), (0x13A0, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 19), (0x3100, 0), (0x3400, 20),
    (0xA000, 0), (0xAC00, 17), (0xD7B0, 0), (0xF900, 20), (0xFB00, 1), (0xFB13, 0), (0xFB1D, 5), (0xFB50, 6),
    (0xFE00, 0), (0xFF21, 1), (0xFF66, 19), (0xFFA0, 0), (0x20000, 20), (0x323B0, 0),
]
N_SCRIPTS = 21


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@cache
def _script_starts() -> tuple[np.ndarray, np.ndarray]:
    starts, scripts = zip((0, 0), *SCRIPTS)
    return np.array(starts), np.array(scripts, np.int8)


class Words:
    """The words of some texts: flat arrays over letters and words."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        joined = "\n".join(lowered)
        lengths = np.array([len(t) + 1 for t in lowered], np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = _letters()[codes]
        at = np.flatnonzero(is_letter)
        own = codes[at].astype(np.uint32)
        before = np.where(at > 0, codes[at - 1] * is_letter[at - 1], 0).astype(np.uint32)
        last = len(codes) - 1
        after = np.where(at < last, codes[np.minimum(at + 1, last)] * is_letter[np.minimum(at + 1, last)], 0).astype(np.uint32)
        mixed = before * np.uint32(0x9E3779B1) + own * np.uint32(0x85EBCA6B) + after * np.uint32(0xC2B2AE35)
        mixed ^= mixed >> np.uint32(15)
        self.cells = ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(17)).astype(np.int32)
        self.starts = np.flatnonzero(before == 0)  # a letter without one before it begins a word
        ends = np.concatenate((np.cumsum(lengths), [0]))[: len(texts)]
        self.doc = np.searchsorted(ends, at[self.starts], side="right")
        self.n_letters = np.diff(np.append(self.starts, len(at)))
        borders, scripts = _script_starts()
        self.letter_scripts = scripts[np.searchsorted(borders, own, side="right") - 1]
        self.script = self.letter_scripts[self.starts] if len(at) else np.zeros(0, np.int8)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of texts with about SLICE_CHARS characters."""
    begin = chars = 0
    for i, text in enumerate(texts):
        if chars and chars + len(text) > SLICE_CHARS:
            yield begin, i
            begin, chars = i, 0
        chars += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, cell, n) of a partition; cells from CELLS on count letters by script."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch["text"].tolist(), batch["lang"].to_numpy()
        for a, b in _slices(texts):
            for lang in pd.unique(langs[a:b]):
                words = Words([t for t, x in zip(texts[a:b], langs[a:b]) if x == lang])
                total = totals.setdefault(lang, np.zeros(CELLS + N_SCRIPTS, np.int64))
                total[:CELLS] += np.bincount(words.cells, minlength=CELLS)
                total[CELLS:] += np.bincount(words.letter_scripts, minlength=N_SCRIPTS)
    for lang, total in totals.items():
        used = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "cell": used, "n": total[used]})


class Model:
    """Log-likelihood per language and cell, and the scripts each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams = counts[:, :CELLS] + SMOOTHING
        self.cells = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
        letters = counts[:, CELLS:]
        self.scripts = letters >= np.maximum(letters.sum(axis=1, keepdims=True) * SCRIPT_SHARE, 1)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, scores
        for a, b in _slices(texts):
            words = Words(texts[a:b])
            letters = self.letters_by_language(words, b - a)
            whole = letters.sum(axis=1)
            best = letters.argmax(axis=1)
            for i in np.flatnonzero(whole):
                names[a + i] = self.langs[best[i]]
            scores[a:b] = letters.max(axis=1) / np.maximum(whole, 1)
        return names, scores

    def letters_by_language(self, words: Words, n_docs: int) -> np.ndarray:
        k = len(self.langs)
        out = np.zeros((n_docs, k), np.int64)
        if len(words.starts):
            label = self.label(words)
            np.add.at(out, (words.doc, label), words.n_letters)
        return out

    def label(self, words: Words) -> np.ndarray:
        """Language of every word: the best path of each text."""
        k = len(self.langs)
        score = np.empty((len(words.starts), k), np.float32)
        for j in range(k):
            score[:, j] = np.add.reduceat(self.cells[j][words.cells], words.starts)
        fits = self.scripts.T[words.script]
        fits[~fits.any(axis=1)] = True
        score[~fits] = -1e6
        return viterbi(score, words.doc, SWITCH_PENALTY)


def viterbi(score: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row of ``score``, row by row within a doc; all docs advance together."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    length = np.diff(np.append(first, len(doc)))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # docs longer than t
    value = score[first].astype(np.float64)
    came, stays = np.zeros(len(doc), np.int16), np.ones(score.shape, bool)
    for t in range(1, length[0]):
        n = active[t]
        v, at = value[:n], first[:n] + t
        best = v.argmax(axis=1)
        switched = (np.take_along_axis(v, best[:, None], 1) - penalty)
        keep = v >= switched
        came[at], stays[at] = best, keep
        value[:n] = np.where(keep, v, switched) + score[at]
    label = np.empty(len(doc), np.int64)
    now = value.argmax(axis=1)
    for t in range(length[0] - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        label[at] = now[:n]
        now[:n] = np.where(stays[at, now[:n]], now[:n], came[at])
    return label


def train(docs: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """Fit on rows (key, text, lang) with text and language, about ``max_rows`` of each language, chosen by a hash of the key."""
    usable = docs.select("key", "text", "lang").filter("text is not null and lang is not null")
    share = usable.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(max_rows) / F.count("*")).alias("share"))
    chosen = usable.join(F.broadcast(share), "lang").filter(  # one row per language
        F.pmod(F.xxhash64(F.col("key"), F.length("text")), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    counts = chosen.select("lang", "text").mapInPandas(_count, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(
        F.sum("n").alias("n")).toPandas()  # CELLS rows per language at most
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), CELLS + N_SCRIPTS))
    table[[langs.index(x) for x in counts["lang"]], counts["cell"]] = counts["n"]
    return Model(langs, table)


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: a third, by the checksum of its id; a null id is not."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def language(model: Model, text: Column) -> Column:
    """(lang, score) of a text. Null, empty and texts without letters are ``und`` with score 0.

    A text goes through as a whole, whatever its length; memory is about 40 bytes a character
    of the longest text.
    """

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = model.predict(batch.fillna("").tolist())
            yield pd.DataFrame({"lang": names, "score": scores})

    # Not to be copied by the optimizer: a copy would run once more.
    return F.pandas_udf(predict, "lang string, score double").asNondeterministic()(text)
