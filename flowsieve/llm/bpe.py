"""Byte-level BPE: pieces by a scan of transition functions, cached pair merging, decoding by offsets.

A text is cut into pieces as the public pattern does:
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. No regular
expression runs. Every code point gets a class from an array, in which the few characters that the
pattern looks ahead are already settled: an apostrophe that would begin a contraction, white space
before white space or the end. What is left is an automaton of eight states, and whether a piece
begins at a code point depends on the state before it. A class is a function from states to states;
such functions compose associatively, and the ones that occur (a few dozen) are numbered, so that a
scan over them is an array operation: all stretches of a long text at once, then the stretches'
functions among each other, then the states.

Each piece is merged pair by pair, lowest rank first, as its bytes; results are kept for repeated
pieces. Of every token the end in the text's bytes is kept, so decoding places all tokens at once.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes handled in one array; a longer text is an array of its own.
BATCH_BYTES = 1 << 19
STRETCH = 64
#: Pieces whose tokens are remembered; when full, the memory starts anew.
REMEMBERED = 150_000

# Classes. SPACE and OTHER_SPACE are the last white space before something else; GAP is the rest of white space.
LETTER, NUMBER, SYMBOL, GAP, SPACE, OTHER_SPACE, SHORT, LONG, BORDER = range(9)
# States: what the last code point belongs to. FRESH: the next one begins a piece in any case.
FRESH, IN_LETTERS, IN_NUMBERS, IN_SYMBOLS, IN_GAP, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)

#: The White_Space property of Unicode.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Letters and numbers of Unicode 16 (first and last of each range), for a Python that knows an earlier version.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NUMBERS_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA))


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, per (class, state)."""
    after, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    after[LETTER] = [IN_LETTERS] * 6 + [FRESH, ONE_LEFT]
    after[NUMBER], after[SYMBOL] = IN_NUMBERS, IN_SYMBOLS
    after[GAP], after[SPACE], after[OTHER_SPACE] = IN_GAP, AFTER_SPACE, FRESH
    # An apostrophe within symbols is one of them.
    after[SHORT], after[LONG] = ONE_LEFT, TWO_LEFT
    after[[SHORT, LONG], [[IN_SYMBOLS], [AFTER_SPACE]]] = IN_SYMBOLS
    for kind, joined in ((LETTER, (IN_LETTERS, AFTER_SPACE, ONE_LEFT, TWO_LEFT)), (NUMBER, (IN_NUMBERS, AFTER_SPACE)),
                         (SYMBOL, (IN_SYMBOLS, AFTER_SPACE)), (SHORT, (IN_SYMBOLS, AFTER_SPACE)),
                         (LONG, (IN_SYMBOLS, AFTER_SPACE)), (GAP, (IN_GAP,))):
        begins[kind, list(joined)] = False
    return after, begins


AFTER, BEGINS = _automaton()


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """All compositions of the classes' functions, the nine classes first, and their products: [first, then]."""
    known = [tuple(f) for f in AFTER.tolist()]
    number: dict[tuple, int] = {}
    for f in known:
        number.setdefault(f, len(number))
    known = list(number)
    i = 0
    while i < len(known):
        for g in AFTER.tolist():
            f = tuple(g[s] for s in known[i])
            if f not in number:
                number[f] = len(known)
                known.append(f)
        i += 1
    product = [[number[tuple(g[s] for s in f)] for g in known] for f in known]
    return np.array(known, np.uint8), np.array(product, np.uint8)


FUNCTIONS, PRODUCT = _functions()
#: The number of each class's function.
OF_CLASS = np.array([next(k for k, f in enumerate(FUNCTIONS.tolist()) if f == g) for g in AFTER.tolist()], np.uint8)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, before looking ahead. White space is GAP."""
    out = np.full(0x110000, SYMBOL, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    for kind, ranges in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
        for first, last in ranges:
            out[first:last + 1] = kind
    out[list(WHITE_SPACE)] = GAP
    return out


def _settled(points: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Class of every code point; ``border`` marks the ones that stand between texts."""
    kind = classes()[points]
    kind[border] = BORDER
    ahead = np.append(kind[1:], BORDER)
    white = kind == GAP
    last = white & (ahead != GAP) & (ahead != BORDER)
    kind[last] = np.where(points[last] == 0x20, SPACE, OTHER_SPACE)
    at = np.flatnonzero((points == 0x27) & (kind == SYMBOL))
    padded = np.append(points, [0, 0])
    one, two = padded[at + 1], padded[at + 2]
    is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
    kind[at[is_(one, "stmd")]] = SHORT
    kind[at[(is_(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]] = LONG
    return kind


def piece_starts(points: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Marks the code points at which a piece begins."""
    kind = _settled(points, border)
    n = len(kind)
    rows = -(-n // STRETCH)
    padded = np.full(rows * STRETCH, BORDER, np.uint8)
    padded[:n] = kind
    # One column per place in a stretch, so that each step takes all stretches at once.
    steps = np.ascontiguousarray(padded.reshape(rows, STRETCH).T)
    flat = PRODUCT.ravel()
    width = np.intp(len(PRODUCT))
    whole = OF_CLASS[steps[0]]
    for column in steps[1:]:
        whole = flat[whole * width + OF_CLASS[column]]
    # Inclusive scan over the stretches, by doubling.
    gap = 1
    while gap < rows:
        whole = np.concatenate([whole[:gap], flat[whole[:-gap] * width + whole[gap:]]])
        gap *= 2
    state = np.concatenate([[FRESH], FUNCTIONS[whole[:-1], FRESH]]).astype(np.uint8)
    out = np.empty((STRETCH, rows), bool)
    begins, after = BEGINS.ravel(), AFTER.ravel()
    for k, column in enumerate(steps):
        at = column * np.intp(8) + state
        out[k], state = begins[at], after[at]
    return out.T.ravel()[:n]


class Vocabulary:
    """Ranks of byte strings: the file's lines hold a token in base 64 and its id."""

    def __init__(self, file: bytes) -> None:
        lines = (line.split() for line in file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.remembered: dict[bytes, bytes] = {}
        tokens = sorted(self.ranks.items(), key=lambda t: t[1])
        size = tokens[-1][1] + 1
        self.sizes = np.zeros(size, np.int64)
        self.sizes[[r for _, r in tokens]] = [len(t) for t, _ in tokens]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: the neighbours that make the token of lowest rank merge, the first ones on ties."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        ends = list(range(1, n + 1))  # end of the part that begins here, 0 if none does
        befores = list(range(-1, n - 1))
        get = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, upto = heapq.heappop(heap)
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != upto:
                continue  # one of the two has merged meanwhile
            ends[i], ends[middle] = upto, 0
            if upto < n:
                befores[upto] = i
                if (r := get(piece[i:ends[upto]])) is not None:
                    heapq.heappush(heap, (r, i, ends[upto]))
            if (b := befores[i]) >= 0 and (r := get(piece[b:upto])) is not None:
                heapq.heappush(heap, (r, b, upto))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i:ends[i]]])
            i = ends[i]
        return out

    def tokens(self, piece: bytes) -> bytes:
        """Ids of a piece as little-endian numbers of four bytes."""
        found = self.remembered.get(piece)
        if found is None:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            found = np.array(self.merge(piece), "<u4").tobytes()
            if len(piece) <= 64:
                self.remembered[piece] = found
        return found


@lru_cache(maxsize=4)
def _vocabulary(file: bytes) -> Vocabulary:
    return Vocabulary(file)


def _utf8_sizes(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


def _encode_group(vocabulary: Vocabulary, texts: list[bytes]) -> list[bytes]:
    """Ids of each text. The texts are joined by a border, a byte that is cut off again."""
    joined = b"\x00".join(texts)
    points = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), np.uint32)
    upto = np.cumsum(_utf8_sizes(points))
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1  # where each text ends, and the border behind it begins
    border = np.zeros(len(points), bool)
    border[np.searchsorted(upto, ends[:-1] + 1)] = True
    starts = piece_starts(points, border)
    cuts = np.append((upto - _utf8_sizes(points))[starts], len(joined))
    first = np.searchsorted(cuts, ends - sizes)
    last = np.searchsorted(cuts, ends)
    cuts = cuts.tolist()
    pieces = [joined[a:b] for a, b in zip(cuts, cuts[1:])]
    ids = list(map(vocabulary.remembered.get, pieces))
    for k in [k for k, found in enumerate(ids) if found is None]:
        ids[k] = vocabulary.tokens(pieces[k])
    return [b"".join(ids[a:b]) for a, b in zip(first.tolist(), last.tolist())]


def _parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows of up to ``most`` bytes; a larger row stands alone."""
    first, total = 0, 0
    for k, size in enumerate(sizes):
        if k > first and total + size > most:
            yield first, k
            first, total = k, 0
        total += size
    if sizes:
        yield first, len(sizes)


def _packed(parts: list[bytes | None]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _encode(vocabulary: Vocabulary, texts: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """``ids`` and ``ends`` of some texts."""
    ids = _encode_group(vocabulary, texts)
    ends = [np.cumsum(vocabulary.sizes[np.frombuffer(x, "<u4")]).astype("<u4").tobytes() for x in ids]
    return _packed(ids), _packed(ends)


def _decode(vocabulary: Vocabulary, ids: bytes, ends: bytes) -> bytes:
    """Every token's bytes at its place."""
    token = np.frombuffer(ids, "<u4").astype(np.int64)
    upto = np.frombuffer(ends, "<u4").astype(np.int64)
    size = np.diff(upto, prepend=0)
    if len(token) != len(upto) or (size != vocabulary.sizes[token]).any():
        raise ValueError("offsets do not fit the tokens")
    source = np.repeat(vocabulary.starts[token] - upto + size, size) + np.arange(int(size.sum()))
    return vocabulary.blob[source].tobytes()


def _rows(kind: str, docs: DataFrame) -> str:
    """The schema of ``row`` and further columns."""
    return f"row {docs.schema['row'].dataType.simpleString()}, {kind}"


class Tokenizer:
    """A vocabulary file, read once by the driver and sent to each executor once (it does not grow with the data)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, "rb") as file:
            self.file = spark.sparkContext.broadcast(file.read())

    def encode(self, docs: DataFrame, columns: list[str], text_col: str = "text", decoded: bool = False) -> DataFrame:
        """``columns`` of each document in ``row``, ``ids`` of its tokens, and ``ends``: where each ends in its UTF-8 bytes.

        With ``decoded``, also the bytes that decoding them gives, in the same pass.

        Both are packed little-endian numbers of four bytes. A null or empty text has no tokens; special tokens
        are ordinary text. Every row is on its own, so repeated rows get equal results, and an empty table none.
        Results leave a task in small batches, whatever the batches it gets.
        """
        file = self.file

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = _vocabulary(file.value)
            for batch in batches:
                texts = batch.column("text").cast(pa.binary())
                for a, b in _parts(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BATCH_BYTES):
                    found = list(_encode(vocabulary, [t or b"" for t in texts.slice(a, b - a).to_pylist()]))
                    if decoded:
                        found.append(_packed([_decode(vocabulary, *x) for x in zip(*[c.to_pylist() for c in found])]))
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), *found], names)

        names = ["row", "ids", "ends"] + ["decoded"] * decoded
        rows = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.col(text_col).alias("text"))
        return rows.mapInArrow(each, _rows(", ".join(f"{n} binary" for n in names[1:]), rows))

    def decode(self, tokens: DataFrame) -> DataFrame:
        """``row``, ``ids`` and the bytes ``decoded`` that ``encode`` gave ``ids`` and ``ends`` for; null where either is null."""
        file = self.file

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = _vocabulary(file.value)
            for batch in batches:
                sizes = pc.fill_null(pc.binary_length(batch.column("ids")), 0).to_pylist()
                for a, b in _parts(sizes, BATCH_BYTES):
                    part = batch.slice(a, b - a)
                    decoded = [None if x is None or y is None else _decode(vocabulary, x, y)
                               for x, y in zip(part.column("ids").to_pylist(), part.column("ends").to_pylist())]
                    yield pa.RecordBatch.from_arrays([part.column("row"), part.column("ids"), _packed(decoded)], ["row", "ids", "decoded"])

        rows = tokens.select("row", "ids", "ends")
        return rows.mapInArrow(each, _rows("ids binary, decoded binary", rows))
