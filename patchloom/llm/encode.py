"""Problem 6: the whole corpus as token ids of a public byte-level vocabulary.

The split of a text into words, which such vocabularies define by an expression,
is found without one: a table gives each code point its class, class and
neighbours give a symbol, and each symbol is a function from state to state of a
small automaton. Functions compose associatively, so the states before each
character come from a scan in blocks (all blocks side by side), and a second table
says at which characters a word starts. Equal words are merged once, by a cache.
"""

from __future__ import annotations

import base64
import heapq
import importlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The cache holds so many words of at most so many characters.
CACHE_WORDS, CACHE_CHARS = 1 << 19, 200
_BLOCK = 256

#: Symbols: end of text, letter, number, other, an apostrophe that starts a short form of one or two letters,
#: a space or other blank that ends its run, one that doesn't, and a blank run's last at the end of the text.
END, LETTER, NUMBER, OTHER, SHORT1, SHORT2, SPACE_LAST, BLANK_LAST, BLANK, BLANK_END = range(10)
#: States, named by what came before: nothing that goes on, a run, a space that the next run takes in, a short form with letters to come, a blank run.
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, SHORT_1, SHORT_2, IN_BLANKS = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """State after each symbol in each state, and whether a word starts at it."""
    after = np.zeros((8, 10), np.uint8)
    starts = np.ones((8, 10), bool)
    for symbol, state in ((END, NONE), (LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (SHORT1, SHORT_1), (SHORT2, SHORT_2), (SPACE_LAST, AFTER_SPACE), (BLANK_LAST, NONE), (BLANK, IN_BLANKS), (BLANK_END, NONE)):
        after[:, symbol] = state
    for state, symbol in ((IN_LETTERS, LETTER), (IN_NUMBERS, NUMBER), (IN_OTHER, OTHER), (IN_BLANKS, BLANK), (IN_BLANKS, BLANK_END)):
        starts[state, symbol] = False
    for symbol in (LETTER, NUMBER, OTHER):
        starts[AFTER_SPACE, symbol] = False
    after[AFTER_SPACE, [SHORT1, SHORT2]] = IN_OTHER
    starts[AFTER_SPACE, [SHORT1, SHORT2]] = False
    after[IN_OTHER, [SHORT1, SHORT2]] = IN_OTHER
    starts[IN_OTHER, [SHORT1, SHORT2]] = False
    after[SHORT_2, LETTER], after[SHORT_1, LETTER] = SHORT_1, NONE
    starts[SHORT_2, LETTER] = starts[SHORT_1, LETTER] = False
    return after, starts


def symbols(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each code point, with an end symbol after each text, and the place of each text in them."""
    n, docs = codes.size, starts.size - 1
    place = starts + np.arange(docs + 1)
    at = np.arange(n) + np.repeat(np.arange(docs), np.diff(starts))
    kind = np.full(n + docs, 4, np.uint8)
    kind[at] = K.categories()[codes]
    char = np.zeros(n + docs + 2, np.uint32)
    char[at] = codes
    kinds = np.array([OTHER, LETTER, NUMBER, BLANK, END], np.uint8)
    out = kinds[kind]
    following = np.concatenate([kind[1:], [4]]).astype(np.uint8) if kind.size else kind
    blank = kind == 3
    out[blank & (following != 3)] = BLANK_LAST
    out[blank & (following != 3) & (char[: kind.size] == 32)] = SPACE_LAST
    out[blank & (following == 4)] = BLANK_END
    quote = np.flatnonzero(char[: kind.size] == 39)
    if quote.size:
        x, y = char[quote + 1], char[quote + 2]
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = np.zeros(quote.size, bool)
        for a, b in ("re", "ve", "ll"):
            two |= (x == ord(a)) & (y == ord(b))
        out[quote[one]] = SHORT1
        out[quote[two]] = SHORT2
    return out, place


def word_starts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where words start, as positions in the code points; every text starts a word unless it is empty."""
    symbol, place = symbols(codes, starts)
    after, begins = _automaton()
    blocks = -(-symbol.size // _BLOCK)
    grid = np.zeros(blocks * _BLOCK, np.uint8)
    grid[: symbol.size] = symbol
    grid = np.ascontiguousarray(grid.reshape(blocks, _BLOCK).T)
    flat = after.ravel()
    reach = np.repeat(np.arange(8, dtype=np.uint8)[:, None], blocks, 1)
    for row in grid:  # each block's function of the state before it
        reach = flat[reach * np.uint8(10) + row]
    entry, state = np.zeros(blocks, np.uint8), 0
    for k, f in enumerate(reach.T.tolist()):
        entry[k], state = state, f[state]
    out, now = np.zeros(grid.shape, bool), entry
    firsts = begins.ravel()
    for k, row in enumerate(grid):
        key = now * np.uint8(10) + row
        out[k], now = firsts[key], flat[key]
    at = np.flatnonzero(out.T.ravel()[: symbol.size] & (symbol != END))
    return at - (np.searchsorted(place, at, "right") - 1)


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def default_path(name: str = VOCABULARY) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def merged(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of a word: of the adjacent parts that together are in the vocabulary, the pair of least rank is joined, the leftmost of equals, until none is left.

    Pairs wait in a heap and parts know their neighbours, so that a word of n bytes takes n log n steps.
    """
    if (whole := rank.get(word)) is not None:
        return [whole]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that starts at a place; end 0: the place starts none
    waiting = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, i, to = heapq.heappop(waiting)
        middle = end[i]
        if not middle or middle >= n or end[middle] != to:
            continue  # one of the two parts has been joined with another meanwhile
        end[i], end[middle] = to, 0
        if to < n:
            before[to] = i
            if (r := rank.get(word[i : end[to]])) is not None:
                heapq.heappush(waiting, (r, i, end[to]))
        if (h := before[i]) >= 0 and (r := rank.get(word[h:to])) is not None:
            heapq.heappush(waiting, (r, h, to))
    out, i = [], 0
    while i < n:
        out.append(rank[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Ids of slices of texts, with a bounded cache of merged words by their hash."""

    def __init__(self, path: str):
        self.rank, self.cache = ranks(path), {}

    def __call__(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, where each text's begin, the words' first code points, and the number of ids of each word."""
        at = word_starts(codes, starts)
        if not at.size:
            none = np.empty(0, np.int32)
            return none, np.zeros(starts.size, np.int64), at, none
        ends = np.concatenate([at[1:], [codes.size]])
        value = K.mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        within = np.arange(codes.size) - np.repeat(at, ends - at)
        value *= K.powers(0x2545F4914F6CDD1D, int((ends - at).max()))[within]
        _, first, inverse = np.unique(K.mix(np.add.reduceat(value, at)) ^ (ends - at).astype(np.uint64), return_index=True, return_inverse=True)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        text = codes.tobytes().decode("latin-1") if codes.dtype == np.uint8 else codes.tobytes().decode("utf-32-le")
        parts = []
        for a, b in zip(at[first].tolist(), ends[first].tolist(), strict=True):
            if (ids := self.cache.get(word := text[a:b])) is None:
                ids = merged(word.encode(), self.rank)
                if b - a <= CACHE_CHARS:
                    self.cache[word] = ids
            parts.append(ids)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        pool = np.fromiter((i for p in parts for i in p), np.int32, int(size.sum()))
        begin = np.cumsum(size) - size
        n = size[inverse]
        total = np.cumsum(n)
        ids = pool[np.arange(total[-1]) - np.repeat(total - n, n) + np.repeat(begin[inverse], n)]
        bound = np.concatenate([[0], total])[np.searchsorted(at, starts)]
        return ids, bound, at, n


def encode(df: DataFrame, key: str, text: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """key, ids (array<int>), one row per row of df; with offsets also words and sizes.

    words holds the first character of each word of the pre-tokenisation, sizes how
    many ids it became, so that any id can be led back to its place. Null and empty
    texts give empty lists; blank texts are encoded as they stand; no special tokens.
    """
    path = path or default_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for part, codes, starts in K.slices(batches, "text"):
            ids, bound, at, n = encoder(codes, starts)
            columns = [part.column("key"), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(ids, pa.int32()))]
            if offsets:
                word = pa.array(np.searchsorted(at, starts), pa.int32())
                first = at - starts[np.searchsorted(starts, at, "right") - 1] if at.size else at
                columns += [pa.ListArray.from_arrays(word, pa.array(first, pa.int32())), pa.ListArray.from_arrays(word, pa.array(n, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "words", "sizes"][: len(columns)])

    schema = f"key {kind}, ids array<int>" + ", words array<int>, sizes array<int>" * offsets
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, path: str | None = None) -> DataFrame:
    """key, text of rows with ids; a null list gives a null text."""
    path = path or default_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = {i: b for b, i in ranks(path).items()}
        for batch in batches:
            texts = [None if x is None else b"".join(back[i] for i in x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    return df.select(F.col(key).alias("key"), "ids").mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
