"""Numpy kernels over Arrow string columns, run inside Spark's Arrow tasks.

A kernel sees one slice of a batch (a few million characters) as one array of
code points plus the start of each text, so that a step costs a handful of
array passes for the whole slice and no Python per token. Nulls are empty texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_CHARS = 1 << 20
SLICE_TEXTS = 1 << 11
#: Bits of a shingle's hash; the rest of a 64-bit word names the text within its slice.
GRAM_BITS = 52
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches of bounded size, each with its code points and the starts of its texts."""
    for batch in batches:
        column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
        size = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(size, size[at] + SLICE_CHARS, "right")) - 1
            to = min(max(to, at + 1), at + SLICE_TEXTS, batch.num_rows)
            yield batch.slice(at, to - at), *codepoints(column.slice(at, to - at))
            at = to


def codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and where each starts (one entry more than texts)."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    offsets -= offsets[0]
    if not raw.size or raw.max() < 128:
        return raw, offsets
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), lead[offsets]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it part of a word, is it blank, and the hash of its lower case."""
    chars = [chr(i) for i in range(0x110000)]
    word = np.fromiter((c.isalnum() or c == "_" for c in chars), bool, len(chars))
    blank = np.fromiter((c.isspace() for c in chars), bool, len(chars))
    lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(chars)), np.uint64, len(chars))
    return word, blank, mix((lower + np.uint64(1)) * _MULT)


@lru_cache(maxsize=1)
def categories() -> np.ndarray:
    """By code point: 1 letter, 2 number, 3 white space, 0 anything else."""
    names = (unicodedata.category(chr(i))[0] for i in range(0x110000))
    kind = np.fromiter(({"L": 1, "N": 2}.get(n, 0) for n in names), np.uint8, 0x110000)
    kind[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return kind


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(8, (n - 1).bit_length()))[:n]


def tokens(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each token: a longest run of letters, digits and underscores, or one other non-blank character, in lower case."""
    word, blank, value = _tables()
    w, b = word[codes], blank[codes]
    begins = ~b
    begins[1:] &= ~(w[1:] & w[:-1])
    first = starts[:-1][starts[:-1] < starts[1:]]
    begins[first] |= ~b[first]
    at = np.flatnonzero(begins)
    if not at.size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    within = np.arange(codes.size) - at[np.maximum(np.cumsum(begins) - 1, 0)]
    v = value[codes]
    v[b] = 0
    v[: at[0]] = 0
    within[b] = 0
    within[: at[0]] = 0
    v *= powers(0x2545F4914F6CDD1D, int(within.max()) + 1)[within]
    return mix(np.add.reduceat(v, at)), np.searchsorted(starts, at, "right") - 1


def shingles(codes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of n consecutive tokens: their hashes sorted within each text, and the texts' bounds in them."""
    t, doc = tokens(codes, starts)
    if t.size < n:
        return np.empty(0, np.uint64), np.zeros(starts.size, np.int64)
    h = np.zeros(t.size - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ t[k : t.size - n + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
    own = doc[: h.size] == doc[n - 1 :]
    low = np.uint64((1 << GRAM_BITS) - 1)
    keys = np.sort((mix(h[own]) & low) | (doc[: h.size][own].astype(np.uint64) << np.uint64(GRAM_BITS)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if keys.size else keys
    bounds = np.searchsorted(keys, np.arange(starts.size, dtype=np.uint64) << np.uint64(GRAM_BITS))
    return keys & low, bounds


def set_hash(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each text's set of shingles; 0 for an empty set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams * _MULT + np.uint64(7)))])
    out = mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
    out[bounds[1:] == bounds[:-1]] = 0
    return out.view(np.int64)


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of `width` code points, by its first; windows may run over text ends."""
    if codes.size < width:
        return np.empty(0, np.uint64)
    base = 0x2545F4914F6CDD1D
    value = mix((codes.astype(np.uint64) + np.uint64(1)) * _MULT)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * powers(base, codes.size))])
    inverse = powers(pow(base, -1, 1 << 64), codes.size - width + 1)
    return mix((sums[width:] - sums[:-width]) * inverse)


def winnow(codes: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and position of chosen windows of half the span: any two texts sharing `span` characters share a chosen window at the same place in the stretch.

    Of the windows inside each stretch of `span` characters the one with the
    least hash is chosen, the leftmost of equals.
    """
    width = span // 2
    h = rolling(codes, width)
    look = span - width + 1
    if h.size < look:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    bits = max(1, int(h.size).bit_length())
    least = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(h.size, dtype=np.uint64)
    have = 1
    while have * 2 <= look:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < look:
        least = np.minimum(least[: least.size - (look - have)], least[look - have :])
    doc = np.repeat(np.arange(starts.size - 1), np.diff(starts))
    inside = doc[: least.size] == doc[span - 1 :]
    chosen = np.zeros(h.size, bool)
    chosen[(least[inside] & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    return h[at], doc[at], at - starts[doc[at]]
