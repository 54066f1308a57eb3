"""Orders by chance of whole tables, drawn and sorted inside tasks.

A task holds all pairs and runs through a share of the iterations, so the
draws, of which there are pairs times iterations, are neither written nor
shuffled. Draws are those of statistics.hash_draws: an MD5 of seed, block and key serves
four iterations by its four words. It is calculated here for all keys at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys whose digests are calculated at a time: their words stay in a core's cache.
AT_ONCE = 16384
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_LOW = (1 << 32) - 1


def _round(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, out: np.ndarray) -> None:
    if i < 32:
        x, y, z = (b, c, d) if i < 16 else (d, b, c)
        np.bitwise_xor(y, z, out=out)
        np.bitwise_and(out, x, out=out)
        np.bitwise_xor(out, z, out=out)
    elif i < 48:
        np.bitwise_xor(b, c, out=out)
        np.bitwise_xor(out, d, out=out)
    else:
        np.invert(d, out=out)
        np.bitwise_or(out, b, out=out)
        np.bitwise_xor(out, c, out=out)


def _digest(words: list[int | np.ndarray], size: int) -> list[np.ndarray]:
    """The four words of the MD5 of padded messages, given word by word; a word that all messages share is a number."""
    state = [np.full(size, x, np.uint32) for x in _START]
    high = np.empty(size, np.uint32)
    for at in range(0, len(words), 16):
        a, b, c, d = (x.copy() for x in state)
        f = np.empty(size, np.uint32)
        for i in range(64):
            _round(i, b, c, d, f)
            np.add(f, a, out=f)
            w = words[at + _WORDS[i]]
            if isinstance(w, int):
                np.add(f, np.uint32((w + _SINES[i]) & _LOW), out=f)
            else:
                np.add(f, np.uint32(_SINES[i]), out=f)
                np.add(f, w, out=f)
            np.right_shift(f, np.uint32(32 - _TURNS[i]), out=high)
            np.left_shift(f, np.uint32(_TURNS[i]), out=f)
            np.bitwise_or(f, high, out=f)
            np.add(f, b, out=f)
            a, b, c, d, f = d, f, b, c, a
        state = [x + y for x, y in zip(state, (a, b, c, d), strict=True)]
    return state


def _padded(data: np.ndarray, at: np.ndarray, rows: np.ndarray, prefix: int, blocks: int) -> list[int | np.ndarray]:
    """The words of the padded messages of some keys, with room of so many bytes before each."""
    n = at[rows + 1] - at[rows]
    room = np.zeros((rows.size, 64 * blocks), np.uint8)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(np.arange(rows.size), n)
    room[row, prefix + within] = data[np.repeat(at[rows], n) + within]
    room[np.arange(rows.size), prefix + n] = 0x80
    room[:, -8:] = ((prefix + n) * 8).astype("<u8").view(np.uint8).reshape(-1, 8)
    words = np.ascontiguousarray(room.view("<u4").T)
    return [w.copy() if (w != w[0]).any() else int(w[0]) for w in words]


class Digests:
    """The MD5 of a prefix and each key, for one prefix after the other."""

    def __init__(self, keys: pa.Array) -> None:
        keys = keys.cast(pa.large_binary())
        _, at, data = keys.buffers()
        self.at = np.frombuffer(at, np.int64)[keys.offset : keys.offset + len(keys) + 1]
        self.data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
        self.prefix, self.parts = -1, []

    def of(self, prefix: bytes) -> np.ndarray:
        """Four rows of a number a key: its digest's groups of eight hexadecimal digits."""
        if len(prefix) != self.prefix:
            self.prefix, self.parts = len(prefix), []
            blocks = (self.prefix + np.diff(self.at) + 8) // 64 + 1
            for b in np.unique(blocks):
                of = np.flatnonzero(blocks == b)
                for i in range(0, of.size, AT_ONCE):
                    rows = of[i : i + AT_ONCE]
                    self.parts.append((rows, _padded(self.data, self.at, rows, self.prefix, int(b))))
        first = np.frombuffer(prefix + bytes(-len(prefix) % 4), "<u4").tolist()
        out = np.empty((4, self.at.size - 1), np.uint32)
        for rows, words in self.parts:
            own = [int(x | w) if isinstance(w, int) else w | np.uint32(x) for x, w in zip(first, words, strict=False)]
            for k, word in enumerate(_digest(own + words[len(own) :], rows.size)):
                out[k, rows] = word.byteswap()
        return out


def _orders(keys: pa.Array, blocks: range, iterations: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each iteration of some blocks, and the places of the keys, which are sorted, in the order of their draws."""
    digests, place = Digests(keys), np.arange(len(keys), dtype=np.uint64)
    for block in blocks:
        for part, h in enumerate(digests.of(f"{seed}-{block}-".encode())):
            if (it := block * 4 + part + 1) <= iterations:
                both = h.astype(np.uint64) << np.uint64(32)
                both |= place
                both.sort()
                yield it, (both & np.uint64(_LOW)).astype(np.intp)


def over_orders(pairs: DataFrame, key: str, values: dict[str, Column], run: Callable, schema: str, iterations: int, seed: int) -> DataFrame:
    """What run(table, orders) yields in each of some tasks: a table of all pairs with `values`, sorted by key, and the orders of the task's iterations.

    Each task reads all pairs, so the pairs are moved once a task whatever the number of iterations. Rows without a key have no draw.
    """
    blocks = (iterations - 1) // 4 + 1
    tasks = min(blocks, 4 * max(4, pairs.sparkSession.sparkContext.defaultParallelism))
    chosen = pairs.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_key"), *(c.alias(n) for n, c in values.items()))
    dealt = chosen.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, F.col("_task"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            task = table.column("_task")[0].as_py()
            keys = table.column("_key").combine_chunks().cast(pa.large_binary())
            order = pc.sort_indices(keys)
            yield from run(table.drop_columns(["_key", "_task"]).take(order), _orders(keys.take(order), range(task, blocks, tasks), iterations, seed))

    return dealt.mapInArrow(each, schema)
