"""Problem 2: groups of near-duplicate records, over all records.

Each distinct run of tokens starts a Poisson process whose rate is its weight;
its arrivals fall on the registers of the signature at random, and each
register keeps the earliest. Two texts agree in a register with the
probability Jaccard similarity of their weighted runs, which for weight 1 is
the share of common among all distinct runs. Arrivals later than the time by
which every register is filled can't matter, so they are never drawn. Registers
are banded, texts that agree in a band are candidates, and candidates are
counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .near import SHINGLE, THRESHOLD, near_same
from .splits import components
from .stages import keep, light

#: 32 bands of 4 registers: a pair at similarity 0.7 stays apart in all bands with probability 0.00015, one at 0.1 meets in any with 0.003.
BANDS, ROWS = 32, 4
#: Contents that a task remembers so as not to sign them again; one signed twice changes nothing.
SEEN = 1 << 20


def signatures(grams: np.ndarray, bounds: np.ndarray, registers: int, weights: np.ndarray | None = None) -> np.ndarray:
    """The run that came first in each register, by text; texts without runs have zeros."""
    n = np.diff(bounds)
    out = np.zeros((n.size, registers), np.uint64)
    todo, patience = np.flatnonzero(n > 0), np.log(registers) + 3.0
    while todo.size:
        size = n[todo]
        doc = np.repeat(np.arange(todo.size), size)
        pick = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[:-1][todo], size)
        g = grams[pick]
        w = np.ones(g.size) if weights is None else weights[pick]
        until = patience * registers / np.bincount(doc, w, todo.size)
        key, when, run = _arrivals(g, doc, w, until, registers)
        first = np.full(todo.size * registers, np.inf)
        np.minimum.at(first, key, when)
        won = when == first[key]
        ids = np.zeros(first.size, np.uint64)
        ids[key[won]] = run[won]
        full = np.isfinite(first).reshape(todo.size, registers).all(1)
        out[todo[full]] = ids.reshape(todo.size, registers)[full]
        todo, patience = todo[~full], patience * 2
    return out


def _arrivals(g, doc, w, until, registers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Register (by text), time and run of each arrival before its text's end of patience."""
    keys, times, runs = [], [], []
    t, step = np.zeros(g.size), 0
    while g.size:
        step = (step + 0x9E3779B97F4A7C15) % (1 << 64)
        x = K.mix(g + np.uint64(step))
        t = t - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        early = t <= until[doc]
        g, doc, w, t, x = g[early], doc[early], w[early], t[early], x[early]
        place = ((K.mix(x) >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
        keys.append(doc * registers + place.astype(np.int64))
        times.append(t)
        runs.append(g)
    return np.concatenate(keys), np.concatenate(times), np.concatenate(runs)


def banded(chunks: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Rows of two kinds: the content of each chunk (band null), and the bands of each content."""
    salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, codes, starts in K.slices(batches, "text"):
            grams, at = K.shingles(codes, starts, SHINGLE)
            content, n = K.set_hash(grams, at), np.diff(at)
            yield _batch(None, content, part.column("chunk_id"), part.column("repo_key"))
            if len(seen) > SEEN:
                seen.clear()
            new = np.array([n[i] > 0 and not (content[i] in seen or seen.add(content[i])) for i in range(n.size)], bool)
            if not new.any():
                continue
            own, runs = content[new], n[new]
            bounds = np.concatenate([[0], np.cumsum(runs)])
            sig = signatures(grams[np.repeat(new, n)], bounds, bands * rows).reshape(own.size, bands, rows)
            h = np.broadcast_to(salt, (own.size, bands))
            for k in range(rows):
                h = K.mix(h ^ (sig[:, :, k] * np.uint64(0x9E3779B97F4A7C15)))
            yield _batch(h.ravel().view(np.int64), np.repeat(own, bands), None, None)

    return chunks.where("length(text) > 0 and chunk_id is not null").select("chunk_id", "repo_key", "text").mapInArrow(sign, "band long, content long, chunk_id string, repo_key string")


def _batch(band, content, chunk_id, repo_key) -> pa.RecordBatch:
    arrays = [
        pa.nulls(content.size, pa.int64()) if band is None else pa.array(band),
        pa.array(content),
        pa.nulls(content.size, pa.string()) if chunk_id is None else chunk_id,
        pa.nulls(content.size, pa.string()) if repo_key is None else repo_key,
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["band", "content", "chunk_id", "repo_key"])


def near_copies(code_chunks: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Near-same pairs of distinct contents (a < b, both, n_a, n_b), and members: which chunk has which content.

    Null, empty and blank texts and texts under four tokens have no content and no
    pair; chunks with the same set of runs share one content, so copies are never
    paired with each other here; repeated rows count once; rows without chunk_id
    are left out.
    """
    found = keep(banded(code_chunks))
    members = found.where("band is null and content <> 0").select("chunk_id", "repo_key", "content").distinct()
    band = found.where("band is not null").select("band", "content")
    pairs = band.withColumnRenamed("content", "a").join(band.withColumnRenamed("content", "b"), "band").where("a < b").select("a", "b").distinct()
    return near_same(code_chunks, members, pairs, threshold), members


def chunk_groups(near: DataFrame, members: DataFrame) -> DataFrame:
    """chunk_id, repo_key, class_id, class_size, cases, group_id, links: one row per chunk that has a content, copies without a near-same text too.

    The class is the content; class_size its rows, cases its cases (null is one).
    links are the near-same classes, so far as the two hold different cases; the
    group is the component of these links, its own class where there is none.
    """
    sizes = members.groupBy("content", "repo_key").agg(F.count("*").alias("n")).groupBy("content")
    sizes = keep(sizes.agg(F.sum("n").alias("class_size"), F.count("*").alias("cases"), F.min("repo_key").alias("least")))
    of = lambda c: sizes.select(F.col("content").alias(c), F.col("cases").alias(f"cases_{c}"), F.col("least").alias(f"least_{c}"))
    one = (F.col("cases_a") == 1) & (F.col("cases_b") == 1) & F.col("least_a").eqNullSafe(F.col("least_b"))
    across = keep(near.select("a", "b").join(of("a"), "a").join(of("b"), "b").where(~one).select("a", "b"))
    links = across.select("a").union(across.select("b")).groupBy(F.col("a").alias("content")).agg(F.count("*").alias("links"))
    found = links.join(components(across).withColumnRenamed("node", "content"), "content")
    classes = keep(sizes.drop("least").join(found, "content", "left"))
    rows = members.join(light(classes), "content")
    return rows.select("chunk_id", "repo_key", F.col("content").alias("class_id"), "class_size", "cases", F.coalesce("root", "content").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def chunk_pairs(near: DataFrame, members: DataFrame) -> DataFrame:
    """chunk_a < chunk_b of different cases: members of near-same contents, and members of one content."""
    left = members.select(F.col("chunk_id").alias("x"), F.col("repo_key").alias("rx"), F.col("content").alias("a"))
    right = members.select(F.col("chunk_id").alias("y"), F.col("repo_key").alias("ry"), F.col("content").alias("b"))
    across = near.select("a", "b").join(left, "a").join(right, "b")
    copies = left.join(right, F.col("a") == F.col("b")).where("x < y").select("a", "b", "x", "rx", "y", "ry")
    both = across.select("x", "rx", "y", "ry").union(copies.select("x", "rx", "y", "ry")).where("not (rx <=> ry)")
    return both.select(F.least("x", "y").alias("chunk_a"), F.greatest("x", "y").alias("chunk_b")).distinct()
