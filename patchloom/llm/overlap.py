"""Problem 1: the same or nearly the same record on both sides of a split.

Evaluation chunks are summed up in a table of fixed size that counts, by the
hash of each run of four tokens, in how many of them it stands. Training
chunks are scanned against it: a chunk of which fewer than 0.7 of the runs hit
cannot be near-same to any evaluation chunk. Of the other chunks, and of all
evaluation chunks, the rarest runs are joined by hash: two sets of which 0.7 is
common must share one of the first n - ceil(0.7 n) + 1 in any order that is the
same for both, so nothing is lost whatever the counts say. Of a training chunk
only runs that are among the rarest of an evaluation chunk are listed, by a bit
table of those, and of an evaluation chunk only runs so listed. Two sets that
share c of their rarest runs, the last of them at places i and j, have at most c
and what follows in the shorter rest in common; pairs for which that is too
little are dropped. Candidate pairs are then counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import records
from .near import SHINGLE, THRESHOLD, near_same
from .stages import keep, light

#: Buckets of the table of evaluation runs (one byte each), and the parts it is merged in.
BUCKETS, PARTS = 1 << 25, 64
#: Bits of the table of one side's rarest runs; a fuller one only lets more runs through.
BITS = 1 << 28
#: Bits for each chunk, as long as the table is smaller than that.
CHUNK_BITS = 128
TRAIN, EVAL = 0, 1
#: Contents that a task remembers so as not to list their runs again; one listed twice changes nothing.
SEEN = 1 << 20


def run_counts(chunks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """By bucket, in how many texts a run of four tokens stands, at most 255. Its size is fixed; a fuller table only filters less."""
    width = buckets // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(buckets, np.uint8)
        for _, codes, starts in K.slices(batches, "text"):
            at, n = np.unique(K.shingles(codes, starts, SHINGLE)[0] & np.uint64(buckets - 1), return_counts=True)
            table[at] = np.minimum(table[at].astype(np.int64) + n, 255)
        for k in range(PARTS):
            if (part := table[k * width : (k + 1) * width]).any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["part", "counts"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(x, np.uint8)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "counts": [np.minimum(total, 255).astype(np.uint8).tobytes()]})

    table = np.zeros(buckets, np.uint8)
    counted = chunks.select("text").mapInArrow(count, "part int, counts binary")
    for row in counted.groupBy("part").applyInPandas(merge, "part int, counts binary").toLocalIterator():
        table[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["counts"], np.uint8)
    return table


def run_bits(runs: DataFrame, bits: int = BITS) -> np.ndarray:
    """A table of bits, eight a byte, of which the hash of each run in the column gram has one; rows without a run have none."""
    width = bits // PARTS

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(width, bool)
        part[pdf["at"].to_numpy() & (width - 1)] = True
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "bits": [np.packbits(part, bitorder="little").tobytes()]})

    table = np.zeros(bits // 8, np.uint8)
    parts = runs.where("gram is not null").select(F.col("gram").bitwiseAND(bits - 1).cast("int").alias("at")).withColumn("part", F.shiftright("at", width.bit_length() - 1))
    for row in parts.groupBy("part").applyInPandas(mark, "part int, bits binary").toLocalIterator():
        table[row["part"] * width // 8 : (row["part"] + 1) * width // 8] = np.frombuffer(row["bits"], np.uint8)
    return table


def rare_runs(chunks: DataFrame, table: Broadcast, threshold: float = THRESHOLD, bits: np.ndarray | None = None) -> DataFrame:
    """Rows of two kinds: the content of each chunk (gram null), and the rare runs of each content by which it can be found, with their places in the order from the rarest on; with bits only runs that have one."""
    filled = chunks.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, marks, seen = table.value, filled.value, set()
        for part, codes, starts in K.slices(batches, "text"):
            grams, at = K.shingles(codes, starts, SHINGLE)
            content, n = K.set_hash(grams, at), np.diff(at)
            if len(seen) > SEEN:
                seen.clear()
            side = part.column("side").to_numpy()
            first = np.array([n[i] > 0 and not ((key := (content[i], side[i])) in seen or seen.add(key)) for i in range(n.size)], bool)
            df = counts[(grams & np.uint64(counts.size - 1)).astype(np.int64)]
            doc = np.repeat(np.arange(n.size), n)
            hits = np.bincount(doc, df > 0, n.size)
            reach = first & (hits >= np.ceil(threshold * n - 1e-9))
            pick = reach[doc]
            g, d, c = grams[pick], doc[pick], df[pick]
            order = np.lexsort((g, c, d))
            g, d, c = g[order], d[order], c[order]
            begin = np.zeros(n.size, np.int64)
            begin[reach] = np.cumsum(n[reach]) - n[reach]
            rank = np.arange(g.size) - begin[d]
            use = (rank <= n[d] - np.ceil(threshold * n[d] - 1e-9)) & (c > 0)
            if marks is not None:
                bit = g & np.uint64(marks.size * 8 - 1)
                use &= (marks[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1) > 0
            g, d, rank = g[use], d[use], rank[use]
            yield _batch(content, n, side, np.arange(n.size), None, None, part.column("chunk_id"), part.column("repo_key"))
            if g.size:
                yield _batch(content, n, side, d, g, rank, None, None)

    schema = "gram long, place int, content long, n int, side byte, chunk_id string, repo_key string"
    return chunks.select("chunk_id", "repo_key", "text", "side").mapInArrow(scan, schema)


def _batch(content, n, side, rows, grams, places, chunk_id, repo_key) -> pa.RecordBatch:
    size = len(rows)
    arrays = [
        pa.nulls(size, pa.int64()) if grams is None else pa.array(grams.view(np.int64)),
        pa.nulls(size, pa.int32()) if places is None else pa.array(places, pa.int32()),
        pa.array(content[rows]), pa.array(n[rows], pa.int32()), pa.array(side[rows], pa.int8()),
        pa.nulls(size, pa.string()) if chunk_id is None else chunk_id,
        pa.nulls(size, pa.string()) if repo_key is None else repo_key,
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["gram", "place", "content", "n", "side", "chunk_id", "repo_key"])


def near_chunk_pairs(cases: DataFrame, chunks: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Near-same pairs of contents (a of an evaluation chunk, b of a training chunk; both, n_a, n_b), and members: which chunk and case has which content on which side."""
    sides = keep(cases.where("split is not null").select(F.col("case_id").alias("repo_key"), F.when(F.col("split") == "train", TRAIN).otherwise(EVAL).cast("byte").alias("side")))
    placed = chunks.where("length(text) > 0 and chunk_id is not null").select("chunk_id", "repo_key", "text").join(light(sides), "repo_key")
    evaluation, training = placed.where(F.col("side") == EVAL), placed.where(F.col("side") == TRAIN)
    table = chunks.sparkSession.sparkContext.broadcast(run_counts(evaluation, buckets))
    bits = min(BITS, 1 << max(20, (CHUNK_BITS * placed.count()).bit_length()))
    theirs = keep(rare_runs(training, table, threshold, run_bits(rare_runs(evaluation, table, threshold), bits)))
    ours = keep(rare_runs(evaluation, table, threshold, run_bits(theirs, bits)))
    members = ours.union(theirs).where("gram is null and n > 0").select("chunk_id", "repo_key", "content", "side").distinct()
    return near_same(chunks, members, candidates(ours, theirs, threshold), threshold), members


def candidates(ours: DataFrame, theirs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b of the contents that can be near-same by their sizes, their common rare runs and the places of these."""
    a, b = (df.where("gram is not null").select("gram", F.col("content").alias(c), F.col("n").alias(f"n_{c}"), F.col("place").alias(f"at_{c}")).repartition("gram").distinct() for df, c in ((ours, "a"), (theirs, "b")))
    sized = (F.col("n_a") >= F.lit(threshold) * F.col("n_b") - 1e-9) & (F.col("n_b") >= F.lit(threshold) * F.col("n_a") - 1e-9)
    shared = a.join(b, "gram").where(sized).groupBy("a", "b").agg(F.count("*").alias("c"), F.max("at_a").alias("i"), F.max("at_b").alias("j"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    most = F.col("c") + F.least(F.col("n_a") - F.col("i"), F.col("n_b") - F.col("j")) - 1
    return shared.where(most >= F.lit(threshold) * (F.col("n_a") + F.col("n_b") - most) - 1e-9).select("a", "b")


def overlaps(all_cases: DataFrame, code_chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each pair of an evaluation and a training case with what they share.

    Columns: eval_case, eval_split, eval_group, train_case, same_file, chunk_pairs
    (near-same pairs of distinct contents), containment (the largest part of an
    evaluation chunk's runs that one training chunk holds; null without such a pair).
    Null, empty and blank texts, texts under four tokens, cases without a split and
    chunks of unknown cases share nothing; repeated rows count once.
    """
    cases = keep(records.cases(all_cases))
    near, members = near_chunk_pairs(cases, code_chunks, threshold)
    ours = members.where(F.col("side") == EVAL).select(F.col("content").alias("a"), F.col("repo_key").alias("eval_case")).distinct()
    theirs = members.where(F.col("side") == TRAIN).select(F.col("content").alias("b"), F.col("repo_key").alias("train_case")).distinct()
    by_text = near.join(ours, "a").join(theirs, "b").groupBy("eval_case", "train_case").agg(F.count("*").alias("chunk_pairs"), F.max(F.col("both") / F.col("n_a")).alias("containment"))
    train = cases.where("split = 'train' and path is not null").select(F.col("case_id").alias("train_case"), "path")
    by_file = cases.where("split <> 'train' and path is not null").select(F.col("case_id").alias("eval_case"), "path").join(train, "path").select("eval_case", "train_case", F.lit(True).alias("same_file"))
    of = cases.select(F.col("case_id").alias("eval_case"), F.col("split").alias("eval_split"), F.col("grp").alias("eval_group"))
    return (
        by_text.join(by_file, ["eval_case", "train_case"], "full")
        .join(of, "eval_case")
        .select("eval_case", "eval_split", "eval_group", "train_case", F.coalesce("same_file", F.lit(False)).alias("same_file"), F.coalesce("chunk_pairs", F.lit(0)).alias("chunk_pairs"), "containment")
    )
