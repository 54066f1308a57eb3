"""Exact checks of candidate pairs of texts, shared by the overlap and near-copy operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .stages import keep, light

#: Near-same: runs of four tokens, at least 0.7 of all runs in common.
SHINGLE, THRESHOLD = 4, 0.7


def texts_of(chunks: DataFrame, members: DataFrame, contents: DataFrame) -> DataFrame:
    """content, text: the text of one chunk of each content asked for."""
    one = keep(members.join(contents, "content", "left_semi").groupBy("content").agg(F.min("chunk_id").alias("chunk_id")))
    return chunks.select("chunk_id", "text").join(light(one), "chunk_id").groupBy("content").agg(F.first("text").alias("text"))


def common(n: int):
    """A task that adds to rows with text_a and text_b the numbers of distinct runs in common and in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, codes, starts in K.slices(iter([batch]), "text_a"):
                _, codes_b, starts_b = next(_whole(part, "text_b"))
                a, at = K.shingles(codes, starts, n)
                b, bt = K.shingles(codes_b, starts_b, n)
                both = [np.intersect1d(a[at[i] : at[i + 1]], b[bt[i] : bt[i + 1]], assume_unique=True).size for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), pa.array(both, pa.int32()), pa.array(np.diff(at), pa.int32()), pa.array(np.diff(bt), pa.int32())],
                    names=["a", "b", "both", "n_a", "n_b"],
                )

    return run


def _whole(part: pa.RecordBatch, text: str):
    column = part.column(part.schema.get_field_index(text))
    yield part, *K.codepoints(column)


def near_same(chunks: DataFrame, members: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, both, n_a, n_b of those candidate pairs of contents whose texts are near-same, by an exact count on whole texts."""
    pairs = keep(pairs)
    wanted = pairs.select(F.col("a").alias("content")).union(pairs.select("b")).distinct()
    texts = keep(texts_of(chunks, members, wanted))
    joined = pairs.join(texts.select(F.col("content").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("content").alias("b"), F.col("text").alias("text_b")), "b")
    counted = joined.mapInArrow(common(SHINGLE), "a long, b long, both int, n_a int, n_b int")
    return counted.where(F.col("both") >= F.lit(threshold) * (F.col("n_a") + F.col("n_b") - F.col("both")) - 1e-9)
