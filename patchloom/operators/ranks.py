"""Exact ranks over whole tables without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, bucket: Column, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """df plus rank (from 1) in the given order within each group of `by`, and total, the group's rows.

    `bucket` must rise with the order: rows are sorted within buckets, and counts
    of buckets, of which there are few, give each bucket's offset.
    """
    by = by or []
    with_bucket = df.withColumn("_bucket", bucket)
    sizes = with_bucket.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    before = F.sum("_n").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("total"))
    place = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = with_bucket.withColumn("_place", place).join(offsets, same)
    return joined.select(*df.columns, (F.col("_before") + F.col("_place")).alias("rank"), "total")


def by_hash(df: DataFrame, key: str) -> DataFrame:
    """df plus rank by the MD5 of the key, and total: an order that does not depend on how rows arrive."""
    h = F.md5(F.col(key).cast("string"))
    return ranked(df, F.left(h, F.lit(3)), [h, F.col(key)])


def ratio_split(df: DataFrame, key: str, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """df plus split by position in hash order; sizes are rounded half to even, the rest is test."""
    n_train, n_val = F.bround(F.col("total") * train), F.bround(F.col("total") * validation)
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    return by_hash(df, key).withColumn("split", split)


def percent_subset(df: DataFrame, key: str, percent: int) -> DataFrame:
    """The first percent of df in hash order, at least one row."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    return by_hash(df, key).where(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("total") * percent / 100)))
