"""Readers of the given tables, and the rule that a record counts once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stages import keep, light


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _newest(df: DataFrame, keys: list[str], order: str, ties: list[str]) -> Column:
    """Place of each row of a key, the latest first, then by `ties`, then by a hash of the whole row, so that no order is left to chance."""
    last = [F.col(c).desc_nulls_last() for c in (order, *ties)]
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*last, F.xxhash64(*df.columns).desc()))


def latest(df: DataFrame, keys: list[str], columns: list[str], order: str = "ingested_at", ties: list[str] | None = None) -> DataFrame:
    """One row per key, the latest by `order` and then by `ties`, with the given columns only. For narrow tables, whose rows are cheap to move."""
    return df.withColumn("_rank", _newest(df, keys, order, ties or [])).where("_rank = 1").select(*dict.fromkeys([*keys, *columns]))


def latest_texts(df: DataFrame, keys: list[str], columns: list[str], order: str = "ingested_at") -> DataFrame:
    """The same for tables with long texts: keys alone are counted, and only rows whose key occurs again are moved; all others stay where they are."""
    again = keep(df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*(F.col(k).alias(f"_{k}") for k in keys)))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    needed = list(dict.fromkeys([*keys, *columns]))
    once = df.join(light(again), same, "left_anti").select(*needed)
    repeated = df.join(light(again), same, "left_semi")
    newest = repeated.withColumn("_rank", _newest(df, keys, order, [])).where("_rank = 1").select(*needed)
    return once.unionByName(newest)


def latest_sql(name: str, keys: str, order: str = "ingested_at") -> str:
    """The same as a subquery."""
    return f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order} DESC NULLS LAST) = 1)"
