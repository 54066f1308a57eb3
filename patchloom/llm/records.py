"""Cases and records as the operators of this package read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_name(split: Column) -> Column:
    """train, validation or test from any spelling or abbreviation of it; anything else, and null, is null."""
    s = F.lower(F.regexp_replace(split, r"[^A-Za-z]", ""))
    return F.when(s.rlike("^tr"), "train").when(s.rlike("^(v|dev)"), "validation").when(s.rlike("^(te|ts)"), "test")


def folded(value: Column) -> Column:
    """Lower case without blanks around."""
    return F.lower(F.regexp_replace(value, r"^(?U)\s+|\s+$", ""))


def group_key(case_id: Column, case_group: Column) -> Column:
    """The folded group, or the first segment of the id where the group is null."""
    return folded(F.coalesce(case_group, F.split_part(case_id, F.lit("/"), F.lit(1))))


def path_key(path: Column, below: str = "defects_db") -> Column:
    """The place a path leads to below a folder, whatever its root, separators, detours and letter case; null if it does not lead below it."""
    parts = F.filter(F.split(F.regexp_replace(folded(path), r"\\", "/"), "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda seen, p: F.when(p == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.concat(seen, F.array(p))),
    )
    at = F.array_position(walked, below)
    place = F.slice(walked, (at + 1).cast("int"), F.size(walked))
    return F.when((at > 0) & (at < F.size(walked)), F.array_join(place, "/"))


def cases(all_cases: DataFrame) -> DataFrame:
    """One row per case_id: case_id, grp, split, path. Rows without an id are dropped; a repeated row's first non-null value counts."""
    return (
        all_cases.where("case_id is not null")
        .select("case_id", group_key(F.col("case_id"), F.col("case_group")).alias("grp"), split_name(F.col("split")).alias("split"), path_key(F.col("buggy_path")).alias("path"))
        .groupBy("case_id")
        .agg(F.min("grp").alias("grp"), F.min("split").alias("split"), F.min("path").alias("path"))
    )
