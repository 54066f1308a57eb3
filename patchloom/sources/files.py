"""Cases, splits, findings and results as files; and what is written back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = T.StructType([T.StructField("case", T.StringType()), T.StructField("method", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("lines_f1", "lines_p", "lines_r"))])
FINDINGS = "case string, file string, ast_parse_ok boolean, parse_error string, num_findings int, findings array<struct<rule:string,line:int,message:string,severity:string>>"
SPLITS = "train_ids array<string>, val_ids array<string>, test_ids array<string>, splits struct<train:array<string>,val:array<string>,test:array<string>>, train array<string>, val array<string>, test array<string>"


def decoded(content: Column, strict: bool = False) -> Column:
    """The text of bytes: UTF-8 with a replacement for what isn't; strict tries UTF-8 with a mark, UTF-16 with a mark and Latin-1 before."""

    def lenient(raw: bytes) -> str:
        return raw.decode("utf-8", "replace")

    def careful(raw: bytes) -> str:
        marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
        for encoding in [e for m, e in marks if raw.startswith(m)] + ["utf-8", "latin-1"]:
            try:
                return raw.decode(encoding)
            except UnicodeDecodeError:
                continue
        return lenient(raw)

    read = careful if strict else lenient

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: "" if x is None else read(bytes(x)))

    return text(content)


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """id (folder below the root, with slashes), name, text of every Python file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(folder)
    below = F.regexp_replace(F.split_part("path", F.lit(folder.rstrip("/") + "/"), F.lit(-1)), r"^file:", "")
    return files.select(F.regexp_replace(below, "/?[^/]+$", "").alias("id"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), decoded(F.col("content")).alias("text"))


def discover_cases(spark: SparkSession, folder: str, excluded: tuple[str, ...] = (), need_fix: bool = True) -> DataFrame:
    """case_id, grp, buggy_src, fixed_src of every folder with buggy.py and, if needed, fixed.py or else fix.py; blank sources are left out then."""
    files = source_files(spark, folder)
    buggy = files.where("name = 'buggy.py'").select(F.col("id").alias("case_id"), F.col("text").alias("buggy_src"))
    fixes = files.where("name in ('fixed.py', 'fix.py')").groupBy(F.col("id").alias("case_id")).agg(F.max_by("text", "name").alias("fixed_src"))
    joined = buggy.join(fixes, "case_id", "inner" if need_fix else "left")
    if need_fix:
        joined = joined.where(r"buggy_src rlike '\\S'")
    kept = joined.where(~F.col("case_id").isin(*excluded)) if excluded else joined
    return kept.select("case_id", F.split_part("case_id", F.lit("/"), F.lit(1)).alias("grp"), "buggy_src", "fixed_src")


def split_members(spark: SparkSession, path: str) -> DataFrame:
    """case_id, split from a split document in any of its layouts: lists of ids, lists under splits, or lists by name."""
    doc = spark.read.schema(SPLITS).json(path, multiLine=True)
    parts = [doc.select(F.explode(F.coalesce(f"{s}_ids", f"splits.{s}", s)).alias("case_id"), F.lit(s).alias("split")) for s in ("train", "val", "test")]
    return parts[0].union(parts[1]).union(parts[2])


def only_split(df: DataFrame, members: DataFrame, split: str, key: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """Rows of df in a split, and the ids of the split that df lacks."""
    ids = members.where(F.col("split") == split).select(key)
    return df.join(ids, key, "left_semi"), ids.join(df, key, "left_anti")


def read_results(spark: SparkSession, path: str, required: tuple[str, ...] = ("case", "method", "lines_f1")) -> DataFrame:
    """Results with a header; numbers that can't be read are null; a missing column is an error."""
    raw = spark.read.csv(path, header=True)
    if lost := [c for c in required if c not in raw.columns]:
        raise ValueError(f"{path} lacks {', '.join(lost)}")
    kinds = {f.name: f.dataType for f in RESULT}
    return raw.select(*(F.col(c).try_cast(kinds.get(c, T.StringType())).alias(c) for c in raw.columns))


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FINDINGS).json(path, multiLine=True)


def checksum(content: Column, expected: str) -> Column:
    """Does the MD5 of the bytes agree?"""
    return F.md5(content) == expected.lower()


def write_csv(df: DataFrame, path: str) -> None:
    """With a header, which an empty frame has as well."""
    df.write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_patches(df: DataFrame, path: str, case: str = "case_id", text: str = "patched", rationale: str = "rationale") -> None:
    """One row of JSON per case, in folders by group."""
    out = df.select(F.split_part(case, F.lit("/"), F.lit(1)).alias("grp"), F.replace(case, F.lit("/"), F.lit("__")).alias("name"), F.col(text).alias("text"), F.col(rationale).alias("rationale"))
    out.write.mode("overwrite").partitionBy("grp").json(path)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A report table of a small aggregate; more rows than `most` are an error, not cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    return "\n".join(lines) + "\n"
