"""Cutting files into overlapping windows of lines, or into syntactic units."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK, line_range, split_lines


def window_chunks(files: DataFrame, repo: Column, path: Column, text: Column, window: Column | int = 80, overlap: Column | int = 10) -> DataFrame:
    """All columns of files plus chunk_id, start_line, end_line, symbol, kind, chunk: a window every window - overlap lines while any line is left.

    Null and empty texts have no window; the id is the first 12 hex digits of the
    MD5 of repository, path and range.
    """
    window, overlap = (x if isinstance(x, Column) else F.lit(x) for x in (window, overlap))
    lined = files.withColumn("_lines", split_lines(text)).withColumn("_n", F.size("_lines")).withColumn("_w", window).withColumn("_step", F.greatest(window - overlap, F.lit(1)))
    each = lined.where("_n > 0").withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.col("_step"))))
    start, end = F.col("_at") + 1, F.least(F.col("_at") + F.col("_w"), F.col("_n"))
    span = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
    return each.select(
        *files.columns, F.left(F.md5(F.concat(repo, F.lit(":"), path, F.lit(":"), span)), F.lit(12)).alias("chunk_id"), start.alias("start_line"), end.alias("end_line"),
        F.concat(F.lit("<win@"), span, F.lit(">")).alias("symbol"), F.lit("module").alias("kind"), line_range(F.col("_lines"), start, end).alias("chunk"),
    )


def adaptive_window(lines: Column) -> tuple[Column, Column]:
    """Window and overlap that follow the length of the file."""
    window = F.greatest(F.lit(6), F.least(F.lit(40), F.floor(lines / 3).cast("int") + 2))
    return window, F.greatest(F.lit(2), F.floor(window / 4).cast("int"))


def syntax_chunks(files: DataFrame, repo: str, path: str, text: str, window: int = 80, overlap: int = 10) -> DataFrame:
    """chunk_id, repo, path, start_line, end_line, symbol, kind, chunk of every function and class, outer ones first; files without any, or that can't be parsed, in windows named <module>.

    Null texts have no chunk.
    """
    breaks = re.compile(LINE_BREAK)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r, p, t in zip(batch["repo"], batch["path"], batch["text"], strict=True):
                lines = breaks.split(t)
                lines = lines[:-1] if lines[-1] == "" else lines
                try:
                    nodes = [n for n in ast.walk(ast.parse(t)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    nodes = []
                spans = [(n.lineno, max(n.lineno, n.end_lineno), n.name, "class" if isinstance(n, ast.ClassDef) else "function") for n in nodes]
                spans = spans or [(i + 1, min(i + window, len(lines)), "<module>", "module") for i in range(0, len(lines), max(1, window - overlap))]
                rows += [(hashlib.md5(f"{r}:{p}:{s}-{e}".encode()).hexdigest()[:12], r, p, s, e, name, kind, "\n".join(lines[s - 1 : e])) for s, e, name, kind in spans]
            yield pd.DataFrame(rows, columns=["chunk_id", "repo", "path", "start_line", "end_line", "symbol", "kind", "chunk"])

    schema = "chunk_id string, repo string, path string, start_line int, end_line int, symbol string, kind string, chunk string"
    some = files.where(F.col(text).isNotNull()).select(F.coalesce(repo, F.lit("")).alias("repo"), F.coalesce(path, F.lit("")).alias("path"), F.col(text).alias("text"))
    return some.mapInPandas(cut, schema)
