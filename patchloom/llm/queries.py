"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encode, nearcopy, overlap, packing, pieces, spans, splits, subjects
from .stages import keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training and an evaluation case that share a file or a near-same chunk."""
    o = overlap.overlaps(table(spark, sf_dir, "all_cases"), table(spark, sf_dir, "code_chunks"))
    return o.select(F.least("eval_case", "train_case").alias("case_a"), F.greatest("eval_case", "train_case").alias("case_b"))


def p1_overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and group of the evaluation case: pairs, cases concerned, and how they overlap."""
    o = overlap.overlaps(table(spark, sf_dir, "all_cases"), table(spark, sf_dir, "code_chunks"))
    return o.groupBy("eval_split", "eval_group").agg(
        F.count("*").alias("pairs"), F.countDistinct("eval_case").alias("eval_cases"), F.sum(F.col("same_file").cast("long")).alias("same_file_pairs"),
        F.sum((F.col("chunk_pairs") > 0).cast("long")).alias("near_same_pairs"), F.round(F.max("containment"), 6).alias("most_contained"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-same chunks of different cases."""
    return nearcopy.chunk_pairs(*nearcopy.near_copies(table(spark, sf_dir, "code_chunks")))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk: its class of texts with its size and cases, its group and the number of near-same classes of other cases."""
    return nearcopy.chunk_groups(*nearcopy.near_copies(table(spark, sf_dir, "code_chunks")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of related sets that hold at least two splits, which the new assignment keeps whole."""
    placed = keep(splits.assign(table(spark, sf_dir, "all_cases"), table(spark, sf_dir, "synthetic_benchmark_report")))
    return splits.torn(placed.select("case_id", "set_id", F.col("old_split").alias("split")))


def p3_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new split for every case, each related set whole."""
    return splits.assign(table(spark, sf_dir, "all_cases"), table(spark, sf_dir, "synthetic_benchmark_report"))


def p3_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases, sets and share of each new split."""
    new = keep(p3_assigned(spark, sf_dir))
    total = new.agg(F.count("*").alias("total"))
    counted = new.groupBy("split").agg(F.count("*").alias("cases"), F.countDistinct("set_id").alias("sets"))
    return counted.crossJoin(F.broadcast(total)).select("split", "cases", "sets", F.round(F.col("cases") / F.col("total"), 6).alias("share"))


def p3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each finding code, and over all cases, how they fall on the new splits."""
    return splits.balance(keep(p3_assigned(spark, sf_dir)), splits.labels_of(table(spark, sf_dir, "all_cases")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized chunks and the strongest boundary at which cuts alone suffice."""
    return pieces.pieces(table(spark, sf_dir, "code_chunks")).where("piece = 0").select("chunk_id", "boundary")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of oversized chunks."""
    return pieces.pieces(table(spark, sf_dir, "code_chunks"))


def _spans(spark: SparkSession, sf_dir: str) -> spans.SpanIndex:
    return spans.shared_spans(table(spark, sf_dir, "code_chunks"), table(spark, sf_dir, "donor_exemplars"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that share a span of 200 characters with a record of another case."""
    return _spans(spark, sf_dir).record_spans().select("rec_kind", "rec_id").distinct()


def p5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared stretches of each record."""
    return _spans(spark, sf_dir).record_spans().select("rec_kind", "rec_id", "start", "stop")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each record the share of its text that stands elsewhere."""
    return spans.shares(_spans(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode.encode(table(spark, sf_dir, "documents"), "doc_id")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, tokens, and how many documents come back as they were from their ids."""
    docs = table(spark, sf_dir, "documents")
    ids = keep(encode.encode(docs, "doc_id"))
    back = encode.decode(ids, "doc_id").select("doc_id", F.md5("text").alias("back"))
    sizes = ids.select("doc_id", F.size("ids").alias("tokens"))
    rows = docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("there")).join(back, "doc_id").join(sizes, "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.sum((F.col("back") == F.col("there")).cast("long")).alias("restored"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = encode.encode(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.size("ids").alias("tokens"))
    return packing.pack(sizes, "doc_id", "tokens")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, or of each part of a document over the capacity."""
    return _packed(spark, sf_dir).withColumnRenamed("size", "tokens")


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, and how much of them stays unused."""
    return packing.usage(_packed(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of each document."""
    return subjects.subjects_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_examples")).select("doc_id", "subject")


def p8_make_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by source and subject."""
    return subjects.make_up(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_examples"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        p1_found, p1_overlap_counts, p2_found, p2_groups, p3_found, p3_assigned, p3_balance, p3_labels, p4_found, p4_pieces, p5_found, p5_spans, p5_shares,
        p6_ids, p6_decoded, p7_packed, p7_usage, p8_found, p8_make_up,
    )
    return {f.__name__: f for f in every}


#: Relations by group and template, walked to the end; every row of all_cases.
_P3 = r"""
WITH RECURSIVE c AS (
  SELECT case_id, min(coalesce(lower(trim(case_group)), lower(split_part(case_id, '/', 1)))) AS g,
         min(CASE WHEN lower(trim(split)) LIKE 'tr%' THEN 'train' WHEN lower(trim(split)) LIKE 'v%' OR lower(trim(split)) LIKE 'dev%' THEN 'validation' WHEN lower(trim(split)) LIKE 't%' THEN 'test' END) AS split
  FROM all_cases GROUP BY case_id),
t AS (SELECT DISTINCT lower(trim(template)) AS t, g FROM synthetic_benchmark_report r JOIN c ON r.id = c.case_id WHERE template IS NOT NULL),
e AS (SELECT DISTINCT a.g AS a, b.g AS b FROM t a JOIN t b USING (t)),
w AS (SELECT DISTINCT g AS a, g AS b FROM c UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a),
s AS (SELECT a AS g, min(b) AS root FROM w GROUP BY a),
x AS (SELECT case_id, split, root FROM c JOIN s USING (g))
SELECT case_id FROM x WHERE root IN (SELECT root FROM x GROUP BY root HAVING min(split) < max(split))
"""

#: Cut boundaries from lines; a stretch is what stands between blank lines.
_P4 = r"""
WITH o AS (SELECT chunk_id, any_value(text) AS text FROM code_chunks WHERE length(text) > 2400 GROUP BY chunk_id),
l AS (SELECT chunk_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM o),
b AS (SELECT *, regexp_full_match(line, '\s*') AS blank, sum(CASE WHEN regexp_full_match(line, '\s*') THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY i) AS part FROM l),
s AS (SELECT chunk_id, part, sum(length(line) + 1) - 1 AS n FROM b WHERE NOT blank GROUP BY chunk_id, part),
m AS (SELECT chunk_id, max(n) AS stretch FROM s GROUP BY chunk_id),
g AS (SELECT chunk_id, max(length(line)) AS longest FROM l GROUP BY chunk_id)
SELECT chunk_id, CASE WHEN coalesce(stretch, 0) <= 2400 THEN 'block' WHEN longest <= 2400 THEN 'line' ELSE 'inside' END AS boundary
FROM g LEFT JOIN m USING (chunk_id)
"""


def oracle_sql() -> dict[str, str]:
    """Only what SQL can say over whole tables; the other queries are tested against brute force in tests/llm."""
    return {"p3_found": _P3, "p4_found": _P4}
