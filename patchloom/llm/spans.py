"""Problem 5: long exact spans that records share.

An index holds fingerprints of all records seen so far in immutable runs, each
bucketed and sorted by fingerprint. A batch of records becomes a new run, is
merge-joined with the runs before it, and every chance match is verified on the
texts. When there are more than FANOUT runs they are compacted into one.

Fingerprints are hashes of windows of half the span, chosen so that any two
texts that share a span share a chosen window in it. Matches in groups of up to
PAIRED entries are followed along their diagonal in both texts. In larger groups,
as boilerplate makes them, every window of a whole span around the match is
hashed and counted by case, which needs no pairs and finds the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .stages import keep, light, shared_folder

SPAN, PAIRED, FANOUT = 200, 16, 4
_SPANS = "content long, start int, stop int"


def shared_records(code_chunks: DataFrame, donors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of both kinds as batches of rec_kind, rec_id, owner (a hash of the case), text."""

    def batch(df: DataFrame, kind: str, key: str, case: str, text: str) -> DataFrame:
        return df.select(F.lit(kind).alias("rec_kind"), F.col(key).cast("string").alias("rec_id"), F.xxhash64(F.coalesce(case, F.lit(""))).alias("owner"), F.col(text).alias("text"))

    return batch(code_chunks, "chunk", "chunk_id", "repo_key", "text"), batch(donors, "donor", "donor_id", "case_id", "buggy_chunk")


def fingerprints(batch: DataFrame, span: int = SPAN) -> DataFrame:
    """fp, content, owner, pos of the chosen windows; a task gives a text for at most two owners, which are as good as all."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[int]] = {}
        for part, codes, starts in K.slices(batches, "text"):
            content, owner = part.column("content").to_numpy(), part.column("owner").to_numpy()
            new = np.zeros(part.num_rows, bool)
            for i, (c, o) in enumerate(zip(content.tolist(), owner.tolist(), strict=True)):
                own = seen.setdefault(c, set())
                if o not in own and len(own) < 2:
                    own.add(o)
                    new[i] = True
            h, doc, pos = K.winnow(codes, starts, span)
            use = new[doc]
            h, doc, pos = h[use], doc[use], pos[use]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(content[doc]), pa.array(owner[doc]), pa.array(pos, pa.int32())], names=["fp", "content", "owner", "pos"])

    long_enough = batch.where(F.length("text") >= span).select(F.xxhash64("text").alias("content"), "owner", "text")
    return long_enough.mapInArrow(mark, "fp long, content long, owner long, pos int")


class SpanIndex:
    """A log-structured index of fingerprints that takes batches of records one after the other."""

    def __init__(self, spark: SparkSession, span: int = SPAN, paired: int = PAIRED, fanout: int = FANOUT):
        self.spark, self.span, self.paired, self.fanout = spark, span, paired, fanout
        self.runs: list[DataFrame] = []
        self.members: list[DataFrame] = []
        self.batches: list[DataFrame] = []
        self.found: list[DataFrame] = []

    def _run(self, entries: DataFrame) -> DataFrame:
        name, parts = f"run_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{shared_folder(self.spark).rstrip('/')}/{name}"
        entries.repartition(parts, "fp").write.bucketBy(parts, "fp").sortBy("fp").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def add(self, batch: DataFrame) -> None:
        """Index a batch and find what it shares with itself and with all batches before."""
        self.members.append(keep(batch.where("text is not null").select("rec_kind", "rec_id", "owner", F.xxhash64("text").alias("content"), F.length("text").alias("n")).distinct()))
        self.batches.append(batch)
        new = self._run(fingerprints(batch, self.span))
        group = new
        if self.runs:
            touched = new.select("fp").distinct()
            for run in self.runs:
                group = group.union(run.join(touched, "fp", "left_semi"))
        self._match(group)
        self.runs.append(new)
        if len(self.runs) > self.fanout:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one."""
        merged = self.runs[0]
        for run in self.runs[1:]:
            merged = merged.union(run)
        self.runs = [self._run(merged.distinct())]

    def _match(self, group: DataFrame) -> None:
        stats = group.groupBy("fp").agg(F.count("*").alias("size"), F.min("owner").alias("lo"), F.max("owner").alias("hi")).where("lo < hi").select("fp", "size")
        linked = keep(group.join(stats, "fp"))
        cold = linked.where(F.col("size") <= self.paired).select("fp", "content", "owner", "pos")
        b = cold.select("fp", F.col("content").alias("b"), F.col("owner").alias("owner_b"), F.col("pos").alias("pos_b"))
        pairs = cold.withColumnRenamed("content", "a").join(b, "fp").where("a < b and owner <> owner_b")
        self.found.append(self._follow(pairs.groupBy("a", "b").agg(F.collect_set(F.expr("pos_b - pos")).alias("shift"))))
        hot = linked.where(F.col("size") > self.paired).groupBy("content").agg(F.collect_set("owner").alias("owners"), F.collect_set("pos").alias("at"))
        self.found.append(self._windows(hot))

    def _texts(self, contents: DataFrame) -> DataFrame:
        """content, text of each content asked for."""
        wanted = light(keep(contents.distinct()))
        parts = [x.where(F.length("text") >= self.span).select(F.xxhash64("text").alias("content"), "text").join(wanted, "content", "left_semi") for x in self.batches]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.dropDuplicates(["content"])

    def _follow(self, pairs: DataFrame) -> DataFrame:
        """Spans that two texts share along the diagonals on which they have a window in common."""
        pairs, span = keep(pairs), self.span
        texts = keep(self._texts(pairs.select(F.col("a").alias("content")).union(pairs.select("b"))))

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple[int, int, int]] = []
                for a, b, shift, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "shift", "text_a", "text_b")), strict=True):
                    u, v = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (x, y))
                    for d in shift:
                        lo, hi = max(0, -d), min(u.size, v.size - d)
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], (u[lo:hi] == v[lo + d : hi + d]).view(np.int8), [0]])))
                        for s, e in zip(edges[::2] + lo, edges[1::2] + lo, strict=True):
                            if e - s >= span:
                                out += [(a, s, e), (b, s + d, e + d)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["content", "start", "stop"])

        joined = pairs.join(texts.select(F.col("content").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("content").alias("b"), F.col("text").alias("text_b")), "b")
        return keep(joined.mapInArrow(follow, _SPANS).distinct())

    def _windows(self, hot: DataFrame) -> DataFrame:
        """Windows of a whole span around matches of large groups that stand in several cases; two hashes name a window."""
        hot, span = keep(hot), self.span
        if hot.isEmpty():
            return self.spark.createDataFrame([], _SPANS)

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, codes, starts in K.slices(batches, "text"):
                h, g = K.rolling(codes, span), K.rolling(codes.astype(np.uint32) + np.uint32(0x200000), span)
                at = part.column("at").to_pylist()
                near = [np.unique(np.add.outer(np.array(p), np.arange(-(span - span // 2), 1))) for p in at]
                near = [x[(x >= 0) & (x <= n - span)] for x, n in zip(near, np.diff(starts), strict=True)]
                doc, start = np.repeat(np.arange(len(near)), [x.size for x in near]), np.concatenate(near)
                w = (starts[doc] + start).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[w].view(np.int64)), pa.array(g[w].view(np.int64)), part.column("content").take(pa.array(doc)), pa.array(start, pa.int32())], names=["w", "v", "content", "start"])

        owners = keep(hot.select("content", F.array_min("owners").alias("least"), F.array_max("owners").alias("most")))
        seen = keep(self._texts(hot.select("content")).join(hot.select("content", "at"), "content").select("content", "text", "at").mapInArrow(windows, "w long, v long, content long, start int"))
        owned = seen.join(light(owners), "content")
        several = owned.groupBy("w", "v").agg(F.min("least").alias("lo"), F.max("most").alias("hi")).where("lo < hi").select("w", "v")
        return keep(seen.join(several, ["w", "v"], "left_semi").select("content", "start", (F.col("start") + span).alias("stop")))

    def record_spans(self) -> DataFrame:
        """rec_kind, rec_id, n, start, stop: for each record the stretches, not overlapping, of which each character stands in a shared span."""
        members = self.members[0]
        for m in self.members[1:]:
            members = members.union(m)
        copies = members.where(F.col("n") >= self.span).groupBy("content").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.max("n").alias("stop")).where("lo < hi").select("content", F.lit(0).alias("start"), "stop")
        spans = copies
        for f in self.found:
            spans = spans.union(f.select("content", "start", "stop"))
        sorted_spans = F.sort_array(F.collect_set(F.struct("start", "stop")))
        none = F.array().cast("array<struct<start:int,stop:int>>")
        joined = F.aggregate(
            "spans", none,
            lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(F.concat(acc, F.array(x)), F.greatest(F.size(acc), F.lit(1)))["stop"] >= x["start"]),
                F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["stop"], x["stop"]).alias("stop")))),
            ).otherwise(F.concat(acc, F.array(x))),
        )
        merged = keep(spans.groupBy("content").agg(sorted_spans.alias("spans")).select("content", F.explode(joined).alias("x")).select("content", "x.start", "x.stop"))
        return members.select("rec_kind", "rec_id", "content", "n").distinct().join(light(merged), "content").select("rec_kind", "rec_id", "n", "start", "stop")

    def records(self) -> DataFrame:
        """rec_kind, rec_id, n of every record whose text is not null."""
        members = self.members[0]
        for m in self.members[1:]:
            members = members.union(m)
        return members.groupBy("rec_kind", "rec_id").agg(F.max("n").alias("n"))


def shared_spans(code_chunks: DataFrame, donors: DataFrame, span: int = SPAN) -> SpanIndex:
    """The index of both tables, each a batch.

    Null texts are no records, texts shorter than the span share nothing; a null
    case is one case of its own; repeated rows count once. Sharing is between
    different cases only; texts are compared as they stand.
    """
    index = SpanIndex(code_chunks.sparkSession, span)
    for batch in shared_records(code_chunks, donors):
        index.add(batch)
    return index


def shares(index: SpanIndex) -> DataFrame:
    """rec_kind, rec_id, n_chars, shared_chars, share: for every record how much of its text stands in another case."""
    shared = index.record_spans().groupBy("rec_kind", "rec_id").agg(F.sum(F.col("stop") - F.col("start")).alias("shared_chars"))
    shared_chars = F.coalesce("shared_chars", F.lit(0).cast("long"))
    share = F.when(F.col("n") > 0, F.round(shared_chars / F.col("n"), 6)).otherwise(0.0)
    return index.records().join(shared, ["rec_kind", "rec_id"], "left").select("rec_kind", "rec_id", F.col("n").alias("n_chars"), shared_chars.alias("shared_chars"), share.alias("share"))
