from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from patchloom.llm import kernels as K
from patchloom.llm import nearcopy, overlap, records
from pyspark.sql import functions as F

from .conftest import CASE, CHUNK, near, runs


def split_of(s):
    s = (s or "").strip().lower()
    return None if not s else "train" if s.startswith("tr") else "validation" if s[0] in "vd" else "test"


def place(p):
    import posixpath

    return p and posixpath.normpath(p.strip().lower().replace("\\", "/")).split("defects_db/")[1]


def test_kernel_runs_are_the_sets_of_the_definition():
    texts = ["", "a", "Foo_bar(1, 2)\n\tx  +ÉA²", None, "  ", "a b c d", "ünïcode «quoted» 量子 ８ a_b a-b", "x" * 3000 + " y z w"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for _, codes, starts in K.slices(iter([batch]), "text"):
        _, at = K.shingles(codes, starts, 4)
        assert np.diff(at).tolist() == [len(runs(t)) for t in texts]


def test_slices_cover_all_rows(monkeypatch):
    monkeypatch.setattr(K, "SLICE_CHARS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["abcdefghijklmnop", "", "é", None, "xy" * 9])], names=["text"])
    got = [bytes(codes.astype(np.uint32)).decode("utf-32-le")[a:b] for _, codes, starts in K.slices(iter([batch.slice(1)]), "text") for a, b in zip(starts, starts[1:], strict=False)]
    assert got == ["", "é", "", "xy" * 9]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 50, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 50, 100).astype(np.uint64)])
    sig = nearcopy.signatures(np.concatenate([a, b]), np.array([0, 400, 800, 800]), 2048)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.05 and not sig[2].any()


def test_signatures_estimate_weighted_similarity():
    grams = np.array([1, 2, 3, 1, 2, 4], np.uint64)
    weights = np.array([4.0, 1.0, 1.0, 4.0, 1.0, 5.0])
    sig = nearcopy.signatures(grams, np.array([0, 3, 6]), 4096, weights)
    # sum over common runs of 1 / sum of the larger ratios
    want = 1 / (1 + 1 / 4 + 1 / 4 + 5 / 4) + 1 / (4 + 1 + 1 + 5)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_found_pairs_are_those_of_brute_force(chunks, chunks_rows):
    got = nearcopy.chunk_pairs(*nearcopy.near_copies(chunks)).collect()
    rows = sorted({(i, r, t) for i, r, t in chunks_rows if i}, key=lambda x: x[0])
    want = {(a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if a[1] != b[1] and near(a[2], b[2])}
    assert len(got) == len(want) > 10 and {tuple(r) for r in got} == want


def test_groups_are_those_of_brute_force(spark, chunks_rows):
    """Copies, a near-same text of the same case (no link) and texts without any other."""
    made = "def f(a, b):\n    return [a, b, a + b, a - b, a * b, 7, 8, 9]"
    chunks_rows = [*chunks_rows, ["o1", "G9/own", made], ["o2", "G9/own", made + " + 1"], ["u1", None, made.replace("f", "other quite different words stand here alone")]]
    rows = sorted({(i, r, t) for i, r, t in chunks_rows if i and runs(t)}, key=str)
    key = [frozenset(runs(t)) for _, _, t in rows]
    classes, cases = {k: [r for r, c in zip(rows, key, strict=True) if c == k] for k in key}, {k: {r[1] for r, c in zip(rows, key, strict=True) if c == k} for k in key}
    close = lambda x, y: x != y and len(x & y) >= 0.7 * len(x | y) - 1e-9 and len(cases[x] | cases[y]) > 1
    links = {x: {y for y in classes if close(x, y)} for x in classes}

    def group(k):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        return frozenset(r[0] for x in seen for r in classes[x])

    table = spark.createDataFrame([(i, r, t) for i, r, t in chunks_rows], "chunk_id string, repo_key string, text string")
    got = nearcopy.chunk_groups(*nearcopy.near_copies(table)).collect()
    assert {(r.chunk_id, r.repo_key, r.class_size, r.cases, r.links) for r in got} == {(i, c, len(classes[k]), len(cases[k]), len(links[k])) for (i, c, _), k in zip(rows, key, strict=True)}
    assert len(got) == len(rows) and {"o1", "o2", "u1"} <= {r.chunk_id for r in got if r.links == 0} and any(r.links == 0 and r.cases > 1 for r in got)
    of = lambda name: {frozenset(r.chunk_id for r in got if r[name] == v) for v in {r[name] for r in got}}
    assert of("class_id") == {frozenset(r[0] for r in c) for c in classes.values()} and of("group_id") == {group(k) for k in classes}


@pytest.mark.parametrize("buckets", [1 << 20, 64])
def test_overlaps_are_those_of_brute_force(cases, cases_rows, chunks, chunks_rows, buckets, monkeypatch):
    """With 64 buckets every run seems common, and nothing is lost."""
    monkeypatch.setattr(overlap.near_chunk_pairs, "__defaults__", (overlap.THRESHOLD, buckets))
    rows = overlap.overlaps(cases, chunks).collect()
    split = {i: split_of(s) for i, _, s, _ in cases_rows if i}
    of: dict = {}
    for i, r, t in chunks_rows:
        if i:
            of.setdefault(r, []).append(t)
    path = {i: place(p) for i, _, _, p in cases_rows if i}
    want = {(e, t) for e in split for t in split if split[t] == "train" and split[e] in ("validation", "test")
            and (path[e] is not None and path[e] == path[t] or any(near(x, y) for x in of.get(e, []) for y in of.get(t, [])))}
    assert {(r.eval_case, r.train_case) for r in rows} == want and len(rows) == len(want) > 3
    assert any(r.same_file for r in rows) and all(r.eval_split == split[r.eval_case] for r in rows)


def test_empty_tables(spark, cases, chunks):
    none = spark.createDataFrame([], CHUNK)
    assert nearcopy.chunk_pairs(*nearcopy.near_copies(none)).count() == 0
    assert overlap.overlaps(spark.createDataFrame([], CASE), none).count() == 0
    assert overlap.overlaps(spark.createDataFrame([], CASE), chunks).count() == 0
    assert overlap.overlaps(cases, none).where("chunk_pairs > 0").count() == 0


def test_path_keys(spark):
    given = ["/a/defects_db/X/b.py", " D:\\q\\Defects_DB\\x\\B.PY", "./defects_db/t/../x//./b.py", "defects_db", "/nowhere/x/b.py", None, "", "../../defects_db/x/b.py"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(given)], "i int, p string")
    got = [r[0] for r in df.select("i", records.path_key(F.col("p")).alias("k")).orderBy("i").select("k").collect()]
    assert got == ["x/b.py"] * 3 + [None] * 4 + ["x/b.py"]


def test_training_runs_are_those_of_the_bit_table(spark, chunks):
    """In a table in which every run seems common, a training chunk lists only runs by which an evaluation chunk is found."""
    placed = chunks.where("length(text) > 0 and chunk_id is not null").withColumn("side", F.when(F.col("chunk_id").like("k%"), overlap.TRAIN).otherwise(overlap.EVAL).cast("byte"))
    table = spark.sparkContext.broadcast(overlap.run_counts(placed, 64))
    listed = lambda side, bits: {(r.content, r.gram): r.place for r in overlap.rare_runs(placed.where(F.col("side") == side), table, bits=bits).where("gram is not null").collect()}
    ours, every = listed(overlap.EVAL, None), listed(overlap.TRAIN, None)
    marked = {g for _, g in ours}
    bits = overlap.run_bits(spark.createDataFrame([(g,) for g in marked], "gram long"))
    some = listed(overlap.TRAIN, bits)
    assert some == {k: v for k, v in every.items() if k[1] in marked} and 0 < len(some) < len(every)


def test_candidates_are_dropped_by_place(spark):
    row = "gram long, place int, content long, n int"
    ours = spark.createDataFrame([(7, 0, 1, 100), (8, 30, 1, 100), (9, 30, 2, 100), (9, 30, 2, 100), (None, None, 1, 100)], row)
    theirs = spark.createDataFrame([(7, 5, 11, 100), (8, 30, 12, 100), (9, 2, 13, 70), (9, 2, 14, 69)], row)
    assert {tuple(r) for r in overlap.candidates(ours, theirs).collect()} == {(1, 11)}
