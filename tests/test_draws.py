"""Orders by chance are those of hash_draws, and no draw is shuffled."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
import pytest
from patchloom.operators import draws, statistics
from pyspark.sql import functions as F

KEYS = ["", "a", "é量子", *("x" * n for n in (44, 47, 48, 49, 50, 51, 56, 120)), *(f"G{i}/case-{i * i}" for i in range(30))]
DIFFS = [((i * 37) % 11 - 5) / 8 for i in range(len(KEYS))]


def order(it: int, seed: int) -> list[str]:
    at = 8 * ((it - 1) % 4)
    return sorted(KEYS, key=lambda k: (hashlib.md5(f"{seed}-{(it - 1) // 4}-{k}".encode()).hexdigest()[at : at + 8], k.encode()))


def shuffled_rows(spark, query) -> int:
    """Rows written to shuffles while a query runs."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (x.apply(i) for x in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)] for i in range(x.size()))}
    before = stages()
    query.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for i, n in stages().items() if i not in before)


def test_digests(monkeypatch):
    monkeypatch.setattr(draws, "AT_ONCE", 7)
    made = draws.Digests(pa.array(KEYS))
    for prefix in (b"10-0-", b"10-7-", b"10-2499-", b"7-1-"):
        hexes = [hashlib.md5(prefix + k.encode()).hexdigest() for k in KEYS]
        assert made.of(prefix).T.tolist() == [[int(h[8 * p : 8 * p + 8], 16) for p in range(4)] for h in hexes]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([*zip(KEYS, DIFFS, strict=True), (None, 3.0)], "k string, diff double")


def test_sweep_is_that_of_brute_force(spark, pairs):
    diff = dict(zip(KEYS, DIFFS, strict=True))
    got = {r.k: (r.positive, r.mean) for r in statistics.size_sweep(pairs, "k", 4, 50, 3).collect()}
    orders = [[diff[k] for k in order(it, 6)] for it in range(1, 51)]
    assert got == {k: (round(sum(sum(o[:k]) > 0 for o in orders) / 50, 6), pytest.approx(sum(sum(o[:k]) / k for o in orders) / 50, abs=1e-6)) for k in range(4, len(KEYS) + 1)}


def test_subsamples_are_those_of_brute_force(spark, pairs):
    diff = dict(zip(KEYS, DIFFS, strict=True))
    sizes = spark.createDataFrame([(20, "b"), (7, "a"), (1, "c")], "k int, ratios string")
    got = {(r.k, r.it): (r.mean, r.p) for r in statistics.subsamples(pairs, "k", sizes, 30, 3).collect()}
    assert len(got) == 90
    for k, it in got:
        part = [diff[x] for x in order(it, 6)[:k]]
        some = sorted(abs(x) for x in part if x)
        rank = {s: some.index(s) + (some.count(s) + 1) / 2 for s in some}
        n, var = len(some), len(some) * (len(some) + 1) * (2 * len(some) + 1) / 24 - sum(some.count(s) ** 3 - some.count(s) for s in rank) / 48
        mean, p = got[k, it]
        assert mean == pytest.approx(sum(part) / k, abs=1e-9)
        assert p is None if not n else p == pytest.approx(math.erfc((sum(rank[abs(x)] for x in part if x > 0) - n * (n + 1) / 4) / math.sqrt(var) / math.sqrt(2)) / 2, abs=2e-7)


def test_sweep_shuffles_no_draws(spark):
    many = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 7 - 3).cast("double").alias("diff"))
    assert shuffled_rows(spark, statistics.size_sweep(many, "k", 4, 400)) < 1000 * 400 / 5


def test_subsamples_shuffle_no_draws(spark):
    many = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 7 - 3).cast("double").alias("diff"))
    sizes = spark.createDataFrame([(100, "a"), (200, "b")], "k int, ratios string")
    assert shuffled_rows(spark, statistics.subsamples(many, "k", sizes, 400)) < 1000 * 400 / 5


def test_no_pairs(spark, pairs):
    sizes = spark.createDataFrame([(1, "a")], "k int, ratios string")
    assert statistics.size_sweep(pairs.limit(0), "k").count() == statistics.subsamples(pairs.limit(0), "k", sizes).count() == 0
