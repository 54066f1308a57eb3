from __future__ import annotations

import random

import pytest
from patchloom.llm import spans

from .conftest import CHUNK, DONOR, NOW

SPAN = 40


def brute(records: list[tuple], span: int) -> dict[tuple, int]:
    """Shared characters of each record, from all windows."""
    cases: dict[str, set] = {}
    for *_, case, t in records:
        for i in range(len(t) - span + 1):
            cases.setdefault(t[i : i + span], set()).add(case)
    out = {}
    for kind, rid, _, t in records:
        marked = [False] * len(t)
        for i in range(len(t) - span + 1):
            if len(cases[t[i : i + span]]) > 1:
                marked[i : i + span] = [True] * span
        out[kind, rid] = sum(marked)
    return out


@pytest.fixture(scope="module")
def records():
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghij ()\nñ量") for _ in range(n))
    common, boiler = [noise(n) for n in (39, 40, 41, 90, 200)], noise(70)
    out = []
    for k in range(60):
        parts = [noise(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(common), noise(rng.randint(0, 40))]
        if k % 3 == 0:
            parts.append(boiler)
        if k % 11 == 0:
            parts = ["=" * rng.randint(30, 200)]
        out.append(("chunk" if k % 4 else "donor", str(k), f"case{k % 7}", "".join(parts)))
    out += [("chunk", "900", "case1", out[5][3]), ("chunk", "901", "case1", out[5][3]), ("donor", "902", "case3", "x" * 39), ("chunk", "903", "case4", "")]
    return out


@pytest.fixture(scope="module")
def tables(spark, records):
    c = [(i, r, "f", 1, 1, "s", "k", t, NOW, 1, "s", 2) for kind, i, r, t in records if kind == "chunk"] + [("904", "case1", "f", 1, 1, "s", "k", None, NOW, 1, "s", 2)]
    d = [(int(i), r, t, None, "o") for kind, i, r, t in records if kind == "donor"] + [(905, None, None, None, "o")]
    return spark.createDataFrame(c + c[:4], CHUNK), spark.createDataFrame(d + d[:2], DONOR)


@pytest.mark.parametrize(("paired", "fanout", "batches"), [(16, 4, 2), (2, 4, 2), (16, 1, 3), (0, 1, 3)])
def test_shares_are_those_of_brute_force(spark, records, tables, paired, fanout, batches):
    """Whatever the groups' limit, the runs' number and the batches, the same comes out."""
    index = spans.SpanIndex(spark, SPAN, paired, fanout)
    chunks, donors = spans.shared_records(*tables)
    for b in [donors, chunks] if batches == 2 else [chunks.where("rec_id % 2 = 0"), chunks.where("rec_id % 2 = 1"), donors]:
        index.add(b)
    assert len(index.runs) <= fanout
    got = {(r.rec_kind, r.rec_id): r.shared_chars for r in spans.shares(index).collect()}
    want = brute(records, SPAN)
    assert got == want
    assert {(r.rec_kind, r.rec_id) for r in index.record_spans().collect()} == {k for k, n in want.items() if n}


def test_empty_tables(spark):
    index = spans.shared_spans(spark.createDataFrame([], CHUNK), spark.createDataFrame([], DONOR))
    assert index.record_spans().count() == 0 and spans.shares(index).count() == 0
