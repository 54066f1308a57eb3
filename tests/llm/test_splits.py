from __future__ import annotations

import collections

import pytest
from patchloom.llm import splits

from .conftest import CASE, NOW, REPORT
from .test_near import split_of


@pytest.fixture(scope="module")
def reports(spark):
    rows = [("G0/case0", " T1 "), ("G1/case1", "t1"), ("G2/case2", "T2"), ("G3/case3", "t2"), ("G3/case3", "t3"), ("G4/case4", "T3"), ("gone/1", "t3"), ("gone/1", "t9"), ("G5/case5", "t9"), ("G6/case6", None), ("G7/case7", None), (None, "t2"), ("G0/case0", "T1")]
    return spark.createDataFrame([(a, b, "r") for a, b in rows], REPORT)


def sets_of(cases_rows, reports):
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    ids = {i for i, *_ in cases_rows if i}
    for i, g, *_ in cases_rows:
        if i:
            parent[root(("c", i))] = root(("g", (g if g is not None else i.split("/")[0]).strip().lower()))
    for r in reports.collect():
        if r.id in ids and r.template is not None:
            parent[root(("c", r.id))] = root(("t", r.template.strip().lower()))
    out = collections.defaultdict(set)
    for i in ids:
        out[root(("c", i))].add(i)
    return list(out.values())


def test_related_sets_and_torn_ones(cases, cases_rows, reports):
    got = collections.defaultdict(set)
    related = splits.related(cases, reports)
    for r in related.collect():
        got[r.set_id].add(r.case_id)
    want = sets_of(cases_rows, reports)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    split = collections.defaultdict(set)
    for i, _, s, _ in cases_rows:
        split[i].add(split_of(s))
    torn = {i for s in want if len({x for i in s for x in split[i]} - {None}) > 1 for i in s}
    assert {r[0] for r in splits.torn(related).collect()} == torn and torn


def test_assignment_keeps_sets_whole(spark, reports):
    """Codes that no list knows are labels too; the shares are met though sets stay whole."""
    rows = [(f"S{g}/c{k}", f"S{g}", None, None, ["QC01", "QC02,QC03 ", None, "new,qc01", ","][(g + k) % 5], NOW, "g", "p") for g in range(120) for k in range(1 + g % 5)]
    rows += [(f"BIG/c{k}", "BIG", "train", None, "QC09", NOW, "g", "p") for k in range(60)]
    table = spark.createDataFrame(rows + rows[:7], CASE)
    new = splits.assign(table, reports)
    got = new.collect()
    assert len(got) == len(rows) == len({r.case_id for r in got})
    by_set = collections.defaultdict(set)
    for r in got:
        by_set[r.set_id].add(r.split)
    assert all(len(s) == 1 for s in by_set.values())
    share = collections.Counter(r.split for r in got)
    assert all(abs(share[s] / len(got) - r) < 0.03 for s, r in splits.RATIOS.items())
    balance = {(r.label, r.split): r for r in splits.balance(new, splits.labels_of(table)).collect()}
    assert {label for label, _ in balance} == {None, "QC01", "QC02", "QC03", "QC09", "NEW"} and len(balance) == 18
    assert all(abs(r.share - r.wanted) < 0.1 for (label, _), r in balance.items() if label in ("QC01", "QC02", "QC03", "NEW"))
    assert balance[None, "train"].cases == share["train"] and balance["QC09", "test"].cases == 0


def test_filling_is_where_one_after_the_other_leads():
    need, want = {"a": 70.0, "b": 15.0, "c": 15.5}, collections.Counter()
    for _ in range(2000):
        s = max(need, key=lambda x: need[x] - want[x])
        want[s] += 0.03
    assert all(abs(q - want[s]) < 0.1 for s, q in splits.fill(need, 60.0))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z2"), (None, "z1"), ("z2", "z1")], "a string, b string")
    roots = {r.node: r.root for r in splits.components(edges).collect()}
    assert {roots[f"n{i:03}"] for i in range(61)} == {"n000"} and roots["z2"] == "z1" and len(roots) == 63


def test_empty_tables(spark, cases, reports):
    none, no_reports = spark.createDataFrame([], CASE), spark.createDataFrame([], REPORT)
    assert splits.torn(splits.related(none, reports)).count() == 0
    assert splits.assign(none, no_reports).count() == 0
    assert splits.related(cases, no_reports).count() == 31
