from __future__ import annotations

import difflib
import json
import math
import random

import pytest
from patchloom.functions import tails
from patchloom.functions import text as T
from patchloom.operators import chunking, code, edits, proposals, ranks, retrieval, rewrite, statistics
from patchloom.sources import files, tables
from pyspark.sql import functions as F


def test_split_lines_is_the_unicode_model(spark):
    given = ["", "a", "a\n", "a\r\nb\rc", "\n\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "x\n\n", "é\n量", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = [r.x for r in df.select("i", T.split_lines(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [None if t is None else t.splitlines() for t in given]


@pytest.mark.parametrize(("text", "rules", "holds"), [
    ("from qiskit import execute, Aer\njob = execute(qc, backend=b, shots=5)\n", ["R1", "R6"], "job = b.run(transpile(qc, b))"),
    ("b = Aer.get_backend('local_qasm_simulator')", ["R2", "R7"], "from qiskit_aer import Aer\nb = Aer.get_backend('qasm_simulator')"),
    ("r.get_data(qc)\nqc.iden(q[0])", ["R3", "R4"], "r.get_statevector()\nqc.id(q[0])"),
    ("from qiskit import execute\nIBMQ.load_account()", ["R5", "R6"], "\nQiskitRuntimeService()"),
    ("print(1)", [], "print(1)"), ("", [], ""),
])
def test_rewrites(spark, text, rules, holds):
    r = rewrite.rewritten(spark.createDataFrame([(text, 1)], "t string, patched_by int"), "t").first()
    assert r.rules == rules and holds in r.patched


def test_rewrites_of_null(spark):
    r = rewrite.rewritten(spark.createDataFrame([(None,)], "t string"), "t").first()
    assert r.patched is None and not r.rules


def test_defect_lines(spark):
    df = spark.createDataFrame([("x\nexecute(qc, backend=b)\nr.get_data(q).iden(1)",), (None,), ("plain",)], "t string")
    got = [[(x.defect, x.line) for x in r[0] or []] for r in df.select(rewrite.defect_lines(F.col("t"))).collect()]
    assert got == [[("DeprecatedExecuteAPI", 2), ("GetDataMisuse", 3), ("IdenGateRename", 3)], [], []]


CIRCUIT = "from qiskit import *\nq = QuantumRegister(2)\nc = ClassicalRegister(2)\ncirc = QuantumCircuit(q, c)\n"


@pytest.mark.parametrize(("text", "rules"), [
    ("job.get_counts()", {"QC01"}), ("qq = QuantumCircuit(2)\nqq.measure_all()", {"QC02"}), ("job.run(1)", {"QC03"}), ("execute(a, backend=b)", {"QC04"}),
    ("backend = get('local_qasm_simulator')", {"QC05"}), ("r.get_data(1)", {"QC06"}), ("qc.h(0)", {"QC08"}), (CIRCUIT + "circ.h(5)", {"QC09"}), (CIRCUIT + "circ.foo(1)", {"QC10"}),
    (CIRCUIT + "circ.measure(q, c)", set()), ("x = 1", set()), ("", set()),
])
def test_findings(spark, text, rules):
    r = code.analysed(spark.createDataFrame([(1, text)], "k int, text string"), ["k"], "text").first()
    assert r.ast_ok and {f.rule for f in r.findings} == rules
    assert all(f.message == code.MESSAGES[f.rule] and f.severity == "warning" for f in r.findings)


def test_unparsable_text(spark):
    r = code.analysed(spark.createDataFrame([(1, "def f(:"), (2, None)], "k int, text string"), ["k"], "text").orderBy("k").collect()
    assert [(x.ast_ok, x.findings) for x in r] == [(False, []), (True, [])]
    assert code.facts_of("def f(:") is None and code.parse("a\x00b")[0] is None and code.api_drift("def f(:", "x") == 0


def test_touched_lines_and_minimal_edits_restore():
    rng = random.Random(2)
    for _ in range(80):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        b = [x for x in a if rng.random() > 0.2] + [rng.choice("xy")] * rng.randint(0, 2)
        ops = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        ta, tb = "\n".join(a), "\n".join(b)
        assert code.touched_lines(ta, tb) == [k for t, i, j, _, _ in ops if t in ("replace", "delete") for k in range(i + 1, j + 1)]
    assert code.change_counts("a\nb\nc", "a\nx\ny\nc\nd") == {"deleted": 0, "added": 1, "modified": 2}
    assert code.minimal_edits("a\nb", "a\nc") == [{"file": "buggy.py", "start": 2, "end": 2, "replacement": "c"}]


def test_guards(spark):
    df = spark.createDataFrame([(1, "def run(self, dag): pass", "def run(self, dag): return 1"), (2, "def run(self, dag): pass", "def run(self): pass"), (3, None, "x ="), (4, "x", None)], "k int, a string, b string")
    got = {r.k: (r.parses, r.interface_kept) for r in code.guarded(df, ["k"], "a", "b").collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, True), 4: (True, True)}
    mix = spark.createDataFrame([("c = ClassicalRegister(2)\nqc.cx(c, 1)\nmeasure(c)",), ("c = ClassicalRegister(2)\nqc.cx(c, 1)",), ("q = QuantumRegister(1)\nqc.cx(q)",), (None,)], "t string")
    assert [r[0] and r[0][:8] for r in mix.select(edits.register_mix(F.col("t"))).collect()] == ["measure(", "cx() use", None, None]
    flip = spark.createDataFrame([("cx(q[0], q[1])", "cx(q[1], q[0])", 1), ("cx(q[0], q[1])", "cx(q[1], q[0])", 2)], "a string, b string, lo int")
    ranges = F.array(F.struct(F.col("lo"), F.col("lo").alias("hi")))
    assert [r[0] for r in flip.select(edits.order_flip(F.col("a"), F.col("b"), ranges)).collect()] == [True, False]


def apply(text, changes):
    lines = text.splitlines()
    for s, e, new in changes:
        s = max(1, s)
        lines = lines[: s - 1] + new.splitlines() + lines[e:]
    return "\n".join(lines)


def test_edits_are_applied_in_order(spark):
    given = [("a\nb\nc\nd", [(2, 3, "X\nY\nZ"), (1, 1, "")]), ("a\nb", [(5, 9, "tail")]), ("a\nb", [(0, 0, "top")]), ("", [(1, 1, "x")]), ("a\nb\nc", [(3, 2, "mid")]), ("a", [])]
    rows = [(i, t, [("f", *c) for c in changes]) for i, (t, changes) in enumerate(given)]
    df = spark.createDataFrame(rows, f"i int, t string, e {edits.EDIT}")
    got = [r.x for r in df.select("i", edits.apply_edits(F.col("t"), F.col("e")).alias("x")).orderBy("i").collect()]
    assert got == [apply(t, c) for t, c in given]


def test_regions_and_sizes(spark):
    df = spark.createDataFrame([([("f", 2, 3, "x\ny\nz"), ("f", 1, 9, "q"), (None, 4, None, None)],)], f"e {edits.EDIT}")
    kept = df.select(edits.in_region(F.col("e"), F.expr("array(struct(1 as lo, 4 as hi))")).alias("k"), edits.lines_touched(F.col("e")).alias("n"), edits.size_change(F.col("e")).alias("c"), edits.has_overlap(F.col("e")).alias("o")).first()
    assert [(k.file, k.start, k.end) for k in kept.k] == [("f", 2, 3), ("buggy.py", 4, 4)] and (kept.n, kept.c, kept.o) == (12, 1 + 8 + 1, True)


def test_prf1(spark):
    r = spark.createDataFrame([([1, 2, 3], [2, 3, 4, 4]), ([], []), ([1], [])], "g array<int>, p array<int>").select(edits.prf1(F.col("g"), F.col("p")).alias("x")).select("x.*").collect()
    assert (r[0].p, r[0].r, r[0].f1) == (0.666667, 0.666667, 0.666667) and (r[1].f1, r[2].f1) == (0, 0)


def test_touched_lines_of_inserts_and_deletes(spark):
    """Lines after an insert or a delete are not touched."""
    a = "one\ntwo\nthree\nfour"
    cases = [  # after, made, then p, r, f1, lines of gold and pred
        ("zero\n" + a, a.replace("two", "2"), (0.0, 0.0, 0.0, 0, 1)),
        ("one\nthree\nfour", "one\n2\nthree\nfour", (1.0, 1.0, 1.0, 1, 1)),
        ("one\n2\nthree\n4", "three\nfour", (0.5, 0.5, 0.5, 2, 2)),
        ("1\n2\nthree\nfour", "one\n2\nfour", (0.5, 0.5, 0.5, 2, 2)),
        ("one", "", (0.0, 0.0, 0.0, 3, 0)),
        (a, a + "\nfive", (0.0, 0.0, 0.0, 0, 0)),
    ]
    df = spark.createDataFrame([(i, a, b, c) for i, (b, c, _) in enumerate(cases)], "i int, a string, b string, c string")
    got = code.touched_sets(df, ["i"], "a", "b", "c").select("i", edits.prf1(F.col("gold"), F.col("pred")).alias("x")).select("i", "x.*").collect()
    assert {r.i: tuple(r)[1:] for r in got} == {i: want for i, (_, _, want) in enumerate(cases)}


def test_published_statistics():
    assert tails.wilcoxon_exact_sf(5, 15) == pytest.approx(0.03125)
    assert 2 * tails.t_sf(2.2647, 11) == pytest.approx(0.0447199, abs=2e-5)
    assert tails.sign_test(5, 0) == pytest.approx(0.0625) and tails.sign_test(0, 0) is None


def test_paired_statistics_without_rows_and_with_ties(spark):
    none = spark.createDataFrame([], "case_id string, a double, b double, diff double")
    assert statistics.summary(none).first().n == 0 and statistics.cliffs_delta(none).first().delta is None
    assert statistics.wilcoxon(none, "case_id").first().z is None and statistics.leave_one_out(none, "case_id").count() == 0
    tied = spark.createDataFrame([(str(i), 0.5, 0.5, 0.0) for i in range(4)], none.schema)
    assert statistics.summary(tied).first().t is None and statistics.wilcoxon(tied, "case_id").first().n == 0


def test_hash_order_is_a_permutation_whatever_the_partitions(spark):
    df = spark.createDataFrame([(f"c{i}",) for i in range(500)], "k string")
    a = {r.k: (r.rank, r.split) for r in ranks.ratio_split(df.repartition(1), "k").collect()}
    b = {r.k: (r.rank, r.split) for r in ranks.ratio_split(df.repartition(7), "k").collect()}
    assert a == b and sorted(r for r, _ in a.values()) == list(range(1, 501)) and sum(s == "train" for _, s in a.values()) == 350
    assert ranks.percent_subset(df, "k", 1).count() == 5 and ranks.percent_subset(df.limit(3), "k", 1).count() == 1
    with pytest.raises(ValueError):
        ranks.percent_subset(df, "k", 0)


def test_syntax_chunks(spark):
    df = spark.createDataFrame([("r", "a.py", "class A:\n    def f(self):\n        pass\n\nasync def g(): pass\n"), ("r", "b.py", "x ="), ("r", "c.py", ""), ("r", "d.py", None)], "repo string, path string, text string")
    got = [(r.path, r.symbol, r.kind, r.start_line, r.end_line) for r in chunking.syntax_chunks(df, "repo", "path", "text").orderBy("path", "start_line").collect()]
    assert got == [("a.py", "A", "class", 1, 3), ("a.py", "f", "function", 2, 3), ("a.py", "g", "function", 5, 5), ("b.py", "<module>", "module", 1, 1)]


def test_bm25_is_the_formula(spark):
    docs = [("a", "cat sat mat cat"), ("b", "cat dog"), ("c", ""), ("d", "bird " * 9)]
    d = retrieval.documents(spark.createDataFrame(docs, "k string, t string"), "k", F.col("t"))
    q = spark.createDataFrame([(1, "cat"), (1, "cat"), (1, "dog"), (1, "none")], "q int, term string")
    got = {r.k: r.score for r in retrieval.bm25(q, d, "q", "k").collect()}
    n, avg = 4, (4 + 2 + 0 + 9) / 4
    one = lambda tf, df, dl: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == pytest.approx({"a": 2 * one(2, 2, 4), "b": 2 * one(1, 2, 2) + one(1, 1, 2)})


def test_replies_and_attempts(spark):
    good = json.dumps({"edits": [{"file": "f", "start": 2, "end": 2, "replacement": "x"}], "rationale": "r"})
    far = json.dumps({"edits": [{"start": 50}]})
    rows = [("a", 1, "no json"), ("a", 2, f"Sure:\n```json\n{good}\n```"), ("a", 3, far), ("b", 1, far), ("c", 1, None), ("d", 4, good)]
    df = spark.createDataFrame([(c, n, r, [(1, 5)]) for c, n, r in rows], "case string, attempt int, raw string, allowed array<struct<lo:int,hi:int>>")
    got = {r.case: (r.attempt, len(r.edits), r.no_op) for r in proposals.accepted(df, "case").collect()}
    assert got == {"a": (2, 1, False), "b": (1, 0, True)}
    m = spark.createDataFrame([(1, 1, "user", "hi"), (1, 0, "system", "be brief"), (1, 2, "assistant", None)], "c int, t int, role string, content string")
    assert proposals.chat(m, "c", "t").first().prompt == "be brief\nUSER:\nhi\nASSISTANT:\n\nASSISTANT:"


def test_files(spark, tmp_path):
    for case, texts in {"g1/a": {"buggy.py": b"x = 1", "fix.py": b"old", "fixed.py": "né\n".encode()}, "g1/b": {"buggy.py": b" \n", "fix.py": b"y"}, "g2/c": {"buggy.py": b"\xff\xfez"}, "g2/d": {"buggy.py": b"q", "fix.py": b"w"}}.items():
        (tmp_path / "cases" / case).mkdir(parents=True)
        for name, raw in texts.items():
            (tmp_path / "cases" / case / name).write_bytes(raw)
    got = files.discover_cases(spark, str(tmp_path / "cases"), excluded=("g2/d",)).collect()
    assert [(r.case_id, r.grp, r.fixed_src) for r in got] == [("g1/a", "g1", "né\n")]
    assert files.discover_cases(spark, str(tmp_path / "cases"), need_fix=False).count() == 4
    for k, doc in enumerate([{"train_ids": ["a"], "val_ids": ["b"], "test_ids": []}, {"splits": {"train": ["a"], "val": ["b"]}}, {"train": ["a"], "val": ["b"], "n": 2}]):
        (tmp_path / f"s{k}.json").write_text(json.dumps(doc))
        members = files.split_members(spark, str(tmp_path / f"s{k}.json"))
        assert {tuple(r) for r in members.collect()} == {("a", "train"), ("b", "val")}
    kept, lost = files.only_split(spark.createDataFrame([("z",)], "case_id string"), members, "train")
    assert kept.count() == 0 and lost.first().case_id == "a"
    (tmp_path / "r.csv").write_text("case,method,lines_f1\na,m,0.5\nb,m,oops\n")
    assert [r.lines_f1 for r in files.read_results(spark, str(tmp_path / "r.csv")).collect()] == [0.5, None]
    with pytest.raises(ValueError):
        files.read_results(spark, str(tmp_path / "r.csv"), ("case", "nothing"))
    files.write_csv(members.limit(0), str(tmp_path / "out"))
    assert "| a | train |" in files.markdown(members.where("case_id = 'a'"), "Members")


def test_search_is_the_brute_force(spark):
    """Ties, repeated terms, boosts, queries without terms and documents without tokens."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    docs = [(f"d{i:03}", " ".join(rng.choice(words[: 1 + i % 12]) for _ in range(rng.randint(0, 9)))) for i in range(160)] + [("e1", None), ("e2", "qasm qasm qasm pulse")]
    d = retrieval.documents(spark.createDataFrame(docs, "k string, t string"), "k", F.col("t"))
    asked = [(q, rng.choice(words)) for q in range(6) for _ in range(4)]
    ids = spark.createDataFrame([(q,) for q in range(7)], "q int")
    terms = spark.createDataFrame(asked, "q int, term string")
    for boost in (None, retrieval.lexicon_boost()):
        got = {(r.q, r.pool_rank): (r.k, round(r.score, 9)) for r in retrieval.search(ids, terms, d, "q", "k", 5, boost).collect()}
        scores = {(r.q, r.k): r.score for r in retrieval.bm25(terms, d, "q", "k").collect()}
        own = {r.k: r.b for r in d.select("k", (boost if boost is not None else F.lit(0.0)).alias("b")).collect()}
        for q in range(7):
            best = sorted(((round(scores.get((q, k), 0.0) + own[k], 9), k) for k, _ in docs), reverse=True)[:5]
            assert [got[q, i + 1] for i in range(5)] == [(k, s) for s, k in best]


def test_latest_texts_moves_only_repeated_keys(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", None, "p"), (None, 1, "n1"), (None, 2, "n2"), ("c", 1, None), ("t", 5, "u"), ("t", 5, "v")]
    df = spark.createDataFrame(rows, "k string, ingested_at int, text string")
    got = {r.k: r.text for r in tables.latest_texts(df, ["k"], ["text"]).collect()}
    assert got == {r.k: r.text for r in tables.latest(df, ["k"], ["text"]).collect()} and got["a"] == "y" and got[None] == "n2" and len(got) == 5
    assert tables.latest_texts(df.limit(0), ["k"], ["text"]).count() == 0


def test_shared_ends_and_changed_lines(spark):
    cases = [("a b c", "a x c", (1, 1), [2]), ("a b c", "a b c", (3, 0), []), ("a c", "a b c", (1, 1), []), ("a a", "a", (1, 0), [2]), ("a", "b c", (0, 0), [1]), ("a b c d", "a c b d", (1, 1), [])]
    df = spark.createDataFrame([(x.split(), y.split()) for x, y, *_ in cases], "a array<string>, b array<string>").withColumn("e", edits.common_ends(F.col("a"), F.col("b")))
    got = [((r.e.head, r.e.tail), r.c) for r in df.withColumn("c", edits.changed_lines(F.col("a"), F.col("b"), F.col("e"))).collect()]
    assert got == [(ends, lines) for *_, ends, lines in cases]


def test_roll_back_of_what_does_not_parse(spark):
    good, bad = "from qiskit import execute\njob = execute(qc, backend=b)", "x = (\njob = execute(qc, backend=b)"
    df = rewrite.rewritten(spark.createDataFrame([(1, good), (2, bad)], "k int, text string"), "text", trace=True)
    out = {r.k: (r.kept, r.patched, r.rules) for r in rewrite.rolled_back(df.select("k", "text", "patched", "rules"), ["k"], "text").collect()}
    assert out[1][0] and out[1][2] == ["R1", "R6"] and out[2] == (False, bad, [])
    lines = {(r.k, r.rule, r.line): r.after for r in rewrite.applied_lines(df, ["k"]).collect()}
    assert lines[1, "R1", 2] == "job = b.run(transpile(qc, b))" and lines[1, "R6", 1] == "from qiskit import transpile"


def test_exact_flips_and_sizes(spark):
    pairs = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 0.0), ("c", -1.0)], "g string, diff double")
    assert {r.g: (r.n, r.p_one, r.p_two) for r in statistics.exact_flips(pairs, "g").collect()} == {"a": (3, 0.125, 0.25), "c": (1, 1.0, 1.0)}
    many = spark.createDataFrame([(f"k{i}", float(i)) for i in range(20)], "k string, diff double")
    assert {r.k: r.ratios for r in statistics.ratio_sizes(many, ("70/15/15", "80/10/10", "74/13/13", "99/1/0")).collect()} == {3: "70/15/15, 74/13/13", 2: "80/10/10", 1: "99/1/0"}
    drawn = statistics.shuffled(many, "k", 30).groupBy("it").agg(F.collect_set("k").alias("ks"), F.max("rank").alias("last")).collect()
    assert len(drawn) == 30 and all(len(r.ks) == 20 == r.last for r in drawn)
    assert statistics.bootstrap(many, "k", 30).count() == 30


def test_general_selection_starts_like_the_pair(spark):
    rng = random.Random(8)
    rows = []
    for q in range(25):
        scores = sorted((round(rng.random() * 9, 3) for _ in range(12)), reverse=True)
        for r, s in enumerate(scores, 1):
            start = rng.randint(1, 30)
            rows.append((q, r, s, 0.0, f"f{rng.randint(0, 2)}", rng.choice(["a", "b", None]), start, start + rng.randint(0, 12)))
    pool = spark.createDataFrame(rows, "q int, pool_rank int, score double, re_score double, file string, symbol string, start int, end int")
    two = {(r.q, r.sel): r.pool_rank for r in retrieval.select_two(pool, "q").collect()}
    k = {(r.q, r.sel): r.pool_rank for r in retrieval.select_k(pool, "q", 4).collect()}
    assert {x: k[x] for x in two} == two and len(k) == 100


def test_pools_merge_and_refill(spark):
    schema = "q int, pool_rank int, file string, start int, end int"
    a = spark.createDataFrame([(1, 1, "x", 1, 2), (1, 2, "donor:y", 1, 2)], schema)
    b = spark.createDataFrame([(1, 1, "x", 1, 2), (1, 2, "z", 1, 2)], schema)
    merged = retrieval.merge_pools([a, b], "q")
    assert [(r.file, r.pool_rank) for r in merged.orderBy("pool_rank").collect()] == [("x", 1), ("donor:y", 2), ("z", 3)]
    assert [(r.file, r.sel) for r in retrieval.own_files(merged, "q", 2).orderBy("sel").collect()] == [("x", 1), ("z", 2)]


def test_diffs(spark):
    df = spark.createDataFrame([(1, "a\nb", "a\nc\nd"), (2, None, "x"), (3, "same", "same")], "k int, a string, b string")
    got = {r.k: (r.diff.count("\n+"), r.edits, r.rows) for r in code.diffs(df, ["k"], "a", "b").collect()}
    assert got == {1: (3, 1, 3), 2: (2, 1, 1), 3: (0, 0, 1)}
