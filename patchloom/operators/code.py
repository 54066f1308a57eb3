"""What needs a parser or a sequence comparison: Arrow tasks around ast and difflib.

Texts are parsed, never run. Null texts count as empty. A text that can't be
parsed, for whatever reason, has no signatures and fails the syntax guard.
"""

from __future__ import annotations

import ast
import difflib
import re
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK

_BREAK = re.compile(LINE_BREAK)

# Calls known on circuits, other known attributes, calls whose integer arguments are qubits, outdated backends.
GATES = frozenset(
    "x y z h s sdg t tdg rx ry rz rxx ryy rzz rzx sx sxdg p u u1 u2 u3 cx cy cz ch cp crx cry crz ccx cnot cswap swap iswap ecr measure measure_all "
    "measure_active reset barrier initialize append compose draw decompose assign_parameters bind_parameters copy depth width size count_ops qasm iden id "
    "mcx mct delay unitary global_phase if_test while_loop for_loop switch".split()
)
ATTRIBUTES = frozenset("data definition name num_qubits num_clbits qubits clbits parameters params".split())
INDEXED = frozenset("h x y z rx ry rz measure cx cz swap".split())
OLD_BACKENDS = frozenset("local_statevector_simulator local_qasm_simulator local_unitary_simulator ibmq_qasm_simulator".split())


def lines_of(text: str) -> list[str]:
    lines = _BREAK.split(text)
    return lines[:-1] if lines[-1] == "" else lines


def parse(text: str) -> tuple[ast.Module | None, str | None]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text), None
    except SyntaxError as e:
        return None, f"SyntaxError: {e.msg} at line {e.lineno}"
    except (ValueError, RecursionError, MemoryError) as e:
        return None, f"{type(e).__name__}: {e}"


def opcodes(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    return difflib.SequenceMatcher(None, lines_of(a), lines_of(b), autojunk=False).get_opcodes()


def touched_lines(a: str, b: str) -> list[int]:
    """Lines of a, from 1, that b replaces or lacks; lines that are only put in touch none."""
    return [k for tag, i, j, _, _ in opcodes(a, b) if tag in ("replace", "delete") for k in range(i + 1, j + 1)]


def change_counts(a: str, b: str) -> dict:
    """deleted, added, modified lines; a replaced stretch counts as long as the longer side."""
    out = {"deleted": 0, "added": 0, "modified": 0}
    for tag, i, j, k, n in opcodes(a, b):
        if tag != "equal":
            out[{"delete": "deleted", "insert": "added", "replace": "modified"}[tag]] += max(j - i, n - k)
    return out


def minimal_edits(a: str, b: str) -> list[dict]:
    """Line-range edits that lead from a to b; what is put in replaces the line after it."""
    new, out = lines_of(b), []
    blocks = difflib.SequenceMatcher(None, lines_of(a), new, autojunk=False).get_matching_blocks()
    at = put = 0
    for m in blocks:
        if m.a > at or m.b > put:
            out.append({"file": "buggy.py", "start": at + 1, "end": max(at + 1, m.a), "replacement": "\n".join(new[put : m.b])})
        at, put = m.a + m.size, m.b + m.size
    return out


def unified(a: str, b: str, context: int = 2) -> list[str]:
    return list(difflib.unified_diff(lines_of(a), lines_of(b), "before", "after", lineterm="", n=context))


def side_by_side(a: str, b: str) -> list[dict]:
    """Rows of kind, left, right (line numbers from 1, or none) for a display beside each other."""
    rows = []
    for tag, i, j, k, n in difflib.SequenceMatcher(None, lines_of(a), lines_of(b)).get_opcodes():
        for step in range(max(j - i, n - k)):
            rows.append({"kind": tag, "left": i + step + 1 if i + step < j else None, "right": k + step + 1 if k + step < n else None})
    return rows


def interfaces(text: str) -> set[tuple[str, ...]]:
    """Positional arguments of every plain function named run."""
    tree, _ = parse(text)
    return {tuple(a.arg for a in n.args.args) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef) and n.name == "run"} if tree else set()


def api_drift(a: str, b: str) -> float:
    """One minus the Jaccard similarity of the functions (with their numbers of arguments) and classes; 0 without any."""

    def names(text: str) -> set[tuple]:
        tree, _ = parse(text)
        functions = {("f", n.name, len(n.args.args)) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)} if tree else set()
        return functions | ({("c", n.name, 0) for n in ast.walk(tree) if isinstance(n, ast.ClassDef)} if tree else set())

    x, y = names(a), names(b)
    return 1 - len(x & y) / len(x | y) if x | y else 0.0


FACT = "struct<kind:string,line:int,target:string,chain:string,ints:array<int>,texts:array<string>,names:array<string>,backend:string,args:int>"


def facts_of(text: str) -> list[dict] | None:
    """What a text states, in the parser's order: names bound, calls, attributes of plain names; None where it can't be parsed. Judging them is left to the rules."""
    tree, _ = parse(text)
    if tree is None:
        return None
    constants = lambda nodes, kind: [n.value for n in nodes if isinstance(n, ast.Constant) and type(n.value) is kind and (kind is str or abs(n.value) < 1 << 31)]
    out: list[dict] = []

    def state(kind: str, line: int, target: str | None, call: ast.AST | None) -> None:
        args = call.args if isinstance(call, ast.Call) else []
        given = [k.value for k in call.keywords if k.arg == "backend"] if isinstance(call, ast.Call) else []
        chain = ast.unparse(call.func) if isinstance(call, ast.Call) else None
        out.append({
            "kind": kind, "line": line, "target": target, "chain": chain, "ints": constants(args, int), "texts": constants(args, str),
            "names": [a.id for a in args if isinstance(a, ast.Name)], "backend": next(iter(constants(given, str)), None), "args": len(args),
        })

    for n in ast.walk(tree):
        if isinstance(n, ast.Assign):
            for t in n.targets:
                if isinstance(t, ast.Name):
                    state("bound", n.lineno, t.id, n.value)
        elif isinstance(n, ast.Call):
            state("call", n.lineno, n.func.value.id if isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) else None, n)
        elif isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name):
            state("attribute", n.lineno, n.value.id, None)
    return out


def per_row(df: DataFrame, keys: list[str], texts: list[str], make: Callable[..., dict], schema: str) -> DataFrame:
    """keys and the columns of `schema`, which `make` gives for the texts of a row; null texts are passed as empty."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [make(*t) for t in batch[[f"_{k}" for k in range(len(texts))]].itertuples(index=False, name=None)]
            out = batch[keys].copy()
            for n in names:
                out[n] = pd.Series([r[n] for r in rows], index=out.index, dtype=object)
            yield out

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    given = df.select(*keys, *(F.coalesce(F.col(t), F.lit("")).alias(f"_{k}") for k, t in enumerate(texts)))
    return given.mapInPandas(run, f"{kinds}, {schema}")


def compared(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """keys, ast_ok, parse_error (of after), drift, deleted, added, modified, touched (array of lines of before)."""

    def make(a: str, b: str) -> dict:
        tree, error = parse(b)
        return {"ast_ok": tree is not None, "parse_error": error, "drift": round(api_drift(a, b), 6), "touched": touched_lines(a, b), **change_counts(a, b)}

    return per_row(df, keys, [before, after], make, "ast_ok boolean, parse_error string, drift double, touched array<int>, deleted int, added int, modified int")


def touched_sets(df: DataFrame, keys: list[str], before: str, after: str, made: str) -> DataFrame:
    """keys, gold, pred: lines of before that after touches and that the made text touches; an empty made text touches none."""

    def make(a: str, b: str, c: str) -> dict:
        return {"gold": touched_lines(a, b), "pred": touched_lines(a, c) if c else []}

    return per_row(df, keys, [before, after, made], make, "gold array<int>, pred array<int>")


def diffs(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """keys, diff (a unified diff with two lines of context, as one text), edits (how many minimal edits lead from before to after), rows (of a display side by side)."""

    def make(a: str, b: str) -> dict:
        return {"diff": "\n".join(unified(a, b)), "edits": len(minimal_edits(a, b)), "rows": len(side_by_side(a, b))}

    return per_row(df, keys, [before, after], make, "diff string, edits int, rows int")


#: What each rule reports (fixed values).
MESSAGES = {
    "QC01": "counts are read but nothing is measured", "QC02": "a circuit without classical bits is measured", "QC03": "a job is run without a backend",
    "QC04": "execute is deprecated", "QC05": "outdated backend name", "QC06": "get_data is no result method", "QC08": "a name is used that nothing is bound to",
    "QC09": "an index lies beyond a register", "QC10": "no such gate",
}


def analysed(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, ast_ok, findings (array of rule, line, message, severity): the static rules as filters over the facts of each text.

    A text that can't be parsed has no findings and ast_ok false. Rules of single
    calls come first, in the order of their lines, then those of the whole text.
    """
    c = F.col
    given = per_row(df.withColumn("_named", c(text).rlike(r"backend\s*=")), [*keys, "_named"], [text], lambda t: {"facts": facts_of(t)}, f"facts array<{FACT}>")
    tail = lambda f: F.element_at(F.split(f["chain"], r"\."), -1)
    of = lambda kind, test: F.filter("facts", lambda f: (f["kind"] == kind) & F.coalesce(test(f), F.lit(False)))
    made = lambda ending: of("bound", lambda f: f["chain"].endswith(ending))
    sized = F.filter(made("QuantumRegister"), lambda f: F.size(f["ints"]) > 0)
    out = given.withColumn("_sizes", F.transform(sized, lambda f: f["ints"][0])).withColumn("_circuits", made("QuantumCircuit"))
    out = out.withColumn("_classical", F.transform(F.filter(made("ClassicalRegister"), lambda f: F.size(f["ints"]) > 0), lambda f: f["target"]))
    out = out.withColumn("_on", F.transform("_circuits", lambda f: f["target"])).withColumn("_bound", F.transform(of("bound", lambda f: F.lit(True)), lambda f: f["target"]))
    out = out.withColumn("_tails", F.transform(of("call", lambda f: F.lit(True)), tail))
    found = lambda rule, facts: F.transform(facts, lambda f: F.struct(F.lit(rule).alias("rule"), f["line"].alias("line")))
    once = lambda rule, test: F.when(test, F.array(F.struct(F.lit(rule).alias("rule"), F.lit(1).alias("line")))).otherwise(F.array().cast("array<struct<rule:string,line:int>>"))
    measured = F.arrays_overlap("_tails", F.array(*map(F.lit, ("measure", "measure_all", "measure_active"))))
    executes = of("call", lambda f: (tail(f) == "execute") & (f["chain"].contains("qiskit") | (f["chain"] == "execute")))
    old = [F.lit(x) for x in sorted(OLD_BACKENDS)]
    outdated = of("call", lambda f: f["backend"].isin(*old) | F.arrays_overlap(f["texts"], F.array(*old)))
    on_circuit = lambda test: of("call", lambda f: F.array_contains("_on", f["target"]) & test(f))
    unknown = on_circuit(lambda f: ~tail(f).startswith("_") & ~tail(f).isin(*sorted(GATES | ATTRIBUTES)))
    beyond = on_circuit(lambda f: tail(f).isin(*sorted(INDEXED)) & F.exists(f["ints"], lambda i: F.exists("_sizes", lambda n: i >= n)))
    single = F.array_sort(F.concat(*(found(r, f) for r, f in (("QC04", executes), ("QC05", outdated), ("QC06", of("call", lambda f: tail(f) == "get_data")), ("QC09", beyond), ("QC10", unknown)))),
        lambda x, y: F.when(x["line"] < y["line"], -1).when(x["line"] > y["line"], 1).when(x["rule"] < y["rule"], -1).when(x["rule"] > y["rule"], 1).otherwise(0))
    bare = F.filter("_circuits", lambda f: ~(((f["args"] >= 2) & (F.size(f["ints"]) > 0)) | F.arrays_overlap(f["names"], F.col("_classical"))))
    backend = F.exists(of("bound", lambda f: F.lit(True)), lambda f: (F.lower(f["target"]) == "backend") | F.coalesce(F.lower(f["chain"]).contains("backend"), F.lit(False)))
    loose = F.filter("facts", lambda f: (f["kind"] == "attribute") & f["target"].isin("qc", "qr", "cr", "circuit") & ~F.array_contains("_bound", f["target"]))
    whole = F.concat(
        once("QC01", F.array_contains("_tails", "get_counts") & ~measured), F.when(measured, F.transform(bare, lambda f: F.struct(F.lit("QC02").alias("rule"), F.lit(1).alias("line")))).otherwise(once("", F.lit(False))),
        once("QC03", ((F.size(executes) > 0) | F.array_contains("_tails", "run")) & ~backend & ~c("_named")), found("QC08", F.slice(loose, 1, 1)),
    )
    message = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
    findings = F.transform(F.concat(single, whole), lambda x: F.struct(x["rule"].alias("rule"), x["line"].alias("line"), message[x["rule"]].alias("message"), F.lit("warning").alias("severity")))
    return out.select(*keys, c("facts").isNotNull().alias("ast_ok"), F.coalesce(findings, F.array().cast("array<struct<rule:string,line:int,message:string,severity:string>>")).alias("findings"))


def guarded(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """keys, parses, parse_error, interface_kept: the guards that need a parser; a text without a run function has no interface to keep."""

    def make(a: str, b: str) -> dict:
        old, (tree, error) = interfaces(a), parse(b)
        return {"parses": tree is not None, "parse_error": error, "interface_kept": not old or old == interfaces(b)}

    return per_row(df, keys, [before, after], make, "parses boolean, parse_error string, interface_kept boolean")
