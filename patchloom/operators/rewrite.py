"""Rewrite rules for known defect patterns, as columns over arrays of lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_lines
from ..stages import keep
from .code import guarded

# What each rule looks for and puts in, in the order of application.
LINE_RULES = (
    ("R2", r"'local_statevector_simulator'", "'statevector_simulator'"),
    ("R2", r'"local_statevector_simulator"', '"statevector_simulator"'),
    ("R2", r"'local_qasm_simulator'", "'qasm_simulator'"),
    ("R2", r'"local_qasm_simulator"', '"qasm_simulator"'),
    ("R3", r"\.get_data\s*\(\s*[^\)]*\)", ".get_statevector()"),
    ("R4", r"\.iden\s*\(", ".id("),
)
EXECUTE = r"execute\s*\(\s*([A-Za-z_][A-Za-z_0-9]*)\s*,\s*(?:backend\s*=\s*)?([A-Za-z_][A-Za-z_0-9]*(?:\.[A-Za-z_][A-Za-z_0-9]*)?)(?:\s*,\s*[^)]*)?\)"
RUN = "$2.run(transpile($1, $2))"
OLD_ACCOUNT, NEW_ACCOUNT = "IBMQ.load_account(", "QiskitRuntimeService("
IMPORT = r"^\s*from\s+qiskit\s+import\s+(.+)"
AER_IMPORT = r"from\s+qiskit(_aer)?\s+import\s+.*\bAer\b|from\s+qiskit\.providers\.aer\s+import"
NEW_AER = "from qiskit_aer import Aer"
#: What a text must hold for any rule to matter.
ANY = r"local_(?:statevector|qasm)_simulator|\.get_data|\.iden|execute|IBMQ\.load_account\(|\bAer\b"
# Defect patterns by name, each looked for line by line.
DEFECTS = (
    ("DeprecatedExecuteAPI", r"\bexecute\s*\(\s*\w+\s*,\s*backend\s*="),
    ("LegacyBackendName", r"""['"]local_(?:statevector|qasm|unitary)_simulator['"]"""),
    ("GetDataMisuse", r"\.get_data\s*\("),
    ("IdenGateRename", r"\.iden\s*\("),
)
# Flags of an unchanged text; the last one holds only where AER_FROM is not imported.
FLAGS = (
    ("DeprecatedExecuteAPI", r"\bexecute\s*\(\s*\w+\s*,\s*backend\s*="),
    ("LegacyBackendName", r"""['"]local_statevector_simulator['"]"""),
    ("GetDataMisuse", r"\.get_data\s*\("),
    ("IdenGateRename", r"\.iden\s*\("),
    ("IBMQMigration", r"\bIBMQ\.load_account\s*\("),
    ("AerReferencedWithoutImport", r"\bAer\."),
)
AER_FROM = r"from\s+qiskit_aer\s+import\s+.*\bAer\b"
# What a fixture must show before, and must not show after.
AUDIT = (r"\.iden\s*\(", r"\blocal_\w+_simulator\b", r"\bexecute\s*\([^)]*backend\s*=", r"\.get_data\s*\(")


def input_flags(text: Column) -> list[Column]:
    """One boolean column for each flag: does the text show the defect?"""
    shown = {name: text.rlike(pattern) for name, pattern in FLAGS}
    shown["AerReferencedWithoutImport"] &= ~text.rlike(AER_FROM)
    return [F.coalesce(c, F.lit(False)).alias(name) for name, c in shown.items()]


def audit(before: Column, after: Column) -> Column:
    """Does a pair of texts show all audited patterns before and none after?"""
    all_before = [before.rlike(p) for p in AUDIT]
    none_after = [~after.rlike(p) for p in AUDIT]
    return reduce(lambda a, b: a & b, [*all_before, *none_after])


def _line_rules(x: Column) -> Column:
    for _, pattern, new in LINE_RULES:
        x = F.regexp_replace(x, pattern, new)
    return x


def _without_execute(x: Column) -> Column:
    names = F.transform(F.split(F.regexp_extract(x, IMPORT, 1), ","), lambda n: F.trim(n))
    left = F.filter(names, lambda n: n != "execute")
    new = F.when(F.size(left) > 0, F.concat(F.lit("from qiskit import "), F.array_join(left, ", "))).otherwise("")
    return F.when(x.rlike(IMPORT) & F.array_contains(names, "execute"), new).otherwise(x)


def rewritten(df: DataFrame, text: str, trace: bool = False) -> DataFrame:
    """df with patched, the text after all rules, and rules, the sorted distinct ones that changed it, and with a trace the lines after each step; a null text stays null without rules.

    Each step is a column of its own, so that none is evaluated twice; texts without
    anything that a rule looks for are passed over.
    """
    c = F.col
    out = df.withColumn("_lines", split_lines(c(text))).withColumn("_any", c(text).rlike(ANY))
    out = out.withColumn("_plain", F.when(c("_any"), F.transform("_lines", _line_rules)).otherwise(c("_lines")))
    out = out.withColumn("_run", F.when(c("_any"), F.transform("_plain", lambda x: F.regexp_replace(x, EXECUTE, RUN))).otherwise(c("_plain")))
    out = out.withColumn("_changed", c("_run") != c("_plain"))
    first = F.array_position(F.transform("_run", lambda x: x.rlike(r"from\s+qiskit\s+import\s+[^\n]+")), F.lit(True))
    out = out.withColumn("_at", F.when(c("_changed") & ~F.get("_run", F.lit(0)).contains("transpile"), first).otherwise(0))
    takes = lambda x: ~F.regexp_extract(x, r"from\s+qiskit\s+import\s+([^\n]+)", 1).contains("transpile")
    out = out.withColumn("_imported", F.when(c("_at") > 0, F.transform("_run", lambda x, i: F.when((i + 1 == c("_at")) & takes(x), F.concat(F.rtrim(x), F.lit(", transpile"))).otherwise(x))).otherwise(c("_run")))
    out = out.withColumn("_account", F.when(c("_any"), F.transform("_imported", lambda x: F.replace(x, F.lit(OLD_ACCOUNT), F.lit(NEW_ACCOUNT)))).otherwise(c("_imported")))
    out = out.withColumn("_bare", F.when(c("_any"), F.transform("_account", _without_execute)).otherwise(c("_account")))
    out = out.withColumn("_whole", F.array_join("_bare", "\n"))
    out = out.withColumn("_aer", c("_whole").rlike(r"\bAer\b") & ~c("_whole").rlike(AER_IMPORT))
    head = F.transform(F.slice("_bare", 1, 40), lambda x, i: F.when(x.startswith("import ") | x.startswith("from "), i + 1).otherwise(0))
    out = out.withColumn("_place", F.when(c("_aer"), F.coalesce(F.array_max(head), F.lit(0))))
    put = F.concat(F.slice("_bare", F.lit(1), c("_place")), F.array(F.lit(NEW_AER)), F.slice("_bare", c("_place") + 1, F.greatest(F.size("_bare") - c("_place"), F.lit(0))))
    fired = [(c("_any") & F.exists("_lines", _matches(p)), r) for r, p, _ in LINE_RULES]
    fired += [(c("_changed"), "R1"), (c("_any") & c(text).contains(OLD_ACCOUNT), "R5"), (c("_account") != c("_bare"), "R6"), (c("_aer"), "R7")]
    rules = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(hit, F.lit(r)) for hit, r in fired)))))
    patched = F.when(c("_aer"), F.array_join(put, "\n")).otherwise(c("_whole"))
    return out.select(*df.columns, patched.alias("patched"), rules.alias("rules"), *(TRACE if trace else ()))


#: The lines after each step, as `rewritten` gives them if asked, and the rule of each step; line stands for R2 to R4.
TRACE = ("_lines", "_plain", "_run", "_imported", "_account", "_bare", "_aer", "_place")
STEPS = (("line", "_lines", "_plain"), ("R1", "_plain", "_run"), ("R1", "_run", "_imported"), ("R5", "_imported", "_account"), ("R6", "_account", "_bare"))


def applied_lines(traced: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule, line, before, after: where each rule changed a line of texts rewritten with a trace; lines as they were numbered then. The traced stage is written once, so that no step is computed again for each comparison."""
    kept = keep(traced.select(*keys, *TRACE))
    both = lambda old, new: F.transform(F.zip_with(old, new, lambda x, y: F.struct(x.alias("before"), y.alias("after"))), lambda z, i: F.struct((i + 1).alias("line"), z["before"].alias("before"), z["after"].alias("after")))
    out = None
    for rule, old, new in STEPS:
        each = kept.select(*keys, F.lit(rule).alias("rule"), F.explode(F.filter(both(old, new), lambda r: r["before"] != r["after"])).alias("x")).select(*keys, "rule", "x.*")
        out = each if out is None else out.union(each)
    added = kept.where("_aer").select(*keys, F.lit("R7").alias("rule"), (F.col("_place") + 1).alias("line"), F.lit("").alias("before"), F.lit(NEW_AER).alias("after"))
    return out.union(added)


def rolled_back(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, kept, patched, rules of rewritten texts (keys, text, patched, rules): what can't be parsed any more goes back to the text without rules."""
    judged = guarded(df, keys, text, "patched").select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("parses").alias("kept"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    joined = df.join(judged, same)
    back = lambda new, old: F.when(F.col("kept"), F.col(new)).otherwise(old).alias(new)
    return joined.select(*keys, "kept", back("patched", F.col(text)), back("rules", F.array().cast("array<string>")))


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


def _named(name: str, pattern: str) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.when(x.rlike(pattern), F.struct(F.lit(name).alias("defect"), (i + 1).alias("line")))


def defect_lines(text: Column) -> Column:
    """Structs of defect and line for every line that shows a defect."""
    lines = split_lines(text)
    each = [F.transform(lines, _named(n, p)) for n, p in DEFECTS]
    none = F.array().cast("array<struct<defect:string,line:int>>")
    return F.when(text.rlike("|".join(p for _, p in DEFECTS)), F.filter(F.concat(*each), lambda x: x.isNotNull())).otherwise(none)
