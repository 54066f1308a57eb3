"""Texts with known defects, made from given texts: a template of snippets crossed with every text, each snippet in or out by a hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_lines

#: Name, lines with the defect, lines without it. A text gets those whose digit of the key's MD5 is below 8; the first snippet stands in every text.
SNIPPETS = (
    ("imports", ("from qiskit import QuantumCircuit, execute", "import numpy"), ("from qiskit import QuantumCircuit, transpile", "import numpy")),
    ("account", ("provider = IBMQ.load_account()",), ("provider = QiskitRuntimeService()",)),
    ("backend", ("device = Aer.get_backend('local_qasm_simulator')",), ("device = Aer.get_backend('qasm_simulator')",)),
    ("vector", ('device = get("local_statevector_simulator")',), ('device = get("statevector_simulator")',)),
    ("circuit", ("q = QuantumRegister(2)", "circ = QuantumCircuit(q)"), ("q = QuantumRegister(2)", "c = ClassicalRegister(2)", "circ = QuantumCircuit(q, c)")),
    ("identity", ("circ.iden(q[0])",), ("circ.id(q[0])",)),
    ("order", ("circ.cx(q[0], q[1])",), ("circ.cx(q[1], q[0])",)),
    ("mixed", ("bits = ClassicalRegister(2)", "circ.cx(bits, 1)"), ("bits = QuantumRegister(2)", "circ.cx(bits, 1)")),
    ("job", ("job = execute(circ, backend=device, shots=128)",), ("job = device.run(transpile(circ, device))",)),
    ("data", ("state = job.result().get_data(circ)",), ("state = job.result().get_statevector()",)),
    ("pass", ("def run(self, dag):", "    return dag"), ("def run(self, circuit):", "    return circuit")),
)


def _takes(key: Column, i: int) -> Column:
    return F.lit(True) if i == 0 else F.substring(F.md5(key), i, 1) < "8"


def defective(df: DataFrame, key: str, text: str) -> DataFrame:
    """df with before, after (the template's lines with and without defects, then the text's lines) and injected (names of the snippets); a null text counts as empty."""
    k, rest = F.col(key).cast("string"), split_lines(F.coalesce(F.col(text), F.lit("")))
    none = F.array().cast("array<string>")
    side = lambda n: F.array_join(F.concat(*(F.when(_takes(k, i), F.array(*map(F.lit, s[n]))).otherwise(none) for i, s in enumerate(SNIPPETS)), rest), "\n")
    names = F.array_compact(F.array(*(F.when(_takes(k, i), F.lit(s[0])) for i, s in enumerate(SNIPPETS))))
    return df.withColumn("before", side(1)).withColumn("after", side(2)).withColumn("injected", names)


def defective_sql(source: str, key: str, lines: str) -> str:
    """The same as a query over a source with key and lines (a list)."""
    quoted = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    takes = lambda i: "true" if i == 0 else f"substr(md5({key}::VARCHAR), {i}, 1) < '8'"
    side = lambda n: "flatten([" + ", ".join(f"CASE WHEN {takes(i)} THEN {quoted(s[n])} ELSE [] END" for i, s in enumerate(SNIPPETS)) + f", {lines}])"
    return f"(SELECT {key}, array_to_string({side(1)}, chr(10)) AS before, array_to_string({side(2)}, chr(10)) AS after FROM {source})"
