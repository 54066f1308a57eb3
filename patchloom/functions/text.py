"""Text and line functions as columns of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word pattern, stop words and domain lexicon of the token model.
WORD = r"[A-Za-z_][A-Za-z_0-9]*"
STOP_WORDS = tuple(
    "a an and are as at be by for from has have in is it its of on or that the to was were will with not this self "
    "none true false return def class if elif else try except finally while for".split()
)
LEXICON = tuple(
    "x y z h s sdg t tdg rx ry rz rzz rzx rxy sx cx ccx cnot cz swap cswap iswap ecr u u1 u2 u3 measure barrier qreg "
    "creg backend provider aer terra pulse schedule bind assign_parameters QuantumCircuit QuantumRegister "
    "ClassicalRegister Parameter ParameterVector DAGCircuit PassManager layout mapper transpile basis_gates "
    "optimization_level qasm dag pass CouplingMap AncillaAllocation NoiseModel Calibrations LayoutPass Unroller".split()
)
#: Words that never enter a seed query.
QUERY_STOP_WORDS = ("def", "class", "import", "return", "from", "if", "else", "raise", "assert", "self")
#: What ends a line: the breaks that Unicode's line model knows.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def lexicon() -> list[str]:
    """The lexicon as tokens are written, sorted."""
    return sorted({w.lower() for w in LEXICON})


def tokens(text: Column) -> Column:
    """Lower-case identifiers without stop words, in order and with repetitions; null for null."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def split_lines(text: Column) -> Column:
    """Lines without their ends; no empty line after a final break; an empty array for an empty text."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_range(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, inclusive) joined by line feeds."""
    return F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n")


def line_count(text: Column) -> Column:
    """Line feeds, and one more if the text doesn't end with one."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return breaks + F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common among all distinct elements; 1 if both are empty."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ == 0, 1.0).otherwise(both / any_)
