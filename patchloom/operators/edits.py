"""Line-range edits: which are allowed, what they make of a text, and checks that need no parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import split_lines

EDIT = "array<struct<file:string,start:int,end:int,replacement:string>>"


def filled(edits: Column) -> Column:
    """Edits with their defaults: start 1, end as start, file buggy.py, nothing to put in; null is no edit."""
    some = F.coalesce(edits, F.array().cast(EDIT))

    def fill(e: Column) -> Column:
        start = F.coalesce(e["start"], F.lit(1))
        return F.struct(F.coalesce(e["file"], F.lit("buggy.py")).alias("file"), start.alias("start"), F.coalesce(e["end"], start).alias("end"), F.coalesce(e["replacement"], F.lit("")).alias("replacement"))

    return F.transform(some, fill)


def in_region(edits: Column, allowed: Column) -> Column:
    """The edits that lie inside one of the allowed ranges (structs of lo and hi); the others are dropped."""
    return F.filter(filled(edits), lambda e: F.exists(allowed, lambda a: (e["start"] >= a["lo"]) & (e["end"] <= a["hi"])))


def apply_edits(text: Column, edits: Column) -> Column:
    """The text's lines after the edits, one after the other; later ranges are not moved by earlier edits, a start below 1 is 1, an end beyond the text its end."""

    def put(lines: Column, e: Column) -> Column:
        start = F.greatest(e["start"], F.lit(1))
        rest = F.greatest(F.size(lines) - F.greatest(e["end"], F.lit(0)), F.lit(0))
        return F.concat(F.slice(lines, 1, start - 1), split_lines(e["replacement"]), F.slice(lines, F.size(lines) - rest + 1, rest))

    return F.array_join(F.aggregate(filled(edits), split_lines(text), put), "\n")


def lines_touched(edits: Column) -> Column:
    """Lines that the edits' ranges cover, counted for each edit."""
    return F.aggregate(filled(edits), F.lit(0), lambda acc, e: acc + F.greatest(e["end"] - e["start"] + 1, F.lit(0)))


def size_change(edits: Column) -> Column:
    """Sum over edits of the difference in lines between what is put in and the range."""
    span = lambda e: F.greatest(e["end"] - e["start"] + 1, F.lit(0))
    return F.aggregate(filled(edits), F.lit(0), lambda acc, e: acc + F.abs(F.size(split_lines(e["replacement"])) - span(e)))


def common_ends(a: Column, b: Column) -> Column:
    """head, tail: how many lines two arrays of lines share at their start, and how many of the others at their end."""
    shortest = F.least(F.size(a), F.size(b))
    same = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
    until = lambda at: F.when(at == 0, shortest).otherwise(F.least((at - 1).cast("int"), shortest))
    head, tail = until(same(a, b)), until(same(F.reverse(a), F.reverse(b)))
    return F.struct(head.alias("head"), F.least(tail, shortest - head).alias("tail"))


def changed_lines(a: Column, b: Column, ends: Column) -> Column:
    """Lines of a, from 1, between the ends it shares with b that don't stand between b's ends; lines that are only put in change none."""
    middle = F.slice(b, ends["head"] + 1, F.greatest(F.size(b) - ends["head"] - ends["tail"], F.lit(0)))
    places = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)))
    return F.filter(places, lambda i: (i > ends["head"]) & (i <= F.size(a) - ends["tail"]) & ~F.array_contains(middle, F.get(a, i - 1)))


def has_overlap(edits: Column) -> Column:
    """Do two edits touch a line both? Such edits depend on their order."""
    e = filled(edits)
    return F.exists(F.sequence(F.lit(1), F.greatest(F.size(e), F.lit(1))), lambda i: F.exists(F.slice(e, i + 1, F.greatest(F.size(e) - i, F.lit(0))), lambda x: (x["start"] <= F.get(e, i - 1)["end"]) & (F.get(e, i - 1)["start"] <= x["end"])))


# Fixed values from here on: patterns and messages of the guards without a parser.
def registers(text: Column, kind: str) -> Column:
    """Names to which a register of the kind (Quantum or Classical) is assigned."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(\w+)\s*=\s*{kind}Register\("), F.lit(1)))


def register_mix(text: Column) -> Column:
    """The first call that takes a classical register for a quantum one, measure calls first; null if there is none."""
    some = F.when(text.contains("ClassicalRegister("), text)
    measured = F.array_intersect(F.regexp_extract_all(some, F.lit(r"measure\s*\(\s*([A-Za-z_]\w*)"), F.lit(1)), registers(some, "Classical"))
    pattern = r"(cx|cz|rz|rx|ry|swap)\s*\(\s*([A-Za-z_]\w*)"
    gates, names = F.regexp_extract_all(some, F.lit(pattern), F.lit(1)), F.regexp_extract_all(some, F.lit(pattern), F.lit(2))
    name = F.get(F.array_intersect(names, registers(some, "Classical")), F.lit(0))
    gate = F.get(gates, (F.array_position(names, name) - 1).cast("int"))
    say = lambda call, name: F.concat(call, F.lit("() uses classical register '"), name, F.lit("' as quantum"))
    return F.coalesce(say(F.lit("measure"), F.get(measured, F.lit(0))), say(gate, name))


def order_flip(before: Column, after: Column, ranges: Column) -> Column:
    """Do the edited ranges name q[0], q[1] before and q[1], q[0] after?"""

    def cut(text: Column) -> Column:
        lines = split_lines(text)
        parts = F.transform(ranges, lambda r: F.slice(lines, F.greatest(r["lo"], F.lit(1)), F.greatest(F.least(F.size(lines), F.greatest(r["lo"], r["hi"], F.lit(1))) - F.greatest(r["lo"], F.lit(1)) + 1, F.lit(0))))
        return F.array_join(F.flatten(parts), "\n")

    return cut(after).rlike(r"\bq\[\s*1\s*\]\s*,\s*q\[\s*0\s*\]") & cut(before).rlike(r"\bq\[\s*0\s*\]\s*,\s*q\[\s*1\s*\]")


def prf1(gold: Column, pred: Column) -> Column:
    """p, r, f1, gold_size, pred_size of two sets of lines; 0 where nothing is predicted or nothing is in common."""
    gold, pred = F.array_distinct(gold), F.array_distinct(pred)
    both = F.size(F.array_intersect(gold, pred))
    p, r = both / F.greatest(F.size(pred), F.lit(1)), both / F.greatest(F.size(gold), F.lit(1))
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))
    return F.struct(F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f1, 6).alias("f1"), F.size(gold).alias("gold_size"), F.size(pred).alias("pred_size"))
