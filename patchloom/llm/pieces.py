"""Problem 4: oversized texts in pieces, cut at natural boundaries.

One bounded regular expression consumes a text from cut to cut: its alternatives
stand in the order of the boundary's strength (end of text, blank line, line end,
any character), each greedy up to the limit. Where a stronger boundary lies in
the upper part of the target range it is taken, which leaves room for the lines
that a piece shares with the one before. The expression runs over a copy of the
text, as long as it, in which every character of a blank line is a mark, so that
one character on either side tells a boundary and nothing is looked for far
behind. How strong a cut is, is read off the marks around it. Offsets and shared
lines are array functions; no text leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP_LINES = 2400, 5
#: What stands for a character of a blank line: a code point that is never assigned to a character. A blank is any white space but a line feed.
MARK = "\ufdd0"
_BLANK = r"[\p{IsWhite_Space}\x1c-\x1f\ufdd0&&[^\n]]"
#: One blank after the other from the start of a line of which the rest is blank.
_OF_BLANK_LINE = rf"(?:(?<![^\n])(?={_BLANK}++(?:\n|\z))|\G(?!\A)){_BLANK}"


def marked(text: Column) -> Column:
    """The text with marks in its blank lines, as long as it was."""
    return F.when(text.rlike(rf"(?:\A|\n){_BLANK}++(?:\n|\z)"), F.regexp_replace(text, _OF_BLANK_LINE, MARK)).otherwise(text)


def cut_pattern(limit: int = LIMIT) -> str:
    """The expression whose matches in a marked text, one after the other, are what lies between cuts. No alternative tries a place that one before it has tried."""
    blank = rf"(?:(?<=\n)(?:(?<=[\n{MARK}]\n)|(?=[\n{MARK}])|(?<=\A\n))|(?=\n(?:[\n{MARK}]|\z)))"
    line = r"(?:(?<=\n)|(?=\n))"
    low, target = limit // 2, limit * 7 // 8
    by = lambda at: rf".{{{low},{target}}}{at}|.{{{target + 1},{limit}}}{at}|.{{1,{low - 1}}}{at}"
    return rf"(?s).{{1,{limit}}}+\z|{by(blank)}|{by(line)}|.{{1,{limit}}}"


def boundary(bodies: Column) -> Column:
    """block, line or inside: the weakest of the cuts between marked pieces. Cuts inside a blank line tear no block, but a line."""
    none = F.lit("")

    def around(x: Column, i: Column) -> Column:
        before = F.concat(F.coalesce(F.right(F.get(bodies, i - 1), F.lit(1)), none), F.right(F.get(bodies, i), F.lit(2)))
        after = F.concat(F.left(x, F.lit(2)), F.coalesce(F.left(F.get(bodies, i + 2), F.lit(1)), F.lit("$")))
        return F.concat(F.right(before, F.lit(2)), F.lit("|"), F.left(after, F.lit(2)))

    ends = F.transform(F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))), around)
    torn = F.exists(ends, lambda e: e.rlike(rf"{MARK}\|{MARK}"))
    at_blank = lambda e: e.rlike(rf"{MARK}\||(?:\A|[\n{MARK}])\n\||\n\|[\n{MARK}]|\|\n[\n{MARK}$]")
    at_line = lambda e: e.rlike(r"\n\||\|\n")
    return F.when(F.forall(ends, at_blank), "block").when(~torn & F.forall(ends, lambda e: at_blank(e) | at_line(e)), "line").otherwise("inside")


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _shared(bodies: Column, i: Column, limit: int, lines: int) -> Column:
    """Up to so many whole lines from the end of the piece before that still fit into the limit."""
    before, body = F.get(bodies, i - 1), F.get(bodies, i)
    cut = F.slice(F.split(before, "\n", -1), 1, _breaks(before))
    torn = (i > 1) & ~F.endswith(F.get(bodies, i - 2), F.lit("\n"))
    whole = F.least(F.size(cut) - torn.cast("int"), F.lit(lines))
    tails = F.transform(F.sequence(F.lit(1), whole), lambda k: F.concat(F.array_join(F.slice(cut, F.size(cut) - k + 1, k), "\n"), F.lit("\n")))
    fitting = F.filter(tails, lambda s: F.length(s) <= F.lit(limit) - F.length(body))
    usable = (i > 0) & F.endswith(before, F.lit("\n")) & (whole > 0)
    return F.when(usable, F.coalesce(F.get(fitting, F.size(fitting) - 1), F.lit(""))).otherwise("")


def pieces(chunks: DataFrame, limit: int = LIMIT, lines: int = OVERLAP_LINES) -> DataFrame:
    """chunk_id, boundary, piece, start_line, end_line, shared_lines, text: the pieces of each chunk over the limit, in order.

    Pieces without the lines they share, put together, are the text. Texts within
    the limit, empty and null texts have no pieces; a null start_line counts as 1;
    of repeated rows the latest counts; rows whose chunk_id is null count as one chunk.
    """
    over = chunks.where(F.length("text") > limit).select("chunk_id", "text", "start_line", "ingested_at")
    latest = F.max_by(F.struct("text", "start_line"), F.coalesce("ingested_at", F.lit(0).cast("timestamp")))
    one = over.groupBy("chunk_id").agg(latest.alias("x")).select("chunk_id", "x.*")
    cut = one.select("chunk_id", "text", F.coalesce("start_line", F.lit(1)).alias("line"), F.regexp_extract_all(marked(F.col("text")), F.lit(cut_pattern(limit)), F.lit(0)).alias("cuts"))
    placed = cut.withColumn("at", F.aggregate("cuts", F.array(F.lit(1)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x)))))
    own = F.transform("cuts", lambda x, i: F.substring("text", F.get("at", i), F.length(x)))
    bodies = placed.select("chunk_id", "line", boundary(F.col("cuts")).alias("boundary"), own.alias("bodies"))
    before = F.aggregate("bodies", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + _breaks(x))))
    led = bodies.withColumn("above", before).withColumn("shared", F.transform("bodies", lambda x, i: _shared(F.col("bodies"), i, limit, lines)))
    each = led.select("chunk_id", "boundary", "line", "above", F.posexplode(F.arrays_zip("bodies", "shared")).alias("piece", "x"))
    text = F.concat("x.shared", "x.bodies")
    return each.select(
        "chunk_id", "boundary", "piece",
        (F.col("line") + F.get("above", F.col("piece")) - _breaks(F.col("x.shared"))).alias("start_line"),
        (F.col("line") + F.get("above", F.col("piece")) + _breaks(F.col("x.bodies")) - F.endswith("x.bodies", F.lit("\n")).cast("int")).alias("end_line"),
        _breaks(F.col("x.shared")).alias("shared_lines"), text.alias("text"),
    )
