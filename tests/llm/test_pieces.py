from __future__ import annotations

import random

import pytest
from patchloom.llm import pieces

from .conftest import CHUNK, NOW


def boundary(text: str, limit: int) -> str:
    lines, stretches, now = text.split("\n"), [], []
    for x in [*lines, ""]:
        if x.strip():
            now.append(x)
        else:
            stretches.append(len("\n".join(now)))
            now = []
    return "block" if max(stretches) <= limit else "line" if max(map(len, lines)) <= limit else "inside"


def texts(limit: int) -> list[str | None]:
    rng = random.Random(3)
    out: list[str | None] = [None, "", "x" * limit, "x" * (limit + 1), "é\n" * limit, "\n" * (limit * 2), " " * (limit * 3), "😀" * (limit * 2 + 7)]
    out += ["x" * limit + "\n" + " " * (limit + 9) + "\n" + "y" * limit, "x\n" * limit + " " * (limit + 9) + "\ny", "x\n" * limit + "\u00a0\u2003\x1c" * 120 + "\ny" * 30, "\n" + "x" * limit + "\n", " \n" + "x" * limit + "\n\t"]
    out += ["a" * limit + "\n\n" + "b" * limit, "a" * limit + "\n" + "b" * limit + "\n", "a" * (limit + 1) + "\n\nb", "\r\n".join(["word " * 3] * limit)]
    for _ in range(60):
        lines = ["" if rng.random() < 0.15 else "\t " if rng.random() < 0.05 else rng.choice("abñ量") * rng.randint(1, limit // rng.choice([1, 3, 9, 20])) for _ in range(rng.randint(5, 80))]
        out.append("\n".join(lines) + rng.choice(["", "\n", "\n\n"]))
    return out


@pytest.mark.parametrize("limit", [60, 2400])
def test_pieces_restore_the_text(spark, limit):
    given = texts(limit)
    rows = [(f"c{i}", "r", "f", 10 + i, None, None, None, t, NOW, 1, "s", 2) for i, t in enumerate(given)]
    df = spark.createDataFrame(rows + rows[3:5], CHUNK)
    got: dict = {}
    for r in pieces.pieces(df, limit).orderBy("chunk_id", "piece").collect():
        got.setdefault(int(r.chunk_id[1:]), []).append(r)
    assert set(got) == {i for i, t in enumerate(given) if t and len(t) > limit}
    for i, parts in got.items():
        body, text = "", given[i]
        for k, p in enumerate(parts):
            lines = p.text.split("\n")
            shared = "".join(x + "\n" for x in lines[: p.shared_lines])
            own = p.text[len(shared) :]
            assert p.piece == k and own and len(p.text) <= limit and p.shared_lines <= 5
            assert body.endswith(shared) and (not shared or len(body) == len(shared) or body[-len(shared) - 1] == "\n")
            assert p.start_line == 10 + i + body.count("\n") - p.shared_lines
            body += own
            assert p.end_line == 10 + i + body.count("\n") - body.endswith("\n")
        assert body == text
        assert {p.boundary for p in parts} == {boundary(text, limit)}
        cuts = [len("".join(q.text.split("\n", q.shared_lines)[-1] for q in parts[: k + 1])) for k in range(len(parts) - 1)]
        if max(map(len, text.split("\n"))) > limit:
            assert parts[0].boundary == "inside" or not any(x.strip() for x in text.split("\n") if len(x) > limit)  # a blank line can be too long for a piece as well
            continue
        for at in cuts:
            at_line = text[at - 1] == "\n" or text[at] == "\n"
            assert at_line
            around = text[:at].rsplit("\n", 2)[-2:] + text[at:].split("\n", 2)[:2]
            assert parts[0].boundary != "block" or any(not x.strip() for x in around)


def test_latest_row_counts_and_empty_table(spark):
    import datetime as dt

    rows = [("c", "r", "f", 1, None, None, None, "a" * 3000, NOW, 1, "s", 2), ("c", "r", "f", None, None, None, None, "b" * 3000, NOW + dt.timedelta(1), 1, "s", 2)]
    got = pieces.pieces(spark.createDataFrame(rows, CHUNK)).orderBy("piece").collect()
    assert [len(r.text) for r in got] == [2400, 600] and got[0].text[0] == "b" and got[0].start_line == 1
    assert pieces.pieces(spark.createDataFrame([], CHUNK)).count() == 0
