"""Small tables with the dirt that the operators must bear: nulls, blanks, repeated rows, extra columns."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest

CHUNK = "chunk_id string, repo_key string, file_path string, start_line int, end_line int, symbol string, kind string, text string, ingested_at timestamp, content long, side string, n int"
CASE = "case_id string, case_group string, split string, buggy_path string, qchecker_rules string, ingested_at timestamp, grp string, path string"
REPORT = "id string, template string, root string"
DONOR = "donor_id long, case_id string, buggy_chunk string, fixed_chunk string, owner string"
NOW = dt.datetime(2024, 1, 1)


def code(rng: random.Random, lines: int) -> list[str]:
    names = ["qubit", "frame", "gate_a", "Readout", "théta", "cache", "node7", "budget"]
    return [f"    {rng.choice(names)}.{rng.choice(names)}({rng.randint(1, 9999)}, {rng.choice(names)}[{rng.randint(0, 30)}])" for _ in range(lines)]


@pytest.fixture(scope="session")
def chunks_rows():
    rng, rows = random.Random(5), []
    for c in range(30):
        base = code(rng, rng.randint(6, 30))
        rows.append([f"k{c:03}", f"G{c % 10}/case{c}", "\n".join(base)])
        if c % 3 == 0:  # an edited copy in another case
            other = list(base)
            for _ in range(1 + c % 4):
                other[rng.randrange(len(other))] = code(rng, 1)[0]
            if c % 2:
                rng.shuffle(other)
            rows.append([f"e{c:03}", f"G{(c + 1) % 10}/case{(c + 1) % 30}", "\r\n".join(other)])
        if c % 5 == 0:
            rows.append([f"x{c:03}", f"G{(c + 2) % 10}/case{(c + 2) % 30}", "\n".join(base)])
    rows += [["n1", "G0/case0", None], ["n2", "G1/case1", ""], ["n3", "G1/case1", " \t\n"], ["n4", "G1/case1", "a b"], ["n5", None, rows[0][2]], [None, "G3/case3", rows[0][2]], ["n6", "nowhere/1", rows[2][2]]]
    rows.append(list(rows[0]))
    return rows


@pytest.fixture(scope="session")
def chunks(spark, chunks_rows):
    return spark.createDataFrame([(i, r, "buggy.py", 3, None, None, None, t, NOW, 1, "s", 2) for i, r, t in chunks_rows], CHUNK)


@pytest.fixture(scope="session")
def cases_rows():
    spell = {"train": ["train", "TRN", " Train ", "training"], "validation": ["dev", "val ", "Validation"], "test": ["test", "TST", "testing"]}
    rows = []
    for c in range(30):
        split = [None, "train", "train", "validation", "test", "train", "train"][c % 7]
        group = None if c % 6 == 0 else f" g{c % 10} " if c % 4 == 0 else f"G{c % 10}"
        path = [f"/a/defects_db/G{c % 10}/case{c}/buggy.py", f"D:\\x\\DEFECTS_DB\\G{c % 10}\\.\\case{c}\\buggy.py ", f"./defects_db/G{c % 10}/tmp/../case{c}//buggy.py"][c % 3]
        if c == 10:
            path = "file:///z/defects_db/g8/CASE8/buggy.py"
        rows.append([f"G{c % 10}/case{c}", group, split and spell[split][c % len(spell[split])], path])
    rows.append(["G1/case1", "g1", "Training", "/other/defects_db/G1/./case1/buggy.py"])
    rows += [["G9/lost", None, None, None], [None, "G1", "test", None]]
    return rows


@pytest.fixture(scope="session")
def cases(spark, cases_rows):
    return spark.createDataFrame([(i, g, s, p, ["QC01", "QC02,QC05", None, ""][k % 4], NOW, "g", "p") for k, (i, g, s, p) in enumerate(cases_rows)], CASE)


def runs(text: str | None) -> set[tuple]:
    t = [x.lower() for x in re.findall(r"\w+|[^\w\s]", text or "")]
    return {tuple(t[i : i + 4]) for i in range(len(t) - 3)}


def near(a: str | None, b: str | None) -> bool:
    x, y = runs(a), runs(b)
    return bool(x and y) and len(x & y) >= 0.7 * len(x | y) - 1e-9
