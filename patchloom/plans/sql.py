"""Fragments of DuckDB SQL that several checks share."""

from __future__ import annotations

from ..functions.text import QUERY_STOP_WORDS, STOP_WORDS, lexicon
from ..sources.tables import latest_sql

CHUNKS, CASES, DONORS = latest_sql("code_chunks", "chunk_id"), latest_sql("all_cases", "case_id"), latest_sql("donor_exemplars", "donor_id")
RESULTS = latest_sql("paired_results", "case_id, method")
REPORTS = latest_sql("synthetic_benchmark_report", "id, method", "run_at DESC NULLS LAST, ingested_at")
BREAK = r"chr(13) || chr(10) || '|[' || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(133) || chr(8232) || chr(8233) || ']'"


def words(values) -> str:
    return ", ".join(f"'{w}'" for w in values)


def tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z_][A-Za-z_0-9]*'), lambda w: lower(w)), lambda w: w NOT IN ({words(STOP_WORDS)}))"


def lines(x: str) -> str:
    parts = f"regexp_split_to_array({x}, {BREAK})"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


#: donor_id, term, weight, pos, rank: seed terms of every twentieth donor.
SEEDS = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY donor_id ORDER BY weight DESC, pos) AS rank FROM (
  SELECT donor_id, term, count(*) * CASE WHEN term IN ({words(lexicon()[:20])}) THEN 2 ELSE 1 END AS weight, min(pos) AS pos FROM (
    SELECT donor_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM (SELECT donor_id, {tokens('buggy_chunk')} AS toks FROM {DONORS} WHERE donor_id % 20 = 0))
  WHERE term NOT IN ({words(QUERY_STOP_WORDS)}) GROUP BY donor_id, term)) WHERE rank <= 6)"""


def bm25(text: str = "text", where: str = "", hint: str = "") -> str:
    """CTEs: c chunks, d tokens, q seed terms and the words of a hint, scores (donor_id, chunk_id, score) of every query and every chunk."""
    hints = f" UNION ALL SELECT donor_id, unnest([{words(hint.split())}]) FROM i" if hint else ""
    return f"""c AS (SELECT * FROM {CHUNKS} {where}),
i AS (SELECT donor_id FROM {DONORS} WHERE donor_id % 20 = 0),
d AS (SELECT chunk_id, coalesce({tokens(text)}, []) AS toks FROM c),
n AS (SELECT count(*) AS n, coalesce(avg(len(toks)), 0) AS avgdl FROM d),
q AS (SELECT donor_id, term FROM {SEEDS}{hints}),
p AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
m AS (SELECT donor_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(1.0, avgdl)))) AS score
  FROM q JOIN f USING (term) JOIN p USING (term), n GROUP BY donor_id, chunk_id),
scores AS (SELECT donor_id, chunk_id, coalesce(score, 0) AS score FROM (SELECT donor_id, chunk_id FROM i, c) LEFT JOIN m USING (donor_id, chunk_id))"""


def pool(k: int, scores: str = "scores") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY donor_id ORDER BY round(score, 9) DESC, chunk_id DESC) AS pool_rank FROM {scores}) WHERE pool_rank <= {k})"
