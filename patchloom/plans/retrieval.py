"""Queries on texts, chunks and searches. Every twentieth donor's excerpt is a query against all chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, retrieval
from ..sources.tables import latest, latest_texts, table
from ..stages import keep
from . import sql as S

POOL, HINT = 80, "cx rz dag"
KINDS = ("function", "class", "module")


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest_texts(table(spark, d, "code_chunks"), ["chunk_id"], ["text", *columns])


def _donors(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest_texts(table(spark, d, "donor_exemplars"), ["donor_id"], ["buggy_chunk", *columns])


def _best(spark: SparkSession, d: str, docs: DataFrame, k: int, every: int = 20, boost: Column | None = None, hint: str = "") -> DataFrame:
    """The k best documents of each query, which are every so manyth donor's seed terms."""
    asked = _donors(spark, d).where(F.col("donor_id") % every == 0)
    terms = retrieval.hinted(retrieval.seed_terms(asked, "donor_id", F.col("buggy_chunk")), asked, "donor_id", hint)
    return retrieval.search(asked.select("donor_id"), terms, docs, "donor_id", "chunk_id", k, boost)


def _indexed(spark: SparkSession, d: str, *header: str, kind: str | None = None) -> DataFrame:
    """Chunks as documents of an index, with the columns of a header before the text."""
    chunks = _chunks(spark, d, *header, *(() if "kind" in header or kind is None else ("kind",)))
    parts = [F.coalesce(c, F.lit("")) for c in (*header, "text")]
    return retrieval.documents(chunks if kind is None else chunks.where(F.col("kind") == kind), "chunk_id", F.concat_ws(" ", *parts))


def q_split_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each chunk: how many by either rule, the longest, the first."""
    lines = T.split_lines(F.col("text"))
    return _chunks(spark, d).where("text is not null").select(
        "chunk_id", F.size(lines).alias("lines"), T.line_count(F.col("text")).cast("long").alias("breaks"),
        F.coalesce(F.array_max(F.transform(lines, F.length)), F.lit(0)).alias("longest"), F.get(lines, F.lit(0)).alias("first_line"),
    )


def q_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each chunk, and distinct ones."""
    toks = T.tokens(F.col("text"))
    return _chunks(spark, d).where("text is not null").select("chunk_id", F.size(toks).alias("tokens"), F.size(F.array_distinct(toks)).alias("distinct_tokens"), F.array_join(F.slice(toks, 1, 5), " ").alias("first_tokens"))


def q_top_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The seed query of every donor."""
    donors = _donors(spark, d)
    return retrieval.seed_terms(donors, "donor_id", F.col("buggy_chunk")).select("donor_id", "term", "weight", "rank")


def q_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 20 lines, 5 shared, over the texts of all chunks."""
    files = _chunks(spark, d, "repo_key").select(F.col("chunk_id").alias("file_id"), "repo_key", "text")
    cut = chunking.window_chunks(files, F.col("repo_key"), F.col("file_id"), F.col("text"), 20, 5)
    return cut.select("file_id", "chunk_id", "start_line", "end_line", "symbol", F.md5("chunk").alias("chunk_md5"))


def q_adaptive_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows whose size follows the length of the text."""
    files = _chunks(spark, d, "repo_key").select(F.col("chunk_id").alias("file_id"), "repo_key", "text")
    window, overlap = chunking.adaptive_window(F.size(T.split_lines(F.col("text"))))
    return chunking.window_chunks(files, F.col("repo_key"), F.col("file_id"), F.col("text"), window, overlap).select("file_id", "chunk_id", "start_line", "end_line")


def q_syntax_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Functions and classes of the texts of all chunks, windows where there are none."""
    files = _chunks(spark, d, "repo_key")
    return chunking.syntax_chunks(files, "repo_key", "chunk_id", "text").select("chunk_id", "path", "start_line", "end_line", "symbol", "kind")


def q_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    """In how many chunks each term stands, and how often."""
    docs = retrieval.documents(_chunks(spark, d), "chunk_id", F.col("text"))
    return retrieval.term_counts(docs, "chunk_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def q_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = retrieval.documents(_chunks(spark, d), "chunk_id", F.col("text"))
    return retrieval.corpus(docs).select("n", F.round("avgdl", 6).alias("avgdl"))


def _ranked(best: DataFrame, *more: str) -> DataFrame:
    return best.select("donor_id", "chunk_id", "pool_rank", *more, F.round("score", 6).alias("score"))


def q_bm25_topk(spark: SparkSession, d: str, every: int = 20) -> DataFrame:
    """The ten best chunks of each query; every so manyth donor is one. Chunks without a term compete with 0."""
    return _ranked(_best(spark, d, _indexed(spark, d), 10, every))


def q_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best chunks with headers of symbol and kind, and lexicon boosts; every chunk competes."""
    return _ranked(_best(spark, d, _indexed(spark, d, "symbol", "kind"), 10, boost=retrieval.lexicon_boost()))


def q_path_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same with the path in the header, and with the hint that every query carries."""
    return _ranked(_best(spark, d, _indexed(spark, d, "symbol", "kind", "file_path"), 10, boost=retrieval.lexicon_boost(), hint=HINT))


def q_kind_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three best of each kind of chunk, each kind an index with statistics of its own."""
    found = [_ranked(_best(spark, d, _indexed(spark, d, kind=k), 3)).withColumn("kind", F.lit(k)) for k in KINDS]
    return found[0].union(found[1]).union(found[2])


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """The pool of each query: donor_id, pool_rank, score, re_score, file, symbol, start, end, chunk_id, text."""
    chunks = _chunks(spark, d, "repo_key", "file_path", "start_line", "end_line", "symbol")
    best = retrieval.rerank(_best(spark, d, _indexed(spark, d), POOL), "donor_id")
    start = F.coalesce("start_line", F.lit(1))
    end = F.coalesce("end_line", start + F.size(T.split_lines(F.col("text"))) - 1)
    return best.join(chunks, "chunk_id").select(
        "donor_id", "pool_rank", "score", "re_score", F.concat("repo_key", F.lit("/"), "file_path").alias("file"), "symbol",
        start.alias("start"), F.greatest(start, end).alias("end"), "chunk_id", "text",
    )


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    """The pool in the order of identifiers shared with the donor's text."""
    asked = _donors(spark, d).where("donor_id % 20 = 0").select("donor_id", F.col("buggy_chunk").alias("asked"))
    return retrieval.rerank(_hits(spark, d).join(asked, "donor_id"), "donor_id", retrieval.shared_words)


def _prior() -> Column:
    preview = F.array_join(F.slice(T.split_lines(F.coalesce("text", F.lit(""))), 1, 120), "\n")
    return retrieval.syntax_prior(preview, F.coalesce("symbol", F.lit("")))


def q_rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of each pool by shared identifiers; equals stay in the pool's order."""
    return _reranked(spark, d).where("pool_rank <= 10").select("donor_id", "chunk_id", "pool_rank", F.round("re_score", 6).alias("re_score"))


def q_prior_topk(spark: SparkSession, d: str) -> DataFrame:
    """Pools ranked anew by the re-rank score with the syntax prior, ten best; equals stay in the pool's order."""
    pool = _reranked(spark, d).withColumn("prior", _prior())
    best = retrieval.resorted(pool, "donor_id", retrieval.with_prior(F.round("re_score", 9), F.col("prior")), 10)
    return _ranked(best.withColumn("prior", F.round("prior", 2)), "prior")


def q_select_balanced(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.select_two(_hits(spark, d).withColumn("score", F.round("score", 9)), "donor_id", "balanced").select("donor_id", "sel", "chunk_id", "pool_rank", "start", "end")


def q_select_coverage(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.select_two(_hits(spark, d), "donor_id", "coverage").select("donor_id", "sel", "chunk_id", "pool_rank", "start", "end")


def q_focus_span(spark: SparkSession, d: str) -> DataFrame:
    """The best hit of each query, tightened to its telling lines, in lines of the chunk."""
    best = _hits(spark, d).where("pool_rank = 1 and length(text) > 0").withColumn("lines", T.split_lines(F.col("text")))
    span = retrieval.focus_span(F.col("lines"), F.lit(1), F.greatest(F.lit(1), F.size("lines")))
    return best.select("donor_id", "chunk_id", span.alias("x")).select("donor_id", "chunk_id", "x.lo", "x.hi", "x.telling")


def q_retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Hit, reciprocal rank, nDCG and recall at 10; a query's gold rows are the chunks of its own case."""
    hits = q_bm25_topk(spark, d)
    donors = _donors(spark, d, "case_id").where("donor_id % 20 = 0")
    gold = donors.join(_chunks(spark, d, "repo_key").select("chunk_id", F.col("repo_key").alias("case_id")), "case_id").select("donor_id", "chunk_id")
    return retrieval.ranking_metrics(hits, gold, "donor_id", "chunk_id")


def q_select_k(spark: SparkSession, d: str) -> DataFrame:
    """Four hits of each query by the balanced selection."""
    return retrieval.select_k(_hits(spark, d).withColumn("score", F.round("score", 9)), "donor_id", 4)


def q_pool_union(spark: SparkSession, d: str) -> DataFrame:
    """The ten best by BM25 and the ten best by the prior as one pool per query, without repetitions."""
    hits = keep(_hits(spark, d))
    columns = ("donor_id", "chunk_id", "file", "start", "end", "pool_rank")
    again = retrieval.resorted(hits, "donor_id", retrieval.with_prior(F.round("score", 9), _prior()), 10)
    return retrieval.merge_pools([hits.where("pool_rank <= 10").select(*columns), again.select(*columns)], "donor_id").select("donor_id", "chunk_id", "pool_rank")


def q_exemplars(spark: SparkSession, d: str) -> DataFrame:
    """Two exemplars for every case from other training cases of its group."""
    cases = latest(table(spark, d, "all_cases"), ["case_id"], ["case_group", "split"])
    grp = F.lower(F.trim(F.coalesce("case_group", F.split_part("case_id", F.lit("/"), F.lit(1)))))
    known = cases.select("case_id", grp.alias("grp"), F.coalesce(F.lower(F.trim("split")).startswith("tr"), F.lit(False)).alias("is_train"))
    donors = _donors(spark, d, "case_id").where("length(buggy_chunk) > 0")
    return retrieval.exemplars(donors, known)


def queries() -> dict:
    every = (
        q_split_lines, q_token_counts, q_top_tokens, q_window_chunks, q_adaptive_chunks, q_syntax_chunks, q_doc_freq, q_corpus_stats, q_bm25_topk, q_hybrid_topk,
        q_path_topk, q_kind_topk, q_rerank_topk, q_prior_topk, q_select_balanced, q_select_coverage, q_focus_span, q_retrieval_metrics, q_select_k, q_pool_union, q_exemplars,
    )
    return {f.__name__: f for f in every}


def _windows(window: str, overlap: str) -> str:
    return f"""WITH f AS (SELECT chunk_id AS file_id, repo_key, {S.lines('text')} AS l FROM {S.CHUNKS} WHERE text IS NOT NULL),
g AS (SELECT *, len(l) AS n FROM f WHERE len(l) > 0), w AS (SELECT *, {window} AS w FROM g), o AS (SELECT *, greatest(w - {overlap}, 1) AS step FROM w),
e AS (SELECT *, unnest(range(0, n, step)) AS a FROM o), r AS (SELECT *, a + 1 AS s, least(a + w, n) AS e FROM e)
"""


def _hits_sql(k: int = POOL) -> str:
    n = f"len({S.lines('c.text')})"
    return f"""WITH {S.bm25()},
pool AS {S.pool(k)},
hits AS (SELECT donor_id, pool_rank, round(score, 9) AS score, repo_key || '/' || file_path AS file, symbol, coalesce(start_line, 1) AS s,
  greatest(coalesce(start_line, 1), coalesce(end_line, coalesce(start_line, 1) + {n} - 1)) AS e, chunk_id, c.text FROM pool JOIN c USING (chunk_id))"""


_FIRST = """, z AS (SELECT *, e - s + 1 AS size, min(score) OVER w AS lo, max(score) OVER w AS hi, max(pool_rank) OVER w AS last_rank FROM hits WINDOW w AS (PARTITION BY donor_id)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY donor_id ORDER BY round({v1}, 9) DESC, pool_rank) AS rn FROM z) WHERE rn = 1),
fin AS (SELECT donor_id, file AS lfile, symbol AS lsym FROM z WHERE pool_rank = last_rank),
two AS (SELECT z.*, greatest(least(z.e, one.e) - greatest(z.s, one.s) + 1, 0) AS ov, one.file AS ffile, one.symbol AS fsym, lfile, lsym FROM z JOIN one USING (donor_id) JOIN fin USING (donor_id)
  WHERE NOT (z.file IS NOT DISTINCT FROM one.file AND z.symbol IS NOT DISTINCT FROM one.symbol AND z.s = one.s AND z.e = one.e)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY donor_id ORDER BY round({v2}, 9) DESC, pool_rank) AS rn FROM two) WHERE rn = 1)
SELECT donor_id, 1 AS sel, chunk_id, pool_rank, s AS start, e AS "end" FROM one UNION ALL SELECT donor_id, 2, chunk_id, pool_rank, s, e FROM best"""


def oracle_sql() -> dict[str, str]:
    lex = S.words(T.lexicon())
    prior = (
        f"(CASE WHEN regexp_matches(x, '{'|'.join(retrieval.ERROR_WORDS)}') THEN 0.10 ELSE 0 END + CASE WHEN regexp_matches(x, '{'|'.join(retrieval.PRIOR_WORDS)}') THEN 0.15 ELSE 0 END"
        r" + CASE WHEN regexp_matches(x, '\b(run|apply)\b') THEN 0.12 ELSE 0 END + CASE WHEN regexp_matches(x, 'dag|layout') THEN 0.08 ELSE 0 END)"
    )
    header = "coalesce(symbol, '') || ' ' || coalesce(kind, '') || ' ' || coalesce(text, '')"
    path = "coalesce(symbol, '') || ' ' || coalesce(kind, '') || ' ' || coalesce(file_path, '') || ' ' || coalesce(text, '')"
    boosted = f", b AS (SELECT chunk_id, 0.02 * 1.8 * len(list_filter(toks, lambda t: t IN ({lex}))) AS boost FROM d), h AS (SELECT donor_id, chunk_id, score + boost AS score FROM scores JOIN b USING (chunk_id))"
    kinds = " UNION ALL ".join(f"SELECT donor_id, chunk_id, pool_rank, round(score, 6) AS score, '{k}' AS kind FROM (WITH {S.bm25(where=chr(39).join(('WHERE kind = ', k, '')))} SELECT * FROM {S.pool(3)})" for k in KINDS)
    shared = f"""{_hits_sql()}, y0 AS (SELECT h.*, list_distinct({S.tokens("coalesce(h.text, '')")}) AS x, list_distinct({S.tokens("coalesce(o.buggy_chunk, '')")}) AS z FROM hits h JOIN {S.DONORS} o USING (donor_id)),
            y1 AS (SELECT * EXCLUDE (score, pool_rank), pool_rank AS was, len(list_intersect(x, z)) AS i, len(list_distinct(list_concat(x, z))) AS u FROM y0),
            y2 AS (SELECT *, round(CASE WHEN u = 0 THEN 1.0 ELSE i / u END, 9) AS re_score FROM y1), y AS (SELECT *, row_number() OVER (PARTITION BY donor_id ORDER BY re_score DESC, was) AS pool_rank FROM y2)"""
    return {
        "q_split_lines": f"""SELECT chunk_id, len(l) AS lines, length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS breaks,
            coalesce(list_max(list_transform(l, lambda x: length(x))), 0) AS longest, l[1] AS first_line FROM (SELECT chunk_id, text, {S.lines('text')} AS l FROM {S.CHUNKS} WHERE text IS NOT NULL)""",
        "q_token_counts": f"""SELECT chunk_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens, coalesce(array_to_string(t[1:5], ' '), '') AS first_tokens
            FROM (SELECT chunk_id, {S.tokens('text')} AS t FROM {S.CHUNKS} WHERE text IS NOT NULL)""",
        "q_top_tokens": f"SELECT donor_id, term, weight, rank FROM {S.SEEDS.replace(' WHERE donor_id % 20 = 0', '')}",
        "q_window_chunks": _windows("20", "5") + "SELECT file_id, left(md5(repo_key || ':' || file_id || ':' || s || '-' || e), 12) AS chunk_id, s AS start_line, e AS end_line, '<win@' || s || '-' || e || '>' AS symbol, md5(array_to_string(l[s:e], chr(10))) AS chunk_md5 FROM r",
        "q_adaptive_chunks": _windows("greatest(6, least(40, n // 3 + 2))", "greatest(2, w // 4)") + "SELECT file_id, left(md5(repo_key || ':' || file_id || ':' || s || '-' || e), 12) AS chunk_id, s AS start_line, e AS end_line FROM r",
        "q_doc_freq": f"SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM (SELECT chunk_id, unnest({S.tokens('text')}) AS term FROM {S.CHUNKS}) GROUP BY term",
        "q_corpus_stats": f"SELECT count(*) AS n, round(avg(coalesce(len({S.tokens('text')}), 0)), 6) AS avgdl FROM {S.CHUNKS}",
        "q_bm25_topk": f"WITH {S.bm25()} SELECT donor_id, chunk_id, pool_rank, round(score, 6) AS score FROM {S.pool(10)}",
        "q_hybrid_topk": f"WITH {S.bm25(header)}{boosted} SELECT donor_id, chunk_id, pool_rank, round(score, 6) AS score FROM {S.pool(10, 'h')}",
        "q_path_topk": f"WITH {S.bm25(path, hint=HINT)}{boosted} SELECT donor_id, chunk_id, pool_rank, round(score, 6) AS score FROM {S.pool(10, 'h')}",
        "q_kind_topk": kinds,
        "q_rerank_topk": f"{shared} SELECT donor_id, chunk_id, pool_rank, round(re_score, 6) AS re_score FROM y WHERE pool_rank <= 10",
        "q_prior_topk": f"""{shared}, pp AS (SELECT *, lower(array_to_string({S.lines("coalesce(text, '')")}[1:120], chr(10)) || ' ' || coalesce(symbol, '')) AS x_ FROM y),
            v AS (SELECT donor_id, chunk_id, pool_rank AS was, round({prior.replace('(x,', '(x_,')}, 2) AS prior, round(re_score * (1 + 0.5 * {prior.replace('(x,', '(x_,')}), 9) AS score FROM pp)
            SELECT donor_id, chunk_id, row_number() OVER (PARTITION BY donor_id ORDER BY score DESC, was) AS pool_rank, prior, round(score, 6) AS score FROM v QUALIFY pool_rank <= 10""",
        "q_select_balanced": _hits_sql() + _FIRST.format(v1="1.05 + (score - lo) / (hi - lo + 1e-9)", v2="0.8 * (size - ov) / size + (score - lo) / (hi - lo + 1e-9) - 0.10 * (1 - (size - ov) / size) + CASE WHEN file IS NOT DISTINCT FROM ffile THEN 0 ELSE 0.15 END + CASE WHEN symbol IS NOT DISTINCT FROM fsym THEN 0 ELSE 0.10 END"),
        "q_select_coverage": _hits_sql() + _FIRST.format(v1="size + 16", v2="size - ov + CASE WHEN file IS NOT DISTINCT FROM lfile THEN 0 ELSE 10 END + CASE WHEN symbol IS NOT DISTINCT FROM lsym THEN 0 ELSE 6 END"),
        "q_focus_span": f"""{_hits_sql()}, t AS (SELECT donor_id, chunk_id, {S.lines('text')} AS l FROM hits WHERE pool_rank = 1 AND length(text) > 0),
            mm AS (SELECT donor_id, chunk_id, len(l) AS n, list_filter(range(1, greatest(1, len(l)) + 1), lambda i: coalesce(regexp_matches(l[i], '{retrieval.FOCUS}'), false)) AS m FROM t),
            s AS (SELECT *, greatest(1, list_min(m) - 3) AS lo, least(n, list_max(m) + 3) AS hi, greatest(1, (1 + greatest(1, n)) // 2 - 12) AS mid FROM mm)
            SELECT donor_id, chunk_id, CASE WHEN len(m) = 0 THEN mid ELSE lo END AS lo, CASE WHEN len(m) = 0 THEN least(n, mid + 23) ELSE least(hi, lo + 23) END AS hi, len(m) AS telling FROM s""",
        "q_pool_union": f"""{_hits_sql()}, x AS (SELECT *, lower(array_to_string({S.lines("coalesce(text, '')")}[1:120], chr(10)) || ' ' || coalesce(symbol, '')) AS x FROM hits),
            y AS (SELECT donor_id, chunk_id, file, s, e, row_number() OVER (PARTITION BY donor_id ORDER BY round(score * (1 + 0.5 * {prior}), 9) DESC, pool_rank) AS pool_rank FROM x), a AS (SELECT *, 1 AS src FROM y WHERE pool_rank <= 10),
            u AS (SELECT donor_id, chunk_id, file, s, e, pool_rank, 0 AS src FROM hits WHERE pool_rank <= 10 UNION ALL SELECT * FROM a),
            k AS (SELECT *, row_number() OVER (PARTITION BY donor_id, file, s, e ORDER BY src, pool_rank) AS i FROM u) SELECT donor_id, chunk_id, row_number() OVER (PARTITION BY donor_id ORDER BY src, pool_rank) AS pool_rank FROM k WHERE i = 1""",
        "q_exemplars": f"""WITH c AS (SELECT case_id, lower(trim(coalesce(case_group, split_part(case_id, '/', 1)))) AS grp, coalesce(lower(trim(split)) LIKE 'tr%', false) AS is_train FROM {S.CASES}),
            o AS (SELECT grp, o.case_id AS donor_case, min(donor_id) AS donor_id FROM {S.DONORS} o JOIN c USING (case_id) WHERE is_train AND length(buggy_chunk) > 0 GROUP BY ALL),
            p AS (SELECT c.case_id, donor_id, row_number() OVER (PARTITION BY c.case_id ORDER BY donor_id) AS place FROM c JOIN o USING (grp) WHERE c.case_id <> donor_case) SELECT case_id, place, donor_id FROM p WHERE place <= 2""",
        "q_retrieval_metrics": f"""WITH {S.bm25()}, h AS {S.pool(10)}, g AS (SELECT donor_id, chunk_id FROM {S.DONORS} x JOIN c ON c.repo_key = x.case_id WHERE donor_id % 20 = 0),
            fo AS (SELECT donor_id, count(*) AS found, min(pool_rank) AS first, sum(1 / log2(pool_rank + 1)) AS dcg FROM h JOIN g USING (donor_id, chunk_id) GROUP BY donor_id),
            sz AS (SELECT donor_id, count(*) AS golds FROM g GROUP BY donor_id)
            SELECT donor_id, CASE WHEN found > 0 THEN 1 ELSE 0 END AS hit, round(coalesce(1 / first, 0), 6) AS rr,
            round(coalesce(dcg / list_sum(list_transform(range(1, least(golds, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg, round(coalesce(found, 0) / golds, 6) AS recall FROM sz LEFT JOIN fo USING (donor_id)""",
    }
