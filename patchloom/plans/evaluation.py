"""Queries on paired results: tests, effect sizes, resampling, curves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tails
from ..operators import statistics
from ..sources.tables import latest, table
from . import sql as S

METHODS = ("AGENT", "RULES")
RATIOS = ("70/15/15", "80/10/10", "75/10/15", "60/20/20")


def _results(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "paired_results"), ["case_id", "method"], ["lines_f1", "lines_p", "lines_r", "num_edits", "lines_touched", "delta_abs_lines", "drift", "id_jacc", "ast_parse_fail"])


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return statistics.paired(_results(spark, d), "case_id", "method", "lines_f1", *METHODS)


def q_paired_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def q_paired_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means, deviation, t, d_z and wins, losses, ties of the paired methods."""
    return statistics.summary(_pairs(spark, d))


def q_cliffs_delta(spark: SparkSession, d: str) -> DataFrame:
    return statistics.cliffs_delta(_pairs(spark, d))


def q_signed_ranks(spark: SparkSession, d: str) -> DataFrame:
    return statistics.signed_ranks(_pairs(spark, d), "case_id")


def q_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return statistics.wilcoxon(_pairs(spark, d), "case_id")


def q_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Test, alternative, statistic, p: Wilcoxon (exact up to 50 untied differences, else approximate), paired t, sign test, from one row of statistics."""
    pairs = _pairs(spark, d)
    summed = statistics.summary(pairs).select("t", F.col("n").alias("pairs"), "wins", "losses")
    one = statistics.wilcoxon(pairs, "case_id").crossJoin(F.broadcast(summed))

    def tests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                yield pd.DataFrame(tails.all_tests(r), columns=["test", "alternative", "statistic", "p"])

    return one.mapInPandas(tests, "test string, alternative string, statistic double, p double")


def q_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """Each pair left out once, with the one-sided p of the others; the report shows them by p."""
    return statistics.leave_one_out(_pairs(spark, d), "case_id").orderBy("p", "case_id")


def q_hash_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Means of the resamples; their 2.5 and 97.5 percentiles are the interval."""
    return statistics.bootstrap(_pairs(spark, d), "case_id")


def q_bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the mean and of d_z, the latter from more than ten valid resamples."""
    b = statistics.bootstrap(_pairs(spark, d), "case_id")
    at = lambda c, x: F.round(F.percentile(c, F.lit(x)) + 1e-9, 6)
    valid = F.count("dz") > 10
    return b.agg(
        F.round(F.avg("mean") + 1e-9, 6).alias("mean"), at("mean", 0.025).alias("lo"), at("mean", 0.975).alias("hi"),
        F.when(valid, at("dz", 0.025)).alias("dz_lo"), F.when(valid, at("dz", 0.975)).alias("dz_hi"),
    )


def q_index_interval(spark: SparkSession, d: str) -> DataFrame:
    """The interval of the mean by index of the sorted resamples."""
    return statistics.index_interval(statistics.bootstrap(_pairs(spark, d), "case_id", seed=42))


def q_sign_flip(spark: SparkSession, d: str) -> DataFrame:
    """One- and two-sided p of the observed mean among means with turned signs, with their mean and deviation."""
    pairs = _pairs(spark, d)
    seen = pairs.agg(F.round(F.avg("diff"), 9).alias("seen"))
    flips = statistics.sign_flips(pairs, "case_id").crossJoin(F.broadcast(seen))
    return flips.agg(
        F.round(F.avg((F.col("mean") >= F.col("seen")).cast("double")), 6).alias("p_one"), F.round(F.avg((F.abs("mean") >= F.abs("seen")).cast("double")), 6).alias("p_two"),
        F.round(F.avg("mean") + 1e-9, 6).alias("null_mean"), F.round(F.stddev_samp("mean") + 1e-9, 6).alias("null_sd"),
    )


def q_exact_flips(spark: SparkSession, d: str) -> DataFrame:
    """The exact p of the sign flips for every group of cases with up to twelve differences."""
    return statistics.exact_flips(_pairs(spark, d).withColumn("grp", F.split_part("case_id", F.lit("/"), F.lit(1))), "grp")


def q_half_split(spark: SparkSession, d: str) -> DataFrame:
    """How often both halves are positive or agree in sign, and how their means correlate."""
    h = statistics.halves(_pairs(spark, d), "case_id")
    first, second = F.col("first") > 0, F.col("second") > 0
    return h.agg(
        F.round(F.avg((first & second).cast("double")) + 1e-9, 6).alias("both_positive"), F.round(F.avg((first == second).cast("double")) + 1e-9, 6).alias("same_sign"),
        F.round(F.corr("first", "second"), 5).alias("correlation"),
    )


def q_subsample(spark: SparkSession, d: str) -> DataFrame:
    """Subsamples of the sizes that the split ratios imply: shares of positive means and of significant ones, and the means' range."""
    pairs = _pairs(spark, d).where("case_id is not null")
    sizes = statistics.ratio_sizes(pairs, RATIOS)
    each = statistics.subsamples(pairs, "case_id", sizes).groupBy("k").agg(
        F.round(F.avg((F.col("mean") > 0).cast("double")) + 1e-9, 6).alias("positive"), F.round(F.avg(F.coalesce(F.col("p") < 0.05, F.lit(False)).cast("double")), 3).alias("significant"),
        F.round(F.avg("mean") + 1e-9, 6).alias("mean"), F.round(F.percentile("mean", F.lit(0.05)) + 1e-9, 6).alias("p05"), F.round(F.percentile("mean", F.lit(0.95)) + 1e-9, 6).alias("p95"),
    )
    return each.join(F.broadcast(sizes), "k")


def q_size_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Share of positive means and their mean for subsamples of every size from four on."""
    return statistics.size_sweep(_pairs(spark, d), "case_id")


def q_method_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Per method: n, mean and a 95 % interval; no width for one value."""
    se = F.when(F.count("lines_f1") > 1, F.stddev_samp("lines_f1") / F.sqrt(F.count("lines_f1"))).otherwise(0.0)
    return _results(spark, d).groupBy("method").agg(F.count("lines_f1").alias("n"), F.round(F.avg("lines_f1") + 1e-9, 6).alias("mean"), F.round(F.avg("lines_f1") - 1.96 * se, 6).alias("lo"), F.round(F.avg("lines_f1") + 1.96 * se, 6).alias("hi"))


def q_ecdf(spark: SparkSession, d: str) -> DataFrame:
    return statistics.ecdf(_results(spark, d), "case_id", "lines_f1", "method")


def q_difference_curve(spark: SparkSession, d: str) -> DataFrame:
    """Pairs in the order of their difference."""
    return statistics.value_ranks(_pairs(spark, d), "case_id", "diff").select("case_id", "diff", "rank")


def q_quartiles(spark: SparkSession, d: str) -> DataFrame:
    p = [F.round(F.percentile("lines_f1", F.lit(x)) + 1e-9, 6).alias(n) for x, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]
    return _results(spark, d).groupBy("method").agg(*p, F.round(F.avg("lines_f1") + 1e-9, 6).alias("mean"), F.min("lines_f1").alias("least"), F.max("lines_f1").alias("most"))


def q_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Twenty bins of identifier similarity from 0 to 1, the last one closed."""
    b = F.least(F.floor(F.col("id_jacc") * 20), F.lit(19))
    return _results(spark, d).where("id_jacc is not null").groupBy("method", b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def q_regression(spark: SparkSession, d: str) -> DataFrame:
    """Line and correlation of the score over the drift; none for fewer than three points, r 0 without variance."""
    some = _results(spark, d).where("drift is not null and lines_f1 is not null")
    flat = (F.stddev_pop("drift") < 1e-12) | (F.stddev_pop("lines_f1") < 1e-12)
    return some.groupBy("method").agg(
        F.count("*").alias("n"), F.round(F.regr_slope("lines_f1", "drift"), 5).alias("slope"), F.round(F.regr_intercept("lines_f1", "drift"), 5).alias("intercept"),
        F.round(F.when(flat, 0.0).otherwise(F.corr("lines_f1", "drift")), 5).alias("r"),
    ).where("n >= 3")


def q_efficiency(spark: SparkSession, d: str) -> DataFrame:
    """Score per ten changed lines; null without changed lines."""
    e = F.round(F.col("lines_f1") / (F.nullif("delta_abs_lines", F.lit(0)) / 10), 6)
    return _results(spark, d).select("case_id", "method", e.alias("efficiency"))


def q_distortion(spark: SparkSession, d: str) -> DataFrame:
    """Flags of each result; a missing drift or similarity raises none."""
    return _results(spark, d).select(
        "case_id", "method", F.coalesce("ast_parse_fail", F.lit(False)).alias("parse_fail"), F.coalesce(F.col("drift") > 0.40, F.lit(False)).alias("drift_flag"), F.coalesce(F.col("id_jacc") < 0.60, F.lit(False)).alias("jaccard_flag"),
        F.coalesce((F.col("lines_f1") == 0) & (F.col("delta_abs_lines") >= 5), F.lit(False)).alias("no_gain_flag"),
    )


def q_left_compare(spark: SparkSession, d: str) -> DataFrame:
    """Pairs beside the rule baseline of the case profile; missing values are 0, and flags tell which were there."""
    profile = latest(table(spark, d, "all_cases"), ["case_id"], ["rule_apr_lines_f1", "qchecker_findings"])
    joined = _pairs(spark, d).join(profile.withColumn("there", F.lit(True)), "case_id", "left")
    return joined.select("case_id", "a", "b", F.coalesce("rule_apr_lines_f1", F.lit(0.0)).alias("rule_f1"), F.coalesce("qchecker_findings", F.lit(0)).alias("findings"), F.coalesce("there", F.lit(False)).alias("profile_present"))


def q_best_in_row(spark: SparkSession, d: str) -> DataFrame:
    """Which methods reach the best score of the case, within 1e-9."""
    wide = _results(spark, d).groupBy("case_id").pivot("method", list(METHODS)).agg(F.first("lines_f1"))
    best = F.greatest(*METHODS)
    return wide.select("case_id", best.alias("best"), *(F.coalesce(F.abs(F.col(m) - best) < 1e-9, F.lit(False)).alias(f"{m.lower()}_best") for m in METHODS))


def queries() -> dict:
    every = (
        q_paired_pivot, q_paired_summary, q_cliffs_delta, q_signed_ranks, q_wilcoxon, q_p_values, q_leave_one_out, q_hash_bootstrap, q_bootstrap_interval, q_index_interval, q_sign_flip, q_exact_flips, q_half_split, q_subsample, q_size_sweep,
        q_method_intervals, q_ecdf, q_difference_curve, q_quartiles, q_histogram, q_regression, q_efficiency, q_distortion, q_left_compare, q_best_in_row,
    )
    return {f.__name__: f for f in every}


_PAIRS = f"""WITH r AS (SELECT * FROM {S.RESULTS}), p AS (SELECT a.case_id, a.lines_f1 AS a, b.lines_f1 AS b, round(a.lines_f1 - b.lines_f1, 6) AS diff FROM r a JOIN r b USING (case_id)
  WHERE a.method = 'AGENT' AND b.method = 'RULES' AND a.lines_f1 IS NOT NULL AND b.lines_f1 IS NOT NULL)"""
_RANKS = _PAIRS + """, s AS (SELECT case_id, diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2.0 AS avg_rank, count(*) OVER (PARTITION BY abs(diff)) AS m FROM p WHERE diff <> 0)"""
_BOTH = f"WITH r AS (SELECT * FROM {S.RESULTS})"


def _drawn(seed: int) -> str:
    """i: eight digits for each pair and iteration; s: pairs of each iteration in their order."""
    return _PAIRS + f""", i AS (SELECT case_id, diff, t.b * 4 + k + 1 AS it, substr(md5('{seed}-' || t.b || '-' || case_id), 8 * k + 1, 8) AS h FROM p, range(0, {-(-statistics.ITERATIONS // 4)}) t(b), range(0, 4) u(k) WHERE t.b * 4 + k + 1 <= {statistics.ITERATIONS}),
        s AS (SELECT it, diff, row_number() OVER (PARTITION BY it ORDER BY h, case_id) AS rank, count(*) OVER (PARTITION BY it) AS total FROM i)"""


def _tail(z: str) -> str:
    """The normal tail by the same polynomial."""
    t, series = f"(1 / (1 + {statistics.TAIL_T} * abs({z})))", "0.0"
    for c in reversed(statistics.TAIL):
        series = f"(({series} + {c}) * {t})"
    upper = f"exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {series}"
    return f"CASE WHEN {z} >= 0 THEN {upper} ELSE 1 - {upper} END"


_Z = "(CASE WHEN n * (n + 1) * (2 * n + 1) / 24.0 - cubes / 48.0 > 1e-12 THEN (w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - cubes / 48.0) END)"


def oracle_sql() -> dict[str, str]:
    copies = " + ".join(f"CASE WHEN h >= '{statistics.as_digits(p)}' THEN 1 ELSE 0 END" for p in statistics.POISSON)
    boot = lambda seed: _drawn(seed) + f""", w AS (SELECT it, diff, {copies} AS c FROM i), g AS (SELECT it, sum(c)::BIGINT AS n, sum(c * diff) AS s, sum(c * diff * diff) AS q FROM w GROUP BY it),
        v AS (SELECT it, n, s / nullif(n, 0) AS m, (q - n * (s / nullif(n, 0)) * (s / nullif(n, 0))) / nullif(n - 1, 0) AS var FROM g), b AS (SELECT it, n, round(m + 1e-9, 6) AS mean, round(CASE WHEN var > 1e-12 THEN m / sqrt(var) END + 1e-9, 6) AS dz FROM v)"""  # noqa: E731
    ratios = ", ".join(f"('{r}', {r.split('/')[1]})" for r in RATIOS)
    return {
        "q_paired_pivot": _PAIRS + " SELECT * FROM p",
        "q_paired_summary": _PAIRS + """ SELECT count(*) AS n, round(avg(a) + 1e-9, 6) AS mean_a, round(avg(b) + 1e-9, 6) AS mean_b, round(avg(diff) + 1e-9, 6) AS mean_diff, round(stddev_samp(diff) + 1e-9, 6) AS sd_diff, round(quantile_cont(diff, 0.5) + 1e-9, 6) AS median_diff,
            round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 5) AS t, round(avg(diff) / stddev_samp(diff), 5) AS dz, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff < 0) AS losses, count(*) FILTER (diff = 0) AS ties FROM p""",
        "q_cliffs_delta": _PAIRS + """, x AS (SELECT sum((p.a > q.b)::INT)::BIGINT AS greater, sum((p.a < q.b)::INT)::BIGINT AS less, count(*) AS n FROM p, p q), e AS (SELECT *, (greater - less) / n AS delta FROM x)
            SELECT greater, less, round(delta, 6) AS delta, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM e""",
        "q_signed_ranks": _RANKS + " SELECT case_id, diff, avg_rank FROM s",
        "q_wilcoxon": _RANKS + """, t AS (SELECT coalesce(sum(m * m * m - m), 0)::DOUBLE AS ties FROM (SELECT DISTINCT abs(diff), m FROM s)), w AS (SELECT count(*) AS n, coalesce(sum(avg_rank) FILTER (diff > 0), 0)::DOUBLE AS w_plus, coalesce(sum(avg_rank) FILTER (diff < 0), 0)::DOUBLE AS w_minus FROM s)
            SELECT n, w_plus, w_minus, ties, round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM w, t""",
        "q_leave_one_out": _PAIRS + f""", o AS (SELECT x.case_id AS dropped, y.case_id, y.diff FROM p x JOIN p y ON x.case_id <> y.case_id), k AS (SELECT *, CASE WHEN diff <> 0 THEN rank() OVER (PARTITION BY dropped, diff = 0 ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY dropped, diff = 0, abs(diff)) - 1) / 2.0 END AS rk,
            count(*) OVER (PARTITION BY dropped, diff = 0, abs(diff)) AS m FROM o),
            g AS (SELECT dropped AS case_id, count(*) AS all_n, round(avg(diff) + 1e-9, 6) AS mean, round(quantile_cont(diff, 0.5) + 1e-9, 6) AS median, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff < 0) AS losses, count(*) FILTER (diff = 0) AS ties,
              coalesce(sum(rk) FILTER (diff > 0), 0) AS w_plus, (count(*) FILTER (diff <> 0))::DOUBLE AS n, coalesce(sum(m * m - 1) FILTER (diff <> 0), 0)::DOUBLE AS cubes FROM k GROUP BY dropped), z AS (SELECT *, {_Z} AS z FROM g)
            SELECT case_id, all_n AS n, mean, median, wins, losses, ties, round(w_plus, 4) AS w_plus, round({_tail('z')}, 5) AS p FROM z""",
        "q_hash_bootstrap": boot(7) + " SELECT * FROM b",
        "q_bootstrap_interval": boot(7) + " SELECT round(avg(mean) + 1e-9, 6) AS mean, round(quantile_cont(mean, 0.025) + 1e-9, 6) AS lo, round(quantile_cont(mean, 0.975) + 1e-9, 6) AS hi, round(quantile_cont(dz, 0.025) + 1e-9, 6) AS dz_lo, round(quantile_cont(dz, 0.975) + 1e-9, 6) AS dz_hi FROM b",
        "q_index_interval": boot(42) + ", l AS (SELECT list_sort(list(mean)) AS l FROM b) SELECT l[floor(0.025 * len(l))::INT + 1] AS lo, l[floor(0.975 * len(l))::INT] AS hi FROM l",
        "q_sign_flip": _drawn(8) + """, f AS (SELECT it, round(avg(CASE WHEN h < '80000000' THEN -diff ELSE diff END), 9) AS mean FROM i GROUP BY it), o AS (SELECT round(avg(diff), 9) AS seen FROM p)
            SELECT round(avg((mean >= seen)::INT), 6) AS p_one, round(avg((abs(mean) >= abs(seen))::INT), 6) AS p_two, round(avg(mean) + 1e-9, 6) AS null_mean, round(stddev_samp(mean) + 1e-9, 6) AS null_sd FROM f, o""",
        "q_exact_flips": _PAIRS + """, g AS (SELECT split_part(case_id, '/', 1) AS grp, list(round(diff * 1e6)::BIGINT) AS d FROM p WHERE diff <> 0 GROUP BY 1 HAVING count(*) <= 12), t AS (SELECT *, unnest(range(0, (1 << len(d))::BIGINT)) AS turn FROM g),
            x AS (SELECT grp, len(d) AS n, list_sum(d) AS seen, list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (turn >> (i - 1)) & 1 = 1 THEN -d[i] ELSE d[i] END)) AS total FROM t)
            SELECT grp, max(n) AS n, round(avg((total >= seen)::INT), 6) AS p_one, round(avg((abs(total) >= abs(seen))::INT), 6) AS p_two FROM x GROUP BY grp""",
        "q_half_split": _drawn(9) + """, h AS (SELECT it, round(avg(diff) FILTER (rank <= total // 2), 9) AS x, round(avg(diff) FILTER (rank > total // 2), 9) AS y FROM s GROUP BY it)
            SELECT round(avg((x > 0 AND y > 0)::INT) + 1e-9, 6) AS both_positive, round(avg(((x > 0) = (y > 0))::INT) + 1e-9, 6) AS same_sign, round(corr(x, y), 5) AS correlation FROM h""",
        "q_subsample": _drawn(10) + f""", rs AS (SELECT greatest(1, round_even(va / 100 * (SELECT count(*) FROM p), 0))::INT AS k, string_agg(ratio, ', ' ORDER BY ratio) AS ratios FROM (VALUES {ratios}) t(ratio, va) GROUP BY 1),
            f AS (SELECT k, it, diff FROM s JOIN rs ON rank <= k), a AS (SELECT *, CASE WHEN diff <> 0 THEN rank() OVER (PARTITION BY k, it, diff = 0 ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY k, it, diff = 0, abs(diff)) - 1) / 2.0 END AS rk, count(*) OVER (PARTITION BY k, it, diff = 0, abs(diff)) AS m FROM f),
            g AS (SELECT k, it, round(sum(diff) / k, 9) AS mean, (count(*) FILTER (diff <> 0))::DOUBLE AS n, coalesce(sum(rk) FILTER (diff > 0), 0)::DOUBLE AS w_plus, coalesce(sum(m * m - 1) FILTER (diff <> 0), 0)::DOUBLE AS cubes FROM a GROUP BY k, it), z AS (SELECT k, mean, {_Z} AS z FROM g), y AS (SELECT k, mean, {_tail('z')} AS p, z FROM z)
            SELECT k, ratios, round(avg((mean > 0)::INT) + 1e-9, 6) AS positive, round(avg((coalesce(p < 0.05, false) AND z IS NOT NULL)::INT), 3) AS significant, round(avg(mean) + 1e-9, 6) AS mean, round(quantile_cont(mean, 0.05) + 1e-9, 6) AS p05, round(quantile_cont(mean, 0.95) + 1e-9, 6) AS p95
            FROM y JOIN rs USING (k) GROUP BY k, ratios""",
        "q_size_sweep": _drawn(10) + """, c AS (SELECT rank AS k, sum(round(diff * 1e6)::BIGINT) OVER (PARTITION BY it ORDER BY rank) AS t FROM s)
            SELECT k, round(avg((t > 0)::INT), 6) AS positive, round(avg(t / k) / 1e6 + 1e-9, 6) AS mean FROM c WHERE k >= 4 GROUP BY k""",
        "q_method_intervals": _BOTH + """, x AS (SELECT method, count(lines_f1) AS n, avg(lines_f1) AS m, CASE WHEN count(lines_f1) > 1 THEN stddev_samp(lines_f1) / sqrt(count(lines_f1)) ELSE 0 END AS se FROM r GROUP BY method)
            SELECT method, n, round(m + 1e-9, 6) AS mean, round(m - 1.96 * se, 6) AS lo, round(m + 1.96 * se, 6) AS hi FROM x""",
        "q_ecdf": _BOTH + " SELECT method, case_id, lines_f1, round(row_number() OVER (PARTITION BY method ORDER BY lines_f1, case_id) / count(*) OVER (PARTITION BY method), 6) AS y FROM r WHERE lines_f1 IS NOT NULL",
        "q_difference_curve": _PAIRS + " SELECT case_id, diff, row_number() OVER (ORDER BY diff, case_id) AS rank FROM p",
        "q_quartiles": _BOTH + " SELECT method, round(quantile_cont(lines_f1, 0.25) + 1e-9, 6) AS q1, round(quantile_cont(lines_f1, 0.5) + 1e-9, 6) AS q2, round(quantile_cont(lines_f1, 0.75) + 1e-9, 6) AS q3, round(avg(lines_f1) + 1e-9, 6) AS mean, min(lines_f1) AS least, max(lines_f1) AS most FROM r GROUP BY method",
        "q_histogram": _BOTH + " SELECT method, least(floor(id_jacc * 20), 19)::INT AS bin, count(*) AS n FROM r WHERE id_jacc IS NOT NULL GROUP BY ALL",
        "q_regression": _BOTH + """ SELECT method, count(*) AS n, round(regr_slope(lines_f1, drift), 5) AS slope, round(regr_intercept(lines_f1, drift), 5) AS intercept, round(CASE WHEN stddev_pop(drift) < 1e-12 OR stddev_pop(lines_f1) < 1e-12 THEN 0 ELSE corr(lines_f1, drift) END, 5) AS r
            FROM r WHERE drift IS NOT NULL AND lines_f1 IS NOT NULL GROUP BY method HAVING count(*) >= 3""",
        "q_efficiency": _BOTH + " SELECT case_id, method, round(lines_f1 / (nullif(delta_abs_lines, 0) / 10), 6) AS efficiency FROM r",
        "q_distortion": _BOTH + " SELECT case_id, method, coalesce(ast_parse_fail, false) AS parse_fail, coalesce(drift > 0.40, false) AS drift_flag, coalesce(id_jacc < 0.60, false) AS jaccard_flag, coalesce(lines_f1 = 0 AND delta_abs_lines >= 5, false) AS no_gain_flag FROM r",
        "q_left_compare": _PAIRS + f", c AS (SELECT * FROM {S.CASES}) SELECT case_id, a, b, coalesce(rule_apr_lines_f1, 0) AS rule_f1, coalesce(qchecker_findings, 0) AS findings, c.case_id IS NOT NULL AS profile_present FROM p LEFT JOIN c USING (case_id)",
        "q_best_in_row": _BOTH + """, w AS (SELECT case_id, max(lines_f1) FILTER (method = 'AGENT') AS x, max(lines_f1) FILTER (method = 'RULES') AS y FROM r GROUP BY case_id), g AS (SELECT *, greatest(x, y) AS best FROM w)
            SELECT case_id, best, coalesce(abs(x - best) < 1e-9, false) AS agent_best, coalesce(abs(y - best) < 1e-9, false) AS rules_best FROM g""",
    }
