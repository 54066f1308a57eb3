"""Queries on the case profile and the benchmark report: splits, roll-ups, buckets, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranks
from ..sources.tables import latest, table
from . import sql as S


def _cases(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, "all_cases"), ["case_id"], list(columns))


def _reports(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, "synthetic_benchmark_report"), ["id", "method"], list(columns), "run_at", ["ingested_at"])


def _split(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.startswith("tr"), "train").when(s.startswith("v") | s.startswith("dev"), "validation").when(s.startswith("t"), "test").otherwise("unassigned")


def _group() -> Column:
    return F.lower(F.trim(F.coalesce("case_group", F.split_part("case_id", F.lit("/"), F.lit(1)))))


def _mean(c: Column | str) -> Column:
    """A mean to six digits; scores have four, so that halves occur, and are moved off them by a hair for both engines to round alike."""
    return F.round(F.avg(c) + 1e-9, 6)


def q_hash_split(spark: SparkSession, d: str) -> DataFrame:
    """70 / 15 / 15 % of the cases by the order of their MD5."""
    return ranks.ratio_split(_cases(spark, d), "case_id").select("case_id", "rank", "split")


def q_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return ranks.ratio_split(_cases(spark, d), "case_id").groupBy("split").agg(F.count("*").alias("n"))


def q_percent_subset(spark: SparkSession, d: str) -> DataFrame:
    """The feature itself is a subset: a fifth of the cases by hash order."""
    return ranks.percent_subset(_cases(spark, d), "case_id", 20).select("case_id", "rank")


def q_profile_by_split(spark: SparkSession, d: str) -> DataFrame:
    """Cases, means and rates per split."""
    c = _cases(spark, d, "split", "buggy_lines", "total_lines_changed", "api_drift", "identifier_jaccard", "qchecker_findings", "rule_apr_num_edits", "rule_apr_lines_f1")
    return c.groupBy(_split(F.col("split")).alias("split")).agg(
        F.count("*").alias("n"), F.round(F.avg("buggy_lines"), 4).alias("mean_lines"), F.round(F.avg("total_lines_changed"), 4).alias("mean_changed"), F.round(F.avg("api_drift"), 4).alias("mean_drift"),
        F.round(F.avg("identifier_jaccard"), 4).alias("mean_jaccard"), F.round(F.avg((F.col("qchecker_findings") > 0).cast("double")), 4).alias("detection_rate"),
        F.round(F.avg((F.col("rule_apr_num_edits") > 0).cast("double")), 4).alias("fire_rate"), F.round(F.avg("rule_apr_lines_f1"), 4).alias("mean_rule_f1"),
    )


def q_profile_by_group(spark: SparkSession, d: str) -> DataFrame:
    c = _cases(spark, d, "case_group", "buggy_lines", "total_lines_changed", "qchecker_findings")
    return c.groupBy(_group().alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg("buggy_lines"), 4).alias("mean_lines"), F.round(F.avg("total_lines_changed"), 4).alias("mean_changed"), F.sum("qchecker_findings").alias("findings"))


def q_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "code_chunks"), ["chunk_id"], ["kind"]).groupBy("kind").agg(F.count("*").alias("n"))


def q_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cases per rule, and the first six of them by id, found in 64 parts side by side; the list is part of the report, the count is over all."""
    each = _cases(spark, d, "qchecker_rules").where("qchecker_rules <> ''").select("case_id", F.explode(F.split("qchecker_rules", ",")).alias("rule")).distinct()
    part = each.withColumn("part", F.pmod(F.xxhash64("case_id"), F.lit(64)))
    six = lambda ids: F.slice(F.sort_array(ids), 1, 6)
    parts = part.groupBy("rule", "part").agg(F.count("*").alias("n"), six(F.collect_list("case_id")).alias("ids"))
    return parts.groupBy("rule").agg(F.sum("n").alias("cases"), F.array_join(six(F.flatten(F.collect_list("ids"))), ", ").alias("first_cases"))


def q_rule_sets(spark: SparkSession, d: str) -> DataFrame:
    """The sorted distinct rules of each case as one text, and how many cases have them."""
    rules = F.array_join(F.array_sort(F.array_distinct(F.split("rule_apr_rules", ","))), ",")
    return _cases(spark, d, "rule_apr_rules").groupBy(F.coalesce(rules, F.lit("")).alias("rules")).agg(F.count("*").alias("n"))


def q_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    c = _cases(spark, d, "rule_apr_num_edits", "rule_apr_lines_f1")
    fired, f1 = F.col("rule_apr_num_edits") > 0, F.col("rule_apr_lines_f1")
    return c.agg(
        F.count("*").alias("cases"), F.count_if(fired).alias("fired"), F.count_if(f1 >= 0.999).alias("perfect"), F.count_if((f1 > 0) & (f1 < 0.999)).alias("partial"),
        F.count_if(fired & (f1 == 0)).alias("fired_without_gain"), F.count_if(F.col("rule_apr_num_edits") == 0).alias("never_fired"),
    )


def q_rollup_means(spark: SparkSession, d: str) -> DataFrame:
    """Means by method, by method and template family, and overall, without runs that failed."""
    family = F.coalesce(F.lower(F.split_part(F.trim("template"), F.lit("_"), F.lit(1))), F.lit("none"))
    r = _reports(spark, d, "template", "lines_f1", "wall_time_s", "error").where("error is null").withColumn("family", family)
    out = r.rollup("method", "family").agg(F.count("*").alias("n"), _mean("lines_f1").alias("mean_f1"), _mean("wall_time_s").alias("mean_s"), F.grouping_id().cast("int").alias("level"))
    return out.select("method", "family", "level", "n", "mean_f1", "mean_s")


def q_defect_rates(spark: SparkSession, d: str) -> DataFrame:
    """Injected and fixed counts of every defect of the catalogue; a rate of 0 where none was injected."""
    r = _reports(spark, d, "injected", "fixed_regex")
    put = r.select(F.explode("injected").alias("defect")).groupBy("defect").agg(F.count("*").alias("injected"))
    fixed = r.select(F.explode("fixed_regex").alias("defect")).groupBy("defect").agg(F.count("*").alias("fixed"))
    catalogue = table(spark, d, "synthetic_benchmark_report").select(F.explode("injected").alias("defect")).distinct()
    rate = F.coalesce(F.round(F.col("fixed") / F.col("injected"), 6), F.lit(0.0))
    return catalogue.join(put, "defect", "left").join(fixed, "defect", "left").select("defect", F.coalesce("injected", F.lit(0)).alias("injected"), F.coalesce("fixed", F.lit(0)).alias("fixed"), rate.alias("rate"))


def q_strata(spark: SparkSession, d: str) -> DataFrame:
    """By number of defects: mean score, mean of the positive ones (0 without any), their number and share."""
    r, f1 = _reports(spark, d, "n_injected", "lines_f1"), F.col("lines_f1")
    return r.groupBy("n_injected").agg(
        F.count("*").alias("n"), _mean("lines_f1").alias("mean"), F.coalesce(_mean(F.when(f1 > 0, f1)), F.lit(0.0)).alias("mean_positive"),
        F.count_if(f1 > 0).alias("positive"), F.round(F.count_if(f1 > 0) / F.count("*"), 6).alias("positive_rate"),
    )


def q_latency(spark: SparkSession, d: str) -> DataFrame:
    """Per method: mean, upper median, least, most and 95th percentile by index of the sorted times."""
    r = _reports(spark, d, "wall_time_s").where("wall_time_s is not null")
    sorted_rows = ranks.ranked(r, F.floor("wall_time_s"), [F.col("wall_time_s"), F.col("id")], ["method"])
    at = F.col("rank") - 1
    pick = lambda i: F.max(F.when(at == i, F.col("wall_time_s")))
    return sorted_rows.groupBy("method").agg(
        F.count("*").alias("n"), _mean("wall_time_s").alias("mean"), F.round(F.sum("wall_time_s"), 3).alias("total_s"), pick(F.floor(F.col("total") / 2)).alias("median"), F.min("wall_time_s").alias("least"), F.max("wall_time_s").alias("most"),
        pick(F.floor(0.95 * (F.col("total") - 1))).alias("p95"),
    )


def q_winner(spark: SparkSession, d: str) -> DataFrame:
    """The method with the best mean, then the best share of positive scores, then the first name."""
    m = _reports(spark, d, "lines_f1").groupBy("method").agg(_mean("lines_f1").alias("mean"), F.round(F.avg((F.col("lines_f1") > 0).cast("double")), 6).alias("positive_rate"))
    return m.orderBy(F.desc("mean"), F.desc("positive_rate"), "method").limit(1)


def q_template_order(spark: SparkSession, d: str) -> DataFrame:
    """Templates with their mean score."""
    t = F.lower(F.trim("template"))
    return _reports(spark, d, "template", "lines_f1").where("template is not null").groupBy(t.alias("template")).agg(F.count("*").alias("n"), _mean("lines_f1").alias("mean")).orderBy(F.desc("mean"), "template")


def q_split_members(spark: SparkSession, d: str) -> DataFrame:
    """Report ids with the split of their case; ids without a case are reported as missing, not dropped."""
    ids = table(spark, d, "synthetic_benchmark_report").select(F.col("id").alias("case_id")).distinct()
    known = _cases(spark, d, "split").withColumn("there", F.lit(True))
    return ids.join(known, "case_id", "left").select("case_id", F.when(F.col("there"), _split(F.col("split"))).otherwise("missing").alias("split"))


def q_json_props(spark: SparkSession, d: str) -> DataFrame:
    """Events by a field of their JSON; rows that aren't valid JSON count under null."""
    e = table(spark, d, "events")
    return e.groupBy("event_type", (F.get_json_object("props", "$.k").try_cast("int") % 10).alias("k")).agg(F.count("*").alias("n"))


def q_loose_means(spark: SparkSession, d: str) -> DataFrame:
    """Means over a field of JSON in which what is no number counts as 0, and totals of what is."""
    n = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(F.coalesce(n, F.lit(0.0))) + 1e-9, 6).alias("mean"), F.round(F.sum(n), 4).alias("total"), F.count("*").alias("n"))


def q_ordered_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The test cases in the order of their ids, each with its path, and where it stands in that order."""
    some = _cases(spark, d, "split", "buggy_path").where(_split(F.col("split")) == "test")
    return ranks.ranked(some.select("case_id", "buggy_path"), F.left("case_id", F.lit(12)), [F.col("case_id")]).select("case_id", "buggy_path", F.col("rank").alias("place"))


def queries() -> dict:
    every = (
        q_hash_split, q_split_counts, q_percent_subset, q_profile_by_split, q_profile_by_group, q_value_counts, q_rule_counts, q_rule_sets, q_effectiveness, q_rollup_means, q_defect_rates, q_strata, q_latency,
        q_winner, q_template_order, q_split_members, q_json_props, q_loose_means, q_ordered_lookup,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    split = "CASE WHEN lower(trim(split)) LIKE 'tr%' THEN 'train' WHEN lower(trim(split)) LIKE 'v%' OR lower(trim(split)) LIKE 'dev%' THEN 'validation' WHEN lower(trim(split)) LIKE 't%' THEN 'test' ELSE 'unassigned' END"
    c, r = f"WITH c AS (SELECT * FROM {S.CASES})", f"WITH r AS (SELECT * FROM {S.REPORTS})"
    hashed = c + """, h AS (SELECT case_id, row_number() OVER (ORDER BY md5(case_id), case_id) AS rank, count(*) OVER () AS n FROM c),
        s AS (SELECT case_id, rank, CASE WHEN rank <= round_even(n * 0.7, 0) THEN 'train' WHEN rank <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split, n FROM h)"""
    return {
        "q_hash_split": hashed + " SELECT case_id, rank, split FROM s",
        "q_split_counts": hashed + " SELECT split, count(*) AS n FROM s GROUP BY split",
        "q_percent_subset": hashed + " SELECT case_id, rank FROM s WHERE rank <= greatest(1, ceil(n * 20 / 100))",
        "q_profile_by_split": c + f""" SELECT {split} AS split, count(*) AS n, round(avg(buggy_lines), 4) AS mean_lines, round(avg(total_lines_changed), 4) AS mean_changed, round(avg(api_drift), 4) AS mean_drift, round(avg(identifier_jaccard), 4) AS mean_jaccard,
            round(avg((qchecker_findings > 0)::INT), 4) AS detection_rate, round(avg((rule_apr_num_edits > 0)::INT), 4) AS fire_rate, round(avg(rule_apr_lines_f1), 4) AS mean_rule_f1 FROM c GROUP BY 1""",
        "q_profile_by_group": c + " SELECT lower(trim(coalesce(case_group, split_part(case_id, '/', 1)))) AS grp, count(*) AS n, round(avg(buggy_lines), 4) AS mean_lines, round(avg(total_lines_changed), 4) AS mean_changed, sum(qchecker_findings)::BIGINT AS findings FROM c GROUP BY 1",
        "q_value_counts": f"SELECT kind, count(*) AS n FROM {S.CHUNKS} GROUP BY kind",
        "q_rule_counts": c + """, e AS (SELECT DISTINCT case_id, unnest(string_split(qchecker_rules, ',')) AS rule FROM c WHERE qchecker_rules <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY case_id) AS i FROM e)
            SELECT rule, count(*) AS cases, string_agg(case_id, ', ' ORDER BY case_id) FILTER (i <= 6) AS first_cases FROM k GROUP BY rule""",
        "q_rule_sets": c + " SELECT coalesce(array_to_string(list_sort(list_distinct(string_split(rule_apr_rules, ','))), ','), '') AS rules, count(*) AS n FROM c GROUP BY 1",
        "q_effectiveness": c + """ SELECT count(*) AS cases, count(*) FILTER (rule_apr_num_edits > 0) AS fired, count(*) FILTER (rule_apr_lines_f1 >= 0.999) AS perfect, count(*) FILTER (rule_apr_lines_f1 > 0 AND rule_apr_lines_f1 < 0.999) AS partial,
            count(*) FILTER (rule_apr_num_edits > 0 AND rule_apr_lines_f1 = 0) AS fired_without_gain, count(*) FILTER (rule_apr_num_edits = 0) AS never_fired FROM c""",
        "q_rollup_means": r + """, f AS (SELECT *, coalesce(lower(split_part(trim(template), '_', 1)), 'none') AS family FROM r WHERE error IS NULL)
            SELECT method, family, grouping(method, family)::INT AS level, count(*) AS n, round(avg(lines_f1) + 1e-9, 6) AS mean_f1, round(avg(wall_time_s) + 1e-9, 6) AS mean_s FROM f GROUP BY ROLLUP (method, family)""",
        "q_defect_rates": r + """, i AS (SELECT d AS defect, count(*) AS injected FROM (SELECT unnest(injected) AS d FROM r) GROUP BY 1), x AS (SELECT d AS defect, count(*) AS fixed FROM (SELECT unnest(fixed_regex) AS d FROM r) GROUP BY 1),
            k AS (SELECT DISTINCT unnest(injected) AS defect FROM synthetic_benchmark_report) SELECT defect, coalesce(injected, 0) AS injected, coalesce(fixed, 0) AS fixed, coalesce(round(fixed / injected, 6), 0) AS rate FROM k LEFT JOIN i USING (defect) LEFT JOIN x USING (defect)""",
        "q_strata": r + """ SELECT n_injected, count(*) AS n, round(avg(lines_f1) + 1e-9, 6) AS mean, coalesce(round(avg(lines_f1) FILTER (lines_f1 > 0) + 1e-9, 6), 0) AS mean_positive, count(*) FILTER (lines_f1 > 0) AS positive, round(count(*) FILTER (lines_f1 > 0) / count(*), 6) AS positive_rate FROM r GROUP BY n_injected""",
        "q_latency": r + """, l AS (SELECT method, list(wall_time_s ORDER BY wall_time_s, id) AS t FROM r WHERE wall_time_s IS NOT NULL GROUP BY method)
            SELECT method, len(t) AS n, round(list_avg(t) + 1e-9, 6) AS mean, round(list_sum(t), 3) AS total_s, t[len(t) // 2 + 1] AS median, list_min(t) AS least, list_max(t) AS most, t[floor(0.95 * (len(t) - 1))::INT + 1] AS p95 FROM l""",
        "q_winner": r + " SELECT method, round(avg(lines_f1) + 1e-9, 6) AS mean, round(avg((lines_f1 > 0)::INT), 6) AS positive_rate FROM r GROUP BY method ORDER BY mean DESC, positive_rate DESC, method LIMIT 1",
        "q_template_order": r + " SELECT lower(trim(template)) AS template, count(*) AS n, round(avg(lines_f1) + 1e-9, 6) AS mean FROM r WHERE template IS NOT NULL GROUP BY 1",
        "q_split_members": c + f", i AS (SELECT DISTINCT id AS case_id FROM synthetic_benchmark_report) SELECT i.case_id, CASE WHEN c.case_id IS NULL THEN 'missing' ELSE {split} END AS split FROM i LEFT JOIN c USING (case_id)",
        "q_json_props": "SELECT event_type, try_cast(json_extract_string(props, '$.k') AS INT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL",
        "q_loose_means": "SELECT event_type, round(avg(coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0)) + 1e-9, 6) AS mean, round(sum(try_cast(json_extract_string(props, '$.k') AS DOUBLE)), 4) AS total, count(*) AS n FROM events GROUP BY event_type",
        "q_ordered_lookup": c + f" SELECT case_id, buggy_path, row_number() OVER (ORDER BY case_id) AS place FROM c WHERE {split} = 'test'",
    }
