"""Problem 3: splits that keep related records together.

Cases are related through their group or a template, directly or over others.
Related sets are the connected components of the graph of groups and templates,
found by joins. Sets are then placed by grouped iterative stratification: each
has a vector of label counts, and the sets with the rarest outstanding label go
first, the largest of them before the smaller ones, into the split that needs the
label most. A wave is the sets of one label whose counts of it lie within a factor
of two. What each split takes of a wave is found by filling the neediest splits
down to a common level, which is where placing one set after the other leads;
running sums then give each set its split. Needs are taken anew after each wave,
so that what a wave's last set was too large for is made up by the next. The more of
a label's cases went with rarer labels before, the more the need for cases as such
counts instead, for which the sets that are left are the means. There are as many waves as labels times the binary logarithm of the largest set, and
only sums by label, size and range of hashes are known outside the tasks. Sets that hold no label,
or only the most frequent, come last and even out the number of cases.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import records
from .stages import keep, light

RATIOS = {"train": 0.70, "validation": 0.15, "test": 0.15}
#: Ranges of hashes in which the running sums of a wave are formed side by side.
RANGES = 64
#: The label that every case has; codes are upper case.
ALL = "all cases"


def components(edges: DataFrame) -> DataFrame:
    """node, root for an undirected graph given as (a, b): root is the least node that can be reached.

    Each round takes the least root among a node's neighbours and then the root's
    own root, so that chains halve; a round is written before the next reads it.
    """
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct())
    roots = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        step = roots.join(near, "node", "left").select("node", F.col("root").alias("was"), F.least("root", "seen").alias("root"))
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        step = keep(step.join(up, "root", "left").select("node", "was", F.least("root", "top").alias("root")))
        roots = step.select("node", "root")
        if step.where("was <> root").isEmpty():
            return roots


def related(all_cases: DataFrame, reports: DataFrame) -> DataFrame:
    """case_id, split, set_id: one row per case; set_id names its related set.

    A case whose group is null takes the first segment of its id; a null template,
    and a report of a case that all_cases lacks, relates nothing; an empty group or
    template is a value like any other; repeated rows count once.
    """
    cases = keep(records.cases(all_cases))
    used = reports.where("template is not null").select(F.col("id").alias("case_id"), records.folded(F.col("template")).alias("template")).distinct()
    links = used.join(cases.select("case_id", "grp"), "case_id").select(F.concat(F.lit("g:"), "grp").alias("a"), F.concat(F.lit("t:"), "template").alias("b"))
    roots = keep(components(links).where("node like 'g:%'").select(F.expr("substring(node, 3)").alias("grp"), "root"))
    return cases.join(light(roots), "grp", "left").select("case_id", "split", F.coalesce("root", F.concat(F.lit("g:"), "grp")).alias("set_id"))


def torn(cases: DataFrame) -> DataFrame:
    """case_id of every case in a related set that holds at least two splits."""
    sets = cases.groupBy("set_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo < hi").select("set_id")
    return cases.join(light(keep(sets)), "set_id", "left_semi").select("case_id")


def labels_of(all_cases: DataFrame) -> DataFrame:
    """case_id, label: the distinct finding codes of each case over all its rows; cases without any have no row."""
    codes = F.transform(F.split("qchecker_rules", ","), lambda x: F.upper(F.trim(x)))
    return all_cases.where("case_id is not null").select("case_id", F.explode(codes).alias("label")).where("label <> ''").distinct()


def label_vectors(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """set_id, n, vector: the cases of each related set, and how many of them have each label that occurs in it."""
    sizes = cases.groupBy("set_id").agg(F.count("*").alias("n"))
    counted = cases.select("case_id", "set_id").join(labels, "case_id").groupBy("set_id", "label").agg(F.count("*").alias("k"))
    vectors = counted.groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "k"))).alias("vector"))
    none = F.create_map().cast("map<string,bigint>")
    return sizes.join(vectors, "set_id", "left").select("set_id", "n", F.coalesce("vector", none).alias("vector"))


def fill(needs: dict[str, float], amount: float) -> list[tuple[str, float]]:
    """How much of an amount each split takes if the neediest always takes next, the largest share first."""
    ordered, top, level = sorted(needs.values(), reverse=True), 0.0, float("-inf")
    for k, need in enumerate(ordered, 1):
        top += need
        level = max(level, (top - amount) / k)
    return sorted(((s, max(0.0, n - level)) for s, n in needs.items()), key=lambda x: (-x[1], x[0]))


def _dealt(wave: DataFrame, sums: dict[int, int], quotas: list[tuple[str, float]]) -> DataFrame:
    """The wave plus split: sets in the order of a hash, by where the middle of each falls in the running sum of its weight w; sums has the weight of each range."""
    before = F.get(F.lit([sum(w for k, w in sums.items() if k < r) for r in range(RANGES)]), F.col("range"))
    within = F.sum("w").over(Window.partitionBy("range").orderBy(F.xxhash64("set_id"), "set_id").rowsBetween(Window.unboundedPreceding, 0))
    middle = before + F.col("within") - F.col("w") / 2
    split, edge = F.lit(quotas[0][0]), sum(q for _, q in quotas)
    for s, q in reversed(quotas):
        split, edge = F.when(middle < edge, s).otherwise(split), edge - q
    return wave.withColumn("within", within).withColumn("split", split)


def stratify(sets: DataFrame, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """set_id, split of sets given as set_id, n, vector."""
    every = F.map_concat("vector", F.create_map(F.lit(ALL), F.col("n")))
    sets = keep(sets.select("set_id", "n", every.alias("vector"), F.pmod(F.xxhash64("set_id"), F.lit(RANGES)).cast("int").alias("range")))
    need: dict[str, dict[str, float]] = {}
    wanted: dict[str, int] = {}
    done: list[str] = []
    waves: list[DataFrame] = []
    while ALL not in done:
        rest = reduce(lambda df, label: df.where(~F.map_contains_key("vector", F.lit(label))), done, sets)
        entries = rest.select("n", "range", F.explode("vector").alias("label", "w")).groupBy("label", F.floor(F.log2("w")).alias("level"), "range")
        sums = entries.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()
        left: dict[str, int] = {ALL: 0}
        for r in sums:
            left[r["label"]] = left.get(r["label"], 0) + r["w"]
        if not done:
            wanted, need = left, {label: {s: r * w for s, r in ratios.items()} for label, w in left.items()}
        label = min(left.keys() - {ALL}, key=lambda x: (left[x], x)) if len(left) > 2 else ALL
        still = left[label] / wanted[label] if label != ALL else 0
        for level in sorted({r["level"] for r in sums if r["label"] == label}, reverse=True):
            wave = [r for r in sums if r["label"] == label and r["level"] == level]
            w, n = sum(r["w"] for r in wave), sum(r["n"] for r in wave)
            room = {s: still * need[label][s] + (1 - still) * need[ALL][s] * w / n for s in ratios}
            held = rest.withColumn("w", F.col("vector")[label]).where(F.floor(F.log2("w")) == level)
            took = Observation()
            each = [F.sum(F.when(F.col("split") == s, F.col("vector")[x])).alias(f"{s}:{x}") for s in ratios for x in wanted]
            waves.append(keep(_dealt(held, {r["range"]: r["w"] for r in wave}, fill(room, w)).observe(took, *each).select("set_id", "split")))
            for key, amount in took.get.items():
                s, _, x = key.partition(":")
                need[x][s] -= amount or 0
        done.append(label)
    none = sets.select("set_id", F.lit(None).cast("string").alias("split")).limit(0)
    return keep(reduce(DataFrame.unionByName, waves, none))


def assign(all_cases: DataFrame, reports: DataFrame, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """case_id, set_id, old_split, split: every case with its new split, each related set whole.

    Labels are the finding codes that occur in qchecker_rules; a null or empty list
    is no label. An empty table gives no rows.
    """
    cases = keep(related(all_cases, reports))
    new = stratify(keep(label_vectors(cases, labels_of(all_cases))), ratios)
    return cases.withColumnRenamed("split", "old_split").join(light(new), "set_id").select("case_id", "set_id", "old_split", "split")


def balance(assigned: DataFrame, labels: DataFrame, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """label, split, cases, share, wanted: how the cases of each label, and all of them (label null), fall on the new splits."""
    every = assigned.select(F.lit(None).cast("string").alias("label"), "split")
    of = keep(assigned.join(labels, "case_id").select("label", "split").union(every).groupBy("label", "split").agg(F.count("*").alias("cases")))
    splits = F.array(*(F.struct(F.lit(s).alias("split"), F.lit(r).alias("wanted")) for s, r in ratios.items()))
    grid = of.groupBy("label").agg(F.sum("cases").alias("total")).select("label", "total", F.inline(splits)).alias("g")
    same = F.col("g.label").eqNullSafe(F.col("o.label")) & (F.col("g.split") == F.col("o.split"))
    cases = F.coalesce("o.cases", F.lit(0))
    return grid.join(of.alias("o"), same, "left").select("g.label", "g.split", cases.alias("cases"), F.round(cases / F.col("g.total"), 6).alias("share"), "g.wanted")
