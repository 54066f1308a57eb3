"""Paired comparisons of two methods: frames, effect sizes, ranks and resampling by hash.

Scores have few digits, so means and percentiles often lie exactly between two
rounded values; they are moved by 1e-9 before rounding, for every engine and
order of summation to round them alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draws import over_orders
from .ranks import ranked

ITERATIONS, SEED = 10_000, 7


def paired(results: DataFrame, key: str, method: str, value: str, a: str, b: str) -> DataFrame:
    """key, a, b, diff of keys that have a value of both methods; results has one row per key and method."""
    wide = results.groupBy(key).pivot(method, [a, b]).agg(F.first(value)).select(key, F.col(a).alias("a"), F.col(b).alias("b"))
    return wide.dropna(subset=["a", "b"]).withColumn("diff", F.round(F.col("a") - F.col("b"), 6))


def summary(pairs: DataFrame) -> DataFrame:
    """One row: n, means, median and deviation of the difference, t, d_z (null where n < 2 or all differences are equal), wins, losses, ties."""
    sd = F.stddev_samp("diff")
    t = F.when(sd > 1e-12, F.avg("diff") / (sd / F.sqrt(F.count("*"))))
    return pairs.agg(
        F.count("*").alias("n"), F.round(F.avg("a") + 1e-9, 6).alias("mean_a"), F.round(F.avg("b") + 1e-9, 6).alias("mean_b"), F.round(F.avg("diff") + 1e-9, 6).alias("mean_diff"),
        F.round(sd + 1e-9, 6).alias("sd_diff"), F.round(F.percentile("diff", F.lit(0.5)) + 1e-9, 6).alias("median_diff"), F.round(t, 5).alias("t"), F.round(F.when(sd > 1e-12, F.avg("diff") / sd), 5).alias("dz"),
        F.count_if(F.col("diff") > 0).alias("wins"), F.count_if(F.col("diff") < 0).alias("losses"), F.count_if(F.col("diff") == 0).alias("ties"),
    )


def cliffs_delta(pairs: DataFrame) -> DataFrame:
    """One row: greater, less, delta, magnitude over all pairs of an a and a b, from counts of values and ranks instead of pairs; null without rows."""
    values = pairs.select(F.col("a").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).union(pairs.select("b", F.lit(0), F.lit(1)))
    counts = values.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).withColumn("bucket", F.floor(F.col("v") * 1000))
    buckets = counts.groupBy("bucket").agg(F.sum("y").alias("by"))
    w = Window.orderBy("bucket")
    offsets = buckets.select("bucket", F.coalesce(F.sum("by").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("by").over(Window.partitionBy()).alias("all_y"))
    inside = F.coalesce(F.sum("y").over(Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = counts.withColumn("inside", inside).join(offsets, "bucket").withColumn("below", F.col("before") + F.col("inside"))
    sums = below.agg(F.sum(F.col("x") * F.col("below")).alias("greater"), F.sum(F.col("x") * (F.col("all_y") - F.col("below") - F.col("y"))).alias("less"), (F.sum("x") * F.sum("y")).alias("n"))
    delta = F.when(F.col("n") > 0, (F.col("greater") - F.col("less")) / F.col("n"))
    size = F.when(F.abs(delta) < 0.147, "negligible").when(F.abs(delta) < 0.33, "small").when(F.abs(delta) < 0.474, "medium").when(delta.isNotNull(), "large")
    return sums.select("greater", "less", F.round(delta, 6).alias("delta"), size.alias("magnitude"))


def signed_ranks(pairs: DataFrame, key: str) -> DataFrame:
    """key, diff, avg_rank of the absolute difference among those that aren't 0; equal ones share the mean of their ranks."""
    some = pairs.where("diff <> 0").select(key, "diff", F.abs("diff").alias("size"))
    counts = some.groupBy("size").agg(F.count("*").alias("m"))
    w = Window.partitionBy("bucket").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = counts.withColumn("bucket", F.floor(F.col("size") * 1000))
    totals = by_bucket.groupBy("bucket").agg(F.sum("m").alias("bm"))
    before = F.coalesce(F.sum("bm").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    avg = F.col("before") + F.coalesce(F.sum("m").over(w), F.lit(0)) + (F.col("m") + 1) / 2
    ranks = by_bucket.join(totals.select("bucket", before.alias("before")), "bucket").select("size", avg.alias("avg_rank"))
    return some.join(ranks, "size").select(key, "diff", "avg_rank")


def wilcoxon(pairs: DataFrame, key: str) -> DataFrame:
    """One row: n, w_plus, w_minus, z (normal approximation with the correction for ties, null without differences)."""
    r = signed_ranks(pairs, key)
    ties = r.groupBy("avg_rank").agg(F.count("*").alias("m")).agg(F.coalesce(F.sum(F.pow("m", F.lit(3)) - F.col("m")), F.lit(0.0)).alias("ties"))
    zero = F.lit(0.0)
    sums = r.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("diff") > 0, F.col("avg_rank"))), zero).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("diff") < 0, F.col("avg_rank"))), zero).alias("w_minus"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return sums.crossJoin(F.broadcast(ties)).select("n", "w_plus", "w_minus", "ties", F.when(var > 0, F.round((F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var), 6)).alias("z"))


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution to seven digits, by a polynomial; the lower half by symmetry."""
    t = 1 / (1 + TAIL_T * F.abs(z))
    series = F.lit(0.0)
    for c in reversed(TAIL):
        series = (series + c) * t
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, upper).otherwise(1 - upper)


#: Coefficients of the normal tail's polynomial (fixed values).
TAIL_T, TAIL = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def signed_rank_z(n: Column, w_plus: Column, ties: Column) -> Column:
    """Normal approximation of a signed rank sum of n differences; ties is the sum of m^3 - m over groups of m equals. Null without differences."""
    n = n.cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return F.when(var > 1e-12, (w_plus - n * (n + 1) / 4) / F.sqrt(F.greatest(var, F.lit(1e-12))))


def leave_one_out(pairs: DataFrame, key: str) -> DataFrame:
    """key, n, mean, median, wins, losses, ties, w_plus, p of all pairs but one, for each one, from totals and ranks instead of n copies of the data.

    p is the one-sided p of the signed rank sum by its normal approximation, null
    where no difference is left.
    """
    diff = F.col("diff")
    total = pairs.agg(
        F.count("*").alias("n"), F.sum("diff").alias("s"), F.count_if(diff > 0).alias("w"), F.count_if(diff < 0).alias("l"), F.count_if(diff == 0).alias("t")
    )
    ranks = signed_ranks(pairs, key)
    plus = ranks.agg(F.coalesce(F.sum(F.when(diff > 0, F.col("avg_rank"))), F.lit(0.0)).alias("w_plus"))
    sizes = pairs.where("diff <> 0").groupBy(F.abs("diff").alias("size")).agg(F.count_if(diff > 0).alias("pos"), F.count("*").alias("m"))
    cubes = sizes.agg(F.coalesce(F.sum(F.pow("m", F.lit(3)) - F.col("m")), F.lit(0.0)).alias("cubes"))
    buckets = sizes.withColumn("bucket", F.floor(F.col("size") * 1000))
    per = buckets.groupBy("bucket").agg(F.sum("pos").alias("p"))
    later = F.coalesce(F.sum("p").over(Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("pos").over(Window.partitionBy("bucket").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    larger = buckets.withColumn("within", within).join(per.select("bucket", later.alias("later")), "bucket")
    larger = larger.select("size", "pos", "m", (F.col("later") + F.col("within")).alias("above"))
    placed = value_ranks(pairs, key, "diff")
    middle = placed.where(F.abs(F.col("rank") - F.col("total") / 2 - 0.5) <= 1.5).agg(F.map_from_entries(F.collect_list(F.struct("rank", "diff"))).alias("middle"))
    joined = placed.join(ranks.select(key, "avg_rank"), key, "left").join(larger, F.abs(diff) == F.col("size"), "left")
    for one in (total, plus, cubes, middle):
        joined = joined.crossJoin(F.broadcast(one))
    positive = diff > 0
    same = F.col("pos") - positive.cast("int")
    shift = F.when(diff == 0, 0.0).otherwise(F.when(positive, F.col("avg_rank")).otherwise(0.0) + F.col("above") + 0.5 * same)
    at = lambda k: F.try_element_at("middle", F.when(k >= F.col("rank"), k + 1).otherwise(k))
    left = F.col("n") - 1
    median = (at(F.floor((left + 1) / 2)) + at(F.floor((left + 2) / 2))) / 2
    m = F.col("m").cast("double")
    z = signed_rank_z(F.col("w") + F.col("l") - (diff != 0).cast("int"), F.col("w_plus") - shift, F.col("cubes") - F.when(diff != 0, 3 * m * (m - 1)).otherwise(0.0))
    return joined.select(
        key, left.alias("n"), F.round(F.when(left > 0, (F.col("s") - diff) / left) + 1e-9, 6).alias("mean"), F.round(F.when(left > 0, median) + 1e-9, 6).alias("median"),
        (F.col("w") - positive.cast("int")).alias("wins"), (F.col("l") - (diff < 0).cast("int")).alias("losses"), (F.col("t") - (diff == 0).cast("int")).alias("ties"),
        F.round(F.col("w_plus") - shift, 4).alias("w_plus"), F.round(normal_tail(z), 5).alias("p"),
    )


def hash_draws(pairs: DataFrame, key: str, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """key, diff, it, h: for each pair and iteration eight hexadecimal digits that depend on seed, iteration and key only. An MD5 serves four iterations."""
    blocks = pairs.select(key, "diff", F.explode(F.sequence(F.lit(0), F.lit((iterations - 1) // 4))).alias("block"))
    digest = blocks.withColumn("digest", F.md5(F.concat(F.lit(f"{seed}-"), F.col("block").cast("string"), F.lit("-"), F.col(key))))
    each = digest.select(key, "diff", "block", "digest", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part"))
    drawn = each.select(key, "diff", (F.col("block") * 4 + F.col("part") + 1).alias("it"), F.expr("substring(digest, 8 * part + 1, 8)").alias("h"))
    return drawn.where(F.col("it") <= iterations)


#: Cumulative probabilities of Poisson(1) for 0, 1, ... copies (fixed values).
POISSON = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885)


def as_digits(p: float) -> str:
    """The eight digits from which on a draw is at least p."""
    return f"{math.ceil(p * (1 << 32)):08x}"


def bootstrap(pairs: DataFrame, key: str, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """it, n, mean, dz of a resample in which each pair has a Poisson(1) number of copies: no index, no order, no driver. dz is null where all its differences are equal."""
    copies = sum((F.when(F.col("h") >= as_digits(p), 1).otherwise(0) for p in POISSON), F.lit(0))
    weighed = hash_draws(pairs, key, iterations, seed).withColumn("c", copies)
    sums = weighed.groupBy("it").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("diff")).alias("s"), F.sum(F.col("c") * F.col("diff") * F.col("diff")).alias("q"))
    mean = F.col("s") / F.nullif("n", F.lit(0))
    var = (F.col("q") - F.col("n") * mean * mean) / F.nullif(F.col("n") - 1, F.lit(0))
    return sums.select("it", "n", F.round(mean + 1e-9, 6).alias("mean"), F.round(F.when(var > 1e-12, mean / F.sqrt(F.greatest(var, F.lit(1e-12)))) + 1e-9, 6).alias("dz"))


def index_interval(means: DataFrame, alpha: float = 0.05) -> DataFrame:
    """lo, hi of (it, mean): the sorted means at index int(a n) and int((1 - a) n) - 1 with a half of alpha; there is one row per iteration."""
    place = F.row_number().over(Window.orderBy("mean")) - 1
    n = F.count("*").over(Window.partitionBy())
    at = means.select("mean", place.alias("i"), n.alias("n"))
    pick = lambda i: F.max(F.when(F.col("i") == i, F.col("mean")))
    return at.agg(pick(F.floor(alpha / 2 * F.col("n"))).alias("lo"), pick(F.floor((1 - alpha / 2) * F.col("n")) - 1).alias("hi"))


def sign_flips(pairs: DataFrame, key: str, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """it, mean of the differences with signs turned by chance."""
    turned = F.when(F.col("h") < as_digits(0.5), -F.col("diff")).otherwise(F.col("diff"))
    return hash_draws(pairs.where("diff is not null"), key, iterations, seed + 1).groupBy("it").agg(F.round(F.avg(turned), 9).alias("mean"))


def exact_flips(pairs: DataFrame, by: str, most: int = 12) -> DataFrame:
    """by, n, p_one, p_two over all 2^n turns of the n differences that aren't 0, for every group with one to `most` of them."""
    some = pairs.where("diff <> 0").groupBy(by).agg(F.count("*").alias("n"), F.collect_list(F.round(F.col("diff") * 1e6).cast("long")).alias("d"))
    every = some.where(F.col("n") <= most).select(by, "n", "d", F.explode(F.expr("sequence(0, cast(pow(2, n) as int) - 1)")).alias("turn"))
    seen = F.aggregate("d", F.lit(0).cast("long"), lambda acc, x: acc + x)
    total = F.aggregate(F.transform("d", lambda x, i: F.when(F.getbit("turn", i) == 1, -x).otherwise(x)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    sums = every.select(by, "n", seen.alias("seen"), total.alias("total"))
    one, two = F.avg((F.col("total") >= F.col("seen")).cast("double")), F.avg((F.abs("total") >= F.abs("seen")).cast("double"))
    return sums.groupBy(by).agg(F.max("n").alias("n"), F.round(one, 6).alias("p_one"), F.round(two, 6).alias("p_two"))


def shuffled(pairs: DataFrame, key: str, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """it, key, diff, rank, total: all pairs of each iteration in an order by chance, sorted in ranges of the draws."""
    drawn = hash_draws(pairs, key, iterations, seed)
    return ranked(drawn, F.left("h", F.lit(1)), [F.col("h"), F.col(key)], ["it"])


def halves(pairs: DataFrame, key: str, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """it, first, second: means of two halves by chance, the first of n // 2 pairs."""
    half = F.col("rank") <= F.floor(F.col("total") / 2)
    means = [F.round(F.avg(F.when(c, F.col("diff"))), 9).alias(n) for c, n in ((half, "first"), (~half, "second"))]
    return shuffled(pairs, key, iterations, seed + 2).groupBy("it").agg(*means)


def ratio_sizes(pairs: DataFrame, ratios: tuple[str, ...]) -> DataFrame:
    """k, ratios: the size of the validation part that each ratio (train/validation/test) implies, at least 1; ratios of one size share a row."""
    parts = pairs.sparkSession.createDataFrame([(r, int(r.split("/")[1])) for r in ratios], "ratio string, va int")
    k = F.greatest(F.lit(1), F.bround(F.col("va") / 100 * F.col("n"))).cast("int")
    sized = parts.crossJoin(F.broadcast(pairs.agg(F.count("*").alias("n")))).select(k.alias("k"), "ratio")
    return sized.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("ratio")), ", ").alias("ratios"))


def _ranked_prefixes(table: pa.Table, orders: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """k, it, s, n, w_plus, cubes of the first k pairs of each order, for every k of the column ks: sum, differences that aren't 0, their positive rank sum and ties."""
    diff, ks = table.column("diff").to_numpy(), sorted(table.column("ks")[0].as_py())
    sizes, code = np.unique(np.abs(diff), return_inverse=True)
    zero, micro, up = int(sizes[0] == 0), np.rint(diff * 1e6).astype(np.int64), diff > 0
    rows: list[tuple] = []
    for it, order in orders:
        m, pos, s, begin = np.zeros(sizes.size, np.int64), np.zeros(sizes.size, np.int64), 0, 0
        for k in ks:
            part = order[begin:k]
            m += np.bincount(code[part], minlength=sizes.size)
            pos += np.bincount(code[part[up[part]]], minlength=sizes.size)
            s, begin = s + int(micro[part].sum()), k
            some = m[zero:].astype(float)
            w_plus = (pos[zero:] * (np.cumsum(some) - some + (some + 1) / 2)).sum()
            rows.append((k, it, s, int(some.sum()), w_plus, (some**3 - some).sum()))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["k", "it", "s", "n", "w_plus", "cubes"])


def subsamples(pairs: DataFrame, key: str, sizes: DataFrame, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """k, it, mean, p: the first k pairs of each iteration's order, for every k of sizes; p is the signed ranks' one-sided p by the normal approximation, null without differences. Differences have six digits."""
    with_sizes = pairs.crossJoin(F.broadcast(sizes.agg(F.collect_list("k").alias("ks"))))
    schema = "k long, it long, s long, n long, w_plus double, cubes double"
    sums = over_orders(with_sizes, key, {"diff": F.col("diff"), "ks": F.col("ks")}, _ranked_prefixes, schema, iterations, seed + 3).withColumn("k", F.col("k").cast("int"))
    return sums.select("k", "it", F.round(F.col("s") / 1e6 / F.col("k"), 9).alias("mean"), normal_tail(signed_rank_z(F.col("n"), F.col("w_plus"), F.col("cubes"))).alias("p"))


def _running_sums(table: pa.Table, orders: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """k, positive, s: over the orders, how often the sum of the first k pairs is positive, and the total of these sums."""
    micro = table.column("micro").to_numpy()
    positive, total = np.zeros(micro.size, np.int64), np.zeros(micro.size, np.int64)
    for _, order in orders:
        so_far = np.cumsum(micro[order])
        positive += so_far > 0
        total += so_far
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, micro.size + 1)), pa.array(positive), pa.array(total)], names=["k", "positive", "s"])


def size_sweep(pairs: DataFrame, key: str, least: int = 4, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """k, positive, mean of the subsamples of every size from `least` to all pairs, from running sums over one order per iteration."""
    run = over_orders(pairs, key, {"micro": F.round(F.col("diff") * 1e6).cast("long")}, _running_sums, "k long, positive long, s long", iterations, seed + 3)
    by_size = run.where(F.col("k") >= least).groupBy("k").agg(F.sum("positive").alias("positive"), F.sum("s").alias("s"))
    return by_size.select("k", F.round(F.col("positive") / iterations, 6).alias("positive"), F.round(F.col("s") / F.col("k") / iterations / 1e6 + 1e-9, 6).alias("mean"))


def value_ranks(df: DataFrame, key: str, value: str, by: list[str] | None = None) -> DataFrame:
    """df plus rank and total by (value, key) within `by`, for values of which many may be equal.

    Distinct values are counted and their counts summed up in ranges; equal values
    are then numbered by key in ranges of the key's first characters, so that neither a
    frequent value nor a frequent range is sorted in one task.
    """
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_m")).withColumn("_range", F.floor(F.col(value) * 100))
    ranges = counts.groupBy(*by, "_range").agg(F.sum("_m").alias("_rm"))
    w = Window.partitionBy(*by)
    earlier = F.coalesce(F.sum("_rm").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select(*by, "_range", earlier.alias("_earlier"), F.sum("_rm").over(w).alias("total"))
    inside = F.coalesce(F.sum("_m").over(Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.withColumn("_inside", inside).join(offsets, [*by, "_range"]).select(*by, value, (F.col("_earlier") + F.col("_inside")).alias("_before"), "total")
    tied = ranked(df, F.left(F.col(key), F.lit(PREFIX)), [F.col(key)], [*by, value]).withColumnRenamed("rank", "_tie").drop("total")
    return tied.join(first, [*by, value]).select(*df.columns, (F.col("_before") + F.col("_tie")).alias("rank"), "total")


#: Characters of a key by which rows of one value are dealt into ranges that are sorted side by side.
PREFIX = 12


def ecdf(df: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """by, key, value, y: i/n of the sorted values; equal values have different y, by key; null values are left out."""
    r = value_ranks(df.where(F.col(value).isNotNull()), key, value, [by])
    return r.select(by, key, value, F.round(F.col("rank") / F.col("total"), 6).alias("y"))
