"""Problem 7: documents in containers of fixed capacity, with as little unused space as possible.

Only sizes matter for the plan, and there are at most `capacity` of them: the
plan is made from their counts, which are bounded whatever the number of items.
Each step takes the largest size that is left and fills its container to the least
slack: a bitset holds which sums can be reached with the sizes still there, the
fullest is taken and led back to counts. The same filling is repeated as often as
the counts allow. Items then get their containers by their rank among the items
of their size, in joins with the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import keep

#: Items of one size are ranked in so many parts at least, and in one part a million items.
CAPACITY, SALTS = 2048, 64


def _fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Sizes and how often each, that together come closest to the room without exceeding it."""
    reach, mask, lots = 1, (1 << (room + 1)) - 1, []
    for size in sorted((s for s in counts if s <= room), reverse=True):
        have, lot = min(counts[size], room // size), 1
        while have:
            take = min(lot, have)
            lots.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            have, lot = have - take, lot * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for size, take, before in reversed(lots):
        if not before >> at & 1:
            out[size] = out.get(size, 0) + take
            at -= size * take
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, dict[int, int]]]:
    """(first container, how many, filling) for all items of sizes from 1 to the capacity; a filling says how often each size occurs."""
    left, out, first = {s: n for s, n in counts.items() if n > 0}, [], 0
    while left:
        top = max(left)
        left[top] -= 1
        filling = _fullest({s: n for s, n in left.items() if n > 0}, capacity - top)
        left[top] += 1
        filling[top] = filling.get(top, 0) + 1
        times = min(left[s] // n for s, n in filling.items())
        out.append((first, times, filling))
        first += times
        for s, n in filling.items():
            left[s] -= times * n
            if not left[s]:
                del left[s]
    return out


def parts(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """key, part, size: an item over the capacity as whole containers and a rest, any other as itself; sizes null or 0 have no part."""
    whole = F.floor(F.col(size) / capacity).cast("int")
    rest = (F.col(size) % capacity).cast("int")
    each = F.concat(F.array_repeat(F.lit(capacity), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    return sizes.where(F.col(size) > 0).select(key, F.posexplode(each).alias("part", "size"))


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """key, part, size, container: every part of every item in one container, none over its capacity.

    Items of null or no size are in no container. Repeated keys are items of their
    own. Ties, items of one size, are placed in an order given by a hash of the key
    and the key, so the containers' contents don't depend on partitions.
    """
    items = keep(parts(sizes, key, size, capacity))
    salts = SALTS + items.count() // 1_000_000
    salted = items.withColumn("salt", F.pmod(F.xxhash64(key, "part"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))  # at most capacity x salts rows
    before = F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = groups.select("size", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r["size"]: r["n"] for r in groups.groupBy("size").agg(F.sum("n").alias("n")).toLocalIterator()}
    rows, used = [], dict.fromkeys(counts, 0)
    for first, times, filling in plan(counts, capacity):
        for s, n in filling.items():
            rows.append((s, used[s], used[s] + times * n, n, first))
            used[s] += times * n
    steps = sizes.sparkSession.createDataFrame(rows, "size int, from_rank long, to_rank long, each int, first long")
    place = F.row_number().over(Window.partitionBy("size", "salt").orderBy(key, "part"))
    ranked = salted.withColumn("place", place).join(offsets, ["size", "salt"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    inside = (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    container = F.col("first") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("each"))
    return ranked.join(F.broadcast(steps), "size").where(inside).select(key, "part", "size", container.cast("long").alias("container"))


def usage(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, unused, share_unused, fewest containers that could hold the tokens."""
    each = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("items"))
    tokens = F.coalesce(F.sum("used"), F.lit(0))
    return each.agg(F.count("*").alias("containers"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), tokens.alias("tokens")).select(
        "containers", "items", "tokens", (F.col("containers") * capacity - F.col("tokens")).alias("unused"),
        F.when(F.col("containers") > 0, F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6)).alias("share_unused"),
        F.ceil(F.col("tokens") / capacity).alias("least_containers"),
    )
