"""Lists: relation ``list_items(key, pos, value)``, ordered by ``pos``.

Positions need only be ordered, not gapless: pushes at either end add positions below the
least or above the greatest, and indexes are counted when they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..relations import firsts, rank, spread_rank

BY_KEY = ["key"]


def indexed(items: DataFrame) -> DataFrame:
    """With ``index`` from the head and ``length``."""
    return spread_rank(items, ["pos"], F.col("pos").cast("double"), "index").withColumnRenamed("card", "length")


def length(items: DataFrame) -> DataFrame:
    return items.groupBy("key").agg(F.count(F.lit(1)).alias("length"))


def push(items: DataFrame, new: DataFrame, left: bool = False, existing: bool = False) -> DataFrame:
    """``new(key, seq, value)`` pushed one after the other at the tail, or the head."""
    ends = items.groupBy("key").agg((F.min if left else F.max)("pos").alias("end"))
    rows = new.join(ends, "key", "inner" if existing else "left")
    n = rank([F.col("seq")]) + 1
    pos = F.coalesce("end", F.lit(0 if left else -1)) + (-n if left else n)
    return items.select("key", "pos", "value").unionByName(rows.select("key", pos.alias("pos"), "value"))


def pop(items: DataFrame, count: int = 1, right: bool = False) -> tuple[DataFrame, DataFrame]:
    """(popped with ``n`` in order, rest)."""
    got = firsts(items, [F.desc("pos") if right else F.asc("pos")], count)
    return got, items.join(got.select("key", "pos"), ["key", "pos"], "left_anti")


def _clamped(start: int, end: int) -> Column:
    n = F.col("length")
    lo = F.lit(start) if start >= 0 else n + start
    hi = F.lit(end) if end >= 0 else n + end
    return F.col("index").between(lo, hi)


def slice_of(items: DataFrame, start: int, end: int) -> DataFrame:
    """LRANGE, and LTRIM's new state: inclusive, negative indexes from the tail."""
    if start >= 0 and end >= 0:
        return firsts(items, [F.asc("pos")], end + 1, name="index").where(F.col("index") >= start)
    if start < 0 and end < 0:
        tail = firsts(items, [F.desc("pos")], -start, name="index").where(F.col("index") >= -end - 1)
        return tail.join(length(items), "key").withColumn("index", F.col("length") - 1 - F.col("index")).drop("length")
    return indexed(items).where(_clamped(start, end)).drop("length")


def at(items: DataFrame, index: int) -> DataFrame:
    return slice_of(items, index, index)


def put(items: DataFrame, index: int, value: str) -> DataFrame:
    """The state with the value at ``index`` replaced; lists too short are left alone."""
    hit = F.col("index") == (F.lit(index) if index >= 0 else F.col("length") + index)
    return indexed(items).select("key", "pos", F.when(hit, F.lit(value)).otherwise(F.col("value")).alias("value"))


def insert(items: DataFrame, pivot: str, value: str, after: bool = False) -> DataFrame:
    """The state with ``value`` next to the first ``pivot`` of each list that has one; all
    positions are numbered anew."""
    first = items.where(F.col("value") == pivot).groupBy("key").agg(F.min("pos").alias("at"))
    numbered = indexed(items).join(first, "key", "left")
    behind = F.coalesce(F.col("pos") > F.col("at") if after else F.col("pos") >= F.col("at"), F.lit(False))
    moved = numbered.select("key", (F.col("index") + behind.cast("long")).alias("pos"), "value")
    new = numbered.where(F.col("pos") == F.col("at")).select("key", (F.col("index") + (1 if after else 0)).alias("pos"), F.lit(value).alias("value"))
    return moved.unionByName(new)


def positions(items: DataFrame, value: str, nth: int = 1, count: int = 1, most: int = 0) -> DataFrame:
    """Head-based indexes of matches, from the ``nth`` on (negative: from the tail), up to
    ``count`` (0: all), looking at ``most`` items at most (0: all)."""
    got = indexed(items)
    seen = F.col("index") if nth > 0 else F.col("length") - 1 - F.col("index")
    if most:
        got = got.where(seen < most)
    got = got.where(F.col("value") == value).withColumn("n", rank([F.asc("index") if nth > 0 else F.desc("index")]))
    got = got.where(F.col("n") >= abs(nth) - 1)
    return (got.where(F.col("n") < abs(nth) - 1 + count) if count else got).select("key", "index")


def remove(items: DataFrame, value: str, count: int = 0) -> DataFrame:
    """The state without the first ``count`` matches (negative: the last ones, 0: all)."""
    same = F.col("value").eqNullSafe(F.lit(value))
    if not count:
        return items.where(~same)
    order = F.asc("pos") if count > 0 else F.desc("pos")
    n = rank([order], ["key", "value"])
    return items.withColumn("n", n).where(~same | (F.col("n") >= abs(count))).drop("n")


def move(items: DataFrame, source, target, from_right: bool = False, to_left: bool = True) -> tuple[DataFrame, DataFrame]:
    """(moved item, state after) for LMOVE from one key to another."""
    one = pop(items.where(F.col("key") == source), 1, from_right)[0]
    moved = one.select(F.lit(target).cast(items.schema["key"].dataType).alias("key"), F.lit(0).alias("seq"), "value")
    left = items.join(one.select("key", "pos"), ["key", "pos"], "left_anti")
    return moved.select("key", "value"), push(left, moved, left=to_left)


def pop_first(items: DataFrame, keys: list, count: int = 1, right: bool = False) -> DataFrame:
    """Pop from the first of ``keys`` that has items (LMPOP, and a woken BLPOP)."""
    place = F.array_position(F.array(*map(F.lit, keys)), F.col("key"))
    some = items.where(F.col("key").isin(keys))
    first = some.agg(F.min(place).alias("place"))  # one row
    return pop(some.join(F.broadcast(first), place == F.col("place")).drop("place"), count, right)[0]
