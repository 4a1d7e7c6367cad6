"""Sets: relation ``set_members(key, member)`` without duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..relations import firsts, glob, rank


def add(sets: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new state, how many members were new per key)."""
    new = incoming.select("key", "member").distinct().join(sets, ["key", "member"], "left_anti")
    return sets.unionByName(new), card(new)


def remove(sets: DataFrame, gone: DataFrame) -> DataFrame:
    return sets.join(gone, ["key", "member"], "left_anti")


def card(sets: DataFrame) -> DataFrame:
    return sets.groupBy("key").agg(F.count(F.lit(1)).alias("card"))


def is_member(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(key, member, ...)`` with found (0 or 1)."""
    return asked.join(sets.withColumn("hit", F.lit(1)), ["key", "member"], "left").withColumn("found", F.coalesce("hit", F.lit(0))).drop("hit")


def members(sets: DataFrame) -> DataFrame:
    """One row per key with its members as a sorted array."""
    return sets.groupBy("key").agg(F.array_sort(F.collect_set("member")).alias("members"))


def sample(sets: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """``count`` distinct members per key by a seeded hash; a negative count draws that
    many with repetition."""
    if count >= 0:
        return firsts(sets, [F.xxhash64("key", "member", F.lit(seed)), F.col("member")], count).drop("n")
    numbered = sets.withColumn("n", rank([F.col("member")]))
    draws = card(sets).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(-count)))).withColumn("n", F.pmod(F.xxhash64("key", "draw", F.lit(seed)), F.col("card")))
    return draws.join(numbered, ["key", "n"]).select("key", "draw", "member")


def pop(sets: DataFrame, count: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(popped, rest)."""
    got = sample(sets, count, seed)
    return got, remove(sets, got)


def move(sets: DataFrame, source: str, target: str, moved: DataFrame) -> DataFrame:
    """``moved(member)`` from one key to another, where the source has them."""
    taken = sets.where(F.col("key") == source).join(moved, "member", "left_semi").select("key", "member")
    return remove(sets, taken).unionByName(taken.withColumn("key", F.lit(target))).distinct()


def union(sets: DataFrame, keys: list[str]) -> DataFrame:
    return sets.where(F.col("key").isin(keys)).select("member").distinct()


def inter(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Members that all keys have, by one aggregation whatever the number of keys."""
    n = sets.where(F.col("key").isin(keys)).groupBy("member").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") == len(set(keys))).select("member")


def diff(sets: DataFrame, keys: list[str]) -> DataFrame:
    rest = sets.where(F.col("key").isin(keys[1:])).select("member")
    return sets.where(F.col("key") == keys[0]).select("member").join(rest, "member", "left_anti")


def inter_card(sets: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    n = inter(sets, keys).agg(F.count(F.lit(1)).alias("card"))
    return n.select(F.least("card", F.lit(limit)).alias("card")) if limit else n


def store(result: DataFrame, key: str) -> DataFrame:
    return result.select(F.lit(key).alias("key"), "member")


def scan(sets: DataFrame, after: str = "", count: int = 10, pattern: str | None = None) -> DataFrame:
    """Keyset pages: the next ``count`` members of each key after ``after``."""
    got = sets.where(F.col("member") > after)
    if pattern is not None:
        got = got.where(glob(F.col("member"), pattern))
    return firsts(got, [F.col("member")], count).drop("n")
