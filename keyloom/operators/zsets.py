"""Sorted sets: relation ``zset(key, member, score)``, ordered by score, then member.

What is asked from either end of a key (``pop``, ``by_rank``, ``page``, ``sample``, ``scan``)
keeps a bounded number of rows in each task first (``relations.firsts``). Ranks from both
ends at once, and the ranks of given members, are counted in parts along the score
(``relations.spread_rank``), so that no task sorts a large key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..relations import firsts, glob, normal, spread_rank

UP = ["score", "member"]


def order(reverse: bool = False) -> list[Column]:
    return [F.desc(c) if reverse else F.asc(c) for c in UP]


def add(zset: DataFrame, incoming: DataFrame, only: str | None = None, better: str | None = None) -> DataFrame:
    """Upsert ``incoming(key, member, score, seq)``; ``only``: NX or XX, ``better``: GT or LT.
    Result: key, member, score, old_score, added, changed."""
    new = {"GT": F.max("score"), "LT": F.min("score")}.get(better or "", F.min_by("score", "seq") if only == "NX" else F.max_by("score", "seq"))
    last = incoming.where(~F.isnan("score")).groupBy("key", "member").agg(normal(new).alias("new"))
    both = zset.join(last, ["key", "member"], "full")
    old, fresh = F.col("score"), F.col("new")
    take = fresh.isNotNull()
    if only == "NX":
        take &= old.isNull()
    if only == "XX":
        take &= old.isNotNull()
    if better:
        take &= old.isNull() | ((fresh > old) if better == "GT" else (fresh < old))
    out = both.select("key", "member", F.when(take, fresh).otherwise(old).alias("score"), old.alias("old_score"), (take & old.isNull()).alias("added"), F.coalesce(take & (old.isNull() | (old != fresh)), F.lit(False)).alias("changed"))
    return out.where(F.col("score").isNotNull())


def increment(zset: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add up ``deltas(key, member, delta)``; members that are missing start at 0."""
    by = deltas.groupBy("key", "member").agg(F.sum("delta").alias("delta"))
    both = zset.join(by, ["key", "member"], "full")
    return both.select("key", "member", normal(F.coalesce("score", F.lit(0.0)) + F.coalesce("delta", F.lit(0.0))).alias("score"))


def remove(zset: DataFrame, members: DataFrame) -> DataFrame:
    return zset.join(members, ["key", "member"], "left_anti")


def scores(zset: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(key, member, ...)`` with the score, null where missing."""
    return asked.join(zset, ["key", "member"], "left")


def card(zset: DataFrame) -> DataFrame:
    return zset.groupBy("key").agg(F.count(F.lit(1)).alias("card"))


def ranked(zset: DataFrame, reverse: bool = False) -> DataFrame:
    """With rank and card (the key's members)."""
    return spread_rank(zset, UP, F.col("score"), "rank", reverse)


def rank_of(zset: DataFrame, asked: DataFrame, reverse: bool = False) -> DataFrame:
    """0-based rank and score of ``asked(key, member)``, where they are members."""
    got = ranked(zset, reverse).join(asked.select("key", "member").distinct(), ["key", "member"])
    return got.select("key", "member", "score", "rank")


def bound(value: str, low: bool) -> Column:
    """A score bound: a number, ``-inf``/``+inf``, or ``(number`` for an open one."""
    open_, number = value.startswith("("), float(value.removeprefix("("))
    s = F.col("score")
    if low:
        return s > number if open_ else s >= number
    return s < number if open_ else s <= number


def lex_bound(value: str, low: bool) -> Column:
    """A lexicographic bound: ``-``, ``+``, ``[x`` or ``(x``."""
    m = F.col("member")
    if value in "-+":
        return F.lit((value == "-") == low)
    x = F.lit(value[1:])
    if value[0] == "(":
        return m > x if low else m < x
    return m >= x if low else m <= x


def by_score(zset: DataFrame, low: str, high: str) -> DataFrame:
    return zset.where(bound(low, True) & bound(high, False))


def by_lex(zset: DataFrame, low: str, high: str) -> DataFrame:
    """Only keys whose scores are all equal have members in lexicographic order."""
    flat = zset.groupBy("key").agg((F.min("score") == F.max("score")).alias("flat")).where("flat").select("key")
    return zset.join(flat, "key", "left_semi").where(lex_bound(low, True) & lex_bound(high, False))


def page(zset: DataFrame, offset: int = 0, count: int = -1, reverse: bool = False) -> DataFrame:
    """``LIMIT offset count`` per key (a negative count: all)."""
    got = ranked(zset, reverse).drop("card") if count < 0 else firsts(zset, order(reverse), offset + count, name="rank")
    return got.where(F.col("rank") >= offset)


def by_rank(zset: DataFrame, first: int, last: int, reverse: bool = False) -> DataFrame:
    """Inclusive ranks; negative ones count from the end."""
    if first >= 0 and last >= 0:
        return firsts(zset, order(reverse), last + 1, name="rank").where(F.col("rank") >= first)
    if first < 0 and last < 0:  # from the other end
        tail = firsts(zset, order(not reverse), -first, name="rank").where(F.col("rank") >= -last - 1)
        return tail.join(card(zset), "key").withColumn("rank", F.col("card") - 1 - F.col("rank")).drop("card")
    lo = F.lit(first) if first >= 0 else F.greatest(F.col("card") + first, F.lit(0))
    hi = F.lit(last) if last >= 0 else F.col("card") + last
    return ranked(zset, reverse).where(F.col("rank").between(lo, hi)).drop("card")


def pop(zset: DataFrame, count: int, largest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(popped, rest)."""
    got = firsts(zset, order(largest), count, name="rank")
    return got, remove(zset, got.select("key", "member"))


def pop_first(zset: DataFrame, keys: list[str], count: int, largest: bool = False) -> DataFrame:
    """Pop from the first of ``keys`` that has members."""
    place = F.array_position(F.array(*map(F.lit, keys)), F.col("key"))
    some = zset.where(F.col("key").isin(keys))
    first = some.agg(F.min(place).alias("place"))
    return pop(some.join(F.broadcast(first), place == F.col("place")).drop("place"), count, largest)[0]


def sample(zset: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """``count`` distinct members of each key, by a seeded hash."""
    return firsts(zset, [F.xxhash64("key", "member", F.lit(seed)), F.col("member")], count, name="rank").drop("rank")


def _sources(zset: DataFrame, keys: list[str], weights: list[float] | None) -> DataFrame:
    w = F.element_at(F.create_map(*(x for k, v in zip(keys, weights or [1.0] * len(keys)) for x in (F.lit(k), F.lit(float(v))))), F.col("key"))
    return zset.where(F.col("key").isin(keys)).withColumn("score", F.col("score") * w)


def _combined(how: str) -> Column:
    """MIN and MAX pass over NaN (infinity times 0) where there is a number."""
    if how == "SUM":
        return normal(F.sum("score")).alias("score")
    number = F.when(~F.isnan("score"), F.col("score"))
    return normal(F.coalesce({"MIN": F.min, "MAX": F.max}[how](number), F.max("score"))).alias("score")


def union(zset: DataFrame, keys: list[str], weights: list[float] | None = None, how: str = "SUM") -> DataFrame:
    return _sources(zset, keys, weights).groupBy("member").agg(_combined(how))


def inter(zset: DataFrame, keys: list[str], weights: list[float] | None = None, how: str = "SUM") -> DataFrame:
    both = _sources(zset, keys, weights).groupBy("member").agg(_combined(how), F.count(F.lit(1)).alias("n"))
    return both.where(F.col("n") == len(set(keys))).drop("n")


def diff(zset: DataFrame, keys: list[str]) -> DataFrame:
    rest = zset.where(F.col("key").isin(keys[1:])).select("member")
    return zset.where(F.col("key") == keys[0]).join(rest, "member", "left_anti").select("member", "score")


def inter_card(zset: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    n = inter(zset, keys).agg(F.count(F.lit(1)).alias("card"))
    return n.select(F.least("card", F.lit(limit)).alias("card")) if limit else n


def store(result: DataFrame, key: str) -> DataFrame:
    """A result (member, score) as rows of a new key."""
    return result.select(F.lit(key).alias("key"), "member", "score")


def scan(zset: DataFrame, after: str = "", count: int = 10, pattern: str | None = None) -> DataFrame:
    """Keyset pages: the next ``count`` members of each key after ``after``."""
    got = zset.where(F.col("member") > after)
    if pattern is not None:
        got = got.where(glob(F.col("member"), pattern))
    return firsts(got, [F.col("member")], count, name="rank").drop("rank")

