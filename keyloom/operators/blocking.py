"""Blocking reads: clients wait at keys, first come first served, and writes wake them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..relations import rank


def serve(waiters: DataFrame, arrivals: DataFrame, order: list[Column]) -> DataFrame:
    """``waiters(client, key, since)`` and what arrives at the keys: the n-th waiter of a
    key gets its n-th arrival in ``order``. Clients that get nothing go on waiting."""
    queue = waiters.withColumn("turn", rank([F.col("since"), F.col("client")]))
    got = arrivals.withColumn("turn", rank(order))
    return queue.join(got, ["key", "turn"]).drop("since")


def served_lists(waiters: DataFrame, items: DataFrame, right: bool = False) -> DataFrame:
    """BLPOP and BRPOP on ``list_items``."""
    return serve(waiters, items, [F.desc("pos") if right else F.asc("pos")]).select("client", "key", "value")


def served_zsets(waiters: DataFrame, zset: DataFrame, largest: bool = False) -> DataFrame:
    """BZPOPMIN and BZPOPMAX."""
    order = [F.desc("score"), F.desc("member")] if largest else [F.asc("score"), F.asc("member")]
    return serve(waiters, zset, order).select("client", "key", "member", "score")


def timed_out(waiters: DataFrame, served: DataFrame, now: int, timeout: int) -> DataFrame:
    return waiters.join(served.select("client"), "client", "left_anti").where(F.col("since") + timeout <= now).select("client")
