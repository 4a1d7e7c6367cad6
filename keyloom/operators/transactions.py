"""Transactions as one plan: queued writes that are applied together, if what was watched
has not changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run(state: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """MULTI ... EXEC: each step sees what the one before left."""
    for step in steps:
        state = step(state)
    return state


def unchanged(state: DataFrame, watched: DataFrame) -> DataFrame:
    """One row if each of ``watched(key, value)``, as read before, is still so; else none."""
    here = state.select("key", F.col("value").alias("is_now"))
    bad = watched.join(here, "key", "left").where(~F.col("value").eqNullSafe(F.col("is_now"))).agg(F.count(F.lit(1)).alias("bad"))
    return bad.where("bad = 0").select(F.lit(True).alias("unchanged"))


def exec_if_unchanged(state: DataFrame, watched: DataFrame, writes: DataFrame) -> DataFrame:
    """The state after ``writes(key, value)``, or as it was when a watched key changed."""
    good = writes.join(F.broadcast(unchanged(state, watched))).select("key", F.col("value").alias("new"))  # one row at most
    both = state.select("key", "value").join(good, "key", "full")
    return both.select("key", F.coalesce("new", "value").alias("value"))


class Queue:
    """Writes that wait for ``execute``; ``discard`` drops them and what was watched."""

    def __init__(self, state: DataFrame):
        self.state, self.steps, self.watched = state, [], None

    def watch(self, seen: DataFrame) -> None:
        self.watched = seen if self.watched is None else self.watched.unionByName(seen)

    def unwatch(self) -> None:
        self.watched = None

    def add(self, step: Callable[[DataFrame], DataFrame]) -> None:
        self.steps.append(step)

    def discard(self) -> DataFrame:
        self.steps, self.watched = [], None
        return self.state

    def execute(self) -> DataFrame:
        """The state after all steps, or as it was when a watched (key, value) changed."""
        after = run(self.state, *self.steps)
        if self.watched is not None:
            fine = F.broadcast(unchanged(self.state, self.watched))  # one row at most
            good, bad = after.join(fine), self.state.join(fine, how="left_anti")
            after = good.drop("unchanged").unionByName(bad)
        self.discard()
        return after
