"""Time series: relations ``ts_samples(key, ts, value)`` and ``ts_series(key, labels, ...)``.

Times are milliseconds. A range is filtered, put into buckets, aggregated, ordered and
limited, in that order. Buckets start at ``align`` (the range's start by default; an open
start means the first sample).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..relations import firsts

#: Aggregators that one hash aggregation computes. TWA needs the sample before.
AGGREGATORS = {
    "avg": lambda v, t: F.avg(v),
    "first": lambda v, t: F.min_by(v, t),
    "last": lambda v, t: F.max_by(v, t),
    "min": lambda v, t: F.min(v),
    "max": lambda v, t: F.max(v),
    "sum": lambda v, t: F.sum(v),
    "range": lambda v, t: F.max(v) - F.min(v),
    "count": lambda v, t: F.count(v).cast("double"),
    "std.p": lambda v, t: F.stddev_pop(v),
    "std.s": lambda v, t: F.stddev_samp(v),
    "var.p": lambda v, t: F.var_pop(v),
    "var.s": lambda v, t: F.var_samp(v),
}


def settle(samples: DataFrame, policy: str = "LAST") -> DataFrame:
    """One value per key and time from ``(key, ts, value, seq)``; BLOCK keeps the first and
    counts as an error what comes after it (``blocked``)."""
    how = {"FIRST": F.min_by("value", "seq"), "BLOCK": F.min_by("value", "seq"), "LAST": F.max_by("value", "seq"), "MIN": F.min("value"), "MAX": F.max("value"), "SUM": F.sum("value")}[policy]
    out = samples.groupBy("key", "ts").agg(how.alias("value"), *([(F.count(F.lit(1)) - 1).alias("blocked")] if policy == "BLOCK" else []))
    return out


def increments(deltas: DataFrame) -> DataFrame:
    """The latest value plus each delta: ``(key, ts, delta)`` replayed in time order."""
    upto = Window.partitionBy("key").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select("key", "ts", F.sum("delta").over(upto).alias("value"))


def delete(samples: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """(samples left, how many were deleted per key)."""
    hit = F.col("ts").between(start, end)
    return samples.where(~hit), samples.where(hit).groupBy("key").agg(F.count(F.lit(1)).alias("deleted"))


def retain(samples: DataFrame, retention_ms: int, now: int) -> DataFrame:
    return samples.where(F.col("ts") >= now - retention_ms) if retention_ms else samples


def latest(samples: DataFrame) -> DataFrame:
    return samples.groupBy("key").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


def info(samples: DataFrame) -> DataFrame:
    return samples.groupBy("key").agg(F.count(F.lit(1)).alias("samples"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def _in_range(samples: DataFrame, start: int | None, end: int | None, filter_ts: list[int] | None, filter_value: tuple[float, float] | None) -> DataFrame:
    if start is not None:
        samples = samples.where(F.col("ts") >= start)
    if end is not None:
        samples = samples.where(F.col("ts") <= end)
    if filter_ts is not None:
        samples = samples.where(F.col("ts").isin(filter_ts))
    return samples if filter_value is None else samples.where(F.col("value").between(*filter_value))


def bucket(ts: Column, width: int, align: Column | int = 0) -> Column:
    at = F.lit(align) if isinstance(align, int) else align
    return ts - F.pmod(ts - at, F.lit(width))


#: Empty buckets that one row makes.
EMPTY_BLOCK = 10_000


def aggregate(samples: DataFrame, how: str, width: int, start: int | None = None, end: int | None = None, align: int | None = None, label: str = "start", empty: bool = False) -> DataFrame:
    """(key, ts, value) per bucket that has a value. ``label``: start, mid or end. Buckets
    without samples get NaN with ``empty``, and 0 if they are counted in any case."""
    if align is None and start is None:
        first = samples.groupBy("key").agg(F.min("ts").alias("_from"))
        rows, at = samples.join(first, "key"), F.col("_from")
    else:
        rows, at = samples, F.lit(align if align is not None else start).cast("long")
    rows = rows.withColumn("_bucket", bucket(F.col("ts"), width, at))
    if how == "twa":
        before = Window.partitionBy("key", "_bucket").orderBy("ts")
        area = (F.col("value") + F.lag("value").over(before)) / 2 * (F.col("ts") - F.lag("ts").over(before))
        got = rows.withColumn("_area", area).groupBy("key", "_bucket").agg(F.when(F.count(F.lit(1)) == 1, F.min("value")).otherwise(F.sum("_area") / width).alias("value"))
    else:
        got = rows.groupBy("key", "_bucket").agg(AGGREGATORS[how](F.col("value"), F.col("ts")).alias("value"))
    if empty or how == "count":
        edges = got.groupBy("key").agg(F.min("_bucket").alias("lo"), F.max("_bucket").alias("hi"))
        lo = F.col("lo") if start is None else bucket(F.lit(start).cast("long"), width, F.lit(align if align is not None else start).cast("long"))
        hi = F.col("hi") if end is None else F.lit(end).cast("long")
        # In blocks, so that no array grows with the range.
        block = width * EMPTY_BLOCK
        spans = edges.select("key", lo.alias("lo"), hi.alias("hi")).withColumn("from", F.explode(F.sequence("lo", "hi", F.lit(block).cast("long"))))
        every = spans.select("key", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + block - width, "hi"), F.lit(width).cast("long"))).alias("_bucket"))
        got = every.join(got, ["key", "_bucket"], "left").withColumn("value", F.coalesce("value", F.lit(0.0 if how == "count" else float("nan"))))
    shift = {"start": 0, "mid": width // 2, "end": width - 1}[label]
    return got.where(F.col("value").isNotNull()).select("key", (F.col("_bucket") + shift).alias("ts"), "value")


def range_of(samples: DataFrame, start: int | None = None, end: int | None = None, how: str | None = None, width: int = 0, align: int | None = None, label: str = "start", empty: bool = False, filter_ts: list[int] | None = None, filter_value: tuple[float, float] | None = None, count: int | None = None, reverse: bool = False) -> DataFrame:
    """RANGE and REVRANGE of every key at once."""
    got = _in_range(samples, start, end, filter_ts, filter_value)
    if how:
        got = aggregate(got, how, width, start, end, align, label, empty)
    if count is not None:
        got = firsts(got, [F.desc("ts") if reverse else F.asc("ts")], count).drop("n")
    return got.select("key", "ts", "value")


def label_filter(text: str) -> Column:
    """``l=v``, ``l!=v`` (also where l is missing), ``l=(a,b)``, ``l!=(a,b)``, ``l=`` (l is
    there) and ``l!=`` (l is not there), on the map ``labels``."""
    name, sign, value = text.partition("!=" if "!=" in text else "=")
    negated = sign == "!="
    own = F.col("labels")[name]
    if not value:
        return own.isNull() if negated else own.isNotNull()
    values = [v for v in value[1:-1].split(",") if v] if value[0] == "(" and value[-1] == ")" else [value]
    hit = F.coalesce(own.isin(values), F.lit(False))
    return ~hit if negated else hit


def query_index(series: DataFrame, *filters: str) -> DataFrame:
    for f in filters:
        series = series.where(label_filter(f))
    return series


def multi_range(samples: DataFrame, series: DataFrame, *filters: str, group: str | None = None, reduce: str = "sum", **kind) -> DataFrame:
    """MRANGE: the ranges of all series that match; with ``group``, the values that series
    of one label value have at the same time are reduced (no label: group "")."""
    wanted = query_index(series, *filters).select("key", "labels")
    got = range_of(samples.join(wanted.select("key"), "key", "left_semi"), **kind)
    if group is None:
        return got
    named = got.join(wanted, "key").select(F.coalesce(F.col("labels")[group], F.lit("")).alias("key"), "ts", "value")
    return named.groupBy("key", "ts").agg(AGGREGATORS[reduce](F.col("value"), F.col("ts")).alias("value"))


def multi_get(samples: DataFrame, series: DataFrame, *filters: str) -> DataFrame:
    wanted = query_index(series, *filters).select("key")
    return latest(samples.join(wanted, "key", "left_semi"))


def rule(samples: DataFrame, target: Column, how: str, width: int, align: int = 0) -> DataFrame:
    """What a downsampling rule has written to ``target`` (a name made from key)."""
    return aggregate(samples, how, width, align=align).withColumn("key", target)


def create_rules(rules: DataFrame) -> DataFrame:
    """``rules(source, target, how, width)``, one for each pair; a series is no rule's source
    and target at once."""
    made = rules.dropDuplicates(["source", "target"])
    return made.join(made.select(F.col("target").alias("source")).distinct(), "source", "left_anti")


def delete_rules(rules: DataFrame, gone: DataFrame) -> DataFrame:
    """The rules without those of ``gone(source, target)``."""
    return rules.join(gone.select("source", "target"), ["source", "target"], "left_anti")


def apply_rules(samples: DataFrame, rules: DataFrame, how: str, width: int) -> DataFrame:
    """The target series of all rules of one kind: (key, ts, value) by target."""
    mine = rules.where((F.col("how") == how) & (F.col("width") == width)).select(F.col("source").alias("key"), "target")
    got = aggregate(samples.join(mine.select("key").distinct(), "key", "left_semi"), how, width, start=0)
    return got.join(mine, "key").select(F.col("target").alias("key"), "ts", "value")
