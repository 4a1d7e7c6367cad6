"""Bitmaps: relation ``bits(key, off)`` of the bits that are set, the highest bit of a byte
first. Counts and combinations are aggregations over offsets; nothing is padded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..relations import rank


def get(bits: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(key, off)`` with bit 0 or 1."""
    return asked.join(bits.select("key", "off", F.lit(1).alias("hit")), ["key", "off"], "left").select("key", "off", F.coalesce("hit", F.lit(0)).alias("bit"))


def put(bits: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``incoming(key, off, bit)``: (state after, the bits before)."""
    on = incoming.where(F.col("bit") == 1).select("key", "off")
    off = incoming.where(F.col("bit") == 0).select("key", "off")
    return bits.join(off, ["key", "off"], "left_anti").unionByName(on).distinct(), get(bits, incoming.select("key", "off"))


def _span(start: int, end: int, unit: str) -> Column:
    """Offsets from start to end; negative ones count from the last byte (or its last bit)."""
    size = (F.floor(F.col("top") / 8) + 1) * (8 if unit == "BIT" else 1)
    lo = F.lit(start) if start >= 0 else F.greatest(size + start, F.lit(0))
    hi = F.least(F.lit(end) if end >= 0 else size + end, size - 1)
    at = F.col("off") if unit == "BIT" else F.floor(F.col("off") / 8)
    return at.between(lo, hi)


def _topped(bits: DataFrame) -> DataFrame:
    return bits.join(bits.groupBy("key").agg(F.max("off").alias("top")), "key")


def count(bits: DataFrame, start: int = 0, end: int = -1, unit: str = "BYTE") -> DataFrame:
    rows = bits if (start, end) == (0, -1) else _topped(bits).where(_span(start, end, unit))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def position(bits: DataFrame, bit: int = 1, start: int = 0) -> DataFrame:
    """The first offset from ``start`` on with the bit. The first 0 is where the run of 1s
    that covers ``start`` ends: offsets minus their rank are constant along a run."""
    rows = bits.where(F.col("off") >= start)
    if bit:
        return rows.groupBy("key").agg(F.min("off").alias("pos"))
    run = rows.withColumn("gap", F.col("off") - rank([F.col("off")])).where(F.col("gap") == start)
    ends = run.groupBy("key").agg((F.max("off") + 1).alias("pos"))
    return bits.select("key").distinct().join(ends, "key", "left").select("key", F.coalesce("pos", F.lit(start)).alias("pos"))


def combine(bits: DataFrame, how: str, keys: list[str]) -> DataFrame:
    """Offsets that are set in AND, OR, XOR, ONE, DIFF (first only), DIFF1 (not the first),
    ANDOR (first and any other) of ``keys``, or NOT of one up to its last byte."""
    rows = bits.where(F.col("key").isin(keys))
    if how == "NOT":
        last = rows.agg((F.floor(F.max("off") / 8) * 8 + 7).alias("last"))
        return last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("off")).join(rows, "off", "left_anti")
    first, rest = F.max(F.col("key") == keys[0]), F.count_if(F.col("key") != keys[0])
    n = F.count(F.lit(1))
    rule = {"AND": n == len(keys), "OR": n > 0, "XOR": n % 2 == 1, "ONE": n == 1, "DIFF": first & (rest == 0), "DIFF1": ~first, "ANDOR": first & (rest > 0)}[how]
    return rows.groupBy("off").agg(rule.alias("on")).where("on").select("off")


def field(bits: DataFrame, kind: str, offset: int) -> DataFrame:
    """BITFIELD GET of ``u8``-like or ``i8``-like numbers of each key."""
    width = int(kind[1:])
    at = F.col("off") - offset
    inside = (at >= 0) & (at < width)
    sign = (at == 0) & F.lit(kind[0] == "i")
    part = F.when(inside, F.when(sign, -F.shiftleft(F.lit(1).cast("long"), width - 1)).otherwise(F.expr(f"shiftleft(1L, cast(greatest(least({width - 1} - (off - {offset}), 62), 0) as int))"))).otherwise(F.lit(0))
    return bits.groupBy("key").agg(F.sum(part).cast("long").alias("value"))


def overflow(value: Column, kind: str, mode: str = "WRAP") -> Column:
    """A sum brought into the range of ``kind``: WRAP, SAT, or FAIL (null)."""
    width, signed = int(kind[1:]), kind[0] == "i"
    lo, hi = (-(1 << width - 1), (1 << width - 1) - 1) if signed else (0, (1 << width) - 1)
    if mode == "SAT":
        return F.least(F.greatest(value, F.lit(lo)), F.lit(hi))
    if mode == "FAIL":
        return F.when(value.between(lo, hi), value)
    return F.pmod(value - lo, F.lit(hi - lo + 1)) + lo


def increment(bits: DataFrame, kind: str, offset: int, by: int, mode: str = "WRAP") -> DataFrame:
    return field(bits, kind, offset).withColumn("value", overflow(F.col("value") + by, kind, mode))
