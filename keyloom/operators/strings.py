"""Strings and counters. Lengths and offsets are bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def raw(value: Column) -> Column:
    return F.encode(F.coalesce(value, F.lit("")), "UTF-8")


def strlen(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0))


def getrange(value: Column, start: int, end: int) -> Column:
    """Bytes from ``start`` to ``end`` inclusive; negative positions count from the end."""
    b, n = raw(value), F.octet_length(raw(value))
    lo = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    hi = F.least(F.lit(end) if end >= 0 else n + end, n - 1)
    return F.when(lo <= hi, F.substring(b, lo + 1, hi - lo + 1)).otherwise(F.lit(b""))


def setrange(value: Column, offset: int, insert: bytes) -> Column:
    """Overwrite at a byte offset; a gap is filled with zero bytes."""
    if not insert:
        return raw(value)
    b = raw(value)
    padded = F.when(F.octet_length(b) < offset, F.rpad(b, F.lit(offset), F.lit(b"\0"))).otherwise(b)
    rest = F.substring(padded, F.lit(offset + len(insert) + 1), F.greatest(F.octet_length(padded) - offset - len(insert), F.lit(0)))
    return F.concat(F.substring(padded, F.lit(1), F.lit(offset)), F.lit(insert), rest)


def append(kv: DataFrame, parts: DataFrame) -> DataFrame:
    """Concatenate ``parts(key, value, seq)`` in order to each key; its length in bytes."""
    tail = parts.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x.value), "").alias("tail"))
    both = kv.select("key", "value").join(tail, "key", "full")
    text = F.concat(F.coalesce("value", F.lit("")), F.coalesce("tail", F.lit("")))
    return both.where(F.col("tail").isNotNull()).select("key", text.alias("value"), F.octet_length(text).alias("length"))


def increments(log: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Replay ``log(key, delta, seq)``: the counter after each step, null from where it
    overflows on, whatever the other keys do."""
    base = log if start is None else log.join(start.withColumnRenamed("value", "base"), "key", "left")
    first = F.lit(0) if start is None else F.coalesce("base", F.lit(0))
    running = F.try_sum("delta").over(Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return base.select("key", "seq", F.try_add(first, running).alias("value"))


def totals(log: DataFrame) -> DataFrame:
    """The counters at the end, by one aggregation."""
    return log.groupBy("key").agg(F.try_sum("delta").alias("value"))


def plain_number(value: Column) -> Column:
    """A double without exponent and without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.17f", F.round(value, 12)), "0+$", ""), r"\.$", "")


def previous(log: DataFrame) -> DataFrame:
    """Replay of writes ``log(key, value, seq)``: the value before each."""
    return log.withColumn("old", F.lag("value").over(Window.partitionBy("key").orderBy("seq")))


@F.pandas_udf(T.StringType())
def xxh3(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """xxh3-64 of the bytes in 16 hex digits."""
    import xxhash

    for values in parts:
        yield pd.Series([None if v is None else xxhash.xxh3_64_hexdigest(v.encode() if isinstance(v, str) else bytes(v)) for v in values])


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence in bytes of ASCII strings, without UDF: the
    rows of the dynamic program are folded one character of ``a`` at a time."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    zero = F.transform(F.concat(F.array(F.lit("")), chars(b)), lambda _: F.lit(0))

    def row(before: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            up, diagonal = F.get(before, j), F.get(before, j - 1)
            here = F.when(F.substring(b, j, F.lit(1)) == x, diagonal + 1).otherwise(F.greatest(up, F.element_at(acc, -1)))
            return F.concat(acc, F.array(here))

        return F.aggregate(F.when(F.length(b) > 0, F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1)))).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(chars(a), zero, row), -1)


_RANGE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("a_start", "a_end", "b_start", "b_end", "length")])


def lcs(min_match: int = 0):
    """UDF of two strings: struct of lcs, length and matches (contiguous ranges, last first)."""

    @F.pandas_udf(T.StructType([T.StructField("lcs", T.BinaryType()), T.StructField("length", T.IntegerType()), T.StructField("matches", T.ArrayType(_RANGE))]))
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for xs, ys in parts:
            yield pd.DataFrame([common_subsequence((x or "").encode(), (y or "").encode(), min_match) for x, y in zip(xs, ys)], columns=["lcs", "length", "matches"])

    return run


def common_subsequence(a: bytes, b: bytes, min_match: int = 0) -> tuple[bytes, int, list[tuple[int, int, int, int, int]]]:
    """The longest common subsequence, going up rather than left on ties."""
    import numpy as np

    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    other = np.frombuffer(b, np.uint8)
    for i, x in enumerate(a, 1):
        table[i, 1:] = np.maximum.accumulate(np.where(other == x, table[i - 1, :-1] + 1, table[i - 1, 1:]))
    i, j, out, ranges = len(a), len(b), bytearray(), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            if ranges and ranges[-1][0] == i and ranges[-1][2] == j:
                ranges[-1][0], ranges[-1][2] = i - 1, j - 1
            else:
                ranges.append([i - 1, i - 1, j - 1, j - 1])
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    found = [(s, e, t, f, e - s + 1) for s, e, t, f in ranges]
    return bytes(out[::-1]), len(out), [r for r in found if r[4] >= min_match]
