"""The relations that stand for the data types, and helpers that all operators use.

Each data type is one long table with the user's key as a column, so an operator works on
all keys at once. Times are epoch milliseconds (``expires_at`` null: never).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of each relation.
COLUMNS = {
    "kv": ("key", "value", "expires_at"),
    "hash_fields": ("key", "field", "value", "expires_at"),
    "list_items": ("key", "pos", "value"),
    "set_members": ("key", "member"),
    "zset": ("key", "member", "score"),
    "stream": ("key", "ms", "seq", "fields"),
    "groups": ("key", "grp", "last_ms", "last_seq"),
    "pel": ("key", "grp", "ms", "seq", "consumer", "delivered_at", "n_delivered"),
    "ts_series": ("key", "labels", "retention_ms", "dup_policy"),
    "ts_samples": ("key", "ts", "value"),
    "json_docs": ("key", "doc"),
    "vectors": ("key", "element", "vec", "attrs"),
    "bits": ("key", "off"),
}


def relation(df: DataFrame, kind: str, **columns: str | Column) -> DataFrame:
    """Any DataFrame as the relation ``kind``: ``relation(df, "zset", key=..., ...)``."""
    return df.select(*((c if isinstance(c, Column) else F.col(c)).alias(name) for name, c in ((n, columns[n]) for n in COLUMNS[kind] if n in columns)))


def live(df: DataFrame, now: int | Column) -> DataFrame:
    """The rows that have not expired."""
    return df.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def normal(score: Column) -> Column:
    """-0.0 as 0.0, so that all engines order scores alike."""
    return score + F.lit(0.0)


def rank(by: list[Column], key: str | list[str] = "key") -> Column:
    """0-based position within a key."""
    keys = [key] if isinstance(key, str) else key
    return (F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1).cast("long")


def firsts(df: DataFrame, by: list[Column], count: int, key: str | list[str] = "key", name: str = "n") -> DataFrame:
    """The first ``count`` rows of each key, numbered from 0. The bound is put on the row
    number itself, so that every task keeps no more than ``count`` rows of a key before
    anything is shuffled."""
    keys = [key] if isinstance(key, str) else key
    numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return numbered.where(F.col(name) <= count).withColumn(name, (F.col(name) - 1).cast("long"))


#: Keys with more rows are ranked in parts, and how many parts.
SPREAD_ROWS, SPREAD_PARTS = 100_000, 256


def spread_rank(df: DataFrame, by: list[str], on: Column, name: str, reverse: bool = False) -> DataFrame:
    """``df`` with ``name``, the 0-based position of each row in its key by ``by``, and with
    ``card``, the rows of its key. Keys of many rows are cut into parts of equal width along
    the number ``on``, which must not fall as ``by`` rises; parts are ranked on their own
    and their counts added up, so that no task sorts such a key."""
    on = F.when(on.isNull() | F.isnan(on), F.lit(float("-inf"))).otherwise(on)  # nulls come first
    finite = F.when(F.abs(on) < float("inf"), on)
    ends = df.groupBy("key").agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), F.count(F.lit(1)).alias("card")).withColumnRenamed("key", "_of")
    share = F.when(on == float("-inf"), 0.0).when(on == float("inf"), 1.0).otherwise((on / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2))
    part = F.when((F.col("card") > SPREAD_ROWS) & (F.col("_lo") < F.col("_hi")), F.floor(share * (SPREAD_PARTS - 1))).otherwise(0).cast("int")
    cut = df.join(ends, F.col("key").eqNullSafe(F.col("_of"))).withColumn("_part", -part if reverse else part).drop("_lo", "_hi", "_of")
    order = [F.desc(c) if reverse else F.asc(c) for c in by]
    inside = cut.withColumn("_n", F.row_number().over(Window.partitionBy("key", "_part").orderBy(*order)))
    ahead = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("_size"))
    base = sizes.select(F.col("key").alias("_key"), F.col("_part").alias("_at"), F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_base"))
    both = inside.join(base, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")))
    return both.withColumn(name, (F.col("_base") + F.col("_n") - 1).cast("long")).drop("_part", "_n", "_key", "_at", "_base")


def glob(column: Column, pattern: str, substring: bool = False) -> Column:
    """Whether a glob pattern (``* ? [a-c] [^a] \\x``) covers the whole string; with
    ``substring`` a pattern without wildcards may match anywhere."""
    if substring and not any(c in pattern for c in "*?[\\"):
        return F.contains(column, F.lit(pattern))
    return column.rlike(glob_regex(pattern))


def glob_regex(pattern: str) -> str:
    out, i = [], 0
    quote = lambda c: "\\" + c if c in r"\.^$*+?{}[]|()-&" else c
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(quote(pattern[i]))
        elif end > 0:
            body = pattern[i + 1 : end]
            negate = body[:1] in "^!"
            body = body[1:] if negate else body
            out.append("[" + "^" * negate + "".join(quote(x) if x != "-" else "-" for x in body) + "]")
            i = end
        else:
            out.append(quote(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"
