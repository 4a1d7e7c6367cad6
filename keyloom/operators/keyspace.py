"""Keys of any type: relation ``kv(key, value, expires_at)``; deadlines in milliseconds.

Writes are sets of rows, of which the last by ``seq`` wins. Nothing is updated in place: an
operator returns the state after it, or what each key answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..relations import firsts, glob, live, rank
from .hashes import allowed
from .strings import xxh3

KEEP = "keep"


def last(incoming: DataFrame, first: bool = False) -> DataFrame:
    return incoming.groupBy("key").agg((F.min_by if first else F.max_by)("value", "seq").alias("new"))


def put(kv: DataFrame, incoming: DataFrame, now: int, only: Column | str | tuple[str, str] | None = None, expires: Column | str | None = None) -> DataFrame:
    """Upsert ``incoming(key, value, seq)``. ``only``: NX, XX, (IFDEQ or IFDNE, hex digest of
    the value before), or a condition on ``value`` (the value before, null if missing). ``expires``: a deadline, KEEP, or none.
    Result: key, value, expires_at, old_value, applied, written (tried)."""
    both = live(kv, now).withColumn("here", F.lit(True)).join(last(incoming, first=isinstance(only, str) and only == "NX"), "key", "full")
    here, tried = F.col("here").isNotNull(), F.col("new").isNotNull()
    if isinstance(only, tuple):  # IFDEQ or IFDNE and a digest
        same = xxh3(F.col("value")) == only[1].lower()
        only = same if only[0] == "IFDEQ" else ~same
    rule = {"NX": ~here, "XX": here}[only] if isinstance(only, str) else (F.lit(True) if only is None else F.coalesce(only, F.lit(False)))
    take = tried & rule
    until = F.col("expires_at") if isinstance(expires, str) else (F.lit(None).cast("long") if expires is None else expires)
    out = both.select(
        "key",
        F.when(take, F.col("new")).otherwise(F.col("value")).alias("value"),
        F.when(take, until).otherwise(F.col("expires_at")).alias("expires_at"),
        F.col("value").alias("old_value"), take.alias("applied"), tried.alias("written"), here.alias("here"),
    )
    return out.where(F.col("here") | F.col("applied") | F.col("written")).drop("here")


def put_all_or_none(kv: DataFrame, incoming: DataFrame, now: int, only: str = "NX") -> DataFrame:
    """The writes, if none (NX) or all (XX) of their keys exist; else no row."""
    new = last(incoming).select("key", F.col("new").alias("value"))
    found = new.join(live(kv, now).select("key"), "key", "left_semi").agg(F.count(F.lit(1)).alias("found"))
    asked = new.agg(F.count(F.lit(1)).alias("asked"))
    fine = found.join(asked).select((F.col("found") == (0 if only == "NX" else F.col("asked"))).alias("fine")).where("fine")
    return new.join(F.broadcast(fine)).drop("fine")  # the right side is one row at most


def get(kv: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """``asked(key, ...)`` with value, null where missing."""
    return asked.join(live(kv, now).select("key", "value"), "key", "left")


def delete(kv: DataFrame, gone: DataFrame, now: int, where: Column | tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(state after, rows that were deleted). ``where``: a condition on ``value``, or IFDEQ
    or IFDNE and the hex digest of a value."""
    if isinstance(where, tuple):
        same = xxh3(F.col("value")) == where[1].lower()
        where = same if where[0] == "IFDEQ" else ~same
    left = live(kv, now)
    hit = left.join(gone.select("key").distinct(), "key", "left_semi")
    if where is not None:
        hit = hit.where(where)
    return left.join(hit.select("key"), "key", "left_anti"), hit


def exists(kv: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """How many of the keys asked for exist; a key asked for twice counts twice."""
    return asked.join(live(kv, now).select("key"), "key").agg(F.count(F.lit(1)).alias("n"))


def rename(kv: DataFrame, names: DataFrame, now: int, only_new: bool = False, copy: bool = False) -> DataFrame:
    """The state after moving (or copying) each ``names(key, to)``; a target that exists is
    overwritten, or with ``only_new`` left alone."""
    left = live(kv, now)
    moves = names.join(left, "key")
    if only_new:
        moves = moves.join(left.select(F.col("key").alias("to")), "to", "left_anti")
    new = moves.select(F.col("to").alias("key"), "value", "expires_at")
    gone = new.select("key") if copy else new.select("key").union(moves.select("key"))
    return left.join(gone, "key", "left_anti").unionByName(new)


def matching(kv: DataFrame, pattern: str, now: int) -> DataFrame:
    return live(kv, now).where(glob(F.col("key"), pattern)).select("key")


def scan(kv: DataFrame, now: int, after: str = "", count: int = 10, pattern: str | None = None) -> DataFrame:
    """The next ``count`` keys after ``after``: a top-k, not a full sort."""
    got = live(kv, now).where(F.col("key") > after)
    if pattern is not None:
        got = got.where(glob(F.col("key"), pattern))
    return got.select("key").orderBy("key").limit(count)


def random_key(kv: DataFrame, now: int, seed: int = 0) -> DataFrame:
    return live(kv, now).select("key").orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(1)


def expire(kv: DataFrame, asked: DataFrame, until: Column, now: int, only: str | None = None) -> DataFrame:
    """Per key asked for: applied (0 or 1) and the deadline after it (a past one deletes)."""
    both = asked.join(live(kv, now).withColumn("here", F.lit(True)), "key", "left")
    ok = F.col("here").isNotNull() & F.coalesce(allowed(only, F.col("expires_at"), until), F.lit(False))
    return both.select("key", ok.cast("int").alias("applied"), F.when(ok, until).otherwise(F.col("expires_at")).alias("expires_at"))


def ttl(kv: DataFrame, asked: DataFrame, now: int, unit: int = 1000, absolute: bool = False) -> DataFrame:
    """-2 missing, -1 without deadline, else what is left, or the deadline."""
    both = asked.join(live(kv, now).withColumn("here", F.lit(True)), "key", "left")
    left = F.col("expires_at") if absolute else F.col("expires_at") - now
    return both.select("key", F.when(F.col("here").isNull(), -2).when(F.col("expires_at").isNull(), -1).otherwise(F.floor(left / unit)).cast("long").alias("ttl"))


def persist(kv: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    both = asked.join(live(kv, now), "key", "left")
    return both.select("key", F.col("expires_at").isNotNull().cast("int").alias("removed"))


def catalog(now: int, **relations: DataFrame) -> DataFrame:
    """(key, type) over several relations: ``catalog(now, string=kv, hash=fields, ...)``."""
    parts = [live(r, now) if "expires_at" in r.columns else r for r in relations.values()]
    keys = [r.select(F.col("key").cast("string").alias("key")).distinct().withColumn("type", F.lit(t)) for t, r in zip(relations, parts)]
    out = keys[0]
    for k in keys[1:]:
        out = out.unionByName(k)
    return out


def encoding(kind: str, size: Column, widest: Column) -> Column:
    """Name of the compact or the general encoding, by the limits of each type."""
    entries, width = {"hash": (128, 64), "zset": (128, 64), "set": (128, 64)}[kind]
    general = {"hash": "hashtable", "zset": "skiplist", "set": "hashtable"}[kind]
    return F.when((size <= entries) & (widest <= width), "listpack").otherwise(general)


def string_encoding(value: Column) -> Column:
    return F.when(value.try_cast("bigint").isNotNull(), "int").when(F.octet_length(value) <= 44, "embstr").otherwise("raw")


def dump(kv: DataFrame, now: int) -> DataFrame:
    return live(kv, now).select("key", F.to_json(F.struct("value", "expires_at")).alias("blob"))


def restore(blobs: DataFrame) -> DataFrame:
    x = F.from_json("blob", "value string, expires_at long")
    return blobs.select("key", x.value.alias("value"), x.expires_at.alias("expires_at"))


def sort(items: DataFrame, by: DataFrame | None = None, get: list[tuple[str, DataFrame]] = (), alpha: bool = False, descending: bool = False, offset: int = 0, count: int = -1) -> DataFrame:
    """``items(key, pos, value)`` of each key in order: by number (or text with ``alpha``)
    of the value, or of ``by(value, weight)`` where a missing weight counts as 0. Ties keep
    their order, and descending reverses them too. ``get``: (name, (value, found)) joined
    to each item. Result: key, rank, value, and a column per ``get``."""
    rows = items
    weight = F.col("value")
    if by is not None:
        rows = rows.join(by.withColumnRenamed("weight", "_weight"), "value", "left")
        weight = F.coalesce("_weight", F.lit("0"))
    weight = weight.cast("string") if alpha else weight.cast("double")
    order = [F.desc("_by"), F.desc("pos")] if descending else [F.asc("_by"), F.asc("pos")]
    rows = rows.withColumn("_by", weight)
    rows = firsts(rows, order, offset + count, name="rank") if count >= 0 else rows.withColumn("rank", rank(order))
    out = rows.where(F.col("rank") >= offset).select("key", "rank", "value")
    for name, found in get:
        out = out.join(found.withColumnRenamed("found", name), "value", "left")
    return out
