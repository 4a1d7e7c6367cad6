"""Streams: relation ``stream(key, ms, seq, ...)`` with ids (ms, seq), consumer groups, and
their pending entries ``pel(key, grp, ms, seq, consumer, delivered_at, n_delivered)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..relations import firsts, rank

ID = ["ms", "seq"]
MOST = (1 << 63) - 1


def id_of(row: str = "") -> Column:
    return F.struct(F.col(f"{row}ms"), F.col(f"{row}seq"))


def parsed(text: str, low: bool) -> tuple[int, int]:
    """``-``, ``+``, ``ms`` (all its entries) or ``ms-seq``."""
    if text in "-+":
        return (0, 0) if text == "-" else (MOST, MOST)
    ms, _, seq = text.partition("-")
    return int(ms), int(seq) if seq else (0 if low else MOST)


def literal(at: tuple[int, int]) -> Column:
    return F.struct(F.lit(at[0]).cast("long").alias("ms"), F.lit(at[1]).cast("long").alias("seq"))


def append(stream: DataFrame, entries: DataFrame) -> DataFrame:
    """``entries(key, at, n, ...)`` with ids for their milliseconds ``at``, in the order of
    ``n``. An id never goes back: a clock behind the last id takes that id's millisecond."""
    last = stream.groupBy("key").agg(F.max(F.struct("ms", "seq")).alias("last"))
    rows = entries.join(last, "key", "left")
    upto = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ms", F.greatest(F.max("at").over(upto), F.coalesce("last.ms", F.lit(0))))
    first = F.when(F.col("ms") == F.col("last.ms"), F.col("last.seq") + 1).otherwise(F.lit(0))
    return rows.withColumn("seq", (first + rank([F.col("n")], ["key", "ms"])).cast("long")).drop("last", "at", "n")


def between(stream: DataFrame, start: str = "-", end: str = "+", count: int | None = None, reverse: bool = False) -> DataFrame:
    """Entries with ids from start to end, the first (or last) ``count`` per key."""
    lo, hi = parsed(start, True), parsed(end, False)
    # The millisecond alone is compared too, so that files and row groups can be skipped.
    got = stream.where(F.col("ms").between(lo[0], hi[0]) & (id_of() >= literal(lo)) & (id_of() <= literal(hi)))
    if count is None:
        return got
    order = [F.desc(c) if reverse else F.asc(c) for c in ID]
    return firsts(got, order, count)


def after(stream: DataFrame, marks: DataFrame, count: int | None = None) -> DataFrame:
    """XREAD: entries of each key with ids greater than ``marks(key, last_ms, last_seq)``."""
    got = stream.join(marks, "key").where(id_of() > F.struct(F.col("last_ms").alias("ms"), F.col("last_seq").alias("seq"))).drop("last_ms", "last_seq")
    return got if count is None else firsts(got, [F.col(c) for c in ID], count).drop("n")


def length(stream: DataFrame) -> DataFrame:
    return stream.groupBy("key").agg(F.count(F.lit(1)).alias("length"))


def delete(stream: DataFrame, ids: DataFrame, pel: DataFrame | None = None, refs: str = "KEEPREF") -> tuple[DataFrame, DataFrame | None]:
    """(entries left, pending left). ``refs``: KEEPREF leaves pending references, DELREF
    removes them, ACKED deletes only what no group has pending."""
    ids = ids.select("key", *ID).distinct()
    if refs == "ACKED" and pel is not None:
        ids = ids.join(pel, ["key", *ID], "left_anti")
    left = stream.join(ids, ["key", *ID], "left_anti")
    return left, pel.join(ids, ["key", *ID], "left_anti") if pel is not None and refs == "DELREF" else pel


def trim(stream: DataFrame, longest: int | None = None, least: str | None = None) -> DataFrame:
    """Keep the newest ``longest`` of each key, or ids from ``least`` on (exact trimming)."""
    if least is not None:
        return stream.where(id_of() >= literal(parsed(least, True)))
    return firsts(stream, [F.desc(c) for c in ID], longest).drop("n")


def info(stream: DataFrame) -> DataFrame:
    return stream.groupBy("key").agg(F.count(F.lit(1)).alias("length"), F.min(F.struct(*ID)).alias("first"), F.max(F.struct(*ID)).alias("last"))


def deliver(stream: DataFrame, groups: DataFrame, consumer: Column, now: Column | int, count: int | None = None) -> tuple[DataFrame, DataFrame]:
    """XREADGROUP ``>``: (new pending entries, groups moved on)."""
    rows = stream.join(groups, "key").where(id_of() > F.struct(F.col("last_ms").alias("ms"), F.col("last_seq").alias("seq")))
    if count is not None:
        rows = firsts(rows, [F.col(c) for c in ID], count, ["key", "grp"])
    pending = rows.select("key", "grp", *ID, consumer.alias("consumer"), (F.lit(now) if isinstance(now, int) else now).cast("long").alias("delivered_at"), F.lit(1).alias("n_delivered"))
    moved = pending.groupBy("key", "grp").agg(F.max(F.struct(*ID)).alias("last"))
    state = groups.join(moved, ["key", "grp"], "left").select("key", "grp", F.coalesce("last.ms", "last_ms").alias("last_ms"), F.coalesce("last.seq", "last_seq").alias("last_seq"))
    return pending, state


def redeliver(pel: DataFrame, consumer: str, start: str = "-") -> DataFrame:
    """XREADGROUP with an id: a consumer's own pending entries after it."""
    return pel.where((F.col("consumer") == consumer) & (id_of() > literal(parsed(start, True))))


def ack(pel: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pending left, how many were acknowledged per key and group)."""
    on = ["key", "grp", *ID]
    done = pel.join(ids.select(*on).distinct(), on, "left_semi")
    return pel.join(ids, on, "left_anti"), done.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("acked"))


def pending(pel: DataFrame) -> DataFrame:
    """Summary per group and consumer."""
    return pel.groupBy("key", "grp", "consumer").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ID)).alias("first"), F.max(F.struct(*ID)).alias("last"))


def pending_detail(pel: DataFrame, now: int, idle: int = 0, start: str = "-", end: str = "+", count: int = 10, consumer: str | None = None) -> DataFrame:
    got = pel.withColumn("idle", F.lit(now) - F.col("delivered_at")).where(F.col("idle") >= idle)
    if consumer is not None:
        got = got.where(F.col("consumer") == consumer)
    got = got.where((id_of() >= literal(parsed(start, True))) & (id_of() <= literal(parsed(end, False))))
    return firsts(got, [F.col(c) for c in ID], count, ["key", "grp"]).drop("n")


def claim(pel: DataFrame, ids: DataFrame, consumer: str, now: int, idle: int = 0, just_id: bool = False) -> DataFrame:
    """The pending entries after ``ids`` that are idle long enough go to ``consumer``."""
    on = ["key", "grp", *ID]
    both = pel.join(ids.select(*on).distinct().withColumn("asked", F.lit(True)), on, "left")
    take = F.col("asked").isNotNull() & (F.lit(now) - F.col("delivered_at") >= idle)
    return both.select(*on, F.when(take, F.lit(consumer)).otherwise(F.col("consumer")).alias("consumer"), F.when(take, F.lit(now)).otherwise(F.col("delivered_at")).cast("long").alias("delivered_at"), (F.col("n_delivered") + F.when(take & F.lit(not just_id), 1).otherwise(0)).alias("n_delivered"), take.alias("claimed"))


def auto_claim(pel: DataFrame, stream: DataFrame, consumer: str, now: int, idle: int, start: str = "-", count: int = 100) -> tuple[DataFrame, DataFrame]:
    """(pending after claiming the first ``count`` idle entries from ``start``, the claimed
    ids with ``deleted`` where the stream has them no more)."""
    some = pending_detail(pel, now, idle, start, count=count).select("key", "grp", *ID)
    there = stream.select("key", *ID, F.lit(True).alias("there"))
    seen = some.join(there, ["key", *ID], "left").withColumn("deleted", F.col("there").isNull()).drop("there")
    gone = seen.where("deleted")
    left = pel.join(gone.select("key", "grp", *ID), ["key", "grp", *ID], "left_anti")
    return claim(left, some, consumer, now, idle), seen


def set_id(stream: DataFrame, asked: DataFrame) -> DataFrame:
    """XSETID: ``asked(key, ms, seq)`` as the last id where it is not below the one there
    is; ``applied`` tells."""
    last = stream.groupBy("key").agg(F.max(F.struct(*ID)).alias("last"))
    both = asked.join(last, "key", "left")
    ok = F.col("last").isNull() | (id_of() >= F.col("last"))
    return both.select("key", F.when(ok, F.col("ms")).otherwise(F.col("last.ms")).alias("last_ms"), F.when(ok, F.col("seq")).otherwise(F.col("last.seq")).alias("last_seq"), ok.alias("applied"))


def create_groups(groups: DataFrame, new: DataFrame) -> DataFrame:
    """XGROUP CREATE: ``new(key, grp, last_ms, last_seq)``; groups that exist stay."""
    return groups.unionByName(new.join(groups, ["key", "grp"], "left_anti").select("key", "grp", "last_ms", "last_seq"))


def destroy_groups(groups: DataFrame, pel: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """XGROUP DESTROY: (groups left, pending left)."""
    on = ["key", "grp"]
    return groups.join(gone, on, "left_anti"), pel.join(gone, on, "left_anti")


def move_groups(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """XGROUP SETID: cursors to ``ids(key, grp, ms, seq)``, forward or back."""
    both = groups.join(ids, ["key", "grp"], "left")
    return both.select("key", "grp", F.coalesce("ms", "last_ms").alias("last_ms"), F.coalesce("seq", "last_seq").alias("last_seq"))


def delete_consumers(pel: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """XGROUP DELCONSUMER ``gone(key, grp, consumer)``: (pending left, how many were its)."""
    on = ["key", "grp", "consumer"]
    lost = pel.join(gone, on, "left_semi").groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return pel.join(gone, on, "left_anti"), lost
