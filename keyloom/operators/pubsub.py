"""Publish and subscribe: messages(id, channel, payload) meet subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import SLOTS, key_slot
from ..relations import glob


def deliveries(messages: DataFrame, exact: DataFrame, patterns: list[tuple[str, str]] = ()) -> DataFrame:
    """(id, channel, subscriber, pattern): one copy for each exact subscription
    ``exact(channel, subscriber)``, by an equi-join, and one for each (pattern, subscriber)
    that matches, tested within the row."""
    named = messages.join(exact, "channel").select("id", "channel", "subscriber", F.lit(None).cast("string").alias("pattern"))
    if not patterns:
        return named
    each = F.array_compact(F.array(*(F.when(glob(F.col("channel"), p), F.struct(F.lit(s).alias("subscriber"), F.lit(p).alias("pattern"))) for p, s in patterns)))
    return named.unionByName(messages.select("id", "channel", F.inline(each)))


def receivers(messages: DataFrame, sent: DataFrame) -> DataFrame:
    """How many copies each message had."""
    n = sent.groupBy("id").agg(F.count(F.lit(1)).alias("receivers"))
    return messages.select("id").join(n, "id", "left").select("id", F.coalesce("receivers", F.lit(0)).alias("receivers"))


def receiver_counts(messages: DataFrame, exact: DataFrame, patterns: list[tuple[str, str]] = ()) -> DataFrame:
    """How many copies ``deliveries`` makes of each of ``messages(id, channel)``, without
    making them: the subscriptions of a channel are counted once."""
    own = exact.groupBy("channel").agg(F.count(F.lit(1)).alias("own"))
    matched = sum((F.coalesce(glob(F.col("channel"), p), F.lit(False)).cast("long") for p, _ in patterns), F.lit(0).cast("long"))
    return messages.select("id", "channel").join(own, "channel", "left").select("id", (F.coalesce("own", F.lit(0)) + matched).alias("receivers"))


def channel_counts(messages: DataFrame) -> DataFrame:
    """(channel, n): the messages of each channel."""
    return messages.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


def delivery_counts(sent: DataFrame, exact: DataFrame, patterns: list[tuple[str, str]] = ()) -> DataFrame:
    """(subscriber, n): how many copies each subscriber gets, from ``channel_counts``."""
    own = sent.join(exact, "channel").select("subscriber", "n")
    if patterns:
        each = F.array_compact(F.array(*(F.when(glob(F.col("channel"), p), F.struct(F.lit(s).alias("subscriber"))) for p, s in patterns)))
        own = own.unionByName(sent.select("n", F.inline(each)))
    return own.groupBy("subscriber").agg(F.sum("n").alias("n"))


def channels(exact: DataFrame, pattern: str = "*") -> DataFrame:
    return exact.where(glob(F.col("channel"), pattern)).select("channel").distinct()


def subscribers(exact: DataFrame) -> DataFrame:
    return exact.groupBy("channel").agg(F.count_distinct("subscriber").alias("subscribers"))


def subscriptions(log: DataFrame) -> DataFrame:
    """(channel, subscriber, since, until) of ``log(channel, subscriber, at, action)`` with the
    actions subscribe and unsubscribe: until is null while a subscription lasts. Subscribing
    twice changes nothing, and neither does unsubscribing from what one has not."""
    own = Window.partitionBy("channel", "subscriber").orderBy("at")
    changed = log.withColumn("_before", F.lag("action").over(own)).where(F.coalesce("_before", F.lit("unsubscribe")) != F.col("action"))
    ended = changed.withColumn("until", F.lead("at").over(own))
    return ended.where(F.col("action") == "subscribe").select("channel", "subscriber", F.col("at").alias("since"), "until")


def deliveries_during(messages: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, channel, subscriber) of ``messages(id, channel, at)`` for those who were
    subscribed when they were sent."""
    met = messages.join(spans, "channel").where((F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    return met.select("id", "channel", "subscriber")


#: Messages and ends of subscriptions are counted in parts of this many units of time.
PART = 3_600_000


def delivery_counts_during(messages: DataFrame, spans: DataFrame) -> DataFrame:
    """(subscriber, n) of what ``deliveries_during`` gives, without making the copies: a
    subscription gets the messages before its end but those before its beginning. They are
    counted along the time within parts of it, and the parts' counts are added up. Who gets
    nothing has no row."""
    part = lambda at: F.floor(at / PART).alias("part")
    sent = messages.where("channel IS NOT NULL AND at IS NOT NULL").groupBy("channel", "at").agg(F.count(F.lit(1)).alias("n")).withColumn("part", part(F.col("at")))
    real = spans.where(F.col("channel").isNotNull() & F.col("since").isNotNull() & (F.col("until").isNull() | (F.col("until") > F.col("since"))))
    ends = F.array(F.struct(F.col("since").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("until").alias("at"), F.lit(1).alias("sign")))
    ends = real.select("channel", "subscriber", F.inline(ends)).groupBy("channel", "subscriber", "at").agg(F.sum("sign").alias("sign"))
    steps = sent.select("channel", "part", "at", "n").unionByName(ends.where("at IS NOT NULL").select("channel", part(F.col("at")), "at", F.lit(0).cast("long").alias("n")).distinct())
    steps = steps.groupBy("channel", "part", "at").agg(F.sum("n").alias("n"))
    before = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    inside = steps.withColumn("inside", F.coalesce(F.sum("n").over(before("channel", "part", by="at")), F.lit(0)))
    parts = steps.groupBy("channel", "part").agg(F.sum("n").alias("own"))
    base = parts.select("channel", "part", F.coalesce(F.sum("own").over(before("channel", by="part")), F.lit(0)).alias("base"))
    told = inside.join(base, ["channel", "part"]).select("channel", "at", (F.col("base") + F.col("inside")).alias("n"))
    timed = ends.where("at IS NOT NULL").join(told, ["channel", "at"]).select("subscriber", (F.col("sign") * F.col("n")).alias("n"))
    whole = sent.groupBy("channel").agg(F.sum("n").alias("n"))  # what lasts gets all but what was before
    lasting = ends.where("at IS NULL").join(whole, "channel").select("subscriber", (F.col("sign") * F.col("n")).alias("n"))
    return timed.unionByName(lasting).groupBy("subscriber").agg(F.sum("n").alias("n")).where("n > 0")


def on_shard(messages: DataFrame, exact: DataFrame, shards: int) -> DataFrame:
    """Shard channels: (id, channel, shard, subscriber); a channel's slot says on which of
    ``shards`` equal ranges of slots its messages are dealt out."""
    shard = F.floor(key_slot(F.col("channel")) * shards / SLOTS).cast("int")
    where = exact.select("channel").distinct().withColumn("shard", shard)  # few channels, so slots are computed once each
    return messages.join(exact.join(where, "channel"), "channel").select("id", "channel", "shard", "subscriber")


def shard_counts(messages: DataFrame, exact: DataFrame, shards: int) -> DataFrame:
    """(channel, shard, n): how many copies ``on_shard`` makes, without making them."""
    own = exact.groupBy("channel").agg(F.count(F.lit(1)).alias("own"))
    shard = F.floor(key_slot(F.col("channel")) * shards / SLOTS).cast("int")
    return channel_counts(messages).join(own, "channel").select("channel", shard.alias("shard"), (F.col("n") * F.col("own")).alias("n"))
