"""The driver's tables as relations, and the same relations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..relations import rank, relation
from ..sources import table

#: "Now" of all queries, in milliseconds.
NOW = 500_000
#: Start of the event month, in milliseconds.
JAN = 1_704_067_200_000


def millis(column: str = "ts"):
    return F.unix_millis(F.col(column).cast("timestamp"))


def rows(names, *values):
    """An array of structs for ``inline``."""
    return F.array(*(F.struct(*(v.alias(n) for n, v in zip(names, row))) for row in values))


def zset(spark: SparkSession, d: str) -> DataFrame:
    return relation(table(spark, d, "orders"), "zset", key="o_orderpriority", member=F.col("o_orderkey").cast("string"), score="o_totalprice")


ZSET = "z AS (SELECT o_orderpriority AS key, CAST(o_orderkey AS VARCHAR) AS member, o_totalprice AS score FROM orders)"


def sets(spark: SparkSession, d: str) -> DataFrame:
    """Who was active on which day, by event type."""
    e = table(spark, d, "events")
    return relation(e, "set_members", key="event_type", member=F.concat_ws(":", F.date_format("ts", "dd"), F.col("user_id").cast("string"))).distinct()


SETS = "s AS (SELECT DISTINCT event_type AS key, strftime(ts, '%d') || ':' || CAST(user_id AS VARCHAR) AS member FROM events)"


def kv(spark: SparkSession, d: str) -> DataFrame:
    """Customers by name; a third never expires, the others do after their number of seconds."""
    c = table(spark, d, "customer")
    return relation(c, "kv", key=F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")), value=F.concat_ws(" ", "c_name", "c_mktsegment"), expires_at=F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") * 1000))


KV = "kv AS (SELECT 'cust:' || c_custkey AS key, c_name || ' ' || c_mktsegment AS value, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 1000 END AS expires_at FROM customer), live AS (SELECT * FROM kv WHERE expires_at IS NULL OR expires_at > 500000)"


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Writes to the same keys: (key, value, seq)."""
    s = table(spark, d, "supplier")
    return s.select(F.concat(F.lit("cust:"), (F.col("s_suppkey") * 37 % 2000).cast("string")).alias("key"), F.col("s_name").alias("value"), F.col("s_suppkey").alias("seq"))


WRITES = "w AS (SELECT 'cust:' || (s_suppkey * 37 % 2000) AS key, s_name AS value, s_suppkey AS seq FROM supplier), w1 AS (SELECT key, arg_max(value, seq) AS value FROM w GROUP BY key)"


def hashes(spark: SparkSession, d: str) -> DataFrame:
    """A customer as a hash; the balance expires."""
    c = table(spark, d, "customer")
    never = F.lit(None).cast("long")
    each = rows(
        ("field", "value", "expires_at"),
        (F.lit("name"), F.col("c_name"), never),
        (F.lit("nation"), F.col("c_nationkey").cast("string"), never),
        (F.lit("balance"), F.col("c_acctbal").cast("string"), F.col("c_custkey") * 1000),
        (F.lit("segment"), F.col("c_mktsegment"), never),
    )
    return c.select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key"), F.inline(each))


HASHES = "h AS (SELECT 'cust:' || c_custkey AS key, u.field, u.value, u.expires_at FROM (SELECT c_custkey, unnest([{'field':'name','value':c_name,'expires_at':NULL::BIGINT},{'field':'nation','value':CAST(c_nationkey AS VARCHAR),'expires_at':NULL},{'field':'balance','value':'','expires_at':c_custkey*1000},{'field':'segment','value':c_mktsegment,'expires_at':NULL}]) AS u FROM customer)), hl AS (SELECT * FROM h WHERE expires_at IS NULL OR expires_at > 500000)"


def lists(spark: SparkSession, d: str) -> DataFrame:
    """The event types of each user in order."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id")).withColumn("pos", rank([F.col("event_id")])).select("key", "pos", "value")


LISTS = "l AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_type AS value FROM events)"


def streams(spark: SparkSession, d: str) -> DataFrame:
    """Events by type, with ids (milliseconds, position within the millisecond)."""
    e = table(spark, d, "events").withColumn("key", F.col("event_type")).withColumn("ms", millis())
    return e.withColumn("seq", rank([F.col("event_id")], ["key", "ms"])).select("key", "ms", "seq", F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("fields"), "event_id", "user_id")


STREAMS = "st AS (SELECT event_type AS key, epoch_us(ts)//1000 AS ms, row_number() OVER (PARTITION BY event_type, epoch_us(ts)//1000 ORDER BY event_id) - 1 AS seq, event_id, user_id FROM events)"


def series(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(ts_series, ts_samples) of each user and event type."""
    e = table(spark, d, "events")
    key = F.concat_ws(":", F.col("event_type"), F.col("user_id").cast("string")).alias("key")
    samples = e.select(key, millis().alias("ts"), "value")
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("seg"), (F.col("user_id") % 4).cast("string"))
    labels = F.when(F.col("user_id") % 7 == 0, F.map_filter(labels, lambda k, _: k == "type")).otherwise(labels)
    names = e.select("event_type", "user_id").distinct().select(key, labels.alias("labels"), F.lit(0).cast("long").alias("retention_ms"), F.lit("LAST").alias("dup_policy"))
    return names, samples


SERIES = "ts AS (SELECT event_type || ':' || user_id AS key, event_type AS type, CASE WHEN user_id % 7 <> 0 THEN CAST(user_id % 4 AS VARCHAR) END AS seg, epoch_us(ts)//1000 AS t, value FROM events)"


def typed(spark: SparkSession, d: str) -> DataFrame:
    """Samples of each event type."""
    return table(spark, d, "events").select(F.col("event_type").alias("key"), millis().alias("ts"), "value")


TYPED = "ts AS (SELECT event_type AS key, epoch_us(ts)//1000 AS t, value FROM events)"


def geo(spark: SparkSession, d: str) -> DataFrame:
    """A place for every customer, by segment: (key, member, lon, lat)."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(F.col("c_mktsegment").alias("key"), k.cast("string").alias("member"), (k * 7919 % 36000 / 100.0 - 180).alias("lon"), (k * 104729 % 17000 / 100.0 - 85).alias("lat"))


GEO = "g AS (SELECT c_mktsegment AS key, CAST(c_custkey AS VARCHAR) AS member, c_custkey * 7919 % 36000 / 100.0 - 180 AS lon, c_custkey * 104729 % 17000 / 100.0 - 85 AS lat FROM customer)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Parts and their makers as JSON documents."""
    p = table(spark, d, "part")
    obj = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.array("p_brand", "p_type").alias("tags"), F.struct(F.col("p_partkey").alias("id"), (F.col("p_size") > 25).alias("big")).alias("meta")))
    return p.select(F.col("p_partkey").alias("key"), obj.alias("doc"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return v.select(F.lit("all").alias("key"), F.col("vec_id").cast("string").alias("element"), F.col("embedding").alias("vec"), F.to_json(F.struct("label", F.col("vec_id").alias("id"))).alias("attrs"))


VECTORS = "v AS (SELECT CAST(vec_id AS VARCHAR) AS element, embedding, label, vec_id AS id FROM embeddings)"


def bits(spark: SparkSession, d: str) -> DataFrame:
    """Users that were active, by day."""
    return table(spark, d, "events").select(F.date_format("ts", "dd").alias("key"), F.col("user_id").alias("off")).distinct()


BITS = "b AS (SELECT DISTINCT strftime(ts, '%d') AS key, user_id AS off FROM events)"
