"""Streams: events by type, read by one consumer group of three consumers."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import streams as o
from .bindings import JAN, STREAMS, streams

DAY = 86_400_000
NOW = JAN + 40 * DAY
MID = JAN + 15 * DAY
W = f"WITH {STREAMS}, x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS n, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS rev FROM st), p AS (SELECT key, 'g' AS grp, ms, seq, 'c' || (user_id % 3) AS consumer, ms + 500 AS delivered_at, event_id FROM st WHERE ms <= {MID} AND event_id % 5 = 0) "
IDS = ["key", "ms", "seq"]


def pel(s, d):
    """What was delivered by mid-month and is not acknowledged."""
    st = streams(s, d).where((F.col("ms") <= MID) & (F.col("event_id") % 5 == 0))
    return st.select("key", F.lit("g").alias("grp"), "ms", "seq", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("consumer"), (F.col("ms") + 500).alias("delivered_at"), F.lit(1).alias("n_delivered"))


def ids(s, d, k=10):
    return streams(s, d).where(F.col("event_id") % k == 0).select(F.lit("g").alias("grp"), *IDS)


def groups(s, d):
    return streams(s, d).select("key").distinct().select("key", F.lit("g").alias("grp"), F.lit(MID).cast("long").alias("last_ms"), F.lit(0).cast("long").alias("last_seq"))


def _rows(name, sql, make):
    @query(W + sql, name=name)
    def run(s, d):
        return make(s, d)


_rows("xadd", f", a AS (SELECT key, rev, count(*) OVER (PARTITION BY key) AS c FROM x WHERE rev <= 3) SELECT a.key, m.ms, m.seq + 4 - rev AS seq FROM a JOIN (SELECT key, ms, seq FROM x WHERE rev = 1) m USING (key)",
      lambda s, d: o.append(streams(s, d), o.between(streams(s, d), count=3, reverse=True).select("key", (F.col("ms") - DAY * 40).alias("at"), (-F.col("n")).alias("n"))).select("key", "ms", "seq"))
_rows("xlen", "SELECT key, count(*) AS length FROM st GROUP BY key", lambda s, d: o.length(streams(s, d)))
_rows("xrange", f", y AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS k FROM st WHERE ms BETWEEN {JAN + DAY} AND {JAN + 9 * DAY}) SELECT key, ms, seq FROM y WHERE k <= 100", lambda s, d: o.between(streams(s, d), str(JAN + DAY), str(JAN + 9 * DAY), 100).select(*IDS))
_rows("xrevrange", f", y AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS k FROM st WHERE ms <= {JAN + 9 * DAY}) SELECT key, ms, seq FROM y WHERE k <= 7", lambda s, d: o.between(streams(s, d), "-", str(JAN + 9 * DAY), 7, reverse=True).select(*IDS))
_rows("xread", f"SELECT key, ms, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS k FROM st WHERE ms > {MID} OR (ms = {MID} AND seq > 0)) WHERE k <= 20", lambda s, d: o.after(streams(s, d), groups(s, d).drop("grp"), 20).select(*IDS))
_rows("xdel", "SELECT key, count(*) AS length FROM st WHERE event_id % 10 <> 0 GROUP BY key", lambda s, d: o.length(o.delete(streams(s, d), ids(s, d))[0]))
_rows("xdelex", f"SELECT key, count(*) AS length FROM st WHERE event_id % 4 <> 0 OR (ms <= {MID} AND event_id % 5 = 0) GROUP BY key", lambda s, d: o.length(o.delete(streams(s, d), ids(s, d, 4), pel(s, d), "ACKED")[0]))
_rows("xdelex_delref", "SELECT key, count(*) AS n FROM p WHERE event_id % 4 <> 0 GROUP BY key", lambda s, d: o.delete(streams(s, d), ids(s, d, 4), pel(s, d), "DELREF")[1].groupBy("key").agg(F.count(F.lit(1)).alias("n")))
_rows("xtrim", "SELECT key, ms, seq FROM x WHERE rev <= 50", lambda s, d: o.trim(streams(s, d), 50).select(*IDS))
_rows("xtrim_minid", f"SELECT key, count(*) AS length FROM st WHERE ms >= {MID} GROUP BY key", lambda s, d: o.length(o.trim(streams(s, d), least=str(MID))))
_rows("xinfo", "SELECT key, length, a.ms AS first_ms, b.ms AS last_ms, b.seq AS last_seq FROM (SELECT key, count(*) AS length FROM st GROUP BY key) JOIN x a USING (key) JOIN x b USING (key) WHERE a.n = 1 AND b.rev = 1",
      lambda s, d: o.info(streams(s, d)).select("key", "length", F.col("first.ms").alias("first_ms"), F.col("last.ms").alias("last_ms"), F.col("last.seq").alias("last_seq")))
_rows("xinfo_consumers", "SELECT key, consumer, count(*) AS pending, max(delivered_at) AS seen FROM p GROUP BY ALL", lambda s, d: pel(s, d).groupBy("key", "consumer").agg(F.count(F.lit(1)).alias("pending"), F.max("delivered_at").alias("seen")))
_rows("xgroup_setid", f"SELECT key, 'g' AS grp, ms AS last_ms, seq AS last_seq FROM x WHERE rev = 1", lambda s, d: o.deliver(streams(s, d), groups(s, d), F.lit("c0"), NOW)[1])
_rows("xreadgroup", f", y AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS k FROM st WHERE ms > {MID} OR (ms = {MID} AND seq > 0)) SELECT key, ms, seq, 'c' || (user_id % 3) AS consumer FROM y WHERE k <= 30",
      lambda s, d: o.deliver(streams(s, d), groups(s, d), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")), NOW, 30)[0].select(*IDS, "consumer"))
_rows("xreadgroup_own", "SELECT key, ms, seq FROM p WHERE consumer = 'c1'", lambda s, d: o.redeliver(pel(s, d), "c1").select(*IDS))
_rows("xpending", "SELECT key, consumer, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM p GROUP BY ALL", lambda s, d: o.pending(pel(s, d)).select("key", "consumer", "n", F.col("first.ms").alias("first_ms"), F.col("last.ms").alias("last_ms")))
_rows("xpending_detail", f"SELECT key, ms, seq, idle FROM (SELECT *, {NOW} - delivered_at AS idle, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS k FROM p WHERE {NOW} - delivered_at >= {30 * DAY} AND consumer = 'c2') WHERE k <= 10",
      lambda s, d: o.pending_detail(pel(s, d), NOW, 30 * DAY, consumer="c2").select(*IDS, "idle"))
_rows("xack", "SELECT key, 'g' AS grp, count(*) AS acked FROM p WHERE event_id % 10 = 0 GROUP BY key", lambda s, d: o.ack(pel(s, d), ids(s, d))[1])
_rows("xackdel", "SELECT key, count(*) AS length FROM st WHERE event_id % 10 <> 0 GROUP BY key", lambda s, d: o.length(o.delete(streams(s, d), ids(s, d), o.ack(pel(s, d), ids(s, d))[0])[0]))
_rows("xclaim", f"SELECT key, consumer, count(*) AS n, sum(hits) AS delivered FROM (SELECT key, CASE WHEN take THEN 'c9' ELSE consumer END AS consumer, CASE WHEN take THEN 2 ELSE 1 END AS hits FROM (SELECT *, event_id % 10 = 0 AND {NOW} - delivered_at >= {30 * DAY} AS take FROM p)) GROUP BY ALL",
      lambda s, d: o.claim(pel(s, d), ids(s, d), "c9", NOW, 30 * DAY).groupBy("key", "consumer").agg(F.count(F.lit(1)).alias("n"), F.sum("n_delivered").alias("delivered")))
_rows("xautoclaim", f"SELECT key, ms, seq, event_id % 10 = 0 AS deleted FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS k FROM p WHERE {NOW} - delivered_at >= {30 * DAY}) WHERE k <= 25",
      lambda s, d: o.auto_claim(pel(s, d), o.delete(streams(s, d), ids(s, d))[0], "c9", NOW, 30 * DAY, count=25)[1].select(*IDS, "deleted"))


def _asked_ids(s, d):
    """Late ids for some keys, early ones for others."""
    early = F.length("key") % 2 == 0
    return streams(s, d).select("key").distinct().select("key", F.lit("g").alias("grp"), F.when(early, F.lit(JAN)).otherwise(F.lit(NOW)).cast("long").alias("ms"), F.lit(7).cast("long").alias("seq"))


_rows("xsetid", f"SELECT key, CASE WHEN length(key) % 2 = 0 THEN ms ELSE {NOW} END AS last_ms, CASE WHEN length(key) % 2 = 0 THEN seq ELSE 7 END AS last_seq, length(key) % 2 <> 0 AS applied FROM x WHERE rev = 1", lambda s, d: o.set_id(streams(s, d), _asked_ids(s, d).drop("grp")))
_rows("xgroup_create", f"SELECT DISTINCT key, g.grp, CASE g.grp WHEN 'g' THEN {MID} ELSE 0 END AS last_ms, 0 AS last_seq FROM st, (VALUES ('g'), ('h')) g(grp)",
      lambda s, d: o.create_groups(groups(s, d), groups(s, d).withColumn("last_ms", F.lit(5).cast("long")).unionByName(groups(s, d).select("key", F.lit("h").alias("grp"), F.lit(0).cast("long").alias("last_ms"), "last_seq"))))
_rows("xgroup_move", f"SELECT DISTINCT key, 'g' AS grp, CASE WHEN length(key) % 2 = 0 THEN {JAN} ELSE {NOW} END AS last_ms, 7 AS last_seq FROM st", lambda s, d: o.move_groups(groups(s, d), _asked_ids(s, d)))
_rows("xgroup_destroy", "SELECT key, count(*) AS n FROM p WHERE length(key) % 2 = 0 GROUP BY key", lambda s, d: o.destroy_groups(groups(s, d), pel(s, d), groups(s, d).where(F.length("key") % 2 != 0))[1].groupBy("key").agg(F.count(F.lit(1)).alias("n")))
_rows("xgroup_delconsumer", "SELECT key, 'g' AS grp, consumer, count(*) AS n FROM p WHERE consumer = 'c1' GROUP BY ALL", lambda s, d: o.delete_consumers(pel(s, d), pel(s, d).select("key", "grp", F.lit("c1").alias("consumer")).distinct())[1])
