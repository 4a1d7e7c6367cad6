"""Lists: the event types of each user, in order."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import lists as o
from ..sources import table
from .bindings import LISTS, lists

W = f"WITH {LISTS}, x AS (SELECT *, count(*) OVER (PARTITION BY key) AS length FROM l), t AS (SELECT min(value) AS first, max(value) AS last FROM l) "


def kinds(s, d):
    """The first and last event type by name."""
    r = table(s, d, "events").agg(F.min("event_type"), F.max("event_type")).first()
    return r[0], r[1]


def new(s, d):
    return table(s, d, "supplier").select((F.col("s_suppkey") * 3).alias("key"), F.col("s_suppkey").alias("seq"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("value")).withColumn("seq", F.col("seq") * 2 + (F.col("value") == "b").cast("int"))


NEW = W + ", n AS (SELECT s_suppkey * 3 AS key, v AS value, s_suppkey * 2 + (v = 'b')::INT AS seq FROM supplier, (VALUES ('a'), ('b')) q(v)) "


def _pushed(name, order, gate="", **kind):
    sql = NEW + f"SELECT key, string_agg(value, ',' ORDER BY {order}) AS items FROM (SELECT key, value, 0 AS p, pos AS q FROM l UNION ALL SELECT key, value, 1, seq FROM n {gate}) GROUP BY key"

    @query(sql, name=name)
    def run(s, d):
        got = o.push(lists(s, d), new(s, d), **kind)
        return got.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x.value), ",").alias("items"))


HAS = "WHERE key IN (SELECT key FROM l)"
_pushed("rpush", "p, q")
_pushed("rpushx", "p, q", HAS, existing=True)
_pushed("lpush", "p DESC, CASE p WHEN 1 THEN -q ELSE q END", left=True)
_pushed("lpushx", "p DESC, CASE p WHEN 1 THEN -q ELSE q END", HAS, left=True, existing=True)


def _rows(name, sql, make):
    @query(W + sql, name=name)
    def run(s, d):
        return make(s, d)


_rows("lpop", "SELECT key, pos AS n, value FROM x WHERE pos BETWEEN 0 AND 1", lambda s, d: o.pop(lists(s, d), 2)[0].select("key", "n", "value"))
_rows("rpop", "SELECT key, length - 1 - pos AS n, value FROM x WHERE length - 1 - pos < 3", lambda s, d: o.pop(lists(s, d), 3, right=True)[0].select("key", "n", "value"))
_rows("llen", "SELECT key, count(*) AS length FROM l GROUP BY key", lambda s, d: o.length(lists(s, d)))
_rows("lrange", "SELECT key, pos AS index, value FROM x WHERE pos BETWEEN 2 AND length - 3", lambda s, d: o.slice_of(lists(s, d), 2, -3).select("key", "index", "value"))
_rows("lindex", "SELECT key, pos AS index, value FROM x WHERE pos = length - 2", lambda s, d: o.at(lists(s, d), -2).select("key", "index", "value"))
_rows("ltrim", "SELECT key, count(*) AS length FROM x WHERE pos >= length - 40 GROUP BY key", lambda s, d: o.length(o.slice_of(lists(s, d), -40, -1)))
_rows("lset", "SELECT key, pos, CASE WHEN pos = 5 THEN 'new' ELSE value END AS value FROM l WHERE pos < 8", lambda s, d: o.put(lists(s, d), 5, "new").where("pos < 8"))
_rows("linsert", ", f AS (SELECT key, min(pos) AS spot FROM l, t WHERE value = last GROUP BY key) SELECT l.key, string_agg(CASE WHEN pos = spot THEN value || ',new' ELSE value END, ',' ORDER BY pos) AS items FROM l JOIN f USING (key) GROUP BY l.key",
      lambda s, d: o.insert(lists(s, d), kinds(s, d)[1], "new", after=True).join(lists(s, d).where(F.col("value") == kinds(s, d)[1]).select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x.value), ",").alias("items")))
_rows("lpos", ", f AS (SELECT key, pos, row_number() OVER (PARTITION BY key ORDER BY pos) AS n FROM l, t WHERE value = first) SELECT key, pos AS index FROM f WHERE n BETWEEN 2 AND 4", lambda s, d: o.positions(lists(s, d), kinds(s, d)[0], 2, 3))
_rows("lpos_tail", ", f AS (SELECT key, pos, row_number() OVER (PARTITION BY key ORDER BY pos DESC) AS n FROM x, t WHERE value = first AND length - 1 - pos < 30) SELECT key, pos AS index FROM f WHERE n >= 2", lambda s, d: o.positions(lists(s, d), kinds(s, d)[0], -2, 0, 30))
_rows("lrem", ", f AS (SELECT key, pos, value, row_number() OVER (PARTITION BY key, value ORDER BY pos DESC) AS n FROM l) SELECT key, count(*) AS length, sum(pos) AS total FROM f, t WHERE value <> first OR n > 2 GROUP BY key",
      lambda s, d: o.remove(lists(s, d), kinds(s, d)[0], -2).groupBy("key").agg(F.count(F.lit(1)).alias("length"), F.sum("pos").alias("total")))
_rows("lmove", "SELECT 2 AS key, value FROM x WHERE key = 1 AND pos = 0", lambda s, d: o.move(lists(s, d), 1, 2)[0])
_rows("rpoplpush", "SELECT 2 AS key, CASE WHEN pos = -1 THEN (SELECT value FROM x WHERE key = 1 AND pos = length - 1) ELSE value END AS value, pos + 1 AS index FROM (SELECT -1 AS pos, '' AS value UNION ALL SELECT pos, value FROM l WHERE key = 2) WHERE pos < 3",
      lambda s, d: o.slice_of(o.move(lists(s, d), 1, 2, from_right=True)[1].where("key = 2"), 0, 3).select("key", "value", "index"))
_rows("lmpop", "SELECT key, length - 1 - pos AS n, value FROM x WHERE key = 3 AND length - 1 - pos < 2", lambda s, d: o.pop_first(lists(s, d), [-1, 3, 4], 2, right=True).select("key", "n", "value"))
