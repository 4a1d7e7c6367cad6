"""Sets: who was active on which day, by event type."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import sets as o
from .bindings import SETS, sets

W = f"WITH {SETS} "


def _keys(s, d):
    """The first three types by name."""
    return [r[0] for r in sets(s, d).select("key").distinct().orderBy("key").limit(3).collect()]


K = W + ", k AS (SELECT key, row_number() OVER (ORDER BY key) AS n FROM (SELECT DISTINCT key FROM s)), a AS (SELECT member FROM s WHERE key = (SELECT key FROM k WHERE n = 1)), b AS (SELECT member FROM s WHERE key = (SELECT key FROM k WHERE n = 2)), c AS (SELECT member FROM s WHERE key = (SELECT key FROM k WHERE n = 3)) "


def _incoming(s, d):
    return sets(s, d).where(F.col("member").endswith("7")).withColumn("key", F.lit("sevens")).unionByName(sets(s, d).where(F.col("member").endswith("5")))


@query(W + "SELECT 'sevens' AS key, count(DISTINCT member) AS card FROM s WHERE member LIKE '%7'")
def sadd(s, d):
    return o.add(sets(s, d), _incoming(s, d))[1]


@query(W + "SELECT key, count(*) AS card FROM s WHERE member NOT LIKE '%5' GROUP BY key")
def srem(s, d):
    return o.card(o.remove(sets(s, d), _incoming(s, d)))


@query(W + "SELECT key, count(*) AS card FROM s GROUP BY key")
def scard(s, d):
    return o.card(sets(s, d))


@query(K + "SELECT k.key, m.member, CAST(EXISTS (SELECT 1 FROM s WHERE s.key = k.key AND s.member = m.member) AS INT) AS found FROM k, (VALUES ('01:7')) m(member)")
def sismember(s, d):
    asked = sets(s, d).select("key").distinct().withColumn("member", F.lit("01:7"))
    return o.is_member(sets(s, d), asked)


@query(W + "SELECT key, member, 1 AS found FROM s UNION ALL SELECT key, 'no' || member, 0 FROM s")
def smismember(s, d):
    """Every key is asked for its members and for as many that it has not."""
    asked = sets(s, d).select("key", F.explode(F.array("member", F.concat(F.lit("no"), "member"))).alias("member"))
    return o.is_member(sets(s, d), asked)


@query(W + "SELECT key, list_sort(list(member)) AS members FROM s WHERE member LIKE '0_:1%' GROUP BY key")
def smembers(s, d):
    return o.members(sets(s, d).where(F.col("member").rlike("^0.:1")))


@query(W + "SELECT key, 9 AS drawn, 9 AS members FROM s GROUP BY key")
def srandmember(s, d):
    got = o.sample(sets(s, d), 9)
    return got.join(sets(s, d), ["key", "member"], "left_semi").groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("drawn"), F.count_distinct("member").cast("int").alias("members"))


@query(W + "SELECT key, 12 AS drawn FROM s GROUP BY key")
def srandmember_repeating(s, d):
    got = o.sample(sets(s, d), -12)
    return got.join(sets(s, d), ["key", "member"], "left_semi").groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("drawn"))


@query(W + "SELECT key, count(*) - 11 AS card FROM s GROUP BY key")
def spop(s, d):
    return o.card(o.pop(sets(s, d), 11)[1])


@query(K + "SELECT key, count(*) AS card FROM (SELECT key, member FROM s WHERE key <> (SELECT key FROM k WHERE n = 1) OR member NOT LIKE '%5' UNION SELECT (SELECT key FROM k WHERE n = 2), member FROM a WHERE member LIKE '%5') GROUP BY key")
def smove(s, d):
    a, b, _ = _keys(s, d)
    moved = sets(s, d).where(F.col("member").endswith("5")).select("member").distinct()
    return o.card(o.move(sets(s, d), a, b, moved))


def _algebra(name, sql, make):
    @query(K + sql, name=name)
    def run(s, d):
        return make(sets(s, d), _keys(s, d))


_algebra("sunion", "SELECT member FROM a UNION SELECT member FROM b UNION SELECT member FROM c", o.union)
_algebra("sunionstore", "SELECT 'dst' AS key, member FROM (SELECT member FROM a UNION SELECT member FROM b UNION SELECT member FROM c)", lambda x, k: o.store(o.union(x, k), "dst"))
_algebra("sinter", "SELECT member FROM a INTERSECT SELECT member FROM b INTERSECT SELECT member FROM c", o.inter)
_algebra("sinterstore", "SELECT 'dst' AS key, member FROM (SELECT member FROM a INTERSECT SELECT member FROM b INTERSECT SELECT member FROM c)", lambda x, k: o.store(o.inter(x, k), "dst"))
_algebra("sintercard", "SELECT count(*) AS card FROM (SELECT member FROM a INTERSECT SELECT member FROM b)", lambda x, k: o.inter_card(x, k[:2]))
_algebra("sintercard_limit", "SELECT least(count(*), 25) AS card FROM (SELECT member FROM a INTERSECT SELECT member FROM b INTERSECT SELECT member FROM c)", lambda x, k: o.inter_card(x, k, 25))
_algebra("sdiff", "SELECT member FROM a EXCEPT SELECT member FROM b EXCEPT SELECT member FROM c", o.diff)
_algebra("sdiffstore", "SELECT 'dst' AS key, member FROM (SELECT member FROM a EXCEPT SELECT member FROM b)", lambda x, k: o.store(o.diff(x, k[:2]), "dst"))


@query(W + "SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS n FROM s WHERE member > '10' AND member LIKE '%:1%') WHERE n <= 4")
def sscan(s, d):
    return o.scan(sets(s, d), "10", 4, "*:1*")
