"""Keys, strings, counters, deadlines and SORT: customers by name."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import keyspace as o
from ..operators import strings as t
from ..relations import live, rank
from ..sources import table
from .bindings import KV, NOW, SETS, WRITES, ZSET, kv, sets, suppliers, zset

W = f"WITH {KV}, {WRITES} "
J = W + ", j AS (SELECT coalesce(live.key, w1.key) AS key, live.value AS old, w1.value AS new, expires_at, live.key IS NOT NULL AS here, w1.key IS NOT NULL AS got FROM live FULL JOIN w1 ON live.key = w1.key) "


def asked(s, d):
    """All customers, and keys that no one has."""
    some = table(s, d, "customer").select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_custkey").alias("pos"))
    return some.union(table(s, d, "supplier").select(F.concat(F.lit("none:"), F.col("s_suppkey").cast("string")).alias("key"), (-F.col("s_suppkey")).alias("pos")))


A = W + ", a AS (SELECT 'cust:' || c_custkey AS key, c_custkey AS pos FROM customer UNION ALL SELECT 'none:' || s_suppkey, -s_suppkey FROM supplier) "
AJ = A + ", q AS (SELECT a.key, a.pos, live.value, live.expires_at, live.key IS NOT NULL AS here FROM a LEFT JOIN live ON a.key = live.key) "


@query(A + "SELECT a.key, live.value FROM a LEFT JOIN live ON a.key = live.key WHERE a.pos = 100")
def get(s, d):
    return o.get(kv(s, d), asked(s, d).where("pos = 100").select("key"), NOW)


@query(A + "SELECT a.pos, a.key, live.value FROM a LEFT JOIN live ON a.key = live.key")
def mget(s, d):
    return o.get(kv(s, d), asked(s, d), NOW).select("pos", "key", "value")


def _put(name, take, until, only=None, expires=None, out="value, expires_at"):
    sql = J + f", r AS (SELECT key, old AS old_value, ({take}) AS applied, CASE WHEN {take} THEN new ELSE old END AS value, CASE WHEN {take} THEN {until} ELSE expires_at END AS expires_at FROM j WHERE got) SELECT key, {out} FROM r"

    @query(sql, name=name)
    def run(s, d):
        got = o.put(kv(s, d), suppliers(s, d), NOW, only() if callable(only) else only, expires() if callable(expires) else expires)
        return got.where("written").select("key", *out.split(", "))


until = lambda ms: lambda: F.lit(ms).cast("long")
_put("set", "got", "NULL")
_put("set_nx", "NOT here", "NULL", "NX", out="applied, expires_at")
_put("set_xx_get", "here", "NULL", "XX", out="old_value, applied")
_put("set_keepttl", "got", "expires_at", expires=o.KEEP)
_put("set_ifeq", "coalesce(old LIKE '%BUILDING', false)", "NULL", lambda: F.col("value").endswith("BUILDING"), out="applied, value")
_put("set_ifne", "here AND NOT old LIKE '%BUILDING'", "NULL", lambda: ~F.col("value").endswith("BUILDING"), out="applied, value")
_put("setnx", "NOT here", "NULL", "NX", out="applied, expires_at")
_put("setex", "got", "560000", expires=until(NOW + 60_000))
_put("psetex", "got", "500999", expires=until(NOW + 999))
_put("mset", "got", "NULL")
_put("msetex", "got", "777000", expires=until(777_000))
_put("getset", "got", "NULL", out="old_value, value")


@query(W + "SELECT key, value FROM w1 WHERE NOT EXISTS (SELECT 1 FROM live JOIN w1 USING (key))")
def msetnx(s, d):
    return o.put_all_or_none(kv(s, d), suppliers(s, d), NOW)


@query(W + "SELECT 'new:' || key AS key, value FROM w1")
def msetnx_free(s, d):
    return o.put_all_or_none(kv(s, d), suppliers(s, d).withColumn("key", F.concat(F.lit("new:"), "key")), NOW)


@query(AJ + "SELECT key, value FROM q WHERE here")
def getdel(s, d):
    return o.delete(kv(s, d), asked(s, d), NOW)[1].select("key", "value")


@query(AJ + "SELECT key, value, CASE WHEN here THEN 900000 END AS expires_at FROM q")
def getex(s, d):
    got = o.expire(kv(s, d), asked(s, d), F.lit(900_000).cast("long"), NOW)
    return o.get(kv(s, d), got.select("key", F.when(F.col("applied") == 1, F.col("expires_at")).alias("expires_at")), NOW).select("key", "value", "expires_at")


@query(W + "SELECT w.key, coalesce(max(live.value), '') || string_agg(w.value, '' ORDER BY w.seq) AS value, CAST(strlen(coalesce(max(live.value), '') || string_agg(w.value, '')) AS INT) AS length FROM w LEFT JOIN live ON w.key = live.key GROUP BY w.key")
def append(s, d):
    return t.append(live(kv(s, d), NOW), suppliers(s, d))


@query(AJ + "SELECT key, CAST(coalesce(strlen(value), 0) AS INT) AS length FROM q")
def strlen(s, d):
    return o.get(kv(s, d), asked(s, d), NOW).select("key", t.strlen(F.col("value")).alias("length"))


def _range(name, start, end, sql):
    @query(AJ + f"SELECT key, {sql} AS part FROM q", name=name)
    def run(s, d):
        return o.get(kv(s, d), asked(s, d), NOW).select("key", t.getrange(F.col("value"), start, end).cast("string").alias("part"))


_range("getrange", 3, 11, "coalesce(value[4:12], '')")
_range("getrange_negative", -8, -2, "coalesce(value[length(value)-7:length(value)-1], '')")
_range("substr", 0, 4, "coalesce(value[1:5], '')")


@query(AJ + "SELECT key, hex(rpad(coalesce(value, ''), 40, chr(0))[1:30] || 'xyz' || CASE WHEN length(coalesce(value, '')) > 33 THEN value[34:] ELSE '' END) AS bytes FROM q".replace("40, chr(0))[1:30]", "30, '~')"))
def setrange(s, d):
    got = o.get(kv(s, d), asked(s, d), NOW)
    return got.select("key", F.hex(F.regexp_replace(t.setrange(F.col("value"), 30, b"xyz").cast("string"), "\u0000", "~")).alias("bytes"))




@query(None)
def lcs(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("key"), "p_name", "p_type")
    x = t.lcs()(F.col("p_name"), F.col("p_type"))
    return p.select("key", x.alias("x")).select("key", F.col("x.lcs").cast("string").alias("lcs"), "x.length", F.size("x.matches").alias("ranges"))


@query(None)
def lcs_length(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("key"), t.lcs()(F.col("p_name"), F.col("p_type")).getField("length").alias("length"))


def _log(s, d, delta):
    return table(s, d, "events").select(F.col("user_id").alias("key"), delta.alias("delta"), F.col("event_id").alias("seq"))


def _counter(name, delta, sql):
    @query(f"SELECT user_id AS key, event_id AS seq, CAST(sum({sql}) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS value FROM events", name=name)
    def run(s, d):
        return t.increments(_log(s, d, delta()))


_counter("incr", lambda: F.lit(1), "1")
_counter("incrby", lambda: F.col("event_id") % 7, "event_id % 7")
_counter("decr", lambda: F.lit(-1), "-1")
_counter("decrby", lambda: -(F.col("event_id") % 5), "-(event_id % 5)")


@query("SELECT user_id AS key, round(sum(event_id % 16) / 4, 4) AS value FROM events GROUP BY 1")
def incrbyfloat(s, d):
    return t.totals(_log(s, d, (F.col("event_id") % 16) / 4)).select("key", F.round("value", 4).alias("value"))


@query(None)
def digest(s, d):
    """Tested against the hash library."""
    return kv(s, d).select("key", t.xxh3("value").alias("digest"))


def _deleted(name, where, sql):
    @query(AJ + f"SELECT count(*) AS n FROM q WHERE here AND {sql}", name=name)
    def run(s, d):
        return o.delete(kv(s, d), asked(s, d), NOW, where())[1].agg(F.count(F.lit(1)).alias("n"))


_deleted("del", lambda: None, "true")
_deleted("unlink", lambda: None, "true")
_deleted("touch", lambda: None, "true")
_deleted("delex", lambda: F.col("value").endswith("BUILDING"), "value LIKE '%BUILDING'")
_deleted("delifex", lambda: ~F.col("value").endswith("BUILDING"), "NOT value LIKE '%BUILDING'")


@query(AJ + "SELECT 2 * count(*) AS n FROM q WHERE here")
def exists(s, d):
    return o.exists(kv(s, d), asked(s, d).union(asked(s, d)), NOW)


@query(W + f", {SETS}, {ZSET} SELECT type, count(*) AS n FROM (SELECT DISTINCT key, 'string' AS type FROM live UNION ALL SELECT DISTINCT key, 'set' FROM s UNION ALL SELECT DISTINCT key, 'zset' FROM z) GROUP BY type")
def type_of(s, d):
    return o.catalog(NOW, string=kv(s, d), set=sets(s, d), zset=zset(s, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _names(s, d):
    return asked(s, d).select("key", F.concat(F.lit("cust:"), (F.col("pos") + 700).cast("string")).alias("to"))


N = A + ", n AS (SELECT live.key, 'cust:' || (pos + 700) AS \"to\", live.value, live.expires_at FROM a JOIN live USING (key)) "


@query(N + "SELECT key, value FROM live WHERE key NOT IN (SELECT \"to\" FROM n) AND key NOT IN (SELECT key FROM n) UNION ALL SELECT \"to\", value FROM n")
def rename(s, d):
    return o.rename(kv(s, d), _names(s, d), NOW).select("key", "value")


@query(N + ", f AS (SELECT * FROM n WHERE \"to\" NOT IN (SELECT key FROM live)) SELECT key, value FROM live WHERE key NOT IN (SELECT key FROM f) UNION ALL SELECT \"to\", value FROM f")
def renamenx(s, d):
    return o.rename(kv(s, d), _names(s, d), NOW, only_new=True).select("key", "value")


@query(N + "SELECT key, value, expires_at FROM live WHERE key NOT IN (SELECT \"to\" FROM n) UNION ALL SELECT \"to\", value, expires_at FROM n")
def copy(s, d):
    return o.rename(kv(s, d), _names(s, d), NOW, copy=True)


@query(W + "SELECT key FROM live WHERE regexp_matches(key, '^cust:1.[3-5].*$')")
def keys(s, d):
    return o.matching(kv(s, d), "cust:1?[3-5]*", NOW)


@query(W + "SELECT key FROM live WHERE key > 'cust:3' AND key LIKE '%1' ORDER BY key LIMIT 20")
def scan(s, d):
    return o.scan(kv(s, d), NOW, "cust:3", 20, "*1")


@query("SELECT 1 AS keys, true AS live")
def randomkey(s, d):
    got = o.random_key(kv(s, d), NOW).join(live(kv(s, d), NOW), "key", "left_semi")
    return got.agg(F.count(F.lit(1)).cast("int").alias("keys")).withColumn("live", F.col("keys") == 1)


def _expire(name, ms, only, rule):
    sql = AJ + f"SELECT key, CAST(here AND ({rule}) AS INT) AS applied, CASE WHEN here AND ({rule}) THEN {ms} ELSE expires_at END AS expires_at FROM q"

    @query(sql, name=name)
    def run(s, d):
        return o.expire(kv(s, d), asked(s, d), F.lit(ms).cast("long"), NOW, only)


_expire("expire", NOW + 300_000, None, "true")
_expire("expire_nx", NOW + 300_000, "NX", "expires_at IS NULL")
_expire("expire_xx", NOW + 300_000, "XX", "expires_at IS NOT NULL")
_expire("pexpire", NOW + 333, None, "true")
_expire("expireat", 900_000, "GT", "coalesce(900000 > expires_at, false)")
_expire("pexpireat", 888_888, "LT", "coalesce(888888 < expires_at, false)")


def _ttl(name, value, **kind):
    @query(AJ + f"SELECT key, CASE WHEN NOT here THEN -2 WHEN expires_at IS NULL THEN -1 ELSE {value} END AS ttl FROM q", name=name)
    def run(s, d):
        return o.ttl(kv(s, d), asked(s, d), NOW, **kind)


_ttl("ttl", "(expires_at - 500000) // 1000")
_ttl("pttl", "expires_at - 500000", unit=1)
_ttl("expiretime", "expires_at // 1000", absolute=True)
_ttl("pexpiretime", "expires_at", unit=1, absolute=True)


@query(AJ + "SELECT key, CAST(here AND expires_at IS NOT NULL AS INT) AS removed FROM q")
def persist(s, d):
    return o.persist(kv(s, d), asked(s, d), NOW)


@query(f"WITH {ZSET} SELECT key, CASE WHEN count(*) <= 128 AND max(strlen(member)) <= 64 THEN 'listpack' ELSE 'skiplist' END AS encoding FROM z GROUP BY key")
def object_encoding(s, d):
    return zset(s, d).groupBy("key").agg(o.encoding("zset", F.count(F.lit(1)), F.max(F.octet_length("member"))).alias("encoding"))


@query(W + "SELECT key, value, expires_at FROM live")
def dump_restore(s, d):
    return o.restore(o.dump(kv(s, d), NOW))


@query(W + "SELECT count(*) AS keys, count(expires_at) AS with_deadline, CAST(avg(expires_at - 500000) AS BIGINT) AS avg_ttl FROM live")
def info_keyspace(s, d):
    return live(kv(s, d), NOW).agg(F.count(F.lit(1)).alias("keys"), F.count("expires_at").alias("with_deadline"), F.round(F.avg(F.col("expires_at") - NOW)).cast("long").alias("avg_ttl"))


# SORT: the orders of each customer.


def _orders(s, d):
    x = table(s, d, "orders")
    return x.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").cast("string").alias("value")).withColumn("pos", rank([F.col("value")]))


def _prices(s, d):
    return table(s, d, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").cast("string").alias("value"), F.col("o_totalprice").cast("string").alias("weight"))


O = "WITH i AS (SELECT o_custkey AS key, CAST(o_orderkey AS VARCHAR) AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS pos, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice ELSE 0 END AS price, o_orderstatus AS status FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {o}) - 1 AS rank FROM i) SELECT key, rank, value{x} FROM r {w}"


@query(O.format(o="CAST(value AS DOUBLE), pos", x="", w="WHERE rank BETWEEN 1 AND 4"))
def sort(s, d):
    return o.sort(_orders(s, d), offset=1, count=4)


@query(O.format(o="value DESC, pos DESC", x="", w=""))
def sort_alpha_desc(s, d):
    return o.sort(_orders(s, d), alpha=True, descending=True)


@query(O.format(o="price, pos", x=", status", w=""))
def sort_by_get(s, d):
    status = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderstatus").alias("found"))
    return o.sort(_orders(s, d), by=_prices(s, d), get=[("status", status)])


@query(O.format(o="price DESC, pos DESC", x="", w=""))
def sort_ro(s, d):
    return o.sort(_orders(s, d), by=_prices(s, d), descending=True)


# Conditions on the digest of the value: xxh3 of "Customer#000000003 ..." and the like is
# computed for one key, of which the others differ.


def _digest_of_one(s, d):
    one = kv(s, d).where(F.col("key") == "cust:3").select(t.xxh3("value")).first()
    return one[0] if one else ""


@query(J + "SELECT key, (coalesce(key = 'cust:3', false)) AS applied FROM (SELECT 'cust:' || c_custkey AS key FROM customer WHERE c_custkey % 3 = 0 OR c_custkey * 1000 > 500000)")
def set_ifdeq(s, d):
    every = kv(s, d).select("key", F.lit("new").alias("value"), F.lit(1).alias("seq"))
    got = o.put(kv(s, d), every, NOW, ("IFDEQ", _digest_of_one(s, d)))
    return got.join(live(kv(s, d), NOW).select("key"), "key", "left_semi").select("key", "applied")


@query(W + "SELECT key FROM live WHERE key = 'cust:3'")
def delex_ifdne(s, d):
    every = kv(s, d).select("key")
    return o.delete(kv(s, d), every, NOW, ("IFDNE", _digest_of_one(s, d)))[0].select("key")
