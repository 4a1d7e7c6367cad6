"""Ranked sets: orders of each priority by price."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import zsets as z
from ..sources import table
from .bindings import ZSET, zset

W = f"WITH {ZSET}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rev, count(*) OVER (PARTITION BY key) AS card FROM z) "
A, B, C = "1-URGENT", "2-HIGH", "5-LOW"


def updates(s, d):
    """Later prices of some orders, and new members: (key, member, score, seq)."""
    o = table(s, d, "orders").where(F.col("o_orderkey") % 3 == 0)
    new = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))
    return o.select(F.col("o_orderpriority").alias("key"), new.cast("string").alias("member"), (F.col("o_totalprice") * (F.col("o_orderkey") % 5)).alias("score"), F.col("o_orderkey").alias("seq"))


U = W + ", u AS (SELECT o_orderpriority AS key, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END AS VARCHAR) AS member, o_totalprice * (o_orderkey % 5) AS new FROM orders WHERE o_orderkey % 3 = 0), j AS (SELECT coalesce(z.key, u.key) AS key, coalesce(z.member, u.member) AS member, score AS old, new FROM z FULL JOIN u ON z.key = u.key AND z.member = u.member) "


def _added(name, take, **kind):
    sql = U + f"SELECT key, count(*) AS n, count_if(old IS NULL) AS added, count_if(old IS NOT NULL AND score <> old) AS changed, round(sum(score), 2) AS total FROM (SELECT key, old, CASE WHEN {take} THEN new ELSE old END AS score FROM j) WHERE score IS NOT NULL GROUP BY key"

    @query(sql, name=name)
    def run(s, d):
        got = z.add(zset(s, d), updates(s, d), **kind)
        return got.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("added").alias("added"), F.count_if(F.col("changed") & ~F.col("added")).alias("changed"), F.round(F.sum("score"), 2).alias("total"))


_added("zadd", "new IS NOT NULL")
_added("zadd_nx", "new IS NOT NULL AND old IS NULL", only="NX")
_added("zadd_xx", "new IS NOT NULL AND old IS NOT NULL", only="XX")
_added("zadd_gt", "new IS NOT NULL AND (old IS NULL OR new > old)", better="GT")
_added("zadd_lt", "new IS NOT NULL AND (old IS NULL OR new < old)", better="LT")


@query(U + "SELECT key, member, round(coalesce(old, 0) + coalesce(new, 0), 4) AS score FROM j WHERE coalesce(old, 0) + coalesce(new, 0) > 400000")
def zincrby(s, d):
    got = z.increment(zset(s, d), updates(s, d).withColumnRenamed("score", "delta"))
    return got.where(F.col("score") > 400000).select("key", "member", F.round("score", 4).alias("score"))


@query(U + "SELECT key, count(*) AS card FROM j WHERE old IS NOT NULL AND new IS NULL GROUP BY key")
def zrem(s, d):
    return z.card(z.remove(zset(s, d), updates(s, d)))


@query(U + "SELECT key, member, old AS score FROM j WHERE new IS NOT NULL")
def zmscore(s, d):
    return z.scores(zset(s, d), updates(s, d).select("key", "member"))


@query(W + f"SELECT key, member, score FROM z WHERE key = '{A}' AND member = (SELECT min(member) FROM z WHERE key = '{A}')")
def zscore(s, d):
    one = zset(s, d).where(F.col("key") == A).groupBy("key").agg(F.min("member").alias("member"))
    return z.scores(zset(s, d), one)


@query(W + "SELECT key, count(*) AS card FROM z GROUP BY key")
def zcard(s, d):
    return z.card(zset(s, d))


def _asked(s, d):
    return zset(s, d).select("key", "member")


@query(W + "SELECT key, member, score, rank FROM r")
def zrank(s, d):
    return z.rank_of(zset(s, d), _asked(s, d))


@query(W + "SELECT key, member, score, rev AS rank FROM r")
def zrevrank(s, d):
    return z.rank_of(zset(s, d), _asked(s, d), reverse=True)


@query(W + "SELECT key, count(*) AS card FROM z WHERE score > 50000 AND score <= 250000 GROUP BY key")
def zcount(s, d):
    return z.card(z.by_score(zset(s, d), "(50000", "250000"))


def _flat(s, d):
    return zset(s, d).withColumn("score", F.when(F.col("key") == C, F.col("score")).otherwise(F.lit(0.0)))


@query(W + f"SELECT key, count(*) AS card FROM z WHERE key <> '{C}' AND member >= '12' AND member < '3' GROUP BY key")
def zlexcount(s, d):
    return z.card(z.by_lex(_flat(s, d), "[12", "(3"))


def _ranged(name, where, make, rank="rank"):
    @query(W + f"SELECT key, member, score, {rank} AS rank FROM r WHERE {where}", name=name)
    def run(s, d):
        return make(zset(s, d)).select("key", "member", "score", "rank")


_ranged("zrange", "rank <= 9", lambda x: z.by_rank(x, 0, 9))
_ranged("zrange_negative", "rank >= card - 5 AND rank <= card - 2", lambda x: z.by_rank(x, -5, -2))
_ranged("zrange_rev", "rev BETWEEN 3 AND 7", lambda x: z.by_rank(x, 3, 7, reverse=True), "rev")
_ranged("zrevrange", "rev <= 9", lambda x: z.by_rank(x, 0, 9, reverse=True), "rev")
_ranged("zpopmin", "rank < 3", lambda x: z.pop(x, 3)[0])
_ranged("zpopmax", "rev < 3", lambda x: z.pop(x, 3, largest=True)[0], "rev")
_ranged("zmpop", f"key = '{B}' AND rank < 4", lambda x: z.pop_first(x, ["none", B, A], 4))

P = W + ", p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {o}) - 1 AS n FROM {f}) SELECT key, member, score, n AS rank FROM p WHERE n BETWEEN 2 AND 6"


@query(P.format(o="score, member", f="z WHERE score >= 100000 AND score < 300000"))
def zrangebyscore(s, d):
    return z.page(z.by_score(zset(s, d), "100000", "(300000"), 2, 5)


@query(P.format(o="score DESC, member DESC", f="z WHERE score >= 100000 AND score < 300000"))
def zrevrangebyscore(s, d):
    return z.page(z.by_score(zset(s, d), "100000", "(300000"), 2, 5, reverse=True)


@query(P.format(o="member", f=f"(SELECT key, member, 0.0 AS score FROM z WHERE key <> '{C}') WHERE member > '2' AND member <= '5'"))
def zrangebylex(s, d):
    return z.page(z.by_lex(_flat(s, d), "(2", "[5"), 2, 5)


@query(P.format(o="member DESC", f=f"(SELECT key, member, 0.0 AS score FROM z WHERE key <> '{C}') WHERE member > '2' AND member <= '5'"))
def zrevrangebylex(s, d):
    return z.page(z.by_lex(_flat(s, d), "(2", "[5"), 2, 5, reverse=True)


@query(W + f"SELECT 'top' AS key, member, score FROM r WHERE key = '{A}' AND rank < 20")
def zrangestore(s, d):
    return z.store(z.by_rank(zset(s, d).where(F.col("key") == A), 0, 19), "top")


@query(W + "SELECT key, count(*) AS sampled, count(*) AS members FROM r WHERE rank < 7 GROUP BY key")
def zrandmember(s, d):
    got = z.sample(zset(s, d), 7)
    return got.join(zset(s, d), ["key", "member"]).groupBy("key").agg(F.count(F.lit(1)).alias("sampled"), F.count_distinct("member").alias("members"))


@query(W + "SELECT key, count(*) AS card FROM z WHERE NOT (score >= 100000 AND score <= 200000) GROUP BY key")
def zremrangebyscore(s, d):
    return z.card(z.remove(zset(s, d), z.by_score(zset(s, d), "100000", "200000")))


@query(W + "SELECT key, member, score FROM r WHERE rank >= 100 AND rank < 110")
def zremrangebyrank(s, d):
    return z.by_rank(z.remove(zset(s, d), z.by_rank(zset(s, d), 0, 99)), 0, 9).drop("rank")


@query(W + f"SELECT key, count(*) AS card FROM z WHERE key = '{C}' OR NOT (member >= '12' AND member < '3') GROUP BY key")
def zremrangebylex(s, d):
    return z.card(z.remove(_flat(s, d), z.by_lex(_flat(s, d), "[12", "(3")))


# Algebra over members that the keys share: how often an order's last three digits occur.


def digits(s, d):
    return zset(s, d).groupBy("key", F.right("member", F.lit(3)).alias("member")).agg(F.round(F.sum("score"), 2).alias("score"))


G = W + ", q AS (SELECT key, right(member, 3) AS member, round(sum(score), 2) AS score FROM z GROUP BY ALL), a AS (SELECT * FROM q WHERE key = '1-URGENT'), b AS (SELECT * FROM q WHERE key = '2-HIGH') "


@query(G + "SELECT coalesce(a.member, b.member) AS member, round(coalesce(2 * a.score, 0) + coalesce(b.score, 0), 2) AS score FROM a FULL JOIN b ON a.member = b.member")
def zunion(s, d):
    return z.union(digits(s, d), [A, B], [2, 1]).select("member", F.round("score", 2).alias("score"))


@query(G + "SELECT 'u' AS key, coalesce(a.member, b.member) AS member, greatest(a.score, b.score) AS score FROM a FULL JOIN b ON a.member = b.member")
def zunionstore(s, d):
    return z.store(z.union(digits(s, d), [A, B], how="MAX"), "u")


@query(G + "SELECT a.member, round(2 * a.score + b.score, 2) AS score FROM a JOIN b ON a.member = b.member")
def zinter(s, d):
    return z.inter(digits(s, d), [A, B], [2, 1]).select("member", F.round("score", 2).alias("score"))


@query(G + "SELECT 'i' AS key, a.member, least(a.score, b.score) AS score FROM a JOIN b ON a.member = b.member")
def zinterstore(s, d):
    return z.store(z.inter(digits(s, d), [A, B], how="MIN"), "i")


@query(G + "SELECT least(count(*), 100) AS card FROM a JOIN b ON a.member = b.member")
def zintercard(s, d):
    return z.inter_card(digits(s, d), [A, B], 100)


@query(G + "SELECT a.member, a.score FROM a ANTI JOIN b ON a.member = b.member")
def zdiff(s, d):
    return z.diff(digits(s, d), [A, B])


@query(G + "SELECT 'd' AS key, b.member, b.score FROM b ANTI JOIN a ON a.member = b.member")
def zdiffstore(s, d):
    return z.store(z.diff(digits(s, d), [B, A]), "d")


@query(W + "SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS n FROM z WHERE member > '2' AND member LIKE '%7') WHERE n <= 5")
def zscan(s, d):
    return z.scan(zset(s, d), "2", 5, "*7")
