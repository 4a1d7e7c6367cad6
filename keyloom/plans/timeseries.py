"""Time series: event values by type, or by user and type with labels."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import timeseries as o
from ..sources import table
from .bindings import JAN, SERIES, TYPED, millis, series, typed

HOUR, DAY = 3_600_000, 86_400_000
W = f"WITH {TYPED} "
S = f"WITH {SERIES} "


@query(W + f"SELECT key, (t // {HOUR}) * {HOUR} AS bucket, round(avg(value), 6) AS value FROM ts GROUP BY ALL")
def ts_range_avg(s, d):
    got = o.range_of(typed(s, d), how="avg", width=HOUR, align=0)
    return got.select("key", F.col("ts").alias("bucket"), F.round("value", 6).alias("value"))


SQL = {"avg": "avg(value)", "first": "arg_min(value, t)", "last": "arg_max(value, t)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)", "range": "max(value) - min(value)", "std.p": "stddev_pop(value)", "std.s": "CASE WHEN count(*) > 1 THEN stddev_samp(value) END", "var.p": "var_pop(value)", "var.s": "CASE WHEN count(*) > 1 THEN var_samp(value) END"}


def _aggregated(how):
    sql = W + f"SELECT key, ts, round(value + 0.0000001, 4) AS value FROM (SELECT key, t - (t - {JAN + 777}) % {6 * HOUR} AS ts, {SQL[how]} AS value FROM ts WHERE t >= {JAN + 777} AND t <= {JAN + 20 * DAY} GROUP BY ALL) WHERE value IS NOT NULL"

    @query(sql, name=f"ts_range_{how.replace('.', '_')}_buckets")
    def run(s, d):
        got = o.range_of(typed(s, d), JAN + 777, JAN + 20 * DAY, how, 6 * HOUR)
        return got.withColumn("value", F.round(F.col("value") + 1e-7, 4))  # off the ties of rounding


for _how in SQL:
    _aggregated(_how)


@query(W + f", b AS (SELECT key, t, value, (t // {DAY}) * {DAY} AS ts FROM ts), g AS (SELECT key, ts, value, (value + lag(value) OVER w) / 2 * (t - lag(t) OVER w) AS area FROM b WINDOW w AS (PARTITION BY key, ts ORDER BY t)) SELECT key, ts, round(CASE WHEN count(*) = 1 THEN min(value) ELSE sum(area) / {DAY} END, 4) AS value FROM g GROUP BY ALL")
def ts_range_twa(s, d):
    return o.range_of(typed(s, d), how="twa", width=DAY, align=0).withColumn("value", F.round("value", 4))


GAP = ", e AS (SELECT key, min(b) AS lo, max(b) AS hi FROM (SELECT key, (t // {w}) * {w} AS b FROM ts) GROUP BY key), f AS (SELECT key, unnest(range(lo, hi + 1, {w})) AS ts FROM e), g AS (SELECT key, (t // {w}) * {w} AS ts, {agg} AS value FROM ts GROUP BY ALL) SELECT f.key, f.ts{shift} AS ts, coalesce(g.value, {none}) AS value FROM f LEFT JOIN g USING (key, ts)"


@query(W + GAP.format(w=HOUR // 2, agg="CAST(count(*) AS DOUBLE)", none="0", shift=""))
def ts_range_count(s, d):
    return o.range_of(typed(s, d), how="count", width=HOUR // 2, align=0)


@query(W + GAP.format(w=HOUR // 4, agg="max(value)", none="'nan'::DOUBLE", shift=f" + {HOUR // 4 - 1}"))
def ts_range_empty(s, d):
    return o.range_of(typed(s, d), how="max", width=HOUR // 4, align=0, label="end", empty=True)


@query(W + f"SELECT key, t AS ts, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS n FROM ts WHERE t >= {JAN + DAY} AND t <= {JAN + 9 * DAY} AND value BETWEEN 10 AND 60) WHERE n <= 25")
def ts_range(s, d):
    return o.range_of(typed(s, d), JAN + DAY, JAN + 9 * DAY, filter_value=(10, 60), count=25)


@query(W + f"SELECT key, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS n FROM (SELECT key, (t // {DAY}) * {DAY} + {DAY // 2} AS ts, min(value) AS value FROM ts GROUP BY ALL)) WHERE n <= 5")
def ts_revrange(s, d):
    return o.range_of(typed(s, d), how="min", width=DAY, align=0, label="mid", count=5, reverse=True)


def _settled(policy, sql):
    @query(f"SELECT event_type AS key, (epoch_us(ts)//1000) // {DAY} * {DAY} AS ts, round({sql}, 4) AS value FROM events GROUP BY ALL", name=f"ts_add_{policy.lower()}")
    def run(s, d):
        e = table(s, d, "events")
        day = (millis() - F.pmod(millis(), F.lit(DAY))).alias("ts")
        got = o.settle(e.select(F.col("event_type").alias("key"), day, "value", F.col("event_id").alias("seq")), policy)
        return got.select("key", "ts", F.round("value", 4).alias("value"))


for _policy, _sql in {"FIRST": "arg_min(value, event_id)", "LAST": "arg_max(value, event_id)", "MIN": "min(value)", "MAX": "max(value)", "SUM": "sum(value)"}.items():
    _settled(_policy, _sql)


@query(f"SELECT event_type AS key, (epoch_us(ts)//1000) // {DAY} * {DAY} AS ts, count(*) - 1 AS blocked FROM events GROUP BY ALL")
def ts_madd_block(s, d):
    e = table(s, d, "events")
    day = (millis() - F.pmod(millis(), F.lit(DAY))).alias("ts")
    return o.settle(e.select(F.col("event_type").alias("key"), day, "value", F.col("event_id").alias("seq")), "BLOCK").drop("value")


@query(W + "SELECT key, t AS ts, CAST(row_number() OVER (PARTITION BY key ORDER BY t) * 3 AS BIGINT) AS value FROM ts")
def ts_incrby(s, d):
    return o.increments(typed(s, d).select("key", "ts", F.lit(3).alias("delta")))


@query(W + "SELECT key, t AS ts, CAST(row_number() OVER (PARTITION BY key ORDER BY t) * -2 AS BIGINT) AS value FROM ts")
def ts_decrby(s, d):
    return o.increments(typed(s, d).select("key", "ts", F.lit(-2).alias("delta")))


@query(W + f"SELECT key, count(*) AS deleted FROM ts WHERE t BETWEEN {JAN + DAY} AND {JAN + 3 * DAY} GROUP BY key")
def ts_del(s, d):
    return o.delete(typed(s, d), JAN + DAY, JAN + 3 * DAY)[1]


@query(W + f"SELECT key, count(*) AS samples, min(t) AS first, max(t) AS last FROM ts WHERE t >= {JAN + 20 * DAY} GROUP BY key")
def ts_retention(s, d):
    return o.info(o.retain(typed(s, d), 10 * DAY, JAN + 30 * DAY))


@query(W + "SELECT key, max(t) AS ts, arg_max(value, t) AS value FROM ts GROUP BY key")
def ts_get(s, d):
    return o.latest(typed(s, d))


@query(W + "SELECT key, count(*) AS samples, min(t) AS first, max(t) AS last FROM ts GROUP BY key")
def ts_info(s, d):
    return o.info(typed(s, d))


@query(W + f"SELECT key || ':daily' AS key, (t // {DAY}) * {DAY} AS ts, round(sum(value), 4) AS value FROM ts GROUP BY ALL")
def ts_createrule(s, d):
    got = o.rule(typed(s, d), F.concat("key", F.lit(":daily")), "sum", DAY)
    return got.select("key", "ts", F.round("value", 4).alias("value"))


FILTERS = {
    "eq": ("seg=1", "seg = '1'"), "ne": ("seg!=1", "(seg IS NULL OR seg <> '1')"), "exists": ("seg=", "seg IS NOT NULL"),
    "missing": ("seg!=", "seg IS NULL"), "in": ("seg=(0,3)", "seg IN ('0', '3')"), "not_in": ("seg!=(0,3)", "(seg IS NULL OR seg NOT IN ('0', '3'))"),
}


def _indexed(name, text, sql):
    @query(S + f"SELECT DISTINCT key FROM ts WHERE {sql}", name=f"ts_queryindex_{name}")
    def run(s, d):
        return o.query_index(series(s, d)[0], text).select("key")


for _name, (_text, _sql) in FILTERS.items():
    _indexed(_name, _text, _sql)


@query(S + f"SELECT key, ts, round(value, 4) AS value FROM (SELECT key, (t // {DAY}) * {DAY} AS ts, avg(value) AS value FROM ts WHERE seg = '2' GROUP BY ALL)")
def ts_mrange(s, d):
    names, samples = series(s, d)
    return o.multi_range(samples, names, "seg=2", how="avg", width=DAY, align=0).withColumn("value", F.round("value", 4))


@query(S + f"SELECT key, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS n FROM (SELECT key, (t // {DAY}) * {DAY} AS ts, max(value) AS value FROM ts WHERE seg IS NULL GROUP BY ALL)) WHERE n <= 3")
def ts_mrevrange(s, d):
    names, samples = series(s, d)
    return o.multi_range(samples, names, "seg!=", how="max", width=DAY, align=0, count=3, reverse=True)


@query(S + f"SELECT coalesce(seg, '') AS key, ts, max(value) AS value FROM (SELECT key, seg, (t // {DAY}) * {DAY} AS ts, min(value) AS value FROM ts GROUP BY ALL) GROUP BY ALL")
def ts_mrange_groupby(s, d):
    names, samples = series(s, d)
    return o.multi_range(samples, names, "type=", group="seg", reduce="max", how="min", width=DAY, align=0)


@query(S + "SELECT key, max(t) AS ts, arg_max(value, t) AS value FROM ts WHERE seg IN ('0', '1') GROUP BY key")
def ts_mget(s, d):
    names, samples = series(s, d)
    return o.multi_get(samples, names, "seg=(0,1)")
