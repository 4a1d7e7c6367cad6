"""Places: one for each customer, by market segment."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import geo as o
from .bindings import GEO, geo

R = 6372797.560856




def haversine(a, b, c, d):
    return f"2*{R}*asin(sqrt(pow(sin((radians({d})-radians({b}))/2),2)+cos(radians({b}))*cos(radians({d}))*pow(sin((radians({c})-radians({a}))/2),2)))"


W = f"WITH {GEO}, c AS (SELECT *, CAST(floor((lon+180)/360*67108864) AS BIGINT) AS x, CAST(floor((lat+85.05112878)/170.10225756*67108864) AS BIGINT) AS y FROM g), p AS (SELECT key, member, x, y, (x+0.5)/67108864*360-180 AS lon, (y+0.5)/67108864*170.10225756-85.05112878 AS lat FROM c) "
BITS = "(SELECT sum(((x >> i) & 1) << (2 * i + 1)) + sum(((y >> i) & 1) << (2 * i)) FROM range(26) r(i))"


@query(W + f"SELECT key, member, CAST({BITS} AS DOUBLE) AS score FROM p")
def geoadd(s, d):
    return o.add(geo(s, d))


@query(W + "SELECT key, member, round(lon, 6) AS lon, round(lat, 6) AS lat FROM p")
def geopos(s, d):
    return o.positions(o.add(geo(s, d))).select("key", "member", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(W + f", q AS (SELECT key, arg_min(lon, CAST(member AS BIGINT)) AS lon0, arg_min(lat, CAST(member AS BIGINT)) AS lat0 FROM p GROUP BY key) SELECT key, member, round(({haversine('lon0', 'lat0', 'lon', 'lat')}) / 1000, 3) AS km FROM p JOIN q USING (key)")
def geodist(s, d):
    at = o.positions(o.add(geo(s, d)))
    first = at.groupBy("key").agg(F.min_by("lon", F.col("member").cast("long")).alias("lon0"), F.min_by("lat", F.col("member").cast("long")).alias("lat0"))
    return at.join(first, "key").select("key", "member", F.round(o.distance(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")) / o.UNITS["km"], 3).alias("km"))


@query(W + ", h AS (SELECT key, member, CAST(floor((lon+180)/360*33554432) AS BIGINT) AS x, CAST(floor((lat+90)/180*33554432) AS BIGINT) AS y FROM p), b AS (SELECT key, member, (SELECT sum(((x >> i) & 1) << (2 * i + 1)) + sum(((y >> i) & 1) << (2 * i)) FROM range(25) r(i))::BIGINT AS bits FROM h) SELECT key, member, (SELECT string_agg('0123456789bcdefghjkmnpqrstuvwxyz'[((bits >> (45 - 5 * i)) & 31) + 1], '' ORDER BY i) FROM range(10) r(i)) || '0' AS hash FROM b")
def geohash(s, d):
    at = o.positions(o.add(geo(s, d)))
    return at.select("key", "member", o.geohash(F.col("lon"), F.col("lat")).alias("hash"))


def _search(name, where, order=None, count=None, unit="km", **kind):
    dist = f"({haversine('10.0', '40.0', 'lon', 'lat')}) / {o.UNITS[unit]}"
    limit = f" WHERE n <= {count}" if count else ""
    by = {"ASC": "dist, member", "DESC": "dist DESC, member DESC", None: f"{BITS}, member"}[order]
    sql = W + f"SELECT key, member, round(dist, 3) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {by}) AS n FROM (SELECT *, {dist} AS dist FROM p) WHERE {where}){limit}"

    @query(sql, name=name)
    def run(s, d):
        got = o.search(o.add(geo(s, d)), 10.0, 40.0, unit=unit, order=order, count=count, **kind)
        return got.select("key", "member", F.round("dist", 3).alias("dist"))


BOX = f"({haversine('lon', 'lat', 'lon', '40.0')}) <= 2000000 AND ({haversine('lon', 'lat', '10.0', 'lat')}) <= 1500000"
_search("geosearch", "dist <= 3000", radius=3000)
_search("geosearch_count", "dist <= 6000", count=4, radius=6000)
_search("geosearch_box", BOX, box=(3000, 4000))
_search("georadius", "dist <= 2500", "ASC", 3, "mi", radius=2500)
_search("georadius_ro", "dist <= 9000", "DESC", 5, radius=9000)


@query(W + f"SELECT 'near' AS key, member, round(({haversine('10.0', '40.0', 'lon', 'lat')}), 2) AS score FROM p WHERE ({haversine('10.0', '40.0', 'lon', 'lat')}) <= 1500000")
def geosearchstore(s, d):
    got = o.search(o.add(geo(s, d)), 10.0, 40.0, radius=1500, unit="km")
    return got.select(F.lit("near").alias("key"), "member", F.round(F.col("dist") * 1000, 2).alias("score"))


AROUND = W + ", m AS (SELECT key, member AS centre, lon AS lon0, lat AS lat0 FROM p WHERE CAST(member AS BIGINT) % 100 = 0) SELECT key, centre, member, round(dist, 2) AS dist FROM (SELECT key, centre, member, " + haversine("lon0", "lat0", "lon", "lat") + " AS dist FROM p JOIN m USING (key)) WHERE dist <= {r}"


def _around(name, radius):
    @query(AROUND.format(r=radius), name=name)
    def run(s, d):
        places = o.add(geo(s, d))
        centres = places.where(F.col("member").cast("long") % 100 == 0).select("key", F.col("member").alias("centre"))
        return o.search_around(places, centres, radius).withColumn("dist", F.round("dist", 2))


_around("georadiusbymember", 700_000)
_around("georadiusbymember_ro", 2_500_000)
