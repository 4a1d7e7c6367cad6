"""Places: a 52-bit cell id is the score of a sorted set, 26 bits for each coordinate with
the longitude's bit first. All of it is column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..relations import firsts

# The grid's limits, its cells along each side, and the earth's radius.
LON, LAT = 180.0, 85.05112878
GRID = float(1 << 26)
RADIUS_M = 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
_EVEN = 0x5555555555555555


# Base conversions rather than masks: these would repeat the column in every step, and the
# repetitions multiply where a distance is computed.


def _spread(x: Column) -> Column:
    """Bits of ``x`` at even places: its binary digits read in base 4."""
    return F.conv(F.bin(x), 4, 10).cast("long")


def _gather(x: Column) -> Column:
    """Bits at even places of ``x``, side by side."""
    return F.conv(F.conv(x.bitwiseAND(F.lit(_EVEN)).cast("string"), 10, 4), 2, 10).cast("long")


def _cell(x: Column, limit: float) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x + limit) / (2 * limit)))
    return F.least(F.floor(share * GRID), F.lit(int(GRID) - 1)).cast("long")


def encode(lon: Column, lat: Column) -> Column:
    return F.shiftleft(_spread(_cell(lon, LON)), 1).bitwiseOR(_spread(_cell(lat, LAT)))


def longitude(cell: Column) -> Column:
    return (_gather(F.shiftright(cell, 1)) + 0.5) / GRID * (2 * LON) - LON


def latitude(cell: Column) -> Column:
    return (_gather(cell) + 0.5) / GRID * (2 * LAT) - LAT


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine, in metres."""
    u = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v))


def add(points: DataFrame) -> DataFrame:
    """``points(key, member, lon, lat)`` as zset; places beyond the grid are refused."""
    fine = (F.abs("lon") <= LON) & (F.abs("lat") <= LAT)
    return points.where(fine).select("key", "member", encode(F.col("lon"), F.col("lat")).cast("double").alias("score"))


def positions(zset: DataFrame) -> DataFrame:
    cell = F.col("score").cast("long")
    return zset.select("*", longitude(cell).alias("lon"), latitude(cell).alias("lat"))


def geohash(lon: Column, lat: Column) -> Column:
    """Eleven base-32 characters over +-180 and +-90 degrees, the last of which is 0."""
    side = float(1 << 25)
    x = F.least(F.floor((lon + 180) / 360 * side), F.lit(int(side) - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * side), F.lit(int(side) - 1)).cast("long")
    bits = F.shiftleft(_spread(x), 1).bitwiseOR(_spread(y))
    letter = lambda i: F.substring(F.lit(ALPHABET), (F.shiftright(bits, 45 - 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1))
    return F.concat(*(letter(i) for i in range(10)), F.lit("0"))


def _in_box(lon: Column, lat: Column, lon0: Column, lat0: Column, width: float, height: float) -> Column:
    tall = distance(lon, lat, lon, lat0) <= height / 2
    wide = distance(lon, lat, lon0, lat) <= width / 2  # at the place's own latitude
    return tall & wide


def search(zset: DataFrame, lon: float, lat: float, radius: float | None = None, box: tuple[float, float] | None = None, unit: str = "m", order: str | None = None, count: int | None = None) -> DataFrame:
    """Places of each key around one centre, with lon, lat and dist (in ``unit``). Without
    an order ``count`` takes the first by cell id, not the nearest."""
    at, here = positions(zset), (F.lit(lon), F.lit(lat))
    metres = distance(*here, F.col("lon"), F.col("lat"))
    scale = UNITS[unit]
    if radius is not None:
        reach = radius * scale
        near = metres <= reach
    else:
        reach = box[1] * scale / 2
        near = _in_box(F.col("lon"), F.col("lat"), *here, box[0] * scale, box[1] * scale)
    band = float(reach / RADIUS_M) * 57.29577951308232 * 1.000001
    got = at.where(F.col("lat").between(lat - band, lat + band) & near).withColumn("dist", metres / scale)
    if count is None:
        return got
    by = {"ASC": [F.asc("dist"), F.asc("member")], "DESC": [F.desc("dist"), F.desc("member")], None: [F.asc("score"), F.asc("member")]}[order]
    return firsts(got, by, count).drop("n")


def search_around(zset: DataFrame, centres: DataFrame, radius_m: float) -> DataFrame:
    """Places within the radius of each of ``centres(key, centre)`` (members of the same
    key): an equi-join on grid cells that are at least one radius wide, then the exact
    distance. The cells' width grows towards the poles with the latitude's band."""
    step = max(radius_m / RADIUS_M * 57.29577951308232 * 1.000001, 1e-6)
    at = positions(zset)
    band = lambda c: F.floor((c + 90) / step).cast("long")

    def cells(b: Column) -> Column:
        """How many cells go around the globe in a band: each is as wide as the longitudes
        differ at most between a place in it and a centre in it or next to it."""
        far = F.greatest(F.abs((b - 1) * step - 90), F.abs((b + 2) * step - 90))
        widest = F.degrees(F.asin(F.least(F.sin(F.radians(F.lit(min(step, 90.0)))) / F.cos(F.radians(F.least(far, F.lit(89.9)))), F.lit(1.0))))
        return F.when(far + step >= 90, F.lit(1)).otherwise(F.greatest(F.floor(360 / widest), F.lit(1))).cast("long")

    spot = lambda lon, n: F.least(F.floor((lon + 180) / 360 * n), n - 1).cast("long")
    mid = centres.join(at.withColumnRenamed("member", "centre"), ["key", "centre"]).select("key", "centre", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    mid = mid.withColumn("band", F.explode(F.sequence(band(F.col("lat0")) - 1, band(F.col("lat0")) + 1)))
    mid = mid.withColumn("n", cells(F.col("band")))
    three = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.pmod(spot(F.col("lon0"), F.col("n")) + i, F.col("n")))
    mid = mid.withColumn("cell", F.explode(F.array_distinct(three)))
    all_ = at.withColumn("band", band(F.col("lat"))).withColumn("cell", spot(F.col("lon"), cells(F.col("band"))))
    dist = distance(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat"))
    return all_.join(mid, ["key", "band", "cell"]).withColumn("dist", dist).where(F.col("dist") <= radius_m).select("key", "centre", "member", "dist")
