"""Small cases: edges of ranges, quirks that are kept, ties, and models in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import Library
from keyloom.operators import geo, jsondoc, keyspace, lists, sets, streams, strings, timeseries, zsets
from keyloom.relations import glob_regex


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_zset_algebra(spark):
    z = spark.createDataFrame([("A", "a", 1.0), ("A", "b", 2.0), ("A", "c", 3.0), ("B", "b", 1.0), ("B", "c", 2.0), ("B", "d", 3.0)], "key string, member string, score double")
    assert rows(zsets.union(z, ["A", "B"]), "member", "score") == [("a", 1), ("b", 3), ("c", 5), ("d", 3)]
    assert rows(zsets.inter(z, ["A", "B"], [2, 3]), "member", "score") == [("b", 7), ("c", 12)]
    assert zsets.inter_card(z, ["A", "B"], 1).first()[0] == 1


def test_zset_bounds_with_infinities(spark):
    inf = float("inf")
    z = spark.createDataFrame([("k", m, s) for m, s in zip("abcdefg", [-inf, 1.0, 2.0, 3.0, 4.0, 5.0, inf])], "key string, member string, score double")
    assert [r[0] for r in rows(zsets.by_score(z, "-inf", "2"), "member")] == ["a", "b", "c"]
    assert [r[0] for r in rows(zsets.by_score(z, "(2", "+inf"), "member")] == ["d", "e", "f", "g"]
    assert zsets.by_lex(z, "-", "+").count() == 0  # scores differ


def test_zset_rank_model(spark):
    rng = random.Random(3)
    data = [("k", f"m{i}", float(rng.randint(0, 9))) for i in range(60)]
    z = spark.createDataFrame(data, "key string, member string, score double")
    order = sorted(data, key=lambda r: (r[2], r[1]))
    for first, last in [(0, 5), (-7, -3), (10, -1), (55, 99)]:
        lo, hi = (x + 60 if x < 0 else x for x in (first, last))
        assert rows(zsets.by_rank(z, first, last), "member") == sorted((r[1],) for r in order[lo : hi + 1])


def test_empty_relations(spark):
    z = spark.createDataFrame([], "key string, member string, score double")
    assert zsets.card(z).count() == zsets.union(z, ["a"]).count() == zsets.pop(z, 2)[0].count() == 0
    assert sets.inter(z.select("key", "member"), ["a", "b"]).count() == 0


def test_list_positions(spark):
    items = spark.createDataFrame([("k", i, v) for i, v in enumerate("abaca")], "key string, pos long, value string")
    assert rows(lists.positions(items, "a", count=0), "index") == [(0,), (2,), (4,)]
    assert rows(lists.positions(items, "a", nth=-2), "index") == [(2,)]
    assert lists.positions(spark.createDataFrame([("k", i, v) for i, v in enumerate("xxxa")], "key string, pos long, value string"), "a", most=3).count() == 0
    assert rows(lists.remove(items, "a", 1), "pos") == [(1,), (2,), (3,), (4,)]


def test_lcs():
    assert strings.common_subsequence(b"ohmytext", b"mynewtext")[:2] == (b"mytext", 6)
    assert strings.common_subsequence(b"", b"x") == (b"", 0, [])


def test_ranges_of_bytes(spark):
    df = spark.createDataFrame([("été!",), (None,), ("",)], "v string")
    got = [r[0] for r in df.select(F.hex(strings.getrange(F.col("v"), 0, 2))).collect()]
    assert got == ["C3A974", "", ""]
    assert spark.createDataFrame([("ab",)], "v string").select(F.hex(strings.setrange(F.col("v"), 4, b"Z"))).first()[0] == "616200005A"


def test_time_series_buckets(spark):
    s = spark.createDataFrame([("k", 0, 1.0), ("k", 10, 3.0), ("k", 20, 5.0), ("k", 30, 7.0)], "key string, ts long, value double")
    assert rows(timeseries.range_of(s, 0, 39, "avg", 20), "ts", "value") == [(0, 2.0), (20, 6.0)]
    assert timeseries.delete(s, 10, 20)[1].first()["deleted"] == 2
    twice = spark.createDataFrame([("k", 10, 1.0, 1), ("k", 10, 2.5, 2)], "key string, ts long, value double, seq int")
    assert timeseries.settle(twice, "SUM").first()["value"] == 3.5
    assert rows(timeseries.range_of(s.where("ts <> 10"), 0, 39, "count", 10), "ts", "value") == [(0, 1.0), (10, 0.0), (20, 1.0), (30, 1.0)]


@pytest.mark.parametrize("text,want", [("s=", ["a", "b"]), ("s!=", ["c"]), ("s=x", ["a"]), ("s!=x", ["b", "c"]), ("s=(x,y)", ["a", "b"]), ("s!=(x,z)", ["b", "c"])])
def test_label_filters(spark, text, want):
    series = spark.createDataFrame([("a", {"s": "x"}), ("b", {"s": "y"}), ("c", {"t": "x"})], "key string, labels map<string,string>")
    assert [r[0] for r in rows(timeseries.query_index(series, text), "key")] == want


def test_expire_less_than_needs_a_deadline(spark):
    kv = spark.createDataFrame([("a", "1", None), ("b", "1", 900)], "key string, value string, expires_at long")
    asked = kv.select("key")
    assert rows(keyspace.expire(kv, asked, F.lit(800).cast("long"), 0, "LT"), "key", "applied") == [("a", 0), ("b", 1)]


def test_globs():
    assert glob_regex("h[a-c]?o*") == "(?s)^h[a-c].o.*$"
    assert glob_regex("a.b") == r"(?s)^a\.b$"


def test_geo(spark):
    p = spark.createDataFrame([("s", "Palermo", 13.361389, 38.115556), ("s", "Catania", 15.087269, 37.502669)], "key string, member string, lon double, lat double")
    z = geo.add(p)
    assert {r["member"]: int(r["score"]) for r in z.collect()} == {"Palermo": 3479099956230698, "Catania": 3479447370796909}
    got = geo.search_around(z, z.where("member = 'Palermo'").select("key", F.col("member").alias("centre")), 200_000)
    assert abs({r["member"]: r["dist"] for r in got.collect()}["Catania"] - 166274.15) < 1
    assert geo.search(z, 15, 37, radius=100, unit="km").select("member").collect()[0][0] == "Catania"


def test_stream_ids_never_go_back(spark):
    st = spark.createDataFrame([("k", 50, 3)], "key string, ms long, seq long")
    new = spark.createDataFrame([("k", 10, 0), ("k", 50, 1), ("k", 60, 2), ("k", 55, 3)], "key string, at long, n int")
    assert rows(streams.append(st, new), "ms", "seq") == [(50, 4), (50, 5), (60, 0), (60, 1)]


def test_json_paths():
    doc = {"a": [{"b": 1}, {"b": 2}], "c": {"d": None}}
    assert [v for *_, v in jsondoc.find(doc, jsondoc.parse_path("$.a[*].b"))] == [1, 2]
    assert [v for *_, v in jsondoc.find(doc, jsondoc.parse_path(".a[-1]"))] == [{"b": 2}]
    assert jsondoc.merge_patch({"a": 1, "b": {"c": 1}}, {"a": None, "b": {"d": 2}}) == {"b": {"c": 1, "d": 2}}
    with pytest.raises(ValueError):
        jsondoc.parse_path("$..a")


def test_library(spark):
    lib = Library()
    lib.load("twice", lambda s: s * 2, "long")
    assert spark.range(3).select(lib.call("twice", F.col("id"))).collect()[2][0] == 4
    with pytest.raises(ValueError):
        lib.load("twice", lambda s: s, "long")
