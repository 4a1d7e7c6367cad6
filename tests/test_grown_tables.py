"""Queries and operators on tables larger than the given ones, and on rows these do not hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from keyloom import catalog
from keyloom.operators import hashes, pubsub, sketches, vectors

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Suppliers that write to the same keys: 10 x 400 of them, of whom two meet in a key."""
    folder = tmp_path_factory.mktemp("repeated")
    c = duckdb.connect()
    for name in ("customer", "events"):
        c.execute(f"COPY (SELECT * FROM '{DATA}/{name}.parquet') TO '{folder}/{name}.parquet'")
    c.execute(f"COPY (SELECT * REPLACE (s_suppkey + 10 * i AS s_suppkey, s_name || i AS s_name) FROM '{DATA}/supplier.parquet', range(400) r(i)) TO '{folder}/supplier.parquet'")
    for name in ("customer", "events", "supplier"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), c


def same(spark, repeated, name):
    folder, c = repeated
    df = catalog.queries()[name](spark, folder)
    got = sorted(map(repr, (tuple(r) for r in df.collect())))
    want = sorted(map(repr, c.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()))
    assert got == want


def test_rounding_keeps_the_sign_of_zero(spark):
    df = spark.createDataFrame([(x,) for x in (-0.00004, 0.00004, -0.0, 0.0, -0.03125, 0.03125, float("nan"), float("-inf"), None)], "x double")
    got = [repr(r[0]) for r in df.select(vectors.rounded(F.col("x"), 4)).collect()]
    assert got == ["-0.0", "0.0", "-0.0", "0.0", "-0.0313", "0.0313", "nan", "-inf", "None"]


def test_each_write_has_its_reply(spark):
    old = spark.createDataFrame([("k", "a", "1", 5), ("k", "b", "2", None), ("k", "c", "3", None)], "key string, field string, value string, expires_at long")
    new = spark.createDataFrame([("k", "b", "x"), ("k", "b", None), ("k", "a", "y"), ("k", "a", "z")], "key string, field string, value string")
    got = hashes.replies(old, new, 10).select("field", "value", "is_new", "written").collect()
    assert sorted(map(tuple, got), key=repr) == [("a", "y", True, True), ("a", "z", True, True), ("b", "x", False, True), ("b", None, False, True), ("c", "3", False, False)]
    last = hashes.put(old, new.withColumn("seq", F.ascii("value")), 10).select("field", "value").collect()
    assert sorted(map(tuple, last)) == [("a", "z"), ("b", "x"), ("c", "3")]


@pytest.mark.parametrize("name", ["hmset", "hset", "hsetex", "hsetex_keepttl", "hsetnx"])
def test_hashes_that_two_suppliers_write_to(spark, repeated, name):
    same(spark, repeated, name)


@pytest.fixture
def crowded(monkeypatch):
    """Cuckoo filters of 15 fingerprints, whose slots are shared."""
    monkeypatch.setattr(sketches, "PRINT_BITS", 4)


def test_cuckoo_answers_where_items_share_a_slot(spark, crowded):
    rows = [("k", str(i)) for i in range(40) for _ in range(i % 3 + 1)] + [("k", None), ("z", "1")]
    items = spark.createDataFrame(rows, "key string, item string")
    asked = spark.createDataFrame([("k", str(i)) for i in range(60)] + [("k", None), ("z", "2"), ("none", "1")], "key string, item string")
    slots, counts = sketches.cuckoo(items, 4), sketches.multiset(items)
    rough = sketches.cuckoo_count(slots, asked, 4)
    want = {(k, i): rows.count((k, i)) for k, i in map(tuple, asked.collect())}
    assert {(r["key"], r["item"]): r["n"] for r in rough.collect()} != want
    got = sketches.cuckoo_exact(rough, counts, 4).collect()
    assert {(r["key"], r["item"]): r["n"] for r in got} == want and len(got) == len(want)
    assert all(r["found"] == (r["n"] > 0) for r in got)


@pytest.mark.parametrize("name", ["cf_add", "cf_addnx", "cf_count", "cf_del", "cf_info", "cf_mexists", "cf_scandump_loadchunk"])
def test_cuckoo_queries_where_items_share_a_slot(spark, repeated, crowded, monkeypatch, name):
    from keyloom.plans import sketches as plans

    monkeypatch.setattr(plans, "CF", 4)
    same(spark, repeated, name)


def test_bloom_filters_grow_with_their_items(spark):
    items = spark.range(2050).select(F.when(F.col("id") < 2000, "many").otherwise("few").alias("key"), F.col("id").cast("string").alias("item"))
    absent = spark.range(1000).select(F.explode(F.array(*map(F.lit, ("many", "few", "none")))).alias("key"), F.concat(F.lit("none"), "id").alias("item"))
    state = sketches.bloom_grown(items, 0.01, 100)
    assert sketches.bloom_grown_has(state, items, 0.01, 100).where("found").count() == 2050
    found = {r[0]: r[1] for r in sketches.bloom_grown_has(state, absent, 0.01, 100).groupBy("key").agg(F.count_if("found")).collect()}
    assert found["many"] <= 40 and found["few"] <= 5 and found["none"] == 0 and len(found) == 3
    rough = sketches.bloom_has(sketches.bloom(items, 0.01, 100), absent, 0.01, 100)
    assert rough.where("key = 'many' AND found").count() > 900  # one filter of that size is full
    info = {r["key"]: r for r in sketches.bloom_grown_info(state, 0.01, 100).collect()}
    assert info["many"]["parts"] == 20 and info["few"]["parts"] == 1


@pytest.fixture
def overfull(monkeypatch):
    from keyloom.plans import sketches as plans

    items = plans.items
    more = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3199)), lambda i: F.concat("item", F.lit("-"), i.cast("string"))))
    monkeypatch.setattr(plans, "items", lambda s, d: items(s, d).distinct().select("key", "n", more.alias("item")))


@pytest.mark.parametrize("name", ["bf_info", "bf_mexists_absent"])
def test_bloom_queries_beyond_the_capacity(spark, repeated, overfull, name):
    same(spark, repeated, name)


def fan(spark):
    messages = spark.createDataFrame([(i, c, at) for i, (c, at) in enumerate([("a", 1), ("a", 5), ("a", 5), ("ab", 7), ("b", 30), ("a", 99), (None, 5), ("none", 1)])], "id long, channel string, at long")
    exact = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "x"), ("quiet", "z"), (None, "w")], "channel string, subscriber string")
    return messages, exact, [("a*", "P"), ("*b", "P"), ("zz", "Q")]


def counted(df, *names):
    return sorted(map(tuple, df.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()))


@pytest.mark.parametrize("patterns", [True, False])
def test_copies_are_counted_without_being_made(spark, patterns):
    messages, exact, given = fan(spark)
    given = given if patterns else []
    sent = pubsub.deliveries(messages, exact, given)
    assert sorted(map(tuple, pubsub.delivery_counts(pubsub.channel_counts(messages), exact, given).collect())) == counted(sent, "subscriber")
    assert sorted(map(tuple, pubsub.receiver_counts(messages, exact, given).collect())) == sorted(map(tuple, pubsub.receivers(messages, sent).collect()))
    assert sorted(map(tuple, pubsub.shard_counts(messages, exact, 3).collect())) == counted(pubsub.on_shard(messages, exact, 3), "channel", "shard")


@pytest.mark.parametrize("part", [1, 10, 3_600_000])
def test_copies_of_spans_are_counted_without_being_made(spark, monkeypatch, part):
    monkeypatch.setattr(pubsub, "PART", part)
    messages, _, _ = fan(spark)
    spans = [("a", "x", 5, 99), ("a", "x", 99, None), ("a", "y", -20, 5), ("a", "z", 6, 6), ("a", "u", 9, 2), ("ab", "x", 7, 8), ("b", "v", 31, None), ("quiet", "w", 0, None), (None, "w", 0, None), ("a", "y", 50, None), ("a", "y", 0, 1000)]
    spans = spark.createDataFrame(spans, "channel string, subscriber string, since long, until long")
    want = counted(pubsub.deliveries_during(messages, spans), "subscriber")
    assert sorted(map(tuple, pubsub.delivery_counts_during(messages, spans).collect())) == want


@pytest.mark.parametrize("name", ["publish", "psubscribe", "spublish", "stream_publish", "subscribe_until"])
def test_fan_out_makes_no_copies(spark, repeated, monkeypatch, name):
    for way in ("deliveries", "deliveries_during", "on_shard"):
        monkeypatch.delattr(pubsub, way)
    same(spark, repeated, name)
