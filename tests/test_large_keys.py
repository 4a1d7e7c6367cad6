"""Ranks in keys too large for one task, and rows that would stop a careless operator."""

import math
import random

import pytest
from pyspark.sql import functions as F

from keyloom import relations
from keyloom.operators import jsondoc, lists, sketches, strings, zsets


@pytest.fixture
def spread(monkeypatch):
    monkeypatch.setattr(relations, "SPREAD_ROWS", 20)
    monkeypatch.setattr(relations, "SPREAD_PARTS", 7)


def members(rng):
    pool = [float("-inf"), float("inf"), -1e300, 1e300, 0.0, 0.0, 0.0, 5.5]
    return [("a", f"m{i}", rng.choice([*pool, rng.uniform(-9, 9)])) for i in range(200)] + [("b", f"m{i}", 1.0) for i in range(30)] + [("c", "x", 2.0)]


@pytest.mark.parametrize("reverse", [False, True])
def test_ranks_in_parts(spark, spread, reverse):
    rows = members(random.Random(1))
    z = spark.createDataFrame(rows, "key string, member string, score double")
    want = {}
    for key in "abc":
        own = sorted(((s, m) for k, m, s in rows if k == key), reverse=reverse)
        want |= {(key, m): n for n, (_, m) in enumerate(own)}
    got = {(r["key"], r["member"]): r["rank"] for r in zsets.rank_of(z, z, reverse).collect()}
    assert got == want
    middle = {(r["key"], r["member"]) for r in zsets.by_rank(z, 3, -4, reverse).collect()}
    size = {"a": 200, "b": 30, "c": 1}
    assert middle == {k for k, n in want.items() if 3 <= n <= size[k[0]] - 4}
    tail = {(r["key"], r["member"]): r["rank"] for r in zsets.by_rank(z, -6, -2, reverse).collect()}
    assert tail == {k: n for k, n in want.items() if size[k[0]] - 6 <= n <= size[k[0]] - 2}


def test_list_indexes_in_parts(spark, spread):
    df = spark.createDataFrame([("a", p * p, str(p)) for p in range(100)] + [("b", 5, "x")], "key string, pos long, value string")
    got = [r["value"] for r in lists.slice_of(df, 10, -11).orderBy("index").collect()]
    assert got == [str(p) for p in range(10, 90)]
    after = lists.insert(df, "50", "new", after=True)
    assert [r["value"] for r in after.where("key = 'a'").orderBy("pos").collect()][49:53] == ["49", "50", "new", "51"]


@pytest.mark.parametrize("make", [lambda z: zsets.pop(z, 3)[0], lambda z: zsets.by_rank(z, 0, 9), lambda z: zsets.by_rank(z, -9, -1), lambda z: lists.pop(z.withColumnsRenamed({"member": "value", "score": "pos"}), 2)[0]])
def test_plans_keep_few_rows_before_the_shuffle(spark, capsys, make):
    make(spark.range(100).selectExpr("cast(id % 3 as string) AS key", "cast(id as string) AS member", "cast(id as double) AS score")).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_items_that_are_null_stay(spark):
    df = spark.createDataFrame([("k", 0, "a"), ("k", 1, None), ("k", 2, "b"), ("k", 3, "b")], "key string, pos long, value string")
    assert [r["value"] for r in lists.remove(df, "b").orderBy("pos").collect()] == ["a", None]
    assert [r["value"] for r in lists.remove(df, "b", -1).orderBy("pos").collect()] == ["a", None, "b"]


def test_least_and_greatest_pass_over_nan(spark):
    df = spark.createDataFrame([("x", "m", float("inf")), ("y", "m", 4.0), ("x", "n", float("inf"))], "key string, member string, score double")
    for how in ("MIN", "MAX"):
        got = {r["member"]: r["score"] for r in zsets.union(df, ["x", "y"], [0, 1], how).collect()}
        assert got["m"] == 4.0 and math.isnan(got["n"])


def test_an_overflow_stops_one_key(spark):
    df = spark.createDataFrame([("a", 2**63 - 1, 1), ("a", 1, 2), ("b", 5, 1)], "key string, delta long, seq long")
    got = {(r["key"], r["seq"]): r["value"] for r in strings.increments(df).collect()}
    assert got == {("a", 1): 2**63 - 1, ("a", 2): None, ("b", 1): 5}


def test_a_malformed_document_stops_no_other(spark):
    df = spark.createDataFrame([(1, '{"a":[1,{"b":"x"}],"f":1.0}'), (2, "not json"), (3, None)], "key long, doc string").orderBy("key")
    x = F.col("doc")
    got = df.select(jsondoc.get(x, "$.f"), jsondoc.type_of(x, "$.f"), jsondoc.arr_len(x, "$.a"), jsondoc.str_len(x, "$.a[-1].b"), jsondoc.put(x, "$.f", "2"), jsondoc.delete(x, "$.a").getField("doc"), jsondoc.valid(x)).collect()
    assert list(map(tuple, got)) == [("1.0", "number", 2, 1, '{"a":[1,{"b":"x"}],"f":2}', '{"f":1.0}', True), (None, None, None, None, "not json", "not json", False), (None,) * 7]


def test_built_in_json_reads_equal_those_in_batches(spark):
    docs = ['{"a":1,"b":-2.5,"c":"é\\n","d":[1,[2]],"e":{"x y":null,"z":true},"n":1e3}', "[]", '"s"', "3", "null"]
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    for path in ("$", "$.a", "$.b", "$.c", "$.d", "$.d[1]", "$.e", "$.e['x y']", "$.e.z", "$.n", "$.none"):
        assert jsondoc.definite(path)
        for make, f in ((jsondoc.type_of, lambda v: jsondoc.TYPES[type(v)]), (jsondoc.str_len, lambda v: len(v) if isinstance(v, str) else None), (jsondoc.arr_len, lambda v: len(v) if isinstance(v, list) else None), (jsondoc.obj_len, lambda v: len(v) if isinstance(v, dict) else None), (jsondoc.obj_keys, lambda v: list(v) if isinstance(v, dict) else None)):
            hits = [jsondoc.find(jsondoc.loads(d)[0], jsondoc.parse_path(path)) for d in docs]
            assert [r[0] for r in df.select(make(F.col("doc"), path)).collect()] == [f(h[0][2]) if h else None for h in hits], path


def test_digests_of_parts_merge_to_that_of_all(spark):
    df = spark.range(3000).selectExpr("id % 3 AS key", "cast(id * 7919 % 3001 as double) AS value")
    parts = sketches.digest_merge(sketches.digest(df, 100), [0, 1, 2], 9)
    (q,) = [r["quantiles"][0] for r in sketches.quantiles(parts, 0.5).collect()]
    assert abs(q - 1500) < 150
    info = sketches.digest_info(parts).first()
    assert info["n"] == 3000 and info["bytes"] < 8000
    assert sketches.digest_info(sketches.digest_create(df.select("key").distinct())).first()["bytes"] == 0


def test_cuckoo_slots_never_lose_an_item(spark):
    items = spark.range(500).selectExpr("'k' AS key", "cast(id as string) AS item")
    state = sketches.cuckoo_load(sketches.cuckoo_dump(sketches.cuckoo(items, 600), 64))
    assert sketches.cuckoo_count(state, items, 600).where("NOT found").count() == 0
    left = sketches.cuckoo_delete(state, items.where("item < 250"), 600)
    assert sketches.cuckoo_info(left, 600).first()["items"] == 250
    assert sketches.cuckoo_count(left, items.where("item >= 250"), 600).where("NOT found").count() == 0
