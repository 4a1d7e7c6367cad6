"""JSON documents: parts."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import jsondoc as o
from .bindings import docs

DOC = "'{{\"name\":\"' || p_name || '\",\"size\":' || {size} || ',\"tags\":[{tags}],\"meta\":{{\"id\":' || p_partkey || ',\"big\":' || {big} || '}}}}'"
SIZE, TAGS, BIG = "p_size", "\"' || p_brand || '\",\"' || p_type || '\"", "(p_size > 25)"


def doc(size=SIZE, tags=TAGS, big=BIG, tail=None):
    out = DOC.format(size=size, tags=tags, big=big)
    return out if tail is None else out[:-2] + tail + "}'"


def _q(name, sql, make):
    @query(f"SELECT p_partkey AS key, {sql} FROM part", name=f"json_{name}")
    def run(s, d):
        return docs(s, d).select("key", *make(F.col("doc")))


_q("get", "'\"' || p_brand || '\"' AS x", lambda x: [o.get(x, "$.tags[0]").alias("x")])
_q("get_many", "'{\"$.size\":' || p_size || ',\"$.tags[*]\":[' || '\"' || p_brand || '\",\"' || p_type || '\"]}' AS x", lambda x: [o.get(x, "$.size", "$.tags[*]").alias("x")])
_q("mget", "CAST(p_partkey AS VARCHAR) AS x", lambda x: [o.value(x, "$.meta.id").alias("x")])
_q("set", doc(tail=',\"new\":[1,2]') + " AS doc", lambda x: [o.put(x, "$.new", "[1,2]").alias("doc")])
_q("set_xx", doc(size="7") + " AS doc", lambda x: [o.put(o.put(x, "$.size", "7", "XX"), "$.none", "1", "XX").alias("doc")])
_q("mset", doc(size="8", big="false") + " AS doc", lambda x: [o.put(o.put(x, "$.size", "8"), "$.meta.big", "false").alias("doc")])
_q("del", doc(tags="\"' || p_type || '\"") + " AS doc, '1' AS reply", lambda x: [c for c in [o.delete(x, "$.tags[0]").getField("doc").alias("doc"), o.delete(x, "$.tags[0]").getField("reply").alias("reply")]])
_q("forget", "'{\"name\":\"' || p_name || '\",\"size\":' || p_size || ',\"tags\":[],\"meta\":{}}' AS doc", lambda x: [o.delete(o.delete(x, "$.meta.*").getField("doc"), "$.tags[*]").getField("doc").alias("doc")])
_q("merge", doc(size="1", tail="") .replace(",\"tags\":[\"' || p_brand || '\",\"' || p_type || '\"]", "") + " AS doc", lambda x: [o.merge(x, "$", '{"size":1,"tags":null}').alias("doc")])
_q("type", "'object' AS a, 'array' AS b, 'string' AS c, 'integer' AS e, 'boolean' AS f", lambda x: [o.type_of(x, p).alias(n) for p, n in (("$.meta", "a"), ("$.tags", "b"), ("$.name", "c"), ("$.size", "e"), ("$.meta.big", "f"))])
_q("toggle", doc(big="(p_size <= 25)") + " AS doc, CASE WHEN p_size > 25 THEN 'false' ELSE 'true' END AS reply", lambda x: [o.toggle(x, "$.meta.big").getField(n).alias(n) for n in ("doc", "reply")])
_q("clear", doc(size="0", tags="") + " AS doc", lambda x: [o.clear(o.clear(x, "$.size").getField("doc"), "$.tags").getField("doc").alias("doc")])
_q("numincrby", "CAST(p_size + 2.5 AS DOUBLE) AS x", lambda x: [o.num_incr(x, "$.size", 2.5).getField("reply").cast("double").alias("x")])
_q("nummultby", "CAST(p_size * 3 AS DOUBLE) AS x", lambda x: [o.num_mult(x, "$.size", 3).getField("reply").cast("double").alias("x")])
_q("strlen", "length(p_name) AS x", lambda x: [o.str_len(x, "$.name").alias("x")])
_q("strappend", "CAST(strlen(p_name) + 3 AS VARCHAR) AS x, p_name || '-é' AS name", lambda x: [o.str_append(x, "$.name", "-é").getField("reply").alias("x"), o.value(o.str_append(x, "$.name", "-é").getField("doc"), "$.name").alias("name")])
_q("arrlen", "CAST(2 AS BIGINT) AS x", lambda x: [o.arr_len(x, "$.tags").alias("x")])
_q("arrappend", doc(tags=TAGS + ",1,null") + " AS doc, '4' AS reply", lambda x: [o.arr_append(x, "$.tags", "1", "null").getField(n).alias(n) for n in ("doc", "reply")])
_q("arrinsert", doc(tags="\"' || p_brand || '\",true,\"' || p_type || '\"") + " AS doc", lambda x: [o.arr_insert(x, "$.tags", -1, "true").getField("doc").alias("doc")])
_q("arrpop", doc(tags="\"' || p_brand || '\"") + " AS doc, '\"' || p_type || '\"' AS reply", lambda x: [o.arr_pop(x, "$.tags").getField(n).alias(n) for n in ("doc", "reply")])
_q("arrtrim", doc(tags="\"' || p_type || '\"") + " AS doc", lambda x: [o.arr_trim(x, "$.tags", 1, -1).getField("doc").alias("doc")])
_q("arrindex", "CAST(CASE WHEN p_brand = 'Brand#11' THEN 0 ELSE -1 END AS BIGINT) AS x", lambda x: [o.arr_index(x, "$.tags", '"Brand#11"').alias("x")])
_q("objlen", "CAST(4 AS BIGINT) AS x", lambda x: [o.obj_len(x).alias("x")])
_q("objkeys", "['id', 'big'] AS x", lambda x: [o.obj_keys(x, "$.meta").alias("x")])
_q("debug", f"strlen({doc()}) AS x", lambda x: [o.memory(x).alias("x")])
_q("resp", "'[\"[\",\"' || p_brand || '\",\"' || p_type || '\"]' AS x", lambda x: [o.resp(x, "$.tags").alias("x")])
