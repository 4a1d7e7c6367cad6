"""Vector sets: the embeddings."""

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import vectors as o
from .bindings import VECTORS, vectors

W = f"WITH {VECTORS} "


def asked(s, d):
    """The queries of a search: every element whose id is divisible by 100."""
    return vectors(s, d).where(F.col("element").cast("long") % 100 == 0)


def _nearest(name, rows, count, **kind):
    sql = f"WITH {VECTORS}, q AS (SELECT element, embedding FROM v WHERE id % 100 = 0), c AS (SELECT q.element AS query, v.element, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM v, q WHERE {rows}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, element) - 1 AS n FROM c) SELECT query, element, round(score, 4) AS score, n FROM r WHERE n < {count}"

    @query(sql, name=name)
    def run(s, d):
        got = o.nearest_to_all(vectors(s, d), asked(s, d), count, **{k: v() if callable(v) else v for k, v in kind.items()})
        return got.select("query", "element", F.round("score", 4).alias("score"), "n")


_nearest("vsim", "true", 10)
_nearest("vsim_filter", "v.label = 3", 5, where=lambda: o.attribute_filter(".label == 3"))
_nearest("vsim_filter_or", "(v.label < 2 OR (v.label >= 8 AND v.id > 100))", 5, where=lambda: o.attribute_filter(".label < 2 || .label >= 8 && .id > 100"))
_nearest("vsim_epsilon", "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.4", 50, epsilon=0.4)


@query(f"WITH {VECTORS}, q AS (SELECT element, embedding FROM v WHERE id % 100 = 0), c AS (SELECT q.element AS query, v.element, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM v, q WHERE v.element <> q.element), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, element) - 1 AS n FROM c) SELECT query, element, round(score, 4) AS score, n FROM r WHERE n < 6")
def vlinks(s, d):
    return o.links(vectors(s, d), asked(s, d).select("element"), 6).select("query", "element", F.round("score", 4).alias("score"), "n")


BIN = "(SELECT count(*) FROM (SELECT unnest(v.embedding) AS a, unnest(q.embedding) AS b) WHERE (a >= 0) = (b >= 0)) / 64.0"


@query(f"WITH {VECTORS}, q AS (SELECT element, embedding FROM v WHERE id % 100 = 0), c AS (SELECT q.element AS query, v.element, {BIN} AS score FROM v, q), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, element) - 1 AS n FROM c) SELECT query, element, CAST(round(score, 4) AS DOUBLE) AS score, n FROM r WHERE n < 8")
def vsim_bin(s, d):
    return o.nearest_to_all(vectors(s, d), asked(s, d), 8, quant="bin").select("query", "element", F.round("score", 4).alias("score"), "n")


@query(None)
def vsim_q8(s, d):
    return o.nearest_to_all(vectors(s, d), asked(s, d), 8, quant="q8")


@query(W + "SELECT 'all' AS key, count(*) AS card, CAST(max(len(embedding)) AS INT) AS dim, count(*) AS with_attrs FROM v")
def vinfo(s, d):
    return o.info(vectors(s, d))


@query(W + "SELECT 'all' AS key, count(*) AS card FROM v")
def vcard(s, d):
    return o.info(vectors(s, d)).select("key", "card")


@query(W + "SELECT 'all' AS key, CAST(max(len(embedding)) AS INT) AS dim FROM v")
def vdim(s, d):
    return o.info(vectors(s, d)).select("key", "dim")


@query(W + "SELECT element, list_transform(embedding::DOUBLE[], lambda x: round(x, 4)) AS vec FROM v")
def vemb(s, d):
    return vectors(s, d).select("element", F.transform("vec", lambda x: o.rounded(x.cast("double"), 4)).alias("vec"))


@query(W + "SELECT element, true AS found FROM v UNION ALL SELECT 'none' || element, false FROM v")
def vismember(s, d):
    all_ = vectors(s, d).select("element", F.lit(True).alias("hit"))
    return vectors(s, d).select(F.explode(F.array("element", F.concat(F.lit("none"), "element"))).alias("element")).join(all_, "element", "left").select("element", F.coalesce("hit", F.lit(False)).alias("found"))


@query(W + "SELECT element, '{\"label\":' || label || ',\"id\":' || id || '}' AS attrs FROM v")
def vgetattr(s, d):
    return vectors(s, d).select("element", "attrs")


@query(W + "SELECT element, CASE WHEN id % 2 = 0 THEN '{\"x\":1}' END AS attrs FROM v")
def vsetattr(s, d):
    some = vectors(s, d)
    new = some.select("key", "element", F.when(F.col("element").cast("long") % 2 == 0, '{"x":1}').otherwise("").alias("attrs"))
    return o.set_attrs(some, new).select("element", "attrs")


@query(W + "SELECT element FROM v WHERE element BETWEEN '12' AND '3' ORDER BY element LIMIT 15")
def vrange(s, d):
    return o.between(vectors(s, d), "12", "3", 15).select("element")


@query(W + "SELECT count(*) AS card FROM v WHERE id % 3 <> 0")
def vrem(s, d):
    gone = vectors(s, d).where(F.col("element").cast("long") % 3 == 0).select("key", "element")
    return vectors(s, d).join(gone, ["key", "element"], "left_anti").agg(F.count(F.lit(1)).alias("card"))


@query(W + "SELECT 12 AS n, 12 AS members FROM v LIMIT 1")
def vrandmember(s, d):
    got = o.sample(vectors(s, d), 12, 1).join(vectors(s, d).select("key", "element"), ["key", "element"], "left_semi")
    return got.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("element").cast("int").alias("members"))


@query(W + "SELECT element, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 3) AS norm, 1.0 AS stored FROM v")
def vadd(s, d):
    some = vectors(s, d)
    got = o.put(some, some.withColumn("vec", F.transform("vec", lambda x: x * 3)))
    return got.join(some.select("element", F.col("vec").alias("was")), "element").select("element", F.round(o.norm(F.col("was")), 3).alias("norm"), F.round(o.norm(F.col("vec")), 3).alias("stored"))


@query(W + "SELECT element, 2 AS dim FROM v")
def vadd_reduce(s, d):
    matrix = [[(i % 5) / 5, (i % 3) / 3] for i in range(64)]
    return vectors(s, d).select("element", F.size(o.project(F.col("vec"), matrix)).alias("dim"))
