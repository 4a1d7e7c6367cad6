"""Vector sets: relation ``vectors(key, element, vec, attrs)``, exact search.

A search takes a block of queries to every row: each batch of rows keeps its best few for
each query, so what is shuffled is bounded by queries and batches, not by pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..relations import firsts


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(vec: Column) -> Column:
    n = norm(vec)
    return F.when(n > 0, F.transform(vec, lambda x: x / n)).otherwise(F.transform(vec, lambda x: x.cast("double")))


def rounded(x: Column, digits: int) -> Column:
    """``x`` rounded half away from zero; what becomes zero keeps its sign, as in C."""
    near = F.round(x, digits)
    return F.when(near == 0, x * 0.0).otherwise(near)


def project(vec: Column, matrix: list[list[float]]) -> Column:
    """Rows of ``matrix`` are input dimensions."""
    columns = F.array(*(F.array(*map(F.lit, c)) for c in zip(*matrix)))
    return F.transform(columns, lambda c: F.aggregate(F.zip_with(vec, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def quantized(vec: Column) -> Column:
    """Bytes 0 to 127 between the least and the greatest component."""
    lo, span = F.array_min(vec), F.greatest(F.array_max(vec) - F.array_min(vec), F.lit(1.1920929e-07))
    return F.transform(vec, lambda x: F.round((x - lo) / span * 127).cast("int"))


def signs(vec: Column) -> Column:
    return F.transform(vec, lambda x: (x >= 0).cast("int"))


def restored(q: Column, vec: Column) -> Column:
    """The vector that quantized bytes stand for."""
    lo, span = F.array_min(vec), F.greatest(F.array_max(vec) - F.array_min(vec), F.lit(1.1920929e-07))
    return F.transform(q, lambda x: x / 127.0 * span + lo)


def _prepare(x: np.ndarray, quant: str) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, n, out=x.copy(), where=n > 0)
    if quant == "q8":
        lo, hi = x.min(1, keepdims=True), x.max(1, keepdims=True)
        return np.floor((x - lo) / np.maximum(hi - lo, 1.1920929e-07) * 127 + 0.5)
    return np.where(x >= 0, 1.0, -1.0) if quant == "bin" else x


def _similarity(x: np.ndarray, q: np.ndarray, quant: str) -> np.ndarray:
    dot, dim = x @ q.T, max(x.shape[1], 1)
    if quant == "q8":
        return dot / max(127.0 * 127.0 * dim, 1.0)
    return (dot / dim + 1) / 2 if quant == "bin" else dot  # bin: 1 - hamming / dim


#: Queries and rows that are compared at once.
QUERY_BLOCK, ROW_BLOCK = 256, 4096

_SCORED = "query string, element string, score double"


def _best(names, given: np.ndarray, elements: np.ndarray, rows: np.ndarray, count: int, quant: str, epsilon: float | None, other: bool) -> Iterator[pd.DataFrame]:
    """The ``count`` best of a batch of rows for each query; ``given`` is prepared."""
    score = _similarity(_prepare(rows, quant), given, quant)
    by_name = np.argsort(elements, kind="stable")
    e = elements[by_name]
    for j, name in enumerate(names):
        s = score[by_name, j]
        keep = np.ones(len(e), bool)
        if other:
            keep &= e != name
        if epsilon is not None and quant != "bin":
            keep &= s >= epsilon
        at = np.flatnonzero(keep)
        at = at[np.argsort(-s[at], kind="stable")[:count]]
        yield pd.DataFrame({"query": name, "element": e[at], "score": s[at]})


def _blocks(df: DataFrame, size: int, prefix: str) -> DataFrame:
    """Rows of at most ``size`` elements and their vectors as bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), size):
                part = batch.iloc[i : i + size]
                yield pd.DataFrame({"e": [part["element"].tolist()], "m": [np.stack(part["vec"].to_list()).astype(np.float64).tobytes()]})

    return df.select("element", "vec").mapInPandas(pack, "e array<string>, m binary").toDF(f"{prefix}e", f"{prefix}m")


def nearest_to_all(vectors: DataFrame, queries: DataFrame, count: int = 10, quant: str = "none", epsilon: float | None = None, where: Column | None = None, other: bool = False) -> DataFrame:
    """(query, element, score, n): the ``count`` best rows for each of any number of
    ``queries(element, vec)``; ties go by element. ``epsilon``: the least score (not for
    bin). ``other``: an element is no neighbour of itself. Blocks of queries meet blocks of
    rows on the executors, and none passes through the driver."""
    if where is not None:
        vectors = vectors.where(where)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qe, qm, e, m in zip(batch["qe"], batch["qm"], batch["e"], batch["m"]):
                given, rows = (np.frombuffer(x, np.float64).reshape(len(n), -1) for n, x in ((qe, qm), (e, m)))
                yield from _best(qe, _prepare(given, quant), np.array(e, object), rows, count, quant, epsilon, other)

    both = _blocks(queries, QUERY_BLOCK, "q").crossJoin(_blocks(vectors, ROW_BLOCK, ""))
    got = both.mapInPandas(best, _SCORED)
    return firsts(got, [F.desc("score"), F.col("element")], count, "query")


def links(vectors: DataFrame, elements: DataFrame, count: int) -> DataFrame:
    """The neighbours of ``elements(element)``, without themselves."""
    return nearest_to_all(vectors, vectors.join(elements, "element", "left_semi"), count, other=True)


def sample(vectors: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """``count`` distinct elements of each key, by a seeded hash."""
    return firsts(vectors.select("key", "element"), [F.xxhash64("element", F.lit(seed)), F.col("element")], count).drop("n")


_TERM = re.compile(r"^(.*?)(==|!=|<=|>=|<|>)(.*)$")


def attribute_filter(text: str, attrs: str = "attrs") -> Column:
    """``.path == "x"``, ``!= < <= > >=``, ``!``, ``&&`` and ``||``, split at the first ``||``,
    then the first ``&&``. Rows without attributes match nothing; ``!=`` holds where the
    path is missing."""
    return F.col(attrs).isNotNull() & F.coalesce(_term(text.strip(), F.col(attrs)), F.lit(False))


def _term(text: str, attrs: Column) -> Column:
    for sign in ("||", "&&"):
        if sign in text:
            a, b = (_term(x.strip(), attrs) for x in text.split(sign, 1))
            return (a | b) if sign == "||" else (a & b)
    if text.startswith("!"):
        return ~_term(text[1:].strip(), attrs)
    path, sign, value = (x.strip() for x in _TERM.match(text).groups())
    found = F.try_variant_get(F.try_parse_json(attrs), "$" + path, "variant")
    kind = F.schema_of_variant(found)
    number = F.when(kind != "STRING", F.try_variant_get(F.try_parse_json(attrs), "$" + path, "double"))
    if sign in ("==", "!="):
        if value == "null":
            same = kind == "VOID"
        elif value[0] == '"':
            same = (kind == "STRING") & (F.try_variant_get(F.try_parse_json(attrs), "$" + path, "string") == value[1:-1])
        else:
            same = number == float(value)
        same = F.coalesce(same, F.lit(False))
        return same if sign == "==" else ~same
    x = float(value)
    return F.coalesce({"<": number < x, ">": number > x, "<=": number <= x, ">=": number >= x}[sign], F.lit(False))


def between(vectors: DataFrame, low: str, high: str, count: int | None = None) -> DataFrame:
    got = vectors.where(F.col("element").between(low, high))
    return got if count is None else firsts(got, [F.col("element")], count).drop("n")


def put(vectors: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert normalized vectors; attributes stay unless new ones come."""
    new = incoming.select("key", "element", F.struct(unit(F.col("vec")).cast("array<float>").alias("v"), F.col("attrs").alias("a")).alias("new"))
    both = vectors.join(new, ["key", "element"], "full")
    return both.select("key", "element", F.coalesce("new.v", "vec").alias("vec"), F.coalesce("new.a", "attrs").alias("attrs"))


def set_attrs(vectors: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming(key, element, attrs)``; empty ones are removed."""
    both = vectors.join(incoming.withColumnRenamed("attrs", "new"), ["key", "element"], "left")
    return both.withColumn("attrs", F.when(F.col("new") == "", None).otherwise(F.coalesce("new", "attrs"))).drop("new")


def info(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("key").agg(F.count(F.lit(1)).alias("card"), F.max(F.size("vec")).alias("dim"), F.count("attrs").alias("with_attrs"))
