"""Connected components: forests of parts of the links, then joins and aggregations over
what the parts leave (alternating large and small stars)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, scratch

#: Links that one task turns into a forest; more of them are several parts.
PART_LINKS = 1 << 19


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that is not the least of its component; the root is."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links that connect what those of the partition do, at most one for each node of about
    ``PART_LINKS`` of them."""
    held: list[pd.DataFrame] = []

    def reduced() -> list[pd.DataFrame]:
        both = pd.concat(held)
        return [pd.DataFrame(dict(zip("uv", forest(both["u"].to_numpy(), both["v"].to_numpy()))))]

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= PART_LINKS:
            held = reduced()
            if len(held[0]) > PART_LINKS // 2:
                yield held.pop()
    if held:
        yield reduced()[0]


def _large(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = e.select("u", "v").union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link, and that to a node without any."""
    n, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    return n == nodes and not edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").take(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that is not the least of its
    component; the root is the least. Up to ``PART_LINKS`` links are one task's work. Beyond,
    each part becomes a forest first, and passes over these follow: each is written to the
    shared folder, and their number grows with the logarithm of the nodes. A node with very
    many links is a skewed key of two longs a row, which adaptive execution splits."""
    kind = ", ".join(f"{c} {t}" for c, t in edges.select("u", "v").dtypes)
    with scratch(edges.sparkSession) as keep:
        now = materialize(edges.where(F.col("u") != F.col("v")).select("u", "v"), "links")
        parts = max(1, -(-now.count() // PART_LINKS))
        now = materialize(now.coalesce(parts).mapInPandas(_forests, kind), "stars")
        while parts > 1 and not _stars(now):
            then = materialize(_small(_large(now)).distinct(), "stars")
            release(edges.sparkSession, [now.__dict__["scratch_path"]])
            now = then
        keep.append(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
