"""Consistent-hash ring with virtual nodes and bounded loads.

A key's hash says on which of ``CELLS`` equal cells of the ring it lies; each shard stands
at ``VIRTUAL_NODES`` of their borders and owns the cells before these. No shard takes more
rows than its bound: all bounds add up to the rows there are and differ by one at most, so
the counts do too (law ``rows``). Rows that a full shard cannot take go on clockwise to the
next shards that can; all others stay with the owner of their cell, so that a changed number
of shards or rows moves few of them (from 16 to 17 shards about a tenth, where 1/17 is the
least; one row in a hundred more moves about one in a hundred).

The bounds act on counts of cells alone: one row for each cell reaches the driver, never a
row of the table. A row then finds shard and slot from its rank within its cell, where rows
are ordered by a hash of all that is known of them. Ranks are counted in ranges of that hash
that hold about ``PART_ROWS`` different rows, so neither a large table nor a key that a third
of all rows share puts a cell into one task. Equal rows are counted before they are ranked;
if one occurs more than ``REPEAT_ROWS`` times, its copies are written out in blocks that are
dealt to all tasks.

Null texts have no bytes and the crc of the empty text; null keys hash like any other key.
Keys may be of any type that can be hashed. Repeated rows each take a slot. An empty table
gives no rows. Other columns are not carried; if the key's name is one of the result's, the
latter gets an underscore.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, scratch, table

SHARDS, VIRTUAL_NODES, CELLS = 16, 64, 4096
#: Different rows whose ranks one task counts, about; copies of a row written out at once.
PART_ROWS, REPEAT_ROWS = 20_000, 10_000
_NODE_STEP = 0x9E3779B97F4A7C15  # the golden ratio in 64 bits (fixed value)


def owners(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[int]:
    """The shard that owns each cell: that of the first virtual node clockwise."""
    nodes: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual_nodes):
            x = ((shard * virtual_nodes + v + 1) * _NODE_STEP) % (1 << 64)
            x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) % (1 << 64)  # splitmix64's mixer (fixed values)
            x = ((x ^ x >> 27) * 0x94D049BB133111EB) % (1 << 64)
            cell = (x ^ x >> 31) % cells
            while cell in nodes and len(nodes) < cells:
                cell = (cell + 1) % cells
            nodes.setdefault(cell, shard)
    at = sorted(nodes)
    return [nodes[at[bisect_left(at, c) % len(at)]] for c in range(cells)]


def bounded(counts: list[int], owner: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, rank after the last, shard, first slot): how the rows of each
    cell are dealt when no shard may take more than its bound."""
    total, n = sum(counts), len(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, out, over = [0] * shards, [], []

    def give(cell: int, lo: int, hi: int, shard: int) -> int:
        k = min(hi - lo, room[shard])
        if k:
            out.append((cell, lo, lo + k, shard, used[shard]))
            used[shard], room[shard] = used[shard] + k, room[shard] - k
        return lo + k

    for cell, count in enumerate(counts):
        lo = give(cell, 0, count, owner[cell])
        if lo < count:
            over.append((cell, lo, count))
    for cell, lo, count in over:
        at = cell
        while lo < count:
            at = (at + 1) % n
            if room[owner[at]]:
                lo = give(cell, lo, count, owner[at])
    return out


def inline_table(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    """A small table from literals, without any RDD."""
    names = spark.range(0).select(F.from_json(F.lit(""), f"struct<{kind}>").alias("x")).schema["x"].dataType.names
    said = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(said), f"array<struct<{kind}>>")))


def ring_cell(key: Column, cells: int = CELLS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(cells)).cast("int")


def _written_out(ranked: DataFrame, most: int) -> DataFrame:
    """A row for each of ``times`` copies, at most ``most``, with its ``nth`` from 0 on."""
    if most <= REPEAT_ROWS:
        return ranked.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    blocks = ranked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {REPEAT_ROWS}"))))
    begin = F.col("block") * REPEAT_ROWS
    return blocks.repartition("cell", "part", "before", "block").withColumn("nth", F.explode(F.sequence(begin, F.least(begin + REPEAT_ROWS, F.col("times")) - 1))).drop("block")


def shard(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, size, text_crc32, law, shard, slot, grown_shard (null)."""
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("k"), ring_cell(F.col(key)).alias("cell"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"))
    with scratch(spark) as keep:
        same = materialize(rows.groupBy("cell", "k", "size", "crc").agg(F.count(F.lit(1)).alias("times")), "rows")
        keep.append(same)
    counts, parts, most = [0] * CELLS, [1] * CELLS, 0
    for cell, n, different, times in same.groupBy("cell").agg(F.sum("times"), F.count(F.lit(1)), F.max("times")).collect():  # at most CELLS rows
        counts[cell], parts[cell], most = n, different // PART_ROWS + 1, max(most, times)
    spans: dict[int, list[dict]] = {}
    for cell, lo, hi, to, base in bounded(counts, owners(shards), shards):
        spans.setdefault(cell, []).append({"lo": lo, "hi": hi, "to": to, "base": base})
    kind = "cell:int,parts:bigint,spans:array<struct<lo:bigint,hi:bigint,to:int,base:bigint>>"
    at = F.broadcast(inline_table(spark, [(c, parts[c], s) for c, s in sorted(spans.items())], kind))  # at most CELLS rows
    same = same.join(at.select("cell", "parts"), "cell").withColumn("order", F.xxhash64("k", "size", "crc", F.lit(1)))
    same = same.withColumn("part", F.floor((F.col("order") / 2.0**64 + 0.5) * F.col("parts")))
    inside = Window.partitionBy("cell", "part").orderBy("order", "k", "size", "crc")
    ranked = same.withColumn("before", F.sum("times").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("times"))
    if max(parts) > 1:
        ahead = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        bases = same.groupBy("cell", "part").agg(F.sum("times").alias("n")).select("cell", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
        ranked = ranked.join(bases, ["cell", "part"]).withColumn("before", F.col("base") + F.col("before"))
    each = _written_out(ranked, most).withColumn("rank", F.col("before") + F.col("nth"))
    each = each.join(at.select("cell", "spans"), "cell").withColumn("span", F.element_at(F.filter("spans", lambda s: (s.lo <= F.col("rank")) & (F.col("rank") < s.hi)), 1))
    size, crc, law, to, slot, grown = fresh(df.select(key), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    return each.select(
        F.col("k").alias(key),
        F.col("size").alias(size),
        F.col("crc").alias(crc),
        F.lit("rows").alias(law),
        F.col("span.to").alias(to),
        (F.col("span.base") + F.col("rank") - F.col("span.lo")).alias(slot),
        F.lit(None).cast("int").alias(grown),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 16 shards whose counts differ by one at most."""
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
