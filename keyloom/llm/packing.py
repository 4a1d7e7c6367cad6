"""Best-fit packing of token sequences by minimum bin slack.

Every document becomes its ids and one end id; longer ones are cut into full pieces, the
first of which is the shorter one. Bins depend on the lengths alone, and there are no more
of these than a sequence has tokens, so the plan is made from the histogram of lengths:
each step fixes the longest length that is left, a bitset subset-sum over what is available
finds the fullest combination that fits beside it, and that combination is taken as
often as the counts allow, which is what the search would return again and again. Bins are
thus described by a few thousand patterns however many there are.

Pieces then find their place by arithmetic: a piece's rank among those of its length says
which pattern, bin and place it gets. Ranks are counted in hashed groups of about
``GROUP_ROWS`` pieces of one length, so that a length which a third of all pieces share is
spread and a rare one has a single group.

Nulls and empty texts are documents of the end id alone. Repeated rows are packed as often
as they occur, and spread by the order in which they were written. Ids may be of any type,
null and shared ones included. An empty table gives no rows. Other columns of ``pack``'s
table are carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, scratch, table

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Pieces for each group in which ranks are counted, about.
GROUP_ROWS = 1_000

_PIECES = T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full ones, after a first that may be shorter."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def pieces(df: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``df`` without its text, one row for each piece: piece, start, length, ids_crc32."""
    end = END_ID.to_bytes(4, "little")

    @F.pandas_udf(_PIECES)
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from .byte_bpe import byte_bpe

        encode = byte_bpe(tokenizer).ids
        for texts in parts:
            out = []
            for t in texts:
                ids = (encode(t) if t else b"") + end
                start, rows = 0, []
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    rows.append((k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                    start += n
                out.append(rows)
            yield pd.Series(out)

    (made,) = fresh(df, "made")
    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    return df.select(*kept, F.explode(cut(F.col(text))).alias(made)).select(*kept, f"{made}.*")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of available lengths that fills ``capacity`` best and holds the
    longest of them; among equals, the one that uses long pieces first."""
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    longest = lengths[0]
    room, chosen = capacity - longest, {longest: 1}
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    full = 1 << room
    for n in lengths:
        left = min(counts[n] - (n == longest), room // n)
        take = 1
        while left > 0:  # counts split in powers of two
            k = min(take, left)
            steps.append((n, k, reach))
            reach |= reach << n * k & mask
            left, take = left - k, take * 2
            if reach & full:
                break
        if reach & full:
            break
    at = reach.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            chosen[n] = chosen.get(n, 0) + k
            at -= n * k
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) until every length is used up."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        pattern = fullest(left, capacity)
        times = min(left[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((pattern, times))
    return out


def places(made: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first bin, how many in a bin, offset)."""
    used: dict[int, int] = {}
    rows, first_bin = [], 0
    for pattern, times in made:
        offset = 0
        for n, k in sorted(pattern.items(), reverse=True):
            rank = used.get(n, 0)
            rows.append((n, rank, rank + k * times, first_bin, k, offset))
            used[n], offset = rank + k * times, offset + n * k
        first_bin += times
    return rows


def pack(cut: DataFrame, by: list[str], capacity: int = CAPACITY, keep: list[DataFrame] | None = None) -> DataFrame:
    """``cut`` (with a long column ``length`` from 1 to ``capacity``) with sequence_id and
    offset. ``by``: the columns that order equal lengths. The table that the result reads is
    put into ``keep``."""
    spark = cut.sparkSession
    row, salt, rank, at, groups, spots, spot, sequence, offset = fresh(cut, "row", "salt", "rank", "at", "groups", "spots", "spot", "sequence_id", "offset")
    in_order = [F.col(f"`{c}`") for c in cut.columns]
    cut = materialize(cut.withColumn(row, F.shiftright(F.monotonically_increasing_id(), 10)), "pieces")
    if keep is not None:
        keep.append(cut)
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    by_length: dict[int, list[tuple]] = {}
    for n, *rest in places(plan(counts, capacity)):
        by_length.setdefault(n, []).append(tuple(rest))
    # One row for each length, so the table is bounded by the capacity.
    kind = f"length long, {groups} long, {spots} array<struct<lo:long,hi:long,bin:long,k:long,offset:long>>"
    plans = F.broadcast(spark.createDataFrame([(n, counts[n] // GROUP_ROWS + 1, s) for n, s in sorted(by_length.items())], kind))
    spread = cut.join(plans.select("length", groups), "length").withColumn(salt, F.pmod(F.xxhash64(*by, row), F.col(groups))).drop(groups)
    ranked = spread.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy(*by)).cast("long") - 1)
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy("length", salt).count()
    bases = sizes.select("length", salt, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(at))
    ranked = ranked.join(bases, ["length", salt]).withColumn(rank, F.col(rank) + F.col(at))
    placed = ranked.join(plans.select("length", spots), "length").withColumn(spot, F.element_at(F.filter(spots, lambda s: (s.lo <= F.col(rank)) & (F.col(rank) < s.hi)), 1))
    step, k = F.col(rank) - F.col(f"{spot}.lo"), F.col(f"{spot}.k")
    nth = step % k
    return placed.select(
        *in_order,
        (F.col(f"{spot}.bin") + ((step - nth) / k).cast("long")).alias(sequence),
        (F.col(f"{spot}.offset") + nth * F.col("length")).alias(offset),
    )


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    body = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    with scratch(docs.sparkSession) as keep:
        made = pack(pieces(body, tokenizer, capacity=capacity), ["doc_id", "piece", "start", "ids_crc32"], capacity, keep)
    return made.withColumnRenamed("doc_id", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, a row for each piece."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
