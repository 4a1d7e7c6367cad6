"""Removal of byte strings that occur more than once, by hash-compared suffix sorting.

Every ``LENGTH``-byte string (a window) that starts anywhere else too is removed. Windows
are first cut down to those that can be repeated: each has an anchor that depends on its
bytes alone (see ``anchors``), so only runs of windows whose anchor occurs twice go on.
Runs of the same bytes, known by a 128-bit cryptographic digest of all of them, repeat each
of their windows. What is left are the runs at the edges of repeated passages. One of each
kind is taken with its bytes; the suffixes that start at its windows are sorted, by groups
of the same anchor at the same distance and without those that no other run goes on like
(by hashes of the bytes on either side of the anchor), in a merge sort that compares two suffixes by
binary search for their common extension on polynomial prefix hashes. Neighbours with a
common extension of a window's length are compared byte by byte before they count as equal.

Counts are aggregated before they are shuffled, joins on anchors are split where they are
skewed, and an anchor with more than ``GROUP_RUNS`` different runs is sorted in salted parts.
Windows of different parts meet by a 64-bit hash and then by their bytes, so the
verification is the same at every size. No step needs a group in one task.

A text is known by two 64-bit hashes, never by its doc_id, which may be null, shared or of
any type: rows that repeat a text, also under one doc_id, are different documents, so all
their windows are repeated. Null texts are empty. Texts shorter than a window stay whole. An
empty table gives no rows. Columns other than key and text are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import GRAM, Runs, between, blocks, prefix_sums
from .common import identity, materialize, scratch, table
from .hashing import mix

LENGTH = 200
GROUP_RUNS = 2048
#: Lengths at which the bytes around anchors are compared before windows are sorted.
LEVELS = 4
#: Windows that are sorted at once.
SORT_WINDOWS = 400_000

#: Windows of edges for each task of the sort, and the most tasks.
TASK_WINDOWS, MOST_TASKS = 1_500_000, 50_000


def _raw(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def _runs(texts: DataFrame, length: int, whole: bool) -> DataFrame:
    """(gram) of every run of (a, b, t) or, with ``whole``, (a, b, gram, d, e, place): the
    text's identity, the anchor, the digest, and first window, windows - 1 and left in one long."""
    kind = ("a", "b", "gram", "d", "e", "place") if whole else ("gram",)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, held in blocks(_raw(batch.column(2))):
                r = Runs(held, length)
                columns = [pa.array(r.gram.view(np.int64))]
                if whole:
                    row, digest = pa.array(r.text + begin), r.digests()
                    place = r.lo << 16 | (r.hi - r.lo) << 8 | r.left
                    columns = [batch.column(0).take(row), batch.column(1).take(row), *columns, pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, names=list(kind))

    return texts.select("a", "b", "t").mapInArrow(find, T.StructType([T.StructField(c, T.LongType()) for c in kind]))


# ---- the suffix sort


class Suffixes:
    """Strings that start at ``start`` in ``data``, compared over ``length`` bytes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: int):
        self.data, self.start, self.length = data, start, length
        self.sums = prefix_sums(data)

    def at(self, chosen: np.ndarray) -> Suffixes:
        """The suffixes of those numbers."""
        some = copy(self)
        some.start = self.start[chosen]
        return some

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes ``a`` and ``b``, at most ``length``."""
        x, y = self.start[a], self.start[b]
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        same = between(self.sums, x, x + hi) == between(self.sums, y, y + hi)
        lo[same] = self.length
        todo = np.flatnonzero(~same)
        x, y, low, high = x[todo], y[todo], lo[todo], hi[todo] - 1
        while len(low) and (low < high).any():
            mid = (low + high + 1) >> 1
            equal = between(self.sums, x, x + mid) == between(self.sums, y, y + mid)
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        lo[todo] = low
        return lo

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        n = self.common(a, b)
        end = n >= self.length
        at = np.minimum(n, self.length - 1)
        smaller = self.data[self.start[a] + at] < self.data[self.start[b] + at]
        return np.where(end, or_equal, smaller)

    def merge_sort(self, group: np.ndarray) -> np.ndarray:
        """The order of suffixes by group (ascending numbers), then content."""
        order = np.argsort(group, kind="stable")
        size = np.bincount(group)
        first = np.concatenate(([0], np.cumsum(size)))
        width = 1
        while width < (size.max() if len(size) else 0):
            g = group[order]
            active = np.flatnonzero(size[g] > width)
            own, base, top = active - first[g[active]], first[g[active]], size[g[active]]
            run = own // width
            other = np.where(run % 2 == 0, run + 1, run - 1) * width  # the run that it is merged with
            begin, stop = np.minimum(other, top), np.minimum(other + width, top)
            lo, hi = begin.copy(), stop.copy()
            left = run % 2 == 0
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                them, us = order[base[open_] + mid], order[active[open_]]
                before = np.where(left[open_], self.less(them, us, False), self.less(them, us, True))
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            start = np.where(left, own - own % width, begin)
            within = own % width
            merged = order.copy()
            merged[base + start + within + (lo - begin)] = order[active]
            order, width = merged, width * 2
        return order

    def equal_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), bool)
        reach = np.arange(self.length)
        for i in range(0, len(a), 4096):
            x, y = self.start[a[i : i + 4096]], self.start[b[i : i + 4096]]
            out[i : i + 4096] = (self.data[x[:, None] + reach] == self.data[y[:, None] + reach]).all(1)
        return out


def repeated_windows(contexts: list[bytes], gram: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Suffixes]:
    """(context, window in it, whether another context has an equal one at the same
    distance from the same anchor, whether it is the first of its kind) for each window,
    and the suffixes."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    windows = sizes - length + 1
    of = np.repeat(np.arange(len(contexts)), windows)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    suffixes = Suffixes(np.frombuffer(b"".join(contexts), np.uint8), begin[of] + nth, length)
    _, g = np.unique(gram, return_inverse=True)
    kept = np.flatnonzero(_extended(suffixes.sums, begin[:-1], sizes, g, left, of, left[of] - nth, length))
    some = suffixes.at(kept)
    _, group = np.unique(g[of[kept]] * 1024 + (left[of[kept]] - nth[kept] + 256), return_inverse=True)
    order = some.merge_sort(group)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(group[a] == group[b])
    near = near[some.common(a[near], b[near]) >= length]
    near = near[some.equal_bytes(a[near], b[near])]
    hit = np.zeros(len(of), bool)
    hit[kept[a[near]]] = hit[kept[b[near]]] = True
    first = np.ones(len(of), bool)
    first[kept[b[near]]] = False
    return of, nth, hit, first, suffixes


def _extended(sums: np.ndarray, begin: np.ndarray, sizes: np.ndarray, g: np.ndarray, left: np.ndarray, of: np.ndarray, ahead: np.ndarray, length: int) -> np.ndarray:
    """Whether each window (of a context ``of``, ``ahead`` bytes before its anchor) may have
    an equal one: some other context of its anchor goes on alike for a number of bytes, of
    ``LEVELS``, on either side that the window covers. What does not is in no equal pair."""
    around = length - GRAM
    levels = np.unique([around * k // LEVELS for k in range(1, LEVELS + 1)])
    levels = levels[levels > 0]
    anchor = begin + left
    may = np.ones(len(of), bool)
    for before in (True, False):
        room = left if before else sizes - left - GRAM
        alike = np.ones((len(levels) + 1, len(begin)), bool)
        for k, n in enumerate(levels.tolist(), 1):
            has = np.flatnonzero(room >= n)
            lo = anchor[has] - n if before else anchor[has] + GRAM
            side = mix(between(sums, lo, lo + n) ^ mix(g[has].astype(np.uint64)))
            _, kind, count = np.unique(side, return_inverse=True, return_counts=True)
            alike[k] = False
            alike[k, has] = count[kind] > 1
        may &= alike[np.searchsorted(levels, ahead if before else around - ahead, "right"), of]
    return may


_MARKS = "gram long, d long, e long, lo int, hi int, h long, w binary"


def _sorted(length: int):
    """Batches sorted by (gram, salt) to marks: ranges of repeated windows and, for salted
    groups, the hash and bytes of one window of each kind in the part."""

    def marks(rows: pd.DataFrame) -> pd.DataFrame:
        part = rows.gram.to_numpy() ^ mix(rows.salt.to_numpy().astype(np.uint64) + np.uint64(1)).view(np.int64)
        of, nth, hit, first, suffixes = repeated_windows(rows.bytes.tolist(), part, rows.left.to_numpy().astype(np.int64), length)
        gram, d, e, hot = (rows[c].to_numpy() for c in ("gram", "d", "e", "hot"))
        edge = np.diff(hit.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        switch = np.flatnonzero(of[1:] != of[:-1]) + 1 if len(of) else np.empty(0, int)
        start = np.union1d(np.flatnonzero(edge == 1), switch[hit[switch]])
        stop = np.union1d(np.flatnonzero(edge == -1) - 1, switch[hit[switch - 1]] - 1)
        out = pd.DataFrame({"gram": gram[of[start]], "d": d[of[start]], "e": e[of[start]], "lo": nth[start], "hi": nth[stop], "h": None, "w": None})
        each = np.flatnonzero(hot[of] & first)  # one of each kind of window
        x = suffixes.start[each]
        h = mix(between(suffixes.sums, x, x + length)).view(np.int64)
        raw = suffixes.data.tobytes() if len(each) else b""
        windows = [raw[i : i + length] for i in x.tolist()]
        met = pd.DataFrame({"gram": gram[of[each]], "d": d[of[each]], "e": e[of[each]], "lo": nth[each], "hi": nth[each], "h": h, "w": windows})
        return pd.concat([out.astype({"h": object}), met.astype({"h": object})], ignore_index=True).astype({"h": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, windows = [], 0
        for batch in batches:
            held.append(batch)
            windows += int(batch.windows.sum())
            if windows >= SORT_WINDOWS:
                rows = pd.concat(held, ignore_index=True)
                last = (rows.gram == rows.gram.iloc[-1]) & (rows.salt == rows.salt.iloc[-1])  # may go on
                held = [rows[last]]
                windows = int(held[0].windows.sum())
                if not last.all():
                    yield from cut(rows[~last].reset_index(drop=True))
        if held and sum(map(len, held)):
            yield from cut(pd.concat(held, ignore_index=True))

    def cut(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole groups, about SORT_WINDOWS windows at a time."""
        total = rows.windows.cumsum().to_numpy() // SORT_WINDOWS
        fresh = np.concatenate(([True], (rows.gram.to_numpy()[1:] != rows.gram.to_numpy()[:-1]) | (rows.salt.to_numpy()[1:] != rows.salt.to_numpy()[:-1])))
        start = np.flatnonzero(fresh)
        piece = np.repeat(total[start], np.diff(np.append(start, len(rows))))
        for _, part in rows.groupby(piece):
            yield marks(part.reset_index(drop=True))

    return run


# ---- the plan


def _lo(place: str) -> Column:
    return F.shiftright(place, 16)


def _more(place: str) -> Column:
    return F.shiftright(place, 8).bitwiseAND(255).cast("int")


def repeated_ranges(texts: DataFrame, length: int = LENGTH, group_runs: int = GROUP_RUNS) -> DataFrame:
    """(a, b, ranges): bytes to remove of each text (a, b, t) that has any, as longs
    ``first << 32 | end``; (a, b) is the identity of the text t."""
    one = ["gram", "d", "e"]
    twice = materialize(_runs(texts, length, False).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("gram"), "grams")
    found = materialize(_runs(texts, length, True).join(twice, "gram"), "runs")
    kinds = materialize(found.groupBy(*one).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("a", "b", "place")).alias("at")), "kinds")
    mixed = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
    salts = F.expr(f"cast(k div {group_runs} as int)")
    edge = kinds.join(mixed, "gram").select(
        F.col("at.a").alias("wa"),
        F.col("at.b").alias("wb"),
        F.struct(
            *one, F.pmod(F.xxhash64("d"), F.greatest(salts + 1, F.lit(1))).cast("int").alias("salt"), (salts > 0).alias("hot"),
            _lo("at.place").alias("lo"), (_more("at.place") + 1).alias("windows"), F.col("at.place").bitwiseAND(255).cast("int").alias("left"),
        ).alias("run"),
    )
    wanted = materialize(edge.groupBy("wa", "wb").agg(F.collect_list("run").alias("runs")), "edges")
    windows = wanted.select(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r.windows))).first()[0] or 0
    body = texts.select("a", "b", F.encode(F.coalesce("t", F.lit("")), "UTF-8").alias("t")).join(wanted, (F.col("a") == F.col("wa")) & (F.col("b") == F.col("wb")))
    cut = body.select("t", F.inline("runs")).select(*one, "salt", "hot", "windows", "left", F.substring("t", F.col("lo") + 1, F.col("windows") + length - 1).alias("bytes"))
    tasks = int(min(max(windows // TASK_WINDOWS + 1, texts.sparkSession.sparkContext.defaultParallelism), MOST_TASKS))
    parts = cut.distinct().repartition(tasks, "gram", "salt").sortWithinPartitions("gram", "salt")  # copies of a text send the same runs
    marks = materialize(parts.mapInPandas(_sorted(length), _MARKS), "marks")
    met = marks.where(F.col("h").isNotNull())
    likely = met.join(met.groupBy("gram", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("gram", "h"), ["gram", "h"])
    equal = likely.groupBy("gram", "w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("gram", "w")
    ranges = marks.where(F.col("h").isNull()).select(*one, "lo", "hi").union(likely.join(equal, ["gram", "w"]).select(*one, "lo", "hi"))
    whole = kinds.where(F.col("n") > 1).select(*one, F.lit(0).alias("lo"), _more("at.place").alias("hi"))
    gone = found.join(whole.union(ranges), one)
    first = _lo("place") + F.col("lo")
    each = gone.select("a", "b", F.shiftleft(first, 32).bitwiseOR(first + F.col("hi") - F.col("lo") + length).alias("r"))
    return each.groupBy("a", "b").agg(F.array_sort(F.collect_set("r")).alias("ranges"))


_KEPT = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


def merged(ranges) -> list[tuple[int, int]]:
    """Disjoint byte ranges from sorted packed ones; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for r in ranges:
        lo, hi = int(r) >> 32, int(r) & 0xFFFFFFFF
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(hi for _, hi in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(lo for lo, _ in spans), len(text)]))


def dedup_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, group_runs: int = GROUP_RUNS, digest: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): ``kept`` are the bytes left of each text
    or, with ``digest``, their sha256 in hex as kept_sha256."""
    a, b = identity(F.col(text))
    docs = df.select(F.col(key).alias("k"), a.alias("a"), b.alias("b"), F.col(text).alias("t"))
    with scratch(df.sparkSession) as keep:
        found = materialize(repeated_ranges(docs, length, group_runs), "ranges")
        keep.append(found)
    found = found.withColumnsRenamed({"a": "fa", "b": "fb"})
    both = docs.join(found, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")), "left")

    @F.pandas_udf(_KEPT)
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ranges in parts:
            rows = []
            for t, r in zip(texts, ranges):
                b = t.encode() if t else b""
                spans = merged(r) if r is not None else []
                left = _cut_out(b, spans)
                rows.append((len(b) - len(left), len(spans), hashlib.sha256(left).hexdigest().encode() if digest else left))
            yield pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])

    out = both.select(F.col("k").alias(key), F.octet_length(F.coalesce("t", F.lit(""))).cast("long").alias("n_bytes"), cut("t", "ranges").alias("c"))
    last = F.col("c.kept").cast("string").alias("kept_sha256") if digest else F.col("c.kept").alias("kept")
    return out.select(F.col(key), "n_bytes", "c.n_removed", "c.n_spans", last)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without its repeated 200-byte strings."""
    return dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
