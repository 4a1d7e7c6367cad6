"""Near-duplicate documents by DartMinHash.

A text is the multiset of its five-word shingles. Each copy of a shingle is a region of
weight one in which hashed darts land: how many, at which rank and for which of the
``COORDINATES`` coordinates follows from the hash alone, so that equal regions get equal
darts. A signature keeps the earliest dart of each coordinate; two of them agree in a
coordinate with the weighted Jaccard similarity of their texts. Just as many ranks are
thrown as it takes to fill every coordinate, whatever the length of the text.

``BANDS`` bands of ``ROWS`` coordinates make buckets. Texts of equal multisets are one node
first. A bucket links each node to its least node and to the one of least hash, never all
pairs. An exact weighted Jaccard similarity decides on a link: first on each node's most
frequent one, then on all those that lie between different components, and links
within a component need no more proof. Components are found by joins.

Nodes of a bucket that is still in several components then meet without a centre: two
texts of similarity 0.8 share one of their rarest copies of shingles, a fifth of each text
(prefix filter; any one order of the copies is exact, rare ones first keeps groups small).
After a few rounds of centres, the text with the fewest rarer copies first, what shares one,
lies apart and can be similar by lengths and places is verified as well, so that no pair
that shares a bucket is lost. Copies that the same texts hold count as one there.

A node is a multiset of shingles, whatever ids its rows have; a class is a component, and its
id is the least doc_id in it (of any type that can be ordered), null if none has one. Texts
without words are copies only of equal texts; null counts as the empty text. Every row is a
document of its own, also where rows share a doc_id or have none. An empty table gives no
rows.

A node with more than ``HOT_LINKS`` links to verify is sent in as many parts as it takes, so
that no task gets all links of a centre; the other end's shingles travel once for each link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, identity, materialize, scratch, table
from .decontaminate import similarity
from .graph import components
from .hashing import blocks, mix, shingles, words

SIMILARITY = 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
#: Darts that fill all coordinates of 19 texts in 20.
DARTS = int(COORDINATES * (np.log(COORDINATES) + 3))

#: Buckets in which copies of shingles are counted to tell rare ones.
RARITY = 1 << 16
#: Rounds in which texts that share a rare copy meet a centre, after the one with the text
#: edited least, and before those left meet each other.
STAR_ROUNDS = 2

#: Ids of texts to compare are broadcast up to this number, and joined by shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Links of a node that are verified in one part.
HOT_LINKS = 64

_COPY, _CELL, _DART = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)  # odd multipliers (fixed values)
_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, i + 1, dtype=float)) for i in range(16)])
_UNIT = 2.0**-53

_SIGNED = T.StructType([T.StructField("fa", T.LongType()), T.StructField("fb", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def units(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each copy of each shingle, its text), by text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((s, text))
    s, text = s[order], text[order]
    start = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (text[1:] != text[:-1])))) if len(s) else np.empty(0, int)
    copy = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    return mix(s + copy.astype(np.uint64) * _COPY), text


def throw(unit: np.ndarray, text: np.ndarray, cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(dart of each text and coordinate, whether there is one) from ``cells[text]`` ranks."""
    per = cells[text]
    at = np.repeat(np.arange(len(unit)), per)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(per) - per, per)
    region = mix(unit[at] ^ (cell + 1).astype(np.uint64) * _CELL)
    count = np.searchsorted(_POISSON, (region >> np.uint64(11)) * _UNIT, "right")
    dart_of = np.repeat(np.arange(len(at)), count)
    nth = np.arange(len(dart_of)) - np.repeat(np.cumsum(count) - count, count)
    dart = mix(region[dart_of] + (nth + 1).astype(np.uint64) * _DART)
    rank = cell[dart_of] + (dart >> np.uint64(11)) * _UNIT
    place = text[at[dart_of]] * COORDINATES + (mix(dart) % np.uint64(COORDINATES)).astype(np.int64)
    earliest = np.full(n * COORDINATES, np.inf)
    np.minimum.at(earliest, place, rank)
    kept = np.zeros(n * COORDINATES, np.uint64)
    win = rank == earliest[place]
    np.maximum.at(kept, place[win], dart[win])
    return kept.reshape(n, COORDINATES), np.isfinite(earliest).reshape(n, COORDINATES)


def signatures(unit: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Texts x coordinates; texts without units are all zero."""
    size = np.bincount(text, minlength=n)
    cells = np.where(size > 0, -(-DARTS // np.maximum(size, 1)), 0)
    out, full = throw(unit, text, cells, n)
    todo = np.flatnonzero((size > 0) & ~full.all(1))
    while len(todo):
        cells[todo] *= 2
        of = np.full(n, -1)
        of[todo] = np.arange(len(todo))
        own = of[text] >= 0
        again, full = throw(unit[own], of[text[own]], cells[todo], len(todo))
        out[todo] = again
        todo = todo[~full.all(1)]
    return out


def sketch(texts) -> list[tuple[int, int, list[int]]]:
    """(two hashes of the multiset, a hash for each band) of every text."""
    out: list[tuple[int, int, list[int]]] = []
    for begin, held in blocks(texts):
        s, first = shingles(*words(held))
        n = len(held)
        unit, text = units(s, first)
        sign = signatures(unit, text, n).reshape(n, BANDS, ROWS)
        band = np.full((n, BANDS), 1, np.uint64) * (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _CELL
        for k in range(ROWS):
            band = mix(band ^ sign[:, :, k])
        sums = np.zeros((2, len(unit) + 1), np.uint64)
        np.cumsum(mix(unit), out=sums[0, 1:])
        np.cumsum(mix(unit ^ _DART), out=sums[1, 1:])
        edge = np.searchsorted(text, np.arange(n + 1))
        both = (sums[:, edge[1:]] - sums[:, edge[:-1]]).view(np.int64)
        for d in range(n):
            if edge[d] < edge[d + 1]:
                out.append((int(both[0, d]), int(both[1, d]), band[d].view(np.int64).tolist()))
            else:  # no words: only an equal text is a copy
                raw = np.frombuffer((texts[begin + d] or "").encode(), np.uint8).astype(np.uint64)
                h = mix(raw + np.arange(1, len(raw) + 1, dtype=np.uint64) * _COPY).sum(dtype=np.uint64)
                out.append((int(np.int64(h.astype(np.int64))), -1, []))
    return out


@F.pandas_udf(_SIGNED)
def _signed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for series in parts:
        yield pd.DataFrame(sketch(series.tolist()), columns=["fa", "fb", "bands"])


@F.pandas_udf(T.BinaryType())
def _shingled(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in parts:
        out = []
        for _, held in blocks(series.tolist()):
            s, first = shingles(*words(held))
            out += [np.sort(s[first[d] : first[d + 1]]).tobytes() for d in range(len(held))]
        yield pd.Series(out)


@F.pandas_udf(T.DoubleType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], dtype="float64")


def _small(df: DataFrame) -> DataFrame:
    """A materialized table, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose exact similarity is high enough."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(ends.where(F.col("n") > HOT_LINKS).select("h", F.expr(f"n div {HOT_LINKS} + 1").alias("parts")), "hot")
    n = hot.count()
    if not n:  # one part each
        both = pairs.join(sets.withColumnsRenamed({"k": "u", "s": "sc"}), "u").join(sets.withColumnRenamed("k", "v"), "v")
        return both.withColumn("x", _similar("sc", "s")).where(F.col("x") >= SIMILARITY).select("u", "v")
    hot = F.broadcast(hot) if n <= BROADCAST_IDS else hot
    for side in ("u", "v"):
        pairs = pairs.join(hot.select(F.col("h").alias(side), F.col("parts").alias(f"p{side}")), side, "left")
    first = F.coalesce("pu", F.lit(1)) >= F.coalesce("pv", F.lit(1))  # which end has more links
    centre, other = F.when(first, F.col("u")).otherwise(F.col("v")), F.when(first, F.col("v")).otherwise(F.col("u"))
    part = F.pmod(F.xxhash64(other), F.coalesce(F.greatest("pu", "pv"), F.lit(1)))
    links = pairs.select("u", "v", centre.alias("c"), other.alias("o"), part.alias("part"))
    parts = sets.join(hot, F.col("k") == F.col("h"), "left").select(F.col("k").alias("c"), F.col("s").alias("sc"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    both = links.join(sets.withColumnRenamed("k", "o"), "o").join(parts, ["c", "part"])
    return both.withColumn("x", _similar("sc", "s")).where(F.col("x") >= SIMILARITY).select("u", "v")


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many copies of shingles of ``sets`` fall into each of ``RARITY`` buckets."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(RARITY, np.int64)
        for batch in batches:
            for raw in batch["s"]:
                unit, _ = _copies(raw)
                total += np.bincount((unit % np.uint64(RARITY)).astype(np.int64), minlength=RARITY)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    out = np.zeros(RARITY, np.int64)
    for r in sets.select("s").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def _copies(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    s = np.frombuffer(raw, np.uint64)
    return units(s, np.array([0, len(s)]))


def _prefixes(sets: DataFrame, rarity: np.ndarray) -> DataFrame:
    """(k, size, place, unit): the rarest copies of each text, one of which every text of
    high enough similarity has among its own."""

    def prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, raw in zip(batch["k"], batch["s"]):
                unit, _ = _copies(raw)
                n = len(unit)
                if n:
                    rare = np.lexsort((unit, rarity[(unit % np.uint64(RARITY)).astype(np.int64)]))
                    rare = rare[: n - int(np.ceil(SIMILARITY * n - 1e-6)) + 1]
                    yield pd.DataFrame({"k": k, "size": n, "place": np.arange(len(rare)), "unit": unit[rare].view(np.int64)})

    key = sets.schema["k"].dataType.simpleString()
    return sets.select("k", "s").mapInPandas(prefix, f"k {key}, size long, place long, unit long")


def _possible(left: Column, sizes: Column) -> Column:
    """Whether texts can be similar that have ``left`` copies in common at most."""
    return left * (1 + SIMILARITY) >= SIMILARITY * sizes - 1e-6


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links))


def _rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
    return df.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))


def _undecided(rows: DataFrame) -> DataFrame:
    """Rows (k, size, place, unit, root) without those that can be similar to no text of
    another component by their unit. What two texts have in common, if this copy is the
    first one, is ``size - place`` of either at most."""
    left = F.col("size") - F.col("place")
    span = rows.groupBy("unit").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.min("size").alias("least"), F.max(left).alias("most")).where("a < z").drop("a", "z")
    return rows.join(span, "unit").where(_possible(F.least(left, "most"), F.col("size") + F.col("least"))).drop("least", "most")


def _once(rows: DataFrame) -> DataFrame:
    """Rows with one unit for all those that the same texts hold, at the least place; a hash
    of the texts stands for it, and were two of them equal, more would meet and none less."""
    held = rows.groupBy("unit").agg(F.xxhash64(F.bit_xor(F.xxhash64("k")), F.bit_xor(F.xxhash64("k", F.lit(1))), F.count(F.lit(1))).alias("group"))
    return rows.join(held, "unit").groupBy(F.col("group").alias("unit"), "k", "root", "size").agg(F.min("place").alias("place"))


def _missed(places: DataFrame, roots: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``roots`` after the links within buckets that their centres do not show."""
    placed = _rooted(places, roots).select("k", "band", "root")
    mixed = placed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("a"), F.max("root").alias("z")).where("n > 2 AND a < z").select("band")
    unsure = materialize(placed.join(mixed, "band").select("k", "root").distinct(), "open")
    own = materialize(sets.join(unsure, "k"), "own")
    rare = materialize(_prefixes(own, _rarity(own)).join(unsure, "k"), "rare")
    rare = materialize(_undecided(rare).drop("root"), "shared")
    done = pairs.select("u", "v")
    for n in range(STAR_ROUNDS + 1):  # joins most of what belongs together without pairs
        now = _rooted(rare, roots)
        # edited copies of one text are nearer to the one edited least, which has the fewest rarer copies, than to each other
        order = F.xxhash64("k", "unit", F.lit(n)) if n else F.struct((F.col("place") / F.col("size")).alias("p"), F.xxhash64("k").alias("x"))
        centre = now.groupBy("unit").agg(F.min(F.struct(order.alias("h"), "k", "root", "size", "place")).alias("c"))
        tried = now.join(centre, "unit").where(F.col("root") != F.col("c.root")).where(_possible(F.least(F.col("size") - F.col("place"), F.col("c.size") - F.col("c.place")), F.col("size") + F.col("c.size")))
        tried = tried.select(F.greatest("k", "c.k").alias("u"), F.least("k", "c.k").alias("v")).distinct()
        tried = materialize(tried.join(done, ["u", "v"], "left_anti"), "tried")
        done = done.union(tried)
        roots = _merged(roots, _verified(tried, sets))
    now = materialize(_undecided(_once(_undecided(_rooted(rare, roots)))), "rooted")
    parts = now.groupBy("unit", "root").agg(F.max(F.col("size") - F.col("place")).alias("left"), F.min("size").alias("size"))
    one, two = (parts.select("unit", *(F.col(c).alias(f"{c}{i}") for c in ("root", "left", "size"))) for i in (1, 2))
    near = one.join(two, "unit").where((F.col("root1") < F.col("root2")) & _possible(F.least("left1", "left2"), F.col("size1") + F.col("size2")))
    for i, j in ("12", "21"):  # each text that can be similar to some of the other component, instead of its component
        own = now.select("unit", F.col("root").alias(f"root{i}"), F.col("k").alias(f"k{i}"), F.col("size").alias("s"), (F.col("size") - F.col("place")).alias("l"))
        near = near.drop(f"left{i}", f"size{i}").join(own, ["unit", f"root{i}"]).where(_possible(F.least("l", f"left{j}"), F.col("s") + F.col(f"size{j}"))).withColumnsRenamed({"l": f"left{i}", "s": f"size{i}"})
    tried = near.select(F.greatest("k1", "k2").alias("u"), F.least("k1", "k2").alias("v")).distinct()
    return _merged(roots, _verified(materialize(tried.join(done, ["u", "v"], "left_anti"), "missed"), sets))


def _nodes(signed: DataFrame) -> DataFrame:
    """(k, fa, fb, key, ta, tb, ck, bands): a number for each multiset, the least key of its
    rows, one of its texts (with that row's key), and its bands."""
    row = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("ck"), "ta", "tb")
    one = signed.groupBy("fa", "fb").agg(F.min("key").alias("key"), F.min(row).alias("row"), F.first("bands").alias("bands"))
    return materialize(one.select(F.monotonically_increasing_id().alias("k"), "fa", "fb", "key", "row.ck", "row.ta", "row.tb", "bands"), "nodes")


def _linked(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of every node that is not the least of its component."""
    places = nodes.select("k", F.explode("bands").alias("band")).distinct()
    order = F.struct(F.xxhash64("k", F.lit(5)).alias("h"), F.col("k"))
    stars = places.groupBy("band").agg(F.min("k").alias("c"), F.max("k").alias("most"), F.min(order).alias("o")).where(F.col("c") < F.col("most")).select("band", F.array_distinct(F.array("c", "o.k")).alias("centres"))
    tried = places.join(stars, "band").select("k", F.explode("centres").alias("c")).where(F.col("k") != F.col("c"))
    pairs = materialize(tried.select(F.greatest("k", "c").alias("u"), F.least("k", "c").alias("v")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")), "pairs")
    ends = pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "k")
    wanted = _small(materialize(nodes.select("k", "ck", "ta", "tb").join(ends, "k"), "wanted").withColumnsRenamed({"ta": "wa", "tb": "wb"}))
    once = texts.join(wanted, (F.col("a") == F.col("wa")) & (F.col("b") == F.col("wb")) & F.col("key").eqNullSafe(F.col("ck"))).select("k", _shingled("t").alias("s"))
    sets = materialize(once.groupBy("k").agg(F.first("s").alias("s")), "sets")  # rows may be repeated
    best = pairs.groupBy("u").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("b")).select("u", "b.v")
    best = materialize(best, "best")
    roots = components(_verified(best, sets))
    rest = pairs.join(best, ["u", "v"], "left_anti").select("u", "v")
    for side in ("u", "v"):
        rest = rest.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
    apart = materialize(rest.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v"), "apart")
    starred = _merged(roots, _verified(apart, sets))
    return _missed(places, starred, sets, pairs)


def _grouped(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Materialized tables (fa, fb, class_id, ck, ta, tb): of each multiset its class, and
    the row (key and text) that stands for the class; and (key, ta, tb, fa, fb, bands): the
    rows' texts and multisets."""
    a, b = identity(F.col(text))
    texts = docs.select(F.col(key).alias("key"), a.alias("a"), b.alias("b"), F.col(text).alias("t"))
    signed = materialize(texts.select("key", F.col("a").alias("ta"), F.col("b").alias("tb"), _signed("t").alias("x")).select("key", "ta", "tb", "x.*"), "signed")
    nodes = _nodes(signed)
    roots = _linked(nodes, texts)
    rooted = nodes.join(roots, F.col("k") == F.col("node"), "left").select("fa", "fb", "key", F.struct(F.col("ck").isNull().alias("none"), "ck", "ta", "tb").alias("row"), F.coalesce("root", "k").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("key").alias("class_id"), F.min("row").alias("head"))
    return materialize(rooted.select("fa", "fb", "root").join(heads, "root").select("fa", "fb", "class_id", "head.ck", "head.ta", "head.tb"), "classes"), signed


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id) for every row of ``docs``; a key of that name gets the class as
    _class_id."""
    with scratch(docs.sparkSession) as keep:
        group, signed = _grouped(docs, key, text)
        keep += [group, signed]
    (name,) = fresh(docs.select(key), "class_id")
    return signed.select(F.col("key"), "fa", "fb").join(group, ["fa", "fb"]).select(F.col("key").alias(key), F.col("class_id").alias(name))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without all but one document of each class: that of the least key (a row
    without key only if none has one), then of least text hash. Rows that repeat both key
    and text are one document and stay or go together."""
    with scratch(docs.sparkSession) as keep:
        group, signed = _grouped(docs, key, text)
        same = F.col("key").eqNullSafe(F.col("ck")) & (F.col("sa") == F.col("ta")) & (F.col("sb") == F.col("tb"))
        rows = signed.select("key", "fa", "fb", F.col("ta").alias("sa"), F.col("tb").alias("sb")).join(group, ["fa", "fb"])
        gone = materialize(rows.where(~same).select("key", "sa", "sb").distinct(), "gone")
        keep.append(gone)
    a, b, *other = fresh(docs, "a", "b", "gone_key", "gone_a", "gone_b")
    body = docs.withColumns(dict(zip((a, b), identity(F.col(text)))))
    met = F.col(key).eqNullSafe(F.col(other[0])) & (F.col(a) == F.col(other[1])) & (F.col(b) == F.col(other[2]))
    return body.join(gone.toDF(*other), met, "left_anti").drop(a, b)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
