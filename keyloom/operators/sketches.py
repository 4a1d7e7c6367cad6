"""Sketches as relations: a filter is the set of its bits, a count-min sketch the table of
its cells. They are built by map-side combining aggregations, merged by union, and probed
by joins, for all keys at once. Digests are states in one binary column, which are built and
merged by aggregations. Exact counterparts stand beside them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- Bloom filters: bits(key, bit)


def bloom_size(error: float, capacity: int) -> tuple[int, int]:
    """(bits, hashes)."""
    bits = max(math.ceil(-capacity * math.log(error) / math.log(2) ** 2), 8)
    return bits, max(round(bits / capacity * math.log(2)), 1)


def _hash(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _bits(items: DataFrame, bits: int, hashes: int) -> DataFrame:
    a, b = (F.pmod(_hash(seed, F.col("item")), F.lit(bits)) for seed in (1, 2))
    places = F.array_distinct(F.array(*((a + i * b) % bits for i in range(hashes))))
    return items.withColumn("bit", F.explode(places))


def bloom(items: DataFrame, error: float = 0.01, capacity: int = 10_000) -> DataFrame:
    """Build from ``items(key, item)``."""
    return _bits(items.select("key", "item"), *bloom_size(error, capacity)).select("key", "bit").distinct()


def bloom_has(state: DataFrame, asked: DataFrame, error: float = 0.01, capacity: int = 10_000) -> DataFrame:
    """``asked(key, item)`` with found; what was added is always found."""
    probes = _bits(asked.select("key", "item").distinct(), *bloom_size(error, capacity))
    hits = probes.join(state.withColumn("hit", F.lit(1)), ["key", "bit"], "left")
    return hits.groupBy("key", "item").agg((F.count(F.lit(1)) == F.count("hit")).alias("found"))


def _parts(items: DataFrame, capacity: int) -> DataFrame:
    """(key, parts): how many filters of ``capacity`` the distinct items of each key ask for."""
    n = items.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return n.select("key", F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("long").alias("parts"))


def _dealt(items: DataFrame) -> DataFrame:
    return items.withColumn("part", F.pmod(_hash(3, F.col("item")), F.col("parts")))


def bloom_grown(items: DataFrame, error: float = 0.01, capacity: int = 10_000) -> DataFrame:
    """Build from ``items(key, item)``: bits(key, parts, part, bit). A key of more than
    ``capacity`` items gets as many filters of that size as it takes; an item's hash says in
    which of them it is, so that the error stays as asked however many there are."""
    items = items.select("key", "item").distinct()
    dealt = _dealt(items.join(_parts(items, capacity), "key"))
    return _bits(dealt, *bloom_size(error, capacity)).select("key", "parts", "part", "bit").distinct()


def bloom_grown_has(state: DataFrame, asked: DataFrame, error: float = 0.01, capacity: int = 10_000) -> DataFrame:
    """``asked(key, item)`` with found, of ``bloom_grown``'s bits."""
    parts = state.select("key", "parts").distinct()
    probes = _bits(_dealt(asked.select("key", "item").distinct().join(parts, "key", "left").fillna(1, ["parts"])), *bloom_size(error, capacity))
    hits = probes.drop("parts").join(state.drop("parts").withColumn("hit", F.lit(1)), ["key", "part", "bit"], "left")
    return hits.groupBy("key", "item").agg((F.count(F.lit(1)) == F.count("hit")).alias("found"))


def bloom_grown_info(state: DataFrame, error: float = 0.01, capacity: int = 10_000) -> DataFrame:
    """(key, parts, capacity, bits, hashes, bits_set): capacity, bits and hashes of each part,
    and the bits that are set in all of them."""
    bits, hashes = bloom_size(error, capacity)
    n = state.groupBy("key").agg(F.max("parts").alias("parts"), F.count("bit").alias("bits_set"))
    return n.select("key", "parts", F.lit(capacity).alias("capacity"), F.lit(bits).alias("bits"), F.lit(hashes).alias("hashes"), "bits_set")


def bloom_expected(n: Column, parts: Column, error: float = 0.01, capacity: int = 10_000) -> Column:
    """How many bits ``n`` items set in ``parts`` filters, as far as hashes are even."""
    bits, hashes = bloom_size(error, capacity)
    return parts * bits * (1 - F.exp(-hashes * n / parts / bits))


def bloom_dump(state: DataFrame) -> DataFrame:
    """(key, chunk, bytes): bitmaps of 32768 bits, ready to be written; see bloom_load."""
    at = F.col("bit") + 1  # positions start at 1
    return state.groupBy("key", F.bitmap_bucket_number(at).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bytes"))


def bloom_load(chunks: DataFrame) -> DataFrame:
    """Bits of dumped chunks."""
    wide = chunks.select("key", "chunk", F.posexplode(F.split(F.hex("bytes"), "")).alias("nibble", "digit")).where(F.col("digit") != "")
    value = F.conv("digit", 16, 10).cast("int")
    place = F.shiftright(F.col("nibble"), 1) * 8 + F.when(F.col("nibble") % 2 == 0, 4).otherwise(0)
    set_ = F.explode(F.filter(F.array(*map(F.lit, range(4))), lambda i: F.call_function("getbit", value, i) == 1))
    return wide.select("key", ((F.col("chunk") - 1) * 32768 + place).alias("base"), set_.alias("i")).select("key", (F.col("base") + F.col("i")).cast("long").alias("bit"))


def bloom_card(state: DataFrame, error: float = 0.01, capacity: int = 10_000) -> DataFrame:
    """(key, card): how many items were added, as the share of bits that are set tells."""
    bits, hashes = bloom_size(error, capacity)
    n = F.least(F.count(F.lit(1)), F.lit(bits - 1))
    return state.groupBy("key").agg(F.round(-bits / hashes * F.log(1 - n / bits)).cast("long").alias("card"))


def bloom_info(state: DataFrame, error: float = 0.01, capacity: int = 10_000) -> DataFrame:
    """(key, capacity, bits, hashes, bits_set)."""
    bits, hashes = bloom_size(error, capacity)
    return state.groupBy("key").agg(F.count("bit").alias("bits_set")).select("key", F.lit(capacity).alias("capacity"), F.lit(bits).alias("bits"), F.lit(hashes).alias("hashes"), "bits_set")


# ---- cuckoo filters: slots(key, bucket, other, print, n). An item has a fingerprint and two
# buckets, either of which follows from the other and the fingerprint. A slot is known by the
# lesser bucket, so nothing needs to be evicted; items of one slot cannot be told apart but
# by their names, as ``cuckoo_exact`` does after the filter has answered.

PRINT_BITS, BUCKET_SIZE = 16, 2


def cuckoo_size(capacity: int) -> int:
    """Buckets: a power of two that holds ``capacity`` items."""
    return 1 << max(math.ceil(math.log2(max(capacity / BUCKET_SIZE, 1))), 0)


def _slots(items: DataFrame, capacity: int) -> DataFrame:
    buckets = cuckoo_size(capacity)
    mark = (F.pmod(_hash(21, F.col("item")), F.lit((1 << PRINT_BITS) - 1)) + 1).alias("print")
    placed = items.withColumn("print", mark).withColumn("_one", F.pmod(_hash(22, F.col("item")), F.lit(buckets)))
    placed = placed.withColumn("_two", F.col("_one").bitwiseXOR(F.pmod(_hash(23, F.col("print")), F.lit(buckets))))
    return placed.withColumn("bucket", F.least("_one", "_two")).withColumn("other", F.greatest("_one", "_two")).drop("_one", "_two")


_SLOT = ["key", "bucket", "other", "print"]


def cuckoo(items: DataFrame, capacity: int) -> DataFrame:
    """Slots of ``items(key, item)``, each counted as often as it occurs."""
    return _slots(items, capacity).groupBy(*_SLOT).agg(F.count(F.lit(1)).alias("n"))


def cuckoo_add(slots: DataFrame, items: DataFrame, capacity: int, absent: bool = False) -> DataFrame:
    """The slots after adding; with ``absent`` only what is not found yet, once."""
    new = cuckoo(items, capacity)
    if absent:
        new = new.join(slots, _SLOT, "left_anti").withColumn("n", F.lit(1).cast("long"))
    return slots.unionByName(new).groupBy(*_SLOT).agg(F.sum("n").alias("n"))


def cuckoo_delete(slots: DataFrame, items: DataFrame, capacity: int) -> DataFrame:
    """One occurrence goes for each row of ``items``."""
    both = slots.join(cuckoo(items, capacity).withColumnRenamed("n", "gone"), _SLOT, "left")
    return both.withColumn("n", F.col("n") - F.coalesce("gone", F.lit(0))).where("n > 0").drop("gone")


def cuckoo_count(slots: DataFrame, asked: DataFrame, capacity: int) -> DataFrame:
    """``asked(key, item)`` with n (never too low) and found."""
    got = _slots(asked.select("key", "item").distinct(), capacity).join(slots, _SLOT, "left")
    return got.select("key", "item", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("found"))


def cuckoo_info(slots: DataFrame, capacity: int) -> DataFrame:
    """(key, buckets, bucket_size, items, slots): items were inserted and not deleted."""
    got = slots.groupBy("key").agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("slots"))
    return got.select("key", F.lit(cuckoo_size(capacity)).alias("buckets"), F.lit(BUCKET_SIZE).alias("bucket_size"), "items", "slots")


def _shared(items: DataFrame, capacity: int) -> DataFrame:
    """The slots of more than one of the distinct ``items(key, item)``: (key, bucket, other,
    print, together)."""
    return _slots(items, capacity).groupBy(*_SLOT).agg(F.count(F.lit(1)).alias("together")).where("together > 1")


def cuckoo_exact(got: DataFrame, counts: DataFrame, capacity: int) -> DataFrame:
    """The answers ``got`` of ``cuckoo_count``, with those in slots that several of the asked
    and the held items share replaced by what ``counts(key, item, n)`` says."""
    known = got.select("key", "item").union(counts.select("key", "item")).distinct()
    shared = _shared(known, capacity).drop("together")
    asked = _slots(got.select("key", "item"), capacity).join(shared, _SLOT, "left_semi").select("key", "item")
    held = _slots(counts, capacity).join(shared, _SLOT, "left_semi").select(F.col("key").alias("_k"), F.col("item").alias("_i"), F.col("n").alias("_n"))
    told = asked.join(held, F.col("key").eqNullSafe(F.col("_k")) & F.col("item").eqNullSafe(F.col("_i")), "left")
    told = told.select(F.col("key").alias("_k"), F.col("item").alias("_i"), F.coalesce("_n", F.lit(0)).alias("_n"))
    both = got.join(told, F.col("key").eqNullSafe(F.col("_k")) & F.col("item").eqNullSafe(F.col("_i")), "left")
    return both.select("key", "item", F.coalesce("_n", "n").alias("n"), F.coalesce(F.col("_n") > 0, "found").alias("found"))


def cuckoo_slots(info: DataFrame, items: DataFrame, capacity: int) -> DataFrame:
    """``cuckoo_info`` with a slot for each of the distinct ``items(key, item)``, also for
    those that share one."""
    more = _shared(items, capacity).groupBy("key").agg(F.sum(F.col("together") - 1).alias("more"))
    return info.join(more, "key", "left").withColumn("slots", F.col("slots") + F.coalesce("more", F.lit(0))).drop("more")


def cuckoo_dump(slots: DataFrame, chunk: int = 4096) -> DataFrame:
    """(key, chunk, bytes): 28 bytes for each slot, ``chunk`` buckets in a row."""
    number = lambda c, n: F.unhex(F.lpad(F.hex(F.col(c).cast("long")), 2 * n, "0"))
    row = F.concat(number("bucket", 8), number("other", 8), number("print", 4), number("n", 8))
    packed = slots.select("key", F.floor(F.col("bucket") / chunk).alias("chunk"), F.hex(row).alias("row"))
    return packed.groupBy("key", "chunk").agg(F.unhex(F.array_join(F.array_sort(F.collect_list("row")), "")).alias("bytes"))


def cuckoo_load(chunks: DataFrame) -> DataFrame:
    """The slots of dumped chunks."""
    starts = F.sequence(F.lit(1), F.octet_length("bytes") - 27, F.lit(28))
    rows = chunks.select("key", "bytes", F.explode(starts).alias("at"))
    number = lambda first, n: F.conv(F.hex(F.substring("bytes", F.col("at") + first, F.lit(n))), 16, 10).cast("long")
    return rows.select("key", number(0, 8).alias("bucket"), number(8, 8).alias("other"), number(16, 4).alias("print"), number(20, 8).alias("n"))


# ---- multisets, exact: counts(key, item, n)


def multiset(items: DataFrame) -> DataFrame:
    return items.groupBy("key", "item").agg(F.count(F.lit(1)).alias("n"))


def multiset_add(counts: DataFrame, items: DataFrame, absent: bool = False) -> DataFrame:
    new = items.join(counts, ["key", "item"], "left_anti") if absent else items
    added = multiset(new.distinct() if absent else new)
    return counts.unionByName(added).groupBy("key", "item").agg(F.sum("n").alias("n"))


def multiset_delete(counts: DataFrame, items: DataFrame) -> DataFrame:
    """One occurrence goes for each row of ``items``."""
    both = counts.join(multiset(items).withColumnRenamed("n", "gone"), ["key", "item"], "left")
    return both.select("key", "item", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n")).where("n > 0")


# ---- count-min: cells(key, row, col, n)


def cms_size(error: float, probability: float) -> tuple[int, int]:
    """(width, depth)."""
    return math.ceil(math.e / error), math.ceil(math.log(1 / probability))


def _cells(items: DataFrame, width: int, depth: int) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(r).alias("row"), F.pmod(_hash(r + 10, F.col("item")), F.lit(width)).alias("col")) for r in range(depth)))
    return items.select("*", F.inline(cells))


def cms(items: DataFrame, width: int, depth: int) -> DataFrame:
    """Build from ``items(key, item, n)``."""
    per = items.groupBy("key", "item").agg(F.sum("n").alias("n"))
    return _cells(per, width, depth).groupBy("key", "row", "col").agg(F.sum("n").alias("n"))


def cms_query(cells: DataFrame, asked: DataFrame, width: int, depth: int) -> DataFrame:
    """Estimates, never below the true counts."""
    probes = _cells(asked.select("key", "item").distinct(), width, depth)
    hits = probes.join(cells, ["key", "row", "col"], "left")
    return hits.groupBy("key", "item").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def cms_zero(keys: DataFrame, width: int, depth: int) -> DataFrame:
    """No cells yet: the dimensions of ``keys(key)`` as (key, width, depth)."""
    return keys.select("key", F.lit(width).alias("width"), F.lit(depth).alias("depth"))


def cms_info(made: DataFrame, cells: DataFrame) -> DataFrame:
    """(key, width, depth, count) of every ``cms_zero`` row: count is what was added."""
    n = cells.where(F.col("row") == 0).groupBy("key").agg(F.sum("n").alias("count"))
    return made.join(n, "key", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def cms_merge(cells: DataFrame, weights: dict[str, int], target: str, mode: str = "sum") -> DataFrame:
    w = F.element_at(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v)))), F.col("key"))
    scaled = cells.where(F.col("key").isin(list(weights))).withColumn("n", F.col("n") * w)
    return scaled.groupBy("row", "col").agg((F.max if mode == "max" else F.sum)("n").alias("n")).withColumn("key", F.lit(target))


# ---- top-k, exact


def top(items: DataFrame, k: int) -> DataFrame:
    """(key, item, n): by count, then item, of ``items(key, item, n)``."""
    n = items.groupBy("key", "item").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("key").orderBy(F.desc("n"), "item")
    return n.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def top_reserve(keys: DataFrame, k: int) -> DataFrame:
    """Empty lists of ``keys(key)``: (key, k)."""
    return keys.select("key", F.lit(k).alias("k"))


def top_count(items: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(key, item)`` with n, 0 for what was never added."""
    n = items.groupBy("key", "item").agg(F.sum("n").alias("n"))
    return asked.select("key", "item").distinct().join(n, ["key", "item"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def top_info(made: DataFrame, items: DataFrame) -> DataFrame:
    """(key, k, listed, least): how many items a list holds, and the least count among them."""
    (k,) = {r[0] for r in made.select("k").distinct().take(2)} or {0}
    got = top(items, k).groupBy("key").agg(F.count(F.lit(1)).alias("listed"), F.min("n").alias("least"))
    return made.join(got, "key", "left").withColumn("listed", F.coalesce("listed", F.lit(0)))


# ---- digests: states(key, state, least, greatest, total, n). They are built by partial
# aggregation, have a bounded size and can be merged; while a key has fewer values than
# about k, they hold all of them and answers are exact.


RANK_STEPS = 4096


def digest(values: DataFrame, k: int = 800) -> DataFrame:
    """The states of ``values(key, value)``."""
    v = F.col("value")
    return values.groupBy("key").agg(F.kll_sketch_agg_double("value", k).alias("state"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.sum(v).alias("total"), F.count(v).alias("n"))


def digest_create(keys: DataFrame) -> DataFrame:
    """Empty states of ``keys(key)``; also what is left of states that are reset."""
    none = F.lit(None)
    return keys.select("key", none.cast("binary").alias("state"), *(none.cast("double").alias(c) for c in ("least", "greatest", "total")), F.lit(0).cast("long").alias("n"))


def _joined(states: DataFrame, by: list[str]) -> DataFrame:
    out = [F.kll_merge_agg_double("state").alias("state"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("total").alias("total"), F.sum("n").alias("n")]
    return states.groupBy(*by).agg(*out)


def digest_add(states: DataFrame, values: DataFrame, k: int = 800) -> DataFrame:
    """The states after more values."""
    return _joined(states.unionByName(digest(values, k)), ["key"])


def digest_merge(states: DataFrame, sources: list, target) -> DataFrame:
    """One state of several keys' states; the values are not read again."""
    return _joined(states.where(F.col("key").isin(sources)), []).withColumn("key", F.lit(target))


def digest_info(states: DataFrame) -> DataFrame:
    """(key, n, least, greatest, mean, bytes)."""
    return states.select("key", "n", "least", "greatest", (F.col("total") / F.col("n")).alias("mean"), F.coalesce(F.octet_length("state"), F.lit(0)).alias("bytes"))


def quantiles(states: DataFrame, *q: float) -> DataFrame:
    """(key, quantiles): for each of ``q`` the least value of which that share is no greater."""
    return states.select("key", F.kll_sketch_get_quantile_double("state", F.array(*map(F.lit, q))).alias("quantiles"))


def cdf(states: DataFrame, x: float) -> DataFrame:
    """(key, cdf, rank, revrank): the share and number of values up to ``x``, and beyond."""
    share = F.when(F.col("least").isNull(), None).when(F.lit(x) < F.col("least"), 0.0).when(F.lit(x) >= F.col("greatest"), 1.0).otherwise(F.kll_sketch_get_rank_double("state", F.lit(float(x))))
    rank = F.round(share * F.col("n")).cast("long")
    return states.select("key", share.alias("cdf"), rank.alias("rank"), (F.col("n") - rank).alias("revrank"))


def by_rank(states: DataFrame, ranks: list[int], reverse: bool = False) -> DataFrame:
    """(key, value, rank): the values at 0-based ranks, from the greatest on with
    ``reverse``; ranks beyond the values have no row. Among more than ``RANK_STEPS`` values
    the nearest of as many quantiles is meant."""
    steps = F.split(F.lit(",".join(str(i / RANK_STEPS) for i in range(RANK_STEPS + 1))), ",").cast("array<double>")
    each = states.withColumn("all", F.kll_sketch_get_quantile_double("state", steps)).withColumn("rank", F.explode(F.array(*map(F.lit, ranks)))).where(F.col("rank") < F.col("n"))
    place = (F.col("n") - F.col("rank") if reverse else F.col("rank") + 1) - 0.5
    return each.select("key", F.get("all", F.round(place / F.col("n") * RANK_STEPS).cast("int")).alias("value"), "rank")


def trimmed_mean(states: DataFrame, low: float, high: float, steps: int = 1000) -> DataFrame:
    """Mean of the values between two quantiles, from ``steps`` quantiles between them."""
    at = F.array(*(F.lit(low + (high - low) * (i + 0.5) / steps) for i in range(steps)))
    return states.select("key", (F.aggregate(F.kll_sketch_get_quantile_double("state", at), F.lit(0.0), lambda s, x: s + x) / steps).alias("mean"))


def exact_quantiles(values: DataFrame, *q: float) -> DataFrame:
    return values.groupBy("key").agg(F.percentile("value", list(q)).alias("quantiles"))


# ---- HyperLogLog


def hll(items: DataFrame, precision: int = 14) -> DataFrame:
    """(key, state)."""
    return items.groupBy("key").agg(F.hll_sketch_agg("item", precision).alias("state"))


def hll_count(states: DataFrame) -> DataFrame:
    return states.select("key", F.hll_sketch_estimate("state").alias("estimate"))


def hll_merge(states: DataFrame, target: str) -> DataFrame:
    return states.agg(F.hll_union_agg("state").alias("state")).select(F.lit(target).alias("key"), "state")
