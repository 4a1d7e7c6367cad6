"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document has as many words as an item; windows that begin before the document
or end after it are tried too, cut to it. Item and window have a fingerprint of 256 bits: a 64-bit SimHash of the words of each
quarter, weighted by how often they occur, so that an edit in one place disturbs one part.
An index over ``BLOCKS`` blocks of 16 bits finds every item that differs from a window in
``RADIUS`` bits at most: one block at least then differs in a single bit or none, and all
values that do are looked up. An exact weighted Jaccard similarity of the five-word
shingles decides on the candidates. Windows are fingerprinted only if as many of their
shingles belong to any items as that similarity takes; no others can reach it.

Texts of similarity 0.8 mostly lie within the radius; tests measure how many against brute
force. Fingerprints are made for ``CHUNK`` windows at a time, so memory does not grow with
their number. The benchmark reaches the executors in broadcast blocks of about
``BLOCK_BYTES``; a larger one takes several passes over the documents, each of them written
to the shared folder. Documents are not shuffled.

Null and empty texts match nothing, nor do items without words. Repeated rows are judged
each on their own. Items under five words match windows of the same words only. The ids of
items may be of any type, null included; other columns are carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, table
from .hashing import SHINGLE, blocks, shingles, words

SIMILARITY = 0.8
PARTS, BLOCKS = 4, 16
#: With 16 blocks, 32 differing bits are the fewest that leave no block with one or none.
RADIUS = 2 * BLOCKS - 1
#: Windows that are fingerprinted at once; bytes of the benchmark's texts for each pass.
CHUNK, BLOCK_BYTES = 1024, 32 << 20

_FLIPS = np.concatenate(([0], 1 << np.arange(16))).astype(np.uint16)


def fingerprints(word: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Rows of four longs for the windows of ``n`` words that begin at ``start``, which may
    lie before the text."""
    out = np.empty((len(start), 32), np.uint8)
    wide = 32 // PARTS  # bytes of each part
    for i in range(0, len(start), CHUNK):
        some = start[i : i + CHUNK]
        for own in np.split(some, np.flatnonzero(np.diff(some) > CHUNK) + 1):
            lo, hi = max(int(own[0]), 0), min(int(own[-1]) + n, len(word))
            bits = np.unpackbits(word[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide], axis=1)
            sums = np.zeros((hi - lo + 1, 8 * wide), np.int32)
            np.cumsum(bits.astype(np.int8) * 2 - 1, axis=0, dtype=np.int32, out=sums[1:])
            at = i + np.searchsorted(some, own[0])
            edges = [np.clip(own + k * n // PARTS - lo, 0, hi - lo) for k in range(PARTS + 1)]
            for k in range(PARTS):
                out[at : at + len(own), wide * k : wide * (k + 1)] = np.packbits(sums[edges[k + 1]] > sums[edges[k]], axis=1)
    return out.view("<u8")


class HammingIndex:
    """All pairs (query, fingerprint) that differ in ``RADIUS`` bits at most."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        value = prints.view("<u2").reshape(len(prints), BLOCKS)
        self.order = np.argsort(value, axis=0, kind="stable").T
        self.value = [value[o, b] for b, o in enumerate(self.order)]

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """Numbers query * fingerprints + fingerprint of the pairs that share a block but
        for one bit, each once."""
        at = queries.view("<u2").reshape(len(queries), BLOCKS)
        pairs = []
        for b, (order, value) in enumerate(zip(self.order, self.value)):
            near = (at[:, b, None] ^ _FLIPS).ravel()
            lo, hi = np.searchsorted(value, near, "left"), np.searchsorted(value, near, "right")
            some = np.flatnonzero(hi > lo)
            n = hi[some] - lo[some]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[some], n)
            pairs.append(np.repeat(some // len(_FLIPS), n) * len(self.prints) + order[k])
        return np.unique(np.concatenate(pairs))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, i = np.divmod(self.candidates(queries), len(self.prints))
        close = np.bitwise_count(queries[q] ^ self.prints[i]).sum(1) <= RADIUS
        return q[close], i[close]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets."""
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    both = np.minimum(ca[ia], cb[ib]).sum()
    return both / (len(a) + len(b) - both)


class Items:
    def __init__(self, texts: list[str]):
        self.shingles: list[np.ndarray] = []
        by_words: dict[int, list[tuple[int, np.ndarray]]] = {}
        for begin, held in blocks(texts):
            w, at = words(held)
            s, first = shingles(w, at)
            for d in range(len(held)):
                self.shingles.append(s[first[d] : first[d + 1]])
                by_words.setdefault(int(at[d + 1] - at[d]), []).append((begin + d, fingerprints(w[at[d] : at[d + 1]], np.zeros(1, np.int64), int(at[d + 1] - at[d]))[0] if at[d + 1] > at[d] else np.zeros(4, np.uint64)))
        by_words.pop(0, None)
        self.by_words = {n: (np.array([i for i, _ in own]), HammingIndex(np.stack([f for _, f in own]))) for n, own in by_words.items()}
        sizes = np.array([len(s) for s in self.shingles], np.int64)
        n_words = np.zeros(len(texts), np.int64)
        for n, (ids, _) in self.by_words.items():
            n_words[ids] = n
        every = np.concatenate([*self.shingles, np.empty(0, np.uint64)])
        # Every shingle with the numbers of words of the items that hold it.
        pair = np.unique(np.stack([every, np.repeat(n_words, sizes).astype(np.uint64)], 1), axis=0)
        self.every, self.length = pair[:, 0].copy(), pair[:, 1].astype(np.int64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.every >> np.uint64(44)] = True

    def match(self, word: np.ndarray, s: np.ndarray, known: np.ndarray) -> list[tuple[int, float]]:
        """(item, similarity) for a text's words and shingles; ``known``: where items' are."""
        best: dict[int, float] = {}
        lo, hi = np.searchsorted(self.every, s[known], "left"), np.searchsorted(self.every, s[known], "right")
        lengths = np.unique(np.concatenate([self.length[a:b] for a, b in set(zip(lo.tolist(), hi.tolist()))]))
        held = np.concatenate(([0], np.cumsum(np.bincount(known, minlength=len(s)))))
        for n in lengths.tolist():
            size = max(n - SHINGLE + 1, 1)
            # A window that has fewer known shingles than this is not similar enough.
            spare = size - int(np.ceil(SIMILARITY * size - 1e-9))
            start = np.arange(-min(spare, len(s)), len(s))
            first, last = np.clip(start, 0, len(s)), np.clip(start + size, 0, len(s))
            start = start[held[last] - held[first] >= size - spare]
            ids, index = self.by_words[n]
            for i in range(0, len(start), CHUNK):
                some = start[i : i + CHUNK]
                q, k = index.near(fingerprints(word, some, n))
                for at, item in zip(some[q].tolist(), ids[k].tolist()):
                    if best.get(item, 0) < 1:
                        best[item] = max(best.get(item, 0), similarity(s[max(at, 0) : max(at + size, 0)], self.shingles[item]))
        return sorted((i, x) for i, x in best.items() if x >= SIMILARITY)

    def search(self, texts) -> list[list[tuple[int, float]]]:
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        for begin, held in blocks(texts):
            w, at = words(held)
            s, first = shingles(w, at)
            maybe = np.flatnonzero(self.sieve[s >> np.uint64(44)])
            place = np.searchsorted(self.every, s[maybe])
            known = maybe[self.every[np.minimum(place, len(self.every) - 1)] == s[maybe]] if len(self.every) else maybe[:0]
            for d in np.unique(np.searchsorted(first, known, "right") - 1):
                lo, hi = first[d], first[d + 1]
                out[begin + d] = self.match(w[at[d] : at[d + 1]], s[lo:hi], known[(known >= lo) & (known < hi)] - lo)
        return out


_built: dict[str, Items] = {}


def _searcher(spark: SparkSession, ids: list, texts: list[str], kind: T.DataType):
    sent, name = spark.sparkContext.broadcast((ids, texts)), uuid.uuid4().hex

    @F.pandas_udf(kind)
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, texts = sent.value
        if name not in _built:
            _built.clear()
            _built[name] = Items(texts)
        for series in parts:
            yield pd.Series([[(ids[i], x) for i, x in hits] for hits in _built[name].search(series.tolist())])

    return search


def _item_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """The benchmark on the driver, about BLOCK_BYTES at a time."""
    ids, texts, size = [], [], 0
    for i, t in benchmark.select(item, text).where(F.col(text).isNotNull()).orderBy(item, text).toLocalIterator():
        ids.append(i)
        texts.append(t)
        size += len(t)
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one column more, and its name: array of (item_id, similarity), empty
    for clean documents."""
    hits, found = fresh(docs, "hits", "found")
    kind = T.ArrayType(T.StructType([T.StructField("item_id", benchmark.schema[item].dataType), T.StructField("similarity", T.DoubleType())]))
    out = docs.withColumn(hits, F.array().cast(kind))
    for n, (ids, texts) in enumerate(_item_blocks(benchmark, item, item_text)):
        if n:
            out = materialize(out, "passes")
        out = out.withColumn(found, _searcher(docs.sparkSession, ids, texts, kind)(F.col(text))).withColumn(hits, F.concat(hits, found)).drop(found)
    return out, hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents of ``docs`` that hold no item."""
    out, hits = contaminated(docs, benchmark, text)
    return out.where(F.size(hits) == 0).drop(hits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, similarity) for every benchmark item that a document holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, hits = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode(hits).alias("hit")).select("doc_id", "hit.item_id", F.round("hit.similarity", 6).alias("similarity"))
