"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and their prefixes, so that inflected forms share some, hashed
into ``BUCKETS``. Of these the machine uses the ``MAX_TERMS`` at most whose presence goes
with the label beyond ``LEAST_Z`` standard deviations, and terms that tell nothing alone but
in pairs: of the ``PAIR_TERMS`` most frequent ones that ``MOST_SHARE`` of the sample at most
holds, those of the ``MAX_PAIRS`` at most whose common presence goes with the label beyond ``PAIR_Z``
standard deviations, and further than either's own. Its score is

    sigmoid(bias + sum of w[i] + sum over pairs of <v[i], v[j]>)

over the terms that a text holds, so pairs count for more, or for less, than their parts.

It learns from a bounded sample: about ``SAMPLE_EACH`` labelled documents of either label,
chosen by a hash of doc_id among those that are not held out, and weighted so that both
labels keep their shares. Of several labels of a doc_id the greatest counts, and of several
texts the one of least hash. The sample is broadcast to the one scan that finds its texts;
the other documents are never shuffled, and each whole text is read for its score.

Null and empty texts hold no terms and get the bias alone. Null labels are left out, and rows
without doc_id count as held out. Without labels of both kinds the bias is the share of toxic
labels (0 without any). Repeated rows score alike. Other columns are carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, held_out, materialize, scratch, table
from .hashing import blocks, words_and_prefixes

SAMPLE_EACH = 6000
BUCKETS = 1 << 22
PREFIXES = (4, 5, 6, 7)
MAX_TERMS, LEAST_Z, LEAST_TEXTS = 4096, 3.5, 3
PAIR_TERMS, MOST_SHARE, MAX_PAIRS, PAIR_Z, LEAST_PAIRS = 512, 0.6, 256, 6.0, 10
FACTORS, ROUNDS, RATE, DECAY = 4, 300, 0.05, 2e-4


def terms(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, how many, bucket, text): a text's buckets can repeat."""
    for begin, held in blocks(texts):
        h, owner = words_and_prefixes(held, PREFIXES)
        yield begin, len(held), (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), owner


class Machine:
    """Terms (sorted buckets), their weights and factors, and the bias."""

    def __init__(self, buckets: np.ndarray, bias: float):
        self.buckets, self.bias = buckets, bias
        self.w = np.zeros(len(buckets))
        self.v = np.random.Generator(np.random.PCG64(11)).normal(0, 0.05, (len(buckets), FACTORS))
        self._sieve = None

    def raw(self, text: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(sum before the sigmoid, sums of factors) of ``n`` texts, for distinct pairs."""
        total = self.bias + np.bincount(text, self.w[term], n)
        sums = np.stack([np.bincount(text, self.v[term, f], n) for f in range(FACTORS)], 1)
        squares = np.bincount(text, (self.v[term] ** 2).sum(1), n)
        return total + 0.5 * ((sums**2).sum(1) - squares), sums

    def fit(self, text: np.ndarray, term: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Full-batch Adam on the weighted logistic loss."""
        weight = weight / weight.sum()
        parts = [np.zeros(1), self.w, self.v]
        first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        m = len(self.buckets)
        for step in range(1, ROUNDS + 1):
            raw, sums = self.raw(text, term, len(label))
            pull = weight * (1 / (1 + np.exp(-raw)) - label)
            along = pull[text]
            slope_v = np.stack([np.bincount(term, along * (sums[text, f] - self.v[term, f]), m) for f in range(FACTORS)], 1)
            slopes = [np.array([pull.sum()]), np.bincount(term, along, m) + DECAY * self.w / max(m, 1), slope_v + DECAY * self.v / max(m, 1)]
            parts[0][0] = self.bias
            for p, g, a, b in zip(parts, slopes, first, second):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
            self.bias = float(parts[0][0])

    def held(self, bucket: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, term) pairs among a block's buckets."""
        if self._sieve is None:
            self._sieve = np.zeros(BUCKETS, bool)
            self._sieve[self.buckets] = True
        known = self._sieve[bucket]
        pair = np.unique(text[known] * max(len(self.buckets), 1) + np.searchsorted(self.buckets, bucket[known]))
        return np.divmod(pair, max(len(self.buckets), 1))

    def score(self, texts) -> np.ndarray:
        out = np.zeros(len(texts))
        for begin, n, bucket, owner in terms(texts):
            text, term = self.held(bucket, owner)
            raw, _ = self.raw(text, term, n)
            out[begin : begin + n] = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
        return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _distinct_terms(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in parts:
        out = []
        for _, n, bucket, owner in terms(series.tolist()):
            text, b = np.divmod(np.unique(owner * BUCKETS + bucket), BUCKETS)
            out += np.split(b.astype(np.int32), np.searchsorted(text, np.arange(1, n)))
        yield pd.Series(out)


def telling_pairs(text: np.ndarray, term: np.ndarray, label: np.ndarray, m: int) -> np.ndarray:
    """Those of ``m`` terms that tell more of the label in a pair than alone."""
    held = np.zeros((len(label), m), np.float32)
    held[text, term] = 1
    rate = label.mean()
    n, pos = held.T @ held, held[label == 1].T @ held[label == 1]
    z = np.abs(pos - rate * n) / np.sqrt(np.maximum(n, 1) * rate * (1 - rate))
    alone = np.diag(z)
    z[(n < LEAST_PAIRS) | (z < PAIR_Z) | (z <= np.maximum(alone[:, None], alone[None, :]))] = 0
    i, j = np.nonzero(np.triu(z, 1))
    top = np.argsort(-z[i, j], kind="stable")[:MAX_PAIRS]
    return np.union1d(i[top], j[top])


def _sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame | None, dict[int, int]]:
    """A materialized table (doc_id, toxic, terms) to learn from, and the count of each label."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}  # two rows
    if len(sizes) < 2:
        return None, sizes
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    take = F.when(F.col("toxic") == 1, F.lit(SAMPLE_EACH / sizes[1])).otherwise(F.lit(SAMPLE_EACH / sizes[0]))
    chosen = F.broadcast(known.where(part < take))  # about 2 * SAMPLE_EACH rows
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return materialize(texts.select("doc_id", "toxic", _distinct_terms("text").alias("terms")), "sample"), sizes


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine for (doc_id, text) and (doc_id, toxic)."""
    with scratch(docs.sparkSession):
        return _learned(*_sampled(docs, labels))


def _learned(sample: DataFrame | None, sizes: dict[int, int]) -> Machine:
    total = sum(sizes.values())
    if sample is None:
        share = sizes.get(1, 0) / max(total, 1)
        return Machine(np.empty(0, np.int64), float(np.log((share + 1e-3) / (1 - share + 1e-3))) if total else -6.0)
    bias = float(np.log(sizes[1] / sizes[0]))
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Machine(np.empty(0, np.int64), bias)
    rate = n[1] / sum(n.values())
    seen = sample.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos"))
    z = F.abs(F.col("pos") - rate * F.col("n")) / F.sqrt(F.col("n") * rate * (1 - rate))
    seen = materialize(seen.where(F.col("n") >= LEAST_TEXTS).withColumn("z", z), "terms")
    best = [r["term"] for r in seen.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(MAX_TERMS).collect()]
    common = [r["term"] for r in seen.where((F.col("n") >= LEAST_PAIRS) & (F.col("n") <= MOST_SHARE * sum(n.values()))).orderBy(F.desc("n"), "term").limit(PAIR_TERMS).collect()]
    buckets = np.array(sorted({*best, *common}), np.int64)
    if not len(buckets):
        return Machine(buckets, bias)
    wanted = F.from_json(F.lit(str(buckets.tolist())), "array<int>")
    rows = sample.select("doc_id", "toxic", F.array_sort(F.array_intersect("terms", wanted)).alias("terms")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["terms"]))
    label = np.array([r["toxic"] for r in rows], float)
    text = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
    term = np.array([b for r in rows for b in r["terms"]], np.int64)
    pairable = np.array(sorted(common), np.int64)
    both = np.isin(term, pairable)
    paired = pairable[telling_pairs(text[both], np.searchsorted(pairable, term[both]), label, len(pairable))]
    machine = Machine(np.array(sorted({*best, *paired.tolist()}), np.int64), bias)
    used = np.isin(term, machine.buckets)
    if used.any():
        machine.fit(text[used], np.searchsorted(machine.buckets, term[used]), label, np.where(label == 1, sizes[1] / n[1], sizes[0] / n[0]))
    return machine


def scored(docs: DataFrame, machine: Machine, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one column more, and its name: the score from 0 to 1."""
    machine._sieve = None
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in parts:
            yield pd.Series(sent.value.score(series.tolist()))

    (name,) = fresh(docs, "score")
    return docs.withColumn(name, score(F.col(text))), name


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, name = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))
