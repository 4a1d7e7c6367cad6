"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier for each bit is a logistic regression
over hashed byte trigrams of the lowered text, in which everything but letters counts as
a space. Decoding adds up each bit's logistic loss, weighted by how well the bit was learned,
and takes the codeword with the least; the softmax of the negative losses is the score, and a
lead of less than ``AMBIGUOUS`` over the second is flagged.

The classifiers learn from about ``SAMPLE_PER_LANGUAGE`` labelled documents of each language
at most, and ``SAMPLE`` in all, chosen by a hash of doc_id and text among those that are not
held out; rows that repeat both are learned once. The executors turn whole texts into
histograms, and only these reach the driver. The model is a table of fixed size; scoring
reads each whole text once and shuffles nothing.

Null texts and texts without any letter are ``und`` with score 0. Without any labelled row
every text is ``und``. Rows without doc_id count as held out. Repeated rows get the same
answer each, and of languages that are equally near the first by name. Other columns are
carried as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, held_out, table
from .hashing import blocks

SAMPLE_PER_LANGUAGE, SAMPLE = 400, 8000
AMBIGUOUS = 0.02
UNKNOWN = "und"
BUCKETS = 1 << 13
SCALE = 40.0
ROUNDS, RATE, DECAY = 120, 2.0, 1e-4
#: Up to this many languages every split of them is a bit; beyond, random splits are.
EXHAUSTIVE = 5

_CLASS = np.full(256, 32, np.uint8)
_CLASS[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_HISTOGRAM = T.StructType([T.StructField("at", T.BinaryType()), T.StructField("share", T.BinaryType())])
_ANSWER = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages."""
    if n <= EXHAUSTIVE:
        bits = [[1 if (m >> i) & 1 else -1 for i in range(n)] for m in range(1, max(1 << (n - 1), 2))]
        return np.array(bits, np.float64).T
    rng = np.random.Generator(np.random.PCG64(n))
    length = 15 + 4 * int(np.ceil(np.log2(n)))
    best, least = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, length))
        apart = (length - code @ code.T) / 2 + length * np.eye(n)
        if apart.min() > least and (np.abs(code.sum(0)) < n).all():
            best, least = code, apart.min()
    return best


def histograms(texts) -> Iterator[tuple[int, np.ndarray]]:
    """(index of a text, share of each trigram bucket), for texts with any trigram."""
    for begin, held in blocks(texts):
        for i, b in enumerate(held):
            if b:
                x = _CLASS[np.frombuffer(b" " + b + b" ", np.uint8)].astype(np.uint32)
                gram = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
                at = (gram * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
                blank = (x[:-2] == 32) & (x[1:-1] == 32)
                counts = np.bincount(at[~blank], minlength=BUCKETS)
                yield begin + i, counts / max(counts.sum(), 1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Codes:
    """Languages, their codewords, and a linear classifier for each bit."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray]], langs: list[str]):
        """From (buckets, shares) of each text, and their languages."""
        self.langs = sorted(set(langs))
        self.code = codewords(len(self.langs)) if self.langs else np.zeros((0, 0))
        bits = self.code.shape[1]
        self.weight, self.bias, self.trust = np.zeros((BUCKETS, bits)), np.zeros(bits), np.ones(bits)
        if len(self.langs) < 2:
            return
        x, y = np.zeros((len(found), BUCKETS), np.float32), np.array([self.langs.index(k) for k in langs])
        for i, (at, share) in enumerate(found):
            x[i, at] = share * SCALE
        target = self.code[y].astype(np.float32)
        balance = (1 / np.bincount(y, minlength=len(self.langs)))[y][:, None].astype(np.float32) / len(self.langs)
        w, b = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
        for _ in range(ROUNDS):
            pull = balance * target / (1 + np.exp(target * (x @ w + b)))
            w += RATE * (x.T @ pull - DECAY * w)
            b += RATE * pull.sum(0)
        self.weight, self.bias = w.astype(np.float64), b.astype(np.float64)
        right = ((x @ w + b) * target > 0).mean(0)
        self.trust = np.log(np.maximum(right, 0.5 + 1e-6) / (1 - np.minimum(right, 1 - 1e-3)))
        self.trust = self.trust / self.trust.mean()

    def answer(self, texts) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, False)] * len(texts)
        if not self.langs:
            return out
        for i, h in histograms(texts):
            if has_letter(texts[i]):
                margin = SCALE * h @ self.weight + self.bias
                loss = np.logaddexp(0, -self.code * margin) @ self.trust
                share = np.exp(loss.min() - loss)
                share /= share.sum()
                best = int(share.argmax())
                lead = share[best] - np.partition(share, -2)[-2] if len(share) > 1 else 1.0
                out[i] = self.langs[best], float(share[best]), bool(lead < AMBIGUOUS)
        return out


@F.pandas_udf(_HISTOGRAM)
def _histogram(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for series in parts:
        out = [(b"", b"")] * len(series)
        for i, h in histograms(series.tolist()):
            at = np.flatnonzero(h)
            out[i] = at.astype(np.int32).tobytes(), h[at].astype(np.float32).tobytes()
        yield pd.DataFrame(out, columns=["at", "share"])


def sample(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Histograms and languages to learn from."""
    known = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND t IS NOT NULL").where(~held_out(F.col("k")))
    different = F.approx_count_distinct(F.xxhash64("k", "t"))
    sizes = {r[0]: r[1] for r in known.groupBy("lang").agg(different).collect()}  # a row for each language
    if not sizes:
        return [], []
    each = min(SAMPLE_PER_LANGUAGE, SAMPLE / len(sizes))
    part = F.pmod(F.xxhash64("k", "t", F.lit(8)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    most = F.element_at(F.create_map(*(x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(each / n)))), F.col("lang"))
    chosen = known.where(part < most).dropDuplicates(["k", "t", "lang"])
    rows = chosen.select("lang", F.xxhash64("k", "t").alias("order"), _histogram("t").alias("h")).select("lang", "order", "h.*").collect()  # at most about SAMPLE rows
    rows.sort(key=lambda r: (r["lang"], r["order"], bytes(r["at"])))
    return [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["share"], np.float32)) for r in rows], [r["lang"] for r in rows]


def identify(df: DataFrame, model: Codes, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` with one column more, and its name: struct of lang, score and ambiguous."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_ANSWER)
    def answer(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in parts:
            yield pd.DataFrame(sent.value.answer(series.tolist()), columns=["lang", "score", "ambiguous"])

    (name,) = fresh(df, "answer")
    return df.withColumn(name, answer(F.col(text))), name


def train(df: DataFrame) -> Codes:
    return Codes(*sample(df))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    out, name = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).lang.alias("lang_pred"), F.col(name).score.alias("score"), F.col(name).ambiguous.alias("ambiguous"))
