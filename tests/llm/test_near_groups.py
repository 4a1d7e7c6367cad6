"""A large group of near copies: no link is lost, and those that lie outside of the group's
component are not compared with all of it."""

import random

import numpy as np

from keyloom.llm import near_dedup
from keyloom.llm.decontaminate import similarity
from keyloom.llm.hashing import blocks, shingles, words


def test_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"word{rng.randint(0, 10**6)}" for _ in range(150)]
    texts = [" ".join(base)]
    for n in range(400):
        copy = list(base)
        for at in rng.sample(range(5, 145, 10), rng.choice([1, 2, 2, 3, 3, 3, 4])):
            copy[at] = f"edit{n}at{at}"
        texts.append(" ".join(copy))
    sets = [np.sort(s) for _, held in blocks(texts) for s, at in [shingles(*words(held))] for s in np.split(s, at[1:-1])]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if want[i] != want[j] and similarity(sets[i], sets[j]) >= near_dedup.SIMILARITY:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if v == old else v for v in want]
    compared = []
    materialize = near_dedup.materialize

    def counted(df, what):
        out = materialize(df, what)
        if what in ("tried", "missed"):
            compared.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert got == dict(enumerate(want))
    assert 1 < len(set(want)) < 100
    assert sum(compared) < 2 * len(texts)
