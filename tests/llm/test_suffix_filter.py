"""Windows that cannot be repeated are not sorted, and none that is repeated is lost."""

from collections import Counter
import random

import numpy as np
import pytest

from keyloom.llm import suffix_dedup
from keyloom.llm.anchors import Runs


@pytest.mark.parametrize("length", [32, 33, 40, 200])
def test_only_windows_that_go_on_alike_are_sorted(monkeypatch, length):
    rng = random.Random(4)
    some = lambda letters, n: bytes(rng.choice(letters) for _ in range(n))
    base, docs = [some(b"ab cd", 500) for _ in range(6)], []
    for _ in range(60):
        lo = rng.randrange(300)
        docs.append(some(b"xyz", rng.randrange(99)) + rng.choice(base)[lo : lo + rng.randrange(400)] + some(b"xyz", rng.randrange(99)))
    runs = Runs(docs, length)
    contexts = [docs[t][a : b + length] for t, a, b in zip(runs.text, runs.lo, runs.hi)]
    sort, sizes = suffix_dedup.Suffixes.merge_sort, []
    monkeypatch.setattr(suffix_dedup.Suffixes, "merge_sort", lambda self, group: (sizes.append(len(group)), sort(self, group))[1])
    of, nth, hit, first, _ = suffix_dedup.repeated_windows(contexts, runs.gram.view(np.int64), runs.left, length)
    place = runs.lo[of] + nth
    got = {(int(runs.text[o]), int(at)) for o, at, h in zip(of, place, hit) if h}
    count = Counter(d[i : i + length] for d in docs for i in range(len(d) - length + 1))
    want = {(k, i) for k, d in enumerate(docs) for i in range(len(d) - length + 1) if count[d[i : i + length]] > 1}
    assert got == want
    assert first.sum() == len(count)
    assert len(want) <= sizes[0] <= len(of) and (length < 200 or sizes[0] < 0.6 * len(of))
