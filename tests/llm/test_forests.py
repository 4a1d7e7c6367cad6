"""Components: a graph of few links takes no passes, and one in parts has the same components."""

import random

import pytest

from keyloom.llm import graph


def links():
    rng = random.Random(5)
    name = rng.sample(range(-(10**15), 10**15), 900)
    chain = [(name[i], name[i + 1]) for i in range(299)]
    star = [(name[300], name[i]) for i in range(301, 500)]
    rest = [(name[rng.randrange(500, 900)], name[rng.randrange(500, 900)]) for _ in range(250)]
    out = chain + star + rest + rest[:20] + [(name[7], name[7])]
    rng.shuffle(out)
    return out


def least(edges):
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = top(u), top(v)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root if top(x) != x}


@pytest.mark.parametrize("part", [40, 1 << 19])
def test_components_in_parts_and_in_one(spark, monkeypatch, part):
    monkeypatch.setattr(graph, "PART_LINKS", part, raising=False)
    made = []
    materialize = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, what: made.append(what) or materialize(df, what))
    edges = links()
    rows = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["root"] for r in rows} == least(edges)
    if part > len(edges):
        assert len(made) <= 2  # the links and their forest; each pass would be one more


def test_no_links(spark):
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []
    assert graph.components(spark.createDataFrame([(3, 3)], "u long, v long")).collect() == []
