"""Queries without SQL answer for every key, against plain Python."""

import numpy as np
import pytest

from keyloom import catalog
from keyloom.operators import vectors

DATA = "/root/testdata/sf0.001"


def test_lcs_of_every_part(spark):
    parts = spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", "p_name", "p_type").collect()
    got = {r["key"]: r for r in catalog.queries()["lcs"](spark, DATA).collect()}
    lengths = {r["key"]: r["length"] for r in catalog.queries()["lcs_length"](spark, DATA).collect()}
    assert lengths == {k: r["length"] for k, r in got.items()}
    assert set(got) == {r["p_partkey"] for r in parts}
    for key, a, b in parts:
        before = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(row[j], before[j + 1]))
            before = row
        assert got[key]["length"] == before[-1] == len(got[key]["lcs"])
        for whole in (a, b):
            rest = iter(whole)
            assert all(x in rest for x in got[key]["lcs"])


@pytest.mark.parametrize("blocks", [(256, 4096), (2, 37)])
def test_q8_search_asks_for_every_hundredth_element(spark, monkeypatch, blocks):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(vectors, "ROW_BLOCK", blocks[1])
    rows = [(str(i), v) for i, v in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]

    def q8(v):
        x = np.array(v, np.float64) / np.sqrt(np.sum(np.square(np.array(v, np.float64))))
        return np.floor((x - x.min()) / (x.max() - x.min()) * 127 + 0.5)

    q = {e: q8(v) for e, v in rows}
    want = set()
    for asked in (e for e in q if int(e) % 100 == 0):
        best = sorted((-float(q[asked] @ q[e]), e) for e in q)[:8]
        want |= {(asked, e, n) for n, (_, e) in enumerate(best)}
    got = catalog.queries()["vsim_q8"](spark, DATA).select("query", "element", "n").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 40


def test_digest_of_every_customer(spark):
    import xxhash

    want = {f"cust:{k}": xxhash.xxh3_64_hexdigest(f"{n} {m}".encode()) for k, n, m in spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment").collect()}
    assert {r["key"]: r["digest"] for r in catalog.queries()["digest"](spark, DATA).collect()} == want
