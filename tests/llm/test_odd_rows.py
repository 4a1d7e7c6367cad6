"""Every operator and stage on odd tables, against brute force on the values: ids that are
null, shared, or strings; repeated rows, very long and empty texts; clashing columns."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from keyloom.llm import decontaminate, language, line_dedup, near_dedup, packing, quality, sharding, suffix_dedup, token_counts, toxicity
from keyloom.llm.common import collected, held_out
from keyloom.llm.hashing import blocks, shingles, words

from .test_llm import by_hand, edited, removed_by_hand, sentence

RNG = random.Random(21)
PASSAGE = sentence(60, RNG)
BASE = [sentence(RNG.choice([12, 70]), RNG) for _ in range(25)]
TEXTS = [*BASE, *BASE[:9], *(edited(b, 60, RNG) for b in BASE if len(b) > 200), *(f"{sentence(9, RNG)}\n{PASSAGE}\n{sentence(5, RNG)}" for _ in range(8))]
TEXTS += ["a\nb\nc\nd\ne", "a\nb\nc\nd\ne", "x\na\nb\nc\nd\ne", "", None, "one", "x " * 30_000 + "\n" + "long line " * 9]

KINDS = ["null ids", "one id and repeated rows", "strings"]


def rows_of(kind):
    n = len(TEXTS)
    ids = {"null ids": [None] * n, "one id and repeated rows": [7] * n, "strings": [f"u{i:03}" for i in range(n)]}.get(kind, list(range(n)))
    rows = list(zip(ids, TEXTS))
    return rows + rows[::3] if "repeated" in kind else rows


@pytest.fixture(params=KINDS)
def rows(request):
    return rows_of(request.param)


def frame(spark, rows, more="hits string, gone int, size int, spots int, a long, prefixes int, lang string, source string, n_chars long, cell int"):
    kind = "string" if any(isinstance(k, str) for k, _ in rows) else "long"
    blank = [None] * (more.count(",") + 1)
    return spark.createDataFrame([(k, t, *blank) for k, t in rows], f"doc_id {kind}, text string, {more}")


def key(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


def test_repeated_bytes(spark, rows):
    got = [tuple(r) for r in suffix_dedup.dedup_bytes(frame(spark, rows), digest=True, group_runs=1).collect()]
    want = [(k, *r) for (k, _), r in zip(rows, removed_by_hand([t for _, t in rows], suffix_dedup.LENGTH))]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_lines(spark, rows):
    """The first place is the least (id, text's identity); rows that repeat both are one."""
    df = frame(spark, rows)
    order = {(r[0], r[1]): (r[0] is not None, r[0] or 0, r[2], r[3]) for r in df.select("doc_id", "text", *line_dedup.identity(df["text"])).collect()}
    first, solid = {}, {}
    for row in set(rows):
        ls = (row[1] or "").split("\n")
        solid[row] = [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate(ls) if x.strip(" \t\r\x0b\x0c")]
        for w in range(len(solid[row]) - 2):
            window, place = tuple(x for _, x in solid[row][w : w + 3]), (order[row], solid[row][w][0])
            first[window] = min(first.get(window, place), place)
    want = []
    for row in rows:
        gone = set()
        for w in range(len(solid[row]) - 2):
            if first[tuple(x for _, x in solid[row][w : w + 3])] != (order[row], solid[row][w][0]):
                gone |= {i for i, _ in solid[row][w : w + 3]}
        want.append((row[0], None if row[1] is None else "\n".join(x for i, x in enumerate(row[1].split("\n")) if i not in gone)))
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    assert sorted((tuple(r) for r in out.select("doc_id", "text").collect()), key=key) == sorted(want, key=key)


def classes_by_hand(rows):
    texts = [t or "" for _, t in rows]
    sets = [s[at[i] : at[i + 1]] for _, held in blocks(texts) for s, at in [shingles(*words(held))] for i in range(len(held))]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if texts[i] == texts[j] or len(sets[i]) and len(sets[j]) and decontaminate.similarity(sets[i], sets[j]) >= near_dedup.SIMILARITY:
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return list(groups.values())


def test_near_duplicates(spark, rows):
    df = frame(spark, rows)
    want = []
    groups = classes_by_hand(rows)
    for group in groups:
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        want += [(rows[i][0], min(ids) if ids else None) for i in group]
    got = [tuple(r) for r in near_dedup.classes(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    out = near_dedup.dedup(df)
    assert out.columns == df.columns
    kept = {(r["doc_id"], r["text"] or "") for r in out.collect()}  # a null text is an empty one
    assert len(kept) == len(groups) and all(len(kept & {(rows[i][0], rows[i][1] or "") for i in g}) == 1 for g in groups)


def test_shards(spark, rows):
    got = sharding.shard(frame(spark, rows)).collect()
    want = collections.Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_quality(spark, rows):
    got = [tuple(r)[:6] for r in quality.quality(frame(spark, rows)).collect()]
    want = [(k, *by_hand(t)) for k, t in rows]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_packing(spark, rows):
    path = public_tokenizers.path(packing.TOKENIZER)
    got = packing.packed(frame(spark, rows), path).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in bins.values():
        end = 0
        for offset, n in sorted(spots):
            assert offset == end
            end += n
        assert end <= packing.CAPACITY
    assert sum(r["piece"] == 0 for r in got) == len(rows)


def test_token_counts(spark, rows):
    path = public_tokenizers.path(token_counts.MODEL)
    model = token_counts.counter(path).model
    df = frame(spark, rows)
    got = [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(df, path, limit=40).collect()]
    want = [(k, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 40) for k, t in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    out, name = token_counts.prefix_counts(df, path)
    assert name not in df.columns
    for r in out.select("text", name).collect():
        for end, n in list(zip(r[1]["ends"], r[1]["tokens"]))[:200:7]:
            assert n == len(model.encode(r[0][:end]))


def test_contamination(spark, rows):
    bench = spark.createDataFrame([("p", PASSAGE), (None, BASE[0]), ("none", None), ("", "")], "item_id string, text string")
    df = frame(spark, rows)
    out, hits = decontaminate.contaminated(df, bench)
    got = [(r["doc_id"], r["text"], tuple(h["item_id"] for h in r[hits])) for r in out.collect()]
    first = {BASE[0], *(t for t in TEXTS if t and BASE[0] in t)}
    for k, t, found in got:
        assert ("p" in found) == bool(t and PASSAGE in t)
        assert t not in first or None in found
    assert decontaminate.decontaminate(df, bench).count() == sum(not f for _, _, f in got)


@pytest.mark.parametrize("kind", ["null ids", "repeated rows with numbers"])
def test_stages(spark, tmp_path, kind):
    folder = f"{tmp_path}/in"
    rows = rows_of(kind)
    labelled = [(1000 + i, " ".join(RNG.choice(p) for _ in range(40)), lang) for i, (lang, p) in enumerate([("xx", ["ang", "blo", "sti"]), ("yy", ["oui", "elle", "eau"])] * 40)]
    spark.createDataFrame([(k, t, lang, "s", len(t)) for k, t, lang in labelled], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = frame(spark, rows)
    by = dict(corpus_pipeline.STAGES)
    every = collections.Counter(rows)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
        if name == "language_id":
            assert got and not got - every and all(t and any(map(str.isalpha, t)) for _, t in got)
        elif name == "decontamination":
            assert got == collections.Counter(r for r in rows if not (r[1] and PASSAGE in r[1]))
        elif name == "near_dedup":
            assert not got - every and len({(k, t or "") for k, t in got}) == len(classes_by_hand(rows))
        assert stage(spark, docs.limit(0), folder).count() == 0
    packed = by["packing"](spark, docs, folder)
    assert packed.where("piece = 0").count() == len(rows) and by["packing"](spark, docs.limit(0), folder).count() == 0


# ---- claims about movement, recall and pruning


def moved(before, after):
    return sum(a != b for a, b in zip(before, after)) / len(before)


def test_shards_move_little_when_they_change():
    """Rows by cell and rank: 16 to 17 shards, and one row in a hundred more."""
    rng = random.Random(22)
    counts = [rng.randint(30, 60) for _ in range(sharding.CELLS)]

    def homes(counts, shards):
        out = {}
        for cell, lo, hi, shard, _ in sharding.bounded(counts, sharding.owners(shards), shards):
            out |= {(cell, r): shard for r in range(lo, hi)}
        return out

    old, new = homes(counts, 16), homes(counts, 17)
    assert sum(old[r] != new[r] for r in old) / len(old) < 2 / 17
    assert sum(old[r] != new[r] != 16 for r in old) / len(old) < 0.06
    grown = homes([c + (rng.random() < 0.45) for c in counts], 16)
    assert sum(old[r] != grown[r] for r in old) / len(old) < 0.02


def test_a_row_of_very_many_copies_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEAT_ROWS", 50)
    monkeypatch.setattr(sharding, "PART_ROWS", 20)
    df = spark.range(1000).selectExpr("if(id % 2 = 0, null, id) AS cell", "if(id % 2 = 0, if(id % 3 = 0, 'x', cast(id as string)), 'y') AS text")
    got = sharding.shard(df, key="cell").collect()
    slots = collections.defaultdict(set)
    for r in got:
        slots[r["shard"]].add(r["slot"])
    assert len(got) == 1000 and all(s == set(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 1000


def test_windows_within_similarity_are_found():
    """Recall against all item-sized windows, at 0.8 or more, over several sorts of edits."""
    rng = random.Random(23)
    pool = [f"w{i}" for i in range(3000)]
    items = [[rng.choice(pool) for _ in range(rng.randint(3, 200))] for _ in range(250)]
    texts = []
    for item in items:
        w, how = list(item), rng.choice("sidteb")
        at = rng.randrange(len(w))
        for _ in range(max(1, int(len(w) * rng.choice([0.01, 0.02, 0.03])))):
            if how == "s":
                w[rng.randrange(len(w))] = rng.choice(pool)
            elif how == "i":
                w.insert(rng.randrange(len(w) + 1), rng.choice(pool))
            elif how == "d" and len(w) > 1:
                w.pop(rng.randrange(len(w)))
        if how == "t":
            w = w[: int(len(w) * rng.uniform(0.88, 1))]
        elif how == "e":
            w = w[int(len(w) * rng.uniform(0, 0.12)) :]
        elif how == "b":
            for j in range(at, min(len(w), at + len(w) // 20 + 1)):
                w[j] = rng.choice(pool)
        pad = [[rng.choice(pool) for _ in range(rng.choice([0, 40]))] for _ in range(2)]
        texts.append(" ".join(pad[0] + w + pad[1]))
    index = decontaminate.Items([" ".join(i) for i in items])
    got = index.search(texts)
    want = []
    for i, t in enumerate(texts):
        (_, held), = blocks([t])
        s, _ = shingles(*words(held))
        own = index.shingles[i]
        best = max(decontaminate.similarity(s[a : a + len(own)], own) for a in range(max(len(s) - len(own), 0) + 1))
        if best >= decontaminate.SIMILARITY:
            want.append(i)
    assert len(want) > 150
    assert sum(i in dict(got[i]) for i in want) / len(want) >= 0.99
    assert not [1 for i, hits in enumerate(got) for j, _ in hits if j != i]


def test_the_index_prunes():
    rng = np.random.Generator(np.random.PCG64(24))
    prints, queries = (rng.integers(0, 1 << 64, (1000, 4), dtype=np.uint64) for _ in range(2))
    assert len(decontaminate.HammingIndex(prints).candidates(queries)) < 0.01 * 1000 * 1000


# ---- learned operators


def test_pairs_that_tell_nothing_alone(spark):
    """A text is toxic if it holds both words or neither, so each word by itself says nothing."""
    rng = random.Random(25)
    rows = []
    for i in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(["qqgroup"] * a + [sentence(12, rng)] + ["zzinsult"] * b), int(a == b)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    machine = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    out, name = toxicity.scored(docs, machine)
    got = {r["doc_id"]: r[name] for r in out.collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == y for i, _, y in held) / len(held) > 0.95


def test_shared_and_missing_ids_are_learned_once(spark):
    """A label of an id that a third of all rows share brings one text; null ids bring none."""
    rows = [(7, f"common {i} words") for i in range(300)] + [(None, "lost " * 5)] * 50 + [(i, "vile " * 3 if i % 2 else sentence(4, RNG)) for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 0), (7, 1), (None, 1)] + [(i, i % 2) for i in range(100, 400)], "doc_id long, toxic int")
    with collected() as paths:
        sample, sizes = toxicity._sampled(docs, labels)
        assert sample.where("doc_id = 7").count() == 1 and sample.where("doc_id IS NULL").count() == 0
        assert sum(sizes.values()) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (7, *range(100, 400)))
    assert len(paths) == 1
    flags = docs.select(held_out(docs["doc_id"]).alias("h"), "doc_id").distinct().collect()
    assert all(r["h"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in flags)


def test_language_sample_is_bounded_and_made_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_PER_LANGUAGE", 40)
    rows = [(7, "angblo sti " * 3, "xx")] * 900 + [(None, "nobody", "xx")] * 50 + [(i, sentence(6, RNG), "xx") for i in range(300)] + [(1000 + i, "oui elle " + sentence(3, RNG), "yy") for i in range(300)]
    found, langs = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    n = collections.Counter(langs)
    assert 15 < n["xx"] < 90 and 15 < n["yy"] < 90 and len(found) == len(langs)
    assert all(abs(share.sum() - 1) < 1e-4 for _, share in found)
