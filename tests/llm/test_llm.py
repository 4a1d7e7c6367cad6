"""Training-data operators against brute force, and on odd input: nulls, empty and long
texts, repeated rows, ties, empty tables, and columns with clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, graph, language, line_dedup, near_dedup, packing, quality, sharding, suffix_dedup, token_counts, toxicity
from keyloom.llm.byte_bpe import ByteBpe
from keyloom.llm.hashing import blocks, shingles, words

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def sentence(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = ["", None, "   ", "!!! ???", "one", "a b c", "é ß 日本語\n\n\x00 x", "x " * 9000, "\n\n\n", "<|endoftext|> tail  two  spaces \n "]
CLASH = "doc_id long, text string, source string, hits string, score double, answer int, length long, gone int, other int, n_tokens string"


def odd_docs(spark, extra=()):
    texts = [*ODD, *extra]
    rows = [(i, t, "s", "h", 1.0, 2, 3, 4, 5, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, "null key", None, None, None, None, None, None, None, None)], CLASH), texts


def empty_docs(spark):
    return spark.createDataFrame([], CLASH)


# ---- tokens


def test_prefix_counts_are_exact():
    c = token_counts.PrefixCounter(public_tokenizers.path(token_counts.MODEL))
    rng = random.Random(1)
    parts = ["a", " ", "b", "  ", "\n", "é", "Ａ", "<s>", "▁", "the", "ing", "\x00", "日", "\t", "'", "1", "😀", "ß", "　", "er", "on"]
    for _ in range(300):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = [len(c.model.encode(t[:i])) for i in range(len(t) + 1)]
        assert c.count(t) == want[-1]
        assert [c.at(t, i) for i in range(len(t) + 1)] == want
        budget = rng.randint(0, 8)
        assert c.cut(t, budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_byte_bpe_equals_the_library():
    c = ByteBpe(public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(2)
    parts = ["a", " ", "b", "  ", "\n", " \n", "é", "Ａ", "'s", "the", "\x00", "日", "\t", "1", "😀", "\xa0", "<|endoftext|>", "²", ".", ",", "ƻ", "\x85"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        assert c.ids(t) == c.encode_by_library(t), repr(t)


def test_token_counts_on_odd_rows(spark):
    docs, _ = odd_docs(spark)
    got = token_counts.token_counts(docs, public_tokenizers.path(token_counts.MODEL), limit=5)
    assert got.count() == docs.count() and got.schema["n_tokens"].dataType.simpleString() == "string"  # theirs; ours has an underscore
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[0]["_n_tokens"] == by_id[1]["_n_tokens"] == 0 and not by_id[0]["over_limit"]
    assert by_id[7]["over_limit"]
    assert token_counts.token_counts(empty_docs(spark), public_tokenizers.path(token_counts.MODEL)).count() == 0


# ---- packing


def test_minimum_bin_slack_is_feasible_and_tight():
    rng = random.Random(3)
    for _ in range(30):
        counts = collections.Counter(rng.choice([3, 5, 8, 13, 20, 40, 64]) for _ in range(rng.randint(1, 200)))
        made = packing.plan(dict(counts), 64)
        used = collections.Counter()
        for pattern, times in made:
            assert sum(n * k for n, k in pattern.items()) <= 64
            for n, k in pattern.items():
                used[n] += k * times
        assert used == counts
        total = sum(n * k for n, k in counts.items())
        assert sum(t for _, t in made) <= total / 64 * 1.35 + 1


def test_fullest_is_the_best_subset():
    rng = random.Random(4)
    for _ in range(50):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        chosen = packing.fullest(collections.Counter(items), 30)
        top = max(items)
        rest = list(items)
        rest.remove(top)
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums if s + x <= 30 - top}
        assert sum(n * k for n, k in chosen.items()) == top + max(sums)


def test_packing_places_every_piece(spark):
    docs, texts = odd_docs(spark, [sentence(700)])
    path = public_tokenizers.path(packing.TOKENIZER)
    rows = packing.packed(docs, path, capacity=64).collect()
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in places.values():
        end = 0
        for offset, n in sorted(spots):
            assert offset == end
            end += n
        assert end <= 64
    ids = np.frombuffer(ByteBpe(path).encode_by_library(texts[-1]) + bytes(4), "<u4")
    mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == len(texts) - 1)
    assert [m[3] for m in mine] == [zlib.crc32(ids[s : s + n].tobytes()) for _, s, n, _ in mine]
    assert all(n == 64 for _, _, n, _ in mine[1:]) and sum(m[2] for m in mine) == len(ids)
    assert packing.packed(empty_docs(spark), path).count() == 0


# ---- quality


def by_hand(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    three = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = collections.Counter(three)
    covered = {i + j for i, t in enumerate(three) if n[t] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    docs, texts = odd_docs(spark, ["a b c a b c a b c", "x\nx\n x\n# $ % x", sentence(80), "a\x0bb\x0cc\rd\xa0e"])
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == by_hand(t), t
        w = by_hand(t)
        assert got[i]["base_failed"] == (w[0] < 50 or 100 * w[4] > 50 * w[0])
    assert quality.quality(docs).count() == docs.count()
    assert quality.quality(empty_docs(spark)).count() == 0


def test_depleted_documents_are_rejected(spark):
    shared = [sentence(60) for _ in range(2)]
    rows = [(i, f"{shared[0]}\n{shared[1]}\nown {i} words", "h") for i in range(30)]
    rows += [(100 + i, sentence(60) + "\n" + sentence(30), "h") for i in range(60)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(30)) and all(got[100 + i] for i in range(60))


# ---- near duplicates


def edited(text, every, rng):
    w = text.split()
    for i in range(0, len(w), every):
        w[i] = "edit" + str(rng.randint(0, 10**6))
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    base = [sentence(rng.choice([8, 60, 200]), rng) for _ in range(25)]
    texts = list(base)
    for b in base:
        texts += [b, *(edited(b, k, rng) for k in (40, 100, 150))]
    texts += ["", "", None, "!!!", "!!!", "one two", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    sets = []
    for _, held in blocks(texts):
        s, at = shingles(*words(held))
        sets += [s[at[i] : at[i + 1]] for i in range(len(held))]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or len(sets[i]) and len(sets[j]) and decontaminate.similarity(sets[i], sets[j]) >= near_dedup.SIMILARITY:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in range(len(texts))}
    kept = {r["doc_id"] for r in near_dedup.dedup(docs).collect()}
    assert kept == set(got.values())


def test_near_copies_of_a_shared_passage_meet(spark):
    rng = random.Random(31)
    texts, groups = [], []
    for _ in range(3):
        passage = [rng.choice(WORDS) for _ in range(300)]
        first = len(texts)
        texts += [" ".join(passage) + " " + sentence(150, rng) for _ in range(250)]
        for n in range(2):
            edited = list(passage)
            for at in (60 + 90 * n, 105 + 90 * n):
                edited[at] = f"edit{n}"
            texts.append(" ".join(edited))
        groups.append(range(first, len(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    sets = [np.sort(s) for _, held in blocks(texts) for s, at in [shingles(*words(held))] for s in np.split(s, at[1:-1])]
    want = {i: i for i in range(len(texts))}
    for group in groups:
        for i in group:
            for j in range(group[0], i):
                if decontaminate.similarity(sets[i], sets[j]) >= near_dedup.SIMILARITY:
                    old, new = max(want[i], want[j]), min(want[i], want[j])
                    want = {k: new if v == old else v for k, v in want.items()}
    assert sum(want[k] != k for k in want) == 3
    assert got == want


def test_near_dedup_on_odd_rows(spark):
    docs, _ = odd_docs(spark)
    assert near_dedup.classes(docs).count() == docs.count()
    assert near_dedup.dedup(docs).columns == docs.columns
    assert near_dedup.classes(empty_docs(spark)).count() == 0


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r[0]: r[1] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


# ---- repeated bytes


def removed_by_hand(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("group_runs", [1, 2048])
def test_repeated_bytes_equal_brute_force(spark, group_runs):
    rng = random.Random(6)
    passage, other = sentence(70, rng), sentence(50, rng)
    texts = [sentence(rng.randint(5, 60), rng) + passage[rng.randint(0, 40) :] + sentence(20, rng) for _ in range(12)]
    texts += [passage, passage, other + other, "é" * 150, "é" * 260, "", None, "short", passage[:199], passage[:200], "ab" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.dedup_bytes(docs, digest=True, group_runs=group_runs).collect()}
    assert [got[i] for i in range(len(texts))] == removed_by_hand(texts, suffix_dedup.LENGTH)


def test_suffixes_are_sorted():
    rng = np.random.Generator(np.random.PCG64(8))
    data = rng.integers(97, 99, 400, dtype=np.uint8)
    start = np.arange(300)
    group = rng.integers(0, 3, 300)
    s = suffix_dedup.Suffixes(data, start, 60)
    order = s.merge_sort(group)
    raw = data.tobytes()
    assert [(group[i], raw[i : i + 60]) for i in order] == sorted((group[i], raw[i : i + 60]) for i in start)


def test_repeated_bytes_on_odd_rows(spark):
    docs, _ = odd_docs(spark)
    assert suffix_dedup.dedup_bytes(docs).count() == docs.count()
    assert suffix_dedup.dedup_bytes(empty_docs(spark)).count() == 0


# ---- shards


def test_bounded_loads_move_little():
    rng = random.Random(9)
    counts = [rng.randint(0, 9) for _ in range(sharding.CELLS)]
    owner = sharding.owners(16)
    spans = sharding.bounded(counts, owner, 16)
    sizes = collections.Counter()
    for cell, lo, hi, shard, base in spans:
        assert base == sizes[shard]
        sizes[shard] += hi - lo
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == sum(counts)
    at_home = sum(hi - lo for cell, lo, hi, shard, _ in spans if owner[cell] == shard)
    assert at_home > 0.7 * sum(counts)


def test_shards_on_odd_rows(spark):
    docs, texts = odd_docs(spark, [sentence(5) for _ in range(50)])
    rows = sharding.shard(docs).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == docs.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1
    one = {r["doc_id"]: r for r in rows}[6]
    assert one["size"] == len(texts[6].encode()) + 1 and one["text_crc32"] == zlib.crc32(texts[6].encode())
    assert sharding.shard(empty_docs(spark)).count() == 0


# ---- lines


def lines_by_hand(texts):
    seen, out = {}, []
    for k, t in enumerate(texts):
        if t is None:
            out.append(None)
            continue
        ls = t.split("\n")
        solid = [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate(ls) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for w in range(len(solid) - 2):
            at = seen.setdefault(tuple(x for _, x in solid[w : w + 3]), (k, solid[w][0]))
            if at != (k, solid[w][0]):
                gone |= {i for i, _ in solid[w : w + 3]}
        out.append("\n".join(x for i, x in enumerate(ls) if i not in gone))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(10)
    pool = [sentence(4, rng) for _ in range(8)] + ["", " "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(60)] + [None, "", "a", "a\na\na\na\na"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[i] for i in range(len(texts))] == lines_by_hand(texts)


def test_lines_on_odd_rows(spark):
    docs, _ = odd_docs(spark)
    assert line_dedup.dedup_lines(docs).columns == docs.columns and line_dedup.dedup_lines(docs).count() == docs.count()
    assert line_dedup.dedup_lines(empty_docs(spark)).count() == 0


# ---- language


def test_codewords_are_apart():
    for n in (2, 3, 5, 12):
        code = language.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert min(apart[i, j] for i in range(n) for j in range(i)) >= max(1, code.shape[1] // 5)


def test_language(spark):
    rng = random.Random(11)
    parts = {"xx": ["ang", "blo", "sti"], "yy": ["oui", "elle", "eau"], "zz": ["ção", "inho", "lhe"]}
    rows = [(i, " ".join(rng.choice(p) + rng.choice(p) for _ in range(rng.randint(3, 60))), lang) for i, (lang, p) in enumerate(list(parts.items()) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out, name = language.identify(docs, language.train(docs))
    got = out.collect()
    assert sum(r[name]["lang"] == r["lang"] for r in got) / len(got) > 0.98
    odd, _ = odd_docs(spark)
    answers, name = language.identify(odd, language.train(docs))
    assert name not in odd.columns
    by_id = {r["doc_id"]: r[name] for r in answers.collect()}
    assert all(by_id[i]["lang"] == "und" and by_id[i]["score"] == 0 for i in (0, 1, 2, 3, 8))
    none = language.train(empty_docs(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r[name]["lang"] for r in language.identify(odd, none)[0].collect()} == {"und"}


# ---- contamination


def test_hamming_index_is_complete():
    rng = np.random.Generator(np.random.PCG64(12))
    prints = rng.integers(0, 1 << 64, (200, 4), dtype=np.uint64)
    queries = prints.copy()
    for row in queries:
        for bit in rng.choice(256, rng.integers(0, 45), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    q, i = decontaminate.HammingIndex(prints).near(queries)
    want = {(a, b) for a in range(200) for b in range(200) if np.bitwise_count(queries[a] ^ prints[b]).sum() <= decontaminate.RADIUS}
    assert set(zip(q.tolist(), i.tolist())) == want and len(want) > 100


def test_contamination(spark):
    rng = random.Random(13)
    items = [sentence(rng.randint(15, 50), rng) for _ in range(20)] + ["", None]
    clean = [sentence(rng.randint(5, 200), rng) for _ in range(40)]
    dirty = [sentence(rng.randint(0, 60), rng) + "\n" + items[k].replace(" ", ",  ", 1).title() + ". " + sentence(30, rng) for k in range(20)]
    near = [sentence(20, rng) + " " + edited(items[k], 60, rng) for k in range(20) if len(items[k].split()) > 45]
    texts = [*clean, *dirty, *near, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out, hits = decontaminate.contaminated(docs, bench)
    got = {r["doc_id"]: [h["item_id"] for h in r[hits]] for r in out.collect()}
    assert not any(got[i] for i in range(40))
    assert all(k in got[40 + k] for k in range(20))
    assert all(got[60 + k] for k in range(len(near)))
    odd, _ = odd_docs(spark)
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.decontaminate(empty_docs(spark), bench).count() == 0


# ---- toxicity


def test_toxicity_learns_terms_and_pairs(spark):
    rng = random.Random(14)
    rows, labels = [], []
    for i in range(900):
        t, y = sentence(20, rng), 0
        kind = i % 6
        if kind == 0:
            t, y = t + " vilestinks", 1
        elif kind == 1:
            t, y = t + " groupname slurry", 1  # together only
        elif kind == 2:
            t = t + " groupname"
        elif kind == 3:
            t = t + " slurry"
        rows.append((i, t))
        labels.append((i, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (5000, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, known)
    out, name = toxicity.scored(docs, machine)
    got = {r["doc_id"]: r[name] for r in out.collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == labels[i][1] for i in held) / len(held) > 0.97
    odd, _ = odd_docs(spark)
    scored, name = toxicity.scored(odd, machine)
    assert name not in odd.columns and all(0 <= r[name] < 0.5 for r in scored.collect() if not r["text"])
    none = toxicity.train(docs, known.limit(0))
    assert toxicity.scored(empty_docs(spark), none)[0].count() == 0
