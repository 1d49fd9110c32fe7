from __future__ import annotations

import collections
import random
import re

import numpy as np

from newsloom.llm import graph
from newsloom.llm import minhash_dedup as m
from newsloom.llm.textarrays import mix


def bag(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return collections.Counter(tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))) if words else collections.Counter()


def brute_pairs(texts, threshold=0.5):
    bags = {i: bag(t) for i, t in texts.items()}
    ids, found = sorted(bags), []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            union = sum((bags[a] | bags[b]).values())
            if union and sum((bags[a] & bags[b]).values()) / union >= threshold:
                found.append((b, a))
    return found


def roots(pairs):
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for p in pairs for x in p}


def test_signature_is_unbiased():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(30):
        n = int(rng.integers(1, 50))
        value = mix(rng.integers(0, 2**60, size=n).astype(np.uint64)) >> np.uint64(16)
        a = rng.integers(0, 9, size=n)
        b = np.where(rng.random(n) < 0.6, a, rng.integers(0, 40, size=n))
        if not a.any() or not b.any():
            continue
        doc = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
        s = m.signatures(doc, np.r_[value[a > 0], value[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 1500)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert max(map(abs, errors)) < 0.06
    assert abs(np.mean(errors)) < 0.01


def test_overlap_of_packed_multisets():
    import pyarrow as pa

    texts = ["a b c a b c a b c d", "a b c a b c e f g", "q r s t", "a b c a b c a b c d"]
    out = next(m._bags(3)(iter([pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], ["id", "text"])])))
    packed = out.column("bag").to_pylist()
    for i in range(4):
        for j in range(4):
            a, b = bag(texts[i]), bag(texts[j])
            assert abs(m.overlap(packed[i], packed[j]) - sum((a & b).values()) / sum((a | b).values())) < 1e-12


def test_groups_match_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts, n = {}, 0
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    for size in [1] * 60 + [2] * 20 + [5, 30]:
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 200))]
        for _ in range(size):
            copy = [w if rng.random() > rng.choice([0, 0.02, 0.06]) else rng.choice(vocabulary) for w in words]
            texts[n] = " ".join(copy)
            n += 1
    for _ in range(60):  # a passage in common is no near copy
        texts[n] = shared + " " + " ".join(rng.choice(vocabulary) for _ in range(90))
        n += 1
    pairs = brute_pairs(texts)
    got = {r.doc_id: r.keeper_id for r in m.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    together = sum(got.get(a, a) == got.get(b, b) for a, b in pairs)
    assert pairs and together / len(pairs) >= 0.97
    want = roots(pairs)
    assert all(want.get(i) == want.get(k) for i, k in got.items())  # nothing beyond the true groups
    assert all(k < i and k not in got for i, k in got.items())


def sharing(texts, pairs):
    """Those of the pairs that share a band."""
    import pyarrow as pa

    ids = list(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([texts[i] for i in ids])], ["id", "text"])
    keys = {i: set(k) for out in m._sign(m.SHINGLE, m.BANDS, m.ROWS)(iter([batch])) for i, k in zip(out.column("id").to_pylist(), out.column("keys").to_pylist(), strict=True)}
    return [(a, b) for a, b in pairs if keys[a] & keys[b]]


def test_pairs_inside_a_crowd_with_a_hot_passage(spark, monkeypatch):
    rng = random.Random(23)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, texts = words(122), {}
    for k in range(800):
        texts[k] = " ".join(passage + words(80))
    for k in range(0, 240, 2):  # pairs of overlap 0.5 to 0.6
        own, same = words(80), rng.randrange(15, 30)
        texts[1000 + k] = " ".join(passage + own)
        texts[1001 + k] = " ".join(passage + own[:same] + words(80 - same))
    bags = {i: bag(t) for i, t in texts.items() if i >= 1000}
    pairs = [(i, i + 1) for i in range(1000, 1240, 2) if 0.5 <= sum((bags[i] & bags[i + 1]).values()) / sum((bags[i] | bags[i + 1]).values()) < 0.65]
    pairs = sharing(texts, pairs)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.keeper_id for r in m.near_duplicates(table).collect()}
    assert len(pairs) > 80 and all(got.get(a, a) == got.get(b, b) for a, b in pairs)
    monkeypatch.setattr(m, "BLOCK_BYTES", 20_000)  # buckets of several blocks
    assert {r.doc_id: r.keeper_id for r in m.near_duplicates(table).collect()} == got


def test_chains_beyond_the_least_document(spark):
    rng = random.Random(31)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = {}
    for k in range(0, 900, 3):  # the least matches the second, the second the third, the least not the third
        a, b, c, tail = words(95), words(60), words(45), words(48)
        texts[k], texts[k + 1], texts[k + 2] = (" ".join(x) for x in (a + b + words(45), a + b + c, a + words(12) + tail + c))
    bags = {i: bag(t) for i, t in texts.items()}
    alike = lambda i, j: sum((bags[i] & bags[j]).values()) / sum((bags[i] | bags[j]).values()) >= 0.5
    pairs = sharing(texts, [(i, j) for k in range(0, 900, 3) for i, j in ((k, k + 1), (k + 1, k + 2), (k, k + 2)) if alike(i, j)])
    got = {r.doc_id: r.keeper_id for r in m.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert sum(j == i + 1 and j % 3 == 2 for i, j in pairs) > 100 and all(got.get(i, i) == got.get(j, j) for i, j in pairs)


def test_sf_recall(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    pairs = brute_pairs(texts)
    got = {r.doc_id: r.keeper_id for r in m.query(spark, sf_dir).collect()}
    assert sum(got.get(a, a) == got.get(b, b) for a, b in pairs) >= 0.9 * len(pairs)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = {(r.doc_id, r.keeper_id, r.exact) for r in m.near_duplicates(odd_docs).collect()}
    assert rows == {(2, 1, True), (11, 1, False)}
    kept = m.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 3, 4, 5, 6, 7, 8, 9, 10, 12]
    assert m.near_duplicates(no_docs).count() == 0 and m.drop_near_duplicates(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots([(a, b) for a, b in edges if a is not None and a != b])
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
