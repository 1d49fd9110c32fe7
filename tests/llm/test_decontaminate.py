from __future__ import annotations

import random
import re

from newsloom.llm import decontaminate as m


def brute(docs, items, k=5, threshold=0.5):
    words = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    out = {}
    for item, text in items:
        w = words(text)
        if not w:
            continue
        size = min(k, len(w))
        own = {tuple(w[a : a + size]) for a in range(len(w) - size + 1)}
        for doc, body in docs:
            v = words(body)
            there = {tuple(v[a : a + size]) for a in range(len(v) - size + 1)}
            share = len(own & there) / len(own)
            if share >= threshold:
                out[doc, item] = round(share, 6)
    return out


def test_matches_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, prose(rng.choice([1, 2, 4, 6, 15, 40, 60]))) for k in range(80)]
    docs = []
    for d in range(120):
        body = prose(rng.choice([10, 300, 4000])).split()
        for _ in range(rng.randrange(3)):
            words = rng.choice(items)[1].split()
            if rng.random() < 0.4:
                words = words[: max(1, int(len(words) * 0.75))]
            at = rng.randrange(len(body))
            body[at:at] = words
        docs.append((d, " ".join(body)))
    want = brute(docs, items)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in m.contaminated(table, bench).collect()}
    assert len(want) > 100
    assert set(got) <= set(want) and all(want[k] == v for k, v in got.items())
    assert len(got) >= 0.97 * len(want)
    kept = {r.doc_id for r in m.drop_contaminated(table, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_large_benchmarks_take_several_passes(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {tuple(r) for r in m.contaminated(docs, bench).collect()}
    monkeypatch.setattr(m, "PASS_CHARS", 2000)
    assert {tuple(r) for r in m.contaminated(docs, bench).collect()} == whole and whole


def test_odd_rows(spark, odd_docs, no_docs):
    twin = odd_docs.where("doc_id = 1").first().text
    items = [(1, twin), (1, twin), (2, None), (3, ""), (4, "one"), (None, twin), (5, "...")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id) for r in m.contaminated(odd_docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (11, 1), (6, 4), (7, 4)}
    kept = m.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.where("doc_id is null").count() == 2
    assert m.contaminated(no_docs, bench).count() == 0
    assert m.contaminated(odd_docs, bench.limit(0)).count() == 0
    assert m.drop_contaminated(odd_docs, bench.limit(0)).count() == odd_docs.count()
