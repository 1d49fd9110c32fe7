from __future__ import annotations

import numpy as np
import pytest

from newsloom.llm import line_dedup as m
from newsloom.llm.textarrays import mix


def brute(rows, least=1):
    trim = lambda line: line.strip(" \t\r")
    owner = {}
    for i, t in rows:
        if i is not None and t:
            for line in map(trim, t.split("\n")):
                if len(line.encode()) >= least:
                    owner[line] = min(owner.get(line, i), i)
    out = []
    for i, t in rows:
        if i is None or not t:
            out.append((i, t, 0))
            continue
        seen, kept = set(), []
        for line in t.split("\n"):
            key = trim(line)
            if len(key.encode()) >= least:
                if owner[key] != i or key in seen:
                    continue
                seen.add(key)
            kept.append(line)
        gone = len(t.split("\n")) - len(kept)
        out.append((i, "\n".join(kept) if gone else t, gone))
    return sorted(out, key=repr)


def test_perfect_hash_is_minimal_and_survives_packing():
    key = np.unique(mix(np.arange(20_000, dtype=np.uint64)))
    count, first = np.arange(len(key)) % 7 + 2, np.arange(len(key)) * 3
    shard = m.Shard.unpack(m.Shard.build(key, count, first).pack())
    assert sorted(shard.index(key)) == list(range(len(key)))
    known, owner = shard.owner(key)
    assert known.all() and (owner == first).all() and (shard.count[shard.index(key)] == count).all()
    strange = mix(np.arange(10**6, 10**6 + 50_000, dtype=np.uint64))
    assert not shard.owner(strange)[0].any()
    assert not m.Shard.build(key[:0], count[:0], first[:0]).owner(strange)[0].any()


@pytest.mark.parametrize("probe_bytes", [m.PROBE_BYTES, 0])
def test_matches_brute_force(spark, sf_dir, probe_bytes):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in m.dedup_lines(docs, probe_bytes=probe_bytes).collect()), key=repr)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("probe_bytes", [m.PROBE_BYTES, 0])
def test_counts_decide(spark, probe_bytes):
    docs = spark.createDataFrame([(k, f"in three\nin {'two' if k < 2 else k}\n\nshort") for k in range(3)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in m.dedup_lines(docs, probe_bytes=probe_bytes, min_docs=3).collect()}
    assert got == {0: "in three\nin two\n\nshort", 1: "in two\n", 2: "in 2\n"}
    got = {r.doc_id: r.text for r in m.dedup_lines(docs, probe_bytes=probe_bytes, min_bytes=6).collect()}
    assert got == {0: "in three\nin two\n\nshort", 1: "\nshort", 2: "in 2\n\nshort"}


@pytest.mark.parametrize("probe_bytes", [m.PROBE_BYTES, 0])
def test_odd_rows(spark, odd_docs, no_docs, probe_bytes, monkeypatch):
    monkeypatch.setattr(m, "SHARD_KEYS", 2)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted((tuple(r) for r in m.dedup_lines(odd_docs, probe_bytes=probe_bytes).collect()), key=repr)
    assert got == brute(rows)
    kept = m.without_repeated_lines(odd_docs, probe_bytes=probe_bytes)
    assert kept.columns == odd_docs.columns
    assert kept.where("doc_id = 2").count() == 0  # nothing of it was left
    assert kept.where("doc_id in (3, 4, 5) or doc_id is null").count() == 5
    changed = kept.where("doc_id = 12").first()
    assert changed.n_chars == len(changed.text)
    assert m.dedup_lines(no_docs, probe_bytes=probe_bytes).count() == 0
