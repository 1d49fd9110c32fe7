from __future__ import annotations

import heapq
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import token_codec as m


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=60))
def test_lengths_are_optimal_and_a_prefix_code(counts):
    counts = np.array(counts)
    lengths = m.code_lengths(counts, 40)
    used = lengths > 0
    assert (used == (counts > 0)).all()
    if used.sum() > 1:
        assert (lengths * counts).sum() == huffman_cost(counts)
        assert (2.0 ** -lengths[used].astype(float)).sum() == 1
    limited = m.code_lengths(counts, 6)
    assert limited.max() <= 6 and (2.0 ** -limited[used].astype(float)).sum() <= 1
    codes = m.canonical(limited)
    words = sorted(format(c, f"0{n}b") for c, n in zip(codes[used], limited[used], strict=True))
    assert all(not b.startswith(a) for a, b in zip(words, words[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=70), min_size=1, max_size=8), st.integers(1, 9))
def test_round_trip_from_every_checkpoint(blocks, step):
    ids = np.array([i for b in blocks for i in b], np.int64)
    sizes = np.array([len(b) for b in blocks])
    counts = np.bincount(ids, minlength=301) ** 3
    codec = m.Codec(m.code_lengths(counts, 12))
    raw, length, bits, local = codec.encode(ids, sizes)
    assert length.sum() == len(raw) and (length == -(-bits // 8)).all()
    base, at = np.cumsum(length) - length, 0
    for b, n in enumerate(sizes):
        for k in range(0, n, step):
            got = codec.decode(raw, np.array([8 * base[b] + local[at + k]]), np.array([min(step, n - k)]))
            assert got.tolist() == blocks[b][k : k + step]
        at += n


def test_limits():
    with pytest.raises(ValueError):
        m.code_lengths(np.ones(20, int), 4)
    assert m.code_lengths(np.zeros(4, int)).tolist() == [0] * 4
    assert m.code_lengths(np.array([0, 9, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        m.Codec(np.array([1, 0])).encode(np.array([1]), np.array([1]))


@pytest.mark.skipif(not os.path.exists(m.VOCABULARY), reason="no vocabulary file")
def test_tables(spark, sf_dir, odd_docs, no_docs):
    tokenizer = m.tokenizer()
    for docs, block_ids in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), 100), (odd_docs, 1000)):
        blocks = m.encode_corpus(docs, block_ids=block_ids, checkpoint=16)
        assert blocks.where("not verified").count() == 0
        rows = m.decode_corpus(blocks).orderBy("doc_id", "block").collect()
        got = {}
        for r in rows:
            got.setdefault(r.doc_id, []).extend(r.token_ids)
        for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
            want = tokenizer.encode_ordinary(r.text or "")
            assert got[r.doc_id] == want * (2 if r.doc_id == 2 and block_ids == 1000 else 1)
    empty = m.encode_corpus(no_docs)
    assert [r.block for r in empty.collect()] == [-1] and m.decode_corpus(empty).count() == 0


@pytest.mark.skipif(not os.path.exists(m.VOCABULARY), reason="no vocabulary file")
def test_blocks_describe_themselves(spark):
    tokenizer = m.tokenizer()
    texts = {1: "the first corpus " * 30, 2: "xylophone", 3: None}, {11: "another corpus, other counts", 12: "the the the"}
    parts = [m.encode_corpus(spark.createDataFrame(list(t.items()), "doc_id long, text string"), checkpoint=k) for t, k in zip(texts, (4, 7), strict=True)]
    both = parts[0].union(parts[1]).union(parts[0].where("block = -1"))
    got = {r.doc_id: r.token_ids for r in m.decode_corpus(both).collect()}
    assert got == {i: tokenizer.encode_ordinary(t or "") for x in texts for i, t in x.items()}
    with pytest.raises(ValueError):
        m.decode_corpus(parts[0].where("block >= 0"))
    with pytest.raises(ValueError):
        m.decode_corpus(parts[0].where("block >= 0").union(parts[1]))
    assert m.decode_corpus(both.limit(0)).count() == 0
