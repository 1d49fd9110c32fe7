from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from newsloom.llm import ppm_score as m
from newsloom.llm.textarrays import string_buffers


def brute(corpus, text, order):
    """Code length of text under a trie of nested dictionaries counted over corpus."""
    nodes = {}
    for t in corpus:
        past = bytes(order)
        for b in t:
            for o in range(order + 1):
                node = nodes.setdefault(past[order - o :], {})
                node[b] = node.get(b, 0) + 1
            past = (past + bytes([b]))[1:]
    bits, past = 0.0, bytes(order)
    for b in text:
        out = set()
        for o in range(order, -1, -1):
            seen = nodes.get(past[order - o :])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in out}
            if left:
                total = sum(left.values()) + len(left)
                if b in left:
                    bits += math.log2(total / left[b])
                    break
                bits += math.log2(total / len(left))
            out |= set(seen)
        else:
            bits += math.log2(256 - len(out))
        past = (past + bytes([b]))[1:]
    return bits


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_pretrained_matches_brute_force(order):
    rng = random.Random(order)
    corpus = ["".join(rng.choice("abcab é") for _ in range(rng.randrange(200))) for _ in range(15)]
    texts = corpus[:3] + ["".join(rng.choice("abcdexyz é日") for _ in range(80)) for _ in range(6)] + ["", "q"]
    raw, ends = string_buffers(pa.array(corpus))
    trie = m.Trie(*m._merged(m.grams(raw, ends, order), np.ones(len(raw), np.int64)), order)
    raw, ends = string_buffers(pa.array(texts))
    total = np.r_[0, np.cumsum(trie.lengths(m.grams(raw, ends, order)))]
    want = [brute([c.encode() for c in corpus], t.encode(), order) for t in texts]
    assert np.allclose(total[ends[1:]] - total[ends[:-1]], want, atol=1e-4)


def test_code_lengths_sum_to_one():
    rng = random.Random(9)
    text = "".join(rng.choice("abcd ") for _ in range(300))
    raw, ends = string_buffers(pa.array([text]))
    trie = m.Trie(*m._merged(m.grams(raw, ends, 2), np.ones(len(raw), np.int64)), 2)
    for context in (b"ab", b"zz", b"a ", b"za", bytes(2)):
        key = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs((2.0 ** -trie.lengths(key)).sum() - 1) < 1e-5


def test_adaptive_is_decodable_in_principle():
    assert m.adaptive_bits(b"", 3) == 0
    assert m.adaptive_bits(b"a", 3) == 8
    rng = random.Random(1)
    assert m.adaptive_bits(b"abc" * 200, 3) < 0.2 * m.adaptive_bits(bytes(rng.randrange(256) for _ in range(600)), 3)


def counted(corpus, order):
    """Nested dictionaries of all contexts, and the code length of a text under them."""
    nodes = {}
    for t in corpus:
        past = bytes(order)
        for b in t:
            for o in range(order + 1):
                node = nodes.setdefault(past[order - o :], {})
                node[b] = node.get(b, 0) + 1
            past = (past + bytes([b]))[1:]
    return nodes


def test_table(spark, sf_dir):
    """All documents: as each byte was seen in its longest context, none escapes."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in m.query(spark, sf_dir).collect()}
    nodes = counted([x.text.encode() for x in rows], m.ORDER)
    for r in rows:
        raw, past, bits = r.text.encode(), bytes(m.ORDER), 0.0
        for b in raw:
            seen = nodes[past]
            bits += math.log2((sum(seen.values()) + len(seen)) / seen[b])
            past = (past + bytes([b]))[1:]
        assert got[r.doc_id].n_bytes == len(raw)
        assert abs(got[r.doc_id].bits - bits) < max(2e-3, 2e-7 * bits)


def test_trie_keeps_all_counts_of_all_orders(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trie = m.train(docs)
    nodes = counted([r.text.encode() for r in docs.collect()], m.ORDER)
    for o in range(m.ORDER + 1):
        want = {int.from_bytes(c + bytes([b]), "big"): n for c, seen in nodes.items() if len(c) == o for b, n in seen.items()}
        assert dict(zip(trie.keys[o].tolist(), trie.count[o].tolist(), strict=True)) == want


def test_scores_keep_all_nodes_however_many(spark, sf_dir, odd_docs, no_docs, monkeypatch):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), odd_docs, no_docs):
        full = sorted((tuple(r) for r in m.score(docs).collect()), key=repr)
        for chunk in (m.CHUNK, 100_000):
            monkeypatch.setattr(m, "CHUNK", chunk)
            got = sorted((tuple(r) for r in m.score(docs, max_nodes=0).collect()), key=repr)
            assert [r[:2] for r in got] == [r[:2] for r in full]
            assert np.allclose([r[2] for r in got], [r[2] for r in full], atol=0.002)


def test_odd_rows(spark, odd_docs, no_docs):
    out = m.score(odd_docs)
    assert out.columns == ["doc_id", "n_bytes", "bits", "bits_per_byte"] and out.count() == odd_docs.count()
    blank = out.where("n_bytes = 0").collect()
    assert len(blank) == 3 and all(r.bits == 0 and r.bits_per_byte is None for r in blank)
    small = odd_docs.where("length(text) < 2000 or text is null")
    again = m.score(small, adaptive=True).collect()
    assert [r.bits for r in again] == [round(m.adaptive_bits((r.text or "").encode()), 3) for r in small.collect()]
    assert m.score(no_docs).count() == 0 and m.score(no_docs, adaptive=True).count() == 0
