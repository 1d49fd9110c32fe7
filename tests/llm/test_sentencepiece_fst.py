from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import sentencepiece_fst as m

if not os.path.exists(m.MODEL):
    pytest.skip("no vocabulary file", allow_module_level=True)

import sentencepiece  # noqa: E402

LIB = sentencepiece.SentencePieceProcessor(model_file=m.MODEL)
FST = m.Transducer(m.read_model(m.MODEL))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abet hinro  \n▁é日.-10'"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_are_the_library_s(text):
    assert FST.encode(text) == LIB.encode(text)
    assert FST.decode(LIB.encode(text)) == text.replace("▁", " ")


@pytest.mark.parametrize("text", ["", " ", "  ", "\n", "a  b", " lead", "trail ", "▁▁a", "😀😀", "    def f(x):\n        return x", "x" * 300, "Ünïcode ﬁ Å\t\x00"])
def test_cases(text):
    assert FST.encode(text) == LIB.encode(text)


def test_memo_limit(monkeypatch):
    monkeypatch.setattr(m, "MEMO_BYTES", 60)
    small = m.Transducer(m.read_model(m.MODEL))
    text = "many different words are longer than the memo of three runs " * 3
    for _ in range(3):
        assert small.encode(text) == LIB.encode(text)
        assert 0 < small.memo.nbytes + small.memo_ids.nbytes + 8 * len(small.memo) < 200
    monkeypatch.setattr(m, "ARCS", 16)
    tiny = m.Transducer(m.read_model(m.MODEL))
    assert tiny.encode(text) == LIB.encode(text) and tiny.arcs.used <= 16


def test_columns_share_runs():
    texts = ["a b  c", None, "", "a b", "b\na ▁b", "日本語 a", "a b"] * 3
    ids, counts = FST.encode_column(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in LIB.encode(t or "")]
    assert counts.tolist() == [len(LIB.encode(t or "")) for t in texts]
    assert FST.decode_column(ids, counts).to_pylist() == [(t or "").replace("▁", " ") for t in texts]


def test_arcs_are_two_piece_texts():
    rng = random.Random(1)
    texts = sorted(FST.vocab)
    some = [rng.choice(texts) for _ in range(6000)] + [t for t in texts if set(t) == {"▁"}] * 4
    pairs = [(s, t) for s, t in zip(some, rng.sample(some, len(some)))] + [(t[:k], t[k:]) for t in some for k in range(1, len(t)) if t[:k] in FST.vocab and t[k:] in FST.vocab]
    before, piece = (np.array([FST.vocab[p[k]] for p in pairs]) for k in (0, 1))
    assert FST.weigh(before, piece).tolist() == [FST._merge(s + t)[0] == [s, t] for s, t in pairs]


@pytest.mark.parametrize("text", ["x" * 30_000, "日本語のテキスト" * 2_000, "ab" * 2_000 + "é" * 2_000, "=" * 999 + "\n" + "-" * 5_000, " " * 3_000 + "a"])
def test_long_runs(text):
    assert FST.encode(text) == LIB.encode(text)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in m.query(spark, sf_dir).collect():
        assert r.token_ids == LIB.encode(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) and r.decoded == texts[r.doc_id]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = m.encode_decode(odd_docs).collect()
    texts = [r.text or "" for r in odd_docs.collect()]
    assert [r.token_ids for r in rows] == [LIB.encode(t) for t in texts]
    assert [r.decoded for r in rows] == texts
    added = m.add_tokens(odd_docs)
    assert added.columns == [*odd_docs.columns, "token_ids", "n_tokens", "lossless"]
    assert added.where("not lossless").count() == 0 and added.count() == odd_docs.count()
    assert m.encode_decode(no_docs).count() == 0 and m.add_tokens(no_docs).count() == 0
    back = m.decode(m.encode_decode(odd_docs).drop("decoded")).collect()
    assert [r.decoded for r in back] == texts


def test_names_and_bytes(spark):
    docs = spark.sql("SELECT 1L AS doc_id, 'a b' AS text, 'x' AS decoded, 'y' AS id, 'z' AS lossless UNION ALL SELECT NULL, cast(X'61FF62' AS string), NULL, NULL, NULL")
    added = m.add_tokens(docs)
    assert added.columns == ["doc_id", "text", "decoded", "id", "token_ids", "n_tokens", "lossless"]
    rows = sorted(added.collect(), key=lambda r: r.doc_id or 0)
    assert rows[1].decoded == "x" and rows[1].lossless and rows[1].token_ids == LIB.encode("a b")
    assert rows[0].token_ids == LIB.encode("a\ufffdb")
    assert sorted(r.decoded for r in m.encode_decode(docs).collect()) == ["a b", "a\ufffdb"]


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(m.read_model(m.MODEL))
    proto.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        m.Transducer(proto.SerializeToString())
