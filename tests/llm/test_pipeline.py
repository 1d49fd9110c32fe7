from __future__ import annotations

import corpus_pipeline as c
from tests.llm import test_decontaminate, test_line_dedup, test_minhash_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in c.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "decontamination", "sentencepiece"]
    state = {}
    for name, stage in c.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        state[name] = (before, docs)
        assert docs.columns[:5] == COLUMNS
    before, after = ([(r.doc_id, r.text) for r in x.collect()] for x in state["line_dedup"])
    want = {i: t for i, t, gone in test_line_dedup.brute(before) if not gone or t.strip()}
    assert dict(after) == want
    before, after = (dict(x.select("doc_id", "text").collect()) for x in state["minhash_near_dedup"])
    groups = test_minhash_dedup.roots(test_minhash_dedup.brute_pairs(before))
    gone = {i for i, root in groups.items() if i != root}
    assert set(after) >= set(before) - gone and len(set(after) & gone) <= 0.1 * len(gone)
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in state["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {d for d, _ in test_decontaminate.brute(before.items(), items)}
    assert set(after) == set(before) - leaked
    before, after = state["sentencepiece"]
    assert after.count() == before.count() and after.where("not lossless").count() == 0
    labels = dict(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect())
    before, after = ({r.doc_id for r in x.collect()} for x in state["toxicity"])
    assert not [d for d in before - after if labels.get(d) == 0]
    toxic = {d for d, t in labels.items() if t == 1} & before
    assert len(toxic - after) >= 0.5 * len(toxic)  # of eleven labelled ones
    assert {tuple(r) for r in c.run(spark, sf_dir).select("doc_id", "text").collect()} == {tuple(r) for r in docs.select("doc_id", "text").collect()}


def test_odd_rows(spark, sf_dir, odd_docs, no_docs):
    table = odd_docs.select(*COLUMNS)
    for docs, least in ((table, 9), (table.limit(0), 0)):
        for name, stage in c.STAGES:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns[:5] == COLUMNS
        assert docs.count() >= least
        if least:
            assert docs.where("doc_id is null").count() == 2  # rows without an id are never dropped
