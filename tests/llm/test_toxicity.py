from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from newsloom.llm import toxicity as m
from newsloom.llm.textarrays import Words


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))]
        toxic = int(rng.random() < 0.15)
        if toxic:
            for _ in range(rng.randrange(3, 7)):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "stinker", "grimling", "grimhead", "louse"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(3000, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:2000]], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in m.classify(docs, labels).collect()}
    held = rows[2000:]
    caught = [got[i] for i, _, y in held if y]
    clean = [got[i] for i, _, y in held if not y]
    assert np.mean(caught) > 0.95 and np.mean(clean) < 0.01
    kept = {r.doc_id for r in m.drop_toxic(docs, labels).collect()}
    assert kept == {i for i, x in got.items() if not x}


def test_risk_falls_below_the_naive_one():
    rows = corpus(800, 2)
    features = [np.unique(np.concatenate([v for _, v in m.features(Words(pa.array([t])))])) for _, t, _ in rows]
    positive = [f for f, (_, _, y) in zip(features, rows, strict=True) if y]
    model = m.fit(positive, features, len(positive) / len(rows))
    scores = model.scores(Words(pa.array([t for _, t, _ in rows])))
    y = np.array([y for _, _, y in rows])
    assert ((scores > 0) == (y == 1)).mean() > 0.97
    assert 0 < len(model.words) < 200


def test_scores_match_brute_force():
    rows = corpus(300, 3)
    features = [np.unique(np.concatenate([v for _, v in m.features(Words(pa.array([t])))])) for _, t, _ in rows]
    model = m.fit([f for f, r in zip(features, rows, strict=True) if r[2]], features, 0.15, min_docs=3)
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    want = [model.bias + sum(weight.get(v, 0.0) for v in f.tolist()) for f in features]
    assert np.allclose(model.scores(Words(pa.array([t for _, t, _ in rows]))), want)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (3, 0, "y"), (4, None, "y"), (None, 1, "z"), (99, 1, "z")], "doc_id long, toxic int, text string")
    out = m.classify(odd_docs, labels)
    assert out.columns == ["doc_id", "score", "toxic"] and out.count() == odd_docs.count()
    assert out.where("toxic is null or score is null").count() == 0
    assert m.drop_toxic(odd_docs, labels).columns == odd_docs.columns
    assert m.classify(no_docs, labels).count() == 0 and m.drop_toxic(no_docs, labels).count() == 0
    assert m.classify(odd_docs, labels.limit(0)).where("toxic").count() == 0


def brute_fit(positive, unlabelled, prior, rounds, rate, min_docs):
    """fit() over dense vectors and by its written formulas, one document after another."""
    everything = [*positive, *unlabelled]
    count = {}
    for d in everything:
        for v in d.tolist():
            count[v] = count.get(v, 0) + 1
    words = sorted(v for v, n in count.items() if n >= min_docs)
    x = np.array([[float(v in set(d.tolist())) for v in words] for d in everything])
    p, u = x[: len(positive)], x[len(positive) :]
    w, b = np.zeros(len(words)), np.log(prior / (1 - prior))
    penalty, loose = prior / (2 * np.sqrt(len(p))), np.ones(len(words))
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    loss = lambda g: np.log1p(np.exp(-np.clip(g, -30, 30)))
    for step in range(2 * rounds):
        if step == rounds:
            penalty, loose = 0.0, (w != 0).astype(float)
        gp, gu = p @ w + b, u @ w + b
        on_negatives = loss(-gu).mean() - prior * loss(-gp).mean()
        # gradients of prior * E_P[l(g)] and of E_U[l(-g)] - prior * E_P[l(-g)]
        own = -prior * (1 - sigmoid(gp)) / len(p)
        dp, du = -prior * sigmoid(gp) / len(p), sigmoid(gu) / len(u)
        dp, du = (own + dp, du) if on_negatives >= 0 else (-dp, -du)
        if step >= rounds:
            w = w * (1 - rate * prior / len(p))
        w = w - rate * loose * (p.T @ dp + u.T @ du)
        b = b - rate * (dp.sum() + du.sum())
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * penalty)
    ranked = sorted(u @ w + b, reverse=True)
    b -= max(0.0, ranked[min(len(ranked) - 1, int(prior * len(ranked)))])
    return {v: k for v, k in zip(words, w, strict=True) if k}, b


def test_fit_matches_brute_force():
    rows = corpus(160, 5)
    features = [np.unique(np.concatenate([v for _, v in m.features(Words(pa.array([t])))])) for _, t, _ in rows]
    positive = [f for f, r in zip(features, rows, strict=True) if r[2]]
    # with the larger prior the risk on negatives would go below 0; where it hovers around 0 for many
    # steps (0.15 over 60 rounds), rounding decides some of them, and the two part by 1e-5
    for prior, rounds, close in ((0.05, 60, 1e-10), (0.15, 20, 1e-10), (0.4, 60, 1e-10), (0.15, 60, 1e-3)):
        model = m.fit(positive, features, prior, rounds=rounds, min_docs=4)
        weights, bias = brute_fit(positive, features, prior, rounds, 1.5, 4)
        assert weights and set(model.words.tolist()) == set(weights)
        assert np.allclose(model.weights, [weights[v] for v in model.words.tolist()], atol=close) and abs(model.bias - bias) < close


def test_query_is_the_model_over_the_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows, model = docs.collect(), m.train(docs, labels)
    want = model.scores(Words(pa.array([r.text for r in rows])))
    got = {r.doc_id: r for r in m.query(spark, sf_dir).collect()}
    assert len(got) == len(rows) and any(r.toxic for r in got.values())
    assert all(abs(got[r.doc_id].score - s) < 1e-5 and got[r.doc_id].toxic == (s > 0) for r, s in zip(rows, want, strict=True))
