from __future__ import annotations

import math
import random
import re
from statistics import NormalDist

import numpy as np

from newsloom.llm import quality_mcd as m


def prose(rng, n, junk=None):
    words = ["".join(rng.choice("aeioulnrstmd") for _ in range(rng.randrange(2, 9))) for _ in range(n)]
    if junk == "upper":
        return " ".join(w.upper() + "!!" for w in words)
    if junk == "marks":
        return " ".join(w + "###" for w in words)
    if junk == "repeat":
        return " ".join(w for w in words[: n // 8] for _ in range(8))
    return " ".join(w + ("." if k % 9 == 0 else "") for k, w in enumerate(words))


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1200):
        junk = rng.choice(["upper", "marks", "repeat"]) if i % 10 == 0 else None
        rows.append((i, prose(rng, rng.randrange(40, 300), junk), "en" if i % 3 else "fr", f"s{i % 4}" if i % 50 else "rare"))
    got = {r.doc_id: r for r in m.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert np.mean([got[i].keep for i in got if i % 10]) > 0.99
    assert np.mean([got[i].keep for i in got if i % 10 == 0]) < 0.05
    assert {r.grp for r in got.values()} >= {'["en","s1"]', '["fr"]', '["en"]'}


def test_labelled_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    out = m.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").agg({"keep": "count"})
    kept = m.query(spark, sf).where("keep").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality").count()
    total, stay = dict(out.collect()), dict(kept.collect())
    assert stay[1] >= 0.99 * total[1] and stay.get(0, 0) <= 0.1 * total[0]


def test_concentration_finds_the_core(spark):
    """Against the classical estimate, which the outliers would carry away."""
    rng = random.Random(2)
    rows = [(i, prose(rng, 120, "marks" if i % 5 == 0 else None), "en", "s") for i in range(500)]
    got = m.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    near = np.array([r.distance for r in got if r.doc_id % 5])
    far = np.array([r.distance for r in got if r.doc_id % 5 == 0])
    assert np.median(near) < 15 and far.min() > 20 * np.median(near)


def test_odd_rows(spark, odd_docs, no_docs):
    out = m.judge(odd_docs)
    assert out.columns == ["doc_id", "grp", "distance", "keep"] and out.count() == odd_docs.count()
    assert out.where("distance is null").count() == 5  # null, null, empty, blank, marks only
    assert out.where("distance is null and keep").count() == 0 and out.where("keep is null").count() == 0
    assert m.judge(no_docs).count() == 0


def statistics_of(text):
    """The five statistics of a text by plain Python, and its number of words."""
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    n, size = len(words), len(text.encode())
    share = lambda test: sum(map(test, text)) / max(1, size)
    mark = lambda c: c.isascii() and not c.isalnum() and not c.isspace()
    x = [math.log(max(0.1, sum(len(w.encode()) for w in words) / max(1, n))), share(lambda c: c.isascii() and c.isupper()) ** 0.5, share(mark) ** 0.5, share(lambda c: c.isascii() and c.isspace()) ** 0.5]
    return [*x, math.log(max(1, len(set(words)))) - 0.8 * math.log(max(1, n))], n


def brute(texts, h=m.H, steps=m.STEPS, bins=40):
    """The squared distances of one group's texts, by numpy over the whole group at once."""
    found = [statistics_of(t) for t in texts]
    x, n = np.array([f[0] for f in found]), np.array([f[1] for f in found])
    centre = np.median(x, axis=0)  # of an odd number
    x = centre + (x - centre) * (n / (n + m.FEW))[:, None]
    spread = np.maximum(1.4826 * np.median(np.abs(x - centre), axis=0), 1e-3)

    def estimate(y):
        mean = y.mean(axis=0)
        return mean, (y - mean).T @ (y - mean) / len(y) + 1e-5 * np.eye(5)

    def distance(fit, y):
        return np.maximum(np.einsum("ni,ij,nj->n", y - fit[0], np.linalg.inv(fit[1]), y - fit[0]), 1e-12)

    cell = lambda d: np.floor(np.log2(d) * bins)
    edge = lambda d, share: np.sort(cell(d))[math.ceil(share * len(d)) - 1]
    z = (x - centre) / spread
    ball = np.maximum((z**2).sum(axis=1), 1e-12)
    fits = [estimate(x[cell(ball) <= edge(ball, h)]), estimate(centre + spread * np.tanh(z))]
    for step in range(steps + 1):
        fits = [estimate(x[cell(d) <= edge(d, h)]) for d in (distance(f, x) for f in fits)]
        if step == steps - 1:
            fits = [min(fits, key=lambda f: round(np.linalg.slogdet(f[1])[1], 9))]
    half = 5 * (1 - 2 / 45) ** 3
    scale = lambda d: 2 ** ((edge(d, 0.5) + 0.5) / bins) / half
    d = distance(fits[0], x)
    limit = 5 * (1 - 2 / 45 + NormalDist().inv_cdf(0.975) * math.sqrt(2 / 45)) ** 3
    last = estimate(x[d <= scale(d) * limit])
    d = distance(last, x)
    return d / scale(d)


def test_distances_match_brute_force(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.randrange(20, 200), rng.choice(["upper", "marks", "repeat"]) if i % 8 == 0 else None), "en", f"s{i % 2}") for i in range(410)]
    rows += [(1000 + i, *rows[0][1:]) for i in range(12)]  # ties
    got = {r.doc_id: r.distance for r in m.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for source in ("s0", "s1"):
        own = [r for r in rows if r[3] == source]
        assert len(own) % 2 == 1
        want = brute([r[1] for r in own])
        assert np.allclose([got[r[0]] for r in own], want, rtol=1e-3, atol=2e-3)
    assert len({got[1000 + i] for i in range(12)} | {got[0]}) == 1


def test_groups_of_null_and_odd_names(spark):
    rng = random.Random(3)
    groups = [("a/b", "c"), ("a", "b/c"), (None, "s"), ("", "s"), ("en", "*"), ("en", None), ("en", "")]
    rows = [(k, prose(rng, 60), *g) for g in groups for k in range(8)]
    got = m.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), min_group=5).select("grp").distinct().collect()
    assert {r.grp for r in got} == {'["a/b","c"]', '["a","b/c"]', '[null,"s"]', '["","s"]', '["en","*"]', '["en",null]', '["en",""]'}
