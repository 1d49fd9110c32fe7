from __future__ import annotations

import random
import re

import pyarrow as pa

from newsloom.llm import pii_bootstrap as m


def test_seeds():
    kinds = {"ann.lee@mail.example.com": "email", "10.0.0.255": "ip", "10.0.0.256": None, "+1 (974) 555-3436": "phone", "4111111111111111": "card", "4111111111111112": None, "123-45-6789": "ssn", "000-45-6789": None, "9233a8ecf7c5b09fe5949719b6b82bc439e9329b": "secret", "2.0": None, "word": None}
    assert {k: m.seed(k) for k in kinds} == kinds


def test_shapes():
    assert m.shape("a.68@mail7.example.com") == "a.#@a#.a.a"
    assert m.shape("+1 (974) 555-3436") == "+# (#) #-#4"
    assert m.shape("9233a8ecf7c5b09fe594") == "x20"


def test_unseen_identifiers_are_found(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("lorem ipsum dolor sit amet version chapter page".split())
    card = lambda: "".join(rng.choice("0123456789") for _ in range(16))
    docs, want = [], set()
    for d in range(300):
        words = [word() for _ in range(30)]
        value = card()
        words.insert(rng.randrange(31), value + rng.choice(["", ".", "###"]))
        want.add((d, value))
        number = f"AB-{rng.randrange(10**6):06d}" if d % 3 else f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"
        words += ["passport", "number", number]  # an unknown form in a context that seeds share
        words += [f"{rng.randrange(9)}.{rng.randrange(9)}", "edition", f"{rng.randrange(40)}"]
        docs.append((d, " ".join(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = m.extract(table).collect()
    found = {(r.doc_id, r.value) for r in rows}
    assert len(found & want) >= 0.99 * len(want)  # only a tenth of the cards has a right check digit
    texts = dict(docs)
    assert all(texts[r.doc_id][r.start : r.stop] == r.value for r in rows)
    assert not any(re.fullmatch(r"\d\.\d|\d{1,2}", r.value) for r in rows)
    assert any(r.confidence < 1 for r in rows)


def test_planted_kinds_in_the_table(spark, sf_dir):
    rows = m.query(spark, sf_dir).collect()
    got = {(r.doc_id, r.value) for r in rows}
    forms = [r"(?<!\d)\d{16}(?!\d)", r"\d{1,3}(?:\.\d{1,3}){3}", r"\+\d \(\d{3}\) \d{3}-\d{4}", r"(?<=\")[0-9a-fA-F]{40}(?=\")"]
    want = {(r.doc_id, v) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for f in forms for v in re.findall(f, r.text)}
    assert want and want <= got


def test_long_and_many_grouped_identifiers(spark):
    secret, card = "9a" * 128, "41 11 11 11 11 11 11 11"
    ibans = [f"DE{k} 3704 0044 0532 0{k}30 00" for k in range(20, 24)]
    shared = [f"iban number 10.0.0.{k} end" for k in range(1, 60)]
    rows = [f"key {secret} end", f"pay {card} now", "1 2 3 " + "5" * 60 + " 6 7", *(f"iban number {x} end" for x in ibans), *shared]
    got = m.extract(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {(0, "secret", secret), (1, "card", card)} <= {(r.doc_id, r.kind, r.value) for r in got}
    spans = next(m._spans(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([f"to {ibans[0]} 77 end"])], ["id", "doc", "text"])])))
    assert ibans[0] in spans.column("value").to_pylist()


def test_glued_identifiers(spark):
    secret = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
    cases = {"mailto:ann@x.com": ["ann@x.com"], "user=ann@x.com": ["ann@x.com"], "a@x.com,b@y.com": ["a@x.com", "b@y.com"], "10.0.0.1:8080": ["10.0.0.1"], f'token="{secret}"': [secret], "日本ann@mail.example.com語": ["ann@mail.example.com"], "tel:+1 (974) 555-3436;": ["+1 (974) 555-3436"], "ID4111111111111111": ["4111111111111111"], "<b>no:4111 1111 1111 1111,x": ["4111 1111 1111 1111"]}
    rows = [(k, f"é see {x} end") for k, x in enumerate(cases)]
    got = m.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.value) for r in got) == sorted((k, v) for k, want in enumerate(cases.values()) for v in want)
    assert all(dict(rows)[r.doc_id][r.start : r.stop] == r.value for r in got)


def test_odd_rows(spark, no_docs):
    rows = [(1, "mail ann@mail.example.com now", "v"), (1, "mail ann@mail.example.com now", "v"), (2, None, "v"), (3, "", "v"), (None, "x 10.1.2.3", "v"), (4, "7 " * 20_000, "v"), (5, "日本 ann@mail.example.com", "v"), (6, "@ @@ 1" + "9" * 500, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string")
    got = sorted(((r.doc_id, r.start, r.kind, r.value) for r in m.extract(docs).collect()), key=repr)
    assert got == sorted([(1, 5, "email", "ann@mail.example.com"), (5, 3, "email", "ann@mail.example.com"), (None, 2, "ip", "10.1.2.3")], key=repr)
    assert m.extract(no_docs).count() == 0


def scored(spans, accept=m.ACCEPT, pattern=m.PATTERN, support=m.SUPPORT, undecided=m.UNDECIDED):
    """The rounds of extract() over (value, seed, patterns), by plain dictionaries: value -> (kind, confidence)."""
    edges = {(v.lower(), p) for v, _, ps in spans for p in ps}
    taken = {}
    for v, k, _ in spans:
        if k:
            taken[v.lower()] = (min(k, taken.get(v.lower(), (k,))[0]), 1.0)
    while taken:
        fresh, rates = {}, {}
        for p in {p for _, p in edges}:
            values = [v for v, q in edges if q == p]
            kinds = [taken[v][0] for v in values if v in taken]
            weight = undecided if p.startswith("s:") else 1.0
            for k in set(kinds):
                rate = kinds.count(k) / (len(kinds) + weight * (len(values) - len(kinds)))
                if kinds.count(k) >= support and rate >= pattern:
                    rates[p, k] = rate
        for v in {v for v, _ in edges} - taken.keys():
            best = []
            for k in {k for _, k in rates}:
                doubt = 1.0
                for u, p in edges:
                    if u == v and (p, k) in rates:
                        doubt *= 1 - min(rates[p, k], 1 - 1e-9)
                if 1 - doubt >= accept:
                    best.append((-(1 - doubt), k))
            if best:
                fresh[v] = (min(best)[1], -min(best)[0])
        if not fresh:
            break
        taken |= fresh
    return taken


def test_rounds_match_brute_force(spark):
    rng = random.Random(12)
    texts = []
    for k in range(40):
        seed = f"10.0.{rng.randrange(9)}.{rng.randrange(200)}" if k % 2 else f"u{k}@x.org"
        texts += [f"from host {seed} ok", f"from host {rng.choice('zyx')}-{rng.randrange(99)} ok", f"passport no AB-{rng.randrange(10**5):05d} seen", f"page {rng.randrange(90)} of {rng.randrange(90)}"]
    texts += [f"passport no {n} seen" for n in ("123-45-6789", "123-45-6780", "123-45-6781", "123-45-6782", *(f"9{k}0-45-6789" for k in range(6)))] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["id", "doc", "text"])
    spans = [(r["value"], r["seed"], r["patterns"]) for out in m._spans(iter([batch])) for r in out.to_pylist()]
    for params in ({}, {"accept": 0.5, "pattern": 0.3, "support": 2}, {"undecided": 0.5}):
        want = scored(spans, **params)
        got = m.extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **params).collect()
        assert got and all(want[r.value.lower()][0] == r.kind and abs(want[r.value.lower()][1] - r.confidence) < 2e-6 for r in got)
        covered = lambda v: any(v in r.value.lower() for r in got)
        assert all(covered(v) for v in want)
        assert params or len(want) >= 6 + len({v for v, k, _ in spans if k})


def test_null_ids_texts_of_one_id_and_long_words(spark):
    same = "mail ann@mail.example.com now"
    rows = [(None, same), (None, same), (None, same), (1, same), (1, same), (1, "x 10.1.2.3 and bob@mail.example.com"), (2, "w" * 50 + "a ann@x.com"), (3, "w" * 50 + "b ann@x.com")]
    got = [(r.doc_id, r.value) for r in m.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(None, "ann@mail.example.com")] * 3 + [(1, "ann@mail.example.com"), (1, "10.1.2.3"), (1, "bob@mail.example.com"), (2, "ann@x.com"), (3, "ann@x.com")], key=repr)
    assert m.brief("w" * 50 + "a") != m.brief("w" * 50 + "b") and len(m.brief("w" * 999)) < 41 and m.shape("é1" * 90) != m.shape("é1" * 91)


def test_ties_of_kinds_go_by_name(spark):
    rows = [f"ref {v} end" for v in ("10.0.0.1", "10.0.0.2", "10.0.0.3")] + [f"ref {v} end" for v in ("a@x.org", "b@x.org", "c@x.org")] + ["ref q7 end"]
    got = m.extract(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), pattern=0.3, accept=0.3).collect()
    assert {r.kind for r in got if r.value == "q7"} <= {"email"}
