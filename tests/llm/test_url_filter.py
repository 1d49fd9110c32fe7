from __future__ import annotations

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import url_filter as m
from newsloom.llm.textarrays import string_buffers


def brute(glob, text):
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), text, re.S) is not None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc/.?**", max_size=9), min_size=1, max_size=40), st.lists(st.text("abc/.", max_size=14), min_size=1, max_size=20))
def test_automaton_matches_each_glob(globs, texts):
    found = m.ShiftAnd(globs).match(*string_buffers(pa.array(texts)))
    assert found.tolist() == [[brute(g, t) for g in globs] for t in texts]


def test_many_words():
    globs = [f"*{'x' * k}{k}*" for k in range(1, 90)]
    texts = [f"aa{'x' * k}{k}b" for k in range(1, 90)] + ["x" * 5000 + "9"]
    automaton = m.ShiftAnd(globs)
    assert automaton.words > 50
    assert automaton.match(*string_buffers(pa.array(texts))).tolist() == [[brute(g, t) for g in globs] for t in texts]


def test_canonical(spark):
    cases = {
        "HTTP://User:pw@WWW.Example.COM:80//a//b/?utm_source=x&q=1&gclid=3#top": "example.com/a/b?q=1",
        "https://m.host.net/en/25#top": "m.host.net/en/25",
        "host.org": "host.org",
        "https://host.org/?ref=x": "host.org",
        "https://host.org/p?a=1&b=2": "host.org/p?a=1&b=2",
        "": "",
        None: None,
    }
    table = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "n int, url string")
    assert {r.url: r.c for r in table.select("url", m.canonical(table.url).alias("c")).collect()} == cases


def test_odd_rows(spark):
    rows = [(1, "https://spam-farm.example.org/a", "x"), (1, "https://spam-farm.example.org/a", "x"), (None, "http://spam-farm.gov/x/", None), (2, None, "y"), (3, "", "y"), (4, "http://host.net/" + "a" * 100_000 + ".exe", "z"), (5, "http://нет.рф/путь", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, canonical string")
    got = sorted(((r.page_id, r.rules, r.blocked) for r in m.filter_urls(pages).collect()), key=repr)
    assert got == sorted([(1, "spam-host", True), (1, "spam-host", True), (None, "government,spam-host", False), (2, "", False), (3, "", False), (4, "binary", True), (5, "", False)], key=repr)
    assert m.filter_urls(pages.limit(0)).count() == 0
    everything = m.filter_urls(pages, rules=(("all", "*", True), ("none", "", False)))
    assert everything.where("blocked").count() == 5
    assert m.filter_urls(pages, rules=()).where("blocked").count() == 0
