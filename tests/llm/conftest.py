"""Tables that every operator must take: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random

import pytest

ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, key long, lead long, band int, rank int, value string, toxic boolean, score double, decoded string, __toxic string, __score string, __id string, __own string, __dropped string, __emptied string, __keys string, __gone string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(n))
    twin = prose(60)
    texts = [(1, twin), (2, twin), (2, twin), (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (7, "one two"), (None, twin), (None, None), (8, prose(30_000)), (9, "x" * 50_000), (10, "!!! ??? ..."), (11, twin + " tail"), (12, "日本語 テキスト\nline two of the text here\r\n" * 3)]
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else "src", None if t is None else len(t), k, k, k, k, 1, "v", True, 0.5, *["n"] * 9) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, ODD_COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD_COLUMNS)
