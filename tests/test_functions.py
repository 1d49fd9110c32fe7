"""Expression library: the known cases, and properties against plain Python."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import dates, texts, urls
from newsloom.functions.trigram import similarity
from newsloom.operators import cooldown, jobs, sampling
from newsloom.streaming.machines import advance


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("url", "want"), [
    ("http://www.beispiel.ua//texte/stueck/?utm_source=tg#comments", "https://beispiel.ua/texte/stueck"),
    ("https://beispiel.ua/texte/stueck?print=1&utm_medium=social", "https://beispiel.ua/texte/stueck?print=1"),
    ("https://www.beispiel.ua/texte/%D0%B9%D0%BE%D1%88/", "https://beispiel.ua/texte/%D0%B9%D0%BE%D1%88"),
    ("https://beispiel.ua:8443/a/../b/", "https://beispiel.ua:8443/b"), ("HTTP://BEISPIEL.ua:80/", "https://beispiel.ua"),
    ("ftp://beispiel.ua/x", None), ("not a url", None), ("", None), (None, None), ("http://[bad", None),
])
def test_normalize(url, want):
    assert urls.normalize(url) == want


def test_normalize_relative_and_idempotent():
    assert urls.normalize("/texte/stueck/?utm_source=x", "http://www.beispiel.ua/texte/stueck#comments") == "https://beispiel.ua/texte/stueck"
    for u in ("http://a.b/c//d?x=1&y=", "https://a.b/%7Euser/ü"):
        assert urls.normalize(urls.normalize(u)) == urls.normalize(u)


def test_jvm_and_python_identities_agree(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert pages.where(~urls.normalize_udf("url").eqNullSafe(urls.normalize_simple(F.col("url")))).count() == 0


def test_remote_safety():
    bad = ["http://localhost/x", "http://127.0.0.1/", "http://10.1.1.1/", "https://[::1]/", "file:///etc/passwd", None, "http://a.localhost/"]
    assert not any(map(urls.safe_remote, bad))
    assert urls.safe_remote("https://beispiel.ua/i.png") and urls.safe_remote("http://8.8.8.8/")


@pytest.mark.parametrize(("text", "want"), [
    ("2026-06-02T09:35:00+03:00", dt.datetime(2026, 6, 2, 6, 35)), ("2026-06-02 18:49:39", dt.datetime(2026, 6, 2, 15, 49, 39)), ("2026-06-02T10:00:00Z", dt.datetime(2026, 6, 2, 10)),
    ("15 квітня 2021 р. 13:55", dt.datetime(2021, 4, 15, 10, 55)), ("Tue, 02 Jun 2026 09:35:00 +0300", dt.datetime(2026, 6, 2, 6, 35)), ("Tue, 2 Jun 2026 09:35:00 GMT", dt.datetime(2026, 6, 2, 9, 35)),
    ("31 лютого 2021", None), ("soon", None), ("", None), (None, None),
])
def test_dates(spark, text, want):
    assert one(spark, dates.first_parseable([F.lit(text).cast("string")])) == want


def test_first_parseable_skips_what_nobody_understands(spark):
    assert one(spark, dates.first_parseable([F.lit("yesterday"), F.lit("2024-01-05")])) == dt.datetime(2024, 1, 4, 22)


def test_naive_zone_depends_on_the_path(spark):
    assert one(spark, dates.iso_utc(F.lit("2026-06-02 12:00:00"), "UTC")) == dt.datetime(2026, 6, 2, 12)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("abcдєж ,.-1", max_size=14), st.text("abcдєж ,.-1", max_size=14)), min_size=1, max_size=20))
def test_trigram_similarity(spark, pairs):
    def grams(t):
        return {f"  {w} "[k : k + 3] for w in re.split(r"[\W_]+", t.lower()) if w for k in range(len(w) + 1)}

    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string").select("k", similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in rows:
        a, b = map(grams, pairs[r.k])
        assert r.s == pytest.approx(len(a & b) / len(a | b) if a | b else 0.0)


def test_trigram_known_value(spark):
    assert one(spark, similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(4 / 11)


@settings(max_examples=30, deadline=None)
@given(st.integers(7, 500), st.integers(3, 9))
def test_lifecycle_positions(spark, n, limit):
    want = list(dict.fromkeys([0, n - 1] + [round(i * (n - 1) / (limit - 1)) for i in range(1, limit - 1)]))
    assert one(spark, sampling.lifecycle_positions(F.lit(n), limit)) == want


def test_samples(spark):
    rows = sampling.placed(spark.range(100).withColumn("key", F.lit(1)), "key", [F.col("id")])
    assert [r.id for r in sampling.lifecycle(rows, 6).orderBy("id").collect()] == [0, 20, 40, 59, 79, 99]
    dozen = sampling.placed(spark.range(12).withColumn("key", F.lit(1)), "key", [F.col("id")])
    assert [r.id for r in sampling.first_latest(dozen, 6).orderBy("id").collect()] == [0, 1, 2, 9, 10, 11]


def test_retry_delays(spark):
    rows = spark.range(1, 5).select(jobs.retry_delay(F.col("id").cast("int")).alias("d")).collect()
    assert [r.d.total_seconds() / 60 for r in rows] == [1, 5, 15, 15]


CASES = [
    ([(0, None)], (300, 1, "ambiguous_short")), ([(0, None), (600, None)], (4200, 2, "ambiguous_long")), ([(0, None), (600, None), (600 + 960, None)], (4200, 1, "ambiguous_short")),
    ([(0, 120)], (120, 0, "provider_short")), ([(0, 1800)], (1800, 0, "provider_long")), ([(0, None), (60, 120), (100, None)], (400, 1, "ambiguous_short")), ([(0, 7200), (60, None)], (7200, 1, "ambiguous_short")),
]


def test_cooldowns(spark):
    rows = [(f"s{k}", at, retry) for k, (seen, _) in enumerate(CASES) for at, retry in seen]
    got = {r.scope: (r.resume, r.ambiguous_count, r.cooldown_kind) for r in cooldown.fold(spark.createDataFrame(rows, "scope string, at long, retry_after long")).collect()}
    assert got == {f"s{k}": want for k, (_, want) in enumerate(CASES)}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9000), st.one_of(st.none(), st.integers(1, 5000))), min_size=1, max_size=15, unique_by=lambda x: x[0]))
def test_cooldown_fold_is_the_state_machine(spark, seen):
    state = (None, 0, None, "")
    for at, retry in sorted(seen):
        state = advance(state, at, retry)
    r = cooldown.fold(spark.createDataFrame([("s", *x) for x in seen], "scope string, at long, retry_after long")).first()
    assert (r.resume, r.ambiguous_count, r.cooldown_kind) == (state[0], state[1], state[3])


def test_texts(spark):
    assert one(spark, texts.classifier_text(F.lit(" T "), F.lit(" body "))) == "T\n\nbody"
    assert one(spark, texts.classifier_text(F.lit(None).cast("string"), F.lit("body"))) == "body"
    assert one(spark, texts.retrieval_text(F.lit(" a "), F.lit(None).cast("string"), F.lit(" "), F.lit("b"))) == "a\nb"
    assert one(spark, texts.clamp(F.lit("one, two, three"), 9)) == "one, two" and one(spark, texts.clamp(F.lit("one,"), 9)) == "one,"
    assert [one(spark, texts.plural(F.lit(n), "справа", "справи", "справ")) for n in (1, 2, 5, 11, 12, 21, 104, 111)] == ["справа", "справи", "справ", "справ", "справ", "справа", "справи", "справ"]
    assert texts.page_window(5, 10) == [1, None, 4, 5, 6, None, 10] and texts.page_window(1, 1) == [1] and texts.page_window(3, 4) == [1, 2, 3, 4]
    assert one(spark, texts.has_marker(F.lit("Це МОЖЛИВО вплине"))) and not one(spark, texts.has_marker(F.lit("так")))
    with pytest.raises(Exception, match="empty text"):
        one(spark, texts.prefixed("query", F.lit(" ")))
    assert one(spark, texts.quality_flags(F.lit(" "), F.lit("читайте також реклама cookie"))) == ["title_missing", "text_short", "contaminated"]


def test_partial_dates(spark):
    p = lambda t, k: dates.partial(F.lit(t).cast("string"), F.lit(k))
    assert tuple(one(spark, p("2024-05", "month"))) == (2024, 5, None, "month")
    assert tuple(one(spark, p("2024-05-07", "year"))) == (2024, None, None, "year") and tuple(one(spark, p(None, "unknown"))) == (None, None, None, "unknown")
    assert not one(spark, dates.conflicts(p("2024", "year"), p("2024-05", "month"))) and one(spark, dates.conflicts(p("2024-06", "month"), p("2024-05-01", "day")))
    assert tuple(one(spark, dates.enrich(p("2024", "year"), p("2024-05-07", "day")))) == (2024, 5, 7, "day")
    assert one(spark, dates.partial_text(p("2024-05", "month"))) == "2024-05"
    assert [one(spark, dates.infer_precision(F.lit(t))) for t in ("2024", "2024-05", "2024-05-07", "May")] == ["year", "month", "day", "unknown"]
    now = F.lit("2026-06-02 06:00:00").cast("timestamp_ntz")
    assert [one(spark, dates.retry_after_seconds(F.lit(t), now)) for t in ("30", "0", "Tue, 02 Jun 2026 06:01:00 GMT", "soon")] == [30, 1, 60, None]


def test_scratch_folder(spark, monkeypatch):
    import types

    from newsloom import session

    path = session.scratch_dir(spark)
    assert path == session.scratch_dir(spark) and ":/" in path or path.startswith("/")
    cluster = types.SimpleNamespace(sparkContext=types.SimpleNamespace(getConf=dict, applicationId="a", master="spark://host:7077"), conf={})
    with pytest.raises(RuntimeError):
        session.scratch_dir(cluster)
