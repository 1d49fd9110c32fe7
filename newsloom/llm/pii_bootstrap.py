"""Personal data by bootstrapped contextual extraction.

Candidates are whitespace-separated tokens with a digit or an @, runs of such tokens, and
what stands inside them between punctuation, at letter/digit borders or for a recogniser.
Seed recognisers name some of them (an address with a valid domain, a card number with a
right check digit, ...). Every candidate has lexical patterns: its own shape, the word or
two words before it with its coarse shape, the word after it. Patterns and instances form
a bipartite graph, scored in rounds by Spark:

* a pattern's confidence in a kind is the share of its instances accepted as that kind;
  instances of other kinds count against it, undecided ones fully for context patterns
  and by UNDECIDED for shapes, which describe the instance itself;
* an instance's confidence in a kind is 1 - prod(1 - confidence) over its patterns.

Instances over the threshold are accepted and support further patterns, so identifiers
that no seed recognises are found by the company and the form they keep.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.textarrays import lean, pieces, string_buffers
from newsloom.session import drop_stored, ship, store

ACCEPT, PATTERN, SUPPORT, UNDECIDED = 0.7, 0.6, 3, 0.02


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})")
_PHONE = re.compile(r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{4}")
_SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}")
_SECRET = re.compile(r"(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]{32,}")


def seed(text: str) -> str | None:
    """The kind of an identifier that is beyond doubt by its form alone, else None."""
    if _EMAIL.fullmatch(text):
        return "email"
    if (m := _IP.fullmatch(text)) and all(int(g) < 256 and (g == "0" or g[0] != "0") for g in m.groups()):
        return "ip"
    if _PHONE.fullmatch(text):
        return "phone"
    if _SSN.fullmatch(text):
        return "ssn"
    digits = re.sub(r"[ -]", "", text)
    if 13 <= len(digits) <= 19 and digits.isdigit() and digits.isascii() and _luhn(digits):
        return "card"
    if _SECRET.fullmatch(text):
        return "secret"
    return None


#: Letters and digits of the longest identifiers that are written in groups (IBAN); the recognisers' own have 19 at most.
LONGEST = 34


def groups(tokens: list[str]) -> Iterator[tuple[int, int]]:
    """(first, last) of the runs of tokens that may be one identifier: up to five, more up to LONGEST letters and digits, and all."""
    for a in range(len(tokens)):
        size = 0
        for b in range(a, len(tokens)):
            size += sum(map(str.isalnum, tokens[b])) if b - a < 5 or size <= LONGEST else 0
            if b - a >= 5 and size > LONGEST:
                break
            yield a, b
    if len(tokens) > 5 and sum(sum(map(str.isalnum, x)) for x in tokens) > LONGEST:
        yield 0, len(tokens) - 1


def _named(text: str) -> str | None:
    """seed(), but more than five groups must be of one length (the last may be shorter)."""
    sizes = [len(x) for x in text.split(" ")]
    return seed(text) if len(sizes) <= 5 or len({*sizes[:-1]}) == 1 and sizes[-1] <= sizes[0] else None


_GLUE = re.compile(r"""[^\s:=,;"'<>|&?!/\\\[\]{}#*~`^$\u3001\u3002\uff0c\uff1a\uff1b]+(?: [^\s:=,;"'<>|&?!/\\\[\]{}#*~`^$\u3001\u3002\uff0c\uff1a\uff1b]+)*""")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_INSIDE = [re.compile(x) for x in (rf"(?<![\d.]){_IP.pattern}(?!\.?\d)", rf"{_PHONE.pattern}(?!\d)", rf"(?<![\d-]){_SSN.pattern}(?![\d-])", r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)", r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}(?![0-9A-Za-z])")]
_DIGITS = re.compile(r"\d(?:[\d.-]*\d)?")


def glued(run: str) -> set[tuple[int, int]]:
    """(start, stop) of candidates that are glued to other text: parts between punctuation, what recognisers find, digits beside letters."""
    found = set()
    parts = [x for x in _GLUE.finditer(run) if x.end() - x.start() < len(run)]
    for part in parts:
        tokens = list(re.finditer(r"\S+", part.group()))
        for a, b in groups([x.group() for x in tokens]):
            lo, hi = part.start() + tokens[a].start(), part.start() + tokens[b].end()
            x, y = _trim(run[lo:hi])
            found.add((lo + x, lo + y))
    for at in (x.start() for x in re.finditer("@", run)):
        lo = at
        while lo and run[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(run, at + 1)):
            found.add((lo, m.end()))
    for form in _INSIDE:
        found.update(x.span() for x in form.finditer(run) if _named(x.group()))
    for token in re.finditer(r"[^\W_]\S*", run):
        if not shape(token.group()).startswith("x") and any(map(str.isalpha, token.group())) and not seed(token.group()):
            found.update((token.start() + x.start(), token.start() + x.end()) for x in _DIGITS.finditer(token.group()))
    return {(a, b) for a, b in found if any(c.isdigit() or c == "@" for c in run[a:b])}


def shape(text: str) -> str:
    """Letters run to `a`, up to three digits to `#`, more to # and their number, long hex to `x`."""
    if re.fullmatch(r"(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z_-]{16,}", text):
        return f"x{len(text)}"
    out = re.sub(r"[^\W\d_]+", "a", text)
    return brief(re.sub(r"\d+", lambda m: "#" if len(m.group()) <= 3 else f"#{len(m.group())}", out), 80)


def brief(text: str, size: int = 40) -> str:
    """text, or for a longer one its beginning and a digest of the whole, so that different texts stay different."""
    return text if len(text) <= size else text[: size - 20] + "~" + hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


_TRIM_LEFT, _TRIM_RIGHT = re.compile(r"^[^\w+(]+"), re.compile(r"[^\w)]+$")


def _trim(text: str) -> tuple[int, int]:
    m = _TRIM_LEFT.match(text)
    lo = m.end() if m else 0
    m = _TRIM_RIGHT.search(text, lo)
    return lo, m.start() if m else len(text)


def _word(text: str) -> str:
    return text[slice(*_trim(text))].lower() or text


def _table(rows: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    row = arrays[0]
    own = [batch.column("id").take(row), batch.column("doc").take(row)]
    return pa.RecordBatch.from_arrays([*own, *arrays[1:]], ["id", "doc", "start", "stop", "value", "seed", "patterns"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    mark = np.zeros(256, np.int64)
    mark[[64, *range(48, 58)]] = 1
    for batch in batches:
        rows: list[tuple] = []
        below = 0
        for part in pieces(batch, "text"):
            base, below = below, below + part.num_rows
            raw, ends = string_buffers(part.column("text"))
            if not len(raw):
                continue
            inside = ~space[raw]
            starts = inside.copy()
            starts[1:] &= ~inside[:-1]
            edge = ends[:-1][np.diff(ends) > 0]
            starts[edge] = inside[edge]
            start = np.flatnonzero(starts)
            stops = inside.copy()
            stops[:-1] &= ~inside[1:]
            last = ends[1:][np.diff(ends) > 0] - 1
            stops[last] = inside[last]
            stop = np.flatnonzero(stops) + 1
            marks = np.r_[0, np.cumsum(mark[raw])]
            wanted = np.flatnonzero(marks[stop] > marks[start])
            if not len(wanted):
                continue
            row_of = np.searchsorted(ends, start[wanted], "right") - 1
            data = raw.tobytes()
            chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
            text = lambda k: data[start[k] : stop[k]].decode("utf-8", "replace")  # noqa: B023, E731
            first_of = np.searchsorted(start, ends)
            k = 0
            while k < len(wanted):
                j = k + 1
                while j < len(wanted) and wanted[j] == wanted[j - 1] + 1 and row_of[j] == row_of[k] and stop[wanted[j - 1]] + 1 == start[wanted[j]] and data[stop[wanted[j - 1]]] == 32:
                    j += 1
                tokens = wanted[k:j]
                row = int(row_of[k])
                lo, hi = first_of[row], first_of[row + 1]
                had = len(rows)
                for a, b in groups([text(t) for t in tokens]):
                    a, b = tokens[a], tokens[b]
                    whole = data[start[a] : stop[b]].decode("utf-8", "replace")
                    x, y = _trim(whole)
                    value = whole[x:y]
                    if not value:
                        continue
                    begin = int(chars[start[a]] - chars[ends[row]]) + x
                    before = _word(text(a - 1)) if a - 1 >= lo else "^"
                    before2 = _word(text(a - 2)) if a - 2 >= lo else "^"
                    after = _word(text(b + 1)) if b + 1 < hi else "$"
                    own = shape(value)
                    coarse = re.sub(r"\d+", "", own)
                    patterns = [f"s:{own}", f"l:{brief(before)}|{coarse}", f"m:{brief(before2)} {brief(before)}|{coarse}", f"r:{brief(after)}|{coarse}"]
                    rows.append((base + row, begin, begin + len(value), value, _named(value), patterns))
                run = data[start[tokens[0]] : stop[tokens[-1]]].decode("utf-8", "replace")
                origin = int(chars[start[tokens[0]]] - chars[ends[row]])
                seen = {(r[1], r[2]) for r in rows[had:]}
                named = {r[1:3] for r in rows[had:] if r[4]}
                head = " ".join(text(t) for t in range(max(lo, tokens[0] - 2), tokens[0]))
                tail = text(tokens[-1] + 1) if tokens[-1] + 1 < hi else "$"
                for x, y in sorted(glued(run)):
                    if (origin + x, origin + y) in seen or any(a <= origin + x and origin + y <= b for a, b in named):
                        continue
                    value = run[x:y]
                    words = ["^", "^", *re.findall(r"\w+", (head + " " + run[max(0, x - 90) : x]).lower())][-2:]
                    after = (re.findall(r"\w+", (run[y : y + 90] + " " + tail).lower()) or ["$"])[0]
                    own = shape(value)
                    coarse = re.sub(r"\d+", "", own)
                    patterns = [f"s:{own}", f"l:{brief(words[1])}|{coarse}", f"m:{brief(words[0])} {brief(words[1])}|{coarse}", f"r:{brief(after)}|{coarse}"]
                    rows.append((base + row, origin + x, origin + y, value, _named(value), patterns))
                if len(rows) > 20_000:
                    yield _table(rows, batch)
                    rows = []
                k = j
        yield _table(rows, batch)


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT, pattern: float = PATTERN, support: int = SUPPORT, undecided: float = UNDECIDED, rounds: int | None = None) -> DataFrame:
    """(doc_id, start, stop, kind, value, confidence): each place of an identifier.

    start and stop are character positions in the text. Of overlapping findings the longest
    stays, then the first. Null and empty texts have none; repeated rows of an id count once,
    but texts of one id that differ are searched each by itself, and so is every row with a null
    id. Of more than five tokens in a row, runs of over LONGEST letters and digits are candidates
    only as a whole. Kinds that tie go by name. rounds: at most so many; without it, until no
    instance is added. No rows or no seeds give no rows; extra columns of any name aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    picked = picked.withColumn("doc", F.when(F.col("id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("text")))
    kind = picked.dtypes[0][1]
    spans, p_spans = store(picked.mapInArrow(lean(_spans), f"id {kind}, doc long, start int, stop int, value string, seed string, patterns array<string>"), "spans")
    edges, p_edges = store(spans.select(F.lower("value").alias("value"), F.explode("patterns").alias("pattern")).distinct(), "edges")
    accepted, p_accepted = store(spans.where("seed is not null").groupBy(F.lower("value").alias("value")).agg(F.min("seed").alias("kind")).withColumn("confidence", F.lit(1.0)), "accepted")
    size = accepted.count()
    total = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    done = 0
    while size and (rounds is None or done < rounds):
        done += 1
        votes = edges.join(accepted, "value").groupBy("pattern", "kind").agg(F.count("*").alias("own"))
        decided = votes.groupBy("pattern").agg(F.sum("own").alias("decided"))
        weight = F.when(F.col("pattern").startswith("s:"), F.lit(undecided)).otherwise(1.0)
        rated = votes.join(decided, "pattern").join(total, "pattern").where(F.col("own") >= support)
        rated = rated.select("pattern", "kind", (F.col("own") / (F.col("decided") + weight * (F.col("n") - F.col("decided")))).alias("rate")).where(F.col("rate") >= pattern)
        doubt = F.exp(F.sum(F.log1p(-F.least("rate", F.lit(1 - 1e-9)))))
        scored = edges.join(rated, "pattern").groupBy("value", "kind").agg((1 - doubt).alias("confidence")).where(F.col("confidence") >= accept)
        order = Window.partitionBy("value").orderBy(F.desc("confidence"), "kind")
        best = scored.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
        fresh = best.join(accepted, "value", "left_anti")
        grown, path = store(accepted.unionByName(fresh), "accepted")
        drop_stored(spark, p_accepted)
        accepted, p_accepted = grown, path
        if (now := grown.count()) == size:
            break
        size = now
    found = spans.withColumn("key", F.lower("value")).join(accepted.withColumnRenamed("value", "key"), "key").select("id", "doc", "start", "stop", "kind", "value", F.round("confidence", 6).alias("confidence")).distinct()
    # the longest of overlapping findings: a finding goes if a longer (or equal, earlier) one covers it
    upto = Window.partitionBy("id", "doc").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    kept = found.withColumn("reach", F.max("stop").over(upto)).where("reach is null or stop > reach").drop("reach", "doc")
    result, _ = store(kept.withColumnRenamed("id", id_col), "pii")  # the result itself
    drop_stored(spark, p_spans, p_edges, p_accepted)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/documents.parquet"))
