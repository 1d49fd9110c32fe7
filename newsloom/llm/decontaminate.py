"""Benchmark decontamination: test items found inside documents many times their size.

MinHash containment search with size partitions: documents are put in partitions of
doubling shingle counts, and each partition has its own one-permutation MinHash, whose
number of bins follows the partition's size, so that a document has about one shingle
a bin however long it is. An item is sketched once for every partition with that
partition's bins; a document is its candidate where their minima agree in a bin. Of an
item's shared shingles at least 0.43 are expected to be bin minima of the document, so
half of an item of ten shingles is missed with a probability of 0.06, and a whole one
of 0.004; items of up to SHORT shingles are looked up by all their shingles. Candidates
are verified by exact containment: the share of an item's shingles that the document has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.names import whole_ids
from newsloom.llm.textarrays import U64, Words, lean, multisets, pieces, shingles
from newsloom.session import ship

SHINGLE, THRESHOLD, SHORT = 5, 0.5, 12
#: Items whose index is sent to the workers at once (by the characters of their texts);
#: a larger benchmark is searched in several passes over the documents.
PASS_CHARS = 4_000_000
_FILTER_BITS = 20


class Index:
    """Sketches of items with one shingle size, by partition."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.values = [v for _, v in items]
        every = np.concatenate(self.values)
        owner = np.repeat(np.arange(len(items)), [len(v) for v in self.values])
        short = np.array([len(v) <= SHORT for v in self.values])[owner]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(every & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        self.short = self._sorted(every[short], owner[short])
        self.all = self._sorted(every[~short], owner[~short])
        self.by_part = []
        longest = max((len(v) for v in self.values), default=1)
        # with 16 bins a shingle nearly every shingle is a minimum: finer partitions all use the last table
        for part in range(min(40, int(longest).bit_length() + 5)):
            bins = every >> U64(48 - part)
            order = np.lexsort((every, bins, owner))
            o, b = owner[order], bins[order]
            least = order[np.r_[True, (o[1:] != o[:-1]) | (b[1:] != b[:-1])]]
            least = least[~short[least]]
            self.by_part.append(self._sorted(every[least], owner[least]))

    @staticmethod
    def _sorted(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(value, kind="stable")
        return value[order], owner[order]

    def search(self, doc: np.ndarray, value: np.ndarray, rows: int) -> list[tuple[int, int, float]]:
        """(row, item index, containment) of candidates, from sorted multisets()."""
        maybe = np.flatnonzero(self.filter[(value & U64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        if not len(maybe):
            return []
        edge = np.searchsorted(doc, np.arange(rows + 1))
        part = np.frexp(np.maximum(1, np.diff(edge)))[1] - 1  # 2 ** part <= size
        pairs: set[tuple[int, int]] = set()

        def match(at: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> None:
            lo, hi = np.searchsorted(keys[0], value[at], "left"), np.searchsorted(keys[0], value[at], "right")
            for k in np.flatnonzero(hi > lo):
                row = int(doc[at[k]])
                pairs.update((row, int(i)) for i in keys[1][lo[k] : hi[k]])

        match(maybe, self.short)
        parts = part[doc[maybe]]
        bins = value[maybe] >> (U64(48) - parts.astype(U64))
        before = np.maximum(maybe - 1, 0)
        least = (maybe == edge[doc[maybe]]) | (value[before] >> (U64(48) - parts.astype(U64)) != bins)
        for p in np.unique(parts[least]):
            match(maybe[least & (parts == p)], self.by_part[p] if p < len(self.by_part) else self.all)
        found = []
        for row, item in sorted(pairs):
            own, wanted = value[edge[row] : edge[row + 1]], self.values[item]
            at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            found.append((row, item, float((own[at] == wanted).mean())))
        return found


def build(items: list[tuple[int, str]], size: int) -> dict[int, Index]:
    """Indexes by shingle size: `size`, and fewer words for items shorter than that."""
    grouped: dict[int, list[tuple[int, np.ndarray]]] = {}
    words = Words(pa.array([t for _, t in items], pa.string()))
    for (item, text), n in zip(items, words.count, strict=True):
        if n:
            k = int(min(size, n))
            _, value, _ = multisets(*shingles(Words(pa.array([text])), k))
            grouped.setdefault(k, []).append((item, value))
    return {k: Index(v) for k, v in grouped.items()}


def _hits(piece: pa.RecordBatch, text: str, indexes: dict[int, Index], threshold: float) -> Iterator[tuple[int, int, float]]:
    """(row, item, containment) of the rows of a batch."""
    words = Words(piece.column(text))
    for k, index in indexes.items():
        doc, value, _ = multisets(*shingles(words, k))
        for row, item, share in index.search(doc, value, piece.num_rows):
            if share >= threshold:
                yield row, index.ids[item], share


def _search(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, items, shares = [], [], []
            for piece in pieces(batch, "text"):
                own = piece.column("id").to_numpy(zero_copy_only=False)
                for row, item, share in _hits(piece, "text", shared.value, threshold):
                    ids.append(int(own[row]))
                    items.append(item)
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(shares, pa.float64())], ["id", "item", "share"])

    return run


def _keep(shared, threshold: float, text: str, id_at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                clean = np.ones(piece.num_rows, bool)
                clean[[row for row, _, _ in _hits(piece, text, shared.value, threshold)]] = False
                yield piece.filter(pa.compute.or_(pa.array(clean), pa.compute.is_null(piece.column(id_at))))

    return run


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, shingle: int) -> Iterator[Broadcast]:
    """Indexes of the items, one after another, of about PASS_CHARS of text each."""
    spark = benchmark.sparkSession
    bench = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null").distinct()
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, math.ceil(chars / PASS_CHARS))
    for k in range(passes):
        mine = bench.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k) if passes > 1 else bench
        yield spark.sparkContext.broadcast(build([(r["item"], r["text"]) for r in mine.collect()], shingle))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, containment) of documents that hold at least `threshold` of an item.

    Containment is the share of an item's distinct word shingles found in the document,
    rounded to 6 places. Items shorter than a shingle are searched with shingles of their
    own length; items and documents without a word (null, empty) match nothing; rows with
    a null id are left out. Repeated rows of a document or an item count as one, with the
    largest containment. No documents or no items give no rows; extra columns of any name aren't
    read; ids that aren't whole numbers are a TypeError.
    """
    whole_ids(docs, id_col)
    whole_ids(benchmark, item_col)
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    found = None
    for shared in _indexes(benchmark, item_col, item_text_col, shingle):
        hits = base.mapInArrow(lean(_search(shared, threshold)), "id long, item long, share double")
        found = hits if found is None else found.union(hits)
    return found.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(F.round(F.max("share"), 6).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows in which contaminated() finds an item; judged row by row, without a join.

    Rows with a null id and texts without a word (null, empty) stay, repeated rows go or stay
    together; no items: all stay; no rows: none. All columns pass, whatever their names.
    """
    whole_ids(docs, id_col)
    whole_ids(benchmark, item_col)
    ship(docs.sparkSession)
    for shared in _indexes(benchmark, item_col, item_text_col, shingle):
        docs = docs.mapInArrow(lean(_keep(shared, threshold, text_col, id_col)), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM b),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, round(count(*)::DOUBLE / any_value(n.n), 6) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*)::DOUBLE / any_value(n.n) >= 0.5
"""
