"""Near-duplicate documents: weighted MinHash bands, then exact multiset overlap.

A document is the multiset of its word shingles. Its signature follows the
BagMinHash idea: every (shingle, weight level) owns a Poisson process of points, a
point carries a time and a component, and a component's value is its earliest point
among the levels the document's weights reach. Levels form dyadic blocks [0,1), [1,2),
[2,4), ...; a block is one process whose points are assigned inside it by further
bits, so a weight of w costs log2(w) processes. A document stops generating at a time
by which all components are very likely filled, and starts again with twice the time
if they aren't; later points can't change a minimum, so the result is exact.
Two signatures agree at a component with probability sum(min) / sum(max) of the
weights, without bias.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from newsloom.llm.graph import components
from newsloom.llm.names import fresh, whole_ids
from newsloom.llm.textarrays import U64, Words, binary_array, lean, list_array, mix, mix_int, multisets, pieces, shingles
from newsloom.session import drop_stored, ship, store

SHINGLE, BANDS, ROWS, THRESHOLD = 3, 50, 5, 0.5
#: Up to so many candidate ids are sent to all executors to pick their texts; beyond it they are joined.
BROADCAST_IDS = 1_000_000
#: Packed multisets of a bucket that are compared in one piece; a larger bucket is cut into blocks, and all pairs of blocks are compared.
BLOCK_BYTES = 4_000_000
_SLACK = 4.0


def signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """BagMinHash signatures (rows x m times, infinite for rows without values)."""
    times = np.full(rows * m, np.inf)
    total = np.bincount(doc, weight, rows)
    factor = np.where(total > 0, 1.0, 0.0)
    open_rows = total > 0
    while open_rows.any():
        with np.errstate(divide="ignore", invalid="ignore"):
            horizon = np.where(open_rows, factor * (np.log(m) + _SLACK) / total, 0.0)
        use = open_rows[doc]
        _generate(times, doc[use], value[use], weight[use], horizon, m)
        open_rows = open_rows & ~np.isfinite(times.reshape(rows, m)).all(axis=1)
        factor *= 2
    return times.reshape(rows, m)


def _generate(times: np.ndarray, doc: np.ndarray, value: np.ndarray, weight: np.ndarray, horizon: np.ndarray, m: int) -> None:
    if not len(doc):
        return
    low, high, block = 0, 1, 0
    while True:
        reach = weight > low
        if not reach.any():
            return
        d, w = doc[reach], weight[reach]
        _block(times, d, mix(value[reach] + U64(mix_int(block + 7))), w, low, high, horizon, m)
        doc, value, weight = d, value[reach], w
        low, high, block = high, 2 * high, block + 1


def _block(times: np.ndarray, doc: np.ndarray, seed: np.ndarray, weight: np.ndarray, low: int, high: int, horizon: np.ndarray, m: int) -> None:
    """Points of the block [low, high) up to each document's horizon, 1, 1, 2, 4, ... at a time."""
    width = high - low
    at = np.zeros(len(doc))
    first, many = 0, 1
    while len(doc):
        number = U64(0x9E3779B97F4A7C15) * np.arange(first + 1, first + many + 1, dtype=U64)
        point = mix(seed[:, None] + number[None, :])
        gap = np.log1p(-((point >> U64(11)).astype(np.float64) * 2.0**-53))
        gap *= -1.0 / (m * width)
        t = np.cumsum(gap, axis=1)
        t += at[:, None]
        hit = t <= horizon[doc][:, None]
        row, col = np.nonzero(hit)
        when, bits = t[row, col], mix(point[row, col])
        if width > 1:
            level = low + (((bits & U64(0xFFFFFFFF)) * U64(width)) >> U64(32)).astype(np.int64)
            inside = level < weight[row]
            row, when, bits = row[inside], when[inside], bits[inside]
        component = (((bits >> U64(32)) * U64(m)) >> U64(32)).astype(np.int64)
        np.minimum.at(times, doc[row] * m + component, when)
        more = hit[:, -1]
        doc, seed, weight, at = doc[more], seed[more], weight[more], t[more, -1]
        first += many
        many = first


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(times).view(U64).reshape(len(times), bands, rows)
    key = np.zeros((len(times), bands), U64)
    for r in range(rows):
        key = mix(key + bits[:, :, r])
    return mix(key + np.arange(1, bands + 1, dtype=U64)[None, :])


def _sign(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"))
                doc, value, weight = multisets(*shingles(words, shingle))
                n = part.num_rows
                times = signatures(doc, value, weight, n, bands * rows)
                full = np.bincount(doc, minlength=n) > 0
                keys = band_keys(times[full], bands, rows)
                term = mix(value * U64(0x9E3779B97F4A7C15) + weight.astype(U64))
                edge = np.searchsorted(doc, np.flatnonzero(full))
                total = np.add.reduceat(term, edge) if len(edge) else np.zeros(0, U64)
                other = np.bitwise_xor.reduceat(mix(term), edge) if len(edge) else np.zeros(0, U64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").filter(pa.array(full)), pa.array(total.view(np.int64)), pa.array(other.view(np.int64)), list_array(keys.view(np.int64).ravel(), np.full(len(keys), bands), pa.int64())],
                    ["id", "fp1", "fp2", "keys"],
                )

    return run


def _bags(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                doc, value, weight = multisets(*shingles(Words(part.column("text")), shingle))
                size = np.bincount(doc, minlength=part.num_rows)
                packed = np.empty((len(value), 10), np.uint8)
                packed[:, :6] = value.view(np.uint8).reshape(-1, 8)[:, :6]
                packed[:, 6:] = weight.astype(np.uint32).view(np.uint8).reshape(-1, 4)
                # hashes of a document first, then its weights where any exceeds one
                edge = np.r_[0, np.cumsum(size)]
                heavy = np.bincount(doc, weight > 1, part.num_rows) > 0
                chunks = []
                for i in range(part.num_rows):
                    a, b = edge[i], edge[i + 1]
                    chunks.append((b"\1" + packed[a:b, :6].tobytes() + packed[a:b, 6:].tobytes()) if heavy[i] else (b"\0" + packed[a:b, :6].tobytes()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(chunks, pa.binary())], ["id", "bag"])

    return run


def _unpack(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bag, np.uint8, offset=1)
    n = len(raw) // (10 if bag[0] else 6)
    value = np.zeros((n, 8), np.uint8)
    value[:, :6] = raw[: 6 * n].reshape(n, 6)
    weight = raw[6 * n :].copy().view(np.uint32).astype(np.int64) if bag[0] else np.ones(n, np.int64)
    return value.view(U64).ravel(), weight


def overlap(a: bytes, b: bytes) -> float:
    """sum(min) / sum(max) of two packed multisets."""
    if a == b:
        return 1.0
    (x, p), (y, q) = _unpack(a), _unpack(b)
    if len(x) > len(y):
        x, p, y, q = y, q, x, p
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = y[at] == x if len(y) else np.zeros(len(x), bool)
    shared = int(np.minimum(p[same], q[at[same]]).sum())
    return shared / max(1, int(p.sum() + q.sum()) - shared)


@F.pandas_udf(DoubleType())
def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([overlap(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows (key, id) of buckets with two documents or more, and the least of each as lead."""
    bucket = Window.partitionBy("key")
    return rows.withColumn("lead", F.min("id").over(bucket)).withColumn("last", F.max("id").over(bucket)).where("lead < last").select("key", "id", "lead")


def links(ids: np.ndarray, group: np.ndarray, right: np.ndarray, bags: list[bytes], threshold: float) -> list[tuple[int, int]]:
    """Pairs over the threshold that join the groups of these documents, judging every pair of two groups.

    right: rows (at the end) that are compared with the others only; if there are none, all are compared with all.
    """
    n = len(ids)
    group = np.unique(group, return_inverse=True)[1]
    value, weight = (np.concatenate(x) for x in zip(*map(_unpack, bags), strict=True))
    doc = np.repeat(np.arange(n), [(len(b) - 1) // (10 if b[0] else 6) for b in bags])
    total = np.bincount(doc, weight, n)
    _, code, count = np.unique(value, return_inverse=True, return_counts=True)
    common = count[code] > 1
    doc, code, weight = doc[common], code[common], weight[common]
    edge = np.searchsorted(doc, np.arange(n + 1))
    split = n - int(right.sum())
    mark, found = np.zeros(len(count), np.int64), []
    for x in range(split):
        lo = split if split < n else x + 1
        if not (group[lo:] != group[x]).any():
            continue
        mine = slice(edge[x], edge[x + 1])
        mark[code[mine]] = weight[mine]
        rest = slice(edge[lo], None)
        shared = np.bincount(doc[rest] - lo, np.minimum(mark[code[rest]], weight[rest]), n - lo)
        mark[code[mine]] = 0
        hit = shared >= threshold * np.maximum(1, total[x] + total[lo:] - shared)
        for y in (lo + np.flatnonzero(hit & (group[lo:] != group[x]))).tolist():
            if group[y] != group[x]:
                found.append((int(ids[y]), int(ids[x])))
                group[group == group[y]] = group[x]
    return found


def _links(threshold: float):
    """Rows sorted by cell and side -> edges."""

    def judge(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ids, group, side = (table.column(c).to_numpy() for c in ("id", "group", "side"))
        found = links(ids, group, side > 0, table.column("bag").to_pylist(), threshold)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if held and held[-1].column("cell")[0] != part.column("cell")[0]:
                    yield judge(held)
                    held = []
                held.append(part)
        if held:
            yield judge(held)

    return run


def _exact(members: DataFrame, groups: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that join the members (key, id) of each bucket as far as pairs over the threshold do."""
    bucket = Window.partitionBy("key")
    sized = bags.select("id", F.length("bag").alias("bytes"))
    rows = members.join(groups.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("group"))
    rows = rows.withColumn("low", F.min("group").over(bucket)).withColumn("high", F.max("group").over(bucket)).where("low < high").join(sized, "id")
    upto = bucket.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("block", F.floor(F.sum("bytes").over(upto) / BLOCK_BYTES).cast("int")).withColumn("blocks", F.max("block").over(bucket))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), "blocks")))
    cells = rows.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "group")
    return cells.join(bags, "id").select("cell", "side", "id", "group", "bag").repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(lean(_links(threshold)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, keeper_id, exact) for each document that repeats another.

    Documents whose shingle multisets overlap by at least `threshold` (sum of minima
    over sum of maxima) belong together, groups are the connected components of that
    relation over the pairs that share a band, and keeper_id is a group's least id;
    the keeper itself has no row. `exact`: its multiset equals the keeper's.

    Pairs are verified against the least document of every bucket they share, so a
    bucket of n copies costs n comparisons. Then all pairs in a bucket that no chain of
    matches has joined yet are verified, whether or not they matched its least document, so
    every pair that shares a band is decided or joined. Where many documents share a passage
    but are no copies, that work grows with the square of the crowd. Texts without a word (null, empty, punctuation)
    and rows without an id are in no group. A text shorter than a shingle is one
    shingle. Repeated rows of an id with one text are one document; texts of one id that differ
    are compared each, and the id goes with all of them. Ties go to the least id. No rows give
    no rows; extra columns of any name aren't read; ids that aren't whole numbers are a TypeError.
    """
    spark = docs.sparkSession
    whole_ids(docs, id_col)
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    signed, p_signed = store(base.mapInArrow(lean(_sign(shingle, bands, rows)), "id long, fp1 long, fp2 long, keys array<long>"), "signed")
    prints = signed.select("id", "fp1", "fp2")
    least = prints.groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies, p_copies = store(prints.join(least, ["fp1", "fp2"]).where("id <> rep").distinct(), "copies")
    # by the text, not the id alone: another text of the same id stays a candidate
    heads = signed.join(copies.select("id", "fp1", "fp2"), ["id", "fp1", "fp2"], "left_anti")
    buckets = heads.select("id", F.explode("keys").alias("key"))
    open_rows, p_open = store(_crowded(buckets), "buckets")
    ids, p_ids = store(open_rows.select("id").distinct(), "ids")
    many = ids.count()
    chosen = base.join(F.broadcast(ids) if many <= BROADCAST_IDS else ids, "id")
    bags, p_bags = store(chosen.mapInArrow(lean(_bags(shingle)), "id long, bag binary"), "bags")
    drop_stored(spark, p_ids)
    edges = copies.select(F.col("id").alias("a"), F.col("rep").alias("b"))
    drop_stored(spark, p_signed)
    left, right = bags.select("id", F.col("bag").alias("bag_a")), bags.select(F.col("id").alias("lead"), F.col("bag").alias("bag_b"))
    led = open_rows.where("id <> lead")
    pairs = led.select("id", "lead").distinct()
    judged, p_judged = store(pairs.join(left, "id").join(right, "lead").select("id", "lead", _overlap("bag_a", "bag_b").alias("overlap")), "judged")
    edges = edges.union(judged.where(F.col("overlap") >= threshold).select("id", "lead"))
    joined, p_joined = store(_exact(led.select("key", "id"), components(edges), bags, threshold), "joined")
    drop_stored(spark, p_bags, p_open)
    groups = components(edges.union(joined))
    found, p_found = store(groups.where("node <> root").select("node", "root"), "groups")
    twins = copies.select(F.col("id").alias("node"), F.col("rep").alias("root"), F.lit(True).alias("exact")).distinct()
    out = found.join(twins, ["node", "root"], "left").select(F.col("node").alias(id_col), F.col("root").alias("keeper_id"), F.coalesce("exact", F.lit(False)).alias("exact"))
    result, _ = store(out, "near")  # the result itself: read by whoever asked for it
    drop_stored(spark, p_judged, p_joined, p_copies, p_found)
    return result


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs without the rows that near_duplicates() reports; one document a group stays.

    Rows with a null id and texts without a word (null, empty) always stay, repeated rows of an
    id stay or go together, no rows give no rows. All columns pass, whatever their names.
    """
    name = fresh(docs.columns, "gone")
    gone = near_duplicates(docs, id_col, text_col, **params).select(F.col(id_col).alias(name))
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
