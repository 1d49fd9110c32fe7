"""Line dedup: repeated lines are dropped from all documents but the first that has them.

Distinct lines are indexed in shards by a minimal perfect hash (levels of bit arrays: a key
settles on the first level where no other key shares its bit; its index is the number of
bits before it). The hash addresses three arrays of a shard: a 32-bit fingerprint, the
number of documents and the first document. Documents probe the arrays, and a line goes
where its count reaches min_docs and its first document is another; a line outside the index
is recognised by its fingerprint but for one in 4e9. Lines of fewer documents than
min_docs could never go, so they are counted but take no place in the arrays.

The index goes to the workers whole while it is under PROBE_BYTES. Beyond it the line
hashes are routed to the shards instead, each shard's arrays are read before its probes
(in SALTS copies, so a line of very many documents is probed in as many tasks), and only
the decisions travel back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.names import fresh, whole_ids
from newsloom.llm.textarrays import U64, _tables, lean, mix, mix_int, pieces, string_buffers
from newsloom.session import drop_stored, ship, store

#: Shorter lines (bytes, trimmed) are left alone: blank ones only.
MIN_BYTES = 1
SHARD_KEYS = 500_000
PROBE_BYTES = 128_000_000
SALTS = 8
_GAMMA = 2.0


class Lines:
    """Trimmed lines of a string column: doc (row), place in the row, hash, and whether long enough."""

    def __init__(self, column: pa.Array, min_bytes: int):
        raw, ends = string_buffers(column)
        n = len(column)
        filled = np.flatnonzero(np.diff(ends) > 0)
        breaks = np.flatnonzero(raw == 10)
        start = np.sort(np.concatenate([ends[filled], breaks + 1]))
        stop = np.sort(np.concatenate([breaks, ends[filled + 1]]))
        self.doc = np.repeat(filled, np.searchsorted(breaks, ends[filled + 1]) - np.searchsorted(breaks, ends[filled]) + 1)
        first = np.searchsorted(self.doc, np.arange(n))
        self.place = np.arange(len(self.doc)) - first[self.doc]
        blank = np.zeros(256, bool)
        blank[[9, 13, 32]] = True
        padded = np.r_[raw, 0]
        while (move := (start < stop) & blank[padded[start]]).any():
            start = start + move
        while (move := (start < stop) & blank[padded[stop - 1]]).any():
            stop = stop - move
        self.long = stop - start >= min_bytes
        power, inverse = _tables(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, U64)
        inner = sums[1:]
        inner += raw
        inner += U64(1)
        inner *= power[: len(raw)]
        np.cumsum(inner, out=inner)
        self.hash = mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(U64))


@dataclass
class Shard:
    """A minimal perfect hash of its keys and the arrays it addresses."""

    levels: list[np.ndarray]
    ranks: list[np.ndarray]
    fingerprint: np.ndarray
    count: np.ndarray
    first: np.ndarray

    @staticmethod
    def place(key: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(key + U64(mix_int(level + 1))) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, key: np.ndarray, count: np.ndarray, first: np.ndarray) -> Shard:
        levels, ranks, left, base = [], [], key, 0
        while len(left):
            size = int(np.ceil(_GAMMA * len(left) / 64)) * 64
            at = cls.place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(U64)
            before = np.cumsum(np.bitwise_count(bits).astype(np.int64))
            levels.append(bits)
            ranks.append((np.r_[0, before[:-1]] + base).astype(np.uint32))
            base += int(before[-1])
            left = left[~alone[at]]
        shard = cls(levels, ranks, np.zeros(len(key), np.uint32), np.zeros(len(key), np.uint32), np.zeros(len(key), np.int64))
        where = shard.index(key)
        shard.fingerprint[where] = (key >> U64(32)).astype(np.uint32)
        shard.count[where] = np.minimum(count, 2**32 - 1)
        shard.first[where] = first
        return shard

    def index(self, key: np.ndarray) -> np.ndarray:
        """Place of each key in the arrays; -1 for keys that settle nowhere."""
        out = np.full(len(key), -1, np.int64)
        rest = np.arange(len(key))
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self.place(key[rest], k, 64 * len(bits))
            word, bit = at >> 6, (at & 63).astype(U64)
            hit = ((bits[word] >> bit) & U64(1)).astype(bool)
            w, b = word[hit], bit[hit]
            out[rest[hit]] = rank[w] + np.bitwise_count(bits[w] & ((U64(1) << b) - U64(1))).astype(np.int64)
            rest = rest[~hit]
        return out

    def owner(self, key: np.ndarray, min_docs: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """(whether in min_docs documents or more, first document) of each key."""
        if not len(self.first):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = self.index(key)
        known = (at >= 0) & (self.fingerprint[at] == (key >> U64(32)).astype(np.uint32)) & (self.count[at] >= min_docs)
        return known, self.first[at]

    def pack(self) -> bytes:
        head = np.array([len(self.first), len(self.levels), *map(len, self.levels)], np.int64)
        return b"".join(x.tobytes() for x in (head, *self.levels, *self.ranks, self.first, self.fingerprint, self.count))

    @classmethod
    def unpack(cls, raw: bytes) -> Shard:
        n, many = np.frombuffer(raw, np.int64, 2)
        sizes = np.frombuffer(raw, np.int64, many, 16)
        at = 16 + 8 * int(many)

        def take(kind, size):
            nonlocal at
            found = np.frombuffer(raw, kind, size, at)
            at += found.nbytes
            return found

        levels = [take(U64, s) for s in sizes]
        ranks = [take(np.uint32, s) for s in sizes]
        first = take(np.int64, n)
        return cls(levels, ranks, take(np.uint32, n), take(np.uint32, n), first)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key & U64(0xFFFFFFFF)) % U64(shards)).astype(np.int64)


def _hashes(min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                lines = Lines(part.column("text"), min_bytes)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                doc, key = lines.doc[lines.long], lines.hash[lines.long]
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                new = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])] if len(doc) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(ids[doc[new]].astype(np.int64))], ["key", "id"])

    return run


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard -> one packed shard a row."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        key, n, first = (table.column(c).to_numpy() for c in ("key", "n", "first"))
        packed = Shard.build(key.view(U64), n, first).pack()
        return pa.RecordBatch.from_arrays([table.column("shard")[:1].combine_chunks(), pa.array([packed], pa.binary())], ["shard", "packed"])

    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if held and held[-1].column("shard")[0] != part.column("shard")[0]:
                yield flush()
                held = []
            held.append(part)
    if held:
        yield flush()


def _clean(part: pa.RecordBatch, text: str, drop: np.ndarray, lines: Lines) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(new texts, dropped lines of each row, whether the row's lines all went)."""
    column = part.column(text)
    gone = np.bincount(lines.doc[drop], minlength=part.num_rows)
    touched = np.flatnonzero(gone)
    edge = np.searchsorted(lines.doc, np.arange(part.num_rows + 1))
    left = []
    for row, old in zip(touched, column.take(pa.array(touched)).to_pylist(), strict=True):
        keep = ~drop[edge[row] : edge[row + 1]]
        left.append("\n".join(line for line, k in zip(old.split("\n"), keep, strict=True) if k))
    if len(touched):
        column = pc.replace_with_mask(column, pa.array(gone > 0), pa.array(left, column.type))
    emptied = np.zeros(part.num_rows, bool)
    emptied[touched] = [not t.strip() for t in left]
    return column, gone, emptied


def _repeats_inside(lines: Lines) -> np.ndarray:
    """Long lines that stand earlier in the same row."""
    at = np.flatnonzero(lines.long)
    order = at[np.lexsort((lines.place[at], lines.hash[at], lines.doc[at]))]
    again = np.zeros(len(lines.doc), bool)
    if len(order) > 1:
        d, h = lines.doc[order], lines.hash[order]
        again[order[1:]] = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
    return again


def _probe(shared, shards: int, min_bytes: int, min_docs: int, text: int, id_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {int(s): Shard.unpack(p) for s, p in shared.value.items()}
        for batch in batches:
            for part in pieces(batch, text):
                lines = Lines(part.column(text), min_bytes)
                drop = _repeats_inside(lines)
                own = pc.fill_null(part.column(id_at), 0).to_numpy(zero_copy_only=False)
                named = pc.is_valid(part.column(id_at)).to_numpy(zero_copy_only=False)
                drop &= named[lines.doc]
                at = np.flatnonzero(lines.long & named[lines.doc])
                which = shard_of(lines.hash[at], shards)
                for s in np.unique(which):
                    if int(s) in index:
                        mine = at[which == s]
                        known, first = index[int(s)].owner(lines.hash[mine], min_docs)
                        drop[mine] |= known & (first != own[lines.doc[mine]])
                yield _result(part, text, drop, lines)

    return run


def _result(part: pa.RecordBatch, text: int, drop: np.ndarray, lines: Lines, columns: int | None = None) -> pa.RecordBatch:
    """The first columns of part with new texts, the dropped lines, and whether the text went whole."""
    column, gone, emptied = _clean(part, text, drop, lines)
    kept = list(part.columns)[:columns]
    kept[text] = column
    arrays = [*kept, pa.array(gone.astype(np.int32)), pa.array(emptied)]
    return pa.RecordBatch.from_arrays(arrays, [f"c{k}" for k in range(len(arrays))])


def _route(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard, the packed shard before its probes -> lines to drop."""
        shard, current = None, None
        for batch in batches:
            which = batch.column("shard").to_numpy()
            packed = batch.column("packed")
            at = np.flatnonzero(pc.is_valid(packed).to_numpy(zero_copy_only=False)).tolist()
            key = pc.fill_null(batch.column("key"), 0).to_numpy(zero_copy_only=False).view(U64)
            ids = pc.fill_null(batch.column("id"), 0).to_numpy(zero_copy_only=False)
            out_id, out_key = [], []
            cuts = sorted({0, *at, *(np.flatnonzero(np.diff(which)) + 1).tolist(), batch.num_rows})
            heads = set(at)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a in heads:
                    shard, current = which[a], Shard.unpack(packed[a].as_py())
                    a += 1
                if current is None or which[min(a, b - 1)] != shard or a == b:
                    continue
                known, first = current.owner(key[a:b], min_docs)
                hit = known & (first != ids[a:b])
                out_id.append(ids[a:b][hit])
                out_key.append(key[a:b][hit].view(np.int64))
            flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat(out_id)), pa.array(flat(out_key))], ["id", "key"])

    return run


def _apply(min_bytes: int, text: int, id_at: int, keys_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                lines = Lines(part.column(text), min_bytes)
                drop = _repeats_inside(lines)
                drop &= pc.is_valid(part.column(id_at)).to_numpy(zero_copy_only=False)[lines.doc]
                lists = part.column(keys_at)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                keys, edge = lists.flatten().to_numpy().view(U64), np.r_[0, np.cumsum(sizes)]
                for row in np.flatnonzero(sizes):
                    a, b = np.searchsorted(lines.doc, [row, row + 1])
                    drop[a:b] |= lines.long[a:b] & np.isin(lines.hash[a:b], keys[edge[row] : edge[row + 1]])
                yield _result(part, text, drop, lines, keys_at)

    return run


def _deduped(docs: DataFrame, id_col: str, text_col: str, min_bytes: int, probe_bytes: int, min_docs: int) -> tuple[DataFrame, str, str]:
    """docs with new texts and two further columns, and their names: dropped lines, and whether no text is left."""
    spark = docs.sparkSession
    whole_ids(docs, id_col)
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    hashes = base.mapInArrow(lean(_hashes(min_bytes)), "key long, id long")
    counted = hashes.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    repeated, p_repeated = store(counted.where(F.col("n") >= min_docs).where("first < last").select("key", "n", "first"), "lines")
    many = repeated.count()
    shards = max(1, -(-many // SHARD_KEYS))
    shard = F.pmod(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(shards)).cast("long")
    placed = repeated.withColumn("shard", shard).repartition(shards, "shard").sortWithinPartitions("shard", "key")
    index, p_index = store(placed.select("shard", "key", "n", "first").mapInArrow(lean(_build), "shard long, packed binary"), "line-index")
    drop_stored(spark, p_repeated)
    total = index.agg(F.sum(F.length("packed"))).first()[0] or 0
    own, dropped, emptied, keys = (fresh(docs.columns, x) for x in ("own", "dropped", "emptied", "keys"))
    kept = docs.withColumn(text_col, F.col(text_col).cast("string"))
    keyed = kept.withColumn(own, F.col(id_col).cast("long"))
    text, id_at = docs.columns.index(text_col), len(docs.columns)
    kinds = [t for _, t in keyed.dtypes] + ["int", "boolean"]
    schema = ", ".join(f"c{k} {t}" for k, t in enumerate(kinds))
    if total <= probe_bytes:
        shared = spark.sparkContext.broadcast({r["shard"]: bytes(r["packed"]) for r in index.collect()})
        drop_stored(spark, p_index)
        out = keyed.mapInArrow(lean(_probe(shared, shards, min_bytes, min_docs, text, id_at)), schema)
    else:
        none = F.lit(None)
        probes = hashes.select(shard.alias("shard"), F.pmod("id", F.lit(SALTS)).alias("salt"), none.cast("binary").alias("packed"), "key", "id")
        arrays = index.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), "packed", none.cast("long").alias("key"), none.cast("long").alias("id"))
        routed = arrays.unionByName(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("packed").isNull())
        hits = routed.select("shard", "packed", "key", "id").mapInArrow(lean(_route(min_docs)), "id long, key long")
        decisions = hits.groupBy(F.col("id").alias(own)).agg(F.collect_set("key").alias(keys))
        joined = keyed.join(decisions, own, "left").select(*[keyed[f"`{c}`"] for c in keyed.columns], keys)
        out = joined.mapInArrow(lean(_apply(min_bytes, text, id_at, id_at + 1)), schema)
    return out.toDF(*keyed.columns, dropped, emptied).drop(own), dropped, emptied


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, probe_bytes: int = PROBE_BYTES, min_docs: int = 2) -> DataFrame:
    """(doc_id, text, dropped_lines) of every row, without repeated lines.

    A line of at least min_bytes (UTF-8, without spaces, tabs and carriage returns around
    it) that min_docs documents or more have stays in the one with the least id, once; other
    occurrences go. A line also stays once within its document. Blank and shorter lines stay.
    Null and empty texts stay as they are, rows with a null id are neither changed nor counted,
    repeated rows of an id keep the same lines (and count as documents only towards a min_docs above 2). No rows
    give no rows; extra columns of any name aren't read; ids that aren't whole numbers are a TypeError.
    """
    out, dropped, _ = _deduped(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, min_bytes, probe_bytes, min_docs)
    return out.select(id_col, text_col, F.col(dropped).alias("dropped_lines"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **params) -> DataFrame:
    """docs with deduped texts as by dedup_lines(); documents left without any text by it go.

    length_col, where docs has it, gets the new length in characters of changed texts. Documents
    that were empty or null before stay, and so do rows with a null id. All columns pass, whatever
    their names.
    """
    out, dropped, emptied = _deduped(docs, id_col, text_col, params.get("min_bytes", MIN_BYTES), params.get("probe_bytes", PROBE_BYTES), params.get("min_docs", 2))
    out = out.where(~F.col(emptied))
    if length_col in docs.columns:
        kind = dict(docs.dtypes)[length_col]
        out = out.withColumn(length_col, F.when(F.col(dropped) > 0, F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return out.drop(dropped, emptied)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE strlen(key) >= 1 GROUP BY key),
f AS (SELECT k.*, strlen(key) >= 1 AND (o.owner <> doc_id OR row_number() OVER (PARTITION BY doc_id, k.key ORDER BY pos) > 1) AS gone FROM k LEFT JOIN o USING (key)),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS dropped FROM f GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN t.dropped > 0 THEN coalesce(t.kept, '') ELSE d.text END AS text, coalesce(t.dropped, 0)::INTEGER AS dropped_lines
FROM documents d LEFT JOIN t USING (doc_id)
"""
