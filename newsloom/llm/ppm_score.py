"""Language-model scores by prediction by partial matching over bytes.

The model is a byte-context trie: how often each byte followed each context of up to
ORDER bytes (documents start in a context of zero bytes). A byte is coded in the longest
context known; if the byte is new there, an escape (method C: as likely as the number of
distinct bytes seen) leads to the next shorter context, where the bytes of the longer one
are excluded, and finally to a uniform choice among bytes never seen. A document's score
is its code length.

Pretrained: the trie is counted over all documents. As a byte seen in a context is also
seen in the shorter one, exclusions depend on the context alone, so every node has fixed
code lengths, and scoring is a hash lookup a byte; only escapes walk the trie. All nodes
are kept: beyond MAX_NODES the distinct nodes of each chunk of text are joined with the
table of counts, and the code lengths found travel back to the chunk.
Adaptive: a document is coded by the trie of its own past, started empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.textarrays import U64, lean, pieces, string_buffers
from newsloom.session import drop_stored, ship, store

ORDER = 4
#: Up to so many (context, byte) nodes of the longest contexts go to all workers; with more,
#: the trie stays a table, and the texts' nodes are routed to it.
MAX_NODES = 2_000_000
#: Text (bytes) whose nodes are looked up together when they are routed.
CHUNK = 32_000_000


def grams(raw: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """The bytes at each position and the `order` before it, packed (the newest lowest)."""
    at = np.arange(len(raw)) - np.repeat(ends[:-1], np.diff(ends))
    key = raw.astype(U64)
    for k in range(1, order + 1):
        before = np.zeros(len(raw), U64)
        before[k:] = raw[:-k]
        before[at < k] = 0
        key |= before << U64(8 * k)
    return key


class Trie:
    """Code lengths of a pretrained trie, from counts of (context, byte) of the longest contexts; those of shorter ones are their sums."""

    def __init__(self, key: np.ndarray, count: np.ndarray, order: int):
        self.order = order
        tables = {order: _merged(key, count)}
        for o in range(order - 1, -1, -1):
            k, n = tables[o + 1]
            tables[o] = _merged(k & U64((1 << (8 * (o + 1))) - 1), n)
        self.keys, self.cost, self.contexts, self.excluded_escape = {}, {}, {}, {}
        self.after, self.total, self.distinct, self.count = {}, {}, {}, {}
        for o, (k, n) in tables.items():
            context, first = np.unique(k >> U64(8), return_index=True)
            total = np.add.reduceat(n, first) if len(n) else n
            distinct = np.diff(np.r_[first, len(k)])
            which = np.repeat(np.arange(len(context)), distinct)
            self.keys[o], self.contexts[o], self.count[o] = k, context, n
            self.total[o], self.distinct[o] = total, distinct
            self.cost[o] = np.log2((total + distinct)[which] / n)
        # of each context: the count mass, in the next shorter context, of the bytes seen in it
        self.shared = {}
        for o in range(1, order + 1):
            k, n = tables[o]
            lower = k & U64((1 << (8 * o)) - 1)
            at, known = _find(self.keys[o - 1], lower)
            mass = np.where(known, self.count[o - 1][at] if len(self.count[o - 1]) else 0, 0)
            first = np.r_[0, np.cumsum(self.distinct[o])[:-1]]
            self.shared[o] = np.add.reduceat(mass, first) if len(mass) else mass
        self._hash()

    def _hash(self) -> None:
        key, cost = self.keys[self.order], self.cost[self.order].astype(np.float32)
        bits = max(10, int(np.ceil(np.log2(max(1, len(key)) * 3))))
        self.bits = bits
        self.slot_key = np.full((1 << bits), U64(2**64 - 1))
        self.slot_cost = np.zeros(1 << bits, np.float32)
        rest, probe = np.arange(len(key)), 0
        while len(rest):
            at = self._slot(key[rest], probe)
            free = self.slot_key[at] == U64(2**64 - 1)
            at, cand = at[free], rest[free]
            self.slot_key[at] = key[cand]
            won = self.slot_key[at] == key[cand]
            self.slot_cost[at[won]] = cost[cand[won]]
            placed = np.zeros(len(key), bool)
            placed[cand[won]] = True
            rest = rest[~placed[rest]]
            probe += 1
        self.probes = probe

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        return ((((key * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)) + U64(probe)) & U64((1 << self.bits) - 1)).astype(np.int64)

    def lengths(self, key: np.ndarray) -> np.ndarray:
        """Bits of each packed (context, byte)."""
        at = self._slot(key, 0)
        out = self.slot_cost[at].astype(np.float64)
        rest = np.flatnonzero(self.slot_key[at] != key)
        for probe in range(1, self.probes):
            if not len(rest):
                return out
            at = self._slot(key[rest], probe)
            found = self.slot_key[at] == key[rest]
            out[rest[found]] = self.slot_cost[at[found]]
            empty = self.slot_key[at] == U64(2**64 - 1)
            if empty.any():
                out[rest[empty]] = -1.0
            rest, lost = rest[~found & ~empty], rest[empty]
            if len(lost):
                out[lost] = self.escapes(key[lost])
        out[rest] = self.escapes(key[rest])
        return out

    def escapes(self, key: np.ndarray) -> np.ndarray:
        """Bits by walking down from the longest context (exact for any byte)."""
        bits = np.zeros(len(key))
        open_ = np.arange(len(key))
        gone = np.zeros(len(key))  # bytes excluded so far
        mass = np.zeros(len(key))  # their count in the context at hand
        for o in range(self.order, -1, -1):
            mine = key[open_] & U64((1 << (8 * (o + 1))) - 1)
            c, known = _find(self.contexts[o], mine >> U64(8))
            k, seen = _find(self.keys[o], mine)
            if not len(self.contexts[o]):
                continue
            total = self.total[o][c] - mass[open_]
            fresh = self.distinct[o][c] - gone[open_]
            use = known & (fresh > 0)
            hit = use & seen
            bits[open_[hit]] += np.log2((total + fresh)[hit] / self.count[o][k[hit]])
            miss = use & ~seen
            bits[open_[miss]] += np.log2((total + fresh)[miss] / fresh[miss])
            in_context = open_[known]
            gone[in_context] = self.distinct[o][c[known]]
            if o:
                mass[in_context] = self.shared[o][c[known]]
                # a context unknown at this order keeps what was excluded: nothing, as longer ones are unknown too
            open_ = open_[~hit]
        bits[open_] += np.log2(np.maximum(1, 256 - gone[open_]))
        return bits


def _merged(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key.astype(U64), count.astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(count.astype(np.int64), first)


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, key)
    at[at == len(table)] = 0
    return at, (table[at] == key) if len(table) else np.zeros(len(key), bool)


def adaptive_bits(text: bytes, order: int = ORDER) -> float:
    """Code length of text by the trie of its own past."""
    nodes: dict[bytes, dict[int, int]] = {}
    bits, past = 0.0, bytes(order)
    for byte in text:
        excluded: set[int] = set()
        for o in range(order, -1, -1):
            seen = nodes.get(past[order - o :])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            if left:
                total = sum(left.values()) + len(left)
                if byte in left:
                    bits += float(np.log2(total / left[byte]))
                    break
                bits += float(np.log2(total / len(left)))
            excluded |= set(seen)
        else:
            bits += float(np.log2(256 - len(excluded)))
        for o in range(order + 1):
            node = nodes.setdefault(past[order - o :], {})
            node[byte] = node.get(byte, 0) + 1
        past = (past + bytes([byte]))[1:] if order else b""
    return bits


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _merged(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

        for batch in batches:
            for part in pieces(batch, "text"):
                key = grams(*string_buffers(part.column("text")), order)
                key.sort()
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                held.append((key[first], np.diff(np.r_[first, len(key)])))
                size += len(first)
                if size > 4_000_000:
                    held = [merged()]
                    size = 0
        if held:
            key, n = merged()
            for lo in range(0, len(key), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + 200_000].view(np.int64)), pa.array(n[lo : lo + 200_000])], ["key", "n"])

    return run


def _counted(docs: DataFrame, text_col: str, order: int) -> tuple[DataFrame, str]:
    """A stored table (key, n) of all nodes of the longest contexts, and its path."""
    if not 1 <= order <= 6:
        raise ValueError("order must be between 1 and 6")
    ship(docs.sparkSession)
    counts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").mapInArrow(lean(_count(order)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return store(counts, "grams")


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Trie:
    """The trie of all texts with all its nodes, on the driver. Contexts of up to 6 bytes."""
    counts, path = _counted(docs, text_col, order)
    trie = Trie(*_arrays(counts), order)
    drop_stored(docs.sparkSession, path)
    return trie


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = df.select("key", "n").toArrow()
    return table.column("key").to_numpy().view(U64), table.column("n").to_numpy()


def _scored(ids: pa.Array, ends: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    sizes = np.diff(ends)
    total = np.r_[0.0, np.cumsum(lengths)]
    bits = total[ends[1:]] - total[ends[:-1]]
    each = np.divide(bits, sizes, out=np.zeros(len(bits)), where=sizes > 0)
    return pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(np.round(bits, 3)), pa.array(np.round(each, 6), mask=sizes == 0)], ["id", "n_bytes", "bits", "bits_per_byte"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                raw, ends = string_buffers(part.column("text"))
                yield _scored(part.column("id"), ends, trie.lengths(grams(raw, ends, trie.order)) if len(raw) else np.zeros(0))

    return run


def _stamp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the chunk of text that each belongs to."""
    chunk, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for part in pieces(batch, "text"):
            size += part.column("text").nbytes
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, chunk + size // CHUNK))], [*part.schema.names, "chunk"])


def _chunk_keys(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for part in pieces(batch.slice(a, b - a), "text"):
                    if now is not None and now != chunks[a]:
                        yield from _key_batches(held, now)
                        held = []
                    now = chunks[a]
                    held.append(np.unique(grams(*string_buffers(part.column("text")), order)))
                    if len(held) > 8:
                        held = [np.unique(np.concatenate(held))]
        if held:
            yield from _key_batches(held, now)

    return run


def _key_batches(held: list[np.ndarray], chunk: int) -> Iterator[pa.RecordBatch]:
    key = np.unique(np.concatenate(held)).view(np.int64)
    for lo in range(0, len(key), 200_000):
        part = key[lo : lo + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(part)], ["chunk", "key"])


def _score_routed(order: int):
    """Rows sorted by chunk, its nodes (by key) before its texts -> scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, costs = None, [], []
        for batch in batches:
            chunks, sides = batch.column("chunk").to_numpy(), batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(chunks) != 0) | (np.diff(sides) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if now != chunks[a]:
                    now, keys, costs = chunks[a], [], []
                if sides[a] == 0:
                    keys.append(part.column("key").to_numpy().view(U64))
                    costs.append(np.log2(part.column("mass").to_numpy() / part.column("n").to_numpy()).astype(np.float32))
                    continue
                if len(keys) > 1 or keys and len(keys[0]) > 1 and keys[0][0] > keys[0][-1]:
                    key, cost = np.concatenate(keys), np.concatenate(costs)
                    by = np.argsort(key)
                    keys, costs = [key[by]], [cost[by]]
                for piece in pieces(part, "text"):
                    raw, ends = string_buffers(piece.column("text"))
                    found = np.zeros(0)
                    if len(raw):
                        at, known = _find(keys[0], grams(raw, ends, order))
                        if not known.all():
                            raise RuntimeError("texts changed between the passes")
                        found = costs[0][at].astype(np.float64)
                    yield _scored(piece.column("id"), ends, found)

    return run


def _routed(picked: DataFrame, counts: DataFrame, order: int, schema: str) -> DataFrame:
    """Scores by the table of counts: as each byte of the texts is a node of it, none escapes."""
    spark = picked.sparkSession
    texts, p_texts = store(picked.mapInArrow(lean(_stamp), f"id {picked.dtypes[0][1]}, text string, chunk long"), "texts")
    context = F.shiftrightunsigned("key", 8)
    masses = counts.groupBy(context.alias("context")).agg((F.sum("n") + F.count("*")).alias("mass"))
    costs = counts.withColumn("context", context).join(masses, "context").select("key", "n", "mass")
    wanted = texts.where("text is not null").select("chunk", "text").mapInArrow(lean(_chunk_keys(order)), "chunk long, key long").distinct()
    nodes = wanted.join(costs, "key").select("chunk", F.lit(0).alias("side"), "key", "n", "mass", F.lit(None).cast(picked.dtypes[0][1]).alias("id"), F.lit(None).cast("string").alias("text"))
    empty = [F.lit(None).cast("long").alias(c) for c in ("key", "n", "mass")]
    both = nodes.unionByName(texts.select("chunk", F.lit(1).alias("side"), *empty, "id", "text"))
    result, _ = store(both.repartition("chunk").sortWithinPartitions("chunk", "side", "key").mapInArrow(lean(_score_routed(order)), schema), "scores")
    drop_stored(spark, p_texts)
    return result


def _score_adaptive(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            bits = [round(adaptive_bits(t, order), 3) for t in texts]
            each = [round(b / len(t), 6) if t else None for b, t in zip(bits, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(bits, pa.float64()), pa.array(each, pa.float64())], ["id", "n_bytes", "bits", "bits_per_byte"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, adaptive: bool = False, max_nodes: int = MAX_NODES) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every row, over its whole text.

    Null and empty texts have 0 bits and a null rate. Rows are scored one by one, so
    repeated rows and null ids are scored like others (each repeat also counts in the
    pretrained trie). No rows give no rows; extra columns of any name aren't read. max_nodes
    decides how nodes are looked up, not what the scores are.
    """
    spark = docs.sparkSession
    ship(spark)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {picked.dtypes[0][1]}, n_bytes long, bits double, bits_per_byte double"
    if adaptive:
        return picked.mapInArrow(lean(_score_adaptive(order)), schema).withColumnRenamed("id", id_col)
    counts, path = _counted(docs, text_col, order)
    if counts.count() > max_nodes:
        out = _routed(picked, counts, order, schema)
    else:
        out = picked.mapInArrow(lean(_score(spark.sparkContext.broadcast(Trie(*_arrays(counts), order)))), schema)
    drop_stored(spark, path)
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
