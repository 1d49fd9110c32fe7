"""Token ids as compact binary blocks: canonical, length-limited Huffman codes.

One code serves the whole corpus: ids are counted over all documents, package-merge
gives the best code lengths of at most `limit` bits, and the lengths alone fix the
canonical code. Documents are cut into independent blocks; a block records the bit
offset of every CHECKPOINT-th id, so decoding can start at any of them. The decoder
looks the next `limit` bits up in a table of (id, length) and advances all checkpoints
of a batch at once.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.textarrays import U64, binary_array, lean, list_array
from newsloom.session import drop_stored, ship, store

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT, BLOCK_IDS, CHECKPOINT = 16, 65_536, 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths (0 for unused ids) of at most `limit` bits, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids need more than {limit} bits")
    used = used[np.lexsort((used, counts[used]))]
    leaf = counts[used].astype(np.int64)
    merged, kinds = leaf, [np.ones(n, bool)]
    for _ in range(limit - 1):
        even = len(merged) // 2 * 2
        pack = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate([leaf, pack])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        kinds.append(order < n)
    take = 2 * n - 2
    length = np.zeros(n, np.int64)
    for is_leaf in reversed(kinds):
        leaves = int(is_leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[used] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words of the lengths: by length, then id."""
    code = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        size = lengths[order].astype(np.int64)
        top = int(size[-1])
        step = np.left_shift(1, top - size)
        code[order] = ((np.cumsum(step) - step) >> (top - size)).astype(np.uint32)
    return code


class Codec:
    """Encoder and decoder of one set of code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical(lengths).astype(U64)
        self.top = int(self.lengths.max(initial=1))
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        span = np.left_shift(1, self.top - self.lengths[order])
        self.symbol = np.zeros(1 << self.top, np.int32)
        self.width = np.ones(1 << self.top, np.uint8)
        filled = int(span.sum())
        self.symbol[:filled] = np.repeat(order, span)
        self.width[:filled] = np.repeat(self.lengths[order], span)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, bytes a block, bits a block, bit offset of each id in its block) of blocks of `sizes` ids."""
        size = self.lengths[ids]
        if len(ids) and not size.all():
            raise ValueError("an id has no code")
        end = np.cumsum(size)
        edge = np.cumsum(sizes)
        bits = np.diff(np.r_[0, np.r_[0, end][edge]])
        words = -(-bits // 64)
        base = (np.cumsum(words) - words) * 64
        start = end - size
        first = np.r_[0, end][edge - sizes]
        local = start - np.repeat(first, sizes)
        at = local + np.repeat(base, sizes)
        out = np.zeros(int(words.sum()) + 1, U64)
        if len(ids):
            word, room = at >> 6, 64 - (at & 63) - size
            code = self.codes[ids]
            spill = room < 0
            part = np.where(spill, code >> np.maximum(-room, 0).astype(U64), code << np.maximum(room, 0).astype(U64))
            new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            out[word[new]] = np.bitwise_or.reduceat(part, new)
            out[word[spill] + 1] |= code[spill] << (64 + room[spill]).astype(U64)
        raw = out.byteswap().view(np.uint8)
        length = -(-bits // 8)
        keep = np.repeat(8 * (np.cumsum(words) - words) - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        return raw[keep], length, bits, local

    def decode(self, raw: np.ndarray, bit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of runs that start at the bits `bit` of raw and hold `sizes` ids, one run after another."""
        out = np.zeros(int(sizes.sum()), np.int32)
        padded = np.r_[raw, np.zeros(4, np.uint8)].astype(np.uint32)
        window = (padded[:-3] << np.uint32(24)) | (padded[1:-2] << np.uint32(16)) | (padded[2:-1] << np.uint32(8)) | padded[3:]
        order = np.argsort(-sizes, kind="stable")
        at, where, left = bit[order].astype(np.int64), (np.cumsum(sizes) - sizes)[order], sizes[order]
        shift, mask = 32 - self.top, (1 << self.top) - 1
        for step in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-left, -step, "left"))
            p = at[:live]
            key = (window[p >> 3].astype(np.int64) >> (shift - (p & 7))) & mask
            out[where[:live] + step] = self.symbol[key]
            at[:live] += self.width[key]
        return out


def tokenizer(path: str = VOCABULARY):
    """The byte-pair tokenizer of a rank file."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_tokenizers: dict[int, object] = {}


def _tokenize(ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        key = hash(ranks)
        if key not in _tokenizers:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
            _tokenizers[key] = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        encode = _tokenizers[key].encode_ordinary
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids = [np.array(encode(t), np.uint16).tobytes() if t else b"" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(column.to_pylist())
    sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    return np.frombuffer(raw, np.uint16).astype(np.int64), sizes


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                total += np.bincount(_flat(batch.slice(lo, 2000).column("ids"))[0], minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["token", "n"])

    return run


def _encode(shared, block_ids: int, checkpoint: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids, per_doc = _flat(part.column("ids"))
                blocks = np.maximum(1, -(-per_doc // block_ids))
                number = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                sizes = np.minimum(np.repeat(per_doc, blocks) - number * block_ids, block_ids)
                raw, length, bits, local = codec.encode(ids, sizes)
                marks = -(-sizes // checkpoint)
                inside = np.arange(int(marks.sum())) - np.repeat(np.cumsum(marks) - marks, marks)
                at = np.repeat(np.cumsum(sizes) - sizes, marks) + inside * checkpoint
                offset = local[at] if len(at) else np.zeros(0, np.int64)
                base = 8 * np.repeat(np.cumsum(length) - length, marks)
                run_sizes = np.minimum(np.repeat(sizes, marks) - inside * checkpoint, checkpoint)
                back = codec.decode(raw, base + offset, run_sizes)
                wrong = np.r_[0, np.cumsum(back != ids)]
                edge = np.cumsum(sizes)
                fine = wrong[edge] == wrong[edge - sizes]
                doc = pa.array(np.repeat(np.arange(part.num_rows), blocks))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(doc), pa.array(number.astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(bits.astype(np.int64)), binary_array(raw, length), list_array(offset.astype(np.int32), marks, pa.int32()), pa.array(fine)],
                    ["id", "block", "n_tokens", "n_bits", "payload", "checkpoints", "verified"],
                )

    return run


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT, block_ids: int = BLOCK_IDS, checkpoint: int = CHECKPOINT) -> DataFrame:
    """Blocks (doc_id, block, n_tokens, n_bits, payload, checkpoints, verified, code) of all documents.

    payload holds the block's code words, most significant bit first; checkpoints the bit
    offset of each `checkpoint`-th id; verified whether decoding gave the ids back; code the
    name of the code that the block is written in. The row with block -1 (null id) is that
    code's header: the code lengths of all ids, compressed, and `checkpoint` as its only
    checkpoint. So the rows are complete by themselves, and so are unions of several corpora.
    Null and empty texts give one empty block; repeated rows and null ids are coded like
    others. Without any id the code is empty. Extra columns of any name aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as file:
        ranks = file.read()
    size = 1 + max(int(line.split()[1]) for line in ranks.splitlines())
    if size > 1 << 16:
        raise ValueError("ids of more than 16 bits are not stored")
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.dtypes[0][1]
    tokens, p_tokens = store(picked.mapInArrow(lean(_tokenize(ranks)), f"id {kind}, ids binary"), "tokens")
    counted = tokens.select("ids").mapInArrow(lean(_count(size)), "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # one row an id of the vocabulary
    counts = np.zeros(size, np.int64)
    for row in counted:
        counts[row["token"]] = row["n"]
    lengths = code_lengths(counts, limit)
    shared = spark.sparkContext.broadcast(lengths)
    schema = f"id {kind}, block int, n_tokens int, n_bits long, payload binary, checkpoints array<int>, verified boolean"
    code = hashlib.blake2b(lengths.tobytes() + f"/{checkpoint}".encode(), digest_size=8).hexdigest()
    blocks, _ = store(tokens.mapInArrow(lean(_encode(shared, block_ids, checkpoint)), schema), "blocks")  # the result itself
    drop_stored(spark, p_tokens)
    head = spark.createDataFrame([(None, -1, int(counts.astype(bool).sum()), int((counts * lengths).sum()), zlib.compress(lengths.tobytes()), [checkpoint], True)], schema)
    return head.unionByName(blocks).withColumn("code", F.lit(code)).withColumnRenamed("id", id_col)


def decode_corpus(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, block, token_ids) of encode_corpus() rows, decoded from every checkpoint at once.

    Each block is read by the header of its code; repeated headers (unions of a corpus with
    itself) count once, blocks of different codes may be mixed. A block without its header is an
    error (ValueError). Null ids and repeated rows are decoded like others; no rows give no rows.
    """
    spark = blocks.sparkSession
    ship(spark)
    heads = {r["code"]: (np.frombuffer(zlib.decompress(bytes(r["payload"])), np.uint8), r["checkpoints"][0]) for r in blocks.where("block = -1").select("code", "payload", "checkpoints").distinct().collect()}  # one row a corpus
    lost = blocks.where("block >= 0" + (f" and (code is null or code not in ({', '.join(map(repr, heads))}))" if heads else "")).select("code").first()
    if lost is not None:
        raise ValueError(f"the header row (block -1) of code {lost['code']} is missing")
    shared = spark.sparkContext.broadcast(heads)
    kind = dict(blocks.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs: dict[str, Codec] = {}
        for batch in batches:
            codes = batch.column("code").dictionary_encode()
            for k, code in enumerate(codes.dictionary.to_pylist()):
                if code not in codecs:
                    codecs[code] = Codec(shared.value[code][0])
                part, checkpoint = batch.filter(pa.compute.equal(codes.indices, k)), shared.value[code][1]
                payload = part.column("payload")
                raw = np.frombuffer(b"".join(payload.to_pylist()), np.uint8)
                length = pa.compute.binary_length(payload).to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = part.column("n_tokens").to_numpy().astype(np.int64)
                marks = -(-sizes // checkpoint)
                inside = np.arange(int(marks.sum())) - np.repeat(np.cumsum(marks) - marks, marks)
                bit = part.column("checkpoints").flatten().to_numpy().astype(np.int64) + 8 * np.repeat(np.cumsum(length) - length, marks)
                ids = codecs[code].decode(raw, bit, np.minimum(np.repeat(sizes, marks) - inside * checkpoint, checkpoint))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("block"), list_array(ids, sizes, pa.int32())], ["id", "block", "token_ids"])

    rows = blocks.where("block >= 0").select(F.col(id_col).alias("id"), "block", "n_tokens", "payload", "checkpoints", "code")
    return rows.mapInArrow(lean(run), f"id {kind}, block int, token_ids array<int>").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
