"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is the composition of three parts compiled from the model file:

* the normaliser (identity character map): a dummy prefix space, space to U+2581;
* the pieces: one state a piece, an arc from piece s to piece t reads t. The arc
  weighs 0 where the two-piece text s t is itself encoded as s, t, else infinity.
  A sequence of pieces is the model's BPE encoding of its text exactly if all its
  neighbours have weight 0: merges inside the two pieces happen in the same order
  as in the whole text, so the first merge over a border would already happen in the
  two-piece text. Hence one path has a finite weight, it is the library's encoding,
  and every prefix has one too: the shortest path needs one state a position;
* the byte fallback: a character outside the vocabulary becomes its UTF-8 bytes;
  no merge can touch it, so it cuts the path.

An arc's weight comes from the merge trees of its two pieces alone: going back in time
from the whole pieces, the symbols at their border are undone one by one, and the weight
is infinite if the model would have merged two of them before one was merged elsewhere.

The distinct runs of a chunk of text (which start at spaces: no piece holds U+2581 after
another character) are composed and relaxed together, position by position, as arrays.
Runs that recur are kept for later chunks, up to MEMO_BYTES a worker.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.textarrays import U64, lean, list_array, pieces, string_buffers
from newsloom.session import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Text (bytes) whose runs are encoded together.
CHUNK = 1 << 20
#: Runs and their ids that a worker keeps from chunk to chunk.
MEMO_BYTES = 8 << 20
#: Arc weights that a worker keeps; beyond it they are computed anew.
ARCS = 400_000
#: Segments longer than this are relaxed one by one, unless there are many of them.
LONE = 400
_EMPTY = U64(2**64 - 1)


class _Table:
    """Open addressing from 64-bit keys to int32 values, for arrays of keys."""

    def __init__(self, room: int):
        self.bits = max(8, int(np.ceil(np.log2(max(1, room) * 2.5))))
        self.room, self.used = room, 0
        self.key = np.full(1 << self.bits, _EMPTY)
        self.value = np.zeros(1 << self.bits, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        """Put in distinct new keys; the table starts anew when it is full."""
        if self.used + len(key) > self.room:
            self.key.fill(_EMPTY)
            self.used = 0
            key, value = key[: self.room], value[: self.room]
        self.used += len(key)
        at, mask = self._slot(key), (1 << self.bits) - 1
        while len(key):
            free = self.key[at] == _EMPTY
            self.key[at[free]] = key[free]
            won = self.key[at] == key
            self.value[at[won]] = value[won]
            key, value, at = key[~won], value[~won], (at[~won] + 1) & mask

    def get(self, key: np.ndarray) -> np.ndarray:
        """The value of each key, -1 without one."""
        at, mask = self._slot(key), (1 << self.bits) - 1
        held = self.key[at]
        out = np.where(held == key, self.value[at], -1)
        rest = np.flatnonzero((held != key) & (held != _EMPTY))
        at = at[rest]
        while len(rest):
            at = (at + 1) & mask
            held = self.key[at]
            hit = held == key[rest]
            out[rest[hit]] = self.value[at[hit]]
            more = ~hit & (held != _EMPTY)
            rest, at = rest[more], at[more]
        return out


class Transducer:
    """Encoder and decoder of one BPE model (bytes of its file)."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        normalizer, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not normalizer.add_dummy_prefix or not normalizer.escape_whitespaces:
            raise ValueError("only BPE models with the identity normaliser and a dummy prefix are compiled")
        sp = SentencePieceProcessor(model_proto=model)
        self.size = sp.get_piece_size()
        self.unk = sp.unk_id()
        self.vocab: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = np.full(256, self.unk, np.int32)
        self.has_bytes = False
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.has_bytes = True
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.bytes_of.append(b"")
            elif sp.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.vocab[piece] = i
                self.score[piece] = sp.get_score(i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) for p in self.vocab):
            raise ValueError("a piece crosses a word border")
        self.piece_bytes = pa.array(self.bytes_of, pa.binary())
        self._compile()
        self.arcs = _Table(ARCS)
        self.memo = pa.array([], pa.string())
        self.memo_ids, self.memo_count = np.zeros(0, np.int32), np.zeros(0, np.int32)

    # compiling

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Greedy merging by score, leftmost first: the symbols left, and the parts of the last merge."""
        parts, last = list(text), None
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [last[0] + last[1]]
        return parts, last

    def _compile(self) -> None:
        size = self.size
        # time at which the model makes a piece: the order of scores; characters are there from the start
        self.rank = np.full(size, -1, np.int64)
        merged = sorted((p for p in self.vocab if len(p) > 1), key=lambda p: -self.score[p])
        time, before = -1, None
        for p in merged:
            time, before = time + (self.score[p] != before), self.score[p]
            self.rank[self.vocab[p]] = time
        self.left, self.right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
        self.own = np.zeros(size + 1, bool)  # pieces that are encoded as themselves
        # pieces of one score, or made before a part of theirs: their arcs are weighed by merging the text
        shared = {s for s, n in Counter(self.score[p] for p in merged).items() if n > 1}
        self.slow = np.zeros(size + 1, bool)
        self.text_of = {i: p for p, i in self.vocab.items()}
        pairs: dict[int, int] = {}
        bigrams: set[tuple[str, str]] = set()
        trie: dict[int, int] = {}
        self.char = np.zeros(0x110000, np.int64)
        chars = sorted({c for p in self.vocab for c in p})
        if len(chars) >= 1 << 16:
            raise ValueError("too many characters")
        for k, c in enumerate(chars):
            if c in self.vocab:
                self.char[ord(c)] = k + 1
        self.char[32] = self.char[ord(SPACE)]
        self.newline_cuts = not any("\n" in p and len(p) > 1 for p in self.vocab)
        ends = [-1]
        for p, i in self.vocab.items():
            if any(c not in self.vocab for c in p):
                continue
            if len(p) == 1:
                self.own[i] = True
            elif (parts_last := self._merge(p))[0] == [p]:
                self.own[i] = True
                self.left[i], self.right[i] = (self.vocab[x] for x in parts_last[1])
                self.slow[i] = self.score[p] in shared or max(self.rank[self.left[i]], self.rank[self.right[i]]) >= self.rank[i]
            for k in range(1, len(p)):
                bigrams.add((p[k - 1], p[k]))
                a, b = self.vocab.get(p[:k]), self.vocab.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * size + b] = int(self.rank[i])
            node = 0
            for c in p:
                key = node << 16 | int(self.char[ord(c)])
                node = trie.setdefault(key, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        for p in merged:  # what is made of such a piece is one too
            i = self.vocab[p]
            self.slow[i] |= self.slow[self.left[i]] | self.slow[self.right[i]]
        self.longest = max(map(len, self.vocab))
        self.ends = np.array(ends, np.int32)
        self.first = np.zeros(len(chars) + 1, np.int64)  # nodes of one character
        for k in range(1, len(chars) + 1):
            self.first[k] = trie.get(k, 0)
        self.trie = self._table(trie)
        self.pairs = self._table(pairs)
        self.inner = self._table({int(self.char[ord(a)]) << 16 | int(self.char[ord(b)]): 1 for a, b in bigrams})

    @staticmethod
    def _table(of: dict[int, int]) -> _Table:
        table = _Table(len(of))
        table.add(np.fromiter(of.keys(), U64, len(of)), np.fromiter(of.values(), np.int32, len(of)))
        return table

    # arcs

    def weigh(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the arc from each `before` (size: start) to `piece` has weight 0."""
        start = before == self.size
        fine = self.own[piece] & (start | self.own[before])
        slow = fine & ~start & (self.slow[before] | self.slow[piece])
        for k in np.flatnonzero(slow):
            s, t = self.text_of[int(before[k])], self.text_of[int(piece[k])]
            fine[k] = self._merge(s + t)[0] == [s, t]
        at = np.flatnonzero(fine & ~start & ~slow)
        x, y = before[at].astype(np.int64), piece[at].astype(np.int64)
        limit = np.full(len(at), 2**40)
        while len(at):
            made = self.pairs.get((x * self.size + y).astype(U64))
            crossed = (made >= 0) & (made < limit)
            fine[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            # the younger symbol is undone; of one age the right one, as merges go from the left
            left = rx > ry
            limit = np.where(left, rx, ry + 1)
            x, y = np.where(left, self.right[x], x), np.where(left, y, self.left[y])
        return fine

    def arc(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """weigh() by the worker's table of known arcs."""
        key = before.astype(U64) * U64(self.size) + piece.astype(U64)
        known = self.arcs.get(key)
        new = np.flatnonzero(known < 0)
        if len(new):
            fresh, at = np.unique(key[new], return_inverse=True)
            weight = self.weigh((fresh // U64(self.size)).astype(np.int64), (fresh % U64(self.size)).astype(np.int64))
            known[new] = weight[at]
            self.arcs.add(fresh, weight.astype(np.int32))
        return known > 0

    # shortest paths

    def _compose(self, char: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces in the segments between the edges."""
        stop = np.repeat(edge[1:], np.diff(edge))
        at, node = np.arange(len(char)), self.first[char]
        starts, lengths, found = [], [], []
        for n in range(1, self.longest + 1):
            piece = self.ends[node]
            hit = piece >= 0
            starts.append(at[hit])
            lengths.append(np.full(int(hit.sum()), n, np.int32))
            found.append(piece[hit])
            room = at + n < stop[at]
            at, node = at[room], node[room]
            if not len(at):
                break
            node = self.trie.get((node.astype(U64) << U64(16)) | char[at + n].astype(U64))
            live = node >= 0
            at, node = at[live], node[live]
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(found)

    def _relax(self, char: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, pieces) of the shortest paths over all segments; position: where a piece starts."""
        size = np.diff(edge)
        segment = np.repeat(np.arange(len(size)), size)
        start, length, piece = self._compose(char, edge)
        depth = start - edge[segment[start]]
        depth = depth.astype(np.uint16 if not len(depth) or depth.max() < 1 << 16 else np.int64)  # sorted by digits where short
        order = np.argsort(depth, kind="stable")
        start, length, piece, depth = start[order], length[order], piece[order], depth[order]
        node = start + segment[start]  # a segment of n characters has n + 1 states
        state = np.full(len(char) + len(size), self.size, np.int32)
        back = np.zeros(len(state), np.int32)
        cut = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1], True]) if len(depth) else np.zeros(1, np.int64)
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            free = self.arc(state[node[lo:hi]], piece[lo:hi])
            to = node[lo:hi][free] + length[lo:hi][free]
            state[to], back[to] = piece[lo:hi][free], length[lo:hi][free]
        now = edge[1:] + np.arange(len(size))
        first = edge[:-1] + np.arange(len(size))
        chosen = np.zeros(len(state), bool)
        while len(now):
            chosen[now] = True
            now = now - back[now]
            more = now > first
            now, first = now[more], first[more]
        end = np.flatnonzero(chosen)
        segment_of = np.searchsorted(edge[1:] + np.arange(len(size)), end, "left")
        return end - segment_of - back[end], state[end]

    def _encode_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each run) of normalised runs (a space stands for U+2581)."""
        raw, ends = string_buffers(runs)
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        begin = np.flatnonzero((raw & 0xC0) != 0x80)  # first byte of each character
        run_edge = np.searchsorted(begin, ends)
        char = self.char[codes]
        cut = np.zeros(len(char) + 1, bool)
        cut[run_edge] = True
        unknown = char == 0
        cut[:-1] |= unknown
        cut[1:] |= unknown
        if len(char) > 1:  # no piece spans two characters that no piece holds side by side
            cut[1:-1] |= self.inner.get((char[:-1].astype(U64) << U64(16)) | char[1:].astype(U64)) < 0
        edge = np.flatnonzero(cut)
        size = np.diff(edge)
        known = ~unknown[edge[:-1]]
        place, piece = [np.flatnonzero(unknown)], [np.full(int(unknown.sum()), -1, np.int32)]
        long = known & (size > LONE)
        if long.sum() > 60:
            long[:] = False
        for group in [known & ~long, *(np.arange(len(size)) == k for k in np.flatnonzero(long))]:
            if not group.any():
                continue
            own = np.repeat(group, size)
            where = np.flatnonzero(own)
            at, found = self._relax(char[own], np.r_[0, np.cumsum(size[group])])
            place.append(where[at])
            piece.append(found)
        place, piece = np.concatenate(place), np.concatenate(piece)
        order = np.argsort(place, kind="stable")
        place, piece = place[order], piece[order]
        width = np.diff(np.r_[begin, len(raw)])
        count = np.where(piece < 0, width[place] if self.has_bytes else 1, 1)
        ids = np.repeat(piece, count)
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            first = np.cumsum(count) - count
            within = lost - np.repeat(first, count)[lost]
            ids[lost] = self.byte_id[raw[begin[np.repeat(place, count)[lost]] + within]] if self.has_bytes else self.unk
        total = np.r_[0, np.cumsum(count)]
        by_run = total[np.searchsorted(place, run_edge)]
        return ids, np.diff(by_run).astype(np.int32)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text); null texts have none."""
        if pc.any(pc.match_substring(texts, SPACE)).as_py():
            texts = pc.replace_substring(texts, SPACE, " ")
        raw, ends = string_buffers(texts)
        full = np.diff(ends) > 0
        if not full.any():
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        first = ends[:-1][full] + np.arange(int(full.sum()))  # a dummy space goes before each text
        dummy = np.zeros(len(raw) + len(first), bool)
        dummy[first] = True
        padded = np.full(len(dummy), 32, np.uint8)
        padded[~dummy] = raw
        blank = padded == 32
        begins = dummy.copy()
        begins[1:] |= blank[1:] & ~blank[:-1]
        if self.newline_cuts:
            line = padded == 10
            begins |= line
            begins[1:] |= line[:-1]
        start = np.flatnonzero(begins)
        offsets = np.r_[start, len(padded)].astype(np.int32)
        runs = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(padded)).dictionary_encode()
        distinct, which = runs.dictionary, runs.indices.to_numpy()
        ids, count = self._known(distinct, which)
        per_run = count[which]
        from_ = (np.cumsum(count) - count)[which]
        out = ids[np.repeat((from_ - (np.cumsum(per_run) - per_run)).astype(np.int32), per_run) + np.arange(int(per_run.sum()), dtype=np.int32)]
        doc_edge = np.searchsorted(start, np.r_[first, len(padded)])
        total = np.r_[0, np.cumsum(per_run)]
        counts = np.zeros(len(texts), np.int64)
        counts[full] = np.diff(total[doc_edge])
        return out, counts

    def _known(self, distinct: pa.Array, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of distinct runs, by the memo where it has them; the memo then holds those that recur."""
        at = pc.index_in(distinct, self.memo).fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(at < 0)
        fresh, fresh_count = self._encode_runs(distinct.take(pa.array(new))) if len(new) else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        source = np.concatenate([self.memo_ids, fresh])
        begin = np.r_[0, np.cumsum(np.concatenate([self.memo_count, fresh_count]))]
        pos = at.astype(np.int64)
        pos[new] = len(self.memo_count) + np.arange(len(new))
        count = np.diff(begin)[pos]
        ids = source[np.repeat(begin[pos] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        used = np.bincount(which, minlength=len(distinct)) + 2 * (at >= 0)
        cost = pc.binary_length(distinct).to_numpy() + 4 * count + 8
        order = np.argsort(-used, kind="stable")
        keep = np.sort(order[(np.cumsum(cost[order]) <= MEMO_BYTES) & (used[order] > 1)])
        self.memo = distinct.take(pa.array(keep))
        kept = np.zeros(len(distinct), bool)
        kept[keep] = True
        self.memo_ids, self.memo_count = ids[np.repeat(kept, count)], count[keep].astype(np.int32)
        return ids, count

    def decode_column(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of lists of ids, given flat."""
        if not len(counts):
            return pa.array([], pa.string())
        offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
        parts = pa.ListArray.from_arrays(pa.array(offsets), self.piece_bytes.take(pa.array(ids, pa.int32())))
        raw, ends = string_buffers(pc.binary_join(parts, b""))
        led = np.flatnonzero((np.diff(ends) > 0) & (np.r_[raw, 0][ends[:-1]] == 32))  # the dummy prefix goes
        led_at = ends[led]
        ends = ends - np.searchsorted(led, np.arange(len(ends)))
        out = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.delete(raw, led_at))])
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())

    def encode(self, text: str) -> list[int]:
        return self.encode_column(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the dummy prefix goes, bytes that aren't UTF-8 become U+FFFD."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_loaded: dict[int, Transducer] = {}


def transducer(model: bytes) -> Transducer:
    """The compiled model, kept in the worker with its memo."""
    key = hash(model)
    if key not in _loaded:
        _loaded[key] = Transducer(model)
    return _loaded[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _valid(column: pa.Array) -> pa.Array:
    """The column with bytes that aren't UTF-8 (a binary column cast to text has some) replaced by U+FFFD."""
    try:
        column.validate(full=True)
        return column
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()], pa.string())


def _encoded(model: bytes, at: int):
    """Batches -> (rows, texts, id lists, numbers of ids, decoded texts) of a few MB; at: the text's column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, pa.Array, pa.Array, pa.Array]]:
        fst = transducer(model)
        for batch in batches:
            for part in pieces(batch, at, CHUNK):
                texts = _valid(part.column(at))
                ids, counts = fst.encode_column(texts)
                yield part, texts, list_array(ids, counts, pa.int32()), pa.array(counts.astype(np.int32)), fst.decode_column(ids, counts)

    return run


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """(id, token_ids, n_tokens, decoded) of every row: the ids, and the text decoded from them.

    Decoding gives the text back, but for a literal U+2581, which the model can't tell
    from a space. Null and empty texts have no ids and decode to ''. Rows are mapped one by one: nulls in the id column, repeated rows and ties
    stay as they are, no rows give no rows; extra columns, whatever their names, aren't read. The vocabulary (fixed size) goes to the workers.
    """
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, ids, n, back in _encoded(model, 1)(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), ids, n, back], ["id", "token_ids", "n_tokens", "decoded"])

    return picked.mapInArrow(lean(run), f"id {picked.dtypes[0][1]}, token_ids array<int>, n_tokens int, decoded string").withColumnRenamed("id", id_col)


def add_tokens(docs: DataFrame, text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """docs with token_ids, n_tokens and lossless: whether decoding the ids gives the text.

    Like encode_decode() row by row: null and empty texts have no ids and are lossless. Existing
    columns of those three names are replaced; columns of any other name, `decoded` too, stay.
    """
    ship(docs.sparkSession)
    kept = docs.drop("token_ids", "n_tokens", "lossless").withColumn(text_col, F.col(text_col).cast("string"))
    model, at = read_model(model_path), kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, ids, n, back in _encoded(model, at)(batches):
            same = pc.equal(pc.fill_null(texts, ""), back)
            yield pa.RecordBatch.from_arrays([*part.columns, ids, n, same], [*part.schema.names, "token_ids", "n_tokens", "lossless"])

    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + ", token_ids array<int>, n_tokens int, lossless boolean"
    return kept.mapInArrow(lean(run), schema)


def decode(tokens: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", model_path: str = MODEL) -> DataFrame:
    """tokens with the text of its id lists in out_col; null lists decode to null."""
    ship(tokens.sparkSession)
    model = read_model(model_path)

    @F.pandas_udf("string")
    def text(ids):
        fst = transducer(model)
        return ids.map(lambda x: None if x is None else fst.decode(list(x)))

    return tokens.withColumn(out_col, text(F.col(ids_col).cast("array<int>")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
