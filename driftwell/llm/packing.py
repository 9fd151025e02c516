"""Packing documents into fixed-length sequences along a Hilbert curve.

Every document's hashed token counts are projected to a few dimensions; the place of that point on a Hilbert curve is its
sort key, so documents with like words lie near each other. A range sort by that key deals the curve out to partitions,
and each partition writes its documents end to end into sequences of ``length`` ids. What is left at a partition's end is
cut into sequences of powers of two, so no id is padding.
"""

from __future__ import annotations

import json
import math
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.base import byte_rows, pieces, table
from driftwell.storage import stash

LENGTH, END = 2048, 1
DIMENSIONS, DEPTH = 4, 10
#: Bytes of text handled at once, and ids that a partition of the curve should hold.
PIECE, SHARE = 2 << 20, 16 << 20
#: A worker's table of known pieces: slots, longest piece in bytes, and ids held before the table starts anew.
SLOTS, LONGEST, ARENA = 1 << 21, 24, 8 << 20

#: What the fast way takes for granted of a tokenizer file; any other file goes through the whole tokenizer, text by text.
STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUTS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}

#: Characters that are cut and lower-cased here; a word with any other goes whole through the tokenizer.
PLAIN = [c for c in range(0x21, 0x17F) if not 0x7F <= c <= 0xA0 and c not in (0x27, 0x130)]
WHITE, LETTER, NUMBER, OTHER, WHOLE = range(5)


def _kind(c: int) -> int:
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By byte: its kind, its lower case. By two bytes of a plain character beyond ASCII: its kind (0: not plain), its lower case."""
    kind, lower = np.full(256, WHOLE, np.uint8), np.arange(256, dtype=np.uint8)
    kind[list(b" \t\n\x0b\x0c\r")] = WHITE
    kinds, lowers = np.zeros(1 << 16, np.uint8), np.zeros((1 << 16, 2), np.uint8)
    for c in PLAIN:
        if c < 0x80:
            kind[c], lower[c] = _kind(c), ord(chr(c).lower())
        else:
            at = int.from_bytes(chr(c).encode(), "big")
            kinds[at], lowers[at] = _kind(c), list(chr(c).lower().encode())
    return kind, lower, kinds, lowers


KIND, LOWER, KINDS, LOWERS = _tables()
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of a text: its bytes in lower case, and the start, size and kind of every piece.

    A piece is a run of letters, one number, or a run of other signs; a word with a character that is not plain, with an
    apostrophe or with the start of a special token is one piece of kind ``WHOLE`` and keeps its case.
    """
    kind, low = KIND[data], LOWER[data]
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[lead + 1 < len(data)]
    pair = data[lead].astype(np.int64) << 8 | data[lead + 1]
    fine = KINDS[pair] > 0
    lead, pair = lead[fine], pair[fine]
    kind[lead] = kind[lead + 1] = KINDS[pair]
    low[lead], low[lead + 1] = LOWERS[pair].T
    change = np.append(True, kind[1:] != kind[:-1])
    change |= kind == NUMBER
    change[lead + 1] = False
    odd = kind == WHOLE
    odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    odd = np.flatnonzero(odd)
    if len(odd):
        # the words that hold these bytes
        gap = np.flatnonzero(kind == WHITE)
        place = np.unique(np.searchsorted(gap, odd))
        first = np.append(0, gap + 1)[place]
        stop = np.append(gap, len(data))[place]
        inside = np.arange(int((stop - first).sum())) + np.repeat(first - (np.cumsum(stop - first) - (stop - first)), stop - first)
        kind[inside], low[inside], change[inside], change[first] = WHOLE, data[inside], False, True
    start = np.flatnonzero(change)
    size = np.diff(np.append(start, len(data)))
    some = kind[start] != WHITE
    start, size = start[some], size[some]
    return low, start, size, kind[start]


class Encoder:
    """Ids of texts as the whole tokenizer gives them, without special tokens.

    For a file of the form above no piece spans white space and equal pieces have equal ids. Pieces are found with array
    operations, looked up by a 64-bit hash in a table of bounded size, and only those it lacks go through the merges. An
    entry may be overwritten; its piece is then merged again.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ending = spec["model"].get("end_of_word_suffix")
        steps, cuts = (spec["normalizer"] or {}).get("normalizers"), (spec["pre_tokenizer"] or {}).get("pretokenizers")
        special = all(x["content"].startswith("<|") and not x["content"].isspace() for x in spec["added_tokens"])
        self.fast = bool(ending) and steps == STEPS and cuts == CUTS and special and all(spec["model"].get(k) == v for k, v in MODEL.items())
        if self.fast:
            self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "post_processor": None}))
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for piece, k in self.bare.get_vocab().items():
                self.ends[k] = piece.endswith(ending)
            # printable bytes stand for themselves, the others follow in order from 256 on: the byte-level alphabet
            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            self.shown = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in set(shown))} | {10: 10}
            self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.count = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.arena, self.used = np.zeros(1 << 16, self.kind), 0

    def _append(self, ids: np.ndarray) -> int:
        begin, end = self.used, self.used + len(ids)
        if end > len(self.arena):
            self.arena = np.append(self.arena[:begin], np.zeros(max(begin, len(ids)), self.kind))
        self.arena[begin:end], self.used = ids, end
        return begin

    def _merged(self, pieces_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the arena and counts of the ids of pieces that were cut already."""
        at, count = [], []
        for i in range(0, len(pieces_), 4096):
            some = pieces_[i : i + 4096]
            text = b"\n".join(some).decode("latin-1").translate(self.shown)
            flat = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            stops = np.flatnonzero(self.ends[flat]) + 1
            if len(stops) != len(some):
                raise RuntimeError("the tokenizer's word ends do not part its pieces")
            first = np.append(0, stops[:-1])
            at.append(self._append(flat) + first)
            count.append(stops - first)
        return np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(count or [np.zeros(0, np.int64)])

    def _whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of whole words by the whole tokenizer."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        count = np.array([len(x) for x in ids], np.int64)
        return self._append(np.array([k for x in ids for k in x], self.kind)) + np.cumsum(count) - count, count

    def _found(self, body: np.ndarray, start: np.ndarray, size: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the arena and counts of the ids of all pieces."""
        h = mixed(size.astype(np.uint64) + (kind == WHOLE).astype(np.uint64) * np.uint64(1 << 40) + np.uint64(1))
        lanes = np.ndarray((len(body) - 7,), np.uint64, body.data, strides=(1,))
        for k in range(0, LONGEST, 8):
            some = np.flatnonzero(size > k) if k else slice(None)
            h[some] = mixed(h[some] * np.uint64(0x9E3779B97F4A7C15) ^ (lanes[start[some] + k] & MASKS[np.minimum(size[some] - k, 8)]))
        h |= np.uint64(1)  # 0 marks a free slot
        one, two = ((h >> np.uint64(s) & np.uint64(SLOTS - 1)).astype(np.int64) for s in (1, 32))
        slot = np.where(self.keys[one] == h, one, two)
        short = size <= LONGEST
        known = (self.keys[slot] == h) & short
        at, count = self.at[slot].astype(np.int64), self.count[slot].astype(np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            # long pieces are not kept; here they are told apart by themselves
            raw, mine = body.tobytes(), h[new]
            for j in np.flatnonzero(~short[new]).tolist():
                i = new[j]
                mine[j] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + size[i]], int(kind[i] == WHOLE))
            _, first, back = np.unique(mine, return_index=True, return_inverse=True)
            first = new[first]
            where, n = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            for whole in (False, True):
                which = np.flatnonzero((kind[first] == WHOLE) == whole)
                if len(which):
                    f = first[which]
                    cut = [raw[a:b] for a, b in zip(start[f].tolist(), (start[f] + size[f]).tolist(), strict=True)]
                    where[which], n[which] = (self._whole if whole else self._merged)(cut)
            at[new], count[new] = where[back], n[back]
            keep = short[first]
            f, where, n = first[keep], where[keep], n[keep]
            free = np.where((self.keys[one[f]] != 0) & (self.keys[two[f]] == 0), two[f], one[f])
            self.keys[free], self.at[free], self.count[free] = h[f], where, n
            # of pieces dealt to one slot the last written stays; its key, place and count must be one piece's
            lost = self.keys[free] != h[f]
            free, f, where, n = free[~lost], f[~lost], where[~lost], n[~lost]
            self.at[free], self.count[free] = where, n
        return at, count

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each followed by ``end`` if given, and the number of each text's."""
        more = [] if end is None else [end]
        if not self.fast:
            ids = [e.ids + more for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
            return np.array([k for x in ids for k in x], self.kind), np.array([len(x) for x in ids], np.int64)
        if self.used > ARENA:
            self._clear()
        joined = b"\n".join(texts)
        body, start, size, kind = runs(np.frombuffer(joined + b"\n", np.uint8))
        at, count = self._found(np.append(body, np.zeros(LONGEST, np.uint8)), start, size, kind)
        edges = np.searchsorted(start, np.append(0, np.cumsum([len(t) + 1 for t in texts])))
        n = np.diff(np.append(0, np.cumsum(count))[edges]) + len(more)
        text = np.repeat(np.arange(len(texts)), np.diff(edges))
        begin = np.cumsum(count) - count + text * len(more)
        out = np.full(int(n.sum()), 0 if end is None else end, self.kind)
        total = int(count.sum())
        step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(begin, count) + step] = self.arena[np.repeat(at, count) + step]
        return out, n


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder; it outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: Signs that are added before a dimension's 16 bits may overflow.
LANE = 60_000


def directions(vocabulary: int, dimensions: int = DIMENSIONS, seed: int = 5) -> np.ndarray:
    """A random sign in each dimension for every id: bit 0 of a 16-bit lane of its own."""
    bits = np.random.default_rng(seed).integers(0, 2, (vocabulary, dimensions), dtype=np.uint64)
    return (bits << (np.uint64(16) * np.arange(dimensions, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def projected(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The mean sign of each run of ``sizes`` ids in every dimension; zero for an empty one. ``flat`` has the ids' signs."""
    some = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), DIMENSIONS), np.float32)
    if len(some):
        parts = -(-sizes[some] // LANE)
        begin = np.repeat((np.cumsum(sizes) - sizes)[some], parts)
        first = np.cumsum(parts) - parts
        cuts = begin + LANE * (np.arange(len(begin)) - np.repeat(first, parts))
        ones = np.add.reduceat(flat, cuts).view("<u2").reshape(-1, 4)[:, :DIMENSIONS].astype(np.int64)
        out[some] = 2 * np.add.reduceat(ones, first, axis=0) / sizes[some][:, None] - 1
    return out


def hilbert(cells: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Places on the Hilbert curve of rows of whole coordinates below ``2 ** depth`` (Skilling's transform, 2004)."""
    x = cells.astype(np.int64).T.copy()
    n, q = len(x), 1 << depth - 1
    while q > 1:
        for i in range(n):
            flip, swap = (x[i] & q) != 0, (x[0] ^ x[i]) & (q - 1)
            x[0] ^= np.where(flip, q - 1, swap)
            if i:
                x[i] ^= np.where(flip, 0, swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << depth - 1
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def tokenized(docs: DataFrame, path: str, end: int | None = END) -> DataFrame:
    """(doc_id, ids, tokens, tie, p0…): little-endian ids with the end id, and the projected point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(path), 0
        signs = directions(enc.tokenizer.get_vocab_size())
        for batch in batches:
            for part in pieces(batch, 1, PIECE):
                flat, n = enc.encode(byte_rows(part.column(1)), end)
                point = projected(signs[flat], n)
                tie = (np.arange(row, row + len(n), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                row += len(n)
                stops = np.append(0, np.cumsum(n) * enc.kind.itemsize)
                ids = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(stops), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(n), pa.array(tie), *map(pa.array, point.T.copy())], names=["doc_id", "ids", "tokens", "tie", *(f"p{k}" for k in range(DIMENSIONS))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    points = ", ".join(f"p{k} float" for k in range(DIMENSIONS))
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, tokens bigint, tie bigint, {points}")


def curve_key(rows: DataFrame) -> tuple[Column, int]:
    """The Hilbert key of the projected points, each dimension centred and scaled over all documents first, and the ids of all."""
    *stats, total = rows.agg(*[f(f"p{k}") for k in range(DIMENSIONS) for f in (F.avg, F.stddev_pop)], F.sum("tokens")).first()
    mean, spread = (np.array([x or 0.0 for x in stats[i::2]]) for i in (0, 1))
    spread[spread == 0] = 1

    @F.arrow_udf("bigint")
    def key(*p: pa.Array) -> pa.Array:
        z = (np.stack([np.asarray(x, np.float64) for x in p], axis=1) - mean) / spread
        cells = np.clip((1 / (1 + np.exp(-1.7 * z))) * (1 << DEPTH), 0, (1 << DEPTH) - 1)
        return pa.array(hilbert(cells))

    return key(*[F.col(f"p{k}") for k in range(DIMENSIONS)]), total or 0


def fill(batches: Iterator[pa.RecordBatch], kind: np.dtype, length: int, first_id: int) -> Iterator[pa.RecordBatch]:
    """Write documents end to end into sequences; columns (doc_id, ids, tokens) in, pieces out."""
    sequence, open_, used = first_id, [], 0

    def rows(out: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], doc_type), *(pa.array(c, pa.int64()) for c in cols[1:6]), pa.array(cols[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    doc_type = None
    for batch in batches:
        doc_type, out, size = batch.schema.field(0).type, [], 0
        for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            wide = np.frombuffer(ids, kind).astype("<u4").tobytes()
            total, at = len(wide) // 4, 0
            while at < total:
                n = min(total - at, length - used)
                open_.append((doc, at, n, total, sequence, used, wide[4 * at : 4 * (at + n)]))
                at, used = at + n, used + n
                if used == length:
                    out += open_
                    sequence, open_, used = sequence + 1, [], 0
            size += len(wide)
            if size > 1 << 23 and out:
                yield rows(out, doc_type)
                out, size = [], 0
        if out:
            yield rows(out, doc_type)
    # the rest: sequences of powers of two, the largest first
    out, used, left = [], 0, used
    room = 1 << left.bit_length() - 1 if left else 0
    for doc, at, n, total, _, _, wide in open_:
        done = 0
        while done < n:
            m = min(n - done, room - used)
            out.append((doc, at + done, m, total, sequence, used, wide[4 * done : 4 * (done + m)]))
            done, used = done + m, used + m
            if used == room:
                left, sequence, used = left - room, sequence + 1, 0
                room = 1 << left.bit_length() - 1 if left else 0
    if out:
        yield rows(out, doc_type)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int | None = END) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids); ids are little-endian unsigned 32-bit.

    Each id of each document lies in one piece. A null or empty text is the end id alone; copies and repeated rows are
    packed one by one, dealt apart by a tie key; an empty table gives no piece. Extra columns are ignored.
    """
    wide = np.dtype("<u2") if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
    rows = stash(tokenized(docs, path, end), "tokens")
    key, total = curve_key(rows)
    order = rows.select("doc_id", "ids", "tokens", "tie", key.alias("key"))
    order = order.repartitionByRange(math.ceil(total / SHARE) or 1, "key", "tie").sortWithinPartitions("key", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fill(batches, wide, length, TaskContext.get().partitionId() << 40)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return order.select("doc_id", "ids", "tokens").mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), default_tokenizer())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
