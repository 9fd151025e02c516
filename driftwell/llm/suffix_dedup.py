"""Removal of repeated byte strings by sharded suffix arrays.

A string of ``length`` bytes that occurs twice has the same least-hashed ``GRAM``-gram in both places, so its occurrences
meet under that anchor. Consecutive strings with one anchor form a context. Contexts are reduced where they are made and
again by anchor: of equal ones only the earliest goes on, the rest are repeats throughout. Anchors that still have
several contexts have their bytes fetched and dealt to shards by anchor. A shard writes its contexts end to end, builds
their suffix array by induced sorting, takes the common prefixes of neighbours in text order, and marks every string
that equals one that starts earlier. Documents then lose the union of the marked strings.

Contexts are told apart by 64 bits of digest beside their anchor: among ``m`` different contexts of one anchor the odds of
a false removal are below ``m * m / 2 ** 65``, three in a million for ten million contexts.

An anchor at the edge of a passage that very many documents share has as many different contexts. A sample of the
documents finds such anchors; it only decides the way, never a result. Their contexts are split into single strings, which
are dealt by a digest of 128 bits and reduced to the earliest, so no anchor gathers in a task.

Contexts, strings, spans and requests travel as records in binary slices of one buffer, without a step for each slice.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from driftwell.llm.base import byte_rows, pieces, table
from driftwell.llm.sais import long_prefixes, places, suffix_array
from driftwell.storage import stash

LENGTH, GRAM = 100, 24
#: Windows of a context, at most; longer runs of one anchor are cut.
RUN, INNER = 120, 128
#: Bytes of text handled at once, and per packed row; bytes of text per bucket; bytes of contexts per shard.
PIECE, PACK, BUCKET, SHARD = 1 << 20, 32 << 20, 16 << 20, 2 << 20
LEAST_BUCKETS = 48
#: One document in so many is sampled for anchors with many contexts; an anchor with so many in the sample is one, and of
#: those the most frequent are listed, so many at most.
SHARE, OFTEN, LISTED = 64, 32, 100_000
LAST = np.iinfo(np.int64).max

PLACE = [("doc", "<i8"), ("th", "<i8"), ("home", "<i4"), ("start", "<i4")]
CONTEXT = np.dtype([*PLACE, ("run", "u1"), ("anchor", "<u8"), ("digest", "<u8")])
STRING = np.dtype([*PLACE, ("digest", "<u8"), ("second", "<u8")])
SPAN = np.dtype([*PLACE, ("stop", "<i4")])
#: Kinds of rows.
CONTEXTS, STRINGS, SPANS, WANTED = range(4)
ROWS = "key bigint, home bigint, kind int, size bigint, records binary, bytes binary"


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


GRAM_TABLE, TEXT_TABLE, SECOND_TABLE = _table(11), _table(12), _table(13)
BASE, TEXT_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the text base and of its inverse, modulo 2 to the 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(TEXT_BASE, -1, 1 << 64)
        steps = np.full(max(n, PIECE + LENGTH), 1, np.uint64)
        _POWERS[:] = [np.cumprod(np.append(steps[:1], steps[1:] * np.uint64(b))) for b in (TEXT_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed hash of every ``gram`` consecutive bytes."""
    doubled, power, m = {1: GRAM_TABLE[data]}, {1: BASE}, 1
    while 2 * m <= gram:
        h = doubled[m]
        doubled[2 * m], power[2 * m] = h[: len(h) - m] * np.uint64(power[m]) + h[m:], power[m] ** 2 % (1 << 64)
        m *= 2
    n, at, left = len(data) - gram + 1, 0, gram
    out = np.zeros(n, np.uint64)
    for m in sorted(doubled, reverse=True):
        if left >= m:
            out = out * np.uint64(power[m]) + doubled[m][at : at + n]
            at, left = at + m, left - m
    return _mix(out)


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    span, now = 1, h
    while 2 * span <= width:
        now, span = np.minimum(now[: len(now) - span], now[span:]), 2 * span
    n = len(h) - width + 1
    return np.minimum(now[:n], now[width - span : width - span + n])


def contexts(texts: list[bytes], hot: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """All strings of ``length`` bytes: those joined by anchor as (text index, first start, windows, anchor, digest), and
    those whose anchor is in ``hot`` one by one as (text index, start, digest, second digest).

    ``INNER`` is added to the windows of a context that has its anchor twice, as one that repeats within itself has.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    none, hashed = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    nothing = (none, none, none, hashed, hashed), (none, none, hashed, hashed)
    if len(data) < length:
        return nothing
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    hashes = gram_hashes(data, gram)
    least = sliding_least(hashes, length - gram + 1)
    at = np.flatnonzero(ends[owner[: len(least)]] - np.arange(len(least)) >= length)
    if not len(at):
        return nothing
    least = least[at]
    new = np.append(True, (least[1:] != least[:-1]) | (np.diff(at) != 1))
    # a run ends after RUN windows at the latest
    first = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(inside % RUN == 0)
    run = np.diff(np.append(first, len(at)))
    begin, anchor = at[first], _mix(least[first] + np.uint64(1))
    power, inverse = powers(len(data))
    sums = np.append(np.uint64(0), np.cumsum(TEXT_TABLE[data] * power))
    often = np.isin(anchor, hot) if len(hot) else np.zeros(len(anchor), bool)
    singles = nothing[1]
    if often.any():
        w = np.repeat(begin[often] - (np.cumsum(run[often]) - run[often]), run[often]) + np.arange(int(run[often].sum()))
        more = np.append(np.uint64(0), np.cumsum(SECOND_TABLE[data] * power))
        singles = owner[w], w - (ends - sizes)[owner[w]], *(_mix((x[w + length] - x[w]) * inverse[w]) for x in (sums, more))
        begin, anchor, run, first = begin[~often], anchor[~often], run[~often], first[~often]
    stop = begin + run + length - 1
    digest = _mix(((sums[stop] - sums[begin]) * inverse[begin]) ^ (run.astype(np.uint64) << np.uint64(40)))
    grams = run + length - gram
    twice = np.zeros(0, bool)
    if len(run):
        at = np.arange(int(grams.sum())) + np.repeat(begin - (np.cumsum(grams) - grams), grams)
        twice = np.add.reduceat(hashes[at] == np.repeat(least[first], grams), np.cumsum(grams) - grams, dtype=np.int64) > 1
    doc = owner[begin]
    return (doc, begin - (ends - sizes)[doc], run + INNER * twice, anchor, digest), singles


def earliest(x: np.ndarray) -> np.ndarray:
    """The rank of each place: by document, null ids last, then start. Equal places, of repeated rows, rank alike."""
    order = np.lexsort((x["start"], x["th"], x["doc"]))
    new = np.zeros(len(order), np.int64)
    for name in ("doc", "th", "start"):
        y = x[name][order]
        new[1:] |= y[1:] != y[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def repeats(x: np.ndarray, keys: tuple[str, str]) -> np.ndarray:
    """True for those of the records with equal ``keys`` that do not stand in the earliest place."""
    a, b = x[keys[0]], x[keys[1]]
    order = np.argsort(a ^ b * np.uint64(BASE), kind="stable")
    # only records whose mixed keys occur twice need to be ranked
    h = (a ^ b * np.uint64(BASE))[order]
    same = h[1:] == h[:-1]
    some = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    out = np.zeros(len(x), bool)
    if len(some):
        y = x[some]
        rank = earliest(y)
        o = np.lexsort((rank, y[keys[1]], y[keys[0]]))
        first = np.append(True, (y[keys[0]][o][1:] != y[keys[0]][o][:-1]) | (y[keys[1]][o][1:] != y[keys[1]][o][:-1]))
        out[some[o]] = rank[o] != rank[o][np.flatnonzero(first)][np.cumsum(first) - 1]
    return out


def spans_of(x: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """The spans of ``size`` bytes from the records' starts; spans that adjoin or overlap in a batch's order are one."""
    x = x if isinstance(size, np.ndarray) else x[np.lexsort((x["start"], x["th"], x["doc"]))]
    out = np.zeros(len(x), SPAN)
    for name, _ in PLACE:
        out[name] = x[name]
    out["stop"] = x["start"] + size
    if not isinstance(size, np.ndarray) and len(out):
        new = np.append(True, (out["doc"][1:] != out["doc"][:-1]) | (out["th"][1:] != out["th"][:-1]) | (out["start"][1:] > out["stop"][:-1]))
        first = np.flatnonzero(new)
        stop = out["stop"][np.append(first[1:], len(out)) - 1]
        out = out[first]
        out["stop"] = stop
    return out


def _slices(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The runs of ``values`` between ``cuts`` as binary values of one buffer."""
    stops = np.append(cuts, len(values)).astype(np.int64) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(stops), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def rows_by(key: np.ndarray, kind: int, records: np.ndarray, sizes: np.ndarray | None = None, home: bool = False) -> pa.RecordBatch:
    """One row for each value of ``key`` with its records; ``home`` tells whether that value is a home."""
    order = np.argsort(key, kind="stable")
    key, records = key[order], records[order]
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.add.reduceat(sizes[order], cuts) if sizes is not None and len(cuts) else np.zeros(len(cuts), np.int64)
    at = pa.array(key[cuts].astype(np.int64))
    return pa.RecordBatch.from_arrays([at, at if home else pa.nulls(len(cuts), pa.int64()), pa.array(np.full(len(cuts), kind, np.int32)), pa.array(size.astype(np.int64)), _slices(records, cuts), pa.nulls(len(cuts), pa.binary())], names=NAMES)


NAMES = [x.split()[0] for x in ROWS.split(", ")]


def records(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(byte_rows(column)), kind)


def of_kind(rows: pa.Table, kind: int, column: str, dtype: np.dtype) -> np.ndarray:
    return records(rows.filter(pa.compute.equal(rows["kind"], kind))[column], dtype)


def _placed(dtype: np.dtype, doc: np.ndarray, th: np.ndarray, home: np.ndarray, which: np.ndarray, **values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(which), dtype)
    out["doc"], out["th"], out["home"] = doc[which], th[which], home[which]
    for name, x in values.items():
        out[name] = x
    return out


def _anchors(buckets: int, hot: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, single, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(held)
            again = repeats(x, ("anchor", "digest"))
            one, x = x[again], x[~again]
            spans = [spans_of(one, one["run"].astype(np.int64) % INNER + LENGTH - 1)]
            yield rows_by((x["anchor"] % np.uint64(buckets)).astype(np.int64), CONTEXTS, x)
            if single:
                y = np.concatenate(single)
                again = repeats(y, ("digest", "second"))
                spans.append(spans_of(y[again], LENGTH))
                yield rows_by((y["digest"][~again] % np.uint64(buckets)).astype(np.int64), STRINGS, y[~again])
            spans = np.concatenate(spans)
            yield rows_by(spans["home"], SPANS, spans, home=True)

        for batch in batches:
            for part in pieces(batch, 1, PIECE):
                texts = byte_rows(part.column(1))
                doc = np.asarray(part.column(0).fill_null(LAST), np.int64)
                th, home = (np.asarray(part.column(k), np.int64) for k in (2, 3))
                (which, at, run_, anchor, digest), (w, start, d, second) = contexts(texts, hot)
                held.append(_placed(CONTEXT, doc, th, home, which, start=at, run=run_, anchor=anchor, digest=digest))
                if len(w):
                    single.append(_placed(STRING, doc, th, home, w, start=start, digest=d, second=second))
                size += sum(map(len, texts)) + 40 * len(w)
                if size > PACK:
                    yield from flush()
                    held, single, size = [], [], 0
        if held:
            yield from flush()

    return run


def _matched(bucket: pa.Table) -> pa.Table:
    """Spans of contexts and strings that repeat earlier ones, and requests for the bytes of the other contexts whose
    anchor has several or stands in them twice."""
    x, y = of_kind(bucket, CONTEXTS, "records", CONTEXT), of_kind(bucket, STRINGS, "records", STRING)
    again = repeats(x, ("anchor", "digest"))
    one, x = x[again], x[~again]
    spans = np.concatenate((spans_of(one, one["run"].astype(np.int64) % INNER + LENGTH - 1), spans_of(y[repeats(y, ("digest", "second"))], LENGTH)))
    order = np.argsort(x["anchor"], kind="stable")
    a = x["anchor"][order]
    same = a[1:] == a[:-1]
    several = np.zeros(len(x), bool)
    several[order] = np.append(same, False) | np.append(False, same) if len(x) else False
    x = x[several | (x["run"] >= INNER)]
    x["run"] %= INNER
    passed = bucket.filter(pa.compute.equal(bucket["kind"], SPANS)).combine_chunks()
    return pa.concat_tables([passed.cast(SCHEMA), *(pa.Table.from_batches([b]).cast(SCHEMA) for b in (rows_by(spans["home"], SPANS, spans, home=True), rows_by(x["home"], WANTED, x, x["run"].astype(np.int64) + LENGTH - 1, home=True)))])


SCHEMA = pa.schema([("key", pa.int64()), ("home", pa.int64()), ("kind", pa.int32()), ("size", pa.int64()), ("records", pa.binary()), ("bytes", pa.binary())])


def doc_texts(docs: pa.Table) -> dict[tuple[int, int], bytes]:
    return dict(zip(zip(docs["doc"].fill_null(LAST).to_pylist(), docs["th"].to_pylist(), strict=True), byte_rows(docs["text"]), strict=True))


def _fetched(shards: int):  # noqa: ANN202
    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        texts, x = doc_texts(docs), records(wanted["records"], CONTEXT)
        shard = (x["anchor"] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        x, shard = x[order], shard[order]
        sizes = x["run"].astype(np.int64) + LENGTH - 1
        cut = [texts[d, t][a : a + n] for d, t, a, n in zip(x["doc"].tolist(), x["th"].tolist(), x["start"].tolist(), sizes.tolist(), strict=True)]
        rows = rows_by(shard, CONTEXTS, x)
        first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(x) else np.zeros(0, np.int64)
        data = _slices(np.frombuffer(b"".join(cut), np.uint8), (np.cumsum(sizes) - sizes)[first])
        return pa.Table.from_batches([rows.set_column(5, "bytes", data)])

    return run


def marked(sizes: np.ndarray, data: np.ndarray, rank: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of every string that equals one in an earlier place; contexts stand end to end in ``data``."""
    n, total = len(sizes), int(sizes.sum())
    t = np.zeros(total + n + 1, np.int16)
    starts = np.cumsum(sizes) - sizes + np.arange(n)
    text = np.ones(len(t), bool)
    text[starts + sizes] = text[-1] = False
    t[text] = data.astype(np.int16) + 2
    t[(starts + sizes)] = 1
    del text
    sa = suffix_array(t, 258)
    before = np.full(len(t), -1, places(len(t)))
    before[sa[1:]] = sa[:-1]
    runs = sizes - length + 1
    equal = np.zeros(len(t), bool)
    which = np.arange(n)
    for k, common in enumerate(long_prefixes(t, before, starts, runs, length)):
        which = which[runs[which] > k]
        equal[starts[which] + k] = common >= length
    del before
    # strings in suffix order: a group shares its first bytes
    offset = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    home = np.repeat(np.arange(n), runs)
    valid = np.zeros(len(t), bool)
    valid[starts[home] + offset] = True
    back = np.zeros(len(t), places(len(t)))
    back[starts[home] + offset] = np.arange(len(home))
    p = sa[valid[sa]]
    w = back[p]
    key = rank[home[w]] * (RUN + 1) + offset[w]
    first = np.flatnonzero(~equal[p])
    least = np.repeat(np.minimum.reduceat(key, first), np.diff(np.append(first, len(p)))) if len(p) else key
    gone = np.sort(w[key != least])
    return home[gone], offset[gone]


def _searched(shard: pa.Table) -> pa.Table:
    x, data = records(shard["records"], CONTEXT), np.frombuffer(b"".join(byte_rows(shard["bytes"])), np.uint8)
    which, offset = marked(x["run"].astype(np.int64) + LENGTH - 1, data, earliest(x))
    new = np.append(True, (which[1:] != which[:-1]) | (np.diff(offset) != 1)) if len(which) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(which))[: len(first)] - 1
    y = x[which[first]]
    y["start"] += offset[first].astype(np.int32)
    spans = spans_of(y, offset[last] - offset[first] + LENGTH)
    return pa.Table.from_batches([rows_by(spans["home"], SPANS, spans, home=True)])


def union(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by spans; adjoining spans form one."""
    order = np.argsort(start, kind="stable")
    a, b = start[order], np.maximum.accumulate(stop[order])
    first = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    return list(zip(a[first].tolist(), b[np.append(first[1:], len(a)) - 1].tolist(), strict=True))


def spans_by_text(spans: pa.Table) -> dict[tuple[int, int], list[tuple[int, int]]]:
    x = records(spans["records"], SPAN)
    if not len(x):
        return {}
    x = x[np.lexsort((x["start"], x["th"], x["doc"]))]
    cuts = np.flatnonzero(np.append(True, (x["doc"][1:] != x["doc"][:-1]) | (x["th"][1:] != x["th"][:-1])))
    return {(int(x["doc"][a]), int(x["th"][a])): union(x["start"][a:b], x["stop"][a:b]) for a, b in zip(cuts, [*cuts[1:], len(x)], strict=True)}


def without(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in gone:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _removed(docs: pa.Table, spans: pa.Table) -> pa.Table:
    found, rows = spans_by_text(spans), []
    for d, th, text in zip(docs["__dw_doc"].fill_null(LAST).to_pylist(), docs["__dw_th"].to_pylist(), byte_rows(docs["text"]), strict=True):
        gone = found.get((d, th), [])
        rows.append((th, len(text), sum(b - a for a, b in gone), hashlib.sha256(without(text, gone)).hexdigest(), gone))
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    spans_ = pa.array([[{"start": a, "stop": b} for a, b in g] for g in cols[4]], kind)
    return pa.Table.from_arrays([docs["doc_id"], *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), spans_], names=["doc_id", "th", "n_bytes", "n_removed", "kept_sha256", "spans"])


def whole_characters(text: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the characters that they cover in part."""
    out = []
    for a, b in gone:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def _cut(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """The documents with their repeated characters taken out; those of which nothing is left go."""
    found, texts, keep = spans_by_text(spans), [], []
    for d, th, text in zip(docs["__dw_doc"].fill_null(LAST).to_pylist(), docs["__dw_th"].to_pylist(), byte_rows(docs["text"]), strict=True):
        left = without(text, whole_characters(text, found.get((d, th), [])))
        texts.append(left.decode("utf-8", "replace"))
        keep.append(bool(left) or not text)
    at = docs.schema.get_field_index("text")
    nulls = docs["text"].is_null().to_pylist()
    out = docs.set_column(at, "text", pa.array([None if n else t for n, t in zip(nulls, texts, strict=True)], pa.string()))
    if "n_chars" in docs.schema.names:
        field = docs.schema.field("n_chars")
        out = out.set_column(docs.schema.get_field_index("n_chars"), field, pa.array([None if n else len(t) for n, t in zip(nulls, texts, strict=True)], field.type))
    return out.filter(pa.array(keep)).drop_columns(["__dw_doc", "__dw_th", "__dw_home"])


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__dw_doc``, a number in the order of doc_id: whole numbers are their own, other ids are counted off."""
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return docs.withColumn("__dw_doc", F.col("doc_id").cast("long"))
    ids = docs.select("doc_id").where("doc_id is not null").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ids = stash(ids.select(F.col("doc_id").alias("__dw_id"), F.monotonically_increasing_id().alias("__dw_doc")), "repeats-ids")
    return docs.join(ids, docs["doc_id"] == ids["__dw_id"], "left").drop("__dw_id")


def frequent_anchors(narrow: DataFrame, share: int = SHARE, often: int = OFTEN, most: int = LISTED) -> np.ndarray:
    """Anchors with many different contexts in a sample of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 0, PIECE):
                (_, _, _, anchor, digest), _ = contexts(byte_rows(part.column(0)), np.zeros(0, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64))], names=["anchor", "digest"])

    some = narrow.where(F.pmod(F.xxhash64(F.lit(29), "doc", "th"), F.lit(share)) == 0).select("text").mapInArrow(run, "anchor bigint, digest bigint").distinct()
    found = some.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= often).orderBy(F.desc("n"), "anchor").limit(most).collect()
    return np.sort(np.array([r["anchor"] for r in found], np.int64).view(np.uint64))


def _spans(docs: DataFrame, share: int, often: int) -> tuple[DataFrame, DataFrame]:
    """The documents with ``__dw_doc``, ``__dw_th`` and ``__dw_home``, and the spans of their repeats by home."""
    d = numbered(docs).withColumn("__dw_th", F.coalesce(F.xxhash64("text"), F.lit(0)))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(total / BUCKET))
    d = d.withColumn("__dw_home", F.pmod(F.xxhash64("__dw_doc", "__dw_th"), F.lit(buckets)))
    narrow = d.select(F.col("__dw_doc").alias("doc"), "text", F.col("__dw_th").alias("th"), F.col("__dw_home").alias("home"))
    anchors = narrow.mapInArrow(_anchors(buckets, frequent_anchors(narrow, share, often)), ROWS)
    found = stash(anchors.groupBy("key").applyInArrow(_matched, ROWS), "repeats")
    wanted = found.where(F.col("kind") == WANTED)
    size = wanted.agg(F.sum("size")).first()[0] or 0
    cut = narrow.groupBy("home").cogroup(wanted.groupBy("home")).applyInArrow(_fetched(max(1, math.ceil(size / SHARD))), ROWS)
    more = stash(cut.groupBy("key").applyInArrow(_searched, ROWS), "repeats")
    return d, found.where(F.col("kind") == SPANS).unionByName(more)


def repeated_spans(docs: DataFrame, share: int = SHARE, often: int = OFTEN) -> DataFrame:
    """(doc_id, th, n_bytes, n_removed, kept_sha256, spans): the runs of bytes covered by strings that occur earlier.

    ``th`` is the hash of the text. A null or empty text has no bytes. Rows that repeat an id and a text are one
    document; those that repeat only an id come in the order of ``th``; null ids come last. Ids of any type that has an
    order will do. An empty table gives an empty result, extra columns are ignored. ``share`` and ``often`` decide which
    anchors are split further, not the result.
    """
    d, spans = _spans(docs.select("doc_id", "text"), share, often)
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th bigint, n_bytes bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>"
    return d.groupBy("__dw_home").cogroup(spans.groupBy("home")).applyInArrow(_removed, kind)


def drop_repeats(docs: DataFrame, share: int = SHARE, often: int = OFTEN) -> DataFrame:
    """The documents without what ``repeated_spans`` finds, in whole characters; columns as they are.

    ``n_chars``, if there, follows the text. A document of which nothing is left goes.
    """
    d, spans = _spans(docs, share, often)
    return d.groupBy("__dw_home").cogroup(spans.groupBy("home")).applyInArrow(_cut, docs.schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
