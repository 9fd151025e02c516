"""SimHash near-duplicates, paired exactly by vantage-point trees.

Every text has a 64-bit fingerprint of its word shingles. Distinct fingerprints go to shards of a vantage-point tree: a
node holds one fingerprint and a radius, and what lies within the radius goes inside. Two fingerprints at most ``reach``
bits apart can be parted by a node only if the outer one lies within radius + reach, by the triangle bound; such boundary
fingerprints go to the inner side as well, so every pair meets in a shard. In a shard the same split goes on with further
vantage points until a leaf is small or no longer falls apart, and leaves are searched exhaustively. Shards return
spanning links, not pairs; links are closed to components by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.base import byte_rows, pieces, table
from driftwell.llm.xxh import xxh64_ranges
from driftwell.operators.components import connected_components
from driftwell.storage import stash

SEED = 42
SHINGLE, REACH = 3, 3
#: Texts are fingerprinted in pieces of so many bytes.
PIECE = 1 << 20
#: The shard tree is fitted on at most so many distinct fingerprints; all are dealt by it.
SAMPLE = 200_000
#: Fingerprints that a shard should get, and those of a leaf inside a shard.
SHARD, LEAF = 6_000, 1_500
FITTED = 64
PLANE = np.uint64(0x0101010101010101)


def shingle_hashes(texts: list[bytes], width: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' shingles in order, and the number of each text's; one shingle if it has fewer words."""
    joined, counts = [], []
    for t in texts:
        words = t.lower().split()
        counts.append(len(words))
        if words:
            joined.append(b" ".join(words))
    n = np.array(counts, np.int64)
    if not joined:
        return np.zeros(0, np.uint64), n
    buffer = b" ".join(joined)
    ends = np.append(np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32), len(buffer))
    starts = np.append(0, ends[:-1] + 1)
    first = np.append(0, np.cumsum(n)[:-1])
    shingles = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    begin = np.append(0, np.cumsum(shingles)[:-1])
    # word index at which each shingle starts, and ends
    s = np.arange(int(shingles.sum())) - np.repeat(begin, shingles) + np.repeat(first, shingles)
    e = s + np.repeat(np.minimum(n, width), shingles) - 1
    return xxh64_ranges(buffer, starts[s], ends[e] - starts[s], seed), shingles


def fingerprints(texts: list[bytes], width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The unsigned fingerprint of each text: a bit is set if over half of the shingles' hashes have it."""
    return majorities(*shingle_hashes(texts, width, seed))


def majorities(h: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The bits that over half of each text's hashes have; ``shingles`` tells how many of ``h`` in turn are a text's."""
    out = np.zeros(len(shingles), np.uint64)
    if not len(h):
        return out
    with_any = np.flatnonzero(shingles)
    begin = np.append(0, np.cumsum(shingles)[:-1])
    # bytes of a word each count one bit; 255 at most are added before they are spread out
    cuts = np.concatenate([np.arange(b, b + c, 255) for b, c in zip(begin[with_any].tolist(), shingles[with_any].tolist(), strict=True)])
    owner = np.repeat(np.arange(len(with_any)), -(-shingles[with_any] // 255))
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & PLANE, cuts)
        per = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)
        on = 2 * per > shingles[with_any][:, None]
        out[with_any] |= (on.astype(np.uint64) << (np.uint64(8) * np.arange(8, dtype=np.uint64) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 1, PIECE):
            fp = fingerprints(byte_rows(part.column(1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["doc_id", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; null and empty texts have zero."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_batches, f"doc_id {kind}, fp bigint")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def choose_split(points: np.ndarray, rng: np.random.Generator, reach: int = REACH, tries: int = 6) -> tuple[np.uint64, int, float] | None:
    """A vantage point and radius: the most even split for the overlap it costs. None if nothing parts the points."""
    best = None
    probe = points if len(points) <= 2048 else rng.choice(points, 2048, replace=False)
    for v in rng.choice(points, min(tries, len(points)), replace=False):
        cum = np.cumsum(np.bincount(distance(probe, v), minlength=65 + reach + 1)) / len(probe)
        inside, wide = cum[: 65 - reach], cum[reach : 65]
        p = np.clip(inside, 1e-9, 1 - 1e-9)
        gain = -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
        cost = np.log2(1 + wide - inside) + 0.05
        score = np.where((inside > 0.02) & (wide < 0.98), gain / cost, 0.0)
        r = int(np.argmax(score))
        if score[r] > 0 and (best is None or score[r] > best[2]):
            best = (v, r, float(score[r]))
    return best


def grow(sample: np.ndarray, leaf: int, seed: int = 1) -> list[tuple[int, int, int, int]]:
    """The shard tree as rows (vantage, radius, inner, outer); children below zero are shards -1 - child."""
    rng, nodes, shards = np.random.default_rng(seed), [], [0]

    def build(points: np.ndarray) -> int:
        split = choose_split(points, rng) if len(points) > leaf else None
        if split is None:
            shards[0] += 1
            return -shards[0]
        at, d = len(nodes), distance(points, split[0])
        nodes.append(None)
        inner, outer = build(points[d <= split[1]]), build(points[d > split[1]])
        nodes[at] = (int(split[0]), split[1], inner, outer)
        return at

    build(sample)
    return nodes


def deal(nodes: list[tuple[int, int, int, int]], points: np.ndarray, reach: int = REACH) -> Iterator[tuple[int, np.ndarray]]:
    """Shards and the indexes of the points that belong to them, boundary points in more than one."""
    stack = [(0 if nodes else -1, np.arange(len(points)))]
    while stack:
        node, rows = stack.pop()
        if not len(rows):
            continue
        if node < 0:
            yield -1 - node, rows
            continue
        v, r, inner, outer = nodes[node]
        d = distance(points[rows], np.uint64(v))
        stack += [(inner, rows[d <= r + reach]), (outer, rows[d > r])]


def leaf_links(points: np.ndarray, reach: int = REACH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links among distinct points by exhaustive comparison."""
    alone = np.ones(len(points), bool)
    for i in range(0, len(points), 256):
        alone[i : i + 256] = (distance(points[i : i + 256, None], points[None, :]) <= reach).sum(axis=1) < 2
    rest = points[~alone]
    while len(rest):
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for i in range(0, len(front), 64):
                near |= (distance(front[i : i + 64, None], rest[None, :]) <= reach).any(axis=0)
            front, rest = rest[near], rest[~near]
            if len(front):
                yield np.full(len(front), root), front


def links(points: np.ndarray, reach: int = REACH, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of a shard: its own vantage-point tree down to the leaves."""
    rng, stack = np.random.default_rng(len(points)), [np.unique(points)]
    while stack:
        p = stack.pop()
        split = choose_split(p, rng, reach) if len(p) > leaf else None
        if split is not None:
            d = distance(p, split[0])
            inner, outer = p[d <= split[1] + reach], p[d > split[1]]
            if max(len(inner), len(outer)) <= 0.9 * len(p):
                stack += [inner, outer]
                continue
        yield from leaf_links(p, reach)


def near_links(distinct: DataFrame, count: int) -> DataFrame:
    """Links (a, b) that span the pairs of ``distinct`` fingerprints (fp) at most ``REACH`` bits apart."""
    size = min(SAMPLE, count)
    picked = distinct if count <= SAMPLE else distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int((1 << 30) * 0.95 * SAMPLE / count)).limit(SAMPLE)
    sample = np.sort(np.array([r[0] for r in picked.collect()], np.int64)).view(np.uint64)
    # a split is fitted on no fewer than FITTED points; beyond that shards are larger, and go on splitting by themselves
    nodes = grow(sample, max(FITTED, int(SHARD * size / max(count, 1))))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0), np.int64)
            for shard, rows in deal(nodes, fp.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard)), pa.array(fp[rows])], names=["shard", "fp"])

    def searched(shard: pa.Table) -> pa.Table:
        fp = np.asarray(shard["fp"].combine_chunks(), np.int64).view(np.uint64)
        found = list(links(fp))
        a, b = (np.concatenate([x[i] for x in found]).view(np.int64) if found else np.zeros(0, np.int64) for i in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return distinct.select("fp").mapInArrow(dealt, "shard bigint, fp bigint").groupBy("shard").applyInArrow(searched, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id that each document reaches over near fingerprints.

    Empty and null texts share the fingerprint zero and link like any other. Equal fingerprints are one node, so groups of
    copies of any size cost a row. A null doc_id is never a component's name; an empty table gives an empty result.
    """
    prints = stash(with_fingerprints(docs), "simhash")
    classes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    parts = connected_components(near_links(classes, classes.count()))
    nodes = classes.join(parts, classes["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = nodes.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group stays: that with the component's least doc_id; of rows that repeat it, one.

    Rows with a null doc_id all stay. Columns are as they are.
    """
    stay = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__dw_id"))
    kept = docs.join(stay, docs["doc_id"] == F.col("__dw_id"), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
