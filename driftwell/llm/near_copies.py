"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found exactly.

Equal sets are one node. Each has a 64-bit fingerprint, the majority bits of its shingles. A tree deals the sets to leaves:
a node holds a vantage point and a radius, or a bound on sizes, and what may be similar to sets of the other side goes to both.
A node is split only where that saves comparisons; leaves are compared exhaustively, block by block. They return links that
span the pairs within 1, 4, 7 bits and so on up to ``REACH``, and a link stays if its two sets are similar. At 0.8 fingerprints differ in 9.7
bits on average, so some similar pairs lie beyond any radius that tells them from unrelated ones.

These are found by shared shingles, and only where they would link two components of the links that stayed. Shingles are put in one order for all texts, common ones last (counted in a sample, which decides
only the order, never the result). Two sets that are similar enough share a shingle among the first fifth of each, so only
texts that share such a shingle are compared. Small groups give pairs of like size, which go on to their whole sets unless
their sketches differ in more bits than similar sets can differ in members. Large groups are compared block by block in two
steps: sketches tell which members may be similar to one of another component, and a pair of blocks of these returns links that
span its similar pairs. This is done for each set's largest group first; of the other groups only what may link two components
of all links so far is compared again. Links are closed to components in one task if few, else by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.base import byte_rows, pieces
from driftwell.llm.simhash import PIECE, distance, majorities, shingle_hashes
from driftwell.operators.components import connected_components
from driftwell.storage import broadcast_checked, drop_stash, in_few_tasks, stash

WIDTH = 5
#: Fingerprints are looked for within so many bits. This decides which path finds a pair, never whether it is found.
REACH, STEP = 13, 3
#: The tree is fitted on about so many sets at most, all are dealt by it; larger leaves are compared by blocks of so many.
FITTED, LEAF = 20_000, 16_384
#: Vantage points tried for a node, the least share of its comparisons that a split must save, and fingerprints compared at a time.
TRIES, SAVED, CELLS = 6, 0.1, 1 << 18
#: The sample that finds common shingles: so many documents and one in ``SHARE`` at least, so that groups of shingles it
#: misses do not grow with the input; those in which one is common, and how many of the commonest count.
SAMPLE, SHARE, COMMON, MOST_COMMON = 5_000, 8, 3, 200_000
#: Larger groups are compared by blocks of about so many texts.
SMALL, BLOCK = 64, 1024
#: Least and most bits of a set's sketch, the parities of its members by residue; between them, one or two a member.
BITS, MOST_BITS = 512, 1 << 15
#: Links that are closed to components in one task; more go through star contraction.
CLOSED = 500_000
#: Shingles that a block's matrix holds at a time, and rows of it that are judged at a time.
COLUMNS, ROWS = 2048, 128


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes ``a`` and ``b`` with so many members in common have a Jaccard similarity of 0.8 at least."""
    return 9 * shared >= 4 * (a + b)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; none for one without words."""
    h, counts = shingle_hashes(texts, WIDTH)
    return [np.unique(x) for x in np.split(h.view(np.int64), np.cumsum(counts)[:-1])] if texts else []


def key_of(shingles: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(shingles.tobytes()), np.uint64).view(np.int64))


def sketch(shingles: np.ndarray) -> bytes:
    bits = min(MOST_BITS, max(BITS, 1 << (len(shingles) - 1).bit_length()))
    return np.packbits(np.bincount(shingles & (bits - 1), minlength=bits).astype(np.uint8) & 1).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """At least so many members are in one of two sets only; the longer sketch is folded to the shorter's residues."""
    a, b = sorted((a, b), key=len)
    y = np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, len(a) // 8), axis=0)
    return int(np.bitwise_count(np.frombuffer(a, np.uint64) ^ y).sum(dtype=np.int64))


def leading(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the order for all texts, one of which every similar set has among its own first ones."""
    n = len(shingles)
    most = n - (4 * n + 4) // 5 + 1
    if n and len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        place = np.where(common[at] == shingles, rank[at], 0)
        if place.any():
            shingles = shingles[np.lexsort((shingles, place))]
    return shingles[:most]


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted common shingles of a sample, and each one's rank by count, from one."""
    part = min(SHARE, max(1, docs.count() // SAMPLE))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 0, PIECE):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(byte_rows(piece.column(0)))))], names=["h"])

    sampled = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0).select("text").mapInArrow(listed, "h bigint")
    found = sampled.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    order = sorted((r["h"], k) for k, r in enumerate(reversed(found), 1))
    return np.array([h for h, _ in order], np.int64), np.array([k for _, k in order], np.int64)


def with_keys(docs: DataFrame, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(doc_id, t, key, n, fp, bits, first): the text's hash, its set's key, size, fingerprint and sketch, and its first shingles."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 2, PIECE):
                sets = shingle_sets(byte_rows(piece.column(2)))
                first = pa.array([leading(s, common, rank) for s in sets], pa.list_(pa.int64()))
                n = np.array([len(s) for s in sets], np.int64)
                fp = majorities(np.concatenate(sets).view(np.uint64), n).view(np.int64)
                more = [pa.array([key_of(s) for s in sets], pa.int64()), pa.array(n), pa.array(fp), pa.array([sketch(s) for s in sets], pa.binary()), first]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *more], names=["doc_id", "t", "key", "n", "fp", "bits", "first"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(keyed, f"doc_id {kind}, t bigint, key bigint, n bigint, fp bigint, bits binary, first array<bigint>")


def sets_of(docs: DataFrame, prints: DataFrame, keys: DataFrame, rows: int) -> DataFrame:
    """(key, shingles): the sets of ``keys`` (key), from one text of each, as bytes; ``rows``: as many as there are prints."""
    one = prints.select("key", "t").join(keys, "key", "left_semi").groupBy("t").agg(F.min("key").alias("key")).groupBy("key").agg(F.min("t").alias("t"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 0, PIECE):
                sets = shingle_sets(byte_rows(piece.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array([key_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("t"), "text").join(broadcast_checked(stash(one.select("t"), "near-copies-texts", rows), 1_000_000), "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    return texts.select("text").mapInArrow(listed, "key bigint, shingles binary")


def _shingles(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in byte_rows(column)]


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.asarray(batch.column(2), np.int64) + np.asarray(batch.column(3), np.int64)
        apart = np.array([least_difference(x, y) for x, y in zip(byte_rows(batch.column(4)), byte_rows(batch.column(5)), strict=True)], np.int64)
        yes = 9 * apart <= n
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(yes))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = _shingles(batch.column(2)), _shingles(batch.column(3))
        shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
        yes = similar(shared, np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(yes))


def spanning(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the similar pairs of ``sets``, by their common members counted in matrix products."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, len(values), COLUMNS):
        lo, hi = np.searchsorted(column, (c, c + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[lo:hi], column[lo:hi] - c] = 1
        shared += m @ m.T
    near = np.zeros(shared.shape, bool)
    for r in range(0, len(sets), ROWS):
        near[r : r + ROWS] = similar(shared[r : r + ROWS].astype(np.int64), sizes[r : r + ROWS, None], sizes[None, :])
    out, rest = [], np.arange(len(sets))
    while len(rest):
        front, rest = rest[:1], rest[1:]
        root = int(front[0])
        while len(front) and len(rest):
            hit = near[np.ix_(front, rest)].any(axis=0)
            front, rest = rest[hit], rest[~hit]
            out += [(root, int(x)) for x in front]
    return out


def likely(n: np.ndarray, bits: list[bytes], part: np.ndarray) -> np.ndarray:
    """Whether each set may be similar to one of another part, by sizes and sketches."""
    out, length = np.zeros(len(n), bool), np.array([len(x) for x in bits])
    for size in np.unique(length).tolist():
        # sizes of similar sets differ by a fourth at most, so one of two such sketches is as long as the other or twice as long
        at = np.flatnonzero((length == size) | (length == 2 * size))
        at = at[np.argsort(n[at], kind="stable")]
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[k], np.uint64).reshape(-1, size // 8), axis=0) for k in at])
        sizes, parts = n[at], part[at]
        stop = np.searchsorted(4 * sizes, 5 * sizes, side="right")
        for k in np.flatnonzero(length[at] == size).tolist():
            other = np.arange(k + 1, stop[k])
            other = other[parts[other] != parts[k]]
            apart = np.bitwise_count(folded[other] ^ folded[k]).sum(axis=1, dtype=np.int64)
            other = other[9 * apart <= sizes[other] + sizes[k]]
            if len(other):
                out[at[k]] = out[at[other]] = True
    return out


def _likely(group: pa.Table) -> pa.Table:
    n, part = (np.asarray(group[k].combine_chunks(), np.int64) for k in ("n", "part"))
    return group.select(["h", "i", "j", "key"]).filter(pa.array(likely(n, byte_rows(group["bits"]), part)))


def _blocks(group: pa.Table) -> pa.Table:
    key = np.asarray(group["key"].combine_chunks(), np.int64)
    found = np.array(spanning(_shingles(group["shingles"])), np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(key[found[:, 0]], pa.int64()), "b": pa.array(key[found[:, 1]], pa.int64())})


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()


def _candidates(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """(h, i, j, key): by pair of blocks of a group (h, key, part), the sets that may be similar to one of another part."""
    groups = members.groupBy("h").agg(F.count("*").alias("m"), F.min("part").alias("least"), F.max("part").alias("most")).where("least < most")
    # a text is in one block of its group and meets each other block in one task
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = members.join(groups.select("h", blocks.alias("blocks")), "h").join(sketches, "key").withColumn("i", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("h", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "key", "part", "n", "bits")
    return stash(dealt.groupBy("h", "i", "j").applyInArrow(_likely, "h bigint, i int, j int, key bigint"), "near-copies-likely")


def choose_split(fp: np.ndarray, n: np.ndarray, rng: np.random.Generator, reach: int) -> tuple[int | None, int] | None:
    """A vantage point and radius, or None and a bound on sizes: that which leaves the least comparisons, if it saves enough."""
    best, least = None, 1 - SAVED
    sizes = np.sort(n)
    for bound in np.unique(sizes[np.linspace(0, len(sizes) - 1, 33).astype(np.int64)]).tolist():
        low, high = np.searchsorted(4 * sizes, 5 * bound, side="right"), len(sizes) - np.searchsorted(sizes, bound, side="right")
        if (left := (low / len(n)) ** 2 + (high / len(n)) ** 2) < least:
            best, least = (None, bound), left
    for v in rng.choice(fp, min(TRIES, len(fp)), replace=False):
        within = np.cumsum(np.bincount(distance(fp, v), minlength=65 + reach)) / len(fp)
        left = within[reach : 65 + reach] ** 2 + (1 - within[:65]) ** 2
        if left.min() < least:
            best, least = (int(v), int(left.argmin())), left.min()
    return best


def sides(split: tuple[int | None, int], fp: np.ndarray, n: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sets go to each side; two that are within reach and of like size are on one side together at least."""
    if split[0] is None:
        return 4 * n <= 5 * split[1], n > split[1]
    d = distance(fp, np.uint64(split[0]))
    return d <= split[1] + reach, d > split[1]


def grow(fp: np.ndarray, n: np.ndarray, leaf: int, reach: int) -> list[tuple[tuple[int | None, int], int, int]]:
    """The tree as rows (split, inner, outer); children below zero are leaves -1 - child."""
    rng, nodes, leaves = np.random.default_rng(1), [], 0

    def build(fp: np.ndarray, n: np.ndarray) -> int:
        nonlocal leaves
        split = choose_split(fp, n, rng, reach) if len(fp) > leaf else None
        if split is None:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(None)
        inner, outer = (build(fp[x], n[x]) for x in sides(split, fp, n, reach))
        nodes[at] = (split, inner, outer)
        return at

    build(fp, n)
    return nodes


def deal(nodes: list[tuple[tuple[int | None, int], int, int]], fp: np.ndarray, n: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves and the indexes of the sets that belong to them, boundary ones in more than one."""
    stack = [(0 if nodes else -1, np.arange(len(fp)))]
    while stack:
        node, rows = stack.pop()
        if node < 0:
            yield -1 - node, rows
        elif len(rows):
            split, inner, outer = nodes[node]
            stack += [(child, rows[x]) for child, x in zip((inner, outer), sides(split, fp[rows], n[rows], reach), strict=True)]


def near(fp: np.ndarray, n: np.ndarray, block: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of like size that span all such pairs within reach, and within ``STEP`` bits less, and so on, so that a
    pair that is only near by chance parts none that are nearer; of two blocks, the pairs across them."""
    order = np.argsort(n, kind="stable")
    fp, n, block = fp[order], n[order], block[order]
    two, nearest, i = len(n) and block.min() < block.max(), np.full(len(n), 255, np.uint8), 0
    stop = np.searchsorted(4 * n, 5 * n, side="right")
    while i < len(n):
        k = min(len(n), i + max(1, CELLS // int(stop[min(len(n) - 1, i + 255)] - i)), i + 256)
        to = int(stop[k - 1])
        d = distance(fp[i:k, None], fp[None, i:to])
        rows, cols = np.nonzero(d <= reach)
        yes = (cols > rows) & (cols + i < stop[rows + i])
        if two:
            yes &= block[rows + i] != block[cols + i]
        rows, cols = rows[yes], cols[yes]
        np.minimum.at(nearest, rows + i, d[rows, cols])
        np.minimum.at(nearest, cols + i, d[rows, cols])
        i = k
    a, b = [], []
    for within in range(reach, -1, -STEP):
        _span(fp, n, np.flatnonzero(nearest <= within), within, a, b)
    none = [np.zeros(0, np.int64)]
    return order[np.concatenate(a + none)], order[np.concatenate(b + none)]


def _span(fp: np.ndarray, n: np.ndarray, rest: np.ndarray, within: int, a: list[np.ndarray], b: list[np.ndarray]) -> None:
    """Add links that span the pairs among ``rest``; each set reached is tied to the nearest of those that reach it."""
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            best, of = np.full(len(rest), 255, np.uint8), np.zeros(len(rest), np.int64)
            for k in range(0, len(front), 64):
                f = front[k : k + 64, None]
                d = np.where((5 * n[f] >= 4 * n[rest]) & (5 * n[rest] >= 4 * n[f]), distance(fp[f], fp[rest]), 255).astype(np.uint8)
                at = d.argmin(axis=0)
                d = d[at, np.arange(len(rest))]
                of = np.where(d < best, f[at, 0], of)
                best = np.minimum(best, d)
            hit = best <= within
            a.append(of[hit])
            b.append(rest[hit])
            front, rest = rest[hit], rest[~hit]


def fingerprint_pairs(sets: DataFrame, reach: int) -> DataFrame:
    """Pairs (a, b) of keys that span all pairs of ``sets`` (key, n, fp) within ``reach`` bits and of like size."""
    count = sets.count()
    picked = sets.where(F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, FITTED / max(count, 1)))).select("key", "fp", "n").collect()
    sample = np.array(sorted((r["key"], r["fp"], r["n"]) for r in picked), np.int64).reshape(-1, 3)
    nodes = grow(sample[:, 1].copy().view(np.uint64), sample[:, 2], max(64, LEAF * len(sample) // max(count, 1)), reach)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, n = np.asarray(batch.column(1), np.int64), np.asarray(batch.column(2), np.int64)
            for leaf, rows in deal(nodes, fp.view(np.uint64), n, reach):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf)), *(x.take(pa.array(rows)) for x in batch.columns)], names=["leaf", "key", "fp", "n"])

    def searched(block: pa.Table) -> pa.Table:
        key, fp, n, own = (np.asarray(block[c].combine_chunks(), np.int64) for c in ("key", "fp", "n", "own"))
        a, b = near(fp.view(np.uint64), n, own, reach)
        return pa.table({"a": pa.array(np.minimum(key[a], key[b]), pa.int64()), "b": pa.array(np.maximum(key[a], key[b]), pa.int64())})

    leaves = stash(sets.select("key", "fp", "n").mapInArrow(dealt, "leaf bigint, key bigint, fp bigint, n bigint"), "near-copies-leaves", count)
    blocks = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("blocks"))
    met = leaves.join(broadcast_checked(blocks), "leaf").withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    met = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("leaf", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j"), "key", "fp", "n", "own")
    pairs = stash(met.groupBy("leaf", "i", "j").applyInArrow(searched, "a bigint, b bigint").distinct(), "near-copies-near", count)
    drop_stash(leaves)
    return pairs


def _sketched(pairs: DataFrame, sketches: DataFrame, rows: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches allow that they are similar."""
    a, b = (sketches.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"s{k}")) for k in ("a", "b"))
    alike = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb")
    return stash(alike.mapInArrow(_possible, "a bigint, b bigint"), "near-copies-pairs", rows)


def _similar(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar."""
    a, b = (whole.select(F.col("key").alias(k), F.col("shingles").alias(f"s{k}")) for k in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_compared, "a bigint, b bigint")


def _sets(docs: DataFrame, prints: DataFrame, keys: DataFrame, rows: int) -> DataFrame:
    return stash(sets_of(docs, prints, keys.distinct(), rows).dropDuplicates(["key"]), "near-copies-sets", rows)


def _sketches(prints: DataFrame, keys: DataFrame, rows: int) -> DataFrame:
    return stash(prints.select("key", "n", "bits").join(keys.distinct(), "key", "left_semi").dropDuplicates(["key"]), "near-copies-sketches", rows)


def closed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while len(a):
        # the larger root of a link goes below the smaller one, then paths are cut short
        low, high = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
        np.minimum.at(least, high, low)
        while not np.array_equal(up := least[least], least):
            least = up
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[least]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of ``links`` (a, b): as ``connected_components``, in one task if there are few."""
    if links.limit(CLOSED + 1).count() > CLOSED:
        return connected_components(links)

    def run(rows: pa.Table) -> pa.Table:
        node, component = closed(*(np.asarray(rows[c].combine_chunks(), np.int64) for c in ("a", "b")))
        return pa.table({"node": pa.array(node, pa.int64()), "component": pa.array(component, pa.int64())})

    return stash(links.where("a <> b").select("a", "b", F.lit(0).alias("all")).groupBy("all").applyInArrow(run, "node bigint, component bigint"), "near-copies-components")


def fingerprint_links(docs: DataFrame, prints: DataFrame, reach: int | None = None) -> DataFrame:
    """Links (a, b) of similar sets among those that span the pairs within ``reach`` bits."""
    count = prints.count()
    pairs = fingerprint_pairs(prints.select("key", "n", "fp").distinct(), REACH if reach is None else reach)
    possible = _sketched(pairs, sketches := _sketches(prints, _ends(pairs), count), count)
    links = stash(_similar(possible, whole := _sets(docs, prints, _ends(possible), count)), "near-copies-links", count)
    for x in (pairs, sketches, possible, whole):
        drop_stash(x)
    return links


def shared_links(docs: DataFrame, prints: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` and further ones, so that all span the pairs of similar sets: by shared shingles, across components of ``links``."""
    parts, count = components(links), prints.count()

    def parted(rows: DataFrame, key: str, part: str) -> DataFrame:
        return rows.join(parts.select(F.col("node").alias(key), F.col("component").alias(part)), key, "left").withColumn(part, F.coalesce(part, key))

    rows = prints.select("key", "n", F.explode("first").alias("h"))
    often = rows.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    met = stash(rows.join(often, "h", "left_semi").distinct(), "near-copies-met", count)
    counted = met.groupBy("h").agg(F.count("*").alias("m"))
    few = met.join(counted.where(F.col("m").between(2, SMALL)), "h", "left_semi")
    few = few.select("h", F.col("key").alias("a"), F.col("n").alias("na")).join(few.select("h", F.col("key").alias("b"), F.col("n").alias("nb")), "h")
    few = few.where("a < b and 5 * least(na, nb) >= 4 * greatest(na, nb)").select("a", "b").distinct()
    pairs = stash(parted(parted(few, "a", "pa"), "b", "pb").where("pa <> pb").select("a", "b"), "near-copies-met-pairs", count)
    many = stash(parted(met.select("h", "key").join(counted.where(F.col("m") > SMALL), "h"), "key", "part"), "near-copies-many", count)
    drop_stash(met)
    sketches = _sketches(prints, _ends(pairs).union(many.select("key")), count)
    possible = _sketched(pairs, sketches, count)
    largest = many.groupBy("key", "part").agg(F.max(F.struct("m", "h")).alias("of")).select(F.col("of.h").alias("h"), "key", "part")
    first = _candidates(largest, sketches)

    def linked(candidates: DataFrame, whole: DataFrame) -> DataFrame:
        return candidates.join(whole, "key").groupBy("h", "i", "j").applyInArrow(_blocks, "a bigint, b bigint")

    whole = _sets(docs, prints, _ends(possible).union(first.select("key")), count)
    links = stash(links.unionByName(_similar(possible, whole)).unionByName(linked(first, whole)), "near-copies-links")
    for x in (pairs, possible, whole):
        drop_stash(x)
    if many.isEmpty():
        return links
    parts = components(links)
    rest = _candidates(parted(many.select("h", "key"), "key", "part"), sketches)
    return links if rest.isEmpty() else links.unionByName(linked(rest, _sets(docs, prints, rest.select("key"), count)))


def near_copy_links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Links (a, b) of keys that span all pairs of similar sets."""
    return shared_links(docs, prints, fingerprint_links(docs, prints))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component of near copies stays: that with the least doc_id, of texts that share it the first by hash.

    Rows that repeat its doc_id and text go too. Rows with a null doc_id all stay; texts without words are copies of each
    other. Columns are as they are.
    """
    prints = stash(with_keys(docs, *common_shingles(docs)), "near-copies")
    count = prints.count()
    parts = components(stash(near_copy_links(docs, prints), "near-copies-links", count))
    classes = prints.groupBy("key").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t"))).alias("least"))
    nodes = classes.join(parts, classes["key"] == parts["node"], "left").select("least", F.coalesce("component", "key").alias("root"))
    stay = nodes.groupBy("root").agg(F.min("least").alias("least")).where("least is not null").select(F.col("least.doc_id").alias("__dw_id"), F.col("least.t").alias("__dw_kept"))
    hashed = docs.withColumn("__dw_t", F.xxhash64("text"))
    kept = hashed.join(stay, (hashed["doc_id"] == F.col("__dw_id")) & (hashed["__dw_t"] == F.col("__dw_kept")), "left_semi").dropDuplicates(["doc_id", "__dw_t"])
    # a row of whole text counts as four
    return in_few_tasks(kept.drop("__dw_t"), 4 * count).unionByName(docs.where("doc_id is null"))
