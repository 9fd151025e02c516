"""Near copies against brute force."""

import random

import numpy as np
import pytest

from driftwell.llm import near_copies

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "ti") for b in ("ba", "den", "fir", "gol", "hum", "jas", "pel")]
SCHEMA = "doc_id bigint, text string, source string"


def changed(words, k, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), k):
        words[at] = rng.choice(WORDS)
    return words


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def expected(rows):
    """The (doc_id, text) that stay, by brute force; of equal ids in one component any text may stay."""
    sets = sorted({shingles(t) for _, t, _ in rows}, key=sorted)
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    root = dict(zip(sets, label, strict=True))
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            r = root[shingles(text)]
            least[r] = min(least.get(r, doc), doc)
    return least, root


@pytest.mark.parametrize("small", [near_copies.SMALL, 1])
def test_near_copies_match_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    monkeypatch.setattr(near_copies, "COLUMNS", 64)
    rng = random.Random(7)
    line = " ".join(rng.choice(WORDS) for _ in range(12))
    texts = [None, "", " \n", "two words", "Two  WORDS", "a " * 50]
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(30, 160))]
        texts += [" ".join(changed(base, k, rng)) for k in (0, 0, 1, 1, 2, 3, 4, 6)]
    hot = [rng.choice(WORDS) for _ in range(120)]
    texts += [" ".join(changed(hot, rng.randrange(4), rng)) for _ in range(40)]
    texts += [line + " " + " ".join(rng.choice(WORDS) for _ in range(20)) for _ in range(30)]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    # ids that repeat: the same row, and other texts, one of them near nothing
    rows += [rows[9], (8, " ".join(rng.choice(WORDS) for _ in range(60)), "s"), (None, texts[10], "s"), (None, None, "s")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    least, root = expected(rows)
    assert sum(doc is None for doc, _ in got) == 2
    named = {root[shingles(t)]: doc for doc, t in got if doc is not None}
    assert named == least and len(got) == len(least) + 2


def test_near_copies_empty(spark):
    assert near_copies.drop_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_leading_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 60)))
        b = np.unique(np.append(rng.choice(a, max(1, int(len(a) * 0.9)), replace=False), rng.integers(0, 400, rng.integers(0, 6))))
        common = np.unique(rng.integers(0, 400, 100))
        rank = rng.permutation(len(common)) + 1
        if near_copies.similar(np.array(len(np.intersect1d(a, b))), len(a), len(b)):
            assert len(np.intersect1d(near_copies.leading(a, common, rank), near_copies.leading(b, common, rank)))


def test_sketches_never_part_similar_sets():
    rng = np.random.default_rng(2)
    for n in (0, 1, 300, 511, 512, 513, 1030, 5000):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        b = np.unique(np.append(a[: int(n * 0.92)], rng.integers(-(1 << 62), 1 << 62, n // 20)))
        assert near_copies.least_difference(near_copies.sketch(a), near_copies.sketch(b)) <= len(np.setxor1d(a, b))


def test_likely_keeps_every_similar_pair_of_two_parts():
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 5, 300, 505, 520, 1020, 1030, 2000):
        base = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        sets += [base, base[: max(1, int(n * 0.9))], np.unique(np.append(base, rng.integers(-(1 << 62), 1 << 62, n // 5)))]
    sets += [np.unique(rng.integers(-(1 << 62), 1 << 62, 400)) for _ in range(20)]
    n = np.array([len(s) for s in sets])
    part = rng.integers(0, 3, len(sets))
    got = near_copies.likely(n, [near_copies.sketch(s) for s in sets], part)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if near_copies.similar(np.array(len(np.intersect1d(sets[i], sets[j]))), n[i], n[j])]
    assert len(pairs) >= 8
    assert all(got[i] and got[j] for i, j in pairs if part[i] != part[j])
    assert not got[-20:].any() and not near_copies.likely(n, [near_copies.sketch(s) for s in sets], np.zeros(len(sets), int)).any()


def test_stage_drops_a_near_copy_that_differs_in_more_than_three_bits(spark):
    import corpus_pipeline
    from driftwell.llm import simhash

    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(100)]
    copy = next(c for c in (changed(base, 2, rng) for _ in range(1000)) if simhash.distance(*simhash.fingerprints([" ".join(base).encode(), " ".join(c).encode()])) > 3)
    a, b = shingles(" ".join(base)), shingles(" ".join(copy))
    assert len(a & b) >= 0.8 * len(a | b)
    docs = spark.createDataFrame([(1, " ".join(base), "s"), (2, " ".join(copy), "s")], SCHEMA)
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()] == [1]


def test_fingerprint_tree_spans_every_pair_within_reach(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    size = rng.integers(1, 400, 60)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)) for k in rng.integers(1, 12, 600)]
    fp, n = np.repeat(base, 10) ^ np.array(flips, np.uint64), np.maximum(1, np.repeat(size, 10) + rng.integers(-9, 9, 600))
    monkeypatch.setattr(near_copies, "CELLS", 500)
    wide = near_copies.grow(fp, n, 40, 13)
    narrow = near_copies.grow(base ^ np.uint64(1), np.full(60, 100), 8, 1)
    assert wide and any(split[0] is None for split, _, _ in wide) and any(split[0] is not None for split, _, _ in narrow)
    for nodes, sizes, reach in ((wide, n, 13), (narrow, np.full(600, 100), 1)):
        label = list(range(600))
        for _, rows in near_copies.deal(nodes, fp, sizes, reach):
            own = rng.integers(0, 2, len(rows))
            for block in (np.zeros(len(rows), int), own):
                for a, b in zip(*near_copies.near(fp[rows], sizes[rows], block, reach), strict=True):
                    i, j = rows[a], rows[b]
                    assert int(fp[i] ^ fp[j]).bit_count() <= reach and 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j])
                    old, new = label[i], label[j]
                    label = [new if x == old else x for x in label] if old != new else label
        pairs = [(i, j) for i in range(600) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= reach and 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j])]
        assert pairs and all(label[i] == label[j] for i, j in pairs)


def test_stage_gets_near_copies_by_fingerprints(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(8)
    texts = [" ".join(changed(base, k, rng)) for base in ([rng.choice(WORDS) for _ in range(150)] for _ in range(12)) for k in (0, 1, 2)]
    texts += [" ".join(rng.choice(WORDS) for _ in range(150)) for _ in range(20)]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], SCHEMA).repartition(3)
    # without the path by shared shingles, which only adds what lies beyond the radius
    monkeypatch.setattr(near_copies, "shared_links", lambda docs, prints, links: links)
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(0, 36, 3), *range(36, 56)]
    # fingerprints of one's own sets decide: with a radius that finds nothing, all stay
    monkeypatch.setattr(near_copies, "REACH", -1)
    assert near_copies.drop_near_copies(docs).count() == len(texts)


@pytest.mark.parametrize("most", [500_000, 0])
def test_components_of_few_and_many_links(spark, monkeypatch, most):
    monkeypatch.setattr(near_copies, "CLOSED", most)
    rng = np.random.default_rng(6)
    chain = [(k, k + 1) for k in range(-40, 0)]
    links = [(int(a), int(b)) for a, b in rng.permutation(chain + [(5, 9), (9, 5), (7, 9), (3, 3), *rng.integers(100, 160, (40, 2)).tolist()])]
    label = {x: x for link in links if link[0] != link[1] for x in link}
    for _ in label:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = near_copies.components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r["node"]: r["component"] for r in got.collect()} == label
    assert near_copies.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_stage_writes_small_tables_in_few_files(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for k in range(150):
        words = rng.choices(WORDS, k=60)
        rows += [(2 * k, " ".join(words), "a"), (2 * k + 1, " ".join(changed(words, 1, rng)), "a")]
    files = {}

    def stash(df, name, *more, write=near_copies.stash):
        files[name] = max(files.get(name, 0), len((out := write(df, name, *more)).inputFiles()))
        return out

    monkeypatch.setattr(near_copies, "stash", stash)
    monkeypatch.setattr(near_copies, "drop_stash", lambda df: None)
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        kept = near_copies.drop_near_copies(spark.createDataFrame(rows, SCHEMA))
        assert kept.rdd.getNumPartitions() <= 8
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(expected(rows)[0].values())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    # a core writes one file, or one for each part of a union
    assert {"near-copies-near", "near-copies-sets", "near-copies-met", "near-copies-links"} <= set(files)
    assert max(files.values()) <= 8, files
