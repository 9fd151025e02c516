"""Repeated strings by brute force: ids of other types, an anchor in very many different contexts, long texts."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from driftwell.llm import suffix_dedup


def brute(rows):
    """(removed bytes, digest of the rest) by id, in the order of ids, by the plain meaning of the rule."""
    seen, out = set(), {}
    for doc, text in rows:
        raw = text.encode()
        cover = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                cover[s] += 1
                cover[s + 100] -= 1
            seen.add(raw[s : s + 100])
        gone = np.cumsum(cover)[:-1] > 0
        out[doc] = (int(gone.sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def noise(rng, n):
    return "".join(rng.choice("abcdefgh ") for _ in range(n))


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_passage_in_many_contexts(spark, kind):
    """With every document sampled, anchors of the passage that all documents share go string by string; so do few or none."""
    rng = random.Random(5)
    passage = noise(rng, 260)
    rows = [(f"d{k:04d}" if kind == "string" else k, noise(rng, rng.randrange(150)) + passage + noise(rng, rng.randrange(150))) for k in range(120)]
    expected = brute(rows)
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5)
    narrow = docs.selectExpr("xxhash64(doc_id) AS doc", "text", "xxhash64(text) AS th")
    assert len(suffix_dedup.frequent_anchors(narrow, 1, 20)) > 0
    for share, often in ((1, 20), (1, 1), (64, 32)):
        found = suffix_dedup.repeated_spans(docs, share, often).collect()
        assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in found} == expected, (share, often)
        assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in found)
    assert suffix_dedup.drop_repeats(docs, 1, 20).columns == ["doc_id", "text"]


def test_text_beyond_a_piece(spark, monkeypatch):
    """Texts longer than what is handled at once, one that repeats within itself and one that repeats another's end."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 10)
    rng = random.Random(6)
    long = noise(rng, 9000)
    rows = [(1, long), (2, long[:3000] + noise(rng, 50) + long[:3000]), (3, noise(rng, 20) + long[-400:]), (4, "ab" * 700), (5, "é" * 400)]
    found = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in found} == brute(rows)


def test_memory_of_a_shard():
    rng = np.random.default_rng(5)
    sizes = np.full(2000, 150)
    data = rng.integers(97, 123, int(sizes.sum()), np.uint8)
    data[-3000:] = data[:3000]
    tracemalloc.start()
    try:
        which, offset = suffix_dedup.marked(sizes, data, np.arange(len(sizes)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(zip(which.tolist(), offset.tolist(), strict=True)) == [(k, x) for k in range(1980, 2000) for x in range(51)]
    # two workers of an executor search shards of several MB at a time
    assert peak < 70 * len(data)
