"""What the third review found to fail or to grow too fast on larger tables."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.functions import voice as V
from driftwell.operators import blocks, clusters, extraction, filters, graph, knn, reach


def naive_items(text, patterns, shortest=20, longest=300):
    out = {}
    for m in (m.group().strip(" \t\n\r") for p in patterns for m in re.finditer(p, text)):
        if shortest <= len(m) <= longest and re.search("[a-zA-Z]", m):
            out.setdefault(m.lower(), m)
    return sorted(out.values())


@pytest.mark.parametrize(("extract", "patterns"), [(extraction.claims, extraction.CLAIMS), (extraction.hypotheses, extraction.HYPOTHESES)])
def test_runs_give_what_the_patterns_match(spark, extract, patterns):
    words = "shows proves. it\n may would if then research data suggests causes cause leads to results in . , a1 wouldif might could".split(" ")
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, rng.integers(3, 40))) for _ in range(300)]
    n = spark.createDataFrame([(f"p{k:03d}", t) for k, t in enumerate(texts)], "path string, content string")
    got = {}
    for r in extract(n).collect():
        got.setdefault(r["path"], []).append(r["item"])
    assert {p: sorted(v) for p, v in got.items()} == {f"p{k:03d}": v for k, t in enumerate(texts) if (v := naive_items(t, patterns))}


@pytest.mark.parametrize("extract", [extraction.claims, extraction.hypotheses])
def test_long_text_without_full_stops_is_read_once(spark, extract):
    n = spark.range(8).select(F.col("id").cast("string").alias("path"), F.concat(F.repeat(F.lit("words without an end "), 8000), F.lit("\nThe last of them shows that it might end.")).alias("content"))
    began = time.monotonic()
    assert extract(n).count() == 8
    assert time.monotonic() - began < 20


def vectors_of(spark, x):
    return spark.createDataFrame([(f"n{i:04d}", row.tolist()) for i, row in enumerate(x)], "path string, embedding array<double>")


def sims_of(x):
    u = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    return np.round(u @ u.T, 12)


@pytest.mark.parametrize("farthest", [False, True])
def test_nearest_with_ties(spark, farthest):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(150, 8)), np.repeat(rng.normal(size=(2, 8)), 60, axis=0), np.zeros((30, 8))])
    s = sims_of(x) * (-1 if farthest else 1)
    np.fill_diagonal(s, -9)
    v = vectors_of(spark, x)
    for columns in (v, v.where("path >= 'n0000'")):
        got = {(r["path"], r["rank"]): r["neighbour"] for r in knn.best(v, columns, 7, farthest, block=32).collect()}
        assert got == {(f"n{i:04d}", k + 1): f"n{j:04d}" for i in range(len(x)) for k, j in enumerate(np.argsort(-s[i], kind="stable")[:7])}


def test_nearest_travels_by_group_not_by_block(spark):
    """With more blocks than groups, a vector goes to each group of rows once; before, to each block."""
    v = vectors_of(spark, np.random.default_rng(6).normal(size=(1200, 4)))
    dealt, groups = blocks._groups(blocks.packed(v, 8), lambda n, _: 8)
    assert groups == 8 and dealt.count() >= 150 and dealt.select("g").distinct().count() == 8
    assert knn.best(v, v, 3, block=8).count() == 3600


def test_best_unlinked_pairs_behind_many_linked_ones(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(1, 8)) + 1e-3 * rng.normal(size=(60, 8)), rng.normal(size=(40, 8))])
    s = sims_of(x)
    linked = [(f"n{i:04d}", f"n{j:04d}") for i in range(60) for j in range(i + 1, 60)]
    want = sorted(((-s[i, j], f"n{i:04d}", f"n{j:04d}") for i in range(100) for j in range(i + 1, 100) if s[i, j] > 0.3 and j >= 60))[:20]
    found = knn.best_unlinked(vectors_of(spark, x), spark.createDataFrame(linked, "a string, b string"), 0.3, 20)
    assert [(r["a"], r["b"]) for r in found.collect()] == [(a, b) for _, a, b in want]


def drawn_graph(spark, seed=8, n=60):
    rng = np.random.default_rng(seed)
    e = {(min(i, j), max(i, j)) for i, j in rng.integers(0, n, (90, 2)) if i != j} | {(0, j) for j in range(1, n, 2)} | {(1, j) for j in range(2, n, 3)}
    x = rng.normal(size=(n - 5, 6)) + rng.normal(size=6)  # the last have no vector
    pairs = spark.createDataFrame([(f"n{i:04d}", f"n{j:04d}") for i, j in e], "a string, b string")
    return e, x, pairs, vectors_of(spark, x)


@pytest.mark.parametrize("small", [2, 256])
def test_bridges_compare_neighbours_only(spark, monkeypatch, small):
    monkeypatch.setattr(knn, "SMALL", small)
    e, x, pairs, v = drawn_graph(spark)
    s, near = sims_of(x), {}
    for i, j in e:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    want = {(i, h, j) for h, m in near.items() for i in m for j in m if i < j < len(x) and (i, j) not in e and s[i, j] >= 0.3}
    members = graph.beside(pairs, v)
    found = knn.alike_within(members, 0.3, graph.tied_neighbours(pairs), block=7).collect()
    assert {(r["a"], r["group"], r["b"]) for r in found} == {tuple(f"n{k:04d}" for k in t) for t in want} and len(found) == len(want)
    assert len({(r["a"], r["bridge"], r["b"]) for r in graph.bridges(pairs, v, 0.3).collect()}) == len(want)
    counts = {r["a"]: r["pairs"] for r in knn.count_alike(members, 0.3, graph.tied_neighbours(pairs), block=7).collect()}
    assert counts == {f"n{h:04d}": sum(t[1] == h for t in want) for h in near if any(t[1] == h for t in want)}
    mean = {r["a"]: r["alike"] for r in knn.mean_alike(members, block=7).collect()}
    for h, m in near.items():
        of = sorted(k for k in m if k < len(x))
        if len(of) > 1:
            assert abs(mean[f"n{h:04d}"] - np.mean([max(0, s[i, j]) for i in of for j in of if i < j])) < 1e-9


def test_triangles_of_a_hub_meet_few_rows(spark):
    """A hub's neighbours are not joined with one another: what leaves a note stays few."""
    e, _, pairs, _ = drawn_graph(spark)
    near = {k: {b if a == k else a for a, b in e if k in (a, b)} for k in range(60)}
    want = {(i, j, k) for i, j in e for k in near[i] & near[j] if j < k}
    assert {tuple(sorted(r)) for r in graph.triangles(pairs).collect()} == {tuple(f"n{k:04d}" for k in sorted(t)) for t in want}
    got = {r["path"]: r["linked"] for r in graph.neighbourhood_density(pairs).collect()}
    assert got == {f"n{k:04d}": sum(i in m and j in m for i, j in e) for k, m in near.items() if len(m) >= 3}


def test_sentences_keep_the_digits_of_their_place(spark):
    """``transform`` hands a function of two arguments the place too: the sentence at place 3 lost the 3s at its ends."""
    text = "One. Two. Three. 33 is not 3 but 33"
    assert spark.range(1).select(V.sentences(F.lit(text))).first()[0] == ["One.", "Two.", "Three.", "33 is not 3 but 33"]


@pytest.mark.parametrize("head", [16, 16_384])
def test_diversity_beyond_one_head(spark, monkeypatch, head):
    monkeypatch.setattr(filters, "SUGGESTED", 10)  # what one task took at most
    x = np.random.default_rng(9).normal(size=(150, 4))
    s, want = sims_of(x), []
    for i in range(150):
        if all(s[i, j] < 0.7 for j in want):
            want.append(i)
    d = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "ord bigint, embedding array<double>")
    assert sorted(r["ord"] for r in filters.diversity(d, filters.Limits(diversity=0.7), head).collect()) == want


def test_silhouette_in_groups(spark, monkeypatch):
    monkeypatch.setattr(clusters, "MOST", 10)  # what one task took at most
    rng = np.random.default_rng(10)
    x, c = rng.normal(size=(90, 4)), np.r_[rng.integers(0, 4, 88), 7, -1]
    d, total = np.linalg.norm(x[:, None] - x[None], axis=2), []
    for i in range(89):
        means = {k: d[i, (c == k) & (np.arange(90) != i)].mean() for k in set(c[:89]) if ((c == k) & (np.arange(90) != i)).any()}
        own, other = means.pop(c[i], None), min(means[k] for k in means if k != c[i])
        total.append(0.0 if own is None else (other - own) / max(own, other))
    labels = spark.createDataFrame([(f"n{i:04d}", int(k)) for i, k in enumerate(c)], "path string, cluster bigint")
    assert [r["silhouette"] for r in clusters.silhouette(vectors_of(spark, x), labels).collect()] == [round(float(np.mean(total)), 3)]
    assert clusters.silhouette(vectors_of(spark, x), labels.where("cluster = 1")).count() == 0


def test_holes_are_judged_where_they_are_found(spark):
    rng = np.random.default_rng(11)
    x, c = rng.normal(size=(120, 5)), [None if k < 0 else f"c{k}" for k in rng.integers(-1, 3, 120)]
    s, v = sims_of(x), vectors_of(spark, x)
    parts = spark.createDataFrame([(f"n{i:04d}", k) for i, k in enumerate(c)], "path string, component string")
    want = {(f"n{i:04d}", f"n{j:04d}") for i in range(120) for j in range(i + 1, 120) if s[i, j] >= 0.3 and c[i] and c[j] and c[i] != c[j]}
    found = graph.structural_holes(parts, v, 0.3)
    assert {(r["a"], r["b"]) for r in found.collect()} == want
    assert "SortMergeJoin" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "HashJoin" not in plan.split("MapInArrow")[0]


def test_density_clusters_by_a_distributed_tree(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(k, s, (40, 4)) for k, s in ((0, 0.3), (2, 0.2), (4, 0.4))] + [rng.normal(2, 3, (25, 4))])
    v, n = vectors_of(spark, x), len(x)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    core = np.sort(d, axis=1)[:, 3]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    inside, best, total = {0}, m[0].copy(), []
    while len(inside) < n:
        j = min((k for k in range(n) if k not in inside), key=lambda k: best[k])
        total.append(best[j])
        inside.add(j)
        best = np.minimum(best, m[j])
    for listed in (3, 8):
        tree, _ = clusters.spanning_tree(blocks.packed(v, 16, unit=False), 3, listed)
        assert len(tree) == n - 1 and np.allclose(sorted(e[0] for e in tree), sorted(total), atol=1e-7)
        assert all(abs(m[i, j] - w) < 1e-7 for w, i, j in tree)
    one, many = ({r["path"]: r["cluster"] for r in clusters.density_clusters(v, most=most).collect()} for most in (1000, 10))
    group = lambda c: {frozenset(p for p in c if c[p] == k) for k in set(c.values()) - {-1}}
    assert group(one) == group(many) and len(group(one)) >= 3


@pytest.mark.parametrize("light", [4, 64])
def test_alike_pairs_that_no_walk_joins(spark, light):
    e, x, pairs, v = drawn_graph(spark)
    e, n = {(i, j) for i, j in e if i % 3 and j % 5}, 60
    m = np.zeros((n, n), int)
    for i, j in e:
        m[i, j] = m[j, i] = 1
    near, s = (m + m @ m + m @ m @ m) > 0, sims_of(x)
    want = {(f"n{i:04d}", f"n{j:04d}") for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.2 and not near[i, j]}
    some = spark.createDataFrame([(f"n{i:04d}", f"n{j:04d}") for i, j in e], "a string, b string")
    found = [(r["a"], r["b"]) for r in reach.unwalked(v, some, 0.2, light, block=16).collect()]
    assert set(found) == want and len(found) == len(want) and want
    assert near[: len(x), : len(x)].sum() > 100
