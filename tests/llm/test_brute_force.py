"""Operators that SQL cannot express against plain restatements of their rules, and models on rows they have not seen."""

import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import language_id, licenses, media, mixing, quality_model, quality_rules, warc

SF = "/root/testdata/sf0.01"


def test_language_profiles_and_distance(spark):
    """Profiles, distances and the nearest language of each text, n-gram by n-gram in dictionaries."""
    rng = random.Random(3)
    words = {"aa": "lorem ipsum dolor sit amet", "bb": "żółw idzie przez pole éa", "cc": "zebra quick xylo wave"}
    rows = [(k, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(3, 40))) + rng.choice([".", " 12!", "  x"]), lang) for k, lang in enumerate([*"aa bb cc".split()] * 20)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")

    def grams(text):
        letters = re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
        return Counter(g for n in (1, 2, 3) for i in range(len(letters) - n + 1) if (g := letters[i : i + n]) != " " and not (n == 3 and g[1] == " "))

    def ranked(counts):
        return sorted(counts, key=lambda g: (-counts[g], len(g), g))

    def code(g):
        return sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))

    profiles = language_id.learn(docs)
    expected = {}
    for lang in words:
        total = sum((grams(t) for _, t, x in rows if x == lang), Counter())
        expected[lang] = sorted(total, key=lambda g: (-total[g], code(g)))[: language_id.DEPTH]
        assert profiles[lang].tolist() == [code(g) for g in expected[lang]]
    found = {r["doc_id"]: r for r in language_id.identify(docs, profiles).collect()}
    for k, text, _ in rows:
        counts = grams(text)
        mine = sorted(counts, key=lambda g: (-counts[g], code(g)))[: language_id.DEPTH]
        off = {x: sum(abs(i - p.index(g)) if g in p else language_id.DEPTH for i, g in enumerate(mine)) for x, p in expected.items()}
        best = min(sorted(off), key=off.get)
        rest = min(v for x, v in off.items() if x != best)
        assert found[k]["lang_pred"] == best and abs(found[k]["score"] - (1 - off[best] / rest if rest else 0.5)) < 1e-9


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.op1_language_id(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").toPandas()
    assert len(out) > 100 and (out.lang == out.lang_pred).mean() >= 0.99


def test_licence_places(spark):
    """Words, places, first and last start and labels by scanning word lists."""
    rng = random.Random(9)
    pool = ["mit", "MIT", "License", "license", "apache", "General", "public", "x", "é1", "version", "2", "0", "gnu", "isc"]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "-", "\n", ", ", "  ", "_"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    found = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for r in found:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]]))
        hit = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in [*licenses.BASE, *licenses.NOTICES]}
        places = sorted(i for p in licenses.BASE for i in hit[p])
        base = sorted({licenses.BASE[p] for p in licenses.BASE if hit[p]})
        labels = sorted({*base, *(licenses.NOTICES[p] for p in licenses.NOTICES if hit[p])})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert (r["base_labels"], r["labels"]) == (",".join(base), ",".join(labels))
        assert r["score"] == (0.9 if any(hit[p] for p in licenses.NOTICES) else 0.6 if places else 0.0)


def test_kernel_ridge_and_steps(spark):
    """Summed normal equations against one least-squares solution, over more partitions than are added at once."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, len(quality_model.STATISTICS)))
    y = (x[:, 0] + x[:, 1] ** 2 > 1).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(2 * quality_model.FOLD + 5)
    kernel = quality_model.Kernel(*quality_model.moments(rows), features=40)
    weights = quality_model.fit(rows, kernel)
    z = kernel(x)
    direct = np.linalg.solve(z.T @ z / len(z) + quality_model.RIDGE * np.eye(z.shape[1]) / z.shape[1], z.T @ y / len(z))
    assert np.allclose(weights, direct, atol=1e-6)
    at, ones, n = np.arange(30.0), rng.integers(0, 5, 30).astype(float), np.full(30, 5.0)
    _, steps = quality_model.isotonic(at, ones, n)
    # the isotonic fit is the largest average of what lies left within the least of what lies right
    means = [min(max(ones[i : k + 1].sum() / n[i : k + 1].sum() for i in range(j + 1)) for k in range(j, 30)) for j in range(30)]
    assert np.allclose(sorted(set(np.round(steps, 9))), sorted(set(np.round(means, 9))))


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_model.op6_quality_model(spark, SF).where("held_out").join(labels, "doc_id").toPandas()
    good, bad = out.score[out.quality == 1].to_numpy(), out.score[out.quality == 0].to_numpy()
    assert len(good) > 50 and len(bad) > 10
    assert (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean() >= 0.97


def test_mix_takes_the_keys_below_the_threshold(spark):
    """Targets by sharing again until no source is above its bound; documents taken are those with the least keys."""
    rng = random.Random(12)
    rows = [(k, "w " * rng.randrange(9), rng.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    keys = {r["doc_id"]: r["k"] for r in docs.select("doc_id", mixing.hash_key(F.col("doc_id")).alias("k")).collect()}
    size = {k: len(t.split()) for k, t, _ in rows}
    sources = [*sorted({s for _, _, s in rows if s}), None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(size[k] for k, _, x in rows if x == s) for s in sources}
    target, open_, left = {}, set(sources), float(sum(total.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * total[s]}
        if not above:
            target |= share
            break
        target |= {s: 3.0 * total[s] for s in above}
        left -= sum(3 * total[s] for s in above)
        open_ -= above
    found = {r["doc_id"]: r for r in mixing.mix_sizes(docs).collect()}
    for s in sources:
        mine = sorted((k for k, _, x in rows if x == s), key=keys.get)
        assert all(abs(found[k]["target"] - target[s]) < 1e-6 and found[k]["source_size"] == total[s] for k in mine)
        times = [found[k]["taken"] // size[k] for k in mine if size[k]]
        assert times == sorted(times, reverse=True) and times[0] - times[-1] <= 1
        assert abs(sum(found[k]["taken"] for k in mine) - target[s]) <= max(size[k] for k in mine)


def test_media_feature_by_hand(spark):
    texts = ["", "abc", "é" * 77, "z" * 64, "line\n" * 300]
    found = {r["doc_id"]: r for r in media.op9_media_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for k, text in enumerate(texts):
        raw = text.encode()
        data = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        mean = sum(data) / len(data)
        deviation = (sum(b * b for b in data) / len(data) - mean * mean) ** 0.5
        rising = 1000 * sum(b > a for a, b in zip(data, data[1:])) // (len(data) - 1)
        bins = [1000 * sum(b >> 4 == j for b in data) // len(data) for j in range(16)]
        assert found[k]["feature"] == f"h{len(data) // 64};m{mean:.3f};d{deviation:.3f};r{rising};b" + ".".join(map(str, bins))
        assert found[k]["tail_crc32"] == zlib.crc32(data[-64:])


def test_media_of_pages_with_several_items(spark):
    """Items keep their order, captions stay with their figure, payloads are resolved, and a hot one is held many times."""
    store = {f"m{k}": bytes([k]) * 64 * (k + 1) for k in range(4)}
    names = {k: media.hashlib.sha256(v).hexdigest() for k, v in store.items()}
    pages, expected = [], {}
    for p in range(60):
        items, html = [], ""
        for j in range(p % 5):
            name = "m0" if p % 2 else f"m{(p + j) % 4}"
            html += f"<p>text {p} {j}</p><figure><img src='{media.REFERENCE}{names[name]}'><figcaption>cap {p} {j}</figcaption></figure>"
            items += [(2 * j, "text", f"text {p} {j}", None, None), (2 * j + 1, "media", None, f"cap {p} {j}", len(store[name]))]
        pages.append((p, html + "<img src='http://elsewhere/x.png'>"))
        expected[p] = [*items, (2 * (p % 5), "media", None, None, None)]
    kept = spark.createDataFrame([(names[k], media.image(v)) for k, v in store.items()], "digest string, media binary")
    items = media.sequences(spark.createDataFrame(pages, "page_id int, html string")).select("page_id", F.explode("items").alias("item"))
    refs = items.select(F.substring("item.media", len(media.REFERENCE) + 1, 64).alias("digest"))
    for hot in (1000, 3):
        media.HOT = hot
        found = media.resolve(items, media.described(kept), refs).select("page_id", "item.*", "payload_bytes").collect()
        got = {p: sorted((r["position"], r["kind"], r["text"], r["caption"], r["payload_bytes"]) for r in found if r["page_id"] == p) for p, _ in pages}
        assert got == expected
    media.HOT = 1000


def test_sequences_of_the_given_pages(spark):
    """Over all given pages: the text items hold the words of an independent tag stripper, in order."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r["page_id"]: r["items"] for r in media.sequences(pages.select("page_id", "html")).collect()}
    for r in pages.select("page_id", "html").collect():
        html = re.sub(r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", " ", r["html"] or "")
        words = re.sub(r"<[^>]*>", " ", html)
        mine = " ".join(x["text"] or "" for x in found[r["page_id"]])
        assert [x["position"] for x in found[r["page_id"]]] == list(range(len(found[r["page_id"]])))
        assert re.sub(r"\s|&\w+;|&#\d+;|[&<>\"']", "", words)[:200] == re.sub(r"\s|[&<>\"']", "", mine)[:200] or "&" in words or "<title" in html.lower()


def test_revisits_are_held_against_their_response(spark):
    pages = [(f"p {k % 7}é", f"u{k}", f"body {k % 3}") for k in range(7)]
    table = spark.createDataFrame(pages, "page_id string, url string, html string").repartition(3)
    records = warc.read_archives(warc.write_archives(table), "string")
    got = {r["page_id"]: r["refers_to"] for r in warc.checked(records).collect()}
    first = {h: min(p for p, _, x in pages if x == h) for _, _, h in pages}
    assert got == {p: None if first[h] == p else first[h] for p, _, h in pages}
    with pytest.raises(warc.BadRecord):
        warc.checked(records.where("record_type = 'revisit'"))
    with pytest.raises(warc.BadRecord):
        warc.checked(records.withColumn("payload_bytes", F.when(F.col("record_type") == "response", 1).otherwise(F.col("payload_bytes"))))


def test_archives_are_read_in_tasks_of_their_own(spark):
    table = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), 40) AS html").repartition(9)
    paths = warc.write_archives(table)
    assert paths.count() >= 4
    tasks = warc.read_archives(paths).withColumn("t", F.spark_partition_id()).select("t").distinct().count()
    assert tasks >= paths.count() // 2


def test_fences_reject_word_runs(spark):
    """Documents of one word said again and again, below the base rule, are beyond the fence; varied ones stay."""
    rng = random.Random(2)
    names = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(rng.sample(names, 60))) for k in range(400)] + [(1000 + k, " ".join(w for x in rng.sample(names, 12) for w in [x] * 5)) for k in range(5)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in rows], "doc_id int, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality_rules.keep_good(docs).select("doc_id").collect()}
    assert kept == set(range(400))
    assert json.dumps(sorted(quality_rules.RATIOS)) == json.dumps(sorted(quality_rules.ratios()))
