"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; brute force on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwell.llm import language_id, licenses, media, mixing, packing, quality_model, quality_rules, sais, simhash, suffix_dedup, warc
from driftwell.llm.xxh import xxh64_ranges

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, key string, words string"
WORDS = "the of and river stone light under winter garden quiet market letter seven green window paper".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    shared = prose(99, 60)
    texts = [prose(k, 80) for k in range(12)]
    texts += [texts[0], texts[0] + " end", prose(20, 30) + " " + shared, prose(21, 30) + " " + shared, None, "", " \n\t ", "###", "a " * 400, prose(30, 3000), "é" * 300, "Released under the MIT License. SPDX-License-Identifier: MIT OR (GPL-2.0+ WITH x-exception)"]
    out = [(k, t, "en" if k % 3 else "de", ["a", "b", None][k % 3], len(t or ""), 1, "k", "w") for k, t in enumerate(texts)]
    out.append(out[3])
    out.append((None, "no id here", None, None, None, None, None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_hashes():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(3000))
    starts, sizes = np.array([rng.randrange(2700) for _ in range(2000)]), np.array([rng.randrange(220) for _ in range(2000)])
    assert xxh64_ranges(data, starts, sizes, 42).tolist() == [xxhash.xxh64_intdigest(data[s : s + n], 42) for s, n in zip(starts, sizes)]


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=60, deadline=None)
def test_suffix_array(values):
    t = np.array([*values, 0])
    expected = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert sais.suffix_array(t, 5).tolist() == expected
    assert sais.suffix_array(t, sais.SMALL + 1).tolist() == expected


def repeats(rows):
    """Bytes covered by 100-byte strings that start earlier, by brute force."""
    seen, out = set(), {}
    for doc, text in sorted({(r[0] if r[0] is not None else 1 << 60, (r[1] or "").encode()) for r in rows}):
        cover = np.zeros(len(text) + 1, int)
        for s in range(len(text) - 99):
            if text[s : s + 100] in seen:
                cover[s] += 1
                cover[s + 100] -= 1
            seen.add(text[s : s + 100])
        gone = np.cumsum(cover)[:-1] > 0
        out[doc, text] = (int(gone.sum()), hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffix_dedup(docs, rows, empty):
    expected = repeats(rows)
    texts = {(r[0] if r[0] is not None else 1 << 60): (r[1] or "").encode() for r in rows}
    found = suffix_dedup.repeated_spans(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        doc = r["doc_id"] if r["doc_id"] is not None else 1 << 60
        assert (r["n_removed"], r["kept_sha256"]) == expected[doc, texts[doc]]
    cut = suffix_dedup.drop_repeats(docs)
    assert cut.columns == docs.columns
    assert cut.where("text is null").count() == 1
    assert suffix_dedup.repeated_spans(empty).count() == 0 and suffix_dedup.drop_repeats(empty).count() == 0


def test_simhash(docs, rows, empty):
    def fingerprint(text):
        words = (text or "").encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    prints = {(r[0], r[1]): fingerprint(r[1]) for r in rows}
    label = {f: f for f in prints.values()}
    for _ in label:
        for a in label:
            label[a] = min(label[b] for b in label if (a ^ b).bit_count() <= 3)
    least = {}
    for (doc, _), f in prints.items():
        if doc is not None:
            least[label[f]] = min(least.get(label[f], doc), doc)
    for r in found:
        f = prints[r["doc_id"], next(x[1] for x in rows if x[0] == r["doc_id"])]
        assert r["fp"] & (1 << 64) - 1 == f
        assert r["component_id"] == least.get(label[f])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.where("doc_id is not null").select("doc_id").collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(empty).count() == 0


def test_vantage_tree_loses_no_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)) for _ in range(4)])
    points = np.unique(np.concatenate([base, near]))
    nodes = simhash.grow(points, 40)
    together = [set(rows.tolist()) for _, rows in simhash.deal(nodes, points)]
    d = simhash.distance(points[:, None], points[None, :])
    for i, j in zip(*np.nonzero((d <= 3) & (d > 0))):
        assert any(i in s and j in s for s in together)


def naive_rules(text):
    words = (text or "").encode().split()
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for w in windows.values() if len(w) > 1 for i in w for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, rows, empty):
    p = quality_rules.PREFIX
    extra = [(100 + k, t, "en", "a", 0, 0, "", "") for k, t in enumerate(["x y\nx y\n\nz", "a b c d e f g h a b c d e f g h", "a|b <c> & #d", "one two three four five six seven eight nine ten " * 3])]
    found = quality_rules.verdict(quality_rules.measures(docs.unionByName(spark.createDataFrame(extra, SCHEMA)))).collect()
    assert len(found) == len(rows) + len(extra)
    for r in found:
        got = tuple(r[p + k] for k in ("n_words", "chars", "symbols", "n_dup_lines", "n_repeat_words"))
        assert got == naive_rules(r["text"]), r["doc_id"]
        assert r[p + "base_failed"] == (got[0] < 20 or 100 * got[4] > 30 * got[0])
        assert not (r[p + "base_failed"] and r[p + "kept"])
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.keep_good(empty).count() == 0


def test_mixing(spark, docs, rows, empty):
    found = mixing.mix_sizes(docs).collect()
    assert len(found) == len(rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    many = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 7 AS int)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('s', id % 4) END AS source")
    out = mixing.mix_sizes(many).join(many.select("doc_id", "source"), "doc_id").toPandas()
    by = out.groupby("source", dropna=False).agg(taken=("taken", "sum"), size=("source_size", "first"), target=("target", "first"))
    for r in by.itertuples():
        assert abs(r.taken - r.target) <= 7 and r.target <= 3 * r.size + 1e-9
    assert len(by) == 6 and abs(by.target.sum() - out["size"].sum()) < 1e-6
    again = mixing.mix_sizes(many).toPandas()
    assert out.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_sizes(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole = Tokenizer.from_file(path)
    odd = ["<|endoftext|>x", "it's DON'T 1,000.5 _a_", "İ ſ ﬁ é 日本", "a\x1cb\x85c d", "naïve ÀÉ"]
    enc = packing.encoder(path)
    for text in [r[1] or "" for r in rows] + odd:
        assert enc.encode([text.encode()])[0].tolist() == whole.encode(text, add_special_tokens=False).ids
    found = packing.pack(docs, path).toPandas()
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1])
    assert found["length"].sum() == sum(len(x) for v in ids.values() for x in v)
    for r in found.itertuples():
        key = None if r.doc_id != r.doc_id else r.doc_id
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[key][0][r.start : r.start + r.length]
    for _, s in found.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        total = int(s.length.sum())
        assert total == 2048 or total & (total - 1) == 0
    assert packing.pack(empty, path).count() == 0


def test_hilbert_neighbours():
    cells = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(4)])
    walk = cells[np.argsort(packing.hilbert(cells, 2))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_language_id(spark, docs, rows, empty):
    text = {"en": "the thing with the other one that was there and then", "de": "der eine und die andere mit dem wagen nicht schön auch"}
    train = spark.createDataFrame([(k, t, lang) for k in range(6) for lang, t in text.items()] + [(9, None, "en"), (10, "x", None)], "doc_id bigint, text string, lang string")
    profiles = language_id.learn(train)
    assert sorted(profiles) == ["de", "en"]
    judged = language_id.identify(spark.createDataFrame([(1, "then the other thing was there"), (2, "und nicht die andere"), (3, None), (4, "123 ?!"), (5, "")], "doc_id bigint, text string"), profiles)
    got = {r["doc_id"]: r["lang_pred"] for r in judged.collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"}
    assert language_id.identify(docs, profiles).count() == len(rows)
    assert language_id.identify(docs, {}).select("lang_pred").distinct().count() == 1
    assert language_id.identify(empty, profiles).count() == 0 and language_id.learn(empty) == {}


def test_licenses(docs, rows, empty):
    assert licenses.postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.evaluate("(GPL-2.0+ OR MIT) AND LGPL-2.1") == ({"gpl-2.0", "mit", "lgpl-2.1"}, 1)
    assert licenses.evaluate("GPL-2.0 WITH Classpath-exception-2.0") == ({"gpl-2.0"}, 1)
    for bad in ("", "a b", "and a", "(a", "a)", "a or", "()"):
        with pytest.raises(licenses.BadExpression):
            licenses.evaluate(bad)
    scan = licenses.scanner()
    assert scan(b"The MIT  license, mit-license; general public\nlicense x")[:5] == (9, 3, 1, 5, "gpl,mit")
    assert scan(b"") == (0, 0, None, None, "", "", 0.0, 0, [])
    found = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert found[23]["labels"] == "gpl-2.0,mit" and found[23]["score"] == 1.0 and found[23]["base_labels"] == "mit"
    assert licenses.scan_licenses(docs).count() == len(rows) and licenses.scan_licenses(empty).count() == 0


def test_quality_model(spark, docs, rows, empty):
    good, bad = [(k, prose(k, 60), 1) for k in range(60)], [(100 + k, " | ".join(prose(k, 8).upper() + "!!" for _ in range(8)), 0) for k in range(60)]
    table = spark.createDataFrame(good + bad, "doc_id bigint, text string, label int")
    labels = table.where("doc_id % 2 = 0").select("doc_id", "label")
    out = quality_model.classify(table, labels).join(table.select("doc_id", "label"), "doc_id").where("doc_id % 2 = 1").collect()
    assert sum((r["score"] >= 0.5) == (r["label"] == 1) for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)
    scored = quality_model.classify(docs, labels)
    assert scored.count() == len(rows) and scored.where("score is null").count() == 0
    assert quality_model.classify(docs, labels.limit(0)).count() == len(rows)
    assert quality_model.classify(empty, labels).count() == 0
    at, steps = quality_model.isotonic(np.arange(4.0), np.array([1.0, 0, 2, 3]), np.array([2.0, 2, 3, 3]))
    assert (np.diff(steps) >= 0).all()


def test_media(docs, rows, empty):
    items = media.interleaved('<p>a <b>b</b></p><figure><img src="x"><figcaption>one &amp; two</figcaption></figure>tail<script>no</script><img src=y alt=z>')
    assert [(x["kind"], x["text"] or x["media"], x["caption"]) for x in items] == [("text", "a b", None), ("media", "x", "one & two"), ("text", "tail", None), ("media", "y", "z")]
    assert media.interleaved(None) == [] and media.interleaved("<figure><figcaption>open") != []
    found = media.text_media(docs).collect()
    assert len(found) == len(rows)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in found:
        data = media.padded(texts[r["doc_id"]])
        stored = media.image(data)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), hashlib.sha256(stored).hexdigest())
        assert r["caption"] == str(r["doc_id"]) and r["position"] == 0
    assert media.text_media(empty).count() == 0


def test_warc(spark):
    pages = [(3, "http://a/\n x", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (7, "u", "ü" * 500), (7, "u", "ü" * 500), (None, "u", "same")]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    found = warc.read_archives(warc.write_archives(table)).collect()
    assert len(found) == len(pages)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in found if r["page_id"] is not None}
    assert got == {1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 5: ("revisit", 2), 7: ("response", None)}
    assert all(r["payload_digest"] == warc.digest((next(p[2] for p in pages if p[0] == r["page_id"]) or "").encode()) for r in found)
    long = warc.read_archives(warc.write_archives(table, least=10)).where("record_type = 'revisit'").count()
    assert long == 0
    raw = warc.record(1, "u", b"body", None, warc.digest(b"body"))
    assert warc.parse(raw)["payload"] == b"body"
    for bad in (raw[:-1], raw.replace(b"body", b"bodz"), raw.replace(b"WARC/1.1", b"WARC/9"), raw.replace(b"WARC-Date", b"WARC-Type")):
        with pytest.raises(warc.BadRecord):
            warc.parse(bad)
    assert warc.read_archives(warc.write_archives(table.limit(0))).count() == 0


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame([(*r[:5],) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
