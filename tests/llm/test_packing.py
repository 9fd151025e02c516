"""The packing operator's encoder against the whole tokenizer, and texts beyond every bound of a piece."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwell.llm import base, packing

LETTERS = "abcxyzABCZ éÀÿŸµªŐőĲİıſßŁ×÷²½ñ" + "0123456789 \t\n\x0b\x1c\x85\xa0" + "'s't.,;<|>|_-#$" + "дЖ日本́​😀ǅΣς"


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


@given(st.lists(st.text(LETTERS, max_size=60), max_size=6))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_whole_tokenizer(whole, texts):
    enc = packing.encoder(packing.default_tokenizer())
    flat, n = enc.encode([t.encode() for t in texts], 1)
    assert enc.fast and n.sum() == len(flat)
    expected = [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == (expected or [[]])


def test_table_of_known_pieces_is_bounded(whole, monkeypatch):
    """With few slots and a small arena entries are overwritten all the time and the ids stay the same."""
    monkeypatch.setattr(packing, "SLOTS", 64)
    monkeypatch.setattr(packing, "ARENA", 500)
    enc, rng = packing.Encoder(packing.default_tokenizer()), random.Random(4)
    for _ in range(30):
        text = " ".join("".join(rng.choice("aeioubcdfg") for _ in range(rng.randrange(1, 40))) for _ in range(60))
        assert enc.encode([text.encode()])[0].tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(enc.keys) == 64


def test_another_tokenizer_goes_text_by_text(tmp_path):
    from tokenizers import Tokenizer

    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"][1]["pattern"] = {"Regex": "[a ]+"}
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": ".+"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    enc, own = packing.Encoder(str(path)), Tokenizer.from_file(str(path))
    texts = ["banana split and a day", "", "one  two"]
    flat, n = enc.encode([t.encode() for t in texts], 7)
    assert not enc.fast and [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [[*own.encode(t, add_special_tokens=False).ids, 7] for t in texts]


def test_long_texts(spark, whole, monkeypatch):
    """One text longer than a piece, one with more ids than a lane adds up."""
    monkeypatch.setattr(packing, "PIECE", 1 << 12)
    rng = random.Random(8)
    texts = ["short", "", " ".join(f"{rng.choice('abcdefg')}{rng.randrange(9)}" for _ in range(packing.LANE)), "tail end"]
    found = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), packing.default_tokenizer()).toPandas()
    for k, text in enumerate(texts):
        ids = [*whole.encode(text, add_special_tokens=False).ids, 1]
        mine = found[found.doc_id == k].sort_values("start")
        assert np.concatenate([np.frombuffer(x, "<u4") for x in mine["ids"]]).tolist() == ids
        assert (mine.doc_tokens == len(ids)).all()
    assert len(whole.encode(texts[2]).ids) > packing.LANE


def test_projection_adds_lanes_exactly():
    signs = packing.directions(50)
    ids = np.random.default_rng(2).integers(0, 50, 3 * packing.LANE + 17)
    got = packing.projected(signs[ids], np.array([len(ids), 0]))
    bits = np.stack([signs >> np.uint64(16 * k) & np.uint64(1) for k in range(packing.DIMENSIONS)], axis=1).astype(np.int64)
    assert np.allclose(got[0], (2 * bits[ids] - 1).mean(axis=0)) and not got[1].any()


def test_pieces_split_by_bytes_and_keep_long_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c" * 9, "d"])], names=["t"])
    parts = [p.column(0).to_pylist() for p in base.pieces(batch, 0, 12)]
    assert [x for p in parts for x in p] == batch.column(0).to_pylist()
    assert all(sum(len(x or "") for x in p) <= 12 or len(p) == 1 for p in parts)
