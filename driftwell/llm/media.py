"""Interleaved document sequences with media payloads kept apart.

An HTML parser turns a page into an ordered array of structs, text or media reference; a caption goes to the media item
whose figure it stands in. Media payloads lie once in a columnar store under their digest, as 8-bit grey images; digest
joins bring what was read back from the store to every place that refers to it, so positions and captions stay aligned
while payloads move only as the few columns that are asked for.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.base import byte_rows, pieces, table
from driftwell.storage import broadcast_checked, stash

#: Payloads are padded to a multiple of so many bytes; it is the width of the image that stores them.
WIDTH = 64
REFERENCE = "media:sha256-"
#: Rows that refer to one digest before its payload is held more than once in the join.
HOT = 1000
PIECE = 4 << 20
ITEMS = "array<struct<position:int,kind:string,text:string,media:string,caption:string>>"
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset(("script", "style", "template", "noscript"))


class Interleaver(HTMLParser):
    """Collects text runs and media references in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden = 0
        self.figures: list[int] = []
        self.caption: list[str] | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "media": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self._flush()
            self.figures.append(len(self.items))
        elif tag == "figcaption":
            self._flush()
            self.caption = []
        elif tag in ("img", "audio", "video", "source", "embed"):
            found = dict(attrs)
            if found.get("src"):
                if self.caption is None:
                    self._flush()
                self.items.append({"position": len(self.items), "kind": "media", "text": None, "media": found["src"], "caption": found.get("alt") or None})
        elif tag in BLOCKS and self.caption is None:
            self._flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(self.hidden - 1, 0)
        elif tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            first = self.figures[-1] if self.figures else len(self.items)
            held = [x for x in self.items[first:] if x["kind"] == "media"]
            for x in held:
                x["caption"] = caption or x["caption"]
            if caption and not held:
                self.items.append({"position": len(self.items), "kind": "text", "text": caption, "media": None, "caption": None})
        elif tag == "figure":
            self._flush()
            if self.figures:
                self.figures.pop()
        elif tag in BLOCKS and self.caption is None:
            self._flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def interleaved(html: str | None) -> list[dict]:
    """The items of a page in order; none for a null or empty one. An open caption or figure ends with the page."""
    parser = Interleaver()
    parser.feed(html or "")
    parser.close()
    if parser.caption is not None:
        parser.handle_endtag("figcaption")
    parser._flush()
    return parser.items


def sequences(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, items) for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media", pa.string()), ("caption", pa.string())]
        for batch in batches:
            for part in pieces(batch, 1, PIECE):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([interleaved(h) for h in part.column(1).to_pylist()], pa.list_(pa.struct(fields)))], names=[key, "items"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "html").mapInArrow(run, f"{key} {kind}, items {ITEMS}")


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % WIDTH if payload else WIDTH)


def image(payload: bytes) -> bytes:
    """A padded payload as the samples of an 8-bit grey image (binary PGM), ``WIDTH`` wide."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples(stored: bytes) -> bytes:
    """The samples of such an image, after its header and size are checked."""
    magic, size, depth, data = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(data) != width * height:
        raise ValueError("not an 8-bit grey image of the stated size")
    return data


def feature(payload: bytes) -> str:
    """Height, mean, deviation, share of rising neighbours, and 16 bins of the samples in per mille."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    n, values = len(x), np.arange(256)
    mean = float(counts @ values) / n
    deviation = max(float(counts @ (values * values)) / n - mean * mean, 0.0) ** 0.5
    rising = 1000 * int((x[1:] > x[:-1]).sum()) // (n - 1)
    bins = 1000 * counts.reshape(16, 16).sum(axis=1) // n
    return f"h{n // WIDTH};m{mean:.3f};d{deviation:.3f};r{rising};b" + ".".join(map(str, bins.tolist()))


def stored_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, html, n_bytes, digest, media): each text as a page that shows its payload, and the image to store.

    A batch stores a payload once; other batches may store it again, which reading settles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, PIECE):
                texts, seen, rows = byte_rows(part.column(1)), set(), []
                for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    payload = padded(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    page = f'<article><figure><img src="{REFERENCE}{digest}"><figcaption>{escape(str(doc))}</figcaption></figure></article>'
                    rows.append((page, len(text), digest, None if digest in seen else image(payload)))
                    seen.add(digest)
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary())], names=["doc_id", "html", "n_bytes", "digest", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, html string, n_bytes bigint, digest string, media binary")


def described(store: DataFrame) -> DataFrame:
    """What the stored media (digest, media) hold, once a digest: read back, decoded and checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, PIECE):
                rows = []
                for digest, stored in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = samples(stored)
                    own = hashlib.sha256(data).hexdigest()
                    if own != digest:
                        raise ValueError(f"stored media {digest} holds {own}")
                    rows.append((digest, len(data), own, zlib.crc32(data[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(data)))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["digest", *NAMES])

    kinds = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    one = store.where("media is not null").select("digest", "media").mapInArrow(run, kinds)
    return one.groupBy("digest").agg(*[F.max(c).alias(c) for c in NAMES])


NAMES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def resolve(items: DataFrame, media: DataFrame, references: DataFrame) -> DataFrame:
    """Exploded sequences (…, item) with the described media that each item refers to, null where there is none.

    ``references`` has a row with its digest for every reference. A digest that more than ``HOT`` rows refer to is held as
    often as they make shares of that size, and each item meets one of these.
    """
    often = references.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    often = broadcast_checked(stash(often.select(F.col("digest").alias("d"), F.ceil(F.col("n") / HOT).cast("int").alias("shares")), "media-often"))
    held = media.join(often, media["digest"] == F.col("d"), "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("d", "shares")
    ref = F.when(F.col("item.media").startswith(REFERENCE), F.substring(F.col("item.media"), len(REFERENCE) + 1, 64))
    names = [c for c in items.columns if c != "item"]
    items = items.withColumn("ref", ref).join(often, F.col("ref") == F.col("d"), "left")
    items = items.withColumn("part", F.pmod(F.xxhash64(*[F.col(c) for c in names]), F.coalesce("shares", F.lit(1)))).drop("d", "shares")
    return items.join(held, (F.col("ref") == held["digest"]) & (F.col("part") == held["share"]), "left").drop("ref", "part", "share")


def text_media(docs: DataFrame) -> DataFrame:
    """Every text as one stored media item, resolved: (doc_id, n_bytes, position, caption, …what the store holds).

    Null and empty texts are one block of zero bytes. Equal texts have equal values and are stored about once; repeated
    rows give a row each; an empty table gives an empty result; extra columns are ignored.
    """
    kept = stash(stored_texts(docs), "media")
    items = sequences(kept.select(F.struct("doc_id", "n_bytes").alias("key"), "html"), "key")
    items = items.select("key.*", F.explode("items").alias("item"))
    return resolve(items, described(kept), kept).select("doc_id", "n_bytes", "item.position", "item.caption", *NAMES)


def op9_media_rows(docs: DataFrame) -> DataFrame:
    return text_media(docs).drop("position", "caption")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_media_rows(table(spark, sf_dir, "documents"))
