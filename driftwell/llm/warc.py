"""WARC archives in Zstandard frames with a shared dictionary.

An archive is a series of Zstandard frames, one a record, after a skippable frame that holds the dictionary all of them
need. A reader loads the dictionary from that leading frame, decodes frame by frame, and validates every record's version
line, headers, lengths and digest, and revisits against the responses they name. Archives are cut at ``ARCHIVE`` bytes and
carry the name of their task attempt; the committed table of paths tells which attempts count, so a repeated task neither
overwrites nor mixes with another's files.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.base import byte_rows, table
from driftwell.storage import shared_path, stash

#: Magic of the skippable frame that holds a dictionary: a fixed value of the format.
DICTIONARY_MAGIC = 0x184D2A5D
#: Bytes of records before an archive is closed; bytes of the dictionary, and of the samples it is made of.
ARCHIVE, DICTIONARY, SAMPLES = 64 << 20, 64 << 10, 4 << 20
#: Pages whose beginnings those samples are.
SAMPLED = 512
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


class BadRecord(ValueError):
    """A record whose headers, lengths or digest are not in order."""


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page}')}>"


def record(page: object, url: str | None, payload: bytes, response: object, name: str) -> bytes:
    """A response, or a revisit of the page ``response``, whose payload stays out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = response is not None
    body = http if revisit else http + payload
    # a header holds one line
    uri = "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"X-Page-ID: {'' if page is None else quote(str(page))}",
        f"WARC-Payload-Digest: sha1:{name}", f"WARC-Block-Digest: sha1:{digest(body)}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(response)}", f"X-Refers-To-Page: {quote(str(response))}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers and payload, or ``BadRecord``."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadRecord("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in headers:
            raise BadRecord(f"header {name!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(name):
            raise BadRecord(f"no {name}")
    if not headers["content-length"].isdigit() or int(headers["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord("content length")
    body = rest[:-4]
    if headers.get("warc-block-digest", "sha1:" + digest(body)) != "sha1:" + digest(body):
        raise BadRecord("block digest")
    http, found, payload = body.partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        raise BadRecord("HTTP headers")
    if headers["warc-type"] == "response":
        if headers.get("warc-payload-digest") != "sha1:" + digest(payload) or int(headers["x-payload-length"]) != len(payload):
            raise BadRecord("payload digest or length")
    elif headers["warc-type"] != "revisit" or not headers.get("warc-refers-to") or payload:
        raise BadRecord("type")
    return headers | {"payload": payload}


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_archive(data: io.BufferedIOBase) -> Iterator[bytes]:
    """The records of an archive, one a frame. A dictionary may itself be compressed."""
    magic, size = struct.unpack("<II", data.read(8))
    if magic != DICTIONARY_MAGIC:
        raise BadRecord("no dictionary frame leads")
    raw = data.read(size)
    if len(raw) != size:
        raise BadRecord("dictionary is cut short")
    if raw[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):
        raw = zstandard.decompress(raw)
    reader, held = zstandard.ZstdDecompressor(zstandard.ZstdCompressionDict(raw) if raw else None), b""
    while True:
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if not held:
                held = data.read(1 << 20)
                if not held:
                    if out:
                        raise BadRecord("frame is cut short")
                    return
            out.append(frame.decompress(held))
            held = frame.unused_data if frame.eof else b""
        yield b"".join(out)


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _write(root: str, dictionary: bytes):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, files, now = TaskContext.get(), [], None
        where, base = store(root)
        packer = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in (0, 1, 3, 4)]
            for page, url, payload, response, name in zip(cols[0], cols[1], byte_rows(batch.column(2)), cols[2], cols[3], strict=True):
                if now is None:
                    # of a task's attempts only that whose rows were committed has its archives in the table of paths
                    files.append(f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(files):04d}.warc.zst")
                    now = where.open_output_stream(f"{base}/{files[-1]}", compression=None)
                    size = now.write(dictionary_frame(dictionary))
                frame = packer.compress(record(page, url, payload, response, name))
                now.write(frame)
                size += len(frame)
                if size > ARCHIVE:
                    now = now.close()
        if now is not None:
            now.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{root}/{f}" for f in files], pa.string())], names=["path"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            where, file = store(path)
            rows, size = [], 0
            with where.open_input_stream(file, compression=None) as data:
                for raw in read_archive(data):
                    h = parse(raw)
                    page, refers = (unquote(h[k]) if h.get(k) else None for k in ("x-page-id", "x-refers-to-page"))
                    rows.append((page, h["warc-target-uri"], h["warc-type"], int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), refers, h["payload"]))
                    size += len(raw)
                    if size > 8 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 7
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])


def write_archives(pages: DataFrame, least: int = 0, root: str | None = None) -> DataFrame:
    """Write a record for every page and return the archives' paths.

    Of pages with equal payloads of at least ``least`` bytes, that with the smallest page_id is a response and the others
    revisit it. A null html is an empty payload. Rows that repeat a page_id and its payload: one is the response. A page
    without an id is never revisited and never revisits. Digests are of whole payloads; an empty table makes no archive.
    """
    spark = pages.sparkSession
    root = root or shared_path(spark, "warc")
    where, base = store(root)
    where.create_dir(base, recursive=True)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    p = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload).alias("sha"))
    # only payloads that repeat are joined back; their table is small next to the pages, and a hot one is one row
    short = F.octet_length("html") >= least
    again = p.where(short & F.col("page_id").isNotNull()).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("s"), "first")
    q = p.join(again, (p["sha"] == F.col("s")) & short, "left")
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first"))

    @F.arrow_udf("string")
    def base32(x: pa.Array) -> pa.Array:
        return pa.array([base64.b32encode(bytes.fromhex(h)).decode() for h in x.to_pylist()], pa.string())

    # the dictionary is made of the beginnings of the pages with the smallest ids
    ids = [r[0] for r in pages.select("page_id").where("page_id is not null").distinct().orderBy("page_id").limit(SAMPLED).collect()]
    some = pages.where(F.col("page_id").isin(ids)).select("page_id", F.substring("html", 1, 1 << 14).alias("html")).orderBy("page_id", "html").collect() if ids else []
    dictionary = b"".join((r["html"] or "").encode() for r in some)[:SAMPLES][-DICTIONARY:]
    rows = q.select("page_id", "url", "html", refers.alias("refers"), base32(F.col("sha")).alias("name"))
    return stash(rows.mapInArrow(_write(root, dictionary), "path string"), "warc-paths")


def read_archives(paths: DataFrame, page_id: str = "bigint") -> DataFrame:
    """Every record of the archives, validated: (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload).

    Every archive is a task of its own. A revisit has no payload of its own; ``checked`` holds it against the response.
    ``page_id`` is the type of the ids that were written.
    """
    kinds = "page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, payload binary"
    read = paths.repartition(max(1, paths.count())).mapInArrow(_read, kinds)
    return read.withColumns({c: F.col(c).cast(page_id) for c in ("page_id", "refers_to")})


def checked(records: DataFrame) -> DataFrame:
    """``records`` without payloads, written and read again, if every revisit names a response of its digest and length.

    Revisits are reduced to one row for each page they name before they meet the responses, so a page that very many
    revisit is one row.
    """
    kept = stash(records.drop("payload"), "warc-records")
    named = kept.where("record_type = 'revisit'").select(F.col("refers_to").alias("page"), "payload_digest", "payload_bytes").distinct()
    responses = kept.where("record_type = 'response'").select(F.col("page_id").alias("page"), "payload_digest", "payload_bytes")
    lost = named.join(responses, ["page", "payload_digest", "payload_bytes"], "left_anti").limit(5).collect()
    if lost:
        raise BadRecord(f"revisits of pages that have no such response: {lost}")
    return kept


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = write_archives(table(spark, sf_dir, "pages"))
    return checked(read_archives(paths)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows from the pages themselves.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p),
b AS (SELECT page_id, first, octet_length(payload) AS n,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(list_sum(list_transform(range(0, 5), lambda j: ((instr('0123456789abcdef', sha[1 + ((5 * i + j) // 4)]) - 1) >> (3 - (5 * i + j) % 4) & 1) << (4 - j))) AS INT), 1)), 'string_agg', '') AS d FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
