"""Dictionary-compressed WARC archives (.warc.zst).

A Zstandard dictionary is built from a bounded sample of the records, stored in a leading skippable frame
of every archive, and each record is a frame of its own. An archive is one row (name, n_records, data) of
a Parquet table, as Spark has no writer of binary files; `data` is the file's bytes.

Null html is an empty payload, a null url gives no target, white space in urls is escaped. Of rows with equal
payloads of at least `least` bytes all those with the smallest page_id are responses, the others revisits;
rows with a null page_id are always responses and don't count for the smallest. Extra columns are ignored; an
empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

DICTIONARY_MAGIC = 0x184D2A5D
#: The dictionary's sample: records, bytes of each, and the dictionary's size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 16_384, 65_536
#: Compressed bytes from which an archive is closed.
ARCHIVE_BYTES = 8_000_000
ARCHIVES = "name string, n_records long, data binary"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_READ_AT_ONCE = 65_536


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; its headers tell the payload's size and digest."""
    name = str(page_id) if page_id is not None else f"none:{uuid.uuid4()}"
    block = _HTTP + (payload if kind == "response" else b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{name}>", "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    head |= {"WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(payload))}
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def warcinfo(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:archive:{name}>", "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields", "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; with too little to train on, the samples themselves."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, from the archive's bytes alone."""
    view, at, dictionary = memoryview(data), 0, None
    magic, n = struct.unpack_from("<II", view, 0)
    if magic == DICTIONARY_MAGIC:
        dictionary, at = zstandard.ZstdCompressionDict(bytes(view[8 : 8 + n])), 8 + n
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            chunk = view[at : at + _READ_AT_ONCE]
            if not len(chunk):
                raise ValueError("the archive is cut off")
            parts.append(frame.decompress(chunk))
            at += len(chunk) - len(frame.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def with_types(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html, digest, refers_to (null: a response). Only ids and digests are grouped and joined;
    html moves once, by page_id, which spreads it evenly."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    light = base.filter((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("other")).filter("refers_to < other").drop("other")
    revisits = light.join(first, "digest").filter("page_id > refers_to").distinct()
    return base.join(revisits, ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, *, least: int = 100, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives of all pages, stored on shared storage and read back as rows."""
    pick = F.xxhash64("page_id")
    picked = pages.select(pick.alias("h")).orderBy("h").limit(SAMPLE_RECORDS).agg(F.max("h").alias("h")).first().h
    sample = pages.filter(pick <= F.lit(picked)).select(F.substring(F.col("html").cast("string"), 1, SAMPLE_BYTES).alias("html"), "url").limit(SAMPLE_RECORDS).collect() if picked is not None else []
    dictionary = build_dictionary([record("response", 0, r.url, x[:SAMPLE_BYTES], hashlib.sha256(x).hexdigest(), None, date) for r in sample if (x := (r.html or "").encode())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, frames, size, n = TaskContext.get().partitionId(), 0, [], 0, 0
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=level, dict_data=data) if data else zstandard.ZstdCompressor(level=level)

        def close() -> pa.RecordBatch:
            nonlocal number, frames, size, n
            name = f"pages-{part:06d}-{number:06d}.warc.zst"
            lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
            whole = lead + writer.compress(warcinfo(name, date)) + b"".join(frames)
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([whole], pa.binary())], ["name", "n_records", "data"])
            number, frames, size, n = number + 1, [], 0, 0
            return out

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                frames.append(writer.compress(record("response" if refers_to is None else "revisit", page_id, url, payload, digest, refers_to, date)))
                size, n = size + len(frames[-1]), n + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
        if n:
            yield close()

    typed = with_types(pages, least).select("page_id", "url", "payload", "digest", "refers_to")
    return materialize(typed.mapInArrow(write, ARCHIVES), "warc", compression="uncompressed")


def read_records(archives: DataFrame) -> DataFrame:
    """One row a record, from the archives' bytes. A response's size and digest are computed from its payload
    and must equal its headers; a revisit's come from its headers."""

    def page(uri: str) -> int | None:
        name = uri.removeprefix("<urn:page:").removesuffix(">")
        return None if name.startswith("none:") else int(name)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for head, block in read_archive(data.as_py()):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")
                    payload = block.partition(b"\r\n\r\n")[2]
                    if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                    rows.append((page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("data").mapInArrow(read, RECORDS)
