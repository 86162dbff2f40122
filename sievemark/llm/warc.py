"""WARC records in seekable Zstandard bundles.

A bundle is a series of independent Zstandard frames with some records each,
and at its end a skippable frame with the seek table: compressed and
decompressed size of every frame, as the seekable format lays it out. The index
table maps each record's key to its bundle, frame and offset within the
frame's decompressed bytes, so one record costs one frame.

Records whose payloads are equal are written once: the one with the largest
key is the response, the others are revisits that name it. Digests are counted
first, and those of several pages are a table of their own. Pages whose digest
may be in it meet it in a join of two plain shuffles, so Spark can split the
pages of one digest; all other pages are written where they are read.

Null payloads count as empty; a record without a key gets an identifier of its
own and is read back with a null key. Equal keys and repeated rows are kept as
separate records (of equal keys with equal payloads all are responses). An empty
table gives no bundle, and columns other than key, url and payload are ignored.
Writing is safe to
repeat: each task writes under a name of its own attempt, and only the index
says which files count.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import key_filter, materialize, maybe_in, new_path, table

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Decompressed bytes of a frame, and of a bundle, at least.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
INDEX = "page_id {kind}, bundle string, frame int, offset long, length long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def named(key) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if key is None else f"<urn:page:{key}>"


def record(key, url: str, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """A WARC/1.1 record: a response is an HTTP message around its payload, a revisit carries no block."""
    block = b""
    if kind == "response":
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", named(key)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        head += [("WARC-Refers-To", named(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def payload_of(block: bytes) -> bytes:
    """What an HTTP message carries behind its header; a revisit's empty block has nothing."""
    return block[block.index(b"\r\n\r\n") + 4 :] if block else b""


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Fields, body and end of the record that starts there."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    start, size = end + 4, int(fields["Content-Length"])
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record has no end")
    return fields, data[start : start + size], start + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *x) for x in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def read_table(tail: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed, decompressed size) of each frame, from a bundle's last bytes."""
    count, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("no seek table, or one with checksums")
    entries = tail[-9 - 8 * count : -9]
    found, at = [], 0
    for packed, plain in struct.iter_unpack("<II", entries):
        found.append((at, packed, plain))
        at += packed
    return found


class Bundle:
    """Writes a bundle; ``add`` returns the record's frame and offset."""

    def __init__(self, stream, level: int = 6):
        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.sizes, self.open, self.filled, self.total = [], [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        place = len(self.sizes), self.filled
        self.open.append(data)
        self.filled += len(data)
        self.total += len(data)
        if self.filled >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.stream.write(packed)
            self.sizes.append((len(packed), self.filled))
            self.open, self.filled = [], 0

    def close(self) -> None:
        self.flush()
        self.stream.write(seek_table(self.sizes))
        self.stream.close()


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def decided(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """pages with payload (binary), payload_digest and refers_to (null for responses)."""
    rows = pages.select(F.col(key).alias("k"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url") if "url" in pages.columns else F.lit("").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    several = rows.groupBy("sha1").agg(F.max("k").alias("largest"), F.count("*").alias("n")).where("n > 1").select("sha1", "largest")
    several = materialize(several, "warc-several")
    shared = key_filter(several, "sha1")
    refers = F.when(F.col("k") == F.col("largest"), F.lit(None)).otherwise(F.col("largest")).alias("refers_to")
    some = maybe_in(rows, shared, "sha1").join(several, "sha1", "left").select("k", "url", "payload", refers)
    rest = maybe_in(rows, shared, "sha1", found=False)
    return some.unionByName(rest.select("k", "url", "payload", F.lit(None).cast(pages.schema[key].dataType).alias("refers_to")))


def write(pages: DataFrame, out_dir: str, key: str = "page_id", payload: str = "html", date: str | None = None) -> DataFrame:
    """Writes the bundles and returns the index: key, bundle, frame, offset, length of each record; date: WARC-Date, now if not given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(out_dir)
        system.create_dir(folder)
        bundle, name, rows = None, "", []

        def done() -> pa.RecordBatch:
            bundle.close()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((key_type, pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["page_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, url, body, refers in zip(*(batch.column(i) for i in range(4)), strict=True):
                if bundle is None:
                    name, rows = f"{uuid.uuid4().hex}.warc.zst", []
                    bundle = Bundle(system.open_output_stream(f"{folder}/{name}", compression=None))
                k, body, refers = k.as_py(), body.as_py(), refers.as_py()
                data = record(k, " ".join(url.as_py().split()), body, digest_of(body), "response" if refers is None else "revisit", refers, date)
                rows.append((k, name, *bundle.add(data), len(data)))
                if bundle.total >= BUNDLE_BYTES:
                    yield done()
                    bundle = None
        if bundle is not None:
            yield done()

    kind = pages.schema[key].dataType.simpleString()
    index = decided(pages, key, payload).mapInArrow(written, INDEX.format(kind=kind))
    return materialize(index, "warc-index")


def read(index: DataFrame, out_dir: str) -> DataFrame:
    """Every record of the bundles that the index names: bundle, frame, offset, fields, body."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(out_dir)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{folder}/{name}") as stream:
                    size = stream.size()
                    tail = stream.read_at(9, size - 9)
                    length = 17 + 8 * struct.unpack("<I", tail[:4])[0]
                    for frame, (at, packed, plain) in enumerate(read_table(stream.read_at(length, size - length))):
                        data = zstandard.ZstdDecompressor().decompress(stream.read_at(packed, at), max_output_size=plain)
                        rows, place = [], 0
                        while place < plain:
                            fields, body, after = parse(data, place)
                            rows.append((name, frame, place, fields, body))
                            place = after
                        kinds = (pa.string(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array([list(r[i].items()) if i == 3 else r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["bundle", "frame", "offset", "fields", "body"])

    names = index.select("bundle").distinct()
    return names.mapInArrow(records, "bundle string, frame int, offset long, fields map<string,string>, body binary")


def fetch(stream, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record of a bundle (a seekable binary stream), by its place in the index."""
    size = stream.seek(0, io.SEEK_END)
    stream.seek(size - 9)
    length = 17 + 8 * struct.unpack("<I", stream.read(9)[:4])[0]
    stream.seek(size - length)
    at, packed, plain = read_table(stream.read(length))[frame]
    stream.seek(at)
    return parse(zstandard.ZstdDecompressor().decompress(stream.read(packed), max_output_size=plain), offset)[:2]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page what its record, read back, says; digest and length are taken anew from the payload, a revisit's from that of the response it names."""
    pages = table(spark, sf_dir, "pages")
    out_dir = new_path(spark, "warc")
    index = write(pages, out_dir)
    kind = pages.schema["page_id"].dataType.simpleString()
    found = read(index, out_dir)
    field = lambda name: F.col("fields")[name]
    response = field("WARC-Type") == "response"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [payload_of(x.as_py()) for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 3)), pa.array([len(x) for x in bodies], pa.int64()), pa.array([digest_of(x) for x in bodies])], names=["page_id", "record_type", "refers_to", "stated", "n", "d"])

    key_in = lambda name: F.expr(f"try_cast(regexp_extract(fields['{name}'], '<urn:page:(.*)>', 1) AS {kind})")
    stated = F.struct(field("X-Payload-Length").cast("long").alias("n"), F.substring(field("WARC-Payload-Digest"), 6, 32).alias("d"))
    rows = found.select(key_in("WARC-Record-ID").alias("page_id"), field("WARC-Type").alias("record_type"), F.when(~response, key_in("WARC-Refers-To")).alias("refers_to"), stated.alias("stated"), "body")
    checked = rows.mapInArrow(sums, f"page_id {kind}, record_type string, refers_to {kind}, stated struct<n:long,d:string>, n long, d string")
    checked = materialize(checked, "warc-read")
    own = F.col("record_type") == "response"
    named_by = materialize(checked.where(~own).select("refers_to").distinct(), "warc-named")
    responses = checked.where(own).join(named_by, checked["page_id"] == named_by["refers_to"], "left_semi").groupBy(F.col("page_id").alias("refers_to")).agg(F.max(F.struct("n", "d")).alias("held"))
    # only revisits meet the responses they name, a table of its own: revisits of one response can be split
    responses = materialize(responses, "warc-responses")
    revisits = checked.where(~own).join(responses, "refers_to", "left").select("page_id", "record_type", "refers_to", F.coalesce("held", "stated").alias("p"))
    rows = checked.where(own).select("page_id", "record_type", F.lit(None).cast(kind).alias("refers_to"), F.struct("n", "d").alias("p")).unionByName(revisits)
    return rows.select("page_id", F.col("p.n").alias("payload_bytes"), F.col("p.d").alias("payload_digest"), "record_type", "refers_to")


_BITS = "".join(f"{i:04b}" for i in range(16))
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS largest FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(s, ''), lambda c: substr('{_BITS}', 4 * (instr('0123456789abcdef', c) - 1) + 1, 4)), '') AS bits FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{_DIGITS}', 1 + CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to FROM b
"""
