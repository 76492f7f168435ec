"""WARC archives: one gzip member for each record, read one after the other.

Records of pages go to archives of about SEGMENT bytes in a shared folder. Each archive is written under a name of
its own by one task attempt; a manifest row names it once the task has ended, so that files of lost or repeated
attempts are never read. Of equal payloads one record is a response (that of the largest page_id), the others are
revisits that refer to it and carry no payload. The reader inflates piece by piece, takes the header off as soon as it is
whole, frames the block by Content-Length and checks digests as the bytes come, so that no more than one block and one
piece are held at a time.

Records carry ids of their own (random UUIDs) and the date given to write(); the page's number is in X-Page-ID, that of
the page that a revisit refers to in X-Refers-To-Page-ID, as
the id of its record is not known where the revisit is written.

A null payload is empty; null urls are written as an empty target; a null page_id is a record without number (its
revisits refer to a page that has one, if there is one). Repeated rows are records of their own, all of them
responses if they share the largest page_id. An empty table gives no archives and no rows; other columns are not
read, whatever their names. Payloads may be as long as a string of Spark may be."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WRITTEN, cut, maybe_broadcast, shared_dir

SEGMENT, CHUNK, MOST_TASKS = 16 << 20, 1 << 16, 100_000
MANIFEST = "path string, records long, bytes long"


class Damaged(ValueError):
    """An archive that doesn't hold what it says."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that Spark names, and the path in it. Schemes of Hadoop's connectors are those that
    pyarrow knows under other names."""
    scheme, sep, rest = uri.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "gs": "gs"}.get(scheme, scheme) + sep + rest)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member."""
    block = b"" if revisit else payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    head += [("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        head += [("X-Refers-To-Page-ID", "" if first is None else str(first)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/octet-stream"), ("Content-Length", str(len(block)))]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def number(text: str | None) -> int | None:
    return int(text) if text else None


def chunks(file, size: int = CHUNK) -> Iterator[bytes]:
    while part := file.read(size):
        yield part


class Reader:
    """One record as its bytes come: feed() pieces, then close() for headers and block."""

    def __init__(self):
        self.head, self.fields, self.block, self.left, self.tail, self.sum = bytearray(), None, bytearray(), 0, b"", hashlib.sha1()

    def feed(self, part: bytes) -> None:
        if self.fields is None:
            self.head += part
            end = self.head.find(b"\r\n\r\n", max(len(self.head) - len(part) - 3, 0))
            if end < 0:
                return
            version, *lines = self.head[:end].decode("utf-8", "surrogatepass").split("\r\n")
            if not version.startswith("WARC/"):
                raise Damaged("no WARC record")
            self.fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
            self.left, part = int(self.fields["Content-Length"]), bytes(self.head[end + 4 :])
            self.head.clear()
        if self.left:
            took = part[: self.left]
            self.block += took
            self.sum.update(took)
            self.left -= len(took)
            part = part[len(took) :]
        self.tail += part
        if len(self.tail) > 4:
            raise Damaged("bytes behind the block")

    def close(self) -> tuple[dict[str, str], bytes]:
        fields, block = self.fields, bytes(self.block)
        if fields is None:
            raise Damaged("no WARC record")
        if self.left or self.tail != b"\r\n\r\n":
            raise Damaged(f"a block of {len(block)} bytes where {fields['Content-Length']} are told")
        found = f"sha1:{base64.b32encode(self.sum.digest()).decode()}"
        if fields["WARC-Block-Digest"] != found:
            raise Damaged("a block that its digest does not match")
        if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != found:
            raise Damaged("a payload that its digest does not match")
        return fields, block


def records(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream of bytes, one gzip member each, checked."""
    unpacker, one = zlib.decompressobj(31), None
    for part in parts:
        while part:
            one = one or Reader()
            try:
                piece = unpacker.decompress(part, CHUNK)
            except zlib.error as e:
                raise Damaged(str(e)) from e
            one.feed(piece)
            part = unpacker.unconsumed_tail or unpacker.unused_data
            while not unpacker.eof and not part and len(piece) == CHUNK:  # what zlib still holds back
                piece = unpacker.decompress(b"", CHUNK)
                one.feed(piece)
            if unpacker.eof:
                yield one.close()
                part = unpacker.unused_data
                unpacker, one = zlib.decompressobj(31), None
    if one:
        raise Damaged("the last member is cut short")


def write(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> DataFrame:
    """Archives of pages; returns their manifest (path, records, bytes). Payloads under least bytes are never revisits.
    date: WARC-Date of the records, now if not given. The archives are among what sweep() deletes."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    WRITTEN.append(folder)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html"))
    # only payloads that occur again are looked up: while those are few, no page is shuffled
    firsts, _ = cut(rows.where(F.col("size") >= least).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    again = F.coalesce(F.col("copies"), F.lit(0)) > 1
    rows = rows.join(maybe_broadcast(firsts), "sha", "left").select("page_id", "url", "html", "first", (again & (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))

    def run(batches):
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        file, path, count, size, done = None, "", 0, 0, []

        def end():
            file.close()
            done.append((f"{folder}/{path}", count, size))

        for b in batches:
            for page, link, text, first, revisit in zip(*(b.column(i).to_pylist() for i in range(5))):
                if file is None:
                    path, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    file = store.open_output_stream(f"{base}/{path}", compression=None)
                part = record(page, link, text.encode("utf-8", "surrogatepass"), first, revisit, date)
                file.write(part)
                count, size = count + 1, size + len(part)
                if size >= SEGMENT:
                    end()
                    file = None
        if file is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return cut(rows.mapInArrow(run, MANIFEST), "manifest")[0]


def read(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload) of every record of the archives in
    manifest; a damaged one fails. payload is null for revisits."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        for b in batches:
            for uri, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, path = store_of(uri)
                out, held, seen = [], 0, 0
                with store.open_input_stream(path, compression=None) as file:
                    for h, block in records(chunks(file)):
                        kind = h["WARC-Type"]
                        out.append((number(h["X-Page-ID"]), h["WARC-Target-URI"], kind, number(h.get("X-Refers-To-Page-ID")), h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), block if kind == "response" else None))
                        held, seen = held + len(block), seen + 1
                        if held > SEGMENT:
                            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)
                            out, held = [], 0
                if seen != wanted:
                    raise Damaged(f"{uri} has {seen} records, not {wanted}")
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    # a number of tasks by the bytes behind the manifest: its own rows are so few that adaptive execution would merge them
    known = manifest.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    tasks = max(1, min(known.n, max(8, -(-(known.bytes or 0) // SEGMENT)), MOST_TASKS))
    return manifest.select("path", "records").repartition(tasks).mapInArrow(run, schema)
