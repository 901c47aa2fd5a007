"""WARC archives: a distributed writer, and a sequential reader of one gzip member per record.

The writer compresses each page once, finds the newest page of every payload by its SHA-1, and lets the others of the payload refer to it. Each task writes its own archives into the shared folder and reports their paths; only reported archives are read, so a task that was lost and run again leaves no double records.

The reader inflates a member piece by piece, takes header lines until the empty line, then exactly Content-Length bytes, and compares the block's digest, and a response's payload digest, with the header. Memory is bounded by the read size and one record's header, whose length follows that of its url (and by one payload where payloads are asked for).

Defined results: a null page is empty; pages under `least` bytes are never revisits; of equal payloads the largest page_id is the response (rows that repeat it too), and a null page_id is never referred to: it revisits a named page of the payload, or is a response where there is none. Empty tables give no archives and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_texts, fresh_folder, materialise

RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _clean(value: str | None) -> str:
    """A header value holds no line ends."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def member(page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, refers_to: int | None, level: int = 4) -> bytes:
    """One record as one gzip member. payload None: a revisit, which keeps the HTTP header of the payload it leaves out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode() + (payload or b"")
    kind = "response" if payload is not None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}"]
    if payload is None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


class Bad(ValueError):
    """An archive breaks the format or a digest."""


class _Inflated:
    """The bytes of one member after another, inflated as they are asked for."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.raw, self.ready, self.z = stream, size, b"", b"", None

    def begin(self) -> bool:
        """Starts the next member; false at the end of the archive."""
        if not self.raw:
            self.raw = self.stream.read(self.size)
        self.z = zlib.decompressobj(31) if self.raw else None
        return bool(self.raw)

    def more(self) -> bytes:
        """Up to `size` further bytes; empty at the member's end."""
        while not self.z.eof:
            if not self.raw:
                self.raw = self.stream.read(self.size)
                if not self.raw:
                    raise Bad("an archive ends inside a record")
            got = self.z.decompress(self.raw, self.size)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                return got
        return b""

    def until(self, mark: bytes) -> bytes:
        held = bytearray(self.ready)
        seen = 0
        while held.find(mark, seen) < 0:
            seen = max(0, len(held) - len(mark) + 1)
            if not (got := self.more()):
                raise Bad("a header without an end")
            held += got
        held = bytes(held)
        head, _, self.ready = held.partition(mark)
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            got = self.ready or self.more()
            if not got:
                raise Bad("a record is shorter than its Content-Length")
            self.ready = got[n:]
            yield got[:n]
            n -= min(n, len(got))


def read_archive(stream, size: int = 1 << 18, payloads: bool = False) -> Iterator[dict]:
    """The records of one archive in order: header fields in lower case, payload_bytes, payload_digest and, if asked for, the payload."""
    source = _Inflated(stream, size)
    while source.begin():
        source.ready = b""
        first, *lines = source.until(b"\r\n\r\n").decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise Bad("a record without its version line")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block, payload, http, held = hashlib.sha1(), hashlib.sha1(), b"", []
        length, inside, seen = int(head["content-length"]), False, 0
        for got in source.take(length):
            block.update(got)
            if not inside:
                http += got
                if b"\r\n\r\n" not in http:
                    continue
                http, _, got = http.partition(b"\r\n\r\n")
                inside = True
            payload.update(got)
            seen += len(got)
            if payloads:
                held.append(got)
        if b"".join(source.take(4)) != b"\r\n\r\n" or source.ready or source.more():
            raise Bad("a record doesn't end after its Content-Length")
        whole = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        if head["warc-block-digest"] != f"sha1:{block.hexdigest()}" or head["warc-type"] == "response" and (seen != whole or head["warc-payload-digest"] != f"sha1:{payload.hexdigest()}"):
            raise Bad(f"a digest differs in {head['warc-record-id']}")
        yield head | {"payload_bytes": whole, "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"), "payload": b"".join(held) if payloads else None}


def write_archives(pages: DataFrame, folder: str, least: int = 1000, archive_mb: int = 256) -> DataFrame:
    """Writes every page into archives under folder; returns path and number of records of each."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    newest = (
        pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("n"))
        .filter(F.col("n") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("newest"), F.count("*").alias("rows"))
        .filter("rows > 1")
        .select("digest", "newest")
    )

    def compress(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, urls, html = part.column(0).to_pylist(), part.column(1).to_pylist(), byte_texts(part.column(2))
                digests = [hashlib.sha1(x).hexdigest() for x in html]
                made = [member(i, u, x, len(x), d, None) for i, u, x, d in zip(ids, urls, html, digests, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(digests, pa.string()), pa.array(map(len, html), pa.int64()), pa.array(made, pa.binary())], ["page_id", "url", "digest", "n", "member"])

    def write(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, digest, bytes_, made, newest_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                revisit = newest_id is not None and newest_id != page_id
                made = member(page_id, url, None, bytes_, digest, newest_id) if revisit else made
                out.write(made)
                size, n = size + len(made), n + 1
                if size > archive_mb << 20:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    ready = pages.mapInArrow(compress, "page_id long, url string, digest string, n long, member binary")
    return materialise(ready.join(newest, "digest", "left").select("page_id", "url", "digest", "n", "member", "newest").mapInArrow(write, "path string, records long"))


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the archives (column path), one archive a time in each task."""

    def number(name: str | None) -> int | None:
        got = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(got) if got else None

    def read(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with store.open_input_stream(path, compression=None) as stream:
                    for r in read_archive(stream, payloads=payloads):
                        rows.append((number(r["warc-record-id"]), r["warc-target-uri"], r["payload_bytes"], r["payload_digest"], r["warc-type"], number(r.get("warc-refers-to")), r["payload"]))
                        held += len(r["payload"] or b"")
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"]
    width = len(names) - (not payloads)

    def frame(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(zip(*rows, strict=True), types, strict=True))[:width]], names[:width])

    return archives.select("path").mapInArrow(read, RECORDS + (", payload binary" if payloads else ""))


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes the pages into new archives in the shared folder and reads them back."""
    folder = fresh_folder(spark, "warc")
    archives = write_archives(pages, folder, least)
    return read_archives(archives.repartition(max(1, archives.count()), "path"), folder)
