"""WARC archives: pages are written as records, one gzip member each, and read back by byte ranges.

Writing: each task writes its own archives into the shared folder and returns their paths; only archives named in the
written manifest count, so a lost or repeated attempt leaves at most a file that nothing reads.

Reading: archives are cut into byte ranges whatever their records. A task scans its range for the gzip magic, takes a
candidate for a member only if its header decodes to a WARC version line, follows the members from there, and owns
exactly the records that start inside its range; the last one is read on past the range's end.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import drop_paths, text_bytes, tidy, written
from lodevec.llm.exact_dedup import filter_bits, hit_filter, with_mark
from lodevec.sources.store import shared_path

MAGIC = b"\x1f\x8b\x08"


@dataclass(frozen=True)
class WarcParams:
    """archive_bytes: size at which a task starts another archive; range_bytes: of a reading task's share; window: bytes
    fetched at a time; tasks: most reading tasks, beyond which a task reads several ranges; date: of all records, so
    reruns write the same bytes; least: payloads from this many bytes on may be revisits."""

    archive_bytes: int = 64 << 20
    range_bytes: int = 8 << 20
    window: int = 1 << 20
    tasks: int = 20_000
    date: str = "2024-01-01T00:00:00Z"
    least: int = 0
    level: int = 6


def with_types(pages: DataFrame, p: WarcParams, paths: list[str]) -> DataFrame:
    """(page_id, url, payload, refers_to, kind): which record is the response of its payload and which revisit it."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    may = rows.where(F.length("payload") >= p.least)
    hits = written(may.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first"), "payloads", paths)
    bits = filter_bits(hits.count())
    marked = with_mark(rows, "digest", written(hit_filter(hits, bits), "filter", paths), bits)
    alone = marked.where("not _maybe").withColumn("first", F.lit(None).cast("long"))
    joined = marked.where("_maybe").join(hits, "digest", "left").select(alone.columns)
    both = alone.unionByName(joined)
    again = F.coalesce((F.length("payload") >= p.least) & ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    return both.select("page_id", "url", "payload", F.when(again, F.col("first")).alias("refers_to"), F.when(again, "revisit").otherwise("response").alias("kind"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, kind: str, p: WarcParams) -> bytes:
    """One record, not compressed. A revisit holds the HTTP header alone, with the full payload's length."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {p.date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:  # a header value can't hold line ends
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(rows: DataFrame, folder: str, p: WarcParams) -> DataFrame:
    """(path, bytes, records) of the archives, as a lazy frame: write it once and read that."""

    def run(batches):
        store, at = fs.FileSystem.from_uri(folder)
        root = folder[: len(folder) - len(at)] if folder.endswith(at) else ""  # scheme and authority, for the manifest
        store.create_dir(at, recursive=True)
        out, path, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, payload, refers_to, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, size, n = f"{at}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                data = member(record(page_id, url, payload, refers_to, kind, p), p.level)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= p.archive_bytes:
                    out.close()
                    done.append((root + path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((root + path, size, n))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], ["path", "bytes", "records"])

    return rows.mapInArrow(tidy(run), "path string, bytes long, records long")


class RangeReader:
    """The members that start in [start, end) of a file."""

    def __init__(self, file, size: int, start: int, end: int, window: int):
        self.file, self.size, self.start, self.end, self.window = file, size, start, end, window

    def fetch(self, at: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(self.window, self.size - at))

    def inflate(self, at: int) -> tuple[bytes, int] | None:
        """The member at a place and where the next one begins; None if no WARC member begins there."""
        z, parts, here, head = zlib.decompressobj(31), [], at, b""
        try:
            while not z.eof:
                data = self.fetch(here)
                if not data:
                    return None
                here += len(data)
                parts.append(z.decompress(data))
                if len(head) < 7:
                    head = b"".join(parts)[:7]
                    if not b"WARC/1.".startswith(head[:7]):
                        return None
        except zlib.error:  # not a member, or its check sum is wrong
            return None
        return (b"".join(parts), here - len(z.unused_data)) if head == b"WARC/1." else None

    def first(self) -> int | None:
        """The first place in the range where a member begins."""
        at = self.start
        while at < self.end:
            data = self.fetch(at)
            k = data.find(MAGIC)
            while k >= 0 and at + k < self.end:
                if self.inflate(at + k):
                    return at + k
                k = data.find(MAGIC, k + 1)
            if len(data) < len(MAGIC) or at + len(data) >= self.size:
                return None
            at += len(data) - len(MAGIC) + 1
        return None

    def members(self) -> Iterator[tuple[int, bytes]]:
        at = self.first()
        while at is not None and at < self.end:
            found = self.inflate(at)
            if not found:
                raise ValueError(f"broken member at {at}")
            yield at, found[0]
            at = found[1]


def parsed(data: bytes) -> dict:
    """The header fields of a record (names in lower case), its HTTP header and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return fields | {"payload": payload, "payload_bytes": length}


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, path string, offset long"


def read_archives(manifest: DataFrame, p: WarcParams, payloads: bool = True) -> DataFrame:
    """The records of archives (path, bytes). A response's length and digest are taken from its payload; a payload that
    contradicts its header's digest fails the read. payloads: whether to return them."""
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(p.range_bytes).cast("long"))
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(cuts).alias("start"))
    # The number is stated, so that no two ranges are put in one task for being short rows.
    many = manifest.agg(F.sum(F.ceil(F.col("bytes") / p.range_bytes))).first()[0]
    ranges = ranges.repartitionByRange(min(int(many or 1), p.tasks), "path", "start")

    def run(batches):
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, at = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_file(at) as file:
                    for place, data in RangeReader(file, size, start, min(size, start + p.range_bytes), p.window).members():
                        r = parsed(data)
                        digest = r["warc-payload-digest"].removeprefix("sha1:")
                        if r["warc-type"] == "response" and (len(r["payload"]) != r["payload_bytes"] or base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest):
                            raise ValueError(f"payload of the record at {place} of {path} contradicts its header")
                        url = r.get("warc-target-uri")
                        url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                        rows.append((int(r["x-page-id"]) if "x-page-id" in r else None, url, r["warc-type"], int(r["x-refers-to-page"]) if "x-refers-to-page" in r else None, r["payload_bytes"], digest, r["payload"] if payloads else None, path, place))
                        if len(rows) == 200:
                            yield batch_of(rows)
                            rows = []
                yield batch_of(rows)

    return ranges.mapInArrow(tidy(run), RECORD)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in RECORD.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], list(names))


def round_trip(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html) and read the archives back: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    Null html is an empty payload; a null url leaves its field out. Of records with equal payloads the one with the
    largest page_id is the response; rows that repeat this page_id with this payload are responses as well. A null
    page_id comes back as null; it revisits where its payload has a page_id elsewhere, else it is a response. An empty
    table gives no archive and an empty result. The archives are deleted once they are read back.
    """
    spark, paths = pages.sparkSession, []
    folder = shared_path(spark, "warc")
    manifest = written(write_archives(with_types(pages, params, paths), folder, params), "manifest", paths)
    back = read_archives(manifest, params, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    back = written(back, "records")
    drop_paths(spark, [*paths, folder])
    return back
