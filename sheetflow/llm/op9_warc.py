"""WARC records in ZIP packages: written by partition, read back by byte ranges.

Writing: payload digests are taken in one pass over the pages and reduced to the first page of each
digest (map-side minimum, so a digest shared by a third of all pages is no hot key). Each page then
becomes a ``response`` or ``revisit`` record, gzip-compressed on its own and appended to a package
``*.wacz`` with two stored members: ``archive/data.warc.gz`` and ``indexes/index.cdx`` (record
identifier, offset, length). A package is closed at ``package_records`` records or ``package_bytes``
bytes, so packages, indexes and working memory are bounded. Every attempt of a task writes files of
its own name; only those of attempts that succeeded are in the manifest, so a lost executor or a
repeated task leaves nothing wrong behind.

Reading: for each package of the manifest the central (or ZIP64) directory is parsed, the stored
members are located, the index is read, and each record is fetched by its byte range alone.

Packages are opened with ``pyarrow.fs`` under ``spark.checkpoint.dir``.

Defined results: a null payload is an empty one; payloads under ``min_dedup`` bytes are always
responses; of equal larger payloads the smallest identifier is the response; a repeated identifier gives one
record per row, each judged by its own payload; a page without an identifier is always a response
and comes back without one; an empty table gives an empty table with the same
columns; other columns of the input are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import zipread
from .common import shared_dir, stored, table

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_name(page_id: int | None) -> str:
    """Record identifier of a page; a page without an identifier has the name ``-``."""
    return f"urn:page:{'-' if page_id is None else page_id}"


def page_of(name: str) -> int | None:
    key = name.removeprefix("urn:page:")
    return None if key == "-" else int(key)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, n: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header of its response, without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_name(page_id)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{record_name(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header fields, HTTP header fields (both by lower-case name) and payload."""

    def fields(raw: bytes) -> dict[str, str]:
        lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    head, _, rest = data.partition(CRLF * 2)
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(CRLF * 2)
    return warc, fields(http), payload


class PackageWriter:
    """One ZIP package under way; members are stored, ZIP64 where sizes need it."""

    def __init__(self, system, path: str):
        self.path, self.out, self.index, self.at = path, system.open_output_stream(path), [], 0
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, key: str, data: bytes) -> None:
        packed = gzip.compress(data, 3, mtime=0)
        self.member.write(packed)
        self.index.append(f"{key} {self.at} {len(packed)}\n")
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.index))
        self.zip.close()
        self.out.close()
        return self.path, len(self.index)


def write_packages(pages: DataFrame, where: str, min_dedup: int = 100, package_records: int = 4096, package_bytes: int = 64 << 20, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """Write all pages; returns the manifest (path, records), stored beside the packages."""
    body = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    digests = stored(rows.select("id", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest")), f"{where}/digests")
    firsts = digests.filter(F.col("n") >= min_dedup).groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    repeats = (
        digests.filter(F.col("n") >= min_dedup).join(firsts.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"))
        .filter("id > first").select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("first").alias("refers_to")).distinct()
    )
    # of rows with one identifier only those with the repeated payload are revisits
    records = rows.join(repeats, (F.col("id") == F.col("r_id")) & (F.sha2("payload", 256) == F.col("r_digest")), "left").select("id", "url", "payload", "refers_to")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(where)
        system.create_dir(f"{base}/packages", recursive=True)
        writer, done = None, []
        for batch in batches:
            ids, urls, payloads, refers = (batch.column(k) for k in range(4))
            for k in range(batch.num_rows):
                page, payload, to = ids[k].as_py(), payloads[k].as_py() or b"", refers[k].as_py()
                if writer is None:
                    writer = PackageWriter(system, f"{base}/packages/{uuid.uuid4().hex}.wacz")
                digest = hashlib.sha256(payload).hexdigest()
                writer.add(record_name(page), record_bytes(page, urls[k].as_py(), payload, len(payload), digest, to))
                if len(writer.index) >= package_records or writer.at >= package_bytes:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return stored(records.mapInArrow(write, "path string, records long"), f"{where}/manifest")


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload_ok boolean"


def read_packages(manifest: DataFrame, where: str) -> DataFrame:
    """All records of the packages of a manifest; response payloads are checked against their digests."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(where)
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_file(path) as package:
                    ranged = lambda at, n, f=package: f.read_at(n, at)
                    inside = {m.name: m for m in zipread.members(ranged, package.size())}
                    start = zipread.data_offset(ranged, inside[ARCHIVE])
                    index = ranged(zipread.data_offset(ranged, inside[INDEX]), inside[INDEX].size)
                    rows = []
                    for line in io.BytesIO(index):
                        key, at, n = line.decode().split(" ")
                        warc, http, payload = parse_record(gzip.decompress(ranged(start + int(at), int(n))))
                        if warc["warc-record-id"] != f"<{key}>":
                            raise ValueError(f"{path}: the index leads to another record")
                        kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha256:")
                        to = warc.get("warc-refers-to", "").removeprefix("<").removesuffix(">")
                        whole = kind == "revisit" or (hashlib.sha256(payload).hexdigest() == digest and len(payload) == int(http["content-length"]))
                        rows.append((page_of(key), int(http["content-length"]), digest, kind, page_of(to) if to else None, warc.get("warc-target-uri"), whole))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # one task reads few packages, whatever the size of the manifest's own files
    return manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "path").select("path").mapInArrow(read, READ_SCHEMA)


def op9_warc(spark, sf_dir):
    where = shared_dir(spark)
    manifest = write_packages(table(spark, sf_dir, "pages"), where)
    return read_packages(manifest, where)


QUERIES = {"op9_warc": op9_warc}
ORACLES = {
    "op9_warc": """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to, url, true AS payload_ok
FROM p JOIN f USING (payload_digest)"""
}
