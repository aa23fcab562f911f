"""WARC archives: one gzip member for each record, payload deduplication by revisit records, and a sequential reader.

The writer runs on the executors and puts whole files into a folder that all of them share; a file appears under its name only
when it is complete, so a task that is run again cannot leave a torn archive. The reader takes a file's bytes in stretches,
decompresses member after member, frames records by their Content-Length, and checks block and payload digests.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import cut, lookup, shared_dir, slices

#: Payload bytes from which equal payloads are written once; bytes of one archive; bytes the reader takes at a time.
LEAST, ARCHIVE_BYTES, STRETCH = 100, 64 << 20, 1 << 16
_END = b"\r\n"


class WarcError(ValueError):
    """An archive that is cut short, badly framed, or whose digest does not hold."""


def record(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member; Content-Length and the block's digest are added to its headers."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))])
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    return made.compress(b"WARC/1.1\r\n" + head.encode() + _END) + made.compress(block) + made.compress(_END + _END) + made.flush()


def members(take: Callable[[int], bytes], stretch: int = STRETCH) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as stretches of its decompressed bytes; a member must be read to its end before the next."""
    rest = take(stretch)
    while rest:
        def stretches() -> Iterator[bytes]:
            nonlocal rest
            inflate = zlib.decompressobj(31)
            while True:
                out = inflate.decompress(rest, stretch)
                rest = inflate.unconsumed_tail
                if out:
                    yield out
                if inflate.eof:
                    rest = inflate.unused_data or take(stretch)
                    return
                if not rest and not (rest := take(stretch)):
                    raise WarcError("the archive ends inside a member")

        yield stretches()


def read(take: Callable[[int], bytes], stretch: int = STRETCH) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record in turn."""
    for member in members(take, stretch):
        held = bytearray()
        while (end := held.find(b"\r\n\r\n")) < 0:
            part = next(member, None)
            if part is None:
                raise WarcError("a record without an end of its headers")
            held += part
        version, *lines = held[:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise WarcError(f"not a WARC record: {version[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        del held[: end + 4]
        for part in member:
            held += part
            if len(held) > length + 4:
                break
        if len(held) > length + 4:
            raise WarcError("a record longer than its Content-Length")
        if bytes(held[length:]) != _END + _END:
            raise WarcError("a record shorter than its Content-Length")
        block = bytes(held[:length])
        said = headers.get("warc-block-digest")
        if said and said != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise WarcError(f"block digest of {headers.get('warc-record-id')}")
        yield headers, block


def payload(headers: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP headers of a response; checked against its digest."""
    body = block.partition(_END + _END)[2]
    if headers["warc-payload-digest"] != f"sha256:{hashlib.sha256(body).hexdigest()}":
        raise WarcError(f"payload digest of {headers.get('warc-record-id')}")
    return body


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark gives it, so that archives lie where Spark's own readers look for them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A file system and a path in it, of a qualified path."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, digest, n_bytes, first) with ``first`` the smallest page_id of equal payloads of ``least`` bytes or more, else null."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))
    narrow = cut(rows.where(F.col("n_bytes") >= least).select("digest", "page_id"))
    # Only payloads that come more than once are looked up, and by then there is one row for each.
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = lookup(narrow, cut(first), "digest").where(F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") > F.col("first")))
    # A row is a copy by its page_id and digest, so one page_id with two payloads is told apart.
    copies = copies.select("page_id", "digest", "first").distinct()
    return rows.join(copies, ["page_id", "digest"], "left")


def write(pages: DataFrame, folder: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write an archive or more for each partition; the manifest (path, n_records) of complete files, already evaluated.

    The folder is made; a path without a scheme lies in Spark's default file system. All records carry the time of the call.
    """
    folder = qualified(pages.sparkSession, folder)
    fs, base = store(folder)
    fs.create_dir(base)
    date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        stem, part, out, size, n = uuid.uuid4().hex, 0, None, 0, 0
        path = lambda: f"{base}/{stem}-{part:05d}.warc.gz"

        def close():
            out.close()
            fs.move(path() + ".open", path())
            return pa.RecordBatch.from_pydict({"path": [path()], "n_records": pa.array([n], pa.int64())})

        for b in slices(batches, "html"):
            for row in b.to_pylist():
                body = row["html"].encode()
                headers = [("WARC-Type", "revisit" if row["first"] is not None else "response"), ("WARC-Record-ID", f"<urn:page:{row['page_id']}>"), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Target-URI", (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("X-Payload-Length", str(len(body)))]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                if row["first"] is None:
                    http += body
                else:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{row['first']}>")]
                if out is None:
                    out, size, n = fs.open_output_stream(path() + ".open", compression=None), 0, 0
                made = record(headers, http)
                out.write(made)
                size, n = size + len(made), n + 1
                if size >= archive_bytes:
                    yield close()
                    out, part = None, part + 1
        if out is not None:
            yield close()

    return cut(plan(pages, least).mapInArrow(put, "path string, n_records long"))


def load(manifest: DataFrame, folder: str, stretch: int = STRETCH) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of every record of the archives of a manifest.

    A revisit has the length and digest of the payload it stands for, and no payload. A torn or altered archive raises
    ``WarcError``, and so does one with fewer records than its manifest says.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    number = lambda x: None if x in (None, "<urn:page:None>") else int(x[len("<urn:page:") : -1])

    def get(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        fs, _ = store(folder)
        arrow = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for frame in frames:
            for path, n in zip(frame.column("path").to_pylist(), frame.column("n_records").to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with fs.open_input_stream(path, compression=None) as file:
                    for h, block in read(file.read, stretch):
                        body = payload(h, block) if h["warc-type"] == "response" else None
                        rows.append((number(h["warc-record-id"]), len(body) if body is not None else int(h["x-payload-length"]), h["warc-payload-digest"].partition(":")[2], h["warc-type"], number(h.get("warc-refers-to")), h["warc-target-uri"], body))
                        size, seen = size + len(block), seen + 1
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                if seen != n:
                    raise WarcError(f"{path} has {seen} records; its manifest says {n}")

    folder = qualified(manifest.sparkSession, folder)
    many = max(1, min(manifest.count(), 10_000))
    return manifest.repartition(many, "path").mapInArrow(get, schema)


def round_trip(pages: DataFrame, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to new archives in the shared folder and read them back; see ``load`` for the columns.

    Null html is an empty payload; payloads of fewer than ``least`` bytes are always responses. Rows with the same page_id all
    stay; equal payloads of the smallest page_id are all responses. A null page_id is never referred to, and its row is a
    response. An empty table gives no archive and no rows.
    """
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return load(write(pages, folder, least, archive_bytes), folder)
