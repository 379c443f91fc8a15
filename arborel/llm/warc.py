"""WARC archives: deterministic sharded writing, and reading back.

Records are range-sorted by page id.  Each task writes one range as gzip
members, one a record, and rolls to a new file by compressed size.  Headers
and digests are made anew from the payloads.  Files are written under
temporary names and renamed when whole; a manifest, written last, commits
them.  Of equal payloads, one record holds the body and others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import new_path, pieces, ranged, shards_for, written
from .tokenbin import make_folder, store

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # name space of URLs, RFC 4122


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(_SPACE, f'{page_id}/{digest}').urn}>"


def base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def hexadecimal(label: str) -> str:
    kind, _, value = label.partition(":")
    if kind != "sha1":
        raise ValueError(f"no SHA-1 digest: {label}")
    return base64.b32decode(value).hex()


def _member(lines: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _clean(url: str | None) -> str:
    """A header value: control characters would break the header apart."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in url or "")


def record(page_id: int | None, url: str | None, size: int, digest: str, newest: int | None, body: bytes | None, date: str) -> bytes:
    """One record, compressed; without a body it is a revisit of page `newest`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (body or b"")
    lines = [("WARC-Type", "response" if body is not None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", _clean(url))]
    if page_id is not None:
        lines.append(("X-Page-ID", str(page_id)))
    if body is None:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(newest, digest)), ("X-Refers-To-Page", str(newest))]
    lines += [("WARC-Payload-Digest", base32(digest)), ("WARC-Block-Digest", base32(hashlib.sha1(block).hexdigest())), ("Content-Type", "application/http;msgtype=response")]
    return _member(lines, block)


class Roller:
    """Writes the records of one range to files of about `roll` compressed bytes."""

    def __init__(self, folder: str, shard: int, roll: int, date: str):
        self.fs, self.folder = store(folder)
        self.shard, self.roll, self.date, self.files, self.out = shard, roll, date, [], None

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.out is not None and self.size >= self.roll:
            self.close()
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{len(self.files):04d}.warc.gz"
            self.temporary = f"{self.folder}/{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.n, self.first = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, page_id
            info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            self.out.write(info)
            self.size += len(info)
        self.out.write(data)
        self.size += len(data)
        self.n, self.last = self.n + 1, page_id

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")
            self.files.append({"name": self.name, "records": self.n, "bytes": self.size, "first": self.first, "last": self.last})
            self.out = None


def write_warc(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, roll: int = 1 << 30, shards: int | None = None, date: str = "1970-01-01T00:00:00Z", most_broadcast: int = 200_000) -> dict:
    """Write an archive of all pages; return its manifest.

    Payloads of at least `least` bytes that are equal: the record with the
    largest page id is a response, others revisit it.  Null html is an empty
    payload; null ids come first and revisit like smaller ids, but are
    responses where no equal payload has an id.  Rows with one id and payload
    each give a record, all of the same type.  An empty table gives a manifest
    without files.  Other columns are not read.  Shards are cut by counts of
    all ids, so that the same pages give the same files in every run.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body")).withColumns({"digest": F.sha1("body"), "size": F.octet_length("body").cast("long")})
    newest = written(rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("digest", "newest"), "newest")
    small = newest.count() <= most_broadcast  # one digest and one number a row; beyond that both sides are shuffled
    marked = rows.join(F.broadcast(newest) if small else newest, "digest", "left")
    revisit = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    marked = marked.select("page_id", "url", "size", "digest", F.when(revisit, F.col("newest")).alias("newest"), F.when(~revisit, F.col("body")).alias("body"))
    ordered = ranged(marked, "page_id", shards or shards_for(pages)).sortWithinPartitions("page_id", "digest", "url")
    make_folder(path)
    files = pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        roller = Roller(path, TaskContext.get().partitionId(), roll, date)
        for batch in batches:
            for a, b, _, _ in pieces(batch, 5):
                for r in zip(*(c.to_pylist() for c in batch.slice(a, b - a).columns), strict=True):
                    roller.add(r[0], record(*r, date))
        roller.close()
        if roller.files:
            yield pa.RecordBatch.from_pylist(roller.files, files)

    done = ordered.mapInArrow(write, "name string, records long, bytes long, first long, last long").collect()  # one row a file
    manifest = {"records": sum(r["records"] for r in done), "files": sorted((r.asDict() for r in done), key=lambda r: r["name"])}
    filesystem, place = store(path)
    with filesystem.open_output_stream(f"{place}/manifest.json.tmp") as out:
        out.write(json.dumps(manifest).encode())
    filesystem.move(f"{place}/manifest.json.tmp", f"{place}/manifest.json")
    return manifest


def members(file, size: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed members of a gzip stream, one after another."""
    rest = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            chunk = rest or file.read(size)
            if not chunk:
                if parts:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(z.decompress(chunk))
            rest = z.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one decompressed record, checked against length and block digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    length = int(headers["Content-Length"])
    block = rest[:length]
    if not first.startswith("WARC/") or rest[length:] != b"\r\n\r\n":
        raise ValueError("no whole WARC record")
    if (label := headers.get("WARC-Block-Digest")) and hexadecimal(label) != hashlib.sha1(block).hexdigest():
        raise ValueError(f"block digest differs in {headers.get('WARC-Record-ID')}")
    return headers, block


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, payload binary"


def read_warc(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The response and revisit records of an archive that its manifest commits.

    Digests and lengths are checked against the bytes; a difference is an error.
    """
    filesystem, place = store(path)
    with filesystem.open_input_stream(f"{place}/manifest.json") as file:
        names = [f["name"] for f in json.loads(file.read())["files"]]
    listed = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)))
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("payload", pa.binary())][: 8 if payloads else 7])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, folder = store(path)
                out: list[list] = [[] for _ in kinds]
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as file:
                    for data in members(file):
                        headers, block = parse(data)
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = hexadecimal(headers["WARC-Payload-Digest"])
                        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"payload digest differs in {headers['WARC-Record-ID']}")
                        page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page")
                        row = (page and int(page), size, digest, kind, refers and int(refers), headers.get("WARC-Target-URI"), name, payload if kind == "response" else None)
                        for o, v in zip(out, row, strict=False):
                            o.append(v)
                        if len(out[0]) >= 500:
                            yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, kinds, strict=True)], schema=kinds)
                            out = [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, kinds, strict=True)], schema=kinds)

    return listed.mapInArrow(read, RECORDS if payloads else RECORDS.removesuffix(", payload binary"))


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write all pages to a new archive of the shared store and read its records back."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path, payloads=False)
