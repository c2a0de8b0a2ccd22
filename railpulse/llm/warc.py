"""Deterministic sharded WARC writer and the reader that checks it.

Pages are sorted by id: shard boundaries are equal steps of the id range, computed from exact minimum,
maximum and count, so they do not depend on the cluster.  A task writes the shards it is dealt, one
gzip member for each record, and begins another file whenever the compressed size would pass the limit.
Headers and digests are made anew from the payload.  Files are written under temporary names and moved
to their final ones; a task that runs twice writes the same bytes under the same names.  The manifest,
moved into place last, names the files that count.

Of records with equal payloads of ``MIN_REVISIT_BYTES`` or more the one with the smallest page id is the
response, the others revisit it.  Rows that repeat id and payload give one response and revisits of the
same id.  A null payload is empty.  A null id sorts last: its record has no id header and it revisits
the smallest id with that payload, or, if there is none, is itself a response.  An empty table gives an
archive without files and no rows.  Columns other than id, url and payload are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.llm.common import bounded_batches, table
from railpulse.session import checkpoint_root

MIN_REVISIT_BYTES = 0
SHARD_ROWS = 2000  # ids of one shard, where they are evenly spread
FILE_BYTES = 8 << 20  # compressed size at which a file is closed
DATE = "2024-01-01T00:00:00Z"  # one date for all records, so that equal input gives equal archives
LEVEL = 6
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


def bare_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = bare_digest(hashlib.sha1(payload).digest())
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}"
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)),
               ("WARC-Date", DATE), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"),
               ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{bare_digest(hashlib.sha1(block).digest())}")]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    return member(headers, block)


class Roller:
    """Writes the records of sorted shards to files that are closed by compressed size or shard end."""

    def __init__(self, root: str, file_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.limit, self.out, self.shard = file_bytes, None, None

    def add(self, shard: int, data: bytes):
        """Yields the manifest line of a file that this record has closed."""
        if self.out is not None and (shard != self.shard or self.size + len(data) > self.limit):
            yield self.close()
        if self.out is None:
            self.seq = self.seq + 1 if shard == self.shard else 0
            self.shard, self.size, self.records = shard, 0, 0
            self.name = f"part-{shard:010d}-{self.seq:05d}.warc.gz"
            self.temporary = f"{self.root}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            info = b"software: deterministic sharded writer\r\nformat: WARC File Format 1.1\r\n"
            self.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, self.name)}>"),
                               ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self.write(data)
        self.records += 1

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> tuple[str, int, int, int, int]:
        self.out.close()
        self.out = None
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        return self.name, self.shard, self.seq, self.records, self.size


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, sha1, refers_to) for every (id, payload) that repeats the payload of a smaller id."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = pages.select("page_id", F.unhex(F.sha1(html)).alias("sha1"), F.octet_length(html).alias("n")).where(
        F.col("n") >= min_bytes)
    first = slim.groupBy("sha1", "n").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    return slim.join(first, ["sha1", "n"]).where("page_id is null or page_id > refers_to").where(
        "refers_to is not null").select("page_id", "sha1", "refers_to").distinct()


def write_archive(pages: DataFrame, root: str, min_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> str:
    """Write ``pages`` (page_id, url, html) below the folder ``root`` (a URI); returns the manifest's path."""
    spark = pages.sparkSession
    bounded_batches(spark)
    low, high, n = pages.agg(F.min("page_id"), F.max("page_id"), F.count("page_id")).first()
    low, width = low or 0, max(1, -(-((high or 0) - (low or 0) + 1) * SHARD_ROWS // max(1, n)))
    shard = F.coalesce(F.floor((F.col("page_id").cast("decimal(20,0)") - low) / width).cast("long"), F.lit((1 << 33)))
    none = F.lit(None)
    info = revisits(pages, min_bytes).select(
        shard.alias("shard"), "page_id", F.lit(0).alias("kind"), "sha1", "refers_to", none.cast("string").alias("url"),
        none.cast("binary").alias("html"))
    body = pages.select(
        shard.alias("shard"), "page_id", F.lit(1).alias("kind"), none.cast("binary").alias("sha1"),
        none.cast("bigint").alias("refers_to"), "url", F.col("html").cast("binary").alias("html"))
    # url and html settle the order of rows that share an id; most ids are unique, so it costs little
    dealt = info.unionByName(body).repartition("shard").sortWithinPartitions(
        "shard", F.col("page_id").asc_nulls_last(), "kind", "url", "html")

    def work(batches):
        roller, now, refers, mine = Roller(root, file_bytes), (), {}, set()
        line = []
        for batch in batches:
            for r in batch.to_pylist():
                if now != (r["shard"], r["page_id"]):
                    now, refers, mine = (r["shard"], r["page_id"]), {}, set()
                if r["kind"] == 0:
                    refers[r["sha1"]] = r["refers_to"]
                    continue
                payload = r["html"] or b""
                sha1 = hashlib.sha1(payload).digest()
                to = refers.get(sha1)
                if to is None and sha1 in mine and r["page_id"] is not None and len(payload) >= min_bytes:
                    to = r["page_id"]
                mine.add(sha1)
                line += roller.add(r["shard"], page_record(r["page_id"], r["url"], payload, to, to is not None))
            if line:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in line], schema=fields)
                line = []
        if roller.out is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, roller.close(), strict=True))], schema=fields)

    names = ["file", "shard", "seq", "records", "bytes"]
    fields = pa.schema([("file", pa.string())] + [(x, pa.int64()) for x in names[1:]])
    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    dealt.mapInArrow(work, "file string, shard bigint, seq bigint, records bigint, bytes bigint").write.mode(
        "overwrite").json(f"{root}/_manifest.tmp")
    fs.move(f"{path}/_manifest.tmp", f"{path}/_manifest")
    return f"{root}/_manifest"


def parse(stream):
    """(headers, block) of each record of a gzip stream with a member for every record."""
    z, data, out = zlib.decompressobj(31), b"", []
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
        out.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            raw, out, z = b"".join(out), [], zlib.decompressobj(31)
            head, _, rest = raw.partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            size = int(headers["Content-Length"])
            if len(rest) != size + 4:
                raise ValueError(f"record of {size} bytes has {len(rest) - 4}")
            yield headers, rest[:size]
    if out and any(out):
        raise ValueError("the file ends within a record")


def read_archive(spark, root: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page record the manifest
    at ``root`` names, digests checked against the blocks."""
    files = spark.read.schema("file string, shard bigint, seq bigint, records bigint, bytes bigint").json(f"{root}/_manifest")
    fields = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])

    def work(batches):
        fs, path = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for file, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with fs.open_input_stream(f"{path}/{file}", compression=None) as stream:
                    for headers, block in parse(stream):
                        if headers["WARC-Type"] not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if bare_digest(hashlib.sha1(block).digest()) != headers["WARC-Block-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"{file}: a block does not have its digest")
                        if headers["WARC-Type"] == "response" and (
                                len(payload) != size or bare_digest(hashlib.sha1(payload).digest()) != digest):
                            raise ValueError(f"{file}: a payload does not have its digest")
                        page, to = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                        rows.append((page and int(page), size, digest, headers["WARC-Type"], to and int(to)))
                if len(rows) != records:
                    raise ValueError(f"{file} has {len(rows)} records, the manifest says {records}")
                yield pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], schema=fields)

    # a task for each file: manifest lines are too small for Spark to tell how much work they stand for
    return files.select("file", "records").repartition(max(1, files.count())).mapInArrow(
        work, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def new_root(spark) -> str:
    """A folder of its own below the shared one."""
    return f"{checkpoint_root(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """All ``pages`` written to WARC archives in the shared folder and read back."""
    root = new_root(spark)
    write_archive(table(spark, sf_dir, "pages"), root)
    return read_archive(spark, root)


#: DuckDB: SHA-1 as base32 by groups of 5 hexadecimal digits, 20 bits, 4 letters
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(encode(body)) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS digest,
        min(page_id) OVER (PARTITION BY hex, n) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
