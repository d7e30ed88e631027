"""WARC archives with a two-level capture index.

Writing: every task writes its pages as WARC/1.1 records, one gzip member each, into files in
the shared folder. Of records with equal payloads the one with the smallest page id is a
response; the others are revisits that refer to it and carry no payload. A task that is run
again writes files of new names, and only files named by the kept index count.

Index: capture lines, keyed by the URL with its host reversed, are range-partitioned and
sorted; each partition is a shard file of gzip blocks of ``LINES`` lines, with a sparse
directory (first key, offset and length of each block) beside it. The shards' first keys are
the upper level, one row a shard. A lookup binary-searches the shards, then the shard's
directory, reads that one block by its range, and last the record by its range.

Defined cases: a null payload is empty; a null URL has the empty key and no target header;
payloads shorter than ``min_bytes`` are all responses; rows with equal payload and all of
equal smallest page id (repeated rows) are all responses; rows with a null page id are
responses unless an equal payload has an id, which they then refer to; other columns are
ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table, scratch_path

#: Capture lines of an index block.
LINES = 512
#: Bytes of a record file after which the next begins, and of one coalesced read.
FILE_BYTES = 1 << 30
READ_BYTES = 4 << 20
#: Date of all records unless the caller gives one: archives of equal input are equal.
DATE = "2024-01-01T00:00:00Z"
ENTRY = "surt string, url string, file string, offset long, length long, page_id long, kind string, digest string"


def surt(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query; no scheme, port, fragment."""
    if not url:
        return ""
    try:
        x = urlsplit(url.strip())
        host = (x.hostname or "").removeprefix("www.")
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (x.path or "/") + (f"?{x.query}" if x.query else "")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _clean(value: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str]:
    """A response record, or a revisit if ``refers_to`` is given; and the payload's digest."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", *([f"WARC-Target-URI: {_clean(url)}"] if url else []), f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> dict:
    """Headers and payload of one record; checks its length and, for a response, its digest."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(head["Content-Length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    number = lambda x: None if x in (None, "<urn:page:None>") else int(x[len("<urn:page:") : -1])
    return {"page_id": number(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "kind": kind, "bytes": size, "digest": digest, "refers_to": number(head.get("WARC-Refers-To")), "payload": payload}


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, body_col: str, min_bytes: int) -> DataFrame:
    """(page_id, url, body, refers_to). Payloads are compared by length and SHA-1; only rows of
    repeated payloads are joined, and bodies move by page id, so a common payload is no hot key."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    mark = rows.select("page_id", F.sha1(F.encode("body", "utf-8")).alias("sha"), F.octet_length("body").alias("n")).filter(F.col("n") >= min_bytes)
    leads = mark.groupBy("sha", "n").agg(F.min("page_id").alias("lead"), F.count("*").alias("times")).filter("times > 1 AND lead IS NOT NULL")
    again = mark.join(leads.hint("shuffle_hash"), ["sha", "n"]).filter(~F.col("page_id").eqNullSafe(F.col("lead"))).select(F.col("page_id").alias("p"), F.col("sha").alias("s"), F.col("lead").alias("refers_to")).distinct()
    keyed = rows.withColumn("sha", F.sha1(F.encode("body", "utf-8")))
    return keyed.join(again.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left").select("page_id", "url", "body", "refers_to")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write the records and return the capture lines (``ENTRY``), themselves already on disk."""

    def run(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            columns = [[] for _ in range(8)]
            for page_id, url, body, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"records-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    text = b"software: sparkloom\r\nformat: WARC File Format 1.1\r\n"
                    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(text)}\r\n\r\n"
                    at = out.write(first := member(info.encode() + text + b"\r\n\r\n")) or len(first)
                data, digest = record(page_id, url, body.encode(), refers_to, date)
                data = member(data)
                out.write(data)
                for column, value in zip(columns, (surt(url), url, name, at, len(data), page_id, "response" if refers_to is None else "revisit", digest)):
                    column.append(value)
                at += len(data)
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in ENTRY.split(", ")])
        if out is not None:
            out.close()

    return cut(with_revisits(pages, id_col, url_col, body_col, min_bytes).mapInArrow(run, ENTRY), "captures")


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the shard files; return the upper level: (first_key, shard, blocks, lines).

    One row a shard, so at most as many rows as the sort has partitions.
    """
    names = captures.columns

    def run(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        shard = f"index-{uuid.uuid4().hex}.cdx.gz"
        directory, waiting, at, lines, out = [], [], 0, 0, None

        def flush():
            nonlocal at
            data = member("".join(json.dumps([r[x] for x in names]) + "\n" for r in waiting).encode())
            directory.append([waiting[0]["surt"], at, len(data), len(waiting)])
            out.write(data)
            at += len(data)
            waiting.clear()

        for batch in batches:
            for row in batch.to_pylist():
                out = out or fs.open_output_stream(f"{base}/{shard}", compression=None)
                waiting.append(row)
                lines += 1
                if len(waiting) == LINES:
                    flush()
        if waiting:
            flush()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{base}/{shard}.directory", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([shard]), pa.array([len(directory)], pa.int64()), pa.array([lines], pa.int64())], ["first_key", "shard", "blocks", "lines"])

    order = ["surt", "file", "offset"]
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut(ranged.mapInArrow(run, "first_key string, shard string, blocks long, lines long"), "shards")


def read_block(fs: pafs.FileSystem, base: str, shard: str, offset: int, length: int) -> list[dict]:
    names = [x.split()[0] for x in ENTRY.split(", ")]
    with fs.open_input_file(f"{base}/{shard}") as f:
        return [dict(zip(names, json.loads(line))) for line in zlib.decompress(f.read_at(length, offset), 31).decode().splitlines()]


def read_directory(fs: pafs.FileSystem, base: str, shard: str) -> list[list]:
    with fs.open_input_file(f"{base}/{shard}.directory") as f:
        return json.loads(zlib.decompress(f.read()))


def lookup(shards: DataFrame, folder: str, urls: DataFrame, url_col: str = "url", max_shards: int = 1 << 20) -> DataFrame:
    """Captures and payloads of given URLs: (asked, page_id, url, kind, digest, refers_to, payload).

    The upper level is sent to the tasks; it has one row a shard, checked against ``max_shards``.
    """
    top = sorted((r.first_key, r.shard) for r in shards.select("first_key", "shard").limit(max_shards + 1).collect())
    if len(top) > max_shards:
        raise ValueError("the index has more shards than the upper level may hold; build it with fewer partitions")
    sent = shards.sparkSession.sparkContext.broadcast(top)

    def run(batches):
        fs, base = _open(folder)
        top, directories = sent.value, {}
        firsts = [k for k, _ in top]
        for batch in batches:
            found = []
            for url in batch.column(0).to_pylist():
                key = surt(url)
                for _, shard in top[max(0, bisect.bisect_left(firsts, key) - 1) : bisect.bisect_right(firsts, key)]:
                    if shard not in directories:
                        directories[shard] = read_directory(fs, base, shard)
                    directory = directories[shard]
                    starts = [x[0] for x in directory]
                    for _, offset, length, _ in directory[max(0, bisect.bisect_left(starts, key) - 1) : bisect.bisect_right(starts, key)]:
                        lines = read_block(fs, base, shard, offset, length)
                        keys = [x["surt"] for x in lines]
                        for line in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                            with fs.open_input_file(f"{base}/{line['file']}") as f:
                                got = parse(zlib.decompress(f.read_at(line["length"], line["offset"]), 31))
                            found.append((url, got["page_id"], got["url"], got["kind"], got["digest"], got["refers_to"], got["payload"]))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], ["asked", "page_id", "url", "kind", "digest", "refers_to", "payload"])

    return urls.select(F.col(url_col).alias("url")).mapInArrow(run, "asked string, page_id long, url string, kind string, digest string, refers_to long, payload binary")


def read_back(shards: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the index: (page_id, url, kind, bytes, digest, refers_to[, payload]).

    Shards' blocks give the captures; these are ranged by file and offset, so that records
    that lie side by side are read together.
    """

    def entries(batches):
        fs, base = _open(folder)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                for _, offset, length, _ in read_directory(fs, base, shard):
                    lines = read_block(fs, base, shard, offset, length)
                    yield pa.RecordBatch.from_arrays([pa.array([x["file"] for x in lines]), pa.array([x["offset"] for x in lines], pa.int64()), pa.array([x["length"] for x in lines], pa.int64())], ["file", "offset", "length"])

    def records(batches):
        fs, base = _open(folder)
        name, f = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            i = 0
            while i < len(files):
                j, end = i, offsets[i]
                while j < len(files) and files[j] == files[i] and offsets[j] == end and end - offsets[i] < READ_BYTES:
                    end += lengths[j]
                    j += 1
                if files[i] != name:
                    if f is not None:
                        f.close()
                    name = files[i]
                    f = fs.open_input_file(f"{base}/{name}")
                data = f.read_at(end - offsets[i], offsets[i])
                got = [parse(zlib.decompress(data[o - offsets[i] : o - offsets[i] + n], 31)) for o, n in zip(offsets[i:j], lengths[i:j])]
                columns = [pa.array([x[k] for x in got], kind) for k, kind in kinds]
                yield pa.RecordBatch.from_arrays(columns, [k for k, _ in kinds])
                i = j
        if f is not None:
            f.close()

    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("bytes", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else [])]
    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = shards.select("shard").repartition(parts, "shard").mapInArrow(entries, "file string, offset long, length long")
    near = lines.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return near.mapInArrow(records, "page_id long, url string, kind string, bytes long, digest string, refers_to long" + ", payload binary" * payloads)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    shards = build_index(write_archives(read_table(spark, sf_dir, "pages"), folder), folder)
    return read_back(shards, folder, payloads=False).select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS lead FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT)) AS w FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((w[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM lead OR lead IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM lead THEN NULL ELSE lead END AS refers_to
FROM b
"""
