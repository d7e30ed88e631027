"""Line deduplication by range-partitioned line hashes and per-document keep bitmaps.

1. A scan emits (128-bit hash of the line's key, document, position) for every line whose key
   has at least ``min_chars`` code points. No text leaves this scan.
2. Rows are range-partitioned by hash and document and sorted within partitions by hash,
   document and position, so a very common line spreads over many partitions. Each
   partition streams its runs, marks every document's lines after the first occurrence and
   counts documents; only a run that touches a partition's edge stays open, and a small
   table of such runs' counts settles it.
3. Dropped positions of each document become a zlib-compressed keep bitmap (bit 1: keep).

Defined cases: null or empty text is one empty line; its key is empty and never dropped while
``min_chars`` > 0; rows with equal id and equal text count as one document and share a
bitmap; rows with equal id and different text are different documents; other columns stay.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table, release, small, version

#: Bytes stripped from both ends of a line.
STRIPPED = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Rows of a batch that the line scan returns.
_BATCH = 1 << 16


def line_key(line: bytes) -> bytes:
    return line.strip(STRIPPED).lower()


def n_points(key: bytes) -> int:
    """Code points of UTF-8 bytes, without decoding."""
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_words: int = 0) -> DataFrame:
    """(h1, h2, id, version, pos): one row per line with a key of enough code points and words."""

    def run(batches):
        digest, signed = xxhash.xxh3_128_digest, np.dtype("<i8")
        for batch in batches:
            texts, versions = batch.column(1), batch.column(2).to_numpy()
            rows, pos, raw = [], [], []

            def flush():
                h = np.frombuffer(b"".join(raw), signed).reshape(-1, 2)
                out = pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(versions[rows]), pa.array(pos, pa.int32())], ["h1", "h2", "id", "version", "pos"])
                rows.clear(), pos.clear(), raw.clear()
                return out

            for i in range(len(batch)):
                text = texts[i].as_buffer()
                for p, line in enumerate((text.to_pybytes() if text is not None else b"").split(b"\n")):
                    key = line_key(line)
                    if n_points(key) >= min_chars and (not min_words or len(key) >= 2 * min_words - 1 and len(key.split()) >= min_words):
                        rows.append(i), pos.append(p), raw.append(digest(key))
                        if len(rows) >= _BATCH:
                            yield flush()
            if rows:
                yield flush()

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), version(text_col).alias("version"))
    return ids.mapInArrow(run, f"h1 long, h2 long, id {ids.schema['id'].dataType.simpleString()}, version long, pos int")


def mark(batches, min_docs: int, keep_first: bool):
    """Stream sorted (h1, h2, id, version, pos) rows; yield the rows to drop.

    state 2: dropped; state 1: dropped if the open run reaches ``min_docs`` in all; state 0:
    an open run's number of documents here. ``first``: the row is its run's first here.
    """
    names = ["h1", "h2", "id", "version", "pos", "state", "n_docs", "first"]
    held: list[pa.RecordBatch] = []  # rows of one run, joined only once it ends
    first_run = True

    def settle(table: pa.RecordBatch, open_run: bool):
        h1, h2 = table.column(0).to_numpy(), table.column(1).to_numpy()
        # ids are compared as dictionary codes, so any type will do
        doc = table.column(2).dictionary_encode(null_encoding="encode").indices.to_numpy()
        ver, n = table.column(3).to_numpy(), len(table)
        new_run = np.ones(n, bool)
        new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_doc = new_run.copy()
        new_doc[1:] |= (doc[1:] != doc[:-1]) | (ver[1:] != ver[:-1])
        starts = np.flatnonzero(new_run)
        sizes = np.diff(np.append(starts, n))
        n_docs = np.add.reduceat(new_doc, starts, dtype=np.int64)
        state = np.repeat(np.where(n_docs >= min_docs, 2, -1), sizes)
        if open_run:
            state[:] = 1
        take = np.flatnonzero(state > 0)
        first = new_run[take]
        if keep_first and not open_run:
            take, first = take[~first], first[~first]
        part = table.take(pa.array(take))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(state[take].astype(np.int32)), pa.nulls(len(take), pa.int64()), pa.array(first)], names)
        if open_run:
            lead = table.slice(0, 1)
            yield pa.RecordBatch.from_arrays([*lead.columns, pa.array([0], pa.int32()), pa.array([int(n_docs[0])], pa.int64()), pa.array([True])], names)

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not len(batch):
            continue
        h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        if held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (int(h1[0]), int(h2[0])):
            yield from settle(joined(), first_run)
            held, first_run = [], False
        if len(edges):
            held.append(batch.slice(0, int(edges[0])))
            yield from settle(joined(), first_run)
            begin, end, first_run = int(edges[0]), int(edges[-1]), False
            if end > begin:
                yield from settle(batch.slice(begin, end - begin), False)
            held, batch = [], batch.slice(end)
        held.append(batch)
    if held:
        yield from settle(joined(), True)


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, keep_first: bool, min_words: int = 0) -> DataFrame:
    """(id, version, pos) of every line to drop."""
    hashes = cut(line_hashes(docs, id_col, text_col, min_chars, min_words), "line-hashes")
    kind = hashes.schema["id"].dataType.simpleString()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), hashes.rdd.getNumPartitions())
    order = ["h1", "h2", "id", "version", "pos"]
    marked = cut(
        hashes.repartitionByRange(parts, "h1", "h2", "id", "version")
        .sortWithinPartitions(*order)
        .mapInArrow(lambda batches: mark(batches, min_docs, keep_first), f"h1 long, h2 long, id {kind}, version long, pos int, state int, n_docs long, first boolean"),
        "line-marks",
    )
    release(hashes)
    # at most two rows a partition: broadcast within a counted size, else shuffled
    total = marked.filter("state = 0").groupBy("h1", "h2").agg(F.sum("n_docs").alias("total"), F.min(F.struct("id", "version", "pos")).alias("lead")).filter(F.col("total") >= min_docs)
    total = cut(total, "line-totals")
    open_rows = marked.filter("state = 1").select("h1", "h2", "id", "version", "pos").join(small(total), ["h1", "h2"])
    if keep_first:
        here = F.struct("id", "version", "pos")
        open_rows = open_rows.filter(~here.eqNullSafe(F.col("lead")))
    return marked.filter("state = 2").select("id", "version", "pos").unionAll(open_rows.select("id", "version", "pos"))


def pack(n_lines: int, drop) -> bytes:
    keep = np.ones(n_lines, np.uint8)
    keep[drop] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, min_docs: int = 2, keep_first: bool = True, min_words: int = 0) -> DataFrame:
    """(id, version, n_lines, n_dropped, bitmap) of every document that loses a line.

    Lines whose key is found in ``min_docs`` documents lose all occurrences, or all but the
    first by (id, position) with ``keep_first``; lines under ``min_words`` words stay. ``version`` is the text's hash.
    """
    lost = dropped_lines(docs, id_col, text_col, min_chars, min_docs, keep_first, min_words).groupBy("id", "version").agg(F.collect_list("pos").alias("pos"))
    size = docs.select(F.col(id_col).alias("id2"), version(text_col).alias("v2"), (F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"))) + 1).alias("n")).distinct()
    both = size.join(lost.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("version") == F.col("v2"))).select("id", "version", F.col("n").cast("long").alias("n"), "pos")

    def run(batches):
        for batch in batches:
            n = batch.column(2).to_pylist()
            drops = [np.asarray(x.values) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([len(x) for x in drops], pa.int64()), pa.array([pack(k, x) for k, x in zip(n, drops)], pa.binary())], ["id", "version", "n_lines", "n_dropped", "bitmap"])

    kind = both.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"id {kind}, version long, n_lines long, n_dropped long, bitmap binary")


def with_bitmaps(docs: DataFrame, maps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with _n_dropped and _bitmap (null: every line stays)."""
    maps = maps.select(F.col("id").alias("_id"), F.col("version").alias("_version"), F.col("n_dropped").alias("_n_dropped"), F.col("bitmap").alias("_bitmap"))
    return docs.join(maps.hint("shuffle_hash"), docs[id_col].eqNullSafe(F.col("_id")) & (version(text_col) == F.col("_version")), "left").drop("_id", "_version")


def kept_text(text: bytes, bitmap: bytes | None) -> bytes:
    if bitmap is None:
        return text
    lines = text.split(b"\n")
    return b"\n".join(x for x, keep in zip(lines, unpack(bitmap, len(lines))) if keep)


def drop_lines(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken out of their texts."""

    @F.pandas_udf("string")
    def rest(text, bitmap):
        return text.combine(bitmap, lambda t, b: t if b is None else kept_text(t.encode(), b).decode())

    joined = with_bitmaps(docs, maps, id_col, text_col)
    return joined.withColumn(text_col, F.when(F.col("_bitmap").isNull(), F.col(text_col)).otherwise(rest(text_col, "_bitmap"))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    joined = with_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs, min_chars=1, min_docs=10, keep_first=False), "doc_id", "text")

    def run(batches):
        for batch in batches:
            n, sha = [], []
            for text, bitmap in zip(batch.column(1), batch.column(3)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                n.append(raw.count(b"\n") + 1)
                sha.append(hashlib.sha256(kept_text(raw, bitmap.as_py())).hexdigest())
            dropped = [x or 0 for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, lines, list_transform(lines, lambda x: translate(regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ks FROM d),
u AS (SELECT DISTINCT doc_id, unnest(ks) AS line FROM k),
bad AS (SELECT line FROM u WHERE length(line) >= 1 GROUP BY line HAVING count(*) >= 10),
m AS (SELECT list(line) AS lines FROM bad),
r AS (SELECT doc_id, k.lines AS lines, [k.lines[i] FOR i IN range(1, len(k.lines) + 1) IF NOT list_contains(coalesce(m.lines, []), ks[i])] AS kept FROM k, m)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM r
"""
