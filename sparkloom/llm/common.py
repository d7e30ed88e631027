"""Shared helpers: reading tables, cutting lineage in the shared folder, and vectorised
tokenising of Arrow string columns straight from their UTF-8 buffers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a worker holds in expanded (numpy) form at once; a longer text is taken alone.
CHUNK_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset under a local master (tests) a temporary folder is chosen and set; a cluster
    must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(base)
    base = base.rstrip("/")
    return "file://" + base[5:] if base.startswith("file:/") and not base.startswith("file://") else base


def small(df: DataFrame, max_rows: int = 1 << 20, max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows and their bytes, both counted, are within the bounds;
    beyond them Spark joins it by shuffling, which can spill and splits hot keys."""
    width = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    n, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


def version(text_col: str) -> Column:
    """A hash of the whole text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def by_row(docs: DataFrame, rows: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` semi- or anti-joined with ``rows`` (id, version): by id and text, so that neither null nor
    repeated ids reach other documents. The names don't clash with columns of ``docs``."""
    there = {x.lower() for x in docs.columns}
    a, b = (next(x for x in (stem + "_" * i for i in range(len(there) + 1)) if x not in there) for stem in ("row_id", "row_version"))
    return docs.join(small(rows.toDF(a, b)), docs[id_col].eqNullSafe(F.col(a)) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col(b)), how)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/sparkloom/{what}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session may have ended before
            pass

    atexit.register(remove)
    return path


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that every
    executor sees, so a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table made by ``cut`` once nothing will read it again."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# ---------------------------------------------------------------- text in Arrow buffers

#: The ASCII white space of the line and word rules, [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Yield (first row, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that stay within rows, and each row's range of runs."""
    n = len(inside)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    cutting = np.zeros(n + 1, bool)
    cutting[offsets] = True
    first = inside & cutting[:-1]
    first[1:] |= inside[1:] & ~inside[:-1]
    first[0] = inside[0]
    last = inside & cutting[1:]
    last[:-1] |= inside[:-1] & ~inside[1:]
    last[-1] = inside[-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class SpanHash:
    """64-bit hashes of byte spans of one buffer, in a few passes over the buffer."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.power) < len(data) + 1:
            n = len(data) + 1
            with np.errstate(over="ignore"):
                self.power = np.full(n, _BASE, np.uint64)
                self.inverse = np.full(n, _INVERSE, np.uint64)
                self.power[0] = self.inverse[0] = 1
                np.multiply.accumulate(self.power, out=self.power)
                np.multiply.accumulate(self.inverse, out=self.inverse)
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=total[1:])
            return mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (a xor-shift-multiply finaliser)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))
