"""Exact top-k inner-product search over vector-approximation files.

Every vector component falls in one of 256 equal-width cells of its dimension, so a vector's
approximation is one byte a dimension. Beside it stands what the cell leaves open, each
component's place within its cell, in as few bytes as the widest cell needs (none if cells
are one wide): cell and place together are the exact vector. Vectors are dealt into blocks,
each an own approximation file. For a block of queries a scan of the cells gives every
vector's lower and upper bound of the score by one matrix product; the kth largest lower
bound already rules out most vectors, and places of the rest are read in order of their bound
until the kth result is certain. Blocks' lists of k are merged per query.

The stated query set meets all rows in blocks: rows of (block, query block) meet in one group
of at most ``BLOCK`` and ``QUERY_BLOCK`` rows on average, whatever the table's size.

Defined cases: vectors that are null or hold null or non-finite components take no part;
repeated rows (equal id and vector) count once; vectors meet only vectors of their own
dimension; a query with fewer than k others gets all of them; ties go to the smaller id;
equal vectors are scored once; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table

BLOCK = 4096
#: Queries that meet a block at once: the whole file travels once for each such block of queries.
QUERY_BLOCK = 16384
#: Queries whose bounds over a block are held at once.
_SUB = 256


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v array<long>): floor(scale * component) of the vectors that take part."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (
        vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fine)
        .select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
        .distinct()
    )


def grid(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per dimension count: each dimension's least value and cell width. As large as the
    dimensions are many, whatever the number of vectors."""
    ends = rows.select(F.size("v").alias("d"), F.posexplode("v")).groupBy("d", "pos").agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d, pos, lo, hi in ends.collect():
        low, width = out.setdefault(d, (np.zeros(d, np.int64), np.ones(d, np.int64)))
        low[pos], width[pos] = lo, -(-(hi - lo + 1) // 256)
    return out


def place_kind(width: np.ndarray) -> str:
    """The smallest unsigned type that holds a place within any cell; none for cells one wide."""
    widest = int(width.max(initial=1))
    return next(kind for kind, most in (("", 1), ("u1", 1 << 8), ("<u2", 1 << 16), ("<u4", 1 << 32), ("<u8", 1 << 64)) if widest <= most)


def approximate(rows: DataFrame, bounds: dict[int, tuple[np.ndarray, np.ndarray]], blocks: int) -> DataFrame:
    """(d, block, id, cells binary, places binary): the approximation and what it leaves open."""

    def run(batches):
        for batch in batches:
            cells, places, sizes = [], [], []
            for v in batch.column(1):
                x = np.asarray(v.values, np.int64)
                low, width = bounds.get(len(x), (np.zeros(0, np.int64),) * 2) if len(x) else (x, np.ones(0, np.int64))
                cell, place = np.divmod(x - low, width)
                kind = place_kind(width)
                cells.append(cell.astype(np.uint8).tobytes())
                places.append(place.astype(kind).tobytes() if kind else b"")
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), batch.column(2), batch.column(0), pa.array(cells, pa.binary()), pa.array(places, pa.binary())], ["d", "block", "id", "cells", "places"])

    dealt = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    return dealt.mapInArrow(run, "d int, block int, id long, cells binary, places binary")


def matrix(column: pa.ChunkedArray, kind: str, d: int) -> np.ndarray:
    """Rows of ``d`` values each; of none where there is nothing to hold."""
    raw = b"".join(column.to_pylist()) if kind and d else b""
    return np.frombuffer(raw, kind).reshape(len(column), d) if kind and d else np.zeros((len(column), 0), np.uint8)


def exact(cells: np.ndarray, places: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The vectors that cells and places stand for."""
    whole = low + cells.astype(np.int64) * width
    return whole + places.astype(np.int64) if places.shape[1] else whole


def search_block(cells: np.ndarray, places: np.ndarray, ids: np.ndarray, query_cells: np.ndarray, query_places: np.ndarray, query_ids: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> tuple[list, list, list, int]:
    """Query ids, ids and scores of each query's k best in one block, and exact vectors read."""
    order = np.argsort(ids, kind="stable")
    cells, places, ids = cells[order], places[order], ids[order]
    if cells.shape[1]:
        raw = np.hstack([cells, np.ascontiguousarray(places).view(np.uint8).reshape(len(ids), -1)]) if places.shape[1] else np.ascontiguousarray(cells)
        _, lead, back = np.unique(raw.view(f"V{raw.shape[1]}").ravel(), return_index=True, return_inverse=True)
    else:
        lead, back = np.zeros(1, np.int64), np.zeros(len(ids), np.int64)
    by = np.argsort(back, kind="stable")
    first = np.searchsorted(back[by], np.arange(len(lead) + 1))
    # of equal vectors the k + 1 smallest ids can ever be wanted: one may be the query itself
    members = [ids[by[a : min(b, a + k + 1)]] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    floor_ = (low + cells[lead].astype(np.int64) * width).astype(np.float64)
    found_q, found_id, found_score, read = [], [], [], 0
    for at in range(0, len(query_ids), _SUB):
        queries = exact(query_cells[at : at + _SUB], query_places[at : at + _SUB], low, width)
        q = queries.astype(np.float64)
        base = q @ floor_.T
        room = (width - 1).astype(np.float64)
        blur = 1e-12 * (np.abs(q) @ np.abs(floor_).max(axis=0, initial=0.0))[:, None]
        upper = base + (np.maximum(q, 0) @ room)[:, None] + blur
        lower = base + (np.minimum(q, 0) @ room)[:, None] - blur
        n = lower.shape[1]
        if n > k + 1:
            sure = np.partition(lower, n - k - 1, axis=1)[:, n - k - 1]
        else:
            sure = np.full(len(q), -np.inf)
        row, col = np.nonzero(upper >= sure[:, None])
        ends = np.searchsorted(row, np.arange(len(q) + 1))
        for i in range(len(q)):
            cand = col[ends[i] : ends[i + 1]]
            bound = upper[i, cand]
            cand, bound = cand[by_bound := np.argsort(-bound, kind="stable")], bound[by_bound]
            best: list[tuple[int, int]] = []
            own, vector, pos = int(query_ids[at + i]), queries[i], 0
            while pos < len(cand) and (len(best) < k or bound[pos] >= -best[-1][0]):
                some = cand[pos : pos + 2 * k]
                scores = exact(cells[lead[some]], places[lead[some]], low, width) @ vector
                read += len(some)
                best.extend((-s, m) for c, s in zip(some.tolist(), scores.tolist()) for m in members[c].tolist() if m != own)
                best = sorted(best)[:k]
                pos += 2 * k
            found_q.extend([own] * len(best))
            found_id.extend(m for _, m in best)
            found_score.extend(-s for s, _ in best)
    return found_q, found_id, found_score, read


def top_k(rows: DataFrame, query_filter, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product with each row that
    ``query_filter`` (a Column over ``id``) selects. ``rows``: (id, v array<long>)."""
    bounds = grid(rows)
    n = rows.count()
    file = cut(approximate(rows, bounds, max(1, math.ceil(n / BLOCK))), "vector-approximations")
    blocks = max(1, math.ceil(n / BLOCK))
    asked = file.filter(query_filter)
    parts = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    data = file.select("d", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "cells", "places")
    queries = asked.select("d", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id", "block"), F.lit(parts)).cast("int").alias("part"), "id", "cells", "places")

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pa.table({x: pa.array([], pa.int64()) for x in names})
        d = key[0].as_py()
        low, width = bounds.get(d, (np.zeros(d, np.int64), np.ones(d, np.int64)))
        kind = place_kind(width)
        both = [x for side in (left, right) for x in (matrix(side["cells"], "u1", d), matrix(side["places"], kind, d), side["id"].to_numpy())]
        q, m, s, _ = search_block(*both, low, width, k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(m, pa.int64()), "score": pa.array(s, pa.int64())})

    keys = ["d", "block", "part"]
    near = data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(whole_vectors(read_table(spark, sf_dir, "embeddings")), F.col("id") % 20 == 0, 20)


ORACLE_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
