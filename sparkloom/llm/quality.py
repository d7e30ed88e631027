"""Quality by importance resampling: the ratio of two hashed n-gram generative models.

1. A scan of all documents counts the documents that hold each hashed n-gram, of all rows (the raw
   model) and of those labelled good (the target model). N-grams are words, word pairs and the
   mark of a word said three times running; words are runs of letters and digits, and so are runs
   of other marks. Text is compared in lower case. An n-gram has a bucket in each of two tables, and
   the ratio nearer to 1 holds, so one collision does not make a common n-gram look bad.
2. A document's log importance is the sum, over the distinct n-grams of its whole text, of
   log(target / raw). Weights are those of rejection sampling, at most 1: ratios over 1 count as
   1. So do ratios that chance explains: by Chernoff's bound an n-gram expected in e documents of
   the target is seen in g or fewer with probability exp(-(e - g + g log(g / e))) at most, and only
   n-grams for which that is under one in all that could get there count (see ``least_surprise``).
3. Documents are sampled by Gumbel top-k: each one's key is its log importance plus Gumbel noise from
   a hash of its id and text, and the k largest keys stay. A document of weight w is then kept with
   probability 1 - exp(-t w); t gives a document of weight 1 the probability ``spare``, and k is the sum
   of these probabilities. The kth largest key is found by histogram passes over keys.

The target model is made from about ``MAX_LABELS`` labelled documents at most, picked by a hash of their
ids; the raw model counts all documents.

Defined cases: null or empty text has importance 0; where the labels tell no n-gram from chance (none, or
none good, or too few) everything is kept; equal keys at the kth place are all kept; of several labels
of a document the worst holds, labels of null ids none; rows of equal id and text share their key and
fate, rows of equal or null id and different texts do not; other columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SpanHash, cut, mix, pieces, read_table, small, utf8, version

#: Buckets of each table.
BUCKETS = 1 << 18
#: Pseudo-documents that smooth both models.
PSEUDO = 0.5
#: Labelled documents, about, that make the target model.
MAX_LABELS = 1 << 18
#: Bytes of text whose n-grams are held at once; a longer text is taken alone.
TEXT_BYTES = 1 << 20
#: Gumbel noise's seed.
SEED = 4
#: Hash of the mark of a word said three times running.
_AGAIN = 7

#: Byte classes: 0 white space, 1 letters, digits and UTF-8 sequences, 2 other marks.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[SPACE] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def ngrams(data: np.ndarray, offsets: np.ndarray, hasher: SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every n-gram, repeats included."""
    kind = _CLASS[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[1:n] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(edge[:n] & (kind > 0))
    follow = np.flatnonzero(edge)
    ends = follow[np.searchsorted(follow, starts, "right")]
    h = hasher(data, starts, ends)
    # empty rows share an offset with the next row: the last of them owns the text
    row = np.searchsorted(offsets, starts, "right") - 1
    same = row[1:] == row[:-1]
    with np.errstate(over="ignore"):
        two = mix(h[:-1] * np.uint64(3) + h[1:])[same]
    again = np.zeros(len(h), bool)
    for step in (1, 2):  # a a a, or with a mark between: a, a, a
        if len(h) > 2 * step:
            again[: -2 * step] |= (h[: -2 * step] == h[step:-step]) & (h[step:-step] == h[2 * step :]) & (row[: -2 * step] == row[2 * step :])
    return np.concatenate([h, two, np.full(int(again.sum()), _AGAIN, np.uint64)]), np.concatenate([row, row[1:][same], row[again]])


def once_a_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, row)."""
    with np.errstate(over="ignore"):
        key = mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.unique(key, return_index=True)[1]
    return h[at], row[at]


def buckets(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An n-gram's bucket in either table."""
    n = np.uint64(BUCKETS)
    return (h % n).astype(np.int64), ((h >> np.uint64(24)) % n).astype(np.int64) + BUCKETS


def with_labels(docs: DataFrame, labels: DataFrame, id_col: str, max_labels: int = MAX_LABELS) -> DataFrame:
    """``docs`` with _good: 1 labelled good (quality 1, not toxic), 0 labelled otherwise, or null."""
    worst = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("_good"))
    n = worst.count()
    if n > max_labels:
        worst = worst.filter(F.shiftrightunsigned(F.xxhash64("_id"), 1) < int((1 << 63) * (max_labels / n)))
    return docs.join(small(worst, 2 * max_labels), docs[id_col] == F.col("_id"), "left").drop("_id")


def counts(labelled: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, raw, good): documents that hold an n-gram of each bucket; of bucket -1, all documents."""

    def run(batches):
        hasher = SpanHash()
        raw, good, n, n_good = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64), 0, 0
        for batch in batches:
            data, offsets = utf8(pc.utf8_lower(batch.column(0)))
            flag = pc.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False) == 1
            n, n_good = n + len(batch), n_good + int(flag.sum())
            for first, part, ends in pieces(data, offsets, TEXT_BYTES):
                h, row = once_a_row(*ngrams(part, ends, hasher))
                own = flag[first + row]
                for bucket in buckets(h):
                    raw += np.bincount(bucket, minlength=2 * BUCKETS)
                    good += np.bincount(bucket[own], minlength=2 * BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(raw[at], n)), pa.array(np.append(good[at], n_good))], ["bucket", "raw", "good"])

    part = labelled.select(F.col(text_col).alias("text"), "_good").mapInArrow(run, "bucket int, raw long, good long")
    return part.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))


def least_surprise(expected: DataFrame) -> float:
    """The least t, in quarters, such that of the buckets expected t times or more (others can't reach a
    surprise of t) less than one is expected to reach it by chance."""
    found = expected.groupBy(F.least(F.floor(F.col("e") * 4), F.lit(160)).cast("int").alias("q")).count().collect()
    n = np.bincount([r.q for r in found], [r["count"] for r in found], minlength=161)[::-1].cumsum()[::-1]
    return int(np.flatnonzero(n * np.exp(-np.arange(161) / 4) <= 1)[0]) / 4


def log_ratio(model: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket where it is under 1 beyond chance, else 0. Only those buckets
    reach the driver, of 2 * BUCKETS at most."""
    model = cut(model, "ngram-counts")
    whole = model.filter("bucket = -1").first()
    out = np.zeros(2 * BUCKETS)
    if whole is None or not whole.good:
        return out
    e, g = F.col("raw") * F.lit(whole.good / whole.raw), F.col("good").cast("double")
    chance = e - g + F.when(g > 0, g * F.log(g / e)).otherwise(0.0)
    some = model.filter("bucket >= 0")
    rare = some.filter((g < e) & (chance > least_surprise(some.select(e.alias("e"))))).select("bucket", F.log((g + PSEUDO) / (e + PSEUDO)).alias("r")).toArrow()
    # in steps of 1 / 65536, so that sums don't depend on their order
    out[rare["bucket"].to_numpy()] = np.round(rare["r"].to_numpy() * 65536) / 65536
    return out


def log_importances(column: pa.Array, ratio: np.ndarray, hasher: SpanHash) -> np.ndarray:
    data, offsets = utf8(pc.utf8_lower(column))
    out = np.zeros(len(column))
    for first, part, ends in pieces(data, offsets, TEXT_BYTES):
        h, row = ngrams(part, ends, hasher)
        a, b = buckets(h)
        some = (ratio[a] < 0) & (ratio[b] < 0)
        h, row = once_a_row(h[some], row[some])
        a, b = buckets(h)
        out[first : first + len(ends) - 1] = np.bincount(row, weights=np.maximum(ratio[a], ratio[b]), minlength=len(ends) - 1)
    return out


def scorer(spark: SparkSession, ratio: np.ndarray):
    """A function from a text column to its log importance. The model is 2 * BUCKETS numbers."""
    sent = spark.sparkContext.broadcast(ratio)
    state = {}

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        if not state:
            state["hasher"] = SpanHash()
        return pa.array(log_importances(text, sent.value, state["hasher"]))

    return score


def gumbel(id_col, text_hash, seed: int = SEED):
    """Gumbel(0, 1) noise from a hash of id and text: -ln(-ln(u))."""
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(id_col.cast("string"), F.lit("")), text_hash, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, key: str, k: int, bins: int = 4096) -> float:
    """The kth largest value of a finite column, by histogram passes that narrow its range."""
    if k <= 0:
        return np.inf
    lo, hi, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if k >= n:
        return -np.inf
    above = 0  # rows over hi
    while True:
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            return lo
        inside = rows.filter((F.col(key) >= lo) & (F.col(key) <= hi))
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col(key) - lo) / width)).cast("int")
        found = inside.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy(F.desc("b")).collect()
        for row in found:
            if above + row.n >= k:
                if row.n == 1 or row.lo == row.hi:
                    return row.lo
                lo, hi = row.lo, row.hi
                break
            above += row.n


def with_keys(docs: DataFrame, ratio: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with log_importance and gumbel_key."""
    scored = docs.withColumn("log_importance", scorer(docs.sparkSession, ratio)(F.col(text_col)))
    return scored.withColumn("gumbel_key", F.col("log_importance") + gumbel(F.col(id_col), version(text_col)))


def sample_size(scored: DataFrame, spare: float) -> int:
    """k: the documents' probabilities to be kept, summed."""
    t = -float(np.log(1 - spare))
    return int(np.ceil(scored.agg(F.sum(1 - F.exp(-t * F.exp("log_importance")))).first()[0] or 0))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", spare: float = 0.9999) -> tuple[np.ndarray, DataFrame, float]:
    """The model, (id, log_importance, gumbel_key) of every row, and the least key that stays."""
    ratio = log_ratio(counts(with_labels(docs.select(id_col, text_col), labels, id_col), text_col))
    scored = cut(with_keys(docs.select(id_col, text_col), ratio, id_col, text_col).drop(text_col), "importance")
    return ratio, scored, kth_largest(scored, "gumbel_key", sample_size(scored, spare)) if ratio.any() else -np.inf


def resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", spare: float = 0.9999) -> DataFrame:
    """(id, log_importance, gumbel_key, kept) of every row of ``docs``."""
    _, scored, least = fitted(docs, labels, id_col, text_col, spare)
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(float(least)))


def keep_sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", spare: float = 0.9999) -> DataFrame:
    """Rows of ``docs`` that stay. Texts are scored again where they lie, so no row moves or is joined."""
    ratio, _, least = fitted(docs, labels, id_col, text_col, spare)
    key = scorer(docs.sparkSession, ratio)(F.col(text_col)) + gumbel(F.col(id_col), version(text_col))
    return docs.filter(key >= F.lit(float(least)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
