"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame
operations only.

Test items are partitioned by their number of distinct shingles of ``width`` words into classes of
doubling size; an item of fewer words is one shingle of them all, and documents are cut into
shingles of that many words too. An item's sketch holds the smallest hashes of its shingles, as many
as its class asks for: an item of n shingles of which a document holds at least ``share`` misses at
most n - ceil(share * n), so at least one hash of a sketch one longer than that for the
class's largest n is among the document's shingles, however long the document is. The
inverted index of sketch hashes therefore finds every document; each found pair is verified
by the exact containment of the item's shingles as text.

Words are runs of letters and digits of the lower-cased text.

Defined cases: an item without words matches nothing; null texts count as empty; repeated rows
give one pair; rows of equal or null id and different texts are different documents, and of
those of one id that hold an item the largest overlap is returned; an empty table gives no
pairs; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_row, cut, read_table, small, version

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


# Each step below is a column of its own: inside a lambda an expression over the row would be
# worked out again for every element. explode_outer, because explode's inferred filter on the
# array's size would be pushed below these columns and put their expressions into the lambda.


def with_hashes(rows: DataFrame, widths: Sequence[int]) -> DataFrame:
    """``rows`` with ``h``: hashes of all shingles of ``text`` of each width, each made from word hashes."""
    out = rows.withColumn("_w", words(F.col("text"))).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    for width in widths:
        out = out.withColumn(f"_h{width}", F.when(F.size("_h") >= width, _every(width)).otherwise(F.array().cast("array<long>")))
    names = [f"_h{width}" for width in widths]
    return out.withColumn("h", F.concat(*names) if names else F.array().cast("array<long>")).drop("_w", "_h", *names)


def _every(width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size("_h") - width), lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(width)]))


def with_shingles(rows: DataFrame, widths: Sequence[int]) -> DataFrame:
    """``rows`` with ``s``: the distinct shingles of ``text`` of each width."""
    out = rows.withColumn("_w", words(F.col("text")))
    for width in widths:
        every = F.transform(F.sequence(F.lit(1), F.size("_w") - width + 1), lambda i: F.array_join(F.slice("_w", i, width), " "))  # noqa: B023
        out = out.withColumn(f"_s{width}", F.when(F.size("_w") >= width, every).otherwise(F.array().cast("array<string>")))
    names = [f"_s{width}" for width in widths]
    return out.withColumn("s", F.array_distinct(F.concat(*names)) if names else F.array().cast("array<string>")).drop("_w", *names)


def sketches(items: DataFrame, share: float) -> DataFrame:
    """(item, version, hash) for each sketch hash of each item with its hashes ``h``."""
    sized = (
        items.withColumn("h", F.sort_array(F.array_distinct("h")))
        .select("item", "version", "h", F.size("h").alias("n"))
        .filter("n > 0")
        .withColumn("largest", F.pow(F.lit(2), F.floor(F.log2("n")) + 1).cast("int") - 1)
        .withColumn("k", (F.col("largest") - F.ceil(F.col("largest") * F.lit(share) - F.lit(1e-9)) + 1).cast("int"))
    )
    return sized.select("item", "version", F.explode(F.slice("h", F.lit(1), F.col("k"))).alias("hash"))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = 5, share: float = 0.8) -> DataFrame:
    """(doc, v, item, version, n, n_shared) of the pairs at ``share`` or more; v is the text's hash."""
    rows = docs.select(F.col(id_col).alias("doc"), version(text_col).alias("v"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_id_col).alias("item"), version(item_text_col).alias("version"), F.col(item_text_col).alias("text")).distinct()
    asked = cut(asked.withColumn("width", F.least(F.lit(width), F.size(words(F.col("text"))))).filter("width > 0"), "items")
    widths = sorted(r.width for r in asked.select("width").distinct().collect())  # ``width`` rows at most
    of_width = lambda make: reduce(DataFrame.unionAll, [make(asked.filter(F.col("width") == w), [w]) for w in widths] or [make(asked, [])])
    index = cut(sketches(of_width(with_hashes), share), "sketches")
    found = with_hashes(rows, widths).select("doc", "v", F.explode_outer("h").alias("hash"))
    pairs = cut(found.join(small(index.select("hash", "item", "version")), "hash").select("doc", "v", "item", "version").distinct(), "candidates")
    # exact containment of the candidates, on the shingles' texts
    again = by_row(rows, pairs.select("doc", "v").distinct(), "left_semi", "doc", "text").distinct()
    held = with_shingles(again, widths).select("doc", "v", F.explode_outer("s").alias("shingle"))
    exact = of_width(with_shingles).select("item", "version", F.size("s").alias("n"), F.explode("s").alias("shingle"))
    shared = held.join(small(cut(exact, "item-shingles")), "shingle").groupBy("doc", "v", "item", "version", "n").agg(F.count("*").alias("n_shared"))
    keys = [shared[x].eqNullSafe(pairs[x]) for x in ("doc", "v", "item", "version")]
    return shared.join(pairs, keys, "left_semi").filter(F.col("n_shared") >= F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = 5, share: float = 0.8) -> DataFrame:
    """(doc id, item id, n_shingles, n_shared, containment) of the pairs at ``share`` or more."""
    kept = contained(docs, items, id_col, text_col, item_id_col, item_text_col, width, share)
    best = kept.groupBy("doc", "item").agg(F.max(F.struct(F.col("n_shared") / F.col("n"), "n_shared", "n")).alias("x"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_id_col), F.col("x.n").cast("long").alias("n_shingles"), F.col("x.n_shared").cast("long").alias("n_shared"), (F.col("x.n_shared") / F.col("x.n")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those that hold one of ``items``, found by id and text."""
    bad = cut(contained(docs, items, id_col, text_col, **options).select("doc", "v").distinct(), "contaminated")
    return by_row(docs, bad, "left_anti", id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round("containment", 6))


ORACLE_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
k AS (SELECT DISTINCT least(5, len(w)) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + k.k - 1], ' ') FOR i IN range(1, len(w) - k.k + 2)]) AS s FROM d, k),
bs AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i + least(5, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(5, len(w)) + 2)]) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
x AS (SELECT doc_id, item_id, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(k AS BIGINT) AS n_shared, round(k / n, 6) AS containment
FROM x JOIN n USING (item_id) WHERE k >= ceil(0.8 * n - 1e-9)
"""
