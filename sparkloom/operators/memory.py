"""Memories: identity, merging, pruning, staleness and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of memory kinds, and how many of a kind a bucket keeps.
KIND_WEIGHTS = {"decision": 1.5, "fact": 1.3, "blocker": 1.3, "next": 1.1, "edit_observation": 1.1, "interaction_pattern": 1.0, "query_association": 0.8, "stale_marker": 0.5}
KIND_CAPS = {"query_association": 4, "edit_observation": 2, "interaction_pattern": 1, "stale_marker": 1, "decision": 3}
OTHER_CAP, TOTAL_CAP = 6, 200
AUTOMATIC, AUTOMATIC_DAYS = ["query_association", "interaction_pattern"], 14


def _lookup(table: dict, key: Column, otherwise) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(otherwise))


def identity() -> Column:
    """What makes two memories the same: kind, place, and the content for most kinds."""
    last = F.when(F.col("kind").isin("interaction_pattern", "edit_observation"), F.lit("")).when(F.col("kind") == "stale_marker", F.coalesce("stale_reason", F.lit(""))).otherwise(F.coalesce("content", F.lit("")))
    return F.struct(F.col("kind"), F.coalesce("symbol_id", F.lit("")).alias("symbol_id"), F.coalesce("file_path", F.lit("")).alias("file_path"), last.alias("rest"))


def upsert(entries: DataFrame) -> DataFrame:
    """One row an identity: merged in order of ``seq``. Lists are joined without repeats (tags at
    most ten, queries six), stale if any is, the largest counts, the last non-empty reason."""
    said = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    ordered = lambda c, n: F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]))), 1, n)
    return entries.groupBy(identity().alias("key")).agg(
        F.min("seq").alias("seq"), F.min_by("content", "seq").alias("content"), ordered("tags", 10).alias("tags"), ordered("queries", 6).alias("queries"),
        F.bool_or("stale").alias("stale"), F.coalesce(F.max_by(said("stale_reason"), F.when(said("stale_reason").isNotNull(), F.col("seq"))), F.lit("")).alias("stale_reason"), F.max("read_count").alias("read_count"), F.max("created_epoch").alias("updated_epoch"),
    ).select("seq", "key.kind", "key.symbol_id", "key.file_path", "content", "tags", "queries", "stale", "stale_reason", "read_count", "updated_epoch")


def prune(entries: DataFrame, now_epoch: int, total: int = TOTAL_CAP) -> DataFrame:
    """The newest entries of each (kind, symbol, file) up to its kind's cap, then the newest of all;
    automatic ones only of the last two weeks."""
    young = ~F.col("kind").isin(AUTOMATIC) | (now_epoch - F.coalesce("created_epoch", F.lit(0)) <= AUTOMATIC_DAYS * 86400)
    newest = [F.desc(F.coalesce("created_epoch", F.lit(0))), F.asc("seq")]
    ranked = entries.filter(young).withColumn("_n", F.row_number().over(Window.partitionBy("kind", "symbol_id", "file_path").orderBy(*newest)))
    return ranked.filter(F.col("_n") <= _lookup(KIND_CAPS, F.col("kind"), OTHER_CAP)).drop("_n").orderBy(*newest).limit(total)


def reconcile(entries: DataFrame, symbols: DataFrame) -> DataFrame:
    """Entries against the symbols (id, path, body_hash) of now: a symbol that is gone or whose body
    changed makes its memories stale; missing paths and hashes are filled in."""
    s = symbols.select(F.col("id").alias("_id"), F.col("path").alias("_path"), F.col("body_hash").alias("_hash"))
    rows = entries.join(s, entries.symbol_id == s._id, "left")
    about = F.coalesce(F.col("symbol_id"), F.lit("")) != ""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    gone = about & F.col("_id").isNull()
    changed = about & F.col("_id").isNotNull() & ~empty("symbol_hash") & ~empty("_hash") & (F.col("symbol_hash") != F.col("_hash"))
    # missing values are filled before the stale flag is set: both look at the old hash
    return rows.withColumns({
        "new_stale": F.when(gone | changed, True).otherwise(F.col("stale")),
        "new_reason": F.when(gone, "symbol removed").when(changed, "symbol body changed").otherwise(F.col("stale_reason")),
        "new_hash": F.when(about & empty("symbol_hash") & F.col("_id").isNotNull(), F.col("_hash")).otherwise(F.col("symbol_hash")),
        "new_path": F.when(about & empty("file_path") & F.col("_id").isNotNull(), F.col("_path")).otherwise(F.col("file_path")),
        "marked": (gone | changed) & (~F.coalesce("stale", F.lit(False)) | ~F.col("stale_reason").eqNullSafe(F.when(gone, "symbol removed").otherwise("symbol body changed"))),
    }).drop("_id", "_path", "_hash")


def stale_markers(reconciled: DataFrame) -> DataFrame:
    """The marker memories that newly stale ones leave."""
    return reconciled.filter("marked").select(F.lit("stale_marker").alias("kind"), F.concat(F.lit("Marked stale because "), "new_reason").alias("content"), "symbol_id", "file_path", F.col("new_reason").alias("stale_reason"), F.lit(True).alias("stale"))


def score(entries: DataFrame, terms: list[str], related: list[str], now_epoch: int, session_epoch: int = 0) -> DataFrame:
    """Entries with ``score``: term hits, place, age (half-life a week), staleness and kind."""
    blob = F.lower(F.concat_ws(" ", F.coalesce("content", F.lit("")), F.array_join("tags", " "), F.coalesce("symbol_id", F.lit("")), F.coalesce("file_path", F.lit(""))))
    hits = sum((F.when(blob.contains(t), 3).otherwise(0) for t in terms), F.lit(0))
    near = F.when(F.col("symbol_id").isin(related) & (F.col("symbol_id") != ""), 5).when(F.col("file_path").isin(related) & (F.col("file_path") != ""), 4).otherwise(0)
    age = F.greatest(F.lit(0.0), (now_epoch - F.col("created_epoch")) / 86400.0)
    fresh = 4.0 * F.pow(F.lit(0.5), age / 7.0)
    recency = F.when((F.col("created_epoch") > 0) & (fresh > 0.1), F.bround(fresh)).otherwise(0.0)
    state = F.when(F.coalesce("stale", F.lit(False)), -6).otherwise(1)
    other = F.when((F.col("kind") == "query_association") & (F.coalesce("session_epoch", F.lit(0)) > 0) & (F.coalesce("session_epoch", F.lit(0)) != session_epoch), -2).otherwise(0)
    weight = _lookup(KIND_WEIGHTS, F.col("kind"), 1.0)
    base = hits + near + recency + state + other
    return entries.withColumn("score", F.when(weight != 1.0, F.bround(base * weight)).otherwise(base).cast("int"))


def best(scored: DataFrame, limit: int) -> DataFrame:
    """Highest score first; fresh before stale, then the newest."""
    return scored.orderBy(F.desc("score"), F.coalesce("stale", F.lit(False)), F.desc(F.coalesce("created_epoch", F.lit(0))), "seq").limit(limit)


def cache_valid(cache: DataFrame, files: DataFrame, now_epoch: int, ttl: int = 900) -> DataFrame:
    """Cache entries (key, created_epoch, files array<struct<path,mtime>>) that are young enough and
    none of whose files (path, mtime) changed."""
    used = cache.select("key", F.explode_outer("files").alias("f")).select("key", "f.path", "f.mtime")
    broken = used.filter("path IS NOT NULL").join(files.select("path", F.col("mtime").alias("now_mtime")), "path", "left").filter(~F.col("mtime").eqNullSafe(F.col("now_mtime"))).select("key").distinct()
    return cache.filter(now_epoch - F.col("created_epoch") <= ttl).join(broken, "key", "left_anti")
