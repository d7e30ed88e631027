"""Change history of a corpus: commits as a table (path, author, ts), and refreshes of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract as X


def recently_changed(commits: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Paths changed in the last ``days`` days."""
    since = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    return commits.filter(F.col("ts") >= since).select("path").distinct()


def last_author(commits: DataFrame) -> DataFrame:
    return commits.groupBy("path").agg(F.max_by("author", "ts").alias("author"), F.max("ts").alias("ts"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files (path, file_hash) that are new or whose content changed."""
    return new.join(old.select("path", "file_hash"), ["path", "file_hash"], "left_anti")


def refresh(store: dict[str, DataFrame], changed: DataFrame, removed: DataFrame | None = None) -> dict[str, DataFrame]:
    """A store with the rows of changed (files) and removed (path) files replaced: everything that
    came from these files goes, and what they hold now comes in."""
    gone = changed.select("path") if removed is None else changed.select("path").unionByName(removed.select("path"))
    gone = gone.distinct()
    sources = gone.withColumnRenamed("path", "src")
    return {
        "files": store["files"].join(gone, "path", "left_anti").unionByName(changed, allowMissingColumns=True),
        "symbols": store["symbols"].join(gone, "path", "left_anti").unionByName(X.symbols(changed)),
        "edges": store["edges"].join(sources, "src", "left_anti").unionByName(X.edges(changed)),
    }


def list_keys(entries: DataFrame, prefix: str, limit: int = 1000) -> DataFrame:
    """Entries (key, ...) below a prefix, in order."""
    return entries.filter(F.col("key").startswith(prefix)).orderBy("key").limit(limit)
