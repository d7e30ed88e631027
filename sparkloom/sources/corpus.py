"""Sources and sinks: source trees, graph stores, tool logs, transcripts, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as X

LOG_SCHEMA = "timestamp string, tool string, turn int, payload struct<mode:string,file:string,full_file_chars:long,response_chars:long,response_tokens_est:long,tokens_avoided:long,tokens_would_have_cost:long>, _bad string"
USAGE_SCHEMA = "type string, sessionId string, project string, timestamp string, usage struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>"


def read_tree(spark: SparkSession, root: str, changed_since: str | None = None, skip: list[str] | None = None) -> DataFrame:
    """(path, ext, size, content, file_hash) of the files below ``root`` that are scanned.

    Directory listing, the size filter and ``changed_since`` (a modification time) work before
    any file is opened. Bytes that are no UTF-8 are left out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if changed_since:
        reader = reader.option("modifiedAfter", changed_since)
    raw = reader.load(root).filter(F.col("length") <= X.MAX_FILE_BYTES)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + root.replace("file:", "").rstrip("/").replace(".", r"\.") + "/", "")
    rows = raw.withColumn("path", path).filter(X.scannable("path", skip))
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return rows.select("path", T.suffix("path").alias("ext"), F.col("length").alias("size"), text.alias("content"), F.md5("content").alias("file_hash"))


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    return read_tree(spark, root).filter("ext = '.md'")


def write_graph(nodes: dict[str, DataFrame], folder: str, max_content: int | None = X.MAX_CONTENT_CHARS) -> None:
    """One Parquet table each: files, symbols, edges. Symbols and edges come from whole texts; only the text
    that is stored is cut to ``max_content`` characters."""
    for name, df in nodes.items():
        if name == "files" and max_content:
            df = df.withColumn("content", F.left("content", F.lit(max_content)))
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("files", "symbols", "edges")}


def read_graph_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A graph document with ``nodes`` and ``edges`` lists; both must be there."""
    doc = spark.read.option("multiLine", True).json(path)
    missing = {"nodes", "edges"} - set(doc.columns)
    if missing:
        raise ValueError(f"graph document lacks {sorted(missing)}")
    return {name: doc.select(F.explode(name).alias("x")).select("x.*") for name in ("nodes", "edges")}


def symbol_index(symbols: DataFrame) -> DataFrame:
    return symbols.select("id", "path", "line_start", "line_end", "body_hash")


def read_tool_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows; blank and malformed lines are left out."""
    rows = spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    # the marker column decides, so it is materialised together with the rest
    return rows.filter(F.col("_bad").isNull() & F.col("tool").isNotNull()).drop("_bad")


def log_after(spark: SparkSession, path: str, line: int) -> DataFrame:
    """Rows of one JSON-lines file after its first ``line`` lines, with ``line_no``: reading goes on where it
    stopped. Lines are numbered within their blocks, the blocks' counts make the offsets."""
    text = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_at"))
    block = F.shiftright("_at", 33)
    sizes = text.groupBy(block.alias("_b")).count()
    earlier = sizes.alias("x").join(sizes.alias("y"), F.col("y._b") < F.col("x._b"), "left").groupBy("x._b").agg(F.coalesce(F.sum("y.count"), F.lit(0)).alias("_before"))
    rows = text.withColumn("_b", block).join(F.broadcast(earlier), "_b").select("value", (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("line_no"))
    return rows.filter(F.col("line_no") > line)


def last_usage(rows: DataFrame) -> DataFrame:
    """(sessionId, usage): the last usage record of each session by its line number."""
    return rows.filter("usage IS NOT NULL").groupBy("sessionId").agg(F.max_by("usage", "line_no").alias("usage"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USAGE_SCHEMA).json(path)


def transcript_usage(rows: DataFrame) -> DataFrame:
    """One row a session: sums over its assistant messages."""
    kept = rows.filter("type = 'assistant' AND usage IS NOT NULL")
    total = lambda c: F.coalesce(F.sum(f"usage.{c}"), F.lit(0))
    return kept.groupBy("sessionId").agg(total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total("cache_read_input_tokens").alias("cache_read_tokens"), total("cache_creation_input_tokens").alias("cache_write_tokens"))


def last_session(rows: DataFrame, project: str) -> DataFrame:
    """The session that a project used last; the project's letter case doesn't count."""
    return rows.filter(F.lower("project") == project.lower()).agg(F.max_by("sessionId", "timestamp").alias("sessionId"))


def export_csv(rows: DataFrame, folder: str) -> None:
    """With a header; values that need it are quoted."""
    rows.write.mode("overwrite").option("header", True).csv(folder)


def write_rows(rows: DataFrame, folder: str) -> None:
    """A table as JSON lines, nulls kept, in place of what was there; ``read_rows`` gives the same rows."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def read_rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Rows of ``write_rows``; lines that are no JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def write_report(tables: dict[str, DataFrame], folder: str, shown: int = 20) -> None:
    """Every table as JSON lines in a folder of its name, and ``report``: a Markdown text with each table's
    number of rows and its first ones by all columns. The driver sees ``shown`` rows a table."""
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for name, rows in tables.items():
        write_rows(rows, f"{folder}/{name}")
        kept = read_rows(spark, f"{folder}/{name}", rows.schema)
        text = kept.select([F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")).alias(c) for c in rows.columns])
        first = text.orderBy(*rows.columns).limit(shown).collect()
        body = ["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns), *("| " + " | ".join(" ".join(x.split()) for x in r) + " |" for r in first)]
        parts.append("\n".join([f"## {name}", "", f"{kept.count()} rows", "", *(body if first else [])]))
    spark.createDataFrame([("\n\n".join(parts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report")


def live_or_stored(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored files with the content on disk, or the stored one where the file is gone."""
    l = live.select("path", F.col("content").alias("_live"))
    return stored.join(l, "path", "left").withColumn("content", F.coalesce("_live", "content")).drop("_live")


def build(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """files, symbols and edges of a source tree; lazily planned, one scan each."""
    files = read_tree(spark, root)
    return {"files": files.withColumn("summary", X.summary("path", "content")).withColumn("keywords", X.keywords(T.stem("path"), "content")), "symbols": X.symbols(files), "edges": X.edges(files)}
