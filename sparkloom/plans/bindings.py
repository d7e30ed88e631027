"""How the engine's logical tables are laid over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: The moment at which ages are taken: results never depend on the clock.
NOW = "2024-01-31 00:00:00"
KINDS = {"purchase": "register_edit", "click": "read", "view": "retrieve", "error": "fallback_rg", "signup": "read_cache_hit"}
MODELS = {"1-URGENT": "opus-4-8", "2-HIGH": "opus", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "haiku", "5-LOW": "fable"}
EXTENSIONS = {"en": ".py", "de": ".go", "fr": ".ts", "es": ".md"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(column, values: dict) -> F.Column:
    out = None
    for k, v in values.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts, kind, file, session, value) from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), "ts", mapped(F.col("event_type"), KINDS).alias("kind"), F.concat(F.lit("src/file"), F.pmod("user_id", F.lit(40)).cast("string"), F.lit(".py")).alias("file"), F.col("user_id").alias("session"), "value")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path, ext, size, content) from documents: source and language are directories."""
    d = table(spark, sf_dir, "documents")
    ext = mapped(F.col("lang"), EXTENSIONS)
    return d.select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), ext).alias("path"), ext.alias("ext"), F.col("n_chars").alias("size"), F.col("text").alias("content"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, line_no from 1, text)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("file_id"), F.posexplode(T.text_lines("text")).alias("p", "text")).select("file_id", (F.col("p") + 1).alias("line_no"), "text")


BLOCK_LINES = 4


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path, name, line_start, line_end, body_hash, body): blocks of four lines of documents,
    lines from 1. Built per row, without a shuffle."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), T.text_lines("text").alias("lines")).filter(F.size("lines") > 0)
    n = F.ceil(F.size("lines") / BLOCK_LINES).cast("int")
    blocks = d.select("file_id", F.size("lines").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice("lines", i * BLOCK_LINES + 1, F.lit(BLOCK_LINES)), "\n"))).alias("b", "body"))
    return blocks.select(F.concat(F.lit("d"), "file_id", F.lit("::b"), "b").alias("id"), "file_id", F.col("b").alias("block"), (F.col("b") * BLOCK_LINES + 1).alias("line_start"), F.least((F.col("b") + 1) * BLOCK_LINES, F.col("n")).alias("line_end"), T.body_hash("body").alias("body_hash"), "body")


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usage event an order, its token counts from the order's lines."""
    l = table(spark, sf_dir, "lineitem")
    sums = l.groupBy("l_orderkey").agg(
        (F.sum("l_quantity") * 10).cast("long").alias("input_tokens"),
        (F.count("*") * 50).alias("output_tokens"),
        F.sum(F.col("l_partkey") % 1000).alias("cache_read_tokens"),
        F.sum(F.col("l_suppkey") % 100).alias("cache_write_tokens"),
        F.sum(F.col("l_linenumber") * 100).cast("long").alias("avoided_tar"),
        F.sum(F.when(F.col("l_returnflag") == "R", 200).otherwise(0)).cast("long").alias("avoided_cross_turn"),
        F.sum(F.when(F.col("l_linestatus") == "O", 150).otherwise(-20)).cast("long").alias("avoided_shadow"),
        (F.sum("l_quantity") * 5).cast("long").alias("tokens_served"),
    )
    o = table(spark, sf_dir, "orders")
    return o.join(sums, o.o_orderkey == sums.l_orderkey).select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("KEY-"), F.col("o_custkey")).alias("license_key"), F.concat(F.lit("s"), F.col("o_orderkey") % 97).alias("session_id"), F.col("o_orderdate").alias("timestamp"),
        mapped(F.col("o_orderpriority"), MODELS).alias("model"), F.concat(F.lit("host"), F.col("o_custkey") % 7).alias("device_host"),
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "avoided_tar", "avoided_cross_turn", "avoided_shadow", "tokens_served", (F.col("avoided_tar") + F.col("avoided_cross_turn") + F.col("avoided_shadow")).alias("tokens_avoided"),
    )


#: The same binding for the SQL side.
USAGE_SQL = """u AS (
  SELECT o_orderkey AS id, 'KEY-' || o_custkey AS license_key, 's' || (o_orderkey % 97) AS session_id, o_orderdate AS "timestamp",
    CASE o_orderpriority WHEN '1-URGENT' THEN 'opus-4-8' WHEN '2-HIGH' THEN 'opus' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'haiku' WHEN '5-LOW' THEN 'fable' END AS model,
    'host' || (o_custkey % 7) AS device_host, i.*, avoided_tar + avoided_cross_turn + avoided_shadow AS tokens_avoided
  FROM orders JOIN (SELECT l_orderkey, CAST(sum(l_quantity) * 10 AS BIGINT) AS input_tokens, count(*) * 50 AS output_tokens, CAST(sum(l_partkey % 1000) AS BIGINT) AS cache_read_tokens,
    CAST(sum(l_suppkey % 100) AS BIGINT) AS cache_write_tokens, CAST(sum(l_linenumber * 100) AS BIGINT) AS avoided_tar, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 200 ELSE 0 END) AS BIGINT) AS avoided_cross_turn,
    CAST(sum(CASE WHEN l_linestatus = 'O' THEN 150 ELSE -20 END) AS BIGINT) AS avoided_shadow, CAST(sum(l_quantity) * 5 AS BIGINT) AS tokens_served FROM lineitem GROUP BY l_orderkey) i ON o_orderkey = l_orderkey)"""
ACTIONS_SQL = """a AS (SELECT event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'register_edit' WHEN 'click' THEN 'read' WHEN 'view' THEN 'retrieve' WHEN 'error' THEN 'fallback_rg' WHEN 'signup' THEN 'read_cache_hit' END AS kind,
  'src/file' || (user_id % 40) || '.py' AS file, user_id AS session, value FROM events)"""
LINES_SQL = """doc_lines AS (SELECT doc_id, CASE WHEN len(x) > 0 AND x[len(x)] = '' THEN x[1:len(x) - 1] ELSE x END AS ls FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS x FROM documents)),
lines AS (SELECT doc_id AS file_id, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS line_no, unnest(ls) AS text FROM doc_lines)""".replace("\\\\", "\\")
SYMBOLS_SQL = LINES_SQL + """,
blocks AS (SELECT doc_id AS file_id, len(ls) AS n, CAST(unnest(range(0, CAST(ceil(len(ls) / 4.0) AS BIGINT))) AS INTEGER) AS block, ls FROM doc_lines WHERE len(ls) > 0),
symbols AS (SELECT 'd' || file_id || '::b' || block AS id, file_id, block, block * 4 + 1 AS line_start, CAST(least((block + 1) * 4, n) AS INTEGER) AS line_end, left(md5(array_to_string(ls[block * 4 + 1:block * 4 + 4], chr(10))), 8) AS body_hash, array_to_string(ls[block * 4 + 1:block * 4 + 4], chr(10)) AS body FROM blocks)"""


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, rel): pages and the paths they refer to."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"), F.lit("references").alias("rel"))


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): parts on consecutive lines of an order that are sold at one discount; directed, with cycles."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    following = F.lead(F.struct(F.col("l_partkey").alias("part"), F.col("l_discount").alias("discount"))).over(w)
    e = table(spark, sf_dir, "lineitem").withColumn("_next", following).filter("l_discount = _next.discount")
    return e.select(F.col("l_partkey").alias("src"), F.col("_next.part").alias("dst")).filter("src <> dst").distinct()


ORDER_EDGES_SQL = """e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER w AS dst, l_discount = lead(l_discount) OVER w AS alike FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) WHERE alike AND src <> dst)"""
