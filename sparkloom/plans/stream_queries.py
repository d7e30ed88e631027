"""Streaming operators run to the end of what is there; the SQL is that of the same batch."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import sessions as K
from . import bindings as B
from .usage_queries import ORACLES as USAGE_SQL

QUERIES, ORACLES = {}, {}


def shared(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names, or a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return os.path.join(base, "sparkloom", f"{what}-{uuid.uuid4().hex}")


def source(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    return spark.readStream.schema(B.table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


def finished(stream: DataFrame, mode: str, write, folder: str) -> None:
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def stream_rate_limit(spark, d):
    folder = shared(spark, "rates")
    limited = K.rate_limited(source(spark, d, "events"), "user_id", 6 * 3600, 2)
    finished(limited, "complete", lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out"), folder)
    return spark.read.parquet(f"{folder}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_latest(spark, d):
    folder = shared(spark, "latest")
    rows = source(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    finished(rows, "append", K.upsert_sink(f"{folder}/out", ["user_id", "event_type"], "event_id"), folder)
    return K.read_upserted(spark, f"{folder}/out")


def stream_session_reads(spark, d):
    folder = shared(spark, "reads")
    reads = source(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("query"), F.concat(F.lit("f"), F.col("event_id") % 7).alias("file"), (F.abs("value") * 200).cast("long").alias("chars"))
    finished(K.session_reads(reads), "append", lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/n={n}"), folder)
    return spark.read.schema(K.OUT).parquet(f"{folder}/out").select("session", "seq", "file", "mode", "served", "used")


QUERIES |= {"stream_rate_limit": stream_rate_limit, "stream_latest": stream_latest, "stream_session_reads": stream_session_reads}
ORACLES["stream_rate_limit"] = USAGE_SQL["rate_limit_windows"]
ORACLES["stream_latest"] = "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1"
#: The session's state walks along its reads: sizes served in the turn, and files known from earlier turns with
#: those turns' one word each.
ORACLES["stream_session_reads"] = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type AS query, 'f' || (event_id % 7) AS file, least(CAST(trunc(abs(value) * 200) AS BIGINT), 20000) AS wanted FROM events),
w(session, n, seq, file, turn, mode, served, used, seen, known) AS (
  SELECT DISTINCT session, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', '', '', CAST(0 AS BIGINT), CAST(0 AS BIGINT), MAP([]::VARCHAR[], []::BIGINT[]), MAP([]::VARCHAR[], []::VARCHAR[]) FROM e
  UNION ALL
  SELECT session, n, seq, file, query, mode, served, used + served, CASE WHEN mode = 'full' THEN map_concat(seen, MAP([file], [greatest(coalesce(seen[file], 0), served)])) ELSE seen END, known FROM (
    SELECT *, CASE mode WHEN 'full' THEN least(wanted, 60000 - used) WHEN 'dedupe_preview' THEN least(wanted, 500, 60000 - used) ELSE 0 END AS served FROM (
      SELECT *, CASE WHEN coalesce(known[file] = query, false) THEN 'cross_turn_pointer' WHEN used >= 60000 THEN 'budget_exhausted' WHEN coalesce(seen[file], -1) >= wanted THEN 'dedupe_preview' ELSE 'full' END AS mode FROM (
        SELECT e.session, e.n, e.seq, e.file, e.query, e.wanted, CASE WHEN e.query = w.turn THEN w.used ELSE 0 END AS used, CASE WHEN e.query = w.turn THEN w.seen ELSE MAP([]::VARCHAR[], []::BIGINT[]) END AS seen,
          CASE WHEN e.query = w.turn THEN w.known ELSE map_concat(w.known, MAP(map_keys(w.seen), list_transform(map_keys(w.seen), lambda f: w.turn))) END AS known
        FROM w JOIN e ON e.session = w.session AND e.n = w.n + 1))))
SELECT session, seq, file, mode, served, used FROM w WHERE n > 0"""
