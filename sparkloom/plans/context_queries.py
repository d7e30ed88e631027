"""Queries of budgets, review context, file links, history and references to other trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import actions as W
from ..operators import audit as A
from ..operators import extract as X
from ..operators import graph as G
from ..operators import policy as P
from ..operators import usage as U
from ..sources import history as H
from . import bindings as B
from .action_queries import NOW

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH s AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS turns, CAST(sum(floor(o_totalprice)) AS BIGINT) AS chars FROM orders GROUP BY ALL),
t AS (SELECT *, CASE p WHEN '1-URGENT' THEN 'targeted' WHEN '2-HIGH' THEN 'behavioral' WHEN '3-MEDIUM' THEN 'exhaustive' ELSE 'other' END AS task FROM s),
l AS (SELECT *, CASE task WHEN 'behavioral' THEN [150000, 250000, 10, 16] WHEN 'exhaustive' THEN [300000, 500000, 15, 25] ELSE [120000, 200000, 8, 14] END AS m FROM t)
SELECT o_custkey, p, CASE WHEN chars >= m[2] THEN 'limit' WHEN chars >= m[1] THEN 'warning' ELSE 'none' END AS cost, CASE WHEN turns >= m[4] THEN 'limit' WHEN turns >= m[3] THEN 'warning' ELSE 'none' END AS turns FROM l""")
def spent_budgets(spark, d):
    s = B.table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"), F.sum(F.floor("o_totalprice")).alias("chars"))
    task = F.coalesce(B.mapped(F.col("p"), {"1-URGENT": "targeted", "2-HIGH": "behavioral", "3-MEDIUM": "exhaustive"}), F.lit("other"))
    return s.select("o_custkey", "p", P.spent(F.col("chars"), F.col("n"), task).alias("x")).select("o_custkey", "p", "x.cost", "x.turns")


LINKED_SQL = "nodes AS (SELECT 'p' || p_partkey AS id, 'size' || p_size AS path FROM part), e AS (SELECT DISTINCT 'p' || src AS src, 'p' || dst AS dst FROM e0)"


@query(f"WITH {B.ORDER_EDGES_SQL.replace('e AS', 'e0 AS', 1)}, {LINKED_SQL}, k AS (SELECT DISTINCT a.path AS file, b.path AS other FROM e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.path <> b.path) SELECT file, 'to' AS way, other FROM k UNION ALL SELECT other, 'from', file FROM k")
def file_adjacency(spark, d):
    nodes = B.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("size"), "p_size").alias("path"))
    e = B.order_edges(spark, d).select(F.concat(F.lit("p"), "src").alias("src"), F.concat(F.lit("p"), "dst").alias("dst"), F.lit("calls").alias("rel"))
    return G.file_adjacency(e, nodes, ["imports", "calls", "uses"])


@query("""SELECT p_partkey AS trace_id, 'src/p' || p_partkey || '.py::load' AS symbol, CAST(CASE WHEN p_size % 2 = 0 THEN 7 ELSE p_size END AS INTEGER) AS line FROM part WHERE p_size > 10""")
def frame_symbols(spark, d):
    parts = B.table(spark, d, "part")
    text = F.concat(F.lit('Traceback\n  File "src/run.py", line 1, in <module>\n  File "src/p'), "p_partkey", F.lit('.py", line '), "p_size", F.lit(", in load"))
    found = X.frames(parts.select(F.col("p_partkey").alias("trace_id"), text.alias("text")))
    symbols = parts.filter("p_size > 10").select(F.concat(F.lit("src/p"), "p_partkey", F.lit(".py::load")).alias("id"), F.when(F.col("p_size") % 2 == 0, 7).alias("line_start"))
    return G.frame_symbols(found, symbols).select("trace_id", "symbol", F.col("line").cast("int").alias("line"))


@query("""WITH c AS (SELECT DISTINCT s_nationkey AS review, 's' || s_suppkey AS file FROM supplier), e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem),
n AS (SELECT review, dst AS other, count(*) AS links FROM e JOIN c ON src = file GROUP BY ALL), r AS (SELECT review, row_number() OVER (PARTITION BY review ORDER BY links DESC, other) AS rank, other AS file FROM n), a AS (SELECT * FROM r WHERE rank <= 8),
q AS (SELECT review, 0 AS own, rank, file FROM a UNION ALL SELECT review, 1, 0, file FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY review ORDER BY own, rank, file) AS k FROM q)
SELECT review, 'affected' AS part, CAST(rank AS INTEGER) AS rank, file FROM a UNION ALL SELECT review, 'read', CAST(k AS INTEGER), file FROM f WHERE k <= 5""")
def changed_context(spark, d):
    e = B.table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    return G.changed_context(e, B.table(spark, d, "supplier").select(F.col("s_nationkey").alias("review"), F.concat(F.lit("s"), "s_suppkey").alias("file")))


@query("SELECT o_orderpriority, count(*) AS n, max(o_orderdate) AS latest FROM orders WHERE o_orderdate >= date_trunc('month', TIMESTAMP '2001-07-20 12:00:00') AND o_orderdate <= TIMESTAMP '2001-07-20 12:00:00' GROUP BY o_orderpriority")
def month_to_date(spark, d):
    return B.table(spark, d, "orders").filter(U.month_to_date("o_orderdate", "2001-07-20 12:00:00")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))


COMMITS_SQL = "c AS (SELECT event_type || '/f' || (event_id % 500) AS path, user_id AS author, ts FROM events)"


def _commits(spark, d):
    return B.table(spark, d, "events").select(F.concat(F.col("event_type"), F.lit("/f"), F.col("event_id") % 500).alias("path"), F.col("user_id").alias("author"), "ts")


@query(f"WITH {COMMITS_SQL} SELECT DISTINCT path FROM c WHERE ts >= TIMESTAMP '{B.NOW}' - INTERVAL 7 DAY")
def recent_changes(spark, d):
    return H.recently_changed(_commits(spark, d), B.NOW, 7)


@query(f"WITH {COMMITS_SQL} SELECT path, arg_max(author, ts) AS author, max(ts) AS ts FROM c GROUP BY path")
def last_author(spark, d):
    return H.last_author(_commits(spark, d))


REFS_SQL = "r AS (SELECT 'u' || user_id || '/' || event_type AS ref, CAST(floor(epoch(ts)) AS BIGINT) AS created_epoch, event_id AS hits FROM events)"


@query(f"WITH {REFS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY created_epoch DESC, hits DESC) AS k FROM r) SELECT ref, created_epoch, hits FROM n WHERE k = 1 AND {NOW} - created_epoch <= 86400")
def registered_references(spark, d):
    refs = lambda kinds: B.table(spark, d, "events").filter(kinds).select(F.concat(F.lit("u"), "user_id", F.lit("/"), "event_type").alias("ref"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_epoch"), F.col("event_id").alias("hits"))
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    return W.registered(refs(~late), refs(late), NOW)


@query("""SELECT p_partkey AS id FROM part WHERE p_size % 4 IN (0, 1) AND NOT (p_size % 4 = 0 AND p_size > 25)""")
def unhandled_calls(spark, d):
    size = F.col("p_size")
    call = F.when(size % 4 == 0, "return fetch(url)").when(size % 4 == 1, "x = requests.get(url)").otherwise("return prefetch_of[url]")
    body = F.when((size % 4 == 0) & (size > 25), F.concat(F.lit("try { "), call, F.lit(" } catch (e) {}"))).otherwise(call)
    return A.unhandled(B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), body.alias("body"))).select("id")
