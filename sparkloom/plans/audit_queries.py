"""Queries of the audit, finding and memory operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import memory as M
from . import bindings as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {B.SYMBOLS_SQL} SELECT body_hash, count(*) AS copies, CAST(max(line_end - line_start) AS INTEGER) AS lines, min(id) AS first_id, array_to_string(list_sort(list(id))[1:5], ' ') AS ids FROM symbols WHERE line_end - line_start >= 3 GROUP BY body_hash HAVING count(*) >= 2")
def copy_paste_groups(spark, d):
    return A.copy_paste(B.symbols(spark, d), min_span=3).withColumn("ids", F.array_join("ids", " "))


@query(f"WITH {B.SYMBOLS_SQL} SELECT body_hash, count(*) AS copies, CAST(max(line_end - line_start) AS INTEGER) AS lines FROM symbols WHERE line_end - line_start >= 2 GROUP BY body_hash HAVING count(*) >= 2 ORDER BY copies * max(line_end - line_start) DESC, body_hash LIMIT 12")
def copy_paste_top(spark, d):
    return A.copy_paste(B.symbols(spark, d), min_span=2, top=12).select("body_hash", "copies", "lines")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size % 2 = 0 AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 47))")
def dead_exports(spark, d):
    p, l = B.table(spark, d, "part"), B.table(spark, d, "lineitem")
    names = p.join(l.filter("l_returnflag = 'R' AND l_quantity >= 47"), p.p_partkey == l.l_partkey, "left_semi").select(F.col("p_name").alias("name"))
    return A.dead_by_name(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") % 2 == 0).alias("exported")), names).select("id", "name")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'A' AND l_quantity >= 47)")
def dead_exports_by_edge(spark, d):
    l = B.table(spark, d, "lineitem")
    rel = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") != "A") & (F.col("l_quantity") >= 47), "imports").otherwise("contains")
    return A.dead_by_edge(B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(True).alias("exported")), l.select(F.lit("x").alias("src"), F.col("l_partkey").alias("dst"), rel.alias("rel"))).select("id")


def _files(spark, d):
    """Documents as modules m0, m1, ...; those of every third id as tests of the module before."""
    n = F.col("doc_id")
    path = F.when(n % 3 == 0, F.concat(F.lit("tests/test_m"), n + 1, F.lit(".py"))).otherwise(F.concat(F.lit("app/m"), n, F.lit(".py")))
    return B.table(spark, d, "documents").select(n.alias("id"), path.alias("path"), F.col("n_chars").alias("size"))


UNTESTED_SQL = "c AS (SELECT doc_id AS id, n_chars AS size, 'm' || doc_id AS stem FROM documents WHERE doc_id % 3 <> 0), t AS (SELECT 'm' || (doc_id + 1) AS stem FROM documents WHERE doc_id % 3 = 0)"


@query(f"WITH {UNTESTED_SQL} SELECT id, size FROM c ANTI JOIN t USING (stem)")
def untested_files(spark, d):
    return A.untested(_files(spark, d)).select("id", "size")


@query(f"WITH {UNTESTED_SQL}, o AS (SELECT count(*) AS n FROM c ANTI JOIN t USING (stem)), a AS (SELECT count(*) AS total FROM c) SELECT total, total - n AS covered, CAST(round((total - n) / total * 100) AS INTEGER) AS pct FROM a, o")
def test_coverage(spark, d):
    return A.coverage(_files(spark, d))


@query("""WITH g AS (SELECT source, CAST(count_if(doc_id % 3 <> 0) AS BIGINT) AS dead, count(DISTINCT lang) AS cycles, CAST(count_if(n_chars > 5000) AS BIGINT) AS copies, CAST(count_if(n_chars < 100) AS BIGINT) AS db, CAST(count_if(lang = 'en') AS BIGINT) AS todos, CAST(round(count_if(lang = 'en') / count(*) * 100) AS INTEGER) AS pct FROM documents GROUP BY source)
SELECT source, CAST(least(100, greatest(0, 60 - pct) + least(15, dead // 3) + least(10, cycles * 2) + least(10, copies * 2) + least(5, db) + least(5, todos // 4)) AS INTEGER) AS score FROM g""")
def debt_score(spark, d):
    g = B.table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("doc_id") % 3 != 0).alias("dead"), F.count_distinct("lang").alias("cycles"), F.count_if(F.col("n_chars") > 5000).alias("copies"), F.count_if(F.col("n_chars") < 100).alias("db"), F.count_if(F.col("lang") == "en").alias("todos"), F.round(F.count_if(F.col("lang") == "en") / F.count("*") * 100).cast("int").alias("pct"))
    return g.select("source", A.debt(F.col("pct"), F.col("dead"), F.col("cycles"), F.col("copies"), F.col("db"), F.col("todos")).alias("score"))


def _findings(spark, d):
    e = B.table(spark, d, "events")
    severity = F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "purchase", "HIGH").when(F.col("event_type") == "click", "MEDIUM").otherwise("LOW")
    return e.select(F.col("event_id").alias("seq"), "ts", severity.alias("severity"), F.concat(F.when(F.col("event_id") % 2 == 0, "Title ").otherwise("TITLE "), F.col("user_id")).alias("title"))


FINDINGS_SQL = "f AS (SELECT event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'click' THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN event_id % 2 = 0 THEN 'Title ' ELSE 'TITLE ' END || user_id AS title FROM events)"


@query(f"WITH {FINDINGS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, seq) AS n FROM f) SELECT seq, severity, title FROM r WHERE n = 1")
def dedupe_keep_first(spark, d):
    return A.dedupe_findings(_findings(spark, d)).select("seq", "severity", "title")


@query(f"WITH {FINDINGS_SQL} SELECT severity, count(*) AS n FROM f GROUP BY severity")
def severity_counts(spark, d):
    return _findings(spark, d).groupBy("severity").agg(F.count("*").alias("n"))


@query(f"WITH {FINDINGS_SQL}, a AS (SELECT DISTINCT title, severity FROM f WHERE ts < '2024-01-16'), b AS (SELECT DISTINCT title, severity FROM f WHERE ts >= '2024-01-16') SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def set_diff_findings(spark, d):
    f = _findings(spark, d)
    return A.only_in(f.filter("ts < '2024-01-16'"), f.filter("ts >= '2024-01-16'"), ["title", "severity"])


NOW = 1706659200  # the moment of bindings.NOW, in seconds
KINDS = ["decision", "query_association", "edit_observation", "interaction_pattern", "stale_marker", "fact"]


def memories(spark, d):
    e = B.table(spark, d, "events")
    n = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (n % 6 + 1).cast("int"))
    return e.select(
        n.alias("seq"), kind.alias("kind"), F.concat(F.lit("user "), F.col("user_id"), F.lit(" "), "event_type").alias("content"), F.array(F.col("event_type")).alias("tags"), F.array(F.concat(F.lit("q"), n % 9)).alias("queries"),
        F.concat(F.lit("f"), F.col("user_id") % 20, F.lit("::s"), n % 3).alias("symbol_id"), F.concat(F.lit("f"), F.col("user_id") % 20).alias("file_path"), F.lit("").alias("symbol_hash"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_epoch"), (n % 7 == 0).alias("stale"), F.when(n % 7 == 0, F.concat(F.lit("r"), n % 2)).otherwise("").alias("stale_reason"), (n % 5).alias("read_count"), (n % 4).alias("session_epoch"),
    )


MEMORY_SQL = """m AS (SELECT event_id AS seq, ['decision', 'query_association', 'edit_observation', 'interaction_pattern', 'stale_marker', 'fact'][event_id % 6 + 1] AS kind, 'user ' || user_id || ' ' || event_type AS content, event_type AS tag, 'q' || (event_id % 9) AS q,
  'f' || (user_id % 20) || '::s' || (event_id % 3) AS symbol_id, 'f' || (user_id % 20) AS file_path, CAST(floor(epoch(ts)) AS BIGINT) AS created_epoch, event_id % 7 = 0 AS stale, CASE WHEN event_id % 7 = 0 THEN 'r' || (event_id % 2) ELSE '' END AS stale_reason, event_id % 5 AS read_count, event_id % 4 AS session_epoch FROM events)"""


@query(f"""WITH {MEMORY_SQL}, s AS (SELECT *, (CASE WHEN contains(lower(content || ' ' || tag || ' ' || symbol_id || ' ' || file_path), 'click') THEN 3 ELSE 0 END) + (CASE WHEN contains(lower(content || ' ' || tag || ' ' || symbol_id || ' ' || file_path), 'user 7') THEN 3 ELSE 0 END)
+ CASE WHEN symbol_id = 'f3::s1' THEN 5 WHEN file_path IN ('f3', 'f4') THEN 4 ELSE 0 END + CASE WHEN 4.0 * pow(0.5, greatest(0, ({NOW} - created_epoch) / 86400.0) / 7.0) > 0.1 THEN round_even(4.0 * pow(0.5, greatest(0, ({NOW} - created_epoch) / 86400.0) / 7.0), 0) ELSE 0 END
+ CASE WHEN stale THEN -6 ELSE 1 END + CASE WHEN kind = 'query_association' AND session_epoch > 0 AND session_epoch <> 2 THEN -2 ELSE 0 END AS base, CASE kind WHEN 'decision' THEN 1.5 WHEN 'fact' THEN 1.3 WHEN 'edit_observation' THEN 1.1 WHEN 'query_association' THEN 0.8 WHEN 'stale_marker' THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM m),
r AS (SELECT seq, kind, CAST(CASE WHEN w <> 1.0 THEN round_even(base * w, 0) ELSE base END AS INTEGER) AS score, stale, created_epoch FROM s) SELECT seq, kind, score FROM r ORDER BY score DESC, stale, created_epoch DESC, seq LIMIT 100""")
def memory_score(spark, d):
    return M.best(M.score(memories(spark, d), ["click", "user 7"], ["f3::s1", "f3", "f4"], NOW, 2), 100).select("seq", "kind", "score")


@query(f"""WITH {MEMORY_SQL}, y AS (SELECT * FROM m WHERE kind NOT IN ('query_association', 'interaction_pattern') OR {NOW} - created_epoch <= 14 * 86400),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, symbol_id, file_path ORDER BY created_epoch DESC, seq) AS n FROM y) SELECT seq, kind, created_epoch FROM r WHERE n <= CASE kind WHEN 'query_association' THEN 4 WHEN 'edit_observation' THEN 2 WHEN 'interaction_pattern' THEN 1 WHEN 'stale_marker' THEN 1 WHEN 'decision' THEN 3 ELSE 6 END ORDER BY created_epoch DESC, seq LIMIT 200""")
def memory_prune(spark, d):
    return M.prune(memories(spark, d), NOW).select("seq", "kind", "created_epoch")


@query(f"""WITH {MEMORY_SQL}, k AS (SELECT *, CASE WHEN kind IN ('interaction_pattern', 'edit_observation') THEN '' WHEN kind = 'stale_marker' THEN stale_reason ELSE content END AS rest FROM m),
t AS (SELECT kind, symbol_id, file_path, rest, tag, min(seq) AS s FROM k GROUP BY ALL), q AS (SELECT kind, symbol_id, file_path, rest, q, min(seq) AS s FROM k GROUP BY ALL),
tt AS (SELECT kind, symbol_id, file_path, rest, array_to_string(list(tag ORDER BY s)[1:10], ' ') AS tags FROM t GROUP BY ALL), qq AS (SELECT kind, symbol_id, file_path, rest, array_to_string(list(q ORDER BY s)[1:6], ' ') AS queries FROM q GROUP BY ALL),
g AS (SELECT kind, symbol_id, file_path, rest, min(seq) AS seq, arg_min(content, seq) AS content, bool_or(stale) AS stale, coalesce(arg_max(CASE WHEN stale_reason <> '' THEN stale_reason END, CASE WHEN stale_reason <> '' THEN seq END), '') AS stale_reason, max(read_count) AS read_count FROM k GROUP BY ALL)
SELECT seq, kind, symbol_id, file_path, content, tags, queries, stale, stale_reason, read_count FROM g JOIN tt USING (kind, symbol_id, file_path, rest) JOIN qq USING (kind, symbol_id, file_path, rest)""")
def memory_upsert_merge(spark, d):
    m = M.upsert(memories(spark, d)).drop("updated_epoch")
    return m.withColumn("tags", F.array_join("tags", " ")).withColumn("queries", F.array_join("queries", " "))


@query("""SELECT event_id AS seq, CASE WHEN user_id % 20 >= 15 OR event_id % 3 = 2 THEN true ELSE event_id % 7 = 0 END AS new_stale, CASE WHEN user_id % 20 >= 15 THEN 'symbol removed' WHEN event_id % 3 = 2 THEN 'symbol body changed' WHEN event_id % 7 = 0 THEN 'r' || (event_id % 2) ELSE '' END AS new_reason FROM events""")
def stale_reconcile(spark, d):
    m = memories(spark, d).withColumn("symbol_hash", F.concat(F.lit("h"), F.col("seq") % 3))
    s = spark.range(15).select(F.col("id").alias("f")).crossJoin(spark.range(3).select(F.col("id").alias("s")))
    symbols = s.select(F.concat(F.lit("f"), "f", F.lit("::s"), "s").alias("id"), F.concat(F.lit("f"), "f").alias("path"), F.when(F.col("s") == 2, "new").otherwise(F.concat(F.lit("h"), "s")).alias("body_hash"))
    return M.reconcile(m, symbols).select("seq", "new_stale", "new_reason")
