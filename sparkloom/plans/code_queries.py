"""Queries of the extractors and detectors: small sources, diffs and traces made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import extract as X
from ..operators import policy as P
from . import bindings as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Added lines of six kinds of diffs: one for each detector, and near misses.
DIFFS = [
    ("py", ["+    for x in xs:", "+        Order.objects.get(id=x)"]), ("py", ["+ return rows or items", "+ pass"]), ("tsx", ["+ window.open(url)", "+ x"]),
    ("tsx", ["+ <div onClick={f}>", "+ x"]), ("rs", ["+ let y = v[i];", "+ x"]), ("py", ["+ return a or b", "- password = 'abcdefgh1'"]),
]


def diffs(spark, d):
    kinds = F.array(*[F.array(F.lit(ext), *map(F.lit, lines)) for ext, lines in DIFFS])
    k = F.element_at(kinds, (F.col("p_partkey") % len(DIFFS) + 1).cast("int"))
    name = F.concat(F.lit("f"), "p_partkey", F.lit("."), F.element_at(k, 1))
    lines = F.concat(F.array(F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name)), F.slice(k, 2, 2))
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("diff_id"), F.posexplode(lines).alias("seq", "text"))


@query("""SELECT p_partkey AS diff_id, 'f' || p_partkey || '.' || ['py', 'py', 'tsx', 'tsx', 'rs'][p_partkey % 6 + 1] AS file, 1 AS seq, ['HIGH', 'CRITICAL', 'HIGH', 'MEDIUM', 'HIGH'][p_partkey % 6 + 1] AS severity,
['n-plus-one', 'falsy-trap', 'dom-security', 'a11y', 'rust-bounds'][p_partkey % 6 + 1] AS tag FROM part WHERE p_partkey % 6 < 5""")
def diff_detectors(spark, d):
    return D.all_findings(diffs(spark, d)).select("diff_id", "file", "seq", "severity", "tag")


@query("SELECT 'f' || p_partkey || '.' || ['py', 'py', 'tsx', 'tsx', 'rs', 'py'][p_partkey % 6 + 1] AS file, CAST(CASE WHEN p_partkey % 6 = 5 THEN 1 ELSE 2 END AS BIGINT) AS added, CAST(CASE WHEN p_partkey % 6 = 5 THEN 1 ELSE 0 END AS BIGINT) AS removed FROM part")
def diff_files(spark, d):
    p = D.parse(diffs(spark, d), tail=120)
    return p.groupBy("file").agg(F.count_if(F.col("sign") == "+").alias("added"), F.count_if(F.col("sign") == "-").alias("removed"))


def sources(spark, d):
    p = F.col("p_partkey")
    text = F.concat(F.lit("import os\nfrom lib.m"), p % 7, F.lit(" import thing\n\ndef load_"), p, F.lit("(a):\n    return a\n\nclass Model"), p, F.lit(":\n    pass\n"))
    return B.table(spark, d, "part").select(F.concat(F.lit("src/p"), p, F.lit(".py")).alias("path"), text.alias("content"))


@query("""SELECT 'src/p' || p_partkey || '.py::load_' || p_partkey AS id, 'utility' AS symbol_type, 4 AS line_start, 6 AS line_end, left(md5('def load_' || p_partkey || '(a):' || chr(10) || '    return a' || chr(10)), 8) AS body_hash FROM part
UNION ALL SELECT 'src/p' || p_partkey || '.py::Model' || p_partkey, 'use_case', 7, 8, left(md5('class Model' || p_partkey || ':' || chr(10) || '    pass'), 8) FROM part""")
def extract_symbols(spark, d):
    return X.symbols(sources(spark, d)).select("id", "symbol_type", "line_start", "line_end", "body_hash")


@query("SELECT 'src/p' || p_partkey || '.py' AS src, unnest(['os', 'lib.m' || (p_partkey % 7)]) AS dst, 'imports' AS rel FROM part")
def extract_imports(spark, d):
    return X.imports(sources(spark, d))


@query("SELECT p_partkey AS trace_id, 'python' AS language, 'src/p' || p_partkey || '.py' AS path, p_size AS line, 'load' AS function FROM part")
def stack_frames(spark, d):
    text = F.concat(F.lit('Traceback\n  File "src/p'), "p_partkey", F.lit('.py", line '), "p_size", F.lit(", in load\nError: x.py:3"))
    return X.frames(B.table(spark, d, "part").select(F.col("p_partkey").alias("trace_id"), text.alias("text"))).select("trace_id", "language", "path", "line", "function")


@query("""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'allowlist_blocked' WHEN event_id % 11 = 0 THEN 'reuse_gate_blocked' WHEN event_type = 'error' THEN 'cross_turn_pointer' WHEN event_id % 5 = 0 THEN 'budget_exhausted' WHEN value > 60 THEN 'dedupe_preview' WHEN event_type = 'view' THEN 'symbol_excerpt' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'anchor_fallback_head' WHEN event_type = 'click' THEN 'anchor_excerpt' WHEN value * 4 <= 60 THEN 'full' WHEN event_type = 'signup' THEN 'query_excerpt' ELSE 'head' END AS mode FROM events""")
def read_modes(spark, d):
    t = F.col("event_type")
    mode = P.read_mode(F.lit(60.0), F.when(F.col("event_id") % 5 == 0, 60_000).otherwise(0), F.when(F.col("value") > 60, F.col("value")).otherwise(-1.0), F.col("event_id") % 13 != 0, t == "error", t == "view", t == "click", t == "signup", gated=F.col("event_id") % 11 == 0, anchor_found=F.col("event_id") % 3 != 0, size=F.col("value") * 4)
    return B.table(spark, d, "events").select("event_id", mode.alias("mode"))


@query("""WITH c AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w, n_chars FROM documents), o AS (SELECT doc_id, CAST(len(list_intersect(w, ['the', 'that', 'thing', 'license', 'token', 'ment', 'tion'])) AS INTEGER) AS overlap, n_chars FROM c)
SELECT doc_id AS file, overlap FROM o WHERE overlap >= 3 ORDER BY overlap DESC, n_chars DESC, doc_id LIMIT 3""")
def memory_first(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))
    cache = B.table(spark, d, "documents").select(F.col("doc_id").alias("file"), words.alias("cached_terms"), F.col("n_chars").alias("tokens"))
    return P.remembered(cache, F.array(*map(F.lit, ["the", "that", "thing", "license", "token", "ment", "tion"]))).select("file", "overlap")


@query("""WITH f AS (SELECT DISTINCT event_id, user_id, event_type, ts FROM events), s AS (SELECT *, CASE event_type WHEN 'signup' THEN 'active' WHEN 'purchase' THEN 'active' WHEN 'error' THEN 'past_due' WHEN 'click' THEN 'cancelled' END AS status FROM f)
SELECT user_id AS sub_id, arg_max(status, ts) AS status FROM s WHERE status IS NOT NULL GROUP BY user_id""")
def subscription_state(spark, d):
    from ..streaming import sessions as K

    e = B.table(spark, d, "events")
    names = B.mapped(F.col("event_type"), {"signup": "created", "purchase": "payment_success", "error": "payment_failed", "click": "cancelled", "view": "looked"})
    twice = e.unionByName(e.filter("event_id % 10 = 0"))  # some deliveries come twice
    rows = twice.select("event_id", F.col("user_id").alias("sub_id"), names.alias("event"), "ts", F.col("ts").alias("renews_at"))
    return K.subscription_state(rows).select("sub_id", "status")


@query("SELECT page_id AS key FROM pages WHERE page_id % 2 = 0 AND page_id % 5 <> 0")
def cache_validity(spark, d):
    from ..operators import memory as M

    p = B.table(spark, d, "pages").select(F.col("page_id").alias("key"))
    cache = p.select("key", F.when(F.col("key") % 2 == 0, 1000).otherwise(10).cast("long").alias("created_epoch"), F.array(F.struct(F.concat(F.lit("f"), "key").alias("path"), F.lit(1).cast("long").alias("mtime"))).alias("files"))
    files = p.select(F.concat(F.lit("f"), "key").alias("path"), F.when(F.col("key") % 5 == 0, 2).otherwise(1).cast("long").alias("mtime"))
    return M.cache_valid(cache, files, 1500).select("key")


@query("SELECT 'u' || (p_partkey + 1) AS file, CAST(1 AS BIGINT) AS uses FROM part WHERE p_partkey % 2 = 0")
def missing_from_diff(spark, d):
    p = B.table(spark, d, "part")
    # every even part's file has a user outside of the diff, every odd one's is used by a file in it
    target = F.concat(F.lit("f"), "p_partkey", F.lit("."), F.element_at(F.array(*[F.lit(e) for e, _ in DIFFS]), (F.col("p_partkey") % len(DIFFS) + 1).cast("int")))
    edges = p.select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("u"), F.col("p_partkey") + 1)).otherwise(target).alias("src"), target.alias("dst"))
    return D.missing_from_diff(D.parse(diffs(spark, d)), edges)


@query("""WITH r AS (SELECT lang AS review_id, doc_id % 3 AS priority, source || '/' || doc_id AS path, least(n_chars, 6000) AS want, coalesce(sum(least(n_chars, 6000)) OVER (PARTITION BY lang ORDER BY doc_id % 3, source || '/' || doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT review_id, path, CAST(least(want, 30000 - before) AS BIGINT) AS taken FROM r WHERE least(want, 30000 - before) > 0""")
def review_context(spark, d):
    docs = B.table(spark, d, "documents")
    files = docs.select(F.col("lang").alias("review_id"), (F.col("doc_id") % 3).alias("priority"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"))
    return D.review_context(files).select("review_id", "path", F.col("taken").cast("long").alias("taken"))
