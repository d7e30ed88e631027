"""Queries of the write side, of history and of whole-text extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import actions as W
from ..operators import audit as A
from ..operators import extract as X
from ..operators import graph as G
from ..operators import search as S
from . import bindings as B

QUERIES, ORACLES = {}, {}
NOW = 1706659200  # the moment of bindings.NOW, in seconds


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def edits(spark, d):
    """Events as edits of one or two files, three of four put in words."""
    n = F.col("event_id")
    file = lambda k: F.concat(F.lit("src/file"), (F.col("user_id") + k) % 40, F.lit(".py"))
    summary = F.when(n % 4 == 0, "").otherwise(F.concat("event_type", F.lit(" by "), "user_id"))
    return B.table(spark, d, "events").select(n.alias("seq"), (F.col("user_id") % 10).alias("session"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"), F.col("ts"), F.when(n % 3 == 0, F.array(file(0), file(1))).otherwise(F.array(file(0))).alias("files"), summary.alias("summary"), F.when(n % 5 == 0, F.col("event_type")).otherwise("").alias("query"))


EDITS_SQL = """e AS (SELECT event_id AS seq, user_id % 10 AS session, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, ts, CASE WHEN event_id % 3 = 0 THEN ['src/file' || (user_id % 40) || '.py', 'src/file' || ((user_id + 1) % 40) || '.py'] ELSE ['src/file' || (user_id % 40) || '.py'] END AS files,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || ' by ' || user_id END AS summary, CASE WHEN event_id % 5 = 0 THEN event_type ELSE '' END AS query FROM events)"""


@query(f"WITH {EDITS_SQL}, x AS (SELECT session, ts, unnest(files) AS file FROM e) SELECT session, file, count(*) AS edited_count, max(ts) AS last_ts FROM x GROUP BY ALL")
def edit_counts(spark, d):
    return W.edit_counts(edits(spark, d), ["session"])


@query(f"""WITH {EDITS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS n FROM e WHERE summary <> ''), r AS (SELECT session, array_to_string(list(seq ORDER BY seq), ' ') AS recent FROM s WHERE n <= 20 GROUP BY session),
a AS (SELECT session, left(string_agg(summary, '; ' ORDER BY seq), 300) AS archive FROM s WHERE n > 20 GROUP BY session) SELECT session, recent, coalesce(archive, '') AS archive FROM r LEFT JOIN a USING (session)""")
def decision_log(spark, d):
    return W.decision_log(edits(spark, d), ["session"]).withColumn("recent", F.array_join("recent", " "))


@query(f"""WITH {EDITS_SQL}, f AS (SELECT seq, epoch, 'decision' AS kind, summary AS content, files[1] AS ref FROM e WHERE summary <> '' UNION ALL SELECT seq, epoch, 'edit_observation', CASE WHEN query <> '' THEN 'Edited after query: ' || query ELSE 'Edited during active session' END, unnest(files) FROM e)
SELECT seq, epoch AS created_epoch, kind, content, ref AS file_path FROM f""")
def edit_memories(spark, d):
    none = spark.createDataFrame([], "id string, path string, body_hash string")
    return W.edit_memories(edits(spark, d), none).select("seq", "created_epoch", "kind", "content", "file_path")


@query(f"""WITH {EDITS_SQL}, q AS (SELECT DISTINCT session, files[1] AS file, 'query_association' AS kind, 'Queried during: ' || query AS content FROM e WHERE query <> ''),
l AS (SELECT session, files[1] AS file FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS n FROM e) WHERE n <= 20), t AS (SELECT session, file, count(*) AS c FROM l GROUP BY ALL), g AS (SELECT session, list_sort(list(file)) AS files FROM t GROUP BY session),
o AS (SELECT session, file, 'interaction_pattern' AS kind, list_filter(files, lambda f: f <> file)[1:5] AS others FROM t JOIN g USING (session) WHERE c >= 2)
SELECT * FROM q UNION ALL SELECT session, file, kind, CASE WHEN len(others) > 0 THEN 'Frequently read with: ' || array_to_string(others, ', ') ELSE 'Repeatedly visited during recent work' END FROM o""")
def read_memories(spark, d):
    return W.read_memories(edits(spark, d).withColumn("file", F.get("files", F.lit(0))))


@query("""WITH f AS (SELECT doc_id AS file, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w, doc_id % 7 AS edited_count, n_chars AS tokens FROM documents), o AS (SELECT file, CAST(len(list_intersect(w, ['the', 'token', 'license', 'und'])) AS INTEGER) AS overlap, edited_count, tokens FROM f)
SELECT file, overlap FROM o WHERE overlap > 0 ORDER BY overlap DESC, edited_count DESC, tokens DESC, file LIMIT 12""")
def touched_files(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))
    files = B.table(spark, d, "documents").select(F.col("doc_id").alias("file"), words.alias("query_terms"), (F.col("doc_id") % 7).alias("edited_count"), F.col("n_chars").alias("tokens"))
    return W.touched_files(files, ["the", "token", "license", "und"]).select("file", "overlap")


@query(f"""WITH {EDITS_SQL}, s AS (SELECT seq, ts, CAST(CASE WHEN contains(lower(summary), 'click') THEN 2 ELSE 0 END + CASE WHEN contains(lower(summary), 'by 7') THEN 2 ELSE 0 END + len(list_intersect(files, ['src/file3.py', 'src/file7.py'])) AS INTEGER) AS score FROM e WHERE summary <> '')
SELECT seq, score FROM s WHERE score > 0 ORDER BY score DESC, ts DESC, seq DESC LIMIT 5""")
def relevant_decisions(spark, d):
    return W.relevant_decisions(edits(spark, d).filter("summary <> ''"), ["click", "by 7"], ["src/file3.py", "src/file7.py"]).select("seq", "score")


@query(f"WITH {EDITS_SQL} SELECT seq, CAST(CASE WHEN contains(summary, 'error') THEN 1 ELSE 0 END + CASE WHEN contains(summary, '12') THEN 1 ELSE 0 END AS INTEGER) AS overlap FROM e WHERE contains(summary, 'error') OR contains(summary, '12') ORDER BY seq DESC LIMIT 10")
def action_history(spark, d):
    rows = edits(spark, d).select("seq", F.lit("edit").alias("kind"), F.get("files", F.lit(0)).alias("file"), F.col("summary").alias("payload"))
    return W.action_hits(rows, ["error", "12"]).select("seq", "overlap")


@query(f"WITH {B.SYMBOLS_SQL} SELECT id, file_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS stale FROM symbols")
def symbols_of_edited_files(spark, d):
    s = B.symbols(spark, d).withColumn("path", F.col("file_id"))
    return W.mark_edited(s, B.table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("file"))).select("id", "stale")


@query(f"WITH {EDITS_SQL} SELECT seq AS key FROM e WHERE len(list_intersect(files, ['src/file3.py', 'src/file7.py'])) = 0")
def cache_invalidation(spark, d):
    cache = edits(spark, d).select(F.col("seq").alias("key"), F.transform("files", lambda f: F.concat(f, F.lit("::main"))).alias("files"))
    return W.invalidated(cache, spark.createDataFrame([("src/file3.py::x",), ("src/file7.py",)], "file string")).select("key")


@query(f"WITH {EDITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS n FROM e) SELECT session, seq FROM r WHERE n <= 20")
def keep_last_reads(spark, d):
    return W.keep_last(edits(spark, d), "seen_reads", ["session"]).select("session", "seq")


@query(f"WITH {EDITS_SQL} SELECT seq, {NOW} - epoch <= 900 AS retrieval, {NOW} - epoch <= 86400 AS external, {NOW} - epoch <= 600 AS read, {NOW} - epoch <= 1209600 AS automatic_memory FROM e")
def cache_lifetimes(spark, d):
    e = edits(spark, d).select("seq", F.col("epoch").alias("created_epoch"))
    for what in W.LIFETIME:
        young = W.alive(e, NOW, what).select("seq", F.lit(True).alias(what))
        e = e.join(young, "seq", "left").withColumn(what, F.coalesce(what, F.lit(False)))
    return e.drop("created_epoch")


@query("WITH n AS (SELECT source || '/' || doc_id AS id FROM documents ORDER BY doc_id LIMIT 200) SELECT DISTINCT split_part(id, '/', 1) AS root FROM n ORDER BY root LIMIT 15")
def package_roots(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("id"))
    return W.package_roots(docs, "doc_id")


@query("""WITH l AS (SELECT url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages), n AS (SELECT DISTINCT src AS id, 'file' AS kind FROM l UNION SELECT DISTINCT dst, 'symbol' FROM l)
SELECT 'nodes' AS what, count(*) AS n FROM n UNION ALL SELECT 'files', count(*) FROM n WHERE kind = 'file' UNION ALL SELECT 'symbols', count(*) FROM n WHERE kind = 'symbol' UNION ALL SELECT 'edges', count(*) FROM l""")
def graph_counts(spark, d):
    e = B.link_edges(spark, d)
    nodes = e.select(F.col("src").alias("id"), F.lit("file").alias("kind")).unionByName(e.select(F.col("dst").alias("id"), F.lit("symbol").alias("kind"))).distinct()
    return W.graph_counts(nodes, e)


@query("""WITH a AS (SELECT l_partkey AS key, l_orderkey AS place, 0 AS f FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_partkey AS key, l_orderkey AS place, 1 AS f FROM lineitem WHERE l_returnflag <> 'R'), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT key, min(CASE WHEN f = m THEN place END) AS place FROM (SELECT *, min(f) OVER (PARTITION BY key) AS m FROM u) GROUP BY key""")
def preferred_rows(spark, d):
    l = B.table(spark, d, "lineitem")
    rows = lambda keep: l.filter(keep).select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("place"))
    return W.preferred(rows(F.col("l_returnflag") == "R"), rows(F.col("l_returnflag") != "R"), ["key"], "place")


@query("SELECT o_orderkey AS seq, '[' || o_orderstatus || '] ' || o_orderpriority AS line FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' ORDER BY o_orderkey LIMIT 15")
def context_entries(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("content"))
    return W.entries_text(o, F.lit("1998-01-01").cast("timestamp_ntz"), "seq")


@query("""WITH f AS (SELECT doc_id, source || '/d' || doc_id AS path FROM documents), i AS (SELECT path, array_to_string(list_sort(list(DISTINCT x))[1:8], ', ') AS i FROM (SELECT path, 'm' || unnest(range(0, doc_id % 12)) AS x FROM f) GROUP BY path), s AS (SELECT path, array_to_string(list_sort(list(DISTINCT x))[1:12], ', ') AS s FROM (SELECT path, 's' || unnest(range(0, doc_id % 17)) AS x FROM f) GROUP BY path)
SELECT path, '// ' || path || CASE WHEN i IS NULL THEN '' ELSE chr(10) || '// imports: ' || i END || CASE WHEN s IS NULL THEN '' ELSE chr(10) || '// exports: ' || s END AS digest FROM f LEFT JOIN i USING (path) LEFT JOIN s USING (path)""")
def symbol_digest(spark, d):
    f = B.table(spark, d, "documents").select("doc_id", F.concat(F.col("source"), F.lit("/d"), "doc_id").alias("path"))
    upto = lambda n, mark: F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < F.col("doc_id") % n), lambda i: F.concat(F.lit(mark), i)))
    return W.symbol_digest(f, f.select(F.col("path").alias("src"), upto(12, "m").alias("dst")), f.select("path", upto(17, "s").alias("name")))


@query("SELECT doc_id, least(n_chars * 50, 120000) AS cost, CASE WHEN n_chars > 21000 THEN 2048 ELSE n_chars END AS shown, list_sort(list_transform(list_distinct(regexp_extract_all(text, '[A-Za-z]+')), lambda w: lpad(CAST(length(w) AS VARCHAR), 6, '0')))[-1]::INTEGER AS longest FROM documents")
def shadow_measures(spark, d):
    docs = B.table(spark, d, "documents").withColumn("size", F.col("n_chars") * 50)
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    return docs.select("doc_id", W.shadow_cost("size").alias("cost"), W.inline(F.col("n_chars")).alias("shown"), F.length(T.longest_term(words)).alias("longest"))


@query("SELECT p_partkey AS id FROM part WHERE p_size > 25 AND p_partkey % 3 <> 0")
def have_without_test(spark, d):
    p = B.table(spark, d, "part").withColumn("path", F.concat(F.lit("src/m"), "p_partkey", F.lit(".py")))
    edges = p.select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("tests/test_m"), "p_partkey", F.lit(".py"))).otherwise(F.concat(F.lit("src/testimony"), "p_partkey", F.lit(".py"))).alias("src"), F.col("path").alias("dst"))
    return W.untested_symbols(p, edges, F.col("p_size") > 25).select(F.col("p_partkey").alias("id"))


@query("SELECT source || '/' || lang || '/' || doc_id AS path FROM documents WHERE (source LIKE 'src1%' AND lang = 'en') OR source = 'src3'")
def inside_registered(spark, d):
    docs = B.table(spark, d, "documents")
    ones = docs.filter(F.col("source").startswith("src1")).select(F.concat(F.col("source"), F.lit("/en/")).alias("dir")).distinct()
    return W.inside(docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path")), ones.unionByName(spark.createDataFrame([("src3",), ("",)], "dir string")))


@query(f"WITH {B.SYMBOLS_SQL} SELECT id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_start, id) AS INTEGER) AS place FROM symbols WHERE file_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def symbols_of_files(spark, d):
    s = B.symbols(spark, d).withColumn("path", F.col("file_id"))
    return W.file_symbols(s, B.table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("path"))).select("id", "place")


@query(f"""WITH {B.LINES_SQL}, m AS (SELECT file_id, line_no FROM lines WHERE regexp_matches(text, '(?i)token|licen[sc]e'))
SELECT file_id, line_no, EXISTS (SELECT 1 FROM m WHERE m.file_id = lines.file_id AND m.line_no < lines.line_no AND m.line_no >= lines.line_no - 3) AS decorated FROM lines WHERE length(text) > 200""")
def lines_near_marks(spark, d):
    lines = B.lines(spark, d).withColumnRenamed("file_id", "path")
    long_ = lines.filter(F.length("text") > 200).select("path", "line_no")
    return W.decorated(lines, long_, "(?i)token|licen[sc]e").select(F.col("path").alias("file_id"), "line_no", "decorated")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def payload_fields(spark, d):
    return B.table(spark, d, "events").select("event_id", W.payload("props", {"k": "int"}).getField("k").alias("k"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'low' WHEN event_type IN ('click', 'view') THEN CASE WHEN value >= 4 THEN 'medium' ELSE 'low' END WHEN event_type = 'signup' THEN CASE WHEN value >= 4 THEN 'medium' ELSE 'low' END ELSE CASE WHEN value >= 10 THEN 'high' WHEN value >= 4 THEN 'medium' ELSE 'low' END END AS tier FROM events""")
def confidence_tiers(spark, d):
    t = F.col("event_type")
    intent = B.mapped(t, {"error": "content_search", "click": "control_flow", "view": "absence_query", "signup": "general", "purchase": "general"})
    task = F.when(t == "signup", "exhaustive").otherwise("targeted")
    return B.table(spark, d, "events").select("event_id", S.confidence(F.col("value"), intent, task).alias("tier"))


FIGURES_SQL = "g AS (SELECT source, CAST(count_if(doc_id % 3 <> 0) // 100 AS BIGINT) AS dead, CAST(count_if(n_chars > 15000) AS BIGINT) AS cycles, CAST(count_if(lang = 'fr') AS BIGINT) AS copies, CAST(count_if(n_chars < 20) AS BIGINT) AS db, CAST(round(count_if(lang = 'en') / count(*) * 100) AS INTEGER) AS pct FROM documents GROUP BY source)"


@query(f"""WITH {FIGURES_SQL}, t AS (SELECT source, unnest([CASE WHEN pct < 50 THEN '1 tests' END, CASE WHEN db > 0 THEN '1 database_out_of_routes' END, CASE WHEN copies > 0 THEN '2 extract_copies' END, CASE WHEN cycles > 0 THEN '2 break_cycles' END, CASE WHEN dead >= 5 THEN '3 remove_dead_exports' END]) AS x FROM g)
SELECT source, CAST(split_part(x, ' ', 1) AS INTEGER) AS week, split_part(x, ' ', 2) AS task FROM t WHERE x IS NOT NULL""")
def fix_roadmap(spark, d):
    g = B.table(spark, d, "documents").groupBy("source").agg(F.floor(F.count_if(F.col("doc_id") % 3 != 0) / 100).alias("dead"), F.count_if(F.col("n_chars") > 15000).alias("cycles"), F.count_if(F.col("lang") == "fr").alias("copies"), F.count_if(F.col("n_chars") < 20).alias("db"), F.round(F.count_if(F.col("lang") == "en") / F.count("*") * 100).cast("int").alias("pct"))
    return A.roadmap(g, ["source"])


@query("SELECT doc_id, CASE WHEN n_chars % 100 < 30 THEN 'LOW' WHEN n_chars % 100 < 60 THEN 'MEDIUM' ELSE 'HIGH' END AS label FROM documents")
def debt_labels(spark, d):
    return B.table(spark, d, "documents").select("doc_id", A.debt_label(F.col("n_chars") % 100).alias("label"))


@query("WITH u AS (SELECT 'app/m' || doc_id || '.py' AS path, n_chars AS size FROM documents WHERE doc_id % 3 = 2 OR (doc_id % 3 = 1 AND doc_id + 2 > (SELECT max(doc_id) FROM documents) AND doc_id - 1 < 0)), f AS (SELECT * FROM u ORDER BY path LIMIT 20) SELECT path, size FROM f ORDER BY size DESC, path LIMIT 15")
def largest_untested(spark, d):
    n = F.col("doc_id")
    path = F.when(n % 3 == 0, F.concat(F.lit("tests/test_m"), n + 1, F.lit(".py"))).otherwise(F.concat(F.lit("app/m"), n, F.lit(".py")))
    return A.largest_untested(B.table(spark, d, "documents").select(n.alias("id"), path.alias("path"), F.col("n_chars").alias("size"))).select("path", "size")


@query("SELECT page_id, ['remote', 'infra', 'explore', 'allow', 'remote', 'allow'][page_id % 6 + 1] AS class FROM pages")
def shell_kinds(spark, d):
    lines = ["ssh host 'ls /'", "cat .loom/graph.json", "cd x; rg foo src | head", "make | grep warn", "docker exec box ls && kubectl run job", "docker build ."]
    cmd = F.element_at(F.array(*map(F.lit, lines)), (F.col("page_id") % len(lines) + 1).cast("int"))
    return B.table(spark, d, "pages").select("page_id", T.shell_class(cmd, [".loom"]).alias("class"))


@query("""SELECT page_id, page_id % 3 = 0 AS names_file, CASE WHEN page_id % 3 = 1 THEN page_id ELSE 0 END AS pr, CASE WHEN page_id % 3 = 2 THEN page_id || ' ' || (page_id + 1) ELSE '' END AS issues FROM pages""")
def references_in_text(spark, d):
    n = F.col("page_id")
    text = F.when(n % 3 == 0, F.concat(F.lit("look at src/p"), n, F.lit(".ts please"))).when(n % 3 == 1, F.concat(F.lit("https://host.example/own/repo/pull/"), n, F.lit("/files"))).otherwise(F.concat(F.lit("Fixes #"), n, F.lit(", closes: #"), n + 1, F.lit(" and #9, fixes #"), n))
    return B.table(spark, d, "pages").select("page_id", T.has_file_path(F.when(n % 3 != 1, text)).alias("names_file"), F.coalesce(T.pull_request(text).getField("number"), F.lit(0)).alias("pr"), F.array_join(T.linked_issues(text), " ").alias("issues"))


@query("SELECT conv_id, arg_max(text, turn) AS last_text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_record(spark, d):
    from ..sources import corpus as C

    rows = B.table(spark, d, "conversations").select(F.col("conv_id").alias("sessionId"), F.col("turn").alias("line_no"), F.when(F.col("role") == "assistant", F.col("text")).alias("usage"))
    return C.last_usage(rows).select(F.col("sessionId").alias("conv_id"), F.col("usage").alias("last_text"))


def modules(spark, d):
    """A module a part, in a language by its number, with imports over several lines and braces in bodies."""
    n = F.col("p_partkey")
    # names are those of the module ten further on, whole modules are the one five further on, or else unknown ones
    far, wild = n + F.when(n % 20 < 10, 10).otherwise(1_000_000), n + F.when(n % 10 < 5, 5).otherwise(1_000_000)
    kinds = [
        (".ts", ["import {\n  alpha", far, ",\n  beta as b\n} from './m", far, "'\nexport * from \"./m", wild, "\"\nconst x = require('lib')\nexport function alpha", n, "(a) {\n  if (a) {\n    return {a}\n  }\n}\n\nexport const beta", n, " = () => {\n}\n"]),
        (".py", ["import os, sys as s\nfrom pkg.m", far, " import (\n    load", far, ",  # first\n    save as keep,\n)\nfrom m", wild, " import *\n\ndef load", n, "(a):\n    if a:\n\n        return a\n\nclass Box", n, ":\n    pass\n"]),
        (".go", ["package p\n\nimport (\n\t\"fmt\"\n\tx \"lib/m", far, "\"\n)\n\nfunc Load", n, "(a int) {\n\tfor {\n\t}\n}\n\nvar s = \"text\"\n"]),
        (".rs", ["use crate::m", far, "::{a, b};\nextern crate serde;\npub fn load", n, "() {\n    match x { A => {}, _ => {} }\n}\n"]),
        (".h", ["#include <vector>\n#include \"m", far, ".h\"\nstruct Box", n, " {\n  int a;\n};\n"]),
    ]
    pick = lambda values: F.element_at(F.array(*values), (n % len(kinds) + 1).cast("int"))
    text = pick([F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts]) for _, parts in kinds])
    return B.table(spark, d, "part").select(n.alias("n"), F.concat(F.lit("src/m"), n.cast("string"), pick([F.lit(e) for e, _ in kinds])).alias("path"), text.alias("content"))


MODULES_SQL = "m AS (SELECT p_partkey AS n, p_partkey % 5 AS k, 'src/m' || p_partkey || ['.ts', '.py', '.go', '.rs', '.h'][p_partkey % 5 + 1] AS path, p_partkey + CASE WHEN p_partkey % 20 < 10 THEN 10 ELSE 1000000 END AS far, p_partkey + CASE WHEN p_partkey % 10 < 5 THEN 5 ELSE 1000000 END AS wild FROM part)"


@query(f"""WITH {MODULES_SQL}, t AS (SELECT path AS src, unnest(CASE k WHEN 0 THEN ['./m' || far, './m' || wild, 'lib'] WHEN 1 THEN ['os', 'sys', 'pkg.m' || far, 'm' || wild] WHEN 2 THEN ['fmt', 'lib/m' || far] WHEN 3 THEN ['crate::m' || far, 'serde'] ELSE ['vector', 'm' || far || '.h'] END) AS dst FROM m)
SELECT DISTINCT src, dst, CASE WHEN dst = 'lib' THEN 'requires' ELSE 'imports' END AS rel FROM t""")
def import_edges_multiline(spark, d):
    return X.imports(modules(spark, d))


@query(f"WITH {MODULES_SQL} SELECT path AS src, unnest(CASE k WHEN 0 THEN ['alpha' || far, 'beta'] ELSE ['load' || far, 'save'] END) AS name FROM m WHERE k < 2")
def imported_names_multiline(spark, d):
    return X.imported_names(modules(spark, d))


@query(f"""WITH {MODULES_SQL}, s AS (SELECT path, unnest(CASE k WHEN 0 THEN [{{'name': 'alpha' || n, 'a': 7, 'b': 11}}, {{'name': 'beta' || n, 'a': 13, 'b': 14}}] WHEN 1 THEN [{{'name': 'load' || n, 'a': 8, 'b': 12}}, {{'name': 'Box' || n, 'a': 13, 'b': 14}}] WHEN 2 THEN [{{'name': 'Load' || n, 'a': 8, 'b': 11}}] WHEN 3 THEN [{{'name': 'load' || n, 'a': 3, 'b': 5}}] ELSE [{{'name': 'Box' || n, 'a': 3, 'b': 5}}] END) AS x FROM m)
SELECT path, x.name AS name, x.a AS line_start, x.b AS line_end FROM s""")
def extract_symbols_braces(spark, d):
    return X.symbols(modules(spark, d)).select("path", "name", "line_start", "line_end")


@query(f"""WITH {MODULES_SQL}, used AS (SELECT CASE k WHEN 0 THEN 'alpha' ELSE 'load' END || far AS name FROM m WHERE k < 2), whole AS (SELECT 'src/m' || wild || CASE k WHEN 0 THEN '.ts' ELSE '.py' END AS path FROM m WHERE k < 2),
s AS (SELECT path, unnest(CASE k WHEN 0 THEN ['alpha' || n, 'beta' || n] WHEN 1 THEN ['load' || n, 'Box' || n] WHEN 2 THEN ['Load' || n] WHEN 3 THEN ['load' || n] ELSE ['Box' || n] END) AS name FROM m)
SELECT path, name FROM s WHERE name NOT IN (SELECT name FROM used) AND path NOT IN (SELECT path FROM whole)""")
def dead_exports_source(spark, d):
    files = modules(spark, d)
    whole = G.resolve_imports(X.wildcard_imports(files), files.select("path")).filter("resolved IS NOT NULL").select(F.col("resolved").alias("path")).distinct()
    return A.dead_by_name(X.symbols(files), X.imported_names(files)).join(whole, "path", "left_anti").select("path", "name")
