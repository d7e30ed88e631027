"""Queries of the graph, import and absence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from . import bindings as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LINKS_SQL = "l AS (SELECT url AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst, 'references' AS rel FROM pages)"


@query(f"WITH {LINKS_SQL} SELECT src, dst, rel, count(*) AS n FROM l GROUP BY ALL")
def link_edges(spark, d):
    return B.link_edges(spark, d).groupBy("src", "dst", "rel").agg(F.count("*").alias("n"))


@query(f"WITH {LINKS_SQL}, t AS (SELECT DISTINCT dst AS node FROM l WHERE length(dst) <= 4), r AS (SELECT DISTINCT node, src, dst, rel FROM l JOIN t ON src = node OR dst = node), n AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY src, dst, rel) AS n FROM r) SELECT node, src, dst, rel FROM n WHERE n <= 30")
def neighbors(spark, d):
    e = B.link_edges(spark, d)
    return G.neighbours(e, e.filter(F.length("dst") <= 4).select(F.col("dst").alias("node")))


@query("""WITH c AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < 0)
SELECT 'p' || l_partkey AS node, count(*) AS degree FROM lineitem WHERE l_suppkey IN (SELECT node FROM c) GROUP BY 1""")
def impact(spark, d):
    return G.impact(_supply(spark, d), B.table(spark, d, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node")))


def _supply(spark, d):
    """(src, dst): every line's supplier and part."""
    return B.table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


def _traders(spark, d):
    """(node): all suppliers, parts and customers; customers are islands here."""
    ids = lambda name, mark, key: B.table(spark, d, name).select(F.concat(F.lit(mark), key).alias("node"))
    return ids("supplier", "s", "s_suppkey").unionAll(ids("part", "p", "p_partkey")).unionAll(ids("customer", "c", "c_custkey"))


NODES_SQL = "n AS (SELECT 's' || s_suppkey AS node FROM supplier UNION SELECT 'p' || p_partkey FROM part UNION SELECT 'c' || c_custkey FROM customer), x AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), e AS (SELECT * FROM x WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n))"
DEGREE_SQL = f"WITH {NODES_SQL}, g AS (SELECT node, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM n LEFT JOIN (SELECT dst, count(*) AS i FROM e GROUP BY dst) ON dst = node LEFT JOIN (SELECT src, count(*) AS o FROM e GROUP BY src) ON src = node)"


@query(f"{DEGREE_SQL} SELECT * FROM g")
def degrees(spark, d):
    return G.degrees(_supply(spark, d), _traders(spark, d))


@query("SELECT 'p' || l_partkey AS node, count(*) AS in_degree FROM lineitem GROUP BY 1 ORDER BY in_degree DESC, node LIMIT 20")
def degree_hotspots(spark, d):
    return G.hotspots(_supply(spark, d), 20)


@query(f"{DEGREE_SQL}, r AS (SELECT 'hotspots' AS list, node, in_degree AS k FROM g WHERE in_degree > 0 UNION ALL SELECT 'entry_points', node, out_degree FROM g WHERE in_degree = 0 AND out_degree > 0 UNION ALL SELECT 'complex', node, in_degree + out_degree FROM g WHERE in_degree + out_degree > 0 UNION ALL SELECT 'islands', node, 0 FROM g WHERE in_degree + out_degree = 0), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY list ORDER BY k DESC, node) AS INTEGER) AS rank FROM r) SELECT list, rank, node FROM o WHERE rank <= 10")
def system_map(spark, d):
    return G.system_map(G.degrees(_supply(spark, d), _traders(spark, d)))


BFS_SQL = f"""WITH RECURSIVE {B.ORDER_EDGES_SQL}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(node, hop) AS (SELECT p_partkey, 0 FROM part WHERE p_size = 1 UNION SELECT dst, hop + 1 FROM w JOIN u ON src = node WHERE hop < 3)"""


def _reached(spark, d):
    return G.bfs(B.order_edges(spark, d), B.table(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("node")), 3)


@query(f"{BFS_SQL} SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY node")
def bfs_hops(spark, d):
    return _reached(spark, d)


@query(f"{BFS_SQL}, h AS (SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY node) SELECT node, hop, CAST((3 - hop) * 10 + CASE WHEN p_size <= 10 THEN 5 ELSE 0 END AS INTEGER) AS score FROM h JOIN part ON p_partkey = node ORDER BY score DESC, node LIMIT 6")
def blast_radius(spark, d):
    recent = B.table(spark, d, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("node"))
    return G.blast(_reached(spark, d), recent, 3).orderBy(F.desc("score"), "node").limit(6)


SCC_SQL = f"WITH RECURSIVE {B.ORDER_EDGES_SQL}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON b = src), m AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"


@query(f"{SCC_SQL} SELECT node, component FROM m")
def scc(spark, d):
    return G.scc(B.order_edges(spark, d))


@query(f"{SCC_SQL} SELECT component, count(*) AS size, array_to_string(list_sort(list(node)), ' ') AS members FROM m GROUP BY component ORDER BY size DESC, component LIMIT 20")
def import_cycles(spark, d):
    return G.cycles(G.scc(B.order_edges(spark, d)), 20).withColumn("members", F.array_join("members", " "))


@query("""WITH f AS (SELECT 'src/m' || (doc_id % 50) || '/x' || doc_id || '.ts' AS path FROM documents), i AS (SELECT 'src/m' || (doc_id % 50) || '/x' || doc_id || '.ts' AS src, CASE doc_id % 3 WHEN 0 THEN '../m' || ((doc_id + 1) % 50) || '/x' || (doc_id + 1) WHEN 1 THEN 'm' || ((doc_id + 2) % 50) || '.x' || (doc_id + 2) ELSE './missing' END AS target, doc_id FROM documents)
SELECT src, target, CASE doc_id % 3 WHEN 0 THEN (SELECT path FROM f WHERE path = 'src/m' || ((doc_id + 1) % 50) || '/x' || (doc_id + 1) || '.ts') WHEN 1 THEN (SELECT path FROM f WHERE path = 'src/m' || ((doc_id + 2) % 50) || '/x' || (doc_id + 2) || '.ts') END AS resolved FROM i""")
def import_resolution(spark, d):
    n = F.col("doc_id")
    name = lambda k: F.concat(((n + k) % 50).cast("string"), F.lit("{}"), (n + k).cast("string"))
    path = F.concat(F.lit("src/m"), n % 50, F.lit("/x"), n, F.lit(".ts"))
    docs = B.table(spark, d, "documents")
    target = F.when(n % 3 == 0, F.concat(F.lit("../m"), F.replace(name(1), F.lit("{}"), F.lit("/x")))).when(n % 3 == 1, F.concat(F.lit("m"), F.replace(name(2), F.lit("{}"), F.lit(".x")))).otherwise("./missing")
    return G.resolve_imports(docs.select(path.alias("src"), target.alias("target")), docs.select(path.alias("path")))


@query("""SELECT source || '/' || lang || '/d' || doc_id AS path, array_to_string(CASE WHEN source LIKE '%1%' THEN [lang, 'deep_' || source, 'top', 'x' || source] ELSE [lang] END, ' ') AS keywords FROM documents""")
def prefix_enrichment(spark, d):
    docs = B.table(spark, d, "documents")
    files = docs.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), "doc_id")).alias("path"), F.array("lang").alias("keywords"))
    ones = docs.select("source", "lang").distinct().filter(F.col("source").contains("1"))
    terms = ones.select(F.col("source").alias("dir"), F.array(F.lit("top"), F.concat(F.lit("x"), "source")).alias("terms")).distinct().unionByName(ones.select(F.concat_ws("/", "source", "lang").alias("dir"), F.array(F.concat(F.lit("deep_"), "source")).alias("terms")))
    return G.prefix_enrichment(files, terms).withColumn("keywords", F.array_join("keywords", " "))


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'added' WHEN l.quality = 1 THEN 'same' ELSE 'changed' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def incremental_merge(spark, d):
    docs, labels = B.table(spark, d, "documents").select("doc_id", F.md5("text").alias("h")), B.table(spark, d, "labels")
    old = docs.join(labels, "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("h")).otherwise("old").alias("h"))
    return G.merge_incremental(old, docs, "doc_id", "h")


@query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 AND toxic = 0 AND starts_with(source, 'src1')")
def have_lack(spark, d):
    docs = B.table(spark, d, "documents").join(B.table(spark, d, "labels"), "doc_id")
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("good_quality")), F.when(F.col("toxic") == 1, F.lit("toxic"))))
    s = docs.select("doc_id", F.col("source").alias("path"), F.lit("use_case").alias("type"), F.lit(True).alias("exported"), tags.alias("keywords"))
    return G.have_lack(s, "Quality", "toxic", "src1").select("doc_id")


@query("SELECT o_orderpriority AS kind, key, count(*) AS n FROM (SELECT o_orderpriority, o_orderstatus || o_custkey AS key FROM orders) WHERE CASE WHEN (SELECT count(*) FROM orders WHERE lower(o_orderstatus || o_custkey) = 'f10') > 0 THEN lower(key) = 'f10' ELSE lower(key) LIKE '%f10%' END GROUP BY ALL")
def dynamic_trace(spark, d):
    o = B.table(spark, d, "orders")
    entries = o.select(F.col("o_orderpriority").alias("kind"), F.concat("o_orderstatus", "o_custkey").alias("key"), F.lit("registers").alias("role"), F.col("o_orderkey").cast("string").alias("file"))
    return G.match_key(entries, "F10").groupBy("kind", "key").agg(F.count("*").alias("n"))


@query("SELECT p_name AS symbol, count(*) AS imports FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_name ORDER BY imports DESC, symbol LIMIT 40")
def external_usage(spark, d):
    p, l = B.table(spark, d, "part"), B.table(spark, d, "lineitem")
    return l.groupBy("l_partkey").agg(F.count("*").alias("n")).join(p, F.col("l_partkey") == p.p_partkey).groupBy(F.col("p_name").alias("symbol")).agg(F.sum("n").alias("imports")).orderBy(F.desc("imports"), "symbol").limit(40)
