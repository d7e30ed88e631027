"""Queries of the text functions, search and retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from . import bindings as B

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


STOP = "[" + ", ".join(map(q, T.STOP_WORDS)) + "]"
#: Distinct values in their first order.
FIRST = "[x[i] FOR i IN range(1, len(x) + 1) IF list_position(x, x[i]) = i]"


def terms_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9_]+'), lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w))"


def cases(text: str, signals: dict, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {q(T.any_of(p))}) THEN {q(n)}" for n, p in signals.items()) + f" ELSE {q(otherwise)} END"


@query(f"WITH c AS (SELECT conv_id, turn, {terms_sql('text')} AS x FROM conversations WHERE role = 'user') SELECT conv_id, turn, array_to_string({FIRST}[1:8], ' ') AS query_key FROM c")
def query_terms(spark, d):
    return B.table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", T.query_key("text").alias("query_key"))


NAME = "p_name || 'Sub' || upper(p_type) || '_' || p_brand"


@query(f"""WITH n AS (SELECT p_partkey, replace(replace(replace({NAME}, ' ', '_'), '#', ''), '-', '') AS name FROM part),
c AS (SELECT p_partkey, name, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[ _]+'), lambda w: length(w) >= 3) AS camel, list_filter(string_split(lower(name), '_'), lambda w: length(w) >= 3) AS snake FROM n),
k AS (SELECT p_partkey, [lower(name)] || camel || snake AS x FROM c) SELECT p_partkey, array_to_string({FIRST}[1:10], ' ') AS keywords FROM k""")
def name_keywords(spark, d):
    name = F.concat("p_name", F.lit("Sub"), F.upper("p_type"), F.lit("_"), "p_brand")
    clean = F.replace(F.replace(F.replace(name, F.lit(" "), F.lit("_")), F.lit("#"), F.lit("")), F.lit("-"), F.lit(""))
    return B.table(spark, d, "part").select("p_partkey", F.array_join(T.name_keywords(clean), " ").alias("keywords"))


@query(f"""SELECT conv_id, turn, CASE WHEN regexp_extract(lower(t), '^\\s*\\[task_type:(exhaustive|targeted|behavioral)\\]', 1) <> '' THEN regexp_extract(lower(t), '^\\s*\\[task_type:(exhaustive|targeted|behavioral)\\]', 1) ELSE {cases("lower(t)", T.TASK_SIGNALS, "targeted")} END AS task_type
FROM (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Audit and ' WHEN 1 THEN 'deadlock in ' WHEN 2 THEN '[task_type:behavioral] ' ELSE '' END || text AS t FROM conversations)""")
def task_type(spark, d):
    # marks are put before the texts, which hold none of the phrases themselves
    mark = F.when(F.col("turn") % 5 == 0, "Audit and ").when(F.col("turn") % 5 == 1, "deadlock in ").when(F.col("turn") % 5 == 2, "[task_type:behavioral] ").otherwise("")
    return B.table(spark, d, "conversations").select("conv_id", "turn", T.task_type(F.concat(mark, "text")).alias("task_type"))


@query(f"""SELECT conv_id, turn, {cases("lower(t)", T.INTENT_SIGNALS, "general")} AS intent
FROM (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'TODO ' WHEN 1 THEN 'n+1 ' WHEN 2 THEN 'routes without ' WHEN 3 THEN 'x.emit(y) ' ELSE '' END || text AS t FROM conversations)""")
def query_intent(spark, d):
    m = F.col("turn") % 6
    mark = F.when(m == 0, "TODO ").when(m == 1, "n+1 ").when(m == 2, "routes without ").when(m == 3, "x.emit(y) ").otherwise("")
    return B.table(spark, d, "conversations").select("conv_id", "turn", T.query_intent(F.concat(mark, "text")).alias("intent"))


@query("SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.token_estimate("text").alias("tokens"))


@query("SELECT doc_id, left(md5(text), 8) AS file_hash, left(sha256(text), 16) AS long_hash FROM documents")
def content_hash(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.body_hash("text").alias("file_hash"), F.left(F.sha2("text", 256), F.lit(16)).alias("long_hash"))


@query(f"WITH {B.LINES_SQL} SELECT file_id, CAST(count(*) AS BIGINT) AS lines, CAST(max(length(text)) AS INTEGER) AS longest FROM lines GROUP BY file_id")
def line_counts(spark, d):
    return B.lines(spark, d).groupBy("file_id").agg(F.count("*").alias("lines"), F.max(F.length("text")).alias("longest"))


@query(f"WITH {B.LINES_SQL} SELECT file_id, line_no, text FROM lines WHERE regexp_matches(text, '(?i)licen[sc]ed? under|token')")
def grep_lines(spark, d):
    return S.grep(B.lines(spark, d), "licen[sc]ed? under|token")


@query(f"WITH {B.LINES_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS n FROM lines WHERE regexp_matches(text, 'The')) SELECT file_id, line_no FROM h WHERE n <= 3")
def grep_per_file_cap(spark, d):
    return S.grep(B.lines(spark, d), "The", per_file=3).select("file_id", "line_no")


@query(f"WITH {B.SYMBOLS_SQL} SELECT l.file_id, l.line_no, s.id AS symbol FROM lines l LEFT JOIN symbols s ON l.file_id = s.file_id AND l.line_no BETWEEN s.line_start AND s.line_end WHERE regexp_matches(l.text, '(?i)ment|tion')")
def grep_enclosing_block(spark, d):
    return S.enclosing(S.grep(B.lines(spark, d), "ment|tion"), B.symbols(spark, d)).select("file_id", "line_no", "symbol")


def doc_lines(spark, d):
    return B.table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), T.text_lines("text").alias("lines"))


@query(f"WITH {B.LINES_SQL} SELECT file_id, line_no, md5(array_to_string(ls[greatest(1, line_no - 5):line_no + 5], chr(10))) AS block_hash FROM lines JOIN doc_lines ON doc_id = file_id WHERE regexp_matches(text, '(?i)licen[sc]e')")
def grep_context(spark, d):
    return S.context(doc_lines(spark, d), "licen[sc]e").select("file_id", "line_no", F.md5("block").alias("block_hash"))


@query(f"""WITH {B.LINES_SQL}, h AS (SELECT file_id, greatest(1, line_no - 12) AS s, min(line_no) AS first FROM lines WHERE regexp_matches(lower(text), 'license|token') GROUP BY ALL),
b AS (SELECT file_id, s, array_to_string(ls[s:first + 12], chr(10)) AS block FROM h JOIN doc_lines ON doc_id = file_id),
r AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY file_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
x AS (SELECT file_id, string_agg(block, chr(10) || chr(10) || '/* --- excerpt --- */' || chr(10) || chr(10) ORDER BY s) AS e FROM r WHERE before < 2000 GROUP BY file_id)
SELECT doc_id AS file_id, md5(left(coalesce(e, array_to_string(ls, chr(10))), 2000)) AS excerpt_hash FROM doc_lines LEFT JOIN x ON doc_id = file_id""")
def excerpt_blocks(spark, d):
    return S.excerpts(doc_lines(spark, d), ["license", "token"], 2000).select("file_id", F.md5("excerpt").alias("excerpt_hash"))


@query("SELECT doc_id, substr(text, greatest(1, instr(lower(text), 'licen') - 100), 200) AS slice FROM documents WHERE instr(lower(text), 'licen') > 0")
def anchor_excerpt(spark, d):
    return B.table(spark, d, "documents").select("doc_id", S.anchored(F.col("text"), "licen", 200).alias("slice")).filter("slice IS NOT NULL")


@query("""WITH r AS (SELECT doc_id, source, least(n_chars, 6000) AS want, coalesce(sum(least(n_chars, 6000)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT doc_id, source, CAST(greatest(0, least(want, 30000 - before)) AS BIGINT) AS taken FROM r WHERE least(want, 30000 - before) > 0""")
def excerpt_budget(spark, d):
    return S.budgeted(B.table(spark, d, "documents"), ["source"], [F.col("doc_id")], "n_chars", 30000, each=6000).select("doc_id", "source", F.col("taken").cast("long").alias("taken"))


@query(f"WITH {B.LINES_SQL} SELECT file_id, line_no, left(trim(regexp_extract(text, '(?i)(released|licensed)\\s*(under)?\\s*(.{{3,}})')), 90) AS mark FROM lines WHERE regexp_matches(text, '(?i)(released|licensed)\\s*(under)?\\s*(.{{3,}})')")
def marker_lines(spark, d):
    from ..operators import audit

    return audit.marked_lines(B.lines(spark, d), r"(?i)(released|licensed)\s*(under)?\s*(.{3,})")


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS w FROM documents),
a AS (SELECT DISTINCT item_id AS query_id, unnest({FIRST}[1:8]) AS term FROM (SELECT item_id, {terms_sql('text')} AS x FROM benchmark)),
st AS (SELECT count(*) AS n, avg(len(w)) AS al FROM w),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w) SEMI JOIN a USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM a JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 5""")
def bm25_topk(spark, d):
    return S.bm25(B.table(spark, d, "documents").select("doc_id", "text"), B.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")).select("query_id", "rank", "doc_id", "score")


FILES_SQL = "f AS (SELECT doc_id AS file_id, source || '/' || lang || '/d' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.go' WHEN 'fr' THEN '.ts' WHEN 'es' THEN '.md' END AS path, CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'go' WHEN 'fr' THEN 'js' END AS family, n_chars FROM documents)"


@query(f"WITH {FILES_SQL}, n AS (SELECT family, count(*) AS n FROM f WHERE family IS NOT NULL GROUP BY family), t AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM n) SELECT family, n, total FROM n, t WHERE n = (SELECT max(n) FROM n) AND total >= 10 AND n / total >= 0.6 ORDER BY family DESC LIMIT 1")
def dominant_language(spark, d):
    return S.dominant_language(B.files(spark, d))


@query(f"WITH {FILES_SQL} SELECT file_id, CASE WHEN family <> 'python' THEN n_chars // 2 ELSE n_chars END AS score, coalesce(family <> 'python', false) AS demoted FROM f")
def language_rerank(spark, d):
    f = B.files(spark, d)
    return S.rerank(f.select(F.col("id").alias("file_id"), "ext", F.col("size").alias("score")), S.dominant_language(f)).select("file_id", "score", "demoted")


@query(f"WITH {FILES_SQL}, {B.SYMBOLS_SQL}, s AS (SELECT file_id, id, CASE WHEN regexp_matches(lower(body), 'tion') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(body), 'ment') THEN 1 ELSE 0 END AS sc FROM symbols), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY sc DESC, id) AS n FROM s WHERE sc > 0) SELECT f.file_id, coalesce(r.id, f.path) AS target FROM f LEFT JOIN r ON f.file_id = r.file_id AND n = 1")
def symbol_upgrade(spark, d):
    s = B.symbols(spark, d).withColumn("name", F.col("body"))
    return S.upgrade(B.files(spark, d).select(F.col("id").alias("file_id"), "path"), s, ["tion", "ment"])


@query(f"""WITH {FILES_SQL}, r AS (SELECT path, n_chars AS size, row_number() OVER (ORDER BY n_chars DESC, file_id) AS rank FROM f),
i AS (SELECT *, row_number() OVER (PARTITION BY array_to_string(string_split(path, '/')[1:2], '/') ORDER BY rank) = 1 AS lead FROM r), o AS (SELECT *, row_number() OVER (ORDER BY lead DESC, rank) AS o FROM i) SELECT path, size FROM o WHERE (lead AND o <= 5) OR o <= 3""")
def diversify_dirs(spark, d):
    ranked = B.files(spark, d).select("path", F.struct((-F.col("size")).alias("less"), "id").alias("rank"))
    return S.diversify(ranked).select("path", (-F.col("rank.less")).alias("size"))


@query(f"WITH {FILES_SQL}, h AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM f JOIN documents ON doc_id = file_id WHERE regexp_matches(text, '(?i)licen[sc]e')) SELECT dir, count(*) AS hits, array_to_string(list_sort(list(DISTINCT path))[1:3], ' ') AS examples FROM h GROUP BY dir")
def exhaustive_map(spark, d):
    return S.directory_map(B.files(spark, d).filter(F.col("content").rlike("(?i)licen[sc]e"))).withColumn("examples", F.array_join("examples", " "))


@query("SELECT page_id, dst, dst <> '' AND NOT starts_with(dst, '@') AND instr(split_part(dst, '::', 1), ':') = 0 AND instr(split_part(dst, '::', 1), '/') > 0 AND instr(string_split(split_part(dst, '::', 1), '/')[-1], '.') > 0 AS local FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages)")
def local_file_refs(spark, d):
    p = B.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"))
    return p.select("page_id", "dst", T.is_local_file("dst").alias("local"))


@query("SELECT doc_id, CAST(length(substr(text, 1, instr(text, 'th'))) - length(replace(substr(text, 1, instr(text, 'th')), chr(10), '')) + 1 AS INTEGER) AS line_no FROM documents WHERE instr(text, 'th') > 0")
def match_line_number(spark, d):
    head = F.substring("text", F.lit(1), F.locate("th", F.col("text")))
    return B.table(spark, d, "documents").filter(F.locate("th", F.col("text")) > 0).select("doc_id", (F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1).alias("line_no"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'hard' WHEN page_id % 4 = 1 THEN 'soft' ELSE 'none' END AS severity, page_id % 4 = 2 AS explores FROM pages")
def shell_classes(spark, d):
    p = B.table(spark, d, "pages")
    k = F.col("page_id") % 4
    cmd = F.when(k == 0, "cd x && rm -rf build").when(k == 1, "echo a > out.txt").when(k == 2, "git status; grep -r foo src | head").otherwise("npm test | grep fail")
    return p.select("page_id", T.destructive(cmd).alias("severity"), T.explores(cmd).alias("explores"))
