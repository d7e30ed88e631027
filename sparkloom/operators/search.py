"""Search over lines, symbols and files: grep, enclosing symbols, excerpts, ranking.

Text work is per row; joins are on keys or bucketed ranges; rankings are top-k windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Lines around a hit in excerpts and in expanded context.
EXCERPT_LINES, CONTEXT_LINES = 12, 5
#: Lines of a range-join bucket.
BUCKET = 64
#: Fixed value: language family of each extension.
FAMILIES = {
    ".c": "cpp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".py": "python", ".go": "go",
    ".ts": "js", ".tsx": "js", ".js": "js", ".jsx": "js", ".swift": "swift", ".cs": "dotnet", ".xaml": "dotnet", ".php": "php",
}


def grep(lines: DataFrame, pattern: str, per_file: int | None = None) -> DataFrame:
    """Lines that match, smart case; at most ``per_file`` of each file, first ones first."""
    hits = lines.filter(F.col("text").rlike(T.smart_case(pattern)))
    if per_file is None:
        return hits
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("file_id").orderBy("line_no"))).filter(F.col("_n") <= per_file).drop("_n")


def enclosing(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hits with the first symbol (by its start) whose lines hold them, or null.

    An equi-join on (file, bucket of lines): a symbol is listed in each bucket it reaches, so a
    long file doesn't compare every hit with every symbol.
    """
    spread = symbols.select("file_id", F.col("id").alias("symbol"), "line_start", "line_end", F.explode(F.sequence(F.floor(F.col("line_start") / BUCKET), F.floor(F.col("line_end") / BUCKET))).alias("bucket"))
    keyed = hits.withColumn("bucket", F.floor(F.col("line_no") / BUCKET))
    inside = (keyed.line_no >= spread.line_start) & (keyed.line_no <= spread.line_end)
    both = keyed.join(spread, (keyed.file_id == spread.file_id) & (keyed.bucket == spread.bucket) & inside, "left").select(keyed.file_id, keyed.line_no, keyed.text, "symbol", "line_start", "line_end")
    first = Window.partitionBy("file_id", "line_no").orderBy("line_start", "symbol")
    return both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def context(docs: DataFrame, pattern: str, around: int = CONTEXT_LINES) -> DataFrame:
    """(file_id, line_no, block): every matching line with its neighbours.

    ``docs``: (file_id, lines array). The neighbours come from the row's own array.
    """
    hit = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.get("lines", i - 1).rlike(T.smart_case(pattern)))
    rows = docs.filter(F.size("lines") > 0).select("file_id", "lines", F.explode(hit).alias("line_no"))
    start = F.greatest(F.col("line_no") - around, F.lit(1))
    return rows.select("file_id", "line_no", F.array_join(F.slice("lines", start, F.col("line_no") + around - start + 1), "\n").alias("block"))


def excerpts(docs: DataFrame, terms: list[str], max_chars: int, around: int = EXCERPT_LINES) -> DataFrame:
    """(file_id, excerpt): blocks about the lines that hold a term, one a starting line, until
    ``max_chars`` are reached; the text's beginning where no line does."""
    low = F.transform("lines", lambda x: F.lower(x))
    rows = docs.withColumn("_hits", F.filter(F.sequence(F.lit(1), F.greatest(F.size("lines"), F.lit(1))), lambda i: F.coalesce(F.get(low, i - 1).rlike(T.any_of(terms)), F.lit(False))))
    starts = F.array_distinct(F.transform("_hits", lambda i: F.greatest(i - around, F.lit(1))))
    # a block ends ``around`` lines after the first hit that begins there
    rows = rows.withColumn("_starts", starts).withColumn("_blocks", F.transform("_starts", lambda s: F.array_join(F.slice("lines", s, F.when(s == 1, F.array_min(F.filter("_hits", lambda i: F.greatest(i - around, F.lit(1)) == s)) + around).otherwise(F.lit(2 * around + 1))), "\n")))
    done = F.reduce("_blocks", F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("b")), lambda acc, x: F.when(acc.n >= max_chars, acc).otherwise(F.struct((acc.n + F.length(x)).alias("n"), F.concat(acc.b, F.array(x)).alias("b"))))
    joined = F.array_join(done.b, "\n\n/* --- excerpt --- */\n\n")
    whole = F.array_join("lines", "\n")
    return rows.select("file_id", F.left(F.when(F.size("_blocks") > 0, joined).otherwise(whole), F.lit(max_chars)).alias("excerpt"))


def anchored(text: Column, anchor: str, max_chars: int) -> Column:
    """A slice of ``max_chars`` centred on the first place of ``anchor``, case ignored; null if
    the text doesn't hold it."""
    at = F.locate(anchor.lower(), F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - max_chars // 2), F.lit(max_chars)))


def budgeted(items: DataFrame, by: list[str], order: list, size: str, budget: int, each: int | None = None) -> DataFrame:
    """Items with ``taken`` characters: in order, until the group's budget is used up; the last one
    is cut. Items that get nothing are left out."""
    want = F.least(F.col(size), F.lit(each)) if each else F.col(size)
    before = F.coalesce(F.sum(want).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return items.withColumn("taken", F.greatest(F.lit(0), F.least(want, F.lit(budget) - before))).filter("taken > 0")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query by BM25.

    ``docs``: (doc_id, text); ``queries``: (query_id, text). Only words of queries are counted in
    documents, by a join with the query words; the rest of a text adds to its length only.
    """
    word = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    asked = queries.select("query_id", F.explode(T.query_terms("text")).alias("term")).distinct()
    split = docs.select("doc_id", word(F.col("text")).alias("w"))
    stats = split.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avg_len"))
    tf = split.select("doc_id", F.size("w").alias("len"), F.explode_outer("w").alias("term")).join(asked.select("term").distinct(), "term").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighted = tf.join(df, "term").crossJoin(F.broadcast(stats)).select(
        "doc_id", "term",
        (F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))).alias("s"),
    )
    scored = asked.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)


def family(ext: str | Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    return F.try_element_at(table, F.col(ext) if isinstance(ext, str) else ext)


def dominant_language(files: DataFrame, least_files: int = 10, least_share: float = 0.6) -> DataFrame:
    """One row (family, n, total) if one family has a large share of enough files, else none."""
    n = files.withColumn("family", family("ext")).filter(F.col("family").isNotNull()).groupBy("family").agg(F.count("*").alias("n"))
    top = n.agg(F.max_by("family", F.struct("n", "family")).alias("family"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return top.filter((F.col("total") >= least_files) & (F.col("n") / F.col("total") >= least_share))


def rerank(ranked: DataFrame, dominant: DataFrame) -> DataFrame:
    """Ranked files (file_id, ext, score) with the scores of minority languages halved."""
    main = dominant.select(F.col("family").alias("_main"))
    rows = ranked.join(F.broadcast(main), how="left").withColumn("_f", family("ext"))
    demoted = F.coalesce((F.col("_f") != F.col("_main")), F.lit(False))
    return rows.withColumn("demoted", demoted).withColumn("score", F.when(demoted, F.floor(F.col("score") / 2)).otherwise(F.col("score")).cast("long")).drop("_main", "_f")


def upgrade(files: DataFrame, symbols: DataFrame, terms: list[str], per_file: int = 1) -> DataFrame:
    """(file_id, target): the symbols of each file that suit the query best, or the file itself.

    A symbol scores one for each term its name holds and one for five lines or more.
    """
    hits = sum((F.when(F.lower("name").contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    scored = symbols.withColumn("_score", hits + F.when(F.col("line_end") - F.col("line_start") >= 5, 1).otherwise(0)).filter("_score > 0")
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("_score"), "id"))).filter(F.col("_n") <= per_file)
    return files.join(best.select("file_id", "id"), "file_id", "left").select("file_id", F.coalesce("id", F.col("path")).alias("target"))


def diversify(ranked: DataFrame, most: int = 5, least: int = 3) -> DataFrame:
    """Ranked files (rank, path): the first of each two-part directory, up to ``most``, filled up to
    ``least`` with the next ones. ``rank`` is anything that sorts: a number, or a struct of keys.

    A directory's first file is a minimum, so a hot directory is combined before the shuffle.
    """
    parts = F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")
    leads = ranked.groupBy(parts.alias("_dir")).agg(F.min(F.struct("rank", "path")).alias("x")).select("x.path", "x.rank").orderBy("rank", "path").limit(most)
    # fewer leads than ``least`` are all there are, so as many rows more hold every file that may fill up
    others = ranked.select("path", "rank").orderBy("rank", "path").limit(most + least).join(leads.select("path"), "path", "left_anti")
    both = leads.withColumn("_lead", F.lit(True)).unionByName(others.withColumn("_lead", F.lit(False)))
    picked = both.withColumn("_o", F.row_number().over(Window.orderBy(F.desc("_lead"), "rank", "path")))
    return picked.filter(F.col("_lead") | (F.col("_o") <= least)).select("path", "rank")


def directory_map(hits: DataFrame, samples: int = 3) -> DataFrame:
    """(dir, hits, examples) of the directories of hit files."""
    return hits.groupBy(T.dirname("path").alias("dir")).agg(F.count("*").alias("hits"), F.slice(F.array_sort(F.collect_set("path")), 1, samples).alias("examples"))


def confidence(score: Column, intent: Column, task: Column | None = None) -> Column:
    """high from a score of 10 on, medium from 4, else low; one step down, to low for content that
    retrieval can't see, where the intent or a broad task asks for more than it finds."""
    base = F.when(score >= 10, 2).when(score >= 4, 1).otherwise(0)
    blind = intent.isin("control_flow", "absence_query", "dynamic_trace")
    if task is not None:
        blind = blind | task.isin("exhaustive", "behavioral")
    level = F.when(intent == "content_search", 0).when(blind, F.least(base, F.lit(1))).otherwise(base)
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), level + 1)
