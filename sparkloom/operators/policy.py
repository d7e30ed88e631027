"""What a read gets and how a query is answered: pure decisions that choose a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import search as S


def read_mode(wanted: Column, used: Column, seen_chars: Column, allowed: Column, cross_turn: Column, has_symbol: Column, has_anchor: Column, has_query: Column, budget: int = 60_000, gated: Column | None = None, anchor_found: Column | None = None, size: Column | None = None) -> Column:
    """The outcome of a read request, first rule first. ``gated``: another file is to be read again first;
    ``anchor_found``: whether the text holds the anchor; ``size``: characters of the text, which is given in
    full if that is no more than is wanted, and by its beginning if nothing else is asked for."""
    yes, no = F.lit(True), F.lit(False)
    fits = no if size is None else size <= wanted
    return (
        F.when(~allowed, "allowlist_blocked")
        .when(no if gated is None else gated, "reuse_gate_blocked")
        .when(cross_turn, "cross_turn_pointer")
        .when(used >= budget, "budget_exhausted")
        .when(seen_chars >= wanted, "dedupe_preview")
        .when(has_symbol, "symbol_excerpt")
        .when(has_anchor & (yes if anchor_found is None else anchor_found), "anchor_excerpt")
        .when(has_anchor, "anchor_fallback_head")
        .when(fits, "full")
        .when(has_query, "query_excerpt")
        .otherwise("full" if size is None else "head")
    )


def spent(read: Column, turns: Column, task: Column) -> Column:
    """struct(cost, turns): none, warning or limit, by what a task of this type may read and take."""
    most = T.limits(F.when(task.isin(*T.TASK_LIMITS), task).otherwise("unknown"))
    level = lambda x, what: F.when(x >= most.getField(f"hard_{what}"), "limit").when(x >= most.getField(f"warn_{what}"), "warning").otherwise("none")
    return F.struct(level(read, "tokens").alias("cost"), level(turns, "turns").alias("turns"))


def read_file(docs: DataFrame, file_id, max_chars: int = 20_000, query_terms: list[str] | None = None, anchor: str = "", span: tuple[int, int] | None = None) -> DataFrame:
    """(file_id, mode, text) of one file (file_id, lines): a symbol's lines, the text about an
    anchor, blocks about the query's words, or the beginning."""
    one = docs.filter(F.col("file_id") == file_id)
    whole = F.array_join("lines", "\n")
    if span:
        return one.select("file_id", F.lit("symbol_excerpt").alias("mode"), F.left(F.array_join(F.slice("lines", span[0], span[1] - span[0] + 1), "\n"), F.lit(max_chars)).alias("text"))
    if anchor:
        cut = S.anchored(whole, anchor, max_chars)
        return one.select("file_id", F.when(cut.isNull(), "anchor_fallback_head").otherwise("anchor_excerpt").alias("mode"), F.coalesce(cut, F.left(whole, F.lit(max_chars))).alias("text"))
    if query_terms:
        return S.excerpts(one, query_terms, max_chars).select("file_id", F.lit("query_excerpt").alias("mode"), F.col("excerpt").alias("text"))
    return one.select("file_id", F.lit("full").alias("mode"), F.left(whole, F.lit(max_chars)).alias("text"))


def remembered(cache: DataFrame, terms: Column, least: int = 3, top: int = 3) -> DataFrame:
    """Files (file, cached_terms, tokens) whose remembered words meet the query's often enough."""
    return cache.withColumn("overlap", F.size(F.array_intersect("cached_terms", terms))).filter(F.col("overlap") >= least).orderBy(F.desc("overlap"), F.desc("tokens"), "file").limit(top)


def plan(query: str, n_files: int, spark) -> dict:
    """How a query is answered: its task type, intent, words and limits, from one tiny plan."""
    row = spark.range(1).select(T.task_type(F.lit(query)).alias("task"), T.query_intent(F.lit(query)).alias("intent"), T.query_terms(F.lit(query)).alias("terms")).first()
    route = "small_project" if n_files < 5 else "exhaustive_map" if row.task == "exhaustive" else "retrieve"
    return {"task_type": row.task, "intent": row.intent, "terms": list(row.terms), "route": route, "limits": T.TASK_LIMITS[row.task]}
