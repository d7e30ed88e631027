"""The engine's functions over one corpus: each returns a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import actions as W
from .operators import audit as A
from .operators import extract as X
from .operators import graph as G
from .operators import memory as M
from .operators import policy as P
from .operators import search as S
from .sources import corpus as C


@dataclass
class Corpus:
    """files (path, ext, size, content, ...), symbols and edges of a source tree."""

    spark: SparkSession
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame

    @classmethod
    def scan(cls, spark: SparkSession, root: str) -> Corpus:
        return cls(spark, **C.build(spark, root))

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Corpus:
        return cls(spark, **C.read_graph(spark, folder))

    def save(self, folder: str) -> None:
        C.write_graph({"files": self.files, "symbols": self.symbols, "edges": self.edges}, folder)

    def lines(self) -> DataFrame:
        return X.lines_of(self.files).withColumnRenamed("path", "file_id")

    def _docs(self) -> DataFrame:
        return self.files.select(F.col("path").alias("file_id"), T.text_lines("content").alias("lines"))

    def _spans(self) -> DataFrame:
        return self.symbols.select(F.col("path").alias("file_id"), "id", "name", "line_start", "line_end")

    def retrieve(self, query: str, top_files: int = 5) -> DataFrame:
        asked = self.spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("text"))
        return S.bm25(self.files.select(F.col("path").alias("doc_id"), F.concat_ws(" ", "content", F.array_join("keywords", " ")).alias("text")), asked, top_files)

    def answer(self, query: str, top_files: int = 5, memory: DataFrame | None = None) -> tuple[dict, DataFrame]:
        """How a query is answered, and its files: for a small corpus all of them, files remembered from
        like queries, a map of directories, or files ranked, with minority languages demoted,
        spread over directories where the task is broad."""
        how = P.plan(query, self.files.limit(5).count(), self.spark)
        if how["route"] == "small_project":
            return how, self.files.select(F.col("path").alias("target"))
        if memory is not None:
            known = P.remembered(memory, F.array(*map(F.lit, how["terms"])).cast("array<string>"))
            if not known.isEmpty():
                return how | {"route": "memory_first", "confidence": "high"}, known.select(F.col("file").alias("target"))
        if how["route"] == "exhaustive_map" and how["terms"]:
            how = how | {"sample": [r.path for r in S.diversify(self._ranked(query, 20), 5, 3).orderBy("rank").collect()]}
            return how, S.directory_map(self.files.filter(F.lower("content").rlike(T.any_of(how["terms"]))))
        ranked = self._ranked(query, top_files)
        top = ranked.agg(F.max("score").alias("s")).select(S.confidence(F.coalesce("s", F.lit(0.0)), F.lit(how["intent"]), F.lit(how["task_type"])).alias("c")).first().c
        return how | {"confidence": top}, S.upgrade(ranked.withColumn("file_id", F.col("path")), self._spans(), how["terms"])

    def _ranked(self, query: str, top_files: int) -> DataFrame:
        """(path, rank, score) with minority languages demoted; as many rows as are asked for."""
        found = self.retrieve(query, top_files).select(F.col("doc_id").alias("file_id"), T.suffix("doc_id").alias("ext"), "score")
        again = S.rerank(found, S.dominant_language(self.files))
        return again.select(F.col("file_id").alias("path"), "score", F.row_number().over(Window.orderBy(F.desc("score"), "file_id")).alias("rank"))

    def top_edges(self, query: str, top_files: int = 5, limit: int = 30) -> DataFrame:
        """Edges between the files that a query finds and their neighbours."""
        return G.neighbours(self.edges, self.retrieve(query, top_files).select(F.col("doc_id").alias("node")), limit)

    def read(self, file: str, max_chars: int = 20_000, query: str = "", anchor: str = "") -> DataFrame:
        path, _, name = file.partition("::")
        span = None
        if name:
            found = self.symbols.filter(F.col("id") == file).select("line_start", "line_end").first()
            span = (found.line_start, found.line_end) if found else None
        terms = P.plan(query, 5, self.spark)["terms"] if query else None
        return P.read_file(self._docs(), path, max_chars, terms, anchor, span)

    def neighbors(self, file: str, limit: int = 30) -> DataFrame:
        return G.neighbours(self.edges, self.spark.createDataFrame([(file,)], "node string"), limit)

    def impact(self, changed: list[str]) -> DataFrame:
        return G.impact(self.edges, self.spark.createDataFrame([(x,) for x in changed], "node string")).filter(T.is_local_file("node"))

    def grep(self, pattern: str, per_file: int | None = None) -> DataFrame:
        return S.enclosing(S.grep(self.lines().select("file_id", "line_no", "text"), pattern, per_file), self._spans())

    def grep_all(self, pattern: str, max_hits: int = 200, file_glob: str = "") -> DataFrame:
        lines = self.lines().filter(F.col("file_id").rlike(T.glob_pattern(file_glob))) if file_glob else self.lines()
        return S.grep(lines, pattern).orderBy("file_id", "line_no").limit(max_hits)

    def find_missing(self, have: str, lack: str, scope: str = "") -> DataFrame:
        return G.have_lack(self.symbols.withColumnRenamed("symbol_type", "type").withColumn("keywords", T.name_keywords("name")), have, lack, scope)

    def _resolved(self, targets: DataFrame) -> DataFrame:
        return G.resolve_imports(targets, self.files.select("path")).filter("resolved IS NOT NULL")

    def dead_exports(self, prefix: str = "", min_span: int = 0, limit: int = 60, symbol_type: str = "") -> DataFrame:
        whole = self._resolved(X.wildcard_imports(self.files)).select(F.col("resolved").alias("path")).distinct()
        dead = A.dead_by_name(self.symbols, X.imported_names(self.files)).join(whole, "path", "left_anti")
        if symbol_type:
            dead = dead.filter(F.col("symbol_type") == symbol_type)
        return dead.filter(F.col("path").startswith(prefix) & (F.col("line_end") - F.col("line_start") >= min_span)).orderBy("path", "line_start").limit(limit)

    def find_cycles(self, limit: int = 20, file_prefix: str = "") -> DataFrame:
        inside = self.edges.filter(F.col("rel").isin("imports", "requires") & F.col("src").startswith(file_prefix))
        resolved = self._resolved(inside.select("src", F.col("dst").alias("target"))).filter(F.col("resolved").startswith(file_prefix))
        return G.cycles(G.scc(resolved.select("src", F.col("resolved").alias("dst"))), limit)

    def debug(self, error: str, radius: int = 3) -> DataFrame:
        """Files near a stack trace's frames, by score."""
        found = X.frames(self.spark.createDataFrame([(0, error)], "trace_id int, text string"))
        seeds = G.frames_to_files(found.select("seq", "path", "line"), self.files.select("path")).select(F.col("file").alias("node"))
        resolved = G.resolve_imports(self.edges.filter("rel = 'imports'").select("src", F.col("dst").alias("target")), self.files.select("path")).filter("resolved IS NOT NULL").select("src", F.col("resolved").alias("dst"))
        return G.blast(G.bfs(resolved, seeds, radius), seeds, radius).orderBy(F.desc("score"), "node").limit(2 * radius)

    def root_causes(self, error: str) -> DataFrame:
        """Symbols that the first frames of a stack trace name."""
        return G.frame_symbols(X.frames(self.spark.createDataFrame([(0, error)], "trace_id int, text string")), self.symbols)

    def adjacency(self, rels: tuple[str, ...] = ("imports", "requires")) -> DataFrame:
        """(file, way, other): imports that files of the corpus answer, both ways."""
        found = self._resolved(self.edges.filter(F.col("rel").isin(*rels)).select("src", F.col("dst").alias("target")))
        nodes = self.files.select(F.col("path").alias("id"), "path")
        return G.file_adjacency(found.select("src", F.col("resolved").alias("dst"), F.lit("imports").alias("rel")), nodes, ["imports"])

    def changed_context(self, changed: list[str], affected: int = 8, reads: int = 5) -> DataFrame:
        """(part, rank, file): files that changed ones touch, and the first to read."""
        links = self.adjacency().filter("way = 'to'").select(F.col("file").alias("src"), F.col("other").alias("dst"))
        mine = self.spark.createDataFrame([(0, x) for x in changed], "review int, file string")
        return G.changed_context(links, mine, affected, reads).drop("review")

    def register(self, known: DataFrame, hits: DataFrame, now_epoch: int) -> DataFrame:
        """References (ref, created_epoch) to another tree's files, with those of a search's hits, while they are valid."""
        found = hits.select(F.col("file_id").alias("ref"), F.lit(now_epoch).cast("long").alias("created_epoch")).distinct()
        return W.registered(known.select("ref", "created_epoch"), found, now_epoch)

    def external_usage(self, package: str = "") -> DataFrame:
        """(dst, files): imports that no file of the corpus answers."""
        r = G.resolve_imports(self.edges.filter("rel = 'imports'").select("src", F.col("dst").alias("target")), self.files.select("path"))
        out = r.filter("resolved IS NULL").groupBy("target").agg(F.count_distinct("src").alias("files"))
        return out.filter(F.col("target").contains(package)) if package else out

    def audit(self) -> dict[str, DataFrame]:
        code = self.files.filter(X.language("path").isNotNull()).select(F.col("path").alias("id"), "path", "size")
        lines = self.lines()
        return {"coverage": A.coverage(code), "untested": A.untested(code), "copy_paste": A.copy_paste(self.symbols), "todos": A.marked_lines(lines), "database_in_routes": A.database_in_routes(code, lines), "dead_exports": self.dead_exports(), "cycles": self.find_cycles()}

    def write_audit(self, folder: str) -> None:
        """The audit as JSON lines and a Markdown report."""
        C.write_report(self.audit(), folder)

    def memories(self, entries: DataFrame, query: str, now_epoch: int, limit: int = 8) -> DataFrame:
        return M.best(M.score(entries, P.plan(query, 5, self.spark)["terms"], [], now_epoch), limit)

    def register_edit(self, files: list[str], summary: str = "", query: str = "", epoch: int = 0, seq: int = 0) -> dict[str, DataFrame]:
        """What an edit adds: memories, the symbols that are stale now, and counts by file."""
        edit = self.spark.createDataFrame([(seq, epoch, files, summary, query)], "seq long, epoch long, files array<string>, summary string, query string")
        touched = edit.select(F.explode("files").alias("file"))
        return {"memories": W.edit_memories(edit, self.symbols), "stale": W.mark_edited(self.symbols, touched).filter("stale"), "counts": W.edit_counts(edit.withColumn("ts", F.col("epoch")))}

    def add_memory(self, kind: str, content: str, files: list[str], now_epoch: int, seq: int = 0) -> DataFrame:
        """The normalised entry of a memory, ready to be merged with the others."""
        entry = self.spark.createDataFrame([(seq, kind, content, files)], "seq long, kind string, content string, files array<string>")
        blank = {c: F.lit(None).cast(t) for c, t in (("summary", "string"), ("symbol_id", "string"), ("file_path", "string"), ("symbol_hash", "string"), ("created_at", "string"), ("updated_at", "string"), ("created_epoch", "long"))}
        return W.normalised(entry.withColumns(blank), self.symbols, now_epoch)

    def add_decision(self, summary: str, files: list[str], now_epoch: int, seq: int = 0) -> DataFrame:
        return self.add_memory("decision", summary, files, now_epoch, seq)

    def action_summary(self, history: DataFrame, decisions: DataFrame, actions: DataFrame, query: str = "", limit: int = 12) -> dict[str, DataFrame]:
        """Files touched, decisions and actions that have to do with a query."""
        terms = P.plan(query, 5, self.spark)["terms"] if query else []
        files = W.touched_files(history, terms, limit)
        named = [r.file for r in files.select("file").collect()]  # ``limit`` at most
        return {"files": files, "decisions": W.relevant_decisions(decisions, terms, named), "actions": W.action_hits(actions, terms)}

    def dynamic_trace(self, entries: DataFrame, key: str) -> DataFrame:
        return G.match_key(entries, key)

    def cross_search(self, root: str, pattern: str, max_hits: int = 200) -> DataFrame:
        """Matching lines of another tree, which is read as it is and not kept."""
        lines = X.lines_of(C.read_tree(self.spark, root)).withColumnRenamed("path", "file_id")
        return S.grep(lines, pattern).orderBy("file_id", "line_no").limit(max_hits)

    def digest(self) -> DataFrame:
        return W.symbol_digest(self.files, self.edges.filter("rel IN ('imports', 'requires')"), self.symbols)

    def bodies(self, pattern: str, scope: str = "", symbols: int = 5, lines: int = 80) -> DataFrame:
        """(id, body) of the first symbols that hold matching lines: in ``scope`` if any match there, else anywhere."""
        hits = self.grep(pattern).filter("symbol IS NOT NULL")
        inside = hits.filter(F.col("file_id").startswith(scope))
        found = (inside if scope and not inside.isEmpty() else hits).groupBy("file_id", "symbol", "line_start", "line_end").count()
        first = found.orderBy(F.desc("count"), "symbol").limit(symbols)
        n = F.least(F.col("line_end") - F.col("line_start") + 1, F.lit(lines))
        return first.join(self._docs(), "file_id").select(F.col("symbol").alias("id"), F.array_join(F.slice("lines", F.col("line_start"), n), "\n").alias("body"))
