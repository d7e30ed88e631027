"""The write side of the activity tables: edits, decisions, captured reads, history and small caches.

Every function takes DataFrames of rows as they come (append-only logs) and returns the rows that
they add or the state that follows from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Decisions kept word for word, characters of the archive, entries of other short lists.
DECISION_WINDOW, ARCHIVE_CHARS = 20, 300
KEEP_LAST = {"edges": 500, "actions": 200, "decisions": 20, "cache": 50, "seen_reads": 20}
# Seconds for which cached things hold.
LIFETIME = {"retrieval": 900, "external": 86_400, "read": 600, "automatic_memory": 14 * 86_400}
# Bytes of a file that count as read, of an answer that stays whole, and of its preview.
SHADOW_FILE, INLINE_CHARS, PREVIEW_CHARS = 120_000, 21_000, 2_048
# Directories that are no package's root.
NO_ROOTS = [".", "..", "node_modules", "vendor", "__pycache__", ".git"]


def alive(rows: DataFrame, now_epoch: int, what: str, ts: str = "created_epoch") -> DataFrame:
    """Rows that are young enough for their kind of cache."""
    return rows.filter(now_epoch - F.col(ts) <= LIFETIME[what])


def keep_last(rows: DataFrame, what: str, by: list[str], order: str = "seq") -> DataFrame:
    """The last rows of each ``by``, as many as lists of the kind hold."""
    newest = Window.partitionBy(*by).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= KEEP_LAST[what]).drop("_n")


def anchors(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """``refs`` (ref) with symbol_id, file_path and symbol_hash: of the symbol it names, else of its file."""
    s = symbols.select(F.col("id").alias("ref"), F.col("path").alias("_path"), F.col("body_hash").alias("_hash"))
    known = F.col("_path").isNotNull()
    return refs.join(s, "ref", "left").withColumns({
        "symbol_id": F.when(known, F.col("ref")).otherwise(""),
        "file_path": F.coalesce("_path", F.split_part("ref", F.lit("::"), F.lit(1))),
        "symbol_hash": F.coalesce("_hash", F.lit("")),
    }).drop("_path", "_hash")


def normalised(entries: DataFrame, symbols: DataFrame, now_epoch: int) -> DataFrame:
    """Memory entries with defaults filled in: an entry without content goes; the first file is its place
    where none is given; the time comes from an ISO date where there is no number."""
    said = F.trim(F.coalesce(F.nullif("content", F.lit("")), "summary", F.lit("")))
    first = F.coalesce(F.get(F.filter("files", lambda f: F.trim(f) != ""), F.lit(0)), F.lit(""))
    rows = entries.withColumn("content", said).filter("content <> ''").withColumn("ref", F.coalesce(F.nullif("symbol_id", F.lit("")), F.nullif(first, F.lit(""))))
    placed = anchors(rows.drop("symbol_id", "file_path", "symbol_hash"), symbols)
    given = rows.select("seq", F.col("symbol_id").alias("_s"), F.col("file_path").alias("_f"), F.col("symbol_hash").alias("_h"))
    epoch = F.unix_timestamp(F.try_to_timestamp(F.coalesce("created_at", "updated_at")))
    out = placed.join(given, "seq").withColumns({
        "kind": T.or_default("kind", "fact"),
        "symbol_id": F.coalesce(F.nullif("_s", F.lit("")), "symbol_id"),
        "file_path": F.coalesce(F.nullif("_f", F.lit("")), "file_path", F.lit("")),
        "symbol_hash": F.coalesce(F.nullif("_h", F.lit("")), "symbol_hash"),
        "created_epoch": F.when(F.coalesce("created_epoch", F.lit(0)) > 0, F.col("created_epoch")).otherwise(F.coalesce(epoch, F.lit(now_epoch))),
    })
    files = F.when(F.size("files") > 0, F.col("files")).otherwise(F.filter(F.array(F.coalesce(F.nullif("symbol_id", F.lit("")), "file_path")), lambda f: f != ""))
    return out.withColumn("files", files).select("seq", "kind", "content", "files", "symbol_id", "file_path", "symbol_hash", "created_epoch")


def edit_counts(edits: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, file, edited_count, last_ts) of edits (seq, ts, files)."""
    each = edits.select(*by, "ts", F.explode(F.array_distinct("files")).alias("file"))
    return each.groupBy(*by, "file").agg(F.count("*").alias("edited_count"), F.max("ts").alias("last_ts"))


def decision_log(edits: DataFrame, by: list[str]) -> DataFrame:
    """(by, recent, archive): numbers of the last decisions, newest last, and the beginning of the older
    ones' summaries. The archive holds only its first characters, so of older decisions no more than
    could fill it are gathered."""
    said = edits.filter(F.coalesce("summary", F.lit("")) != "")
    old, new = Window.partitionBy(*by).orderBy("seq"), Window.partitionBy(*by).orderBy(F.desc("seq"))
    recent = said.withColumn("_n", F.row_number().over(new)).filter(F.col("_n") <= DECISION_WINDOW)
    kept = recent.groupBy(*by).agg(F.array_sort(F.collect_list("seq")).alias("recent"))
    # a summary and its separator take three characters at least
    early = said.withColumn("_o", F.row_number().over(old)).filter(F.col("_o") <= ARCHIVE_CHARS // 3 + 1).join(recent.select(*by, "seq"), [*by, "seq"], "left_anti")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "summary"))), lambda x: x.summary), "; ")
    archive = early.groupBy(*by).agg(F.left(joined, F.lit(ARCHIVE_CHARS)).alias("archive"))
    return kept.join(archive, by, "left").withColumn("archive", F.coalesce("archive", F.lit("")))


def edit_memories(edits: DataFrame, symbols: DataFrame) -> DataFrame:
    """The memories that edits (seq, epoch, files, summary, query) leave: one of the decision, if it was put in
    words, and one of each file edited."""
    decisions = edits.filter(F.coalesce("summary", F.lit("")) != "").select("seq", "epoch", F.lit("decision").alias("kind"), F.col("summary").alias("content"), T.query_terms("summary").alias("tags"), F.coalesce(F.get("files", F.lit(0)), F.lit("")).alias("ref"))
    after = F.when(F.coalesce("query", F.lit("")) != "", F.concat(F.lit("Edited after query: "), "query")).otherwise("Edited during active session")
    seen = edits.withColumn("content", after).select("seq", "epoch", F.lit("edit_observation").alias("kind"), "content", T.query_terms(F.coalesce(F.nullif("summary", F.lit("")), "content")).alias("tags"), F.explode(F.array_distinct("files")).alias("ref"))
    return anchors(decisions.unionByName(seen), symbols).withColumnRenamed("epoch", "created_epoch")


def read_memories(reads: DataFrame, window: int = 20) -> DataFrame:
    """The memories that reads (session, seq, file, query) leave: what was asked when a file was read, and, of a
    file read twice or more among the session's last ``window`` reads, what it was read with."""
    asked = reads.filter(F.trim(F.coalesce("query", F.lit(""))) != "")
    queried = asked.select("session", "file", F.lit("query_association").alias("kind"), F.concat(F.lit("Queried during: "), F.trim("query")).alias("content")).distinct()
    last = reads.withColumn("_n", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq")))).filter(F.col("_n") <= window)
    times = last.groupBy("session", "file").count()
    together = times.groupBy("session").agg(F.array_sort(F.collect_set("file")).alias("files"))  # ``window`` files at most
    often = times.filter("count >= 2").join(together, "session").withColumn("others", F.slice(F.array_remove("files", F.col("file")), 1, 5))
    content = F.when(F.size("others") > 0, F.concat(F.lit("Frequently read with: "), F.array_join("others", ", "))).otherwise("Repeatedly visited during recent work")
    return queried.unionByName(often.select("session", "file", F.lit("interaction_pattern").alias("kind"), content.alias("content")))


def overlap(terms: str | Column, asked: list[str]) -> Column:
    return F.size(F.array_intersect(T.col(terms), F.array(*map(F.lit, asked)).cast("array<string>")))


def touched_files(files: DataFrame, asked: list[str], limit: int = 12) -> DataFrame:
    """Files (file, query_terms, edited_count, tokens) that meet the query's words: most words first, then most
    edits, then most tokens cached, then by name. Without words all files count."""
    rows = files.withColumn("overlap", overlap("query_terms", asked) if asked else F.lit(0))
    rows = rows.filter("overlap > 0") if asked else rows
    return rows.orderBy(F.desc("overlap"), F.desc("edited_count"), F.desc("tokens"), "file").limit(limit)


def relevant_decisions(decisions: DataFrame, asked: list[str], files: list[str], top: int = 5) -> DataFrame:
    """Decisions (ts, seq, summary, files) by two points a word and one a shared file, the newest first of
    equal ones; without words the last ones."""
    if not asked:
        return decisions.withColumn("score", F.lit(0)).orderBy(F.desc("ts"), F.desc("seq")).limit(top)
    words = sum((F.when(F.lower("summary").contains(t), 2).otherwise(0) for t in asked), F.lit(0))
    scored = decisions.withColumn("score", (words + overlap("files", files)).cast("int"))
    return scored.filter("score > 0").orderBy(F.desc("score"), F.desc("ts"), F.desc("seq")).limit(top)


def action_hits(actions: DataFrame, asked: list[str], limit: int = 10) -> DataFrame:
    """The newest actions (seq, kind, file, payload) whose payload holds a word of the query."""
    held = sum((F.when(F.lower("payload").contains(t), 1).otherwise(0) for t in asked), F.lit(0))
    rows = actions.withColumn("overlap", held)
    return (rows.filter("overlap > 0") if asked else rows).orderBy(F.desc("seq")).limit(limit).select("seq", "kind", "file", "overlap")


def mark_edited(symbols: DataFrame, edited: DataFrame) -> DataFrame:
    """Symbols (id, path) with ``stale``: those of edited files (file)."""
    gone = edited.select(F.col("file").alias("path")).distinct().withColumn("_edited", F.lit(True))
    return symbols.join(gone, "path", "left").withColumn("stale", F.coalesce("_edited", F.lit(False))).drop("_edited")


def invalidated(cache: DataFrame, edited: DataFrame) -> DataFrame:
    """Cache entries (key, files) that name no edited file; symbols count as their file."""
    base = F.transform("files", lambda f: F.split_part(f, F.lit("::"), F.lit(1)))
    hit = cache.select("key", F.explode(base).alias("file")).join(edited.select(F.split_part("file", F.lit("::"), F.lit(1)).alias("file")).distinct(), "file", "left_semi")
    return cache.join(hit.select("key").distinct(), "key", "left_anti")


def inside(paths: DataFrame, directories: DataFrame) -> DataFrame:
    """Paths (path) that are, or lie in, a registered directory (dir): each path meets its own prefixes."""
    prefixes = paths.select("path", F.explode(F.array_distinct(F.concat(T.path_prefixes("path"), F.array("path")))).alias("dir"))
    return prefixes.join(directories.select(F.rtrim("dir", F.lit("/")).alias("dir")).filter("dir <> ''").distinct(), "dir", "left_semi").select("path").distinct()


def package_roots(nodes: DataFrame, order: str, first: int = 200, top: int = 15) -> DataFrame:
    """(root): top directories of the first nodes (id), sorted."""
    root = F.split_part("id", F.lit("/"), F.lit(1))
    return nodes.orderBy(order).limit(first).filter(F.col("id").contains("/")).select(root.alias("root")).filter(~F.col("root").isin(NO_ROOTS)).distinct().orderBy("root").limit(top)


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): nodes, files, symbols and edges of a graph, nodes of (kind)."""
    counted = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "symbol").alias("symbols"))
    each = counted.select(F.explode(F.map_entries(F.create_map(F.lit("nodes"), "nodes", F.lit("files"), "files", F.lit("symbols"), "symbols"))).alias("x")).select(F.col("x.key").alias("what"), F.col("x.value").alias("n"))
    return each.unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n"))


def preferred(first: DataFrame, second: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Rows of both, one a key: the first table's if it has one, else the second's, by ``place`` within one."""
    both = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy("_from", place)
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_from")


def entries_text(entries: DataFrame, since: Column, order: str, first: int = 15) -> DataFrame:
    """(seq, line): the first entries (date, type, content) from a day on, as "[type] content"."""
    return entries.filter(F.col("date") >= since).orderBy(order).limit(first).select(order, F.format_string("[%s] %s", "type", "content").alias("line"))


def symbol_digest(files: DataFrame, edges: DataFrame, symbols: DataFrame, imports: int = 8, names: int = 12, chars: int = 2000) -> DataFrame:
    """(path, digest): a file's path, its first imports and its first symbols, from their tables alone."""
    def firsts(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
        ranked = rows.select(F.col(key).alias("path"), F.col(value).alias("v")).distinct().withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("v"))).filter(F.col("_n") <= n)
        return ranked.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias(value))

    i, s = firsts(edges, "src", "dst", imports), firsts(symbols, "path", "name", names)
    lines = F.concat_ws("\n", F.concat(F.lit("// "), "path"), F.concat(F.lit("// imports: "), "dst"), F.concat(F.lit("// exports: "), "name"))
    return files.select("path").join(i, "path", "left").join(s, "path", "left").select("path", F.left(lines, F.lit(chars)).alias("digest"))


def shadow_cost(size: str | Column) -> Column:
    """Characters that reading a file of some size would have cost."""
    return F.least(T.col(size), F.lit(SHADOW_FILE))


def inline(answer_chars: Column) -> Column:
    """Characters of an answer that are given at once: all, or a preview of a large one."""
    return F.when(answer_chars > INLINE_CHARS, PREVIEW_CHARS).otherwise(answer_chars)


def untested_symbols(symbols: DataFrame, edges: DataFrame, have: Column) -> DataFrame:
    """Symbols that ``have`` holds for and whose file no test file imports."""
    tested = edges.filter(T.is_test("src")).select(F.col("dst").alias("path")).distinct()
    return symbols.filter(have).join(tested, "path", "left_anti")


def file_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols of the given files (path), numbered in order of their lines."""
    order = Window.partitionBy("path").orderBy("line_start", "id")
    return symbols.join(files.select("path").distinct(), "path", "left_semi").withColumn("place", F.row_number().over(order))


def decorated(lines: DataFrame, declarations: DataFrame, decorator: str, within: int = 3) -> DataFrame:
    """Declarations (path, line_no) with ``decorated``: a line that matches stands at most ``within`` lines above.
    One window over both tables' lines of a file; no line meets another by a join."""
    marks = lines.filter(F.col("text").rlike(decorator)).select("path", "line_no", F.col("line_no").alias("_mark"), F.lit(0).alias("_d"))
    rows = declarations.withColumns({"_mark": F.lit(None).cast("int"), "_d": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    above = F.max("_mark").over(Window.partitionBy("path").orderBy("line_no").rangeBetween(-within, -1))
    return rows.withColumn("decorated", above.isNotNull()).filter("_d = 1").drop("_mark", "_d")


def payload(row: str | Column, fields: dict[str, str]) -> Column:
    """Only the named fields of a JSON text, as a struct; what else it holds is not kept."""
    return F.from_json(T.col(row), ", ".join(f"{name} {kind}" for name, kind in fields.items()))


def registered(known: DataFrame, found: DataFrame, now_epoch: int) -> DataFrame:
    """References (ref, created_epoch, ...) to files outside of the corpus that are still valid: the newest of
    each, known or found again; among equally new ones one that was found."""
    both = known.withColumn("_new", F.lit(0)).unionByName(found.withColumn("_new", F.lit(1)))
    rest = [c for c in both.columns if c not in ("ref", "_new")]
    newest = both.groupBy("ref").agg(F.max_by(F.struct(*rest), F.struct("created_epoch", "_new", *[c for c in rest if c != "created_epoch"])).alias("x")).select("ref", "x.*")
    return alive(newest, now_epoch, "external")
