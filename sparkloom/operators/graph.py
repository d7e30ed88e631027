"""Graph operators over edge tables (src, dst[, rel]).

Iterative ones loop on the driver over DataFrames, one round a pass over the frontier, and cut
lineage each round by files in the shared folder; what the driver sees is a count.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: files in the folder that ``spark.checkpoint.dir``
    names (a temporary one only under a local master), which survive the loss of executors. Unlike
    a checkpoint, whose size estimates multiply join by join, files bring their true sizes."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/sparkloom/graph-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before
        pass


def neighbours(edges: DataFrame, nodes: DataFrame, limit: int = 30) -> DataFrame:
    """(node, src, dst, rel): at most ``limit`` edges that touch each node, in order.

    Two equi-joins and a union instead of one join on "either end".
    """
    n = nodes.select("node").distinct()
    touch = edges.join(n.withColumnRenamed("node", "src"), "src").withColumn("node", F.col("src")).unionByName(edges.join(n.withColumnRenamed("node", "dst"), "dst").withColumn("node", F.col("dst")))
    rows = touch.select("node", "src", "dst", "rel").distinct()
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy("src", "dst", "rel"))).filter(F.col("_n") <= limit).drop("_n")


def impact(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, degree): other ends of edges at changed nodes, without the changed ones."""
    c = changed.select("node").distinct()
    out = edges.join(c.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    back = edges.join(c.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
    return out.unionAll(back).join(c, "node", "left_anti").groupBy("node").agg(F.count("*").alias("degree"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree) of every given node; edges to other nodes don't count."""
    known = nodes.select("node").distinct()
    inside = edges.select("src", "dst").distinct().join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    i, o = inside.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree")), inside.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    return known.join(i, "node", "left").join(o, "node", "left").select("node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def hotspots(edges: DataFrame, n: int = 20) -> DataFrame:
    """The most referred-to targets."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree")).orderBy(F.desc("in_degree"), "node").limit(n)


def system_map(deg: DataFrame, n: int = 10) -> DataFrame:
    """(list, rank, node): hotspots, entry points (only outgoing), complex nodes and islands."""
    total = F.col("in_degree") + F.col("out_degree")
    rules = {
        "hotspots": (F.col("in_degree") > 0, F.col("in_degree")), "entry_points": ((F.col("in_degree") == 0) & (F.col("out_degree") > 0), F.col("out_degree")),
        "complex": (total > 0, total), "islands": (total == 0, F.lit(0)),
    }
    # the top rows are taken before they are numbered, so no window sees more than n rows
    picked = [deg.filter(keep).select("node", key.alias("k")).orderBy(F.desc("k"), "node").limit(n).select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(F.desc("k"), "node")).alias("rank"), "node") for name, (keep, key) in rules.items()]
    out = picked[0]
    for p in picked[1:]:
        out = out.unionByName(p)
    return out


def bfs(edges: DataFrame, seeds: DataFrame, radius: int, directed: bool = False) -> DataFrame:
    """(node, hop): nodes within ``radius`` steps of any seed, with the least distance."""
    step = edges.select("src", "dst")
    if not directed:
        step = step.unionAll(step.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    step = settle(step.filter("src <> dst").distinct())
    seen = settle(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    front = seen
    for hop in range(1, radius + 1):
        front = settle(front.join(step, front.node == step.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def blast(reached: DataFrame, recent: DataFrame, radius: int) -> DataFrame:
    """(node, hop, score): nearer nodes first, five more for lately changed ones."""
    r = recent.select("node").distinct().withColumn("_r", F.lit(5))
    return reached.join(r, "node", "left").select("node", "hop", ((radius - F.col("hop")) * 10 + F.coalesce("_r", F.lit(0))).alias("score"))


def scc(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of two nodes or more, each named by its
    smallest node.

    Nodes without way in or out are trimmed. Then every node takes the smallest label that
    reaches it (forward) and the smallest it reaches (backward); nodes of equal label pair that
    meet their label's own node both ways form that node's component, and edges between
    different pairs are cut. Repeated on the rest until none is left, so cost follows what is
    undecided; each round decides at least the smallest node.
    """
    left = settle(edges.select("src", "dst").filter("src <> dst").distinct())
    done = None
    while True:
        n = left.count()
        while n:  # trim
            left = settle(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            before, n = n, left.count()
            if n == before:
                break
        if not n:
            break
        nodes = left.select(F.col("src").alias("node")).unionAll(left.select(F.col("dst").alias("node"))).distinct()
        label = _least_labels(nodes, left)
        # reached by its label's node and reaching it: same component
        found = label.filter("f = b").select("node", F.col("f").alias("component"))
        done = found if done is None else done.unionByName(found)
        done = settle(done)
        rest = label.join(found, "node", "left_anti")
        s, t = rest.select(F.col("node").alias("src"), F.struct("f", "b").alias("ls")), rest.select(F.col("node").alias("dst"), F.struct("f", "b").alias("lt"))
        left = settle(left.join(s, "src").join(t, "dst").filter("ls = lt").select("src", "dst"))
    if done is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    big = done.groupBy("component").agg(F.count("*").alias("_n")).filter("_n > 1").select("component")
    return done.join(big, "component", "left_semi").select("node", "component")


def _least_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, f, b): the smallest node that reaches each node along ``edges`` and the smallest it reaches, itself
    included; both ways in one pass a round. What reaches a node's label reaches the node too, so labels jump
    to their labels' labels, and a chain takes rounds in the logarithm of its length."""
    label = nodes.select("node", F.col("node").alias("f"), F.col("node").alias("b"))
    none = F.lit(None).cast(label.schema["node"].dataType)
    while True:
        ahead = edges.join(label, edges.src == label.node).select(F.col("dst").alias("node"), "f", none.alias("b"))
        back = edges.join(label, edges.dst == label.node).select(F.col("src").alias("node"), none.alias("f"), "b")
        near = ahead.unionAll(back).groupBy("node").agg(F.min("f").alias("nf"), F.min("b").alias("nb"))
        step = label.join(near, "node", "left").select("node", F.col("f").alias("wf"), F.col("b").alias("wb"), F.least("f", "nf").alias("lf"), F.least("b", "nb").alias("lb"))
        f, b = label.select(F.col("node").alias("lf"), F.col("f").alias("jf")), label.select(F.col("node").alias("lb"), F.col("b").alias("jb"))
        jumped = step.join(f, "lf", "left").join(b, "lb", "left")
        new = settle(jumped.select("node", F.least("lf", "jf").alias("f"), F.least("lb", "jb").alias("b"), (F.least("lf", "jf") < F.col("wf")).alias("cf"), (F.least("lb", "jb") < F.col("wb")).alias("cb")))
        if new.filter("cf OR cb").isEmpty():
            return new.select("node", "f", "b")
        label = new.select("node", "f", "b")


def cycles(components: DataFrame, limit: int = 20) -> DataFrame:
    """(component, size, members): largest first, members in order; as many as ``limit``."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(limit)
    return components.join(F.broadcast(sizes), "component").groupBy("component", "size").agg(F.array_sort(F.collect_list("node")).alias("members"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (src, target) with the file they mean, or null.

    ``files``: (path). A relative target is taken from the importer's directory and tried as it
    is, as a stem, then as a directory's index; a module name is tried as a path of dots, below
    src, lib and pkg as well. The first of these keys that a file has wins.
    """
    path = F.col("path")
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    keys = files.select("path", F.explode(F.array(
        F.struct(path.alias("key"), F.lit(1).alias("prio")), F.struct(bare.alias("key"), F.lit(2).alias("prio")),
        F.struct(F.regexp_replace(bare, "/(index|__init__)$", "").alias("key"), F.lit(3).alias("prio")),
        F.struct(F.replace(F.regexp_replace(bare, "^(src|lib|pkg)/", ""), F.lit("/"), F.lit(".")).alias("key"), F.lit(4).alias("prio")),
    )).alias("k")).select("path", "k.key", "k.prio").groupBy("key").agg(F.min_by("path", F.struct("prio", "path")).alias("resolved"), F.min("prio").alias("prio"))
    relative = F.col("target").startswith(".") & F.col("target").contains("/")
    wanted = imports.withColumn("key", F.when(relative, T.normal_path(F.concat(T.dirname("src"), F.lit("/"), "target"))).otherwise(F.regexp_replace("target", r"^\.+", "")))
    return wanted.join(keys, "key", "left").select("src", "target", "resolved")


def prefix_enrichment(files: DataFrame, terms: DataFrame) -> DataFrame:
    """Files (path, keywords) with the terms of all directories above them (dir, terms)."""
    spread = files.select("path", F.explode(T.path_prefixes("path")).alias("dir"))
    found = spread.join(terms.select("dir", "terms"), "dir").groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("more"))
    return files.join(found, "path", "left").select("path", F.when(F.col("more").isNull(), F.col("keywords")).otherwise(F.array_union("keywords", F.col("more"))).alias("keywords"))


def merge_incremental(old: DataFrame, new: DataFrame, key: str, hash_col: str) -> DataFrame:
    """Rows of ``new`` with what happened to them since ``old``: same, changed, added; and the
    removed ones."""
    o = old.select(key, F.col(hash_col).alias("_old"))
    both = o.join(new.select(key, F.col(hash_col).alias("_new")), key, "full_outer")
    return both.select(key, F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "same").otherwise("changed").alias("status"))


def have_lack(symbols: DataFrame, have: str, lack: str, scope: str = "") -> DataFrame:
    """Symbols (id, path, name, type, exported, keywords) that have one thing and lack another.

    A thing is ``exported``, a type, or a word held by the type or by any keyword.
    """

    def holds(word: str):
        w = word.lower()
        return (F.lit(w == "exported") & F.coalesce("exported", F.lit(False))) | F.coalesce(F.lower("type").contains(w), F.lit(False)) | F.coalesce(F.exists("keywords", lambda k: F.lower(k).contains(w)), F.lit(False))

    rows = symbols.filter(F.col("path").startswith(scope)) if scope else symbols
    return rows.filter(holds(have) & ~holds(lack))


def match_key(entries: DataFrame, key: str) -> DataFrame:
    """Entries (kind, key, role, file) of the exact key, else of keys that hold it."""
    exact = entries.filter(F.lower("key") == key.lower()).withColumn("prio", F.lit(0))
    part = entries.filter(F.lower("key").contains(key.lower()) & (F.lower("key") != key.lower())).withColumn("prio", F.lit(1))
    both = exact.unionByName(part)
    best = both.agg(F.min("prio").alias("best"))
    return both.join(F.broadcast(best), F.col("prio") == F.col("best")).drop("prio", "best")


def frames_to_files(frames: DataFrame, files: DataFrame) -> DataFrame:
    """Stack frames (seq, path, line) with their files (path): equal paths, or, where no frame of
    the trace has one, the shortest file path that ends in the frame's."""
    exact = frames.join(files.select(F.col("path"), F.col("path").alias("file")), "path")
    tails = files.select(F.col("path").alias("file"), F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), -1 * i, i), "/"))).alias("path"))
    ending = frames.join(tails, "path").groupBy("seq", "path", "line").agg(F.min_by("file", F.struct(F.length("file"), F.col("file"))).alias("file"))
    none = exact.agg((F.count("*") == 0).alias("_none"))
    return exact.select("seq", "path", "line", "file").unionByName(ending.join(F.broadcast(none)).filter("_none").select("seq", "path", "line", "file"))


def file_adjacency(edges: DataFrame, nodes: DataFrame, rels: list[str]) -> DataFrame:
    """(file, way, other): edges of some kinds between known nodes (id, path), as links of their files both ways
    (to, from), each once. Edges whose ends lie in one file link nothing."""
    of = nodes.select("id", "path").distinct()
    known = edges.filter(F.col("rel").isin(rels)).select("src", "dst").distinct()
    ends = known.join(of.select(F.col("id").alias("src"), F.col("path").alias("file")), "src").join(of.select(F.col("id").alias("dst"), F.col("path").alias("other")), "dst")
    links = ends.filter("file <> other").select("file", "other").distinct()
    return links.select("file", F.lit("to").alias("way"), "other").unionAll(links.select(F.col("other").alias("file"), F.lit("from"), F.col("file").alias("other")))


def frame_symbols(frames: DataFrame, symbols: DataFrame, first: int = 3) -> DataFrame:
    """(trace_id, symbol, line): symbols (id, line_start) that the first frames of each trace name by file and
    function; nameless functions name none. Without a line of its own a symbol has the frame's."""
    w = Window.partitionBy("trace_id").orderBy("seq")
    named = frames.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") <= first) & (F.col("function") != "") & ~F.col("function").isin("<module>", "<anonymous>", "main"))
    return named.withColumn("id", F.concat_ws("::", "path", "function")).join(symbols.select("id", "line_start"), "id").select("trace_id", F.col("id").alias("symbol"), F.coalesce("line_start", "line").alias("line"))


def changed_context(edges: DataFrame, changed: DataFrame, affected: int = 8, reads: int = 5) -> DataFrame:
    """(review, part, rank, file): what a review of changed files (review, file) is shown: the files most linked
    to them, and of these and of the changed ones (which come after them) the first to read."""
    c = changed.select("review", "file").distinct()
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = both.join(c, both.src == c.file).groupBy("review", F.col("dst").alias("other")).agg(F.count("*").alias("links"))
    near = near.join(c.select("review", F.col("file").alias("other")), ["review", "other"], "left_anti")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("review").orderBy(F.desc("links"), "other"))).filter(F.col("rank") <= affected)
    shown = ranked.select("review", F.lit("affected").alias("part"), "rank", F.col("other").alias("file"))
    queue = shown.select("review", F.lit(0).alias("_own"), "rank", "file").unionAll(c.select("review", F.lit(1), F.lit(0), "file"))
    first = queue.withColumn("_n", F.row_number().over(Window.partitionBy("review").orderBy("_own", "rank", "file"))).filter(F.col("_n") <= reads)
    return shown.unionAll(first.select("review", F.lit("read"), F.col("_n"), "file"))
