"""From files to symbols, imports and stack frames: one table of patterns, applied to lines.

A pattern belongs to a family of languages and matches a whole declaration line, so extraction
is a filter and a regular expression over ``lines``; ends of bodies come from a window that
counts braces, or from indentation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MAX_FILE_BYTES, MAX_CONTENT_CHARS, MAX_BODY_LINES = 300_000, 24_000, 400
SKIP_DIRS = [".git", "node_modules", "dist", "build", "venv", ".venv", "__pycache__", "target", "vendor", ".next", "coverage"]
SCAN_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".swift", ".rs", ".c", ".cc", ".cpp", ".cxx", ".h", ".hpp", ".hh", ".hxx", ".json", ".md", ".yaml", ".yml"]
LANGUAGE = {".py": "python", ".ts": "js", ".tsx": "js", ".js": "js", ".jsx": "js", ".go": "go", ".rs": "rust", ".c": "cpp", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".h": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".php": "php", ".swift": "swift"}

#: (language, kind, pattern whose group 1 is the name, exported pattern or None for always)
SYMBOL_PATTERNS = [
    ("js", "api_route", r"^\s*export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE)\b", None),
    ("js", "utility", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+([A-Za-z_$][\w$]*)", r"^\s*export\b"),
    ("js", "utility", r"^\s*(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>", r"^\s*export\b"),
    ("js", "model", r"^\s*(?:export\s+)?(?:interface|type)\s+([A-Za-z_$][\w$]*)", r"^\s*export\b"),
    ("js", "use_case", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)", r"^\s*export\b"),
    ("js", "model", r"^\s*(?:export\s+)?const\s+(\w*[Ss]chema)\s*=", r"^\s*export\b"),
    ("python", "utility", r"^(?:async\s+)?def\s+([A-Za-z]\w*)\s*\(", None),
    ("python", "use_case", r"^class\s+([A-Za-z]\w*)", None),
    ("go", "utility", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*[\[(]", r"^func\s+(?:\([^)]*\)\s*)?[A-Z]"),
    ("go", "model", r"^type\s+([A-Za-z_]\w*)\s+struct\b", r"^type\s+[A-Z]"),
    ("go", "model", r"^type\s+([A-Za-z_]\w*)\s+interface\b", r"^type\s+[A-Z]"),
    ("rust", "utility", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)", r"^\s*pub\b"),
    ("rust", "model", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|type)\s+(\w+)", r"^\s*pub\b"),
    ("rust", "utility", r"^\s*macro_rules!\s+(\w+)", None),
    ("rust", "utility", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+([A-Z_][A-Z0-9_]*)\s*:", r"^\s*pub\b"),
    ("cpp", "model", r"^\s*(?:class|struct|enum(?:\s+class)?)\s+(\w+)\s*(?:final\s*)?[:{]", None),
    ("cpp", "utility", r"^(?:[A-Za-z_][\w:<>,*&\s]*\s+[*&]?)([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:const\s*)?\{", None),
    ("cpp", "model", r"^\s*typedef\s+.*\b(\w+)\s*;", None),
    ("cpp", "utility", r"^\s*#define\s+([A-Za-z]\w*)\s*\(", None),
    ("php", "utility", r"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*function\s+(\w+)", None),
    ("php", "model", r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait|enum)\s+(\w+)", None),
]
#: (language, relation, pattern of a statement over whole texts, pattern of its targets in group 1)
IMPORT_PATTERNS = [
    ("js", "imports", r"\bimport\s+(?:[\w$*{][^'\";]*?\sfrom\s*)?['\"][^'\"\n]+['\"]", r"['\"]([^'\"\n]+)['\"]$"),
    ("js", "imports", r"\bexport\s+(?:type\s+)?[*{][^'\";]*?\sfrom\s*['\"][^'\"\n]+['\"]", r"['\"]([^'\"\n]+)['\"]$"),
    ("js", "requires", r"\brequire\(\s*['\"][^'\"\n]+['\"]\s*\)", r"['\"]([^'\"]+)['\"]"),
    ("python", "imports", r"(?m)^[ \t]*from\s+[.\w]+\s+import\b", r"from\s+([.\w]+)"),
    ("python", "imports", r"(?m)^[ \t]*import\s+[\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*", r"(?:import|,)\s*([\w.]+)"),
    ("go", "imports", r"(?m)^import\s*(?:\([^)]*\)|(?:[\w.]+\s+)?\"[^\"\n]+\")", r"\"([^\"\n]+)\""),
    ("rust", "imports", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+[\w:]*\w", r"use\s+([\w:]+)$"),
    ("rust", "imports", r"(?m)^[ \t]*extern\s+crate\s+\w+", r"crate\s+(\w+)"),
    ("cpp", "imports", r"(?m)^[ \t]*#\s*include\s*[<\"][^>\"\n]+[>\"]", r"[<\"]([^>\"]+)[>\"]"),
    ("swift", "imports", r"(?m)^[ \t]*import\s+\w+", r"import\s+(\w+)"),
]
FRAME_PATTERNS = [
    ("python", r"File \"([^\"]+)\", line (\d+), in (\S+)"), ("js", r"at (?:[^(]*\()?((?:[A-Za-z]:)?[^():\s]+):(\d+):\d+\)?()"), ("go", r"^\s+(\S+\.go):(\d+)()"), ("generic", r"([\w./\-]+\.\w{1,5}):(\d+)()"),
]


def scannable(path, skip: list[str] | None = None) -> F.Column:
    """Whether a path is read at all: a known suffix and no skipped directory."""
    return T.suffix(path).isin(SCAN_SUFFIXES) & ~F.arrays_overlap(F.split(T.col(path), "/"), F.array(*map(F.lit, SKIP_DIRS if skip is None else skip)).cast("array<string>"))


def language(path) -> F.Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGE.items() for x in pair]), T.suffix(path))


def lines_of(files: DataFrame) -> DataFrame:
    """(path, lang, line_no from 1, text)."""
    return files.select("path", language("path").alias("lang"), F.posexplode(T.text_lines("content")).alias("p", "text")).select("path", "lang", (F.col("p") + 1).alias("line_no"), "text")


def declarations(lines: DataFrame) -> DataFrame:
    """(path, lang, line_no, name, symbol_type, exported): the first pattern that a line matches."""
    found = F.lit(None).cast("struct<name:string,symbol_type:string,exported:boolean>")
    for lang, kind, pattern, exported in reversed(SYMBOL_PATTERNS):
        is_out = F.col("text").rlike(exported) if exported else F.lit(True)
        value = F.struct(F.regexp_extract("text", pattern, 1).alias("name"), F.lit(kind).alias("symbol_type"), is_out.alias("exported"))
        found = F.when((F.col("lang") == lang) & F.col("text").rlike(pattern), value).otherwise(found)
    rows = lines.withColumn("f", found).filter("f IS NOT NULL").select("path", "lang", "line_no", "f.*")
    private = (F.col("lang") == "python") & F.col("name").rlike("^(_|test_)")
    return rows.filter(~private)


def block_ends(files: DataFrame, lines: DataFrame, decls: DataFrame) -> DataFrame:
    """Declarations with line_end. Braces: the first line from the declaration on where as many
    have closed as opened, at most 400 lines on, found by a fold over those lines of the file's
    own array; else 100 lines on. Python: the line before the next one that begins at the left margin."""
    text = files.select("path", T.text_lines("content").alias("_ls"))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("open"), F.lit(None).cast("int").alias("end"))

    def step(acc, line):
        opens = F.regexp_count(line, F.lit(r"\{"))
        depth, opened = acc.depth + opens - F.regexp_count(line, F.lit(r"\}")), acc.open | (opens > 0)
        end = F.when(opened & (depth <= 0), acc.i)
        return F.when(acc.end.isNotNull(), acc).otherwise(F.struct((acc.i + 1).alias("i"), depth.alias("depth"), opened.alias("open"), end.alias("end")))

    margin = lines.filter((F.col("lang") == "python") & F.col("text").rlike(r"^[^\s#)\]}]"))
    after = margin.select("path", "line_no", (F.lead("line_no").over(Window.partitionBy("path").orderBy("line_no")) - 1).alias("_next"))
    rows = decls.join(after, ["path", "line_no"], "left").join(text, "path")
    braces = F.col("line_no") + F.reduce(F.slice("_ls", F.col("line_no"), F.lit(MAX_BODY_LINES)), start, step).getField("end")
    last = F.size("_ls")
    end = F.when(F.col("lang") == "python", F.coalesce("_next", last)).otherwise(F.coalesce(braces, F.least(last, F.col("line_no") + 100)))
    return rows.withColumn("line_end", end.cast("int")).withColumn("body_hash", T.body_hash(F.array_join(F.slice("_ls", F.col("line_no"), F.col("line_end") - F.col("line_no") + 1), "\n"))).drop("_ls", "_next")


def symbols(files: DataFrame) -> DataFrame:
    """(id, path, name, symbol_type, exported, line_start, line_end, body_hash) of every file; a name
    declared twice in a file is its first declaration."""
    lines = lines_of(files)
    found = declarations(lines)
    once = found.withColumn("_n", F.row_number().over(Window.partitionBy("path", "name").orderBy("line_no"))).filter("_n = 1").drop("_n")
    return block_ends(files, lines, once).select(F.concat_ws("::", "path", "name").alias("id"), "path", "name", "symbol_type", "exported", F.col("line_no").alias("line_start"), "line_end", "body_hash")


def imports(files: DataFrame) -> DataFrame:
    """(src, dst, rel): import targets as written, each once a file. Statements may span lines, so they
    are looked for in whole texts, all patterns in one pass."""
    none = F.array().cast("array<struct<dst:string,rel:string>>")
    found = []
    for lang, rel, statement, target in IMPORT_PATTERNS:
        targets = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(statement), F.lit(0)), lambda s: F.regexp_extract_all(s, F.lit(target), F.lit(1))))  # noqa: B023
        found.append(F.when(F.col("_lang") == lang, F.transform(targets, lambda t: F.struct(t.alias("dst"), F.lit(rel).alias("rel")))).otherwise(none))  # noqa: B023
    rows = files.withColumn("_lang", language("path")).filter("content IS NOT NULL").select(F.col("path").alias("src"), F.explode(F.concat(*found)).alias("x"))
    return rows.select("src", "x.dst", "x.rel").filter("dst <> ''").distinct()


def imported_names(files: DataFrame) -> DataFrame:
    """(src, name): names that files import from elsewhere or hand on, over whole texts."""
    rows = files.withColumn("_lang", language("path")).filter("content IS NOT NULL")
    js = F.regexp_extract_all("content", F.lit(r"\b(?:import|export)\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from\b"), F.lit(1))
    py = F.concat(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*from\s+[.\w]+\s+import\s*\(([^)]*)\)"), F.lit(1)), F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*from\s+[.\w]+\s+import[ \t]+([^\n(]+)"), F.lit(1)))
    lists = F.when(F.col("_lang") == "js", js).when(F.col("_lang") == "python", py)
    part = rows.select(F.col("path").alias("src"), F.explode(lists).alias("list"))
    each = part.select("src", F.explode(F.split(F.regexp_replace("list", r"(#|//)[^\n]*|\\", " "), ",")).alias("n"))
    name = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace("n", r"\s+", " ")), r" as .*$", ""), "^type ", ""))
    return each.select("src", name.alias("name")).filter("name <> '' AND name <> '*'").distinct()


def wildcard_imports(files: DataFrame) -> DataFrame:
    """(src, target): modules that files import whole, so that any of their names may be used."""
    rows = files.withColumn("_lang", language("path")).filter("content IS NOT NULL")
    js = F.regexp_extract_all("content", F.lit(r"\b(?:import|export)\s*\*\s*(?:as\s+[\w$]+\s+)?from\s*['\"]([^'\"\n]+)['\"]"), F.lit(1))
    py = F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*from\s+([.\w]+)\s+import\s*\*"), F.lit(1))
    return rows.select(F.col("path").alias("src"), F.explode(F.when(F.col("_lang") == "js", js).when(F.col("_lang") == "python", py)).alias("target")).distinct()


def references(lines: DataFrame) -> DataFrame:
    """(src, dst, rel): path-like words with a slash and an extension in quotes."""
    found = lines.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(r"['\"`]([\w@.\-]+(?:/[\w@.\-]+)+\.\w+)['\"`]"), F.lit(1))).alias("dst"))
    return found.filter(T.is_local_file("dst")).distinct().withColumn("rel", F.lit("references"))


def edges(files: DataFrame) -> DataFrame:
    """Imports, references and contained symbols, each (src, dst, rel) once."""
    contains = symbols(files).select(F.col("path").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("rel"))
    return imports(files).unionByName(references(lines_of(files))).unionByName(contains).distinct()


def frames(traces: DataFrame) -> DataFrame:
    """(trace_id, seq, language, path, line, function): frames of stack traces (trace_id, text), each
    file once, in order. The generic pattern counts only where no other finds a frame."""
    lines = traces.select("trace_id", F.posexplode(T.text_lines("text")).alias("seq", "line_text"))
    rows = None
    for lang, p in FRAME_PATTERNS:
        part = lines.filter(F.col("line_text").rlike(p)).select("trace_id", "seq", F.lit(lang).alias("language"), F.regexp_extract("line_text", p, 1).alias("path"), F.regexp_extract("line_text", p, 2).cast("int").alias("line"), F.regexp_extract("line_text", p, 3).alias("function"))
        rows = part if rows is None else rows.unionByName(part)
    known = rows.withColumn("_known", F.max((F.col("language") != "generic").cast("int")).over(Window.partitionBy("trace_id")))
    kept = known.filter((F.col("_known") == 0) | (F.col("language") != "generic"))
    w = Window.partitionBy("trace_id", "path").orderBy("seq", "language")
    return kept.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_known")


def headings(files: DataFrame) -> DataFrame:
    """(path, line_no, level, title, line_end): Markdown sections, each up to the next heading of its
    level or above."""
    lines = files.filter(T.suffix("path") == ".md").select("path", F.posexplode(T.text_lines("content")).alias("p", "text")).select("path", (F.col("p") + 1).alias("line_no"), "text")
    h = lines.filter(F.col("text").rlike(r"^#{1,6}\s+\S")).select("path", "line_no", F.length(F.regexp_extract("text", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("text", "^#+", "")).alias("title"))
    last = lines.groupBy("path").agg(F.max("line_no").alias("last"))
    after = h.select(F.col("path").alias("p2"), F.col("line_no").alias("n2"), F.col("level").alias("l2"))
    cond = (F.col("p2") == F.col("path")) & (F.col("n2") > F.col("line_no")) & (F.col("l2") <= F.col("level"))
    return h.join(after, cond, "left").groupBy("path", "line_no", "level", "title").agg(F.min("n2").alias("next")).join(last, "path").select("path", "line_no", "level", "title", F.coalesce(F.col("next") - 1, F.col("last")).alias("line_end"))


def directory_terms(files: DataFrame) -> DataFrame:
    """(dir, terms): words of Markdown headings for the directories their sections mention."""
    lines = files.filter(T.suffix("path") == ".md").select("path", F.posexplode(T.text_lines("content")).alias("p", "text")).select("path", (F.col("p") + 1).alias("line_no"), "text")
    mention = lines.select("path", "line_no", F.explode(F.regexp_extract_all("text", F.lit(r"((?:[\w.\-]+/)+)[\w.\-]*"), F.lit(1))).alias("d")).select("path", "line_no", F.rtrim(F.col("d")).alias("d"))
    sections = headings(files).select(F.col("path").alias("p2"), F.col("line_no").alias("a"), F.col("line_end").alias("b"), "title")
    words = mention.join(sections, (F.col("path") == F.col("p2")) & F.col("line_no").between(F.col("a"), F.col("b"))).select(F.regexp_replace("d", "/$", "").alias("dir"), F.explode(T.query_terms("title")).alias("term"))
    return words.groupBy("dir").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def keywords(name, text) -> F.Column:
    """Words that describe a file: its name's and its declarations', distinct, at most eighty."""
    declared = F.regexp_extract_all(T.col(text), F.lit(r"(?:def|class|function|func|fn|struct|interface|type|const)\s+([A-Za-z_]\w*)"), F.lit(1))
    routes = F.regexp_extract_all(T.col(text), F.lit(r"['\"](/[a-z][\w/\-]*)['\"]"), F.lit(1))
    parts = F.flatten(F.transform(declared, lambda d: F.concat(F.array(F.lower(d)), T.camel_parts(d))))
    segments = F.filter(F.flatten(F.transform(routes, lambda r: F.split(r, "/"))), lambda s: F.length(s) >= 3)
    return F.slice(F.array_distinct(F.concat(T.name_keywords(name), parts, segments)), 1, 80)


def summary(path, text) -> F.Column:
    """One line about a file: its leading comment or doc string, then up to five declared names."""
    lead = F.trim(F.regexp_extract(T.col(text), r"(?s)^\s*(?:\"\"\"|'''|/\*+|//|#)\s*(.*?)(?:\"\"\"|'''|\*/|\n)", 1))
    names = F.array_join(F.slice(F.regexp_extract_all(T.col(text), F.lit(r"(?:def|class|function|func|fn|struct)\s+([A-Za-z_]\w*)"), F.lit(1)), 1, 5), ", ")
    return F.left(F.concat_ws(" | ", F.nullif(lead, F.lit("")), F.nullif(names, F.lit("")), T.dirname(path)), F.lit(250))
