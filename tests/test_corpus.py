"""A small source tree in six languages, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sparkloom.engine import Corpus
from sparkloom.operators import detect as D
from sparkloom.operators import extract as X
from sparkloom.operators import policy as P
from sparkloom.operators import usage as U
from sparkloom.sources import corpus as C

TREE = {
    "src/a.ts": "// entry of the app\nimport { helper } from './b'\n\nexport function main(x: number) {\n  if (x) {\n    return helper(x)\n  }\n}\n\nexport function unused() {\n  return fetch('http://x')\n}\n",
    "src/b.ts": "import { main } from './a'\nexport const helper = (y) => {\n  return y\n}\nexport class Box {\n}\n",
    "src/c.py": "from d import load\nimport os\n\n\ndef first(a):\n    return load(a)\n\n\nclass Model:\n    def inner(self):\n        return 1\n\n\ndef _hidden():\n    pass\n",
    "src/d.py": "def load(a):\n    # TODO: later, with care\n    return a\n",
    "tests/test_d.py": "from d import load\n",
    "pkg/e.go": "package e\n\nimport \"fmt\"\n\nfunc Run(n int) {\n\tfmt.Println(n)\n}\n\ntype Thing struct {\n\tA int\n}\n",
    "pkg/f.rs": "use std::fs;\n\npub fn go() {\n    let x = 1;\n}\n\nstruct Hidden;\n",
    "pkg/g.h": "#include <stdio.h>\n#include \"f.h\"\n\nclass Shape {\n};\n",
    "docs/guide.md": "# Payments\nsee src/pay/core.ts\n\n## Ledger\nnothing\n\n# Other\n",
    "node_modules/x.js": "export function skipped() {}\n",
    "notes.txt": "no code",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "src/bytes.py").write_bytes(b"def ok():\n    return '\xff'\n")
    (root / "src/huge.py").write_text("#" * 300_001)
    return str(root)


@pytest.fixture(scope="module")
def corpus(spark, tree):
    return Corpus.scan(spark, tree)


def test_files_are_pruned_and_decoded(corpus):
    found = {r.path: r.content for r in corpus.files.collect()}
    assert set(found) == (set(TREE) - {"node_modules/x.js", "notes.txt"}) | {"src/bytes.py"}
    assert found["src/bytes.py"] == "def ok():\n    return ''\n"


def test_symbols(corpus):
    got = {r.id: (r.symbol_type, r.exported, r.line_start, r.line_end) for r in corpus.symbols.collect()}
    assert got["src/a.ts::main"] == ("utility", True, 4, 8)
    assert got["src/b.ts::helper"] == ("utility", True, 2, 4)
    assert got["src/b.ts::Box"] == ("use_case", True, 5, 6)
    assert got["src/c.py::first"][2:] == (5, 8) and got["src/c.py::Model"][2:] == (9, 13)
    assert got["pkg/e.go::Run"] == ("utility", True, 5, 7) and got["pkg/e.go::Thing"][0] == "model"
    assert got["pkg/f.rs::go"][1] is True and got["pkg/f.rs::Hidden"][1] is False
    assert got["pkg/g.h::Shape"][0] == "model"
    assert "src/c.py::_hidden" not in got


def test_edges(corpus):
    got = {(r.src, r.dst, r.rel) for r in corpus.edges.collect()}
    assert {("src/a.ts", "./b", "imports"), ("src/c.py", "d", "imports"), ("src/c.py", "os", "imports"), ("pkg/e.go", "fmt", "imports"), ("pkg/f.rs", "std::fs", "imports"), ("pkg/g.h", "stdio.h", "imports"), ("src/a.ts", "src/a.ts::main", "contains")} <= got
    assert len(got) == corpus.edges.count()


def test_cycles_dead_exports_and_audit(corpus):
    assert [r.members for r in corpus.find_cycles().collect()] == [["src/a.ts", "src/b.ts"]]
    dead = {r.id for r in corpus.dead_exports().collect()}
    assert "src/a.ts::unused" in dead and "src/b.ts::helper" not in dead and "src/d.py::load" not in dead
    audit = corpus.audit()
    assert [(r.file_id, r.line_no) for r in audit["todos"].collect()] == [("src/d.py", 2)]
    assert "src/d.py" not in {r.path for r in audit["untested"].collect()}


def test_grep_knows_its_symbol(corpus):
    assert [(r.file_id, r.line_no, r.symbol) for r in corpus.grep("helper\\(x").collect()] == [("src/a.ts", 6, "src/a.ts::main")]


def test_read_modes(corpus):
    assert corpus.read("src/a.ts::main").first().text.startswith("export function main")
    assert corpus.read("src/a.ts", 20, anchor="UNUSED").first().mode == "anchor_excerpt"
    assert corpus.read("src/a.ts", 20, anchor="zzz").first().mode == "anchor_fallback_head"
    assert "helper" in corpus.read("src/a.ts", query="where is helper").first().text
    assert corpus.read("src/d.py").first().mode == "full"


def test_retrieval_and_debug(corpus):
    assert corpus.retrieve("ledger payments guide").first().doc_id == "docs/guide.md"
    how, found = corpus.answer("audit all places of helper")
    assert how["route"] == "exhaustive_map" and found.count() == 1
    trace = 'Traceback (most recent call last):\n  File "src/c.py", line 6, in first\n  File "src/d.py", line 3, in load\nValueError'
    assert {r.node for r in corpus.debug(trace).collect()} >= {"src/c.py", "src/d.py"}


def test_frames_name_symbols_and_files_link_both_ways(corpus):
    trace = 'Traceback\n  File "src/c.py", line 6, in first\n  File "src/d.py", line 3, in load\n  File "src/gone.py", line 1, in load\n'
    assert {(r.symbol, r.line) for r in corpus.root_causes(trace).collect()} == {("src/c.py::first", 5), ("src/d.py::load", 1)}
    links = {tuple(r) for r in corpus.adjacency().collect()}
    assert {("src/a.ts", "to", "src/b.ts"), ("src/a.ts", "from", "src/b.ts"), ("src/c.py", "to", "src/d.py"), ("src/d.py", "from", "src/c.py")} <= links
    shown = {(r.part, r["rank"], r.file) for r in corpus.changed_context(["src/a.ts"]).collect()}
    assert shown == {("affected", 1, "src/b.ts"), ("read", 1, "src/b.ts"), ("read", 2, "src/a.ts")}


def test_references_are_registered_while_valid(spark, corpus, tree):
    known = spark.createDataFrame([("x/old.py", 10), ("x/kept.py", 90_000), ("src/d.py", 90_000)], "ref string, created_epoch long")
    got = {r.ref: r.created_epoch for r in corpus.register(known, corpus.cross_search(tree, "def load"), 100_000).collect()}
    assert got == {"x/kept.py": 90_000, "src/d.py": 100_000}


def test_report_and_rows(spark, tmp_path):
    rows = spark.createDataFrame([(2, "a|b\nc", None), (1, None, 0.5)], "id int, text string, x double")
    C.write_report({"found": rows, "nothing": rows.limit(0)}, str(tmp_path / "r"))
    back = C.read_rows(spark, str(tmp_path / "r" / "found"), rows.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    report = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r" / "report")).collect())
    assert "## found\n\n2 rows\n\n| id | text | x |\n|-|-|-|\n| 1 |  | 0.5 |\n| 2 | a\\|b c |  |" in report and "## nothing\n\n0 rows" in report


def test_budgets_and_months(spark):
    rows = spark.createDataFrame([("targeted", 120_000, 14), ("exhaustive", 120_000, 14), ("new", 200_000, 8), (None, 0, 0)], "task string, chars long, turns int")
    got = [tuple(r.x) for r in rows.select(P.spent(F.col("chars"), F.col("turns"), F.col("task")).alias("x")).collect()]
    assert got == [("warning", "limit"), ("none", "none"), ("limit", "warning"), ("none", "none")]
    days = spark.createDataFrame([("2024-02-01 00:00:00",), ("2024-01-31 23:59:59",), ("2024-02-10 12:00:00",), ("2024-02-10 12:00:01",), (None,)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert [str(r.t) for r in days.filter(U.month_to_date("t", "2024-02-10 12:00:00")).collect()] == ["2024-02-01 00:00:00", "2024-02-10 12:00:00"]


def test_store_round_trip(spark, corpus, tmp_path):
    corpus.save(str(tmp_path / "graph"))
    again = Corpus.open(spark, str(tmp_path / "graph"))
    assert again.symbols.count() == corpus.symbols.count() and again.edges.count() == corpus.edges.count()


def test_headings_and_directory_terms(corpus):
    assert [(r.title, r.line_no, r.line_end) for r in X.headings(corpus.files).orderBy("line_no").collect()] == [("Payments", 1, 6), ("Ledger", 4, 6), ("Other", 7, 7)]
    assert [(r.dir, r.terms) for r in X.directory_terms(corpus.files).collect()] == [("src/pay", ["payments"])]


def test_frames(spark):
    t = spark.createDataFrame([(0, 'File "a.py", line 3, in f\nFile "a.py", line 9, in g'), (1, "  at run (src/x.ts:10:5)\n  at y (src/z.js:2:1)"), (2, "panic\n\tmain.go:7 +0x1"), (3, "oops at conf.yml:4")], "trace_id int, text string")
    got = [(r.trace_id, r.language, r.path, r.line) for r in X.frames(t).orderBy("trace_id", "seq").collect()]
    assert got == [(0, "python", "a.py", 3), (1, "js", "src/x.ts", 10), (1, "js", "src/z.js", 2), (2, "go", "main.go", 7), (3, "generic", "conf.yml", 4)]


def diff(spark, lines):
    return spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "diff_id int, seq int, text string")


def tags(spark, lines):
    return sorted((r.tag, r.seq) for r in D.all_findings(diff(spark, lines)).collect())


def test_detectors_and_near_misses(spark):
    py, rs, tsx = "diff --git a/x.py b/x.py", "diff --git a/x.rs b/x.rs", "diff --git a/x.tsx b/x.tsx"
    assert tags(spark, [py, "+    for u in users:", "+        Order.objects.get(id=u)"]) == [("n-plus-one", 1)]
    assert tags(spark, [py, "+    for u in users:", *["+ pass"] * 14, "+ q.filter(x)"]) == []
    assert tags(spark, [py, "+ return rows or items"]) == [("falsy-trap", 1)]
    assert tags(spark, [py, "+ return rows or other"]) == []
    assert tags(spark, [tsx, "+ window.open(url)"]) == [("dom-security", 1)]
    assert tags(spark, [tsx, "+ window.open(", "+  url,", "+ 'noopener')"]) == []
    assert tags(spark, [tsx, "+ <div onClick={f}>"]) == [("a11y", 1)]
    assert tags(spark, [tsx, "+ <div onClick={f}", "+ onKeyDown={g}>"]) == [] and tags(spark, [tsx, "+ <button onClick={f}>"]) == []
    assert tags(spark, [rs, "+ let y = v[i];"]) == [("rust-bounds", 1)]
    assert tags(spark, [rs, "+ if i < v.len() {", "+ let y = v[i];"]) == [] and tags(spark, [rs, "+ let y = v[0];"]) == []
    assert tags(spark, [py, "+ password = 'abcdefgh1'"]) == [("secret", 1)] and tags(spark, [py, "- password = 'abcdefgh1'"]) == []


def test_diff_parse_keeps_the_tail(spark):
    parsed = D.parse(diff(spark, ["diff --git a/x b/x", *[f"+{i}" for i in range(130)], "diff --git a/y b/y", "+z"]), tail=120)
    n = {r.file: r["count"] for r in parsed.groupBy("file").count().collect()}
    assert n == {"x": 120, "y": 2}


def test_log_skips_malformed_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"tool":"graph_read","turn":1,"payload":{"mode":"full"}}\n\nnot json\n{"tool":"x","turn":2,"payload":{}}\n')
    assert sorted(r.tool for r in C.read_tool_log(spark, str(tmp_path / "log.jsonl")).collect()) == ["graph_read", "x"]


def test_transcripts(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"type":"assistant","sessionId":"s","project":"/P","timestamp":"1","usage":{"input_tokens":3}}\n{"type":"user","sessionId":"s","usage":{"input_tokens":9}}\n{"type":"assistant","sessionId":"s2","project":"/p","timestamp":"2","usage":{"input_tokens":4,"output_tokens":1}}\n')
    t = C.read_transcripts(spark, str(tmp_path / "t.jsonl"))
    assert {r.sessionId: (r.input_tokens, r.output_tokens) for r in C.transcript_usage(t).collect()} == {"s": (3, 0), "s2": (4, 1)}
    assert C.last_session(t, "/p").first().sessionId == "s2"


def test_refresh_equals_a_new_scan(spark):
    from sparkloom.sources import history as H

    cols = "path string, content string, file_hash string"
    old = spark.createDataFrame([("a.py", "def f():\n    pass\n", "1"), ("b.py", "import a\n", "2"), ("c.py", "import b\n", "3")], cols)
    new = spark.createDataFrame([("a.py", "def g():\n    pass\n", "9"), ("b.py", "import a\n", "2"), ("d.py", "import d\n", "4")], cols)
    store = {"files": old, "symbols": X.symbols(old), "edges": X.edges(old)}
    changed = H.changed_files(old, new)
    assert sorted(r.path for r in changed.collect()) == ["a.py", "d.py"]
    got = H.refresh(store, changed, spark.createDataFrame([("c.py",)], "path string"))
    assert sorted(map(str, got["edges"].collect())) == sorted(map(str, X.edges(new).collect()))
    assert sorted(r.id for r in got["symbols"].collect()) == sorted(r.id for r in X.symbols(new).collect()) == ["a.py::g"]


def test_history(spark):
    from sparkloom.sources import history as H

    c = spark.sql("SELECT 'a' path, 'x' author, timestamp'2024-01-01' ts UNION ALL SELECT 'a', 'y', timestamp'2024-03-01' UNION ALL SELECT 'b', 'z', timestamp'2023-01-01'")
    assert [r.path for r in H.recently_changed(c, "2024-03-10").collect()] == ["a"]
    assert {r.path: r.author for r in H.last_author(c).collect()} == {"a": "y", "b": "z"}
