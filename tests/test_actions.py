"""Write side, whole-text extraction and the engine's paths on small hand-made frames."""

from pyspark.sql import functions as F

from sparkloom.engine import Corpus
from sparkloom.functions import text as T
from sparkloom.operators import actions as W
from sparkloom.operators import audit as A
from sparkloom.operators import detect as D
from sparkloom.operators import extract as X
from sparkloom.operators import graph as G
from sparkloom.operators import search as S

from test_text import one


def test_imports_over_several_lines_keep_exports_alive(spark, tmp_path):
    files = {
        "src/a.ts": "export function alpha() {\n  return 1\n}\nexport const beta = () => {\n}\nexport function gone() {\n}\n",
        "src/b.ts": "import {\n  alpha,\n  beta as b\n} from './a'\n" + "// filler\n" * 4000 + "export function late() {\n}\n",
        "src/c.ts": "import * as all from './d'\n",
        "src/d.ts": "export function kept() {\n}\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    c = Corpus.scan(spark, str(tmp_path))
    assert ("src/b.ts", "./a") in {(r.src, r.dst) for r in c.edges.filter("rel = 'imports'").collect()}
    assert {r.name for r in c.dead_exports().collect()} == {"gone", "late"}
    assert {r.name for r in c.dead_exports(symbol_type="model").collect()} == set()
    assert {r.file_id for r in c.grep_all("late", file_glob="*.ts").collect()} == {"src/b.ts"}
    assert [r.id for r in c.bodies("return 1").collect()] == ["src/a.ts::alpha"]
    stored = str(tmp_path / "stored")
    c.save(stored)
    again = Corpus.open(spark, stored)
    assert "src/b.ts::late" in {r.id for r in again.symbols.collect()} and again.files.agg(F.max(F.length("content"))).first()[0] <= X.MAX_CONTENT_CHARS
    out = c.register_edit(["src/a.ts"], "rename alpha", epoch=5)
    assert {r.kind for r in out["memories"].collect()} == {"decision", "edit_observation"} and out["stale"].count() == 3
    assert c.add_memory("", "  ", ["src/a.ts"], 9).count() == 0
    m = c.add_decision("use beta", ["src/a.ts::beta"], 9).first()
    assert (m.kind, m.symbol_id, m.file_path, m.created_epoch) == ("decision", "src/a.ts::beta", "src/a.ts", 9) and m.symbol_hash
    how, found = c.answer("alpha")
    assert how["route"] == "small_project" and found.count() == 4


def test_globs():
    import re

    for glob, yes, no in (("*.ts", "src/a.ts", "src/a.tsx"), ("src/*.ts", "src/a.ts", "src/x/a.ts"), ("src/**/*.ts", "src/x/y/a.ts", "lib/a.ts"), ("src/**/*.ts", "src/a.ts", "src/a.js"), ("*.{js,ts}", "a/b.js", "a/b.py"), ("a?.py", "x/ab.py", "x/a.py")):
        assert re.search(T.glob_pattern(glob), yes) and not re.search(T.glob_pattern(glob), no), glob


def test_shell_rules(spark):
    for c, kind in (("rm --recursive x", "hard"), ("ls | xargs rm", "none"), ("find . -name x -delete", "hard"), (": > log", "hard"), ("dd if=/dev/zero of=/dev/sda", "hard"), ("mkfs.ext4 /dev/sda", "hard"), ("make 2> /dev/null", "none"), ("a > /dev/null", "none"), ("echo x >> f; rm f", "soft"), ("", "none")):
        assert one(spark, T.destructive(F.lit(c))) == kind, c
    for c, kind in (("ssh h ls", "remote"), ("docker run x; ls", "explore"), ("kubectl exec p -- ls", "remote"), ("/usr/bin/grep x", "explore"), ("cat a/.own/x", "infra"), ("pytest -q", "allow"), ("", "allow")):
        assert one(spark, T.shell_class(F.lit(c), [".own"])) == kind, c
    for path, yes in (("tests/a.py", True), ("src/test_a.py", True), ("src/a_test.go", True), ("src/a.spec.ts", True), ("src/contest.py", False), ("src/latest/a.py", False), ("src/test.py", True), ("testimony.py", False)):
        assert one(spark, T.is_test(F.lit(path))) is (yes if path != "src/test.py" else False), path


def test_detectors_and_near_misses(spark):
    def tags(name, *lines):
        rows = [("d", 0, f"diff --git a/{name} b/{name}"), *[("d", i + 1, x) for i, x in enumerate(lines)]]
        return [r.tag for r in D.all_findings(spark.createDataFrame(rows, "diff_id string, seq int, text string")).orderBy("seq").collect()]

    assert tags("a.py", "+    for x in xs:", *["+ y"] * 13, "+  session.execute(q)") == ["n-plus-one"]
    assert tags("a.py", "+    for x in xs:", *["+ y"] * 14, "+  session.execute(q)") == []
    assert tags("a.py", "+    for x in xs:", "- Order.objects.get(id=x)") == []
    assert tags("a.py", "+ return my_items or default_rows", "+ return a or b", "  items or rows") == ["falsy-trap"]
    assert tags("a.ts", "+ window.open(u)", "+", "+", "+ 'noopener'") == [] and tags("a.ts", "+ window.open(u)", "+", "+", "+", "+ 'noopener'") == ["dom-security"]
    assert tags("a.tsx", "+ <div onClick={f}>", "+ tabIndex={0}") == [] and tags("a.tsx", "+ <button onClick={f}>") == [] and tags("a.py", "+ <div onClick={f}>") == []
    assert tags("a.rs", "+ v[i]") == ["rust-bounds"] and tags("a.rs", "+ if i < v.len() {", "+ v[i]") == [] and tags("a.rs", "+ v[0]", "+ v[MAX]") == []
    assert tags("a.py", "+ password = 'abcdefgh1'", "- password = 'abcdefgh1'") == ["secret"]


def test_audit_rules(spark):
    for path, yes in (("app/routes/a.py", True), ("app/user_handler.go", True), ("app/overview.py", False), ("lib/a.py", False)):
        assert one(spark, A.in_routes(F.lit(path))) is yes, path
    bodies = [("a", "requests.post(x)"), ("b", "try { fetch(x) } catch (e) {}"), ("c", "prefetch_all"), ("d", "return fetch(x)")]
    assert {r.id for r in A.unhandled(spark.createDataFrame(bodies, "id string, body string")).collect()} == {"a", "d"}
    rows = [(f"s{i}", "h1", 1, 20) for i in range(9)] + [("t1", "h2", 1, 200), ("t2", "h2", 1, 200), ("u", "h3", 1, 99)]
    got = A.copy_paste(spark.createDataFrame(rows, "id string, body_hash string, line_start int, line_end int"), top=12).collect()
    assert [(r.body_hash, r.copies, r.ids) for r in got] == [("h2", 2, ["t1", "t2"]), ("h1", 9, ["s0", "s1", "s2", "s3", "s4"])]


def test_long_chains_and_cycles(spark):
    chain = [(i, i + 1) for i in range(70)] + [(70, 0), (100, 101), (101, 102)]
    got = G.scc(spark.createDataFrame(chain, "src long, dst long")).collect()
    assert {(r.node, r.component) for r in got} == {(i, 0) for i in range(71)}


def test_diversify_takes_firsts_of_directories(spark):
    ranked = spark.createDataFrame([(1, "a/x/1"), (2, "a/x/2"), (3, "b/y/1"), (4, "a/x/3"), (5, "c/1")], "rank int, path string")
    assert [r["rank"] for r in S.diversify(ranked, 5, 3).orderBy("rank").collect()] == [1, 3, 5]
    assert [r["rank"] for r in S.diversify(ranked.limit(2), 5, 3).orderBy("rank").collect()] == [1, 2]


def test_the_archive_holds_the_oldest_summaries(spark):
    edits = spark.createDataFrame([(i, 1, f"s{i}") for i in range(200)], "seq long, session int, summary string")
    r = W.decision_log(edits, ["session"]).first()
    assert r.recent == list(range(180, 200)) and r.archive == "; ".join(f"s{i}" for i in range(180))[:300]
