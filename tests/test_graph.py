from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.operators import graph as G


def edges(spark, pairs):
    return spark.createDataFrame(pairs or [], "src int, dst int")


def closure(pairs):
    nodes = {x for p in pairs for x in p}
    reach = set(pairs)
    for k, i, j in product(sorted(nodes), repeat=3):
        if (i, k) in reach and (k, j) in reach:
            reach.add((i, j))
    return nodes, reach


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=14))
def test_components_are_mutual_reachability(spark, pairs):
    got = {r.node: r.component for r in G.scc(edges(spark, pairs)).collect()}
    nodes, reach = closure([p for p in pairs if p[0] != p[1]])
    want = {}
    for n in nodes:
        group = {n} | {m for m in nodes if (n, m) in reach and (m, n) in reach}
        if len(group) > 1:
            want[n] = min(group)
    assert got == want


def test_cycles_are_listed_largest_first(spark):
    e = edges(spark, [(1, 2), (2, 1), (3, 4), (4, 5), (5, 3), (5, 6)])
    assert [(r.component, r["size"], r.members) for r in G.cycles(G.scc(e)).orderBy("component").collect()] == [(1, 2, [1, 2]), (3, 3, [3, 4, 5])]


def test_bfs_hops_and_radius(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (9, 4)])
    seeds = spark.createDataFrame([(1,)], "node int")
    assert {r.node: r.hop for r in G.bfs(e, seeds, 2).collect()} == {1: 0, 2: 1, 3: 2}
    assert {r.node: r.hop for r in G.bfs(e, seeds, 9).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 9: 4}
    assert {r.node for r in G.bfs(e, spark.createDataFrame([(4,)], "node int"), 5, directed=True).collect()} == {4}


def test_imports_resolve_by_priority(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b/index.ts",), ("src/pkg/mod.py",), ("src/c.ts",)], "path string")
    imports = spark.createDataFrame([("src/a.ts", "./b"), ("src/b/index.ts", "../c"), ("src/a.ts", "pkg.mod"), ("src/a.ts", "./a.ts"), ("src/a.ts", "react")], "src string, target string")
    got = {(r.src, r.target): r.resolved for r in G.resolve_imports(imports, files).collect()}
    assert got == {("src/a.ts", "./b"): "src/b/index.ts", ("src/b/index.ts", "../c"): "src/c.ts", ("src/a.ts", "pkg.mod"): "src/pkg/mod.py", ("src/a.ts", "./a.ts"): "src/a.ts", ("src/a.ts", "react"): None}


def test_frames_match_by_suffix_only_without_exact_ones(spark):
    files = spark.createDataFrame([("src/a.py",), ("lib/src/b.py",)], "path string")
    f = spark.createDataFrame([(0, "src/a.py", 3), (1, "src/b.py", 4)], "seq int, path string, line int")
    assert [r.file for r in G.frames_to_files(f, files).collect()] == ["src/a.py"]
    assert [r.file for r in G.frames_to_files(f.filter("seq = 1"), files).collect()] == ["lib/src/b.py"]


def test_incremental_status(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, h string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "id int, h string")
    assert {r.id: r.status for r in G.merge_incremental(old, new, "id", "h").collect()} == {1: "same", 2: "changed", 3: "removed", 4: "added"}
