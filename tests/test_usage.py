from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.operators import memory as M
from sparkloom.operators import search as S
from sparkloom.operators import usage as U


def test_prices(spark):
    rows = spark.createDataFrame([(m,) for m in ("Opus-4-8", "opus-4-1", "haiku-x", "fable", "", None)], "model string")
    got = [r.p for r in rows.select(U.price().p_input.alias("p")).collect()]
    assert got == [5.0, 15.0, 1.0, 10.0, 3.0, 3.0]


def test_costs(spark):
    u = spark.createDataFrame([("haiku", 1_000_000, 0, 0, 0, 500_000), ("x", 0, 0, 0, 0, 0)], "model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, tokens_avoided long")
    a, b = U.with_costs(u).collect()
    assert (a.total_cost_usd, a.naive_cost_usd, a.saved_usd, a.savings_pct) == (1.0, 1.5, 0.5, 0.3333)
    assert (b.total_cost_usd, b.savings_pct) == (0.0, 0.0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50)), min_size=1, max_size=12), st.integers(1, 80))
def test_budget_is_never_exceeded(spark, items, budget):
    df = spark.createDataFrame([(i, g, n) for i, (g, n) in enumerate(items)], "i int, g int, n int")
    got = S.budgeted(df, ["g"], [F.col("i")], "n", budget).collect()
    for g in {x for x, _ in items}:
        assert sum(r.taken for r in got if r.g == g) == min(budget, sum(n for x, n in items if x == g))


def test_log_fold(spark):
    cols = "seq int, tool string, turn int, mode string, file string, full_chars long, response_chars long, response_tokens long, shadow_tokens long, payload_chars long"
    log = spark.createDataFrame([
        (1, "graph_read", 1, "full", "a", 4000, 400, 0, 0, 0), (2, "native_read", 2, "symbol_excerpt", "a::f", 4000, 200, 0, 0, 0), (3, "graph_read", 2, "cross_turn_pointer", "a", 100_000, 10, 0, 0, 0),
        (4, "graph_read", 3, "dedupe_preview", "a", 800, 80, 0, 0, 0), (5, "graph_continue", 4, None, None, 0, 0, 0, 0, 400), (6, "shadow_grep", 4, None, None, 0, 0, 0, 77, 0), (7, "graph_read", 1, "full", "b", 0, 0, 33, 0, 0),
    ], cols)
    r = U.log_savings(log).first()
    assert (r.total_turns, r.tokens_served, r.avoided_tar, r.avoided_cross_turn, r.full_tokens) == (4, 100 + 50 + 20 + 33, 900 + 180, 20_000, 1000 + 200)
    assert (r.overhead_tokens, r.shadow_grep_tokens, r.unique_files, r.total_reads) == (25 + 25 + 20 + 15 + 100, 77, 1, 4)


def test_rollup_merge_is_rebuild(spark):
    u = spark.sql("SELECT 'k' license_key, timestamp_ntz'2024-01-01 05:00:00' + make_interval(0,0,0,0,id*7) timestamp, IF(id % 3 = 0, null, concat('h', id % 2)) device_host, (id * 5 - 20) tokens_avoided FROM range(20)")
    key = ["license_key", "day", "device_host"]
    whole = sorted(map(tuple, U.daily_rollup(u).select(*key, "tokens_saved", "requests").collect()))
    half = F.col("tokens_avoided") < 30
    assert sorted(map(tuple, U.merge_rollup(U.daily_rollup(u.filter(half)), u.filter(~half)).select(*key, "tokens_saved", "requests").collect())) == whole


def test_expiry(spark):
    rows = spark.createDataFrame([("perpetual",), ("2024-01-01",), ("2099-01-01",)], "e string")
    assert [r.x for r in rows.select(U.expired("e", "2024-06-01").alias("x")).collect()] == [False, True, False]


def test_upsert_is_idempotent(spark):
    cols = "seq int, kind string, content string, tags array<string>, queries array<string>, symbol_id string, file_path string, stale boolean, stale_reason string, read_count int, created_epoch long"
    rows = [(1, "edit_observation", "x", ["a"], ["q1"], "s", "f", False, "", 1, 10), (2, "edit_observation", "y", ["b", "a"], ["q2"], "s", "f", True, "gone", 5, 20), (3, "fact", "z", [], [], "", "", False, "", 0, 5)]
    e = spark.createDataFrame(rows, cols)
    once = sorted(map(str, M.upsert(e).collect()))
    assert once == sorted(map(str, M.upsert(e.unionByName(e)).collect()))
    m = M.upsert(e).filter("kind = 'edit_observation'").first()
    assert (m.content, m.tags, m.queries, m.stale, m.stale_reason, m.read_count) == ("x", ["a", "b"], ["q1", "q2"], True, "gone", 5)


def test_cache_validity(spark):
    c = spark.sql("SELECT 'a' key, 1000L created_epoch, array(struct('f' path, 1L mtime)) files UNION ALL SELECT 'b', 1000L, array(struct('g', 1L)) UNION ALL SELECT 'c', 10L, array(struct('f', 1L))")
    f = spark.createDataFrame([("f", 1), ("g", 2)], "path string, mtime long")
    assert [r.key for r in M.cache_valid(c, f, 1500).collect()] == ["a"]
