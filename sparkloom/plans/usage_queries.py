"""Queries of the usage, action-log and licence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as U
from . import bindings as B

QUERIES, ORACLES = {}, {}
WEIGHTS = {n: "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in table.items()) + f" ELSE {rest} END" for n, table, rest in (("att", U.ATTENTION_WEIGHTS, 0), ("act", U.ACTION_WEIGHTS, 5))}
AGE = f"greatest(0, epoch(TIMESTAMP '{B.NOW}') - floor(epoch(ts)))"
COST_SQL = """c0 AS (SELECT *, CASE WHEN model LIKE '%haiku%' THEN 1.0 WHEN model LIKE '%fable%' THEN 10.0 WHEN model LIKE '%opus%' AND (model LIKE '%4-8%' OR model LIKE '%4-7%') THEN 5.0 WHEN model LIKE '%opus%' THEN 15.0 ELSE 3.0 END::DOUBLE AS p FROM u),
c1 AS (SELECT *, (input_tokens * p + cache_write_tokens * (p * 1.25) + cache_read_tokens * (p * 0.1) + output_tokens * (p * 5)) / 1e6 AS spent FROM c0),
c2 AS (SELECT *, spent + greatest(tokens_avoided, 0) * p / 1e6 AS naive FROM c1),
c AS (SELECT *, p AS input_price, round(spent + 1e-10, 6) AS total_cost_usd, round(naive + 1e-10, 6) AS naive_cost_usd, round(greatest(0, naive - spent) + 1e-10, 6) AS saved_usd, round(CASE WHEN naive > 0 THEN (naive - spent) / naive ELSE 0 END, 4) AS savings_pct FROM c2)"""


def day_text(df):
    return df.withColumn("day", F.col("day").cast("string"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {B.ACTIONS_SQL} SELECT file, round(sum({WEIGHTS['att']} * pow(2.0, -{AGE} / 86400.0)), 6) AS score, count(nullif(kind IN ('read', 'read_cache_hit'), false)) AS reads, count(nullif(kind = 'register_edit', false)) AS edits, max(ts) AS last_ts FROM a WHERE {WEIGHTS['att']} > 0 GROUP BY file")
def attention_decay(spark, d):
    return U.attention(B.actions(spark, d), B.NOW, half_life=86400.0).withColumn("score", F.round("score", 6))


@query(f"""WITH {B.ACTIONS_SQL}, t AS (SELECT file, sum({WEIGHTS['att']} * pow(2.0, -{AGE} / 86400.0)) AS score, count(nullif(kind IN ('read', 'read_cache_hit'), false)) AS reads, count(nullif(kind = 'register_edit', false)) AS edits FROM a WHERE {WEIGHTS['att']} > 0 GROUP BY file),
p AS (SELECT 'src/file' || i || '.py' AS path, CASE WHEN i % 2 = 0 THEN 'hard' ELSE 'soft' END AS severity FROM range(0, 40) r(i))
SELECT path, severity, round(score, 6) AS score, reads, edits, severity = 'hard' AND edits >= 2 AS block FROM p JOIN t ON path = file WHERE score >= 2.0""")
def undo_shield(spark, d):
    targets = spark.range(40).select(F.concat(F.lit("src/file"), "id", F.lit(".py")).alias("path"), F.when(F.col("id") % 2 == 0, "hard").otherwise("soft").alias("severity"))
    return U.shield(U.attention(B.actions(spark, d), B.NOW, half_life=86400.0), targets).withColumn("score", F.round("score", 6))


@query(f"WITH {B.ACTIONS_SQL} SELECT seq, kind, file, round({WEIGHTS['act']} * pow(2.0, -{AGE} / 86400.0), 6) AS importance FROM a ORDER BY {WEIGHTS['act']} * pow(2.0, -{AGE} / 86400.0) DESC, seq LIMIT 300")
def action_eviction(spark, d):
    return U.evict(B.actions(spark, d), B.NOW).select("seq", "kind", "file", F.round("importance", 6).alias("importance"))


@query(f"WITH {B.USAGE_SQL}, {COST_SQL} SELECT id, model, input_price, total_cost_usd, naive_cost_usd, saved_usd, savings_pct FROM c")
def price_tier_cost(spark, d):
    return U.with_costs(B.usage_events(spark, d)).select("id", "model", "input_price", "total_cost_usd", "naive_cost_usd", "saved_usd", "savings_pct")


@query(f"""WITH {B.USAGE_SQL}, {COST_SQL}, s AS (SELECT count(*) AS turns, CAST(sum(input_tokens) AS BIGINT) AS total_input, CAST(sum(output_tokens) AS BIGINT) AS total_output, CAST(sum(cache_read_tokens) AS BIGINT) AS total_cache_read, CAST(sum(cache_write_tokens) AS BIGINT) AS total_cache_write,
round(sum(total_cost_usd) + 1e-8, 4) AS total_cost, round(sum(naive_cost_usd) + 1e-8, 4) AS total_naive, round(avg(savings_pct) * 100, 2) AS avg_savings_pct, CAST(sum(tokens_served) AS BIGINT) AS total_served, CAST(sum(tokens_avoided) AS BIGINT) AS total_avoided, CAST(sum(avoided_tar) AS BIGINT) AS total_tar, CAST(sum(avoided_cross_turn) AS BIGINT) AS total_cross_turn, CAST(sum(avoided_shadow) AS BIGINT) AS total_shadow
FROM c WHERE "timestamp" >= TIMESTAMP '1997-03-01' AND "timestamp" < TIMESTAMP '1997-04-01') SELECT *, round(total_avoided / (total_served + total_avoided) * 100, 2) AS tool_savings_pct FROM s""")
def usage_summary_month(spark, d):
    return U.summary(U.with_costs(B.usage_events(spark, d).filter(U.in_window("timestamp", "1997-03-01", "1997-04-01"))))


@query(f"""WITH {B.USAGE_SQL}, {COST_SQL} SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, count(*) AS turns, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, round(sum(total_cost_usd) + 1e-8, 4) AS cost, round(sum(naive_cost_usd) + 1e-8, 4) AS naive, CAST(sum(tokens_served) AS BIGINT) AS tokens_served, CAST(sum(tokens_avoided) AS BIGINT) AS tokens_avoided FROM c GROUP BY 1""")
def usage_by_day(spark, d):
    return day_text(U.by_day(U.with_costs(B.usage_events(spark, d))))


@query(f"""WITH {B.USAGE_SQL}, x AS (SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, CAST(sum(tokens_avoided) AS BIGINT) AS tokens_saved, count(*) AS requests FROM u WHERE "timestamp" >= TIMESTAMP '2001-07-01' - INTERVAL 60 DAY AND tokens_avoided > 0 GROUP BY 1)
SELECT *, CAST((SELECT sum(tokens_saved) FROM x) AS BIGINT) AS total_saved, CAST((SELECT sum(requests) FROM x) AS BIGINT) AS total_requests, round((SELECT sum(tokens_saved) FROM x) * 3.0 / 1e6, 4) AS saved_usd FROM x""")
def savings_chart(spark, d):
    return day_text(U.savings_chart(B.usage_events(spark, d), "2001-07-01 00:00:00", 60))


_ROLLUP = f"""WITH {B.USAGE_SQL} SELECT license_key, CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, coalesce(device_host, 'unknown') AS device_host, CAST(sum(greatest(tokens_avoided, 0)) AS BIGINT) AS tokens_saved, count(*) AS requests FROM u GROUP BY ALL"""


@query(_ROLLUP)
def daily_rollup_rebuild(spark, d):
    return day_text(U.daily_rollup(B.usage_events(spark, d)))


@query(_ROLLUP)
def daily_rollup_merge(spark, d):
    u = B.usage_events(spark, d)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return day_text(U.merge_rollup(U.daily_rollup(u.filter(F.col("timestamp") < cut)), u.filter(F.col("timestamp") >= cut)))


@query(f"""WITH {B.USAGE_SQL} SELECT license_key, session_id, id, model, tokens_avoided FROM (SELECT *, row_number() OVER (PARTITION BY license_key, session_id ORDER BY "timestamp" DESC, id DESC) AS n FROM u) WHERE n = 1""")
def latest_per_session(spark, d):
    return U.latest(B.usage_events(spark, d), ["license_key", "session_id"], F.desc("timestamp"), F.desc("id")).select("license_key", "session_id", "id", "model", "tokens_avoided")


@query(f"""WITH {B.USAGE_SQL}, {COST_SQL} SELECT id, session_id, round(CASE WHEN tokens_avoided > 0 THEN avoided_tar / tokens_avoided ELSE 0 END, 4) AS tar_share, round(CASE WHEN tokens_avoided > 0 THEN avoided_cross_turn / tokens_avoided ELSE 0 END, 4) AS cross_turn_share, round(CASE WHEN tokens_avoided > 0 THEN avoided_shadow / tokens_avoided ELSE 0 END, 4) AS shadow_share, saved_usd FROM c""")
def session_savings_shares(spark, d):
    c = U.with_costs(B.usage_events(spark, d))
    return c.select("id", "session_id", U.share("avoided_tar", "tokens_avoided").alias("tar_share"), U.share("avoided_cross_turn", "tokens_avoided").alias("cross_turn_share"), U.share("avoided_shadow", "tokens_avoided").alias("shadow_share"), "saved_usd")


@query("SELECT o_custkey, o_orderpriority, count(*) AS cnt, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL ORDER BY cnt DESC, o_custkey, o_orderpriority LIMIT 10")
def top_repos(spark, d):
    return B.table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("cnt"), F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("cnt"), "o_custkey", "o_orderpriority").limit(10)


@query("SELECT count(DISTINCT o_custkey || '/' || o_orderpriority) AS repos, count(*) AS total, count(nullif(o_orderdate >= date_trunc('month', TIMESTAMP '2001-07-20'), false)) AS month_to_date FROM orders")
def distinct_repos(spark, d):
    o = B.table(spark, d, "orders")
    return o.agg(F.count_distinct(F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority")).alias("repos"), F.count("*").alias("total"), F.count_if(F.col("o_orderdate") >= F.lit("2001-07-01").cast("timestamp_ntz")).alias("month_to_date"))


@query("SELECT o_custkey, count(*) AS reviews, round(coalesce(sum(o_totalprice), 0), 2) AS total, round(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) / 100, 0) + 1e-8, 4) AS mean, count(nullif(o_orderstatus = 'F', false)) AS failed FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_custkey")
def repo_dashboard(spark, d):
    o = B.table(spark, d, "orders").filter(F.col("o_orderstatus").isNotNull())
    return o.groupBy("o_custkey").agg(F.count("*").alias("reviews"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"), U.half_up(F.coalesce(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count("*") / 100, F.lit(0.0)), 4).alias("mean"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))


@query("SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'completed' END AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def recent_reviews(spark, d):
    return B.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status")).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)


@query("SELECT user_id, CAST(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS window_start, count(*) AS requests, count(*) > 2 AS limited FROM events GROUP BY ALL")
def rate_limit_windows(spark, d):
    return U.rate_windows(B.table(spark, d, "events"), "user_id", 6 * 3600, 2).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def tool_log(spark, d):
    """A tool log from events: the type gives tool and mode, the value the sizes."""
    e = B.table(spark, d, "events")
    n = F.floor(F.abs(F.col("value")) * 100).cast("long")
    k = F.col("event_id") % 11
    tool = F.when(k == 0, "shadow_grep").when(k == 1, "shadow_file_reads").when(k == 2, "graph_continue").otherwise("graph_read")
    mode = F.when(F.col("event_type") == "error", "cross_turn_pointer").when(F.col("event_type") == "signup", "dedupe_preview").when(F.col("event_type") == "view", "symbol_excerpt").otherwise("full")
    return e.select(F.col("event_id").alias("seq"), tool.alias("tool"), (F.col("event_id") % 17).alias("turn"), mode.alias("mode"), F.concat(F.lit("f"), F.col("user_id"), F.when(F.col("event_type") == "view", "::s").otherwise("")).alias("file"), F.when(k == 5, 0).otherwise(n).alias("full_chars"), F.floor(n / 3).alias("response_chars"), F.floor(n / 5).alias("response_tokens"), F.floor(n / 7).alias("shadow_tokens"), (n % 400).alias("payload_chars"))


LOG_SQL = """l AS (SELECT event_id AS seq, CASE event_id % 11 WHEN 0 THEN 'shadow_grep' WHEN 1 THEN 'shadow_file_reads' WHEN 2 THEN 'graph_continue' ELSE 'graph_read' END AS tool, event_id % 17 AS turn,
  CASE event_type WHEN 'error' THEN 'cross_turn_pointer' WHEN 'signup' THEN 'dedupe_preview' WHEN 'view' THEN 'symbol_excerpt' ELSE 'full' END AS mode, 'f' || user_id AS base,
  CASE WHEN event_id % 11 = 5 THEN 0 ELSE n END AS fc, n // 3 AS rc, n // 5 AS rt, n // 7 AS st, n % 400 AS pc FROM (SELECT *, CAST(floor(abs(value) * 100) AS BIGINT) AS n FROM events)),
r AS (SELECT *, least(fc, 80000) AS cap, tool = 'graph_read' AND mode NOT IN ('cross_turn_pointer', 'dedupe_preview') AND fc > 0 AS plain FROM l),
f AS (SELECT *, plain AND row_number() OVER (PARTITION BY base, plain ORDER BY seq) = 1 AS fresh, tool = 'graph_read' AND mode = 'cross_turn_pointer' AS pointer, tool = 'graph_read' AND mode = 'dedupe_preview' AS preview FROM r)"""


@query(f"""WITH {LOG_SQL}, s AS (SELECT max(turn) AS total_turns,
CAST(sum(CASE WHEN plain OR (preview AND fc > 0) THEN rc // 4 WHEN tool = 'graph_read' AND NOT pointer AND NOT preview THEN rt ELSE 0 END) AS BIGINT) AS tokens_served,
CAST(sum(CASE WHEN fresh THEN greatest(0, cap - rc) // 4 WHEN preview AND fc > 0 THEN greatest(0, fc - rc) // 4 ELSE 0 END) AS BIGINT) AS avoided_tar,
CAST(sum(CASE WHEN pointer AND fc > 0 THEN cap // 4 ELSE 0 END) AS BIGINT) AS avoided_cross_turn,
CAST(sum(CASE WHEN fresh THEN cap // 4 WHEN preview AND fc > 0 THEN fc // 4 ELSE 0 END) AS BIGINT) AS full_tokens,
CAST(sum(CASE WHEN pointer THEN 20 WHEN preview THEN 15 WHEN plain THEN 25 WHEN tool = 'graph_continue' THEN pc // 4 ELSE 0 END) AS BIGINT) AS overhead_tokens,
CAST(sum(CASE WHEN tool = 'shadow_grep' THEN st ELSE 0 END) AS BIGINT) AS shadow_grep_tokens, CAST(sum(CASE WHEN tool = 'shadow_file_reads' THEN st ELSE 0 END) AS BIGINT) AS shadow_read_tokens,
count(DISTINCT CASE WHEN plain THEN base END) AS unique_files, count(nullif(tool = 'graph_read' AND NOT pointer, false)) AS total_reads FROM f)
SELECT *, round(CASE WHEN full_tokens > 0 THEN avoided_tar / full_tokens ELSE 0 END, 4) AS tar FROM s""")
def savings_fold(spark, d):
    return U.log_savings(tool_log(spark, d))


@query(f"WITH {LOG_SQL} SELECT mode, count(*) AS hits FROM l WHERE tool = 'graph_read' GROUP BY mode")
def tool_hits_map(spark, d):
    return U.mode_hits(tool_log(spark, d))


@query(f"WITH {LOG_SQL} SELECT base AS file, seq AS first_seq, CAST(greatest(0, cap - rc) // 4 AS BIGINT) AS avoided FROM f WHERE fresh")
def first_read_fold(spark, d):
    log = tool_log(spark, d).filter((F.col("tool") == "graph_read") & ~F.col("mode").isin("cross_turn_pointer", "dedupe_preview") & (F.col("full_chars") > 0)).withColumn("file", F.split_part("file", F.lit("::"), F.lit(1)))
    return U.latest(log, ["file"], F.asc("seq")).select("file", F.col("seq").alias("first_seq"), F.floor(F.greatest(F.lit(0), F.least("full_chars", F.lit(U.READ_CAP_CHARS)) - F.col("response_chars")) / 4).alias("avoided"))


def licences(spark, d):
    o = B.table(spark, d, "orders")
    host = F.concat(F.when(F.col("o_orderkey") % 3 == 0, " HOST").otherwise("host"), F.col("o_orderkey") % 13)
    acts = o.groupBy(F.col("o_custkey").alias("key")).agg(F.collect_list(F.struct(host.alias("host"), F.col("o_orderdate").alias("ts"))).alias("activations"))
    return acts.withColumn("seats", (F.col("key") % 9 + 1).cast("int"))


@query("SELECT o_custkey AS key, CAST(o_custkey % 9 + 1 AS INTEGER) AS seats, count(DISTINCT o_orderkey % 13) AS devices, count(DISTINCT o_orderkey % 13) > o_custkey % 9 + 1 AS over FROM orders GROUP BY o_custkey")
def seat_usage(spark, d):
    return U.seats(licences(spark, d))


@query("SELECT o_custkey AS key, 'host' || (o_orderkey % 13) AS host, max(o_orderdate) AS last_ts FROM orders GROUP BY ALL")
def latest_activation(spark, d):
    a = licences(spark, d).select("key", F.explode("activations").alias("a"))
    return a.groupBy("key", F.lower(F.trim("a.host")).alias("host")).agg(F.max("a.ts").alias("last_ts"))


@query(f"""WITH {B.ACTIONS_SQL} SELECT file, count(nullif(kind IN ('read', 'read_cache_hit'), false)) AS read_count, count(nullif(kind = 'register_edit', false)) AS edit_count, max(seq) AS last_seq FROM a WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY file""")
def recent_window(spark, d):
    a = B.actions(spark, d).filter(F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz"))
    return a.groupBy("file").agg(F.count_if(F.col("kind").isin("read", "read_cache_hit")).alias("read_count"), F.count_if(F.col("kind") == "register_edit").alias("edit_count"), F.max("seq").alias("last_seq"))


def _windows(*lengths):
    return lambda spark, d: (
        B.table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), *lengths).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
    )


QUERIES["events_tumbling"] = _windows("1 hour")
ORACLES["events_tumbling"] = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
QUERIES["events_sliding"] = _windows("2 hours", "1 hour")
ORACLES["events_sliding"] = "SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, event_type, value FROM events, range(0, 2) r(k)) GROUP BY ALL"


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS brk FROM events), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def events_session(spark, d):
    e = B.table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
