"""Usage analytics: prices, costs, savings, roll-ups, windows and keyed states.

All are plain aggregations or windows over keys; sums combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dollars a million tokens (input, cache write, cache read, output); the first rule
# whose words a model's name holds is taken.
PRICE_RULES = [
    (["haiku"], [], (1.0, 1.25, 0.1, 5.0)),
    (["fable"], [], (10.0, 12.5, 1.0, 50.0)),
    (["opus"], ["4-8", "4-7"], (5.0, 6.25, 0.5, 25.0)),
    (["opus"], [], (15.0, 18.75, 1.5, 75.0)),
]
DEFAULT_PRICES = (3.0, 3.75, 0.3, 15.0)
# Weights of action kinds for attention, and for what an action log keeps.
ATTENTION_WEIGHTS = {"read": 2, "read_cache_hit": 1, "register_edit": 8, "edit_observation": 5}
ACTION_WEIGHTS = {
    "register_edit": 100, "read": 50, "continue_retrieve": 25, "continue_memory_first": 25, "retrieve": 15, "fallback_rg": 10, "impact": 8, "cross_search": 8, "action_summary": 5,
    "read_cache_hit": 3, "retrieve_cache_hit": 3, "read_blocked_allowlist": 1, "read_blocked_reuse_gate": 1, "fallback_blocked_limit": 1,
}
#: Characters a plain reader would take of one file; fixed.
READ_CAP_CHARS = 80_000


def weight(kind: Column, weights: dict[str, int], otherwise: int) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(otherwise))


def seconds_before(ts: Column, now: str) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp")))


def attention(actions: DataFrame, now: str, half_life: float = 3600.0, key: str = "file") -> DataFrame:
    """(key, score, reads, edits, last_ts): weights of a key's actions, halved every half-life."""
    w = weight(F.col("kind"), ATTENTION_WEIGHTS, 0)
    kept = actions.filter((w > 0) & (F.col(key).cast("string") != ""))
    return kept.groupBy(key).agg(
        F.sum(w * F.pow(F.lit(2.0), -seconds_before(F.col("ts"), now) / half_life)).alias("score"),
        F.count_if(F.col("kind").isin("read", "read_cache_hit")).alias("reads"),
        F.count_if(F.col("kind").isin("register_edit", "edit_observation")).alias("edits"),
        F.max("ts").alias("last_ts"),
    )


def shield(attention_rows: DataFrame, targets: DataFrame, least: float = 2.0) -> DataFrame:
    """Targets (path, severity hard / soft) that were lately worked on, with ``block`` if the
    change is hard and the file was edited at least twice."""
    return targets.join(attention_rows, targets.path == attention_rows.file).filter(F.col("score") >= least).select(
        "path", "severity", "score", "reads", "edits", ((F.col("severity") == "hard") & (F.col("edits") >= 2)).alias("block")
    )


def evict(actions: DataFrame, now: str, keep: int = 300, by: str | None = None) -> DataFrame:
    """The ``keep`` actions of largest weight, halved every day; per ``by`` if given."""
    scored = actions.withColumn("importance", weight(F.col("kind"), ACTION_WEIGHTS, 5) * F.pow(F.lit(2.0), -seconds_before(F.col("ts"), now) / 86400.0))
    if by is None:
        return scored.orderBy(F.desc("importance"), "seq").limit(keep)
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("importance"), "seq"))).filter(F.col("_n") <= keep).drop("_n")


def price(model: str | Column = "model") -> Column:
    """struct(p_input, p_write, p_read, p_output) of a model's name."""
    low = F.lower(F.coalesce(F.col(model) if isinstance(model, str) else model, F.lit("")))
    names = ("p_input", "p_write", "p_read", "p_output")
    out = F.struct(*[F.lit(x).alias(n) for x, n in zip(DEFAULT_PRICES, names)])
    for words, one_of, prices in reversed(PRICE_RULES):
        rule = F.lit(True)
        for w in words:
            rule = rule & low.contains(w)
        if one_of:
            rule = rule & F.greatest(*[low.contains(w) for w in one_of]) if len(one_of) > 1 else rule & low.contains(one_of[0])
        out = F.when(rule, F.struct(*[F.lit(x).alias(n) for x, n in zip(prices, names)])).otherwise(out)
    return out


def with_costs(usage: DataFrame) -> DataFrame:
    """Usage rows with input_price, total_cost_usd, naive_cost_usd, saved_usd and savings_pct.

    The naive cost adds the avoided tokens at the input price.
    """
    rows = usage.withColumn("_p", price())
    spent = (F.col("input_tokens") * F.col("_p.p_input") + F.col("cache_write_tokens") * F.col("_p.p_write") + F.col("cache_read_tokens") * F.col("_p.p_read") + F.col("output_tokens") * F.col("_p.p_output")) / 1e6
    rows = rows.withColumn("_spent", spent).withColumn("_naive", F.col("_spent") + F.greatest(F.col("tokens_avoided"), F.lit(0)) * F.col("_p.p_input") / 1e6)
    return rows.withColumns({
        "input_price": F.col("_p.p_input"),
        "total_cost_usd": half_up(F.col("_spent"), 6),
        "naive_cost_usd": half_up(F.col("_naive"), 6),
        "saved_usd": half_up(F.greatest(F.lit(0.0), F.col("_naive") - F.col("_spent")), 6),
        "savings_pct": F.round(F.when(F.col("_naive") > 0, (F.col("_naive") - F.col("_spent")) / F.col("_naive")).otherwise(0.0), 4),
    }).drop("_p", "_spent", "_naive")


def half_up(value: Column, digits: int) -> Column:
    """Rounded with decimal halves up: a trace is added, so that a half that binary fractions put
    just below itself goes up too."""
    return F.round(value + F.lit(10.0 ** -(digits + 4)), digits)


def share(part: str | Column, whole: str | Column, digits: int = 4) -> Column:
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.round(F.when(whole > 0, part / whole).otherwise(0.0), digits)


def in_window(ts: str | Column, start: str, end: str) -> Column:
    """A half-open window; the bounds are literals, so the filter reaches the scan."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return (c >= F.lit(start).cast("timestamp_ntz")) & (c < F.lit(end).cast("timestamp_ntz"))


def month_to_date(ts: str | Column, now: str) -> Column:
    """From the first of the month of ``now`` up to ``now``; the bounds are folded, so the filter reaches the scan."""
    c = F.col(ts) if isinstance(ts, str) else ts
    end = F.lit(now).cast("timestamp_ntz")
    return (c >= F.date_trunc("month", end).cast("timestamp_ntz")) & (c <= end)


def summary(costed: DataFrame) -> DataFrame:
    """One row of totals."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = costed.agg(
        F.count("*").alias("turns"), total("input_tokens").alias("total_input"), total("output_tokens").alias("total_output"), total("cache_read_tokens").alias("total_cache_read"),
        total("cache_write_tokens").alias("total_cache_write"), half_up(total("total_cost_usd"), 4).alias("total_cost"), half_up(total("naive_cost_usd"), 4).alias("total_naive"),
        F.round(F.coalesce(F.avg("savings_pct"), F.lit(0.0)) * 100, 2).alias("avg_savings_pct"), total("tokens_served").alias("total_served"), total("tokens_avoided").alias("total_avoided"),
        total("avoided_tar").alias("total_tar"), total("avoided_cross_turn").alias("total_cross_turn"), total("avoided_shadow").alias("total_shadow"),
    )
    return out.withColumn("tool_savings_pct", F.round(F.when(F.col("total_served") + F.col("total_avoided") > 0, F.col("total_avoided") / (F.col("total_served") + F.col("total_avoided")) * 100).otherwise(0.0), 2))


def by_day(costed: DataFrame) -> DataFrame:
    return costed.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("turns"), F.sum("input_tokens").alias("input_tokens"), F.sum("cache_read_tokens").alias("cache_read_tokens"), half_up(F.sum("total_cost_usd"), 4).alias("cost"),
        half_up(F.sum("naive_cost_usd"), 4).alias("naive"), F.sum("tokens_served").alias("tokens_served"), F.sum("tokens_avoided").alias("tokens_avoided"),
    )


def savings_chart(usage: DataFrame, now: str, days: int = 30, price_per_million: float = 3.0) -> DataFrame:
    """Daily savings of the last ``days`` (90 at most) days with the grand totals on each row."""
    since = F.lit(now).cast("timestamp_ntz") - F.make_interval(days=F.lit(min(days, 90)))
    daily = usage.filter((F.col("timestamp") >= since) & (F.col("tokens_avoided") > 0)).groupBy(F.to_date("timestamp").alias("day")).agg(F.sum("tokens_avoided").alias("tokens_saved"), F.count("*").alias("requests"))
    totals = daily.agg(F.sum("tokens_saved").alias("total_saved"), F.sum("requests").alias("total_requests"))
    return daily.crossJoin(F.broadcast(totals)).withColumn("saved_usd", F.round(F.col("total_saved") * price_per_million / 1e6, 4))


def daily_rollup(usage: DataFrame) -> DataFrame:
    """(license_key, day, device_host, tokens_saved, requests), rebuilt from all events."""
    return usage.groupBy("license_key", F.to_date("timestamp").alias("day"), F.coalesce("device_host", F.lit("unknown")).alias("device_host")).agg(
        F.sum(F.greatest(F.coalesce("tokens_avoided", F.lit(0)), F.lit(0))).alias("tokens_saved"), F.count("*").alias("requests")
    )


def merge_rollup(old: DataFrame, new_events: DataFrame) -> DataFrame:
    """A roll-up with further events added: equals the rebuild over all of them."""
    keys = ["license_key", "day", "device_host"]
    return old.unionByName(daily_rollup(new_events)).groupBy(*keys).agg(F.sum("tokens_saved").alias("tokens_saved"), F.sum("requests").alias("requests"))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order: later rows replace earlier ones."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def rate_windows(events: DataFrame, key: str, seconds: int, limit: int, ts: str = "ts") -> DataFrame:
    """Requests of each key in each fixed window, and whether they exceed the limit."""
    w = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("requests")).select(key, F.col("w.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("limited"))


def log_savings(log: DataFrame) -> DataFrame:
    """One row of what a tool log served and avoided.

    ``log``: (seq, tool, turn, mode, file, full_chars, response_chars, response_tokens, shadow_tokens,
    payload_chars). The first full read of each file counts what was avoided; further reads of it
    (also of its symbols) only what was served. Pointers, previews and shadow measurements have
    their own accounts.
    """
    base = F.split_part("file", F.lit("::"), F.lit(1))
    read = F.col("tool").isin("graph_read", "native_read")
    plain = read & ~F.col("mode").isin("cross_turn_pointer", "dedupe_preview") & (F.col("full_chars") > 0)
    rows = log.withColumn("_plain", plain).withColumn("_base", F.when(plain & (F.col("file") != ""), base))
    # rows without a file are spread by their number: they would all meet in one group
    spread = F.coalesce("_base", F.concat(F.lit("#"), F.col("seq").cast("string")))
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy(spread, F.col("_base").isNull()).orderBy("seq")) == 1)
    capped = F.least("full_chars", F.lit(READ_CAP_CHARS))
    quarter = lambda c: F.floor(c / 4)
    pointer, preview = read & (F.col("mode") == "cross_turn_pointer"), read & (F.col("mode") == "dedupe_preview")
    add = lambda when, value: F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("long")
    fresh = F.col("_plain") & F.col("_first")
    shown = preview & (F.col("full_chars") > 0)
    out = rows.agg(
        F.max("turn").alias("total_turns"),
        (add(F.col("_plain"), quarter(F.col("response_chars"))) + add(shown, quarter(F.col("response_chars"))) + add(read & ~pointer & ~preview & (F.col("full_chars") <= 0), F.col("response_tokens"))).alias("tokens_served"),
        (add(fresh, quarter(F.greatest(F.lit(0), capped - F.col("response_chars")))) + add(shown, quarter(F.greatest(F.lit(0), F.col("full_chars") - F.col("response_chars"))))).alias("avoided_tar"),
        add(pointer & (F.col("full_chars") > 0), quarter(capped)).alias("avoided_cross_turn"),
        (add(fresh, quarter(capped)) + add(shown, quarter(F.col("full_chars")))).alias("full_tokens"),
        (add(pointer, F.lit(20)) + add(preview, F.lit(15)) + add(F.col("_plain"), F.lit(25)) + add(F.col("tool") == "graph_continue", quarter(F.col("payload_chars")))).alias("overhead_tokens"),
        add(F.col("tool") == "shadow_grep", F.col("shadow_tokens")).alias("shadow_grep_tokens"),
        add(F.col("tool") == "shadow_file_reads", F.col("shadow_tokens")).alias("shadow_read_tokens"),
        F.count_distinct("_base").alias("unique_files"),
        F.count_if(read & ~pointer).alias("total_reads"),
    )
    return out.withColumn("tar", share("avoided_tar", "full_tokens"))


def mode_hits(log: DataFrame) -> DataFrame:
    """(mode, hits) of the reads of a tool log."""
    return log.filter(F.col("tool").isin("graph_read", "native_read")).groupBy(F.coalesce("mode", F.lit("unknown")).alias("mode")).agg(F.count("*").alias("hits"))


def seats(licences: DataFrame) -> DataFrame:
    """(key, seats, devices, over): distinct hosts of each licence's activations against its seats."""
    host = F.coalesce(F.nullif(F.lower(F.trim("a.host")), F.lit("")), F.lit("unknown"))
    used = licences.select("key", F.explode("activations").alias("a")).groupBy("key").agg(F.count_distinct(host).alias("devices"))
    return licences.select("key", "seats").join(used, "key", "left").select("key", "seats", F.coalesce("devices", F.lit(0)).alias("devices")).withColumn("over", F.col("devices") > F.col("seats"))


def expired(expires: str | Column, today: str) -> Column:
    c = F.col(expires) if isinstance(expires, str) else expires
    return (c != "perpetual") & (F.try_to_date(c) < F.lit(today).cast("date"))
