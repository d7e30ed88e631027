"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations
only.

Documents are summed to cells of (source, language, topic) with their tokens, partial sums
first, so a source that holds a third of all rows is a few cells. What is wanted of every source,
language and topic is its target share of ``fraction`` of all tokens, and no more than it has: what
a value lacks is spread over the others in proportion. A cell is kept with probability
least(1, u); u starts at ``fraction`` and is raked in turn to every margin, by wanted / expected tokens,
until a round meets no margin that is off by more than ``tolerance``, or the worst is no better by a
share of ``gain`` than in the round before, or for ``rounds`` rounds (margins that no probabilities can
meet together are met as far as that goes; ``achieved`` tells). A document
stays by its cell's probability, decided by a hash of its id, so repeated rows share their fate
and a task run again decides alike.

Each step is one sum by margin with partial sums and one join with its table, which is broadcast
within a checked size; the steps' tables are cut, so plans stay short however many the rounds.

Targets default to the tempered shares: each margin's token share to the power ``alpha``,
scaled to the whole. A topic is the first of ``TOPICS`` whose pattern the text matches.

Defined cases: null source, language or text are values of their own (empty string); a cell
without tokens keeps its documents with probability ``fraction``; a margin value without
target gets weight 0; an empty table gives an empty result; other columns stay, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table, small

#: Topic rules in order of priority; the last resort is "prose".
TOPICS = {
    "legal": r"(?i)licen[sc]ed? under|under the [a-z]+ licen[sc]e|all rights reserved",
    "contact": r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]+",
    "table": r" \| ",
    "emphatic": r"!!|%%%",
}
DIMENSIONS = ("source", "lang", "topic")
FRACTION, ALPHA, TOLERANCE, GAIN, ROUNDS = 0.8, 0.7, 0.01, 0.25, 12


def topic(text: Column, rules: Mapping[str, str]) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(rules.items()):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), name).otherwise(out)
    return out


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    there = {x.lower() for x in df.columns}
    return next(x for x in (stem + "_" * i for i in range(len(there) + 1)) if x not in there)


def measured(docs: DataFrame, text_col: str = "text", rules: Mapping[str, str] = TOPICS) -> DataFrame:
    """``docs`` with a last column: a struct of source, lang, topic and tokens (words between white space)."""
    text = F.coalesce(text_col, F.lit(""))
    cell = F.struct(
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        topic(F.col(text_col), rules).alias("topic"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
    )
    return docs.withColumn(fresh(docs, "cell"), cell)


def wanted(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, alpha: float, fraction: float) -> dict[str, DataFrame]:
    """For each margin (value, have, want): what it has and what is wanted of it, in tokens."""
    margins, most = {}, []
    for dim in DIMENSIONS:
        base = F.pow(F.col("have"), F.lit(alpha))
        if targets and dim in targets:
            shares = F.create_map(*[F.lit(x) for pair in targets[dim].items() for x in pair])
            base = F.coalesce(F.try_element_at(shares, F.col(dim)).cast("double"), F.lit(0.0))
        margins[dim] = cut(cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("have")).withColumn("base", base), f"margin-{dim}")
        most.append(margins[dim].agg(F.sum("have"), F.sum(F.when(F.col("base") > 0, F.col("have")))).first())
    goal = min([fraction * (most[0][0] or 0.0), *(x or 0.0 for _, x in most)])
    out = {}
    for dim, margin in margins.items():
        # the scale c of the shares, higher as more values have less than their share
        full, scale, filled = F.lit(False), 0.0, -1
        while True:
            held, share, n = margin.agg(F.sum(F.when(full, F.col("have")).otherwise(0.0)), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("base"))), F.count(F.when(full, 1))).first()
            if n == filled or not share:
                break
            scale, filled = (goal - held) / share, n
            full = F.col("base") * F.lit(scale) >= F.col("have")
        want = F.when(full, F.when(F.col("base") > 0, F.col("have")).otherwise(0.0)).otherwise(F.col("base") * F.lit(scale))
        out[dim] = cut(margin.select(F.col(dim).alias("value"), "have", want.alias("want")), f"wanted-{dim}")
    return out


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, alpha: float = ALPHA, fraction: float = FRACTION, tolerance: float = TOLERANCE, gain: float = GAIN, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with the fitted ``weight``: the tokens expected of each."""
    want = wanted(cells, targets, alpha, fraction)
    few = {dim: F.broadcast if small(table) is not table else lambda x: x for dim, table in want.items()}  # a margin keeps its size
    weight = F.col("tokens") * F.least(F.lit(1.0), F.col("u"))
    out = cells.select(*DIMENSIONS, "tokens", F.lit(float(fraction)).alias("u"))
    worst = float("inf")
    for _ in range(rounds):
        off = []
        for dim in DIMENSIONS:
            step = out.groupBy(F.col(dim).alias("value")).agg(F.sum(weight).alias("now")).join(few[dim](want[dim]), "value")
            by = F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(F.lit(1.0))
            step = cut(step.select(F.col("value").alias(dim), by.alias("by"), (F.col("want") >= F.col("have")).alias("all"), F.when(F.col("want") > 0, F.abs(F.col("now") / F.col("want") - 1)).alias("off")), f"raked-{dim}")
            off.append(step.select("off"))
            u = F.col("u") * F.col("by")
            out = out.join(few[dim](step.drop("off")), dim).withColumn("u", F.when(F.col("all"), F.greatest(F.lit(1.0), u)).otherwise(u)).select(*DIMENSIONS, "tokens", "u")
        out = cut(out, "raked")
        now = reduce(DataFrame.unionAll, off).agg(F.max("off")).first()[0] or 0.0
        if now <= tolerance or now > (1 - gain) * worst:
            break
        worst = now
    return out.select(*DIMENSIONS, "tokens", weight.alias("weight"))


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from the id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def mixed(rows: DataFrame, id_col: str = "doc_id", targets: Mapping[str, Mapping[str, float]] | None = None, alpha: float = ALPHA, fraction: float = FRACTION, tolerance: float = TOLERANCE, gain: float = GAIN, rounds: int = ROUNDS, seed: int = 9) -> DataFrame:
    """``measured`` rows with two more last columns: the probability, and whether the row is kept. They are
    read twice, for the cells and for the sample: rows whose texts cost more than a copy of their
    measures are best cut before."""
    cell = F.col(rows.columns[-1])
    cells = cut(rows.groupBy(*[cell.getField(x).alias(x) for x in DIMENSIONS]).agg(F.sum(cell.getField("tokens")).alias("tokens")), "cells")
    fitted = cut(rake(cells, targets, alpha, fraction, tolerance, gain, rounds), "fitted")
    key, value, kept = fresh(rows, "cell_key"), fresh(rows, "probability"), fresh(rows, "kept")
    probability = F.when(F.col("tokens") > 0, F.col("weight") / F.nullif("tokens", F.lit(0))).otherwise(F.lit(fraction))
    rate = fitted.select(F.struct(*DIMENSIONS).alias(key), probability.alias(value))
    found = rows.join(small(rate), F.struct(*[cell.getField(x).alias(x) for x in DIMENSIONS]) == F.col(key)).drop(key)
    return found.withColumn(kept, uniform(F.col(id_col), seed) < F.col(value))


def achieved(found: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, alpha: float = ALPHA, fraction: float = FRACTION) -> DataFrame:
    """(dimension, value, have, want, expected, sampled) tokens of every margin of ``mixed`` rows."""
    cell, probability, kept = (F.col(x) for x in found.columns[-3:])
    sums = [F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("p")).alias("expected"), F.sum(F.when(F.col("k"), F.col("tokens")).otherwise(0)).alias("sampled")]
    cells = cut(found.select(*[cell.getField(x).alias(x) for x in (*DIMENSIONS, "tokens")], probability.alias("p"), kept.alias("k")).groupBy(*DIMENSIONS).agg(*sums), "achieved")
    want = wanted(cells, targets, alpha, fraction)
    parts = [cells.groupBy(F.col(dim).alias("value")).agg(F.sum("expected").alias("expected"), F.sum("sampled").alias("sampled")).join(want[dim], "value").select(F.lit(dim).alias("dimension"), "value", "have", "want", "expected", "sampled") for dim in DIMENSIONS]
    return reduce(DataFrame.unionAll, parts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(read_table(spark, sf_dir, "documents"))
    found = mixed(cut(rows.select("doc_id", F.col(rows.columns[-1]).alias("cell")), "measured"))
    return found.select("doc_id", "cell.topic", F.col("cell.tokens").alias("n_tokens"), F.round("probability", 9).alias("probability"), "kept")


def _oracle(alpha: float = ALPHA, fraction: float = FRACTION, tolerance: float = TOLERANCE, gain: float = GAIN, rounds: int = ROUNDS, passes: int = 12, seed: int = 9) -> str:
    rules = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{name}'" for name, p in TOPICS.items())
    steps = [
        f"d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {rules} ELSE 'prose' END AS topic, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents)",
        "c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
        f"goal AS MATERIALIZED (SELECT {fraction} * sum(tokens) AS goal FROM c)",
    ]
    for x in DIMENSIONS:
        steps.append(f"m_{x} AS MATERIALIZED (SELECT {x}, sum(tokens) AS have, pow(sum(tokens), {alpha}) AS base FROM c GROUP BY {x})")
        steps.append(f"s_{x}_0 AS MATERIALIZED (SELECT any_value(goal) / sum(base) AS s FROM m_{x}, goal)")
        for i in range(passes):
            steps.append(f"s_{x}_{i + 1} AS MATERIALIZED (SELECT CASE WHEN sum(base) FILTER (base * s < have) > 0 THEN (any_value(goal) - coalesce(sum(have) FILTER (base * s >= have), 0)) / sum(base) FILTER (base * s < have) ELSE any_value(s) END AS s FROM m_{x}, goal, s_{x}_{i})")
        steps.append(f"t_{x} AS MATERIALIZED (SELECT {x}, have, least(have, base * s) AS want FROM m_{x}, s_{x}_{passes})")
    steps += [f"w0 AS MATERIALIZED (SELECT *, CAST({fraction} AS DOUBLE) AS u FROM c)", "g0 AS MATERIALIZED (SELECT true AS go, CAST(1e300 AS DOUBLE) AS worst)"]
    n = 0
    for turn in range(rounds):
        off = []
        for x in DIMENSIONS:
            step = f"SELECT source, lang, topic, tokens, u, t_{x}.want, t_{x}.have, go, sum(tokens * least(1, u)) OVER (PARTITION BY {x}) AS now FROM w{n} JOIN t_{x} USING ({x}), g{turn}"
            new = "u * CASE WHEN now > 0 THEN want / now ELSE 1 END"
            off.append(f"SELECT CASE WHEN want > 0 THEN abs(now / want - 1) END AS off FROM w{n + 1}")
            steps.append(f"w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, now, want, CASE WHEN NOT go THEN u WHEN want >= have THEN greatest(1, {new}) ELSE {new} END AS u FROM ({step}))")
            n += 1
        steps.append(f"g{turn + 1} AS MATERIALIZED (SELECT any_value(go) AND coalesce(max(off), 0) > {tolerance} AND coalesce(max(off), 0) <= {1 - gain} * any_value(worst) AS go, coalesce(max(off), 0) AS worst FROM ({' UNION ALL '.join(off)}), g{turn})")
    steps.append(f"p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1, u) ELSE {fraction} END AS probability FROM w{n})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, topic, n_tokens, round(probability, 9) AS probability, CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < probability AS kept FROM d JOIN p USING (source, lang, topic)"


ORACLE_SQL = _oracle()
