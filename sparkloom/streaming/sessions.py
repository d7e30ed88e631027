"""Streaming operators: keyed state with time-outs, event-time windows, upserting sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators import usage as U

#: Characters a turn may read, and a single read.
TURN_BUDGET, READ_LIMIT, PREVIEW = 60_000, 20_000, 500
#: Quiet time after which a session's state goes.
QUIET_MS = 900_000


def rate_limited(requests: DataFrame, key: str, seconds: int, limit: int, lateness: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Requests a key and fixed window; state of a window goes when it can get no more rows."""
    stream = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return stream.groupBy(key, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("requests")).select(key, F.col("w.start").alias("window_start"), "requests", (F.col("requests") > limit).alias("limited"))


def once(events: DataFrame, key: str, ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """The first delivery of each event id."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def _folder(spark, folder: str):
    """The file system of a folder, and what makes paths of names in it."""
    jvm = spark.sparkContext._jvm
    path = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join([folder, *names]))
    return path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _versions(spark, folder: str) -> dict[int, list[int]]:
    """Finished versions of each bucket, oldest first."""
    fs, path = _folder(spark, folder)
    found: dict[int, list[int]] = {}
    if not fs.exists(path()):
        return found
    finished = (s.getPath().getName() for s in fs.listStatus(path()) if fs.exists(path(s.getPath().getName(), "_SUCCESS")))
    for version in sorted(int(name[1:]) for name in finished if name.startswith("v")):
        for s in fs.listStatus(path(f"v{version}")):
            if s.getPath().getName().startswith("_bucket="):
                found.setdefault(int(s.getPath().getName().partition("=")[2]), []).append(version)
    return found


def upsert_sink(folder: str, keys: list[str], order: str, buckets: int = 64):
    """A ``foreachBatch`` function that keeps the newest row a key in ``folder``.

    Rows lie in buckets by a hash of their key, and a batch writes a new version of the buckets it
    touches only. It reads versions older than itself, so a batch that is run again writes the same;
    a version counts once it is whole, and of each bucket the two newest versions stay.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = {r[0] for r in fresh.select("_bucket").distinct().collect()}  # ``buckets`` at most
        if not touched:
            return
        found = {b: [v for v in versions if v < number] for b, versions in _versions(spark, folder).items()}
        before = [f"{folder}/v{found[b][-1]}/_bucket={b}" for b in sorted(touched) if found.get(b)]
        rows = fresh
        if before:
            old = spark.read.schema(batch.schema).parquet(*before)
            rows = old.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).unionByName(fresh)
        U.latest(rows, keys, F.desc(order)).repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(f"{folder}/v{number}")
        fs, path = _folder(spark, folder)
        for b in touched:
            for v in found.get(b, [])[:-1]:
                fs.delete(path(f"v{v}", f"_bucket={b}"), True)

    return write


def read_upserted(spark, folder: str) -> DataFrame:
    """The newest version of every bucket."""
    return spark.read.parquet(*[f"{folder}/v{versions[-1]}/_bucket={b}" for b, versions in sorted(_versions(spark, folder).items())])


OUT = "session string, seq long, file string, mode string, served long, used long"
STATE = "turn string, terms string, used long, files array<string>, sizes array<long>, known array<string>, words array<string>"


def read_modes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What each read of a session gets, in order: a pointer to an earlier turn that read the file for a query
    with a word in common, a preview of what the turn has already served (more than that is read
    again), nothing once the turn's budget is used up, or the text. A new query begins a new turn."""
    turn, terms, used, files, sizes, known, words = state.get if state.exists else ("", "", 0, [], [], [], [])
    seen, before = dict(zip(files, sizes)), dict(zip(known, words))
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for r in rows.itertuples():
        if r.query != turn:
            before.update(dict.fromkeys(seen, terms))
            turn, terms, used, seen = r.query, r.terms, 0, {}
        wanted = min(int(r.chars), READ_LIMIT)
        if set(before.get(r.file, "").split()) & set(terms.split()):
            mode, served = "cross_turn_pointer", 0
        elif used >= TURN_BUDGET:
            mode, served = "budget_exhausted", 0
        elif seen.get(r.file, -1) >= wanted:
            mode, served = "dedupe_preview", min(wanted, PREVIEW, TURN_BUDGET - used)
        else:
            mode, served = "full", min(wanted, TURN_BUDGET - used)
            seen[r.file] = max(seen.get(r.file, 0), served)
        used += served
        out.append((key[0], r.seq, r.file, mode, served, used))
    state.update((turn, terms, used, list(seen), list(seen.values()), list(before), list(before.values())))
    state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + QUIET_MS)
    yield pd.DataFrame(out, columns=["session", "seq", "file", "mode", "served", "used"])


def session_reads(requests: DataFrame) -> DataFrame:
    """Streaming reads (session, seq, ts, query, file, chars) with their outcome; a session that is
    quiet for 15 minutes of event time is forgotten."""
    query = F.coalesce("query", F.lit(""))
    timed = requests.withColumns({"ts": F.col("ts").cast("timestamp"), "query": query, "terms": T.query_key(query)}).withWatermark("ts", "10 minutes")
    return timed.groupBy("session").applyInPandasWithState(read_modes, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def subscription_state(events: DataFrame) -> DataFrame:
    """(sub_id, status, renews_at): the state after each subscription's last event; a delivery that
    comes twice counts once, and events that come out of order are put in order first."""
    status = F.when(F.col("event").isin("created", "resumed", "payment_success", "unpaused"), "active").when(F.col("event") == "cancelled", "cancelled").when(F.col("event") == "paused", "paused").when(F.col("event") == "payment_failed", "past_due").when(F.col("event") == "expired", "expired")
    first = events.dropDuplicates(["event_id"]).withColumn("status", status).filter("status IS NOT NULL")
    return first.groupBy("sub_id").agg(F.max_by(F.struct("status", "renews_at"), F.struct("ts", "event_id")).alias("x")).select("sub_id", "x.status", "x.renews_at")
