"""Streaming operators give what a batch over the same rows gives."""

from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from sparkloom.operators import usage as U
from sparkloom.streaming import sessions as K


def stream(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_session_reads(spark, tmp_path):
    schema = "session string, seq long, ts timestamp, query string, file string, chars long"
    at = datetime(2024, 1, 1)
    parts = [[("s", 1, at, "q", "a", 15_000), ("s", 2, at, "q", "a", 9_000), ("t", 3, at, "q", "a", 50_000)], [("s", 4, at, "q", "a", 18_000), ("s", 5, at, "r", "a", 100)]]
    q = K.session_reads(stream(spark, tmp_path, parts, schema)).writeStream.format("memory").queryName("reads").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r.seq: (r["mode"], r.served) for r in spark.table("reads").collect()}
    assert got == {1: ("full", 15_000), 2: ("dedupe_preview", 500), 3: ("full", 20_000), 4: ("full", 18_000), 5: ("full", 100)}


class State:
    exists, hasTimedOut, get = False, False, None

    def update(self, x):
        self.get, self.exists = x, True

    def getCurrentWatermarkMs(self):
        return 0

    def setTimeoutTimestamp(self, _):
        pass


def test_files_of_earlier_turns_are_pointed_to_where_words_meet():
    cols = ["session", "seq", "query", "terms", "file", "chars"]
    state = State()
    first = pd.DataFrame([("s", 1, "cache store", "cache store", "a", 100), ("s", 2, "cache store", "cache store", "a", 300)], columns=cols)
    assert next(K.read_modes(("s",), iter([first]), state))["mode"].tolist() == ["full", "full"]  # more than was served is read again
    then = pd.DataFrame([("s", 3, "cache keys", "cache keys", "a", 100), ("s", 4, "cache keys", "cache keys", "b", 100), ("s", 5, "login", "login", "a", 100), ("s", 6, "store", "store", "a", 100)], columns=cols)
    out = next(K.read_modes(("s",), iter([then]), state))
    assert out["mode"].tolist() == ["cross_turn_pointer", "full", "full", "full"] and out.served.tolist() == [0, 100, 100, 100]


def test_budget_runs_out():
    rows = pd.DataFrame([("s", i, "q", "q", f"f{i}", 25_000) for i in range(5)], columns=["session", "seq", "query", "terms", "file", "chars"])
    out = next(K.read_modes(("s",), iter([rows]), State()))
    assert out.served.tolist() == [20_000, 20_000, 20_000, 0, 0] and out["mode"].tolist()[-1] == "budget_exhausted"


def test_upsert_sink_keeps_the_newest(spark, tmp_path):
    schema = "k string, s string, id long, v long"
    parts = [[("a", "x", 1, 10), ("a", "x", 2, 20)], [("a", "x", 3, 30), ("b", "y", 4, 40)]]
    df = stream(spark, tmp_path, parts, schema)
    out = str(tmp_path / "out")
    q = df.writeStream.foreachBatch(K.upsert_sink(out, ["k", "s"], "id")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted(map(tuple, K.read_upserted(spark, out).collect()))
    batch = U.latest(spark.read.schema(schema).parquet(str(tmp_path / "in")), ["k", "s"], F.desc("id"))
    assert got == sorted(map(tuple, batch.collect())) == [("a", "x", 3, 30), ("b", "y", 4, 40)]


def test_upsert_sink_writes_touched_buckets_and_repeats_batches(spark, tmp_path):
    out, schema = str(tmp_path / "out"), "k string, id long"
    write = K.upsert_sink(out, ["k"], "id", buckets=8)
    keys = [f"k{i}" for i in range(20)]
    write(spark.createDataFrame([(k, 0) for k in keys], schema), 0)
    for number in (1, 2, 3, 3):  # the last batch comes twice
        write(spark.createDataFrame([("k7", number)], schema), number)
        assert {r.k: r.id for r in K.read_upserted(spark, out).collect()} == {k: number if k == "k7" else 0 for k in keys}
    write(spark.createDataFrame([], schema), 4)
    held = [v for v in K._versions(spark, out).values() if len(v) > 1]
    assert held == [[2, 3]]


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    schema = "ip string, ts timestamp"
    rows = [("a", datetime(2024, 1, 1, 0, 0, s)) for s in (1, 2, 3)] + [("b", datetime(2024, 1, 1, 0, 2, 0))]
    df = stream(spark, tmp_path, [rows], schema)
    q = K.rate_limited(df, "ip", 60, 2).writeStream.format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(str, spark.table("rates").collect())) == sorted(map(str, U.rate_windows(spark.createDataFrame(rows, schema), "ip", 60, 2).collect()))


def test_subscriptions(spark):
    cols = "event_id string, sub_id string, event string, ts long, renews_at string"
    rows = [("1", "s", "created", 1, "x"), ("3", "s", "resumed", 3, "z"), ("2", "s", "cancelled", 2, "y"), ("2", "s", "cancelled", 2, "y"), ("4", "s", "unknown", 9, "q")]
    r = K.subscription_state(spark.createDataFrame(rows, cols)).first()
    assert (r.status, r.renews_at) == ("active", "z")
