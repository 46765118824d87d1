"""Streams of several runs: windows and timers, resumption after a failure, counters and rings."""

import datetime
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from factloom.functions.runs import Limits, Run
from factloom.operators import ingest
from factloom.streaming import recent, windows
from factloom.streaming.ledger import Ledger, run_in_slices, undrained


def closed(limits, turns):
    run = Run(limits)
    return [w for t in turns for w in run.add(*t)] + run.end()


@pytest.mark.parametrize(
    ("limits", "wanted"),
    [
        (Limits(10, 9), [(0, 0, 1, 2, 8, "max_tokens"), (1, 2, 2, 1, 20, "max_tokens"), (2, 3, 4, 2, 8, "session_end")]),
        (Limits(99, 2), [(0, 0, 1, 2, 8, "max_turns"), (1, 2, 3, 2, 24, "max_turns"), (2, 4, 4, 1, 4, "session_end")]),
        (Limits(99, 3, overlap=1), [(0, 0, 2, 3, 28, "max_turns"), (1, 2, 4, 3, 28, "max_turns"), (2, 4, 4, 1, 4, "session_end")]),
        (Limits(99, 9, most_chars=25), [(0, 0, 1, 2, 8, "max_chars"), (1, 2, 2, 1, 20, "max_chars"), (2, 3, 4, 2, 8, "session_end")]),
    ],
)
def test_limits_close_windows(limits, wanted):
    assert closed(limits, [(0, 4, 10), (1, 4, 10), (2, 20, 30), (3, 4, 10), (4, 4, 10)]) == wanted


def test_batch_windows_take_overlap_and_characters(spark):
    turns = spark.createDataFrame([("u", "s", k, "x" * 40) for k in range(5)] + [("u", "s", 9, "  "), ("u", "t", 0, None)], "user_id string, session_id string, idx long, content string")
    found = ingest.extract_windows(turns, Limits(1000, 12, 100, 1)).orderBy("window").collect()
    assert [(r["first_idx"], r["last_idx"], r["reason"]) for r in found] == [(0, 1, "max_chars"), (1, 2, "max_chars"), (2, 3, "max_chars"), (3, 4, "session_end")]


def stream(spark, folder, schema, make, mode, ledger, after=None):
    read = make(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    return read.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(ledger.sink(after)).start()


def test_idle_sessions_close_by_timer_or_by_their_next_turn(spark, tmp_path):
    at = {"a": [1, 2, 3], "b": [2, 500], "c": [990, 991], "d": [1, 400, 401]}  # seconds; idle after 60
    rows = [("u", s, k, 5, 10, 1000 * t) for s, times in at.items() for k, t in enumerate(times)]
    df = spark.createDataFrame(rows, "user_id string, session_id string, idx long, cost long, chars long, ms long").withColumn("time", F.timestamp_millis("ms"))
    ledger = Ledger(spark, f"{tmp_path}/out")
    make = lambda s: windows.extract_windows(s, Limits(100, 2, overlap=0), "time", "1 second", 60_000)
    with windows.state_store(spark):
        run_in_slices(df, f"{tmp_path}/in", [300_000, 600_000], "ms", lambda k: stream(spark, tmp_path, df.schema, make, "append", ledger))
    found = sorted((r["session_id"], r["first_idx"], r["last_idx"], r["window"], r["reason"]) for r in ledger.read().collect())
    ends = "session_end"
    assert found == [("a", 0, 1, 0, "max_turns"), ("a", 2, 2, 1, ends), ("b", 0, 0, 0, ends), ("b", 1, 1, 0, ends), ("c", 0, 1, 0, "max_turns"), ("d", 0, 0, 0, ends), ("d", 1, 2, 0, "max_turns")]


def test_a_batch_that_is_written_twice_counts_once(spark, tmp_path):
    df = spark.createDataFrame([(k,) for k in range(30)], "id long")
    ledger, failed = Ledger(spark, f"{tmp_path}/out"), []

    def fail(batch):
        if batch == 1 and not failed:
            failed.append(ledger.read().count())  # written and marked, not committed by the stream
            raise RuntimeError("stopped")

    with pytest.raises(StreamingQueryException):
        df.where("id < 10").write.mode("append").parquet(f"{tmp_path}/in")
        stream(spark, tmp_path, df.schema, lambda s: s, "append", ledger, fail).awaitTermination()
        df.where("id between 10 and 19").write.mode("append").parquet(f"{tmp_path}/in")
        stream(spark, tmp_path, df.schema, lambda s: s, "append", ledger, fail).awaitTermination()
    df.where("id >= 20").write.mode("append").parquet(f"{tmp_path}/in")
    stream(spark, tmp_path, df.schema, lambda s: s, "append", ledger, fail).awaitTermination()
    assert failed == [20]
    assert sorted(r["id"] for r in ledger.read().collect()) == list(range(30))


def test_batches_without_a_mark_are_not_read(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.write(spark.range(3), 0)
    spark.range(5).write.parquet(f"{tmp_path}/data/batch=1")  # a writer died here
    assert ledger.read().count() == 3
    ledger.write(spark.range(7), 1)
    assert ledger.read().count() == 10


def test_drained_counts_are_taken_off(spark):
    counters = spark.createDataFrame([("a", 5), ("b", 2), ("c", 1)], "k string, n_new long")
    drained = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, n long")
    assert sorted(map(tuple, undrained(counters, drained, "k").collect())) == [("a", 2), ("c", 1)]


def test_a_ring_holds_the_last_samples_in_any_order_of_arrival(spark, tmp_path):
    rows = [("a", 5, 0, 1.0, 0), ("a", 3, 0, 9.0, 0), ("a", 4, 0, None, 1), ("a", 1, 0, 50.0, 1), ("a", 5, 0, 1.0, 1), ("b", 1, 0, None, 0)]
    df = spark.createDataFrame(rows, "k string, at long, id long, value double, arrived long")
    ledger = Ledger(spark, f"{tmp_path}/out")
    with windows.state_store(spark):
        run_in_slices(df, f"{tmp_path}/in", [1], "arrived", lambda n: stream(spark, tmp_path, df.schema, lambda s: recent.ring(s.drop("arrived"), ["k"], 3), "update", ledger))
    found = {r["k"]: r for r in ledger.latest("k").collect()}
    assert [(found[k]["n"], found[k]["first"], found[k]["last"], found[k]["least"], found[k]["most"]) for k in "ab"] == [(3, 3, 5, 1.0, 9.0), (1, 1, 1, None, None)]


def test_late_facts_are_closed_in_the_order_of_their_keys_however_many_come_at_once(spark, tmp_path):
    from factloom.plans import streams

    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(hours=rng.randrange(24 * 29)), k % 2, "view", 1.0, "{}") for k in rng.sample(range(400), 120)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        found = sorted((r["user_id"], r["loser"], r["winner"], r["valid_until"]) for r in streams.stream_supersede(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    heads, wanted = {}, []
    micros = lambda ts: (ts - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    slices = [(sum(micros(ts) + e % 7 * streams.LATE >= d for d in streams.DAYS), micros(ts), f"f{e:012d}", f"u{u}") for e, ts, u, *_ in rows]
    for _, at, fact, user in sorted(slices):
        old = heads.get(user)
        heads[user] = max((at, fact), old or (at, fact))
        if old:
            loser, winner = sorted([old, (at, fact)])
            wanted.append((user, loser[1], winner[1], winner[0]))
    assert found == sorted(wanted)


def test_a_batch_of_heads_that_comes_again_writes_the_same(spark, tmp_path):
    from factloom.streaming import state

    closed, heads = Ledger(spark, f"{tmp_path}/out"), Ledger(spark, f"{tmp_path}/heads")
    put = state.superseding(closed, heads, ["k"])
    batches = [[("a", 5, "x"), ("a", 5, "x"), ("b", 1, "y")], [("a", 3, "w"), ("a", 5, "x"), ("a", 7, "z")], [("a", 6, "v"), ("b", 2, "u")], [("a", 9, "t")]]
    for n, rows in enumerate(batches):
        for _ in range(2):
            put(spark.createDataFrame(rows, "k string, valid_from long, fact_id string"), n)
    assert sorted(tuple(r) for r in closed.read().drop("batch").collect()) == [("a", "v", "z", 7), ("a", "w", "x", 5), ("a", "x", "z", 7), ("a", "z", "t", 9), ("b", "y", "u", 2)]
    assert {r["batch"] for r in heads.marks().collect()} == {2, 3}
