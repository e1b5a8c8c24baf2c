"""Streams give what batches do."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import telemetry
from loomgraph.sources.projection import usage
from loomgraph.streaming import ingest
from loomgraph.streaming import telemetry as live

SF = "/root/testdata/sf0.001"


def drained(df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


@pytest.fixture
def stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    usage(events).repartition(3).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    return spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), log


def test_sessions(stream):
    rows = drained(live.session_windows(stream[0]), "sessions", "complete")
    batch = telemetry.sessions(stream[1]).groupBy("session").agg(F.count("*").alias("events"), F.sum("tokens").alias("tokens"), F.unix_micros(F.min("ts")).alias("start_us"))
    assert sorted(map(tuple, rows.select("start_us", "events", "tokens").collect())) == sorted(map(tuple, batch.select("start_us", "events", "tokens").collect()))


def test_windows(stream):
    rows = drained(live.velocity_windows(stream[0]), "windows", "complete")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, telemetry.windows(stream[1]).collect()))


def test_incremental_ingestion(spark, tmp_path):
    store, seen = ingest.Store(spark, str(tmp_path / "store"), "path string, hash string"), []
    run = ingest.apply_changes(store, on_change=lambda rows: seen.append(sorted(r["path"] for r in rows.collect())))
    batch = lambda *rows: spark.createDataFrame(rows, "path string, hash string, deleted boolean, version long")
    run(batch(("a", "1", False, 1), ("b", "1", False, 1), ("a", "2", False, 2)), 0)
    run(batch(("a", "2", False, 3)), 1)
    run(batch(("b", None, True, 4), ("c", "1", False, 4)), 2)
    assert sorted(map(tuple, store.read().collect())) == [("a", "2"), ("c", "1")]
    assert seen == [["a", "b"], ["b", "c"]]


def test_sessions_of_any_length_have_a_hash(spark):
    # three sessions: of one event, of 31 and of 25,000, which come in several batches; two events at a time
    times = [0, *(10_000 + 60 * (i // 2) for i in range(31)), *(1_000_000 + i // 2 for i in range(25_000))]
    rows = spark.range(len(times)).join(spark.createDataFrame(list(enumerate(times)), "id long, s long"), "id")
    u = rows.select(F.col("id").alias("event_id"), F.timestamp_seconds("s").alias("ts"), F.lit("a").alias("mode"), F.lit(1).alias("tokens"), F.lit(False).alias("empty"))
    got = {r["session"]: (r["events"], r["hash"]) for r in telemetry.session_summary(u).collect()}
    stamp = lambda part: hashlib.md5("|".join(str(1_000_000 * t) for t in part).encode()).hexdigest()[:8]
    assert got == {1: (1, stamp(times[:1])), 2: (31, stamp(times[1:32])), 3: (25_000, stamp(times[32:]))}
