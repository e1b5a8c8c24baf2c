"""Tasks inferred from sessions: the rules, and the stream against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import tasks
from loomgraph.streaming import sessions

USAGE = "event_id long, repo long, us long, mode string, tool string, tokens int, empty boolean, task_type string"


def log(spark, rows):
    return spark.createDataFrame(rows, USAGE).withColumn("ts", F.timestamp_micros("us"))


def entries(repo, modes, start=0, step=60, **more):
    """Events a minute apart: (mode, tool) or mode."""
    out = []
    for i, m in enumerate(modes):
        mode, tool = m if isinstance(m, tuple) else (m, None)
        out.append((1000 * repo + len(out) + start, repo, (start + i * step) * 1_000_000, mode, tool, 10, more.get("empty", lambda i: False)(i), more.get("label", lambda i: None)(i)))
    return out


def said(spark, rows=()):
    return spark.createDataFrame(list(rows), "repo long, us long, helpful boolean").withColumn("ts", F.timestamp_micros("us"))


def found(spark, rows, feedback=(), **more):
    made = tasks.session_tasks(log(spark, rows), said(spark, feedback), **more)
    return {(r["repo"], r["start_us"] // 1_000_000): r for r in made.collect()}


def test_task_types_and_modes(spark):
    rows = (
        entries(1, ["overview", "focus", "focus", "dead", "stats"]) + entries(2, ["stats", "report"]) + entries(3, ["hotspots", "diff"])
        + entries(4, [(None, "blast_radius"), (None, "index_repo"), ("", "strange_tool")]) + entries(5, ["focus", "focus"], label=lambda i: ["null", "bugfix"][i])
        + entries(6, ["unheard"]) + entries(7, ["focus"] * 31) + entries(8, ["focus"] * 30)
    )
    made = found(spark, rows)
    assert {k[0]: (r["task_type"], r["context_modes"], r["events"]) for k, r in made.items()} == {
        1: ("code_navigation", "overview,focus,dead", 5), 3: ("refactor", "hotspots,diff", 2), 4: ("code_navigation", "blast,strange_tool", 3),
        5: ("bugfix", "focus", 2), 6: ("general", "unheard", 1), 8: ("code_navigation", "focus", 30),
    }


def test_success_by_feedback_or_by_results(spark):
    half = entries(1, ["focus"] * 4, empty=lambda i: i < 2) + entries(2, ["focus"] * 4, empty=lambda i: i < 1) + entries(3, ["focus"] * 4, empty=lambda i: True)
    assert {k[0]: r["success"] for k, r in found(spark, half).items()} == {1: False, 2: True, 3: False}
    end = 180
    near = [(2, (end + 3600) * 1_000_000, False), (3, (end - 3600) * 1_000_000, True), (3, end * 1_000_000, False), (1, (end + 3601) * 1_000_000, True)]
    assert {k[0]: r["success"] for k, r in found(spark, half, near).items()} == {1: False, 2: False, 3: True}


def test_sessions_split_after_the_gap_and_known_ones_go(spark):
    rows = entries(1, ["focus", "dead"], step=1200) + entries(1, ["diff"], start=1200 + 1201)
    made = found(spark, rows)
    assert {k[1]: r["events"] for k, r in made.items()} == {0: 2, 2401: 1}
    known = spark.createDataFrame([(made[1, 0]["session_hash"],)], "session_hash string")
    assert set(found(spark, rows, known=known)) == {(1, 2401)}


def test_merged_stretches_are_sessions():
    rng = random.Random(7)
    for _ in range(50):
        times = sorted(rng.sample(range(0, 40_000, 100), rng.randint(1, 60)))
        one = lambda t: {"start_us": t * 10**6, "end_us": t * 10**6, "events": 1, "tokens": 2, "empties": 0, "details": [[t]]}
        want, last = [], None
        for t in times:
            if last is None or t - last > 1200:
                want.append([])
            want[-1].append(t)
            last = t
        shuffled = rng.sample(times, len(times))
        state = []
        for at in range(0, len(shuffled), 7):  # in any order, in several batches
            state = sessions.merged([*state, *map(one, shuffled[at : at + 7])])
        assert [(s["start_us"], s["end_us"], s["events"], s["tokens"]) for s in state] == [(w[0] * 10**6, w[-1] * 10**6, len(w), 2 * len(w)) for w in want]
        assert all(sorted(x[0] for x in s["details"]) == w if len(w) <= 30 else s["details"] == [] for s, w in zip(state, want))


def test_the_stream_records_what_the_batch_finds(spark, tmp_path):
    """Over several micro-batches with late rows, keyed by repository; a batch that comes again records nothing twice."""
    rng, rows = random.Random(3), []
    for repo in (1, 2, 3):
        at = 0
        for k in range(120):
            at += rng.choice([30, 60, 300, 1200, 1201, 2400])
            rows.append((1000 * repo + k, repo, at * 1_000_000, rng.choice(["focus", "overview", "dead", "stats", "hotspots"]), None, k, rng.random() < 0.5, None))
    rows += entries(4, ["focus"] * 40, step=20)
    rows.sort(key=lambda r: r[2] + rng.randint(-1500, 1500) * 1_000_000)  # late by less than the watermark allows
    last = max(r[2] for r in rows)
    flush = [(9_000 + i, 9, last + (i + 10) * 10_000 * 1_000_000, "focus", None, 1, False, None) for i in range(2)]
    step = len(rows) // 4 + 1
    for i, part in enumerate([*(rows[at : at + step] for at in range(0, len(rows), step)), flush[:1], flush[1:]]):
        log(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part{i}")
    store = sessions.task_store(spark, f"file://{tmp_path}/tasks")
    schema = log(spark, rows[:1]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    closed = sessions.closed_sessions(stream)
    closed.writeStream.foreachBatch(sessions.recorded(store)).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    columns = ["repo", "start_us", "end_us", "events", "tokens", "empties", "context_modes", "task_type", "session_hash"]
    got = [tuple(r) for r in store.read("tasks").select(*columns).collect() if r["repo"] != 9]
    want = [tuple(r) for r in tasks.session_tasks(log(spark, rows), said(spark)).select(*columns).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20 and 4 not in {r[0] for r in want}
    again = sessions.recorded(store)
    batch = store.read("tasks").drop("key")
    again(batch, store.manifest()["last"] + 1)
    assert store.read("tasks").count() == len(got) + len(store.read("tasks").where("repo = 9").collect())
