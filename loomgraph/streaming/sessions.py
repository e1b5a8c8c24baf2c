"""Sessions of usage logs as a stream with state: the rules of operators.tasks, event by event.

Each log (by repository) has a state of open stretches: the times between which
events lie no more than the gap apart, their counts, and the events themselves as
long as they are few enough to be a session of a person; a longer stretch gives up
its events and keeps its count.  An event that comes late, within the watermark,
joins the stretches that it lies between.  A timer closes a stretch once the
watermark is past the gap behind it, when no event can reach it any more.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tasks import MOST, described, entry_mode
from ..operators.telemetry import GAP
from .store import Store
from .telemetry import LATE

_STRETCH = "start_us long, end_us long, events long, tokens long, empties long, details string"
#: What a session has before its rules are applied.
CLOSED = "repo long, start_us long, end_us long, events long, tokens long, empties long, details string"
_DETAILS = "array<struct<us:long,event_id:long,mode:string,label:string>>"


def merged(stretches: list[dict], gap: int = GAP, most: int = MOST) -> list[dict]:
    """Stretches in order, those no more than the gap apart as one; details go beyond most events."""
    out: list[dict] = []
    for s in sorted(stretches, key=lambda s: (s["start_us"], s["end_us"])):
        if out and s["start_us"] - out[-1]["end_us"] <= gap * 1_000_000:
            last = out[-1]
            last["end_us"] = max(last["end_us"], s["end_us"])
            last |= {k: last[k] + s[k] for k in ("events", "tokens", "empties")}
            last["details"] = [*last["details"], *s["details"]] if last["events"] <= most else []
        else:
            out.append(dict(s))
    return out


class Stretches(StatefulProcessor):
    """The open stretches of one log; closed ones of up to MOST events come out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _STRETCH)

    def _load(self) -> list[dict]:
        return [dict(zip(("start_us", "end_us", "events", "tokens", "empties"), s[:5])) | {"details": json.loads(s[5])} for s in self.open.get()]

    def _keep(self, stretches: list[dict]) -> None:
        if stretches:
            self.open.put([(s["start_us"], s["end_us"], s["events"], s["tokens"], s["empties"], json.dumps(s["details"])) for s in stretches])
            # milliseconds, and one more, as a gap of exactly GAP seconds doesn't end a stretch
            self.handle.registerTimer(min(s["end_us"] for s in stretches) // 1000 + GAP * 1000 + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = [
            {"start_us": r.us, "end_us": r.us, "events": 1, "tokens": r.tokens or 0, "empties": int(bool(r.empty)), "details": [[r.us, r.event_id, r.mode, r.label]]}
            for r in rows
        ]
        self._keep(merged([*self._load(), *came]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        past, left = timerValues.getCurrentWatermarkInMs() * 1000 - GAP * 1_000_000, []
        for s in self._load():
            if s["end_us"] >= past:
                left.append(s)
            elif s["events"] <= MOST:
                details = json.dumps([dict(zip(("us", "event_id", "mode", "label"), x)) for x in sorted(s["details"], key=lambda x: x[:2])])
                yield Row(repo=key[0], start_us=s["start_us"], end_us=s["end_us"], events=s["events"], tokens=s["tokens"], empties=s["empties"], details=details)
        self._keep(left)

    def close(self) -> None:
        pass


def closed_sessions(usage: DataFrame, late: str = LATE) -> DataFrame:
    """repo, start_us, end_us, events, tokens, empties, context_modes, task_type and session_hash of sessions that have ended; usage: ts, event_id, repo, mode, tokens, empty.  The session's state lies in RocksDB."""
    usage.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    column = lambda name: F.col(name) if name in usage.columns else F.lit(None).cast("string")
    rows = usage.withWatermark("ts", late).select(
        F.col("repo").cast("long").alias("repo"), "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"),
        entry_mode(F.col("mode"), column("tool")).alias("mode"), column("task_type").alias("label"), F.col("tokens").cast("long").alias("tokens"), "empty",
    )
    ended = rows.groupBy("repo").transformWithState(statefulProcessor=Stretches(), outputStructType=CLOSED, outputMode="Append", timeMode="EventTime")
    return described(ended.withColumn("_e", F.from_json("details", _DETAILS)).drop("details"))


#: Columns of recorded tasks; a task's key is its log and its hash.
TASKS = "key string, repo long, start_us long, end_us long, events long, tokens long, empties long, context_modes string, task_type string, session_hash string"


def task_store(spark: SparkSession, folder: str) -> Store:
    return Store(spark, folder, {"tasks": TASKS}, {"tasks": ("key",)})


def recorded(store: Store) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that records closed sessions, each hash of a log once, whatever comes again."""

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("key", F.concat_ws("/", F.coalesce(F.col("repo").cast("string"), F.lit("")), "session_hash")).dropDuplicates(["key"])
        new = rows.join(store.read("tasks").select("key"), "key", "left_anti")
        store.apply(number, new.select(F.col("key").alias("path")), tasks=new)

    return run
