"""State of runs from a stream of events: bounded state, and a collection that holds every run.

The stream keeps the last state of runs that are on their way. A timer drops a run some time after
its end, or after its last event, so what is kept goes with the runs of that time and not with all runs
ever. Changes go to a collection keyed by run, where a row only gives way to one that comes after it; so an
event that comes once its run was dropped, a replayed batch and a batch pass agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.runs import TERMINAL
from ..sources import collection

_FIELDS = "final boolean, ts timestamp, event_id long, state string"
CHANGES = f"parse_run_id string, {_FIELDS}"
#: A row of a run gives way to one that is greater by these.
_LATER = ("final", "ts", "event_id", "state")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunStates(StatefulProcessor):
    """Last state of each run; a terminal one wins over others, as ``runs.latest_state`` says."""

    def __init__(self, after_end_ms: int, idle_ms: int):
        self.after_end_ms, self.idle_ms = after_end_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _FIELDS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.last.get()) if self.last.exists() else None
        now = before
        for part in rows:
            for row in part[list(_LATER)].itertuples(index=False, name=None):
                row = (bool(row[0]), pd.Timestamp(row[1]).to_pydatetime(), int(row[2]), row[3])
                if now is None or row > now:
                    now = row
        if now == before:
            return
        self.last.update(now)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(now[1]).timestamp() * 1000) + (self.after_end_ms if now[0] else self.idle_ms))
        yield pd.DataFrame([(key[0], *now)], columns=["parse_run_id", *_LATER])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def state_changes(events: DataFrame, late: str = "10 minutes", after_end_ms: int = 3_600_000, idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """Changes of runs from a stream of events (parse_run_id, state, ts, event_id), for update mode.

    Events without a run, time or state are left out. Needs RocksDB as state store, which ``stream_states`` sets.
    """
    known = events.filter("parse_run_id is not null and ts is not null and state is not null")
    rows = known.select("parse_run_id", F.col("state").isin(*TERMINAL).alias("final"), "ts", F.coalesce(F.col("event_id").cast("long"), F.lit(0)).alias("event_id"), "state")
    return rows.withWatermark("ts", late).groupBy("parse_run_id").transformWithStateInPandas(RunStates(after_end_ms, idle_ms), CHANGES, "Update", "EventTime")


def merge_states(path: str):
    """For ``foreachBatch``: put changes into the collection at ``path``, where each run keeps its greatest row."""

    def each(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        rows.persist()
        held = collection.lookup(spark, path, rows, "parse_run_id").select(rows.columns) if collection.versions(spark, path) else rows.limit(0)
        best = F.max(F.struct(*_LATER)).alias("b")
        collection.upsert_collection(spark, rows.unionByName(held).groupBy("parse_run_id").agg(best).select("parse_run_id", "b.*"), path, "parse_run_id")
        rows.unpersist()

    return each


def stream_states(events: DataFrame, path: str, checkpoint: str, **bounds) -> StreamingQuery:
    """Keep the collection at ``path`` up to date with a stream of events; see ``state_changes`` for ``bounds``."""
    spark = events.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # a query keeps the store that it starts with
    try:
        changes = state_changes(events, **bounds)
        return changes.writeStream.outputMode("update").foreachBatch(merge_states(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return collection.read_collection(spark, path).select("parse_run_id", "state", "ts", "final")
