"""Bounded retention on a stream: the newest events of each key, kept as state that expires."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakesignal.scale import top_per_key

#: State lists and timers need this provider.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = "at timestamp, event_id string"


def _newest_first(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["at", "event_id"], ascending=False, kind="stable")


class NewestEvents(StatefulProcessor):
    """List state of the ``limit`` newest (at, event_id) per key, with a timer that forgets a key ``idle_seconds`` after its newest event.

    Output rows (key, at, event_id, change, n_held): an event that enters the buffer ("in"), or leaves it because newer
    ones came ("out") or the key was idle ("expired"), and how many the buffer then holds.
    """

    def __init__(self, key: str, limit: int, idle_seconds: float):
        self.key, self.limit, self.idle = key, limit, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)

    def _rows(self, key, rows: pd.DataFrame, change: str, n: int) -> pd.DataFrame:
        out = rows[["at", "event_id"]].copy()
        out.insert(0, self.key, key[0])
        return out.assign(change=change, n_held=n)

    def _stored(self) -> pd.DataFrame:
        rows = list(self.held.get()) if self.held.exists() else []
        return pd.DataFrame({"at": pd.Series([r[0] for r in rows], dtype="datetime64[ns]"), "event_id": pd.Series([r[1] for r in rows], dtype=object)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self._stored()
        new = [r[["at", "event_id"]] for r in rows]
        every = _newest_first(pd.concat([before, *new], ignore_index=True)).drop_duplicates()
        kept = every.iloc[: self.limit]
        names = set(zip(before["at"], before["event_id"]))
        was = pd.Series([pair in names for pair in zip(every["at"], every["event_id"])], index=every.index, dtype=bool)
        entered, left = kept[~was.loc[kept.index]], every.iloc[self.limit :]
        self.held.put([(at.to_pydatetime(), event) for at, event in zip(kept["at"], kept["event_id"])])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        newest = kept["at"].iloc[0].to_pydatetime().replace(tzinfo=timezone.utc)
        self.handle.registerTimer(int((newest.timestamp() + self.idle) * 1000))
        yield pd.concat([self._rows(key, entered, "in", len(kept)), self._rows(key, left[was.loc[left.index]], "out", len(kept))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = self._stored()
        self.held.clear()
        yield self._rows(key, gone, "expired", 0)

    def close(self) -> None:
        pass


def pruned(events: DataFrame, key: str, limit: int) -> DataFrame:
    """``events`` without those that cannot be among a key's newest: each task passes on ``limit`` of a key per batch of rows.

    A key with most of the events is cut down before its rows meet.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _newest_first(batch).groupby(key, sort=False, dropna=False).head(limit)

    return events.mapInPandas(cut, events.schema)


def stream_newest(events: DataFrame, key: str, limit: int = 500, idle_seconds: float = 3600, watermark: str = "10 minutes") -> DataFrame:
    """Changes of every key's buffer for a stream of (key, at, event_id); the session needs STATE_STORE."""
    slim = events.select(key, F.col("at").cast("timestamp").alias("at"), F.col("event_id").cast("string").alias("event_id"))
    schema = T.StructType([slim.schema[key], T.StructField("at", T.TimestampType()), T.StructField("event_id", T.StringType()), T.StructField("change", T.StringType()), T.StructField("n_held", T.IntegerType())])
    processor = NewestEvents(key, limit, idle_seconds)
    marked = pruned(slim, key, limit).withWatermark("at", watermark)
    return marked.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def buffer_of(changes: DataFrame, key: str) -> DataFrame:
    """(key, at, event_id): what the buffers hold after all ``changes``; an event enters and leaves once at most."""
    balance = F.sum(F.when(F.col("change") == "in", 1).otherwise(-1))
    return changes.groupBy(key, "at", "event_id").agg(balance.alias("b")).where("b > 0").drop("b")


def newest_per_key(events: DataFrame, key: str, limit: int = 500) -> DataFrame:
    """The batch form: the ``limit`` newest (key, at, event_id)."""
    rows = events.select(key, "at", F.col("event_id").cast("string").alias("event_id")).distinct()
    return top_per_key(rows, [key], [F.desc("at"), F.desc("event_id")], limit).drop("rank")
