"""What is public and not yet archived: a registry that a successful burst drains and a failed one leaves.

State is kept by key (a shard of stories, so small): pending events by time, and registered stories.  Events wait for the
watermark and are applied in the order of time and number, so batches and the order within them change nothing, as long as no event is
later than the watermark allows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PUBLIC, DRAIN, FAILED = "public", "drain", "failed"
OUT = "key long, burst long, story long, seen timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Registry(StatefulProcessor):
    """Rows: seq, at_us, kind, story. A drain gives one row for each registered story and clears; a failed one does nothing.

    Pending events are kept by stretch of time, each with one timer at its end, so state is read and written once for a
    stretch and not for an event.
    """

    def __init__(self, stretch_ms: int):
        self.stretch = stretch_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "stretch long", "events string")
        self.registered = handle.getValueState("registered", "stories string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list] = {}
        for batch in rows:
            for at, seq, kind, story in zip(*(batch[c].tolist() for c in ("at_us", "seq", "kind", "story"))):
                fresh.setdefault(at // (1000 * self.stretch), []).append([at, seq, kind, story])
        for stretch, events in fresh.items():
            if self.pending.containsKey((stretch,)):
                events = json.loads(self.pending.getValue((stretch,))[0]) + events
            else:
                self.handle.registerTimer((stretch + 1) * self.stretch)
            self.pending.updateValue((stretch,), (json.dumps(events),))
        yield self.archived(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        place = (expiredTimerInfo.getExpiryTimeInMs() // self.stretch - 1,)
        stories = json.loads(self.registered.get()[0]) if self.registered.exists() else {}
        out = []
        for at, seq, kind, story in sorted(json.loads(self.pending.getValue(place)[0])):
            if kind == PUBLIC:
                stories[str(story)] = at
            elif kind == DRAIN:
                out += [(key[0], seq, int(s), seen) for s, seen in stories.items()]
                stories = {}
        self.pending.removeKey(place)
        self.registered.update((json.dumps(stories),))
        yield self.archived(key, out)

    @staticmethod
    def archived(key, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["key", "burst", "story", "seen"])
        return frame.astype({"key": "int64", "burst": "int64", "story": "int64"}).assign(seen=pd.to_datetime(frame["seen"], unit="us"))

    def close(self) -> None:
        pass


def drained(events: DataFrame, late: str = "1 hour", stretch_ms: int = 3_600_000) -> DataFrame:
    """(key, burst, story, seen) of a stream of events (key, seq, ts, kind, story): what each successful burst archives."""
    rows = events.withWatermark("ts", late).select("key", "seq", "ts", F.unix_micros("ts").alias("at_us"), "kind", "story")
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy("key").transformWithStateInPandas(Registry(stretch_ms), OUT, "Append", "EventTime")
