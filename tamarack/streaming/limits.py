"""Sliding-log rate limits as a stream with timers and expiring state.

A request is decided once the watermark has passed it, so requests that arrive out of order are decided in order of time
(ties by id), as the batch form does; the watermark has passed it when the slot of SLOT seconds that it falls in is over. Until
then it waits in its key's state, in chunks of at most CHUNK requests in order: a key's requests of a batch are few reads and
writes of state and one timer. Due chunks are merged, each read when the order comes to it, so what is in memory are the
chunks of one key that overlap in time and the times that the log holds (at most `limit`). Once nothing waits and the last
allowed time has left the window, a timer drops the key's state.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLOT, CHUNK = 60, 2000
OUTPUT = "key string, id long, s double, allowed boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _end(s: float) -> float:
    """When the slot of a time is over."""
    return (s // SLOT + 1) * SLOT


class SlidingLog(StatefulProcessor):
    """Decides (key, id, s): allowed if fewer than `limit` requests were allowed in the `width` seconds before it; denied
    requests leave no trace."""

    def __init__(self, limit: int, width: float) -> None:
        self.limit, self.width = limit, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first double, n long", "rows string")
        self.log = handle.getValueState("log", "times array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs() / 1000, None
        for part in rows:
            pairs = sorted(zip(part["s"].tolist(), part["id"].tolist(), strict=True))
            late = [x for x in pairs if _end(x[0]) <= passed]  # its slot is decided already: it is decided now, by the log as it is
            if late:
                yield self._decided(key, late)
            if len(late) < len(pairs):
                self._wait(pairs[len(late):])
                first = pairs[len(late)][0] if first is None else min(first, pairs[len(late)][0])
        if first is not None:
            self.handle.registerTimer(int(_end(first) * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) / 1000
        chunks = sorted((float(k[0]), int(k[1])) for k in self.waiting.keys())
        due, left = [], []
        for row in self._in_order([c for c in chunks if _end(c[0]) <= now], now, left):
            due.append(row)
            if len(due) == CHUNK:
                yield self._decided(key, due)
                due = []
        if due:
            yield self._decided(key, due)
        for rest in left:
            self._wait(rest)
        firsts = [c[0] for c in chunks if _end(c[0]) > now] + [rest[0][0] for rest in left]
        if firsts:
            self.handle.registerTimer(int(_end(min(firsts)) * 1000))
            return
        log = list(self.log.get()[0]) if self.log.exists() else []
        if log and log[-1] + self.width <= now:
            self.log.clear()

    def _wait(self, pairs: list) -> None:
        """Stores sorted requests as chunks."""
        for a in range(0, len(pairs), CHUNK):
            n, first = 0, pairs[a][0]
            while self.waiting.containsKey((first, n)):
                n += 1
            self.waiting.updateValue((first, n), (json.dumps(pairs[a : a + CHUNK]),))

    def _in_order(self, chunks: list, now: float, left: list) -> Iterator[tuple]:
        """The requests of the chunks whose slots end by `now`, in order of time and id, out of the state; what the chunks hold
        of later ones goes to `left`. A chunk is read when the order has come to its first request."""
        open_rows: list = []
        for i in range(len(chunks) + 1):
            begin = chunks[i][0] if i < len(chunks) else math.inf
            while open_rows and open_rows[0][0] < begin:
                s, id_, number, at, rows = heapq.heappop(open_rows)
                if _end(s) > now:
                    left.append(rows[at:])
                    continue
                yield s, id_
                if at + 1 < len(rows):
                    heapq.heappush(open_rows, (*rows[at + 1], number, at + 1, rows))
            if i < len(chunks):
                rows = [tuple(x) for x in json.loads(self.waiting.getValue(chunks[i])[0])]
                self.waiting.removeKey(chunks[i])
                heapq.heappush(open_rows, (*rows[0], i, 0, rows))

    def _decided(self, key, rows: list) -> pd.DataFrame:
        log, out = list(self.log.get()[0]) if self.log.exists() else [], []
        for s, i in rows:
            log = [t for t in log if t > s - self.width]
            allowed = len(log) < self.limit
            out.append((key[0], i, s, allowed))
            if allowed:
                log.append(s)
        if log:
            self.log.update((log,))
            self.handle.registerTimer(int((log[-1] + self.width) * 1000) + 1)
        return pd.DataFrame(out, columns=["key", "id", "s", "allowed"])

    def close(self) -> None:
        pass


def limited(requests: DataFrame, limit: int, width: float, late: str = "0 seconds") -> DataFrame:
    """A stream of (key, id, ts) as decided requests (OUTPUT), in append mode. Needs the RocksDB state store (ROCKS).
    Rows without key or time are dropped; what comes more than `late` behind the newest is dropped as late."""
    rows = requests.where("key is not null and ts is not null").withWatermark("ts", late)
    shaped = rows.select(F.col("key").cast("string").alias("key"), "id", (F.unix_micros("ts") / 1e6).alias("s"), "ts")
    return shaped.groupBy("key").transformWithStateInPandas(SlidingLog(limit, width), OUTPUT, "Append", "EventTime")
