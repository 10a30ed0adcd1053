"""Incremental behaviour as Structured Streaming: session rollups, windows, rejection flags, rate limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sinks import AppendLog, latest, run_available

LATE = "10 minutes"


def session_rollup(messages: DataFrame) -> DataFrame:
    """Running message count, characters and assistant turns by session (update mode)."""
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("message_count"), F.sum(F.char_length("text").cast("long")).alias("n_chars"), F.count_if(F.col("role") == "assistant").alias("assistant_turns")
    )


def tumbling_counts(events: DataFrame, key: str, width: str = "60 seconds", time: str = "ts") -> DataFrame:
    """Requests by key and window; those after the watermark are dropped as late."""
    return events.withWatermark(time, LATE).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def session_windows(events: DataFrame, key: str, gap: str = "30 minutes", time: str = "ts") -> DataFrame:
    return events.withWatermark(time, LATE).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def sliding_log(limit: int, width: int) -> Callable:
    """For applyInPandas by key: each request (s, in seconds) with allowed: fewer than `limit` requests were allowed in
    the `width` seconds before it. Denied requests leave no trace. State is the allowed ones inside the window."""

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows, log, out = rows.sort_values(["s", "id"]), [], []
        for s in rows["s"]:
            log = [t for t in log if t > s - width]
            out.append(len(log) < limit)
            if out[-1]:
                log.append(s)
        return rows.assign(allowed=out)

    return decide


def sliding_log_sorted(limit: int, width: int) -> Callable:
    """The same for mapInArrow over (user_id, id, s), of which each partition is sorted by all three: what is kept from
    batch to batch is one user and the times allowed in the window, whatever the number of the user's requests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, log = object(), deque()
        for batch in batches:
            out = []
            for u, s in zip(batch.column("user_id").to_pylist(), batch.column("s").to_pylist(), strict=True):
                if u != user:
                    user, log = u, deque()
                if s is None:  # no time is in no window
                    out.append(True)
                    continue
                while log and log[0] <= s - width:
                    log.popleft()
                out.append(len(log) < limit)
                if out[-1]:
                    log.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, "allowed"])

    return run


def sliding_log_state(limit: int, width: int) -> Callable:
    """The same for applyInPandasWithState: the allowed times of a key are its state."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["s", "id"])
        out = []
        for s in rows["s"]:
            log = [t for t in log if t > s - width]
            out.append(len(log) < limit)
            if out[-1]:
                log.append(float(s))
        state.update((log,))
        yield pd.DataFrame({"key": [key[0]] * len(rows), "id": rows["id"].to_numpy(), "allowed": out})

    return decide


def run_once(stream: DataFrame, mode: str, name: str, checkpoint: str | None = None) -> DataFrame:
    """All available input through a streaming query into a memory table; for tests and small results."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def run_updates(stream: DataFrame, path: str, checkpoint: str, *keyed: str) -> DataFrame:
    """All available input through a streaming query in update mode. A batch appends only the keys that it changed, once, to a
    log below path; the result is the row of each key's last batch. What a batch writes grows with the batch, not with all keys."""
    log = AppendLog(stream.sparkSession, path, stream.schema)
    run_available(stream, log.sink(), checkpoint, "update")
    return latest(log, *keyed)
