"""Keyed state in event-time order: pairs and predictions are taken in the order of (time, id) per
key, however they arrive inside the watermark.

Arriving rows wait in the key's buffer, chunks of rows of the same ten minutes, until
the watermark has passed them; an event-time timer then releases them in order, ten minutes by ten
minutes, to the running result. A chunk is written once, without reading what waits already, since each
access to the state is a call to the JVM. Spark drops rows that arrive behind the watermark (they are counted in
the query's progress as dropped by watermark): they can't take their place any more. What a key
keeps beside the buffer is small: its position and, for a rolling window, the last rows of it.

State is kept in RocksDB, so a buffer needn't fit in memory; only ten minutes of a key do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
_BUCKET = 600_000_000  # microseconds
#: Rows that are written together.
_ROWS = 100_000


class InEventOrder(StatefulProcessor):
    """Buffers (ts microseconds, id, value) by key and releases them in order. Subclasses keep a
    state of ``STATE`` and turn released rows into results."""

    STATE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getMapState("buffer", "bucket long, chunk long", "ts array<long>, id array<string>, value array<string>")
        self.written = handle.getValueState("written", "chunks long")
        self.kept = handle.getValueState("kept", self.STATE)

    def close(self) -> None:
        pass

    def begin(self) -> tuple:
        """The state of a key before its first row."""
        raise NotImplementedError

    def take(self, key: tuple, state: tuple, ts: np.ndarray, ids: list, values: list) -> tuple[tuple, pd.DataFrame]:
        """The state after these rows, and the results."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, held, chunk = None, [], self.written.get()[0] if self.written.exists() else 0

        def write() -> int:
            """Writes the rows held, a chunk for each bucket; returns the next chunk's number."""
            frame, at = pd.concat(held), chunk
            held.clear()
            for bucket, part in frame.groupby(frame["ts_us"].to_numpy() // _BUCKET):
                self.buffer.updateValue((int(bucket), at), (part["ts_us"].tolist(), part["id"].tolist(), part["value"].tolist()))
                at += 1
            return at

        for frame in rows:
            if len(frame):
                held.append(frame)
                first = int(frame["ts_us"].min()) if first is None else min(first, int(frame["ts_us"].min()))
            if sum(map(len, held)) >= _ROWS:
                chunk = write()
        if held:
            chunk = write()
        if first is not None:
            self.written.update((chunk,))
            self.handle.registerTimer(max(-(-first // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        chunks: dict[int, list] = {}
        for at in self.buffer.keys():
            chunks.setdefault(at[0], []).append((at[0], at[1]))
        state, rest = None, None
        for bucket in sorted(chunks):
            if bucket * _BUCKET > passed:
                rest = bucket * _BUCKET
                break
            ts, ids, values = [], [], []
            for at in chunks[bucket]:
                for all_rows, some in zip((ts, ids, values), self.buffer.getValue(at)):
                    all_rows.extend(some)
            order = sorted(range(len(ts)), key=lambda i: (ts[i], ids[i]))
            n = sum(t <= passed for t in ts)
            if n:
                state = state or (self.kept.get() if self.kept.exists() else self.begin())
                now = order[:n]
                state, out = self.take(key, state, np.array([ts[i] for i in now]), [ids[i] for i in now], [values[i] for i in now])
                if len(out):
                    yield out
                for at in chunks[bucket]:
                    self.buffer.removeKey(at)
            if n < len(ts):
                later = order[n:]
                if n:
                    self.buffer.updateValue(chunks[bucket][0], ([ts[i] for i in later], [ids[i] for i in later], [values[i] for i in later]))
                rest = ts[later[0]]
                break
        if state is not None:
            self.kept.update(state)
        if rest is not None:
            self.handle.registerTimer(max(-(-rest // 1000), passed // 1000 + 1))


class RollingHits(InEventOrder):
    """Accuracy over the last ``window`` rows; a value is '1' for a hit. The state is the
    position and the last window - 1 hits."""

    STATE = "rn long, hits binary"
    OUTPUT = "model_version string, request_id string, ts_us long, rn long, window_fill long, rolling_accuracy double"

    def __init__(self, window: int):
        self.window = window

    def begin(self) -> tuple:
        return 0, b""

    def take(self, key, state, ts, ids, values):
        rn, hits = state[0], np.frombuffer(bytes(state[1]), np.uint8)
        line = np.concatenate([hits, np.array([v == "1" for v in values], np.uint8)]).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(line)])
        end = np.arange(len(hits) + 1, len(line) + 1)
        start = np.maximum(end - self.window, 0)
        place = rn + np.arange(1, len(values) + 1)
        fill = np.minimum(place, self.window)
        out = pd.DataFrame({"model_version": key[0], "request_id": ids, "ts_us": ts, "rn": place, "window_fill": fill,
                            "rolling_accuracy": (total[end] - total[start]) / fill})
        return (rn + len(values), line[max(0, len(line) - self.window + 1) :].astype(np.uint8).tobytes()), out


class ShiftEvery(InEventOrder):
    """The shift of class shares against a baseline, checked each ``interval`` rows. The state is
    the position and the counts of the classes since the last check."""

    STATE = "rn long, classes array<string>, counts array<long>"
    OUTPUT = "model_version string, block long, n long, class_distribution_shift double, model_drift_detected boolean"

    def __init__(self, interval: int, threshold: float, baseline: dict[str | None, dict[str, float]]):
        self.interval, self.threshold, self.baseline = interval, threshold, baseline

    def begin(self) -> tuple:
        return 0, [], []

    def take(self, key, state, ts, ids, values):
        rn, counts = state[0], Counter(dict(zip(state[1], state[2])))
        shares, rows = self.baseline.get(key[0]), []
        at = 0
        while at < len(values):
            upto = min(len(values), at + self.interval - rn % self.interval)
            counts.update(values[at:upto])
            rn, at = rn + upto - at, upto
            if rn % self.interval == 0:
                if shares:
                    shift = sum(abs(counts[c] / self.interval - p) for c, p in sorted(shares.items()))
                    rows.append((key[0], rn // self.interval - 1, self.interval, shift, shift > self.threshold))
                counts.clear()
        out = pd.DataFrame(rows, columns=["model_version", "block", "n", "class_distribution_shift", "model_drift_detected"])
        return (rn, list(counts), list(counts.values())), out


def in_event_order(rows: DataFrame, processor: InEventOrder) -> DataFrame:
    """``rows`` (model_version, id, ts_us, value, and the watermarked event time) through the
    processor, key by key."""
    return rows.groupBy("model_version").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.OUTPUT, outputMode="Append", timeMode="EventTime")
