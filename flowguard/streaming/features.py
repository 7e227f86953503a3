"""Trailing-window features on a stream, in event order per (sensor, source).

Rows wait in state until the watermark has passed them, then they are worked off in
(time, key) order. Sources are cut into time slices as in the batch operator, each with the rows of
one window length before it, so a task holds one slice of a source at a time. What the longest
window no longer needs leaves the state, and all of a slice once the watermark has passed its end.
"""

import heapq
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from flowguard import constants as K
from flowguard.operators.windows import own_slice, slice_copies, slice_length, window_features
from flowguard.session import materialised

ROW = ["t", "event_key", "dst_address", "dst_port", "protocol", "packet_count", "byte_count",
       "duration_ms", "failed", "target"]
STATE_SCHEMA = ("t long, event_key string, dst_address string, dst_port int, protocol string, "
                "packet_count long, byte_count long, duration_ms long, failed long, target boolean")
TYPES = {"flow_count": "long", "unique_dst_address_count": "long",
         "unique_dst_port_count": "long", "packet_total": "long", "byte_total": "long",
         "failure_count": "long", "mean_duration_ms": "double", "max_duration_ms": "long",
         "mean_bytes_per_flow": "double", "seconds_since_prior_service": "double",
         "prior_service_missing": "boolean"}


# Stateful processors need this state store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def output_schema(seconds) -> str:
    return "event_key string, " + ", ".join(
        f"w{w}_{n} {TYPES[n]}" for w in seconds for n in K.WINDOW_FEATURES)


def sliding(rows, first: int, reach: int) -> list[list]:
    """Window features of rows[first:], rows being in (time, key) order.

    Counts and sums move with the two ends of the window, so the work grows with the rows
    and not with the length of a window.
    """
    t = np.array([r[0] for r in rows], dtype=np.int64)
    start = np.searchsorted(t, t - reach, side="left")
    sums = [np.concatenate([[0], np.cumsum([r[c] for r in rows])]) for c in (5, 6, 8, 7)]
    distinct = [_distinct([r[2] for r in rows], start), _distinct([r[3] for r in rows], start)]
    largest = _largest([r[7] for r in rows], start)
    last_seen, out = {}, []
    for i, row in enumerate(rows):
        before = last_seen.get(row[2:5])
        last_seen[row[2:5]] = row[0]
        if i < first:
            continue
        prior = before is not None and before >= row[0] - reach
        n = i + 1 - int(start[i])
        packets, octets, failures, duration = (int(s[i + 1] - s[start[i]]) for s in sums)
        out.append([n, distinct[0][i], distinct[1][i], packets, octets, failures, duration / n,
                    largest[i], octets / n, (row[0] - before) / 1e6 if prior else 0.0, not prior])
    return out


def _distinct(values, start) -> list[int]:
    held, low, out = Counter(), 0, []
    for i, v in enumerate(values):
        if v is not None:
            held[v] += 1
        while low < start[i]:
            old = values[low]
            low += 1
            if old is not None:
                held[old] -= 1
                if not held[old]:
                    del held[old]
        out.append(len(held))
    return out


def _largest(values, start) -> list[int]:
    heap, out = [], []
    for i, v in enumerate(values):
        heapq.heappush(heap, (-v, i))
        while heap[0][1] < start[i]:
            heapq.heappop(heap)
        out.append(-heap[0][0])
    return out


class WindowFeatures(StatefulProcessor):
    """State of a slice: ``waiting`` rows before the watermark passes, ``recent`` rows of the windows.

    Rows before the slice are not its ``target``: they count in windows and have no features here.
    Both are maps by (time, key): a row is written when it comes, moved once, and removed when the
    longest window has left it; nothing is rewritten in between.
    """

    def __init__(self, seconds):
        self.seconds = tuple(seconds)
        self.length = slice_length(max(self.seconds))

    def init(self, handle):
        self.handle = handle
        place, rest = "t long, event_key string", STATE_SCHEMA.split(", ", 2)[2]
        self.waiting = handle.getMapState("waiting", place, rest)
        self.recent = handle.getMapState("recent", place, rest)

    @staticmethod
    def _plain(values):
        return tuple(None if v is None or v != v else v for v in values)

    @staticmethod
    def _rows(state):
        return sorted((*key, *value) for key, value in state.iterator())

    def handleInputRows(self, key, rows, timerValues):
        late = timerValues.getCurrentWatermarkInMs()
        first = None
        for frame in rows:
            for values in frame[ROW].itertuples(index=False, name=None):
                clean = self._plain(values)
                port = None if clean[3] is None else int(clean[3])
                self.waiting.updateValue(clean[:2], (clean[2], port, *clean[4:]))
                first = clean[0] if first is None else min(first, clean[0])
        if first is not None:
            self.handle.registerTimer(max(first // 1000 + 1, late + 1))
        yield pd.DataFrame(columns=self._columns())

    def _columns(self):
        return ["event_key"] + [f"w{w}_{n}" for w in self.seconds for n in K.WINDOW_FEATURES]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        end = (int(key[2]) + 1) * self.length
        held = self._rows(self.waiting)
        due = [r for r in held if r[0] < mark]
        recent = self._rows(self.recent)
        known = {r[1] for r in recent}
        ready = [r for r in due if r[1] not in known]
        reach, rows = max(self.seconds) * 1_000_000, recent + ready
        parts = [sliding(rows, len(recent), w * 1_000_000) for w in self.seconds]
        out = [[row[1], *(v for part in parts for v in part[i])] for i, row in enumerate(ready)
               if row[9]]
        for r in due:
            self.waiting.removeKey(r[:2])
        needed = mark - reach if mark <= end else end
        for r in ready:
            if r[0] >= needed:
                self.recent.updateValue(r[:2], r[2:])
        for r in recent:
            if r[0] < needed:
                self.recent.removeKey(r[:2])
        if len(held) > len(due):
            self.handle.registerTimer(held[len(due)][0] // 1000 + 1)
        elif mark <= end:
            self.handle.registerTimer(end // 1000 + 1)
        yield pd.DataFrame(out, columns=self._columns())

    def close(self):
        pass


def stream_features(flows: DataFrame, seconds=K.DEFAULT_WINDOWS, delay: str = "10 minutes"
                    ) -> DataFrame:
    """Features per flow, emitted once the watermark has passed the flow."""
    from flowguard.functions.flow_columns import is_failure
    flows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = (flows.withWatermark("event_time", delay)
            .withColumn("t", F.unix_micros("event_time"))
            .withColumn("_own", own_slice(slice_length(max(seconds))))
            .withColumn("slice", F.explode(slice_copies(max(seconds))))
            .withColumn("target", F.col("slice") == F.col("_own"))
            .withColumn("failed", is_failure(F.col("source_type"), F.col("state")).cast("long"))
            .withColumn("sensor", F.coalesce("sensor_id", F.lit("")))
            .select("event_time", "sensor", "src_address", "slice", *ROW))
    return rows.groupBy("sensor", "src_address", "slice").transformWithStateInPandas(
        statefulProcessor=WindowFeatures(seconds), outputStructType=output_schema(seconds),
        outputMode="Append", timeMode="EventTime")


def settled_features(flows: DataFrame, emitted: DataFrame, seconds=K.DEFAULT_WINDOWS) -> DataFrame:
    """The stream's features, made whole: the open tail, late flows, and what those change.

    ``flows`` are all flows stored, each once. A source whose flows were not all emitted is computed
    again from its first missing flow on, with one window length of rows before it; all other rows
    stay as the stream gave them.
    """
    source = ["sensor_id", "src_address"]
    missing = flows.join(emitted.select("event_key"), "event_key", "left_anti")
    first = materialised(missing.groupBy(*source).agg(F.min("event_time").alias("_first")))
    first = first.select(F.col("sensor_id").alias("_sensor"), F.col("src_address").alias("_source"),
                         "_first")
    again = flows.join(first, F.col("sensor_id").eqNullSafe(F.col("_sensor"))
                       & (F.col("src_address") == F.col("_source")))
    before = F.col("_first") - F.expr(f"INTERVAL {max(seconds)} SECONDS")
    rows = again.where(F.col("event_time") >= before).withColumn(
        "_due", F.col("event_time") >= F.col("_first")).drop("_sensor", "_source", "_first")
    made = window_features(rows, seconds, carry=("_due",)).where("_due").drop("_due")
    made = materialised(made)
    return emitted.join(made.select("event_key"), "event_key", "left_anti").unionByName(made)
