"""The event-time rules of the protocol as Structured Streaming plans.

Each function takes streaming (or batch) DataFrames and returns one; sinks are chosen by the caller. Times are a `ts` TIMESTAMP column.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUTCOME = "120 minutes"


def outcome_windows(anchors: DataFrame, readings: DataFrame, window: str = OUTCOME, delay: str = "10 minutes", threshold: float = 180.0) -> DataFrame:
    """Peak over (t0, t0 + window] per anchor: stream-stream interval join, then an append-mode aggregate once the watermark passes t0.

    anchors: participant_id, event_id, t0; readings: participant_id, ts, value."""
    a = anchors.withWatermark("t0", delay).alias("a")
    r = readings.withWatermark("ts", delay).alias("r")
    cond = F.expr(f"a.participant_id = r.participant_id AND r.ts > a.t0 AND r.ts <= a.t0 + INTERVAL {window}")
    j = a.join(r, cond, "inner").select(F.col("a.participant_id").alias("participant_id"), F.col("a.event_id").alias("event_id"), F.col("a.t0").alias("t0"), F.col("r.value").alias("value"))
    g = j.groupBy("participant_id", "event_id", "t0").agg(F.max("value").alias("peak"), F.count("value").alias("n_readings"))
    return g.withColumn("reached", F.col("peak") >= threshold)


def first_requests(requests: DataFrame, delay: str = "1 day") -> DataFrame:
    """One request per (participant, event): repeats within the watermark are dropped."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["participant_id", "event_id"])


def daily_blocks(readings: DataFrame, delay: str = "1 hour") -> DataFrame:
    return readings.withWatermark("ts", delay).groupBy("participant_id", F.window("ts", "1 day").alias("w")).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean")).select("participant_id", F.col("w.start").alias("day"), "n", "mean")


def rolling_activity(readings: DataFrame, width: str = "4 hours", every: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    return readings.withWatermark("ts", delay).groupBy("participant_id", F.window("ts", width, every).alias("w")).agg(
        F.avg("value").alias("mean"), F.count("value").alias("n")).select("participant_id", F.col("w.end").alias("at"), "mean", "n")


def overlap_sessions(anchors: DataFrame, gap: str = "119 minutes 59.999999 seconds", delay: str = "3 hours") -> DataFrame:
    """Runs of overlapping anchors. A session of size one is an isolated anchor; the gap is a microsecond short of the window, because two
    anchors exactly one window apart are isolated while Spark merges events exactly one gap apart."""
    return anchors.withWatermark("ts", delay).groupBy("participant_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_anchors")).select("participant_id", F.col("w.start").alias("first"), F.col("w.end").alias("closes"), "n_anchors")


#: Running sums, and the open windows: when they close, and what is known of them.
STATE = ("n BIGINT, cc DOUBLE, cg DOUBLE, gg DOUBLE, cy DOUBLE, gy DOUBLE, closes ARRAY<BIGINT>, events ARRAY<STRING>, carbs ARRAY<DOUBLE>, activity ARRAY<DOUBLE>, "
         "rises ARRAY<DOUBLE>, usable ARRAY<BOOLEAN>")
OUTPUT = "participant_id STRING, event_id STRING, kind STRING, at_us BIGINT, version BIGINT, mean_rise DOUBLE, pred_std DOUBLE"


COLUMNS = ["participant_id", "event_id", "kind", "at_us", "version", "mean_rise", "pred_std"]
#: What a forecast and a lesson take from a row.
ROW = namedtuple("ROW", "us event_id carbs_g activity_level peak_glucose_rise excluded_reason v_bb v_bg v_gg m_b m_g noise")


class Personaliser(StatefulProcessor):
    """Forecast now, learn when the outcome window closes.

    State per participant: six running sums and the queue of open windows, in one value, because every call for state is a message to the JVM and back. Rows of a micro-batch are taken in time order; before each one the
    windows closed by its time are learned (or, if unusable, reported excluded). An event-time timer resolves what no later row triggers: a window
    closed by the watermark cannot be preceded by any later row, so learning it then cannot leak. A participant has a timer for the first open window
    only, which sets the next one, so the calls do not grow with the events."""

    def __init__(self, window_us: int = 7_200_000_000):
        self.window_us = window_us

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def _load(self) -> tuple[list, list]:
        held = self.state.get()
        return (list(held[:6]), list(zip(*held[6:]))) if held is not None else ([0, 0.0, 0.0, 0.0, 0.0, 0.0], [])

    def _save(self, s: list, queue: list) -> None:
        self.state.update((*s, *([list(c) for c in zip(*queue)] or [[]] * 6)))

    def _wake(self, queue: list) -> None:
        """One timer, for the window that closes first; windows that the rows themselves have closed need none."""
        if queue:
            self.handle.registerTimer(min(p[0] for p in queue) // 1000 + 1)

    @staticmethod
    def _resolve(s: list, queue: list, now: int, pid: str, out: list) -> list:
        due = sorted((p for p in queue if p[0] <= now), key=lambda p: p[0])
        for close, event, c, a, rise, usable in due:
            if usable:
                z = c * a
                s[0] += 1
                for i, v in enumerate((c * c, c * z, z * z, c * rise, z * rise), start=1):
                    s[i] += v
            out.append((pid, event, "reconciled" if usable else "excluded", close, s[0], None, None))
        return [p for p in queue if p[0] > now]

    @staticmethod
    def _forecast(s: list, r) -> tuple[float, float]:
        d0 = r.v_bb * r.v_gg - r.v_bg * r.v_bg
        p = (r.v_gg / d0, -r.v_bg / d0, r.v_bb / d0)
        q = (p[0] + s[1] / r.noise, p[1] + s[2] / r.noise, p[2] + s[3] / r.noise)
        h = (p[0] * r.m_b + p[1] * r.m_g + s[4] / r.noise, p[1] * r.m_b + p[2] * r.m_g + s[5] / r.noise)
        d = q[0] * q[2] - q[1] * q[1]
        bb, bg, gg = q[2] / d, -q[1] / d, q[0] / d
        x, z = r.carbs_g, r.carbs_g * r.activity_level
        return x * (bb * h[0] + bg * h[1]) + z * (bg * h[0] + gg * h[1]), (r.noise + x * x * bb + 2 * x * z * bg + z * z * gg) ** 0.5

    def _taken(self, pid: str, rows: list) -> list[tuple]:
        s, queue = self._load()
        out: list = []
        for r in sorted(rows, key=lambda r: (r.us, r.event_id)):
            queue = self._resolve(s, queue, int(r.us), pid, out)
            mean, sd = self._forecast(s, r)
            out.append((pid, r.event_id, "forecast", int(r.us), s[0], mean, sd))
            usable = r.excluded_reason is None or (isinstance(r.excluded_reason, float)) or not str(r.excluded_reason).strip()
            usable = bool(usable and pd.notna(r.peak_glucose_rise))
            close = int(r.us) + self.window_us
            queue.append((close, r.event_id, float(r.carbs_g), float(r.activity_level), float(r.peak_glucose_rise) if usable else 0.0, usable))
        self._wake(queue)
        self._save(s, queue)
        return out

    def _closed(self, pid: str, timerValues, expiredTimerInfo) -> list[tuple]:  # noqa: N803
        s, queue = self._load()
        out: list = []
        # all that the watermark has closed, so that the next timer lies ahead of it
        queue = self._resolve(s, queue, max(int(expiredTimerInfo.getExpiryTimeInMs()), int(timerValues.getCurrentWatermarkInMs())) * 1000 - 1, pid, out)
        self._wake(queue)
        self._save(s, queue)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield pd.DataFrame(self._taken(key[0], [ROW._make(r) for batch in rows for r in zip(*[batch[c].tolist() for c in ROW._fields])]), columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield pd.DataFrame(self._closed(key[0], timerValues, expiredTimerInfo), columns=COLUMNS)

    def close(self) -> None:
        pass


class RowPersonaliser(Personaliser):
    """The same on rows: what many participants give shares an Arrow batch, where a frame is one of its own."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        return iter([Row(**dict(zip(COLUMNS, r))) for r in self._taken(key[0], list(rows))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return iter([Row(**dict(zip(COLUMNS, r))) for r in self._closed(key[0], timerValues, expiredTimerInfo)])


def personalise(events: DataFrame, delay: str = "0 seconds", window_us: int = 7_200_000_000) -> DataFrame:
    """Stream form of the sequential forecast. `events` carries its prior columns (stream-static join with the small prior table)."""
    rows = events.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", delay)
    return rows.select("participant_id", *ROW._fields, "ts").groupBy("participant_id").transformWithState(
        statefulProcessor=RowPersonaliser(window_us), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def idempotent_batches(stream: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch under its own batch id; a replayed batch overwrites itself, so a retry changes nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available and stop; used by tests, backfills and the registered queries."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
