"""Live metrics that need the order of events: requests under way, and rates of counters that restart.

Each series keeps a little state of its own in the state store, and timers on the
watermark write a window once nothing can change it any more.  Rows may come in any
order up to the watermark; later ones are dropped.  A series passes through one task a
refresh, in Arrow batches; moves at the same moment and samples of written windows are
folded into single numbers, so state and work follow the open windows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

NEVER = 2**63 - 1
MICROS = 1_000_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs this store; a session that names one already is left as it is."""
    if spark.conf.get(STORE, None) is None or "RocksDB" not in spark.conf.get(STORE):
        spark.conf.set(STORE, ROCKS)


def _grouped(df: DataFrame, keys: list[str], processor: StatefulProcessor, values: list[StructField]) -> DataFrame:
    """Rows (start, keys, values) written by the processor, with window columns."""
    keep_state_in_rocksdb(df.sparkSession)
    schema = StructType([StructField("start", LongType()), *[df.schema[k] for k in keys], *values])
    rows = df.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventTime")
    names = [f.name for f in values]
    width = F.lit(processor.width)
    return rows.select(F.timestamp_micros("start").alias("window_start"), F.timestamp_micros(F.col("start") + width).alias("window_end"), *keys, *names)


class OpenRequests(StatefulProcessor):
    """Most requests under way per window, for one series.

    The state is one value: ``moves``, (moment, net move) pairs in order that are in no
    written window yet; how many requests were open when the next window to write
    begins; and where it begins.  A request without an end stays counted as open; the
    moves of requests that have ended are gone once their windows are written.
    """

    def __init__(self, keys: list[str], window_s: int):
        self.keys, self.width = keys, window_s * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "moves binary, open long, following long")

    def _load(self) -> tuple[np.ndarray, int, int | None]:
        if not self.state.exists():
            return np.zeros((0, 2), np.int64), 0, None
        moves, count, following = self.state.get()
        return np.frombuffer(bytes(moves), np.int64).reshape(-1, 2), count, following

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        moves, count, following = self._load()
        parts = [moves]
        for part in rows:
            begun, ended = part["begun"].to_numpy(np.int64), part["ended"].to_numpy(np.int64)
            ended = ended[ended != NEVER]
            parts.append(np.stack([np.r_[begun, ended], np.r_[np.ones(len(begun), np.int64), np.full(len(ended), -1)]], axis=1))
        steps = np.concatenate(parts)
        moments, of = np.unique(steps[:, 0], return_inverse=True)
        net = np.zeros(len(moments), np.int64)
        np.add.at(net, of, steps[:, 1])
        moves = np.stack([moments, net], axis=1)
        self._store(moves, count, following)
        yield from ()

    def _store(self, moves: np.ndarray, count: int, following: int | None) -> None:
        """Keep the state, and one timer for the next window to write.

        Nothing is due without moves: whether a quiet stretch goes on is known with the next ones.
        """
        self.state.update((np.ascontiguousarray(moves).tobytes(), count, following))
        if len(moves):
            start = int(moves[0, 0] - moves[0, 0] % self.width) if following is None else following
            self.handle.registerTimer((start + self.width) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        moves, count, at = self._load()
        if not len(moves):
            return
        starts = moves[:, 0] - moves[:, 0] % self.width
        at = int(starts[0]) if at is None else at
        running = count + np.cumsum(moves[:, 1])
        out, done, last = [], 0, int(starts[-1])
        while at + self.width <= closed and at <= last:
            end = int(np.searchsorted(starts, at, side="right"))
            if end > done:
                peak = int(running[done:end].max())
                out.append((at, max(peak, count) if moves[done, 0] > at else peak))
                count, done = int(running[end - 1]), end
            else:
                out.append((at, count))
            at += self.width
        if out:
            self._store(moves[done:], count, at)
            yield _frame(out, key, self.keys, ["most_in_progress"])


def _frame(rows: list[tuple], key: tuple, keys: list[str], names: list[str]) -> pd.DataFrame:
    """Rows (start, values) with the key between them."""
    columns = list(zip(*rows, strict=True))
    frame = pd.DataFrame({"start": columns[0]})
    for name, value in zip(keys, key, strict=True):
        frame[name] = value
    for name, values in zip(names, columns[1:], strict=True):
        frame[name] = values
    return frame


def live_in_progress(log: DataFrame, window_s: int = 3600) -> DataFrame:
    """``gauges.in_progress`` over a stream with a watermark on ``ts``, for closed windows.

    A window is written when the watermark has passed it and a later or equal move of its
    series is known.  Rows without a time are left out; without a duration a
    request has not ended.
    """
    begun = F.unix_micros("ts")
    lasts = F.round(F.col("duration_s") * MICROS).cast("long")
    ended = F.when(lasts.isNotNull(), begun + F.greatest(F.lit(0), lasts)).otherwise(F.lit(NEVER))
    keys = ["method", "endpoint"]
    spans = log.filter("ts is not null").select("ts", *keys, begun.alias("begun"), ended.alias("ended"))
    return _grouped(spans, keys, OpenRequests(keys, window_s), [StructField("most_in_progress", LongType())])


SAMPLE = np.dtype([("at", "<i8"), ("tie", "<i8"), ("value", "<f8")])
SLOT = np.dtype([("slot", "<i8"), ("increase", "<f8")])


class CounterIncreases(StatefulProcessor):
    """Increase per sliding window of one counter that may restart from 0.

    The state is one value: ``waiting``, the samples of slots that the watermark has not
    passed, in any order; ``slots``, the increase of passed slots until their last
    window is written; the last compared value; and the end of the last written window.
    """

    def __init__(self, keys: list[str], window_s: int, slide_s: int):
        if window_s % slide_s:
            raise ValueError("a window must be a multiple of its slide")
        self.keys, self.width, self.slide = keys, window_s * MICROS, slide_s * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counter", "waiting binary, slots binary, value double, written long")

    def _load(self) -> tuple[np.ndarray, np.ndarray, float | None, int | None]:
        if not self.state.exists():
            return np.zeros(0, SAMPLE), np.zeros(0, SLOT), None, None
        waiting, slots, value, written = self.state.get()
        return np.frombuffer(bytes(waiting), SAMPLE), np.frombuffer(bytes(slots), SLOT), value, written

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting, slots, value, written = self._load()
        parts = [waiting]
        for part in rows:
            samples = np.empty(len(part), SAMPLE)
            for name in SAMPLE.names:
                samples[name] = part[name].to_numpy()
            parts.append(samples)
        waiting = np.concatenate(parts)
        self.state.update((waiting.tobytes(), slots.tobytes(), value, written))
        self._wake(waiting, slots, written)
        yield from ()

    def _wake(self, waiting: np.ndarray, slots: np.ndarray, written: int | None) -> None:
        """One timer, for the end of the next window to write."""
        known = np.r_[slots["slot"], waiting["at"] - waiting["at"] % self.slide]
        ends = self._ends(known)
        if written is not None:
            ends = ends[ends > written]
        if len(ends):
            self.handle.registerTimer(int(ends.min()) // 1000)

    def _ends(self, slots: np.ndarray) -> np.ndarray:
        """Ends of the windows that hold any of the slots."""
        return np.unique(np.unique(slots)[:, None] + np.arange(self.slide, self.width + 1, self.slide))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, slots, value, written = self._load()
        slot = waiting["at"] - waiting["at"] % self.slide
        passed = slot + self.slide <= closed
        samples = np.sort(waiting[passed], order=["at", "tie"])
        waiting = waiting[~passed]
        if len(samples):
            values = samples["value"]
            before = np.r_[values[0] if value is None else value, values[:-1]]
            grown = np.where(values < before, values, values - before)
            value = float(values[-1])
            of, at = np.unique(samples["at"] - samples["at"] % self.slide, return_inverse=True)
            added = np.empty(len(of), SLOT)
            added["slot"], added["increase"] = of, np.bincount(at, grown, len(of))
            slots = np.concatenate([slots, added])
        due = self._ends(slots["slot"])
        due = due[(due <= closed) & (due > (written if written is not None else -NEVER))]
        if len(due):
            # Slots are in order, so those of a window are neighbours.
            first = np.searchsorted(slots["slot"], due - self.width)
            last = np.searchsorted(slots["slot"], due)
            increases = [float(slots["increase"][i:j].sum()) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
            written = int(due[-1])
            yield _frame(list(zip((due - self.width).tolist(), increases, strict=True)), key, self.keys, ["increase"])
        slots = slots[slots["slot"] + self.width > closed]
        self.state.update((waiting.tobytes(), slots.tobytes(), value, written))
        self._wake(waiting, slots, written)


def live_counter_rate(samples: DataFrame, keys: list[str], window_s: int = 300, slide_s: int = 60, tie: str = "event_id") -> DataFrame:
    """``rates.counter_rate`` over a stream with a watermark on ``ts``, for closed windows.

    Samples without a time or a value are left out.
    """
    own = samples.filter("ts is not null and value is not null").select(
        "ts", *keys, F.unix_micros("ts").alias("at"), F.col(tie).cast("long").alias("tie"), F.col("value").cast("double").alias("value")
    )
    grown = _grouped(own, keys, CounterIncreases(keys, window_s, slide_s), [StructField("increase", DoubleType())])
    return grown.withColumn("rate", F.col("increase") / F.lit(float(window_s)))
