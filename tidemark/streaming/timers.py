"""Rules that speak when nothing comes: keyed stream processors with timers, and the same rules over tables as windows.

The processors need the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`); state and timers are in
the query's checkpoint, so a restarted query goes on with both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _checked(df: DataFrame) -> DataFrame:
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in df.sparkSession.conf.get(name, ""):
        raise ValueError(f"timers need {name} = {ROCKSDB}")
    return df


def _millis(x) -> int:
    return int(pd.Timestamp(x).value // 1_000_000)


class Silence(StatefulProcessor):
    """A row as a key comes to a stop, and one as it starts again; see `silences`."""

    def __init__(self, at: str, timeout_ms: int, by_event_time: bool, forget_ms: int | None):
        self.at, self.timeout_ms, self.by_event_time, self.forget_ms = at, timeout_ms, by_event_time, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms long, silent boolean", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        before, silent = held if held else (None, False)
        times = [_millis(x) for pdf in rows for x in pdf[self.at]]
        newest = max(times) if self.by_event_time else timerValues.getCurrentProcessingTimeInMs()
        if before is not None and newest <= before:  # only rows from before what is known
            return
        if silent:
            yield pd.DataFrame({"key": [key[0]], "last_ms": [before], "known_ms": [min(x for x in times if x > before) if self.by_event_time else newest], "silent": [False]})
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.last.update((newest, False))
        self.handle.registerTimer(newest + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        before, silent = self.last.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if not silent and due >= before + self.timeout_ms:
            self.last.update((before, True))
            yield pd.DataFrame({"key": [key[0]], "last_ms": [before], "known_ms": [due], "silent": [True]})

    def close(self) -> None:
        pass


def silences(df: DataFrame, key: str, at: str, *, timeout_ms: int = 3000, late: str | None = None, forget_ms: int | None = None) -> DataFrame:
    """(key, last_ms, known_ms, silent) of a stream: a row once a key has sent nothing for the timeout, without any
    further row of it, and a row as it speaks again.

    With `late`, the delay of the watermark on the timestamp `at`, silence is a matter of event time: it is told once
    the watermark is past the timeout, the same in every run. Without, it is a matter of the wall clock and told when no
    row comes at all; keys are forgotten after `forget_ms` then. Rows from before a key's latest one change nothing.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = _checked(df).withWatermark(at, late) if late else _checked(df)
    processor = Silence(at, timeout_ms, bool(late), None if late else forget_ms)
    return rows.select(key, at).groupBy(key).transformWithStateInPandas(processor, f"key {kind}, last_ms long, known_ms long, silent boolean", "append", "eventTime" if late else "processingTime")


def silences_of_table(df: DataFrame, keys: list[str], at_ms: str, *, timeout_ms: int = 3000) -> DataFrame:
    """(keys, last_ms, known_ms, silent): what `silences` tells of a stream that has ended, by event time: the last
    silence of each key is open. Several rows of one time count once."""
    w = Window.partitionBy(*keys).orderBy(at_ms)
    ends = df.select(*keys, F.col(at_ms).alias("last_ms"), F.lead(at_ms).over(w).alias("_next"))
    quiet = ends.where(F.col("_next").isNull() | (F.col("_next") > F.col("last_ms") + timeout_ms))
    told = F.array(F.struct((F.col("last_ms") + timeout_ms).alias("known_ms"), F.lit(True).alias("silent")), F.struct(F.col("_next").alias("known_ms"), F.lit(False).alias("silent")))
    return quiet.select(*keys, "last_ms", F.explode(told).alias("x")).select(*keys, "last_ms", "x.*").where("known_ms IS NOT NULL")


class Bursts(StatefulProcessor):
    """Bursts of clock exchanges with a time limit on the reply; see `clock_bursts`."""

    def __init__(self, size: int, timeout_ms: int, good_us: int, updates: int, floor: int):
        self.size, self.timeout_ms, self.good_us, self.updates, self.floor = size, timeout_ms, good_us, updates, floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flight = handle.getValueState("flight", "sent_us long")
        self.samples = handle.getListState("samples", "offset_us long, error_us long")
        self.floors = handle.getListState("floors", "error_us long")
        self.stage = handle.getValueState("stage", "bursts long, good long, confirm_us long, synced boolean")

    def _finish(self, key, at_ms: int, overdue: bool) -> tuple:
        """Ends the burst with the samples it has; the one with the least error speaks for it."""
        samples = sorted(self.samples.get(), key=lambda x: x[1])
        bursts, good, confirm, synced = self.stage.get() if self.stage.exists() else (0, 0, None, False)
        bursts, offset, error, taken = bursts + 1, None, None, False
        if samples:
            offset, error = (int(x) for x in samples[0])
            floors = [int(x[0]) for x in self.floors.get()]
            least = min([error, *floors])
            taken = not synced or error <= least + max(least // 2, 1000)
            self.floors.put([(x,) for x in [*floors, error][-self.floor :]])
            if taken and not synced:
                if confirm is not None:
                    synced, good, confirm = abs(offset - confirm) <= self.good_us, 0, None
                else:
                    good = good + 1 if error < self.good_us else 0
                    confirm = offset if good >= self.updates else None
        self.stage.update((bursts, good, confirm, bool(synced)))
        self.samples.clear()
        return key[0], at_ms, bursts, len(samples), offset, error, taken, overdue, bool(synced)

    def _drop_timers(self) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "kind"], kind="stable").itertuples():
            now = _millis(r.at)
            waits = int(self.flight.get()[0]) if self.flight.exists() else None
            if waits is not None and now - waits // 1000 >= self.timeout_ms:  # overdue, whether or not the timer has told
                self.flight.clear()
                self._drop_timers()
                out.append(self._finish(key, waits // 1000 + self.timeout_ms, True))
                waits = None
            if r.kind == "sent" and waits is None:
                self.flight.update((int(r.sent_us),))
                self.handle.registerTimer(int(r.sent_us) // 1000 + self.timeout_ms)
            elif r.kind == "reply" and waits == r.sent_us:
                self.flight.clear()
                self._drop_timers()
                error = ((r.received_us - r.sent_us) - (r.replied_us - r.heard_us)) / 2
                offset = ((r.heard_us - r.sent_us) + (r.replied_us - r.received_us)) / 2
                self.samples.appendValue((int(offset), int(error) if error >= 0 else 1 << 62))
                if len(list(self.samples.get())) >= self.size:
                    out.append(self._finish(key, now, False))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.flight.exists():
            self.flight.clear()
            yield pd.DataFrame([self._finish(key, expiredTimerInfo.getExpiryTimeInMs(), True)], columns=COLUMNS)

    def close(self) -> None:
        pass


COLUMNS = ["key", "at_ms", "burst", "samples", "offset_us", "error_us", "taken", "overdue", "synced"]


def clock_bursts(df: DataFrame, key: str, *, late: str = "1 second", size: int = 8, timeout_ms: int = 5000, good_us: int = 1000, updates: int = 8, floor: int = 30) -> DataFrame:
    """The bursts of a stream of clock exchanges: rows (key, at, kind, sent_us, heard_us, replied_us, received_us), of
    kind 'sent' as an exchange begins and 'reply' as its answer comes, `at` being the timestamp of either.

    One exchange is in flight at a time; replies to others are ignored. A burst ends after `size` replies, or when one
    is overdue, with the samples it has and without a further row: a timer tells. Its sample of least error counts, if
    any. After `updates` good ones in a row (error under `good_us`) the next has to lie within `good_us` of the last of
    them; then the clock is synced, or the count starts over. Synced, a burst whose error is over half again (and a
    millisecond) above the least of the last `floor` is not taken.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = _checked(df).withWatermark("at", late)
    schema = f"key {kind}, at_ms long, burst long, samples long, offset_us long, error_us long, taken boolean, overdue boolean, synced boolean"
    return rows.groupBy(key).transformWithStateInPandas(Bursts(size, timeout_ms, good_us, updates, floor), schema, "append", "eventTime")
