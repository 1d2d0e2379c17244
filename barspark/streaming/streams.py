"""Stream versions of the bar, session, signal and trade operators. Each gives the batch operator's rows on the same input, as far as late data allow."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bars_from_ticks(ticks: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of (symbol, ts, value); ticks later than the watermark are dropped."""
    w = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", length).alias("w"))
    out = w.agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("tick_volume"))
    return out.select("symbol", F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "tick_volume")


def dedup(bars: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first row of each symbol and time that arrives. The batch operator keeps the last: a stream can't take back what it gave out."""
    return bars.withWatermark("bar_ts", late).dropDuplicatesWithinWatermark(["symbol", "bar_ts"])


def activity_sessions(ticks: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """symbol, start, end, n of the runs of ticks with no longer gap between."""
    s = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class FirstOfEpisode(StatefulProcessor):
    """Of bars in order (in_episode, hit, signal), the first hit of each run of bars in an episode."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("episode", "active boolean, fired boolean")

    def handleInputRows(self, key, rows, timerValues):
        active, fired = self.state.get() if self.state.exists() else (False, False)
        bars = pd.concat(list(rows)).sort_values("bar_idx")
        out = []
        for idx, inside, hit, signal in zip(bars["bar_idx"], bars["in_episode"], bars["hit"], bars["signal"]):
            fired = fired and active and inside
            active = bool(inside)
            if inside and hit and not fired:
                fired = True
                out.append((*key, int(idx), int(signal)))
        self.state.update((active, fired))
        yield pd.DataFrame(out, columns=["symbol", "bar_idx", "signal"])

    def close(self) -> None:
        pass


def episode_signals(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").transformWithStateInPandas(FirstOfEpisode(), "symbol string, bar_idx long, signal int", "Append", "None")


class OpenPosition(StatefulProcessor):
    """Of candidates in order of entry_idx, those that start behind the exit of the last one taken."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", "exit_idx long")

    def handleInputRows(self, key, rows, timerValues):
        last = self.state.get()[0] if self.state.exists() else None
        out = []
        for entry, end in pd.concat(list(rows)).sort_values("entry_idx")[["entry_idx", "exit_idx"]].itertuples(index=False):
            if last is None or entry > last:
                last = int(end)
                out.append((*key, int(entry), last))
        if last is not None:
            self.state.update((last,))
        yield pd.DataFrame(out, columns=["experiment_id", "symbol", "entry_idx", "exit_idx"])

    def close(self) -> None:
        pass


def one_at_a_time(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("experiment_id", "symbol").transformWithStateInPandas(OpenPosition(), "experiment_id string, symbol string, entry_idx long, exit_idx long", "Append", "None")


def snapshot_writer(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends new rows to a Parquet table, leaves known ones out and raises ValueError on drift. Batches may come again."""
    from barspark.functions.store import checkpointed
    from barspark.operators.bookkeeping import append_snapshot

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates()
        try:
            existing = spark.read.schema(batch.schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # any other failed read is no empty table
                raise
            existing = spark.createDataFrame([], batch.schema)
        judged = checkpointed(append_snapshot(existing, rows, key))
        if not judged.filter("status = 'drift'").isEmpty():
            raise ValueError(f"batch {batch_id} changes rows that are there")
        judged.filter("status = 'new'").drop("status").write.mode("append").parquet(path)

    return write


def signals_with_ticks(signals: DataFrame, ticks: DataFrame, within: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Each signal (symbol, signal_ts, direction) beside the ticks (symbol, ts, value) of the time behind it. They meet by symbol and stretch of that length, so a row is held against two stretches and not all of its symbol's."""
    length = F.unix_micros(F.expr(f"timestamp '1970-01-01 00:00:00' + interval {within}")) - F.unix_micros(F.expr("timestamp '1970-01-01 00:00:00'"))
    stretch = lambda t: F.floor(F.unix_micros(t) / length)
    both = F.sequence(stretch("signal_ts"), stretch("signal_ts") + 1)
    s = signals.withWatermark("signal_ts", late).withColumn("_stretch", F.explode(both)).alias("s")
    t = ticks.withWatermark("ts", late).withColumn("_stretch", stretch("ts")).alias("t")
    near = (F.col("s.symbol") == F.col("t.symbol")) & (F.col("s._stretch") == F.col("t._stretch")) & (F.col("t.ts") >= F.col("s.signal_ts")) & (F.col("t.ts") <= F.col("s.signal_ts") + F.expr(f"interval {within}"))
    return s.join(t, near).select("s.symbol", "signal_ts", "direction", "ts", "value")


#: A stretch of time has so many lengths that a signal looks ahead: few enough keys, and few ticks that two stretches need.
SPAN = 16


class TicksBehind(StatefulProcessor):
    """Of a stretch of time: its signals, and the ticks of it and of the start of the next. A row for each signal with the ticks that met it in this batch; pairs are never rows."""

    def __init__(self, length: int) -> None:
        self.length = length  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "signals binary, ticks binary, numbers binary")

    def _met(self, signals: np.ndarray, ticks: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        order = np.argsort(ticks, kind="stable")
        ticks, before = ticks[order], np.concatenate([[0], np.cumsum(numbers[order])])
        return before[np.searchsorted(ticks, signals + self.length, "right")] - before[np.searchsorted(ticks, signals, "left")]

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows))
        us, n, signal = (batch[k].to_numpy() for k in ("us", "n", "signal"))
        fresh, ticks, numbers = np.unique(us[signal]), us[~signal], n[~signal]
        known, old, old_numbers = (np.frombuffer(x, "<i8") for x in (self.state.get() if self.state.exists() else (b"", b"", b"")))
        fresh = np.setdiff1d(fresh, known, assume_unique=True)
        all_ticks, all_numbers = np.concatenate([old, ticks]), np.concatenate([old_numbers, numbers])
        at = np.concatenate([fresh, known])
        met = np.concatenate([self._met(fresh, all_ticks, all_numbers), self._met(known, ticks, numbers)])
        self.state.update(tuple(x.astype("<i8").tobytes() for x in (at, all_ticks, all_numbers)))
        self.handle.registerTimer(((int(key[1]) + 1) * SPAN + 1) * self.length // 1000 + 1)
        yield pd.DataFrame({"symbol": key[0], "signal_us": at[met > 0], "n": met[met > 0]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()  # nothing that may still come is of this time
        yield pd.DataFrame({"symbol": pd.Series(dtype=str), "signal_us": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def count_ticks(signals: DataFrame, ticks: DataFrame, within: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """symbol, signal_ts, n: the ticks (symbol, ts, n: their number) of the time behind each signal (symbol, signal_ts), counted without a row for each pair. Signals of one symbol and time are one.
    A row tells what a batch adds to a signal; a signal's rows, summed up, are its count."""
    length = signals.sparkSession.sql(f"select unix_micros(timestamp '1970-01-01 00:00:00Z' + interval {within})").first()[0]
    us = F.unix_micros("ts")
    stretch = F.floor(us / (length * SPAN))
    ahead = F.floor((us - length) / (length * SPAN))  # another one at the start of a stretch, where signals before it look
    s = signals.select("symbol", F.col("signal_ts").alias("ts"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("signal"))
    both = s.unionByName(ticks.select("symbol", "ts", F.col("n").cast("long").alias("n"), F.lit(False).alias("signal"))).withWatermark("ts", late)
    spread = F.when(F.col("signal"), F.array(stretch)).otherwise(F.array_distinct(F.array(ahead, stretch)))
    rows = both.select("symbol", "ts", us.alias("us"), "n", "signal", F.explode(spread).alias("stretch"))
    met = rows.groupBy("symbol", "stretch").transformWithStateInPandas(TicksBehind(length), "symbol string, signal_us long, n long", "Append", "EventTime")
    return met.select("symbol", F.timestamp_micros("signal_us").alias("signal_ts"), "n")
