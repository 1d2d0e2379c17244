"""The first bar that reaches a stop or a target, for many trades at once.

Bars are cut into blocks of ``BLOCK``; a block keeps the extremes of 16, 256 and 4,096 of its bars. A trade asks the
largest stretch that begins at its place whether it can hold a bar that reaches a level: if not, the trade skips it, else
it goes down to the smaller ones. So a trade reads some 16 extremes a level, however long it lasts. Trades that a block
does not end skip all blocks whose extremes can't reach them, and go on in the next that can.

A stop that moves is followed bar by bar, for all trades of a block in step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barspark.functions.store import checkpointed

BLOCK, FAN = 1 << 16, 16
LEVELS = 4
#: Trades that a task takes with one block.
TRADES = 500_000
REASONS = ("stop_same_bar_ambiguous", "trail", "stop", "target", "time", "end_of_data")


class Pyramid:
    """Lows and highs of stretches of 1, 16, 256 and 4,096 bars, or blocks, or ticks, of the bid and of the ask, at which a short is closed."""

    def __init__(self, high: np.ndarray, low: np.ndarray, ask_high: np.ndarray, ask_low: np.ndarray):
        self.levels = [{"high": high, "low": low, "ask_high": ask_high, "ask_low": ask_low}]
        for _ in range(LEVELS - 1):
            self.levels.append({k: self._coarser(v, k.endswith("high")) for k, v in self.levels[-1].items()})

    @staticmethod
    def _coarser(values: np.ndarray, highest: bool) -> np.ndarray:
        padded = np.full(-(-len(values) // FAN) * FAN, np.nan)
        padded[: len(values)] = values
        known = np.where(np.isnan(padded), -np.inf if highest else np.inf, padded).reshape(-1, FAN)
        return known.max(axis=1) if highest else known.min(axis=1)

    def reached(self, level: int, at: np.ndarray, long_: np.ndarray, stop: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Whether the stretch number at of a level goes to the stop or the target. Unknown prices and targets are not reached."""
        x = self.levels[level]
        as_long = (x["low"][at] <= stop) | (x["high"][at] >= target)
        as_short = (x["ask_high"][at] >= stop) | (x["ask_low"][at] <= target)
        return np.where(long_, as_long, as_short)

    def first(self, start: np.ndarray, until: np.ndarray, long_: np.ndarray, stop: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first bar from start up to until that reaches a level, or until + 1."""
        place, level = start.copy(), np.zeros(len(start), dtype=np.int64)
        going = np.flatnonzero(place <= until)
        while len(going):
            p, k = place[going], level[going]
            hit = np.zeros(len(going), dtype=bool)
            for each in range(LEVELS):
                mine = np.flatnonzero(k == each)
                if len(mine):
                    g = going[mine]
                    hit[mine] = self.reached(each, p[mine] // FAN**each, long_[g], stop[g], target[g])
            found = hit & (k == 0)
            level[going] = np.where(hit, np.maximum(k - 1, 0), k)
            on = np.flatnonzero(~hit)
            g = going[on]
            place[g] = (p[on] // FAN ** k[on] + 1) * FAN ** k[on]
            level[g] = np.where((place[g] % FAN ** (k[on] + 1) == 0) & (k[on] < LEVELS - 1), k[on] + 1, k[on])
            going = going[~found]
            going = going[place[going] <= until[going]]
        return np.minimum(place, until + 1)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As functions.prices.round_price."""
    scale = 10.0**digits
    return np.sign(x) * np.floor(np.abs(x) * scale + 0.5 + 1e-9) / scale + 0.0


def _follow(b: dict[str, np.ndarray], t: dict[str, np.ndarray], until: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bar that reaches the moving stop or the target, or until + 1; the stop that holds on it). Stops move on each bar's close, from the next bar on."""
    place, stop = t["start"].copy(), t["moved"].copy()
    long_, way = t["direction"] == 1, t["direction"]
    going = np.flatnonzero(place <= until)
    while len(going):
        p, s, up = place[going], stop[going], long_[going]
        hit = np.where(up, (b["low"][p] <= s) | (b["high"][p] >= t["target_price"][going]), (b["high"][p] + b["gap"][p] >= s) | (b["low"][p] + b["gap"][p] <= t["target_price"][going]))
        on = going[~hit]
        p = place[on]
        atr = np.where(b["atr"][p] > 0, b["atr"][p], np.nan)
        moved = _rounded(b["close"][p] - way[on] * t["atr_trail"][on] * atr, digits)
        stop[on] = np.where(long_[on], np.fmax(stop[on], moved), np.fmin(stop[on], moved))
        place[on] += 1
        going = on[place[on] <= until[on]]
    return place, stop


def _ends(table: pa.Table, trades: pa.Table, digits: int) -> pa.Table:
    """What a block's bars do to its trades: see first_barrier."""
    table = table.sort_by("bar_idx")
    b = {k: table[k].cast(pa.float64()).to_numpy() for k in ("open", "high", "low", "close", "gap", "atr", "time")}
    first, last_idx = table["bar_idx"][0].as_py(), table["last_idx"][0].as_py()
    n = table.num_rows
    t = {k: trades[k].cast(pa.float64()).to_numpy() for k in ("direction", "stop_price", "target_price", "time_exit_minutes", "atr_trail", "entry_time", "moved")}
    entry = trades["entry_idx"].to_numpy() - first
    t["start"] = np.maximum(trades["from_idx"].to_numpy() - first, 0)
    # Time runs out on the first bar behind the entry at which enough minutes have passed.
    late = np.searchsorted(b["time"], np.nan_to_num(t["entry_time"] + 60 * t["time_exit_minutes"], nan=np.inf) - 1.0, side="left")
    late = np.maximum(late, np.maximum(entry + 1, t["start"]))
    while True:
        early = np.flatnonzero((late < n) & ((b["time"][np.minimum(late, n - 1)] - t["entry_time"]) / 60.0 < t["time_exit_minutes"]))
        if not len(early):
            break
        late[early] += 1
    late = np.where(np.isnan(t["time_exit_minutes"]), n, late)
    ended = first + n - 1 == last_idx
    until = np.minimum(late, n - 1)
    moving = ~np.isnan(t["atr_trail"])
    at, stop = np.empty(len(until), dtype=np.int64), t["stop_price"].copy()
    long_ = t["direction"] == 1
    still = np.flatnonzero(~moving)
    if len(still):
        at[still] = Pyramid(b["high"], b["low"], b["high"] + b["gap"], b["low"] + b["gap"]).first(t["start"][still], until[still], long_[still], stop[still], t["target_price"][still])
    moves = np.flatnonzero(moving)
    if len(moves):
        at[moves], stop[moves] = _follow(b, {k: v[moves] for k, v in t.items()}, until[moves], digits)
    barrier = at <= until
    done = barrier | (late < n) | ended
    at = np.where(barrier, at, until)
    high, low, gap, open_ = b["high"][at], b["low"][at], b["gap"][at], b["open"][at]
    hit_stop = barrier & np.where(long_, low <= stop, high + gap >= stop)
    hit_target = barrier & np.where(long_, high >= t["target_price"], low + gap <= t["target_price"])
    by_stop = np.where(long_, np.fmin(stop, open_), np.fmax(stop - gap, open_))
    by_target = np.where(long_, t["target_price"], t["target_price"] - gap)
    raw = np.where(hit_stop, by_stop, np.where(hit_target, by_target, b["close"][at]))
    which = np.select([hit_stop & hit_target, hit_stop & (np.abs(stop - t["stop_price"]) > 1e-12), hit_stop, hit_target, late <= at], range(5), 5)
    stop_now = np.where(done, np.nan, np.where(moving, stop, t["stop_price"]))
    taken = table.select(["bar_idx", "exit_spread", "exit_ts"]).take(pa.array(at))
    out = trades.drop(["_block", "_part"])
    out = out.set_column(out.column_names.index("moved"), "moved", pa.array(stop_now, mask=np.isnan(stop_now)))
    out = out.set_column(out.column_names.index("from_idx"), "from_idx", pa.array(np.full(len(at), first + n)))
    for name, column in (("exit_idx", taken["bar_idx"]), ("raw_exit", pa.array(raw, mask=np.isnan(raw))), ("exit_reason", pa.array(np.array(REASONS, dtype=object)[which])), ("exit_spread", taken["exit_spread"]), ("exit_ts", taken["exit_ts"]), ("done", pa.array(done))):
        out = out.append_column(name, column)
    return out


def first_barrier(trades: DataFrame, bars: DataFrame, key: list[str], time: Column, point: float, digits: int) -> DataFrame:
    """key, exit_idx, raw_exit, exit_reason, exit_spread, exit_ts: the first bar that ends each trade.

    trades: key (with symbol and entry_idx), direction, stop_price, target_price, time_exit_minutes, atr_trail (nulls: none), entry_time (seconds). bars: symbol, bar_idx (one by
    one), bar_ts, open, high, low, close, spread, atr; time gives their seconds. A stop counts before a target on the same bar. Time runs out by minutes since the entry, at the
    close, but not on the entry bar. The last bar of the data ends all.
    """
    last = bars.groupBy("symbol").agg(F.max("bar_idx").alias("last_idx"))
    block = F.floor(F.col("bar_idx") / BLOCK)
    side = bars.select("symbol", "bar_idx", block.alias("_block"), "open", "high", "low", "close", (F.col("spread") * point).alias("gap"), "atr", time.cast("double").alias("time"), F.col("spread").alias("exit_spread"), F.col("bar_ts").alias("exit_ts"))
    side = side.join(F.broadcast(last), "symbol")  # a row for each symbol
    # Extremes of whole blocks: a list for each symbol, of a row for each BLOCK bars.
    extremes = F.struct("_block", F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.col("low") + F.col("gap")).alias("ask_low"), F.max(F.col("high") + F.col("gap")).alias("ask_high"), F.max("time").alias("time"))
    blocks = side.groupBy("symbol", "_block").agg(extremes.alias("x")).groupBy("symbol").agg(F.array_sort(F.collect_list("x")).alias("_blocks"))

    left = trades.select(*key, "direction", "stop_price", "target_price", "time_exit_minutes", "atr_trail", "entry_time").withColumns({"moved": F.col("stop_price"), "from_idx": F.col("entry_idx").cast("long")})
    left = left.withColumn("_block", F.floor(F.col("from_idx") / BLOCK))
    kept_columns = [f for f in left.schema.fields if f.name != "_block"]
    out = T.StructType([
        *kept_columns, T.StructField("exit_idx", T.LongType()), T.StructField("raw_exit", T.DoubleType()), T.StructField("exit_reason", T.StringType()),
        T.StructField("exit_spread", side.schema["exit_spread"].dataType), T.StructField("exit_ts", side.schema["exit_ts"].dataType), T.StructField("done", T.BooleanType()),
    ])

    def run(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return out_arrow.empty_table()
        found = _ends(two, one, digits)
        return pa.Table.from_arrays([found[f.name].cast(f.type) for f in out_arrow], schema=out_arrow)

    out_arrow = to_arrow_schema(out)
    finished = None
    while True:
        left = checkpointed(left)
        # Blocks that many trades enter are dealt to several tasks, each with the block's bars.
        parts = left.groupBy("symbol", "_block").agg(F.ceil(F.count("*") / TRADES).cast("int").alias("_parts"))
        dealt = left.join(F.broadcast(parts), ["symbol", "_block"]).withColumn("_part", F.pmod(F.xxhash64(*key), F.col("_parts")).cast("int")).drop("_parts")
        copies = side.join(F.broadcast(parts), ["symbol", "_block"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        dealt, copies = dealt.toDF(*dealt.columns), copies.toDF(*copies.columns)  # a cogroup wants columns of its own on each side
        group = ["symbol", "_block", "_part"]
        found = checkpointed(dealt.groupBy(*group).cogroup(copies.groupBy(*group)).applyInArrow(run, out))
        part = found.filter("done").select(*key, "exit_idx", "raw_exit", "exit_reason", "exit_spread", "exit_ts")
        finished = part if finished is None else finished.unionByName(part)
        rest = found.filter("not done")
        if rest.isEmpty():
            return finished
        # The next block that can end the trade: one whose extremes reach it, or in which its time runs out, or the last one. Moving stops are asked everywhere.
        long_, b = F.col("direction") == 1, F.col
        can = lambda x: F.when(b("atr_trail").isNotNull(), F.lit(True)).otherwise(
            F.coalesce(F.when(long_, x["low"] <= b("stop_price")).otherwise(x["ask_high"] >= b("stop_price")), F.lit(False))
            | F.coalesce(F.when(long_, x["high"] >= b("target_price")).otherwise(x["ask_low"] <= b("target_price")), F.lit(False))
            | F.coalesce((x["time"] - b("entry_time")) / 60.0 >= b("time_exit_minutes"), F.lit(False))
            | (x["_block"] == F.element_at("_blocks", -1)["_block"])
        )
        after = rest.select(*[f.name for f in kept_columns]).join(F.broadcast(blocks), "symbol")
        after = after.withColumn("_block", F.get(F.filter("_blocks", lambda x: (x["_block"] * BLOCK >= b("from_idx")) & can(x)), F.lit(0))["_block"]).filter("_block is not null")
        left = after.withColumn("from_idx", F.greatest("from_idx", F.col("_block") * BLOCK)).drop("_blocks")


#: Milliseconds of a block of ticks.
STRETCH = 3_600_000
_HIT = ["trade_id", "trigger_msc", "kind"]


def _levels(trades: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(long, stop, target) of trades."""
    stop, target = (trades[c].cast(pa.float64()).to_numpy() for c in ("stop_price", "target_price"))
    return trades["direction"].to_numpy() == 1, stop, target


def _tick_hits(trades: pa.Table, ticks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of trades that a block's ticks trigger, when, how)."""
    ticks = ticks.sort_by("time_msc")
    time, bid, ask = ticks["time_msc"].to_numpy(), *(ticks[c].cast(pa.float64()).to_numpy() for c in ("bid", "ask"))
    long_, stop, target = _levels(trades)
    start = np.searchsorted(time, trades["anchor_msc"].to_numpy(), side="right")
    at = Pyramid(bid, bid, ask, ask).first(start, np.full(len(start), len(time) - 1), long_, stop, target)
    hit = np.flatnonzero(at < len(time))
    at, long_, stop, target = at[hit], long_[hit], stop[hit], target[hit]
    when, by_stop, by_target = time[at], np.zeros(len(hit), dtype=bool), np.zeros(len(hit), dtype=bool)
    same = np.arange(len(hit))  # if both levels are reached in one millisecond, the order is not known
    while len(same):
        price = np.where(long_[same], bid[at[same]], ask[at[same]])
        by_stop[same] |= np.where(long_[same], price <= stop[same], price >= stop[same])
        by_target[same] |= np.where(long_[same], price >= target[same], price <= target[same])
        at[same] += 1
        same = same[at[same] < len(time)]
        same = same[time[at[same]] == when[same]]
    return hit, when, np.where(by_stop & by_target, "AMBIGUOUS", np.where(by_stop, "SL", "TP"))


def first_trigger(trades: DataFrame, ticks: DataFrame) -> DataFrame:
    """trade_id, trigger_msc, kind (SL, TP or AMBIGUOUS): the first tick after the anchor at which a level is reached; longs are closed at the bid, shorts at the ask.

    trades: trade_id, symbol, direction, stop_price, target_price, anchor_msc. Ticks are cut into hours. A trade is held against the rest of its hour; else against the extremes
    of all later hours, of which the first that reaches a level holds the tick. No trade meets the ticks between.
    """
    keys = ["trade_id", "symbol", "direction", "stop_price", "target_price", "anchor_msc"]
    block = lambda x: F.floor(F.col(x) / STRETCH)
    side = ticks.select(F.col("symbol").alias("_symbol"), "time_msc", "bid", "ask", block("time_msc").alias("_hour"))
    hours = checkpointed(side.groupBy("_symbol", "_hour").agg(F.max("bid").alias("high"), F.min("bid").alias("low"), F.max("ask").alias("ask_high"), F.min("ask").alias("ask_low")))
    asked = checkpointed(trades.select(*keys).filter("anchor_msc is not null").withColumn("_block", block("anchor_msc")))
    kinds = {f.name: f for f in asked.schema.fields}
    out = T.StructType([*(kinds[k] for k in keys), T.StructField("_block", T.LongType()), T.StructField("trigger_msc", T.LongType()), T.StructField("kind", T.StringType())])
    arrow = to_arrow_schema(out)

    def table(rows: pa.Table, block: np.ndarray, when: np.ndarray, how: np.ndarray, known: np.ndarray) -> pa.Table:
        columns = [*(rows[k] for k in keys), pa.array(block), pa.array(when, mask=~known), pa.array(how.astype(object), mask=~known)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def in_hour(rows: pa.Table, ticks: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return arrow.empty_table()
        when, how, known = np.zeros(rows.num_rows, dtype=np.int64), np.full(rows.num_rows, "", dtype=object), np.zeros(rows.num_rows, dtype=bool)
        if ticks.num_rows:
            hit, when[hit], how[hit] = _tick_hits(rows, ticks)
            known[hit] = True
        return table(rows, rows["_block"].to_numpy(), when, how, known)

    def next_hour(rows: pa.Table, hours: pa.Table) -> pa.Table:
        if not rows.num_rows or not hours.num_rows:
            return arrow.empty_table()
        hours = hours.sort_by("_hour")
        number = hours["_hour"].to_numpy()
        x = {c: hours[c].cast(pa.float64()).to_numpy() for c in ("high", "low", "ask_high", "ask_low")}
        start = np.searchsorted(number, rows["_block"].to_numpy(), side="right")
        at = Pyramid(**x).first(start, np.full(len(start), len(number) - 1), *_levels(rows))
        rows, at = rows.filter(pa.array(at < len(number))), at[at < len(number)]
        none = np.zeros(len(at), dtype=bool)
        return table(rows, number[at], np.zeros(len(at), dtype=np.int64), np.full(len(at), "", dtype=object), none)

    def dealt(rows: DataFrame, beside: DataFrame, group: dict[str, str], run) -> DataFrame:
        """run over the groups, of which those with many trades are dealt to several tasks."""
        parts = rows.groupBy(*group).agg(F.ceil(F.count("*") / TRADES).cast("int").alias("_parts"))
        own = rows.join(F.broadcast(parts), [*group]).withColumn("_part", F.pmod(F.xxhash64("trade_id"), F.col("_parts")).cast("int")).drop("_parts")
        renamed = parts.toDF(*(group.get(c, c) for c in parts.columns))
        copies = beside.join(F.broadcast(renamed), [*group.values()]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        own, copies = own.toDF(*own.columns), copies.toDF(*copies.columns)
        return checkpointed(own.groupBy(*group, "_part").cogroup(copies.groupBy(*group.values(), "_part")).applyInArrow(run, out))

    by_hour = {"symbol": "_symbol", "_block": "_hour"}
    first = dealt(asked, side, by_hour, in_hour)
    left = first.filter("kind is null").select(*keys, "_block")
    later = dealt(left, hours, {"symbol": "_symbol"}, next_hour).select(*keys, "_block")
    return first.filter("kind is not null").select(*_HIT).unionByName(dealt(later, side, by_hour, in_hour).filter("kind is not null").select(*_HIT))
