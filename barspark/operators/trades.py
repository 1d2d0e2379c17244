"""From signals to trades, as joins and windows over whole tables.

A signal on a bar is entered at the open of the next bar, with the signal bar's atr. What a trade would come to depends on its own entry only, so
outcomes are found for all candidates at once; then the candidates that do not overlap are chosen in order of time.

signals: experiment_id, symbol, bar_idx, signal. bars: symbol, bar_idx, bar_ts, open, high, low, close, spread, atr.
settings, a row for each experiment: experiment_id, stop_atr, target_r, time_exit_minutes, atr_trail (nulls: none), commission, slippage, preferred_risk, hard_risk, max_lot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.calendar import epoch
from barspark.functions.prices import entry_price, exit_price, lot_for_stop, round_price
from barspark.functions.store import checkpointed
from barspark.operators.barriers import first_barrier
from barspark.operators.frames import Frames
from barspark.operators.scan import asof, non_overlapping

POINT, DIGITS, CONTRACT = 0.01, 2, 1.0
KEY = ["experiment_id", "symbol", "entry_idx"]


def c(name: str) -> Column:
    return F.col(name)


def candidates(signals: DataFrame, bars: DataFrame, settings: DataFrame) -> DataFrame:
    """A row for each signal that has a next bar and an atr, with entry price, stop, target, lot (null: no lot is within the risk) and planned risk."""
    w = Frames("symbol")
    entry = bars.select("symbol", "bar_idx", "atr", c("close").alias("signal_price"), c("bar_ts").alias("signal_ts"), w.lead("bar_idx").alias("entry_idx"), w.lead("open").alias("raw_entry"), w.lead("spread").alias("entry_spread"), w.lead("bar_ts").alias("entry_ts"))
    rows = signals.filter("signal != 0").join(entry.filter("entry_idx is not null and atr > 0"), ["symbol", "bar_idx"]).join(settings, "experiment_id")
    return bracket_levels(rows.withColumnRenamed("bar_idx", "signal_idx").withColumnRenamed("signal", "direction"))


def bracket_levels(rows: DataFrame) -> DataFrame:
    way = c("direction")
    rows = rows.withColumn("entry_price", entry_price(c("raw_entry"), c("entry_spread"), way, c("slippage"), POINT, DIGITS))
    rows = rows.withColumn("stop_price", round_price(c("entry_price") - way * c("stop_atr") * c("atr"), DIGITS))
    rows = rows.withColumn("target_price", round_price(c("entry_price") + way * c("target_r") * F.abs(c("entry_price") - c("stop_price")), DIGITS))
    rows = rows.withColumn("lot", lot_for_stop(c("entry_price"), c("stop_price"), c("preferred_risk"), c("hard_risk"), c("max_lot"), CONTRACT))
    return rows.withColumn("planned_risk", F.abs(c("entry_price") - c("stop_price")) * CONTRACT * c("lot"))


def outcomes(cands: DataFrame, bars: DataFrame) -> DataFrame:
    """For each candidate the first bar that ends it: exit_idx, raw_exit, exit_reason, exit_spread, exit_ts."""
    return first_barrier(cands.withColumn("entry_time", epoch(c("entry_ts")).cast("double")), bars, KEY, epoch(c("bar_ts")), POINT, DIGITS)


def trade_economics(trades: DataFrame) -> DataFrame:
    """gross_pnl, costs, net_pnl, pnl_r, exit_price and hold_minutes. A long pays the entry's spread, a short the exit's."""
    way, size = c("direction"), c("lot") * CONTRACT
    t = trades.withColumn("gross_pnl", way * (c("raw_exit") - c("raw_entry")) * size)
    t = t.withColumn("spread_cost", F.when(way == 1, c("entry_spread")).otherwise(c("exit_spread")) * POINT * size)
    t = t.withColumn("slippage_cost", 2 * c("slippage") * POINT * size).withColumn("commission_cost", c("commission") * c("lot"))
    t = t.withColumn("net_pnl", c("gross_pnl") - c("spread_cost") - c("slippage_cost") - c("commission_cost"))
    t = t.withColumn("pnl_r", F.when(c("planned_risk") > 0, c("net_pnl") / c("planned_risk")))
    t = t.withColumn("exit_price", exit_price(c("raw_exit"), c("exit_spread"), way, c("slippage"), POINT, DIGITS))
    return t.withColumn("hold_minutes", (epoch(c("exit_ts")) - epoch(c("entry_ts"))) / 60.0)


FLAGS = ("session_asia", "session_london", "session_new_york", "session_overlap")


def annotate(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """trades with broker_date and session flags of the entry bar, and trade_seq in order of entry."""
    flags = [f for f in FLAGS if f in bars.columns]
    at = bars.select("symbol", c("bar_idx").alias("entry_idx"), F.date_format("bar_ts", "yyyy-MM-dd").alias("broker_date"), *flags)
    seq = F.row_number().over(Window.partitionBy("experiment_id").orderBy("entry_idx", "symbol"))
    return trades.join(at, ["symbol", "entry_idx"], "left").withColumn("trade_seq", seq)


def choose_trades(cands: DataFrame, bars: DataFrame) -> DataFrame:
    """The candidates with a lot, with their outcomes, one position at a time for each experiment and symbol."""
    # The filter comes behind the cut, as in front of it all of a lot's arithmetic would be written out again and again in one method.
    able = checkpointed(cands).filter("lot is not null")
    chosen = non_overlapping(outcomes(able, bars), ["experiment_id", "symbol"], "entry_idx", "exit_idx", gap=1)
    return able.join(checkpointed(chosen), KEY)


def risk_skips(cands: DataFrame, trades: DataFrame) -> DataFrame:
    """experiment_id, risk_skip_count: candidates without a lot at whose entry no trade was open."""
    skipped = cands.filter("lot is null").select("experiment_id", "symbol", c("entry_idx").alias("skip_idx"))
    open_ = trades.select("experiment_id", "symbol", "entry_idx", "exit_idx")
    free = asof(skipped, open_, ["experiment_id", "symbol"], "skip_idx", "entry_idx", ["exit_idx"]).filter(c("exit_idx").isNull() | (c("exit_idx") < c("skip_idx")))
    return free.groupBy("experiment_id").agg(F.count("*").alias("risk_skip_count"))


def signals_to_trades(signals: DataFrame, bars: DataFrame, settings: DataFrame) -> DataFrame:
    cands = candidates(signals, bars, settings)
    return annotate(trade_economics(choose_trades(cands, bars)), bars)


def export_trades(trades: DataFrame, zone: str = "EET") -> DataFrame:
    """The trades with times as ISO strings of the broker's zone, in a fixed column order, for CSV or Parquet."""
    stamp = lambda x: F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), c(x)), "yyyy-MM-dd'T'HH:mm:ss")
    return trades.select(
        "experiment_id", "trade_seq", "symbol", stamp("signal_ts").alias("signal_time"), stamp("entry_ts").alias("entry_time"), stamp("exit_ts").alias("exit_time"), "direction", "signal_price", "entry_price", "stop_price", "target_price", "exit_price",
        "exit_reason", "lot", "planned_risk", "gross_pnl", "spread_cost", "commission_cost", "slippage_cost", "net_pnl", "pnl_r", "hold_minutes", "broker_date",
    )
