"""Coarser bars and the moving-average cross rule on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.functions.calendar import epoch
from barspark.operators.features import recursive_averages
from barspark.operators.frames import Frames, mean
from barspark.operators.scan import asof


def resample(bars: DataFrame, seconds: int) -> DataFrame:
    """symbol, bucket, close_time (epoch of the bucket's end), open, high, low, close, last_idx of every bucket that has bars. Buckets start at multiples of the length since 1970."""
    bucket = F.floor(epoch(F.col("bar_ts")) / seconds)
    grouped = bars.withColumn("bucket", bucket).groupBy("symbol", "bucket").agg(
        F.min_by("open", "bar_idx").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_idx").alias("close"), F.max("bar_idx").alias("last_idx"),
    )
    full = grouped.filter(" and ".join(f"{c} is not null" for c in ("open", "high", "low", "close")))
    return full.select("symbol", "bucket", ((F.col("bucket") + 1) * seconds).alias("close_time"), "open", "high", "low", "close", "last_idx")


def simple_atr(df: DataFrame, n: int, w: Frames):
    """Mean of the last n true ranges, which need a previous close each; null before."""
    tr = F.greatest("high", w.lag("close")) - F.least("low", w.lag("close"))
    tr = F.when(w.lag("close").isNotNull(), tr)
    df = df.withColumn("_tr", tr)
    return df.withColumn(f"sma_atr_{n}", mean("_tr", n, w.own(n))).drop("_tr")


def cross_state(bars: DataFrame, fast_seconds: int = 300, slow_seconds: int = 900, fast: int = 9, slow: int = 21, rsi: int = 14, atr: int = 14, trend: int = 200) -> DataFrame:
    """Indicators of each fast bar beside the last slow bar that was complete by its end."""
    w = Frames("symbol", order="bucket")
    place = F.row_number().over(w.base) - 1
    near = resample(bars, fast_seconds).withColumn("_place", place)
    change = F.col("close") - w.lag("close")
    near = near.withColumns({"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0)), "true_range": F.lit(0.0)})
    near = recursive_averages(near, ["symbol"], "_place", (), (), (rsi,))
    near = simple_atr(near, atr, w).withColumns({"fast": mean("close", fast, w.own(fast)), "slow": mean("close", slow, w.own(slow))})
    near = near.withColumns({"fast_before": w.lag("fast"), "slow_before": w.lag("slow")})
    far = resample(bars, slow_seconds).withColumn("htf_sma", mean("close", trend, w.own(trend)))
    far = far.select("symbol", F.col("close_time").alias("htf_time"), F.col("close").alias("htf_close"), "htf_sma")
    keep = ["symbol", "bucket", "close_time", "close", "last_idx", "fast", "slow", "fast_before", "slow_before", F.col(f"rsi_{rsi}").alias("rsi"), F.col(f"sma_atr_{atr}").alias("execution_atr")]
    return asof(near.select(*keep), far, ["symbol"], "close_time", "htf_time", ["htf_close", "htf_sma"])


def cross_signal(bars: DataFrame, overbought: float = 70.0, oversold: float = 30.0, fast_seconds: int = 300, **lengths) -> DataFrame:
    """symbol, bar_idx (last bar of the fast bucket), entry_idx, signal, execution_atr and the indicator values. The next bar must lie in the next bucket."""
    state = cross_state(bars, fast_seconds, **lengths)
    w = Frames("symbol")
    follow = bars.select("symbol", F.col("bar_idx").alias("last_idx"), w.lead("bar_idx").alias("entry_idx"), F.floor(epoch(w.lead("bar_ts")) / fast_seconds).alias("next_bucket"))
    df = state.join(follow, ["symbol", "last_idx"]).filter(F.col("next_bucket") == F.col("bucket") + 1)
    up = (F.col("fast_before") <= F.col("slow_before")) & (F.col("fast") > F.col("slow")) & (F.col("rsi") < overbought) & (F.col("htf_close") > F.col("htf_sma"))
    down = (F.col("fast_before") >= F.col("slow_before")) & (F.col("fast") < F.col("slow")) & (F.col("rsi") > oversold) & (F.col("htf_close") < F.col("htf_sma"))
    signal = F.when(F.col("execution_atr").isNotNull(), F.when(up, 1).when(down, -1))
    return df.withColumn("signal", signal).filter("signal is not null").select("symbol", F.col("last_idx").alias("bar_idx"), "entry_idx", "signal", "close", "fast", "slow", "rsi", "execution_atr", "htf_close", "htf_sma")


def export_signals(bars: DataFrame, start: str, end: str, **lengths) -> DataFrame:
    """cross_signal rows whose entry bar lies in [start, end), with times and prices of signal and entry bar."""
    w = Frames("symbol")
    own = bars.select("symbol", "bar_idx", F.col("bar_ts").alias("signal_ts"), w.lead("bar_ts").alias("entry_ts"), w.lead("open").alias("entry_open"), w.lead("spread").alias("entry_spread"))
    inside = (F.col("entry_ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("entry_ts") < F.lit(end).cast("timestamp_ntz"))
    return cross_signal(bars, **lengths).join(own, ["symbol", "bar_idx"]).filter(inside)
