"""Lagged features of bars, computed within the segments between irregular gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.operators.frames import Frames, highest, lowest, mean, slope, std
from barspark.operators.scan import affine_scans, seeded_input

SMA, EMA, ATR, RSI, RANGE, TREND = (5, 9, 21, 50, 100, 200), (9, 21, 50, 100, 200), (7, 14, 28), (7, 14, 21), (5, 10, 20, 50), (10, 20, 50)
KEYS = ["symbol", "segment_id"]


def candle_columns(w: Frames) -> dict[str, Column]:
    before = w.lag("close")
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "return_1": c / before - 1, "log_return_1": F.log(c / before), "range": h - low, "body": F.abs(c - o),
        "upper_wick": h - F.greatest(o, c), "lower_wick": F.least(o, c) - low,
        "true_range": F.greatest(h - low, F.abs(h - F.coalesce(before, c)), F.abs(low - F.coalesce(before, c))),
        "_gain": F.greatest(c - before, F.lit(0.0)), "_loss": F.greatest(before - c, F.lit(0.0)), "_move": F.abs(c - before),
    }


def recursive_averages(df: DataFrame, keys: list[str], place: str, ema=EMA, atr=ATR, rsi=RSI) -> DataFrame:
    """df (close, true_range, _gain, _loss) with ema_n, atr_n (Wilder) and rsi_n (Wilder); null before their first value. All of them share one pass over blocks."""
    at = F.col(place)
    scans = {f"ema_{n}": (seeded_input("close", at, n, 2 / (n + 1), keys, place), 1 - 2 / (n + 1)) for n in ema}
    scans |= {f"atr_{n}": (seeded_input("true_range", at, n, 1 / n, keys, place), (n - 1) / n) for n in atr}
    for n in rsi:
        scans |= {f"_{k}_{n}": (F.coalesce(seeded_input(f"_{k}", at, n, 1 / n, keys, place, skip=1), F.lit(0.0)), (n - 1) / n) for k in ("gain", "loss")}
    df = df.withColumns({f"_in_{name}": x for name, (x, _) in scans.items()})
    df = affine_scans(df, keys, place, {name: (F.col(f"_in_{name}"), a) for name, (_, a) in scans.items()})
    out = {f"ema_{n}": F.when(at >= n - 1, F.col(f"ema_{n}")) for n in ema} | {f"atr_{n}": F.when(at >= n - 1, F.col(f"atr_{n}")) for n in atr}
    for n in rsi:
        gain, loss = F.col(f"_gain_{n}"), F.col(f"_loss_{n}")
        value = F.when(loss == 0, F.when(gain == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + gain / loss))
        out[f"rsi_{n}"] = F.when(at >= n, value)
    return df.withColumns(out).drop(*(f"_in_{name}" for name in scans), *(f"_{k}_{n}" for n in rsi for k in ("gain", "loss")))


def features(bars: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """bars with all features of the same bar. keys cut the series; each part starts anew."""
    w = Frames(*keys)
    df = bars.withColumn("_place", F.row_number().over(w.base) - 1).withColumns(candle_columns(w))
    df = recursive_averages(df, keys, "_place")
    df = df.withColumns({f"sma_{n}": mean("close", n, w.own(n)) for n in SMA} | {"boll_mid_20_2": mean("close", 20, w.own(20)), "_std": std("close", 20, w.own(20))})
    mid, dev = F.col("boll_mid_20_2"), F.col("_std")
    df = df.withColumns({"boll_upper_20_2": mid + 2 * dev, "boll_lower_20_2": mid - 2 * dev, "boll_bandwidth_20_2": 4 * dev / F.nullif(mid, F.lit(0.0)), "boll_zscore_20_2": F.when(dev > 0, (F.col("close") - mid) / dev)})
    df = df.withColumns({f"rolling_high_{n}": highest("high", n, w.own(n)) for n in RANGE} | {f"rolling_low_{n}": lowest("low", n, w.own(n)) for n in RANGE})
    width = {n: F.col(f"rolling_high_{n}") - F.col(f"rolling_low_{n}") for n in RANGE}
    df = df.withColumns({f"range_position_{n}": F.when(width[n] > 0, (F.col("close") - F.col(f"rolling_low_{n}")) / width[n]) for n in RANGE})
    more = {}
    for n in TREND:
        path = F.when(F.count("_move").over(w.own(n)) == n, F.sum("_move").over(w.own(n)))
        more |= {f"realized_vol_{n}": std("log_return_1", n, w.own(n)), f"regression_slope_{n}": slope("close", n, w.own(n))}
        more[f"efficiency_ratio_{n}"] = F.when(path == 0, 0.0).otherwise(F.abs(F.col("close") - w.lag("close", n)) / path)
    return df.withColumns(more).drop("_place", "_std", "_gain", "_loss", "_move")


def names(df: DataFrame, bars: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in bars.columns and c != "true_range"]


def lagged_features(bars: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """bars with every feature of the bar before, within the segment, as <name>_lag1; the first bar of a segment has nulls."""
    df, w = features(bars, keys), Frames(*keys)
    return df.select(*bars.columns, *(w.lag(c).alias(f"{c}_lag1") for c in names(df, bars)))


def with_lagged_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """bars with atr: the Wilder average true range up to the bar before."""
    w = Frames("symbol")
    df = bars.withColumns({k: v for k, v in candle_columns(w).items() if k in ("true_range", "_gain", "_loss")})
    df = recursive_averages(df, ["symbol"], "bar_idx", (), (n,), ())
    return df.withColumn("atr", w.lag(f"atr_{n}")).drop("true_range", f"atr_{n}", "_gain", "_loss")
