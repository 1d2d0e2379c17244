"""Operators on literal frames and against plain loops on random series."""

from __future__ import annotations

import datetime as dt
import importlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.functions import prices
from barspark.operators import barriers, features, metrics, quality, scan, signals, trades, validation
from barspark.operators.frames import Frames

BAR = "symbol string, bar_ts timestamp_ntz, bar_idx long, open double, high double, low double, close double, tick_volume long, spread long, real_volume long, atr double, session_asia boolean, session_london boolean, session_new_york boolean"


def random_bars(spark, n=600, seed=1, symbols=("A",), step=0.6):
    rng, rows = np.random.default_rng(seed), []
    for s in symbols:
        close = 100 + np.cumsum(rng.normal(0, step, n))
        for i in range(n):
            o = close[i - 1] if i else 100.0
            h, low = max(o, close[i]) + abs(rng.normal(0, 0.3)), min(o, close[i]) - abs(rng.normal(0, 0.3))
            t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
            atr = float(0.5 + rng.random()) if i > 3 else None
            rows.append((s, t, i, float(o), float(h), float(low), float(close[i]), 10, int(rng.integers(1, 9)), 0, atr, t.hour < 8, 7 <= t.hour < 15, 13 <= t.hour < 20))
    return spark.createDataFrame(rows, BAR), rows


def got_signals(df):
    return {(r.symbol, r.bar_idx): r.signal for r in df.filter("signal != 0").collect()}


def test_dirty_bars(spark):
    t = [dt.datetime(2024, 1, 1, 0, m) for m in (0, 1, 1, 4)]
    rows = [("A", t[0], 0, 10.0, 11.0, 9.0, 10.5, 5, 2, 0), ("A", t[1], 1, 10.0, 9.0, 9.5, 10.5, 5, 2, 0), ("A", t[2], 2, 10.0, 11.0, 9.0, 10.2, 5, 3, 0), ("A", t[3], 3, 10.0, 11.0, 9.0, 10.2, -5, -1, 0)]
    raw = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, ingest_seq long, open double, high double, low double, close double, tick_volume long, spread long, real_volume long")
    counts = {r.issue_type: r.n for r in quality.issues(raw).groupBy("issue_type").agg(F.count("*").alias("n")).collect()}
    assert counts == {"duplicate_timestamp": 2, "invalid_ohlc": 1, "invalid_spread": 1, "negative_volume": 1, "unexpected_gap": 1}
    assert [(r.bar_ts.minute, r.close) for r in quality.clean_bars(raw).orderBy("bar_ts").collect()] == [(0, 10.5), (1, 10.2)]
    s = quality.summary(raw).first()
    assert (s.input_rows, s.clean_rows, s.removed_rows, s.non_monotonic_input) == (4, 2, 2, False)
    assert quality.issues(raw.limit(0)).count() == 0


def test_gap_columns(spark):
    minute = dt.timedelta(minutes=1)
    times = [dt.datetime(2024, 1, 2, 0, 59)]
    times.append(times[-1] + 71 * minute)  # a scheduled break to 02:10
    times += [times[-1] + 11 * minute]
    times += [times[-1] + k * minute for k in range(1, 205)]
    df = spark.createDataFrame([("A", t, i) for i, t in enumerate(times)], "symbol string, bar_ts timestamp_ntz, bar_idx long")
    rows = quality.gap_columns(df).orderBy("bar_idx").collect()
    assert rows[1].is_scheduled_break_after and not rows[1].is_irregular_gap_after and rows[1].entry_allowed
    assert rows[2].is_irregular_gap_after and rows[2].segment_id == 1
    assert [r.entry_allowed for r in rows] == [True, True] + [False] * 200 + [True] * 5
    with pytest.raises(Exception, match="times must increase"):
        quality.gap_columns(df.unionByName(df.withColumn("bar_idx", F.col("bar_idx") + 1000))).collect()


def test_recursive_averages_over_many_blocks(spark):
    df, rows = random_bars(spark, 1500)
    out = features.features(df.withColumn("segment_id", F.lit(0))).orderBy("bar_idx").collect()
    close = [r[6] for r in rows]
    for n in (9, 200):
        y = float(np.mean(close[:n]))
        for i in range(n, 1500):
            y = y + 2 / (n + 1) * (close[i] - y)
            assert out[i][f"ema_{n}"] == pytest.approx(y, rel=1e-11)
        assert out[n - 2][f"ema_{n}"] is None
    change = np.diff(close)
    up, down = np.maximum(change, 0), np.maximum(-change, 0)
    g, d = up[:14].mean(), down[:14].mean()
    for i in range(14, 1499):
        g, d = (13 * g + up[i]) / 14, (13 * d + down[i]) / 14
        assert out[i + 1]["rsi_14"] == pytest.approx(100 - 100 / (1 + g / d), rel=1e-9)


def test_features_do_not_look_ahead(spark):
    df, _ = random_bars(spark, 300)
    df = df.withColumn("segment_id", F.lit(0))
    wild = df.withColumns({c: F.when(F.col("bar_idx") == 299, F.col(c) * 100).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    a, b = (features.lagged_features(x).filter("bar_idx = 299").first().asDict() for x in (df, wild))
    for name in a:
        if name.endswith("_lag1"):
            assert a[name] == pytest.approx(b[name], nan_ok=True)


def test_expanding_quantile_of_long_series(spark, monkeypatch):
    df, rows = random_bars(spark, 700, seed=4, symbols=("A", "B"))
    df = df.withColumn("v", F.round(F.col("high") - F.col("low"), 1))
    w = Frames("symbol")
    short = {(r.symbol, r.bar_idx): r.q for r in signals.expanding_quantile(df, "v", 0.3, w, "q").collect()}
    monkeypatch.setattr(signals, "EXPANDING_LIMIT", 10)
    monkeypatch.setattr(signals, "_RANK_BLOCK", 32)
    long_ = {(r.symbol, r.bar_idx): r.q for r in signals.expanding_quantile(df, "v", 0.3, w, "q").collect()}
    assert short == pytest.approx(long_)


def test_greedy_choice_of_long_series(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(s), int(s + rng.integers(0, 30))) for k in "ab" for s in rng.choice(2000, 300, replace=False)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    want = set()
    for k in "ab":
        last = None
        for _, s, e in sorted(r for r in rows if r[0] == k):
            if last is None or s >= last + 1:
                want.add((k, s))
                last = e
    assert {(r.k, r.s) for r in scan.non_overlapping(df, ["k"], "s", "e", 1).collect()} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # keys run over batches
    try:
        assert {(r.k, r.s) for r in scan.non_overlapping(df, ["k"], "s", "e", 1).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert scan.non_overlapping(df.limit(0), ["k"], "s", "e", 1).count() == 0
    assert scan.non_overlapping(df.limit(0), ["k"], "s", "e").count() == 0


def test_asof(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 3)], "k string, t long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 8, "z")], "k string, at long, v string")
    back = {(r.k, r.t): r.v for r in scan.asof(left, right, ["k"], "t", "at", ["v"]).collect()}
    assert back == {("a", 5): "y", ("a", 1): None, ("b", 9): None, (None, 3): None}
    ahead = {(r.k, r.t): r.v for r in scan.asof(left, right, ["k"], "t", "at", ["v"], forward=True).collect()}
    assert ahead == {("a", 5): "y", ("a", 1): "x", ("b", 9): None, (None, 3): None}


def retest_by_hand(rows, p, scale):
    """One bar at a time: wait for quiet, for a break, for a return and its confirmation."""
    n, out = p["compression_lookback"], {}
    phase, fresh, box = "idle", True, None
    for i, (_, _, _, o, h, low, c, *_rest) in enumerate(rows):
        atr = rows[i - 1][10] if i else None
        hi, lo = (max(r[4] for r in rows[i - n : i]), min(r[5] for r in rows[i - n : i])) if i >= n else (None, None)
        quiet = hi is not None and atr is not None and (hi - lo) / (atr * scale) <= p["compression_atr_ratio"]
        if phase == "retest":
            b, way, level, a, touched = box
            if i - b > p["retest_window_bars"]:
                phase, fresh = "idle", False
            else:
                beyond = (c - level) * way
                if beyond < -p["retest_tolerance_atr"] * a:
                    phase, fresh = "idle", False
                else:
                    touched = touched or ((low - level) if way > 0 else (level - h)) <= p["retest_tolerance_atr"] * a
                    if touched and beyond >= p["confirmation_atr"] * a and (c - o) * way > 0:
                        out[("A", i)] = way
                        phase, fresh = "idle", False
                    else:
                        box = (b, way, level, a, touched)
            continue
        if phase == "idle":
            if not quiet:
                fresh = True
                continue
            if not fresh:
                continue
            phase, box = "armed", (hi, lo, atr)
        top, bottom, a = box
        big = abs(c - o) >= p["breakout_body_atr"] * a
        way = 1 if c > top + p["breakout_buffer_atr"] * a and c > o and big else -1 if c < bottom - p["breakout_buffer_atr"] * a and c < o and big else 0
        if way:
            phase, box = "retest", (i, way, top if way > 0 else bottom, a, False)
        elif not quiet:
            phase, fresh = "idle", True
    return out


@pytest.mark.parametrize(("name", "ratio"), [("compression_breakout_retest", 4.0), ("compression_breakout_retest_v2", 1.4)])
def test_retest(spark, name, ratio):
    p = {"compression_lookback": 8, "compression_atr_ratio": ratio, "breakout_buffer_atr": 0.0, "breakout_body_atr": 0.1, "retest_window_bars": 10, "retest_tolerance_atr": 0.5, "confirmation_atr": 0.0}
    total = 0
    for seed in (1, 2, 3):
        df, rows = random_bars(spark, 700, seed=seed)
        want = retest_by_hand(rows, p, 8**0.5 if name.endswith("v2") else 1.0)
        assert got_signals(signals.evaluate(df, name, p)) == want
        total += len(want)
    assert total > 10


def sweep_by_hand(rows, p):
    """For each target session: its reference range, then its bars one by one."""
    asia = p["transition"] == "asia_to_london"
    src, tgt = (11, 12) if asia else (12, 13)
    out, n = {}, len(rows)
    used = set()
    for s in range(n):
        if not rows[s][tgt] or (s and rows[s - 1][tgt]):
            continue
        if asia:
            ends = [e for e in range(1, s + 1) if rows[e - 1][src] and not rows[e][src]]
            if not ends or ends[-1] in used:
                continue
            used.add(ends[-1])
            e = ends[-1]
        else:
            e = s
            if not (rows[s - 1][src] if s else False):
                continue
        b = e
        while b and rows[b - 1][src]:
            b -= 1
        top, bottom = max(r[4] for r in rows[b:e]), min(r[5] for r in rows[b:e])
        atrs = [r[10] for r in rows[:s] if r[10]]
        if not atrs or top <= bottom:
            continue
        a, side, at = atrs[-1], 0, None
        for i in range(s, min(n, s + p["entry_window_bars"])):
            _, _, _, o, h, low, c = rows[i][:7]
            if not rows[i][tgt]:
                break
            up, down = h > top + p["sweep_atr"] * a, low < bottom - p["sweep_atr"] * a
            if side == 0:
                if up and down:
                    break
                side, at = (1, i) if up else (-1, i) if down else (0, None)
            elif (side == 1 and down) or (side == -1 and up):
                break
            if side:
                if i - at > p["max_reclaim_bars"]:
                    break
                depth = p["reclaim_depth_atr"] * a
                if side == 1 and c < top - depth and c < o:
                    out[("A", i)] = -1
                    break
                if side == -1 and c > bottom + depth and c > o:
                    out[("A", i)] = 1
                    break
    return out


@pytest.mark.parametrize("transition", ["asia_to_london", "london_pre_ny_to_new_york"])
def test_sweep(spark, transition):
    p = {"transition": transition, "entry_window_bars": 6, "sweep_atr": 0.1, "max_reclaim_bars": 3, "reclaim_depth_atr": 0.05}
    df, rows = random_bars(spark, 1500, seed=9)
    want = sweep_by_hand(rows, p)
    assert got_signals(signals.evaluate(df, "prior_session_sweep_reclaim", p)) == want and len(want) > 8


def test_rules_reject_what_they_do_not_know():
    signals.check_params("sma_slope", {"lookback": 20, "slope_horizon": 2})
    for bad in ({"lookback": 4}, {"length": 3}):
        with pytest.raises(ValueError):
            signals.check_params("sma_slope", bad)
    with pytest.raises(ValueError):
        signals.register("sma_slope", "x", {}, lambda df, p, w: df)
    assert len(signals.RULES) == 37


def test_missing_values_give_no_signal(spark):
    df, _ = random_bars(spark, 120)
    holes = df.withColumn("close", F.when(F.col("bar_idx") == 60, None).otherwise(F.col("close")))
    for name, p in (("nbar_breakout", {"lookback": 5}), ("zscore_reversion", {"lookback": 10, "z_threshold": 1.0}), ("rsi_extreme", {"lookback": 5, "lower": 40.0})):
        assert ("A", 60) not in got_signals(signals.evaluate(holes, name, p))


def loop_trades(rows, sig, s):
    """One position at a time, bar by bar."""
    price = lambda x: float(np.floor(x * 100 + 0.5 + 1e-9) / 100)
    out, i, n = [], 1, len(rows)
    while i < n:
        way, atr = sig.get(i - 1, 0), rows[i - 1][10]
        if not way or not atr:
            i += 1
            continue
        bid, spread = rows[i][3], rows[i][8]
        entry = price(bid + spread * 0.01 + 0.05) if way > 0 else price(bid - 0.05)
        stop = price(entry - way * s["stop_atr"] * atr)
        target = None if s["target_r"] is None else price(entry + way * s["target_r"] * abs(entry - stop))
        now, j = stop, i
        while True:
            o, h, low, c, gap = *rows[j][3:7], rows[j][8] * 0.01
            hit_stop = low <= now if way > 0 else h + gap >= now
            hit_target = target is not None and (h >= target if way > 0 else low + gap <= target)
            if hit_stop:
                why, raw = ("stop_same_bar_ambiguous" if hit_target else "trail" if abs(now - stop) > 1e-12 else "stop"), (min(now, o) if way > 0 else max(now - gap, o))
            elif hit_target:
                why, raw = "target", target if way > 0 else target - gap
            elif j > i and s["time_exit_minutes"] is not None and (j - i) * 60 >= s["time_exit_minutes"]:
                why, raw = "time", c
            elif j == n - 1:
                why, raw = "end_of_data", c
            else:
                if s["atr_trail"] is not None and rows[j][10]:
                    moved = price(c - way * s["atr_trail"] * rows[j][10])
                    now = max(now, moved) if way > 0 else min(now, moved)
                j += 1
                continue
            out.append((i, j, why, round(raw, 6)))
            break
        i = j + 1
    return out


def test_trades_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(barriers, "BLOCK", 64)
    df, rows = random_bars(spark, 500, seed=6)
    rng = np.random.default_rng(2)
    sig = {int(i): int(rng.choice([-1, 1])) for i in rng.choice(499, 160, replace=False)}
    kinds = [("a", 1.0, 1.5, None, None), ("b", 1.0, None, 300.0, None), ("c", 2.0, None, None, 1.0), ("d", 0.8, 1.0, 240.0, None)]
    settings = spark.createDataFrame(kinds, "experiment_id string, stop_atr double, target_r double, time_exit_minutes double, atr_trail double")
    settings = settings.select("*", F.lit(6.0).alias("commission"), F.lit(5.0).alias("slippage"), F.lit(2.0).alias("preferred_risk"), F.lit(5.0).alias("hard_risk"), F.lit(0.1).alias("max_lot"))
    s = spark.createDataFrame([(k[0], "A", i, w) for k in kinds for i, w in sig.items()], "experiment_id string, symbol string, bar_idx long, signal int")
    got = trades.signals_to_trades(s, df, settings).collect()
    for k, stop, target, minutes, trail in kinds:
        want = loop_trades(rows, sig, {"stop_atr": stop, "target_r": target, "time_exit_minutes": minutes, "atr_trail": trail})
        mine = sorted((r.entry_idx, r.exit_idx, r.exit_reason, round(r.raw_exit, 6)) for r in got if r.experiment_id == k)
        assert mine == want and len(want) > 20
    for r in got:
        assert r.net_pnl == pytest.approx(r.gross_pnl - r.spread_cost - r.slippage_cost - r.commission_cost)


def test_lots(spark):
    rows = [(100.0, 99.0, 0.02), (100.0, 0.0, 0.01), (100.0, -500.0, None), (100.0, 100.0, None), (100.0, 99.99, 0.1)]
    df = spark.createDataFrame(rows, "e double, s double, want double")
    lot = prices.lot_for_stop(F.col("e"), F.col("s"), F.lit(0.02), F.lit(1.0), F.lit(0.1))
    assert [(r.want, r.lot) for r in df.select("want", lot.alias("lot")).collect()] == [(0.02, 0.02), (0.01, 0.01), (None, None), (None, None), (0.1, 0.1)]


def test_profit_and_loss_by_hand(spark):
    net = [10.0, -5.0, -5.0, 20.0, -10.0]
    rows = [("x", i, f"2024-01-0{i // 2 + 1}", 1 if i % 2 else -1, v, v / 5, 10.0 * i, 0.0, 0.0, 0.0) for i, v in enumerate(net)]
    t = spark.createDataFrame(rows, "k string, trade_seq long, broker_date string, direction int, net_pnl double, pnl_r double, hold_minutes double, commission_cost double, spread_cost double, slippage_cost double")
    m = metrics.summarize(t, ["k"], 100.0).first()
    assert (m.profit_factor, m.max_loss_streak, m.max_drawdown_usd, m.net_profit, m.active_months) == (1.5, 2, 10.0, 10.0, 1)
    assert m.median_hold_minutes == 20.0 and m.top_5_trade_profit_fraction == 1.0
    assert metrics.summarize(t.limit(0), ["k"]).count() == 0
    wins = metrics.summarize(t.filter("net_pnl > 0"), ["k"]).first()
    assert wins.profit_factor is None and wins.max_loss_streak == 0 and wins.max_drawdown_usd == 0


def test_scores_of_missing_values(spark):
    cols = "experiment_id string, profit_factor double, expectancy_r double, positive_year_fraction double, positive_month_fraction double, completed_trades long, max_drawdown_pct double, top_5_trade_profit_fraction double, best_month_profit_fraction double, active_months long, long_trades long, short_trades long, long_pf double, short_pf double, daily_percentile double, robustness_component double"
    rows = [("none", *[None] * 15), ("best", 2.0, 0.3, 1.0, 1.0, 3000, 0.0, 0.0, 0.0, 12, 500, 500, 2.0, 2.0, 1.0, 15.0), ("half", 1.3, 0.1, 0.5, None, 300, 5.0, 0.25, 0.9, 3, 500, 500, 0.45, 2.0, 0.5, None)]
    got = {r.experiment_id: r for r in validation.score(spark.createDataFrame(rows, cols)).collect()}
    assert got["none"].pre_robustness_score == 0 and got["none"].drawdown_penalty == 15 and got["none"].final_score is None
    assert got["best"].pre_robustness_score == 85 and got["best"].final_score == 100
    h = got["half"]
    assert (h.pf_component, h.expectancy_component, h.stability_component, h.sample_size_component) == (pytest.approx(12.5), 10.0, 7.5, 0.0)
    assert (h.concentration_penalty, h.side_dependence_penalty) == (7.5, pytest.approx(5.0))


def test_the_rest_works_without_the_llm_folder(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("barspark.llm", "__spark_entry__", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "barspark.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert entry.llm_queries is None and "flagship_breakout" in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")
