"""Campaigns with bad rows, promotion in one piece, names with bars in them, the spread of resampling, and first barriers and triggers against loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_research import SETTINGS, random_bars

from barspark.operators import barriers, campaign, signals, trades, validation
from barspark.operators import experiments as ex

TABLE = "experiment_id string, strategy string, params map<string,double>, cat_params map<string,string>"


def own(spark, ids, **changed):
    base = {"stop_atr": 1.0, "target_r": 1.0, "time_exit_minutes": None, "atr_trail": None, "commission": 6.0, "slippage": 5.0, "preferred_risk": 2.0, "hard_risk": 5.0, "max_lot": 0.1}
    return spark.createDataFrame([(e, *(base | changed.get(e, {})).values()) for e in ids], SETTINGS)


def test_a_campaign_goes_on_where_experiments_are_bad(spark):
    bars, _ = random_bars(spark, 300)
    good = {"lookback": 12.0}
    table = spark.createDataFrame(
        [("fine", "nbar_breakout", good, None), ("idle", "nbar_breakout", good, None), ("rule", "nbar_breakup", good, None), ("far", "nbar_breakout", {"lookback": 700.0}, None), ("lost", "nbar_breakout", good, None), ("flat", "nbar_breakout", good, None), ("two", "nbar_breakout", good, None), ("two", "sma_slope", {"lookback": 9.0, "slope_horizon": 2.0}, None)],
        TABLE,
    )
    settings = own(spark, ["fine", "idle", "rule", "far", "flat", "two"], idle={"stop_atr": 90_000.0}, flat={"stop_atr": 0.0})
    found = {(r.experiment_id, r.strategy): r for r in campaign.campaign(bars, table, settings).collect()}
    errors = {k[0]: r.error for k, r in found.items()}
    assert errors == {"fine": None, "idle": None, "rule": "there is no rule nbar_breakup", "far": "lookback is outside of its domain", "lost": "no settings", "flat": "stop_atr is not above 0", "two": "several experiments have this id"}
    assert len(found) == 8 and all((r.error is None) == (r.net_profit is not None) for r in found.values())
    s = signals.evaluate(bars, "nbar_breakout", {"lookback": 12}).filter("signal != 0").select(F.lit("fine").alias("experiment_id"), "symbol", "bar_idx", "signal")
    alone = trades.signals_to_trades(s, bars, settings).collect()
    fine = found["fine", "nbar_breakout"]
    assert fine.completed_trades == len(alone) > 0 and fine.net_profit == pytest.approx(sum(t.net_pnl for t in alone))
    assert found["idle", "nbar_breakout"].completed_trades == 0
    assert campaign.campaign(bars, table.limit(0), settings).count() == 0
    assert campaign.campaign(bars, table.filter("strategy = 'nbar_breakup'"), settings).count() == 1


def test_directions_of_a_campaign(spark):
    bars, _ = random_bars(spark, 200)
    table = spark.createDataFrame([(e, "nbar_breakout", {"lookback": 12.0}, None, m) for e, m in (("a", "long"), ("b", "short"), ("c", None))], TABLE + ", direction string")
    _, t = campaign.trades_of(bars, table, own(spark, "abc"))
    ways = {}
    for r in t.collect():
        ways.setdefault(r.experiment_id, set()).add(r.direction)
    assert ways == {"a": {1}, "b": {-1}, "c": {1, -1}}


def test_promotion_stresses_survivors_only(spark, monkeypatch):
    bars, _ = random_bars(spark, 400)
    table = spark.createDataFrame([(e, "nbar_breakout", {"lookback": n}, None) for e, n in (("a", 5.0), ("b", 12.0), ("c", 30.0))], TABLE)
    settings, domains = own(spark, "abc"), ex.domains_table(spark, signals.RULES)
    plain = {r.experiment_id: r.verdict for r in campaign.promote(bars, table, settings, domains, length=10, samples=50).collect()}
    assert plain == dict.fromkeys("abc", "REJECTED")  # too few trades
    monkeypatch.setattr(validation, "stage1_decision", lambda m: m.withColumns({"reasons": F.when(F.col("experiment_id") == "b", F.array()).otherwise(F.array(F.lit("no"))).cast("array<string>"), "passed": F.col("experiment_id") == "b"}))
    asked, real = [], campaign.evidence

    def seen(*args, **options):
        asked.append(sorted(r.experiment_id for r in args[4].collect()))
        return real(*args, **options)

    monkeypatch.setattr(campaign, "evidence", seen)
    found = {r.experiment_id: r for r in campaign.promote(bars, table, settings, domains, length=10, samples=50).collect()}
    assert asked == [["b"]] and found["a"].verdict == found["c"].verdict == "REJECTED" and found["b"].verdict in ("STAGE1_SURVIVOR", "ROBUST_CANDIDATE")


def test_stress_runs_are_those_of_each_kind(spark):
    """The table of runs holds what cost_stress and parameter_stress give, for ids that hold the bar sign too."""
    bars, _ = random_bars(spark, 300)
    settings, domains = own(spark, ["a|b", "a"]), ex.domains_table(spark, signals.RULES)
    table = spark.createDataFrame([(e, "nbar_breakout", {"lookback": 20.0}, None) for e in ("a|b", "a")], TABLE).drop("cat_params")
    s = signals.evaluate_table(bars, table)
    runs = {(r.experiment_id, r.stress_type, r.label): (r.completed_trades, round(r.net_profit, 9)) for r in validation.stress_runs(s, bars, table, settings, domains).collect()}
    cost = {(r.experiment_id, "cost", r.label): (r.completed_trades, round(r.net_profit, 9)) for r in validation.cost_stress(s, bars, settings).collect()}
    near = {(r.experiment_id, "parameter", f"lookback={r.value}"): (r.completed_trades, round(r.net_profit, 9)) for r in validation.parameter_stress(bars, table, settings, domains).collect()}
    assert runs == cost | near and len(runs) == 28 and {e for e, *_ in runs} == {"a|b", "a"}


def test_walk_forward_keeps_names_with_bars(spark):
    bars, _ = random_bars(spark, 200)
    bars = bars.withColumn("symbol", F.concat("symbol", F.lit("|x")))
    folds = bars.select(F.date_format("bar_ts", "yyyy-MM-dd").alias("month")).distinct().withColumns({"fold_id": F.lit("f|1"), "segment": F.lit("research")})
    s = signals.evaluate(bars, "nbar_breakout", {"lookback": 8}).filter("signal != 0").select(F.lit("e").alias("experiment_id"), "symbol", "bar_idx", "signal")
    found = validation.walk_forward(s, bars, own(spark, ["e"]), folds, "yyyy-MM-dd").collect()
    assert [(r.experiment_id, r.fold_id, r.segment) for r in found] == [("e", "f|1", "research")] and found[0].completed_trades > 0


@pytest.mark.parametrize("n", [5, 10, 30, 100])
def test_resampled_means_spread_as_they_should(n):
    """The spread of the mean of n drawn days, over 40 keys of 5,000 samples, against the exact one: within 1 %."""
    rng, ratios = np.random.default_rng(n), []
    for base in rng.integers(0, 1 << 28, 40):
        d = rng.normal(size=n)
        place = validation._draws(int(base), np.arange(5000)[:, None], np.arange(n)[None, :]) * np.uint64(n) // np.uint64(validation._WORD)
        ratios.append(d[place.astype(int)].mean(axis=1).std() / (d.std() / n**0.5))
    assert abs(np.mean(ratios) - 1) < 0.01 and max(np.abs(np.array(ratios) - 1)) < 0.05


def test_pyramid_finds_the_first_bar():
    rng = np.random.default_rng(4)
    bid = np.cumsum(rng.normal(size=20_000))
    bid[rng.choice(20_000, 50)] = np.nan
    ask = bid + 0.1
    start, until = rng.integers(0, 20_000, 3000), rng.integers(0, 20_000, 3000)
    long_, stop, target = rng.random(3000) < 0.5, rng.normal(scale=60, size=3000), rng.normal(scale=60, size=3000)
    target[::7] = np.nan
    found = barriers.Pyramid(bid, bid, ask, ask).first(start, until, long_, stop, target)
    for k in range(3000):
        path = slice(start[k], until[k] + 1)
        hit = (bid[path] <= stop[k]) | (bid[path] >= target[k]) if long_[k] else (ask[path] >= stop[k]) | (ask[path] <= target[k])
        assert found[k] == (start[k] + hit.argmax() if hit.any() else max(until[k] + 1, min(start[k], until[k] + 1)))


def test_trades_over_many_blocks_end_as_in_one(spark, monkeypatch):
    """With blocks of 16 bars and tasks of 7 trades, every trade ends as over one block, moving stops and time exits too."""
    bars, _ = random_bars(spark, 500, symbols=("A", "B"))
    settings = own(spark, "abcd", b={"time_exit_minutes": 900.0, "target_r": None}, c={"atr_trail": 1.5, "target_r": None}, d={"stop_atr": 6.0, "target_r": 8.0})
    s = signals.evaluate(bars, "nbar_breakout", {"lookback": 5}).filter("signal != 0").select("symbol", "bar_idx", "signal").crossJoin(settings.select("experiment_id"))
    cands = trades.checkpointed(trades.candidates(s, bars, settings))
    whole = {tuple(r) for r in trades.outcomes(cands, bars).collect()}
    monkeypatch.setattr(barriers, "BLOCK", 16)
    monkeypatch.setattr(barriers, "TRADES", 7)
    assert {tuple(r) for r in trades.outcomes(cands, bars).collect()} == whole and len(whole) == cands.count() > 100
    assert {r[5] for r in whole} >= {"stop", "target", "trail", "time"}


def test_first_trigger_against_a_loop(spark):
    rng = random.Random(8)
    ticks, price = [], 100.0
    for k in range(4000):
        price += rng.gauss(0, 0.05)
        ticks.append((rng.choice("AB"), 3_600_000 * 5 + k * 20_000 // 3 * 3 + rng.choice((0, 0, 1)) * 60_000, round(price, 2), round(price + 0.02, 2)))
    asked = [(i, rng.choice("ABC"), rng.choice((1, -1)), round(100 + rng.gauss(0, 2), 2), None if i % 9 == 0 else round(100 + rng.gauss(0, 2), 2), 3_600_000 * rng.randint(0, 28) + rng.randint(0, 3_600_000)) for i in range(400)]
    want = {}
    for i, symbol, d, stop, target, anchor in asked:
        kinds: dict = {}
        for s, t, bid, ask in ticks:
            p = bid if d == 1 else ask
            if s == symbol and t > anchor:
                by_stop, by_target = (p - stop) * d <= 0, target is not None and (p - target) * d >= 0
                if by_stop or by_target:
                    kinds.setdefault(t, set()).update({"SL"} if by_stop else set(), {"TP"} if by_target else set())
        if kinds:
            t = min(kinds)
            want[i] = (t, "AMBIGUOUS" if len(kinds[t]) == 2 else min(kinds[t]))
    df = spark.createDataFrame(asked, "trade_id long, symbol string, direction int, stop_price double, target_price double, anchor_msc long")
    t = spark.createDataFrame(ticks, "symbol string, time_msc long, bid double, ask double")
    assert {r.trade_id: (r.trigger_msc, r.kind) for r in barriers.first_trigger(df, t).collect()} == want and len(want) > 150
    assert barriers.first_trigger(df.limit(0), t).count() == barriers.first_trigger(df, t.limit(0)).count() == 0
