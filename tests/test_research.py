"""Experiment tables, folds and stress where some experiments never trade, quotas, file order, snapshots."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.operators import experiments as ex
from barspark.operators import frames, metrics, quality, signals, validation
from barspark.sources import bars as bar_files
from barspark.sources import ledgers
from barspark.streaming import streams
from test_operators import random_bars

TRADE = "experiment_id string, trade_seq long, broker_date string, direction int, net_pnl double, pnl_r double, hold_minutes double, commission_cost double, spread_cost double, slippage_cost double"


def trade(e, seq, day, net):
    return (e, seq, day, 1, net, net / 10, 5.0, 0.1, 0.1, 0.1)


def test_folds_without_trades_count(spark):
    rows = [trade("a", 1, "2024-01-03", 4.0), trade("a", 2, "2024-02-03", -1.0), trade("a", 3, "2024-02-05", 3.0), trade("b", 1, "2024-03-01", 5.0)]
    folds = spark.createDataFrame([("f1", "research", "2024-01"), ("f1", "validation", "2024-02"), ("f2", "research", "2024-02"), ("f2", "validation", "2024-03")], "fold_id string, segment string, month string")
    everyone = spark.createDataFrame([("a",), ("b",), ("never",)], "experiment_id string")
    found = validation.fold_metrics(spark.createDataFrame(rows, TRADE), folds, ["experiment_id"], everyone)
    assert {(r.experiment_id, r.fold_id, r.segment): r.completed_trades for r in found.collect()} == {
        (e, f, s): n for e, own in {"a": (1, 2, 2, 0), "b": (0, 0, 0, 1), "never": (0,) * 4}.items() for (f, s), n in zip([("f1", "research"), ("f1", "validation"), ("f2", "research"), ("f2", "validation")], own)
    }
    idle = found.filter("experiment_id = 'never'").first()
    assert (idle.net_profit, idle.max_drawdown_pct, idle.profit_factor, idle.expectancy_usd, idle.positive_day_fraction) == (0.0, 0.0, None, None, None)
    s = {r.experiment_id: r for r in validation.summarize_folds(found, ["experiment_id"]).collect()}
    assert (s["a"].validation_fold_count, s["a"].validation_joint_stability_fraction, s["a"].worst_validation_net_profit, s["a"].median_validation_pf) == (2, 0.5, 0.0, 3.0)
    assert (s["never"].validation_fold_count, s["never"].validation_joint_stability_fraction, s["never"].worst_validation_net_profit, s["never"].median_validation_pf) == (2, 0.0, 0.0, None)


def test_metrics_of_experiments_without_trades(spark):
    t = spark.createDataFrame([trade("a", 1, "2024-01-03", 4.0)], TRADE)
    everyone = spark.createDataFrame([("a",), ("never",)], "experiment_id string")
    rows = {r.experiment_id: r for r in metrics.summarize(t, ["experiment_id"], everyone=everyone).collect()}
    idle = rows["never"]
    assert rows["a"].completed_trades == 1 and (idle.completed_trades, idle.net_profit, idle.gross_profit, idle.max_drawdown_pct, idle.max_loss_streak, idle.active_months) == (0, 0.0, 0.0, 0.0, 0, 0)
    assert idle.profit_factor is None and idle.win_rate is None and idle.worst_month is None
    gate = validation.activation_gate(spark.createDataFrame([("a", 60, 0, 0), ("never", 0, 0, 0)], "experiment_id string, completed_trades long, risk_skip_count long, end_of_data_exits long"), 2, 1, 0).first()
    assert gate.zero_trade_count == 1 and gate.passed


SETTINGS = "experiment_id string, stop_atr double, target_r double, time_exit_minutes double, atr_trail double, commission double, slippage double, preferred_risk double, hard_risk double, max_lot double"


def test_stress_of_experiments_without_trades(spark):
    bars, _ = random_bars(spark, 300)
    own = spark.createDataFrame([("E", 1.0, 1.0, None, None, 6.0, 5.0, 2.0, 5.0, 0.1), ("wide", 90_000.0, 1.0, None, None, 6.0, 5.0, 2.0, 5.0, 0.1)], SETTINGS)
    base = own.select("experiment_id", F.lit("nbar_breakout").alias("strategy"), F.create_map(F.lit("lookback"), F.lit(20.0)).alias("params"))
    near = validation.parameter_stress(bars, base, own, ex.domains_table(spark, signals.RULES)).collect()
    assert sorted((r.experiment_id, r.param, r.value) for r in near) == [(e, "lookback", v) for e in ("E", "wide") for v in (16.0, 18.0, 22.0, 24.0)]
    for r in near:
        s = signals.evaluate(bars, "nbar_breakout", {"lookback": int(r.value)}).filter("signal != 0").select(F.lit(r.experiment_id).alias("experiment_id"), "symbol", "bar_idx", "signal")
        from barspark.operators.trades import signals_to_trades

        t = signals_to_trades(s, bars, own.filter(F.col("experiment_id") == r.experiment_id)).collect()
        assert r.completed_trades == len(t) and r.net_profit == pytest.approx(sum(x.net_pnl for x in t), abs=1e-9) and (r.completed_trades > 0) == (r.experiment_id == "E")
    s = signals.evaluate_table(bars, base)
    cost = validation.cost_stress(s, bars, own)
    assert {(r.experiment_id, r.completed_trades == 0) for r in cost.collect()} == {("E", False), ("wide", True)} and cost.count() == 20
    report = {r.experiment_id: r for r in validation.stress_report(cost.withColumn("stress_type", F.lit("cost"))).collect()}
    assert report["wide"].cost_run_count == 10 and report["wide"].cost_stability_pct == 0.0


def test_a_table_of_experiments_gives_each_its_rule(spark):
    bars, _ = random_bars(spark, 400, symbols=("A", "B"))
    bars = bars.drop("session_new_york").withColumn("session_new_york", F.hour("bar_ts") >= 13).withColumn("session_overlap", F.lit(False))
    random.seed(5)
    runs = []
    for name, rule in sorted(signals.RULES.items()):
        for _ in range(2):
            p = {}
            for k, d in rule.domain.items():
                p[k] = random.choice(d) if isinstance(d[0], str) else random.randint(d[0], min(d[1], d[0] + 6)) if isinstance(d[0], int) else round(random.uniform(*d), 3)
            runs.append((f"{name}{len(runs)}", name, p))
    numbers = lambda p: {k: float(v) for k, v in p.items() if not isinstance(v, str)}
    words = lambda p: {k: v for k, v in p.items() if isinstance(v, str)}
    table = spark.createDataFrame([(e, n, numbers(p), words(p)) for e, n, p in runs], "experiment_id string, strategy string, params map<string,double>, cat_params map<string,string>")
    got = {}
    for r in signals.evaluate_table(bars, table).collect():
        got.setdefault(r.experiment_id, set()).add((r.symbol, r.bar_idx, r.signal))
    for e, name, p in runs:
        want = {(r.symbol, r.bar_idx, r.signal) for r in signals.evaluate(bars, name, p).filter("signal != 0").collect()}
        assert got.get(e, set()) == want, (e, p)
    assert sum(map(len, got.values())) > 500
    assert signals.evaluate_table(bars, table.limit(0)).count() == 0


def test_frames_over_many_blocks_equal_windows(spark, monkeypatch):
    """With tiny blocks and parts of parameter sets: every frame is the same bits as Spark's window, expanding quantiles too."""
    from barspark.operators import blocks
    from barspark.operators.frames import Frames, highest, lowest, mean, slope, std, with_quantile

    monkeypatch.setattr(blocks, "BLOCK", 128)
    monkeypatch.setattr(blocks, "SETS", 2)
    bars, _ = random_bars(spark, 700, symbols=("A", "B"))
    w, names = Frames("symbol"), ["m", "s", "b", "hi", "lo", "q", "e"]
    sets = [{"n": n, "share": q} for n, q in ((5, 0.05), (17, 0.4), (64, 0.333), (100, 0.05), (31, 0.99))]

    def find(b, p):
        n = p["n"]
        return dict(zip(names, (b.mean("close", n), b.std("close", n, True), b.slope("close", n), b.extreme("high", n, True, True), b.extreme("low", n, False), b.quantile("close", n, p["share"]), b.expanding("close", p["share"], "whole"))))

    ready = bars.withColumn("whole", F.lit(1))
    near = blocks.earlier_near(ready, ["symbol"], "close", sorted({p["share"] for p in sets}), bucket=32)
    rows = blocks.frame_rows(ready, ["symbol"], ["close", "high", "low", "whole"], [], sets, 101, names, find, near, "share").collect()
    got = {(r.set_id, r.symbol, r.bar_idx): tuple(r[n] for n in names) for r in rows}
    assert len(got) == len(rows) == 1400 * len(sets)
    for i, p in enumerate(sets):
        n = p["n"]
        df = bars.withColumns({"m": mean("close", n, w.own(n)), "s": std("close", n, w.prior(n)), "b": slope("close", n, w.own(n)), "hi": highest("high", n, w.prior(n)), "lo": lowest("low", n, w.own(n))})
        df = signals.expanding_quantile(with_quantile(df, "close", p["share"], n, w, "q"), "close", p["share"], w, "e")
        for r in df.collect():
            assert got[i, r.symbol, r.bar_idx] == tuple(r[x] for x in names), (p, r.bar_idx)


def test_one_plan_a_rule_and_no_bars_by_experiment(spark):
    """A thousand experiments with frames of their own: one branch, and the only exchange of bars is by block."""
    bars, _ = random_bars(spark, 300)
    rows = [(f"x{i}", "atr_percentile_regime", {"lookback": 10.0 + i % 180, "percentile": round(0.5 + i / 2500, 5)}) for i in range(1000)]
    found = signals.evaluate_table(bars, spark.createDataFrame(rows, "experiment_id string, strategy string, params map<string,double>"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "Union" not in plan and "hashpartitioning(experiment_id" not in plan
    assert found.select("experiment_id").distinct().count() == 1000


def test_bad_experiments_are_rows_with_errors(spark):
    good = {"lookback": 9.0, "slope_horizon": 1.0}
    table = [
        ("fine", "sma_slope", good, None), ("also", "sma_slope", good | {"threshold_atr": 0.5}, {}), ("rule", "no_such_rule", good, None), ("name", "sma_slope", good | {"length": 3.0}, None), ("high", "sma_slope", good | {"threshold_atr": 7.0}, None),
        ("none", "sma_slope", {"lookback": 9.0}, None), ("null", "sma_slope", {"lookback": None, "slope_horizon": 1.0}, None), ("half", "sma_slope", {"lookback": 9.5, "slope_horizon": 1.0}, None), ("text", "session_open_momentum", {}, {"session": "moon"}), (None, "sma_slope", good, None), ("nothing", None, None, None),
    ]
    table = spark.createDataFrame(table, "experiment_id string, strategy string, params map<string,double>, cat_params map<string,string>")
    found = {r.experiment_id: r.error for r in signals.with_errors(table).collect()}
    assert found == {
        "fine": None, "also": None, "rule": "there is no rule no_such_rule", "name": "there is no parameter length", "high": "threshold_atr is outside of its domain", "none": "no value of slope_horizon",
        "null": "lookback is outside of its domain", "half": "lookback is no whole number", "text": "session is outside of its domain", None: "no experiment_id", "nothing": "there is no rule null",
    }
    bars, _ = random_bars(spark, 60)
    assert "fine" in {r.experiment_id for r in signals.evaluate_table(bars, table).collect()} <= {"fine", "also"}


def test_quotas_cover_all_buckets(spark):
    def quota(sizes, total, **more):
        df = spark.createDataFrame([(f"b{i}", n, i) for i, n in enumerate(sizes)], "bucket string, size long, place int")
        return [r.quota for r in ex.allocate_quota(df, total, **more).orderBy("bucket").collect()]

    assert quota([1000, 1, 1, 1, 1, 1], 6, least_one=True) == [1] * 6
    assert quota([500, 500, 1, 1, 1, 1], 8, least_one=True) == [2, 2, 1, 1, 1, 1]
    assert quota([1000, 1, 1, 1, 1, 1], 5, least_one=True) == [5, 0, 0, 0, 0, 0]
    with pytest.raises(Exception, match="larger than all buckets"):
        quota([2, 3], 6)
    with pytest.raises(ValueError, match="positive"):
        quota([2, 3], 0)


def test_matches_with_history(spark):
    past = [("h1", "SMA-slope", {"lookback": 20.0, "x": 1.0}), ("h2", "sma slope", {"lookback": 21.0}), ("h3", "sma slope", {"other": 3.0}), ("h4", "sma slope", {"lookback": 20.0 * (1 + 5e-11), "threshold": None}), ("h5", "else", {"lookback": 20.0}), ("h6", "sma slope", {"lookback": 20.0, "threshold": 0.2}), ("h7", "sma slope", {"threshold": 5e-13})]
    own = [("e1", "sma_slope", {"lookback": 20.0, "threshold": 0.1}), ("e2", "sma_slope", {"threshold": 0.0}), ("e3", "nothing", {"lookback": 1.0})]
    m = "map<string,double>"
    got = ex.historical_matches(spark.createDataFrame(own, f"experiment_id string, strategy string, params {m}"), spark.createDataFrame(past, f"historical_id string, strategy_name string, params {m}"))
    assert {r.experiment_id: r.matches for r in got.collect()} == {"e1": ["h1", "h3", "h4"], "e2": ["h1", "h2", "h3", "h4", "h7"]}


def test_lines_keep_their_order_over_files(spark, tmp_path):
    head = "symbol,time,open,high,low,close,tick_volume,spread,real_volume"
    line = lambda close, t="2024-01-01 00:00:00": f"A,{t},1,3,0.5,{close},5,1,0"
    (tmp_path / "a.csv").write_text("\n".join([head, line(1.0)]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([head, line(2.0), *(line(1.0, f"2024-01-02 {h:02d}:{m:02d}:00") for h in range(24) for m in range(60))]) + "\n")
    raw = bar_files.read_bars_csv(spark, str(tmp_path))
    assert quality.dedup_keep_last(raw).filter("bar_ts = timestamp_ntz'2024-01-01 00:00:00'").first().close == 2.0
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "x.log").write_text("2024.01.01 00:00:00 ENTRY\nrun started\n2024.01.01 00:05:00 EXIT\n")
    found = ledgers.parse_log(ledgers.read_log(spark, str(tmp_path / "logs"))).collect()
    assert [r.kind for r in found] == ["exit"]


def test_a_symbol_without_bars_in_the_window_is_refused(spark):
    bars, _ = random_bars(spark, 30, symbols=("A", "B"))
    bars = bars.filter("symbol = 'A' or bar_idx < 10")
    assert quality.research_prefix(bars.filter("symbol = 'A'"), 5, "2024-01-01 12:00:00").count() == 5
    with pytest.raises(Exception, match="fewer bars"):
        quality.research_prefix(bars, 5, "2024-01-01 12:00:00").count()


def test_snapshots_do_not_take_a_failed_read_for_an_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "id long, v string")
    path = str(tmp_path / "table")
    write = streams.snapshot_writer(path, ["id"])
    write(rows, 0)
    write(rows, 1)
    assert spark.read.parquet(path).count() == 1
    (tmp_path / "damaged").mkdir()
    (tmp_path / "damaged" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        streams.snapshot_writer(str(tmp_path / "damaged"), ["id"])(rows, 0)


def test_percentiles_of_ties(spark):
    values = [3.0, 1.0, 2.0, 2.0, None, 5.0]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double").repartition(3)
    got = {r.k: r.daily_percentile for r in validation.tie_averaged_percentile(df, "v").collect()}
    assert got == {4: 0.0, 1: 0.2, 2: 0.5, 3: 0.5, 0: 0.8, 5: 1.0}
    assert validation.tie_averaged_percentile(df.limit(0), "v").count() == 0
    assert [r.idx for r in ex.spread_sample(df, "k", 3).orderBy("idx").collect()] == [0, 2, 5]


def test_sliding_windows_over_blocks(spark):
    rng = np.random.default_rng(6)
    values = {k: [None if rng.random() < 0.002 else float(np.round(rng.normal(), 1)) for _ in range(n)] for k, n in (("A", 9000), ("B", 30))}
    df = spark.createDataFrame([(k, i, v, i % 2 == 0) for k, own in values.items() for i, v in enumerate(own)], "symbol string, bar_idx long, v double, flag boolean").repartition(5)
    w = frames.Frames("symbol")
    got = {(r.symbol, r.bar_idx): r for r in frames.sliding(frames.with_quantile(df, "v", 0.9, 25, w, "q"), "v", 25, w, "s", lambda x: x[:, -1] - x[:, 0], own=True).collect()}
    assert len(got) == 9030
    for (k, i), r in got.items():
        own = values[k]
        before, upto = own[max(0, i - 25) : i], own[max(0, i - 24) : i + 1]
        assert r.v == own[i] and r.flag == (i % 2 == 0)
        assert r.q == (pytest.approx(np.percentile(before, 90), abs=1e-12) if len(before) == 25 and None not in before else None)
        assert r.s == (pytest.approx(upto[-1] - upto[0]) if len(upto) == 25 and None not in upto else None)
    assert sum(r.q is None for r in got.values()) > 200
