"""Queries over whole tables against plain loops, on the smallest tables."""

from __future__ import annotations

import collections
import hashlib
import math

import numpy as np
import pytest

from barspark.operators import trades
from barspark.plans import fixtures as fx
from barspark.plans import registry, research_queries, trade_queries

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def ticks(spark, sf):
    return [r.asDict() | {"time": r.time_msc // 1000, "way": 1 if r.event_id % 4 < 2 else -1} for r in fx.ticks(spark, sf).collect()]


@pytest.fixture(scope="module")
def of(ticks):
    """The ticks of each symbol in the order of time."""
    out = collections.defaultdict(list)
    for t in sorted(ticks, key=lambda x: x["time_msc"]):
        out[t["symbol"]].append(t)
    return out


def rows(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def intervals(of):
    out = []
    for s, own in of.items():
        own = sorted(own, key=lambda t: (t["time"], t["event_id"] % 2 == 0))
        ends = [t["time"] for t in own[1:]] + [4_102_444_800]
        out += [(s, t["time"], z) for t, z in zip(own, ends) if t["event_id"] % 2 == 0]
    return out


def test_intervals_and_classes(spark, sf, ticks, of):
    want = intervals(of)
    assert sorted(map(tuple, rows(spark, sf, "l2_open_intervals"))) == sorted(want)
    out, seen, signalled, guards = [], set(), set(), collections.defaultdict(list)
    ledger = [(t["symbol"], t["time"], t["way"] * (-1 if t["event_id"] % 5 == 0 else 1)) for t in ticks if t["event_id"] % 3]
    seen = {(s, at // 300, way) for s, at, way in ledger}
    signalled = {(t["symbol"], t["time"] // 300, t["way"]) for t in ticks}
    for t in ticks:
        if t["event_id"] % 6 == 0:
            guards[t["symbol"], t["time"] // 300].append(f"r{t['event_id'] % 4}")
    for t in ticks:
        s, at, way = t["symbol"], t["time"], t["way"]
        if (s, at // 300, way) in seen:
            kind = "matched"
        elif any(x == s and a < at < z for x, a, z in want):
            kind = "position_open"
        else:
            kind = "guard:" + min(guards[s, at // 300]) if guards[s, at // 300] else "unexplained"
        out.append((s, at, way, kind))
    out += [(s, at, way, "missing_signal") for s, at, way in ledger if (s, at // 300, way) not in signalled]
    assert sorted(map(tuple, rows(spark, sf, "l1_classify_signals"))) == sorted(out)


def test_construction(spark, sf, ticks):
    got = {x.key: (x.span_error, x.midpoint_error, x.span_ok) for x in rows(spark, sf, "l3_construction_check")}
    assert len(got) == len(ticks)
    for t in ticks:
        k = t["event_id"]
        assert got[k] == (pytest.approx(-0.3 if k % 5 == 0 else 0, abs=1e-6), pytest.approx(0.5 if k % 2 == 0 else 0, abs=1e-6), k % 5 > 0)


def test_balances_and_volumes(spark, sf, ticks, of):
    balance = {x.event_id: (x.balance_time, x.balance) for x in rows(spark, sf, "l5_balance_asof")}
    volume = {x.event_id: (x.expected_volume, x.volume_ok) for x in rows(spark, sf, "l6_volume_check")}
    asked = [t for t in ticks if t["event_id"] % 2]
    assert set(balance) == set(volume) == {t["event_id"] for t in asked}
    for t in asked:
        known = [(b["time"], b["bid"]) for b in of[t["symbol"]] if b["event_id"] % 2 == 0 and b["time"] <= t["time"]]
        at, value = max(known) if known else (None, None)
        assert balance[t["event_id"]] == (at, value if value is None else pytest.approx(value, abs=1e-5))
        lot = None if value is None else math.floor(value * 50 * 0.002 / 5 / 0.01 + 1e-9) * 0.01
        own = 0.5 if t["event_id"] % 4 == 1 else 0
        assert volume[t["event_id"]] == (lot if lot is None else pytest.approx(lot, abs=1e-6), lot is not None and abs(own - lot) < 1e-9)


def test_ticks_of_trades(spark, sf, ticks, of):
    entry, trigger, ends = {}, {}, {}
    for t in ticks:
        k, d, own = t["event_id"], 1 if t["event_id"] % 2 == 0 else -1, of[t["symbol"]]
        near = [x["time_msc"] for x in own if x["time"] == t["time"] and abs(x["ask" if d == 1 else "bid"] - t["ask"]) <= 0.005 + 1e-9]
        if near:
            entry[k] = min(near)
        due = t["time_msc"] + 600_000
        ends[k] = (max((x["time_msc"] for x in own if x["time_msc"] <= due), default=None), min((x["time_msc"] for x in own if x["time_msc"] >= due), default=None))
        kinds = collections.defaultdict(set)
        for x in own:
            price = x["bid" if d == 1 else "ask"]
            if x["time_msc"] > t["time_msc"] and (price - (t["bid"] - d * 40)) * d <= 0:
                kinds[x["time_msc"]].add("SL")
            if x["time_msc"] > t["time_msc"] and (price - (t["bid"] + d * 60)) * d >= 0:
                kinds[x["time_msc"]].add("TP")
        if kinds:
            at = min(kinds)
            trigger[k] = (at, "AMBIGUOUS" if len(kinds[at]) > 1 else min(kinds[at]))
    assert {x.trade_id: x.tick_msc for x in rows(spark, sf, "l7_entry_tick")} == entry
    assert {x.trade_id: (x.trigger_msc, x.kind) for x in rows(spark, sf, "l8_first_trigger")} == trigger
    assert {x.event_id: (x.before_msc, x.after_msc) for x in rows(spark, sf, "l9_delay_endpoints")} == ends


def test_order_lines(spark, sf):
    lines = fx.table(spark, sf, "lineitem").collect()
    rates = collections.Counter((-1 if x.l_returnflag == "N" else 1, round(float(x.l_discount / x.l_quantity), 6), round(float(x.l_tax / x.l_quantity), 6)) for x in lines)
    got = collections.Counter()
    for x in rows(spark, sf, "l11_cost_rates"):
        got[x.direction, round(x.commission_rate, 6), round(x.swap_rate, 6)] += x.n
    assert got.total() == len(lines) and got == rates
    pairs = collections.defaultdict(list)
    for x in sorted(lines, key=lambda x: (x.l_shipdate, x.l_orderkey, x.l_linenumber)):
        pairs[x.l_suppkey, str(x.l_partkey)].append((float(x.l_quantity), round(float(x.l_tax - x.l_discount), 6)))
    want = sorted((*k, 10 * (i + 1), *v) for k, own in pairs.items() for i, v in enumerate(own))
    got = sorted(map(tuple, rows(spark, sf, "s9_pair_deals")))
    assert [x[:4] for x in got] == [x[:4] for x in want] and max(map(len, pairs.values())) > 1
    assert [x[4] for x in got] == pytest.approx([x[4] for x in want], abs=1e-5)


def test_streams(spark, sf, of):
    bars = collections.defaultdict(list)
    for b in sorted(fx.bars(spark, sf).collect(), key=lambda b: b.bar_idx):
        bars[b.symbol].append(b)
    want = []
    for s, own in bars.items():
        free = -1
        for b in own:
            if b.bar_idx > free:
                free = b.bar_idx + b.tick_volume
                want.append((s, b.bar_idx, free))
    assert sorted((x.symbol, x.entry_idx, x.exit_idx) for x in rows(spark, sf, "x5_stream_positions")) == sorted(want)
    times = {r.event_id: r.ts for r in fx.events(spark, sf).collect()}
    near = {(s, t["event_id"]): sum(0 <= (times[x["event_id"]] - times[t["event_id"]]).total_seconds() <= 1800 for x in own) for s, own in of.items() for t in own}
    assert {(x.symbol, x.signal_id): x.n for x in rows(spark, sf, "x7_stream_signal_ticks")} == near


def test_resampling_has_the_full_number_of_samples(spark, sf, monkeypatch):
    """Registered queries over trades of one experiment, against loops over all 5,000 samples."""
    rng, n, seed = np.random.default_rng(3), 5000, 9216000
    rows_ = [(1, i + 1, f"2024-01-{1 + i // 2:02d}", float(np.round(rng.normal(5, 50), 2))) for i in range(12)]
    small = spark.createDataFrame(rows_, "experiment_id long, trade_seq long, broker_date string, net_pnl double")
    monkeypatch.setattr(research_queries, "lines", lambda *_: small)
    base, p = int(hashlib.md5(f"{seed}|1".encode()).hexdigest()[:7], 16), 2**32

    def mixed(x):
        x = (x ^ x >> 16) * 2_246_822_507 % p
        x = (x ^ x >> 13) * 3_266_489_909 % p
        return x ^ x >> 16

    def draw(sample, place):
        key = mixed((base + sample * 2_654_435_769) % p)
        return mixed(mixed((key + place * 2_146_121_005) % p) ^ key)

    days = [rows_[2 * k][3] + rows_[2 * k + 1][3] for k in range(6)]
    drawn = np.array([[days[draw(i, k) * 6 // p] for k in range(6)] for i in range(n)])
    got = rows(spark, sf, "v10_bootstrap_days_5000")[0].asDict()
    for q in (5, 50, 95):
        assert got[f"mean_daily_p{q}"] == pytest.approx(np.percentile(drawn.mean(1), q), abs=1e-5)
        assert got[f"total_pnl_p{q}"] == pytest.approx(np.percentile(drawn.sum(1), q), abs=1e-5)
    falls = []
    for i in range(n):
        order = sorted(rows_, key=lambda x: draw(i, x[1] - 1))
        equity = np.cumsum([0.0, *(x[3] for x in order)])
        falls.append((np.maximum.accumulate(equity) - equity).max())
    got = rows(spark, sf, "v11_order_monte_carlo_5000")[0].asDict()
    for q in (5, 50, 95):
        assert got[f"max_drawdown_p{q}"] == pytest.approx(np.percentile(falls, q), abs=1e-5)


def test_walk_forward_has_validation_segments(spark, sf):
    found = rows(spark, sf, "v5_walk_forward_days")
    assert {x.segment for x in found} == {"research", "validation"} and len({x.fold_id for x in found}) > 1
    # One slice by hand: the bars of the first fold's days of validation, renumbered, as a market of their own.
    market, s = trade_queries.breakouts(spark, sf)
    bars = collections.defaultdict(list)
    for b in sorted(market.collect(), key=lambda b: b.bar_idx):
        bars[b.symbol].append(b)
    days = sorted({b.bar_ts.date() for own in bars.values() for b in own})[12:15]
    own = {x: [b for b in bars[x] if b.bar_ts.date() in days] for x in bars}
    place = {(x, b.bar_idx): i for x in own for i, b in enumerate(own[x])}
    slice_ = spark.createDataFrame([b.asDict() | {"bar_idx": place[x, b.bar_idx]} for x in own for b in own[x]], market.schema)
    signalled = spark.createDataFrame([(x.experiment_id, x.symbol, place[x.symbol, x.bar_idx], x.signal) for x in s.collect() if (x.symbol, x.bar_idx) in place], s.select("experiment_id", "symbol", "bar_idx", "signal").schema)
    totals = {x.experiment_id: [] for x in trade_queries.settings(spark).collect()}
    for t in trades.signals_to_trades(signalled, slice_, trade_queries.settings(spark)).collect():
        totals[t.experiment_id].append(t.net_pnl)
    got = {x.experiment_id: (x.completed_trades, x.net_profit) for x in found if (x.fold_id, x.segment) == ("rolling-001", "validation")}
    assert got == {e: (len(v), pytest.approx(sum(v), abs=1e-4)) for e, v in totals.items()} and got
