"""Tests of the fourth review's findings."""

from __future__ import annotations

import bisect
import datetime as dt
import random


def test_ticks_are_counted_without_pairs(spark, tmp_path):
    """A stream of several batches: 1,200 signals and 9,000 ticks within three hours would be a million pairs; counts come from rows of signals."""
    from barspark.plans.ledger_queries import run_stream
    from barspark.streaming import streams

    rng, start = random.Random(8), dt.datetime(2024, 1, 1, 7)
    ticks = [(s, start + dt.timedelta(seconds=rng.randrange(10800)), rng.randrange(1, 4)) for s in "ab" for _ in range(4500)]
    signals = [(s, start + dt.timedelta(seconds=x)) for s in "ab" for x in rng.sample(range(10800), 600)]
    for k in range(3):  # in order of time, as late rows are dropped
        part = lambda rows: [r for r in rows if int((r[1] - start).total_seconds()) // 3600 == k]  # noqa: E731, B023
        spark.createDataFrame(part(ticks), "symbol string, ts timestamp, n long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
        spark.createDataFrame(part(signals), "symbol string, signal_ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
    read = lambda x: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{x}").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{x}")
    df = run_stream(streams.count_ticks(read("s"), read("t"), "30 minutes", "1 day"))
    assert df.count() <= 3 * len(signals)
    found = {(r.symbol, r.at): r.n for r in df.groupBy("symbol", "signal_ts").sum("n").toDF("symbol", "at", "n").collect()}
    want = {}
    for s in "ab":
        mine = sorted((ts, n) for x, ts, n in ticks if x == s)
        for at in (at for x, at in signals if x == s):
            lo, hi = bisect.bisect_left(mine, (at, 0)), bisect.bisect_right(mine, (at + dt.timedelta(minutes=30), 9))
            want[s, at] = sum(n for _, n in mine[lo:hi])
    assert found == {k: n for k, n in want.items() if n}


def test_shuffles_abreast_are_those_one_by_one():
    """Half words sort as whole ones do, equal upper bits and equal words included, and falls have the bits of sums from trade to trade."""
    import numpy as np

    from barspark.operators import validation as v

    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 40, 600, 1300):
        words = rng.integers(0, 1 << 32, (300, n), dtype=np.uint32)
        words[::3] >>= np.uint32(26)  # many equal words
        words[1::3, : n // 2] ^= (words[1::3, n - n // 2 :] ^ words[1::3, : n // 2]) & np.uint32(0xFFFFFF00)  # equal upper bits
        assert (v._shuffled(words) == np.argsort(words, axis=1, kind="stable")).all()
        net, sample = rng.normal(10, 900, n).round(2), np.arange(v._ABREAST)
        falls = v._falls(net, 77, sample)
        order = np.argsort(v._draws(77, sample[:, None], np.arange(n)[None, :]), axis=1, kind="stable")
        equity = np.cumsum(net[order], axis=1)
        assert (falls == (np.maximum(np.maximum.accumulate(equity, axis=1), 0) - equity).max(axis=1)).all()
        assert (falls[:9] == v._falls(net, 77, sample[:9])).all()


def test_gathered_trades_are_not_sent_again(spark):
    """Folds, days and samples of trades in buckets of their key need no shuffle by experiment."""
    from barspark.functions.store import gathered
    from barspark.operators import metrics, validation

    rows = [(k, seq, f"2024-{seq % 12 + 1:02d}-01", float((seq * 7 + k) % 11 - 5)) for k in range(9) for seq in range(30)]
    plain = spark.createDataFrame(rows, "experiment_id int, trade_seq int, broker_date string, net_pnl double")
    folds = spark.createDataFrame([(f"f{i}", "research" if m < 3 + i else "validation", f"2024-{m:02d}") for i in range(4) for m in range(1 + i, 6 + i)], "fold_id string, segment string, month string")
    t, key = gathered(plain.repartition(4, "experiment_id"), "experiment_id", "trade_seq"), ["experiment_id"]
    for part in (
        lambda x, **lie: validation.summarize_folds(validation.fold_metrics(x, folds, key, falls=False, **lie), key),
        lambda x, **lie: validation.bootstrap_days(x, key, 20, 5, **lie),
        lambda x, **_: metrics.calendar_rollup(x, key),
        lambda x, **_: validation.top_trade_removal(x, key),
    ):
        df = part(t, together=True)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = part(t, together=True)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert plan.count("Exchange hashpartitioning(experiment_id#") == (2 if "_from" in plan else 0)  # blocks of samples of large keys, of which there are none
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, part(plain).collect()))
