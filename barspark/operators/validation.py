"""Folds, stress, resampling, scores and decisions on metric tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.functions.store import checkpointed
from barspark.operators import metrics
from barspark.operators.scan import running_total


def c(name: str) -> Column:
    return F.col(name)


# Folds


def months(rows: DataFrame, date: str = "broker_date", length: int = 7) -> DataFrame:
    """month (YYYY-MM; with a length of 10 a day) and its place (1, 2, ...)."""
    found = rows.select(F.substring(date, 1, length).alias("month")).distinct()
    return found.withColumn("place", F.row_number().over(Window.orderBy("month")))


def _fold_rows(scheme: str, spans: DataFrame, found: DataFrame) -> DataFrame:
    """spans: number, research_from, research_to, validation_to (places). A row for each fold, segment and month."""
    rows = spans.join(found, (c("place") >= c("research_from")) & (c("place") <= c("validation_to")))
    segment = F.when(c("place") <= c("research_to"), "research").otherwise("validation")
    return rows.select(F.concat(F.lit(f"{scheme}-"), F.lpad(c("number").cast("string"), 3, "0")).alias("fold_id"), segment.alias("segment"), "month")


def _short(found: DataFrame, scheme: str, needed: int) -> DataFrame:
    """With fewer months than needed: none below 7, else one fold with 80 % (6 at least) for research and up to 3 for validation."""
    n = found.agg(F.count("*").alias("n")).filter((c("n") >= 7) & (c("n") < needed))
    research = F.least(F.greatest(F.lit(6), F.floor(c("n") * 0.8)), c("n") - 1)
    spans = n.select(F.lit(1).alias("number"), F.lit(1).alias("research_from"), research.alias("research_to"), F.least(research + 3, c("n")).alias("validation_to"))
    return _fold_rows(scheme, spans, found)


def rolling_folds(rows: DataFrame, research: int = 12, validation: int = 3, step: int = 3, length: int = 7) -> DataFrame:
    found = months(rows, length=length)
    n = found.agg(F.count("*").alias("n")).filter(c("n") >= research + validation)
    starts = n.select(F.explode(F.sequence(F.lit(1), c("n") - research - validation + 1, F.lit(step))).alias("s"))
    spans = starts.select(((c("s") - 1) / step + 1).cast("int").alias("number"), c("s").alias("research_from"), (c("s") + research - 1).alias("research_to"), (c("s") + research + validation - 1).alias("validation_to"))
    return _fold_rows("rolling", spans, found).unionByName(_short(found, "rolling", research + validation))


def expanding_folds(rows: DataFrame, validation: int = 3, least: int = 12, length: int = 7) -> DataFrame:
    found = months(rows, length=length)
    n = found.agg(F.count("*").alias("n")).filter(c("n") >= least + validation)
    ends = n.select(F.explode(F.sequence(F.lit(least), c("n") - validation, F.lit(validation))).alias("e"))
    spans = ends.select(((c("e") - least) / validation + 1).cast("int").alias("number"), F.lit(1).alias("research_from"), c("e").alias("research_to"), (c("e") + validation).alias("validation_to"))
    return _fold_rows("expanding", spans, found).unionByName(_short(found, "expanding", least + validation))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, checkpointed, with a number of its own for each row."""
    return checkpointed(df.withColumn(name, F.monotonically_increasing_id()))


def _each_segment(everyone: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row of everyone in each fold and segment, of which there are few."""
    return everyone.distinct().crossJoin(F.broadcast(folds.select("fold_id", "segment").distinct()))


def fold_metrics(trades: DataFrame, folds: DataFrame, keys: list[str], everyone: DataFrame | None = None, length: int = 7, falls: bool = True, together: bool = False) -> DataFrame:
    """Metrics of the trades of each fold and segment, for each key of everyone (or of the trades), also where it had no trades. folds is small: one row for each fold and month, or day with a length of 10.

    Trades are summed up by day, and days are sent to their key once; its months meet the folds there, beside a row without trades for each fold, so neither trades nor metrics fan out over a shuffle.
    falls adds max_drawdown_pct, for which every trade is put in order in each of its folds. together: the trades lie by key already (see gathered), so no day is sent.
    """
    own, net, sums = [*keys, "fold_id", "segment"], c("net_pnl"), ("n", "gain", "loss", "net", "days", "good")
    days = trades.groupBy(*keys, "broker_date").agg(F.count("*").alias("n"), F.sum(F.greatest(net, F.lit(0.0))).alias("gain"), F.sum(F.least(net, F.lit(0.0))).alias("loss"), F.sum(net).alias("net"))
    days = (days if together else days.repartition(*keys)).withColumns({"month": F.substring("broker_date", 1, length), "days": F.lit(1).cast("long"), "good": (c("net") > 0).cast("long")})
    months_ = days.groupBy(*keys, "month").agg(*(F.sum(x).alias(x) for x in sums))
    none = F.struct(F.lit("").alias("month"), *(F.lit(0).cast(months_.schema[x].dataType).alias(x) for x in sums))
    rows = months_.groupBy(*keys).agg(F.collect_list(F.struct("month", *sums)).alias("had"))
    if everyone is not None:
        rows = everyone.select(*keys).distinct().join(rows, keys, "left")
    rows = rows.select(*keys, F.explode(F.concat(F.array(none), F.coalesce("had", F.array().cast(rows.schema["had"].dataType)))).alias("x")).select(*keys, "x.*")
    every = folds.select("fold_id", "segment").distinct().withColumn("month", F.lit(""))
    out = rows.join(F.broadcast(folds.select("fold_id", "segment", "month").unionByName(every)), "month").groupBy(*own).agg(*(F.sum(x).alias(x) for x in sums))
    ratio = F.try_divide(c("gain"), F.nullif(F.abs("loss"), F.lit(0.0)))
    out = out.select(*own, c("n").alias("completed_trades"), ratio.alias("profit_factor"), F.try_divide("net", "n").alias("expectancy_usd"), c("net").alias("net_profit"), F.try_divide("good", "days").alias("positive_day_fraction"))
    if not falls:
        return out
    dated = trades.repartition(*keys).withColumn("month", F.substring("broker_date", 1, length)).join(F.broadcast(folds), "month")
    out = out.join(metrics.drawdowns(dated, own).select(*own, "max_drawdown_pct"), own, "left")
    return out.select(*own, "completed_trades", "profit_factor", "expectancy_usd", "net_profit", F.coalesce("max_drawdown_pct", F.lit(0.0)).alias("max_drawdown_pct"), "positive_day_fraction")


def walk_forward(signals: DataFrame, bars: DataFrame, settings: DataFrame, folds: DataFrame, period: str = "yyyy-MM") -> DataFrame:
    """Trades of each fold and segment on its bars alone, so that none runs over the end of its slice, and their metrics: a row for each experiment of settings, fold and segment. signals: experiment_id, symbol, bar_idx, signal."""
    from barspark.operators.trades import signals_to_trades

    dated = bars.withColumn("month", F.date_format("bar_ts", period)).join(F.broadcast(folds), "month")
    # Each slice is a series of its own, named by a number.
    parts = numbered(dated.select("symbol", "fold_id", "segment").distinct(), "part")
    w = Window.partitionBy("part").orderBy("bar_idx")
    sliced = dated.join(parts, ["symbol", "fold_id", "segment"]).withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    own = signals.join(sliced.select("symbol", "bar_idx", "part", "idx"), ["symbol", "bar_idx"]).select("experiment_id", c("part").alias("symbol"), c("idx").alias("bar_idx"), "signal")
    market = sliced.drop("symbol", "bar_idx", "month", "fold_id", "segment").withColumnsRenamed({"part": "symbol", "idx": "bar_idx"})
    t = signals_to_trades(own, market, settings).withColumnRenamed("symbol", "part").join(parts, "part").drop("part")
    keys = ["experiment_id", "fold_id", "segment"]
    seq = F.row_number().over(Window.partitionBy(*keys).orderBy("entry_ts", "symbol"))
    return metrics.summarize(t.withColumn("trade_seq", seq), keys, everyone=_each_segment(settings.select("experiment_id"), folds))


def summarize_folds(folded: DataFrame, keys: list[str]) -> DataFrame:
    own = c("segment") == "validation"
    good, gain = own & (c("profit_factor") > 1), own & (c("expectancy_usd") > 0)
    n = F.count_if(own)
    out = folded.groupBy(*keys).agg(
        n.alias("validation_fold_count"), F.median(F.when(own, c("profit_factor"))).alias("median_validation_pf"), F.median(F.when(c("segment") == "research", c("profit_factor"))).alias("_research"),
        F.try_divide(F.count_if(good), n).alias("validation_pf_above_1_fraction"), F.try_divide(F.count_if(gain), n).alias("validation_positive_expectancy_fraction"),
        F.try_divide(F.count_if(good & gain), n).alias("validation_joint_stability_fraction"), F.min(F.when(own, c("net_profit"))).alias("worst_validation_net_profit"),
    )
    return out.withColumn("research_to_validation_pf_degradation_ratio", F.when(c("_research") > 0, c("median_validation_pf") / c("_research"))).drop("_research")


# Stress

SLIPPAGE, COMMISSION, SPREAD, APPROVED_COMMISSION = (0.0, 5.0, 10.0, 20.0), (1.0, 1.25, 1.5), (1.0, 1.25, 1.5), 6.0


def cost_scenarios(spark: SparkSession) -> DataFrame:
    """label, slippage, commission, spread_multiplier; null where the experiment's own value stays."""
    rows = [(f"slippage:{s:g}", s, None, 1.0) for s in SLIPPAGE] + [(f"commission:{m:g}", None, APPROVED_COMMISSION * m, 1.0) for m in COMMISSION] + [(f"spread:{m:g}", None, None, m) for m in SPREAD]
    return spark.createDataFrame(rows, "label string, slippage_new double, commission_new double, spread_multiplier double")


def _run_metrics(signals: DataFrame, bars: DataFrame, runs: DataFrame) -> DataFrame:
    """runs with metrics, also without trades. runs: run (a number), variant, settings, spread_multiplier; signals has the variant as experiment_id. Spreads are rounded half to even."""
    from barspark.operators.trades import signals_to_trades

    out, settings = None, runs.select(c("run").alias("experiment_id"), *SETTINGS, "spread_multiplier")
    named = signals.withColumnRenamed("experiment_id", "variant").join(runs.select("variant", "run", "spread_multiplier"), "variant")
    for m in SPREAD:
        mine = named.filter(c("spread_multiplier") == m).select(c("run").alias("experiment_id"), "symbol", "bar_idx", "signal")
        stressed = bars.withColumn("spread", F.rint(c("spread") * m))
        t = signals_to_trades(mine, stressed, settings.filter(c("spread_multiplier") == m).drop("spread_multiplier"))
        out = t if out is None else out.unionByName(t)
    out = checkpointed(out)
    found = metrics.totals(out, ["experiment_id"]).join(metrics.drawdowns(out, ["experiment_id"]), "experiment_id")
    found = metrics.with_idle(found, settings, ["experiment_id"]).withColumnRenamed("experiment_id", "run")
    return runs.drop(*SETTINGS, "spread_multiplier", "variant").join(found, "run").drop("run")


#: The columns of settings that a run may change or keep.
SETTINGS = ["stop_atr", "target_r", "time_exit_minutes", "atr_trail", "commission", "slippage", "preferred_risk", "hard_risk", "max_lot"]


def _cost_runs(settings: DataFrame) -> DataFrame:
    """Each experiment of settings under each scenario: experiment_id, label, settings, spread_multiplier."""
    own = settings.crossJoin(F.broadcast(cost_scenarios(settings.sparkSession)))
    own = own.withColumns({"slippage": F.coalesce("slippage_new", "slippage"), "commission": F.coalesce("commission_new", "commission")})
    return own.select("experiment_id", "label", *SETTINGS, "spread_multiplier")


def cost_stress(signals: DataFrame, bars: DataFrame, settings: DataFrame) -> DataFrame:
    """experiment_id, label and the metrics of each experiment of settings under each scenario, also without trades."""
    return _run_metrics(signals, bars, numbered(_cost_runs(settings).withColumn("variant", c("experiment_id")), "run"))


def _variants(experiments: DataFrame, domains: DataFrame) -> DataFrame:
    """experiment_id, param, value, strategy, params and variant (a number) of the neighbours of experiments (see parameter_neighbors)."""
    from barspark.operators.experiments import parameter_neighbors

    return numbered(parameter_neighbors(experiments, domains).join(experiments.select("experiment_id", "strategy"), "experiment_id"), "variant")


def parameter_stress(bars: DataFrame, experiments: DataFrame, settings: DataFrame, domains: DataFrame) -> DataFrame:
    """experiment_id, param, value and the metrics of each experiment (experiment_id, strategy, params) with one parameter moved at a time, also without trades."""
    from barspark.operators.signals import evaluate_table

    near = _variants(experiments, domains)
    signals = evaluate_table(bars, near.select(c("variant").alias("experiment_id"), "strategy", "params"))
    runs = near.select("experiment_id", "param", "value", "variant").join(settings, "experiment_id").withColumns({"run": c("variant"), "spread_multiplier": F.lit(1.0)})
    return _run_metrics(signals, bars, checkpointed(runs))


def stress_runs(signals: DataFrame, bars: DataFrame, experiments: DataFrame, settings: DataFrame, domains: DataFrame) -> DataFrame:
    """experiment_id, stress_type (cost or parameter), label (scenario or parameter=value) and metrics: one table of runs, keyed by experiment and scenario, which one job fills.

    signals are those of the experiments; their neighbours' are found here, all in one table.
    """
    from barspark.operators.signals import evaluate_table

    base = numbered(settings.select("experiment_id").distinct(), "variant").withColumn("variant", -1 - c("variant"))  # the neighbours' numbers are not below 0
    near = _variants(experiments, domains)
    moved = evaluate_table(bars, near.select(c("variant").alias("experiment_id"), "strategy", "params"))
    own = signals.join(base, "experiment_id").select(c("variant").alias("experiment_id"), "symbol", "bar_idx", "signal")
    label = F.concat("param", F.lit("="), c("value").cast("string")).alias("label")
    param_runs = near.select("experiment_id", label, "variant").join(settings.select("experiment_id", *SETTINGS), "experiment_id").withColumns({"spread_multiplier": F.lit(1.0), "stress_type": F.lit("parameter")})
    cost_runs = _cost_runs(settings).join(base, "experiment_id").withColumn("stress_type", F.lit("cost"))
    return _run_metrics(own.unionByName(moved), bars, numbered(cost_runs.unionByName(param_runs), "run"))


def stress_report(stressed: DataFrame) -> DataFrame:
    """experiment_id, parameter_stability_pct, cost_stability_pct, max_drawdown_pct, run counts of rows (experiment_id, stress_type, profit_factor, expectancy_usd, max_drawdown_pct)."""
    param, cost = c("stress_type") == "parameter", c("stress_type") == "cost"
    good = c("profit_factor") > 1
    return stressed.groupBy("experiment_id").agg(
        F.coalesce(F.try_divide(100.0 * F.count_if(param & good & (c("expectancy_usd") > 0)), F.count_if(param)), F.lit(100.0)).alias("parameter_stability_pct"),
        F.coalesce(F.try_divide(100.0 * F.count_if(cost & good), F.count_if(cost)), F.lit(100.0)).alias("cost_stability_pct"),
        F.coalesce(F.max("max_drawdown_pct"), F.lit(0.0)).alias("stress_max_drawdown_pct"), F.count_if(param).alias("parameter_run_count"), F.count_if(cost).alias("cost_run_count"),
    )


# Resampling

QUANTILES = (0.05, 0.5, 0.95)
#: About so many draws are in memory at once, in a processor's cache.
_DRAWN = 1 << 16
#: A key with at most so many draws in all is one task's and its quantiles are found there; the samples of a larger one are spread.
_TOGETHER = 1 << 26
_WORD = 1 << 32
#: Shuffles go abreast where there are at least so many, of so many trades in all at once (32 MB).
_ABREAST, _STEPS = 512, 1 << 22


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit word with every bit spread over all of them (the finalizer of a public hash; fixed values). 32-bit products wrap around. x is overwritten."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def _draws(base: int, sample: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random number below _WORD for each sample and place: a counter-based generator, keyed by the sample's own word, in arithmetic that SQL has too."""
    return _words(base, sample, place).astype(np.uint64)


def _words(base: int, sample: np.ndarray, place: np.ndarray) -> np.ndarray:
    words = lambda x: np.atleast_1d(x).astype(np.uint32)
    key = _mixed(words(np.uint32(base)) + words(sample) * np.uint32(0x9E3779B9))
    x = _mixed(key + words(place) * np.uint32(0x7FEB352D))
    x ^= key
    return _mixed(x)


def _shuffled(words: np.ndarray) -> np.ndarray:
    """The places of each row in the order of its words, equal words in the order of places."""
    n = words.shape[1]
    place = np.arange(n, dtype=np.uint32)[None, :]
    bits = max(1, (n - 1).bit_length())
    # Half words sort in half the time: the place under the upper bits of the word. A row with equal upper bits is sorted by whole words, as are all where most would be.
    few = n * n < 1 << max(0, 32 - bits)
    if few:
        mask = np.uint32((1 << bits) - 1)
        order = words & ~mask
        order |= place
        order.sort(axis=1)
        unsure = ((order[:, 1:] ^ order[:, :-1]) <= mask).any(axis=1)
        order &= mask
        if not unsure.any():
            return order
        words = words[unsure]
    # A long word holds the draw above the place, so equal draws keep the order of the trades.
    whole = words.astype(np.uint64)
    whole <<= np.uint64(32)
    whole |= place
    whole.sort(axis=1)
    whole &= np.uint64(_WORD - 1)
    if few:
        order[unsure] = whole
        return order
    return whole.view(np.int64)


def _falls(net: np.ndarray, base: int, sample: np.ndarray) -> np.ndarray:
    """The deepest fall from the peak so far, 0 included, of each shuffle of net."""
    n, some = len(net), max(1, _DRAWN // max(1, len(net)))
    place = np.arange(n)[None, :]
    drawn = lambda at: net.take(_shuffled(_words(base, sample[at : at + some, None], place)).astype(np.int64, copy=False), mode="clip")
    if len(sample) < _ABREAST:
        out = []
        for at in range(0, len(sample), some):
            equity = np.cumsum(drawn(at), axis=1)
            peak = np.maximum.accumulate(equity, axis=1)
            np.maximum(peak, 0.0, out=peak)
            peak -= equity
            out.append(peak.max(axis=1))
        return np.concatenate(out)
    # All samples go from trade to trade abreast.
    steps = np.empty((n, len(sample)))
    for at in range(0, len(sample), some):
        steps[:, at : at + some] = drawn(at).T
    equity, peak, fall = np.zeros((3, len(sample)))
    below = np.empty(len(sample))
    for step in steps:
        equity += step
        np.maximum(peak, equity, out=peak)
        np.subtract(peak, equity, out=below)
        np.maximum(fall, below, out=fall)
    return fall


def _tasks(df: DataFrame) -> int:
    """Few bytes are much work here, so partitions are not to be put together by size."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _resampled(values: DataFrame, keys: list[str], n: int, seed: int, columns: dict[str, str], one: Callable, together: int = _DRAWN) -> DataFrame:
    """keys and the quantiles of n samples of each key, column by column. values: keys and an array of its values in order. A key's array goes to one task, which draws all of its samples, or to a task for each
    block of samples where that is much work, so nothing is joined and no sample is a row before it is summed up. one: (values, base, samples) -> an array for each column; it gets so many samples that about together values are drawn."""
    base = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(c(k).cast("string") for k in keys))), 1, 7), 16, 10).cast("long")
    rows = values.withColumn("_base", base)
    many = F.size("values").cast("long") * n > _TOGETHER
    step = F.greatest(F.lit(1), F.floor(F.lit(_TOGETHER) / F.greatest(F.size("values"), F.lit(1)))).cast("int")
    spread = rows.filter(many).withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(n - 1), step))).withColumn("_to", F.least(c("_from") + step, F.lit(n)))
    kinds = ", ".join(f"`{k}` {t}" for k, t in values.select(*keys).dtypes)
    names = [f"{name}_p{round(q * 100)}" for name in columns.values() for q in QUANTILES]

    def drawn(data: np.ndarray, start: int, lo: int, hi: int) -> list[np.ndarray]:
        some = max(1, together // max(1, len(data)))
        parts = [one(data, start, np.arange(at, min(hi, at + some))) for at in range(lo, hi, some)]
        return [np.concatenate(x) for x in zip(*parts)]

    def quantiles(x: np.ndarray) -> list[float]:
        """In the terms of Spark's and SQL's exact percentile."""
        x = np.sort(x)
        at = [(q * (n - 1), int(q * (n - 1))) for q in QUANTILES]
        return [float(x[k]) if p == k else float((k + 1 - p) * x[k] + (p - k) * x[k + 1]) for p, k in at]

    def arrays(batch: pa.RecordBatch):
        lists = batch["values"]
        flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(float), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
        return ((i, flat[at[i] : at[i + 1]], int(start)) for i, start in enumerate(batch["_base"].to_pylist()))

    def whole(batches):
        for batch in batches:
            found = [[v for x in drawn(data, start, 0, n) for v in quantiles(x)] for _, data, start in arrays(batch)]
            found = np.array(found).reshape(batch.num_rows, len(names))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *(pa.array(x) for x in found.T)], names=[*keys, *names])

    def blocks(batches):
        for batch in batches:
            lo, hi = batch["_from"].to_pylist(), batch["_to"].to_pylist()
            for i, data, start in arrays(batch):
                found = drawn(data, start, lo[i], hi[i])
                yield pa.RecordBatch.from_arrays([*(pa.repeat(batch[k][i], hi[i] - lo[i]) for k in keys), *map(pa.array, found)], names=[*keys, *columns])

    small = rows.filter(~many).mapInArrow(whole, f"{kinds}, " + ", ".join(f"{x} double" for x in names))
    large = spread.repartition(_tasks(values), *keys, "_from").mapInArrow(blocks, f"{kinds}, " + ", ".join(f"{x} double" for x in columns))
    large = large.groupBy(*keys).agg(*(F.percentile(src, F.lit(q)).alias(f"{name}_p{round(q * 100)}") for src, name in columns.items() for q in QUANTILES))
    return small.unionByName(large)


def bootstrap_days(trades: DataFrame, keys: list[str], n: int = 5000, seed: int = 9216000, together: bool = False) -> DataFrame:
    """Quantiles of mean and total of n resamples of whole days. A sample's day at a place is drawn by a hash, so the draws need no state. together: the trades lie by key already."""
    days = trades.groupBy(*keys, "broker_date").agg(F.sum("net_pnl").alias("d"))
    listed = (days if together else days.repartition(_tasks(days), *keys)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("broker_date", "d"))).alias("x")).select(*keys, c("x.d").alias("values"))

    def one(d: np.ndarray, base: int, sample: np.ndarray):
        place = _draws(base, sample[:, None], np.arange(len(d))[None, :])
        place *= np.uint64(len(d))
        place >>= np.uint64(32)
        total = d[place.view(np.int64)].sum(axis=1)
        return total / len(d), total

    return _resampled(listed, keys, n, seed, {"m": "mean_daily", "t": "total_pnl"}, one)


def order_monte_carlo(trades: DataFrame, keys: list[str], n: int = 5000, seed: int = 9216000) -> DataFrame:
    """Quantiles of the drawdown from 0 over n shuffles of the trades."""
    listed = trades.select(*keys, "trade_seq", "net_pnl").repartition(_tasks(trades), *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("trade_seq", "net_pnl"))).alias("x")).select(*keys, c("x.net_pnl").alias("values"))

    def one(net: np.ndarray, base: int, sample: np.ndarray):
        return (_falls(net, base, sample),)

    return _resampled(listed, keys, n, seed, {"dd": "max_drawdown"}, one, _STEPS)


def top_trade_removal(trades: DataFrame, keys: list[str], counts: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Net profit and profit factor without the largest winners (ties: the earlier goes), and how much they change."""
    w = Window.partitionBy(*keys).orderBy(F.desc("net_pnl"), "trade_seq")
    ranked = trades.withColumn("_place", F.row_number().over(w))
    net, out = c("net_pnl"), []
    out += [F.sum(net).alias("_net"), metrics.profit_factor(net).alias("_pf")]
    for k in counts:
        stays = (c("_place") > k) | (net <= 0)
        out += [F.coalesce(F.sum(F.when(stays, net)), F.lit(0.0)).alias(f"_net_{k}"), metrics.profit_factor(net, stays).alias(f"_pf_{k}")]
    wide = ranked.groupBy(*keys).agg(*out)
    rows = wide.select(*keys, "_net", "_pf", F.explode(F.array(*(F.struct(F.lit(k).alias("removed"), c(f"_net_{k}").alias("net_profit"), c(f"_pf_{k}").alias("profit_factor")) for k in counts))).alias("x"))
    change = lambda before, after: F.when(before != 0, (before - after) / F.abs(before) * 100)
    return rows.select(*keys, "x.*", change(c("_net"), c("x.net_profit")).alias("net_profit_sensitivity_pct"), change(c("_pf"), c("x.profit_factor")).alias("profit_factor_sensitivity_pct"), ((c("_net") > 0) & (c("x.net_profit") < 0)).alias("turns_negative"))


# Scores

#: Weights and bounds of the score, fixed values.
PF_WEIGHT, PF_LOW, PF_HIGH = 25.0, 1.10, 1.50
R_WEIGHT, R_HIGH = 20.0, 0.20
DAILY_WEIGHT, STABILITY_WEIGHT, SAMPLE_WEIGHT = 15.0, 15.0, 10.0
SAMPLE_LOW, SAMPLE_HIGH = 300.0, 3000.0
DRAWDOWN_POINTS, DRAWDOWN_PCT = 15.0, 5.0
CONCENTRATION_POINTS, TOP_SHARE, MONTH_SHARE, MONTHS = 15.0, 0.50, 0.60, 6
SIDE_POINTS, SIDE_TRADES, SIDE_PF = 10.0, 100, 0.90
PRE_MAX, ROBUST_MAX, ALL_MAX = 85.0, 15.0, 100.0


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def score(m: DataFrame) -> DataFrame:
    """m (a metric row each, with daily_percentile and perhaps robustness_component) with the components, penalties and scores. A missing robustness leaves final_score null."""
    zero = F.lit(0.0)
    pf = F.coalesce(PF_WEIGHT * clip((c("profit_factor") - PF_LOW) / (PF_HIGH - PF_LOW)), zero)
    exp_r = F.coalesce(R_WEIGHT * clip(c("expectancy_r") / R_HIGH), zero)
    daily = DAILY_WEIGHT * clip(F.coalesce("daily_percentile", zero))
    year, month = c("positive_year_fraction"), c("positive_month_fraction")
    stability = STABILITY_WEIGHT * F.coalesce((clip(year) + clip(month)) / 2, clip(F.coalesce(year, month)), zero)
    # least and greatest skip nulls, so what is unknown is told apart first.
    stability = F.when(year.isNull() & month.isNull(), zero).when(year.isNull(), STABILITY_WEIGHT * clip(month)).when(month.isNull(), STABILITY_WEIGHT * clip(year)).otherwise(stability)
    sample = F.when(c("completed_trades") > SAMPLE_LOW, SAMPLE_WEIGHT * clip(F.log(c("completed_trades") / SAMPLE_LOW) / F.log(F.lit(SAMPLE_HIGH / SAMPLE_LOW)))).otherwise(zero)
    fall = F.when(c("max_drawdown_pct").isNull(), F.lit(DRAWDOWN_POINTS)).otherwise(DRAWDOWN_POINTS * clip(c("max_drawdown_pct") / DRAWDOWN_PCT))
    top = c("top_5_trade_profit_fraction") / TOP_SHARE
    best = F.when(c("active_months") >= MONTHS, c("best_month_profit_fraction") / MONTH_SHARE)
    crowd = F.when(top.isNull() & best.isNull(), zero).otherwise(CONCENTRATION_POINTS * clip(F.greatest(top, best)))
    weak = F.when((c("long_trades") >= SIDE_TRADES) & (c("short_trades") >= SIDE_TRADES) & c("long_pf").isNotNull() & c("short_pf").isNotNull(), F.least("long_pf", "short_pf"))
    lean = F.when(weak < SIDE_PF, SIDE_POINTS * clip((SIDE_PF - weak) / SIDE_PF)).otherwise(zero)
    pf, exp_r = F.when(c("profit_factor").isNull(), zero).otherwise(pf), F.when(c("expectancy_r").isNull(), zero).otherwise(exp_r)
    out = m.withColumns({"pf_component": pf, "expectancy_component": exp_r, "median_daily_component": daily, "stability_component": stability, "sample_size_component": sample, "drawdown_penalty": fall, "concentration_penalty": crowd, "side_dependence_penalty": lean})
    total = c("pf_component") + c("expectancy_component") + c("median_daily_component") + c("stability_component") + c("sample_size_component") - c("drawdown_penalty") - c("concentration_penalty") - c("side_dependence_penalty")
    out = out.withColumn("pre_robustness_score", clip(total, 0.0, PRE_MAX))
    robust = F.when(c("robustness_component").isNotNull(), clip(c("robustness_component"), 0.0, ROBUST_MAX)) if "robustness_component" in m.columns else F.lit(None).cast("double")
    return out.withColumn("final_score", F.when(robust.isNotNull(), clip(c("pre_robustness_score") + robust, 0.0, ALL_MAX)))


def tie_averaged_percentile(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """df with daily_percentile: the mean place of equal values over n - 1; 1 for a single row. Only the distinct values are put in order."""
    keys = keys or []
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_ties"))
    if keys:
        part = Window.partitionBy(*keys)
        before = F.coalesce(F.sum("_ties").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumn("_before", before).withColumn("_all", F.sum("_ties").over(part))
    else:
        placed = running_total(counts, value, "_ties", "_before", "_all")
    placed = placed.withColumnsRenamed({k: f"_{k}_" for k in (*keys, value)})
    same = [c(k).eqNullSafe(c(f"_{k}_")) for k in (*keys, value)]
    place = c("_before") + (c("_ties") - 1) / 2
    return df.join(placed, same).withColumn("daily_percentile", F.when(c("_all") == 1, F.lit(1.0)).otherwise(place / (c("_all") - 1))).select(*df.columns, "daily_percentile")


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(why)) for bad, why in pairs)), lambda x: x.isNotNull())


def stage1_decision(m: DataFrame) -> DataFrame:
    """m with reasons (in order) and passed."""
    months_ = c("active_months")
    missing_month = (months_ >= MONTHS) & c("best_month_profit_fraction").isNull()
    crowded_month = (months_ >= MONTHS) & F.coalesce(c("best_month_profit_fraction") > MONTH_SHARE, F.lit(False))
    reasons = _reasons(
        (c("profit_factor") < 1.10, "pf_below_1_10"), (c("max_drawdown_pct") > 5.0, "drawdown_above_5_pct"), (c("completed_trades") < 300, "completed_trades_below_300"), (c("expectancy_usd") <= 0, "expectancy_not_positive"),
        (F.coalesce(c("positive_year_fraction") <= 0.5, F.lit(False)), "profitable_years_not_majority"), (c("top_5_trade_profit_fraction").isNull(), "top_five_profit_concentration_missing"), (F.coalesce(c("top_5_trade_profit_fraction") > TOP_SHARE, F.lit(False)), "top_five_profit_concentration_above_50_pct"),
        (months_.isNull(), "active_months_missing"), (F.coalesce(missing_month, F.lit(False)), "best_month_profit_concentration_missing"), (F.coalesce(crowded_month, F.lit(False)), "best_month_profit_concentration_above_60_pct"),
    )
    return m.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def robustness_evidence(expanding: DataFrame, rolling: DataFrame, folded: DataFrame, stress: DataFrame, bootstrap: DataFrame, removal: DataFrame) -> DataFrame:
    """One evidence row for each experiment from the summaries of folds (all keyed by experiment_id), stress, resampling and removal."""
    key = "experiment_id"
    pf = folded.filter("segment = 'validation'").groupBy(key).agg(F.round(F.median("profit_factor"), 12).alias("median_validation_pf"))
    out = expanding.select(key, *(c(x).alias(f"expanding_{x}") for x in expanding.columns if x != key))
    out = out.join(rolling.select(key, *(c(x).alias(f"rolling_{x}") for x in rolling.columns if x != key)), key)
    five = removal.filter("removed = 5").select(key, c("net_profit").alias("top_five_removal_net_profit"), c("profit_factor").alias("top_five_removal_profit_factor"))
    for part in (pf, stress, bootstrap, five):
        out = out.join(part, key, "left")
    return out


def robust_decision(df: DataFrame) -> DataFrame:
    """df (metrics beside evidence) with robust_reasons, robust_passed, walkforward_stability and robustness_component."""
    exp_, roll = c("expanding_validation_joint_stability_fraction"), c("rolling_validation_joint_stability_fraction")
    reasons = _reasons(
        (exp_ < 0.60, "expanding_walkforward_below_60_pct"), (roll < 0.60, "rolling_walkforward_below_60_pct"), (c("median_validation_pf") < 1.05, "median_validation_pf_below_1_05"), (c("parameter_stability_pct") < 60, "parameter_stability_below_60_pct"),
        (c("cost_stability_pct") < 50, "cost_stability_below_50_pct"), (c("stress_max_drawdown_pct") > 5, "stress_drawdown_above_5_pct"), (c("top_five_removal_net_profit") < 0, "top_five_removal_turns_negative"), (c("profit_factor") < 1.10, "baseline_pf_below_1_10"),
    )
    walk = (exp_ + roll) / 2
    part = (walk + c("parameter_stability_pct") / 100 + c("cost_stability_pct") / 100) / 3 * ROBUST_MAX
    out = df.withColumn("robust_reasons", reasons).withColumn("robust_passed", F.size("robust_reasons") == 0)
    return out.withColumns({"walkforward_stability": walk, "robustness_component": F.when(part.isNotNull(), clip(part, 0.0, ROBUST_MAX))})


def classify(m: DataFrame, evidence: DataFrame) -> DataFrame:
    """m with scores, verdict (REJECTED, STAGE1_SURVIVOR, ROBUST_CANDIDATE) and rejection_reason. Percentiles are among those that pass the first stage."""
    decided = stage1_decision(m)
    rejected = decided.filter("not passed").select("experiment_id", F.lit("REJECTED").alias("verdict"), F.array_join("reasons", ";").alias("rejection_reason"), F.lit(None).cast("double").alias("final_score"))
    ranked = tie_averaged_percentile(decided.filter("passed").drop("reasons", "passed"), "median_profit_per_active_day")
    judged = score(robust_decision(ranked.join(evidence.withColumn("_seen", F.lit(True)), "experiment_id", "left")))
    verdict = F.when(c("_seen") & c("robust_passed"), "ROBUST_CANDIDATE").otherwise("STAGE1_SURVIVOR")
    why = F.when(c("_seen").isNull(), "robustness_not_evaluated").otherwise(F.array_join("robust_reasons", ";"))
    return rejected.unionByName(judged.select("experiment_id", verdict.alias("verdict"), why.alias("rejection_reason"), F.when(c("_seen"), c("final_score")).alias("final_score")))


def promoted_trades(trades: DataFrame, classified: DataFrame) -> DataFrame:
    """The trades of the experiments that are not rejected; one without trades raises an error."""
    ids = classified.filter("verdict != 'REJECTED'").select("experiment_id")
    missing = ids.join(trades.select("experiment_id").distinct(), "experiment_id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("a promoted experiment has no trades")
    return trades.join(ids, "experiment_id", "left_semi")


# Selections


def select_by_frequency(m: DataFrame, low: float = 3.0, high: float = 10.0, most: int = 6) -> DataFrame:
    """The best by final_score (then id) with low to high trades a week. m has data_start and data_end in seconds."""
    weekly = c("completed_trades") / ((c("data_end") - c("data_start")) / (7 * 24 * 3600.0))
    return m.withColumn("trades_per_week", weekly).filter(c("trades_per_week").between(low, high)).orderBy(F.desc("final_score"), "experiment_id").limit(most)


def select_by_daily_profit(m: DataFrame, least: float = 50.0, most: int = 6) -> DataFrame:
    good = (c("profit_per_active_day") >= least) & (c("median_profit_per_active_day") > 0)
    return m.filter(good).orderBy(F.desc("final_score"), "experiment_id").limit(most)


def select_by_viability(m: DataFrame, most: int = 6) -> DataFrame:
    good = (c("net_profit") > 0) & (c("profit_factor") >= 1.1) & (c("expectancy_usd") > 0) & (c("max_drawdown_pct") <= 5) & c("final_score").isNotNull()
    return m.filter(good).orderBy(F.desc("final_score"), "experiment_id").limit(most)


ACTIVATION_ROWS, LEAST_50, LEAST_300, MOST_END_SHARE = 256, 205, 64, 0.05


def activation_gate(rows: DataFrame, n: int = ACTIVATION_ROWS, least_50: int = LEAST_50, least_300: int = LEAST_300) -> DataFrame:
    """One row: passed, reasons and counts of rows (experiment_id, completed_trades, risk_skip_count, end_of_data_exits). A row that is missing, doubled or impossible fails the gate."""
    t, e, k = c("completed_trades"), c("end_of_data_exits"), c("risk_skip_count")
    bad = c("experiment_id").isNull() | t.isNull() | e.isNull() | k.isNull() | (t < 0) | (e < 0) | (k < 0) | (e > t)
    a = rows.agg(
        F.count("*").alias("sample_size"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("_bad"), F.count_distinct("experiment_id").alias("_ids"), F.count_if(t == 0).alias("zero_trade_count"), F.count_if(t >= 50).alias("at_least_50_count"), F.count_if(t >= 300).alias("at_least_300_count"),
        F.median(t).alias("median_completed_trades"), F.percentile(t, F.lit(0.9)).alias("p90_completed_trades"), F.sum(t).alias("total_completed_trades"), F.sum(e).alias("_ends"),
    )
    share = F.try_divide(c("_ends"), c("total_completed_trades"))
    no = F.lit(False)
    reasons = F.when(c("sample_size") != n, F.array(F.lit("sample_size_wrong"))).when(c("_bad") | (c("_ids") != c("sample_size")), F.array(F.lit("malformed_structural_row"))).otherwise(
        _reasons((F.coalesce(c("total_completed_trades") == 0, no), "no_completed_trades"), (c("at_least_50_count") < least_50, "too_few_with_50_trades"), (c("at_least_300_count") < least_300, "too_few_with_300_trades"), (F.coalesce(share > MOST_END_SHARE, no), "end_of_data_fraction_above_5_pct"))
    )
    out = a.withColumn("end_of_data_fraction", share).withColumn("reasons", reasons)
    return out.withColumn("passed", F.size("reasons") == 0).drop("_bad", "_ids", "_ends")


def holdout_run(bars: DataFrame, rule: str, params: dict, settings: DataFrame, start: str, end: str) -> DataFrame:
    """Trades of a rule inside [start, end): bars before the start warm the rule up, bars from the end on are cut. Trades outside raise an error."""
    from barspark.operators import signals as sig
    from barspark.operators.trades import signals_to_trades

    seen = bars.filter(c("bar_ts") < F.lit(end).cast("timestamp_ntz"))
    s = sig.mask_window(sig.evaluate(seen, rule, params), start, end).filter("signal != 0").select("symbol", "bar_idx", "signal")
    t = signals_to_trades(s.crossJoin(F.broadcast(settings.select("experiment_id"))), seen, settings)
    inside = (c("entry_ts") >= F.lit(start).cast("timestamp_ntz")) & (c("exit_ts") < F.lit(end).cast("timestamp_ntz"))
    return t.filter(F.when(inside, True).otherwise(F.raise_error(F.lit("a trade lies outside of the window")).cast("boolean")))
