"""From a table of experiments to metrics, and from metrics to verdicts; what is wrong with an experiment is a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.store import checkpointed
from barspark.operators import metrics, validation
from barspark.operators.signals import direction_filter, evaluate_table, with_errors
from barspark.operators.trades import signals_to_trades


def c(name: str) -> Column:
    return F.col(name)


def checked(experiments: DataFrame, settings: DataFrame) -> DataFrame:
    """experiments with error (null: none): of the rule or its parameters, of settings that lack or can't be traded, or of an id that several experiments or settings have."""
    times = experiments.groupBy("experiment_id").agg(F.count("*").alias("_times"))
    own = settings.groupBy("experiment_id").agg(F.count("*").alias("_settings"), *(F.min(x).alias(f"_{x}") for x in ("stop_atr", "preferred_risk", "hard_risk", "max_lot", "commission", "slippage")))
    df = with_errors(experiments).join(times, "experiment_id", "left").join(own, "experiment_id", "left")
    above = lambda x: F.when(~F.coalesce(c(f"_{x}") > 0, F.lit(False)), f"{x} is not above 0")
    known = lambda x: F.when(~F.coalesce(c(f"_{x}") >= 0, F.lit(False)), f"{x} is below 0 or unknown")
    error = F.coalesce(
        c("error"), F.when(c("_times") > 1, "several experiments have this id"), F.when(c("_settings").isNull(), "no settings"), F.when(c("_settings") > 1, "several settings have this id"),
        *map(above, ("stop_atr", "preferred_risk", "hard_risk", "max_lot")), *map(known, ("commission", "slippage")),
    )
    return df.withColumn("error", error).select(*experiments.columns, "error")


def trades_of(bars: DataFrame, experiments: DataFrame, settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals, trades) of experiments without errors; a column direction (long, short, combined or null) takes signals of the other side away."""
    signals = evaluate_table(bars, experiments)
    if "direction" in experiments.columns:
        signals = direction_filter(signals.join(experiments.select("experiment_id", F.coalesce("direction", F.lit("combined")).alias("_mode")), "experiment_id"), c("_mode")).drop("_mode").filter("signal != 0")
    signals = checkpointed(signals)
    own = settings.join(experiments.select("experiment_id"), "experiment_id", "left_semi")
    return signals, checkpointed(signals_to_trades(signals, bars, own))


def campaign(bars: DataFrame, experiments: DataFrame, settings: DataFrame) -> DataFrame:
    """experiment_id, strategy, error and the metrics of every row of experiments, as one job: those with an error have null metrics, those that never trade have zeros."""
    table = checkpointed(checked(experiments, settings))
    good = table.filter("error is null")
    _, t = trades_of(bars, good.drop("error"), settings)
    found = metrics.summarize(t, ["experiment_id"], everyone=good.select("experiment_id"))
    failed = table.filter("error is not null").select("experiment_id", "strategy", "error")
    done = good.select("experiment_id", "strategy", F.lit(None).cast("string").alias("error")).join(found, "experiment_id")
    return done.unionByName(failed, allowMissingColumns=True)


def evidence(signals: DataFrame, trades: DataFrame, bars: DataFrame, experiments: DataFrame, settings: DataFrame, domains: DataFrame, length: int = 7, samples: int = 5000, again: bool = False) -> DataFrame:
    """The evidence of experiments from their own runs: folds of months (or of days, with a length of 10), cost and parameter stress, resampled days, and trades without the best.

    Folds are of the trades by date; again: the signals are traded anew on the bars of each slice alone (``validation.walk_forward``).
    """
    key, ids = ["experiment_id"], settings.select("experiment_id")

    def over(folds: DataFrame) -> DataFrame:
        if again:
            return validation.walk_forward(signals, bars, settings, folds, "yyyy-MM-dd"[:length])
        return validation.fold_metrics(trades, folds, key, ids, length, falls=False)

    rolling = checkpointed(over(validation.rolling_folds(trades, length=length)))
    expanding = over(validation.expanding_folds(trades, length=length))
    stress = validation.stress_report(validation.stress_runs(signals, bars, experiments, settings, domains))
    removal = validation.top_trade_removal(trades, key)
    return validation.robustness_evidence(validation.summarize_folds(expanding, key), validation.summarize_folds(rolling, key), rolling, stress, validation.bootstrap_days(trades, key, samples), removal)


def promote(bars: DataFrame, experiments: DataFrame, settings: DataFrame, domains: DataFrame, **options) -> DataFrame:
    """experiment_id, verdict, rejection_reason, final_score of every experiment without an error. Folds, stress and resampling are run for those only that pass the first stage."""
    found = checkpointed(campaign(bars, experiments, settings).filter("error is null").drop("error", "strategy"))
    passed = checkpointed(validation.stage1_decision(found).filter("passed").select("experiment_id"))
    of = lambda df: df.join(passed, "experiment_id", "left_semi")
    own = of(settings)
    signals, trades = trades_of(bars, of(experiments), own)
    return validation.classify(found, evidence(signals, trades, bars, of(experiments), own, domains, **options))
