"""Performance tables of trades, a row for each key. What is undefined is null.

trades: the keys, trade_seq (the order), broker_date, direction, net_pnl, pnl_r, hold_minutes, commission_cost, spread_cost, slippage_cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EQUITY = 5000.0


def c(name: str) -> Column:
    return F.col(name)


def _sum_if(x: Column, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, x)), F.lit(0.0))


def exact_sum(x: Column) -> Column:
    """The sum of x, the same in every order of the rows: of up to 10 decimals, exactly, where the values are in the range of money."""
    fits = F.coalesce(F.max(F.abs(x)) < 1e15, F.lit(True))
    return F.when(fits, F.sum(F.when(F.abs(x) < 1e15, x).cast("decimal(28,10)")).cast("double")).otherwise(F.sum(x))


def profit_factor(net: Column, when: Column | None = None) -> Column:
    when = F.lit(True) if when is None else when
    return F.try_divide(_sum_if(net, when & (net > 0)), F.nullif(F.abs(_sum_if(net, when & (net < 0))), F.lit(0.0)))


def totals(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, sums, sides, medians and costs, in one pass."""
    net = c("net_pnl")
    return trades.groupBy(*keys).agg(
        F.count("*").alias("completed_trades"), F.count_if(net > 0).alias("wins"), F.count_if(net < 0).alias("losses"), (F.count_if(net > 0) / F.count("*")).alias("win_rate"),
        _sum_if(net, net > 0).alias("gross_profit"), _sum_if(net, net < 0).alias("gross_loss"), profit_factor(net).alias("profit_factor"), F.sum(net).alias("net_profit"), F.avg(net).alias("expectancy_usd"),
        F.avg("pnl_r").alias("expectancy_r"), profit_factor(net, c("direction") == 1).alias("long_pf"), profit_factor(net, c("direction") == -1).alias("short_pf"),
        F.count_if(c("direction") == 1).alias("long_trades"), F.count_if(c("direction") == -1).alias("short_trades"), F.median("hold_minutes").alias("median_hold_minutes"),
        F.sum("commission_cost").alias("commission_cost"), F.sum("spread_cost").alias("spread_cost"), F.sum("slippage_cost").alias("slippage_cost"),
    )


def loss_streaks(trades: DataFrame, keys: list[str], order: str = "trade_seq") -> DataFrame:
    """The longest run of losing trades."""
    w = Window.partitionBy(*keys).orderBy(order)
    loss = c("net_pnl") < 0
    df = trades.select(*keys, order, loss.alias("_loss")).withColumn("_run", F.count_if(~c("_loss")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = df.groupBy(*keys, "_run").agg(F.count_if("_loss").alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias("max_loss_streak"))


def drawdowns(trades: DataFrame, keys: list[str], equity: float = EQUITY, order: str = "trade_seq") -> DataFrame:
    """The largest fall of the equity from its highest point so far, the start included."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = trades.withColumn("_equity", F.lit(equity) + F.sum("net_pnl").over(w)).withColumn("_peak", F.greatest(F.lit(equity), F.max("_equity").over(w)))
    fall = c("_peak") - c("_equity")
    return df.groupBy(*keys).agg(F.max(fall).alias("max_drawdown_usd"), F.max(F.when(c("_peak") > 0, fall / c("_peak") * 100).otherwise(0.0)).alias("max_drawdown_pct"))


def calendar_rollup(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Day, month and year sums, by one pass over days and grouping sets over those. Ranks and signs depend on a sum's last bit, so a day is summed in the order of its trades and the rest exactly, wherever the rows lie."""
    w = Window.partitionBy(*keys, "broker_date").orderBy("trade_seq").rowsBetween(Window.unboundedPreceding, 0)
    days = trades.withColumn("_so_far", F.sum("net_pnl").over(w)).groupBy(*keys, "broker_date").agg(F.max_by("_so_far", "trade_seq").alias("day_net"), F.count("*").alias("n"))
    day = days.groupBy(*keys).agg(F.count("*").alias("active_days"), F.median("day_net").alias("median_profit_per_active_day"), (exact_sum(c("day_net")) / F.count("*")).alias("profit_per_active_day"), (F.sum("n") / F.count("*")).alias("trades_per_active_day"), (F.count_if(c("day_net") > 0) / F.count("*")).alias("positive_day_fraction"))
    months = days.groupBy(*keys, F.substring("broker_date", 1, 7).alias("month")).agg(exact_sum(c("day_net")).alias("m"))
    month = months.groupBy(*keys).agg(F.count("*").alias("active_months"), F.min("m").alias("worst_month"), F.max("m").alias("best_month"), (F.count_if(c("m") > 0) / F.count("*")).alias("positive_month_fraction"))
    years = months.groupBy(*keys, F.substring("month", 1, 4).alias("year")).agg(exact_sum(c("m")).alias("y"))
    year = years.groupBy(*keys).agg((F.count_if(c("y") > 0) / F.count("*")).alias("positive_year_fraction"))
    return day.join(month, keys).join(year, keys)


def concentration(trades: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """Share of the top winners in the gross profit."""
    w = Window.partitionBy(*keys).orderBy(F.desc("net_pnl"))
    wins = trades.filter("net_pnl > 0").withColumn("_place", F.row_number().over(w))
    return wins.groupBy(*keys).agg((F.sum(F.when(c("_place") <= top, c("net_pnl"))) / F.sum("net_pnl")).alias(f"top_{top}_trade_profit_fraction"))


def summarize(trades: DataFrame, keys: list[str], equity: float = EQUITY, everyone: DataFrame | None = None) -> DataFrame:
    """All metrics, of keys with trades or of all keys of everyone. Every part is a row for each key, so the joins are small."""
    out = totals(trades, keys)
    for part in (loss_streaks(trades, keys), drawdowns(trades, keys, equity), calendar_rollup(trades, keys), concentration(trades, keys)):
        out = out.join(part, keys, "left")
    best = F.when(c("gross_profit") > 0, F.greatest(F.lit(0.0), c("best_month")) / c("gross_profit"))
    out = out.withColumn("best_month_profit_fraction", best).drop("best_month")
    return out if everyone is None else with_idle(out, everyone, keys)


#: What a key without trades has: no trades, no money moved, no fall. What has no meaning without trades stays null.
ZERO_COUNTS = ("completed_trades", "wins", "losses", "long_trades", "short_trades", "max_loss_streak", "active_days", "active_months")
ZERO_SUMS = ("gross_profit", "gross_loss", "net_profit", "commission_cost", "spread_cost", "slippage_cost", "max_drawdown_usd", "max_drawdown_pct")


def with_idle(found: DataFrame, everyone: DataFrame, keys: list[str]) -> DataFrame:
    """The metrics found, with a row for each key of everyone, of whom some had no trades."""
    out = everyone.select(*keys).distinct().join(found, keys, "left")
    zeros = {n: F.lit(0).cast(found.schema[n].dataType) for n in (*ZERO_COUNTS, *ZERO_SUMS) if n in found.columns}
    return out.withColumns({n: F.coalesce(c(n), zero) for n, zero in zeros.items()})


def positive_day_fraction(trades: DataFrame, keys: list[str]) -> DataFrame:
    return calendar_rollup(trades, keys).select(*keys, "positive_day_fraction")
