"""Holding computed signals and trades against an external ledger and a tick store.

ticks: symbol, time_msc, bid, ask. Ranges of ticks are joined by stretches of time, which makes them equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators.barriers import first_trigger  # noqa: F401
from barspark.operators.scan import asof

POINT = 0.01
_STRETCH = 3_600_000


def c(name: str) -> Column:
    return F.col(name)


def open_intervals(events: DataFrame, keys: list[str], far: int = 4_102_444_800) -> DataFrame:
    """entry_time, exit_time of each entry of events (time, kind entry or exit): up to the next event; an entry that nothing follows is open for good."""
    w = Window.partitionBy(*keys).orderBy("time", F.when(c("kind") == "exit", 0).otherwise(1))
    df = events.withColumn("exit_time", F.coalesce(F.lead("time").over(w), F.lit(far)))
    return df.filter("kind = 'entry'").select(*keys, c("time").alias("entry_time"), "exit_time")


def classify_signals(signals: DataFrame, ledger: DataFrame, intervals: DataFrame, guards: DataFrame, bucket_seconds: int = 300) -> DataFrame:
    """symbol, time, direction, class: matched (a ledger entry in the same bucket and direction), position_open, guard:<reason>, unexplained; and missing_signal for ledger entries without a signal.

    signals and ledger: symbol, time (seconds), direction. intervals: symbol, entry_time, exit_time. guards: symbol, bucket, reason.
    """
    bucket = F.floor(c("time") / bucket_seconds)
    s = signals.select("symbol", "time", "direction", bucket.alias("bucket"))
    entered = ledger.select("symbol", bucket.alias("bucket"), "direction").distinct().withColumn("hit", F.lit(True))
    df = s.join(entered, ["symbol", "bucket", "direction"], "left")
    # The last interval that began before the signal tells whether a position was open: intervals of a symbol do not overlap.
    df = asof(df, intervals.select("symbol", "entry_time", "exit_time"), ["symbol"], "time", "entry_time", ["exit_time"])
    first = guards.groupBy("symbol", "bucket").agg(F.min("reason").alias("reason"))
    df = df.join(first, ["symbol", "bucket"], "left")
    inside = (c("entry_time") < c("time")) & (c("time") < c("exit_time"))
    kind = F.when(c("hit"), "matched").when(inside, "position_open").when(c("reason").isNotNull(), F.concat(F.lit("guard:"), c("reason"))).otherwise("unexplained")
    out = df.select("symbol", "time", "direction", kind.alias("class"))
    own = s.select("symbol", "bucket", "direction").distinct()
    missing = ledger.select("symbol", "time", "direction", bucket.alias("bucket")).join(own, ["symbol", "bucket", "direction"], "left_anti")
    return out.unionByName(missing.select("symbol", "time", "direction", F.lit("missing_signal").alias("class")))


def construction_check(ledger: DataFrame, states: DataFrame, stop_atr: float = 1.5) -> DataFrame:
    """ledger (key, entry_price, stop, target) beside states (key, atr, planned_entry): span_error (stop to target against 2 x stop_atr x atr), midpoint_error, drift, and whether the span is within a point."""
    df = ledger.join(states, "key", "left")
    span = F.abs(c("target") - c("stop")) - 2 * stop_atr * c("atr")
    df = df.withColumns({"span_error": span, "midpoint_error": (c("target") + c("stop")) / 2 - c("entry_price"), "drift": c("entry_price") - c("planned_entry")})
    return df.withColumn("span_ok", F.coalesce(F.abs("span_error") <= POINT + 1e-9, F.lit(False)))


def lifecycle_check(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 0.011) -> DataFrame:
    """The n-th trade of left against the n-th of right (keys, exit_time, reason, net, balance): same_reason, same_time, balance_step_ok, and rows that one side lacks."""
    w = Window.partitionBy(*keys).orderBy("exit_time")
    a = left.select(*keys, F.row_number().over(w).alias("n"), c("exit_time").alias("_time_a"), c("reason").alias("_reason_a"), c("net").alias("_net"), (c("balance") - F.lag("balance").over(w)).alias("_step"), F.lit(True).alias("_in_a"))
    b = right.select(*keys, F.row_number().over(w).alias("n"), c("exit_time").alias("_time_b"), c("reason").alias("_reason_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, [*keys, "n"], "full")
    return both.select(
        *keys, "n", (c("_reason_a") == c("_reason_b")).alias("same_reason"), (c("_time_a") == c("_time_b")).alias("same_time"),
        F.coalesce(F.abs(c("_step") - c("_net")) <= tolerance, F.lit(True)).alias("balance_step_ok"), F.when(c("_in_a").isNull(), "left").when(c("_in_b").isNull(), "right").alias("missing"),
    )


def balance_asof(events: DataFrame, balances: DataFrame, keys: list[str]) -> DataFrame:
    """events (keys, time) with the last balance at or before."""
    return asof(events, balances.select(*keys, c("time").alias("balance_time"), "balance"), keys, "time", "balance_time", ["balance"])


def volume_check(events: DataFrame, balances: DataFrame, keys: list[str], share: float = 0.002, contract: float = 100.0, step: float = 0.01) -> DataFrame:
    """events (keys, time, stop_distance, volume; null: skipped) with expected_volume = floor(balance x share / (stop x contract) / step) steps, and volume_ok."""
    df = balance_asof(events, balances, keys)
    lot = F.round(F.floor(c("balance") * share / (c("stop_distance") * contract) / step + 1e-9) * step, 10)
    df = df.withColumn("expected_volume", lot)
    return df.withColumn("volume_ok", F.coalesce(F.abs(F.coalesce("volume", F.lit(0.0)) - c("expected_volume")) < 1e-9, F.lit(False)))


def in_range(rows: DataFrame, ticks: DataFrame, low: str, high: str) -> DataFrame:
    """Each row beside the ticks of its symbol with low <= time_msc <= high."""
    parts = F.sequence(F.floor(c(low) / _STRETCH), F.floor(c(high) / _STRETCH))
    spread = rows.withColumn("_part", F.explode(parts))
    side = ticks.select("symbol", "time_msc", "bid", "ask", F.floor(c("time_msc") / _STRETCH).alias("_part"))
    return spread.join(side, ["symbol", "_part"]).filter((c("time_msc") >= c(low)) & (c("time_msc") <= c(high))).drop("_part")


def entry_tick(trades: DataFrame, ticks: DataFrame) -> DataFrame:
    """trade_id, tick_msc: the first tick in the second of the entry whose own side's price is the fill within half a point."""
    rows = trades.withColumns({"_lo": c("entry_time") * 1000, "_hi": c("entry_time") * 1000 + 999})
    price = F.when(c("direction") == 1, c("ask")).otherwise(c("bid"))
    near = in_range(rows, ticks, "_lo", "_hi").filter(F.abs(price - c("entry_price")) <= POINT / 2 + 1e-9)
    return near.groupBy("trade_id").agg(F.min("time_msc").alias("tick_msc"))


def delay_endpoints(events: DataFrame, ticks: DataFrame, delay_msc: int) -> DataFrame:
    """events (event_id, symbol, time_msc, fill) with the last tick at or before, and the first at or after, time + delay, and which of them explains the fill."""
    at = events.withColumn("due", c("time_msc") + delay_msc).drop("time_msc")
    t = ticks.groupBy("symbol", "time_msc").agg(F.min("bid").alias("bid"))
    back = asof(at, t.select("symbol", c("time_msc").alias("before_msc"), c("bid").alias("before_bid")), ["symbol"], "due", "before_msc", ["before_bid"])
    both = asof(back, t.select("symbol", c("time_msc").alias("after_msc"), c("bid").alias("after_bid")), ["symbol"], "due", "after_msc", ["after_bid"], forward=True)
    near = lambda x: F.coalesce(F.abs(c(x) - c("fill")) <= POINT / 2 + 1e-9, F.lit(False))
    return both.withColumn("explains", F.when(near("before_bid") & near("after_bid"), "both").when(near("before_bid"), "before").when(near("after_bid"), "after").otherwise("none"))


def rounding_sweep(prices: DataFrame, epsilons: list[float], digits: int = 2) -> DataFrame:
    """epsilon, mismatches, best: how many raw prices, rounded half up with the nudge, differ from the ledger's (raw, booked); the least epsilon of fewest mismatches is best."""
    eps = F.explode(F.array(*(F.lit(e) for e in epsilons)))
    rounded = F.floor(c("raw") * 10**digits + 0.5 + c("epsilon")) / 10**digits
    found = prices.withColumn("epsilon", eps).groupBy("epsilon").agg(F.count_if(F.abs(rounded - c("booked")) > 1e-9).alias("mismatches"))
    first = F.row_number().over(Window.orderBy("mismatches", "epsilon")) == 1
    return found.withColumn("best", first)


def cost_rates(ledger: DataFrame) -> DataFrame:
    """direction, commission_rate, swap_rate (per lot, 8 digits) and how often."""
    rate = lambda x: F.round(c(x) / c("volume"), 8).alias(f"{x}_rate")
    return ledger.filter("volume > 0").select("direction", rate("commission"), rate("swap")).groupBy("direction", "commission_rate", "swap_rate").agg(F.count("*").alias("n"))


#: Nights charged for each weekday (Monday 0) on which a position is held over midnight, fixed values.
SWAP_NIGHTS = (1, 1, 3, 1, 1, 0, 0)


def swap_charges(trades: DataFrame) -> DataFrame:
    """trade_id, nights, swap of trades (trade_id, entry_ts, exit_ts, volume, swap_per_lot): a charge for each midnight held over, rounded each night."""
    last = F.date_sub(F.to_date("exit_ts"), 1)
    held = trades.filter(F.to_date("entry_ts") <= last).withColumn("day", F.explode(F.sequence(F.to_date("entry_ts"), last)))
    times = F.get(F.array(*(F.lit(x) for x in SWAP_NIGHTS)), F.weekday("day"))
    nightly = F.round(c("swap_per_lot") * c("volume") * times, 2)
    return held.groupBy("trade_id").agg(F.sum(times).alias("nights"), F.round(F.sum(nightly), 2).alias("swap"))


def field_mismatches(left: DataFrame, right: DataFrame, key: str, tolerances: dict[str, float]) -> DataFrame:
    """field, n_compared, n_mismatches over trades that both sides have; a value that only one side has is a mismatch."""
    both = left.alias("a").join(right.alias("b"), key)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), c(f"a.{f}").cast("double").alias("x"), c(f"b.{f}").cast("double").alias("y"), F.lit(t).alias("t")) for f, t in tolerances.items())))
    rows = both.select(each.alias("v")).select("v.*")
    same = F.coalesce(F.abs(c("x") - c("y")) <= c("t"), c("x").isNull() & c("y").isNull())
    return rows.groupBy("field").agg(F.count("*").alias("n_compared"), F.count_if(~same).alias("n_mismatches"))
