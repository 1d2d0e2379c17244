"""Bars, raw bars, ticks and trades derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.functions.calendar import add_sessions
from barspark.functions.prices import round_price
from barspark.operators.features import with_lagged_atr
from barspark.operators.quality import gap_columns

BAR_SECONDS, IRREGULAR, COOLDOWN = 3600, 5400, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "value")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    grouped = events(spark, sf_dir).groupBy("symbol", hour.alias("bar_ts")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
        F.count("*").alias("tick_volume"), F.count("*").alias("spread"), F.lit(0).cast("long").alias("real_volume"),
    )
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("bar_ts")) - 1
    return grouped.withColumn("bar_idx", place.cast("long")).select("symbol", "bar_ts", "bar_idx", "open", "high", "low", "close", "tick_volume", "spread", "real_volume")


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_columns(bars(spark, sf_dir), BAR_SECONDS, IRREGULAR, COOLDOWN)


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with lagged atr and session flags."""
    return add_sessions(with_lagged_atr(bars(spark, sf_dir)))


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with planted faults: some doubled with a later ingest_seq, swapped, negative or missing."""
    b = bars(spark, sf_dir).filter("bar_idx % 89 != 88").withColumn("ingest_seq", F.col("bar_idx") * 2)
    again = b.filter("bar_idx % 97 = 96").withColumn("ingest_seq", F.col("ingest_seq") + 1).withColumn("close", (F.col("high") + F.col("low")) / 2)
    all_ = b.unionByName(again)
    swap = F.col("bar_idx") % 101 == 100
    return all_.select(
        "symbol", "bar_ts", "bar_idx", "ingest_seq", "open", F.when(swap, F.col("low") - 1).otherwise(F.col("high")).alias("high"), F.when(swap, F.col("high")).otherwise(F.col("low")).alias("low"), "close",
        F.when(F.col("bar_idx") % 107 == 106, -1).otherwise(F.col("tick_volume")).alias("tick_volume"), F.when(F.col("bar_idx") % 103 == 102, -1).otherwise(F.col("spread")).alias("spread"), "real_volume",
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return events(spark, sf_dir).select("symbol", F.floor(t / 1000).alias("time_msc"), F.col("value").alias("bid"), F.round(F.col("value") + 0.05, 2).alias("ask"), F.date_format("ts", "yyyy-MM-dd").alias("broker_date"), "event_id")


def trades(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    """Trades of each supplier's (or another key's) order lines."""
    t = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy(key).orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    price = F.col("l_extendedprice")
    risk = price * 0.01
    net = round_price(price * (F.col("l_discount") - F.col("l_tax")))
    return t.select(
        F.col(key).alias("experiment_id"), F.row_number().over(order).cast("long").alias("trade_seq"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("broker_date"),
        F.when(F.col("l_returnflag") == "N", -1).otherwise(1).alias("direction"), net.alias("net_pnl"), (net / risk).alias("pnl_r"), F.col("l_quantity").alias("hold_minutes"),
        (F.col("l_quantity") * 0.06).alias("commission"), (F.col("l_quantity") * 0.02).alias("spread_cost"), (F.col("l_quantity") * 0.1).alias("slippage_cost"), risk.alias("planned_risk"),
    )


BARS_SQL = """bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS bar_idx FROM (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS bar_ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
    count(*) AS tick_volume, count(*) AS spread, CAST(0 AS BIGINT) AS real_volume FROM events GROUP BY 1, 2))"""

SEGMENTED_SQL = BARS_SQL + f""",
gap_0 AS (SELECT *, coalesce(date_diff('second', lag(bar_ts) OVER w, bar_ts), {BAR_SECONDS}) AS gap_seconds, hour(bar_ts) * 60 + minute(bar_ts) AS clock,
    coalesce(hour(lag(bar_ts) OVER w) * 60 + minute(lag(bar_ts) OVER w), hour(bar_ts) * 60 + minute(bar_ts)) AS clock_before FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
gap_1 AS (SELECT *, gap_seconds > {BAR_SECONDS} AS is_gap_after, gap_seconds > {BAR_SECONDS} AND gap_seconds BETWEEN 2700 AND 10800 AND clock_before BETWEEN 30 AND 185 AND clock BETWEEN 120 AND 250 AS is_scheduled_break_after FROM gap_0),
gap_2 AS (SELECT *, is_gap_after AND gap_seconds > {IRREGULAR} AND NOT is_scheduled_break_after AS is_irregular_gap_after FROM gap_1),
segmented AS (SELECT *, coalesce(bar_idx - max(CASE WHEN is_irregular_gap_after THEN bar_idx END) OVER w >= {COOLDOWN}, true) AS entry_allowed,
    sum(CASE WHEN is_irregular_gap_after AND bar_idx > 0 THEN 1 ELSE 0 END) OVER w AS segment_id FROM gap_2 WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING))"""


def prefix_sum_sql(name: str, given: str, place: str, a: float, part: str) -> str:
    """A recursive average as a prefix sum in powers of a, for series short enough not to overflow."""
    return f"sum({given} * power({a!r}, -{place})) OVER (PARTITION BY {part} ORDER BY {place} ROWS UNBOUNDED PRECEDING) * power({a!r}, {place}) AS {name}"


def seed_sql(x: str, n: int, share: float, place: str, part: str, skip: int = 0) -> str:
    first = n - 1 + skip
    return f"CASE WHEN {place} < {first} THEN 0 WHEN {place} = {first} THEN avg({x}) OVER (PARTITION BY {part} ORDER BY {place} ROWS {n - 1} PRECEDING) ELSE {x} * {share!r} END"


MARKET_SQL = BARS_SQL + f""",
tr AS (SELECT *, greatest(high - low, abs(high - coalesce(lag(close) OVER w, close)), abs(low - coalesce(lag(close) OVER w, close))) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
tr_in AS (SELECT *, {seed_sql("tr", 14, 1 / 14, "bar_idx", "symbol")} AS given FROM tr),
atr_0 AS (SELECT *, {prefix_sum_sql("atr14", "given", "bar_idx", 13 / 14, "symbol")} FROM tr_in),
market_0 AS (SELECT * EXCLUDE (tr, given, atr14), lag(CASE WHEN bar_idx >= 13 THEN atr14 END) OVER (PARTITION BY symbol ORDER BY bar_idx) AS atr,
    hour(timezone('Asia/Tokyo', timezone('EET', bar_ts))) AS h_asia, hour(timezone('Europe/London', timezone('EET', bar_ts))) AS h_london, hour(timezone('America/New_York', timezone('EET', bar_ts))) AS h_ny FROM atr_0),
market AS (SELECT * EXCLUDE (h_asia, h_london, h_ny), h_asia >= 9 AND h_asia < 18 AS session_asia, h_london >= 8 AND h_london < 17 AS session_london, h_ny >= 8 AND h_ny < 17 AS session_new_york,
    h_london >= 8 AND h_london < 17 AND h_ny >= 8 AND h_ny < 17 AS session_overlap FROM market_0)"""

RAW_SQL = BARS_SQL + """,
raw_0 AS (SELECT *, bar_idx * 2 AS ingest_seq FROM bars WHERE bar_idx % 89 <> 88),
raw_1 AS (SELECT * FROM raw_0 UNION ALL SELECT * REPLACE (ingest_seq + 1 AS ingest_seq, (high + low) / 2 AS close) FROM raw_0 WHERE bar_idx % 97 = 96),
raw AS (SELECT * REPLACE (CASE WHEN bar_idx % 101 = 100 THEN low - 1 ELSE high END AS high, CASE WHEN bar_idx % 101 = 100 THEN high ELSE low END AS low,
    CASE WHEN bar_idx % 107 = 106 THEN -1 ELSE tick_volume END AS tick_volume, CASE WHEN bar_idx % 103 = 102 THEN -1 ELSE spread END AS spread) FROM raw_1)"""

TICKS_SQL = "ticks AS (SELECT event_type AS symbol, epoch_us(ts) // 1000 AS time_msc, value AS bid, round(value + 0.05, 2) AS ask, strftime(ts, '%Y-%m-%d') AS broker_date, event_id FROM events)"

NET_SQL = "l_extendedprice * (l_discount - l_tax)"
NET_SQL = f"CASE WHEN {NET_SQL} >= 0 THEN floor({NET_SQL} * 100 + 0.5 + 1e-9) ELSE ceil({NET_SQL} * 100 - 0.5 - 1e-9) END / 100"
TRADES_SQL = f"""trades AS (SELECT l_suppkey AS experiment_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS trade_seq, strftime(l_shipdate, '%Y-%m-%d') AS broker_date,
  CASE WHEN l_returnflag = 'N' THEN -1 ELSE 1 END AS direction, {NET_SQL} AS net_pnl, {NET_SQL} / (l_extendedprice * 0.01) AS pnl_r,
  l_quantity AS hold_minutes, l_quantity * 0.06 AS commission, l_quantity * 0.02 AS spread_cost, l_quantity * 0.1 AS slippage_cost, l_extendedprice * 0.01 AS planned_risk FROM lineitem)"""
