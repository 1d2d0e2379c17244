"""Queries over bars: sources, checks, calendar, features and coarser bars, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions import calendar as cal
from barspark.operators import features, quality, resample, signals
from barspark.plans import fixtures as fx
from barspark.plans.fixtures import BARS_SQL, MARKET_SQL, RAW_SQL, SEGMENTED_SQL, prefix_sum_sql, seed_sql

SEG = "PARTITION BY symbol, segment_id ORDER BY bar_idx"


def r(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def rs(*pairs: str) -> str:
    """Rounded SQL columns, each 'expression AS name' or a name."""
    out = []
    for p in pairs:
        expr, _, name = p.rpartition(" AS ") if " AS " in p else (p, "", p)
        out.append(f"round({expr}, 6) AS {name}")
    return ", ".join(out)


Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Quality


@query("d1_invalid_ohlc", f"WITH {RAW_SQL} SELECT symbol, bar_idx, ingest_seq FROM raw WHERE NOT coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close) AND low <= least(open, close) AND low <= high, false)")
def d1(spark, sf):
    return fx.raw_bars(spark, sf).filter(quality.invalid_ohlc()).select("symbol", "bar_idx", "ingest_seq")


@query("d2_invalid_spread", f"WITH {RAW_SQL} SELECT symbol, bar_idx, ingest_seq FROM raw WHERE spread IS NULL OR spread < 0")
def d2(spark, sf):
    return fx.raw_bars(spark, sf).filter(quality.invalid_spread()).select("symbol", "bar_idx", "ingest_seq")


@query("d3_negative_volume", f"WITH {RAW_SQL} SELECT symbol, bar_idx, ingest_seq FROM raw WHERE tick_volume < 0 OR real_volume < 0")
def d3(spark, sf):
    return fx.raw_bars(spark, sf).filter(quality.negative_volume()).select("symbol", "bar_idx", "ingest_seq")


@query("d4_duplicate_timestamps", f"WITH {RAW_SQL} SELECT symbol, bar_idx, ingest_seq, copies FROM (SELECT *, count(*) OVER (PARTITION BY symbol, bar_ts) AS copies FROM raw) WHERE copies > 1")
def d4(spark, sf):
    return quality.duplicate_timestamps(fx.raw_bars(spark, sf)).select("symbol", "bar_idx", "ingest_seq", "copies")


DEDUP = "dedup AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY symbol, bar_ts ORDER BY ingest_seq DESC) = 1)"


@query("d5_dedup_keep_last", f"WITH {RAW_SQL}, {DEDUP} SELECT symbol, bar_idx, ingest_seq, round(close, 6) AS close FROM dedup")
def d5(spark, sf):
    return quality.dedup_keep_last(fx.raw_bars(spark, sf)).select("symbol", "bar_idx", "ingest_seq", *r("close"))


GAPS = """gaps AS (SELECT * FROM (SELECT symbol, bar_ts, lag(bar_ts) OVER w AS previous_ts, date_diff('second', lag(bar_ts) OVER w, bar_ts) AS gap_seconds FROM dedup WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)) WHERE gap_seconds > 3600),
gap_kinds AS (SELECT *, (isodow(previous_ts) - 1) + date_diff('day', CAST(previous_ts AS DATE), CAST(bar_ts AS DATE)) >= 5 AS weekend FROM gaps)"""


@query("d6_gap_issues", f"WITH {RAW_SQL}, {DEDUP}, {GAPS} SELECT symbol, epoch_ms(bar_ts) // 1000 AS bar_s, gap_seconds, CASE WHEN weekend THEN 'market_closed_gap' ELSE 'unexpected_gap' END AS issue_type, CASE WHEN weekend THEN 'info' ELSE 'warning' END AS severity FROM gap_kinds")
def d6(spark, sf):
    return quality.gap_issues(quality.dedup_keep_last(fx.raw_bars(spark, sf)), fx.BAR_SECONDS).select("symbol", cal.epoch(F.col("bar_ts")).alias("bar_s"), "gap_seconds", "issue_type", "severity")


CLEAN = "clean AS (SELECT * FROM dedup WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close) AND low <= least(open, close) AND low <= high AND spread >= 0 AND NOT coalesce(tick_volume < 0, false) AND NOT coalesce(real_volume < 0, false))"


@query("d7_repeated_runs", f"WITH {BARS_SQL}, n AS (SELECT symbol, bar_ts, bar_idx, CASE WHEN tick_volume IS NOT DISTINCT FROM lag(tick_volume) OVER w THEN 0 ELSE 1 END AS new FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT symbol, epoch_ms(min(bar_ts)) // 1000 AS start_s, count(*) AS n_bars FROM g GROUP BY symbol, run HAVING count(*) >= 3")
def d7(spark, sf):
    """Runs of hours of equal activity; prices of the fixture never repeat."""
    return quality.repeated_bar_runs(fx.bars(spark, sf), 3, ("tick_volume",)).select("symbol", cal.epoch(F.col("start_ts")).alias("start_s"), "n_bars")


@query("d8_validate_issues", f"""WITH {RAW_SQL}, {DEDUP}, {GAPS}, i AS (
  SELECT symbol, 'duplicate_timestamp' AS issue_type FROM (SELECT symbol, count(*) OVER (PARTITION BY symbol, bar_ts) AS k FROM raw) WHERE k > 1
  UNION ALL SELECT symbol, 'invalid_ohlc' FROM raw WHERE NOT coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close) AND low <= least(open, close) AND low <= high, false)
  UNION ALL SELECT symbol, 'invalid_spread' FROM raw WHERE coalesce(spread < 0, true) UNION ALL SELECT symbol, 'negative_volume' FROM raw WHERE coalesce(tick_volume < 0, false) OR coalesce(real_volume < 0, false)
  UNION ALL SELECT symbol, CASE WHEN weekend THEN 'market_closed_gap' ELSE 'unexpected_gap' END FROM gap_kinds) SELECT symbol, issue_type, count(*) AS n FROM i GROUP BY ALL""")
def d8(spark, sf):
    return quality.issues(fx.raw_bars(spark, sf), fx.BAR_SECONDS).groupBy("symbol", "issue_type").agg(F.count("*").alias("n"))


@query("d8_validate_summary", f"""WITH {RAW_SQL}, {DEDUP}, {CLEAN}, late AS (SELECT symbol, count(*) AS input_rows, bool_or(coalesce(p > bar_ts, false)) AS non_monotonic_input FROM (SELECT *, lag(bar_ts) OVER (PARTITION BY symbol ORDER BY ingest_seq) AS p FROM raw) GROUP BY symbol)
SELECT symbol, input_rows, clean_rows, input_rows - clean_rows AS removed_rows, non_monotonic_input FROM late JOIN (SELECT symbol, count(*) AS clean_rows FROM clean GROUP BY symbol) USING (symbol)""")
def d8s(spark, sf):
    return quality.summary(fx.raw_bars(spark, sf), fx.BAR_SECONDS).drop("issue_counts")


@query("d9_research_window", f"WITH {BARS_SQL} SELECT symbol, bar_idx FROM bars WHERE bar_ts >= TIMESTAMP '2024-01-15 00:00:00'")
def d9(spark, sf):
    return quality.research_window(fx.bars(spark, sf), "2024-01-15 00:00:00").select("symbol", "bar_idx")


GAP_COLUMNS = ["gap_seconds", "is_gap_after", "is_scheduled_break_after", "is_irregular_gap_after"]


@query("d10_gap_columns", f"WITH {SEGMENTED_SQL} SELECT symbol, bar_idx, {', '.join(GAP_COLUMNS)} FROM segmented")
def d10(spark, sf):
    return fx.segmented(spark, sf).select("symbol", "bar_idx", *GAP_COLUMNS)


@query("d11_entry_allowed", f"WITH {SEGMENTED_SQL} SELECT symbol, bar_idx, entry_allowed FROM segmented")
def d11(spark, sf):
    return fx.segmented(spark, sf).select("symbol", "bar_idx", "entry_allowed")


@query("d12_segments", f"WITH {SEGMENTED_SQL} SELECT symbol, CAST(segment_id AS BIGINT) AS segment_id, min(bar_idx) AS first_idx, count(*) AS n_bars FROM segmented GROUP BY 1, 2")
def d12(spark, sf):
    return fx.segmented(spark, sf).groupBy("symbol", "segment_id").agg(F.min("bar_idx").alias("first_idx"), F.count("*").alias("n_bars"))


@query("d13_research_prefix", f"WITH {BARS_SQL} SELECT symbol, bar_idx FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS k FROM bars WHERE bar_ts >= TIMESTAMP '2024-01-10 00:00:00') WHERE k <= 20")
def d13(spark, sf):
    return quality.research_prefix(fx.bars(spark, sf), 20, "2024-01-10 00:00:00").select("symbol", "bar_idx")


# Calendar

FLAGS = ["session_asia", "session_london", "session_new_york", "session_overlap"]


@query("c1_sessions", f"WITH {MARKET_SQL} SELECT symbol, bar_idx, {', '.join(FLAGS)} FROM market")
def c1(spark, sf):
    return cal.add_sessions(fx.bars(spark, sf)).select("symbol", "bar_idx", *FLAGS)


@query("c2_calendar", f"WITH {BARS_SQL} SELECT symbol, bar_idx, strftime(bar_ts, '%Y-%m-%d') AS broker_date, CAST(year(bar_ts) AS INTEGER) AS year, CAST(month(bar_ts) AS INTEGER) AS month, CAST(isodow(bar_ts) - 1 AS INTEGER) AS weekday, CAST(hour(bar_ts) AS INTEGER) AS hour, CAST(minute(bar_ts) AS INTEGER) AS minute FROM bars")
def c2(spark, sf):
    return cal.add_calendar(fx.bars(spark, sf)).select("symbol", "bar_idx", "broker_date", "year", "month", "weekday", "hour", "minute")


@query("c3_utc_epoch", f"WITH {BARS_SQL} SELECT symbol, bar_idx, epoch_ms(bar_ts) // 1000 AS legacy, CAST(epoch(timezone('EET', bar_ts)) AS BIGINT) AS utc FROM bars")
def c3(spark, sf):
    ts = F.col("bar_ts")
    return fx.bars(spark, sf).select("symbol", "bar_idx", cal.to_utc_epoch(ts, "legacy_wall_clock").alias("legacy"), cal.to_utc_epoch(ts, "broker_local_to_utc").alias("utc"))


@query("c4_calendar_groups", f"WITH {BARS_SQL} SELECT symbol, bar_idx, dense_rank() OVER (PARTITION BY symbol ORDER BY CAST(bar_ts AS DATE)) - 1 AS day_id, dense_rank() OVER (PARTITION BY symbol ORDER BY date_trunc('month', bar_ts)) - 1 AS month_id, dense_rank() OVER (PARTITION BY symbol ORDER BY year(bar_ts)) - 1 AS year_id FROM bars")
def c4(spark, sf):
    return cal.calendar_groups(fx.bars(spark, sf)).select("symbol", "bar_idx", *(F.col(c).cast("long").alias(c) for c in ("day_id", "month_id", "year_id")))


@query("c5_session_occurrences", f"WITH {MARKET_SQL}, s AS (SELECT *, session_london AND NOT coalesce(lag(session_london) OVER (PARTITION BY symbol ORDER BY bar_idx), false) AS st FROM market), o AS (SELECT *, CAST(sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM s) SELECT symbol, run_id, min(bar_idx) AS first_idx, count(*) AS n_bars FROM o WHERE session_london GROUP BY 1, 2")
def c5(spark, sf):
    df = signals.session_occurrences(cal.add_sessions(fx.bars(spark, sf)), "session_london", ["symbol"])
    return df.filter("in_session").groupBy("symbol", "run_id").agg(F.min("bar_idx").alias("first_idx"), F.count("*").alias("n_bars"))


@query("c6_legacy_epoch", f"WITH {BARS_SQL} SELECT symbol, bar_idx, CAST(epoch(timezone('EET', bar_ts)) AS BIGINT) AS utc FROM bars")
def c6(spark, sf):
    return fx.bars(spark, sf).select("symbol", "bar_idx", cal.legacy_epoch_to_utc(cal.epoch(F.col("bar_ts"))).alias("utc"))


# Features

PLACED = SEGMENTED_SQL + ",\nplaced AS (SELECT *, row_number() OVER (PARTITION BY symbol, segment_id ORDER BY bar_idx) - 1 AS place, lag(close) OVER (PARTITION BY symbol, segment_id ORDER BY bar_idx) AS c1 FROM segmented)"


def own(n: int) -> str:
    return f"({SEG} ROWS {n - 1} PRECEDING)"


def when_full(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {own(n)} = {n} THEN {f} OVER {own(n)} END"


def _feature_query(name: str, columns: list[str], sql: str) -> None:
    def run(spark, sf):
        return features.features(fx.segmented(spark, sf)).select("symbol", "bar_idx", *r(*columns))

    query(name, sql)(run)


_feature_query("f1_returns", ["return_1", "log_return_1"], f"WITH {PLACED} SELECT symbol, bar_idx, {rs('close / c1 - 1 AS return_1', 'ln(close / c1) AS log_return_1')} FROM placed")
_feature_query("f2_candles", ["range", "body", "upper_wick", "lower_wick"], f"WITH {PLACED} SELECT symbol, bar_idx, {rs('high - low AS range', 'abs(close - open) AS body', 'high - greatest(open, close) AS upper_wick', 'least(open, close) - low AS lower_wick')} FROM placed")
_feature_query("f3_sma", [f"sma_{n}" for n in features.SMA], f"WITH {PLACED} SELECT symbol, bar_idx, {rs(*(when_full('avg(close)', 'close', n) + f' AS sma_{n}' for n in features.SMA))} FROM placed")


def _recursive(columns: list[tuple[str, str, int, float, float, int]], final: str) -> str:
    """columns: name, source, n, a, share, skip."""
    part = "symbol, segment_id"
    given = ", ".join(f"{seed_sql(x, n, share, 'place', part, skip)} AS in_{name}" for name, x, n, a, share, skip in columns)
    sums = ", ".join(prefix_sum_sql(name, f"in_{name}", "place", a, part) for name, x, n, a, share, skip in columns)
    return f"WITH {PLACED}, src AS (SELECT *, greatest(high - low, abs(high - coalesce(c1, close)), abs(low - coalesce(c1, close))) AS tr, greatest(close - c1, 0) AS gain, greatest(c1 - close, 0) AS loss FROM placed), given AS (SELECT *, {given} FROM src), sums AS (SELECT *, {sums} FROM given) {final}"


_feature_query("f4_ema", [f"ema_{n}" for n in features.EMA], _recursive([(f"e{n}", "close", n, 1 - 2 / (n + 1), 2 / (n + 1), 0) for n in features.EMA], f"SELECT symbol, bar_idx, {rs(*(f'CASE WHEN place >= {n - 1} THEN e{n} END AS ema_{n}' for n in features.EMA))} FROM sums"))
_feature_query("f5_atr", [f"atr_{n}" for n in features.ATR], _recursive([(f"a{n}", "tr", n, (n - 1) / n, 1 / n, 0) for n in features.ATR], f"SELECT symbol, bar_idx, {rs(*(f'CASE WHEN place >= {n - 1} THEN a{n} END AS atr_{n}' for n in features.ATR))} FROM sums"))
_feature_query("f6_rsi", [f"rsi_{n}" for n in features.RSI], _recursive([(f"{k[0]}{n}", k, n, (n - 1) / n, 1 / n, 1) for n in features.RSI for k in ("gain", "loss")], f"SELECT symbol, bar_idx, {rs(*(f'CASE WHEN place < {n} THEN NULL WHEN l{n} = 0 THEN CASE WHEN g{n} = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + g{n} / l{n}) END AS rsi_{n}' for n in features.RSI))} FROM sums"))
BOLL = f"WITH {PLACED}, b AS (SELECT *, {when_full('avg(close)', 'close', 20)} AS m, {when_full('stddev_pop(close)', 'close', 20)} AS s FROM placed)"
_feature_query("f8_bollinger", ["boll_mid_20_2", "boll_upper_20_2", "boll_lower_20_2", "boll_bandwidth_20_2", "boll_zscore_20_2"], f"{BOLL} SELECT symbol, bar_idx, {rs('m AS boll_mid_20_2', 'm + 2 * s AS boll_upper_20_2', 'm - 2 * s AS boll_lower_20_2', '4 * s / nullif(m, 0) AS boll_bandwidth_20_2', 'CASE WHEN s > 0 THEN (close - m) / s END AS boll_zscore_20_2')} FROM b")
RANGES = ", ".join(f"{when_full('max(high)', 'high', n)} AS rolling_high_{n}, {when_full('min(low)', 'low', n)} AS rolling_low_{n}" for n in features.RANGE)
_feature_query("f9_ranges", [f"{k}_{n}" for n in features.RANGE for k in ("rolling_high", "rolling_low", "range_position")], f"WITH {PLACED}, g AS (SELECT *, {RANGES} FROM placed) SELECT symbol, bar_idx, {rs(*(x for n in features.RANGE for x in (f'rolling_high_{n}', f'rolling_low_{n}', f'CASE WHEN rolling_high_{n} > rolling_low_{n} THEN (close - rolling_low_{n}) / (rolling_high_{n} - rolling_low_{n}) END AS range_position_{n}')))} FROM g")
RET = f"WITH {PLACED}, q AS (SELECT *, ln(close / c1) AS lr, abs(close - c1) AS mv FROM placed)"
_feature_query("f10_realized_vol", [f"realized_vol_{n}" for n in features.TREND], f"{RET} SELECT symbol, bar_idx, {rs(*(when_full('stddev_pop(lr)', 'lr', n) + f' AS realized_vol_{n}' for n in features.TREND))} FROM q")
_feature_query("f11_regression_slope", [f"regression_slope_{n}" for n in features.TREND], f"{RET} SELECT symbol, bar_idx, {rs(*(when_full('regr_slope(close, bar_idx)', 'close', n) + f' AS regression_slope_{n}' for n in features.TREND))} FROM q")
_feature_query("f12_efficiency", [f"efficiency_ratio_{n}" for n in features.TREND], f"{RET}, p AS (SELECT *, {', '.join(when_full('sum(mv)', 'mv', n) + f' AS p{n}, lag(close, {n}) OVER ({SEG}) AS l{n}' for n in features.TREND)} FROM q) SELECT symbol, bar_idx, {rs(*(f'CASE WHEN p{n} = 0 THEN 0 ELSE abs(close - l{n}) / p{n} END AS efficiency_ratio_{n}' for n in features.TREND))} FROM p")


@query("f7_rolling_std", f"WITH {PLACED} SELECT symbol, bar_idx, {rs(when_full('stddev_pop(close)', 'close', 10) + ' AS std_10')} FROM placed")
def f7(spark, sf):
    from barspark.operators.frames import Frames, std

    w = Frames("symbol", "segment_id")
    return fx.segmented(spark, sf).select("symbol", "bar_idx", F.round(std("close", 10, w.own(10)), 6).alias("std_10"))


@query("f13_lagged_features", f"{BOLL}, l AS (SELECT *, lag(m) OVER ({SEG}) AS m1, lag(close / c1 - 1) OVER ({SEG}) AS r1, lag(high - low) OVER ({SEG}) AS g1 FROM b) SELECT symbol, bar_idx, {rs('r1 AS return_1_lag1', 'g1 AS range_lag1', 'm1 AS boll_mid_20_2_lag1')} FROM l")
def f13(spark, sf):
    return features.lagged_features(fx.segmented(spark, sf)).select("symbol", "bar_idx", *r("return_1_lag1", "range_lag1", "boll_mid_20_2_lag1"))


# Coarser bars: the fixture's bars are hourly, so four and twelve hours stand for five and fifteen minutes.

FOUR, TWELVE = 4 * 3600, 12 * 3600
RESAMPLED = f"""{BARS_SQL}, m5 AS (SELECT symbol, epoch_ms(bar_ts) // {FOUR * 1000} AS bucket, (epoch_ms(bar_ts) // {FOUR * 1000} + 1) * {FOUR} AS close_time, arg_min(open, bar_idx) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_idx) AS close, max(bar_idx) AS last_idx FROM bars GROUP BY ALL),
m15 AS (SELECT symbol, epoch_ms(bar_ts) // {TWELVE * 1000} AS bucket, (epoch_ms(bar_ts) // {TWELVE * 1000} + 1) * {TWELVE} AS htf_time, arg_max(close, bar_idx) AS htf_close FROM bars GROUP BY ALL)"""


@query("r1_resample", f"WITH {RESAMPLED} SELECT symbol, close_time, {rs('open', 'high', 'low', 'close')}, last_idx FROM m5")
def r1(spark, sf):
    return resample.resample(fx.bars(spark, sf), FOUR).select("symbol", "close_time", *r("open", "high", "low", "close"), "last_idx")


LENGTHS = {"fast_seconds": FOUR, "slow_seconds": TWELVE, "fast": 3, "slow": 7, "rsi": 5, "atr": 5, "trend": 8}
M5W = "PARTITION BY symbol ORDER BY bucket"
STATE = f"""{RESAMPLED}, s0 AS (SELECT *, row_number() OVER ({M5W}) - 1 AS place, lag(close) OVER ({M5W}) AS c1 FROM m5),
s1 AS (SELECT *, greatest(high, c1) - least(low, c1) AS tr_full, greatest(close - c1, 0) AS gain, greatest(c1 - close, 0) AS loss FROM s0),
s2 AS (SELECT *, CASE WHEN c1 IS NULL THEN NULL ELSE tr_full END AS tr, {seed_sql("gain", 5, 0.2, "place", "symbol", 1)} AS gi, {seed_sql("loss", 5, 0.2, "place", "symbol", 1)} AS li FROM s1),
s3 AS (SELECT *, {prefix_sum_sql("g", "gi", "place", 0.8, "symbol")}, {prefix_sum_sql("l", "li", "place", 0.8, "symbol")}, CASE WHEN count(tr) OVER ({M5W} ROWS 4 PRECEDING) = 5 THEN avg(tr) OVER ({M5W} ROWS 4 PRECEDING) END AS execution_atr,
  CASE WHEN count(close) OVER ({M5W} ROWS 2 PRECEDING) = 3 THEN avg(close) OVER ({M5W} ROWS 2 PRECEDING) END AS fast, CASE WHEN count(close) OVER ({M5W} ROWS 6 PRECEDING) = 7 THEN avg(close) OVER ({M5W} ROWS 6 PRECEDING) END AS slow FROM s2),
s4 AS (SELECT *, lag(fast) OVER ({M5W}) AS fast_before, lag(slow) OVER ({M5W}) AS slow_before, CASE WHEN place < 5 THEN NULL WHEN l = 0 THEN CASE WHEN g = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + g / l) END AS rsi FROM s3),
far AS (SELECT *, CASE WHEN count(htf_close) OVER ({M5W} ROWS 7 PRECEDING) = 8 THEN avg(htf_close) OVER ({M5W} ROWS 7 PRECEDING) END AS htf_sma FROM m15),
state AS (SELECT s4.*, far.htf_time, far.htf_close, far.htf_sma FROM s4 ASOF LEFT JOIN far ON s4.symbol = far.symbol AND s4.close_time >= far.htf_time)"""


@query("r2_simple_atr", f"WITH {STATE} SELECT symbol, bucket, {rs('execution_atr')} FROM state")
def r2(spark, sf):
    return resample.cross_state(fx.bars(spark, sf), **LENGTHS).select("symbol", "bucket", *r("execution_atr"))


@query("r3_htf_asof", f"WITH {STATE} SELECT symbol, bucket, htf_time, {rs('htf_close', 'htf_sma')} FROM state")
def r3(spark, sf):
    return resample.cross_state(fx.bars(spark, sf), **LENGTHS).select("symbol", "bucket", "htf_time", *r("htf_close", "htf_sma"))


CROSS = f"""{STATE}, nx AS (SELECT symbol, bar_idx AS last_idx, lead(bar_idx) OVER w AS entry_idx, lead(bar_ts) OVER w AS entry_ts, lead(open) OVER w AS entry_open, lead(spread) OVER w AS entry_spread, bar_ts AS signal_ts FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
sig AS (SELECT *, CASE WHEN execution_atr IS NULL THEN NULL WHEN fast_before <= slow_before AND fast > slow AND rsi < 70 AND htf_close > htf_sma THEN 1 WHEN fast_before >= slow_before AND fast < slow AND rsi > 30 AND htf_close < htf_sma THEN -1 END AS signal
  FROM state JOIN nx USING (symbol, last_idx) WHERE epoch_ms(entry_ts) // {FOUR * 1000} = bucket + 1)"""


@query("r4_cross_signal", f"WITH {CROSS} SELECT symbol, last_idx AS bar_idx, entry_idx, CAST(signal AS INTEGER) AS signal, {rs('rsi', 'execution_atr')} FROM sig WHERE signal IS NOT NULL")
def r4(spark, sf):
    return resample.cross_signal(fx.bars(spark, sf), **LENGTHS).select("symbol", "bar_idx", "entry_idx", "signal", *r("rsi", "execution_atr"))


@query("r5_export_signals", f"WITH {CROSS} SELECT symbol, last_idx AS bar_idx, epoch_ms(signal_ts) // 1000 AS signal_s, epoch_ms(entry_ts) // 1000 AS entry_s, {rs('entry_open', 'fast', 'slow')}, entry_spread, CAST(signal AS INTEGER) AS signal FROM sig WHERE signal IS NOT NULL AND entry_ts >= TIMESTAMP '2024-01-05' AND entry_ts < TIMESTAMP '2024-01-25'")
def r5(spark, sf):
    df = resample.export_signals(fx.bars(spark, sf), "2024-01-05", "2024-01-25", **LENGTHS)
    return df.select("symbol", "bar_idx", cal.epoch(F.col("signal_ts")).alias("signal_s"), cal.epoch(F.col("entry_ts")).alias("entry_s"), *r("entry_open", "fast", "slow"), "entry_spread", "signal")


# Wrappers of signals

BREAK = f"{MARKET_SQL}, s AS (SELECT *, CASE WHEN close > hi AND lo IS NOT NULL THEN 1 WHEN close < lo AND hi IS NOT NULL THEN -1 ELSE 0 END AS signal FROM (SELECT *, CASE WHEN count(high) OVER p = 20 THEN max(high) OVER p END AS hi, CASE WHEN count(low) OVER p = 20 THEN min(low) OVER p END AS lo FROM market WINDOW p AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)))"


def _breakouts(spark, sf):
    return signals.evaluate(fx.market(spark, sf), "nbar_breakout", {"lookback": 20})


@query("g11_expanding_quantile", f"WITH {BARS_SQL} SELECT symbol, bar_idx, round(quantile_cont(high - low, 0.35) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS q FROM bars")
def g11(spark, sf):
    from barspark.operators.frames import Frames

    df = fx.bars(spark, sf).withColumn("range", F.col("high") - F.col("low"))
    return signals.expanding_quantile(df, "range", 0.35, Frames("symbol"), "q").select("symbol", "bar_idx", *r("q"))


@query("g39_direction_filter", f"WITH {BREAK} SELECT symbol, bar_idx, mode, CAST(signal AS INTEGER) AS signal FROM s, (VALUES ('long'), ('short'), ('combined')) t(mode) WHERE (mode = 'combined' AND signal <> 0) OR (mode = 'long' AND signal > 0) OR (mode = 'short' AND signal < 0)")
def g39(spark, sf):
    modes = F.explode(F.array(*(F.lit(m) for m in ("long", "short", "combined"))))
    df = _breakouts(spark, sf).withColumn("mode", modes)
    return signals.direction_filter(df, F.col("mode")).filter("signal != 0").select("symbol", "bar_idx", "mode", "signal")


@query("g40_mask_entries", f"WITH {BREAK}, {SEGMENTED_SQL[len(BARS_SQL) + 1 :].lstrip()} SELECT symbol, bar_idx, CAST(signal AS INTEGER) AS signal FROM s JOIN segmented g USING (symbol, bar_idx) WHERE signal <> 0 AND g.entry_allowed")
def g40(spark, sf):
    df = _breakouts(spark, sf).join(fx.segmented(spark, sf).select("symbol", "bar_idx", "entry_allowed"), ["symbol", "bar_idx"])
    return signals.mask_entries(df).filter("signal != 0").select("symbol", "bar_idx", "signal")


@query("g41_mask_window", f"WITH {BREAK} SELECT symbol, bar_idx, CAST(signal AS INTEGER) AS signal FROM s WHERE signal <> 0 AND bar_ts >= TIMESTAMP '2024-01-08' AND bar_ts < TIMESTAMP '2024-01-20'")
def g41(spark, sf):
    return signals.mask_window(_breakouts(spark, sf), "2024-01-08", "2024-01-20").filter("signal != 0").select("symbol", "bar_idx", "signal")


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL
