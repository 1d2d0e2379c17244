"""Queries on trades and their metrics, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.functions import prices
from barspark.functions.store import checkpointed
from barspark.operators import metrics, signals, trades
from barspark.plans import fixtures as fx
from barspark.plans.bar_queries import BREAK, r, rs
from barspark.plans.fixtures import BARS_SQL, TRADES_SQL

#: experiment_id, stop_atr, target_r, time_exit_minutes, atr_trail
SETTINGS = [("E1", 0.5, 1.0, None, None), ("E2", 1.0, None, 600.0, None), ("E3", 0.75, None, None, 1.0), ("E4", 0.5, 2.0, 1440.0, None), ("E5", 2.0, 0.5, None, None)]
COSTS = {"commission": 6.0, "slippage": 5.0, "preferred_risk": 2.0, "hard_risk": 1.8, "max_lot": 0.1}
SCHEMA = "experiment_id string, stop_atr double, target_r double, time_exit_minutes double, atr_trail double"


def settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SETTINGS, SCHEMA).select("*", *(F.lit(v).alias(k) for k, v in COSTS.items()))


def breakouts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(market, signals of every experiment)"""
    market = checkpointed(fx.market(spark, sf_dir))  # every step of the trades reads it
    s = signals.evaluate(market, "nbar_breakout", {"lookback": 20}).filter("signal != 0").select("symbol", "bar_idx", "signal")
    return market, s.crossJoin(F.broadcast(settings(spark).select("experiment_id")))


def price(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN floor(({x}) * 100 + 0.5 + 1e-9) ELSE ceil(({x}) * 100 - 0.5 - 1e-9) END / 100"


VALUES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in SETTINGS)
CANDS = f"""{BREAK}, settings AS (SELECT *, 6.0::DOUBLE AS commission, 5.0::DOUBLE AS slippage, 2.0::DOUBLE AS preferred_risk, 1.8::DOUBLE AS hard_risk, 0.1::DOUBLE AS max_lot FROM (SELECT a AS experiment_id, b::DOUBLE AS stop_atr, c::DOUBLE AS target_r, d::DOUBLE AS time_exit_minutes, e::DOUBLE AS atr_trail FROM (VALUES {VALUES}) v(a, b, c, d, e))),
nxt AS (SELECT symbol, bar_idx AS signal_idx, CAST(signal AS INTEGER) AS direction, atr, close AS signal_price, bar_ts AS signal_ts, lead(bar_idx) OVER w AS entry_idx, lead(open) OVER w AS raw_entry, lead(spread) OVER w AS entry_spread, lead(bar_ts) OVER w AS entry_ts FROM s WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
c0 AS (SELECT *, {price("CASE WHEN direction = 1 THEN raw_entry + entry_spread * 0.01 + slippage * 0.01 ELSE raw_entry - slippage * 0.01 END")} AS entry_price FROM nxt, settings WHERE direction <> 0 AND entry_idx IS NOT NULL AND atr > 0),
c1 AS (SELECT *, {price("(entry_price - direction * stop_atr * atr)")} AS stop_price FROM c0),
c2 AS (SELECT *, {price("(entry_price + direction * target_r * abs(entry_price - stop_price))")} AS target_raw, abs(entry_price - stop_price) AS per_lot FROM c1),
c3 AS (SELECT *, CASE WHEN target_r IS NULL THEN NULL ELSE target_raw END AS target_price, round(floor(least(preferred_risk / per_lot, max_lot) / 0.01 + 1e-12) * 0.01, 10) AS wanted FROM c2),
c4 AS (SELECT *, CASE WHEN preferred_risk / per_lot < 0.01 THEN 0.01 ELSE greatest(wanted, 0.01) END AS lot_0 FROM c3),
cands AS (SELECT *, CASE WHEN per_lot > 0 AND per_lot * lot_0 <= hard_risk + 1e-12 THEN lot_0 END AS lot, CASE WHEN per_lot > 0 AND per_lot * lot_0 <= hard_risk + 1e-12 THEN per_lot * lot_0 END AS planned_risk FROM c4)"""
OUTCOMES = f"""{CANDS}, last AS (SELECT symbol, max(bar_idx) AS last_idx FROM bars GROUP BY symbol),
p0 AS (SELECT c.*, b.bar_idx AS i, b.bar_ts AS t, b.open AS o, b.high AS h, b.low AS l, b.close AS cl, b.spread AS exit_spread, last_idx,
  CASE WHEN b.atr > 0 THEN {price("(b.close - c.direction * c.atr_trail * b.atr)")} END AS moved_0 FROM cands c JOIN market b ON b.symbol = c.symbol AND b.bar_idx >= c.entry_idx JOIN last ON last.symbol = c.symbol),
p0m AS (SELECT *, CASE WHEN atr_trail IS NOT NULL THEN moved_0 END AS moved FROM p0),
p1 AS (SELECT *, CASE WHEN direction = 1 THEN greatest(stop_price, max(moved) OVER w) ELSE least(stop_price, min(moved) OVER w) END AS stop_now FROM p0m WINDOW w AS (PARTITION BY experiment_id, symbol, entry_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p2 AS (SELECT *, CASE WHEN direction = 1 THEN l <= stop_now ELSE h + exit_spread * 0.01 >= stop_now END AS hs, coalesce(CASE WHEN direction = 1 THEN h >= target_price ELSE l + exit_spread * 0.01 <= target_price END, false) AS ht,
  coalesce(i > entry_idx AND (epoch_ms(t) - epoch_ms(entry_ts)) / 60000.0 >= time_exit_minutes, false) AS late FROM p1),
p3 AS (SELECT *, CASE WHEN hs AND ht THEN 'stop_same_bar_ambiguous' WHEN hs AND abs(stop_now - stop_price) > 1e-12 THEN 'trail' WHEN hs THEN 'stop' WHEN ht THEN 'target' WHEN late THEN 'time' WHEN i = last_idx THEN 'end_of_data' END AS exit_reason,
  CASE WHEN hs THEN CASE WHEN direction = 1 THEN least(stop_now, o) ELSE greatest(stop_now - exit_spread * 0.01, o) END WHEN ht THEN CASE WHEN direction = 1 THEN target_price ELSE target_price - exit_spread * 0.01 END ELSE cl END AS raw_exit FROM p2),
outcomes AS (SELECT * EXCLUDE (o, h, l, cl, moved, moved_0), i AS exit_idx, t AS exit_ts FROM p3 WHERE exit_reason IS NOT NULL AND lot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY experiment_id, symbol, entry_idx ORDER BY i) = 1)"""
CHOSEN = OUTCOMES.replace("bars AS (", "bars AS MATERIALIZED (", 1).replace(", outcomes AS (", ", outcomes AS MATERIALIZED (").replace("\noutcomes AS (", "\noutcomes AS MATERIALIZED (") + """,
walk AS (SELECT experiment_id, symbol, min(entry_idx) AS entry_idx FROM outcomes GROUP BY ALL
  UNION ALL SELECT x.experiment_id, x.symbol, (SELECT min(n.entry_idx) FROM outcomes n WHERE n.experiment_id = x.experiment_id AND n.symbol = x.symbol AND n.entry_idx > x.exit_idx)
  FROM walk k JOIN outcomes x USING (experiment_id, symbol, entry_idx)),
chosen AS (SELECT o.* FROM outcomes o JOIN walk USING (experiment_id, symbol, entry_idx))"""
ECON = CHOSEN + f""",
e0 AS (SELECT *, direction * (raw_exit - raw_entry) * lot AS gross_pnl, CASE WHEN direction = 1 THEN entry_spread ELSE exit_spread END * 0.01 * lot AS spread_cost, 2 * slippage * 0.01 * lot AS slippage_cost, commission * lot AS commission_cost, (epoch_ms(exit_ts) - epoch_ms(entry_ts)) / 60000.0 AS hold_minutes,
  {price("CASE WHEN direction = 1 THEN raw_exit - slippage * 0.01 ELSE raw_exit + exit_spread * 0.01 + slippage * 0.01 END")} AS exit_price FROM chosen),
econ AS (SELECT *, gross_pnl - spread_cost - slippage_cost - commission_cost AS net_pnl, (gross_pnl - spread_cost - slippage_cost - commission_cost) / planned_risk AS pnl_r, strftime(entry_ts, '%Y-%m-%d') AS broker_date, row_number() OVER (PARTITION BY experiment_id ORDER BY entry_idx, symbol) AS trade_seq FROM e0)"""

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


ID = ["experiment_id", "symbol", "entry_idx"]


@query("t1_round_price", f"WITH {BARS_SQL} SELECT symbol, bar_idx, round({price('(close * 1.005 - 100)')}, 6) AS price FROM bars")
def t1(spark, sf):
    return fx.bars(spark, sf).select("symbol", "bar_idx", F.round(prices.round_price(F.col("close") * 1.005 - 100), 6).alias("price"))


@query("t2_fill_prices", f"WITH {BARS_SQL} SELECT symbol, bar_idx, {rs(price('(open + spread * 0.01 + 0.05)') + ' AS buy', price('(open - 0.05)') + ' AS sell', price('(close - 0.05)') + ' AS sell_out', price('(close + spread * 0.01 + 0.05)') + ' AS buy_back')} FROM bars")
def t2(spark, sf):
    b, slip = fx.bars(spark, sf), F.lit(5.0)
    up, down = F.lit(1), F.lit(-1)
    o, c, s = F.col("open"), F.col("close"), F.col("spread")
    return b.select("symbol", "bar_idx", *(F.round(x, 6).alias(n) for n, x in (("buy", prices.entry_price(o, s, up, slip)), ("sell", prices.entry_price(o, s, down, slip)), ("sell_out", prices.exit_price(c, s, up, slip)), ("buy_back", prices.exit_price(c, s, down, slip)))))


def _cands(spark, sf):
    market, s = breakouts(spark, sf)
    return trades.candidates(s, market, settings(spark)), market


@query("t3_bracket_levels", f"WITH {CANDS} SELECT experiment_id, symbol, entry_idx, direction, {rs('entry_price', 'stop_price', 'target_price')} FROM cands")
def t3(spark, sf):
    return _cands(spark, sf)[0].select(*ID, "direction", *r("entry_price", "stop_price", "target_price"))


@query("t4_lot_sizes", f"WITH {CANDS} SELECT experiment_id, symbol, entry_idx, {rs('lot', 'planned_risk')} FROM cands")
def t4(spark, sf):
    return _cands(spark, sf)[0].select(*ID, *r("lot", "planned_risk"))


def _outcomes(spark, sf):
    cands, market = _cands(spark, sf)
    able = checkpointed(cands.filter("lot is not null"))
    return able.join(trades.outcomes(able, market), ID)


@query("t5_first_barrier", f"WITH {OUTCOMES} SELECT experiment_id, symbol, entry_idx, exit_idx, exit_reason, {rs('raw_exit')} FROM outcomes WHERE atr_trail IS NULL")
def t5(spark, sf):
    return _outcomes(spark, sf).filter("atr_trail is null").select(*ID, "exit_idx", "exit_reason", *r("raw_exit"))


@query("t6_trailing_stop", f"WITH {OUTCOMES} SELECT experiment_id, symbol, entry_idx, exit_idx, exit_reason, {rs('raw_exit')} FROM outcomes WHERE atr_trail IS NOT NULL")
def t6(spark, sf):
    return _outcomes(spark, sf).filter("atr_trail is not null").select(*ID, "exit_idx", "exit_reason", *r("raw_exit"))


@query("t7_non_overlapping", f"WITH RECURSIVE {CHOSEN} SELECT experiment_id, symbol, entry_idx, exit_idx FROM chosen")
def t7(spark, sf):
    cands, market = _cands(spark, sf)
    return trades.choose_trades(cands, market).select(*ID, "exit_idx")


@query("t7_risk_skips", f"WITH RECURSIVE {CHOSEN}, k AS (SELECT experiment_id, symbol, entry_idx FROM cands WHERE lot IS NULL) SELECT experiment_id, count(*) AS risk_skip_count FROM k WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.experiment_id = k.experiment_id AND c.symbol = k.symbol AND k.entry_idx BETWEEN c.entry_idx AND c.exit_idx) GROUP BY 1")
def t7s(spark, sf):
    cands, market = _cands(spark, sf)
    return trades.risk_skips(cands, trades.choose_trades(cands, market))


def _trades(spark, sf):
    market, s = breakouts(spark, sf)
    return trades.signals_to_trades(s, market, settings(spark))


ECON_COLUMNS = ("gross_pnl", "spread_cost", "slippage_cost", "commission_cost", "net_pnl", "pnl_r", "exit_price", "hold_minutes")


@query("t8_trade_economics", f"WITH RECURSIVE {ECON} SELECT experiment_id, symbol, entry_idx, {rs(*ECON_COLUMNS)} FROM econ")
def t8(spark, sf):
    return _trades(spark, sf).select(*ID, *r(*ECON_COLUMNS))


@query("t9_annotated_trades", f"WITH RECURSIVE {ECON} SELECT e.experiment_id, e.symbol, e.entry_idx, e.trade_seq, e.broker_date, m.session_asia, m.session_london, m.session_new_york, m.session_overlap FROM econ e JOIN market m ON m.symbol = e.symbol AND m.bar_idx = e.entry_idx")
def t9(spark, sf):
    return _trades(spark, sf).select(*ID, F.col("trade_seq").cast("long").alias("trade_seq"), "broker_date", *trades.FLAGS)


@query("t10_signals_to_trades", f"WITH RECURSIVE {ECON} SELECT experiment_id, exit_reason, count(*) AS n, {rs('sum(net_pnl) AS net_pnl', 'sum(gross_pnl) AS gross_pnl')} FROM econ GROUP BY 1, 2")
def t10(spark, sf):
    return _trades(spark, sf).groupBy("experiment_id", "exit_reason").agg(F.count("*").alias("n"), F.round(F.sum("net_pnl"), 6).alias("net_pnl"), F.round(F.sum("gross_pnl"), 6).alias("gross_pnl"))


@query("s11_export_trades", f"WITH RECURSIVE {ECON} SELECT experiment_id, trade_seq, strftime(timezone('EET', timezone('UTC', entry_ts)), '%Y-%m-%dT%H:%M:%S') AS entry_time, strftime(timezone('EET', timezone('UTC', exit_ts)), '%Y-%m-%dT%H:%M:%S') AS exit_time, exit_reason, {rs('net_pnl')} FROM econ")
def s11(spark, sf):
    return trades.export_trades(_trades(spark, sf)).select("experiment_id", F.col("trade_seq").cast("long").alias("trade_seq"), "entry_time", "exit_time", "exit_reason", *r("net_pnl"))


# Metrics, over the order lines as trades

K = ["experiment_id"]
PF = "sum(CASE WHEN net_pnl > 0 {w} THEN net_pnl ELSE 0 END) / nullif(abs(sum(CASE WHEN net_pnl < 0 {w} THEN net_pnl ELSE 0 END)), 0)"


def pf(when: str = "") -> str:
    return PF.format(w=f"AND {when}" if when else "")


def lines(spark, sf) -> DataFrame:
    return fx.trades(spark, sf).withColumnRenamed("commission", "commission_cost")


def _metric(name: str, columns: list[str], sql: str, part=metrics.totals):
    @query(name, sql)
    def run(spark, sf):
        df = part(lines(spark, sf), K)
        kinds = dict(df.dtypes)
        return df.select(*K, *(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in columns))


T = f"WITH {TRADES_SQL}"
_metric("m1_counts", ["completed_trades", "wins", "losses", "win_rate", "gross_profit", "gross_loss", "net_profit", "expectancy_usd"], f"{T} SELECT experiment_id, count(*) AS completed_trades, count(*) FILTER (net_pnl > 0) AS wins, count(*) FILTER (net_pnl < 0) AS losses, {rs('count(*) FILTER (net_pnl > 0) / count(*) AS win_rate', 'sum(CASE WHEN net_pnl > 0 THEN net_pnl ELSE 0 END) AS gross_profit', 'sum(CASE WHEN net_pnl < 0 THEN net_pnl ELSE 0 END) AS gross_loss', 'sum(net_pnl) AS net_profit', 'avg(net_pnl) AS expectancy_usd')} FROM trades GROUP BY 1")
_metric("m2_profit_factor", ["profit_factor"], f"{T} SELECT experiment_id, {rs(pf() + ' AS profit_factor')} FROM trades GROUP BY 1")
STREAK = "streak AS (SELECT experiment_id, max(n) AS max_loss_streak FROM (SELECT experiment_id, run, count(*) FILTER (net_pnl < 0) AS n FROM (SELECT *, count(*) FILTER (net_pnl >= 0) OVER (PARTITION BY experiment_id ORDER BY trade_seq ROWS UNBOUNDED PRECEDING) AS run FROM trades) GROUP BY 1, 2) GROUP BY 1)"
_metric("m3_loss_streak", ["max_loss_streak"], f"{T}, {STREAK} SELECT * FROM streak", metrics.loss_streaks)
DD = """dd AS (SELECT experiment_id, max(greatest(5000, peak) - eq) AS max_drawdown_usd, max((greatest(5000, peak) - eq) / greatest(5000, peak) * 100) AS max_drawdown_pct FROM (SELECT *, max(eq) OVER (PARTITION BY experiment_id ORDER BY trade_seq ROWS UNBOUNDED PRECEDING) AS peak FROM
  (SELECT *, 5000 + sum(net_pnl) OVER (PARTITION BY experiment_id ORDER BY trade_seq ROWS UNBOUNDED PRECEDING) AS eq FROM trades)) GROUP BY 1)"""
_metric("m4_drawdown", ["max_drawdown_usd", "max_drawdown_pct"], f"{T}, {DD} SELECT experiment_id, {rs('max_drawdown_usd', 'max_drawdown_pct')} FROM dd", metrics.drawdowns)
_metric("m5_expectancy_r", ["expectancy_r"], f"{T} SELECT experiment_id, {rs('avg(pnl_r) AS expectancy_r')} FROM trades GROUP BY 1")
ROLL = """days AS (SELECT experiment_id, broker_date, sum(net_pnl) AS d, count(*) AS n FROM trades GROUP BY 1, 2), months AS (SELECT experiment_id, left(broker_date, 7) AS mo, sum(d) AS m FROM days GROUP BY 1, 2), years AS (SELECT experiment_id, left(mo, 4) AS yr, sum(m) AS y FROM months GROUP BY 1, 2),
roll AS (SELECT * FROM (SELECT experiment_id, count(*) AS active_days, median(d) AS median_profit_per_active_day, sum(d) / count(*) AS profit_per_active_day, sum(n) / count(*) AS trades_per_active_day, count(*) FILTER (d > 0) / count(*) AS positive_day_fraction FROM days GROUP BY 1)
  JOIN (SELECT experiment_id, count(*) AS active_months, min(m) AS worst_month, max(m) AS best_month, count(*) FILTER (m > 0) / count(*) AS positive_month_fraction FROM months GROUP BY 1) USING (experiment_id) JOIN (SELECT experiment_id, count(*) FILTER (y > 0) / count(*) AS positive_year_fraction FROM years GROUP BY 1) USING (experiment_id))"""
ROLLED = ["median_profit_per_active_day", "profit_per_active_day", "worst_month", "positive_month_fraction", "positive_year_fraction"]
_metric("m6_calendar_rollup", ["active_days", "active_months", *ROLLED], f"{T}, {ROLL} SELECT experiment_id, active_days, active_months, {rs(*ROLLED)} FROM roll", metrics.calendar_rollup)
_metric("m7_sides", ["long_pf", "short_pf", "long_trades", "short_trades"], f"{T} SELECT experiment_id, {rs(pf('direction = 1') + ' AS long_pf', pf('direction = -1') + ' AS short_pf')}, count(*) FILTER (direction = 1) AS long_trades, count(*) FILTER (direction = -1) AS short_trades FROM trades GROUP BY 1")
_metric("m8_median_hold", ["median_hold_minutes"], f"{T} SELECT experiment_id, {rs('median(hold_minutes) AS median_hold_minutes')} FROM trades GROUP BY 1")
TOP = "top AS (SELECT experiment_id, sum(net_pnl) FILTER (k <= 5) / sum(net_pnl) AS top_5_trade_profit_fraction FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY net_pnl DESC) AS k FROM trades WHERE net_pnl > 0) GROUP BY 1)"
_metric("m9_concentration", ["top_5_trade_profit_fraction"], f"{T}, {TOP} SELECT experiment_id, {rs('top_5_trade_profit_fraction')} FROM top", metrics.concentration)
_metric("m10_costs", ["net_profit", "commission_cost", "spread_cost", "slippage_cost"], f"{T} SELECT experiment_id, {rs('sum(net_pnl) AS net_profit', 'sum(commission) AS commission_cost', 'sum(spread_cost) AS spread_cost', 'sum(slippage_cost) AS slippage_cost')} FROM trades GROUP BY 1")
SUMMARY = f"""{TRADES_SQL}, {STREAK}, {DD}, {ROLL}, {TOP}, tot AS (SELECT experiment_id, count(*) AS completed_trades, sum(CASE WHEN net_pnl > 0 THEN net_pnl ELSE 0 END) AS gross_profit, sum(net_pnl) AS net_profit, avg(net_pnl) AS expectancy_usd, avg(pnl_r) AS expectancy_r,
  {pf()} AS profit_factor, {pf('direction = 1')} AS long_pf, {pf('direction = -1')} AS short_pf, count(*) FILTER (direction = 1) AS long_trades, count(*) FILTER (direction = -1) AS short_trades FROM trades GROUP BY 1),
summary AS (SELECT *, CASE WHEN gross_profit > 0 THEN greatest(0, best_month) / gross_profit END AS best_month_profit_fraction FROM tot LEFT JOIN streak USING (experiment_id) LEFT JOIN dd USING (experiment_id) LEFT JOIN roll USING (experiment_id) LEFT JOIN top USING (experiment_id))"""
ALL = ["profit_factor", "net_profit", "expectancy_usd", "expectancy_r", "max_drawdown_pct", "worst_month", "positive_year_fraction", "top_5_trade_profit_fraction", "best_month_profit_fraction", "median_profit_per_active_day"]
_metric("m11_summarize", ["completed_trades", "max_loss_streak", "active_months", *ALL], f"WITH {SUMMARY} SELECT experiment_id, completed_trades, max_loss_streak, active_months, {rs(*ALL)} FROM summary", metrics.summarize)
_metric("m12_positive_days", ["positive_day_fraction"], f"{T}, {ROLL} SELECT experiment_id, {rs('positive_day_fraction')} FROM roll", metrics.positive_day_fraction)


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return SQL
