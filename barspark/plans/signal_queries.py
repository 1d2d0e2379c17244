"""A query for each signal rule over the hourly market bars, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.operators import signals
from barspark.plans.fixtures import MARKET_SQL, market

W = "PARTITION BY symbol ORDER BY bar_idx"


def own(n: int) -> str:
    return f"({W} ROWS {n - 1} PRECEDING)"


def prior(n: int) -> str:
    return f"({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def full(f: str, x: str, n: int, frame: str) -> str:
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {f} OVER {frame} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def levels(n: int) -> str:
    return f"{full('max(high)', 'high', n, prior(n))} AS hi, {full('min(low)', 'low', n, prior(n))} AS lo"


def position(n: int) -> str:
    return f"{full('max(high)', 'high', n, own(n))} AS hi, {full('min(low)', 'low', n, own(n))} AS lo"


def mean_std(x: str, n: int, frame: str) -> str:
    return f"{full(f'avg({x})', x, n, frame)} AS m, {full(f'stddev_pop({x})', x, n, frame)} AS s"


MA = "atr > 0"
BODY = "sign(close - open)"
#: rule: (parameters, SQL steps each adding columns to the rows of the one before, condition for 1, condition for -1).
CASES: dict[str, tuple[dict, list[str], str, str]] = {
    "sma_slope": ({"lookback": 20, "slope_horizon": 3, "threshold_atr": 0.05}, [f"{full('avg(close)', 'close', 20, own(20))} AS m", f"m - {lag('m', 3)} AS d"], f"{MA} AND d > 0.05 * atr", f"{MA} AND d < -0.05 * atr"),
    "ema_slope": ({"lookback": 15, "slope_horizon": 2, "threshold_atr": 0.1}, [full("list(close)", "close", 15, own(15)) + " AS xs", f"list_reduce(xs, lambda a, x: {2 / 16!r} * x + {1 - 2 / 16!r} * a) AS m", f"m - {lag('m', 2)} AS d"], f"{MA} AND d > 0.1 * atr", f"{MA} AND d < -0.1 * atr"),
    "regression_slope": ({"lookback": 30, "threshold_atr": 0.01}, [full("regr_slope(close, bar_idx)", "close", 30, own(30)) + " AS d"], f"{MA} AND d > 0.01 * atr", f"{MA} AND d < -0.01 * atr"),
    "roc_momentum": ({"lookback": 10, "threshold_pct": 1.5}, [f"(close / nullif({lag('close', 10)}, 0) - 1) * 100 AS d"], "d > 1.5", "d < -1.5"),
    "efficiency_trend": ({"lookback": 10, "er_threshold": 0.15}, [f"abs(close - {lag('close')}) AS mv, close - {lag('close', 10)} AS net", full("sum(mv)", "mv", 10, own(10)) + " AS path"], "path > 0 AND abs(net) / path >= 0.15 AND net > 0", "path > 0 AND abs(net) / path >= 0.15 AND net < 0"),
    "nbar_breakout": ({"lookback": 20}, [levels(20)], "close > hi AND lo IS NOT NULL", "close < lo AND hi IS NOT NULL"),
    "nbar_failed_breakout": ({"lookback": 10}, [levels(10)], "NOT (high > hi AND close < hi) AND low < lo AND close > lo", "high > hi AND close < hi"),
    "range_expansion": ({"median_lookback": 20, "range_multiple": 1.2}, [f"CASE WHEN bar_idx = 0 THEN high - low ELSE greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END AS t", full("quantile_cont(t, 0.5)", "t", 20, prior(20)) + " AS q"], f"q > 0 AND t / q >= 1.2 AND {BODY} > 0", f"q > 0 AND t / q >= 1.2 AND {BODY} < 0"),
    "bollinger_expansion": ({"lookback": 20, "std_multiplier": 1.0, "bandwidth_percentile": 0.5}, [mean_std("close", 20, own(20)), "CASE WHEN m <> 0 THEN 2 * s / abs(m) END AS width", full("quantile_cont(width, 0.5)", "width", 20, prior(20)) + " AS q"], "width >= q AND close > m + s", "width >= q AND close < m - s"),
    "compression_breakout": ({"compression_lookback": 10, "compression_percentile": 0.4, "breakout_lookback": 5}, ["high - low AS r", f"quantile_cont(r, 0.4) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q, {full('avg(r)', 'r', 10, prior(10))} AS m, {levels(5)}"], "m <= q AND close > hi AND lo IS NOT NULL", "m <= q AND close < lo AND hi IS NOT NULL"),
    "zscore_reversion": ({"lookback": 30, "z_threshold": 1.5}, [mean_std("close", 30, own(30))], "s > 0 AND (close - m) / s <= -1.5", "s > 0 AND (close - m) / s >= 1.5"),
    "bollinger_reversion": ({"lookback": 20, "std_multiplier": 2.0}, [mean_std("close", 20, own(20))], "s > 0 AND close <= m - 2 * s", "s > 0 AND close >= m + 2 * s"),
    "rsi_extreme": ({"lookback": 10, "lower": 40.0}, [f"close - {lag('close')} AS d", f"{full('sum(greatest(d, 0))', 'd', 10, own(10))} AS up, {full('sum(greatest(-d, 0))', 'd', 10, own(10))} AS dn", "CASE WHEN up = 0 AND dn = 0 THEN NULL WHEN dn = 0 THEN 100 WHEN up = 0 THEN 0 ELSE 100 - 100 / (1 + up / dn) END AS rsi"], "rsi <= 40", "rsi >= 60"),
    "stochastic_extreme": ({"lookback": 14, "lower": 20.0}, [position(14)], "hi > lo AND 100 * (close - lo) / (hi - lo) <= 20", "hi > lo AND 100 * (close - lo) / (hi - lo) >= 80"),
    "cci_extreme": ({"lookback": 20, "threshold": 100.0}, ["(high + low + close) / 3 AS t", f"{full('avg(t)', 't', 20, own(20))} AS m, list(t) OVER {own(20)} AS ts", "list_sum(list_transform(ts, lambda x: abs(x - m))) / 20 AS dv"], "dv > 0 AND (t - m) / (0.015 * dv) <= -100", "dv > 0 AND (t - m) / (0.015 * dv) >= 100"),
    "williams_r_extreme": ({"lookback": 14, "edge_band": 15.0}, [position(14)], "hi > lo AND -100 * (hi - close) / (hi - lo) <= -85", "hi > lo AND -100 * (hi - close) / (hi - lo) >= -15"),
    "engulfing": ({"min_body_atr": 0.2}, [f"{lag('open')} AS po, {lag('close')} AS pc"], f"{MA} AND abs(close - open) >= 0.2 * atr AND pc < po AND close > open AND open <= pc AND close >= po", f"{MA} AND abs(close - open) >= 0.2 * atr AND pc > po AND close < open AND open >= pc AND close <= po"),
    "rejection_candle": ({"wick_body_ratio": 2.0}, ["abs(close - open) AS b, high - greatest(open, close) AS u, least(open, close) - low AS l"], "b > 0 AND l >= 2 * b AND l > u AND close > open", "b > 0 AND u >= 2 * b AND u > l AND close < open"),
    "inside_bar_break": ({"buffer_atr": 0.05}, [f"{lag('high', 2)} AS h2, {lag('low', 2)} AS l2, {lag('high')} AS h1, {lag('low')} AS l1"], f"{MA} AND h1 <= h2 AND l1 >= l2 AND close > h2 + 0.05 * atr", f"{MA} AND h1 <= h2 AND l1 >= l2 AND close < l2 - 0.05 * atr"),
    "outside_bar": ({"min_range_atr": 0.5}, [f"{lag('high')} AS h1, {lag('low')} AS l1"], f"{MA} AND high > h1 AND low < l1 AND high - low >= 0.5 * atr AND close > open", f"{MA} AND high > h1 AND low < l1 AND high - low >= 0.5 * atr AND close < open"),
    "level_sweep_reclaim": ({"lookback": 10}, [levels(10)], "low < lo AND close > lo", "NOT (low < lo AND close > lo) AND high > hi AND close < hi"),
    "session_open_momentum": ({"session": "london", "threshold_atr": 0.1}, [f"session_london AND NOT coalesce({lag('session_london')}, false) AS f"], f"f AND {MA} AND close - open > 0.1 * atr", f"f AND {MA} AND close - open < -0.1 * atr"),
    "prior_session_high_low_break": ({"session": "asia"}, [f"session_asia AND NOT coalesce({lag('session_asia')}, false) AS st", f"sum(CASE WHEN st THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run", "max(CASE WHEN session_asia THEN high END) OVER (PARTITION BY symbol, run) AS rh, min(CASE WHEN session_asia THEN low END) OVER (PARTITION BY symbol, run) AS rl", "max_by(rh, run) OVER (PARTITION BY symbol ORDER BY run RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi, max_by(rl, run) OVER (PARTITION BY symbol ORDER BY run RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo"], "session_asia AND close > hi", "session_asia AND close < lo"),
    "opening_range_breakout": ({"session": "new_york", "opening_bars": 3}, [f"session_new_york AND NOT coalesce({lag('session_new_york')}, false) AS st", f"sum(CASE WHEN st THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run", "row_number() OVER (PARTITION BY symbol, run ORDER BY bar_idx) AS nth", "max(CASE WHEN session_new_york AND nth <= 3 THEN high END) OVER (PARTITION BY symbol, run) AS hi, min(CASE WHEN session_new_york AND nth <= 3 THEN low END) OVER (PARTITION BY symbol, run) AS lo"], "session_new_york AND nth > 3 AND close > hi", "session_new_york AND nth > 3 AND close < lo"),
    "atr_percentile_regime": ({"lookback": 30, "percentile": 0.7}, [full("quantile_cont(atr, 0.7)", "atr", 30, prior(30)) + " AS q"], f"atr >= q AND {BODY} > 0", f"atr >= q AND {BODY} < 0"),
    "volatility_expansion_direction": ({"lookback": 20, "range_multiple": 1.2}, ["high - low AS r", full("quantile_cont(r, 0.5)", "r", 20, prior(20)) + " AS q"], f"q > 0 AND r >= 1.2 * q AND {BODY} > 0", f"q > 0 AND r >= 1.2 * q AND {BODY} < 0"),
    "volatility_contraction_reversion": ({"lookback": 20, "percentile": 0.3}, ["high - low AS r", full("quantile_cont(r, 0.3)", "r", 20, prior(20)) + " AS q"], f"r <= q AND {BODY} < 0", f"r <= q AND {BODY} > 0"),
    "return_continuation": ({"lookback": 5, "threshold_pct": 1.0}, [f"(close / nullif({lag('close', 5)}, 0) - 1) * 100 AS d"], "d > 1", "d < -1"),
    "return_reversal": ({"lookback": 5, "threshold_pct": 1.0}, [f"(close / nullif({lag('close', 5)}, 0) - 1) * 100 AS d"], "d < -1", "d > 1"),
    "rolling_autocorr_direction": ({"lookback": 20, "min_abs_autocorr": 0.2}, [f"close / nullif({lag('close')}, 0) - 1 AS r", f"{lag('r')} AS r1", f"CASE WHEN count(r1) OVER {own(19)} = 19 THEN corr(r1, r) OVER {own(19)} END AS k", "sign(r) * CASE WHEN k < 0 THEN -1 ELSE 1 END AS way"], "abs(k) >= 0.2 AND way > 0", "abs(k) >= 0.2 AND way < 0"),
    "range_position_reversal": ({"lookback": 20, "edge_fraction": 0.1}, [position(20)], "hi > lo AND (close - lo) / (hi - lo) <= 0.1", "hi > lo AND (close - lo) / (hi - lo) >= 1 - 0.1"),
    "standardized_return_signal": ({"lookback": 20, "z_threshold": 1.0}, [f"close / nullif({lag('close')}, 0) - 1 AS r", mean_std("r", 20, prior(20))], "s > 0 AND (r - m) / s >= 1", "s > 0 AND (r - m) / s <= -1"),
    "trend_pullback_recovery": ({"trend_lookback": 20, "trend_threshold_atr": 0.1, "pullback_lookback": 3, "pullback_threshold_atr": 0.05}, [f"{lag('atr')} AS a1, {lag('close')} AS c1, {lag('close', 2)} AS c2, {lag('close')} - {lag('close', 21)} AS t, {lag('close')} - {lag('close', 4)} AS k"], "a1 > 0 AND t >= 0.1 * a1 AND k <= -0.05 * a1 AND c1 < c2 AND close > c1", "a1 > 0 AND t <= -0.1 * a1 AND k >= 0.05 * a1 AND c1 > c2 AND close < c1"),
    "trend_pullback_recovery_v2": ({"trend_lookback": 20, "trend_threshold_atr": 0.1, "pullback_lookback": 3, "pullback_threshold_atr": 0.05, "recovery_threshold_atr": 0.1}, [
        f"{lag('atr')} AS a1, {lag('close')} AS c1, {lag('close', 2)} AS c2, {lag('close')} - {lag('close', 21)} AS t, {lag('close')} - {lag('close', 4)} AS k",
        "coalesce(a1 > 0 AND t >= 0.1 * a1 AND k <= -0.05 * a1, false) AS fu, coalesce(a1 > 0 AND t <= -0.1 * a1 AND k >= 0.05 * a1, false) AS fd",
        f"CASE WHEN fu AND NOT coalesce({lag('fu')}, false) THEN 1 ELSE 0 END AS su, CASE WHEN fd AND NOT coalesce({lag('fd')}, false) THEN 1 ELSE 0 END AS sd, fu AND c1 < c2 AND close - c1 >= 0.1 * a1 AS hu, fd AND c1 > c2 AND c1 - close >= 0.1 * a1 AS hd",
        f"sum(su) OVER ({W} ROWS UNBOUNDED PRECEDING) AS eu, sum(sd) OVER ({W} ROWS UNBOUNDED PRECEDING) AS ed",
        "min(CASE WHEN hu THEN bar_idx END) OVER (PARTITION BY symbol, eu) AS xu, min(CASE WHEN hd THEN bar_idx END) OVER (PARTITION BY symbol, ed) AS xd",
    ], "xu = bar_idx", "xd = bar_idx"),
}

#: Parameters of the rules of the last families, whose SQL is not a chain of windows.
RETEST = {"compression_lookback": 10, "compression_atr_ratio": 3.2, "breakout_buffer_atr": 0.0, "breakout_body_atr": 0.05, "retest_window_bars": 8, "retest_tolerance_atr": 0.4, "confirmation_atr": 0.0}
MORE: dict[str, tuple[str, dict]] = {
    "compression_breakout_retest": ("compression_breakout_retest", RETEST),
    "compression_breakout_retest_v2": ("compression_breakout_retest_v2", RETEST | {"compression_atr_ratio": 1.0}),
    "prior_session_sweep_reclaim_asia": ("prior_session_sweep_reclaim", {"transition": "asia_to_london", "entry_window_bars": 8, "sweep_atr": 0.0, "max_reclaim_bars": 4, "reclaim_depth_atr": 0.0}),
    "prior_session_sweep_reclaim_london": ("prior_session_sweep_reclaim", {"transition": "london_pre_ny_to_new_york", "entry_window_bars": 8, "sweep_atr": 0.0, "max_reclaim_bars": 4, "reclaim_depth_atr": 0.0}),
}


def chain(start: str, steps: list[str]) -> tuple[str, str]:
    """(common table expressions, name of the last) that add the columns of each step."""
    parts, name = [], start
    for i, step in enumerate(steps):
        parts.append(f"step_{i} AS (SELECT *, {step} FROM {name})")
        name = f"step_{i}"
    return "".join(",\n" + x for x in parts), name


def signal_sql(name: str) -> str:
    _, steps, up, down = CASES[name]
    ctes, last = chain("market", steps)
    return f"WITH {MARKET_SQL}{ctes}\nSELECT symbol, bar_idx, signal FROM (SELECT symbol, bar_idx, CAST(CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END AS INTEGER) AS signal FROM {last}) WHERE signal <> 0"


def retest_sql(p: dict, per_root: bool) -> str:
    """Bar by bar, as a recursion over all series at once: phase 0 waits for quiet, 1 for a break, 2 for a return and its confirmation."""
    n, scale = p["compression_lookback"], p["compression_lookback"] ** 0.5 if per_root else 1.0
    tol, conf, buffer, body = (f"{p[k]}::DOUBLE * {{}}" for k in ("retest_tolerance_atr", "confirmation_atr", "breakout_buffer_atr", "breakout_body_atr"))
    return f"""WITH RECURSIVE {MARKET_SQL}, b0 AS (SELECT symbol, bar_idx AS i, open AS o, high AS h, low AS l, close AS c, lag(atr) OVER (PARTITION BY symbol ORDER BY bar_idx) AS a1,
  CASE WHEN bar_idx >= {n} THEN max(high) OVER p END AS hi, CASE WHEN bar_idx >= {n} THEN min(low) OVER p END AS lo FROM market WINDOW p AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)),
b AS MATERIALIZED (SELECT *, coalesce(a1 > 0 AND (hi - lo) / (a1 * {scale}) <= {p["compression_atr_ratio"]}, false) AS quiet FROM b0),
s AS (SELECT symbol, CAST(-1 AS BIGINT) AS i, 0 AS phase, true AS fresh, CAST(0 AS BIGINT) AS since, 0 AS way, 0::DOUBLE AS level, 0::DOUBLE AS top, 0::DOUBLE AS bottom, 0::DOUBLE AS a, false AS touched, 0 AS sig FROM (SELECT DISTINCT symbol FROM b)
UNION ALL SELECT symbol, i, CASE WHEN phase = 2 THEN CASE WHEN ended OR hit THEN 0 ELSE 2 END WHEN brk <> 0 THEN 2 WHEN arm AND quiet THEN 1 ELSE 0 END,
  CASE WHEN phase = 2 THEN NOT (ended OR hit) AND fresh WHEN brk <> 0 THEN fresh WHEN quiet THEN fresh ELSE true END,
  CASE WHEN phase < 2 AND brk <> 0 THEN i ELSE since END, CASE WHEN phase < 2 AND brk <> 0 THEN brk ELSE way END, CASE WHEN phase < 2 AND brk <> 0 THEN CASE WHEN brk > 0 THEN top2 ELSE bottom2 END ELSE level END,
  top2, bottom2, CASE WHEN phase = 2 THEN a ELSE a2 END, phase = 2 AND touched2, CASE WHEN phase = 2 AND hit AND NOT ended THEN way ELSE 0 END
FROM (SELECT *, CASE WHEN NOT arm THEN 0 WHEN c > top2 + {buffer.format("a2")} AND c > o AND abs(c - o) >= {body.format("a2")} THEN 1 WHEN c < bottom2 - {buffer.format("a2")} AND c < o AND abs(c - o) >= {body.format("a2")} THEN -1 ELSE 0 END AS brk,
    touched2 AND CASE WHEN way > 0 THEN c >= level + {conf.format("a")} AND c > o ELSE c <= level - {conf.format("a")} AND c < o END AS hit
  FROM (SELECT s.symbol, b.i, o, h, l, c, quiet, phase, fresh, since, way, level, a, phase = 1 OR (phase = 0 AND quiet AND fresh) AS arm, CASE WHEN phase = 1 THEN top ELSE hi END AS top2, CASE WHEN phase = 1 THEN bottom ELSE lo END AS bottom2,
      CASE WHEN phase = 1 THEN a ELSE a1 END AS a2, b.i - since > {p["retest_window_bars"]} OR CASE WHEN way > 0 THEN c < level - {tol.format("a")} ELSE c > level + {tol.format("a")} END AS ended,
      touched OR CASE WHEN way > 0 THEN l <= level + {tol.format("a")} ELSE h >= level - {tol.format("a")} END AS touched2 FROM s JOIN b ON b.symbol = s.symbol AND b.i = s.i + 1)))
SELECT symbol, i AS bar_idx, sig AS signal FROM s WHERE sig <> 0"""


def sweep_sql(p: dict) -> str:
    """Each start of a target session with its reference range, and the first bars at which something happens."""
    asia = p["transition"] == "asia_to_london"
    source, target = ("session_asia", "session_london") if asia else ("session_london", "session_new_york")
    refs = (
        "ends AS (SELECT symbol, i AS e FROM r WHERE was_s AND NOT s), near AS (SELECT st.symbol, st.i, st.t_run, max(e) AS e FROM st JOIN ends ON ends.symbol = st.symbol AND e <= st.i GROUP BY ALL), ref AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY symbol, e ORDER BY i) = 1)"
        if asia
        else "ref AS (SELECT symbol, i, t_run, i AS e FROM st WHERE was_s)"
    )
    sweep, depth = f"{p['sweep_atr']}::DOUBLE * a", f"{p['reclaim_depth_atr']}::DOUBLE * a"
    return f"""WITH {MARKET_SQL}, m AS (SELECT symbol, bar_idx AS i, open AS o, high AS h, low AS l, close AS c, atr, {source} AS s, {target} AS t, coalesce(lag({source}) OVER w, false) AS was_s, coalesce(lag({target}) OVER w, false) AS was_t FROM market WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
r AS (SELECT *, sum(CASE WHEN s AND NOT was_s THEN 1 ELSE 0 END) OVER w AS s_run, sum(CASE WHEN t AND NOT was_t THEN 1 ELSE 0 END) OVER w AS t_run FROM m WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)),
st AS (SELECT * FROM r WHERE t AND NOT was_t), {refs},
ranged AS (SELECT ref.symbol, ref.i AS start, ref.t_run, max(x.h) AS top, min(x.l) AS bottom FROM ref JOIN r last ON last.symbol = ref.symbol AND last.i = ref.e - 1 JOIN r x ON x.symbol = ref.symbol AND x.s AND x.s_run = last.s_run AND x.i < ref.e GROUP BY ALL),
armed AS (SELECT ranged.*, (SELECT max_by(atr, i) FROM r WHERE r.symbol = ranged.symbol AND r.i < start AND atr > 0) AS a FROM ranged WHERE top > bottom),
seen AS (SELECT armed.*, r.i, r.o, r.c, r.h > top + {sweep} AS up, r.l < bottom - {sweep} AS down FROM armed JOIN r ON r.symbol = armed.symbol AND r.t AND r.t_run = armed.t_run AND r.i < start + {p["entry_window_bars"]} WHERE a IS NOT NULL),
swept AS (SELECT *, min(i) FILTER (up) OVER g AS fu, min(i) FILTER (down) OVER g AS fd FROM seen WINDOW g AS (PARTITION BY symbol, start)),
told AS (SELECT *, fu IS NOT NULL AND (fd IS NULL OR fu < fd) AS high_first, least(fu, fd) AS since FROM swept WHERE fu IS DISTINCT FROM fd),
hits AS (SELECT symbol, start, high_first, min(i) FILTER (i > since AND CASE WHEN high_first THEN down ELSE up END) AS other,
  min(i) FILTER (i BETWEEN since AND since + {p["max_reclaim_bars"]} AND CASE WHEN high_first THEN c < top - {depth} AND c < o ELSE c > bottom + {depth} AND c > o END) AS back FROM told GROUP BY ALL)
SELECT symbol, back AS bar_idx, CASE WHEN high_first THEN -1 ELSE 1 END AS signal FROM hits WHERE back IS NOT NULL AND (other IS NULL OR back < other)"""


def _query(name: str, params: dict):
    def run(spark, sf_dir):
        return signals.evaluate(market(spark, sf_dir), name, params).filter("signal != 0").select("symbol", "bar_idx", "signal")

    return run


def queries() -> dict:
    out = {f"sig_{name}": _query(name, params) for name, (params, *_) in CASES.items()}
    return out | {f"sig_{label}": _query(name, params) for label, (name, params) in MORE.items()}


def oracle_sql() -> dict[str, str]:
    more = {label: sweep_sql(p) if "transition" in p else retest_sql(p, name.endswith("v2")) for label, (name, p) in MORE.items()}
    return {f"sig_{name}": signal_sql(name) for name in CASES} | {f"sig_{label}": sql for label, sql in more.items()}


def flagship(spark, sf_dir):
    """Breakout signals by symbol."""
    s = signals.evaluate(market(spark, sf_dir), "nbar_breakout", {"lookback": 20})
    return s.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.count_if(F.col("signal") > 0).alias("n_long"), F.count_if(F.col("signal") < 0).alias("n_short"))


FLAGSHIP_SQL = f"WITH {MARKET_SQL}, s AS (SELECT symbol, close, {levels(20)} FROM market) SELECT symbol, count(*) AS n_bars, count(*) FILTER (close > hi) AS n_long, count(*) FILTER (close < lo) AS n_short FROM s GROUP BY symbol"
