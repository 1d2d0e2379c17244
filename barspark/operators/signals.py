"""Signal rules: bars (symbol, bar_idx, open, high, low, close, atr, session flags) to 1, -1 or 0 for each bar.

A rule is a function of bars, its parameters and the frames of its series; it adds the column signal. ``RULES`` names them with the
domains of their parameters; ``register`` adds a user's rule. Missing inputs anywhere in a rule's window give 0. atr is that of the bar before (see ``with_lagged_atr``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.store import checkpointed
from barspark.operators.blocks import Block, Find, earlier_near, frame_rows, shifted
from barspark.operators.frames import Frames, GivenFrames, full, highest, known, lowest, mean, side, sliding, slope, std, with_quantile
from barspark.operators.scan import asof, non_overlapping, with_runs

Domain = tuple
BuildRule = Callable[[DataFrame, dict, Frames], DataFrame]


@dataclass(frozen=True)
class Many:
    """How a rule is evaluated for many experiments at once (see ``evaluate_table``).

    prepare adds columns that depend on no parameter; a rule with a session gets the bars once for each session (_session). find gives the frames (names) of a block of bars for one set of the parameters over; it reads the numeric columns inputs
    and looks back over reach bars. uses are the columns that the rest of the rule reads. A rule that is keyed follows a path of its own for each experiment.
    """

    uses: tuple[str, ...] = ()
    over: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    find: Find | None = None
    inputs: tuple[str, ...] = ("close",)
    reach: Callable[[dict], int] = lambda p: 0
    prepare: Callable[[DataFrame, Frames], DataFrame] | None = None
    keyed: bool = False
    #: The column of an expanding quantile, and the parameter that is its share.
    expanding: tuple[str, str] | None = None
    #: In place of all that: hits (experiment_id, keys, bar_idx, signal) from bars, experiments, their values as columns, and keys.
    direct: Callable[[DataFrame, DataFrame, dict, list[str]], DataFrame] | None = None


@dataclass(frozen=True)
class Rule:
    family: str
    build: BuildRule
    domain: dict[str, Domain]
    many: Many | None = None


RULES: dict[str, Rule] = {}


def register(name: str, family: str, domain: dict[str, Domain], build: BuildRule, many: Many | None = None) -> None:
    """Add a rule. Without many, a table of experiments has a plan for each set of its whole-number and text parameters."""
    if name in RULES:
        raise ValueError(f"there is a rule {name!r} already")
    RULES[name] = Rule(family, build, domain, many)


def rule(name: str, family: str, many: Many | None = None, **domain: Domain):
    def add(build: BuildRule) -> BuildRule:
        register(name, family, domain, build, many)
        return build

    return add


def c(name: str) -> Column:
    return F.col(name)


def _signal(df: DataFrame, up: Column, down: Column, when: Column | None = None) -> DataFrame:
    value = side(up, down)
    return df.withColumn("signal", value if when is None else F.when(when, value).otherwise(0))


def _atr_known() -> Column:
    return F.coalesce(c("atr") > 0, F.lit(False))


def _body() -> Column:
    return F.signum(c("close") - c("open")).cast("int")


# Trend


def _rise(average: Callable[[Block, str, int], np.ndarray]) -> Many:
    """An average of closes and its rise over slope_horizon bars."""

    def find(b: Block, p: dict) -> dict[str, np.ndarray]:
        value = average(b, "close", p["lookback"])
        return {"_rise": value - shifted(value, p["slope_horizon"])}

    return Many(uses=("atr",), over=("lookback", "slope_horizon"), names=("_rise",), find=find, reach=lambda p: p["lookback"] + p["slope_horizon"])


@rule("sma_slope", "trend_momentum", many=_rise(Block.mean), lookback=(5, 100), slope_horizon=(1, 10), threshold_atr=(0.0, 0.5))
def sma_slope(df, p, w):
    def frames(df):
        df = df.withColumn("_m", mean("close", p["lookback"], w.own(p["lookback"])))
        return df.withColumn("_rise", c("_m") - w.lag("_m", p["slope_horizon"]))

    df = w.framed(df, frames)
    least = p.get("threshold_atr", 0.0) * c("atr")
    return _signal(df, c("_rise") > least, c("_rise") < -least, _atr_known())


@rule("ema_slope", "trend_momentum", many=_rise(Block.anew), lookback=(5, 100), slope_horizon=(1, 10), threshold_atr=(0.0, 0.5))
def ema_slope(df, p, w):
    """The average starts anew at the first close of each window."""

    def frames(df):
        n = p["lookback"]
        alpha = 2.0 / (n + 1)

        def folded(windows: np.ndarray) -> np.ndarray:
            out = windows[:, 0]
            for k in range(1, n):
                out = alpha * windows[:, k] + (1 - alpha) * out
            return out

        df = sliding(df, "close", n, w, "_m", folded, own=True)
        return df.withColumn("_rise", c("_m") - w.lag("_m", p["slope_horizon"]))

    df = w.framed(df, frames)
    least = p.get("threshold_atr", 0.0) * c("atr")
    return _signal(df, c("_rise") > least, c("_rise") < -least, _atr_known())


def _one_length(names: tuple[str, ...], find: Callable[[Block, int], tuple[np.ndarray, ...]], uses: tuple[str, ...] = (), over: str = "lookback", inputs: tuple[str, ...] = ("close",), prepare=None) -> Many:
    """Frames of one length, the parameter over."""
    return Many(uses, (over,), names, lambda b, p: dict(zip(names, find(b, p[over]))), inputs, lambda p: p[over] + 1, prepare)


@rule("regression_slope", "trend_momentum", many=_one_length(("_s",), lambda b, n: (b.slope("close", n),), ("atr",)), lookback=(5, 120), threshold_atr=(0.0, 0.2))
def regression_slope(df, p, w):
    df = w.framed(df, lambda df: df.withColumn("_s", slope("close", p["lookback"], w.own(p["lookback"]))))
    least = p.get("threshold_atr", 0.0) * c("atr")
    return _signal(df, c("_s") > least, c("_s") < -least, _atr_known())


_LAGGED = _one_length(("_before",), lambda b, n: (b.lag("close", n),), ("close",))


def _change_pct() -> Column:
    return (c("close") / F.nullif("_before", F.lit(0.0)) - 1) * 100


@rule("roc_momentum", "trend_momentum", many=_LAGGED, lookback=(2, 60), threshold_pct=(0.0, 1.5))
def roc_momentum(df, p, w):
    df = w.framed(df, lambda df: df.withColumn("_before", w.lag("close", p["lookback"])))
    least = p.get("threshold_pct", 0.0)
    return _signal(df, _change_pct() > least, _change_pct() < -least)


def _with_move(df, w):
    return df.withColumn("_move", F.abs(c("close") - w.lag("close")))


@rule(
    "efficiency_trend", "trend_momentum", lookback=(5, 80), er_threshold=(0.1, 0.8),
    many=_one_length(("_path", "_net"), lambda b, n: (b.total("_move", n), b.columns["close"] - b.lag("close", n)), inputs=("close", "_move"), prepare=_with_move),
)
def efficiency_trend(df, p, w):
    def frames(df):
        n = p["lookback"]
        return _with_move(df, w).withColumns({"_path": full(F.sum("_move").over(w.own(n)), "_move", n, w.own(n)), "_net": c("close") - w.lag("close", n)})

    df = w.framed(df, frames)
    strong = (c("_path") > 0) & (F.abs("_net") / c("_path") >= p["er_threshold"])
    return _signal(df, strong & (c("_net") > 0), strong & (c("_net") < 0))


# Breakout


def _prior_levels(df: DataFrame, n: int, w: Frames) -> DataFrame:
    return df.withColumns({"_hi": highest("high", n, w.prior(n)), "_lo": lowest("low", n, w.prior(n))})


def _levels_before(b: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    return b.extreme("high", n, True, prior=True), b.extreme("low", n, False, prior=True)


def _prior(*uses: str) -> Many:
    return _one_length(("_hi", "_lo"), _levels_before, uses, inputs=("high", "low"))


@rule("nbar_breakout", "breakout", many=_prior("close"), lookback=(2, 100))
def nbar_breakout(df, p, w):
    df = w.framed(df, lambda df: _prior_levels(df, p["lookback"], w))
    return _signal(df, c("close") > c("_hi"), c("close") < c("_lo"), known("_hi", "_lo", "close"))


@rule("nbar_failed_breakout", "breakout", many=_prior("high", "low", "close"), lookback=(2, 100))
def nbar_failed_breakout(df, p, w):
    """Where both sides are pierced, the short side counts."""
    df = w.framed(df, lambda df: _prior_levels(df, p["lookback"], w))
    back_down, back_up = (c("high") > c("_hi")) & (c("close") < c("_hi")), (c("low") < c("_lo")) & (c("close") > c("_lo"))
    return _signal(df, back_up & ~back_down, back_down, known("_hi", "_lo", "high", "low", "close"))


def true_range(w: Frames) -> Column:
    before = w.lag("close")
    spread = c("high") - c("low")
    return F.when(c("bar_idx") == 0, spread).when(before.isNotNull(), F.greatest(spread, F.abs(c("high") - before), F.abs(c("low") - before)))


def _with_true_range(df, w):
    return df.withColumn("_tr", true_range(w))


def _with_range(df, w):
    return df.withColumn("_range", c("high") - c("low"))


@rule(
    "range_expansion", "breakout", median_lookback=(5, 100), range_multiple=(1.1, 3.0),
    many=_one_length(("_mid",), lambda b, n: (b.quantile("_tr", n, 0.5),), ("_tr", "open", "close"), "median_lookback", ("_tr",), _with_true_range),
)
def range_expansion(df, p, w):
    df = w.framed(df, lambda df: with_quantile(_with_true_range(df, w), "_tr", 0.5, p["median_lookback"], w, "_mid"))
    wide = (c("_mid") > 0) & (c("_tr") / c("_mid") >= p["range_multiple"])
    return _signal(df, wide & (_body() > 0), wide & (_body() < 0))


def _bands(b: Block, p: dict) -> dict[str, np.ndarray]:
    n, k = p["lookback"], p["std_multiplier"]
    m, s = b.mean("close", n), b.std("close", n)
    with np.errstate(divide="ignore", invalid="ignore"):
        width = np.where(m != 0, 2 * k * s / np.abs(m), np.nan)
    return {"_m": m, "_s": s, "_width": width, "_q": b.quantile("_width", n, p["bandwidth_percentile"], width)}


@rule(
    "bollinger_expansion", "breakout", lookback=(10, 80), std_multiplier=(1.0, 3.0), bandwidth_percentile=(0.5, 0.95),
    many=Many(("close",), ("lookback", "std_multiplier", "bandwidth_percentile"), ("_m", "_s", "_width", "_q"), _bands, reach=lambda p: 2 * p["lookback"]),
)
def bollinger_expansion(df, p, w):
    k = p["std_multiplier"]

    def frames(df):
        n = p["lookback"]
        df = df.withColumns({"_m": mean("close", n, w.own(n)), "_s": std("close", n, w.own(n))})
        df = df.withColumn("_width", F.when(c("_m") != 0, 2 * k * c("_s") / F.abs("_m")))
        return with_quantile(df, "_width", p["bandwidth_percentile"], n, w, "_q")

    df = w.framed(df, frames)
    wide = c("_width") >= c("_q")
    return _signal(df, wide & (c("close") > c("_m") + k * c("_s")), wide & (c("close") < c("_m") - k * c("_s")))


#: Expanding quantiles of series up to this long use the expanding frame, whose cost is quadratic.
EXPANDING_LIMIT = 5_000
_RANK_BLOCK = 1024


def expanding_quantile(df: DataFrame, value: str, q: float, w: Frames, name: str) -> DataFrame:
    """df with the exact quantile (linear between ranks) of all values before the bar; null at the first bar and for good after a missing value."""
    most = df.groupBy(*w.keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    whole = F.count(value).over(w.before()) == F.count(F.lit(1)).over(w.before())
    if most <= EXPANDING_LIMIT:
        return df.withColumn(name, F.when(whole, F.percentile(value, F.lit(float(q))).over(w.before())))
    return _blocked_quantile(df, value, q, w, name, whole)


def _blocked_quantile(df: DataFrame, value: str, q: float, w: Frames, name: str, whole: Column) -> DataFrame:
    """The series is cut into blocks of bars and, by rank, into buckets of values. Counts of the buckets before each block say which few buckets hold the ranks
    that the bars of the block can ask for (a block adds no more values than it has bars); only their values go to the block's bars."""
    keys, size = list(w.keys), _RANK_BLOCK
    block = F.floor(c("bar_idx") / size)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_v", "bar_idx")) - 1
    cut = df.select(*keys, "bar_idx", block.alias("_b"), c(value).alias("_v")).filter("_v is not null").withColumn("_k", F.floor(rank / size))
    counts = cut.groupBy(*keys, "_k", "_b").agg(F.count("*").alias("_n"))
    blocks = df.select(*keys, block.alias("_b")).distinct()
    grid = blocks.join(counts.select(*keys, "_k").distinct(), keys).join(counts, [*keys, "_k", "_b"], "left")
    by_bucket = Window.partitionBy(*keys, "_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_e", F.coalesce(F.sum("_n").over(by_bucket), F.lit(0)))
    by_block = Window.partitionBy(*keys, "_b").orderBy("_k")
    grid = grid.withColumns({"_skip": F.sum("_e").over(by_block) - c("_e"), "_before": F.sum("_e").over(Window.partitionBy(*keys, "_b"))})
    low, high = (c("_before") - 1) * q - size - 1, (c("_before") + size) * q + 2
    asked = grid.filter((c("_e") > 0) & (c("_skip") <= high) & (c("_skip") + c("_e") > low))
    earlier = asked.join(cut.select(*keys, "_k", c("_b").alias("_b0"), "_v"), [*keys, "_k"]).filter(c("_b0") < c("_b"))
    near = earlier.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list("_v")).alias("_near"), F.min("_skip").alias("_skip"), F.first("_before").alias("_before"))
    own = F.collect_list(value).over(Window.partitionBy(*keys, "_b").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_whole", whole).withColumn("_b", block).withColumn("_own", own).join(near, [*keys, "_b"], "left")
    rows = rows.withColumn("_pool", F.array_sort(F.concat(F.coalesce("_near", F.array().cast("array<double>")), "_own")))
    total = F.coalesce("_before", F.lit(0)) + F.size("_own")
    at = (total - 1) * q - F.coalesce("_skip", F.lit(0))
    lo = F.floor(at).cast("int")
    between = F.get("_pool", lo) + (F.coalesce(F.get("_pool", lo + 1), F.get("_pool", lo)) - F.get("_pool", lo)) * (at - lo)
    return rows.withColumn(name, F.when(c("_whole") & (total > 0), between)).drop("_b", "_own", "_near", "_skip", "_before", "_pool", "_whole")


def _with_whole_range(df, w):
    """The range, and 1 where no range before is missing."""
    missing = F.max(c("_range").isNull()).over(w.before())
    return _with_range(df, w).withColumn("_whole", F.when(F.coalesce(missing, F.lit(False)), 0).otherwise(1))


def _compression(b: Block, p: dict) -> dict[str, np.ndarray]:
    hi, lo = _levels_before(b, p["breakout_lookback"])
    return {"_hi": hi, "_lo": lo, "_m": b.mean("_range", p["compression_lookback"], prior=True), "_q": b.expanding("_range", p["compression_percentile"], "_whole")}


@rule(
    "compression_breakout", "breakout", compression_lookback=(5, 80), compression_percentile=(0.05, 0.4), breakout_lookback=(2, 50),
    many=Many(
        ("close",), ("compression_lookback", "compression_percentile", "breakout_lookback"), ("_hi", "_lo", "_m", "_q"), _compression, ("high", "low", "_range", "_whole"),
        lambda p: max(p["compression_lookback"], p["breakout_lookback"]) + 1, _with_whole_range, expanding=("_range", "compression_percentile"),
    ),
)
def compression_breakout(df, p, w):
    def frames(df):
        n = p["compression_lookback"]
        df = expanding_quantile(_with_range(df, w), "_range", p["compression_percentile"], w, "_q")
        return _prior_levels(df, p["breakout_lookback"], w).withColumn("_m", mean("_range", n, w.prior(n)))

    df = w.framed(df, frames)
    quiet = c("_m") <= c("_q")
    return _signal(df, quiet & (c("close") > c("_hi")), quiet & (c("close") < c("_lo")), known("_hi", "_lo"))


# Mean reversion


def _mean_std(name: str, uses: tuple[str, ...], prior: bool = False, prepare=None) -> Many:
    return _one_length(("_m", "_s"), lambda b, n: (b.mean(name, n, prior), b.std(name, n, prior)), uses, inputs=(name,), prepare=prepare)


def _with_mean_std(df, n, w):
    return df.withColumns({"_m": mean("close", n, w.own(n)), "_s": std("close", n, w.own(n))})


@rule("zscore_reversion", "mean_reversion", many=_mean_std("close", ("close",)), lookback=(10, 200), z_threshold=(1.0, 3.5))
def zscore_reversion(df, p, w):
    k = p["z_threshold"]
    df = w.framed(df, lambda df: _with_mean_std(df, p["lookback"], w))
    z = F.when(c("_s") > 0, (c("close") - c("_m")) / c("_s"))
    return _signal(df, z <= -k, z >= k)


@rule("bollinger_reversion", "mean_reversion", many=_mean_std("close", ("close",)), lookback=(10, 100), std_multiplier=(1.0, 3.5))
def bollinger_reversion(df, p, w):
    k = p["std_multiplier"]
    df = w.framed(df, lambda df: _with_mean_std(df, p["lookback"], w))
    return _signal(df, c("close") <= c("_m") - k * c("_s"), c("close") >= c("_m") + k * c("_s"), c("_s") > 0)


def _with_up_down(df, w):
    """Rises and falls of the close; null where either close is."""
    move = c("close") - w.lag("close")
    return df.withColumns({"_up": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), "_down": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0)))})


@rule(
    "rsi_extreme", "mean_reversion", lookback=(5, 40), lower=(10.0, 40.0),
    many=_one_length(("_rise", "_fall"), lambda b, n: (b.total("_up", n), b.total("_down", n)), inputs=("_up", "_down"), prepare=_with_up_down),
)
def rsi_extreme(df, p, w):
    """Relative strength from simple sums of rises and falls."""
    lower = p["lower"]

    def frames(df):
        n = p["lookback"]
        df = _with_up_down(df, w)
        return df.withColumns({"_rise": full(F.sum("_up").over(w.own(n)), "_up", n, w.own(n)), "_fall": full(F.sum("_down").over(w.own(n)), "_down", n, w.own(n))})

    df = w.framed(df, frames)
    rsi = F.when((c("_rise") == 0) & (c("_fall") == 0), None).when(c("_fall") == 0, 100.0).when(c("_rise") == 0, 0.0).otherwise(100 - 100 / (1 + c("_rise") / c("_fall")))
    return _signal(df, rsi <= lower, rsi >= 100 - lower)


_OWN_LEVELS = _one_length(("_hi", "_lo"), lambda b, n: (b.extreme("high", n, True), b.extreme("low", n, False)), ("close",), inputs=("high", "low"))


def _position(df: DataFrame, p: dict, w: Frames) -> DataFrame:
    def frames(df):
        n = p["lookback"]
        return df.withColumns({"_hi": highest("high", n, w.own(n)), "_lo": lowest("low", n, w.own(n))})

    df = w.framed(df, frames)
    return df.withColumn("_pos", F.when(c("_hi") > c("_lo"), (c("close") - c("_lo")) / (c("_hi") - c("_lo"))))


@rule("stochastic_extreme", "mean_reversion", many=_OWN_LEVELS, lookback=(5, 60), lower=(5.0, 35.0))
def stochastic_extreme(df, p, w):
    df = _position(df, p, w)
    k = 100 * (c("close") - c("_lo")) / (c("_hi") - c("_lo"))
    return _signal(df, k <= p["lower"], k >= 100 - p["lower"], c("_pos").isNotNull())


def _with_typical(df, w):
    return df.withColumn("_t", (c("high") + c("low") + c("close")) / 3)


def _mean_deviation(b: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    m = b.mean("_t", n)
    return m, b.deviation("_t", n, m)


@rule("cci_extreme", "mean_reversion", many=_one_length(("_m", "_dev"), _mean_deviation, ("_t",), inputs=("_t",), prepare=_with_typical), lookback=(5, 60), threshold=(50.0, 250.0))
def cci_extreme(df, p, w):
    k = p["threshold"]

    def frames(df):
        n = p["lookback"]
        df = _with_typical(df, w)
        df = df.withColumn("_m", mean("_t", n, w.own(n)))

        def deviation(windows: np.ndarray, middle: np.ndarray) -> np.ndarray:
            out = np.zeros(len(windows))
            for k in range(n):
                out = out + np.abs(windows[:, k] - middle)
            return out / n

        return sliding(df, "_t", n, w, "_dev", deviation, own=True, beside=("_m",))

    df = w.framed(df, frames)
    cci = F.when(c("_dev") > 0, (c("_t") - c("_m")) / (0.015 * c("_dev")))
    return _signal(df, cci <= -k, cci >= k)


@rule("williams_r_extreme", "mean_reversion", many=_OWN_LEVELS, lookback=(5, 60), edge_band=(5.0, 35.0))
def williams_r_extreme(df, p, w):
    df = _position(df, p, w)
    r = -100 * (c("_hi") - c("close")) / (c("_hi") - c("_lo"))
    return _signal(df, r <= -100 + p["edge_band"], r >= -p["edge_band"], c("_pos").isNotNull())


# Price action


def _with_last(*names: str, back: int = 1):
    """Adds the values of the bars before: _open1, _open2, ..."""

    def add(df, w):
        return df.withColumns({f"_{n}{k}": w.lag(n, k) for n in names for k in range(1, back + 1)})

    return add


@rule("engulfing", "price_action", many=Many(("open", "close", "atr", "_open1", "_close1"), prepare=_with_last("open", "close")), min_body_atr=(0.0, 1.5))
def engulfing(df, p, w):
    df = w.framed(df, lambda df: _with_last("open", "close")(df, w))
    po, pc = c("_open1"), c("_close1")
    big = F.abs(c("close") - c("open")) >= p.get("min_body_atr", 0.0) * c("atr")
    up = (pc < po) & (c("close") > c("open")) & (c("open") <= pc) & (c("close") >= po)
    down = (pc > po) & (c("close") < c("open")) & (c("open") >= pc) & (c("close") <= po)
    return _signal(df, big & up, big & down, _atr_known())


@rule("rejection_candle", "price_action", many=Many(("open", "high", "low", "close")), wick_body_ratio=(1.5, 5.0))
def rejection_candle(df, p, w):
    body = F.abs(c("close") - c("open"))
    upper, lower = c("high") - F.greatest("open", "close"), F.least("open", "close") - c("low")
    k = p["wick_body_ratio"]
    up = (lower >= k * body) & (lower > upper) & (c("close") > c("open"))
    down = (upper >= k * body) & (upper > lower) & (c("close") < c("open"))
    return _signal(df, up, down, known("high", "low") & (body > 0))


@rule("inside_bar_break", "price_action", many=Many(("close", "atr", "_high1", "_high2", "_low1", "_low2"), prepare=_with_last("high", "low", back=2)), buffer_atr=(0.0, 0.5))
def inside_bar_break(df, p, w):
    df = w.framed(df, lambda df: _with_last("high", "low", back=2)(df, w))
    hi, lo = c("_high2"), c("_low2")
    inside = (c("_high1") <= hi) & (c("_low1") >= lo)
    room = p.get("buffer_atr", 0.0) * c("atr")
    return _signal(df, inside & (c("close") > hi + room), inside & (c("close") < lo - room), _atr_known())


@rule("outside_bar", "price_action", many=Many(("open", "high", "low", "close", "atr", "_high1", "_low1"), prepare=_with_last("high", "low")), min_range_atr=(0.0, 2.0))
def outside_bar(df, p, w):
    df = w.framed(df, lambda df: _with_last("high", "low")(df, w))
    out = (c("high") > c("_high1")) & (c("low") < c("_low1")) & (c("high") - c("low") >= p.get("min_range_atr", 0.0) * c("atr"))
    return _signal(df, out & (_body() > 0), out & (_body() < 0), _atr_known())


@rule("level_sweep_reclaim", "price_action", many=_prior("high", "low", "close"), lookback=(2, 100))
def level_sweep_reclaim(df, p, w):
    """Where both sides are pierced, the long side counts."""
    df = w.framed(df, lambda df: _prior_levels(df, p["lookback"], w))
    up, down = (c("low") < c("_lo")) & (c("close") > c("_lo")), (c("high") > c("_hi")) & (c("close") < c("_hi"))
    return _signal(df, up, down, known("_hi", "_lo", "high", "low", "close"))


# Sessions

_SESSION = ("asia", "london", "new_york", "overlap")


def session_occurrences(df: DataFrame, flag: str, keys: list[str]) -> DataFrame:
    """df with run_id (number of the session run) and in_session."""
    df = df.withColumn("in_session", F.coalesce(c(flag), F.lit(False)))
    return with_runs(df, "in_session", keys, "bar_idx")


def _each_session(df: DataFrame) -> DataFrame:
    """The bars once for each session, with its name (_session) and flag (_flag)."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("name"), c(f"session_{s}").alias("flag")) for s in _SESSION if f"session_{s}" in df.columns)))
    return df.withColumn("_each", each).withColumns({"_session": c("_each.name"), "_flag": c("_each.flag")}).drop("_each")


def _in_sessions(add: Callable[[DataFrame, str, list[str]], DataFrame], *uses: str) -> Many:
    """add gives what a rule reads of one session's flag, in series of its own."""
    return Many((*uses, "_session"), prepare=lambda df, w: add(_each_session(df), "_flag", [*w.keys, "_session"]))


def _with_first(df: DataFrame, flag: str, keys: list[str]) -> DataFrame:
    return df.withColumn("_first", c(flag) & ~F.coalesce(Frames(*keys).lag(flag), F.lit(False)))


@rule("session_open_momentum", "session", many=_in_sessions(_with_first, "open", "close", "atr", "_first"), session=_SESSION, threshold_atr=(0.0, 1.0))
def session_open_momentum(df, p, w):
    df = w.framed(df, lambda df: _with_first(df, f"session_{p['session']}", list(w.keys)))
    move, least = c("close") - c("open"), p.get("threshold_atr", 0.0) * c("atr")
    return _signal(df, c("_first") & (move > least), c("_first") & (move < -least), _atr_known())


def _with_prior_range(df: DataFrame, flag: str, keys: list[str]) -> DataFrame:
    """df with in_session and _range, high and low of the last session before."""
    df = session_occurrences(df, flag, keys)
    both = known("high", "low") & c("in_session")
    runs = df.filter(c("run_id") > 0).groupBy(*keys, "run_id").agg(F.max(F.when(both, c("high"))).alias("_hi"), F.min(F.when(both, c("low"))).alias("_lo"))
    before = Window.partitionBy(*keys).orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(c("_hi").isNotNull(), F.struct("_hi", "_lo")), ignorenulls=True).over(before)
    return df.join(runs.select(*keys, "run_id", last.alias("_range")), [*keys, "run_id"], "left")


@rule("prior_session_high_low_break", "session", many=_in_sessions(_with_prior_range, "close", "in_session", "_range"), session=_SESSION)
def prior_session_high_low_break(df, p, w):
    df = w.framed(df, lambda df: _with_prior_range(df, f"session_{p['session']}", list(w.keys)))
    return _signal(df, c("close") > c("_range._hi"), c("close") < c("_range._lo"), c("in_session"))


#: Bars of the longest opening range.
_LONGEST_OPENING = 30


def _with_openings(df: DataFrame, flag: str, keys: list[str]) -> DataFrame:
    """df with in_session, _nth (place in the session) and _his, _los: high and low of the first 1, 2, ... bars of the session."""
    df = session_occurrences(df, flag, keys)
    run = Window.partitionBy(*keys, "run_id").orderBy("bar_idx")
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    opening = c("in_session") & known("high", "low", "close")
    df = df.withColumn("_nth", F.row_number().over(run))
    levels = df.select(*keys, "run_id", "_nth", F.max(F.when(opening, c("high"))).over(so_far).alias("hi"), F.min(F.when(opening, c("low"))).over(so_far).alias("lo"))
    lists = levels.filter(c("_nth") <= _LONGEST_OPENING).groupBy(*keys, "run_id").agg(F.array_sort(F.collect_list(F.struct("_nth", "hi", "lo"))).alias("_first"))
    return df.join(lists.select(*keys, "run_id", c("_first.hi").alias("_his"), c("_first.lo").alias("_los")), [*keys, "run_id"], "left")


@rule("opening_range_breakout", "session", many=_in_sessions(_with_openings, "high", "low", "close", "in_session", "_nth", "_his", "_los"), session=_SESSION, opening_bars=(2, _LONGEST_OPENING))
def opening_range_breakout(df, p, w):
    df = w.framed(df, lambda df: _with_openings(df, f"session_{p['session']}", list(w.keys)))
    n = p["opening_bars"] if isinstance(p["opening_bars"], Column) else F.lit(p["opening_bars"])
    later = c("in_session") & (c("_nth") > n) & known("high", "low")
    return _signal(df, c("close") > F.get("_his", n.cast("int") - 1), c("close") < F.get("_los", n.cast("int") - 1), later)


# Volatility


def _quantile_of(name: str, uses: tuple[str, ...], prepare=None) -> Many:
    """The quantile percentile of the lookback values before; both are data."""
    find = lambda b, p: {"_q": b.quantile(name, p["lookback"], p["percentile"])}
    return Many(uses, ("lookback", "percentile"), ("_q",), find, (name,), lambda p: p["lookback"] + 1, prepare)


@rule("atr_percentile_regime", "volatility", many=_quantile_of("atr", ("open", "close", "atr")), lookback=(10, 200), percentile=(0.5, 0.95))
def atr_percentile_regime(df, p, w):
    df = w.framed(df, lambda df: with_quantile(df, "atr", p["percentile"], p["lookback"], w, "_q"))
    high = c("atr") >= c("_q")
    return _signal(df, high & (_body() > 0), high & (_body() < 0))


@rule(
    "volatility_expansion_direction", "volatility", lookback=(5, 100), range_multiple=(1.1, 3.0),
    many=_one_length(("_q",), lambda b, n: (b.quantile("_range", n, 0.5),), ("open", "close", "_range"), inputs=("_range",), prepare=_with_range),
)
def volatility_expansion_direction(df, p, w):
    df = w.framed(df, lambda df: with_quantile(_with_range(df, w), "_range", 0.5, p["lookback"], w, "_q"))
    wide = (c("_q") > 0) & (c("_range") >= p["range_multiple"] * c("_q"))
    return _signal(df, wide & (_body() > 0), wide & (_body() < 0))


@rule("volatility_contraction_reversion", "volatility", many=_quantile_of("_range", ("open", "close", "_range"), _with_range), lookback=(10, 200), percentile=(0.05, 0.4))
def volatility_contraction_reversion(df, p, w):
    df = w.framed(df, lambda df: with_quantile(_with_range(df, w), "_range", p["percentile"], p["lookback"], w, "_q"))
    quiet = c("_range") <= c("_q")
    return _signal(df, quiet & (_body() < 0), quiet & (_body() > 0))


# Statistical


@rule("return_continuation", "statistical", many=_LAGGED, lookback=(1, 60), threshold_pct=(0.0, 1.5))
def return_continuation(df, p, w):
    return roc_momentum(df, p, w)


@rule("return_reversal", "statistical", many=_LAGGED, lookback=(1, 60), threshold_pct=(0.0, 1.5))
def return_reversal(df, p, w):
    return return_continuation(df, p, w).withColumn("signal", -c("signal"))


def _with_return(df, w):
    return df.withColumn("_ret", c("close") / F.nullif(w.lag("close"), F.lit(0.0)) - 1)


def _with_returns(df, w):
    return _with_return(df, w).withColumn("_prev", w.lag("_ret"))


def _autocorrelation(b: Block, n: int) -> tuple[np.ndarray]:
    value, varied = b.correlation("_prev", "_ret", n - 1)
    return (np.where(varied, value, np.nan),)


@rule(
    "rolling_autocorr_direction", "statistical", lookback=(5, 100), min_abs_autocorr=(0.0, 0.8),
    many=_one_length(("_corr",), _autocorrelation, ("_ret",), inputs=("_prev", "_ret"), prepare=_with_returns),
)
def rolling_autocorr_direction(df, p, w):
    def frames(df):
        n = p["lookback"]
        frame = w.own(n - 1)
        varied = (F.stddev_pop("_prev").over(frame) > 0) & (F.stddev_pop("_ret").over(frame) > 0)
        whole = (F.count("_prev").over(frame) == n - 1) & (F.count("_ret").over(frame) == n - 1)
        return _with_returns(df, w).withColumn("_corr", F.when(whole & varied, F.corr("_prev", "_ret").over(frame)))

    df = w.framed(df, frames)
    strong = F.abs("_corr") >= p["min_abs_autocorr"]
    way = F.signum("_ret") * F.when(c("_corr") < 0, -1).otherwise(1)
    return _signal(df, strong & (way > 0), strong & (way < 0))


@rule("range_position_reversal", "statistical", many=_OWN_LEVELS, lookback=(5, 100), edge_fraction=(0.05, 0.35))
def range_position_reversal(df, p, w):
    df = _position(df, p, w)
    high = c("_pos") >= 1 - p["edge_fraction"]
    return _signal(df, (c("_pos") <= p["edge_fraction"]) & ~high, high)


@rule("standardized_return_signal", "statistical", many=_mean_std("_ret", ("_ret",), True, _with_return), lookback=(10, 200), z_threshold=(0.5, 3.5))
def standardized_return_signal(df, p, w):
    k = p["z_threshold"]

    def frames(df):
        n = p["lookback"]
        return _with_return(df, w).withColumns({"_m": mean("_ret", n, w.prior(n)), "_s": std("_ret", n, w.prior(n))})

    df = w.framed(df, frames)
    z = F.when(c("_s") > 0, (c("_ret") - c("_m")) / c("_s"))
    return _signal(df, z >= k, z <= -k)


# Pullbacks


def _with_last_closes(df, w):
    return df.withColumns({"_atr": F.when(w.lag("atr") > 0, w.lag("atr")), "_c1": w.lag("close"), "_c2": w.lag("close", 2)})


def _moves(b: Block, p: dict) -> dict[str, np.ndarray]:
    last = b.lag("close", 1)
    return {"_trend": last - b.lag("close", 1 + p["trend_lookback"]), "_pull": last - b.lag("close", 1 + p["pullback_lookback"])}


def _pulled_back(keyed: bool) -> Many:
    uses, over = ("close", "_atr", "_c1", "_c2"), ("trend_lookback", "pullback_lookback")
    return Many(uses, over, ("_trend", "_pull"), _moves, reach=lambda p: 1 + max(p.values()), prepare=_with_last_closes, keyed=keyed)


def _pullback(df: DataFrame, p: dict, w: Frames) -> DataFrame:
    """_up, _down: a trend and a move against it up to the bar before, in its atr."""

    def frames(df):
        last = w.lag("close")
        return _with_last_closes(df, w).withColumns({"_trend": last - w.lag("close", 1 + p["trend_lookback"]), "_pull": last - w.lag("close", 1 + p["pullback_lookback"])})

    df = w.framed(df, frames)
    t, k = p["trend_threshold_atr"] * c("_atr"), p["pullback_threshold_atr"] * c("_atr")
    ready = known("_atr", "close", "_c1", "_c2", "_trend", "_pull")
    return df.withColumns({"_up": ready & (c("_trend") >= t) & (c("_pull") <= -k), "_down": ready & (c("_trend") <= -t) & (c("_pull") >= k)})


@rule("trend_pullback_recovery", "edge_b_trend_pullback", many=_pulled_back(False), trend_lookback=(60, 240), trend_threshold_atr=(2.0, 8.0), pullback_lookback=(3, 20), pullback_threshold_atr=(0.5, 3.0))
def trend_pullback_recovery(df, p, w):
    df = _pullback(df, p, w)
    up = c("_up") & (c("_c1") < c("_c2")) & (c("close") > c("_c1"))
    down = c("_down") & ~c("_up") & (c("_c1") > c("_c2")) & (c("close") < c("_c1"))
    return _signal(df, up, down)


@rule("trend_pullback_recovery_v2", "edge_b_trend_pullback_v2", many=_pulled_back(True), trend_lookback=(120, 480), trend_threshold_atr=(4.0, 12.0), pullback_lookback=(5, 30), pullback_threshold_atr=(0.75, 4.0), recovery_threshold_atr=(0.1, 1.0))
def trend_pullback_recovery_v2(df, p, w):
    """The first turn of each episode of bars in a pullback."""
    keys = list(w.keys)
    df = _pullback(df, p, w)
    turn = p["recovery_threshold_atr"] * c("_atr")
    for name, flag, at in (("_long", "_up", (c("_c1") < c("_c2")) & (c("close") - c("_c1") >= turn)), ("_short", "_down", (c("_c1") > c("_c2")) & (c("_c1") - c("close") >= turn))):
        df = df.withColumn("_in", F.coalesce(c(flag), F.lit(False)))
        df = with_runs(df, "_in", keys, "bar_idx", "_episode").withColumn("_hit", c("_in") & at)
        earlier = Window.partitionBy(*keys, "_episode").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn(name, F.coalesce(c("_hit"), F.lit(False)) & ~F.coalesce(F.bool_or("_hit").over(earlier), F.lit(False)))
    return _signal(df, c("_long"), c("_short"))


# Compression, break, retest


def _with_last_atr(df, w):
    return df.withColumn("_atr", F.when(w.lag("atr") > 0, w.lag("atr")))


_BARS = ("open", "high", "low", "close")
_RETESTED = Many(
    (*_BARS, "_atr"), ("compression_lookback",), ("_hi", "_lo"), lambda b, p: dict(zip(("_hi", "_lo"), _levels_before(b, p["compression_lookback"]))),
    ("high", "low"), lambda p: p["compression_lookback"] + 1, _with_last_atr, keyed=True,
)


def _retest(df: DataFrame, p: dict, w: Frames, per_root: bool) -> DataFrame:
    """A quiet range, a decisive break out of it, a return to the broken level and a confirmation.

    Runs of quiet bars freeze the range of their first bar. Each run has at most one break: the first decisive bar of the run or the bar after it. The bars
    behind the break tell how it ends. A run counts only if a bar that is not quiet lies between it and the end of the last one that counted.
    """
    keys, n, wait = list(w.keys), p["compression_lookback"], p["retest_window_bars"]
    scale = n**0.5 if per_root else 1.0
    df = w.framed(df, lambda df: _prior_levels(_with_last_atr(df, w), n, w))
    quiet = (c("_hi") - c("_lo") >= 0) & ((c("_hi") - c("_lo")) / (c("_atr") * scale) <= p["compression_atr_ratio"])
    df = df.withColumn("_quiet", F.coalesce(quiet, F.lit(False)))
    df = with_runs(df, "_quiet", keys, "bar_idx", "_run").withColumn("_near", c("_quiet") | F.coalesce(w.lag("_quiet"), F.lit(False)))
    run = Window.partitionBy(*keys, "_run").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    frozen = F.first(F.struct(c("_hi").alias("hi"), c("_lo").alias("lo"), c("_atr").alias("atr"), c("bar_idx").alias("start"))).over(run)
    runs = df.filter((c("_run") > 0) & c("_near")).withColumn("_f", frozen)
    body, room = F.abs(c("close") - c("open")), p["breakout_buffer_atr"] * c("_f.atr")
    big = body >= p["breakout_body_atr"] * c("_f.atr")
    up = (c("close") > c("_f.hi") + room) & (c("close") > c("open")) & big
    down = (c("close") < c("_f.lo") - room) & (c("close") < c("open")) & big
    own = [x for x in df.columns if x.startswith("_p_")]  # an experiment's thresholds, where they are columns
    breaks = runs.withColumn("_way", side(up, down)).filter("_way != 0").groupBy(*keys, "_run", "_f", *own).agg(F.min("bar_idx").alias("_b"), F.min_by("_way", "bar_idx").alias("_way"))
    level = F.when(c("_way") > 0, c("_f.hi")).otherwise(c("_f.lo")).alias("_level")
    breaks = breaks.select(*keys, "_run", c("_f.start").alias("_start"), c("_f.atr").alias("_fatr"), "_b", "_way", level, *own)
    after = breaks.withColumn("bar_idx", F.explode(F.sequence(c("_b") + 1, c("_b") + wait)))
    seen = after.join(df.select(*keys, "bar_idx", "open", "high", "low", "close"), [*keys, "bar_idx"])
    tol, conf = p["retest_tolerance_atr"] * c("_fatr"), p["confirmation_atr"] * c("_fatr")
    long_, full_bar = c("_way") > 0, known("open", "high", "low", "close")
    fails = full_bar & F.when(long_, c("close") < c("_level") - tol).otherwise(c("close") > c("_level") + tol)
    touch = full_bar & ~fails & F.when(long_, c("low") <= c("_level") + tol).otherwise(c("high") >= c("_level") - tol)
    good = full_bar & F.when(long_, (c("close") >= c("_level") + conf) & (c("close") > c("open"))).otherwise((c("close") <= c("_level") - conf) & (c("close") < c("open")))
    seen = seen.withColumn("_touched", F.bool_or(F.coalesce(touch, F.lit(False))).over(Window.partitionBy(*keys, "_run").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)))
    seen = seen.withColumn("_event", F.when(fails, 0).when(c("_touched") & good, c("_way")))
    ends = seen.filter("_event is not null").groupBy(*keys, "_run").agg(F.min("bar_idx").alias("_end"), F.min_by("_event", "bar_idx").alias("_event"))
    tries = breaks.join(ends, [*keys, "_run"], "left").withColumn("_stop", F.coalesce(c("_end"), c("_b") + wait + 1))
    chosen = non_overlapping(tries.select(*keys, "_start", "_stop", "_event"), keys, "_start", "_stop", gap=2)
    hits = chosen.filter("_event != 0").select(*keys, c("_stop").alias("bar_idx"), c("_event").alias("signal"))
    return df.join(hits, [*keys, "bar_idx"], "left").withColumn("signal", F.coalesce("signal", F.lit(0)))


_RETEST = {"compression_lookback": (20, 120), "compression_atr_ratio": (1.0, 6.0), "breakout_buffer_atr": (0.0, 0.5), "breakout_body_atr": (0.1, 1.0), "retest_window_bars": (3, 30), "retest_tolerance_atr": (0.05, 0.5), "confirmation_atr": (0.0, 0.5)}


@rule("compression_breakout_retest", "edge_c_compression_retest", many=_RETESTED, **_RETEST)
def compression_breakout_retest(df, p, w):
    return _retest(df, p, w, per_root=False)


@rule("compression_breakout_retest_v2", "edge_c_compression_retest_v2", many=_RETESTED, **_RETEST)
def compression_breakout_retest_v2(df, p, w):
    return _retest(df, p, w, per_root=True)


# Sweep of a prior session's range


_TRANSITIONS = ("asia_to_london", "london_pre_ny_to_new_york")


def _armed_bars(df: DataFrame, transition: str, keys: list[str]) -> DataFrame:
    """The bars of each target session that has a reference range, with range, atr before the session (_fatr) and place in the session (_age); no threshold is needed for these."""
    asia = transition == "asia_to_london"
    source, target = ("asia", "london") if asia else ("london", "new_york")
    bars = session_occurrences(df, f"session_{source}", keys).withColumnRenamed("run_id", "_source").withColumnRenamed("in_session", "_in_source")
    bars = session_occurrences(bars, f"session_{target}", keys).withColumnRenamed("run_id", "_target")
    both = known("high", "low") & c("_in_source")
    if asia:
        # A range is complete on the first bar after its session, and serves one target session.
        done = bars.filter((c("_source") > 0) & c("_in_source")).groupBy(*keys, "_source").agg(F.max(F.when(both, c("high"))).alias("_hi"), F.min(F.when(both, c("low"))).alias("_lo"), (F.max("bar_idx") + 1).alias("_done"))
        done = done.filter("_hi is not null")
        starts = bars.filter(c("in_session")).groupBy(*keys, "_target").agg(F.min("bar_idx").alias("_start"))
        armed = asof(starts, done, keys, "_start", "_done", ["_hi", "_lo", "_source"])
        first = F.row_number().over(Window.partitionBy(*keys, "_source").orderBy("_start")) == 1
        armed = armed.filter("_source is not null").withColumn("_first", first).filter("_first").drop("_first", "_source", "_done")
    else:
        # The range so far of the session that runs, or that ended on the bar before; the target's first bar is not in it.
        so_far = Window.partitionBy(*keys, "_source").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, -1)
        live = bars.withColumns({"_hi": F.max(F.when(both, c("high"))).over(so_far), "_lo": F.min(F.when(both, c("low"))).over(so_far)})
        # A run's first bar looks back at no bar of its own run; a bar right behind a run still sees it.
        starts_here = c("in_session") & ~F.coalesce(Frames(*keys).lag("in_session"), F.lit(False))
        runs_now = F.coalesce(Frames(*keys).lag("_in_source"), F.lit(False)) | c("_in_source")
        live = live.withColumn("_here", starts_here).withColumn("_live", runs_now).filter(c("_here") & c("_live") & c("_hi").isNotNull())
        armed = live.select(*keys, "_target", c("bar_idx").alias("_start"), "_hi", "_lo")
    atr_before = F.last(F.when(c("atr") > 0, c("atr")), ignorenulls=True).over(Frames(*keys).before())
    atr = bars.select(*keys, c("bar_idx").alias("_start"), atr_before.alias("_fatr"))
    armed = armed.filter("_hi > _lo").join(atr, [*keys, "_start"]).filter("_fatr is not null")
    seen = bars.filter(c("in_session")).select(*keys, "_target", "bar_idx", "open", "high", "low", "close").join(armed, [*keys, "_target"])
    return seen.withColumn("_age", c("bar_idx") - c("_start")).filter(known("open", "high", "low", "close"))


def _sweeps(seen: DataFrame, p: dict, keys: list[str]) -> DataFrame:
    """keys, bar_idx, signal: the first sweep of the range and the close back inside, of each target session and key."""
    seen = seen.filter(c("_age") < p["entry_window_bars"])
    above, below = c("high") > c("_hi") + p["sweep_atr"] * c("_fatr"), c("low") < c("_lo") - p["sweep_atr"] * c("_fatr")
    run = [*keys, "_target"]
    every = Window.partitionBy(*run)
    seen = seen.withColumns({"_above": above, "_below": below}).withColumns({"_a": F.min(F.when(c("_above"), c("_age"))).over(every), "_z": F.min(F.when(c("_below"), c("_age"))).over(every)})
    up = c("_a").isNotNull() & (c("_z").isNull() | (c("_a") < c("_z")))
    swept = F.least("_a", "_z")
    other = F.when(up, c("_below")).otherwise(c("_above"))
    in_time = c("_age").between(swept, swept + p["max_reclaim_bars"])
    depth = p["reclaim_depth_atr"] * c("_fatr")
    back = F.when(up, (c("close") < c("_hi") - depth) & (c("close") < c("open"))).otherwise((c("close") > c("_lo") + depth) & (c("close") > c("open")))
    seen = seen.filter(~(c("_a").eqNullSafe(c("_z")))).withColumns({"_opposite": F.when((c("_age") > swept) & other, c("_age")), "_back": F.when(in_time & back, c("_age")), "_way": F.when(up, -1).otherwise(1)})
    hits = seen.groupBy(*run, "_start", "_way").agg(F.min("_opposite").alias("_opposite"), F.min("_back").alias("_back"))
    hits = hits.filter(c("_back").isNotNull() & (c("_opposite").isNull() | (c("_back") < c("_opposite"))))
    return hits.select(*keys, (c("_start") + c("_back")).alias("bar_idx"), c("_way").alias("signal"))


def _all_sweeps(bars: DataFrame, experiments: DataFrame, p: dict, keys: list[str]) -> DataFrame:
    """The sweeps of many experiments: thresholds meet the few bars of armed sessions only."""
    out = None
    for transition in _TRANSITIONS:
        own = experiments.filter(p["transition"] == transition)
        hits = _sweeps(_armed_bars(bars, transition, keys).crossJoin(F.broadcast(own)), p, ["experiment_id", *keys])
        out = hits if out is None else out.unionByName(hits)
    allowed = ["entry_allowed"] if "entry_allowed" in bars.columns else []
    return out.join(bars.select(*keys, "bar_idx", *allowed), [*keys, "bar_idx"])


@rule("prior_session_sweep_reclaim", "edge_d_session_sweep", many=Many(direct=_all_sweeps), transition=_TRANSITIONS, entry_window_bars=(15, 240), sweep_atr=(0.0, 1.0), max_reclaim_bars=(0, 30), reclaim_depth_atr=(0.0, 0.5))
def prior_session_sweep_reclaim(df, p, w):
    """In a target session: the first sweep of the reference range and a close back inside within max_reclaim_bars, unless the other side is swept first."""
    keys = list(w.keys)
    if p["transition"] not in _TRANSITIONS:
        raise ValueError(f"unknown transition {p['transition']!r}")
    hits = _sweeps(_armed_bars(df, p["transition"], keys), p, keys)
    return df.join(hits, [*keys, "bar_idx"], "left").withColumn("signal", F.coalesce("signal", F.lit(0)))


# Wrappers


def check_params(name: str, params: dict) -> None:
    """A parameter outside of its rule's domain, or of no such name, raises ValueError."""
    domain = RULES[name].domain
    for k, v in params.items():
        if k not in domain:
            raise ValueError(f"{name} has no parameter {k!r}")
        d = domain[k]
        inside = v in d if any(isinstance(x, str) for x in d) else d[0] <= v <= d[1]
        if not inside:
            raise ValueError(f"{k}={v!r} is outside of {d} in {name}")


def evaluate(bars: DataFrame, name: str, params: dict, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """bars with the rule's signal, 0 where entry_allowed is false."""
    out = RULES[name].build(bars, params, Frames(*keys)).select(*bars.columns, c("signal").cast("int").alias("signal"))
    return mask_entries(out) if "entry_allowed" in bars.columns else out


#: Parameters that count 0 where they are not given.
OPTIONAL = ("threshold_atr", "threshold_pct", "min_body_atr", "buffer_atr", "min_range_atr")
#: Shares of sliding quantiles; Spark's windows take them as constants only.
_SHARES = ("percentile", "bandwidth_percentile", "compression_percentile")
#: Experiments that are broadcast to the bars' frames, a few hundred bytes each; more are joined by shuffle.
MOST_BROADCAST = 100_000


def with_errors(experiments: DataFrame) -> DataFrame:
    """experiments (experiment_id, strategy, params map, and perhaps cat_params map) with error: what is wrong with the rule's name or parameters, or null."""
    rows = [(name, [(k, *((None, None, list(d)) if isinstance(d[0], str) else (float(d[0]), float(d[1]), None)), isinstance(d[0], int), k in OPTIONAL) for k, d in r.domain.items()]) for name, r in RULES.items()]
    domains = experiments.sparkSession.createDataFrame(rows, "strategy string, _domain array<struct<name string, low double, high double, texts array<string>, whole boolean, optional boolean>>")
    texts = c("cat_params") if "cat_params" in experiments.columns else F.lit(None).cast("map<string,string>")
    none_given, no_texts = F.create_map().cast("map<string,double>"), F.create_map().cast("map<string,string>")
    df = experiments.join(F.broadcast(domains), "strategy", "left").withColumns({"_v": F.coalesce(c("params").cast("map<string,double>"), none_given), "_t": F.coalesce(texts, no_texts)})
    unknown = F.array_except(F.concat(F.map_keys("_v"), F.map_keys("_t")), F.transform("_domain", lambda d: d["name"]))

    def wrong(d: Column) -> Column:
        value, text = c("_v")[d["name"]], c("_t")[d["name"]]
        is_text = d["texts"].isNotNull()
        given = F.map_contains_key("_t", d["name"]) | F.map_contains_key("_v", d["name"])
        bad = F.when(is_text, ~F.coalesce(F.array_contains(d["texts"], text), F.lit(False))).otherwise(~F.coalesce(value.between(d["low"], d["high"]), F.lit(False)))
        part = F.when(~given & ~d["optional"], F.concat(F.lit("no value of "), d["name"]))
        part = part.when(given & bad, F.concat(d["name"], F.lit(" is outside of its domain")))
        return part.when(given & d["whole"] & ~is_text & (value != F.floor(value)), F.concat(d["name"], F.lit(" is no whole number")))

    faults = F.filter(F.transform("_domain", wrong), lambda x: x.isNotNull())
    error = F.when(c("_domain").isNull(), F.concat(F.lit("there is no rule "), F.coalesce("strategy", F.lit("null"))))
    error = error.when(F.size(unknown) > 0, F.concat(F.lit("there is no parameter "), F.get(unknown, F.lit(0)))).when(F.size(faults) > 0, F.get(faults, F.lit(0)))
    return df.withColumn("error", error.otherwise(F.when(c("experiment_id").isNull(), "no experiment_id"))).drop("_domain", "_v", "_t")


def _sets_of(name: str) -> tuple[str, ...]:
    """The parameters of which each set is evaluated apart: those that make frames, or, without many, all that Spark's windows need as constants."""
    r = RULES[name]
    return r.many.over if r.many else tuple(k for k, d in r.domain.items() if not isinstance(d[0], float) or k in _SHARES)


def evaluate_table(bars: DataFrame, experiments: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """experiment_id, keys, bar_idx, signal of the non-zero signals of a table of experiments (experiment_id, strategy, params map, and perhaps cat_params map).

    There is one plan for each rule, whatever its parameters. Frames of all parameter sets are found over blocks of bars (``blocks.frame_rows``); experiments are then joined to
    them by set, and thresholds compared as columns. Bars are sent by block, once for each SETS sets, never by experiment, but for rules that follow a path of their own. Only
    the distinct parameter sets come to the driver. Experiments with an error (``with_errors``) have no signals.
    """
    texts = c("cat_params") if "cat_params" in experiments.columns else F.lit(None).cast("map<string,string>")
    good = with_errors(experiments).filter("error is null").select("experiment_id", "strategy", c("params").cast("map<string,double>").alias("_params"), texts.alias("_texts"))
    over = F.create_map(*(x for name in RULES for x in (F.lit(name), F.array(*map(F.lit, _sets_of(name))).cast("array<string>"))))
    value = lambda k: F.coalesce(c("_texts")[k], c("_params")[k].cast("string"))
    rows = checkpointed(good.withColumn("_set", F.transform(over[c("strategy")], value)))
    counted = rows.groupBy("strategy", "_set").agg(F.count("*").alias("n")).collect()
    many = sum(r["n"] for r in counted) <= MOST_BROADCAST
    out = None
    for name in sorted({r["strategy"] for r in counted}):
        domain, names = RULES[name].domain, _sets_of(name)
        sets = sorted((r["_set"] for r in counted if r["strategy"] == name), key=str)
        typed = [{k: v if isinstance(domain[k][0], str) else type(domain[k][0])(float(v)) for k, v in zip(names, x)} for x in sets]
        own = rows.filter(c("strategy") == name)
        if names:
            numbered = bars.sparkSession.createDataFrame([(i, x) for i, x in enumerate(sets)], "set_id int, _set array<string>")
            own = own.join(F.broadcast(numbered), "_set")
        columns = {k: c("_texts")[k] if isinstance(d[0], str) else F.coalesce(c("_params")[k], F.lit(0.0)) if k in OPTIONAL else c("_params")[k].cast("int" if isinstance(d[0], int) else "double") for k, d in domain.items()}
        own = own.select("experiment_id", *(["set_id"] if names else []), *(x.alias(f"_p_{k}") for k, x in columns.items()))
        p = {k: c(f"_p_{k}") for k in domain}
        found = _many(bars, RULES[name], own, typed, p, list(keys), F.broadcast if many else lambda df: df)
        out = found if out is None else out.unionByName(found)
    if out is None:
        kinds = dict(bars.dtypes)
        none = [F.lit(None).cast(experiments.schema["experiment_id"].dataType).alias("experiment_id"), *(F.lit(None).cast(kinds[k]).alias(k) for k in keys)]
        out = bars.limit(0).select(*none, "bar_idx", F.lit(0).alias("signal"))
    return out


def _many(bars: DataFrame, r: Rule, own: DataFrame, sets: list[dict], p: dict, keys: list[str], small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The non-zero signals of the experiments (own) of one rule."""
    masked = ["entry_allowed"] if "entry_allowed" in bars.columns else []
    found = ["experiment_id", *keys, "bar_idx", c("signal").cast("int").alias("signal")]
    series = Frames(*keys)
    m = r.many
    if m is None:
        out = None
        for i, constants in enumerate(sets):
            each = bars.crossJoin(own.filter(c("set_id") == i))
            part = r.build(each, p | constants, Frames("experiment_id", *keys))
            part = (mask_entries(part) if masked else part).filter("signal != 0").select(*found)
            out = part if out is None else out.unionByName(part)
        return out
    if m.direct:
        rows = m.direct(bars, own, p, keys)
        return (mask_entries(rows) if masked else rows).filter("signal != 0").select(*found)
    ready = m.prepare(bars, series) if m.prepare else bars
    passed = [*m.uses, *masked]
    if m.over:
        reach = max(m.reach(x) for x in sets)
        near, share = None, ""
        if m.expanding:
            value, share = m.expanding
            near = earlier_near(ready, keys, value, sorted({x[share] for x in sets}))
        rows = frame_rows(ready, keys, list(m.inputs), passed, sets, reach, list(m.names), m.find, near, share).join(small(own), "set_id")
    elif "_session" in m.uses:
        rows = ready.select(*keys, "bar_idx", *passed).join(small(own), c("_session") == c("_p_session"))
    else:
        rows = ready.select(*keys, "bar_idx", *passed).crossJoin(small(own))
    rows = r.build(rows, p, GivenFrames("experiment_id", *keys) if m.keyed else GivenFrames(*keys))
    return (mask_entries(rows) if masked else rows).filter("signal != 0").select(*found)


def direction_filter(signals: DataFrame, mode: Column | str) -> DataFrame:
    """Keep long, short or both (combined) signals; mode may be a column."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    keep = (mode == "combined") | ((mode == "long") & (c("signal") > 0)) | ((mode == "short") & (c("signal") < 0))
    return signals.withColumn("signal", F.when(keep, c("signal")).otherwise(0))


def mask_entries(signals: DataFrame) -> DataFrame:
    """0 where entry_allowed is false; values other than -1, 0 and 1 raise an error."""
    good = F.when(c("signal").isin(-1, 0, 1), c("signal")).otherwise(F.raise_error(F.lit("signals are -1, 0 or 1")).cast("int"))
    return signals.withColumn("signal", F.when(c("entry_allowed"), good).otherwise(F.lit(0)))


def mask_window(signals: DataFrame, start: str, end: str) -> DataFrame:
    """0 outside of [start, end). Apply it to finished signals: the bars before the start warm the windows up."""
    inside = (c("bar_ts") >= F.lit(start).cast("timestamp_ntz")) & (c("bar_ts") < F.lit(end).cast("timestamp_ntz"))
    return signals.withColumn("signal", F.when(inside, c("signal")).otherwise(0))
