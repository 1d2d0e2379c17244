"""Window frames over bars: ordered by bar_idx within keys."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Frames:
    """The frames of one partitioning. ``own(n)`` is a bar and the n - 1 before it, ``prior(n)`` the n before it."""

    def __init__(self, *keys: str, order: str = "bar_idx"):
        self.keys = keys
        self.base: WindowSpec = Window.partitionBy(*keys).orderBy(order)

    def own(self, n: int) -> WindowSpec:
        return self.base.rowsBetween(-(n - 1), 0)

    def prior(self, n: int) -> WindowSpec:
        return self.base.rowsBetween(-n, -1)

    def so_far(self) -> WindowSpec:
        return self.base.rowsBetween(Window.unboundedPreceding, 0)

    def before(self) -> WindowSpec:
        return self.base.rowsBetween(Window.unboundedPreceding, -1)

    def framed(self, df: DataFrame, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """df with the frames of a rule, which add computes."""
        return add(df)

    def lag(self, c: str | Column, n: int = 1) -> Column:
        return F.lag(c, n).over(self.base)

    def lead(self, c: str | Column, n: int = 1) -> Column:
        return F.lead(c, n).over(self.base)


class GivenFrames(Frames):
    """Frames of rows that have the frames of their rules as columns."""

    def framed(self, df: DataFrame, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return df


def full(value: Column, source: str | Column, n: int, frame: WindowSpec) -> Column:
    """value where the frame holds n known values of source, else null."""
    source = F.col(source) if isinstance(source, str) else source
    return F.when(F.count(source).over(frame) == n, value)


def mean(c: str, n: int, frame: WindowSpec) -> Column:
    return full(F.avg(c).over(frame), c, n, frame)


def std(c: str, n: int, frame: WindowSpec) -> Column:
    """Population standard deviation."""
    return full(F.stddev_pop(c).over(frame), c, n, frame)


def highest(c: str, n: int, frame: WindowSpec) -> Column:
    return full(F.max(c).over(frame), c, n, frame)


def lowest(c: str, n: int, frame: WindowSpec) -> Column:
    return full(F.min(c).over(frame), c, n, frame)


#: Bars of a block of ``sliding``; a window is not longer.
SLIDING_BLOCK = 4096


def sliding(df: DataFrame, value: str, n: int, w: Frames, name: str, of: Callable[..., np.ndarray], own: bool = False, beside: tuple[str, ...] = ()) -> DataFrame:
    """df with of(windows, *beside) in the column name; null where a window has an unknown value or fewer than n. bar_idx counts the bars of a series one by one.

    windows has a row for each bar: the n values before it (own: up to it). A series is cut into blocks of bars, each with the last bars of the block before it, so it is not
    one task, and what Spark's windows would do bar by bar is done for a block at once.
    """
    block, place = F.floor(F.col("bar_idx") / SLIDING_BLOCK), F.col("bar_idx") % SLIDING_BLOCK
    rows = df.withColumn("_block", F.explode(F.when(place >= SLIDING_BLOCK - n, F.array(block, block + 1)).otherwise(F.array(block))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bar_idx")
        idx, values = table["bar_idx"].to_numpy(), table[value].cast(pa.float64()).to_numpy()
        mine = idx // SLIDING_BLOCK == table["_block"][0].as_py()
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n, np.nan), values]), n)[own:][: len(idx)][mine]
        table = table.filter(pa.array(mine)).drop(["_block"])
        known = ~np.isnan(windows).any(axis=1)
        found = np.zeros(len(known))
        found[known] = of(windows[known], *(table[c].cast(pa.float64()).to_numpy()[known] for c in beside))
        return table.append_column(name, pa.array(found, mask=~known))

    return rows.groupBy(*w.keys, "_block").applyInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def with_quantile(df: DataFrame, value: str, q: float, n: int, w: Frames, name: str) -> DataFrame:
    """df with the exact quantile (linear between ranks) of the n values before the bar."""
    at = (n - 1) * float(q)
    lo, hi = math.floor(at), math.ceil(at)

    def of(windows: np.ndarray) -> np.ndarray:
        ordered = np.sort(windows, axis=1)
        low, high = ordered[:, lo], ordered[:, hi]
        return np.where(low == high, low, (hi - at) * low + (at - lo) * high)

    return sliding(df, value, n, w, name, of)


def slope(c: str, n: int, frame: WindowSpec) -> Column:
    """Least-squares slope against the bar index."""
    return full(F.regr_slope(F.col(c), F.col("bar_idx").cast("double")).over(frame), c, n, frame)


def side(up: Column, down: Column) -> Column:
    """1 where up holds, else -1 where down holds, else 0; unknown is false."""
    return F.when(up, F.lit(1)).when(down, F.lit(-1)).otherwise(F.lit(0))


def known(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out
