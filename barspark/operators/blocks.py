"""Frames whose length is data: a block of bars is read once, and the frames of many parameter sets are found over it.

A series is cut into blocks of ``BLOCK`` bars, each with the last bars of the block before it. ``frame_rows`` deals the
blocks, and parts of the parameter sets, to tasks and gives a row for each bar and parameter set, in which frames are
plain columns: what uses them needs neither windows nor a plan of its own for each set.

Sums run in the order of Spark's windows, from the oldest value on, so both give the same bits. Highs and lows come from
a table of spans of powers of two; quantiles from a wavelet matrix of the block's ranks, by descent from the highest bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barspark.functions.store import checkpointed

BLOCK = 8192
#: Parameter sets that a task works on with one block.
SETS = 64


class Wavelet:
    """Ranks of values, a bit a level, the highest first; a level keeps how many zeros stand before each place."""

    def __init__(self, values: np.ndarray):
        self.ordered, rank = np.unique(values, return_inverse=True)
        self.levels = []
        for bit in reversed(range(max(1, int(len(self.ordered) - 1).bit_length()))):
            one = (rank >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(~one)])))
            rank = np.concatenate([rank[~one], rank[one]])

    def smallest(self, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of each stretch of values from begin up to, not with, end."""
        rank = np.zeros(len(begin), dtype=np.int64)
        for bit, zeros in self.levels:
            low, high = zeros[begin], zeros[end]
            one = k >= high - low
            rank |= one.astype(np.int64) << bit
            begin, end = np.where(one, zeros[-1] + begin - low, low), np.where(one, zeros[-1] + end - high, high)
            k = np.where(one, k - (high - low), k)
        return self.ordered[rank]


class Block:
    """The columns of a block and of the bars before it, as arrays (NaN: null), and frames over them. A frame is null where it holds fewer than n bars or a null."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = columns
        self.size = len(next(iter(columns.values())))
        #: The first bar of the block itself, and by share what ``earlier_near`` found for it.
        self.first, self.near = 0, {}
        self._gaps: dict[str, np.ndarray] = {}
        self._spans: dict[tuple[str, bool], list[np.ndarray]] = {}
        self._wavelets: dict[str, Wavelet] = {}

    def _whole(self, name: str, n: int, shift: int) -> np.ndarray:
        """Where the n values that end shift bars before a bar are all there."""
        if name not in self._gaps:
            self._gaps[name] = np.concatenate([[0], np.cumsum(np.isnan(self.columns[name]))])
        end = np.arange(self.size) + 1 - shift
        begin = end - n
        return (begin >= 0) & (self._gaps[name][np.maximum(end, 0)] == self._gaps[name][np.maximum(begin, 0)])

    def _steps(self, name: str, n: int, shift: int) -> Iterator[np.ndarray]:
        """The values of all bars' frames, the oldest of each first; of bars too near to the start, anything."""
        padded = np.concatenate([np.zeros(n + shift), self.columns[name]])
        for back in range(n - 1 + shift, shift - 1, -1):
            yield padded[n + shift - back : n + shift - back + self.size]

    def _full(self, value: np.ndarray, name: str, n: int, shift: int) -> np.ndarray:
        return np.where(self._whole(name, n, shift), value, np.nan)

    def lag(self, name: str, n: int) -> np.ndarray:
        return shifted(self.columns[name], n)

    def total(self, name: str, n: int, prior: bool = False) -> np.ndarray:
        out = np.zeros(self.size)
        for x in self._steps(name, n, int(prior)):
            out = out + x
        return self._full(out, name, n, int(prior))

    def mean(self, name: str, n: int, prior: bool = False) -> np.ndarray:
        return self.total(name, n, prior) / n

    def std(self, name: str, n: int, prior: bool = False) -> np.ndarray:
        """Population standard deviation."""
        average, squares = np.zeros(self.size), np.zeros(self.size)
        for k, x in enumerate(self._steps(name, n, int(prior)), 1):
            delta = x - average
            part = delta / k
            average, squares = average + part, squares + delta * (delta - part)
        return self._full(np.sqrt(squares / n), name, n, int(prior))

    def slope(self, name: str, n: int) -> np.ndarray:
        """Least-squares slope against the bar's number."""
        x_mean, y_mean, both, squares = np.zeros(self.size), np.zeros(self.size), np.zeros(self.size), np.zeros(self.size)
        for k, (x, y) in enumerate(zip(self._steps("bar_idx", n, 0), self._steps(name, n, 0)), 1):
            dx, dy = x - x_mean, y - y_mean
            squares = squares + dx * (dx - dx / k)
            x_mean, y_mean = x_mean + dx / k, y_mean + dy / k
            both = both + dx * (y - y_mean)
        return self._full(both / squares, name, n, 0)

    def correlation(self, one: str, two: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(correlation of two columns, where both vary)."""
        x_mean, y_mean, both, x_squares, y_squares = (np.zeros(self.size) for _ in range(5))
        for k, (x, y) in enumerate(zip(self._steps(one, n, 0), self._steps(two, n, 0)), 1):
            dx, dy = x - x_mean, y - y_mean
            x_mean, y_mean = x_mean + dx / k, y_mean + dy / k
            both = both + dx * (y - y_mean)
            x_squares, y_squares = x_squares + dx * (x - x_mean), y_squares + dy * (y - y_mean)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = both / np.sqrt(x_squares * y_squares)
        return np.where(self._whole(one, n, 0) & self._whole(two, n, 0), out, np.nan), (self.std(one, n) > 0) & (self.std(two, n) > 0)

    def extreme(self, name: str, n: int, highest: bool, prior: bool = False) -> np.ndarray:
        """The highest or lowest value: two spans of a power of two that cover the frame."""
        pick = np.fmax if highest else np.fmin
        spans = self._spans.setdefault((name, highest), [self.columns[name]])
        power = n.bit_length() - 1
        while len(spans) <= power:
            spans.append(pick(spans[-1], shifted(spans[-1], 1 << len(spans) - 1)))
        shift = int(prior)
        return self._full(pick(shifted(spans[power], shift), shifted(spans[power], shift + n - (1 << power))), name, n, shift)

    def anew(self, name: str, n: int) -> np.ndarray:
        """Exponential average that starts anew at the first value of each frame."""
        alpha, out = 2.0 / (n + 1), None
        for x in self._steps(name, n, 0):
            out = x if out is None else alpha * x + (1 - alpha) * out
        return self._full(out, name, n, 0)

    def deviation(self, name: str, n: int, middle: np.ndarray) -> np.ndarray:
        """Mean distance from middle."""
        out = np.zeros(self.size)
        for x in self._steps(name, n, 0):
            out = out + np.abs(x - middle)
        return self._full(out / n, name, n, 0)

    def quantile(self, name: str, n: int, share: float, values: np.ndarray | None = None) -> np.ndarray:
        """The exact quantile (linear between ranks) of the n values before the bar."""
        if values is not None:
            self.columns[name] = values
            self._gaps.pop(name, None), self._wavelets.pop(name, None)
        if name not in self._wavelets:
            self._wavelets[name] = Wavelet(np.nan_to_num(self.columns[name], nan=0.0))
        whole = self._whole(name, n, 1)
        end = np.flatnonzero(whole)
        at = (n - 1) * float(share)
        low, high = int(np.floor(at)), int(np.ceil(at))
        find = lambda k: self._wavelets[name].smallest(end - n, end, np.full(len(end), k))
        first = find(low)
        second = first if low == high else find(high)
        out = np.full(self.size, np.nan)
        out[end] = np.where(first == second, first, (high - at) * first + (at - low) * second)
        return out

    def expanding(self, name: str, share: float, whole: str) -> np.ndarray:
        """The exact quantile (linear between ranks) of all values before the bar, where the column whole is 1."""
        skip, before, near = self.near.get(share, (0, 0, np.zeros(0)))
        own = np.nan_to_num(self.columns[name][self.first :], nan=0.0)
        place = np.arange(len(own))
        asked = np.flatnonzero((self.columns[whole][self.first :] == 1) & (before + place > 0))
        ranks, m = Wavelet(np.concatenate([near, own])), len(near)
        at = (before + asked - 1) * float(share)
        low, high = np.floor(at), np.ceil(at)
        find = lambda k: ranks.smallest(np.zeros(len(asked), dtype=np.int64), m + asked, k.astype(np.int64) - skip)
        first, second = find(low), find(high)
        out = np.full(self.size, np.nan)
        out[self.first + asked] = np.where(first == second, first, (high - at) * first + (at - low) * second)
        return out


def earlier_near(bars: DataFrame, keys: list[str], value: str, shares: list[float], bucket: int = 1024) -> DataFrame:
    """keys, _block, _share, _skip, _before, _v: of the values before each block, those whose ranks its bars can ask for at each share.

    Values are cut into buckets by rank; counts of the buckets before each block say which few hold the ranks, as a block adds no more values than it has bars. _skip values
    before the block are lower than those given; _before is the count of all.
    """
    block = F.floor(F.col("bar_idx") / BLOCK)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_v", "bar_idx")) - 1
    cut = bars.select(*keys, "bar_idx", block.alias("_b"), F.col(value).alias("_v")).filter("_v is not null").withColumn("_k", F.floor(rank / bucket))
    cut = checkpointed(cut.drop("bar_idx"))
    counts = cut.groupBy(*keys, "_k", "_b").agg(F.count("*").alias("_n"))
    grid = counts.select(*keys, "_b").distinct().join(counts.select(*keys, "_k").distinct(), keys).join(counts, [*keys, "_k", "_b"], "left")
    sums = Window.partitionBy(*keys, "_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_e", F.coalesce(F.sum("_n").over(sums), F.lit(0)))
    whole = Window.partitionBy(*keys, "_b")
    grid = grid.withColumns({"_skip": F.sum("_e").over(whole.orderBy("_k")) - F.col("_e"), "_before": F.sum("_e").over(whole)})
    each = grid.filter("_e > 0").withColumn("_share", F.explode(F.array(*map(F.lit, shares))))
    low, high = (F.col("_before") - 1) * F.col("_share") - 1, (F.col("_before") + BLOCK) * F.col("_share") + 2
    # Among values before and in the block, a rank is at most BLOCK places off from the same value's rank before it.
    asked = each.filter((F.col("_skip") <= high) & (F.col("_skip") + F.col("_e") > low - BLOCK))
    asked = asked.withColumn("_skip", F.min("_skip").over(Window.partitionBy(*keys, "_b", "_share")))
    found = asked.select(*keys, F.col("_b").alias("_block"), "_share", "_skip", "_before", "_k").join(cut, [*keys, "_k"]).filter(F.col("_b") < F.col("_block"))
    return found.select(*keys, "_block", "_share", "_skip", "_before", "_v")


def shifted(values: np.ndarray, n: int) -> np.ndarray:
    """Each bar's value n bars before; null where there is none."""
    return values if n == 0 else np.concatenate([np.full(min(n, len(values)), np.nan), values[: len(values) - n]])


Find = Callable[[Block, dict], dict[str, np.ndarray]]


def frame_rows(bars: DataFrame, keys: list[str], inputs: list[str], passed: list[str], sets: list[dict], reach: int, names: list[str], find: Find, near: DataFrame | None = None, share: str = "") -> DataFrame:
    """keys, bar_idx, passed, set_id and the frames (names, doubles) for each bar and parameter set.

    inputs: numeric columns that the frames read. reach: bars before a block that the longest frame needs. A task takes a block and up to SETS parameter sets, so blocks are sent
    once for each SETS of them. near: what ``earlier_near`` found for the shares, which are the parameter share of the sets. bar_idx counts the bars of a series one by one.
    """
    reach = min(reach, BLOCK)
    parts = -(-len(sets) // SETS)
    block, place = F.floor(F.col("bar_idx") / BLOCK), F.col("bar_idx") % BLOCK
    columns = list(dict.fromkeys([*keys, "bar_idx", *inputs, *passed]))
    rows = bars.select(*columns, F.explode(F.when(place >= BLOCK - reach, F.array(block, block + 1)).otherwise(F.array(block))).alias("_block"))
    rows = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kinds = {f.name: f for f in rows.schema.fields}
    out = T.StructType([*(kinds[c] for c in dict.fromkeys([*keys, "bar_idx", *passed])), T.StructField("set_id", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def frames_of(table: pa.Table, beside: pa.Table | None) -> Iterator[pa.RecordBatch]:
        table = table.sort_by("bar_idx")
        part, number = table["_part"][0].as_py(), table["_block"][0].as_py()
        block = Block({c: table[c].cast(pa.float64()).to_numpy() for c in ("bar_idx", *inputs)})
        mine = table["bar_idx"].to_numpy() // BLOCK == number
        own = table.filter(pa.array(mine)).select([f.name for f in out if f.name in kinds]).combine_chunks()
        if not own.num_rows:
            return
        block.first = int(mine.argmax())
        if beside is not None:
            shares = beside["_share"].to_numpy()
            for x in np.unique(shares):
                rows = beside.filter(pa.array(shares == x))
                block.near[float(x)] = (rows["_skip"][0].as_py(), rows["_before"][0].as_py(), rows["_v"].to_numpy())
        for set_id in range(part * SETS, min(len(sets), (part + 1) * SETS)):
            found = find(block, sets[set_id])
            frames = [pa.array(x := np.asarray(found[n], dtype=float)[mine], mask=np.isnan(x)) for n in names]
            columns = [*(own[c] for c in own.column_names), pa.array(np.full(own.num_rows, set_id, dtype=np.int32)), *frames]
            yield from pa.Table.from_arrays(columns, names=out.names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from frames_of(pa.Table.from_batches(batches), None)

    def run_beside(bars: pa.Table, beside: pa.Table) -> pa.Table:
        batches = list(frames_of(bars, beside if beside.num_rows else None)) if bars.num_rows else []
        return pa.Table.from_batches(batches, schema=batches[0].schema if batches else to_arrow_schema(out))

    group = [*keys, "_block", "_part"]
    if near is None:
        return rows.groupBy(*group).applyInArrow(run, out)
    wanted = bars.sparkSession.createDataFrame(sorted({(i // SETS, float(x[share])) for i, x in enumerate(sets)}), "_part int, _share double")
    dealt = near.join(F.broadcast(wanted), "_share")
    rows, dealt = rows.toDF(*rows.columns), dealt.toDF(*dealt.columns)  # a cogroup wants columns of its own on each side
    return rows.groupBy(*group).cogroup(dealt.groupBy(*group)).applyInArrow(run_beside, out)
