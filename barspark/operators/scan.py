"""Ordered building blocks: recursive averages in blocks, islands, as-of joins, greedy chains."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.store import checkpointed

BLOCK = 256


def affine_scans(df: DataFrame, keys: list[str], order: str, scans: dict[str, tuple[Column, float]]) -> DataFrame:
    """df with y[name] = input + a * y[previous] along order (0, 1, 2, ... within keys), for each name: (input, a).

    A series is cut into blocks of BLOCK rows. Each block is summed on its own; a block's start then follows from the last values of
    the blocks before it, of which there is one row for each, so the rows of a long series are worked on in parallel.
    """
    block, place = "_scan_block", "_scan_place"
    df = df.withColumn(block, F.floor(F.col(order) / BLOCK)).withColumn(place, F.col(order) % BLOCK)
    inside = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_own_{n}": F.sum(x * F.pow(F.lit(1 / a), F.col(place))).over(inside) * F.pow(F.lit(a), F.col(place)) for n, (x, a) in scans.items()})
    last = df.groupBy(*keys, block).agg(*(F.max_by(f"_own_{n}", place).alias(f"_tail_{n}") for n in scans))
    blocks = Window.partitionBy(*keys).orderBy(block)
    carried = {}
    for n, (_, a) in scans.items():
        shrink = a**BLOCK
        reach = 1 if shrink < 1e-18 else math.ceil(math.log(1e-18) / (BLOCK * math.log(a))) + 1
        terms = [F.coalesce(F.lag(f"_tail_{n}", d).over(blocks), F.lit(0.0)) * shrink ** (d - 1) for d in range(1, reach + 1)]
        carried[f"_carry_{n}"] = sum(terms[1:], terms[0])
    starts = last.select(*keys, block, *(c.alias(n) for n, c in carried.items()))
    out = df.join(starts, [*keys, block])
    out = out.withColumns({n: F.col(f"_own_{n}") + F.col(f"_carry_{n}") * F.pow(F.lit(a), F.col(place) + 1) for n, (_, a) in scans.items()})
    return out.drop(block, place, *(f"_{k}_{n}" for n in scans for k in ("own", "carry")))


def running_total(df: DataFrame, order: str, amount: str, before: str, total: str) -> DataFrame:
    """df with the sum of the amounts before a row in an order (nulls first), and of all. Rows are sorted in ranges; only a sum for each range is added up in one place."""
    ranged = checkpointed(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum(amount).alias("_sum"))
    starts = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_start"), F.sum("_sum").over(Window.partitionBy(F.lit(1))).alias(total))
    inside = F.sum(amount).over(Window.partitionBy("_range").orderBy(order)) - F.col(amount)
    return ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_range").withColumn(before, F.col("_start") + F.col("_inside")).drop("_range", "_start", "_inside")


def seeded_input(x: str, place: Column, n: int, share: float, frame_keys: list[str], order: str, skip: int = 0) -> Column:
    """Input of an average that starts at place skip + n - 1 with the mean of n values and takes share of each later value."""
    seed = F.avg(x).over(Window.partitionBy(*frame_keys).orderBy(order).rowsBetween(-(n - 1), 0))
    first = skip + n - 1
    return F.when(place < first, F.lit(0.0)).when(place == first, seed).otherwise(F.col(x) * share)


def islands(flag: Column, keys: list[str], order: str) -> tuple[Column, Column]:
    """(start flag, start count so far) of the runs in which flag holds. Use the first as a column before the second."""
    w = Window.partitionBy(*keys).orderBy(order)
    start = flag & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    return start, F.sum(F.col("_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))


def with_runs(df: DataFrame, flag: str, keys: list[str], order: str, name: str = "run_id") -> DataFrame:
    """df with the number of the run of flag that a row is in, or that was the last before it (0: none yet)."""
    start, _ = islands(F.col(flag), keys, order)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_start", start).withColumn(name, F.sum(F.col("_start").cast("int")).over(w)).drop("_start")


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], forward: bool = False) -> DataFrame:
    """left with the values of the last right row at or before its time (forward: the first at or after it), or nulls.

    Both sides are put in one order by key and time; the last known value is carried along. No row meets another row, so nothing fans out.
    """
    taken = F.struct(F.col(right_time).alias("_at"), *values)
    kind = "struct<" + ",".join(f"{n}:{t}" for n, t in right.select(taken.alias("x")).select("x.*").dtypes) + ">"
    row = F.struct(*left.columns)
    one = left.select(*keys, F.col(left_time).alias("_t"), F.lit(0 if forward else 1).alias("_side"), row.alias("_row"), F.lit(None).cast(kind).alias("_seen"))
    two = right.select(*keys, F.col(right_time).alias("_t"), F.lit(1 if forward else 0).alias("_side"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), taken.alias("_seen"))
    # Forward the rows are run past from the last one on: a frame that ends with the series would be read again for every row.
    w = Window.partitionBy(*keys).orderBy(*((F.desc("_t"), F.desc("_side")) if forward else ("_t", "_side")))
    seen = F.last("_seen", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = one.unionByName(two).withColumn("_found", seen).filter(F.col("_row").isNotNull())
    return both.select("_row.*", F.col("_found._at").alias(right_time if right_time not in left.columns else f"{right_time}_found"), *(F.col(f"_found.{v}").alias(v) for v in values))


def non_overlapping(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """The rows of df (one for each start and key) that a greedy choice in order of start keeps: a row is kept if its start is at least the end of the last kept one plus gap.

    Rows are sorted within their keys and run past once; what is carried from row to row is the key and the first start that is free. A key's rows are never held together.
    """
    dealt = df.withColumns({"_from": F.col(start).cast("long"), "_free": F.col(end).cast("long") + gap}).repartition(*keys).sortWithinPartitions(*keys, "_from")
    columns = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, free = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            first = [batch[k][0].as_py() for k in keys]
            new = np.zeros(batch.num_rows, dtype=bool)
            new[0] = first != last
            for k in keys:
                a, b = batch[k][1:], batch[k][:-1]
                both = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
                new[1:] |= both | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
            chosen = []
            for fresh, at, until in zip(new.tolist(), batch["_from"].to_pylist(), batch["_free"].to_pylist()):
                taken = fresh or free is None or at >= free
                chosen.append(taken)
                if taken:
                    free = until
            last = [batch[k][batch.num_rows - 1].as_py() for k in keys]
            yield batch.select(columns).filter(pa.array(chosen))

    return dealt.mapInArrow(run, df.schema)
