"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The rows lie in ``n_parts`` parts by a hash of their key; rows of equal keys are numbered first, and the number is part of the key. Given the sizes of the parts and of the shards (at most one row apart), the
number of rows that go from each part to each shard is drawn from the multivariate hypergeometric law, so that every way to
deal out the rows is equally likely. Each part is permuted and cut by its row of the matrix; the rows are exchanged;
each shard is permuted again, in ranges of a hash, whose places follow from the counts of the ranges. No shard and no part is ever in one task
as a whole unless it has few rows; only the matrix (n_parts x n_shards counts) is on the driver.

Defined results: nulls in key columns are ordinary values; rows that are equal in all key columns are dealt apart like others (which of them goes where
is open); an empty table gives no rows; other columns are carried along, and those that are called shard or slot are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from barspark.llm.shared import kept, number_copies

ROWS_PER_PART, MOST_PARTS = 2_000, 1 << 15
_UNIT = float(1 << 63)


def communication_matrix(part_sizes: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Counts from part to shard: rows sum to the part sizes, columns to shard sizes that are at most one apart."""
    rng, wide, total = np.random.default_rng(seed), np.random.RandomState(seed), sum(part_sizes)
    left = np.array([total // n_shards + (s < total % n_shards) for s in range(n_shards)], dtype=np.int64)
    rows = []
    for size in part_sizes:
        if left.sum() < 10**9:
            draw = rng.multivariate_hypergeometric(left, size, method="marginals")
        else:  # the law above takes no more; shard by shard, each against the rest, is the same law, drawn in double precision
            draw, rest, open_ = np.zeros(n_shards, dtype=np.int64), int(left.sum()), size
            for s in range(n_shards):
                rest -= int(left[s])
                draw[s] = min(open_, int(left[s])) if not open_ or not rest else wide.hypergeometric(int(left[s]), rest, open_)
                open_ -= int(draw[s])
        left -= draw
        rows.append(draw)
    return np.array(rows, dtype=np.int64).reshape(len(part_sizes), n_shards)


def shuffle_into_shards(df: DataFrame, n_shards: int, key: list[str], seed: int = 0) -> DataFrame:
    """df with shard (0 to n_shards - 1) and slot (0 to the shard's size - 1)."""
    spark, df = df.sparkSession, df.drop("shard", "slot")
    columns, df = df.columns, kept(number_copies(df, key, "_copy"), "numbered")
    key = [*key, "_copy"]

    def random(stage: int) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(stage), *key)

    total = df.count()
    n_parts = int(min(MOST_PARTS, max(1, -(-total // ROWS_PER_PART))))
    placed = df.withColumn("_part", F.pmod(random(0), F.lit(n_parts)).cast("int"))
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # n_parts rows
    matrix = communication_matrix([sizes.get(p, 0) for p in range(n_parts)], n_shards, seed)
    cuts = spark.createDataFrame([(p, [int(x) for x in np.cumsum(row)]) for p, row in enumerate(matrix)], "_part int, _cuts array<long>")

    # Permute within the part, cut by the row of the matrix.
    local = placed.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(random(1), *key)))
    dealt = local.join(F.broadcast(cuts), "_part").withColumn("shard", F.size(F.filter("_cuts", lambda c: c < F.col("_place"))))
    dealt = dealt.drop("_cuts", "_place", "_part")

    # Permute within the shard: ranges of the hash, each in its order.
    n_ranges = int(max(1, -(-total // n_shards // ROWS_PER_PART)))
    share = random(2) / F.lit(_UNIT) / 2 + 0.5
    dealt = dealt.withColumn("_range", F.least(F.floor(share * n_ranges), F.lit(n_ranges - 1)).cast("int"))
    counts = dealt.groupBy("shard", "_range").agg(F.count("*").alias("n"))
    before = counts.select("shard", "_range", (F.sum("n").over(Window.partitionBy("shard").orderBy("_range")) - F.col("n")).alias("_before"))
    order = Window.partitionBy("shard", "_range").orderBy(random(2), *key)
    placed = dealt.withColumn("_rank", F.row_number().over(order)).join(before, ["shard", "_range"])
    return placed.withColumn("slot", F.col("_before") + F.col("_rank") - 1).select(*columns, "shard", "slot")
