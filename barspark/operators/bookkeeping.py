"""Which runs are pending, snapshots that never change, drift and fingerprints of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def c(name: str) -> Column:
    return F.col(name)


def pending(catalog: DataFrame, completed: DataFrame, only: DataFrame | None = None, limit: int | None = None, order: str = "row") -> DataFrame:
    """Rows of the catalog that are not completed, of the wanted ids if given, in catalog order."""
    out = catalog.join(completed.select("experiment_id").distinct(), "experiment_id", "left_anti")
    if only is not None:
        out = out.join(only.select("experiment_id").distinct(), "experiment_id", "left_semi")
    return out if limit is None else out.orderBy(order).limit(limit)


def append_snapshot(existing: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with what becomes of each: same (already there), drift (there with other values) or new. Only new ones are to be appended; a drift is an error of the caller's."""
    values = [x for x in existing.columns if x not in key]
    both = rows.alias("n").join(existing.alias("e"), [c(f"n.{k}").eqNullSafe(c(f"e.{k}")) for k in key], "left")
    there = F.lit(False)
    for k in key:
        there = there | c(f"e.{k}").isNotNull()
    same = F.lit(True)
    for v in values:
        same = same & c(f"n.{v}").eqNullSafe(c(f"e.{v}"))
    return both.select("n.*", F.when(~there, "new").when(same, "same").otherwise("drift").alias("status"))


def frozen_drift(frozen: DataFrame, catalog: DataFrame, fields: list[str]) -> DataFrame:
    """experiment_id, field, expected, actual of every frozen value that the catalog does not have; field is missing or duplicate for ids that are not there or frozen twice."""
    twice = frozen.groupBy("experiment_id").agg(F.count("*").alias("n")).filter("n > 1").select("experiment_id", F.lit("duplicate").alias("field"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"))
    both = frozen.alias("f").join(catalog.withColumn("_there", F.lit(True)).alias("k"), "experiment_id", "left")
    missing = both.filter("_there is null").select("experiment_id", F.lit("missing").alias("field"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"))
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("field"), c(f"f.{x}").cast("string").alias("expected"), c(f"k.{x}").cast("string").alias("actual")) for x in fields)))
    wrong = both.filter("_there").select("experiment_id", each.alias("x")).select("experiment_id", "x.*").filter(~c("expected").eqNullSafe(c("actual")))
    return twice.unionByName(missing).unionByName(wrong)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """n_rows and four sums of 32-bit slices of each row's md5, the same in any order of rows."""
    text = F.concat_ws("\x1f", *(F.coalesce(c(x).cast("string"), F.lit("\x00")) for x in sorted(df.columns)))
    hashed = df.select(F.md5(text).alias("h"))
    return hashed.agg(F.count("*").alias("n_rows"), *(F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"h{i}") for i in range(4)))
