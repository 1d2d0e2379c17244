"""Folders and keys that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one, but on a local master only: elsewhere executors could not see it."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_dir = jvm_dir.get() if jvm_dir.isDefined() else None
    if not set_dir:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this session. All tables and files of the operators lie in it."""
    return f"{shared_dir(spark)}/barspark-llm-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete the session's folder: intermediate tables, written files and what lost attempts left. For when no result is needed any more, as results are read from there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{session_folder(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """The rows, written to the shared folder and read again: later steps neither compute them twice nor depend on one executor."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """A key of the row by its id and text (null: empty); equal rows have equal keys. Never null."""
    return F.xxhash64(F.col(id_column).cast("long"), F.coalesce(F.col(text_column), F.lit("")))


def number_copies(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """df with a number of its own (1, 2, ...) for each of the rows that are equal in the key columns.

    Which of equal rows gets which number is open. A frequent key is numbered in the slices of the table's partitions, so it is never in one task. A table without
    equal rows, as most are, is only counted by key.
    """
    if df.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty():
        return df.withColumn(name, F.lit(1).cast("long"))
    rows = kept(df.withColumn("_slice", F.spark_partition_id()), "slices")
    own = Window.partitionBy(*key, "_slice").orderBy(F.lit(1))
    counts = rows.groupBy(*key, "_slice").agg(F.count("*").alias("_n"))
    # Only keys with rows in two slices or more need the counts of those before.
    before = Window.partitionBy(*(c + "_k" for c in key)).orderBy("_slice_k").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(c).alias(c + "_k") for c in key), F.col("_slice").alias("_slice_k"), "_n").withColumn("_before", F.sum("_n").over(before)).filter("_before > 0").drop("_n")
    same = F.col("_slice") == F.col("_slice_k")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(c + "_k"))
    placed = rows.withColumn("_nth", F.row_number().over(own)).join(starts, same, "left")
    return placed.withColumn(name, (F.col("_nth") + F.coalesce("_before", F.lit(0))).cast("long")).select(*df.columns, name)


#: Keys that more than one in so many rows have are joined by a broadcast, which so has fewer rows than this.
FREQUENT = 1000


def join_frequent(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame | None = None, how: str = "left") -> DataFrame:
    """left with the one row that right has for its keys; where it has none, with nulls, or (how: inner) not at all.

    Keys that more than one in FREQUENT rows of left have are joined by a broadcast, the others by a shuffle, so no key fills a task. left and right are tables, as they are read
    twice. counts: keys and their rows (n) in left, if known.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    limit = counts.agg((F.sum("n") / FREQUENT).alias("_limit"))
    often = kept(counts.join(F.broadcast(limit), F.col("n") > F.col("_limit")).select(*keys, F.lit(True).alias("_often")), "frequent")
    marked = left.join(F.broadcast(often), keys, "left")
    hot = marked.filter("_often").drop("_often").join(F.broadcast(right.join(F.broadcast(often.select(*keys)), keys)), keys, how)
    return hot.unionByName(marked.filter("_often is null").drop("_often").join(right.hint("merge"), keys, how))
