"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to ``spark.checkpoint.dir``; where that is unset, as in tests, to a temporary folder, but on a local master only."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def shared_folder(spark, what: str) -> str:
    """A new path in the shared folder."""
    import uuid

    checkpointed(spark.range(0))  # makes sure that the folder is set
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{what}-{uuid.uuid4().hex}"


def gathered(df: DataFrame, key: str, order: str) -> DataFrame:
    """df as a table in the shared folder, in buckets of key: what follows by key reads the columns it needs and sends no rows. df is to come by key already, as from a window over it."""
    import uuid

    spark, name = df.sparkSession, f"gathered_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", shared_folder(spark, "gathered")).bucketBy(buckets, key).sortBy(key, order).saveAsTable(name)
    return spark.table(name)
