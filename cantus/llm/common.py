"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. A local session that has none gets a folder of its own; a cluster must name one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        configured = tempfile.mkdtemp(prefix="cantus-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later uses neither recompute it nor need its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cantus/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, total_bytes: int, per_partition: int) -> int:
    """A partition count that keeps the mean partition under ``per_partition`` bytes and the cores busy."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes) // per_partition))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


class Shared:
    """A broadcast value of bounded size, with a key by which a Python worker remembers what it has built from it."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.id, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.broadcast.value
