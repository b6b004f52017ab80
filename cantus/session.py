"""Making the package importable in Python workers, and tables in the folder that a cluster shares."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the workers, unless their search path has it already; once per application."""
    app = spark.sparkContext.applicationId
    home = os.path.dirname(_ROOT)
    if app in _SHIPPED or home in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return spark
    archive = os.path.join(tempfile.mkdtemp(prefix="cantus-ship-"), "cantus.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for folder, _, files in os.walk(_ROOT):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, home))
    spark.sparkContext.addPyFile(archive)
    if archive in sys.path:
        sys.path.remove(archive)  # the driver keeps to the folder
    _SHIPPED.add(app)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see. A local session that has none gets a folder of its own; a cluster must name one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        configured = tempfile.mkdtemp(prefix="cantus-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def checkpointed(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder and read back: later uses neither recompute it nor keep its lineage."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/cantus/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
