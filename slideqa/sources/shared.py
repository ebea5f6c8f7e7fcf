"""Folders that the driver and all executors see, for tables between steps."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. A session in one process, as tests are, may leave that unset and gets a
    temporary folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder()
    return f"{folder.rstrip('/')}/slideqa-{uuid.uuid4().hex}/{name}"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a few files dealt out to all cores, for work that costs more than moving them; many files stay as they
    are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
