"""Tables written to the folder that the driver and all executors share.

Work of several rounds cuts its lineage here: a written table outlives the executor that made it.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group.
ROW_GROUP = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new temporary folder serves a session in one process (as tests
    are); on a cluster that would be another folder on each machine, so it is an error there."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"


class Saved:
    """A table in the shared folder: ``df`` reads it, ``drop()`` removes it when no plan needs it any more. Row
    groups are small, as a writer holds one in memory."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        df.write.option("parquet.block.size", ROW_GROUP).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
