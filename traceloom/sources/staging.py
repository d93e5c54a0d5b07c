"""Tables that cut lineage: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a local master gets a temporary folder; a
    cluster raises, as its executors could not see a local one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows in as many parts as there are cores or shuffle partitions, by key or evenly: for work that takes far more time than its bytes tell."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: this cuts the lineage."""
    return written(df, shared_dir(df.sparkSession, name))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system holds it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


class Workspace:
    """A folder of staged tables that goes when the work is done; what is kept stays.

    Tables read from the folder can't be read after it: keep the result before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, shared_dir(spark, name)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *error) -> None:
        delete(self.spark, self.path)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{self.path}/{name}-{uuid.uuid4().hex}")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return stage(df, f"{self.name}-{name}")
