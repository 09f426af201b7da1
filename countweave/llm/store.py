"""Tables kept on shared storage: one computation, many readers, no lineage behind them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a private one only in local sessions that name none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="llm-tables-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Whether shuffle files go when the action that made them ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, free: bool = False, **options) -> DataFrame:
    """Write once as Parquet in the shared folder and read from there (lost executors lose nothing).

    free: drop the shuffle files of the write at its end, not when the driver next collects its garbage.
    options: of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE, None)
    if free:
        spark.conf.set(FREE, "true")
        df = df.select("*")  # the setting is read where a plan is made
    try:
        df.write.options(**options).parquet(path)
    finally:
        if free:
            spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(n: int, each: int, least: int = 1) -> int:
    """Partitions so that each holds about `each` rows."""
    return max(least, -(-int(n) // each))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def some_id(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """The id as a long under its own name, for the thin queries."""
    return df.withColumn(name, F.col(name).cast("long"))
