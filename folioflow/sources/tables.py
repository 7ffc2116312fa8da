"""Reading the Parquet tables of a data directory."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory ``sf_dir`` (one file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs_once(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of jobs, one row per id (some rows are stored twice).

    ``id`` comes first, under the name ``book``.  Rows without id are left out.
    """
    jobs = table(spark, sf_dir, "jobs").where(F.col("id").isNotNull())
    return jobs.select(F.col("id").alias("book"), *columns).dropDuplicates(["book"])


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: spark.checkpoint.dir, or, on one machine only, a temporary one where that is unset."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current is None:
        if not configured and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = configured or os.path.join(tempfile.gettempdir(), "folioflow-checkpoints")
        sc.setCheckpointDir(path)
        return path
    return current


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
