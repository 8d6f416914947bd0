"""The folder that driver and executors share, for tables that outlive a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or else a folder in a warehouse that is no machine's own disk; in local mode, where all is one process, a
    temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master == "local" or context.master.startswith("local["):
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="loomstone-")
        return _own[context.applicationId]
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if "://" not in warehouse or warehouse.startswith("file:"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share; the warehouse {warehouse} is local")
    return f"{warehouse}/loomstone"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and a lost executor costs no more than reading it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
