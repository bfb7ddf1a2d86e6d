"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_test_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _test_dirs:
        _test_dirs[app] = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return _test_dirs[app]


class Stored:
    """Tables written to the shared folder; cuts lineage and outlives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads it. ``stored_path`` on the result names the folder."""
        path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stored_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that no later step reads."""
        path = getattr(df, "stored_path", None)
        if path:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
