"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir.

A table written here cuts lineage: it survives the loss of any executor, and the plans that
read it start from its real size, so that Spark's own size checks choose the joins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seqlake.scratch import scratch_root


def short_batches(spark: SparkSession, size: str = "1m") -> None:
    """From now on, texts reach Python in batches of about so many bytes in this session, unless it has set a size itself.

    Spark's default of 64 MB takes hundreds of megabytes per task, as both sides hold a batch more
    than once. Results are lazy, so the setting must outlast the call.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, size)


class Scratch:
    """Tables of one operator run, freed together or one by one."""

    def __init__(self, spark: SparkSession, name: str):
        short_batches(spark)
        self.spark = spark
        self.base = f"{scratch_root(spark).rstrip('/')}/seqlake/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df once and return the written table."""
        path = f"{self.base}/{self.count}-{name}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more, the result's own plan included."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
