"""Paths in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}  # of an application on one machine, its folder


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; where none is set, one machine alone (tests) gets a temporary one, a cluster an error."""
    root = spark.conf.get(_KEY, None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{_KEY} must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="seqlake-"))
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/seqlake/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once and read back: computed once, and of known size, so that Spark's own size check picks the joins."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
