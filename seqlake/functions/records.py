"""Records as schemaless JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.scratch import delete, new_path


def blobs(log: DataFrame, id_col: str = "seq") -> DataFrame:
    """(id, ref, mime, size, level) of the blobs in each record, at whatever level they stand.

    Level by level, variants are exploded into their members until none is left; a blob is an
    object whose $type says so. Members that are no objects or arrays leave at once. A level is
    written before the next one reads it, so the work is one pass over each level's members.
    """
    spark, base = log.sparkSession, new_path(log.sparkSession, "blobs")
    level = log.select(id_col, F.try_parse_json("record").alias("v")).where("v IS NOT NULL")
    found, n = [], 0
    while True:
        path = f"{base}/level={n}"
        level.write.parquet(path)
        level = spark.read.schema(level.schema).parquet(path)
        if level.isEmpty():
            break
        is_blob = F.coalesce(F.try_variant_get("v", '$["$type"]', "string") == "blob", F.lit(False))
        out = f"{base}-found/level={n}"
        level.where(is_blob).select(
            id_col, F.try_variant_get("v", '$.ref["$link"]', "string").alias("ref"), F.try_variant_get("v", "$.mimeType", "string").alias("mime"),
            F.try_variant_get("v", "$.size", "long").alias("size"), F.lit(n).alias("level"),
        ).write.parquet(out)
        found.append(spark.read.parquet(out))
        level = level.where(~is_blob).lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer())).select(id_col, F.col("value").alias("v"))
        level = level.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
        n += 1
    delete(spark, base)
    none = spark.createDataFrame([], f"{id_col} {log.schema[id_col].dataType.simpleString()}, ref string, mime string, size long, level int")
    return reduce(DataFrame.unionByName, found, none)
