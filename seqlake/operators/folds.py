"""Killers: what deletes older rows of a record or of an account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.functions import scalars as S
from seqlake.schema import RECORD_KEY


def fold_tombstones(log: DataFrame, lo: int = 0, hi: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(record killers, account killers) with the largest killer seq in (lo, hi] and its reason."""
    window = log.where(F.col("seq") > lo)
    window = window if hi is None else window.where(F.col("seq") <= hi)
    last = [F.max("seq").alias("killer_seq"), F.max_by("kind", "seq").alias("reason")]
    records = window.where(F.col("kind").isin("delete", "update")).groupBy(*RECORD_KEY).agg(*last)
    dids = window.where(S.is_did_killer()).groupBy("did").agg(*last)
    return records, dids


def merge_tombstones(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two partial folds, the larger seq per key."""
    key = [c for c in a.columns if c not in ("killer_seq", "reason")]
    return a.unionByName(b).groupBy(*key).agg(F.max("killer_seq").alias("killer_seq"), F.max_by("reason", "killer_seq").alias("reason"))


def killed(log: DataFrame, records: DataFrame, dids: DataFrame) -> DataFrame:
    """log with suppressed: a materialization with a killer of strictly larger seq."""
    by_record = records.select(*RECORD_KEY, F.col("killer_seq").alias("_record"))
    by_did = dids.select("did", F.col("killer_seq").alias("_did"))
    late = F.coalesce(F.greatest("_record", "_did") > F.col("seq"), F.lit(False))
    rows = log.join(by_record, RECORD_KEY, "left").join(by_did, "did", "left")
    return rows.withColumn("suppressed", S.is_materialization() & late).drop("_record", "_did")


def suppress(log: DataFrame, records: DataFrame, dids: DataFrame) -> DataFrame:
    return killed(log, records, dids).where("NOT suppressed").drop("suppressed").select(*log.columns)
