"""Set operations and comparison of two logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.functions import scalars as S
from seqlake.operators.ranges import Keyed
from seqlake.plans.jobs import current_state, expected_compaction
from seqlake.schema import RECORD_KEY

CONTENT = ["kind", "did", "collection", "rkey", "rev"]


def handoff(archive: DataFrame, live: DataFrame, tip: int) -> DataFrame:
    """The archive up to the tip, the live stream from it; the shared row comes once."""
    return archive.where(F.col("seq") <= tip).unionByName(live.where(F.col("seq") >= tip)).dropDuplicates(["seq"])


def _hashed(log: DataFrame, with_seq: bool = False) -> DataFrame:
    key = CONTENT + ["seq"] * with_seq
    return log.select(*key, F.sha2(F.coalesce("record", F.lit("")), 256).alias("payload"))


def coverage_diff(want: DataFrame, got: DataFrame, with_seq: bool = False) -> DataFrame:
    """Wanted rows (key and payload hash) that got does not hold at all."""
    return _hashed(want, with_seq).distinct().join(_hashed(got, with_seq).distinct(), CONTENT + ["seq"] * with_seq + ["payload"], "left_anti")


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side holds more often: count_a, count_b."""
    both = _hashed(a).withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(_hashed(b).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    out = both.groupBy(*CONTENT, "payload").agg(F.sum("_a").alias("count_a"), F.sum("_b").alias("count_b"))
    return out.where("count_a <> count_b")


def ordered_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per account, rows by their rank in seq: missing, extra or mismatch."""
    one, two = (Keyed(_hashed(x, True), ["did"], "seq").numbered("rank").select("did", "rank", F.col("seq").alias("seq" + k), F.concat_ws("|", "kind", "collection", "rkey", "rev", "payload").alias("row" + k)) for x, k in ((a, "_a"), (b, "_b")))
    rows = one.join(two, ["did", "rank"], "full_outer")
    diagnosis = F.when(F.col("row_b").isNull(), "missing").when(F.col("row_a").isNull(), "extra").when(F.col("row_a") != F.col("row_b"), "mismatch")
    return rows.select("did", "rank", "seq_a", "seq_b", diagnosis.alias("diagnosis")).where("diagnosis IS NOT NULL")


def compacted_diff(want: DataFrame, got: DataFrame, watermark: int) -> DataFrame:
    """The multiset difference after the compaction that the watermark demands."""
    return multiset_diff(expected_compaction(want, watermark), got)


def _state(log: DataFrame) -> DataFrame:
    return current_state(log).select(*RECORD_KEY, F.struct("rev", "record").alias("v"))


def state_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records whose live state differs: only_a, only_b or changed."""
    rows = _state(a).withColumnRenamed("v", "va").join(_state(b).withColumnRenamed("v", "vb"), RECORD_KEY, "full_outer")
    what = F.when(F.col("vb").isNull(), "only_a").when(F.col("va").isNull(), "only_b").when(~F.col("va").eqNullSafe(F.col("vb")), "changed")
    return rows.select(*RECORD_KEY, what.alias("difference")).where("difference IS NOT NULL")


def check_fold_convergence(filtered: DataFrame, full: DataFrame, collections: list[str]) -> DataFrame:
    """Folding a filtered stream must give the restriction of the full fold; differences are rows."""
    inside = F.col("collection").isin(collections)
    only = full.where(~S.is_commit() | inside)
    return state_diff(filtered.where(~S.is_commit() | inside), only)
