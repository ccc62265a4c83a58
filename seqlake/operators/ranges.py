"""Running results over one order of a whole table, without a window over the whole table.

Rows are dealt to ranges of the order and written; each range is summed up to one row, the few
range rows are carried on from range to range, and a window runs inside each range only. What is
broadcast has a row or two per range. ``Keyed`` does the same inside each key (an account, a source):
a key of any size is spread over ranges, and only the first and last key of a range carry values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from seqlake.scratch import new_path

PART = "_part"


class Ranged:
    """A table in ranges of an order, written once so that every use sees the same ranges."""

    def __init__(self, rows: DataFrame, *order: Column | str):
        spark = rows.sparkSession
        self.order, self.path = order, new_path(spark, "ranges")
        rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()).write.parquet(self.path)
        self.rows = spark.read.schema(StructType([*rows.schema.fields, StructField(PART, IntegerType())])).parquet(self.path)
        self.inside = Window.partitionBy(PART).orderBy(*order)

    def _with(self, per_part: DataFrame, name: str) -> DataFrame:
        return self.rows.join(F.broadcast(per_part.select(PART, name)), PART, "left")

    def numbered(self, name: str) -> DataFrame:
        """Rows with their number in the order, from 1."""
        sizes = self.rows.groupBy(PART).agg(F.count("*").alias("_n"))
        before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy(PART)) - F.col("_n"))
        return self._with(before, "_before").withColumn(name, F.col("_before") + F.row_number().over(self.inside)).drop(PART, "_before")

    def running_max(self, value: Column, name: str) -> DataFrame:
        """Rows with the greatest value up to and including them; nulls don't count."""
        tops = self.rows.groupBy(PART).agg(F.max(value).alias("_top"))
        earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        tops = tops.withColumn("_before", F.max("_top").over(earlier))
        own = F.max(value).over(self.inside.rowsBetween(Window.unboundedPreceding, 0))
        return self._with(tops, "_before").withColumn(name, F.greatest(own, "_before")).drop(PART, "_before")

    def next_known(self, value: Column, name: str) -> DataFrame:
        """Rows with the first value that isn't null at or after them."""
        firsts = self.rows.groupBy(PART).agg(F.min_by(value, F.when(value.isNotNull(), F.struct(*self.order))).alias("_first"))
        later = Window.orderBy(PART).rowsBetween(1, Window.unboundedFollowing)
        firsts = firsts.withColumn("_after", F.first("_first", ignorenulls=True).over(later))
        # backwards, as Spark goes through all following rows again for each row of a frame that ends with the partition
        back = Window.partitionBy(PART).orderBy(*[(F.col(c) if isinstance(c, str) else c).desc() for c in self.order])
        own = F.last(value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
        return self._with(firsts, "_after").withColumn(name, F.coalesce(own, "_after")).drop(PART, "_after")


class Keyed(Ranged):
    """A table in ranges of (key, order): running values inside each key. Rows without a key are one key."""

    def __init__(self, rows: DataFrame, key: list[str], *order: Column | str):
        super().__init__(rows, *key, *order)
        self.key, self.within = F.struct(*key), Window.partitionBy(PART, *key).orderBy(*order)

    def _carried(self, summary: Column, carry) -> DataFrame:
        """Rows with _carried: what earlier ranges hold of the row's key, by carry over their summaries."""
        ends = self.rows.groupBy(PART).agg(F.min(self.key).alias("_lo"), F.max(self.key).alias("_hi"))
        edges = self.rows.join(F.broadcast(ends), PART).where((self.key == F.col("_lo")) | (self.key == F.col("_hi")))
        edges = edges.groupBy(PART, self.key.alias("_key")).agg(summary.alias("_sum"))
        earlier = Window.partitionBy("_key").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.select(F.col(PART).alias("_in"), "_key", carry("_sum").over(earlier).alias("_carried")).where("_carried IS NOT NULL")
        return self.rows.join(F.broadcast(edges), (F.col(PART) == F.col("_in")) & (self.key == F.col("_key")), "left")

    def _out(self, rows: DataFrame, name: str, value: Column) -> DataFrame:
        return rows.withColumn(name, value).drop(PART, "_in", "_key", "_carried")

    def numbered(self, name: str) -> DataFrame:
        """Rows with their number inside the key, from 1."""
        rows = self._carried(F.count("*"), F.sum)
        return self._out(rows, name, F.coalesce("_carried", F.lit(0)) + F.row_number().over(self.within))

    def max_before(self, value: Column, name: str) -> DataFrame:
        """Rows with the greatest value of the key's earlier rows; nulls don't count."""
        rows = self._carried(F.max(value), F.max)
        own = F.max(value).over(self.within.rowsBetween(Window.unboundedPreceding, -1))
        return self._out(rows, name, F.greatest(own, "_carried"))

    def last_known(self, value: Column, name: str) -> DataFrame:
        """Rows with the key's last value that isn't null, up to and including them."""
        last = F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order)))
        rows = self._carried(last, lambda c: F.last(c, ignorenulls=True))
        own = F.last(value, ignorenulls=True).over(self.within.rowsBetween(Window.unboundedPreceding, 0))
        return self._out(rows, name, F.coalesce(own, "_carried"))

    def previous(self, value: Column, name: str) -> DataFrame:
        """Rows with the value of the key's row before."""
        held = F.struct(value.alias("v"))
        rows = self._carried(F.max_by(held, F.struct(*self.order)), F.last)
        return self._out(rows, name, F.coalesce(F.lag(held).over(self.within), "_carried")["v"])


def numbered_within(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Rows numbered from 1 inside each group; a group of any size is spread over ranges."""
    return Keyed(rows, [group], order).numbered(name)
