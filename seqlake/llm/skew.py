"""Salting of hot keys, and broadcast sides of a checked size.

A key is hot when it holds more than ``HOT_ROWS`` rows and more than a ``MOST_HOT``-th of all
rows. So at most MOST_HOT keys can be hot, whatever the input: the table of hot keys is safe to
broadcast by its construction. All other keys hold no more than total / MOST_HOT rows.

Joins that pick few texts or sets by their ids take the ids as a broadcast while they are
``MOST_NUMBERS`` numbers or fewer, so that no text moves; beyond that, Spark picks the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_HOT = 4096
HOT_ROWS = 256
SALTS = 32
MOST_NUMBERS = 1_000_000


def hot_keys(counts: DataFrame, total: int, n_col: str = "n") -> DataFrame:
    """Of counts (keys..., n), the keys that are hot: MOST_HOT rows at most."""
    return counts.where(F.col(n_col) > max(HOT_ROWS, total // MOST_HOT)).drop(n_col)


def with_salt(rows: DataFrame, hot: DataFrame, by: Column, salts: int = SALTS) -> DataFrame:
    """rows plus salt: a number below salts, by the hash of ``by``, for rows of hot keys; 0 for the rest."""
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), hot.columns, "left")
    return marked.withColumn("salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(0).cast("int")).drop("_hot")


def for_each_salt(table: DataFrame, hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """A table with one row per key, its rows of hot keys repeated for every salt."""
    marked = table.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), hot.columns, "left")
    each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("salt", F.explode(each)).drop("_hot")


def side(table: DataFrame) -> DataFrame:
    """A written table of numbers as a broadcast side, if it holds MOST_NUMBERS or fewer, else as it is."""
    return F.broadcast(table) if table.count() * len(table.columns) <= MOST_NUMBERS else table
