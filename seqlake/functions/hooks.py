"""What callers may pass in: row decisions, a patch of one column, and transforms by batch or by block."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame

from seqlake.operators.aggregates import with_block


def rewrite(log: DataFrame, keep: Callable[[DataFrame], Column]) -> DataFrame:
    """Rows for which the caller's Column predicate holds."""
    return log.where(keep(log))


def patch_indexed_at(log: DataFrame, value: Callable[[DataFrame], Column]) -> DataFrame:
    """The log with indexed_at from the caller's Column; no other column can change."""
    return log.withColumn("indexed_at", value(log).cast("long"))


def transform_batches(log: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The caller's function on Arrow batches of the log."""

    def run(batches):
        for batch in batches:
            yield f(batch)

    return log.mapInPandas(run, schema)


def transform_blocks(log: DataFrame, f: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str, rows_per_block: int = 4096) -> DataFrame:
    """The caller's function on (block, its rows in order of seq), once for each block that holds rows.

    A block is a span of rows_per_block seqs, so a task never holds more rows than that of a log whose seqs are unique.
    """

    def run(key, rows):
        return f(int(key[0]), rows.drop(columns="block").sort_values("seq", kind="stable", ignore_index=True))

    return with_block(log, rows_per_block).groupBy("block").applyInPandas(run, schema)
