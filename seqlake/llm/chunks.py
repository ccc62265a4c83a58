"""Looking up what many documents share, a chunk of documents at a time.

A chunk is a row that holds some megabytes of documents as numbers, and each key that they use
(a word, a pair of ids) once. Keys are looked up by a join of (chunk, place, key) with a table of
keys, and what was found comes back as one array per chunk. So a key comes to the join once per
chunk, however often its documents use it, and neither documents nor tables are broadcast unless
Spark's own size check says so.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_ids():
    """Numbers that no other task of the job gives."""
    number = TaskContext.get().partitionId() << 32
    while True:
        yield number
        number += 1


def with_found(chunks: DataFrame, keys: str, table: DataFrame, key: str, values: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """chunks plus found: of the keys that table (key, *also, *values) holds, (pos, *values) by place; null if none.

    keys names an array column of chunks; also names columns that both sides share.
    """
    each = chunks.select("chunk", *also, F.posexplode(keys).alias("pos", key))
    hits = each.join(table, [key, *also]).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pos", *values))).alias("found"))
    return chunks.drop(keys).join(hits, "chunk", "left")
