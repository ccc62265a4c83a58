"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` points of a ring; a key starts at its hash and goes to the shard
of the next point clockwise. A shard takes no more than its capacity; keys that meet a full
shard continue clockwise to the next point whose shard has room, so balance is guaranteed and
only overflowing keys leave their home.

The ring is cut into ``cells`` equal hash ranges. Spark counts keys per cell; that table has at
most ``cells`` rows whatever the input's size, and the walk of the overflow over it is done on
counts alone. The resulting plan (cell, from_rank, shard, from_slot) is joined back to the
keys, which take their place by rank inside their cell. Ranks are numbered over ranges of
(cell, hash, id, text, place in the input), so a cell of any size, as of rows that share an id or
have none, is spread over tasks.

Capacities: floor(n / shards), one more for the first n mod shards shards. Their sum is n, so
every shard is filled exactly and counts differ by one at most (law ``rows``).

Defined results: a null text has size 1 and CRC 0 (that of no bytes); rows repeated with the
same id share a cell and get different slots; rows with a null id hash like the empty string;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.operators.ranges import Keyed

CELLS = 1 << 16


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    return sorted((zlib.crc32(f"shard {s} point {v}".encode()) % CELLS, s) for s in range(shards) for v in range(vnodes))


def walk(counts: dict[int, int], capacity: list[int], points: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Place the keys of each cell, clockwise: rows (cell, from_rank, shard, from_slot).

    A cell's keys go to its home shard while that has room; the rest queues and meets the
    following points in turn. Two laps are enough, as the capacities hold all keys.
    """
    places = [p for p, _ in points]
    room, used = list(capacity), [0] * len(capacity)
    by_point: dict[int, list[tuple[int, int]]] = {}
    for cell in sorted(counts):
        by_point.setdefault(bisect.bisect_left(places, cell) % len(points), []).append((cell, counts[cell]))
    plan, queue = [], []
    for lap in range(2):
        for k, (_, shard) in enumerate(points):
            queue += [(cell, 0, n) for cell, n in by_point.get(k, ())] if lap == 0 else []
            if not room[shard]:
                continue
            rest = []
            for cell, rank, n in queue:
                take = min(n, room[shard])
                if take:
                    plan.append((cell, rank, shard, used[shard]))
                    room[shard] -= take
                    used[shard] += take
                if take < n:
                    rest.append((cell, rank + take, n - take))
            queue = rest
    assert not queue
    return plan


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", vnodes: int = 64) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row; slots are gapless from 0 in each shard."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    hashed = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")))
    cell = F.pmod(hashed, F.lit(CELLS)).cast("int")
    counts = {r.cell: r.n for r in rows.select("id").groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    plan = walk(counts, capacity, ring_points(shards, vnodes))
    steps = spark.createDataFrame(plan, "cell int, from_rank long, shard int, from_slot long")
    bounds = steps.withColumn("to_rank", F.lead("from_rank").over(Window.partitionBy("cell").orderBy("from_rank")))
    celled = rows.withColumn("hash", hashed).withColumn("cell", cell).withColumn("row", F.monotonically_increasing_id())
    ranked = Keyed(celled, ["cell"], "hash", "id", "text_crc32", "size", "row").numbered("rank").withColumn("rank", F.col("rank") - 1)
    placed = ranked.join(F.broadcast(bounds), "cell").where("rank >= from_rank AND (to_rank IS NULL OR rank < to_rank)")
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("from_slot") + F.col("rank") - F.col("from_rank")).alias("slot")
    )


def op4_ring_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = shard(docs, 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
