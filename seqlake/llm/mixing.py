"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Sources in code point order, null last, weigh 5, 2, 1, repeating; they share
all words by weight. A target stops at ``most`` times its source's size, and the excess is
shared again by weight until none is above.

1. blocks: a source's documents form blocks by a hash, about as many as the square root of all
   rows for a large source, so neither the list of a source's blocks nor a block is large.
2. quota: a target is whole passes over the source, then whole blocks in permuted order, passing
   over those that don't fit, then of the blocks passed over the longest documents that fit,
   equally long ones in permuted order. So no document that is not drawn once more would fit
   under the target. Block draws are units; a source's last documents are one unit more.
3. tree: each node splits its vector of units per source into two halves by one multivariate
   hypergeometric sample, down to the output shards, with exact totals. Sources are dealt to
   ``GROUPS`` groups by hash; the tree splits the groups' totals on the driver (GROUPS numbers
   whatever the number of sources), and a task per group splits its sources' units under these.
4. draw: a source's units in permuted order are cut into disjoint ranges, as many for each shard
   as the tree gave it. A document's draws are the shards whose ranges hold its block.
5. local shuffle: every draw has a place inside its shard.

The driver holds no row per source: order, targets and quotas of the sources are Spark tables.
Everything hangs on the seed and hashes of ids, so reruns agree.

Defined results: a null text has size 0; documents of size 0 are drawn like others and add
nothing; a source without words has target 0; rows repeated with one id are drawn together;
an empty table gives an empty result; other columns are not read. A group may hold 10^9 units
at most (numpy raises above); fewer ``blocks`` make fewer units.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.llm.scratch import Scratch
from seqlake.llm.text import words

GROUPS = 1024
WEIGHTS = (5.0, 2.0, 1.0)


def numbered(rows: DataFrame, scratch: Scratch, *order: Column) -> DataFrame:
    """rows with place, from 0 in the given order: counted per range of the order, numbered inside it."""
    ranged = scratch.save(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = counts.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))  # a row per partition
    inside = Window.partitionBy("_range").orderBy(*order)
    return ranged.join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.row_number().over(inside) - 1).drop("_range", "_before")


def with_targets(sources: DataFrame, most: float = 3.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Sources (place, words, ...) with target: words each should give.

    The share of a unit of weight only rises from round to round, so a source that is capped stays
    capped; a round is one aggregate over the sources, and ends when it caps none anew.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("cap", most * F.col("words"))
    total, unit, capped = float(sources.agg(F.sum("words")).first()[0] or 0), 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * unit if capped >= 0 else F.lit(False)
        found = weighed.agg(
            F.sum(F.when(~over, F.col("weight"))).alias("open"), F.sum(F.when(over, F.col("cap"))).alias("given"), F.count(F.when(over, 1)).alias("capped")
        ).first()
        if found.capped == capped or not found.open:
            break
        unit, capped = (total - (found.given or 0.0)) / found.open, found.capped
    return weighed.withColumn("target", F.least("cap", F.col("weight") * unit)).drop("weight", "cap")


def split_draws(draws: np.ndarray, totals: list[int], rng: np.random.Generator) -> np.ndarray:
    """(shards, kinds): a table whose columns sum to draws and whose rows sum to totals, from the splitting tree."""
    out = np.zeros((len(totals), len(draws)), np.int64)

    def deal(first: int, last: int, have: np.ndarray) -> None:
        if last - first == 1:
            out[first] = have
            return
        middle = (first + last) // 2
        left = rng.multivariate_hypergeometric(have, sum(totals[first:middle]), method="marginals") if have.sum() else have
        deal(first, middle, left)
        deal(middle, last, have - left)

    deal(0, len(totals), np.asarray(draws, np.int64))
    return out


def _split_group(seed: int):
    """Of a group of sources: which units of each source go to which shard, as running totals by shard."""

    def run(sources: pa.Table) -> pa.Table:
        sources = sources.sort_by([("key", "ascending")])
        dealt = split_draws(sources["units"].to_numpy(), sources["totals"][0].as_py(), np.random.default_rng([seed, sources["grp"][0].as_py()]))
        return sources.select(["key"]).append_column("upper", pa.array(np.cumsum(dealt, axis=0).T.tolist(), pa.list_(pa.int64())))

    return run


def dealt_units(units: DataFrame, shards: int, seed: int, scratch: Scratch) -> DataFrame:
    """(key, upper: array by shard): source key's units from upper[s - 1] up to upper[s] go to shard s."""
    spark = units.sparkSession
    grouped = scratch.save(units.withColumn("grp", F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int")), "units")
    totals = {r.grp: r.units for r in grouped.groupBy("grp").agg(F.sum("units").alias("units")).collect()}  # GROUPS rows at most
    groups = sorted(totals)
    whole = sum(totals.values())
    even = [whole * (s + 1) // shards - whole * s // shards for s in range(shards)]
    dealt = split_draws(np.array([totals[g] for g in groups], np.int64), even, np.random.default_rng(seed))
    table = spark.createDataFrame([(g, dealt[:, k].tolist()) for k, g in enumerate(groups)], "grp int, totals array<long>")
    return grouped.join(F.broadcast(table), "grp").groupBy("grp").applyInArrow(_split_group(seed), "key string, upper array<long>")


def _sized(batches):
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for w in words(batch.column(2)):
            size[w.rows] = np.diff(w.first)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size)], ["id", "source", "size"])


def _fit_blocks(blocks: pa.Table) -> pa.Table:
    """A source's blocks, which of them are drawn whole once more, and the room that this leaves."""
    blocks = blocks.sort_by([("turn", "ascending"), ("block", "ascending")])
    room, whole, missed = blocks["rest"][0].as_py(), [], False
    for size in blocks["words"].to_pylist():
        whole.append(size <= room and (size > 0 or not missed))  # empty blocks only before the first that doesn't fit
        missed |= not whole[-1]
        room -= size if whole[-1] else 0
    kept = blocks.select(["key", "block", "passes", "source_size", "target"])
    return kept.append_column("whole", pa.array(whole)).append_column("room", pa.array([room] * len(whole), pa.float64()))


def _fit_sizes(sizes: pa.Table) -> pa.Table:
    """How many documents of each size a source's room takes, the longest first."""
    sizes = sizes.sort_by([("size", "descending")])
    room, take = sizes["room"][0].as_py(), []
    for size, documents in zip(sizes["size"].to_pylist(), sizes["documents"].to_pylist()):
        take.append(min(documents, int(room // size)))
        room -= take[-1] * size
    take = pa.array(take, pa.int64())
    return sizes.select(["key", "size"]).append_column("take", take).filter(pc.greater(take, 0))


def mix(
    docs: DataFrame, shards: int = 16, seed: int = 17, most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    blocks: int | None = None,
) -> DataFrame:
    """One row per input row: (id, source, size, source_size, target, draws, places).

    draws names the shards that drew the row, once per draw, and places its place in each of them.
    blocks is the number of blocks of a large source, by default the square root of all rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    rows = scratch.save(rows.mapInArrow(_sized, "id long, source string, size long"), "sizes")
    blocks = blocks or max(1, round(rows.count() ** 0.5))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    rows = rows.withColumn("key", key).withColumn("hash", F.xxhash64(F.lit(seed), "id")).withColumn("block", F.pmod(F.shiftright("hash", 20), F.lit(blocks)).cast("int"))
    by_block = scratch.save(rows.groupBy("key", "source", "block").agg(F.sum("size").alias("words")), "blocks")

    sources = scratch.save(by_block.groupBy("key", "source").agg(F.sum("words").alias("words")), "sources")
    sources = scratch.save(numbered(sources, scratch, F.col("source").isNull(), F.col("source")), "places")
    goal = with_targets(sources, most).select("key", F.col("words").alias("source_size"), "target")
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(int(most)), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    rest = F.when(F.col("passes") < most, F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))).otherwise(0.0)
    goal = goal.withColumn("passes", passes).withColumn("rest", rest)

    turn = F.xxhash64(F.lit(seed + 1), "block")
    filled = by_block.join(goal, "key").select("key", "block", "words", "passes", "rest", "source_size", "target", turn.alias("turn"))
    filled = filled.groupBy("key").applyInArrow(_fit_blocks, "key string, block int, passes int, source_size long, target double, whole boolean, room double")
    filled = scratch.save(filled, "filled")

    # Joins of documents go by (source, block): no key of theirs is hot.
    passed = filled.where("NOT whole AND room > 0").select("key", "block", "room")
    left = rows.join(passed, ["key", "block"]).groupBy("key", "block", "hash", "id").agg(F.sum("size").alias("size"), F.max("room").alias("room"))
    left = scratch.save(left.where("size > 0 AND size <= room"), "left")
    counts = scratch.save(left.groupBy("key", "size", "block").agg(F.count("*").alias("documents"), F.max("room").alias("room")), "counts")
    wanted = counts.groupBy("key", "size").agg(F.sum("documents").alias("documents"), F.max("room").alias("room"))
    wanted = scratch.save(wanted.groupBy("key").applyInArrow(_fit_sizes, "key string, size long, take long"), "wanted")
    permuted = Window.partitionBy("key", "size").orderBy(turn, "block")
    quota = counts.drop("room").join(wanted, ["key", "size"]).withColumn("quota", F.col("take") - F.sum("documents").over(permuted) + F.col("documents"))
    within = Window.partitionBy("key", "size", "block").orderBy("hash", "id")
    last = left.drop("room").join(quota.where("quota > 0").drop("take", "documents"), ["key", "size", "block"]).withColumn("number", F.row_number().over(within))
    last = last.where("number <= quota").select("key", "block", F.col("id").alias("last_id"))

    times = F.col("passes") + F.col("whole").cast("int")
    units = filled.where(times > 0).select("key", "block", F.explode(F.sequence(F.lit(1), times)).alias("pass"))
    units = scratch.save(units.unionByName(wanted.select("key").distinct().select("key", F.lit(-1).alias("block"), F.lit(0).alias("pass"))), "draws")
    upper = dealt_units(units.groupBy("key").agg(F.count("*").alias("units")), shards, seed, scratch)
    shuffled = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 2), "pass", "block"), "pass", "block")
    drawn = units.withColumn("draw", F.row_number().over(shuffled) - 1).join(upper, "key")
    drawn = drawn.withColumn("shard", F.size(F.filter("upper", lambda u: u <= F.col("draw")))).where(F.col("shard") < shards)
    drawn = scratch.save(drawn.groupBy("key", "block").agg(F.array_sort(F.collect_list("shard")).alias("shards")), "drawn")
    last = scratch.save(last.join(drawn.where("block < 0").select("key", F.col("shards")[0].alias("last_shard")), "key"), "last")
    scratch.drop(by_block, left, counts, wanted, units)

    known = filled.select("key", "block", "source_size", "target").join(drawn, ["key", "block"], "left")
    out = rows.join(known, ["key", "block"])
    same_row = (out["key"] == last["key"]) & (out["block"] == last["block"]) & out["id"].eqNullSafe(last["last_id"])
    out = out.join(last, same_row, "left").drop(last["key"], last["block"])
    given = F.coalesce("shards", F.array().cast("array<int>"))
    draws = F.when(F.col("last_shard").isNull(), given).otherwise(F.array_append(given, F.col("last_shard")))
    places = F.transform("draws", lambda s, copy: F.xxhash64(F.lit(seed + 3), s, copy, "id"))
    out = out.withColumn("draws", draws).withColumn("places", places)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "draws", "places")


def place(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: (id, copy, shard, place), a row per draw; sort a shard by place to shuffle it."""
    each = mixed.select(id_col, F.posexplode(F.arrays_zip("draws", "places")).alias("copy", "x"))
    return each.select(id_col, "copy", F.col("x.draws").alias("shard"), F.col("x.places").alias("place"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.col("draws").alias("shards"), "places")
