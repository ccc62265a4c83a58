"""A log in buckets of seqs, of which jobs rewrite those that they change.

A bucket holds a fixed span of seqs and lies whole in one file, which many buckets share: files follow
the rows, not the buckets. A generation's manifest (a row per bucket: version, events, bounds of
seq and time, file) says which generation wrote a bucket last, and where. A job writes new versions
of some buckets, then a manifest, and publishes it by one rename, so a crash before that leaves the
old log, and readers of a generation never see another. Generations that no reader needs are deleted
by ``vacuum``, which moves the buckets that are still named out of files that hold others; where
they went is a table of its own (``moved``, published like a manifest).

Two indexes say which buckets may hold wanted rows. ``mentions`` has the kinds and collections of
each bucket. ``accounts`` has, per slot of hashed accounts, words of bits: a word has a bit for each of
64 neighbouring buckets, set where one of the accounts is; those of several slots are united by bit_or. Rewrites
take rows away or patch times, so both stay right without being written again: nothing wanted lies outside.

Manifests and sets of buckets are tables; the driver holds a row per file, and a row per bucket only
where a caller asks for a set. Rows of the log stay in Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from seqlake.functions import scalars as S
from seqlake.operators import windows as W
from seqlake.operators.filters import validate_import
from seqlake.operators.folds import fold_tombstones, killed
from seqlake.operators.joins import resolve_imported_time
from seqlake.scratch import delete, exists, stored

MANIFEST = "bucket long, version int, events long, min_seq long, max_seq long, min_time long, max_time long, file string"
MOVED = "bucket long, version int, file string"
BOUNDS = {"min_seq": F.min, "max_seq": F.max, "min_time": F.min, "max_time": F.max}
FOLDER = "_gen"  # data/_gen=3 holds what generation 3 wrote
EXTENT = 1 << 17  # seqs whose buckets are written by one task
WORD = 64  # buckets of a word of the accounts' index
SMALL = 1 << 20  # named buckets that are broadcast at most
ACCOUNTS = 1 << 18  # accounts that are broadcast at most


def sent(accounts: DataFrame) -> DataFrame:
    """A stored table of accounts, broadcast if it is counted as short enough; else Spark's size check picks the joins."""
    return F.broadcast(accounts) if accounts.count() <= ACCOUNTS else accounts


class BucketedLog:
    """The log at path; of a generation, or of the newest one at the time of each call."""

    def __init__(self, spark: SparkSession, path: str, rows_per_bucket: int = 1 << 20, slots: int = 1 << 16):
        self.spark, self.path, self.span, self.slots = spark, path.rstrip("/"), rows_per_bucket, slots

    # ---- layout

    def _bucket(self) -> Column:
        return F.floor((F.col("seq") - 1) / self.span).cast("long")

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64("did"), F.lit(self.slots)).cast("int")

    def _generations(self, folder: str) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[4:]) for n in names if n.startswith("gen="))

    def generation(self) -> int:
        """The newest published generation; -1 before the first."""
        return max(self._generations("manifest"), default=-1)

    def manifest(self, generation: int | None = None) -> DataFrame:
        generation = self.generation() if generation is None else generation
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/gen={generation}")
        moves = self._generations("moved")
        if not moves:
            return rows
        moved = self.spark.read.schema(MOVED).parquet(f"{self.path}/moved/gen={moves[-1]}").withColumnRenamed("file", "_moved")
        return rows.join(moved, ["bucket", "version"], "left").withColumn("file", F.coalesce("_moved", "file")).select(*rows.columns)

    def versions(self, generation: int | None = None) -> dict[int, int]:
        """{bucket: generation that wrote it last}."""
        return {r.bucket: r.version for r in self.manifest(generation).select("bucket", "version").collect()}

    def _some(self, buckets: set[int] | DataFrame) -> DataFrame:
        """A set of buckets as a table."""
        if isinstance(buckets, DataFrame):
            return buckets.select("bucket")
        return stored(self.spark.createDataFrame([(b,) for b in buckets], "bucket long"), "buckets")

    def _rows(self, named: DataFrame) -> DataFrame:
        """Rows of these buckets (bucket, file); only files that hold one of them are touched.

        A folder holds a bucket once, so a row is known by its bucket and its folder's number.
        """
        folder = F.regexp_extract("file", f"^{FOLDER}=(-?[0-9]+)/", 1).cast("int")
        named = stored(named.select("bucket", folder.alias(FOLDER), "file"), "named")
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        files = named.groupBy("file").count().collect()
        if not files:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(StructType([*schema.fields, StructField(FOLDER, IntegerType())])).option("basePath", f"{self.path}/data")
        rows = rows.parquet(*[f"{self.path}/data/{r.file}" for r in files]).withColumn("bucket", self._bucket())
        named = named.select("bucket", FOLDER)
        named = F.broadcast(named) if sum(r["count"] for r in files) <= SMALL else named
        return rows.join(named, ["bucket", FOLDER], "left_semi").select(schema.names)

    def read(self, generation: int | None = None, buckets: set[int] | DataFrame | None = None, after: int = 0, before: int | None = None) -> DataFrame:
        """Rows of a generation, of some buckets only, in a window of seqs; files without one of these buckets are not touched."""
        named = self.manifest(generation).where(F.col("bucket") >= after // self.span)
        named = named if before is None else named.where(F.col("bucket") <= (before - 1) // self.span)
        named = named if buckets is None else named.join(self._some(buckets), "bucket", "left_semi")
        rows = self._rows(named).where(F.col("seq") > after)
        return rows if before is None else rows.where(F.col("seq") <= before)

    # ---- writing

    def _folder(self, number: int) -> str:
        """Generations write to folders of their own numbers, vacuum to those below 0."""
        return f"{self.path}/data/{FOLDER}={number}"

    def _write(self, rows: DataFrame, folder: int, mode: str = "overwrite") -> None:
        """Write the buckets of rows to a folder.

        A task writes the buckets of some extents to one file, and AQE gives small extents to one task.
        """
        extent = F.floor((F.col("seq") - 1) / self.span / max(1, EXTENT // self.span))
        rows.repartition(extent).sortWithinPartitions("seq").write.mode(mode).option("compression", "zstd").parquet(self._folder(folder))

    def _sums(self, folder: int, *also: Column) -> DataFrame:
        """Events and bounds per bucket of a folder, its file, and what else rows are told apart by."""
        back = self.spark.read.schema("seq long, witnessed_at long, kind string, collection string").parquet(self._folder(folder))
        return back.groupBy(self._bucket().alias("bucket"), F.col("_metadata.file_name").alias("_name"), *also).agg(
            F.count("*").alias("events"), *[f("seq" if "seq" in c else "witnessed_at").alias(c) for c, f in BOUNDS.items()]
        )

    def _told(self, folder: int, version: int, sums: DataFrame | None = None) -> DataFrame:
        """Manifest rows of the buckets in a folder, from its sums where they are known."""
        told = self._sums(folder)
        if sums is not None:
            told = sums.groupBy("bucket", "_name").agg(F.sum("events").alias("events"), *[f(c).alias(c) for c, f in BOUNDS.items()])
        file = F.concat(F.lit(f"{FOLDER}={folder}/"), "_name")
        return stored(told.select("*", F.lit(version).alias("version"), file.alias("file")).select([c.split()[0] for c in MANIFEST.split(", ")]), "told")

    def _publish(self, rows: DataFrame, generation: int, folder: str = "manifest") -> None:
        """Make rows the manifest of a generation, by one rename."""
        path = f"{self.path}/{folder}/gen={generation}"
        if exists(self.spark, path):
            raise ValueError(f"generation {generation} is published already: another job was faster")
        hidden = f"{self.path}/{folder}/_{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(hidden)
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        if not fs_path(hidden).getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(fs_path(hidden), fs_path(path)):
            raise ValueError(f"generation {generation} could not be published")

    def _index(self, sums: DataFrame, generation: int) -> None:
        """Write both indexes of a generation that was appended."""
        sums.select("bucket", "kind", "collection").distinct().write.mode("overwrite").parquet(f"{self.path}/mentions/gen={generation}")
        rows = self.spark.read.schema("seq long, did string").parquet(self._folder(generation))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bucket") % WORD).cast("int"))
        rows = rows.select(self._slot().alias("slot"), self._bucket().alias("bucket")).groupBy("slot", F.floor(F.col("bucket") / WORD).alias("word"))
        rows.agg(F.bit_or(bit).alias("bits")).write.mode("overwrite").parquet(f"{self.path}/accounts/gen={generation}")

    def append(self, rows: DataFrame) -> int:
        """Add rows, computed and written once; files with buckets that hold some already are written again with both. The new generation."""
        old, new = self.generation(), self.generation() + 1
        if old < 0:
            rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema")
        self._write(rows, new)
        sums = stored(self._sums(new, S.kind_class().alias("kind"), F.col("collection")), "sums")
        self._index(sums, new)
        told = self._told(new, new, sums)
        if old < 0:
            self._publish(told, new)
            return new
        before = self.manifest(old)
        shared = stored(before.join(told.select("bucket"), "bucket", "left_semi"), "shared")
        if not shared.isEmpty():
            stale = told.join(shared.select("bucket"), "bucket", "left_semi").select("file").distinct()
            mixed = stored(told.join(stale, "file", "left_semi"), "mixed")
            self._write(self._rows(mixed.unionByName(shared)), new, "append")
            delete(self.spark, *[f"{self.path}/data/{r.file}" for r in mixed.select("file").distinct().collect()])
            told = self._told(new, new)
        self._publish(before.join(told, "bucket", "left_anti").unionByName(told), new)
        return new

    def rewrite(self, buckets: set[int] | DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Write these buckets again as change leaves their rows; the new generation, or the old one if there is none to write."""
        old, buckets = self.generation(), self._some(buckets)
        if buckets.isEmpty():
            return old
        self._write(change(self.read(old, buckets)), old + 1)
        told = self._told(old + 1, old + 1)
        self._publish(self.manifest(old).join(buckets, "bucket", "left_anti").unionByName(told), old + 1)
        return old + 1

    def vacuum(self, keep: int = 2) -> None:
        """Forget all but the newest generations and delete bucket versions that none of these names."""
        every = self._generations("manifest")
        kept, gone = every[-keep:], every[:-keep]
        if not gone:
            return
        told = lambda gs: reduce(DataFrame.union, [self.manifest(g).select("bucket", "version", "file") for g in gs]).distinct()
        lost = stored(told(gone).join(told(kept), ["bucket", "version"], "left_anti").select("file").distinct(), "lost")
        for g in kept:
            self._move(stored(self.manifest(g).join(lost, "file", "left_semi"), "mixed"))
        delete(self.spark, *[f"{self.path}/data/{r.file}" for r in lost.collect()])
        delete(self.spark, *[f"{self.path}/manifest/gen={g}" for g in gone])

    def _move(self, named: DataFrame) -> None:
        """Write these buckets to new files, as they are and under their versions, and tell where they are."""
        if named.isEmpty():
            return
        moves = self._generations("moved")
        new = max(moves, default=-1) + 1
        self._write(self._rows(named), -1 - new)
        places = self._told(-1 - new, new).select("bucket", "file")
        places = named.select("bucket", "version").join(places, "bucket").select("bucket", "version", "file")
        if moves:
            before = self.spark.read.schema(MOVED).parquet(f"{self.path}/moved/gen={moves[-1]}")
            places = places.unionByName(before.join(named, ["bucket", "version"], "left_anti"))
        self._publish(places, new, "moved")

    # ---- planning

    def _of_accounts(self, dids: DataFrame) -> DataFrame:
        """Buckets that may hold one of these accounts: the united words of the accounts' slots."""
        slots = dids.select(self._slot().alias("slot")).distinct()
        index = self.spark.read.schema("slot int, word long, bits long").parquet(f"{self.path}/accounts")
        words = index.join(slots, "slot", "left_semi").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        each = words.select("word", "bits", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("bit"))
        held = each.where(F.call_function("shiftright", "bits", "bit").bitwiseAND(1) == 1)
        return held.select((F.col("word") * WORD + F.col("bit")).alias("bucket"))

    def with_accounts(self, dids: DataFrame) -> set[int]:
        """Buckets that may hold one of these accounts, as a set."""
        return {r.bucket for r in self._of_accounts(dids).collect()}

    def _of_kinds(self, kinds: list[str] | None, collections: list[str] | None) -> DataFrame:
        """Buckets with rows of these public kinds; collections bind commits only."""
        rows = self.spark.read.schema("bucket long, kind string, collection string").parquet(f"{self.path}/mentions")
        rows = rows.where(F.col("kind").isin(kinds)) if kinds else rows
        rows = rows.where((F.col("kind") != "commit") | F.col("collection").isin(collections)) if collections else rows
        return rows.select("bucket").distinct()

    def with_kinds(self, kinds: list[str] | None, collections: list[str] | None) -> set[int]:
        """Buckets with rows of these public kinds, as a set."""
        return {r.bucket for r in self._of_kinds(kinds, collections).collect()}

    def plan(self, dids: DataFrame | None = None, kinds: list[str] | None = None, collections: list[str] | None = None, after: int = 0, before: int | None = None) -> DataFrame:
        """Manifest rows of the buckets that may hold wanted rows; nothing wanted lies outside."""
        rows = self.manifest().where(F.col("max_seq") > after)
        rows = rows if before is None else rows.where(F.col("min_seq") <= before)
        if kinds or collections:
            rows = rows.join(self._of_kinds(kinds, collections), "bucket", "left_semi")
        return rows if dids is None else rows.join(self._of_accounts(dids), "bucket", "left_semi")

    # ---- jobs; each can be run again without effect

    def compact(self, prev: int, watermark: int) -> tuple[int, DataFrame]:
        """Remove rows at or below the watermark that a killer in (prev, watermark] suppresses.

        Killers come from the window's buckets; of the others, those are read that may hold their
        accounts. (the generation, (bucket, removed) of the buckets that were written again.)
        """
        window = self.read(after=prev, before=watermark)
        records, dids = (stored(x.drop("reason"), "killers") for x in fold_tombstones(window, prev, watermark))
        planned = self.plan(records.select("did").unionByName(dids.select("did")), before=watermark)
        dids = sent(dids)
        of = lambda rows: killed(rows, records, dids).withColumn("suppressed", F.col("suppressed") & (F.col("seq") <= watermark))
        removed = stored(of(self.read(buckets=planned)).where("suppressed").groupBy(self._bucket().alias("bucket")).agg(F.count("*").alias("removed")), "removed")
        keep = lambda rows: of(rows).where("NOT suppressed").select(*rows.columns)
        return self.rewrite(removed, keep), removed

    def takedown(self, dids: DataFrame) -> int:
        """Remove all rows of these accounts."""
        dids = sent(stored(dids.select("did").distinct(), "taken"))
        rows = self.read(buckets=self.plan(dids)).join(dids, "did", "left_semi")
        touched = stored(rows.select(self._bucket().alias("bucket")).distinct(), "touched")
        return self.rewrite(touched, lambda x: x.join(dids, "did", "left_anti").select(*x.columns))

    def import_timestamps(self, rows: DataFrame) -> int:
        """Patch indexed_at (and nothing else) by valid import rows; only buckets with a row that changes are written."""
        rules = stored(W.fold_rules(validate_import(rows)[0]), "rules")
        patched = lambda x: resolve_imported_time(x, rules)
        changed = patched(self.read(buckets=self.plan(rules))).where("new_indexed_at <> indexed_at")
        touched = stored(changed.select(self._bucket().alias("bucket")).distinct(), "touched")
        return self.rewrite(touched, lambda x: patched(x).drop("indexed_at").withColumnRenamed("new_indexed_at", "indexed_at").select(*x.columns))

    def expire(self, now_micros: int, window_micros: int) -> int:
        """Drop buckets whose rows are all older than the window; the newest one stays. No file is read or written but the manifest."""
        old, rows = self.generation(), self.manifest()
        newest = rows.agg(F.max("bucket")).first()[0]
        kept = rows.where((F.col("max_time") >= now_micros - window_micros) | (F.col("bucket") == newest))
        if kept.count() == rows.count():
            return old
        self._publish(kept, old + 1)
        return old + 1
