"""State and maintenance jobs over the log. Each can be run again without effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.functions import scalars as S
from seqlake.operators import aggregates as A
from seqlake.operators import windows as W
from seqlake.operators.filters import small, validate_import
from seqlake.operators.folds import fold_tombstones, killed, suppress
from seqlake.operators.joins import merge_live, resolve_imported_time
from seqlake.operators.ranges import Ranged
from seqlake.schema import RECORD_KEY
from seqlake.sources.logs import append_with_seq

MICROS = 1_000_000


def current_state(log: DataFrame) -> DataFrame:
    """Live records: the latest version of each, unless deleted or below an account killer."""
    latest = W.latest_version(log).where("kind <> 'delete'")
    _, dids = fold_tombstones(log)
    dead = dids.select("did", F.col("killer_seq").alias("_dead"))
    return latest.join(dead, "did", "left").where("_dead IS NULL OR seq > _dead").drop("_dead").select(*log.columns)


def repo_snapshot(log: DataFrame, dids: DataFrame | None = None) -> DataFrame:
    """Per account: live records by commits alone, their count, latest rev and a digest of all paths and contents.

    The digest has two steps, so that no row holds a whole account: entries in order are hashed per
    part of the account (the first three hex digits of the path's hash, 4096 at most), and the
    parts' digests in order are hashed per account.
    """
    rows = log if dids is None else log.join(small(dids.select("did").distinct()), "did", "left_semi")
    live = W.latest_version(rows).where("kind <> 'delete'")
    path = F.concat_ws("/", "collection", "rkey")
    entry = F.concat_ws("=", path, F.sha2(F.coalesce("record", F.lit("")), 256))
    hashed = lambda c, sep: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), sep), 256)
    parts = live.groupBy("did", F.substring(F.sha2(path, 256), 1, 3).alias("_part")).agg(F.count("*").alias("records"), hashed(entry, "\n").alias("_d"))
    out = parts.groupBy("did").agg(F.sum("records").alias("records"), hashed(F.concat_ws(":", "_part", "_d"), "\n").alias("digest"))
    revs = rows.where(S.is_commit()).groupBy("did").agg(F.max("rev").alias("rev"))
    return revs.join(out, "did", "left").select("did", "rev", F.coalesce("records", F.lit(0)).alias("records"), "digest")


def compact(log: DataFrame, prev: int, watermark: int) -> DataFrame:
    """The log without rows at or below the watermark that a killer in (prev, watermark] suppresses."""
    records, dids = fold_tombstones(log, prev, watermark)
    old = suppress(log.where(F.col("seq") <= watermark), records, dids)
    return old.unionByName(log.where(F.col("seq") > watermark).select(*old.columns))


def expected_compaction(log: DataFrame, watermark: int) -> DataFrame:
    return compact(log, 0, watermark)


def check_compacted(log: DataFrame, watermark: int) -> DataFrame:
    """Rows at or below the watermark that should be gone; none is right."""
    old = log.where(F.col("seq") <= watermark)
    return killed(old, *fold_tombstones(old)).where("suppressed").drop("suppressed")


def touched_buckets(log: DataFrame, rows_per_bucket: int, prev: int, watermark: int) -> DataFrame:
    """Buckets with a row that compaction removes, and how many: what has to be rewritten."""
    records, dids = fold_tombstones(log, prev, watermark)
    dead = killed(log.where(F.col("seq") <= watermark), records, dids).where("suppressed")
    return A.with_block(dead, rows_per_bucket).groupBy("block").agg(F.count("*").alias("removed"))


def merge_bootstrap(archive: DataFrame, live: DataFrame, repo_status: DataFrame) -> DataFrame:
    """The archive followed by the live rows that the backfill doesn't hold, in their order, with new seqs."""
    kept = merge_live(live, repo_status).withColumnRenamed("seq", "_order")
    return archive.unionByName(append_with_seq(archive, kept, ["_order"]).select(*archive.columns))


def import_timestamps(log: DataFrame, rows: DataFrame) -> DataFrame:
    """log (with cid) with indexed_at patched by valid import rows; no other column changes."""
    rules, _ = validate_import(rows)
    patched = resolve_imported_time(log, W.fold_rules(rules))
    return patched.drop("indexed_at").withColumnRenamed("new_indexed_at", "indexed_at").select(*log.columns)


def touched_by_import(log: DataFrame, rows: DataFrame, rows_per_bucket: int) -> DataFrame:
    """Buckets whose rows change in an import; the others need no rewrite."""
    rules, _ = validate_import(rows)
    changed = resolve_imported_time(log, W.fold_rules(rules)).where("new_indexed_at <> indexed_at")
    return A.with_block(changed, rows_per_bucket).groupBy("block").agg(F.count("*").alias("patched"))


def stamp(new: DataFrame, rules: DataFrame) -> DataFrame:
    """New rows with the rules' times, before they are appended."""
    out = resolve_imported_time(new, rules)
    return out.drop("indexed_at").withColumnRenamed("new_indexed_at", "indexed_at").select(*new.columns)


def reconcile(log: DataFrame, snapshot: DataFrame, collections: list[str]) -> DataFrame:
    """Rows that bring the log to a snapshot (did, snap_rev, collection, rkey, record).

    Newer records come as updates, missing paths as deletes; accounts that are not active, and
    snapshots older than the account's last whole sync, give nothing.
    """
    snap = snapshot.where(F.col("collection").isin(collections))
    heads = snapshot.groupBy("did").agg(F.max("snap_rev").alias("snap_rev"))
    mine = log.join(heads.select("did"), "did", "left_semi")
    last = mine.where("kind = 'account'").groupBy("did").agg(F.max_by("account_deleted", "seq").alias("_gone"))
    syncs = mine.where((F.col("kind") == "sync") & F.col("scope_collections").isNull()).groupBy("did").agg(F.max("rev").alias("_sync"))
    guard = heads.join(last, "did", "left").join(syncs, "did", "left").withColumn("_sync", F.coalesce("_sync", F.lit("")))
    guard = guard.where(~F.coalesce("_gone", F.lit(False)) & (F.col("_sync") <= F.col("snap_rev"))).drop("_gone")
    old = W.latest_by_rev(mine.where(F.col("collection").isin(collections))).select(*RECORD_KEY, F.col("kind").alias("_kind"), F.col("rev").alias("_rev"))
    rows = snap.select(*RECORD_KEY, "record", F.lit(True).alias("_in")).join(old, RECORD_KEY, "full_outer").join(guard, "did")
    upsert = F.col("_in") & (F.col("_rev").isNull() | (F.col("_rev") < F.col("snap_rev")))
    delete = F.col("_in").isNull() & (F.col("_kind") != "delete") & (F.col("_rev") < F.col("snap_rev")) & (F.col("_rev") >= F.col("_sync"))
    kind = F.when(upsert, "update").when(delete, "delete")
    return rows.select("did", kind.alias("kind"), "collection", "rkey", F.col("snap_rev").alias("rev"), "record").where("kind IS NOT NULL")


def advance_boundary(boundaries: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The greatest rev per (did, collection) of old boundaries and a snapshot's."""
    new = snapshot.select("did", "collection", F.col("snap_rev").alias("rev"))
    return boundaries.select("did", "collection", "rev").unionByName(new).groupBy("did", "collection").agg(F.max("rev").alias("rev"))


def expire(index: DataFrame, now_micros: int, window_micros: int) -> DataFrame:
    """Blocks older than the window; the newest one always stays."""
    newest = index.agg(F.max("max_seq").alias("_top"))
    return index.crossJoin(F.broadcast(newest)).where((F.col("max_time") < now_micros - window_micros) & (F.col("max_seq") < F.col("_top"))).drop("_top")


def takedown(log: DataFrame, dids: DataFrame) -> DataFrame:
    return log.join(small(dids.select("did").distinct()), "did", "left_anti")


def buckets_for(index: DataFrame, mentions: DataFrame, collections: list[str], after: int, before: int, keep_markers: bool = True) -> DataFrame:
    """Ranges of blocks that may hold wanted rows; nothing wanted lies outside."""
    names = [*collections, *(A.SENTINELS.values() if keep_markers else [])]
    hit = mentions.where(F.col("collection").isin(names)).select("block").distinct()
    rows = index.where((F.col("max_seq") > after) & (F.col("min_seq") <= before)).join(hit, "block", "left_semi")
    runs = Ranged(rows.select("block", "events"), "block").numbered("_k").groupBy((F.col("block") - F.col("_k")).alias("_run"))
    return runs.agg(F.min("block").alias("first_block"), F.max("block").alias("last_block"), F.sum("events").alias("events")).drop("_run")


def verify_index(log: DataFrame, index: DataFrame, rows_per_block: int) -> DataFrame:
    """Blocks whose stored statistics differ from recomputed ones, or whose seqs overlap the block before."""
    fresh = A.block_index(log, rows_per_block)
    cols = [c for c in fresh.columns if c != "block"]
    both = index.select("block", F.struct(*cols).alias("a")).join(fresh.select("block", F.struct(*cols).alias("b")), "block", "full_outer")
    wrong = both.where(~F.col("a").eqNullSafe(F.col("b"))).select("block", F.lit("statistics").alias("fault"))
    before = index.select((F.col("block") + 1).alias("block"), F.col("max_seq").alias("_max"))
    overlap = index.join(before, "block").where("min_seq <= _max").select("block", F.lit("overlap").alias("fault"))
    return wrong.unionByName(overlap)


def resolve_cursors(cursors: DataFrame, log: DataFrame, index: DataFrame, now_micros: int, floor_seq: int, reject_below_floor: bool = False, rows_per_block: int = 4096) -> DataFrame:
    """(cursor, mode, start_seq, clamped) of a table of cursors.

    Values below 10^15 are seqs, others are times: a time means the first seq witnessed at or after
    it. Only rows that raise the running maximum of time can be such a first one. They lie in blocks
    of the index that raise it, and only those blocks are read. In order of time they are in order of
    seq too, so cursors and these rows are merged by time, and each cursor takes the next row's seq.
    """
    top = index.agg(F.max("max_seq").alias("_top"))
    rows = cursors.select("cursor").distinct().crossJoin(F.broadcast(top))
    as_time = F.col("cursor") >= 10**15
    timed = rows.where(as_time & (F.col("cursor") <= now_micros)).select("cursor")
    blocks = Ranged(index.select("block", "max_time"), "block").running_max(F.col("max_time"), "_reached")
    raising = blocks.groupBy("_reached").agg(F.min("block").alias("block"))
    inside = A.with_block(log.select("seq", "witnessed_at"), rows_per_block).join(raising.select("block"), "block", "left_semi")
    earlier = Ranged(inside, "seq").running_max(F.col("witnessed_at"), "_reached").where("witnessed_at = _reached")
    firsts = earlier.groupBy(F.col("witnessed_at").alias("_at")).agg(F.min("seq").alias("_seq"))
    merged = timed.select(F.col("cursor").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_seq")).unionByName(firsts.select("_at", F.lit(1).alias("_side"), "_seq"))
    firsts = Ranged(merged, "_at", "_side").next_known(F.col("_seq"), "_first").where("_side = 0").select(F.col("_at").alias("cursor"), "_first")
    rows = rows.join(firsts, "cursor", "left")
    live = F.when(as_time, F.col("cursor") > now_micros).otherwise(F.col("cursor") > F.col("_top"))
    raw = F.when(as_time, F.coalesce("_first", F.col("_top") + 1)).otherwise(F.greatest("cursor", F.lit(1)))
    low = raw < floor_seq
    mode = F.when(live, "live").when(~as_time & low & F.lit(reject_below_floor), "too_old").when(as_time, "replay_time").otherwise("replay_seq")
    start = F.when(mode.isin("replay_seq", "replay_time"), F.greatest(raw, F.lit(floor_seq), F.lit(1)))
    clamped = (mode == "live") | (mode.isin("replay_seq", "replay_time") & (low | (F.col("cursor") == 0)))
    return rows.select("cursor", mode.alias("mode"), start.alias("start_seq"), clamped.alias("clamped"))


def history_disclosure(log: DataFrame, attribution: DataFrame, policies: DataFrame) -> DataFrame:
    """What of the history can be told: legacy rows below the first attributed one, and policy gaps."""
    bounds = log.agg(F.min("seq").alias("lo")).crossJoin(attribution.agg(F.min("seq").alias("first")))  # single rows
    none = F.lit(None).cast("string")
    floor = bounds.select(F.lit("replay_floor").alias("reason"), none.alias("collection"), F.col("first").alias("from_seq"), F.lit(None).cast("long").alias("through_seq"))
    legacy = bounds.where("first IS NULL OR lo < first").select(F.lit("legacy-scope-unknown").alias("reason"), none.alias("collection"), F.col("lo").alias("from_seq"), (F.col("first") - 1).alias("through_seq"))
    gaps = W.policy_gaps(policies).select(F.lit("policy-disabled").alias("reason"), "collection", "from_seq", "through_seq")
    return floor.unionByName(legacy).unionByName(gaps)


def retry_due(repo_status: DataFrame, now: int, parked: DataFrame, interval: int, max_delay: int) -> DataFrame:
    """Failed active repositories due for a retry on hosts not parked, and when the next try would follow."""
    due = repo_status.where("backfill_status = 'failed' AND active").where(F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    due = due.withColumn("retry_host", F.coalesce(F.nullif("host", F.lit("")), F.nullif("pds_host", F.lit("")), F.lit("unknown")))
    due = due.join(small(parked.select(F.col("host").alias("retry_host")).distinct()), "retry_host", "left_anti")
    backoff = F.least(F.lit(max_delay), F.lit(interval) * F.pow(F.lit(2.0), F.least("retry_count", F.lit(30)))).cast("long")
    server = F.when(F.col("reset_at") > now, F.least(F.col("reset_at"), F.lit(now + max_delay)))
    return due.select("did", "retry_host", "retry_count", F.coalesce(server, F.lit(now) + backoff).alias("next_attempt"))


def alerts_due(hosts: DataFrame, threshold: float, repeat: int, now: int) -> DataFrame:
    """Hosts to warn about or to report as recovered, with their new state."""
    rows = hosts.where("account_limit > 0 AND status <> 'banned' AND NOT silenced").withColumn("usage", S.usage())
    due = (F.col("alert_state").isNull()) | (F.col("alert_state") != "warning") | F.col("alert_sent_at").isNull() | (F.col("alert_sent_at") <= now - repeat)
    alert = F.when((F.col("usage") >= threshold) & due, "warning").when((F.col("usage") < threshold) & (F.col("alert_state") == "warning"), "ok")
    return rows.select("host_id", "hostname", "usage", alert.alias("new_state"), F.lit(now).alias("alert_sent_at")).where("new_state IS NOT NULL")


def move_accounts(accounts: DataFrame, moves: DataFrame, hosts: DataFrame) -> DataFrame:
    """Accounts on their new hosts (did, new_host_id), with quotas applied again."""
    rows = accounts.join(moves, "did", "left").withColumn("host_id", F.coalesce("new_host_id", "host_id")).drop("new_host_id")
    return W.admit_accounts(rows, hosts)


def audit_repos(snapshot: DataFrame, authoritative: DataFrame) -> DataFrame:
    """match, mismatch or missing per account of an authoritative table (did, rev, digest)."""
    own = snapshot.select("did", F.col("rev").alias("_rev"), F.col("digest").alias("_digest"))
    verdict = F.when(F.col("_rev").isNull(), "missing").when((F.col("rev") == F.col("_rev")) & F.col("digest").eqNullSafe(F.col("_digest")), "match").otherwise("mismatch")
    return authoritative.join(own, "did", "left").select("did", verdict.alias("verdict"))
