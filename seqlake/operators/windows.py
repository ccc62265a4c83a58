"""Windows by record, account, host or source; none runs over the whole log at once.

Orders inside an account or a source go by ranges (``ranges.Keyed``), as one of them may hold most of a log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.functions import scalars as S
from seqlake.operators.ranges import Keyed, numbered_within
from seqlake.schema import RECORD_KEY


def latest_version(log: DataFrame) -> DataFrame:
    """The row of greatest seq per record; an aggregate, so splits combine before the shuffle."""
    rest = [c for c in log.columns if c not in RECORD_KEY]
    best = log.where(S.is_commit()).groupBy(*RECORD_KEY).agg(F.max_by(F.struct(*rest), "seq").alias("v"))
    return best.select(*RECORD_KEY, "v.*").select(*log.columns)


def latest_by_rev(log: DataFrame) -> DataFrame:
    """The row of greatest rev, then seq, per record."""
    rest = [c for c in log.columns if c not in RECORD_KEY]
    best = log.where(S.is_commit()).groupBy(*RECORD_KEY).agg(F.max_by(F.struct(*rest), F.struct("rev", "seq")).alias("v"))
    return best.select(*RECORD_KEY, "v.*").select(*log.columns)


def seq_gaps(feed: DataFrame) -> DataFrame:
    """Gaps of (source, upstream_seq): expected, got and how many were skipped."""
    rows = Keyed(feed.select("source", "upstream_seq"), ["source"], "upstream_seq").previous(F.col("upstream_seq") + 1, "expected")
    return rows.where("upstream_seq > expected").select("source", "expected", F.col("upstream_seq").alias("got"), (F.col("upstream_seq") - F.col("expected")).alias("skipped"))


def check_invariants(log: DataFrame) -> DataFrame:
    """Violations (did, seq, fault): repeated seqs, commits without rev, revs that fall within an account."""
    twice = log.groupBy("seq").agg(F.min("did").alias("did"), F.count("*").alias("n")).where("n > 1").select("did", "seq", F.lit("repeated_seq").alias("fault"))
    none = log.where(S.is_commit() & (F.col("rev") == "")).select("did", "seq", F.lit("commit_without_rev").alias("fault"))
    commits = Keyed(log.where(S.is_commit()).select("did", "seq", "rev"), ["did"], "seq", "rev")
    falls = commits.max_before(F.col("rev"), "_top").where("rev < _top").select("did", "seq", F.lit("rev_falls").alias("fault"))
    return twice.unionByName(none).unionByName(falls)


def drop_stale_revs(log: DataFrame) -> DataFrame:
    """Rows without commits whose rev isn't above all earlier revs of the account."""
    rows = Keyed(log, ["did"], "seq").max_before(F.when(S.is_commit(), F.col("rev")), "_top")
    return rows.where(~F.coalesce(S.is_commit() & (F.col("rev") <= F.col("_top")), F.lit(False))).drop("_top")


def latest_acquisition(jobs: DataFrame) -> DataFrame:
    """The newest job per (pds, source_rev, policy_rev): generation, progress time, id; recoveries don't count."""
    order = Window.partitionBy("pds", "source_rev", "policy_rev").orderBy(F.desc("generation"), F.desc("progress_at"), F.desc("job_id"))
    rows = jobs.where("reason <> 'repository_recovery'")
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def fold_rules(rules: DataFrame) -> DataFrame:
    """Last write wins per (path, scope, cid), in file order."""
    key = [*RECORD_KEY, "scope", "cid"]
    return rules.groupBy(*key).agg(F.max_by("ts", "offset").alias("ts"))


def admit_accounts(accounts: DataFrame, hosts: DataFrame) -> DataFrame:
    """Accounts beyond their host's limit, in uid order, are host-throttled."""
    rows = numbered_within(accounts, "host_id", "uid", "_k").join(hosts.select("host_id", "account_limit"), "host_id")
    return rows.withColumn("admitted_status", F.when(F.col("_k") > F.col("account_limit"), "host-throttled").otherwise("active")).drop("_k")


def reactivate(accounts: DataFrame, limits: DataFrame) -> DataFrame:
    """Throttled accounts that a raised limit (host_id, new_limit) takes back, lowest uid first."""
    waits = (F.col("status") == "host-throttled") & (F.col("upstream_status") == "active")
    rows = accounts.withColumn("_w", F.coalesce(waits, F.lit(False)))
    room = rows.groupBy("host_id").agg(F.count_if(~F.col("_w")).alias("_reserved")).join(limits, "host_id")
    rows = numbered_within(rows.where("_w").drop("_w"), "host_id", "uid", "_k").join(room, "host_id")
    return rows.where(F.col("_k") <= F.col("new_limit") - F.col("_reserved")).drop("_k", "_reserved")


def policy_gaps(policies: DataFrame) -> DataFrame:
    """Per collection, the spans (from_seq, through_seq] of removal; a span still open has no end.

    The policy table has a row per revision of the configuration.
    """
    order = Window.orderBy("revision")
    steps = policies.withColumn("_n", F.row_number().over(order)).withColumn("_at", F.coalesce("effective_after_seq", F.lit(0)))
    names = steps.select(F.explode("collections").alias("collection")).distinct()
    grid = names.crossJoin(F.broadcast(steps.select("_n", "_at", "collections"))).withColumn("_on", F.array_contains("collections", F.col("collection")))
    each = Window.partitionBy("collection").orderBy("_n")
    turns = grid.withColumn("_was", F.lag("_on").over(each)).where("_was IS NOT NULL AND _was <> _on")
    turns = turns.withColumn("through_seq", F.lead("_at").over(each))
    gaps = turns.where("NOT _on").select("collection", (F.col("_at") + 1).alias("from_seq"), "through_seq")
    return gaps.where("through_seq IS NULL OR from_seq <= through_seq")


def recent_errors(repo_status: DataFrame, n: int) -> DataFrame:
    """The n latest errors per host, newest first, as rows."""
    order = Window.partitionBy("pds_host").orderBy(F.desc("updated_at"), "did")
    rows = repo_status.where("last_error IS NOT NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return rows.select("pds_host", "place", "did", "last_error")


def did_timeline(log: DataFrame, did: str, watermark: int) -> DataFrame:
    """One account's events in order, flagged by the watermark."""
    return log.where(F.col("did") == did).withColumn("compacted", F.col("seq") <= watermark).orderBy("seq")


def status_as_of(log: DataFrame) -> DataFrame:
    """The hosting status in force at every event of an account."""
    given = F.when(F.col("kind") == "account", F.when(F.col("account_deleted"), "deleted").otherwise("active"))
    return Keyed(log, ["did"], "seq").last_known(given, "status_as_of")


def coalesce_blocks(blocks: DataFrame) -> DataFrame:
    """Ranges (first_block, last_block, blocks) of the block ids per segment."""
    order = Window.partitionBy("segment").orderBy("block")
    rows = blocks.select("segment", "block").distinct().withColumn("_run", F.col("block") - F.row_number().over(order))
    return rows.groupBy("segment", "_run").agg(F.min("block").alias("first_block"), F.max("block").alias("last_block"), F.count("*").alias("blocks")).drop("_run")


def slow_consumers(progress: DataFrame, lag_threshold: int, min_rate: float, window_s: float) -> DataFrame:
    """Streaks (consumer, streak) far behind for a full window and reading below min_rate.

    progress: (consumer, seen_at seconds, pos, lag). A streak is a run of observations far behind.
    """
    order = Window.partitionBy("consumer").orderBy("seen_at")
    far = F.col("lag") > lag_threshold
    rows = progress.withColumn("_far", far).withColumn("_start", F.when(far & ~F.coalesce(F.lag(far).over(order), F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("streak", F.sum("_start").over(order)).where("_far")
    spans = rows.groupBy("consumer", "streak").agg(F.min("seen_at").alias("since"), F.max("seen_at").alias("until"), F.min("pos").alias("from_pos"), F.max("pos").alias("to_pos"))
    spans = spans.withColumn("rate", F.when(F.col("until") > F.col("since"), (F.col("to_pos") - F.col("from_pos")) / (F.col("until") - F.col("since"))))
    return spans.where((F.col("until") - F.col("since") >= window_s) & (F.col("rate") < min_rate))
