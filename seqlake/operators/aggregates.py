"""Aggregations: directory, activity, archive statistics, backfill and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.functions import scalars as S
from seqlake.operators.filters import DROP_REASONS, small
from seqlake.operators.windows import latest_acquisition

SENTINELS = {"account": "$account", "identity": "$identity", "sync": "$sync"}


def _day(micros):
    return F.to_date(F.timestamp_micros(micros))


def build_directory(log: DataFrame) -> DataFrame:
    """(collection, did, seen_ms): when an account first wrote to a collection."""
    rows = log.where(F.col("kind").isin("create", "update"))
    return rows.groupBy("collection", "did").agg(F.floor(F.min("witnessed_at") / 1000).alias("seen_ms"))


def collection_stats(directory: DataFrame) -> DataFrame:
    return directory.groupBy("collection").agg(F.count("*").alias("dids"))


def cap_collections(directory: DataFrame, most: int) -> DataFrame:
    """At most so many collections per account; the oldest stay."""
    order = Window.partitionBy("did").orderBy("seen_ms", "collection")
    return directory.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")


def dau(log: DataFrame) -> DataFrame:
    """Distinct accounts per day and collection, creates and updates only."""
    rows = log.where(F.col("kind").isin("create", "update")).select(_day(F.col("witnessed_at")).alias("day"), "collection", "did").distinct()
    return rows.groupBy("day", "collection").agg(F.count("*").alias("dids"))


def with_block(log: DataFrame, rows_per_block: int) -> DataFrame:
    """log with its block: a block is a fixed span of seqs."""
    return log.withColumn("block", F.floor((F.col("seq") - 1) / rows_per_block))


def block_index(log: DataFrame, rows_per_block: int = 4096) -> DataFrame:
    """Per block: events, accounts, bounds of seq and time."""
    rows = with_block(log, rows_per_block)
    return rows.groupBy("block").agg(
        F.count("*").alias("events"), F.countDistinct("did").alias("dids"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
        F.min("witnessed_at").alias("min_time"), F.max("witnessed_at").alias("max_time"),
    )


def block_collections(log: DataFrame, rows_per_block: int = 4096) -> DataFrame:
    """(block, collection): what a block mentions, markers as sentinels; one row each, so no set outgrows a row."""
    name = F.when(F.col("kind").isin(list(SENTINELS)), F.concat(F.lit("$"), F.col("kind"))).otherwise(F.col("collection"))
    return with_block(log, rows_per_block).select("block", name.alias("collection")).distinct()


def collection_rollup(log: DataFrame, rows_per_block: int = 4096, blocks_per_segment: int = 4) -> DataFrame:
    """Per collection: events, and the segments and blocks that mention it."""
    rows = with_block(log.where(S.is_commit()), rows_per_block).groupBy("collection", "block").agg(F.count("*").alias("n"))
    rows = rows.withColumn("segment", F.floor(F.col("block") / blocks_per_segment))
    out = rows.groupBy("collection").agg(F.sum("n").alias("events"), F.countDistinct("segment").alias("segments"), F.count("*").alias("blocks"))
    return out.orderBy(F.desc("events"), "collection")


def network_totals(index: DataFrame) -> DataFrame:
    """Totals over block statistics; blocks without events do not pull the bounds."""
    full = F.col("events") > 0
    return index.agg(
        F.sum("events").alias("events"), F.count("*").alias("blocks"), F.min(F.when(full, F.col("min_seq"))).alias("min_seq"),
        F.max(F.when(full, F.col("max_seq"))).alias("max_seq"), F.min(F.when(full, F.col("min_time"))).alias("min_time"), F.max(F.when(full, F.col("max_time"))).alias("max_time"),
    )


def merge_tree_stats(sealed: DataFrame, tail: DataFrame) -> DataFrame:
    """Totals of the sealed index and the tail's statistics together."""
    return network_totals(sealed.unionByName(tail))


def backfill_counts(repo_status: DataFrame) -> DataFrame:
    """Repositories by status; unknown statuses count in the total only."""
    c = lambda s: F.count_if(F.col("backfill_status") == s).alias(s)
    return repo_status.agg(F.count("*").alias("total"), *[c(s) for s in ("pending", "complete", "failed", "not_found")], F.count_if("active").alias("active"))


def host_rollup(repo_status: DataFrame) -> DataFrame:
    """Per host: counts by status, and its latest error with class and class counts (as class:count, sorted)."""
    rows = repo_status.withColumn("error_class", F.when(F.col("last_error").isNotNull(), S.error_class("last_error")))
    base = rows.groupBy("pds_host").agg(
        F.count("*").alias("total"), F.count_if(F.col("backfill_status") == "complete").alias("complete"), F.count_if(F.col("backfill_status") == "failed").alias("failed"),
        F.count_if("active").alias("active"), F.max(F.when(F.col("last_error").isNotNull(), F.struct("updated_at", "did", "last_error", "error_class"))).alias("_e"),
    )
    classes = rows.where("error_class IS NOT NULL").groupBy("pds_host", "error_class").agg(F.count("*").alias("n"))
    classes = classes.groupBy("pds_host").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "error_class", "n"))), ",").alias("error_classes"))
    out = base.join(classes, "pds_host", "left")
    return out.select("pds_host", "total", "complete", "failed", "active", F.col("_e.last_error").alias("last_error"), F.col("_e.error_class").alias("last_class"), "error_classes")


def backfill_progress(repo_status: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """(totals, hosts with most repositories remaining)."""
    left = F.col("backfill_status").isin("pending", "failed") & F.col("active")
    hosts = repo_status.groupBy("pds_host").agg(F.count("*").alias("total"), F.count_if(left).alias("remaining"), F.count_if((F.col("backfill_status") == "failed") & F.col("active")).alias("failed"))
    done = F.sum("total") - F.sum("remaining")
    totals = hosts.agg(
        F.sum("total").alias("total"), done.alias("done"), (100.0 * done / F.sum("total")).alias("percent"),
        F.count_if(F.col("remaining") == 0).alias("drained_hosts"), F.count_if((F.col("remaining") > 0) & (F.col("remaining") == F.col("failed"))).alias("exhausted_hosts"),
    )
    return totals, hosts.where("remaining > 0").orderBy(F.desc("remaining"), "pds_host").limit(top)


def acquisition(details: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """Evidence per job from its repositories; unknown inventories give null, never zero.

    Details are those of a job, or of a key (a column of both) whose jobs share one inventory.
    """
    seen = details.groupBy(key).agg(
        F.count_if(F.col("state") == "completed").alias("scanned"), F.count_if(F.col("matching")).alias("matching"),
        F.count_if(~F.col("matching")).alias("no_match"), F.sum("records").alias("attributable_records"),
    )
    rows = jobs.select(*dict.fromkeys(["job_id", key]), "job_state", F.when(F.col("total_known"), F.col("total_repos")).alias("initial_inventory")).join(small(seen), key, "left")
    state = F.when(F.col("job_state").isin("pending", "running"), "running").when(F.col("job_state") == "incomplete", "stopped_incomplete").otherwise(F.col("job_state"))
    left = F.when(F.col("initial_inventory").isNotNull() & F.col("scanned").isNotNull(), F.greatest(F.lit(0), F.col("initial_inventory") - F.col("scanned")))
    return rows.select("job_id", state.alias("state"), "initial_inventory", "scanned", "matching", "no_match", "attributable_records", left.alias("unresolved"))


def coverage(sources: DataFrame, jobs: DataFrame, policy_rev: int) -> DataFrame:
    """Over all enabled sources: unknown beats incomplete beats complete; no enabled source is unknown."""
    latest = latest_acquisition(jobs.where(F.col("policy_rev") == policy_rev)).select("pds", "source_rev", "job_state", "unresolved")
    rows = sources.where("state = 'enabled'").select("pds", "source_rev").join(latest, ["pds", "source_rev"], "left")
    open_ = F.coalesce((F.col("job_state") != "complete") | (F.coalesce("unresolved", F.lit(0)) > 0), F.lit(True))
    out = rows.agg(F.count("*").alias("enabled_sources"), F.bool_or(F.col("job_state").isNull()).alias("u"), F.bool_or(open_).alias("i"))
    state = F.when((F.col("enabled_sources") == 0) | F.col("u"), "unknown").when(F.col("i"), "incomplete").otherwise("complete")
    return out.select("enabled_sources", state.alias("state"))


def drop_counts(dropped: DataFrame) -> DataFrame:
    """Drops by (source, reason), zeros included."""
    spark = dropped.sparkSession
    all_ = spark.createDataFrame([(s, r) for s in ("live", "backfill") for r in DROP_REASONS], "source string, reason string")
    seen = dropped.groupBy("source", F.col("drop_reason").alias("reason")).agg(F.count("*").alias("n"))
    return F.broadcast(all_).join(seen, ["source", "reason"], "left").select("source", "reason", F.coalesce("n", F.lit(0)).alias("drops"))


def reject_report(rejects: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(counts by reason, the first rejects in file order)."""
    return rejects.groupBy("reason").agg(F.count("*").alias("rejects")), rejects.orderBy("offset").limit(most)


def import_stats(log: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows matched by either scope, and version rules that matched nothing."""
    key = ["did", "collection", "rkey"]
    rows = log.where(S.is_materialization()).select(*key, "cid")
    every = rows.join(rules.where("scope = 'all_versions'").select(*key).distinct(), key, "left_semi").agg(F.count("*").alias("matched_all_versions"))
    one = rules.where("scope = 'specific_version'").select(*key, "cid").distinct()
    hit = rows.join(one, [*key, "cid"], "left_semi").agg(F.count("*").alias("matched_specific"))
    missed = one.join(rows, [*key, "cid"], "left_anti").agg(F.count("*").alias("specific_never_matched"))
    return every.crossJoin(hit).crossJoin(missed)  # three single rows


def lag_summary(matched: DataFrame) -> DataFrame:
    lag = F.abs("lag_us")
    rows = matched.where("lag_us IS NOT NULL")
    return rows.agg(
        F.count("*").alias("matched"), F.count_if(F.col("lag_us") > 0).alias("left_first"), F.count_if(F.col("lag_us") < 0).alias("right_first"),
        F.avg(lag).alias("mean_lag_us"), F.max(lag).alias("max_lag_us"),
    )


def account_counts(accounts: DataFrame) -> DataFrame:
    return accounts.where("upstream_status <> 'deleted'").groupBy("host_id").agg(F.count("*").alias("accounts"))


def traffic_mix(log: DataFrame) -> DataFrame:
    """Events per kind, collection and hour, with their share of all events."""
    rows = log.groupBy("kind", "collection", F.floor(F.col("witnessed_at") / 3_600_000_000).alias("hour")).agg(F.count("*").alias("events"))
    total = log.agg(F.count("*").alias("all_events"))
    return rows.crossJoin(F.broadcast(total)).select("kind", "collection", "hour", "events", (F.col("events") / F.col("all_events")).alias("share"))


def approx_dids(log: DataFrame, error: float = 0.01) -> DataFrame:
    return log.agg(F.approx_count_distinct("did", error).alias("dids"))


def block_sketches(log: DataFrame, rows_per_block: int = 4096, lg_entries: int = 12) -> DataFrame:
    """(block, dids): a theta sketch of each block's accounts, of bounded size. Stored once, it answers for any span of blocks."""
    return with_block(log, rows_per_block).groupBy("block").agg(F.theta_sketch_agg("did", lg_entries).alias("dids"))


def span_sketches(sketches: DataFrame, spans: DataFrame, lg_entries: int = 12) -> DataFrame:
    """(span, dids): the united sketches of the blocks of each span (span, first_block, last_block); spans may overlap."""
    blocks = spans.select("span", F.explode(F.sequence("first_block", "last_block")).alias("block"))
    return sketches.join(blocks, "block").groupBy("span").agg(F.theta_union_agg("dids", lg_entries).alias("dids"))


def span_accounts(spans: DataFrame) -> DataFrame:
    """(span, dids) of united sketches: how many accounts; exact below the sketch's number of entries."""
    return spans.select("span", F.theta_sketch_estimate("dids").alias("dids"))


def shared_accounts(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, shared): how many accounts two spans share, for each of the pairs (a, b)."""
    a, b = (spans.select(F.col("span").alias(c), F.col("dids").alias(f"_{c}")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b")
    return both.select("a", "b", F.theta_sketch_estimate(F.theta_intersection("_a", "_b")).alias("shared"))


def activity_rollup(log: DataFrame) -> DataFrame:
    """Events and accounts per (day, collection), per day and in all, in one pass."""
    rows = log.where(S.is_commit()).withColumn("day", _day(F.col("witnessed_at")))
    out = rows.rollup("day", "collection").agg(F.count("*").alias("events"), F.countDistinct("did").alias("dids"), F.grouping_id().cast("long").alias("level"))
    return out


def inventory_progress(details: DataFrame, now: int, key: str = "job_id") -> DataFrame:
    """Per job, or per key that jobs with one inventory share: totals, and the next deadline with its reason."""
    wait = (F.col("state") == "waiting") & (F.col("due") > now)
    return details.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(F.col("state") == "completed").alias("completed"), F.count_if(F.col("state") == "waiting").alias("waiting"),
        F.min(F.when(wait, F.col("due"))).alias("next_due"), F.min_by("wait_reason", F.when(wait, F.struct("due", "wait_reason"))).alias("next_reason"),
    )


def recovery_scopes(lost: DataFrame, identities: DataFrame, open_jobs: DataFrame) -> DataFrame:
    """(host, did): the accounts to recover per host, with those of the host's open recovery (host, scope array).

    A host may have lost most of its accounts, so a scope is rows, not one array.
    """
    found = lost.select("did").distinct().join(identities.select("did", F.col("pds_host").alias("host")), "did")
    all_ = found.unionByName(open_jobs.select(F.explode("scope").alias("did"), "host")).distinct()
    return all_.join(found.select("host").distinct(), "host", "left_semi").select("host", "did")
