"""Joins between the log, accounts, hosts and other side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.functions import scalars as S
from seqlake.operators.filters import account_status, is_denied
from seqlake.schema import RECORD_KEY
from seqlake.scratch import stored

COMPARED = ["did", "rev", "operation", "collection", "rkey"]


def accounts_detailed(accounts: DataFrame, repos: DataFrame, cursor: int = 0, limit: int = 500) -> DataFrame:
    """Active accounts with their repository, uid order."""
    rows = accounts.where((F.col("status") == "active") & (F.col("upstream_status") == "active") & (F.col("uid") > cursor))
    return rows.join(repos, "uid").orderBy("uid").limit(limit)


def admitted_hosts(hosts: DataFrame, sources: DataFrame) -> DataFrame:
    """Hosts with an enabled, validated source, not banned."""
    ok = sources.where((F.col("state") == "enabled") & (F.col("validation_status") == "validated")).select("host_id")
    return hosts.where(F.col("status") != "banned").join(ok, "host_id", "left_semi")


def source_accounts(observations: DataFrame, accounts: DataFrame, hosts: DataFrame, sources: DataFrame) -> DataFrame:
    """Observed accounts with their current placement; coverage is incomplete if the resolved host is admitted."""
    host = hosts.select(F.col("host_id").alias("current_host_id"), F.col("hostname").alias("current_hostname"))
    placed = accounts.select("did", F.col("host_id").alias("current_host_id"), F.col("status").alias("current_status"))
    admitted = admitted_hosts(hosts, sources).select(F.col("hostname").alias("resolved_hostname"), F.lit(True).alias("_in"))
    rows = observations.join(placed, "did", "left").join(host, "current_host_id", "left").join(admitted, "resolved_hostname", "left")
    coverage = F.when(F.col("_in"), "incomplete").otherwise("unknown")
    reason = F.when(F.col("current_status") == "host-throttled", "host_account_limit")
    return rows.withColumn("target_coverage", coverage).withColumn("admission_reason", reason).drop("_in")


def merge_live(live: DataFrame, repo_status: DataFrame) -> DataFrame:
    """Live rows that a complete backfill doesn't hold already: rev above the backfilled one; an empty rev stays."""
    done = repo_status.where("backfill_status = 'complete'").select("did", F.col("backfill_rev").alias("_rev"))
    held = (S.is_commit() | (F.col("kind") == "sync")) & (F.col("rev") != "") & (F.col("rev") <= F.col("_rev"))
    return live.join(done, "did", "left").where(~F.coalesce(held, F.lit(False))).drop("_rev").select(*live.columns)


def resolve_imported_time(log: DataFrame, rules: DataFrame) -> DataFrame:
    """log (with cid) plus new_indexed_at: a rule for the version beats one for all versions; others keep their time."""
    every = rules.where("scope = 'all_versions'").select(*RECORD_KEY, F.col("ts").alias("_every"))
    one = rules.where("scope = 'specific_version'").select(*RECORD_KEY, "cid", F.col("ts").alias("_one"))
    rows = log.join(every, RECORD_KEY, "left").join(one, [*RECORD_KEY, "cid"], "left")
    new = F.when(S.is_materialization(), F.coalesce("_one", "_every"))
    return rows.withColumn("new_indexed_at", F.coalesce(new, "indexed_at")).drop("_every", "_one")


def compare_streams(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two captures (did, rev, operation, collection, rkey, payload, time_us) matched on their key."""
    one, two = (x.groupBy(*COMPARED).agg(F.min_by("payload", "time_us").alias("payload" + k), F.min("time_us").alias("time" + k)) for x, k in ((a, "_a"), (b, "_b")))
    rows = one.join(two, COMPARED, "full_outer")
    outcome = F.when(F.col("time_b").isNull(), "only_left").when(F.col("time_a").isNull(), "only_right").when(~F.col("payload_a").eqNullSafe(F.col("payload_b")), "payload_mismatch").otherwise("common")
    return rows.select(*COMPARED, outcome.alias("outcome"), (F.col("time_b") - F.col("time_a")).alias("lag_us"))


def resolve_handles(queries: DataFrame, identities: DataFrame) -> DataFrame:
    """queries (handle) with the did of the latest identity event of the handle, case ignored."""
    known = identities.where("handle IS NOT NULL").groupBy(F.lower("handle").alias("_h")).agg(F.max_by("did", "seq").alias("did"))
    return queries.withColumn("_h", F.lower("handle")).join(known, "_h", "left").drop("_h")


def attach_attribution(log: DataFrame, attribution: DataFrame) -> DataFrame:
    """log with stream_id, policy_rev, provenance; rows without one are legacy-unknown."""
    rows = log.join(attribution, "seq", "left")
    return rows.withColumn("provenance", F.coalesce("provenance", F.lit("legacy-unknown")))


def drop_superseded(new: DataFrame, boundaries: DataFrame) -> DataFrame:
    """new without commits at or below the snapshot boundary (did, collection, rev) of their collection."""
    bound = boundaries.select("did", "collection", F.col("rev").alias("_bound"))
    old = S.is_commit() & F.coalesce(F.col("rev") <= F.col("_bound"), F.lit(False))
    return new.join(bound, ["did", "collection"], "left").where(~old).drop("_bound").select(*new.columns)


def rejection_key(host, position, kind, policy):
    return F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c for c in (host, position, kind, policy)])


def skip_rejected(events: DataFrame, rejected: DataFrame, policy_rev: int) -> DataFrame:
    """events (host_id, position, kind) not yet rejected under this policy revision."""
    keyed = events.withColumn("idempotency_key", rejection_key("host_id", "position", "kind", F.lit(policy_rev).cast("string")))
    return keyed.join(rejected.select("idempotency_key").distinct(), "idempotency_key", "left_anti")


def check_source_host(events: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): an event's source must be the host that its account resolves to."""
    rows = events.join(identities.select("did", "resolved_host_id"), "did", "left")
    same = F.coalesce(F.col("host_id") == F.col("resolved_host_id"), F.lit(False))
    return rows.where(same), rows.where(~same).withColumn("reason", F.when(F.col("resolved_host_id").isNull(), "unresolved").otherwise("host_mismatch"))


def discover_hosts(
    observed: DataFrame, identities: DataFrame, sources: DataFrame, attempted: DataFrame, host_status: DataFrame,
    retained: list[str], deny: list[str], threshold: int,
) -> DataFrame:
    """One row per candidate origin with its outcome and the account limit to ask for."""
    dids = observed.where(F.col("collection").isin(retained)).select("did").distinct()
    found = dids.join(identities.select("did", "pds_endpoint"), "did", "left").withColumn("origin", S.normalize_origin("pds_endpoint"))
    found = found.withColumn("state", F.when(F.col("pds_endpoint").isNull(), "resolve_failed").when(F.col("origin").isNull(), "invalid_pds"))
    rows = found.groupBy("origin", "state").agg(F.count("*").alias("dids"))
    rows = rows.withColumn("host", F.regexp_replace("origin", "^https://", ""))
    rows = rows.join(sources.select("origin", F.lit(True).alias("_known")).distinct(), "origin", "left")
    rows = rows.join(attempted.select("origin", F.lit(True).alias("_tried")).distinct(), "origin", "left")
    rows = rows.join(host_status.select(F.col("hostname").alias("host"), F.col("status").alias("upstream"), F.col("account_count").alias("_count")), "host", "left")
    outcome = (
        F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("_known"), "known").when(is_denied("host", deny), "denied")
        .when(F.col("_tried"), "attempted").when(F.col("upstream") == "banned", "upstream_banned").otherwise("submitted")
    )
    target = F.when((outcome == "submitted") & F.col("upstream").isNotNull(), S.limit_target("upstream", "_count", threshold)).otherwise(F.lit(0).cast("long"))
    return rows.select("origin", "dids", outcome.alias("outcome"), target.alias("limit_target"))


def reconcile_limits(pending: DataFrame, sources: DataFrame, maximum: int, now: int, ttl: int) -> DataFrame:
    """pending (origin, target, since) against sources (origin, state, account_limit): outcome, done and the limit to request."""
    rows = pending.join(sources.select("origin", "state", "account_limit"), "origin", "left")
    want = F.least("target", F.lit(maximum))
    outcome = (
        F.when(F.col("state").isNull(), "source_missing").when(F.col("state") != "enabled", "source_not_enabled")
        .when(F.col("account_limit").isNull(), "limit_unknown").when(F.lit(maximum < 1), "maximum_unset")
        .when(F.col("account_limit") >= want, "limit_sufficient").otherwise("submitted")
    )
    missing = outcome == "source_missing"
    expired = missing & (F.lit(now) - F.col("since") > ttl)
    return rows.select(
        "origin", F.when(expired, "expired_source_missing").otherwise(outcome).alias("outcome"), (~missing | expired).alias("done"),
        F.when(outcome == "submitted", want).alias("request_limit"),
    )


def _asked(accounts: DataFrame, repos: DataFrame, dids: DataFrame) -> DataFrame:
    rows = dids.select("did").distinct().join(accounts.withColumn("_found", F.lit(True)), "did", "left")
    return account_status(rows).join(repos.select("uid", "rev", "commit_cid"), "uid", "left")


def repo_status_of(accounts: DataFrame, repos: DataFrame, dids: DataFrame) -> DataFrame:
    """active, status and rev (null if unknown) of known accounts."""
    return _asked(accounts, repos, dids).where("_found").select("did", F.col("is_active").alias("active"), F.col("status_field").alias("status"), "rev")


def latest_commit(accounts: DataFrame, repos: DataFrame, dids: DataFrame) -> DataFrame:
    """cid and rev, or the refusal code, per asked account."""
    s = F.col("public_status")
    refusal = (
        F.when(F.col("_found").isNull(), "RepoNotFound").when(s.isin("takendown", "suspended"), "RepoTakendown").when(s == "deactivated", "RepoDeactivated")
        .when(s == "deleted", "RepoDeleted").when(s != "active", "RepoInactive").when(F.col("rev").isNull(), "RepoNotSynchronized")
    )
    rows = _asked(accounts, repos, dids).withColumn("refusal", refusal)
    return rows.select("did", "refusal", F.when(F.col("refusal").isNull(), F.col("commit_cid")).alias("cid"), F.when(F.col("refusal").isNull(), F.col("rev")).alias("rev"))


def repository_details(inventory: DataFrame, completed: DataFrame, retries: DataFrame) -> DataFrame:
    """State per (job_id, did): completed, waiting for a retry, or pending."""
    key = ["job_id", "did"]
    rows = inventory.join(completed.select(*key, "matching", "records"), key, "left").join(retries.select(*key, "due", "wait_reason", "attempts"), key, "left")
    state = F.when(F.col("matching").isNotNull(), "completed").when(F.col("due").isNotNull(), "waiting").otherwise("pending")
    return rows.withColumn("state", state)


def details_of_jobs(jobs: DataFrame, details: DataFrame, key: str, block: int = 256, part: int = 16384, task_rows: int = 8_000_000) -> DataFrame:
    """Details by a key that jobs share, told for each job.

    The result is as large as jobs times accounts of a key, so it is neither shuffled nor sorted: a key's jobs
    fall into blocks and its details into parts, and each pair of them is a cell, which is joined on its own. A
    detail comes with all jobs of a block after it, in one order, so written columns hold long runs and
    patterns that repeat. Tasks are as many as the rows of the result ask for, as inputs don't tell its size.
    """
    jobs, details = jobs.select("job_id", key), stored(details, "details")
    cells = stored(
        jobs.groupBy(key).agg(F.count("*").alias("_jobs")).join(details.groupBy(key).agg(F.count("*").alias("_details")), key)
        .withColumn("_blocks", F.ceil(F.col("_jobs") / block)).withColumn("_parts", F.ceil(F.col("_details") / part)), "cells",
    )
    rows = cells.agg(F.sum(F.col("_jobs") * F.col("_details"))).first()[0] or 0
    tasks = max(1, -(-rows // task_rows))
    copying = max(1, -(-rows // (block * 1_000_000)))  # details come once per block, a million of them from a task
    counts = cells.select(key, "_blocks", "_parts")
    of = lambda column, n: F.pmod(F.xxhash64(column), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    salt = F.col("_block") * F.col("_parts") + F.col("_part")
    one = jobs.join(counts, key).select("job_id", key, of("job_id", "_blocks").alias("_block"), "_parts", every("_parts").alias("_part"))
    many = details.join(counts, key).repartition(copying, "did").select(*details.columns, every("_blocks").alias("_block"), "_parts", of("did", "_parts").alias("_part"))
    one, many = (x.withColumn("_salt", salt).drop("_block", "_parts", "_part").repartition(tasks, key, "_salt") for x in (one, many))
    return many.hint("merge").join(one, [key, "_salt"]).drop("_salt")
