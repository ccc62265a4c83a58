"""Filters, validation and policies over the log and its side tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.functions import scalars as S
from seqlake.scratch import stored

LONG_LIST = 1_000
DROP_REASONS = ["invalid_rev", "invalid_collection", "invalid_rkey", "field_too_long", "missing_block"]


def small(df: DataFrame) -> DataFrame:
    """A side that is often small: written once, so that Spark broadcasts it by its true size or not at all."""
    return stored(df, "side")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def collection_matches(collection, patterns: list[str]) -> Column:
    """Exact names, or namespaces as ``ns.*``."""
    c = F.col(collection) if isinstance(collection, str) else collection
    exact = [p for p in patterns if not p.endswith(".*")]
    return any_of([c.isin(exact)] * bool(exact) + [c.startswith(p[:-1]) for p in patterns if p.endswith(".*")])


def restrict_dids(log: DataFrame, dids: DataFrame) -> DataFrame:
    return log.join(small(dids.select("did").distinct()), "did", "left_semi")


def _of_dids(log: DataFrame, dids: list[str] | None) -> DataFrame:
    if not dids:
        return log
    if len(dids) <= LONG_LIST:
        return log.where(F.col("did").isin(dids))
    return restrict_dids(log, log.sparkSession.createDataFrame([(d,) for d in dids], "did string"))


def filter_v1(log: DataFrame, dids: list[str] | None = None, collections: list[str] | None = None) -> DataFrame:
    """DIDs bind all kinds; collections bind commits only, and not those without a collection."""
    if collections:
        log = log.where(~S.is_commit() | (F.col("collection") == "") | collection_matches("collection", collections))
    return _of_dids(log, dids)


def filter_v2(log: DataFrame, kinds: list[str] | None = None, dids: list[str] | None = None, collections: list[str] | None = None) -> DataFrame:
    """Public kinds and DIDs and (not a commit or a wanted collection)."""
    if kinds:
        log = log.where(S.kind_class().isin(kinds))
    if collections:
        log = log.where(~S.is_commit() | collection_matches("collection", collections))
    return _of_dids(log, dids)


def max_size(frames: DataFrame, most: int, frame: str = "frame") -> DataFrame:
    """Frames of at most so many bytes; 0 sets no cap."""
    return frames.where(F.octet_length(frame) <= most) if most else frames


def apply_policy(log: DataFrame, collections: list[str]) -> DataFrame:
    """Commits of listed collections, and all markers; an empty policy keeps markers only."""
    return log.where(~S.is_commit() | (F.col("collection").isin(collections) if collections else F.lit(False)))


def apply_policy_history(log: DataFrame, policies: DataFrame) -> DataFrame:
    """Each row under the policy in force at its seq: (revision, collections, effective_after_seq).

    The policy table holds a row per revision; its intervals are disjoint, so the range join adds no rows.
    """
    order = Window.orderBy("since", "revision")
    spans = policies.withColumn("since", F.coalesce("effective_after_seq", F.lit(0))).withColumn("until", F.lead("since").over(order))
    spans = spans.select(F.col("revision").alias("policy_rev"), "collections", "since", "until")
    inside = (F.col("seq") > F.col("since")) & (F.col("until").isNull() | (F.col("seq") <= F.col("until")))
    judged = log.join(small(spans), inside, "left")
    kept = ~S.is_commit() | F.coalesce(F.array_contains("collections", F.col("collection")), F.lit(False))
    return judged.where(kept).drop("collections", "since", "until")


def validate_ops(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, dropped): a wrong rev drops the whole event, other faults drop the op alone."""
    reason = (
        F.when((S.is_commit() | (F.col("kind") == "sync")) & ~S.matches("tid", "rev"), "invalid_rev")
        .when(S.is_commit() & ~S.matches("nsid", "collection"), "invalid_collection")
        .when(S.is_commit() & ~S.matches("record_key", "rkey"), "invalid_rkey")
        .when(~widths_fit(), "field_too_long")
        .when(S.is_materialization() & F.col("record").isNull(), "missing_block")
    )
    judged = log.withColumn("drop_reason", reason)
    return judged.where("drop_reason IS NULL").drop("drop_reason"), judged.where("drop_reason IS NOT NULL")


def widths_fit() -> Column:
    """Whether a row fits the archive's columns: 65535 bytes of did, 255 of the rest."""
    short = [F.octet_length(c) <= 255 for c in ("collection", "rkey", "rev")]
    return F.coalesce(reduce(lambda a, b: a & b, short, F.octet_length("did") <= 65535), F.lit(False))


def check_widths(log: DataFrame) -> DataFrame:
    return log.withColumn("fits", widths_fit())


def split_record_path(paths: DataFrame, column: str = "path") -> DataFrame:
    """(path, collection, rkey, reason) of repository paths."""
    collection, rkey = S.split_path(column)
    rows = paths.withColumn("collection", collection).withColumn("rkey", rkey)
    reason = F.when(F.col("collection").isNull(), "malformed_path").when(~S.matches("nsid", "collection"), "invalid_collection").when(~S.matches("record_key", "rkey"), "invalid_rkey")
    return rows.withColumn("reason", reason)


def validate_import(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, rejects) of import rows (offset, uri, timestamp, scope, cid); the first failing rule names the reason."""
    time = F.when(F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z"), F.try_to_timestamp("timestamp"))
    # A generator, so that parts and time are worked out once per row: Spark would copy them into each test of them.
    parsed = F.struct(*[c.alias(n) for c, n in zip((*S.at_uri_parts("uri"), F.unix_micros(time)), ("_did", "_collection", "_rkey", "_micros"))])
    rows = rows.select("*", F.inline(F.array(parsed)))
    did, collection, rkey, micros = map(F.col, ("_did", "_collection", "_rkey", "_micros"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    reason = (
        F.when(F.coalesce(F.col("malformed"), F.lit(False)), "malformed_csv") if "malformed" in rows.columns else F.when(F.lit(False), "")
    )
    size = F.octet_length(F.concat_ws(",", text("uri"), text("timestamp"), text("scope"), text("cid")))
    reason = (
        reason.when(size >= 65536, "row_too_long")
        .when((text("uri") == "") | (text("timestamp") == ""), "missing_field")
        .when(~F.coalesce(F.col("uri").rlike(S.PATTERNS["at_uri"][0]), F.lit(False)), "bad_uri")
        .when(~S.matches("did", did), "uri_authority_not_did")
        .when(~S.matches("nsid", collection) | ~S.matches("record_key", rkey), "uri_missing_collection_or_rkey")
        .when(micros.isNull(), "bad_timestamp").when(micros <= 0, "non_positive_timestamp")
        .when(~text("scope").isin("", "all_versions", "specific_version"), "unknown_scope")
        .when((text("scope") == "specific_version") & (text("cid") == ""), "specific_version_missing_cid")
        .when((text("scope") == "specific_version") & ~S.matches("cid", "cid"), "bad_cid")
    )
    judged = rows.withColumn("reason", reason)
    scope = F.when(text("scope") == "specific_version", "specific_version").otherwise("all_versions")
    rules = judged.where("reason IS NULL").select(
        "offset", did.alias("did"), collection.alias("collection"), rkey.alias("rkey"), scope.alias("scope"),
        F.when(scope == "specific_version", F.col("cid")).alias("cid"), micros.alias("ts"),
    )
    return rules, judged.where("reason IS NOT NULL").select("offset", "uri", "timestamp", "reason")


def account_status(accounts: DataFrame) -> DataFrame:
    """public_status, is_active and status_field (null if active)."""
    local = F.col("status")
    public = F.when(local == "host-throttled", "throttled").when(local != "active", local).otherwise(F.col("upstream_status"))
    active = local.isin("active", "throttled") & (F.col("upstream_status") == "active")
    return accounts.withColumn("public_status", public).withColumn("is_active", active).withColumn("status_field", F.when(~active, public))


def normalize_account_events(events: DataFrame) -> DataFrame:
    """new_status of (did, active, status) events; inactive without a status is malformed."""
    new = F.when(F.col("active"), "active").otherwise(F.col("status"))
    return events.withColumn("new_status", new).withColumn("reject_reason", F.when(new.isNull(), "malformed_event"))


def is_banned(hosts: DataFrame, bans: DataFrame) -> DataFrame:
    """hosts with banned: the host, or any parent domain of two labels or more, is in bans (domain)."""
    parts = F.split("hostname", r"\.")
    rows = hosts.withColumn("_suffix", F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), ".")))
    hit = rows.select("hostname", F.explode("_suffix").alias("domain")).join(small(bans.select("domain").distinct()), "domain", "left_semi")
    hit = hit.select("hostname").distinct().withColumn("_hit", F.lit(True))
    return hosts.join(hit, "hostname", "left").withColumn("banned", F.coalesce("_hit", F.lit(False)) | F.col("hostname").startswith("localhost:")).drop("_hit")


def is_denied(host, patterns: list[str]) -> Column:
    """Exact names, or subdomains as ``*.suffix``; ports are ignored."""
    bare = F.regexp_replace(F.col(host) if isinstance(host, str) else host, r":[0-9]+\z", "")
    return any_of(bare.endswith(p[1:]) if p.startswith("*.") else bare == p for p in patterns)


def public_collections(stats: DataFrame, words: list[str], min_dids: int) -> DataFrame:
    """Collections (collection, dids) without bad words and with enough accounts."""
    if words:
        stats = stats.where(~F.lower("collection").rlike("|".join(rf"\Q{w.lower()}\E" for w in words)))
    return stats.where(F.col("dids") >= min_dids)


def check_commits(commits: DataFrame, now_micros: int) -> DataFrame:
    """fault of commit frames (rev, commit_rev, rebase, too_big, ops); null if none."""
    fault = (
        F.when(F.size("ops") > 200, "too_many_ops").when(F.exists("ops", lambda o: o.isNull()), "null_op")
        .when(F.col("rev") != F.col("commit_rev"), "rev_mismatch").when(F.col("rebase") | F.col("too_big"), "deprecated_flag")
        .when(~S.matches("tid", "rev"), "invalid_rev").when(S.tid_micros("rev") > now_micros + 300_000_000, "future_rev")
    )
    return commits.withColumn("fault", fault)
