"""Keyset pages and top lists: filter, order, limit, which Spark runs as one distributed top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.functions import scalars as S
from seqlake.operators.filters import account_status, public_collections


def active_accounts(accounts: DataFrame, cursor: int, limit: int) -> DataFrame:
    return account_status(accounts).where(F.col("is_active") & (F.col("uid") > cursor)).orderBy("uid").limit(limit)


def _with_cursor(page: DataFrame, column: str, limit: int) -> DataFrame:
    """The page with next_cursor, which is set only on a full page; a page has limit rows at most."""
    full = page.agg(F.when(F.count("*") == limit, F.max(column)).alias("next_cursor"))
    return page.crossJoin(F.broadcast(full))


def list_hosts(hosts: DataFrame, cursor: int, limit: int, ever_active: bool = False) -> DataFrame:
    rows = hosts.withColumn("ever_active", F.col("last_seq") > 0).where(F.col("host_id") > cursor)
    rows = rows.where("ever_active") if ever_active else rows
    return _with_cursor(rows.orderBy("host_id").limit(limit), "host_id", limit)


def dids_of(directory: DataFrame, collection: str, limit: int, after: tuple[int, str] | None = None) -> DataFrame:
    rows = directory.where(F.col("collection") == collection)
    if after:
        rows = rows.where((F.col("seen_ms") > after[0]) | ((F.col("seen_ms") == after[0]) & (F.col("did") > after[1])))
    return rows.orderBy("seen_ms", "did").limit(limit)


def list_collections(stats: DataFrame, cursor: str, limit: int, min_dids: int, words: list[str]) -> DataFrame:
    """Alphabetical; hidden collections go before the limit counts."""
    return public_collections(stats, words, min_dids).where(F.col("collection") > cursor).orderBy("collection").limit(limit)


def list_rejected(rejected: DataFrame, after_id: int = 0, limit: int = 100) -> DataFrame:
    """In order of id; rows that share an id follow their other columns, so a page is the same in every run."""
    return rejected.where(F.col("id") > after_id).orderBy("id", "idempotency_key", "reason").limit(min(limit or 100, 1000))


def list_takedowns(accounts: DataFrame, cursor: int, limit: int) -> DataFrame:
    return accounts.where((F.col("status") == "takendown") & (F.col("uid") > cursor)).orderBy("uid").limit(limit)


def hosts_near_limit(hosts: DataFrame, threshold: float, limit: int = 0) -> DataFrame:
    rows = hosts.withColumn("usage", S.usage()).where((F.col("usage") >= threshold) & (F.col("status") != "banned")).orderBy(F.desc("usage"), "host_id")
    return rows.limit(limit) if limit else rows


def host_table(rollup: DataFrame, sort_by: str = "total", top: int = 10) -> DataFrame:
    return rollup.orderBy(F.desc(sort_by), "pds_host").limit(top)


def replay_page(log: DataFrame, start_seq: int, stop_seq: int, n: int) -> DataFrame:
    return log.where((F.col("seq") >= start_seq) & (F.col("seq") < stop_seq)).orderBy("seq").limit(n)


def list_repos(accounts: DataFrame, repos: DataFrame, cursor: int, limit: int) -> DataFrame:
    rows = account_status(accounts).where(F.col("uid") > cursor).join(repos.select("uid", "rev", "commit_cid"), "uid")
    page = rows.select("uid", "did", F.col("commit_cid").alias("head"), "rev", F.col("is_active").alias("active"), F.col("status_field").alias("status"))
    return _with_cursor(page.orderBy("uid").limit(limit), "uid", limit)


def inventory(listing: DataFrame, job_id: str) -> DataFrame:
    """A job's frozen inventory in account order; an unfinished listing is an error."""
    rows = listing.where(F.col("job_id") == job_id)
    checked = F.when(F.col("listing_complete"), F.col("did")).otherwise(F.raise_error(F.lit("inventory is not complete")))
    return rows.select("job_id", checked.alias("did")).orderBy("did")
