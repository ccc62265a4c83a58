"""The event log: one row per event in sequence order."""

from __future__ import annotations

from pyspark.sql import types as T

LOG_COLUMNS = {
    "seq": T.LongType(),
    "witnessed_at": T.LongType(),  # microseconds
    "indexed_at": T.LongType(),  # microseconds, 0: never imported
    "kind": T.StringType(),
    "did": T.StringType(),
    "collection": T.StringType(),  # empty for account-level kinds
    "rkey": T.StringType(),
    "rev": T.StringType(),
    "record": T.StringType(),  # JSON, null for deletes and account-level kinds
    "account_deleted": T.BooleanType(),
    "handle": T.StringType(),
    "scope_collections": T.ArrayType(T.StringType()),
}
LOG = T.StructType([T.StructField(k, v) for k, v in LOG_COLUMNS.items()])

COMMIT_KINDS = ["create", "update", "delete", "create_resync"]
MATERIALIZATIONS = ["create", "update", "create_resync"]
RECORD_KEY = ["did", "collection", "rkey"]
EMPTY_SCOPE = "CAST(NULL AS ARRAY<STRING>)"
