"""Exact dedup by skew-safe combining, in DataFrame functions only.

Texts count as equal when they are identical after every run of white space
``[\\x20\\x09-\\x0D]+`` becomes one space. A digest (SHA-256 of the normalised text) groups
rows, and whatever shares a digest is compared by its full content at every stage:

1. local: the aggregation by (digest, salt, content) merges equal contents inside each input
   split, before anything is shuffled, so a text moves once per split that holds it;
2. salted: the same aggregation's shuffle. Hot digests (``skew``) are dealt to ``salts`` groups by
   the hash of the id, all others have one group, which is final;
3. global: the salt winners of the hot digests, at most ``salts`` rows per content, are combined.

Rows find their group by (digest, salt), the winners of hot digests being repeated per salt. So
no stage brings the rows of a hot digest into one task.

Defined results: a null text counts as empty, and all empty texts are one group; the smallest
id of a group stays; repeated rows (same id and text) count in group_size, and those with the
smallest id are all kept, as are rows of a group that has null ids alone; an empty table gives
an empty result. Only the id and text columns are read, so extra columns of any name
are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.scratch import Scratch
from seqlake.llm.skew import SALTS, for_each_salt, hot_keys, with_salt

WHITE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RUN, " ")


def digest_of(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, digest).

    keep_id is the smallest id with an equal text, kept says whether the row is that one, and
    digest is the SHA-256 of the normalised text in lowercase hex.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("content"))
    rows = rows.withColumn("digest", digest_of(F.col("content")))
    ids = scratch.save(rows.select("id", "digest"), "digests")
    hot = scratch.save(hot_keys(ids.groupBy("digest").agg(F.count("*").alias("n")), ids.count()), "hot")

    merged = with_salt(rows, hot, F.col("id"), salts).groupBy("digest", "salt", "content").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    # Only the winners of hot digests are combined again, so only their contents are written.
    held = merged.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left")
    held = scratch.save(held.select("digest", "keep_id", "n", "hot", F.when(F.col("hot"), F.col("content")).alias("content")), "salted")
    combined = held.where("hot").groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = combined.select("digest", "keep_id", "group_size").unionByName(held.where("hot IS NULL").select("digest", "keep_id", F.col("n").alias("group_size")))
    winners = scratch.save(winners, "winners")
    scratch.drop(held)

    # A digest shared by different contents never shows in practice; its rows are matched by content.
    clashing = winners.groupBy("digest").count().where("count > 1").select("digest")
    if clashing.isEmpty():
        placed = with_salt(ids, hot, F.col("id"), salts).join(for_each_salt(winners, hot, salts), ["digest", "salt"])
    else:
        clashing = scratch.save(clashing, "clashing")
        torn = rows.join(clashing, "digest", "left_semi")
        groups = torn.groupBy("digest", "content").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        placed = (
            ids.join(clashing, "digest", "left_anti").join(winners, "digest").select("id", "digest", "keep_id", "group_size")
            .unionByName(torn.join(groups, ["digest", "content"]).select("id", "digest", "keep_id", "group_size"))
        )
    return placed.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("digest"),
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).withColumnRenamed("digest", "text_sha256")


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents),
g AS (SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY content)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.content) AS text_sha256
FROM n JOIN g ON n.content = g.content
"""
