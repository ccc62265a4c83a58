"""Line dedup by the spread of lines over distinct sites.

A line that shows on ``min_sites`` sites or more is boilerplate: it stays at its first place
(smallest document id, then position) and goes everywhere else.

1. One aggregation per line hash merges HyperLogLog sketches of the sites, straight from the
   lines and combined inside each input split, so a line that holds a third of all rows comes
   to the shuffle as one small row per split. It also counts the rows and finds the first place.
2. Lines with fewer rows than min_sites can't reach it. Where the estimate is within three
   standard errors (or one site) of the threshold, the exact distinct count decides; only these
   lines' sites are gathered, combined per (line, site) inside each split.
3. Rows of boilerplate lines are found by a join on the line hash, hot lines salted (``skew``),
   and the positions that go are collected per document.

Lines are cut at newlines and compared after white space at both ends is stripped; blank lines
are never removed. Line hashes (128 bits), ids and positions are what is shuffled up to there;
then texts and the positions of their documents meet in a join of Spark's choice.

Defined results: a null text stays null and has no lines; a null site counts as one site of
its own; repeated lines of one document count as one site; rows that share an id but not the
text are documents of their own (the hash of the text tells them apart), rows that share both
lose the same lines; null ids come first; an empty table gives an empty result; all input
columns are kept as they are, but for the text, and for one named n_lines_removed, which is
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.scratch import Scratch
from seqlake.llm.skew import for_each_salt, hot_keys, with_salt

LG_K = 12
ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
KEY = ["h1", "h2"]


def line_rows(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, row, site, pos, h1, h2) of every line that isn't blank; row is the hash of the text."""
    lines = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("row"),
        F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("")).alias("site"),
        F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"),
    ).withColumn("line", F.regexp_replace("raw", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", ""))
    return lines.where("line <> ''").select(
        "id", "row", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2")
    )


def site_spread(lines: DataFrame) -> DataFrame:
    """(h1, h2, n, first, sites): rows, first place and estimated number of sites of each line."""
    return lines.groupBy(*KEY).agg(
        F.count("*").alias("n"),
        F.min(F.struct("id", "row", "pos")).alias("first"),
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"),
    )


def boilerplate(lines: DataFrame, min_sites: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, first) of the lines that show on min_sites sites or more, and the hot ones of all lines."""
    spread = site_spread(lines).where(F.col("n") >= min_sites)
    margin = F.greatest(F.lit(1.0), F.lit(ERROR) * F.col("sites"))
    spread = spread.withColumn("near", F.abs(F.col("sites") - min_sites) <= margin).where(F.col("near") | (F.col("sites") > min_sites))
    spread = scratch.save(spread, "spread")
    hot = scratch.save(hot_keys(spread.select(*KEY, "n"), lines.count()), "hot")

    near = for_each_salt(spread.where("near").select(*KEY), hot)
    exact = (
        with_salt(lines.select(*KEY, "site"), hot, F.col("site")).join(near, [*KEY, "salt"], "left_semi")
        .groupBy(*KEY, "site").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.count("*").alias("exact"))
        .where(F.col("exact") >= min_sites).select(*KEY)
    )
    wide = spread.where("NOT near").select(*KEY).unionByName(exact)
    common = scratch.save(spread.select(*KEY, "first").join(wide, KEY, "left_semi"), "common")
    scratch.drop(spread)
    return common, hot


def removed_lines(docs: DataFrame, min_sites: int, id_col: str, text_col: str, site_col: str, scratch: Scratch) -> DataFrame:
    """(id, row, drop: sorted positions) of the documents that lose lines."""
    lines = scratch.save(line_rows(docs, id_col, text_col, site_col), "lines")
    common, hot = boilerplate(lines, min_sites, scratch)
    place = F.struct("id", "row", "pos")
    found = with_salt(lines.drop("site"), hot, place).join(for_each_salt(common, hot), [*KEY, "salt"])
    gone = found.where(~place.eqNullSafe(F.col("first"))).groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("drop"))
    gone = scratch.save(gone, "gone")
    scratch.drop(lines, common)
    return gone


def without(lines: Column, drop: Column) -> Column:
    """lines but those at the sorted positions drop, in the time of their number: the spans between dropped ones are cut out whole."""
    def span(k):
        start = F.when(k == 0, 0).otherwise(F.get(drop, k - 1) + 1)
        end = F.coalesce(F.get(drop, k), F.size(lines))
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drop)), span))


def line_dedup(docs: DataFrame, min_sites: int = 8, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The documents with their boilerplate lines removed, plus n_lines_removed."""
    gone = removed_lines(docs, min_sites, id_col, text_col, site_col, Scratch(docs.sparkSession, "lines"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"))
    joined = rows.join(gone, rows["id"].eqNullSafe(gone["id"]) & (rows["row"] == gone["row"]), "left").select("doc", "drop")
    text = F.col("doc")[text_col]
    kept = F.get(F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(without(lines, F.col("drop")), "\n")), 0)
    return joined.select(
        *[F.when(F.col("drop").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns if c != "n_lines_removed"],
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_lines_removed"),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, source, pos, list_extract(parts, pos) AS raw FROM (
    SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (
      SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
k AS (SELECT *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
c AS (SELECT line, min({'d': doc_id, 'p': pos}) AS f FROM k WHERE line <> '' GROUP BY line
      HAVING count(DISTINCT coalesce('s' || source, '')) >= 8),
r AS (SELECT k.*, c.f IS NOT NULL AND (k.doc_id, k.pos) <> (c.f.d, c.f.p) AS gone FROM k LEFT JOIN c ON k.line = c.line),
o AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS t FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.n, 0) AS n_lines_removed, sha256(coalesce(o.t, '')) AS kept_sha256
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""
