"""A corpus pipeline: five stages, each one operator of seqlake.llm at work on documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's
result as Parquet to the shared folder and hands the written table to the next stage. All
stages but the last return the columns of documents.

Rows with one doc_id: documents has unique ids; where ids repeat, rows that share one are kept
or dropped together in the mixing stage, and share the result of the n-gram join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm import language_id, line_dedup, mixing, ngram_join, sentencepiece
from seqlake.llm.scratch import Scratch
from seqlake.llm.skew import side

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents, then drops texts without a letter and texts it can't place."""
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs.where(~language_id.held_out()))
    placed = language_id.predict(docs, model, keep=tuple(COLUMNS))
    return placed.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that spread over many sites; a document that loses all its lines goes."""
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    kept = out.where((F.col("n_lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    chars = F.when(F.col("n_lines_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return kept.withColumn("n_chars", chars).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at 0.75, the one with the smallest doc_id stays."""
    docs = docs.select(*COLUMNS)
    groups = ngram_join.ngram_components(docs)
    gone = Scratch(spark, "near").save(groups.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(side(gone), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that sources meet their target weights, and writes them in the mix's order.

    A document comes once per draw, in the shard that drew it and at its place there: the rows are
    sorted by shard and place over range partitions, each of which lies in one shard or few.
    """
    docs = docs.select(*COLUMNS)
    draws = mixing.place(mixing.mix(docs).dropDuplicates(["doc_id"])).withColumnRenamed("doc_id", "drawn_id")
    draws = Scratch(spark, "mixed").save(draws, "draws")
    drawn = docs.join(draws, docs["doc_id"].eqNullSafe(draws["drawn_id"]))
    order = ["shard", "place", "doc_id", "copy"]
    return drawn.repartitionByRange(*order).sortWithinPartitions(*order).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts."""
    return sentencepiece.encode(docs, keep=("doc_id", "source"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_boilerplate),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Language identification, mixing and encoding have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
