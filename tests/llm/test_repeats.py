"""Repeated rows, clashing ids and very many lines."""

import time
import zlib

from pyspark.sql import functions as F

from seqlake.llm import language_id, line_dedup, quotations, sharding


def test_lines_are_cut_in_the_time_of_their_number(spark):
    def cut(lines, drop):
        df = spark.createDataFrame([("\n".join(lines), drop)], "text string, drop array<int>")
        kept = F.get(F.transform(F.array(F.split("text", "\n")), lambda x: F.array_join(line_dedup.without(x, F.col("drop")), "\n")), 0)
        return df.select(kept.alias("kept")).first().kept

    small = [f"l{k}" for k in range(7)]
    for drop in ([], [0], [6], [0, 6], [1, 2, 5], list(range(7))):
        assert cut(small, drop) == "\n".join(x for k, x in enumerate(small) if k not in drop)
    assert cut([""], [0]) == "" and cut(["", ""], [0]) == ""
    many = [f"line {k}" for k in range(200_000)]
    start = time.time()
    assert cut(many, [k for k in range(200_000) if k % 3]) == "\n".join(many[::3])
    assert time.time() - start < 60  # two minutes for 80 000 lines by one look-up per line


def test_line_dedup_of_a_text_that_loses_most_lines(spark):
    shared = [f"boilerplate {k}" for k in range(3000)]
    rows = [(d, "\n".join(shared + [f"own {d}"]), f"s{d}") for d in range(9)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].text == rows[0][1]
    assert all(got[d].text == f"own {d}" and got[d].n_lines_removed == 3000 for d in range(1, 9))


def test_copies_of_a_row_fill_no_sample(spark):
    copies = [(1, 1, "en")] * 5000
    others = [(k, k, "en") for k in range(2, 3000)]
    got = language_id.sample_of(spark.createDataFrame(copies + others, "id long, row long, lang string"), 400).collect()
    assert len(got) == len({(r.id, r.row) for r in got}) == 400 and sorted(r.k for r in got) == list(range(1, 401))


def test_turns_that_repeat_clash_or_lack_a_key(spark):
    turns = [(1, k, f"Text {k}.") for k in range(3)] * 20 + [(None, 1, "a"), (1, None, "b"), (2, 0, "Two."), (1, 1 << 20, "Far."), (3, 0, None), (3, 0, None)]
    out = quotations.conversations(quotations.mail_from_turns(spark.createDataFrame(turns, "conv_id long, turn long, text string")))
    got = {tuple(r.id): r for r in out.collect()}
    assert out.count() == len(got) == 6
    assert tuple(got[(1, 2)].parent_id) == (1, 1) and tuple(got[(1, 2)].root_id) == (1, 0) and got[(1, 2)].depth == 2
    assert got[(2, 0)].own_text == "Two." and got[(1, 1 << 20)].own_text == "Far." and got[(3, 0)].own_text == ""


def test_rows_that_share_an_id_are_ranked_in_many_tasks(spark):
    rows = [(7, "same")] * 3000 + [(None, f"text {k % 50}") for k in range(3000)] + [(k, "other") for k in range(100, 3100)]
    placed = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 8)
    got = placed.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.doc_id or 0, r.text_crc32) for r in got) == sorted((d or 0, zlib.crc32(t.encode())) for d, t in rows)
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(slots[s] == list(range(1125)) for s in range(8))
    again = {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.shard(spark.createDataFrame(rows[::-1], "doc_id long, text string"), 8).collect()}
    assert again == {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in got}


def test_a_cell_of_any_size_is_dealt_to_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 4000, 1, 4).select(F.lit(1).alias("cell"), F.lit(5).alias("hash"), F.monotonically_increasing_id().alias("row"))
        keyed = sharding.Keyed(rows, ["cell"], "hash", "row")
        sizes = [r["count"] for r in keyed.rows.groupBy("_part").count().collect()]
        assert len(sizes) > 1 and max(sizes) < 4000 * 2 / len(sizes)
        assert sorted(r.n for r in keyed.numbered("n").select("n").collect()) == list(range(1, 4001))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
