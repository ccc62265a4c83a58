"""Running values inside keys of any size, whole blocks for callbacks, and paced streams, against plain loops."""

import os
import random
from collections import defaultdict
from statistics import median

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqlake.functions.hooks import transform_blocks
from seqlake.operators import compare as U
from seqlake.operators import windows as W
from seqlake.operators.ranges import PART, Keyed, numbered_within
from seqlake.scratch import new_path
from seqlake.sources.paced import PacedReader, paced_log
from seqlake.schema import LOG
from tests.test_edge_cases import log


@pytest.fixture
def ranges(spark):
    """As many ranges as shuffle partitions, also of small tables (Spark would make one of them)."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def keyed_rows(seed):
    rng = random.Random(seed)
    hot = lambda: "hot" if rng.random() < 0.5 else rng.choice([None, "", "a", "b", "z", *[f"k{n}" for n in range(40)]])
    return [(k, hot(), rng.choice([None, None, rng.randint(0, 99)])) for k in rng.sample(range(9000), 3000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_keyed_ranges_against_plain_loops(spark, seed, ranges):
    rows = keyed_rows(seed)
    df = spark.createDataFrame(rows, "at int, key string, x int").repartition(5)
    by_key = defaultdict(list)
    for at, key, x in sorted(rows):
        by_key[key].append((at, x))
    number, before, known, previous = {}, {}, {}, {}
    for items in by_key.values():
        top = last = prior = None
        for k, (at, x) in enumerate(items):
            number[at], before[at], previous[at] = k + 1, top, prior
            top = max((v for v in (top, x) if v is not None), default=None)
            last = known[at] = x if x is not None else last
            prior = x
    ranged = Keyed(df, ["key"], "at")
    parts = ranged.rows.where("key = 'hot'").select(PART).distinct().count()
    assert parts > 1
    x = F.col("x")
    for out, want in (
        (ranged.numbered("v"), number), (ranged.max_before(x, "v"), before), (ranged.last_known(x, "v"), known), (ranged.previous(x, "v"), previous),
        (numbered_within(df, "key", "at", "v"), number),
    ):
        assert out.columns == ["at", "key", "x", "v"]
        got = out.collect()
        assert len(got) == len(rows) and {r["at"]: r.v for r in got} == want
    assert Keyed(df.where("false"), ["key"], "at").max_before(x, "v").count() == 0


def test_an_account_with_half_of_the_log_is_spread(spark, ranges):
    events = [("create", f"r{s % 5}", f"{s:09d}") if s % 50 else ("account", "", "") for s in range(1, 6001)]
    rows = [(s, "did:hot" if s % 2 else f"did:{s % 300}", *e) for s, e in enumerate(events, 1)]
    df = spark.createDataFrame(rows, "seq long, did string, kind string, rkey string, rev string").withColumn("account_deleted", F.col("seq") % 100 == 0)
    sizes = [r["count"] for r in Keyed(df, ["did"], "seq").rows.groupBy(PART).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * median(sizes)
    given, want = {}, {}
    for s, did, kind, *_ in rows:
        if kind == "account":
            given[did] = "deleted" if s % 100 == 0 else "active"
        want[s] = given.get(did)
    assert {r.seq: r.status_as_of for r in W.status_as_of(df).collect()} == want
    fall = df.withColumn("rev", F.when(F.col("seq") == 5001, "000000001").otherwise(F.col("rev")))
    assert [(r.did, r.seq, r.fault) for r in W.check_invariants(fall).collect()] == [("did:hot", 5001, "rev_falls")]
    assert df.count() - W.drop_stale_revs(fall).count() == 1


def test_gaps_and_ranks_of_one_source(spark, ranges):
    seqs = [s for s in range(1, 4000) if s % 1000]
    feed = spark.createDataFrame([(7, s) for s in seqs] + [(8, 5), (8, 5), (8, None), (None, 3), (None, 9)], "source int, upstream_seq long").repartition(3)
    got = sorted(((r.source or 0), r.expected, r.got, r.skipped) for r in W.seq_gaps(feed).collect())
    assert got == [(0, 4, 9, 5), (7, 1000, 1001, 1), (7, 2000, 2001, 1), (7, 3000, 3001, 1)]
    one = log(spark, *[(s, "create", "d", "c", "k", f"{s:05d}", None) for s in range(1, 500)])
    got = U.ordered_diff(one, one.where("seq < 499")).collect()
    assert [(r.rank, r.seq_a, r.seq_b, r.diagnosis) for r in got] == [(499, 499, None, "missing")]


def test_a_callback_sees_each_block_once_and_whole(spark):
    seqs = [s for s in range(1, 2001) if not 129 <= s <= 256]
    df = spark.createDataFrame([(s, "x" * (s % 9)) for s in random.Random(5).sample(seqs, len(seqs))], "seq long, record string").repartition(7)

    def seen(block, rows):
        assert rows.seq.is_monotonic_increasing
        return pd.DataFrame({"block": [block], "rows": [len(rows)], "low": [rows.seq.min()], "high": [rows.seq.max()]})

    got = transform_blocks(df, seen, "block long, rows long, low long, high long", 64).collect()
    want = defaultdict(list)
    for s in seqs:
        want[(s - 1) // 64].append(s)
    assert sorted(tuple(r) for r in got) == [(b, len(v), min(v), max(v)) for b, v in sorted(want.items())]
    assert 2 not in want  # an empty block isn't called
    assert transform_blocks(df.where("false"), seen, "block long, rows long, low long, high long", 64).count() == 0


def appended(spark, path, seqs, files=2):
    rows = log(spark, *[(s, "create", f"d{s % 7}", "c", f"r{s}", f"{s:05d}", "{}", False, ["a", None] if s % 3 else None) for s in seqs])
    rows.repartitionByRange(files, "seq").sortWithinPartitions("seq").write.option("parquet.block.size", 4096).mode("append").parquet(path)


def read_on(spark, path, out, **caps):
    q = paced_log(spark, path, **caps).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-offsets").start()
    try:
        q.processAllAvailable()
        return [p.numInputRows for p in q.recentProgress if p.numInputRows]
    finally:
        q.stop()


def test_a_paced_stream_keeps_its_cap_and_resumes(spark):
    path, out = new_path(spark, "log"), new_path(spark, "paced")
    appended(spark, path, range(1, 501))
    first = read_on(spark, path, out, rows=120)
    assert first == [120, 120, 120, 120, 20]
    assert read_on(spark, path, out, rows=120) == []  # nothing twice
    appended(spark, path, [s for s in range(501, 1001) if not 600 < s < 900])  # a span without seqs
    second = read_on(spark, path, out, rows=70)
    assert max(second) <= 70 and sum(second) == 201
    got = spark.read.schema(LOG).parquet(out)
    want = spark.read.schema(LOG).parquet(path)
    assert got.count() == want.count() == 701 and got.exceptAll(want).count() == 0


def test_a_paced_stream_by_bytes(spark):
    path, out = new_path(spark, "log"), new_path(spark, "paced")
    appended(spark, path, range(1, 2001), files=4)
    everything = PacedReader({"path": path}, LOG)
    total = sum(g.size for g in everything._listed())
    took = read_on(spark, path, out, size=total // 5)
    assert sum(took) == 2000 and len(took) >= 5 and max(took) < 2 * 2000 / 5
    few = new_path(spark, "log")
    appended(spark, few, range(1, 4), files=1)
    assert read_on(spark, few, new_path(spark, "paced"), size=1) == [1, 1, 1]  # less than a row holds: one at a time
    assert spark.read.parquet(out).select("seq").distinct().count() == 2000


def test_a_paced_reader_waits_for_a_job_that_still_writes(spark):
    path = new_path(spark, "log")
    appended(spark, path, range(1, 11))
    reader = PacedReader({"path": path, "rowspertrigger": "4"}, LOG)
    folder = path.removeprefix("file://").removeprefix("file:")
    os.mkdir(folder + "/_temporary")
    assert reader.latestOffset() == {"seq": 0}
    os.rmdir(folder + "/_temporary")
    assert reader.latestOffset() == {"seq": 4} and reader.latestOffset() == {"seq": 4}
    assert {g.after for g in reader.partitions({"seq": 0}, {"seq": 4})} == {0} and reader.latestOffset() == {"seq": 8}
    again = PacedReader({"path": path, "rowspertrigger": "4"}, LOG)
    assert again.partitions({"seq": 8}, {"seq": 8}) == [] and again.latestOffset() == {"seq": 10}
