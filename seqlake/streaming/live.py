"""The log as a stream. State is kept by account or source, in sorted runs or in Spark's state store.

Batch writers are idempotent: a micro-batch writes its own folder, named by its batch id and
overwritten on a retry. What it needs to know of the past stands in a mark of the batch before
(one row) and in state runs, to which it adds one of its own size, so no micro-batch reads what
earlier ones wrote to the target, and none writes the whole state again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from seqlake.functions import scalars as S
from seqlake.operators import filters as FL
from seqlake.operators.ranges import Keyed, Ranged
from seqlake.operators.windows import latest_version
from seqlake.schema import LOG
from seqlake.scratch import delete, exists
from seqlake.sources.logs import continue_seqs, parse_v1_json, seq_window, stream_log

FAN = 8
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # fixed value: Spark's class name


def _write_batch(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _foreach(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    def once(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # a writer looks at its micro-batch several times
        try:
            write(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(once).outputMode(mode)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep Spark's state in RocksDB, so it may outgrow a task's memory."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Marks:
    """One row per micro-batch beside its output: what the next one has to know, such as the last seq.

    A batch's mark is written after its rows; a retry finds the same mark before it, and gives the
    same rows and the same mark.
    """

    def __init__(self, path: str, schema: str):
        self.path, self.schema = f"{path}-marks", schema

    def before(self, spark: SparkSession, batch: int) -> dict | None:
        path = f"{self.path}/batch={batch - 1}"
        if batch == 0 or not exists(spark, path):
            return None
        return spark.read.schema(self.schema).parquet(path).first().asDict()

    def put(self, spark: SparkSession, batch: int, *values) -> None:
        spark.createDataFrame([values], self.schema).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        delete(spark, f"{self.path}/batch={batch - 2}")  # only the newest micro-batch is ever retried


class StateRuns:
    """State as runs that a fold puts together, so that the work of a micro-batch follows its size.

    A micro-batch writes its own rows, folded, as a run of level 0. FAN runs of a level become one
    run of the next, so a row is written again once per level, and there are as many levels as the
    logarithm of the number of micro-batches. fold must give the same for runs as for all their
    rows together. A list per batch (a row per run) names the runs; runs that the last two lists
    do without are deleted.
    """

    def __init__(self, path: str, schema, fold: Callable[[DataFrame], DataFrame], fan: int = FAN):
        self.path, self.schema, self.fold, self.fan = path, schema, fold, fan

    def _list(self, spark: SparkSession, batch: int) -> list[tuple[str, int]]:
        path = f"{self.path}/list={batch}"
        if batch < 0 or not exists(spark, path):
            return []
        return sorted((r.run, r.level) for r in spark.read.schema("run string, level int").parquet(path).collect())

    def _read(self, spark: SparkSession, runs: list[str]) -> DataFrame:
        paths = [f"{self.path}/run={r}" for r in runs]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, run: str) -> None:
        self.fold(rows).write.mode("overwrite").parquet(f"{self.path}/run={run}")

    def rows(self, spark: SparkSession, batch: int) -> DataFrame:
        """The state as a micro-batch left it."""
        return self.fold(self._read(spark, [r for r, _ in self._list(spark, batch)]))

    def of(self, batch: DataFrame, key: str, batch_id: int) -> DataFrame:
        """What is known of the keys of a micro-batch before it."""
        spark = batch.sparkSession
        runs = self._read(spark, [r for r, _ in self._list(spark, batch_id - 1)])
        return self.fold(runs.join(batch.select(key).distinct(), key, "left_semi"))

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """Add rows; what they say of their keys is folded into what is known."""
        spark = rows.sparkSession
        before, older = self._list(spark, batch_id - 1), self._list(spark, batch_id - 2)
        now, level = [*before, (f"{batch_id}-0", 0)], 0
        self._write(rows, now[-1][0])
        while len(full := [r for r, k in now if k == level]) >= self.fan:
            level += 1
            self._write(self._read(spark, full), f"{batch_id}-{level}")
            now = [x for x in now if x[0] not in full] + [(f"{batch_id}-{level}", level)]
        spark.createDataFrame(now, "run string, level int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/list={batch_id}")
        kept = {r for r, _ in before} | {r for r, _ in now}
        delete(spark, *[f"{self.path}/run={r}" for r, _ in older if r not in kept], f"{self.path}/list={batch_id - 2}")


def greatest_of(key: str, *columns: str) -> Callable[[DataFrame], DataFrame]:
    """A fold: per key, the greatest value of each column."""
    return lambda rows: rows.groupBy(key).agg(*[F.max(c).alias(c) for c in columns])


def ingest_stream(lines: DataFrame, target: str, collections: list[str], checkpoint: str, position: str | None = None) -> StreamingQuery:
    """v1 lines -> parsed -> gated -> policy -> seq -> appended folder; offsets move after the write.

    position names a column of lines that tells the order at the source, such as the upstream
    cursor; without it rows follow their time, account and rev. The last seq of a batch is its mark.
    """
    marks = Marks(target, "last_seq long")
    order = [position] if position else ["witnessed_at", "did", "rev"]

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows, _ = parse_v1_json(batch, keep=[position] if position else [])
        good, _ = FL.validate_ops(rows.withColumn("seq", F.lit(0).cast("long")))
        top = (marks.before(spark, batch_id) or {"last_seq": 0})["last_seq"]
        _write_batch(continue_seqs(top, FL.apply_policy(good, collections), order).select(*LOG.names), target, batch_id)
        last = spark.read.schema(LOG).parquet(f"{target}/batch={batch_id}").agg(F.max("seq")).first()[0]
        marks.put(spark, batch_id, last or top)

    return _foreach(lines, append, checkpoint)


def judged(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of a micro-batch with a verdict, the accounts' new state) given their state (did, rev, applied).

    A verdict is kept, stale_rev, stale_resync or replayed. What an account has reached before a row
    is the greatest of its state and of the batch's earlier rows.
    """
    marker = F.col("kind").isin("account", "identity")
    own_rev, own_applied = F.when(~marker, F.col("rev")), F.when(marker, F.col("upstream_seq"))
    before = Window.partitionBy("did").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = batch.select("did", "seq", "kind", "rev", "upstream_seq").join(state.select("did", F.col("rev").alias("_rev"), F.col("applied").alias("_applied")), "did", "left")
    top = F.coalesce(F.greatest("_rev", F.max(own_rev).over(before)), F.lit(""))
    applied = F.coalesce(F.greatest("_applied", F.max(own_applied).over(before)), F.lit(-1))
    rows = rows.withColumn("_top", top).withColumn("_done", applied)
    verdict = (
        F.when(marker, F.when(F.col("upstream_seq") <= F.col("_done"), "replayed").otherwise("kept"))
        .when(F.col("kind") == "create_resync", F.when(F.col("rev") < F.col("_top"), "stale_resync").otherwise("kept"))
        .when(F.col("rev") <= F.col("_top"), "stale_rev").otherwise("kept")
    )
    new = batch.groupBy("did").agg(F.max(own_rev).alias("rev"), F.max(own_applied).alias("applied")).unionByName(state)
    new = new.groupBy("did").agg(F.coalesce(F.max("rev"), F.lit("")).alias("rev"), F.coalesce(F.max("applied"), F.lit(-1).cast("long")).alias("applied"))
    return rows.select("did", "seq", "kind", "rev", "upstream_seq", verdict.alias("verdict")), new


def _chain(stream: DataFrame, refused: str, path: str, checkpoint: str) -> StreamingQuery:
    states = StateRuns(f"{path}-state", "did string, rev string, applied long", greatest_of("did", "rev", "applied"))

    def judge(batch: DataFrame, batch_id: int) -> None:
        rows, new = judged(batch, states.of(batch, "did", batch_id))
        _write_batch(rows.where(F.col("verdict") != refused), path, batch_id)
        states.put(new, batch_id)

    return _foreach(stream, judge, checkpoint)


def rev_chain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """To path: commits and syncs whose rev moves the account on."""
    return _chain(stream, "stale_rev", path, checkpoint)


def drop_replayed(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """To path: account and identity events not applied before."""
    return _chain(stream, "replayed", path, checkpoint)


def drop_stale_resync(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """To path: resync rows, unless the account has moved on."""
    return _chain(stream, "stale_resync", path, checkpoint)


def gaps_of(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first gaps, new state) of a micro-batch of (source, upstream_seq), given (source, last, told) of its sources."""
    rows = Keyed(batch.select("source", "upstream_seq").distinct(), ["source"], "upstream_seq").previous(F.col("upstream_seq"), "_before")
    rows = rows.join(state, "source", "left")
    before = F.greatest("_before", "last")
    gaps = rows.withColumn("expected", before + 1).where("upstream_seq > expected AND NOT coalesce(told, false)")
    first = gaps.groupBy("source").agg(F.min(F.struct("upstream_seq", "expected")).alias("x"))
    first = first.select("source", F.col("x.expected").alias("expected"), F.col("x.upstream_seq").alias("got"), (F.col("x.upstream_seq") - F.col("x.expected")).alias("skipped"))
    new = rows.groupBy("source").agg(F.greatest(F.max("upstream_seq"), F.max("last")).alias("last"), F.coalesce(F.bool_or("told"), F.lit(False)).alias("told"))
    new = new.join(first.select("source", F.lit(True).alias("_now")), "source", "left").withColumn("told", F.col("told") | F.coalesce("_now", F.lit(False))).drop("_now")
    rest = state.join(new, "source", "left_anti")
    return first, new.unionByName(rest)


def continuity_loss(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """To path: the first gap of each source (source, upstream_seq); later ones are not told."""
    states = StateRuns(f"{path}-state", "source long, last long, told boolean", greatest_of("source", "last", "told"))

    def tell(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("source", F.col("source").cast("long"))
        first, new = gaps_of(batch, states.of(batch, "source", batch_id))
        _write_batch(first, path, batch_id)
        states.put(new, batch_id)

    return _foreach(stream, tell, checkpoint)


def directory_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """To path: each pair once, written by the micro-batch that saw it first, in whatever order rows come.

    Spark's state store (RocksDB, so state may outgrow memory) keeps the times of the first and the
    last micro-batch of each pair; a micro-batch asks only for its own pairs, and those whose first
    is the last are new. A retried micro-batch keeps its time, so it gives the same pairs.
    """
    rows = stream.where(F.col("kind").isin("create", "update")).withColumn("_batch", F.current_timestamp())
    pairs = rows.groupBy("collection", "did").agg(
        F.min("_batch").alias("_first"), F.max("_batch").alias("_last"), F.min(F.floor(F.col("witnessed_at") / 1000)).alias("seen_ms")
    )

    def add(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch.where("_first = _last").select("collection", "did", "seen_ms"), path, batch_id)

    with state_on_disk(stream.sparkSession):
        return _foreach(pairs, add, checkpoint, "update")


def dau_stream(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Distinct accounts per day and collection, told when the watermark closes the day.

    An account's pair is remembered for the watermark's length after it was first seen that day, so
    the watermark must not be shorter than a day.
    """
    rows = stream.where(F.col("kind").isin("create", "update")).withColumn("ts", F.timestamp_micros("witnessed_at")).withWatermark("ts", watermark)
    rows = rows.withColumn("date", F.to_date("ts").cast("string")).dropDuplicatesWithinWatermark(["did", "collection", "date"])
    return rows.groupBy(F.window("ts", "1 day").alias("day"), "collection").agg(F.count("*").alias("dids"))


def rate_windows(stream: DataFrame, hosts: DataFrame, size: str, slide: str, limit: str, watermark: str = "10 minutes") -> DataFrame:
    """Events per host in sliding windows against the host's limit (per_second, per_hour or per_day)."""
    limits = FL.small(hosts.select("host_id", *S.host_rates()).select("host_id", F.col(limit).alias("most")))
    rows = stream.withColumn("ts", F.timestamp_micros("witnessed_at")).withWatermark("ts", watermark)
    counts = rows.groupBy(F.window("ts", size, slide).alias("span"), "host_id").agg(F.count("*").alias("events"))
    return counts.join(limits, "host_id").select("host_id", F.col("span.start").alias("since"), "events", (F.col("events") > F.col("most")).alias("over_limit"))


def rate_panes(stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Events per host and second: counted once, whatever windows are asked of them later.

    A pane is state until the watermark passes it: start the stream inside ``state_on_disk``.
    """
    rows = stream.withColumn("ts", F.timestamp_micros("witnessed_at")).withWatermark("ts", watermark)
    panes = rows.groupBy(F.window("ts", "1 second").alias("pane"), "host_id").agg(F.count("*").alias("events"))
    return panes.select("host_id", F.unix_seconds("pane.start").alias("second"), "events")


#: Seconds of a sliding window and of its step, by the limit that it is held against.
SLIDES = {"per_second": (1, 1), "per_hour": (3600, 1800), "per_day": (86_400, 43_200)}


def host_limits(panes: DataFrame, hosts: DataFrame, rates: list | None = None) -> DataFrame:
    """(host_id, rate, since, events, over_limit): all three limits of every host, from its panes alone."""
    at = F.col("second")
    starts = [F.struct(F.lit(r).alias("rate"), ((F.floor(at / step) - k) * step).alias("since")) for r, (size, step) in SLIDES.items() for k in range(size // step)]
    counts = panes.select("host_id", "events", F.explode(F.array(*starts)).alias("w")).groupBy("host_id", "w.rate", "w.since").agg(F.sum("events").alias("events"))
    limits = hosts.select("host_id", *(rates or S.host_rates())).unpivot("host_id", list(SLIDES), "rate", "most")
    return counts.join(FL.small(limits), ["host_id", "rate"]).select("host_id", "rate", "since", "events", (F.col("events") > F.col("most")).alias("over_limit"))


def waits(batch: DataFrame, rate: float, global_rate: float, state: DataFrame, whole: dict) -> tuple[DataFrame, DataFrame, dict]:
    """(rows with their wait, new state of the sources, new state of the whole) of a micro-batch of (source, seq, at_us).

    A bucket holds a second's worth of its rate and is full at first. In order of time, the n-th
    event reserves a token: with x = rate * t - n, the tokens left after it are burst - 1 - (the
    greatest x so far - x), and a shortage is waited for at the bucket's rate. An event
    waits for both buckets. So a bucket is a running maximum, and needs to remember n, the greatest
    x and the latest time (earlier times count as that). Times are seconds since the first batch's.
    """
    base = whole["base"] if whole["base"] is not None else (batch.agg(F.min("at_us")).first()[0] or 0)
    rows = batch.select(F.col("source").cast("long").alias("source"), "seq", "at_us").withColumn("_t", (F.greatest("at_us", F.lit(whole["last"])) - base) / 1e6)
    rows = Ranged(rows, "_t", "seq", "source").numbered("_n").withColumn("_gx", global_rate * F.col("_t") - (F.col("_n") + whole["n"]))
    rows = Ranged(rows, "_n").running_max(F.col("_gx"), "_gtop").join(state, "source", "left")
    order = Window.partitionBy("source").orderBy("_n")
    rows = rows.withColumn("_k", F.row_number().over(order) + F.coalesce("n", F.lit(0))).withColumn("_x", rate * F.col("_t") - F.col("_k"))
    rows = rows.withColumn("_top", F.greatest(F.max("_x").over(order.rowsBetween(Window.unboundedPreceding, 0)), "most"))
    short = lambda r, top, x: F.greatest(F.lit(0.0), (top - x + 1 - r) / r)
    wait = F.greatest(short(rate, F.col("_top"), F.col("_x")), short(global_rate, F.greatest("_gtop", F.lit(whole["most"])), F.col("_gx")))
    out = rows.select("source", "seq", "at_us", F.round(wait * 1e6).cast("long").alias("wait_us")).withColumn("admitted", F.col("wait_us") == 0)
    new = rows.groupBy("source").agg(F.max("_k").cast("long").alias("n"), F.max("_top").alias("most")).unionByName(state.join(batch.select(F.col("source").cast("long").alias("source")).distinct(), "source", "left_anti"))
    total = rows.agg(F.max("_n").alias("n"), F.max("_gx").alias("most"), F.max("at_us").alias("last")).first()
    known = lambda x, y: max(v for v in (x, y) if v is not None)
    whole = {"base": base, "n": whole["n"] + (total.n or 0), "most": known(whole["most"], total.most), "last": known(whole["last"], total.last)}
    return out, new, whole


def token_bucket(stream: DataFrame, rate: float, global_rate: float, path: str, checkpoint: str) -> StreamingQuery:
    """To path: (source, seq, at_us, wait_us, admitted): how long each event waits for a token of its source and of all sources.

    Rows are marked, never held back; admitted ones don't wait. Events take their tokens in order of time.
    """
    states = StateRuns(f"{path}-state", "source long, n long, most double", greatest_of("source", "n", "most"))
    marks = Marks(path, "base long, n long, most double, last long")

    def mark(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        whole = marks.before(spark, batch_id) or {"base": None, "n": 0, "most": float("-inf"), "last": 0}
        batch = batch.withColumn("source", F.col("source").cast("long"))
        rows, new, whole = waits(batch, rate, global_rate, states.of(batch, "source", batch_id), whole)
        _write_batch(rows, path, batch_id)
        states.put(new, batch_id)
        marks.put(spark, batch_id, whole["base"], whole["n"], whole["most"], whole["last"])

    return _foreach(stream, mark, checkpoint)


def folded_state(rows: DataFrame) -> DataFrame:
    """The latest version of each record that no killer of its account is above, deletes included, and the latest killers.

    Deletes and killers stay: rows that come later may carry smaller seqs.
    """
    last = latest_version(rows.where(S.is_commit()))
    markers = rows.where(S.is_did_killer()).groupBy("did").agg(F.max_by(F.struct(*LOG.names), "seq").alias("x")).select("x.*")
    dead = markers.select("did", F.col("seq").alias("_dead"))
    alive = last.join(dead, "did", "left").where("_dead IS NULL OR seq > _dead")
    return alive.select(*LOG.names).unionByName(markers.select(*LOG.names))


def current_state_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """State runs at path: a micro-batch writes its own folded rows and reads none of the state."""
    states = StateRuns(path, LOG, folded_state)
    return _foreach(stream, lambda batch, batch_id: states.put(batch.select(*LOG.names), batch_id), checkpoint)


def live_records(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The live records after a micro-batch of current_state_stream."""
    return StateRuns(path, LOG, folded_state).rows(spark, batch_id).where(S.is_materialization())


def archive_then_live(spark: SparkSession, path: str, tip: int, wanted: Callable[[DataFrame], DataFrame] = lambda x: x) -> tuple[DataFrame, DataFrame]:
    """(archive up to the tip, stream after it): the boundary row comes once, both sides filtered alike."""
    archive = seq_window(spark.read.schema(LOG).parquet(path), None, tip)
    return wanted(archive), wanted(stream_log(spark, path).where(F.col("seq") > tip))


def with_notices(batch: DataFrame, policies: DataFrame) -> DataFrame:
    """Rows kept by the policy history and a notice row before the first row that each policy governs.

    For one micro-batch: (seq, type notice or event, policy_rev, kind, did, collection).
    """
    rows = FL.apply_policy_history(batch, policies).select("seq", F.lit("event").alias("type"), "policy_rev", "kind", "did", "collection")
    seen = batch.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    at = policies.select(F.col("revision").alias("policy_rev"), (F.coalesce("effective_after_seq", F.lit(0)) + 1).alias("seq"))
    notes = at.crossJoin(F.broadcast(seen)).where("seq >= lo AND seq <= hi")
    none = F.lit(None).cast("string")
    notes = notes.select("seq", F.lit("notice").alias("type"), "policy_rev", none.alias("kind"), none.alias("did"), none.alias("collection"))
    return notes.unionByName(rows).orderBy("seq", F.desc("type"))


def policy_notices(stream: DataFrame, policies: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    def tell(batch: DataFrame, batch_id: int) -> None:
        _write_batch(with_notices(batch, policies), path, batch_id)

    return _foreach(stream, tell, checkpoint)


def split_late(batch: DataFrame, seen_until: int, delay_us: int) -> tuple[DataFrame, DataFrame]:
    """(on time, late) of a micro-batch, given the greatest time of earlier ones; nothing is dropped."""
    late = F.col("witnessed_at") < seen_until - delay_us
    return batch.where(~late), batch.where(late)


def late_stream(stream: DataFrame, path: str, late_path: str, delay_us: int, checkpoint: str) -> StreamingQuery:
    """Rows to path, late rows to a side table. The greatest time seen is a batch's mark."""
    marks = Marks(path, "seen_until long")

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = (marks.before(spark, batch_id) or {"seen_until": 0})["seen_until"]
        good, late = split_late(batch.select(*LOG.names), seen, delay_us)
        _write_batch(good, path, batch_id)
        _write_batch(late, late_path, batch_id)
        marks.put(spark, batch_id, max(seen, batch.agg(F.max("witnessed_at")).first()[0] or 0))

    return _foreach(stream, split, checkpoint)
