"""Approximate nearest neighbours by learned partitions.

1. fit, on a bounded sample (``sample_rows`` distinct vectors with the smallest hashes): the
   sample's neighbour graph is cut into ``partitions`` balanced parts by recursive bisection
   with swaps, and a small network learns to tell a vector's part.
2. index: every distinct vector goes to its most probable part. Equal vectors are one entry
   that carries its ``k + 1`` smallest ids; as a query returns k rows besides its own, no more
   of them can ever show in a result.
3. search: queries visit their ``probes`` most probable parts. Parts are dealt into blocks of
   bounded size on both sides, one pair of blocks per task, and candidates are scored by
   inner product in double precision on the original vectors. Queries whose parts hold fewer
   than k others (small tables) visit all parts.

Joins of queries with their vectors and results salt hot ones (``skew``), so equal vectors that
make up a third of the table don't meet in one task.

Defined results: vectors that are null, zero, of another length than the most frequent one, or
that hold null or non-finite components take no part, nor do null ids; ties go to the smaller
id; a query finds fewer than k rows only if there are no more; rows that share an id count
once, with the least of their vectors; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.llm.scratch import Scratch
from seqlake.llm.skew import for_each_salt, hot_keys, with_salt

BLOCK_ROWS = 4096


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its k rows of largest inner product."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a:a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a:a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def _bisect(x: np.ndarray, graph: np.ndarray, own: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Two halves of the rows in own, with few graph edges between them: True for one half."""
    centred = x[own] - x[own].mean(0)
    axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    side = np.zeros(len(own), bool)
    side[np.argsort(centred @ axis, kind="stable")[len(own) // 2:]] = True
    place = np.full(len(x), -1)
    place[own] = np.arange(len(own))
    a = np.repeat(np.arange(len(own)), graph.shape[1])
    b = place[graph[own].ravel()]
    a, b = a[b >= 0], b[b >= 0]
    for _ in range(rounds):
        across = side[a] != side[b]
        gain = np.bincount(a, np.where(across, 1, -1), len(own)) + np.bincount(b, np.where(across, 1, -1), len(own))
        one, two = (np.flatnonzero(s)[np.argsort(-gain[s], kind="stable")] for s in (side, ~side))
        pairs = min(len(one), len(two))
        good = int(np.count_nonzero(gain[one[:pairs]] + gain[two[:pairs]] > 0)) // 2
        if not good:
            break
        side[one[:good]], side[two[:good]] = False, True
    return side


def balanced_parts(x: np.ndarray, partitions: int, degree: int = 12) -> np.ndarray:
    """A part for each row; sizes differ by one at most per level of the recursion."""
    graph, parts = neighbour_graph(x, degree), np.zeros(len(x), np.int64)
    level = 1
    while level < partitions:
        for p in range(level):
            own = np.flatnonzero(parts == p)
            if len(own) > 1:
                parts[own[_bisect(x, graph, own)]] = p + level
        level *= 2
    return parts


class Router:
    """A network with one hidden layer that gives each part's probability for a vector."""

    def __init__(self, dim: int, parts: int, hidden: int = 128, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, dim**-0.5, (dim, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def train(self, x: np.ndarray, target: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 3e-3) -> Router:
        rng, step = np.random.default_rng(5), 0
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                own = order[a:a + batch]
                hidden = np.maximum(x[own] @ self.w[0] + self.w[1], 0)
                z = hidden @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                p = p / p.sum(1, keepdims=True) - target[own]
                p /= len(own)
                back = (p @ self.w[2].T) * (hidden > 0)
                step += 1
                for k, g in enumerate((x[own].T @ back, back.sum(0), hidden.T @ p, p.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def best(self, x: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-self.logits(unit(x)), axis=1, kind="stable")[:, :probes]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, partitions: int) -> Router:
    """Parts of the sample's graph, and a router whose targets are the parts of a row's neighbours."""
    router = Router(sample.shape[1], partitions)
    if len(sample) < 2:
        return router
    parts = balanced_parts(sample, partitions)
    target = np.zeros((len(sample), partitions))
    np.add.at(target, (np.arange(len(sample)), parts), 1)
    near = neighbour_graph(sample, 12)
    for k in range(near.shape[1]):
        np.add.at(target, (np.arange(len(sample)), parts[near[:, k]]), 1 / near.shape[1])
    return router.train(unit(sample), target / target.sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _routed(shared, probes: int):
    """Rows (cid, vec, ids, part) for each of the most probable parts."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            best = shared.value.best(_matrix(batch.column("vec")), probes)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1]))
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), pa.array(best.ravel().astype(np.int32))], [*batch.schema.names, "part"])

    return run


def _scored(most: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "cid": [], "score": []}
        if candidates.num_rows and queries.num_rows:
            c, q = _matrix(candidates.column("vec")), _matrix(queries.column("vec"))
            cid, qid = candidates.column("cid").to_numpy(), queries.column("cid").to_numpy()
            longest = np.linalg.norm(c, axis=1).max()
            for a in range(0, len(q), 256):
                rough = q[a:a + 256] @ c.T
                keep = min(most, len(c))
                bar = np.partition(rough, len(c) - keep, axis=1)[:, len(c) - keep]
                slack = 1e-12 * longest * np.linalg.norm(q[a:a + 256], axis=1)  # what rounding may hide
                for k in range(len(rough)):
                    near = np.flatnonzero(rough[k] >= bar[k] - slack[k])
                    exact = (c[near] * q[a + k]).sum(1)
                    order = np.lexsort((cid[near], -exact))[:most]
                    out["query"].append(np.full(len(order), qid[a + k]))
                    out["cid"].append(cid[near][order])
                    out["score"].append(exact[order])
        flat = {k: np.concatenate(v) if v else np.zeros(0, np.float64 if k == "score" else np.int64) for k, v in out.items()}
        return pa.table(flat)

    return run


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the vectors that take part."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(finite & F.exists(vec_col, lambda x: x != 0))
    vectors = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    most = vectors.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return vectors.where(F.size("vec") == (most.dim if most else 0))


def _found(index: DataFrame, asked: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(query, cid, score): the k + 1 best classes of each query in the parts that it visits."""
    blocks = index.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("ci"))
    blocks = blocks.join(asked.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("qi")), "part")
    blocks = F.broadcast(scratch.save(blocks, "blocks"))  # a row per part
    left = index.join(blocks, "part").select(
        "part", F.pmod(F.xxhash64("cid"), F.col("ci")).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.col("qi") - 1)).alias("q"), "cid", "vec"
    )
    right = asked.join(blocks, "part").select(
        "part", F.explode(F.sequence(F.lit(0), F.col("ci") - 1)).alias("c"), F.pmod(F.xxhash64("cid"), F.col("qi")).cast("int").alias("q"), "cid", "vec"
    )
    found = left.groupBy("part", "c", "q").cogroup(right.groupBy("part", "c", "q")).applyInArrow(_scored(k + 1), "query long, cid long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "cid")
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")


def nearest(
    rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    partitions: int = 64, probes: int = 46, sample_rows: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where is_query holds, the k nearest others found."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "neighbours")
    vectors = valid_vectors(rows, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec"))
    vectors = scratch.save(vectors.withColumn("same", F.xxhash64("vec")), "vectors")
    by_id = Window.partitionBy("same", "vec").orderBy("id")  # cut to k + 1 rows before the shuffle as well
    firsts = vectors.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    classes = firsts.groupBy("same", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "same", "vec", "ids")
    classes = scratch.save(classes, "classes")
    sample = classes.select("vec", "cid").orderBy(F.xxhash64("vec"), "cid").limit(sample_rows).select("vec").collect()
    dim = len(sample[0].vec) if sample else 1
    router = fit(np.array([r.vec for r in sample], float).reshape(len(sample), dim), partitions)
    shared = spark.sparkContext.broadcast(router)

    vec = dict(classes.dtypes)["vec"]
    index = scratch.save(classes.select("cid", "vec").mapInArrow(_routed(shared, 1), f"cid long, vec {vec}, part int"), "index")
    asking = vectors.where(is_query(F.col("id")))
    hot = scratch.save(hot_keys(asking.groupBy("same").agg(F.count("*").alias("n")), vectors.count()), "hot")
    asking = with_salt(asking, hot, F.col("id")).join(for_each_salt(classes.select("cid", "same", "vec"), hot), ["same", "salt", "vec"])
    asking = scratch.save(asking.select("id", "cid"), "asking")
    queries = asking.groupBy("cid").agg(F.count("*").alias("n"))
    hot = scratch.save(hot_keys(queries, vectors.count()), "hot")

    def search(queries: DataFrame, probes: int) -> DataFrame:
        """(query, vec_id, score): the k + 1 nearest rows found of each query class."""
        asked = classes.join(queries, "cid", "left_semi").select("cid", "vec")
        asked = scratch.save(asked.mapInArrow(_routed(shared, probes), f"cid long, vec {vec}, part int"), "asked")
        found = _found(index, asked, k, scratch).join(classes.select("cid", "ids"), "cid").select("query", F.explode("ids").alias("vec_id"), "score")
        nearest_ids = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return scratch.save(found.withColumn("n", F.row_number().over(nearest_ids)).where(F.col("n") <= k + 1).drop("n"), "near")

    near = search(queries, min(probes, partitions))
    short = near.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") <= k).select("query")  # a query's own row is one of them
    missed = queries.join(near.withColumnRenamed("query", "cid"), "cid", "left_anti").select("cid").unionByName(short.withColumnRenamed("query", "cid"))
    missed = scratch.save(missed, "missed")
    if probes < partitions and not missed.isEmpty():
        near = near.join(missed.withColumnRenamed("cid", "query"), "query", "left_anti").unionByName(search(missed, partitions))
    scratch.drop(vectors, classes, index)
    answers = with_salt(asking, hot, F.col("id")).join(for_each_salt(near.withColumnRenamed("query", "cid"), hot), ["cid", "salt"]).where("id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))
    return answers.select(F.col("id").alias("query_id"), rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op1_learned_partitions(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, lambda i: i % 20 == 0)
