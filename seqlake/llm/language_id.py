"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of the lower-cased words, with a space at either end, hashed to
``buckets``; a feature's value is its share of the text's n-grams times its inverse document
frequency. Document frequencies cover all rows that may be learned from. Weights are
trained with follow-the-regularised-leader (per-coordinate rates, elastic-net penalty) on a
bounded sample, ``rows_per_language`` rows of each label with the smallest hashes; a fifth of
it is kept aside to fit one softmax temperature. What the penalty leaves at zero is not stored.

Rows of a label are counted first, and only those with hashes below about twice the share asked for
are ranked, so no more than that meets in one task. The driver trains on the sample and
holds ``buckets`` x labels numbers: it is meant for labels by the hundred.

As the value is linear in the n-gram counts, a text's logits are sums over its words; each
distinct word of a batch is scored once.

Defined results: null text, or one without a letter, is ``und`` with score 0; empty and very
long texts are read whole; labels that are null are not learned; if nothing can be learned
every row is ``und``; ties go to the label that sorts first; rows are never merged, and rows
that share an id are told apart by the hash of their text; other columns are not read, nor are kept
columns named lang_pred or score, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.llm.scratch import Scratch, short_batches
from seqlake.llm.text import lists, mix, words

SCALE = 20.0
PIECE = 1 << 19  # bytes of text whose words are looked up at once: n-grams take some hundred times that
_STEP = np.uint64(0xD6E8FEB86659FD93)


def word_grams(distinct: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all 1- to 3-grams by word, offsets by word)."""
    points = np.frombuffer(f" {b' '.join(distinct).decode('utf-8', 'replace').lower()} ".encode("utf-32-le", "replace"), np.uint32)
    space = points == 0x20
    word = np.cumsum(space) - 1
    code = points.astype(np.uint64)
    grams, owner, h = [], [], np.zeros(len(code), np.uint64)
    for n in (1, 2, 3):
        m = len(code) - n + 1
        h = (h[:m] ^ (h[:m] >> np.uint64(29))) * _STEP + code[n - 1:] + np.uint64(n)
        held = ~space[:m] if n == 1 else np.ones(m, bool) if n == 2 else ~space[1:m + 1]
        if n == 2:
            held = ~(space[:m] & space[1:])
        held = held & (word[:m] < len(distinct))
        grams.append(mix(h[held]) % np.uint64(buckets))
        owner.append(word[:m][held])
    grams, owner = np.concatenate(grams).astype(np.int32), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return grams[order], np.searchsorted(owner[order], np.arange(len(distinct) + 1))


def word_table(w, buckets: int):
    """(place of each word among the piece's distinct words, their n-grams, offsets)."""
    _, at, place = np.unique(w.hashes(), return_index=True, return_inverse=True)
    data = w.data.tobytes()
    distinct = [data[s:e] for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist())]
    return place, *word_grams(distinct, buckets)


def _spread(values: np.ndarray, off: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The values of the chosen rows of a ragged table, one after another."""
    size = off[chosen + 1] - off[chosen]
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(off[chosen] - ends + size, size)]


def _vectors(buckets: int):
    """Rows (id, grams, counts) of whole texts."""

    def run(batches):
        for batch in batches:
            rows, grams, counts = [], [], []
            for w in words(batch.column(1), PIECE):
                if not len(w.starts):
                    continue
                place, values, off = word_table(w, buckets)
                for row, a, b in zip(w.rows.tolist(), w.first[:-1].tolist(), w.first[1:].tolist()):
                    if b > a:
                        g, c = np.unique(_spread(values, off, place[a:b]), return_counts=True)
                        rows.append(row)
                        grams.append(g)
                        counts.append(c)
            if rows:
                ends = np.array([0, *np.cumsum([len(g) for g in grams])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), *(lists(np.concatenate(x).astype(np.int64), ends) for x in (grams, counts))], ["id", "grams", "counts"]
                )

    return run


def _frequencies(buckets: int):
    """Rows (gram, docs): in how many texts of a split a bucket shows."""

    def run(batches):
        docs, mark = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for w in words(batch.column(0), PIECE):
                if not len(w.starts):
                    continue
                place, values, off = word_table(w, buckets)
                for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                    if b > a:
                        g = _spread(values, off, np.unique(place[a:b]))
                        here = np.arange(len(g))
                        mark[g] = here
                        docs[g[mark[g] == here]] += 1
        found = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(docs[found])], ["gram", "docs"])

    return run


def ftrl(rows, labels, classes: int, buckets: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4):
    """Weights (buckets, classes) of a softmax over sparse rows [(index, value)]."""
    z, n = np.zeros((buckets, classes)), np.zeros((buckets, classes))

    def leader(zi, ni):
        return np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            index, value = rows[k]
            zi, ni = z[index], n[index]
            w = leader(zi, ni)
            logits = value @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            g = value[:, None] * p[None, :]
            moved = ni + g * g
            z[index] = zi + g - (np.sqrt(moved) - np.sqrt(ni)) / alpha * w
            n[index] = moved
    return leader(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The softmax temperature of least loss on rows that were not trained on."""
    def loss(t):
        x = logits / t
        x = x - x.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), labels]))

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 61))
    return float(min(grid, key=loss)) if len(labels) else 1.0


class LanguageModel:
    """What fit learned: labels, weights by n-gram bucket (idf included) and temperature.

    weights has a row for each bucket with a weight that isn't zero, after a first row of zeros for
    all other buckets; place gives each bucket's row.
    """

    def __init__(self, labels: list[str], weights: np.ndarray, heat: float):
        learned = np.flatnonzero(weights.any(axis=1))
        self.labels, self.heat = labels, heat
        self.weights = np.concatenate([np.zeros((1, len(labels)), np.float32), weights[learned].astype(np.float32)])
        self.place = np.zeros(len(weights), np.int32)
        self.place[learned] = np.arange(1, len(learned) + 1)


def sample_of(known: DataFrame, most: int) -> DataFrame:
    """Of (id, row, lang, ...), (id, row, lang, k): the rows of each lang with the ``most`` smallest hashes, k from 1.

    Rows repeated with one id and text count once, so copies can't fill the sample.
    """
    known = known.select("id", "row", "lang").distinct()
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))  # a row per label
    share = F.least(F.lit(1.0), (2.0 * most + 64) / F.col("n"))
    u = F.shiftrightunsigned(F.xxhash64("id", "row"), 11) / float(1 << 53)
    few = known.select("id", "row", "lang", u.alias("u")).join(F.broadcast(counts.select("lang", share.alias("share"))), "lang").where("u < share")
    by_hash = Window.partitionBy("lang").orderBy("u", "id", "row")
    return few.withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= most).select("id", "row", "lang", "k")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_language: int = 800, buckets: int = 1 << 17) -> LanguageModel:
    """Learn from all rows of docs that have a text and a label."""
    scratch = Scratch(docs.sparkSession, "language")
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample = scratch.save(sample_of(known, rows_per_language), "sample")
    total = known.count()
    docs_by_gram = known.select("text").mapInArrow(_frequencies(buckets), "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
    idf = np.full(buckets, np.log(1.0 + total))
    for r in docs_by_gram.toLocalIterator():
        idf[r.gram] = np.log((1 + total) / (1 + r.docs)) + 0.1

    wanted = F.broadcast(sample.select(F.col("id").alias("_id"), F.col("row").alias("_row")).distinct())  # rows_per_language rows per label
    chosen = known.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left_semi").select(F.struct("id", "row").alias("id"), "text")
    rows, place = [], {}
    id_type = known.schema["id"].dataType.simpleString()
    for r in chosen.mapInArrow(_vectors(buckets), f"id struct<id:{id_type},row:long>, grams array<long>, counts array<long>").toLocalIterator():
        if tuple(r.id) not in place:
            g, c = np.array(r.grams), np.array(r.counts, float)
            place[tuple(r.id)] = len(rows)
            rows.append((g, (SCALE * c / c.sum() * idf[g]).astype(np.float32)))
    ranked = sorted((r.k, r.lang, (r.id, r.row)) for r in sample.collect() if (r.id, r.row) in place)
    picked = [(k, own, lang) for k, lang, own in ranked]
    labels = sorted({lang for _, _, lang in picked})
    scratch.drop(sample)
    if not labels:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), 1.0)
    target = {lang: i for i, lang in enumerate(labels)}
    train, held = [x for x in picked if x[0] % 5], [x for x in picked if x[0] % 5 == 0]
    weights = ftrl([rows[place[i]] for _, i, _ in train], [target[lang] for *_, lang in train], len(labels), buckets)
    logits = np.array([rows[place[i]][1] @ weights[rows[place[i]][0]] for _, i, _ in held]).reshape(len(held), len(labels))
    heat = temperature(logits, np.array([target[lang] for *_, lang in held], int))
    return LanguageModel(labels, (SCALE * idf[:, None] * weights).astype(np.float32), heat)


def _predicted(model):
    def run(batches):
        labels, weights, heat, learned = model.value
        for batch in batches:
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            letter = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for w in words(batch.column(1), PIECE):
                if not len(w.starts) or not labels:
                    continue
                place, grams, off = word_table(w, len(learned))
                sums = np.add.reduceat(weights[learned[grams]], off[:-1], axis=0, dtype=np.float64)
                full = np.flatnonzero(np.diff(w.first))
                at = w.first[:-1][full]
                logits = np.add.reduceat(sums[place], at, axis=0) / np.add.reduceat(np.diff(off)[place], at)[:, None] / heat
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best[w.rows[full]] = p.argmax(1)
                score[w.rows[full]] = p.max(1)
            best[~letter], score[~letter] = -1, 0
            names = pa.array([labels[k] if k >= 0 else "und" for k in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], names, pa.array(score)], [*batch.schema.names[2:], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score, one row per input row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.labels, model.weights, model.heat, model.place))
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    short_batches(spark)
    kept = [c for c in keep if c not in ("lang_pred", "score")]
    # Inner columns go by position, so kept ones may have any name.
    rows = docs.select(letter.alias("_0"), F.col(text_col).alias("_1"), *[F.col(c).alias(f"_{k + 2}") for k, c in enumerate(kept)])
    types = [f.dataType.simpleString() for f in docs.select(*kept).schema]
    schema = "".join(f"_{k + 2} {t}, " for k, t in enumerate(types)) + "lang_pred string, score double"
    return rows.mapInArrow(_predicted(shared), schema).toDF(*kept, "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
