"""Phrase collocation mining with counting quotient filters.

Per language, phrases of two and three words are counted and scored by how much more often they
show than their parts. A phrase is no more frequent than its rarest word, so only words that
reach the least count get numbers, and n-grams with another word are not counted: nothing that
could be a candidate is lost.

1. words: a chunk of documents of one language (``chunks``) is a list of its distinct words with
   their counts and a stream of places in that list, -1 between pieces. Words' counts are summed,
   frequent words are numbered, and numbers come back by chunk.
2. filters: an n-gram packs its word numbers into 3 x bits. ``Permutation`` maps these one to one
   to a quotient (the highest bits) and the whole remainder, so a counter loses nothing. A task
   keeps one sorted filter, merges each block of new n-grams into it, and hands it on by shards
   (the first bits of the quotient) when it is full: a run length per quotient, then remainders
   and counters in as few bytes as they need (``Filter``).
3. a shard's sorted filters are merged; counts that reach the least count are turned back into
   words' numbers.
4. scores are exact decimals. Frequent phrases, lengths of parts and longer candidates meet in
   joins on words' numbers; the best of each language are picked per salt, then over all salts.

A language may hold any share of the rows: its words and n-grams are spread by chunk, word and shard.

Defined results: null texts are empty; a null language is ``und``; texts of any length are counted
whole; repeated rows count each time; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.llm.chunks import chunk_ids, with_found
from seqlake.llm.scratch import Scratch
from seqlake.llm.skew import SALTS
from seqlake.llm.text import texts

CHUNK_BYTES = 4 << 20
BLOCK_NGRAMS = 1 << 20  # n-grams sorted at once
FULL = 3 << 19  # entries of a task's filter that is handed on
SHARD_NGRAMS = 4 << 20

_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

CHUNK = "chunk long, lang string, words array<string>, times array<long>, stream array<int>"
FILTER = "shard int, quotient_bits int, runs binary, remainders binary, counters binary, large array<long>"


def word_stream(data: np.ndarray, off: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(all words of the texts, places in their dictionary with -1 between pieces)."""
    data = _LOWER[data]
    kind = _CLASS[data]
    inside = np.concatenate([[False], kind == 0, [False]])
    cuts = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    at = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    to = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    cuts = cuts[inside[cuts] & inside[cuts + 1]]  # texts that meet inside a run of word bytes
    at, to = np.union1d(at, cuts), np.union1d(to, cuts)
    piece = np.cumsum(kind == 2)[at] if len(at) else np.zeros(0, np.int64)
    new = np.diff(piece + np.searchsorted(off, at, "right"), prepend=0) > 0
    if len(data) < 2**31:
        bounds = np.empty(2 * len(at) + 1, np.int32)
        bounds[:-1:2], bounds[1::2], bounds[-1] = at, to, to[-1] if len(to) else 0
        every = pa.StringArray.from_buffers(2 * len(at), pa.py_buffer(bounds), pa.py_buffer(data))
        words = every.take(pa.array(np.arange(0, 2 * len(at), 2)))
    else:
        words = pa.array([data[a:b].tobytes().decode() for a, b in zip(at, to)], pa.string())
    words = pc.dictionary_encode(words)
    stream = np.full(len(at) + int(new.sum()), -1, np.int32)
    stream[np.arange(len(at)) + np.cumsum(new)] = np.asarray(words.indices)
    return words.dictionary, stream


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = chunk_ids()

    def told(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        for lang in pc.unique(table.column("lang")):
            own = table.filter(pc.equal(table.column("lang"), lang))
            words, stream = word_stream(*texts(own.column("text")))
            if len(words):
                times = pa.array(np.bincount(stream[stream >= 0], minlength=len(words)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([next(number)]), pa.array([lang.as_py()]), _list(words), _list(times), _list(pa.array(stream))], ["chunk", "lang", "words", "times", "stream"])

    rows, size = [], 0
    for batch in batches:
        rows.append(batch)
        size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if size >= CHUNK_BYTES:
            yield from told(rows)
            rows, size = [], 0
    if rows:
        yield from told(rows)


class Permutation:
    """One-to-one scrambling of three numbers of so many bits: (first: bits, rest: 2 x bits)."""

    # Odd numbers, by which multiplying can be undone.
    ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93, 0x94D049BB133111EB)]

    def __init__(self, bits: int):
        if not 1 <= bits <= 32:
            raise ValueError(f"words' numbers of {bits} bits")
        self.bits = np.uint64(bits)
        self.rest_bits = 2 * bits
        self.mask = np.uint64(2 ** (2 * bits) - 1)
        self.back = [np.uint64(pow(int(x), -1, 1 << 64)) for x in self.ODD]

    def _spread(self, first: np.ndarray) -> np.ndarray:
        return (first * self.ODD[2] ^ (first * self.ODD[3] >> np.uint64(31))) & self.mask

    def _fold(self, rest: np.ndarray) -> np.ndarray:
        return (rest * self.ODD[3] & self.mask) >> self.bits

    def scramble(self, first: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = rest ^ self._spread(first)
        for odd in self.ODD[:2]:
            rest = rest * odd & self.mask
            rest ^= rest >> self.bits
        return first ^ self._fold(rest), rest

    def restore(self, first: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = first ^ self._fold(rest)
        for back in self.back[1::-1]:
            rest = rest ^ (rest >> self.bits)
            rest = rest * back & self.mask
        return first, rest ^ self._spread(first)


class Filter:
    """A sorted counting quotient filter: scrambled n-grams (rest, first) with their counts."""

    def __init__(self, bits: int, rest: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.bits, self.rest, self.first, self.count = bits, rest, first, count

    @classmethod
    def of(cls, bits: int, rest: np.ndarray, first: np.ndarray, count: np.ndarray) -> Filter:
        """Sort and add up; both parts fit one key up to 21 bits."""
        if 3 * bits <= 64:
            order = np.argsort(rest << np.uint64(bits) | first, kind="stable")
        else:
            order = np.lexsort((first, rest))
        rest, first, count = rest[order], first[order], count[order]
        new = np.ones(len(rest), bool)
        new[1:] = (rest[1:] != rest[:-1]) | (first[1:] != first[:-1])
        start = np.flatnonzero(new)
        return cls(bits, rest[start], first[start], np.add.reduceat(count, start) if len(start) else count)

    @classmethod
    def merged(cls, filters: list[Filter]) -> Filter:
        parts = [np.concatenate([getattr(f, c) for f in filters]) for c in ("rest", "first", "count")]
        return cls.of(filters[0].bits, *parts)

    def packed(self, shard_bits: int) -> pa.RecordBatch:
        """A row per shard: run lengths by quotient, remainders, counters of a byte each, larger ones apart."""
        rest_bits = 2 * self.bits
        shard = (self.rest >> np.uint64(rest_bits - shard_bits)).astype(np.int64)
        full, at = np.unique(shard, return_index=True)
        rows = {c: [] for c in ("quotient_bits", "runs", "remainders", "counters", "large")}
        for a, b in zip(at, np.append(at[1:], len(shard))):
            q = int(min(max((b - a).item().bit_length() - 1, 0), 24, rest_bits - shard_bits))
            low = rest_bits - shard_bits - q
            quotient = (self.rest[a:b] >> np.uint64(low)) & np.uint64(2**q - 1)
            runs = np.bincount(quotient.astype(np.int64), minlength=2**q)
            width = 1 if runs.max() < 2**8 else 4
            rest = self.rest[a:b] & np.uint64(2**low - 1)
            count = self.count[a:b]
            rows["quotient_bits"].append(q)
            rows["runs"].append(bytes([width]) + runs.astype(f"<u{width}").tobytes())
            rows["remainders"].append(_bytes(rest, low) + _bytes(self.first[a:b], self.bits))
            rows["counters"].append(np.minimum(count, 255).astype(np.uint8).tobytes())
            rows["large"].append(count[count >= 255])
        types = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(v, t) for v, t in zip(rows.values(), types))], ["shard", *rows])

    @classmethod
    def unpacked(cls, bits: int, shard_bits: int, row: dict) -> Filter:
        q, counters = row["quotient_bits"], np.frombuffer(row["counters"], np.uint8)
        low = 2 * bits - shard_bits - q
        runs = np.frombuffer(row["runs"], f"<u{row['runs'][0]}", offset=1)
        n = len(counters)
        middle = n * -(-low // 8)
        rest, first = _numbers(row["remainders"][:middle], low, n), _numbers(row["remainders"][middle:], bits, n)
        high = np.repeat(np.arange(2**q, dtype=np.uint64) + np.uint64(row["shard"] << q), runs)
        count = counters.astype(np.int64)
        count[counters == 255] = row["large"]
        return cls(bits, high << np.uint64(low) | rest, first, count)


def _bytes(values: np.ndarray, bits: int) -> bytes:
    width = -(-bits // 8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _numbers(data: bytes, bits: int, n: int) -> np.ndarray:
    width = -(-bits // 8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def ngrams(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, rest) of all runs of two and three numbers without a 0; a missing third is 0."""
    ids = ids.astype(np.uint64)
    two = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    three = two[:-1][np.diff(two) == 1] if len(two) else two
    b = np.uint64(bits)
    rest = np.concatenate([ids[two + 1] << b, ids[three + 1] << b | ids[three + 2]])
    return np.concatenate([ids[two], ids[three]]), rest


def _filters(bits: int, shard_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scrambled = Permutation(bits)
        own: Filter | None = None
        held, waiting = [], 0

        def merge() -> None:
            nonlocal own, held, waiting
            first, rest = (np.concatenate(x) for x in zip(*held))
            for a in range(0, len(first), BLOCK_NGRAMS):
                f, r = scrambled.scramble(first[a:a + BLOCK_NGRAMS], rest[a:a + BLOCK_NGRAMS])
                block = Filter.of(bits, r, f, np.ones(len(f), np.int64))
                own = Filter.merged([own, block]) if own else block
            held, waiting = [], 0

        for batch in batches:
            for stream, found in zip(batch.column("stream"), batch.column("found")):
                if not found.is_valid:
                    continue
                place = np.asarray(stream.values)
                ids = np.zeros(int(place.max(initial=0)) + 2, np.int64)  # the last stands for -1
                ids[np.asarray(found.values.field("pos"))] = np.asarray(found.values.field("id"))
                held.append(ngrams(ids[place], bits))
                waiting += len(held[-1][0])
                if waiting >= BLOCK_NGRAMS:
                    merge()
                    if len(own.rest) >= FULL:
                        yield own.packed(shard_bits)
                        own = None
        if waiting:
            merge()
        if own and len(own.rest):
            yield own.packed(shard_bits)

    return run


def _counted(bits: int, shard_bits: int, least: int):
    """Of one shard: n-grams (w1, w2, w3, a) that its filters hold least times or more together."""

    def run(table: pa.Table) -> pa.Table:
        every = Filter.merged([Filter.unpacked(bits, shard_bits, row) for row in table.to_pylist()])
        often = every.count >= least
        first, rest = Permutation(bits).restore(every.first[often], every.rest[often])
        low = np.uint64(2**bits - 1)
        numbers = [x.astype(np.int64) for x in (first, rest >> np.uint64(bits), rest & low)]
        return pa.table({"w1": numbers[0], "w2": numbers[1], "w3": numbers[2], "a": every.count[often]})

    return run


def numbered(words: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(words with id from 1 up, the greatest id): a row's place in its partition of the written table, interleaved."""
    placed = scratch.save(words.withColumn("_m", F.monotonically_increasing_id()), "placed")
    part, row = F.shiftright("_m", 33), F.col("_m").bitwiseAND(2**33 - 1)
    most = placed.agg(F.coalesce(F.max(part), F.lit(0)).alias("part"), F.coalesce(F.max(row), F.lit(0)).alias("row")).first()
    ids = placed.withColumn("id", row * (most.part + 1) + part + 1).drop("_m")
    return ids, (most.row + 1) * (most.part + 1)


def frequent_ngrams(docs: DataFrame, least: int, text_col: str, lang_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(n-grams (w1, w2, w3, a) by ids, words (lang, word, f, id), words of all (lang, n))."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    chunks = scratch.save(rows.mapInArrow(_words, CHUNK), "chunks")
    each = chunks.select("lang", F.explode(F.arrays_zip("words", "times")).alias("x")).select("lang", "x.words", "x.times")
    counts = scratch.save(each.groupBy("lang", F.col("words").alias("word")).agg(F.sum("times").alias("f")), "counts")
    sizes = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words, most = numbered(counts.where(F.col("f") >= least), scratch)
    words = scratch.save(words, "words")
    bits = max(1, most.bit_length())
    total = counts.agg(F.sum("f")).first()[0] or 0
    shard_bits = min(2 * bits, max(0, -(-2 * total // SHARD_NGRAMS) - 1).bit_length())
    found = with_found(chunks.select("chunk", "lang", "words", "stream"), "words", words.select("lang", "word", "id"), "word", ["id"], ("lang",))
    filters = found.select("stream", "found").mapInArrow(_filters(bits, shard_bits), FILTER)
    grams = filters.groupBy("shard").applyInArrow(_counted(bits, shard_bits, least), "w1 long, w2 long, w3 long, a long")
    return scratch.save(grams, "ngrams"), words, sizes


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in decimals of 37 digits: counts up to 10^14 for a, 10^18 for parts."""
    big = lambda c, p: c.cast(f"decimal({p},0)")
    top = F.lit(1_000_000).cast("decimal(7,0)") * big(a, 14) * big(a, 14)
    return F.call_function("div", top, big(left, 18) * big(right, 18))


def scored(grams: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, w1, w2, w3, a, l, r, score): of a phrase's cuts the one with the lowest score, the first of these."""
    one = lambda name, f: words.select(F.col("id").alias(name), F.col("f").alias(f))
    pairs, triples = grams.where("w3 = 0"), grams.where("w3 > 0")
    pairs = pairs.join(words.select(F.col("id").alias("w1"), "lang", F.col("f").alias("l")), "w1").join(one("w2", "r"), "w2")
    pairs = pairs.select("lang", "w1", "w2", "w3", "a", "l", "r", exact_score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    two = grams.where("w3 = 0")
    triples = triples.join(words.select(F.col("id").alias("w1"), "lang", F.col("f").alias("f1")), "w1").join(one("w3", "f3"), "w3")
    triples = triples.join(two.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"])
    triples = triples.join(two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
    cut = lambda k, left, right: F.struct(exact_score(F.col("a"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    triples = triples.withColumn("x", F.least(cut(1, "f1", "f23"), cut(2, "f12", "f3")))
    return pairs.unionByName(triples.select("lang", "w1", "w2", "w3", "a", "x.l", "x.r", "x.score"))


def without_parts(phrases: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """phrases without the pairs that stand in a frequent triple with at least so many percent of their count."""
    triples = grams.where("w3 > 0")
    longer = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = longer.groupBy("w1", "w2").agg(F.max("a").alias("_longer")).withColumn("w3", F.lit(0).cast("long"))
    kept = phrases.join(longer, ["w1", "w2", "w3"], "left")
    return kept.where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * percent)).drop("_longer")


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of two and three words of each language."""
    scratch = Scratch(docs.sparkSession, "phrases")
    grams, words, sizes = frequent_ngrams(docs, least, text_col, lang_col, scratch)
    kept = without_parts(scored(grams, words), grams, percent)
    name = lambda k: words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"))
    named = kept.join(name(1), "w1").join(name(2), "w2").join(name(3), "w3", "left")
    named = named.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = named.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_k") <= most).drop("_k", "_salt")
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP13_SQL = r"""
WITH p AS (SELECT lang, unnest(list_transform(string_split_regex(text, '[.,;:!?\x0A-\x0D]'), lambda x: regexp_extract_all(x, '[^\x20\x09]+'))) AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p CROSS JOIN (SELECT unnest([1, 2, 3]) AS k))),
c AS MATERIALIZED (SELECT lang, k, phrase, concat(lang, chr(10), phrase) AS q, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND a >= 10),
h AS (SELECT lang, k, phrase, a, 1 AS cut, concat(lang, chr(10), w[1]) AS first, concat(lang, chr(10), array_to_string(w[2:], ' ')) AS rest FROM f UNION ALL SELECT lang, k, phrase, a, 2, concat(lang, chr(10), array_to_string(w[1:2], ' ')), concat(lang, chr(10), w[3]) FROM f WHERE k = 3),
s AS (SELECT h.*, x.a AS l, y.a AS r, CAST(CAST(1000000 AS HUGEINT) * h.a * h.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM h JOIN c x ON x.q = h.first JOIN c y ON y.q = h.rest),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM s) WHERE best = 1),
t AS (SELECT lang, phrase, max(a) AS longer FROM (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM f WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM f WHERE k = 3) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN t ON b.lang = t.lang AND b.phrase = t.phrase WHERE b.k = 3 OR t.longer IS NULL OR 100 * t.longer < 50 * b.a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT q.lang, q.rank, q.phrase, q.a, q.l, q.r, n.n, q.score FROM q JOIN n ON q.lang = n.lang WHERE q.rank <= 2000
"""
