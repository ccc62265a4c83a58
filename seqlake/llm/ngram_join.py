"""N-gram Jaccard join by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct word 5-grams (A-Z lower-cased). The
global order of n-grams is cut into ``FRAGMENTS`` equal ranges of hashes, the vertical partitions.
The overlap of a pair is counted in each fragment on its own, in a shuffle by (fragment, set), and
the partial counts are summed per pair. The join is exact over the sets:

1. sets: one row per row of the input with its set's size and 128-bit key; equal sets are one
   class, told by the key's first half.
2. screening: in the first fragments alone, n-grams held by one class only are counted per
   class. A class with more of them than its size allows at the asked similarity can't link
   and leaves. Splits send at most two classes per n-gram, so frequent n-grams stay cheap.
3. prefixes: the rest orders its n-grams by frequency, then hash; two sets that link share an
   n-gram among their first ``size - need + 1``. Only n-grams above total / 65536 carry a
   counted frequency, so what is broadcast has 65536 rows at most. The first n-gram that two sets
   share leaves them no more overlap than n-grams from there on: the position filter.
4. rounds: of the classes that share a prefix n-gram, a few are stars, picked by hash. Every other
   one is compared with the stars, if sizes and positions allow a link and they don't stand in
   one component yet. Linked classes contract to components, and the stars leave the n-gram's
   list, as they are done with it. There is one star in the first round, then sixteen times as
   many each time; an n-gram with no more classes than stars is settled by
   that. So a group of near copies collapses in the first rounds for the price of its size, and
   the pairs within a group are never listed while contraction makes progress.
5. before the second round, classes are screened again by n-grams that their own component holds
   alone.

Defined results: text without words, or null, has size 0, links with nothing and is its own
component; fewer than five words make one shingle of the whole sequence; equal texts share a
component; rows that share an id are compared by their own texts; a row with a null id shares
the component of the rows with an equal set, and where none of these has an id links with
nothing more and has a null component; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.components import components
from seqlake.llm.scratch import Scratch
from seqlake.llm.skew import for_each_salt, hot_keys, side, with_salt
from seqlake.llm.text import lists, mix, words

FRAGMENTS = 8
SCREENED = 3
FEW_HOLDERS = 64
PART_NGRAMS = 2_000_000
PART_CLASSES = 20_000
STARS = (1, 16)
STARS_GROW = 16
HEAVY_ROWS = 1 << 16
PIECE = 1 << 20  # bytes of text whose n-grams are hashed at once
_STEP = np.uint64(0xD6E8FEB86659FD93)


def ngram_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of every text with words."""
    for w in words(column, PIECE):
        h = w.hashes(lower=True)
        grams = h[: max(0, len(h) - n + 1)] * _STEP
        for j in range(1, n):
            grams = ((grams ^ (grams >> np.uint64(32))) + h[j:j + len(grams)]) * _STEP
        grams = mix(grams)
        for row, a, b in zip(w.rows.tolist(), w.first[:-1].tolist(), w.first[1:].tolist()):
            if b - a >= n:
                yield row, np.unique(grams[a:b - n + 1])
            elif b > a:
                whole = np.full(1, b - a, np.uint64)
                for x in h[a:b]:
                    whole = ((whole ^ (whole >> np.uint64(32))) + x) * _STEP
                yield row, mix(whole)


def set_key(grams: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sets(n: int):
    def run(batches):
        for batch in batches:
            size, hi, lo = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, grams in ngram_sets(batch.column(1), n):
                size[row] = len(grams)
                hi[row], lo[row] = set_key(grams)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(hi), pa.array(lo)], ["id", "n", "hi", "lo"])

    return run


def _screen_rows(n: int, parts: int):
    """Rows (part, grams, who, sets): in each split, two classes at most per n-gram."""
    top = np.uint64(SCREENED << 61)
    cuts = np.array([SCREENED * (1 << 61) * p // parts for p in range(1, parts)], np.uint64)

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys, found = [], []
            for _, grams in ngram_sets(batch.column(0), n):
                key = set_key(grams)
                if key not in seen:
                    seen.add(key)
                    keys.append(key[0])
                    found.append(grams[: np.searchsorted(grams, top)])
            if not found:
                continue
            grams = np.concatenate(found)
            who = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])
            order = np.argsort(grams, kind="stable")
            grams, who = grams[order], who[order]
            new = np.ones(len(grams), bool)
            new[1:] = grams[1:] != grams[:-1]
            keep = new | np.append(new[1:], True)
            grams, who = grams[keep], who[keep]
            bounds = np.concatenate([[0], np.searchsorted(grams, cuts), [len(grams)]])
            full = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
            if not full:
                continue
            off = np.array([0, *np.cumsum([bounds[p + 1] - bounds[p] for p in full])])
            local = [np.unique(who[bounds[p]:bounds[p + 1]], return_inverse=True) for p in full]
            sets = np.concatenate([np.array(keys, np.int64)[u] for u, _ in local])
            set_off = np.array([0, *np.cumsum([len(u) for u, _ in local])])
            places = np.concatenate([v for _, v in local]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), lists(grams, off), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(places)), lists(sets, set_off)],
                ["part", "grams", "who", "sets"],
            )

    return run


def _alone(buckets: int):
    """Of one part: rows (bucket, hi, alone), how many n-grams each class holds alone, as arrays."""

    def run(table: pa.Table) -> pa.Table:
        grams, who = [], []
        for batch in table.to_batches():
            for k in range(batch.num_rows):
                sets = batch.column("sets")[k].values.to_numpy()
                grams.append(batch.column("grams")[k].values.to_numpy().view(np.uint64))
                who.append(sets[batch.column("who")[k].values.to_numpy()])
        grams, who = np.concatenate(grams), np.concatenate(who)
        order = np.argsort(grams, kind="stable")
        grams, who = grams[order], who[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        least, most = np.minimum.reduceat(who, first), np.maximum.reduceat(who, first)
        hi, alone = np.unique(least[least == most], return_counts=True)
        bucket = (hi % buckets).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        full, at = np.unique(bucket[order], return_index=True)
        off = np.append(at, len(order))
        return pa.table({"bucket": full, "hi": lists(hi[order], off), "alone": lists(alone[order].astype(np.int64), off)})

    return run


def _alone_by_class(table: pa.Table) -> pa.Table:
    hi, alone = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("hi", "alone"))
    found, place = np.unique(hi, return_inverse=True)
    return pa.table({"hi": found, "alone": np.bincount(place, weights=alone, minlength=len(found)).astype(np.int64)})


def _segments(n: int):
    """Rows (cid, n, frags) of the classes' sets, cut at the fragments' bounds, from (text, hi, lo)."""
    cuts = np.array([f << 61 for f in range(1, FRAGMENTS)], np.uint64)

    def run(batches):
        for batch in batches:
            hi, lo = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            kept = [(row, g) for row, g in ngram_sets(batch.column(0), n) if set_key(g) == (hi[row], lo[row])]
            if not kept:
                continue
            inner = np.concatenate([[0], *[np.append(np.searchsorted(g, cuts), len(g)) + base for (_, g), base in zip(kept, np.cumsum([0] + [len(g) for _, g in kept[:-1]]))]])
            frags = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * FRAGMENTS), lists(np.concatenate([g for _, g in kept]), inner))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array([r for r, _ in kept])), pa.array([len(g) for _, g in kept], pa.int64()), frags], ["cid", "n", "frags"]
            )

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets by row) of a list<list<long>> column."""
    outer = np.array(column.offsets)
    inner = np.array(column.values.offsets)
    return column.values.values.to_numpy(zero_copy_only=False).view(np.uint64), inner[outer]


def _prefixes(heavy, percent: int):
    """Rows (gram, cid, n, left): each class's first n-grams by frequency and hash, and how many are left from there on."""

    def run(batches):
        often, counts = heavy.value
        for batch in batches:
            values, off = _flat(batch.column("frags"))
            rank = np.zeros(len(values), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, values), len(often) - 1)
                rank = np.where(often[at] == values, counts[at], 0)
            out = [[], [], [], []]
            for cid, n, a, b in zip(batch.column("cid").to_pylist(), batch.column("n").to_pylist(), off[:-1], off[1:]):
                own = values[a:b]
                first = own[np.lexsort((own, rank[a:b]))[: n * (100 - percent) // 100 + 1]].view(np.int64)
                for x, y in zip(out, (first, np.full(len(first), cid), np.full(len(first), n), n - np.arange(len(first)))):
                    x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["gram", "cid", "n", "left"])

    return run


def _open_rows(parts: int):
    """Rows (part, grams, comps, cids) of the classes still in play, cut by range of n-grams.

    An n-gram that several components of the split hold, or one component holds in many
    classes, is told by its components alone (cid 0); so frequent n-grams stay cheap.
    """
    cuts = np.array([(1 << 64) * p // parts for p in range(1, parts)], np.uint64)

    def run(batches):
        for batch in batches:
            grams, off = _flat(batch.column("frags"))
            cids, comps = (np.repeat(batch.column(c).to_numpy(), np.diff(off)) for c in ("cid", "comp"))
            grams = grams[off[0]:off[-1]]
            order = np.lexsort((comps, grams))
            grams, cids, comps = grams[order], cids[order].copy(), comps[order]
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            last = np.append(first[1:], len(grams)) - 1
            told = (comps[first] != comps[last]) | (last - first >= FEW_HOLDERS)
            keep = np.repeat(~told, last - first + 1)
            for ends in (first[told], last[told]):
                keep[ends], cids[ends] = True, 0
            grams, cids, comps = grams[keep], cids[keep], comps[keep]
            bounds = np.concatenate([[0], np.searchsorted(grams, cuts), [len(grams)]])
            full = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
            if full:
                ends = np.array([0, *(bounds[p + 1] for p in full)])
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(lists(x, ends) for x in (grams, comps, cids))], ["part", "grams", "comps", "cids"])

    return run


def _closed(table: pa.Table) -> pa.Table:
    """Of one part: (cid, closed), how many n-grams of a class its own component holds alone."""
    grams, comps, cids = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("grams", "comps", "cids"))
    order = np.argsort(grams, kind="stable")
    grams, comps, cids = grams[order], comps[order], cids[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    alone = np.minimum.reduceat(comps, first) == np.maximum.reduceat(comps, first)
    alone = np.repeat(alone, np.diff(np.append(first, len(grams))))
    cid, closed = np.unique(cids[alone & (cids != 0)], return_counts=True)
    return pa.table({"cid": cid, "closed": closed.astype(np.int64)})


def _verified(pairs: DataFrame, segments: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Of the pairs (a, b, ...), those that reach the similarity: partial overlaps by fragment, summed per pair."""
    hot = scratch.save(hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), pairs.count()), "hot")
    each = with_salt(pairs.select("a", "b"), hot, F.col("b")).withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    stars = scratch.save(pairs.select(F.col("a").alias("cid")).distinct(), "stars")
    cut = lambda sets: sets.select(F.posexplode("frags").alias("fragment", "grams"), "cid", "n")
    left = cut(segments.join(side(stars), "cid", "left_semi"))
    left = for_each_salt(left.select("fragment", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga")), hot)
    right = cut(segments).select("fragment", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    partial = each.join(left, ["fragment", "a", "salt"]).join(right, ["fragment", "b"])
    partial = partial.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("o"))
    counted = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return counted.where(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * percent).select("a", "b")


def _star_pairs(live: DataFrame, number: int, stars: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b, ca, cb) of stars a and others b to compare, live with who is a star).

    live: (gram, cid, n, left, comp). slack is the greatest size of a set that the position lets link.
    """
    slack = F.floor(F.col("left") * (100 + percent) / percent) - F.col("n")
    live = live.withColumn("slack", slack).withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(number), "cid"), 11) / float(1 << 53))
    grams = live.groupBy("gram").agg(
        F.count("*").alias("holders"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("n").alias("least"), F.max("slack").alias("most"), F.min("u").alias("first")
    )
    grams = scratch.save(grams.where("x < y").drop("x", "y"), "grams")
    hot = scratch.save(hot_keys(grams.select("gram", F.col("holders").alias("n")), live.count()), "hot")
    known = with_salt(live, hot, F.col("cid")).join(for_each_salt(grams, hot), ["gram", "salt"]).where("slack >= least AND n <= most")
    known = known.withColumn("star", (F.col("u") == F.col("first")) | (F.col("u") * F.col("holders") < stars))
    known = scratch.save(known.select("gram", "cid", "n", "left", "comp", "star"), "known")

    star = known.where("star").select("gram", *[F.col(c).alias("s_" + c) for c in ("cid", "n", "left", "comp")])
    both = with_salt(known, hot, F.col("cid")).join(for_each_salt(star, hot), ["gram", "salt"])
    both = both.where((F.col("comp") != F.col("s_comp")) & ~(F.col("star") & (F.col("cid") > F.col("s_cid"))))
    both = both.where(F.least("left", "s_left") * (100 + percent) >= (F.col("n") + F.col("s_n")) * percent)
    pairs = both.select(F.col("s_cid").alias("a"), F.col("cid").alias("b"), F.col("s_comp").alias("ca"), F.col("comp").alias("cb")).distinct()
    return scratch.save(pairs, "pairs"), known


def _contracted(rows: DataFrame, moved: DataFrame, col: str = "comp") -> DataFrame:
    """rows whose component col is replaced by the one that it moved to."""
    to = moved.select(F.col("id").alias(col), F.col("component").alias("_to"))
    return rows.join(to, col, "left").withColumn(col, F.coalesce("_to", col)).drop("_to")


def _of_live(segments: DataFrame, live: DataFrame, scratch: Scratch) -> DataFrame:
    """(cid, n, comp, frags) of the classes in live."""
    own = scratch.save(live.select("cid", "comp").distinct(), "own")
    return scratch.save(segments.select("cid", "n", "frags").join(side(own), "cid").select("cid", "n", "comp", "frags"), "segments")


def _still_open(live: DataFrame, doubtful: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """live without the classes of which too many n-grams are held by their own component alone."""
    parts = max(1, -(-(doubtful.agg(F.sum("n")).first()[0] or 0) // PART_NGRAMS))
    closed = doubtful.select("cid", "comp", "frags").mapInArrow(_open_rows(parts), "part int, grams array<long>, comps array<long>, cids array<long>")
    closed = closed.groupBy("part").applyInArrow(_closed, "cid long, closed long").groupBy("cid").agg(F.sum("closed").alias("closed"))
    too_many = F.coalesce("closed", F.lit(0)) > F.floor(F.col("n") * (100 - percent) / 100)
    open_classes = scratch.save(doubtful.select("cid", "n").join(closed, "cid", "left").where(~too_many).select("cid"), "open")
    return scratch.save(live.join(side(open_classes), "cid", "left_semi"), "live")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id) under links of Jaccard >= percent / 100."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = scratch.save(source.mapInArrow(_sets(n), "id long, n long, hi long, lo long"), "sets")
    classes = sets.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("sid"), F.first("n").alias("n"), F.count("*").alias("rows"))
    classes = scratch.save(classes, "classes")

    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total * SCREENED // (FRAGMENTS * PART_NGRAMS)))
    screened = source.select("text").mapInArrow(_screen_rows(n, parts), "part int, grams array<long>, who array<int>, sets array<long>")
    buckets = max(1, classes.count() // PART_CLASSES)
    alone = screened.groupBy("part").applyInArrow(_alone(buckets), "bucket int, hi array<long>, alone array<long>")
    alone = alone.groupBy("bucket").applyInArrow(_alone_by_class, "hi long, alone long")
    in_play = (
        classes.where("sid IS NOT NULL").join(alone, "hi", "left")
        .where(F.coalesce("alone", F.lit(0)) <= F.floor(F.col("n") * (100 - percent) / 100))
        .select("sid", "hi", "lo")
    )
    in_play = scratch.save(in_play, "in_play")
    chosen = source.join(side(in_play), source.id == in_play.sid).select("text", "hi", "lo")
    segments = chosen.mapInArrow(_segments(n), "cid long, n long, frags array<array<long>>")
    if not sets.groupBy("id").count().where("count > 1").isEmpty():
        segments = segments.dropDuplicates(["cid"])
    segments = scratch.save(segments, "segments")

    grams = segments.select(F.explode(F.flatten("frags")).alias("gram"))
    held = segments.agg(F.sum("n")).first()[0] or 0
    least = max(FEW_HOLDERS, held // HEAVY_ROWS)
    often = grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > least).collect()
    often = sorted((r.gram & (2**64 - 1), r.n) for r in often)
    heavy = spark.sparkContext.broadcast((np.array([g for g, _ in often], np.uint64), np.array([c for _, c in often], np.int64)))
    prefixes = segments.mapInArrow(_prefixes(heavy, percent), "gram long, cid long, n long, left long")
    live = scratch.save(prefixes.withColumn("comp", F.col("cid")), "live")

    linked = None  # (id, component) of all classes in components of several
    number, stars = 0, STARS[0]
    while not live.isEmpty():
        pairs, known = _star_pairs(live, number, stars, percent, scratch)
        links = _verified(pairs, segments, percent, scratch)
        edges = pairs.join(links, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        moved = scratch.save(components(edges, scratch), "moved")
        before, live = live, scratch.save(_contracted(known.where("NOT star").drop("star"), moved), "live")
        scratch.drop(before, known, pairs)
        if linked is None:
            linked = moved
        else:
            later = _contracted(linked, moved, "component")
            linked = scratch.save(later.unionByName(moved.join(linked, "id", "left_anti")), "linked")
        number, stars = number + 1, STARS[1] if number == 0 else stars * STARS_GROW
        if not live.isEmpty():
            before, segments = segments, _of_live(segments, live, scratch)
            scratch.drop(before)
            live = _still_open(live, segments, percent, scratch) if number == 1 else live

    named = classes.select("hi", "lo", "sid", "rows")
    if linked is not None:
        placed = scratch.save(classes.select(F.col("hi").alias("id"), "sid").join(linked, "id"), "placed")
        least_ids = placed.groupBy("component").agg(F.min("sid").alias("least"), F.count("*").alias("n"))
        least_ids = scratch.save(least_ids, "least")
        hot = scratch.save(hot_keys(least_ids.select("component", "n"), placed.count()), "hot")
        found = with_salt(placed, hot, F.col("id")).join(for_each_salt(least_ids.select("component", "least"), hot), ["component", "salt"])
        named = named.join(found.select(F.col("id").alias("hi"), "least"), "hi", "left").withColumn("sid", F.coalesce("least", "sid")).drop("least")
    named = scratch.save(named.withColumnRenamed("sid", "component"), "named")
    scratch.drop(classes, in_play, segments)
    hot = scratch.save(hot_keys(named.select("hi", "lo", F.col("rows").alias("n")), sets.count()), "hot")
    out = with_salt(sets.where("n > 0"), hot, F.col("id")).join(for_each_salt(named.drop("rows"), hot), ["hi", "lo", "salt"])
    out = out.select("id", "n", "component").unionByName(sets.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * p.i >= 75 * (x.n + y.n - p.i)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT links.b, r.c FROM r JOIN links ON r.id = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT id, min(c) AS component_id FROM r GROUP BY id) m ON d.doc_id = m.id
"""
