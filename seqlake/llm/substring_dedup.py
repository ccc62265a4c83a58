"""Substring dedup: suffix automata of reference shards, and matching statistics against them.

A window is ``window`` consecutive words of one document, words unchanged. A word goes when a
window covers it whose word sequence also starts in a document with a smaller id. Windows
are judged on the input, not on what is left.

1. anchors: each window names one word k-gram, k = window / 2, by the least hash in it
   (winnowing). Equal windows name equal anchors, so a window can only repeat where its anchor
   shows in two documents; all other text leaves here.
2. segments: runs of windows whose anchors belong to one shard (a hash range of anchors), at
   most ``CUT`` windows each. Equal segments are merged to one row with the smallest document
   id; only that row carries words.
3. hot shards: one passage that very many documents share, each with other words around it, fills
   one shard. Windows of a shard over ``BLOCK_WORDS`` words are dealt again, by the hash of the
   whole window, to as many parts as its size asks for, and equal pieces are merged as segments
   are. Equal windows stay together, and the work grows in proportion to the shard's words.
4. automata: a task builds the suffix automaton of one shard (or part) once, of all documents
   in it, and streams the same documents through it: it follows the longest match (the matching
   statistics), and where that reaches the window's length the state tells the smallest document
   that holds the window.
5. spans: windows found go to all documents that hold the segment, maximal spans are merged per
   document, and the words outside them are kept.

The automata are not sent to all tasks: their size grows with the repeated text, so a broadcast
of them has no bound, and every shard's automaton would be tried on every document. Instead
documents come to the automaton of the shard that their anchors name.

Words are compared by 64-bit hashes. Defined results: a null text has no words; repeated words
inside one document alone are never removed; rows that share an id count as one document, but
each is cut by its own spans (the hash of the text tells them apart); a row with a null id
is left alone and removes nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.scratch import Scratch
from seqlake.llm.skew import for_each_salt, hot_keys, with_salt
from seqlake.llm.text import Words, lists, mix, words

BLOCK_WORDS = 200_000
CUT = 10_000
_STEP = np.uint64(0xD6E8FEB86659FD93)
NONE = np.iinfo(np.int64).max


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row."""
    grams = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        grams = (grams ^ (grams >> np.uint64(32))) * _STEP + h[j:j + len(grams)]
    return mix(grams)


def window_anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, anchor of the window that starts at each word); the last words' are void."""
    h = w.hashes()
    k = window // 2
    least, wide, need = rolled(h, k), 1, window - k + 1
    while wide * 2 <= need:
        least = np.minimum(least[:-wide], least[wide:]) if len(least) > wide else least[:0]
        wide *= 2
    if wide < need:
        least = np.minimum(least[: wide - need], least[need - wide:]) if len(least) > need - wide else least[:0]
    return h, least


def _anchors(window: int):
    """Rows (id, row, anchors) of the documents with at least one window."""

    def run(batches):
        for batch in batches:
            rows, found = [], []
            for w in words(batch.column(2)):
                _, anchor = window_anchors(w, window)
                for row, a, b in zip(w.rows.tolist(), w.first[:-1].tolist(), w.first[1:].tolist()):
                    if b - a >= window:
                        rows.append(row)
                        found.append(np.unique(anchor[a:b - window + 1]))
            if rows:
                off = np.array([0, *np.cumsum([len(x) for x in found])])
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), lists(np.concatenate(found), off)], ["id", "row", "anchors"])

    return run


def _key(seq: np.ndarray) -> bytes:
    return hashlib.blake2b(seq.tobytes(), digest_size=16).digest()


def _pack(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows (content key, word hashes or None, whole numbers...) as a batch: hi, lo, words and the named numbers."""
    key, seq, *numbers = zip(*found)
    keys = np.frombuffer(b"".join(key), np.int64).reshape(-1, 2)
    held = pa.array([None if x is None else x.view(np.int64) for x in seq], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), held, *(pa.array(x, pa.int64()) for x in numbers)], ["hi", "lo", "words", *names])


SEGMENT = "hi long, lo long, words array<long>, shard long, id long, row long, start long, windows long"


def _segments(window: int, shards: int):
    """Rows of SEGMENT from (id, row, text, anchors); words only once per batch and content."""

    def run(batches):
        for batch in batches:
            ids, rows, shared = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            values, offsets = shared.values.to_numpy().view(np.uint64), np.array(shared.offsets)
            out, seen = [], set()
            for w in words(batch.column(2)):
                h, anchor = window_anchors(w, window)
                for row, a, b in zip(w.rows.tolist(), w.first[:-1].tolist(), w.first[1:].tolist()):
                    if b - a < window:
                        continue
                    own, mine = anchor[a:b - window + 1], np.sort(values[offsets[row]:offsets[row + 1]])
                    at = np.minimum(np.searchsorted(mine, own), len(mine) - 1)
                    shard = np.where(mine[at] == own, (own % np.uint64(shards)).astype(np.int64), -1)
                    cuts = np.flatnonzero(np.diff(shard)) + 1
                    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
                        if shard[s] < 0:
                            continue
                        for c in range(s, e, CUT):
                            d = min(e, c + CUT)
                            seq = h[a + c:a + d + window - 1]
                            key = _key(seq)
                            out.append((key, None if key in seen else seq, int(shard[s]), ids[row], rows[row], c, d - c))
                            seen.add(key)
            if out:
                yield _pack(out, ["shard", "id", "row", "start", "windows"])

    return run


PIECE = "hi long, lo long, words array<long>, shard long, part long, first_id long, whole_hi long, whole_lo long, start long, windows long"


def _pieces(window: int):
    """Rows of PIECE: the segments (hi, lo, first_id, words, shard, parts) of hot shards, cut by the part of each window."""

    def run(batches):
        for batch in batches:
            hi, lo, first, _, shard, parts = (c.to_pylist() if k != 3 else None for k, c in enumerate(batch.columns))
            values, off = batch.column(3).values.to_numpy().view(np.uint64), np.array(batch.column(3).offsets)
            out, seen = [], set()
            for k in range(batch.num_rows):
                h = values[off[k]:off[k + 1]]
                part = (rolled(h, window) % np.uint64(parts[k])).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part)) + 1
                for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
                    seq = h[s:e + window - 1]
                    key = _key(seq)
                    out.append((key, None if (shard[k], key) in seen else seq, shard[k], int(part[s]), first[k], hi[k], lo[k], s, e - s))
                    seen.add((shard[k], key))
            if out:
                yield _pack(out, ["shard", "part", "first_id", "whole_hi", "whole_lo", "start", "windows"])

    return run


class SuffixAutomaton:
    """Of several sequences, each with an owner; a state knows the smallest owner of its strings."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [NONE]

    def _state(self, following: dict, length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.owner.append(NONE)
        return len(self.link) - 1

    def _split(self, before: int, symbol: int, state: int) -> int:
        """A state for the strings of state that are no longer than one more than before's."""
        part = self._state(dict(self.next[state]), self.length[before] + 1, self.link[state])
        self.link[state] = part
        while before >= 0 and self.next[before].get(symbol) == state:
            self.next[before][symbol] = part
            before = self.link[before]
        return part

    def add(self, sequence: list[int], owner: int) -> None:
        nexts, link, length, owners = self.next, self.link, self.length, self.owner
        at = 0
        for symbol in sequence:
            known = nexts[at].get(symbol)
            if known is None:
                new, back = self._state({}, length[at] + 1, 0), at
                while back >= 0 and symbol not in nexts[back]:
                    nexts[back][symbol] = new
                    back = link[back]
                if back >= 0:
                    known = nexts[back][symbol]
                    link[new] = known if length[known] == length[back] + 1 else self._split(back, symbol, known)
                at = new
            else:
                at = known if length[known] == length[at] + 1 else self._split(at, symbol, known)
            if owner < owners[at]:
                owners[at] = owner

    def close(self) -> None:
        """Hand owners from longer strings to their suffixes."""
        for state in np.argsort(np.array(self.length))[:0:-1].tolist():
            if self.owner[state] < self.owner[self.link[state]]:
                self.owner[self.link[state]] = self.owner[state]

    def owners(self, sequence: list[int], window: int) -> list[int]:
        """For each window of the sequence, the smallest owner of a sequence that holds it."""
        nexts, link, length, owners = self.next, self.link, self.length, self.owner
        at, matched, out = 0, 0, []
        for k, symbol in enumerate(sequence):
            while at and symbol not in nexts[at]:
                at = link[at]
                matched = length[at]
            following = nexts[at].get(symbol)
            if following is not None:
                at, matched = following, matched + 1
                while at and length[link[at]] >= window:
                    at = link[at]
                    matched = length[at]
            if k >= window - 1:
                out.append(owners[at] if matched >= window else NONE)
        return out


def _matched(window: int):
    """Rows (shard, part, hi, lo, runs): runs (start, windows) of a sequence that smaller documents hold."""

    def run(table: pa.Table) -> pa.Table:
        column = table.column("words").combine_chunks()
        _, symbols = np.unique(column.values.to_numpy(), return_inverse=True)
        symbols, off = symbols.tolist(), column.offsets.to_pylist()
        base = off[0]
        ids = table.column("first_id").to_pylist()
        automaton = SuffixAutomaton()
        for k in range(len(ids)):
            automaton.add(symbols[off[k] - base:off[k + 1] - base], ids[k])
        automaton.close()
        rows, runs = [], []
        for k in range(len(ids)):
            found = automaton.owners(symbols[off[k] - base:off[k + 1] - base], window)
            hit = np.flatnonzero(np.array(found) < ids[k])
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > 1)
                begin, end = hit[np.append(0, cut + 1)], hit[np.append(cut, len(hit) - 1)]
                rows.append(k)
                runs.append([{"start": a, "windows": b - a + 1} for a, b in zip(begin.tolist(), end.tolist())])
        picked = table.select(["shard", "part", "hi", "lo"]).take(pa.array(rows, pa.int64()))
        return picked.append_column("runs", pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("windows", pa.int64())]))))

    return run


def _kept(window: int):
    """Rows (id, n_words, n_removed, kept_sha256, kept) from (id, text, spans), a piece of the batch at a time."""

    def run(batches):
        for batch in batches:
            spans = batch.column(2)
            flat, span_off = spans.values, np.array(spans.offsets)
            begin, count = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            for w in words(batch.column(1)):
                keep = np.ones(len(w.starts) + 1, bool)
                n_words = np.diff(w.first)
                n_removed = np.zeros(len(n_words), np.int64)
                for at, (row, a, b) in enumerate(zip(w.rows.tolist(), w.first[:-1].tolist(), w.first[1:].tolist())):
                    for s in range(span_off[row], span_off[row + 1]):
                        keep[a + begin[s]:min(b, a + begin[s] + count[s] + window - 1)] = False
                    n_removed[at] = b - a - np.count_nonzero(keep[a:b])
                keep = keep[:-1]
                edge = np.zeros(len(w.data) + 2, np.int8)
                edge[w.starts[keep]] += 1
                edge[w.ends[keep]] -= 1
                byte = np.cumsum(edge[:-1]).astype(bool)
                data = np.append(w.data, np.uint8(0x20))
                last = np.repeat(w.bounds[1:], n_words)
                gap = w.ends[keep & (w.ends < last)]
                byte[gap], data[gap] = True, 0x20
                sizes = np.concatenate([[0], np.cumsum(byte)])[w.bounds]
                joined = data[byte].tobytes()
                kept = [joined[a:b].rstrip(b" ") for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist())]
                sha = [hashlib.sha256(x).hexdigest() for x in kept]
                ids = batch.column(0).slice(int(w.rows[0]), len(w.rows))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n_words, pa.int64()), pa.array(n_removed), pa.array(sha), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return run


RUNS = "array<struct<start:long,windows:long>>"
_KEY = ["shard", "hi", "lo"]


def _moved(runs: str, by: str):
    """The runs of a sequence that starts at word ``by`` of a longer one, counted from the longer one's start."""
    return F.transform(runs, lambda r: F.struct((r["start"] + F.col(by)).alias("start"), r["windows"].alias("windows")))


def _spans_of(placed: DataFrame, runs: DataFrame, owner: str, keys: list[str], out: list[str]) -> DataFrame:
    """(out..., spans) of placed rows (keys, owner, first, start, windows, out).

    A row whose owner is not the first holder of the sequence loses all its windows, the first
    holder itself those in runs (keys, runs).
    """
    copies = placed.where(F.col(owner) > F.col("first")).select(*out, F.array(F.struct("start", "windows")).alias("spans"))
    firsts = placed.where(F.col(owner) == F.col("first")).join(runs, keys).select(*out, _moved("runs", "start").alias("spans"))
    return copies.unionByName(firsts)


def segment_runs(distinct: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(shard, hi, lo, runs) of distinct segments (shard, hi, lo, first_id, words): what smaller documents hold."""
    blow_up = max(1, window // 3)  # words of a window's pieces against those of its segment, at most
    size = distinct.groupBy("shard").agg(F.sum(F.size("words")).alias("words")).where(F.col("words") > BLOCK_WORDS)
    parts = scratch.save(size.select("shard", F.ceil(F.col("words") * blow_up / BLOCK_WORDS).alias("parts")), "parts")
    salt = F.pmod("hi", F.lit(64))
    each = parts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    dealt = distinct.withColumn("salt", salt).join(each, ["shard", "salt"], "left").drop("salt")
    dealt = scratch.save(dealt, "dealt")

    whole = dealt.where("parts IS NULL").select("shard", F.lit(0).cast("long").alias("part"), "hi", "lo", "first_id", "words")
    pieces = scratch.save(dealt.where("parts IS NOT NULL").select("hi", "lo", "first_id", "words", "shard", "parts").mapInArrow(_pieces(window), PIECE), "pieces")
    key = ["shard", "part", "hi", "lo"]
    merged = pieces.groupBy(*key).agg(F.min("first_id").alias("first_id"), F.first("words", True).alias("words"), F.count("*").alias("n"))
    merged = scratch.save(merged, "merged")
    tasks = whole.unionByName(merged.drop("n"))
    runs = tasks.groupBy("shard", "part").applyInArrow(_matched(window), f"shard long, part long, hi long, lo long, runs {RUNS}")
    runs = scratch.save(runs, "runs")

    hot = scratch.save(hot_keys(merged.select(*key, "n"), pieces.count()), "hot")
    firsts = for_each_salt(merged.select(*key, F.col("first_id").alias("first")), hot)
    placed = with_salt(pieces.drop("words"), hot, F.struct("whole_hi", "whole_lo", "start")).join(firsts, [*key, "salt"])
    found = _spans_of(placed, runs, "first_id", key, ["shard", "whole_hi", "whole_lo"])
    found = found.groupBy("shard", F.col("whole_hi").alias("hi"), F.col("whole_lo").alias("lo")).agg(F.flatten(F.collect_list("spans")).alias("runs"))
    cold = runs.join(parts, "shard", "left_anti").select(*_KEY, "runs")
    out = scratch.save(found.unionByName(cold), "found")
    scratch.drop(dealt, pieces, merged, runs)
    return out


def repeated_spans(source: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(id, row, spans: array of (start, windows)) of (id, row, text): runs of windows that a smaller document holds."""
    source = source.where("id IS NOT NULL")
    anchors = scratch.save(source.select("id", "row", "text").mapInArrow(_anchors(window), "id long, row long, anchors array<long>"), "anchors")
    each = anchors.select("id", "row", F.explode("anchors").alias("anchor"))
    counts = each.groupBy("anchor").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count("*").alias("n")).where("x < y")
    counts = scratch.save(counts.select("anchor", "n"), "shared")
    hot = scratch.save(hot_keys(counts, anchors.agg(F.sum(F.size("anchors"))).first()[0] or 0), "hot")
    held = with_salt(each, hot, F.col("id")).join(for_each_salt(counts.select("anchor"), hot), ["anchor", "salt"], "left_semi")
    held = scratch.save(held.groupBy("id", "row").agg(F.collect_set("anchor").alias("anchors")), "held")
    scratch.drop(anchors, counts)
    total = held.agg(F.sum(F.size("anchors"))).first()[0] or 0
    shards = max(1, 4 * total * window // BLOCK_WORDS)
    found = source.join(held, ["id", "row"]).select("id", "row", "text", "anchors").mapInArrow(_segments(window, shards), SEGMENT)
    found = scratch.save(found, "segments")
    distinct = found.groupBy(*_KEY).agg(F.min("id").alias("first_id"), F.first("words", True).alias("words"), F.count("*").alias("n"))
    distinct = scratch.save(distinct, "distinct")
    places = scratch.save(found.select(*_KEY, "id", "row", "start", "windows"), "places")
    scratch.drop(held, found)

    runs = segment_runs(distinct.drop("n"), window, scratch)
    hot = scratch.save(hot_keys(distinct.select(*_KEY, "n"), places.count()), "hot")
    firsts = for_each_salt(distinct.select(*_KEY, F.col("first_id").alias("first")), hot)
    placed = with_salt(places, hot, F.col("id")).join(firsts, [*_KEY, "salt"])
    spans = _spans_of(placed, runs, "id", _KEY, ["id", "row"])
    spans = scratch.save(spans.groupBy("id", "row").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    scratch.drop(distinct, places, runs)
    return spans


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_words, n_removed, kept_sha256, kept), kept being the text left."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    spans = repeated_spans(source, window, Scratch(docs.sparkSession, "substrings"))
    joined = source.join(spans, ["id", "row"], "left").select("id", "text", F.coalesce("spans", F.array().cast(RUNS)).alias("spans"))
    out = joined.mapInArrow(_kept(window), "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.withColumnRenamed("id", id_col)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).drop("kept")


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM i),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM g JOIN f ON g.g = f.g WHERE first < doc_id),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM w),
o AS (SELECT k.doc_id, count(*) AS n, count(c.k) AS gone, string_agg(k.word, ' ' ORDER BY k.k) FILTER (c.k IS NULL) AS kept FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.k = c.k GROUP BY k.doc_id)
SELECT d.doc_id, coalesce(o.n, 0) AS n_words, coalesce(o.gone, 0) AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256 FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""
