"""Cross-tokenizer alignment by whitespace-token anchors.

Every text, with a space before it, is encoded by two tokenizers: A, a byte-level BPE file, and B, a
SentencePiece model, which adds the space itself. Byte offsets at which tokens of both end cut the
tokens into groups, and all pairs of an A and a B token of one group are linked.

1. full tokenisation. Neither tokenizer joins a byte that isn't white space with a following
   space, so a text is cut there and each distinct cut is encoded once per task (``Encoders``);
   where B's pieces could reach over such a place, texts are encoded whole.
2. anchors: ends of A tokens before a token marked by a space, checked against the ends of B
   tokens before such a token, split all tokens of a batch into windows.
3. windows of equal ids are aligned once: the groups of a window are memoised by its ids.
4. counts: a chunk of documents (``chunks``) names each of its id pairs once, with the number of
   its documents that hold it. These are summed per pair over the corpus; an A id's highest is a
   window over its pairs, as many as B has ids at most. Counts come back to the chunk as rows, and
   meet its documents, which Spark moves as packed bytes, in a task that holds one chunk at a time.

Defined results: null and empty texts, and texts that either tokenizer doesn't restore byte by byte
(such as those with a literal U+2581), have no tokens; strings of special tokens are plain text;
texts of any length are aligned whole; rows that share an id, or have none, are documents of their
own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import ctypes
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.llm.chunks import chunk_ids
from seqlake.llm.scratch import Scratch
from seqlake.llm.text import mix

BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

# Fixed value: how a byte-level tokenizer cuts a text before it merges.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SPACE = "▁"
BEFORE_SPACE = re.compile(r"(?<=\S)(?= \s*\S)")
MOST_CUTS = 50_000  # distinct cuts and windows that a task remembers
LONG_CUT = 4096  # characters of a cut that makes a task forget its cuts after the batch
BATCH_BYTES = 2 << 20
CHUNK_TOKENS = 600_000
SLICE_LINKS = 100_000  # links that are listed at once

ALIGNED = "id long, groups array<struct<a:array<int>,b:array<int>>>"
CHUNK = "chunk long, pairs array<long>, held array<long>, docs binary"
LINKED = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable, else the next from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pool:
    """Rows of numbers of any length, told by their places."""

    def __init__(self, columns: int = 1):
        self.values = [np.zeros(0, np.int32)] * columns
        self.ends = np.zeros(0, np.int64)

    def add(self, sizes: np.ndarray, *values: np.ndarray) -> None:
        last = self.ends[-1] if len(self.ends) else 0
        self.ends = np.concatenate([self.ends, last + np.cumsum(sizes)])
        self.values = [np.concatenate([x, y.astype(np.int32)]) for x, y in zip(self.values, values)]

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """(sizes of these rows, then the values of all of them in order, by column)."""
        start = np.append(0, self.ends)[rows]
        sizes = self.ends[rows] - start
        place = ranges(start, sizes)
        return sizes, *[x[place] for x in self.values]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start .. start + size, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in rows], np.int64)
    return sizes, np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))


class Encoders:
    """Both tokenizers of a task, and what it remembers of cuts and windows."""

    def __init__(self, bpe: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(bpe, encoding="utf-8") as f:
            spec = json.load(f)
        values = byte_values()
        vocab, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(values[c] for c in t): i for t, i in vocab.items() if t not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{bpe}: ids must follow the order of merges")
        self.a = tiktoken.Encoding("own", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[1:-1], 16)]) if self.b.is_byte(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(names)]
        self.whole = any(re.search(f"[^{SPACE}]{SPACE}", t) for t in names)
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_space, self.b_space = (np.array([t.startswith(b" ") for t in x]) for x in (self.a_bytes, self.b_bytes))
        self.forget_cuts()
        self.forget_windows()

    def forget_cuts(self) -> None:
        self.cuts: dict[str, int] = {}
        self.a_ids, self.b_ids, self.restored = Pool(), Pool(), np.zeros(0, bool)

    def forget_windows(self) -> None:
        self.windows: dict[tuple[int, bytes, bytes], int] = {}
        self.sizes = Pool(2)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """[numbers of A tokens, of B tokens of each text, all A ids, all B ids]; a text that isn't restored has none."""
        if len(self.cuts) > MOST_CUTS:
            self.forget_cuts()
        # A cut may only stand before a space that follows a byte which isn't white.
        cut = [([" " + t] if self.whole else BEFORE_SPACE.split(" " + t)) if t else [] for t in texts]
        known = self.cuts
        found = list(map(known.get, chain.from_iterable(cut)))
        new = list(dict.fromkeys(c for c, at in zip(chain.from_iterable(cut), found) if at is None))
        new.sort(key=lambda c: c[-1].isspace())
        known.update(zip(new, range(len(known), len(known) + len(new))))
        place = np.array([known[c] if at is None else at for c, at in zip(chain.from_iterable(cut), found)] if new else found, np.int64)
        if new:
            data = [c.encode() for c in new]
            a, b = self._a(new, data), flat(self.b.encode([c[1:] for c in new], num_threads=1))
            self.a_ids.add(*a)
            self.b_ids.add(*b)
            self.restored = np.append(self.restored, self._same(*a, self.a_size, self.a_bytes, data) & self._same(*b, self.b_size, self.b_bytes, data))
        per_text = np.array([len(c) for c in cut], np.int64)
        text = np.repeat(np.arange(len(texts)), per_text)
        (na, a), (nb, b) = self.a_ids.take(place), self.b_ids.take(place)
        n_a, n_b = (np.bincount(text, n, len(texts)).astype(np.int64) for n in (na, nb))
        lost = np.unique(text[~self.restored[place]])
        if len(lost):
            ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
            gone = [k for k in lost if not (self._text(a[ends_a[k] - n_a[k]:ends_a[k]], self.a_bytes) == self._text(b[ends_b[k] - n_b[k]:ends_b[k]], self.b_bytes) == (" " + texts[k]).encode())]
            kept = ~np.isin(np.arange(len(texts)), gone)
            a, b, n_a, n_b = a[np.repeat(kept, n_a)], b[np.repeat(kept, n_b)], n_a * kept, n_b * kept
        if max(map(len, new), default=0) > LONG_CUT:
            self.forget_cuts()
        elif len(known) > MOST_CUTS:
            self._keep_cuts(np.bincount(place, minlength=len(known)))
        return [n_a, n_b, a, b]

    def _keep_cuts(self, seen: np.ndarray) -> None:
        """Remember only cuts that the last batch held twice or more, the most frequent ones, half of MOST_CUTS at most."""
        kept = np.argsort(-seen, kind="stable")[:MOST_CUTS // 2]
        kept = kept[seen[kept] > 1]
        names, old, restored = list(self.cuts), (self.a_ids, self.b_ids), self.restored
        self.forget_cuts()
        self.cuts.update(zip([names[k] for k in kept.tolist()], range(len(kept))))
        for pool, before in zip((self.a_ids, self.b_ids), old):
            pool.add(*before.take(kept))
        self.restored = restored[kept]

    def _a(self, cuts: list[str], data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of A tokens, A ids) of cuts, of which those that end in white space come last.

        A cut begins with a space, and A joins none with a byte before it that isn't white, so the others
        are encoded as one text, whose tokens end where cuts do.
        """
        n = next((k for k, c in enumerate(cuts) if c[-1].isspace()), len(cuts))
        ids = np.array(self.a.encode_ordinary("".join(cuts[:n])), np.int32)
        ends, want = np.cumsum(self.a_size[ids]), np.cumsum([len(x) for x in data[:n]])
        last = np.searchsorted(ends, want)
        if n and (len(last) == 0 or last[-1] != len(ids) - 1 or (ends[last] != want).any()):
            return flat([self.a.encode_ordinary(c) for c in cuts])
        sizes, rest = flat([self.a.encode_ordinary(c) for c in cuts[n:]])
        return np.concatenate([np.diff(last, prepend=-1), sizes]), np.concatenate([ids, rest])

    def _same(self, sizes: np.ndarray, ids: np.ndarray, size: np.ndarray, known: list[bytes], data: list[bytes]) -> np.ndarray:
        """Whether the bytes of each cut's tokens are the cut's."""
        n = len(data)
        length = np.array([len(x) for x in data], np.int64)
        got = np.bincount(np.repeat(np.arange(n), sizes), size[ids], n).astype(np.int64)
        same = got == length
        one, two = (np.frombuffer(x, np.uint8) for x in (self._text(ids.tolist(), known), b"".join(data)))
        differ = one[np.repeat(same, got)] != two[np.repeat(same, length)]
        same[np.repeat(np.flatnonzero(same), length[same])[differ]] = False
        return same

    @staticmethod
    def _text(ids, known: list[bytes]) -> bytes:
        return b"".join([known[i] for i in ids])

    def group_sizes(self, a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A and B tokens of all groups of the windows that end at wa in a and at wb in b, looked up by the windows' ids."""
        if len(self.windows) > MOST_CUTS:
            self.forget_windows()
        na, nb = np.diff(wa, prepend=-1), np.diff(wb, prepend=-1)
        fa, fb = wa - na + 1, wb - nb + 1
        one, back = self._distinct(a, b, fa, na, fb, nb)
        a_text, b_text = a.tobytes(), b.tobytes()
        spans = zip(*(x[one].tolist() for x in (na, 4 * fa, 4 * (fa + na), 4 * fb, 4 * (fb + nb))))
        keys = [(n, a_text[i:j], b_text[k:m]) for n, i, j, k, m in spans]
        known = self.windows
        found = list(map(known.get, keys))
        new = [w for w, at in zip(one.tolist(), found) if at is None]
        fresh = [ids for ids, at in zip(keys, found) if at is None]
        known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
        place = np.array([known[ids] if at is None else at for ids, at in zip(keys, found)], np.int64)
        if new:
            self.sizes.add(*self._aligned(a, b, *(x[new] for x in (fa, na, fb, nb))))
        return self.sizes.take(place[back])[1:]

    @staticmethod
    def _distinct(a: np.ndarray, b: np.ndarray, fa: np.ndarray, na: np.ndarray, fb: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(one window of each kind, of each window its kind): kinds are told by a hash, and all ids are compared."""
        seed = 7
        while True:
            told = na.astype(np.uint64)
            for ids, n, first in ((a, na, fa), (b, nb, fb)):
                own = (ids.astype(np.uint64) + np.uint64(1)) * (np.arange(len(ids)) - np.repeat(first, n) + seed).astype(np.uint64)
                told = mix(told * np.uint64(seed) + np.add.reduceat(mix(own), first) + n.astype(np.uint64))
            _, one, back = np.unique(told, return_index=True, return_inverse=True)
            like = one[back]
            if (na[like] == na).all() and (nb[like] == nb).all() and (a[ranges(fa[like], na)] == a).all() and (b[ranges(fb[like], nb)] == b).all():
                return one, back
            seed += 2

    def _aligned(self, a: np.ndarray, b: np.ndarray, fa: np.ndarray, na: np.ndarray, fb: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, ...]:
        """(groups of each of these windows, A sizes, B sizes of all groups): both sides' bytes are laid end to end."""
        ends_a, ends_b = np.cumsum(self.a_size[a[ranges(fa, na)]]), np.cumsum(self.b_size[b[ranges(fb, nb)]])
        shared, ka, kb = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        last = ends_a[np.cumsum(na) - 1]
        return np.diff(np.searchsorted(shared, last, "right"), prepend=0), np.diff(ka, prepend=-1), np.diff(kb, prepend=-1)


@lru_cache(maxsize=2)
def encoders(bpe: str, pieces: str) -> Encoders:
    return Encoders(bpe, pieces)


def anchors(enc: Encoders, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the last tokens of all windows; *_last are those of the texts."""
    found = []
    for ids, size, space, last in ((a, enc.a_size, enc.a_space, a_last), (b, enc.b_size, enc.b_space, b_last)):
        before = np.append(space[ids[1:]], True)
        before[last] = True
        places = np.flatnonzero(before)
        found.append((places, np.cumsum(size[ids])[places]))
    (pa_, ea), (pb, eb) = found
    _, ka, kb = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    return pa_[ka], pb[kb]


def _list(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def aligned_batch(enc: Encoders, texts: list[str | None]) -> pa.ListArray:
    """The groups of each text, as list<struct<a: list<int>, b: list<int>>>."""
    n_a, n_b, a, b = enc.encode(texts)
    size_a = size_b = np.zeros(0, np.int32)
    if len(a):
        full = n_a > 0
        size_a, size_b = enc.group_sizes(a, b, *anchors(enc, a, b, np.cumsum(n_a[full]) - 1, np.cumsum(n_b[full]) - 1))
    groups = pa.StructArray.from_arrays([_list(pa.array(a), size_a), _list(pa.array(b), size_b)], ["a", "b"])
    in_text = np.searchsorted(np.cumsum(size_a), np.cumsum(n_a), "right")
    return _list(groups, np.diff(in_text, prepend=0))


def _align(bpe: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(bpe, pieces)
        for batch in batches:
            text = batch.column(1)
            weight = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0)))
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + BATCH_BYTES, "right")))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], aligned_batch(enc, text[at:to].to_pylist())], ["id", "groups"])
                at = to

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bpe: str = BPE, pieces: str = PIECES) -> DataFrame:
    """(id, groups array<struct<a, b>>): the ids of the A and B tokens of every group, in order of the text."""
    return _texts(docs, id_col, text_col).mapInArrow(_align(bpe, pieces), ALIGNED)


def _offsets(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.offsets).astype(np.int64)


def pairs_of(a: np.ndarray, b: np.ndarray, a_off: np.ndarray, b_off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of all groups: pairs a << 32 | b. Large groups name each pair once."""
    na, nb = np.diff(a_off), np.diff(b_off)
    small = na * nb <= 4096
    every = np.flatnonzero(small)
    sizes = (na * nb)[every]
    parts = np.cumsum(sizes) // SLICE_LINKS
    out = []
    for g, n in zip(*(np.split(x, np.flatnonzero(np.diff(parts)) + 1) for x in (every, sizes))):
        row = np.repeat(g, n)
        k = ranges(np.zeros(len(g), np.int64), n)
        pair = (a[a_off[row] + k // nb[row]].astype(np.int64) << 32) | b[b_off[row] + k % nb[row]]
        out.append((row, pair, np.ones(len(row), np.int64)))
    for w in np.flatnonzero(~small):
        x, cx = np.unique(a[a_off[w]:a_off[w + 1]], return_counts=True)
        y, cy = np.unique(b[b_off[w]:b_off[w + 1]], return_counts=True)
        pair = ((x.astype(np.int64)[:, None] << 32) | y[None, :]).ravel()
        out.append((np.full(len(pair), w), pair, np.outer(cx, cy).ravel()))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def groups_text(column: pa.ListArray) -> pa.Array:
    """``a1,a2|b1;a3|b2`` of each row's groups."""
    groups = column.values
    told = [pc.binary_join(pa.ListArray.from_arrays(groups.field(k).offsets, pc.cast(groups.field(k).values, pa.string())), ",") for k in ("a", "b")]
    return pc.binary_join(pa.ListArray.from_arrays(column.offsets, pc.binary_join_element_wise(*told, "|")), ";")


def _chunk(number: int, ids: pa.Array, column: pa.ListArray) -> pa.RecordBatch:
    column = pa.concat_arrays([column])
    groups = column.values
    doc_off, a_off, b_off = _offsets(column), _offsets(groups.field("a")), _offsets(groups.field("b"))
    a, b = (np.asarray(groups.field(k).values) for k in ("a", "b"))
    row, pair, times = pairs_of(a, b, a_off, b_off)
    coded = pc.dictionary_encode(pa.array(pair))
    pairs = np.asarray(coded.dictionary)
    span = max(len(pairs), 1)
    key = np.searchsorted(doc_off, row, "right") - 1
    del row, pair
    key *= span
    key += np.asarray(coded.indices)
    del coded
    if (times == 1).all():
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[first], np.diff(first, append=len(key))
    else:
        key, back = np.unique(key, return_inverse=True)
        times = np.bincount(back, times, len(key)).astype(np.int64)
    doc, at = np.divmod(key, span)
    n = len(column)
    per_doc = np.bincount(doc, minlength=n)
    links = np.bincount(doc, times, n).astype(np.int64)
    text = groups_text(column)
    sha = ["" if not len(t) else hashlib.sha256(t.encode()).hexdigest() for t in text.to_pylist()]
    docs = pa.RecordBatch.from_arrays(
        [
            ids, pa.array(a_off[doc_off[1:]] - a_off[doc_off[:-1]]), pa.array(b_off[doc_off[1:]] - b_off[doc_off[:-1]]), pa.array(np.diff(doc_off)),
            pa.array(links), pa.array(sha, pa.string()), _list(pa.array(np.diff(at, prepend=0).astype(np.int32)), per_doc), _list(pa.array(times), per_doc),
        ],
        ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "step", "times"],
    )
    one = np.array([len(pairs)])
    held = np.bincount(at, minlength=len(pairs)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array([number]), _list(pa.array(pairs), one), _list(pa.array(held), one), pa.array([_packed(docs)], pa.binary())], ["chunk", "pairs", "held", "docs"])


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def release() -> None:
    """Give freed memory back: both allocators keep what a chunk took, and a worker stays when its task has ended."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, rows, tokens = chunk_ids(), [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows.append(batch)
        tokens += len(batch.column(1).flatten().field("a").flatten())
        if tokens >= CHUNK_TOKENS:
            del batch
            yield _whole_chunk(next(number), rows)
            tokens = 0
            release()
    if rows:
        yield _whole_chunk(next(number), rows)
    release()


def _whole_chunk(number: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The chunk of these rows, which are let go."""
    columns = pa.Table.from_batches(rows).combine_chunks().to_batches()[0].columns
    rows.clear()
    return _chunk(number, *columns)


def _told(chunk: pa.Table, found: pa.Table) -> pa.Table:
    """Rows of the documents of a chunk, with what was found of its pairs."""
    docs = _unpacked(chunk.column("docs")[0].as_py())
    off = _offsets(docs.column("step"))
    at, times = np.cumsum(docs.column("step").values, dtype=np.int64), np.asarray(docs.column("times").values)
    place = found.column("pos").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    count[place], best[place] = found.column("n").to_numpy(), found.column("best").to_numpy()
    n = docs.num_rows
    doc = np.repeat(np.arange(n), np.diff(off))
    total = [np.zeros(n, np.int64) for _ in range(2)]
    np.add.at(total[0], doc, times * best[at])
    np.add.at(total[1], doc, times * count[at])
    own = [docs.column(k) for k in ("id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.Table.from_arrays([*own, *map(pa.array, total), docs.column("groups_sha256")], LINK_COLUMNS)


LINK_COLUMNS = [c.split()[0] for c in LINKED.split(", ")]


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n, best): the documents that hold each pair linked, and whether its A id has none with more."""
    each = chunks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("x.pairs", "x.held")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("n"))
    own = Window.partitionBy(F.shiftright("pair", 32))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(own)).alias("best"))


def links(aligned: DataFrame) -> DataFrame:
    """Per document of align(): sizes, links, best links, the sum of the links' counts and the digest of its groups."""
    return _links(aligned.mapInArrow(_chunks, CHUNK))


def aligned_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bpe: str = BPE, pieces: str = PIECES) -> DataFrame:
    """links(align(docs)), where a task makes chunks of the groups that it aligns: groups are neither written nor moved."""
    aligned = _align(bpe, pieces)
    return _links(_texts(docs, id_col, text_col).mapInArrow(lambda batches: _chunks(aligned(batches)), CHUNK))


def _links(chunks: DataFrame) -> DataFrame:
    scratch = Scratch(chunks.sparkSession, "links")
    chunks = scratch.save(chunks, "chunks")
    counts = scratch.save(pair_counts(chunks), "counts")
    found = chunks.select("chunk", F.posexplode("pairs").alias("pos", "pair")).join(counts, "pair").select(F.col("chunk").alias("of"), "pos", "n", "best")
    return chunks.select("chunk", "docs").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(_told, LINKED)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return aligned_links(docs).withColumnRenamed("id", "doc_id")
