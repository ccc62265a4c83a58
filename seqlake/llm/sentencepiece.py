"""SentencePiece encoding and decoding by batched numpy merges or Viterbi.

The pieces and scores come from a model file whose path is a parameter; the table of pieces,
bounded by the vocabulary, is sent to the tasks. A text gets a leading space and spaces become
U+2581. A file that was trained by merges (BPE) is applied by merges: of the neighbouring pieces
of a word that make up a piece, the pair of the greatest score is joined, the leftmost on ties,
until none is left. Any other file gives the segmentation of the greatest sum of scores, the
longest piece winning ties at each end. Characters without a piece become byte pieces.

No piece runs over a space that follows another character, so the pieces of a text are the
pieces of its words, cut there, and distinct words of a batch are encoded once. Words are cut
further between characters that are neighbours in no piece, as no piece runs over such a
place. Words with equally many characters advance together, whatever their length, and hashes of
substrings probe the sorted keys of the pieces. Merging, each round joins one pair per word
and looks up the two pairs that this makes; the best pair is found over maxima of stretches of
a word, so a round looks at the square root of a long word. Viterbi takes maxima over the
lengths that may end at a character and stores backpointers.

A literal U+2581 in a text is written as bytes, so decoding restores every text exactly; all
other ids are those of SentencePieceProcessor.encode for a file with identity normalization.

Defined results: a null text has null ids and 0 tokens, an empty one no ids; texts are never
cut; an empty table gives an empty result; other columns are kept by encode's ``keep`` list, but for
those with the names of the results, which are replaced; rows are never merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.scratch import short_batches
from seqlake.llm.text import Words, pieces, texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
STRETCH = 64
SPACE, LITERAL = 0x2581, 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """Pieces as arrays: keys by length with ids and scores, byte ids, and surfaces by id."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    scores: dict[str, tuple[float, int]]
    unknown: float
    bytes_: np.ndarray
    unknown_id: int
    surface: np.ndarray
    surface_off: np.ndarray
    alone: np.ndarray  # bytes that stand in no piece of more characters
    keys: np.ndarray  # of pieces of all lengths, sorted, with ids and scores
    key_ids: np.ndarray
    key_scores: np.ndarray
    neighbours: np.ndarray  # pairs of characters that are neighbours in a piece, sorted
    merges: bool  # whether the file was trained by merges


def _keys(points: np.ndarray) -> np.ndarray:
    """Prefix hashes (n, length + 1) of rows of characters."""
    h = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    for j in range(points.shape[1]):
        h[:, j + 1] = h[:, j] * _BASE + points[:, j].astype(np.uint64) + np.uint64(1)
    return h


def load_pieces(path: str = MODEL) -> Pieces:
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    normal = {model.id_to_piece(i): (model.get_score(i), i) for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    if any(chr(SPACE) in p.lstrip(chr(SPACE)) for p in normal):
        raise ValueError("a piece runs over the start of a word")
    surface = [b""] * size
    byte_ids = np.full(256, -1, np.int32)
    for i in range(size):
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[3:5], 16)
            surface[i], byte_ids[value] = bytes([value]), i
    for p, (_, i) in normal.items():
        surface[i] = p.replace(chr(SPACE), " ").encode()
    by_length = {}
    for n in sorted({len(p) for p in normal}):
        own = [p for p in normal if len(p) == n]
        key = _keys(np.array([[ord(c) for c in p] for p in own], np.uint32))[:, -1]
        order = np.argsort(key)
        by_length[n] = (key[order], np.array([normal[p][1] for p in own], np.int32)[order], np.array([normal[p][0] for p in own])[order])
    joined = {b for p in normal if len(p) > 1 for b in p.encode()}
    alone = np.array([b < 0x20 and b not in joined for b in range(256)])
    off = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
    keys, key_ids, key_scores = (np.concatenate([own[k] for own in by_length.values()]) for k in range(3))
    order = np.argsort(keys)
    keys, key_ids, key_scores = keys[order], key_ids[order], key_scores[order]
    if (keys[1:] == keys[:-1]).any():
        raise ValueError("two pieces have one key")
    trainer = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).trainer_spec
    merges = trainer.model_type == trainer.BPE
    if merges and any(model.is_unused(i) for i in range(size)):
        raise ValueError("a merge model has unused pieces")
    neighbours = np.array(sorted({ord(x) << 32 | ord(y) for p in normal for x, y in zip(p, p[1:])}), np.uint64)
    least = min(s for s, _ in normal.values())
    return Pieces(by_length, normal, least - 10.0, byte_ids, model.unk_id(), np.frombuffer(b"".join(surface), np.uint8), off, alone, keys, key_ids, key_scores, neighbours, merges)


def _viterbi(points: np.ndarray, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in order, how many by word) by the greatest sum of scores; a character without a piece is -1 - code."""
    n, length = points.shape
    prefix = _keys(points)
    scores, ids, power = {}, {}, np.uint64(1)
    for span in range(1, min(length, max(table.by_length)) + 1):
        with np.errstate(over="ignore"):
            power = power * _BASE
        if span not in table.by_length:
            continue
        keys, piece_ids, piece_scores = table.by_length[span]
        probe = prefix[:, span:] - prefix[:, :-span] * power
        at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
        hit = keys[at] == probe
        scores[span] = np.where(hit, piece_scores[at], -np.inf)
        ids[span] = np.where(hit, piece_ids[at], -1)
    missing = ids[1] < 0 if 1 in ids else np.ones((n, length), bool)
    scores[1] = np.where(missing, table.unknown, scores.get(1, np.zeros((n, length))))
    ids[1] = np.where(missing, -1 - points.astype(np.int32), ids.get(1, np.zeros((n, length), np.int32)))
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, length + 1), np.int32)
    spans = sorted(scores, reverse=True)
    for j in range(1, length + 1):
        for span in spans:
            if span <= j:
                total = best[:, j - span] + scores[span][:, j - span]
                better = total > best[:, j]
                best[better, j] = total[better]
                back[better, j] = span
    out, count, at = np.zeros((n, length), np.int32), np.zeros(n, np.int64), np.full(n, length)
    open_rows = np.arange(n)
    while len(open_rows):
        span = back[open_rows, at[open_rows]]
        start = at[open_rows] - span
        for s in np.unique(span):
            own = open_rows[span == s]
            out[own, count[own]] = ids[int(s)][own, at[own] - s]
        count[open_rows] += 1
        at[open_rows] = start
        open_rows = open_rows[start > 0]
    place = count[:, None] - 1 - np.arange(length)  # from the last piece to the first
    return np.take_along_axis(out, np.maximum(place, 0), 1)[place >= 0], count


def _merge(points: np.ndarray, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in order, how many by word) by merges; a character without a piece is -1 - code."""
    n, length = points.shape
    prefix = _keys(points)
    power = np.multiply.accumulate(np.array([1] + [_BASE] * length, np.uint64))

    def find(keys: np.ndarray) -> np.ndarray:
        """Their places among the pieces' keys, or -1."""
        at = np.minimum(np.searchsorted(table.keys, keys), len(table.keys) - 1)
        return np.where(table.keys[at] == keys, at, -1)

    one = find(prefix[:, 1:] - prefix[:, :-1] * power[1])
    ids = np.where(one < 0, -1 - points.astype(np.int32), table.key_ids[one])
    end = np.tile(np.arange(1, length + 1), (n, 1))
    before = np.tile(np.arange(-1, length), (n, 1))
    there = np.ones((n, length), bool)
    width = length if length <= STRETCH else int(np.ceil(length**0.5))
    stretches = -(-length // width)
    pair, score = np.full((n, length), -1), np.full((n, stretches, width), -np.inf)  # of the piece that begins here and its next
    flat = score.reshape(n, -1)
    pair[:, :-1] = find(prefix[:, 2:] - prefix[:, :-2] * power[min(2, length)])
    flat[:, :length][pair >= 0] = table.key_scores[pair[pair >= 0]]
    best = score.max(2)

    def put(rows: np.ndarray, at: np.ndarray, value) -> None:
        flat[rows, at] = value
        if stretches > 1:
            own = at // width
            best[rows, own] = score[rows, own].max(1)

    def look(rows: np.ndarray, first: np.ndarray, past: np.ndarray) -> None:
        found = find(prefix[rows, past] - prefix[rows, first] * power[past - first])
        pair[rows, first] = found
        put(rows, first, np.where(found < 0, -np.inf, table.key_scores[found]))

    rows = np.arange(n)
    while True:
        own = best[rows].argmax(1) if stretches > 1 else np.zeros(len(rows), np.int64)
        at = own * width + score[rows, own].argmax(1)
        more = flat[rows, at] > -np.inf
        rows, at = rows[more], at[more]
        if not len(rows):
            return ids[there], there.sum(1)
        middle = end[rows, at]
        past = end[rows, middle]
        ids[rows, at], end[rows, at], before[rows, past] = table.key_ids[pair[rows, at]], past, at
        there[rows, middle] = False
        put(rows, middle, -np.inf)
        put(rows, at, -np.inf)
        right, left = past < length, at > 0
        look(rows[right], at[right], end[rows[right], past[right]])
        look(rows[left], before[rows[left], at[left]], past[left])


def _with_bytes(ids: np.ndarray, size: np.ndarray, table: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """ids with byte pieces for characters without a piece (-1 - code), and how many by word."""
    lost = np.flatnonzero(ids < 0)
    if not len(lost):
        return ids, size
    codes, which = np.unique(-1 - ids[lost], return_inverse=True)
    spelt = [table.bytes_[list(chr(SPACE if c == LITERAL else c).encode())] for c in codes.tolist()]
    spelt = [b if (b >= 0).all() else np.array([table.unknown_id], np.int32) for b in spelt]
    long = np.ones(len(ids), np.int64)
    long[lost] = np.array([len(b) for b in spelt])[which]
    out = np.repeat(ids, long)
    start = np.cumsum(long) - long
    first = np.concatenate([[0], np.cumsum([len(b) for b in spelt])])[which]
    step = np.arange(long[lost].sum()) - np.repeat(np.cumsum(long[lost]) - long[lost], long[lost])
    out[np.repeat(start[lost], long[lost]) + step] = np.concatenate(spelt)[np.repeat(first, long[lost]) + step]
    total = np.concatenate([[0], np.cumsum(long)])
    ends = np.cumsum(size)
    return out, total[ends] - total[ends - size]


def encode_words(distinct: list[bytes], table: Pieces, merges: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, offsets by word), by merges or by the greatest sum of scores."""
    raw = b"".join(distinct)
    points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    points = np.where(points == SPACE, LITERAL, np.where(points == 0x20, SPACE, points)).astype(np.uint32)
    begun = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # characters before each byte
    first = begun[np.concatenate([[0], np.cumsum([len(w) for w in distinct])])]

    near = points[:-1].astype(np.uint64) << np.uint64(32) | points[1:].astype(np.uint64)
    cut = np.ones(len(points), bool)
    if len(table.neighbours):
        cut[1:] = table.neighbours[np.minimum(np.searchsorted(table.neighbours, near), len(table.neighbours) - 1)] != near
    cut[first[:-1]] = True
    starts = np.flatnonzero(cut)
    length = np.diff(np.append(starts, len(points)))
    order = np.argsort(length, kind="stable")
    found, size = [], np.zeros(len(starts), np.int64)
    for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        ids, count = (_merge if merges else _viterbi)(points[starts[rows][:, None] + np.arange(length[rows[0]])], table)
        found.append(ids)
        size[rows] = count
    ids = np.concatenate(found)
    step = np.arange(len(ids)) - np.repeat(np.cumsum(size[order]) - size[order], size[order])
    placed = np.empty_like(ids)
    placed[np.repeat((np.cumsum(size) - size)[order], size[order]) + step] = ids
    ids, size = _with_bytes(placed, size, table)
    total = np.concatenate([[0], np.cumsum(size)])
    return ids.astype(np.int32), total[np.searchsorted(starts, first)].astype(np.int64)


def encode_column(column: pa.Array, table: Pieces, most: int = 1 << 20, merges: bool = False) -> pa.Array:
    """list<int32> of ids for a column of texts, by merges or by the greatest sum of scores."""
    data, off = texts(column)
    ids, sizes = [], np.zeros(len(off) - 1, np.int64)
    for a, b in pieces(off, most):
        bounds = off[a:b + 1] - off[a]
        full = np.diff(bounds) > 0
        text = np.insert(data[off[a]:off[b]], bounds[:-1][full], 0x20)
        bounds = bounds + np.concatenate([[0], np.cumsum(full)])
        if not len(text):
            continue
        space, single = text == 0x20, table.alone[text]
        cut = np.zeros(len(text), bool)
        cut[0] = True
        cut[1:] = (space[1:] & ~space[:-1]) | single[1:] | single[:-1]
        cut[bounds[:-1][full]] = True
        starts = np.flatnonzero(cut)
        w = Words(np.arange(a, b), text, starts, np.append(starts[1:], len(text)), np.searchsorted(starts, bounds), bounds)
        _, at, place = np.unique(w.hashes(), return_index=True, return_inverse=True)
        raw = text.tobytes()
        values, value_off = encode_words([raw[s:e] for s, e in zip(starts[at].tolist(), w.ends[at].tolist())], table, merges)
        size = np.diff(value_off)[place]
        ends = np.cumsum(size)
        ids.append(values[np.arange(ends[-1]) + np.repeat(value_off[place] - ends + size, size)])
        sizes[a:b] = np.diff(np.concatenate([[0], ends])[w.first])
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(flat))


def decode_column(ids: pa.Array, table: Pieces) -> list[bytes]:
    """The texts of lists of ids, as UTF-8."""
    flat = ids.values.to_numpy(zero_copy_only=False)
    bounds = np.array(ids.offsets)
    flat, bounds = flat[bounds[0]:bounds[-1]], bounds - bounds[0]
    out = []
    for a, b in pieces(bounds, 4 << 20):
        own = flat[bounds[a]:bounds[b]]
        size = np.diff(table.surface_off)[own]
        ends = np.cumsum(size)
        text = table.surface[np.arange(ends[-1] if len(ends) else 0) + np.repeat(table.surface_off[own] - ends + size, size)].tobytes()
        cuts = np.concatenate([[0], ends])[bounds[a:b + 1] - bounds[a]].tolist()
        out += [text[s:e][1:] for s, e in zip(cuts[:-1], cuts[1:])]
    return out


def _encoded(shared, check: bool):
    def run(batches):
        table = shared.value
        for batch in batches:
            text = batch.column(0)
            ids = encode_column(text, table, merges=table.merges)
            count = pc.list_value_length(ids).cast(pa.int64())
            given = pc.is_valid(text)
            out = [*(batch.column(k) for k in range(1, batch.num_columns)), count, pc.if_else(given, ids.cast(pa.list_(pa.int32())), pa.scalar(None, pa.list_(pa.int32())))]
            names = [*batch.schema.names[1:], "n_tokens", "ids"]
            if check:
                data, off = texts(text)
                raw = data.tobytes()
                same = [raw[a:b] == d for a, b, d in zip(off[:-1].tolist(), off[1:].tolist(), decode_column(ids, table))]
                out.append(pa.array(same, pa.bool_()))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), check: bool = False) -> DataFrame:
    """The kept columns with n_tokens and ids; with check, round_trip says whether decoding gives the text."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model))
    kept = [c for c in keep if c not in ("n_tokens", "ids", "round_trip")]
    types = [f.dataType.simpleString() for f in docs.select(*kept).schema]
    schema = "".join(f"_{k + 1} {t}, " for k, t in enumerate(types)) + "n_tokens long, ids array<int>" + ", round_trip boolean" * check
    rows = docs.select(F.col(text_col).alias("_0"), *[F.col(c).alias(f"_{k + 1}") for k, c in enumerate(kept)])
    return rows.mapInArrow(_encoded(shared, check), schema).toDF(*kept, "n_tokens", "ids", *["round_trip"] * check)


def _decoded(shared):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            text = decode_column(pc.fill_null(ids, []), shared.value)
            text = pa.array([t.decode("utf-8", "replace") if v else None for t, v in zip(text, pc.is_valid(ids).to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1, batch.num_columns)), text], [*batch.schema.names[1:], "text"])

    return run


def decode(tokens: DataFrame, model: str = MODEL, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with text, the inverse of encode; null ids give a null text."""
    shared = tokens.sparkSession.sparkContext.broadcast(load_pieces(model))
    kept = [c for c in keep if c != "text"]
    types = [f.dataType.simpleString() for f in tokens.select(*kept).schema]
    schema = "".join(f"_{k + 1} {t}, " for k, t in enumerate(types)) + "text string"
    rows = tokens.select(F.col(ids_col).alias("_0"), *[F.col(c).alias(f"_{k + 1}") for k, c in enumerate(kept)])
    return rows.mapInArrow(_decoded(shared), schema).toDF(*kept, "text")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, check=True)
