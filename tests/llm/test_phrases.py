"""Phrase mining against plain counts, and its filters against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from seqlake.llm import phrases as P
from tests.llm.helpers import LOWER, corpus, frame


def plain(rows, least=10, percent=50, most=2000):
    """{(lang, rank): (phrase, a, l, r, n, score)} by counting every phrase."""
    out = {}
    by_lang = {}
    for _, text, lang, *_ in rows:
        by_lang.setdefault(lang or "und", []).append((text or "").translate(LOWER))
    for lang, texts in by_lang.items():
        f = Counter()
        for text in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
                w = re.findall(r"[^\x20\x09]+", piece)
                for k in (1, 2, 3):
                    f.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for k, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out[lang, k] = (phrase.decode(), -a, left, right, n, -score)
    return out


def sentences(seed=3, n=400):
    rng = random.Random(seed)
    vocab = ["The", "the", "of", "new", "york", "city", "é", "a", "b", "ß", " x"]
    texts = [None, "", " \t ", "...", "new york", "x" * 5000, "a b " * 4000]
    for _ in range(n):
        w = rng.choices(vocab, k=rng.randint(1, 30))
        if rng.random() < 0.3:
            w += ["New", "York", "City"]
        texts.append("".join(x + rng.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "  "]) for x in w))
    return [(k % 350, t, rng.choice(["en", "en", "en", "fr", None]), None, None) for k, t in enumerate(texts)]


def told(df):
    rows = df.collect()
    assert len({(r.lang, r["rank"]) for r in rows}) == len(rows)
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows}


@pytest.mark.parametrize("shards", [P.SHARD_NGRAMS, 500])
def test_collocations(spark, monkeypatch, shards):
    """With one shard, and with many."""
    monkeypatch.setattr(P, "SHARD_NGRAMS", shards)
    rows = sentences() + corpus(n=20)
    assert told(P.collocations(frame(spark, rows).withColumnRenamed("hash", "word"))) == plain(rows)
    assert told(P.collocations(frame(spark, rows), least=3, percent=80, most=5)) == plain(rows, 3, 80, 5)


def test_blocks_and_full_filters(monkeypatch):
    monkeypatch.setattr(P, "BLOCK_NGRAMS", 64)
    monkeypatch.setattr(P, "FULL", 100)
    import pyarrow as pa

    rng = np.random.default_rng(1)
    found = pa.array([[{"pos": k, "id": k + 1} for k in range(9)], None, [{"pos": 0, "id": 9}]], pa.list_(pa.struct([("pos", pa.int32()), ("id", pa.int64())])))
    streams = [rng.integers(-1, 11, 3000).astype(np.int32), np.array([-1, 0, 1], np.int32), np.array([-1, 0, 0, 0, 1], np.int32)]
    batch = pa.RecordBatch.from_arrays([pa.array([s.tolist() for s in streams], pa.list_(pa.int32())), found], ["stream", "found"])
    packed = pa.Table.from_batches(list(P._filters(5, 3)([batch])))
    want = Counter()
    for s, ids in ((streams[0], [*range(1, 10), 0, 0, 0]), (streams[2], [9, 0, 0])):
        w = [ids[x] for x in s]
        want.update((a, b, 0) for a, b in zip(w, w[1:]) if a and b)
        want.update((a, b, c) for a, b, c in zip(w, w[1:], w[2:]) if a and b and c)
    got = Counter()
    for shard in set(packed.column("shard").to_pylist()):
        own = packed.filter(pa.compute.equal(packed.column("shard"), shard))
        for r in P._counted(5, 3, 1)(own).to_pylist():
            assert (r["w1"], r["w2"], r["w3"]) not in got
            got[r["w1"], r["w2"], r["w3"]] = r["a"]
    assert got == want


@pytest.mark.parametrize("bits", [1, 4, 13, 21, 22, 32])
def test_permutation_and_filter_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    n = 3000
    first = rng.integers(0, 2**bits, n, dtype=np.uint64)
    rest = rng.integers(0, 2 ** min(2 * bits, 63), n, dtype=np.uint64) * np.uint64(2 if bits == 32 else 1)
    p = P.Permutation(bits)
    f, r = p.scramble(first, rest)
    assert f.max() < 2**bits and (bits == 32 or r.max() < 4**bits)
    assert all((x == y).all() for x, y in zip(p.restore(f, r), (first, rest)))
    if bits == 4:
        every = np.arange(16**3, dtype=np.uint64)
        assert len({(int(a), int(b)) for a, b in zip(*p.scramble(every >> np.uint64(8), every & np.uint64(255)))}) == 16**3
    count = rng.integers(1, 600, n)
    want = Counter()
    for a, b, c in zip(f.tolist(), r.tolist(), count.tolist()):
        want[b, a] += c
    own = P.Filter.of(bits, r, f, count)
    for shard_bits in (0, min(3, 2 * bits)):
        parts = [P.Filter.unpacked(bits, shard_bits, row) for row in own.packed(shard_bits).to_pylist()]
        both = P.Filter.merged(parts)
        assert dict(zip(zip(both.rest.tolist(), both.first.tolist()), both.count.tolist())) == want
        assert sum(len(x.rest) for x in parts) == len(want)


def test_scores_past_64_bits(spark):
    big = 99_999_999_999_999
    df = spark.createDataFrame([(big, big * 9_000, big * 8_000), (10, 10, 10), (7, 9, 10**18 - 1)], "a long, l long, r long")
    got = [r.s for r in df.select(P.exact_score(df.a, df.l, df.r).alias("s")).collect()]
    assert got == [1_000_000 * big * big // (big * 9_000 * big * 8_000), 1_000_000, 0]


def test_empty_tables(spark):
    assert P.collocations(frame(spark, corpus(n=3)).where("false")).count() == 0
    assert P.collocations(frame(spark, [(1, None, None, None, None), (2, " . ", "en", None, None)])).count() == 0
