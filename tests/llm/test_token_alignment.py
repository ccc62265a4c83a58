"""Token alignment against the tokenizers' own ids and a plain walk over both."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqlake.llm import token_alignment as TA
from tests.llm.helpers import corpus, frame

ODD = [
    "  a   b <|endoftext|> x\n\n y", "é▁ foo", "▁", "😀😀 it's I'LL we'll 12 123,456\t\tx", "   ", "　 x", "a\u0000b", "日本語 テキスト", "\r\n\r\n  z ", " \n \n x",
    "a\n \nb", "x  y   z", "a" * 3000, "ab " * 10 + "\t \t q  ", "<s> </s> <unk> <0x41>", "the the the", "tail  \n ", "é ​ ﻿ x", "no space" + "不" * 200,
]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TA.BPE)
    tokenizer.encode_special_tokens = True
    enc = TA.encoders(TA.BPE, TA.PIECES)

    def groups(text):
        if not text:
            return []
        whole = " " + text
        a, b = tokenizer.encode(whole, add_special_tokens=False).ids, enc.b.encode(text)
        x, y = [enc.a_bytes[i] for i in a], [enc.b_bytes[i] for i in b]
        if not b"".join(x) == b"".join(y) == whole.encode():
            return []
        out, i, j, ends = [], 0, 0, [0, 0]
        ga, gb = [], []
        while i < len(a) or j < len(b):
            if not ga or (gb and ends[0] < ends[1]):
                ga.append(a[i])
                ends[0] += len(x[i])
                i += 1
            else:
                gb.append(b[j])
                ends[1] += len(y[j])
                j += 1
            if ga and gb and ends[0] == ends[1]:
                out.append((ga, gb))
                ga, gb = [], []
        return out

    return groups


def stats(rows, groups):
    """{row: (n_a, n_b, n_groups, n_links, n_best, count_sum, sha)} by listing all links."""
    own = [groups(t) for t in rows]
    links = [Counter((a, b) for ga, gb in g for a in ga for b in gb) for g in own]
    held = Counter(p for x in links for p in x)
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for g, x in zip(own, links):
        told = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        out.append((
            sum(len(ga) for ga, _ in g), sum(len(gb) for _, gb in g), len(g), sum(x.values()), sum(n for p, n in x.items() if held[p] == best[p[0]]),
            sum(n * held[p] for p, n in x.items()), hashlib.sha256(told.encode()).hexdigest() if g else "",
        ))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_groups_and_counts(spark, plain):
    rows = corpus(n=25) + [(10_001 + k, t, None, None, None) for k, t in enumerate(ODD)] + [(7, "twice", None, None, None), (7, "twice", None, None, None), (None, "no id", None, None, None)]
    docs = frame(spark, rows)
    aligned = TA.align(docs)
    want = sorted((str(d), [(g[0], g[1]) for g in plain(t)]) for d, t, *_ in rows)
    got = sorted((str(r.id), [(list(g.a), list(g.b)) for g in r.groups]) for r in aligned.collect())
    assert got == want
    told = TA.links(aligned).collect()
    assert sorted((str(r.id), *(r[c] for c in COLUMNS)) for r in told) == sorted((str(r[0]), *x) for r, x in zip(rows, stats([r[1] for r in rows], plain)))


def test_many_chunks_and_little_memory(spark, plain, monkeypatch):
    """Tiny chunks and a task that forgets after every batch give the same."""
    texts = [t for _, t, *_ in corpus(n=12)]
    enc = TA.Encoders(TA.BPE, TA.PIECES)
    monkeypatch.setattr(TA, "MOST_CUTS", 3)
    got = [[(g["a"], g["b"]) for g in TA.aligned_batch(enc, [t])[0].as_py()] for t in texts]
    assert got == [plain(t) for t in texts]
    whole = TA.Encoders(TA.BPE, TA.PIECES)
    whole.whole = True
    assert TA.aligned_batch(whole, ODD).to_pylist() == TA.aligned_batch(enc, ODD).to_pylist()


def test_large_groups_name_each_pair_once():
    import numpy as np

    a, b = np.arange(200, dtype=np.int32) % 90, np.arange(300, dtype=np.int32) % 70
    row, pair, times = TA.pairs_of(a, b, np.array([0, 199, 200]), np.array([0, 299, 300]))
    plain = Counter((0, int(x) << 32 | int(y)) for x in a[:199] for y in b[:299]) + Counter({(1, int(a[199]) << 32 | int(b[299])): 1})
    assert Counter({(int(r), int(p)): int(t) for r, p, t in zip(row, pair, times)}) == plain


def test_empty_table_and_query(spark, tmp_path, plain):
    docs = frame(spark, corpus(n=3))
    assert TA.links(TA.align(docs.where("false"))).count() == 0
    rows = corpus(n=8)
    docs = frame(spark, rows).select("doc_id", "text", F.lit(1).alias("groups"), F.lit(2).alias("found"))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = TA.op11_token_alignment(spark, f"file://{tmp_path}")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = {r[0]: x for r, x in zip(rows, stats([r[1] for r in rows], plain))}
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got.collect()} == want


def test_frequent_cuts_are_remembered_and_new_ones_encoded_as_one_text(monkeypatch):
    """Encoded one by one or as one text, with every kind of border; after each batch only what came twice is still known."""
    enc = TA.Encoders(TA.BPE, TA.PIECES)
    monkeypatch.setattr(TA, "MOST_CUTS", 10)
    odd = [None, "", " ", "a  ", "b \n", "\n c", "it 's  x  y", "\x1c d\x1d e", "f▁ g", "　 ​ h ", "ﬁ Å \U0001f600", "x\u0085 y", "don 't ' s", "z" * 5000 + " q"]
    for k in range(3):
        texts = [*odd, *[f"common w{k}x{i} common été " for i in range(30)]]
        calls, encode = [], enc.a.encode_ordinary
        monkeypatch.setattr(enc.a, "encode_ordinary", lambda c: calls.append(c) or encode(c), raising=False)
        n_a, n_b, a, b = enc.encode(texts if k else texts[len(odd):])
        monkeypatch.setattr(enc.a, "encode_ordinary", encode)
        assert len(calls) < 30
        if not k:
            assert " common" in enc.cuts and len(enc.cuts) <= 5
        at_a = at_b = 0
        for t, x, y in zip(texts if k else texts[len(odd):], n_a, n_b):
            one, two = (encode(" " + t), enc.b.encode(t)) if t else ([], [])
            whole = t and enc._text(one, enc.a_bytes) == enc._text(two, enc.b_bytes) == (" " + t).encode()
            assert (list(a[at_a:at_a + x]), list(b[at_b:at_b + y])) == ((one, two) if whole else ([], [])), t
            at_a, at_b = at_a + x, at_b + y
        assert (at_a, at_b) == (len(a), len(b))


def test_query_neither_writes_nor_moves_groups(spark, tmp_path, monkeypatch):
    """Documents become chunks in the task that aligns them, with the figures that aligned groups give."""
    docs = frame(spark, corpus(n=9))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    saved, save = [], TA.Scratch.save
    monkeypatch.setattr(TA.Scratch, "save", lambda self, df, name="t": saved.append(df.columns) or save(self, df, name))
    got = sorted(tuple(r) for r in TA.op11_token_alignment(spark, f"file://{tmp_path}").collect())
    assert saved and not any("groups" in c for c in saved)
    assert got == sorted(tuple(r) for r in TA.links(TA.align(docs)).collect())


def test_counts_reach_documents_as_rows_and_bytes(spark, tmp_path):
    """A chunk's documents are one packed value in Spark's memory, and no task gathers a chunk's counts as objects."""
    frame(spark, corpus(n=9)).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = TA.op11_token_alignment(spark, f"file://{tmp_path}")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "docs" in plan
    assert dict(f.split(" ", 1) for f in TA.CHUNK.split(", "))["docs"] == "binary"


def test_packed_documents_keep_large_counts():
    """One group of 50 000 equal tokens on both sides links a pair 2.5 billion times."""
    import numpy as np
    import pyarrow as pa

    n = 50_000
    tokens = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(np.full(n, k, np.int32))) for k in (3, 4)]
    groups = TA._list(pa.StructArray.from_arrays(tokens, ["a", "b"]), np.array([1]))
    chunk = pa.Table.from_batches([TA._chunk(0, pa.array([9]), groups)])
    found = pa.table({"pos": pa.array([0], pa.int32()), "n": [1], "best": [True]})
    assert TA._told(chunk, found).select(["n_links", "n_best", "count_sum"]).to_pylist() == [{"n_links": n * n, "n_best": n * n, "count_sum": n * n}]


def test_a_worker_gives_back_what_its_chunks_took():
    """When a task has ended, its worker holds little besides the tokenizers and what it remembers of cuts and windows."""
    import subprocess
    import sys

    told = subprocess.run([sys.executable, "-c", """
import random, re
import pyarrow as pa
from seqlake.llm import token_alignment as TA

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem): +(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rng = random.Random(3)
TA.chunk_ids = lambda: iter(range(9))
vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(4000)]
batches = [pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([" ".join(rng.choices(vocab, k=600)) for _ in range(300)])], ["id", "text"]) for _ in range(6)]
TA.encoders(TA.BPE, TA.PIECES)
began = held()
made = sum(1 for c in TA._chunks(TA._align(TA.BPE, TA.PIECES)(iter(batches))))
print(made, held() - began)
"""], capture_output=True, text=True, check=True).stdout.split()
    assert int(told[0]) >= 2
    assert float(told[1]) < 40
