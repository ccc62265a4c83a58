import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from seqlake.llm import language_id, mixing, neighbours, quotations, sentencepiece, skew
from tests.llm.helpers import by_group, corpus, frame, words

DATA = "/root/testdata/sf0.01"


def test_language_id_on_held_out_documents(spark):
    got = language_id.op6_language_id(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_defined_results(spark):
    rows = [(k, t, lang, None, None) for k, (t, lang) in enumerate([
        ("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("the the the", "en"), ("und und die", "de"),
        (None, "en"), ("", "de"), ("123 !? 456", "en"), ("the " * 50_000, None), ("der", None),
    ])]
    docs = frame(spark, rows)
    model = language_id.fit(docs, rows_per_language=10)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert [got[k] for k in (4, 5, 6)] == [("und", 0.0)] * 3
    assert got[7][0] == "en" and got[8][0] == "de" and got[0][0] == "en"
    none = language_id.fit(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(docs.where("false"), model).count() == 0


def plain_grams(text, buckets):
    """Buckets of the 1- to 3-grams of all words, from the characters' codes alone."""
    out, mask = [], (1 << 64) - 1
    for word in words(text):
        padded = f" {word.lower()} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                gram = padded[i:i + n]
                if n == 1 and gram == " ":
                    continue
                h = 0
                for k, c in enumerate(gram):
                    h = ((h ^ (h >> 29)) * int(language_id._STEP) + ord(c) + k + 1) & mask
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    h = (h ^ (h >> shift)) * factor & mask
                out.append((h ^ (h >> 31)) % buckets)
    return out


def test_language_id_against_a_plain_scorer(spark):
    """The score of each text from its grams one by one, with the idf counted by hand."""
    rows = [(k, " ".join(t), lang, None, None) for k, (t, lang) in enumerate(
        ((rng.choices(own, k=rng.randint(1, 30)) + ["Éa", "x"]), lang) for rng in [random.Random(1)] for lang, own in (("en", ["the", "and", "of", "house"]), ("de", ["der", "und", "Haus", "ist"]), ("fr", ["le", "et", "maison"])) for _ in range(40))]
    docs, buckets = frame(spark, rows), 1 << 12
    model = language_id.fit(docs, rows_per_language=30, buckets=buckets)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    weights = model.weights[model.place].astype(float)
    for d, t, *_ in rows:
        grams = plain_grams(t, buckets)
        logits = sum(weights[g] for g in grams) / len(grams) / model.heat
        p = np.exp(logits - logits.max())
        p /= p.sum()
        assert got[d] == (model.labels[int(p.argmax())], pytest.approx(float(p.max()), abs=1e-6))
    seen = {}
    for _, t, *_ in rows:
        for g in set(plain_grams(t, buckets)):
            seen[g] = seen.get(g, 0) + 1
    found = [docs.select("text").mapInArrow(language_id._frequencies(buckets), "gram long, docs long").groupBy("gram").sum("docs").collect()]
    assert {g: n for g, n in found[0]} == seen
    assert (model.weights[0] == 0).all() and len(model.weights) - 1 <= len(seen)


def test_language_id_of_rows_that_share_an_id(spark):
    """Each row is learned and placed by its own text, and reruns agree."""
    rows = [(k % 5, f"{word} {k}", lang, None, None) for k in range(40) for word, lang in (("the house and the", "en"), ("das Haus und die", "de"))]
    rows += [(1, None, None, None, None), (None, "the and the", "en", None, None), (None, "das und die", "de", None, None)]
    docs = frame(spark, rows)
    want = sorted((t or "", lang or "und") for _, t, lang, *_ in rows)
    for again in (docs, docs.repartition(5)):
        model = language_id.fit(again, rows_per_language=30)
        got = language_id.predict(again, model, keep=("doc_id", "text")).collect()
        assert sorted((r.text or "", r.lang_pred) for r in got) == want


def test_language_id_sample_is_bounded_and_by_hash(spark):
    rows = [(k % 900, f"t{k}", "en" if k % 3 else "de", None, None) for k in range(3000)] + [(1, "rare", "fr", None, None)]
    known = frame(spark, rows).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("row"), "lang")
    got = by_group(language_id.sample_of(known, 50).collect(), lambda r: r.lang)
    assert {lang: sorted(r.k for r in own) for lang, own in got.items()} == {"en": list(range(1, 51)), "de": list(range(1, 51)), "fr": [1]}
    u = F.shiftrightunsigned(F.xxhash64("id", "row"), 11)
    for lang in ("en", "de"):
        least = known.where(F.col("lang") == lang).orderBy(u, "id", "row").limit(50).collect()
        assert {(r.id, r.row) for r in got[lang]} == {(r.id, r.row) for r in least}


def plain_ftrl(rows, labels, classes, buckets, epochs=3, alpha=0.5, beta=1.0, l1=1e-4, l2=1e-4):
    """One coordinate at a time, by the published update."""
    z, n = [[0.0] * classes for _ in range(buckets)], [[0.0] * classes for _ in range(buckets)]

    def weight(i, c):
        if abs(z[i][c]) <= l1:
            return 0.0
        return -(z[i][c] - np.sign(z[i][c]) * l1) / ((beta + n[i][c] ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            index, value = rows[k]
            w = {i: [weight(i, c) for c in range(classes)] for i in index}
            logits = [sum(v * w[i][c] for i, v in zip(index, value)) for c in range(classes)]
            total = sum(np.exp(x) for x in logits)
            for c in range(classes):
                error = np.exp(logits[c]) / total - (labels[k] == c)
                for i, v in zip(index, value):
                    g = v * error
                    z[i][c] += g - ((n[i][c] + g * g) ** 0.5 - n[i][c] ** 0.5) / alpha * w[i][c]
                    n[i][c] += g * g
    return np.array([[weight(i, c) for c in range(classes)] for i in range(buckets)])


def test_ftrl_against_a_plain_version():
    rng = np.random.default_rng(2)
    rows = [(rng.choice(20, 4, replace=False), rng.random(4)) for _ in range(60)]
    labels = rng.integers(0, 3, 60).tolist()
    for l1 in (1e-4, 0.3):
        assert language_id.ftrl(rows, labels, 3, 20, l1=l1) == pytest.approx(plain_ftrl(rows, labels, 3, 20, l1=l1), abs=1e-9)


def test_results_replace_kept_columns_of_their_names(spark):
    df = frame(spark, [(1, "the cat", "en", "s", None), (2, "der Hund", "de", "s", None)])
    for name in ("_letter", "_0", "_1", "lang_pred", "score", "n_tokens", "ids"):
        df = df.withColumn(name, F.lit(name))
    keep = ("doc_id", "text", "_letter", "_0", "_1", "lang_pred", "score", "n_tokens", "ids")
    named = language_id.predict(df, language_id.fit(df, rows_per_language=5), keep=keep)
    assert named.columns == ["doc_id", "text", "_letter", "_0", "_1", "n_tokens", "ids", "lang_pred", "score"]
    assert {(r["_0"], r["_letter"], r.n_tokens) for r in named.collect()} == {("_0", "_letter", "n_tokens")}
    tokens = sentencepiece.encode(df, keep=keep)
    assert {r.lang_pred for r in tokens.collect()} == {"lang_pred"} and dict(tokens.dtypes)["ids"] == "array<int>"
    back = sentencepiece.decode(tokens, keep=("doc_id", "text", "_0"))
    assert {(r.doc_id, r["_0"], r.text) for r in back.collect()} == {(1, "_0", "the cat"), (2, "_0", "der Hund")}


def test_word_grams_by_hand():
    grams, off = language_id.word_grams([b"Ab", b"c"], 1 << 30)
    again, _ = language_id.word_grams([b"ab"], 1 << 30)
    assert off.tolist() == [0, 7, 11]  # a b _a ab b_ _ab ab_ and c _c c_ _c_
    assert grams[:7].tolist() == again.tolist()


def test_ftrl_learns_and_penalty_makes_weights_sparse():
    rng = np.random.default_rng(1)
    rows = [(np.array([y, 2 + rng.integers(50)]), np.array([1.0, 1.0])) for y in rng.integers(0, 2, 400)]
    labels = [int(r[0][0]) for r in rows]
    w = language_id.ftrl(rows, labels, 2, 60)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]
    assert (language_id.ftrl(rows, labels, 2, 60, l1=5.0) == 0).mean() > (w == 0).mean()


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.load_pieces()


def brute_encode(text, table):
    """Greatest sum of scores over all segmentations, the longest last piece on ties."""
    if not text:
        return []
    points = [sentencepiece.LITERAL if c == "▁" else sentencepiece.SPACE if c == " " else ord(c) for c in " " + text]
    best = [(0.0, [])]
    for j in range(1, len(points) + 1):
        found = None
        for i in range(max(0, j - 20), j):
            s = "".join(chr(p) if p != sentencepiece.LITERAL else "\0" for p in points[i:j])
            score, piece = table.scores.get(s, (None, None)) if sentencepiece.LITERAL not in points[i:j] else (None, None)
            if score is None and j - i == 1:
                score, piece = table.unknown, -1 - points[i]
            if score is not None and (found is None or best[i][0] + score > found[0]):
                found = (best[i][0] + score, [*best[i][1], piece])
        best.append(found)
    return sentencepiece._with_bytes(np.array(best[-1][1]), np.array([len(best[-1][1])]), table)[0].tolist()


def test_sentencepiece_against_brute_force_and_round_trip(spark, pieces):
    rng = random.Random(2)
    texts = ["", "a", " ", "  a  b ", "\n\n x\t▁ y", "漢字 é😀 \x00z", "ab" * 200, "Hello  world\n\tété", "x" * 49, "y" * 48]
    texts += ["".join(rng.choice("abcdeé \n漢T") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    got = sentencepiece.encode_column(pa.array(texts), pieces, 200).to_pylist()
    assert got == [brute_encode(t, pieces) for t in texts]
    docs = frame(spark, [(k, t, None, None, None) for k, t in enumerate([*texts, None, texts[5]])])
    tokens = sentencepiece.encode(docs, check=True)
    rows = {r.doc_id: r for r in tokens.collect()}
    assert all(r.round_trip for r in rows.values())
    assert rows[len(texts)].ids is None and rows[len(texts)].n_tokens == 0
    back = {r.doc_id: r.text for r in sentencepiece.decode(tokens).collect()}
    assert back == dict(enumerate([*texts, None, texts[5]]))
    assert sentencepiece.encode(docs.where("false")).count() == 0


def test_sentencepiece_gives_the_ids_of_the_merge_model(spark, pieces):
    model = SentencePieceProcessor(model_file=sentencepiece.MODEL)
    rng = random.Random(3)
    texts = ["", "a", " ", "  a  b ", "\n\n x\t y", "漢字 é😀 z", "ab" * 200, "Hello  world\n\tété", "internationalization" * 3, "x" * 49, "    " * 30]
    texts += ["".join(rng.choice("abcdeéstionr \n漢T") for _ in range(rng.randint(1, 150))) for _ in range(300)]
    texts += ["".join(rng.choice("inherstao") for _ in range(rng.randint(40, 90))) for _ in range(50)]
    docs = frame(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])
    assert {r.doc_id: r.ids for r in sentencepiece.encode(docs).collect()} == dict(enumerate(model.encode(texts)))
    given = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in sentencepiece.op5_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: t if t is None else model.encode(t) for d, t in given.items()}


def targets(spark, sizes):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "place long, words long")
    return [r.target for r in mixing.with_targets(rows).orderBy("place").collect()]


def long_words():
    rng = random.Random(8)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(100_000))
    base64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(20_000))
    return [cjk, base64, "https://example.org/" + "path/" * 300 + "?q=" + "a" * 500, "ab" * 3000, "a" * 5001, "ไทย" * 400, "in" * 33 + "her" * 41, "x" * 65]


def test_sentencepiece_takes_words_of_any_length_the_same_way(pieces):
    texts = long_words()
    model = SentencePieceProcessor(model_file=sentencepiece.MODEL)
    assert sentencepiece.encode_column(pa.array(texts), pieces, merges=True).to_pylist() == model.encode(texts)
    short = [t[:3000] for t in texts]
    got = sentencepiece.encode_column(pa.array(short), pieces)
    assert got.to_pylist() == [brute_encode(t, pieces) for t in short]
    assert [t.decode() for t in sentencepiece.decode_column(got, pieces)] == short


def test_mixing_targets(spark):
    assert targets(spark, [100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    assert targets(spark, [10, 100, 100]) == pytest.approx([30, 120, 60])
    assert targets(spark, [0, 10]) == pytest.approx([0, 10])
    assert targets(spark, []) == []


def test_numbering_over_ranges(spark):
    names = [None, *(f"s{k:03}" for k in range(200)), "é", "Z"]
    rows = spark.createDataFrame([(n,) for n in names], "source string").repartition(5)
    got = {r.source: r.place for r in mixing.numbered(rows, mixing.Scratch(spark, "t"), F.col("source").isNull(), F.col("source")).collect()}
    assert got == {n: k for k, n in enumerate(sorted(names, key=lambda n: (n is None, n or "")))}


def test_splitting_tree_has_exact_totals():
    draws, totals = np.array([100, 7, 0]), [17, 18, 18, 18, 18, 18]
    out = mixing.split_draws(draws, totals, np.random.default_rng(3))
    assert out.sum(0).tolist() == [100, 7, 0] and (out >= 0).all() and out.sum(1).tolist() == totals
    mean = np.mean([mixing.split_draws(draws, totals, np.random.default_rng(k))[:, 0] for k in range(2000)], axis=0)
    assert mean == pytest.approx(100 * np.array(totals) / 107, rel=0.02)


def spark_hash(*longs):
    h = 42
    for bits, x in longs:
        h = xxhash.xxh64_intdigest(x.to_bytes(bits // 8, "little", signed=True), h)
    return h - (1 << 64) * (h >> 63)


def plain_draws(rows, blocks, seed=17):
    """{(doc_id, source): draws} of documents with unique ids, by filling one source after another."""
    size = {d: len(words(t)) for d, t, *_ in rows}
    names = sorted({r[3] for r in rows}, key=lambda n: (n is None, n or ""))
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    own = {n: [r[0] for r in rows if r[3] == n] for n in names}
    words_of = {n: sum(size[d] for d in own[n]) for n in names}
    goal, open_, left = {}, set(names), sum(size.values())
    while open_:
        unit = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if 3 * words_of[n] < weight[n] * unit}
        for n in full or open_:
            goal[n] = 3 * words_of[n] if full else weight[n] * unit
        left -= sum(goal[n] for n in full)
        open_ -= full or set(names)
    out = {}
    for n in names:
        passes = min(3, int(goal[n] // words_of[n])) if words_of[n] else 0
        room = goal[n] - passes * words_of[n] if passes < 3 else 0
        by_hash = {d: spark_hash((32, seed), (64, d)) for d in own[n]}
        of_block = {}
        for d in own[n]:
            of_block.setdefault((by_hash[d] >> 20) % blocks, []).append(d)
        turn = {b: spark_hash((32, seed + 1), (32, b)) for b in of_block}
        missed, passed = False, []
        out |= dict.fromkeys(own[n], passes)
        for b in sorted(of_block, key=lambda b: (turn[b], b)):
            need = sum(size[d] for d in of_block[b])
            if need <= room and (need or not missed):
                room -= need
                for d in of_block[b]:
                    out[d] += 1
            else:
                missed = True
                passed += [(-size[d], turn[b], b, by_hash[d], d) for d in of_block[b] if size[d]]
        for less, *_, d in sorted(passed):
            if -less <= room:
                room += less
                out[d] += 1
    return out, goal


@pytest.mark.parametrize("blocks", [None, 3])
def test_mixing_against_a_plain_mixer(spark, blocks):
    rows = corpus(n=400)
    got = mixing.mix(frame(spark, rows), blocks=blocks).collect()
    want, goal = plain_draws(rows, blocks or round(len(rows) ** 0.5))
    assert {r.doc_id: len(r.draws) for r in got} == want
    assert {r.source: r.target for r in got} == pytest.approx(goal)
    again = {r.doc_id: (r.draws, r.places) for r in mixing.mix(frame(spark, rows).repartition(5), blocks=blocks).collect()}
    assert again == {r.doc_id: (r.draws, r.places) for r in got}
    assert all(len(r.places) == len(r.draws) <= 3 for r in got)
    for _, own in by_group(got, lambda r: r.source).items():
        taken = sum(r["size"] * len(r.draws) for r in own)
        assert abs(taken - own[0].target) <= max(r["size"] for r in own)
        assert own[0].source_size == sum(r["size"] for r in own)
    assert mixing.mix(frame(spark, rows).where("false")).count() == 0


def test_mixing_shards_come_from_the_tree(spark, monkeypatch):
    """Every shard has its share of each source, as many units as the tree gave it; with a tree that gives all to one shard there is one."""
    rows = [(k, "w " * 10, None, f"s{k % 3}", None) for k in range(3000)]
    got = mixing.place(mixing.mix(frame(spark, rows), shards=4))
    source = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, source string")
    shares = {(r.source, r.shard): r["count"] for r in got.join(source, "doc_id").groupBy("source", "shard").count().collect()}
    for s in ("s0", "s1", "s2"):
        whole = sum(shares[s, k] for k in range(4))
        assert all(0.12 < shares[s, k] / whole < 0.4 for k in range(4))
    assert got.select("shard", "place").distinct().count() == got.count() == sum(shares.values())
    monkeypatch.setattr(mixing, "split_draws", lambda draws, totals, rng: np.array([draws] + [np.zeros(len(draws), np.int64)] * (len(totals) - 1)))
    assert [r.shard for r in mixing.place(mixing.mix(frame(spark, rows), shards=4)).select("shard").distinct().collect()] == [0]


@pytest.mark.parametrize("blocks", [4, 1024])
def test_mixing_fills_past_long_documents(spark, blocks):
    rng = random.Random(6)
    sizes = [(f"s{k:02}", n) for k in range(30) for n in [1000, *(rng.randint(10, 70) for _ in range(100))]]
    rows = [(d, "w " * n, None, source, None) for d, (source, n) in enumerate(sizes)]
    rows += [r for r in rows if r[0] % 40 == 7] + [(None, "w w w", None, "s00", None), (9999, "", None, "s00", None)]
    got = mixing.mix(frame(spark, rows), blocks=blocks).collect()
    assert len(got) == len(rows)
    for _, own in by_group(got, lambda r: r.source).items():
        target, passes = own[0].target, int(own[0].target // own[0].source_size)
        left = target - sum(r["size"] * len(r.draws) for r in own)
        assert 0 <= left <= 0.05 * target
        for _, same in by_group(own, lambda r: r.doc_id).items():
            size, times = sum(r["size"] for r in same), {len(r.draws) for r in same}
            assert times == {passes + 1} or times == {passes} and (size == 0 or size > left)


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).astype(np.float32).tolist()
    x[7] = x[3] = x[5]  # equal vectors tie
    odd = [None, [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0]]
    rows = [(k, v, 1, 2) for k, v in enumerate(x + odd)] + [(0, x[0], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cid int, part int")
    got = by_group(neighbours.nearest(df, lambda i: i % 5 == 0, partitions=4, probes=4).collect(), lambda r: r.query_id)
    m = np.array(x, np.float32).astype(float)
    assert sorted(got) == list(range(0, 600, 5))
    for q, found in got.items():
        score = (m * m[q]).sum(1)
        order = [k for k in np.lexsort((np.arange(600), -score)) if k != q][:20]
        found.sort(key=lambda r: r["rank"])
        assert [r.vec_id for r in found] == order and [r["rank"] for r in found] == list(range(1, 21))
        assert [r.score for r in found] == pytest.approx(score[order].tolist(), abs=1e-12)

    for n in (1, 2, 6, 15, 25, 40):  # with the defaults: all candidates, if there are no more than k
        few = by_group(neighbours.nearest(df.where(F.col("vec_id") < n), lambda i: i % 4 == 0).collect(), lambda r: r.query_id)
        assert {q: len(f) for q, f in few.items()} == {q: min(20, n - 1) for q in range(0, n, 4) if n > 1}
    assert neighbours.nearest(df.where("false"), lambda i: i == 0).count() == 0


def test_nearest_of_ties_and_hot_vectors(spark, monkeypatch):
    """Quantised vectors tie by the dozen, one vector holds a third of all rows, and an id has two vectors."""
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    rng = np.random.default_rng(9)
    x = rng.integers(-1, 2, (900, 6)).astype(np.float32)
    x[:, 0] = 1
    x[::3] = x[0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())] + [(4, [9.0] * 6)], "vec_id long, embedding array<float>")
    got = by_group(neighbours.nearest(df, lambda i: i % 9 == 0, partitions=4, probes=4).collect(), lambda r: r.query_id)
    m = x.astype(float)
    m[4] = min(x[4].tolist(), [9.0] * 6)
    assert sorted(got) == list(range(0, 900, 9))
    for q, found in got.items():
        score = m @ m[q]
        assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == [k for k in np.lexsort((np.arange(900), -score)) if k != q][:20]


def test_learned_partitions_recall(spark):
    got = by_group(neighbours.op1_learned_partitions(spark, DATA).collect(), lambda r: r.query_id)
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    recall = []
    for q, found in got.items():
        score = m @ m[ids == q][0]
        score[ids == q] = -np.inf
        recall.append(len({r.vec_id for r in found} & set(ids[np.argsort(-score)[:20]].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_balanced_parts():
    rng = np.random.default_rng(3)
    x = neighbours.unit(rng.normal(size=(300, 5)))
    sizes = np.bincount(neighbours.balanced_parts(x, 8), minlength=8)
    assert sizes.min() >= 35 and sizes.max() <= 40


def test_quotations_by_hand(spark):
    mail = [
        (1, 10, "t", "Hello all.\n\nHow are you?"),
        (2, 11, "t", "Fine.\n\n> how   are YOU?"),
        (3, 12, "t", "Me too.\n> Fine.\n>> How are you?\nBye"),
        (4, 13, "u", "Elsewhere.\n> Fine."),
        (5, 9, "t", "> Hello all.\nquotes the future"),
        (6, 14, "u", None), (7, 15, "u", ""), (8, 16, "v", "> nobody said this"), (2, 11, "t", "Fine.\n\n> how   are YOU?"),
    ]
    df = spark.createDataFrame(mail, "id long, at long, scope string, text string").withColumn("parent_id", F.lit(1)).withColumn("hash", F.lit(2))
    got = {r.id: (r.parent_id, r.root_id, r.depth, r.own_text) for r in quotations.conversations(df).collect()}
    assert got == {
        1: (None, 1, 0, "Hello all.\n\nHow are you?"), 2: (1, 1, 1, "Fine."), 3: (2, 1, 2, "Me too.\nBye"), 4: (2, 1, 2, "Elsewhere."),
        5: (None, 5, 0, "quotes the future"), 6: (None, 6, 0, ""), 7: (None, 7, 0, ""), 8: (None, 8, 0, ""),
    }
    assert quotations.conversations(df.where("false")).count() == 0


def test_quotations_of_mail_with_crlf(spark):
    mail = [
        (1, 10, "t", "Hello all.\r\n\r\nHow are you?\r\n"),
        (2, 11, "t", "Fine.\r\n\r\n> How are you?\r\n>\r\n> Hello all.\r\n"),
        (3, 12, "t", "Me too.\r\n\t\r\n> Fine.\r\n>\t\r\n>> How are you?\r\n"),
        (4, 13, "t", "> Me too.\n"), (4, 14, "s", "> Me too.\nsecond row of this id"),
    ]
    df = spark.createDataFrame(mail, "id long, at long, scope string, text string")
    for docs in (df, df.orderBy(F.desc("at"))):
        got = sorted((r.id, r.parent_id, r.root_id, r.depth, r.linked_passages, r.own_text) for r in quotations.conversations(docs).collect())
        assert got == [(1, None, 1, 0, 0, "Hello all.\r\n\r\nHow are you?"), (2, 1, 1, 1, 2, "Fine."), (3, 2, 1, 2, 1, "Me too."), (4, 3, 1, 3, 1, ""), (4, 3, 1, 3, 1, "second row of this id")]


def test_quotations_of_a_passage_in_half_of_all_mail(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    mail = [(k, k, f"t{k % 7}", "Same words.\n" if k < 9 else f"Own {k}.\n> Same words." if k % 2 else f"Own {k}.\n> Own {k - 1}.") for k in range(300)]
    got = {r.id: r.parent_id for r in quotations.conversations(spark.createDataFrame(mail, "id long, at long, scope string, text string")).collect()}
    assert got == {k: None if k < 10 else next(j for j in range(9) if j % 7 == k % 7) if k % 2 else k - 1 for k in range(300) if k != 9} | {9: 2}


def test_quotation_query_rebuilds_the_turns(spark):
    got = {r.message_id: r for r in quotations.op3_quotation_linking(spark, "/root/testdata/sf0.001").collect()}
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    assert len(got) == len(turns)
    right = sum(got[(t.conv_id << 20) + t.turn].parent_id == ((t.conv_id << 20) + t.turn - 1 if t.turn else None) for t in turns)
    assert right >= 0.99 * len(turns)
