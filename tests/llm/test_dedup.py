import hashlib
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from seqlake.llm import components as C
from seqlake.llm import exact_dedup, line_dedup, ngram_join, sharding, skew, substring_dedup
from seqlake.llm.scratch import Scratch
from tests.llm.helpers import by_group, components, corpus, frame, kept_words


def empty(spark):
    return frame(spark, corpus()).where("false")


@pytest.mark.parametrize("hot_rows", [256, 1])
@pytest.mark.parametrize("digest", ["sha256", "length"])
def test_exact_dedup(spark, monkeypatch, hot_rows, digest):
    """Also with nearly all digests hot, and with a digest that different contents share."""
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    if digest == "length":
        monkeypatch.setattr(exact_dedup, "digest_of", lambda c: F.pmod(F.length(c), F.lit(7)).cast("string").cast("binary"))
    rows = corpus()
    rows += [rows[3], rows[9]]  # repeated rows
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if digest == "sha256" else str(len(t) % 7).encode().hex()
    groups = by_group(rows, lambda r: norm(r[1]))
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(frame(spark, rows), salts=3).collect())
    want = Counter()
    for r in rows:
        g = groups[norm(r[1])]
        keep = min(x[0] for x in g)
        want[(r[0], keep, len(g), r[0] == keep, sha(norm(r[1])))] += 1
    assert got == want
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_of_a_text_that_holds_half_of_all_rows(spark):
    rows = [(k, "the same text" if k % 2 else f"text {k}", None, None, None) for k in range(2000)]
    got = exact_dedup.exact_dedup(frame(spark, rows))
    assert {(r.keep_id, r.group_size) for r in got.where("doc_id % 2 = 1").collect()} == {(1, 1000)}
    assert got.where("kept").count() == 1001


def test_ngram_components(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, rows)).collect()}
    assert got == components(rows)
    assert len({c for _, c in got.values()}) < len(got)


@pytest.mark.parametrize("edits", [4, 9])
def test_ngram_components_of_one_large_group(spark, monkeypatch, edits):
    """Many near copies that share all n-grams but few, above, around and below the threshold: several rounds of stars, hot n-grams."""
    monkeypatch.setattr(ngram_join, "STARS", (1, 2))
    monkeypatch.setattr(ngram_join, "STARS_GROW", 2)
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for j in range(k % edits):
            w[(7 * k + 13 * j) % 120] = f"edit{k}-{j}"
        rows.append((k, " ".join(w), None, None, None))
    rows += [(100 + k, " ".join(base[:60] + [f"end{k}-{j}" for j in range(8 + k)]), None, None, None) for k in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, rows)).collect()}
    assert got == components(rows)


def test_ngram_components_count_every_fragment(spark, monkeypatch):
    """Partial overlaps of all fragments make up the overlap: without one of them links are lost."""
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(w if j != 20 + k * 9 else f"x{k}" for j, w in enumerate(base)), None, None, None) for k in range(12)]
    docs = frame(spark, rows)
    assert {r.component_id for r in ngram_join.ngram_components(docs).collect()} == {0}
    posexplode = F.posexplode
    monkeypatch.setattr(ngram_join.F, "posexplode", lambda c: posexplode(F.slice(c, 1, 7)))
    assert len({r.component_id for r in ngram_join.ngram_components(docs).collect()}) > 3


def test_ngram_components_of_rows_that_share_an_id_or_have_none(spark):
    one, two = (" ".join(f"{n}{k}" for k in range(80)) for n in ("a", "b"))
    rows = [(5, one), (5, two), (9, one + " more"), (8, two + " more"), (None, one), (None, "no one has this text but me")]
    got = Counter(tuple(r) for r in ngram_join.ngram_components(frame(spark, [(*r, None, None, None) for r in rows])).collect())
    assert got == Counter([(5, 76, 5), (5, 76, 5), (9, 77, 5), (8, 77, 5), (None, 76, 5), (None, 3, None)])


def test_ngram_components_of_nothing_and_repeated_rows(spark):
    assert ngram_join.ngram_components(empty(spark)).count() == 0
    rows = [(4, "a b c d e f g", None, None, None), (4, "a b c d e f g", None, None, None), (2, "A  b c d e f g", None, None, None), (9, None, None, None, None)]
    got = sorted(tuple(r) for r in ngram_join.ngram_components(frame(spark, rows)).collect())
    assert got == [(2, 3, 2), (4, 3, 2), (4, 3, 2), (9, 0, 9)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in C.components(edges, Scratch(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize(("window", "block", "cut", "hot_rows"), [(50, 200_000, 10_000, 256), (8, 300, 20, 256), (50, 400, 30, 1)])
def test_substring_dedup(spark, monkeypatch, window, block, cut, hot_rows):
    """Also with shards that must be dealt again, segments that must be cut, and hot keys."""
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", block)
    monkeypatch.setattr(substring_dedup, "CUT", cut)
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    rows = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(frame(spark, rows), window).collect()}
    want = kept_words(rows, window)
    assert got == want
    assert sum(w[1] for w in want.values()) > 0


def test_substring_dedup_of_one_passage_in_all_documents(spark, monkeypatch):
    """One shard holds nearly all text: it is dealt again by windows."""
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 2000)
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{' '.join(f'a{k}-{j}' for j in range(k % 30))} {passage} {' '.join(f'b{k // 2}-{j}' for j in range(55))}", None, None, None) for k in range(150)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert got == kept_words(rows, 50)


def test_substring_dedup_of_rows_that_share_an_id(spark):
    """Each row is cut by its own spans alone; null ids are left alone."""
    shared, own = ([f"{n}{k}" for k in range(120)] for n in ("s", "u"))
    rows = [(1, " ".join(shared)), (7, " ".join(shared[:100])), (7, " ".join(own)), (7, " ".join(shared[:100])), (None, " ".join(shared)), (None, " ".join(own))]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(frame(spark, [(*r, None, None, None) for r in rows])).collect())
    assert got == Counter([(1, 120, 0), (7, 100, 100), (7, 120, 0), (7, 100, 100), (None, 120, 0), (None, 120, 0)])


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_suffix_automaton_against_brute_force():
    texts = [(3, [1, 2, 3, 1, 2, 4]), (1, [2, 3, 1, 2]), (7, [1, 2, 3, 1, 2, 3, 1, 2])]
    automaton = substring_dedup.SuffixAutomaton()
    for owner, t in texts:
        automaton.add(t, owner)
    automaton.close()
    for _, t in [*texts, (0, [9, 1, 2, 3, 9, 2, 3, 1])]:
        want = [min((o for o, x in texts if any(x[j:j + 3] == t[i:i + 3] for j in range(len(x) - 2))), default=substring_dedup.NONE) for i in range(len(t) - 2)]
        assert automaton.owners(t, 3) == want


def plain_lines(rows, least):
    """[(doc_id, text, lines removed)] by looking at all lines."""
    sites, first = {}, {}
    for d, t, _, s, _ in rows:
        for p, line in enumerate((t or "").split("\n")):
            if line.strip():
                sites.setdefault(line.strip(), set()).add(s)
                first.setdefault(line.strip(), []).append((d, t, p))
    out = []
    for d, t, *_ in rows:
        own = (t or "").split("\n")
        gone = [p for p, x in enumerate(own) if x.strip() and len(sites[x.strip()]) >= least and min(f[0] for f in first[x.strip()]) != d]
        gone += [p for p, x in enumerate(own) if x.strip() and len(sites[x.strip()]) >= least and min(f[0] for f in first[x.strip()]) == d and min(f[2] for f in first[x.strip()] if f[:2] == (d, t)) != p]
        out.append((d, None if t is None else "\n".join(x for p, x in enumerate(own) if p not in gone), len(gone)))
    return Counter(out)


@pytest.mark.parametrize("hot_rows", [256, 1])
def test_line_dedup(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    lines = ["common one", "  common one ", "rare", "", "twice", "common two"]
    rows = [(k, "\n".join([lines[k % 2], f"own {k}", "", lines[2] if k < 3 else "x" + str(k), "common two", "common two"]), None, f"s{k % 4}" if k % 5 else None, None) for k in range(20)]
    rows += [(90, None, None, "s1", None), (91, "", None, "s1", None)]
    got = line_dedup.line_dedup(frame(spark, rows), 4)
    want = plain_lines(rows, 4)
    assert Counter((r.doc_id, r.text, r.n_lines_removed) for r in got.collect()) == want
    assert sum(n for *_, n in want) > 20
    assert line_dedup.line_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("near", [1.0, 0.0])
def test_line_dedup_counts_near_the_threshold_exactly(spark, monkeypatch, near):
    """Sketches decide far from the threshold, exact counts near it: a sketch that is wrong by a little or a lot shows."""
    rows = [(100 * n + k, f"on {n} sites\nown {n} {k}", None, f"s{k}", None) for n in (5, 7, 8, 9, 40) for k in range(n)]
    rows += [(9000 + k, "on one site", None, "s0", None) for k in range(30)]
    spread = line_dedup.site_spread
    monkeypatch.setattr(line_dedup, "site_spread", lambda lines: spread(lines).withColumn("sites", F.col("sites") + near if near else F.lit(2.0)))
    got = Counter((r.doc_id, r.text, r.n_lines_removed) for r in line_dedup.line_dedup(frame(spark, rows)).collect())
    assert (got == plain_lines(rows, 8)) == (near == 1.0)


def test_line_dedup_of_repeated_ids_and_clashing_columns(spark):
    """Rows that share an id are cut by their own positions, and no input column gets in the way."""
    rows = [(k, "shared by all\nunique to " + str(k), None, f"s{k}", None) for k in range(10)]
    rows += [(5, "first of five\nsecond\nshared by all", None, "s5", None), (None, "shared by all", None, "s1", None), (None, "a text without an id", None, "s1", None)]
    df = frame(spark, rows)
    for name in ("_drop", "drop", "n_lines_removed", "row", "doc", "pos", "h1", "salt", "_hot"):
        df = df.withColumn(name, F.lit(name))
    out = line_dedup.line_dedup(df)
    assert sorted(out.columns) == sorted(df.columns) and dict(out.dtypes)["n_lines_removed"] == "bigint"
    got = Counter((r.doc_id, r.text, r.n_lines_removed, r.drop) for r in out.collect())
    want = Counter((d, t if d is None else t.replace("shared by all\n", "").replace("\nshared by all", ""), int(d is not None), "drop") for d, t, *_ in rows)
    assert got == want


def test_sharding(spark):
    rows = corpus()
    rows += [rows[3], rows[9]]
    got = [tuple(r) for r in sharding.shard(frame(spark, rows), 8).collect()]
    assert Counter(g[:3] for g in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = by_group(got, lambda g: g[3])
    assert all(sorted(x[4] for x in g) == list(range(len(g))) for g in slots.values())
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shard(empty(spark), 8).count() == 0
    more = {g[0]: g[3] for g in (tuple(r) for r in sharding.shard(frame(spark, rows), 9).collect())}
    moved = sum(more[g[0]] != g[3] for g in got)
    assert moved < len(got) * 0.6  # a plain modulo would move eight ninths


def plain_ring(keys, shards, vnodes=64):
    """{key: shard}, key by key: a key goes clockwise from its cell to the first point whose shard has room.

    Keys arrive point by point and, at a point, after those that were passed on to it.
    """
    points = sorted((zlib.crc32(f"shard {s} point {v}".encode()) % sharding.CELLS, s) for s in range(shards) for v in range(vnodes))
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    cell = {k: xxhash.xxh64_intdigest(str(k).encode(), 42) % sharding.CELLS for k in keys}
    home = {k: next((p for p, (at, _) in enumerate(points) if at >= cell[k]), 0) for k in keys}
    order = lambda k: (cell[k], xxhash.xxh64_intdigest(str(k).encode(), 42) ^ (1 << 63))  # noqa: E731  by signed hash
    out, waiting = {}, []
    for p in [*range(len(points)), *range(len(points))]:
        waiting += sorted((k for k in keys if home[k] == p and k not in out and k not in waiting), key=order)
        shard = points[p][1]
        while waiting and room[shard]:
            out[waiting.pop(0)] = shard
            room[shard] -= 1
    return out


@pytest.mark.parametrize("shards", [2, 8, 9])
def test_sharding_against_a_walk_key_by_key(spark, shards):
    keys = [k * 7 for k in range(500)]
    got = {r.doc_id: r.shard for r in sharding.shard(frame(spark, [(k, "t", None, None, None) for k in keys]), shards).collect()}
    assert got == plain_ring(keys, shards)


def test_ring_walk_goes_clockwise_past_full_shards():
    assert sorted(sharding.walk({5: 4, 20: 1}, [2, 3], [(10, 0), (30, 1)])) == [(5, 0, 0, 0), (5, 2, 1, 0), (20, 0, 1, 2)]
    assert sorted(sharding.walk({5: 2, 40: 3}, [2, 3], [(10, 0), (30, 1)])) == [(5, 0, 0, 0), (40, 0, 1, 0)]
