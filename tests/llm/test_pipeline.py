from pyspark.sql import functions as F

import corpus_pipeline
from seqlake.llm import line_dedup, mixing, registry
from tests.llm.helpers import components, corpus, frame, words


def test_stages_keep_columns_and_take_effect(spark):
    rows = [(d, t, "en" if t and d % 2 else "fr" if t else None, s or "s9", len(t or "")) for d, t, _, s, _ in corpus()]
    docs = frame(spark, rows)
    texts = {d: t for d, t, *_ in rows}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "line_dedup", "ngram_join", "mixing", "sentencepiece"]

    named = steps["language_id"](spark, docs, "")
    assert named.columns == corpus_pipeline.COLUMNS
    left = {r.doc_id for r in named.collect()}
    assert all(any(c.isalpha() for c in texts[d] or "") for d in left)
    assert len(left) >= 0.9 * sum(bool(words(t)) for t in texts.values())

    lines = steps["line_dedup"](spark, docs, "")
    assert lines.columns == corpus_pipeline.COLUMNS
    plain = line_dedup.line_dedup(docs.select(*corpus_pipeline.COLUMNS)).count()
    assert lines.count() <= plain

    kept = {r.doc_id for r in steps["ngram_join"](spark, docs, "").collect()}
    assert kept == {d for d, (_, c) in components(rows).items() if c == d}

    drawn = steps["mixing"](spark, docs, "").collect()
    assert {r.doc_id for r in drawn} <= set(texts) and all(r.text == texts[r.doc_id] for r in drawn)

    tokens = steps["sentencepiece"](spark, docs, "").collect()
    assert {r.doc_id for r in tokens} == set(texts)


def test_stages_on_odd_tables(spark):
    """No rows; rows without an id; columns that clash with inner ones."""
    rows = [(d, t, "en" if t and (d or 0) % 2 else "fr" if t else None, s or "s9", len(t or "")) for d, t, _, s, _ in corpus(n=30)]
    own = " ".join(f"word{k}" for k in range(40))
    rows += [(None, own, "en", "s1", 3), (None, own + " again", "fr", None, 3), (None, None, None, None, None)]
    clash = frame(spark, rows)
    for name in ("drop", "row", "salt", "draws", "places", "shard", "place", "copy", "drawn_id", "n_lines_removed", "lang_pred", "ids", "_hot"):
        clash = clash.withColumn(name, F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, clash.where("false"), "")
        assert none.count() == 0
        out = stage(spark, clash, "")
        assert none.dtypes == out.dtypes
        got = out.collect()
        missing = [r for r in got if r.doc_id is None]
        assert len(missing) >= (2 if name != "mixing" else 1), name
        if name != "sentencepiece":
            assert out.columns == corpus_pipeline.COLUMNS
            assert {r.text for r in missing} <= {own, own + " again", None}


def test_mixing_stage_writes_in_the_order_of_shards_and_places(spark):
    docs = frame(spark, corpus(n=200)).select(*corpus_pipeline.COLUMNS)
    each = mixing.place(mixing.mix(docs))
    want = [r.doc_id for r in sorted(each.collect(), key=lambda r: (r.shard, r.place, r.doc_id, r.copy))]
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "").collect()] == want


def test_run_and_registry(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.where("n_tokens > 0").count() > 50
    assert sorted(registry.QUERIES, key=lambda q: int(q[2:].split("_")[0])) == [q for q in registry.QUERIES]
    assert len(registry.QUERIES) == 13
