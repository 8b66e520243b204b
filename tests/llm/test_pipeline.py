import random
from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline
from larkspur.llm import mixing, ngram_join, pieces
from larkspur.llm import textbytes as tb

SF = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    (_, good), (_, exact), (_, near), (_, mixed), (_, encoded) = corpus_pipeline.STAGES
    one = good(spark, docs, str(SF)).cache()
    assert one.columns == docs.columns
    kept = {x.doc_id for x in one.collect()}
    assert sum(labels[i] == 1 and i not in kept for i in labels) <= 0.01 * len(labels) and sum(labels[i] == 0 and i in kept for i in labels) <= 0.02 * len(labels)

    two = exact(spark, one, str(SF)).cache()
    texts = {}
    for x in one.collect():
        texts[x.text] = max(x.doc_id, texts.get(x.text, -1))
    assert {x.doc_id for x in two.collect()} == set(texts.values()) and two.columns == docs.columns

    three = near(spark, two, str(SF)).cache()
    rows = {x.doc_id: x.text for x in two.collect()}
    sets = {i: set(t.split()) and {tuple(w[k : k + 5]) for w in [[c for c in t.lower().split()]] for k in range(max(1, len(w) - 4))} for i, t in rows.items()}
    by, up = {}, {i: i for i in rows}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = {p for ids in by.values() if len(ids) < 200 for a in ids for b in ids if a < b for p in [(a, b)]}
    for a, b in seen:
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    assert {x.doc_id for x in three.collect()} == {i for i in rows if top(i) == i}

    four = mixed(spark, three, str(SF)).cache()
    assert 0 < four.count() < three.count() and four.columns == docs.columns
    five = encoded(spark, four, str(SF)).collect()
    v = pieces.vocabulary(pieces.MODEL)
    whole = {x.doc_id: x.text for x in four.collect()}
    assert len(five) == len(whole) and all(x.round_trip and x.ids == v.whole.encode(whole[x.doc_id]) for x in five)


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.mode("overwrite").parquet(f"file://{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f"file://{tmp_path}").count() == 0, name
    assert ngram_join.ngram_components(docs).count() == 0


def test_mixing_stage_learns_from_every_text(spark):
    """What the stage keeps follows from topics that were learned in memory from all of its texts."""
    r = random.Random(5)
    groups = [[f"{g}{k}" for k in range(300)] for g in "abcdefghijkl"]
    texts = [" ".join(r.choice(groups[min(11, int(r.expovariate(0.5)))]) for _ in range(6)) + " the" * r.randrange(9) for _ in range(9000)]
    topics, _ = mixing.learn_topics([mixing._slots(h) for h in tb.each_words(pa.array(texts))]).assign(pa.array(texts))
    docs = spark.createDataFrame([(i, t, ["en", "de"][i % 3 % 2], f"s{i % 4}", topics[i]) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, topic string")
    stage = dict(corpus_pipeline.STAGES)["mixing"]
    got = {x.doc_id for x in stage(spark, docs.drop("topic"), "").collect()}
    targets = mixing.MixTargets(temper={"source": 0.5, "lang": 0.7, "topic": 0.8}, keep_share=0.8)
    assert got == {x.doc_id for x in mixing.mix(docs, targets, topic_col="topic").where("__kept").collect()}


def test_quality_stage_learns_from_every_label(spark, tmp_path):
    """What a single labelled document shows takes effect, however many labels there are."""
    docs = spark.createDataFrame([(i, f"a{i} b{i}", "en", "s", 0) for i in range(15_000)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "0 as toxic").write.parquet(f"file://{tmp_path}/labels.parquet")
    kept = {x.doc_id for x in dict(corpus_pipeline.STAGES)["quality"](spark, docs, f"file://{tmp_path}").collect()}
    assert sum((i in kept) == i % 2 for i in range(15_000)) > 0.97 * 15_000
