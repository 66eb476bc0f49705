"""The pipeline's stages, each against its operator's brute-force rules."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
from termforge.llm import mixing, ngramjoin, quality, queries, toxicity


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    (_, toxic), (_, good), (_, once), (_, mixed), (_, coded) = corpus_pipeline.STAGES
    one = toxic(spark, docs, sf_dir).cache()
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, s in scores.items() if s < 0.5)
    two = good(spark, one, sf_dir).cache()
    assert sorted(r.doc_id for r in two.collect()) == sorted(r.doc_id for r in quality.judge_documents(one).where("kept").collect())
    three = once(spark, two, sf_dir).cache()
    assert sorted(r.doc_id for r in three.collect()) == sorted({r.class_id for r in ngramjoin.link_documents(two).collect()})
    four = mixed(spark, three, sf_dir).cache()
    planned = Counter({r.doc_id: r.copies for r in mixing.plan_copies(three).collect()})
    assert Counter(r.doc_id for r in four.collect()) == +planned
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    five = coded(spark, four, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert Counter(r.doc_id for r in five) == +planned
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in five)


def test_run_keeps_only_what_its_result_reads(spark, sf_dir):
    from termforge.llm import common

    before = common.written()
    out = corpus_pipeline.run(spark, sf_dir.replace("sf0.01", "sf0.001"))
    assert common.written() <= before + 1 + len(corpus_pipeline.STAGES) and out.count() > 0
    common.release(spark, before)


def test_stages_on_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, score double, rid long, counts string, key string, __own int"
    text = " ".join(f"wort{i}" for i in range(40))
    rows = [(i, f"{text} own{i}{'x' * (i % 7)} tail{i * i}", "en", "a" if i % 3 else None, 1, 2, 3.0, 4, "c", "k", 5) for i in range(12)]
    rows += [(None, f"{text} none", None, None, None, None, None, None, None, None, None)] * 2 + [(3, None, "en", "a", *[None] * 7), (4, "", "en", "b", *[None] * 7)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs, n = table, table.count()
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf_dir)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == table.columns, name
        assert n or docs.count() == 0


def test_registered_names():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
