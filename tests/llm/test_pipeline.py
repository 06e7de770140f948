"""The pipeline: its stages' columns, order and decisions, nulls, and the components behind the groups."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from swathkit.llm import common
from swathkit.llm.components import connected_components


def test_stages_on_the_table(spark, data):
    docs = common.table(spark, data, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, data))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_id"] for r in last} == set(texts)
    for r in last:
        assert r["decoded"] == (texts[r["doc_id"]] or "") and r["ids"] == library.encode(r["decoded"], add_special_tokens=False).ids


def test_empty_and_null_documents(spark, data):
    docs = common.table(spark, data, "documents")
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0)], docs.schema)
    for frame in (odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = common.materialize(stage(spark, frame, data))
        assert frame.count() in (0, 2)


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 50)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {i for e in edges if e[0] != e[1] for i in e}
    assert got == {i: find(i) for i in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
