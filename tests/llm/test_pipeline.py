import random

import corpus_pipeline
import numpy as np
import pytest
from texts import prose, word
from tickforge.llm import bpe_words, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Clean documents, junk, near copies, documents with a shared passage, and leaks."""
    r = random.Random(21)
    path = tmp_path_factory.mktemp("corpus")
    docs = {i: prose(r, r.randint(60, 200)) for i in range(300)}
    junk = {i: " ".join(w + "%%%" for w in prose(r, 120).split()) for i in range(300, 400)}
    near = {}
    for i in range(400, 430):
        words = docs[i - 400].split(" ")
        words[len(words) // 2] = word(r)
        near[i] = " ".join(words)
    passage, items = prose(r, 70), [prose(r, 40) for _ in range(10)]
    shared = {i: f"{prose(r, 90)} {passage} {prose(r, 90)}" for i in range(500, 510)}
    leaks = {600 + k: f"{prose(r, 90)} {item} {prose(r, 90)}" for k, item in enumerate(items)}
    every = docs | junk | near | shared | leaks
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in every.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    labels = [(i, 1, 0) for i in docs] + [(i, 0, 0) for i in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), every, passage


def test_run(spark, made):
    path, every, passage = made
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == {*range(300), *range(500, 510)}
    import public_tokenizers

    table = {v: k for k, v in bpe_words.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")).items()}
    text = {i: b"".join(table[k] for k in np.frombuffer(r.ids, "<u4").tolist()).decode() for i, r in got.items()}
    assert all(text[i] == every[i] for i in (*range(300), 500))
    for i in range(501, 510):
        left = every[i].split(passage)
        assert passage not in text[i] and text[i].startswith(left[0].strip()[:-1]) and len(text[i]) >= len(left[0]) + len(left[1]) - 2


def test_stages_keep_the_columns_and_odd_rows(spark, made):
    path, _, _ = made
    odd = [(None, None, None, None, None), (None, "some words of no number", "en", "s", 4), (1, None, "en", "s", None), (2, "", None, None, 0), (2, "", None, None, 0)]
    docs = spark.createDataFrame(odd, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        assert out.count() == len(odd), name
    for stage in (corpus_pipeline.quality, corpus_pipeline.tokenize):
        assert stage(spark, docs, path).count() <= len(odd)
        assert stage(spark, docs.where("doc_id > 9"), path).count() == 0
    assert corpus_pipeline.tokenize(spark, docs, path).count() == len(odd)


def test_every_operator_has_a_query():
    names = list(queries.QUERIES)
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and set(queries.ORACLE_SQL) <= set(names)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_queries_as_their_sql(spark, name):
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_stages_keep_columns_that_clash_with_their_own(spark, made, monkeypatch):
    path, every, _ = made
    names = ["score", "removed", "removed_", "component_id", "kept", "h", "c0", "a", "b", "id", "sig", "__doc", "__doc_text", "__salt", "rows", "n_tokens", "item_id"]
    rows = [(i, every[i], "en", "s", len(every[i]), *(f"{n} {i}" for n in names)) for i in [*range(40), 400, 500, 501, 600]]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} string" for n in names)).repartition(2)
    for limit in (corpus_pipeline.MAX_BROADCAST, 0):
        monkeypatch.setattr(corpus_pipeline, "MAX_BROADCAST", limit)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert out.columns == docs.columns and out.schema == docs.schema, name
            assert all(r[n] == f"{n} {r.doc_id}" for r in out.collect() for n in names), name
    assert corpus_pipeline.tokenize(spark, docs, path).count() == len(rows)
