import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tickforge.llm import queries, quality_fm
from texts import prose


def rows(n=900):
    r = random.Random(6)
    docs, labels = [], []
    for doc in range(n):
        text, good = prose(r, r.randint(20, 120)), doc % 4 != 0
        if not good:
            text = " ".join(w + "%%%" for w in text.split()) if doc % 8 else " | ".join(text.split())
        docs.append((doc, text, "en", "s", len(text)))
        if doc % 5:
            labels.append((doc, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_splits(spark, tmp_path):
    docs, labels = rows()
    docs += [(5000, None, "en", "s", None), (5001, "", None, None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    # labels of held-out rows are turned round: learning from them would show
    turned = [(d, q if zlib.crc32(str(d).encode()) % 3 != 1 else 1 - q, t) for d, q, t in labels] + [(None, 1, 0), (3, None, 0)]
    spark.createDataFrame(turned, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in queries.op10_quality_fm(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    held = [r for d, r in got.items() if d < 5000 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_sum_of_squares_identity():
    r = np.random.default_rng(3)
    width = quality_fm.BUCKETS + quality_fm.STATISTICS
    m = quality_fm.Machine(0.3, r.normal(size=width), r.normal(size=(width, quality_fm.FACTORS)), np.zeros(quality_fm.STATISTICS), np.ones(quality_fm.STATISTICS))
    j, x, z = np.array([5, 9, 70]), np.array([0.5, 2.0, -1.0]), r.normal(size=(1, quality_fm.STATISTICS))
    got = m.raw(j, x, np.array([0, 3]), z)[0][0]
    at, v = np.concatenate((j, quality_fm.BUCKETS + np.arange(quality_fm.STATISTICS))), np.concatenate((x, z[0]))
    pairs = sum(m.factors[at[a]] @ m.factors[at[b]] * v[a] * v[b] for a in range(len(at)) for b in range(a))
    assert np.isclose(got, 0.3 + m.weights[at] @ v + pairs)


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 0.1), (1, "a b", "x", 0.1), (None, None, None, None)], "doc_id long, text string, quality string, score double")
    for labels in ([], [(1, 1)], [(1, None)]):
        model = quality_fm.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = quality_fm.classify(docs, model).collect()
        assert len(got) == 3 and all(0 <= r.score <= 1 for r in got) and got[0].quality in ("x", None)
        assert quality_fm.classify(docs.where("doc_id > 9"), model).count() == 0
    clash = docs.withColumns({c: F.lit(1) for c in ("__text", "__chars", "c0", "y", "label_id", "x")})
    assert quality_fm.classify(clash, model).columns == [*(c for c in clash.columns if c != "score"), "score"]
    assert quality_fm.classify(clash, quality_fm.fit(clash, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))).count() == 3
    j, x, begin, stats = quality_fm.features(pa.array(["", None, "w " * 200_000]), pa.array([0.0, None, 4e5]))
    assert begin.tolist() == [0, 0, 0, 1] and np.isfinite(stats).all()


def test_a_repeated_document_is_one_row_of_the_fit(spark, monkeypatch):
    docs, labels = rows(60)
    many = spark.createDataFrame([(d, t, n) for d, t, _, _, n in docs] + [(0, f"copy {k}", 6) for k in range(500)], "doc_id long, text string, n_chars long").repartition(4)
    seen = []
    monkeypatch.setattr(quality_fm, "train", lambda given, stats, y: seen.append(len(y)))
    quality_fm.fit(many, spark.createDataFrame([(d, q) for d, q, _ in labels] + [(0, 1), (0, 0)], "doc_id long, quality int"))
    assert seen[0] <= 60
