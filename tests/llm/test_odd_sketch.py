import random
import re

import numpy as np
import pytest
from tickforge.llm import components, odd_sketch
from texts import prose, word


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)])


def brute(rows, n, percent=80):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and rows[i][0] is not None and rows[j][0] is not None and 100 * len(x & y) >= percent * len(x | y):
                up[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted((doc, len(s), least.get(top(i)) if doc is not None else None) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)) if doc is not None)


def corpus():
    r = random.Random(3)
    texts = [None, "", "  \n", "one", "ONE", "one two", "a b c d e", "a b c d f"]
    for size in (9, 30, 120, 400):
        for _ in range(6):
            base = prose(r, size).split(" ")
            texts.append(" ".join(base))
            for _ in range(r.randint(0, 6)):  # chains of edits drift apart
                for _ in range(max(1, len(base) // 25)):
                    base[r.randrange(len(base))] = word(r)
                texts.append(" ".join(base))
    hub = prose(r, 200)
    texts += [hub] * 40 + [hub.upper()]
    ids = r.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("n", [2, 5])
def test_components_as_brute_force(spark, n):
    rows = corpus()
    given = spark.createDataFrame([(f"x{i}", d, t, 1, "kept") for i, (d, t) in enumerate(rows)], "component_id string, doc_id long, text string, a int, h string").repartition(5)
    got = odd_sketch.near_duplicates(given, n=n).collect()
    assert sorted((g.doc_id, g.n_shingles, g.component_id) for g in got) == brute(rows, n)
    assert all(g.kept == (g.doc_id == g.component_id) for g in got)


def test_buckets_with_several_components(spark, monkeypatch):
    """Links that no leader has, in blocks smaller than a bucket."""
    monkeypatch.setattr(odd_sketch, "BLOCK", 3)
    monkeypatch.setattr(odd_sketch, "MINOR_BLOCK", 4)
    r = random.Random(9)
    base = [word(r) for _ in range(300)]
    rows = []
    for k in range(30):  # 30 versions, each near the next one only
        base[k * 9 : k * 9 + 9] = [word(r) for _ in range(9)]
        rows.append((100 - k, " ".join(base)))
    got = odd_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect()
    assert sorted((g.doc_id, g.n_shingles, g.component_id) for g in got) == brute(rows, 2)


def test_large_buckets_of_a_leader_travel_once(spark, monkeypatch):
    """Near copies that meet in most bands: rows travel as for one search of all, not for one a band."""
    monkeypatch.setattr(odd_sketch, "BLOCK", 16)
    monkeypatch.setattr(odd_sketch, "MINOR_BLOCK", 16)
    r = random.Random(4)
    base = [word(r) for _ in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(160):  # 2 to 16 other words: the last ones are near no other copy
        copy = base[:]
        for i in r.sample(range(120), 2 + k * 15 // 160):
            copy[i] = word(r)
        rows.append((k + 1, " ".join(copy)))
    travelled, between = [], odd_sketch._between

    def spy(members, *rest):
        travelled.append(members.selectExpr("sum(IF(minor, columns, 0) + rows) AS n").first().n)
        return between(members, *rest)

    monkeypatch.setattr(odd_sketch, "_between", spy)
    got = odd_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect()
    assert sorted((g.doc_id, g.n_shingles, g.component_id) for g in got) == brute(rows, 2)
    assert 0 < travelled[0] < 2 * 161 * 11  # 161 rows by 11 blocks, both ways; 5306 for one bucket after the other


def test_odd_rows(spark):
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, "A B C"), (None, None), (7, None)]
    got = odd_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect()
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((g.doc_id, g.component_id, g.kept) for g in got), key=key) == sorted([(None, None, True), (5, 3, False), (5, 3, False), (3, 3, True), (None, None, True), (7, 7, True)], key=key)
    text = " ".join(f"w{i}" for i in range(200))
    twice = [(9, None), (9, text), (9, "other words"), (4, text + " more"), (11, text + " and more")]
    got = odd_sketch.near_duplicates(spark.createDataFrame(twice, "doc_id long, text string"), n=2).collect()
    assert sorted((g.doc_id, g.component_id) for g in got if g.n_shingles > 1) == [(4, 4), (9, 4), (11, 4)] and len(got) == 5
    assert odd_sketch.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_estimates_high_similarity():
    r = np.random.default_rng(0)
    for same in (0.95, 0.9, 0.8):
        errors = []
        for _ in range(60):
            x = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
            y = np.concatenate((x[: round(2000 * 2 * same / (1 + same))], r.integers(0, 1 << 63, 2000 - round(2000 * 2 * same / (1 + same)), dtype=np.uint64)))
            a, b = odd_sketch.odd_sketches(odd_sketch.min_hashes([np.unique(x), np.unique(y)]))
            bits = int(np.bitwise_count(a ^ b).sum())
            assert bits <= odd_sketch.MAX_ODD
            errors.append(odd_sketch.similarity_of(bits) - same)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (201, 200), (300, 300), (None, 4), (500, 499), (500, 498)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 0, 201: 200, 499: 498, 500: 498}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
