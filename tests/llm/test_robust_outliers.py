import random
import re

import numpy as np
import pytest
from tickforge.llm import robust_outliers
from texts import prose

SCHEMA = "doc_id long, text string, lang string, source string, kept string, g_lang string"


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places, covered = {}, set()
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in places.values():
        if len(at) > 1:
            covered.update(k for i in at for k in range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def rows():
    r = random.Random(12)
    out = [None, "", " \t\n", "a", "  b", "x " * 30_000, "one two three four five six seven eight " * 5, "A line.\n\nA line.\nA line.\r\n", "🙂 é # $ <b> &amp; |" * 3]
    for i in range(330):
        text = prose(r, int(np.exp(r.gauss(4.5, 0.7))) + 20)
        if i % 30 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        if i % 31 == 0:
            text += " " + " ".join(text.split()[:12])
        out.append(text)
    return [(i, t, "en" if i % 3 else "de" if i % 2 else None, "big" if i % 4 else f"s{i % 7}", "k", "g") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def judged(spark):
    return {r.doc_id: r for r in robust_outliers.judge(spark.createDataFrame(rows(), SCHEMA).repartition(3)).collect()}


def test_counts_as_brute_force(judged):
    for doc, text, *_ in rows():
        r = judged[doc]
        want = counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def plain(x):
    """The estimate of one group in numpy; quantiles as the sketch gives them for few rows."""
    floors = np.array([f for _, f in robust_outliers.VECTOR.values()])
    pick = lambda v, q: np.sort(v)[max(int(np.ceil(q * len(v))) - 1, 0)]
    mean = np.array([pick(c, 0.5) for c in x.T])
    cov = np.diag(floors**2) + np.diag([(1.4826 * pick(abs(c - m), 0.5)) ** 2 for c, m in zip(x.T, mean, strict=True)])
    distance = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    fit = lambda inner: (inner.mean(axis=0), np.cov(inner.T, bias=True) + np.diag(floors**2))
    size = lambda e: np.log(np.linalg.det(e[1]))
    gap = (abs(x - mean) / np.sqrt(np.diag(cov))).sum(axis=1)

    def step(e):
        d = distance(*e)
        return fit(x[d <= pick(d, robust_outliers.COVERAGE)])

    ends = []
    for e in ((mean, cov), fit(x), fit(x[gap <= pick(gap, 0.5)])):
        for _ in range(robust_outliers.FIRST_STEPS):
            e = step(e)
        ends.append(e)
    best = min(ends, key=size)
    while True:
        then = step(best)
        fall = size(best) - size(then)
        best = then if fall > 0 else best
        if fall <= 2 * robust_outliers.TOLERANCE:
            break
    d = distance(*best)
    return d / max(pick(d, 0.5) / robust_outliers.chi_square_quantile(0.5, x.shape[1]), 1)


def test_distances_as_numpy(judged):
    groups = {}
    for doc, _, lang, source, *_ in rows():
        if not judged[doc].base_failed:
            groups.setdefault((lang, source), []).append(doc)
    pools = {}
    for (lang, source), docs in groups.items():
        pools.setdefault((lang, source if len(docs) >= robust_outliers.LEAST_ROWS else "*"), []).extend(docs)
    last = {}
    for (lang, source), docs in pools.items():
        last.setdefault((lang if len(docs) >= robust_outliers.LEAST_ROWS else "*", source), []).extend(docs)
    tried = 0
    for docs in last.values():
        if len(docs) < robust_outliers.LEAST_ROWS:
            assert all(judged[d].distance2 is None and judged[d].kept for d in docs)
            continue
        n, chars, symbols, lines, repeats = np.array([counts(dict((r[0], r[1]) for r in rows())[d]) for d in docs], float).T
        x = np.stack([np.log1p(n), np.log(chars / n + 0.5), np.log1p(100 * symbols / n), np.log1p(lines), np.log1p(100 * repeats / n)], axis=1)
        assert np.allclose(plain(x), [judged[d].distance2 for d in docs], rtol=1e-6)
        tried += len(docs)
    assert tried > 200


def test_junk_is_rejected_and_prose_is_not(judged):
    for doc, text, *_ in rows()[9:]:
        r = judged[doc]
        if not r.base_failed:
            assert r.kept == ("%%%" not in text)


def test_shuffled_groups_give_the_same(spark, judged, monkeypatch):
    monkeypatch.setattr(robust_outliers, "MAX_BROADCAST_GROUPS", 0)
    got = robust_outliers.judge(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == sorted((d, r.kept) for d, r in judged.items())


def test_empty_and_repeated(spark):
    assert robust_outliers.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = [(1, "a b", None, None, "", ""), (1, "a b", None, None, "", ""), (None, None, "x", "y", "", "")]
    assert [r.kept for r in robust_outliers.judge(spark.createDataFrame(twice, SCHEMA)).collect()] == [False] * 3


def test_the_least_determinant_of_the_starts_is_kept(spark):
    """A fifth of the rows lies apart, and spreads the covariance of all rows: no such start may win."""
    r = np.random.default_rng(4)
    names = list(robust_outliers.VECTOR)
    x = r.normal(0, 1, (400, len(names)))
    x[:80] = x[:80] * 0.2 + 9
    data = [("=en", "=s", *map(float, v)) for v in x]
    rows = spark.createDataFrame(data, ", ".join(["g_lang string", "g_source string", *(f"{n} double" for n in names)]))
    (found,) = robust_outliers.estimates(rows).collect()
    assert max(abs(found[f"m_{i}"]) for i in range(len(names))) < 0.3
    factor = np.array([[found[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(len(names))] for i in range(len(names))])
    assert (np.linalg.norm(np.linalg.solve(factor, (x[:80] - [found[f"m_{i}"] for i in range(len(names))]).T), axis=0) ** 2 / found.scale > robust_outliers.chi_square_quantile(1 - robust_outliers.TAIL, len(names))).all()
