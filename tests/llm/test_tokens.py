import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from tickforge.llm import bpe_words, queries, repair_store, token_counts
from tokenizers import Tokenizer

SCHEMA = "lang string, doc_id long, text string, ids string, start long, decoded string"


def odd_texts() -> list:
    r = random.Random(5)
    parts = ["the", "Été", " ", "  ", "   ", "\n", "\t", " ", "x'''s", "can't", "12345", "!!", "▁", "▁ ", " ▁", "日本語", "🙂", "<|endoftext|>", "<s>", "a" * 300, "\r\n", "fin."]
    long = " ".join(r.choice(["word", "plural", "naïve", "x\n", "(1)", "", "▁a"]) for _ in range(60_000))
    return [None, "", " ", "one", "same text twice", "same text twice", long, *("".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(200))]


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts()
    rows = [("en", 1000 - i if i % 7 else i, t, "x", 1, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_bpe_words_as_tiktoken(docs):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe_words.decode(bpe_words.encode(docs, path, P.PATTERN), path).collect()
    want = sorted((r.doc_id, np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect())
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want


def test_decoding_without_a_broadcast_and_odd_columns(docs, spark, monkeypatch):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = [(k, x, {"a": k}, "old", k) for k, x in enumerate([[5, 9, 5], [], None, [300, 40_000] * 5000])]
    coded = spark.createDataFrame(rows, "row long, token_ids array<int>, id map<string,int>, decoded string, tokens long").repartition(2)
    token = {v: k for k, v in bpe_words.read_ranks(path).items()}
    want = {r[0]: None if r[1] is None else b"".join(token[i] for i in r[1]) for r in rows}
    for size in (bpe_words.MAX_TABLE, 0):
        monkeypatch.setattr(bpe_words, "MAX_TABLE", size)
        got = bpe_words.decode(coded, path)
        assert got.columns == ["row", "token_ids", "id", "tokens", "decoded"]
        assert {r.row: r.decoded if r.decoded is None else bytes(r.decoded) for r in got.collect()} == want
        assert ("strategy=broadcast" in got._jdf.queryExecution().optimizedPlan().toString()) == (size > 0)
        for bad in (10**7, -1):
            with pytest.raises(Exception, match="not in the vocabulary"):
                bpe_words.decode(spark.createDataFrame([(1, [bad])], "doc_id long, token_ids array<int>"), path).collect()


def test_repair_store_as_tokenizers(docs, tmp_path, monkeypatch):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    stored = repair_store.store(docs, path, end_id=2)
    monkeypatch.setattr(repair_store, "MAX_BROADCAST", 0 if len(rows) % 2 else 10**5)
    got = sorted(repair_store.read(docs.sparkSession, stored).collect(), key=lambda r: r.start)
    facts = sorted(repair_store.facts(docs.sparkSession, stored).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in facts] == [(r.doc_id, r.start, len(r.ids) // 4, zlib.crc32(bytes(r.ids))) for r in got]
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    want = sorted((r.doc_id, np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in rows)
    assert sorted((r.doc_id, bytes(r.ids)) for r in got) == want
    sizes = [len(r.ids) // 4 for r in got]
    assert [r.start for r in got] == np.cumsum([0, *sizes])[:-1].tolist()


def test_grammar_round_trip_and_ranges():
    r = np.random.default_rng(1)
    docs = [r.integers(0, 9, n).astype(np.uint32) for n in (1, 5000, 0, 3, 20_000, 0)]
    docs.append(np.zeros(4000, np.uint32))
    payload = repair_store.compress(docs)
    shard = repair_store.Shard(payload)
    assert len(payload) < 0.7 * 3 * sum(map(len, docs))
    for i, want in enumerate(docs):
        assert np.array_equal(shard.document(i), want)
        for a, b in ((0, len(want)), (len(want) // 3, len(want) // 2), (len(want), len(want))):
            assert np.array_equal(shard.ids(i, a, b), want[a:b])
    assert all(np.array_equal(a, b) for a, b in zip(shard.documents(), docs, strict=True))
    assert np.array_equal(shard.length, [len(shard.expand(np.array([shard.first + k], np.uint32))) for k in range(len(shard.length))])
    assert repair_store.Shard(repair_store.compress([])).documents() == []


def test_token_counts_as_sentencepiece(docs):
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs, path).collect())
    assert got == sorted((r.doc_id, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in docs.collect())


def test_parts_of_long_texts_add_up():
    count, safe = token_counts.counter(P.path("piece_bpe_32k.model"))
    assert safe
    for text in odd_texts()[6:]:
        for size in (1, 7, 100):
            assert sum(count(token_counts.parts_of(text, size))) == count([text])[0]


def test_token_counts_by_tokenizers_file(docs):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = sorted((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect())
    assert got == sorted((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())


def test_empty_tables(docs):
    none = docs.where("doc_id < -1")
    assert bpe_words.encode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert repair_store.read(none.sparkSession, repair_store.store(none, P.path("byte_bpe_50k.json"), 2)).count() == 0
    assert token_counts.count_tokens(none, P.path("piece_bpe_32k.model")).count() == 0


def test_queries(spark, tmp_path):
    rows = [(3, "b b b"), (1, None), (2, "Été 12")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, want = 0, []
    for doc, text in sorted(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op1_repair_store(spark, str(tmp_path)).collect()) == want
    nine = {r.doc_id: r for r in queries.op9_bpe_words(spark, str(tmp_path)).collect()}
    assert nine[1].n_tokens == 0 and nine[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert nine[2].decoded_sha256 == hashlib.sha256("Été 12".encode()).hexdigest()
    five = {r.doc_id: r for r in queries.op5_token_counts(spark, str(tmp_path)).collect()}
    assert five[1].n_tokens == 0 and five[1].n_bytes == 0 and not five[2].over_limit


def test_a_grammar_leaves_no_frequent_pair():
    r = np.random.default_rng(5)
    words = [r.integers(0, 300, r.integers(2, 30)) for _ in range(400)]
    docs = [np.concatenate([words[k] for k in r.zipf(1.3, 60) % 400]).astype("<u4") for _ in range(40)]
    docs += [np.full(1000, 7, "<u4"), np.zeros(0, "<u4"), *[np.array([500, 501], "<u4")] * 6, np.arange(2000, dtype="<u4") % 2]
    shard = repair_store.Shard(repair_store.compress(docs))
    assert all(np.array_equal(a, b) for a, b in zip(shard.documents(), docs, strict=True))
    count, used = Counter(), {}
    for k in range(len(docs)):
        s = shard.symbols[shard.offsets[k] : shard.offsets[k + 1]].tolist()
        for i, pair in enumerate(zip(s, s[1:])):
            if used.get(pair) != (k, i - 1):
                count[pair] += 1
                used[pair] = k, i
    assert max(count.values()) < repair_store.MIN_COUNT


def plain_repair(docs):
    """Symbols and rules left by replacing the most frequent pair, one at a time."""
    docs, fresh, rules = [list(map(int, d)) for d in docs], 10**6, 0
    while True:
        count = Counter()
        for d in docs:
            i = 0
            while i < len(d) - 1:
                count[d[i], d[i + 1]] += 1
                i += 2 if i + 2 < len(d) and d[i] == d[i + 1] == d[i + 2] else 1
        if not count or count.most_common(1)[0][1] < repair_store.MIN_COUNT:
            return sum(map(len, docs)), rules
        pair = count.most_common(1)[0][0]
        for k, d in enumerate(docs):
            out, i = [], 0
            while i < len(d):
                both = i + 1 < len(d) and (d[i], d[i + 1]) == pair
                out.append(fresh if both else d[i])
                i += 2 if both else 1
            docs[k] = out
        fresh, rules = fresh + 1, rules + 1


def test_grammar_is_as_small_as_a_plain_one():
    r = np.random.default_rng(8)
    words = [r.integers(0, 200, r.integers(1, 9)) for _ in range(300)]
    docs = [np.concatenate([words[k] for k in r.zipf(1.4, 60) % 300]).astype("<u4") for _ in range(40)]
    symbols, rules = plain_repair(docs)
    shard = repair_store.Shard(repair_store.compress(docs))
    ours, plain = (3 * s + 12 * n for s, n in ((len(shard.symbols), len(shard.length)), (symbols, rules)))
    assert ours <= 1.03 * plain, (len(shard.symbols), len(shard.length), symbols, rules)
