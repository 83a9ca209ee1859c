import random

from pyspark.sql import functions as F
from tickforge.llm import merkle_audit, warc


def audit(spark, good, other):
    make = lambda rows: merkle_audit.Tree(spark.createDataFrame(rows, "key long, record string, digest string, node long"))
    return {(r.key, r.status) for r in merkle_audit.audit(make(good), make(other)).collect()}


def test_findings_as_plain_comparison(spark):
    r = random.Random(1)
    good = {k: f"record {k} " + "x" * r.randint(0, 50) for k in r.sample(range(-3000, 200_000), 1500)}
    other = dict(good)
    want = set()
    for k in r.sample(sorted(good), 25):
        other[k] += "!"
        want.add((k, "corrupt"))
    for k in r.sample(sorted(set(good) - {k for k, _ in want}), 10):
        del other[k]
        want.add((k, "missing"))
    other[999_999] = "new"
    want.add((999_999, "extra"))
    rows = lambda d: [(k, v, "clash", 1) for k, v in d.items()]
    assert audit(spark, rows(good), rows(other)) == want
    assert audit(spark, rows(good), rows(good)) == set()


def test_odd_rows(spark):
    good = [(1, "a", "", 0), (1, "a", "", 0), (1, "b", "", 0), (2, None, "", 0), (None, "z", "", 0)]
    assert audit(spark, good, good) == set()
    assert audit(spark, good, good[1:]) == {(1, "corrupt")}  # a copy less
    assert audit(spark, good, [(1, "a", "", 0), (1, "a", "", 0), (1, "b", "", 0), (2, "", "", 0), (None, "z", "", 0)]) == set()
    assert audit(spark, good, []) == {(1, "missing"), (2, "missing"), (None, "missing")}
    assert audit(spark, [], good) == {(1, "extra"), (2, "extra"), (None, "extra")}
    assert audit(spark, [], []) == set()
    assert audit(spark, [(1, "a", "", 0), (None, "z", "", 0)], [(1, "a", "", 0), (None, "y", "", 0)]) == {(None, "corrupt")}
    many = [(5, f"record {k}", "", 0) for k in range(3000)]  # one hot key
    assert audit(spark, many, many[::-1]) == set() and audit(spark, many, [*many[1:], many[1]]) == {(5, "corrupt")}


def test_offsets_follow_key_order(spark):
    r = random.Random(2)
    rows = [(k, "y" * r.randint(0, 9)) for k in r.sample(range(100_000), 800)]
    tree = merkle_audit.Tree(spark.createDataFrame(rows, "key long, record string")).grow(4)
    start = 0
    want = []
    for k, v in sorted(rows):
        want.append((k, start, len(v)))
        start += len(v)
    got = merkle_audit.offsets(tree).where(F.col("records") == 1).select("key", "start", "size").collect()
    assert sorted(tuple(x) for x in got) == want


def test_the_descent_compares_few_nodes(spark):
    rows = [(k, f"record {k}") for k in range(0, 3_000_000, 100)]
    other = [(k, v + "!" if k in (500_000, 500_100, 2_000_000) else v) for k, v in rows]
    good, replica = (merkle_audit.Tree(spark.createDataFrame(x, "key long, record string")) for x in (rows, other))
    segments, compared = merkle_audit.descend(good, replica)
    assert {r.node for r in segments.collect()} == {500_000 // 256, 500_100 // 256, 2_000_000 // 256}
    assert sum(compared) < 400 < good.levels[0].count() / 20
    assert {r.key for r in merkle_audit.findings(good, replica, segments).collect()} == {500_000, 500_100, 2_000_000}


def warc_bytes(n, r):
    return [b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, len(x), x) for k in range(n) for x in [bytes(r.choices(b"ab\r\n", k=r.randint(0, 300)))]]


def test_warc_records_keep_their_places(spark, tmp_path):
    import gzip
    import hashlib

    r = random.Random(4)
    records = warc_bytes(50, r)
    tricky = b"WARC/1.0\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 12\r\n\r\nWARC/1.1\r\n..\r\n\r\n"
    cut, torn = records[3][:-9], b"no record at all "
    files = {"a.warc": [*records[:20], tricky, *records[20:]], "b.warc": [torn, *records[:3], cut, *records[4:9]], "c.warc": []}
    for name, parts in files.items():
        (tmp_path / name).write_bytes(b"".join(parts))
    packed = [gzip.compress(x) for x in records]
    (tmp_path / "d.warc.gz").write_bytes(b"".join(packed))
    (tmp_path / "e.warc.gz").write_bytes(b"".join(packed)[: -len(packed[-1]) // 2])
    got = {}
    for g in warc.read(spark, str(tmp_path)).collect():
        got.setdefault(g.file.rsplit("/", 1)[1], []).append(g)
    for name, parts in [*files.items(), ("d.warc.gz", packed)]:
        at, rows = 0, sorted(got.get(name, []), key=lambda g: g.offset)
        assert len(rows) == len(parts)
        for g, x in zip(rows, parts, strict=True):
            whole = gzip.decompress(x) if name.endswith("gz") else x
            assert (g.offset, g.length, g.digest, g.size) == (at, len(x), hashlib.sha256(whole).hexdigest(), len(whole))
            at += len(x)
    assert [g.record_id for g in sorted(got["b.warc"], key=lambda g: g.offset)] == [None, *(f"urn:page:{k}" for k in range(9))]
    assert len(got["e.warc.gz"]) == 50
